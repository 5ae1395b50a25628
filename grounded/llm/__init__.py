"""Operations of a training-data pipeline: search, tokenisers, joins, classifiers, archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which counts as part of it)
imports it; ``__spark_entry__.py`` adds its queries when it can be imported."""
