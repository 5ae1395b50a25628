"""grounded: a Spark-native corpus, retrieval, answering and moderation engine.

Every operator is a lazy ``DataFrame -> DataFrame`` transformation.  Heavy
work (tokenising, hashing, joins, ranking) runs in JVM expressions; the only
Python on executors is NumPy inside ``mapInPandas`` for dense similarity.
"""

from grounded.config import EngineConfig, SearchConfig, TextConfig, EmbedConfig, AnswerConfig
from grounded.session import build_session, scratch_dir

__all__ = [
    "EngineConfig", "SearchConfig", "TextConfig", "EmbedConfig", "AnswerConfig",
    "build_session", "scratch_dir",
]
