"""Decontamination: alignment against a plain table, planted copies, clean documents, odd rows."""

import random

import numpy as np
import pytest

from grounded.llm import decontaminate as dec

SF = "/root/testdata/sf0.01"


def plain(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        assert dec.align(a, b)[0] == plain(a, b)
    assert dec.align(np.array([1, 2, 3]), np.array([9, 1, 2, 3, 9])) == (3, 4)


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(f"zz{rng.randrange(999)}" if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append("extra")
    return out


def test_planted_copies_and_clean_documents(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng, items = random.Random(5), [(r.item_id, r.text) for r in bench.collect()]
    norm = lambda t: " ".join(dec.words_of(t))
    verbatim = {(r.doc_id, i) for r in docs.collect() for i, t in items if norm(t) in norm(r.text)}
    filler = [w for r in docs.limit(30).collect() for w in dec.words_of(r.text)]
    planted = []
    for k, (item, text) in enumerate(items):
        body = edited(rng, dec.words_of(text), 0.2)
        planted.append((10 ** 6 + item, " ".join(filler[k * 50:k * 50 + 80] + body + filler[k * 70:k * 70 + 200])))
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in dec.leaks(both, bench).collect()}
    assert {g for g in got if g[0] < 10 ** 6} == verbatim
    caught = {g[0] - 10 ** 6 for g in got if g[0] >= 10 ** 6 and g[0] - 10 ** 6 == g[1]}
    assert len(caught) >= 0.95 * len(items)
    assert {g[0] - 10 ** 6 for g in got if g[0] >= 10 ** 6} == caught
    clean = dec.clean(both, bench)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in both.collect()} - {g[0] for g in got}


def test_an_item_that_leaked_into_most_documents_is_found(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(i, (item if i % 3 else "nothing to see") + f" word{i}") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in dec.leaks(docs, bench).collect()} == {i for i in range(300) if i % 3}


def test_a_widely_leaked_part_and_a_rare_edited_copy(spark):
    words = [f"w{i}" for i in range(40)]
    part, other = " ".join(words[:20]), " ".join(w if i % 5 else "zz" for i, w in enumerate(words))
    rows = [(i, f"start {part} end {i}") for i in range(200)] + [(900, f"a {other} b")] + [(1000 + i, "w1 w2 w3 and so on") for i in range(500)]
    got = dec.leaks(spark.createDataFrame(rows, "doc_id long, text string"),
                    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {*range(200), 900}


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    bench, docs = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(tuple, dec.leaks(docs, bench).collect()))
    monkeypatch.setattr(dec, "BLOCK_CHARS", 3000)
    assert len(dec.blocks(bench)) > 2
    assert sorted(map(tuple, dec.leaks(docs, bench).collect())) == whole


@pytest.mark.parametrize("short", ["two words", "one", "three words here"])
def test_odd_rows(spark, short):
    rows = [(1, None, 0.0), (2, "", 0.0), (3, f"there are {short} in it", 1.0), (3, f"there are {short} in it", 1.0), (None, short, 2.0),
            (5, "two x words one-sided three here", 2.0), (6, "y " * 100000 + short, 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    bench = spark.createDataFrame([(1, short, "q"), (2, None, "q"), (3, "", "q"), (None, "no such words at all anywhere", "q")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.score) for r in dec.leaks(docs, bench).collect()), key=str)
    want = [(3, 1, 1.0), (3, 1, 1.0), (6, 1, 1.0), (None, 1, 1.0)] + ([(5, 1, 1.0)] if short == "one" else [])
    assert got == sorted(want, key=str)
    assert dec.leaks(docs.limit(0), bench).count() == 0 and dec.leaks(docs, bench.limit(0)).count() == 0
    assert dec.clean(docs, bench.limit(0)).count() == len(rows) and dec.clean(docs, bench).columns == docs.columns


def found(spark, docs, items):
    got = dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_parts_of_items_are_found(spark):
    words, short = [f"w{i}" for i in range(200)], [f"s{i}" for i in range(59)]
    docs = [(1, "before it " + " ".join(words[70:130]) + " after it"), (2, "a " + " ".join(short[30:50]) + " b"),
            (3, " ".join(words[100:113])), (4, " ".join(words[20:26]))]
    # A part of a tenth of the item, in more documents than any other part.
    docs += [(100 + i, f"page {i} " + " ".join(words[150:170])) for i in range(300)]
    got = found(spark, docs, [(1, " ".join(words)), (2, " ".join(short))])
    assert got == {(1, 1), (2, 2), (3, 1)} | {(100 + i, 1) for i in range(300)}


def test_copies_with_a_third_replaced_are_found(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(60))) for k in range(40)]
    third = lambda t: " ".join("zz" if j % 3 == 2 else w for j, w in enumerate(t.split()))
    less = lambda t: " ".join(w for j, w in enumerate(t.split()) if j % 3 != 2)
    some = lambda t: " ".join("zz" if rng.random() < 1 / 3 else w for w in t.split())
    for edit, least in ((third, 40), (less, 40), (some, 36)):
        got = found(spark, [(k, f"some words before {edit(t)} and after") for k, t in items], items)
        assert len(got) >= least and all(d == i for d, i in got)


def test_common_short_items_need_a_sentence_of_their_own(spark):
    docs = [(i, f"the answer {i} is yes and in the end we go") for i in range(50)]
    docs += [(100, "Text before. In the end! Text after."), (101, "a rare short item here"), (102, "Yes.")]
    got = found(spark, docs, [(1, "yes"), (2, "in the end"), (3, "rare short item")])
    assert got == {(100, 2), (101, 3)}
    bench = spark.createDataFrame([(1, "yes")], "item_id long, text string")
    assert dec.clean(spark.createDataFrame(docs, "doc_id long, text string"), bench).count() == len(docs)


def test_a_template_of_many_items_is_evidence_for_none(spark):
    """An instruction of 20 words that stands in 60 items; the items' own words still are found, and so is a template that is an item."""
    template = " ".join(f"t{j}" for j in range(20))
    items = [(k, f"{template} " + " ".join(f"i{k}w{j}" for j in range(30))) for k in range(60)]
    docs = [(1, f"we begin {template} and go on"), (2, f"before {items[7][1]} after"), (3, " ".join(f"i9w{j}" for j in range(4, 24))), (4, f"x {template} i3w0 i3w1 i3w2 y")]
    assert found(spark, docs, items) == {(2, 7), (3, 9)}
    few = items[:5]                                    # in few items the run is evidence
    assert found(spark, docs[:1], few) == {(1, k) for k in range(5)}
    same = [(k, template) for k in range(60)]          # equal items are one item
    assert found(spark, docs[:1], same) == {(1, k) for k in range(60)}
    near = [(k, f"{template} own{k}") for k in range(60)]      # hardly a word of their own: the run stays evidence
    assert found(spark, docs[:1], near) == {(1, k) for k in range(60)}


def test_all_pairs_by_whole_alignment(spark):
    """Every document is aligned whole with every item: nothing that reaches the bound is missed, nothing else is found."""
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").collect()]
    rng = random.Random(11)
    for k, (i, text) in enumerate(bench[:20]):
        docs.append((10 ** 6 + k, " ".join(edited(rng, dec.words_of(text), 0.1 + k / 40))))
    docs = docs[-220:]
    numbers: dict = {}
    coded = lambda t: np.array([numbers.setdefault(w, len(numbers) + 1) for w in dec.words_of(t)], np.int64)
    want = set()
    items = [(i, coded(t)) for i, t in bench]
    for d, t in docs:
        doc = coded(t)
        for i, item in items:
            if len(item) >= dec.LEAST and dec.align(item, doc)[0] >= dec.needed(len(item), dec.THRESHOLD):
                want.add((d, i))
    got = {g for g in found(spark, docs, bench) if len(dict(items)[g[1]]) >= dec.LEAST}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) >= 15


def test_rows_of_one_text_go_together(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog again", "__leak") for i in range(50)] + [(99, "clean", "k"), (100, None, "n")],
                                 "doc_id long, text string, id string")
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    kept = dec.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [99, 100]
