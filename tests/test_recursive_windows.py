"""Boundary-aware windows: no character lost, bounds kept, the strongest separators used."""

from hypothesis import given, settings, strategies as st

from grounded.config import TextConfig
from grounded.operators import text as txt

pieces = st.lists(st.sampled_from(["a", "bb ", "ccc", "\n", "\n\n", " ", "é😀", "x" * 7, ". "]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(text=pieces, size=st.integers(1, 20), share=st.floats(0, 0.99))
def test_spans(text, size, share):
    overlap = int(size * share)
    spans = txt.recursive_spans(text, size, overlap)
    assert (not spans) == (not text)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap          # on, without a gap, sharing no more than the overlap
    assert all(0 < b - a <= size for a, b in spans)


def test_separators_in_their_order():
    cut = lambda t, size, overlap=0: [t[a:b] for a, b in txt.recursive_spans(t, size, overlap)]
    assert cut("one two\n\nthree four", 12) == ["one two\n\n", "three four"]
    assert cut("one two\nthree four", 12) == ["one two\n", "three four"]
    assert cut("one two three four", 9) == ["one two ", "three ", "four"]
    assert cut("abcdefghij", 4) == ["abcd", "efgh", "ij"] and cut("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    assert cut("short", 800, 200) == ["short"] and cut("", 5) == [] and txt.recursive_spans(None, 5, 0) == []


def test_rows(spark):
    long = "word " * 5000 + "y" * 3000
    rows = [(1, "a b", "k"), (2, None, "k"), (3, "", "k"), (3, long, "k"), (None, "é😀 " * 500, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string")
    got = txt.recursive_windows(df, cfg=TextConfig(char_window=100, char_overlap=30))
    assert got.columns == ["doc_id", "i", "start", "chunk"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.i, r.start, r.chunk))
    assert set(by) == {1, 3, None}
    for key, text in ((1, "a b"), (3, long), (None, "é😀 " * 500)):
        spans = txt.recursive_spans(text, 100, 30)
        assert sorted(by[key]) == [(i, a, text[a:b]) for i, (a, b) in enumerate(spans)]
