"""Personal-data spans against plain Python."""

import re

from hypothesis import given, settings, strategies as st

from grounded.operators import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    spans = []
    for no, (cat, pattern) in enumerate(pii.CANDIDATES):
        for m in re.finditer(pattern, text, re.ASCII):
            s, start = m.group(), m.start()
            digits = re.sub("[^0-9]", "", s)
            if cat == "CARD" and not ((13 <= len(s) <= 19 if s == digits else len(digits) == 16) and luhn(digits)):
                continue
            if cat == "IP" and not (s.count(".") == 3 and all(len(p) <= 3 and int(p) <= 255 for p in s.split("."))):
                continue
            if cat == "PHONE" and len(s.rsplit("-", 1)[1]) != 4:
                continue
            if cat == "EMAIL" and (".." in s.split("@")[-1] or s.split("@")[-1].startswith(".")):
                continue
            if cat == "SECRET":
                start = m.end() - len(re.search("[A-Za-z0-9_-]+$", s).group())
            spans.append((start, -m.end(), no, cat))
    out = []
    for start, last, _, cat in sorted(spans):
        size = -last - start
        if out and start < out[-1][1]:
            a, b, c, longest, n = out[-1]
            out[-1] = (a, max(b, -last), cat if size > longest else c, max(size, longest), n + 1)
        else:
            out.append((start, -last, cat, size, 1))
    return [(a, b, c, n) for a, b, c, _, n in out]


def hide(text, found):
    out, at = "", 0
    for a, b, c, _ in found:
        out, at = out + text[at:a] + f"[{c}]", b
    return out + text[at:]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in pii.pii_spans(df, "t", "id").collect():
        got.setdefault(r.id, []).append((r.start, r.stop, r.category, r.n_spans))
    red = {r.id: (r.redacted, r.n_regions) for r in pii.redact(df, "t").collect()}
    for i, t in enumerate(texts):
        want = plain(t or "")
        assert sorted(got.get(i, [])) == want, t
        assert red[i] == (None if t is None else hide(t, want), len(want)), t


def test_known_cases(spark):
    check(spark, [
        "mail me at Joe.Doe+x@example.com, or joe@ex..com, or @ex.com", "card 4111111111111111 and 4111111111111112 and 4111 1111 1111 1111 4111-1111-1111-1111",
        "4111111111111111 4111111111111111", "4111 1111 1111 11112", "ip 10.0.0.1. and 256.1.1.1 and 1.2.3.4.5 and 1.2.3 and 0001.2.3.4", "+1 (555) 123-4567 and +1 (555) 123-45678",
        'api_key = "AAAABBBBCCCC4111111111111111" Password: short', "token=4111111111111111", "é😀 4111111111111111 😀 10.0.0.1", "", None, "nothing here",
        "a4111111111111111@example.com", "10.0.0.1@example.com", "1" * 5000, "4111111111111111 " * 300])


words = st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "299.0.0.1", "a@b.co", "a@b..co", "+44 (020) 123-4567", "token=", "secret: ",
                         "ABCDEFGHIJKLMNOP", "0123456789abcdef-_", "x", "é", "😀", ".", "-", "5", "\n"])


@settings(max_examples=20, deadline=None)
@given(batch=st.lists(st.builds(lambda ws, sep: sep.join(ws), st.lists(words, max_size=8), st.sampled_from(["", " ", "-"])), min_size=10, max_size=25))
def test_any_mix(spark, batch):
    check(spark, batch)
