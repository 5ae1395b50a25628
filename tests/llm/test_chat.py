"""Chat formatting: reversible escapes, exact masks, parts that equal wholes, digests of the table."""

import hashlib
import random

import public_tokenizers
import pytest

from grounded.llm import chat

SF = "/root/testdata/sf0.001"
ODD = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "<", "[", "\\", "/s>", "[\\INST]", "<\\\\/s>", "a", " ", "é", "🙂", "\n", "INST]"]


@pytest.fixture(scope="module")
def tokenizer():
    return chat.load_tokenizer(public_tokenizers.path(chat.VOCABULARY))


def test_reversible(tokenizer):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice(ODD) for _ in range(rng.randint(0, 12)))
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", text()]), text()) for _ in range(rng.randint(1, 6))]
        formatted, ids, starts, ends, _ = chat.format_part(tokenizer, turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in zip(starts, ends)] == [t for r, t in turns if r == "assistant" and t]
        assert tokenizer.decode(ids, skip_special_tokens=False) == formatted
        # The same turns one by one give the same ids.
        assert ids == [i for t in turns for i in chat.format_part(tokenizer, [t])[1]]


def digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest(),
                     len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = chat.conversation_digests(chat.format_conversations(df, **options)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == digests(rows)
    assert len(got) == len({r[0] for r in rows})
    return got


def test_table_and_planted(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = "</s>[INST] ok [/INST]"
    check(spark, rows + [(-7, 0, "user", own), (-7, 1, "assistant", own)])


def test_odd_rows_and_a_long_conversation(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (1, None, "user", "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"),
            (2, 5, "assistant", "z " * 200000), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (4, -3, "system", "s")]
    long = [(3, i, "assistant" if i % 2 else "user", f" turn {i} [INST]") for i in range(1000)]
    check(spark, rows + long)
    check(spark, rows + long, turns=7)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_conversations(df)).count() == 0


def test_parts_are_bounded_whatever_the_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHARS", 3000)
    rows = [(None, i % 60, "assistant" if i % 2 else "user", f"no conversation {i} " + "x" * (i % 90)) for i in range(900)]
    rows += [(1, None, "user", f"no turn {i}") for i in range(900)] + [(2, 3, "assistant", "again and again")] * 900
    rows += [(3, i, "user", "long " * 200) for i in range(30)] + [(3, 30, "assistant", "z" * 10000)]
    check(spark, rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = [chat.parse(r.formatted) for r in chat.format_conversations(df).collect()]
    assert max(map(len, parts)) <= chat.TURNS
    assert all(len(p) == 1 or sum(len(a) + len(b) for a, b in p) <= 3000 for p in parts)
