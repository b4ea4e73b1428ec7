"""Chat round trip and Feistel sharding."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import chat, sharding
from tests.llm import messy

NASTY = ["", " ", "plain", "[INST]", "[/INST]", "</s>[INST] ok [/INST]", "\\", "\\\\[INST\\]", "[\\INST]", "<", "[", "<</SYS>>",
         "<<s>>", "<s\\>", "<<ROLE 41>>x<</ROLE>>", "a\nb\\n", "<<SYS\\>>\\", "[INST\\]é漢", "</", "<s>" * 50, None]


def conv_rows():
    rows = []
    for c, t in enumerate(NASTY):
        rows += [(c, 0, "user", t), (c, 1, "assistant", t)]
    rows += [(100, i, r, t) for i, (r, t) in enumerate([("system", "be [INST] kind"), ("user", "q"), ("assistant", "</s>"),
                                                        ("tool", "<</ROLE>>"), (None, "no role"), ("r]\\ >>", "odd")])]
    rows += [(101, 1, "assistant", "b"), (101, 0, "assistant", "a"), (101, 0, "assistant", "a"), (101, None, "user", "first")]
    rows += [(None, 0, "user", "lost"), (102, 0, "user", "x" * 300_000 + "</s>")]
    return rows


def test_round_trip_digests(spark):
    rows = conv_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    f = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(f).collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in f.collect():
        assert len(r["formatted"]) == sum(x["chars"] for x in r["layout"])
        assert r["level"] <= 1
    raw = {r["conv_id"]: r["formatted"] for r in f.collect()}
    assert raw[2] == "[INST]plain[/INST]<s>plain</s>"


def test_parser_rejects_what_the_grammar_does_not_allow(spark):
    bad = ["", "x", "[INST]a", "[INST]a</s>", "x[INST]a[/INST]", "[INST]a[/INST]x", "[INST][INST]a[/INST]", "[/INST]a[INST]"]
    got = spark.createDataFrame([(b,) for b in bad], "f string").select(chat.parse(F.col("f")).alias("p")).collect()
    assert all(r["p"] is None for r in got)


def test_loss_mask_is_cut_out_of_the_text(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    monkeypatch.setattr(chat, "CHUNK", 5)
    rows = [(c, i, r, "é漢\U0001f600</s>\\ab"[: (i * 5 + c) % 13]) for c in range(12) for i in range(c)
            for r in (("user", "assistant", "tool", "assistant")[i % 4],)]
    f = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r["m"] for r in f.select("conv_id", chat.masked(F.col("formatted"), F.col("layout")).alias("m")).collect()}
    assert got == {c: [x for d, _, r, x in rows if d == c and r == "assistant"] for c in range(1, 12)}
    lens = spark.createDataFrame([([i % 3 for i in range(n)],) for n in range(23)], "a array<long>")
    for r in lens.select("a", chat.starts(F.col("a")).alias("s")).collect():
        assert r["s"] == [sum(r["a"][:i]) for i in range(len(r["a"]))]


def test_a_wrong_loss_mask_raises(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "answer")],
                               "conv_id long, turn long, role string, text string")
    f = chat.format_chats(df)
    for field, value in (("loss_chars", F.lit(5)), ("loss_from", F.lit(2)), ("loss", F.lit(False))):
        def put(x):
            return x.withField(field, value)  # noqa: B023
        wrong = f.withColumn("layout", F.transform("layout", put))
        with pytest.raises(Exception, match="loss mask"):
            chat.read_back(wrong).collect()


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(df)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000])
def test_permutation_is_a_bijection(spark, n):
    p = [r[0] for r in spark.range(n).select(sharding.locate(F.col("id"), F.lit(n).cast("long"))).collect()]
    assert sorted(p) == list(range(n))
    if n >= 50:
        assert p != sorted(p)


def test_shards(spark):
    docs = messy.table(spark)
    got = sharding.shard_rows(docs, 8).collect()
    want = Counter((i, len((t or "").encode()) + 1) for i, t, _ in messy.rows())
    assert Counter((r["doc_id"], r["size"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_rows(docs.repartition(7), 8).collect()  # the shuffle depends on content alone
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_shards_of_one_repeated_row_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 16)
    df = spark.range(1000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_rows(df, 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert [(r["n"], r["m"]) for r in got] == [(125, 124)] * 8
    assert sharding.shard_rows(df.limit(0), 8).count() == 0
