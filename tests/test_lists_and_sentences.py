"""Lists without ids, group-preserving split, totals, learned sentence boundaries."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corpusforge.config import SplitConfig
from corpusforge.operators import joins, report, sentences
from corpusforge.operators.split import group_split, split_counts
from corpusforge.session import shared_dir


# ------------------------------------------------------------- lists
def _write_lists(tmp, sizes, name):
    """One file of JSON lines a size; the last file is the shorter tail."""
    at, d = 0, tmp / name
    os.makedirs(d)
    for k, n in enumerate(sizes):
        (d / f"part-{k:03d}.json").write_text("".join(f'{{"{name}": "{name} {i}"}}\n' for i in range(at, at + n)))
        at += n
    return str(d), at


@pytest.mark.parametrize("left,right", [([5, 1, 30], [10, 10, 10, 6]), ([7], [2, 0, 9]), ([3, 3], [4])])
def test_pairs_by_position_over_several_files(spark, tmp_path, left, right):
    a, n = _write_lists(tmp_path, left, "summary")
    b, m = _write_lists(tmp_path, right, "output")
    pairs, counts = joins.pair_by_position(spark.read.schema("summary string").json(a), spark.read.schema("output string").json(b))
    got = sorted((r["position"], r["summary"], r["output"]) for r in pairs.collect())
    assert got == [(i, f"summary {i}", f"output {i}") for i in range(min(n, m))]
    assert {r["check"]: r["value"] for r in counts.collect()} == {
        "predictions": n, "references": m, "pairs": min(n, m), "unpaired_predictions": max(n - m, 0), "unpaired_references": max(m - n, 0)}


def test_places_in_a_file_of_several_splits(spark, tmp_path):
    a, n = _write_lists(tmp_path, [4000, 10, 2000], "summary")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        rows, chunks = joins.numbered(spark.read.schema("summary string").json(a))
        assert chunks.count() > 10  # splits of the large files
        assert sorted((r["position"], r["summary"]) for r in rows.collect()) == [(i, f"summary {i}") for i in range(n)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_places_in_parquet_and_a_clashing_column(spark):
    path = shared_dir(spark, "list-test")
    spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").withColumn("position", F.lit("old")).write.parquet(path)
    rows, _ = joins.numbered(spark.read.parquet(path))
    assert all(r["position"] == r["id"] for r in rows.collect()) and rows.columns == ["id", "position"]


# ------------------------------------------------------------- split by groups
def _brute_group_split(rows, cfg):
    sizes: dict = {}
    for _, g in rows:
        h = hashlib.sha256(f"{cfg.seed}:{g or ''}".encode()).hexdigest()
        sizes[h] = sizes.get(h, 0) + 1
    te = int(len(rows) * cfg.train_ratio)
    ve, start, of = te + int(len(rows) * cfg.valid_ratio), 0, {}
    for h in sorted(sizes):
        of[h] = "train" if start < te else "valid" if start < ve else "test"
        start += sizes[h]
    return {i: of[hashlib.sha256(f"{cfg.seed}:{g or ''}".encode()).hexdigest()] for i, g in rows}


@pytest.mark.parametrize("cfg", [SplitConfig(), SplitConfig(0.5, 0.25, 0.25), SplitConfig(0.0, 0.5, 0.5), SplitConfig(1.0, 0.0, 0.0)])
def test_group_split_keeps_groups(spark, cfg):
    rows = [(i, f"g{i % 61}") for i in range(400)] + [(1000 + i, "hot") for i in range(200)] + [(2000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, g string")
    got = {r["doc_id"]: r["split"] for r in group_split(df, "g", cfg).collect()}
    assert got == _brute_group_split(rows, cfg)
    by: dict = {}
    for i, g in rows:
        by.setdefault(g, set()).add(got[i])
    assert all(len(s) == 1 for s in by.values())


def test_group_split_empty_and_no_shuffle_of_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, input string")
    assert group_split(df.limit(0)).count() == 0
    plan = group_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# ------------------------------------------------------------- totals
def test_split_counts_totals(spark):
    df = spark.createDataFrame([("en", "train"), ("en", "test"), ("fr", "train"), (None, "train")], "lang string, split string")
    got = {(r["level"], r["lang"], r["split"]): r["n"] for r in split_counts(df, totals=True).collect()}
    assert got == {(0, "en", "train"): 1, (0, "en", "test"): 1, (0, "fr", "train"): 1, (0, None, "train"): 1,
                   (1, "en", None): 2, (1, "fr", None): 1, (1, None, None): 1, (2, None, None): 4}


def test_length_totals_and_message_of_an_empty_set(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "xxx", None), ("b", None, None)], "g string, t string, u string")
    got = {(r["level"], r["g"], r["column"]): r for r in report.length_report_totals(df, ["g"], ["t", "u"]).collect()}
    assert len(got) == 6
    r = got[1, None, "t"]
    assert (r["count"], r["min"], r["max"], r["mean"], r["median"], r["percentile_90"], r["message"]) == (2, 1, 3, 2.0, 2.0, 3, None)
    assert (got[0, "b", "u"]["count"], got[0, "b", "u"]["mean"], got[0, "b", "u"]["message"]) == (0, None, "No valid 'u' fields found.")
    plan = report.length_report_totals(df, ["g"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 2  # the columns, and the grouping sets


# ------------------------------------------------------------- sentences
def _corpus(spark):
    rows = []
    for i in range(60):
        rows.append((i, "en", f"We met Dr. Smith at noon. The meeting with Dr. Jones took {i} hours. The end was near. "
                              "He went home, i.e. to bed. The cat sat there. She saw the cat. The doctor went. We sat down. "
                              "The bed near noon and the cat there went down for hours as the doctor said so. "
                              "At noon the bed, near the cat, went down there for hours or so they said."))
        rows.append((100 + i, "de", "Das ist z.B. ein Satz. Der Hund kam usw. und ging. Der Hund sah ein Haus. Ein Haus war da. Der Satz war kurz. "
                                    "Der kurz da war ging im Haus ein Satz weit und mehr."))
    return spark.createDataFrame([*rows, (900, "en", None), (901, None, "Alone here. And there."), (902, "en", "")], "doc_id long, lang string, text string")


def test_sentence_boundaries_are_learned(spark):
    docs = _corpus(spark)
    model = sentences.train(docs, "text", "lang")
    assert {"dr", "i.e"} <= model["en"]["abbreviation"] and not {"noon", "near", "bed", "cat"} & model["en"]["abbreviation"]
    assert "z.b" in model["de"]["abbreviation"] and "kurz" not in model["de"]["abbreviation"]
    assert "the" in model["en"]["starter"]
    out = {r["doc_id"]: r["l"] for r in docs.select("doc_id", sentences.lines(F.col("text"), F.col("lang"), model).alias("l")).collect()}
    assert out[0].split("\n") == ["We met Dr. Smith at noon.", "The meeting with Dr. Jones took 0 hours.", "The end was near.",
                                  "He went home, i.e. to bed.", "The cat sat there.", "She saw the cat.", "The doctor went.", "We sat down.",
                                  "The bed near noon and the cat there went down for hours as the doctor said so.",
                                  "At noon the bed, near the cat, went down there for hours or so they said."]
    assert out[100].split("\n")[0] == "Das ist z.B. ein Satz."
    assert out[900] is None and out[902] == "" and out[901] == "Alone here.\nAnd there."


def test_marks_numbers_and_initials():
    kinds = {"abbreviation": {"no"}, "starter": {"the"}, "collocation": {("no", "the")}}
    cut = lambda t, k=kinds: sentences.split_lines(t, k).split("\n")
    assert cut("Wait! Really? Yes.") == ["Wait!", "Really?", "Yes."]
    assert cut('He said "stop." Then left.') == ['He said "stop."', "Then left."]
    assert cut("J. Doe came on 3. March.") == ["J. Doe came on 3. March."]
    assert cut("It cost 3. The end.", kinds | {"collocation": set()}) == ["It cost 3.", "The end."]
    assert cut("See no. The five.") == ["See no. The five."]  # a collocation
    assert cut("And so on... Then more. ") == ["And so on...", "Then more. "]


def test_type_counts_equal_a_plain_count(spark):
    from collections import Counter
    docs = spark.createDataFrame([(1, "x", "A b. (C) 12. b. D... e"), (2, "x", "b. b"), (3, None, "Z.")], "doc_id long, lang string, text string")
    got = {(r["lang"], r["type"], r["dot"], r["next"]): r["n"] for r in sentences.type_counts(docs, "text", "lang").collect()}
    assert got == Counter({("x", "a", False, None): 1, ("x", "b", True, "c"): 1, ("x", "c", False, None): 1, ("x", "##number##", True, "b"): 1,
                           ("x", "b", True, "d"): 1, ("x", "d", True, "e"): 1, ("x", "e", False, None): 1, ("x", "b", True, "b"): 1,
                           ("x", "b", False, None): 1, (None, "z", True, None): 1})


def test_a_long_next_word_is_read_whole():
    long = "Q" + "x" * 120
    kinds = {"abbreviation": {"no"}, "starter": {long.lower()}}
    assert sentences.split_lines(f"See no. {long} is it.", kinds) == f"See no.\n{long} is it."
    assert sentences.split_lines(f"See no. {long} is it.", kinds | {"starter": {long.lower()[:80]}}) == f"See no. {long} is it."


def test_a_model_keeps_every_entry(spark):
    # 20,050 abbreviations of one language, each 40 times before a period
    words = ["q" + "".join(chr(97 + i // 26 ** k % 26) for k in range(3)) + "." + chr(97 + i % 7) for i in range(20_050)]
    counts = spark.createDataFrame([("x", w, True, "a", 40) for w in words] + [("x", "a", False, None, 40_000_000)],
                                   "lang string, type string, dot boolean, next string, n long")
    n = sentences.statistics(counts).where("kind = 'abbreviation'").count()
    model = sentences.Boundaries(sentences.statistics(counts).select("lang", "kind", "a", "b"))
    assert n == len(set(words)) > 20_000 and len(model.kinds["x"]["abbreviation"]) == n


def test_a_large_model_is_joined_with_equal_lines(spark, monkeypatch):
    docs = _corpus(spark).withColumn("two", F.concat(F.lit("No. 3. The end. "), "text")).repartition(3)
    docs = docs.unionByName(docs.where("doc_id < 3"))  # rows that come twice
    cut = lambda m: sorted((tuple(r) for r in sentences.with_lines(docs, ["text", "two"], "lang", m).collect()), key=repr)
    small = sentences.learn(docs, "text", "lang")
    want = cut(small)
    monkeypatch.setattr(sentences, "MAX_BROADCAST_ENTRIES", 1)
    monkeypatch.setattr(sentences, "BLOCK_ASKED", 10)
    large = sentences.learn(docs, "text", "lang")
    assert small.kinds is not None and large.kinds is None
    assert cut(large) == want and any("\n" in (r[2] or "") for r in want)


def test_words_are_counted_before_they_become_types(spark, monkeypatch):
    from collections import Counter
    texts = ["A b. (C) 12. b. D... e", " Dr. ", "x y. z\u0085q. \x1cb. c\tD.\nE ٣. Ⅳ. İs. ...", "", "   ", None, "a.b.c. Zz. Straße."]
    docs = spark.createDataFrame([(None if i % 3 else "x", t) for i, t in enumerate(texts * 3)], "lang string, text string").repartition(2)
    words = F.split("text", r"\s+")
    bare = lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}.]+$", ""))
    want = Counter()
    for r in docs.select("lang", F.transform(words, bare).alias("w")).where("w IS NOT NULL").collect():
        named = lambda w: sentences.NUMBER if (t := w.rstrip(".")).isascii() and t.isdigit() else t
        for a, b in zip(r["w"], [*r["w"][1:], None]):
            if named(a):
                want[r["lang"], named(a), a.endswith("."), named(b) if a.endswith(".") and b is not None else None] += 1
    monkeypatch.setattr(sentences, "HELD_WORDS", 3)  # handed over in many parts
    counts = sentences.type_counts(docs, "text", "lang")
    assert {(r["lang"], r["type"], r["dot"], r["next"]): r["n"] for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" not in plan.lower() and "mapinarrow" in plan.lower()  # no regular expression is run on every word
