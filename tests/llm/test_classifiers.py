"""Language ID, toxicity and quality: gradients, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusforge.llm import langid, quality, toxicity
from corpusforge.llm.common import text_buffer
from tests.llm import messy

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_backpropagation_through_time_matches_differences():
    rng = np.random.default_rng(0)
    p = {"table": (rng.standard_normal((256, 6)) * 0.2).astype(np.float64), "uf": rng.standard_normal((3, 3)) * 0.1,
         "uc": rng.standard_normal((3, 3)) * 0.1}
    p["table"][:, :3] += 0.5  # keep the gates inside their linear range
    x = rng.integers(0, 256, (5, 4))
    w = rng.standard_normal((5, 4, 3))
    for reverse in (False, True):
        states, tape = langid._train_sweep(x, p, reverse)
        grad = langid._through_time(x, p, tape, w)
        base = (states * w).sum()
        for name, at in (("uf", (1, 2)), ("uc", (0, 1)), ("table", (int(x[2, 1]), 4)), ("table", (int(x[3, 0]), 0))):
            p[name][at] += 1e-3
            up = (langid._train_sweep(x, p, reverse)[0] * w).sum()
            p[name][at] -= 1e-3
            assert abs((up - base) / 1e-3 - grad[name][at]) < 5e-3 * max(1, abs(grad[name][at]))


def test_language_held_out_accuracy(spark, docs):
    model = langid.fit(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    m = messy.table(spark)
    out = langid.predict(m, model).collect()
    assert len(out) == m.count()
    by = {r["doc_id"]: r for r in out}
    for i in (104, 105, 106, 107):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    assert by[108]["lang_pred"] != "und"
    kept = langid.keep_known(m, model, min_score=0.0)
    assert kept.columns == m.columns
    assert {r["doc_id"] for r in m.collect()} - {r["doc_id"] for r in kept.collect()} <= {104, 105, 106, 107, None}
    assert langid.predict(m.limit(0), model).count() == 0


def test_language_without_training_rows(spark):
    m = messy.table(spark, [(1, "abc", None), (2, None, "aa")])
    got = langid.predict(m, langid.fit(m)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_pooled_labels_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [messy.words(rng, n) for n in (1, 5, 60, 400)] + ["", None]
    net = langid.train_network(np.random.default_rng(1).integers(0, 256, (40, langid.SPAN)), np.arange(40) % 2, 2, steps=2)
    whole = langid.pooled(net, *text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(langid.pooled(net, *text_buffer(pa.array([t])))[0], whole[i], atol=1e-5)


def brute_pooled(table, raw):
    k, _, f = table.shape
    b = np.frombuffer(raw + bytes(k - 1), np.uint8)
    resp = np.stack([sum(table[j][b[i + j]] for j in range(k)) for i in range(len(raw))])
    halves = [np.maximum(resp[i:i + quality.HALF].max(0), 0) for i in range(0, len(raw), quality.HALF)]
    chunks = [np.maximum(a, b_) for a, b_ in zip(halves, halves[1:])] or halves
    return np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)])


def test_pooling_covers_the_whole_text(monkeypatch):
    monkeypatch.setattr(quality, "SEGMENT", 1024)
    monkeypatch.setattr(quality, "SLICE", 2000)
    rng = np.random.default_rng(4)
    table = rng.standard_normal((quality.WIDTH, 256, 5)).astype(np.float32)
    raws = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 3, 255, 256, 257, 1024, 1025, 5000)]
    offs = np.concatenate([[0], np.cumsum([0, *map(len, raws)])])
    got = quality.pooled(table, np.frombuffer(b"".join(raws), np.uint8), offs)
    assert not got[0].any()
    for g, raw in zip(got[1:], raws):
        assert np.allclose(g, brute_pooled(table, raw), atol=1e-4)


def rates(got, labels, col):
    y = {r["doc_id"]: r[col] for r in labels.collect()}
    held = [(y[r["doc_id"]], r["predicted"], r["score"]) for r in got if r["held_out"] and r["doc_id"] in y]
    pos, neg = [s for t, _, s in held if t], [s for t, _, s in held if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    return auc, sum(t == p for t, p, _ in held) / len(held)


def test_quality_held_out(spark, docs, labels):
    model = quality.fit(docs, labels)
    got = quality.predict(docs, model).collect()
    auc, right = rates(got, labels, "quality")
    assert auc > 0.9 and right > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    m = quality.predict(messy.table(spark), model).collect()
    assert len(m) == len(messy.rows())
    by = {r["doc_id"]: r["score"] for r in m}
    assert by[104] == by[105]
    assert quality.predict(docs.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has ten toxic documents in the held-out fold
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.predict(docs, model).collect()
    auc, right = rates(got, labels, "toxic")
    assert auc > 0.93 and right > 0.95
    m = messy.table(spark)
    out = toxicity.predict(m, model).collect()
    assert len(out) == m.count() and all(0 <= r["score"] <= 1 for r in out)
    kept = toxicity.drop_toxic(m, model)
    assert kept.columns == m.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in out)
    assert toxicity.drop_toxic(m.limit(0), model).count() == 0


def test_labels_that_teach_nothing(spark):
    m = messy.table(spark)
    none = spark.createDataFrame([(1, None, None), (None, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(m, none) == {"prior": 0.5}
    assert toxicity.fit(m, none) is None
    assert {r["score"] for r in toxicity.predict(m, None).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert quality.fit(m, one)["prior"] == 1.0


def test_negative_part_of_the_risk_is_walked_back():
    pos = [{"a": 1, "w": 1}] * 20
    unl = [{"a": 1, "w": 1}] * 2 + [{"w": 1}] * 60
    m = toxicity.train_classifier(pos, unl, 0.1)
    s = toxicity.score_texts({"weights": {k: v for k, v in m["weights"].items()}, "intercept": m["intercept"]}, ["a w", "w", ""])
    assert s[0] > s[1] and np.isfinite(s).all()
