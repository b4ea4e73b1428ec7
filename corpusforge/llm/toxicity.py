"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic documents are the positives; every other training document,
whatever its label, is unlabelled text. A linear classifier over a document's
distinct lower-cased words, their beginnings and their number (as log2(1 + number
of words that carry a feature)) minimises the class-prior
corrected, non-negative risk over the FEATURES that lead most among the positives

    prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic))

with the logistic loss; where the second part turns negative, its gradient is
walked back. The prior is the share of toxic rows among all labelled training
rows. An L1 step, as strong as the noise of so few positives, keeps words without
evidence at exactly 0, on little data as on much.

The fit uses a bounded sample: at most ``max_pos`` positives and about
``max_unl`` unlabelled documents, drawn by a hash of the id.

Defined results: null and empty text score the classifier's intercept; without
a confirmed positive, or in an empty table, every score is 0; null labels count as
unlabelled; of the texts of a repeated id the least is learned; features that lead
equally are taken by name; repeated rows get equal results; texts of any length are
read whole, in runs of bounded size; extra columns pass through `drop_toxic` and are
ignored by `predict`, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import byte_slices, crc_fold, hash_fraction, staged

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
#: The feature of all words: its count is the number of distinct words of a text.
SIZE = ""
#: Candidates: the FEATURES that lead most of those that LEAST positives hold. A step of L1 takes what noise of that many
#: candidates among so few positives would give (times the prior); what it leaves at 0 is not a feature.
FEATURES, LEAST, ROUNDS, NOISE = 1000, 3, 800, 0.02
#: How far the corrected risk may fall under 0 before its gradient is walked back.
SLACK = 0.05
#: A word table of a Python worker is dropped at this size (memory bound).
CACHE = 300_000


def features(word: str) -> tuple[str, ...]:
    """A word, its longer beginnings, and SIZE, which every word carries."""
    return (SIZE, word, *[word[:k] + "~" for k in BEGINNINGS if len(word) >= k])


def document_features(text: str | None) -> Counter:
    """Feature -> number of distinct words of the text that carry it."""
    return Counter(f for w in set(_WORD.findall((text or "").lower())) for f in features(w))


def train_classifier(pos: list[dict], unl: list[dict], prior: float) -> dict:
    """Weights of features, intercept: accelerated proximal steps on the non-negative risk."""
    names = sorted(set().union(*pos, *unl))
    place = {f: j for j, f in enumerate(names)}

    def matrix(sets):
        x = np.zeros((len(sets), len(names) + 1), np.float32)
        for i, s in enumerate(sets):
            x[i, [place[f] for f in s]] = np.log2(1 + np.array(list(s.values()), float))
        x[:, -1] = 1
        return x

    xp, xu = matrix(pos), matrix(unl)
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(prior / (1 - prior))

    def sig(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    # the risk's curvature is at most a quarter of the largest eigenvalue of the mean outer products
    l1 = NOISE * prior * math.sqrt(math.log(len(names) + 1) / len(pos))
    tp, tu, f32 = np.ascontiguousarray(xp.T), np.ascontiguousarray(xu.T), np.float32  # products stay in single precision
    v = np.ones(len(w), f32)
    for _ in range(30):
        v = f32(prior / len(xp)) * (tp @ (xp @ v)) + (tu @ (xu @ v)) / f32(len(xu))
        top = np.linalg.norm(v)
        v /= top
    rate, ahead, t = 4 / (1.05 * top), w.copy(), 1.0
    best, least = w, np.inf
    for _ in range(ROUNDS):
        zp, zu = (xp @ ahead.astype(f32)).astype(float), (xu @ ahead.astype(f32)).astype(float)
        part = prior * np.logaddexp(0, -zp).mean()
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        risk = part + max(0.0, rest) + l1 * np.abs(ahead[:-1]).sum()
        if risk < least and rest >= -SLACK:
            best, least = ahead, risk
        # d/dz log(1 + exp(z)) = sig(z); d/dz log(1 + exp(-z)) = -sig(-z)
        g_un, g_back = sig(zu) / len(zu), -prior * sig(zp) / len(zp)
        if rest >= -SLACK:
            g, step = tp @ (g_back - prior * sig(-zp) / len(zp)).astype(f32) + tu @ g_un.astype(f32), rate
        else:  # the corrected part of the risk went negative: walk its gradient back, without momentum
            g, step, t, w = -(tp @ g_back.astype(f32) + tu @ g_un.astype(f32)), rate / 4, 1.0, ahead
        new = ahead - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    w = best
    return {"weights": {f: float(x) for f, x in zip(names, w) if x}, "intercept": float(w[-1])}


def score_texts(model: dict, texts: list, cache: dict | None = None) -> np.ndarray:
    """Score of each text; ``cache`` maps words to the weighted features they carry."""
    if model is None:
        return np.zeros(len(texts))
    weights, cache = model["weights"], {} if cache is None else cache
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        got: dict = {}
        for w in set(_WORD.findall((t or "").lower())):
            fs = cache.get(w)
            if fs is None:
                if len(cache) >= CACHE:
                    cache.clear()
                fs = cache[w] = tuple(f for f in features(w) if f in weights)
            for f in fs:
                got[f] = got.get(f, 0) + 1
        out[i] = model["intercept"] + sum(weights[f] * math.log2(1 + got[f]) for f in sorted(got))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_pos: int = 2500, max_unl: int = 5000) -> dict | None:
    """Train on rows whose crc32(id as text) mod 5 is not 0."""
    known = labels.where(crc_fold(id_col, 5) != 0).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    c = known.agg(F.count(F.when(F.col("y") > 0, 1)).alias("pos"), F.count("y").alias("all")).first()
    if not c["pos"]:
        return None
    prior = min(c["pos"] / c["all"], 0.99)
    ids = known.where("y > 0").select("id", F.xxhash64("id", F.lit("toxic")).alias("draw")).orderBy("draw", "id").limit(max_pos).select("id")
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # one text an id (the least), so a repeated id is one row: at most max_pos rows
    pos = (src.join(F.broadcast(ids.distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
           .select("id", F.lit(1).alias("pos"), "text"))
    n = max(1, docs.count())
    unl = (src.where(crc_fold("id", 5) != 0).withColumn("draw", hash_fraction("id", F.lit("unlabelled")))
           .where(F.col("draw") < max_unl / n / 0.8).orderBy("draw", "id").limit(max_unl)
           .select("id", F.lit(0).alias("pos"), "text"))
    sample = staged(pos.unionByName(unl), "toxicity-sample")  # bounded: max_pos + max_unl rows
    sizes = {r["pos"]: r["count"] for r in sample.groupBy("pos").count().collect()}
    if len(sizes) < 2:
        return None

    def tally(batches):
        for b in batches:
            n_by: dict = {}
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in document_features(t):
                    c = n_by.setdefault(f, [0, 0])
                    c[p] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n_by), pa.string()),
                                              pa.array([c[0] for c in n_by.values()], pa.int64()),
                                              pa.array([c[1] for c in n_by.values()], pa.int64())], names=["f", "u", "p"])

    # standard errors by which positives hold a feature more often than unlabelled text
    r1, r0 = F.col("p") / sizes[1], F.col("u") / sizes[0]
    r = (F.col("p") + F.col("u")) / (sizes[0] + sizes[1])
    lead = (r1 - r0) / F.sqrt(r * (1 - r) * (1 / sizes[1] + 1 / sizes[0]) + 1e-12)
    names = {SIZE} | {x["f"] for x in (sample.select("pos", "text").mapInArrow(tally, "f string, u long, p long")
                              .groupBy("f").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
                              .where((F.col("p") >= LEAST) & (lead > 0))
                              .orderBy(lead.desc(), "f").limit(FEATURES).select("f").collect())}

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), b.column(1),
                 pa.array([sorted((f, n) for f, n in document_features(t).items() if f in names)
                           for t in b.column(2).to_pylist()], pa.map_(pa.string(), pa.int32()))], names=["id", "pos", "f"])
    rows = sample.mapInArrow(held, "id string, pos int, f map<string,int>").collect()
    rows.sort(key=lambda x: (x["id"] or "", x["pos"], sorted(x["f"].items())))
    return train_classifier([x["f"] for x in rows if x["pos"]], [x["f"] for x in rows if not x["pos"]], prior)


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
            cut: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    src = docs.select(F.col(id_col).alias("doc_id"), (crc_fold(id_col, 5) == 0).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    schema = src.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        cache: dict = {}
        for b in (part for batch in batches for part in byte_slices(batch, 2)):
            s = score_texts(model, b.column(2).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()),
                                              pa.array((s >= cut).astype(np.int32))], names=schema.names)
    return src.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: dict | None, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that score under ``cut``."""
    at = docs.columns.index(text_col)

    def run(batches):
        cache: dict = {}
        for b in (part for batch in batches for part in byte_slices(batch, at)):
            yield b.filter(pa.array(score_texts(model, b.column(at).to_pylist(), cache) < cut))
    return docs.mapInArrow(run, docs.schema)
