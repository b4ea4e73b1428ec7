"""Quality classifier: a byte-level convolutional network in numpy.

FILTERS learned filters of WIDTH bytes (one-hot bytes, so a filter is a table
of byte weights per offset) slide over the whole text. Their responses are
max-pooled over overlapping chunks (CHUNK bytes, every CHUNK / 2); the largest
and the mean chunk value of each filter give one probability by a logistic
layer. Texts are read in pieces of SEGMENT bytes with WIDTH - 1 bytes of
look-ahead, so memory is bounded whatever the text's length.

The fit uses a bounded sample of labelled rows: at most ``per_class`` of each
label outside the held-out fold, drawn by a hash of the id, each row weighted
by its class's true share, with the texts' TRAIN_BYTES hashed-place windows.

Defined results: null and empty text score the bias of the logistic layer
(pooled values 0); without labels of both classes every score is the share of
label 1 (0.5 without any); null labels are not learned; repeated rows get equal
results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import byte_slices, crc_fold, text_buffer

WIDTH, FILTERS, CHUNK, SEGMENT, SLICE = 6, 16, 512, 32768, 1 << 19
TRAIN_BYTES, EPOCHS, BATCH, RATE = 8192, 8, 24, 0.01
HALF = CHUNK // 2


def _convolve(table: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Responses (len(buf) - WIDTH + 1, filters) of the filters at every byte."""
    n = len(buf) - WIDTH + 1
    out = table[0].take(buf[:n], axis=0)
    for k in range(1, WIDTH):
        out += table[k].take(buf[k:k + n], axis=0)
    return out


def _segments(offs: np.ndarray):
    """Groups of (document, from, to) pieces, each group of at most about SLICE bytes."""
    group, size = [], 0
    for d in range(len(offs) - 1):
        for lo in range(int(offs[d]), int(offs[d + 1]), SEGMENT):
            hi = min(lo + SEGMENT, int(offs[d + 1]))
            group.append((d, lo, hi))
            size += hi - lo
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def pooled(table: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, 2 * filters): largest and mean chunk maximum, rectified."""
    n_docs, filters = len(offs) - 1, table.shape[2]
    tail = np.zeros(WIDTH - 1, np.uint8)
    halves, owner = [], []
    for group in _segments(offs):
        parts, starts, at = [], [], 0
        for d, lo, hi in group:
            end = min(hi + WIDTH - 1, int(offs[d + 1]))  # look-ahead inside the text, zeros past its end
            parts += [buf[lo:end], tail[:hi + WIDTH - 1 - end]]
            cuts = np.arange(0, hi - lo, HALF)
            # the WIDTH - 1 positions that straddle two pieces form a block of their own, dropped below
            starts.append(np.append(cuts, hi - lo) + at)
            owner.append(np.append(np.full(len(cuts), d), -1))
            at += hi - lo + WIDTH - 1
        resp = _convolve(table, np.concatenate([*parts, tail]).astype(np.intp))
        halves.append(np.maximum.reduceat(resp, np.concatenate(starts), axis=0))
    out = np.zeros((n_docs, 2 * filters), np.float32)
    if not halves:
        return out
    half, own = np.concatenate(halves), np.concatenate(owner)
    half, own = np.maximum(half[own >= 0], 0), own[own >= 0]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    n = np.diff(np.append(first, len(own)))
    follows = np.append(own[1:] == own[:-1], False)
    chunk = half.copy()
    chunk[:-1][follows[:-1]] = np.maximum(half[:-1], half[1:])[follows[:-1]]
    last = first + n - 1
    # the last half has no chunk of its own unless it is the only one
    chunk[last[n > 1]] = 0
    out[own[first], :filters] = np.maximum.reduceat(chunk, first, axis=0)
    out[own[first], filters:] = np.add.reduceat(chunk, first, axis=0) / np.maximum(n - 1, 1)[:, None]
    return out


def train_network(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS,
                  seed: int = 11) -> dict:
    """Adam on the weighted log loss; gradients reach the filters at the pooled positions."""
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.1).astype(np.float32)
    top = (rng.standard_normal(2 * FILTERS) * 0.3).astype(np.float32)
    bias = np.float32(0)
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (table, top)] + [[0.0, 0.0]]
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            step += 1
            g_table, g_top, g_bias, norm = np.zeros_like(table), np.zeros_like(top), 0.0, 0.0
            for i in order[lo:lo + BATCH]:
                b = np.frombuffer(texts[i] + bytes(WIDTH - 1), np.uint8).astype(np.intp)
                n = len(b) - WIDTH + 1
                if n == 0:
                    continue
                resp = _convolve(table, b)
                starts = range(0, max(1, n - HALF) if n > HALF else 1, HALF)
                arg = np.stack([s + resp[s:s + CHUNK].argmax(0) for s in starts])
                val = np.maximum(np.take_along_axis(resp, arg, 0), 0)
                best = val.argmax(0)
                x = np.concatenate([val[best, np.arange(FILTERS)], val.mean(0)])
                p = 1 / (1 + np.exp(-np.clip(x @ top + bias, -30, 30)))
                g = weights[i] * (p - labels[i])
                norm += weights[i]
                g_top += g * x
                g_bias += g
                gv = np.broadcast_to(g * top[FILTERS:] / len(val), val.shape).copy()
                gv[best, np.arange(FILTERS)] += g * top[:FILTERS]
                gv *= val > 0
                cols = np.broadcast_to(np.arange(FILTERS), arg.shape)
                for k in range(WIDTH):
                    np.add.at(g_table[k], (b[arg + k], cols), gv)
            lr = RATE * (1 - 0.9 * step / total)
            for (m, u), a, g in zip(state, (table, top, None), (g_table, g_top, g_bias)):
                if a is None:
                    continue
                g = g / max(norm, 1e-9)
                m += 0.1 * (g - m)
                u += 0.01 * (g * g - u)
                a -= (lr * (m / (1 - 0.9 ** step)) / (np.sqrt(u / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
            bias = np.float32(bias - 10 * lr * g_bias / max(norm, 1e-9))
    return {"table": table, "top": top, "bias": float(bias), "prior": None}


def score_texts(model: dict, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text of an Arrow column."""
    buf, offs = text_buffer(texts)
    if model["prior"] is not None:
        return np.full(len(offs) - 1, model["prior"])
    z = pooled(model["table"], buf, offs).astype(np.float64) @ model["top"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = 1200) -> dict:
    """Train on labelled rows whose crc32(id as text) mod 5 is not 0."""
    known = (labels.where(F.col(label_col).isNotNull() & (crc_fold(id_col, 5) != 0))
             .select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"),
                     F.xxhash64(F.col(id_col), F.lit("quality")).alias("draw")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return {"prior": counts.get(1, 0) / total if total else 0.5}
    drawn = known.where("y = 0").orderBy("draw", "id").limit(per_class).unionByName(
        known.where("y = 1").orderBy("draw", "id").limit(per_class))  # bounded: 2 * per_class ids
    chars = F.length("text")
    window = F.substr(F.col("text"), (F.lit(1) + F.pmod(F.xxhash64("id"), F.greatest(chars - TRAIN_BYTES + 1, F.lit(1)))).cast("int"),
                      F.lit(TRAIN_BYTES))
    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(drawn), "id").select("id", "y", window.alias("t"))
            .groupBy("id", "y").agg(F.min("t").alias("t")).collect())  # a row a drawn id, however often it repeats
    rows.sort(key=lambda r: (str(r["id"]), r["y"], r["t"]))
    y = np.array([r["y"] for r in rows])
    seen = np.bincount(y, minlength=2) if len(y) else np.zeros(2, int)
    if seen.min() == 0:
        return {"prior": counts[1] / total}
    weights = np.array([counts[k] / total * len(y) / seen[k] for k in (0, 1)])[y]
    return train_network([r["t"].encode() for r in rows], y, weights)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
            cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    src = docs.select(F.col(id_col).alias("doc_id"), (crc_fold(id_col, 5) == 0).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    schema = src.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        for b in (part for batch in batches for part in byte_slices(batch, 2)):
            s = score_texts(model, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()),
                                              pa.array((s >= cut).astype(np.int32))], names=schema.names)
    return src.mapInArrow(run, schema)
