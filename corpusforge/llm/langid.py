"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Each direction is a minimal gated unit: gate f = sigmoid(x_f + h U_f),
candidate c = tanh(x_c + (f h) U_c), state h += f (c - h). Both states
label every byte position with language probabilities; a document's
probabilities are the mean over all its positions, its score the largest.
Training is backpropagation through time over byte windows with Adam.

A text of any length is read whole: it is cut into cores of CORE bytes, each
run with CONTEXT more bytes on either side, many cores at once, so memory is
bounded by LANES whatever the text's length.

The fit uses a bounded sample: at most about ``per_lang`` training documents a
language (drawn by a hash of the id) with WINDOWS windows each at hashed places.

Defined results: null text or a text without a letter is ``und`` with score 0;
without any training document every text is ``und`` with score 0; a null lang
is never learned; ties between languages go to the first by name; repeated rows get
equal results; an empty table gives an empty result; extra columns pass through
`keep_known` and are ignored by `predict`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import byte_slices, crc_fold, hash_fraction, text_buffer

HIDDEN, CORE, CONTEXT, LANES = 8, 240, 8, 4096
SPAN, WINDOWS, STEPS, BATCH, RATE = 96, 3, 260, 192, 0.02
#: Bytes of text that are labelled together (memory bound; a longer text is one run).
SLICE = 1 << 20
#: `keeps` rejects below this pooled probability of the best language.
MIN_SCORE = 0.35
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _sweep(x: np.ndarray, p: dict, reverse: bool):
    """Yield (step, state) of one direction over x (steps, lanes)."""
    n, lanes = x.shape
    hid = p["uf"].shape[0]
    h = np.zeros((lanes, hid), np.float32)
    f, c = np.empty_like(h), np.empty_like(h)
    for t in range(n - 1, -1, -1) if reverse else range(n):
        z = p["table"].take(x[t], axis=0)
        np.matmul(h, p["uf"], out=f)
        f += z[:, :hid]
        f *= 0.5
        np.tanh(f, out=f)  # sigmoid(z) = (1 + tanh(z / 2)) / 2
        f += 1
        f *= 0.5
        np.matmul(f * h, p["uc"], out=c)
        c += z[:, hid:]
        np.tanh(c, out=c)
        c -= h
        c *= f
        h += c
        yield t, h


def _train_sweep(x, p, reverse):
    hid = p["uf"].shape[0]
    h = np.zeros((x.shape[1], hid), np.float32)
    tape, states = [], np.empty((*x.shape, hid), np.float32)
    for t in range(len(x) - 1, -1, -1) if reverse else range(len(x)):
        z = p["table"][x[t]]
        f = 0.5 + 0.5 * np.tanh(0.5 * (z[:, :hid] + h @ p["uf"]))
        g = f * h
        c = np.tanh(z[:, hid:] + g @ p["uc"])
        tape.append((t, h, f, g, c))
        h = h + f * (c - h)
        states[t] = h
    return states, tape


def _through_time(x, p, tape, dstates):
    hid = p["uf"].shape[0]
    g_in = np.empty((*x.shape, 2 * hid), np.float32)
    duf, duc = np.zeros_like(p["uf"]), np.zeros_like(p["uc"])
    dh = np.zeros((x.shape[1], hid), np.float32)
    for t, h, f, g, c in reversed(tape):
        dh = dh + dstates[t]
        dzc = dh * f * (1 - c * c)
        df = dh * (c - h)
        dg = dzc @ p["uc"].T
        df += dg * h
        dzf = df * f * (1 - f)
        duf += h.T @ dzf
        duc += g.T @ dzc
        dh = dh * (1 - f) + dg * f + dzf @ p["uf"].T
        g_in[t, :, :hid], g_in[t, :, hid:] = dzf, dzc
    flat, rows = g_in.reshape(-1, 2 * hid), x.reshape(-1)
    table = np.stack([np.bincount(rows, flat[:, j], 256) for j in range(2 * hid)], 1).astype(np.float32)
    return {"table": table, "uf": duf, "uc": duc}


def train_network(windows: np.ndarray, labels: np.ndarray, n_langs: int, steps: int = STEPS, seed: int = 7) -> dict:
    """Fit on (n, SPAN) byte windows with one label each, every position labelled."""
    rng = np.random.default_rng(seed)
    r = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
    net = {}
    for d in ("fw", "bw"):
        tab = r(256, 2 * HIDDEN)
        net[d] = {"table": tab, "uf": r(HIDDEN, HIDDEN, k=0.1), "uc": r(HIDDEN, HIDDEN)}
    net["out"] = {"w": r(2 * HIDDEN, n_langs), "b": np.zeros(n_langs, np.float32)}
    mean = {k: {n: np.zeros_like(a) for n, a in v.items()} for k, v in net.items()}
    sq = {k: {n: np.zeros_like(a) for n, a in v.items()} for k, v in net.items()}
    groups = [np.flatnonzero(labels == k) for k in range(n_langs)]
    for s in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // n_langs)) for g in groups])
        x, y = np.ascontiguousarray(windows[pick].T).astype(np.intp), labels[pick]
        sf, tf = _train_sweep(x, net["fw"], False)
        sb, tb = _train_sweep(x, net["bw"], True)
        both = np.concatenate([sf, sb], 2)
        z = both @ net["out"]["w"] + net["out"]["b"]
        e = np.exp(z - z.max(2, keepdims=True))
        q = e / e.sum(2, keepdims=True)
        q[:, np.arange(len(y)), y] -= 1
        q /= x.size
        back = q @ net["out"]["w"].T
        grads = {"fw": _through_time(x, net["fw"], tf, back[..., :HIDDEN]),
                 "bw": _through_time(x, net["bw"], tb, back[..., HIDDEN:]),
                 "out": {"w": np.einsum("tbh,tbl->hl", both, q), "b": q.sum((0, 1))}}
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for v in grads.values() for g in v.values())))
        if not np.isfinite(norm):
            continue
        shrink = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        for k, v in grads.items():
            for n, g in v.items():
                g, m, u = g * shrink, mean[k][n], sq[k][n]
                m += 0.1 * (g - m)
                u += 0.01 * (g * g - u)
                net[k][n] -= (RATE * min(1, 2 - 2 * s / steps) * (m / (1 - 0.9 ** s))
                              / (np.sqrt(u / (1 - 0.99 ** s)) + 1e-6)).astype(np.float32)
    return net


def pooled(net: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, languages) mean position probabilities; zeros for empty texts."""
    n_docs, n_langs = len(offs) - 1, len(net["out"]["b"])
    sums = np.zeros((n_docs, n_langs))
    lens = np.diff(offs)
    cores = -(-lens // CORE)
    doc = np.repeat(np.arange(n_docs), cores)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(cores) - cores, cores)
    wf, wb = net["out"]["w"][:HIDDEN], net["out"]["w"][HIDDEN:]
    steps = CORE + 2 * CONTEXT
    for lo in range(0, len(doc), LANES):
        d, k = doc[lo:lo + LANES], nth[lo:lo + LANES]
        at = (offs[d] + k * CORE - CONTEXT)[None, :] + np.arange(steps)[:, None]
        inside = (at >= offs[d]) & (at < offs[d + 1])
        x = np.where(inside, buf[np.where(inside, at, 0)], 0).astype(np.intp)
        z = np.empty((steps, len(d), n_langs), np.float32)
        for t, h in _sweep(x, net["fw"], False):
            np.matmul(h, wf, out=z[t])
        total = np.zeros((len(d), n_langs), np.float32)
        for t, h in _sweep(x, net["bw"], True):
            if CONTEXT <= t < steps - CONTEXT:
                e = z[t] + h @ wb + net["out"]["b"]
                e -= e.max(1, keepdims=True)
                np.exp(e, out=e)
                e *= (inside[t] / e.sum(1))[:, None]
                total += e
        np.add.at(sums, d, total)
    return sums / np.maximum(lens, 1)[:, None]


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; one byte of memory a byte of text."""
    out = np.zeros(len(offs) - 1, bool)
    some = np.flatnonzero(offs[1:] > offs[:-1])
    if len(some):
        out[some] = np.logical_or.reduceat(_ASCII_LETTER[buf], offs[some])
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = any(ch.isalpha() for ch in bytes(buf[offs[i]:offs[i + 1]]).decode("utf-8", "replace"))
    return out


def label(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text of an Arrow column."""
    buf, offs = text_buffer(texts)
    langs = np.array([*model["langs"], "und"], object)
    if model["net"] is None:
        return np.full(len(offs) - 1, "und", object), np.zeros(len(offs) - 1)
    p = pooled(model["net"], buf, offs)
    best = p.argmax(1)
    sure = has_letter(buf, offs)
    return langs[np.where(sure, best, len(langs) - 1)], np.where(sure, np.clip(p.max(1), 0, 1), 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = 400) -> dict:
    """Train on documents whose crc32(id as text) mod 4 is not 2, with text and lang."""
    train = (docs.where(crc_fold(id_col, 4) != 2)
             .where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
             .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "net": None}
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, per_lang / counts[k]))]),
                         F.col("lang"))
    draws = (train.withColumn("draw", hash_fraction("id", F.lit("langid")))
             .where(F.col("draw") < share).orderBy("draw").limit(2 * per_lang * len(langs))
             .select("id", "lang", *[F.expr("substring(text, 1 + cast(pmod(xxhash64(id, {}), greatest(length(text) - {}, 1)) as int), {})"
                                            .format(j, SPAN - 1, SPAN)).alias(f"w{j}") for j in range(WINDOWS)]))
    rows = draws.collect()
    win, lab = [], []
    for r in sorted(rows, key=lambda r: (str(r["id"]), r["lang"], r["w0"])):
        for j in range(WINDOWS):
            b = np.frombuffer(r[f"w{j}"].encode()[:SPAN], np.uint8)
            win.append(np.pad(b, (0, SPAN - len(b))))
            lab.append(langs.index(r["lang"]))
    have = sorted(set(lab))  # a language may draw nothing when its share is tiny
    langs = [langs[k] for k in have]
    lab = np.searchsorted(have, np.array(lab))
    return {"langs": langs, "net": train_network(np.array(win), lab, len(langs))}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    src = docs.select(F.col(id_col).alias("doc_id"), (crc_fold(id_col, 4) == 2).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    schema = src.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for b in (part for batch in batches for part in byte_slices(batch, 2, SLICE)):
            lang, score = label(model, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], names=schema.names)
    return src.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: dict, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language with enough score."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in (part for batch in batches for part in byte_slices(batch, at, SLICE)):
            lang, score = label(model, b.column(at))
            yield b.filter(pa.array((lang != "und") & (score >= min_score)))
    return docs.mapInArrow(run, docs.schema)
