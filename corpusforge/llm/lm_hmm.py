"""Hidden Markov language model with Baum-Welch counts aggregated by Spark.

Tokens are lower-cased (A-Z) words and one end per text. A state emits a word
group, the group emits the word: P(w | s) = P(g(w) | s) * (c(w) + 1) / (n_g +
v_g + 1), with c over all training documents and one unknown word a group. The
most frequent words are groups of their own, all others fall into groups by
their last three characters. There are at least TOP and TAIL of them, and
GROWTH * sqrt(training vocabulary) of each beyond that, so the model follows the
vocabulary but stays small beside it, while counts cover every word.

1. One pass reads texts into staged rows of block-local word numbers and one
   dictionary per block (a task starts a new block at BLOCK_WORDS words).
2. Dictionaries are summed into global counts, joined with them, and meet their
   block's documents once: each document becomes its group sequence.
3. Incremental Baum-Welch: from seeded random parameters, every sweep is a pass
   over all training documents in SHARDS hashed parts; a part's expected counts
   replace those of its last visit and the parameters are estimated anew, so one
   sweep makes SHARDS updates. Sweeps end when the likelihood grows by GAIN of
   itself or less (logged). Tasks emit expected counts per parameter; a shuffle
   adds them up.
4. The scaled forward recursion gives the exact likelihood, in double precision
   (training runs in single). Sequences of up to WHOLE tokens run side by side;
   longer ones in parallel pieces: transfer matrices of CHUNK tokens, chained per
   document.

Defined results: null and empty texts hold the end token alone; a null id is in
the fold of the empty text; repeated rows are scored and counted each; without
training documents counts are 0 and the groups are uniform; an empty table
gives an empty result.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import crc_fold, staged

log = logging.getLogger(__name__)

STATES, TOP, TAIL, GROWTH = 6, 2048, 2048, 16
GAIN, CHUNK, LANES = 5e-3, 64, 4096
#: Longer sequences are cut into pieces of CHUNK.
WHOLE = 1024
#: Parts of the training documents after each of which the parameters are estimated anew.
SHARDS = 8
BLOCK_WORDS = 400_000
#: Groups of a small vocabulary; the last group is the end token.
GROUPS = TOP + TAIL + 1
#: Weight of the overall group distribution in each state's emissions.
PRIOR = 200.0


# ------------------------------------------------------------- documents as word numbers
def _packed(ids: np.ndarray) -> bytes:
    """Word numbers as a plane of low 16 bits and one of the next 8 (of 16 if a number needs them)."""
    wide = len(ids) and int(ids.max()) >> 24
    high = (ids >> 16).astype("<u2" if wide else np.uint8)
    return (b"w" if wide else b"n") + (ids & 0xFFFF).astype("<u2").tobytes() + high.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = raw[:1] == b"w"
    n = (len(raw) - 1) // (4 if wide else 3)
    low = np.frombuffer(raw, "<u2", n, 1).astype(np.int64)
    return low | np.frombuffer(raw, "<u2" if wide else np.uint8, n, 1 + 2 * n).astype(np.int64) << 16


def encode(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged rows: kind 1 documents (ids: block-local word numbers), kind 0 words of a block."""
    src = docs.select(F.col(id_col).alias("id"), (crc_fold(id_col, 7) != 2).alias("train"),
                      F.col(text_col).cast("string").alias("text"))
    none = lambda t: F.lit(None).cast(t)
    schema = src.select(none("long").alias("block"), none("int").alias("kind"), "id", "train", none("int").alias("local"),
                        none("string").alias("word"), none("long").alias("cnt"), none("binary").alias("ids")).schema
    id_type = pa.null()

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        words: dict = {}
        counts = np.zeros(1024, np.int64)

        def book():
            n = len(words)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part << 24 | nth)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, id_type), pa.nulls(n, pa.bool_()),
                 pa.array(np.arange(n, dtype=np.int32)), pa.array([w.decode("utf-8", "replace") for w in words], pa.string()),
                 pa.array(counts[:n]), pa.nulls(n, pa.binary())], names=schema.names)
        for b in batches:
            id_type = b.column(0).type
            for lo in range(0, b.num_rows, 512):
                piece = b.slice(lo, 512)
                out = []
                for text, train in zip(piece.column(2).to_pylist(), piece.column(1).to_pylist()):
                    toks = (text or "").encode("utf-8", "replace").lower().split()
                    ids = np.array([words.setdefault(w, len(words)) for w in toks], np.uint32)
                    if len(words) > len(counts):
                        counts = np.concatenate([counts, np.zeros(max(len(counts), len(words) - len(counts)), np.int64)])
                    if train and len(ids):
                        np.add.at(counts, ids, 1)
                    out.append(_packed(ids))
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part << 24 | nth)), pa.array(np.ones(n, np.int32)), piece.column(0), piece.column(1),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(out, pa.binary())],
                    names=schema.names)
                if len(words) >= BLOCK_WORDS:
                    yield book()
                    words, counts, nth = {}, np.zeros(1024, np.int64), nth + 1
        if words:
            yield book()
    return staged(src.mapInArrow(run, schema), "lm-encoded")


# ------------------------------------------------------------- HMM on group sequences
class Chunks:
    """Sequences cut into pieces of ``chunk`` symbols, longest first, with their chains."""

    def __init__(self, seqs: list[np.ndarray], chunk: int):
        lens = np.array([len(s) for s in seqs])
        n = -(-lens // chunk)
        self.flat = np.concatenate(seqs).astype(np.int64)
        base = np.cumsum(lens) - lens
        doc = np.repeat(np.arange(len(seqs)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(lens[doc] - nth * chunk, chunk)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.size, self.first = (base[doc] + nth * chunk)[order], size[order], (nth == 0)[order]
        # chains: for each k, the documents with a k-th chunk and its place
        self.docs = len(seqs)
        by = np.argsort(nth, kind="stable")
        cuts = np.searchsorted(nth[by], np.arange(n.max() + 1))
        self.chain = [(doc[by[a:b]], place[by[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


def transfers(c: Chunks, pi, trans, emit):
    """(matrices, log scales): row state before a chunk -> column state after it, with its emissions."""
    s = len(pi)
    m, scale = np.empty((len(c.at), s, s)), np.zeros(len(c.at))
    for lo in range(0, len(c.at), LANES):
        at, size = c.at[lo:lo + LANES], c.size[lo:lo + LANES]
        # a text's first symbol follows the start distribution whatever the row
        x = np.where(c.first[lo:lo + LANES, None, None], pi[None, None, :], trans[None]) * emit[c.flat[at]][:, None, :]
        lg = np.zeros(len(at))
        for t in range(1, int(size[0])):
            k = int(np.searchsorted(-size, -t, "left"))  # pieces longer than t come first
            x[:k] = (x[:k].reshape(-1, s) @ trans).reshape(k, s, s) * emit[c.flat[at[:k] + t]][:, None, :]
            if t % 8 == 0:
                z = x[:k].sum((1, 2))
                x[:k] /= z[:, None, None]
                lg[:k] += np.log(z)
        z = x.sum((1, 2))
        m[lo:lo + LANES], scale[lo:lo + LANES] = x / z[:, None, None], lg + np.log(z)
    return m, scale


def _by_length(seqs: list[np.ndarray]):
    """(places, chunk size) of the sequences that are run whole, and of those that are cut."""
    long_ = np.array([len(s) > WHOLE for s in seqs], bool)
    return [(at, size) for at, size in ((np.flatnonzero(~long_), WHOLE), (np.flatnonzero(long_), CHUNK)) if len(at)]


def _forward(c: Chunks, lo: int, start, model, keep: list | None = None) -> np.ndarray:
    """Log likelihood of each piece of a block of lanes, given the states before it; ``keep`` gets the scaled forward states."""
    pi, trans, emit = model
    at, size, first = c.at[lo:lo + LANES], c.size[lo:lo + LANES], c.first[lo:lo + LANES]
    x = np.where(first[:, None], pi[None], pi[None] if start is None else start @ trans).astype(trans.dtype)
    ll, part = np.zeros(len(at)), np.ones(len(at))
    for t in range(int(size[0])):
        k = int(np.searchsorted(-size, -t, "left"))  # pieces longer than t come first
        if t:
            x = x[:k] @ trans
        x *= emit[c.flat[at[:k] + t]]
        z = x.sum(1)
        x /= z[:, None]
        part[:k] *= z
        if t % 16 == 15:
            ll += np.log(part)
            part[:] = 1
        if keep is not None:
            keep.append(x)
    return ll + np.log(part)


def _ends(c: Chunks, model):
    """States before and weights after each piece of cut sequences, and the log likelihoods."""
    pi, trans, emit = model
    m, scale = transfers(c, pi, trans, emit)
    s = len(pi)
    alpha, ll = np.full((c.docs, s), 1 / s), np.zeros(c.docs)
    into = np.empty((len(c.at), s))
    for docs, where in c.chain:
        into[where] = alpha[docs]
        v = np.einsum("ds,dst->dt", alpha[docs], m[where])
        z = v.sum(1)
        alpha[docs] = v / z[:, None]
        ll[docs] += np.log(z) + scale[where]
    out, beta = np.empty_like(into), np.ones((c.docs, s))
    for docs, where in reversed(c.chain):
        out[where] = beta[docs]
        v = np.einsum("dst,dt->ds", m[where], beta[docs])
        beta[docs] = v / v.sum(1, keepdims=True)
    return into, out, ll


def log_likelihoods(seqs: list[np.ndarray], model) -> np.ndarray:
    """Natural log likelihood of each sequence."""
    out = np.zeros(len(seqs))
    for at, size in _by_length(seqs):
        c = Chunks([seqs[i] for i in at], size)
        if size == CHUNK:
            out[at] = _ends(c, model)[2]
            continue
        ll = np.concatenate([_forward(c, lo, None, model) for lo in range(0, len(c.at), LANES)])
        docs, where = c.chain[0]
        out[at[docs]] = ll[where]
    return out


def expected_counts(seqs: list[np.ndarray], model, kind=np.float64):
    """(start, transition, emission by group) expected counts and the log likelihood."""
    exact, (pi, trans, emit) = model, tuple(np.asarray(a, kind) for a in model)
    model = pi, trans, emit
    s = len(pi)
    n_pi, n_trans, n_emit, total = np.zeros(s), np.zeros((s, s)), np.zeros((emit.shape[0], s)), 0.0
    for docs, size_ in _by_length(seqs):
        c = Chunks([seqs[i] for i in docs], size_)
        into, out = (None, None) if size_ == WHOLE else [x.astype(kind) for x in _ends(c, exact)[:2]]
        for lo in range(0, len(c.at), LANES):
            at, size, first = c.at[lo:lo + LANES], c.size[lo:lo + LANES], c.first[lo:lo + LANES]
            start = None if into is None else into[lo:lo + LANES]
            b = np.ones((len(at), s), kind) if out is None else out[lo:lo + LANES].copy()
            a: list = []
            total += _forward(c, lo, start, model, a).sum()
            sym, gam, left_sum = [], [], np.zeros((s, s))
            for t in range(int(size[0]) - 1, -1, -1):
                k = len(a[t])
                o = c.flat[at[:k] + t]
                g = a[t] * b[:k]
                g /= g.sum(1, keepdims=True)
                sym.append(o)
                gam.append(g)
                eb = emit[o] * b[:k]
                back = eb @ trans.T
                if t:
                    left = a[t - 1][:k]
                else:
                    n_pi += g[first].sum(0)
                    if start is None:
                        break
                    left, eb, back = start[~first], eb[~first], back[~first]
                left_sum += (left / (left * back).sum(1, keepdims=True)).T @ eb
                if t:
                    b[:k] = back / back.sum(1, keepdims=True)
            n_trans += trans * left_sum
            sym, gam = np.concatenate(sym), np.concatenate(gam)
            for j in range(s):
                n_emit[:, j] += np.bincount(sym, gam[:, j], emit.shape[0])
    return n_pi, n_trans, n_emit, total


def reestimate(n_pi, n_trans, n_emit, overall):
    """Parameters from expected counts; every state keeps some of the overall group distribution."""
    pi = (n_pi + 1) / (n_pi + 1).sum()
    trans = (n_trans + 1) / (n_trans + 1).sum(1, keepdims=True)
    emit = (n_emit + PRIOR * overall[:, None]) / (n_emit.sum(0) + PRIOR)
    return pi, trans, emit


def start_model(seqs: list[np.ndarray], overall: np.ndarray, states: int = STATES, rounds: int = 0, seed: int = 5):
    """Seeded random parameters, after ``rounds`` of Baum-Welch on ``seqs``."""
    rng = np.random.default_rng(seed)
    trans = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(trans, 0.9)
    emit = overall[:, None] * rng.uniform(0.5, 1.5, (len(overall), states))
    model = np.full(states, 1 / states), trans, emit / emit.sum(0)
    for _ in range(rounds if seqs else 0):
        model = reestimate(*expected_counts(seqs, model)[:3], overall)
    return model


def _groups(values, code: str) -> list[np.ndarray]:
    return [np.frombuffer(v, code) for v in values]


def _slices(seqs: list[np.ndarray], most: int = 1_000_000):
    """Runs of sequences of about ``most`` symbols together."""
    lo, n = 0, 0
    for i, s in enumerate(seqs):
        n += len(s)
        if n >= most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(seqs):
        yield lo, len(seqs)


# ------------------------------------------------------------- the Spark job
def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(staged documents as group sequences, corpus statistics)."""
    rows = encode(docs, id_col, text_col)
    book = rows.where("kind = 0").select("block", "local", "word", "cnt")
    counts = staged(book.groupBy("word").agg(F.sum("cnt").alias("c")), "lm-counts")
    r = rows.where("kind = 1").agg(F.count(F.when(F.col("train"), 1))).first()
    n_train = r[0]
    k = counts.where("c > 0").agg(F.sum("c"), F.count(F.lit(1))).first()
    stats = {"N": (k[0] or 0) + n_train, "V": k[1] + (1 if n_train else 0), "train_docs": n_train}
    grown = int(GROWTH * stats["V"] ** 0.5)
    n_top, n_tail = max(TOP, grown), max(TAIL, grown)
    end, n_groups = n_top + n_tail, n_top + n_tail + 1
    code = stats["code"] = "<u2" if n_groups <= 1 << 16 else "<u4"
    top = (counts.where("c > 0").orderBy(F.col("c").desc(), "word").limit(n_top)  # as the root of the vocabulary
           .select("word", F.row_number().over(_by_count()).alias("rank")))
    g = F.coalesce(F.col("rank") - 1, n_top + F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(n_tail))).cast("int")
    known = staged(counts.join(F.broadcast(top), "word", "left").select("word", "c", g.alias("g")), "lm-vocabulary")
    n_g, v_g = np.zeros(n_groups), np.zeros(n_groups)
    for x in known.groupBy("g").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).collect():
        n_g[x["g"]], v_g[x["g"]] = x["n"], x["v"]
    n_g[end], v_g[end] = n_train, 1 if n_train else 0
    stats["room"] = n_g + v_g + 1  # a group's tokens, its words and one unknown word
    resolved = book.join(known, "word").select("block", F.lit(0).alias("kind"), "local", "c", "g")
    both = (rows.where("kind = 1").select("block", "kind", "id", "train", "ids")
            .unionByName(resolved, allowMissingColumns=True).select("block", "kind", "local", "c", "g", "id", "train", "ids"))
    schema = rows.select("id", "train", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
                         F.lit(0.0).alias("log_c"), F.lit(b"").alias("groups")).schema

    def run(batches):
        block, c, g = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        pend_c, pend_g = [], []
        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], len(blocks))):
                if blocks[lo] != block:
                    block, pend_c, pend_g = blocks[lo], [], []
                    c = g = np.zeros(0, np.int64)
                part = b.slice(lo, hi - lo)
                if kinds[lo] == 0:  # the block's dictionary comes first, by local number
                    pend_c.append(part.column(3).to_numpy(zero_copy_only=False))
                    pend_g.append(part.column(4).to_numpy(zero_copy_only=False))
                    continue
                if pend_c:
                    c, g = np.concatenate([c, *pend_c]), np.concatenate([g, *pend_g])
                    pend_c, pend_g = [], []
                out_n, out_k, out_l, out_g = [], [], [], []
                for raw in part.column(7).to_pylist():
                    ids = _unpacked(raw)
                    cnt = c[ids]
                    out_n.append(len(ids) + 1)
                    out_k.append(int((cnt > 0).sum()) + (n_train > 0))
                    out_l.append(float(np.log10(cnt + 1.0).sum() + np.log10(n_train + 1.0)))
                    out_g.append(np.append(g[ids], end).astype(code).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(5), part.column(6), pa.array(out_n, pa.int64()), pa.array(out_k, pa.int64()),
                     pa.array(out_l, pa.float64()), pa.array(out_g, pa.binary())], names=schema.names)
    grouped = both.repartition("block").sortWithinPartitions("block", "kind", "local")
    shard = F.pmod(F.xxhash64("id", "groups"), F.lit(SHARDS)).cast("int")
    return staged(grouped.mapInArrow(run, schema).withColumn("shard", shard), "lm-sequences", by="shard"), stats


def _by_count():
    from pyspark.sql import Window
    return Window.orderBy(F.col("c").desc(), "word")


def train(seqs: DataFrame, stats: dict, states: int = STATES, gain: float = GAIN):
    """Incremental Baum-Welch: sweeps over all training documents, shard by shard.

    After each shard its expected counts replace those of its last visit, and the
    parameters are estimated anew from the counts of all shards.
    """
    overall, code = stats["room"] / stats["room"].sum(), stats["code"]
    groups = len(overall)
    model, last, sweep = start_model([], overall, states), None, 0
    sizes = np.cumsum([states, states * states, groups * states, 1])
    held = np.zeros((SHARDS, sizes[-1]))
    while stats["train_docs"]:
        for shard in range(SHARDS):
            def count(batches, model=model):
                total = np.zeros(sizes[-1])
                for b in batches:
                    s = _groups(b.column(0).to_pylist(), code)
                    for lo, hi in _slices(s):
                        total += np.concatenate([np.ravel(x) for x in expected_counts(s[lo:hi], model, np.float32)])
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["k", "v"])
            got = (seqs.where((F.col("shard") == shard) & F.col("train")).select("groups").mapInArrow(count, "k long, v double")
                   .groupBy("k").agg(F.sum("v").alias("v")).toArrow())  # one row a parameter
            held[shard] = 0
            held[shard][got.column("k").to_numpy()] = got.column("v").to_numpy()
            a, b, c, _ = np.split(held.sum(0), sizes[:-1])
            model = reestimate(a, b.reshape(states, states), c.reshape(groups, states), overall)
        ll, sweep = float(held[:, -1].sum()), sweep + 1
        log.info("sweep %d: log likelihood %.8g", sweep, ll)
        if last is not None and not ll - last > gain * abs(last):
            break
        last = ll
    return model


def score(seqs: DataFrame, stats: dict, model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    log_room, base = np.log10(stats["room"]), float(np.log10(stats["N"] + stats["V"] + 1))
    src = seqs.select(F.col("id").alias("doc_id"), "n_tokens", "n_known", (~F.col("train")).alias("held_out"), "log_c", "groups")
    schema = src.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"),
                        F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema
    total, code = stats["N"], stats["code"]

    def run(batches):
        for b in batches:
            s = _groups(b.column(5).to_pylist(), code)
            ll = np.zeros(len(s))
            for lo, hi in _slices(s):
                ll[lo:hi] = log_likelihoods(s[lo:hi], model)
            n, log_c = b.column(1).to_numpy(), b.column(4).to_numpy()
            out = ll / np.log(10) + log_c - np.array([log_room[x].sum() for x in s])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), b.column(1), b.column(2), pa.array(np.full(len(s), total, np.int64)),
                 pa.array(log_c - n * base), pa.array(out)], names=schema.names)
    return src.mapInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents outside the held-out fold and score every document."""
    seqs, stats = prepare(docs, id_col, text_col)
    return score(seqs, stats, train(seqs, stats))
