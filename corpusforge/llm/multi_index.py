"""Embedding near-dedup with an inverted multi-index.

Unit vectors are halved; two codebooks, trained independently on the halves of a
bounded sample, form a product grid whose cells hold every vector. A vector
visits cells in the order of the multi-sequence: the sums of its halves' squared
distances to the centroids, less those of its own cell. The traversal stops at a
reach that is measured: QUERIES vectors are compared with all others, in blocks,
and the reach is the least with which ``recall`` of their links is met (of all
links, and on average of a query), widened as few linked queries say less. What meets in a cell is verified by the cosine
in double precision.

Scale: equal vectors of a label are folded first, so copies are never paired. A
pair is verified once, in the cell of one of the two that the other visits (the
lesser cell if both do). A full cell is cut into blocks and every pair of blocks
is a group of its own, so a task holds at most 2 * BLOCK vectors; it returns a
count and a spanning link a vector, never the pairs. The codebooks grow with the
root of a label's vectors, so that cells stay small.

Bounded, documented samples: SAMPLE vectors for the codebooks, QUERIES for the
reach; every vector is indexed and visits.

Defined results: a null label, and a null, empty or zero vector or one with null
or non-finite components link with nothing; vectors of different lengths never
link; repeated rows are rows of one vector and link with each other; a component is
named by its least id (nulls last); an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import hash_fraction, staged
from corpusforge.llm.simhash import components

log = logging.getLogger(__name__)

COSINE, RECALL = 0.93, 1.0
SAMPLE, QUERIES = 16_384, 2048
#: Vectors of a label that a cell is to hold on average, and the most centroids of a codebook.
FILL, MOST = 32, 512
#: Distinct vectors of one block of a full cell; a group holds two at most.
BLOCK = 1024
#: Places in which the members of a component meet its name.
SALTS = 16
#: The measured reach is widened by 1 + WIDER / sqrt(linked queries); a share LEAST of the vectors visits two cells at least.
WIDER, LEAST = 4.0, 0.25
#: Steps in which the reach is measured (a histogram's bins).
STEP = 1 / 4096


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; very large and small ones too."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(col: pa.Array, dims: int, code: str) -> np.ndarray:
    """Unit vectors of a binary column of ``dims`` numbers each."""
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return _unit(np.frombuffer(raw.tobytes(), code).reshape(-1, dims))


def vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(vec_id, label, dims, vec): each row's numbers as bytes, null where the row links with nothing; and their type."""
    code = "<f4" if df.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    kind = "array<float>" if code == "<f4" else "array<double>"
    src = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kind).alias("v"))
    schema = src.select("vec_id", "label", F.lit(None).cast("int").alias("dims"), F.lit(None).cast("binary").alias("vec")).schema

    def run(batches):
        for b in batches:
            for part in (b.slice(lo, 1000) for lo in range(0, b.num_rows, 1000)):
                v, labels = part.column(2), part.column(1).is_valid().to_numpy(zero_copy_only=False)
                dims = np.diff(v.offsets.to_numpy())
                flat = v.values.slice(v.offsets[0].as_py(), int(dims.sum())).to_numpy(zero_copy_only=False).astype(code)  # nulls: NaN
                row = np.repeat(np.arange(len(v)), dims)
                ok = labels & v.is_valid().to_numpy(zero_copy_only=False) & (dims > 0)
                ok[row[~np.isfinite(flat)]] = False
                some = np.zeros(len(v), bool)
                some[row[flat != 0]] = True
                ok &= some
                raw, at = flat.tobytes(), np.concatenate([[0], np.cumsum(dims)]) * int(code[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.where(ok, dims, 0).astype(np.int32), mask=~ok),
                     pa.array([raw[at[i]:at[i + 1]] if ok[i] else None for i in range(len(v))], pa.binary())], names=schema.names)
    return src.mapInArrow(run, schema), code


# ------------------------------------------------------------- the index
def train_codebook(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds from seeded rows."""
    c = x[np.random.default_rng(seed).choice(len(x), k, False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def gaps(books, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each half: (nearest centroid, squared distances to all centroids less the least)."""
    out, cut = [], x.shape[1] // 2
    for c, half in zip(books, (x[:, :cut], x[:, cut:])):
        d = (c * c).sum(1)[None] - 2 * half @ c.T
        near = d.argmin(1)
        out.append((near, d - d[np.arange(len(d)), near][:, None]))
    return out


def traverse(books, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own cell of each row; rows and cells of the visits to other cells).

    Both sequences of gaps are sorted; for each place of the first, the second is
    followed while the sum of the two stays within the reach: together, the start
    of the multi-sequence.
    """
    (near_a, a), (near_b, b) = gaps(books, x)
    k = len(books[1])
    order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
    a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    rows, cells, live = [], [], np.arange(len(x))
    for i in range(a.shape[1]):
        live = live[a[live, i] <= reach]
        if not len(live):
            break
        for j in range(k):
            on = live[a[live, i] + b[live, j] <= reach] if j == 0 else on[a[on, i] + b[on, j] <= reach]
            if not len(on):
                break
            rows.append(on)
            cells.append(order_a[on, i] * k + order_b[on, j])
    own = near_a * k + near_b
    rows, cells = np.concatenate(rows), np.concatenate(cells)
    other = cells != own[rows]
    return own, rows[other], cells[other]


def _second(books, x: np.ndarray) -> np.ndarray:
    """Reach at which each row first visits a cell beside its own."""
    return np.min([np.partition(d, 1, axis=1)[:, 1] for _, d in gaps(books, x)], axis=0)


class Index:
    """Codebooks of the two halves for vectors of ``dims`` numbers, and the measured reach."""

    def __init__(self, books, dims: int, code: str, reach: float = 0.0):
        self.books, self.dims, self.code, self.reach = books, dims, code, reach


def fit(kinds: DataFrame, dims: int, code: str, cosine: float, recall: float, sample: int, queries: int) -> Index:
    """Codebooks from at most ``sample`` vectors, and the reach from at most ``queries``."""
    mine = kinds.where(F.col("dims") == dims)
    stats = mine.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    k = min(MOST, max(1, int(np.ceil(np.sqrt((stats[0] or 1) / FILL)))))
    drawn = (mine.select("uid", "label", "vec", hash_fraction("uid", F.lit("index")).alias("u")).orderBy("u", "uid")
             .limit(max(sample, queries)).collect())
    x = _unit(np.frombuffer(b"".join(r["vec"] for r in drawn), code).reshape(-1, dims))
    k = min(k, len(x))
    cut = dims // 2
    index = Index([train_codebook(x[:sample, :cut], k), train_codebook(x[:sample, cut:], k, seed=4)], dims, code)
    labels = {}
    for i, r in enumerate(drawn[:queries]):
        labels.setdefault(r["label"], []).append(i)
    uids = np.array([r["uid"] for r in drawn[:queries]], np.int64)

    def met(batches):
        """(query, bin, links): by the reach with which one of the two visits the other's cell."""
        g = gaps(index.books, x[:queries])
        for b in batches:
            for part in (b.slice(lo, 2000) for lo in range(0, b.num_rows, 2000)):
                label, uid, n = part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy()
                v = _matrix(part.column(3), dims, code)
                by: dict = {}
                for i, name in enumerate(label):
                    by.setdefault(name, []).append(i)
                for name, at in by.items():
                    if name not in labels:
                        continue
                    q, at = np.array(labels[name]), np.array(at)
                    i, j = np.nonzero((x[q] @ v[at].T >= cosine) & (uids[q][:, None] != uid[at][None]))
                    if not len(i):
                        continue
                    i, j = q[i], at[j]
                    gv = gaps(index.books, v[j])
                    there = sum(h[1][i, hv[0]] for h, hv in zip(g, gv))
                    back = sum(hv[1][np.arange(len(j)), h[0][i]] for h, hv in zip(g, gv))
                    bins = np.ceil(np.minimum(there, back) / STEP).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(bins), pa.array(n[j])], names=["q", "bin", "n"])
    got = (mine.select("label", "uid", "n", "vec").mapInArrow(met, "q long, bin long, n long")
           .groupBy("q", "bin").agg(F.sum("n").alias("n")).collect())  # at most queries x bins rows
    if got:
        q, bins, n = (np.array([r[c] for r in got], float) for c in ("q", "bin", "n"))
        per = np.bincount(q.astype(int), n)[q.astype(int)]
        order = bins.argsort(kind="stable")
        need = [bins[order][np.searchsorted(np.cumsum(w[order]), recall * w.sum() * (1 - 1e-12))] for w in (n, n / per)]
        # few linked queries say little about the farthest link
        index.reach = float(max(need)) * STEP * (1 + WIDER / np.sqrt(len(set(q))))
    index.reach = max(index.reach, float(np.quantile(_second(index.books, x), LEAST)) if k > 1 else 0.0)
    log.info("index of %d x %d cells, reach %.5f from %d queries' links", k, k, index.reach, len({r["q"] for r in got}))
    return index


def posts(kinds: DataFrame, index: Index) -> DataFrame:
    """(label, cell, home, uid, n, visits, vec): every vector in its own cell and in those that it visits."""
    src = kinds.where(F.col("dims") == index.dims).select("label", "uid", "n", "vec")
    schema = src.select("label", F.lit(0).cast("int").alias("cell"), F.lit(0).cast("int").alias("home"), "uid", "n",
                        F.array().cast("array<int>").alias("visits"), "vec").schema

    def run(batches):
        for b in batches:
            for part in (b.slice(lo, 2000) for lo in range(0, b.num_rows, 2000)):
                own, row, cell = traverse(index.books, _matrix(part.column(3), index.dims, index.code), index.reach)
                order = np.lexsort((cell, row))
                row, cell = row[order], cell[order]
                ends = np.searchsorted(row, np.arange(len(own) + 1))
                visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))
                take = pa.array(np.concatenate([np.arange(len(own)), row]))
                out = part.take(take)
                yield pa.RecordBatch.from_arrays(
                    [out.column(0), pa.array(np.concatenate([own, cell]), pa.int32()), pa.array(own[take.to_numpy()], pa.int32()),
                     out.column(1), out.column(2), visits.take(take), out.column(3)], names=schema.names)
    return src.mapInArrow(run, schema)


# ------------------------------------------------------------- verification
def verify(unit: np.ndarray, n: np.ndarray, home: np.ndarray, cell: int, visits: list, block: np.ndarray, cosine: float):
    """(links of each row, least row of its component) of a group: rows that live in ``cell`` and rows that visit it.

    Of rows of two blocks only pairs across are compared. A pair of a dweller and
    a visitor counts here unless the dweller visits the other's cell, too, and
    that one is less.
    """
    lives = np.flatnonzero(home == cell)
    links, root = np.zeros(len(n), np.int64), np.arange(len(n))
    if not len(lives):
        return links, root
    across = block.min() != block.max()
    homes, code = np.unique(home, return_inverse=True)
    back = np.zeros((len(lives), len(homes)), bool)  # dweller visits the home of ...
    for i, r in enumerate(lives):
        at = np.searchsorted(homes, visits[r])
        at = at[(at < len(homes))]
        back[i, at[np.isin(homes[at], visits[r])]] = True
    back[:, homes >= cell] = False
    linked = np.zeros((len(lives), len(n)), bool)
    for lo in range(0, len(lives), 256):
        rows = lives[lo:lo + 256]
        hit = unit[rows] @ unit.T >= cosine
        hit &= ~back[lo:lo + 256][:, code]
        if across:
            hit &= block[rows][:, None] != block[None]
        hit[np.arange(len(rows)), rows] = False
        linked[lo:lo + 256] = hit
    links[lives] = linked @ n
    visitor = home != cell
    links[visitor] = n[lives] @ linked[:, visitor]
    # components of the group: every linked dweller's row is read once
    place = np.full(len(n), -1)
    place[lives] = np.arange(len(lives))
    open_ = linked.any(1)
    seen = np.zeros(len(n), bool)
    while open_.any():
        front = np.array([open_.argmax()])
        group = np.zeros(len(n), bool)
        group[lives[front]] = True
        while len(front):
            open_[front] = False
            group |= linked[front].any(0)
            back_to = linked[:, group & visitor].any(1) if (group & visitor).any() else np.zeros(len(lives), bool)
            front = np.flatnonzero(open_ & (group[lives] | back_to))
            group[lives[front]] = True
        members = np.flatnonzero(group)
        root[members] = np.minimum(root[members], members[0])
        seen |= group
    return links, root


def _verified(index: Index, cosine: float, names: list[str]):
    def group(rows):
        t = pa.Table.from_batches(rows)
        col = {c: t.column(i) for i, c in enumerate(names)}
        uid = col["uid"].to_numpy()
        links, root = verify(_matrix(col["vec"].combine_chunks(), index.dims, index.code), col["n"].to_numpy(), col["home"].to_numpy(),
                             col["cell"][0].as_py(), col["visits"].to_pylist(), col["own"].to_numpy(), cosine)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
        return pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some]), pa.array(uid[root[some]])],
                                          names=["uid", "links", "root"])

    def run(batches):
        held, key = [], None
        for b in batches:
            keys = list(zip(*[b.column(names.index(c)).to_pylist() for c in ("label", "cell", "bi", "bj")]))
            lo = 0
            for hi in range(1, len(keys) + 1):
                if hi < len(keys) and keys[hi] == keys[lo]:
                    continue
                if held and keys[lo] != key:
                    yield group(held)
                    held = []
                key = keys[lo]
                held.append(b.slice(lo, hi - lo))
                lo = hi
        if held:
            yield group(held)
    return run


def verified(post: DataFrame, index: Index, cosine: float) -> DataFrame:
    """(uid, links, root): of each vector in each group, its links there and a spanning link."""
    full = (post.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 2 * BLOCK)
            .select("label", "cell", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1)).cast("long")
    cut = (post.join(full, ["label", "cell"], "left").withColumn("own", F.pmod(F.xxhash64("uid"), blocks))
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
           .withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
           .select("label", "cell", "bi", "bj", "own", "home", "uid", "n", "visits", "vec"))
    keys = ["label", "cell", "bi", "bj"]
    grouped = cut.repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(_verified(index, cosine, grouped.columns), "uid long, links long, root long")


def near_duplicates(df: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, queries: int = QUERIES,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    rows, code = vectors(df, id_col, vec_col, label_col)
    one, two = F.xxhash64("label", "dims", "vec"), F.xxhash64("vec", "dims", "label")
    least = F.min(F.struct(F.col("vec_id").isNull().alias("nil"), "vec_id")).alias("least")
    kinds = staged(rows.where("dims is not null").groupBy("label", "dims", "vec").agg(F.count(F.lit(1)).alias("n"), least)
                   .withColumn("uid", F.monotonically_increasing_id()), "index-vectors")
    met = None
    for r in kinds.select("dims").distinct().orderBy("dims").toLocalIterator():  # one index a length of vectors
        index = fit(kinds, r["dims"], code, cosine, recall, sample, queries)
        found = verified(posts(kinds, index), index, cosine)
        met = found if met is None else met.unionByName(found)
    none = kinds.select("uid", F.lit(0).cast("long").alias("links"), F.col("uid").alias("root")).limit(0)
    met = staged(met if met is not None else none, "index-links")
    roots = components(met.select(F.col("uid").alias("a"), F.col("root").alias("b")), "index-components")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    links = met.groupBy("uid").agg(F.sum("links").alias("links"))
    named = (kinds.drop("vec").join(links, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
             .select("uid", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "root",
                     F.pmod(F.xxhash64("uid"), F.lit(SALTS)).alias("salt")))
    # a component may be large: its members meet its name in SALTS places
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    linked = named.where("root is not null")
    name = (linked.groupBy("root", "salt").agg(F.min("least").alias("name")).groupBy("root").agg(F.min("name").alias("name"))
            .select("root", "name", salts))
    named = (linked.join(name, ["root", "salt"]).select("uid", "n_links", F.col("name.vec_id").alias("component_id"))
             .unionByName(named.where("root is null").select("uid", "n_links", F.col("least.vec_id").alias("component_id"))))
    marks = kinds.select("uid", one.alias("h1"), two.alias("h2"))
    of = marks.join(named, "uid").drop("uid")
    mine = rows.select("vec_id", F.when(F.col("dims").isNotNull(), one).alias("h1"), F.when(F.col("dims").isNotNull(), two).alias("h2"))
    return (mine.join(of, ["h1", "h2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
