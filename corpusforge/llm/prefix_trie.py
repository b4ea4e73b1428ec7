"""Conversation prefix trie by whole-sequence collapse.

Every conversation is rebuilt: the first h turns of its head (the conversation
whose id is the next lower multiple of ``every``), then its own turns after its
first h, with h the CRC-32 of its id modulo ``heads``. The distinct sequences of
first d rebuilt turns (role, text) are the nodes of a trie.

1. Texts are read once into narrow turns (two 60-bit numbers of a SHA-256 of role
   and text, and the number of words); no text goes through an exchange.
2. Turns are sorted globally by ranges, so a conversation of any length is spread
   over partitions. Its part in one partition is a run; places and running sums
   are made within runs and carried over the (few) runs of a conversation.
3. A prefix's key is the running sum of hashed (place, turn): conversations with
   the same turns have the same keys, without a string of any length being built.
4. Whole sequences are collapsed: conversations with the same last key become one
   weighted sequence with the list of its ends. Sequences whose key is an inner
   key are dropped by anti-join; what is left are the leaves.
5. Prefixes of the distinct sequences, weighted, are added up per node. Each node
   belongs to the least of the leaves below it; running sums from a leaf's end
   over the nodes that belong to it, added up per node, are the subtree totals, so
   no level-by-level loop over the depth is needed.

The list of ends is digested in one stream per sequence, as SHA-256 asks; its ids
come in sorted pieces of at most END_PIECE, so memory is bounded for any number of
copies.

Defined results: null role and text are empty; turns are ordered by turn (null
first), ties by role, then by the digest of role and text (repeated rows are turns
each); a null conv_id is a conversation of its own turns alone, it names a node
only if no other member does, and its decimal form is the empty text; a head that is absent
lends no turns; a conversation may be left without turns and is then a member of
the root alone; a negative id's head is its multiple towards zero; an empty table
gives an empty result (no root); texts of any length count with their digest; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import staged

EVERY, HEADS = 20, 4
#: Ids in one piece of a list of ends.
END_PIECE = 256


def _number(hex_: F.Column, at: int) -> F.Column:
    return F.conv(F.substring(hex_, at, 15), 16, 10).cast("long")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, of which the first may be null."""
    other = right.withColumnsRenamed({k: f"j_{k}" for k in keys})
    on = F.col(keys[0]).eqNullSafe(F.col(f"j_{keys[0]}"))
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"j_{k}"))
    return left.join(other, on, how).drop(*[f"j_{k}" for k in keys])


def narrow_turns(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv, turn, role, a, b, words) of every row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return (conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
                                 digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
            .select("conv", "turn", "role", _number(F.col("digest"), 1).alias("a"), _number(F.col("digest"), 16).alias("b"), "words"))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs of turns, conversations): staged (conv, run, i, a, b, words), and (conv, run, before, n) of the runs.

    ``i`` is the place within the run, ``before`` the conversation's turns in
    earlier runs, ``n`` those in this one.
    """
    mid = F.monotonically_increasing_id()
    rows = staged(staged(turns, "trie-narrow").orderBy(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "a", "b")
                  .select("conv", mid.alias("mid"), "a", "b", "words"), "trie-turns")
    rows = rows.select("conv", F.shiftright("mid", 33).alias("run"), "mid", "a", "b", "words")
    runs = rows.groupBy("conv", "run").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition at most
    runs = staged(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "trie-runs")
    return rows, runs


def rebuilt(turns: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): staged (conv, run, pos, a, b, words) of the rebuilt turns and (conv) of all conversations.

    Run -1 holds the turns from the head.
    """
    rows, runs = placed(turns)
    h = F.when(F.col("conv").isNull(), 0).otherwise(F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)))
    convs = runs.groupBy("conv").agg(F.sum("n").alias("n_own")).withColumn("h", h.cast("long"))
    head = F.col("conv") - F.col("conv") % every
    first = (rows.join(runs.where((F.col("before") < heads) & (F.col("conv") % every == 0)), ["conv", "run"])
             .withColumn("pos", F.col("before") + F.col("mid") - F.col("first")).where(F.col("pos") < heads - 1)
             .select(F.col("conv").alias("head"), "pos", "a", "b", "words"))
    lent = (convs.select("conv", "h", head.alias("head")).join(first, "head").where("pos < h")
            .select("conv", F.lit(-1).cast("long").alias("run"), "pos", "a", "b", "words"))
    lends = runs.select(F.col("conv").alias("head"), "n").groupBy("head").agg(F.sum("n").alias("n_head"))
    shift = (convs.withColumn("head", head).join(lends, "head", "left")
             .select("conv", "h", (F.least("h", F.coalesce("n_head", F.lit(0))) - F.col("h")).alias("shift")))
    own_runs = _meet(runs.drop("n"), shift, ["conv"])
    own = (_meet(rows, own_runs, ["conv", "run"]).withColumn("at", F.col("before") + F.col("mid") - F.col("first")).where("at >= h")
           .select("conv", "run", (F.col("at") + F.col("shift")).alias("pos"), "a", "b", "words"))
    return staged(own.unionByName(lent), "trie-rebuilt"), convs.select("conv")


def _runs_before(rows: DataFrame, sums: list[str], backwards: bool = False) -> DataFrame:
    """Per (conv, run): the totals ``t_<sum>`` of the runs before it (after it)."""
    totals = rows.groupBy("conv", "run").agg(*[F.sum(c).alias(c) for c in sums])
    order = F.col("run").desc() if backwards else F.col("run")
    before = Window.partitionBy("conv").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return totals.select("conv", "run", *[F.coalesce(F.sum(c).over(before), zero).alias(f"t_{c}") for c in sums])


def _running(rows: DataFrame, sums: list[str], backwards: bool = False) -> DataFrame:
    """``rows`` with the running totals of ``sums`` over each conversation, in place order (from the end)."""
    order = F.col("pos").desc() if backwards else F.col("pos")
    inside = Window.partitionBy("conv", "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"r_{c}": F.sum(c).over(inside) for c in sums})
    return (_meet(out, _runs_before(rows, sums, backwards), ["conv", "run"])
            .withColumns({f"r_{c}": F.col(f"r_{c}") + F.col(f"t_{c}") for c in sums}).drop(*[f"t_{c}" for c in sums]))


def _bits(hash_: F.Column) -> F.Column:
    """A 64-bit hash as a decimal, so sums of any number of them stay exact."""
    return hash_.cast("decimal(20,0)")


def _key(x: F.Column, y: F.Column) -> tuple[F.Column, F.Column]:
    """Two longs that stand for the two sums of a prefix."""
    x, y = x.cast("decimal(38,0)"), y.cast("decimal(38,0)")
    return F.xxhash64(x, y), F.xxhash64(y, x, F.lit(1))


def prefixes(rows: DataFrame) -> DataFrame:
    """Staged (conv, run, pos, depth, words, x, y, px, py): each rebuilt turn with its prefix's key and the one before."""
    f = rows.withColumns({"x": _bits(F.xxhash64("pos", "a", "b")), "y": _bits(F.xxhash64("b", "a", "pos"))})
    x, y = F.col("r_x"), F.col("r_y")
    (kx, ky), (px, py) = _key(x, y), _key(x - F.col("x"), y - F.col("y"))
    return staged(_running(f, ["x", "y"]).select("conv", "run", "pos", (F.col("pos") + 1).alias("depth"), "words", kx.alias("kx"),
                                                 ky.alias("ky"), px.alias("px"), py.alias("py")), "trie-prefixes")


def _ends_digests(convs: DataFrame) -> DataFrame:
    """(depth, kx, ky, ends_sha256): the digest of each whole sequence's conversations in ascending order."""
    by_id = convs.orderBy(F.col("conv").asc_nulls_first()).withColumn("mid", F.monotonically_increasing_id())
    piece = F.floor(F.col("mid") / END_PIECE)  # of one partition: ids ascend with it, END_PIECE of them at most
    pieces = (by_id.groupBy("depth", "kx", "ky", piece.alias("piece"))
              .agg(F.array_sort(F.collect_list(F.struct("mid", F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("id")))).alias("ids"))
              .select("depth", "kx", "ky", "piece", F.array_join(F.col("ids.id"), ",").alias("ids")))
    ordered = pieces.repartition("depth", "kx", "ky").sortWithinPartitions("depth", "kx", "ky", "piece")
    schema = ordered.select("depth", "kx", "ky", F.lit("").alias("ends_sha256")).schema

    def run(batches):
        key, digest = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*[b.column(c).to_pylist() for c in (0, 1, 2, 4)]):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            yield _batch(out, b.schema)
        if key is not None:
            yield _batch([(*key, digest.hexdigest())], b.schema)

    def _batch(rows, like):
        cols = list(zip(*rows)) if rows else [()] * 4
        types = [like.field(0).type, like.field(1).type, like.field(2).type, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)
    return ordered.mapInArrow(run, schema)


def trie(conversations: DataFrame, every: int = EVERY, heads: int = HEADS, **cols) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(narrow_turns(conversations, **cols), every, heads)
    rows = prefixes(rows)
    node = ["depth", "kx", "ky"]
    root_key = dict(zip(node, (F.lit(0).cast("long"), *_key(F.lit(0), F.lit(0)))))
    least = F.min(F.struct(F.col("conv").isNull().alias("nil"), "conv"))
    # whole sequences: the key of each conversation's last turn, the root's key without turns
    last = rows.groupBy("conv").agg(F.max_by(F.struct(*node), "depth").alias("k"))
    whole = staged(_meet(convs, last, ["conv"], "left")
                   .select("conv", *[F.coalesce(F.col(f"k.{c}"), root_key[c]).alias(c) for c in node]), "trie-whole")
    sequences = whole.groupBy(*node).agg(F.count(F.lit(1)).alias("weight"), least.alias("rep"))
    inner = (rows.select((F.col("depth") - 1).alias("depth"), F.col("px").alias("kx"), F.col("py").alias("ky")).distinct())
    leaves = sequences.join(inner, node, "left_anti").select(*node, F.lit(1).alias("leaf"))
    sequences = staged(sequences.join(leaves, node, "left")
                       .select(*node, "weight", "rep", F.coalesce("leaf", F.lit(0)).alias("leaf")), "trie-sequences")
    # weighted prefixes of one conversation a sequence, run by run
    reps = sequences.select(F.col("rep.conv").alias("conv"), "weight", "leaf")
    own = _meet(rows.select("conv", "run").distinct(), reps, ["conv"])
    paths = staged(_meet(rows, own, ["conv", "run"]), "trie-paths")
    path_conv = F.struct(F.col("conv").isNull().alias("nil"), "conv")
    nodes = paths.groupBy(*node).agg(
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.min(path_conv).alias("m"),
        F.min(F.when(F.col("leaf") == 1, path_conv)).alias("owner"), F.first("words").alias("words"),
        F.first("px").alias("px"), F.first("py").alias("py"))
    nodes = staged(nodes, "trie-nodes")
    # subtree totals: every node's value at its owner's place, summed from the owner's end, added up per node
    value = nodes.select(F.col("owner.conv").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("value"))
    valued = (_meet(paths.where("leaf = 1"), value, ["conv", "depth"], "left")
              .select("conv", "run", "pos", *node, F.coalesce("value", F.lit(0)).alias("value")))
    saved = _running(valued, ["value"], backwards=True).groupBy(*node).agg(F.sum("r_value").alias("saved_tokens"))
    parents = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("kx"), F.col("py").alias("ky")).agg(
        F.count(F.lit(1)).alias("n_children"))
    ends = _ends_digests(whole)
    # the root: all conversations, and the values of all nodes
    none = F.lit(None).cast("long")
    value = F.lit(0).cast("long").alias("value")
    root = (sequences.select("weight", "leaf", "rep", value)
            .unionByName(nodes.select(F.lit(0).cast("long").alias("weight"), F.lit(0).alias("leaf"),
                                      F.lit(None).cast(sequences.schema["rep"].dataType).alias("rep"),
                                      ((F.col("n_convs") - 1) * F.col("words")).alias("value")))
            .agg(F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.min("rep").alias("m"),
                 F.sum("value").alias("saved_tokens")).where("n_convs > 0")
            .select(*[root_key[c].alias(c) for c in node], "n_convs", "n_leaves", "m", none.alias("px"), none.alias("py"), "saved_tokens"))
    full = (nodes.join(saved, node).select(*root.columns).unionByName(root)
            .join(parents, node, "left").join(ends, node, "left"))
    names = nodes.select(F.col("depth").alias("p_depth"), F.col("kx").alias("p_x"), F.col("ky").alias("p_y"), F.col("m.conv").alias("p_conv"))
    inner_ = full.where("depth > 1").join(names, (F.col("p_depth") == F.col("depth") - 1) & (F.col("p_x") == F.col("px"))
                                          & (F.col("p_y") == F.col("py")))
    top = full.where("depth <= 1")
    least_conv = whole.agg(least.alias("m")).first()["m"]
    root_conv = F.lit(least_conv["conv"] if least_conv else None).cast("long")
    out = lambda parent: [F.col("m.conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"),
                          F.col("n_convs").cast("long").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                          F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
                          F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")]
    return inner_.select(out(F.col("p_conv"))).unionByName(top.select(out(F.when(F.col("depth") == 1, root_conv))))
