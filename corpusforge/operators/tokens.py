"""Vocabulary, encode/decode, pad/truncate, label masks, audits.

The tokenizer is pluggable: ``word_pieces`` (chat markers + [a-z0-9]+ words,
lower-cased) is the built-in one, and ``encode_with`` accepts any object with
``encode(str) -> list[int]`` (e.g. a ``tokenizers`` tokenizer) for T2.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.config import IGNORE_ID, IM_END, IM_END_ID, IM_START, IM_START_ID, PAD_ID, UNK_ID

N_SPECIAL = 4  # pad, unk, im_start, im_end
# Largest vocabulary we ship to executors as a dictionary, in entries and in bytes of its pieces; a larger one is joined.
# Every Python process of a task that encodes or decodes holds its own.
MAX_BROADCAST_VOCAB = 400_000
MAX_BROADCAST_BYTES = 8 << 20
# Most list values and rows whose distinct values are joined together (memory bound of a task).
BLOCK_VALUES, BLOCK_ROWS = 1 << 20, 1 << 14


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Bytes of lower-cased text that stay: word characters, and S and E, which lower-cased text lacks, for the two markers.
_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789SE" else 32 for c in range(256))


def _words(texts: pa.Array, markers: bool) -> pa.Array:
    """Arrow array of the texts' lower-case [a-z0-9]+ words (and chat markers); a null text gives null."""
    def plain(t: bytes) -> bytes:
        t = t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode()
        if markers and b"<|" in t:
            t = t.replace(IM_START.encode(), b" S ").replace(IM_END.encode(), b" E ")
        return t.translate(_KEPT).strip()
    said = pa.array([None if t is None else plain(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).view(pa.string())
    lists = pc.ascii_split_whitespace(said)
    lens, flat = list_lens(lists), lists.flatten()
    lens[pc.equal(said, "").fill_null(False).to_numpy(zero_copy_only=False)] = 0
    flat = flat.filter(pc.not_equal(flat, ""))
    if markers:
        for mark, marker in (("S", IM_START), ("E", IM_END)):
            flat = pc.if_else(pc.equal(flat, mark), marker, flat)
    return list_array(lens, flat, said.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _word_pieces_udf(texts: pa.Array) -> pa.Array:
    return _words(texts, True)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _rouge_words_udf(texts: pa.Array) -> pa.Array:
    return _words(texts, False)


def word_pieces(text) -> Column:
    """Chat markers and lower-case [a-z0-9]+ words, in order."""
    return _word_pieces_udf(_c(text))


def rouge_words(text) -> Column:
    """The words of ``rouge_tokens``, cut by a Python step."""
    return _rouge_words_udf(_c(text))


def text_pieces(text) -> Column:
    """Words with their accents, and marks one by one, in order: decoding keeps sentences apart."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), 1)


def build_vocabulary(df: DataFrame, pieces_col: str, k: int | None) -> DataFrame:
    """Top-k pieces by (count desc, piece asc) -> ids after the 4 special ids.

    The count is a map-side-combined aggregation; only the k winners (a bounded
    table) are numbered in one task. Without ``k`` the whole vocabulary is
    numbered: counts are few distinct values, so running totals per count (and
    per hash bucket of the piece within a count) number the pieces in many tasks.
    """
    toks = _batch_counts(df.select(pieces_col)).filter(~F.col("token").isin(IM_START, IM_END))
    counts = toks.groupBy("token").agg(F.sum("n").alias("n"))
    if k is None:
        return _number_all(counts)
    top = counts.orderBy(F.col("n").desc(), F.col("token")).limit(k)
    w = Window.orderBy(F.col("n").desc(), F.col("token"))
    return top.select("token", (F.row_number().over(w) + (N_SPECIAL - 1)).cast("long").alias("id"), "n")


def _batch_counts(pieces: DataFrame) -> DataFrame:
    """(token, n): the pieces of a table's only column, counted in each batch, so that no row is made for every piece."""
    def run(batches):
        for b in batches:
            found = b.column(0).flatten().drop_null().value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["token", "n"])
    return pieces.mapInArrow(run, "token string, n long")


def _number_all(counts: DataFrame) -> DataFrame:
    """Ids of the order (count desc, piece asc): pieces of one count are ranked by their first characters first."""
    from corpusforge.operators.annotate import materialize
    c = materialize(counts.withColumn("_p", F.substring("token", 1, 2)), "vocabulary")
    cells = c.groupBy("n", "_p").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy(F.col("n").desc(), F.col("_p")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("n", "_p", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("n", "_p").orderBy("token")
    return (c.join(cells, ["n", "_p"])
            .select("token", (F.col("_start") + F.row_number().over(inside) + (N_SPECIAL - 1)).cast("long").alias("id"), "n"))


class Vocabulary:
    """A vocabulary made once: a staged table and, if it is small enough, one broadcast dictionary."""

    def __init__(self, vocab: DataFrame):
        from corpusforge.operators.annotate import materialize
        self.table = materialize(vocab.select("token", "id", "n"), "vocabulary")
        size = self.table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("b")).first()
        self.shared = None
        if size["n"] <= MAX_BROADCAST_VOCAB and size["b"] <= MAX_BROADCAST_BYTES:
            d = {r["token"]: int(r["id"]) for r in self.table.select("token", "id").collect()}
            d[IM_START], d[IM_END] = IM_START_ID, IM_END_ID
            self.shared = vocab.sparkSession.sparkContext.broadcast(d)


def _made(vocab) -> Vocabulary:
    return vocab if isinstance(vocab, Vocabulary) else Vocabulary(vocab)


def list_lens(a: pa.Array) -> np.ndarray:
    """Lengths of an Arrow array's lists; a null list has none."""
    return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def one_array(a: pa.ChunkedArray) -> pa.Array:
    """The chunks of an Arrow column in one."""
    return pa.concat_arrays(a.chunks) if a.num_chunks != 1 else a.chunk(0)


def list_array(lens: np.ndarray, values: pa.Array, null=None) -> pa.Array:
    """Arrow list array from the lists' lengths and all values in a row; ``null`` marks the null lists."""
    offsets = np.append(0, np.cumsum(lens, dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=null)


def flat_codes(lists: list) -> tuple:
    """(lengths and nulls of each list array, codes of all their values in a row, distinct values); a null value is code -1."""
    shapes = [(list_lens(a), a.is_null()) for a in lists]
    found = pa.concat_arrays([a.flatten() for a in lists]).dictionary_encode()
    return shapes, found.indices.fill_null(-1).to_numpy(zero_copy_only=False), found.dictionary


def coded(df: DataFrame, cols: list[str], keep: bool = True, name: str = "coded", most: int | None = None) -> DataFrame:
    """Staged ``df`` with its list columns as numbers local to a block of rows.

    A block holds at most ``most`` (BLOCK_VALUES) list values and BLOCK_ROWS rows of one
    task, or one longer row. Added: ``_block``, for the i-th column ``_codes<i>`` (places in the
    block's distinct values, -1 for a null value; null for a null list), and on the
    block's first row ``_entries``, those values. Without ``keep``, ``cols`` are left out.
    """
    from pyspark import TaskContext

    from corpusforge.operators.annotate import materialize
    most = most or BLOCK_VALUES
    carried = [c for c in df.columns if keep or c not in cols]
    x = df.select(*carried, *[F.col(c).alias(f"_codes{i}") for i, c in enumerate(cols)])
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([x.schema[c] for c in carried] + [T.StructField("_block", T.LongType())]
                          + [T.StructField(f"_codes{i}", ints) for i in range(len(cols))]
                          + [T.StructField("_entries", x.schema["_codes0"].dataType)])

    def block(held: list, number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        column = lambda c: one_array(t.column(c))
        shapes, codes, values = flat_codes([column(f"_codes{i}") for i in range(len(cols))])
        parts = np.split(codes.astype(np.int32), np.cumsum([lens.sum() for lens, _ in shapes])[:-1])
        first = np.zeros(t.num_rows, np.int64)
        first[0] = len(values)
        return pa.RecordBatch.from_arrays(
            [column(c) for c in carried] + [pa.array(np.full(t.num_rows, number, np.int64))]
            + [list_array(lens, pa.array(p), null) for (lens, null), p in zip(shapes, parts)]
            + [list_array(first, values, pa.array(np.arange(t.num_rows) > 0))], names=schema.names)

    def cut(batches):
        number, held, size, rows = TaskContext.get().partitionId() << 33, [], 0, 0
        for b in batches:
            upto, lo = np.cumsum(sum(list_lens(b.column(f"_codes{i}")) for i in range(len(cols)))), 0
            while lo < b.num_rows:
                before = int(upto[lo - 1]) if lo else 0
                hi = min(int(np.searchsorted(upto, before + most - size, "right")), lo + BLOCK_ROWS - rows)
                hi = max(hi, lo if held else lo + 1)
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                    size, rows, lo = size + int(upto[hi - 1]) - before, rows + hi - lo, hi
                if lo < b.num_rows:
                    yield block(held, number)
                    number, held, size, rows = number + 1, [], 0, 0
        if held:
            yield block(held, number)
    return materialize(x.mapInArrow(cut, schema), name)


def entries(staged: DataFrame, key: str) -> DataFrame:
    """(_of, _pos, key): the distinct values of every block of ``coded``, with its number and their places."""
    return staged.where(F.col("_entries").isNotNull()).select(F.col("_block").alias("_of"), F.posexplode("_entries").alias("_pos", key))


def by_block(staged: DataFrame, found: DataFrame, n_cols: int, out: list, finish) -> DataFrame:
    """Each block of ``coded`` meets its looked-up entries (_of, _pos, ...).

    ``finish(rows, found)`` gets both as Arrow tables and gives the arrays of the
    ``out`` fields, a value a row; the block's numbers are dropped.
    """
    codes = [f"_codes{i}" for i in range(n_cols)]
    rows = staged.drop("_entries")
    carried = [c for c in rows.columns if c != "_block" and c not in codes]
    schema = T.StructType([rows.schema[c] for c in carried] + out)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        made = finish([one_array(left.column(c)) for c in codes], right)
        return pa.Table.from_arrays([*(left.column(c) for c in carried), *made], names=schema.names)
    return rows.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(meet, schema)


def encode(df: DataFrame, pieces_col, vocab, out_col="ids", keep: bool = True) -> DataFrame:
    """Pieces -> ids inside each task with a broadcast dictionary (no shuffle).

    ``pieces_col`` and ``out_col`` are names, or lists of as many names. ``vocab`` is a
    table or a ``Vocabulary`` made of one. For a vocabulary too large for a dictionary
    the distinct pieces of each block of rows are joined instead, with the same result:
    texts move once, as numbers. Without ``keep`` the pieces are left out.
    """
    v = _made(vocab)
    bc = v.shared
    cols, outs = ([pieces_col], [out_col]) if isinstance(pieces_col, str) else (list(pieces_col), list(out_col))
    if bc is None:
        st = coded(df, cols, keep, "encode-rows")
        specials = df.sparkSession.createDataFrame([(IM_START, IM_START_ID), (IM_END, IM_END_ID)], "token string, id int")
        known = v.table.select("token", F.col("id").cast("int")).unionByName(specials)
        found = entries(st, "token").join(known, "token").select("_of", "_pos", "id")

        def finish(codes, right):
            pos, new = (right.column(c).to_numpy() for c in ("_pos", "id"))
            flats = [a.flatten().to_numpy(zero_copy_only=False) for a in codes]
            ids = np.full(max([int(f.max(initial=-1)) for f in flats] + [int(pos.max(initial=-1))]) + 2, UNK_ID, np.int32)
            ids[pos] = new
            return [list_array(list_lens(a), pa.array(ids[f]), a.is_null()) for a, f in zip(codes, flats)]
        return by_block(st, found, len(cols), [T.StructField(o, T.ArrayType(T.IntegerType())) for o in outs], finish)

    def _enc(a: pa.Array) -> pa.Array:
        d = bc.value
        (shape,), codes, values = flat_codes([a])
        ids = np.array([*(d.get(x, UNK_ID) for x in values.to_pylist()), UNK_ID], np.int32)
        return list_array(shape[0], pa.array(ids[codes]), shape[1])

    enc = F.arrow_udf(_enc, T.ArrayType(T.IntegerType()))
    x = df.withColumns({o: enc(F.col(c)) for c, o in zip(cols, outs)})
    return x if keep else x.drop(*cols)


def encode_relational(df: DataFrame, key_cols: list[str], pieces_col: str, vocab: DataFrame,
                      out_col: str = "ids") -> DataFrame:
    """T2, relational form: posexplode, join the vocabulary, regroup by key in order; null pieces give null."""
    v = vocab.select("token", F.col("id").cast("int").alias("_id"))
    specials = df.sparkSession.createDataFrame([(IM_START, IM_START_ID), (IM_END, IM_END_ID)], "token string, _id int")
    v = v.unionByName(specials)
    x = df.select(*key_cols, F.posexplode(pieces_col).alias("_pos", "token"))
    x = x.join(v, "token", "left").withColumn("_id", F.coalesce("_id", F.lit(UNK_ID)))
    g = x.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("_pos", "_id"))).alias("_s"))
    return df.join(g.select(*key_cols, F.col("_s._id").alias(out_col)), key_cols, "left") \
        .withColumn(out_col, F.when(F.col(pieces_col).isNotNull(), F.coalesce(out_col, F.array().cast("array<int>"))))


def encode_with(df: DataFrame, text_col: str, tokenizer_factory, out_col: str = "ids") -> DataFrame:
    """T2 with a foreign tokenizer: ``tokenizer_factory()`` is built once per Python worker."""
    holder: dict = {}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _enc(s: pd.Series) -> pd.Series:
        tok = holder.get("t")
        if tok is None:
            tok = holder["t"] = tokenizer_factory()
        return pd.Series([None if x is None else list(tok.encode(x)) for x in s])

    return df.withColumn(out_col, _enc(F.col(text_col)))


def pad_truncate(ids, n: int, pad: int = PAD_ID, padding_side: str = "right") -> tuple[Column, Column]:
    """(input_ids, attention_mask) of length n; truncation is on the right."""
    c = _c(ids)
    kept = F.slice(c, 1, n)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(kept), F.lit(0)))
    ones = F.array_repeat(F.lit(1), F.size(kept))
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(n) - F.size(kept), F.lit(0)))
    if padding_side == "right":
        return F.concat(kept, fill), F.concat(ones, zeros)
    if padding_side == "left":
        return F.concat(fill, kept), F.concat(zeros, ones)
    raise ValueError(padding_side)


def mask_labels(input_ids, prefix_len, mode: str = "prompt", pad: int = PAD_ID) -> Column:
    """T4: labels from padded input ids.

    ``prompt``: the first prefix_len positions become -100 (intended masking).
    ``as_written``: the prefix is padded to max_length too, so every label is -100.
    ``full``: labels = input ids with pad positions -100 (what training really sees).
    """
    c = _c(input_ids)
    if mode == "prompt":
        # no lambda: the prefix length is evaluated once per row, not once per element
        p = F.least(F.greatest(_c(prefix_len), F.lit(0)), F.size(c))
        return F.concat(F.array_repeat(F.lit(IGNORE_ID), p),
                        F.slice(c, p + 1, F.greatest(F.size(c) - p, F.lit(0))))
    if mode == "as_written":
        return F.transform(c, lambda x: F.lit(IGNORE_ID))
    if mode == "full":
        return F.transform(c, lambda x: F.when(x == F.lit(pad), F.lit(IGNORE_ID)).otherwise(x))
    raise ValueError(mode)


def unmask_labels(ids, pad: int = PAD_ID) -> Column:
    """T5: -100 -> pad before decoding."""
    return F.transform(_c(ids), lambda x: F.when(x == F.lit(IGNORE_ID), F.lit(pad)).otherwise(x))


def decode_relational(df: DataFrame, key_cols: list[str], ids_col: str, vocab: DataFrame, out_col: str = "text") -> DataFrame:
    """T6, relational form: posexplode, join the vocabulary by id, regroup by key in order."""
    x = (df.select(*key_cols, F.posexplode(ids_col).alias("_pos", "_id")).where(F.col("_id") >= N_SPECIAL)
         .join(vocab.select("token", F.col("id").alias("_id")), "_id"))
    g = x.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("_pos", "token"))).alias("_s"))
    said = F.coalesce(F.array_join("_s.token", " "), F.lit(""))
    return (df.join(g, key_cols, "left").withColumn(out_col, F.when(F.col(ids_col).isNotNull(), said)).drop("_s"))


def decode(df: DataFrame, ids_col, vocab, out_col="text") -> DataFrame:
    """Ids -> space-joined pieces, special ids skipped (reverse table; a large vocabulary is joined to each block's distinct ids).

    ``ids_col`` and ``out_col`` are names, or lists of as many names.
    """
    v = _made(vocab)
    bc = v.shared
    cols, outs = ([ids_col], [out_col]) if isinstance(ids_col, str) else (list(ids_col), list(out_col))
    if bc is None:
        own = [f"_own{i}" for i in range(len(cols))]
        x = df.withColumns({o: F.filter(F.col(c), lambda i: i >= N_SPECIAL) for o, c in zip(own, cols)})
        st = coded(x, own, False, "decode-rows")
        found = entries(st, "id").join(v.table.select("token", F.col("id").cast("int").alias("id")), "id").select("_of", "_pos", "token")

        def finish(codes, right):
            pos, words = right.column("_pos").to_numpy(), one_array(right.column("token")) if right.num_rows else pa.array([], pa.string())
            flats = [a.flatten().to_numpy(zero_copy_only=False) for a in codes]
            at = np.full(max([int(f.max(initial=-1)) for f in flats] + [int(pos.max(initial=-1))]) + 2, -1, np.int64)
            at[pos] = np.arange(len(pos))
            out = []
            for a, f in zip(codes, flats):
                lens, place = list_lens(a), at[f]
                said = place >= 0
                lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[said], minlength=len(lens))
                text = pc.binary_join(list_array(lens, words.take(pa.array(place[said]))), " ")
                out.append(pc.if_else(a.is_null(), pa.scalar(None, text.type), text))
            return out
        return by_block(st, found, len(cols), [T.StructField(o, T.StringType()) for o in outs], finish)
    holder: dict = {}

    @F.pandas_udf(T.StringType())
    def _dec(s: pd.Series) -> pd.Series:
        tab = holder.get("t")
        if tab is None:
            d = bc.value
            tab = holder["t"] = np.empty(max(d.values()) + 1, dtype=object)
            for tok, i in d.items():
                tab[i] = tok
        out = []
        for ids in s:
            if ids is None:
                out.append(None)
                continue
            a = np.asarray(ids, dtype=np.int64)
            a = a[(a >= N_SPECIAL) & (a < len(tab))]
            out.append(" ".join(tab[a].tolist()))
        return pd.Series(out, dtype=object)

    return df.withColumns({o: _dec(F.col(c)) for c, o in zip(cols, outs)})


@F.arrow_udf(T.StringType())
def _ids_text_udf(ids: pa.Array) -> pa.Array:
    lens, flat = list_lens(ids), ids.flatten()
    if flat.null_count:  # null ids are left out
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[known], minlength=len(lens))
    text = pc.binary_join(list_array(lens, flat.drop_null().cast(pa.string())), ",")
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), text)


def ids_text(c) -> Column:
    """Array of ids as comma-separated text (for reports and cross-engine checks)."""
    return _ids_text_udf(_c(c))


def truncation_audit(df: DataFrame, group_cols: list[str], total_len: str, prefix_len: str,
                     max_length: int) -> DataFrame:
    """Answer tokens kept and lost to right truncation, per group."""
    t, p = F.col(total_len), F.col(prefix_len)
    answer = F.greatest(t - p, F.lit(0))
    kept = F.greatest(F.least(t, F.lit(max_length)) - p, F.lit(0))
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(answer).cast("long").alias("answer_tokens"),
        F.sum(kept).cast("long").alias("kept_tokens"),
        F.sum(answer - kept).cast("long").alias("lost_tokens"),
        F.count_if(kept < answer).alias("truncated_records"),
        F.count_if((kept == 0) & (answer > 0)).alias("answer_fully_lost"))
