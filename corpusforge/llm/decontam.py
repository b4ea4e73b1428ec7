"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; other words are lowered.
Windows of WINDOW canonical tokens of documents and benchmark items are hash
joined, and the canonical text of joined windows is compared as well. A
diagonal is a document position minus an item position. Windows of one document
and item on one diagonal, in one of the overlapping bands of 2 * SHIFT
diagonals, or in one of those of twice the item's size are one alignment, so a
word more or less does not split an item. An alignment is a leak if

* it covers at least min(NEED, half of the item's windows) item windows, or, by
  the windows of SHORT symbols that items under LONG tokens have as well, all
  tokens of the item but one in ten (at least one), and
* its slots are consistent: each value of the item stands for one value of the
  document and the other way round (a re-parameterised question), or windows
  of WINDOW without any slot alone reach the same number (a verbatim passage).

A run of names and a number with the number words after it are one symbol.
A text has three readings, each with windows of its own: `plain` (lower-cased
tokens, no slots, so marks and capitals do not count), `start` (capitalised words
inside a sentence are names, the first word of a sentence is not) and `name`
(every capitalised word is a name, so sentence marks do not count). Windows are
joined and alignments judged within a reading; one that leaks is enough. Units are unit words after a
number and currency or percent signs; number words count as numbers. A window
with slots needs at least LITERAL literal words, so runs of placeholders match
nothing.

Only windows that pass a fixed-size Bloom filter of the item windows (2 **
BLOOM_BITS bits, whatever the benchmark's size) leave the task; the join that
follows is exact, so a fuller filter costs rows, never results.

`plain` windows need no literals, so an item full of numbers or names is found
where it stands as it is. An item of fewer than WINDOW tokens has one window,
the whole of its lower-cased tokens, and is a leak wherever they stand in a row.

Defined results: null texts and texts without tokens have no windows and match
nothing; copies of a document or an item each give their
own rows; repeated rows of one (id, text) give one row; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import RunHash, byte_slices, fresh, staged

WINDOW, LITERAL, NEED, BLOOM_BITS = 8, 4, 8, 23
#: Items of WINDOW to LONG - 1 tokens have windows of SHORT symbols as well, of which SHORT_LITERAL are literal.
SHORT, SHORT_LITERAL, LONG = 4, 1, 32
#: Diagonals of a narrow band.
SHIFT = 4
#: Words read as numbers, and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty "
                         "forty fifty sixty seventy eighty ninety hundred thousand million".split())
UNITS = frozenset("km m cm mm kg g mg t l ml cl s ms min h hr kb mb gb mph kmh km/h mile miles meter meters metre "
                  "metres foot feet inch inches yard yards gram grams kilogram kilograms ton tons pound pounds ounce "
                  "ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month "
                  "months year years dollar dollars cent cents euro euros percent degree degrees".split())
_BREAK, _WORD, _CAP, _NUM, _UNIT, _SIGN, _NUMWORD = range(7)
#: Bytes of text whose tokens are handled together; a longer text is a slice of its own.
SLICE = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PLACE = {_NUM: "<num>", _CAP: "<name>", _UNIT: "<unit>", _SIGN: "<unit>"}
PLAIN, START, NAME, WHOLE = "plain", "start", "name", "whole"
#: (reading, symbols) of all windows: WHOLE ones are items under WINDOW tokens as they are.
KINDS = [*((name, span) for name in (PLAIN, START, NAME) for span in (WINDOW, SHORT)), *((WHOLE, n) for n in range(1, WINDOW))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace"), 17)


_PLACE_HASH = {k: np.uint64(_digest(v)) for k, v in _PLACE.items()}


_SPECIAL = dict.fromkeys(UNITS, _UNIT) | dict.fromkeys("%€$£°", _SIGN) | dict.fromkeys(NUMBER_WORDS, _NUMWORD)
#: What a character starts or continues (low three bits), and what else it is.
_LETTER, _DIGIT, _MARK, _SIGNS = range(1, 5)
_JOINS_LETTERS, _JOINS_DIGITS, _UPPER, _TITLE, _LOWER, _ISDIGIT, _KNOWN = (1 << k for k in range(3, 10))


class Alphabet:
    """Class and hash of every character met so far; hashes do not tell capitals, nor forms of sigma, apart."""

    def __init__(self):
        self.flags, self.codes = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint64)
        self.runs = RunHash(0x9E3779B97F4A7C15)
        self._learn({*range(0x250), *map(ord, "".join(_SPECIAL))})
        words = sorted((int(self.hashes(np.frombuffer(w.encode("utf-32-le"), np.uint32), np.array([0]), np.array([len(w)]))[0]), k)
                       for w, k in _SPECIAL.items())
        self.special = np.array([h for h, _ in words], np.uint64), np.array([k for _, k in words], np.int8)

    def _learn(self, points):
        for n in points:
            c = chr(n)
            flag = (_LETTER if c.isalnum() and not c.isdecimal() else _DIGIT if c.isdecimal() else _MARK if c in ".!?\n"
                    else _SIGNS if c in "%€$£°" else 0)
            for bit, has in ((_JOINS_LETTERS, c in "'’"), (_JOINS_DIGITS, c in ".,:/"), (_UPPER, c.isupper()),
                             (_TITLE, c.istitle()), (_LOWER, c.islower()), (_ISDIGIT, c.isdigit())):
                flag |= bit * has
            self.flags[n] = flag | _KNOWN
            self.codes[n] = _digest(c.lower().replace("ς", "σ"))

    def classes(self, points: np.ndarray) -> np.ndarray:
        flags = self.flags[points]
        if not flags.all():
            self._learn(np.unique(points[flags == 0]).tolist())
            flags = self.flags[points]
        return flags

    def hashes(self, points: np.ndarray, start, end) -> np.ndarray:
        """Hash of each run of characters, capitals as small letters."""
        return _mix(self.runs(self.codes[points], start, end))


class Tokens:
    """Tokens of some texts in one run, sentence breaks removed: kind, hash, text number, position, first of a sentence.

    Tokens are runs of ``.!?`` and newlines (breaks), digits with single ``.,:/``
    between them, letters with single apostrophes between them, and single signs.
    """

    def __init__(self, texts, alphabet: Alphabet):
        texts = [t or "" for t in texts]
        self.joined = "\0".join(["", *texts, ""])  # a character before and after each text that belongs to no token
        points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        flags = alphabet.classes(points)
        group = (flags & 7).astype(np.uint8)
        joins = [(at[(group[at - 1] == g) & (group[at + 1] == g)], g) for at, g in (
            (np.flatnonzero(flags & _JOINS_LETTERS), _LETTER), (np.flatnonzero(flags & _JOINS_DIGITS), _DIGIT))]
        for at, g in joins:
            group[at] = g
        edge, single = group[1:] != group[:-1], group == _SIGNS
        start = np.flatnonzero((np.append(True, edge) | single) & (group > 0))
        end = np.flatnonzero((np.append(edge, True) | single) & (group > 0)) + 1
        hash_ = alphabet.hashes(points, start, end)
        head, heads = group[start], flags[start]
        up, low = (np.cumsum((flags & bits) > 0, dtype=np.int32) for bits in (_UPPER | _TITLE, _LOWER))
        kind = np.full(len(start), _WORD, np.int8)
        kind[((heads & _UPPER) > 0) & (up[end - 1] == up[start]) & (low[end - 1] > low[start])] = _CAP
        words, kinds = alphabet.special
        at = np.minimum(np.searchsorted(words, hash_), len(words) - 1)
        kind = np.where(words[at] == hash_, kinds[at], kind)
        kind[(heads & _ISDIGIT) > 0] = _NUM
        kind[head == _MARK] = _BREAK
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)  # of each text in ``joined``
        doc = np.searchsorted(ends, start)
        first = np.append(True, (kind[:-1] == _BREAK) | (doc[1:] != doc[:-1]))[:len(kind)]
        keep = np.flatnonzero(kind != _BREAK)
        self.start, self.stop = start[keep], end[keep]
        self.kind, self.hash, self.doc, self.first = kind[keep], hash_[keep], doc[keep], first[keep]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.pos = np.arange(len(keep)) - (np.cumsum(self.size) - self.size)[self.doc]

    def lowered(self, a: int, b: int) -> str:
        """Tokens ``a`` to ``b`` in lower case."""
        return " ".join(self.joined[s:e].lower() for s, e in zip(self.start[a:b].tolist(), self.stop[a:b].tolist()))


class Form:
    """One reading of the tokens: which of them are slots, and the symbols that windows are made of."""

    def __init__(self, t: Tokens, name: str):
        self.t, self.name = t, name
        slot = np.full(len(t.kind), -1, np.int8)
        before = np.append(_BREAK, t.kind)[:len(t.kind)]
        inside = t.pos > 0 if name == NAME else ~t.first
        head = np.ones(len(slot), bool)
        if name not in (PLAIN, WHOLE):
            number, counted = (t.kind == _NUM) | (t.kind == _NUMWORD), (before == _NUM) | (before == _NUMWORD)
            slot[number] = _NUM
            slot[t.kind == _SIGN] = _SIGN
            slot[(t.kind == _CAP) & (inside | (name == NAME))] = _CAP
            slot[(t.kind == _UNIT) & inside & counted] = _UNIT
            # a run of names, or a number with the number words after it, is one symbol
            last = np.append(-1, slot)[:len(slot)]
            head = ~(inside & (((slot == _CAP) & (last == _CAP)) | ((t.kind == _NUMWORD) & counted)))
        hash_ = t.hash.copy()
        for k, h in _PLACE_HASH.items():
            hash_[slot == k] = h
        first = np.flatnonzero(head)
        #: symbols: their slot kind, hash, text number and first token; ``end`` is the token after a symbol
        self.slot, self.hash, self.doc, self.first = slot[first], _mix(hash_[first]), t.doc[first], first
        self.end = np.append(first[1:], len(head))[:len(first)]

    def windows(self, span: int, literal: int) -> tuple[np.ndarray, np.ndarray]:
        """(first symbols, hashes) of the windows of ``span`` symbols of one text with enough literals."""
        n = len(self.hash) - span + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, _digest(f"{self.name} {span}"), np.uint64)
        for k in range(span):
            h = h * _MULT + self.hash[k:k + n]
        ok = self.doc[:n] == self.doc[span - 1:]
        if literal and self.name not in (PLAIN, WHOLE):
            count = np.concatenate([[0], np.cumsum(self.slot < 0)])
            ok &= count[span:] - count[:-span] >= literal
        at = np.flatnonzero(ok)
        return at, _mix(h[at])

    def text(self, i: int, span: int) -> tuple[str, list[str]]:
        """(canonical text, slot values) of the window at symbol ``i``."""
        own = [self.t.lowered(a, b) for a, b in zip(self.first[i:i + span].tolist(), self.end[i:i + span].tolist())]
        kinds = self.slot[i:i + span].tolist()
        return (" ".join([f"{self.name}{span}", *(t if s < 0 else _PLACE[s] for t, s in zip(own, kinds))]),
                [f"{_PLACE[s]}{t}" for t, s in zip(own, kinds) if s >= 0])


def _bits(h: np.ndarray, size: int):
    mask = np.uint64(size - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


WINDOW_SCHEMA = ("id {id}, mark long, reading string, span int, size int, n int, pos int, upto int, hash long, form string, "
                 "slots array<string>")


def windows(df: DataFrame, id_col: str, text_col: str, bloom: np.ndarray | None = None,
            kinds: list[tuple[str, int]] = KINDS) -> DataFrame:
    """(id, mark, reading, span, size, n, pos, upto, hash, form, slots): windows of each distinct (id, text).

    ``mark`` is a hash of the text (the row's identity beside its id), ``size``
    its tokens, ``n`` the number of its windows of this kind, ``pos`` to ``upto``
    the tokens of the window. ``bloom`` keeps only windows that may be joined, and
    of equal WHOLE windows of a text the first; without it (items), short windows
    are those of short texts, and WHOLE windows are whole texts.
    """
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
                    F.col(text_col).cast("string").alias("text"))
    schema = WINDOW_SCHEMA.format(id=src.schema["id"].dataType.simpleString())

    packed = None if bloom is None else np.packbits(bloom)

    def run(batches):
        alphabet = Alphabet()
        bloom = None if packed is None else np.unpackbits(packed).astype(bool)
        for b in (part for batch in batches for part in byte_slices(batch, 2, SLICE)):
            t = Tokens(b.column(2).to_pylist(), alphabet)
            rows: list = [[] for _ in range(10)]
            f = None
            for name, span in kinds:
                f = f if f is not None and f.name == name else Form(t, name)
                at, h = f.windows(span, {WINDOW: LITERAL, SHORT: SHORT_LITERAL}.get(span, 0))
                if bloom is None and span < WINDOW:
                    size = t.size[f.doc[at]]
                    take = np.flatnonzero(size == span if name == WHOLE else (size >= WINDOW) & (size < LONG))
                    at, h = at[take], h[take]
                n = np.bincount(f.doc[at], minlength=b.num_rows)
                if bloom is not None:
                    one, two = _bits(h, len(bloom))
                    hit = np.flatnonzero(bloom[one])
                    hit = hit[bloom[two[hit]]]
                    if name == WHOLE:
                        hit = hit[np.sort(np.unique(np.stack([f.doc[at[hit]].astype(np.uint64), h[hit]]), axis=1, return_index=True)[1])]
                    at, h = at[hit], h[hit]
                k, lo = f.doc[at], t.pos[f.first[at]]
                hi = lo + f.end[at + span - 1] - f.first[at]
                for i, *row in zip(at.tolist(), k.tolist(), t.size[k].tolist(), n[k].tolist(), lo.tolist(), hi.tolist(),
                                   h.view(np.int64).tolist()):
                    for col, v in zip(rows, (*row, f.name, span, *f.text(i, span))):
                        col.append(v)
            k, size, n, lo, hi, h, name, span, form, slots = rows
            take = pa.array(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(name, pa.string()),
                 *(pa.array(x, pa.int32()) for x in (span, size, n, lo, hi)), pa.array(h, pa.int64()),
                 pa.array(form, pa.string()), pa.array(slots, pa.list_(pa.string()))],
                names=["id", "mark", "reading", "span", "size", "n", "pos", "upto", "hash", "form", "slots"])
    return src.mapInArrow(run, schema)


def _bloom(hashes: DataFrame) -> np.ndarray:
    """Fixed-size filter; at most 2 ** BLOOM_BITS / 64 words reach the driver."""
    mask = (1 << BLOOM_BITS) - 1
    bit = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(mask)),
                            F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(mask))))
    words = (hashes.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("w"),
                                                    F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("m"))
             .groupBy("w").agg(F.bit_or("m").alias("m")).collect())
    out = np.zeros((1 << BLOOM_BITS) // 64, np.uint64)
    for r in words:
        out[r["w"]] = np.uint64(r["m"] & 0xFFFFFFFFFFFFFFFF)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def alignments(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, mark, item_id, reading, span, item_windows, covered, verbatim, slots, consistent, leak) per aligned pair."""
    bench = staged(windows(items, item_col, item_text), "bench-windows")
    kinds = sorted((r["reading"], r["span"]) for r in bench.select("reading", "span").distinct().collect())  # at most KINDS
    docs_w = windows(docs, id_col, text_col, _bloom(bench), kinds)
    b = bench.select(F.col("id").alias("item_id"), F.col("mark").alias("item_mark"), F.col("n").alias("item_windows"),
                     F.col("size").alias("item_size"), F.col("pos").alias("item_pos"), F.col("upto").alias("item_upto"), "reading", "span",
                     "hash", "form", F.col("slots").alias("item_slots")).distinct()
    pairs = (docs_w.select(F.col("id").alias("doc_id"), "mark", "pos", "hash", "form", "slots").join(b, ["hash", "form"])
             .withColumn("diagonal", F.col("pos") - F.col("item_pos")))
    # a diagonal of its own, and each of two bands it lies in: narrow ones and ones of the item's size
    bands = [F.struct(F.lit(0).alias("wide"), F.col("diagonal").cast("long").alias("at"))]
    for wide, width in ((1, F.lit(SHIFT)), (2, F.col("item_size"))):
        own = F.floor(F.col("diagonal") / width)
        bands += [F.struct(F.lit(wide).alias("wide"), (own + k).alias("at")) for k in (0, 1)]
    pairs = pairs.withColumn("band", F.explode(F.array(*bands)))
    short = (F.col("span") == SHORT) & (F.col("reading") != WHOLE)
    by = pairs.groupBy("doc_id", "mark", "item_id", "item_mark", "reading", "span", "item_size", "item_windows", "band").agg(
        F.size(F.collect_set("item_pos")).alias("covered"),
        F.size(F.collect_set(F.when(F.size("slots") == 0, F.col("item_pos")))).alias("verbatim"),
        # distinct tokens of a short item: a bounded list
        F.size(F.array_distinct(F.flatten(F.collect_set(
            F.when(short, F.sequence("item_pos", F.col("item_upto") - 1)))))).alias("tokens"),
        # pairs of values of one item within its own length: a bounded list
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))))).alias("z"))
    by = by.select("doc_id", "mark", "item_id", "reading", "span", "item_size", "item_windows", "covered", "verbatim", "tokens",
                   F.size("z").alias("slots"),
                   ((F.size(F.array_distinct(F.col("z.i"))) == F.size("z"))
                    & (F.size(F.array_distinct(F.col("z.d"))) == F.size("z"))).alias("consistent"))
    need = F.least(F.lit(NEED), F.ceil(F.col("item_windows") / 2).cast("int"))
    whole = F.col("tokens") >= F.col("item_size") - F.greatest(F.lit(1), F.floor(F.col("item_size") / 10))
    enough = F.when(short, whole & F.col("consistent")).otherwise(
        ((F.col("covered") >= need) & F.col("consistent")) | (F.col("verbatim") >= need))
    return by.withColumn("leak", enough).drop("item_size", "tokens")


def leaks(docs: DataFrame, items: DataFrame, **cols) -> DataFrame:
    """(doc_id, item_id, covered, verbatim, item_windows, slots, consistent): the best leaking alignment of each pair."""
    best = F.max(F.struct("covered", "verbatim", "item_windows", "slots", "consistent")).alias("b")
    return (alignments(docs, items, **cols).where("leak").groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "b.*"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cols) -> DataFrame:
    """Rows of ``docs``, all columns, without a leak."""
    found = staged(alignments(docs, items, id_col, text_col, **cols).where("leak").select("doc_id", "mark").distinct(), "leaks")
    (mark,) = fresh(docs.columns, "cf_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    return marked.join(found, marked[id_col].eqNullSafe(found["doc_id"]) & (marked[mark] == found["mark"]),
                       "left_anti").drop(mark)
