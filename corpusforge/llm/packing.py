"""Hierarchical packing into context windows of several sizes.

Documents are tokenised once into a staged table (unique row id, ids, count).
Whole windows of the longest tier leave a document first; its remainder is
routed to the shortest tier that holds it. From the longest tier down:

1. each piece of the tier opens a window;
2. the windows' gaps, laid end to end, are matched with the pieces of all
   shorter tiers, laid end to end (shortest tier first): a piece is cut where a
   gap ends, and as many windows are filled as the shorter pieces can fill whole;
3. pieces whose window stays open are laid end to end and cut at the tier's
   size. What is left at the very end is cut into powers of two.

So every sequence has exactly a power of two tokens and needs no padding.
Sequences are numbered by descending size and dealt to step groups of
STEP_TOKENS tokens: a group never splits a sequence, and all but the last hold
exactly the same number of tokens.

All laying end to end is a distributed running total over narrow rows (row id,
start, length); the ids move once, when documents meet their cuts.

Defined results: null text is an empty text and packs its end id alone;
repeated rows are packed each, in the order of their row ids, as ties are; an empty
table gives an empty result; very long texts are tokenised whole and cut over as
many sequences as they need; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import RunHash, byte_slices, running, staged

TIERS = (1024, 2048, 4096)
STEP_TOKENS = 8 * 4096
END_ID = 2
#: Entries of a task's table of white-space separated words and their ids (memory bound).
CACHE = 300_000
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Small letters of ASCII and Latin-1 in UTF-8, whole characters whatever the normal form.
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Any letters of ASCII and Latin-1.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The normalizer and pre-tokenizer with which a text's ids are those of its white-space separated words.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a word in byte pairs; a text that holds it is encoded word by word.
_END = b"\x01"
#: Bytes of text whose words are looked up together.
SLICE = 1 << 19
#: Characters that change neither by composition with a neighbour here nor, but for simple capitals, by lowering:
#: Latin (without the dotted capital i), Cyrillic, common Han characters, Hangul syllables, punctuation, currency signs.
_PLAIN = ((0, 0x130), (0x131, 0x300), (0x400, 0x460), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0)
#: Endings that the split pattern takes whole.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _by_word(spec: dict) -> bool:
    """Whether the tokenizer drops white space, lowers, and has no token over a space."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return ((spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and pre[0].get("pattern") == {"Regex": SPLIT}
            and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", ())))


def _byte_pairs(spec: dict):
    """Byte-pair encoder of lower-case words, each closed by _END, with the vocabulary's merges; None if it has no such form."""
    import tiktoken
    model = spec["model"]
    end, order = model.get("end_of_word_suffix"), [model["vocab"].get("".join(m)) for m in model.get("merges", ()) if not isinstance(m, str)]
    if not end or not order or None in order or order != sorted(order):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}
    ranks = {}
    for token, n in model["vocab"].items():
        core = token.removesuffix(end)
        if all(c in letter for c in core):
            ranks[bytes(letter[c] for c in core) + _END * (core != token)] = n
    return tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})


class _Words(dict):
    """Word -> its ids as little-endian uint32; a word is encoded when it is first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = _by_word(spec)
        self.pairs = _byte_pairs(spec) if self.by_word else None
        probes = ("a", "words", "straße", "été", "niño", "œuvre", "zqxj", "antidisestablishmentarianism")
        if self.pairs and any(self.piece(w.encode()) != self.whole(w) for w in probes):
            self.pairs = None
        self.kinds = None
        if self.pairs:
            self.closing = np.zeros(self.pairs.max_token_value + 1, bool)
            self.closing[[n for b, n in self.pairs._mergeable_ranks.items() if len(b) > 1 and b.endswith(_END)]] = True
        self.runs = RunHash(0x9E3779B97F4A7C15), RunHash(0xD1B54A32D192ED03)
        self.forget()

    def forget(self):
        """Drop the word table: sorted hashes, second hashes, place and number of a word's ids in ``pool``."""
        self.clear()
        self.known = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)]
        self.pool = np.zeros(0, np.uint32)

    def piece(self, word: bytes) -> list[int]:
        return self.pairs.encode_ordinary(word.decode() + _END.decode())

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> bytes:
        if self.pairs and _SMALL.fullmatch(word):
            ids = self[word] = array("I", self.piece(word)).tobytes()
            return ids
        # letters and a run of marks after them are pieces of their own ("word," is "word" and ","), and the
        # tokenizer lowers its input; such forms take a place only beside a word that has been seen before.
        # The tokenizer's control strings stay whole.
        if b"<|" not in word:
            stem = word.rstrip(_MARKS)
            cut = stem and stem != word and _LETTERS.fullmatch(stem[-2:] if stem[-1] > 127 else stem[-1:])
            base = stem if cut else word.decode().lower().encode() if _LETTERS.fullmatch(word) else word.lower()
            if base != word:
                seen = base in self
                ids = self[base] + self[word[len(stem):]] if cut else self[base]
                if seen:
                    self[word] = ids
                return ids
        ids = self[word] = array("I", self.whole(word.decode("utf-8", "replace"))).tobytes()
        return ids


    def kind_of(self) -> np.ndarray:
        """Class of every character for the split pattern; 255 for those that are left to the tokenizer itself."""
        if self.kinds is None:
            self.kinds = np.full(0x110000, 255, np.uint8)
            for lo, hi in _PLAIN:
                if hi - lo > 5000:
                    self.kinds[lo:hi] = _LETTER
                    continue
                for n in range(lo, hi):
                    major = unicodedata.category(chr(n))[0]
                    self.kinds[n] = _LETTER if major == "L" else _NUMBER if major == "N" else 255 if major == "M" else _OTHER
            self.kinds[list(_SPACES)] = _SPACE
            self.kinds[_END[0]] = 255
        return self.kinds

    def words(self, texts: list[str]):
        """Lowered texts in one and as code points; start, end and text of each word of plain texts; which texts are not plain."""
        low = [t.lower() for t in texts]
        joined = "".join(f"{t}\n" for t in low)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind_of()[points]
        ends = np.cumsum([len(t) + 1 for t in low], dtype=np.int64)
        odd = np.array(["<|" in t for t in low], bool)
        odd[np.searchsorted(ends, np.flatnonzero(kind == 255), "right")] = True
        # words begin where the class changes, and at every number
        starts = np.append(True, kind[1:] != kind[:-1]) | (kind == _NUMBER)
        quote = np.flatnonzero(points == 39)
        quote = quote[starts[quote]]
        for ending in _ENDINGS:
            at = quote[quote + len(ending) < len(points)]
            for k, c in enumerate(ending, 1):
                at = at[points[at + k] == ord(c)]
            starts[at + 1] = False
            starts[at + len(ending) + 1] = True  # at most the line end after the text
        keep = kind != _SPACE
        start, end = np.flatnonzero(starts & keep), np.flatnonzero(np.append(starts[1:], True) & keep) + 1
        doc = np.searchsorted(ends, start, "right")
        plain = ~odd[doc]
        return joined, points, start[plain], end[plain], doc[plain], odd

    def encode_words(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text, every distinct word encoded once; None where a text is not plain."""
        if len(self.known[0]) > CACHE:
            self.forget()
        joined, points, start, end, doc, odd = self.words(texts)
        codes = points.astype(np.uint64) + np.uint64(1)  # no character is nought to the hashes
        one, two = (run(codes, start, end) for run in self.runs)
        own, first, which = np.unique(one, return_index=True, return_inverse=True)
        hashes, others, _, _ = self.known
        at = np.searchsorted(hashes, own)
        new = np.flatnonzero(np.append(hashes, np.uint64(0))[at] != own) if len(hashes) else np.arange(len(own))
        new = np.union1d(new, np.flatnonzero(at == len(hashes)))
        if len(new):
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist())
            ids = self.pairs.encode_to_numpy("".join([joined[a:b] + "\x01" for a, b in spans]), disallowed_special=())
            stop = np.flatnonzero(self.closing[ids]) + 1
            size = np.diff(stop, prepend=0)
            rows = own[new], two[first[new]], stop - size + len(self.pool), size
            self.known = [np.insert(k, at[new], r) for k, r in zip(self.known, rows)]
            self.pool = np.append(self.pool, ids)
            at = np.searchsorted(self.known[0], own)
        _, others, place, size = (k[at][which] for k in self.known)
        odd[doc[others != two]] = True  # two words with one hash: their texts go the other way
        # the words' ids, one after another
        upto = np.cumsum(size)
        out = self.pool[np.repeat(place - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)].astype("<u4").tobytes()
        cut = np.append(0, upto)[np.searchsorted(doc, np.arange(len(texts) + 1))] * 4
        return [None if bad else out[a:b] for bad, a, b in zip(odd.tolist(), cut.tolist(), cut[1:].tolist())]


def _encode(known: _Words, texts: list) -> list[bytes]:
    """Ids (little-endian uint32) of each text and the end id.

    Where the tokenizer drops white space and no token spans it, words are cut and
    looked up by array operations, each distinct one encoded once by the byte pairs
    of the vocabulary. A
    text with characters outside _PLAIN or a control string is encoded word by
    word through the tokenizer, each distinct word once; a tokenizer of another
    kind is given whole texts.
    """
    end, out, texts = np.array([END_ID], "<u4").tobytes(), [], [t or "" for t in texts]
    if not known.by_word:
        return [np.array(known.whole(t), "<u4").tobytes() + end for t in texts]
    for t, ids in zip(texts, known.encode_words(texts) if known.pairs else [None] * len(texts)):
        if ids is not None:
            out.append(ids + end)
            continue
        if len(known) > CACHE:
            known.forget()
        out.append(b"".join(map(known.__getitem__, t.encode("utf-8", "replace").split())) + end)
    return out


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (rid, doc_id, n, ids): a unique row id, the id count and the ids of every document."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = src.select("doc_id", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("ids")).schema

    def run(batches):
        known = _Words(tokenizer_path)
        for b in batches:
            for part in byte_slices(b, 1, SLICE):
                ids = _encode(known, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                                  pa.array(ids, pa.binary())], names=schema.names)
    return staged(src.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "pack-tokens")


def _powers(total: int) -> list[int]:
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


def _total(df: DataFrame, col: str) -> int:
    return df.agg(F.sum(col)).first()[0] or 0


def _chop(pieces: DataFrame, size: int, cls: str, name: str):
    """Lay pieces end to end and cut at ``size``; the tail goes to powers of two.

    -> (cut pieces, number of whole windows, tail sizes)
    """
    laid = staged(running(pieces, "len", ["rid", "start"]), name)
    total = _total(laid, "len")
    whole, tails = total // size, _powers(total % size)
    at = [whole * size + sum(tails[:k]) for k in range(len(tails))]
    win = "array<struct<at:long,size:long,cls:string,idx:long>>"
    tail = F.array(*[F.struct(F.lit(a).cast("long").alias("at"), F.lit(s).cast("long").alias("size"),
                              F.lit(f"{cls}tail").alias("cls"), F.lit(k).cast("long").alias("idx"))
                     for k, (a, s) in enumerate(zip(at, tails))]).cast(win)
    first, last = F.floor(F.col("lo") / size), F.least(F.floor((F.col("hi") - 1) / size), F.lit(whole - 1))
    regular = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: F.struct(
        (k * size).alias("at"), F.lit(size).cast("long").alias("size"), F.lit(cls).alias("cls"), k.alias("idx")))
    ).otherwise(F.array().cast(win)).cast(win)
    over = F.filter(F.concat(regular, tail), lambda w: (w["at"] < F.col("hi")) & (w["at"] + w["size"] > F.col("lo")))
    cut = laid.withColumn("w", F.explode(over))
    lo = F.greatest("lo", F.col("w.at"))
    return cut.select("rid", (F.col("start") + lo - F.col("lo")).alias("start"),
                      (F.least("hi", F.col("w.at") + F.col("w.size")) - lo).alias("len"),
                      F.col("w.cls").alias("cls"), F.col("w.idx").alias("idx"), (lo - F.col("w.at")).alias("offset")), whole, tails


def _fill(pool: DataFrame, size: int, tiers, name: str):
    """Open windows for the tier's pieces and fill their gaps from shorter pieces.

    -> (placed pieces, number of filled windows, open pieces of the tier, rest of the pool)
    """
    lead = pool.where(F.col("len") > size // 2).withColumn("gap", F.lit(size) - F.col("len"))
    lead = running(lead.withColumn("one", F.lit(1)), "gap", ["rid", "start"], names=("g0", "g1"))
    lead = staged(running(lead, "one", ["rid", "start"], names=("idx", "idx1")).drop("one", "idx1"), name + "-lead")
    rank = sum((F.col("len") > t).cast("int") for t in tiers if t < size)
    fill = staged(running(pool.where(F.col("len") <= size // 2), "len", ["rid", "start"], rank, ("f0", "f1")), name + "-fill")
    have = _total(fill, "len")
    done = lead.where(F.col("g1") <= have)
    r = done.agg(F.count(F.lit(1)), F.max("g1")).first()
    n_done, used = r[0], r[1] or 0
    # match the two lines: both sides are cut into grid cells, an overlap counts in the cell where it begins
    cell = size // 2
    gaps = done.where("gap > 0").select("g0", "g1", "idx", F.col("len").alias("taken"), F.explode(
        F.sequence(F.floor(F.col("g0") / cell), F.floor((F.col("g1") - 1) / cell))).alias("cell"))
    filler = fill.where(F.col("f0") < used).withColumn("cell", F.explode(
        F.sequence(F.floor(F.col("f0") / cell), F.floor((F.least("f1", F.lit(used)) - 1) / cell))))
    lo, hi = F.greatest("f0", "g0"), F.least("f1", "g1")
    met = (filler.join(gaps, "cell").where((lo < hi) & (F.floor(lo / cell) == F.col("cell")))
           .select("rid", (F.col("start") + lo - F.col("f0")).alias("start"), (hi - lo).alias("len"),
                   F.lit(f"{size}").alias("cls"), "idx", (F.col("taken") + lo - F.col("g0")).alias("offset")))
    heads = done.select("rid", "start", "len", F.lit(f"{size}").alias("cls"), "idx", F.lit(0).cast("long").alias("offset"))
    rest = fill.where(F.col("f1") > used).select("rid", (F.col("start") + F.greatest(F.lit(used) - F.col("f0"), F.lit(0))).alias("start"),
                                                 (F.col("f1") - F.greatest("f0", F.lit(used))).alias("len"))
    return heads.unionByName(met), n_done, lead.where(F.col("g1") > have).select("rid", "start", "len"), rest


def plan(sizes: DataFrame, tiers=TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """(rid, pieces): where each document's ids go, from (rid, n) alone.

    A piece is (start, length, sequence_id, offset, window, step).
    """
    tiers, longest = tuple(sorted(tiers)), max(tiers)
    docs = staged(running(sizes.withColumn("full", F.floor(F.col("n") / longest)), "full", ["rid"],
                          names=("full_at", "full_to")), "pack-docs")
    n_full = _total(docs, "full")
    pool = docs.select("rid", (F.col("full") * longest).alias("start"), (F.col("n") - F.col("full") * longest).alias("len")).where("len > 0")
    parts, classes = [], [("full", longest, n_full)]
    tails = []
    for size in sorted(tiers[1:], reverse=True):
        placed, n_done, open_, pool = _fill(pool, size, tiers, f"pack-{size}")
        cut, n_cut, tail = _chop(open_, size, f"{size}open", f"pack-{size}-open")
        parts += [placed, cut]
        classes += [(f"{size}", size, n_done), (f"{size}open", size, n_cut)]
        tails += [(f"{size}opentail", k, s) for k, s in enumerate(tail)]
    cut, n_cut, tail = _chop(pool, tiers[0], f"{tiers[0]}open", f"pack-{tiers[0]}-open")
    parts.append(cut)
    classes.append((f"{tiers[0]}open", tiers[0], n_cut))
    tails += [(f"{tiers[0]}opentail", k, s) for k, s in enumerate(tail)]
    # number the sequences by descending size; each class is one run of equal sizes
    seq = tok = 0
    number: dict = {}
    for cls, size, n in classes:
        number[cls] = (seq, tok, size)
        seq, tok = seq + n, tok + n * size
    single = {}
    for cls, k, size in sorted(tails, key=lambda t: (-t[2], t[0])):
        single[cls, k] = (seq, tok, size)
        seq, tok = seq + 1, tok + size

    def place(c, i, what):
        """sequence id, first token or size of sequence ``i`` of class ``c``."""
        run_ = lambda v: v[0] + i if what == 0 else v[1] + i * v[2] if what == 1 else F.lit(v[2])
        out = F.lit(None).cast("long")
        for cls, v in number.items():
            out = F.when(c == cls, run_(v)).otherwise(out)
        for (cls, k), v in single.items():
            out = F.when((c == cls) & (i == k), F.lit(v[what])).otherwise(out)
        return out.cast("long")

    def piece(start, length, c, i, offset):
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"),
                        place(c, i, 0).alias("sequence_id"), offset.cast("long").alias("offset"),
                        place(c, i, 2).alias("window"), F.floor(place(c, i, 1) / step_tokens).cast("long").alias("step"))
    cuts = parts[0]
    for p in parts[1:]:
        cuts = cuts.unionByName(p)
    by = (cuts.select("rid", piece(F.col("start"), F.col("len"), F.col("cls"), F.col("idx"), F.col("offset")).alias("p"))
          .groupBy("rid").agg(F.collect_list("p").alias("cuts")))
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda k: piece(
        k * longest, F.lit(longest), F.lit("full"), F.col("full_at") + k, F.lit(0))))
    none = F.array().cast(by.schema["cuts"].dataType)
    return (docs.select("rid", "full", "full_at").join(by, "rid", "left")
            .select("rid", F.concat(F.coalesce(whole, none), F.coalesce("cuts", none)).alias("pieces")))


def pack(docs: DataFrame, tokenizer_path: str, tiers=TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step and the ids."""
    t = tokenised(docs, tokenizer_path, id_col, text_col)
    cuts = plan(t.select("rid", "n"), tiers, step_tokens)
    def cut(p):
        ids_ = F.substring(F.col("ids"), p["start"].cast("int") * 4 + 1, p["length"].cast("int") * 4)
        return F.struct(p.alias("p"), F.crc32(ids_).alias("crc"), *([ids_.alias("ids")] if with_ids else []))
    out = (t.join(cuts, "rid").select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform("pieces", cut)).alias("x"))
           .select("doc_id", "x.p.start", "x.p.length", F.col("x.crc").alias("ids_crc32"), "doc_tokens", "x.p.sequence_id",
                   "x.p.offset", "x.p.window", "x.p.step", *(["x.ids"] if with_ids else [])))
    return out
