"""Small numeric helpers that run inside Arrow-batched UDFs on executors.

Spark partitions and shuffles the work; these functions only see one Arrow
batch (at most ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows) at a time.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd


def _as_list(x):
    if x is None:
        return []
    return list(x)


# --------------------------------------------------------------------------
# ROUGE tokens as numbers: the same words as the column form rouge_tokens.
# --------------------------------------------------------------------------
_WORD_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else 32 for c in range(256))


class WordCodes(dict):
    """Word -> number, given as words are met; words of one ``stem`` share a number."""

    def __init__(self, stem=None):
        super().__init__()
        self.stem, self.stems = stem, {}

    def __missing__(self, word: bytes) -> int:
        if self.stem is None:
            n = len(self)
        else:
            s = self.stem(word.decode())
            n = self.stems.setdefault(s, len(self.stems))
        self[word] = n
        return n

    def lines(self, text: bytes | None) -> list[list[int]]:
        """Numbers of the lower-case [a-z0-9]+ words of a text (UTF-8), a list per line that has any."""
        if text is None:
            return []
        text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
        return [[*map(self.__getitem__, w)] for x in text.translate(_WORD_BYTES).split(b"\n") if (w := x.split())]


# --------------------------------------------------------------------------
# Clipped n-gram overlap for a whole batch, fully vectorised.
# --------------------------------------------------------------------------
def clipped_overlap(preds, refs) -> np.ndarray:
    """sum over grams g of min(count_pred(g), count_ref(g)), per row of the batch."""
    n = len(preds)
    lp = np.fromiter((0 if x is None else len(x) for x in preds), np.int64, n)
    lr = np.fromiter((0 if x is None else len(x) for x in refs), np.int64, n)
    tp, tr = int(lp.sum()), int(lr.sum())
    if tp == 0 or tr == 0:
        return np.zeros(n, dtype=np.int64)
    flat = np.concatenate([np.concatenate([x for x in preds if x is not None and len(x)]),
                           np.concatenate([x for x in refs if x is not None and len(x)])])
    codes, _ = pd.factorize(flat)
    return clipped_ngrams(codes, lp, lr, 1)


def clipped_ngrams(codes, pred_lens, ref_lens, n: int) -> np.ndarray:
    """Clipped overlap of the n-grams of token codes, per row: all predictions' tokens in a row, then all references'."""
    rows, lens = len(pred_lens), np.concatenate([pred_lens, ref_lens])
    row, place = np.repeat(np.arange(len(lens)), lens), np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    tokens = np.asarray(codes, np.int64) + 1
    grams, k = tokens, int(tokens.max(initial=0)) + 1
    for step in range(1, n):  # grams are numbered anew after each token, so the products stay small
        grams = pd.factorize(grams * k + np.roll(tokens, -step))[0]
    whole = place + n <= np.repeat(lens, lens)
    row, grams = row[whole], grams[whole]
    k = int(grams.max(initial=0)) + 1
    pred = row < rows
    up, cp = np.unique(row[pred] * k + grams[pred], return_counts=True)
    ur, cr = np.unique((row[~pred] - rows) * k + grams[~pred], return_counts=True)
    common, ip, ir = np.intersect1d(up, ur, assume_unique=True, return_indices=True)
    return np.bincount(common // k, weights=np.minimum(cp[ip], cr[ir]), minlength=rows).astype(np.int64)


# --------------------------------------------------------------------------
# Longest common subsequence, bit-parallel (Allison & Dix 1986; Crochemore
# et al. 2001; Hyyro 2004): one word-parallel step per token of b.
# --------------------------------------------------------------------------
def lcs_length(a, b) -> int:
    a, b = sorted((_as_list(a), _as_list(b)), key=len, reverse=True)
    # what both begin or end with is on a longest common subsequence
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(b))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not b:
        return head + tail
    masks = _token_masks(a)
    full = (1 << len(a)) - 1
    v = full
    for tok in b:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


# --------------------------------------------------------------------------
# Summary-level LCS (ROUGE-Lsum, Lin 2004 sec. 3.2): union of LCS hits per
# reference sentence, hits clipped by token counts on both sides.
# --------------------------------------------------------------------------
def _token_masks(tokens) -> dict:
    """Token -> bit vector of its places."""
    masks: dict = {}
    for j, t in enumerate(tokens):
        masks[t] = masks.get(t, 0) | (1 << j)
    return masks


def _lcs_indices(ref, cand, masks: dict | None = None) -> list:
    """Indices of ref tokens on one LCS path; the DP rows are bit vectors of the candidate's places.

    LCS(ref[:i], cand[:j]) is the number of zero bits among the low j bits of row i; a
    token that the candidate lacks has the row before it. The walk back from the end
    takes a token whose row counts more than the row before, or that stands at the
    candidate's place j, at its last place up to j: every place in between leaves the
    count of its row and not of the row before as it is, so the path goes left there.
    """
    masks = _token_masks(cand) if masks is None else masks
    m, n = len(ref), len(cand)
    out = []
    while m and n and ref[m - 1] == cand[n - 1]:  # what both end with is on the path
        m -= 1
        n -= 1
        out.append(m)
    full = low = (1 << n) - 1
    v, rows = full, []
    for i in range(m):
        mm = masks.get(ref[i])
        if mm is not None and (mm := mm & full):
            rows.append((i, mm, v))
            u = v & mm
            v = ((v + u) | (v - u)) & full
    for i, mm, before in reversed(rows):
        if mm := mm & low:
            top = mm.bit_length()
            if low >> top == 0 or (v & low).bit_count() < (before & low).bit_count():
                out.append(i)
                low = (1 << top - 1) - 1
                if not low:
                    break
        v = before
    return out


def summary_lcs_hits(ref_sents, cand_sents) -> tuple[int, int, int]:
    """(hits, ref token count, candidate token count) for ROUGE-Lsum.

    A token's hits are its places in the unions of all sentences, up to its count in the
    candidate, so sentences may be taken in any order. Those that the candidate has as
    they stand need no comparison. Every other one meets the candidate's sentence that
    shares most of its tokens, and further ones while it has places outside its union of
    a token that the candidate has left.
    """
    ref_sents = [list(s) for s in _as_list(ref_sents) if s is not None and len(s)]
    cand_sents = [list(s) for s in _as_list(cand_sents) if s is not None and len(s)]
    m = sum(len(s) for s in ref_sents)
    n = sum(len(s) for s in cand_sents)
    if m == 0 or n == 0:
        return 0, m, n
    distinct = list(dict.fromkeys(map(tuple, cand_sents)))
    if len(ref_sents) == len(distinct) == 1:  # the union is one path, and no hit is clipped
        return lcs_length(ref_sents[0], distinct[0]), m, n
    left = Counter(chain.from_iterable(cand_sents))
    whole, masks, holders, hits = set(distinct), [None] * len(distinct), {}, 0
    there = Counter(chain.from_iterable(s for s in ref_sents if tuple(s) in whole))
    for t, c in there.items():
        c = min(c, left[t])
        hits += c
        left[t] -= c
    for k, s in enumerate(distinct):
        for t in set(s):
            if left[t]:
                holders.setdefault(t, []).append(k)

    def meet(rs: list, union: set, k: int) -> None:
        nonlocal hits
        if masks[k] is None:
            masks[k] = _token_masks(distinct[k])
        for i in _lcs_indices(rs, distinct[k], masks[k]):
            if i not in union:
                union.add(i)
                if left[rs[i]] > 0:
                    left[rs[i]] -= 1
                    hits += 1

    begun = []
    for rs in ref_sents:
        if tuple(rs) not in whole:
            near = Counter(chain.from_iterable(holders[t] for t in {*rs} if t in holders and left[t] > 0))
            if near:
                begun.append((rs, set(), max(near, key=near.get)))
                meet(*begun[-1])
    for rs, union, best in begun:
        def lacking() -> set:
            return {t for i, t in enumerate(rs) if t in holders and left[t] > 0 and i not in union}  # noqa: B023
        lacks = lacking()
        for k, _ in Counter(chain.from_iterable(holders[t] for t in lacks)).most_common():
            if k != best and not lacks.isdisjoint(distinct[k]):
                meet(rs, union, k)
                lacks = lacking()
                if not lacks:
                    break
    return hits, m, n


# --------------------------------------------------------------------------
# Greedy cosine matching of token vectors (BERTScore without idf).
# --------------------------------------------------------------------------
GREEDY_BLOCK = 1024


def greedy_match(pred_vecs, ref_vecs, pred_n=None, ref_n=None) -> tuple[float, float, float]:
    """Mean best cosine of either side, weighted by counts; products are made in blocks."""
    if pred_vecs is None or ref_vecs is None or len(pred_vecs) == 0 or len(ref_vecs) == 0:
        return 0.0, 0.0, 0.0
    p, r = (np.asarray(x if isinstance(x, np.ndarray) and x.ndim == 2 else [np.asarray(v, dtype=np.float64) for v in x], np.float64)
            for x in (pred_vecs, ref_vecs))
    pn = np.linalg.norm(p, axis=1, keepdims=True)
    rn = np.linalg.norm(r, axis=1, keepdims=True)
    p = p / np.where(pn == 0, 1.0, pn)
    r = r / np.where(rn == 0, 1.0, rn)
    best_p, best_r = np.full(len(p), -np.inf), np.full(len(r), -np.inf)
    for i in range(0, len(p), GREEDY_BLOCK):
        for j in range(0, len(r), GREEDY_BLOCK):
            s = p[i:i + GREEDY_BLOCK] @ r[j:j + GREEDY_BLOCK].T
            np.maximum(best_p[i:i + GREEDY_BLOCK], s.max(axis=1), out=best_p[i:i + GREEDY_BLOCK])
            np.maximum(best_r[j:j + GREEDY_BLOCK], s.max(axis=0), out=best_r[j:j + GREEDY_BLOCK])
    prec = float(np.average(best_p, weights=pred_n))
    rec = float(np.average(best_r, weights=ref_n))
    f = 2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0
    return prec, rec, f


def unit_rows(vec) -> np.ndarray:
    """Rows of length 1, in double precision; a zero row stays."""
    vec = np.asarray(vec, np.float64)
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    return vec / np.where(norm == 0, 1.0, norm)


def greedy_rows(unit, p, r, pred_n, ref_n, own: bool) -> tuple[float, float, float]:
    """``greedy_match`` of the rows p and r (numbers, ascending) of ``unit_rows``.

    With ``own`` every row's cosine with itself is 1, the most that there is, so a row
    that is on both sides needs no products; without (zero or unknown values) all do.
    """
    if len(p) == 0 or len(r) == 0:
        return 0.0, 0.0, 0.0
    means = []
    for a, b, n in ((p, r, pred_n), (r, p, ref_n)):
        best = np.full(len(a), -np.inf)
        if own:
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            best[b[at] == a] = 1.0
        rest = np.flatnonzero(best < 1.0)
        for i in range(0, len(rest), GREEDY_BLOCK):
            some = unit[a[rest[i:i + GREEDY_BLOCK]]]
            for j in range(0, len(b), GREEDY_BLOCK):
                top = (some @ unit[b[j:j + GREEDY_BLOCK]].T).max(axis=1)
                best[rest[i:i + GREEDY_BLOCK]] = np.maximum(best[rest[i:i + GREEDY_BLOCK]], top)
        means.append(float((best * n).sum() / n.sum()))
    prec, rec = means
    return prec, rec, 2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0


# --------------------------------------------------------------------------
# Porter stemmer: the original 1980 algorithm (Porter, "An algorithm for
# suffix stripping", Program 14(3)), and the extended variant that public ROUGE
# scorers use: a few irregular words, short -ies / -ied words keep -ie, a final
# y turns to i only after a consonant that is not the first letter, -bli, -fulli
# and -logi endings, and vowel-consonant words of two letters count as short.
# --------------------------------------------------------------------------
# Words the extended variant answers as a whole.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
             "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
_VOWELS = set("aeiou")


def _is_cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    m, prev_v = 0, False
    for i in range(len(stem)):
        v = not _is_cons(stem, i)
        if prev_v and not v:
            m += 1
        prev_v = v
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _ends_double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str, extended: bool = False) -> bool:
    if extended and len(w) == 2:
        return not _is_cons(w, 0) and _is_cons(w, 1)
    if len(w) < 3:
        return False
    return (_is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2)
            and _is_cons(w, len(w) - 1) and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond(stem) else w
    return w


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
          ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
          ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
          ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
          "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _step2_extended(w: str) -> str:
    positive = lambda s: _measure(s) > 0
    if w.endswith("alli"):
        return _step2_extended(w[:-2]) if positive(w[:-4]) else w
    if w.endswith("logi"):
        return w[:-1] if positive(w[:-3]) else w
    rules = [("bli", "ble") if r[0] == "abli" else r for r in _STEP2]
    return _replace(w, [("fulli", "ful"), *rules], positive)


def porter_stem(w: str, extended: bool = False) -> str:
    if extended and w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    # step 1a; short words in -ies and -ied keep their e
    if extended and len(w) == 4 and w.endswith("ies"):
        w = w[:-1]
        return _after_1a(w, extended)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    return _after_1a(w, extended)


def _after_1a(w: str, extended: bool) -> str:
    # step 1b
    extra = False
    if extended and w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _ends_double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w, extended):
            w += "e"
    # step 1c
    if w.endswith("y") and (len(w) > 2 and _is_cons(w, len(w) - 2) if extended else _has_vowel(w[:-1])):
        w = w[:-1] + "i"
    # steps 2, 3
    w = _step2_extended(w) if extended else _replace(w, _STEP2, lambda s: _measure(s) > 0)
    w = _replace(w, _STEP3, lambda s: _measure(s) > 0)
    # step 4
    for suf in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        mm = _measure(stem)
        if mm > 1 or (mm == 1 and not _cvc(stem, extended)):
            w = stem
    # step 5b
    if _measure(w) > 1 and _ends_double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w
