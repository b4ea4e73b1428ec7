"""Pure-Python kernels: exactness against plain definitions."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusforge.functions import kernels
from tests import plain_lcs

toks = st.lists(st.sampled_from(list("abcdefg")), max_size=40)


@given(toks, toks)
@settings(max_examples=300, deadline=None)
def test_bit_parallel_lcs_equals_dp(a, b):
    assert kernels.lcs_length(a, b) == plain_lcs.lcs_length_dp(a, b)


def test_lcs_hand_case():
    assert kernels.lcs_length("a b c d e".split(), "a x c e".split()) == 3


@given(st.lists(st.tuples(toks, toks), max_size=12))
@settings(max_examples=200, deadline=None)
def test_clipped_overlap_equals_counter(rows):
    import numpy as np
    preds = [np.array(p, dtype=object) for p, _ in rows]
    refs = [np.array(r, dtype=object) for _, r in rows]
    got = kernels.clipped_overlap(preds, refs) if rows else []
    want = [sum((Counter(p) & Counter(r)).values()) for p, r in rows]
    assert list(got) == want


def test_summary_lcs_hand_case():
    hits, m, n = kernels.summary_lcs_hits([["a", "b", "c"], ["a", "d"]], [["a", "b", "d"]])
    assert (hits, m, n) == (3, 5, 3)
    p, r = hits / n, hits / m
    assert abs(2 * p * r / (p + r) - 0.75) < 1e-12


def test_greedy_match_hand_case():
    p, r, f = kernels.greedy_match([[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]])
    assert (p, r) == (1.0, 0.5)
    assert abs(f - 2 / 3) < 1e-12


def test_porter_known_stems():
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop",
             "falling": "fall", "happy": "happi", "sky": "sky", "relational": "relat",
             "generalization": "gener", "hopeful": "hope", "goodness": "good", "adjustment": "adjust"}
    for w, s in cases.items():
        assert kernels.porter_stem(w) == s, w


def test_extended_stems():
    cases = {"dying": "die", "died": "die", "dies": "die", "ties": "tie", "flies": "fli", "flied": "fli", "spied": "spi",
             "enjoy": "enjoy", "happy": "happi", "by": "by", "sky": "sky", "skies": "sky", "news": "news", "possibly": "possibl",
             "geology": "geolog", "hopefully": "hope", "generally": "gener", "caresses": "caress", "proceed": "proceed"}
    for w, s in cases.items():
        assert kernels.porter_stem(w, extended=True) == s, (w, kernels.porter_stem(w, extended=True))


@given(toks, toks)
@settings(max_examples=300, deadline=None)
def test_bit_row_backtrack_equals_table_backtrack(a, b):
    assert kernels._lcs_indices(a, b) == plain_lcs.lcs_indices_table(
        [ord(x) for x in a], [ord(x) for x in b])


def _real_pairs():
    """Whole texts of the tables against each other: neither is a subsequence of the other."""
    import re

    import pyarrow.parquet as pq
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    texts = [[re.findall("[a-z0-9]+", s.lower()) for s in re.split(r"[.\n]+", t)] for t in texts if 20 < len(t) < 4000][:40]
    return list(zip(texts, texts[1:] + texts[:1]))


def test_kernels_on_real_pairs_equal_the_plain_programmes():
    seen = 0
    for a, b in _real_pairs():
        flat_a, flat_b = [w for s in a for w in s], [w for s in b for w in s]
        n = plain_lcs.lcs_length_dp(flat_a, flat_b)
        assert kernels.lcs_length(flat_a, flat_b) == n
        seen += 0 < n < min(len(flat_a), len(flat_b))
        # the union of the paths of every pair of sentences, clipped by counts
        cr, cc, hits = Counter(flat_a), Counter(flat_b), 0
        for s in a:
            union = {i for c in b for i in plain_lcs.lcs_indices_table(*_codes(s, c))}
            for i in sorted(union):
                if cr[s[i]] > 0 and cc[s[i]] > 0:
                    hits, cr[s[i]], cc[s[i]] = hits + 1, cr[s[i]] - 1, cc[s[i]] - 1
        assert kernels.summary_lcs_hits(a, b) == (hits, len(flat_a), len(flat_b))
    assert seen > 20


def _codes(a, b):
    number: dict = {}
    return [number.setdefault(w, len(number)) for w in a], [number.setdefault(w, len(number)) for w in b]
