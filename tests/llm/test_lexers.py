"""The array lexers of decontamination and packing against plain ones."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusforge.llm import decontam, packing

SF = "/root/testdata/sf0.001"
ODD = "aAbsStTmMdDrReEvVlL''''’  \n\t\x85\xa0\x00\x01\x1c.!?-_,:/12²½٣ªéÉßÀÆŁİıſЖжйЙё中文한글€£%°…–“”<|>Ḱ̊Σσς😀\xad​𝐀"
TOKEN = re.compile(r"[.!?\n]+|\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%€$£°]")


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(n)]


def real_texts():
    return pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()


def kind_of(token):
    if token[0] in ".!?\n":
        return decontam._BREAK
    if token[0].isdigit():
        return decontam._NUM
    special = decontam._SPECIAL.get(token.lower())
    if special is not None:
        return special
    capital = len(token) > 1 and token[0].isupper() and token[1:].islower()
    return decontam._CAP if capital else decontam._WORD


@pytest.mark.parametrize("texts", [odd_texts(4000, 1), real_texts(), [None, "", "five Km 3.5 kg", "Twenty Five MPH 5%"]])
def test_tokens_are_those_of_the_pattern(texts):
    got = decontam.Tokens(texts, decontam.Alphabet())
    want = []
    for d, text in enumerate(texts):
        first, pos = True, 0
        for token in TOKEN.findall(text or ""):
            kind = kind_of(token)
            if kind != decontam._BREAK:
                want.append((d, pos, token, kind, first))
                pos += 1
            first = kind == decontam._BREAK
    words = [got.joined[a:b] for a, b in zip(got.start, got.stop)]
    assert list(zip(got.doc.tolist(), got.pos.tolist(), words, got.kind.tolist(), got.first.tolist())) == want
    # one hash for each lower-cased word, whatever its capitals (forms of sigma count as one)
    by_word, by_hash = {}, {}
    for w, h in zip(words, got.hash.tolist()):
        low = w.lower().replace("ς", "σ")
        assert by_word.setdefault(low, h) == h and by_hash.setdefault(h, low) == low


def test_word_ids_are_the_tokenizers_own():
    import public_tokenizers
    known = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    plain = "".join(c for c in ODD if known.kind_of()[ord(c)] != 255)
    rng = random.Random(3)
    texts = [*odd_texts(3000, 2), *("".join(rng.choice(plain) for _ in range(rng.randrange(30))) for _ in range(3000)),
             *(t or "" for t in real_texts()[:200]), "it's WE'LL they're 's's'' ''s 5's", "<|endoftext|> a", "'", "a'", "x" * 3000]
    got = []
    for lo in range(0, len(texts), 500):
        got += packing._encode(known, texts[lo:lo + 500])
    want = [np.array([*e.ids, packing.END_ID], "<u4").tobytes() for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_words_with_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers
    known = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    second = known.runs[1]
    known.runs = (lambda codes, start, end: (end - start).astype(np.uint64)), second  # words of one length collide
    texts = ["one two three", "six ten", "cat dog house", "", "eleven"]
    want = [np.array([*known.whole(t), packing.END_ID], "<u4").tobytes() for t in texts]
    assert packing._encode(known, texts) == want and packing._encode(known, texts[::-1]) == want[::-1]


def test_word_table_is_bounded(monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(packing, "CACHE", 20)
    known = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for t in real_texts()[:40]]
    want = [np.array([*known.whole(t), packing.END_ID], "<u4").tobytes() for t in texts]
    assert [packing._encode(known, [t])[0] for t in texts] == want
