"""Scalar text expressions (JVM-side, codegen'd built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as Python's str.split() sees it: U+0009..U+000D, the
# separators U+001C..U+001F, U+0085 and every Z category (incl. U+00A0).
_PY_WHITESPACE = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize_text(c, lowercase: bool = False) -> Column:
    """strip and collapse all Unicode whitespace runs to one space."""
    out = F.trim(F.regexp_replace(_c(c), _PY_WHITESPACE, " "))
    return F.lower(out) if lowercase else out


def sentence_lines(c) -> Column:
    """one sentence per line (rule form: break after . ! ? followed by spaces)."""
    return F.regexp_replace(_c(c), r"([.!?]) +", "$1\n")


def rouge_tokens(c) -> Column:
    """lower-case, non-[a-z0-9] runs to a space, split, drop empties."""
    spaced = F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " "), lambda x: x != F.lit(""))


def ngrams(tokens, n: int) -> Column:
    """Contiguous n-grams of a token array, joined by a space (empty if too short)."""
    t = _c(tokens)
    if n == 1:
        return t
    return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)),
                    lambda i: F.concat_ws(" ", *[F.element_at(t, i + k) for k in range(n)])))


def summary_file_name(c, strict: bool = False) -> Column:
    """basename(fp).split('.')[-2] + '_sum.txt'; no dot -> null (or error)."""
    base = F.element_at(F.split(_c(c), "/"), -1)
    parts = F.split(base, "[.]")
    if strict:
        stem = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(
            F.raise_error(F.concat(F.lit("no extension in file name: "), base)))
    else:
        stem = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    return F.concat(stem, F.lit("_sum.txt"))


def subtask_lang(c) -> Column:
    """language = last '_' part of a subtask name."""
    return F.element_at(F.split(_c(c), "_"), -1)


def crop(c, n: int) -> Column:
    """First n code points."""
    return F.substring(_c(c), 1, n)
