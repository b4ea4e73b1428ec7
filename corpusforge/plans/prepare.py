"""Dataset preparation (section 3.1): split -> per-split drops -> crop, one lazy plan.

The result is one table with a ``split`` column; ``write_splits`` lays it out
as ``split=/lang=`` directories so readers prune to the splits they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusforge.config import PrepConfig
from corpusforge.operators.prep import crop_fields, drop_by_split
from corpusforge.operators.split import stratified_split


def prepare(records: DataFrame, cfg: PrepConfig = PrepConfig(), group_cols=("lang",),
            key_col: str = "doc_id") -> DataFrame:
    """records (key, lang, input, output, rationale, rationale_prompt) -> prepared splits."""
    s = stratified_split(records, list(group_cols), key_col, cfg.split)
    s = drop_by_split(s, cfg.drop_columns)
    return crop_fields(s, cfg.crop)
