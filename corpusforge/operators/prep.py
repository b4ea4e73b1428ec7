"""Column drops, crops, renames and domain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.config import CropConfig


def drop_column_strict(df: DataFrame, name: str) -> DataFrame:
    """Drop a column that must exist (plain ``drop`` ignores missing names)."""
    if name not in df.columns:
        raise KeyError(f"column {name!r} is missing; present: {df.columns}")
    return df.drop(name)


def drop_by_split(df: DataFrame, drop_map: dict, split_col: str = "split") -> DataFrame:
    """One table; a column dropped for a split becomes null on that split's rows."""
    cols = sorted({c for cs in drop_map.values() for c in cs})
    out = df
    for c in cols:
        if c not in df.columns:
            raise KeyError(f"column {c!r} is missing")
        splits = [s for s, cs in drop_map.items() if c in cs]
        if set(splits) >= {"train", "valid", "test"}:
            out = out.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
        else:
            out = out.withColumn(c, F.when(F.col(split_col).isin(*splits), F.lit(None)).otherwise(F.col(c)))
    return out


def split_view(df: DataFrame, split: str, drop_map: dict, split_col: str = "split") -> DataFrame:
    """Read view of one split with its dropped columns removed (pruned by Catalyst)."""
    keep = [c for c in df.columns if c not in drop_map.get(split, [])]
    return df.filter(F.col(split_col) == split).select(*keep)


def crop_fields(df: DataFrame, cfg: CropConfig = CropConfig(), split_col: str = "split",
                input_col: str = "input", output_col: str = "output") -> DataFrame:
    """Crop input/output to the first n code points on the configured splits only."""
    if not cfg.enabled:
        return df
    on = F.col(split_col).isin(*cfg.apply_to)
    return (df.withColumn(input_col, F.when(on, F.substring(input_col, 1, cfg.input_max_length))
                          .otherwise(F.col(input_col)))
              .withColumn(output_col, F.when(on, F.substring(output_col, 1, cfg.output_max_length))
                          .otherwise(F.col(output_col))))


def field_or_empty(df: DataFrame, name: str) -> Column:
    """A missing field reads as '' (length 0); a field that is no text reads as null (skipped)."""
    if name not in df.columns:
        return F.lit("")
    return F.col(name) if df.schema[name].dataType.simpleString() == "string" else F.lit(None).cast("string")


def rename_fields(df: DataFrame, mapping: dict) -> DataFrame:
    """P5: keep only the mapped columns, renamed old -> new."""
    missing = [o for o in mapping if o not in df.columns]
    if missing:
        raise KeyError(f"columns missing: {missing}")
    return df.select(*[F.col(o).alias(n) for o, n in mapping.items()])


MODE_COLUMNS = {
    "standard": ["input_ids", "attention_mask", "labels"],
    "distill": ["input_ids", "attention_mask", "labels",
                "input_ids_expl", "attention_mask_expl", "labels_expl"],
}


def select_mode_columns(df: DataFrame, mode: str, keys=("doc_id",)) -> DataFrame:
    """The columns a training mode keeps (text columns are dropped)."""
    if mode not in MODE_COLUMNS:
        raise ValueError(f"mode must be one of {sorted(MODE_COLUMNS)}")
    return df.select(*keys, *MODE_COLUMNS[mode])


def domain_violations(df: DataFrame, domains: dict, keys=("doc_id",)) -> DataFrame:
    """P10: rows whose value lies outside its allowed list: (keys..., field, value)."""
    found = F.array(*[F.struct((F.col(c).isNull() | ~F.col(c).isin(*allowed)).alias("bad"), F.lit(c).alias("field"),
                               F.col(c).cast("string").alias("value")) for c, allowed in domains.items()])
    bad = df.select(*keys, F.explode(F.filter(found, lambda x: x["bad"])).alias("_v"))  # one pass for all fields
    return bad.select(*keys, "_v.field", "_v.value")
