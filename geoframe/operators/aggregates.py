"""Aggregates over geometries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.kernel.arrangement import overlay
from geoframe.kernel.geometry import Geometry
from geoframe.types import GEOMETRY


def extent(g: str) -> Column:
    b = F.col(f"{g}.bbox")
    return F.struct(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))


def _union(rows: list) -> Geometry:
    while len(rows) > 1:
        rows = [overlay(*rows[k: k + 2], "union") if k + 1 < len(rows) else rows[k] for k in range(0, len(rows), 2)]
    return rows[0]


def union_aggregate(df: DataFrame, keys: list[str], g: str, fan: int = 64, rounds: int = 2) -> DataFrame:
    """The union of each group's geometries, in cascades: groups are dealt into slices first, so that a large group isn't one task's."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        rows = [Geometry.of(_plain(r)) for r in pdf[g] if r is not None]
        out[g] = [_union(rows).struct() if rows else None]
        return out

    level = df.select(*keys, g)
    for left in range(rounds, -1, -1):
        slice_ = F.pmod(F.xxhash64(f"{g}.bbox", *keys), F.lit(fan**left))
        dealt = level.select(*keys, g, slice_.alias("__s"))
        level = dealt.groupBy(*keys, "__s").applyInPandas(fold, f"{schema}, {g} {GEOMETRY}, __s long").select(*keys, g)
    return level


def _plain(v):
    if hasattr(v, "asDict"):
        return v.asDict(recursive=True)
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "tolist"):
        return [_plain(x) for x in v.tolist()]
    return [_plain(x) for x in v] if isinstance(v, list) else v
