"""Feature streams: the same filters and measures on Structured Streaming frames. Nothing here keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geoframe.plans.layer import Layer


def filtered(stream: DataFrame, where=None, bbox=None, fields=None, geometry: str = "geometry") -> DataFrame:
    """Rows of a stream that pass a where text and a bbox. Limits and offsets have no meaning on a stream and aren't offered."""
    return Layer(stream, geometry=geometry).read_features(where=where, bbox=bbox, fields=fields)
