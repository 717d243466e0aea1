"""Fitted transformations hold no state, so they apply to streams as they are; see ``score_stream``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(stream: DataFrame, *fitted) -> DataFrame:
    """A streaming DataFrame through the given fitted stages, in order."""
    for f in fitted:
        stream = f.transform(stream)
    return stream
