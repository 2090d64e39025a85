"""Usage counts over arriving profiler records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from portlens.operators.events import normalize_events
from portlens.operators.usage import USAGE_KEYS, features
from portlens.sources.profile import scan_profile


def usage_stream(profile: DataFrame, lateness: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Usage per feature and place in tumbling windows of event time.

    Features are read from each record alone, so the only state is one row of
    counts per group and open window. Every record moves the watermark, also
    those without features.
    """
    events = normalize_events(scan_profile(profile.withWatermark("ts", lateness)))
    return (
        features(events)
        .groupBy(F.window("ts", every).alias("period"), *USAGE_KEYS)
        .agg(
            F.count(F.lit(1)).alias("usage_count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.max("duration_ms").alias("max_duration_ms"),
        )
    )
