"""Intake of uploaded probe images: admission, size ceiling, fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from mediamatch.operators.features import DEFAULT_PROCESSORS, Processor, fingerprint
from mediamatch.schema import Settings
from mediamatch.sources.images import admit_probes


def intake(probes: DataFrame, settings: Settings = Settings(), processors: Sequence[Processor] = DEFAULT_PROCESSORS) -> DataFrame:
    """Probe images with their features and `reject_reason`, ready for the search where this is null.

    `probes` holds file_size, mime_type, width, height, n_channels and data; its other columns stay. Images are shrunk
    to `settings.downscale_max`, then to the working size. Pixels of a refused probe never reach the feature code; an
    admitted one whose pixels cannot be read is `undecodable` too. Narrow: nothing is shuffled.
    """
    admitted = admit_probes(probes).withColumn("data", F.when(F.col("reject_reason").isNull(), F.col("data")))
    printed = fingerprint(admitted, processors, probe_edge=settings.downscale_max)
    unread = F.when(F.col("fingerprint").isNull(), "undecodable")
    reasoned = printed.withColumn("reject_reason", F.coalesce("reject_reason", unread))
    return reasoned.select("*", "fingerprint.*").drop("fingerprint")
