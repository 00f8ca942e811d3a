"""Sequential packing: a running sum that starts again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_in_order(blobs: DataFrame, limit: int) -> DataFrame:
    """Adds part_number to blobs (ordinal unique, size, is_metadata); see ``split_parts``.

    Each decision depends on the one before, so that one task streams over the sizes (three narrow columns, sorted
    externally, never held whole); all other columns are joined back by ordinal in parallel.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, filled = 1, 0
        for batch in batches:
            out = []
            for size, meta in zip(batch["size"].tolist(), batch["is_metadata"].tolist(), strict=True):
                if filled and filled + size >= limit and not meta:
                    part, filled = part + 1, 0
                filled += size
                out.append(part)
            yield pd.DataFrame({"ordinal": batch["ordinal"], "part_number": out})

    narrow = blobs.select(F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), "is_metadata")
    parts = narrow.repartition(1).sortWithinPartitions("ordinal").mapInPandas(fold, "ordinal long, part_number int")
    return blobs.join(parts, "ordinal")
