"""Binwise frame sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorepool.constants import FRAME_BINS, FRAMES_MAX, FRAMES_PER_BIN
from scorepool.functions.text import held_once


def binwise(total: Column, bins: int = FRAME_BINS, per_bin: int = FRAMES_PER_BIN, most: int = FRAMES_MAX) -> Column:
    """Array of (frame, bin): even picks in each of up to `bins` equal bins of 0..total-1, first bin first, each frame once.

    A lone pick is the middle of its bin; more run from its first to its last frame, rounded half to even.
    """
    n = F.least(F.lit(bins), total)

    def picks(b: Column) -> Column:
        """Picks of a bin. They differ, as the picks of a bin are a frame apart at least and bins don't meet."""
        bound = F.struct(F.floor(b * total / n).cast("long").alias("start"), F.floor((b + 1) * total / n).cast("long").alias("end"))

        def spread(x: Column) -> Column:
            width = x["end"] - x["start"]
            count = F.least(F.lit(per_bin), width).cast("int")
            even = lambda k: x["start"] + F.bround((width - 1) * k / F.greatest(count - 1, F.lit(1)), 0).cast("long")
            pick = lambda k: F.struct(F.when(count == 1, x["start"] + F.floor(width / 2)).otherwise(even(k)).alias("frame"), b.alias("bin"))
            return F.transform(F.sequence(F.lit(0), count - 1), pick)

        return held_once(bound, spread)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(n).cast("int") - 1), picks))
    return F.when(total > 0, F.slice(every, 1, most)).otherwise(F.array().cast("array<struct<frame: bigint, bin: int>>"))


def per_total(rows: DataFrame, total: str, name: str, make: Callable[[Column], Column] = binwise) -> DataFrame:
    """rows with make(total), their picks or what follows from them, as column `name`.

    It depends on nothing but the total, so it is made once for each that occurs, spread over tasks by their shuffle, and joined
    to the rows. A null total counts as one of its own, and every row stays.
    """
    totals = rows.select(F.col(total).alias("_total")).distinct().select("_total", make(F.col("_total")).alias(name))
    return rows.join(totals, F.col(total).eqNullSafe(F.col("_total")), "left").drop("_total")


def accounting_issue(indices: Column, bin_ids: Column, most: int = FRAMES_MAX, bins: int = FRAME_BINS) -> Column:
    """Why a sample's frame indices are not sound; null if they are."""

    def issue(x: Column) -> Column:
        indices, bin_ids = x["indices"], x["bin_ids"]
        return F.coalesce(
            F.when(indices.isNull() | (F.size(indices) < 1) | (F.size(indices) > most), F.lit("frame_count")),
            F.when(F.array_sort(F.array_distinct(indices)) != indices, F.lit("not_increasing")),
            F.when(F.size(bin_ids) != F.size(indices), F.lit("bin_count")),
            F.when(~F.forall(bin_ids, lambda b: (b >= 0) & (b < bins)), F.lit("bin_range")),
        )

    return held_once(F.struct(indices.alias("indices"), bin_ids.alias("bin_ids")), issue)
