"""Exact medians and quantiles, global and per group (AG2), by repeated range counts.

Spark's exact ``median`` keeps every distinct value of a group in one buffer. Here groups of
at most ``FEW`` rows are sorted as they are. Of a larger group, each pass draws about
``SAMPLE`` values, takes two of them around each wanted place, and counts exactly how many
rows lie below, at, between and above them. A place is then known to be at one of these
values, or in a range between them that holds a few hundredths of the rows. Only the rows of
such ranges are stored for the next pass, until a range has ``FEW`` rows. The draw decides how
many rows a range holds, never the result: every row is counted. All counts aggregate on the
map side, so a group with a third of all rows is a few partial rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.staging import broadcast_if_small, staged

SAMPLE = 4_000
FEW = 10_000


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """One row per group and quantile: the group columns, ``q``, ``n`` and ``quantile``.

    Between two values the quantile is interpolated (``q * (n - 1)`` counts places from 0, so
    0.5 is the usual median). Null and NaN values are left out, as are rows with a null in a
    group column (Q12); a group without values has no row. No groups: one row per quantile.
    """
    keys = [f"k{i}" for i in range(len(groups))]
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)], F.lit(0).alias("one"), v.alias("v"))
    for c in [*keys, "v"]:
        rows = rows.where(F.col(c).isNotNull())
    rows = staged(rows.where(~F.isnan("v")), "quantile-values")
    keys = ["one", *keys]
    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FEW)
    large = staged(sizes.withColumn("part", F.monotonically_increasing_id()), "quantile-large")
    few = rows.join(broadcast_if_small(large.select(*keys)), keys, "left_anti")
    n = F.count("*").over(Window.partitionBy(*keys))
    few = few.select(*keys, n.alias("n"), (F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1).alias("place"), F.col("v").alias("x"))
    values = _asked(few.where(F.exists(wanted, lambda q: _at_place(F.col("place"), q * (F.col("n") - 1)))), wanted)
    values = values.where(_at_place(F.col("place"), F.col("at"))).select(*keys, "n", "q", "at", "place", "x")
    if not large.isEmpty():
        places = staged(_asked(large, wanted).withColumn("place", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))), "quantile-places")
        inside = rows.join(broadcast_if_small(large.select(*keys, "part")), keys).select(F.col("part").alias("range"), "v")
        met = places.join(_values_at(staged(inside, "quantile-rows"), places, 4 * len(quantiles)), ["part", "place"])
        values = values.unionByName(met.select(*keys, "n", "q", "at", "place", "x"))
    met = values.groupBy(*keys, "q", "n").agg(
        F.min(F.struct("place", "x")).alias("a"), F.max(F.struct("place", "x")).alias("b"), F.first("at").alias("at"))
    return met.select(*[F.col(k).alias(g) for k, g in zip(keys[1:], groups)], "q", "n",
                      F.when(F.col("a.x") == F.col("b.x"), F.col("a.x")).otherwise(  # infinities aren't interpolated among themselves
                          F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("at") - F.col("a.place"))).alias("quantile"))


def _asked(df: DataFrame, wanted: Column) -> DataFrame:
    """A row per quantile; ``at``: its place, counted from 0, maybe between two."""
    return df.withColumn("q", F.explode(wanted)).withColumn("at", F.col("q") * (F.col("n") - 1))


def _at_place(place: Column, at: Column) -> Column:
    return (place == F.floor(at)) | (place == F.ceil(at))


def _values_at(rows: DataFrame, places: DataFrame, bounds: int) -> DataFrame:
    """(part, place, x): the value at each place of each large group. ``bounds``: the most that a pass counts by in a range."""
    # open: the place lies in a range of ``inside`` rows, behind ``before`` rows of its group; rows: (range, v) of all open ranges
    open_ = places.select("part", F.col("part").alias("range"), "place", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")).distinct()
    open_, found, turn = staged(open_, "quantile-open"), [], 0
    while not open_.isEmpty():
        turn += 1
        near = staged(_bounds(rows, open_, turn), "quantile-near")
        zone = sum((F.coalesce((F.col("v") > b).cast("int") + (F.col("v") >= b).cast("int"), F.lit(0))
                    for b in (F.get("bounds", F.lit(i)) for i in range(bounds))), F.lit(0))   # odd: at a bound
        zoned = rows.join(broadcast_if_small(near), "range").select("range", "v", zone.alias("zone"))
        zones = staged(zoned.groupBy("range", "zone").agg(F.count("*").alias("n")), "quantile-zones")
        zones = zones.withColumn("end", F.sum("n").over(Window.partitionBy("range").orderBy("zone")))
        place = F.col("place") - F.col("before")
        hit = open_.join(zones, "range").where((place < F.col("end")) & (place >= F.col("end") - F.col("n"))).join(near, "range")
        hit = staged(hit.select("part", "place", "range", "zone", (F.col("before") + F.col("end") - F.col("n")).alias("before"), F.col("n").alias("inside"),
                                F.when(F.col("zone") % 2 == 1, F.get("bounds", F.floor(F.col("zone") / 2).cast("int"))).alias("x")), "quantile-hit")
        found.append(hit.where("x IS NOT NULL").select("part", "place", "x"))
        left = hit.where("x IS NULL")
        next_ = staged(left.select("range", "zone", "inside").distinct().withColumn("next", F.monotonically_increasing_id()), "quantile-next")
        kept = staged(zoned.join(broadcast_if_small(next_), ["range", "zone"]).select(F.col("next").alias("range"), "v", "inside"), "quantile-rows")
        left = staged(left.join(next_.drop("inside"), ["range", "zone"]).select("part", F.col("next").alias("range"), "place", "before", "inside"), "quantile-open")
        ranked = kept.where(F.col("inside") <= FEW).select("range", F.col("v").alias("x"), (
            F.row_number().over(Window.partitionBy("range").orderBy("v")) - 1).alias("seq"))
        few = left.join(ranked, "range").where(F.col("seq") == F.col("place") - F.col("before"))
        found.append(staged(few.select("part", "place", "x"), "quantile-found"))
        rows, open_ = kept.where(F.col("inside") > FEW).drop("inside"), left.where(F.col("inside") > FEW)
    return reduce(DataFrame.unionByName, found)


def _bounds(rows: DataFrame, open_: DataFrame, turn: int) -> DataFrame:
    """(range, bounds): values around the places of each range, ascending; null if none was drawn."""
    ranges = staged(open_.groupBy("range").agg(F.first("inside").alias("inside"), F.first("before").alias("before"), F.collect_set("place").alias("places")), "quantile-ranges")
    drawn = rows.join(broadcast_if_small(ranges.select("range", "inside")), "range").where(F.rand(turn) < F.lit(float(SAMPLE)) / F.col("inside"))
    drawn = drawn.groupBy("range").agg(F.sort_array(F.collect_list("v")).alias("s"))
    size, margin = F.size("s"), F.ceil(F.sqrt(F.size("s")) * 2)   # four standard deviations of a drawn value's place

    def around(place: Column) -> Column:
        i = F.floor((place - F.col("before") + 0.5) / F.col("inside") * size)
        return F.array(*[F.get("s", F.least(F.greatest(j, F.lit(0)), size - 1).cast("int")) for j in (i - margin, i + margin)])

    return ranges.join(drawn, "range", "left").select("range", F.array_sort(F.array_distinct(F.flatten(F.transform("places", around)))).alias("bounds"))
