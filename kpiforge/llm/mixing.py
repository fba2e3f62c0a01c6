"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source replays its documents in one shuffled order for up to ``epochs`` rounds.
A replayed document's virtual finish time is the source's words up to and with it,
divided by the source's weight. All replays, sorted by that time and cut at the total
budget, are the mix: a source that runs dry leaves the queue, and the others share what
is left by weight, so the targets are the water level ``least(epochs * size, level * weight)``.

No row carries a text through a shuffle. Prefix sums are taken in two steps (buckets of
about ``bucket_rows`` rows, then inside a bucket), so a source that holds a third of the
rows is spread like any other. What a source contributes is a prefix of its shuffled
order; hence one cutoff per source decides every document in a map over the table.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last;
rows equal in id and text are taken together; empty documents are taken with their
neighbours and cost nothing; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, staged

BUCKET_ROWS = 2_000
SPLITS = 1_024


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """(source, source_size, n) -> with place, weight, level and target; one row per source.

    ``weights`` repeat over the sources in code point order, null last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    d = (sizes.withColumn("place", F.row_number().over(order))
         .withColumn("weight", F.element_at(cycle, (F.col("place") - 1) % len(weights) + 1))
         .withColumn("most", F.col("source_size") * F.lit(float(epochs)))
         .withColumn("full_at", F.col("most") / F.col("weight"))
         .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share))))
    by_full = Window.orderBy("full_at", "place")
    d = (d.withColumn("used", F.coalesce(F.sum("most").over(by_full.rowsBetween(Window.unboundedPreceding, -1)),
                                         F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(by_full.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("try", (F.col("budget") - F.col("used")) / F.col("left"))
         .withColumn("level", F.max(F.when(F.col("try") <= F.col("full_at"), F.col("try"))).over(everything)))
    return (d.withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")))
            .select("source", "place", "weight", "n", "source_size", "budget", "level", "target"))


def _order_key(seed: int) -> list[Column]:
    """The shuffled order inside a source: a hash of the row, then the id, then the text's hash."""
    return [F.xxhash64(F.lit(seed), F.col("id"), F.col("text_hash")).alias("h"), F.col("id"), F.col("text_hash")]


def cutoffs(rows: DataFrame, weights: Sequence[float], share: float = 1.5, epochs: int = 2, seed: int = 7,
            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per source its target and the last replay that the mix takes.

    ``rows``: (source, id, text_hash, size), read several times; stage it first.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = staged(source_targets(sizes, weights, share, epochs), "mix-targets")
    small = broadcast_if_small(targets)
    by_source = lambda a, b: a.join(b, F.col("source").eqNullSafe(F.col("t_source")), "inner")
    renamed = small.withColumnRenamed("source", "t_source")

    # two-step prefix sums in the shuffled order of each source
    key = _order_key(seed)
    part = F.floor((F.shiftright("h", 11) / F.lit(float(2 ** 53)) + 0.5) * F.ceil(F.col("n") / bucket_rows))
    d = (by_source(rows.withColumn("h", key[0]), renamed).drop("t_source")
         .withColumn("part", part.cast("long")))
    sums = (d.groupBy("place", "part").agg(F.sum("size").alias("part_size"))
            .withColumn("before", F.sum("part_size").over(Window.partitionBy("place").orderBy("part"))
                        - F.col("part_size"))
            .select(F.col("place").alias("s_place"), F.col("part").alias("s_part"), "before"))
    sums = broadcast_if_small(staged(sums, "mix-parts"))
    inside = (Window.partitionBy("place", "part").orderBy("h", "id", "text_hash")
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    d = (d.join(sums, (F.col("place") == F.col("s_place")) & (F.col("part") == F.col("s_part")))
         .withColumn("upto", F.col("before") + F.sum("size").over(inside)))
    replays = staged(
        d.select("place", "weight", "source_size", "budget", "h", "id", "text_hash", "size", "upto",
                 F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
        .withColumn("finish", (F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("weight"))
        .select("place", "epoch", "h", "id", "text_hash", "size", "finish", "budget"), "mix-replays")

    last = _last_replay(replays, bucket_rows)
    taken = replays if last is None else replays.where(
        F.struct("finish", "place", "epoch", "h", "id", "text_hash") <= last)
    ends = (taken.groupBy("place").agg(F.max(F.struct("epoch", "h", "id", "text_hash")).alias("end"))
            .withColumnRenamed("place", "e_place"))
    return staged(targets.join(ends, F.col("place") == F.col("e_place"), "left").drop("e_place"), "mix-cutoffs")


def _last_replay(replays: DataFrame, bucket_rows: int) -> Column | None:
    """The global range sort's last replay inside the budget, found without a global sort.

    Sums over ranges of the finish time name the range in which the budget ends; that
    range is split again, until few enough rows are left to be sorted. Replays equal in
    everything count as one. ``None``: the budget takes everything.
    """
    d = replays.where("size > 0")
    top = d.agg(F.max("finish"), F.max("budget"), F.count("*")).first()
    if not top[2]:
        return None
    low, high, room, n = 0.0, float(top[0]), float(top[1]), top[2]
    here = d
    while n > bucket_rows and high > low:
        step = (high - low) / SPLITS
        slot = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(step)), F.lit(SPLITS - 1))
        sums = (here.groupBy(slot.alias("slot"))
                .agg(F.sum("size").alias("words"), F.count("*").alias("n"),
                     F.min("finish").alias("low"), F.max("finish").alias("high")).orderBy("slot").collect())
        found = None
        for r in sums:  # at most SPLITS rows
            if r["words"] > room:
                found = r
                break
            room -= r["words"]
        if found is None:
            return None
        low, high = found["low"], found["high"]
        if found["n"] == n:
            break
        n = found["n"]
        here = d.where(F.col("finish").between(low, high))
    order = Window.orderBy("finish", "place", "epoch", "h", "id", "text_hash").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    key = F.struct("finish", "place", "epoch", "h", "id", "text_hash")
    rest = here.select(key.alias("key"), F.sum("size").over(order).alias("upto"))
    inside = rest.where(F.col("upto") <= F.lit(room)).agg(F.max("key").alias("key")).first()["key"]
    if inside is None:  # nothing of this range fits: everything before it does
        return F.struct(F.lit(low).alias("finish"), F.lit(0).alias("place"), F.lit(0).alias("epoch"),
                        F.lit(None).cast("long").alias("h"), F.lit(None).cast(replays.schema["id"].dataType).alias("id"),
                        F.lit(None).cast("long").alias("text_hash"))
    if rest.where(F.col("upto") > F.lit(room)).limit(1).count() == 0 and here is d:
        return None
    return F.struct(*(F.lit(inside[c]).cast(replays.schema[c].dataType).alias(c) for c in
                      ("finish", "place", "epoch", "h", "id", "text_hash")))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every input row as ``row`` with size, source_size, weight, target, copies and taken.

    ``copies`` is how often the mix takes the row (0 to ``epochs``), ``taken`` its words
    in the mix. ``replayed`` turns this into the mixed rows.
    """
    from kpiforge.llm.common import packed

    rows = packed(docs, source=F.col(source_col), id=F.col(id_col), text_hash=F.xxhash64(F.col(text_col)),
                  size=word_count(F.col(text_col)))
    narrow = staged(rows.drop("row"), "mix-rows")
    return _applied(rows, narrow, weights, share, epochs, seed, bucket_rows)


def mix_sizes(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2,
              seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``mix`` without the texts: id, size, source_size, target, copies, taken per row.

    ``rows``: (source, id, text_hash, size), staged.
    """
    return _applied(rows, rows, weights, share, epochs, seed, bucket_rows).select(
        "id", "source", "size", "source_size", "weight", "target", "copies", "taken")


def _applied(rows, narrow, weights, share, epochs, seed, bucket_rows) -> DataFrame:
    ends = broadcast_if_small(cutoffs(narrow, weights, share, epochs, seed, bucket_rows)).withColumnRenamed(
        "source", "t_source").select("t_source", "source_size", "weight", "target", "end")
    h, i, t = _order_key(seed)
    copies = sum((F.when(F.struct(F.lit(e).alias("epoch"), h, i, t) <= F.col("end"), 1).otherwise(0)
                  for e in range(epochs)), F.lit(0))
    return (rows.join(ends, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
            .withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("end"))


def replayed(mixed: DataFrame) -> DataFrame:
    """The mix itself: each input row as often as it is taken, with the input's columns."""
    return (mixed.where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))
