"""Multi-party perspective rotation of chats.

Every speaker of a conversation gets a rendering in which they are the assistant and the others
are users under their names; only the assistant's words are trained on. A rendering is given as
its segments, one per turn: text, place in the whole rendering, and the mask's span there, so
neither a conversation nor a rendering has to fit into a row. Joined in order, they are the whole.

Segments are ranged over the partitions by conversation, perspective and turn; places are running
lengths inside a partition plus the lengths that the conversation has in earlier partitions.

Defined cases: a null role is the speaker ``unknown``, a null text is empty; ``system`` turns are
shown to everybody and are nobody's perspective; turns with equal numbers go by the hash of role
and text, null turns first; repeated rows are repeated turns; a null conversation id is one
conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, staged

NOT_SPEAKERS = ("system",)
ASSISTANT, USER, SYSTEM, END = "<|assistant|>\n", "<|user name=%s|>\n", "<|%s|>\n", "<|end|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", not_speakers: tuple[str, ...] = NOT_SPEAKERS) -> DataFrame:
    """conv_id, perspective, turn, role, segment, start, mask_start, mask_end (code points, end exclusive).

    Only an assistant's segment has a mask: its text and the end mark.
    """
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    speakers = (said.where(~F.col("role").isin(*not_speakers)).groupBy("conv_id", "role").agg(F.count("*").alias("n"))
                .select(F.col("conv_id").alias("s_conv"), F.col("role").alias("perspective")))
    d = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("s_conv"))).drop("s_conv")
    own = F.col("role") == F.col("perspective")
    head = (F.when(own, F.lit(ASSISTANT)).when(F.col("role").isin(*not_speakers), F.format_string(SYSTEM, "role"))
            .otherwise(F.format_string(USER, "role")))
    d = d.select("conv_id", "perspective", "turn", "role", own.alias("own"), F.length(head).alias("head"),
                 F.concat(head, F.col("text"), F.lit(END)).alias("segment"),
                 F.md5(F.concat(F.col("role"), F.lit("\n"), F.col("text"))).alias("h"))
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = staged(d.withColumn("spread", F.monotonically_increasing_id())
               .repartitionByRange(n, "conv_id", "perspective", "turn", "h", "spread")
               .withColumn("part", F.spark_partition_id()), "chat-segments")
    whole = Window.partitionBy("conv_id", "perspective").orderBy("part")  # at most one row per partition
    before = (d.groupBy("conv_id", "perspective", "part").agg(F.sum(F.length("segment")).alias("length"))
              .withColumn("before", F.sum("length").over(whole) - F.col("length")).where("before > 0")
              .select(F.col("conv_id").alias("b_conv"), F.col("perspective").alias("b_perspective"),
                      F.col("part").alias("b_part"), "before"))
    before = broadcast_if_small(staged(before, "chat-before"))
    inside = Window.partitionBy("part", "conv_id", "perspective").orderBy("turn", "h", "spread").rowsBetween(
        Window.unboundedPreceding, -1)
    d = d.join(before, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_perspective"))
               & (F.col("part") == F.col("b_part")), "left")
    start = F.coalesce("before", F.lit(0)) + F.coalesce(F.sum(F.length("segment")).over(inside), F.lit(0))
    return (d.withColumn("start", start.cast("long"))
            .select("conv_id", "perspective", "turn", "role", "segment", "start",
                    F.when(F.col("own"), F.col("start") + F.col("head")).alias("mask_start"),
                    F.when(F.col("own"), F.col("start") + F.length("segment")).alias("mask_end")))
