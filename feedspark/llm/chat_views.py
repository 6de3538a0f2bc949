"""Multi-party chat: the dialogue from every participant's point of view (native: DataFrame functions only).

For each participant all turns are rendered in order: the participant's own as assistant, the others' as named
users, system turns as they are. Only the participant's own words and their end marker are to be learned.
A rendered dialogue is returned as its segments with their places in the whole, so a conversation of any
length is spread over many rows and tasks: places are running sums over ranges, not one window per dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import running_sums

SYSTEM, END = "system", "<|end|>"


def chat_views(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """conv_id, perspective, position, role, name, segment, seg_start, seg_end, mask_start, mask_end.

    ``turns``: conv_id, turn, role, text; participants are the roles of a conversation but ``system``. Turns go by
    (turn, role, text), NULL turns first; repeated rows are repeated turns. A NULL role is the participant '',
    a NULL text is empty, NULL conv_ids are one conversation. Marker openings ``<|`` in texts become ``<\\|``.
    Places count code points from the start of the view; the mask is NULL for segments not to be learned. A
    conversation of system turns only has no view; an empty table gives no rows.
    """
    said = turns.select("conv_id", F.col("turn").alias("turn_no"), F.coalesce("role", F.lit("")).alias("speaker"),
                        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("content"))
    people = (said.filter(F.col("speaker") != system)
              .select(F.col("conv_id").alias("of_conv"), F.col("speaker").alias("perspective")).distinct())
    views = said.join(people, said["conv_id"].eqNullSafe(people["of_conv"])).drop("of_conv")
    role = (F.when(F.col("speaker") == system, F.lit("system"))
            .when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user")))
    named = views.withColumn("as_role", role).withColumn(
        "opening", F.concat(F.lit("<|"), "as_role", F.when(F.col("as_role") == "user", F.concat(F.lit(":"), "speaker"))
                            .otherwise(F.lit("")), F.lit("|>\n")))
    sized = named.withColumn("size", F.length("opening") + F.length("content") + len(END) + 1)
    placed = running_sums(sized, ["conv_id", "perspective"], ["turn_no", "speaker", "content"],
                          {"seg_start": F.col("size").cast("long"), "position": F.lit(1).cast("long")})
    own = F.col("as_role") == "assistant"
    learn = F.col("seg_start") + F.length("opening")
    return placed.select(
        "conv_id", "perspective", "position", F.col("as_role").alias("role"),
        F.when(F.col("as_role") == "user", F.col("speaker")).alias("name"),
        F.concat("opening", "content", F.lit(END + "\n")).alias("segment"),
        "seg_start", (F.col("seg_start") + F.col("size")).alias("seg_end"),
        F.when(own, learn).alias("mask_start"),
        F.when(own, learn + F.length("content") + len(END)).alias("mask_end"))
