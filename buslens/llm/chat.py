"""Chat formatting: every participant's view of a dialogue.

For each participant of a conversation the dialogue is rendered anew: the
participant speaks as the assistant, everybody else as a named user, and what
comes from no speaker (system turns) stays. The loss mask covers what the
participant said and nothing else.

A rendered dialogue is returned as its segments, one row per view and turn with
the character positions in the whole text, so no conversation is gathered into
one cell or task: joining the segments of a view in order gives its text. The
positions are running sums over sorted slices of balanced size, however many
turns one conversation holds.

Defined results: turns without conversation id form one conversation of that
null id; a null role is the unnamed participant ``unknown``; a null text is
empty; a null turn comes first. Turns with the same number are ordered by role
and text, and repeated rows stay, one segment each. A conversation of system
turns alone has no participant and no rows. Columns besides the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buslens.llm.tasks import quoted
from buslens.scale import lookup_join, materialise, sorted_slices

# Fixed values of the rendering.
SYSTEM, UNKNOWN = "system", "unknown"
OPEN, NAME, BODY, CLOSE = "<|im_start|>", " name=", "\n", "<|im_end|>\n"
VIEW = ["conv_id", "speaker"]
COLUMNS = ["conv_id", "speaker", "turn", "position", "chat_role", "name", "segment", "start", "mask_start", "mask_end", "in_loss"]


def _segment(own: Column) -> tuple[Column, Column, Column]:
    """Role, name and header of a turn in a view."""
    system = F.col("role") == SYSTEM
    role = F.when(system, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~system & ~own, F.col("role"))
    header = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(NAME), name), F.lit("")), F.lit(BODY))
    return role, name, header


def perspectives(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Segments of every participant's view of every conversation; see ``COLUMNS``.

    ``start`` is the position of the segment in the rendered text of its view,
    ``mask_start`` and ``mask_end`` bound its text and closing mark where it
    counts for the loss and are null elsewhere.
    """
    rows = turns.select(
        F.col(quoted(conversation)).alias("conv_id"), F.col(quoted(turn)).alias("turn"),
        F.coalesce(F.col(quoted(role)), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
    )
    # One row per conversation and speaker, combined before the shuffle.
    speakers = rows.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    views = rows.join(speakers.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    chat_role, name, header = _segment(F.col("role") == F.col("speaker"))
    size = F.length(header) + F.length("text") + F.lit(len(CLOSE))
    sized = views.withColumn("_size", size.cast("long"))
    slices = sorted_slices(sized, VIEW, ["turn", "role", "text"])
    inside = Window.partitionBy("_slice", *VIEW).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    heads = slices.groupBy("_slice", *VIEW).agg(F.sum("_size").alias("_sizes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*VIEW).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    offsets = heads.select(
        "_slice", *VIEW, F.coalesce(F.sum("_sizes").over(earlier), none).alias("_start"),
        F.coalesce(F.sum("_rows").over(earlier), none).alias("_before"),
    ).where(F.col("_before") > 0)  # only views that cross a border
    placed = slices.withColumns({
        "_sum": F.coalesce(F.sum("_size").over(inside), none),
        "_nth": F.count(F.lit(1)).over(inside),
    })
    placed = lookup_join(placed, materialise(offsets, "views"), ["_slice", *VIEW], "left", null_safe=True)
    start = F.col("_sum") + F.coalesce("_start", none)
    own = F.col("role") == F.col("speaker")
    body = start + F.length(header)
    return placed.select(
        "conv_id", "speaker", "turn",
        (F.col("_nth") + F.coalesce("_before", none)).cast("long").alias("position"),
        chat_role.alias("chat_role"), name.alias("name"),
        F.concat(header, F.col("text"), F.lit(CLOSE)).alias("segment"),
        start.alias("start"),
        F.when(own, body).alias("mask_start"),
        F.when(own, body + F.length("text") + F.lit(len(CLOSE))).alias("mask_end"),
        own.alias("in_loss"),
    )
