"""Chat formatting by perspective rotation, in DataFrame functions only.

Every participant of a conversation (each role but ``system``) in turn is the assistant: the dialogue is rendered with
that speaker's turns as assistant turns, the others' as user turns under their names, and the masks mark the assistant's
words with the end mark that they must learn to give. A dialogue is one row, unless it is too long for one: a turn weighs its
characters and ``TURN`` more, and a part ends once ``PART`` is reached, so a part is bounded whatever the turn numbers
are. The dialogue is its parts' texts joined in order; ``start`` is where a part begins in it, and masks count from the
dialogue's start.

Conversations of one part are grouped at once. The longer ones are sorted by range first, over all tasks, so that neither a hot
conversation nor one of null ids or equal turn numbers is ever gathered: each range's weight in each conversation gives
the weight before it, and within a range the turns are counted on.

Defined cases: a null text is empty, a null role is the participant ``unknown``, a null turn comes first; a null
conv_id is a conversation of its own; turns of one number stand in the order of role and text; repeated rows are turns
each; a conversation of system turns only has no participant and yields no row; texts may hold the marks themselves, which
are left as they are. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

PART, TURN = 4_000_000, 1_000
START, END = "<|im_start|>", "<|im_end|>"


def parted(said: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with every perspective of their conversation and their part: of conversations of one part, and of longer ones."""
    weight = F.length("text") + F.lit(TURN)
    sizes = said.groupBy("conv").agg(F.sum(weight).alias("weight"))
    long = materialise(sizes.where(F.col("weight") > PART).select("conv"), "long")
    usual = said.join(long, "conv", "left_anti").join(people, "conv").withColumn("part", F.lit(0).cast("long"))
    # equal turns are dealt to several ranges, too
    order = ["turn", "role", "text"]
    ranged = said.join(long, "conv", "left_semi").withColumn("any", F.rand(7)).repartitionByRange("conv", *order, "any").drop("any")
    ranged = materialise(ranged.withColumn("range", F.spark_partition_id()), "ranged")
    stretches = ranged.groupBy("range", "conv").agg(F.sum(weight).alias("own"))
    earlier = F.coalesce(F.sum("own").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("range", "conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    views = stretches.select("range", "conv", earlier.alias("earlier")).join(people, "conv")
    cut = ranged.withColumn("inside", inside).join(views, ["range", "conv"])
    cut = cut.withColumn("part", F.floor((F.col("earlier") + F.col("inside")) / F.lit(PART)).cast("long"))
    return usual, cut


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, part, start, n_turns, text, masks (start-end pairs of characters, end exclusive), n_masked."""
    said = turns.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    people = said.where("role <> 'system'").select("conv", F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    head = (
        F.when(own, F.lit(f"{START}assistant\n"))
        .when(F.col("role") == "system", F.lit(f"{START}system\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), F.col("role"), F.lit("\n")))
    )
    line = F.concat(head, F.col("text"), F.lit(f"{END}\n"))
    keys = ["conv", "conv_id", "perspective", "part"]
    turn = F.struct("turn", "role", F.col("text").alias("said"), own.alias("own"), F.length(head).alias("from"), line.alias("line")).alias("s")

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, turn).groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("s"), F.sum(F.length("s.line")).alias("n_chars"))

    usual, cut = parted(said, people)
    long = materialise(gathered(cut), "parts")
    w = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = long.select("conv", "perspective", "part", F.coalesce(F.sum("n_chars").over(w), F.lit(0)).alias("start"))
    parts = gathered(usual).withColumn("start", F.lit(0).cast("long")).unionByName(long.join(starts, ["conv", "perspective", "part"]))
    nothing = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"))

    def add(acc, x):
        a, b = acc["at"] + x["from"], acc["at"] + F.length(x["line"]) - 1
        spans = F.when(x["own"], F.concat(acc["spans"], F.array(F.struct(a.alias("a"), b.alias("b"))))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(x["line"])).alias("at"), spans.alias("spans"))

    return parts.withColumn("_spans", F.aggregate("s", nothing, add)["spans"]).select(
        "conv_id",
        "perspective",
        "part",
        "start",
        F.size("s").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("s", lambda x: x["line"])).alias("text"),
        F.concat_ws(",", F.transform("_spans", lambda x: F.concat(x["a"], F.lit("-"), x["b"]))).alias("masks"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]).alias("n_masked"),
    )
