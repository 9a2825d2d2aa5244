"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

The mix has as many words as the corpus. Sources share it by weight; a source
may give at most CAP times its own size, and what it cannot give is shared
again by weight among the others until no target is above its cap.

A target of k whole sizes and a rest means k complete epochs of the source and
a sample for the rest: each document draws a uniform number from its id and
gets the key -ln(u) / w, exponential with its quality weight w as rate; the
documents are taken by ascending key until the rest is filled.

The keys of a source are cut into ranges of equal ratio, STEPS to a factor of
e. Whatever the weights, a range holds at most 1 / (e * STEPS) of an
exponential draw, so no source, however large, is sorted in one task: sizes
are summed for each range first and the ranges prefix-summed; only the one
range in which a source's rest ends has its rows sorted and summed. All other
rows stay where they are and are taken or not by their range. The boundary
document is taken if that brings the source nearer to its target, and no
document after it is, whether it was taken or not. So a source can miss its
target by half the size of its longest document, and not by more: where the
rest is 400,000 words and the first key has a text of a million, nothing is
taken of the rest.

Only DataFrame functions are used. Cases: a null or empty text has size 0 and
gets taken 0; a null source is a source of its own, last in order; equal
keys are ordered by id, size and text hash; a row without an id draws from its
text; a source of only empty texts has target 0; quality weights that are
null, not finite or below MIN_WEIGHT count as MIN_WEIGHT; an empty table gives
an empty mix. Internal columns carry the prefix ``_llm_``, so other input
columns cannot clash; ``mix`` refuses to keep columns named as its own results
(ValueError), and ``mixed`` carries any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, written

CAP = 3
WEIGHTS = (1, 2, 3)
STEPS = 256
MIN_WEIGHT = 0.05


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Default quality weight: the square of the share of letters, marks and
    digits among the characters that are not white space."""
    dense = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    marks = F.length(F.regexp_replace(text, r"[^#*$%&|<>!]+", ""))
    share = (dense - marks) / F.when(dense > 0, dense)
    return F.coalesce(share * share, F.lit(0.0))


def uniform(id_col: Column, text: Column) -> Column:
    """A number in (0, 1) drawn from the id alone, or from the text where there
    is no id."""
    own = F.concat(F.lit("#"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), own)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame) -> DataFrame:
    """(_llm_source, source_size, target) from one row for each source.

    Sharing again by weight until nothing is above its cap ends at
    target = min(cap, level * weight) for one common level. With the sources
    in order of cap / weight, the first k are capped, where k is the largest
    number for which the k-th stays below the level that k - 1 capped leave.
    """
    by_name = Window.orderBy(F.col("_llm_source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    known = sizes.withColumn("_llm_weight", F.element_at(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    known = known.withColumn("_llm_cap", CAP * F.col("source_size"))
    order = Window.orderBy(F.col("_llm_cap") / F.col("_llm_weight"), F.col("_llm_source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_llm_cap").over(before), F.lit(0))) / (
        F.sum("_llm_weight").over(everything) - F.coalesce(F.sum("_llm_weight").over(before), F.lit(0)))
    known = known.withColumn("_llm_level", level)
    known = known.withColumn("_llm_open", F.col("_llm_cap") >= F.col("_llm_level") * F.col("_llm_weight"))
    # the level of the first source that stays below its cap holds for all after it
    common = F.min(F.when(F.col("_llm_open"), F.struct(
        (F.col("_llm_cap") / F.col("_llm_weight")).alias("at"), F.col("_llm_level").alias("level")))).over(everything)
    return known.select("_llm_source", "source_size", F.coalesce(F.least(
        F.col("_llm_cap").cast("double"), common["level"] * F.col("_llm_weight")),
        F.col("_llm_cap").cast("double")).alias("target"))


def mix(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight: Column | None = None) -> DataFrame:
    """Columns ``keep`` of each row with size, source_size, target and taken
    (words the mix takes of it). ``weight``: quality weight of a row."""
    if clash := {"size", "source_size", "target", "taken"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would stand twice in the mix")
    weight = quality_weight(F.col(text_col)) if weight is None else weight
    weight = F.when(weight > MIN_WEIGHT, weight).otherwise(F.lit(MIN_WEIGHT))
    weight = F.when(F.isnan(weight) | (weight == float("inf")), F.lit(MIN_WEIGHT)).otherwise(weight)
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(source_col).alias("_llm_source"), F.col(id_col).alias("_llm_id"),
        size_of(F.col(text_col)).alias("size"), (-F.log(uniform(F.col(id_col), F.col(text_col))) / weight).alias("_llm_key"),
        F.xxhash64(text_col).alias("_llm_text"))
    rows = rows.withColumn("_llm_range", F.floor(F.log("_llm_key") * STEPS).cast("int"))
    rows = written(rows, "mix-rows")
    sums = Window.partitionBy("_llm_source").orderBy("_llm_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(rows.groupBy("_llm_source", "_llm_range").agg(F.sum("size").alias("_llm_sum")).withColumn(
        "_llm_before", F.coalesce(F.sum("_llm_sum").over(sums), F.lit(0))), "mix-ranges")
    goal = targets(ranges.groupBy("_llm_source").agg(F.sum("_llm_sum").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("_llm_epochs", epochs).withColumn(
        "_llm_rest", F.col("target") - F.col("_llm_epochs") * F.col("source_size")).withColumnRenamed("_llm_source", "_llm_s")
    # the one range of each source in which the rest ends; those before it are taken, those after it not
    cut = F.min(F.when((F.col("_llm_before") <= F.col("_llm_rest")) & (F.col("_llm_before") + F.col("_llm_sum") > F.col("_llm_rest")),
                       F.struct(F.col("_llm_range").alias("at"), F.col("_llm_before").alias("before"))))
    plan = ranges.join(goal, F.col("_llm_source").eqNullSafe(F.col("_llm_s"))).groupBy(
        "_llm_s", "source_size", "target", "_llm_epochs", "_llm_rest").agg(cut.alias("_llm_cut"))
    plan = written(plan, "mix-plan")
    rows = rows.join(plan, F.col("_llm_source").eqNullSafe(F.col("_llm_s")))
    whole = rows.where(F.col("_llm_cut").isNull() | (F.col("_llm_range") != F.col("_llm_cut.at"))).withColumn(
        "_llm_extra", F.coalesce((F.col("_llm_range") < F.col("_llm_cut.at")).cast("int"), F.lit(0)))
    inside = Window.partitionBy("_llm_source").orderBy("_llm_key", "_llm_id", "size", "_llm_text")
    so_far = F.col("_llm_cut.before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    parted = rows.where(F.col("_llm_range") == F.col("_llm_cut.at")).withColumn(
        "_llm_extra", (so_far + F.col("size") / 2 <= F.col("_llm_rest")).cast("int"))
    times = F.least(F.col("_llm_epochs") + F.col("_llm_extra"), F.lit(CAP))
    return whole.unionByName(parted).select(
        *[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weight: Column | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns."""
    columns = docs.columns
    out = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_llm_row"), "*"), ["_llm_row"], id_col,
              text_col, source_col, weight)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    return out.where("taken > 0").select("_llm_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_llm_copy")).select(
        *[F.col("_llm_row").getField(c).alias(c) for c in columns])
