"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

A source's documents, shuffled by a hash, are laid end to end in a circle of words. There are as many slots as blocks of BLOCK
words make up all targets. Slot k's point, the fractional part of k times the golden ratio, falls into one source's share of the
cumulative targets. Slots are ranked per source, and rank r takes the r-th block of the source's circle. So a source
gets as many blocks as points fall to it, which is within a few of its target, whatever the number of slots; only what would go beyond
`most` rounds of a circle is left. Ranks and running sums are made in two steps, within parts of bounded size and over the parts'
sums, so that a source with a third of all rows is not one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, scratch, written

#: Words of a block.
BLOCK = 32
GOLDEN = 0.6180339887498949
#: Rows of a part of a source.
PART = 4096
WEIGHTS = (5, 2, 1)
#: How often a source's words may be taken.
MOST = 3


def sized(text: str):
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(seed: int):
    """The number by which rows are shuffled; equal rows have equal ones."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def sizes(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size in words and order of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), sized("text").alias("size"), shuffled(seed).alias("order"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """s (0, 1, ... by source's code points, null last), source, source_size, n_docs, weight, target. A row for each source.

    A target is the source's weighted share of all words, but at most `most` times the source's words; what that leaves
    goes to the others by weight. All sources with a cap below the level come first in order of cap / weight.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("s", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("s") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    still = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    by = by.withColumn("level", left / still)  # the level if this source and all after it are below their caps
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "s", "level"))).over(all_)["level"]
    return by.withColumn("target", F.least("cap", level * F.col("weight"))).select("s", "source", "source_size", "n_docs", "weight", "target")


def _part(order, n):
    """Which of the parts of about PART rows, a power of two of them, a row of a source with n rows belongs to."""
    return F.shiftrightunsigned(order, 24) % F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n / PART, F.lit(1.0))))).cast("long")


def laid_out(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Each row of sizes() with s, start (words of its source before it) and row, a number unique within s and part."""
    rows = sized.join(goals.select("s", F.col("source").alias("own"), "n_docs"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    rows = rows.withColumn("part", _part(F.col("order"), F.col("n_docs")))
    in_part = Window.partitionBy("s", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("s", "part").agg(F.sum("size").alias("part_size"))
    before = sums.withColumn("before", F.coalesce(F.sum("part_size").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("part_size")
    within = rows.withColumn("row", F.row_number().over(in_part)).withColumn("within", F.sum("size").over(in_part) - F.col("size"))
    return within.join(before, ["s", "part"]).select("doc_id", "source", "size", "s", "part", "order", "row", (F.col("before") + F.col("within")).alias("start"))


def schedule(goals: DataFrame, block: int = BLOCK, step: float = GOLDEN) -> DataFrame:
    """slot, s, part: which source's block comes next. Point k is the fractional part of k times `step`."""
    spark = goals.sparkSession
    fact = goals.where("target > 0")
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    fact = fact.select("s", (F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy())).alias("high"))
    last = F.lead("s").over(Window.orderBy("s")).isNull()
    fact = fact.withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("s"))).withColumn("high", F.when(last, 1.0).otherwise(F.col("high")))
    words, sources = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    total = round(words / block)
    cells = 1024 + 4 * sources  # shares are found by cell, so that neither side needs to be small
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART + 1))
    far = (step * (1 << 20)) % 1  # in two steps, so that large numbers keep their digits
    points = spark.range(0, total, 1, n).select(F.col("id").alias("slot"), F.pmod(F.expr(f"id div {1 << 20}") * far + F.col("id") % (1 << 20) * step, F.lit(1.0)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    shares = fact.select("s", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell"))
    return points.join(shares, "cell").where("point >= low and point < high").select("slot", "s", F.expr(f"slot div {PART}").alias("part"))


def ranked(slots: DataFrame) -> DataFrame:
    """slot, s, rank: the place of each slot among its source's."""
    counts = slots.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("s", "part", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("s", "part").orderBy("slot"))
    return slots.withColumn("within", within).join(before, ["s", "part"]).select("slot", "s", (F.col("before") + F.col("within") - 1).alias("rank"))


def quotas(goals: DataFrame, slots: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Adds words, what a source's slots take, and epochs and rest: whole rounds of its words, and how many more."""
    got = slots.groupBy("s").agg(F.count(F.lit(1)).alias("slots"))
    words = F.least(F.coalesce("slots", F.lit(0)) * block, F.col("source_size") * most)
    out = goals.join(got, "s", "left").withColumn("words", words).drop("slots")
    size = F.greatest(F.col("source_size"), F.lit(1))
    return out.withColumn("epochs", F.floor(F.col("words") / size).cast("long")).withColumn("rest", F.col("words") % size)


def _held(epoch, column: str = "size"):
    """How many of a row's words are taken in a round of its source: all, those before the place where the last round ends, or none."""
    rest = F.least(F.col(column), F.greatest(F.col("rest") - F.col("start"), F.lit(0)))
    return F.when(epoch < F.col("epochs"), F.col(column)).when(epoch == F.col("epochs"), rest).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK, seed: int = 1, step: float = GOLDEN) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, n_slots of every row.

    taken: the words that the row's blocks take, repeats counted; first_slot: the first slot whose block has some of its words,
    null if none has; n_slots: how many have. Null texts and texts without words have size 0 and are never taken; a source of such
    only has target 0. Rows with equal doc_id, source and text may change places; each is a row of its own. Empty tables give
    empty results.
    """
    root = scratch(docs.sparkSession, "mixing")
    sized = written(sizes(docs, seed), f"{root}/sizes")
    goals = written(targets(sized, weights), f"{root}/targets")
    slots = written(schedule(goals, block, step), f"{root}/slots")
    per = written(quotas(goals, slots, block), f"{root}/quotas").select("s", "source_size", "target", "epochs", "rest")  # a row for each source
    rows = laid_out(sized, goals).join(per, "s")
    rounds = F.sequence(F.lit(0), F.least(F.col("epochs"), F.lit(MOST)))
    begins = lambda e: e * F.col("source_size") + F.col("start")
    some = lambda e: _held(e) > 0
    taken = F.aggregate(rounds, F.lit(0).cast("long"), lambda a, e: a + _held(e))
    touched = lambda e: F.floor((begins(e) + _held(e) - 1) / block) - F.floor(begins(e) / block) + 1
    n_slots = F.aggregate(F.filter(rounds, some), F.lit(0).cast("long"), lambda a, e: a + touched(e))
    # the last block of one round may be the first of the next
    n_slots = n_slots - F.size(F.filter(rounds, lambda e: (e > 0) & some(e) & (F.floor(begins(e) / block) == F.floor((begins(e - 1) + F.col("size") - 1) / block))))
    rows = rows.withColumns({"taken": taken, "n_slots": n_slots.cast("long")})
    rows = rows.withColumn("rank", F.when(F.col("taken") > 0, F.floor(F.col("start") / block)))
    first = ranked(slots).withColumnRenamed("slot", "first_slot")
    return rows.join(first, ["s", "rank"], "left").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_slots of every row; see mix()."""
    return mix(docs, weights).drop("source")


def repeated_documents(docs: DataFrame, weights: tuple = WEIGHTS, seed: int = 1, block: int = BLOCK, step: float = GOLDEN) -> DataFrame:
    """The rows of docs as often as the mix begins to take them, three times at most.

    The schedule says how many blocks of a source are taken. So all of its rows are taken equally often, and those up to one place in their
    shuffled order once more. The place is kept per source, and a row tells by its own number whether it stands before it: no
    text is shuffled. Rows without words are never taken. Rows that are equal in doc_id, source and text stand at one place
    and are taken alike.
    """
    root = scratch(docs.sparkSession, "mixing")
    sized = written(sizes(docs, seed), f"{root}/sizes")
    goals = written(targets(sized, weights), f"{root}/targets")
    quota = written(quotas(goals, schedule(goals, block, step), block), f"{root}/quotas").where("source_size > 0")
    ends = laid_out(sized, goals).join(quota.select("s", "rest"), "s").where("start < rest and size > 0").groupBy("s").agg(F.max(F.struct("part", "order")).alias("end"))
    per = written(quota.join(ends, "s", "left").select(F.col("source").alias("__source"), F.col("n_docs").alias("__n"), F.col("epochs").alias("__epochs"), F.col("end").alias("__end")), f"{root}/sources")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col("source").cast("string").alias("__own"), shuffled(seed).alias("__order"), F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)).alias("__some"))
    own = own.where("__some").join(per, F.col("__own").eqNullSafe(F.col("__source")))
    place = F.struct(_part(F.col("__order"), F.col("__n")).alias("part"), F.col("__order").alias("order"))
    times = F.col("__epochs") + F.when(F.col("__end").isNotNull() & (place <= F.col("__end")), 1).otherwise(0)
    taken = own.withColumn("__times", times).where("__times > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__copy")).select("__row.*")
