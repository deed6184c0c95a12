"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.common import WORD, staged

#: Cells into which one level of the search for a source's cut divides its rank scale, and the levels.
CELLS, LEVELS = 1024, 2


def shares(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """source_size and target of each source (one row a source).

    sizes: source, source_size. Sources by code point, null last, get the weights in turn. The total is
    total_share of all sizes; a target above most * source_size stops there and its excess is dealt to the
    others by weight, until none is above. Targets are a water level times the weight: with the sources in
    order of most * source_size / weight, the k first stop, for the least k that leaves the level below the next.
    """
    # One row a source: the number of sources is a property of the mix, not of the rows.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    base = sizes.withColumn("weight", turn).withColumn("room", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = Window.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    goal = F.lit(float(total_share)) * F.sum("source_size").over(everything)
    level = F.try_divide(goal - F.coalesce(F.sum("room").over(before), F.lit(0.0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = base.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > F.col("room"))
    # The level of the first source that doesn't stop; those before it stop. Without one, all stop.
    first = F.min_by("level", F.when(~F.col("stops"), F.col("room") / F.col("weight"))).over(everything)
    return levels.select("source", "source_size", F.least(F.col("room"), F.coalesce(first * F.col("weight"), F.col("room"))).alias("target"))


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row (but maps, which have no hash)."""
    return F.xxhash64(*[docs[f"`{f.name}`"] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How many copies of each row the mix takes: doc_id, source, size, row_hash, source_size, target, copies, taken.

    size is the number of words (null text: 0). With r = target / source_size, every row gets floor(r)
    certain copies. For the rest f = r - floor(r), its inclusion probability is
    p = 1 - (1 - f) ** sqrt(size / mean size of its source), its random number u comes from a hash of seed,
    doc_id, row_hash and its number among equal rows, and rows rank by the odds of u divided by the odds of p.
    The sample has a fixed size in words: the first of this order are taken up to the rest of the target, the last one if
    more than half of it fits. So a source misses its target by half a document at most, whatever ids its rows share.

    Rows equal in all columns are numbered by their count, not by a window; each has its own u. Null doc_ids
    are told apart by their rows. Ties in rank go to the smaller doc_id, null first. A source of size 0 has target 0.
    Null sources form one source. Empty table: no rows. Other columns, of whatever name, only enter row_hash.

    No window spans a source: ranks are cut into cells, cell totals give the cell with the cut, and only
    its documents are cut again and at last sorted.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), words_of(docs["text"]).alias("size"), row_hash(docs).alias("row_hash"))
    classes = staged(keyed.groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("rows")), "mix-sizes")
    per_source = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n_docs"))
    sized = classes.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")
    goal = shares(per_source.select("source", "source_size"), weights, total_share, most)
    plan = goal.join(per_source.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("ratio", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    plan = plan.withColumn("whole", F.floor("ratio").cast("long")).withColumn("part", F.col("ratio") - F.col("whole"))
    # The level and the target come from sums of whole numbers, so a remainder of rounding is no part.
    plan = plan.withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")))
    plan = plan.withColumn("room", F.col("part") * F.col("source_size"))
    plan = staged(plan, "mix-plan").withColumnRenamed("source", "s")

    u = (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("row_hash").cast("string"), F.col("nth").cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    shown = sized.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    miss = F.pow(1 - F.col("part"), F.sqrt(F.try_divide(F.col("size") * F.col("n_docs"), F.col("source_size"))))
    odds = F.try_divide((u / (1 - u)), F.try_divide(1 - miss, miss))
    # q / (1 + q) keeps the order and lies in 0 to 1; documents without words never count.
    ranked = shown.withColumn("rank_key", F.when((F.col("size") > 0) & (F.col("part") > 0), odds / (1 + odds)))
    ranked = staged(ranked.select("doc_id", "source", "size", "row_hash", "source_size", "target", "whole", "room", "rank_key"), "mix-ranks")

    cut = staged(boundary(ranked), "mix-cut")
    out = ranked.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    inside = (F.col("rank_key") < F.col("last_key")) | ((F.col("rank_key") == F.col("last_key")) & F.coalesce(F.col("doc_id") <= F.col("last_id"), F.lit(True)))
    copies = F.col("whole") + F.coalesce(inside, F.lit(False)).cast("long")
    return out.select("doc_id", "source", "size", "row_hash", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def boundary(ranked: DataFrame) -> DataFrame:
    """The last document (last_key, last_id) that each source's sample takes."""
    keyed = ranked.filter("rank_key is not null").select("source", "doc_id", "size", "room", "rank_key")
    keyed = keyed.withColumn("low", F.lit(0.0)).withColumn("before", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        width = 1.0 / CELLS**level
        keyed = keyed.withColumn("cell", F.least(F.floor((F.col("rank_key") - F.col("low")) / width), F.lit(CELLS - 1)).cast("long"))
        cells = keyed.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.max("room").alias("room"), F.max("before").alias("base"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.withColumn("at", F.col("base") + F.coalesce(upto, F.lit(0)))
        # The cell in which the sample ends: the last that begins before the rest of the target is full.
        last = cells.filter(F.col("at") < F.col("room")).groupBy(F.col("source").alias("s")).agg(F.max(F.struct("cell", "at")).alias("end"))
        keyed = keyed.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("end.cell")))
        keyed = keyed.withColumn("low", F.col("low") + F.col("cell") * width).withColumn("before", F.col("end.at")).drop("s", "end", "cell")
    order = Window.partitionBy("source").orderBy("rank_key", F.col("doc_id").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = keyed.withColumn("upto", F.col("before") + F.sum("size").over(order))
    # A document is taken if more than half of it fits. The first in order is the last resort of an all-unfit cell.
    fits = running.filter(F.col("upto") - F.col("size") / 2 <= F.col("room"))
    ends = fits.groupBy("source").agg(F.max(F.struct("rank_key", "doc_id")).alias("last"))
    starts = keyed.groupBy(F.col("source").alias("s")).agg(F.max("low").alias("low"))
    both = starts.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return both.select(F.col("s").alias("source"), F.coalesce(F.col("last.rank_key"), F.col("low")).alias("last_key"), F.when(F.col("last").isNull(), F.lit(-(1 << 63))).otherwise(F.col("last.doc_id")).alias("last_id"))


def words_of(text: Column) -> Column:
    """A document's size: its number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. mixed: the result of mix(docs).

    Rows are found by doc_id (null too), source, size and row_hash. Rows equal in all columns can't be told apart: one of them is
    taken as often as all are. Texts of any length and null texts stay whole; other columns, of whatever name, are carried. Empty
    tables: no rows.
    """
    keys = ["doc_id", "source", "size", "row_hash"]
    free = lambda name: next(x for i in range(len(docs.columns) + 1) if (x := f"_mix_{name}_{i}").lower() not in {c.lower() for c in docs.columns})
    names = {k: free(k) for k in [*keys, "copies", "rows"]}
    planned = mixed.groupBy(*[F.col(k).alias(names[k]) for k in keys]).agg(F.sum("copies").alias(names["copies"]), F.count("*").alias(names["rows"])).filter(F.col(names["copies"]) > 0)
    mine = {"doc_id": docs["doc_id"].cast("long"), "source": docs["source"].cast("string"), "size": words_of(docs["text"]), "row_hash": row_hash(docs)}
    found = F.lit(True)
    for k in keys:
        found = found & mine[k].eqNullSafe(planned[names[k]])
    once = docs.join(planned.filter(F.col(names["rows"]) == 1), found)
    several = docs.join(planned.filter(F.col(names["rows"]) > 1), found).dropDuplicates([names[k] for k in keys])
    nth = free("nth")
    return once.unionAll(several).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), names["copies"]))).drop(nth, *names.values())
