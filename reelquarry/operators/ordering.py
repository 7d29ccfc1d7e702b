"""Order within and between groups: ordinals, running offsets, carries, elections, contiguous runs, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordinals(rows: DataFrame, keys: list[str], order: str, name: str = "ordinal") -> DataFrame:
    """A number from 0 in each group."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def running_offsets(rows: DataFrame, keys: list[str], order: str, length: str, name: str = "log_start") -> DataFrame:
    """Where each row starts if those before it lie end to end."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(length).over(before), F.lit(0)))


def carried(rows: DataFrame, keys: list[str], order: str, value: Column, name: str = "carry") -> DataFrame:
    """The value of the row before, 0 at a group's start."""
    return rows.withColumn(name, F.lag(value, 1, 0).over(Window.partitionBy(*keys).orderBy(order)))


def elect(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each group (of all, without keys) in an order; one partial aggregation."""
    fields = [f"o{k}" for k in range(len(order))]
    ranked = candidates.select("*", *[c.alias(f) for c, f in zip(order, fields, strict=True)])
    first = ranked.groupBy(*keys).agg(F.min_by(F.struct(*candidates.columns), F.struct(*fields)).alias("row"))
    return first.select("row.*")


def contiguous(rows: DataFrame, keys: list[str], index: str, order: str) -> DataFrame:
    """Rows with a `status`: kept if their index continues the run from 0, duplicate if it came before, else stranded."""
    same = Window.partitionBy(*keys, index).orderBy(order)
    numbered = rows.withColumn("copy", F.row_number().over(same))
    in_order = Window.partitionBy(*keys).orderBy(index, order)
    rank = F.sum(F.when(F.col("copy") == 1, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    status = F.when(F.col("copy") > 1, "duplicate").when(F.col(index) == rank, "kept").otherwise("stranded")
    return numbered.withColumn("status", status).drop("copy")


def missing_indices(placed: DataFrame, keys: list[str], index: str, total: str) -> DataFrame:
    """(keys, cause, missing) as the ordering of contiguous() reports them.

    The next index that is wanted never passes a gap. So each stranded row reports every index from there up to its own,
    and the end reports every index from there to the declared total, present or not.
    """
    runs = placed.groupBy(*keys).agg(F.count_if(F.col("status") == "kept").cast("long").alias("next"), F.max(total).cast("long").alias("total"))
    stranded = placed.filter("status = 'stranded'").select(*keys, F.col(index).cast("long").alias("upto")).join(runs, keys)
    between = stranded.select(*keys, F.col("upto").alias("cause"), F.explode(F.sequence("next", F.col("upto") - 1)).alias("missing"))
    end = runs.filter("next < total").select(*keys, F.lit(-1).cast("long").alias("cause"), F.explode(F.sequence("next", F.col("total") - 1)).alias("missing"))
    return between.union(end)


def adjacent_pairs(rows: DataFrame, keys: list[str], position: str, geometry: str) -> DataFrame:
    """(keys, left, right) of neighbours with equal geometry, paired from the left: each row is in one pair at most.

    Equality is transitive, so neighbours of equal geometry form chains, and the greedy pass over a chain takes its first
    with its second, its third with its fourth.
    """
    own = Window.partitionBy(*keys).orderBy(position)
    linked = (F.lag(position).over(own).eqNullSafe(F.col(position) - 1)) & (F.lag(geometry).over(own).eqNullSafe(F.col(geometry)))
    chains = rows.withColumn("chain", F.sum(F.when(linked, 0).otherwise(1)).over(own))
    chain = Window.partitionBy(*keys, "chain").orderBy(position)
    placed = chains.withColumn("place", F.row_number().over(chain)).withColumn("next", F.lead(position).over(chain))
    return placed.filter("place % 2 = 1 AND next IS NOT NULL").select(*keys, F.col(position).alias("left"), F.col("next").alias("right"))
