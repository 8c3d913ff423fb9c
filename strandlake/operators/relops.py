"""Relational helpers that the engine's operators are built of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import kept


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins of ``width`` that [start, end) touches."""
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside [start, end): an equi-join on key and bin, then the exact test.

    A point has one bin, so no pair comes twice; an interval is repeated once a bin.  Choose ``width`` near
    the usual interval length.  Bins spread a long contig over many tasks.
    """
    p = points.withColumn("_bin", F.floor(F.col(point) / width))
    i = intervals.withColumn("_bin", F.explode(bins(F.col(start), F.col(end), width)))
    return p.join(i, [*keys, "_bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re_: str, width: int) -> DataFrame:
    """Pairs of overlapping intervals; each pair in the bin of its later start only."""
    a = left.withColumn("_bin", F.explode(bins(F.col(ls), F.col(le), width)))
    b = right.withColumn("_bin", F.explode(bins(F.col(rs), F.col(re_), width)))
    on = a.join(b, [*keys, "_bin"]).where((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)))
    return on.where(F.col("_bin") == F.floor(F.greatest(ls, rs) / width)).drop("_bin")


def band_self_join(rows: DataFrame, keys: list[str], pos: str, low: int, high: int, right_columns: dict[str, str]) -> DataFrame:
    """Ordered pairs with low <= right - left <= high; ``right_columns`` renames the right side's columns.

    Bins are ``high`` wide, so that a left row meets the rows of its own bin and the next one only.
    """
    left = rows.withColumn("_bin", F.explode(F.array(F.floor(F.col(pos) / high), F.floor(F.col(pos) / high) + 1)))
    right = rows.select(*keys, F.floor(F.col(pos) / high).alias("_bin"), *[F.col(c).alias(n) for c, n in right_columns.items()])
    gap = F.col(right_columns[pos]) - F.col(pos)
    return left.join(right, [*keys, "_bin"]).where((gap >= low) & (gap <= high)).drop("_bin")


def _blocked(rows: DataFrame, keys: list[str], weight: Column, block: Column) -> DataFrame:
    """``rows`` with ``_block`` and ``_before``, the weight of the blocks before theirs: only block sums are put in
    order over a whole key."""
    rows = rows.withColumn("_block", block.cast("long"))
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_block").agg(F.sum(weight).alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    return rows.join(sums, [*keys, "_block"])


def running_ranges(rows: DataFrame, keys: list[str], weight: str, order: list[str], block: Column | None = None) -> DataFrame:
    """``lo`` and ``hi``: the half-open range of running weight that each row owns, within its key.

    ``block`` must not decrease along ``order``: rows are then put in order within their block only, so that a
    long key spreads over many tasks.
    """
    held = rows if block is None else _blocked(rows, keys, F.col(weight), block)
    within = keys if block is None else [*keys, "_block"]
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.sum(weight).over(w) + (0 if block is None else F.col("_before"))
    return held.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col(weight)).select(*rows.columns, "hi", "lo")


def numbered(rows: DataFrame, keys: list[str], name: str, order: list, block: Column | None = None) -> DataFrame:
    """``rows`` with their number from 0 within their key; ``block`` as in ``running_ranges``."""
    held = rows if block is None else _blocked(rows, keys, F.lit(1), block)
    within = keys if block is None else [*keys, "_block"]
    number = F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long") - 1
    return held.withColumn(name, number + (0 if block is None else F.col("_before"))).select(*[c for c in rows.columns if c != name], name)


def cumulative_pick(draws: DataFrame, ranges: DataFrame, keys: list[str], draw: str, width: int) -> DataFrame:
    """The row whose [lo, hi) holds the draw: the first running weight above it."""
    return range_join(draws, ranges.where("hi > lo"), keys, draw, "lo", "hi", width)


def block_sums(rows: DataFrame, keys: list[str], block: str, weight: str) -> DataFrame:
    """(keys, block, sum, before, lo, hi): each block's weight, the rows before it and its range of running weight."""
    w = Window.partitionBy(*keys).orderBy(block)
    sums = rows.groupBy(*keys, block).agg(F.sum(weight).alias("sum"), F.count("*").alias("_n"))
    sums = sums.withColumn("before", F.sum("_n").over(w) - F.col("_n")).withColumn("hi", F.sum("sum").over(w))
    return sums.withColumn("lo", F.col("hi") - F.col("sum")).drop("_n")


def blocked_pick(draws: DataFrame, rows: DataFrame, blocks: DataFrame, keys: list[str], block: str, draw: str, weight: str, name: str, order: list, width: int) -> DataFrame:
    """``draws`` with the row whose running weight holds theirs, and its number ``name`` within its key.

    ``blocks`` are the rows' ``block_sums``; choose ``width`` near a block's usual weight.  A draw meets its block by the running weight of blocks; rows are put
    in order only within blocks that are drawn, so ``rows`` is gone through twice at most.
    """
    met = cumulative_pick(draws, blocks.select(*keys, block, "before", "lo", "hi"), keys, draw, width)
    met = met.withColumn("_rest", F.col(draw) - F.col("lo")).drop("lo", "hi")
    w = Window.partitionBy(*keys, block).orderBy(*order)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("_upto", upto).withColumn("_place", F.row_number().over(w).cast("long") - 1)
    found = ranked.join(met, [*keys, block]).where((F.col("_rest") < F.col("_upto")) & (F.col("_rest") >= F.col("_upto") - F.col(weight)))
    return found.withColumn(name, F.col("before") + F.col("_place")).drop("_upto", "_place", "_rest", "before", block)


def rank_select(draws: DataFrame, domain: DataFrame, keys: list[str], rank: str, order: list[str], block: Column | None = None) -> DataFrame:
    """The domain row of each drawn rank: numbers within the key, then an equi-join on key and rank."""
    return draws.join(numbered(domain, keys, rank, order, block), [*keys, rank])


def islands(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of overlapping or touching intervals of each key."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = rows.withColumn("_new", F.when(F.col(start) <= F.max(end).over(before), 0).otherwise(1))
    return opened.withColumn("_island", F.sum("_new").over(upto)).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


#: Blocks of remainders, within which contigs are put in order.
REMAINDERS = 4096


def _with_total(rows: DataFrame, total: Column) -> DataFrame:
    """``rows`` with an aggregate over all of them: one row, which is broadcast."""
    return rows.crossJoin(F.broadcast(rows.agg(total)))


def _seated(rows: DataFrame, total: int, weight: str, share: Column, order: str) -> DataFrame:
    """``rows`` with (_quota, _rest) get their seats: left-over ones go by remainder, ranked by blocks of it."""
    rows = _with_total(rows, (F.lit(total) - F.coalesce(F.sum("_quota"), F.lit(0))).alias("_left")).withColumn("_one", F.lit(0))
    block = F.lit(REMAINDERS - 1) - F.least(F.lit(REMAINDERS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * REMAINDERS))
    rows = numbered(rows, ["_one"], "_place", [F.desc(F.col(weight) > 0), F.desc("_rest"), order], block)
    extra = F.when((F.col(weight) > 0) & (F.col("_place") < F.col("_left")), 1).otherwise(0)
    return rows.withColumn("seats", (F.col("_quota") + extra).cast("long")).drop("_one", "_place", "_left", "_quota", "_rest")


def hamilton(rows: DataFrame, total: int, weight: str, order: str) -> DataFrame:
    """``seats``: ``total`` shared by integer ``weight``, left-over seats to the largest remainders, ties to
    the smaller ``order``; a zero weight gets none.  Sums are one row; ranks go by blocks of the remainder."""
    exact = F.col(weight).cast("decimal(20,0)")
    rows = _with_total(kept(rows), F.sum(exact).cast("decimal(20,0)").alias("_whole"))
    rows = rows.withColumn("_product", (exact * F.lit(total).cast("decimal(18,0)")).cast("decimal(38,0)"))
    rows = rows.withColumn("_rest", F.when(F.col("_whole") > 0, F.col("_product") % F.col("_whole")).otherwise(0).cast("decimal(38,0)"))
    rows = rows.withColumn("_quota", F.when(F.col("_whole") > 0, ((F.col("_product") - F.col("_rest")) / F.col("_whole")).cast("long")).otherwise(0))
    share = F.when(F.col("_whole") > 0, F.col("_rest").cast("double") / F.col("_whole").cast("double"))
    return _seated(rows, total, weight, share, order).drop("_whole", "_product")


def hamilton_real(rows: DataFrame, total: int, weight: str, order: str) -> DataFrame:
    """The same for real weights.  Shares count to nine digits, so that the order of a sum decides nothing."""
    rows = _with_total(kept(rows), F.sum(weight).alias("_whole"))
    rows = rows.withColumn("_share", F.when(F.col("_whole") > 0, F.col(weight) / F.when(F.col("_whole") > 0, F.col("_whole")) * total).otherwise(0.0))
    rows = rows.withColumn("_quota", F.floor(F.round("_share", 9))).withColumn("_rest", F.round(F.col("_share") - F.col("_quota"), 9))
    return _seated(rows, total, weight, F.greatest(F.col("_rest"), F.lit(0.0)), order).drop("_whole", "_share")


def before_each(rows: DataFrame, weight: str, order: str, name: str = "before") -> DataFrame:
    """``rows`` with the weight of all rows before theirs by the integer ``order``, put in order by blocks of it."""
    held = running_ranges(rows.withColumn("_one", F.lit(0)), ["_one"], weight, [order], F.floor(F.col(order) / REMAINDERS))
    return held.withColumnRenamed("lo", name).drop("_one", "hi")


def first_accepted(attempts: DataFrame, keys: list[str], attempt: str, accepted: str) -> DataFrame:
    """Of each key the accepted row of the smallest attempt; combines before it shuffles."""
    rest = [c for c in attempts.columns if c not in keys and c != accepted]
    best = attempts.where(accepted).groupBy(*keys).agg(F.min_by(F.struct(*rest), attempt).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def ordered_accept(candidates: DataFrame, keys: list[str], ordinal: str, need: str) -> DataFrame:
    """The first ``need`` accepted candidates of each key by ordinal, numbered; ``skipped`` counts the ordinals
    passed over before the last one."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    kept = candidates.withColumn("accept_rank", F.row_number().over(w).cast("long") - 1).where(F.col("accept_rank") < F.col(need))
    return kept.withColumn("skipped", F.col(ordinal) - F.col("accept_rank"))


def same_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    """Whether both hold the same set of keys: one aggregate over both, no difference of either from the other."""
    marked = left.select(*keys, F.lit(1).alias("_side")).unionByName(right.select(*keys, F.lit(2).alias("_side")))
    return marked.groupBy(*keys).agg(F.bit_or("_side").alias("_sides")).where("_sides <> 3").isEmpty()
