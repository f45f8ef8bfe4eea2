"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Weights are shares of a period, PERIOD slots for every SOURCES_A_PERIOD sources or part of as many: source i gets p_i of
them. Its j-th block is released at
floor((j - 1) * period / p_i) and due at ceil(j * period / p_i). In every slot the released block of the earliest deadline
runs (ties: the source that comes first by name), which keeps every source less than one block away from its weight at
every slot. The schedule repeats after a period, so it is found once for one period and n sources, as one expression,
and any block's slot follows from its number.

A source's documents stand in the order of a hash of their ids and are cut into blocks of `block_rows`. When a source has
no blocks left its slots are skipped and the others go on in their proportions, so that no document is left out; up to
the slot at which the first source ends, the mix follows the weights. A block's place counts the blocks that are really
there: sums over the periods and, in a period, over its slots, so that no global sort is needed.

Numbering rows in a source takes no task more than a cell of it: cells are equal parts of the range of hashes, as many
as the source's rows ask for. Sources, the slots of a period and the blocks of each cell are tables that rows are joined with,
the blocks by the cells that rows have been shuffled by already. Only the sums over periods, of which there is one for some
PERIOD * BLOCK_ROWS rows, pass through one task.

Defined cases: a null source is one of its own, named by NO_SOURCE; a null text is kept; rows of equal id follow each other by a
hash of their text; a source without a weight raises, a weight without rows is left out; an empty table gives no rows; extra columns
stay as they are, but for one called `mix`, whose place the mix takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .ranges import BITS, hash52

PERIOD, SOURCES_A_PERIOD, BLOCK_ROWS = 1000, 500, 64
#: Rows of a source that one task numbers, on average.
CELL_ROWS = 5_000
#: Weights are counts to this power: sources of few documents get more than their share of rows.
EVENNESS = 0.5
NO_SOURCE = "(none)"


def tempered(counts: DataFrame, power: float = EVENNESS) -> DataFrame:
    """source, weight: the counts (source, n) to a power."""
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """source, share: whole slots that add up to `period`, by largest remainders; at least one each. One row a source."""
    total = weights.agg(F.sum("weight").alias("t"), F.count(F.lit(1)).alias("m"))
    spread = weights.crossJoin(F.broadcast(total)).withColumn("exact", F.col("weight") / F.col("t") * (period - F.col("m")))
    spread = spread.withColumn("floor", F.floor("exact"))
    left = F.lit(period) - F.col("m") - F.sum("floor").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact") - F.col("floor")), "source"))
    return spread.select("source", (1 + F.col("floor") + F.when(place <= left, 1).otherwise(0)).cast("int").alias("share"))


def schedule(shares_: Column, period: int) -> Column:
    """For the shares of sources 0.. the source that runs in each slot of a period, by earliest deadline first."""
    p = lambda i: F.get(shares_, i)

    def slot(state, t):
        def block(done, i):
            released = F.floor(done * F.lit(period) / p(i)) <= t
            due = F.ceil((done + 1) * F.lit(period) / p(i))
            return F.when(released & (done < p(i)), F.struct(due.alias("due"), i.alias("i")))

        def after(run):
            done = F.transform(state["done"], lambda d, i: d + F.when(i == run, 1).otherwise(0))
            return F.struct(done.alias("done"), F.concat(state["runs"], F.array(run)).alias("runs"))

        # an array of one, so that the choice is made once and not for each source
        return F.get(F.transform(F.array(F.array_min(F.transform(state["done"], block))["i"]), after), 0)

    start = F.struct(F.transform(shares_, lambda _: F.lit(0)).alias("done"), F.expr("cast(array() as array<int>)").alias("runs"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, slot, lambda state: state["runs"])


def _plan(counts: DataFrame, weights: DataFrame, period: int, block_rows: int) -> DataFrame:
    """One row: the sources in the order of names with their shares, blocks and rows, and the runs of one period."""
    by_source = counts.join(shares(weights.join(counts, "source", "left_semi"), period), "source", "left")
    each = F.array_sort(F.collect_list(F.struct("source", "share", F.ceil(F.col("n") / block_rows).alias("blocks"), "n")))
    return by_source.agg(each.alias("sources")).withColumn("runs", schedule(F.col("sources.share"), period))


def _placed_blocks(cells: DataFrame, sources: DataFrame, slots: DataFrame, period: int, block_rows: int) -> DataFrame:
    """number, cell, before and the blocks of which a cell (number, cell, n, before) has rows, in their order: block, slot, place, and start, the rows of the mix before it."""
    reach = F.sequence(F.floor(F.col("before") / block_rows), F.floor((F.col("before") + F.col("n") - 1) / block_rows))
    blocks = cells.select("number", "cell", "before", F.explode(reach).alias("block")).join(sources.select("number", "share", F.col("n").alias("rows")), "number")
    # a block of several cells counts where it begins
    begins = (F.col("block") * block_rows >= F.col("before")).cast("long")
    blocks = blocks.withColumns({"turn": F.floor(F.col("block") / F.col("share")), "nth": F.col("block") % F.col("share"), "begins": begins, "size": begins * F.least(F.lit(block_rows), F.col("rows") - F.col("block") * block_rows)})
    blocks = materialize(blocks.join(slots, ["number", "nth"]).select("number", "cell", "before", "block", "turn", "t", "begins", "size"), "blocks")
    earlier = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = blocks.groupBy("turn").agg(F.sum("begins").alias("begun"), F.sum("size").alias("filled"))
    turns = turns.select("turn", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("begun", "filled")])
    in_turn = Window.partitionBy("turn").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, e: (F.col(c) + F.coalesce(F.sum(e).over(in_turn), F.lit(0))).cast("long")
    placed = blocks.join(turns, "turn").withColumns({"place": so_far("begun", "begins"), "start": so_far("filled", "size"), "slot": (F.col("turn") * period + F.col("t")).cast("long")})
    return placed.groupBy("number", "cell", "before").agg(F.array_sort(F.collect_list(F.struct("block", "slot", "place", "start"))).alias("blocks"))


def interleave(docs: DataFrame, weights: DataFrame | None = None, period: int | None = None, block_rows: int = BLOCK_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (by default all) of every row of `docs` (doc_id, source and any others), with `mix`: a struct of

    - source_row, block: the row's number in its source and that of its block, from 0;
    - slot: the slot that the schedule gives the block;
    - place: the block's number among all blocks that are there, from 0;
    - position: the row's number in the mix.

    `weights` (source, weight) are the targets, the tempered counts by default. `period` has to be as many as the sources
    at least; by default it follows from their number.
    """
    name = F.coalesce(F.col("source"), F.lit(NO_SOURCE))
    counts = materialize(docs.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("n")), "counts")
    many = counts.count()
    period = period or PERIOD * max(1, -(-many // SOURCES_A_PERIOD))
    if many > period:
        raise ValueError(f"{many} sources don't fit in a period of {period}")
    plan = materialize(_plan(counts, tempered(counts) if weights is None else weights, period, block_rows), "plan")
    sources = materialize(plan.select(F.posexplode("sources").alias("number", "s")).select("number", "s.*"), "sources")
    missing = [r["source"] for r in sources.filter("share is null").select("source").take(5)]
    if missing:
        raise ValueError(f"no weight for {missing}")
    # the slot of each source's n-th block of a period
    slots = plan.select(F.posexplode("runs").alias("t", "number")).withColumn("nth", (F.row_number().over(Window.partitionBy("number").orderBy("t")) - 1).cast("long"))

    keep = [c for c in keep or docs.columns if c != "mix"]
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").alias("id"), tie.alias("tie"), name.alias("source"), hash52(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("blocks") * block_rows / CELL_ROWS))
    rows = rows.join(sources.select("source", "number", parts.alias("cells")), "source")
    share = F.col("order").cast("double") / float(1 << BITS)
    rows = rows.withColumn("cell", F.least(F.floor(share * F.col("cells")), F.col("cells") - 1)).drop("source", "cells")
    cells = rows.groupBy("number", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    blocks = materialize(_placed_blocks(cells, sources, slots, period, block_rows), "places")
    in_cell = Window.partitionBy("number", "cell").orderBy("order", "id", "tie")
    ranked = rows.withColumn("k", F.row_number().over(in_cell) - 1).join(blocks, ["number", "cell"])
    source_row = F.col("before") + F.col("k")
    ranked = ranked.withColumns({"source_row": source_row, "its": F.get("blocks", (F.floor(source_row / block_rows) - F.floor(F.col("before") / block_rows)).cast("int"))})
    mix = F.struct("source_row", "its.block", "its.slot", "its.place", (F.col("its.start") + F.col("source_row") % block_rows).alias("position"))
    return ranked.select(*[F.col(f"row.`{c}`") for c in keep], mix.alias("mix"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of interleave() in the order of the mix, without `mix`."""
    return mixed.orderBy("mix.position").drop("mix")
