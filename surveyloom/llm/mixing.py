"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their id, are cut into blocks. While no source has run out, one
with the share w of the weights has had w t of the first t slots; it releases its j-th block in the slot where that
passes j - 1 and must have it placed by the end of the one where it reaches j. Earliest deadline first places one block
in every slot, and the number of a source's blocks in the first t slots differs from w t by less than one, however
many slots there are. Where a source has no block left a new phase begins, in which the others' weights share the slots;
a block counts to the phase that it is due in. One task makes the schedule from the sources' counts and weights: what
it holds depends on the number of sources, not of documents, and the driver gets none of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.llm.common import arrow, staged

BLOCK_DOCS, TEMPER = 16, 0.5
RANGE_ROWS, RUN = 1 << 20, 1 << 14


def placed(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int]]:
    """(source, block, phase) of slot 0, 1, ... until all blocks are placed.

    Exact in integers: at virtual time v a source with the weight w has had min(blocks, v w) slots, of sum(that) in
    all. A phase is what lies between two ends of sources. Holds a few numbers for each source, none for a block.
    """
    ratios = {s: float(weights[s]).as_integer_ratio() for s, n in enumerate(blocks) if n}
    unit = max((d for _, d in ratios.values()), default=1)  # a power of two, as the others are
    whole = {s: n * (unit // d) for s, (n, d) in ratios.items()}
    ends: list[Fraction] = []  # virtual times
    gone, active = [0], [sum(whole.values())]  # before each end: slots of the sources that have ended, weight of the others
    for end, s in sorted((Fraction(blocks[s], w), s) for s, w in whole.items()):
        if not ends or ends[-1] != end:
            ends.append(end)
            gone.append(gone[-1])
            active.append(active[-1])
        gone[-1] += blocks[s]
        active[-1] -= whole[s]
    tops, bottoms, phase = [e.numerator for e in ends], [e.denominator for e in ends], dict.fromkeys(whole, 0)

    def due(s: int, j: int) -> int:
        """The slot by whose end source s has had j blocks; the phase of the j-th is set on the way."""
        w, low, step = whole[s], phase[s], 1
        while tops[min(low + step, len(tops)) - 1] * w < j * bottoms[min(low + step, len(tops)) - 1]:
            low, step = low + step, 2 * step
        high = min(low + step, len(tops)) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if tops[mid] * w < j * bottoms[mid] else (low, mid)
        phase[s] = low
        return -((-gone[low] * w - j * active[low]) // w)

    def release(s: int, j: int) -> int:
        """The slot within which source s has had j blocks, in the phase that due(s, j) has found."""
        return gone[phase[s]] + j * active[phase[s]] // whole[s]

    done = dict.fromkeys(whole, 0)
    waiting, ready = [(0, s) for s in whole], []
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (due(s, done[s] + 1), s))
        s = heapq.heappop(ready)[1]
        yield s, done[s], phase[s]
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (release(s, done[s]), s))


def _plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, block, phase, slot) of rows (source, blocks, weight), in runs of slots."""
    names, blocks, weights = [], [], []
    for batch in batches:
        for held, column in zip((names, blocks, weights), batch.columns, strict=True):
            held += column.to_pylist()
    run, at = placed(blocks, weights), 0
    while some := list(islice(run, RUN)):
        s, b, phase = zip(*some, strict=True)
        yield arrow({"source": ([names[i] for i in s], pa.string()), "block": (b, pa.int64()), "phase": (phase, pa.int32()), "slot": (list(range(at, at + len(s))), pa.int64())})
        at += len(s)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK_DOCS, id_col: str = "doc_id", source_col: str = "source", keep: bool = False) -> DataFrame:
    """(doc_id, source, block, phase, slot, position) for every row of docs, each exactly once.

    position orders the mixture: slot * block + place in the block (a source's last block may be short, which leaves
    gaps). weights: target by source; without them, each source's number of documents to the power TEMPER, so large
    sources come less often than they would and go on after the small ones. A source missing in weights, or with one
    that isn't positive, gets the least positive weight. A null source counts as the empty one. Repeated rows and
    null ids are placed like any other. Any number of sources is scheduled, each by its own weight. An empty table
    gives no rows. keep: adds the columns to all of docs' own instead, as struct `mix`.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if keep else F.lit(True)
    rows = docs.select(own.alias("row"), F.col(id_col).cast("long").alias("doc_id"), source.alias("source"))
    counts = staged(rows.groupBy("source").agg(F.count("*").alias("n")), "sources")
    named = [F.lit(x) for kv in (weights or {}).items() for x in kv]
    target = (F.create_map(*named)[F.col("source")] if named else F.pow("n", F.lit(TEMPER))).cast("double")
    target = F.when((target > 0) & (target < float("inf")), target)
    total, least = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.min(target), F.lit(1.0))).first()
    shares = counts.select("source", F.ceil(F.col("n") / block).alias("blocks"), F.coalesce(target, F.lit(least)).alias("w"))
    # one task goes through the slots and holds a few numbers a source; its input is a row a source, from which Spark
    # would take its output for small and send it through the driver, but for the hint below
    plan = shares.coalesce(1).sortWithinPartitions("source").mapInArrow(_plan, "source string, block long, phase int, slot long")

    # rank within a source without gathering it: a hash orders it, its leading bits cut the order into ranges of a
    # bounded number of rows, counts of the ranges before give where a range begins
    bits = min(40, (total // RANGE_ROWS).bit_length() + 8)
    rows = rows.withColumn("key", F.xxhash64("doc_id")).withColumn("range", F.shiftrightunsigned("key", 64 - bits))
    ranges = rows.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = ranges.select("source", "range", "n", (F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    # a range gets the slots of its blocks, so rows needn't be shuffled again to meet them
    last = F.expr(f"(before + n - 1) div {int(block)}")
    each = before.select("source", "range", "before", F.explode(F.sequence(F.expr(f"before div {int(block)}"), last)).alias("block"))
    slots = each.join(plan.hint("merge"), ["source", "block"]).groupBy("source", "range").agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("block", "phase", "slot"))).alias("slots"))
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "source")) - 1)
    found = ranked.join(slots, ["source", "range"]).withColumn("rank", F.col("before") + F.col("at"))
    found = found.withColumn("own", F.expr(f"get(slots, cast(rank div {int(block)} - before div {int(block)} as int))"))
    found = found.select("row", "doc_id", "source", "rank", "own.*").withColumn("position", F.col("slot") * block + F.col("rank") % block)
    made = ["block", "phase", "slot", "position"]
    if keep:
        return found.select("row.*", F.struct(*made).alias("mix"))
    return found.select("doc_id", "source", *made)


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs' own columns and rows, in the order of the mixture over partitions and within: files written of it hold
    it in the order of their names. Positions are dense but for short blocks, so they're dealt out evenly as they are."""
    names = [f"`{c}`" for c in docs.columns]
    made = mixed(docs, weights, keep=True)
    blocks = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit(""))).count().agg(F.sum(F.ceil(F.col("count") / BLOCK_DOCS))).first()[0]
    top = BLOCK_DOCS * max(1, blocks or 0)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = -(-top // parts)
    return made.repartitionById(parts, F.floor(F.col("mix.position") / width).cast("int")).sortWithinPartitions("mix.position").select(*names)


def source_mixture(docs: DataFrame) -> DataFrame:
    return mixed(docs)
