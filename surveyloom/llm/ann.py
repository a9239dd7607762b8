"""Approximate nearest neighbours by a forest of hash prefixes.

A tree is the array of all rows sorted by a long hash string. A string's first symbol is the vertex of a randomly
turned cross-polytope that the row's direction is nearest to (FIRST bits), then come symbols of small cross-polytopes
(NEXT bits each); every tree has turns of its own. The arrays are dealt to tasks by ranges of strings. A query's
cell in a tree are the rows that share a prefix with it. It descends to the longest prefix and ascends in all trees
together, symbol by symbol, until their cells hold enough candidates; where the cells of the first symbol aren't
enough it goes on to its next nearest vertices, in the end to all. Counts of cells tell where that is before any
vector is looked at, so a query is sent to the ranges that hold its cells alone and measured exactly there.

Equal vectors are one entry with its least ids, as many as any answer can take, so copies make no cell large.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.llm.common import arrow, staged

#: Trees; bits and components of a string's first symbol; bits, components and number of those that follow.
TREES, FIRST, WIDE, NEXT, NARROW, SYMBOLS, SEED = 36, 7, 64, 3, 4, 18, 20_240_607
BITS = FIRST + NEXT * SYMBOLS
#: Candidates asked for, over all trees: ENOUGH * k * rows ** POWER (measured, see README).
ENOUGH, POWER = 1.1, 0.6
#: Rows and queries that a task holds at once; vectors whose mean the strings are taken around.
SHARD_ROWS, BLOCK_QUERIES, CENTRE_ROWS = 8192, 2048, 4096


def turns(dim: int) -> np.ndarray:
    """(dim, trees, components): the same everywhere. The first symbol's directions are orthogonal."""
    rng, wide = np.random.default_rng([SEED, dim]), min(dim, WIDE)
    out = np.zeros((dim, TREES, WIDE + NARROW * SYMBOLS))
    for t in range(TREES):
        out[:, t, :wide] = np.linalg.qr(rng.standard_normal((dim, wide)))[0]
        out[:, t, WIDE:] = rng.standard_normal((dim, NARROW * SYMBOLS))
    return out


def vertices(y: np.ndarray) -> np.ndarray:
    """Number of the nearest vertex of the cross-polytope: component with the largest size, and its sign."""
    at = np.abs(y).argmax(-1)
    return 2 * at + (np.take_along_axis(y, at[..., None], -1)[..., 0] > 0)


class Strings:
    def __init__(self, dim: int, centre: np.ndarray | None):
        self.turns, self.centre = turns(dim).reshape(dim, -1), np.zeros(dim) if centre is None else centre

    def _turned(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) @ self.turns).reshape(len(x), TREES, -1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): hash strings, the first symbol in the highest of BITS bits."""
        out = np.zeros((len(x), TREES), dtype=np.int64)
        for i in range(0, len(x), 512):
            y = self._turned(x[i : i + 512])
            key = vertices(y[:, :, :WIDE])
            for s in range(SYMBOLS):
                key = key << NEXT | vertices(y[:, :, WIDE + s * NARROW : WIDE + (s + 1) * NARROW])
            out[i : i + 512] = key
        return out

    def nearest_vertices(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees, 2 ** FIRST): first symbols from the nearest to the furthest; unused ones last."""
        y = self._turned(x)[:, :, :WIDE]
        both = np.stack([-y, y], axis=-1).reshape(*y.shape[:2], -1)
        return np.argsort(-both, axis=-1, kind="stable")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min(F.transform("v", lambda x: x + 0.0)).alias("v"))


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean of at most CENTRE_ROWS vectors, by their number of components."""
    got: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_ROWS).collect():
        got.setdefault(len(r["v"]), []).append(r["v"])
    return {d: np.mean(x, axis=0) for d, x in got.items()}


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftright(key, BITS - bits)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_measured): the k nearest found of each row whose id is divisible by `every`,
    among all other rows with vectors of as many components; score is the Euclidean distance in double precision,
    n_measured how many different vectors the query was measured against, with repeats in several trees.

    Rows with a null id, and vectors that are null, empty, zero, or hold null or non-finite components take no part.
    Rows with the same id are one: the least vector counts. Ties go to the smaller vec_id. With fewer candidates
    than k all are returned; a query without candidates has no rows, and neither has an empty table. Other columns are
    not read. Any number of lengths of vectors is searched.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    total, centres = rows.count(), _centres(rows)
    strings: dict[int, Strings] = {}

    def of(dim: int) -> Strings:
        if dim not in strings:
            strings.clear()  # one at a time: rows come by their length
            strings[dim] = Strings(dim, centres.get(dim))
        return strings[dim]

    # one entry for each vector: its least k + 1 ids, of which one may be the query's own
    by = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where(F.col("vec_id") % every == 0).select("v", F.col("vec_id").alias("query_id"))
    least = least.join(asking.select("v").distinct().withColumn("asks", F.lit(True)), "v", "left")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                node, v, asks = (part.column(i).to_pylist() for i in (0, 1, 2))
                dims = np.array([len(x) for x in v])
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d).tolist()
                    x = np.array([v[i] for i in at])
                    yield arrow({
                        "dim": ([d] * len(at), pa.int32()), "node": ([node[i] for i in at], pa.int64()), "asks": ([bool(asks[i]) for i in at], pa.bool_()),
                        "v": ([y.tobytes() for y in x.astype(kind)], pa.binary()), "keys": (list(of(d)(x)), pa.list_(pa.int64())),
                    })

    ids = staged(least.select(F.col("ids")[0].alias("node"), "v", F.coalesce("asks", F.lit(False)).alias("asks"), "ids"), "distinct")
    index = staged(ids.select("node", "v", "asks").mapInArrow(hashed, "dim int, node long, asks boolean, v binary, keys array<long>"), "strings")
    entries = index.select("dim", F.posexplode("keys").alias("tree", "key"), "node")
    queries = index.where("asks").select("dim", F.posexplode("keys").alias("tree", "key"), "node")

    # cells of every prefix that may hold more than a row, and how many candidates a query's cells hold in all trees
    levels = [FIRST + NEXT * j for j in range(SYMBOLS + 1) if not j or total >> (FIRST + NEXT * (j - 1))]
    at_levels = F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), _prefix(F.col("key"), b).alias("cell")) for b in levels)))
    cells = entries.select("dim", "tree", at_levels.alias("c")).select("dim", "tree", "c.*").groupBy("dim", "tree", "bits", "cell").agg(F.count("*").alias("n"))
    cells = staged(cells, "cells")
    sizes = cells.where(F.col("bits") == FIRST).where("tree = 0").groupBy("dim").agg(F.sum("n").alias("rows"))
    # itself, which is in its cell of every tree, doesn't count; a table of no more rows than that is looked at whole
    wanted = F.greatest(F.lit(TREES * k), F.ceil(ENOUGH * (k + 1) * F.pow("rows", F.lit(POWER))))
    enough = F.when(F.col("rows") > wanted, wanted + TREES).otherwise(F.lit(1 << 62))
    own = queries.select("dim", "tree", "node", at_levels.alias("c")).select("dim", "tree", "node", "c.*")
    held = own.join(cells, ["dim", "tree", "bits", "cell"]).groupBy("dim", "node", "bits").agg(F.sum("n").alias("n")).join(sizes, "dim")
    chosen = staged(held.groupBy("dim", "node", "rows").agg(F.max(F.when(F.col("n") >= enough, F.col("bits"))).alias("bits"), enough.alias("enough")), "levels")

    def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << FIRST
        for batch in batches:
            for part in (batch.slice(i, 16) for i in range(0, batch.num_rows, 16)):
                dims = part.column(0).to_numpy()
                for d in np.unique(dims).tolist():
                    some = part.filter(pa.array(dims == d))
                    order = of(d).nearest_vertices(_matrix(some.column(2), d, kind))
                    n = len(order) * TREES * size
                    yield arrow({
                        "dim": (np.full(n, d), pa.int32()), "node": (np.repeat(some.column(1).to_numpy(), TREES * size), pa.int64()),
                        "tree": (np.tile(np.repeat(np.arange(TREES), size), len(order)), pa.int32()), "cell": (order.ravel(), pa.int64()), "place": (np.tile(np.arange(size), len(order) * TREES), pa.int32()),
                    })

    # for the queries whose first symbols' cells aren't enough: how many of their nearest vertices are
    more = index.join(chosen.where("bits is null").select("node", "enough"), "node")
    probes = staged(more.select("dim", "node", "v").mapInArrow(in_order, "dim int, node long, tree int, cell long, place int"), "probes")
    gain = probes.join(cells.where(F.col("bits") == FIRST), ["dim", "tree", "cell"]).groupBy("node", "place").agg(F.sum("n").alias("n"))
    upto = gain.withColumn("n", F.sum("n").over(Window.partitionBy("node").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    upto = upto.join(more.select("node", "enough"), "node").groupBy("node").agg(F.min(F.when(F.col("n") >= F.col("enough"), F.col("place"))).alias("last"))
    first = probes.join(upto, "node").where(F.col("place") <= F.coalesce("last", F.lit(1 << FIRST))).select("dim", "tree", "node", F.lit(FIRST).alias("bits"), "cell")
    visits = own.join(chosen.select("node", "bits"), ["node", "bits"]).select("dim", "tree", "node", "bits", "cell").unionByName(first)

    # tasks' ranges of strings: even ones by the number of rows; where one holds more, it is dealt again by a hash
    cut = min(BITS, max(0, (total // SHARD_ROWS).bit_length()))
    ranged = entries.select("dim", "tree", _prefix(F.col("key"), cut).alias("range"), "key", "node")
    spans = visits.select("dim", "tree", "node", F.expr(f"shiftleft(cell, {BITS} - bits)").alias("low"), F.expr(f"shiftleft(cell + 1, {BITS} - bits) - 1").alias("high"))
    spans = spans.select("dim", "tree", F.explode(F.sequence(_prefix(F.col("low"), cut), _prefix(F.col("high"), cut))).alias("range"), "node", "low", "high")
    place = ["dim", "tree", "range"]
    deal = ranged.groupBy(place).agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards")).join(spans.groupBy(place).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")), place)
    deal = staged(deal, "deal")
    found_in = index.select(F.col("node").alias("asked"), F.col("v").alias("q"))
    left = index.select("dim", F.posexplode("keys").alias("tree", "key"), "node", "v").withColumn("range", _prefix(F.col("key"), cut)).join(deal, place)
    left = left.select(*place, F.pmod(F.xxhash64("node"), "shards").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "node", "v")
    right = spans.join(deal, place).select(*place, F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.col("node").alias("asked"), "low", "high")
    right = right.join(found_in, "asked").select(*place, "shard", "block", "asked", "low", "high", "q").toDF("q_dim", "q_tree", "q_range", "q_shard", "q_block", "asked", "low", "high", "q")

    def measure(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, dim = [], int(key[0])
        if len(left) and len(right):
            left = left.sort_values("key", kind="stable")
            keys, nodes = left["key"].to_numpy(), left["node"].to_numpy()
            x = np.frombuffer(b"".join(left["v"]), kind).reshape(-1, dim).astype(np.float64)
            for (low, high), some in right.groupby(["low", "high"]):
                a, b = np.searchsorted(keys, low), np.searchsorted(keys, high, "right")
                for i in range(0, len(some) if b > a else 0, 256):
                    q = np.frombuffer(b"".join(some["q"].iloc[i : i + 256]), kind).reshape(-1, dim).astype(np.float64)
                    asked = some["asked"].to_numpy()[i : i + 256]
                    rough = (x[a:b] ** 2).sum(1) - 2 * q @ x[a:b].T
                    bound = np.partition(rough, min(k + 1, b - a) - 1, axis=1)[:, min(k + 1, b - a) - 1]
                    slack = 1e-9 * (1 + np.abs(rough).max(1) + (q**2).sum(1))
                    who, near = np.nonzero(rough <= (bound + slack)[:, None])
                    score = np.sqrt(((x[a + near] - q[who]) ** 2).sum(1))
                    out.append(pd.DataFrame({"asked": asked[who], "node": nodes[a + near], "score": score, "n": (b - a) * (np.concatenate([[-1], who[:-1]]) != who)}))
        return pd.concat(out) if out else pd.DataFrame({"asked": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})

    found = left.groupBy(*place, "shard", "block").cogroup(right.groupBy("q_dim", "q_tree", "q_range", "q_shard", "q_block")).applyInPandas(measure, "asked long, node long, score double, n long")
    found = found.groupBy("asked", "node").agg(F.min("score").alias("score"), F.sum("n").alias("n"))
    # entries to ids; the query's own vector is at distance 0, whether found or not
    owners = index.where("asks").select(F.col("node").alias("asked"), "node", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"))
    best = found.unionByName(owners).groupBy("asked", "node").agg(F.min("score").alias("score"), F.sum("n").alias("n"))
    best = best.withColumn("n_measured", F.sum("n").over(Window.partitionBy("asked")))
    best = best.join(ids.select("node", "ids"), "node").select("asked", F.explode("ids").alias("vec_id"), "score", "n_measured")
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("asked").orderBy("score", "vec_id"))).where(F.col("at") <= k + 1)
    asked = asking.join(ids.select("v", F.col("node").alias("asked")), "v").select("query_id", "asked")
    own = asked.join(best, "asked").where("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_measured")


def ann_search(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings)
