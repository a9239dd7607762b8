"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is the bitwise majority of XXH64 over a document's word shingles. Two fingerprints that differ in at most
`most` bits agree on at least blocks - most of the blocks that the 64 bits are cut into, so joining on every choice of
that many blocks finds every pair. Equal fingerprints are one node. Within a bucket only a spanning set of links is
kept, so a large group of near copies makes as many rows as it has members; a bucket beyond a bound is split again by
blocks of the bits that it hasn't fixed, which loses no pair and ends, as the bits do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import arrow, staged, text_bytes

SEED, SHINGLE, MOST, BLOCKS, BUCKET = 42, 3, 3, 6, 2048


def simhash(text: bytes, words: int = SHINGLE) -> int:
    """Lower-case A-Z, words between ASCII white space, shingles with repeats; fewer words are one shingle, none is 0."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp as a signed long), one row for each row of docs."""

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield arrow({"doc_id": (batch.column(0), pa.int64()), "fp": (fp.view(np.int64), pa.int64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col)).mapInArrow(prints, "doc_id long, fp long")


def _cut(bits: list[int], blocks: int) -> list[int]:
    """Masks of the given bit positions cut into blocks."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, dtype=np.int64), blocks)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(fixed: int, most: int, blocks: int) -> list[int]:
    """Masks to join on below a bucket that has fixed some bits: those, and every choice of blocks - most others."""
    rest = [b for b in range(64) if not fixed >> b & 1]
    return [fixed | sum(c) for c in combinations(_cut(rest, blocks), blocks - most)]


def star(fps: np.ndarray, most: int) -> np.ndarray:
    """For each of a bucket's distinct fingerprints the smallest it is linked with, directly or by others."""
    if len(fps) == 2:
        return fps[[0, 0]] if int(fps[0] ^ fps[1]).bit_count() <= most else fps
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most
    root = np.full(len(fps), -1)
    for i in range(len(fps)):
        if root[i] < 0:
            front = np.array([i])
            while len(front):
                root[front] = i
                front = np.flatnonzero(near[front].any(0) & (root < 0))
    return fps[root]


def _bucket_links(most: int, limit: int):
    """Over rows (mask, part, fp) sorted by all three: links (fp, root), and rows of buckets beyond the limit again."""

    def close(rows: list[np.ndarray]) -> tuple[list, list]:
        fps = np.unique(np.concatenate(rows))
        root = star(fps, most)
        other = root != fps
        return fps[other].view(np.int64).tolist(), root[other].view(np.int64).tolist()

    def batch(kind: int, mask: list, a: list, b: list) -> pa.RecordBatch:
        return arrow({"hot": ([kind == 1] * len(a), pa.bool_()), "mask": (mask, pa.int64()), "a": (a, pa.int64()), "b": (b, pa.int64())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for x in batches:
            mask, part, fp = (x.column(i).to_numpy() for i in range(3))
            if not len(fp):
                continue
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            # a run of one row that neither goes on from the last batch nor into the next is alone
            odd = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp)))
            la, lb, hm, ha = [], [], [], []
            for i in odd.tolist():
                s, e = int(starts[i]), int(ends[i])
                now = (int(mask[s]), int(part[s]))
                if now != key:
                    if 1 < size <= limit:
                        p, q = close(held)
                        la += p
                        lb += q
                    key, held, size = now, [], 0
                held.append(fp[s:e].view(np.uint64))
                size += e - s
                if size > limit:
                    for h in held:
                        ha += h.view(np.int64).tolist()
                        hm += [now[0]] * len(h)
                    held = []
            if la:
                yield batch(0, [0] * len(la), la, lb)
            if ha:
                yield batch(1, hm, ha, ha)
        if 1 < size <= limit:
            p, q = close(held)
            yield batch(0, [0] * len(p), p, q)

    return run


def links(fps: DataFrame, most: int = MOST, blocks: int = BLOCKS, limit: int = BUCKET) -> DataFrame:
    """(a, b), a > b in unsigned order: links that span the same components as all pairs within `most` bits.
    fps: column fp, distinct."""
    spark, found = fps.sparkSession, None
    rows, masks = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), [0]
    while masks:
        below = [(_signed(m), [_signed(x) for x in block_masks(m, most, blocks)]) for m in masks]
        if len(below) == 1:
            each = rows.select("fp", F.explode(F.array(*map(F.lit, below[0][1]))).alias("mask"))
        else:  # at most 20 ** 2 masks of 20 each
            table = spark.createDataFrame(below, "mask long, masks array<long>")
            each = rows.join(F.broadcast(table), "mask").select("fp", F.explode("masks").alias("mask")).distinct()
        each = each.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
        made = staged(each.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").mapInArrow(_bucket_links(most, limit), "hot boolean, mask long, a long, b long"), "blocks")
        new = made.where(~F.col("hot")).select("a", "b")
        found = new if found is None else found.union(new)
        rows = made.where("hot").select("mask", F.col("a").alias("fp")).distinct()
        # the masks, 20 at the first level and 20 times as many at each below, are bounded by the rule that makes them
        masks = [r["mask"] & (1 << 64) - 1 for r in rows.select("mask").distinct().collect()]
    return found.distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of the edges (a, b): alternating large and small stars until nothing changes.

    Each half links neighbours of a node to the least of them. What a node has is summed up by a minimum, which
    tasks do before the shuffle, and joined back, which Spark splits where a node has very many neighbours.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        now = staged(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct(), name)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs.

    component_id is the smallest doc_id reachable over links, the row's own included. A null or empty text has
    fingerprint zero and is linked like any other; a row with a null id counts in links, has the component of its
    fingerprint, and null where no row of the component has an id. Repeated rows are repeated; an empty table gives
    no rows; other columns are not read. Fingerprints, 16 bytes a row, are staged once: the text is read once.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), most, blocks))
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, and rows without an id, which nothing
    can stand for. Rows that share such an id are one document and all stay."""
    kept = near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
