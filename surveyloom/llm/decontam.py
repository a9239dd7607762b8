"""Benchmark decontamination by a BM25 inverted index of test items with block-max WAND.

Every document is cut into overlapping passages, twice as long as the longest item of an index, so that whatever is
as long as an item lies within one. Each passage is a query: all items are retrieved whose BM25 score reaches the
least score that a passage holding the item can have, that is the item's own score less its heaviest terms that
may be missing under the overlap asked for. No contained item falls below it. What is retrieved is verified: the
share of the question's and of the answer's word shingles that the passage holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import arrow, staged

K1, B, SHINGLE, OVERLAP, BLOCK = 1.2, 0.75, 5, 0.8, 16
SHARD_BYTES = 16 << 20
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's answer is its last sentence that has a word, its question what stands before; of one sentence both are all."""
    parts = [w for s in _SENTENCE.split(text or "") if (w := words(s))]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [x for p in parts[:-1] for x in p], parts[-1]


def shingles(w: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of `size` words; of fewer words the whole run."""
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's shingles that the passage holds."""
    own = shingles(part)
    return len(own & {tuple(passage[i : i + min(SHINGLE, len(part))]) for i in range(len(passage) - min(SHINGLE, len(part)) + 1)}) / len(own) if own else 0.0


@dataclass
class Index:
    """Items of up to `longest` words. Weights are BM25 over the item's least score, so that the threshold is 1."""

    longest: int
    ids: list[int | None]
    questions: list[list[str]]
    answers: list[list[str]]
    least: np.ndarray
    terms: dict[str, int]
    items: list[np.ndarray] = field(default_factory=list)  # postings by term, ascending
    weights: list[np.ndarray] = field(default_factory=list)
    block_most: list[np.ndarray] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # essential postings, by term
    essential: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    essential_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    need: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass(frozen=True)
class Corpus:
    """Of all items with words, whatever index they are in: their number, words and, for some words, items that hold them."""

    n: int
    words: int
    df: dict[str, int]


def corpus_of(rows: list[tuple[int | None, str]]) -> Corpus:
    each = [w for _, t in rows if (w := words(t))]
    return Corpus(len(each), sum(map(len, each)), dict(Counter(t for w in each for t in set(w))))


def build_index(rows: list[tuple[int | None, str]], longest: int, share: float = OVERLAP, corpus: Corpus | None = None) -> Index:
    """An index of items; those without words take no part. BM25 is by the corpus, or the rows where there's none."""
    kept = [(i, w, *question_answer(t)) for i, t in rows if (w := words(t))]
    corpus = corpus or corpus_of(rows)
    total, mean = corpus.n, corpus.words / max(1, corpus.n)
    n, df = len(kept), {t: corpus.df[t] for _, w, _, _ in kept for t in w}
    terms = {t: k for k, t in enumerate(sorted(df))}
    idf = {t: math.log1p((total - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    least, need = np.zeros(n), np.zeros(n)
    lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
    light: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for k, (_, w, q, a) in enumerate(kept):
        weight = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
        # a missing shingle costs one word at most, as each word is in a shingle of the same part
        missing = sum(len(s) - math.ceil(share * len(s) - 1e-9) for s in (shingles(q), shingles(a)))
        heavy = sorted(weight.values(), reverse=True)
        least[k] = max(sum(heavy[missing:]), heavy[-1]) * (1 - 1e-9)
        # terms that occur in most items are left out while what is left still has to be there
        spare = 0.0
        for t, x in sorted(weight.items(), key=lambda p: (-df[p[0]], p[0])):
            x /= least[k]
            lists[terms[t]].append((k, x))
            if spare + x < 0.5:
                spare += x
            else:
                light[terms[t]].append((k, x))
        need[k] = 1 - spare
    out = Index(longest, [i for i, *_ in kept], [q for _, _, q, _ in kept], [a for *_, a in kept], least, terms, need=need)
    sizes = np.zeros(len(terms) + 1, dtype=np.int64)
    for t in range(len(terms)):
        p = lists[t]
        out.items.append(np.array([i for i, _ in p]))
        out.weights.append(np.array([x for _, x in p]))
        out.block_most.append(np.maximum.reduceat(out.weights[-1], np.arange(0, len(p), BLOCK)))
        sizes[t + 1] = len(light[t])
    out.most = np.array([b.max() for b in out.block_most])
    out.first = np.cumsum(sizes)
    out.essential = np.array([i for t in range(len(terms)) for i, _ in light[t]], dtype=np.int64)
    out.essential_weight = np.array([x for t in range(len(terms)) for _, x in light[t]])
    return out


def block_max_wand(index: Index, query: Iterable[int]) -> list[tuple[int, float]]:
    """All items whose score over the distinct query terms is at least 1, by document-at-a-time evaluation: cursors
    in the order of their items, a pivot where the terms' maxima reach the threshold, and a whole block skipped
    where the maxima of the blocks at the pivot don't."""
    cursors = [[int(index.items[t][0]), 0, t] for t in query]
    out = []
    while cursors:
        cursors.sort()
        total, pivot = 0.0, -1
        for i, (_, _, t) in enumerate(cursors):
            total += index.most[t]
            if total >= 1:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, upto = 0.0, None
        for _, at, t in cursors[: pivot + 1]:
            block = (at + int(np.searchsorted(index.items[t][at:], item))) // BLOCK
            if block < len(index.block_most[t]):
                bound += index.block_most[t][block]
                last = int(index.items[t][min((block + 1) * BLOCK, len(index.items[t])) - 1])
                upto = last if upto is None else min(upto, last)
        if bound >= 1:
            score = 0.0
            for c in cursors[: pivot + 1]:
                at = c[1] + int(np.searchsorted(index.items[c[2]][c[1] :], item))
                if at < len(index.items[c[2]]) and index.items[c[2]][at] == item:
                    score += index.weights[c[2]][at]
            if score >= 1:
                out.append((item, score))
            target = item + 1
        else:
            target = max(item + 1, (item if upto is None else upto) + 1)
            if pivot + 1 < len(cursors):
                target = min(target, max(item + 1, cursors[pivot + 1][0]))
        moved = []
        for i, (now, at, t) in enumerate(cursors):
            if i <= pivot and now < target:
                at += int(np.searchsorted(index.items[t][at:], target))
                if at >= len(index.items[t]):
                    continue
                now = int(index.items[t][at])
            moved.append([now, at, t])
        cursors = moved
    return out


def passages_to_try(index: Index, ids: np.ndarray, chunk: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Numbers of the chunks that begin a passage (that chunk and the next of the same document) some item may reach.
    ids: term or -1 by word; chunk: its number; last: whether a chunk is its document's last. The bound sums what
    the essential postings give, for every passage and item at once."""
    known = ids >= 0
    pair = np.unique(chunk[known] * len(index.terms) + ids[known])
    c, t = np.divmod(pair, len(index.terms))
    size = index.first[t + 1] - index.first[t]
    if not size.sum():
        return np.zeros(0, np.int64)
    where = np.repeat(index.first[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    key, back = np.unique(np.repeat(c, size) * len(index.ids) + index.essential[where], return_inverse=True)
    score = np.bincount(back, weights=index.essential_weight[where])
    c, item = np.divmod(key, len(index.ids))

    def beside(step: int) -> np.ndarray:
        at = np.searchsorted(key, key + step * len(index.ids))
        ok = at < len(key)
        ok[ok] = key[at[ok]] == key[ok] + step * len(index.ids)
        other = c + min(step, 0)
        ok &= (other >= 0) & ~last[np.maximum(other, 0)]
        return np.where(ok, score[np.minimum(at, len(key) - 1)], 0.0)

    need = index.need[item] - 1e-9
    forward, backward = c[score + beside(1) >= need], c[score + beside(-1) >= need] - 1
    return np.union1d(forward, backward[(backward >= 0) & ~last[np.maximum(backward, 0)]])


def found_in(indexes: list[Index], texts: list[str | None]) -> list[list[tuple[int | None, float, float, float]]]:
    """Per text the verified items: id, BM25 score, overlap of question and answer, of the passage with the best score."""
    out: list[dict[tuple[int, int], tuple]] = [{} for _ in texts]
    split = [words(t) for t in texts]
    for number, index in enumerate(indexes):
        if not index.ids:
            continue
        step = index.longest
        count = np.array([max(1, -(-len(w) // step)) for w in split], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        ids = np.fromiter((x for w in split for x in map(index.terms.get, w, repeat(-1))), dtype=np.int64, count=int(lengths.sum()))
        start = np.concatenate([[0], np.cumsum(lengths)])
        place = np.arange(len(ids)) - np.repeat(start[:-1], lengths)
        chunk = np.repeat(first[:-1], lengths) + place // step
        last = np.zeros(first[-1], dtype=bool)
        last[first[1:] - 1] = True
        for k in passages_to_try(index, ids, chunk, last).tolist():
            d = int(np.searchsorted(first, k, "right")) - 1
            a = (k - int(first[d])) * step
            passage = split[d][a : a + 2 * step]
            query = np.unique(ids[start[d] + a : min(start[d] + a + 2 * step, start[d + 1])])
            for item, score in block_max_wand(index, query[query >= 0].tolist()):
                q, r = overlap(index.questions[item], passage), overlap(index.answers[item], passage)
                if q >= OVERLAP and r >= OVERLAP:
                    made = (index.ids[item], score * index.least[item], q, r)
                    if made[1:] > out[d].get((number, item), (None, -1.0))[1:]:
                        out[d][number, item] = made
    return [sorted(x.values(), key=lambda r: (r[0] is None, r[0] or 0)) for x in out]


def shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[Index]]:
    """Indexes of at most SHARD_BYTES of item text at a time: what goes to the tasks is bounded, however large the
    benchmark; each shard is one more pass over the documents. Items of like lengths share an index. Document
    frequencies, number and mean length are those of all items: tasks count them, and each item comes with those of its
    own words, so that its scores are the same whatever else is in its shard."""

    def build(rows: list[tuple]) -> list[Index]:
        corpus = Corpus(total["n"], total["words"] or 0, {t: c for *_, df in rows for t, c in df})
        by: dict[int, list] = defaultdict(list)
        for i, t, _ in rows:
            by[max(64, 1 << (len(words(t)) - 1).bit_length()) if words(t) else 64].append((i, t))
        return [build_index(v, k, corpus=corpus) for k, v in sorted(by.items())]

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [words(t) for t in batch.column(1).to_pylist()]
            yield arrow({"row": (batch.column(0), pa.int64()), "size": ([len(w) for w in each], pa.int64()), "terms": ([sorted(set(w)) for w in each], pa.list_(pa.string()))})

    slim = items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    table = staged(slim.withColumn("row", F.monotonically_increasing_id()), "items")
    has = staged(table.select("row", "t").mapInArrow(counted, "row long, size long, terms array<string>"), "terms")
    total = has.where("size > 0").agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    terms = has.select("row", F.explode("terms").alias("term"))
    own = terms.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("row").agg(F.collect_list(F.struct("term", "df")).alias("df"))
    rows, size = [], 0
    for r in table.join(own, "row", "left").select("i", "t", "df").orderBy("i", "t").toLocalIterator():
        rows.append((r["i"], r["t"], r["df"] or ()))
        size += len(r["t"])
        if size >= SHARD_BYTES:
            yield build(rows)
            rows, size = [], 0
    if rows:
        yield build(rows)


BATCH_CHARS = 200_000


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap): the items that each row of docs holds.

    Null and empty texts hold nothing and items without words are in nothing; null ids are kept as null; repeated
    rows of docs give repeated results, repeated items are items of their own; an empty table gives no rows; other
    columns are not read. No shuffle: the index goes to the documents.
    """
    kinds = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], kinds)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for indexes in shards(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(indexes)

        def find(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, size = [], [], 0
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids.append(d)
                    texts.append(t.as_py())
                    size += len(texts[-1] or "")
                    if size >= BATCH_CHARS:
                        yield rows(ids, found_in(sent.value, texts))
                        ids, texts, size = [], [], 0
                if ids:
                    yield rows(ids, found_in(sent.value, texts))

        def rows(ids: list, found: list) -> pa.RecordBatch:
            flat = [(d, *r) for d, x in zip(ids, found, strict=True) for r in x]
            names = {"doc_id": pa.int64(), "item_id": pa.int64(), "bm25": pa.float64(), "question_overlap": pa.float64(), "answer_overlap": pa.float64()}
            return arrow({n: ([r[i] for r in flat], k) for i, (n, k) in enumerate(names.items())})

        out = out.unionByName(slim.mapInArrow(find, kinds))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item: each row is judged where it is read, whatever its id."""
    at = docs.columns.index(text_col)
    for indexes in shards(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(indexes)

        def keep(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                    clean = [not x for x in found_in(sent.value, some.column(at).to_pylist())]
                    yield some.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
