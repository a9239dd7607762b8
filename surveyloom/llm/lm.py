"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the tokens before, times that of the token in its class. The class
layer is a softmax over CLASSES classes whose features, hashed into tables of a fixed size, are the token before, the
classes of the three before, and a skip over the token before. Tasks train it by minibatch gradient updates on their
own training documents, all of them; the expected counts of a gradient are those of one class drawn from the model for
each token, without bias. The tables are averaged row by row, weighted by how many tokens touched a row. The word layer
is a softmax with the word itself as its only feature, whose optimum with add-one smoothing is the relative
frequency, so it takes the exact counts of all training words. Scoring is by numpy over sparse rows of the tables.

Words come by the million, so their counts stay a table: frequent words, a bounded number, go to the tasks, the
document's other words are joined with the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import Memo, arrow, crc_mod, parts, staged, sum_parts, text_bytes

#: Class 0 is the end token's alone. Rows of each feature's table. Most words that go to the tasks.
CLASSES, ROWS, HEAD = 64, 1 << 12, 1 << 18
#: Features; tokens of a minibatch; step and what each squared gradient sum begins at.
FEATURES, BATCH, RATE, DAMP, SEED = 3, 32_768, 0.3, 25.0, 5
MOD, HELD = 7, 2
TABLE = FEATURES * ROWS + 1


def word_class(word: bytes) -> int:
    """By the first two bytes: what languages and kinds of text differ in."""
    return zlib.crc32(word[:2]) % (CLASSES - 1) + 1


def _code(word: bytes) -> int:
    return zlib.crc32(word) * CLASSES + word_class(word)


def encoded(text: bytes, memo: Memo) -> tuple[list[bytes], np.ndarray]:
    """Lower-case words, and by token its hash and class in one number; the end token is number 0. What Tokens and
    word_codes give for many texts at once, written out for one."""
    words = text.lower().split()
    out = np.zeros(len(words) + 1, dtype=np.int64)
    out[:-1] = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
    return words, out


#: Bytes of text whose tokens are held at once.
PIECE = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), 32]] = True
#: Step of the crc32 by its lowest byte, and classes by the first two bytes (one byte: the second half's).
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> 1) ^ np.where(_CRC & 1, np.uint32(0xEDB88320), np.uint32(0))
_CLASS = np.array([word_class(bytes([i >> 8, i & 255])) for i in range(1 << 16)] + [word_class(bytes([i])) for i in range(256)], dtype=np.int64)
#: Longer words are hashed one by one.
LONG = 32


class Tokens(NamedTuple):
    """Tokens of some documents: lower-case words one after the other, and how many each document has."""

    words: pa.BinaryArray
    counts: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        """Where the end tokens are, when each document has one behind its words."""
        return np.cumsum(self.counts + 1) - 1

    def with_ends(self, values: np.ndarray, end: float) -> np.ndarray:
        """What belongs to words, with the end tokens' value between."""
        out = np.empty(len(values) + len(self.counts), dtype=values.dtype)
        word = np.ones(len(out), dtype=bool)
        word[self.ends] = False
        out[word] = values
        out[self.ends] = end
        return out


def tokens(texts: pa.Array) -> Iterator[tuple[slice, Tokens]]:
    """Tokens of a binary column without nulls, by slices of about PIECE bytes; a longer document is a slice alone."""
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        raw = data.slice(int(at[i]), int(at[j] - at[i])).to_pybytes() if at[j] > at[i] else b""
        yield slice(i, j), _tokens(np.frombuffer(raw.lower(), dtype=np.uint8), at[i : j + 1] - at[i])
        i = j


def _tokens(raw: np.ndarray, at: np.ndarray) -> Tokens:
    word = ~_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = at[(at > 0) & (at < len(raw))]
    first[cut], last[cut - 1] = word[cut], word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
    return Tokens(words, np.diff(np.searchsorted(starts, at)))


def distinct_words(words: pa.BinaryArray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Each word's place among the distinct ones, and those."""
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def word_codes(words: pa.BinaryArray) -> np.ndarray:
    """_code of every word: crc32 a byte of all words at a time, the longest first."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
    size = np.diff(at)
    short = np.minimum(size, LONG + 1).astype(np.uint8)
    order = np.argsort(LONG + 1 - short, kind="stable")
    start = at[:-1][order].astype(np.int64)
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    more = len(order) - np.cumsum(np.bincount(short, minlength=LONG + 2))
    for k in range(LONG):
        if not (m := int(more[k])):
            break
        c = crc[:m]
        crc[:m] = _CRC[(c ^ data[start[:m] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    ordered = ~crc
    for i in range(int(more[LONG])):
        w = order[i]
        ordered[i] = zlib.crc32(data[at[w] : at[w + 1]])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = ordered
    head = data[at[:-1]].astype(np.int64)
    two = np.where(size > 1, head << 8 | data[np.minimum(at[:-1] + 1, len(data) - 1)], head + (1 << 16))
    return out * CLASSES + _CLASS[two]


BEFORE = 3


def features(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, FEATURES) rows of the table, and classes, of documents one after the other."""
    return laid_out(np.concatenate(codes), np.array([len(c) for c in codes]))


def laid_out(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """features() of the codes of documents with so many tokens each; what is of one feature lies together."""
    real = np.ones(len(codes) + BEFORE * len(sizes), dtype=bool)
    starts = np.cumsum(sizes + BEFORE) - sizes - BEFORE
    for k in range(BEFORE):
        real[starts + k] = False
    flat = np.full(len(real), -1)
    flat[real] = codes
    word, cls = flat // CLASSES, flat % CLASSES
    one, two = word[2:-1], word[1:-2]
    three = (cls[2:-1] * CLASSES + cls[1:-2]) * CLASSES + cls[:-3]
    mix = np.uint64(0x9E3779B97F4A7C15)
    rows = np.empty((FEATURES, len(codes)), dtype=np.int64)
    for i, x in enumerate((one, three + 99, two)):
        rows[i] = (x.view(np.uint64)[real[BEFORE:]] * mix >> np.uint64(52)).view(np.int64) % ROWS + i * ROWS
    return rows.T, cls[real]


def _scores(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = table[rows[:, 0]]
    for i in range(1, FEATURES):
        z += table[rows[:, i]]
    z += table[-1]
    z -= z.max(1, keepdims=True)
    return z


def class_log_probs(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(tokens, CLASSES) natural logarithms."""
    z = _scores(table, rows)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


#: Tokens whose class scores are held at once: they fit a core's cache.
SLICE = 4096


#: Products of weights below this are computed again by sums of logarithms.
LEAST = 1e-25


class Weights:
    """Classes' weights of tokens as products of the exponentials of rows, so that a table is exponentiated, not each
    token's scores. A row is divided by its greatest number; the bias is in the first feature's rows."""

    def __init__(self):
        self.exp = np.empty((FEATURES * ROWS, CLASSES), dtype=np.float32)
        self.made, self.other = (np.empty((SLICE, CLASSES), dtype=np.float32) for _ in range(2))

    def set(self, table: np.ndarray) -> None:
        self.table = table
        self.exp[:] = table[:-1]
        self.exp[:ROWS] += table[-1]
        self.exp -= self.exp.max(1, keepdims=True)
        np.exp(self.exp, out=self.exp)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """(tokens, CLASSES), of at most SLICE tokens; overwritten by the next call."""
        made, other = self.made[: len(rows)], self.other[: len(rows)]
        np.take(self.exp, rows[:, 0], axis=0, out=made, mode="clip")
        for i in range(1, FEATURES):
            made *= np.take(self.exp, rows[:, i], axis=0, out=other, mode="clip")
        return made


_ONES = np.ones(CLASSES, dtype=np.float32)


def own_log_probs(table: np.ndarray, rows: np.ndarray, cls: np.ndarray, weights: Weights | None = None) -> np.ndarray:
    """Natural logarithm of each token's own class. weights: of this table, where they are at hand."""
    if weights is None:
        weights = Weights()
        weights.set(table)
    out = np.empty(len(cls))
    for i in range(0, len(cls), SLICE):
        r, c = rows[i : i + SLICE], cls[i : i + SLICE]
        w = weights.of(r)
        own = w[np.arange(len(c)), c]
        low = np.flatnonzero(own < LEAST)
        own[low] = 1
        out[i : i + SLICE] = np.log(own) - np.log(np.maximum(w @ _ONES, LEAST))
        if len(low):
            out[i + low] = class_log_probs(table, r[low])[np.arange(len(low)), c[low]]
    return out


#: Classes are drawn in two steps, a block of them and one in it, by sums up to each.
BLOCK = 8
_BLOCKS = np.repeat(np.tri(CLASSES // BLOCK, dtype=np.float32), BLOCK, axis=1)
_WITHIN = np.tri(BLOCK, dtype=np.float32)


def draw(weights: Weights, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each of at most SLICE tokens, with the model's probabilities."""
    w = weights.of(rows)
    upto = _BLOCKS @ w.T
    if len(low := np.flatnonzero(upto[-1] < LEAST)):
        w[low] = np.exp(_scores(weights.table, rows[low]))
        upto = _BLOCKS @ w.T
    left = rng.random(len(rows), dtype=np.float32) * upto[-1]
    token = np.arange(len(rows))
    block = (upto[:-1] < left).view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64)
    left -= np.where(block > 0, upto[block - 1, token], 0)
    upto = _WITHIN @ w.reshape(-1, BLOCK)[token * (CLASSES // BLOCK) + block].T
    return block * BLOCK + (upto[:-1] < left).view(np.uint8).sum(0, dtype=np.uint8)


def update(table: np.ndarray, power: np.ndarray, seen: np.ndarray, rows: np.ndarray, cls: np.ndarray, rng: np.random.Generator, weights: Weights) -> None:
    """One minibatch: drawn less observed counts, scaled by the root of the squares so far."""
    weights.set(table)
    drawn = np.concatenate([draw(weights, rows[i : i + SLICE], rng) for i in range(0, len(cls), SLICE)])
    cells = rows.T * CLASSES
    g = (np.bincount((cells + drawn).ravel(), minlength=table.size) - np.bincount((cells + cls).ravel(), minlength=table.size)).astype(np.float32)
    g[-CLASSES:] = np.bincount(drawn, minlength=CLASSES) - np.bincount(cls, minlength=CLASSES)
    g = g.reshape(table.shape)
    power += g * g
    g *= RATE
    g /= np.sqrt(power)
    table -= g
    seen += np.bincount(rows.T.ravel(), minlength=TABLE)
    seen[-1] += len(cls)


def word_counts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(word, c, every, docs): counts in training documents and in all. The end token is the null word. A task sums up
    a bounded number of words before it hands them on."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.Table] = []
        docs_of = np.zeros(2, dtype=np.int64)

        def merged() -> pa.Table:
            return pa.concat_tables(made).group_by("word", use_threads=False).aggregate([("c", "sum"), ("every", "sum")]).select(["word", "c_sum", "every_sum"]).rename_columns(["word", "c", "every"])

        for batch in batches:
            for at, some in tokens(batch.column(1)):
                held = batch.column(0)[at].to_numpy()
                docs_of += np.bincount(held, minlength=2)
                which, words = distinct_words(some.words)
                every = np.bincount(which, minlength=len(words))
                c = every - np.bincount(which[np.repeat(held, some.counts) == 1], minlength=len(words))
                made.append(pa.table({"word": words, "c": pa.array(c, pa.int64()), "every": pa.array(every, pa.int64())}))
                if sum(t.num_rows for t in made) > 600_000:
                    made = [merged()]
                    if made[0].num_rows > 300_000:
                        yield from made.pop().to_batches()
        made.append(pa.table({"word": pa.array([None], pa.binary()), "c": docs_of[:1], "every": [docs_of.sum()]}))
        yield from merged().to_batches()

    held = (crc_mod(id_col, MOD) == HELD).cast("int")
    return docs.select(held, text_bytes(text_col)).mapInArrow(count, "word binary, c long, every long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def class_column(word: Column) -> Column:
    """word_class of a binary column."""
    return F.crc32(F.substring(word, 1, 2)) % (CLASSES - 1) + 1


def train(docs: DataFrame, text_col: str, id_col: str, prior: np.ndarray) -> np.ndarray:
    """The class layer's table, (TABLE, CLASSES), its last row the bias, which begins at the classes' frequencies."""
    size = TABLE * CLASSES
    start = np.zeros((TABLE, CLASSES), dtype=np.float32)
    start[-1] = np.log(prior)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rng, weights = start.copy(), np.random.default_rng(SEED), Weights()
        seen, power = np.zeros(TABLE), np.full(table.shape, DAMP, dtype=np.float32)
        # a minibatch is filled across batches of rows, so that only a task's last is a short one
        rows, cls = np.empty((0, FEATURES), dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            for _, some in tokens(batch.column(0)):
                r, c = laid_out(some.with_ends(word_codes(some.words), 0), some.counts + 1)
                rows, cls = np.concatenate([rows.T, r.T], axis=1).T, np.concatenate([cls, c])
                full = len(cls) - len(cls) % BATCH
                for i in range(0, full, BATCH):
                    update(table, power, seen, rows[i : i + BATCH], cls[i : i + BATCH], rng, weights)
                rows, cls = rows[full:], cls[full:]
        if len(cls):
            update(table, power, seen, rows, cls, rng, weights)
        moved = (table - start).astype(np.float64) * seen[:, None]
        yield from parts(np.concatenate([moved.ravel(), seen]))

    training = docs.where(crc_mod(id_col, MOD) != HELD).select(text_bytes(text_col))
    total = sum_parts(training.mapInArrow(learn, "part int, data binary"), size + TABLE)
    moved, seen = total[:size].reshape(TABLE, CLASSES), total[size:]
    return (start + moved / np.maximum(seen, 1)[:, None]).astype(np.float32)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Tokens are lower-case words and one end; documents whose crc32 of the id as text leaves 2 modulo 7 aren't learned.
    base_score is the add-one unigram, score the model's log10 probability. A null or empty text is its end token; a
    null id counts as the empty text in the crc; repeated rows are repeated and count each time. Without training
    documents the base is 0 for every text. An empty table gives no rows. Other columns are not read. The text is
    read three times: counts, gradients, scores.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = staged(word_counts(docs, "text", "doc_id"), "counts")
    known = F.col("c") > 0
    by = counts.groupBy(F.when(F.col("word").isNull(), F.lit(0)).otherwise(class_column(F.col("word"))).cast("int").alias("cls")).agg(F.sum("c").alias("n"), F.count(F.when(known, 1)).alias("v")).collect()
    n_of, v_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by:
        n_of[r["cls"]], v_of[r["cls"]] = r["n"], r["v"]
    total, distinct = int(n_of.sum()), int(v_of.sum())
    below = float(total + distinct + 1)
    end = int(n_of[0])
    # the words that occur most, in held-out documents too: what's left can't be in very many documents
    cut = counts.where("word is not null").groupBy("every").agg(F.count("*").alias("n"))
    edge = 0
    got = 0
    for r in cut.where("every > 1").orderBy(F.desc("every")).limit(HEAD).toLocalIterator():  # distinct counts, few
        if got + r["n"] > HEAD:
            edge = r["every"] + 1
            break
        got, edge = got + r["n"], r["every"]
    head = [] if not edge else counts.where(F.col("word").isNotNull() & (F.col("every") >= edge)).select("word", "c").collect()
    head = pa.array([bytes(r["word"]) for r in head], pa.binary()), np.array([*(r["c"] for r in head), -1], dtype=np.int64)
    prior = (n_of + 1) / (n_of + 1).sum()
    table = train(docs, "text", "doc_id", prior)
    # what the word layer adds to the base: its class's denominator in place of all words'; the end is alone in class 0
    gain = np.log10(below / (n_of + v_of + 1))
    gain[0] = -np.log10((end + 1) / below)
    sent = spark.sparkContext.broadcast((head, table, gain))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head_words, head_counts), table, gain = sent.value
        weights = Weights()
        weights.set(table)
        end_log = np.log10((end + 1) / below)
        for batch in batches:
            for at, some in tokens(batch.column(2)):
                # a piece's distinct words are looked up once; -1: not among the frequent ones
                which, words = distinct_words(some.words)
                c = head_counts[pc.fill_null(pc.index_in(words, head_words), -1).to_numpy(zero_copy_only=False)]
                sizes = some.counts + 1
                starts = np.cumsum(sizes) - sizes
                log = np.where(c < 0, 0, np.log10((np.maximum(c, 0) + 1) / below))
                base = np.add.reduceat(some.with_ends(log[which], end_log), starts)
                seen = np.add.reduceat(some.with_ends((c > 0).astype(np.int64)[which], int(end > 0)), starts)
                rows, cls = laid_out(some.with_ends(word_codes(words)[which], 0), sizes)
                more = np.add.reduceat(own_log_probs(table, rows, cls, weights) / np.log(10) + gain[cls], starts)
                rare = (c < 0)[which]
                key, n = np.unique(np.repeat(np.arange(len(sizes)) * max(len(words), 1), some.counts)[rare] + which[rare], return_counts=True)
                doc, word = np.divmod(key, max(len(words), 1))
                pairs = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(n, pa.int64())], names=["word", "n"])
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)), pa.int32()), pairs)
                yield arrow({"row": (batch.column(0)[at], pa.int64()), "doc_id": (batch.column(1)[at], pa.int64()), "n_tokens": (sizes, pa.int64()), "known": (seen, pa.int64()), "base": (base, pa.float64()), "more": (more, pa.float64()), "tail": (tails, tails.type)})

    # rows are numbered so that the same id may come again; the numbers are staged with what belongs to them
    made = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_bytes("text")).mapInArrow(score, "row long, doc_id long, n_tokens long, known long, base double, more double, tail array<struct<word:binary,n:bigint>>")
    made = staged(made, "scores")
    rare = made.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n").join(counts.select("word", "c"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rare"), F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(below))).alias("base_rare"))
    out = made.select("row", "doc_id", "n_tokens", "known", "base", "more").join(rare, "row", "left")
    base = F.col("base") + F.coalesce("base_rare", F.lit(0.0))
    return out.select(
        "doc_id", (crc_mod("doc_id", MOD) == HELD).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("more")).alias("score"),
    )
