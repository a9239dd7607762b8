"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network in numpy.

Random indexing gives each word a fixed sparse index vector of a few +1 and -1; a word's vector is the sum of the index
vectors of its neighbours over the whole corpus. Words are hashed to buckets, so the table has a fixed size. Each
token counts as two words: its letters, and its shape (case, marks, length, repetition). Tasks sum their tables, the
driver gets the sum alone. A document's features are means and spreads of its words' vectors. The network is trained
on a bounded sample of labelled documents and its probabilities are calibrated by a temperature on documents of the
sample that it wasn't trained on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import Memo, arrow, crc_mod, parts, staged, sum_parts, text_bytes

#: Buckets of words and, of them, of shapes; components; non-zeros of an index vector; neighbours on either side.
BUCKETS, SHAPES, DIM, ONES, WINDOW = 1 << 13, 1 << 9, 32, 4, 2
#: Most labelled documents that the network is trained on, hidden units, least score of a good document.
SAMPLE, HIDDEN, LEAST = 20_000, 24, 0.7
FEATURES = 4 * DIM + 2


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (BUCKETS, ONES) of the index vectors, from a mixing of the bucket's number."""
    x = np.arange(BUCKETS * ONES, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x % np.uint64(DIM)).astype(np.int64).reshape(BUCKETS, ONES), np.where(x >> np.uint64(40) & np.uint64(1), 1.0, -1.0).reshape(BUCKETS, ONES)


def _shape(word: bytes) -> int:
    letters = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    tail, head = word[len(word.rstrip(b"!#$%&*|<>=~^_+@.,;:?")) :], word[:1]
    case = "0" if not letters else "U" if letters.isupper() and len(letters) > 1 else "T" if letters[:1].isupper() else "L" if letters[:1].islower() else "D" if letters[:1].isdigit() else "X"
    return zlib.crc32(f"{case}|{tail[:3].decode('latin-1')}|{min(len(tail), 4)}|{min(len(letters) // 3, 5)}|{'m' if head in (b'|', b'#', b'*', b'<') else ''}".encode()) % (SHAPES // 2)


def _code(word: bytes) -> int:
    """Bucket of the letters and bucket of the shape in one number."""
    return (SHAPES + zlib.crc32(word.lower()) % (BUCKETS - SHAPES)) * SHAPES + _shape(word)


def tokens(text: bytes, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the shapes; a token that is the one before or two before has a shape of its own."""
    words = text.split()
    code = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
    word, shape = np.divmod(code, SHAPES)
    again = np.zeros(len(word), dtype=bool)
    again[1:] |= word[1:] == word[:-1]
    again[2:] |= word[2:] == word[:-2]
    return word, shape + again * (SHAPES // 2)


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sum over all tokens of the corpus of their neighbours' index vectors, (BUCKETS, DIM)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (place, sign) = Memo(_code), _index_vectors()
        table = np.zeros(BUCKETS * DIM)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def add() -> None:
            # documents are set apart by WINDOW tokens of bucket -1
            gap = np.full(WINDOW, -1)
            word, shape = (np.concatenate([y for x in held for y in (x[k], gap)]) for k in (0, 1))
            for step in range(1, WINDOW + 1):
                ok = (word[:-step] >= 0) & (word[step:] >= 0)
                pairs = [(word, word), (shape, shape), (word, shape)] if step == 1 else [(word, word)]
                for a, b in pairs:
                    for x, y in ((a[:-step][ok], b[step:][ok]), (a[step:][ok], b[:-step][ok])):
                        for j in range(ONES):
                            table[:] += np.bincount(x * DIM + place[y, j], weights=sign[y, j], minlength=len(table))

        for batch in batches:
            for t in batch.column(0):
                held.append(tokens(t.as_py(), memo))
                size += len(held[-1][0])
                if size > 400_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        yield from parts(table)

    return sum_parts(docs.select(text_bytes(text_col)).mapInArrow(count, "part int, data binary"), BUCKETS * DIM).reshape(BUCKETS, DIM)


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit vectors of the words that have neighbours; single precision."""
    centred = table - table.sum(0) / max(1.0, np.abs(table).sum()) * np.abs(table).sum(1, keepdims=True)
    return (centred / np.maximum(np.sqrt((centred**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(word: np.ndarray, shape: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of a document: means and spreads of its words' and of its shapes' vectors, share of distinct words, size."""
    out = np.zeros(FEATURES, dtype=np.float32)
    if len(word):
        for i, x in enumerate((word, shape)):
            some, n = np.unique(x, return_counts=True)
            v, n = vectors[some], n.astype(np.float32)[:, None] / len(x)
            mean = (v * n).sum(0)
            out[2 * i * DIM : (2 * i + 1) * DIM] = mean
            out[(2 * i + 1) * DIM : (2 * i + 2) * DIM] = np.sqrt(np.maximum((v * v * n).sum(0) - mean**2, 0))
            if not i:
                out[-2] = np.log(len(some) / len(word))
        out[-1] = np.log1p(len(word))
    return out


def document_features(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features as bytes of float32)."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_code)
        for batch in batches:
            rows = [pooled(*tokens(t.as_py(), memo), sent.value).tobytes() for t in batch.column(1)]
            yield arrow({"doc_id": (batch.column(0), pa.int64()), "features": (rows, pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col)).mapInArrow(pool, "doc_id long, features binary")


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = 7) -> Network:
    """Adam over minibatches; the temperature is the one with the least loss on every fifth document, which isn't
    trained on. With labels of one kind only, or none, a constant network gives the smoothed share of good ones."""
    x = x.astype(np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    rng = np.random.default_rng(seed)
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    net = Network(mean, scale, rng.normal(0, (1 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(prior))
    if len(np.unique(y)) < 2 or len(y) < 20:
        return net
    held = np.arange(len(y)) % 5 == 4
    xt, yt = (x[~held] - mean) / scale, y[~held]
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(yt))
        for i in range(0, len(order), 128):
            k = order[i : i + 128]
            h = np.tanh(xt[k] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - yt[k]) / len(k)
            back = d[:, None] * p[2] * (1 - h**2)
            g = [xt[k].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for a, b, c, q in zip(m, v, g, p, strict=True):
                a += 0.1 * (c - a)
                b += 0.001 * (c * c - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    z = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: _loss(z / t, y[held])))
    return net


def sampled_labels(labels: DataFrame, label_col: str = "quality", most: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most `most` labelled rows, chosen by a hash of the id among those that aren't held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y")).where("y is not null and doc_id is not null").where(crc_mod("doc_id", 4) != 2)
    n = rows.count()
    share = int(min(1.0, 0.9 * most / max(n, 1)) * (1 << 30))
    return staged(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most), "labels")


def fit(features: DataFrame, chosen: DataFrame, most: int = SAMPLE) -> Network:
    """Trains on the chosen labels (see sampled_labels), at most `most` rows of 12 bytes, which go to every task. Where ids
    are repeated the documents may be more: of those with a label, 2 * most at most are taken, by a hash of id, features
    and label, so that the choice doesn't depend on tasks."""
    own = features.join(F.broadcast(chosen), "doc_id").select("doc_id", "features", "y")
    got = own.orderBy(F.xxhash64("doc_id", "features", "y"), "doc_id", "features", "y").limit(2 * most).collect()
    got.sort(key=lambda r: (r["doc_id"], r["features"], r["y"]))
    order = np.random.default_rng(11).permutation(len(got))
    x = np.array([np.frombuffer(r["features"], np.float32) for r in got]).reshape(len(got), FEATURES)[order]
    return train(x, np.array([r["y"] for r in got], dtype=np.float64)[order])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    score is the calibrated probability of label 1; predicted is 1 from LEAST on. An empty or null text has the score
    of no words; a null id stays null and its text is scored. Labels of rows whose crc32 of the id as text leaves 2
    modulo 4 aren't learned, null labels and labels without a document aren't either; a document with several labels
    is learned with each. Repeated rows are repeated; an empty table gives no rows; without labels every score is 0.5.
    Only ids and texts are read. The text is read twice: for the vectors and for the features, half a kilobyte a
    document, which are staged.
    """
    vectors = word_vectors(context_table(docs, text_col))
    features = staged(document_features(docs, vectors, id_col, text_col), "features")
    net = fit(features, sampled_labels(labels))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(f.as_py(), np.float32) for f in batch.column(1)]).reshape(-1, FEATURES)
            yield arrow({"doc_id": (batch.column(0), pa.int64()), "score": (net(x), pa.float64())})

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, all columns. Rows are judged where they are read."""
    vectors = word_vectors(context_table(docs))
    chosen = sampled_labels(labels)
    net = fit(document_features(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"), vectors), chosen)
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (vectors, net) = Memo(_code), sent.value
        for batch in batches:
            for some in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                x = np.array([pooled(*tokens((t.as_py() or "").encode(), memo), vectors) for t in some.column(at)]).reshape(-1, FEATURES)
                yield some.filter(pa.array(net(x) >= LEAST, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
