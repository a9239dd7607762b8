"""Token ids in a binary file format.

Each document's ids are serialised as little-endian 16- or 32-bit integers and compressed on their own with a
zstandard dictionary that all share, trained on a bounded sample of serialised id arrays. Documents are packed in
ascending order into segments: header, dictionary hash, ids of the documents, their token counts and an index of
offsets, then the frames, so one short document is read without its neighbours. Segments are rows of a Parquet table,
with the least and greatest id beside each, so a reader of one document fetches one segment. They are written through Spark's commit protocol: any file system that Spark knows, and a task that is
lost is run again and leaves nothing behind. The dictionary is a table of one row beside it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import arrow, shared_path, text_bytes

MAGIC, VERSION = b"SLTOKENS", 2
#: magic, version, bytes of an id, documents, tokens of the part before this segment, dictionary hash
HEADER = struct.Struct("<8sHHIQ32s")
END_ID, LEVEL, SEGMENT_BYTES = 2, 3, 4 << 20
SAMPLE_DOCS, SAMPLE_PIECES, PIECE_BYTES, DICTIONARY_BYTES = 400, 4, 4096, 64 << 10
ROWS_A_PART = 20_000
#: low and high: least and greatest id in the segment, null if it has none.
SEGMENT = "part int, segment int, docs long, tokens long, low long, high long, data binary"

#: Latin letters, with or without a blank before: one pre-token.
_LATIN = re.compile(rb"(?: ?)(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _bytes(*parts: int | range) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for p in parts:
        table[list(p) if isinstance(p, range) else p] = True
    return table


#: By byte: what a piece may begin with, marks without the apostrophe; what may begin white space, of any script; ASCII
#: letters, and digits too.
_BLANK, _MARK = _bytes(0x20, 0x0A), _bytes(range(0x21, 0x27), range(0x28, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F))
_MAYBE_SPACE = _bytes(range(0x09, 0x0E), range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3)
_LETTER = _bytes(range(0x41, 0x5B), range(0x61, 0x7B))
_ALNUM = _LETTER | _bytes(range(0x30, 0x3A))


@lru_cache(maxsize=2)
def _tokenizer(file: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


class Encoder:
    """The ids of whole texts by a byte-level tokenizer of the tokenizers library, as serialised arrays.

    Its pre-tokens never reach over the start of a blank or line feed that precedes something else, nor from a line
    feed into a letter, nor from Latin letters or digits into ASCII marks other than the apostrophe. So texts, as bytes,
    are cut there, many at a time, and each distinct piece is given to the library once, as long as the memo holds
    it; words of letters are given to it many at a time. Texts with `<|` go to it whole, as an added token might hold a blank; `whole` sends it all texts: for
    tokenizers with another way of cutting. The memo's older half goes where it's full.
    """

    MOST = 400_000

    def __init__(self, file: str, end_id: int | None = END_ID, whole: bool = False):
        self.tokenizer, self.whole = _tokenizer(file), whole
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _library(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

    def _words(self, words: list[bytes], between: bytes) -> Iterator[bytes]:
        """Of words of letters, each one pre-token: with a blank before they need nothing between, else a line feed."""
        size, step = self.kind.itemsize, 1 + len(between)
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            made = self.tokenizer.encode(between.join(some).decode(), add_special_tokens=False)
            ids, number = np.array(made.ids, self.kind).tobytes(), np.array(made.word_ids, dtype=np.int64)
            cut = np.searchsorted(number, np.arange(len(some)) * step) * size, np.searchsorted(number, np.arange(len(some)) * step + 1) * size
            yield from (ids[a:b] for a, b in zip(*(c.tolist() for c in cut), strict=True))

    def _of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.memo) > self.MOST:
            self.memo, self.older = {}, self.memo
        missing = [p for p in pieces if p not in self.memo]
        new = []
        for p in missing:
            if (ids := self.older.get(p)) is None:
                new.append(p)
            else:
                self.memo[p] = ids
        words = [p for p in new if _LATIN.fullmatch(p)]
        for between, some in ((b"", [w for w in words if w[0] == 32]), (b"\n", [w for w in words if w[0] != 32])):
            self.memo.update(zip(some, self._words(some, between), strict=True))
        rest = [p for p in new if p not in self.memo]
        self.memo.update(zip(rest, self._library(rest), strict=True))
        return list(map(self.memo.__getitem__, pieces))

    @staticmethod
    def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a piece begins at a byte. offsets: where texts begin, and the end of all."""
        start = np.zeros(len(data), dtype=bool)
        if len(data) > 1:
            start[:-1] = _BLANK[data[:-1]] & ~_MAYBE_SPACE[data[1:]]
            start[1:] |= (data[:-1] == 0x0A) & _LETTER[data[1:]]
            at = np.flatnonzero(_MARK[data[1:]]) + 1
            before = data[at - 1]
            latin = (data[np.maximum(at - 2, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (at > 1)
            start[at[_ALNUM[before] | latin]] = True
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        start[last[_BLANK[data[last]]]] = False  # nothing follows
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        return start

    def many(self, texts: pa.Array) -> list[bytes]:
        """Of texts in UTF-8, as an array of binaries without nulls."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return [self.end] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        alone = np.unique(np.searchsorted(offsets, np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)), "right")) - 1
        if self.whole:
            alone = np.arange(len(texts))
        starts = self._starts(data, offsets)
        for i in alone.tolist():
            starts[offsets[i] + 1 : offsets[i + 1]] = False
        starts = np.flatnonzero(starts).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, np.int32(len(data)))), pa.py_buffer(data)]).dictionary_encode()
        ids = self._of(cut.dictionary.to_pylist())
        # the pieces' ids one after the other, by the places of each piece's ids among those of the distinct ones
        code, size = cut.indices.to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        n = size[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = np.frombuffer(b"".join(ids), self.kind)[np.repeat((np.cumsum(size) - size)[code] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, offsets)]
        return [flat[a:b].tobytes() + self.end for a, b in pairwise(cuts.tolist())]

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text.encode()], pa.binary()))[0]


@lru_cache(maxsize=2)
def encoder(file: str, end_id: int | None, whole: bool) -> Encoder:
    """One for each worker: a task begins with the memo of the ones before."""
    return Encoder(file, end_id, whole)


def _some(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with their texts, of about `most` bytes each; a longer text is a slice of its own."""
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    i = 0
    while i < len(texts):
        n = max(1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1 - i)
        yield batch.slice(i, n), texts.slice(i, n)
        i += n


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or none where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def pack(ids: list[int | None], counts: list[int], frames: list[bytes], width: int, before: int, dictionary_hash: bytes) -> bytes:
    """A segment: header, ids, a bit for each that is null, token counts, offsets, frames."""
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    head = HEADER.pack(MAGIC, VERSION, width, len(ids), before, dictionary_hash)
    return b"".join([head, np.array([x or 0 for x in ids], "<i8").tobytes(), np.packbits([x is None for x in ids]).tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Segment:
    """Reads a segment; checks magic, version and that the dictionary is the one it was written with."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, n, self.before, digest = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        at = HEADER.size
        ids = np.frombuffer(data, "<i8", n, at)
        nulls = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at + 8 * n), count=n)
        self.ids = [None if null else x for x, null in zip(ids.tolist(), nulls.tolist(), strict=True)]
        at += 8 * n + -(-n // 8)
        self.counts = np.frombuffer(data, "<u4", n, at)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 4 * n)
        self.start, self.data = at + 12 * n + 8, data
        self.codec = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by its offsets alone."""
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        raw = self.codec.decompress(self.data[self.start + a : self.start + b], max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def sample_ids(docs: DataFrame, file: str, end_id: int | None, rows: int, whole: bool) -> list[bytes]:
    """Pieces of the id arrays of about SAMPLE_DOCS documents, chosen by a hash of the id: at most
    2 * SAMPLE_DOCS * SAMPLE_PIECES pieces of PIECE_BYTES come to the driver, whatever the input's size."""
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file, end_id, whole)
        for batch in batches:
            out = []
            for ids in (x for _, texts in _some(batch, 0) for x in encode.many(texts)):
                at = range(0, len(ids), PIECE_BYTES)
                out += [ids[i : i + PIECE_BYTES] for i in at[:: max(1, len(at) // SAMPLE_PIECES)][:SAMPLE_PIECES]]
            yield arrow({"piece": (out, pa.binary())})

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(text_bytes())
    most = 2 * SAMPLE_DOCS * SAMPLE_PIECES
    return sorted(r["piece"] for r in chosen.mapInArrow(cut, "piece binary").limit(most).collect())


def bounds_of(ids: DataFrame, parts: int) -> list[int]:
    """Ids that cut the table in about equal parts, ascending."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("x")).first()["x"] or []))


def part_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most value; null, which comes first, is in part 0."""
    if not bounds:
        return F.lit(0)
    # binary search as nested conditions: log2 of the bounds deep
    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < bounds[mid], find(lo, mid)).otherwise(find(mid + 1, hi))

    return F.when(value.isNull(), F.lit(0)).otherwise(find(0, len(bounds)))


def write_tokens(docs: DataFrame, file: str, path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None, whole: bool = False) -> str:
    """Writes the ids of every whole text of docs under path, in ascending order of the id (or of `order`, a long).

    A null or empty text has the end id alone (no ids if there is none); a null id comes first. Rows with the same id
    are all written, ordered by their ids' bytes. Other columns aren't read. An empty table writes no segment. Ids,
    not texts, are shuffled, once, compressed, to parts bounded in rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(id_col) if order is None else order).cast("long").alias("place"), F.col(text_col).cast("string").alias("text"))
    rows = slim.select("place").count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PART)) if rows > 1000 else 1
    bounds = bounds_of(slim.select(F.col("place").alias("doc_id")), parts)
    dictionary = train_dictionary(sample_ids(slim, file, end_id, rows, whole))
    digest = hashlib.sha256(dictionary).digest()
    width = Encoder(file, end_id).kind.itemsize

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(file, end_id, whole)
        codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(dictionary))
        for batch in batches:
            for some, texts in _some(batch, 3):
                counts, frames = [], []
                for ids in to_ids.many(texts):
                    counts.append(len(ids) // width)
                    frames.append(codec.compress(ids))
                yield arrow({"part": (some.column(0), pa.int32()), "place": (some.column(1), pa.int64()), "doc_id": (some.column(2), pa.int64()), "n": (counts, pa.int32()), "frame": (frames, pa.binary())})

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = None, 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, before, size
            data, known = pack(ids, counts, frames, width, before, digest), [x for x in ids if x is not None]
            row = arrow({
                "part": ([part], pa.int32()), "segment": ([number], pa.int32()), "docs": ([len(ids)], pa.int64()), "tokens": ([sum(counts)], pa.int64()),
                "low": ([min(known, default=None)], pa.int64()), "high": ([max(known, default=None)], pa.int64()), "data": ([data], pa.binary()),
            })
            number, before, size = number + 1, before + sum(counts), 0
            for x in (ids, counts, frames):
                x.clear()
            return row

        for batch in batches:
            for p, d, n, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if p != part or size >= SEGMENT_BYTES:
                    if ids:
                        yield close()
                    if p != part:
                        part, number, before = p, 0, 0
                ids.append(d)
                counts.append(n)
                frames.append(f.as_py())
                size += len(frames[-1])
        if ids:
            yield close()

    made = slim.select(part_of(F.col("place"), bounds).alias("part"), "place", "doc_id", text_bytes()).mapInArrow(encode, "part int, place long, doc_id long, n int, frame binary")
    dealt = made.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("part"), F.col("place").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "frame")
    dealt.mapInArrow(segments, SEGMENT).write.parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(dictionary), digest.hex())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def _dictionary(spark, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read_document(spark, path: str, doc_id: int) -> DataFrame:
    """(doc_id, ids) of the documents with an id, a row each; none if there is none. low and high leave out the other
    segments before their data is read, and of a segment only the documents' own frames are decompressed."""
    dictionary = _dictionary(spark, path)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                seg = Segment(data.as_py(), dictionary)
                ids = [seg.tokens(k) for k, x in enumerate(seg.ids) if x == doc_id]
                yield arrow({"doc_id": ([doc_id] * len(ids), pa.int64()), "ids": (ids, pa.list_(pa.int32()))})

    rows = spark.read.parquet(f"{path}/segments").where((F.col("low") <= doc_id) & (F.col("high") >= doc_id))
    return rows.select("data").mapInArrow(decode, "doc_id long, ids array<int>")


def read_tokens(spark, path: str, columns: str, of: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Per document of the files, in any order: doc_id, start, n_tokens and what `of` makes of its ids.
    columns: names and types of those."""
    dictionary = _dictionary(spark, path)
    table = spark.read.parquet(f"{path}/segments")
    names = [c.strip().split(" ") for c in columns.split(",")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seg = Segment(data.as_py(), dictionary)
                starts = seg.before + np.concatenate([[0], np.cumsum(seg.counts, dtype=np.int64)[:-1]])
                made = [of(seg.tokens(k)) for k in range(len(seg.ids))]
                yield arrow(
                    {"part": ([part] * len(seg.ids), pa.int32()), "doc_id": (seg.ids, pa.int64()), "start": (starts, pa.int64()), "n_tokens": (seg.counts.astype(np.int64), pa.int64())}
                    | {n: ([x[i] for x in made], kinds[t]) for i, (n, t) in enumerate(names)}
                )

    got = table.select("part", "data").mapInArrow(decode, f"part int, doc_id long, start long, n_tokens long, {columns}")
    # one number for each part of ROWS_A_PART documents and more: as many as the writing job had tasks
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    base = np.concatenate([[0], np.cumsum([n for _, n in sizes], dtype=np.int64)])
    starts = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, base[:-1], strict=True)], "part int, base long")
    return got.join(starts, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", *(n for n, _ in names))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32_of(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def token_digest(docs: DataFrame, order: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that it writes."""
    path = write_tokens(docs, tokenizer_file(), shared_path(docs.sparkSession, "tokens"), order=order)
    return read_tokens(docs.sparkSession, path, "ids_crc32 long", crc32_of)
