"""The attempt journal: an append-only table that a run is resumed from, and its stream view."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.instrument import SURVEY
from surveyloom.functions.responses import parse
from surveyloom.functions.scalars import attempt_seed
from surveyloom.operators.requests import latest_success, remaining

ENTRY = "request_id string, attempt int, seed long, raw_completion string, valid boolean, error string, scores map<string,int>, achieved_total int, achieved_tier string, tier_match boolean, retryable boolean, elapsed_s double"

#: HTTP statuses after which a request may be tried again; 5xx are, too.
RETRYABLE = frozenset({408, 409, 429})


class ProviderError(RuntimeError):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status
        self.retryable = status is None or status in RETRYABLE or 500 <= status < 600


def even_answers(request: dict, seed: int) -> str:
    """An offline provider: an answer whose total is the target, dealt out evenly."""
    import json

    d = SURVEY[request["disorder"]]
    total = round(request["score_target"] * (d.n_items if d.mean else 1))
    base, more = divmod(total, d.n_items)
    return json.dumps({"scores": {c: min(d.top, base + (k < more)) for k, c in enumerate(d.items)}})


#: What the answers of this provider depend on; such a provider is asked once for equal requests of a batch.
even_answers.depends = ("disorder", "score_target")

_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "map<string,int>": pa.map_(pa.string(), pa.int32())}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split(" ") for c in ENTRY.split(", "))])


def _alike(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each combination of the columns' values, and each row's combination."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns:
        own = batch.column(c).dictionary_encode("encode")
        code = np.unique(code, return_inverse=True)[1] * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    return first, at


def attempted(requests: DataFrame, provider: Callable[[dict, int], str], seed: int) -> DataFrame:
    """One more attempt of each request (request_id, disorder, score_target, tier_code, attempts): a task asks the
    provider for its own rows, and reads each completion strictly. A provider whose answers depend on some of the
    request's columns alone, neither on others nor on the seed, may name them in `depends`."""
    rows = requests.select("request_id", "disorder", "score_target", "tier_code", (F.col("attempts") + 1).cast("int").alias("attempt"), attempt_seed(F.lit(seed), F.col("request_id"), F.col("attempts") + 1).alias("seed"))
    depends = getattr(provider, "depends", None)

    def answer(r: dict) -> tuple:
        raw, error, retry, began = None, None, True, time.perf_counter()
        try:
            raw = provider(r, r["seed"])
        except ProviderError as e:
            error, retry = str(e), e.retryable
        took = time.perf_counter() - began
        scores, why = parse(raw, SURVEY[r["disorder"]]) if error is None else (None, error)
        total = None if scores is None else sum(scores.values())
        tier = None if total is None else f"tier_{SURVEY[r['disorder']].tier_of_total(total)}"
        return raw, scores is not None, why, None if scores is None else list(scores.items()), total, tier, None if tier is None else tier == r["tier_code"], retry, took

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.ones(batch.num_rows)
            at = None
            if depends is not None:
                first, at = _alike(batch, [*dict.fromkeys([*depends, "disorder", "tier_code"])])
                n = np.bincount(at)
            asked = batch if at is None else batch.take(pa.array(first))
            *made, took = zip(*map(answer, asked.to_pylist()), strict=True)
            made = [pa.array(x, f.type) for x, f in zip([*made, np.array(took) / n], list(_SCHEMA)[3:], strict=True)]
            if at is not None:
                made = [x.take(pa.array(at)) for x in made]
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(_SCHEMA.field(c).type) for c in ("request_id", "attempt", "seed")] + made, schema=_SCHEMA)

    return rows.mapInArrow(ask, ENTRY)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a journal. A file's last line may be torn and is dropped if so; any other bad line is an error.
    A line is known to be torn if it is its file's last and doesn't end the JSON object."""
    lines = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.select("file", "value", F.from_json("value", ENTRY, {"mode": "PERMISSIVE"}).alias("e"))
    bad = parsed.where(F.col("e.request_id").isNull() & (F.trim("value") != ""))
    per_file = bad.groupBy("file").agg(F.count("*").alias("n"), F.count_if(~F.rtrim("value").endswith("}")).alias("torn"))
    if not per_file.where("n > 1 or torn < n").isEmpty():
        raise ValueError("the journal has a line that can't be read before its end")
    return parsed.where("e.request_id is not null").select("e.*")


def checked_journal(journal: DataFrame, requests: DataFrame, seed: int) -> DataFrame:
    """The journal's entries of these requests whose seed is the one of their attempt."""
    own = journal.join(requests.select("request_id"), "request_id", "left_semi")
    return own.where(F.col("seed") == attempt_seed(F.lit(seed), F.col("request_id"), F.col("attempt")))


def run(spark: SparkSession, requests: DataFrame, journal_path: str, provider: Callable[[dict, int], str], seed: int, retries: int = 2, extra: int = 0) -> DataFrame:
    """Attempts all that remains until every request has a success, has failed for good or has had its tries; each
    round is appended to the journal under journal_path before the next begins. Returns the latest successes. extra:
    tries beyond the others for what has used those up, when a run is taken up again; a failure for good stays one."""
    if isinstance(extra, bool) or not isinstance(extra, int) or extra < 0:
        raise ValueError("extra attempts are a whole number from 0 on")

    def journal() -> DataFrame:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(journal_path)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return spark.read.schema(ENTRY).parquet(journal_path) if there else spark.createDataFrame([], ENTRY)

    for _ in range(retries + 1 + extra):
        left = remaining(requests, journal(), retries + 1 + extra)
        if left.isEmpty():
            break
        attempted(left, provider, seed).write.mode("append").parquet(journal_path)
    return latest_success(journal(), "request_id", "attempt", "valid", ["scores", "achieved_total", "achieved_tier", "tier_match"])


def effort(journal: DataFrame) -> DataFrame:
    """(n_attempts, n_requests, seconds): what the attempts of a journal took."""
    return journal.agg(F.count("*").alias("n_attempts"), F.count_distinct("request_id").alias("n_requests"), F.coalesce(F.sum("elapsed_s"), F.lit(0.0)).alias("seconds"))


def progress_stream(spark: SparkSession, journal_path: str) -> DataFrame:
    """A stream of (valid, n) over the files that are appended to a journal."""
    return spark.readStream.schema(ENTRY).parquet(journal_path).groupBy("valid").agg(F.count("*").alias("n"))
