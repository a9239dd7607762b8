"""Requests of a generation run: rendering, completeness, what remains, and the table view of its successes."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.instrument import SURVEY, Instrument
from surveyloom.operators.ranking import first_of
from surveyloom.operators.scoring import valid_target

SYSTEM = "You answer structured questionnaires as the person described and return JSON only."


def targets(profiles: DataFrame, instrument: Instrument = SURVEY) -> DataFrame:
    """(patient_id, AGE, SEX, disorder, words, tier_code, score_target, allowed_min, allowed_max, valid): one row for
    each person and domain."""
    each = []
    for d in instrument.domains:
        tier, score = F.col(f"`{d.key}_TIER_CODE`"), F.col(f"`{d.key}_SCORE_TARGET`")
        scale = float(d.n_items) if d.mean else 1.0
        low, high = (F.get(F.array(*(F.lit(f(d.attainable(t)) / scale) for t in range(5))), F.substring(tier, -1, 1).try_cast("int")) for f in (min, max))
        each.append(F.struct(F.lit(d.name).alias("disorder"), F.col(f"`{d.key}`").alias("words"), tier.alias("tier_code"), score.alias("score_target"), low.alias("allowed_min"), high.alias("allowed_max"), valid_target(d, score, tier).alias("valid")))
    return profiles.select("patient_id", "AGE", "SEX", F.explode(F.array(*each)).alias("t")).select("patient_id", "AGE", "SEX", "t.*")


def target_line(d_key: Column, mean: Column, score: Column, tier: Column, words: Column) -> Column:
    number = F.when(mean, F.format_string("%.1f", score)).otherwise(F.format_string("%d", score.cast("long")))
    return F.concat(d_key, F.lit(": target "), F.when(mean, "average").otherwise("sum"), F.lit(" "), number, F.lit(", "), tier, F.lit(" ("), words, F.lit(")."))


def rendered(profiles: DataFrame, documents: dict[str, dict], context: str = "full", instrument: Instrument = SURVEY) -> DataFrame:
    """Requests with messages and their hash: one for each person and domain, rendered by expressions.

    documents: by domain its text (`about`, lines) and `items` (key, label), small configuration that becomes literals.
    context 'own' shows the domain's own target, 'full' all of the person's.
    """
    if context not in ("own", "full"):
        raise ValueError("context is own or full")
    checked_documents(documents, instrument)
    means = F.create_map(*(F.lit(x) for d in instrument.domains for x in (d.name, d.mean)))
    keys = F.create_map(*(F.lit(x) for d in instrument.domains for x in (d.name, d.key)))
    tops = F.create_map(*(F.lit(x) for d in instrument.domains for x in (d.name, d.top)))
    about = F.create_map(*(F.lit(x) for n, doc in documents.items() for x in (n, "\n".join(doc["about"]))))
    items = F.create_map(*(F.lit(x) for n, doc in documents.items() for x in (n, "\n".join(f"{i['key']}: {i['label']}" for i in doc["items"]))))
    shown = F.array(*(target_line(F.lit(d.key), F.lit(d.mean), F.col(f"`{d.key}_SCORE_TARGET`"), F.col(f"`{d.key}_TIER_CODE`"), F.col(f"`{d.key}`")) for d in instrument.domains))
    rows = profiles.withColumn("_all", F.array_join(shown, "\n")).select("patient_id", "_all")
    t = targets(profiles, instrument).join(rows, "patient_id") if context == "full" else targets(profiles, instrument).withColumn("_all", F.lit(""))
    name = F.col("disorder")
    age = F.when(F.col("AGE").isNull(), F.lit("not reported")).otherwise(F.concat(F.col("AGE").cast("long").cast("string"), F.lit(" years")))
    own = target_line(keys[name], means[name], F.col("score_target"), F.col("tier_code"), F.col("words"))
    user = F.concat_ws(
        "\n",
        F.lit('Answer with one JSON object {"scores": {item: whole number}} and nothing else.'),
        F.concat(F.lit("Items take whole numbers from 0 to "), tops[name].cast("string"), F.lit(".")),
        F.concat(F.lit("Person "), F.col("patient_id"), F.lit(", age "), age, F.lit(", recorded sex "), F.when(F.col("SEX") == 1, "male").otherwise("female"), F.lit(".")),
        F.col("_all") if context == "full" else own,
        F.concat(F.lit("Questionnaire: "), keys[name], F.lit(". The "), F.when(means[name], "average").otherwise("sum"), F.lit(" of its items has to be "), F.col("score_target").cast("string"), F.lit(", within "), F.col("allowed_min").cast("string"), F.lit(" to "), F.col("allowed_max").cast("string"), F.lit(".")),
        about[name], items[name],
    )
    made = t.select(
        F.concat_ws(":", "patient_id", name).alias("request_id"), "patient_id", "disorder", F.struct("AGE", "SEX").alias("profile"), F.struct("score_target", "tier_code", "allowed_min", "allowed_max", "valid").alias("target"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"),
    )
    return made.withColumn("prompt_sha256", F.sha2(F.to_json(F.struct("disorder", "messages", "patient_id", "profile", "request_id", "target"), {"ignoreNullFields": "false"}), 256))


def demographics_valid(age: Column, sex: Column) -> Column:
    """An age is null or a finite number from 0 on, a sex 1 or 2; never null."""
    a, s = age.cast("double"), sex.cast("double")
    return (age.isNull() | F.coalesce((a >= 0) & (a < float("inf")) & ~F.isnan(a), F.lit(False))) & F.coalesce(s.isin(1.0, 2.0), F.lit(False))


def checked_documents(documents: dict[str, dict], instrument: Instrument = SURVEY) -> dict[str, dict]:
    """The documents as they are, or an error: one of each domain, with text, and exactly the domain's items in their
    order, each with a label."""
    if set(documents) != set(instrument.names):
        raise ValueError("a document for each domain is asked for")
    for d in instrument.domains:
        doc = documents[d.name]
        if not doc.get("about") or not all(isinstance(x, str) and x.strip() for x in doc["about"]):
            raise ValueError(f"no text about {d.name}")
        items = doc.get("items") or []
        if [i.get("key") for i in items] != list(d.items):
            raise ValueError(f"items of {d.name} are missing, repeated or in another order")
        if not all(isinstance(i.get("label"), str) and i["label"].strip() for i in items):
            raise ValueError(f"an item of {d.name} has no label")
    return documents


#: Settings of a run: default (None: it has to be given), and what a value must be.
WHOLE, NUMBER, TEXT = "whole", "number", "text"
SETTINGS: dict[str, tuple[object, str, Callable]] = {
    "model": (None, TEXT, lambda x: True), "model_revision": (None, TEXT, lambda x: re.fullmatch("[0-9a-f]{40}", x.lower()) is not None), "backend": (None, TEXT, lambda x: True),
    "temperature": (1.0, NUMBER, lambda x: x >= 0), "top_p": (1.0, NUMBER, lambda x: 0 < x <= 1), "min_p": (0.0, NUMBER, lambda x: 0 <= x <= 1), "top_k": (-1, WHOLE, lambda x: x == -1 or x >= 1),
    "max_tokens": (2048, WHOLE, lambda x: x >= 1), "context_window": (8192, WHOLE, lambda x: x >= 1), "workers": (1, WHOLE, lambda x: x >= 1),
    "max_retries": (2, WHOLE, lambda x: x >= 0), "seed": (42, WHOLE, lambda x: x >= 0), "timeout": (600.0, NUMBER, lambda x: x > 0),
}


def resolved_settings(given: dict) -> dict:
    """All settings with their defaults, or an error for one that is unknown, missing or out of its bounds."""
    if extra := set(given) - set(SETTINGS):
        raise ValueError(f"unknown settings: {sorted(extra)}")
    out = {k: given.get(k, default) for k, (default, _, _) in SETTINGS.items()}
    for key, (_, kind, holds) in SETTINGS.items():
        value = out[key]
        good = isinstance(value, str) and value.strip() != "" if kind == TEXT else not isinstance(value, bool) and isinstance(value, int if kind == WHOLE else int | float) and math.isfinite(value)
        if not good or not holds(value):
            raise ValueError(f"{key} can't be {value!r}")
    if out["max_tokens"] >= out["context_window"]:
        raise ValueError("max_tokens leaves no room for a prompt")
    return out | {"model_revision": out["model_revision"].lower()}


def prompt_sizes(requests: DataFrame, count: Callable[[list[dict]], int], max_tokens: int, window: int) -> DataFrame:
    """(request_id, n_tokens, fits): tokens of whole prompts by a tokenizer that the caller names, counted by tasks;
    a prompt that doesn't leave max_tokens of the window is reported, never cut."""

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(m) for m in batch.column(1).to_pylist()], pa.int64())], names=["request_id", "n_tokens"])

    counted = requests.select("request_id", "messages").mapInArrow(sizes, "request_id string, n_tokens long")
    return counted.withColumn("fits", F.col("n_tokens") + max_tokens <= window)


def checked_prompts(requests: DataFrame, count: Callable[[list[dict]], int], max_tokens: int, window: int) -> dict:
    """Number of prompts and the longest, or an error if one doesn't fit."""
    r = prompt_sizes(requests, count, max_tokens, window).agg(F.count("*").alias("n"), F.max("n_tokens").alias("most"), F.count_if(~F.col("fits")).alias("over")).first()
    if r["over"]:
        raise ValueError(f"{r['over']} prompts don't fit; the longest has {r['most']} tokens, with {max_tokens} more of {window}")
    return {"n_requests": r["n"], "max_input_tokens": r["most"] or 0, "max_tokens": max_tokens, "context_window": window}


def bundle_complete(requests: DataFrame, n_domains: int, patient: str = "patient_id", domain: str = "disorder", profile: str = "profile") -> DataFrame:
    """(patient, n, n_domains, n_profiles, complete): every domain once, one profile."""
    p = F.to_json(F.col(profile)) if isinstance(requests.schema[profile].dataType, requests.schema.__class__) else F.col(profile)
    return requests.groupBy(patient).agg(F.count("*").alias("n"), F.count_distinct(domain).alias("n_domains"), F.count_distinct(F.coalesce(p.cast("string"), F.lit(""))).alias("n_profiles")).withColumn("complete", (F.col("n") == n_domains) & (F.col("n_domains") == n_domains) & (F.col("n_profiles") == 1))


def extension_conflicts(old: DataFrame, new: DataFrame, key: str = "request_id", digest: str = "prompt_sha256") -> DataFrame:
    """Requests of the old bundle that the new one lacks or has with other content: growth may only add."""
    n = new.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    return old.join(n, F.col(key) == F.col("_k"), "left").where(F.col("_d").isNull() | (F.col("_d") != F.col(digest))).select(key)


def latest_success(attempts: DataFrame, key: str, order: str, valid: str, values: list[str]) -> DataFrame:
    """The last valid attempt of each request."""
    return first_of(attempts.where(F.col(valid)).select(key, order, *values), [key], [F.desc(order)])


def with_success(requests: DataFrame, success: DataFrame, key: str = "request_id") -> DataFrame:
    return requests.join(success, key, "left")


def remaining(requests: DataFrame, attempts: DataFrame, limit: int, key: str = "request_id", valid: str = "valid", retryable: str = "retryable") -> DataFrame:
    """(request columns, attempts): without a success, below the limit of attempts and not failed for good."""
    tried = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.bool_or(valid).alias("_ok"), F.bool_or(~F.col(valid) & ~F.col(retryable)).alias("_final"))
    rows = requests.join(tried, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return rows.where(~F.coalesce("_ok", F.lit(False)) & ~F.coalesce("_final", F.lit(False)) & (F.col("attempts") < limit)).drop("_ok", "_final")


def completion(requests: DataFrame, success: DataFrame, key: str = "request_id") -> DataFrame:
    rows = requests.select(key).join(success.select(key, F.lit(True).alias("_s")).distinct(), key, "left")
    return rows.agg(F.count("*").alias("n_requests"), F.count("_s").alias("n_success")).withColumn("status", F.when(F.col("n_requests") == F.col("n_success"), "complete").otherwise("incomplete"))


def tier_agreement(rows: DataFrame, domain: str, achieved: str, target: str) -> DataFrame:
    """(domain, n, percent), with a row 'all' over every domain: a rollup."""
    hit = F.coalesce(F.col(achieved) == F.col(target), F.lit(False)).cast("int")
    return rows.rollup(domain).agg(F.count("*").alias("n"), (100.0 * F.sum(hit) / F.count("*")).alias("percent"), F.grouping(domain).alias("_g")).select(F.when(F.col("_g") == 1, "all").otherwise(F.col(domain)).alias("domain"), "n", "percent")


def response_table(success: DataFrame, instrument: Instrument = SURVEY, patient: str = "patient_id", domain: str = "disorder", scores: str = "scores") -> DataFrame:
    """One row for each person from successes (patient, domain, scores map): items without an answer are null. One
    aggregation by person; no column is pivoted by its data."""
    made = [F.max(F.when(F.col(domain) == d.name, F.col(scores)[c])).alias(c) for d in instrument.domains for c in d.items]
    return success.groupBy(F.col(patient).alias(instrument.id)).agg(*made)


def job_matrix(models: DataFrame, seeds: DataFrame, conditions: DataFrame) -> DataFrame:
    """Models, seeds and conditions of a study where the condition names the model (array column models). Each condition
    that a model is in takes every seed: the seeds, a handful, are gathered to a row by an aggregate."""
    listed = conditions.select("condition", F.explode("models").alias("model")).join(models, "model").withColumn("_all", F.lit(0))
    every = seeds.agg(F.sort_array(F.collect_set("seed")).alias("seeds")).withColumn("_all", F.lit(0))
    return listed.join(every, "_all").select("model", F.explode("seeds").alias("seed"), "condition")
