"""URL filter: host and path rules, and for the rest a logistic regression on hashed n-grams.

Features are the character n-grams (3 to 5 bytes) of host and path, hashed apart into
``2 ** bits`` buckets.  The model is fitted on a small labelled URL table
(``url_labels``, or the caller's own) that has nothing to do with the rules; scoring is
one Arrow pass over host and path with no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import slices_by_chars

SIZES = (3, 4, 5)


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    bits: int


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(name, verdict), or null.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def features(texts: list[str], bits: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and buckets of all n-grams of all texts, one rolling pass for each size."""
    raw = [f"^{t}$".encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(raw)), lengths)
    rows, buckets = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, salt * 97 + n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = row[: len(h)] == row[n - 1 :]
        rows.append(row[: len(h)][inside])
        buckets.append((h[inside] >> np.uint64(64 - bits)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def design(hosts: list[str], paths: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values (each row's n-grams share a unit of weight)."""
    parts = [features(hosts, bits, 1), features(paths, bits, 2)]
    row, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    count = np.bincount(row, minlength=len(hosts))
    return row, bucket, 1.0 / np.sqrt(np.maximum(count[row], 1))


def fit(labelled: pd.DataFrame, bits: int = 15, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5) -> Model | None:
    """Full-batch gradient descent on ``labelled(host, path, block)``; the same rows give the same model.

    None where the table is empty; a constant model where it has one class only.
    """
    if labelled.empty:
        return None
    labelled = labelled.sort_values(["host", "path", "block"], kind="stable")
    y = labelled["block"].to_numpy(dtype=np.float64)
    if y.min() == y.max():
        return Model(np.zeros(1 << bits), 30.0 if y[0] else -30.0, bits)
    row, bucket, value = design(labelled["host"].tolist(), labelled["path"].tolist(), bits)
    weights, bias = np.zeros(1 << bits), 0.0
    weight_of = 1 / len(y)
    for _ in range(rounds):
        z = np.bincount(row, weights[bucket] * value, len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight_of
        weights -= rate * (np.bincount(bucket, error[row] * value, len(weights)) + decay * weights)
        bias -= rate * error.sum()
    return Model(weights, bias, bits)


def scorer(model: Model | None):
    """Probability that a URL is to be blocked; 0 where nothing was learnt."""

    def run(batches):
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            p = np.zeros(len(hosts))
            if model is not None:
                for lo, hi in slices_by_chars(np.array([len(h) + len(q) for h, q in zip(hosts, paths, strict=True)]), 400_000):
                    row, bucket, value = design(hosts[lo:hi], paths[lo:hi], model.bits)
                    z = np.bincount(row, model.weights[bucket] * value, hi - lo) + model.bias
                    p[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "block_score"])

    return run


def judged_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, found``: the parts of each URL and the rule that fits it."""
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))


def filter_urls(parts: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every row of ``judged_urls``.

    A null URL, or one without ``://``, has an empty host and path and is judged by the
    model's bias alone.  URLs of any length are judged whole.  Repeated rows give
    repeated rows; an empty table an empty one; other columns of the pages, whatever
    their names, do not go along.
    """
    flat = parts.select("page_id", "host", "path", F.col("found.name").alias("rule"), F.col("found.verdict").alias("ruled"))
    schema = ", ".join(f"`{n}` {t}" for n, t in flat.dtypes)
    scored = flat.mapInArrow(scorer(model), f"{schema}, block_score double")
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
