"""Summaries of requests: rates, latencies, and checks of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_summary(requests: DataFrame, seconds: float, by: str = "service") -> DataFrame:
    """Counts, rates and latencies of each service, from (service, latency_ms, ok).

    Latencies are those of successes; their sum is divided by all requests, and so is the throughput.
    """
    ok = F.when(F.col("ok"), F.col("latency_ms"))
    total = F.count(F.lit(1))
    return requests.groupBy(by).agg(
        total.alias("total"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        (F.count_if("ok") * 100.0 / total).alias("success_percent"),
        (total / F.lit(float(seconds))).alias("per_second"),
        F.min(ok).alias("min_ms"),
        F.max(ok).alias("max_ms"),
        (F.coalesce(F.sum(ok), F.lit(0.0)) / total).alias("avg_ms"),
    )


def latency_quantiles(requests: DataFrame, by: str = "service", *, exact: bool = False) -> DataFrame:
    """p50, p90 and p99 of successes; from a bounded sketch unless `exact`."""
    ok = F.when(F.col("ok"), F.col("latency_ms"))
    at = F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))
    q = F.percentile(ok, at) if exact else F.percentile_approx(ok, [0.5, 0.9, 0.99], 10000)
    return requests.groupBy(by).agg(q.alias("q")).select(by, *(F.col("q")[k].alias(n) for k, n in enumerate(("p50_ms", "p90_ms", "p99_ms"))))


def verify_reads(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(kind, reads, incorrect) from expected (key, kind) and actual (key, value).

    A written key has to be there; a deleted and an unwritten one must not.
    """
    got = expected.join(actual.select("key", F.lit(True).alias("there")), "key", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return got.groupBy("kind").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("there") != (F.col("kind") == "W")).alias("incorrect"))
