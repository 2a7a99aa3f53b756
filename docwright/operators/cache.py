"""Cache semantics over tables (key, value, expires_at), and request limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key

#: Seconds that responses and embeddings stay, and requests a minute.
RESPONSE_TTL, EMBEDDING_TTL, REQUESTS_PER_MINUTE = 3_600, 86_400, 10


def response_key(question: Column, mode: Column) -> Column:
    """Parity form: neither top_k nor threshold is part of the key."""
    return cache_key("response", F.concat_ws("::", question, mode))


def full_response_key(question: Column, mode: Column, top_k: Column, threshold: Column) -> Column:
    return cache_key("response", F.concat_ws("::", question, mode, top_k.cast("string"), F.coalesce(threshold.cast("string"), F.lit("-"))))


def live(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (qid, key) with their live value and whether it was a hit; keys written twice give the value that lives longest."""
    newest = live(cache, now).groupBy("key").agg(F.max_by("value", "expires_at").alias("value"))
    return requests.join(newest, "key", "left").withColumn("hit", F.col("value").isNotNull())


def entries(rows: DataFrame, now: Column, ttl: int) -> DataFrame:
    """(key, value, expires_at) of rows (key, value)."""
    return rows.select("key", "value", (now + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))


def invalidate(cache: DataFrame, prefix: str = "response:") -> DataFrame:
    """What is left after an ingest; both kinds of ingest drop the same prefix."""
    return cache.where(~F.col("key").startswith(prefix))


def over_limit(events: DataFrame, limit: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """(user_id, minute, requests, rejected) of every client's every minute."""
    per = events.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("requests"))
    return per.withColumn("rejected", F.greatest(F.col("requests") - limit, F.lit(0)))
