"""Request and message logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.scans import PER_CHUNK, queue_pairs

# Static files, trackers and header prefixes that are noise.
STATIC = r"(?i)\.(js|css|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot|map)(\?|$)"
TRACKERS = (
    "google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.net", "facebook.com/tr", "hotjar.com", "segment.io", "segment.com",
    "mixpanel.com", "amplitude.com", "sentry.io", "newrelic.com", "datadoghq.com", "cdn.jsdelivr.net", "fonts.googleapis.com", "fonts.gstatic.com",
)
NOISE = ("accept", "accept-encoding", "accept-language", "connection", "host", "user-agent", "sec-", "upgrade-insecure-requests")


def is_api(url: Column, content_type: Column) -> Column:
    tracker = F.lit(False)
    for t in TRACKERS:
        tracker = tracker | url.contains(t)
    api = content_type.contains("application/json") | url.contains("graphql") | url.contains("/gql") | url.rlike(r"(?i)/api/|/v\d+/")
    return ~url.rlike(STATIC) & ~tracker & F.coalesce(api, F.lit(False))


def is_graphql(url: Column, body: Column) -> Column:
    query = F.try_variant_get(F.try_parse_json(body), "$.query", "string")
    return url.contains("graphql") | url.contains("/gql") | F.coalesce(query != "", F.lit(False))


def first_of_each(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("c")).select(*keys, "c.*")


def useful_headers(headers: Column) -> Column:
    def noisy(k: Column) -> Column:
        hit = F.lit(False)
        for p in NOISE:
            hit = hit | F.lower(k).startswith(p)
        return hit

    return F.map_filter(headers, lambda k, _: ~noisy(k))


def query_params(url: Column) -> Column:
    return F.str_to_map(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("&"), F.lit("="))


def pair_requests(requests: DataFrame, responses: DataFrame, url: str, at: str, per_chunk: int = PER_CHUNK) -> DataFrame:
    """(url, request, response, duration): a response answers the oldest request of its URL that has none by then.

    A response when no request is outstanding is dropped; at one instant requests come first, then the order of ids.
    """
    log = requests.select(url, F.col("id"), F.col(at), F.lit(True).alias("__asks")).unionByName(responses.select(url, F.col("id"), F.col(at), F.lit(False).alias("__asks")))
    log = queue_pairs(log.withColumn("__last", ~F.col("__asks")), url, at, [at, "__last", "id"], "__asks", per_chunk)
    a = log.where("__asks").select(url, "__k", F.col("id").alias("request"), F.col(at).alias("t0"))
    b = log.where("not __asks and __k is not null").select(url, "__k", F.col("id").alias("response"), F.col(at).alias("t1"))
    return a.join(b, [url, "__k"], "left").select(url, "request", "response", (F.col("t1") - F.col("t0")).alias("duration"))


def socket_summary(messages: DataFrame, connection: str, order: list[str], most: int) -> DataFrame:
    """Per connection: messages sent and received among the first ``most`` of all; connections without any are kept."""
    kept = messages.orderBy(*order).limit(most).groupBy(connection).agg(F.count_if(F.col("direction") == "sent").alias("sent"), F.count_if(F.col("direction") == "received").alias("received"))
    out = messages.select(connection).distinct().join(kept, connection, "left")
    return out.select(connection, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sent", "received")])


def payload(text: Column) -> Column:
    """A JSON text as a variant, other text as a string variant."""
    return F.coalesce(F.try_parse_json(text), F.to_variant_object(F.struct(text.alias("raw"))))
