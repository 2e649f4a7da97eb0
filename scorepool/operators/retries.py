"""Retry logs two levels deep: the attempts of a slot, and the transport tries of each attempt, kept nested in the slot's row.

Sums and checks are higher-order functions over the nested arrays: no level is exploded, and a slot's row is all that its check needs.

A slot's attempts are array<struct<attempt, status, request_seconds, input_tokens, output_tokens, transport_request_count,
transports: array<struct<transport_attempt, status, request_seconds, backoff_seconds_after, retryable>>>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorepool.constants import ROW_TOLERANCE

MOST_ATTEMPTS, MOST_TRIES = 8, 3


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(of(x).cast("double"), F.lit(0.0)))


def _tries(attempt: Column) -> Column:
    """An attempt's tries; one without a log was sent once, in its own time, and failed if the endpoint did."""
    alone = F.struct(
        F.lit(1).alias("transport_attempt"), F.when(attempt["status"] == "endpoint_error", "error").otherwise("success").alias("status"), attempt["request_seconds"].cast("double").alias("request_seconds"),
        F.lit(0.0).alias("backoff_seconds_after"), F.lit(False).alias("retryable"),
    )
    held = F.transform(
        F.coalesce(attempt["transports"], F.array()),
        lambda t: F.struct(
            t["transport_attempt"].cast("int").alias("transport_attempt"), t["status"].alias("status"), t["request_seconds"].cast("double").alias("request_seconds"),
            t["backoff_seconds_after"].cast("double").alias("backoff_seconds_after"), t["retryable"].alias("retryable"),
        ),
    )
    return F.when(F.size(held) > 0, held).otherwise(F.array(alone))


def nested_rollup(attempts: Column) -> Column:
    """struct of a slot's attempts, requests, failed requests, attempts that were sent again, seconds of requests and of waiting, tokens,
    and the number of the attempt that was accepted (null if none was)."""
    logs = F.transform(attempts, _tries)
    flat = F.flatten(logs)
    accepted = F.filter(attempts, lambda a: a["status"] == "accepted")
    tokens = lambda c: F.aggregate(attempts, F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a[c].cast("long"), F.lit(0)))
    return F.struct(
        F.size(attempts).alias("attempts"), F.size(flat).alias("requests"), F.size(F.filter(flat, lambda t: t["status"] != "success")).alias("failed_requests"), F.size(F.filter(logs, lambda t: F.size(t) > 1)).alias("retried_attempts"),
        _total(flat, lambda t: t["request_seconds"]).alias("request_seconds"), _total(flat, lambda t: t["backoff_seconds_after"]).alias("backoff_seconds"),
        tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"), F.get(accepted, F.lit(0))["attempt"].cast("int").alias("accepted_attempt"),
    )


def _first(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), F.lit(text)).otherwise(out)
    return out


def _attempt_issue(a: Column, tolerance: float) -> Column:
    t = _tries(a)
    n = F.size(t)
    last = F.element_at(t, -1)
    before = F.slice(t, 1, n - 1)
    return _first(
        (F.exists(F.transform(t, lambda x, i: x["transport_attempt"] != i + 1), lambda wrong: wrong), "tries are not numbered 1, 2, 3 ..."),
        (n > MOST_TRIES, "too many tries"),
        (F.exists(t, lambda x: (x["request_seconds"] < 0) | (x["backoff_seconds_after"] < 0)), "a time is negative"),
        (F.exists(before, lambda x: x["status"] == "success"), "a try follows a successful one"),
        (F.exists(before, lambda x: ~F.coalesce(x["retryable"], F.lit(False))), "a try follows an error that is not retryable"),
        (last["backoff_seconds_after"] > 0, "the last try is followed by a wait"),
        ((last["status"] == "success") == (a["status"] == "endpoint_error"), "the last try and the attempt disagree"),
        (F.coalesce(a["transport_request_count"], n) != n, "the stated number of requests differs"),
        (F.abs(F.coalesce(a["request_seconds"], F.lit(0.0)) - _total(t, lambda x: x["request_seconds"])) > tolerance, "the stated seconds differ"),
    )


def nested_issue(attempts: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    """The first rule that a slot's log breaks, of the slot as a whole or of its first attempt at fault; null where all hold."""
    n = F.size(attempts)
    found = F.transform(attempts, lambda a, i: F.struct((i + 1).alias("at"), _attempt_issue(a, tolerance).alias("issue")))
    first = F.get(F.filter(found, lambda x: x["issue"].isNotNull()), F.lit(0))
    return F.coalesce(
        _first(
            (attempts.isNull() | (n == 0), "no attempts"),
            (F.exists(F.transform(attempts, lambda a, i: a["attempt"] != i + 1), lambda wrong: wrong), "attempts are not numbered 1, 2, 3 ..."),
            (n > MOST_ATTEMPTS, "too many attempts"),
            (F.exists(F.slice(attempts, 1, F.greatest(n - 1, F.lit(0))), lambda a: a["status"] == "accepted"), "an attempt follows the accepted one"),
        ),
        F.concat(F.lit("attempt "), first["at"].cast("string"), F.lit(": "), first["issue"]),
    )
