"""Plug-in interfaces for model-backed stages, and stand-ins that need no model."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool.constants import CANDIDATES
from scorepool.functions.text import stable_hash

#: Semantic attempts for each slot, and transport tries for each attempt.
ATTEMPTS, TRIES = 8, 3


class Generator(Protocol):
    def __call__(self, sample: dict, candidate_index: int, attempt: int, seed: int) -> str: ...


class TextEncoder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def request_seed(base: int, video_id, index, attempt):
    """A seed for each request, derived from the video, so reruns repeat it."""
    return F.lit(base) + stable_hash(video_id, 10**6) + 10_000 * index + attempt - 1


def requests(samples: DataFrame, base_seed: int) -> DataFrame:
    """A row for each sample and slot with its first seed."""
    slots = samples.withColumn("candidate_index", F.explode(F.sequence(F.lit(1), F.lit(CANDIDATES))))
    return slots.withColumn("seed", request_seed(base_seed, F.col("video_id"), F.col("candidate_index"), F.lit(1)))


def generate(slots: DataFrame, generator: Generator, accept: Callable[[str], str], partitions: int | None = None) -> DataFrame:
    """Runs a generator until `accept` gives no reason against the reply or attempts are used up: one row for each attempt.

    Requests carry derived seeds, so a repeated task asks the same again.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for s in batch.to_dict("records"):
                for attempt in range(1, ATTEMPTS + 1):
                    began = time.perf_counter()
                    reply = generator(s, int(s["candidate_index"]), attempt, int(s["seed"]) + attempt - 1)
                    reason = accept(reply)
                    rows.append((s["sample_key"], int(s["candidate_index"]), attempt, "parse_rejected" if reason else "accepted", reason, reply, time.perf_counter() - began))
                    if not reason:
                        break
            yield pd.DataFrame(rows, columns=["sample_key", "candidate_index", "attempt", "status", "reason", "reply", "request_seconds"])

    dealt = slots.repartition(partitions) if partitions else slots
    return dealt.mapInPandas(run, "sample_key string, candidate_index int, attempt int, status string, reason string, reply string, request_seconds double")


def replay(replies: dict[tuple[str, int, int], str]) -> Generator:
    """A generator that reads recorded replies by (sample_key, candidate_index, attempt)."""
    return lambda sample, index, attempt, seed: replies.get((sample["sample_key"], index, attempt), "")


def retryable(error: Exception) -> bool:
    if isinstance(error, urllib.error.HTTPError):
        return error.code in (408, 409, 425, 429) or error.code >= 500
    return isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError))


def post(url: str, payload: dict, timeout: float = 300.0, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, open_url=urllib.request.urlopen) -> tuple[dict, list[dict]]:
    """Posts JSON with a linear, capped wait between tries; the reply and a log of tries."""
    log = []
    for k in range(1, tries + 1):
        began = time.perf_counter()
        try:
            request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
            with open_url(request, timeout=timeout) as reply:
                body = json.loads(reply.read())
            log.append({"transport_attempt": k, "status": "ok", "request_seconds": time.perf_counter() - began})
            return body, log
        except Exception as e:
            again = retryable(e) and k < tries
            wait = min(8.0, 1.5 * k) if again else 0.0
            log.append({"transport_attempt": k, "status": "error", "error_type": type(e).__name__, "retryable": retryable(e), "backoff_seconds_after": wait, "request_seconds": time.perf_counter() - began})
            if not again:
                raise
            sleep(wait)
    raise RuntimeError("no try was made")
