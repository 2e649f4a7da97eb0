"""Run configurations of a matrix of datasets and models, seeds, and the environment a run is made in."""

from __future__ import annotations

import copy
import platform
import random
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from scorepool.functions.text import stable_hash
from scorepool.sinks import fingerprint, portable


def matrix(base: dict, datasets: dict[str, dict], models: dict[str, dict], output: str) -> Iterator[dict]:
    """A configuration for each dataset and model, in order: base, then both parts, an output folder of its own, and a fingerprint."""
    for d, dataset in datasets.items():
        for m, model in models.items():
            held = copy.deepcopy(base) | {"dataset": {"name": d} | dataset, "model": {"name": m} | model, "output": portable(f"{output.rstrip('/')}/{d}/{m}")}
            yield held | {"fingerprint": fingerprint(held)}


def request_seed(video_id: Column, candidate_index: Column, attempt: Column, base: int) -> Column:
    """The seed of one request: by video, slot and attempt, the same on every machine."""
    return F.lit(base) + stable_hash(video_id, 1_000_000).cast("long") + 10_000 * candidate_index + attempt - 1


def seed_everything(seed: int) -> np.random.Generator:
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)


def environment(spark) -> dict:
    """What results may depend on besides data and configuration."""
    return {
        "python": sys.version.split()[0], "platform": platform.platform(), "numpy": np.__version__, "spark": spark.version,
        "ansi": spark.conf.get("spark.sql.ansi.enabled"), "time_zone": spark.conf.get("spark.sql.session.timeZone"), "master": spark.sparkContext.master,
    }
