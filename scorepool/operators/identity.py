"""Who made a reply and how: provenance of candidates, identity of models and services, versions of a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorepool.constants import CANDIDATES, FRAMES_MAX, REWARD_WEIGHTS
from scorepool.operators.quality import first_issue

#: What a candidate's provenance must state.
PROVENANCE = "struct<parse_status: string, semantic_repair_applied: boolean, wrapped_free_text: boolean, surrounding_free_text: boolean, response_envelope: string>"
ENVELOPES = ("raw_json", "single_markdown_json_fence")
FRAME_POLICY = "one_to_sixteen_data_images_without_service_resampling"


def provenance_issue(p: Column) -> Column:
    """Why a candidate was not read straight from a structured reply; null if it was. Missing flags count as broken."""
    flags = ("semantic_repair_applied", "wrapped_free_text", "surrounding_free_text")
    return first_issue(
        (p.isNull(), "provenance is missing"),
        (~p["parse_status"].eqNullSafe(F.lit("valid_json_candidate")), "parse_status is not valid_json_candidate"),
        *[(~p[f].eqNullSafe(F.lit(False)), f"{f} must be false") for f in flags],
        (~F.coalesce(p["response_envelope"].isin(*ENVELOPES), F.lit(False)), "response_envelope is unknown"),
    )


def generation_issue(attempt: Column, expected: dict, protocol: str, frames: Column) -> Column:
    """Why an attempt's service is not the configured one. expected: field of server_metrics to value; attempt has status,
    transport_request_count, server_metrics (map of texts) and visual_input_frames."""
    said = attempt["server_metrics"]
    same = lambda name, value: said[name].eqNullSafe(F.lit(str(value)))
    return first_issue(
        (~F.coalesce(attempt["status"].isin("accepted", "parse_rejected"), F.lit(False)), "the attempt failed on the way"),
        (~attempt["transport_request_count"].eqNullSafe(F.lit(1).cast("int")), "the attempt was sent more than once"),
        (said.isNull(), "the reply lacks its service's identity"),
        (~same("server_protocol_version", protocol), "the service has another protocol version"),
        (~same("configured_max_frames", FRAMES_MAX), "the service has another frame cap"),
        *[(~same(name, value), f"{name} differs from the configuration") for name, value in expected.items()],
        (~attempt["visual_input_frames"].eqNullSafe(frames), "the service saw another number of frames"),
    )


def generation_issues(slots: DataFrame, expected: dict, protocol: str, key: str = "sample_key") -> DataFrame:
    """(key, candidate_index, attempt, issue) of broken attempts; slots have attempts, an array, and frames."""
    each = slots.select(key, "candidate_index", "frames", F.posexplode("attempts").alias("_at", "_a"))
    return each.select(key, "candidate_index", (F.col("_at") + 1).alias("attempt"), generation_issue(F.col("_a"), expected, protocol, F.col("frames")).alias("issue")).where("issue is not null")


def advertised(models: list[dict], model_id: str) -> dict:
    """The one entry of a service's model list that has the id, checked for its frame cap and policy."""
    found = [m for m in models if isinstance(m, dict) and m.get("id") == model_id]
    if len(found) != 1:
        raise ValueError(f"the service must list {model_id!r} exactly once, not {len(found)} times")
    cap = found[0].get("max_frames")
    if isinstance(cap, bool) or cap != FRAMES_MAX:
        raise ValueError(f"the service must take {FRAMES_MAX} frames")
    if found[0].get("frame_input_policy") != FRAME_POLICY:
        raise ValueError("the service must not resample frames")
    return found[0]


def differing(expected: dict, observed: dict, path: str = "") -> list[str]:
    """Dotted names under which two nested mappings differ, in order of name."""
    out = []
    for name in sorted({*expected, *observed}):
        a, b, at = expected.get(name), observed.get(name), f"{path}{name}"
        if isinstance(a, dict) and isinstance(b, dict):
            out += differing(a, b, f"{at}.")
        elif type(a) is not type(b) or a != b:
            out.append(at)
    return out


#: Settings that every formal run has.
FIXED = {"candidates": CANDIDATES, "max_frames": FRAMES_MAX, "reward_weights": REWARD_WEIGHTS}


def check_config(config: dict) -> None:
    """An error that names every fixed setting a configuration departs from."""
    if bad := differing(FIXED, {k: config.get(k) for k in FIXED}):
        raise ValueError("a formal run fixes: " + ", ".join(bad))
