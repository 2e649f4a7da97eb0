"""Contracts of whole result rows and of summary rows: ordered checks as one expression, first failure named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorepool.constants import CANDIDATES, IDENTITY_TOLERANCE, LOWER_IS_BETTER, MATRIX_TOLERANCE, ROW_TOLERANCE
from scorepool.functions.sampling import accounting_issue
from scorepool.operators.quality import first_issue, identity_gap, unit

USAGE = "struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>"
ATTEMPT = "struct<attempt: int, prompt_kind: string, status: string, request_seconds: double, returned_model_id_conflict: boolean, visual_input_frames: int>"
SLOT = f"struct<candidate_index: int, terminal_status: string, candidate_id: string, request_count: int, transport_request_count: int, request_seconds: double, usage: {USAGE}, attempts: array<{ATTEMPT}>>"
#: Whole-pool and first-candidate counts of a row's efficiency, by what they must equal: (slot field, summed over all slots or C1's own).
_SLOT_FIELDS = {"requests": "transport_request_count", "semantic_attempts": "request_count", "input_tokens": "input_tokens", "output_tokens": "output_tokens", "total_tokens": "total_tokens"}
COUNTS = {f"{who}_{what}": (field, who != "direct") for who in ("generation", "direct", "best") for what, field in _SLOT_FIELDS.items()}
SECONDS = ("sampling_seconds", "reward_encoding_seconds", "reward_scoring_seconds", "selection_seconds", "direct_seconds", "best_seconds", "generation_seconds", "metric_seconds", "pipeline_seconds")
EFFICIENCY = (
    "struct<" + "".join(f"{n}: bigint, " for n in COUNTS) + "sampled_frames: int, " + "".join(f"{n}: double, " for n in SECONDS)
    + f"seconds_by_slot: array<double>, usage_by_slot: array<{USAGE}>, scoring_seconds_by_slot: array<double>>"
)
#: The columns that result_issue reads.
RESULT = (
    "sample_key string, video_id string, experiment_version string, prompt_version string, requested_slots int, protocol_fingerprint string, generation_source string, "
    "sampling struct<source_kind: string, fallback_used: boolean, eligible: boolean, selected_indices: array<int>, bin_ids: array<int>>, "
    f"slots array<{SLOT}>, candidates array<struct<candidate_index: int, candidate_id: string, reward: double>>, valid_slots int, full_pool boolean, direct_id string, best_id string, efficiency {EFFICIENCY}"
)
_ATTEMPTS_MOST = 8


def _sum(values: Column, field) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(field(x).cast("double"), F.lit(0.0)))


def _far(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) > ROW_TOLERANCE)


def _slot_issue(slot: Column, candidates: Column, frames: Column) -> Column:
    attempts = slot["attempts"]
    held = F.filter(candidates, lambda c: c["candidate_index"] == slot["candidate_index"])
    valid = slot["terminal_status"] == "valid"
    accepted = F.size(F.filter(attempts, lambda a: a["status"] == "accepted"))
    numbered = F.transform(attempts, lambda a, i: (a["attempt"] == i + 1) & (a["prompt_kind"] == F.when(i == 0, "base_generation").otherwise("validation_retry")))
    known = F.forall(attempts, lambda a: a["status"].isin("accepted", "parse_rejected"))
    answered = F.forall(attempts, lambda a: ~F.coalesce(a["returned_model_id_conflict"], F.lit(False)) & (a["visual_input_frames"] == frames))
    usage = slot["usage"]
    return first_issue(
        (~slot["terminal_status"].isin("valid", "failed"), "a slot has an invalid terminal status"),
        (valid != (F.size(held) == 1), "valid slots and scored candidates do not match"),
        (~slot["candidate_id"].eqNullSafe(F.get(held, F.lit(0))["candidate_id"]), "slot and candidate identifiers do not match"),
        (attempts.isNull() | (F.size(attempts) == 0), "a slot has no attempts"),
        (F.size(attempts) > _ATTEMPTS_MOST, "a slot has too many attempts"),
        (~F.forall(numbered, lambda ok: F.coalesce(ok, F.lit(False))), "attempts are misnumbered or of the wrong prompt kind"),
        (~F.coalesce(known, F.lit(False)), "an attempt has an invalid status"),
        (~F.coalesce(answered, F.lit(False)), "a reply disagrees about its model or frames"),
        (valid != (accepted == 1), "slot status and accepted attempt disagree"),
        ((accepted > 0) & (F.element_at(attempts, -1)["status"] != "accepted"), "an accepted attempt is not the last"),
        (slot["request_count"] != F.size(attempts), "request_count differs from the attempts"),
        (_far(slot["request_seconds"], _sum(attempts, lambda a: a["request_seconds"])), "request_seconds differ from the attempts"),
        (usage["total_tokens"] != usage["input_tokens"] + usage["output_tokens"], "slot usage does not add up"),
    )


def _efficiency_issue(e: Column, slots: Column, frames: Column) -> Column:
    first = F.get(slots, F.lit(0))
    field = lambda name: (lambda slot: slot["usage"][name] if name.endswith("tokens") else slot[name])
    checks = [(e.isNull(), "efficiency is missing")]
    for name, (of, whole) in COUNTS.items():
        expected = _sum(slots, field(of)) if whole else field(of)(first).cast("double")
        checks.append((~e[name].cast("double").eqNullSafe(expected), f"efficiency.{name} differs from " + ("the slots" if whole else "C1")))
    checks += [(~e["sampled_frames"].eqNullSafe(frames), "efficiency.sampled_frames differs from the sampling")]
    checks += [(e[f"{p}_total_tokens"] != e[f"{p}_input_tokens"] + e[f"{p}_output_tokens"], f"efficiency.{p}_total_tokens does not add up") for p in ("generation", "direct", "best")]
    checks += [(e[n].isNull() | (e[n] < 0) | F.isnan(e[n]) | (e[n] == float("inf")), f"efficiency.{n} is not a duration") for n in SECONDS]
    spent = _sum(slots, lambda s: s["request_seconds"])
    online = e["sampling_seconds"] + spent + e["reward_encoding_seconds"] + e["reward_scoring_seconds"] + e["selection_seconds"]
    least = e["sampling_seconds"] + e["generation_seconds"] + e["reward_encoding_seconds"] + e["reward_scoring_seconds"] + e["metric_seconds"] + e["selection_seconds"]
    scoring = e["scoring_seconds_by_slot"]
    checks += [
        (_far(e["direct_seconds"], e["sampling_seconds"] + first["request_seconds"]), "efficiency.direct_seconds is inconsistent"),
        (_far(e["best_seconds"], online), "efficiency.best_seconds is inconsistent"),
        (e["generation_seconds"] + ROW_TOLERANCE < spent, "efficiency.generation_seconds is shorter than its requests"),
        (e["pipeline_seconds"] + ROW_TOLERANCE < least, "efficiency.pipeline_seconds is shorter than its parts"),
        (e["seconds_by_slot"].isNull() | (F.size(e["seconds_by_slot"]) != CANDIDATES), "seconds by slot are invalid"),
        (F.exists(F.zip_with(e["seconds_by_slot"], slots, lambda x, s: _far(x, s["request_seconds"])), lambda far: far), "seconds by slot differ from the slots"),
        (~e["usage_by_slot"].eqNullSafe(F.transform(slots, lambda s: s["usage"])), "usage by slot differs from the slots"),
        (scoring.isNull() | (F.size(scoring) != CANDIDATES) | F.exists(scoring, lambda x: x < 0), "scoring seconds by slot are invalid"),
        (_far(e["reward_scoring_seconds"], _sum(scoring, lambda x: x)), "scoring seconds do not add up"),
    ]
    return first_issue(*checks)


def result_issue(fingerprint: str, experiment: str | None = None, prompt: str | None = None) -> Column:
    """The first way in which a result row (of RESULT's columns) breaks its contract; null if none. Versions are checked where given."""
    c = F.col
    sampling, slots, candidates = c("sampling"), c("slots"), c("candidates")
    frames, ids = F.size(sampling["selected_indices"]), F.transform(candidates, lambda x: x["candidate_id"])
    in_order = F.transform(slots, lambda s, i: s["candidate_index"] == i + 1)
    valid = F.size(F.filter(slots, lambda s: s["terminal_status"] == "valid"))
    best = F.array_max(F.transform(candidates, lambda x: F.struct(F.bround(x["reward"], 6).alias("r"), (-x["candidate_index"]).alias("i"), x["candidate_id"].alias("id"))))["id"]
    first = F.get(F.filter(candidates, lambda x: x["candidate_index"] == 1), F.lit(0))["candidate_id"]
    version = lambda name, want: [(~c(name).eqNullSafe(F.lit(want)), f"{name} is invalid")] if want is not None else []
    head = first_issue(
        *version("experiment_version", experiment),
        (~c("protocol_fingerprint").eqNullSafe(F.lit(fingerprint)), "protocol_fingerprint is invalid"),
        *version("prompt_version", prompt),
        (~c("generation_source").eqNullSafe(F.lit("multimodal_model")), "generation source is not a multimodal model"),
        (sampling.isNull(), "sampling is missing"),
        (~F.coalesce(sampling["source_kind"].isin("video", "image_dir", "npz"), F.lit(False)), "sampling did not use a real source"),
        (sampling["fallback_used"], "sampling used a fallback"),
        (~sampling["eligible"].eqNullSafe(F.lit(True)), "sampling is not eligible"),
    )
    frame = accounting_issue(sampling["selected_indices"], sampling["bin_ids"])
    shape = first_issue(
        (~c("requested_slots").eqNullSafe(F.lit(CANDIDATES)), "the requested slot count is invalid"),
        (slots.isNull() | (F.size(slots) != CANDIDATES), "slot outcomes are incomplete"),
        (candidates.isNull(), "candidates is missing"),
        (F.size(F.array_distinct(F.transform(candidates, lambda x: x["candidate_index"]))) != F.size(candidates), "candidate indices are duplicated"),
        (~F.forall(in_order, lambda ok: F.coalesce(ok, F.lit(False))), "slot outcomes are not ordered C1-C4"),
    )
    each = F.get(F.array_compact(F.transform(slots, lambda s: _slot_issue(s, candidates, frames))), F.lit(0))
    tail = first_issue(
        (F.size(candidates) != valid, "candidates do not match valid slots"),
        (~c("valid_slots").eqNullSafe(valid), "valid_slots does not match the slots"),
        (~c("full_pool").eqNullSafe(valid == CANDIDATES), "full_pool does not match the slots"),
        (F.exists(ids, lambda x: x.isNull() | (x == "")), "a candidate has no identifier"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "candidate identifiers are duplicated"),
        (F.exists(candidates, lambda x: ~F.coalesce(unit(x["reward"]), F.lit(False))), "a reward is outside 0 to 1"),
        (~c("direct_id").eqNullSafe(first), "the direct candidate is not C1"),
        (~c("best_id").eqNullSafe(best), "the selected candidate is not the best"),
    )
    return F.coalesce(head, frame, shape, each, _efficiency_issue(c("efficiency"), slots, frames), tail)


def with_issues(results: DataFrame, fingerprint: str, experiment: str | None = None, prompt: str | None = None) -> DataFrame:
    return results.withColumn("issue", result_issue(fingerprint, experiment, prompt))


def resume_issues(results: DataFrame, samples: DataFrame, fingerprint: str, key: str = "sample_key") -> DataFrame:
    """Rows that forbid resuming: broken ones, and ones of no current sample (key, issue)."""
    broken = with_issues(results, fingerprint).where("issue is not null").select(key, "issue")
    strange = results.join(samples.select(key), key, "left_anti").select(key, F.lit("not a current sample").alias("issue"))
    return broken.unionByName(strange)


def matrix_row_issue(metrics: tuple[str, ...], methods: tuple[str, ...] = ("direct", "best_of_4")) -> Column:
    """The first way in which a matrix row breaks its contract: columns <method>_ok, _success_rate, _cond_<metric>, _eff_<metric>, and requested."""
    c = F.col
    checks = [(c("requested").isNull() | (c("requested") <= 0), "requested is not positive")]
    for m in methods:
        ok, rate = c(f"{m}_ok"), c(f"{m}_success_rate")
        checks += [
            (ok.isNull() | (ok < 0) | (ok > c("requested")), f"{m} successes are out of range"),
            (rate.isNull() | (F.abs(rate - ok / c("requested")) > MATRIX_TOLERANCE), f"{m} success rate does not follow from its counts"),
        ]
        for x in metrics:
            cond, eff = c(f"{m}_cond_{x}"), c(f"{m}_eff_{x}")
            checks += [
                ((ok == 0) != cond.isNull(), f"{m} {x}: a conditional mean needs successes"),
                (~F.coalesce(unit(eff), F.lit(False)), f"{m} {x}: the effective mean is outside 0 to 1"),
                (identity_gap(cond, eff, rate, x) > IDENTITY_TOLERANCE, f"{m} {x}: effective and conditional means disagree"),
            ]
    for narrow, wide in zip(methods, methods[1:], strict=False):
        checks.append((c(f"{narrow}_success_rate") > c(f"{wide}_success_rate") + MATRIX_TOLERANCE, f"{narrow} succeeds more often than {wide}"))
    if "reward" in metrics and "reward" not in LOWER_IS_BETTER:
        checks.append((c(f"{methods[0]}_eff_reward") > c(f"{methods[-1]}_eff_reward") + MATRIX_TOLERANCE, "the first candidate beats the best"))
    return first_issue(*checks)


def matrix_row(summary: DataFrame, dataset: str, model: str, metrics: tuple[str, ...]) -> DataFrame:
    """One wide row of a run's method summary, keyed by dataset and model."""
    names = ["ok", "success_rate", *[f"{k}_{m}" for m in metrics for k in ("cond", "eff")]]
    pick = [F.max(F.when(F.col("method") == m, F.col(n))).alias(f"{m}_{n}") for m in ("direct", "best_of_4") for n in names]
    return summary.agg(F.max("requested").alias("requested"), *pick).select(F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), "*")


def server_metrics(reply: Column) -> Column:
    """Scalar entries of a reply variant's server_metrics as text, with the returned model and whether the two name different ones."""
    entries = F.from_json(F.to_json(F.try_variant_get(reply, "$.server_metrics", "variant")), "map<string,string>")
    scalar = F.map_filter(entries, lambda k, v: v.isNull() | ~(v.startswith("{") | v.startswith("[")))
    model, said = F.trim(F.try_variant_get(reply, "$.model", "string")), F.try_variant_get(reply, "$.server_metrics.returned_model_id", "string")
    return F.struct(F.coalesce(scalar, F.create_map().cast("map<string,string>")).alias("metrics"), F.coalesce(F.nullif(model, F.lit("")), said).alias("returned_model_id"), F.coalesce((said != "") & (model != "") & (said != model), F.lit(False)).alias("conflict"))
