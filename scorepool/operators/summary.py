"""The summary of a run: counts, rates, counts by kind and the selected candidates' metrics; typed reading of loosely typed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorepool.constants import METRICS
from scorepool.functions.text import held_once
from scorepool.operators.quality import first_issue

#: Kinds of input that hold real frames, and the source of generated candidates that counts as multimodal.
REAL_KINDS = ("video", "image_dir", "npz")
MULTIMODAL = "multimodal_model"
#: Where a candidate's metrics are: (group, field). csr is 1 where reward.violations is an empty list.
FIELDS = {
    "reward": ("reward", "total"), "mv_align": ("reward", "alignment"), "semantic_point_coverage": ("quality", "semantic_point_coverage"), "cider_lite": ("quality", "cider_lite"), "rep": ("quality", "repetition_rate"),
}


def number_issue(value: Column, key: str, context: str, least: float | None = None, most: float | None = None) -> Column:
    """Why the field `key` of a variant object is not a number within bounds; null where it is. Truth values and texts are no numbers."""
    held = F.try_variant_get(value, f"$.{key}", "variant")
    kind, number = F.schema_of_variant(held), F.try_variant_get(value, f"$.{key}", "double")
    name = f"{context}.{key}"
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    rules = [(held.isNull(), f"Missing required field {name}."), (~numeric, f"{name} must be numeric."), (F.isnan(number) | (F.abs(number) == float("inf")), f"{name} must be finite.")]
    if least is not None and most is not None:
        rules.append((~number.between(least, most), f"{name} must be within [{least:g}, {most:g}]."))
    elif least is not None:
        rules.append((number < least, f"{name} must be at least {least:g}."))
    return first_issue(*rules)


def object_issue(value: Column, key: str, context: str, kind: str = "OBJECT") -> Column:
    """Why the field is not an object (or, with kind ARRAY, a list)."""
    held = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
    return F.when(~F.coalesce(held.startswith(kind), F.lit(False)), F.lit(f"{context}.{key} must be {'an object' if kind == 'OBJECT' else 'a list'}."))


def candidate_issue(candidate: Column) -> Column:
    """The first thing wrong with the metrics of a candidate (variant)."""
    checks = [object_issue(candidate, "reward", "candidate"), object_issue(candidate, "quality", "candidate"), object_issue(F.try_variant_get(candidate, "$.reward", "variant"), "violations", "candidate.reward", "ARRAY")]
    checks += [number_issue(F.try_variant_get(candidate, f"$.{group}", "variant"), field, f"candidate.{group}", 0, 1) for group, field in FIELDS.values()]
    return F.coalesce(*checks)


def candidate_metrics(candidate: Column) -> Column:
    """struct of the six metrics of a candidate (variant); null without one. What is wrong with one ends the job."""
    clean = F.size(F.try_variant_get(candidate, "$.reward.violations", "array<variant>")) == 0
    each = {m: F.try_variant_get(candidate, f"$.{group}.{field}", "double") for m, (group, field) in FIELDS.items()} | {"csr": clean.cast("double")}
    issue, kind = candidate_issue(candidate), f"struct<{', '.join(f'{m}: double' for m in METRICS)}>"
    found = F.struct(*[each[m].alias(m) for m in METRICS])
    return F.when(candidate.isNotNull() & ~F.is_variant_null(candidate), held_once(issue, lambda x: F.when(x.isNotNull(), F.raise_error(x).cast(kind)).otherwise(found)))


def run_summary(results: DataFrame) -> DataFrame:
    """Rows (field, value) of results (num_candidates, best_candidate variant, source_kind, generation_source): numbers of samples and
    candidates, success, rates of real inputs and of multimodal generation, how many there are of each kind, and the mean of each metric over
    the selected candidates (null without any). Kinds that are null count as unknown. All in two aggregations."""
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    rows = results.select("num_candidates", named("source_kind").alias("source_kind"), named("generation_source").alias("generation_source"), candidate_metrics(F.col("best_candidate")).alias("m"))
    n, ok = F.count(F.lit(1)), F.count("m")
    rate = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    one = {
        "num_samples": n, "num_candidates": F.coalesce(F.sum("num_candidates"), F.lit(0)), "selected_output_success_count": ok, "selected_output_success_rate": F.round(ok / F.greatest(F.lit(1), n), 6),
        "real_video_rate": rate(F.col("source_kind").isin(*REAL_KINDS)), "multimodal_generation_rate": rate(F.col("generation_source") == MULTIMODAL),
    } | {f"selected_metrics.{m}": F.round(F.avg(f"m.{m}"), 6) for m in METRICS}
    wide = rows.agg(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(one.values())])
    facts = wide.select(F.inline(F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"_{i}").alias("value")) for i, name in enumerate(one)])))
    kinds = rows.select(F.explode(F.array(*[F.concat(F.lit(f"{c}_counts."), F.col(c)) for c in ("source_kind", "generation_source")])).alias("field")).groupBy("field").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return facts.unionByName(kinds)


def slot_view(slot: Column) -> Column:
    """What a selection's record keeps of a slot outcome."""
    return F.struct(
        slot["candidate_index"].cast("int").alias("candidate_index"), slot["terminal_status"].alias("terminal_status"), slot["candidate_id"].alias("candidate_id"), F.coalesce(slot["terminal_reason"], F.lit("")).alias("terminal_reason"),
        slot["request_count"].cast("int").alias("semantic_attempts"), slot["transport_request_count"].cast("int").alias("generation_requests"), F.bround(slot["request_seconds"].cast("double"), 6).alias("request_seconds"), slot["usage"].alias("usage"),
    )


def coverage_audit(points: Column, source_field: Column, encoder: str, threshold: float, text_fields: tuple[str, ...]) -> Column:
    """How a sample's reference points were held against its script."""
    return F.struct(
        F.coalesce(F.size(points) > 0, F.lit(False)).alias("reference_available"), F.coalesce(F.greatest(F.lit(0), F.size(points)), F.lit(0)).alias("reference_count"), source_field.alias("reference_source_field"), F.lit(encoder).alias("encoder"), F.lit("cosine").alias("similarity"),
        F.lit(float(threshold)).alias("similarity_threshold"), F.array(*map(F.lit, text_fields)).alias("script_text_fields"), F.lit("evaluation_only").alias("reference_usage"),
    )


#: Settings that a generated candidate's controls state.
CONTROL_FIELDS = (
    "target_duration_sec", "segments", "output_language", "summary_position", "pace", "information_density", "target_words_per_segment", "min_words_per_segment", "max_words_per_segment", "salient_points", "risk_terms",
)


def control_metadata(settings: dict, model_id: str = "", model_name: str = "") -> dict:
    """The controls that the runner, not the model, states for a candidate. A setting that is absent is an error."""
    if absent := [f for f in CONTROL_FIELDS if f not in settings]:
        raise ValueError(f"settings lack {absent}")
    runtime = {"generated_by": "openai_compatible_multimodal", "model_id": model_id, "model_name": model_name}
    return {f: list(settings[f]) if isinstance(settings[f], (list, tuple)) else settings[f] for f in CONTROL_FIELDS} | {"_generation_runtime": runtime}


def own_key(rows: DataFrame, key: str = "sample_key", other: str = "video_id") -> Column:
    """A row's key, or its video's id where that is blank; both blank is an error."""
    stated = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in (key, other) if c in rows.columns]
    return F.coalesce(*stated, F.raise_error(F.lit(f"a row has neither {key} nor {other}")).cast("string"))
