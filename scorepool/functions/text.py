"""Text functions as Spark columns; Arrow UDFs only where the JVM has no Unicode decomposition or names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorepool.constants import RISK_TERMS

_TOKEN = r"[A-Za-z0-9_]+|[一-鿿]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased words of A-Z, digits and _, and single CJK ideographs; every character where there are none. Null has none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(lower, F.lit(_TOKEN), F.lit(0))
    return F.when(F.size(found) > 0, found).when(lower == "", F.array().cast("array<string>")).otherwise(F.split(lower, ""))


def repetition_rate(words: Column) -> Column:
    """Share of tokens that have come before; 0 without tokens."""
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(words)) / F.size(words))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n tokens joined by a space; none if there are fewer tokens."""
    if n == 1:
        return words
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def held_once(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngram_keys(words: Column, n: int) -> Column:
    """64-bit hashes of all runs of n tokens, in order; none if there are fewer tokens."""
    keys = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, keys).otherwise(F.array().cast("array<bigint>"))


def _merged(a: Column, b: Column) -> Column:
    """How many elements two sorted arrays share, by one merge of the two."""

    def step(s: Column, _) -> Column:
        x, y = F.get(a, s["i"]), F.get(b, s["j"])
        left, right = F.coalesce(x <= y, F.lit(False)).cast("int"), F.coalesce(y <= x, F.lit(False)).cast("int")
        return F.struct((s["i"] + left).alias("i"), (s["j"] + right).alias("j"), (s["n"] + left * right).alias("n"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), zero, step, lambda s: s["n"])


def shared_count(a: Column, b: Column) -> Column:
    """How many elements two arrays share, repeats counted as often as both have them. Only elements that both have are sorted and merged."""

    def counted(common: Column) -> Column:
        own = [F.sort_array(F.filter(x, lambda v: F.array_contains(common, v))) for x in (a, b)]
        both = F.struct(own[0].alias("a"), own[1].alias("b"))
        return F.when(F.size(common) == 0, F.lit(0)).otherwise(held_once(both, lambda t: _merged(t["a"], t["b"])))

    return held_once(F.array_intersect(a, b), counted)


def cider_lite(prediction: Column | str, reference: Column | str) -> Column:
    """The mean over orders 1 to 4 of the F1 of clipped n-gram counts; an order that a side lacks adds 0. Null counts as empty.

    Both texts are in one row, so their sorted n-gram hashes are merged there, in the JVM, and no n-gram is shuffled.
    """
    p, r = (F.col(x) if isinstance(x, str) else x for x in (prediction, reference))

    def order(t: Column, n: int) -> Column:
        def f1(g: Column) -> Column:
            return F.when((F.size(g["p"]) == 0) | (F.size(g["r"]) == 0), F.lit(0.0)).otherwise(2 * shared_count(g["p"], g["r"]) / (F.size(g["p"]) + F.size(g["r"])))

        return held_once(F.struct(ngram_keys(t["p"], n).alias("p"), ngram_keys(t["r"], n).alias("r")), f1)

    return held_once(F.struct(tokens(p).alias("p"), tokens(r).alias("r")), lambda t: (order(t, 1) + order(t, 2) + order(t, 3) + order(t, 4)) / 4)


_ENGLISH = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)?")


@F.pandas_udf(T.IntegerType())
def english_word_count(text: pd.Series) -> pd.Series:
    """Words of A-Z after compatibility decomposition without combining marks."""

    def count(value) -> int:
        if not value:
            return 0
        if not value.isascii():
            value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
        return len(_ENGLISH.findall(value))

    return text.map(count).astype("int32")


def risk_terms(text: Column, terms: tuple[str, ...] = RISK_TERMS) -> Column:
    """Configured terms found as substrings, whatever the case, in configured order."""
    known = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, known)), lambda t: F.contains(lower, t)) if known else F.array().cast("array<string>")


def risk_score(found: Column, terms: tuple[str, ...] = RISK_TERMS) -> Column:
    known = len({t.lower() for t in terms if t})
    return F.lit(1.0) if not terms else F.greatest(F.lit(0.0), 1 - F.size(F.array_distinct(found)) / max(1, known))


def ends_sentence(text: Column) -> Column:
    return stripped(text).rlike(r"[.!?][\"']?$")


def stable_hash(text: Column, modulus: int) -> Column:
    """The first 64 bits of SHA-256, unsigned, modulo `modulus`."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(modulus).cast("decimal(20,0)")).cast("long")


def json_string(text: Column) -> Column:
    """text as a JSON string literal, non-ASCII characters kept."""
    quoted = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def sample_key(video_id: Column, question: Column, answer: Column, caption: Column) -> Column:
    """video_id::hash of the four fields as JSON with sorted keys, twelve digits."""
    fields = (("answer", answer), ("caption", caption), ("question", question), ("video_id", video_id))
    parts = [F.concat(F.lit(f'"{name}": '), json_string(value)) for name, value in fields]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return F.concat(F.coalesce(video_id, F.lit("")), F.lit("::"), F.lpad(stable_hash(text, 10**12).cast("string"), 12, "0"))


def hashed_vector(rows: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """Rows (key, vector): signed hashed unigrams and halves for bigrams, L2-normalised. A cheap encoder for tests."""
    words = rows.select(key, tokens(F.col(text)).alias("w"))
    signed = F.transform("w", lambda w: F.struct(w.alias("t"), F.when(stable_hash(F.concat(w, F.lit("::sign")), 2) == 0, 1.0).otherwise(-1.0).alias("v")))
    pairs = F.transform(ngrams(F.col("w"), 2), lambda g: F.struct(F.translate(g, " ", "_").alias("t"), F.lit(0.5).alias("v")))
    parts = words.select(key, F.explode(F.concat(signed, pairs)).alias("x")).groupBy(key, stable_hash(F.col("x.t"), dim).cast("int").alias("b")).agg(F.sum("x.v").alias("v"))
    held = parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    return rows.select(key).join(held.select(key, value.alias("vector")), key, "left").select(key, F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)).alias("vector"))


def degenerate_period(text: Column, least: int = 256, repeats: int = 8, periods: int = 24) -> Column:
    """The smallest period up to `periods` with which a text of at least `least` characters ends `repeats` times, letters included; else null."""
    ends = lambda v, p: (F.right(v, p * repeats) == F.repeat(F.right(v, p), F.lit(repeats))) & F.right(v, p).rlike(r"\p{L}")
    first = lambda v: F.get(F.filter(F.sequence(F.lit(1), F.lit(periods)), lambda p: ends(v, p)), F.lit(0))
    value = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")
    return F.get(F.transform(F.array(value), lambda v: F.when(F.length(v) >= least, first(v))), F.lit(0))  # the array binds v once


def repeated_tail(tokens: Column, least: int = 128, repeats: int = 8, periods: int = 8) -> Column:
    """The smallest period with which an array of at least `least` tokens ends `repeats` times; else null."""
    n = F.size(tokens)
    hits = [F.when((n >= p * repeats) & (F.slice(tokens, -p * repeats, p * repeats) == F.flatten(F.array_repeat(F.slice(tokens, -p, p), repeats))), F.lit(p)) for p in range(1, periods + 1)]
    return F.when(n >= least, F.coalesce(*hits))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places, filled from columns; nulls as empty. Its hash is stable_hash's or sha2's of the result."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(pieces)])


def prompts(base: Column, retry_suffix: str) -> Column:
    """The first prompt and the one of later attempts, each with its SHA-256."""
    retry = F.concat(base, F.lit(retry_suffix))
    return F.struct(base.alias("base"), F.sha2(base, 256).alias("base_sha256"), retry.alias("retry"), F.sha2(retry, 256).alias("retry_sha256"))


def sanitized_id(raw: Column, video: Column, index: int) -> Column:
    """An identifier that starts with its video's, of [A-Za-z0-9_.:-] only."""
    fallback = f"vlm_{index:02d}"
    video = F.coalesce(F.nullif(stripped(video), F.lit("")), F.lit("video"))
    raw = F.coalesce(F.nullif(stripped(raw), F.lit("")), F.lit(fallback))
    full = F.when(F.startswith(raw, video), raw).otherwise(F.concat(video, F.lit("_"), raw))
    clean = F.regexp_replace(F.regexp_replace(full, r"[^A-Za-z0-9_.:-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.concat(video, F.lit(f"_{fallback}")))


def four_digits(value: Column) -> Column:
    """%.4f, or n/a for null."""
    return F.lit("n/a") if value is None else F.when(value.isNotNull(), F.format_string("%.4f", value.cast("double"))).otherwise("n/a")


def non_blank_join(parts: list[Column], separator: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)
