"""Loosely typed JSON values as native columns. A value is a struct (text, kind): what it says, strings without their quotes, and the
first character of its JSON: `"`, `[`, `{`, `t`, `f`, `n`, a digit or a sign. An absent value has no text and no kind.

Nothing is bounded by depth or size: nested values are flattened over their tokens, not by recursion. Key order is that of the text.
Of a key given twice in a row the last counts; twice in a nested object is an error, as is a row that is no JSON object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorepool.functions.text import held_once

_STRICT = {"mode": "FAILFAST"}
#: A key with its colon or a string, a comma, or a bare scalar; strings hold no quote, as `quoteless` has written those by number.
_TOKEN = r'("[^"]*"\s*:?|,|[^\s\[\]{},:"]+)'
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_DECIMAL = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
_DELIMITERS = "[,，;；/、]"


def strip(text: Column) -> Column:
    """Without white space at either end, that of any script included."""
    return F.regexp_replace(text, _EDGE, "")


def kind_of(variant: Column) -> Column:
    return F.substring(F.to_json(variant), 1, 1)


def value(text: Column, variant: Column) -> Column:
    return F.struct(text.alias("text"), kind_of(variant).alias("kind"))


def _schema(names, kind: str) -> str:
    return ", ".join(f"`{n}` {kind}" for n in names)


def texts(raw: Column, names) -> Column:
    """struct of the texts of an object's fields: null where absent or null."""
    return F.from_json(raw, _schema(names, "string"), _STRICT)


def variants(raw: Column, names) -> Column:
    """struct of an object's fields as variants, whose nulls are not SQL's."""
    return F.from_json(raw, _schema(names, "variant"), _STRICT)


def first_of(text: str, variant: str, names) -> Column:
    """struct (name, text, kind) of the first field that is neither null nor an empty string; null without any. text and variant name
    the columns that `texts` and `variants` made."""
    held = [f"WHEN {text}.`{n}` != '' THEN named_struct('name', '{n}', 'text', {text}.`{n}`, 'kind', substring(to_json({variant}.`{n}`), 1, 1))" for n in names]
    return F.expr(f"CASE {' '.join(held)} END")


def first_in(fields: Column, names) -> Column:
    """The same of one object's `fields` (struct t, v of maps), as (text, kind)."""
    held = F.filter(F.array(*map(F.lit, names)), lambda n: F.try_element_at(fields["t"], n) != "")
    return F.get(F.transform(held, lambda n: value(F.try_element_at(fields["t"], n), F.try_element_at(fields["v"], n))), F.lit(0))


def number_text(text: Column) -> Column:
    """A JSON number: whole ones by their digits, others with a point, from 1e16 on and below 1e-4 with a power of ten."""
    x = text.try_cast("double")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E([0-9])", r"e+$1"), "E-", "e-")
    two = F.regexp_replace(power, "e([+-])([0-9])$", r"e$10$2")
    digits = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"0+$", ""), r"\.$", ".0")
    far = (F.abs(x) >= 1e16) | ((F.abs(x) < 1e-4) & (x != 0))
    return F.when(text == "-0", "0").when(~text.contains("E"), text).when(far, two).otherwise(digits)


def quoteless(json: Column) -> Column:
    """The same JSON with escaped backslashes and quotes by number, so that a quote always begins or ends a string."""
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))


def _said(quoted: Column) -> Column:
    """What a string token says."""
    inner = F.substring_index(F.substring_index(quoted, '"', 2), '"', -1)
    return F.when(inner.contains("\\"), F.get_json_object(F.concat(F.lit('["'), inner, F.lit('"]')), "$[0]")).otherwise(inner)


def flat(json: Column) -> Column:
    """Elements of lists by spaces and `key: value` of objects, at any depth; scalars alone."""

    def word(t: Column) -> Column:
        said = held_once(_said(t), lambda x: F.when(t.endswith(":"), F.concat(x, F.lit(": "))).otherwise(strip(x)))
        return F.when(t == ",", " ").when(t.startswith('"'), said).when(t == "null", "").when(t.isin("true", "false"), F.initcap(t)).otherwise(number_text(t))

    return F.array_join(F.transform(F.regexp_extract_all(quoteless(json), F.lit(_TOKEN), F.lit(1)), word), "")


def stated(v: Column) -> Column:
    """A value as text: strings as they are, the rest as `plain` says them; empty where absent."""
    return F.when(v["text"].isNull(), "").when(v["kind"] == '"', v["text"]).otherwise(flat(v["text"]))


def plain(v: Column) -> Column:
    """A value as text: lists by spaces, objects as key: value, the rest stripped."""
    return F.when(v["kind"] == '"', strip(v["text"])).otherwise(stated(v))


def truthy(v: Column) -> Column:
    """Neither absent, empty, zero nor false."""
    nested = v["kind"].isin("[", "{")
    number = F.coalesce(v["text"].try_cast("double") != 0, F.lit(True))
    return F.when(v["text"].isNull(), False).when(nested, ~v["text"].isin("[]", "{}")).when(v["kind"] == '"', v["text"] != "").when(v["kind"].isin("t", "f"), v["text"] == "true").otherwise(number)


def elements(json: Column) -> Column:
    """The values of a list."""
    return F.zip_with(F.from_json(json, "array<string>", _STRICT), F.from_json(json, "array<variant>", _STRICT), value)


def entries(json: Column) -> Column:
    """struct (key, value) of each field of an object, in its order."""
    pairs = [F.map_entries(F.from_json(json, f"map<string,{kind}>", _STRICT)) for kind in ("string", "variant")]
    return F.zip_with(*pairs, lambda t, v: F.struct(t["key"].alias("key"), value(t["value"], v["value"]).alias("value")))


def listed(v: Column) -> Column:
    """Non-blank texts of a list, of a JSON list in a string, or of a delimited string; any other value is the one text."""
    text = strip(v["text"])
    in_string = (v["kind"] == '"') & text.startswith("[") & text.endswith("]") & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    held = F.when(v["kind"] == "[", v["text"]).when(in_string, text)
    filled = lambda a: F.filter(a, lambda t: t != "")
    parts = filled(F.transform(F.split(text, _DELIMITERS), strip))
    of_list = held_once(held, lambda h: filled(F.transform(elements(h), plain)))
    return F.when(v["text"].isNull(), F.array().cast("array<string>")).when(held.isNotNull(), of_list).when(v["kind"] == '"', parts).otherwise(F.array(plain(v)))


def number(v: Column) -> Column:
    """A number, a text that is one, or a truth value, as a double; null for all else."""
    text = F.lower(strip(v["text"]))
    bare = F.regexp_replace(text, "^[+-]", "")
    special = F.when(bare.isin("inf", "infinity"), float("inf")).when(bare == "nan", float("nan"))
    told = F.when(text.rlike(_DECIMAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).otherwise(F.when(text.startswith("-"), -special).otherwise(special))
    return F.when(v["kind"] == "t", 1.0).when(v["kind"] == "f", 0.0).when(~v["kind"].isin("[", "{"), told)


def subtitles(v: Column, text_names, start_names) -> Column:
    """`[start] text` of a list's objects and the texts of its other values, by spaces; any other value as it is."""

    def item(e: Column) -> Column:
        def both(row: Column) -> Column:
            return F.struct(first_in(row, text_names).alias("text"), first_in(row, start_names).alias("start"))

        def line(x: Column) -> Column:
            mark = F.when(x["start"].isNull(), "").otherwise(F.concat(F.lit("["), stated(x["start"]), F.lit("] ")))
            return F.struct(mark.alias("mark"), F.when(truthy(x["text"]), x["text"]).alias("said"))

        read = F.struct(*[F.from_json(e["text"], f"map<string,{kind}>", _STRICT).alias(n) for n, kind in (("t", "string"), ("v", "variant"))])
        return F.when(e["kind"] == "{", held_once(held_once(read, both), line)).otherwise(F.struct(F.lit("").alias("mark"), e.alias("said")))

    said = F.transform(F.transform(elements(v["text"]), item), lambda x: F.when(x["said"].isNotNull(), F.concat(x["mark"], plain(x["said"]))))
    lines = F.filter(said, lambda t: t != "")
    return F.when(v["kind"] == "[", F.array_join(lines, " ")).otherwise(plain(v))


def options(given: Column, numbered: Column) -> Column:
    """array of (key, text) of choices: the fields of an object, the values of a list with null keys, or else `numbered` (an array of
    struct present, value): those before the first absent one, without blanks."""
    no_key = F.lit(None).cast("string").alias("key")
    gap = F.array_position(F.transform(numbered, lambda x: x["present"]), False)
    led = F.when(gap == 0, numbered).otherwise(F.slice(numbered, F.lit(1), F.greatest(gap.cast("int") - 1, F.lit(0))))
    filled = F.transform(F.filter(led, lambda x: x["value"]["text"] != ""), lambda x: F.struct(no_key, x["value"].alias("value")))
    of_list = F.transform(elements(given["text"]), lambda e: F.struct(no_key, e.alias("value")))
    kind, some = given["kind"], ~given["text"].isin("[]", "{}")
    pairs = F.when((kind == "[") & some, of_list).when((kind == "{") & some, entries(given["text"])).otherwise(filled)
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), plain(p["value"]).alias("text")))


def options_text(pairs: Column) -> Column:
    """`A. x C. z`: by key, or by letter and from the 27th on by number; blank ones are left out but keep their letter."""
    keyed = F.transform(F.array_sort(pairs), lambda p: F.when(p["text"] != "", F.concat(p["key"], F.lit(". "), p["text"])))
    mark = lambda i: F.when(i < 26, F.char(F.lit(65) + i)).otherwise(i.cast("string"))
    lettered = F.transform(pairs, lambda p, i: F.when(p["text"] != "", F.concat(mark(i), F.lit(". "), p["text"])))
    return F.array_join(F.array_compact(F.when(F.exists(pairs, lambda p: p["key"].isNotNull()), keyed).otherwise(lettered)), " ")
