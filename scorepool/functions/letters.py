"""Letters and their script, by a table of code point intervals compiled from Unicode names, searched as native columns.

The table has the letters whose name holds LATIN and those whose name doesn't, as intervals in blocks of 256 code points, so a letter is
looked up by its block and compared with the few intervals there. The same intervals as rows (`interval_rows`) serve a join in SQL.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = 256
_ASCII = r"[\x00-\x7F]+"


@lru_cache(maxsize=1)
def interval_rows() -> tuple[tuple[int, int, bool], ...]:
    """(first, last, latin) of every run of letters of one kind."""
    out: list[list] = []
    for code in range(0x110000):
        c = chr(code)
        if not c.isalpha():
            continue
        latin = "LATIN" in unicodedata.name(c, "")
        if out and out[-1][1] == code - 1 and out[-1][2] == latin:
            out[-1][1] = code
        else:
            out.append([code, code, latin])
    return tuple(map(tuple, out))


@lru_cache(maxsize=1)
def _blocks() -> str:
    """For each block the intervals in it, as JSON."""
    blocks: list[list[dict]] = [[] for _ in range(0x110000 // _BLOCK)]
    for first, last, latin in interval_rows():
        for block in range(first // _BLOCK, last // _BLOCK + 1):
            blocks[block].append({"a": max(first, block * _BLOCK), "b": min(last, block * _BLOCK + _BLOCK - 1), "l": latin})
    return json.dumps(blocks)


def _interval(code: Column) -> Column:
    """The interval that holds a code point; null for what is no letter."""
    table = F.from_json(F.lit(_blocks()), "array<array<struct<a:int,b:int,l:boolean>>>")  # folded to a constant
    near = F.get(table, F.floor(code / _BLOCK).cast("int"))
    return F.get(F.filter(near, lambda i: code.between(i["a"], i["b"])), F.lit(0))


def _beyond_ascii(text: Column) -> Column:
    """The characters of a text that are not ASCII, in order."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), _ASCII, "")
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, ""))


def other_letters(text: Column) -> Column:
    """Code points of the letters of a text that are not Latin, in order; none for null."""
    return F.filter(F.transform(_beyond_ascii(text), lambda c: F.ascii(c)), lambda code: ~F.coalesce(_interval(code)["l"], F.lit(True)))


def letter_counts(text: Column) -> Column:
    """struct<letters, non_latin> of a text."""
    plain = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", ""))
    more = F.size(F.filter(F.transform(_beyond_ascii(text), lambda c: F.ascii(c)), lambda code: _interval(code).isNotNull()))
    return F.struct((plain + more).alias("letters"), F.size(other_letters(text)).alias("non_latin"))


def code_name(code: Column) -> Column:
    """U+XXXX of a code point."""
    return F.concat(F.lit("U+"), F.when(code < 65536, F.lpad(F.hex(code), 4, "0")).otherwise(F.hex(code)))


def on_screen_audit(segments: Column, name: str = "on_screen_text") -> Column:
    """Of an array of segments: whether their shown texts hold letters that are not Latin, in which segments (from 1), how many, of how many."""
    counts = F.transform(segments, lambda s: letter_counts(s[name]))
    held = F.filter(F.transform(counts, lambda c, i: F.when(c["non_latin"] > 0, i + 1)), lambda i: i.isNotNull())
    total = lambda what: F.aggregate(counts, F.lit(0), lambda n, c: n + c[what])
    return F.struct(
        (F.size(held) > 0).alias("has_non_latin"), held.alias("non_latin_segment_indices"), total("non_latin").alias("non_latin_letter_count"), total("letters").alias("total_letter_count"),
    )


def control_strings(kind: T.DataType, value: Column, path: str | Column = "controls") -> Column:
    """array<struct<path, value>> of all texts in a column, by its type: fields, elements and theirs, but for fields whose name begins with
    an underscore. Texts come in the order of the type's fields."""
    path = F.lit(path) if isinstance(path, str) else path
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("value")))).otherwise(_NO_FIELDS())
    if isinstance(kind, T.StructType):
        parts = [control_strings(f.dataType, value[f.name], F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if not f.name.startswith("_")]
        return F.concat(*parts) if parts else _NO_FIELDS()
    if isinstance(kind, T.MapType):
        each = F.filter(F.map_entries(value), lambda e: ~e["key"].startswith("_"))
        return F.coalesce(F.flatten(F.transform(each, lambda e: control_strings(kind.valueType, e["value"], F.concat(path, F.lit("."), e["key"])))), _NO_FIELDS())
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda v, i: control_strings(kind.elementType, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))), _NO_FIELDS())
    return _NO_FIELDS()


def _NO_FIELDS() -> Column:
    return F.array().cast("array<struct<path:string,value:string>>")


def contract_fields(segments: Column, kind: T.DataType | None = None, controls: Column | None = None) -> Column:
    """The texts that must be Latin, with their paths: narration and salient_point of each segment (from 1), then the controls' texts."""
    each = F.transform(segments, lambda s, i: F.array(*[F.struct(F.concat(F.lit("timeline["), (i + 1).cast("string"), F.lit(f"].{n}")).alias("path"), s[n].alias("value")) for n in ("narration", "salient_point")]))
    fields = F.coalesce(F.flatten(each), _NO_FIELDS())
    return fields if controls is None else F.concat(fields, control_strings(kind, controls))


@F.pandas_udf(T.StringType())
def _unicode_name(code: pd.Series) -> pd.Series:
    return code.map(lambda c: unicodedata.name(chr(c), "") or "UNKNOWN")


def contract_issues(rows: DataFrame, fields: Column, name: str = "issue") -> DataFrame:
    """rows with `name`: which field first holds a letter that is not Latin, and the letter; null where none does. Names are made once
    for each distinct letter found, of which there are at most as many as Unicode has, and joined."""
    first = F.get(F.filter(F.transform(fields, lambda f: F.struct(f["path"].alias("path"), F.get(other_letters(f["value"]), F.lit(0)).alias("code"))), lambda f: f["code"].isNotNull()), F.lit(0))
    found = rows.withColumn("_first", first)
    names = found.select(F.col("_first.code").alias("_code")).where("_code is not null").distinct().withColumn("_name", _unicode_name("_code"))
    joined = found.join(F.broadcast(names), F.col("_first.code") == F.col("_code"), "left")
    issue = F.concat(F.col("_first.path"), F.lit(" contains non-Latin letter "), code_name(F.col("_code")), F.lit(" ("), F.col("_name"), F.lit(")"))
    return joined.withColumn(name, issue).drop("_first", "_code", "_name")
