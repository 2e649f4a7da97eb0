"""Queries of the corpus operators: each applies one operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorepool.llm.common import crc_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.ngram_join import shingle_components

    return shingle_components(table(spark, sf_dir, "documents"))


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.webp import stored_media

    return stored_media(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.ctw import score, train

    docs = table(spark, sf_dir, "documents")
    learns = crc_bucket(F.col("doc_id"), 7) != 2
    return score(docs, train(docs.where(learns)), learns)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.manifest import verified

    return verified(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorepool.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_token_files, op3_pii, op4_decontaminate, op5_substring_dedup, op6_ngram_join, op7_webp, op8_language_id, op9_packing, op10_ctw_scores, op11_importance, op12_manifest, op13_warc)
}

_SQL_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of each distinct string of `src` (column k), as a query: the table of 256 remainders is built by the rule, then bytes are folded in.
_SQL_CRC = """crc_rem AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::UBIGINT] || [b::UBIGINT FOR b IN range(8)], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) AS v FROM range(256) t(i))),
crc_bytes AS (SELECT k, [(strpos('0123456789ABCDEF', h[2 * j - 1]) * 16 + strpos('0123456789ABCDEF', h[2 * j]) - 17)::UBIGINT FOR j IN range(1, len(h) // 2 + 1)] AS b FROM (SELECT k, hex(k) AS h FROM (SELECT DISTINCT k FROM {src}))),
crcs AS (SELECT k, xor(list_reduce([4294967295::UBIGINT] || b, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM crc_bytes, crc_rem)"""
_SQL_RUNS = r"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _sql_leaf(text: str) -> str:
    each = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(each)})"


def _sql_tree(name: str, nodes: str) -> str:
    """All nodes (tree, lvl, idx, n, hash, pre) over nodes (tree, idx, n, hash), parents by eights."""
    pre = "string_agg(hash, '' ORDER BY idx)"
    return f"""{name}(tree, lvl, idx, n, hash, pre) AS (SELECT tree, 0, idx, n, hash, '' FROM {nodes} UNION ALL
SELECT tree, lvl + 1, idx // 8, max((n + 7) // 8), sha256({pre}), {pre} FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 8)"""


#: The others can't be written in SQL as they stand (tokenizers, trained models, codecs); tests hold them against brute-force
#: versions, exact round trips and held-out examples instead.
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": f"""WITH w AS (SELECT doc_id, {_SQL_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM (SELECT doc_id, s, unnest(range(0, 20)) AS o FROM later)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS k FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op6_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SQL_WORDS.format(text=_LOWERED)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN size x ON p.a = x.doc_id JOIN size y ON p.b = y.doc_id WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN size ON d.doc_id = size.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON d.doc_id = c.a""",
    "op11_importance": f"""WITH dw AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_RUNS.format(lowered=_LOWERED)} AS ws FROM documents),
d AS (SELECT row, unnest(ws) AS k FROM dw), b AS (SELECT unnest({_SQL_RUNS.format(lowered=_LOWERED)}) AS k FROM benchmark),
{_SQL_CRC.format(src="(SELECT k FROM d UNION ALL SELECT k FROM b)")},
s AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM d JOIN crcs USING (k) GROUP BY 1), t AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM b JOIN crcs USING (k) GROUP BY 1),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t ON s.bucket = t.bucket),
w AS (SELECT row, count(*) AS n, sum(g) AS g FROM d JOIN crcs USING (k) JOIN gain ON gain.bucket = crc % 10000 GROUP BY row),
each AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE ((g - ((g % n) + n) % n) // n)::BIGINT END AS weight,
floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM dw LEFT JOIN w USING (row)),
ranked AS (SELECT doc_id, n_features, weight, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS r, 10 * (count(*) FILTER (n_features >= 20) OVER ()) // 100 AS drawn FROM each)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= drawn THEN r END AS rank FROM ranked""",
    "op12_manifest": f"""WITH RECURSIVE {_SQL_CRC.format(src="(SELECT coalesce(doc_id::VARCHAR, '') AS k FROM documents)")},
rows AS (SELECT row_number() OVER () AS row, CASE WHEN lang IS NULL THEN '' ELSE ':' || lang END AS tree, doc_id, {_sql_leaf("text")} AS hash,
{_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents),
leaf AS (SELECT row, tree, doc_id, hash, CASE WHEN crc % 3 = 0 THEN low ELSE hash END AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
FROM rows JOIN crcs ON k = coalesce(doc_id::VARCHAR, '')),
{_sql_tree("up", "leaf")},
subroot AS (SELECT '' AS tree, tree AS name, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
{_sql_tree("top", "subroot")},
steps AS (SELECT l.row, 0 AS part, u.lvl, u.pre, (l.idx // (8 ** (u.lvl - 1))::BIGINT) % 8 AS slot FROM leaf l JOIN up u ON u.tree = l.tree AND u.lvl > 0 AND u.idx = l.idx // (8 ** u.lvl)::BIGINT
UNION ALL SELECT l.row, 1, t.lvl, t.pre, (s.idx // (8 ** (t.lvl - 1))::BIGINT) % 8 FROM leaf l JOIN subroot s ON s.name = l.tree JOIN top t ON t.lvl > 0 AND t.idx = s.idx // (8 ** t.lvl)::BIGINT),
cut AS (SELECT row, part, lvl, substr(pre, 1, 64 * slot) AS a, substr(pre, 64 * slot + 65) AS b FROM steps),
path AS (SELECT row, string_agg(a || b, '' ORDER BY part, lvl) AS around, list({{'h': '', 'a': a, 'b': b}} ORDER BY part, lvl) AS sides FROM cut GROUP BY row),
proof AS (SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, (SELECT hash FROM top WHERE n = 1) AS root, sha256(coalesce(around, '')) AS proof_sha256,
list_reduce([{{'h': now, 'a': '', 'b': ''}}] || coalesce(sides, []), lambda x, y: {{'h': sha256(y.a || x.h || y.b), 'a': '', 'b': ''}}).h AS folded_root FROM leaf l JOIN subroot s ON s.name = l.tree LEFT JOIN path USING (row))
SELECT *, folded_root = root AS verified FROM proof""",
    "op13_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last,
strlen(html) >= 1000 AND row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) > 1 AS again FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM q""",
}
