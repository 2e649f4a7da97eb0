"""Queries by name over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorepool import constants as C
from scorepool import reports
from scorepool.functions import letters, sampling, text, timeline, vectors
from scorepool.operators import bootstrap, contracts, fingerprint, identity, parsing, quality, retries, selection, stats, summary
from scorepool.plans import views as V
from scorepool.plans.views import table
from scorepool.sources import annotations

#: Text whose n-grams one task counts, in bytes.
GRAM_BYTES = 16 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r9(x):
    """Nine places: sums of doubles come in different orders."""
    return F.round(x, 9)


# --- text ---------------------------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]')"
_WORDS = f"docs AS (SELECT doc_id, CASE WHEN len({_TOKENS}) > 0 THEN {_TOKENS} WHEN text = '' THEN [] ELSE string_split(lower(text), '') END AS w FROM documents)"


@query(f"WITH {_WORDS} SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, CAST(len(list_distinct(w)) AS INT) AS n_distinct FROM docs")
def tokenize_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(f"WITH {_WORDS} SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE round(1 - len(list_distinct(w)) / len(w), 9) END AS repetition FROM docs")
def repetition_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", r9(text.repetition_rate(F.col("w"))).alias("repetition"))


@query(f"WITH {_WORDS}, g AS (SELECT list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM docs WHERE len(w) >= 2) SELECT gram, count(*) AS n FROM (SELECT unnest(g) AS gram FROM g) GROUP BY gram")
def ngram_counts(spark, sf_dir):
    """No task counts the grams of more than about GRAM_BYTES of text: shares of documents first, then shares of grams."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // GRAM_BYTES))
    shares = d.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("share")).repartitionById(n, F.col("share"))
    grams = shares.select("share", text.tokens(F.col("text")).alias("w")).select("share", F.explode(text.ngrams(F.col("w"), 2)).alias("gram"))
    counted = grams.groupBy("share", "gram").agg(F.count(F.lit(1)).alias("n"))  # within the shares' tasks
    return counted.select("gram", "n").repartition(n, "gram").groupBy("gram").agg(F.sum("n").alias("n"))


@query(f"""WITH b AS (SELECT item_id, text FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark),
p AS (SELECT doc_id, {_TOKENS} AS w FROM documents), r AS (SELECT d.doc_id, {_TOKENS.replace('text', 'b.text')} AS w FROM documents d, n JOIN b ON b.item_id = d.doc_id % n.n),
k AS (SELECT unnest([1, 2, 3, 4]) AS k),
gp AS (SELECT doc_id, k, g, count(*) AS c FROM (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM p, k) GROUP BY 1, 2, 3),
gr AS (SELECT doc_id, k, g, count(*) AS c FROM (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM r, k) GROUP BY 1, 2, 3),
o AS (SELECT gp.doc_id, gp.k, sum(least(gp.c, gr.c)) AS o FROM gp JOIN gr USING (doc_id, k, g) GROUP BY 1, 2),
tp AS (SELECT doc_id, k, sum(c) AS c FROM gp GROUP BY 1, 2), tr AS (SELECT doc_id, k, sum(c) AS c FROM gr GROUP BY 1, 2)
SELECT d.doc_id, round(coalesce(sum(2 * o.o / (tp.c + tr.c)), 0) / 4, 9) AS cider_lite FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN tp USING (doc_id, k) LEFT JOIN tr USING (doc_id, k) GROUP BY d.doc_id""")
def cider_lite(spark, sf_dir):
    return V.references(spark, sf_dir).select("doc_id", r9(text.cider_lite("text", "reference")).alias("cider_lite"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(strip_accents(text), '[A-Za-z]+(?:[''’-][A-Za-z]+)?')) AS INT) AS words FROM documents")
def english_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.english_word_count("text").alias("words"))


_FREQUENT = ("the", "of", "est", "und", "que", "number one", "best")


def _terms_sql(terms):
    return "list_filter([" + ", ".join("'" + t + "'" for t in terms) + "], lambda t: contains(lower(text), t))"


@query(f"SELECT doc_id, array_to_string({_terms_sql(C.RISK_TERMS)}, '|') AS risk_terms, array_to_string({_terms_sql(_FREQUENT)}, '|') AS frequent_terms FROM documents")
def risk_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(text.risk_terms(F.col("text")), "|").alias("risk_terms"), F.array_join(text.risk_terms(F.col("text"), _FREQUENT), "|").alias("frequent_terms"))


@query(f"SELECT doc_id, round(1 - len({_terms_sql(_FREQUENT)}) / 7, 9) AS risk FROM documents")
def risk_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", r9(text.risk_score(text.risk_terms(F.col("text"), _FREQUENT), _FREQUENT)).alias("risk"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(text), 1, 16))::UBIGINT % 1000003 AS BIGINT) AS bucket, sha256(text) AS sha FROM documents")
def stable_hash_bucket(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.stable_hash(F.col("text"), 1000003).alias("bucket"), F.sha2("text", 256).alias("sha"))


_KEY_JSON = """'{"answer": ' || to_json(lang) || ', "caption": ' || to_json(source) || ', "question": ' || to_json(text) || ', "video_id": ' || to_json(CAST(doc_id AS VARCHAR)) || '}'"""


@query(f"SELECT doc_id, CAST(doc_id AS VARCHAR) || '::' || lpad(CAST(('0x' || substr(sha256({_KEY_JSON}), 1, 16))::UBIGINT % 1000000000000 AS VARCHAR), 12, '0') AS sample_key FROM documents")
def sample_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.sample_key(F.col("doc_id").cast("string"), F.col("text"), F.col("lang"), F.col("source")).alias("sample_key"))


_LOOPED = "CASE WHEN conv_id % 3 = 0 THEN text || repeat(substr(text, 1, CAST(1 + conv_id % 26 AS INT)), 40) ELSE text END"
_RSTRIP = "regexp_replace(t, '\\s+$', '')"


@query(f"""WITH c AS (SELECT conv_id, turn, {_LOOPED} AS t FROM conversations), s AS (SELECT conv_id, turn, {_RSTRIP} AS v FROM c)
SELECT conv_id, turn, CASE WHEN length(v) >= 256 THEN CAST(list_min(list_filter(range(1, 25), lambda p: right(v, CAST(8 * p AS INT)) = repeat(right(v, CAST(p AS INT)), 8) AND regexp_matches(right(v, CAST(p AS INT)), '\\p{{L}}'))) AS INT) END AS period FROM s""")
def degenerate_tail(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    looped = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.expr("repeat(substr(text, 1, cast(1 + conv_id % 26 as int)), 40)"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.degenerate_period(looped).alias("period"))


@query("SELECT c_custkey, coalesce(nullif(trim(regexp_replace('v' || c_nationkey || '_' || c_name || ' #' || c_mktsegment, '[^A-Za-z0-9_.:-]+', '_', 'g'), '_'), ''), 'x') AS candidate_id FROM customer")
def candidate_id_sanitize(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.concat("c_name", F.lit(" #"), "c_mktsegment")
    return c.select("c_custkey", text.sanitized_id(raw, F.concat(F.lit("v"), F.col("c_nationkey")), 0).alias("candidate_id"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END, nullif(p_type, ''), '') AS name, CASE WHEN p_partkey % 3 <> 0 THEN 'name' WHEN p_partkey % 5 <> 0 THEN 'brand' ELSE 'type' END AS field FROM part")
def first_non_blank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a, b, c = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")), F.col("p_type")
    return p.select("p_partkey", annotations.first_non_blank(a, b, c).alias("name"), annotations.first_non_blank_name(name=a, brand=b, type=c).alias("field"))


@query("""SELECT r.r_regionkey, string_agg(CASE WHEN n.i % 4 <> 1 THEN chr(CAST(65 + n.i AS INT)) || '. ' || n.n_name END, ' ' ORDER BY n.i) AS options
FROM region r JOIN (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) n ON n.n_regionkey = r.r_regionkey GROUP BY 1""")
def format_options(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x, i: F.when(i % 4 == 1, F.lit(" ")).otherwise(x["n_name"])).alias("o"))
    return n.select(F.col("n_regionkey").alias("r_regionkey"), annotations.lettered(F.col("o")).alias("options"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'duplicate_key' WHEN event_id % 7 = 0 THEN 'invalid' END AS issue FROM events")
def strict_json_accept(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"a": {"k": 1, "k": 2}, "p": '), "props", F.lit("}"))).when(F.col("event_id") % 7 == 0, F.concat("props", F.lit(" x"))).otherwise(F.col("props"))
    return e.select("event_id", parsing.strict_json_issue(made).alias("issue"))


_PLANTED = 3000
_INTERVALS = ", ".join(f"({a}, {b}, {latin})" for a, b, latin in letters.interval_rows())


@query(rf"""WITH iv(a, b, latin) AS (VALUES {_INTERVALS}), t AS (SELECT doc_id, coalesce(text, '') || ' ' || chr((880 + doc_id % {_PLANTED})::INT) AS s FROM documents),
c AS (SELECT doc_id, unicode(unnest(c)) AS code, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, regexp_extract_all(regexp_replace(s, '[\x00-\x7F]+', '', 'g'), '(?s).') AS c FROM t)),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT latin) AS other, arg_min(code, i) FILTER (NOT latin) AS first FROM c JOIN iv ON code BETWEEN a AND b GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN first IS NULL THEN NULL ELSE 'U+' || lpad(printf('%X', first), 4, '0') END AS issue, CAST(length(regexp_replace(s, '[^A-Za-z]+', '', 'g')) + coalesce(n, 0) AS INT) AS letters, CAST(coalesce(other, 0) AS INT) AS non_latin
FROM t LEFT JOIN k ON t.doc_id = k.doc_id""")
def latin_contract(spark, sf_dir):
    """Every whole text with one more character, of Greek, Cyrillic, Arabic, Indic and other blocks or of none."""
    planted = F.decode(F.unhex(F.lpad(F.hex(F.lit(880) + F.col("doc_id") % _PLANTED), 4, "0")), "UTF-16BE")
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), planted).alias("s"))
    first = F.get(letters.other_letters(F.col("s")), F.lit(0))
    return t.select("doc_id", letters.code_name(first).alias("issue"), letters.letter_counts(F.col("s")).alias("a")).select("doc_id", "issue", "a.letters", "a.non_latin")


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,，;；/、]'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, CAST(len(p) AS INT) AS n, p[1] AS head FROM s""")
def split_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", annotations.split_list(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").alias("n"), F.get("p", F.lit(0)).alias("head"))


@query("SELECT page_id, NOT regexp_matches(url, '^[A-Za-z]:[\\\\/]') AND (starts_with(url, '//') OR regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')) AS remote, starts_with('data/' || page_id, '//') AS local_remote FROM pages")
def remote_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", annotations.remote(F.col("url")).alias("remote"), annotations.remote(F.concat(F.lit("data/"), F.col("page_id"))).alias("local_remote"))


@query("SELECT s_suppkey, round_even(s_acctbal / 7, 2) AS even FROM supplier")
def half_even_round(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", vectors.half_even(F.col("s_acctbal") / 7, 2).alias("even"))


# --- vectors ------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity"
_NOVEL = f"nov AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN 0.5 ELSE 1 - ({_COS}(v, lag(v) OVER w) + 1) / 2 END AS novelty FROM frames_v WINDOW w AS (PARTITION BY sample_key ORDER BY frame_pos))"
_WEIGHTS = f"""{V.FRAMES}, {_NOVEL}, comp AS (SELECT sample_key, i, sum(x) AS x FROM (SELECT sample_key, unnest(v) AS x, unnest(range(1, 65)) AS i FROM frames_v) GROUP BY 1, 2),
cen AS (SELECT sample_key, list(x ORDER BY i) AS c FROM comp GROUP BY 1),
sc AS (SELECT n.*, 0.55 * ({_COS}(n.v, cen.c) + 1) / 2 + (1 - 0.55) * novelty AS s FROM nov n JOIN cen USING (sample_key)),
ex AS (SELECT *, exp((s - max(s) OVER (PARTITION BY sample_key)) / 0.35) AS e FROM sc), wt AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_key) AS weight FROM ex)"""
_POOLED = f"""{_WEIGHTS}, pc AS (SELECT sample_key, i, sum(x * weight) AS x FROM (SELECT sample_key, weight, unnest(v) AS x, unnest(range(1, 65)) AS i FROM wt) GROUP BY 1, 2),
pn AS (SELECT sample_key, sqrt(sum(x * x)) AS n FROM pc GROUP BY 1), pooled AS (SELECT sample_key, list(x / n ORDER BY i) AS p FROM pc JOIN pn USING (sample_key) GROUP BY 1)"""


@query(f"WITH {V.FRAMES}, {_NOVEL} SELECT vec_id, round(novelty, 6) AS novelty FROM nov")
def novelty_lag(spark, sf_dir):
    return vectors.with_novelty(V.frames(spark, sf_dir)).select("vec_id", F.round("novelty", 6).alias("novelty"))


@query(f"WITH {_WEIGHTS} SELECT vec_id, round(weight, 7) AS weight FROM wt")
def frame_weights(spark, sf_dir):
    return vectors.with_weights(V.frames(spark, sf_dir)).select("vec_id", F.round("weight", 7).alias("weight"))


@query(f"WITH {_POOLED} SELECT sample_key, i AS pos, round(x / n, 6) AS value FROM pc JOIN pn USING (sample_key)")
def pooled_embedding(spark, sf_dir):
    p = vectors.pooled(vectors.with_weights(V.frames(spark, sf_dir)))
    return p.select("sample_key", F.posexplode("pooled").alias("pos", "value")).select("sample_key", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {_WEIGHTS} SELECT sample_key, frame_pos FROM wt QUALIFY row_number() OVER (PARTITION BY sample_key ORDER BY weight DESC, frame_pos DESC) <= 4")
def keyframes_top4(spark, sf_dir):
    return vectors.key_frames(vectors.with_weights(V.frames(spark, sf_dir))).select("sample_key", F.col("frame_pos").cast("long").alias("frame_pos"))


def _tags(spark, sf_dir):
    """The first 28 vectors as a taxonomy: 8 scenes, 10 objects, 10 activities, of which 1, 2 and 1 are chosen."""
    e = table(spark, sf_dir, "embeddings").where("vec_id < 28")
    group = F.when(F.col("vec_id") < 8, "scene").when(F.col("vec_id") < 18, "object").otherwise("activity")
    return e.select(group.alias("tag_group"), F.concat(F.lit("tag"), F.col("vec_id")).alias("tag"), F.col("vec_id").alias("tag_pos"), F.when(group == "object", 2).otherwise(1).alias("top"), "embedding")


_TAGS = "tags AS (SELECT CASE WHEN vec_id < 8 THEN 'scene' WHEN vec_id < 18 THEN 'object' ELSE 'activity' END AS tag_group, 'tag' || vec_id AS tag, vec_id AS tag_pos, CASE WHEN vec_id BETWEEN 8 AND 17 THEN 2 ELSE 1 END AS top, CAST(embedding AS DOUBLE[]) AS t FROM embeddings WHERE vec_id < 28)"


@query(f"WITH {_POOLED}, {_TAGS} SELECT sample_key, tag_group, tag FROM pooled, tags QUALIFY row_number() OVER (PARTITION BY sample_key, tag_group ORDER BY list_dot_product(p, t) DESC, tag_pos DESC) <= any_value(top) OVER (PARTITION BY sample_key, tag_group)")
def tags_topk(spark, sf_dir):
    pooled = vectors.pooled(vectors.with_weights(V.frames(spark, sf_dir)))
    return vectors.top_tags(pooled, _tags(spark, sf_dir)).select("sample_key", "tag_group", "tag")


_POINTS = f"""{V.FRAMES}, g AS (SELECT *, sample_key * 1000000 + frame_pos // 7 AS k, frame_pos % 7 AS place FROM frames_v),
pt AS (SELECT k, place, v FROM g WHERE place < 2 OR (k % 1000000) % 3 = 2), sg AS (SELECT k, place + 1 AS segment_index, v FROM g WHERE place >= 2 AND (k % 1000000) % 3 <> 2),
x AS (SELECT pt.k, pt.place, segment_index, {_COS}(pt.v, sg.v) AS c FROM pt JOIN sg USING (k) UNION ALL SELECT pt.k, pt.place, 0, {_COS}(pt.v, w.v) FROM pt JOIN (SELECT k, v FROM g WHERE place = 0) w USING (k) WHERE pt.k NOT IN (SELECT k FROM sg)),
best AS (SELECT k AS sample_key, place AS point_index, round(c, 6) AS similarity, segment_index, c >= 0.1 AS covered FROM x QUALIFY row_number() OVER (PARTITION BY k, place ORDER BY c DESC, segment_index) = 1)"""


def _points(spark, sf_dir):
    """Seven frames of a label make a sample: two points and five segments, or in every third sample seven points and a whole text alone."""
    f = V.frames(spark, sf_dir)
    f = f.select((F.col("sample_key") * 1000000 + F.floor(F.col("frame_pos") / 7)).alias("sample_key"), (F.col("frame_pos") % 7).cast("long").alias("place"), "embedding")
    bare = (F.col("sample_key") % 1000000) % 3 == 2
    points = f.where((F.col("place") < 2) | bare).select("sample_key", F.col("place").alias("point_index"), "embedding")
    segs = f.where((F.col("place") >= 2) & ~bare).select("sample_key", (F.col("place") + 1).alias("segment_index"), "embedding")
    return vectors.point_coverage(points, segs, 0.1, whole=f.where("place = 0").select("sample_key", "embedding"))


@query(f"WITH {_POINTS} SELECT * FROM best")
def semantic_point_coverage(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_POINTS} SELECT sample_key, count(*) AS points, round(avg(CAST(covered AS INT)), 9) AS coverage FROM best GROUP BY 1")
def semantic_point_mean(spark, sf_dir):
    return vectors.mean_coverage(_points(spark, sf_dir)).withColumn("coverage", r9(F.col("coverage")))


@query(f"""WITH {_POOLED}, {_TAGS}, pick AS (SELECT sample_key, list(tag) AS tags FROM (SELECT sample_key, tag FROM pooled, tags QUALIFY row_number() OVER (PARTITION BY sample_key, tag_group ORDER BY list_dot_product(p, t) DESC, tag_pos DESC) <= any_value(top) OVER (PARTITION BY sample_key, tag_group)) GROUP BY 1),
a AS (SELECT sample_key, v AS anchor FROM frames_v WHERE frame_pos = 0), s AS (SELECT sample_key, v AS script, 'tag' || (vec_id % 28) || ' text' AS t FROM frames_v WHERE frame_pos = 1)
SELECT sample_key, round(0.5 * ({_COS}(script, p) + 1) / 2 + 0.5 * (0.7 * ({_COS}(script, anchor) + 1) / 2 + 0.3 * len(list_filter(tags, lambda x: contains(t, x))) / len(tags)), 6) AS alignment FROM pooled JOIN pick USING (sample_key) JOIN a USING (sample_key) JOIN s USING (sample_key)""")
def alignment_score(spark, sf_dir):
    f = V.frames(spark, sf_dir)
    pooled = vectors.pooled(vectors.with_weights(f))
    picked = vectors.top_tags(pooled, _tags(spark, sf_dir)).groupBy("sample_key").agg(F.collect_list("tag").alias("tags"))
    anchor = f.where("frame_pos = 0").select("sample_key", F.col("embedding").alias("anchor"))
    script = f.where("frame_pos = 1").select("sample_key", F.col("embedding").alias("script"), F.concat(F.lit("tag"), F.col("vec_id") % 28, F.lit(" text")).alias("t"))
    all_ = pooled.join(picked, "sample_key").join(anchor, "sample_key").join(script, "sample_key")
    return all_.select("sample_key", F.round(vectors.alignment(F.col("script"), F.col("pooled"), F.col("anchor"), F.col("t"), F.col("tags")), 6).alias("alignment"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 60 + 1 AS t FROM customer), b AS (SELECT c_custkey, t, unnest(range(0, least(8, t))) AS b, least(8, t) AS n FROM c),
r AS (SELECT *, CAST(floor(b * t / n) AS BIGINT) AS lo, CAST(floor((b + 1) * t / n) AS BIGINT) AS hi FROM b)
SELECT c_custkey, array_to_string(list_transform(list_distinct_sorted, lambda x: CAST(x AS VARCHAR)), ',') AS frames FROM (SELECT c_custkey, list_sort(list_distinct(flatten(list(CASE WHEN hi - lo = 1 THEN [lo] ELSE [lo, hi - 1] END)))) AS list_distinct_sorted FROM r GROUP BY 1)""")
def binwise_indices(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60 + 1).alias("t"))
    listed = lambda t: F.array_join(F.transform(sampling.binwise(t), lambda x: x["frame"].cast("string")), ",")
    return sampling.per_total(c, "t", "frames", listed).select("c_custkey", "frames")


# --- timelines ----------------------------------------------------------------------------------------------------

_T = V.TIMELINE


_OPTIONS = "o AS (SELECT doc_id, string_split(text, ' ')[1:5] AS w, CASE doc_id % 4 WHEN 0 THEN chr(CAST(65 + doc_id % 7 AS INT)) WHEN 1 THEN chr(CAST(97 + doc_id % 7 AS INT)) WHEN 2 THEN CAST(doc_id % 9 AS VARCHAR) ELSE 'none' END AS answer FROM documents)"


@query(f"""WITH {_OPTIONS}, p AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN doc_id % 7 WHEN 1 THEN doc_id % 7 WHEN 2 THEN doc_id % 9 END AS spot FROM o),
t AS (SELECT doc_id, answer, spot, list_transform(w, lambda x, i: CASE WHEN i % 2 = 1 THEN '(' || chr(CAST(64 + i AS INT)) || ') ' || x ELSE chr(CAST(64 + i AS INT)) || '. ' || x END) AS w, w AS bare FROM p)
SELECT doc_id, CASE WHEN spot IS NULL OR spot >= len(w) THEN answer WHEN doc_id % 4 = 2 OR trim(bare[spot + 1], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN w[spot + 1] ELSE regexp_replace(bare[spot + 1], '^\\s+', '') END AS chosen FROM t""")
def chosen_option(spark, sf_dir):
    """Five words of each text as labelled options, picked by letters, numbers, and selectors that pick nothing."""
    d = table(spark, sf_dir, "documents")
    k, letter = F.col("doc_id") % 4, lambda base: F.char(base + F.col("doc_id") % 7)
    answer = F.when(k == 0, letter(65)).when(k == 1, letter(97)).when(k == 2, (F.col("doc_id") % 9).cast("string")).otherwise("none")
    label = lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("("), F.char(65 + i), F.lit(") "), x)).otherwise(F.concat(F.char(65 + i), F.lit(". "), x))
    options = F.transform(F.slice(F.split("text", " "), 1, 5), lambda x, i: F.struct(F.lit(None).cast("string").alias("key"), label(x, i).alias("text")))
    return d.select("doc_id", annotations.chosen(answer, options).alias("chosen"))


@query("""SELECT doc_id, CAST(doc_id AS VARCHAR) AS video_id, 'lang ' || coalesce(lang, 'none') AS question, CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'src: ' || coalesce(source, 'None') ELSE 'a b' END AS answer,
'[' || doc_id % 9 || '] said plain' || CASE WHEN doc_id % 2 = 0 THEN ' why' ELSE '' END AS caption, CASE doc_id % 4 WHEN 0 THEN n_chars / 2 WHEN 1 THEN CAST(n_chars AS DOUBLE) WHEN 2 THEN 1.5 END AS duration,
CASE WHEN doc_id % 5 = 0 THEN 'one|two' WHEN doc_id % 5 = 1 THEN 'x|y' ELSE '' END AS points, CASE WHEN doc_id % 5 = 0 THEN 'key_points' WHEN doc_id % 5 = 1 THEN 'clues' ELSE '' END AS field FROM documents""")
def sample_mapping(spark, sf_dir):
    """Annotations of loosely typed values, made from every document: blanks, nested values, numbers as texts, lists in texts."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    source, none = F.coalesce("source", F.lit("None")), F.lit(None).cast("string")
    raw = F.struct(
        F.lit("").alias("video_id"), k.alias("id"), F.concat(F.lit("  lang "), F.coalesce("lang", F.lit("none")), F.lit(" ")).alias("question"),
        F.when(k % 3 == 0, F.parse_json(F.lit('"yes"'))).when(k % 3 == 1, F.parse_json(F.concat(F.lit('{"src": "'), source, F.lit('"}')))).otherwise(F.parse_json(F.lit('["a", "b"]'))).alias("answer"),
        F.array(F.to_json(F.struct((k % 9).alias("start"), F.lit("said").alias("text")))).alias("_s"), F.when(k % 2 == 0, "why").alias("prompt"),
        F.when(k % 4 == 0, (F.col("n_chars") / 2).cast("string")).when(k % 4 == 1, F.col("n_chars").cast("string")).when(k % 4 == 2, "1.5").otherwise("long").alias("duration"),
        F.when(k % 5 == 0, F.lit("one， two ; ")).otherwise(none).alias("key_points"), F.when(k % 5 == 1, F.lit('["x", " ", "y"]')).otherwise(none).alias("clues"),
    )
    text_ = F.to_json(raw.dropFields("_s"))
    subtitles = F.concat(F.lit(', "subtitles": [{"start": '), (k % 9).cast("string"), F.lit(', "text": "said"}, "plain"]}'))
    samples = annotations.to_samples(d.select(F.concat(F.regexp_replace(text_, "}$", ""), subtitles).alias("raw")))
    return samples.select(F.col("video_id").cast("long").alias("doc_id"), "video_id", "question", "answer", "caption", "duration", F.array_join("semantic_points", "|").alias("points"), F.col("semantic_point_source_field").alias("field"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Evidence context: q' || doc_id % 5 END AS context, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN NULL ELSE 'Expected answer: ' || coalesce(lang, 'none') END AS answer,
CASE WHEN doc_id % 7 = 0 THEN 'question is blank' WHEN doc_id % 11 = 0 THEN 'answer is blank' END AS issue FROM documents""")
def reference_points(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = d.select("doc_id", F.when(k % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" q"), k % 5)).alias("question"), F.when(k % 11 == 0, F.lit("")).otherwise(F.coalesce("lang", F.lit("none"))).alias("answer"))
    out, good = annotations.reference_points(rows), F.col("issue").isNull()
    context = F.when(good | (F.col("issue") == "answer is blank"), F.col("reference_points")[0])
    return out.select("doc_id", context.alias("context"), F.when(good, F.col("reference_points")[1]).alias("answer"), "issue")


_REPLIES = (
    ('{"timeline": [%s]}', ""), ('```json\n{"timeline": [%s, %s]}\n```', ""), ('{"controls": {"timeline": [%s]}}', ""), ("[%s, %s]", "expected one JSON object, received an array of 2 items"), ("5", "top-level JSON value is not an object"),
    ("{}", "the required `timeline` field is not a JSON array"), ('{"timeline": [7]}', "timeline[1] is not a JSON object"), ('{"timeline": [{"start": "5"}]}', "timeline[1].start must be a finite JSON number; received str"),
    ('{"timeline": [{"end": true}]}', "timeline[1].end must be a finite JSON number; received bool"), ('{"timeline": [{"control_tags": ["summary", "summary"]}]}', "timeline[1].control_tags contains duplicate tags"),
    ("stop it " * 40, "degenerate repetition: period=8"), ('{"timeline": [{"narration": 4}]}', "timeline[1].narration must be a JSON string; received int"),
)
_SEGMENT = '{"start": 0, "end": 6, "narration": "plain", "on_screen_text": "", "salient_point": "", "control_tags": []}'


@query("SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{reason}'" for i, (_, reason) in enumerate(_REPLIES)) + " END AS reason, CASE doc_id % 12 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS segments, CASE WHEN doc_id % 12 = 1 THEN 'single_markdown_json_fence' ELSE 'raw_json' END AS envelope FROM documents")
def reply_parsing(spark, sf_dir):
    """A reply for each document, of twelve kinds."""
    made = F.get(F.array(*[F.lit(reply.replace("%s", _SEGMENT)) for reply, _ in _REPLIES]), (F.col("doc_id") % 12).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", parsing.parsed_candidate(made).alias("c"))
    return rows.select("doc_id", "c.reason", F.coalesce(F.size(parsing.timeline(F.col("c"))), F.lit(0)).alias("segments"), "c.envelope")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0 WHEN c_custkey % 10 < 3 THEN 0 ELSE greatest(0, least(1, round(c_acctbal / 5000, 6))) END AS clipped, CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE printf('%.4f', c_acctbal) END AS text FROM customer")
def clipped_numbers(spark, sf_dir):
    k, x = F.col("c_custkey") % 10, F.col("c_acctbal").cast("double")
    value = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.round(x / 5000, 6))
    return table(spark, sf_dir, "customer").select("c_custkey", vectors.clip01(value).alias("clipped"), text.four_digits(F.when(k != 0, x)).alias("text"))


_BROKEN = (
    ("protocol_fingerprint", F.lit, "x", "protocol_fingerprint is invalid"), ("experiment_version", F.lit, "x", "experiment_version is invalid"), ("prompt_version", F.lit, "x", "prompt_version is invalid"), ("requested_slots", F.lit, 3, "the requested slot count is invalid"),
    ("valid_slots", F.lit, 3, "valid_slots does not match the slots"), ("full_pool", F.lit, False, "full_pool does not match the slots"), ("direct_id", F.lit, "c2", "the direct candidate is not C1"), ("best_id", F.lit, "c3", "the selected candidate is not the best"),
    *[(f"efficiency.{n}", F.lit, 99, f"efficiency.{n} differs from " + ("the slots" if whole else "C1")) for n, (_, whole) in contracts.COUNTS.items()],
    ("efficiency.sampled_frames", F.lit, 3, "efficiency.sampled_frames differs from the sampling"), ("efficiency.metric_seconds", F.lit, -1.0, "efficiency.metric_seconds is not a duration"), ("efficiency.direct_seconds", F.lit, 2.0, "efficiency.direct_seconds is inconsistent"),
    ("efficiency.best_seconds", F.lit, 2.0, "efficiency.best_seconds is inconsistent"), ("efficiency.generation_seconds", F.lit, 3.0, "efficiency.generation_seconds is shorter than its requests"), ("efficiency.pipeline_seconds", F.lit, 4.0, "efficiency.pipeline_seconds is shorter than its parts"),
    ("sampling.source_kind", F.lit, "made", "sampling did not use a real source"), ("sampling.fallback_used", F.lit, True, "sampling used a fallback"), ("sampling.eligible", F.lit, False, "sampling is not eligible"),
)


def _whole_row() -> dict:
    """A result row without a fault."""
    usage = {"input_tokens": 2, "output_tokens": 3, "total_tokens": 5}
    attempt = {"attempt": 1, "prompt_kind": "base_generation", "status": "accepted", "request_seconds": 1.0, "returned_model_id_conflict": False, "visual_input_frames": 2}
    slots = [{"candidate_index": i, "terminal_status": "valid", "candidate_id": f"c{i}", "request_count": 1, "transport_request_count": 1, "request_seconds": 1.0, "usage": usage, "attempts": [attempt]} for i in range(1, 5)]
    once = {"requests": 1, "semantic_attempts": 1, **usage}
    spent = {f"{who}_{what}": n * v for who, n in (("generation", 4), ("direct", 1), ("best", 4)) for what, v in once.items()}
    seconds = {"sampling_seconds": 0.5, "reward_encoding_seconds": 0.1, "reward_scoring_seconds": 0.4, "selection_seconds": 0.0, "direct_seconds": 1.5, "best_seconds": 5.0, "generation_seconds": 4.0, "metric_seconds": 0.2, "pipeline_seconds": 6.0}
    return {
        "sample_key": "s", "video_id": "v", "experiment_version": "e", "prompt_version": "q", "requested_slots": 4, "protocol_fingerprint": "p", "generation_source": "multimodal_model",
        "sampling": {"source_kind": "video", "fallback_used": False, "eligible": True, "selected_indices": [0, 3], "bin_ids": [0, 1]}, "slots": slots,
        "candidates": [{"candidate_index": i, "candidate_id": f"c{i}", "reward": r} for i, r in zip(range(1, 5), (0.1, 0.5, 0.5, 0.2), strict=True)], "valid_slots": 4, "full_pool": True, "direct_id": "c1", "best_id": "c2",
        "efficiency": spent | seconds | {"sampled_frames": 2, "seconds_by_slot": [1.0] * 4, "usage_by_slot": [usage] * 4, "scoring_seconds_by_slot": [0.1] * 4},
    }


@query(f"SELECT c_custkey, CASE c_custkey % {len(_BROKEN) + 1} " + " ".join(f"WHEN {i} THEN '{b[3]}'" for i, b in enumerate(_BROKEN)) + " END AS issue FROM customer")
def row_contract(spark, sf_dir):
    """A result row for each customer, with one of the faults or none."""
    row = spark.createDataFrame([_whole_row()], contracts.RESULT)
    rows, k = table(spark, sf_dir, "customer").select("c_custkey").crossJoin(F.broadcast(row)), F.col("c_custkey") % (len(_BROKEN) + 1)  # one row
    for i, (path, lit, value, _) in enumerate(_BROKEN):
        name, _, inner = path.partition(".")
        old = F.col(name)
        new = old.withField(inner, lit(value).cast(row.schema[name].dataType[inner].dataType)) if inner else lit(value).cast(row.schema[name].dataType)
        rows = rows.withColumn(name, F.when(k == i, new).otherwise(old))
    return contracts.with_issues(rows, "p", "e", "q").select("c_custkey", "issue")


@query("""SELECT c_custkey, 'c' || c_custkey AS sample_key, 'the selected candidate is not the best' AS issue FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 'c' || c_custkey, 'not a current sample' FROM customer WHERE c_nationkey % 5 = 0""")
def resume_check(spark, sf_dir):
    """Earlier results of every customer, every seventh broken; the current samples lack those of every fifth nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("c"), "c_custkey").alias("key"))
    row = spark.createDataFrame([_whole_row()], contracts.RESULT).drop("sample_key", "best_id")
    results = c.crossJoin(F.broadcast(row)).withColumns({"sample_key": F.col("key"), "best_id": F.when(F.col("c_custkey") % 7 == 0, "c4").otherwise("c2")})  # one row
    issues = contracts.resume_issues(results, c.where("c_nationkey % 5 <> 0").select(F.col("key").alias("sample_key")), "p")
    return issues.select(F.substring("sample_key", 2, 20).cast("long").alias("c_custkey"), "sample_key", "issue")


_MATRIX_ROW = {"requested": 10, "direct_ok": 8, "direct_success_rate": 0.8, "direct_cond_reward": 0.5, "direct_eff_reward": 0.4, "best_of_4_ok": 9, "best_of_4_success_rate": 0.9, "best_of_4_cond_reward": 0.6, "best_of_4_eff_reward": 0.54}
_MATRIX_BROKEN = (
    ({"requested": 0}, "requested is not positive"), ({"direct_ok": 11}, "direct successes are out of range"), ({"best_of_4_success_rate": 0.8}, "best_of_4 success rate does not follow from its counts"),
    ({"direct_cond_reward": None}, "direct reward: a conditional mean needs successes"), ({"direct_eff_reward": 1.5}, "direct reward: the effective mean is outside 0 to 1"), ({"best_of_4_eff_reward": 0.6}, "best_of_4 reward: effective and conditional means disagree"),
    ({"direct_ok": 10, "direct_success_rate": 1.0, "direct_cond_reward": 0.4}, "direct succeeds more often than best_of_4"), ({"direct_cond_reward": 0.75, "direct_eff_reward": 0.6}, "the first candidate beats the best"),
)


@query(f"SELECT c_custkey, CASE c_custkey % {len(_MATRIX_BROKEN) + 1} " + " ".join(f"WHEN {i} THEN '{message}'" for i, (_, message) in enumerate(_MATRIX_BROKEN)) + " END AS issue FROM customer")
def matrix_row_contract(spark, sf_dir):
    """A matrix row for each customer, with one of the faults or none."""
    k = F.col("c_custkey") % (len(_MATRIX_BROKEN) + 1)
    columns = {}
    for name, value in _MATRIX_ROW.items():
        kind = "int" if isinstance(value, int) else "double"
        out = F.lit(value).cast(kind)
        for i, (changes, _) in enumerate(_MATRIX_BROKEN):
            if name in changes:
                out = F.when(k == i, F.lit(changes[name]).cast(kind)).otherwise(out)
        columns[name] = out
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(n) for n, v in columns.items()])
    return rows.select("c_custkey", contracts.matrix_row_issue(("reward",)).alias("issue"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE event_id % 97 END AS input_tokens, CASE event_id % 6 WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE event_id % 53 END AS output_tokens,
CASE event_id % 3 WHEN 0 THEN 'say ' || event_type WHEN 1 THEN 'a' || event_type ELSE '' END AS text FROM events""")
def response_fields(spark, sf_dir):
    """Usage counts and message text of chat responses made from events: both namings, wrong and missing totals, parts and none."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    given, made, total = (k % 97).cast("string"), (k % 53).cast("string"), (k % 97 + k % 53).cast("string")
    usage = (
        F.when(k % 6 == 0, F.concat(F.lit('{"input_tokens": '), given, F.lit(', "output_tokens": '), made, F.lit("}"))).when(k % 6 == 1, F.concat(F.lit('{"prompt_tokens": '), given, F.lit(', "completion_tokens": '), made, F.lit(', "total_tokens": '), total, F.lit("}")))
        .when(k % 6 == 2, F.concat(F.lit('{"prompt_tokens": '), given, F.lit(', "completion_tokens": '), made, F.lit(', "total_tokens": 9999}'))).when(k % 6 == 4, F.concat(F.lit('{"prompt_tokens": '), given, F.lit("}")))
        .otherwise(F.concat(F.lit('{"input_tokens": '), given, F.lit(', "completion_tokens": '), made, F.lit("}")))
    )
    content = F.when(k % 3 == 0, F.concat(F.lit('"say '), "event_type", F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('[{"type": "text", "text": "a"}, {"type": "text", "text": "'), "event_type", F.lit('"}, {"type": "image"}]'))).otherwise("null")
    reply = F.concat(F.lit('{"choices": [{"message": {"content": '), content, F.lit("}}]}"))
    out = e.select("event_id", parsing.usage_counts(F.parse_json(usage)).alias("u"), parsing.message_text(F.parse_json(reply)).alias("text"))
    return out.select("event_id", "u.input_tokens", "u.output_tokens", "text")


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_concat(string_split(text, ' '), flatten(list_transform(range(8), lambda i: string_split(text, ' ')[1:doc_id % 10 + 1]))) ELSE string_split(text, ' ') END AS t FROM documents)
SELECT doc_id, coalesce(CASE WHEN len(t) >= 128 THEN list_filter([1, 2, 3, 4, 5, 6, 7, 8], lambda p: len(t) >= 8 * p AND t[len(t) - 8 * p + 1:] = flatten(list_transform(range(8), lambda i: t[len(t) - p + 1:])))[1] END, 0) AS period FROM t""")
def repeated_tail(spark, sf_dir):
    """The words of each text, every third one followed by its first words eight times."""
    d, words = table(spark, sf_dir, "documents"), F.split("text", " ")
    again = F.flatten(F.array_repeat(F.slice(words, F.lit(1), (F.col("doc_id") % 10 + 1).cast("int")), 8))
    return d.select("doc_id", F.coalesce(text.repeated_tail(F.when(F.col("doc_id") % 3 == 0, F.concat(words, again)).otherwise(words)), F.lit(0)).alias("period"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'provenance is missing' WHEN lang = 'de' THEN 'parse_status is not valid_json_candidate' WHEN n_chars % 5 = 0 THEN 'semantic_repair_applied must be false' WHEN n_chars % 7 = 0 THEN 'wrapped_free_text must be false'
WHEN length(source) % 2 = 0 THEN 'surrounding_free_text must be false' WHEN n_chars % 3 = 0 THEN 'response_envelope is unknown' END AS issue FROM documents""")
def provenance_issues(spark, sf_dir):
    n = F.col("n_chars")
    p = F.struct(
        F.when(F.coalesce(F.col("lang") != "de", F.lit(True)), "valid_json_candidate").otherwise("free_text").alias("parse_status"), (n % 5 == 0).alias("semantic_repair_applied"), F.when(n % 7 != 0, F.lit(False)).alias("wrapped_free_text"),
        F.coalesce(F.length("source") % 2 == 0, F.lit(False)).alias("surrounding_free_text"), F.when(n % 3 == 0, "other").when(n % 2 == 0, "raw_json").otherwise("single_markdown_json_fence").alias("response_envelope"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", identity.provenance_issue(F.when(F.col("doc_id") % 11 != 0, p)).alias("issue"))


@query(f"""WITH {V.ATTEMPTS}, a AS (SELECT status, CASE WHEN attempt_id % 4 = 0 THEN 'base_generation' WHEN attempt_id % 4 < 3 THEN 'validation_retry' END AS prompt_kind FROM attempts_v)
SELECT 'status' AS what, coalesce(status, 'unknown') AS value, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'prompt_kind', coalesce(prompt_kind, 'unknown'), count(*) FROM a GROUP BY 2""")
def attempt_counts(spark, sf_dir):
    k = F.col("attempt_id") % 4
    return stats.attempt_counts(V.attempts(spark, sf_dir).withColumn("prompt_kind", F.when(k == 0, "base_generation").when(k < 3, "validation_retry")))


@query(f"WITH {_T} SELECT candidate_id, round(0.60 * (1 - avg(least(1.0, abs(words - 12) / 12))) + 0.25 * avg(CAST(words BETWEEN 6 AND 18 AS INT)) + 0.15 * avg(CAST(complete AS INT)), 9) AS readability FROM timeline_v GROUP BY 1")
def readability(spark, sf_dir):
    return V.timelines(spark, sf_dir).select("candidate_id", r9(timeline.readability(F.col("segments"))).alias("readability"))


_RHYTHM = """obs AS (SELECT c.candidate_id, k.k, coalesce(greatest(0, t.e - t.s), 0) AS d, c.n FROM (SELECT candidate_id, count(*) AS n FROM timeline_v GROUP BY 1) c, (SELECT unnest([1, 2, 3, 4, 5]) AS k) k LEFT JOIN timeline_v t ON t.candidate_id = c.candidate_id AND t.segment_index = k.k),
cum AS (SELECT *, sum(d) OVER (PARTITION BY candidate_id ORDER BY k) AS b FROM obs),
rh AS (SELECT candidate_id, 0.55 * greatest(0, least(1, 1 - sum(abs(d - 6)) / 60)) + 0.45 * greatest(0, least(1, 1 - 2 * avg(abs(b - 6 * k)) / 30)) - greatest(0, max(n) - 5) / 5 AS r FROM cum GROUP BY 1)"""


@query(f"WITH {_T}, {_RHYTHM} SELECT candidate_id, round(greatest(0, least(1, r)), 9) AS rhythm FROM rh")
def rhythm(spark, sf_dir):
    return V.timelines(spark, sf_dir, words=False).select("candidate_id", r9(timeline.rhythm(F.col("segments"))).alias("rhythm"))


_VALID = """lagged AS (SELECT *, lag(e) OVER (PARTITION BY candidate_id ORDER BY segment_index) AS pe FROM timeline_v),
val AS (SELECT candidate_id, bool_and(s >= 0 AND e > s AND (pe IS NULL OR s >= pe - 1e-6)) AS ok, min(s) AS first_start, max(CASE WHEN is_summary THEN e END) AS last_end, sum(greatest(0, coalesce(s - pe, 0))) AS gaps, count(*) AS n, avg(words) AS density,
 bool_and(regexp_replace(narration, '\\s+', '', 'g') <> '') AS present, max(CASE WHEN is_summary THEN segment_index END) AS summary_index FROM lagged GROUP BY 1),
cov AS (SELECT *, ok AND first_start <= 1.5 AND abs(last_end - 30) / 30 <= 0.15 AND gaps / 30 <= 0.15 AS covered FROM val),
vio AS (SELECT *, list_filter([CASE WHEN n <> 5 THEN 'segment_count' END, CASE WHEN NOT ok THEN 'timestamp_validity' END, CASE WHEN NOT covered THEN 'duration_coverage' END, CASE WHEN NOT present THEN 'required_fields' END, CASE WHEN summary_index <> 5 THEN 'summary_position' END, CASE WHEN density NOT BETWEEN 6 AND 18 THEN 'information_density' END], lambda x: x IS NOT NULL) AS violations FROM cov)"""


@query(f"WITH {_T}, {_VALID} SELECT candidate_id, ok FROM val")
def timestamps_valid(spark, sf_dir):
    return V.timelines(spark, sf_dir, words=False).select("candidate_id", timeline.timestamps_valid(F.col("segments")).alias("ok"))


@query(f"WITH {_T}, {_VALID} SELECT candidate_id, covered FROM cov")
def duration_coverage(spark, sf_dir):
    return V.timelines(spark, sf_dir, words=False).select("candidate_id", timeline.duration_coverage(F.col("segments")).alias("covered"))


@query(f"WITH {_T}, {_VALID} SELECT candidate_id, array_to_string(violations, '|') AS violations, round(1 - len(violations) / 6, 9) AS control FROM vio")
def control_violations(spark, sf_dir):
    v = timeline.violations(F.col("segments"))
    return V.timelines(spark, sf_dir).select("candidate_id", F.array_join(v, "|").alias("violations"), r9(timeline.control_score(v)).alias("control"))


@query(f"""WITH {_T}, {_RHYTHM}, {_VALID}, rd AS (SELECT candidate_id, 0.60 * (1 - avg(least(1.0, abs(words - 12) / 12))) + 0.25 * avg(CAST(words BETWEEN 6 AND 18 AS INT)) + 0.15 * avg(CAST(complete AS INT)) AS x, string_agg(narration, chr(10) ORDER BY segment_index) AS text FROM timeline_v GROUP BY 1)
SELECT candidate_id, round((6 * 0.5 + 3 * x + 3 * greatest(0, least(1, r)) + 4 * (1 - len(violations) / 6) + (1 - len({_terms_sql(_FREQUENT)}) / 7)) / 17, 9) AS reward FROM rd JOIN rh USING (candidate_id) JOIN vio USING (candidate_id)""")
def composite_reward(spark, sf_dir):
    s = F.col("segments")
    whole = text.non_blank_join([F.array_join(F.transform(s, lambda x: x["narration"]), "\n")], "\n")
    risk = text.risk_score(text.risk_terms(whole, _FREQUENT), _FREQUENT)
    total = timeline.total_reward(alignment=F.lit(0.5), readability=timeline.readability(s), rhythm=timeline.rhythm(s), control=timeline.control_score(timeline.violations(s)), risk=risk)
    return V.timelines(spark, sf_dir).select("candidate_id", r9(total).alias("reward"))


# --- selection and statistics ---------------------------------------------------------------------------------------

_METRICS = ("reward", "csr", "rep")
_PICK = f"""{V.SLOTS}, k AS (SELECT DISTINCT sample_key FROM slots_v), m AS (SELECT 'direct' AS method, 1 AS p UNION ALL SELECT 'best_of_4', 4),
pick AS (SELECT m.method, sv.*, row_number() OVER (PARTITION BY m.method, sv.sample_key ORDER BY sv.reward DESC, sv.candidate_index) AS rn FROM slots_v sv JOIN m ON sv.candidate_index <= m.p WHERE sv.valid),
sel AS (SELECT k.sample_key, m.method, p.candidate_id, p.reward, p.csr, p.rep FROM k CROSS JOIN m LEFT JOIN (SELECT * FROM pick WHERE rn = 1) p ON p.sample_key = k.sample_key AND p.method = m.method)"""


@query(f"""WITH {_PICK} SELECT method, count(*) AS requested, count(candidate_id) AS ok, round(avg(reward), 9) AS cond_reward, round(avg(coalesce(reward, 0)), 9) AS eff_reward,
round(avg(csr), 9) AS cond_csr, round(avg(coalesce(csr, 0)), 9) AS eff_csr, round(avg(rep), 9) AS cond_rep, round(avg(coalesce(rep, 1)), 9) AS eff_rep FROM sel GROUP BY method""")
def effective_vs_conditional(spark, sf_dir):
    s = stats.summarize_methods(selection.selections(V.slots(spark, sf_dir), _METRICS), _METRICS)
    return s.select("method", "requested", "ok", *[r9(F.col(f"{k}_{m}")).alias(f"{k}_{m}") for m in _METRICS for k in ("cond", "eff")])


_MAIN = ", ".join(f"round({a}, 9) AS {k}_{m}" for k, f in (("conditional", "avg({m})"), ("effective", "avg(coalesce({m}, {w}))")) for m in _METRICS for a in [f.format(m=m, w=int(m == "rep"))])


@query(f"""WITH {_PICK}, n AS (SELECT m.method, sv.sample_key, count(*) FILTER (WHERE valid) = count(*) AS whole FROM slots_v sv JOIN m ON sv.candidate_index <= m.p GROUP BY 1, 2),
b AS (SELECT sample_key, max(reward) FILTER (WHERE valid) AS reward, max(csr) FILTER (WHERE valid) AS csr, min(rep) FILTER (WHERE valid) AS rep, count(*) FILTER (WHERE valid) AS v, count(*) AS c FROM slots_v GROUP BY 1)
SELECT sel.method, count(*) AS requested_samples, count(candidate_id) AS successful_samples, round(avg(CAST(candidate_id IS NOT NULL AS INT)), 9) AS selection_success_rate, round(avg(CAST(whole AS INT)), 9) AS complete_requested_prefix_rate, {_MAIN} FROM sel JOIN n ON sel.method = n.method AND sel.sample_key = n.sample_key GROUP BY 1
UNION ALL SELECT 'metric_wise_upper_bound', count(*), count(*) FILTER (WHERE v > 0), round(avg(CAST(v > 0 AS INT)), 9), round(avg(CAST(v = c AS INT)), 9), {_MAIN} FROM b""")
def main_results(spark, sf_dir):
    s = V.slots(spark, sf_dir)
    summary = stats.summarize_methods(selection.selections(s, _METRICS), _METRICS)
    table_ = reports.main_table(summary, reports.bound_summary(s, _METRICS), _METRICS)
    return table_.select(*table_.columns[:3], *[r9(F.col(c)).alias(c) for c in table_.columns[3:]])


@query(f"WITH {V.SLOTS} SELECT sample_key, candidate_id, reward FROM slots_v WHERE valid QUALIFY row_number() OVER (PARTITION BY sample_key ORDER BY reward DESC, candidate_index) = 1")
def best_of_4(spark, sf_dir):
    return selection.best_of(V.slots(spark, sf_dir)).select("sample_key", "candidate_id", "reward")


@query(f"WITH {V.SLOTS} SELECT sample_key, candidate_id, reward FROM slots_v WHERE valid AND candidate_index = 1")
def direct_c1(spark, sf_dir):
    return selection.direct(V.slots(spark, sf_dir)).select("sample_key", "candidate_id", "reward")


@query(f"""WITH {V.SLOTS}, l AS (SELECT sample_key, candidate_index, candidate_id, unnest(['reward', 'csr', 'rep']) AS metric, unnest([reward, csr, rep]) AS value FROM slots_v WHERE valid)
SELECT sample_key, metric, value, candidate_id FROM l QUALIFY row_number() OVER (PARTITION BY sample_key, metric ORDER BY CASE WHEN metric = 'rep' THEN -value ELSE value END DESC, candidate_index) = 1""")
def upper_bound_by_metric(spark, sf_dir):
    return selection.upper_bound(V.slots(spark, sf_dir), _METRICS)


@query(f"WITH {_PICK} SELECT m.method, count(*) AS slots, count(*) FILTER (WHERE valid) AS valid_slots FROM slots_v JOIN m ON candidate_index <= m.p GROUP BY 1")
def prefix_methods(spark, sf_dir):
    return selection.by_method(V.slots(spark, sf_dir)).groupBy("method").agg(F.count(F.lit(1)).alias("slots"), F.count_if("valid").alias("valid_slots"))


@query(f"WITH {V.SLOTS} SELECT valid_slots, count(*) AS n FROM (SELECT sample_key, count(*) FILTER (WHERE valid) AS valid_slots FROM slots_v GROUP BY 1) GROUP BY 1")
def valid_slot_histogram(spark, sf_dir):
    per = V.slots(spark, sf_dir).groupBy("sample_key").agg(F.count_if("valid").alias("valid_slots"))
    return stats.histogram(per, "valid_slots")


@query("SELECT coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def source_kind_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("source"))
    return stats.value_counts(d, "source")


@query(f"""WITH {V.SLOTS}, p AS (SELECT sample_key, count(*) AS n, count(*) FILTER (WHERE valid) AS v FROM slots_v GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS slots, CAST(sum(v) AS BIGINT) AS valid_slots, count(*) AS samples, count(*) FILTER (WHERE v = 4 AND n = 4) AS full_pools, round(avg(CAST(v = 4 AND n = 4 AS INT)), 9) AS full_pool_rate FROM p""")
def pool_integrity(spark, sf_dir):
    return stats.pool_integrity(V.slots(spark, sf_dir)).withColumn("full_pool_rate", r9(F.col("full_pool_rate")))


@query(f"""WITH {_PICK}, c AS (SELECT * FROM sel WHERE method = 'best_of_4') SELECT count(*) AS samples, (SELECT count(*) FROM slots_v WHERE valid) AS candidates, round(avg(CAST(candidate_id IS NOT NULL AS INT)), 9) AS success_rate,
round(coalesce(avg(reward), 0), 9) AS mean_reward, round(coalesce(avg(csr), 0), 9) AS mean_csr, round(coalesce(avg(rep), 0), 9) AS mean_rep FROM c""")
def result_summary(spark, sf_dir):
    slots = V.slots(spark, sf_dir)
    picked = selection.selections(slots, _METRICS, {"best_of_4": 4})
    means = [r9(stats.mean_or_zero(m)).alias(f"mean_{m}") for m in _METRICS]
    return picked.agg(F.count(F.lit(1)).alias("samples"), F.sum("valid_slots").alias("candidates"), r9(F.avg(F.col("candidate_id").isNotNull().cast("int"))).alias("success_rate"), *means)


@query(f"""WITH {V.ATTEMPTS}, l AS (SELECT status, unnest(['request_seconds', 'input_tokens', 'output_tokens']) AS key, unnest([request_seconds, CAST(input_tokens AS DOUBLE), CAST(output_tokens AS DOUBLE)]) AS value FROM attempts_v)
SELECT status, key, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 4) AS total FROM l GROUP BY 1, 2""")
def efficiency_percentiles(spark, sf_dir):
    a = V.attempts(spark, sf_dir).withColumn("request_seconds", F.abs("request_seconds"))
    out = stats.efficiency(a, ("request_seconds", "input_tokens", "output_tokens"), ("status",))
    return out.select("status", "key", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], F.round("total", 4).alias("total"))


@query(f"""WITH {V.ATTEMPTS}, m AS (SELECT 'direct' AS method, 1 AS p UNION ALL SELECT 'best_of_4', 4), k AS (SELECT DISTINCT sample_key FROM attempts_v)
SELECT k.sample_key, m.method, round(coalesce(sum(a.request_seconds), 0), 4) AS request_seconds, CAST(coalesce(sum(a.input_tokens), 0) AS DOUBLE) AS input_tokens FROM k CROSS JOIN m LEFT JOIN attempts_v a ON a.sample_key = k.sample_key AND a.candidate_index <= m.p GROUP BY 1, 2""")
def method_efficiency(spark, sf_dir):
    out = stats.method_efficiency(V.attempts(spark, sf_dir), ("request_seconds", "input_tokens"), C.PREFIX_METHODS)
    return out.select("sample_key", "method", F.round("request_seconds", 4).alias("request_seconds"), "input_tokens")


@query(f"WITH {V.ATTEMPTS} SELECT attempt_id, round(sum(request_seconds) OVER (PARTITION BY sample_key ORDER BY candidate_index, attempt_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM attempts_v")
def prefix_sums(spark, sf_dir):
    out = selection.prefix_sums(V.attempts(spark, sf_dir), "request_seconds", order=("candidate_index", "attempt_id"))
    return out.select("attempt_id", F.round("running", 4).alias("running"))


_ROLL = f"""{V.ATTEMPTS}, roll AS (SELECT sample_key, candidate_index, count(*) AS attempts, sum(request_seconds) AS seconds, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
CASE WHEN bool_or(status = 'accepted') THEN 'accepted' WHEN bool_and(status = 'endpoint_error') THEN 'endpoint_errors_only' WHEN bool_and(status = 'parse_rejected') THEN 'parse_rejections_only' ELSE 'mixed_failures' END AS reason FROM attempts_v GROUP BY 1, 2)"""


@query(f"WITH {_ROLL} SELECT sample_key, candidate_index, attempts, round(seconds, 4) AS seconds, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, reason FROM roll")
def attempt_rollup(spark, sf_dir):
    return stats.rollup(V.attempts(spark, sf_dir), ("sample_key", "candidate_index")).withColumn("seconds", F.round("seconds", 4))


@query(f"""WITH {V.ATTEMPTS} SELECT sample_key, arg_max(status, attempt_id) AS last, max(input_tokens) AS max_input_tokens, max(output_tokens) AS max_output_tokens, bool_or(status = 'endpoint_error') AS any_flag, count(*) AS n FROM attempts_v GROUP BY 1""")
def last_metadata_max_peak(spark, sf_dir):
    return stats.peaks(V.attempts(spark, sf_dir), "sample_key", "status", "attempt_id", ("input_tokens", "output_tokens"), F.col("status") == "endpoint_error")


@query(f"WITH {_ROLL} SELECT reason, count(*) AS slots, CAST(sum(attempts) AS BIGINT) AS attempts FROM roll GROUP BY 1")
def failure_reasons(spark, sf_dir):
    rolled = stats.rollup(V.attempts(spark, sf_dir), ("sample_key", "candidate_index"))
    return rolled.groupBy("reason").agg(F.count(F.lit(1)).alias("slots"), F.sum("attempts").alias("attempts"))


def _bootstrap_sql(metrics: tuple[str, ...], worst: dict[str, int]) -> str:
    """Weights from the same hashes, weighted sums for each replicate, and their percentiles."""
    weight = " + ".join(f"CAST(h >= {step} AS INT)" for step in bootstrap.poisson_steps())
    sums = ", ".join(f"count({m}) AS n_{m}, coalesce(sum({m}), 0) AS cond_{m}, sum(coalesce({m}, {worst.get(m, 0)})) AS eff_{m}" for m in metrics)
    each = " UNION ALL ".join(f"SELECT method, cluster, '{m}' AS metric, '{e}' AS estimand, {n} AS n, {v} AS v FROM c" for m in metrics for e, n, v in (("conditional", f"n_{m}", f"cond_{m}"), ("effective", "n", f"eff_{m}")))
    return f"""c AS (SELECT method, CAST(sample_key % 40 AS VARCHAR) AS cluster, count(*) AS n, {sums} FROM sel GROUP BY 1, 2), l AS ({each}),
h AS (SELECT cluster, r, CAST('0x' || substr(sha256('{C.BOOTSTRAP_SEED}:' || (r // {bootstrap.PER_HASH}) || ':' || cluster), 8 * (r % {bootstrap.PER_HASH}) + 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT cluster FROM c), range({C.BOOTSTRAP_REPLICATES}) t(r)),
d AS (SELECT method, metric, estimand, sum(v * ({weight})) / sum(n * ({weight})) AS m FROM l JOIN h USING (cluster) WHERE n > 0 GROUP BY method, metric, estimand, r HAVING sum(n * ({weight})) > 0)
SELECT method, metric, estimand, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM d GROUP BY 1, 2, 3"""


@query(f"WITH {_PICK}, {_bootstrap_sql(_METRICS, {m: 1 for m in C.LOWER_IS_BETTER})}")
def cluster_bootstrap_ci(spark, sf_dir):
    slots = V.slots(spark, sf_dir)
    picked = selection.selections(slots, _METRICS).withColumn("video_id", F.col("sample_key") % 40)
    return bootstrap.cluster_intervals(picked, _METRICS, "video_id", ("direct", "best_of_4"))


@query(f"""WITH {_PICK} SELECT method, sample_key % 40 AS cluster, count(*) AS n, count(reward) AS n_reward, round(coalesce(sum(reward), 0), 6) AS cond_reward, round(sum(coalesce(reward, 0)), 6) AS eff_reward, round(sum(coalesce(rep, 1)), 6) AS eff_rep FROM sel GROUP BY 1, 2""")
def cluster_sums(spark, sf_dir):
    picked = selection.selections(V.slots(spark, sf_dir), ("reward", "rep")).withColumn("video_id", F.col("sample_key") % 40)
    sums = bootstrap.cluster_sums(picked, ("reward", "rep"), "video_id")
    return sums.select("method", F.col("cluster").cast("long").alias("cluster"), "n", "n_reward", *[F.round(c, 6).alias(c) for c in ("cond_reward", "eff_reward", "eff_rep")])


@query("SELECT r_name AS dataset, p_brand AS model FROM region CROSS JOIN (SELECT DISTINCT p_brand FROM part)")
def matrix_cross(spark, sf_dir):
    models = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model")).distinct()
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("dataset")).crossJoin(models)


_DIGEST_SQL = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "n_chars", "source", "text"))
_WORDS_SQL = " || ',' || ".join(f"CAST(sum(CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT)) AS VARCHAR)" for k in range(8))


@query(f"WITH r AS (SELECT lang, sha256({_DIGEST_SQL}) AS d FROM documents) SELECT lang, count(*) AS rows, sha256(count(*) || ',' || {_WORDS_SQL}) AS fingerprint FROM r GROUP BY lang")
def content_fingerprint(spark, sf_dir):
    return fingerprint.table_fingerprint(table(spark, sf_dir, "documents"), ("doc_id", "n_chars", "source", "text"), ("lang",))


def _nested_attempts(spark, sf_dir) -> DataFrame:
    """Slots of six events each, every event an attempt with one to three tries of its own; some logs break a rule."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    n = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    seconds = F.round(F.abs("value"), 3)
    tries = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        (i + F.when(k % 50 == 7, 1).otherwise(0)).alias("transport_attempt"), F.when((i < n) | (F.col("event_type") == "error"), "error").otherwise("success").alias("status"), (seconds * i).alias("request_seconds"),
        F.when(i < n, i * 1.5).when(k % 31 == 5, 1.5).otherwise(0.0).alias("backoff_seconds_after"), (k % 41 != 3).alias("retryable"),
    ))
    status = F.when(F.col("event_type") == "error", "endpoint_error").when((F.col("event_type") == "purchase") & (k % 6 >= 4), "accepted").otherwise("parse_rejected")
    attempt = F.struct(
        (k % 6 + 1).cast("int").alias("attempt"), status.alias("status"), (seconds * (n * (n + 1) / 2)).alias("request_seconds"), (k % 97).alias("input_tokens"), (k % 53).alias("output_tokens"),
        (n + F.when(k % 29 == 11, 1).otherwise(0)).alias("transport_request_count"), F.when(k % 13 != 4, tries).alias("transports"),
    )
    return e.select(F.floor(k / 6).alias("slot"), attempt.alias("a")).groupBy("slot").agg(F.array_sort(F.collect_list("a")).alias("attempts"))  # six events


_NESTED = """e AS (SELECT event_id AS k, event_id // 6 AS slot, event_id % 6 + 1 AS attempt, event_type AS kind, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS n, round(abs(value), 3) AS sec,
CASE WHEN event_type = 'error' THEN 'endpoint_error' WHEN event_type = 'purchase' AND event_id % 6 >= 4 THEN 'accepted' ELSE 'parse_rejected' END AS status, event_id % 13 = 4 AS bare FROM events),
t AS (SELECT e.*, i, CASE WHEN bare THEN sec * (n * (n + 1) / 2) ELSE sec * i END AS tsec, CASE WHEN bare THEN 0 WHEN i < n THEN 1.5 * i WHEN k % 31 = 5 THEN 1.5 ELSE 0 END AS wait,
CASE WHEN bare THEN kind = 'error' ELSE i < n OR kind = 'error' END AS failed FROM e JOIN range(1, 4) r(i) ON i <= CASE WHEN bare THEN 1 ELSE n END),
a AS (SELECT slot, attempt, k, any_value(status) AS status, count(*) AS tries, sum(tsec) AS tsec, sum(wait) AS wait, count(*) FILTER (failed) AS failed,
CASE WHEN any_value(bare) THEN NULL WHEN k % 50 = 7 THEN 'tries are not numbered 1, 2, 3 ...' WHEN any_value(n) > 1 AND k % 41 = 3 THEN 'a try follows an error that is not retryable' WHEN k % 31 = 5 THEN 'the last try is followed by a wait' END AS rule,
any_value(n) + CASE WHEN k % 29 = 11 THEN 1 ELSE 0 END <> count(*) AS differs FROM t GROUP BY slot, attempt, k),
b AS (SELECT *, coalesce(rule, CASE WHEN differs THEN 'the stated number of requests differs' END) AS issue, attempt - row_number() OVER (PARTITION BY slot ORDER BY attempt) AS gap, lead(attempt) OVER (PARTITION BY slot ORDER BY attempt) IS NOT NULL AS more FROM a)"""


@query(f"""WITH {_NESTED} SELECT slot, count(*)::INT AS attempts, sum(tries)::INT AS requests, sum(failed)::INT AS failed_requests, count(*) FILTER (tries > 1)::INT AS retried_attempts, round(sum(tsec), 4) AS request_seconds, round(sum(wait::DOUBLE), 4) AS backoff_seconds,
sum(k % 97)::BIGINT AS input_tokens, sum(k % 53)::BIGINT AS output_tokens, min(attempt) FILTER (status = 'accepted')::INT AS accepted_attempt FROM b GROUP BY slot""")
def nested_retries(spark, sf_dir):
    out = _nested_attempts(spark, sf_dir).select("slot", retries.nested_rollup(F.col("attempts")).alias("r")).select("slot", "r.*")
    return out.withColumns({c: F.round(c, 4) for c in ("request_seconds", "backoff_seconds")})


@query(f"""WITH {_NESTED} SELECT slot, CASE WHEN max(gap) > 0 THEN 'attempts are not numbered 1, 2, 3 ...' WHEN bool_or(status = 'accepted' AND more) THEN 'an attempt follows the accepted one'
ELSE 'attempt ' || min(attempt) FILTER (issue IS NOT NULL) || ': ' || arg_min(issue, attempt) FILTER (issue IS NOT NULL) END AS issue FROM b GROUP BY slot""")
def nested_retry_issues(spark, sf_dir):
    return _nested_attempts(spark, sf_dir).select("slot", retries.nested_issue(F.col("attempts")).alias("issue"))


_RESULTS = """r AS (SELECT doc_id, doc_id % 5 AS candidates, doc_id % 7 <> 0 AS ok, n_chars % 16 / 16.0 AS reward, doc_id % 8 / 8.0 AS align, n_chars % 3 = 0 AS clean, n_chars % 5 / 4.0 AS spc, 0.25 AS cider, n_chars % 9 / 8.0 AS rep,
CASE doc_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'npz' WHEN 2 THEN 'text' ELSE 'unknown' END AS kind, coalesce(source, 'unknown') AS gen FROM documents)"""


@query(f"""WITH {_RESULTS}, f AS (SELECT 'num_samples' AS field, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'num_candidates', sum(candidates)::DOUBLE FROM r UNION ALL SELECT 'selected_output_success_count', (count(*) FILTER (ok))::DOUBLE FROM r
UNION ALL SELECT 'selected_output_success_rate', round(avg(ok::INT), 6) FROM r UNION ALL SELECT 'real_video_rate', round(avg((kind IN ('video', 'npz'))::INT), 6) FROM r UNION ALL SELECT 'multimodal_generation_rate', round(avg((gen = 'multimodal_model')::INT), 6) FROM r
UNION ALL SELECT 'selected_metrics.' || m, round(avg(v), 6) FROM (SELECT unnest(['reward', 'mv_align', 'csr', 'semantic_point_coverage', 'cider_lite', 'rep']) AS m, unnest([reward::DOUBLE, align::DOUBLE, clean::INT::DOUBLE, spc::DOUBLE, cider::DOUBLE, rep::DOUBLE]) AS v FROM r WHERE ok) GROUP BY m)
SELECT * FROM f UNION ALL SELECT 'source_kind_counts.' || kind, count(*)::DOUBLE FROM r GROUP BY 1 UNION ALL SELECT 'generation_source_counts.' || gen, count(*)::DOUBLE FROM r GROUP BY 1""")
def run_summary(spark, sf_dir):
    """Every document as a result, with a nested selected candidate but where none was valid."""
    k, n = F.col("doc_id"), F.col("n_chars")
    violations = F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    reward = F.struct((n % 16 / 16).alias("total"), (k % 8 / 8).alias("alignment"), violations.alias("violations"))
    best = F.struct(reward.alias("reward"), F.struct((n % 5 / 4).alias("semantic_point_coverage"), F.lit(0.25).alias("cider_lite"), (n % 9 / 8).alias("repetition_rate")).alias("quality"))
    kind = F.when(k % 4 == 0, "video").when(k % 4 == 1, "npz").when(k % 4 == 2, "text")
    rows = table(spark, sf_dir, "documents").select((k % 5).alias("num_candidates"), F.when(k % 7 != 0, F.parse_json(F.to_json(best))).alias("best_candidate"), kind.alias("source_kind"), F.col("source").alias("generation_source"))
    return summary.run_summary(rows)


# --- audits -------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def audit_missing(spark, sf_dir):
    return quality.missing(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def audit_unexpected(spark, sf_dir):
    return quality.unexpected(table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def audit_duplicates(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_resume(spark, sf_dir):
    return quality.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT coalesce(n.k, o.k) AS dataset, coalesce(n.s, o.s) AS model, coalesce(n.v, o.v) AS value FROM (SELECT c_nationkey AS k, c_mktsegment AS s, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1, 2) o
FULL JOIN (SELECT c_nationkey + 13 AS k, c_mktsegment AS s, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY 1, 2) n ON o.k = n.k AND o.s = n.s""")
def summary_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = lambda key, value: c.groupBy(key.alias("dataset"), F.col("c_mktsegment").alias("model")).agg(value.alias("value"))
    stored = rows(F.col("c_nationkey"), F.round(F.sum("c_acctbal"), 2).cast("double"))
    return quality.upsert(stored, rows(F.col("c_nationkey") + 13, F.count(F.lit(1)).cast("double")), ["dataset", "model"])


@query(f"""WITH {V.ATTEMPTS} SELECT attempt_id, CASE WHEN output_tokens - attempt_id % 11 < 0 THEN 'usage is negative' WHEN attempt_id % 13 = 0 THEN 'total differs from input plus output' END AS issue FROM attempts_v""")
def usage_accounting(spark, sf_dir):
    a = V.attempts(spark, sf_dir)
    out = F.col("output_tokens") - F.col("attempt_id") % 11
    total = F.col("input_tokens") + out + F.when(F.col("attempt_id") % 13 == 0, 1).otherwise(0)
    return a.select("attempt_id", quality.usage_issue(F.col("input_tokens"), out, F.when(out < 0, F.lit(0)).otherwise(total)).alias("issue"))


@query(f"""WITH {_PICK}, x AS (SELECT method, avg(reward) AS cr, avg(coalesce(reward, 0)) + CASE method WHEN 'direct' THEN 0.01 ELSE 0 END AS er, avg(csr) AS cc, avg(coalesce(csr, 0)) AS ec, avg(rep) AS cp,
avg(coalesce(rep, 1)) + CASE method WHEN 'best_of_4' THEN 0.01 ELSE 0 END AS ep, avg(CAST(candidate_id IS NOT NULL AS INT)) AS s FROM sel GROUP BY method),
y AS (SELECT method, CASE WHEN abs(er - coalesce(cr, 0) * s) > 1e-4 THEN 'reward breaks the identity' WHEN abs(ec - coalesce(cc, 0) * s) > 1e-4 THEN 'csr breaks the identity'
WHEN abs(ep - coalesce(cp, 0) * s - (1 - s)) > 1e-4 THEN 'rep breaks the identity' END AS issue FROM x) SELECT * FROM y WHERE issue IS NOT NULL""")
def effective_identity(spark, sf_dir):
    """One stated mean of each method is off."""
    s = stats.summarize_methods(selection.selections(V.slots(spark, sf_dir), _METRICS), _METRICS)
    off = lambda m, method: F.col(m) + F.when(F.col("method") == method, 0.01).otherwise(0.0)
    return quality.identity_issues(s.withColumns({"eff_reward": off("eff_reward", "direct"), "eff_rep": off("eff_rep", "best_of_4")}), _METRICS)


@query(f"WITH {V.SLOTS} SELECT s.sample_key FROM slots_v s JOIN slots_v f ON s.sample_key = f.sample_key WHERE s.candidate_index = s.sample_key % 4 + 1 AND f.candidate_index = 1 AND coalesce(f.reward, 0) > coalesce(s.reward, 0)")
def reward_ordering(spark, sf_dir):
    """A selection that takes slot sample_key % 4 + 1, whatever its reward."""
    s = V.slots(spark, sf_dir)
    return quality.ordering_violations(s, s.where("candidate_index = sample_key % 4 + 1"))


@query(f"""WITH {V.SLOTS} SELECT coalesce(s.sample_key, c.sample_key) AS sample_key, coalesce(s.candidate_index, c.candidate_index) AS candidate_index, CASE WHEN c.sample_key IS NULL THEN 'slot_without_candidate' ELSE 'candidate_without_slot' END AS issue
FROM (SELECT * FROM slots_v WHERE valid) s FULL JOIN (SELECT * FROM slots_v WHERE candidate_id % 17 <> 3) c ON s.sample_key = c.sample_key AND s.candidate_index = c.candidate_index WHERE s.sample_key IS NULL OR c.sample_key IS NULL""")
def slot_candidate_audit(spark, sf_dir):
    s = V.slots(spark, sf_dir)
    return quality.slot_mismatches(s, s.where("candidate_id % 17 <> 3"))


@query(f"WITH {V.SLOTS} SELECT sample_key FROM slots_v WHERE candidate_id % 29 <> 3 GROUP BY 1 HAVING list_sort(list(candidate_index)) <> [1, 2, 3, 4]")
def slot_order_audit(spark, sf_dir):
    return quality.slot_order_issues(V.slots(spark, sf_dir).where("candidate_id % 29 <> 3"))


@query(f"""WITH {_ROLL} SELECT sample_key, candidate_index, CASE WHEN sample_key % 10 = 0 THEN 'attempt count differs' WHEN sample_key % 10 = 1 THEN 'seconds differ' ELSE 'tokens differ' END AS issue FROM roll WHERE sample_key % 10 < 3""")
def rollup_accounting(spark, sf_dir):
    rolled = stats.rollup(V.attempts(spark, sf_dir), ("sample_key", "candidate_index"))
    k = F.col("sample_key") % 10
    stated = rolled.select("sample_key", "candidate_index", (F.col("attempts") + F.when(k == 0, 1).otherwise(0)).alias("attempts"), (F.col("seconds") + F.when(k == 1, 0.5).otherwise(0)).alias("seconds"), (F.col("input_tokens") + F.when(k == 2, 1).otherwise(0)).alias("input_tokens"), "output_tokens")
    return quality.rollup_issue(stated, rolled, ["sample_key", "candidate_index"])


@query(f"WITH {V.ATTEMPTS}, n AS (SELECT sample_key, candidate_index, row_number() OVER (PARTITION BY sample_key, candidate_index ORDER BY attempt_id) AS i, attempt_id FROM attempts_v) SELECT DISTINCT sample_key, candidate_index FROM n WHERE i = 2 AND sample_key % 7 = 0")
def attempt_numbering(spark, sf_dir):
    own = Window.partitionBy("sample_key", "candidate_index").orderBy("attempt_id")
    a = V.attempts(spark, sf_dir).withColumn("attempt", F.row_number().over(own))
    shifted = a.withColumn("attempt", F.when((F.col("sample_key") % 7 == 0) & (F.col("attempt") == 2), 1).otherwise(F.col("attempt")))
    return quality.numbering_issues(shifted, ["sample_key", "candidate_index"])


@query("""WITH e AS (SELECT doc_id AS sample_key FROM documents WHERE doc_id % 10 <> 7), r AS (SELECT doc_id AS sample_key, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 50 = 0),
h AS (SELECT sample_key, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS bad FROM r GROUP BY 1), b AS (SELECT e.sample_key AS ek, h.* FROM e FULL JOIN h ON e.sample_key = h.sample_key)
SELECT count(ek) AS expected, CAST(sum(n) AS BIGINT) AS observed, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE ek IS NULL) AS unexpected, count(*) FILTER (WHERE n > 1) AS duplicates, CAST(sum(bad) AS BIGINT) AS row_issues, false AS eligible FROM b""")
def run_audit(spark, sf_dir):
    expected = table(spark, sf_dir, "documents").where("doc_id % 10 <> 7").select(F.col("doc_id").alias("sample_key"))
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_key"), F.when(F.col("quality") == 0, "quality").alias("issue"))
    return quality.run_audit(expected, l.unionByName(l.where("sample_key % 50 = 0")))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'semantic_points must contain exactly two strings' WHEN doc_id % 6 = 1 THEN 'semantic_points contains an empty point' WHEN doc_id % 6 = 2 THEN 'semantic point does not follow `Expected answer:...`'
WHEN doc_id % 6 = 3 THEN 'per-row reference protocol is invalid' WHEN doc_id % 6 = 4 THEN 'reference_enters_reward must be false' END AS issue FROM documents""")
def reference_contract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    good = F.array(F.lit("Evidence context: x"), F.lit("Expected answer: y"))
    points = F.when(k == 0, F.array(F.lit("one"))).when(k == 1, F.array(F.lit("Evidence context: x"), F.lit("  "))).when(k == 2, F.array(F.lit("Evidence context: x"), F.lit("Answer: y"))).otherwise(good)
    flags = F.struct(F.when(k == 3, "other").otherwise("p1").alias("protocol"), F.lit(False).alias("reference_enters_generation"), (k == 4).alias("reference_enters_reward"), F.lit(False).alias("reference_enters_candidate_selection"))
    return d.select("doc_id", quality.reference_issue(points, flags, "p1").alias("issue"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'not_increasing' WHEN c_custkey % 7 = 0 THEN 'bin_range' END AS issue FROM customer")
def sampling_accounting(spark, sf_dir):
    c = sampling.per_total(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60 + 2).alias("t")), "t", "p")
    frames = F.transform("p", lambda x: x["frame"])
    frames = F.when(F.col("c_custkey") % 5 == 0, F.reverse(frames)).otherwise(frames)
    bins = F.transform("p", lambda x: x["bin"] + F.when(F.col("c_custkey") % 7 == 0, 8).otherwise(0))
    return c.select("c_custkey", sampling.accounting_issue(frames, bins).alias("issue"))
