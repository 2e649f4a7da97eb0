"""Importance resampling, Merkle manifests and WARC archives against plain versions."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scorepool.llm import importance, manifest, warc


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- importance resampling ----------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_resample(docs, target, orders, buckets, least, percent, seed):
    def grams(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    s, t = ([g for _, text in rows for g in grams(text)] for rows in (docs, target))
    gain = [math.floor(1000 * math.log((t.count(b) + 1) * (len(s) + buckets) / ((s.count(b) + 1) * (len(t) + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in docs:
        g = grams(text)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(sha(f"{seed}:{'' if doc is None else doc}")[:8], 16)
        out.append([doc, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(able) // 100
    ranks = sorted((r[3], r[0], i + 1) for i, r in enumerate(able[:drawn]))
    return sorted([tuple(r[:4]) for r in out], key=str), ranks


TARGET = [(1, "alpha1 beta7 alpha2, the end"), (2, None), (2, "word1 sch1é word2"), (None, "again again")]


@pytest.mark.parametrize("orders, percent", [(1, 10), (1, 100), (3, 40)])
def test_resample_equals_plain_version(spark, docs, rows, orders, percent):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = importance.resample(docs, target, orders=orders, buckets=97, least_words=3, percent=percent).collect()
    want, ranks = plain_resample(rows, TARGET, orders, 97, 3, percent, "2024")
    assert sorted([tuple(r)[:4] for r in got], key=str) == want
    assert sorted((r["score"], r["doc_id"], r["rank"]) for r in got if r["rank"]) == ranks


def test_resample_merges_copies_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(importance, "STRETCH", 4)
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text)] * 11 + [(None, "")] * 9 + [(8, text + " more")], "doc_id long, text string")
    got = importance.resample(docs, docs.where("false").select(F.col("doc_id").alias("item_id"), "text"), percent=50).collect()
    assert len(got) == 21 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6]


def test_resample_of_empty_tables(spark, empty):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(empty, target).count() == 0


def test_plain_texts(spark):
    texts = ["", None, "  Ab,c É. ", "a", ",", "a b", "x\x00y  é1", " ", "日本 語", "A-B", "-", "KK", "9_9"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r["key"]: r["text"] for r in importance.plain_texts(frame, "doc_id").collect()} == {i: " ".join(plain_words(t)) for i, t in enumerate(texts)}


# --- manifest -----------------------------------------------------------------------------------------------------


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes):
    """Root and the siblings of each node, by slots: [(left, right), ...]."""
    around = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, below = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for leaf in under[a + k]:
                    around[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha("".join(run)))
            below.append([leaf for u in under[a : a + 8] for leaf in u])
        nodes, under = parents, below
    return nodes[0], around


def plain_manifest(rows):
    leaf = lambda r, text: sha("".join(map(plain_field, (r[0], r[1], r[2], r[3], text))))
    trees = {}
    for r in rows:
        tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[4] is not None
        trees.setdefault(r[2], []).append((r[0], leaf(r, r[4]), leaf(r, lowered(r[4]) if tampered else r[4])))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    each = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        each[name] = plain_tree([r[1] for r in trees[name]])
    root, top = plain_tree([each[name][0] for name in names])
    out = []
    for name, over in zip(names, top, strict=True):
        for (doc, original, now), around in zip(trees[name], each[name][1], strict=True):
            h = now
            for left, right in around + over:
                h = sha(left + h + right)
            out.append((doc, original, each[name][0], root, sha("".join(a + b for a, b in around + over)), h, h == root))
    return sorted(out, key=str)


KIND = "doc_id long, source string, lang string, n_chars long, text string"


def many(n, langs):
    return [(i * 7 % n, None if i % 5 == 0 else f"s{i % 3}", langs[i % len(langs)], None if i % 11 == 0 else i, [f"Text {i}", "", None, "É A", "same"][i % 5]) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "s", None, 3, "Abc")],
        [(3, None, "en", None, None), (None, "", "", 0, "")],
        [(None, None, None, None, None)] * 20 + many(30, [f"l{k}" for k in range(11)]),
        many(150, ["en", "en", "de", None, "", "é"]) + [(5, "x", "en", 1, "twice")] * 9,
        many(64, ["en"]) + many(65, ["fr"]) + many(1, ["xx"]) + [(9, "long", "xx", 1, "A" * 300_000)],
    ],
)
def test_manifest_equals_plain_version(spark, rows):
    frame = spark.createDataFrame(rows, KIND)
    clashing = [F.lit(1).alias(c) for c in ("idx", "n", "tree", "leaf", "steps", "root")]
    assert sorted(map(tuple, manifest.verified(frame.select("*", *clashing)).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_an_empty_table(spark):
    frame = manifest.verified(spark.createDataFrame([], KIND))
    assert frame.count() == 0 and frame.columns == [c.split()[0] for c in manifest.SCHEMA.split(", ")]


def test_root_follows_every_value_and_no_partitioning(spark):
    rows = many(40, ["en", None])
    frame = spark.createDataFrame(rows, KIND)
    root = manifest.build(frame).root
    assert root == manifest.build(frame.repartition(7)).root
    for column, value in enumerate([1000, "other", "other", 77, "other"]):
        changed = [*rows[:-1], tuple(value if k == column else x for k, x in enumerate(rows[-1]))]
        assert manifest.build(spark.createDataFrame(changed, KIND)).root != root


# --- WARC ---------------------------------------------------------------------------------------------------------

BIG = "".join(f"<p>paragraph {i} é</p>\r\n\r\n" for i in range(3000))
MARKS = "x" * 90 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1" * 30 + "WARC/1.1"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (9, "http://a/9", BIG), (3, "u\r\nWARC-Type: x y\x00", "small"), (4, "u", "small"), (5, "http://x/WARC/1.1", MARKS), (6, "u", None),
    (7, "", ""), (None, "u", "y" * 1000), (None, "u", "y" * 1000), (8, "ü", "z" * 999), (10, "ü", "z" * 999), (11, "e", "é" * 500), (12, "e", "é" * 500), (-3, "e", "é" * 500),
]


def plain_round_trip(pages):
    out, kept = [], {}
    for page, _, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            kept.setdefault(raw, []).append(page)
    left = {raw: max(pages_, key=lambda p: (p is not None, p or 0)) for raw, pages_ in kept.items()}
    stored = set()
    for page, _, html in pages:
        raw = (html or "").encode()
        again = raw in left and not (left[raw] == page and raw not in stored)
        if raw in left and not again:
            stored.add(raw)
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", left[raw] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment, chunk, hot", [(8192, 4096, 1000), (300, 64, 1), (1, 7, 1000)])
def test_archives_round_trip(spark, segment, chunk, hot, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", hot)
    pages = PAGES if segment > 1 else [(p, u, (h or "")[:1100]) for p, u, h in PAGES]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").select("*", F.lit(1).alias("row"), F.lit(2).alias("size"), F.lit("x").alias("key"))
    got = warc.round_trip(frame, segment=segment, chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=str) == plain_round_trip(pages)


def test_payloads_come_back_from_split_files(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, f"{tmp_path}/a", segment=500, chunk=100)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("part-*")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert raw.count(b"WARC/1.1\r\n") == raw.count(b"\r\nWARC-Record-ID: ") == len(list(warc._sequential(raw)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = warc.reassembled(warc.read_records(spark, f"{tmp_path}/a")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == len(PAGES)
    payloads = {(h or "").encode() for _, _, h in PAGES}
    assert {bytes(r["payload"]) for r in rows if r["kind"] == "response"} == payloads
    assert warc.dangling(warc.reassembled(warc.read_records(spark, f"{tmp_path}/a"))).count() == 0


def foreign(blocks):
    """An archive of another writer: plain bodies, in which version lines may occur."""
    out = b""
    for k, body in enumerate(blocks):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" + body
        out += b"WARC/1.1\r\nContent-Length: %d\r\nWARC-Type: response\r\nX-Long: a\r\n b\r\nWARC-Record-ID: <urn:x:%d>\r\n\r\n" % (len(block), k) + block + b"\r\n\r\n"
    return out


def test_version_lines_within_blocks(spark, tmp_path):
    blocks = [b"one", MARKS.encode(), b"\xff\x00\r\n\r\n", b""]
    (tmp_path / "f.warc").write_bytes(foreign(blocks))
    (tmp_path / "g.warc").write_bytes(foreign([b"plain"]))
    rows = warc.reassembled(warc.read_records(spark, str(tmp_path))).collect()
    assert sorted(bytes(r["payload"]) for r in rows) == sorted([*blocks, b"plain"])


@pytest.mark.parametrize("damage", ["lost", "repeated", "length", "digest"])
def test_damage_is_an_error(spark, tmp_path, damage):
    parts = [warc.VERSION + r + b"\r\n\r\n" for r in warc.records("urn:page:1:0", "u", b"payload " * 100, None, "2024-01-01T00:00:00Z", 200, 50)]
    if damage == "lost":
        del parts[1]
    elif damage == "repeated":
        parts.append(parts[1])
    elif damage == "length":
        parts[-1] = re.sub(rb"Total-Length: \d+", b"Total-Length: 7", parts[-1])
    else:
        parts = [re.sub(rb"sha1:\w", b"sha1:7", p) if b"sha1:7" not in p else re.sub(rb"sha1:\w", b"sha1:A", p) for p in parts]
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    with pytest.raises(Exception, match="segments of|digest"):
        warc.reassembled(warc.read_records(spark, str(tmp_path))).collect()


def test_dangling_revisits(spark, tmp_path):
    parts = [warc.records("urn:page:1:0", "u", b"a" * 1000, refers, "2024-01-01T00:00:00Z")[0] for refers in ("urn:page:2:1", "urn:page:2:1", "urn:page:3:2")]
    parts += warc.records("urn:page:3:2", "u", b"a" * 1000, None, "2024-01-01T00:00:00Z")
    (tmp_path / "x.warc").write_bytes(b"".join(warc.VERSION + p + b"\r\n\r\n" for p in parts))
    rows = warc.reassembled(warc.read_records(spark, str(tmp_path)))
    assert [(r["refers"], r["n"]) for r in warc.dangling(rows).collect()] == [("urn:page:2:1", 2)]


def test_chunks():
    for size in (1, 3, 4096):
        for payload in (b"", b"a", MARKS.encode(), b"WARC/1.1"):
            body = warc.chunked(payload, size)
            assert warc.dechunked(body) == payload and b"WARC/1.1" not in body
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"x\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
