"""WARC archives: records written in segments with chunked transfer framing, and reassembled on reading.

Writing: a page is an HTTP response whose body is chunked. A block beyond SEGMENT_BYTES is cut: its first segment stays in the response
record, the others go into continuation records. Of equal payloads one is stored, the others are revisit records that refer to it.

Reading: an archive is split at the version line that begins each record, in parallel within files too. Continuation records are grouped
by origin identifier, ordered by segment number, put together, held against the stated total length, and the chunks are decoded.

Archives are written and read by Spark's own text source, byte for byte, so they lie in any store that Spark reaches, and a lost task
leaves no part of a file behind.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorepool.llm.common import materialise, scratch_table

VERSION = b"WARC/1.1\r\n"
_MARK = VERSION[:8]
#: A block beyond this goes into continuation records, so that no line of an archive is much longer.
SEGMENT_BYTES = 8 << 10
CHUNK_BYTES = 4 << 10
#: Smaller payloads are always stored.
REVISIT_BYTES = 1000
#: Payloads with more copies are decided by a broadcast; there are at most as many as this share of all rows allows.
HOT_SHARE = 1000
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- framing ------------------------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer coding. A chunk also ends within every `WARC/1.1` of the payload, so that no version line comes about in a record."""
    cuts, marks, at = [0], [], payload.find(_MARK)
    while at >= 0:
        marks.append(at + 5)
        at = payload.find(_MARK, at + 1)
    for mark in [*marks, len(payload)]:
        while mark - cuts[-1] > size:
            cuts.append(cuts[-1] + size)
        if mark > cuts[-1]:
            cuts.append(mark)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out += [b"%x\r\n" % (b - a), payload[a:b], b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        n = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(body[at : at + n])
        at += n + 2


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)


def _plain(text: str | None) -> str | None:
    """A header value: control characters and spaces are percent-encoded, and what would look like a version line."""
    return None if text is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text).replace("WARC/1.1", "WARC%2F1.1")


def sha1_base32(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(name: str, url: str | None, payload: bytes, refers: str | None, date: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> list[bytes]:
    """The records of one page, without their version line: a revisit, or a response and its continuations."""
    digest = sha1_base32(payload)
    common = [("WARC-Date", date), ("WARC-Payload-Digest", digest)]
    target = ("WARC-Target-URI", _plain(url))
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), target, *common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers}>"), kind, ("Content-Length", str(len(block)))]
        return [_head(fields) + b"\r\n" + block]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    out = []
    for k, part in enumerate(parts, 1):
        last = k == len(parts)
        number = [("WARC-Segment-Number", str(k))] if len(parts) > 1 else []
        if k > 1:
            number += [("WARC-Segment-Origin-ID", f"<{name}>")] + ([("WARC-Segment-Total-Length", str(len(block)))] if last else [])
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", f"<{name}>" if k == 1 else f"<{name}:{k}>"), target, *(common if k == 1 else common[:1]), *number]
        fields += [kind] if k == 1 else []
        out.append(_head([*fields, ("Content-Length", str(len(part)))]) + b"\r\n" + part)
    return out


def fields_of(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case; continued lines joined) and what follows them, of a record without its version line."""
    head, found, rest = record.partition(_END)
    if not found:
        raise ValueError("a record has no end of header")
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields, rest


# --- writing ------------------------------------------------------------------------------------------------------


def _identified(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, payload, size, sha256); row numbers rows by their place in the input."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    return rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha256", F.sha2("payload", 256))


def _name(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), row.cast("string"))


def decided(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(name, url, payload, refers): which record each page becomes; refers names the record that a revisit refers to, else null.

    Payloads that occur more than once are found by partial aggregation of their digests. Those with very many copies are few and
    broadcast; pages of the others join by digest. Pages that are decided already are dealt evenly.
    """
    rows = _identified(pages)
    keys = materialise(rows.select("row", "page_id", "size", "sha256"), "warc-keys")
    groups = keys.where(F.col("size") >= least).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "row")).alias("kept")).where("n > 1")
    groups = materialise(groups.select("sha256", "n", F.col("kept.row").alias("kept"), _name(F.col("kept.page_id"), F.col("kept.row")).alias("target")), "warc-groups")
    hot = max(HOT_SHARE, keys.count() // HOT_SHARE)
    many = groups.where(F.col("n") > hot).select("sha256", F.col("kept").alias("hot_kept"), F.col("target").alias("hot_target"))  # at most HOT_SHARE rows
    few = groups.where(F.col("n") <= hot).select(F.col("sha256").alias("key"), "kept", "target")
    rows = rows.join(F.broadcast(many), "sha256", "left")
    open_key = (F.col("size") >= least) & F.col("hot_kept").isNull()
    rows = rows.withColumn("key", F.when(open_key, F.col("sha256")).otherwise(F.concat(F.lit("row"), F.col("row").cast("string")))).join(few, "key", "left")
    kept, target = F.coalesce("hot_kept", "kept"), F.coalesce("hot_target", "target")
    return rows.select(_name(F.col("page_id"), F.col("row")).alias("name"), "url", "payload", F.when(kept != F.col("row"), target).alias("refers"))


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the records of pages (page_id, url, html) to archives under path, each row's records in one file.

    Of rows with equal payloads of at least `least` bytes, that with the largest page_id (of several such the last in the input) is a
    response, the others are revisits. A null html is an empty payload. pages must give the same rows when read again.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out: list[bytes] = []
                for row in batch.slice(k, 64).to_pylist():
                    out += records(row["name"], row["url"], row["payload"], row["refers"], date, segment, chunk)
                yield pa.RecordBatch.from_arrays([pa.array([VERSION + r for r in out], pa.binary())], names=["value"])

    rows = decided(pages, least).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", _END.decode()).text(path)


# --- reading ------------------------------------------------------------------------------------------------------

_RECORD = "id string, origin string, number long, total long, kind string, target_uri string, digest string, refers string, block binary"


def parsed(record: bytes) -> tuple | None:
    """A record's columns, or None where its bytes end before its length says: then a version line within the block was taken for the
    start of a record."""
    fields, rest = fields_of(record)
    n = int(fields["content-length"])
    if len(rest) < n:
        return None
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    number = int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None
    total = int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None
    return bare("warc-record-id"), bare("warc-segment-origin-id"), number, total, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), bare("warc-refers-to"), rest[:n]


def _sequential(data: bytes):
    """Records of a whole file, each found by the length of the one before."""
    at = data.find(VERSION[:5])
    while 0 <= at < len(data):
        line = data.index(b"\r\n", at) + 2
        head = data.index(_END, line) + 4
        fields, _ = fields_of(data[line:head])
        end = head + int(fields["content-length"])
        yield data[line:end]
        at = data.find(VERSION[:5], end)


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    spec = [c.split() for c in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(spec)], names=[c for c, _ in spec])


def read_records(spark: SparkSession, path: str, own: bool = False) -> DataFrame:
    """Every record under path, as (id, origin, number, total, kind, target_uri, digest, refers, block). Files are read in parts, at
    the version line. A file in which that also occurs within a block is read as a whole instead, record by record; own=True says
    that write_archives() wrote the files, in which it never does, and saves the pass that looks for such files."""
    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select("value", F.col("_metadata.file_path").alias("file")).where("value <> ''")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = [parsed(v) for v in batch.column("value").slice(k, 256).to_pylist()]
                if None in rows:
                    raise ValueError("a record is shorter than it says")
                yield _batches(rows)

    def whole(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for record in _sequential(batch.column("content")[k].as_py()):
                    yield _batches([parsed(record)])

    cut: list[str] = []
    if not own:
        head = F.substring_index("value", _END.decode(), 1)
        length = F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length:\s*([0-9]+)", 1).try_cast("long")
        short = F.octet_length("value") < F.octet_length(head) + len(_END) + length
        cut = [r["file"] for r in lines.where(F.coalesce(short, F.lit(True))).select("file").distinct().collect()]  # names, and only of such files
    good = lines.where(~F.col("file").isin(cut)) if cut else lines
    out = good.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, _RECORD)
    return out.unionByName(spark.read.format("binaryFile").load(cut).select("content").mapInArrow(whole, _RECORD)) if cut else out


_SPAN = "id string, kind string, target_uri string, refers string, payload_bytes long, payload_digest string, payload binary"


def reassembled(found: DataFrame, payloads: bool = True) -> DataFrame:
    """(id, kind, target_uri, refers, payload_bytes, payload_digest, payload): one row for each response and revisit.

    Segments meet by the identifier of the record that they continue, whichever files hold them; the others take no shuffle but as a row
    of their own. A missing or repeated segment, a total length that differs, broken framing or a digest that the payload doesn't have
    ends the job. With payloads=False the bytes are dropped once they are counted and hashed. A revisit's size and digest are those it states.
    """
    part = F.struct(F.col("number"), F.col("total"), F.col("block"))
    grouped = (
        found.where("number is not null")
        .groupBy(F.coalesce("origin", "id").alias("id"))
        .agg(F.array_sort(F.collect_list(part)).alias("parts"), *[F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c) for c in ("kind", "target_uri", "digest", "refers")])
    )
    whole = found.where("number is null").select("id", F.array(F.struct(F.lit(1).cast("long").alias("number"), F.octet_length("block").cast("long").alias("total"), F.col("block").alias("block"))).alias("parts"), "kind", "target_uri", "digest", "refers")

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                block = joined(r["id"], r["kind"], [(p["number"], p["total"], p["block"]) for p in r["parts"]])
                rows.append(decoded(r["id"], r["kind"], r["target_uri"], r["digest"], r["refers"], block, payloads))
                if sum(len(x[6] or b"") for x in rows) > 1 << 20:
                    yield _spans(rows)
                    rows = []
            if rows:
                yield _spans(rows)

    return grouped.select(whole.columns).unionByName(whole).mapInArrow(run, _SPAN)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    spec = [c.split() for c in _SPAN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(spec)], names=[c for c, _ in spec])


def joined(name: str, kind: str | None, parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its segments, in order, complete, and as long as the last one says."""
    if kind is None or [n for n, _, _ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments of {name} are missing or repeated")
    block = b"".join(b for _, _, b in parts)
    if parts[-1][1] != len(block):
        raise ValueError(f"segments of {name} have {len(block)} bytes, not {parts[-1][1]}")
    return block


def decoded(name: str, kind: str, uri: str | None, digest: str | None, refers: str | None, block: bytes, payloads: bool) -> tuple:
    """A row of _SPAN from a whole block: an HTTP header, and a body that is chunked or has a stated length."""
    head, _, body = block.partition(_END)
    http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    hex_digest = base64.b32decode(digest[5:]).hex() if digest and digest.lower().startswith("sha1:") and len(digest) == 37 else None
    if kind == "revisit":
        return name, kind, uri, refers, int(http["content-length"]) if "content-length" in http else None, hex_digest, None
    payload = dechunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body
    real = hashlib.sha1(payload).hexdigest()
    if hex_digest is not None and real != hex_digest:
        raise ValueError(f"the payload of {name} doesn't have its digest")
    return name, kind, uri, refers, len(payload), real, payload if payloads else None


def dangling(rows: DataFrame) -> DataFrame:
    """(refers, payload_digest, payload_bytes, n) of revisits whose response is absent or another payload's. Links are counted before they
    meet the responses, so the copies of one payload are a single row."""
    links = rows.where("kind = 'revisit'").groupBy("refers", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"))
    held = rows.where("kind = 'response'").select(F.col("id").alias("refers"), "payload_digest", "payload_bytes")
    return links.join(held, ["refers", "payload_digest", "payload_bytes"], "left_anti")


def _page(name: Column) -> Column:
    part = F.split(name, ":")[2]
    return F.when(part != "-", part.cast("long"))


def round_trip(pages: DataFrame, least: int = REVISIT_BYTES, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row of pages, from archives written and read back.

    A null html counts as empty; very long pages are cut into segments; repeated rows have a record each, equal payloads with equal
    page_ids included; null ids are written as `-` and read as null; an empty table gives no rows; other columns, whatever their
    names, are ignored.
    """
    spark = pages.sparkSession
    path = scratch_table(spark, "warc")
    write_archives(pages, path, least, segment, chunk)
    rows = reassembled(read_records(spark, path, own=True), payloads=False)
    return rows.select(_page(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), _page(F.col("refers")).alias("refers_to"))
