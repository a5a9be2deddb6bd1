"""WARC archives: a Spark sink and source for ``warc`` files, and assembly of records into captures.

Writing: every page is one transaction of three records (request, response or revisit, metadata) tied by
``WARC-Concurrent-To``. A record is a gzip member of its own; archives end near ROLL bytes, so a file is a bounded piece of
work for the reader. Tasks write files of unique names and Spark's commit writes the manifest, so a lost executor or a
second attempt leaves files that no reader looks at. Files go through the file system of the path's scheme, never through
a machine's own folder.

Reading: one task an archive, one record in memory at a time. ``captures`` joins request and metadata records to their
response (or revisit) by concurrent-to identifiers, in either direction or through one record between, and nests them in
one row.

Equal payloads: a page whose payload another page has is a revisit of the one with the smallest key. The representative of
a payload comes from an aggregation with map-side combine. Payloads that more than one in HOT_SHARE pages have (there can't
be more than HOT_SHARE of them) reach their pages by a broadcast, all others by a shuffle, so no key is hot in it.

Defined results: a null html is an empty payload; a null url or key is left out of the record's headers; a null key sorts
last, so it refers to others before it is referred to; pages that repeat a key and payload are one response and revisits of
it, all with rows of their own; an empty table makes an empty archive; columns beside key, url and html aren't read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import discard, fresh_path, materialize

ROLL, HOT_SHARE, READ_BYTES, BATCH_BYTES, LEVEL = 64 << 20, 1000, 1 << 20, 8 << 20, 6
CRLF = b"\r\n"
MANIFEST = "_manifest"
#: Names of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, content_type string, http_status int, payload binary, payload_length long, fields map<string,string>, archive string, offset long"


def sha1_base32(payload: Column) -> Column:
    """Bare base32 of the SHA-1: five bytes are eight letters, and ``conv`` knows base 32 by other letters."""
    hexes = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# ---- records as bytes


def record(heads: list[tuple[str, Column]], block: Column) -> Column:
    """One record as binary: version, heads that have a value, block, two line ends. A line end inside a value would split
    the head, so it becomes a space."""
    lines = [F.concat(F.lit(f"{k}: "), F.regexp_replace(v, r"[\r\n]+", " ")) for k, v in heads]
    top = F.concat_ws("\r\n", F.lit(VERSION), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat(top, F.lit("\r\n\r\n")).cast("binary"), block, F.lit(b"\r\n\r\n"))


def http_request(uri: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\x00-\x20]", ""), r"^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(host) + 2)
    return F.concat(F.lit("GET /"), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")).cast("binary")


def http_response(payload: Column, length: Column) -> Column:
    """Status, heads and payload; a revisit (null payload) keeps the heads alone."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), F.coalesce(payload, F.lit(b"")))


# ---- files


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path's scheme; Hadoop's name of S3 is taken for S3."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path) if "://" in path else re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else f"file://{path}")


class Archive:
    """A file of gzip members that is written front to back."""

    def __init__(self, path: str):
        self.name, (self.at, top) = f"{uuid.uuid4().hex}.warc.gz", _place(path)
        self.at.create_dir(top, recursive=True)
        self.out, self.size = self.at.open_output_stream(f"{top}/{self.name}", compression=None), 0

    def append(self, data) -> None:
        member = zlib.compress(data, LEVEL, 31)
        self.out.write(member)
        self.size += len(member)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of one column, ``record``, as members; rows of one task keep their order."""

    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("roll", ROLL))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        names, archive = [], None
        for batch in batches:
            for one in batch.column("record"):
                if archive is None:
                    archive = Archive(self.path)
                    names.append(archive.name)
                archive.append(one.as_buffer())  # not copied
                if archive.size >= self.roll:
                    archive = archive.out.close()
        if archive is not None:
            archive.out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        at, top = _place(self.path)
        at.create_dir(top, recursive=True)
        with at.open_output_stream(f"{top}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        at, top = _place(self.path)
        for name in (n for m in messages if m for n in m.names):
            at.delete_file(f"{top}/{name}")


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Bytes:
    """Uncompressed bytes of a file of gzip members (or of plain records), with the member's place of each record."""

    def __init__(self, source):
        self.source, self.held, self.raw, self.fed, self.plain, self.start = source, bytearray(), b"", 0, None, 0
        self.inflate = None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                if self.inflate is not None:
                    raise ValueError(f"archive ends inside the member at {self.start}")
                return False
            if self.plain is None:
                self.plain = self.raw[:2] != b"\x1f\x8b"
        if self.plain:
            self.held += self.raw
            self.fed, self.raw = self.fed + len(self.raw), b""
            return True
        if self.inflate is None:
            self.inflate, self.start = zlib.decompressobj(31), self.fed
        before = len(self.raw)
        self.held += self.inflate.decompress(self.raw, READ_BYTES)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.fed += before - len(self.raw)
        if self.inflate.eof:
            self.inflate = None
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> bytes | None:
        """The next record's head up to its empty line; None at the end of the file."""
        seen = 0
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            end = self.held.find(CRLF * 2, max(seen - 3, 0))
            if end >= 0:
                return self.take(end + 4)
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a record's head")
                return None


def parse_heads(head: bytes) -> list[tuple[str, str]]:
    """(lower-case name, value) of the lines after the first; a line that begins with a blank continues its predecessor."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip().lower(), v.strip()))
    return out


def _row(head: bytes, block: bytes, archive: str, offset: int) -> tuple:
    pairs = parse_heads(head)
    h = dict(reversed(pairs))  # the first of repeated heads
    status, payload, length, fields = None, None, None, None
    kind = h.get("content-type", "")
    if kind.startswith("application/http"):
        top, gap, payload = block.partition(CRLF * 2)
        http = dict(reversed(parse_heads(top)))
        found = re.match(rb"HTTP/\S+ (\d{3})", top)
        status = int(found[1]) if found else None
        stated = http.get("content-length", "")
        length = int(stated) if h.get("warc-type") == "revisit" and stated.isdigit() else len(payload)
        payload = None if h.get("warc-type") in ("revisit", "request") else payload
    elif kind.startswith("application/warc-fields"):
        fields = dict(reversed(parse_heads(CRLF + block)))
    else:
        payload, length = block, len(block)
    digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    return h.get("warc-record-id"), h.get("warc-type"), h.get("warc-date"), h.get("warc-target-uri"), [v for k, v in pairs if k == "warc-concurrent-to"], h.get("warc-refers-to"), digest, h.get("content-type"), status, payload, length, fields, archive, offset


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        self.arrow = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("content_type", pa.string()), ("http_status", pa.int32()), ("payload", pa.binary()), ("payload_length", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("archive", pa.string()), ("offset", pa.int64())])

    def partitions(self) -> list[InputPartition]:
        """Committed archives; a folder without a manifest is taken as it is."""
        at, top = _place(self.path)
        if at.get_file_info(f"{top}/{MANIFEST}").type == fs.FileType.File:
            names = json.loads(at.open_input_stream(f"{top}/{MANIFEST}", compression=None).read())
        else:
            names = sorted(f.base_name for f in at.get_file_info(fs.FileSelector(top)) if f.base_name.endswith((".warc", ".warc.gz")))
        return [_File(n) for n in names] or [_File("")]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        at, top = _place(self.path)
        rows, size = [], 0
        with at.open_input_stream(f"{top}/{part.name}", compression=None) as source:
            data = _Bytes(source)
            while (head := data.head()) is not None:
                if not head.startswith(b"WARC/"):
                    raise ValueError(f"{part.name}: no record at {data.start}")
                offset = data.start
                length = int(dict(parse_heads(head)).get("content-length", 0))
                rows.append(_row(head, data.take(length), part.name, offset))
                size += len(head) + length
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(self.arrow.names, zip(*rows)))
        columns["fields"] = [list(f.items()) if f is not None else None for f in columns["fields"]]
        return pa.RecordBatch.from_arrays([pa.array(columns[n], self.arrow.field(n).type) for n in self.names], names=self.names)


class WarcSource(DataSource):
    """``format("warc")``: reads the records of a folder's archives; writes rows of ``record binary``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


# ---- pages to records


def _urn(*parts: Column) -> Column:
    """A stable record identifier from what makes a record one of its kind."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", *parts)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def with_representative(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``first``: the (key, row) of the payload's smallest key, null for payloads below ``least_bytes``.

    ``pages`` has page_id, row, digest, length. Frequent digests meet their pages by a broadcast of at most HOT_SHARE rows.
    """
    able = F.col("length") >= least_bytes
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    groups = materialize(pages.where(able).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "warc-payloads")
    share = pages.count() // HOT_SHARE
    hot = groups.where(F.col("_n") > share).select("digest", F.col("first").alias("_hot"))  # at most HOT_SHARE digests
    rest = groups.where(F.col("_n") <= share).select(F.col("digest").alias("_d"), F.col("first").alias("_rest"))
    known = pages.join(F.broadcast(hot), "digest", "left")
    plain = known.where(F.col("_hot").isNull() & able)
    settled = known.where(F.col("_hot").isNotNull() | ~able).withColumn("_rest", F.lit(None).cast(groups.schema["first"].dataType))
    joined = plain.join(rest, F.col("digest") == F.col("_d"), "left").drop("_d")
    return joined.unionByName(settled).withColumn("first", F.coalesce("_hot", "_rest")).drop("_hot", "_rest")


def numbered(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """page_id, url, payload, digest, length and a number for each row, written once so that numbers stay."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), "url", html.alias("payload"), F.monotonically_increasing_id().alias("row"))
    return materialize(rows.withColumns({"digest": sha1_base32(F.col("payload")), "length": F.octet_length("payload").cast("long")}), "warc-pages", "zstd")


def page_records(rows: DataFrame, run: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Three records a row of ``numbered``: request, response (or revisit of an equal payload), metadata with the key."""
    first = with_representative(rows.select("page_id", "row", "digest", "length"), least_bytes)
    again = first.where(F.col("first.row") != F.col("row")).select("row", F.col("first.row").alias("_first"))
    rows = rows.join(again, "row", "left")
    text = lambda c: F.col(c).cast("string")
    name = lambda kind, row: _urn(F.lit(run), F.lit(kind), text(row))
    revisit = F.col("_first").isNotNull()
    own = name("response", "row")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    heads = lambda kind, uid, mime, *more: [("WARC-Type", kind), ("WARC-Record-ID", uid), *common, ("Content-Type", F.lit(mime)), *more]
    same = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Refers-To", F.when(revisit, name("response", "_first"))), ("WARC-Profile", F.when(revisit, F.lit(SAME_PAYLOAD)))]
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), text("page_id"), F.lit("\r\n")), F.lit("")), F.lit("via: crawl\r\n")).cast("binary")
    three = [
        record(heads(F.lit("request"), name("request", "row"), "application/http; msgtype=request", ("WARC-Concurrent-To", own)), http_request(F.col("url"))),
        record(heads(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), own, "application/http; msgtype=response", *same), http_response(F.when(~revisit, F.col("payload")), F.col("length"))),
        record(heads(F.lit("metadata"), name("metadata", "row"), "application/warc-fields", ("WARC-Concurrent-To", own)), fields),
    ]
    return rows.select(F.explode(F.array(*three)).alias("record"))


def write_archives(pages: DataFrame, path: str, roll: int = ROLL, key: str = "page_id", **options) -> None:
    """Write each page's records to archives of about ``roll`` bytes; ``options`` are those of ``page_records``."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    rows = numbered(pages, key)
    page_records(rows, uuid.uuid4().hex, **options).write.format("warc").mode("append").option("path", path).option("roll", roll).save()
    discard(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).load()


# ---- records to captures


def _short(uid: Column) -> Column:
    """An identifier as a key of joins: the 16 bytes of a urn:uuid, any other one with a longer prefix; no two share one."""
    form = r"^<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})>$"
    return F.when(uid.rlike(form), F.unhex(F.regexp_replace(uid, form, "$1$2$3$4$5"))).otherwise(F.concat(F.lit("another identifier "), uid).cast("binary"))


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, type, target_uri, date, payload_digest, payload_length, refers_to, http_status,
    archive, offset, and arrays ``requests`` and ``metadata`` of (record_id, type, target_uri, fields).

    A capture is a response, revisit or resource record. Other records belong to it where one of the two names the other in
    WARC-Concurrent-To, or where they name a record that does. Those that name none are not part of a capture.
    """
    head = F.col("type").isin("response", "revisit", "resource")
    small = records.drop("payload", "content_type").withColumn("_k", _short(F.col("record_id")))
    to = F.explode(F.transform("concurrent_to", _short)).alias("_to")
    anchors = small.where(head).drop("fields").withColumnsRenamed({"record_id": "capture_id", "_k": "_a"})
    others = small.where(F.col("type").isin("request", "metadata")).select("_k", "record_id", "type", "target_uri", "fields", "concurrent_to")
    named = others.select("_k", to)
    direct = named.join(anchors.select(F.col("_a").alias("_to")), "_to").select("_k", F.col("_to").alias("_a"))
    back = anchors.select(to, "_a").withColumnRenamed("_to", "_k")
    near = direct.unionByName(back)
    through = named.join(near.withColumnRenamed("_k", "_to"), "_to").select("_k", "_a")
    links = near.unionByName(through).distinct()
    part = _plain(F.struct("record_id", "type", "target_uri", "fields"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, part)))
    nested = others.join(links, "_k").groupBy("_a").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    none = F.array().cast(nested.schema["requests"].dataType)
    out = anchors.drop("concurrent_to").join(nested, "_a", "left").drop("_a")
    return out.withColumns({c: F.coalesce(c, none) for c in ("requests", "metadata")})


def _plain(part: Column) -> Column:
    """The struct with its map as entries, which can be ordered."""
    return F.struct(part["record_id"].alias("record_id"), part["type"].alias("type"), part["target_uri"].alias("target_uri"), F.map_entries(part["fields"]).alias("fields"))


def field_of(parts: str, name: str) -> Column:
    """The first value of a warc-fields entry among the records of a nested array."""
    return F.get(F.filter(F.flatten(F.transform(parts, lambda p: F.coalesce(p["fields"], F.array().cast("array<struct<key:string,value:string>>")))), lambda e: e["key"] == name), 0)["value"]


def resolve_revisits(found: DataFrame, columns: list[str]) -> DataFrame:
    """``ref_<column>`` of the response that a revisit refers to; frequent ones by a broadcast of at most HOT_SHARE rows."""
    again = found.where(F.col("refers_to").isNotNull())
    share = again.count() // HOT_SHARE
    often = F.broadcast(again.groupBy("refers_to").count().where(F.col("count") > share).select(F.col("refers_to").alias("_id")))
    targets = found.select(F.col("capture_id").alias("_id"), F.struct(*columns).alias("_ref"))
    hot = F.broadcast(targets.join(often, "_id").select("_id", F.col("_ref").alias("_hot")))
    known = found.join(hot, F.col("refers_to") == F.col("_id"), "left").drop("_id")
    open_ = F.col("refers_to").isNotNull() & F.col("_hot").isNull()
    joined = known.where(open_).join(targets, F.col("refers_to") == F.col("_id"), "left").drop("_id")
    settled = known.where(~open_).withColumn("_ref", F.lit(None).cast(targets.schema["_ref"].dataType))
    ref = F.coalesce("_hot", "_ref")
    return joined.unionByName(settled).withColumns({f"ref_{c}": ref[c] for c in columns}).drop("_hot", "_ref")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_archives(spark, path)
    # what the payloads themselves say, not what their records claim
    read = records.withColumn("payload_digest", F.when(F.col("type") == "response", sha1_base32(F.col("payload"))).otherwise(F.col("payload_digest")))
    found = materialize(captures(materialize(read.drop("payload"), "warc-records")).withColumn("page_id", field_of("metadata", "page-id").cast("long")), "warc-captures")
    out = resolve_revisits(found, ["page_id", "payload_digest", "payload_length"])
    return out.select("page_id", F.coalesce("ref_payload_length", "payload_length").alias("payload_bytes"), F.coalesce("ref_payload_digest", "payload_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("ref_page_id").alias("refers_to"))


#: base32 is spelled out: five hex digits are four letters.
ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS k, first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS first FROM pages),
h AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(payload), (5 * i + 1)::INT, 5))::INT) AS fives FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> j) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM h
"""
