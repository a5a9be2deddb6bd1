"""WARC archives: exact round trips, what the files hold by themselves, and captures from records of any direction."""

import base64
import gzip
import hashlib
import io
import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from straitline.llm import warc as W

PAGES = "page_id long, url string, html string, digest string, row int, length int, payload string, first int, heads int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, 2, "p", 3, 4) for i, u, h in rows], PAGES)


AWKWARD = [
    (7, "https://a.example/x?y=1", "<p>same</p>"), (3, "http://b.example", "<p>same</p>"), (9, "HTTP://c.example/\r\nInjected: 1", "<p>same</p>"),
    (1, None, "head\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (2, "http://d.example/ü", "Straße 東京 \u0000 end"), (4, "", ""), (5, "http://e.example/", None),
    (6, "http://f.example/a", "twice"), (6, "http://f.example/b", "twice"), (None, "http://g.example/", "<p>same</p>"), (None, "http://h.example/", "alone"), (8, "http://i.example/", "x" * 3_000_000), (10, "http://j.example/", " \r\n"),
]


def expected(rows):
    out, order = [], sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first = {}
    for i in order:
        body = (rows[i][2] or "").encode()
        at = first.setdefault(body, i)
        out.append((rows[i][0], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if at == i else "revisit", None if at == i else rows[at][0]))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark, tmp_path):
    pages_of(spark, AWKWARD).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    one, two = (W.op11(spark, str(tmp_path)) for _ in range(2))
    assert one.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    got = sorted((tuple(r) for r in one.collect()), key=str)
    assert got == expected(AWKWARD) == sorted((tuple(r) for r in two.collect()), key=str)


def test_frequent_payloads_and_ties(spark, tmp_path):
    rows = [(i, f"http://x.example/{i}", "hot" if i % 3 else f"cold {i % 40}") for i in range(5, 3005)]
    pages_of(spark, rows).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(r) for r in W.op11(spark, str(tmp_path)).collect()), key=str) == expected(rows)


def test_least_bytes_keeps_small_payloads_as_responses(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    W.write_archives(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), path, least_bytes=3)
    assert Counter(r["type"] for r in W.read_archives(spark, path).collect()) == {"request": 4, "metadata": 4, "response": 3, "revisit": 1}


def parse(data: bytes):
    """An own reading of uncompressed records: (heads, block)."""
    while data:
        top, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = top.decode().split("\r\n")
        heads = dict(line.split(": ", 1) for line in lines)
        n = int(heads["Content-Length"])
        assert version == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        yield heads, rest[:n]
        data = rest[n + 4 :]


def test_files_are_archives_of_single_members(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    W.write_archives(pages_of(spark, AWKWARD), path)
    names = json.loads(Path(f"{tmp_path}/a/{W.MANIFEST}").read_text())
    data = b"".join(gzip.decompress(Path(f"{tmp_path}/a/{n}").read_bytes()) for n in names)
    records = list(parse(data))
    assert len(records) == 3 * len(AWKWARD) and len({h["WARC-Record-ID"] for h, _ in records}) == len(records)
    ids = {h["WARC-Record-ID"]: h for h, _ in records}
    for h, block in records:
        assert "Injected" not in h
        if h["WARC-Type"] in ("request", "metadata"):
            assert ids[h["WARC-Concurrent-To"]]["WARC-Type"] in ("response", "revisit")
        else:
            body = block.partition(b"\r\n\r\n")[2]
            assert h["WARC-Type"] == "revisit" or h["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert h["WARC-Type"] == "response" or (ids[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and not body)
    # any place that the reader states is the start of a member
    for r in W.read_archives(spark, path).collect():
        member = gzip.GzipFile(fileobj=io.BytesIO(Path(f"{tmp_path}/a/{r['archive']}").read_bytes()[r["offset"] :])).read(60)
        assert member.startswith(b"WARC/1.1\r\n")


def test_archives_roll_and_uncommitted_files_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    rows = pages_of(spark, [(i, "u", f"{i} " * 500) for i in range(60)])
    W.write_archives(rows, path, roll=4000)
    names = json.loads(Path(f"{tmp_path}/a/{W.MANIFEST}").read_text())
    assert len(names) > 4
    Path(f"{tmp_path}/a/stray.warc.gz").write_bytes(b"\x1f\x8bhalf a member")
    assert W.read_archives(spark, path).count() == 180


def test_broken_and_plain_archives(spark, tmp_path):
    heads = [[("WARC-Type", "resource"), ("WARC-Record-ID", "<a>"), ("Content-Type", "text/plain"), ("None", None)], [("WARC-Type", "metadata"), ("WARC-Record-ID", "<b>"), ("WARC-Concurrent-To", "<a>"), ("Content-Type", "application/warc-fields")]]
    made = [W.record([(k, F.lit(v).cast("string")) for k, v in h], F.lit(block)) for h, block in zip(heads, (b"one\r\n\r\ntwo", b"k: v\r\n"))]
    whole = b"".join(bytes(v) for v in spark.range(1).select(*[m.alias(f"r{i}") for i, m in enumerate(made)]).first())
    assert [b for _, b in parse(whole)] == [b"one\r\n\r\ntwo", b"k: v\r\n"] and b"None" not in whole
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(whole)
    got = {r["record_id"]: r for r in W.read_archives(spark, f"file://{tmp_path}/plain").collect()}
    assert got["<a>"]["payload"] == b"one\r\n\r\ntwo" and got["<b>"]["fields"] == {"k": "v"}
    for name, data in (("cut", gzip.compress(whole)[:-30]), ("short", gzip.compress(whole[:-20])), ("other", b"GET / HTTP/1.1\r\n\r\n")):
        (tmp_path / name).mkdir()
        (tmp_path / f"{name}/a.warc.gz").write_bytes(data)
        with pytest.raises(Exception, match="archive ends|no record"):
            W.read_archives(spark, f"file://{tmp_path}/{name}").count()


def rec(uid, kind, to=(), fields=None):
    return (uid, kind, "d", "u", list(to), None, None, None, None, None, 0, fields, "f", 0)


def test_captures_join_either_direction_and_through_one(spark):
    rows = [
        rec("r1", "response"), rec("q1", "request", ["r1"]), rec("m1", "metadata", ["q1"], {"k": "1"}),  # metadata names the request only
        rec("r2", "response", ["q2", "m2"]), rec("q2", "request"), rec("m2", "metadata", ["r2"], {"k": "2"}),  # named from both sides: once
        rec("r3", "resource"), rec("q9", "request", ["nowhere"]), rec("m9", "metadata"), rec(None, "metadata", [None]), rec("i", "warcinfo"),
        rec("m3", "metadata", ["r1", "r3"]),  # of two captures
    ]
    got = {r["capture_id"]: ([q["record_id"] for q in r["requests"]], [m["record_id"] for m in r["metadata"]], r["k"]) for r in W.captures(spark.createDataFrame(rows, W.RECORD)).withColumn("k", W.field_of("metadata", "k")).collect()}
    assert W.captures(spark.createDataFrame([], W.RECORD)).count() == 0
    assert got == {"r1": (["q1"], ["m1", "m3"], "1"), "r2": (["q2"], ["m2"], "2"), "r3": ([], ["m3"], None)}


def test_empty_table(spark, tmp_path):
    pages_of(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op11(spark, str(tmp_path)).count() == 0


def test_digest_expression(spark):
    for body in (b"", b"a", bytes(range(256))):
        got = spark.createDataFrame([(body,)], "p binary").select(W.sha1_base32(F.col("p"))).first()[0]
        assert got == base64.b32encode(hashlib.sha1(body).digest()).decode()
