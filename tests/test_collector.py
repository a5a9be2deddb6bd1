"""The live feed: protocol, rings, reconnects in every state, and a query that restarts without loss or repeats."""

import base64
import hashlib
import json
import os
import socket
import struct
import threading
import time
from dataclasses import replace

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from straitline import jobs
from straitline.config import ZONES
from straitline.sources.catalog import Catalog
from straitline.streaming import collector as C

KEY = "s3cr3t-of-the-test"


def position(mmsi, lat=26.4, kind="PositionReport"):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "latitude": lat, "longitude": 56.5, "time_utc": "2026-03-01 05:00:00.123456789 +0000 UTC"}, "Message": {kind: {"UserID": mmsi, "Latitude": lat, "Longitude": 56.5, "Sog": 1.5}}})


def static(mmsi):
    return json.dumps({"MessageType": "ShipStaticData", "MetaData": {"MMSI": mmsi, "time_utc": "2026-03-01 06:00:00 +0000 UTC"}, "Message": {"ShipStaticData": {"UserID": mmsi, "Name": "A ", "Type": 80}}})


class Server:
    """A websocket server whose n-th connection follows the n-th script; the last script serves all others.

    Steps of a script: ``refuse``, ``garbage`` (no handshake), ``hang`` (silent), ``close``, a text, or bytes of raw frames.
    """

    def __init__(self, *scripts):
        self.scripts, self.subscriptions, self.seen, self.alive = list(scripts), [], 0, True
        self.sock = socket.create_server(("127.0.0.1", 0))
        self.url = f"ws://127.0.0.1:{self.sock.getsockname()[1]}/feed"
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self):
        while self.alive:
            try:
                link, _ = self.sock.accept()
            except OSError:
                return
            script = self.scripts[min(self.seen, len(self.scripts) - 1)]
            self.seen += 1
            threading.Thread(target=self._talk, args=(link, script), daemon=True).start()

    def _talk(self, link, script):
        try:
            if script[0] == "refuse":
                return
            head = b""
            while b"\r\n\r\n" not in head:
                head += link.recv(4096)
            if script[0] == "garbage":
                link.sendall(b"HTTP/1.1 403 Forbidden\r\n\r\n")
                return
            nonce = next(x.split(": ")[1] for x in head.decode().split("\r\n") if x.startswith("Sec-WebSocket-Key"))
            accept = base64.b64encode(hashlib.sha1((nonce + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest()).decode()
            link.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
            self.subscriptions.append(json.loads(self.frame(link)))
            for step in script:
                if step == "close":
                    link.sendall(b"\x88\x00")
                    return
                if step == "hang":
                    while self.alive and link.fileno() >= 0:
                        time.sleep(0.05)
                    return
                link.sendall(step if isinstance(step, bytes) else self.text(step))
        except OSError:
            pass
        finally:
            link.close()

    @staticmethod
    def frame(link):
        def take(n):
            out = b""
            while len(out) < n:
                out += link.recv(n - len(out))
            return out

        _, size = take(2)
        assert size & 0x80  # clients mask
        size = size & 0x7F
        size = struct.unpack(">H", take(2))[0] if size == 126 else struct.unpack(">Q", take(8))[0] if size == 127 else size
        mask = take(4)
        return bytes(b ^ mask[i % 4] for i, b in enumerate(take(size)))

    @staticmethod
    def text(s, first=0x81):
        data = s.encode()
        n = len(data)
        return bytes([first]) + (bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 65536 else b"\x7f" + struct.pack(">Q", n)) + data

    def close(self):
        self.alive = False
        self.sock.close()


@pytest.fixture
def serve():
    made = []

    def start(*scripts):
        made.append(Server(*scripts))
        return made[-1]

    yield start
    for s in made:
        s.close()


def collector(tmp_path, url="ws://127.0.0.1:1/", **k):
    return C.Collector(C.SegmentLog(str(tmp_path / "log")), lambda: {"APIKey": KEY}, url, uniform=lambda a, b: a / 100, **k)


def lines(c):
    return [json.loads(x)["MetaData"]["MMSI"] for n in c.log.numbers() for x in c.log.read(n)]


def until(what, seconds=20):
    end = time.time() + seconds
    while not what():
        assert time.time() < end, "it didn't happen"
        time.sleep(0.02)


def test_protocol_frames(serve):
    long, huge = "x" * 300, "é" * 40_000
    parts = Server.text("spl", 0x01) + b"\x89\x02hi" + Server.text("it", 0x80)  # a ping between fragments
    server = serve([long, huge, parts, "end", "close"])
    ws = C.WebSocket(server.url, 3)
    ws.send(json.dumps({"a": "ü" * 200}))
    got = ws.messages()
    assert [next(got) for _ in range(4)] == [long, huge, "split", "end"] and server.subscriptions == [{"a": "ü" * 200}]
    with pytest.raises(ConnectionError, match="closed"):
        next(got)
    ws.close()


def test_a_silent_link_is_dead(serve):
    ws = C.WebSocket(serve(["hang"]).url, 3, ping=0.1)
    ws.send("{}")
    with pytest.raises(ConnectionError, match="ping"):
        next(ws.messages())


def test_routes_and_counters(tmp_path):
    c = collector(tmp_path)
    for text in (position(1), static(2), position(3, kind="StandardClassBPositionReport"), '{"MessageType": "Other"}', "not json", "[1]"):
        c.take(text)
    assert c.counts | {"flushes": 0} == {"received": 6, "positions": 2, "static": 1, "unparsed": 3, "reconnects": 0, "flushes": 0}
    with pytest.raises(C.FeedError, match="quota"):
        c.take('{"error": "quota"}')
    assert c.flush() == 0 and lines(c) == [1, 3, 2] and c.flush() == 0 and c.log.numbers() == [0]


def test_rings_drop_the_oldest_and_count_them(tmp_path):
    c = collector(tmp_path, buffer=3)
    for i in range(8):
        c.take(position(i))
    c.take(static(9))
    assert c.stats()["dropped"] == 5 and c.counts["positions"] == 8 and [len(r.items) for r in c.rings.values()] == [3, 1]
    c.flush()
    assert lines(c) == [5, 6, 7, 9]
    ring = C.Ring(C.BUFFER)
    for i in range(C.BUFFER + 1234):
        ring.append(i)
    assert (len(ring.items), ring.dropped, ring.items[0]) == (200_000, 1234, 1234)


def test_a_log_out_of_reach_keeps_the_rings(tmp_path, monkeypatch):
    c = collector(tmp_path)
    c.take(position(1))
    monkeypatch.setattr(c.log, "write", lambda *a: (_ for _ in ()).throw(OSError("away")))
    with pytest.raises(OSError, match="away"):
        c.flush()
    monkeypatch.undo()
    assert c.number == -1 and c.flush() == 0 and lines(c) == [1]


def test_reconnects_from_every_state(tmp_path, serve):
    server = serve(["refuse"], ["garbage"], [position(1), "close"], [position(2), '{"error": "no"}'], [position(3), "hang"])
    c = collector(tmp_path, server.url)
    c.start()
    until(lambda: c.counts["positions"] == 3)
    assert c.state == "reading" and c.counts["reconnects"] == 4 and lines(c) == [1, 2]  # flushed before each wait
    # half of min(2^n, 60) by the fixed draw; a taken subscription starts the row anew
    assert [round(w * 200) for w in c.waits] == [1, 2, 1, 1] and "no" in c.last_error
    c.stop()
    assert c.state == "stopped" and lines(c) == [1, 2, 3] and server.subscriptions == [{"APIKey": KEY}] * 3


def test_waits_are_capped(tmp_path):
    c = collector(tmp_path)
    c.run(max_reconnects=8)
    assert [round(w * 200) for w in c.waits] == [1, 2, 4, 8, 16, 32, 60, 60, 60] and c.state == "stopped"


def test_a_late_subscription_is_another_try(tmp_path, serve, monkeypatch):
    monkeypatch.setattr(C, "SUBSCRIBE_S", -1.0)
    c = collector(tmp_path, serve(["hang"]).url, connect=lambda url, _: C.WebSocket(url, 3))
    c.run(max_reconnects=0)
    assert "too late" in c.last_error and c.connected_since is None


@pytest.fixture
def key(tmp_path):
    (tmp_path / "key").write_text(KEY + "\n")
    return str(tmp_path / "key")


def test_query_restarts_without_loss_or_repeats(spark, tmp_path, serve, key):
    server = serve([*(position(i) for i in range(5)), static(50), "hang"], [*(position(i) for i in range(5, 9)), position(9, lat=0.0), "hang"])
    cat = Catalog(spark, str(tmp_path / "lake"))
    where = {"log": f"{tmp_path}/log", "checkpoint": f"{tmp_path}/ck", "every": "0 seconds", "url": server.url, "keyfile": key}

    def have():
        try:
            return cat.read_partitions("ais_positions").count()
        except (PySparkException, Py4JJavaError):  # no file yet, or one that is being replaced
            return 0

    q = C.collect(cat, **where)
    try:
        until(lambda: have() == 5, 60)
        plan = q._jsq.toString() + str(q.lastProgress) + spark.sparkContext._jvm.java.lang.String.valueOf(q.id)
        assert KEY not in plan
    finally:
        q.stop()
    # a batch that was planned but not committed: forget the last commit and let it run again
    commits = sorted((f for f in os.listdir(f"{tmp_path}/ck/commits") if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{tmp_path}/ck/commits/{f}")
    q = C.collect(cat, **where)
    try:
        until(lambda: have() == 10, 60)
    finally:
        q.stop()
    rows = cat.read_partitions("ais_positions").collect()
    assert sorted(r.mmsi for r in rows) == list(range(10)) and {r.mmsi for r in rows if r.zone_key is None} == {9}
    assert [r.mmsi for r in cat.read_partitions("ais_static").collect()] == [50] and "batch" not in rows[0].asDict()
    for sub in server.subscriptions:
        assert sub["APIKey"] == KEY and sub["BoundingBoxes"] == [z.feed_box for z in ZONES.values() if z.live] and "ShipStaticData" in sub["FilterMessageTypes"]
    stats = C.collector_stats(spark, f"{tmp_path}/log").collect()
    assert stats[-1].received == 5 and sum(s.static for s in stats) >= 1 and all(s.dropped == 0 for s in stats)
    for folder, _, names in os.walk(tmp_path):
        for n in names:
            if n != "key":
                with open(f"{folder}/{n}", "rb") as f:
                    assert KEY.encode() not in f.read()


def test_no_zone_or_key_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="live"):
        C.live_feed(spark, "x", {"h": replace(ZONES["hormuz"], live=False)})
    with pytest.raises(RuntimeError, match="NO_SUCH_KEY"):
        C.secret({"keyenv": "NO_SUCH_KEY"})


def test_verb(spark, tmp_path, serve, key, capsys):
    server = serve([position(1), static(2), "hang"])
    assert jobs.main(["--root", str(tmp_path / "data"), "collect-ais", "--url", server.url, "--every", "0 seconds", "--seconds", "12", "--key-file", key]) == 0
    assert "received" in capsys.readouterr().out
    assert Catalog(spark, str(tmp_path / "data")).read_partitions("ais_positions").first().mmsi == 1
