"""The live feed as a streaming source: a socket reader beside the query, bounded rings, a log of segments as offsets.

A socket can't be read twice, so what arrives is put into a log before Spark hears of it: each trigger asks for the latest
offset, which moves the rings' messages into a new segment file and answers its number. Batches are ranges of segments, read
by executors from the log, so a query that starts again from its checkpoint reads the very same rows. Segments leave the log
when Spark has committed them. Messages still in the rings are lost only if the process dies; a stop writes them first.

Between two triggers at most ``buffer`` messages of each kind are held; beyond, the oldest go and are counted. Counters
stand in ``<log>/stats``, one file a segment (``collector_stats``). The key comes from an environment variable or a file
that the options name: it is never an option itself, so neither plans nor logs hold it.
"""

from __future__ import annotations

import base64
import contextlib
import datetime as dt
import hashlib
import json
import os
import random
import re
import socket
import ssl
import threading
import time
import urllib.parse
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from straitline.config import ZONES, Zone
from straitline.sources.catalog import Catalog
from straitline.streaming import feed

#: The feed's address, its deadline for a subscription, the rings' bound, the longest wait, the ping interval.
FEED_URL, SUBSCRIBE_S, BUFFER, MAX_WAIT_S, PING_S = "wss://stream.aisstream.io/v0/stream", 3.0, 200_000, 60.0, 20.0
#: Fixed value of the websocket protocol.
_HANDSHAKE = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
_TEXT, _CLOSE, _PING, _PONG = 1, 8, 9, 10


class FeedError(RuntimeError):
    """The service answered with an error envelope."""


class WebSocket:
    """A text client of the websocket protocol: handshake, masked frames, pings, fragments."""

    def __init__(self, url: str, timeout: float, ping: float = PING_S):
        at = urllib.parse.urlsplit(url)
        secure = at.scheme == "wss"
        self.sock = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), timeout)
        self.held, self.ping = b"", ping
        try:
            if secure:
                self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=at.hostname)
            nonce = base64.b64encode(os.urandom(16)).decode()
            path = (at.path or "/") + (f"?{at.query}" if at.query else "")
            self.sock.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {nonce}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
            while b"\r\n\r\n" not in self.held:
                self._more()
            head, _, self.held = self.held.partition(b"\r\n\r\n")
            wanted = base64.b64encode(hashlib.sha1((nonce + _HANDSHAKE).encode()).digest()).decode()
            if not re.match(rb"HTTP/1\.1 101 ", head) or f"sec-websocket-accept: {wanted}".lower() not in head.decode("latin-1").lower():
                raise ConnectionError(f"no websocket: {head[:40]!r}")
        except BaseException:
            self.sock.close()
            raise

    def _more(self) -> None:
        got = self.sock.recv(1 << 16)
        if not got:
            raise ConnectionError("the feed closed the connection")
        self.held += got

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            self._more()
        out, self.held = self.held[:n], self.held[n:]
        return out

    def _send(self, kind: int, data: bytes) -> None:
        size = len(data)
        length = bytes([0x80 | size]) if size < 126 else b"\xfe" + size.to_bytes(2, "big") if size < 1 << 16 else b"\xff" + size.to_bytes(8, "big")
        mask = os.urandom(4)
        pad = int.from_bytes((mask * (size // 4 + 1))[:size], "big")
        self.sock.sendall(bytes([0x80 | kind]) + length + mask + (int.from_bytes(data, "big") ^ pad).to_bytes(size, "big"))

    def send(self, text: str) -> None:
        self._send(_TEXT, text.encode())

    def messages(self) -> Iterator[str]:
        """Text messages until the other side closes. A link that is silent for two ping intervals is dead."""
        self.sock.settimeout(self.ping)
        parts, asked = [], False
        while True:
            try:
                while len(self.held) < 2:
                    self._more()
            except TimeoutError:
                if asked:
                    raise ConnectionError("the feed doesn't answer pings") from None
                self._send(_PING, b"")
                asked = True
                continue
            asked = False
            first, second = self._take(2)
            size = second & 0x7F
            size = int.from_bytes(self._take({126: 2, 127: 8}[size]), "big") if size > 125 else size
            data = self._take(size)
            kind = first & 0x0F
            if kind == _CLOSE:
                raise ConnectionError("the feed closed the connection")
            if kind == _PING:
                self._send(_PONG, data)
            elif kind != _PONG:
                parts.append(data)
                if first & 0x80:
                    yield b"".join(parts).decode("utf-8", "replace")
                    parts = []

    def close(self) -> None:
        with contextlib.suppress(OSError):
            self.sock.shutdown(socket.SHUT_RDWR)
        self.sock.close()


class Ring:
    """The newest ``limit`` items; older ones are dropped and counted."""

    def __init__(self, limit: int):
        self.items: deque[str] = deque()
        self.limit, self.dropped = limit, 0

    def append(self, item: str) -> None:
        self.items.append(item)
        if len(self.items) > self.limit:
            self.items.popleft()
            self.dropped += 1

    def drain(self) -> list[str]:
        out = list(self.items)
        self.items.clear()
        return out


class SegmentLog:
    """Numbered files of messages, a line each, below a folder that executors see."""

    def __init__(self, path: str):
        self.at, self.top = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else fs.FileSystem.from_uri(f"file://{os.path.abspath(path)}")
        for sub in ("segments", "stats"):
            self.at.create_dir(f"{self.top}/{sub}", recursive=True)

    def identity(self) -> str:
        """A name that stays with the log."""
        name = f"{self.top}/identity"
        if self.at.get_file_info(name).type != fs.FileType.File:
            self._put(name, uuid.uuid4().hex[:12].encode())
        with self.at.open_input_stream(name) as f:
            return f.read().decode()

    def _put(self, name: str, data: bytes) -> None:
        """All or nothing: readers see whole files only."""
        with self.at.open_output_stream(f"{name}.part") as f:
            f.write(data)
        self.at.move(f"{name}.part", name)

    def numbers(self) -> list[int]:
        found = (re.fullmatch(r"segment-(\d+)\.jsonl", f.base_name) for f in self.at.get_file_info(fs.FileSelector(f"{self.top}/segments")))
        return sorted(int(m[1]) for m in found if m)

    def write(self, number: int, lines: list[str]) -> None:
        self._put(f"{self.top}/segments/segment-{number}.jsonl", "".join(f"{x}\n" for x in lines).encode())

    def write_stats(self, number: int, stats: dict) -> None:
        self._put(f"{self.top}/stats/stats-{number}.json", json.dumps(stats).encode())

    def read(self, number: int) -> Iterator[str]:
        with self.at.open_input_stream(f"{self.top}/segments/segment-{number}.jsonl") as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (x.decode() for x in lines)

    def drop_below(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                self.at.delete_file(f"{self.top}/segments/segment-{n}.jsonl")


class Collector:
    """Connects, subscribes, reads into the rings; after a loss it flushes, waits and connects again.

    States: ``idle``, ``connecting``, ``reading``, ``waiting``, ``stopped``. The n-th wait in a row is min(2^n, 60) seconds
    times a number between a half and one; a connection that takes the subscription ends the row.
    """

    def __init__(self, log: SegmentLog, subscription: Callable[[], dict], url: str = FEED_URL, buffer: int = BUFFER, connect: Callable[[str, float], WebSocket] = WebSocket, max_wait: float = MAX_WAIT_S, uniform: Callable[[float, float], float] = random.uniform):
        self.log, self.subscription, self.url, self.connect, self.max_wait, self.uniform = log, subscription, url, connect, max_wait, uniform
        self.rings = {"positions": Ring(buffer), "static": Ring(buffer)}
        self.counts = {"received": 0, "positions": 0, "static": 0, "unparsed": 0, "reconnects": 0, "flushes": 0}
        self.state, self.connected_since, self.last_error, self.waits = "idle", None, None, []
        self.lock, self.stopping, self.link = threading.RLock(), threading.Event(), None
        have = log.numbers()
        self.number = have[-1] if have else -1
        self.thread = threading.Thread(target=self.run, name="ais-feed", daemon=True)

    def stats(self) -> dict:
        return {"segment": self.number, "at": dt.datetime.now(dt.timezone.utc).isoformat(), "state": self.state, "connected_since": self.connected_since, "last_error": self.last_error, **self.counts, "dropped": sum(r.dropped for r in self.rings.values())}

    def take(self, text: str) -> None:
        """Route one message; an error envelope raises."""
        with self.lock:
            self.counts["received"] += 1
            try:
                envelope = json.loads(text)
            except ValueError:
                envelope = None
            if not isinstance(envelope, dict):
                self.counts["unparsed"] += 1
                return
            if envelope.get("error"):
                raise FeedError(str(envelope["error"]))
            kind = envelope.get("MessageType")
            name = "positions" if kind in feed.POSITION_TYPES else "static" if kind in feed.STATIC_TYPES else "unparsed"
            self.counts[name] += 1
            if name != "unparsed":
                self.rings[name].append(text.replace("\r", " ").replace("\n", " "))  # JSON has line ends between tokens only

    def flush(self) -> int:
        """Move what the rings hold into a segment; the number of the last one."""
        with self.lock:
            lines = [x for r in self.rings.values() for x in r.items]
            if lines:
                self.log.write(self.number + 1, lines)  # if this fails the rings keep their items
                self.number += 1
                for r in self.rings.values():
                    r.drain()
                self.counts["flushes"] += 1
                self.log.write_stats(self.number, self.stats())
            return self.number

    def session(self) -> None:
        """One connection, from its first byte to its loss."""
        self.state, start = "connecting", time.monotonic()
        self.link = self.connect(self.url, SUBSCRIBE_S)
        try:
            self.link.send(json.dumps(self.subscription()))
            if time.monotonic() - start > SUBSCRIBE_S:
                raise TimeoutError("the subscription came too late")
            self.state, self.connected_since, self.attempt = "reading", dt.datetime.now(dt.timezone.utc).isoformat(), 0
            for text in self.link.messages():
                self.take(text)
            raise ConnectionError("the feed ended")
        finally:
            self.link.close()

    def run(self, max_reconnects: int | None = None) -> None:
        self.attempt = 0
        while not self.stopping.is_set():
            try:
                self.session()
            except Exception as e:  # noqa: BLE001  any loss leads to another try
                if self.stopping.is_set():
                    break
                self.counts["reconnects"] += 1
                self.last_error = f"{type(e).__name__}: {e}"
                self.state = "waiting"
                with contextlib.suppress(OSError):  # a log that is out of reach must not end the reader; the rings keep their items
                    self.flush()
                wait = min(2.0**self.attempt, self.max_wait) * self.uniform(0.5, 1.0)
                self.attempt += 1
                self.waits.append(wait)
                if max_reconnects is not None and self.counts["reconnects"] > max_reconnects:
                    break
                self.stopping.wait(wait)
        self.state = "stopped"

    def start(self) -> None:
        if self.state == "idle":
            self.state = "connecting"
            self.thread.start()

    def stop(self) -> None:
        self.stopping.set()
        if self.link is not None:
            self.link.close()
        if self.thread.ident is not None:
            self.thread.join(10)
        self.flush()


def secret(options: dict) -> str:
    """The key from the file or the environment variable that the options name."""
    if options.get("keyfile"):
        with open(options["keyfile"], encoding="utf-8") as f:
            return f.read().strip()
    name = options.get("keyenv", "AISSTREAM_API_KEY")
    if not os.environ.get(name):
        raise RuntimeError(f"set {name} in the environment, or give the option keyfile")
    return os.environ[name]


class _Segment(InputPartition):
    def __init__(self, number: int):
        self.number = number


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.log = dict(options), SegmentLog(options["log"])
        self.collector: Collector | None = None

    def _running(self) -> Collector:
        if self.collector is None:
            boxes, types = json.loads(self.options["boxes"]), self.options.get("types")
            if not boxes:
                raise ValueError("no boxes to subscribe to")
            kinds = types.split(",") if types else [*feed.POSITION_TYPES, *feed.STATIC_TYPES]
            secret(self.options)  # a missing key is an error of the query, not one to try again
            self.collector = Collector(self.log, lambda: {"APIKey": secret(self.options), "BoundingBoxes": boxes, "FilterMessageTypes": kinds}, self.options.get("url", FEED_URL), int(self.options.get("buffer", BUFFER)), max_wait=float(self.options.get("maxwait", MAX_WAIT_S)))
            self.collector.start()
        return self.collector

    def initialOffset(self) -> dict:
        have = self.log.numbers()
        return {"segment": have[0] - 1 if have else -1}

    def latestOffset(self) -> dict:
        return {"segment": self._running().flush()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Segment(n) for n in range(start["segment"] + 1, end["segment"] + 1)]

    def read(self, part: _Segment) -> Iterator[pa.RecordBatch]:
        name, lines = f"{self.log.identity()}-{part.number:09d}", list(self.log.read(part.number))  # at most two rings
        for i in range(0, len(lines), 10_000):
            some = lines[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([name] * len(some), pa.string())], names=["value", "segment"])

    def commit(self, end: dict) -> None:
        """The last committed segment stays: its number is where the log goes on."""
        self.log.drop_below(end["segment"])

    def stop(self) -> None:
        if self.collector is not None:
            self.collector.stop()


class FeedSource(DataSource):
    """``readStream.format("ais_feed")``: value (a message as JSON) and segment (where it stands in the log).

    Options: ``log`` (shared folder), ``boxes`` (JSON list of [[lat, lon], [lat, lon]]), ``types`` (comma-separated; all known
    ones without it), ``url``, ``keyenv`` or ``keyfile``, ``buffer``, ``maxwait``.
    """

    @classmethod
    def name(cls) -> str:
        return "ais_feed"

    def schema(self) -> str:
        return "value string, segment string"

    def streamReader(self, schema):
        return FeedReader(self.options)


def live_feed(spark: SparkSession, log: str, zones: dict[str, Zone] = ZONES, **options) -> DataFrame:
    """The feed of the live ones among ``zones``."""
    boxes = [z.feed_box for z in zones.values() if z.live]
    if not boxes:
        raise RuntimeError("no zone is marked for live collection; nothing to subscribe to")
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("ais_feed").options(log=log, boxes=json.dumps(boxes), **options).load()


def collect(cat: Catalog, log: str, checkpoint: str, zones: dict[str, Zone] = ZONES, every: str = "5 minutes", **options):
    """The query that keeps the feed in the lake, positions and static reports by date, hour and segment.

    A batch that is repeated after a failure overwrites the folders of its own segments, so rows stand once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        env = feed.envelopes(batch, keep=("segment",)).persist()
        try:
            cat.append(feed.positions(env, zones, keep=("segment",)), "ais_positions", batch="segment")
            cat.append(feed.static_reports(env, keep=("segment",)), "ais_static", batch="segment")
        finally:
            env.unpersist()

    stream = live_feed(cat.spark, log, zones, **options)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime=every).queryName("ais_feed").start()


def collector_stats(spark: SparkSession, log: str) -> DataFrame:
    """Counters at each segment, oldest first: received, positions, static, unparsed, dropped, reconnects, flushes, state."""
    schema = "segment long, at timestamp, state string, connected_since timestamp, last_error string, received long, positions long, static long, unparsed long, reconnects long, flushes long, dropped long"
    return spark.read.schema(schema).json(f"{log}/stats").orderBy("segment", F.col("at"))
