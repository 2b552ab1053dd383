"""Packet captures of MySQL traffic as events.

Reading a file is one task: packets come in its order. Its TCP segments on the server's port are then dealt by connection and sorted, and
each connection is reassembled and decoded as its packets stream by, so decoding is spread over connections and holds one at a time. What has
to be known across connections, session ids and counters, is relational.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tracewright.sources.mysql_wire import CLIENT, SERVER, Connection
from tracewright.sources.slowlog import _File
from tracewright.storage import numbered, written

PACKET = "file string, pkt long, ts_micros long, flow string, side int, seq long, syn boolean, fin boolean, ack boolean, rst boolean, payload binary, truncated boolean, fragment boolean"
DECODED = (
    "file string, flow string, conn int, kind string, emitted long, at int, ts_micros long, user string, db string, query string, latency_s double, response_seen boolean, thread long, version string, fate string, "
    "statements_expanded long, statements_inexpandable long, commands_ignored long, responses_missing long"
)
#: The first bytes of capture files, and of link layers those that can be stripped.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}
NG_MAGIC = b"\x0a\x0d\x0d\x0a"
LOOPBACK, ETHERNET, RAW, COOKED, COOKED2 = (0, 108), 1, 101, 113, 276
IP_TYPES, VLAN_TYPES = (0x0800, 0x86DD), (0x8100, 0x88A8)
#: Data out of order that a direction may hold before its connection counts as broken.
MOST_PENDING = 8 << 20
#: Sessions whose thread id is not known, or is taken, are numbered from here.
SYNTHETIC = 1 << 48
#: Where what is left at the end of a file sorts.
AFTER_ALL = 1 << 42
FATES = {"decoded": "connections_decoded", "tls": "connections_tls_skipped", "compressed": "connections_compressed_skipped", "midstream": "connections_midstream_skipped", "broken": "connections_broken"}
#: Fixed order of the warnings about what was lost.
LOSSES = (
    ("connections_tls_skipped", "connections were encrypted and could not be read"),
    ("connections_compressed_skipped", "connections were compressed and could not be read"),
    ("connections_midstream_skipped", "connections began before the capture, or are not MySQL"),
    ("connections_broken", "connections lack packets and were read in part"),
    ("truncated_packets", "packets were cut short; capture whole packets"),
    ("ip_fragments_skipped", "IP fragments were left out"),
    ("statements_inexpandable", "prepared statements could not be filled in and were left out"),
)


def looks_like_pcap(path: str) -> bool:
    """S4."""
    try:
        with open(path, "rb") as f:
            first = f.read(4)
    except OSError:
        return False
    return first in MAGIC or first == NG_MAGIC


def packets(stream):
    """(microseconds, link type, frame, cut short) of a pcap or pcap-ng file; what follows a cut end is left out."""

    def read(n: int) -> bytes | None:
        data = stream.read(n)
        return data if len(data) == n else None

    first = read(4)
    if first in MAGIC:
        order, per_micro = MAGIC[first]
        head = read(20)
        link = struct.unpack(order + "I", head[16:])[0] & 0xFFFF if head else ETHERNET
        while record := read(16):
            seconds, part, kept, whole = struct.unpack(order + "IIII", record)
            frame = read(kept)
            if frame is None:
                return
            yield seconds * 1_000_000 + part // per_micro, link, frame, kept < whole
    elif first == NG_MAGIC:
        order, ports, kind = "<", [], first
        while kind:
            size = read(4)
            if size is None:
                return
            if kind == NG_MAGIC:
                mark = read(4)
                if mark is None:
                    return
                order, ports = (">" if mark == b"\x1a\x2b\x3c\x4d" else "<"), []
                body = read(struct.unpack(order + "I", size)[0] - 16)
            else:
                body = read(struct.unpack(order + "I", size)[0] - 12)
            if body is None or read(4) is None:
                return
            number = struct.unpack(order + "I", kind)[0]
            if number == 1 and len(body) >= 8:
                ports.append((struct.unpack(order + "H", body[:2])[0], *_clock(order, body[8:])))
            elif number == 6 and len(body) >= 20:
                at, high, low, kept, whole = struct.unpack(order + "IIIII", body[:20])
                if at < len(ports):
                    link, units, offset = ports[at]
                    yield ((high << 32 | low) * 1_000_000) // units + offset * 1_000_000, link, body[20 : 20 + kept], kept < whole
            kind = read(4)
    else:
        raise ValueError("not a packet capture")


def _clock(order: str, options: bytes) -> tuple[int, int]:
    """Units a second and the offset in seconds from an interface's options."""
    units, offset, at = 1_000_000, 0, 0
    while at + 4 <= len(options):
        code, n = struct.unpack(order + "HH", options[at : at + 4])
        value = options[at + 4 : at + 4 + n]
        if code == 9 and n == 1:
            units = 1 << (value[0] & 127) if value[0] & 128 else 10 ** value[0]
        elif code == 14 and n == 8:
            offset = struct.unpack(order + "q", value)[0]
        elif code == 0:
            break
        at += 4 + n + -n % 4
    return units, offset


def ip_of(link: int, frame: bytes) -> bytes | None:
    """the IP packet of a frame."""
    if link == RAW:
        return frame
    if link in LOOPBACK:
        return frame[4:] if len(frame) >= 4 else None
    kind_at, start = {ETHERNET: (12, 14), COOKED: (14, 16), COOKED2: (0, 20)}.get(link, (None, None))
    if kind_at is None or len(frame) < start:
        return None
    kind = int.from_bytes(frame[kind_at : kind_at + 2])
    while link == ETHERNET and kind in VLAN_TYPES:
        start += 4
        if len(frame) < start:
            return None
        kind = int.from_bytes(frame[start - 2 : start])
    return frame[start:] if kind in IP_TYPES else None


def is_fragment(ip: bytes) -> bool:
    """F14."""
    version = ip[0] >> 4 if ip else 0
    return (version == 4 and len(ip) >= 8 and bool(int.from_bytes(ip[6:8]) & 0x3FFF)) or (version == 6 and len(ip) >= 40 and ip[6] == 44)


def tcp_of(ip: bytes) -> tuple[bytes, bytes, bytes] | None:
    """(source, destination, TCP segment) of a whole IP packet."""
    version = ip[0] >> 4 if ip else 0
    if version == 4:
        head = (ip[0] & 15) * 4
        if len(ip) < 20 or head < 20 or len(ip) < head or is_fragment(ip) or ip[9] != 6:
            return None
        total = int.from_bytes(ip[2:4])
        return ip[12:16], ip[16:20], ip[head : total if head <= total <= len(ip) else len(ip)]
    if version != 6 or len(ip) < 40:
        return None
    following, at = ip[6], 40
    while following in (0, 43, 60):  # options that may come before the segment
        if len(ip) < at + 8:
            return None
        following, at = ip[at], at + (ip[at + 1] + 1) * 8
    end = min(40 + int.from_bytes(ip[4:6]), len(ip))
    return (ip[8:24], ip[24:40], ip[at:end]) if following == 6 and at <= end else None


def rows_of(stream, port: int, file: str):
    """Rows of ``PACKET``: F13, the segments from and to the port, and fragments."""
    for n, (ts, link, frame, cut) in enumerate(packets(stream)):
        ip = ip_of(link, frame)
        if not ip:
            continue
        found = tcp_of(ip)
        if found is None or len(found[2]) < 20:
            if is_fragment(ip):
                yield (file, n, ts, None, None, None, False, False, False, False, None, cut, True)
            continue
        source, target, tcp = found
        head, flags = (tcp[12] >> 4) * 4, tcp[13]
        if head < 20 or len(tcp) < head:
            continue
        a, b = (f"{x.hex()}:{int.from_bytes(p)}" for x, p in ((source, tcp[:2]), (target, tcp[2:4])))
        if int.from_bytes(tcp[:2]) == port:
            side, flow = SERVER, f"{b}>{a}"
        elif int.from_bytes(tcp[2:4]) == port:
            side, flow = CLIENT, f"{a}>{b}"
        else:
            continue
        yield (file, n, ts, flow, side, int.from_bytes(tcp[4:8]), bool(flags & 2), bool(flags & 1), bool(flags & 16), bool(flags & 4), tcp[head:], cut, False)


class _PacketReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.port = options["path"], int(options.get("port", "3306"))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        files, path = self._files()
        info = files.get_file_info(path)
        found = [info] if info.is_file else [x for x in files.get_file_info(fs.FileSelector(path)) if x.is_file]
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path)]

    def read(self, partition):
        with self._files()[0].open_input_stream(partition.path, buffer_size=1 << 20) as stream:
            yield from rows_of(stream, self.port, partition.path)


class PcapSource(DataSource):
    """``spark.read.format("mysql_pcap").option("port", ...).load(path)``: a file, or the files of a folder."""

    @classmethod
    def name(cls):
        return "mysql_pcap"

    def schema(self):
        return PACKET

    def reader(self, schema):
        return _PacketReader(self.options)


class Stream:
    """One direction's bytes in order, from segments in any."""

    def __init__(self):
        self.first: int | None = None
        self.done = 0
        self.later: list[tuple[int, int, bytes]] = []
        self.held = 0
        self.lost = False

    def open(self, seq: int) -> None:
        self.first, self.done, self.later, self.held = (seq + 1) & 0xFFFFFFFF, 0, [], 0

    def _place(self, seq: int) -> int:
        """The place in the stream that a number of 32 bits means: the one nearest to what is expected."""
        away = (seq - self.first - self.done + (1 << 31)) % (1 << 32) - (1 << 31)
        return self.done + away

    def data(self, ts: int, seq: int, payload: bytes):
        if not payload or self.lost:
            return
        if self.first is None:
            self.first = seq
        at = self._place(seq)
        if at > self.done:
            if self.held + len(payload) > MOST_PENDING:
                self.lost, self.later, self.held = True, [], 0
            elif all(x[0] != at for x in self.later):
                heapq.heappush(self.later, (at, ts, payload))
                self.held += len(payload)
            return
        heapq.heappush(self.later, (at, ts, payload))
        self.held += len(payload)
        while self.later and self.later[0][0] <= self.done:
            at, when, part = heapq.heappop(self.later)
            self.held -= len(part)
            if at + len(part) > self.done:
                fresh = part[self.done - at :]
                self.done = at + len(part)
                yield when, fresh


class Flow:
    """The connections that one pair of endpoints has had, one after another."""

    def __init__(self, file: str, flow: str):
        self.file, self.flow, self.n, self.last = file, flow, -1, 0
        self.over = True

    def _begin(self) -> None:
        self.n += 1
        self.decoder, self.streams, self.fins, self.over = Connection(), (Stream(), Stream()), [False, False], False

    def packet(self, p: dict):
        self.last = p["pkt"]
        if p["syn"] and not p["ack"] and p["side"] == CLIENT:
            again = self.n >= 0 and not self.over and self.streams[CLIENT].first == (p["seq"] + 1) & 0xFFFFFFFF
            if not again:
                yield from self.end(p["pkt"])
                self._begin()
        elif self.n < 0:
            self._begin()
        if self.over:
            return
        stream = self.streams[p["side"]]
        if p["syn"]:
            stream.open(p["seq"])
        found = []
        for ts, data in stream.data(p["ts_micros"], p["seq"], p["payload"]):
            found += self.decoder.feed(p["side"], ts, data)
        yield from self._events(found, p["pkt"])
        self.fins[p["side"]] |= p["fin"]
        if p["rst"] or all(self.fins) or self.decoder.end or any(s.lost for s in self.streams):
            yield from self.end(p["pkt"], len(found))

    def _events(self, found: list[dict], emitted: int, at: int = 0):
        for i, e in enumerate(found, at):
            yield {"file": self.file, "flow": self.flow, "conn": self.n, "kind": "event", "emitted": emitted, "at": i, "thread": self.decoder.thread} | e

    def end(self, emitted: int | None = None, at: int = 0):
        """The connection is over: what was not answered, and its counters."""
        if self.over:
            return
        self.over = True
        yield from self._events(self.decoder.close(), AFTER_ALL + self.last if emitted is None else emitted, at)
        fate = self.decoder.end or ("broken" if any(s.lost for s in self.streams) else "decoded")
        yield {"file": self.file, "flow": self.flow, "conn": self.n, "kind": "connection", "emitted": emitted, "thread": self.decoder.thread, "version": self.decoder.version, "fate": fate} | self.decoder.counts


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_FIELDS = [f.split() for f in DECODED.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in _FIELDS], [n for n, _ in _FIELDS])


def _decode(batches):
    flow, rows = None, []
    for batch in batches:
        for p in batch.to_pylist():
            if flow is None or (flow.file, flow.flow) != (p["file"], p["flow"]):
                if flow:
                    rows += flow.end()
                flow = Flow(p["file"], p["flow"])
            rows += flow.packet(p)
        if rows:
            yield _batch(rows)
            rows = []
    if flow and (rows := list(flow.end())):
        yield _batch(rows)


@dataclass
class PcapCapture:
    events: DataFrame
    counters: dict
    warnings: list[str]


def decode(read: DataFrame) -> DataFrame:
    """Rows of ``DECODED`` from rows of ``PACKET``: statements and connections."""
    segments = read.where("NOT fragment").select("file", "pkt", "ts_micros", "flow", "side", "seq", "syn", "fin", "ack", "rst", "payload")
    return segments.repartition("file", "flow").sortWithinPartitions("file", "flow", "pkt").mapInArrow(_decode, DECODED)


def events_of(decoded: DataFrame) -> DataFrame:
    """Statements as events, in the order in which their responses came, file by file. W9: a thread id is the session of the first
    connection that has it; other connections are numbered from SYNTHETIC, in order."""
    found = decoded.where("kind = 'event'")
    key = ["file", "flow", "conn"]
    conns = found.groupBy(*key).agg(F.min(F.struct("emitted", "at")).alias("first"), F.first("thread").alias("thread"))
    conns = written(conns.select(*key, F.struct("file", "first", "flow", "conn").alias("begin"), "thread"), "connections")
    owners = conns.where("thread IS NOT NULL").groupBy("thread").agg(F.min("begin").alias("begin"))
    own = conns.join(owners.hint("merge"), ["thread", "begin"]).select(*key, F.col("thread").alias("session_id"))
    rest = numbered(conns.join(own.select(*key).hint("merge"), key, "left_anti"), ["begin"], "place").select(*key, (F.lit(SYNTHETIC) + F.col("place")).alias("session_id"))
    events = numbered(found, ["file", "emitted", "at"], "ordinal").join(own.unionByName(rest).hint("merge"), key)
    return events.select("ordinal", "ts_micros", "session_id", "user", "db", "query", F.col("latency_s").alias("orig_query_time_s"))


def counters(read: DataFrame, decoded: DataFrame) -> dict:
    """A15."""
    one = read.agg(F.count_if(~F.col("fragment")).alias("packets"), F.count_if(F.col("truncated") & ~F.col("fragment")).alias("truncated_packets"), F.count_if("fragment").alias("ip_fragments_skipped")).first().asDict()
    c = decoded.where("kind = 'connection'")
    two = c.agg(
        F.count("*").alias("connections"),
        *[F.count_if(F.col("fate") == fate).alias(name) for fate, name in FATES.items()],
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in Connection.COUNTERS],
        F.slice(F.array_sort(F.collect_set("version")), 1, 8).alias("server_versions"),
    )
    return one | two.first().asDict()


def warnings(counted: dict) -> list[str]:
    """C13."""
    return [f"{counted[name]} {text}" for name, text in LOSSES if counted[name]]


def read_capture_file(spark: SparkSession, path: str, port: int = 3306) -> PcapCapture:
    spark.dataSource.register(PcapSource)
    read = spark.read.format("mysql_pcap").option("port", str(port)).load(path)
    decoded = decode(read).cache()
    counted = counters(read, decoded)
    return PcapCapture(events_of(decoded), counted, warnings(counted))
