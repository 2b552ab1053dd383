import random
import struct

import pytest

from tracewright import __main__ as cli
from tracewright.sources import capture as cap
from tracewright.sources import mysql_wire as M
from tracewright.sources import pcap as P

FLAGS = M.PROTOCOL_41 | M.SECURE | M.WITH_DB


def message(number, payload):
    out = b""
    while True:
        part, payload = payload[: M.FULL], payload[M.FULL :]
        out += len(part).to_bytes(3, "little") + bytes([number & 255]) + part
        number += 1
        if len(part) < M.FULL:
            return out


def greeting(thread=77, flags=0xFFFFFFFF, version=b"8.0.36"):
    return message(0, b"\x0a" + version + b"\0" + struct.pack("<I", thread) + b"x" * 8 + b"\0" + struct.pack("<H", flags & 0xFFFF) + b"\x21" + b"\0\0" + struct.pack("<H", flags >> 16))


def login(flags=FLAGS, user=b"app", db=b"shop"):
    return message(1, struct.pack("<IIB", flags, 1 << 24, 33) + b"\0" * 23 + user + b"\0" + b"\x02ab" + db + b"\0")


OK = message(1, b"\0\0\0\2\0\0\0")


class Wire:
    """Frames of connections between a client and a server."""

    def __init__(self, client=40_000, link=1, ip6=False, start=(1000, 9000)):
        self.client, self.link, self.ip6, self.seq, self.frames, self.ts = client, link, ip6, list(start), [], 1_700_000_000_000_000

    def segment(self, side, payload=b"", flags=16, seq=None, ms=1):
        self.ts += 1000 * ms
        ports = (self.client, 3306) if side == M.CLIENT else (3306, self.client)
        tcp = struct.pack(">HHIIBBHHH", *ports, (self.seq[side] if seq is None else seq) & 0xFFFFFFFF, 0, 5 << 4, flags, 100, 0, 0) + payload
        a, b = (b"\x0a\0\0\1", b"\x0a\0\0\2") if side == M.CLIENT else (b"\x0a\0\0\2", b"\x0a\0\0\1")
        if self.ip6:
            ip = struct.pack(">IHBB", 6 << 28, len(tcp) + 8, 0, 64) + a * 4 + b * 4 + b"\x06\0" + b"\0" * 6 + tcp
        else:
            ip = struct.pack(">BBHHHBBH", 0x45, 0, (20 + len(tcp)) % (len(tcp) < 60_000 and 65_536 or 1), 0, 0, 64, 6, 0) + a + b + tcp
        kind = b"\x86\xdd" if self.ip6 else b"\x08\0"
        head = {1: b"\0" * 12 + b"\x81\0\0\5" + kind, 101: b"", 113: b"\0" * 14 + kind, 276: kind + b"\0" * 18, 0: b"\2\0\0\0"}[self.link]
        self.frames.append((self.ts, head + ip))
        if seq is None:
            self.seq[side] += len(payload) + bool(flags & 3)

    def open(self, **hello):
        self.segment(M.CLIENT, flags=2)
        self.segment(M.SERVER, flags=18)
        self.segment(M.SERVER, greeting(**hello))

    def start(self, **hello):
        self.open(**hello)
        self.segment(M.CLIENT, login())
        self.segment(M.SERVER, message(2, b"\0\0\0\2\0\0\0"))

    def ask(self, command, payload, answer=OK, ms=5):
        self.segment(M.CLIENT, message(0, bytes([command]) + payload))
        if answer:
            self.segment(M.SERVER, answer, ms=ms)


def pcap_file(path, frames, link=1, order="<", nano=False, cut=0):
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link))
        for ts, frame in sorted(frames, key=lambda x: x[0]):
            f.write(struct.pack(order + "IIII", ts // 1_000_000, ts % 1_000_000 * (1000 if nano else 1), len(frame), len(frame) + cut) + frame)
    return str(path)


def ng_file(path, frames, link=1):
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    with open(path, "wb") as f:
        f.write(struct.pack("<II", 0x0A0D0D0A, 28) + struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1) + struct.pack("<I", 28))
        f.write(block(1, struct.pack("<HHI", link, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0)))
        for ts, frame in frames:
            f.write(block(6, struct.pack("<IIIII", 0, ts * 1000 >> 32, ts * 1000 & 0xFFFFFFFF, len(frame), len(frame)) + frame + b"\0" * (-len(frame) % 4)))
    return str(path)


def read(spark, path):
    got = P.read_capture_file(spark, path)
    return got.events.orderBy("ordinal").collect(), got.counters, got.warnings


@pytest.mark.parametrize("link,ip6", [(1, False), (101, False), (113, True), (276, False), (0, False), (1, True)])
def test_links_and_addresses(spark, tmp_path, link, ip6):
    w = Wire(link=link, ip6=ip6)
    w.start()
    w.ask(M.QUERY, b"SELECT 1")
    w.ask(M.INIT_DB, b"ot`her")
    w.ask(M.QUERY, b"SELECT 2")
    w.ask(0x0E, b"")
    w.ask(M.QUIT, b"", None)
    events, c, warned = read(spark, (pcap_file if link != 276 else ng_file)(tmp_path / "a.pcap", w.frames, link))
    assert [(e.query, e.db, e.user, e.session_id) for e in events] == [("SELECT 1", "shop", "app", 77), ("USE `ot``her`", "ot`her", "app", 77), ("SELECT 2", "ot`her", "app", 77)]
    assert [e.orig_query_time_s for e in events] == [0.005] * 3
    assert (c["connections"], c["connections_decoded"], c["packets"], c["server_versions"], c["commands_ignored"], warned) == (1, 1, len(w.frames), ["8.0.36"], 1, [])


def test_byte_orders_and_cut_packets(spark, tmp_path):
    w = Wire()
    w.start()
    w.ask(M.QUERY, b"SELECT 1")
    events, c, warned = read(spark, pcap_file(tmp_path / "a.pcap", w.frames, order=">", nano=True, cut=9))
    assert events[0].ts_micros == w.frames[-2][0] and c["truncated_packets"] == len(w.frames) and len(warned) == 1
    data = (tmp_path / "a.pcap").read_bytes()
    (tmp_path / "b.pcap").write_bytes(data[:-5])
    assert read(spark, str(tmp_path / "b.pcap"))[1]["responses_missing"] == 1


def test_segments_out_of_order_and_repeated(spark, tmp_path):
    rng = random.Random(5)
    w = Wire(start=(0xFFFFFFF0, 0xFFFFFF00))
    w.start()
    sqls = [f"SELECT '{'x' * rng.randint(1, 300)}', {i}" for i in range(20)]
    for sql in sqls:
        data = message(0, bytes([M.QUERY]) + sql.encode())
        start, cuts = w.seq[M.CLIENT], sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(4))})
        parts = [(start + max(0, a - 3), data[max(0, a - 3) : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        rng.shuffle(parts)
        for seq, part in parts + parts[:2]:
            w.segment(M.CLIENT, part, seq=seq)
        w.seq[M.CLIENT] += len(data)
        w.segment(M.SERVER, OK)
    events, c, _ = read(spark, pcap_file(tmp_path / "a.pcap", w.frames))
    assert [e.query for e in events] == sqls and c["connections_decoded"] == 1


def test_fates_of_connections(spark, tmp_path):
    frames = []
    for i, flags in enumerate((FLAGS | M.SSL, FLAGS | M.COMPRESS, 0)):
        w = Wire(41_000 + i)
        w.open()
        w.segment(M.CLIENT, login(flags))
        w.ask(M.QUERY, b"SELECT hidden")
        frames += w.frames
    w = Wire(42_000)
    w.ask(M.QUERY, b"SELECT mid")
    frames += w.frames
    w = Wire(43_000)
    w.start()
    w.ask(M.QUERY, b"SELECT kept")
    for i in range(10):
        w.segment(M.CLIENT, b"z" * 1_000_000, seq=w.seq[0] + 10 + i * 1_000_000)
    w.ask(M.QUERY, b"SELECT lost")
    frames += w.frames
    frames.append((w.ts + 1, b"\0" * 12 + b"\x08\0" + struct.pack(">BBHHHBBH", 0x45, 0, 28, 0, 0x2000, 64, 6, 0) + b"\0" * 16))
    events, c, warned = read(spark, pcap_file(tmp_path / "a.pcap", frames))
    assert [e.query for e in events] == ["SELECT kept"]
    assert [c[n] for n in ("connections", "connections_tls_skipped", "connections_compressed_skipped", "connections_midstream_skipped", "connections_broken", "connections_decoded", "ip_fragments_skipped")] == [5, 1, 1, 2, 1, 0, 1]
    assert len(warned) == 5


def test_reused_ports_and_thread_ids(spark, tmp_path):
    w = Wire()
    w.start(thread=5)
    w.ask(M.QUERY, b"SELECT 'unanswered'", None)
    w.seq = [700_000, 800_000]
    w.start(thread=6)
    w.ask(M.QUERY, b"SELECT 6")
    other = Wire(50_000)
    other.ts = w.ts
    other.start(thread=6)
    other.ask(M.QUERY, b"SELECT 'again'")
    events, c, _ = read(spark, pcap_file(tmp_path / "a.pcap", w.frames + other.frames))
    assert [(e.query, e.session_id, e.orig_query_time_s) for e in events] == [("SELECT 'unanswered'", 5, 0.0), ("SELECT 6", 6, 0.005), ("SELECT 'again'", P.SYNTHETIC, 0.005)]
    assert c["connections"] == 3 and c["responses_missing"] == 1


def prepare_ok(number, n):
    return message(1, b"\0" + struct.pack("<IHHBH", number, 0, n, 0, 0))


def test_prepared_statements(spark, tmp_path):
    w = Wire()
    w.start()
    w.ask(M.PREPARE, b"SELECT ?, '?', ? -- ?\n, `?`, ?", prepare_ok(3, 3))
    text = b"it's"
    w.ask(M.EXECUTE, struct.pack("<IBI", 3, 0, 1) + b"\x02" + b"\x01" + b"\x03\0\x06\0\xfd\0" + struct.pack("<i", -5) + bytes([len(text)]) + text)
    w.ask(M.LONG_DATA, struct.pack("<IH", 3, 2) + b"lo\xff", None)
    w.ask(M.EXECUTE, struct.pack("<IBI", 3, 0, 1) + b"\x02" + b"\x00" + struct.pack("<i", 7))
    w.ask(M.CLOSE, struct.pack("<I", 3), None)
    w.ask(M.EXECUTE, struct.pack("<IBI", 3, 0, 1))
    events, c, _ = read(spark, pcap_file(tmp_path / "a.pcap", w.frames))
    assert [e.query for e in events] == ["SELECT -5, '?', NULL -- ?\n, `?`, 'it''s'", "SELECT 7, '?', NULL -- ?\n, `?`, X'6C6FFF'"]
    assert (c["statements_expanded"], c["statements_inexpandable"]) == (2, 1)


@pytest.mark.parametrize(
    "kind,flags,data,want",
    [(1, 0, b"\xff", "-1"), (1, 128, b"\xff", "255"), (2, 0, b"\x00\x80", "-32768"), (8, 128, b"\xff" * 8, str(2**64 - 1)), (4, 0, struct.pack("<f", 0.1), "0.1"), (5, 0, struct.pack("<d", 1e20), "100000000000000000000"), (5, 0, struct.pack("<d", float("nan")), "NULL"), (10, 0, b"\x04\xe8\x07\x02\x1d", "'2024-02-29'"), (12, 0, b"\x0b\xe8\x07\x02\x1d\x01\x02\x03\x40\xe2\x01\x00", "'2024-02-29 01:02:03.123456'"), (7, 0, b"\x00", "'0000-00-00 00:00:00'"), (11, 0, b"\x08\x01\x02\x00\x00\x00\x03\x04\x05", "'-51:04:05'"), (0xF6, 0, b"\x05-1.50", "-1.50"), (16, 0, b"\x01\x05", "X'05'"), (0xFC, 0, b"\x02\xff\x00", "X'FF00'"), (6, 0, b"", "NULL")],
)
def test_binary_values(kind, flags, data, want):
    assert M.binary_value(M.Reader(data), kind, flags) == want


def test_unsupported_values():
    for kind, data in ((0xFF, b"\x01a"), (12, b"\x05aaaaa"), (3, b"ab")):
        with pytest.raises(M.Short):
            M.binary_value(M.Reader(data), kind, 0)
    with pytest.raises(M.Short):
        M.interpolate("SELECT ?", [], 1)
    with pytest.raises(M.Short):
        M.interpolate("SELECT 1", [], 1)


def test_query_attributes_and_long_messages():
    c = M.Connection()
    c.feed(M.SERVER, 0, greeting())
    c.feed(M.CLIENT, 1, login(FLAGS | M.QUERY_ATTRIBUTES))
    c.feed(M.CLIENT, 2, message(0, bytes([M.QUERY]) + b"\x01\x01\x00\x01\x03\x00\x01k" + struct.pack("<i", 5) + b"SELECT 1"))
    assert [e["query"] for e in c.feed(M.SERVER, 9, OK)] == ["SELECT 1"]
    big = b"SELECT '" + b"x" * (M.FULL + 10) + b"'"
    c.attributes = False
    c.feed(M.CLIENT, 10, message(0, bytes([M.QUERY]) + big))
    assert [len(e["query"]) for e in c.feed(M.SERVER, 11, message(2, b"\0"))] == [len(big)]


def test_capture_command(spark, tmp_path, capsys):
    w = Wire()
    w.start()
    w.ask(M.QUERY, b"SELECT 1")
    path, out = pcap_file(tmp_path / "a.pcap", w.frames), str(tmp_path / "c.jsonl.zst")
    assert P.looks_like_pcap(path) and not P.looks_like_pcap(__file__)
    assert cli.main(["capture", "--input", path, "--out", out]) == 0
    got = cap.read_capture(spark, out)
    assert got.summary["pcap"]["connections_decoded"] == 1 and got.events.first().query == "SELECT 1"
    assert "1 events" in capsys.readouterr().out
