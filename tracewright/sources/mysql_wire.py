"""Statements of a MySQL connection from the bytes of its two directions."""

from __future__ import annotations

import re
import struct
from collections import deque
from decimal import Decimal

from tracewright.functions import sqltext

#: Fixed values of the protocol.
SSL, COMPRESS, ZSTD, PROTOCOL_41, WITH_DB, SECURE, LENENC_AUTH, QUERY_ATTRIBUTES = 0x800, 0x20, 0x4000000, 0x200, 0x8, 0x8000, 0x200000, 0x8000000
QUIT, INIT_DB, QUERY, PREPARE, EXECUTE, LONG_DATA, CLOSE, RESET = 0x01, 0x02, 0x03, 0x16, 0x17, 0x18, 0x19, 0x1A
PARAMETER_COUNT, UNSIGNED, FULL = 0x8, 0x80, 0xFFFFFF
INTEGERS = {0x01: 1, 0x02: 2, 0x0D: 2, 0x03: 4, 0x09: 4, 0x08: 8}
NULL_TYPE, DATES, TIME, DECIMALS, BIT = 0x06, (0x07, 0x0A, 0x0C), 0x0B, (0x00, 0xF6), 0x10
TEXTS = (0x0F, 0xF5, 0xF7, 0xF8, 0xF9, 0xFA, 0xFB, 0xFC, 0xFD, 0xFE)
#: A message longer than this breaks the connection's decoding.
MOST_BYTES = 64 << 20
CLIENT, SERVER = 0, 1

_ESCAPES = str.maketrans({"'": "''", "\\": "\\\\", "\0": "\\0", "\n": "\\n", "\r": "\\r", "\x1a": "\\Z"})
_HOLES = re.compile(rf"{sqltext.QUOTED}|{sqltext.BLOCK}|{sqltext.LINE}|\?".replace(r"\z", r"\Z"))


class Short(Exception):
    """A message ends before what it should hold, or holds what has no literal."""


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def length(self) -> int:
        first = self.number(1)
        if first < 0xFB:
            return first
        if first in (0xFB, 0xFF):
            raise Short
        return self.number({0xFC: 2, 0xFD: 3, 0xFE: 8}[first])

    def counted(self) -> bytes:
        return self.take(self.length())

    def until_null(self) -> bytes:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Short
        out = self.data[self.at : end]
        self.at = end + 1
        return out

    def rest(self) -> bytes:
        return self.data[self.at :]


def string_literal(text: str) -> str:
    return f"'{text.translate(_ESCAPES)}'"


def bytes_literal(data: bytes) -> str:
    try:
        return string_literal(data.decode())
    except UnicodeDecodeError:
        return f"X'{data.hex().upper()}'"


def _float_text(value: float, short: str) -> str:
    if value != value or value in (float("inf"), float("-inf")):
        return "NULL"
    text = format(Decimal(short), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def binary_value(r: Reader, kind: int, flags: int) -> str:
    """A parameter of a prepared statement as a literal."""
    if kind == NULL_TYPE:
        return "NULL"
    if kind in INTEGERS:
        return str(int.from_bytes(r.take(INTEGERS[kind]), "little", signed=not flags & UNSIGNED))
    if kind == 0x04:
        import numpy as np

        raw = r.take(4)
        return _float_text(struct.unpack("<f", raw)[0], str(np.frombuffer(raw, "<f4")[0]))
    if kind == 0x05:
        (v,) = struct.unpack("<d", r.take(8))
        return _float_text(v, repr(v))
    if kind in DATES:
        b = r.take(r.number(1))
        if not b:
            return "'0000-00-00 00:00:00'"
        if len(b) not in (4, 7, 11):
            raise Short
        text = f"{b[0] | b[1] << 8:04d}-{b[2]:02d}-{b[3]:02d}"
        if len(b) > 4:
            text += f" {b[4]:02d}:{b[5]:02d}:{b[6]:02d}"
        return f"'{text}" + (f".{int.from_bytes(b[7:], 'little'):06d}'" if len(b) > 7 else "'")
    if kind == TIME:
        b = r.take(r.number(1))
        if not b:
            return "'00:00:00'"
        if len(b) not in (8, 12):
            raise Short
        hours = int.from_bytes(b[1:5], "little") * 24 + b[5]
        return f"'{'-' * bool(b[0])}{hours:02d}:{b[6]:02d}:{b[7]:02d}" + (f".{int.from_bytes(b[8:], 'little'):06d}'" if len(b) > 8 else "'")
    if kind in DECIMALS:
        data = r.counted()
        if re.fullmatch(rb"[0-9+\-.eE]+", data):
            return data.decode()
        try:
            return string_literal(data.decode())
        except UnicodeDecodeError:
            raise Short from None
    if kind == BIT:
        return f"X'{r.counted().hex().upper()}'"
    if kind in TEXTS:
        return bytes_literal(r.counted())
    raise Short


def interpolate(sql: str, values: list[str], expected: int) -> str:
    """A statement with its question marks filled in, those in quotes and comments left alone."""
    left = iter(values)
    n = 0

    def fill(m: re.Match) -> str:
        nonlocal n
        if m[0] != "?":
            return m[0]
        n += 1
        try:
            return next(left)
        except StopIteration:
            raise Short from None

    out = _HOLES.sub(fill, sql)
    if n != expected:
        raise Short
    return out


def use_target(sql: str) -> str | None:
    """X19 for a statement on the wire, where a name may hold white space."""
    m = re.fullmatch(r"(?is)use\s+(.+)", sql.strip().removesuffix(";").strip())
    if not m:
        return None
    name = m[1].strip()
    if name.startswith("`"):
        return name[1:-1].replace("``", "`") or None if len(name) > 1 and name.endswith("`") else None
    return name


class Messages:
    """Messages of one direction from its bytes in order: (first number, last number, time, payload)."""

    def __init__(self):
        self.data, self.base, self.times = bytearray(), 0, deque()
        self.open: tuple[int, int, bytearray] | None = None
        self.broken = False

    def feed(self, ts: int, data: bytes):
        self.times.append((self.base + len(self.data), ts))
        self.data += data
        at = 0
        while len(self.data) - at >= 4:
            n = int.from_bytes(self.data[at : at + 3], "little")
            if len(self.data) - at < 4 + n:
                break
            number, payload = self.data[at + 3], bytes(self.data[at + 4 : at + 4 + n])
            while len(self.times) > 1 and self.times[1][0] <= self.base + at:
                self.times.popleft()
            first, when, whole = self.open or (number, self.times[0][1], bytearray())
            if len(whole) + n > MOST_BYTES:
                self.broken = True
                return
            whole += payload
            self.open = (first, when, whole) if n == FULL else None
            if not self.open:
                yield first, number, when, bytes(whole)
            at += 4 + n
        del self.data[:at]
        self.base += at
        self.broken = len(self.data) > MOST_BYTES


class Connection:
    """The decoder of a connection. ``end`` is why it stopped: tls, compressed, midstream, broken or closed."""

    COUNTERS = ("statements_expanded", "statements_inexpandable", "commands_ignored", "responses_missing")

    def __init__(self):
        self.phase, self.sides = "greeting", (Messages(), Messages())
        self.end: str | None = None
        self.quit = False
        self.version = self.thread = self.user = self.db = None
        self.server_flags = 0
        self.attributes = False
        self.prepared: dict[int, list] = {}  # id -> [text, number of parameters, their types]
        self.long: dict[tuple[int, int], bytearray] = {}
        self.waiting: deque = deque()  # (number of the first response message, what it answers)
        self.next_part: int | None = None
        self.counts = dict.fromkeys(self.COUNTERS, 0)

    def feed(self, side: int, ts: int, data: bytes) -> list[dict]:
        """Bytes of one side, in order; the statements whose responses begin."""
        out: list[dict] = []
        if self.end or self.quit or not data:
            return out
        for message in self.sides[side].feed(ts, data):
            if side == SERVER:
                self._answer(*message, out)
            else:
                self._ask(*message)
            if self.end or self.quit:
                return out
        if self.sides[side].broken:
            self.end = "broken"
        return out

    def close(self) -> list[dict]:
        """Statements that were never answered."""
        left = [x for _, x in self.waiting if isinstance(x, dict)]
        self.waiting.clear()
        self.counts["responses_missing"] += len(left)
        return [x | {"latency_s": 0.0, "response_seen": False} for x in left]

    def _answer(self, first: int, last: int, ts: int, payload: bytes, out: list[dict]) -> None:
        if self.phase == "greeting":
            try:
                r = Reader(payload)
                if r.number(1) != 10:
                    raise Short
                self.version = r.until_null().decode("utf-8", "replace")
                self.thread = r.number(4)
                rest = r.rest()  # 8 bytes of data, a blank, then flags in two halves
                low, high = rest[9:11], rest[14:16]
                self.server_flags = int.from_bytes(low, "little") | int.from_bytes(high, "little") << 16
                self.phase = "login"
            except Short:
                self.end = "midstream"
            return
        if self.phase == "login":
            self.end = "midstream"
            return
        if self.next_part == first:
            self.next_part = (last + 1) & 255
            return
        if not self.waiting or self.waiting[0][0] != first:
            self.next_part = None
            return
        self.next_part = (last + 1) & 255
        what = self.waiting.popleft()[1]
        if isinstance(what, dict):
            out.append(what | {"latency_s": max(0, ts - what["ts_micros"]) / 1e6, "response_seen": True})
        elif isinstance(what, str) and len(payload) >= 9 and payload[0] == 0:
            self.prepared[int.from_bytes(payload[1:5], "little")] = [what, int.from_bytes(payload[7:9], "little"), None]

    def _ask(self, first: int, last: int, ts: int, payload: bytes) -> None:
        if self.phase == "greeting":
            self.end = "midstream"
        elif self.phase == "login":
            self._login(payload)
        elif first == 0 and payload:
            if not self.waiting:
                self.next_part = None
            self._command(payload[0], payload[1:], (last + 1) & 255, ts)

    def _login(self, payload: bytes) -> None:
        flags = int.from_bytes(payload[:4], "little")
        self.end = "midstream" if len(payload) < 4 or not flags & PROTOCOL_41 else "tls" if flags & SSL else "compressed" if flags & (COMPRESS | ZSTD) else None
        if self.end:
            return
        # A client may send a flag that the server never offered, and then not act on it.
        self.attributes = bool(flags & self.server_flags & QUERY_ATTRIBUTES)
        self.phase = "open"
        r = Reader(payload)
        try:
            r.take(32)
            self.user = r.until_null().decode("utf-8", "replace")
            if flags & LENENC_AUTH:
                r.counted()
            elif flags & SECURE:
                r.take(r.number(1))
            else:
                r.until_null()
            if flags & WITH_DB:
                self.db = r.until_null().decode("utf-8", "replace") or None
        except Short:
            return

    def _statement(self, answer: int, ts: int, sql: str) -> None:
        self.db = use_target(sql) or self.db
        self.waiting.append((answer, {"ts_micros": ts, "query": sql, "db": self.db, "user": self.user}))

    def _command(self, command: int, p: bytes, answer: int, ts: int) -> None:
        if command == QUIT:
            self.quit = True
        elif command == QUERY:
            try:
                self._statement(answer, ts, self._query_text(p).decode("utf-8", "replace"))
            except Short:
                self.counts["commands_ignored"] += 1
                self.waiting.append((answer, None))
        elif command == INIT_DB:
            name = p.decode("utf-8", "replace")
            self.db = name
            self._statement(answer, ts, "USE `" + name.replace("`", "``") + "`")
        elif command == PREPARE:
            self.waiting.append((answer, p.decode("utf-8", "replace")))
        elif command == EXECUTE:
            try:
                sql = self._execute(p)
                self.counts["statements_expanded"] += 1
                self._statement(answer, ts, sql)
            except Short:
                self.counts["statements_inexpandable"] += 1
                self.waiting.append((answer, None))
        elif command == LONG_DATA:  # has no answer
            if len(p) >= 6:
                self.long.setdefault((int.from_bytes(p[:4], "little"), int.from_bytes(p[4:6], "little")), bytearray()).extend(p[6:])
        elif command in (CLOSE, RESET):
            if len(p) >= 4:
                number = int.from_bytes(p[:4], "little")
                self._forget(number)
                if command == CLOSE:
                    self.prepared.pop(number, None)
            if command == RESET:
                self.waiting.append((answer, None))
        else:
            self.counts["commands_ignored"] += 1
            self.waiting.append((answer, None))

    def _forget(self, number: int) -> None:
        self.long = {k: v for k, v in self.long.items() if k[0] != number}

    @staticmethod
    def _types(r: Reader, n: int, named: bool) -> list[tuple[int, int]]:
        types = []
        for _ in range(n):
            types.append((r.number(1), r.number(1)))
            if named:
                r.counted()
        return types

    def _query_text(self, p: bytes) -> bytes:
        """The text of a query, past its attributes."""
        if not self.attributes:
            return p
        r = Reader(p)
        n = r.length()
        r.length()
        if n:
            nulls = r.take((n + 7) // 8)
            if r.number(1) != 1:
                raise Short
            for i, t in enumerate(self._types(r, n, True)):
                if not nulls[i // 8] >> (i % 8) & 1:
                    binary_value(r, *t)
        return r.rest()

    def _execute(self, p: bytes) -> str:
        """A prepared statement with its parameters."""
        r = Reader(p)
        number, flags = r.number(4), r.number(1)
        r.take(4)
        if number not in self.prepared:
            raise Short
        own = self.prepared[number]
        named = self.attributes and bool(flags & PARAMETER_COUNT)
        n = r.length() if named else own[1]
        values: list[str] = []
        if n:
            nulls = r.take((n + 7) // 8)
            if r.number(1) == 1:
                own[2] = self._types(r, n, named)
            if own[2] is None or len(own[2]) < n:
                raise Short
            for i, t in enumerate(own[2][:n]):
                if nulls[i // 8] >> (i % 8) & 1:
                    values.append("NULL")
                elif (number, i) in self.long:
                    values.append(bytes_literal(bytes(self.long[number, i])))
                else:
                    values.append(binary_value(r, *t))
        self._forget(number)
        return interpolate(own[0], values[: own[1]], own[1])
