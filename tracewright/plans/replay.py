"""Executes captured sessions on a target and logs what became of each event.

Sessions are dealt to partitions by a shuffle, in which each one's events are sorted; that shuffle is the spool. A task runs the sessions of its
partition, each in order and on a connection of its own, or on connections of a small pool. The log is written once, so that no report makes
the target run a statement again. A task that is lost is run again by Spark, and so are its sessions' reads. With writes allowed that must
not be: a task then leaves a mark in the shared folder before its first statement, and one that finds its partition marked fails.

The write gate holds by default: what is not provably a read is skipped. A target that fails in a way that ends its connection ends the
session: the rest of its events are ``not_run``.
"""

from __future__ import annotations

import contextlib
import queue
import re
import struct
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions import sqltext
from tracewright.functions.scalars import redact_url_text, truncate_bytes
from tracewright.operators import events as ev
from tracewright.storage import shared_path, written

#: Rows of a log that the driver holds at a time.
DRIVER_ROWS = 50_000
LOG_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "decimal(20,0)": pa.decimal128(20, 0), "array<string>": pa.list_(pa.string())}
LOG_FIELDS = [(c.split()[0], c.split()[1]) for c in re.split(r", (?=[a-z_]+ )", schemas.EXEC_LOG)]


class TargetError(Exception):
    def __init__(self, message: str, fatal: bool = False):
        super().__init__(message)
        self.fatal = fatal


@dataclass
class ResultChecksum:
    rows: int
    digest: int
    columns: list[str]
    size: int


class Connection(ABC):
    @abstractmethod
    def query(self, sql: str) -> int:
        """Runs a statement, reads its rows and returns their size."""

    @abstractmethod
    def query_checksum(self, sql: str) -> ResultChecksum | None:
        """The same with a checksum; None if there is no result set."""

    def close(self) -> None:
        return None


class Target(ABC):
    """What statements run on. It is sent to executors, so it holds settings and no connection."""

    @abstractmethod
    def connect(self) -> Connection: ...

    def settings(self) -> dict[str, str]:
        """S8."""
        return {}

    def version(self) -> str:
        return ""


def cell_size(v) -> int:
    """X16 for a value of a driver."""
    import datetime

    if v is None:
        return 0
    if isinstance(v, (bytes, bytearray, memoryview)):
        return len(v)
    if isinstance(v, (bool, int, float)):
        return 8
    if isinstance(v, (datetime.datetime, datetime.date)):
        return 26
    if isinstance(v, datetime.timedelta):
        hours = int(abs(v.total_seconds()) // 3600)
        return max(2, len(str(hours))) + 13 + (v.total_seconds() < 0)
    return len(str(v).encode())


def row_digest(row: Iterable) -> int:
    """A hash of a row's cells with their types."""
    import xxhash

    h = xxhash.xxh64()
    for v in row:
        if v is None:
            h.update(b"n")
        elif isinstance(v, float):
            h.update(b"f" + struct.pack("<d", v))
        elif isinstance(v, int):
            h.update(b"i" + str(int(v)).encode() + b";")
        else:
            data = bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else str(v).encode()
            h.update(b"b" + struct.pack("<Q", len(data)) + data)
    return h.intdigest()


def checksum_rows(rows: Iterable, columns: list[str]) -> ResultChecksum:
    """Sum, exclusive or and number of the rows' hashes, in any order, with the names of columns."""
    import xxhash

    n = size = total = mixed = 0
    for row in rows:
        d = row_digest(row)
        n, size, total, mixed = n + 1, size + sum(map(cell_size, row)), (total + d) % (1 << 64), mixed ^ d
    return ResultChecksum(n, xxhash.xxh64_intdigest(struct.pack("<QQQ", n, total, mixed) + "\0".join(columns).encode()), columns, size)


class MockTarget(Target):
    """A target without a server: a comment ``/* mock: ... */`` in a statement says what becomes of it.

    ``fails`` is an error, ``hangs up`` one that ends the connection; ``bytes=n`` is the size of the result, which is else that of the text;
    ``row=x`` is its one row, and with ``no result`` there is none.
    """

    def __init__(self, latency_s: float = 0.0, connects: bool = True):
        self.latency_s, self.connects = latency_s, connects

    def connect(self) -> Connection:
        if not self.connects:
            raise TargetError("mock connection refused", True)
        return _MockConnection(self.latency_s)


class _MockConnection(Connection):
    def __init__(self, latency_s: float):
        self.latency_s = latency_s

    @staticmethod
    def _told(sql: str) -> dict[str, str]:
        said = re.search(r"/\* mock: (.*?) \*/", sql)
        return dict((x.strip().split("=", 1) + [""])[:2] for x in said[1].split(",")) if said else {}

    def query(self, sql: str) -> int:
        if self.latency_s:
            time.sleep(self.latency_s)
        told = self._told(sql)
        for mark, fatal in (("hangs up", True), ("fails", False)):
            if mark in told:
                raise TargetError(f"mock {'fatal ' if fatal else ''}error", fatal)
        return int(told.get("bytes") or len(sql.encode()))

    def query_checksum(self, sql: str) -> ResultChecksum | None:
        size, told = self.query(sql), self._told(sql)
        return None if "no result" in told else replace(checksum_rows([(told.get("row") or "row",)], ["c"]), size=size)


class DbApiTarget(Target):
    """Any database with a Python driver: ``connect`` makes a connection as its driver has it; ``fatal`` tells which errors end one."""

    def __init__(self, connect: Callable[[], object], fatal: Callable[[Exception], bool] = lambda e: False, batch: int = 1000):
        self.make, self.fatal, self.batch = connect, fatal, batch

    def connect(self) -> Connection:
        try:
            return _DbApiConnection(self.make(), self.fatal, self.batch)
        except Exception as e:
            raise TargetError(str(e), True) from e


class _DbApiConnection(Connection):
    def __init__(self, raw, fatal, batch: int):
        self.raw, self.fatal, self.batch = raw, fatal, batch

    def _rows(self, sql: str) -> tuple[list[str] | None, Iterator]:
        cursor = self.raw.cursor()
        cursor.execute(sql)
        names = [c[0] for c in cursor.description] if cursor.description else None
        return names, (row for rows in iter(lambda: cursor.fetchmany(self.batch), []) for row in rows) if names is not None else iter(())

    def query(self, sql: str) -> int:
        try:
            return sum(cell_size(v) for row in self._rows(sql)[1] for v in row)
        except Exception as e:
            raise TargetError(str(e), self.fatal(e)) from e

    def query_checksum(self, sql: str) -> ResultChecksum | None:
        try:
            names, rows = self._rows(sql)
            return None if names is None else checksum_rows(rows, names)
        except Exception as e:
            raise TargetError(str(e), self.fatal(e)) from e

    def close(self) -> None:
        self.raw.close()


#: What of a MySQL server's settings a report keeps, and the names under which servers have the isolation level.
SETTINGS, ISOLATION = ("sql_mode", "character_set_server", "collation_server", "innodb_buffer_pool_size"), ("transaction_isolation", "tx_isolation")


#: Python drivers that connect alike, and the codes of errors after which a connection is gone.
DRIVERS, LOST = ("pymysql", "MySQLdb", "mysql.connector"), (1053, 2006, 2013, 2055, 4031)


class _MySqlConnect:
    """Makes connections to the server of a URL; the driver is looked for where the connection is made."""

    def __init__(self, url: str):
        from urllib.parse import unquote, urlsplit

        scheme, _, rest = url.partition("://")
        account, at, place = rest.partition("/")[0].rpartition("@")  # a password may have an @
        user, _, password = account.partition(":")
        parts = urlsplit(f"{scheme}://{place}")
        if scheme != "mysql" or not parts.hostname:
            raise ValueError(f"not a MySQL URL: {redact_url_text(url)}")
        database = unquote(urlsplit(f"{scheme}://x/{rest.partition('/')[2]}").path.strip("/"))
        self.settings = {"host": parts.hostname, "port": parts.port or 3306, "user": unquote(user) if at else "", "password": unquote(password)} | ({"database": database} if database else {})

    def __call__(self):
        import importlib

        for name in DRIVERS:
            try:
                driver = importlib.import_module(name)
            except ModuleNotFoundError:
                continue
            made = driver.connect(**self.settings)
            with contextlib.suppress(Exception):
                made.autocommit(True)
            return made
        raise TargetError("no Python driver for MySQL: " + ", ".join(DRIVERS), True)


class MySqlTarget(DbApiTarget):
    """A MySQL or MariaDB server by any driver that makes connections as Python's database interface has them."""

    @classmethod
    def at(cls, url: str) -> MySqlTarget:
        """The server of ``mysql://user:password@host:port/database``, by whichever driver there is."""
        return cls(_MySqlConnect(url), lambda e: bool(e.args) and e.args[0] in LOST)

    def _variable(self, cursor, name: str) -> str | None:
        cursor.execute(f"SHOW VARIABLES LIKE '{name}'")
        found = [str(value) for key, value in cursor.fetchall() if key == name]
        return found[0] if found else None

    def settings(self) -> dict[str, str]:
        """The isolation level under one name, whichever the server has."""
        raw = self.make()
        try:
            cursor = raw.cursor()
            found = {n: self._variable(cursor, n) for n in SETTINGS}
            found["transaction_isolation"] = next((v for n in ISOLATION if (v := self._variable(cursor, n)) is not None), None)
            return {k: v for k, v in found.items() if v is not None}
        finally:
            raw.close()

    def version(self) -> str:
        raw = self.make()
        try:
            cursor = raw.cursor()
            cursor.execute("SELECT VERSION()")
            return str(cursor.fetchone()[0])
        finally:
            raw.close()


def descriptors_left(connections: int, spare: int = 32) -> str | None:
    """A warning if the process may not open ``connections`` and ``spare`` more files."""
    import resource

    limit = resource.getrlimit(resource.RLIMIT_NOFILE)[0]
    if limit == resource.RLIM_INFINITY or limit >= connections + spare:
        return None
    return f"{connections} connections need {connections + spare} file descriptors; the limit is {limit}"


class DuckDbTarget(DbApiTarget):
    """A DuckDB database, in memory or a file opened read-only; ``setup`` runs on each connection."""

    def __init__(self, path: str = ":memory:", setup: tuple[str, ...] = ()):
        def connect():
            import duckdb

            raw = duckdb.connect(path, read_only=path != ":memory:")
            for sql in setup:
                raw.execute(sql)
            return raw

        super().__init__(connect)

    def version(self) -> str:
        import duckdb

        return f"DuckDB {duckdb.__version__}"


class SparkSqlTarget(Target):
    """The session itself. Tasks have no session, so its events run on threads of the driver."""

    on_driver = True

    def __init__(self, spark):
        self.spark = spark

    def connect(self) -> Connection:
        return _SparkConnection(self.spark.newSession())

    def settings(self) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.sql("SET").collect()}

    def version(self) -> str:
        return f"Spark {self.spark.version}"


class _SparkConnection(Connection):
    def __init__(self, spark):
        self.spark = spark

    def _frame(self, sql: str):
        try:
            return self.spark.sql(sql)
        except Exception as e:
            raise TargetError(str(e).strip().splitlines()[0]) from e

    def query(self, sql: str) -> int:
        return self._read(sql).size

    def query_checksum(self, sql: str) -> ResultChecksum | None:
        return self._read(sql)

    def _read(self, sql: str) -> ResultChecksum:
        df = self._frame(sql)
        try:
            return checksum_rows(df.toLocalIterator(), df.columns)
        except TargetError:
            raise
        except Exception as e:
            raise TargetError(str(e).strip().splitlines()[0]) from e


@dataclass(frozen=True)
class Options:
    max_connections: int = 50
    allow_writes: bool = False
    db_override: str | None = None
    speed: float | None = None  # None: as fast as it goes
    checksum: bool = False
    pool: int | None = None
    warmup: bool = False
    repeat: int = 1
    filters: ev.Filters = ev.Filters()
    window_text: str | None = None
    abort_uri: str | None = None  # a file whose presence stops the replay
    read_only: bool = False  # said so; it holds unless writes are allowed

    @property
    def speed_label(self) -> str:
        return "max" if self.speed is None else repr(float(self.speed)).removesuffix(".0")


def parse_speed(text: str) -> float | None:
    """``max``, which is as fast as it goes, or a positive factor."""
    if text.lower() == "max":
        return None
    try:
        speed = float(text)
    except ValueError:
        speed = -1.0
    if not 0 < speed < float("inf"):
        raise ValueError(f"a speed is max or a positive number, not {text!r}")
    return speed


class _Abort:
    """Looks for the file now and then."""

    def __init__(self, uri: str | None):
        self.uri, self.next, self.found = uri, 0.0, False

    def __call__(self) -> bool:
        if self.uri and not self.found and time.monotonic() >= self.next:
            from pyarrow import fs

            files, path = fs.FileSystem.from_uri(self.uri)
            self.found = files.get_file_info(path).type != fs.FileType.NotFound
            self.next = time.monotonic() + 0.2
        return self.found


class _Connections:
    """Connections with the database each is in: one for each session, or a pool of them."""

    def __init__(self, target: Target, pool: int | None):
        self.target, self.idle = target, queue.Queue()
        for _ in range(pool or 0):
            self.idle.put(None)

    def take(self):
        held = self.idle.get()
        return held or [self.target.connect(), None]

    def give(self, held) -> None:
        self.idle.put(held)


def run_sessions(sessions: Iterable[tuple[int, list[dict]]], target: Target, options: Options, which: int, start: float, threads: int) -> Iterator[dict]:
    """Rows of ``schemas.EXEC_LOG`` for sessions, ``threads`` of them at a time. ``start``: the clock at which the first event is due."""
    abort, out = _Abort(options.abort_uri), queue.Queue(4096)  # rows leave as they come
    pool = _Connections(target, options.pool) if options.pool else None
    stay = options.db_override is not None or pool is not None

    def row(e: dict, outcome: str, **more) -> dict:
        return {"pass": which, "ordinal": e["ordinal"], "session_id": e["session_id"], "fingerprint_id": e["fingerprint_id"], "outcome": outcome, "due_us": e.get("due_us")} | more

    def execute(held: list, e: dict) -> tuple[dict, bool]:
        """The row, and whether the connection is lost."""
        db = options.db_override or e["db"]
        at = round((time.time() - start) * 1e6)
        try:
            if db and held[1] != db:
                try:
                    held[0].query("USE `" + db.replace("`", "``") + "`")
                except TargetError as x:
                    raise TargetError(f"USE `{db}`: {x}", x.fatal) from x
                held[1] = db
            began = time.perf_counter()
            if options.checksum and sqltext.classify_text(e["query"]) == "read":
                got = held[0].query_checksum(e["query"])
                more = {"result_bytes": got.size, "digest": Decimal(got.digest), "digest_rows": got.rows, "columns": got.columns} if got else {"result_bytes": 0}
            else:
                more = {"result_bytes": held[0].query(e["query"])}
            return row(e, "ok", latency_us=max(1, round((time.perf_counter() - began) * 1e6)), start_us=at, **more), False
        except TargetError as x:
            return row(e, "error", error=truncate_bytes(str(x)), start_us=at), x.fatal

    def session(events: list[dict]) -> Iterator[dict]:
        runs = [(options.allow_writes or sqltext.classify_text(e["query"]) == "read") and not (stay and sqltext.is_use_text(e["query"])) for e in events]
        own = None
        for i, (e, goes) in enumerate(zip(events, runs, strict=True)):
            if not goes:
                yield row(e, "skipped")
                continue
            while e.get("due_us") is not None and options.speed and not abort() and (wait := start + e["due_us"] / 1e6 - time.time()) > 0:
                time.sleep(min(wait, 0.2))
            lost = abort()
            if lost:
                yield row(e, "not_run")
            else:
                try:
                    held = pool.take() if pool else own or [target.connect(), None]
                except TargetError as x:
                    if pool:
                        pool.give(None)
                    yield {"pass": which, "session_id": e["session_id"], "outcome": "connect_failure", "error": truncate_bytes(str(x))}
                    yield row(e, "not_run")
                    held, lost = None, pool is None
                if held:
                    own = held
                    done, gone = execute(held, e)
                    yield done
                    if pool:
                        pool.give(None if gone else held)
                    lost = gone and not pool  # a pooled session goes on, on another connection
            if lost:
                yield from (row(x, "not_run") for x in events[i + 1 :])
                break
        if own and not pool:
            own[0].close()

    def feed() -> None:
        room = threading.Semaphore(2 * threads)
        try:
            with ThreadPoolExecutor(threads) as workers:

                def one(events):
                    try:
                        for done in session(events):
                            out.put(done)
                    except BaseException as x:
                        out.put(x)
                    finally:
                        room.release()

                for _, events in sessions:
                    room.acquire()
                    workers.submit(one, events)
        except BaseException as x:
            out.put(x)
        out.put(None)

    feeder = threading.Thread(target=feed, daemon=True)
    feeder.start()
    while (got := out.get()) is not None:
        if isinstance(got, BaseException):
            raise got
        yield got


def _grouped(rows: Iterable[dict]) -> Iterator[tuple[int, list[dict]]]:
    """Sessions of rows that come session by session."""
    events: list[dict] = []
    for r in rows:
        if events and events[-1]["session_id"] != r["session_id"]:
            yield events[0]["session_id"], events
            events = []
        events.append(r)
    if events:
        yield events[0]["session_id"], events


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(n) for r in rows], LOG_TYPES[t]) for n, t in LOG_FIELDS], [n for n, _ in LOG_FIELDS])


def _once(marks: str, which: int, partition: int) -> None:
    """Fails if the partition's sessions may have run before: an executor that is lost may have executed their writes."""
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(marks)
    path = f"{folder}/pass-{which}-partition-{partition}"
    if files.get_file_info(path).type != fs.FileType.NotFound:
        raise RuntimeError(f"the sessions of partition {partition} have been started before; with writes allowed they are not run again")
    files.create_dir(folder, recursive=True)
    files.open_output_stream(path).close()


def _task(target: Target, options: Options, which: int, start: float, connections: int, parts: int, marks: str | None):
    def task(batches):
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        if marks:
            _once(marks, which, partition)
        threads = max(1, connections // parts + (partition < connections % parts))  # all of them together are ``connections``
        rows: list[dict] = []
        events = (r for b in batches for r in b.to_pylist())
        for r in run_sessions(_grouped(events), target, replace(options, pool=threads) if options.pool else options, which, start, threads):
            rows.append(r)
            if len(rows) == 2000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return task


def spool(events: DataFrame, options: Options) -> DataFrame:
    """The events to replay with their due times. A session in which nothing runs is there to be counted; it never connects."""
    kept = options.filters.apply(events)
    kept = ev.due_offsets(kept, options.speed) if options.speed else kept.withColumn("due_us", F.lit(None).cast("long"))
    return kept.select("ordinal", "session_id", "db", "query", "fingerprint_id", "due_us")


def _from_driver(spark, rows: Iterator[dict], path: str) -> DataFrame:
    """Writes a log that comes on the driver, some rows at a time."""
    import itertools

    first = True
    while (some := list(itertools.islice(rows, DRIVER_ROWS))) or first:
        table = pa.Table.from_batches([_batch(some)]) if some else _batch([]).schema.empty_table()
        spark.createDataFrame(table).write.mode("append").parquet(path)
        first = False
    return spark.read.schema(schemas.EXEC_LOG).parquet(path)


def run_pass(events: DataFrame, target: Target, options: Options, which: int = 0) -> DataFrame:
    """One pass over all sessions; returns its log, which is written.

    Connections are shared out among partitions: ``max_connections`` of them at a time at most, however many cores there are.
    """
    spark = events.sparkSession
    spooled = spool(events, options)
    connections = options.pool or options.max_connections
    if getattr(target, "on_driver", False):
        rows = (r.asDict() for r in spooled.orderBy("session_id", "ordinal").toLocalIterator(prefetchPartitions=True))
        return _from_driver(spark, run_sessions(_grouped(rows), target, options, which, time.time(), connections), shared_path(spark, "exec-log"))
    parts = max(1, min(spark.sparkContext.defaultParallelism, connections))
    dealt = spooled.repartition(parts, "session_id").sortWithinPartitions("session_id", "ordinal")
    marks = shared_path(spark, "started") if options.allow_writes else None
    marks = f"file://{marks}" if marks and "://" not in marks and marks.startswith("/") else marks
    return written(dealt.mapInArrow(_task(target, options, which, time.time() + (1.0 if options.speed else 0.0), connections, parts, marks), schemas.EXEC_LOG), "exec-log")


def abort_file(spark) -> str:
    """A path for ``Options.abort_uri``: the replay stops once a file is there."""
    return shared_path(spark, "abort")
