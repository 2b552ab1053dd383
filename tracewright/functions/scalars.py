"""Scalar functions of reports and comparisons, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decades of result sizes, each up to and without its bound.
SIZE_BOUNDS = (1 << 10, 10 << 10, 100 << 10, 1 << 20, 10 << 20, 100 << 20)
SIZE_LABELS = ("<1KB", "1KB-10KB", "10KB-100KB", "100KB-1MB", "1MB-10MB", "10MB-100MB", ">=100MB")


def size_index(size: Column) -> Column:
    """the decade of a result size, from 0."""
    out = F.when(size < SIZE_BOUNDS[0], 0)
    for i, bound in enumerate(SIZE_BOUNDS[1:], 1):
        out = out.when(size < bound, i)
    return out.otherwise(len(SIZE_BOUNDS))


def size_label(size: Column) -> Column:
    return F.get(F.array(*map(F.lit, SIZE_LABELS)), size_index(size))


def label_index(label: Column) -> Column:
    """The decade of a label; labels that are unknown come last."""
    known = F.array_position(F.array(*map(F.lit, SIZE_LABELS)), label)
    return F.when(known > 0, known - 1).otherwise(len(SIZE_LABELS))


def pct_change(base: Column, cand: Column) -> Column:
    """Change in percent, null if there is no base."""
    return F.when(base > 0, (cand - base) / base * 100)


def metric_delta(base: Column, cand: Column) -> Column:
    """X8."""
    b, c = base.cast("double"), cand.cast("double")
    return F.struct(b.alias("baseline_us"), c.alias("candidate_us"), (c - b).alias("delta_us"), pct_change(b, c).alias("delta_pct"))


def server_family(version: Column) -> Column:
    """F11."""
    return F.when(version == "", None).when(version.contains("MariaDB"), "MariaDB").when(version.isNotNull(), "MySQL")


def display_version(version: Column, latency_source: Column) -> Column:
    """without the compatibility prefix that MariaDB servers send."""
    return F.when(version != "", F.regexp_replace(version, "^5\\.5\\.5-(?=[\\s\\S]*MariaDB)", "")).when(latency_source == "recorded-slow-log", "recorded (slow log)").otherwise("unknown")


def fmt_bytes(size: Column) -> Column:
    """X11. Ties round to even."""
    b = size.cast("double")
    unit = lambda n, name: F.concat(F.format_string("%.1f", F.bround(b / float(n), 1)), F.lit(name))
    return F.when(b < 1 << 10, F.concat(F.format_string("%.0f", F.bround(b, 0)), F.lit("B"))).when(b < 1 << 20, unit(1 << 10, "KB")).when(b < 1 << 30, unit(1 << 20, "MB")).otherwise(unit(1 << 30, "GB"))


def fmt_ms(us: Column) -> Column:
    """X12."""
    return F.format_string("%.3f", us.cast("double") / 1000)


def fmt_pct(pct: Column) -> Column:
    """X12. Ties round to even."""
    # Ten times the value is tenths + low exactly, so that 0.25 is a tie and 0.15, which lies below, is none.
    p = pct.cast("double")
    tenths = p * 8 + p * 2
    low = p * 2 - (tenths - p * 8)
    near = F.rint(tenths)
    near = F.when((F.abs(tenths - near) == 0.5) & (low != 0), tenths + F.signum(low) / 2).otherwise(near)
    return F.when(p.isNull(), "n/a").otherwise(F.format_string("%+.1f%%", F.when(F.abs(p) < 1 << 50, near / 10).otherwise(p)))


def truncate_chars(s: Column, n: int) -> Column:
    """X13."""
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def truncate_bytes(s: str | None, n: int = 300) -> str | None:
    """``n`` bytes at most, cut between characters."""
    data = (s or "").encode()
    return s if s is None or len(data) <= n else data[:n].decode("utf-8", "ignore") + "…"


def redact_url(url: Column) -> Column:
    """The password of a URL's user is masked."""
    return F.regexp_replace(url, r"^([\s\S]*?://[^/?#:@]*):[^/?#]*@", "$1:***@")


def redact_url_text(url: str) -> str:
    """X15 for a text."""
    return re.sub(r"^([\s\S]*?://[^/?#:@]*):[^/?#]*@", r"\1:***@", url)


def escape_html(s: Column) -> Column:
    """X28."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(ref))
    return s


def rfc3339(us: Column) -> Column:
    """The fraction only if there is one, without trailing zeros."""
    t = F.timestamp_micros(us)
    whole, part = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.pmod(us, F.lit(1_000_000))
    return F.concat(whole, F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(part.cast("string"), 6, "0"), "0+$", ""))), F.lit("Z"))


def time_micros(value: Column) -> Column:
    """A time of a slow log, with its zone or as YYMMDD HH:MM:SS in UTC, as microseconds."""
    v = F.trim(value)
    zoned = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.unix_micros(F.try_to_timestamp(v)))
    old = F.when(v.rlike(r"^\d{6}\s+\d{1,2}:\d{1,2}:\d{1,2}(?:\s|$)"), F.unix_micros(F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_replace(F.regexp_extract(v, r"^\d{6}\s+\d{1,2}:\d{1,2}:\d{1,2}", 0), r"\s+", " ")), F.lit("yyyyMMdd H:m:s"))))
    return F.when(v.contains("T"), zoned).otherwise(old)


def set_timestamp_micros(line: Column) -> Column:
    """X18."""
    v = F.trim(F.regexp_replace(F.regexp_extract(line, r"(?is)^set timestamp=(.+)$", 1), ";+$", ""))
    return F.round(v.try_cast("double") * 1e6).cast("long")


def use_target(line: Column) -> Column:
    """The database of a ``use`` line; a bare name has no white space."""
    rest = F.regexp_replace(F.trim(F.regexp_extract(line, r"(?is)^use (.+)$", 1)), r"\s*;+\s*$", "")
    quoted = F.replace(F.regexp_extract(rest, r"(?s)^`(.*)`$", 1), F.lit("``"), F.lit("`"))
    name = F.when(rest.rlike(r"(?s)^`.*`$"), quoted).when(~rest.rlike(r"\s"), rest)
    return F.when(name != "", name)


def header_value(line: Column, key: str) -> Column:
    """The value after ``key:`` on a header line, null if the next word is a key itself."""
    return F.nullif(F.regexp_extract(line, rf"(?:^|\s){key}:\s+(\S*[^\s:])(?=\s|$)", 1), F.lit(""))


def header_user(rest: Column) -> Column:
    """The user of a User@Host line, after its label."""
    before = F.trim(F.regexp_extract(rest, r"^[^@]*", 0))
    user = F.when(before.startswith("["), F.regexp_extract(before, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(before, r"^[^\[]*", 0))
    return F.nullif(user, F.lit(""))


def header_thread(rest: Column) -> Column:
    """The number after the last ``Id:``."""
    return F.regexp_extract(rest, r"(?s)^.*Id:\s*(\S+)", 1).try_cast("long")


def value_bytes(c: Column, kind: str) -> Column:
    """The size of a cell by its type."""
    if kind in ("string", "binary") or kind.startswith("decimal"):
        size = F.octet_length(c.cast("string") if kind.startswith("decimal") else c)
    elif kind in ("float",):
        size = F.lit(4)
    elif kind.startswith(("timestamp", "date")):
        size = F.lit(26)
    elif kind.startswith("interval"):
        seconds = c.cast("long")
        hours = F.floor(F.abs(seconds) / 3600)
        size = F.greatest(F.length(hours.cast("string")), F.lit(2)) + 13 + F.when(seconds < 0, 1).otherwise(0)
    else:
        size = F.lit(8)
    return F.when(c.isNull(), 0).otherwise(size).cast("long")


def string_literal(s: Column) -> Column:
    """A text as a quoted literal."""
    for raw, out in (("\\", "\\\\"), ("'", "''"), ("\0", "\\0"), ("\n", "\\n"), ("\r", "\\r"), ("\x1a", "\\Z")):
        s = F.replace(s, F.lit(raw), F.lit(out))
    return F.concat(F.lit("'"), s, F.lit("'"))


def bytes_literal(b: Column) -> Column:
    """Bytes as a text literal if they are UTF-8, else in hex."""
    text = F.try_validate_utf8(b.cast("string"))
    return F.when(text.isNotNull(), string_literal(text)).otherwise(F.concat(F.lit("X'"), F.hex(b), F.lit("'")))
