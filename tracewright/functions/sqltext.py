"""SQL text as data: query classes, read/write gate and determinism.

The same patterns serve two forms. The column form (``fingerprint``, ``classify``, ...) stays in the JVM and is what plans use. The
Python form (``fingerprint_text``, ...) serves drivers, sources written in Python, and tests, which hold the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, and all that is trimmed at the ends.
WHITE = r" \t\n\f\r"
ENDS = WHITE + r"\x0B\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

STRING = r"'(?:[^'\\]++|\\[\s\S]?+|'')*+(?:'|\z)|\"(?:[^\"\\]++|\\[\s\S]?+|\"\")*+(?:\"|\z)"
BACKTICK = r"`(?:[^`]++|``)*+(?:`|\z)"
BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
#: Up to the end of the line; two dashes need white space, or the end, after them.
LINE = rf"--(?=[{WHITE}]|\z)[^\n]*+|#[^\n]*+"
NUMBER = r"0[xX][0-9A-Fa-f]*+|(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+"
#: An identifier takes digits after it, and a point before a digit.
IDENT = r"[A-Za-z_$\u0080-\U0010FFFF][A-Za-z0-9_$\u0080-\U0010FFFF]*+(?:\.(?=[0-9]))?+"
TOKEN = rf"{STRING}|{BACKTICK}|{BLOCK}|{LINE}|[{WHITE}]++|{NUMBER}|{IDENT}|[^'\"`/\-#.0-9A-Za-z_$\u0080-\U0010FFFF{WHITE}]++|[\s\S]"
#: Stands for a number until signs are folded, so that the mark of a string is not taken for one.
MARK = "\x01"
#: A sign that cannot be a binary operator goes with its number.
SIGN = rf"((?:^|[(,=<>+\-*/%]) *)[-+] *{MARK}"
GROUP = r"\((?=[?, ]*\?)[?, ]*\)"
IN_LIST = rf"(?<![A-Za-z0-9_$`])in *{GROUP}"
VALUES_LIST = rf"(?<![A-Za-z0-9_$`])values *{GROUP}(?: *(?:, *)?{GROUP})*"

#: Quotes as the classifiers skip them: a backslash does not escape in backticks.
QUOTED = rf"{STRING}|{BACKTICK}"
#: A conditional comment is executed, so only its opening is inert.
CLASS_TOKEN = rf"{QUOTED}|/\*![0-9]*+|{BLOCK}|{LINE}|[{WHITE}]++|[A-Za-z_][A-Za-z0-9_$]*+|[^A-Za-z_'\"`/\-#;(){WHITE}]++|[\s\S]"
INERT = rf"^(?:/\*|--(?:[{WHITE}]|$)|#|[{WHITE}])"
WORD = r"^[A-Za-z_]"

#: What makes a result differ between two runs on the same data.
VOLATILE_CALLS = ("now", "sysdate", "curdate", "curtime", "rand", "uuid", "uuid_short", "last_insert_id", "connection_id", "found_rows", "row_count", "benchmark", "get_lock", "release_lock", "is_free_lock", "is_used_lock", "version", "sleep")
VOLATILE_WORDS = ("current_timestamp", "current_date", "current_time", "localtime", "localtimestamp", "utc_timestamp", "utc_date", "utc_time", "information_schema", "performance_schema")
#: Fixed values of the read/write gate.
READ_VERBS, EXPLAIN_VERBS = ("show", "use", "help"), ("explain", "describe", "desc")
WRITE_SETS = ("global", "persist", "persist_only", "password", "default")
WRITE_VERBS = ("insert", "update", "delete", "replace")


def _java(pattern: str) -> str:
    """The pattern for the JVM, which writes code points beyond four digits otherwise."""
    return pattern.replace(r"\U0010FFFF", r"\x{10FFFF}")


def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"))


_TOKEN, _SIGN, _IN, _VALUES, _CLASS, _INERT, _QUOTED = map(_python, (TOKEN, SIGN, IN_LIST, VALUES_LIST, CLASS_TOKEN, INERT, QUOTED))
_LOWER = str.maketrans(UPPER, LOWER)
_ENDS = re.compile(f"[{ENDS}]").pattern


def fingerprint_text(sql: str) -> str:
    """The class of a statement: literals, comments, white space and case are normalized."""
    out: list[str] = []
    for m in _TOKEN.finditer(sql):
        t = m[0]
        c = t[0]
        if c in "'\"":
            out.append("?")
        elif c in " \t\n\f\r" or t.startswith("/*"):
            out.append(" ")
        elif c == "#" or (c == "-" and len(t) > 1):
            continue
        elif c.isascii() and (c.isdigit() or (c == "." and len(t) > 1)):
            out.append(MARK)
        elif t == "-" and m.end() == len(sql):
            out.append(t)
        else:
            out.append(t.translate(_LOWER))
    s = re.sub(" +", " ", "".join(out)).removeprefix(" ")
    s = _SIGN.sub(r"\1?", s).replace(MARK, "?")
    s = re.sub(rf"^{_ENDS}+|[;{ENDS}]+$", "", s)
    return _VALUES.sub("values (?+)", _IN.sub("in (?+)", s))


def _words(sql: str) -> tuple[list[tuple[str, int]], bool]:
    """(word, depth of parentheses) in order, and whether something follows a semicolon."""
    words, depth, ended = [], 0, False
    for m in _CLASS.finditer(sql):
        t = m[0]
        if _INERT.match(t) and not (t == "/" or t == "-"):
            continue
        if ended and t != ";":
            return words, True
        if t == ";":
            ended = True
        elif t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif re.match(WORD, t):
            words.append((t.translate(_LOWER), depth))
    return words, False


def classify_text(sql: str) -> str:
    """'read' if a statement is provably one, else 'write'."""
    words, several = _words(sql)
    if several or not words:
        return "write"

    def files(tail: list[tuple[str, int]]) -> str:
        names = [w for w, _ in tail]
        return "write" if any(a == "into" and b in ("outfile", "dumpfile") for a, b in zip(names, names[1:], strict=False)) else "read"

    def after_with(tail: list[tuple[str, int]]) -> str:
        at = next((i for i, (w, d) in enumerate(tail) if not d and w in ("select", *WRITE_VERBS)), None)
        return "write" if at is None or tail[at][0] != "select" else files(tail[at + 1 :])

    first, tail = words[0][0], words[1:]
    if first == "select":
        return files(tail)
    if first in READ_VERBS:
        return "read"
    if first in EXPLAIN_VERBS:
        if not tail or tail[0][0] != "analyze":
            return "read"
        at = next((i for i, (w, _) in enumerate(tail[1:], 1) if w not in ("format", "tree", "json")), None)
        if at is None:
            return "write"
        verb = tail[at][0]
        return files(tail[at + 1 :]) if verb in ("select", "table") else after_with(tail[at + 1 :]) if verb == "with" else "write"
    if first == "set":
        return "write" if tail and tail[0][0] in WRITE_SETS else "read"
    return after_with(tail) if first == "with" else "write"


def is_use_text(sql: str) -> bool:
    """Whether the first word is USE."""
    for m in _CLASS.finditer(sql):
        if re.match(WORD, m[0]):
            return m[0].lower() == "use"
    return False


def should_execute_text(sql: str, allow_writes: bool) -> bool:
    return allow_writes or classify_text(sql) == "read"


def is_nondeterministic_text(class_text: str) -> bool:
    """Whether results of a query class may differ between runs on the same data."""
    s = _QUOTED.sub("`", class_text)
    if "@@" in s:
        return True
    seen = set()
    for m in re.finditer(rf"([A-Za-z_][A-Za-z0-9_$]*)[{WHITE}]*(\([{WHITE}]*\)?)?", s):
        word, called = m[1], m[2]
        if word in VOLATILE_WORDS or (called and (word in VOLATILE_CALLS or (word == "unix_timestamp" and called.endswith(")")))):
            return True
        seen.add(word)
    return "limit" in seen and "order" not in seen


# --- the same as columns -----------------------------------------------------------------------------------------------


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fingerprint(sql: Column) -> Column:
    """X1 as a column."""
    tokens = F.regexp_extract_all(sql, F.lit(_java(TOKEN)), F.lit(0))
    long = lambda t: F.length(t) > 1
    mapped = lambda t: _let(  # by the code of the first character, as it is cheap to compare
        F.ascii(t),
        lambda c: F.when(c.isin(9, 10, 12, 13, 32) | ((c == 47) & long(t)), " ")
        .when(c.between(48, 57) | ((c == 46) & long(t)), MARK)
        .when(c.isin(34, 39), "?")
        .when((c == 35) | ((c == 45) & long(t)), "")
        .otherwise(_ascii_lower(t)),
    )
    parts = F.transform(tokens, mapped)
    s = F.regexp_replace(F.array_join(parts, ""), " +", " ")
    s = F.regexp_replace(F.regexp_replace(s, "^ ", ""), SIGN, "$1?")
    s = F.regexp_replace(F.translate(s, MARK, "?"), rf"^[{ENDS}]+|[;{ENDS}]+\z", "")
    return F.regexp_replace(F.regexp_replace(s, IN_LIST, "in (?+)"), VALUES_LIST, "values (?+)")


def _live(sql: Column) -> Column:
    """The tokens that the classifiers look at, in lower case."""
    tokens = F.regexp_extract_all(sql, F.lit(_java(CLASS_TOKEN)), F.lit(0))
    inert = lambda t: _let(F.ascii(t), lambda c: c.isin(9, 10, 12, 13, 32, 35) | (c.isin(45, 47) & (F.length(t) > 1)))
    return F.transform(F.filter(tokens, lambda t: ~inert(t)), _ascii_lower)


def _word_like(t: Column) -> Column:
    c = F.ascii(t)
    return c.between(97, 122) | (c == 95)


def _placed(tokens: Column) -> Column:
    """Words with their depth of parentheses."""
    empty = F.array().cast("array<struct<w:string,d:int>>")
    step = lambda s, t: F.struct(
        (s["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"),
        F.when(_word_like(t), F.concat(s["words"], F.array(F.struct(t.alias("w"), s["depth"].alias("d"))))).otherwise(s["words"]).alias("words"),
    )
    return F.aggregate(F.filter(tokens, lambda t: t.isin("(", ")") | _word_like(t)), F.struct(F.lit(0).alias("depth"), empty.alias("words")), step, lambda s: s["words"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used: columns have no names for parts of an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The first word, if nothing but white space and parentheses comes before it and it plainly ends.
FIRST_WORD = rf"^[{WHITE}(]*+([A-Za-z_][A-Za-z0-9_]*+)(?=[{WHITE}(;]|\z)"


def classify(sql: Column) -> Column:
    """X2 as a column: 'read' or 'write'. Most statements are decided by their first word; the others are taken apart."""
    whole = _let(_live(sql), lambda tokens: _let(_placed(tokens), lambda words: _class_of(tokens, words)))
    plain = ~sql.contains(";") & ~sql.contains("/*")

    def decide(first: Column) -> Column:
        doubtful = first.isin("", "with", "set", *EXPLAIN_VERBS)
        return (
            F.when(~doubtful & ~first.isin("select", *READ_VERBS), "write")
            .when(plain & first.isin(*READ_VERBS), "read")
            .when(plain & (first == "select") & ~F.lower(sql).contains("into"), "read")
            .otherwise(whole)
        )

    return _let(_ascii_lower(F.regexp_extract(sql, FIRST_WORD, 1)), decide)


def _class_of(tokens: Column, words: Column) -> Column:
    several = F.exists(F.slice(tokens, F.greatest(F.array_position(tokens, ";").cast("int"), F.lit(1)), F.size(tokens)), lambda t: t != ";") & F.array_contains(tokens, ";")
    word = lambda i: F.get(words, F.lit(i))["w"]
    names = lambda w: F.transform(w, lambda x: x["w"])
    rest = lambda w, n: F.slice(w, n, F.greatest(F.size(w), F.lit(1)))

    def files(w: Column) -> Column:
        pairs = lambda n: F.zip_with(n, rest(n, 2), lambda a, b: (a == "into") & b.isin("outfile", "dumpfile"))
        return F.when(_let(names(w), lambda n: F.exists(pairs(n), lambda x: F.coalesce(x, F.lit(False)))), "write").otherwise("read")

    def after_with(w: Column) -> Column:
        verb = lambda x: F.when((x["d"] == 0) & x["w"].isin("select", *WRITE_VERBS), x["w"]).otherwise(F.lit(""))

        def decide(verbs: Column) -> Column:
            at = F.coalesce(F.array_position(F.transform(verbs, lambda x: x != ""), True).cast("int"), F.lit(0))
            return F.when((at == 0) | (F.get(verbs, at - 1) != "select"), "write").otherwise(files(rest(w, at + 1)))

        return _let(F.transform(w, verb), decide)

    tail = rest(words, 2)

    def explained(at: Column) -> Column:
        verb, below = F.get(rest(words, 3), at - 1)["w"], rest(words, at + 3)
        return F.when(at == 0, "write").when(verb.isin("select", "table"), files(below)).when(verb == "with", after_with(below)).otherwise("write")

    skipped = F.transform(rest(words, 3), lambda x: ~x["w"].isin("format", "tree", "json"))
    analyzed = _let(F.coalesce(F.array_position(skipped, True).cast("int"), F.lit(0)), explained)
    return (
        F.when(several | (F.size(words) == 0), "write")
        .when(word(0) == "select", files(tail))
        .when(word(0).isin(*READ_VERBS), "read")
        .when(word(0).isin(*EXPLAIN_VERBS), F.when(F.coalesce(word(1) == "analyze", F.lit(False)), analyzed).otherwise("read"))
        .when(word(0) == "set", F.when(F.coalesce(word(1).isin(*WRITE_SETS), F.lit(False)), "write").otherwise("read"))
        .when(word(0) == "with", after_with(tail))
        .otherwise("write")
    )


def is_use(sql: Column) -> Column:
    """X4 as a column."""
    whole = F.coalesce(F.get(F.filter(_live(sql), _word_like), F.lit(0)) == "use", F.lit(False))
    return _let(_ascii_lower(F.regexp_extract(sql, FIRST_WORD, 1)), lambda first: F.when(first != "", first == "use").otherwise(whole))


def should_execute(sql: Column, allow_writes: bool) -> Column:
    """the write gate."""
    return F.lit(True) if allow_writes else classify(sql) == "read"


def is_nondeterministic(class_text: Column) -> Column:
    """X5 as a column."""
    name = lambda c: F.regexp_extract(c, r"^[A-Za-z0-9_$]+", 0)
    call = F.lit(rf"[A-Za-z_][A-Za-z0-9_$]*+[{WHITE}]*+(?:\([{WHITE}]*+\)?)?")

    def decide(found: Column) -> Column:
        volatile = F.exists(found, lambda x: x["w"].isin(*VOLATILE_WORDS) | (x["c"].contains("(") & (x["w"].isin(*VOLATILE_CALLS) | ((x["w"] == "unix_timestamp") & x["c"].endswith(")")))))
        word = lambda w: F.exists(found, lambda x: x["w"] == w)
        return volatile | (word("limit") & ~word("order"))

    bare = F.regexp_replace(class_text, _java(QUOTED), "`")
    return _let(bare, lambda s: s.contains("@@") | _let(F.transform(F.regexp_extract_all(s, call, F.lit(0)), lambda c: F.struct(name(c).alias("w"), c.alias("c"))), decide))


def _pandas(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return apply


def register(spark: SparkSession) -> None:
    """Registers ``sql_fingerprint``, ``sql_classify``, ``sql_is_use`` and ``is_nondeterministic`` for SQL."""
    for name, f, kind in (("sql_fingerprint", fingerprint_text, "string"), ("sql_classify", classify_text, "string"), ("sql_is_use", is_use_text, "boolean"), ("is_nondeterministic", is_nondeterministic_text, "boolean")):
        spark.udf.register(name, _pandas(f, kind))
