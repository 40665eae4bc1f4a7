"""Scalar functions: search terms, names, identities, globs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TERM_SPLIT = "[^a-z0-9_./:@-]+"


def terms(query: str) -> list[str]:
    """Distinct search terms of a query, in order of appearance (Q1)."""
    return list(dict.fromkeys(t for t in re.split(TERM_SPLIT, query.lower()) if t))


def score(label: Column, wanted: list[str]) -> Column:
    """100 for each term that is the whole label, 20 for each that it holds (Q1)."""
    low = F.lower(label)
    total = F.lit(0)
    for t in wanted:
        total = total + F.when(low == t, 100).when(F.contains(low, F.lit(t)), 20).otherwise(0)
    return total


def bare_name(name: Column) -> Column:
    """Lower-case letters and digits of a name only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def name_tokens(name: Column) -> Column:
    """Parts of a camelCase or snake_case name, lower-cased, in the singular."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    parts = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")
    cut = lambda x: F.when((x != "status") & F.endswith(x, F.lit("s")), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    return F.transform(parts, lambda x: F.when(x == "statuses", "status").when(x == "categories", "category").otherwise(cut(x)))


def content_id(prefix: str, *parts: Column, digits: int = 24) -> Column:
    """``prefix:`` and the first hex digits of a hash over the parts."""
    return F.concat(F.lit(f"{prefix}:"), F.left(F.sha2(F.concat_ws("\u0000", *parts), 256), F.lit(digits)))


def canonical_json(*columns: str) -> Column:
    """JSON of the columns with sorted keys, absent for null; control characters in lower-case hex."""
    return F.regexp_replace(F.to_json(F.struct(*sorted(columns))), "\\\\u00([01])([A-F])", "\\\\u00$1$2")


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """NFC of a string; there is no built-in function for it."""
    return values.str.normalize("NFC")


def glob_regex(glob: str) -> str:
    """The regular expression of a path glob: ``*`` and ``?`` within a segment, ``**`` over segments."""
    parts = glob.split("/")
    parts = [p for i, p in enumerate(parts) if p != "**" or i == 0 or parts[i - 1] != "**"]
    if parts == ["**"]:
        return "^.*$"
    out, joined = "", True  # joined: no slash is due before the next part
    for i, p in enumerate(parts):
        if p == "**":
            out += "(?:[^/]+/)*" if i == 0 else "(?:/.*)?" if i == len(parts) - 1 else "(?:/[^/]+)*"
            joined = i == 0
            continue
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p)
        out += ("" if joined else "/") + body
        joined = False
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def at_or_below(path: Column, root: Column) -> Column:
    """Whether a path is ``root`` or lies below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def prefixes(path: Column) -> Column:
    """All directories of a path and itself: ``a``, ``a/b``, ``a/b/c``; makes prefix joins equi joins."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


_DEVICE = "(?i)^(?:con|prn|aux|nul|com[0-9\u00b9\u00b2\u00b3]|lpt[0-9\u00b9\u00b2\u00b3]|conin[$]|conout[$])(?:[.].*)?$"


def normal_path(path: Column) -> Column:
    """A path below the target with single forward slashes; null if it is absolute, has dot segments or is not portable (P5).

    Names that are not NFC are to be passed through :func:`nfc` first.
    """
    slashed = F.regexp_replace(path, "\\\\", "/")
    plain = F.regexp_replace(F.regexp_replace(slashed, "/+", "/"), "/$", "")
    bad = path.isNull() | (path == "") | path.rlike("[:\u0000]") | F.startswith(slashed, F.lit("/")) | F.exists(F.split(slashed, "/"), lambda s: s.isin(".", "..") | s.rlike("[. ]$") | s.rlike(_DEVICE))
    return F.when(~bad, plain)


def terminal_safe(value: Column) -> Column:
    """A text with control and direction characters as ``\\uXXXX`` (P19); only characters that occur cost a pass."""
    codes = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0), 0x061C, 0x200E, 0x200F, 0x2028, 0x2029, *range(0x202A, 0x202F), *range(0x2066, 0x206A)]
    kind = "[" + "".join(f"\\x{{{c:x}}}" for c in codes) + "]"
    each = F.transform(F.split(value, ""), lambda c: F.when(c.rlike(kind), F.concat(F.lit("\\u"), F.lpad(F.hex(F.unhex(F.hex(F.encode(c, "UTF-16BE")))), 4, "0"))).otherwise(c))
    return F.when(value.rlike(kind), F.array_join(each, "")).otherwise(value)


def guard_fragment(sql_text: Column) -> Column:
    """A piece of SQL without comments, in lower case with single blanks, literals as ``?`` (guard fragments, 2.8)."""
    bare = F.regexp_replace(F.regexp_replace(sql_text, "/[*](?s:.*?)[*]/", " "), "--[^\n]*", " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(bare, "'(?:[^']|'')*'", "?")), "\\s+", " "))


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and match of all leftmost matches, as an array (2.8)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(found)).alias("p"), found.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def line_column(text: Column, offset: Column) -> Column:
    """line and column, from 1, of an offset (2.8)."""
    head = F.substr(text, F.lit(1), offset)
    line = F.length(head) - F.length(F.regexp_replace(head, "\n", "")) + 1
    return F.struct(line.alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).alias("column"))


def expand_braces(glob: str) -> list[str]:
    """The globs that the first-level braces of a glob stand for, innermost first (2.8)."""
    m = re.search(r"\{([^{}]*)\}", glob)
    if not m:
        return [glob]
    return list(dict.fromkeys(g for part in m[1].split(",") for g in expand_braces(glob[: m.start()] + part + glob[m.end() :])))
