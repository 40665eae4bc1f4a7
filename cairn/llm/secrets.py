"""Secret scans with corpus-wide ownership frequency.

The base spans follow three fixed patterns.  The method proposes further
candidates: values of secret-like assignments, keys with well-known prefixes
and long mixed tokens.  Every candidate's value is hashed, and the hash is
counted over the whole corpus by distinct repositories and owners.  A value
that several owners have is a copied example, unless OWN_SHARE of the
repositories that hold it are one owner's (others may have copied from it); one
that is an owner's in this sense and that looks random is taken for a live
credential, and its span is added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Workspace

_WORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Base kinds in their order: pattern, group with the value, least length of it.
BASE = {
    "assign": (re.compile(f"({_WORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]{32,}"), 0, 32),
}
#: Further candidates of the method.
LOOSE = {
    "key": re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{30,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{4,}+)(?![A-Za-z0-9_-])"),
    "mixed": re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-]|\.[A-Za-z0-9+/_=-])"),
}
#: Assignments to names with such a word; of the value only padding holds '=', so values and names are read once each.
_NAMED = "pass|pwd|secret|token|key|cred|auth|private|signature"
_NAME = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)[\"']?\x20*+[:=]\x20*+[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9+/_-](?:[A-Za-z0-9+/_-]|\.(?=[A-Za-z0-9+/_-]))*+={0,2}(?![A-Za-z0-9+/_=-])")
_IS_NAMED = re.compile(f"(?i:{_NAMED})")
KINDS = [*BASE, *LOOSE, "named"]
#: A text without a match of this (RE2, so linear) has no candidate at all.
_ANY = f"(?:{_WORD})[\"']?\\x20*[:=]|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}|[A-Za-z0-9+/_-]{{24}}|gh[pousr]_|xox[abprs]-|sk-|eyJ|AIza|(?i:{_NAMED})[A-Za-z0-9_.-]*[\"']?\x20*[:=]"
#: Fewest bits per character of a live-looking value.
ENTROPY = 3.5
#: Share of the repositories of a value from which it counts as its main owner's.
OWN_SHARE = 0.9
#: Values that are sent to all executors; beyond that the join shuffles, with each value in SALTS parts.
BROADCAST_VALUES, SALTS = 500_000, 16
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,live:boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("live", pa.bool_())]))


def looks_live(value: str) -> bool:
    """Random enough for a credential: letters and digits, much entropy, no word like 'example'."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) or re.search("(?i)example|sample|placeholder|changeme|your|xxxx|0000|1234567", value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


def scan(text: str) -> tuple[list[dict], list[dict]]:
    """(base spans, further candidates) of a text, in order; places in code points, ends exclusive."""
    base, loose = [], []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                base.append((m.start(), rank, {"kind": kind, "start": m.start(), "end": m.end(), "value": m[group]}))
    for rank, (kind, pattern) in enumerate(LOOSE.items()):
        for m in pattern.finditer(text):
            loose.append((m.start(), rank, {"kind": kind, "start": m.start(), "end": m.end(), "value": m[0]}))
    for m in _NAME.finditer(text):
        if _IS_NAMED.search(m[1]) and (v := _VALUE.match(text, m.end())) and len(v[0]) >= 8:
            loose.append((v.start(), len(LOOSE), {"kind": "named", "start": v.start(), "end": v.end(), "value": v[0]}))
    out = []
    for found in (base, loose):
        found.sort(key=lambda x: x[:2])
        out.append([x | {"live": looks_live(x["value"]), "value": hashlib.sha256(x["value"].encode()).hexdigest()} for _, _, x in found])
    return out[0], out[1]


def candidates(docs: DataFrame, text: str, keep: dict[str, F.Column]) -> DataFrame:
    """The columns ``keep``, base and loose spans (with the hash of each value) of each row."""
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), f"base {_SPANS}", f"loose {_SPANS}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.large_string())
            hit = pc.fill_null(pc.match_substring_regex(column, _ANY), False).to_pylist()
            base: list[list[dict]] = [[] for _ in hit]
            loose: list[list[dict]] = [[] for _ in hit]
            for i, h in enumerate(hit):
                if h:
                    base[i], loose[i] = scan(column[i].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, _TYPE), pa.array(loose, _TYPE)], names=[*batch.schema.names[:-1], "base", "loose"])

    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners, top_repos) of every candidate's hash; top_repos are the repositories of its main owner.

    Distinct triples come first, so a value in a third of all rows shrinks to
    its repositories before anything is shuffled by value alone.
    """
    each = found.select("repo", "owner", F.explode(F.concat("base", "loose")).alias("x")).select(F.col("x.value").alias("value"), "repo", "owner").distinct()
    by_repo = each.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_repo.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.max("repos").alias("top_repos"))


def find_secrets(docs: DataFrame, text: str = "text", repo: F.Column | None = None, owner: F.Column | None = None, max_owners: int = 1) -> DataFrame:
    """doc_id, base spans and added spans (candidates of at most ``max_owners`` owners, or mainly of one, that look live) of each row.

    By default a document's repository is its source and language, its owner the
    source.  Null and empty texts have no spans; a null repository or owner is
    one of its own; repeated rows are each scanned and count once for ownership;
    an empty table gives no rows.
    """
    text_none = F.lit("")
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    store = Workspace(docs.sparkSession, "secrets")
    keep = {"doc_id": F.col("doc_id"), "repo": F.coalesce(repo.cast("string"), text_none), "owner": F.coalesce(owner.cast("string"), text_none)}
    found = store.save(candidates(docs, text, keep).withColumn("row", F.monotonically_increasing_id()), "found")
    whose = ownership(found).where((F.col("n_owners") <= max_owners) | (F.col("top_repos") >= OWN_SHARE * F.col("n_repos")))
    own = store.save(whose.select(F.col("value").alias("own")), "own")
    loose = found.where(F.size("loose") > 0).select("row", F.explode("loose").alias("x")).where("x.live")
    if own.count() <= BROADCAST_VALUES:
        live = loose.join(F.broadcast(own), F.col("x.value") == F.col("own"), "left_semi")
    else:
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        live = loose.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(own, (F.col("x.value") == F.col("own")) & (F.col("salt") == F.col("part")), "left_semi")
    added = live.groupBy("row").agg(F.collect_list("x").alias("added"))
    return found.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(_SPANS)).alias("added"))


def _render(spans: F.Column) -> F.Column:
    place = F.create_map(*(v for i, k in enumerate(KINDS) for v in (F.lit(k), F.lit(i))))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), place[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def secrets_query(docs: DataFrame) -> DataFrame:
    """The digest columns of op5."""
    found = find_secrets(docs)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in BASE), F.sha2(_render(F.col("base")), 256).alias("base_sha256"), _render(F.concat("base", "added")).alias("spans"))
