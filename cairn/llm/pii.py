"""Personal data: base patterns, and candidates scored by boosted trees.

The base spans follow fixed patterns and checks.  Besides, generators with high
recall propose looser candidates that may overlap.  Boosted trees, fitted on all
candidates with the checks of their kinds as labels, score them by their format and
context; thresholds that are calibrated for each kind on held-out candidates select
those that are redacted as well.  The fitted trees become a column expression.

Only built-in functions run over the texts and the candidates; the driver chooses
the cuts of the trees from sums over all candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace

#: Leftmost non-overlapping matches.  Each is equal to the plain pattern in its
#: comment, but starts only where a run begins (or the last match ended) and
#: never gives back, so that long runs of letters or digits take linear time.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 14 digits or more
    "card": "[0-9](?:[\\x20-]?[0-9]){13,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Generators of further candidates: kind -> pattern.
LOOSE = {
    "ssn": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "natphone": "(?<![0-9A-Za-z+-])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\\x20?[0-9A-Z]{4}){2,7}(?:\\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "atmail": "(?<![0-9A-Za-z._-])[A-Za-z0-9._-]{2,}+\\x20?[(\\[]at[)\\]]\\x20?[A-Za-z0-9-]++\\.[A-Za-z]{2,}+",
}
#: A text that lacks the letter or sign has no match of the kind.
_NEEDS = {"email": "@", "phone": "+", "atmail": "at"}
KINDS = [*BASE, *LOOSE]
#: Matches that are folded at a time, and characters of a bucket in which spans are looked for.
_FOLD, _BUCKET = 64, 64
ROUNDS, RATE, PRECISION, FOLDS = 24, 0.3, 0.95, 3
#: Quantiles at which trees may cut, and the unit of gradients, which are whole numbers so that sums have one value.
_LEVELS, _UNIT = [i / 20 for i in range(1, 20)], 1 << 24
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,m:string>>"
_NEAR = "array<struct<kind:string,start:bigint,end:bigint,m:string,before:string,after:string>>"


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """The matches of a pattern with their places in code points, from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in _NEEDS:
        found = F.when(F.contains(text, F.lit(_NEEDS[kind])), found)
    return F.coalesce(found, F.array().cast("array<string>"))


def _placed(text: Column, kind: str, pattern: str, found: Column) -> Column:
    """The spans of the matches, with up to 30 characters before (back to the last match) and one after.

    Sums run over chunks, then over the chunks' totals, so that no long array is
    copied per match; what stands around a match comes from the pieces between
    matches, since a place in a long text is found only by counting up to it.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_NEAR).alias("out"))

    def span(x: Column, start: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span(x, start, end))).alias("out"))

    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    starts = lambda cs: F.aggregate(F.transform(cs, lambda c: c["at"]), none, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    move = lambda c, s: F.transform(c["out"], lambda x: span(x, x["start"] + s, x["end"] + s))
    once = lambda column, f: F.flatten(F.transform(F.array(column), f))  # noqa: E731  # used twice, computed once

    def place(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(_FOLD)), lambda c: F.aggregate(F.slice(pairs, c, F.lit(_FOLD)), zero, step))
        return once(chunks, lambda cs: F.flatten(F.zip_with(cs, starts(cs), move)))

    def around(pieces: Column) -> Column:
        pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"), F.slice(pieces, 2, F.size(found)).alias("q"))
        # A piece's length is counted in code points, and its end is read backwards.
        return F.transform(pairs, lambda x: F.struct(F.length(x["p"]).cast("bigint").alias("gap"), x["m"].alias("m"), F.substring(x["p"], -30, 30).alias("before"), F.substring(x["q"], 1, 1).alias("after")))

    placed = once(F.split(text, pattern), lambda pieces: once(around(pieces), place))
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast(_NEAR))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        v = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(x: Column) -> Column:
    """Whether a base candidate passes the check of its kind."""
    m, digits = x["m"], _digits(x["m"])
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3))), F.lit("9999")), F.lit(0)) <= 255)
    card = F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.when(x["kind"] == "ip", F.forall(F.split(m, "\\."), small)).when(x["kind"] == "card", card).when(x["kind"] == "phone", F.length(digits).between(10, 15)).otherwise(True)


def _mod97(m: Column) -> Column:
    """Whether an IBAN's digits, with its first four characters last, leave 1."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _own(x: Column) -> Column:
    """Whether a loose candidate passes the check of its kind: number plan, check digits."""
    m, digits = x["m"], _digits(x["m"])
    ssn = ~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^...00") & ~digits.rlike("0000$")
    plan = digits.rlike("^[2-9](?!11)..[2-9](?!11)..") & (F.contains(m, F.lit("(")) == F.contains(m, F.lit(")")))
    return F.when(x["kind"] == "ssn", ssn).when(x["kind"] == "natphone", plan).when(x["kind"] == "iban", _mod97(m)).otherwise(True)


def _render(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _ordered(spans: Column) -> Column:
    place = F.create_map(*(v for i, k in enumerate(KINDS) for v in (F.lit(k), F.lit(i))))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), place[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


# --- features and trees -----------------------------------------------------


def _features(c: str = "c") -> dict[str, Column]:
    """Features of a candidate column ``c`` (m, before, after) in a table of candidates."""
    m, before, after = F.col(f"{c}.m"), F.lower(F.col("before")), F.col("after")
    count = lambda p: (F.length(m) - F.length(F.regexp_replace(m, p, ""))).cast("double")
    digits = _digits(m)
    word = lambda p: F.when(before.rlike(p), 1.0).otherwise(0.0)
    return {
        "length": F.length(m).cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": count("[A-Za-z]"),
        "separators": count("[ .()-]"),
        "at": F.when(m.rlike("@|at[)\\]]"), 1.0).otherwise(0.0),
        "plus": F.when(F.startswith(m, F.lit("+")), 1.0).otherwise(0.0),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        "luhn": F.when(F.length(digits).between(12, 19), F.when(_luhn(digits), 1.0).otherwise(0.0)).otherwise(0.5),
        "own": F.when(F.col(f"{c}.kind").isin(*LOOSE), F.when(_own(F.col(c)), 1.0).otherwise(0.0)).otherwise(0.5),
        "glued": F.when(before.rlike("[A-Za-z0-9_=/]$") | after.rlike("^[A-Za-z0-9_=/]"), 1.0).otherwise(0.0),
        "call": word("phone|tel|call|mobile|fax"),
        "mail": word("mail|contact|write"),
        "card": word("card|visa|iban|account|ssn|social"),
    }


def _split(cuts: list[np.ndarray], sums: np.ndarray) -> tuple | None:
    """The best cut of a node by its sums of gradients, curvatures and rows in each slot: (feature, cut, sums left, sums right)."""
    least, best, at = 1e-6, None, 0
    for f, own in enumerate(cuts):
        upto = np.cumsum(sums[at : at + len(own) + 1], axis=0)
        at += len(own) + 1
        left, right, whole = upto[:-1], upto[-1] - upto[:-1], upto[-1]
        gain = left[:, 0] ** 2 / (left[:, 1] + 1) + right[:, 0] ** 2 / (right[:, 1] + 1) - whole[0] ** 2 / (whole[1] + 1)
        gain[np.minimum(left[:, 2], right[:, 2]) < 20] = 0
        if len(gain) and gain.max() > least:
            c = int(gain.argmax())
            least, best = gain[c] + 1e-9, (f, float(own[c]), left[c], right[c])
    return best


def _leaf(sums: np.ndarray) -> tuple:
    return (float(-RATE * sums[0] / (sums[1] + 1)),)


def _boost(cuts: list[np.ndarray], models: int, look: Callable, add: Callable) -> list[list[tuple]]:
    """The trees of each model, which are (feature, cut, left, right) or (value,).

    ``look`` takes the first cut of each model's next tree and gives the sums of
    each model, side of that cut and slot; the slots of a feature are the ranges
    between its cuts.  ``add`` takes the next tree of each model.
    """

    def branch(sums: np.ndarray) -> tuple:
        if best := _split(cuts, sums):
            return (best[0], best[1], _leaf(best[2]), _leaf(best[3]))
        return _leaf(sums[: len(cuts[0]) + 1].sum(axis=0))

    trees: list[list[tuple]] = [[] for _ in range(models)]
    for _ in range(ROUNDS if models else 0):
        tops = [_split(cuts, sums[0]) for sums in look([None] * models)]
        new = [(top[0], top[1], branch(sums[0]), branch(sums[1])) if top else branch(sums[0]) for top, sums in zip(tops, look(tops), strict=True)]
        add(new)
        for own, tree in zip(trees, new, strict=True):
            own.append(tree)
    return trees


def _models(seen: set[tuple[int, float]]) -> list[int]:
    """The parts to hold out (-1: none) where both labels are left; ``seen`` has the parts and their labels."""
    return [m for m in range(-1, FOLDS) if len({y for part, y in seen if part != m}) == 2]


def _predict(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _predict(tree[2], x), _predict(tree[3], x))


def fit(x: np.ndarray, y: np.ndarray, kind: np.ndarray, part: np.ndarray | None = None) -> tuple[list[tuple], dict[int, float]]:
    """Boosted trees of depth two, and for each kind the least margin with PRECISION.

    Margins are calibrated on candidates that the trees did not see: each of
    FOLDS parts is scored by trees of the other parts.  The precision is that of
    the lower bound of a binomial rate (normal approximation with one success
    less).  Kinds without such a margin are left out.  This is the fit of
    arrays; :func:`fit_table` does the same with a table.
    """
    part = np.arange(len(x)) % FOLDS if part is None else part
    models = _models(set(zip(part.tolist(), y.tolist(), strict=True)))
    cuts = [np.unique([np.quantile(v[kind == k], _LEVELS) for k in np.unique(kind)]) for v in x.T]
    first = np.cumsum([0, *(len(c) + 1 for c in cuts)])
    slots = [first[f] + np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]
    scores = np.zeros((len(models), len(x)))

    def look(tops: list[tuple | None]) -> np.ndarray:
        sums = np.zeros((len(models), 2, first[-1], 3))
        for i, (m, top) in enumerate(zip(models, tops, strict=True)):
            side = (x[:, top[0]] > top[1]).astype(int) if top else np.zeros(len(x), int)
            p = 1 / (1 + np.exp(-scores[i]))
            each = np.stack((np.round((p - y) * _UNIT) / _UNIT, np.round(p * (1 - p) * _UNIT) / _UNIT, np.ones(len(x))), axis=1)
            for slot in slots:
                np.add.at(sums[i], (side[part != m], slot[part != m]), each[part != m])
        return sums

    def add(new: list[tuple]) -> None:
        for i, tree in enumerate(new):
            scores[i] += _predict(tree, x)

    trees = _boost(cuts, len(models), look, add)
    least: dict[int, float] = {}
    if -1 in models:
        held = np.full(len(x), -np.inf)
        for i, m in enumerate(models):
            held[part == m] = scores[i][part == m]
        for k in np.unique(kind).tolist():
            own = (kind == k) & (held > -np.inf)
            order = np.argsort(-held[own], kind="stable")
            s, good = held[own][order], np.cumsum(y[own][order])
            n = np.arange(1, len(s) + 1)
            last = np.concatenate((s[1:] != s[:-1], [True])) if len(s) else np.zeros(0, bool)
            ok = np.flatnonzero(last & (_sure(np.maximum(good, 1), n, np.sqrt) >= PRECISION))
            if len(ok):
                least[k] = float(s[ok[-1]])
    return (trees[models.index(-1)] if -1 in models else []), least


def _sure(good, n, sqrt: Callable):
    """The lower bound of the rate of ``good`` (one at least) among ``n``, both numbers, arrays or columns."""
    rate = (good - 1) / n
    return rate - 1.64 * sqrt(rate * (1 - rate) / n)


def fit_table(known: DataFrame, features: dict[str, Column], store: Workspace) -> tuple[list[tuple], dict[str, float]]:
    """:func:`fit` on all rows of a table of candidates, with the margins of LOOSE kinds by name.

    Candidates with the same features, kind, label and part are counted once,
    then features are rounded up to the next cut.  Parts follow the match and what
    stands before it, so that repeats of one are held out together.
    """
    names = list(features)
    part = F.pmod(F.xxhash64("c.m", "before"), F.lit(FOLDS)).cast("int").alias("part")
    exact = known.select(*(v.alias(k) for k, v in features.items()), F.col("c.kind").alias("kind"), F.col("valid").cast("double").alias("y"), part)
    exact = store.save(exact.groupBy(*names, "kind", "y", "part").agg(F.count(F.lit(1)).alias("n")), "cells")
    marks = exact.groupBy("kind").agg(*(F.percentile(k, _LEVELS, F.col("n")).alias(k) for k in names)).collect()
    models = _models({(r.part, r.y) for r in exact.select("part", "y").distinct().collect()})
    if -1 not in models:
        return [], {}
    cuts = [np.unique([r[k] for r in marks]) for k in names]
    first = np.cumsum([0, *(len(c) + 1 for c in cuts)])
    up = lambda k, own: F.coalesce(F.array_min(F.filter(F.lit(own.tolist()), lambda c: c >= F.col(k))), F.lit(float("inf"))).alias(k)
    cells = exact.select(*(up(k, own) for k, own in zip(names, cuts, strict=True)), "kind", "y", "part", "n")
    cells = cells.groupBy(*names, "kind", "y", "part").agg(F.sum("n").alias("n")).withColumns({f"s{i}": F.lit(0.0) for i in range(len(models))})
    cells = store.save(cells, "scored")
    values = F.inline(F.array(*(F.struct(F.lit(f).alias("f"), F.col(k).alias("v")) for f, k in enumerate(names))))

    def look(tops: list[tuple | None]) -> np.ndarray:
        each = {}
        for i, (m, top) in enumerate(zip(models, tops, strict=True)):
            p, n = 1 / (1 + F.exp(-F.col(f"s{i}"))), F.when(F.col("part") != m, F.col("n")).otherwise(0)
            each[f"side{i}"] = F.when(F.col(names[top[0]]) > top[1], 1).otherwise(0) if top else F.lit(0)
            each |= {f"g{i}": F.round((p - F.col("y")) * _UNIT).cast("bigint") * n, f"h{i}": F.round(p * (1 - p) * _UNIT).cast("bigint") * n, f"n{i}": n}
        total = [F.sum(F.when(F.col(f"side{i}") == side, F.col(f"{c}{i}")).otherwise(0)) for i in range(len(models)) for side in range(1 + any(tops)) for c in "ghn"]
        sums = np.zeros((len(models), 2, first[-1], 3))
        for f, v, *got in cells.select(values, *(c.alias(k) for k, c in each.items())).groupBy("f", "v").agg(*total).collect():
            sums[:, : 1 + any(tops), first[f] + np.searchsorted(cuts[f], v)] = np.reshape(got, (len(models), -1, 3)) / (_UNIT, _UNIT, 1)
        return sums

    def add(new: list[tuple]) -> None:
        nonlocal cells
        old, cells = cells, store.save(cells.withColumns({f"s{i}": F.col(f"s{i}") + _as_column(tree, [F.col(k) for k in names]) for i, tree in enumerate(new)}), "scored")
        store.drop(old)

    trees = _boost(cuts, len(models), look, add)
    held = F.coalesce(*(F.when(F.col("part") == m, F.col(f"s{i}")) for i, m in enumerate(models)))
    ranks = cells.where(F.col("kind").isin(*LOOSE)).groupBy("kind", held.alias("s")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good")).where("s is not null")
    down = Window.partitionBy("kind").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranks.select("kind", "s", F.sum("n").over(down).alias("n"), F.sum("good").over(down).alias("good"))
    least = ranks.where(_sure(F.greatest("good", F.lit(1.0)), F.col("n"), F.sqrt) >= PRECISION).groupBy("kind").agg(F.min("s")).collect()
    return trees[models.index(-1)], dict(map(tuple, least))


def _as_column(tree: tuple, features: list[Column]) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    return F.when(features[tree[0]] <= tree[1], _as_column(tree[2], features)).otherwise(_as_column(tree[3], features))


# --- the operator -----------------------------------------------------------


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base (spans of the base patterns) and added (those that the trees select) of each row.

    Spans are (start, rank, end, kind) in code points, end exclusive, in order.
    Null and empty texts have none; repeated rows are each searched; an empty
    table gives no rows and fits nothing.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    store = Workspace(docs.sparkSession, "pii")
    rows = docs.select("doc_id", t.alias("text")).select("doc_id", "text", *(_matches(F.col("text"), k, p).alias(k) for k, p in (BASE | LOOSE).items()))
    placed = rows.select("doc_id", *(_placed(F.col("text"), k, p, F.col(k)).alias(k) for k, p in (BASE | LOOSE).items()))
    raw = F.concat(*(F.col(k) for k in BASE))
    near = lambda xs, good: F.transform(xs, lambda x: F.struct(F.struct(*(x[f].alias(f) for f in ("kind", "start", "end", "m"))).alias("c"), x["before"].alias("before"), x["after"].alias("after"), good(x).alias("valid")))
    found = store.save(placed.select("doc_id", near(raw, _valid).alias("raw"), near(F.concat(*(F.col(k) for k in LOOSE)), _own).alias("loose")).withColumn("row", F.monotonically_increasing_id()), "found")
    # Loose candidates that overlap no good base span; both are looked up by buckets of places.
    bucket = F.explode(F.sequence(F.floor(F.col("start") / _BUCKET), F.floor((F.col("end") - 1) / _BUCKET))).alias("bucket")
    some = found.where(F.size("loose") > 0)
    loose = some.select("row", F.inline("loose")).withColumns({"start": F.col("c.start"), "end": F.col("c.end")})
    taken = some.select("row", F.explode(F.filter("raw", lambda x: x["valid"])).alias("x")).select("row", F.col("x.c.start").alias("start"), F.col("x.c.end").alias("end")).select("row", bucket, F.col("start").alias("from"), F.col("end").alias("to"))
    clash = loose.select("row", "c", "start", "end", bucket).join(taken, ["row", "bucket"]).where((F.col("from") < F.col("end")) & (F.col("to") > F.col("start"))).select("row", "c").distinct()
    free = store.save(loose.join(clash, ["row", "c"], "left_anti").select("row", "c", "before", "after", "valid"), "free")
    features = _features()
    known = found.select(F.inline("raw")).unionByName(free.drop("row"))
    # A kind with too few good candidates has no margin, whatever the trees say.
    enough = [r["count"] for r in free.where("valid").groupBy("c.kind").count().collect() if _sure(r["count"], r["count"], np.sqrt) >= PRECISION]
    trees, margins = fit_table(known, features, store) if enough else ([], {})
    least = [(k, margins[k]) for k in KINDS if k in margins]
    if not least:
        added = free.select("row", F.array().cast(_SPAN).alias("picked")).limit(0)
    else:
        names = list(features)
        scored = free.select("row", "c", *(v.alias(k) for k, v in features.items()))
        margin = reduce(lambda a, b: a + b, (_as_column(tree, [F.col(n) for n in names]) for tree in trees))
        good = margin >= F.coalesce(*(F.when(F.col("c.kind") == k, F.lit(x)) for k, x in least), F.lit(float("inf")))
        added = scored.where(good).groupBy("row").agg(F.collect_list("c").alias("picked"))
    base = F.transform(F.filter("raw", lambda x: x["valid"]), lambda x: x["c"])
    joined = found.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    return joined.select("doc_id", _ordered(F.col("base")).alias("base"), _ordered(F.coalesce("picked", F.array().cast(_SPAN))).alias("added"))


def redact_query(docs: DataFrame) -> DataFrame:
    """The digest columns of op8."""
    found = find_pii(docs)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in BASE), F.sha2(_render(F.col("base")), 256).alias("base_sha256"), _render(F.array_sort(F.concat("base", "added"))).alias("spans"))
