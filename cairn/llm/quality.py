"""Quality rules whose cutoffs carry a risk guarantee.

Each rule rejects a text whose statistic is at or above a cutoff.  The cutoffs
of all rules are tightened together, along a path that the documents labelled
bad and the unlabelled ones fix: a cutoff comes the earlier, the larger the share
of the bad that it rejects is against the share of the unlabelled.  How far to go
is chosen per stratum on the documents labelled good, such that the rate of good
texts rejected by any rule is at most ``risk``, at confidence ``1 - delta`` for
all strata together:

* a step is accepted if the exact binomial tail P(X <= k | n, risk) of its k
  false rejections among n good texts is at most ``delta / strata`` (Bonferroni
  over the strata);
* steps are tried from the loosest on and the search ends at the first that
  fails (a fixed sequence of tests), so that no further correction is needed
  for steps or rules.  The path does not look at the good texts.

Strata whose good texts are too few for TOLERATED false rejections, and those beyond the
``max_strata`` largest, are judged together as one stratum, for which the
guarantee then holds as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
#: Rule -> (numerator, denominator) of its statistic; high values are rejected.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "shouting": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
}
#: Cutoffs are multiples of 1/STEPS, up to TOP.
STEPS, TOP = 50, 2.0
LEVELS = int(STEPS * TOP) + 1
#: False rejections that a stratum of its own has room for.
TOLERATED = 3
#: Steps of the path: shares of the greatest enrichment of the bad; below ENRICHED a cutoff is of no use.
SHARES, ENRICHED = tuple((19 - j) / 20 for j in range(19)), 1.5


def _stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    start, end, row = X.words(data, offsets)
    inside = X.cover(start, end, len(data))
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": X.per_row(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": X.per_row(SYMBOL[data], offsets),
        "n_upper": X.per_row(UPPER[data], offsets),
        "n_marks": X.per_row(data == 33, offsets),
    }
    # Lines: cut at newlines and at the ends of rows.
    edge = np.zeros(len(data) + 1, bool)
    edge[1:][data == 10] = True
    edge[offsets] = True
    first = np.flatnonzero(edge)
    lo, hi = first[:-1], first[1:].copy()
    hi -= data[hi - 1] == 10 if len(hi) else 0
    has = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lo, hi = lo[has], hi[has]
    line_row = np.searchsorted(offsets, lo, "right") - 1
    order = np.lexsort((line := X.classes(data, lo, hi), line_row))
    again = np.zeros(len(order), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = np.bincount(line_row[order[again]], minlength=n)
    # Windows of three words that occur twice in their text; words are numbered by their bytes.
    covered = np.zeros(len(start), bool)
    if len(start) > 2:
        word = X.classes(data, start, end)
        kinds = int(word.max()) + 1
        w = np.flatnonzero(row[2:] == row[:-2])
        pair = np.unique(word[w] * kinds + word[w + 1], return_inverse=True)[1]
        window = pair * kinds + word[w + 2]
        order = np.lexsort((window, row[w]))
        twin = (window[order][1:] == window[order][:-1]) & (row[w][order][1:] == row[w][order][:-1])
        twice = w[order[np.concatenate((twin, [False])) | np.concatenate(([False], twin))]] if len(w) else w
        covered = X.cover(twice, twice + 3, len(start))
    out["n_repeat_words"] = np.bincount(row, weights=covered, minlength=n).astype(np.int64)
    return out


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` and the counts STATS.

    A null or empty text has no words.  Rows are independent: repeated rows and
    ids are kept as they are.  Other columns, whatever their names, are ignored.
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), *(f"{s} bigint" for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_stats(d, o) for _, _, d, o in X.chunks(*X.buffers(batch.column(batch.num_columns - 1)))]
            found = {s: np.concatenate([p[s] for p in parts]) if parts else np.zeros(0, np.int64) for s in STATS}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[s], pa.int64()) for s in STATS)], names=[*batch.schema.names[:-1], *STATS])

    return rows.mapInArrow(run, schema)


def base_failed() -> F.Column:
    """The fixed base rule: under 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly up to rounding."""
    if k >= n:
        return 1.0
    return _betainc(n - k, k + 1, 1 - p)


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 20_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + t * d) or 1e-300)
            c = (1 + t / c) or 1e-300
            f *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return front * f / a


def _level(rule: str) -> F.Column:
    """The statistic of a rule in whole steps, 0 .. STEPS*TOP."""
    num, den = RULES[rule]
    return F.when(F.col(den) > 0, F.least(F.lit(int(STEPS * TOP)), F.floor(F.col(num) * STEPS / F.col(den)))).otherwise(0).cast("int")


Cutoffs = tuple[dict[str, list[int]], dict[str, int], int]


def _enrichment(bad: dict[int, int], other: dict[int, int]) -> list[float]:
    """Of each level of a rule: the best enrichment of a cutoff that rejects it; cautious where counts are small."""
    n_bad, n_other = sum(bad.values()), sum(other.values())
    tail_bad, tail_other, out = sum(bad.values()) - bad.get(0, 0), n_other - other.get(0, 0), [0.0] * LEVELS
    for level in range(1, LEVELS):
        if bad.get(level):
            out[level] = (tail_bad - math.sqrt(tail_bad)) / n_bad / ((tail_other + math.sqrt(tail_other) + 1) / (n_other + 1))
        out[level] = max(out[level], out[level - 1])
        tail_bad, tail_other = tail_bad - bad.get(level, 0), tail_other - other.get(level, 0)
    return out


def _paths(bad: dict[str, dict[int, int]], other: dict[str, dict[int, int]]) -> dict[str, list[int]]:
    """Rule -> the first step that rejects each level; len(SHARES) for none."""
    score = {r: _enrichment(bad[r], other[r]) for r in RULES}
    most = max(x[-1] for x in score.values())
    # Without unlabelled documents there is nothing to be enriched against.
    least = ENRICHED if any(other.values()) else 1e-9
    first = lambda e: next((j for j, f in enumerate(SHARES) if e >= max(f * most, least)), len(SHARES))
    return {r: [first(e) for e in score[r]] for r in RULES}


def _step(paths: dict[str, list[int]]) -> F.Column:
    return F.least(*(F.element_at(F.array(*(F.lit(x) for x in paths[r])), _level(r) + 1) for r in RULES))


def _furthest(by: dict[int, int], risk: float, share: float) -> int:
    """The last accepted step, from counts of good texts by the step that rejects them; -1 for none."""
    n, rejected = sum(by.values()), 0
    for j in range(len(SHARES)):
        rejected += by.get(j, 0)
        if binomial_tail(rejected, n, risk) > share:
            return j - 1
    return len(SHARES) - 1


def enough(risk: float, share: float) -> int:
    """The fewest good texts at which TOLERATED false rejections are accepted."""
    low, high = TOLERATED, 1 << 40
    while high - low > 1:
        n = (low + high) // 2
        low, high = (low, n) if binomial_tail(TOLERATED, n, risk) <= share else (n, high)
    return high


def fit(stats: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.02, delta: float = 0.05, max_strata: int = 1000) -> Cutoffs:
    """The path (rule -> step of each level), the last step of each stratum of its own, and that of all others together.

    ``labels`` has doc_id and quality (1 good, 0 bad); of several labels of one
    document the best counts, null labels count for nothing.  Only histograms
    reach the driver: of levels by rule, and of steps for ``max_strata`` strata.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("__good"))
    able = stats.where(~base_failed()).join(known, "doc_id", "left")
    able = able.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("s"), F.col("__good").alias("good"), *(_level(r).alias(r) for r in RULES))
    bad: dict[str, dict[int, int]] = {r: {} for r in RULES}
    other: dict[str, dict[int, int]] = {r: {} for r in RULES}
    each = able.where("good is null or not good").select("good", F.inline(F.array(*(F.struct(F.lit(x).alias("rule"), F.col(x).alias("level")) for x in RULES))))
    for r in each.groupBy("good", "rule", "level").count().collect():
        (other if r["good"] is None else bad)[r["rule"]][r["level"]] = r["count"]
    paths = _paths(bad, other)
    step = F.least(*(F.element_at(F.array(*(F.lit(x) for x in paths[r])), F.col(r) + 1) for r in RULES))
    known = able.where("good").select("s", step.alias("step"))
    sizes = known.groupBy("s").count()
    # Enough good texts for TOLERATED of them to be rejected; the share of the error grows as fewer strata are left.
    strata = max_strata
    while True:
        own = {r["s"] for r in sizes.where(F.col("count") >= enough(risk, delta / (strata + 1))).orderBy(F.desc("count"), "s").limit(max_strata).collect()}
        if len(own) >= strata:
            break
        strata = len(own)
    hist: dict[str | None, dict[int, int]] = {None: {}}
    named = F.when(F.col("s").isin(*own), F.col("s")) if own else F.lit(None).cast("string")
    for r in known.groupBy(named.alias("s"), "step").count().collect():
        hist.setdefault(r["s"], {})[r["step"]] = r["count"]
    share = delta / len(hist)
    last = {s: _furthest(by, risk, share) for s, by in hist.items()}
    return paths, {s: x for s, x in last.items() if s is not None}, last[None]


def judge(stats: DataFrame, cutoffs: Cutoffs, stratum: str) -> DataFrame:
    """``stats`` with base_failed and kept."""
    paths, own, rest = cutoffs
    s = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    last = F.coalesce(F.create_map(*(F.lit(x) for kv in own.items() for x in kv))[s], F.lit(rest)) if own else F.lit(rest)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (_step(paths) > last))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Cutoffs are fitted as in :func:`quality_rules`; the rows are then judged
    where they are read, so that nothing is joined by id.  Nulls, repeated rows
    and empty tables count as there.
    """
    from ._store import Workspace

    store = Workspace(docs.sparkSession, "quality")
    stats = store.save(statistics(docs, text, ("doc_id", stratum)))
    paths, own, rest = fit(stats, labels, stratum, risk, delta)
    store.drop(stats)
    tables = {r: np.array(p) for r, p in paths.items()}
    place, by = docs.columns.index(text), docs.columns.index(stratum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = np.array([own.get("" if x is None else str(x), rest) for x in batch.column(by).to_pylist()], np.int64)
            for i, j, data, offsets in X.chunks(*X.buffers(batch.column(place))):
                s = _stats(data, offsets)
                bad = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
                for rule, (num, den) in RULES.items():
                    level = np.where(s[den] > 0, np.minimum(LEVELS - 1, s[num] * STEPS // np.maximum(s[den], 1)), 0)
                    bad |= tables[rule][level] <= last[i:j]
                yield batch.slice(i, j - i).filter(pa.array(~bad))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts STATS, ``stratum``, base_failed and kept for each row of ``docs``.

    Nulls: a null text has no words and fails; a null stratum is one of its own;
    a null doc_id is never labelled.  Empty tables give empty results, and
    without labels only the base rule rejects.  Repeated rows are each judged.
    """
    from ._store import Workspace

    stats = Workspace(docs.sparkSession, "quality").save(statistics(docs, keep=("doc_id", stratum)))
    return judge(stats, fit(stats, labels, stratum, risk, delta), stratum)
