"""Operator 9: quality rules as a short-circuit cascade.  DataFrame operations only.

Each rule is a condition over statistics of the whole text that rejects a document.  The
cascade times every rule alone on a bounded sample of rows and counts what it rejects there,
orders the rules by rejection per cost, and evaluates them in that order; a rule runs only
where all before it passed (SQL's CASE evaluates its branches in turn).  The verdict is that
of all rules together, so the order changes the cost and never the result.

Statistics, with words ``[^\\x20\\x09-\\x0D]+``:

* n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``),
* n_dup_lines: lines (split at \\n) with a word that equal an earlier line of the text,
* n_repeat_words: words inside 3-word windows that occur twice or more in the text.

Windows are compared by the 64-bit hash of their three words; two different windows of one
text share a hash with probability below n * n / 2**65.

Cases: a null text has no words and is rejected by the base rule; empty and white texts
likewise; repeated rows and null ids keep their rows; an empty table gives no rows; other
columns pass through ``measure`` unless their names are those of statistics, which replace them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, blanks, word_count

SYMBOLS = "#*$%&|<>"
#: Rows of the sample that costs and selectivities are estimated on, at most.
SAMPLE_ROWS = 2000


def _words(text: Column) -> Column:
    """Words as an array; the split is by a single character unless blanks meet."""
    one = F.trim(blanks(text))
    return F.when(one == "", F.array().cast("array<string>")).when(F.contains(one, F.lit("  ")), F.split(one, " +")).otherwise(F.split(one, " "))


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, ASCII_SPACE, "") != "")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _with_statistic(df: DataFrame, name: str, t: Column, alive: Column | None = None) -> DataFrame:
    """Adds a statistic of the text ``t``; where ``alive`` is false it is not computed."""
    if name in df.columns:
        return df
    only = (lambda c: c) if alive is None else (lambda c: F.when(alive, c))
    if name == "n_words" and "_q_words" in df.columns:
        return df.withColumn(name, F.size("_q_words").cast("long"))
    if name == "n_words":
        return df.withColumn(name, only(word_count(t)))
    if name == "word_chars":
        return df.withColumn(name, only(F.char_length(F.replace(blanks(t), F.lit(" "), F.lit(""))).cast("long")))
    if name == "n_symbols":
        return df.withColumn(name, only((F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long")))
    if name in ("n_lines", "n_dup_lines"):
        df = df if "_q_lines" in df.columns else df.withColumn("_q_lines", only(_lines(t)))
        all_lines = F.size("_q_lines")
        return df.withColumn(name, (all_lines if name == "n_lines" else all_lines - F.size(F.array_distinct("_q_lines"))).cast("long"))
    # Repeated windows in two steps: texts whose windows all differ (most) stop after counting
    # the distinct hashes; only in the rest are windows sorted with their places, so that equal
    # ones become neighbours.
    df = df if "_q_words" in df.columns else df.withColumn("_q_words", only(_words(t)))
    w, n = F.col("_q_words"), F.greatest(F.size("_q_words") - 2, F.lit(0))
    df = df.withColumn("_q_windows", F.zip_with(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(w, 3, n), lambda ab, c: F.xxhash64(ab, c)))
    v = F.col("_q_windows")
    placed = F.sort_array(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_sorted", F.when(F.size(F.array_distinct(v)) < F.size(v), placed))
    s = F.col("_q_sorted")
    m = F.size(s)
    # Neighbours with one hash mark both their places; a window equal to any other has an equal neighbour.
    pairs = F.zip_with(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_q_at", F.when(s.isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))))
    at = F.col("_q_at")
    # A place covers the words up to the next place, three at most; the last place covers three.
    gaps = F.aggregate(F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3).cast("long"), lambda acc, g: acc + g)
    return df.withColumn(name, F.when(at.isNotNull(), gaps).otherwise(0).cast("long"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds every statistic to every row; columns of those names are replaced, all others pass through."""
    kept = [c for c in docs.columns if c not in STATISTICS]
    clash = {c: f"_own_{c}" for c in kept if c.startswith("_q_")}
    df = docs.select(*(F.col(c).alias(clash.get(c, c)) for c in kept), F.coalesce(F.col(text_col), F.lit("")).alias("_q_text"))
    for name in ("n_repeat_words", *STATISTICS):
        df = _with_statistic(df, name, F.col("_q_text"))
    return df.select(*(F.col(clash.get(c, c)).alias(c) for c in kept), *STATISTICS)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the statistics named in ``needs``; it must not be null."""

    name: str
    needs: tuple[str, ...]
    rejects: Column


def base_rule() -> Rule:
    return Rule("base", ("n_words", "n_repeat_words"), (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def default_rules() -> list[Rule]:
    """Bounds that running prose of any European language keeps far from."""
    return [
        Rule("symbols", ("n_symbols", "n_words"), 4 * F.col("n_symbols") > F.col("n_words")),
        Rule("duplicate lines", ("n_dup_lines", "n_lines"), 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("word length", ("word_chars", "n_words"), (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))),
    ]


def plan_cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules with cost (seconds on the sample) and selectivity (share rejected), best rejection per cost first.

    The sample is the first ``sample_rows`` rows.  A collected limit runs over one partition
    first and over further ones only if that held too few rows, and stops reading at the
    limit, so the sample costs the same for a table of any size; only verdicts come to the
    driver.  A rule is timed with just the statistics it needs, less the time of the scan, and
    only after a first run that compiles its plan and warms it up.
    """

    def timed(df: DataFrame) -> tuple[float, int, int]:
        df.limit(-(-sample_rows // 4)).collect()
        sample = df.limit(sample_rows)
        began = time.perf_counter()
        flags = [r[0] for r in sample.collect()]
        return time.perf_counter() - began, sum(map(bool, flags)), len(flags)

    scan, _, _ = timed(docs.select(F.col(text_col).isNull() | (F.octet_length(text_col) >= 0)))
    out = []
    for rule in rules:
        seconds, rejected, n = timed(measure(docs.select(text_col), text_col).select(rule.rejects))
        out.append((rule, max(seconds - scan, 1e-3), rejected / n if n else 0.0))
    return sorted(out, key=lambda t: (-t[2] / t[1], t[1], t[0].name))


def cascade(rules: list[Rule]) -> Column:
    """True for documents that every rule keeps; rules after the first that rejects do not run."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.rejects, False)
    return verdict.otherwise(True) if rules else F.lit(True)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``measure`` with base_failed and kept added."""
    rules = default_rules() if rules is None else rules
    base = base_rule()
    ordered = [r for r, _, _ in plan_cascade(docs, [base, *rules], text_col)]
    return measure(docs, text_col).withColumn("base_failed", base.rejects).withColumn("kept", cascade(ordered))


def keep(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The documents that every rule keeps, with their own columns.

    Here the cascade also spares the statistics: each is computed under CASE for those rows
    only that all rules before its first use have kept.
    """
    rules = [base_rule(), *(default_rules() if rules is None else rules)]
    clash = {c: f"_own_{c}" for c in docs.columns if c in STATISTICS or c.startswith("_q_")}
    df, text = docs.withColumnsRenamed(clash), F.coalesce(F.col(clash.get(text_col, text_col)), F.lit(""))
    alive = F.lit(True)
    for i, (rule, _, _) in enumerate(plan_cascade(docs, rules, text_col)):
        for name in rule.needs:
            df = _with_statistic(df, name, text, alive)
        df = df.withColumn(f"_q_alive_{i}", alive & ~F.coalesce(rule.rejects, F.lit(True)))
        alive = F.col(f"_q_alive_{i}")
    # The row number is not deterministic, so Catalyst leaves the filter above the statistics
    # instead of pushing it below and computing them again for each mention.
    kept = df.withColumn("_q_row", F.monotonically_increasing_id()).where(alive & (F.col("_q_row") >= 0))
    return kept.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))
