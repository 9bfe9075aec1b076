"""Operator 7: mixing sources to target weights by entropy balancing.  DataFrame operations only.

Among all document rates r (expected copies) between 0 and ``cap`` that give each source its
target of words, the mix takes those nearest to "one copy of each" in relative entropy.  The
convex dual has one multiplier a source, and its solution tilts rates exponentially:
``r = min(cap, exp(multiplier * size / mean size))``.  Newton's method on the dual needs, for
each source and round, the words that the rates give and their derivative.  Rates depend on
the source and the size only, so both are sums over the (source, size) histogram, a table
formed once by partial aggregation.  Steps are safeguarded by a bracket, a few rounds are
one small distributed job, and only whether any error is left comes to the driver.

Rounding: rate r means floor(r) copies and one more for some documents.  Extras are dealt
along the sizes of a source by the rounded cumulative sum of the fractional parts, so a
source's words stay within about one document of what the rates give.  Within a (source,
size) the documents with the first ranks in hash order take the extras; ranks come from
hashed buckets with prefix counts, so equal documents never meet in one task.

Cases: a null text has size 0; documents of size 0 keep one copy; a null source is a source
of its own, sorted last; repeated rows each count, and which of rows equal in all columns
takes an extra copy makes no difference; an empty table gives no rows; other columns pass
through where their names do not clash with the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .common import materialise, small_side, text_or_empty, unused, word_count, work_dir

CAP = 3
TOLERANCE = 1e-7
MAX_ROUNDS = 60
#: Newton rounds between two looks at the errors; a source that has converged keeps its multiplier.
ROUNDS_A_JOB = 4
#: A multiplier of this size drives the rates to 0 or to the cap as far as doubles tell.
BOUND = 64.0
#: Buckets that documents of one source and size are numbered in; results depend on it, so it is fixed.
BUCKETS = 1024


def source_targets(sizes: DataFrame, where: str, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``sizes``: source, source_size.  Adds target: all words shared by weight, at most ``cap`` times the source's.

    Sources by code point, null last, weigh in turn; what exceeds a source's limit is shared
    again by weight.  The fixed point is ``min(limit, weight * level)``: the level starts at all
    words by all weights and rises as sources reach their limits, each round two sums over all
    sources, until it reaches no further limit.
    """
    turned = numbered(sizes, [F.col("source").isNull(), F.col("source")], f"{where}/ranked")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = turned.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("limit"))
    words, level, reached = weighed.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("limit") < F.col("weight") * F.lit(level)
        n, given, left = weighed.agg(F.count_if(over), F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == reached or not left:
            break
        reached, level = n, (words - given) / left
    return weighed.select("source", "source_size", F.least("limit", F.col("weight") * F.lit(level)).alias("target"))


def _rate(size: Column, scale: Column, multiplier: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(multiplier * size / scale, F.lit(50.0))))


def _newton(histogram: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One round: each source's words and slope under its multiplier, the bracket around the solution, the next multiplier."""
    joined = histogram.withColumnRenamed("source", "of").join(state, F.col("of").eqNullSafe(F.col("source")))
    rate = _rate(F.col("size"), F.col("scale"), F.col("multiplier"), cap)
    words = F.col("size") * F.col("n") * rate
    slope = F.when(rate < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)
    got = joined.groupBy("source", "target", "source_size", "scale", "multiplier", "low", "high").agg(
        # Decimal sums do not depend on the order of rows, so reruns take the same steps to the last bit.
        F.sum(words.cast("decimal(38,6)")).cast("double").alias("words"), F.sum(slope.cast("decimal(38,6)")).cast("double").alias("slope"),
    )
    over = F.col("words") > F.col("target")
    low, high = F.when(over, F.col("low")).otherwise(F.col("multiplier")), F.when(over, F.col("multiplier")).otherwise(F.col("high"))
    newton = F.col("multiplier") + (F.col("target") - F.col("words")) / F.col("slope")
    error = F.when(F.col("target") > 0, F.abs(F.col("words") - F.col("target")) / F.col("target")).otherwise(0.0)
    got = got.withColumns({"low": low, "high": high, "error": F.when(F.col("source_size") > 0, error).otherwise(0.0)})
    step = F.when((F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
    # A target at the cap has no finite solution: all rates of the source are the cap.
    step = F.when(F.col("target") >= F.col("source_size") * cap * (1 - 1e-12), F.lit(BOUND)).when(F.col("error") < TOLERANCE, F.col("multiplier")).otherwise(step)
    return got.withColumn("multiplier", step).select(state.columns)


def balance(histogram: DataFrame, targets: DataFrame, where: str, cap: int = CAP) -> DataFrame:
    """Newton rounds on the dual.  ``histogram``: source, size, n.  Gives source, multiplier, scale."""
    scale = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.join(scale, targets["source"].eqNullSafe(scale["source"])).select(
        targets["source"], "target", F.col("source_size").cast("double").alias("source_size"), F.greatest("scale", F.lit(1e-9)).alias("scale"),
        F.lit(0.0).alias("multiplier"), F.lit(-BOUND).alias("low"), F.lit(BOUND).alias("high"), F.lit(1.0).alias("error"),
    )
    state = materialise(state, f"{where}/round-0")
    sources = state.count()
    for turn in range(ROUNDS_A_JOB, MAX_ROUNDS + 1, ROUNDS_A_JOB):
        for _ in range(ROUNDS_A_JOB):
            state = _newton(histogram, small_side(state, sources, 160), cap)
        state = materialise(state, f"{where}/round-{turn}")
        open_ = (F.col("error") >= TOLERANCE) & (F.col("high") - F.col("low") > 1e-13) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
        if state.where(open_).isEmpty():
            break
    return state.select("source", "multiplier", "scale", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, rate, copies."""
    where = work_dir(docs.sparkSession, "mixing")
    # One order of documents whatever the session's settings: by a hash of id and text, in a fixed number of buckets.
    order = F.xxhash64(id_col, text_col)
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), order.alias("order"))
    measured = materialise(measured.withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int")), f"{where}/sizes")
    cells = materialise(measured.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), f"{where}/cells")
    histogram = materialise(cells.groupBy("source", "size").agg(F.sum("n").alias("n")), f"{where}/histogram")
    targets = materialise(source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), where, weights, cap), f"{where}/targets")
    solved = balance(histogram, targets, f"{where}/newton", cap)

    # Extras of each (source, size): differences of the rounded running sum of fractional parts.
    side = small_side(solved, solved.count(), 160)
    rate = F.when(F.col("multiplier") >= BOUND, F.lit(float(cap))).otherwise(_rate(F.col("size"), F.col("scale"), F.col("multiplier"), cap))
    rated = histogram.withColumnRenamed("source", "of").join(side, F.col("of").eqNullSafe(F.col("source"))).withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate))
    part = (F.col("rate") - F.floor("rate")) * F.col("n")
    along = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct size
    run = F.sum(part).over(along)
    rated = rated.withColumn("run", F.round(run)).withColumn("extras", (F.col("run") - F.coalesce(F.lag("run").over(Window.partitionBy("source").orderBy(F.desc("size"))), F.lit(0.0))).cast("long"))
    rated = rated.select("source", "size", "source_size", "target", "rate", F.floor("rate").cast("long").alias("whole"), "extras")

    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")  # a row for each bucket
    placed = cells.withColumn("before", before).alias("c").join(rated.alias("r"), F.col("c.source").eqNullSafe(F.col("r.source")) & (F.col("c.size") == F.col("r.size")))
    placed = materialise(placed.select("c.source", "c.size", "bucket", "before", "source_size", "target", "rate", "whole", "extras"), f"{where}/placed")
    # Documents are numbered within (source, size, bucket); the bucket's prefix count makes that a rank within (source, size).
    numbered = measured.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", "doc_id")))
    d, p = numbered.alias("d"), placed.alias("p")
    out = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.bucket") == F.col("p.bucket")))
    copies = F.col("whole") + F.when(F.col("before") + F.col("nth") <= F.col("extras"), 1).otherwise(0)
    return out.select("d.doc_id", "d.source", "d.size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every document as often as the mix takes it (0 to ``cap`` times).

    Rows equal in id, source and size share their copies: each takes an equal part, and the
    first of them in order of a hash of the text one more, until all copies are dealt.
    """
    where = work_dir(docs.sparkSession, "mixed")
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    size, of, of_source, of_size, copies, n, nth = unused(docs, "size", "of", "of_source", "of_size", "copies", "n", "nth")
    changed = taken.where("copies <> n").select(F.col("doc_id").alias(of), F.col("source").alias(of_source), F.col("size").alias(of_size), F.col("copies").cast("int").alias(copies), F.col("n").cast("int").alias(n))
    changed = materialise(changed, f"{where}/changed")
    rows, shared = changed.agg(F.count(F.lit(1)), F.max(n)).first()
    side = small_side(changed, rows, 80)
    sized = docs.withColumn(size, word_count(text_or_empty(text_col)))
    same = sized[id_col].eqNullSafe(side[of]) & sized[source_col].eqNullSafe(side[of_source]) & (sized[size] == side[of_size])
    joined = sized.join(side, same, "left")
    repeat = lambda df, times: df.withColumn(nth, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
    if (shared or 1) == 1:
        return repeat(joined, F.coalesce(copies, F.lit(1)))
    alone = repeat(joined.where(F.coalesce(n, F.lit(1)) == 1), F.coalesce(copies, F.lit(1)))
    ranked = joined.where(F.col(n) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(of, of_source, of_size).orderBy(F.xxhash64(text_col))))
    return alone.union(repeat(ranked, F.floor(F.col(copies) / F.col(n)).cast("int") + (F.col(nth) <= F.col(copies) % F.col(n)).cast("int")))
