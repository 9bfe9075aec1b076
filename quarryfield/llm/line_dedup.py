"""Operator 5: removal of repeated and nearly repeated lines.  DataFrame operations only.

Lines are compared after lower-casing and collapsing white space.  A line goes if an earlier
line of the corpus (by doc_id, then place) is equal, or, for lines of at least ``min_words``
words, within one word edit: one word changed, added or left out.  "Earlier" counts whether
that line itself stays or not, so the result does not depend on any processing order.

Deletion-neighbourhood join, in two levels so that long lines stay cheap:

1. Equal lines collapse to their earliest place.  Each distinct line is cut into blocks of
   words; leaving out one block at a time gives its block-deletion variants, hashed from the
   words before and after the block and the word count.  Two lines within one edit share the
   variant of the block that holds the edit, so only lines that share one go on.
2. Of those, the shared block's words are left out one at a time: the word-deletion variants
   within the edit bound, again as hashed keys.  Lines that leave out the same place of equal
   variants differ in that word; a line whose block equals another's variant lacks a word.

Each key keeps its earliest lines by partial aggregation, and every other line of the key is
joined to that one line, never to all; the pair is then verified word by word.  Sides are
broadcast only below a counted size; otherwise joins shuffle and are left to the adaptive
skew handling, so a variant or a line shared by very many places may be split.

Cases: a null text stays null; blank lines always stay; a document whose lines all go keeps
its row with an empty text; null ids sort first; rows with one id are told apart by their
text, and rows equal in both keep or lose the same lines; an empty table gives no rows; other
columns pass through, whatever their names, except n_lines, n_dropped and n_near, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_side, unused, work_dir

MIN_WORDS = 8
#: Lines of up to BLOCK_LINE_WORDS words have BLOCKS blocks; longer ones half the square root of their words.
BLOCK_LINE_WORDS = 64
BLOCKS = 3

_PLACE = ("doc_id", "row", "nth")


def normalise(text: Column) -> Column:
    """Lower case, white space other than line breaks collapsed; a whole text at once, its lines are trimmed later.

    Rare characters are looked for before anything is rewritten: a search reads bytes, a
    rewrite decodes every character.
    """
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    text = F.when(odd, F.translate(text, "\t\r\x0b\x0c", " " * 4)).otherwise(text)
    return F.lower(F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text))


def _blocks(n: Column) -> Column:
    return F.when(n <= BLOCK_LINE_WORDS, F.lit(BLOCKS)).otherwise(F.ceil(F.sqrt(n) / 2).cast("int"))


def _edges(n: Column, blocks: Column, b: Column) -> tuple[Column, Column]:
    """Block b covers words [start, end) of n."""
    return F.floor(b * n / blocks).cast("int"), F.floor((b + 1) * n / blocks).cast("int")


def _variant(line: Column, n: Column, blocks: Column, b: Column) -> Column:
    """Hash of a line without block b, seen as one of n words: the first words up to the block and the last after it.

    A line of one word more has the same hash if the extra word is in that block.
    """
    start, end = _edges(n, blocks, b)
    part = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    return F.xxhash64(n, b, part(start), part(end - n))


def _variants(line: Column, n: Column, min_words: int) -> Column:
    """Hashes of the block-deletion variants: as one of n words, then as n - 1 words and one more.

    Lines of usual length have a fixed number of blocks, spelled out so that no loop is interpreted.
    """
    few = lambda m: F.array(*(_variant(line, m, F.lit(BLOCKS), F.lit(b)) for b in range(BLOCKS)))
    many = lambda m: F.transform(F.sequence(F.lit(0), _blocks(m) - 1), lambda b: _variant(line, m, _blocks(m), b))
    short = F.when(n <= BLOCK_LINE_WORDS, F.when(n > min_words, F.concat(few(n), few(n - 1))).otherwise(few(n)))
    long = F.when(n - 1 <= BLOCK_LINE_WORDS, F.concat(many(n), few(n - 1))).otherwise(F.concat(many(n), many(n - 1)))
    return F.when(n >= min_words, F.coalesce(short, long))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def _place(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in _PLACE))


def within_one_edit(x: Column, y: Column) -> Column:
    """Word edit distance of at most one."""
    a, b = F.split(x, " "), F.split(y, " ")
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differing = F.filter(F.zip_with(a, b, lambda u, v: u == v), lambda same: ~same)
    n = F.size(short)
    cut = F.array_position(F.zip_with(F.slice(long, F.lit(1), n), short, lambda u, v: u == v), F.lit(False)).cast("int")
    cut = F.when(cut == 0, n + 1).otherwise(cut)
    gone = F.slice(long, cut + 1, n + 1 - cut) == F.slice(short, cut, n + 1 - cut)
    return F.when(F.size(a) == F.size(b), F.size(differing) <= 1).when(F.size(long) == n + 1, gone).otherwise(F.lit(False))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), nth, near (no equal line came before, but a near one): one row for each line that goes."""
    where = work_dir(docs.sparkSession, "line-dedup")
    rows = _rows(docs, id_col, text_col)

    # One pass over the texts: places, 128 bits for each line, block-deletion variants.
    split = rows.select("doc_id", "row", F.posexplode(F.split(normalise(F.col("text")), "\n", -1)).alias("nth", "raw"))
    lines = split.select(*_PLACE, F.trim("raw").alias("line")).where("line != ''")
    lines = lines.withColumn("n", (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int"))
    seen = materialise(lines.select(*_PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "n", _variants(F.col("line"), F.col("n"), min_words).alias("variants")), f"{where}/lines")
    firsts = materialise(
        seen.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.max("n").alias("n"), F.any_value("variants").alias("variants"), F.count(F.lit(1)).alias("places")),
        f"{where}/firsts",
    )

    # Level 1: distinct lines that share a block-deletion variant with another.
    shared = materialise(firsts.select(F.explode("variants").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), f"{where}/shared")
    each = firsts.select("first.*", "n", F.posexplode("variants").alias("i", "key"))
    own = _blocks(F.col("n"))
    each = each.withColumn("longer", F.col("i") >= own).withColumn("m", F.col("n") - F.col("longer").cast("int"))
    start, end = _edges(F.col("m"), _blocks(F.col("m")), F.when(F.col("longer"), F.col("i") - own).otherwise(F.col("i")))
    each = each.select(*_PLACE, "key", "longer", start.alias("at"), (end - start + F.col("longer").cast("int")).alias("len"))
    matched = each.join(small_side(shared, shared.count(), 32), "key")
    by_line = matched.groupBy(*_PLACE).agg(F.collect_list(F.struct("key", "longer", "at", "len")).alias("blocks"), F.count(F.lit(1)).alias("n"))
    by_row = materialise(by_line.groupBy("doc_id", "row").agg(F.collect_list(F.struct("nth", "blocks")).alias("found"), F.sum("n").alias("n")), f"{where}/matched")
    size = by_row.agg(F.sum("n"), F.count(F.lit(1))).first()
    side = small_side(by_row, 1, 48 * (size[0] or 0) + 48 * size[1])

    # Level 2: word-deletion variants of the shared blocks.  The matched lines' texts are written once.
    texts = rows.join(side, _same_row(rows, side))
    texts = texts.select(rows["doc_id"], rows["row"], F.split(normalise(rows["text"]), "\n", -1).alias("split"), F.explode("found").alias("f"))
    texts = materialise(texts.select("doc_id", "row", "f.*", F.trim(F.get("split", F.col("f.nth"))).alias("line")), f"{where}/matched-lines")
    hashed = texts.select(*_PLACE, F.transform(F.split("line", " "), lambda x: F.xxhash64(x)).alias("w"), F.explode("blocks").alias("b"))
    blocks = hashed.select(*_PLACE, "b.*", F.slice("w", F.col("b.at") + 1, F.col("b.len")).alias("block"))
    block, length = F.col("block"), F.col("len")
    without = lambda j: (F.slice(block, F.lit(1), j), F.slice(block, j + 2, length - j - 1))
    word = F.transform(
        F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))),
        lambda j: F.struct(F.when(F.col("longer"), F.xxhash64("key", F.lit(0), *without(j))).otherwise(F.xxhash64("key", j + 1, *without(j))).alias("g"), F.when(F.col("longer"), F.lit("long")).otherwise(F.lit("same")).alias("role")),
    )
    word = F.when(length > 0, word).otherwise(F.array().cast("array<struct<g:bigint,role:string>>"))
    itself = F.array(F.struct(F.xxhash64("key", F.lit(0), block).alias("g"), F.lit("short").alias("role")))
    keyed = materialise(blocks.select(*_PLACE, F.explode(F.when(F.col("longer"), word).otherwise(F.concat(itself, word))).alias("k")).select(*_PLACE, "k.*"), f"{where}/keyed")
    least = lambda role: F.min(F.when(F.col("role") == role, _place())).alias(role)
    heads = keyed.groupBy("g").agg(least("same"), least("short"), least("long"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    partner = F.when(F.col("role") == "same", F.col("same")).when(F.col("role") == "short", F.col("long")).otherwise(F.col("short"))
    pairs = keyed.join(heads, "g").select(_place().alias("place"), partner.alias("partner")).where("partner < place")
    pairs = pairs.groupBy("place").agg(F.min("partner").alias("partner"))

    # Verification on the lines themselves.
    words = texts.select(_place().alias("place"), "line").distinct()
    mine, other = words.select("place", F.col("line").alias("x")), words.select(F.col("place").alias("partner"), F.col("line").alias("y"))
    near = pairs.join(mine, "place").join(other, "partner").where(within_one_edit(F.col("x"), F.col("y"))).select(F.col("place").alias("first"), F.lit(True).alias("near"))

    # Every place but the first of a line goes, and the first too if a near line came before it.
    going = materialise(firsts.select("h1", "h2", "first", "places").join(near, "first", "left").where("places > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), f"{where}/going")
    return seen.select(*_PLACE, "h1", "h2").join(small_side(going, going.count(), 80), ["h1", "h2"]).where((_place() != F.col("first")) | F.col("near")).select(*_PLACE, (F.col("near") & (_place() == F.col("first"))).alias("near"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines taken out of the text; adds n_lines, n_dropped, n_near (all but the last two unchanged otherwise)."""
    where = work_dir(docs.sparkSession, "line-dedup")
    gone = dropped_lines(docs, min_words, id_col, text_col)
    gone = materialise(gone.groupBy("doc_id", "row").agg(F.collect_set("nth").alias("gone"), F.count_if("near").alias("near"), F.count(F.lit(1)).alias("n")), f"{where}/gone")
    size = gone.agg(F.sum("n"), F.count(F.lit(1))).first()
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "n_near")]
    row, split, of, of_row, places, near = unused(docs, "text_row", "split", "of", "of_row", "gone", "near")
    side = small_side(gone, 1, 8 * (size[0] or 0) + 64 * size[1]).select(F.col("doc_id").alias(of), F.col("row").alias(of_row), F.col("gone").alias(places), F.col("near").alias(near))
    df = docs.select(*kept).withColumn(row, F.xxhash64(text_col))
    df = df.join(side, df[id_col].eqNullSafe(side[of]) & (df[row] == side[of_row]), "left")
    df = df.withColumn(split, F.split(F.col(text_col), "\n", -1))  # a column, so that the loop below does not split again
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(places))
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    return df.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in kept),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).alias("n_lines"),
        F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).alias("n_dropped"),
        F.coalesce(near, F.lit(0)).alias("n_near"),
    )
