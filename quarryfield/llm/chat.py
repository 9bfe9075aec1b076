"""Operator 10: chat formatting by prefix-target expansion.  DataFrame operations only.

A conversation, its rows in order of turn, becomes text by a template::

    ### role: text</turn>\\n

Inside roles and texts the escape character and the characters that begin a control string
are written as ``\\s`` (backslash), ``\\h`` (#), ``\\l`` (<) and, in roles, ``\\c`` (:); a null
role is ``\\0``.  So no text can hold a control string, whatever it says, and unescaping gives
it back exactly.

Expansion: each assistant turn becomes one example whose prompt is everything before its
reply (header included) and whose completion, the only trainable part, is the reply.  What
follows the last reply (its end mark and later turns) would be in no example, so each
conversation's last row also carries it as ``tail``; prompt, completion and tail of that row
are the whole formatted conversation.  A conversation without an assistant turn gives one
row with a null completion.

Cases: a null text is empty; rows with a null or equal turn come in order of turn (null
first), role and text; a null conv_id is a conversation of its own; repeated rows are
repeated turns; an empty table gives no rows; other columns are ignored.  A conversation's
turns meet in one row (its digest runs over all of them in order); examples hold the prefix
each, as the method asks, so their text grows with the square of a conversation's turns.
``read_back`` checks every prompt against the examples before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
START = "### "


def escape(text: Column, role: bool = False) -> Column:
    pairs = [("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])]
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in [(":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\s")]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array of (role, text, head, body) in order; head + body + END are the formatted turn."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.coalesce(escape(t["role"], role=True), F.lit("\\0")), F.lit(": "))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].eqNullSafe(F.lit("assistant")).alias("reply"), head(t).alias("head"), escape(t["text"]).alias("body"))))


def expand(rows: DataFrame, **cols: str) -> DataFrame:
    """One row for each assistant turn: conv_id, example (from 0), prompt, seen, completion, tail, last.

    ``seen``: characters at the start of the prompt that the example before holds too, as its
    prompt and completion.
    """
    formatted = format_conversations(rows, **cols)
    texts = formatted.select(
        "conv_id", F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("whole"),
        F.size(F.filter("turns", lambda t: t["reply"])).alias("n"),
    )
    # Where each reply starts in the formatted text: running lengths, over rows that hold no text.
    turns = formatted.select("conv_id", F.posexplode("turns").alias("pos", "t"))
    turns = turns.select("conv_id", "pos", F.col("t.reply").alias("reply"), F.char_length("t.head").alias("head"), F.char_length("t.body").alias("body"))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("head") + F.col("body") + F.lit(len(END))).over(before), F.lit(0)) + F.col("head")
    example = F.coalesce(F.sum(F.col("reply").cast("int")).over(before), F.lit(0)).cast("int")
    placed = turns.select(F.col("conv_id").alias("of"), "pos", "reply", at.alias("at"), "body", example.alias("example"))
    seen = F.coalesce(F.max(F.when(F.col("reply"), F.col("at") + F.col("body"))).over(Window.partitionBy("of").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    replies = placed.select("of", "reply", F.struct(F.col("at"), F.col("body").alias("n"), seen.alias("seen")).alias("span"), "example").where("reply").drop("reply")
    df = texts.join(replies, texts["conv_id"].eqNullSafe(replies["of"]), "left").withColumn("example", F.coalesce("example", F.lit(0)))
    df = df.withColumn("last", F.col("example") == F.greatest(F.col("n"), F.lit(1)) - 1)
    at, n = F.col("span.at").cast("int"), F.col("span.n").cast("int")
    return df.select(
        "conv_id", "example",
        F.when(F.col("span").isNull(), F.col("whole")).otherwise(F.substring("whole", F.lit(1), at)).alias("prompt"),
        F.coalesce(F.col("span.seen"), F.lit(0)).cast("int").alias("seen"),
        F.when(F.col("span").isNotNull(), F.substring("whole", at + 1, n)).alias("completion"),
        F.when(F.col("last"), F.when(F.col("span").isNull(), "").otherwise(F.expr("substring(whole, int(span.at + span.n) + 1)"))).alias("tail"),
        "last",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """From the examples alone: conv_id, turns (array of role, text), replies (array of text), formatted.

    Each example gives what its prompt adds to the example before, then its completion; the
    rest of every prompt is compared with that example by hash, so that the text is shuffled
    once and not once for each example.  ``formatted`` is null if a prompt disagrees.
    """
    head, more = F.substring("prompt", F.lit(1), F.col("seen")), F.expr("substring(prompt, seen + 1)")
    part = F.struct("example", F.concat_ws("", more, "completion", "tail").alias("text"), "completion", F.xxhash64(head).alias("head"), F.xxhash64(F.concat_ws("", "prompt", "completion")).alias("all"))
    grouped = examples.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    n = F.size("parts")
    agree = F.forall(F.zip_with(F.slice("parts", F.lit(1), n - 1), F.slice("parts", F.lit(2), n - 1), lambda a, b: a["all"] == b["head"]), lambda same: same)
    replies = F.filter(F.transform("parts", lambda p: p["completion"]), lambda c: c.isNotNull())
    read = grouped.select("conv_id", F.when(agree, F.concat_ws("", F.transform("parts", lambda p: p["text"]))).alias("formatted"), replies.alias("replies"))
    lines = F.filter(F.split("formatted", END, -1), lambda x: x != "")

    def parse(x: Column) -> Column:
        cut = F.instr(x, ": ")
        role = F.substring(x, F.lit(len(START) + 1), cut - 1 - len(START))
        return F.struct(F.when(role != "\\0", unescape(role)).alias("role"), unescape(F.substring(x, cut + 2, F.char_length(x))).alias("text"))

    return read.select("conv_id", F.transform(lines, parse).alias("turns"), F.transform("replies", unescape).alias("replies"), "formatted")
