"""Chat formatting by quotation linking.

Quoted passages, runs of lines of one level (``>``, nested by repeating it), are normalised and hashed as a whole, joined to the messages of the
same conversation that wrote the same lines in a row, and taken out; messages are then ordered along the tree of replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcorpus.plans.storage import cut

#: Leading quote marks of a line.
MARKS = r"^([> \t]*)"


def level(line: Column) -> Column:
    """How deeply a line is quoted: the number of its leading ``>``."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(line: Column) -> Column:
    """A line without quote marks, in lower case, white space made one space and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"\s+", " "))


def quoted_lines(turns: DataFrame) -> DataFrame:
    """``conv, turn, row, pos, level, passage, h``: one row per non-blank line; ``passage`` numbers runs of one level in a message."""
    lines = turns.select("conv", "turn", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    found = lines.select("conv", "turn", "row", "pos", level(F.col("line")).alias("level"), normal(F.col("line")).alias("norm")).filter("norm <> ''")
    order = Window.partitionBy("conv", "turn", "row").orderBy("pos")
    new = F.coalesce((F.col("level") != F.lag("level").over(order)).cast("int"), F.lit(1))
    return found.withColumn("new", new).withColumn("passage", F.sum("new").over(order)).select("conv", "turn", "row", "pos", "level", "passage", F.xxhash64("norm").alias("h"))


def _latest_before(key: str) -> Column:
    """The latest earlier message of the conversation that has ``key`` as its own."""
    return F.max("own").over(Window.partitionBy("conv", key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))


def passage_origins(lines: DataFrame) -> DataFrame:
    """``conv, turn, row, passage, whole``: of each quoted passage the latest earlier message that has all its lines in a row among its own, if there is one.

    The lines' hashes are hashed once more by passage. Of messages all runs of own lines are hashed that are as long as a passage of the conversation, and both meet by hash.
    Passages of n lines in all have the root of 2 n lengths at most, so that is what a line's runs are bounded by.
    """
    hs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("hs")
    passages = lines.filter("level > 0").groupBy("conv", "turn", "row", "passage").agg(hs)
    passages = passages.select("conv", "turn", "row", "passage", F.xxhash64("hs").alias("run"), F.size("hs").alias("k"))
    lengths = passages.groupBy("conv").agg(F.collect_set("k").alias("ks"))
    own = lines.filter("level = 0").groupBy("conv", "turn", "row").agg(hs).join(lengths, "conv")
    runs = F.flatten(F.transform(F.filter("ks", lambda k: k <= F.size("hs")), lambda k: F.transform(F.sequence(F.lit(1), F.size("hs") - k + 1), lambda i: F.xxhash64(F.slice("hs", i, k)))))
    wrote = own.select("conv", "turn", F.explode(runs).alias("run")).distinct().withColumn("own", F.col("turn"))
    both = passages.select("conv", "turn", "row", "passage", "run").unionByName(wrote, allowMissingColumns=True)
    return both.withColumn("whole", _latest_before("run")).filter("passage is not null").select("conv", "turn", "row", "passage", "whole")


def reply_links(turns: DataFrame) -> DataFrame:
    """``conv, turn, reply_to``: messages that quote an earlier message of their conversation.

    A quoted passage goes to the latest earlier message that wrote it as a whole (see ``passage_origins``). Only one that no message wrote as a whole is led
    back line by line: to the message that most of its lines lead to (half of them at least; the later one of two), a line leading to the latest
    earlier message that wrote it. Of a message's passages the one of least level decides, then the one with the most lines found, then the later origin.
    """
    lines = cut(quoted_lines(turns), "lines")
    traced = lines.withColumn("own", F.when(F.col("level") == 0, F.col("turn"))).withColumn("origin", _latest_before("h")).filter("level > 0")
    key = ["conv", "turn", "row", "passage"]
    votes = traced.groupBy(*key, "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    passages = votes.groupBy(*key, "level").agg(F.sum("n").alias("all"), F.max(F.when(F.col("origin").isNotNull(), F.struct("n", "origin"))).alias("best"))
    found = passages.join(passage_origins(lines), key)
    origin = F.when(F.col("whole").isNotNull(), F.struct(F.col("all").alias("n"), F.col("whole").alias("origin"))).when(F.expr("2 * best.n >= all"), F.col("best"))
    found = found.withColumn("best", origin).filter("best is not null")
    best = found.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), F.col("best.n").alias("n"), F.col("best.origin").alias("origin"))).alias("best"))
    return best.select("conv", "turn", F.col("best.origin").alias("reply_to"))


def branches(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``conv, turn, branch, path``: where each message stands in its conversation's reply tree.

    A message hangs on the one it quotes, or on the one before it. A branch is a run of messages that each hang on the one
    before; it is named by its first turn. ``path`` lists the branches from the first one down to the message's own as
    (minus the turn hung on, branch), so that ascending order of (path, turn) walks the tree depth first, going on
    with a branch before what was hung on it later, and with what hangs lowest first. Only branches that hang on
    an earlier message take part in the rounds, each of which doubles the part of the path that is known.
    """
    order = Window.partitionBy("conv").orderBy("turn")
    joined = ids.join(links, ["conv", "turn"], "left")
    before = F.lag("turn").over(order)
    begins = before.isNull() | F.coalesce(F.col("reply_to") != before, F.lit(False))
    marked = joined.withColumn("mark", F.when(begins, F.col("turn"))).withColumn("branch", F.last("mark", ignorenulls=True).over(order))
    placed = cut(marked.select("conv", "turn", "reply_to", "branch"), "branches")
    at = placed.select("conv", F.col("turn").alias("reply_to"), F.col("branch").alias("up"))
    hung = placed.filter("turn = branch and reply_to is not null").join(at, ["conv", "reply_to"])
    first = placed.groupBy("conv").agg(F.min("turn").alias("first"))
    key = F.struct((-F.col("reply_to")).alias("at"), F.col("branch").alias("branch"))
    root = F.struct(F.lit(None).cast("long").alias("at"), F.col("first").alias("branch"))
    ways = cut(hung.join(first, "conv").select("conv", "branch", F.when(F.col("up") != F.col("first"), F.col("up")).alias("up"), F.when(F.col("up") != F.col("first"), F.array(key)).otherwise(F.array(root, key)).alias("path")), "ways")
    while not ways.filter("up is not null").isEmpty():
        above = ways.select("conv", F.col("branch").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        longer = ways.join(above, ["conv", "up"], "left")
        ways = cut(longer.select("conv", "branch", F.col("next").alias("up"), F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path")), "ways")
    return placed.join(first, "conv").join(ways, ["conv", "branch"], "left").select("conv", "turn", "branch", F.coalesce("path", F.array(root)).alias("path"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per row of ``turns``: ``conv_id, turn, role, reply_to, branch, depth, position, n_quoted, max_level, text``.

    ``text`` is the message without quoted lines, trimmed; ``position`` counts from 0 within a conversation, in the
    order of its reply tree (see ``branches``; ``depth`` is 0 on the first branch). ``n_quoted`` counts quoted lines, ``max_level`` is their deepest nesting (0: none). A null text is an empty
    one. Null conversation ids are one conversation, null turns stand before all others. Rows that share conversation and
    turn are one message for links and have positions in the order of role and text. A quote that no earlier message has
    links to nothing. Very long texts are lines like others. Extra columns are ignored; empty input gives no rows.
    """
    none = -(2**63)
    rows = turns.select(
        "conv_id", F.col("turn").alias("turn_in"), "role", "text", F.coalesce(F.col("conv_id").cast("long"), F.lit(none)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn")
    ).withColumn("row", F.xxhash64("role", "text"))
    links = cut(reply_links(rows.filter(F.col("text").contains(">")).select("conv").distinct().join(rows, "conv")), "replies")
    places = branches(rows.select("conv", "turn").distinct(), links)
    full = F.coalesce("text", F.lit(""))
    lines = F.split(full, "\n", -1)
    quoted = F.filter(F.transform(lines, level), lambda x: x > 0)
    named = rows.join(links, ["conv", "turn"], "left").join(places, ["conv", "turn"])
    at = F.row_number().over(Window.partitionBy("conv").orderBy("path", "turn", "role", "text")) - 1
    return named.select(
        "conv_id", F.col("turn_in").alias("turn"), "role", "reply_to", "branch", (F.size("path") - 1).cast("long").alias("depth"), at.cast("long").alias("position"), F.size(quoted).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(quoted), F.lit(0)).cast("long").alias("max_level"), F.regexp_replace(F.array_join(F.filter(lines, lambda x: level(x) == 0), "\n"), r"^\s+|\s+$", "").alias("text"),
    )
