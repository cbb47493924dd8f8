"""Quotation linking: conversations in reply order, without quotes.

Only DataFrame functions are used.

1. *Parse.*  A line's quote level is the number of ``>`` it begins with.
   Consecutive lines of one level above 0 are a quoted passage.
2. *Hash.*  A passage, each of its lines, and each of its paragraphs (cut at
   its empty lines) is normalised (lower case, white space runs to one
   blank) and hashed; so are a message's own body, paragraphs and lines, for
   those hashes that some message quotes.
3. *Link.*  Each quoted unit is linked to the latest earlier message of its
   conversation that holds it.  A paragraph counts as a unit where neither
   its whole passage nor all of its lines are found (part of a message,
   wrapped anew); else those tell of it.  The units of a message's lowest linked level
   vote with their length: the message with most is the one replied to (of
   equal ones the latest).
4. *Order.*  Following the links leads to the message that began a thread.
   In a conversation threads stand in the order of their first messages and
   messages in a thread in the order of their turns, so every reply stands
   behind what it answers.  A message without links begins a thread.

A conversation, line or message that most rows share is spread over tasks:
latest-earlier lookups and positions are taken in blocks of turns, with a
running value over one row per block.

Null texts count as empty; a null conv_id is a conversation of its own and
null turns come first in it.  Rows that repeat (conv_id, turn) are replied
to as one and keep a row each; empty tables give no rows.  conv_id may have
any type that a string can be cast back to; whole numbers are returned as
long.  Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

BLOCK = 10_000                                            # turns
QUOTE_MARKS = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"(?i)^\s*(on\b.{0,200}\bwrote|le\b.{0,200}\ba écrit|am\b.{0,200}\bschrieb.{0,80}|el\b.{0,200}\bescribió)\s*:\s*$"


def normal(text) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed_lines(text) -> F.Column:
    """array<struct<level, body>> of a text's lines."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)

    def line(raw):
        marks = F.regexp_extract(raw, QUOTE_MARKS, 1)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.cast("int").alias("level"), F.substr(raw, F.length(marks) + 1).alias("body"))

    return F.transform(lines, line)


def own_lines(lines) -> F.Column:
    """The lines of level 0, without a line that announces a quote."""
    following = F.slice(F.transform(lines, lambda x: x["level"]), 2, F.size(lines))
    told = F.zip_with(lines, following, lambda x, after: F.when(
        (x["level"] == 0) & ~((F.coalesce(after, F.lit(0)) > 0) & x["body"].rlike(ATTRIBUTION)), x["body"]))
    return F.filter(told, lambda body: body.isNotNull())


def joined(lines) -> F.Column:
    return F.array_join(lines, "\n")


def own_units(lines) -> F.Column:
    """Normalised body, paragraphs and lines of a message's own text."""
    body = joined(own_lines(lines))
    units = F.concat(F.array(body), F.split(body, r"\n\s*\n", -1), F.split(body, "\n", -1))
    return F.array_distinct(F.filter(F.transform(units, normal), lambda u: u != ""))


def passages(lines) -> F.Column:
    """array<struct<level, body>>: one passage for each run of lines of a level.

    The lines are written one after the other, a line of another level than
    the one before behind a mark and its level, and cut at the marks again,
    in linear time."""
    clear = F.transform(lines, lambda x: F.struct(x["level"].alias("level"),
                                                  F.translate(x["body"], "\x01\x02", "").alias("body")))
    before = F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x["level"]))
    marked = F.zip_with(clear, F.slice(before, 1, F.size(lines)), lambda x, last: F.when(
        x["level"] == last, F.concat(F.lit("\n"), x["body"])).otherwise(
        F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"), x["body"])))
    runs = F.split(F.array_join(marked, ""), "\x01", -1)
    return F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.struct(
        F.substring_index(r, "\x02", 1).cast("int").alias("level"), F.substring_index(r, "\x02", -1).alias("body")))


def quoted_units(lines) -> F.Column:
    """array<struct<level, unit>>: quoted passages and their lines, normalised."""
    whole = F.transform(passages(lines), lambda x: F.struct(x["level"].alias("level"), normal(x["body"]).alias("unit")))
    single = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), normal(x["body"]).alias("unit")))
    return F.filter(F.concat(whole, single), lambda u: (u["level"] > 0) & (u["unit"] != ""))


def quotes(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, weight) of all quoted passages and lines."""
    quoting = messages.where(F.contains("text", F.lit(">"))).select("conv", "turn", parsed_lines(F.col("text")).alias("lines"))
    return (quoting.select("conv", "turn", F.explode(quoted_units(F.col("lines"))).alias("u"))
            .select("conv", "turn", "u.level", F.md5("u.unit").alias("hash"), F.length("u.unit").alias("weight")).distinct())


def paragraphs(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, weight, passage, line): the paragraphs of
    several lines in quoted passages of several paragraphs, once for each
    line, with the hashes of the passage and of the line."""
    quoting = messages.where(F.contains("text", F.lit(">"))).select("conv", "turn", parsed_lines(F.col("text")).alias("lines"))
    whole = (quoting.select("conv", "turn", F.explode(passages(F.col("lines"))).alias("p"))
             .select("conv", "turn", "p.level", "p.body", F.md5(normal(F.col("p.body"))).alias("passage"))
             .where((F.col("level") > 0) & F.col("body").rlike(r"\n\s*\n")))
    cut = (whole.select("conv", "turn", "level", "passage", F.explode(F.split("body", r"\n\s*\n", -1)).alias("body"))
           .where(F.contains("body", F.lit("\n"))).withColumn("unit", normal(F.col("body"))).where("unit != ''")
           .select("conv", "turn", "level", "passage", F.md5("unit").alias("hash"), F.length("unit").alias("weight"), "body"))
    lines = F.filter(F.transform(F.split("body", "\n", -1), normal), lambda x: x != "")
    return (cut.select("conv", "turn", "level", "hash", "weight", "passage", F.explode(lines).alias("line"))
            .withColumn("line", F.md5("line")).distinct())


def with_paragraphs(found: DataFrame, cut: DataFrame) -> DataFrame:
    """``found`` and the paragraphs that are no passage or line: these are ``extra``."""
    more = cut.select("conv", "turn", "level", "hash", "weight", F.lit(True).alias("extra"))
    return (found.withColumn("extra", F.lit(False)).unionByName(more).groupBy("conv", "turn", "level", "hash")
            .agg(F.max("weight").alias("weight"), F.min("extra").alias("extra")))


def telling(linked: DataFrame, cut: DataFrame) -> DataFrame:
    """``linked`` without those paragraphs whose passage or lines are all found."""
    known = linked.where("not extra").select("conv", "turn", "level", "hash")
    lost = cut.select("conv", "turn", "level", "hash", "passage", "line")
    for part in ("line", "passage"):
        lost = lost.join(known.withColumnRenamed("hash", part), ["conv", "turn", "level", part], "left_anti")
    more = linked.where("extra").join(lost.select("conv", "turn", "level", "hash").distinct(), ["conv", "turn", "level", "hash"],
                                      "left_semi")
    return linked.where("not extra").unionByName(more.select(*linked.columns))


def links(messages: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, weight, extra, source): each quoted unit with
    the turn of the latest earlier message that holds it."""
    wanted = found.select("conv", "hash").distinct()
    own = (messages.select("conv", "turn", F.explode(own_units(parsed_lines(F.col("text")))).alias("unit"))
           .select("conv", F.md5("unit").alias("hash"), "turn").join(wanted, ["conv", "hash"], "left_semi").distinct())
    block = F.floor(F.col("turn") / BLOCK)
    events = (own.select("conv", "hash", "turn", F.col("turn").alias("held"), F.lit(None).cast("int").alias("level"),
                         F.lit(None).cast("int").alias("weight"), F.lit(None).cast("boolean").alias("extra"))
              .unionByName(found.select("conv", "hash", "turn", F.lit(None).cast("long").alias("held"), "level", "weight",
                                        "extra"))
              .withColumn("block", block))
    before = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (events.groupBy("conv", "hash", "block").agg(F.max("held").alias("last"))
               .withColumn("carried", F.max("last").over(before)).drop("last"))
    inside = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return (events.withColumn("near", F.max("held").over(inside)).where("level is not null")
            .join(carried, ["conv", "hash", "block"])
            .select("conv", "turn", "level", "hash", "weight", "extra", F.coalesce("near", "carried").alias("source"))
            .where("source is not null"))


def parents(linked: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked)."""
    votes = linked.groupBy("conv", "turn", "level", "source").agg(F.sum("weight").alias("votes"), F.count("*").alias("n"))
    best = F.max(F.struct(-F.col("level"), F.col("votes"), F.col("source")))
    return votes.groupBy("conv", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked")).select(
        "conv", "turn", F.col("best.source").alias("parent"), "n_linked")


def roots(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turn, root): the end of each chain of parents.  Every round
    doubles the steps that a pointer spans."""
    now = scratch.write(linked.select("conv", "turn", F.col("parent").alias("root")), "roots-0")
    nr = 0
    while True:
        ahead = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, ["conv", "root"], "left")
        nr += 1
        now = scratch.write(step.select("conv", "turn", F.coalesce("next", "root").alias("root"),
                                        F.col("next").isNotNull().alias("moved")), f"roots-{nr}")
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, root, turn, ...) with their place in the conversation,
    from 0: rows of earlier blocks of threads, of earlier blocks of turns in
    the same block of threads, and the rank among the rest."""
    blocked = (rows.withColumn("threads", F.floor(F.col("root") / BLOCK)).withColumn("turns", F.floor(F.col("turn") / BLOCK)))
    cells = blocked.groupBy("conv", "threads", "root", "turns").agg(F.count("*").alias("n"))
    blocks = cells.groupBy("conv", "threads").agg(F.sum("n").alias("n"))
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "threads", F.coalesce(F.sum("n").over(ahead("conv").orderBy("threads")), F.lit(0)).alias("p"))
    cells = cells.withColumn("q", F.coalesce(F.sum("n").over(ahead("conv", "threads").orderBy("root", "turns")), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("conv", "threads", "root", "turns").orderBy("turn", "role", "text"))
    return (blocked.withColumn("r", rank).join(cells.drop("n"), ["conv", "threads", "root", "turns"])
            .join(blocks, ["conv", "threads"]).withColumn("position", F.col("p") + F.col("q") + F.col("r") - 1)
            .drop("threads", "turns", "p", "q", "r"))


NULL_TURN = -(1 << 40)


def reply_order(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn (null: begins a
    thread), root_turn, position, n_quoted and n_linked (quoted units, and
    those found), text (without quotes, trimmed)."""
    scratch = Scratch(conversations.sparkSession, "chat-quotes")
    kind = conversations.schema["conv_id"].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else kind
    messages = conversations.select(
        F.coalesce(F.concat(F.lit("0"), F.col("conv_id").cast("string")), F.lit("1")).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NULL_TURN)).alias("turn"), "role", "text")
    found = scratch.write(quotes(messages), "quotes")
    counted = found.groupBy("conv", "turn").agg(F.count("*").alias("n_quoted"))
    if found.limit(1).count():
        cut = scratch.write(paragraphs(messages), "paragraphs")
        units = telling(scratch.write(links(messages, with_paragraphs(found, cut)), "links"), cut)
        counted = (found.select("conv", "turn").unionByName(units.where("extra").select("conv", "turn"))
                   .groupBy("conv", "turn").agg(F.count("*").alias("n_quoted")))
        linked = scratch.write(parents(units), "parents")
        threads = linked.join(roots(linked, scratch), ["conv", "turn"])
        told = counted.join(threads, ["conv", "turn"], "left")
    else:
        told = counted.select("conv", "turn", "n_quoted", *[F.lit(None).cast("long").alias(c)
                                                            for c in ("parent", "n_linked", "root")])
    rows = messages.join(told, ["conv", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    turn = lambda c: F.when(F.col(c) != NULL_TURN, F.col(c))
    body = F.when(F.contains("text", F.lit(">")), F.trim(joined(own_lines(parsed_lines(F.col("text")))), )).otherwise(
        F.trim(F.coalesce("text", F.lit(""))))
    return positions(rows).select(
        F.when(F.col("conv") != "1", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id"), turn("turn").alias("turn"),
        "role", turn("parent").alias("parent_turn"), turn("root").alias("root_turn"), F.col("position").cast("long"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), body.alias("text"))
