"""Chat formatting by quotation linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

QUOTE = r"^[ \t]*((?:>[ \t]*)+)"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), "[^>]", ""))


def _plain(text: Column) -> Column:
    """Normalised passage: lower case, white space as single spaces, none at the ends."""
    return F.btrim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("line")))


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", least_words: int = 5) -> DataFrame:
    """One row per message: conversation, turn, role, text without quotes, reply_to, reply_conv, thread, rendered.

    Lines that begin with `>` are quoted, as deep as they have marks; lines of one depth in a row are a
    passage. Its normalised hash is joined to earlier messages of the conversation whose own text,
    a paragraph or a line of it is the same; the latest such message is its source. A passage that
    is none of these has as source the latest earlier message whose own text holds all its lines, or
    all its paragraphs, one after another (blank lines do not count). A message replies
    to the source of its shallowest passages (most passages, then the latest). Where the conversation has none,
    a passage of least_words words or more is joined to the messages of all other conversations; the first by
    conversation and turn is the source, in reply_conv and reply_to, and the message stays in its own conversation.
    thread is the turn at the root of its replies there (its own turn without one), so the order
    (conversation, thread, turn) puts every reply after its message. rendered is the chat form.

    Null text is empty; null conversations and turns link with nothing and are their own thread (null);
    an unknown role is rendered as given, a null one as `user`; repeated rows each give a row; an empty table
    gives an empty result; other columns are not read.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), _lines(F.col(text_col)).alias("lines"))
    own = F.btrim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(" \t\r\n"))
    rows = written(rows.select("conv", "turn", "role", own.alias("own"), F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), x["level"].alias("level"), x["line"].alias("line"))), lambda x: x["level"] > 0).alias("quoted")), "messages")
    parent = written(_parents(rows.where("conv is not null and turn is not null"), least_words), "parents")
    roots = _roots(parent.where("conv = reply_conv").drop("reply_conv"))
    out = rows.join(parent, ["conv", "turn"], "left").join(roots.select("conv", "turn", "root"), ["conv", "turn"], "left").withColumn("thread", F.coalesce("root", "turn"))
    mark = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("own"), F.lit("\n"))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("own").alias(text_col), "reply_to", "reply_conv", "thread", mark.alias("rendered"))


def _units(text: Column, kind: str) -> Column:
    """Hashes of the text's lines or paragraphs, in order, without blank ones."""
    parts = F.transform(F.split(text, "\n" if kind == "line" else r"\n[ \t]*\n"), _plain)
    return F.transform(F.filter(parts, lambda x: x != ""), F.md5)


def _latest(originals: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (conv, hash, turn, ...) with source: the latest earlier turn of originals with the hash, in one sorted pass for each hash."""
    extra = [c for c in wanted.columns if c not in ("conv", "hash", "turn")]
    both = originals.select("conv", "hash", "turn", F.lit(1).alias("kind"), *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in extra])
    both = both.join(wanted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    both = both.unionByName(wanted.select("conv", "hash", "turn", F.lit(0).alias("kind"), *extra))
    before = Window.partitionBy("conv", "hash").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    source = F.last(F.when(F.col("kind") == 1, F.col("turn")), ignorenulls=True).over(before)
    return both.withColumn("source", source).where("kind = 0").withColumn("source", F.expr("case when source < turn then source end")).drop("kind")


def _held(rows: DataFrame, left: DataFrame, kind: str) -> DataFrame:
    """left (conv, turn, level, run, text) with source: the latest earlier message that holds the units of text in a row.

    Only stretches of an original are hashed that begin with the first unit of a wanted passage and
    have its length; they are cut once a message, so no array is repeated by line.
    """
    whole = lambda x: F.md5(F.array_join(x, ","))
    wanted = left.withColumn("units", _units(F.col("text"), kind)).where(F.size("units") > 1)
    wanted = wanted.select("conv", "turn", "level", "run", whole(F.col("units")).alias("hash"), F.col("units")[0].alias("first"), F.size("units").alias("n"))
    parts = rows.select("conv", "turn", _units(F.col("own"), kind).alias("units")).where(F.size("units") > 1)
    cuts = parts.select("conv", "turn", F.posexplode("units").alias("at", "first")).join(wanted.select("conv", "first", "n").distinct(), ["conv", "first"])
    cuts = cuts.groupBy("conv", "turn").agg(F.collect_set(F.struct("at", "n")).alias("cuts"))
    held = parts.join(cuts, ["conv", "turn"]).select("conv", "turn", F.explode(F.array_distinct(F.transform("cuts", lambda c: whole(F.slice("units", c["at"] + 1, c["n"]))))).alias("hash"))
    return _latest(held, wanted.drop("first", "n"))


def _parents(rows: DataFrame, least_words: int) -> DataFrame:
    """(conv, turn, reply_to, reply_conv) for the messages with a linked quotation."""
    lines = rows.where("size(quoted) > 0").select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.*")
    run = F.col("at") - F.row_number().over(Window.partitionBy("conv", "turn", "level").orderBy("at"))
    passages = lines.withColumn("run", run).groupBy("conv", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    text = F.array_join("x.line", "\n")
    passages = passages.select("conv", "turn", "level", "run", text.alias("text"), F.md5(_plain(text)).alias("hash")).where(_plain(F.col("text")) != "")
    units = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    units = F.array_distinct(F.filter(F.transform(units, _plain), lambda x: x != ""))
    originals = rows.select("conv", "turn", F.explode(units).alias("unit")).select("conv", "turn", F.md5("unit").alias("hash"), (F.size(F.split("unit", " ")) >= least_words).alias("long"))
    first = written(_latest(originals.drop("long"), passages), "passages")
    left = first.where("source is null").select("conv", "turn", "level", "run", "text")
    found = _held(rows, left, "line").unionByName(_held(rows, left, "paragraph")).groupBy("conv", "turn", "level", "run").agg(F.max("source").alias("source"))
    key = ["conv", "turn", "level", "run"]
    links = written(first.select(*key, "source").unionByName(found.select(*key, "source")).where("source is not null"), "links")
    # what a conversation does not hold: by hash over all of them, of which one row a wanted passage comes back
    wanted = first.where("source is null").join(links.select("conv", "turn").distinct(), ["conv", "turn"], "left_anti").where(F.size(F.split(_plain(F.col("text")), " ")) >= least_words).select(*key, "hash")
    other = originals.where("long").join(wanted.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("x"))
    away = wanted.join(other, "hash").select(*key, F.col("x.turn").alias("source"), F.col("x.conv").alias("reply_conv")).where("reply_conv <> conv")
    counted = links.withColumn("reply_conv", F.col("conv")).unionByName(away).groupBy("conv", "turn", "level", "source", "reply_conv").count()
    best = F.max_by(F.struct("source", "reply_conv"), F.struct(-F.col("level"), F.col("count"), F.col("source"))).alias("x")
    return counted.groupBy("conv", "turn").agg(best).select("conv", "turn", F.col("x.source").alias("reply_to"), F.col("x.reply_conv").alias("reply_conv"))


def _roots(parent: DataFrame) -> DataFrame:
    """Follow replies to their roots by pointer doubling: as many joins as the depth has binary digits."""
    now = written(parent.select("conv", "turn", "reply_to", F.col("reply_to").alias("root")), "replies")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        step = written(now.join(up, ["conv", "root"], "left").select("conv", "turn", "reply_to", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "replies")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def transcripts(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", turns: int = 200) -> DataFrame:
    """(conversation, part, n_messages, n_replies, transcript) from linked(): rendered messages in reply order, without quotes.

    Every message follows the one it replies to; threads come by the turn of their root. A part holds the
    threads whose roots lie in `turns` turns in a row, so that a conversation of any length is cut into training examples
    of bounded length (a thread stays whole). Messages without conversation or turn are transcripts of their own.
    """
    placed = F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()
    got = messages.where(placed).groupBy(conv_col, F.floor(F.col("thread") / turns).alias("part")).agg(F.count("*").alias("n_messages"), F.count("reply_to").alias("n_replies"), F.array_sort(F.collect_list(F.struct("thread", turn_col, "rendered"))).alias("x"))
    got = got.select(conv_col, "part", "n_messages", "n_replies", F.array_join("x.rendered", "").alias("transcript"))
    alone = messages.where(~placed).select(conv_col, F.lit(None).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("n_messages"), F.lit(0).cast("bigint").alias("n_replies"), F.col("rendered").alias("transcript"))
    return got.unionByName(alone)
