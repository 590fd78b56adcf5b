"""Quotation linking: conversations in reply order without their quotes, in DataFrame operations only.

A line's quote level is the number of ``>`` marks at its start (blanks between them don't
count). Runs of lines of one level are passages. A quoted passage is normalised (marks off,
lower case, white space folded) and hashed, and so are all stretches of lines and sentences
of every message's own text that start and number as a quote's do; a passage links its
message to the earlier message of the conversation that holds it, the latest of several. If
none holds it all, its paragraphs and lines are looked up, and the message that holds most
of them is its source. One word alone is matched with whole messages only; a quote that
begins or ends within a sentence of a longer line is not found. A message replies to the source of its last passage of
level 1 (or of the least level it has), or else to the message before it. Its text without
quotes stays; a conversation's messages are ordered by reply: each after the one it replies
to, before that one's later replies.

Null texts are empty messages; a message of quotes only keeps its place with empty text.
Messages that share a turn are ordered by role, then text; rows equal in all of them are
one message with their number in ``copies``. Null ids and turns are a conversation and a place of their own, null turns
first. A quote without a source links nothing and is not in the text, but it is not lost: such
passages are counted in ``n_unlinked`` and kept, with their marks, in ``unlinked`` (null for none;
passages of white space only don't count). Hashes of passages are joined by
conversation and hash, so a passage that very many conversations share meets only its own
conversation. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_files, stage, table, unstage

# Fixed value: marks of quoting at the start of a line.
MARKS = r"^(?:[ \t]*>)+"
# Ends of sentences in folded text; words, of which each letter is one in scripts without blanks.
SENTENCE_END = r"(?<=[.!?\u2026] )|(?<=[.!?\u2026][\"')\]] )|(?<=[\u3002\uff01\uff1f])"
WORDS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"
#: Words below which a passage is too short to tell its source by, unless it is a whole message.
LEAST_WORDS = 2


def _fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with mid (place in the conversation) and lines (level, text)."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(_level(x).alias("level"), F.trim(F.regexp_replace(x, MARKS, "")).alias("line")))
    return rows.withColumn("mid", F.row_number().over(order)).withColumn("lines", lines)


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, joined: array of (level, text)."""
    empty = F.expr("cast(array() as array<struct<level:int,text:string>>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        one = F.struct(x["level"].cast("int").alias("level"), x["line"].alias("text"))
        joined = F.struct(last["level"].alias("level"), F.concat(last["text"], F.lit("\n"), x["line"]).alias("text"))
        return F.when((F.size(acc) > 0) & (last["level"] == x["level"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(lines, empty, add)


def _sentences(folded: Column) -> Column:
    """The sentences of a folded text, each with the blank that follows it."""
    return F.filter(F.split(folded, SENTENCE_END), lambda x: x != "")


def _pieces(text: Column) -> Column:
    """Two cuts of a text: at the ends of lines and sentences, and, for rewrapped text, of sentences only."""
    lines = F.filter(F.transform(F.split(text, "\n"), _fold), lambda x: x != "")
    return F.array(F.flatten(F.transform(lines, lambda x: _sentences(F.concat(x, F.lit(" "))))), _sentences(_fold(text)))


def _own(lines: Column) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")


def _unlinked(lines: Column, linked: Column) -> Column:
    """The quoted passages, with their marks, whose places are not among the linked ones."""
    kept = F.filter(_passages(lines), lambda x, i: (x["level"] > 0) & (F.trim(x["text"], F.lit(" \t\n")) != "") & ~F.array_contains(linked, i))

    def marked(x: Column) -> Column:
        marks = F.concat(F.repeat(F.lit(">"), x["level"]), F.lit(" "))
        return F.array_join(F.transform(F.split(x["text"], "\n"), lambda line: F.concat(marks, line)), "\n")

    return F.transform(kept, marked)


def _starts(cuts: Column) -> Column:
    """(pieces, their number, hash of the first) of each cut."""
    return F.transform(cuts, lambda c: F.struct(F.size(c).alias("k"), F.xxhash64(F.trim(F.try_element_at(c, F.lit(1)))).alias("first")))


def link_quotes(msgs: DataFrame) -> DataFrame:
    """Links (conv_id, mid, pos, level, source) from quoting messages to the quoted ones."""
    runs = msgs.where("text like '%>%'").select("conv_id", "mid", F.posexplode(_passages(F.col("lines"))).alias("pos", "p"))
    runs = runs.where("p.level > 0").select("conv_id", "mid", "pos", F.col("p.level").alias("level"), F.col("p.text").alias("text"))
    # a passage, and for passages without a source their paragraphs and lines
    parts = F.array_distinct(F.concat(F.split("text", r"\n[ \t]*\n"), F.split("text", "\n")))
    asked = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("part"))), F.transform(parts, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("part"))))
    asked = runs.select("conv_id", "mid", "pos", "level", F.inline(asked)).withColumn("folded", _fold(F.col("part"))).where("folded != ''")
    # short ones are told only by whole messages
    short = F.regexp_count("folded", F.lit(WORDS)) < LEAST_WORDS
    asked = asked.withColumn("short", short).where("whole or not short")
    asked = stage(asked.select("conv_id", "mid", "pos", "level", "whole", "short", F.length("folded").alias("n"), F.xxhash64("folded", F.col("short").cast("int")).alias("h"), _starts(_pieces(F.col("part"))).alias("starts")), "quote-asked")
    # only conversations with quotes matter; of their messages, stretches of pieces that start as a quote does and are as long
    held = msgs.join(asked.select(F.col("conv_id").alias("c")).distinct(), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    held = stage(held.select("conv_id", "mid", _own(F.col("lines")).alias("own")).withColumn("cuts", _pieces(F.col("own"))), "quote-held")
    wanted = asked.where("not short").select(F.col("conv_id").alias("c"), F.inline("starts")).distinct()
    begins = held.select("conv_id", "mid", F.posexplode("cuts").alias("cut", "pieces"))
    begins = begins.select("conv_id", "mid", "cut", F.size("pieces").alias("size"), F.posexplode(F.transform("pieces", lambda x: F.xxhash64(F.trim(x)))).alias("i", "begin"))
    begins = begins.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("begin") == F.col("first")) & (F.col("i") + F.col("k") <= F.col("size")))
    begins = begins.groupBy(F.col("conv_id").alias("c"), F.col("mid").alias("m")).agg(F.collect_set(F.struct("cut", "i", "k")).alias("stretches"))
    stretches = F.transform("stretches", lambda x: F.xxhash64(F.trim(F.array_join(F.slice(F.col("cuts")[x["cut"]], x["i"] + 1, x["k"]), "")), F.lit(0)))
    cut = held.join(begins, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mid") == F.col("m"))).select("conv_id", "mid", F.explode(F.array_distinct(stretches)).alias("h"))
    whole = held.select("conv_id", "mid", F.explode(F.array(*[F.xxhash64(_fold(F.col("own")), F.lit(x)) for x in (0, 1)])).alias("h"))
    # the latest holder before each quote, in one pass over the holders and quotes of a hash
    none = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("level", "int"), ("whole", "boolean"), ("n", "int"))]
    both = cut.unionByName(whole).select("conv_id", "mid", "h", *none, F.col("mid").alias("held")).unionByName(asked.select("conv_id", "mid", "h", "pos", F.col("level").cast("int"), "whole", "n", F.lit(None).cast("int").alias("held")))
    earlier = Window.partitionBy("conv_id", "h").orderBy("mid").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.max("held").over(earlier)).where("pos is not null and source is not null")
    # the whole passage's source, or else the one that holds most of its parts, the latest of several
    found = found.groupBy("conv_id", "mid", "pos", "level", "source").agg(F.max("whole").alias("whole"), F.sum("n").alias("n"))
    return found.groupBy("conv_id", "mid", "pos", "level").agg(F.max(F.struct("whole", "n", "source"))["source"].alias("source"))


def link_conversations(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, place (in reply order), turn, role, text without quotes, reply_to (a turn), n_quotes, depth, copies, n_unlinked, unlinked."""
    msgs = stage(messages(conversations), "quote-messages")
    links = link_quotes(msgs)
    target = links.groupBy("conv_id", "mid").agg(F.min(F.struct("level", (-F.col("pos")).alias("pos"), "source"))["source"].alias("source"), F.count(F.lit(1)).alias("n_quotes"), F.collect_set("pos").alias("linked"))
    target = target.select(F.col("conv_id").alias("c"), F.col("mid").alias("m"), "source", "n_quotes", "linked")
    text = F.trim(_own(F.col("lines")), F.lit("\n "))
    rows = msgs.join(target, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mid") == F.col("m")), "left")
    without = F.when(F.col("text").contains(">"), _unlinked(F.col("lines"), F.coalesce("linked", F.expr("cast(array() as array<int>)"))))
    without = F.when(F.size(without) > 0, without)
    rows = rows.select("conv_id", "mid", "turn", "role", without.alias("without"), text.alias("text"), F.coalesce("source", F.when(F.col("mid") > 1, F.col("mid") - 1)).alias("parent"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), "copies")
    without = (F.coalesce(F.size("without"), F.lit(0)).alias("n_unlinked"), F.array_join("without", "\n\n").alias("unlinked"))
    rows = stage(rows.select(*(c for c in rows.columns if c != "without"), *without), "quote-parents")
    # a conversation whose messages all reply to the one before is in order as it is
    whole = Window.partitionBy("conv_id").orderBy("mid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("branched", F.max(F.coalesce(F.col("parent") != F.col("mid") - 1, F.lit(False))).over(whole))
    plain = rows.where("not branched").withColumn("reply_to", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("mid")))
    plain = plain.select("conv_id", F.col("mid").alias("place"), "turn", "role", "text", "reply_to", "n_quotes", (F.col("mid") - 1).alias("depth"), "copies", "n_unlinked", "unlinked")
    rows = stage(rows.where("branched").drop("branched"), "quote-branched")
    if rows.isEmpty():
        return plain
    places = _reply_places(rows).select(F.col("conv_id").alias("c"), F.col("mid").alias("m"), "place", "depth")
    up = rows.select(F.col("conv_id").alias("c2"), F.col("mid").alias("m2"), F.col("turn").alias("reply_to"))
    out = rows.join(places, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mid") == F.col("m")))
    out = out.join(up, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("parent") == F.col("m2")), "left")
    return plain.unionByName(out.select("conv_id", "place", "turn", "role", "text", "reply_to", "n_quotes", "depth", "copies", "n_unlinked", "unlinked"))


def _reply_places(rows: DataFrame) -> DataFrame:
    """conv_id, mid, place and depth in reply order, for trees of any depth.

    A walk round the tree enters (2 * mid) and leaves (2 * mid + 1) each message once. Every
    step knows the one before it; doubling those pointers counts the steps up to each, in
    rounds that grow with the log2 of a conversation's messages. A message's place is the
    number of messages entered so far, its depth that of those entered and not left.
    """
    last = rows.groupBy(F.col("conv_id").alias("c"), F.col("parent").alias("p")).agg(F.max("mid").alias("last"))
    before = F.lag("mid").over(Window.partitionBy("conv_id", "parent").orderBy("mid"))
    walk = rows.select("conv_id", "mid", "parent", before.alias("before")).join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mid") == F.col("p")), "left")
    enter = F.struct((2 * F.col("mid")).alias("step"), F.coalesce(2 * F.col("before") + 1, 2 * F.col("parent")).alias("back"), F.lit(1).alias("entered"), F.lit(0).alias("left"))
    leave = F.struct((2 * F.col("mid") + 1).alias("step"), F.coalesce(2 * F.col("last") + 1, 2 * F.col("mid")).alias("back"), F.lit(0).alias("entered"), F.lit(1).alias("left"))
    now = stage(walk.select("conv_id", F.inline(F.array(enter, leave))), "quote-walk")
    while not now.where("back is not null").isEmpty():
        there = now.select(F.col("conv_id").alias("c"), F.col("step").alias("s"), F.col("back").alias("back2"), F.col("entered").alias("entered2"), F.col("left").alias("left2"))
        moved = now.where("back is not null").join(there, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("back") == F.col("s")))
        moved = moved.select("conv_id", "step", F.col("back2").alias("back"), (F.col("entered") + F.col("entered2")).alias("entered"), (F.col("left") + F.col("left2")).alias("left"))
        done, now = now, stage(moved.unionByName(now.where("back is null")), "quote-walk")
        unstage(done)
    return now.where("step % 2 = 0").select("conv_id", F.expr("cast(step div 2 as int)").alias("mid"), F.col("entered").alias("place"), (F.col("entered") - F.col("left") - 1).alias("depth"))


def op7_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(link_conversations(table(spark, sf_dir, "conversations")))


QUERIES = {"op7_quote_linking": op7_quote_linking}
