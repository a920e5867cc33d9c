"""Chat formatting: quotation linking.

1. Lines are read for their quote level (leading ">" signs, with or without spaces between). A passage is a run of lines
   of one level; level 0 is the message's own text.
2. Quoted passages are normalised (quote signs gone, lower case, letters and digits only) and hashed, as a whole, by
   paragraph and by line.
3. Own passages are hashed the same way and joined to the quoted ones by hash. Of all originals the one to link to is: in
   the same conversation and before the quoting message if there is one (else in another conversation, the first that
   isn't the quoting one), the longest equal passage, the latest turn before.
   A message replies to the original of its first passage of level 1 that is found (else of the lowest level found).
4. Links within a conversation are followed to the thread's first message by repeated joins (each round doubles the
   distance), and messages are put in order: threads by their first message, in a thread by turn, so that a message
   follows what it replies to. Without quotes a conversation is in order of turns, as one thread per message.

Attribution lines ("X wrote:" directly before a quote) are taken off. The order number of a message is counted by
ranges of (conversation, thread, turn), not in one window per conversation, so that one huge conversation is no single
task. Paragraphs and lines of a quote that are shorter than ``LEAST_CHARS`` normalised characters aren't linked on their
own; a whole quote of fewer is linked within its conversation only.

Edge cases: null or empty texts have no passage and stay as empty messages; a very long quote is read line by line and
hashed once per line, paragraph and run; rows of equal (conv_id, turn) each stay,
ordered by role and text; rows without conv_id or turn are never linked and come first; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import running
from .common import running_offsets, stage, table

LEAST_CHARS = 12
QUOTE = r"^\s*(?:>\s*)+"
WROTE = r"(?i)^.{0,200}\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def level_of(line) -> F.Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[^>]", ""))


def normal(text) -> F.Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _keyed(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` with ``lines``: array of (level, body), attribution lines before quotes taken off."""
    lines = F.transform(F.split("text", "\r\n|\r|\n"), lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body")))
    rows = messages.withColumn("lines", lines)
    before = F.filter("lines", lambda x, i: ~((x.level == 0) & x.body.rlike(WROTE) & (F.coalesce(F.get(F.col("lines.level"), i + 1), F.lit(0)) > 0)))
    return rows.withColumn("lines", before)


def _passages() -> F.Column:
    """Runs of lines of one level: array of (level, body), bodies joined by newlines."""
    n, level = F.size("lines"), F.col("lines.level")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(level, i) != F.get(level, i - 1)))

    def run(first, place):
        end = F.coalesce(F.get(starts, place + 1), n)
        return F.struct(F.get(level, first).alias("level"), F.array_join(F.slice(F.col("lines.body"), first + 1, end - first), "\n").alias("body"))

    return F.transform(starts, run)


def own_text(lines) -> F.Column:
    """The message without its quotes; blank lines at the ends and doubled ones go."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x.level == 0), lambda x: x.body), "\n")
    return F.regexp_replace(F.regexp_replace(own, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def quoted_passages(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, place, level, hash, size) of quoted passages; only messages with a quote are looked at."""
    some = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.exists("lines", lambda x: x.level > 0))
    some = some.select("conv_id", "turn", "lines")
    rows = some.select("conv_id", "turn", F.posexplode(_passages()).alias("place", "p")).where("p.level > 0")
    whole, body = normal(F.col("p.body")), F.col("p.body")
    parts = F.filter(F.transform(F.concat(F.split(body, r"\n\s*\n"), F.split(body, "\n")), normal), lambda x: F.length(x) >= LEAST_CHARS)
    rows = rows.select("conv_id", "turn", "place", F.col("p.level").alias("level"), F.explode(F.array_distinct(F.concat(F.array(whole), parts))).alias("plain"))
    return rows.where(F.length("plain") > 0).select("conv_id", "turn", "place", "level", F.sha2("plain", 256).alias("hash"), F.length("plain").alias("size"))


def own_passages(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, hash): the own text as a whole, its paragraphs, its lines."""
    own = F.col("own")
    pieces = F.array_distinct(F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n")))
    rows = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", own_text(F.col("lines")).alias("own"))
    rows = rows.select("conv_id", "turn", F.explode(F.transform(pieces, normal)).alias("plain")).where(F.length("plain") > 0)
    return rows.select("conv_id", "turn", F.sha2("plain", 256).alias("hash")).distinct()


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn, level, size): what each quoting message replies to."""
    quotes = stage(quoted_passages(parsed), "quotes")
    if quotes.isEmpty():  # no quote, nothing to look for
        return quotes.select("conv_id", "turn", F.lit(None).cast("long").alias("to_conv"), F.lit(None).cast("long").alias("to_turn"), "level", "size")
    # of the same conversation the latest before, by running maxima over the turns of equal passages alone, in buckets of
    # turns, so that a passage that one conversation repeats all the time is no single task; of other conversations the
    # first two, so that one is not the quoting one: aggregations with partial sums
    own = own_passages(parsed).join(quotes.select("hash").distinct(), "hash", "left_semi")
    own = stage(own, "own")
    turns = quotes.withColumn("own", F.lit(None).cast("long")).unionByName(own.select("conv_id", "turn", "hash", F.col("turn").alias("own")), allowMissingColumns=True)
    turns = turns.withColumn("is_own", F.col("own").isNotNull().cast("int"))  # a turn's quotes stand before its own passages
    turns = running(turns, ["hash", "conv_id"], ["turn", "is_own"], F.col("own"), "to_turn", kind="max", bucket=4096, own=False)
    here = turns.where("own is null and to_turn is not null")
    here = here.groupBy("conv_id", "turn", "place", "level", "size").agg(F.max("to_turn").alias("to_turn")).withColumn("to_conv", F.col("conv_id"))
    first = stage(own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("o")), "first")
    second = own.join(first, "hash").where(F.col("conv_id") != F.col("o.conv_id")).groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("o2"))
    first = first.join(second, "hash", "left")
    there = quotes.where(F.col("size") >= LEAST_CHARS).join(here.select("conv_id", "turn", "place").distinct(), ["conv_id", "turn", "place"], "left_anti").join(first, "hash").withColumn("o", F.when(F.col("o.conv_id") != F.col("conv_id"), F.col("o")).otherwise(F.col("o2"))).where(F.col("o").isNotNull())
    there = there.select("conv_id", "turn", "place", "level", "size", F.col("o.turn").alias("to_turn"), F.col("o.conv_id").alias("to_conv"))
    found = here.select("conv_id", "turn", "place", "level", "size", "to_turn", "to_conv").unionByName(there)
    best = found.groupBy("conv_id", "turn").agg(F.min(F.struct((F.col("to_conv") != F.col("conv_id")).alias("far"), "level", (-F.col("size")).alias("less"), (-F.col("to_turn")).alias("late"), "place", "to_conv")).alias("m"))
    return best.select("conv_id", "turn", F.col("m.to_conv").alias("to_conv"), (-F.col("m.late")).alias("to_turn"), F.col("m.level").alias("level"), (-F.col("m.less")).alias("size"))


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of messages that reply within their conversation, by doubled steps."""
    near = links.where("to_conv = conv_id").select("conv_id", "turn", F.col("to_turn").alias("root"), F.lit(1).alias("depth"))
    now = stage(near, "roots")
    if now.isEmpty():
        return now
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        stepped = now.join(up, ["conv_id", "root"], "left")
        moved = stage(stepped.select("conv_id", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "roots")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``number`` from 0 in the given order over all rows: ranges are sorted and counted on their own."""
    spread = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = running_offsets(spread.groupBy("range").agg(F.count("*").alias("n")), ["range"], "n", "before").select("range", "before")
    return spread.join(F.broadcast(sizes), "range").withColumn("number", F.col("before") + F.col("at")).drop("range", "at", "before")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message, in reply order: (conv_id, turn, role, text, position, thread, depth, reply_to_conv,
    reply_to_turn, n_quoted, max_level); ``text`` is without quotes, ``position`` counts from 0 in the conversation."""
    parsed = parse(_keyed(messages))
    links = stage(link(parsed), "replies")
    roots = thread_roots(links)
    quoted = F.filter("lines", lambda x: x.level > 0)
    rows = parsed.select("conv_id", "turn", "role", own_text(F.col("lines")).alias("text"), F.size(quoted).alias("n_quoted"), F.coalesce(F.array_max(F.col("lines.level")), F.lit(0)).alias("max_level"))
    rows = rows.join(links.select("conv_id", "turn", F.col("to_conv").alias("reply_to_conv"), F.col("to_turn").alias("reply_to_turn")), ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    rows = rows.withColumn("thread", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0))).drop("root")
    rows = numbered(rows, ["conv_id", "thread", "turn", "role", "text"])
    first = rows.groupBy("conv_id").agg(F.min("number").alias("first"))
    rows = rows.join(first.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("position", F.col("number") - F.col("first"))
    return rows.select("conv_id", "turn", "role", "text", "position", "thread", "depth", "reply_to_conv", "reply_to_turn", "n_quoted", "max_level")


def op4_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
