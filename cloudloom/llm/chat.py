"""Chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is the number of ">" before its text. Adjacent lines of one level above 0 are a quoted passage; its hash is
over its text with case and white space evened out. Messages are hashed as a whole and by line, both without their quotes; a
passage is joined within its conversation to the earliest message with the same whole, else its different lines are joined to all
earlier messages with such a line and the message with the most of them, then the earliest, is taken. Passages of the lowest level are what a
message replies to; of several originals the latest one counts, and only turns before the message's own count.

Result: one row for each message, in reply order: conv_id, then the turn of the thread's first message, depth, turn. reply_to is
null for a message that quotes nothing known. body is the text without quoted lines, trimmed; message is the body in chat form.
Null text counts as empty; null role as "user"; messages with null conv_id or turn quote nothing. Rows that repeat a
(conv_id, turn) are rows each, and reply to what any of them quotes. A message of any length is read whole. An empty table gives
no rows. Only conv_id, turn, role and text are read, whatever other columns there are. Work is by message and by (conversation,
hash): no task needs a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import cut, table

QUOTED = r"(?:^|\n)[ \t]{0,3}>"
MARKS = r"^(?:[ \t]{0,3}>)+"


def evened(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def hashed(text: Column) -> Column:
    return F.md5(evened(text).cast("binary"))


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def body(text: Column) -> Column:
    """The text without quoted lines, trimmed."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: ~F.rlike(s, F.lit(MARKS)))
    return F.when(F.rlike(text, F.lit(QUOTED)), F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""))).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage (its number) and text of quoted passages; messages: conv_id, turn, text."""
    quoting = messages.where(F.rlike("text", F.lit(QUOTED))).withColumn("row", F.monotonically_increasing_id())
    lines = quoting.select("conv_id", "turn", "row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("conv_id", "turn", "row", "at", level(F.col("line")).alias("level"), F.regexp_replace("line", MARKS, "").alias("line"))
    message = Window.partitionBy("row", "conv_id", "turn").orderBy("at")
    begins = F.coalesce(F.col("level") != F.lag("level").over(message), F.lit(True))
    numbered = lines.withColumn("begins", begins.cast("int")).withColumn("passage", F.sum("begins").over(message))
    grouped = numbered.where("level > 0").groupBy("conv_id", "turn", "row", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    return grouped.select("conv_id", "turn", "row", "passage", "level", F.col("lines.line").alias("lines")).withColumn("text", F.array_join("lines", "\n"))


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn and reply_to of messages that quote a known message."""
    known = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    quoted = cut(passages(known), "passages")
    if quoted.isEmpty():
        return known.where("false").select("conv_id", "turn", F.col("turn").alias("reply_to"))
    convs = quoted.select("conv_id").distinct()
    bodies = known.join(convs, "conv_id", "left_semi").select("conv_id", F.col("turn").alias("origin"), body(F.col("text")).alias("body")).where("body <> ''")
    whole = bodies.groupBy("conv_id", hashed(F.col("body")).alias("hash")).agg(F.min("origin").alias("origin"))
    by_line = bodies.select("conv_id", "origin", F.explode(F.split("body", "\n", -1)).alias("line")).where(evened(F.col("line")) != "")
    by_line = by_line.select("conv_id", "origin", hashed(F.col("line")).alias("hash")).distinct()
    first_by_line = by_line.groupBy("conv_id", "hash").agg(F.min("origin").alias("origin"))
    lowest = quoted.groupBy("conv_id", "turn", "row").agg(F.min("level").alias("level"))
    direct = quoted.join(lowest, ["conv_id", "turn", "row", "level"])
    full = direct.withColumn("hash", hashed(F.col("text"))).join(whole, ["conv_id", "hash"]).where("origin < turn").select("conv_id", "turn", "row", "passage", "origin")
    different = F.array_distinct(F.transform(F.filter("lines", lambda s: evened(s) != ""), hashed))
    left = direct.join(full.select("row", "passage"), ["row", "passage"], "left_anti").select("conv_id", "turn", "row", "passage", different.alias("hashes"))
    lines = left.select("conv_id", "turn", "row", "passage", F.size("hashes").alias("of"), F.explode("hashes").alias("hash"))
    one = lines.where("of = 1").join(first_by_line, ["conv_id", "hash"]).where("origin < turn").select("conv_id", "turn", "row", "passage", "origin")  # all have one vote
    votes = lines.where("of > 1").join(by_line, ["conv_id", "hash"]).where("origin < turn").groupBy("conv_id", "turn", "row", "passage", "origin").agg(F.count(F.lit(1)).alias("n"))
    part = votes.groupBy("conv_id", "turn", "row", "passage").agg(F.max(F.struct("n", (-F.col("origin")).alias("less"))).alias("best")).select("conv_id", "turn", "row", "passage", (-F.col("best.less")).alias("origin"))
    return full.union(one).union(part).groupBy("conv_id", "turn").agg(F.max("origin").alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, root and depth of messages with a reply_to, by doubling the steps to the root."""
    at = cut(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        after = cut(at.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", "reply_to", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "threads")
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, message, reply_to, root, depth for each row of messages, in reply order."""
    messages = messages.select("conv_id", "turn", "role", "text")
    links = cut(replies(messages), "replies")
    placed = messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), body(F.coalesce("text", F.lit(""))).alias("body"))
    if links.isEmpty():
        out = placed.withColumn("reply_to", F.lit(None).cast("long")).withColumn("root", F.col("turn")).withColumn("depth", F.lit(0).cast("long"))
    else:
        out = placed.join(threads(links), ["conv_id", "turn"], "left").withColumns({"root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long"))})
    message = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>"))
    return out.select("conv_id", "turn", "role", "body", message.alias("message"), "reply_to", "root", "depth").orderBy("conv_id", "root", "depth", "turn", "role", "body")


def query(spark, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


_EVEN = r"lower(trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))"
SQL = rf"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
ln AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM m),
mk AS (SELECT *, regexp_extract(line, '^(?:[ \t]{{0,3}}>)+') AS mark FROM ln),
lv AS MATERIALIZED (SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS rest FROM mk),
bd AS MATERIALIZED (SELECT rid, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE level = 0), ''), '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '') AS body FROM lv GROUP BY rid),
ps AS (SELECT *, sum(begins) OVER (PARTITION BY rid ORDER BY place) AS passage FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY rid ORDER BY place) THEN 0 ELSE 1 END AS begins FROM lv)),
pa AS (SELECT *, min(level) OVER (PARTITION BY rid) AS lowest FROM (SELECT rid, conv_id, turn, passage, level, {_EVEN.format("string_agg(rest, chr(10) ORDER BY place)")} AS whole, list_distinct(list_filter(list({_EVEN.format("rest")}), lambda x: x <> '')) AS wanted
  FROM ps WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY rid, conv_id, turn, passage, level)),
direct AS MATERIALIZED (SELECT * FROM pa WHERE level = lowest),
og AS MATERIALIZED (SELECT conv_id, turn AS origin, body, {_EVEN.format("body")} AS whole FROM m JOIN bd USING (rid) WHERE body <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
ful AS MATERIALIZED (SELECT rid, passage, min(origin) AS origin FROM direct JOIN og USING (conv_id, whole) GROUP BY rid, passage, turn HAVING min(origin) < turn),
ol AS MATERIALIZED (SELECT DISTINCT conv_id, origin, line FROM (SELECT conv_id, origin, {_EVEN.format("line")} AS line FROM (SELECT conv_id, origin, unnest(string_split(body, chr(10))) AS line FROM og)) WHERE line <> ''),
vo AS (SELECT rid, passage, origin, count(*) AS n FROM (SELECT rid, conv_id, turn, passage, unnest(wanted) AS line FROM direct ANTI JOIN ful USING (rid, passage)) JOIN ol USING (conv_id, line) WHERE origin < turn GROUP BY rid, passage, origin),
hit AS (SELECT rid, origin FROM ful UNION ALL SELECT rid, arg_max(origin, struct_pack(n := n, o := -origin)) FROM vo GROUP BY rid, passage),
rp AS MATERIALIZED (SELECT conv_id, turn, max(origin) AS reply_to FROM hit JOIN m USING (rid) GROUP BY conv_id, turn),
th AS (SELECT conv_id, turn, reply_to, reply_to AS root, 1 AS depth FROM rp UNION ALL SELECT t.conv_id, t.turn, t.reply_to, r.reply_to, t.depth + 1 FROM th t JOIN rp r ON r.conv_id = t.conv_id AND r.turn = t.root),
top AS (SELECT conv_id, turn, reply_to, arg_max(root, depth) AS root, max(depth) AS depth FROM th GROUP BY conv_id, turn, reply_to)
SELECT m.conv_id, m.turn, role, body, '<|' || role || '|>' || chr(10) || body || chr(10) || '<|end|>' AS message, reply_to, coalesce(root, m.turn) AS root, CAST(coalesce(depth, 0) AS BIGINT) AS depth
FROM m JOIN bd USING (rid) LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
"""
