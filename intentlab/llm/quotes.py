"""Quotation linking: conversations in reply order, without quotes.

1. A line's quote level is the number of ``>`` it begins with (each may follow up
   to three blanks). A passage is a maximal run of lines of one level from
   1 on; a message's own text is its lines of level 0, blank ends removed.
2. A line, and a message's own text as a whole, is normalised (lower case, runs
   of other characters than letters and digits become one blank) and hashed. Per
   conversation the first message that holds a hash is its original.
3. A quoted line joins the original of its hash if that is an earlier turn; a
   passage whose whole text is an earlier message's own text joins it too,
   with the weight of all its lines, so that re-wrapped quotes are found.
   A passage's source is the message with most weight, the latest of equals.
4. A message replies to the source of its heaviest level-1 passage, the
   latest of equals; without one it opens a branch at its own turn.
   ``thread`` lists the turns from the branch's first message on as sortable
   hexadecimal numbers; sorted by it, a conversation is in reply order.

Chains of replies are followed by doubling, so 2**n replies take n rounds.
Only rows are returned, so a conversation of any size fits. Defined results: a null
text is empty; a row without conv_id or turn is alone, without links and
with null thread; repeated (conv_id, turn) rows are one message for
links, whose quotes count together, and keep a row each; empty lines link nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import materialize

QUOTED = r"^(?:[ \t]{0,3}>)+"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    """md5 of the normalised text; null if nothing is left of it."""
    n = normalised(text)
    return F.when(n != "", F.md5(n))


def sortable(turn: Column) -> Column:
    """16 hexadecimal digits in the order of signed numbers."""
    return F.lpad(F.hex(turn.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def linked(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text", keep: tuple = ("role",)) -> DataFrame:
    """conv_id, turn, the ``keep`` columns, text (own), reply_to, depth, thread, n_quotes, n_linked; one row per input row."""
    rows = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), *keep,
                           F.coalesce(F.col(text), F.lit("")).alias("body"))
    lines = F.split("body", r"\r?\n")
    own = F.array_join(F.filter(lines, lambda x: ~x.rlike(QUOTED)), "\n")
    rows = rows.withColumn("text", F.regexp_replace(own, r"^\s+|\s+$", ""))
    placed = rows.where("conv_id is not null and turn is not null")

    # originals: the first turn of a conversation with a line or an own text
    hashes = F.array_union(F.transform(F.split("text", "\n"), digest), F.array(digest(F.col("text"))))
    originals = (placed.select("conv_id", "turn", F.explode(hashes).alias("h")).where("h is not null")
                 .groupBy("conv_id", "h").agg(F.min("turn").alias("source")))

    quoting = placed.where(F.col("body").rlike("(?m)" + QUOTED)).select("conv_id", "turn", F.md5("body").alias("m"), lines.alias("lines")).distinct()
    quoted = quoting.select("conv_id", "turn", "m", F.posexplode("lines").alias("at", "line")).select(
        "conv_id", "turn", "m", "at", level_of(F.col("line")).alias("level"), F.regexp_replace("line", QUOTED, "").alias("line"))
    w = Window.partitionBy("conv_id", "turn", "m").orderBy("at")  # the lines of one message
    quoted = quoted.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(w)).cast("int"))
    quoted = quoted.withColumn("passage", F.sum("new").over(w)).where("level > 0")
    key = ["conv_id", "turn", "m", "passage", "level"]
    whole = quoted.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("all"), F.count("*").alias("n"))
    whole = whole.select(*key, digest(F.array_join(F.col("all.line"), " ")).alias("h"), F.col("n").alias("weight"))
    marks = quoted.select(*key, digest(F.col("line")).alias("h"), F.lit(1).cast("long").alias("weight")).unionByName(whole).where("h is not null")
    met = marks.join(originals, ["conv_id", "h"]).where("source < turn")
    weights = met.groupBy(*key, "source").agg(F.sum("weight").alias("weight"))
    passages = weights.groupBy(*key).agg(F.max(F.struct("weight", "source")).alias("best"))
    passages = materialize(passages.select(*key, "best.weight", "best.source"), "quote-links")
    replies = (passages.where("level = 1").groupBy("conv_id", "turn")
               .agg(F.max(F.struct("weight", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to")))
    n_quotes = whole.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    n_linked = passages.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))

    # chains of replies: top is the farthest ancestor reached, below the turns from it (without it) down to the message
    chain = replies.select("conv_id", "turn", F.col("reply_to").alias("top"), F.concat(F.lit("/"), sortable(F.col("turn"))).alias("below"),
                           F.lit(1).cast("long").alias("depth"))
    while True:
        chain = materialize(chain, "quote-chains")
        up = chain.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("up"), F.col("below").alias("middle"), F.col("depth").alias("more"))
        if chain.join(up, ["conv_id", "top"], "left_semi").isEmpty():
            break
        chain = chain.join(up, ["conv_id", "top"], "left").select(
            "conv_id", "turn", F.coalesce("up", "top").alias("top"), F.concat(F.coalesce("middle", F.lit("")), "below").alias("below"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    chain = chain.select("conv_id", "turn", F.concat(sortable(F.col("top")), "below").alias("below"), "depth")

    out = rows
    for side in (replies, n_quotes, n_linked, chain):
        out = out.join(side, ["conv_id", "turn"], "left")
    thread = F.when(F.col("conv_id").isNotNull(), F.coalesce("below", sortable(F.col("turn"))))
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", *keep, "text", "reply_to", F.coalesce("depth", zero).alias("depth"), thread.alias("thread"),
                      F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"))


def in_reply_order(found: DataFrame) -> DataFrame:
    """Rows dealt and sorted by (conv_id, thread): part files hold conversations in reply order."""
    return found.repartitionByRange("conv_id", "thread").sortWithinPartitions("conv_id", "thread")


#: DuckDB SQL of op7 with the same definitions.
SQL = r"""
WITH RECURSIVE msg AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS body, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
own AS (
  SELECT *, regexp_replace(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '^(?:[ \t]{0,3}>)+')), chr(10)),
    '^\s+|\s+$', '', 'g') AS own_text FROM msg),
marks AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(h), '[^\p{L}\p{N}]+', ' ', 'g')) AS h
  FROM (SELECT conv_id, turn, unnest(list_append(string_split(own_text, chr(10)), own_text)) AS h FROM own)),
originals AS (SELECT conv_id, h, min(turn) AS source FROM marks WHERE h <> '' GROUP BY conv_id, h),
numbered AS (
  SELECT conv_id, turn, md5(body) AS m, i AS pos, lines[i] AS line,
    length(regexp_replace(regexp_extract(lines[i], '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS level
  FROM (SELECT DISTINCT conv_id, turn, body, lines FROM msg WHERE regexp_matches(body, '(?m)^(?:[ \t]{0,3}>)+')),
    LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
runs AS (SELECT *, CASE WHEN level <> lag(level, 1, -1) OVER w THEN 1 ELSE 0 END AS new FROM numbered
  WINDOW w AS (PARTITION BY conv_id, turn, m ORDER BY pos)),
quoted AS (
  SELECT conv_id, turn, m, pos, level, regexp_replace(line, '^(?:[ \t]{0,3}>)+', '') AS line,
    sum(new) OVER (PARTITION BY conv_id, turn, m ORDER BY pos) AS passage FROM runs),
whole AS (
  SELECT conv_id, turn, m, passage, level, string_agg(line, ' ' ORDER BY pos) AS h, count(*) AS weight
  FROM quoted WHERE level > 0 GROUP BY ALL),
asked AS (
  SELECT conv_id, turn, m, passage, level, trim(regexp_replace(lower(h), '[^\p{L}\p{N}]+', ' ', 'g')) AS h, weight FROM (
    SELECT conv_id, turn, m, passage, level, line AS h, 1 AS weight FROM quoted WHERE level > 0
    UNION ALL SELECT * FROM whole)),
weights AS (
  SELECT a.conv_id, a.turn, m, passage, level, source, sum(weight) AS weight
  FROM asked a JOIN originals o ON a.conv_id = o.conv_id AND a.h = o.h AND o.source < a.turn GROUP BY ALL),
best AS (
  SELECT * FROM weights QUALIFY row_number() OVER (
    PARTITION BY conv_id, turn, m, passage ORDER BY weight DESC, source DESC) = 1),
replies AS (
  SELECT conv_id, turn, source AS reply_to FROM best WHERE level = 1
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY weight DESC, source DESC) = 1),
threads AS (
  SELECT DISTINCT conv_id, turn, lpad(upper(printf('%x', turn + 1 + 9223372036854775807::HUGEINT)), 16, '0') AS thread, 0::BIGINT AS depth
  FROM msg ANTI JOIN replies USING (conv_id, turn) WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  UNION ALL
  SELECT r.conv_id, r.turn, t.thread || '/' || lpad(upper(printf('%x', r.turn + 1 + 9223372036854775807::HUGEINT)), 16, '0'), t.depth + 1
  FROM threads t JOIN replies r ON r.conv_id = t.conv_id AND r.reply_to = t.turn),
counts AS (SELECT conv_id, turn, count(*) AS n_quotes FROM whole GROUP BY ALL),
hits AS (SELECT conv_id, turn, count(*) AS n_linked FROM best GROUP BY ALL)
SELECT o.conv_id, o.turn, o.role, o.own_text AS text, r.reply_to, coalesce(t.depth, 0)::BIGINT AS depth, t.thread,
  coalesce(c.n_quotes, 0)::BIGINT AS n_quotes, coalesce(h.n_linked, 0)::BIGINT AS n_linked
FROM own o LEFT JOIN replies r USING (conv_id, turn) LEFT JOIN threads t USING (conv_id, turn)
LEFT JOIN counts c USING (conv_id, turn) LEFT JOIN hits h USING (conv_id, turn)
"""
