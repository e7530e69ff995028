r"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with quote marks (">", nested by repeating it) are quoted;
their depth is the number of marks.  A passage is a run of lines of one depth
of at least 1.  A message's body is its unquoted lines, without a line that
only announces a quote ("... wrote:").  Passages and bodies are normalised
(marks off, lower case, white space collapsed) and hashed; a passage links to
the first message of its conversation whose body, or consecutive lines of it
(paragraphs are such, lines without a word do not count), has the hash, if
that is an earlier turn, and else to the first such message of the other
conversations.  A message replies to the message that its
first linked passage of depth 1 quotes from its conversation, and else to the
turn before it.  Conversations come out in reply order: threads by their
first turn, and a message always after the one it replies to.

Originals are reduced to one row a hash before the join, so a passage that
very many messages hold joins once.  Turns are numbered by blocks of turns
and pointers are followed by doubling, so no conversation is a single group.

Defined cases: null texts read as empty; messages with a null conv_id or turn
keep a row, without a parent and at depth 0; repeated rows of a turn share its
place in the thread and follow each other by role and text; passages without
a word are not counted; columns besides the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

MARK = r"^(?:[ \t]{0,3}>)+[ \t]?"
ANNOUNCES = r"(?i)(wrote|schrieb|écrit|escribió) ?:\s*$"
#: Turns numbered together.
TURNS = 1024


def lines_of(text: Column) -> Column:
    """Structs (depth, line), the marks taken off."""

    def one(line: Column) -> Column:
        mark = F.regexp_extract(line, MARK, 0)
        depth = F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))
        return F.struct(depth.alias("depth"), F.regexp_replace(line, MARK, "").alias("line"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\x0B\f]+", " "))


def body_of(lines: Column) -> Column:
    def announces(x: Column, i: Column) -> Column:
        following = F.get(lines, i + 1)
        return x["line"].rlike(ANNOUNCES) & F.coalesce(following["depth"] > 0, F.lit(False))

    own = F.filter(lines, lambda x, i: (x["depth"] == 0) & ~announces(x, i))
    joined = F.array_join(F.transform(own, lambda x: x["line"]), "\n")
    return F.regexp_replace(joined, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")


def passages_of(lines: Column) -> Column:
    """Structs (depth, text, n) of the quoted runs in order, the text normalised; n is its lines with a word."""
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(every, lambda i: (i == 0) | (F.get(lines, i)["depth"] != F.get(lines, i - 1)["depth"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(lines)))
    runs = F.transform(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"]))
    quoted = F.filter(runs, lambda r: F.get(r, F.lit(0))["depth"] > 0)

    def passage(run: Column) -> Column:
        text = F.array_join(F.transform(run, lambda x: x["line"]), " ")
        worded = F.filter(run, lambda x: normalised(x["line"]) != "")
        return F.struct(F.get(run, F.lit(0))["depth"].alias("depth"), normalised(text).alias("text"), F.size(worded).alias("n"))

    return F.filter(F.transform(quoted, passage), lambda r: r["text"] != "")


def originals_of(body: Column, runs: list[int]) -> Column:
    """The normalised body, its paragraphs, its lines and its runs of so many lines with a word, each once."""
    parts = F.concat(F.array(body), F.split(body, r"\n[ \t\r]*\n"), F.split(body, "\n"))
    lines = F.filter(F.transform(F.split(body, "\n"), normalised), lambda p: p != "")

    def joined(n: int) -> Column:
        starts = F.when(F.size(lines) >= n, F.sequence(F.lit(1), F.size(lines) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(lines, i, n), " "))

    return F.array_distinct(F.filter(F.concat(F.transform(parts, normalised), *map(joined, runs)), lambda p: p != ""))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, passages): quote levels parsed."""
    rows = messages.select("conv_id", "turn", "role", lines_of(F.col("text")).alias("lines"))
    # Texts without a mark, the usual case, need no runs.
    quoted = F.exists("lines", lambda x: x["depth"] > 0)
    none = F.array().cast("array<struct<depth:int,text:string,n:int>>")
    return rows.select(
        "conv_id", "turn", "role", body_of(F.col("lines")).alias("body"), F.when(quoted, passages_of(F.col("lines"))).otherwise(none).alias("passages")
    )


def linked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, depth, to_conv, to_turn): each passage and the message it quotes, if found."""
    quotes = rows.where(F.size("passages") > 0).select("conv_id", "turn", F.posexplode("passages").alias("at", "passage"))
    # The lengths that quotes have, so that a body gives that many runs a line.
    runs = sorted(r.n for r in quotes.select("passage.n").where("n > 1").distinct().collect())
    quotes = quotes.select("conv_id", "turn", "at", F.col("passage.depth").alias("depth"), F.sha2("passage.text", 256).alias("hash"))
    # Only hashes that are quoted at all are looked up among the bodies.
    wanted = quotes.select("hash").distinct()
    bodies = rows.select("conv_id", "turn", F.explode(originals_of(F.col("body"), runs)).alias("part"))
    held = bodies.select("conv_id", "turn", F.sha2("part", 256).alias("hash")).join(wanted, "hash", "left_semi")
    near = held.groupBy("conv_id", "hash").agg(F.min("turn").alias("near_turn"))
    # The two least conversations: one of them is not the quoting one.  Spark limits the rows of a hash before it deals them out.
    order = Window.partitionBy("hash").orderBy("conv_id")
    least = near.where("conv_id IS NOT NULL AND near_turn IS NOT NULL").withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    far = least.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("conv_id", "near_turn"))).alias("holders"))
    found = quotes.join(near, ["conv_id", "hash"], "left").join(far, "hash", "left")
    found = found.withColumn("far", F.get(F.filter("holders", lambda h: h["conv_id"] != F.col("conv_id")), F.lit(0)))
    here = F.col("near_turn") < F.col("turn")
    away = F.col("far").isNotNull()
    return found.select(
        "conv_id",
        "turn",
        "at",
        "depth",
        F.when(here, F.col("conv_id")).when(away, F.col("far.conv_id")).alias("to_conv"),
        F.when(here, F.col("near_turn")).when(away, F.col("far.near_turn")).alias("to_turn"),
    )


def turn_before(keys: DataFrame) -> DataFrame:
    """``keys`` (conv_id, turn, each once) with before, the greatest smaller turn."""
    blocks = keys.withColumn("block", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    over = Window.partitionBy("conv_id").orderBy("block")
    ends = blocks.groupBy("conv_id", "block").agg(F.max("turn").alias("last")).select("conv_id", "block", F.lag("last").over(over).alias("last_before"))
    joined = blocks.withColumn("lag", F.lag("turn").over(inside)).join(ends, ["conv_id", "block"])
    return joined.select("conv_id", "turn", F.coalesce("lag", "last_before").alias("before"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, reply_depth) by pointer doubling over (conv_id, turn, parent_turn)."""
    root = F.col("parent_turn").isNull()
    state = materialize(
        parents.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("up"), (~root).cast("long").alias("steps"), root.alias("done")), "threads"
    )
    # Only pointers that have not reached a first turn are followed on.
    while state.where("NOT done").limit(1).count():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        moved = state.where("NOT done").join(above, ["conv_id", "up"])
        moved = moved.select("conv_id", "turn", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done"))
        state = materialize(state.where("done").unionByName(moved), "threads")
    return state.select("conv_id", "turn", F.col("up").alias("thread_turn"), F.col("steps").alias("reply_depth"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Each message (conv_id, turn, role, body) with its quotes, parent, thread and position in reply order."""
    rows = materialize(parsed(messages), "messages")
    quotes = materialize(linked(rows), "quotes")
    first = F.min(F.when((F.col("depth") == 1) & (F.col("to_conv") == F.col("conv_id")), F.struct("at", "to_turn")))
    by_message = quotes.groupBy("conv_id", "turn").agg(first["to_turn"].alias("quoted_turn"), F.count("to_turn").alias("n_linked"))
    keys = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    parents = turn_before(keys).join(by_message, ["conv_id", "turn"], "left")
    parents = materialize(
        parents.select("conv_id", "turn", F.coalesce("quoted_turn", "before").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "parents"
    )
    placed = threads(parents).join(parents, ["conv_id", "turn"])
    out = rows.join(placed, ["conv_id", "turn"], "left").withColumn("block", F.floor(F.col("turn") / TURNS))
    part = ["conv_id", "thread_turn", "block"]
    inside = Window.partitionBy(*part).orderBy("turn", "role", "body")
    over = Window.partitionBy("conv_id").orderBy("thread_turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.where("turn IS NOT NULL AND conv_id IS NOT NULL").groupBy(*part).agg(F.count("*").alias("n"))
    starts = starts.select(*part, F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    ranked = out.where(placed).withColumn("rank", F.row_number().over(inside)).join(starts, part)
    # Rows without a conv_id or turn have no place, and no window gathers them.
    ranked = ranked.unionByName(out.where(~placed), allowMissingColumns=True)
    return ranked.select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        "thread_turn",
        F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"),
        (F.col("before") + F.col("rank")).cast("long").alias("position"),
    )


def op8_chat_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reply_ordered(table(spark, sf_dir, "conversations"))
    return found.select(
        "conv_id", "turn", "role", F.sha2("body", 256).alias("body_sha256"), "n_quotes", "n_linked", "parent_turn", "thread_turn", "reply_depth", "position"
    )


#: DuckDB: the contract of the docstring with lines as rows.
ORACLE_SQL = r"""
WITH RECURSIVE message AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
raw_line AS (SELECT id, conv_id, turn, generate_subscripts(parts, 1) AS i, unnest(parts) AS raw FROM (SELECT *, string_split(text, chr(10)) AS parts FROM message)),
marked AS (SELECT *, regexp_extract(raw, '^(?:[ \t]{0,3}>)+[ \t]?') AS mark FROM raw_line),
line AS (
  SELECT id, conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) AS depth, substr(raw, length(mark) + 1) AS own,
    trim(regexp_replace(lower(substr(raw, length(mark) + 1)), '[ \t\n\r\x0B\f]+', ' ', 'g')) AS norm
  FROM marked),
edge AS (SELECT *, lag(depth) OVER w AS above, lead(depth) OVER w AS below FROM line WINDOW w AS (PARTITION BY id ORDER BY i)),
grouped AS (SELECT *, count_if(above IS DISTINCT FROM depth) OVER (PARTITION BY id ORDER BY i) AS run FROM edge),
quote AS (
  SELECT id, conv_id, turn, run, any_value(depth) AS depth, trim(string_agg(norm, ' ' ORDER BY i) FILTER (WHERE norm <> '')) AS part, count_if(norm <> '') AS n
  FROM grouped WHERE depth > 0 GROUP BY id, conv_id, turn, run HAVING count_if(norm <> '') > 0),
own AS (SELECT * FROM edge WHERE depth = 0 AND NOT (coalesce(below, 0) > 0 AND regexp_matches(own, '(?i)(wrote|schrieb|écrit|escribió) ?:\s*$'))),
body AS (
  SELECT m.id, regexp_replace(coalesce(string_agg(own.own, chr(10) ORDER BY i), ''), '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g') AS body
  FROM message m LEFT JOIN own USING (id) GROUP BY m.id),
worded AS (SELECT id, conv_id, turn, norm, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM own WHERE norm <> ''),
original AS (
  SELECT w.conv_id, w.turn, string_agg(o.norm, ' ' ORDER BY o.k) AS part
  FROM worded w JOIN (SELECT DISTINCT n FROM quote) s ON true JOIN worded o ON o.id = w.id AND o.k BETWEEN w.k AND w.k + s.n - 1
  GROUP BY w.id, w.conv_id, w.turn, w.k, s.n HAVING count(*) = s.n
  UNION SELECT conv_id, turn, norm FROM worded
  UNION SELECT m.conv_id, m.turn, trim(regexp_replace(lower(p), '[ \t\n\r\x0B\f]+', ' ', 'g'))
  FROM (SELECT id, unnest([body] || regexp_split_to_array(body, '\n[ \t\r]*\n')) AS p FROM body) JOIN message m USING (id)),
holder AS (SELECT conv_id, part, min(turn) AS turn FROM original WHERE part <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, part),
link AS (
  SELECT q.id, q.run, q.depth, q.conv_id, q.turn,
    max(h.turn) FILTER (WHERE h.conv_id = q.conv_id AND h.turn < q.turn) AS here,
    arg_min(h.turn, h.conv_id) FILTER (WHERE h.conv_id <> q.conv_id) AS away
  FROM quote q LEFT JOIN holder h USING (part) GROUP BY q.id, q.run, q.depth, q.conv_id, q.turn),
spot AS (SELECT DISTINCT conv_id, turn FROM message WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
stated AS (
  SELECT conv_id, turn, count(coalesce(here, away)) AS n_linked, arg_min(here, {'run': run, 'here': here}) FILTER (WHERE depth = 1 AND here IS NOT NULL) AS quoted
  FROM link GROUP BY conv_id, turn),
parent AS (
  SELECT s.conv_id, s.turn, coalesce(quoted, lag(s.turn) OVER (PARTITION BY s.conv_id ORDER BY s.turn)) AS parent_turn, coalesce(n_linked, 0) AS n_linked
  FROM spot s LEFT JOIN stated t ON t.conv_id = s.conv_id AND t.turn = s.turn),
tree AS (
  SELECT conv_id, turn, turn AS thread_turn, 0 AS reply_depth FROM parent WHERE parent_turn IS NULL
  UNION ALL SELECT p.conv_id, p.turn, t.thread_turn, t.reply_depth + 1 FROM parent p JOIN tree t ON p.conv_id = t.conv_id AND p.parent_turn = t.turn)
SELECT m.conv_id, m.turn, m.role, sha256(b.body) AS body_sha256, (SELECT count(*) FROM quote q WHERE q.id = m.id) AS n_quotes,
  coalesce(p.n_linked, 0) AS n_linked, p.parent_turn, t.thread_turn, CAST(coalesce(t.reply_depth, 0) AS BIGINT) AS reply_depth,
  CASE WHEN t.turn IS NOT NULL THEN row_number() OVER (PARTITION BY m.conv_id ORDER BY t.thread_turn NULLS LAST, m.turn, m.role NULLS FIRST, b.body) END AS position
FROM message m JOIN body b USING (id) LEFT JOIN parent p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN tree t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
