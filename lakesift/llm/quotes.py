"""Chat formatting by quotation linking.

Lines that start with one or more `>` are quoted; their number is the level.
Consecutive lines of one level, without a blank line between them, make a passage;
its words in lower case, with single spaces, are hashed. Passages at level 0 (and
a message's whole own text) are what can be quoted. A quoted passage is linked to
the first message of the conversation that holds it as its own, if that comes
before the quoting message. A passage that nobody said as a whole is linked through its
pieces, which are its lines and its sentences: a piece of at least `WINDOW` words is found if each run
of `WINDOW` words in it is said earlier, wherever in a passage; a shorter one if it is a
line or sentence of an earlier message. Of a passage's pieces the latest origin counts, as a run can be
said before by others. Case and punctuation don't matter there. A message replies to the latest message that its passages
of level 1 are linked to, or else those of deeper levels.

Replies form trees. Pointer doubling finds each message's root and depth in
a number of rounds that is the logarithm of the deepest chain; each round is cut off in the
shared checkpoint folder. The conversation is then sorted by root, depth and
turn, so that a reply stands after what it replies to, and every message is
given as its role and its text without quotes and without the line that introduces
one (`... wrote:`).

Main path: DataFrame functions only. Originals are reduced to one row for each
passage of a conversation before the join, so a passage that is quoted and said
many times never makes pairs; no window or list spans a conversation. Passages are
gathered by message; only messages that quote, and conversations that hold one,
get as far as that.

Defined cases: a null text or role is empty; a null conversation or turn links to nothing
and stands as a root of its own; equal rows are kept and treated alike; quotes of something
that nobody said are counted and removed, without a link; an empty table gives
an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesift.llm.common import cut, table

LINES = r"\r?\n"
PREFIX = r"^((?:[ \t]*>)+)"
QUOTED = r"(?m)^[ \t]*>"
#: A line that introduces a quote.
INTRODUCES = r"^[^\n]+\b(wrote|writes|said|schrieb|escribió|écrit)\s*:\s*$"
#: The SQL knows such lines up to 200 characters.
SQL_INTRODUCES = r"^[^\n]{1,200}\b(wrote|writes|said|schrieb|escribió|écrit)\s*:\s*$"
SENTENCE_END = r"(?<=[.!?…])\s+|(?<=[。！？])"
#: Words in a run that tells where a quote comes from.
WINDOW = 5
KEY = ["conv_id", "turn", "digest"]


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 1), r"[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\s\p{Z}]+", ""), r"[\s\p{Z}]+"), "")


def _windows(words: Column) -> Column:
    """Hashes of the runs of WINDOW words; words: at least so many."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda k: F.md5(F.array_join(F.slice(words, k, WINDOW), " ")))


def _pieces(bodies: Column) -> Column:
    """The words of a passage's lines and sentences."""
    whole = F.array_join(bodies, " ")
    return F.filter(F.transform(F.array_distinct(F.concat(bodies, F.split(whole, SENTENCE_END))), _words), lambda w: F.size(w) > 0)


def _piece_origins(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """(KEY, run, piece_origin) of quoted passages with a piece that was said; quotes, said: with KEY, run and bodies."""
    short = F.filter(_pieces(F.col("bodies")), lambda w: F.size(w) < WINDOW)
    words = _words(F.array_join("bodies", " "))
    none = F.array().cast("array<string>")
    hashes = F.concat(F.transform(short, lambda w: F.md5(F.array_join(w, " "))), F.when(F.size(words) >= WINDOW, _windows(words)).otherwise(none))
    first = said.select("conv_id", "turn", F.explode(hashes).alias("part")).groupBy("conv_id", "part").agg(F.min("turn").alias("part_origin"))
    pieces = quotes.select(*KEY, "run", F.posexplode(_pieces(F.col("bodies"))).alias("piece", "words"))
    words = F.col("words")
    parts = F.when(F.size(words) >= WINDOW, _windows(words)).otherwise(F.array(F.md5(F.array_join(words, " "))))
    asked = pieces.select(*KEY, "run", "piece", F.explode(F.array_distinct(parts)).alias("part"))
    earlier = F.when(F.col("part_origin") < F.col("turn"), F.col("part_origin"))
    found = asked.join(first, ["conv_id", "part"], "left").withColumn("part_origin", earlier)
    whole = found.groupBy(*KEY, "run", "piece").agg(F.max("part_origin").alias("piece_origin"), F.bool_and(F.col("part_origin").isNotNull()).alias("all"))
    return whole.where("all").groupBy(*KEY, "run").agg(F.max("piece_origin").alias("piece_origin"))


def _own_text(text: Column) -> Column:
    """The text without quoted lines and lines that introduce them."""
    lines = F.split(text, LINES)

    def kept(line: Column, at: Column) -> Column:
        follows = F.coalesce(F.get(lines, at + 1), F.lit(""))
        return (_level(line) == 0) & ~(line.rlike(INTRODUCES) & follows.rlike(PREFIX))

    own = F.regexp_replace(F.array_join(F.filter(lines, kept), "\n"), r"\n{3,}", "\n\n")
    return F.when(text.rlike(QUOTED), F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(text)


def _passages(messages: DataFrame) -> DataFrame:
    """(KEY, run, level, bodies, passage): the passages of messages with the columns KEY and text."""
    lines = messages.select(*KEY, F.posexplode(F.split("text", LINES)).alias("line", "body"))
    lines = lines.select(*KEY, "line", _level(F.col("body")).alias("level"), F.regexp_replace("body", PREFIX, "").alias("body"))
    lines = lines.withColumn("blank", _normal(F.col("body")) == "")
    order = Window.partitionBy(*KEY).orderBy("line")
    breaks = F.col("blank") | F.coalesce(F.lag("blank").over(order), F.lit(True)) | (F.lag("level").over(order) != F.col("level"))
    runs = lines.withColumn("breaks", breaks.cast("int")).withColumn("run", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = runs.where(~F.col("blank")).groupBy(*KEY, "run", "level").agg(F.array_sort(F.collect_list(F.struct("line", "body"))).alias("all"))
    bodies = F.col("all")["body"]
    return gathered.select(*KEY, "run", "level", bodies.alias("bodies"), F.md5(_normal(F.array_join(bodies, " "))).alias("passage"))


def _roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of messages that reply; links: (conv_id, turn, reply_to), one row a message."""
    at = cut(links.select("conv_id", "turn", F.col("reply_to").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        stepped = at.join(up, ["conv_id", "root_turn"], "left")
        if stepped.where(F.col("higher").isNotNull()).isEmpty():
            return at
        at = cut(stepped.select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def thread(conversations: DataFrame) -> DataFrame:
    """Messages in reply order, without quotes; conversations: (conv_id, turn, role, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    messages = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.md5(text).alias("digest"))
    known = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = known.where(F.col("text").rlike(QUOTED)).select(*KEY, "text").distinct()
    quotes = cut(_passages(quoting).where(F.col("level") > 0))
    info = ["quote_level", "n_quotes", "n_linked", "reply_to"]
    if quotes.isEmpty():
        empty = dict.fromkeys(("quote_level", "n_quotes", "n_linked", "depth"), F.lit(0).cast("long"))
        whole = messages.withColumns(empty | {"reply_to": F.lit(None).cast("long"), "root_turn": F.col("turn")})
    else:
        asked = known.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").select(*KEY, "text").distinct()
        own = asked.withColumn("text", _own_text(F.col("text")))
        passages = _passages(own).where(F.col("level") == 0)
        said = passages.select("conv_id", "turn", "passage")
        said = said.union(own.select("conv_id", "turn", F.md5(_normal(F.col("text")))))
        first = said.groupBy("conv_id", "passage").agg(F.min("turn").alias("origin"))
        found = quotes.join(first, ["conv_id", "passage"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
        left = found.where(F.col("origin").isNull())
        found = found.join(_piece_origins(left, passages), [*KEY, "run"], "left").withColumn("origin", F.coalesce("origin", "piece_origin"))
        linked = cut(
            found.groupBy(*KEY).agg(
                F.max("level").cast("long").alias("quote_level"),
                F.count(F.lit(1)).alias("n_quotes"),
                F.count("origin").alias("n_linked"),
                F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")).alias("reply_to"),
            )
        )
        replies = linked.where(F.col("reply_to").isNotNull()).groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to"))
        whole = messages.join(linked, KEY, "left").join(_roots(replies), ["conv_id", "turn"], "left")
        whole = whole.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("quote_level", "n_quotes", "n_linked", "depth")})
        whole = whole.withColumn("root_turn", F.coalesce("root_turn", "turn"))
    own = _own_text(F.col("text"))
    return (
        whole.select("conv_id", "turn", "role", own.alias("text"), *info, "root_turn", "depth")
        .withColumn("message", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text")))
        .orderBy("conv_id", "root_turn", "depth", "turn", "role", "text")
    )


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread(table(spark, sf_dir, "conversations"))


def op10_sql() -> str:
    def level(body: str) -> str:
        return f"len(regexp_replace(regexp_extract({body}, '{PREFIX}', 1), '[^>]', '', 'g'))"

    def normal(text: str) -> str:
        return f"trim(regexp_replace(lower({text}), '[\\s\\p{{Z}}]+', ' ', 'g'))"

    def lines(column: str) -> str:
        split = f"string_split_regex({column}, '{LINES}')"
        return f"SELECT rid, unnest({split}) AS raw, generate_subscripts({split}, 1) AS line FROM"

    def passages(name: str, column: str, source: str) -> str:
        return f"""{name}_lines AS ({lines(column)} {source}),
{name}_levels AS (SELECT rid, line, {level("raw")} AS level, regexp_replace(raw, '{PREFIX}', '') AS body FROM {name}_lines),
{name}_blank AS (SELECT *, {normal("body")} = '' AS blank FROM {name}_levels),
{name}_breaks AS (SELECT *, (blank OR lag(blank, 1, TRUE) OVER w OR coalesce(lag(level) OVER w <> level, FALSE))::INTEGER AS breaks FROM {name}_blank WINDOW w AS (PARTITION BY rid ORDER BY line)),
{name}_runs AS (SELECT *, sum(breaks) OVER (PARTITION BY rid ORDER BY line) AS run FROM {name}_breaks),
{name} AS (SELECT rid, level, md5({normal("string_agg(body, ' ' ORDER BY line)")}) AS passage FROM {name}_runs WHERE NOT blank GROUP BY rid, run, level)"""

    return f"""
WITH RECURSIVE messages AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
cut_lines AS ({lines("text")} messages),
judged AS (SELECT rid, line, raw, {level("raw")} = 0 AND NOT (regexp_matches(raw, '{SQL_INTRODUCES}') AND regexp_matches(lead(raw, 1, '') OVER (PARTITION BY rid ORDER BY line), '{PREFIX}')) AS kept FROM cut_lines),
kept_lines AS (SELECT rid, string_agg(raw, chr(10) ORDER BY line) FILTER (kept) AS own FROM judged GROUP BY rid),
texts AS (SELECT messages.*, regexp_matches(text, '{QUOTED}') AS quoting, CASE WHEN regexp_matches(text, '{QUOTED}')
  THEN regexp_replace(regexp_replace(coalesce(own, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') ELSE text END AS own
  FROM messages LEFT JOIN kept_lines USING (rid)),
known AS (SELECT * FROM texts WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
{passages("quoted", "text", "known")},
{passages("said", "own", "known")},
sayings AS (SELECT conv_id, turn, passage FROM said JOIN known USING (rid) WHERE level = 0 UNION ALL SELECT conv_id, turn, md5({normal("own")}) FROM known),
first_said AS (SELECT conv_id, passage, min(turn) AS origin FROM sayings GROUP BY conv_id, passage),
links AS (SELECT rid, level, CASE WHEN origin < turn THEN origin END AS origin
  FROM quoted JOIN known USING (rid) LEFT JOIN first_said USING (conv_id, passage) WHERE level > 0 AND quoting),
linked AS (SELECT rid, max(level) AS quote_level, count(*) AS n_quotes, count(origin) AS n_linked,
  coalesce(max(origin) FILTER (level = 1), max(origin)) AS reply_to FROM links GROUP BY rid),
replies AS (SELECT conv_id, turn, max(reply_to) AS reply_to FROM linked JOIN known USING (rid) WHERE reply_to IS NOT NULL GROUP BY conv_id, turn),
up AS (SELECT conv_id, turn, reply_to AS root_turn, 1 AS depth FROM replies
  UNION ALL SELECT up.conv_id, up.turn, replies.reply_to, up.depth + 1 FROM up JOIN replies ON replies.conv_id = up.conv_id AND replies.turn = up.root_turn),
roots AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn)
SELECT texts.conv_id, texts.turn, role, own AS text, coalesce(quote_level, 0)::BIGINT AS quote_level, coalesce(n_quotes, 0)::BIGINT AS n_quotes,
  coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to, coalesce(root_turn, texts.turn) AS root_turn, coalesce(depth, 0)::BIGINT AS depth,
  '<|' || role || '|>' || chr(10) || own AS message
FROM texts LEFT JOIN linked USING (rid) LEFT JOIN roots ON roots.conv_id = texts.conv_id AND roots.turn = texts.turn
"""
