"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a cap of `max_epochs` times its own words. The
budget (`budget` times all words) is shared by weight; what a source cannot take
under its cap is shared anew among the others by weight until none is above its
cap. That fixed point is a water level: target = min(cap, level * weight), found
with running sums over the sources sorted by cap / weight.

A source's training stream is its documents in hash order, gone through as many
times as its target asks. Its schedule is a weight that moves linearly from
`start` to `end` while training time goes from 0 to 1; the integral of that
schedule is the source's cumulative word demand, and each use of a document has
its own position: the time at which that demand reaches the first word of that use.
Documents are range-sorted by position.

Prefix sums never gather a source in one task: a source's hash range is cut
into buckets of about `rows_per_bucket` documents, buckets are summed first, and
running sums inside a bucket start from the sum of the buckets before it.

Defined cases: a null text has size 0; a null source is a source of its own that
comes last; a source whose size is 0 has target 0; a null id counts as an empty
one; a document without words that isn't taken has no position; equal (id, source, size) rows are interchangeable, each gets its own share
of the stream and its own output row; an empty table gives an empty result;
columns other than the three that are named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesift.llm.common import cut, id_text, md5_long, table, text_or_empty, whole_row

WEIGHTS = (5, 2, 1)
#: Start and end of each source's weight over training time, repeating like WEIGHTS.
SCHEDULES = ((3.0, 1.0), (1.0, 1.0), (1.0, 3.0))
BUDGET = 1.5
MAX_EPOCHS = 2
ROWS_PER_BUCKET = 4096
RANGE = 1 << 60
COPIES_AT_ONCE = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def _cycled(values, rank: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(rank) % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, keys, source_size, target, start, end) of each source; sized: (source, size, copies)."""
    sums = sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("keys")
    )
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (
        sums.withColumn("rank", F.row_number().over(every) - 1)
        .withColumn("weight", _cycled(weights, "rank"))
        .withColumn("start", _cycled([s for s, _ in schedules], "rank"))
        .withColumn("end", _cycled([e for _, e in schedules], "rank"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    rising = Window.orderBy("ratio", "rank")
    before, all_rows = rising.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = ranked.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    levels = levels.withColumn("capped", F.col("level") >= F.col("ratio"))
    first_open = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(all_rows)["level"]
    return levels.withColumn("open_level", first_open).select(
        "source",
        "keys",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("weight")).alias("target"),
        "start",
        "end",
    )


def position(start: Column, end: Column, share: Column) -> Column:
    """The time at which the integral of a weight from start to end reaches this share of its whole."""
    moving = (F.sqrt(start * start + (end * end - start * start) * share) - start) / F.nullif(end - start, F.lit(0.0))
    return F.when(start == end, share).otherwise(moving)


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, schedules, budget: float, max_epochs: int, rows_per_bucket: int) -> DataFrame:
    """(doc_id, source, size, copies, source_size, target, start, end, base), one row for equal (id, source, size) rows; base: the words of a pass before them."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"))
    # Read several times below; it's a few dozen bytes a document, and the texts are read once.
    counted = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    keyed = counted.withColumn("key", md5_long(id_text("doc_id")))
    targets = source_targets(keyed, weights, schedules, budget, max_epochs)
    # One row a source: Spark broadcasts it while it is small and shuffles it beyond that.
    same_source = keyed["source"].eqNullSafe(targets["source"])
    placed = keyed.join(targets, same_source).select(keyed["*"], *[targets[c] for c in ("keys", "source_size", "target", "start", "end")])
    placed = placed.withColumn("buckets", F.ceil(F.col("keys") / rows_per_bucket)).withColumn(
        "bucket", F.expr(f"key div ({RANGE}L div buckets + 1)")
    )
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    whole = running.join(offsets, running["source"].eqNullSafe(offsets["source"]) & (running["bucket"] == offsets["bucket"]))
    base = (offsets["offset"] + running["inner"]).alias("base")
    return whole.select(*[running[c] for c in ("doc_id", "source", "size", "copies", "source_size", "target", "start", "end")], base)


def _uses(rows: DataFrame, copy: Column) -> DataFrame:
    """With taken and positions, the training time of each use: a pass goes through all of the source, so uses are source_size words apart."""
    words, size, source_size = F.col("words"), F.col("size"), F.col("source_size")
    rows = (
        rows.withColumn("first_word", F.col("base") + copy * size)
        .withColumn("words", F.floor(F.col("target") + 0.5))
        .withColumn("epochs", F.expr("coalesce(words div nullif(source_size, 0), 0)"))
        .withColumn("rest", words - F.col("epochs") * source_size)
        .withColumn("taken", F.col("epochs") * size + F.greatest(F.lit(0), F.least(size, F.col("rest") - F.col("first_word"))))
    )
    last = F.col("epochs") - F.when(F.col("first_word") < F.col("rest"), 0).otherwise(1)

    def time(turn: Column) -> Column:
        return position(F.col("start"), F.col("end"), (turn * source_size + F.col("first_word")) / F.nullif(words, F.lit(0)))

    return rows.withColumn("positions", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), time)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, positions), one row per input row, range-sorted by position.

    positions has the time of every use, position that of the first.
    """
    whole = _streams(docs, id_col, text_col, source_col, weights, schedules, budget, max_epochs, rows_per_bucket)
    last = F.col("copies") - 1
    chunks = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES_AT_ONCE}"))))
    rows = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * COPIES_AT_ONCE, F.least(last, F.col("chunk") * COPIES_AT_ONCE + COPIES_AT_ONCE - 1))))
    rows = _uses(rows, F.col("copy")).withColumn("position", F.get("positions", F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "positions").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The documents as the mix trains on them: each as often as its taken words ask, to the nearest whole, every use at its own position.

    A source's last document is the only one that can be taken in part. Documents that aren't taken go. Equal (id, source, size)
    rows take their places in the stream in order of the MD5 of the text. The columns stay as they were.
    """
    wanted = F.when(F.col("size") > 0, F.round(F.col("taken") / F.nullif(F.col("size"), F.lit(0)))).otherwise(0).cast("int")
    streams = _streams(docs, id_col, text_col, source_col, weights, schedules, budget, max_epochs, rows_per_bucket)
    # Of equal rows the first is taken most.
    streams = _uses(streams, F.lit(0)).where(wanted > 0)
    streams = streams.select("doc_id", "source", "size", F.struct("size", "copies", "source_size", "target", "start", "end", "base").alias("stream"))
    # The rows travel as one column, so no name of theirs can clash.
    text = text_or_empty(text_col)
    sized = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("origin"), word_count(text).alias("words"), F.md5(text).alias("digest"))
    same = sized["id"].eqNullSafe(streams["doc_id"]) & sized["origin"].eqNullSafe(streams["source"]) & (sized["words"] == streams["size"])
    order = Window.partitionBy("id", "origin", "words").orderBy("digest")
    place = F.when(F.col("stream")["copies"] > 1, F.row_number().over(order) - 1).otherwise(0).cast("long")
    joined = sized.join(streams, same).select("row", "id", place.alias("place"), "stream.*")
    used = _uses(joined, F.col("place")).where(wanted > 0).select("row", "id", F.explode(F.slice("positions", F.lit(1), wanted)).alias("position"))
    return used.repartitionByRange("position", "id").sortWithinPartitions("position", "id").select("row.*")


COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "uses", "position", "last_position"]


def digest(found: DataFrame) -> DataFrame:
    """The rows of mix with the number of a document's uses and the time of the last one in place of the list."""
    uses = F.when(F.col("taken") > 0, F.size("positions")).otherwise(0).alias("uses")
    return found.withColumns({"uses": uses, "last_position": F.element_at("positions", -1)}).select(*COLUMNS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(mix(table(spark, sf_dir, "documents")))


OP5_SQL = f"""
WITH sized AS (
  SELECT doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sums),
weighted AS (
  SELECT source, source_size, rk,
         [{", ".join(map(str, WEIGHTS))}][rk % {len(WEIGHTS)} + 1] AS weight,
         [{", ".join(f"{s}::DOUBLE" for s, _ in SCHEDULES)}][rk % {len(SCHEDULES)} + 1] AS s0,
         [{", ".join(f"{e}::DOUBLE" for _, e in SCHEDULES)}][rk % {len(SCHEDULES)} + 1] AS s1,
         source_size * {MAX_EPOCHS} AS cap
  FROM ranked),
levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, rk) AS place,
         ((sum(source_size) OVER ())::DOUBLE * {BUDGET} - coalesce((sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0))
         / ((sum(weight) OVER ())::DOUBLE - coalesce((sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0)) AS lvl
  FROM weighted),
targets AS (
  SELECT source, source_size, s0, s1,
         CASE WHEN lvl >= ratio THEN cap::DOUBLE
              ELSE (SELECT arg_min(lvl, place) FROM levels WHERE lvl < ratio) * weight END AS target
  FROM levels),
keyed AS (
  SELECT doc_id, source, size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM sized),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.s0, t.s1, floor(t.target + 0.5)::BIGINT AS words,
         coalesce((sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS first_word
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, coalesce(words // nullif(source_size, 0), 0) AS epochs FROM placed),
took AS (
  SELECT *, (epochs * size + greatest(0, least(size, words - epochs * source_size - first_word)))::BIGINT AS taken,
         epochs + (first_word < words - epochs * source_size)::BIGINT AS uses FROM taking),
shares AS (
  SELECT *, first_word::DOUBLE / nullif(words, 0) AS share, ((uses - 1) * source_size + first_word)::DOUBLE / nullif(words, 0) AS last_share FROM took)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN uses ELSE 0 END::INTEGER AS uses,
       CASE WHEN taken > 0 THEN CASE WHEN s0 = s1 THEN share ELSE (sqrt(s0 * s0 + (s1 * s1 - s0 * s0) * share) - s0) / (s1 - s0) END END AS position,
       CASE WHEN taken > 0 THEN CASE WHEN s0 = s1 THEN last_share ELSE (sqrt(s0 * s0 + (s1 * s1 - s0 * s0) * last_share) - s0) / (s1 - s0) END END AS last_position
FROM shares
"""
