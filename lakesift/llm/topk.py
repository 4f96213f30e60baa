"""Exact top-k search by tiled matrix products.

Queries are dealt into tiles of a fixed number of rows, candidates come as the
batches of their partitions (shards). Each task multiplies every shard by the query
tile, selects the k best of each query in that product, and merges them into one
running list for each query; so a task hands on k rows a query, however many
candidates it has seen. Lists are then merged in a tree: first by query and a group
of tasks, then by query.

The queries grow with the input, so they're never broadcast as a whole: a
round takes at most `queries_per_round` of them in id order, and there are as many rounds as
that needs. Rows that share an id are reduced to one query in Spark first, so a round's broadcast and the running lists are bounded by
that parameter. If there are several rounds, each is written to the shared folder and its broadcast is freed before
the next one begins.

Scores are exact: products run in float64 where no partial sum can reach 2**53,
and in Python integers otherwise.

Defined cases: vectors that are null, or hold a null or non-finite component, take
no part, nor does a null id; vectors of different lengths aren't compared; rows that
share an id are one item, whose score is its best one and which asks with its smallest vector;
ties go to the smaller id; fewer than k candidates give fewer rows; an empty
table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesift.llm.common import cut, table

K = 5
QUERY_EVERY = 50
QUERIES_PER_ROUND = 16384
TILE = 512
SHARD = 8192
MERGE_GROUPS = 32
EXACT = float(1 << 53)
LONG = np.iinfo(np.int64)


def _usable(vectors: pa.Array) -> np.ndarray:
    """Which rows hold a vector of finite components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
    sizes = np.diff(vectors.offsets.to_numpy()) if vectors.null_count == 0 else np.array([0 if v is None else len(v) for v in vectors.to_pylist()])
    bad = np.zeros(len(vectors), int)
    np.add.at(bad, np.repeat(np.arange(len(vectors)), sizes), ~np.isfinite(flat))
    return (bad == 0) & ~np.asarray(vectors.is_null())


def _by_length(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * vectors)) for each length of vector, sorted by id."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    keep = _usable(vectors) & ~np.asarray(ids.is_null())
    ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
    sizes = np.asarray(vectors.value_lengths())
    numbers = ids.to_numpy(zero_copy_only=False).astype("i8")
    for n in np.unique(sizes):
        chosen = np.flatnonzero(sizes == n)
        block = vectors.take(pa.array(chosen)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(chosen), n)
        order = np.argsort(numbers[chosen], kind="stable")
        yield numbers[chosen][order], np.floor(block * scale)[order]


def scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products as int64; what a long can't hold is held at its limits."""
    if queries.shape[1] == 0:
        return np.zeros((len(queries), len(shard)), np.int64)
    if np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1] < EXACT:
        return (queries @ shard.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in shard]
    return np.array([[min(max(sum(map(int.__mul__, a, b)), LONG.min), LONG.max) for b in whole[1]] for a in whole[0]], np.int64)


def best(got: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best distinct ids of each row of got; ids: sorted, one for each column."""
    allowed = ids[None, :] != own[:, None]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    if not first.all():  # rows that share an id: its best score stands in its first column
        starts = np.flatnonzero(first)
        got, allowed, ids = np.maximum.reduceat(got, starts, axis=1), allowed[:, starts], ids[starts]
    if len(ids) > k + 1:
        floor = np.partition(np.where(allowed, got, LONG.min), len(ids) - k, axis=1)[:, len(ids) - k]
        allowed &= got >= floor[:, None]
    row, col = np.nonzero(allowed)
    value = got[row, col]
    order = np.lexsort((ids[col], -value.astype(object) if (value == LONG.min).any() else -value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[col[keep]], value[keep]


class _Running:
    """The k best so far of every query of a tile."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.own, self.queries, self.k = own, queries, k
        self.row = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.value = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, shard: np.ndarray) -> None:
        new = best(scores(self.queries, shard), ids, self.own, self.k)
        row, found, value = (np.concatenate([a, b]) for a, b in zip((self.row, self.ids, self.value), new))
        order = np.lexsort((-value, found, row))
        row, found, value = row[order], found[order], value[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (found[1:] != found[:-1])]) if len(row) else np.zeros(0, bool)
        row, found, value = row[once], found[once], value[once]
        order = np.lexsort((found, -value, row))
        row, found, value = row[order], found[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.row, self.ids, self.value = row[keep], found[keep], value[keep]


def _search(tiles: list[tuple[np.ndarray, np.ndarray]], scale: float, k: int):
    """A function for mapInArrow: candidates (vec_id, embedding) to (query_id, vec_id, score, task)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        running = [_Running(own, queries, k) for own, queries in tiles]
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                for ids, shard in _by_length(part.column(0), part.column(1), scale):
                    for tile in running:
                        if tile.queries.shape[1] == shard.shape[1]:
                            tile.add(ids, shard)
        task = TaskContext.get().partitionId()
        for tile in running:
            if len(tile.row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile.own[tile.row]), pa.array(tile.ids), pa.array(tile.value), pa.array(np.full(len(tile.row), task, np.int32))],
                    names=["query_id", "vec_id", "score", "task"],
                )

    return search


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best distinct ids of each query, from the lists of the tasks, by way of groups of tasks."""

    def cut_to(df: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    grouped = lists.groupBy("query_id", (F.col("task") % MERGE_GROUPS).alias("part"), "vec_id").agg(F.max("score").alias("score"))
    halfway = cut_to(grouped, ["query_id", "part"]).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return cut_to(halfway, ["query_id"]).select("query_id", "rank", "vec_id", "score")


def _queries(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, floors): one query for each id and length of vector, the smallest; vectors with null or non-finite components take no part."""
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    # floor() gives a long, which large components have no place in; beyond 2**52 doubles are whole.
    floors = F.transform(F.transform("embedding", lambda x: x * scale), lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    return rows.where(usable).select("vec_id", floors.alias("floors")).groupBy("vec_id", F.size("floors").alias("n")).agg(F.min("floors").alias("floors")).select("vec_id", "floors")


def _tiles(found: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for ids, block in _by_length(found.column(0).combine_chunks(), found.column(1).combine_chunks(), 1.0):
        out += [(ids[at : at + TILE], block[at : at + TILE]) for at in range(0, len(ids), TILE)]
    return out


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = 256.0, queries_per_round: int = QUERIES_PER_ROUND) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among all rows but its own; is_query is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    out, last = None, None
    asked = _queries(rows.where(is_query), scale)
    while True:
        todo = asked if last is None else asked.where(F.col("vec_id") > last)
        ids = [r[0] for r in todo.select("vec_id").distinct().orderBy("vec_id").limit(queries_per_round).collect()]
        if not ids:
            break
        more, last = len(ids) == queries_per_round, ids[-1]
        sent = spark.sparkContext.broadcast(_tiles(todo.where(F.col("vec_id") <= last).toArrow()))

        def task(batches, sent=sent):
            yield from _search(sent.value, scale, k)(batches)

        found = _merged(rows.mapInArrow(task, "query_id long, vec_id long, score long, task int"), k)
        if more or out is not None:
            found = cut(found)
            sent.destroy()
        out = found if out is None else out.unionAll(found)
        if not more:
            break
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
