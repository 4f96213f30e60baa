"""Relief scores: features that tell a row from near rows of other classes, and not from near rows of its own.

Every row is compared with every other, so work grows with the square of the rows. Two strategies:

* block: the scaled values are broadcast, `block_bytes` of them at a time; each task compares its rows with those
  in tiles of a fixed size. If all values fit into one block, a single pass hands on one number a feature. If they don't, there is a
  round for each block and pass: the first sums up each row's distances (or keeps the nearest rows of each class), MultiSURF counts
  each row's near rows in a second, and the last adds up the scores. A round hands on a few numbers a row, or one a feature and task, is written
  to the shared folder, and its broadcast is freed. Pairs are never rows, and rows aren't shuffled for them.
* sql: a join on unequal ids. Statistics of a row's distances are aggregated by row, which Spark sums in each task
  before the shuffle, and the pairs are formed again for the scores; so pairs never go through a shuffle.
  The other side is broadcast only if its size allows it; beyond that, Spark deals out both sides.

Where rows lie on few lines (`lines.py`), pairs aren't formed: by `sql`, by `block` if there are several blocks, and in one block if pairs are more
than `PAIRS_AT_MOST`, counted by feature.

`auto` is block at every size. All ways give the same scores. Ids must be unique.

Values are divided by their column's range before they're compared. A column is discrete if it has at most
`discrete_limit` different values; two of those differ by 0 or 1. A distance is the sum over the features.
Of equal distances the row of the smaller id is nearer.
"""

from __future__ import annotations

import logging
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.checkpoints import cut
from lakesift.dataset import FeatureFrame, matrix
from lakesift.functions.selection import ranked, selection_count
from lakesift.operators import lines
from lakesift.operators.base import FittedSelector, Selector, check_strategy

BLOCK_BYTES = 256 << 20
#: Distances that a task holds, the most rows of them, and how many are worked on at a time.
TILE_CELLS = 1 << 18
MOST_TILE_ROWS = 64
PIECE_CELLS = 1 << 14
PAIRS_AT_MOST = 5_000_000_000
MOST_SQL_FEATURES = 1000
log = logging.getLogger(__name__)


@dataclass
class Prepared:
    """rows: (key, y, x), in order of the id: the row's place as an increasing number, its label's code, and its scaled values."""

    rows: DataFrame
    n: int
    p: int
    class_rows: list[int]
    discrete: list[bool]
    active: list[int]

    @property
    def bytes(self) -> int:
        return self.n * (len(self.discrete) + 2) * 8

    def wide(self) -> DataFrame:
        """(id, y, f0, f1, ...)"""
        if self.p > MOST_SQL_FEATURES:
            raise ValueError(f"strategy='sql' is for at most {MOST_SQL_FEATURES} features")
        return self.rows.select(F.col("key").alias("id"), "y", *[F.get("x", f).alias(f"f{k}") for k, f in enumerate(self.active)])

    def only(self, active: list[int]) -> Prepared:
        return replace(self, active=active, p=len(active))


def prepare(frame: FeatureFrame, discrete_limit: int, n: int) -> tuple[Prepared, list]:
    if frame.id_col is None:
        raise ValueError("rows are compared with each other: an id column is needed")
    classes = frame.classes()
    found = {r["feature_idx"]: r for r in frame.ranges(discrete_limit).collect()}
    discrete = [found[k]["is_discrete"] for k in range(frame.n_features)]
    ranges = [1.0 if d or found[k]["high"] == found[k]["low"] else found[k]["high"] - found[k]["low"] for k, d in enumerate(discrete)]
    spans = np.array(ranges)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(matrix(batch.column(2)) / spans), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["id", "y", "x"])

    kind = frame.df.schema[frame.id_col].dataType.simpleString()
    rows = frame.df.select(F.col(frame.id_col).alias("id"), frame.label_code([c for c, _ in classes]).alias("y"), frame.values().alias("x"))
    rows = cut(rows.mapInArrow(scale, f"id {kind}, y int, x array<double>").orderBy("id").withColumn("key", F.monotonically_increasing_id()))
    if rows.select(F.count_distinct("id")).first()[0] != n:
        raise ValueError(f"{frame.id_col} must be unique and not null: each row is compared with all others")
    return Prepared(rows.select("key", "y", "x"), n, frame.n_features, [c for _, c in classes], discrete, list(range(frame.n_features))), [c for c, _ in classes]


def _difference(k: int, discrete: bool) -> Column:
    a, b = F.col(f"a.f{k}"), F.col(f"b.f{k}")
    return F.when(a != b, 1.0).otherwise(0.0) if discrete else F.abs(a - b)


def _pairs(data: Prepared, left: DataFrame) -> DataFrame:
    """left x rows for unequal ids, with d0, d1, ... and dist; left has id and y, and what else is kept as a.*."""
    other = F.broadcast(data.wide()) if data.bytes <= BLOCK_BYTES else data.wide()
    spark = data.rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(data.n * data.n / 50_000_000))
    joined = left.repartition(tasks, "id").alias("a").join(other.alias("b"), F.col("a.id") != F.col("b.id"))
    diffs = [_difference(k, data.discrete[f]).alias(f"d{k}") for k, f in enumerate(data.active)]
    extra = [F.col(f"a.{c}").alias(c) for c in left.columns if c not in ("id", "y") and not c.startswith("f")]
    out = joined.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.y").alias("yi"), F.col("b.y").alias("yj"), *extra, *diffs)
    dist = F.col("d0")
    for k in range(1, data.p):
        dist = dist + F.col(f"d{k}")
    return out.withColumn("dist", dist)


def _with_limits(data: Prepared, limit) -> DataFrame:
    stats = _pairs(data, data.wide()).groupBy("i").agg(F.avg("dist").alias("mean"), F.avg(F.col("dist") * F.col("dist")).alias("square"))
    limits = stats.select(F.col("i").alias("id"), limit(F.col("mean"), F.col("square")).alias("lim"))
    return data.wide().join(limits, "id")


def _surf_sql(data: Prepared, star: bool) -> list[float]:
    rows = _with_limits(data, lambda mean, square: mean)
    near, miss = F.col("dist") < F.col("lim"), F.col("yi") != F.col("yj")
    sign = F.when(near, F.when(miss, 1.0).otherwise(-1.0)).otherwise(F.when(miss, -1.0).otherwise(1.0) if star else 0.0)
    row = _pairs(data, rows).agg(*[F.sum(F.col(f"d{k}") * sign) for k in range(data.p)]).first()
    return [(v or 0.0) / data.n for v in row]


def _multisurf_sql(data: Prepared, star: bool) -> list[float]:
    rows = _with_limits(data, lambda mean, square: mean - F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)) / 2)
    near, miss = F.col("dist") < F.col("lim"), F.col("yi") != F.col("yj")
    near_miss, near_hit, far_miss = near & miss, near & ~miss, ~near & miss
    sums = [F.count_if(near_miss).alias("n_miss"), F.count_if(near_hit).alias("n_hit")]
    for k in range(data.p):
        d = F.col(f"d{k}")
        sums.append(F.sum(F.when(near_miss, d).when(far_miss, -d if star else 0.0).otherwise(0.0)).alias(f"m{k}"))
        sums.append(F.sum(F.when(near_hit, d).otherwise(0.0)).alias(f"h{k}"))
    by_row = _pairs(data, rows).groupBy("i").agg(*sums)
    parts = [F.sum(F.col(f"m{k}") / F.greatest("n_miss", F.lit(1)) - F.col(f"h{k}") / F.greatest("n_hit", F.lit(1))) for k in range(data.p)]
    return [(v or 0.0) / data.n for v in by_row.agg(*parts).first()]


def _class_weight(data: Prepared, k: int, same: Column, yi: Column, yj: Column) -> Column:
    counts = F.array(*[F.lit(float(c)) for c in data.class_rows])
    own, other = F.element_at(counts, yi + 1), F.element_at(counts, yj + 1)
    return F.when(same, -1.0 / F.least(F.lit(float(k)), own)).otherwise(other / (data.n - own) / k)


def _relieff_sql(data: Prepared, k: int) -> list[float]:
    order = Window.partitionBy("i", "yj").orderBy("dist", "j")
    near = _pairs(data, data.wide()).select("i", "j", "yi", "yj", "dist", *[f"d{f}" for f in range(data.p)])
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    weight = _class_weight(data, k, F.col("yi") == F.col("yj"), F.col("yi"), F.col("yj"))
    row = near.withColumn("w", weight).agg(*[F.sum(F.col(f"d{f}") * F.col("w")) for f in range(data.p)]).first()
    return [(v or 0.0) / data.n for v in row]


def _pieces(rows: int, columns: int) -> Iterator[slice]:
    """Columns by pieces that stay in a core's cache, with as many rows."""
    width = max(256, PIECE_CELLS // max(1, rows))
    return (slice(at, min(at + width, columns)) for at in range(0, columns, width))


def _apart(a: np.ndarray, b: np.ndarray, discrete: bool, out: np.ndarray) -> np.ndarray:
    """What a feature contributes to the distances of rows a to others b."""
    if discrete:
        out[...] = a[:, None] != b[None, :]
        return out
    np.subtract(a[:, None], b[None, :], out=out)
    return np.abs(out, out=out)


def _distances(mine: np.ndarray, others: np.ndarray, discrete: list[bool]) -> np.ndarray:
    """mine: rows by features; others: features by rows."""
    dist = np.zeros((len(mine), others.shape[1]))
    for piece in _pieces(*dist.shape):
        total = np.zeros((len(mine), piece.stop - piece.start))
        one = np.empty_like(total)
        for f, kind in enumerate(discrete):
            total += _apart(mine[:, f], others[f, piece], kind, one)
        dist[:, piece] = total
    return dist


def _nearest(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k nearest columns of each row, the first of equals; columns that aren't finite never are."""
    if k >= dist.shape[1]:
        return np.nonzero(np.isfinite(dist))
    limit = np.partition(dist, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(dist <= np.where(np.isfinite(limit), limit, np.finfo(float).max)[:, None])
    if len(row) and np.bincount(row).max() > k:  # some are as far as the last one
        order = np.lexsort((col, dist[row, col], row))
        row, col = row[order], col[order]
        here = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[here], col[here]
    return row, col


@dataclass(frozen=True)
class _Rule:
    """What a pair counts in the scores."""

    kind: str
    k: int
    star: bool
    n: int
    class_rows: tuple[int, ...]

    def limits(self, total: np.ndarray, square: np.ndarray) -> np.ndarray:
        """How near a near row is, from the sums of a row's distances and of their squares."""
        mean = total / (self.n - 1)
        if self.kind == "surf":
            return mean
        return mean - np.sqrt(np.maximum(0.0, square / (self.n - 1) - mean * mean)) / 2

    def class_weights(self, y: np.ndarray) -> np.ndarray:
        """What a neighbour of each class counts for rows of these classes."""
        counts = np.array(self.class_rows, float)
        own, hit = counts[y][:, None], np.arange(len(counts))[None, :] == y[:, None]
        return np.where(hit, -1.0 / np.minimum(self.k, own), counts[None, :] / np.maximum(1, self.n - own) / self.k)

    def weights(self, dist: np.ndarray, miss: np.ndarray, limit: np.ndarray, n_miss: np.ndarray | None = None, n_hit: np.ndarray | None = None) -> np.ndarray:
        """limit: for each row; dist: not finite for the row itself."""
        near = dist < limit[:, None]
        sign = np.where(miss, 1.0, -1.0)
        if self.kind == "surf":
            weight = np.where(near, sign, -sign if self.star else 0.0)
        else:
            misses = np.where(near, 1.0, -1.0 if self.star else 0.0) / np.maximum(1, n_miss)[:, None]
            weight = np.where(miss, misses, near / -np.maximum(1.0, n_hit)[:, None])
        return np.where(np.isfinite(dist), weight, 0.0)


def _tiled(batches: Iterator[pa.RecordBatch], sent, active: list[int] | None, discrete: list[bool]):
    """(keys, classes, other columns, distances, their classes and keys, values of both) of each tile; a row's distance to itself is infinite.

    batches: (key, y, x, ...); sent: a block of (keys, classes, values by feature) in order of class and key. active: the features that count, if not all do.
    """
    keys, y, x = sent.value
    x = x if active is None else x[active]
    places = np.argsort(keys)
    in_order = keys[places]
    step = max(1, min(MOST_TILE_ROWS, TILE_CELLS // max(1, len(y))))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            mine = matrix(part.column(2))
            mine = mine if active is None else mine[:, active]
            my_keys = part.column(0).to_numpy()
            dist = _distances(mine, x, discrete)
            spot = np.searchsorted(in_order, my_keys)
            own = np.take(in_order, spot, mode="clip") == my_keys
            dist[np.flatnonzero(own), places[spot[own]]] = np.inf
            yield my_keys, part.column(1).to_numpy(), part.columns[3:], dist, y, keys, mine, x


def _by_class(y: np.ndarray, classes: int) -> list[tuple[int, int]]:
    """(first, end) of each class in y, which is sorted."""
    ends = np.searchsorted(y, np.arange(classes + 1))
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def _added(scores: np.ndarray, weight: np.ndarray, mine: np.ndarray, x: np.ndarray, discrete: list[bool]) -> None:
    for piece in _pieces(*weight.shape):
        here = np.ascontiguousarray(weight[:, piece])
        one, here = np.empty_like(here), here.ravel()
        for f, kind in enumerate(discrete):
            scores[f] += _apart(mine[:, f], x[f, piece], kind, one).ravel() @ here


def _added_of(scores: np.ndarray, weight: np.ndarray, row: np.ndarray, col: np.ndarray, mine: np.ndarray, x: np.ndarray, discrete: list[bool]) -> None:
    """Of some pairs, with a weight each."""
    for f, kind in enumerate(discrete):
        a, b = mine[row, f], x[f, col]
        scores[f] += (a != b if kind else np.abs(a - b)) @ weight


def _by_feature(scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(scores)), pa.int32()), pa.array(scores)], names=["f", "score"])


def _finite(dist: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(dist), dist, 0.0)


class Blocks:
    """The block strategy over prepared rows. Blocks that are all of the rows are fetched and broadcast once, whichever features count."""

    def __init__(self, data: Prepared, block_bytes: int | None = None) -> None:
        self.data, self.sent = data, None
        self.count = math.ceil(data.bytes / (block_bytes or BLOCK_BYTES))

    def _block(self, k: int):
        """The rows of a block, which are those of a hash, sorted by class and key; their values by feature."""
        if self.sent is not None:
            return self.sent
        rows = self.data.rows if self.count == 1 else self.data.rows.where(F.pmod(F.xxhash64("key"), F.lit(self.count)) == k)
        table = rows.toArrow().sort_by([("y", "ascending"), ("key", "ascending")])
        values = np.ascontiguousarray(matrix(table.column("x")).T) if table.num_rows else np.zeros((len(self.data.discrete), 0))
        sent = self.data.rows.sparkSession.sparkContext.broadcast((table.column("key").to_numpy(), table.column("y").to_numpy().astype(np.int64), values))
        if self.count == 1:
            self.sent = sent
        return sent

    def close(self) -> None:
        if self.sent is not None:
            self.sent.destroy()
            self.sent = None

    def scores(self, data: Prepared, kind: str, k: int = 0, star: bool = False) -> list[float]:
        rule = _Rule(kind, k, star, data.n, tuple(data.class_rows))
        discrete = [data.discrete[f] for f in data.active]
        active = None if data.p == len(data.discrete) else data.active
        by_feature = (self._in_one if self.count == 1 else self._in_rounds)(data, rule, active, discrete)
        return [by_feature.get(f, 0.0) / data.n for f in range(data.p)]

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Tasks for all cores: comparing a row is much work, holding it is little."""
        cores = 4 * rows.sparkSession.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(min(self.data.n, cores), "key")

    def _in_one(self, data: Prepared, rule: _Rule, active: list[int] | None, discrete: list[bool]) -> dict[int, float]:
        sent = self._block(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = np.zeros(len(discrete))
            for _, my_y, _, dist, y, _, mine, x in _tiled(batches, sent, active, discrete):
                if rule.kind == "relieff":
                    each = rule.class_weights(my_y)
                    for c, (first, end) in enumerate(_by_class(y, len(rule.class_rows))):
                        row, col = _nearest(dist[:, first:end], rule.k)
                        _added_of(scores, each[row, c], row, col + first, mine, x, discrete)
                else:
                    miss, known = my_y[:, None] != y[None, :], _finite(dist)
                    limit = rule.limits(known.sum(axis=1), (known * known).sum(axis=1))
                    near = dist < limit[:, None]
                    weight = rule.weights(dist, miss, limit, (near & miss).sum(axis=1), (near & ~miss).sum(axis=1))
                    _added(scores, weight, mine, x, discrete)
            yield _by_feature(scores)

        found = self._spread(data.rows).mapInArrow(run, "f int, score double").groupBy("f").agg(F.sum("score").alias("score"))
        return {r["f"]: r["score"] for r in found.collect()}

    def _round(self, rows: DataFrame, make, schema: str) -> DataFrame:
        """make(block) over rows for each block, each written and its broadcast freed."""
        out = None
        for k in range(self.count):
            sent = self._block(k)
            found = cut(rows.mapInArrow(make(sent), schema))
            sent.destroy()
            out = found if out is None else out.unionAll(found)
        return out

    def _in_rounds(self, data: Prepared, rule: _Rule, active: list[int] | None, discrete: list[bool]) -> dict[int, float]:
        rows = data.rows
        if rule.kind == "relieff":
            near = self._round(rows, lambda sent: _nearest_of(sent, rule, active, discrete), "key long, class int, dist double, other long")
            order = Window.partitionBy("key", "class").orderBy("dist", "other")
            last = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rule.k)
            last = last.groupBy("key", "class").agg(F.max(F.struct("dist", "other")).alias("last")).groupBy("key").agg(F.collect_list(F.struct("class", "last.dist", "last.other")).alias("limits"))
            limited = cut(rows.join(last, "key").select("key", "y", "x", "limits"))
        else:
            sums = self._round(rows, lambda sent: _summed(sent, active, discrete), "key long, total double, square double")
            sums = sums.groupBy("key").agg(F.sum("total").alias("total"), F.sum("square").alias("square"))
            mean = F.col("total") / (data.n - 1)
            spread = F.sqrt(F.greatest(F.lit(0.0), F.col("square") / (data.n - 1) - mean * mean))
            limit = (mean if rule.kind == "surf" else mean - spread / 2).alias("limit")
            limited = cut(rows.join(sums.select("key", limit), "key").select("key", "y", "x", "limit"))
            if rule.kind == "multisurf":
                counts = self._round(limited, lambda sent: _near_counts(sent, active, discrete), "key long, n_miss long, n_hit long")
                counts = counts.groupBy("key").agg(F.sum("n_miss").alias("n_miss"), F.sum("n_hit").alias("n_hit"))
                limited = cut(limited.join(counts, "key").select("key", "y", "x", "limit", "n_miss", "n_hit"))
        found = self._round(limited, lambda sent: _limited_scores(sent, rule, active, discrete), "f int, score double")
        return {r["f"]: r["score"] for r in found.groupBy("f").agg(F.sum("score").alias("score")).collect()}


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def _nearest_of(sent, rule: _Rule, active, discrete):
    """The k nearest rows of each class in a block, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for my_keys, _, _, dist, y, keys, _, _ in _tiled(batches, sent, active, discrete):
            for c, (first, end) in enumerate(_by_class(y, len(rule.class_rows))):
                row, col = _nearest(dist[:, first:end], rule.k)
                if len(row):
                    yield _batch("key class dist other", my_keys[row], np.full(len(row), c, np.int32), dist[row, col + first], keys[col + first])

    return run


def _summed(sent, active, discrete):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for my_keys, _, _, dist, *_ in _tiled(batches, sent, active, discrete):
            known = _finite(dist)
            yield _batch("key total square", my_keys, known.sum(axis=1), (known * known).sum(axis=1))

    return run


def _near_counts(sent, active, discrete):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for my_keys, my_y, more, dist, y, *_ in _tiled(batches, sent, active, discrete):
            near, miss = dist < more[0].to_numpy()[:, None], my_y[:, None] != y[None, :]
            yield _batch("key n_miss n_hit", my_keys, (near & miss).sum(axis=1), (near & ~miss).sum(axis=1))

    return run


def _limited_scores(sent, rule: _Rule, active, discrete):
    """The scores of a block's rows as others, with limits that all blocks gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = np.zeros(len(discrete))
        for _, my_y, more, dist, y, keys, mine, x in _tiled(batches, sent, active, discrete):
            if rule.kind == "relieff":
                far, last = np.full((len(my_y), len(rule.class_rows)), -np.inf), np.zeros((len(my_y), len(rule.class_rows)), np.int64)
                for row, limits in enumerate(more[0].to_pylist()):
                    for limit in limits:
                        far[row, limit["class"]], last[row, limit["class"]] = limit["dist"], limit["other"]
                near = (dist < far[:, y]) | ((dist == far[:, y]) & (keys[None, :] <= last[:, y]))
                weight = near * rule.class_weights(my_y)[:, y]
            else:
                weight = rule.weights(dist, my_y[:, None] != y[None, :], *[c.to_numpy() for c in more])
            _added(scores, weight, mine, x, discrete)
        yield _by_feature(scores)

    return run


@dataclass
class Scorer:
    """A scorer's rows, ready to be scored over some of their features."""

    selector: _Relief
    frame: FeatureFrame
    data: Prepared
    classes: list
    blocks: Blocks | None

    def __call__(self, active: list[int]) -> FittedSelector:
        """The model over these features only."""
        names = tuple(self.frame.feature_cols[f] for f in active)
        m = selection_count(self.selector.n_features_to_select, len(active))
        if self.selector._needs_classes() and len(self.classes) < 2:
            return FittedSelector(names, list(range(m)), [0.0] * len(active), None, self.classes, array_col=self.frame.array_col)
        scores = self.selector._scores(self.data.only(active), self.blocks)
        return FittedSelector(names, ranked(scores)[:m], scores, [self.data.discrete[f] for f in active], self.classes, array_col=self.frame.array_col)

    def close(self) -> None:
        if self.blocks is not None:
            self.blocks.close()


@dataclass
class _Relief(Selector):
    n_features_to_select: float | int = 0.2
    discrete_limit: int = 10
    strategy: str = "auto"
    verbose: bool = False
    block_bytes: int = BLOCK_BYTES

    def _check(self, n: int) -> None:
        pass

    def _rule(self) -> tuple[str, int, bool]:
        """What counts: kind, neighbours, star."""
        raise NotImplementedError

    def _scores(self, data: Prepared, blocks: Blocks | None) -> list[float]:
        """By lines if that's less work than pairs; else by blocks, or in SQL if there are none."""
        kind, k, star = self._rule()
        if blocks is None or blocks.count > 1 or data.n * data.n * data.p > PAIRS_AT_MOST:
            found = lines.scores(data, kind, k, star)
            if found is not None:
                return found
        if blocks is not None:
            return blocks.scores(data, kind, k, star)
        return _relieff_sql(data, k) if kind == "relieff" else (_surf_sql if kind == "surf" else _multisurf_sql)(data, star)

    def fit_frame(self, frame: FeatureFrame) -> FittedSelector:
        scorer = self.scorer(frame)
        try:
            return scorer(list(range(frame.n_features)))
        finally:
            scorer.close()

    def scorer(self, frame: FeatureFrame) -> Scorer:
        """Checks and prepares the rows once, for scores over any of the features."""
        check_strategy(self.strategy)
        if isinstance(self.discrete_limit, bool) or not isinstance(self.discrete_limit, int) or self.discrete_limit < 1:
            raise ValueError("discrete_limit must be a positive int")
        n = frame.checked(least_rows=2)
        selection_count(self.n_features_to_select, frame.n_features)
        self._check(n)
        data, classes = prepare(frame, self.discrete_limit, n)
        if not self._needs_classes() or len(classes) > 1:
            self._warn(data)
        blocks = None if self.strategy == "sql" else Blocks(data, self.block_bytes)
        if self.verbose:
            log.info("%s: %d rows, %d features, strategy %s", type(self).__name__, n, data.p, "sql" if blocks is None else f"block, {blocks.count} of them")
        return Scorer(self, frame, data, classes, blocks)

    def _needs_classes(self) -> bool:
        return False

    def _warn(self, data: Prepared) -> None:
        pass


@dataclass
class ReliefF(_Relief):
    """The n_neighbors nearest rows of its own class and of each other class; the latter weigh by their class's share."""

    n_neighbors: int = 3

    def _check(self, n: int) -> None:
        k = self.n_neighbors
        if isinstance(k, bool) or not isinstance(k, int) or not 0 < k < n:
            raise ValueError("n_neighbors must be an int above 0 and below the number of rows")

    def _needs_classes(self) -> bool:
        return True

    def _warn(self, data: Prepared) -> None:
        if self.n_neighbors >= min(data.class_rows):
            warnings.warn(f"n_neighbors {self.n_neighbors} is not below the rows of the smallest class ({min(data.class_rows)})", UserWarning, stacklevel=3)

    def _rule(self) -> tuple[str, int, bool]:
        return "relieff", self.n_neighbors, False


@dataclass
class SURF(_Relief):
    """All rows nearer than the mean distance; with use_star the farther ones count the other way round."""

    use_star: bool = False

    def _rule(self) -> tuple[str, int, bool]:
        return "surf", 0, self.use_star


@dataclass
class MultiSURF(_Relief):
    """All rows nearer than the mean distance less half its deviation, averaged; with use_star farther misses are taken off."""

    use_star: bool = False

    def _rule(self) -> tuple[str, int, bool]:
        return "multisurf", 0, self.use_star
