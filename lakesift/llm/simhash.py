"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit for each bit of a shingle's XXH64 that is set in over half
of the shingles. Distinct fingerprints are sorted by population count and
cut into tiles. Two fingerprints that differ in at most `radius` bits have
population counts that differ by at most `radius`, so tile pairs whose ranges of
counts lie further apart are skipped; the others are compared whole, block by
block, with exclusive-or and bit counts in numpy. Inside a tile pair the counts of
the eight bytes skip blocks in the same way. Nothing is missed: it's a
comparison of all pairs, less those that can't be close.

A tile pair doesn't hand on the close pairs themselves, which grow with the square of a
group of near copies, but a spanning forest of them: at most one edge a fingerprint.
Components are found over the forests of all tile pairs. A node there is a fingerprint with the smallest id of its documents, in the
order of that id, so a component's root names it and no rows are ever gathered by component.
Fingerprints that over a thousandth of the documents share, of which there are a thousand at most, are joined to their
documents by broadcast, the others by fingerprint.

The tile size follows the number of distinct fingerprints, so that the number of
tiles stays about `TILES`, within memory bounds. What is sent to a task is two tiles;
fingerprints never meet on the driver, only the number of tiles and their ranges do.

Defined cases: a null text is empty; a text without words has fingerprint zero, which
links like any other; equal rows are each given; a null id never names a component
unless the component has no other; an empty table gives an empty result; columns
other than the id and the text aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.common import cut, in_few_tasks, shuffle_partitions, table, whole_row
from lakesift.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
TILES = 24
LEAST_TILE, MOST_TILE = 2048, 131072
BLOCK = 256
#: A fingerprint that more than one in so many documents have is joined by broadcast; so there are fewer than this.
HOT_SHARE = 1000
#: Rows of the table of tile pairs (40 bytes each) up to which it is broadcast.
BROADCAST_PAIRS = 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z alone, and the white space U+0009 to U+000D and U+0020
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Union-find over the positions of an array."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if np.array_equal(higher, self.up):
                return self.up
            self.up = higher

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins many pairs at once: the larger root of a pair hangs under the smaller until nothing moves."""
        while len(a):
            roots = self.roots()
            x, y = roots[a], roots[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def _order(fps: np.ndarray) -> np.ndarray:
    """An order that brings fingerprints with equal bit counts by byte together."""
    counts = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8))
    halves = counts.reshape(-1, 4, 2).sum(axis=2)
    return np.lexsort((halves[:, 2], halves[:, 1], halves[:, 0], counts.sum(axis=1)))


def compare(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the close pairs in left x right, or in left x left, as positions in both arrays, the left one first."""
    fps = left if right is None else np.concatenate([left, right])
    forest = _Forest(len(fps))
    one = np.arange(len(left))[_order(left)]
    two = one if right is None else len(left) + _order(right)

    def ranges(order: np.ndarray):
        parts = np.bitwise_count(fps[order].view(np.uint16).reshape(-1, 4)).astype(np.int64)
        starts = np.arange(0, len(order), BLOCK)
        return starts, np.minimum.reduceat(parts, starts), np.maximum.reduceat(parts, starts)

    starts, low, high = ranges(one)
    starts2, low2, high2 = ranges(two)
    for k, at in enumerate(starts):
        # The counts of the four 16-bit parts differ by this much at least, in sum: a lower bound of the differing bits.
        gap = (np.maximum(0, np.maximum(low[k] - high2, low2 - high[k]))).sum(axis=1)
        near = np.flatnonzero((gap <= radius) & ((starts2 >= at) if right is None else True))
        mine = one[at : at + BLOCK]
        for group in np.split(near, np.arange(64, len(near), 64)):
            if not len(group):
                continue
            other = np.concatenate([two[s : s + BLOCK] for s in starts2[group]])
            close = np.bitwise_count(fps[mine][:, None] ^ fps[other][None, :]) <= radius
            a, b = np.nonzero(close)
            a, b = mine[a], other[b]
            apart = a != b
            forest.join(a[apart], b[apart])
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return moved, roots[moved]


def _tiles(distinct: DataFrame, tile: int, n: int) -> DataFrame:
    """(tile, fps and ids as bytes): the n distinct (fp, none, least, bits) sorted by population count, in tiles of `tile` rows.

    Rows are numbered within buckets of a population count and a hash, each of which is a part
    of a tile's size, so no task holds more than that; a tile is never mixed from two population counts.
    """
    per_count = {r[0]: r[1] for r in distinct.groupBy("bits").count().collect()}  # 65 rows at most
    parts = F.create_map(*[F.lit(x) for bits, n in per_count.items() for x in (int(bits), max(1, round(n / tile)))])
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("fp"), F.element_at(parts, F.col("bits")).cast("long")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            bits, part, *node = (batch.column(k).to_numpy() for k in range(5))
            node = np.column_stack(node)
            order = np.lexsort((part, bits))
            bits, part, node = bits[order], part[order], node[order]
            starts = np.flatnonzero(np.concatenate([[True], (bits[1:] != bits[:-1]) | (part[1:] != part[:-1])])) if len(node) else []
            for a, b in zip(starts, [*starts[1:], len(node)]):
                held.setdefault((int(bits[a]), int(part[a])), []).append(node[a:b])
        for (bits, part), found in held.items():
            nodes = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bits], pa.int32()), pa.array([part], pa.int64()), pa.array([nodes[np.argsort(nodes[:, 0])].tobytes()], pa.binary())],
                names=["bits", "part", "nodes"],
            )

    spread = dealt.select("bits", "part", "fp", "none", "least").repartition("bits", "part")
    return in_few_tasks(spread, n).mapInArrow(pack, "bits int, part long, nodes binary")


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest, by tile pair, of all pairs of fingerprints at most radius bits apart.

    distinct: n rows (fp, none, least) that are cheap to read again.
    a and b are nodes: none (1 if the fingerprint's documents have no id, else 0), least (the smallest id, else 0) and fp.
    """
    distinct = distinct.withColumn("bits", F.bit_count("fp").cast("int"))
    tile = min(MOST_TILE, max(LEAST_TILE, n // TILES))
    tiles = cut(_tiles(distinct, tile, n))
    # One row for each tile and each population count within reach: the join is on equal counts.
    within = F.explode(F.array(*[F.col("bits") + d for d in range(radius + 1)]))
    other = tiles.select(F.col("bits").alias("bits2"), F.col("part").alias("part2"))
    pairs = tiles.select("bits", "part", within.alias("bits2")).join(other, "bits2")
    pairs = pairs.where((F.col("bits") < F.col("bits2")) | (F.col("part") <= F.col("part2")))
    same = (F.col("bits") == F.col("bits2")) & (F.col("part") == F.col("part2"))
    pairs = cut(pairs.withColumn("same", same).withColumn("pair", F.struct("bits", "part", "bits2", "part2")), tiles.count() ** 2)
    n_pairs = pairs.count()
    sent = F.broadcast(pairs) if n_pairs <= BROADCAST_PAIRS else pairs
    tasks = max(1, min(n_pairs, 4 * shuffle_partitions(distinct.sparkSession)))
    left = tiles.join(sent, ["bits", "part"]).select("pair", F.col("nodes").alias("one"))
    names = tiles.select(F.col("bits").alias("bits2"), F.col("part").alias("part2"), "nodes")
    right = names.join(sent.where(~F.col("same")), ["bits2", "part2"]).select("pair", F.col("nodes").alias("two"))
    ready = left.repartition(tasks, "pair").join(right.repartition(tasks, "pair"), "pair", "left").select("one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                left, right = (None if x is None else np.frombuffer(x, np.int64).reshape(-1, 3) for x in (one.as_buffer(), two.as_buffer()))
                a, b = compare(_fps(left), None if right is None else _fps(right), radius)
                nodes = left if right is None else np.concatenate([left, right])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k][:, c]) for k in (a, b) for c in range(3)], names=[f"{e}_{c}" for e in "ab" for c in ("fp", "none", "least")])

    found = ready.mapInArrow(run, ", ".join(f"{e}_{c} long" for e in "ab" for c in ("fp", "none", "least")))
    node = {e: F.struct(*[F.col(f"{e}_{c}").alias(c) for c in ("none", "least", "fp")]).alias(e) for e in "ab"}
    return found.select(node["a"], node["b"]).distinct()


def _fps(nodes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(nodes[:, 0]).view(np.uint64)


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """prints with root (a fingerprint) and component_id; prints: a table with the columns doc_id and fp that is cheap to read again."""
    total = prints.count()
    smallest = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), total)
    n, most = smallest.agg(F.count(F.lit(1)), F.coalesce(F.max("copies"), F.lit(0))).first()
    nodes = smallest.select("fp", F.col("least").isNull().cast("long").alias("none"), F.coalesce("least", F.lit(0)).alias("least"))
    roots = components(links(nodes, n, radius), n).select(F.col("node")["fp"].alias("fp"), F.col("root").alias("top"))
    top = F.col("top")
    component = F.when(top.isNull(), F.col("least")).when(top["none"] == 0, top["least"])
    named = smallest.join(roots, "fp", "left").select("fp", F.coalesce(top["fp"], "fp").alias("root"), component.alias("component_id"), "copies")
    named = cut(named, n)
    limit = max(1, total // HOT_SHARE)
    few, many = named.where(F.col("copies") <= limit).drop("copies"), named.where(F.col("copies") > limit).drop("copies")
    if most <= limit:
        return in_few_tasks(prints.join(few, "fp"), total)
    rest = prints.join(F.broadcast(many.select("fp")), "fp", "left_anti").join(few, "fp")
    return in_few_tasks(rest.unionByName(prints.join(F.broadcast(many), "fp")), total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), one row per document; component_id is the smallest id reachable over links."""
    return _components(cut(fingerprints(docs, id_col, text_col)), radius).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs of which one stands for each component: that of the smallest id (nulls last), then of the smallest MD5 of the text.

    Equal rows of that id and text are reduced to one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut(_prints_with_digest(keyed))
    placed = _components(prints, radius)
    chosen = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("best"))
    chosen = chosen.select(F.col("best")["doc_id"].alias("best_id"), F.col("best")["digest"].alias("best_digest"))
    # The rows travel as one column, so no name of theirs can clash.
    marked = docs.select(whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("id"), F.md5(text).alias("digest"))
    kept = marked.join(chosen, marked["id"].eqNullSafe(chosen["best_id"]) & (marked["digest"] == chosen["best_digest"]), "left_semi")
    if not prints.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "digest"])
    return kept.select("row.*")


def _prints_with_digest(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            digests = pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array(found)], names=["doc_id", "digest", "fp"])

    return keyed.mapInArrow(run, "doc_id long, digest string, fp long")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
