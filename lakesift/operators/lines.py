"""Relief scores of rows on few lines, without a row for each pair.

Rows that are equal in all features but one (the main one, which must be continuous) are on one line, and a line's rows are in order
of that feature. Then the rows of a line that are nearer to a row than a limit are a range of it, and the nearest ones are beside one place. Running
sums by class at a range's ends give what its rows count. So the work is rows x lines look-ups, not rows x rows.

All of it are DataFrame operations. Look-ups and rows are sorted together by ranges of (line, value), running sums go over each part of
that order, and what the parts before add comes from a small table: no task needs more than a part, and the parts
follow the number of look-ups. Equal rows of a class are one run, with a number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import add
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.checkpoints import cut

if TYPE_CHECKING:
    from lakesift.operators.relief import Prepared

#: Lines are for so many rows on each at least; with fewer, pairs are the lesser work.
ROWS_A_LINE = 32
MOST_LINES = 1024
#: More features than these are hardly ever on few lines. Running sums are columns, two for each class.
MOST_FEATURES = 64
MOST_CLASSES = 32
LOOK_UPS_A_TASK = 500_000
#: Where the look-ups stand among rows of the same value.
BEFORE, ROW, BEHIND = 0, 1, 2


@dataclass
class Lines:
    """runs: (run, line, v, c, y, m, o0, o1, ...): m equal rows of class y; v is the main feature and c the same from its middle, o the others.

    lines: (h, h0, h1, ...): the values that the rows of a line share. number: of lines.
    """

    data: Prepared
    main: int | None
    runs: DataFrame
    lines: DataFrame
    number: int
    size: int

    @property
    def others(self) -> list[int]:
        return [k for k in range(self.data.p) if k != self.main]

    def apart(self, k: int) -> Column:
        """What feature k, not the main one, adds to the distance of a run's rows from those of line h."""
        a, b = F.col(f"o{k}"), F.col(f"h{k}")
        return F.when(a != b, 1.0).otherwise(0.0) if self.data.discrete[self.data.active[k]] else F.abs(a - b)

    def distance(self, main: Column) -> Column:
        """In the order of the features, as for pairs; d0, d1, ... are those apart."""
        return reduce(add, [main if k == self.main else F.col(f"d{k}") for k in range(self.data.p)])

    def to_lines(self, runs: DataFrame) -> DataFrame:
        """runs x lines, with d0, d1, ... and near: the least distance of any row there."""
        met = runs.crossJoin(F.broadcast(self.lines))
        if self.others:
            met = met.withColumns({f"d{k}": self.apart(k) for k in self.others})
        return met.drop(*[f"{s}{k}" for s in "oh" for k in self.others]).withColumn("near", self.distance(F.lit(0.0)))


def find(data: Prepared) -> Lines | None:
    """The lines of the rows, if they are few."""
    most = min(MOST_LINES, data.n // ROWS_A_LINE)
    if not most or data.p > MOST_FEATURES or len(data.class_rows) > MOST_CLASSES:
        return None
    # -0.0 is 0.0
    x = {k: F.get("x", f) + F.lit(0.0) for k, f in enumerate(data.active)}
    continuous, main = [k for k, f in enumerate(data.active) if not data.discrete[f]], None
    if continuous:
        # Two features with many values are enough to tell that lines are many.
        for some in (continuous[:2], continuous):
            about = data.rows.agg(*[F.approx_count_distinct(x[k]) for k in some]).first()
            main = max(zip(about, some))[1]
            if any(n > 1.25 * most for n, k in zip(about, some) if k != main):
                return None
            if some == continuous:
                break
    others = [k for k in range(data.p) if k != main]
    spark = data.rows.sparkSession
    shared = sorted(data.rows.select(*[x[k] for k in others]).distinct().limit(most + 1).collect()) if others else [()]
    if len(shared) > most:
        return None
    lines = spark.createDataFrame([(h, *map(float, row)) for h, row in enumerate(shared)], ", ".join(["h int", *[f"h{k} double" for k in others]]))
    v = F.lit(0.0) if main is None else x[main]
    low, high = data.rows.agg(F.min(v), F.max(v)).first()
    rows = data.rows.select("y", v.alias("v"), *[x[k].alias(f"o{k}") for k in others])
    by = [f"o{k}" for k in others]
    runs = rows.groupBy("y", "v", *by).agg(F.count(F.lit(1)).alias("m"))
    on = reduce(lambda a, b: a & b, [F.col(f"o{k}") == F.col(f"h{k}") for k in others], F.lit(True))
    runs = runs.join(F.broadcast(lines), on).withColumn("line", F.col("h")).drop(*lines.columns)
    runs = _spread(runs, data.n * len(shared))
    runs = cut(runs.select(F.monotonically_increasing_id().alias("run"), "line", "v", (F.col("v") - (low + high) / 2).alias("c"), "y", "m", *by))
    return Lines(data, main, runs, lines, len(shared), runs.count())


def _spread(rows: DataFrame, look_ups: int) -> DataFrame:
    """Tasks by the number of look-ups: few rows make many."""
    return rows.repartition(_tasks(rows, look_ups))


def _tasks(rows: DataFrame, look_ups: int) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(look_ups / LOOK_UPS_A_TASK))


def _running(events: DataFrame, sums: dict[str, Column], number: int) -> DataFrame:
    """events (line, at, side, ...) with running sums by line, in order of at and side. number: of events, about."""
    spread = cut(events.repartitionByRange(_tasks(events, number), "line", "at", "side").withColumn("part", F.spark_partition_id()))
    before = spread.groupBy("line", "part").agg(*[F.sum(x).alias(f"{name}_") for name, x in sums.items()])
    earlier = Window.partitionBy("line").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("line", "part", *[F.coalesce(F.sum(f"{name}_").over(earlier), F.lit(0)).alias(f"{name}_") for name in sums])
    order = Window.partitionBy("line", "part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = spread.withColumns({name: F.coalesce(F.sum(x).over(order), F.lit(0)) for name, x in sums.items()})
    out = out.join(F.broadcast(before), ["line", "part"])
    return out.withColumns({name: F.col(name) + F.col(f"{name}_") for name in sums}).drop("part", *[f"{name}_" for name in sums])


def _as_rows(found: Lines, *columns: Column) -> DataFrame:
    """The runs as events that running sums count, with m and c or 0."""
    return found.runs.select("line", F.col("v").alias("at"), F.lit(ROW).alias("side"), *columns)


def _looked_up(found: Lines, queries: DataFrame, number: int) -> DataFrame:
    """queries (line, at, side, ...) with n0, n1, ..., s0, s1, ...: by class the number of rows before, and the sum of their c."""
    classes = range(len(found.data.class_rows))
    events = queries.unionByName(_as_rows(found, F.col("y").alias("ry"), F.col("m").alias("rm"), (F.col("m") * F.col("c")).alias("rs")), allowMissingColumns=True)
    sums = {f"n{k}": F.when(F.col("ry") == k, F.col("rm")) for k in classes} | {f"s{k}": F.when(F.col("ry") == k, F.col("rs")) for k in classes}
    return _running(events, sums, number + found.size).where(F.col("side") != ROW)


def _all(found: Lines, letter: str) -> Column:
    return reduce(add, [F.col(f"{letter}{k}") for k in range(len(found.data.class_rows))])


def _own(found: Lines, letter: str) -> Column:
    return F.element_at(F.array(*[F.col(f"{letter}{k}") for k in range(len(found.data.class_rows))]), F.col("y") + 1)


def _with_totals(found: Lines) -> Lines:
    """lines also with the totals of each: by class tn0, ... and ts0, ... of its rows and of their c, tq of the squares of all, and low and high of v."""
    classes, m, c = range(len(found.data.class_rows)), F.col("m"), F.col("c")
    sums = [F.coalesce(F.sum(F.when(F.col("y") == k, m)), F.lit(0)).alias(f"tn{k}") for k in classes]
    sums += [F.coalesce(F.sum(F.when(F.col("y") == k, m * c)), F.lit(0.0)).alias(f"ts{k}") for k in classes]
    totals = found.runs.groupBy(F.col("line").alias("h")).agg(*sums, F.sum(m * c * c).alias("tq"), F.min("v").alias("low"), F.max("v").alias("high"))
    return replace(found, lines=cut(found.lines.join(F.broadcast(totals), "h"), found.number))


def _by_run(looked_up: DataFrame, sums: dict[str, Column], met: DataFrame, whole: dict[str, Column]) -> DataFrame:
    """Sums by run over its look-ups and over the lines that it meets; a name in both is added up."""
    here = looked_up.groupBy("run").agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    there = met.groupBy("run").agg(*[F.sum(x).alias(f"{name}_") for name, x in whole.items()]) if whole else met.select("run").distinct()
    zero, names = F.lit(0.0), list(dict.fromkeys([*sums, *whole]))
    each = {name: (F.coalesce(name, zero) if name in sums else zero) + (F.col(f"{name}_") if name in whole else zero) for name in names}
    return there.join(here, "run", "left").select("run", *[x.alias(name) for name, x in each.items()])


def _limits(found: Lines, kind: str) -> DataFrame:
    """(run, limit) from the sums of distances and of their squares over all lines."""
    n, c, near = found.data.n, F.col("c"), F.col("near")
    met = found.to_lines(found.runs)
    inside = met.where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("high")))
    queries = inside.select("run", F.col("h").alias("line"), F.col("v").alias("at"), F.lit(BEHIND).alias("side"), "c", "near")
    looked_up = _looked_up(found, queries, found.size * found.number)
    # Twice what the rows before add, less the line's whole sum of differences.
    before = 2 * (c * _all(found, "n") - _all(found, "s"))
    count, total = _all(found, "tn"), _all(found, "ts")
    whole = F.when(F.col("v") >= F.col("high"), c * count - total).otherwise(total - c * count)
    square = F.col("tq") - 2 * c * total + c * c * count
    by_run = _by_run(
        looked_up, {"total": before, "square": 2 * near * before}, met, {"total": whole + near * count, "square": square + 2 * near * whole + near * near * count}
    )
    mean = F.col("total") / (n - 1)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("square") / (n - 1) - mean * mean))
    return by_run.select("run", (mean if kind == "surf" else mean - spread / 2).alias("limit"))


def _near_scores(found: Lines, kind: str, star: bool) -> list[float]:
    """A range's rows are those before its last end less those before its first; their differences, those before the run's own place
    twice, less those before either end."""
    found = _with_totals(found)
    limited = cut(_spread(found.runs.join(_limits(found, kind), "run"), found.size * found.number))
    met = found.to_lines(limited)
    v, c, radius, within = F.col("v"), F.col("c"), F.col("limit") - F.col("near"), F.col("near") < F.col("limit")
    # Ends leave out what is as far as the limit, and never what is equal. counts: how often an end's rows count; amounts: their differences.
    ends = [(v - radius, F.when(v - radius < v, BEHIND).otherwise(BEFORE), within, -1, -1), (v, F.lit(BEHIND), F.lit(True) if star else within, 0, 2)]
    ends.append((v + radius, F.when(v + radius > v, BEFORE).otherwise(BEHIND), within, 1, -1))
    asked = [F.struct(F.when(wanted, at).alias("at"), side.alias("side"), F.lit(n).alias("counts"), F.when(within, m).otherwise(0).alias("amounts")) for at, side, wanted, n, m in ends]
    apart = [f"d{k}" for k in found.others]
    queries = met.select("run", F.col("h").alias("line"), "low", "y", "c", *apart, F.explode(F.array(*asked)).alias("end")).where(F.col("end.at") >= F.col("low"))
    queries = queries.select("run", "line", "y", "c", *apart, "end.at", "end.side", "end.counts", "end.amounts")
    looked_up = _looked_up(found, queries, found.size * found.number * 3)
    n_hit, s_hit = _own(found, "n"), _own(found, "s")
    looked_up = looked_up.select("run", "c", *apart, "counts", "amounts", n_hit.alias("n_hit"), (_all(found, "n") - n_hit).alias("n_miss"), s_hit.alias("s_hit"), (_all(found, "s") - s_hit).alias("s_miss"))
    counts, amounts, sums, whole = F.col("counts"), F.col("amounts"), {}, {}
    for name in ("hit", "miss"):
        before = c * F.col(f"n_{name}") - F.col(f"s_{name}")
        sums |= {f"n_{name}": counts * F.col(f"n_{name}"), name: amounts * before}
        sums |= {f"{name}{k}": F.col(f"d{k}") * counts * F.col(f"n_{name}") for k in found.others}
        if star:
            n, s = _own(found, "tn"), _own(found, "ts")
            n, s = (n, s) if name == "hit" else (_all(found, "tn") - n, _all(found, "ts") - s)
            sums[f"all_{name}"], whole[f"all_{name}"] = F.when(counts == 0, 2 * before).otherwise(0.0), s - c * n
            whole |= {f"all_{name}{k}": F.col(f"d{k}") * n for k in found.others}
    by_run = _by_run(looked_up, sums, limited if not star else met, whole).join(limited.select("run", "m", "limit"), "run")
    # A row isn't its own hit.
    by_run = by_run.withColumn("n_hit", F.col("n_hit") - F.when(F.col("limit") > 0, 1).otherwise(0))
    scores = []
    for k in range(found.data.p):
        name = "" if k == found.main else str(k)
        hit, miss = F.col(f"hit{name}"), F.col(f"miss{name}")
        far_hit, far_miss = (F.col(f"all_hit{name}") - hit, F.col(f"all_miss{name}") - miss) if star else (F.lit(0.0), F.lit(0.0))
        if kind == "surf":
            scores.append(miss - hit - far_miss + far_hit)
        else:
            scores.append((miss - far_miss) / F.greatest("n_miss", F.lit(1)) - hit / F.greatest("n_hit", F.lit(1)))
    row = by_run.agg(*[F.sum(F.col("m") * s) for s in scores]).first()
    return [(s or 0.0) / found.data.n for s in row]


def _ranked(found: Lines, keys: int) -> DataFrame | None:
    """(line, y, rank, v, keys): a run's rank by value among those of its line and class, and its first keys. None if values are too close to tell distances apart."""
    data = found.data
    classes = range(len(data.class_rows))
    events = _as_rows(found, "run", "v", "y", "m", "c", *[f"o{k}" for k in found.others])
    ranked = cut(_running(events, {f"r{k}": F.when(F.col("y") == k, 1) for k in classes}, found.size).drop("at", "side"))
    ranked = ranked.withColumn("rank", F.element_at(F.array(*[f"r{k}" for k in classes]), F.col("y") + 1))
    following = ranked.select("line", "y", (F.col("rank") - 1).alias("rank"), F.col("v").alias("next"))
    gap = ranked.join(following, ["line", "y", "rank"]).agg(F.min(F.col("next") - F.col("v"))).first()[0]
    if gap is not None and gap <= 1e-15 * data.p * data.p:
        return None
    x = {k: F.get("x", f) + F.lit(0.0) for k, f in enumerate(data.active)}
    by = ["y", "v", *[f"o{k}" for k in found.others]]
    rows = data.rows.select("key", "y", (F.lit(0.0) if found.main is None else x[found.main]).alias("v"), *[x[k].alias(f"o{k}") for k in found.others])
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("place") <= keys)
    first = first.groupBy(*by).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return cut(ranked.join(first, by))


def _nearest_runs(found: Lines, asked: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """(run, of, best): for runs asked (run, y, v, of, line, rank, d0, ...) about class `of` on a line, the k nearest rows there, or k + 1 of the own class, sorted.

    rank: how many runs of that line and class have no greater value.
    """
    there = runs.select("line", F.col("y").alias("of"), F.col("rank").alias("place"), F.col("v").alias("w"), "keys")
    places = F.sequence(F.greatest(F.lit(1), F.col("rank") - k), F.col("rank") + k + 1)
    met = asked.withColumn("place", F.explode(places)).join(there, ["line", "of", "place"])
    main = F.abs(F.col("v") - F.col("w"))
    dist = found.distance(main)
    amounts = F.array(*[main if f == found.main else F.col(f"d{f}") for f in range(found.data.p)])
    entries = F.transform("keys", lambda key: F.struct(dist.alias("dist"), key.alias("key"), amounts.alias("amounts")))
    return _best(met.select("run", "of", "y", entries.alias("best")), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = F.array_sort(F.flatten(F.collect_list("best")))
    wanted = F.when(F.col("y") == F.col("of"), k + 1).otherwise(k)
    return found.groupBy("run", "of", "y").agg(best.alias("best")).withColumn("best", F.slice("best", F.lit(1), wanted))


def _relieff_scores(found: Lines, k: int) -> list[float] | None:
    """A row's nearest rows are first looked for on its own line; other lines then only matter if they're as near."""
    from lakesift.operators.relief import _class_weight

    data = found.data
    runs = _ranked(found, k + 1)
    if runs is None:
        return None
    classes = range(len(data.class_rows))

    def by_class(ranks: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c).alias("of"), F.col(f"r{c}").alias("rank")) for c in classes])
        return ranks.withColumn("each", F.explode(each)).withColumns({"of": F.col("each.of"), "rank": F.col("each.rank")}).drop("each", *[f"r{c}" for c in classes])

    own = by_class(runs.select("run", "line", "v", "y", *[F.lit(0.0).alias(f"d{f}") for f in found.others], *[f"r{c}" for c in classes]))
    best = _nearest_runs(found, own, runs, k)
    wanted = F.when(F.col("y") == F.col("of"), k + 1).otherwise(k)
    each = runs.select("run", "line", "y", "v", "m", *[f"o{f}" for f in found.others]).withColumn("of", F.explode(F.array(*[F.lit(c) for c in classes])))
    each = each.join(best.drop("y"), ["run", "of"], "left")
    each = cut(_spread(each, found.size * found.number).withColumn("best", F.coalesce("best", F.array().cast("array<struct<dist:double,key:bigint,amounts:array<double>>>"))))
    bound = F.when(F.size("best") < wanted, float("inf")).otherwise(F.element_at("best", -1)["dist"])
    # Only the line's row of these columns is of use here, so the lists stay behind.
    narrow = each.select("run", "of", "line", "y", "v", *[f"o{f}" for f in found.others], bound.alias("bound"))
    queries = found.to_lines(narrow).where((F.col("h") != F.col("line")) & (F.col("near") <= F.col("bound")))
    queries = cut(queries.select("run", "of", F.col("h").alias("line"), F.col("v").alias("at"), F.lit(BEHIND).alias("side"), "y", "v", *[f"d{f}" for f in found.others]))
    number = queries.count()
    if number:
        events = queries.unionByName(_as_rows(found, F.col("y").alias("ry")), allowMissingColumns=True)
        looked_up = _running(events, {f"r{c}": F.when(F.col("ry") == c, 1) for c in classes}, number + found.size).where(F.col("side") != ROW)
        asked = looked_up.withColumn("rank", F.element_at(F.array(*[f"r{c}" for c in classes]), F.col("of") + 1)).drop("at", "side", "ry", *[f"r{c}" for c in classes])
        more = _nearest_runs(found, asked, runs, k).select("run", "of", F.col("best").alias("more"))
        each = each.join(more, ["run", "of"], "left")
        each = each.withColumn("best", F.slice(F.array_sort(F.concat("best", F.coalesce("more", F.array().cast("array<struct<dist:double,key:bigint,amounts:array<double>>>")))), F.lit(1), wanted))
    # Of the own class, the row itself is among the first k + 1, or as many equal ones are; either adds nothing.
    weight = F.col("m") * _class_weight(data, k, F.col("y") == F.col("of"), F.col("y"), F.col("of"))
    amounts = [F.transform("best", lambda entry: F.get(entry["amounts"], f)) for f in range(data.p)]
    sums = [F.sum(weight * F.aggregate(x, F.lit(0.0), lambda total, one: total + one)) for x in amounts]
    return [(s or 0.0) / data.n for s in each.agg(*sums).first()]


def scores(data: Prepared, kind: str, k: int, star: bool) -> list[float] | None:
    """None if the rows aren't on few lines."""
    found = find(data)
    if found is None:
        return None
    return _relieff_scores(found, k) if kind == "relieff" else _near_scores(found, kind, star)
