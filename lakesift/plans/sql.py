"""SQL texts that give the rows of the catalogue's queries in any engine with window functions."""

from __future__ import annotations

import itertools

EVENTS = "(SELECT event_type, value, hour(ts)::DOUBLE AS hour, regexp_extract(props, '\"k\":\\s*(-?[0-9.]+)', 1)::DOUBLE AS k FROM events)"
CODES = (
    "(SELECT l_linenumber AS linenumber, round(l_discount * 100)::INTEGER AS discount, round(l_tax * 100)::INTEGER AS tax, trunc(l_quantity)::INTEGER AS quantity, "
    "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM lineitem)"
)
_BIN = "least(9, floor(({x} - min({x}) OVER ()) * 10 / (max({x}) OVER () - min({x}) OVER ())))::INTEGER"
PLANTED = (
    "(SELECT floor((l_quantity - 1) / 10)::INTEGER AS y, " + _BIN.format(x="l_quantity") + " AS q, " + _BIN.format(x="(l_quantity + 3 * l_linenumber)") + " AS qn, "
    "l_linenumber AS linenumber, round(l_discount * 100)::INTEGER AS discount FROM lineitem)"
)
TWO = (
    "(SELECT 2 * (l_quantity > 25)::INTEGER + (l_linenumber > 4)::INTEGER AS y, "
    + ", ".join(_BIN.format(x=c) + f" AS {c}" for c in ("l_quantity", "l_discount", "l_tax"))
    + ", l_linenumber FROM lineitem)"
)
GENES = (
    "SELECT l_orderkey * 10 + l_linenumber AS key, l_linenumber % 3 AS g0, trunc(l_quantity)::INTEGER % 3 AS g1, round(l_discount * 100)::INTEGER % 3 AS g2, "
    "round(l_tax * 100)::INTEGER % 3 AS g3, (l_linenumber % 3 = 1 AND trunc(l_quantity)::INTEGER % 3 = 1)::INTEGER AS y FROM lineitem"
)
BIN_UNIFORM = "SELECT bin, count(*) AS n FROM (SELECT " + _BIN.format(x="l_extendedprice") + " AS bin FROM lineitem) GROUP BY bin"
BIN_QUANTILE = (
    "WITH e AS (SELECT DISTINCT unnest(quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM customer) "
    "SELECT bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM e WHERE edge <= c_acctbal)::INTEGER AS bin FROM customer) GROUP BY bin"
)


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def chi2(source: str, label: str, features: list[str], dof: int) -> str:
    sums = ", ".join(f"sum({c})::DOUBLE AS s{k}" for k, c in enumerate(features))
    long = _union(f"SELECT n, {k} AS feature_idx, '{c}' AS feature, s{k} AS o FROM s" for k, c in enumerate(features))
    tail = {2: "exp(-x / 2)", 4: "exp(-x / 2) * (1 + x / 2)"}[dof]
    return f"""WITH s AS (SELECT {label} AS y, count(*)::DOUBLE AS n, {sums} FROM {source} GROUP BY {label}),
l AS ({long}),
e AS (SELECT *, n * sum(o) OVER (PARTITION BY feature_idx) / sum(n) OVER (PARTITION BY feature_idx) AS ex FROM l),
c AS (SELECT feature_idx, feature, coalesce(sum(CASE WHEN ex > 1e-12 THEN (o - ex) * (o - ex) / ex END), 0) AS x FROM e GROUP BY feature_idx, feature)
SELECT feature_idx, feature, round(x, 4) AS chi2, round({tail}, 6) AS p_value FROM c"""


def _wide(p: int) -> str:
    return f"wide AS (SELECT label % 3 AS y, k::INTEGER AS feature_idx, abs(embedding[k % 64 + 1]::DOUBLE) * (1 + k // 64) AS v FROM embeddings, range({p}) t(k))"


def chi2_wide(p: int) -> str:
    return f"""WITH {_wide(p)}, sizes AS (SELECT label % 3 AS y, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1),
sums AS (SELECT feature_idx, y, sum(v) AS o FROM wide GROUP BY ALL),
e AS (SELECT feature_idx, o, n * sum(o) OVER (PARTITION BY feature_idx) / (SELECT sum(n) FROM sizes) AS ex FROM sums JOIN sizes USING (y)),
c AS (SELECT feature_idx, coalesce(sum(CASE WHEN ex > 1e-12 THEN (o - ex) * (o - ex) / ex END), 0) AS x FROM e GROUP BY feature_idx)
SELECT feature_idx, round(x, 4) AS chi2, round(exp(-x / 2), 6) AS p_value FROM c"""


def ranges_wide(p: int, limit: int) -> str:
    return f"WITH {_wide(p)} SELECT feature_idx, min(v) AS low, max(v) AS high, count(DISTINCT v) <= {limit} AS is_discrete FROM wide GROUP BY feature_idx"


def projected(subset: str, expected: list[str]) -> str:
    """The selected columns of lineitem; there are no rows if the subset that the SQL finds is another one."""
    names = ", ".join(f"'{c}'" for c in expected)
    return f"SELECT l_orderkey, {', '.join(expected)} FROM lineitem WHERE (SELECT list(feature ORDER BY feature_idx) FROM ({subset})) = [{names}]"


def profile(source: str, features: list[str], limit: int) -> str:
    return _union(
        f"SELECT {k} AS feature_idx, '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, count(DISTINCT {c}) <= {limit} AS is_discrete FROM {source}"
        for k, c in enumerate(features)
    )


def _cells(source: str, pairs: list[tuple[str, str]]) -> str:
    return _union(f"SELECT {k} AS pair, {a}::VARCHAR AS x, {b}::VARCHAR AS y, count(*)::DOUBLE AS n FROM {source} GROUP BY {a}, {b}" for k, (a, b) in enumerate(pairs))


def _shares(source: str, pairs: list[tuple[str, str]]) -> str:
    return f"""cells AS ({_cells(source, pairs)}),
shares AS (SELECT pair, n / sum(n) OVER (PARTITION BY pair) AS p, sum(n) OVER (PARTITION BY pair, x) / sum(n) OVER (PARTITION BY pair) AS px,
  sum(n) OVER (PARTITION BY pair, y) / sum(n) OVER (PARTITION BY pair) AS py FROM cells)"""


def _mi(unit: str = "bit") -> str:
    return "mis AS (SELECT pair, sum(CASE WHEN p > 1e-12 THEN p * ln(p / (px * py + 1e-12)) ELSE 0 END)" + (" / ln(2)" if unit == "bit" else "") + " AS mi FROM shares GROUP BY pair)"


_SU = """sus AS (SELECT pair, sum(CASE WHEN p > 1e-12 THEN p * log2(p / (px * py)) ELSE 0 END) AS i, -sum(CASE WHEN px > 1e-12 THEN p * log2(px) ELSE 0 END) AS hx,
  -sum(CASE WHEN py > 1e-12 THEN p * log2(py) ELSE 0 END) AS hy FROM shares GROUP BY pair),
su AS (SELECT pair, CASE WHEN hx + hy < 1e-12 THEN 0 ELSE 2 * i / (hx + hy) END AS su, hx, hy FROM sus)"""


def _names(features: list[str]) -> str:
    return "names(pair, feature) AS (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(features)) + ")"


def _index(n: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(n), 2))


def _index_table(n: int) -> str:
    return "places(pair, f1, f2) AS (VALUES " + ", ".join(f"({k}, {i}, {j})" for k, (i, j) in enumerate(_index(n))) + ")"


def relevance(source: str, features: list[str], label: str, unit: str) -> str:
    return f"""WITH {_shares(source, [(c, label) for c in features])}, {_mi(unit)}, {_names(features)}
SELECT pair AS feature_idx, feature, round(mi, 9) AS mi FROM mis JOIN names USING (pair)"""


def redundancy(source: str, features: list[str]) -> str:
    pairs = [(features[i], features[j]) for i, j in _index(len(features))]
    return f"WITH {_shares(source, pairs)}, {_mi()}, {_index_table(len(features))} SELECT f1, f2, round(mi, 9) AS mi FROM mis JOIN places USING (pair)"


def su_relevance(source: str, features: list[str], label: str) -> str:
    return f"WITH {_shares(source, [(c, label) for c in features])}, {_SU} SELECT pair AS feature_idx, round(su, 9) AS su, round(hx, 9) AS hx, round(hy, 9) AS hy FROM su"


def su_matrix(source: str, features: list[str]) -> str:
    pairs = [(features[i], features[j]) for i, j in _index(len(features))]
    return f"WITH {_shares(source, pairs)}, {_SU}, {_index_table(len(features))} SELECT f1, f2, round(su, 9) AS su FROM su JOIN places USING (pair)"


def mrmr(source: str, features: list[str], label: str, method: str) -> str:
    """Two steps."""
    p = len(features)
    pairs = [(c, label) for c in features] + [(features[i], features[j]) for i, j in _index(p)]
    between = "both_ways(f, g, mi) AS (" + _union(f"SELECT {a}, {b}, mi FROM mis WHERE pair = {p + k}" for k, (i, j) in enumerate(_index(p)) for a, b in ((i, j), (j, i))) + ")"
    score = "r.mi - b.mi" if method == "MID" else "r.mi / (b.mi + 1e-9)"
    return f"""WITH {_shares(source, pairs)}, {_mi()}, {_names(features)}, {between},
one AS (SELECT pair AS f, mi FROM mis WHERE pair < {p} ORDER BY mi DESC, pair LIMIT 1),
two AS (SELECT r.pair AS f, {score} AS score FROM mis r JOIN one ON r.pair <> one.f JOIN both_ways b ON b.f = one.f AND b.g = r.pair WHERE r.pair < {p} ORDER BY score DESC, r.pair LIMIT 1),
steps AS (SELECT 1 AS step, f, mi AS score FROM one UNION ALL SELECT 2, f, score FROM two)
SELECT step, f AS feature_idx, feature, round(score, 6) AS score FROM steps JOIN names ON f = pair"""


def cfs(source: str, features: list[str], label: str) -> str:
    """The greedy search, a step a table, then the pruning."""
    p = len(features)
    pairs = [(c, label) for c in features] + [(features[i], features[j]) for i, j in _index(p)]
    both = "r_ff(f, g, r) AS (" + _union(f"SELECT {a}, {b}, su FROM su WHERE pair = {p + k}" for k, (i, j) in enumerate(_index(p)) for a, b in ((i, j), (j, i))) + ")"
    steps = [
        "r_cf AS (SELECT pair AS f, su AS r FROM su WHERE pair < " + str(p) + ")",
        "step1 AS (SELECT CASE WHEN r >= 0.1 THEN [f] ELSE [] END AS chosen, r AS merit FROM r_cf ORDER BY r DESC, f LIMIT 1)",
    ]
    for k in range(1, p):
        steps.append(
            f"""cand{k} AS (SELECT c.f, ((SELECT sum(r) FROM r_cf WHERE list_contains(s.chosen, f)) + c.r) / sqrt({k + 1} + (SELECT coalesce(sum(r), 0) FROM r_ff
  WHERE list_contains(list_append(s.chosen, c.f), f) AND list_contains(list_append(s.chosen, c.f), g))) AS merit
  FROM step{k} s JOIN r_cf c ON NOT list_contains(s.chosen, c.f) AND c.r >= 0.1 WHERE len(s.chosen) = {k} ORDER BY merit DESC, c.f LIMIT 1)"""
        )
        steps.append(
            f"step{k + 1} AS (SELECT CASE WHEN c.merit > s.merit THEN list_append(s.chosen, c.f) ELSE s.chosen END AS chosen, greatest(s.merit, coalesce(c.merit, s.merit)) AS merit FROM step{k} s LEFT JOIN cand{k} c ON TRUE)"
        )
    return f"""WITH {_shares(source, pairs)}, {_SU}, {_names(features)}, {both}, {", ".join(steps)},
found AS (SELECT c.f, c.r FROM r_cf c JOIN step{p} s ON list_contains(s.chosen, c.f)),
kept AS (SELECT a.f, a.r FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b JOIN r_ff ON r_ff.f = b.f AND r_ff.g = a.f WHERE (b.r > a.r OR (b.r = a.r AND b.f < a.f)) AND r_ff.r >= a.r)),
final AS (SELECT sum(r) / sqrt(count(*) + (SELECT coalesce(sum(x.r), 0) FROM r_ff x JOIN kept a ON x.f = a.f JOIN kept b ON x.g = b.f)) AS merit FROM kept)
SELECT f AS feature_idx, feature, round(merit, 6) AS merit FROM kept JOIN names ON f = pair, final"""


def _scaled(rows: str, p: int, limit: int = 10) -> str:
    stats = ", ".join(f"count(DISTINCT x{k}) <= {limit} AS disc{k}, max(x{k}) - min(x{k}) AS r{k}" for k in range(p))
    values = ", ".join(f"CASE WHEN disc{k} OR r{k} = 0 THEN x{k} ELSE x{k} / r{k} END AS f{k}" for k in range(p))
    return f"raw AS ({rows}), stats AS (SELECT {stats} FROM raw), scaled AS (SELECT id, y, {values} FROM raw, stats)"


def relief(kind: str, rows: str, features: list[str], k: int = 0, star: bool = False) -> str:
    p = len(features)
    diffs = ", ".join(f"CASE WHEN disc{f} THEN (a.f{f} <> b.f{f})::INTEGER::DOUBLE ELSE abs(a.f{f} - b.f{f}) END AS d{f}" for f in range(p))
    dist = " + ".join(f"d{f}" for f in range(p))
    head = f"""WITH {_scaled(rows, p)}, pairs AS (SELECT *, {dist} AS dist FROM (SELECT a.id AS i, b.id AS j, a.y <> b.y AS miss, a.y AS yi, b.y AS yj, {diffs} FROM scaled a JOIN scaled b ON a.id <> b.id, stats)),
size AS (SELECT count(*)::DOUBLE AS n FROM raw)"""
    if kind == "relieff":
        middle = f"""counts AS (SELECT y, count(*)::DOUBLE AS c FROM raw GROUP BY y),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, yj ORDER BY dist, j) AS place FROM pairs) WHERE place <= {k}),
weighed AS (SELECT near.*, CASE WHEN miss THEN cj.c / (n - ci.c) / {k} ELSE -1 / least({k}, ci.c) END AS w FROM near JOIN counts ci ON ci.y = yi JOIN counts cj ON cj.y = yj, size)"""
        total = [f"(SELECT sum(d{f} * w) FROM weighed)" for f in range(p)]
    elif kind == "surf":
        middle = f"""limits AS (SELECT i, avg(dist) AS lim FROM pairs GROUP BY i),
weighed AS (SELECT pairs.*, CASE WHEN dist < lim THEN CASE WHEN miss THEN 1 ELSE -1 END ELSE {"CASE WHEN miss THEN -1 ELSE 1 END" if star else "0"} END AS w FROM pairs JOIN limits USING (i))"""
        total = [f"(SELECT sum(d{f} * w) FROM weighed)" for f in range(p)]
    else:
        sums = ", ".join(
            f"sum(CASE WHEN near AND miss THEN d{f} {f'WHEN NOT near AND miss THEN -d{f}' if star else ''} ELSE 0 END) AS m{f}, sum(CASE WHEN near AND NOT miss THEN d{f} ELSE 0 END) AS h{f}" for f in range(p)
        )
        middle = f"""limits AS (SELECT i, avg(dist) - sqrt(greatest(0, avg(dist * dist) - avg(dist) * avg(dist))) / 2 AS lim FROM pairs GROUP BY i),
near AS (SELECT pairs.*, dist < lim AS near FROM pairs JOIN limits USING (i)),
weighed AS (SELECT i, greatest(1, count(*) FILTER (near AND miss)) AS nm, greatest(1, count(*) FILTER (near AND NOT miss)) AS nh, {sums} FROM near GROUP BY i)"""
        total = [f"(SELECT sum(m{f} / nm - h{f} / nh) FROM weighed)" for f in range(p)]
    out = _union(f"SELECT {f} AS feature_idx, '{c}' AS feature, disc{f} AS is_discrete, round(coalesce({total[f]}, 0) / n + 0.0, 6) AS score FROM size, stats" for f, c in enumerate(features))
    return f"{head}, {middle} {out}"


def turf(rows: str, features: list[str], keep: int, share: float, rounds: int) -> str:
    """MultiSURF on continuous features, round by round; a round drops a share of those that are left, at least one, and none once keep are left."""
    p = len(features)
    parts = [_scaled(rows, p), "long AS (" + _union(f"SELECT id, y, {f} AS f, f{f} AS x FROM scaled" for f in range(p)) + ")", "size AS (SELECT count(*)::DOUBLE AS n FROM raw)", f"act0 AS (SELECT unnest(range({p})) AS f)"]
    for r in range(rounds):
        parts.append(
            f"""pair{r} AS (SELECT a.id AS i, b.id AS j, a.y <> b.y AS miss, a.f, abs(a.x - b.x) AS d FROM long a JOIN long b ON a.f = b.f AND a.id <> b.id JOIN act{r} ON act{r}.f = a.f),
dist{r} AS (SELECT i, j, sum(d) AS dist FROM pair{r} GROUP BY i, j),
lim{r} AS (SELECT i, avg(dist) - sqrt(greatest(0, avg(dist * dist) - avg(dist) * avg(dist))) / 2 AS lim FROM dist{r} GROUP BY i),
near{r} AS (SELECT p.* FROM pair{r} p JOIN dist{r} t ON p.i = t.i AND p.j = t.j JOIN lim{r} l ON l.i = p.i WHERE dist < lim),
row{r} AS (SELECT i, f, coalesce(sum(d) FILTER (miss) / greatest(1, count(*) FILTER (miss)), 0) - coalesce(sum(d) FILTER (NOT miss) / greatest(1, count(*) FILTER (NOT miss)), 0) AS s FROM near{r} GROUP BY i, f),
score{r} AS (SELECT f, sum(s) / any_value(n) AS s FROM row{r}, size GROUP BY f),
act{r + 1} AS (SELECT f FROM (SELECT f, row_number() OVER (ORDER BY s, f) AS place, count(*) OVER () AS here FROM score{r}) WHERE place > least(greatest(1, floor(here * {share})), here - {keep}))"""
        )
    names = _names(features)
    return f"WITH {', '.join(parts)}, {names} SELECT pair::INTEGER AS feature_idx, feature, round(s, 6) AS score, pair IN (SELECT f FROM act{rounds}) AS survives FROM names JOIN score0 ON score0.f = pair"


def _combos(genes: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(genes, 2))


def _by_cell(genes: list[str], by: str = "") -> str:
    return _union(
        f"SELECT {k} AS combo, {a} * 3 + {b} AS cell{by}, count(*) FILTER (y = 1) AS cases, count(*) FILTER (y = 0) AS controls FROM rows GROUP BY ALL" for k, (a, b) in enumerate(_combos(genes))
    )


def mdr_accuracy(genes: list[str]) -> str:
    return f"""WITH rows AS ({GENES}), cells AS ({_by_cell(genes)}), sizes AS (SELECT count(*) FILTER (y = 1) AS nc, count(*) FILTER (y = 0) AS n0 FROM rows)
SELECT combo, round((sum(CASE WHEN controls = 0 OR cases * n0 > controls * nc THEN cases ELSE 0 END)::DOUBLE / any_value(nc)
  + sum(CASE WHEN controls = 0 OR cases * n0 > controls * nc THEN 0 ELSE controls END)::DOUBLE / any_value(n0)) / 2, 9) AS ba FROM cells, sizes GROUP BY combo"""


def _winners(genes: list[str], cv: int, order: list[str]) -> str:
    return f"""plain AS ({GENES}), rows AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY {', '.join(order)}) - 1) % {cv})::INTEGER AS fold FROM plain),
cells AS ({_by_cell(genes, ", fold")}),
folds AS (SELECT fold, count(*) FILTER (y = 1) AS fc, count(*) FILTER (y = 0) AS f0 FROM rows GROUP BY fold),
sizes AS (SELECT *, sum(fc) OVER () - fc AS nc, sum(f0) OVER () - f0 AS n0 FROM folds),
whole AS (SELECT combo, cell, sum(cases) AS ac, sum(controls) AS a0 FROM cells GROUP BY combo, cell),
seen AS (SELECT w.combo, w.cell, s.*, coalesce(c.cases, 0) AS tc, coalesce(c.controls, 0) AS t0, ac - coalesce(c.cases, 0) AS rc, a0 - coalesce(c.controls, 0) AS r0
  FROM whole w CROSS JOIN sizes s LEFT JOIN cells c ON c.combo = w.combo AND c.cell = w.cell AND c.fold = s.fold),
judged AS (SELECT *, r0 = 0 OR rc * n0 > r0 * nc AS high, rc / (r0 + 1e-9) > nc::DOUBLE / n0 AS risk FROM seen),
scored AS (SELECT combo, fold, (sum(CASE WHEN high THEN rc ELSE 0 END)::DOUBLE / any_value(nc) + sum(CASE WHEN high THEN 0 ELSE r0 END)::DOUBLE / any_value(n0)) / 2 AS train_ba,
  (sum(CASE WHEN risk THEN tc ELSE 0 END)::DOUBLE / any_value(fc) + sum(CASE WHEN risk THEN 0 ELSE t0 END)::DOUBLE / any_value(f0)) / 2 AS test_ba FROM judged GROUP BY combo, fold),
won AS (SELECT fold, combo, train_ba, test_ba FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_ba DESC, combo) AS place FROM scored) WHERE place = 1)"""


def mdr_winners(genes: list[str], cv: int) -> str:
    return f"WITH {_winners(genes, cv, ['key', *genes])} SELECT fold, combo, round(train_ba, 9) AS train_ba, round(test_ba, 9) AS test_ba FROM won"


def _model(genes: list[str], cv: int) -> str:
    """The combination that most folds chose, then of the best mean, then of the first fold; its cells and their risk."""
    pairs = ", ".join(f"({k}, {genes.index(a)}, {genes.index(b)})" for k, (a, b) in enumerate(_combos(genes)))
    return f"""{_winners(genes, cv, ["key"])},
best AS (SELECT combo FROM won GROUP BY combo ORDER BY count(*) DESC, avg(test_ba) DESC, min(fold) LIMIT 1),
pairs(combo, first, second) AS (VALUES {pairs}), nine AS (SELECT unnest(range({3 ** 2}))::INTEGER AS cell),
lim AS (SELECT count(*) FILTER (y = 1)::DOUBLE / count(*) FILTER (y = 0) AS lim FROM rows),
lut AS (SELECT nine.cell, first, second, coalesce(ac / (a0 + 1e-9) > lim, FALSE)::INTEGER AS high_risk
  FROM best JOIN pairs USING (combo) CROSS JOIN nine CROSS JOIN lim LEFT JOIN whole ON whole.combo = best.combo AND whole.cell = nine.cell)"""


def mdr_lut(genes: list[str], cv: int) -> str:
    return f"WITH {_model(genes, cv)} SELECT cell, first, second, high_risk FROM lut"


def mdr_predict(genes: list[str], cv: int) -> str:
    listed = f"[{', '.join(genes)}]"
    return f"""WITH {_model(genes, cv)} SELECT y, high_risk AS prediction, count(*) AS n
FROM rows JOIN lut ON {listed}[first + 1] * 3 + {listed}[second + 1] = lut.cell GROUP BY ALL"""
