"""SQL for the catalogue's rows, written from the semantics and run by another engine."""

from __future__ import annotations

from itertools import product

from ..sources.tables import CATEGORICAL, CLICK_COLUMNS
from . import queries as q

CV = "cv AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in CLICK_COLUMNS.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey)"
SC = f"{CV}, st AS (SELECT avg(age) AS m, stddev_pop(age) AS s FROM cv), z AS (SELECT cv.* EXCLUDE (age), (age - m) / s AS age FROM cv, st), im AS (SELECT avg(age) AS m FROM z), za AS (SELECT z.* EXCLUDE (age), coalesce(age, m) AS age FROM z, im)"
CATS = {
    "gender": ["Female", "Male", "Non-Binary"],
    "device_type": ["Desktop", "Mobile", "Tablet"],
    "ad_position": ["Bottom", "Side", "Top"],
    "browsing_history": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "time_of_day": ["Afternoon", "Evening", "Morning", "Night"],
}
EDGES = "ed AS (SELECT round(min(age), 9) AS e0, round(avg(age) - 2 * stddev_samp(age), 9) AS e1, round(avg(age) - stddev_samp(age), 9) AS e2, round(avg(age) - 0.5 * stddev_samp(age), 9) AS e3, round(avg(age), 9) AS e4, round(avg(age) + 0.5 * stddev_samp(age), 9) AS e5, round(avg(age) + stddev_samp(age), 9) AS e6, round(avg(age) + 2 * stddev_samp(age), 9) AS e7, round(max(age), 9) AS e8 FROM za)"
BIN = "CASE " + " ".join(f"WHEN round(age, 9) > e{i - 1} AND round(age, 9) <= e{i} THEN {i}" for i in range(1, 9)) + " END"


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def name(*parts: str) -> str:
    return "_".join(parts).lower().replace("-", "_")


def dummies(columns: dict[str, list]) -> list[tuple[str, str]]:
    out = []
    for c, values in columns.items():
        out += [(name(c, str(v)), f"CASE WHEN {c} = {v if isinstance(v, int) else repr(v)} THEN 1.0 ELSE 0.0 END::DOUBLE") for v in values[1:]]
        out.append((name(c, "nan"), f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE"))
    return [(n, f"({x.removesuffix('::DOUBLE')})::DOUBLE") for n, x in out]


def sums(source: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {rnd(f'sum({x})')} AS total FROM {source}" for n, x in columns)


PAIRS = "p AS (SELECT ((p_size % 3) - 1)::DOUBLE AS a, (p_partkey % 7) / 4.0::DOUBLE - 0.75 AS p, p_size::DOUBLE AS x1, (p_partkey % 5)::DOUBLE AS x2 FROM part)"
WRONG = "CASE WHEN a * p <= 0 THEN a ELSE 0.0 END"
LOSS = {"MSE": "(a - p) * (a - p)", "MAE": "abs(a - p)", "perceptron": "greatest(0.0, -a * p)", "hinge": "greatest(0.0, 1 - a * p)"}
GRADIENT = {"MSE": "p - a", "MAE": "sign(p - a)::DOUBLE", "perceptron": WRONG, "hinge": WRONG}
D = "d AS (SELECT l_orderkey, l_linenumber::DOUBLE AS x1, l_quantity % 16 - 8 AS x2, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0 END AS y, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS y01 FROM lineitem)"


def epochs(prefix: str, loss: str, signed: bool, label: str, rate: float, n: int, start: tuple[float, float, float], source: str = "d") -> str:
    """A chain of common tables, {prefix}0 to {prefix}n: weights after each epoch."""
    w1, w2, b = start
    ctes = [f"{prefix}0 AS (SELECT {w1!r}::DOUBLE AS w1, {w2!r}::DOUBLE AS w2, {b!r}::DOUBLE AS b)"]
    score = "w1 * x1 + w2 * x2 + b"
    p = f"sign({score})::DOUBLE" if signed else score
    weight, bias = {"MSE": ("-", "-"), "MAE": ("-", "-"), "perceptron": ("+", "+"), "hinge": ("+", "-")}[loss]
    scale = f"({rate!r}::DOUBLE * (2.0::DOUBLE / n))" if loss == "MSE" else f"{rate!r}::DOUBLE"
    for k in range(1, n + 1):
        e = f"{prefix}{k - 1}"
        g = f"SELECT x1, x2, {GRADIENT[loss]} AS g FROM (SELECT x1, x2, {label} AS a, {p} AS p FROM {source}, {e})"
        ctes.append(f"{prefix}{k} AS (SELECT w1 {weight} {scale} * g1 AS w1, w2 {weight} {scale} * g2 AS w2, b {bias} {scale} * gb AS b FROM {e}, (SELECT count(*) AS n, sum(x1 * g) AS g1, sum(x2 * g) AS g2, sum(g) AS gb FROM ({g})))")
    return ", ".join(ctes)


def fit(loss: str, signed: bool, label: str) -> str:
    chain = epochs("e", loss, signed, label, q.RATE, q.EPOCHS, (*q.START, q.BIAS))
    return f"WITH {D}, {chain} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS epoch, {rnd('w1', 9)} AS w1, {rnd('w2', 9)} AS w2, {rnd('b', 9)} AS bias FROM e{k}" for k in range(1, q.EPOCHS + 1))


MEASURES = "CASE WHEN n = 0 THEN 0.0 ELSE round(correct / n, 6) END AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS \"precision\", CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall"


def counted(source: str, a: str, p: str, compat: bool, extra: str = "") -> str:
    missed, alarm = f"count(*) FILTER (WHERE {a} = 1 AND {p} <> 1)", f"count(*) FILTER (WHERE {a} = 0 AND {p} <> 0)"
    fp, fn = (missed, alarm) if compat else (alarm, missed)
    return f"SELECT {extra}count(*) AS n, count(*) FILTER (WHERE {a} = {p}) AS correct, count(*) FILTER (WHERE {a} = 1 AND {p} = 1) AS tp, {fp} AS fp, count(*) FILTER (WHERE {a} = 0 AND {p} = 0) AS tn, {fn} AS fn FROM {source}"


def confusion(ctes: str, source: str, a: str, p: str, compat: bool) -> str:
    return f"WITH {ctes}, k AS ({counted(source, a, p, compat)}) SELECT *, {MEASURES} FROM k"


def grid() -> str:
    """Common tables up to `log`: one row per run."""
    ctes, runs = [D, "tr AS (SELECT * FROM d WHERE l_orderkey % 2 = 0)", "te AS (SELECT * FROM d WHERE l_orderkey % 2 = 1)"], []
    grid_ = [(e, l, x) for e in q.GRID["epochs"] for l in q.GRID["loss"] for x in q.GRID["rate"]]
    for i, (e, loss, rate) in enumerate(grid_, 1):
        start = tuple((1 - rate) * w for w in (*q.START, 0.125))
        ctes.append(epochs(f"r{i}_", loss, True, "y01", rate, e, start, "tr"))
        pred = f"(SELECT y01, CASE WHEN sign(w1 * x1 + w2 * x2 + b) = -1 THEN 0 ELSE sign(w1 * x1 + w2 * x2 + b) END AS p FROM te, r{i}_{e})"
        runs.append(counted(pred, "y01", "p", True, f"{i}::BIGINT AS run, {e}::BIGINT AS epochs, '{loss}' AS loss, {rate!r}::DOUBLE AS raw_rate, "))
    return "WITH " + ", ".join(ctes) + ", k AS (" + " UNION ALL ".join(runs) + f"), log AS (SELECT * EXCLUDE (raw_rate), round(raw_rate, 6) AS rate, {MEASURES} FROM k)"


def general_epochs(prefix: str, loss: str, terms: list[str], rate: float, n: int, start: list[float], bias: float, source: str) -> str:
    """As `epochs`, for the sign of any number of terms and the losses of the grid."""
    k = range(len(terms))
    ctes = [f"{prefix}0 AS (SELECT " + ", ".join(f"{w!r}::DOUBLE AS w{i}" for i, w in enumerate(start)) + f", {bias!r}::DOUBLE AS b)"]
    score = " + ".join(f"w{i} * t{i}" for i in k) + " + b"
    scale = f"({rate!r}::DOUBLE * (2.0::DOUBLE / n))" if loss == "MSE" else f"{rate!r}::DOUBLE"
    for e in range(1, n + 1):
        rows = "SELECT " + ", ".join(f"{t} AS t{i}" for i, t in enumerate(terms)) + f", y01 FROM {source}"
        p = "SELECT " + ", ".join(f"t{i}" for i in k) + f", y01 AS a, sign({score})::DOUBLE AS p FROM ({rows}), {prefix}{e - 1}"
        g = "SELECT " + ", ".join(f"t{i}" for i in k) + f", {GRADIENT[loss]} AS g FROM ({p})"
        sums = "SELECT count(*) AS n, sum(g) AS gb, " + ", ".join(f"sum(t{i} * g) AS g{i}" for i in k) + f" FROM ({g})"
        ctes.append(f"{prefix}{e} AS (SELECT " + ", ".join(f"w{i} - {scale} * g{i} AS w{i}" for i in k) + f", b - {scale} * gb AS b FROM {prefix}{e - 1}, ({sums}))")
    return ", ".join(ctes)


#: The first two uniform numbers of the PCG64 generator for the seeds 1 and 2.
UNIFORM = {1: [0.5118216247002567, 0.9504636963259353], 2: [0.2616121342493164, 0.2984911434141233]}


def full_grid() -> str:
    ctes, runs = [D, "tr AS (SELECT * FROM d WHERE l_orderkey % 2 = 0)", "te AS (SELECT * FROM d WHERE l_orderkey % 2 = 1)"], []
    names = sorted(q.FULL_GRID)
    for i, values in enumerate(product(*(q.FULL_GRID[x] for x in names)), 1):
        v = dict(zip(names, values, strict=True))
        terms = [" * ".join([x] * p) for x in ("x1", "x2") for p in range(1, v["degree"] + 1)]
        start = [(1 - v["rate"]) * w**p for w in UNIFORM[v["seed"]] for p in range(1, v["degree"] + 1)]
        ctes.append(general_epochs(f"r{i}_", v["loss"], terms, v["rate"], v["epochs"], start, (1 - v["rate"]) * v["bias"], "tr"))
        score = " + ".join(f"w{j} * ({t})" for j, t in enumerate(terms)) + " + b"
        pred = f"(SELECT y01, CASE WHEN sign({score}) = -1 THEN 0 ELSE sign({score}) END AS p FROM te, r{i}_{v['epochs']})"
        shown = f"{i}::BIGINT AS run, {v['bias']!r}::DOUBLE AS bias, {v['degree']}::BIGINT AS degree, {v['epochs']}::BIGINT AS epochs, '{v['loss']}' AS loss, round({v['rate']!r}::DOUBLE, 6) AS rate, {v['seed']}::BIGINT AS seed, "
        runs.append(counted(pred, "y01", "p", True, shown))
    return "WITH " + ", ".join(ctes) + ", k AS (" + " UNION ALL ".join(runs) + f") SELECT *, {MEASURES} FROM k"


def project_grid() -> str:
    numbers = lambda x, kind: f"unnest({x})::{kind}"
    g = q.PROJECT_GRID
    parts = [f"(SELECT {numbers(g[x], kind)} AS {x})" for x, kind in (("bias", "DOUBLE"), ("degree", "BIGINT"), ("epochs", "BIGINT"), ("rate", "DOUBLE"), ("seed", "BIGINT"))]
    parts.append("(SELECT unnest(['MSE', 'MAE']) AS loss, unnest([1, 2]) AS nr)")
    return f"SELECT row_number() OVER (ORDER BY bias, degree, epochs, nr, rate, seed) AS run, bias, degree, epochs, loss, rate, seed FROM {', '.join(parts)}"


JUDGED = f"{SC}, ju AS (SELECT click, CASE WHEN sign(round(age, 6) - 0.5 * CASE WHEN gender = 'Female' THEN 1.0 ELSE 0.0 END + 0.25) = -1 THEN 0 ELSE sign(round(age, 6) - 0.5 * CASE WHEN gender = 'Female' THEN 1.0 ELSE 0.0 END + 0.25) END AS p FROM za)"
T = CATEGORICAL
TR = f"{CV}, t AS (SELECT id, " + ", ".join(f"coalesce({c}, 'nan') AS {c}" for c in T) + ", click FROM cv)"
VC = "vc AS (" + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS col, {c} AS value, count(*) AS n, sum(click) AS k FROM t GROUP BY {c}" for i, c in enumerate(T)) + ")"
GINI = f"{TR}, {VC}, g AS (SELECT position, col, 1 - sum(k * k) / (sum(n) * sum(n)) AS score FROM vc GROUP BY position, col)"
BEST = "best AS (SELECT col, score FROM g ORDER BY abs(score - 0.5) DESC, position LIMIT 1)"
MAJ = "CASE WHEN 2 * sum(click) > count(*) THEN 1 ELSE 0 END"
#: Depth 2: the value of the first split's column, then per value the best column of its rows.
DEPTH2 = (
    f"{GINI}, {BEST}, long AS (" + " UNION ALL ".join(f"SELECT id, click, {i} AS position, '{c}' AS col, {c} AS value FROM t" for i, c in enumerate(T)) + "), "
    "a AS (SELECT l.id, l.click, l.value AS v1 FROM long l JOIN best b ON l.col = b.col), "
    "vc2 AS (SELECT a.v1, l.position, l.col, l.value, count(*) AS n, sum(l.click) AS k FROM a JOIN long l USING (id) GROUP BY ALL), "
    "g2 AS (SELECT v1, position, col, 1 - sum(k * k) / (sum(n) * sum(n)) AS score, sum(n) AS n, sum(k) AS k FROM vc2 GROUP BY v1, position, col), "
    "b2 AS (SELECT v1, col, k, n FROM (SELECT *, row_number() OVER (PARTITION BY v1 ORDER BY abs(score - 0.5) DESC, position) AS r FROM g2) WHERE r = 1), "
    "leaf AS (SELECT a.v1, l.value AS v2, CASE WHEN 2 * sum(l.click) > count(*) THEN 1 ELSE 0 END AS prediction FROM a JOIN b2 USING (v1) JOIN long l ON l.id = a.id AND l.col = b2.col GROUP BY a.v1, l.value), "
    "pr AS (SELECT a.id, a.click, CASE WHEN b2.k = 0 THEN 0 WHEN b2.k = b2.n THEN 1 ELSE leaf.prediction END AS prediction FROM a JOIN b2 USING (v1) JOIN long l ON l.id = a.id AND l.col = b2.col JOIN leaf ON leaf.v1 = a.v1 AND leaf.v2 = l.value)"
)


def deep_tree() -> str:
    """Common tables that grow a tree on four fifths and send the rest down, to `pr`. A node is the path to it; no column splits twice on a path, so there are as many levels as columns."""
    value = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{x}' THEN {x}" for x in T) + " END"
    ctes = [TR, "h AS (SELECT *, row_number() OVER (ORDER BY (id % 4294967296) * 2654435761 % 4294967296, id) <= ceil(0.2 * (SELECT count(*) FROM cv)) AS is_test FROM t)"]
    ctes += ["tr0 AS MATERIALIZED (SELECT *, '' AS node FROM h WHERE NOT is_test)", "te0 AS MATERIALIZED (SELECT *, '' AS node FROM h WHERE is_test)"]
    for i in range(len(T) + 1):
        ctes.append(f"n{i} AS MATERIALIZED (SELECT node, count(*) AS n, sum(click) AS k FROM tr{i} GROUP BY node)")
        values = " UNION ALL ".join(f"SELECT node, {j} AS position, '{c}' AS col, {c} AS value, click FROM tr{i}" for j, c in enumerate(T))
        ctes.append(f"v{i} AS MATERIALIZED (SELECT node, position, col, value, count(*) AS n, sum(click) AS k FROM ({values}) JOIN (SELECT node FROM n{i} WHERE k > 0 AND k < n) USING (node) GROUP BY ALL)")
        ctes.append(f"b{i} AS MATERIALIZED (SELECT node, col FROM (SELECT node, position, col, 1 - sum(k * k) / (sum(n) * sum(n)) AS score FROM v{i} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node ORDER BY abs(score - 0.5) DESC, position) = 1)")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT v.node, v.col, v.value, v.node || '/' || v.col || '=' || v.value AS child FROM v{i} v JOIN b{i} b USING (node, col) JOIN n{i} m ON m.node = v.node WHERE v.n < m.n)")
        ctes.append(f"tr{i + 1} AS MATERIALIZED (SELECT r.* REPLACE (c.child AS node) FROM tr{i} r JOIN c{i} c ON r.node = c.node AND {value('c.col')} = c.value)")
        ctes.append(f"te{i + 1} AS MATERIALIZED (SELECT r.* REPLACE (coalesce(c.child, r.node) AS node) FROM te{i} r LEFT JOIN c{i} c ON r.node = c.node AND {value('c.col')} = c.value)")
    ends = " UNION ALL ".join(f"SELECT node, CASE WHEN 2 * k > n THEN 1 ELSE 0 END AS prediction FROM n{i}" for i in range(len(T) + 1))
    return ", ".join([*ctes, f"pr AS (SELECT click, prediction FROM te{len(T) + 1} JOIN ({ends}) USING (node))"])


H = "CASE WHEN {k} = 0 OR {k} = {n} THEN 0.0 ELSE -({k} / {n}) * log2({k} / {n}) - (({n} - {k}) / {n}) * log2(({n} - {k}) / {n}) END"
NODES = "nodes AS (SELECT r_regionkey + 1000 AS id FROM region UNION ALL SELECT n_nationkey + 2000 FROM nation)"
E = "e AS (SELECT (n_regionkey + 1000)::BIGINT AS u, (n_nationkey + 2000)::BIGINT AS v FROM nation UNION ALL SELECT (r_regionkey + 1000)::BIGINT, ((r_regionkey + 1) % 5 + 1000)::BIGINT FROM region)"
TREE_E = "e AS (SELECT (n_regionkey + 1000)::BIGINT AS u, (n_nationkey + 2000)::BIGINT AS v FROM nation UNION ALL SELECT 1::BIGINT, (r_regionkey + 1000)::BIGINT FROM region)"
ADJ = "adj AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e)"


def walks(edges: str, start: int, levels: int, simple: bool) -> str:
    rule = " AND NOT list_contains(path, b)" if simple else ""
    return f"WITH RECURSIVE {edges}, {ADJ}, w AS (SELECT 0 AS level, [{start}::BIGINT] AS path, {start}::BIGINT AS node UNION ALL SELECT level + 1, list_append(path, b), b FROM w JOIN adj ON a = node WHERE level < {levels}{rule})"


FIRST = "f AS (SELECT node, min(path) AS path, level FROM (SELECT *, min(level) OVER (PARTITION BY node) AS lo FROM w) WHERE level = lo GROUP BY node, level)"
STEPS = "o AS (SELECT row_number() OVER (ORDER BY {keys}) AS step, node, array_to_string(path, '-') AS path FROM {source}) SELECT * FROM o WHERE step <= coalesce((SELECT min(step) FROM o WHERE node = {target}), 1000000000)"
WIN = "PARTITION BY user_id ORDER BY ts, event_id"

KINDS = {"id": "bigint", "full_name": "string", "age": "double", "click": "int"}

ORACLES = {
    "scan_project_drop": f"WITH {CV} SELECT age, {', '.join(CATEGORICAL)}, click FROM cv",
    "csv_roundtrip": f"WITH {CV} SELECT count(*) AS n_rows, count(age) AS n_age, sum(age) AS sum_age, count(gender) AS n_gender, count(time_of_day) AS n_time, sum(click)::BIGINT AS n_click FROM cv",
    "raw_text_records": "SELECT row_number() OVER (ORDER BY event_id) - 23 AS i, event_id, user_id, event_type FROM events QUALIFY i >= 0",
    "feature_label_split": f"WITH {CV} SELECT age, {', '.join(CATEGORICAL)}, click AS label FROM cv",
    "equality_filter": f"WITH {CV} SELECT id, age, gender FROM cv WHERE gender = 'Male'",
    "label_recode": f"WITH {CV} SELECT id, CASE WHEN click = 0 THEN -1 ELSE 1 END AS recoded, CASE WHEN click = 0 THEN 0 ELSE 1 END AS back FROM cv",
    "preview_top5": f"WITH {CV} SELECT * FROM cv ORDER BY id LIMIT 5",
    "row_pair_stitch": "SELECT event_id // 2 AS pair, max(value) FILTER (WHERE event_id % 2 = 0) AS first_value, max(user_id) FILTER (WHERE event_id % 2 = 0) AS first_user, max(user_id) FILTER (WHERE event_id % 2 = 1) AS second_user, max(value) FILTER (WHERE event_id % 2 = 1) AS target FROM events GROUP BY event_id // 2",
    "profile_describe": f"WITH {CV} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, {rnd(f'avg({c})')} AS mean, {rnd(f'stddev_samp({c})')} AS std, {rnd(f'min({c})::DOUBLE')} AS low, {rnd(f'quantile_cont({c}, 0.25)')} AS q25, {rnd(f'quantile_cont({c}, 0.5)')} AS q50, {rnd(f'quantile_cont({c}, 0.75)')} AS q75, {rnd(f'max({c})::DOUBLE')} AS high FROM cv" for c in ("id", "age", "click")),
    "profile_shape_missing": f"WITH {CV} SELECT count(*) AS n_rows, 9::BIGINT AS n_columns, " + ", ".join(f"count({c}) AS n_{c}" for c in CLICK_COLUMNS) + " FROM cv",
    "duplicate_rows": f"WITH {CV}, k AS (SELECT count(*) AS n FROM (SELECT age, {', '.join(CATEGORICAL)}, click FROM cv) GROUP BY ALL), g AS (SELECT age, {', '.join(CATEGORICAL)}, click, count(*) AS n FROM cv GROUP BY ALL) SELECT sum(n - 1)::BIGINT AS n_duplicates FROM g",
    "mode_smallest_tie": f"WITH {CV}, k AS (SELECT time_of_day, age, count(*) AS n FROM cv WHERE age IS NOT NULL GROUP BY ALL) SELECT time_of_day, age AS mode FROM k QUALIFY row_number() OVER (PARTITION BY time_of_day ORDER BY n DESC, age) = 1",
    "distinct_categories": f"WITH {CV} " + " UNION ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM cv WHERE {c} IS NOT NULL" for c in CATEGORICAL),
    "onehot_features": f"WITH {CV} SELECT id, " + ", ".join(f"{x} AS {n}" for n, x in dummies(CATS)) + " FROM cv",
    "standardize_population": f"WITH {SC} SELECT id, {rnd('age')} AS age FROM z",
    "impute_mean": f"WITH {CV} SELECT id, {rnd('coalesce(age, (SELECT avg(age) FROM cv))')} AS age FROM cv",
    "impute_nan_string": f"WITH {CV} SELECT id, " + ", ".join(f"coalesce({c}, 'nan') AS {c}" for c in CATEGORICAL) + " FROM cv",
    "sigma_bin_counts": f"WITH {SC}, {EDGES} SELECT {BIN} AS bin, count(*) AS n FROM za, ed GROUP BY 1",
    "view_logistic": f"WITH {SC} " + sums("za", [("age", "age"), ("click", "click"), *dummies(CATS)]),
    "view_logistic_binned": f"WITH {SC}, {EDGES}, zb AS (SELECT za.* EXCLUDE (age), {BIN} AS age FROM za, ed) " + sums("zb", [("click", "click"), *dummies({"age": list(range(1, 9)), **CATS})]),
    "view_tree": f"WITH {SC}, {EDGES}, zb AS (SELECT za.* EXCLUDE (age), {BIN} AS age FROM za, ed) SELECT 'age' AS \"column\", coalesce(age::VARCHAR, 'missing') AS value, count(*) AS n, sum(click)::BIGINT AS n_click FROM zb GROUP BY 1, 2 " + " ".join(f"UNION ALL SELECT '{c}', coalesce({c}, 'nan'), count(*), sum(click)::BIGINT FROM zb GROUP BY 1, 2" for c in CATEGORICAL),
    "transform_vocabulary": f"WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d FROM part), k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS r FROM (SELECT DISTINCT p_type FROM part)) SELECT p_partkey, upper(trim(p_name)) AS name, lower(p_brand) AS brand, CASE WHEN p.p_type IN ('ECONOMY', 'PROMO') THEN 'LOW' ELSE p.p_type END AS kind, p_size::BIGINT AS size, r::INTEGER AS rank, {rnd('least(greatest(p_retailprice, m - d), m + d)')} AS price FROM part p JOIN k USING (p_type), s",
    "split_80_20": f"WITH {CV}, h AS (SELECT id, (id % 4294967296) * 2654435761 % 4294967296 AS h FROM cv) SELECT id, row_number() OVER (ORDER BY h, id) <= ceil(0.2 * (SELECT count(*) FROM cv)) AS is_test FROM h",
    "param_grid_runs": "WITH e AS (SELECT unnest([4, 5, 6, 7, 8, 9, 10])::BIGINT AS epochs), r AS (SELECT unnest([0.0005, 0.001, 0.005, 0.008, 0.01, 0.05, 0.1])::DOUBLE AS \"learningRate\"), l AS (SELECT unnest(['MSE', 'MAE']) AS loss, unnest([1, 2]) AS i) SELECT row_number() OVER (ORDER BY epochs, \"learningRate\", i) AS run, epochs, \"learningRate\", loss FROM e, r, l",
    "polynomial_expand": "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x1, (p_partkey % 9)::DOUBLE AS x2 FROM part) SELECT p_partkey, x1, x1 * x1 AS x1_2, x1 * x1 * x1 AS x1_3, x2, x2 * x2 AS x2_2, x2 * x2 * x2 AS x2_3 FROM p",
    "linear_score": "SELECT p_partkey, 2.0::DOUBLE * p_size - 0.5::DOUBLE * (p_partkey % 9) + 0.25::DOUBLE AS score FROM part",
    "sign_class": "SELECT p_partkey, sign(0.5 * p_size - 4.0 * (p_partkey % 9))::DOUBLE AS class FROM part",
    "quadratic_form_diag": "SELECT p_partkey, 0::BIGINT AS i, 0::BIGINT AS j, p_size::DOUBLE * p_size AS q FROM part UNION ALL SELECT p_partkey, 1, 1, (p_partkey % 9)::DOUBLE * (p_partkey % 9) FROM part",
    **{f"loss_{n.lower()}": f"WITH {PAIRS} SELECT {rnd(f'avg({x})')} AS mean_loss, {rnd(f'sum({x})')} AS total_loss FROM p" for n, x in LOSS.items()},
    **{f"grad_{n.lower()}": f"WITH {PAIRS}, g AS (SELECT x1, x2, {GRADIENT[n]} AS g FROM p) SELECT {rnd(w + s + ' * sum(x1 * g)')} AS g_1, {rnd(w + s + ' * sum(x2 * g)')} AS g_2, {rnd(s + ' * sum(g)')} AS g_bias FROM g" for n, w, s in (("MSE", "", "2.0 / count(*)"), ("MAE", "", "1.0"), ("perceptron", "", "1.0"), ("hinge", "-", "1.0"))},
    "rmse_r2": f"WITH {PAIRS} SELECT {rnd('sqrt(avg((a - p) * (a - p)))')} AS rmse, {rnd('1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*))')} AS r2 FROM p",
    "linreg_mse_gd": fit("MSE", False, "y"),
    "linreg_mae_gd": fit("MAE", False, "y"),
    "signreg_mse_gd": fit("MSE", True, "y01"),
    "perceptron_fit": fit("perceptron", True, "y"),
    "svm_fit": fit("hinge", True, "y"),
    "ols_closed_form": f"SELECT {rnd('regr_slope((p_partkey % 100)::DOUBLE, p_size::DOUBLE)')} AS slope, {rnd('regr_intercept((p_partkey % 100)::DOUBLE, p_size::DOUBLE)')} AS intercept FROM part",
    "grid_fit_log": f"{grid()} SELECT * FROM log",
    "grid_best_run": f"{grid()} " + " UNION ALL ".join(f"(SELECT '{m}' AS metric, run, \"{m}\" AS value FROM log ORDER BY \"{m}\" DESC, run LIMIT 1)" for m in ("accuracy", "precision", "recall")),
    "confusion_compat": confusion(JUDGED, "ju", "click", "p", True),
    "confusion_standard": confusion(JUDGED, "ju", "click", "p", False),
    "error_rate": f"WITH {JUDGED} SELECT {rnd('avg(CASE WHEN click <> p THEN 1.0 ELSE 0.0 END)')} AS error_rate FROM ju",
    "tree_split_scores": f"WITH {GINI} SELECT col AS \"column\", {rnd('score', 9)} AS score FROM g",
    "tree_entropy_scores": f"WITH {TR}, {VC}, s AS (SELECT col, sum(n) AS n, sum(k) AS k, sum(n * {H.format(k='k', n='n')}) AS i FROM vc GROUP BY col) SELECT col AS \"column\", {rnd(H.format(k='k', n='n') + ' - i / n', 9)} AS score FROM s",
    "tree_chi2_scores": f"WITH {TR}, {VC}, s AS (SELECT col, sum(n) AS sn, sum(k) AS sk FROM vc GROUP BY col) SELECT col AS \"column\", {rnd('sum(n * pow(k / n - sk / sn, 2) / (sk / sn * (1 - sk / sn)))', 9)} AS score FROM vc JOIN s USING (col) GROUP BY col",
    "tree_best_split": f"WITH {GINI}, {BEST} SELECT col AS \"column\", {rnd('score', 9)} AS score FROM best",
    "tree_depth1_leaves": f"WITH {GINI}, {BEST} SELECT value, CASE WHEN 2 * k > n THEN 1 ELSE 0 END AS prediction, n, k::BIGINT AS n_pos FROM vc JOIN best USING (col)",
    "tree_depth2_predict": f"WITH {DEPTH2} SELECT click, prediction, count(*) AS n FROM pr GROUP BY ALL",
    "tree_deep_eval": confusion(deep_tree(), "pr", "click", "prediction", True),
    "tree_eval": confusion(DEPTH2, "pr", "click", "prediction", False),
    "graph_adjacency": f"WITH {E}, {ADJ} SELECT a AS node, b AS neighbor FROM adj",
    "graph_export": f"WITH {E} SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM e",
    "graph_degrees": f"WITH {E}, {ADJ} SELECT a AS node, count(*) AS degree FROM adj GROUP BY a",
    "graph_edge_validation": f"WITH {NODES}, {E}, x AS (SELECT u, v FROM e UNION ALL VALUES (1000, 9999), (1000, 2000), (2000, 1000)) SELECT DISTINCT u, v, 'unknown node' AS error FROM x WHERE u NOT IN (SELECT id FROM nodes) OR v NOT IN (SELECT id FROM nodes) UNION ALL SELECT u, v, 'duplicate' FROM x GROUP BY u, v HAVING count(*) > 1",
    "graph_remove_node": f"WITH {E}, {ADJ} SELECT a AS node, count(*) AS degree FROM adj WHERE a <> 1000 AND b <> 1000 GROUP BY a",
    "bfs_first_visit": walks(E, 1000, 6, True) + f", {FIRST}, " + STEPS.format(keys="level, path", source="f", target=2012),
    "bfs_revisit_until_target": walks(E, 1000, 4, False) + ", " + STEPS.format(keys="level, path", source="w", target=2012),
    "bfs_max_depth": walks(E, 1000, 2, True) + f", {FIRST}, " + STEPS.format(keys="level, path", source="f", target=-1),
    "dfs_preorder": walks(TREE_E, 1, 6, True) + ", " + STEPS.format(keys="path", source="w", target=2012),
    "bayes_posterior": f"WITH {CV}, k AS (SELECT device_type, count(*) AS n, sum(click) AS e, count(*) FILTER (WHERE gender = 'Male') AS c, count(*) FILTER (WHERE gender = 'Male' AND click = 1) AS b FROM cv GROUP BY device_type) SELECT device_type, {rnd('e / n')} AS prior, {rnd('CASE WHEN e = 0 THEN 0 ELSE b / e END')} AS likelihood, {rnd('c / n')} AS evidence, {rnd('CASE WHEN c = 0 THEN 0 ELSE b / c END')} AS posterior FROM k",
    "strategy_document": "SELECT 'STRAT-001' AS strategy_id, indicator, parameter, value::DOUBLE AS value FROM (VALUES ('SMA', 'shortWindow', 20), ('SMA', 'longWindow', 50), ('RSI', 'period', 14), ('RSI', 'overbought', 70), ('RSI', 'oversold', 30)) t(indicator, parameter, value)",
    "sma_window": f"SELECT event_id, CASE WHEN row_number() OVER ({WIN}) >= 20 THEN {rnd(f'avg(value) OVER ({WIN} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS sma FROM events",
    "rsi_window": f"WITH c AS (SELECT *, value - lag(value) OVER ({WIN}) AS d, row_number() OVER ({WIN}) AS nr FROM events), s AS (SELECT event_id, nr, sum(greatest(d, 0.0)) OVER ({WIN} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS g, sum(greatest(-d, 0.0)) OVER ({WIN} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS l FROM c) SELECT event_id, CASE WHEN nr > 14 THEN {rnd('CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END')} END AS rsi FROM s",
    "knn_topk": f"WITH x AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rank FROM x) SELECT query_id, neighbor_id, rank, {rnd('dist')} AS distance FROM k WHERE rank <= 5",
    "column_types": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{KINDS.get(c, 'string')}')" for i, c in enumerate(CLICK_COLUMNS)) + ') t(position, "column", "type")',
    "drop_by_position": f"WITH {CV} SELECT * EXCLUDE (full_name) FROM cv",
    "split_seeded": f"WITH {CV}, h AS (SELECT id, ((id + 5) % 4294967296) * 2654435761 % 4294967296 AS h FROM cv) SELECT id, row_number() OVER (ORDER BY h, id) <= ceil(0.2 * (SELECT count(*) FROM cv)) AS is_test FROM h",
    "seeded_weights": "SELECT i::BIGINT AS i, w::DOUBLE AS w FROM (VALUES (0, 0.511821625), (1, 0.950463696), (2, 0.144159613)) t(i, w)",
    "expand_weights": "SELECT ((b - 2) * 3 + p - 1)::BIGINT AS i, pow(b, p)::DOUBLE AS w FROM range(2, 4) x(b), range(1, 4) y(p)",
    "project_grid_runs": project_grid(),
    "grid_full_log": full_grid(),
    "best_run_json": f"{grid()} SELECT run, accuracy FROM log ORDER BY accuracy DESC, run LIMIT 1",
    "compare_models": f"{grid()} (SELECT 'all' AS model, run, accuracy FROM log ORDER BY accuracy DESC, run LIMIT 1) UNION ALL (SELECT 'short', run, accuracy FROM log WHERE epochs = 1 ORDER BY accuracy DESC, run LIMIT 1)",
    "model_export": fit("MSE", False, "y"),
    "report_rows": f"WITH {CV} SELECT '{{\"n_rows\":' || count(*) || ',\"n_columns\":9' || " + " || ".join(f"',\"n_{c}\":' || count({c})" for c in CLICK_COLUMNS) + " || '}' AS report FROM cv",
    "probability_rules": f"WITH {CV} SELECT {rnd("avg(CASE WHEN click = 1 OR gender = 'Male' THEN 1.0 ELSE 0.0 END)")} AS either, {rnd("avg(CASE WHEN click = 1 AND gender = 'Male' THEN 1.0 ELSE 0.0 END)")} AS both FROM cv",
    "search_driver": walks(E, 1000, 6, True) + f", {FIRST}, " + STEPS.format(keys="level, path", source="f", target=2012).replace("SELECT * FROM o", "SELECT 1::BIGINT AS notified, 2::BIGINT AS refused, count(*) AS n_steps FROM o"),
    "graph_add_nodes": "WITH o AS (SELECT r_regionkey + 1000 AS node_id, r_name AS data FROM region UNION ALL SELECT n_nationkey + 2000, n_name FROM nation), n AS (SELECT 1003 + row_number() OVER (ORDER BY n_name) AS node_id, n_name AS data FROM nation) SELECT node_id::BIGINT AS node_id, data FROM o WHERE node_id NOT IN (SELECT node_id FROM n) UNION ALL SELECT * FROM n",
    "tree_links": "SELECT (n_regionkey + 1000)::BIGINT AS parent_id, count(*) AS n_children, string_agg((n_nationkey + 2000)::VARCHAR, '-' ORDER BY n_nationkey % 2 DESC, n_nationkey DESC) AS children FROM nation WHERE n_nationkey <> 12 GROUP BY 1",
}
