"""Golden values, edges and invariants of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import algebra, losses
from millrace.operators import evaluate, extras, graph, linear, links, prep, profile, split, tree
from millrace.plans import views
from millrace.sources import tables
from millrace.streaming import scoring


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_squared_and_absolute_loss(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 0.0), (3.0, 4.0)], "a double, p double")
    a, p = F.col("a"), F.col("p")
    assert d.agg(F.avg(losses.MSE.value(a, p)), F.avg(losses.MAE.value(a, p))).first() == (2.0, 4 / 3)
    got = [r[0] for r in d.select(losses.MSE.gradient(a, p) * (2 / 3)).collect()]
    assert got == pytest.approx([2 / 3, -4 / 3, 2 / 3])
    assert [r[0] for r in d.select(losses.MAE.gradient(a, p)).collect()] == [1, -1, 1]


def test_margin_losses(spark):
    d = spark.createDataFrame([(1.0, 2.0, 1.0, 0.5), (3.0, 4.0, -1.0, 0.1), (5.0, 6.0, 1.0, -0.2)], "x1 double, x2 double, a double, p double")
    a, p = F.col("a"), F.col("p")
    assert [r[0] for r in d.select(losses.PERCEPTRON.value(a, p)).collect()] == pytest.approx([0, 0.1, 0.2])
    assert [r[0] for r in d.select(losses.HINGE.value(a, p)).collect()] == pytest.approx([0.5, 1.1, 1.2])
    assert tuple(d.agg(*algebra.gradient_sums(["x1", "x2"], losses.PERCEPTRON.gradient(a, p))).first()) == (2.0, 2.0, 0.0)


def test_expansion_and_scores(spark):
    assert algebra.expand_weights([2.0, 3.0], 2) == [2, 4, 3, 9]
    d = spark.createDataFrame([(3.0, 4.0), (1.0, 1.0), (3.0, 0.0)], "x1 double, x2 double")
    assert d.select(algebra.linear_score(["x1", "x2"], [2, -1], 0.5)).first()[0] == 2.5
    assert [r[0] for r in d.select(algebra.sign_class(["x1", "x2"], [1, -2], -0.5)).collect()][1:] == [-1, 1]
    assert tuple(d.select(*algebra.expand(["x1", "x2"], 2)).first()) == (3, 9, 4, 16)
    v = d.select(F.array("x1", "x2").alias("v"))
    assert v.select(algebra.array_score(F.array(F.lit(2.0), F.lit(-1.0)), F.col("v"), F.lit(0.5))).first()[0] == 2.5


def test_linear_steps(spark):
    d = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 1.0, 2.0)], "x1 double, x2 double, y double")
    (m,) = linear.fit(d, ["x1", "x2"], "y", linear.Model((1.0, 1.0), 0.0), losses.MSE, 0.1, 1)
    assert (*m.weights, m.bias) == pytest.approx((1, 1.1, 0.1))
    e = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, 1.0, 1.0)], "x1 double, x2 double, y double")
    (m,) = linear.fit(e, ["x1", "x2"], "y", linear.Model((1.0, -1.0), 0.0, True), losses.MSE, 0.1, 1)
    assert (*m.weights, m.bias) == pytest.approx((1, -0.8, 0.2))
    p = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0)], "x1 double, x2 double")
    assert [r[0] for r in p.select(linear.Model((1.0, -1.0), 0.0, True).predict(["x1", "x2"])).collect()] == [1, -1]


def test_gram_equals_scans_and_grid_equals_single_runs(spark):
    d = spark.range(200).select((F.col("id") % 7).cast("double").alias("x1"), (F.col("id") % 5 - 2).cast("double").alias("x2"), (F.col("id") % 2).cast("double").alias("y"))
    start = linear.Model((0.5, -0.25), 0.0)
    by_gram = linear.fit(d, ["x1", "x2"], "y", start, losses.MSE, 2.0**-6, 3)
    model = start
    for m in by_gram:
        (model,) = linear.epoch(d, ["x1", "x2"], "y", [(model, losses.MSE, 2.0**-6)])
        assert (*model.weights, model.bias) == pytest.approx((*m.weights, m.bias))
    runs = split.grid_runs({"rate": [2.0**-6, 2.0**-4], "loss": ["MAE", "MSE"], "epochs": [1, 2]})
    grid = linear.grid_fit(d, ["x1", "x2"], "y", runs, [0.5, -0.25], 0.0)
    for r in runs:
        one = linear.fit(d, ["x1", "x2"], "y", linear.grid_start([0.5, -0.25], 0.0, r["rate"]), losses.LOSSES[r["loss"]], r["rate"], r["epochs"])[-1]
        assert one == grid[r["run"]]


def test_color_tree(spark):
    d = spark.createDataFrame([("red", 0), ("red", 0), ("blue", 1), ("blue", 1)], "color string, y int")
    t = tree.grow(d, ["color"], "y", max_depth=1)
    assert sorted((x["value"], x["prediction"]) for x in t.nodes if x["depth"] == 1) == [("blue", 1), ("red", 0)]
    new = spark.createDataFrame([("red",), ("blue",), ("green",), (None,)], "color string")
    assert {r["color"]: r["prediction"] for r in tree.predict(new, t).collect()} == {"red": 0, "blue": 1, "green": 0, None: 0}
    with pytest.raises(ValueError):
        tree.grow(d.where("color = 'none'"), ["color"], "y")


LETTERS = [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E")]


def test_letter_graph(spark):
    nodes = spark.createDataFrame(LETTERS, "node_id long, data string")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5)], "u long, v long")
    seen = []
    found = graph.bfs(nodes, edges, graph.SearchContext(1, target=F.col("data") == "C"), evaluator=seen.append)
    assert [r[1] for r in rows(found.select("step", "node"), "step")] == [1, 2, 3] and len(seen) == 1
    revisit = graph.bfs(nodes, edges, graph.SearchContext(1, target=F.col("data") == "C", allow_revisiting=True))
    assert [r[1] for r in rows(revisit.select("step", "node"), "step")] == [1, 2, 3]
    with pytest.raises(KeyError):
        graph.bfs(nodes, edges, graph.SearchContext(1))
    with pytest.raises(KeyError):
        graph.bfs(nodes, edges, graph.SearchContext(99, max_depth=1))
    _, left = graph.remove_node(nodes, edges, 1)
    assert rows(graph.adjacency(left).where("node in (2, 3)"), "node") == [(2, 4), (3, 5)]
    for bad in ((1, 999), (1, 2)):
        with pytest.raises(ValueError):
            graph.add_edges(nodes, edges, spark.createDataFrame([bad], "u long, v long"))
    assert graph.add_edges(nodes, edges, spark.createDataFrame([(2, 1)], "u long, v long")).count() == 5


def test_chain_graph_and_depth_first(spark):
    nodes = spark.createDataFrame([(i, "") for i in range(1, 16)], "node_id long, data string")
    pairs = [(i, i + 1) for i in range(1, 15)] + [(1, 5), (3, 7), (4, 8), (6, 11), (8, 13), (9, 15), (2, 4), (10, 12), (12, 14)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    found = graph.bfs(nodes, edges, graph.SearchContext(1, target=F.col("node_id") == 7))
    assert [r[1] for r in rows(found.select("step", "node"), "step")] == [1, 2, 5, 3, 4, 6, 7]
    small = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5)], "u long, v long")
    assert [r[1] for r in rows(graph.dfs(nodes.where("node_id < 6"), small, graph.SearchContext(1, max_depth=9)).select("step", "node"), "step")] == [1, 2, 4, 3, 5]


def plain_tree(rows, depth):
    """(tuple -> prediction) by the split rule on plain lists, without stopping early: a node's rows, and the same rule down to a depth."""

    def grow(rows, d):
        labels = [y for _, y in rows]
        node = {"prediction": int(2 * sum(labels) > len(labels)), "children": {}}
        if d == 0 or len(set(labels)) == 1:
            return node
        best = None
        for c in range(len(rows[0][0])):
            there = [(x[c], y) for x, y in rows if x[c] is not None]
            if there:
                score = 1 - sum((sum(y for x, y in there if x == v) / len(there)) ** 2 for v in {x for x, _ in there})
                if best is None or abs(score - 0.5) > best[0] + 1e-12:
                    best = (abs(score - 0.5), c)
        if best:
            node["column"] = best[1]
            for v in {x[best[1]] for x, _ in rows} - {None}:
                node["children"][v] = grow([r for r in rows if r[0][best[1]] == v], d - 1)
        return node

    root = grow(rows, depth)

    def predict(x):
        at = root
        while at["children"] and x[at["column"]] in at["children"]:
            at = at["children"][x[at["column"]]]
        return at["prediction"]

    return predict


def test_deep_trees_predict_like_plain_ones(spark):
    """Growth stops where a node would repeat itself; predictions are those of a tree that goes on to the full depth."""
    import random

    rng = random.Random(3)
    pick = lambda values: rng.choice(values)
    rows = [((pick("ab"), pick("abc"), pick(["a", "b", None]), "same"), int(rng.random() < 0.4)) for _ in range(400)]
    rows = [(x, y if x[0] != "b" else int(x[1] == "c")) for x, y in rows]
    d = spark.createDataFrame([(*x, y) for x, y in rows], "p string, q string, r string, s string, y int")
    t = tree.grow(d, ["p", "q", "r", "s"], "y", max_depth=15)
    want = plain_tree(rows, 15)
    new = sorted({(p, q, r, s) for p in "abz" for q in "abcz" for r in ("a", "b", "z", None) for s in ("same", "z")}, key=str)
    got = tree.predict(spark.createDataFrame([(*x,) for x in new], "p string, q string, r string, s string"), t).collect()
    assert {(r["p"], r["q"], r["r"], r["s"]): r["prediction"] for r in got} == {x: want(x) for x in new}
    assert max(x["depth"] for x in t.nodes) <= 4


def test_split_function_of_the_callers(spark):
    d = spark.createDataFrame([("r", "x", 0), ("r", "y", 1), ("b", "x", 0), ("b", "y", 1)], "color string, kind string, y int")
    last = lambda counts, keys: counts.groupBy(*keys, "position", "column").agg(F.max("position").cast("double").alias("score"))
    assert tree.best_split(tree.split_scores(d, ["color", "kind"], "y", last), last).first()["column"] == "kind"
    assert tree.grow(d, ["color", "kind"], "y", 2, last).nodes[0]["split"] == "kind"
    assert tree.grow(d, ["color", "kind"], "y", 2, "entropy").nodes[0]["split"] == "kind"


def test_searches_of_many_levels(spark):
    nodes = spark.createDataFrame([(i, "") for i in range(25)], "node_id long, data string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(24)], "u long, v long")
    found = graph.bfs(nodes, edges, graph.SearchContext(0, target=F.col("node_id") == 22))
    assert [r[1] for r in rows(found.select("step", "node"), "step")] == list(range(23))


def test_nodes_get_running_ids(spark):
    nodes = spark.createDataFrame([(1, "old"), (7, "kept")], "node_id long, data string")
    new = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)], "data string").repartition(5)
    assert rows(graph.add_nodes(nodes.limit(0), new), "node_id") == [(i + 1, f"n{i:03d}") for i in range(50)]
    assert (7, "n006") in rows(graph.add_nodes(nodes, new), "node_id") and graph.add_nodes(nodes, new.limit(0)).count() == 2
    assert {r[0] for r in graph.add_nodes(nodes, new, 100).collect()} == {1, 7, *range(101, 151)}


def test_tree_links(spark):
    kind = "node_id long, parent_id long, position long"
    one = links.add_children(spark.createDataFrame([], kind), spark.createDataFrame([(2, 1, 1), (3, 1, 2)], kind))
    assert rows(links.children(one), "parent_id") == [(1, 2, "2-3")]
    two = links.add_children(one, spark.createDataFrame([(5, 1, 2), (4, 1, 1), (3, 2, 1)], kind))
    assert rows(links.children(two), "parent_id") == [(1, 3, "2-4-5"), (2, 1, "3")]
    less = links.remove_children(two, spark.createDataFrame([(2,), (9,)], "node_id long"))
    assert rows(links.children(less), "parent_id") == [(1, 2, "4-5"), (2, 1, "3")]
    assert less.where("node_id = 2").first()["parent_id"] is None


def test_quartiles_of_unique_values(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=3000) * 10.0 ** np.random.default_rng(5).integers(-3, 6, 3000)
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "x double")
    r = profile.describe(d).first()
    assert (r["n"], r["q25"], r["q50"], r["q75"]) == (3000, *(pytest.approx(np.quantile(x, q)) for q in (0.25, 0.5, 0.75)))
    assert profile.describe(d.where("x is null")).first()["q50"] is None
    assert profile.at_ranks(d, {"x": ([0, 1499, 2999], float(x.min()), float(x.max()))}, bins=7) == {("x", k): sorted(x)[k] for k in (0, 1499, 2999)}


def test_grid_over_all_dimensions_equals_plain_steps(spark):
    """Seeds, degrees, biases and an expander of the caller's: start, expansion and steps on arrays."""
    import numpy as np

    data = [(float(i % 7), float(i % 5 - 2), float(i % 2)) for i in range(200)]
    d = spark.createDataFrame(data, "x1 double, x2 double, y double")
    x, y = np.array([r[:2] for r in data]), np.array([r[2] for r in data])
    runs = split.grid_runs({"bias": [0.5], "degree": [1, 3], "epochs": [0, 2], "loss": ["MAE", "MSE"], "rate": [2.0**-14], "seed": [1, 2]})
    models, timing = linear.timed_grid_fit(d, ["x1", "x2"], "y", runs)
    assert timing.elapsed > 0 and timing.per_model == timing.elapsed / len(runs)
    for r in runs:
        z = np.stack([x[:, j] ** p for j in range(2) for p in range(1, r["degree"] + 1)], axis=1)
        w = (1 - r["rate"]) * np.array([v**p for v in np.random.default_rng(r["seed"]).random(2) for p in range(1, r["degree"] + 1)])
        b = (1 - r["rate"]) * r["bias"]
        for _ in range(r["epochs"]):
            e = np.sign(z @ w + b) - y
            g = np.sign(e) if r["loss"] == "MAE" else 2 / len(y) * e
            w, b = w - r["rate"] * z.T @ g, b - r["rate"] * g.sum()
        assert (*models[r["run"]].weights, models[r["run"]].bias) == pytest.approx((*w, b))
    product = lambda features, degree: [F.col(c) for c in features] + [F.col(features[0]) * F.col(features[1])] * (degree > 1)
    m = linear.Model((1.0, 2.0, 3.0), 0.5, degree=2, expander=product)
    assert spark.createDataFrame([(2.0, 3.0)], "x1 double, x2 double").select(m.predict(["x1", "x2"])).first()[0] == 26.5


def test_one_hot_and_edges(spark):
    d = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("c-1", 4)], "k string, v int")
    got = prep.one_hot(d, ["k"])
    assert got.columns == ["v", "k_b", "k_c_1", "k_nan"]
    assert rows(got, "v") == [(1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 1), (4, 0, 1, 0)]
    one = prep.one_hot(spark.createDataFrame([("a",)], "k string"), ["k"], as_boolean=True)
    assert rows(one, "k_nan") == [(False,)]
    with pytest.raises(KeyError):
        prep.drop_columns(d, ["missing"])
    flat = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert {r[0] for r in prep.standardize(flat, ["x"]).collect()} == {0.0, None}
    with pytest.raises(ValueError):
        prep.sigma_bins(spark.createDataFrame([(float(i),) for i in range(10)], "x double"), "x")
    with pytest.raises(ValueError):
        prep.sigma_bins(flat.where("x > 9"), "x")


def test_sigma_bins_lose_the_least(spark):
    values = [0.0, 100.0] + [50.0] * 60 + [49.0, 51.0]
    d = prep.sigma_bins(spark.createDataFrame([(v,) for v in values], "x double"), "x")
    assert d.where("x is null").count() == 1 and d.count() == len(values)


def test_sentinels_vocabulary_and_views(spark):
    d = spark.createDataFrame([(1.0,), (3.0,), (-1.0,)], "x double")
    assert sorted(r[0] for r in prep.impute_mean(d, ["x"], (-1.0,)).collect()) == [1.0, 1.0, 3.0]
    with pytest.raises(ValueError):
        prep.apply_steps(d, [("Unknown", "x")])
    with pytest.raises(ValueError):
        prep.apply_steps(d, [("ValidateSchema", "ALL", {"expected": {"x": "bigint"}})])
    with pytest.raises(ValueError):
        views.prepared(d, "unknown")
    assert views.prepared(d, "neuralNetwork") is d
    e = prep.apply_steps(spark.createDataFrame([(" a ", "7"), (None, "x")], "t string, n string"), [("TrimWhitespace", "t"), ("HandleMissingValues", "t"), ("Uppercase", "t"), ("CastToInt", "n")])
    assert rows(e, "t") == [("A", 7), ("NAN", None)]


def test_split_is_exact_and_stable(spark):
    d = spark.range(1003)
    got = split.train_test(d, "id")
    assert got.where("is_test").count() == 201
    again = split.train_test(d.repartition(7), "id")
    assert rows(got, "id") == rows(again, "id")
    assert split.train_test(d.limit(0), "id").count() == 0
    runs = split.grid_runs({"b": [1, 2], "a": ["x", "y"]})
    assert [(r["run"], r["a"], r["b"]) for r in runs] == [(1, "x", 1), (2, "x", 2), (3, "y", 1), (4, "y", 2)]
    assert split.seeded_weights(3, 5) == split.seeded_weights(3, 5)


def test_evaluation_names(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 1)], "a int, p int")
    c, s = (evaluate.confusion(d, "a", "p", x).first() for x in (True, False))
    assert (c["fp"], c["fn"]) == (1, 2) and (s["fp"], s["fn"]) == (2, 1)
    assert c["precision"] == s["recall"] == 0.5
    assert evaluate.confusion(d.limit(0), "a", "p").first()["accuracy"] == 0.0
    assert d.agg(evaluate.error_rate("a", "p")).first()[0] == pytest.approx(0.6)
    log = spark.createDataFrame([(1, 0.5, 0.1, 0.3), (2, 0.5, 0.2, 0.3)], "run long, accuracy double, precision double, recall double")
    assert {r["metric"]: r["run"] for r in evaluate.best_runs(log).collect()} == {"accuracy": 1, "precision": 2, "recall": 1}
    assert json.loads(evaluate.report(log))["run"] == 1
    assert evaluate.compare_models(spark, {"m": log}).first()["run"] == 1


def test_profile_edges(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a")], "x int, k string")
    assert profile.duplicate_rows(d).first()[0] == 2
    assert profile.duplicate_rows(d.limit(0)).first()[0] == 0
    assert profile.mode(spark.createDataFrame([(2,), (1,), (1,), (2,)], "x int"), [], "x").first()[0] == 1
    r = profile.describe(d, ["x"]).first()
    assert (r["n"], r["mean"], r["q50"]) == (2, 1.0, 1.0)
    assert profile.column_types(d).count() == 2


def test_sources(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text("x,y\n1.5,a\nNaN,\n,b\n")
    assert rows(tables.read_csv(spark, p, "x double, y string"), "y") == [(None, None), (1.5, "a"), (None, "b")]
    with pytest.raises(ValueError):
        tables.load("json", spark, p)
    f = spark.createDataFrame([(1,)], "x int")
    assert tables.load("pd", spark, f) is f
    (tmp_path / "h.txt").write_text("skip\n 1 2 3\n 4 5\n 6  7 8\n9 10\n")
    rec = tables.read_records(spark, str(tmp_path / "h.txt"), 1)
    d = rec.select("i", *[F.get("fields", F.lit(k)).cast("double").alias(f"f{k}") for k in range(3)])
    got = tables.stitch_pairs(d, "i", {"a": "f0", "b": "f1", "c": "f2"}, {"d": "f0", "t": "f1"})
    assert rows(got, "pair") == [(0, 1, 2, 3, 4, 5), (1, 6, 7, 8, 9, 10)]
    assert tables.two_clusters(spark).count() == 50
    tables.save_model(f, str(tmp_path / "m"))
    assert json.loads(tables.report(f).first()[0]) == {"x": 1}


def test_records_of_several_files_are_one_sequence(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("".join(f" {10 * k + j}  x\n" for j in range(10)))
    rec = tables.read_records(spark, str(tmp_path), 4).select("i", F.get("fields", F.lit(0)).cast("long"))
    assert rows(rec, "i") == [(i, i + 4) for i in range(26)]


def test_nearest_takes_all_queries_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(5).integers(-3, 4, (300, 4)).astype(float)  # many ties
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = extras.nearest(e, e.where("vec_id % 20 = 0"), 5, query_block=4, row_block=40)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    true = [(q, n, k + 1) for q in range(0, 300, 20) for k, n in enumerate(sorted((n for n in range(300) if n != q), key=lambda n: (d[q, n], n))[:5])]
    assert sorted((r["query_id"], r["neighbor_id"], r["rank"]) for r in got.collect()) == sorted(true)


def test_probability_rules(spark):
    d = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    assert tuple(d.agg(extras.probability(a), extras.sum_rule(a, b), extras.product_rule(a, b)).first()) == (0.5, 0.75, 0.25)
    assert extras.posterior(d, [], a, b).first()["posterior"] == 0.5


def test_stream_scores_like_a_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("age")).write.parquet(src)
    batch = spark.read.parquet(src)
    scale, model = prep.fit_scale(batch, "age"), linear.Model((1.0,), 0.0, True)
    want = scoring.scored(batch, scale, "age", ["age"], model).where("predicted = 1").count()
    stream = scoring.scored(spark.readStream.schema(batch.schema).parquet(src), scale, "age", ["age"], model)
    q = scoring.hits_by_window(stream, "ts").writeStream.format("memory").queryName("hits").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hits").agg(F.sum("n"), F.sum("n_positive")).first() == (100, want)
