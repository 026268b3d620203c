"""The catalogue: each query as a plan on the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import algebra, losses
from ..operators import evaluate, extras, graph, linear, links, prep, profile, split, tree
from ..sources import tables
from ..sources.tables import CATEGORICAL, click_view, table
from . import views

#: The learners' input: small whole numbers, so that sums are exact in any order.
X, RATE, START, BIAS, EPOCHS = ["x1", "x2"], 2.0**-14, (0.5, -0.25), 0.0, 3
GRID = {"rate": [2.0**-14, 2.0**-12], "epochs": [1, 3], "loss": ["MAE", "MSE"]}
#: The recorded grid of the ad-click runs.
RECORDED_GRID = {"epochs": [4, 5, 6, 7, 8, 9, 10], "learningRate": [0.0005, 0.001, 0.005, 0.008, 0.01, 0.05, 0.1], "loss": ["MSE", "MAE"]}
#: A grid over every dimension that a run has.
FULL_GRID = {"bias": [0.125, 0.5], "degree": [1, 2], "epochs": [1, 2], "loss": ["MAE", "MSE"], "rate": [2.0**-14], "seed": [1, 2]}
#: The project models' grid (for 19 and for 26 weights).
PROJECT_GRID = {
    "bias": [0.5, 1.0, 2.0, 5.0],
    "degree": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11],
    "epochs": [10, 25, 50, 200, 300, 500],
    "loss": ["MSE", "MAE"],
    "rate": [0.008, 0.01, 0.012, 0.015, 0.02, 0.03, 0.05, 0.07, 0.12, 0.15],
    "seed": [1, 2, 27],
}
#: The strategy document.
STRATEGY = {
    "strategyId": "STRAT-001",
    "strategyName": "Moving Average Crossover",
    "description": "Tests a simple moving average crossover strategy using short and long period averages.",
    "tickers": [{"symbol": "AAPL", "displayName": "Apple Inc.", "allocation": 0.4}, {"symbol": "MSFT", "displayName": "Microsoft Corporation", "allocation": 0.6}],
    "timeframe": {"start": "2024-01-01T00:00:00Z", "end": "2024-12-31T00:00:00Z"},
    "settings": {"initialCapital": 100000, "rebalanceFrequency": "monthly", "benchmark": "SPY"},
    "additionalProperties": {
        "indicators": [{"name": "SMA", "parameters": {"shortWindow": 20, "longWindow": 50}}, {"name": "RSI", "parameters": {"period": 14, "overbought": 70, "oversold": 30}}],
        "riskManagement": {"stopLoss": 0.05, "takeProfit": 0.1, "positionSizing": "fixed"},
        "notes": "Backtest configured for 1-year period with monthly rebalancing.",
    },
}


def r(c, digits: int = 6):
    """Rounded for comparison; no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def learning(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("double").alias("x1"), (F.col("l_quantity") % 16 - 8).alias("x2"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y01"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """actual in {-1, 0, 1}, predicted in quarters, features x1, x2."""
    p = table(spark, sf, "part")
    return p.select(((F.col("p_size") % 3) - 1).cast("double").alias("actual"), ((F.col("p_partkey") % 7) / 4.0 - 0.75).alias("predicted"), F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 5).cast("double").alias("x2"))


def graph_of(spark: SparkSession, sf: str, ring: bool = True, root: bool = False) -> tuple[DataFrame, DataFrame]:
    """Regions and nations; regions in a ring, or below a root."""
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    nodes = region.select((F.col("r_regionkey") + 1000).cast("long").alias("node_id"), F.col("r_name").alias("data")).union(nation.select((F.col("n_nationkey") + 2000).cast("long"), "n_name"))
    edges = nation.select((F.col("n_regionkey") + 1000).cast("long").alias("u"), (F.col("n_nationkey") + 2000).cast("long").alias("v"))
    if ring:
        edges = edges.union(region.select((F.col("r_regionkey") + 1000).cast("long"), ((F.col("r_regionkey") + 1) % 5 + 1000).cast("long")))
    if root:
        nodes = nodes.union(spark.createDataFrame([(1, "root")], "node_id long, data string"))
        edges = edges.union(region.select(F.lit(1).cast("long"), (F.col("r_regionkey") + 1000).cast("long")))
    return nodes, edges


def csv_roundtrip(spark, sf):
    path = tables.scratch_path(spark, "click-csv")
    tables.write_csv(click_view(spark, sf), path)
    return tables.load("csv", spark, path).agg(F.count("*").alias("n_rows"), F.count("age").alias("n_age"), F.sum("age").alias("sum_age"), F.count("gender").alias("n_gender"), F.count("time_of_day").alias("n_time"), F.sum("click").alias("n_click"))


def raw_text_records(spark, sf):
    path = tables.scratch_path(spark, "records")
    e = table(spark, sf, "events").orderBy("event_id").select(F.concat_ws("  ", F.lit(" "), F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")))
    e.write.text(path)
    rec = tables.read_records(spark, path, skip=22)
    return rec.select("i", F.get("fields", F.lit(0)).cast("long").alias("event_id"), F.get("fields", F.lit(1)).cast("long").alias("user_id"), F.get("fields", F.lit(2)).alias("event_type"))


def row_pair_stitch(spark, sf):
    e = table(spark, sf, "events")
    return tables.stitch_pairs(e, "event_id", {"first_value": "value", "first_user": "user_id"}, {"second_user": "user_id", "target": "value"})


def profile_describe(spark, sf):
    return rounded(profile.describe(click_view(spark, sf), ["id", "age", "click"]))


def imputed_age(spark, sf):
    return prep.impute_mean(prep.standardize(click_view(spark, sf), ["age"]), ["age"])


def sigma_bin_counts(spark, sf):
    return prep.sigma_bins(imputed_age(spark, sf).select("age"), "age").groupBy(F.col("age").alias("bin")).agg(F.count("*").alias("n"))


def column_sums(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), r(F.col(c)).alias("total")) for c in df.columns])).alias("s")).select("s.*")


def view_tree(spark, sf):
    v = views.prepared(click_view(spark, sf), "decisionTree")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value")) for c in v.columns if c != "click"])
    return v.select("click", F.explode(cells).alias("s")).groupBy("s.column", "s.value").agg(F.count("*").alias("n"), F.sum("click").cast("long").alias("n_click"))


def transform_vocabulary(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("string").alias("size"), F.col("p_type").alias("rank"), F.col("p_retailprice").alias("price"))
    steps = [("TrimWhitespace", "name"), ("Uppercase", "name"), ("Lowercase", "brand"), ("StandardizeCategories", "kind", {"synonyms": {"ECONOMY": "LOW", "PROMO": "LOW"}}), ("CastToInt", "size"), ("OrdinalEncode", "rank"), ("ClipOutliers", "price", {"sigmas": 1.0}), ("HandleMissingValues", "ALL")]
    return rounded(prep.apply_steps(p, steps))


def polynomial_expand(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 9).cast("double").alias("x2"))
    return p.select("p_partkey", *algebra.expand(X, 3))


def scored(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 9).cast("double").alias("x2"))


def quadratic_form_diag(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 9).cast("double")).alias("v"))
    return algebra.diagonal_form(p, ["p_partkey"], "v").select("p_partkey", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "q")


def loss_total(loss):
    return lambda spark, sf: pairs(spark, sf).agg(r(F.avg(losses.LOSSES[loss].value(F.col("actual"), F.col("predicted")))).alias("mean_loss"), r(F.sum(losses.LOSSES[loss].value(F.col("actual"), F.col("predicted")))).alias("total_loss"))


def gradient(loss):
    def q(spark, sf):
        k = losses.LOSSES[loss]
        d = pairs(spark, sf)
        out = d.agg(F.count("*").alias("n"), *algebra.gradient_sums(X, k.gradient(F.col("actual"), F.col("predicted"))))
        # hinge: the direction of the weights is negated, its bias is not
        sign = -1.0 if loss == "hinge" else 1.0
        scale = 2.0 / F.col("n") if k.mean_gradient else F.lit(1.0)
        return out.select(r(sign * scale * F.col("g_0")).alias("g_1"), r(sign * scale * F.col("g_1")).alias("g_2"), r(scale * F.col("g_bias")).alias("g_bias"))

    return q


def epochs_frame(spark: SparkSession, models: list[linear.Model]) -> DataFrame:
    rows = [(i, *[round(float(w), 9) + 0.0 for w in (*m.weights, m.bias)]) for i, m in enumerate(models, 1)]
    return spark.createDataFrame(rows, "epoch long, w1 double, w2 double, bias double")


def fitted(loss, signed, label):
    return lambda spark, sf: epochs_frame(spark, linear.fit(learning(spark, sf), X, label, linear.Model(START, BIAS, signed), losses.LOSSES[loss], RATE, EPOCHS))


def ols_closed_form(spark, sf):
    m = linear.least_squares(table(spark, sf, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 100).cast("double").alias("y")), ["x"], "y")
    return spark.createDataFrame([(round(m.weights[0], 6) + 0.0, round(m.bias, 6) + 0.0)], "slope double, intercept double")


def grid_log(spark, sf):
    """Even orders train, odd ones test."""
    d = learning(spark, sf)
    runs = split.grid_runs(GRID)
    models = linear.grid_fit(d.where("l_orderkey % 2 = 0"), X, "y01", runs, list(START), 0.125)
    log = evaluate.run_log(d.where("l_orderkey % 2 = 1"), X, "y01", models)
    return log.join(F.broadcast(split.grid_frame(spark, GRID)), "run")


def judged(spark, sf):
    """A fixed rule's predictions: the flagship's first steps."""
    d = imputed_age(spark, sf).withColumn("female", F.when(F.col("gender") == "Female", 1.0).otherwise(0.0))
    # rounding keeps classes alike where imputed means meet the border
    s = algebra.sign_class([F.round("age", 6), F.col("female")], [1.0, -0.5], 0.25)
    return d.select("click", prep_class(s).alias("predicted"))


def prep_class(s):
    return F.when(s == -1, 0.0).otherwise(s)


def flagship(spark, sf):
    return rounded(evaluate.confusion(judged(spark, sf), "click", "predicted", compat=True))


TREE = ["gender", "device_type", "ad_position", "browsing_history", "time_of_day"]


def tree_rows(spark, sf):
    return prep.impute_text(click_view(spark, sf), TREE).select("id", *TREE, "click")


def scores(criterion):
    return lambda spark, sf: rounded(tree.split_scores(tree_rows(spark, sf), TREE, "click", criterion).select("column", "score"), 9)


def tree_best_split(spark, sf):
    return rounded(tree.best_split(tree.split_scores(tree_rows(spark, sf), TREE, "click")), 9)


def tree_depth1_leaves(spark, sf):
    t = tree.grow(tree_rows(spark, sf), TREE, "click", max_depth=1)
    return t.frame(spark).where("depth = 1").select("value", "prediction", "n", "n_pos")


def tree_depth2_predict(spark, sf):
    d = tree_rows(spark, sf)
    return tree.predict(d, tree.grow(d, TREE, "click", max_depth=2)).groupBy("click", "prediction").agg(F.count("*").alias("n"))


def tree_eval(spark, sf):
    d = tree_rows(spark, sf)
    return rounded(evaluate.confusion(tree.predict(d, tree.grow(d, TREE, "click", max_depth=2)), "click", "prediction", compat=False))


def tree_deep_eval(spark, sf):
    """Depth 15; grows on four fifths, judged on the rest."""
    d = split.train_test(tree_rows(spark, sf), "id")
    t = tree.grow(d.where("not is_test"), TREE, "click", max_depth=15)
    return rounded(evaluate.confusion(tree.predict(d.where("is_test"), t), "click", "prediction", compat=True))


def graph_edge_validation(spark, sf):
    nodes, edges = graph_of(spark, sf)
    extra = spark.createDataFrame([(1000, 9999), (1000, 2000), (2000, 1000)], "u long, v long")
    return graph.edge_errors(nodes, edges.union(extra))


def graph_remove_node(spark, sf):
    nodes, edges = graph.remove_node(*graph_of(spark, sf), 1000)
    return graph.degrees(edges).join(nodes, F.col("node") == F.col("node_id")).select("node", "degree")


def walk(context, tree_only=False, search=graph.bfs, levels=6):
    def q(spark, sf):
        nodes, edges = graph_of(spark, sf, ring=not tree_only, root=tree_only)
        return search(nodes, edges, context(F.col("node_id")), levels).select("step", "node", "path")

    return q


def bayes_posterior(spark, sf):
    return rounded(extras.posterior(click_view(spark, sf), ["device_type"], F.col("click") == 1, F.coalesce(F.col("gender") == "Male", F.lit(False))))


def strategy_document(spark, sf):
    doc = spark.createDataFrame([(json.dumps(STRATEGY),)], "doc string")
    return tables.strategy_indicators(tables.parse_strategies(doc, "doc"))


def sma_window(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", r(extras.moving_average("value", ["user_id"], ["ts", "event_id"], 20)).alias("sma"))


def rsi_window(spark, sf):
    return extras.relative_strength(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), "value", ["user_id"], ["ts", "event_id"], 14).select("event_id", r("rsi").alias("rsi"))


def knn_topk(spark, sf):
    """Every row whose id is divisible by 20 against all rows."""
    e = table(spark, sf, "embeddings")
    return rounded(extras.nearest(e, e.where("vec_id % 20 = 0"), 5).select("query_id", "neighbor_id", F.col("rank").cast("long").alias("rank"), "distance"))


def grid_full_log(spark, sf):
    """Runs over every dimension: start weights by seed, expanded by degree, and start biases."""
    d, runs = learning(spark, sf), split.grid_runs(FULL_GRID)
    models = linear.grid_fit(d.where("l_orderkey % 2 = 0"), X, "y01", runs)
    return evaluate.run_log(d.where("l_orderkey % 2 = 1"), X, "y01", models).join(F.broadcast(split.grid_frame(spark, FULL_GRID)), "run")


def best_run_json(spark, sf):
    text = evaluate.report(grid_log(spark, sf))
    return spark.createDataFrame([(text,)], "report string").select(F.from_json("report", "run long, accuracy double").alias("r")).select("r.*")


def compare_models(spark, sf):
    log = grid_log(spark, sf)
    return evaluate.compare_models(spark, {"all": log, "short": log.where("epochs = 1")}).select("model", "run", "accuracy")


def model_export(spark, sf):
    """Fitted epochs, saved and read again."""
    path = tables.scratch_path(spark, "model")
    tables.save_model(QUERIES["linreg_mse_gd"](spark, sf), path)
    return spark.read.parquet(path)


def search_driver(spark, sf):
    """What an evaluator sees that is notified after the search; unknown starts and missing criteria are refused before it."""
    nodes, edges = graph_of(spark, sf)
    seen, refused = [], 0
    for wrong in (graph.SearchContext(1000), graph.SearchContext(-1, max_depth=1)):
        try:
            graph.bfs(nodes, edges, wrong)
        except KeyError:
            refused += 1
    graph.bfs(nodes, edges, graph.SearchContext(1000, target=F.col("node_id") == 2012), 6, evaluator=seen.append)
    return seen[0].agg(F.lit(len(seen)).cast("long").alias("notified"), F.lit(refused).cast("long").alias("refused"), F.count("*").alias("n_steps"))


def graph_add_nodes(spark, sf):
    nodes, _ = graph_of(spark, sf)
    return graph.add_nodes(nodes, table(spark, sf, "nation").select(F.col("n_name").alias("data")), last_id=1003)


def tree_links(spark, sf):
    """Nations below regions, added in two steps, one removed."""
    nation = table(spark, sf, "nation").select((F.col("n_nationkey") + 2000).cast("long").alias("node_id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), (-F.col("n_nationkey")).cast("long").alias("position"))
    none = spark.createDataFrame([], "node_id long, parent_id long, position long")
    first = links.add_children(none, nation.where("node_id % 2 = 1"))
    both = links.add_children(first, nation.where("node_id % 2 = 0"))
    return links.children(links.remove_children(both, nation.where("node_id = 2012")))


QUERIES = {
    "scan_project_drop": lambda s, d: prep.drop_columns(click_view(s, d), views.IDS),
    "csv_roundtrip": csv_roundtrip,
    "raw_text_records": raw_text_records,
    "feature_label_split": lambda s, d: views.features_and_label(prep.drop_columns(click_view(s, d), views.IDS)),
    "equality_filter": lambda s, d: click_view(s, d).where(F.col("gender") == "Male").select("id", "age", "gender"),
    "label_recode": lambda s, d: click_view(s, d).select("id", prep.recode_labels("click").alias("recoded")).withColumn("back", prep.recode_back("recoded")),
    "preview_top5": lambda s, d: profile.preview(click_view(s, d), "id"),
    "row_pair_stitch": row_pair_stitch,
    "profile_describe": profile_describe,
    "profile_shape_missing": lambda s, d: profile.shape_and_missing(click_view(s, d)),
    "duplicate_rows": lambda s, d: profile.duplicate_rows(prep.drop_columns(click_view(s, d), views.IDS)),
    "mode_smallest_tie": lambda s, d: profile.mode(click_view(s, d), ["time_of_day"], "age"),
    "distinct_categories": lambda s, d: profile.categories(click_view(s, d), CATEGORICAL),
    "onehot_features": lambda s, d: prep.one_hot(click_view(s, d).select("id", *CATEGORICAL), CATEGORICAL),
    "standardize_population": lambda s, d: rounded(prep.standardize(click_view(s, d).select("id", "age"), ["age"])),
    "impute_mean": lambda s, d: rounded(prep.impute_mean(click_view(s, d).select("id", "age"), ["age"])),
    "impute_nan_string": lambda s, d: prep.impute_text(click_view(s, d).select("id", *CATEGORICAL), CATEGORICAL),
    "sigma_bin_counts": sigma_bin_counts,
    "view_logistic": lambda s, d: column_sums(views.prepared(click_view(s, d), "logisticReg")),
    "view_logistic_binned": lambda s, d: column_sums(views.prepared(click_view(s, d), "logisticRegWithAgeBinning")),
    "view_tree": view_tree,
    "transform_vocabulary": transform_vocabulary,
    "split_80_20": lambda s, d: split.train_test(click_view(s, d).select("id"), "id"),
    "param_grid_runs": lambda s, d: split.grid_frame(s, RECORDED_GRID),
    "polynomial_expand": polynomial_expand,
    "linear_score": lambda s, d: scored(s, d).select("p_partkey", algebra.linear_score(X, [2.0, -0.5], 0.25).alias("score")),
    "sign_class": lambda s, d: scored(s, d).select("p_partkey", algebra.sign_class(X, [0.5, -4.0], 0.0).alias("class")),
    "quadratic_form_diag": quadratic_form_diag,
    **{f"loss_{n.lower()}": loss_total(n) for n in losses.LOSSES},
    **{f"grad_{n.lower()}": gradient(n) for n in losses.LOSSES},
    "rmse_r2": lambda s, d: pairs(s, d).agg(r(losses.rmse(F.col("actual"), F.col("predicted"))).alias("rmse"), r(losses.r_squared(F.col("actual"), F.col("predicted"))).alias("r2")),
    "linreg_mse_gd": fitted("MSE", False, "y"),
    "linreg_mae_gd": fitted("MAE", False, "y"),
    "signreg_mse_gd": fitted("MSE", True, "y01"),
    "perceptron_fit": fitted("perceptron", True, "y"),
    "svm_fit": fitted("hinge", True, "y"),
    "ols_closed_form": ols_closed_form,
    "grid_fit_log": lambda s, d: rounded(grid_log(s, d)),
    "grid_best_run": lambda s, d: rounded(evaluate.best_runs(grid_log(s, d))),
    "confusion_compat": flagship,
    "confusion_standard": lambda s, d: rounded(evaluate.confusion(judged(s, d), "click", "predicted", compat=False)),
    "error_rate": lambda s, d: judged(s, d).agg(r(evaluate.error_rate("click", "predicted")).alias("error_rate")),
    "tree_split_scores": scores("gini"),
    "tree_entropy_scores": scores("entropy"),
    "tree_chi2_scores": scores("chi2"),
    "tree_best_split": tree_best_split,
    "tree_depth1_leaves": tree_depth1_leaves,
    "tree_depth2_predict": tree_depth2_predict,
    "tree_eval": tree_eval,
    "tree_deep_eval": tree_deep_eval,
    "graph_adjacency": lambda s, d: graph.adjacency(graph_of(s, d)[1]),
    "graph_export": lambda s, d: graph.undirected(graph_of(s, d)[1]),
    "graph_degrees": lambda s, d: graph.degrees(graph_of(s, d)[1]),
    "graph_edge_validation": graph_edge_validation,
    "graph_remove_node": graph_remove_node,
    "bfs_first_visit": walk(lambda n: graph.SearchContext(1000, target=n == 2012)),
    "bfs_revisit_until_target": walk(lambda n: graph.SearchContext(1000, target=n == 2012, allow_revisiting=True)),
    "bfs_max_depth": walk(lambda n: graph.SearchContext(1000, max_depth=2)),
    "dfs_preorder": walk(lambda n: graph.SearchContext(1, target=n == 2012), tree_only=True, search=graph.dfs),
    "bayes_posterior": bayes_posterior,
    "strategy_document": strategy_document,
    "sma_window": sma_window,
    "rsi_window": rsi_window,
    "knn_topk": knn_topk,
    "column_types": lambda s, d: profile.column_types(click_view(s, d)),
    "drop_by_position": lambda s, d: prep.drop_position(click_view(s, d), 1),
    "split_seeded": lambda s, d: split.train_test(click_view(s, d).select("id"), "id", salt=5),
    "seeded_weights": lambda s, d: rounded(s.createDataFrame(list(enumerate(split.seeded_weights(3, 1))), "i long, w double"), 9),
    "expand_weights": lambda s, d: s.createDataFrame(list(enumerate(algebra.expand_weights([2.0, 3.0], 3))), "i long, w double"),
    "project_grid_runs": lambda s, d: split.grid_frame(s, PROJECT_GRID),
    "grid_full_log": lambda s, d: rounded(grid_full_log(s, d)),
    "best_run_json": lambda s, d: rounded(best_run_json(s, d)),
    "compare_models": lambda s, d: rounded(compare_models(s, d)),
    "model_export": model_export,
    "report_rows": lambda s, d: tables.report(profile.shape_and_missing(click_view(s, d))),
    "probability_rules": lambda s, d: click_view(s, d).agg(r(extras.sum_rule(F.col("click") == 1, F.col("gender") == "Male")).alias("either"), r(extras.product_rule(F.col("click") == 1, F.col("gender") == "Male")).alias("both")),
    "search_driver": search_driver,
    "graph_add_nodes": graph_add_nodes,
    "tree_links": tree_links,
}
