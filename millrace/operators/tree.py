"""Multiway categorical trees, grown level by level.

Training rows are summed to distinct feature tuples with (n, n_pos) once; a level is one aggregate over these. The score of a column at a node is
1 - sum of squared joint shares (positives of a value / rows where the column is present); the column farthest from 0.5 splits, the first on ties.
Rows with a missing value get no child. Pure nodes are not split further: every descendant, and the fallback, would predict the same. Nor are nodes whose
chosen column has a single value that all their rows have: the child would hold the same rows, choose the same column, and so on down. So depth is at most the
number of columns. Each level's tuples are written to the shared folder, so that no plan grows with the depth.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, settled

#: Nodes that the driver holds at most; growth beyond is an error, not a silent cut.
MAX_NODES = 200_000


def tuples(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.groupBy(*[F.col(c).cast("string").alias(c) for c in features]).agg(F.count("*").alias("n"), F.sum(F.col(label)).cast("long").alias("n_pos"))


def value_counts(t: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, position, column, value, n, n_pos) over present values."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).alias("value")) for i, c in enumerate(features)])
    long = t.select(*keys, "n", "n_pos", F.explode(cells).alias("s")).select(*keys, "n", "n_pos", "s.*").where("value is not null")
    return long.groupBy(*keys, "position", "column", "value").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))


def gini(keys: list[str]):
    """1 - sum of squared joint shares."""

    def score(counts: DataFrame) -> DataFrame:
        g = counts.groupBy(*keys, "position", "column").agg(F.sum("n").alias("n"), F.sum(F.col("n_pos") * F.col("n_pos")).alias("squares"))
        return g.select(*keys, "position", "column", (1 - F.col("squares") / (F.col("n") * F.col("n"))).alias("score"))

    return score


def entropy_part(k: Column, n: Column) -> Column:
    p = k / n
    return F.when(k > 0, -p * F.log2(p)).otherwise(0.0)


def binary_entropy(k: Column, n: Column) -> Column:
    return entropy_part(k, n) + entropy_part(n - k, n)


def information_gain(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of the label minus its entropy within values."""
    g = counts.groupBy(*keys, "position", "column").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("p"), F.sum(F.col("n") * binary_entropy(F.col("n_pos"), F.col("n"))).alias("within"))
    return g.select(*keys, "position", "column", (binary_entropy(F.col("p"), F.col("n")) - F.col("within") / F.col("n")).alias("score"))


def chi_square(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson's statistic of value against label: sum of n (q - p)^2 / (p (1 - p)), q a value's share of positives."""
    g = counts.groupBy(*keys, "position", "column").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("p"), F.sum(F.col("n_pos") * F.col("n_pos") / F.col("n")).alias("s"))
    spread = F.col("p") / F.col("n") * (F.col("n") - F.col("p"))
    return g.select(*keys, "position", "column", F.when(spread == 0, 0.0).otherwise((F.col("s") - F.col("p") * F.col("p") / F.col("n")) / (spread / F.col("n"))).alias("score"))


@dataclass
class Tree:
    """Nodes as rows: node, parent, depth, split column (None for leaves), value that leads to it, prediction, n, n_pos."""

    nodes: list[dict]
    features: list[str]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.nodes], "node long, parent long, depth int, split string, value string, prediction int, n long, n_pos long")


def majority(n: int, n_pos: int) -> int:
    """The mode of labels 0 and 1, the smaller on ties."""
    return int(2 * n_pos > n)


#: A split function: from value counts by (keys, position, column, value) to (keys, position, column, score), the largest preference first.
SplitFunction = Callable[[DataFrame, list[str]], DataFrame]
CRITERIA: dict[str, tuple[SplitFunction, Callable[[Column], Column]]] = {
    "gini": (lambda counts, keys: gini(keys)(counts), lambda score: F.abs(score - 0.5)),
    "entropy": (information_gain, lambda score: score),
    "chi2": (chi_square, lambda score: score),
}


def strategy(criterion: str | SplitFunction) -> tuple[SplitFunction, Callable[[Column], Column]]:
    """A named split function, or one of the caller's own, whose largest score wins."""
    return (criterion, lambda score: score) if callable(criterion) else CRITERIA[criterion]


def split_scores(df: DataFrame, features: list[str], label: str, criterion: str | SplitFunction = "gini") -> DataFrame:
    """(position, column, score) of the whole table."""
    return strategy(criterion)[0](value_counts(tuples(df, features, label), features, []), [])


def best_split(scores: DataFrame, criterion: str | SplitFunction = "gini") -> DataFrame:
    best = F.max(F.struct(strategy(criterion)[1](F.col("score")).alias("d"), (-F.col("position")).alias("p"), F.col("column"), F.col("score")))
    return scores.agg(best.alias("b")).select("b.column", "b.score")


def grow(df: DataFrame, features: list[str], label: str, max_depth: int = 15, criterion: str | SplitFunction = "gini") -> Tree:
    """One aggregate and one small collect (nodes, not rows) a level."""
    scored, preferred = strategy(criterion)
    t = settled(tuples(df, features, label).withColumn("node", F.lit(0).cast("long")), "tree")
    r = t.agg(F.sum("n"), F.sum("n_pos")).first()
    if not r[0]:
        raise ValueError("no training rows")
    nodes = [{"node": 0, "parent": None, "depth": 0, "split": None, "value": None, "prediction": majority(r[0], r[1]), "n": r[0], "n_pos": r[1]}]
    open_, spark = {0: nodes[0]}, df.sparkSession
    for depth in range(1, max_depth + 1):
        open_ = {k: x for k, x in open_.items() if 0 < x["n_pos"] < x["n"]}
        if not open_:
            break
        live = t.where(F.col("node").isin(*open_)) if len(open_) < 1000 else t
        counts = value_counts(live, features, ["node"])
        best = scored(counts, ["node"]).groupBy("node").agg(F.max(F.struct(preferred(F.col("score")).alias("d"), (-F.col("position")).alias("p"), F.col("column"))).alias("b")).select("node", F.col("b.column").alias("column"))
        children = counts.join(best, ["node", "column"]).select("node", "column", "value", "n", "n_pos").orderBy("node", "value").collect()
        new = {}
        for c in children:
            if c["node"] not in open_ or c["n"] == open_[c["node"]]["n"]:
                continue
            open_[c["node"]]["split"] = c["column"]
            x = {"node": len(nodes), "parent": c["node"], "depth": depth, "split": None, "value": c["value"], "prediction": majority(c["n"], c["n_pos"]), "n": c["n"], "n_pos": c["n_pos"]}
            nodes.append(x)
            new[x["node"]] = x
        if len(nodes) > MAX_NODES:
            raise ValueError(f"the tree has more than {MAX_NODES} nodes")
        if not new:
            break
        step = spark.createDataFrame([(x["parent"], nodes[x["parent"]]["split"], x["value"], k) for k, x in new.items()], "node long, split string, value string, child long")
        cells = F.create_map(*[y for c in features for y in (F.lit(c), F.col(c))])
        t = t.join(F.broadcast(step.select("node", "split").distinct()), "node").withColumn("value", F.element_at(cells, F.col("split")))
        old, t = t, settled(t.join(F.broadcast(step), ["node", "split", "value"]).select(*features, "n", "n_pos", F.col("child").alias("node")), "tree")
        discard(old)
        open_ = new
    discard(t)
    return Tree(nodes, features)


def predict(df: DataFrame, tree: Tree, column: str = "prediction") -> DataFrame:
    """Adds the prediction: a row follows equal values down; where none is equal, the node's own majority holds.

    One join of the (bounded) node table per level.
    """
    spark, depth = df.sparkSession, max(x["depth"] for x in tree.nodes)
    by = {x["node"]: x for x in tree.nodes}
    df = df.withColumn("t_node", F.lit(0).cast("long")).withColumn(column, F.lit(by[0]["prediction"])).withColumn("t_split", F.lit(by[0]["split"]).cast("string"))
    cells = F.create_map(*[y for c in tree.features for y in (F.lit(c), F.col(c).cast("string"))])
    for d in range(1, depth + 1):
        step = [(x["parent"], x["value"], x["node"], x["prediction"], x["split"]) for x in tree.nodes if x["depth"] == d]
        s = spark.createDataFrame(step, "t_node long, t_value string, t_child long, t_pred int, t_next string")
        df = df.withColumn("t_value", F.element_at(cells, F.col("t_split"))).join(F.broadcast(s), ["t_node", "t_value"], "left")
        df = df.withColumn(column, F.coalesce("t_pred", column)).withColumn("t_split", F.when(F.col("t_child").isNotNull(), F.col("t_next"))).withColumn("t_node", F.coalesce("t_child", F.lit(-1).cast("long"))).drop("t_value", "t_child", "t_pred", "t_next")
    return df.drop("t_node", "t_split")
