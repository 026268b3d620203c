"""Prepared views by model name; lazy, so only the one asked for is ever computed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.prep import drop_columns, impute_mean, impute_text, known_categories, one_hot, sigma_bins, standardize
from ..sources.tables import CATEGORICAL

IDS = ["id", "full_name"]


def logistic(df: DataFrame) -> DataFrame:
    df = one_hot(drop_columns(df, IDS), CATEGORICAL)
    return impute_mean(standardize(df, ["age"]), ["age"])


def logistic_binned(df: DataFrame) -> DataFrame:
    """All eight bins are levels of age, seen or not."""
    df = impute_mean(standardize(drop_columns(df, IDS), ["age"]), ["age"])
    known = known_categories(df, CATEGORICAL) | {"age": list(range(1, 9))}
    return one_hot(sigma_bins(df, "age"), ["age", *CATEGORICAL], known)


def tree(df: DataFrame) -> DataFrame:
    """Categories stay texts, 'nan' among them; age becomes a bin."""
    df = impute_text(drop_columns(df, IDS), CATEGORICAL)
    return sigma_bins(impute_mean(standardize(df, ["age"]), ["age"]), "age")


VIEWS = {"logisticReg": logistic, "logisticRegWithAgeBinning": logistic_binned, "decisionTree": tree, "neuralNetwork": lambda df: df}


def prepared(df: DataFrame, model: str) -> DataFrame:
    if model not in VIEWS:
        raise ValueError(f"unknown model: {model}")
    return VIEWS[model](df)


def features_and_label(df: DataFrame, label: str = "click") -> DataFrame:
    """Features first, the target last as `label`, in one frame so that they cannot misalign."""
    return df.select(*[c for c in df.columns if c != label], df[label].alias("label"))
