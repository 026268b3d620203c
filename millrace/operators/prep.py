"""Preparation of tables: dropping, one-hot, standardizing, imputing, sigma bins, and a vocabulary of named steps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import categories


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drops by name; an unknown name is an error."""
    if unknown := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no such columns: {unknown}")
    return df.drop(*columns)


def drop_position(df: DataFrame, i: int) -> DataFrame:
    return df.drop(df.columns[i])


def recode_labels(column: str) -> Column:
    """0 becomes -1, all else 1."""
    return F.when(F.col(column) == 0, -1).otherwise(1)


def recode_back(column: str) -> Column:
    """-1 becomes 0."""
    return F.when(F.col(column) == -1, 0).otherwise(F.col(column))


def clean_name(*parts: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", "_".join(parts).lower()).strip("_")


def known_categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted categories of each column. They become columns, so their number must be small."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in categories(df, columns).collect():
        found[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in found.items()}


def one_hot(df: DataFrame, columns: list[str], known: dict[str, list] | None = None, as_boolean: bool = False) -> DataFrame:
    """Indicators of all but the first sorted category, and one for missing, for each column; other columns come first.

    Rows with a missing value are 0 in each category and 1 in `<column>_nan`, which is always there.
    """
    known = known or known_categories(df, columns)
    on, off = (F.lit(True), F.lit(False)) if as_boolean else (F.lit(1.0), F.lit(0.0))
    dummies = []
    for c in columns:
        dummies += [F.when(F.col(c) == v, on).otherwise(off).alias(clean_name(c, str(v))) for v in known[c][1:]]
        dummies.append(F.when(F.col(c).isNull(), on).otherwise(off).alias(clean_name(c, "nan")))
    return df.select(*[c for c in df.columns if c not in columns], *dummies)


@dataclass(frozen=True)
class Scale:
    mean: float
    sd: float


def fit_scales(df: DataFrame, columns: list[str]) -> dict[str, Scale]:
    """Mean and population deviation of the present values of each column, in one scan."""
    if not columns:
        return {}
    r = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return {c: Scale(r[2 * i] or 0.0, r[2 * i + 1] or 0.0) for i, c in enumerate(columns)}


def fit_scale(df: DataFrame, column: str) -> Scale:
    return fit_scales(df, [column])[column]


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; zero deviation divides by one; missing stays missing."""
    scales = fit_scales(df, columns)
    return df.select(*[((F.col(c) - scales[c].mean) / (scales[c].sd or 1.0)).alias(c) if c in scales else F.col(c) for c in df.columns])


def impute_mean(df: DataFrame, columns: list[str], sentinels: tuple = (None,)) -> DataFrame:
    """Replaces sentinels by the mean of the present values, taken before the column changes."""
    if not columns:
        return df
    means = df.agg(*[F.avg(c) for c in columns]).first()
    for c, mean in zip(columns, means, strict=True):
        for s in sentinels:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(mean)) if s is None else F.when(F.col(c) == s, mean).otherwise(F.col(c)))
    return df


def impute_text(df: DataFrame, columns: list[str], text: str = "nan") -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(text)).alias(c) if c in columns else F.col(c) for c in df.columns])


def sigma_edges(df: DataFrame, column: str, digits: int = 9) -> list[float]:
    """min, mean -2, -1, -.5, 0, .5, 1, 2 sample deviations, max; they must rise."""
    r = df.agg(F.min(column), F.avg(column), F.stddev_samp(column), F.max(column)).first()
    if r[0] is None or r[2] is None:
        raise ValueError(f"{column} has too few values for bins")
    edges = [round(x, digits) for x in (r[0], *(r[1] + k * r[2] for k in (-2, -1, -0.5, 0, 0.5, 1, 2)), r[3])]
    if any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError(f"edges of {column} do not rise: {edges}")
    return edges


def sigma_bins(df: DataFrame, column: str, digits: int = 9) -> DataFrame:
    """Right-closed bins 1 to 8; the least value itself lies outside and is missing. Values and edges are rounded, as imputed means lie on an edge."""
    edges, x, ladder = sigma_edges(df, column, digits), F.round(F.col(column), digits), F.lit(None).cast("int")
    for i in range(8, 0, -1):
        ladder = F.when((x > edges[i - 1]) & (x <= edges[i]), i).otherwise(ladder)
    return df.withColumn(column, ladder)


#: Named steps of declared configurations; parameters are ours, as declarations give none.
def clip_outliers(df: DataFrame, column: str, sigmas: float = 2.0) -> DataFrame:
    s = fit_scale(df, column)
    return df.withColumn(column, F.least(F.greatest(F.col(column), F.lit(s.mean - sigmas * s.sd)), F.lit(s.mean + sigmas * s.sd)))


def ordinal_encode(df: DataFrame, column: str, order: list[str] | None = None) -> DataFrame:
    """Position in the order (or the sorted categories); unknown and missing values are missing."""
    order = order or known_categories(df, [column])[column]
    at = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)]) if order else F.create_map().cast("map<string,int>")
    return df.withColumn(column, F.element_at(at, F.col(column)))


def standardize_categories(df: DataFrame, column: str, synonyms: dict[str, str]) -> DataFrame:
    if not synonyms:
        return df
    at = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.element_at(at, F.col(column)), F.col(column)))


def require_schema(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    if wrong := {c: t for c, t in expected.items() if dict(df.dtypes).get(c) != t}:
        raise ValueError(f"columns are missing or of another type: {wrong}")
    return df


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


STEPS = {
    "TrimWhitespace": lambda df, c, **_: df.select(*[F.trim(x).alias(x) if x in (text_columns(df) if c == "ALL" else [c]) else F.col(x) for x in df.columns]),
    "HandleMissingValues": lambda df, c, text="nan", **_: impute_text(df, text_columns(df) if c == "ALL" else [c], text),
    "ValidateSchema": lambda df, c, expected=None, **_: require_schema(df, expected or {}),
    "CastToInt": lambda df, c, **_: df.withColumn(c, F.col(c).try_cast("bigint")),
    "CastToFloat": lambda df, c, **_: df.withColumn(c, F.col(c).try_cast("double")),
    "CastToString": lambda df, c, **_: df.withColumn(c, F.col(c).cast("string")),
    "ClipOutliers": lambda df, c, sigmas=2.0, **_: clip_outliers(df, c, sigmas),
    "StandardizeNumeric": lambda df, c, **_: standardize(df, [c]),
    "Lowercase": lambda df, c, **_: df.withColumn(c, F.lower(c)),
    "Uppercase": lambda df, c, **_: df.withColumn(c, F.upper(c)),
    "StandardizeCategories": lambda df, c, synonyms=None, **_: standardize_categories(df, c, synonyms or {}),
    "StandardizeSizeScale": lambda df, c, synonyms=None, **_: standardize_categories(df, c, synonyms or {}),
    "OneHotEncode": lambda df, c, **_: one_hot(df, [c]),
    "OrdinalEncode": lambda df, c, order=None, **_: ordinal_encode(df, c, order),
}


def apply_steps(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """steps: (name, column or 'ALL', parameters)."""
    for name, column, *rest in steps:
        if name not in STEPS:
            raise ValueError(f"unknown step: {name}")
        df = STEPS[name](df, column, **(rest[0] if rest else {}))
    return df
