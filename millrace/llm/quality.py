"""Quality rules: statistics of whole texts in Spark expressions and a decision list learned from labelled rows.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the labelled sample by information gain, pruned on the other
third, and kept while it is precise; rows that it covers leave, and the next rule is learned. The list becomes one ordered
`CASE WHEN ... THEN false ... ELSE true`.

Defined cases: a null text has no words; a text without words fails the base rules (n_words < 20); rows repeat as they come; labels without a
document, null labels and repeated labels (the larger counts) are harmless; with no usable label the list is empty and every row passes it; an
empty table gives an empty result; further columns of the input are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, UPPER, WORD_SPLIT

SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: a name and its expression over the statistics of a row.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
}


def length_without(text: str, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics of each whole text (prefix `q_` for what later steps only need in between)."""
    d = docs.withColumn("q_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("q_w", F.filter(F.split("q_t", WORD_SPLIT), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("q_w").cast("long"))
    d = d.withColumn("q_len", F.length("q_t")).withColumn("word_chars", length_without("q_t", SPACE).cast("long"))
    d = d.withColumn("n_symbols", (F.col("q_len") - length_without("q_t", SYMBOLS)).cast("long"))
    d = d.withColumn("n_capitals", (F.col("q_len") - length_without("q_t", UPPER)).cast("long"))
    d = d.withColumn("n_marks", (F.col("q_len") - length_without("q_t", "!?.,;:")).cast("long"))
    d = d.withColumn("q_lines", F.filter(F.split("q_t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    d = d.withColumn("n_lines", F.size("q_lines").cast("long")).withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")).drop("q_lines", "q_t", "q_len")
    # windows: a hash for each word, then one for each run of words
    d = d.withColumn("q_h", F.transform("q_w", lambda w: F.xxhash64(w))).drop("q_w")
    d = d.withColumn("q_k", F.when(F.size("q_h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("q_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("q_h", i, WINDOW))))).drop("q_h")
    again = F.size(F.array_distinct("q_k")) < F.size("q_k")
    d = d.withColumn("q_s", F.when(again, F.sort_array(F.transform("q_k", lambda k, i: F.struct(k.alias("k"), i.alias("i")))))).drop("q_k")
    near = lambda j: F.coalesce(F.get("q_s", j)["k"], F.lit(None))
    twice = F.transform("q_s", lambda e, j: F.when((e["k"] == near(j - 1)) | (e["k"] == near(j + 1)), e["i"]))
    d = d.withColumn("q_p", F.sort_array(F.filter(twice, lambda x: x.isNotNull()))).drop("q_s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("q_p", start, lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).cast("long").alias("n"), (i + WINDOW).alias("end")))
    # The guard is always true. As Spark takes row numbers for non-deterministic, filters on the result stay above the arrays instead of being rewritten in terms of
    # the text, which would repeat each array at each of its uses.
    return d.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered["n"], F.lit(0).cast("long")))).drop("q_p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass
class Rule:
    """(feature, is_greater, threshold) conditions that together reject a row."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, row: dict) -> bool:
        return all((row[f] > t) == above for f, above, t in self.conditions)

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {'>' if above else '<='} {t!r}D" for f, above, t in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule]

    def verdict(self) -> Column:
        """True keeps the row: one ordered conditional expression."""
        cases = None
        for r in self.rules:
            cases = (F if cases is None else cases).when(F.expr(r.sql()), F.lit(False))
        return F.lit(True) if cases is None else cases.otherwise(F.lit(True))


def best_condition(bad: list[dict], good: list[dict]) -> tuple[float, tuple | None]:
    """The threshold with the largest gain: rejected rows covered times the bits that their share rises by."""
    p0, n0 = len(bad), len(good)
    before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
    for f in FEATURES:
        rows = sorted([(r[f], 1) for r in bad] + [(r[f], 0) for r in good])
        p = 0
        for k in range(len(rows) - 1):
            p += rows[k][1]
            if rows[k][0] == rows[k + 1][0]:
                continue
            cut = (rows[k][0] + rows[k + 1][0]) / 2
            for above, pos, all_ in ((False, p, k + 1), (True, p0 - p, len(rows) - k - 1)):
                if pos and (gain := pos * (math.log2(pos / all_) - before)) > best[0]:
                    best = (gain, (f, above, cut))
    return best


def learn(rows: list[dict], min_precision: float = 0.95, min_cover: int = 3, max_rules: int = 16, max_conditions: int = 4) -> DecisionList:
    """rows: features and `bad`; every third row, by position, prunes."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        bad, good, rule = [r for r in grow if r["bad"]], [r for r in grow if not r["bad"]], Rule()
        while bad and good and len(rule.conditions) < max_conditions:
            _, c = best_condition(bad, good)
            if c is None:
                break
            rule.conditions.append(c)
            bad, good = [r for r in bad if rule.covers(r)], [r for r in good if rule.covers(r)]
        if not rule.conditions:
            break

        def worth(n: int, conditions=tuple(rule.conditions)) -> float:
            hit = [r["bad"] for r in prune if Rule(list(conditions[:n])).covers(r)]
            return (2 * sum(hit) - len(hit)) / max(1, len(hit))

        lengths = sorted(range(1, len(rule.conditions) + 1), key=lambda n: (worth(n), -n), reverse=True)
        for n in lengths:  # the best pruned form that is precise over all rows that are left
            pruned = Rule(rule.conditions[:n])
            hit = [r["bad"] for r in rows if pruned.covers(r)]
            if sum(hit) >= min_cover and sum(hit) >= min_precision * len(hit):
                break
        else:
            break
        rules.append(pruned)
        grow, prune, rows = ([r for r in part if not pruned.covers(r)] for part in (grow, prune, rows))
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> DecisionList:
    """Learns from at most `max_labelled` labelled rows (those with the smallest hash of their id), which bounds what the driver gets; rows that fail the base rules teach nothing."""
    some = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = with_statistics(texts).where(~base_failed()).select("doc_id", (F.col("quality") == 0).alias("bad"), *[F.expr(x).cast("double").alias(n) for n, x in FEATURES.items()], F.xxhash64("doc_id").alias("h"))
    got = [r.asDict() for r in rows.orderBy("h", "doc_id").limit(2 * max_labelled).collect()]
    return learn(got)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds statistics, `base_failed` and `kept`."""
    d = with_statistics(docs).withColumn("base_failed", base_failed())
    return d.withColumn("kept", ~F.col("base_failed") & rules.verdict())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", *STATISTICS, "base_failed", "kept")
