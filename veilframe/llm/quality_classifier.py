"""Document quality by hierarchical empirical Bayes.

A logistic classifier over a document's measurements gives its own evidence. Documents of a
site share a prior: what is known of a path (a language section of a host) is shrunk toward
its host, the host toward all hosts, the more the fewer documents there are. How strongly is
estimated from how much hosts and paths differ. A document counts for its site with its label
where it has one, else with what the classifier makes of it. All of it is grouped sums, joined
back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.quality_rules import MEASURES, ledger
from veilframe.llm.storage import Workspace
from veilframe.llm.text import only

# The classifier is fitted on at most so many labelled documents, drawn by a hash of their ids
# and measurements; where there are more, rows above the hash that leaves so many never leave
# their tasks.
MOST_LABELLED = 20_000
RIDGE = 1.0
# A site's evidence never counts for more than this many of its documents' worth of log-odds.
SITE_WEIGHT = 1.0
_EDGE = 1e-4
_DRAWS = 1 << 40

FEATURES = {
    "length": "ln(1 + n_words)",
    "symbols": "least(n_symbols / greatest(n_words, 1), 1.0)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "least(abs(word_chars / greatest(n_words, 1) - 5), 10) / 5",
}


@dataclass(frozen=True)
class Classifier:
    """Weights of the features and, last, the intercept."""

    weights: tuple[float, ...]

    def log_odds(self) -> Column:
        terms = [F.lit(w) * F.expr(f) for w, f in zip(self.weights, FEATURES.values())]
        return sum(terms, F.lit(self.weights[-1]))


def fit(labelled: DataFrame, label: str = "quality") -> Classifier:
    """Ridge logistic regression by Newton's method, on a bounded sample brought to the
    driver. With labels of one kind or none, only the intercept differs from zero."""
    columns = [F.expr(f).cast("double").alias(name) for name, f in FEATURES.items()]
    rows = labelled.where(F.col(label).isNotNull()).withColumn("draw", F.pmod(F.xxhash64("id", *MEASURES), F.lit(_DRAWS)))
    n = rows.count()
    if n > MOST_LABELLED:
        rows = rows.where(F.col("draw") < int(_DRAWS * MOST_LABELLED / n))
    rows = rows.orderBy("draw", "id", *MEASURES).limit(MOST_LABELLED)
    data = np.array(rows.select(*columns, F.col(label).cast("double")).collect(), float).reshape(-1, len(FEATURES) + 1)
    y = data[:, -1]
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    weights = np.append(np.zeros(len(FEATURES)), prior)
    if 0 < y.sum() < len(y):
        x = np.column_stack([data[:, :-1], np.ones(len(y))])
        penalty = np.append(np.full(len(FEATURES), RIDGE), 1e-6)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (y - p) - penalty * weights
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            weights = weights + np.linalg.solve(curve, slope)
    return Classifier(tuple(float(w) for w in weights))


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.ln(bounded / (1 - bounded))


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents the prior is worth, by moments: the spread within groups beside the
    spread between their means that it does not explain. ``groups`` has n, good, the sum of
    what documents count, and squares, the sum of its squares."""
    share = F.col("good") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * (share - F.lit(mean)) ** 2).alias("between"),
        F.sum(F.col("squares") - F.col("n") * share * share).alias("within"),
        F.sum(F.col("n") * F.col("n")).alias("sizes"),
    ).first()
    if not row.n or row.k < 2 or row.n == row.k:
        return 1.0
    within = max(row.within / (row.n - row.k), _EDGE)
    spread = row.n - row.sizes / row.n
    variance = (row.between - (row.k - 1) * within) / spread if spread > 0 else 0.0
    return float(min(max(within / max(variance, 1e-6), 1.0), 1e4))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    threshold: float = 0.5,
) -> DataFrame:
    """(id, document_odds, host_posterior, path_posterior, posterior, kept) of every row.

    A document's own evidence is left out of its site's when the two are combined. A null
    host or path is a site like any other; a null text has no words; labels that are null or
    belong to no document are ignored, of several for one id the least counts; without any
    labels the classifier knows nothing and every document has the same odds.
    """
    work = Workspace(docs.sparkSession, "quality")
    packed = docs.select(
        F.struct(
            F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), F.col(f"`{path_col}`").alias("path")
        ).alias("key"),
        F.col(f"`{text_col}`").alias("text"),
    )
    measured = work.store(ledger(packed, id_col="key").select("key.*", *MEASURES))
    known = only(labels, id_col, label_col).toDF("labelled", "quality").groupBy("labelled").agg(F.min("quality").alias("quality"))
    classifier = fit(measured.join(known, F.col("id") == F.col("labelled")), "quality")
    odds = classifier.log_odds()
    labelled = measured.join(known, F.col("id") == F.col("labelled"), "left")
    p = F.coalesce(F.col("quality").cast("double"), 1 / (1 + F.exp(-odds)))
    scored = labelled.select("id", "host", "path", odds.alias("odds"), p.alias("p"))
    sums = F.count(F.lit(1)).alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("squares")
    paths = work.store(scored.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum("squares").alias("host_squares")
    )
    everything = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = everything.good / everything.n if everything.n else 0.5
    host_prior = _strength(hosts.toDF("host", "n", "good", "squares"), mean)
    path_prior = _strength(paths, mean)
    sites = paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    sites = sites.select(
        F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "good", "host_n", "host_good"
    )
    same = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    host = (F.col("host_good") - F.col("p") + F.lit(host_prior * mean)) / (F.col("host_n") - 1 + F.lit(host_prior))
    path = (F.col("good") - F.col("p") + F.lit(path_prior) * F.col("host_posterior")) / (
        F.col("n") - 1 + F.lit(path_prior)
    )
    shift = F.lit(SITE_WEIGHT) * (_logit(F.col("path_posterior")) - _logit(F.lit(mean)))
    posterior = 1 / (1 + F.exp(-(F.col("odds") + shift)))
    return (
        scored.join(sites, same)
        .withColumn("host_posterior", host)
        .withColumn("path_posterior", path)
        .withColumn("posterior", posterior)
        .select(
            F.col("id").alias(id_col),
            F.col("odds").alias("document_odds"),
            "host_posterior",
            "path_posterior",
            "posterior",
            (F.col("posterior") >= threshold).alias("kept"),
        )
    )
