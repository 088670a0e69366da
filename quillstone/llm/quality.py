"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model gives each document evidence from features of its text.  Grouped sums of
the documents' probabilities give every path a rate that is shrunk towards its host's, and every
host a rate shrunk towards the global one; how strongly follows from the spread between
sites.  A document's posterior is its own evidence on top of its site's rate, which
leaves the document itself out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.workspace import join_keys, materialize

#: The logistic model is fitted on at most so many labelled documents, those with the smallest hashes of their id.
FIT_ROWS = 20_000
#: Site tables up to this many rows are broadcast (under 100 bytes a row); larger ones are shuffled, but for the rows of hot sites.
MAX_BROADCAST_SITES = 50_000
#: Strength of the ridge that keeps weights finite when the classes can be told apart fully.
RIDGE = 1e-3
#: Limits of the evidence of one document, in logits.
MOST_EVIDENCE = 12.0
#: Limits of the weight, in documents, of the rate that a site is shrunk towards.
LEAST_PRIOR, MOST_PRIOR = 5.0, 10_000.0

FEATURES = ("log_words", "symbols", "upper", "repeated", "same_again", "line_repeats", "word_length")


def features(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``_features``: array<double> in the order of FEATURES; zeros for an empty or null text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = F.col("_words"), F.col("_lines")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    share = lambda part, whole: 1 - F.size(F.array_distinct(part)) / F.greatest(whole, F.lit(1.0))
    return (
        df.withColumn("_words", F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
        .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
        .withColumn(
            "_features",
            F.array(
                F.log1p(F.size(words).cast("double")),
                F.regexp_count(text, F.lit("[^\\p{L}\\p{N}\\s.,;:'\"()/@+-]{2,}")) / n,
                F.regexp_count(text, F.lit("\\p{Lu}")) / F.greatest(F.length(text), F.lit(1)),
                F.when(F.size(words) > 0, share(words, n)).otherwise(F.lit(0.0)),
                F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) / n,
                F.when(F.size(lines) > 0, share(lines, F.size(lines).cast("double"))).otherwise(F.lit(0.0)),
                F.length(text) / n,
            ),
        )
        .drop("_words", "_lines")
    )


@dataclass(frozen=True)
class Classifier:
    """Weights of the standardised features; ``rate`` is the share of good documents in the sample."""

    weights: tuple[float, ...]
    bias: float
    rate: float

    def evidence(self) -> Column:
        """Log likelihood ratio of good to bad, from ``_features``."""
        score = F.lit(self.bias - _logit(self.rate))
        for i, w in enumerate(self.weights):
            score = score + F.col("_features")[i] * F.lit(w)
        return F.least(F.lit(MOST_EVIDENCE), F.greatest(F.lit(-MOST_EVIDENCE), score))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton's method; without both classes no feature has weight."""
    rate = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return Classifier((0.0,) * len(FEATURES), _logit(rate), rate)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), RIDGE * len(x))
    ridge[0] = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    weights = w[1:] / scale
    return Classifier(tuple(map(float, weights)), float(w[0] - weights @ mean), rate)


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> Classifier:
    """Fit on at most ``fit_rows`` labelled documents."""
    sample = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_good"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(fit_rows)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    # Of rows with one id the text with the least hash counts, so that there are no more rows than ids and reruns agree.
    one = F.min_by(F.struct("_features", F.col("_good").cast("double").alias("good")), F.struct(F.xxhash64("_text"), F.length("_text")))
    got = features(rows, "_text").groupBy("_id").agg(one.alias("r")).select("r.*").collect()
    x = np.array([r[0] for r in got], float).reshape(-1, len(FEATURES))
    return fit_logistic(x, np.array([r[1] for r in got], float))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.5,
    fit_rows: int = FIT_ROWS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs``, or the columns of it that ``keep`` names, with host, path, p_doc, host_rate, path_rate, posterior and good.

    ``labels`` has ids and a 0/1 label (null labels are left out; of several the lowest counts).
    ``p_doc`` is the document's own probability, ``host_rate`` and ``path_rate`` the shrunken rates of its
    site without it, ``posterior`` combines both, and ``good`` says whether it reaches
    ``threshold``.  Null hosts and paths are sites of their own.  Repeated rows count each.  Columns of
    ``docs`` with the names of results are replaced.  Without labels every document has its prior of one half, and is good.
    An empty table gives an empty result.
    """
    new = ("host", "path", "p_doc", "host_rate", "path_rate", "posterior", "good")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    model = fit_classifier(docs, labels, id_col, text_col, label_col, fit_rows)
    base = _logit(model.rate)
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    kept = [F.col(f"`{c}`") for c in keep]
    # Texts are read for their evidence once; sites and posteriors come from the table that holds it.
    scored = features(docs.select(*kept, F.struct(host.alias("host"), path.alias("path")).alias("_site"), F.col(text_col).alias("_text")), "_text")
    scored = materialize(scored.select(*kept, "_site", model.evidence().alias("_llr")), "quality-evidence")
    p = sigmoid(F.col("_llr") + base)

    # A site is one value, in which null hosts and paths compare as equal.
    sites = scored.groupBy("_site").agg(F.sum(p).alias("sp"), F.count("*").alias("np"))
    sites = materialize(sites.withColumn("_host", F.struct("_site.host")), "quality-sites")
    hosts = sites.groupBy("_host").agg(F.sum("sp").alias("sh"), F.sum("np").alias("nh"), F.count("*").alias("paths"))
    hosts = materialize(hosts, "quality-hosts")
    whole = sites.agg(F.sum("sp").alias("s"), F.sum("np").alias("n"), F.count("*").alias("sites")).first()
    n = whole["n"] or 0
    rate = (whole["s"] + 0.5) / (n + 1) if n else 0.5

    def prior_weight(table: DataFrame, s: str, count: str, towards: Column) -> float:
        """Moment estimate of the prior's weight from the spread of rates that is more than chance gives."""
        r = table.agg(
            F.sum(F.col(count) * (F.col(s) / F.col(count) - towards) ** 2).alias("spread"),
            F.count("*").alias("k"),
            F.sum(F.col(count).cast("double") ** 2).alias("squares"),
        ).first()
        chance = rate * (1 - rate)
        free = n - (r["squares"] or 0) / n if n else 0
        if not n or free <= 0:
            return MOST_PRIOR
        between = (r["spread"] - (r["k"] - 1) * chance) / free
        return float(min(MOST_PRIOR, max(LEAST_PRIOR, chance / between - 1))) if between > 0 else MOST_PRIOR

    host_weight = prior_weight(hosts, "sh", "nh", F.lit(rate))
    both = join_keys(sites, hosts, ["_host"], "paths", whole["sites"]).select("_site", "sp", "np", "sh", "nh")
    both = materialize(both, "quality-both")
    path_weight = prior_weight(both, "sp", "np", F.col("sh") / F.col("nh"))
    joined = scored.join(F.broadcast(both), "_site") if whole["sites"] <= MAX_BROADCAST_SITES else join_keys(scored, both, ["_site"], "np", n)
    host_rate = (F.lit(host_weight * rate) + F.col("sh") - F.col("p_doc")) / (F.col("nh") - 1 + host_weight)
    path_rate = (F.lit(path_weight) * F.col("host_rate") + F.col("sp") - F.col("p_doc")) / (F.col("np") - 1 + path_weight)
    inside = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    return (
        joined.select(*kept, F.col("_site.host").alias("host"), F.col("_site.path").alias("path"), "_llr", p.alias("p_doc"), "sp", "np", "sh", "nh")
        .withColumn("host_rate", inside(host_rate))
        .withColumn("path_rate", inside(path_rate))
        .withColumn("posterior", sigmoid(F.col("_llr") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))))
        .withColumn("good", F.col("posterior") >= F.lit(threshold))
        .drop("_llr", "sp", "np", "sh", "nh")
    )
