"""A quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier over a document's counts gives its own evidence. By grouped
aggregation, a path's share of good documents is shrunk toward its host's, and a
host's toward all documents'; how strongly is estimated from how much the groups
differ beyond chance. A document's probability is its own evidence with the odds of
its path in place of the odds of all documents. A document's own evidence is left out
of what its groups say about it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .common import checkpointed

#: The classifier's inputs, from the counts of quality_rules.
INPUTS: dict[str, str] = {
    "symbols": "least(1.0, n_symbols / greatest(n_words, 1))",
    "capitals": "n_upper / greatest(n_letters, 1)",
    "letters": "n_letters / greatest(n_chars, 1)",
    "bare_words": "n_bare_words / greatest(n_words, 1)",
    "word_length": "least(12.0, word_chars / greatest(n_words, 1))",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "stutter": "n_stutter / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "ended_lines": "n_ended_lines / greatest(n_lines, 1)",
    "log_words": "ln(1.0 + n_words)",
}


def train(sample: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the last a constant, of a ridge logistic regression by Newton's method on standardised inputs."""
    mean, scale = sample.mean(axis=0), sample.std(axis=0) + 1e-9
    x = np.column_stack([(sample - mean) / scale, np.ones(len(sample))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * sample.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1] / scale
    return np.append(weights, w[-1] - weights @ mean)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> float:
    """How many documents a group's prior counts for, from rows (n, s, q): counts, sums and sums of squares of evidence.

    The variance within groups over the variance between them, by moments; one row
    reaches the driver. Without two groups or any difference between them: a million.
    """
    row = groups.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not row["n"] or row["g"] < 2 or row["n"] <= row["g"]:
        return 1e6
    g, n = row["g"], float(row["n"])
    within = max(row["q"] - row["b"], 1e-9) / (n - g)
    between = (row["b"] - row["s"] ** 2 / n - (g - 1) * within) / max(n - float(row["nn"]) / n, 1e-9)
    return float(min(max(within / max(between, 1e-12), 1.0), 1e6))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality", sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, host, path, p_document, p_host, p_path, p_quality, kept), a row for each row of ``docs``.

    ``labels``: ``id_col`` and ``label_col`` (1 good, 0 bad); of several labels of an
    id the mean counts, at least one half being good. The classifier is fitted on
    about ``sample_rows`` labelled documents, those whose id hashes lowest; with no
    labels of one kind, each document's evidence is the labels' mean (one half
    without labels). ``host`` and ``path`` (paths lie within hosts): by default the
    source, and the language within it; nulls are groups of their own. kept:
    p_quality of at least one half. Null text has no words; texts of any length are
    taken whole. Null ids have no labels. Repeated rows are rows like any other, but
    the classifier sees one row of an id. Columns named like the results play no part.
    No rows: no rows.
    """
    host = docs["source"] if host is None else host
    path = docs["lang"] if path is None else path
    rows = quality_rules.features(docs, docs[text_col], [docs[id_col], host.cast("string"), path.cast("string")])
    rows = checkpointed(rows.select(F.col("keep_0").alias("doc_id"), F.col("keep_1").alias("host"), F.col("keep_2").alias("path"), *(F.expr(x).cast("double").alias(f"x_{n}") for n, x in INPUTS.items())))
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("double").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    n_marks = marks.count()
    chosen = marks
    if n_marks > sample_rows:
        chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (sample_rows / n_marks)))
    names = [f"x_{n}" for n in INPUTS]
    # One row an id, however often it is there, so that no more than the sample reaches the driver.
    found = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*names, "label")).alias("r")).select("r.*").orderBy(*names, "label").toArrow()
    y = (found["label"].to_numpy() >= 0.5).astype(float)
    if len(set(y.tolist())) == 2:
        w = train(np.column_stack([found[n].to_numpy() for n in names]), y)
        z = sum((F.col(n) * float(a) for n, a in zip(names, w[:-1], strict=True)), F.lit(float(w[-1])))
        own = 1 / (1 + F.exp(-z))
    else:
        own = F.lit(float(y.mean()) if len(y) else 0.5)
    rows = checkpointed(rows.select("doc_id", "host", "path", F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p_document")))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("p_document").alias("s"), F.sum(F.col("p_document") * F.col("p_document")).alias("q")]
    paths = checkpointed(rows.groupBy("host", "path").agg(*sums))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    whole = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = float(whole) if whole is not None else 0.5
    k_host, k_path = _strength(hosts), _strength(paths)
    groups = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("n").alias("n_path"), F.col("s").alias("s_path"))
    tops = hosts.select(F.col("host").alias("g"), F.col("n").alias("n_host"), F.col("s").alias("s_host"))
    groups = groups.join(tops, F.col("h").eqNullSafe(F.col("g"))).drop("g")
    rows = rows.join(groups, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    p_host = (F.col("s_host") - F.col("p_document") + k_host * mean) / (F.col("n_host") - 1 + k_host)
    rows = rows.withColumn("p_host", p_host)
    rows = rows.withColumn("p_path", (F.col("s_path") - F.col("p_document") + k_path * F.col("p_host")) / (F.col("n_path") - 1 + k_path))
    odds = _logit(F.col("p_document")) + _logit(F.col("p_path")) - _logit(F.lit(mean))
    rows = rows.withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return rows.select("doc_id", "host", "path", "p_document", "p_host", "p_path", "p_quality", (F.col("p_quality") >= 0.5).alias("kept"))
