"""Rates that mix documents to target weights of domains, with DataFrame functions only.

A naive Bayes classifier on hashed words, fitted on the labelled table, gives each document a
probability for each domain. The rates r >= 0 are fitted by projected gradient on least squares:
the expected tokens of domain k are the sum of r * n_tokens * p_k, the targets a weight for each domain
and the total that leaves the anchor domain ``headroom`` times its tokens. Gradients are scaled by
1 / n_tokens and by the inverse of the domains' second moments H, for which a step of 1 is safe, and each
step starts a little ahead in the direction of the last one (accelerated projected gradient, which starts anew where
that leads uphill). A step depends on the sums of the domains only, so a round is one aggregate over the documents' features, and a
document's rate is worked out from the few numbers of all rounds. The fit goes on until the targets are met or, where
no rates >= 0 meet them, until the rates stand still; ``error`` says what is left: the tokens off target
of all domains as a share of the targets'.

Defined results: null and empty texts have no tokens and the domains' priors; documents without a label
are scored like the others, labels without a document or with a null are left out, of several labels of one document the
largest counts; without any label all domains are alike; very long texts are read whole; repeated rows have equal rates; an empty
table gives no row; only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

c = F.col
DOMAINS = ("good", "low", "toxic")
#: Weights of the domains among all tokens of the mixture.
TARGETS = {"good": 0.93, "low": 0.05, "toxic": 0.02}
ANCHOR, HEADROOM = "good", 1.1
#: Labelled documents the classifier is fitted on: those with the smallest hash of doc_id.
TRAINING_DOCUMENTS = 20_000
BUCKETS, EFFECTIVE_WORDS = 8192, 60
#: Ends of the fit: error as a share of the targets, or what a step moves the rates (root of the mean square over all tokens).
CLOSE_ENOUGH, STILL = 1e-4, 3e-4
#: Rounds after which the rates are written to a table, so that no expression grows with the number of rounds.
ROUNDS_A_TABLE = 30


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\n\t\r\f\x0b", "     "), " "), "")


def buckets(found: Column) -> Column:
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def domain_of_label() -> Column:
    return F.when(c("toxic") == 1, "toxic").when(c("quality") == 0, "low").when(c("quality") == 1, "good")


def fit_classifier(docs: DataFrame, labels: DataFrame, documents: int = TRAINING_DOCUMENTS) -> tuple[list[float], list[list[float]]]:
    """Log priors of the domains and their log probabilities of the word buckets; a bounded number of counts reaches the driver."""
    labelled = labels.select(c("doc_id").alias("_doc"), domain_of_label().alias("_domain")).where("_doc is not null and _domain is not null")
    sample = labelled.groupBy("_doc").agg(F.max("_domain").alias("_domain")).orderBy(F.xxhash64("_doc"), "_doc").limit(documents)
    # at most ``documents`` rows of two short columns
    rows = docs.select(c("doc_id").alias("_doc"), c("text").alias("_text")).join(F.broadcast(sample), "_doc")
    # the outer form of explode: the plain one adds a filter that would work out the words twice
    found = rows.select("_domain", F.explode_outer(F.array_distinct(buckets(words(c("_text"))))).alias("_bucket")).where("_bucket is not null").groupBy("_domain", "_bucket").agg(F.count("*").alias("n")).collect()
    sizes = {r["_domain"]: r["n"] for r in rows.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    counts = np.full((len(DOMAINS), BUCKETS), 0.1)
    for r in found:
        counts[DOMAINS.index(r["_domain"]), r["_bucket"]] += r["n"]
    prior = np.log(np.array([sizes.get(d, 0) + 1.0 for d in DOMAINS]) / (sum(sizes.values()) + len(DOMAINS)))
    chance = np.log(counts / counts.sum(axis=1, keepdims=True))
    return prior.tolist(), (chance - chance.max(axis=0)).tolist()


def features(docs: DataFrame, prior: list[float], chance: list[list[float]]) -> DataFrame:
    """_doc, n_tokens and the probability p_<domain> of each domain."""
    def scored(values: list[float]) -> Column:
        logs = F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")  # folded to one constant in the plan
        return F.aggregate("_buckets", F.lit(0.0), lambda total, bucket: total + F.get(logs, bucket))

    rows = docs.select(c("doc_id").alias("_doc"), words(c("text")).alias("_words"))
    rows = rows.select("_doc", F.size("_words").cast("long").alias("n_tokens"), buckets(c("_words")).alias("_buckets"))
    for d, own in zip(DOMAINS, chance):
        rows = rows.withColumn(f"_s_{d}", scored(own))
    part = F.least(c("n_tokens"), F.lit(EFFECTIVE_WORDS)) / F.greatest(c("n_tokens"), F.lit(1))
    for d, p in zip(DOMAINS, prior):
        rows = rows.withColumn(f"_s_{d}", c(f"_s_{d}") * part + F.lit(p))
    rows = rows.withColumn("_top", F.greatest(*(f"_s_{d}" for d in DOMAINS)))
    for d in DOMAINS:
        rows = rows.withColumn(f"_e_{d}", F.exp(c(f"_s_{d}") - c("_top")))
    total = sum((c(f"_e_{d}") for d in DOMAINS), F.lit(0.0))
    return rows.select("_doc", "n_tokens", *((c(f"_e_{d}") / total).alias(f"p_{d}") for d in DOMAINS))


def rates(steps: list[list[float]]) -> Column:
    """(now, before) of a document after further rounds: from ``ahead`` of its rate a step along its own probabilities, cut at 0 each time."""
    own = F.struct(c("rate").alias("now"), c("before").alias("before"))
    if not steps:
        return own

    def further(x: Column, step: Column) -> Column:
        start = x["now"] + F.get(step, 0) * (x["now"] - x["before"])
        down = sum((c(f"p_{d}") * F.get(step, i) for i, d in enumerate(DOMAINS, 1)), F.lit(0.0))
        return F.struct(F.greatest(F.lit(0.0), start - down).alias("now"), x["now"].alias("before"))

    return F.aggregate(F.array(*(F.array(*map(F.lit, step)) for step in steps)), own, further)


def fit_rates(found: DataFrame, targets: dict[str, float], anchor: str, headroom: float) -> DataFrame:
    """The features with rate and error. Each round is one aggregate of one sum for each domain, and one more."""
    p = [c(f"p_{d}") for d in DOMAINS]
    moments = found.agg(*(F.coalesce(F.sum(c("n_tokens") * x), F.lit(0.0)).alias(f"t{i}") for i, x in enumerate(p)),
                        *(F.coalesce(F.sum(c("n_tokens") * x * y), F.lit(0.0)).alias(f"h{i}{j}") for i, x in enumerate(p) for j, y in enumerate(p))).first()
    sums = np.array([moments[f"t{i}"] for i in range(len(p))])
    found = found.withColumn("rate", F.lit(1.0)).withColumn("before", F.lit(1.0))
    tokens = sums.sum()
    if not tokens:
        return found.withColumn("error", F.lit(0.0)).drop("before")
    h = np.array([[moments[f"h{i}{j}"] for j in range(len(p))] for i in range(len(p))])
    inverse = np.linalg.pinv(h, rcond=1e-9, hermitian=True)
    shares = np.array([targets[d] for d in DOMAINS])
    at = DOMAINS.index(anchor)
    wanted = shares / shares[at] * headroom * sums[at]
    steps: list[list[float]] = []
    before, moved, pace = sums, np.inf, 1.0
    while np.abs(sums - wanted).sum() > CLOSE_ENOUGH * wanted.sum() and moved > STILL:
        if len(steps) == ROUNDS_A_TABLE:
            found, steps = kept(found.withColumn("_r", rates(steps)).withColumn("rate", c("_r.now")).withColumn("before", c("_r.before")).drop("_r"), "rates"), []
        faster = (1.0 + (1.0 + 4.0 * pace * pace) ** 0.5) / 2.0
        ahead, pace = (pace - 1.0) / faster, faster
        down = inverse @ (sums + ahead * (sums - before) - wanted)
        rows = found.withColumn("_old", rates(steps)).withColumn("_new", rates([*steps, [ahead, *down.tolist()]])["now"])
        step = c("_new") - c("_old.now") - F.lit(ahead) * (c("_old.now") - c("_old.before"))
        row = rows.agg(*(F.sum(c("_new") * c("n_tokens") * x).alias(f"t{i}") for i, x in enumerate(p)),
                       F.sum(c("n_tokens") * step * step).alias("moved"), F.sum(c("n_tokens") * step * (c("_new") - c("_old.now"))).alias("along")).first()
        steps.append([ahead, *down.tolist()])
        before, sums = sums, np.array([row[f"t{i}"] for i in range(len(p))])
        moved = (row["moved"] / tokens) ** 0.5
        if row["along"] < 0:
            pace = 1.0
    error = float(np.abs(sums - wanted).sum() / max(wanted.sum(), 1.0))
    return found.withColumn("rate", rates(steps)["now"]).withColumn("error", F.lit(error)).drop("before")


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str, headroom: float) -> DataFrame:
    prior, chance = fit_classifier(docs, labels)
    found = kept(features(docs, prior, chance), "domains")
    u = F.pmod(F.xxhash64("_doc", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(c("rate")) + (u < c("rate") - F.floor("rate")).cast("long")
    return fit_rates(found, targets, anchor, headroom).withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = ANCHOR, headroom: float = HEADROOM) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, error and copies (the rate rounded by a hash of doc_id, up or down by its fraction)."""
    done = fitted(docs, labels, targets, anchor, headroom)
    return done.select(c("_doc").alias("doc_id"), "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "error", "copies")


def take(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = ANCHOR, headroom: float = HEADROOM) -> DataFrame:
    """The documents that the mixture takes at least once, each row once, with all their columns.

    A document without tokens is no part of a mixture and goes; one with a null doc_id is taken.
    """
    out = fitted(docs, labels, targets, anchor, headroom).where("_doc is not null and (copies = 0 or n_tokens = 0)").select(c("_doc").alias("_out")).distinct()
    return docs.join(out, docs["doc_id"] == out["_out"], "left_anti")
