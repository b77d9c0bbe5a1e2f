"""Mixing sources to target weights with soft membership.

The domains are those of the label table: ``toxic``, else ``high`` or ``low`` quality. A naive Bayes classifier on
the presence of at most ``FEATURES`` terms per domain, fitted on a bounded sample of labelled rows
(``SAMPLE_PER_DOMAIN`` of each domain, chosen by a hash), gives every document a posterior over them. A document of
``n`` tokens adds ``n * p[k]`` expected tokens to domain ``k``; wanted are rates ``r >= 0`` with

    sum over documents of r * n * p[k]  =  weight[k] * (all tokens)        in the least-squares sense.

Among all such rates they are the ones nearest to 1, which are ``max(0, 1 + sum of factor[k] * p[k])`` with one factor per domain
(up to ``NUDGE`` times the factors, which makes them unique). The factors are found by projected Newton steps: scaled by
the second moments of the documents that are not at 0, rare domains converge as fast as common ones. A step needs a few
sums over all documents, so only some numbers per pair of domains reach the driver. Steps are taken until every target is met to ``TOLERANCE`` or
the least squares are reached; then the rest that cannot be met is a warning. After ``STEPS`` steps without either the fit fails.

Everything is DataFrame functions.

Defined cases: a null or empty text has no tokens, the classifier's prior and the rate that the
steps give that; labels without a document or with nulls are not learned from; contradicting labels count for each
domain; no usable label gives the single domain ``all``, and
without a weighted domain all rates are 1; targets of domains that don't occur cannot be met and are
missed by the least squares (with a warning); repeated rows have a rate each; other columns are kept by ``mixed``.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seapoint.llm.staging import scratch, staged

WEIGHTS = {"high": 0.8, "low": 0.2, "toxic": 0.0}
SAMPLE_PER_DOMAIN = 3000
FEATURES = 200
SUPPORT = 5
LEAST_RATIO = 25.0
STEPS = 200
TOLERANCE = 1e-5
NUDGE = 1e-9
_SHORTER = tuple(4.0**-j for j in range(1, 9))

_TOKEN = r"\p{L}+|[^\p{L}\p{N}\s]{2,}"


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)))


def _labelled(documents: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """A bounded sample of ``domain, text`` and its size by domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    rows = (
        labels.select(F.col("doc_id").alias("labelled_id"), domain.alias("domain"))
        .filter("domain IS NOT NULL AND labelled_id IS NOT NULL")
        .distinct()
    )
    counts = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))]) if counts else F.lit(None)
    draw = F.pmod(F.xxhash64("labelled_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = staged(rows.filter(draw < share[F.col("domain")]) if counts else rows, "labelled")
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(drawn, F.col("doc_id") == F.col("labelled_id")).select("domain", "text"), counts


def fit_domains(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_DOMAIN, features: int = FEATURES
) -> dict:
    """``domains``, the log priors of all labels, and the log odds of the chosen terms."""
    rows, counts = _labelled(documents, labels, sample)
    domains = sorted(counts)
    if not domains:
        return {"domains": ["all"], "prior": [0.0], "terms": {}}
    sizes = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    seen = [F.sum((F.col("domain") == k).cast("int")).alias(f"n{i}") for i, k in enumerate(domains)]
    terms = staged(
        rows.select("domain", F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(*seen, F.count("*").alias("n"))
        .filter(F.col("n") >= SUPPORT),
        "terms",
    )
    all_rows = max(1, sum(sizes.values()))
    chosen = {}
    for i, k in enumerate(domains):
        # Log-likelihood ratio of the term's split between the domain and the others against that of all rows.
        own = sizes.get(k, 0) / all_rows
        inside, outside = F.col(f"n{i}"), F.col("n") - F.col(f"n{i}")

        def part(seen: Column, share: float) -> Column:
            return F.when(seen > 0, 2 * seen * F.log(seen / (F.col("n") * share))).otherwise(F.lit(0.0))

        ratio = part(inside, own) + part(outside, 1 - own) if 0 < own < 1 else F.lit(0.0)
        scored = terms.withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
        for r in scored.orderBy(F.desc("ratio"), "term").limit(features).collect():
            chosen[r.term] = [(r[f"n{j}"] + 0.5) / (sizes.get(d, 0) + 1.0) for j, d in enumerate(domains)]
    total = sum(counts.values())
    # A term speaks by its absence as well: what all of them add when absent goes into the prior.
    absent = [sum(math.log1p(-share[j]) for share in chosen.values()) for j in range(len(domains))]
    return {
        "domains": domains,
        "prior": [math.log(counts[k] / total) + absent[j] for j, k in enumerate(domains)],
        "terms": {t: [math.log(x) - math.log1p(-x) for x in share] for t, share in chosen.items()},
    }


def posterior(text: Column, model: dict) -> Column:
    """The domain posteriors of a text, in the order of the model's domains."""
    prior = F.array(*[F.lit(float(x)) for x in model["prior"]])
    if model["terms"]:
        table = F.from_json(F.lit(json.dumps(model["terms"])), "map<string,array<double>>")
        known = F.from_json(F.lit(json.dumps(sorted(model["terms"]))), "array<string>")
        found = F.array_intersect(_terms(text), known)
        logs = F.aggregate(found, prior, lambda s, t: F.zip_with(s, F.element_at(table, t), lambda a, b: a + b))
    else:
        logs = prior
    return F.transform(
        F.array(logs), lambda one: F.transform(one, lambda x: F.exp(F.greatest(x - F.array_max(one), F.lit(-30.0))))
    )[0]


def _described(documents: DataFrame, model: dict) -> tuple[Column, Column]:
    """Tokens and unnormalised posterior of a row of ``documents``."""
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    tokens = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return tokens.cast("double"), posterior(text, model)


def with_posterior(documents: DataFrame, model: dict, doc: Column) -> DataFrame:
    """``doc``, ``n`` tokens and posterior ``p`` of every row."""
    tokens, raw = _described(documents, model)
    rows = documents.select(doc.alias("doc"), tokens.alias("n"), raw.alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc", "n", F.transform("q", lambda x: x / total).alias("p"))


def _rate(factors: np.ndarray) -> Column:
    """The rate of a row with ``p``."""
    rate = F.lit(1.0)
    for i, x in enumerate(factors):
        rate = rate + F.col("p")[i] * F.lit(float(x))
    return F.greatest(F.lit(0.0), rate)


def fit_rates(rows: DataFrame, domains: list[str], weights: dict[str, float], steps: int = STEPS) -> np.ndarray:
    """The factors of the fitted rates of ``rows(n, p)``; all 0, so rates of 1, without a weighted domain or a token.

    ``rows`` should be a written table without many more columns than these.
    """
    k = len(domains)
    n, p = F.col("n"), F.col("p")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = float(rows.agg(F.sum("n")).first()[0] or 0.0)
    factors = np.zeros(k)
    if not total or not any(weights.get(d) for d in domains):
        return factors
    scale = sum(weights.get(d, 0.0) for d in domains) or 1.0
    target = np.array([weights.get(d, 0.0) / scale for d in domains])

    def sums(at: np.ndarray, others: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, list[float]]:
        """Objective, mix and second moments at ``at``, and the objectives at ``others``."""
        rate = _rate(at)
        live = F.when(rate > 0, n).otherwise(F.lit(0.0))
        got = rows.agg(
            *[F.sum(n * p[i] * rate).alias(f"m{i}") for i in range(k)],
            *[F.sum(live * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs],
            *[F.sum(n * _rate(x) * _rate(x)).alias(f"f{c}") for c, x in enumerate([at, *others])],
        ).first()
        moments = np.zeros((k, k))
        for i, j in pairs:
            moments[i, j] = moments[j, i] = float(got[f"g{i}_{j}"]) / total
        height = [float(got[f"f{c}"]) / total / 2 - target @ x + NUDGE / 2 * (x @ x) for c, x in enumerate([at, *others])]
        return height[0], np.array([float(got[f"m{i}"]) for i in range(k)]) / total, moments, height[1:]

    height, met, moments, _ = sums(factors, [])
    for _ in range(steps):
        gap = float(np.abs(met - target).max())
        slope = met - target + NUDGE * factors
        if gap < TOLERANCE or np.abs(slope).max() < TOLERANCE / 100:
            break
        step = np.linalg.solve(moments + (NUDGE + 1e-12 * np.trace(moments)) * np.eye(k), -slope)
        shorter = [factors + x * step for x in _SHORTER]
        now, met_now, moments_now, heights = sums(factors + step, shorter)
        best = int(np.argmin(heights))
        if heights[best] < now:
            taken = shorter[best]
            now, met_now, moments_now, _ = sums(taken, [])
        else:
            taken = factors + step
        if now >= height:
            # Not even the shortest step lowers the objective: it is at its least, to the last digits.
            break
        factors, height, met, moments = taken, now, met_now, moments_now
    else:
        raise RuntimeError(f"the rates did not converge in {steps} steps: {dict(zip(domains, met.tolist()))} against {dict(zip(domains, target.tolist()))}")
    if gap >= TOLERANCE:
        warnings.warn(f"the mix misses its targets by up to {gap:.2g}: {dict(zip(domains, met.round(6).tolist()))}", stacklevel=2)
    return factors


def document_rates(documents: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>, rate`` of every row."""
    with scratch(documents.sparkSession) as kept:
        model = fit_domains(documents, labels)
        rows = kept(with_posterior(documents, model, documents["doc_id"]), "posteriors")
        factors = fit_rates(rows, model["domains"], weights or WEIGHTS)
    return rows.select(
        F.col("doc").alias("doc_id"),
        F.col("n").cast("long").alias("n_tokens"),
        *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model["domains"])],
        _rate(factors).alias("rate"),
    )


def mixed(documents: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, by: str | None = None) -> DataFrame:
    """``documents`` with their ``sampling_rate``; rows whose rate is 0 have no place in the mix and go.

    With ``by``, a column of few values such as the language, the rows of each value are mixed to the weights by themselves. The
    factors are fitted on numbers alone; the rows themselves are read once more at the end.
    """
    with scratch(documents.sparkSession):
        model = fit_domains(documents, labels)
        numbers = staged(with_posterior(documents, model, documents[by].cast("string") if by else F.lit(None).cast("string")), "posteriors")
        values = [r.doc for r in numbers.select("doc").distinct().collect()] if by else [None]
        factors = {x: fit_rates(numbers.filter(F.col("doc").eqNullSafe(F.lit(x))), model["domains"], weights or WEIGHTS) for x in values}
    rows = with_posterior(documents, model, F.struct(*[documents[c] for c in documents.columns]))
    value = F.col("doc").getField(by).cast("string") if by else F.lit(None).cast("string")
    rate = F.lit(1.0)
    for x, fitted in factors.items():
        rate = F.when(value.eqNullSafe(F.lit(x)), _rate(fitted)).otherwise(rate)
    # Inlined, so that the optimiser does not copy the posterior into every use.
    rows = rows.select("doc", F.inline(F.array(F.struct("n", "p")))).select("doc", rate.alias("rate"))
    out = [F.col("doc").getField(c).alias(c) for c in documents.columns if c != "sampling_rate"]
    return rows.filter("rate > 0").select(*out, F.col("rate").alias("sampling_rate"))
