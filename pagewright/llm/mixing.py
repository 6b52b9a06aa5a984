"""Operator 5: mixing sources to target weights by soft membership, in DataFrame functions only.

A classifier fitted on a labelled table gives each document a posterior over domains. Each document gets a rate, how
often it is to be used; a domain's expected tokens are the sum over documents of rate x tokens x posterior. Rates start at
1 and are fitted by projected gradient descent on the squared difference from the target tokens: a step moves each rate
against its gradient and is projected back onto what isn't negative (or 0 to `max_rate`, if given), and only steps that lessen the difference are kept, so
the rates end at the least squares also where the targets are out of reach. Only sums over domains reach the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import materialise

#: Hash buckets of the words.
BUCKETS = 1 << 16
#: Labelled rows that the classifier is fitted on, about, of each domain.
SAMPLE_PER_DOMAIN = 5_000
#: A word counts for a domain only if its log odds are at least so many standard errors from none.
SURE = 4.0
#: A domain's sum of log odds counts up to this, either way.
LIMIT = 12.0
#: Domains of the labels table and the shares of tokens to reach.
TARGETS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}

#: For each domain its log odds by bucket, and under -1 the weights of all domains' sums and a constant.
Model = dict[str, dict[int, "float | list[float]"]]


def tokens(text: Column) -> Column:
    """Runs of letters of the lower-cased text, and single signs; digits and white space are none. Null: no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"(\p{L}+|[^\p{L}\p{N}\s])"), F.lit(1))


def n_tokens(text: Column) -> Column:
    """What the targets count: words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def label_domains(labels: DataFrame) -> DataFrame:
    """(label_id, domain) of each labelled id: toxic, else poor where the quality is 0, else good; null labels are none.

    An id that is labelled twice has the domain that comes last in the alphabet.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    named = labels.select(F.col("doc_id").cast("long").alias("label_id"), domain.alias("domain")).dropna()
    return named.groupBy("label_id").agg(F.max("domain").alias("domain"))


def sample_labels(labelled: DataFrame, domains: list[str], per_domain: int = SAMPLE_PER_DOMAIN) -> tuple[DataFrame, dict[str, int]]:
    """About `per_domain` rows of each domain of (label_id, domain), by a hash of the id; and the domains' whole row counts."""
    rows = labelled.filter(F.col("domain").isin(domains))
    sizes = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    share = F.create_map(*[F.lit(v) for d in domains for v in (d, min(1.0, per_domain / max(1, sizes.get(d, 0))))])
    taken = F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < F.element_at(share, F.col("domain")) * 1_000_000
    return materialise(rows.filter(taken)), sizes


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS, per_domain: int = SAMPLE_PER_DOMAIN) -> Model:
    """For each domain the log odds of the buckets that tell it from the others; key -1 holds the log prior.

    Fitted on the texts of about `per_domain` labelled ids of each domain, chosen by a hash of the id. The sample of ids is
    broadcast (its bound is domains x per_domain), so no text is shuffled. The driver gets the telling buckets only, at most `buckets` numbers a domain, and a few numbers for each row of one half of the sample, on which the
    weights of the sums are fitted (key -1: a weight for each domain's sum, then the constant), so that a posterior
    is worth what it says; the other half gives the odds. A domain without rows gets a posterior of nearly 0.
    """
    sample, sizes = sample_labels(labelled, domains, per_domain)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    rows = texts.join(F.broadcast(sample), texts.doc_id == sample.label_id).select("text", "domain")
    rows = materialise(rows)
    bucket, half = F.pmod(F.xxhash64("token"), F.lit(buckets)), F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(2)) == 0
    # Once for each text: a long text would otherwise outweigh the rest.
    each = rows.filter(half).select("domain", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).select("domain", bucket.alias("bucket"))
    counts = materialise(each.groupBy("bucket", "domain").agg(F.count("*").alias("n")))
    totals = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    whole, model = sum(totals.values()), {}
    wide = counts.groupBy("bucket").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)])
    for k, d in enumerate(domains):
        mine, other = totals.get(d, 0), whole - totals.get(d, 0)
        model[d] = {}
        if mine and other:
            a, b = F.col(f"n{k}") + 0.5, F.col("all") - F.col(f"n{k}") + 0.5
            odds = F.log(a / (mine + 1.0)) - F.log(b / (other + 1.0))
            told = wide.select("bucket", odds.alias("odds")).filter(F.abs(odds) >= SURE * F.sqrt(1 / a + 1 / b))
            model[d] |= {r.bucket: r.odds for r in told.collect()}
    found = sums_of(rows.filter(~half).select("domain", F.col("text").alias("_text")), model, ["domain"]).collect()
    y = np.array([domains.index(r.domain) for r in found], int)
    x = np.array([[r[f"s_{d}"] for d in domains] for r in found], float).reshape(-1, len(domains))
    weight = np.array([max(1.0, sizes[r.domain] / per_domain) for r in found])
    for d, w in zip(domains, _calibrated(x, y, weight, len(domains)), strict=True):
        model[d][-1] = w
    return model


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, rounds: int = 1000) -> list[list[float]]:
    """For each class the weights of x and a constant: softmax regression by gradient steps with momentum."""
    x = np.hstack([np.clip(x, -LIMIT, LIMIT) / LIMIT, np.ones((len(x), 1))])
    w, speed = np.zeros((classes, x.shape[1])), 0.0
    total = max(1.0, weight.sum())
    seen = np.bincount(y, weights=weight, minlength=classes) + 0.01
    w[:, -1] = np.log(seen / seen.sum())
    for _ in range(rounds if len(x) else 0):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        speed = 0.9 * speed - 0.5 * ((p * weight[:, None]).T @ x / total + 1e-5 * w)
        w = w + speed
    return [[*(row[:-1] / LIMIT).tolist(), float(row[-1])] for row in w]


def evidence(text: Column, model: Model, buckets: int = BUCKETS) -> list[Column]:
    """The places of the text's telling tokens, each distinct token once, to be named `hits`; and from it each domain's sum of log odds."""
    names = list(model)
    telling = sorted({b for d in names for b in model[d] if b >= 0})
    place = {b: k for k, b in enumerate(telling)}
    spots = [0] * buckets
    for b, k in place.items():
        spots[b] = k + 1
    spot = F.from_json(F.lit(str(spots)), "array<int>")
    own = {d: F.from_json(F.lit(str([0.0] + [round(model[d].get(b, 0.0), 6) for b in telling])), "array<double>") for d in names}
    hits = F.filter(F.transform(F.array_distinct(tokens(text)), lambda w: F.get(spot, F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))), lambda i: i > 0)

    def summed(weights: Column) -> Column:
        return F.aggregate("hits", F.lit(0.0), lambda s, i: s + F.get(weights, i))

    return [hits, *[summed(own[d]) for d in names]]


def sums_of(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` and s_<domain>...: the sums of log odds of the text in `_text`."""
    hits, *sums = evidence(F.col("_text"), model)
    rows = rows.select(*keep, hits.alias("hits"))
    return rows.select(*keep, *[s.alias(f"s_{d}") for d, s in zip(model, sums, strict=True)])


def memberships(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """(doc_id, row_key, tokens, p_<domain>...): the posteriors of every row; row_key is a hash of id and text.

    A posterior is the softmax of the weighed sums of log odds, each bounded by LIMIT. A text without telling tokens has what
    such texts have in the labelled table. With `keep_row` the whole row comes along, in the struct `row`.
    """
    names = list(model)
    row = [F.struct(*docs.columns).alias("row")] if keep_row else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *row)
    kept = ["doc_id", "row_key", "tokens", *(["row"] if keep_row else [])]
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "_text")).withColumn("tokens", n_tokens(F.col("_text")))
    rows = sums_of(rows.select(*kept, "_text"), model, kept)
    sums = [F.least(F.greatest(F.col(f"s_{d}"), F.lit(-LIMIT)), F.lit(LIMIT)) for d in names]
    powers = []
    for d in names:
        *weights, constant = model[d][-1]
        powers.append(F.exp(sum((F.lit(w) * c for w, c in zip(weights, sums, strict=True)), F.lit(constant))))
    rows = rows.select(*kept, *[p.alias(f"e_{d}") for d, p in zip(names, powers, strict=True)])
    whole = sum((F.col(f"e_{d}") for d in names[1:]), F.col(f"e_{names[0]}"))
    return rows.select(*kept, *[(F.col(f"e_{d}") / whole).alias(f"p_{d}") for d in names])


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small linear system, by elimination with pivots; a small ridge keeps it solvable."""
    n = len(right)
    rows = [[v + (1e-9 if i == j else 0.0) for j, v in enumerate(row)] + [right[i]] for i, row in enumerate(matrix)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[p] = rows[p], rows[i]
        for r in range(n):
            if r != i and rows[i][i]:
                f = rows[r][i] / rows[i][i]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] if rows[i][i] else 0.0 for i in range(n)]


@dataclass(frozen=True)
class Step:
    """A rate moves by minus `along` . posteriors. One at a bound that `push` . posteriors, its gradient, drives outward stays there."""

    along: list[float]
    push: list[float]


@dataclass(frozen=True)
class Fit:
    """The steps from rates of 1; what the domains' shares of the total tokens are to be and have become; the sum of squared differences."""

    steps: list[Step]
    wanted: list[float]
    reached: list[float]
    error: float


def _dot(weights: list[Column], p: list[Column]) -> Column:
    return sum((w * c for w, c in zip(weights[1:], p[1:], strict=True)), weights[0] * p[0])


def moved(rate: Column, along: Column, push: Column, max_rate: float) -> Column:
    """The rate after one step, projected back onto 0 to max_rate."""
    held = ((rate <= 0) & (push > 0)) | ((rate >= max_rate) & (push < 0))
    return F.when(held, rate).otherwise(F.least(F.greatest(rate - along, F.lit(0.0)), F.lit(max_rate)))


def rate_of(steps: list[Step], p: list[Column], max_rate: float) -> Column:
    """The rate after some steps from 1."""
    if not steps:
        return F.lit(1.0)
    taken = F.from_json(F.lit(json.dumps([s.along + s.push for s in steps])), "array<array<double>>")
    k = len(p)

    def step(rate: Column, s: Column) -> Column:
        along, push = ([F.get(s, F.lit(i)) for i in range(at, at + k)] for at in (0, k))
        return moved(rate, _dot(along, p), _dot(push, p), max_rate)

    return F.aggregate(taken, F.lit(1.0), step)


#: Lengths that are tried of a step to the least squares of the free rates, and of one along the gradient.
LENGTHS = ((1.0, 0.5, 0.25, 0.1, 0.03, 0.01), (8.0, 2.0, 0.5, 0.1, 0.01, 0.001))


def solve_rates(rows: DataFrame, targets: dict[str, float], total_tokens: float | None = None, max_rate: float = math.inf, rounds: int = 40, tolerance: float = 1e-3) -> Fit:
    """Projected gradient steps on the rates of `rows` (tokens, p_<domain>...) to the least squares of the domains' shares.

    The gradient of a rate is its tokens times posterior . difference; per token it is the same for all rows of like
    posteriors, so a rate is a function of the steps and its posteriors and isn't stored. A round takes two aggregates of
    numbers: the second moments of the posteriors of the free rates, which give the step that would meet the targets if no rate met a
    bound; then the differences after that step, and after the plain gradient's, at several lengths. The
    best of them is taken if it is better than standing still, so the error never grows. It ends when the difference is
    within `tolerance` of the total tokens, or two rounds running gain less than a ten-thousandth of it.
    """
    domains = list(targets)
    weight, k = sum(targets.values()) or 1.0, len(domains)
    wanted = [targets[d] / weight for d in domains]
    p = [F.col(f"p_{d}") for d in domains]
    t, rate = F.col("tokens").cast("double").alias("t"), F.col("rate")
    first = rows.select(t, *p).agg(F.sum("t").alias("t"), *[F.sum(F.col("t") * c).alias(f"a{i}") for i, c in enumerate(p)]).first()
    if not first.t:
        return Fit([], wanted, [0.0] * k, sum(w * w for w in wanted))
    total, steps, small = total_tokens or first.t, [], 0
    reached = [first[f"a{i}"] / total for i in range(k)]
    error = sum((a - w) ** 2 for a, w in zip(reached, wanted, strict=True))
    for _ in range(rounds):
        if error <= tolerance**2 or small == 2:
            break
        off = [a - w for a, w in zip(reached, wanted, strict=True)]
        numbers = rows.select(t, *p, rate_of(steps, p, max_rate).alias("rate"))
        push = _dot([F.lit(x) for x in off], p)
        free = F.when(((rate > 0) | (push < 0)) & ((rate < max_rate) | (push > 0)), F.col("t")).otherwise(0.0)
        sums = numbers.agg(*[F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        moments = [[sums[f"m{min(i, j)}_{max(i, j)}"] / total for j in range(k)] for i in range(k)]
        ways = [_solve(moments, off), [x / max(1e-9, sum(moments[i][i] for i in range(k))) for x in off]]
        trials = [Step([c * x for x in way], off) for way, lengths in zip(ways, LENGTHS, strict=True) for c in lengths]
        after = [moved(rate, _dot([F.lit(x) for x in s.along], p), push, max_rate).alias(f"r{n}") for n, s in enumerate(trials)]
        sums = numbers.select("t", *p, *after).agg(*[F.sum(F.col(f"r{n}") * F.col("t") * p[i]).alias(f"a{n}_{i}") for n in range(len(trials)) for i in range(k)]).first()
        got = [[sums[f"a{n}_{i}"] / total for i in range(k)] for n in range(len(trials))]
        errors = [sum((a - w) ** 2 for a, w in zip(g, wanted, strict=True)) for g in got]
        best = min(range(len(trials)), key=errors.__getitem__)
        if errors[best] >= error:
            break
        small = small + 1 if error - errors[best] < 1e-4 * error else 0
        steps, reached, error = [*steps, trials[best]], got[best], errors[best]
    return Fit(steps, wanted, reached, error)


def fit_rates(members: DataFrame, targets: dict[str, float], max_rate: float = math.inf, **params) -> DataFrame:
    """`members` with `rate` and `error`: rates of least squares from 0 to max_rate (no bound, unless given), and the squared difference of the shares that was reached, the same in each row.

    `targets` are weights, of `total_tokens` (those of all members, unless given). `members` is written once, and each round
    reads its numbers only.
    """
    rows = materialise(members)
    fit = solve_rates(rows, targets, max_rate=max_rate, **params)
    rate = rate_of(fit.steps, [F.col(f"p_{d}") for d in targets], max_rate)
    return rows.withColumns({"rate": rate, "error": F.lit(float(fit.error))})


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep_row: bool = False, **params) -> DataFrame:
    """(doc_id, row_key, tokens, p_<domain>..., rate, error) of every row of `docs`: fit the classifier on `labels`, then the rates.

    Null and empty texts have no tokens and the prior posterior; their rates follow from it. Equal rows get equal rates.
    With no labels every posterior is even; with no rows or no tokens the rates stay 1. Nothing wider than numbers is shuffled.
    Other columns play no part.
    """
    model = fit_classifier(docs, label_domains(labels), list(targets))
    return fit_rates(memberships(docs, model, keep_row=keep_row), targets, **params)


def apply_rates(rated: DataFrame, seed: int = 42) -> DataFrame:
    """The rows in `row`, each repeated floor(rate) times, and once more with the chance of the remainder, by a seeded hash of the row."""
    luck = F.pmod(F.xxhash64(F.lit(seed), F.col("row_key")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")
