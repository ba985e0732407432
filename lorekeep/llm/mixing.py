"""Mixing sources to target weights: soft memberships and nonnegative document rates.

Built-in Spark functions only; the driver sees vectors with one number for
each domain, and the evidence of at most a third of the labelled sample. A naive
Bayes classifier over hashed words, fitted on two thirds of at most `per_domain`
labelled rows of each domain, gives every document evidence for each domain;
multinomial logistic calibration on the other third (one slope, one offset a
domain, weighted to the domains' true shares) turns it into posteriors. Terms
are the distinct words of the whole text and three shape terms: its shares of
capitals, of symbols and of different words, each in steps. Only terms whose
frequency differs clearly between the domains count.

The expected tokens of a domain are the sum of rate x tokens x posterior.
Least squares moves all rates from 1 until these totals match the targets (with
a slight pull back to 1). It is not plain projected gradient over the rates: that
was built and took 199 rounds, a job each, for targets that this form meets in a
few. A document's gradient is its posterior times the domains' residuals, so all
steps are one vector over the domains; a document's rate is 1 less its posterior
times that vector, projected to 0 to MOST. The vector moves by damped Newton steps
on the dual: the residuals, scaled by the second moments of the posteriors whose
rates can move, and cut until the dual loss falls. So the state is a few numbers
and no round writes a table. It ends when no step is left: then the totals are
within TOLERANCE of the targets, or no nonnegative rates come closer with these
memberships. What is reached is returned.

Defined cases: a null or empty text has no tokens, the prior as posterior and
rate 1 at first like others; a missing domain (no labelled rows) has posterior
0 and its target is spread over the rest; with no tokens at all rates stay 1;
labels that are null or repeat count once by their greatest domain; rows that
repeat are each rated. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .columns import whole_rows, words

N_BUCKETS = 16384
#: Terms count whose log odds are at least so many standard errors from 0.
CLEAR = 3.0
#: No document is drawn more often.
MOST = 4.0
#: Shares may differ so much from their targets.
TOLERANCE = 1e-4
#: Weight of the rates' squared distance from 1 beside that of the totals from their targets.
PULL = 1e-6
#: Target share of the tokens of each domain.
TARGETS = {"good": 0.85, "low": 0.13, "toxic": 0.02}
#: Tokens of the kept domain that are asked for, over those that there are.
HEADROOM = 1.1


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The domain that a labelled row names."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "low")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(N_BUCKETS)).cast("int")


def _with_terms(df: DataFrame, text: str, tokens: str = "tokens", terms: str = "terms") -> DataFrame:
    """df with its number of words and the distinct buckets of its terms."""
    held = df.withColumn("every", F.transform(words(text), _bucket)).withColumn("different", F.array_distinct("every"))
    n = F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(1))

    def step(name: str, share: Column) -> Column:
        return _bucket(F.concat(F.lit(f"\0{name}"), F.floor(F.sqrt(share) * 10).cast("string")))

    capitals = F.coalesce(F.regexp_count(F.col(text), F.lit(r"\p{Lu}")), F.lit(0)) / n
    symbols = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[!#$%&*+/<=>?@\\^_|~]")), F.lit(0)) / n
    different = F.size("different") / F.greatest(F.size("every"), F.lit(1))
    shape = F.array(step("capitals", capitals), step("symbols", symbols), step("different", different * different))
    return held.withColumn(tokens, F.size("every").cast("long")).withColumn(terms, F.array_union("different", shape)).drop("every", "different")


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small system by elimination."""
    rows = [[*m, r] for m, r in zip(matrix, right)]
    for i in range(len(rows)):
        top = max(range(i, len(rows)), key=lambda j: abs(rows[j][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for j in range(len(rows)):
            if j != i and rows[i][i]:
                times = rows[j][i] / rows[i][i]
                rows[j] = [x - times * y for x, y in zip(rows[j], rows[i])]
    return [r[-1] / r[i] if r[i] else 0.0 for i, r in enumerate(rows)]


@dataclass
class Classifier:
    """weights: for each domain, the log odds of each bucket against the mean of all domains; a domain's score is slope x
    evidence + offset (None if the domain is unseen)."""

    domains: list[str]
    weights: list[list[float]]
    slope: float
    offsets: list[float | None]


def _posteriors(z: list[float]) -> list[float]:
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def calibrated(rows: list[tuple[int, list[float]]], shares: list[float], rounds: int = 50) -> tuple[float, list[float]]:
    """(slope, offsets) of rows(domain, evidence for each domain) by Newton steps on the log loss, each domain weighted to
    its share; evidence without effect has slope 0."""
    k = len(shares)
    counts = [sum(d == i for d, _ in rows) for i in range(k)]
    of = [s / c if c else 0.0 for s, c in zip(shares, counts)]
    params = [0.5, *[math.log(s / shares[0]) for s in shares[1:]]]

    def scores(q: list[float], e: list[float]) -> list[float]:
        return [q[0] * e[0], *[q[0] * x + c for x, c in zip(e[1:], q[1:])]]

    def loss(q: list[float]) -> float:
        return sum(-of[d] * math.log(max(_posteriors(scores(q, e))[d], 1e-300)) for d, e in rows) + 1e-3 * sum(x * x for x in q[1:])

    now = loss(params)
    for _ in range(rounds):
        gradient, hessian = [2e-3 * (i > 0) * x for i, x in enumerate(params)], [[(2e-3 if i else 1e-9) * (i == j) for j in range(k)] for i in range(k)]
        for d, e in rows:
            p = _posteriors(scores(params, e))
            features = [[e[i], *[float(i == j) for j in range(1, k)]] for i in range(k)]
            mean = [sum(p[i] * features[i][j] for i in range(k)) for j in range(k)]
            for a in range(k):
                gradient[a] += of[d] * (mean[a] - features[d][a])
                for b in range(k):
                    hessian[a][b] += of[d] * sum(p[i] * (features[i][a] - mean[a]) * (features[i][b] - mean[b]) for i in range(k))
        step, size = _solved(hessian, gradient), 1.0
        while size > 1e-6 and loss(trial := [max(x - size * y, 0.0) if i == 0 else x - size * y for i, (x, y) in enumerate(zip(params, step))]) > now:
            size /= 2
        if size <= 1e-6 or now - loss(trial) < 1e-9:
            break
        params, now = trial, loss(trial)
    return params[0], [0.0, *params[1:]]


def _evidence(buckets: str, weights: list[float]) -> Column:
    """The sum of the weights of the buckets."""
    table = F.split(F.lit(",".join(f"{x:.6g}" if x else "0" for x in weights)), ",").cast("array<double>")  # a constant of N_BUCKETS numbers
    return F.aggregate(buckets, F.lit(0.0), lambda a, x: a + F.element_at(table, x + 1))


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], per_domain: int = 1500, text: str = "text") -> Classifier:
    """Naive Bayes over the distinct hashed words of at most per_domain labelled documents of each domain, and its calibration."""
    named = labels.select("doc_id", domain_of().alias("domain")).where("domain is not null and doc_id is not null")
    named = named.groupBy("doc_id").agg(F.max("domain").alias("domain")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = None
    for d in domains:
        part = named.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        ids = part if ids is None else ids.union(part)
    ids = saved(ids, "mix-sample")
    sample = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    third = (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0).alias("third")
    # saved before it is exploded: Spark would else test the size of every document's terms before the join with the sample
    sample = saved(_with_terms(sample, "text").select("domain", "terms", third), "mix-terms")
    taught = sample.where("not third")
    counts = taught.select("domain", F.explode("terms").alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()  # at most N_BUCKETS rows for each domain
    sizes = {r["domain"]: r["n"] for r in taught.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    shares = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.get(d, 0) for d in domains)
    table = {d: [0] * N_BUCKETS for d in domains}
    for r in counts:
        table[r["domain"]][r["bucket"]] = r["n"]
    seen = [d for d in domains if shares.get(d)]
    weights = []
    for d in domains:
        n, rest, own = sizes.get(d, 0), sum(sizes.get(e, 0) for e in seen if e != d), [0.0] * N_BUCKETS
        for b in range(N_BUCKETS) if n and rest else ():
            x, y = table[d][b] + 0.5, sum(table[e][b] for e in seen if e != d) + 0.5
            odds = math.log(x / (n + 1)) - math.log(y / (rest + 1))
            own[b] = odds if abs(odds) >= CLEAR * math.sqrt(1 / x + 1 / y) else 0.0
        weights.append(own)
    if not seen:
        return Classifier(domains, weights, 0.0, [None] * len(domains))
    shown = sample.where("third").select("domain", F.array(*[_evidence("terms", weights[domains.index(d)]) for d in seen]).alias("e")).collect()  # bounded by the sample
    slope, offsets = calibrated([(seen.index(r["domain"]), list(r["e"])) for r in shown], [shares[d] / total for d in seen])
    return Classifier(domains, weights, slope, [offsets[seen.index(d)] if d in seen else None for d in domains])


def with_members(df: DataFrame, model: Classifier, text: str = "text", tokens: str = "tokens", p: str = "p") -> DataFrame:
    """df with its number of words and its posteriors, in the order of the model's domains."""
    k = len(model.domains)
    if all(x is None for x in model.offsets):
        return df.withColumn(tokens, F.size(words(text)).cast("long")).withColumn(p, F.array(*[F.lit(1.0 / k)] * k))
    held = _with_terms(df, text, tokens, "buckets")
    base = next(own for own, offset in zip(model.weights, model.offsets) if offset is not None)
    z, first = [], True
    for offset, own in zip(model.offsets, model.weights):  # against the first domain, so that one sum less is needed
        z.append(F.lit(None).cast("double") if offset is None else F.lit(offset) if first else F.lit(offset) + model.slope * _evidence("buckets", [x - y for x, y in zip(own, base)]))
        first = first and offset is None
    held = held.withColumn("z", F.array(*z))
    held = held.withColumn("e", F.transform("z", lambda x: F.coalesce(F.exp(x - F.array_max("z")), F.lit(0.0))))
    held = held.withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return held.withColumn(p, F.transform("e", lambda x: x / F.col("sum"))).drop("buckets", "z", "e", "sum")


@dataclass
class Fit:
    """moved: the accumulated steps, a vector over the domains; targets and reached: shares of the budget; settled: no
    step is left (the targets are met, or cannot be met more closely)."""

    moved: list[float]
    targets: list[float]
    reached: list[float]
    settled: bool


def _vector(values: list[float]) -> Column:
    """A constant array; as one object, so that rounds with other values share their compiled code."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


def _along(moved: list[float], p: str = "p") -> Column:
    return F.aggregate(F.zip_with(p, _vector(moved), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def _rate(moved: list[float], p: str = "p") -> Column:
    """1 less the posteriors times the accumulated steps, projected to 0 to MOST."""
    return F.least(F.lit(MOST), F.greatest(F.lit(0.0), 1 - _along(moved, p)))


def rates(members: DataFrame, targets: list[float], budget: float | None = None, rounds: int = 200) -> tuple[DataFrame, Fit]:
    """members with `rate`, and the fit; targets are shares of budget (all tokens, if not given) for each domain of p."""
    k, p = len(targets), [F.get("p", i) for i in range(len(targets))]
    first = members.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * x).alias(f"t{i}") for i, x in enumerate(p)]).first()
    n = float(first["n"] or 0)
    if n == 0:
        return members.withColumn("rate", F.lit(1.0)), Fit([0.0] * k, targets, targets, True)
    present = [(first[f"t{i}"] or 0.0) > 0 for i in range(k)]
    whole, scale = sum(t for t, here in zip(targets, present) if here) or 1.0, (budget or n) / n
    goal = [t / whole * scale if here else 0.0 for t, here in zip(targets, present)]

    def measured(moved: list[float]) -> tuple[float, list[float], list[list[float]]]:
        """The least-squares dual, the totals, and the second moments of the posteriors whose rates may move."""
        rows = members.select("tokens", "p", (1 - _along(moved)).alias("bare")).withColumn("r", F.least(F.lit(MOST), F.greatest(F.lit(0.0), F.col("bare"))))
        t, free = F.col("tokens") / n, (F.col("bare") > 0) & (F.col("bare") < MOST)
        sums = [F.sum(t * F.col("r") * x).alias(f"t{i}") for i, x in enumerate(p)]
        moments = [F.sum(F.when(free, t * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
        out = rows.agg(*sums, *moments, F.sum(t * F.col("r") * (F.col("bare") - F.col("r") / 2)).alias("dual")).first()
        dual = out["dual"] + sum(g * x for g, x in zip(goal, moved)) + PULL / 2 * sum(x * x for x in moved)
        return dual, [out[f"t{i}"] for i in range(k)], [[out[f"g{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]

    moved, settled = [0.0] * k, False
    dual, totals, moments = measured(moved)
    for _ in range(rounds):
        gradient = [t - g - PULL * x for t, g, x in zip(totals, goal, moved)]
        if max(map(abs, gradient)) <= TOLERANCE * scale:
            settled = True
            break
        step, size = _solved([[x + (PULL + 1e-12) * (i == j) for j, x in enumerate(row)] for i, row in enumerate(moments)], gradient), 1.0
        while size > 1e-12:  # where few rates can move, steps are long: the dual falls at last along each, unless it is least
            trial = [x + size * y for x, y in zip(moved, step)]
            after = measured(trial)
            if after[0] < dual:
                break
            size /= 4
        else:
            break
        moved, (dual, totals, moments) = trial, after
    else:
        raise RuntimeError(f"rates have not settled after {rounds} rounds")
    return members.withColumn("rate", _rate(moved)), Fit(moved, [g / scale for g in goal], [t / scale for t in totals], settled)


def op3_mixing(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain> for each domain, rate (how often the document is to be drawn in expectation), and, the
    same in every row, reached_<domain>: the share of the tokens that these rates give the domain."""
    targets = targets or TARGETS
    model = fit(docs, labels, list(targets))
    members = saved(with_members(docs.select("doc_id", "text"), model).select("doc_id", "tokens", "p"), "mix-members")
    rated, found = rates(members, list(targets.values()))
    return rated.select(
        "doc_id", "tokens", *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(targets)], "rate", *[F.lit(float(x)).alias(f"reached_{d}") for d, x in zip(targets, found.reached)]
    )


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep: str, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says: its whole part, and once more if a hash of
    (doc_id, text) falls below its fraction, so at most MOST times. The budget asks for HEADROOM times the tokens of
    domain `keep`."""
    names = list(targets)
    model = fit(docs, labels, names, text=text)
    own = with_members(docs.select("doc_id", F.col(text).alias("text")), model).select("doc_id", "tokens", "p")
    own = saved(own, "mix-members")
    kept = own.agg(F.sum(F.col("tokens") * F.get("p", names.index(keep)))).first()[0] or 0.0
    budget = HEADROOM * kept * sum(targets.values()) / targets[keep] if kept else None
    _, found = rates(own, list(targets.values()), budget)
    rows = whole_rows(docs).withColumn("text", F.col(f"row.`{text}`"))
    draw = F.pmod(F.xxhash64("row.doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    rated = with_members(rows, model).withColumn("times", F.floor(_rate(found.moved) + draw).cast("int"))
    # no filter on the computed number: it would be pushed below and evaluate the memberships once more for each use
    return rated.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
