"""Mixing sources to target weights through soft membership. DataFrame operations only.

A classifier fitted on a labelled table gives every document posteriors over the domains. Rates (how often each document
is to be used) are fitted by projected gradient steps so that the expected tokens of each domain match the targets:
minimise ``(s - t)' M (s - t) / 2`` over rates ``r >= least``, where ``s_d = sum_i r_i * tokens_i * p_id``. In the variables
``sqrt(tokens_i) * r_i`` the gradient of a document is its posteriors times ``M (s - t)``, so a step is one D-vector for all
documents; ``M`` is the inverse of the domains' Gram matrix. A second direction takes that of the documents above their bound
alone. One pass over the compact table of tokens and posteriors tries several lengths of both directions and gives each
trial's D sums and Gram matrix; the trial of the least objective is the next step. A document's rate is replayed from the
list of the steps' vectors.

Classifier: naive Bayes on the presence of marks, which are words chosen by their log odds between domains on a bounded
sample of labelled rows, and the text's symbol, capital and repetition levels. Marks go together, which makes naive Bayes too
sure. So its logits are scaled and shifted on a part of the sample that the counts leave out: by the factor of the least log
loss, each with the shifts at which the domains' expected tokens are those of the labels there. Targets that too sure posteriors
seem to meet may then be out of reach; they are met as nearly as can be, with a warning, and what is expected is what comes.

Defined cases: null text is empty, has 0 tokens and the posteriors of its marks; null labels are not used; with no labelled
rows every document has rate 1 and equal posteriors; repeated rows get rates of their own; of rows with one labelled id the
first text in code-point order is learned from; ids are whole numbers (others are refused). Extra columns stay. Targets that
no rates can meet are met as closely as the objective says; a fit that misses its targets by more than ``MISS`` warns.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, whole_number, written

#: Bound of the labelled rows that the classifier is fitted on (a hash of the id picks about as many).
LABELLED_ROWS = 4000
#: Words chosen for each domain, and the least share of a domain's rows that has one.
WORDS_PER_DOMAIN, LEAST_SHARE = 24, 0.01
ITERATIONS, TOLERANCE = 25, 1e-6
#: Lengths tried of a step by the documents above their bound, and by all.
LENGTHS_FREE, LENGTHS_ALL = (0.25, 1.0), (1.0, 8.0, 64.0)
#: Share of all tokens by which a domain may miss its target without a warning.
MISS = 1e-3
PRIOR = 1.0
#: Share of the labelled sample that calibrates, one in so many rows; turns in which its shifts settle; factors of the logits that are tried.
HELD, TURNS = 3, 60
SCALES = (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)


def _levels(name: str, value: Column, cuts: tuple[float, ...]) -> Column:
    out = F.lit(f"#{name}0")
    for k, c in enumerate(cuts, 1):
        out = F.when(value > c, F.lit(f"#{name}{k}")).otherwise(out)
    return out


_WHITE = " \t\n\x0b\x0c\r"


def with_marks(df: DataFrame, text: Column, words: str, levels: str, tokens: str) -> DataFrame:
    """Adds the distinct words of a text, its levels, and its number of words (runs without space, tab, LF, VT, FF, CR).

    Step by step, so that each costly expression stands in a projection of its own and is evaluated once.
    """
    w = unused(df, "_words")
    bare = F.btrim(F.lower(text), F.lit(_WHITE))
    df = df.withColumn(w, F.when(F.length(bare) > 0, F.split(bare, r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>")))
    df = df.withColumns({words: F.array_distinct(w), tokens: F.size(w).cast("long")}).drop(w)
    size = F.greatest(F.length(text), F.lit(1))
    symbols, capitals, repeats = (unused(df, f"_{k}") for k in ("symbols", "capitals", "repeats"))
    df = df.withColumns({symbols: F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / size, capitals: F.regexp_count(text, F.lit("[A-Z]")) / size, repeats: 1 - F.size(words) / F.greatest(F.col(tokens), F.lit(1))})
    told = F.array(_levels("symbols", F.col(symbols), (0.005, 0.03, 0.1)), _levels("capitals", F.col(capitals), (0.06, 0.3, 0.6)), _levels("repeats", F.col(repeats), (0.4, 0.6, 0.8)))
    return df.withColumn(levels, told).drop(symbols, capitals, repeats)


class Classifier:
    """``scale * (base[d] + sum of weights[mark][d]) + shift[d]`` over the marks of a text, then a softmax."""

    def __init__(self, domains: list[str], base: list[float], weights: dict[str, list[float]], scale: float = 1.0, shift: list[float] | None = None) -> None:
        self.domains, self.base, self.weights, self.scale = domains, base, weights, scale
        self.shift = shift or [0.0] * len(domains)

    def with_logits(self, df: DataFrame, marks: str, names: list[str]) -> DataFrame:
        """Adds a column for each domain, unscaled."""
        sums = [reduce(lambda a, b: a + b, [F.when(F.array_contains(marks, x), F.lit(float(w[k]))).otherwise(F.lit(0.0)) for x, w in self.weights.items()], F.lit(float(b))) for k, b in enumerate(self.base)]
        return df.withColumns(dict(zip(names, sums, strict=True)))

    def apply(self, df: DataFrame, text_col: str, posteriors: str, tokens: str) -> DataFrame:
        """Adds the words of a text and an array with a probability for each domain."""
        m, v, h, e = unused(df, "_marks"), unused(df, "_levels"), unused(df, "_hits"), unused(df, "_exp")
        df = with_marks(df, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), m, v, tokens)
        known = F.array(*[F.lit(x) for x in self.weights]) if self.weights else F.array().cast("array<string>")
        df = df.withColumn(h, F.concat(F.array_intersect(m, known), F.col(v))).drop(m, v)
        names = [f"{e}{k}" for k in range(len(self.domains))]
        df = self.with_logits(df, h, names).drop(h)
        df = df.withColumns({n: self.scale * F.col(n) + b for n, b in zip(names, self.shift, strict=True)})
        most = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        df = df.withColumns({f"{n}e": F.exp(F.col(n) - most) for n in names})
        total = reduce(lambda a, b: a + b, [F.col(f"{n}e") for n in names])
        return df.withColumn(posteriors, F.array(*[F.col(f"{n}e") / total for n in names])).drop(*names, *[f"{n}e" for n in names])

    def calibrated(self, rows: DataFrame) -> Classifier:
        """Scaled and shifted by labelled rows ``m`` (marks), ``d`` (domain), ``n`` (tokens), which are as few as the labelled sample."""
        names = [f"z{k}" for k in range(len(self.domains))]
        told = self.with_logits(rows, "m", names).select("d", "n", *names).collect()
        seen = [([r[n] for n in names], self.domains.index(r["d"]), max(1, r["n"])) for r in told]
        if not seen:
            return self
        tokens = [sum(w for _, d, w in seen if d == k) + PRIOR for k in range(len(names))]
        loss, scale, shift = min(_calibration(seen, tokens, s) for s in SCALES)
        return Classifier(self.domains, self.base, self.weights, scale, shift)


def _calibration(seen: list[tuple[list[float], int, int]], tokens: list[float], scale: float) -> tuple[float, float, list[float]]:
    """For one factor the log loss a token, and the shifts that make the expected tokens of each domain those seen."""
    shift = [0.0] * len(tokens)
    for turn in range(TURNS + 1):
        expected, loss = [PRIOR] * len(tokens), 0.0
        for z, own, w in seen:
            x = [scale * a + b for a, b in zip(z, shift, strict=True)]
            most = max(x)
            e = [math.exp(a - most) for a in x]
            total = sum(e)
            loss -= w * (x[own] - most - math.log(total))
            for k, a in enumerate(e):
                expected[k] += w * a / total
        if turn < TURNS:
            shift = [b + math.log(t / a) for b, t, a in zip(shift, tokens, expected, strict=True)]
    return loss / sum(w for *_, w in seen), scale, shift


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", bound: int = LABELLED_ROWS, calibrate: bool = True) -> Classifier:
    """Fits on about ``bound`` rows of ``labelled`` (id, domain); only counts of marks by domain reach the driver, and the logits of the rows that calibrate."""
    rows = labelled.select(whole_number(labelled, id_col).alias("i"), F.col(f"`{domain_col}`").cast("string").alias("d")).filter(F.col("i").isNotNull() & F.col("d").isin(domains)).distinct()
    n = rows.count()
    if not n:
        return Classifier(domains, [0.0] * len(domains), {})
    share = min(1.0, bound / n)
    picked = rows.filter(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # About ``bound`` distinct ids (16 bytes a row) are broadcast; one text of each is kept.
    texts = docs.select(whole_number(docs, id_col).alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")).join(F.broadcast(picked), "i")
    texts = texts.groupBy("i", "d").agg(F.min("t").alias("t"))
    every = written(with_marks(texts, F.col("t"), "w", "v", "n").select("d", "n", F.concat("w", "v").alias("m"), (F.pmod(F.xxhash64("i", F.lit(3)), F.lit(HELD)) == 0).alias("held")), "labelled")
    seen = every.filter("not held") if calibrate else every
    totals = {r["d"]: r["n"] for r in seen.groupBy("d").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Classifier(domains, [0.0] * len(domains), {})
    counts = seen.select("d", F.explode("m").alias("mark")).groupBy("mark").agg(*[F.sum((F.col("d") == d).cast("int")).alias(f"n{k}") for k, d in enumerate(domains)])
    rate = [(F.col(f"n{k}") + PRIOR) / (totals.get(d, 0) + 2 * PRIOR) for k, d in enumerate(domains)]
    odds = [F.log(r / (1 - r)) for r in rate]
    chosen: dict[str, list[float]] = {}
    for k, d in enumerate(domains):
        others = [o for j, o in enumerate(odds) if j != k]
        gap = F.abs(odds[k] - reduce(lambda a, b: a + b, others) / len(others)) * F.sqrt(rate[k]) if others else F.lit(0.0)
        frequent = F.col(f"n{k}") >= LEAST_SHARE * totals.get(d, 0)
        top = counts.filter(frequent | F.col("mark").startswith("#")).withColumn("gap", gap).orderBy(F.desc("gap"), "mark").limit(WORDS_PER_DOMAIN).select("mark", *[r.alias(f"r{j}") for j, r in enumerate(rate)]).collect()
        for r in top:
            chosen[r["mark"]] = [r[f"r{j}"] for j in range(len(domains))]
    base = [math.log((totals.get(d, 0) + PRIOR) / (sum(totals.values()) + PRIOR * len(domains))) + sum(math.log(1 - p[k]) for p in chosen.values()) for k, d in enumerate(domains)]
    model = Classifier(domains, base, {m: [math.log(q / (1 - q)) for q in p] for m, p in sorted(chosen.items())})
    return model.calibrated(every.filter("held")) if calibrate else model


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Inverse of a small positive definite matrix (Gauss-Jordan)."""
    n = len(m)
    a = [row[:] + [float(i == j) for j in range(n)] for i, row in enumerate(m)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(a[r][c]))
        a[c], a[p] = a[p], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(n):
            if r != c and a[r][c]:
                a[r] = [x - a[r][c] * y for x, y in zip(a[r], a[c], strict=True)]
    return [row[n:] for row in a]


def moved(rate: Column, p: Column, step: list[float], least: float) -> Column:
    return F.greatest(F.lit(float(least)), rate - reduce(lambda a, b: a + b, [p[k] * F.lit(float(x)) for k, x in enumerate(step)]))


def rate_of(p: Column, steps: list[list[float]], least: float) -> Column:
    """The rate after all steps, each projected to ``least`` or more."""
    if not steps:
        return F.lit(max(1.0, least))
    rate = F.lit(1.0)
    for step in steps:
        rate = moved(rate, p, step, least)
    return rate


def solve(table: DataFrame, n_domains: int, targets: dict[int, float] | None, multipliers: list[float] | None = None, least: float = 0.0) -> tuple[list[list[float]], list[float], float]:
    """Steps, targets and the greatest miss (a share of all tokens) for a table of ``tokens`` and posteriors ``p``; one pass over it a step.

    ``targets`` are shares of the tokens in all; ``multipliers`` instead are factors on each domain's own tokens. The total
    stays, unless ``least`` is 1 or more: then nothing is given up, and the total grows to the least one for which the rates
    that meet the shares (1 plus a sum of the posteriors with weights of at least 0) exist. Without one all rates stay.
    """
    d = range(n_domains)
    part = [F.col("p")[k] for k in d]
    pairs = [(j, k) for j in d for k in d if j <= k]

    def sums(trials: list[list[float]]) -> list[tuple[list[float], list[list[float]]]]:
        """For each trial of a next step the domains' tokens and the Gram matrix of the documents above their bound."""
        names = [f"r{i}" for i in range(len(trials))]
        rows = table.select("tokens", "p", rate_of(F.col("p"), steps, least).alias("r")).select("tokens", "p", *[moved(F.col("r"), F.col("p"), t, least).alias(n) for t, n in zip(trials, names, strict=True)])
        told = [F.sum(F.col("tokens") * F.col(n) * part[k]).alias(f"{n}s{k}") for n in names for k in d]
        told += [F.sum(F.when(F.col(n) > least, F.col("tokens") * part[j] * part[k]).otherwise(0.0)).alias(f"{n}g{j}_{k}") for n in names for j, k in pairs]
        got = rows.agg(*told).first()
        value = lambda c: got[c] or 0.0
        return [([value(f"{n}s{k}") for k in d], [[value(f"{n}g{min(j, k)}_{max(j, k)}") for k in d] for j in d]) for n in names]

    first = table.agg(*[F.coalesce(F.sum(F.col("tokens") * part[k]), F.lit(0.0)).alias(f"s{k}") for k in d], *[F.coalesce(F.sum(F.col("tokens") * part[j] * part[k]), F.lit(0.0)).alias(f"g{j}_{k}") for j, k in pairs]).first()
    now = [first[f"s{k}"] for k in d]
    total = sum(now)
    goal = [now[k] * multipliers[k] for k in d] if multipliers else [total * targets[k] / sum(targets.values()) for k in d]
    if not total:
        return [], goal, 0.0
    whole = [[first[f"g{min(j, k)}_{max(j, k)}"] for k in d] for j in d]
    ridged = lambda gram: [[gram[j][k] + (1e-9 * total if j == k else 0) for k in d] for j in d]
    inverse = _inverse(ridged(whole))
    steps: list[list[float]] = []
    if targets and not multipliers and least >= 1:
        shares = [x / total for x in goal]
        a, b = ([sum(inverse[k][j] * x[j] for j in d) for k in d] for x in (now, shares))
        if min(now) <= 1e-6 * total:
            return [], goal, max(abs(x / total - y) for x, y in zip(now, shares, strict=True))
        # Where no rates of the form 1 plus a sum of the posteriors meet the shares, the total stays and they are met as nearly as can be.
        grown = max(x / y for x, y in zip(a, b, strict=True)) if min(b) > 0 else total
        goal = [grown * x for x in shares]
        total = grown
    free = whole

    def objective(got: list[float]) -> float:
        miss = [x - y for x, y in zip(got, goal, strict=True)]
        return sum(miss[j] * inverse[j][k] * miss[k] for j in d for k in d)

    for _ in range(ITERATIONS):
        miss = [a - b for a, b in zip(now, goal, strict=True)]
        if max(map(abs, miss)) <= TOLERANCE * total:
            break
        trials = []
        for lengths, m in ((LENGTHS_FREE, _inverse(ridged(free))), (LENGTHS_ALL, inverse)):
            along = [sum(m[j][k] * miss[k] for k in d) for j in d]
            trials += [[length * x for x in along] for length in lengths]
        got = sums(trials)
        best = min(range(len(trials)), key=lambda i: objective(got[i][0]))
        if objective(got[best][0]) >= objective(now):
            break
        steps.append(trials[best])
        now, free = got[best]
    return steps, goal, max(abs(a - b) for a, b in zip(now, goal, strict=True)) / total


def mix(docs: DataFrame, labelled: DataFrame, domains: list[str], targets: dict[str, float] | None = None, multipliers: dict[str, float] | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, calibrate: bool = True) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``n_tokens``, ``posteriors`` (in the order of ``domains``) and ``rate``.

    The posteriors are computed once and written with those columns; the fit reads two of the table's columns, and no
    text is shuffled.
    """
    model = fit(docs, labelled, domains, id_col, text_col, calibrate=calibrate)
    p, n = unused(docs, "_p"), unused(docs, "_n")
    kept = docs.columns if columns is None else columns
    known = written(model.apply(docs, text_col, p, n).select(*[F.col(f"`{c}`") for c in kept], n, p), "posteriors")
    table = known.select(F.col(n).alias("tokens"), F.col(p).alias("p"))
    steps, _, miss = solve(table, len(domains), {k: (targets or {}).get(d, 0.0) for k, d in enumerate(domains)}, [multipliers.get(d, 1.0) for d in domains] if multipliers else None, least)
    if miss > MISS and (targets or multipliers):
        warnings.warn(f"The rates miss their targets by {miss:.2%} of all tokens", stacklevel=2)
    made = {"n_tokens": F.col(n), "posteriors": F.col(p), "rate": rate_of(F.col(p), steps, least)}
    return known.select(*[F.col(f"`{c}`") for c in kept if c.lower() not in made], *[c.alias(k) for k, c in made.items()])


def shares(rated: DataFrame, domains: list[str]) -> dict[str, float]:
    """The domains' shares of the expected tokens of ``mix``'s result; empty without tokens."""
    got = rated.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col("posteriors")[k]).alias(f"s{k}") for k in range(len(domains))]).first()
    total = sum(x or 0.0 for x in got)
    return {d: got[k] / total for k, d in enumerate(domains)} if total else {}


def repeated(mixed: DataFrame, rate: Column, id_col: str, columns: list[str]) -> DataFrame:
    """Each row as often as its rate says: the whole part, and once more where a hash of the id falls below the rest."""
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(rate + draw).cast("int")
    tmp = unused(mixed, "_times")
    return mixed.withColumn(tmp, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*[F.col(f"`{c}`") for c in columns])


#: Domains that the labels table tells, and the target shares of the registered query.
DOMAINS = ["good", "low", "toxic"]
TARGETS = {"good": 0.85, "low": 0.1, "toxic": 0.05}


def domains_of(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labels table; rows with a null in either label are left out."""
    toxic, quality = F.col("toxic"), F.col("quality")
    domain = F.when(toxic.isNull() | quality.isNull(), None).when(toxic == 1, "toxic").when(quality == 0, "low").otherwise("good")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")
