"""Mixing: fractional document rates whose expected domain token totals match target weights.

A labelled table names the domain of some documents. A naive Bayes classifier is counted from the labelled rows and gives
every document posteriors over the domains (soft membership). What it looks at is not made for any domain: the share
of a text's words that are distinct, its shares of capital letters and of signs, each in bins, and whether it holds a
word of a lexicon, the words whose document frequency marks a domain; what a bin or the lexicon says is learned. Then
nonnegative rates r are fitted by least squares,

    minimise  1/2 | sum_i r_i t_i p_i - T |^2  over  r >= 0,   from r = 1,

where t_i are a document's tokens, p_i its posteriors and T the target totals. The gradient by r_i, per token, is p_i . g
with g the miss of the domains' totals, so a step of the projected gradient is r_i <- max(0, r_i - p_i . s) with one
number per domain: g, scaled by the inverse second moment of the posteriors of the rows not at zero. Every iterate is
projected, and the rates are the fold of all steps so far over a row's posteriors; rows with equal posteriors have
equal rates. An iteration is one aggregation over (tokens, posteriors) for the miss and the moments and one that tries
some lengths of the step, plain gradient steps among them; both return a few sums to the driver. It ends when every
domain's miss is within ``tolerance`` of its target or no length lowers the sum of squares any more; the totals reached
are returned, and ``mix`` shows their shares.

Only DataFrame expressions touch rows. No shuffle carries text. The labelled word counts that pick the lexicon
features come from a bounded sample of labelled rows (``lexicon_rows``); every other count is over all rows.

Defined results: null or empty texts have zero tokens and posteriors from their features; a null id is a row
like any other; repeated rows each get a rate; equal rows get equal rates; without labelled rows the
posteriors are uniform; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._base import table

DOMAINS = ("clean", "junk", "toxic")
#: Shares of the expected tokens of the mixture.
TARGETS = {"clean": 0.98, "junk": 0.01, "toxic": 0.01}
LEXICON_ROWS = 20_000
LEXICON_WORDS = 48
ROUNDS = 40
#: Miss of a domain's total, as a share of its target, at which the fit ends.
TOLERANCE = 1e-4
#: Lengths of a scaled, and of a plain, gradient step that are tried at once.
LENGTHS = (3.0, 1.0, 0.5, 0.2, 0.05)
PLAIN = (1.0, 0.25)


#: Edges of the bins of shares of characters; shares of distinct words are in tenths.
EDGES = (1e-9, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4)
TENTHS = 10


def word_list(text: Column) -> Column:
    """Words between blanks and line breaks."""
    return F.array_remove(F.split(text, r"[ \t\r\n]+"), "")


def lexicon(docs: DataFrame, labelled: DataFrame, domain: str, rows: int = LEXICON_ROWS, words: int = LEXICON_WORDS) -> list[str]:
    """Words that mark ``domain``: by log-odds of document frequency in a bounded sample of labelled rows."""
    sample = labelled.orderBy(F.xxhash64("id"), "id").limit(rows)
    # At most `rows` ids and domains are broadcast.
    texts = docs.join(F.broadcast(sample), "id").select((F.col("domain") == domain).cast("int").alias("is"), F.array_distinct(F.split(F.lower("body"), r"[^\p{L}]+")).alias("ws"))
    sizes = texts.agg(F.coalesce(F.sum("is"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("n")).first()
    a, b = sizes["a"], sizes["n"] - sizes["a"]
    if not a or not b:
        return []
    # Not `explode`: the filter on the array's size that Catalyst infers for it would be pushed below the join,
    # and split the text of every document.
    counts = texts.select("is", F.explode_outer("ws").alias("w")).where(F.length("w") >= 3).groupBy("w").agg(F.sum("is").alias("inside"), F.count(F.lit(1)).alias("seen"))
    odds = F.log((F.col("inside") + 0.5) / (a + 1.0)) - F.log((F.col("seen") - F.col("inside") + 0.5) / (b + 1.0))
    marked = counts.where((F.col("inside") >= max(5, a // 100)) & (odds >= math.log(8.0)))
    return [r["w"] for r in marked.orderBy(odds.desc(), "w").limit(words).collect()]


def sized(rows: DataFrame) -> DataFrame:
    """``rows`` (with body) and tokens, distinct: the number of words and of different ones."""
    named = rows.select("*", F.inline(F.array(F.struct(word_list(F.col("body")).alias("words")))))
    return named.select(*rows.columns, F.size("words").cast("bigint").alias("tokens"), F.size(F.array_distinct("words")).alias("distinct"))


def features(text: Column, words: Sequence[str]) -> list[tuple[Column, int]]:
    """Features of a text and the number of their bins; the columns tokens and distinct stand beside it."""
    binned = lambda share: sum(((share >= e).cast("int") for e in EDGES[1:]), (share >= EDGES[0]).cast("int"))
    # One pass drops what is neither a capital letter nor a sign; the counts are of the little that is left.
    rest = F.regexp_replace(text, r"[a-z0-9\s\u0080-\x{10FFFF}]+", "")
    capitals, n = F.length(F.regexp_replace(rest, r"[^A-Z]+", "")), F.greatest(F.length(text), F.lit(1))
    out = [
        (F.least(F.lit(TENTHS - 1), F.floor(F.col("distinct") * (TENTHS - 0.01) / F.greatest("tokens", F.lit(1)))).cast("int"), TENTHS),
        (binned(capitals / n), len(EDGES) + 1),
        (binned((F.length(rest) - capitals) / n), len(EDGES) + 1),
    ]
    if words:
        # Plain substrings first: the expression with word borders then runs on the few texts that hold one.
        low = F.lower(text)
        held = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            held = held | F.contains(low, F.lit(w))
        out.append(((held & low.rlike(r"(?<!\p{L})(" + "|".join(re.escape(w) for w in words) + r")(?!\p{L})")).cast("int"), 2))
    return out


@dataclass
class Classifier:
    """Naive Bayes tables: for each domain the log of its prior, and of each bin of each feature."""

    domains: list[str]
    words: list[str]
    prior: list[float]
    tables: list[list[list[float]]]

    def flags(self, body: Column) -> list[Column]:
        return [c for c, _ in features(body, self.words)]

    def logs(self, flags: Sequence[Column]) -> list[Column]:
        """Unnormalised log posteriors, given bins."""
        out = []
        for prior, tables in zip(self.prior, self.tables, strict=True):
            x = F.lit(prior)
            for flag, table_ in zip(flags, tables, strict=True):
                x = x + F.get(F.array(*[F.lit(v) for v in table_]), flag)
            out.append(x)
        return out


def _normalised(logs: Sequence[Column]) -> list[Column]:
    """Posteriors out of log columns."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    odds = [F.exp(x - top) for x in logs]
    norm = sum(odds[1:], odds[0])
    return [o / norm for o in odds]


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: Sequence[str], *, lexicon_of: str | None = "toxic", lexicon_rows: int = LEXICON_ROWS) -> tuple[Classifier, DataFrame]:
    """The classifier, and (id, tokens, f0..fk) of all documents. docs: id, body; labels: id, domain."""
    labelled = table(labels.where(F.col("domain").isin(list(domains)) & F.col("id").isNotNull()).groupBy("id").agg(F.min("domain").alias("domain")), "mix-labels")
    words = lexicon(docs, labelled, lexicon_of, lexicon_rows) if lexicon_of else []
    body = F.coalesce(F.col("body"), F.lit(""))
    flags = features(F.col("body"), words)
    seen = table(sized(docs.select("id", body.alias("body"))).select("id", "tokens", *[f.alias(f"f{j}") for j, (f, _) in enumerate(flags)]), "mix-features")
    bins = [(j, k) for j, (_, n) in enumerate(flags) for k in range(n)]
    counted = seen.join(labelled, "id").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"f{j}") == k).alias(f"n{j}_{k}") for j, k in bins]).collect()
    rows = {r["domain"]: r for r in counted}
    total = sum(r["n"] for r in rows.values())
    prior, tables = [], []
    for d in domains:
        n = rows[d]["n"] if d in rows else 0
        prior.append(math.log((n + 1) / (total + len(domains))))
        tables.append([[math.log(((rows[d][f"n{j}_{k}"] if d in rows else 0) + 0.5) / (n + 0.5 * size)) for k in range(size)] for j, (_, size) in enumerate(flags)])
    return Classifier(list(domains), words, prior, tables), seen


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivoting for a handful of domains."""
    n = len(right)
    m = [[*row, right[i]] for i, row in enumerate(matrix)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(m[r][c]))
        m[c], m[p] = m[p], m[c]
        if abs(m[c][c]) < 1e-300:
            continue
        for r in range(n):
            if r != c:
                q = m[r][c] / m[c][c]
                m[r] = [x - q * y for x, y in zip(m[r], m[c], strict=True)]
    return [m[i][n] / m[i][i] if abs(m[i][i]) >= 1e-300 else 0.0 for i in range(n)]


def fold_rates(posterior: Sequence[Column], steps: Sequence[Sequence[float]]) -> Column:
    """The rate after some projected steps, from 1."""
    rate = F.lit(1.0)
    for s in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((p * F.lit(float(x)) for p, x in zip(posterior[1:], s[1:], strict=True)), posterior[0] * F.lit(float(s[0]))))
    return rate


@dataclass
class Fit:
    """The steps that rates are folded from, and the totals they reach and were to reach."""

    steps: list[list[float]]
    reached: list[float]
    wanted: list[float]
    met: bool  # whether every domain is within the tolerance

    def rate(self, posterior: Sequence[Column]) -> Column:
        return F.round(fold_rates(posterior, self.steps), 6)


def fit_rates(soft: DataFrame, k: int, targets: Sequence[float], *, total: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Fit:
    """Rates for (tokens, p0..pk).

    Without ``total``, the mixture is as large as the domain with the largest target share allows without being repeated.
    """
    weights = [w / sum(targets) for w in targets]
    have = [float(x) for x in soft.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).first()]
    size = sum(have)
    if size <= 0:
        return Fit([], have, [0.0] * k, True)
    if total is None:
        total = min((h / w for h, w in zip(have, weights, strict=True) if w > 0 and h > 0), default=0.0)
        # A scarce domain must not shrink the rest: it is the most plentiful target that sets the size.
        total = max(total, have[max(range(k), key=lambda i: weights[i])] / max(weights))
    want = [w * total for w in weights]
    posterior = [F.col(f"p{i}") for i in range(k)]
    miss = lambda got: max(abs(g - w) / (w or size) for g, w in zip(got, want, strict=True))
    off = lambda got: sum(((g - w) / size) ** 2 for g, w in zip(got, want, strict=True))
    steps: list[list[float]] = []
    reached, met = have, False
    for _ in range(rounds):
        if met := miss(reached) <= tolerance:
            break
        rated = soft.withColumn("r", fold_rates(posterior, steps))
        moments = [F.sum(F.when(F.col("r") > 0, F.col("tokens") * posterior[i] * posterior[j]).otherwise(0.0)).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
        upper = iter(float(x) for x in rated.agg(*moments).first())
        second = [[0.0] * k for _ in range(k)]
        for i in range(k):
            for j in range(i, k):
                second[i][j] = second[j][i] = next(upper) / size
            second[i][i] += 1e-9
        gradient = [(g - w) / size for g, w in zip(reached, want, strict=True)]
        scaled = _solve(second, gradient)
        trials = [[x * length for x in scaled] for length in LENGTHS] + [[x * length / max(second[i][i] for i in range(k)) for x in gradient] for length in PLAIN]
        sums = [F.sum(F.col("tokens") * p * F.greatest(F.lit(0.0), F.col("r") - sum((q * F.lit(float(x)) for q, x in zip(posterior[1:], t[1:], strict=True)), posterior[0] * F.lit(float(t[0]))))) for t in trials for p in posterior]
        got = [float(x) for x in rated.agg(*[c.alias(f"v{n}") for n, c in enumerate(sums)]).first()]
        totals = [got[n * k : (n + 1) * k] for n in range(len(trials))]
        best = min(range(len(trials)), key=lambda n: off(totals[n]))
        if off(totals[best]) >= off(reached) * (1 - 1e-9):
            break
        steps.append(trials[best])
        reached = totals[best]
    return Fit(steps, reached, want, met or miss(reached) <= tolerance)


def _copies(rate: Column, id_: Column) -> Column:
    """Whole repeats: the rate's floor, and one more with the rate's fraction as probability, by a hash of the id."""
    draw = F.pmod(F.xxhash64(id_, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, *, total: float | None = None, lexicon_rows: int = LEXICON_ROWS, lexicon_of: str | None = "toxic") -> tuple[Classifier, Fit, DataFrame]:
    """docs: id, body; labels: id, domain -> the classifier, the fit, and (id, tokens, p0..pk) of all documents."""
    targets = targets or TARGETS
    domains = sorted(targets)
    classifier, seen = fit_classifier(docs, labels, domains, lexicon_of=lexicon_of, lexicon_rows=lexicon_rows)
    flags = [F.col(f"f{j}") for j in range(len(classifier.tables[0]))]
    logs = seen.select("id", "tokens", F.inline(F.array(F.struct(*[x.alias(f"l{i}") for i, x in enumerate(classifier.logs(flags))]))))
    soft = table(logs.select("id", "tokens", *[p.alias(f"p{i}") for i, p in enumerate(_normalised([F.col(f"l{i}") for i in range(len(domains))]))]), "mix-posteriors")
    return classifier, fit_rates(soft, len(domains), [targets[d] for d in domains], total=total), soft


def _plain(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    named = labels.select(F.col("id").cast("bigint").alias("id"), F.col("domain"))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("body")), named


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, tokens, p_<domain>..., rate, copies, and reached_<domain>..., the shares that all rates reach."""
    classifier, fitted, soft = fit(*_plain(docs, labels, id_col, text_col), targets, **options)
    rate = fitted.rate([F.col(f"p{i}") for i in range(len(classifier.domains))])
    whole = sum(fitted.reached) or 1.0
    return soft.withColumn("rate", rate).select(
        F.col("id").alias("doc_id"),
        "tokens",
        *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(classifier.domains)],
        "rate",
        _copies(F.col("rate"), F.col("id")).alias("copies"),
        *[F.lit(x / whole).alias(f"reached_{d}") for d, x in zip(classifier.domains, fitted.reached, strict=True)],
    )


def apply(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as its rate says. No join: rates are expressions over the row's text."""
    classifier, fitted, _ = fit(*_plain(docs, labels, id_col, text_col), targets, **options)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"), body.alias("body")))
    # `inline` keeps the optimizer from writing each step into every place where the next one uses it.
    step = lambda df, **named: df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(k) for k, c in named.items()]))))
    flagged = step(rows, **{f"f{j}": f for j, f in enumerate(classifier.flags(F.col("body")))}).drop("body", "distinct")
    scored = step(flagged, **{f"l{i}": x for i, x in enumerate(classifier.logs([F.col(f"f{j}") for j in range(len(classifier.tables[0]))]))})
    soft = step(scored, **{f"p{i}": p for i, p in enumerate(_normalised([F.col(f"l{i}") for i in range(len(classifier.domains))]))})
    rated = step(soft, rate=fitted.rate([F.col(f"p{i}") for i in range(len(classifier.domains))]))
    counted = rated.select("row", _copies(F.col("rate"), F.col("id")).alias("copies")).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def label_domains(labels: DataFrame) -> DataFrame:
    """The domain of a row of ``labels``: toxic, else junk where quality is 0, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).where(F.col("domain").isNotNull())
