"""Mixing sources to target weights with soft membership.

A classifier learned from the labelled table gives every document a posterior
over domains.  Projected gradient steps then fit a nonnegative rate for every
document so that the expected token total of each domain meets its target.
Each step is one distributed sum per domain; the driver sees only those sums.
DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persisted
from .components import components

DOMAINS = ("good", "low", "toxic")
SYMBOLS = "!\"#$%&*+/<=>@\\^_`{|}~[]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _level(share: Column) -> Column:
    """A share as one of seven coarse levels."""
    steps = (0.0, 0.01, 0.05, 0.15, 0.3, 0.6)
    return sum((share > s).cast("int") for s in steps)


def marked(documents: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text, n_tokens, tokens: distinct lower-cased words and a few marks for the shape of the text.

    With ``carry`` also the input row as struct ``row``.
    """
    rest = [F.struct("*").alias("row")] if carry else []
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    size = F.greatest(F.length(text), F.lit(1))

    def removed(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / size

    out = documents.select("doc_id", "text", *rest, words.alias("_w"), removed(SYMBOLS).alias("_s"), removed(CAPITALS).alias("_c"))
    out = out.withColumn("n_tokens", F.size("_w").cast("long"))
    out = out.withColumn("_w", F.array_distinct("_w"))
    again = F.when(F.col("n_tokens") > 20, 1 - F.size("_w") / F.col("n_tokens")).otherwise(0.0)
    shape = F.array(*[F.concat(F.lit(f"#{name}"), _level(value).cast("string")) for name, value in (("symbols", F.col("_s")), ("capitals", F.col("_c")), ("repeats", again))])
    return out.select("doc_id", "text", "n_tokens", *(["row"] if carry else []), F.concat("_w", shape).alias("tokens"))


LEVELS = 24
LENGTHS = 32
RARE = 16  # frequency up to which chance finds are counted out
FOLDS = 5
SURE = 2.0  # standard errors below the estimate at which a word's weight is taken
ONE = 1 << 20  # weight of one text; whole numbers add up alike in any order


def _step(score: Column) -> Column:
    """Level of a score, from 0."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(2 * score))).cast("int")


def _length(tokens: Column) -> Column:
    """Class of length: the number of distinct words halves from one class to the one before."""
    return F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.greatest(F.size(tokens), F.lit(1))))).cast("int")


@dataclass
class Contrast:
    """One yes-or-no question: telling words with their weights, the chance score at each class of length, and the posterior at each level."""

    words: list[str]
    weights: list[float]
    chance: list[float]
    spread: list[float]
    posterior: list[float]

    def score(self, tokens: Column) -> Column:
        """Summed weight of the telling words of a text, before any regard to its length."""
        if not self.words:
            return F.lit(0.0)
        table = F.create_map(*[F.lit(x) for pair in zip(self.words, self.weights) for x in pair])
        met = F.array_intersect(tokens, F.array(*map(F.lit, self.words)))
        return F.aggregate(met, F.lit(0.0), lambda total, word: total + F.try_element_at(table, word))

    def level(self, tokens: Column) -> Column:
        return _step(self.beyond_chance(self.score(tokens), _length(tokens)))

    def beyond_chance(self, score: Column, length: Column) -> Column:
        """How far a score lies above what texts of the other side of this length gather by chance."""
        mean, spread = (F.element_at(F.array(*map(F.lit, x)), length + 1) for x in (self.chance, self.spread))
        return (score - mean) / spread


@dataclass
class Classifier:
    """Is a text toxic, and if not, is it of low quality?"""

    toxic: Contrast
    low: Contrast

    def member_class(self, tokens: Column) -> Column:
        """Both levels as one number below LEVELS squared; texts of one class share all posteriors."""
        return self.toxic.level(tokens) * LEVELS + self.low.level(tokens)

    def posteriors(self, member: Column) -> dict[str, Column]:
        toxic = F.element_at(F.array(*map(F.lit, self.toxic.posterior)), (member / LEVELS).cast("int") + 1)
        low = F.element_at(F.array(*map(F.lit, self.low.posterior)), member % LEVELS + 1)
        return {"good": (1 - toxic) * (1 - low), "low": (1 - toxic) * low, "toxic": toxic}


SKETCH = 32  # smallest token hashes of a text that are compared
NEAR = 0.7  # share of them that near copies have in common


def _weighted(texts: DataFrame) -> DataFrame:
    """Texts (id, low, toxic, tokens) with ``family``, the smallest id of a component of near copies, and ``weight``.

    Two texts are near copies if the smallest hashes of both their token sets
    together agree in a share of ``NEAR``.  Texts meet the smallest id that has
    four of these hashes in the same sequence, so no pairs of copies are built.
    """
    hashes = F.array_sort(F.transform("tokens", lambda w: F.xxhash64(w)))
    sketch = persisted(texts.select("id", F.slice(hashes, 1, SKETCH).alias("s")).dropDuplicates(["id"]), "mixing-sketches")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("s") - 3)), lambda i: F.xxhash64(F.slice("s", i, F.lit(4))))
    keys = sketch.select("id", F.explode(F.array_distinct(runs)).alias("key"))
    met = keys.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = keys.join(met, "key").filter("a < id").select("a", F.col("id").alias("b")).distinct()
    pairs = pairs.join(sketch.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sketch.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    least = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
    near = F.size(F.array_intersect(F.array_intersect(least, "x"), "y")) >= NEAR * F.size(least)
    named = texts.join(components(pairs.filter(near).select("a", "b")), "id", "left").withColumn("family", F.coalesce("label", "id"))
    sizes = named.groupBy("family", "low", "toxic").agg(F.count(F.lit(1)).alias("k"))
    rows = named.join(sizes, ["family", "low", "toxic"])
    return rows.select("low", "toxic", "family", "tokens", F.round(ONE / F.col("k")).cast("long").alias("weight"))


def _real_share(found: int, by_chance: float) -> float:
    """Share of words found that are no chance finds, smoothed by one real word.

    A cell of few words cannot prove that all of them are chance finds, so
    they keep a small weight.
    """
    return (max(0.0, found - by_chance) + 1) / (found + 1)


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = 20000, words: int = 256) -> Classifier:
    """Learn from at most ``fit_rows`` labelled documents, chosen by a hash of the id.

    A family of near copies, told by its whole texts, weighs as much as one
    text, on each side it is labelled for; all its texts are in one fold.
    A word's weight is the lower confidence bound of its smoothed log ratio
    between the two sides, so the evidence a word needs does not depend on the
    size of the table, times the share of equally frequent words that are not
    chance finds; words with a positive weight tell.  All texts choose the
    words and all calibrate them, scored by the words of the other folds.  Long
    texts gather telling words by chance: a score counts from the mean that
    texts without the label reach at this length, in units of their spread.
    Both rise with length, saturate where such texts do, and double with the
    length beyond the longest of them.  Rows without id, text or label are left
    out; of several label rows the most toxic and the lowest quality count.  Without labels both questions answer one half.
    """
    given = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("low"), (F.max("toxic") == 1).alias("toxic")).dropna()
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # the bound of what is broadcast
    flags = F.struct("low", "toxic").alias("doc_id")
    known = marked(documents.filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").select(flags, "text"))
    known = known.select("doc_id.low", "doc_id.toxic", F.xxhash64("text").alias("id"), "tokens").dropDuplicates(["id", "low", "toxic"])
    known = _weighted(persisted(known, "mixing-texts"))
    known = persisted(known.withColumn("fold", F.pmod(F.xxhash64("family"), F.lit(FOLDS)).cast("int")), "mixing-sample")

    def by_fold(what: Column, name: str) -> list[Column]:
        return [F.coalesce(F.sum(F.when(F.col("fold") == k, what)), F.lit(0)).alias(f"{name}{k}") for k in range(FOLDS)]

    weight = F.col("weight")
    sums = [c for name, what in (("n", weight), ("toxic", F.when(F.col("toxic"), weight)), ("low", F.when(F.col("low"), weight))) for c in by_fold(what, name)]
    size = known.agg(*sums).first()
    each = known.select("toxic", "low", "weight", "fold", F.explode(F.array_distinct("tokens")).alias("w"))
    counts = each.groupBy("w").agg(*sums)
    counts = persisted(counts, "mixing-words")

    def telling(side: str, folds: list[int]) -> Contrast:
        yes, total = (sum(size[f"{c}{k}"] for k in folds) / ONE for c in (side, "n"))
        y, n = (sum(F.col(f"{c}{k}") for k in folds) / ONE for c in (side, "n"))
        ratio = F.log((y + 0.5) / (yes + 1)) - F.log((n - y + 0.5) / (total - yes + 1))
        bound = ratio - SURE * F.sqrt(1 / (y + 0.5) + 1 / (n - y + 0.5))
        # Of the words of this frequency, how many stand on the yes side so often by chance alone?
        often, hits = F.round(n).cast("int"), F.round(y).cast("int")
        cells = counts.filter(often.between(1, RARE)).groupBy(often.alias("n"), hits.alias("y")).agg(F.count(F.lit(1)).alias("k")).collect()
        every = [sum(r["k"] for r in cells if r["n"] == i) for i in range(RARE + 1)]
        p = yes / total if total else 0.0
        real = {r["n"] * 100 + r["y"]: _real_share(r["k"], every[r["n"]] * math.comb(r["n"], r["y"]) * p ** r["y"] * (1 - p) ** (r["n"] - r["y"])) for r in cells}
        if real:
            bound = bound * F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(real.items()) for x in pair]), often * 100 + hits), F.lit(1.0))
        top = counts.select("w", bound.alias("x"), (y * bound).alias("g")).filter("x > 0").orderBy(F.desc("g"), "w").limit(words).collect()
        return Contrast([r["w"] for r in top], [r["x"] for r in top], [0.0] * LENGTHS, [1.0] * LENGTHS, [])

    def contrast(side: str) -> Contrast:
        found = telling(side, list(range(FOLDS)))
        score = F.lit(0.0)
        for k in range(FOLDS):
            score = F.when(F.col("fold") == k, telling(side, [j for j in range(FOLDS) if j != k]).score(F.col("tokens"))).otherwise(score)
        scored = persisted(known.select(score.alias("score"), _length(F.col("tokens")).alias("length"), side, "weight"), "mixing-scores")
        mass = (F.col("score") * 1000).cast("long")  # whole thousandths
        sums = scored.filter(~F.col(side)).groupBy("length").agg(*[F.sum(x.cast("decimal(38,0)")).cast("double").alias(c) for c, x in (("n", weight), ("s", weight * mass), ("q", weight * mass * mass))]).collect()
        found.chance, found.spread = _by_length({r["length"]: (r["n"], r["s"] / 1e3, r["q"] / 1e6) for r in sums}, sum(found.weights))
        level = _step(found.beyond_chance(F.col("score"), F.col("length")))
        seen = scored.groupBy(level.alias("level")).agg(F.sum("weight").alias("n"), F.coalesce(F.sum(F.when(F.col(side), weight)), F.lit(0)).alias("yes")).collect()
        n, y = [0.0] * LEVELS, [0.0] * LEVELS
        for r in seen:
            n[r["level"]], y[r["level"]] = r["n"] / ONE, r["yes"] / ONE
        found.posterior = _rising(y, n)
        return found

    return Classifier(contrast("toxic"), contrast("low"))


def _pools(total: list[float], n: list[float]) -> list[list[float]]:
    """Sums, weights and numbers of levels, neighbours pooled until the means rise; levels of no weight join the one before."""
    pools: list[list[float]] = []
    for y, k in zip(total, n):
        pools.append([y, k, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, c = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c]
    return pools


def _rising(yes: list[float], n: list[float]) -> list[float]:
    """Rising shares, each pool smoothed by one text of the overall share."""
    base = sum(yes) / sum(n) if sum(n) > 0 else 0.5
    out: list[float] = []
    for y, k, levels in _pools(yes, n):
        out += [max([(y + base) / (k + 1), *out[-1:]])] * int(levels)
    return out


def _by_length(seen: dict[int, tuple[float, float, float]], most: float) -> tuple[list[float], list[float]]:
    """Rising mean score and spread (at least 1) of every class of length, from weights, sums and sums of squares."""
    if not seen:
        return [0.0] * LENGTHS, [1.0] * LENGTHS
    none = (0.0, 0.0, 0.0)
    n, s, q = zip(*[seen.get(i, none) for i in range(LENGTHS)])
    within = [max(0.0, b - a * a / k) if k else 0.0 for k, a, b in zip(n, s, q)]
    mean, var = ([y / k if k else 0.0 for y, k, levels in _pools(x, n) for _ in range(int(levels))] for x in (s, within))
    last = max(seen)
    for i in range(last + 1, LENGTHS):
        mean[i], var[i] = min(most, 2 * mean[i - 1]), min(most * most, 2 * var[i - 1])
    return mean, [(1 + v) ** 0.5 for v in var]


def classed(documents: DataFrame, model: Classifier, carry: bool = False) -> DataFrame:
    """doc_id, n_tokens and class (with ``carry`` also ``row``)."""
    docs = marked(documents, carry)
    return docs.select("doc_id", "n_tokens", *(["row"] if carry else []), model.member_class(F.col("tokens")).alias("class"))


@dataclass
class Rates:
    """Rate of every class, shares of the present token total asked for and reached, and how far from an optimum they are.

    ``gap`` is the largest violation of the optimality conditions: no rate
    above zero wants to move, none at zero wants to rise.  At a gap of zero a
    share that misses its target cannot be met with these posteriors.
    """

    rates: list[float]
    wanted: dict[str, float]
    reached: dict[str, float]
    gap: float


STEPS = 1000  # gradient steps of one job


def fitted_rates(members: DataFrame, model: Classifier, targets: dict[str, float] | None, tolerance: float = 1e-6) -> Rates:
    """The rate of every class, by projected gradient over the distributed token totals.

    Minimises the squared misses of the domains' expected token totals, each
    relative to the domain's present total, over nonnegative rates, from rate 1
    everywhere.  Scaled this way the step size is 1.  Documents of one class
    have one gradient per token and so one rate; their tokens are summed once,
    before the steps, which then work on one row of at most LEVELS squared
    classes, until no rate moves by more than ``tolerance``.  ``targets`` are
    shares of the present token total; None keeps every domain's present share
    but drops ``toxic``.
    """
    classes = members.groupBy("class").agg(F.sum("n_tokens").cast("double").alias("n"))
    parts = model.posteriors(F.col("class"))
    item = F.struct("class", "n", *[parts[d].alias(d) for d in DOMAINS])
    row = persisted(classes.filter("n > 0").agg(F.sort_array(F.collect_list(item)).alias("items")), "mixing-classes")

    def totals(rate: Column) -> list[Column]:
        return [F.aggregate(F.zip_with("items", rate, _tokens(d)), F.lit(0.0), lambda a, b: a + b) for d in DOMAINS]

    ones = F.transform("items", lambda c: F.lit(1.0))
    present = [x or 0.0 for x in row.select(*totals(ones)).first()]
    total = sum(present)
    wanted = [0.0 if d == "toxic" and targets is None else present[i] if targets is None else targets[d] * total for i, d in enumerate(DOMAINS)]

    def misses(rate: Column) -> Column:
        return F.array(*[(now - F.lit(w)) / F.lit(p) if p > 0 else F.lit(0.0) for now, w, p in zip(totals(rate), wanted, present)])

    def moved(rate: Column) -> Column:
        return F.transform(F.array(misses(rate)), lambda miss: F.zip_with("items", rate, _step_down(miss)))[0]

    rate, gap, now = [], 0.0, present
    while total > 0:
        start = F.array(*map(F.lit, rate)) if rate else ones
        after = row.select("items", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda r, _: moved(r)).alias("r"))
        after = after.select("r", *totals(F.col("r")), F.array_max(F.zip_with("r", moved(F.col("r")), lambda a, b: F.abs(a - b)))).first()
        rate, now, gap = after[0], list(after[1:-1]), after[-1]
        if gap < tolerance:
            break
    # Rates of the classes without tokens follow from the last misses: what one step from rate 1 makes of them.
    miss = [(n - w) / p if p > 0 else 0.0 for n, w, p in zip(now, wanted, present)]
    rows = members.sparkSession.range(LEVELS * LEVELS).select(F.col("id").cast("int").alias("class"))
    own = model.posteriors(F.col("class"))
    known = {c: r for c, r in zip(row.select(F.col("items.class").alias("c")).first()["c"] or [], rate)} if rate else {}
    step = F.greatest(F.lit(0.0), F.lit(1.0) - sum(F.lit(m) * own[d] for m, d in zip(miss, DOMAINS)))
    other = sorted(rows.select("class", step.alias("rate")).collect())
    share = lambda x: {d: v / total if total > 0 else 0.0 for d, v in zip(DOMAINS, x)}
    return Rates([known.get(r["class"], r["rate"]) for r in other], share(wanted), share(now), gap)


def _tokens(domain: str):
    return lambda c, rate: c["n"] * c[domain] * rate


def _step_down(miss: Column):
    return lambda c, rate: F.greatest(F.lit(0.0), rate - sum(miss[i] * c[d] for i, d in enumerate(DOMAINS)))


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None, fit_rows: int = 20000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, p_<domain>, rate, copies.

    ``copies`` rounds the rate up or down by a hash of the id, so that its
    expectation is the rate.  A text without words has no tokens and so no part
    in the totals; its rate follows from its class.  ``wanted_<domain>`` and
    ``reached_<domain>`` are shares of the present token total, ``gap`` says how
    far the rates are from an optimum.  Without any label every rate is alike.  Repeated rows and null ids are rows of their own; other
    columns are not carried.
    """
    model = fit(documents, labels, fit_rows)
    members = persisted(classed(documents, model), "mixing-members")
    rates = fitted_rates(members, model, targets)
    parts = model.posteriors(F.col("class"))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(29)), F.lit(1 << 30)) / (1 << 30)
    rate = F.element_at(F.array(*map(F.lit, rates.rates)), F.col("class") + 1)
    shares = [F.lit(x[d]).alias(f"{name}_{d}") for name, x in (("wanted", rates.wanted), ("reached", rates.reached)) for d in DOMAINS]
    return members.select("doc_id", "n_tokens", *[parts[d].alias(f"p_{d}") for d in DOMAINS], rate.alias("rate"), F.floor(rate + draw).cast("long").alias("copies"), *shares, F.lit(rates.gap).alias("gap"))


def mixture(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None, fit_rows: int = 20000) -> DataFrame:
    """The rows of the mixture with the columns of the input, each as often as its rate rounded to a whole number.

    Rounding to the nearest keeps every row whose rate is above one half.
    """
    model = fit(documents, labels, fit_rows)
    # Written with their class, so the texts are classified once and the sums read two columns.
    rows = persisted(classed(documents, model, carry=True), "mixing-rows")
    rates = fitted_rates(rows.select("n_tokens", "class"), model, targets).rates
    copies = F.element_at(F.array(*[F.lit(int(r + 0.5)) for r in rates]), F.col("class") + 1)
    kept = rows.select("row", copies.alias("_n")).filter("_n > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("row.*")
