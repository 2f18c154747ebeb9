"""Document rates that bring soft domains to target weights, by DataFrame expressions only.

A Bernoulli naive Bayes classifier learned from a labelled table gives each document a posterior
over domains. Projected-gradient least squares then finds nonnegative rates, one for each document,
whose expected token totals by domain match the targets. A step needs one number for each domain
from the whole table; the rates are an expression of the posterior and the steps so far, so nothing
but these numbers ever leaves the executors.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from temblor.llm.graph import settle

_LOG = logging.getLogger(__name__)
SAMPLE_ROWS = 4_000  # labelled documents of each domain that are read at most to learn
LEAST_LIFT = 12.0  # a mark is so much commoner in its domain
HANDFUL = 2  # sample documents of its domain that have a mark, whatever their share; as many are added to the others' count
_TABLES = 1_024  # the weights are dealt out by hash, so that finding one does not depend on how many there are
_SMOOTH = 0.25
_SIGNS = r"[^!|#$%&*{}<>=_^~@+\\]+"


def add_features(frame: DataFrame, text_col: str) -> DataFrame:
    """``frame`` with ``_found``, the features of a text, and ``_tokens``, the number of its letter runs.

    Features are the distinct letter runs in lower case and marks of the text's shape, written so that
    no word equals one: signs, capitals, and how few of all its words and of all its lines are distinct.
    In steps, so that each pass over the text happens once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    frame = frame.withColumns({
        "_words": F.array_remove(F.split(F.lower(text), r"\P{L}+"), ""),
        "_signs": F.length(F.regexp_replace(text, _SIGNS, "")) / (F.length(text) + 1),
        "_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")) / (F.length(text) + 1),
        "_lines": F.array_remove(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), "")})
    frame = frame.withColumn("_distinct", F.array_distinct("_words"))
    signs, capitals = F.col("_signs"), F.col("_capitals")
    # One for a text without words or lines: nothing is repeated.
    words = (F.size("_distinct") + F.when(F.size("_words") == 0, 1).otherwise(0)) / F.greatest(F.size("_words"), F.lit(1))
    lines = (F.size(F.array_distinct("_lines")) + F.when(F.size("_lines") == 0, 1).otherwise(0)) / F.greatest(F.size("_lines"), F.lit(1))
    frame = frame.withColumns({"_new_words": words, "_new_lines": lines})
    words, lines = F.col("_new_words"), F.col("_new_lines")
    marks = [(signs > 0.005, "signs>0.5%"), (signs > 0.03, "signs>3%"), (signs > 0.1, "signs>10%"),
             (capitals > 0.1, "capitals>10%"), (capitals > 0.4, "capitals>40%"),
             (words < 0.35, "words<35%"), (words < 0.2, "words<20%"), (words < 0.1, "words<10%"), (words < 0.05, "words<5%"),
             (lines < 0.5, "lines<50%"), (lines < 0.25, "lines<25%"), (lines < 0.1, "lines<10%")]
    shape = F.array(*[F.when(test, F.lit(name)).otherwise("") for test, name in marks])
    return frame.withColumns({
        "_found": F.concat("_distinct", shape), "_tokens": F.size("_words").cast("bigint")}).drop(
            "_words", "_signs", "_capitals", "_lines", "_distinct", "_new_words", "_new_lines")


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]  # log prior plus the log odds of all words being absent
    weights: dict[str, list[float]] = field(default_factory=dict)  # by word: what its presence adds

    def _tables(self) -> Column:
        """The weights by word, dealt out over maps by the word's hash: one constant, read from one text."""
        spark = SparkSession.active()
        words = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(sorted(self.weights))), "array<string>")).alias("word"))
        tables: list[dict] = [{} for _ in range(_TABLES)]
        for row in words.select("word", F.pmod(F.xxhash64("word"), F.lit(_TABLES)).cast("int").alias("k")).collect():
            tables[row["k"]][row["word"]] = self.weights[row["word"]]
        return F.from_json(F.lit(json.dumps(tables)), "array<map<string,array<double>>>")

    def add_posterior(self, frame: DataFrame, found: Column, name: str = "posterior") -> DataFrame:
        """``frame`` with array<double> ``name``: domain probabilities from a document's features.

        In steps, so that nothing is worked out twice.
        """
        # Double of each domain for each known word that is present.
        present = F.lit(None).cast("array<array<double>>")
        if self.weights:
            tables = self._tables()
            present = F.filter(F.transform(F.array_distinct(found), lambda w: F.element_at(
                F.element_at(tables, F.pmod(F.xxhash64(w), F.lit(_TABLES)).cast("int") + 1), w)), lambda x: x.isNotNull())
        frame = frame.withColumn("_present", present)
        logs = []
        for k, prior in enumerate(self.prior):
            added = F.aggregate("_present", F.lit(0.0), lambda total, x: total + x[k]) if self.weights else F.lit(0.0)
            logs.append((prior + added).alias(f"_log{k}"))
        k = range(len(logs))
        rest = [F.col(f"`{c}`") for c in frame.columns if c != "_present"]
        frame = frame.select(*rest, *logs)
        # Odds against each domain: no column is needed twice in one expression but the logs.
        p = [1 / sum((F.exp(F.least(F.col(f"_log{j}") - F.col(f"_log{i}"), F.lit(700.0))) for j in k), F.lit(0.0)) for i in k]
        return frame.select(*rest, F.array(*p).alias(name))


def learn_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id",
                  text_col: str = "text", domain_col: str = "domain", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """A classifier from ``labelled`` (id, domain): at most ``sample_rows`` rows of each domain, those
    with the smallest hash of their id. Labels of other domains, without id or text count for nothing.

    Marks are chosen by lift alone, however small their share of a domain: the marks of a language that
    a tenth of its documents are in are kept like the others'. They are no more than the sample's words.
    """
    picked = None
    known = labelled.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(domain_col).alias("_domain"))
    sizes = {r["_domain"]: r["n"] for r in known.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()
             if r["_domain"] in domains}
    for name in domains:
        part = known.filter(F.col("_domain") == name).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
        picked = part if picked is None else picked.union(part)
    # At most ``sample_rows`` x domains rows of two short columns.
    text = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sample = text.join(F.broadcast(settle(picked)), "_id")
    sample = settle(add_features(sample, "_text").select("_domain", F.array_distinct("_found").alias("found")))
    rows = {r["_domain"]: r["n"] for r in sample.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {d: rows.get(d, 0) for d in domains}
    counts = settle(sample.select("_domain", F.explode("found").alias("word")).filter("word != ''").groupBy("word").agg(
        *[F.count_if(F.col("_domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]))
    chosen: dict[str, list[int]] = {}
    every = sum(n.values())
    for i, d in enumerate(domains):
        if not n[d] or n[d] == every:
            continue
        others = sum((F.col(f"n{j}") for j in range(len(domains)) if j != i), F.lit(0))
        # Marks of a domain, not words that it merely has less often: those go with a text's length.
        # Of many rare words some are commoner by chance: the handful added to the others rules these out.
        marks = counts.filter((F.col(f"n{i}") >= HANDFUL) & (
            F.col(f"n{i}") / n[d] > LEAST_LIFT * (others + HANDFUL) / (every - n[d])))
        for r in marks.collect():
            chosen[r["word"]] = [r[f"n{j}"] for j in range(len(domains))]
    total = sum(sizes.values())
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    weights = {}
    for word, seen in chosen.items():
        p = [(c + _SMOOTH) / (n[d] + 2 * _SMOOTH) for c, d in zip(seen, domains)]
        prior = [a + math.log(1 - x) for a, x in zip(prior, p)]
        weights[word] = [math.log(x) - math.log(1 - x) for x in p]
    return Classifier(domains, prior, weights)


@dataclass
class Rates:
    """Rates as an expression: every step lowers a document's rate by its posterior times the step."""

    steps: list[list[float]]
    reached: list[float]  # expected tokens of each domain
    wanted: list[float]

    def rate(self, posterior: Column, start: Column | None = None, since: int = 0) -> Column:
        """The rate of a document, by a fold over the steps: the expression is as large for 400 as for 3."""
        rate = F.lit(1.0) if start is None else start
        steps = F.from_json(F.lit(json.dumps(self.steps[since:])), "array<array<double>>")
        return F.aggregate(steps, rate, lambda r, step: F.greatest(F.lit(0.0), r - sum(
            (posterior[k] * step[k] for k in range(len(self.wanted))), F.lit(0.0))))

    def off(self) -> float:
        """The largest distance of a domain from its target, as a share of all wanted tokens."""
        total = sum(self.wanted)
        return max((abs(r - w) for r, w in zip(self.reached, self.wanted)), default=0.0) / total if total else 0.0


def fit_rates(slim: DataFrame, shares: list[float], tokens: float | None = None, steps: int = 80, close: float = 1e-4) -> Rates:
    """Rates for ``slim`` (tokens, posterior) that bring domain k to ``shares[k]`` of ``tokens``.

    Minimises the sum over domains of ((reached - wanted) / scale)^2, the scale being the root of a
    domain's sum of tokens times squared posterior, by projected gradient from rate
    1, in the metric that weighs a document by its tokens; so a step is the same for long and short
    documents of one posterior. Without ``tokens`` the total stays what it is. A domain without
    tokens cannot be reached; its target is left over. Stops when every domain that has tokens is
    within ``close`` of the total of its target, when ten steps together gain nothing, or after
    ``steps`` steps; what was reached is logged beside the targets, as a warning if it is not close.
    """
    k = range(len(shares))
    first = slim.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in k],
                     *[F.sum(F.col("tokens") * F.col("posterior")[i] * F.col("posterior")[j]).alias(f"h{i}_{j}")
                       for i in k for j in k]).first()
    have = [first[f"t{i}"] or 0.0 for i in k]
    total = tokens if tokens is not None else sum(have)
    wanted = [s * total for s in shares]
    rates = Rates([], have, wanted)
    if not sum(have):
        return rates
    # This scale gives the small matrix a unit diagonal; its largest eigenvalue bounds the step.
    scale = [max(math.sqrt(first[f"h{i}_{i}"] or 0.0), 1e-9) for i in k]
    matrix = [[(first[f"h{i}_{j}"] or 0.0) / scale[i] / scale[j] for j in k] for i in k]
    vector = [1.0] * len(shares)
    largest = 1e-30
    for _ in range(100):
        image = [sum(matrix[i][j] * vector[j] for j in k) for i in k]
        largest = max(max(map(abs, image)), 1e-30)
        vector = [x / largest for x in image]
    current = slim.withColumn("rate", F.lit(1.0))
    since, before = 0, math.inf
    for _ in range(steps):
        if all(abs(r - w) <= close * total for r, w, h in zip(rates.reached, wanted, have) if h):
            break
        if len(rates.steps) % 10 == 0:
            left = sum(((r - w) / s) ** 2 for r, w, s in zip(rates.reached, wanted, scale))
            if left >= before * (1 - 1e-6):
                break
            before = left
        error = [(rates.reached[i] - wanted[i]) / scale[i] for i in k]
        rates.steps.append([e / scale[i] / largest for i, e in enumerate(error)])
        rate = rates.rate(F.col("posterior"), F.col("rate"), since)
        sums = current.agg(*[F.sum(F.col("tokens") * rate * F.col("posterior")[i]).alias(f"t{i}") for i in k]).first()
        rates.reached = [sums[f"t{i}"] for i in k]
        if len(rates.steps) - since == 10:
            current = settle(current.withColumn("rate", rate))
            since = len(rates.steps)
    missed = any(abs(r - w) > close * total for r, w, h in zip(rates.reached, wanted, have) if h)
    _LOG.log(logging.WARNING if missed else logging.INFO, "expected tokens %s of wanted %s after %d steps",
             [round(r) for r in rates.reached], [round(w) for w in wanted], len(rates.steps))
    return rates


def copies_of(rate: Column, key: Column) -> Column:
    """A whole number whose mean over keys is the rate; the same key always draws the same."""
    draw = F.pmod(F.xxhash64(F.lit(101), key), F.lit(1 << 52)) / float(1 << 52)
    return F.floor(rate + draw).cast("int")


DOMAIN_SHARES = {"good": 0.9, "poor": 0.07, "toxic": 0.03}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a label table: toxic before poor before good; one row for each id."""
    merged = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return merged.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor")
                         .when(F.col("quality") == 1, "good").alias("domain"))


def _slim(docs: DataFrame, model: Classifier, id_col: str, text_col: str) -> DataFrame:
    parts = add_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    parts = parts.select("doc_id", F.col("_tokens").alias("tokens"), "_found")
    return model.add_posterior(parts, F.col("_found")).drop("_found")


def mix_rates(docs: DataFrame, labelled: DataFrame, shares: dict[str, float] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies) for every row of ``docs``.

    ``tokens`` counts letter runs. A null text is empty: no tokens, and the posterior of a text with
    no feature. Rows are judged one by one, so repeated rows and null ids are rows of their own;
    equal ids draw equally. Without labels all domains are equally likely. No rows give no rows.
    """
    shares = shares or DOMAIN_SHARES
    names = list(shares)
    model = learn_domains(docs, labelled, names, id_col, text_col)
    slim = settle(_slim(docs, model, id_col, text_col))
    rates = fit_rates(slim, list(shares.values()))
    rated = slim.withColumn("rate", rates.rate(F.col("posterior")))
    return rated.select("doc_id", "tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(names)],
                        "rate", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, shares: dict[str, float] | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; no shuffle of the texts.

    A rate of one or more never drops a document. Working columns begin with an underscore;
    columns of ``docs`` that are named alike are kept apart.
    """
    names = [F.col(f"`_c{i}`").alias(c) for i, c in enumerate(docs.columns)]
    clear = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    id_col, text_col = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col))
    labelled = labelled.withColumnRenamed("doc_id", id_col) if "doc_id" in labelled.columns else labelled
    docs = clear
    shares = shares or DOMAIN_SHARES
    model = learn_domains(docs, labelled, list(shares), id_col, text_col)
    rates = fit_rates(settle(_slim(docs, model, id_col, text_col).select("tokens", "posterior")), list(shares.values()))
    rated = model.add_posterior(add_features(docs, text_col), F.col("_found"), "_posterior").drop("_found", "_tokens")
    copies = copies_of(rates.rate(F.col("_posterior")), F.col(id_col))
    # No filter: it would be a second copy of the expression. No copies are no elements, hence no rows.
    return rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*names)
