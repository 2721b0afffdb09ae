"""Mixing to target weights by soft membership. Only DataFrame functions are used.

A naive Bayes classifier of words, learned from the labels table, gives each document posteriors over domains. Then
each document gets a rate, how often it is to be read, so that the expected tokens of the domains meet their targets:
least squares over the domains' totals by projected gradient steps.

The gradient of a document's rate is its posteriors times the domains' misses, so all that the steps have added up to
is one number a domain. A pass over the memberships makes every rate from these numbers, projects it to its bounds and
sums up the domains; the next step goes along the misses, scaled by the Gram matrix of the documents whose rates are
within their bounds. The driver sees a few sums a pass; nothing is written.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents, spare_name, written

#: Labelled rows that the classifier learns from, about (chosen by a hash of their ids), and buckets of its words.
MAX_LABELLED, BUCKETS = 20_000, 1 << 18
#: Documents that a word is taken to be in besides those seen, in the domains' usual shares.
PRIOR_DOCUMENTS = 1.0
#: Weight of the ridge that decides between rates that meet the targets alike, and the gradient at which steps end.
RIDGE, TOLERANCE = 1e-8, 1e-10
_LOG = logging.getLogger(__name__)
DOMAINS = ["high", "low", "toxic"]
TARGETS = {"high": 0.85, "low": 0.14, "toxic": 0.01}


def label_domain() -> Column:
    """Of a row of labels; rows without either label are left out of learning."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")


def _with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """A row for each distinct word of a document and for how much it repeats words (in tenths), as buckets; one with a null bucket never occurs."""
    with_words = docs.withColumn("words", _words(F.col(f"`{text_col}`"))).drop(text_col).withColumn("n_tokens", F.size("words").cast("long"))
    distinct = F.array_distinct("words")
    fresh = F.concat(F.lit(" fresh "), F.floor(10 * F.size(distinct) / F.greatest("n_tokens", F.lit(1))).cast("string"))
    each = with_words.withColumn("feature", F.explode(F.array_append(distinct, fresh))).drop("words")
    return each.withColumn("bucket", F.pmod(F.xxhash64("feature"), F.lit(BUCKETS))).drop("feature")


def learn(docs: DataFrame, labels: DataFrame, domains: list[str] = DOMAINS, max_labelled: int = MAX_LABELLED, text_col: str = "text") -> tuple[DataFrame, dict[str, float]]:
    """(bucket, weight and what a word of it says for each domain; log prior of each domain). labels: doc_id and domain.

    What a word says is the logarithm of the domain's share of the labelled documents that have it, over the domain's
    share of all, times its weight: 1 - 2 (domains - 1) / G, at least 0, where G is twice the log-likelihood ratio
    against the usual shares (so what Akaike's criterion takes for chance says nothing). All words of the labelled
    texts take part. The table has BUCKETS rows at most, whatever the corpus, so it may be broadcast. Of several labels
    of an id the least counts; beyond max_labelled labelled ids a hash chooses about so many."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = written(known, "labelled")
    if (all_known := known.count()) > max_labelled:
        known = known.where(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 32)) < int((1 << 32) * max_labelled / all_known))
    n = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    share = {k: (n.get(k, 0) + 1) / (sum(n.values()) + len(domains)) for k in domains}
    taught = docs.select(F.col("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "doc_id")
    seen = _with_features(taught, "text").groupBy("bucket").agg(*[F.sum((F.col("domain") == k).cast("long")).alias(f"c{i}") for i, k in enumerate(domains)])
    total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(len(domains))])
    ratio = 2 * reduce(lambda a, b: a + b, [F.when(F.col(f"c{i}") > 0, F.col(f"c{i}") * F.log(F.col(f"c{i}") / (total * share[k]))).otherwise(0.0) for i, k in enumerate(domains)])
    weighed = seen.withColumn("weight", 1 - 2 * (len(domains) - 1) / F.greatest(ratio, F.lit(1e-9)))
    says = [(F.col("weight") * F.log((F.col(f"c{i}") / share[k] + PRIOR_DOCUMENTS) / (total + PRIOR_DOCUMENTS))).alias(f"l{i}") for i, k in enumerate(domains)]
    return written(weighed.where("weight > 0").select("bucket", "weight", *says), "words"), {k: math.log(x) for k, x in share.items()}


def memberships(numbered: DataFrame, model: DataFrame, prior: dict[str, float], id_col: str = "doc_id", text_col: str = "text", rid: str = "rid") -> DataFrame:
    """(rid, doc_id, n_tokens, p_<domain>...). What the known words say is summed and divided by the root of their weight, which keeps memberships soft."""
    domains = list(prior)
    slim = numbered.select(F.col(rid).alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hits = _with_features(slim, "text").join(F.broadcast(model), "bucket", "left")
    sums = hits.groupBy("rid", "doc_id", "n_tokens").agg(*[F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(domains))], F.coalesce(F.sum("weight"), F.lit(0.0)).alias("hits"))
    root = F.sqrt(F.greatest("hits", F.lit(1.0)))
    raw = sums.select("rid", "doc_id", "n_tokens", *[(prior[k] + F.col(f"s{i}") / root).alias(f"s{i}") for i, k in enumerate(domains)])
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("s0")
    raised = raw.select("rid", "doc_id", "n_tokens", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(len(domains))])
    whole = reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in range(len(domains))])
    return raised.select("rid", "doc_id", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p_{k}") for i, k in enumerate(domains)])


def _rate(drift: Column, max_rate: float | None) -> Column:
    raised = F.greatest(F.lit(0.0), 1 + drift)
    return raised if max_rate is None else F.least(F.lit(float(max_rate)), raised)


def fit_rates(members: DataFrame, targets: dict[str, float], total: float | None = None, max_rate: float | None = None, ridge: float = RIDGE, tolerance: float = TOLERANCE, missed: dict[str, float] | None = None) -> DataFrame:
    """members with ``rate``. targets: shares of the tokens to be read, scaled to sum 1; total: how many, as many as there are unless given.

    Minimises 1/2 sum_k (S_k / T - target_k)^2 + ridge/2 sum_d (t_d / T) (rate_d - 1)^2 over 0 <= rate_d (<= max_rate), where S_k = sum_d t_d p_dk rate_d.
    Steps go on until no part of the gradient exceeds the tolerance, or the objective can't be told to fall any more: it is
    convex and falls with every step, so steps end. What each domain gets beyond its target, as a share of the tokens to be
    read, goes to missed; where the targets are out of reach (by more than a thousandth) a warning says so.
    Documents without tokens have rate 1; where there are no tokens at all, all have."""
    domains = list(targets)
    p, weight = [F.col(f"p_{k}") for k in domains], F.col("n_tokens").cast("double")
    tokens = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not tokens:
        return members.withColumn("rate", F.lit(1.0))
    scale = (total if total is not None else tokens) / tokens / sum(targets.values())
    goal, n = np.array([targets[k] * scale for k in domains]), len(domains)
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    drift = lambda said: reduce(lambda a, b: a + b, [float(x) * c for x, c in zip(said, p)])

    def passed(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each tried sum of steps, in one pass: the objective of the domains' numbers, its gradient and its Gram matrix."""
        sums = []
        for said in tried:
            z = drift(said)
            rate = _rate(z, max_rate)
            beyond = F.lit(0.0) if max_rate is None else F.greatest(F.lit(0.0), 1 + z - max_rate) * max_rate
            live = z > -1 if max_rate is None else (z > -1) & (z <= max_rate - 1)
            sums += [F.sum(weight * (rate * rate / 2 + beyond)), *[F.sum(weight * c * rate) for c in p], *[F.sum(F.when(live, weight * p[a] * p[b]).otherwise(0.0)) for a, b in pairs]]
        got = np.array(members.agg(*[x.alias(f"x{i}") for i, x in enumerate(sums)]).first(), float).reshape(len(tried), -1) / tokens
        out = []
        for said, row in zip(tried, got):
            gram = np.zeros((n, n))
            for (a, b), x in zip(pairs, row[1 + n :]):
                gram[a, b] = gram[b, a] = x
            out.append((row[0] - goal @ said + ridge / 2 * said @ said, row[1 : 1 + n] - goal + ridge * said, gram + ridge * np.eye(n)))
        return out

    said, shorter = np.zeros(n), 0
    value, slope, gram = passed([said])[0]
    while np.abs(slope).max() > tolerance:
        step = -np.linalg.solve(gram, slope)
        tried = [said + step * 0.25 ** (shorter + k) for k in range(8)]
        found = passed(tried)
        best = min(range(len(tried)), key=lambda k: found[k][0])
        gain = value - found[best][0]
        if gain > 0:
            said, (value, slope, gram), shorter = tried[best], found[best], max(0, shorter + best - 1)
            if gain < 1e-13 * max(1.0, abs(value)):
                break
        elif np.abs(tried[-1] - said).max() > 1e-15 * max(1.0, np.abs(said).max()):
            shorter += 8
        else:
            break
    left = {k: float(x) for k, x in zip(domains, (slope - ridge * said) / max(goal.sum(), 1e-300))}
    if missed is not None:
        missed.update(left)
    if max(map(abs, left.values())) > 1e-3:
        _LOG.warning("targets out of reach; beyond them, as shares of the tokens to be read: %s", {k: round(x, 4) for k, x in left.items()})
    return members.withColumn("rate", F.when(F.col("n_tokens") > 0, _rate(drift(said), max_rate)).otherwise(1.0))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, text_col: str = "text", rid: str | None = None, **options) -> DataFrame:
    """(rid, doc_id, n_tokens, p_<domain>..., rate) of each row of docs. labels: doc_id and domain, one of targets.

    rid: a column of docs that tells rows apart, else they are numbered. Tokens are what white space parts; null and
    empty texts have none and rate 1. Texts are read whole; repeated rows and ids are rows of their own, a null id has
    no label, other columns are not read. Without usable labels all domains are alike; an empty table gives an empty one."""
    row = F.col(rid) if rid else F.monotonically_increasing_id()
    numbered = docs.select(row.alias("rid"), "doc_id", F.col(f"`{text_col}`").cast("string").alias("text"))
    model, prior = learn(docs, labels, list(targets), text_col=text_col)
    members = written(memberships(numbered, model, prior), "members")
    if callable(total := options.get("total")):
        options["total"] = total(members)
    return fit_rates(members, targets, **options)


def shares(mixed: DataFrame, domains: list[str] = DOMAINS) -> dict[str, float]:
    """The domains' shares of the tokens to be read."""
    read = F.col("n_tokens") * F.col("rate")
    sums = mixed.agg(*[F.coalesce(F.sum(read * F.col(f"p_{k}")), F.lit(0.0)) for k in domains]).first()
    return {k: x / (sum(sums) or 1.0) for k, x in zip(domains, sums)}


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """docs with each row as often as its rate says: its whole part, and once more with the chance of the rest, by a hash of id and text. Columns stay; see ``mix``."""
    text, rid = F.col("text"), spare_name(docs, "rid")
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    rates = mix(numbered, labels, targets, rid=rid, **options)
    often, times = spare_name(docs, "times"), spare_name(docs, "time")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(1 << 32)) / float(1 << 32)
    joined = numbered.join(rates.select(F.col("rid").alias(rid), F.col("rate").alias(often)), rid)
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.floor(F.col(often) + drawn).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label_domain().alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and rate of every row of documents; see ``mix`` for nulls, empty and long texts, repeats and other columns."""
    return mix(documents(spark, sf_dir), table_labels(spark, sf_dir)).drop("rid")
