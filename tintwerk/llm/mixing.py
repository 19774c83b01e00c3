"""Mixing sources to target weights by soft membership.

A classifier learnt from a labelled table (texts with their domain) gives every document its posterior over the domains:
multinomial naive Bayes over ``BUCKETS`` hashed words, its evidence tempered to at most ``EVIDENCE`` words, so that the
membership stays soft. Training reads a bounded, documented sample (``SAMPLE`` labelled rows of least hash); the counts
are summed by Spark.

A document's rate says how many times it should stand in the mixture. The rates r >= 0 minimise

    |M^-1/2 (sum_i r_i t_i p_i - T)|^2     (t: tokens, p: posterior, T: target tokens of each domain)

by projected gradient from r = 1, preconditioned by M = sum_i t_i p_i p_i^T and 1/t_i. Every step is one aggregate of some K^2 sums
over all documents (more where it has to be halved): a document's rate is a fold over the K-vectors of the steps so far, so nothing but these is kept.
With a ``floor`` above 0 no rate falls below it: at 1 every document stays and the mixture is reached by copies alone.
A target that no rates reach (soft domains, or a floor) leaves a shortfall, which the report of ``mix`` states.
The tokens of a long document weigh more, its rate doesn't. Documents of the same posterior have the same rate.

Defined cases: null and empty texts have 0 tokens, the labelled rows' shares as posterior and a rate like others; a domain
without tokens gets none (its target is shared among the others); rows without a domain aren't learnt from; without any
labelled row there is one domain-less posterior and all rates are 1; repeated rows each count; extra columns are ignored;
an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwerk.llm import _bytes as by
from tintwerk.llm._work import written

SAMPLE = 8_000
BUCKETS = 4096
EVIDENCE = 8.0
STEPS = 100
ENOUGH = 1e-4


@dataclass
class Domains:
    names: list[str]
    prior: np.ndarray  # logarithms
    weights: np.ndarray  # (BUCKETS, domains), logarithms

    def posterior(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, (rows, domains) posteriors) of the texts."""
        _, _, h, at = by.words(data, offsets)
        n = np.diff(at)
        sums = np.zeros((len(h) + 1, len(self.names)))
        np.cumsum(self.weights[(h % by.U(BUCKETS)).astype(np.int64)], axis=0, out=sums[1:])
        mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None]
        logit = self.prior + mean * np.minimum(n, EVIDENCE)[:, None]
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        return n, p / p.sum(1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, domain: str = "domain", sample: int = SAMPLE) -> Domains:
    """From the rows of ``docs`` (doc_id, text and the column named by ``domain``) that ``labels`` (doc_id) points at."""
    chosen = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("h")).distinct()
    chosen = F.broadcast(written(chosen.orderBy("h", "doc_id").limit(sample), "labels"))  # at most ``sample`` rows of 16 bytes
    rows = docs.where(F.col(domain).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(domain).cast("string").alias("domain"))
    rows = rows.join(chosen, "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = by.texts(b.column(0))
            _, _, h, at = by.words(data, offsets)
            bucket = (h % by.U(BUCKETS)).astype(np.int64)
            for k, domain in enumerate(b.column(1).to_pylist()):
                own = found.setdefault(domain, np.zeros(BUCKETS + 1))
                own += np.bincount(np.append(bucket[at[k] : at[k + 1]], BUCKETS), minlength=BUCKETS + 1)
        for domain, own in found.items():
            where = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([domain] * len(where)), pa.array(where.astype(np.int32)), pa.array(own[where])], ["domain", "bucket", "n"])

    counts = rows.select("text", "domain").mapInArrow(count, "domain string, bucket int, n double").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()  # domains x BUCKETS
    names = sorted(counts["domain"].unique())
    table = np.zeros((BUCKETS + 1, len(names)))
    table[counts["bucket"], [names.index(d) for d in counts["domain"]]] = counts["n"]
    if not names:
        return Domains(["all"], np.zeros(1), np.zeros((BUCKETS, 1)))
    words = table[:-1] + 0.5
    return Domains(names, np.log(table[-1] / table[-1].sum()), np.log(words / words.sum(0)))


def memberships(docs: DataFrame, domains: Domains) -> DataFrame:
    """``doc_id, n_tokens, posterior`` (an array in the order of ``domains.names``) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(domains.names)
        for b in batches:
            data, offsets = by.texts(b.column(1))
            for i, j in by.slices(offsets):
                n, p = domains.posterior(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(np.arange(0, p.size + 1, k, dtype=np.int32), pa.array(p.ravel()))], ["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def rate_of(posterior: Column, steps: list[np.ndarray], floor: float = 0.0) -> Column:
    """The rate after the given steps: each takes posterior . step away and cuts at the floor."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    vectors = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(vectors, F.lit(1.0), lambda r, s: F.greatest(F.lit(floor), r - F.aggregate(F.zip_with(posterior, s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)))


def fit(members: DataFrame, target: np.ndarray, floor: float = 0.0, most: int = STEPS, enough: float = ENOUGH) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of the projected gradient and the domain tokens they reach. ``target``: tokens of each domain.

    A step is preconditioned by the documents that aren't held at the floor; one that doesn't come nearer is halved. It ends where the target is
    reached (``enough``, as a share) or no step comes nearer any more: then the tokens reached are the nearest there are. An end
    before that, after ``most`` aggregates, raises.
    """
    k = len(target)
    p = [F.col("posterior")[i] for i in range(k)]
    t = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]

    def measured(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each domain, and M over the documents above the floor (all, before the first step)."""
        free = F.when(F.col("r") > floor, t).otherwise(0.0) if steps else t
        rows = members.select("n_tokens", "posterior", rate_of(F.col("posterior"), steps, floor).alias("r"))
        row = rows.agg(*[F.sum(F.col("r") * t * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
        return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), m

    scale = max(float(target.sum()), 1.0)
    steps: list[np.ndarray] = []
    sums, m = measured(steps)
    whole = np.linalg.pinv(m, rcond=1e-9, hermitian=True)
    far = lambda s: float((s - target) @ whole @ (s - target))
    slow = 0
    for _ in range(most):
        if np.abs(sums - target).sum() <= enough * scale or slow == 3:
            return steps, sums
        step = np.linalg.pinv(m, rcond=1e-9, hermitian=True) @ (sums - target)
        if slow == 2 or not np.abs(step).sum():  # a last try in the plain direction
            step = whole @ (sums - target)
        for _ in range(6):
            new, m_new = measured([*steps, step])
            if far(new) < far(sums):
                break
            step = step / 2
        slow = slow + 1 if far(new) > (1 - 1e-3) * far(sums) else 0
        if far(new) < far(sums):
            steps, sums, m = [*steps, step], new, m_new
    raise RuntimeError(f"rates not found in {most} steps: {sums} of {target}")


def targets(weights: dict[str, float], names: list[str], tokens: np.ndarray, total: float | None = None) -> np.ndarray:
    """Target tokens of each domain: ``total`` (all tokens there are, unless given) by weight, among the domains with tokens.

    ``total=None`` with weights keeps the size of the corpus. A total of ``inf`` is the least at which no domain shrinks.
    """
    w = np.array([max(0.0, weights.get(n, 0.0)) for n in names]) * (tokens > 0)
    if not w.sum():
        return tokens.astype(float)
    w = w / w.sum()
    if total == float("inf"):
        total = float((tokens[w > 0] / w[w > 0]).max())
    return w * (tokens.sum() if total is None else total)


def _fitted(members: DataFrame, domains: Domains, weights: dict[str, float], total: float | None, floor: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The steps, and for each domain its target and the tokens reached."""
    k = len(domains.names)
    row = members.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in range(k)]).first()
    tokens = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
    target = targets(weights, domains.names, tokens, total)
    steps, reached = fit(members, target, floor)
    return steps, target, reached


def mix(docs: DataFrame, domains: Domains, weights: dict[str, float], total: float | None = None, floor: float = 0.0) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(``doc_id, n_tokens, posterior, rate`` of each row; for each domain its target and the tokens reached)."""
    members = written(memberships(docs, domains), "memberships")
    steps, target, reached = _fitted(members, domains, weights, total, floor)
    return members.withColumn("rate", rate_of(F.col("posterior"), steps, floor)), {n: (float(a), float(b)) for n, a, b in zip(domains.names, target, reached, strict=True)}


def resampled(docs: DataFrame, domains: Domains, weights: dict[str, float], total: float | None = None, floor: float = 0.0) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part surely, the rest by a hash of the row's doc_id and text."""
    names = docs.columns
    steps, _, _ = _fitted(written(memberships(docs, domains), "memberships"), domains, weights, total, floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = by.texts(b.column(names.index("text")))
            ids = np.array(b.column(names.index("doc_id")).cast(pa.int64()).fill_null(-1), np.int64)
            copies = []
            for i, j in by.slices(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, p = domains.posterior(own, at)
                rate = np.ones(j - i)
                for s in steps:
                    rate = np.maximum(floor, rate - p @ s)
                draw = by.mixed(ids[i:j].view(by.U) ^ by.Prefix(own).hashes(at[:-1], at[1:])) >> by.U(11)
                copies.append(np.floor(rate + 1e-9) + (draw / float(1 << 53) < rate + 1e-9 - np.floor(rate + 1e-9)))
            yield b.take(pa.array(np.repeat(np.arange(b.num_rows), np.concatenate(copies).astype(np.int64)))) if copies else b

    return docs.mapInArrow(run, docs.schema)
