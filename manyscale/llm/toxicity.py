"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. Of the rows to learn from, at most ``SAMPLE`` for each label are taken, those with the smallest hash of their id; both
   bounds are parameters, and this sample is all that is collected or broadcast. A quarter of it calibrates, the rest are examples.
2. Terms are runs of letters, A-Z in lower case. The vocabulary is the terms whose odds of either label are ``ODDS`` times those of
   all examples, beyond ``EVIDENCE`` times what chance among so many terms allows (chi-square), at most ``TERMS``. Copies count
   as several documents, hence that factor; terms with nearly even odds only make vectors long. Examples are unit vectors of ``(1 + ln tf) ln(1 + n / df)``.
3. The index lists a term's examples in blocks of ``BLOCK`` neighbouring examples, with the greatest weight of each block.
   A text adds up those maxima into a bound for every block and visits blocks from the highest bound down, until
   no bound reaches the ``K``-th best cosine. So the neighbours are exact; equal cosines go to the smaller id.
4. Neighbours vote with ``1 / (1 - cosine + SOFT)``. Shares of the vote become probabilities by isotonic regression on the
   calibration rows, which count by how many rows each stands for. Texts without a neighbour have a class of their own there.

Scoring is one pass without a shuffle. Defined results: null and empty texts have no neighbour; rows that repeat an id are scored by their
own texts, and as an example the id has its smallest text; of several labels of an id the greatest counts, null ones never; where
only one label or none occurs, every score is that label, or 0; equal texts get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyscale.llm import common
from manyscale.plans import storage

#: Rows of one label that are learnt from, at most.
SAMPLE = 20_000
TERMS = 8192
ODDS, EVIDENCE = 3, 2
K = 15
BLOCK = 64
SOFT = 0.05
BINS = 40
#: The part of the sample, by hash of the id, that calibrates: one in so many.
CALIBRATES = 4

WORDS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text: str | None) -> list[str]:
    return WORDS.findall(text.encode().lower().decode()) if text else []


@dataclass
class Index:
    """Unit vectors of labelled examples, term by term and block by block."""

    known: dict[str, int]
    weight_of_term: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: Postings ``(example, weight)`` by term, then example; runs of one term and block, with their maxima.
    example: np.ndarray
    weight: np.ndarray
    run_start: np.ndarray
    run_block: np.ndarray
    run_most: np.ndarray
    #: First run of each term.
    term_start: np.ndarray

    @classmethod
    def build(cls, examples: list[tuple[int, int, dict[int, int]]], vocabulary: list[tuple[str, int]], n: int) -> Index:
        """From examples ``(id, label, counts of terms by their place)`` and ``(term, documents)`` among ``n`` examples."""
        known = {term: k for k, (term, _) in enumerate(vocabulary)}
        idf = np.array([math.log(1 + n / max(1, df)) for _, df in vocabulary])
        found = [unit(counts, idf) for _, _, counts in examples]
        # Examples with one leading term stand together, so that blocks have few terms.
        lead = [int(t[w.argmax()]) if len(t) else -1 for t, w in found]
        order = sorted(range(len(examples)), key=lambda k: (lead[k], examples[k][0]))
        term = np.concatenate([found[k][0] for k in order] or [np.empty(0, np.int64)])
        weight = np.concatenate([found[k][1] for k in order] or [np.empty(0)])
        example = np.repeat(np.arange(len(order)), [len(found[k][0]) for k in order])
        by = np.argsort(term, kind="stable")
        term, weight, example = term[by], weight[by], example[by]
        run = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(example // BLOCK, prepend=-1) != 0))
        return cls(known, idf, np.array([examples[k][0] for k in order], np.int64), np.array([examples[k][1] for k in order], np.int64),
                   example, weight, np.append(run, len(term)), example[run] // BLOCK,
                   np.maximum.reduceat(weight, run) if len(run) else weight, np.searchsorted(term[run], np.arange(len(known) + 1)))

    @property
    def n_bytes(self) -> int:
        return sum(a.nbytes for a in vars(self).values() if isinstance(a, np.ndarray)) + 100 * len(self.known)

    def nearest(self, text: str | None, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` best examples that share a term with the text, best first."""
        at, own = unit(term_counts(self.known, text), self.weight_of_term)
        first, last = self.term_start[at], self.term_start[at + 1]
        runs = expanded(first, last)
        if not len(runs):
            return np.empty(0, np.int64), np.empty(0)
        own = np.repeat(own, last - first)
        block = self.run_block[runs]
        n_blocks = -(-len(self.ids) // BLOCK)
        bound = np.bincount(block, own * self.run_most[runs], n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score, done, step = np.zeros(n_blocks * BLOCK), 0, max(4, -(-k // BLOCK))
        while done < len(order):
            if done:
                best = score[score > 0]
                # Bounds and scores are sums in different orders; the slack covers their rounding.
                if len(best) >= k and bound[order[done]] < np.partition(best, -k)[-k] - 1e-9:
                    break
            visit = np.zeros(n_blocks, bool)
            visit[order[done : done + step]] = True
            here = np.flatnonzero(visit[block])
            start, end = self.run_start[runs[here]], self.run_start[runs[here] + 1]
            posts = expanded(start, end)
            score += np.bincount(self.example[posts], self.weight[posts] * np.repeat(own[here], end - start), len(score))
            done, step = done + step, step * 2
        found = np.flatnonzero(score > 0)
        # Sums of the same numbers in another order differ in the last digits.
        best = found[np.lexsort((self.ids[found], -score[found].round(9)))[:k]]
        return best, np.minimum(score[best], 1.0)

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """The weighted share of toxic neighbours, -1 without any."""
        if not len(best):
            return -1.0
        weight = 1 / (1 - cosine + SOFT)
        return float(weight @ self.labels[best] / weight.sum())


def term_counts(known: dict[str, int], text: str | None) -> Counter:
    """How often each known term occurs, by its place in the vocabulary."""
    return Counter(k for t in terms(text) if (k := known.get(t)) is not None)


def unit(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order and TF-IDF weights of length one; nothing without a term."""
    if not counts:
        return np.empty(0, np.int64), np.empty(0)
    at = np.array(sorted(counts), np.int64)
    weight = (1 + np.log([counts[k] for k in at.tolist()])) * idf[at]
    return at, weight / math.sqrt(float(weight @ weight))


def expanded(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``[start, end)``, range by range."""
    sizes = end - start
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)


def bin_of(vote: float) -> int:
    """0 without a neighbour, else 1 to ``BINS``."""
    return 0 if vote < 0 else 1 + min(BINS - 1, int(vote * BINS))


def isotonic(positive: np.ndarray, total: np.ndarray, prior: float) -> np.ndarray:
    """Shares that do not fall from bin to bin (pool adjacent violators), each drawn to ``prior`` by one row."""
    pools: list[list[float]] = []
    for k, (p, t) in enumerate(zip(positive, total)):
        pools.append([p, t, 1])
        while len(pools) > 1 and pools[-2][0] * max(pools[-1][1], 1e-300) >= pools[-1][0] * max(pools[-2][1], 1e-300):
            p, t, n = pools.pop()
            pools[-1] = [pools[-1][0] + p, pools[-1][1] + t, pools[-1][2] + n]
    return np.concatenate([np.full(n, (p + prior) / (t + 1)) for p, t, n in pools])


@dataclass
class Model:
    index: Index | None
    #: Probability of each ``bin_of``.
    table: np.ndarray

    def one(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        if self.index is None:
            return float(self.table[0]), []
        best, cosine = self.index.nearest(text)
        score = float(self.table[bin_of(self.index.vote(best, cosine))])
        return score, [(int(self.index.ids[k]), float(c), int(self.index.labels[k])) for k, c in zip(best, cosine)]


def sampled(labels: DataFrame, id: str, label: str, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """``(doc_id, toxic)`` of at most ``sample`` ids of each label, and how many ids one of them stands for."""
    each = labels.where(F.col(id).isNotNull() & F.col(label).cast("int").isin(0, 1)).groupBy(F.col(id).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in each.groupBy("toxic").count().collect()}
    parts = [each.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return parts[0].union(parts[1]), {k: n / min(n, sample) for k, n in counts.items()}


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, n_terms: int = TERMS) -> Model:
    """Learn from all documents that have a label in ``labels``, through a bounded sample of them."""
    taken, stands_for = sampled(labels, id, label, sample)
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    # At most twice ``sample`` ids are broadcast.
    rows = own.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = common.stored(rows.withColumn("calibrates", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(CALIBRATES)) == 0))
    examples = rows.where("NOT calibrates")
    sizes = {r.toxic: r["count"] for r in examples.groupBy("toxic").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    prior = stands_for.get(1, 0) * positive / max(1e-300, stands_for.get(1, 0) * positive + stands_for.get(0, 0) * negative)
    if not positive or not negative:
        return Model(None, np.full(BINS + 1, prior))

    def add(sums, bodies, marks):
        for body, mark in zip(bodies, marks):
            for term in set(terms(body)):
                seen = sums.get(term, (0, 0))
                sums[term] = (seen[0] + 1, seen[1] + mark)

    spread = common.tallied(examples.select("text", "toxic"), add, "term string, n long, m long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    spread = common.stored(spread)
    total = positive + negative
    # Chi-square of a term's documents against the label.
    scale = total ** 3 / (positive * negative)
    chi = F.expr(f"CASE WHEN n < {total} THEN pow(m - n * {positive / total!r}D, 2) * {scale!r}D / (CAST(n AS DOUBLE) * ({total} - n)) ELSE 0D END")
    least = EVIDENCE * (2 * math.log(max(2, spread.count())) + 5)
    odds = F.expr(f"(m + 0.5D) / (n - m + 0.5D) * {negative / positive!r}D")
    one_sided = (odds >= ODDS) | (odds <= 1 / ODDS)
    chosen = spread.withColumn("chi", chi).where((F.col("chi") > least) & one_sided & (F.col("n") >= 3)).orderBy(F.desc("chi"), "term").limit(n_terms).select("term", "n").collect()
    vocabulary = sorted((r.term, r.n) for r in chosen)
    index = Index.build(counted(examples, vocabulary), vocabulary, total)
    sent = storage.checked_broadcast(docs.sparkSession, index, index.n_bytes, "the index of examples")

    def votes(sums, bodies, marks):
        for body, mark in zip(bodies, marks):
            key = (bin_of(sent.value.vote(*sent.value.nearest(body))), mark)
            sums[key] = (sums.get(key, (0,))[0] + 1,)

    judged = common.tallied(rows.where("calibrates").select("text", "toxic"), votes, "bin int, toxic int, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).collect()
    tally = np.zeros((BINS + 1, 2))
    for r in judged:
        tally[r.bin, r.toxic] += r.n * stands_for[r.toxic]
    alone = (tally[0, 1] + prior) / (tally[0].sum() + 1)
    return Model(index, np.append(alone, isotonic(tally[1:, 1], tally[1:].sum(1), prior)))


def counted(examples: DataFrame, vocabulary: list[tuple[str, int]]) -> list[tuple[int, int, dict[int, int]]]:
    """The examples as counts of the vocabulary's terms, at most one number for each term and example; texts stay on the executors."""
    known = {term: k for k, (term, _) in enumerate(vocabulary)}

    def work(ids, texts):
        found = [sorted(term_counts(known, t).items()) for t in texts]
        return {"doc_id": ids, "at": [[k for k, _ in f] for f in found], "n": [[n for _, n in f] for f in found]}

    marks = {r.doc_id: r.toxic for r in examples.select("doc_id", "toxic").collect()}
    rows = common.on_texts(examples, work, "doc_id long, at array<int>, n array<long>").collect()
    return [(r.doc_id, marks[r.doc_id], dict(zip(r.at, r.n))) for r in rows]


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, evidence array<struct<doc_id, cosine, toxic>>)`` of every whole text, nearest examples first."""
    size = model.table.nbytes + (model.index.n_bytes if model.index else 0)
    sent = storage.checked_broadcast(docs.sparkSession, model, size, "the index of examples")

    def work(ids, texts):
        found = [sent.value.one(t) for t in texts]
        evidence = [[{"doc_id": i, "cosine": c, "toxic": t} for i, c, t in near] for _, near in found]
        return {"doc_id": ids, "score": [s for s, _ in found], "evidence": evidence}

    return common.on_texts(docs, work, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>", id, text)
