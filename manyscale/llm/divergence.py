"""Divergence between the sources of a language, by row accumulation over a term-major index.

Terms are runs of letters (ASCII letters, and all characters beyond ASCII) with A-Z in lower case. A language keeps the terms of at
least ``LEAST_DOCUMENTS`` of its documents, ``V`` in number. A group is a language and a source. A term that occurs
``c`` times in a group of ``N`` kept occurrences has ``p = 1 + floor(SCALE * (c + 2) / (N + 2V))``; the divergence of two groups
sums ``floor((p - q)^2 / (p + q))`` over all kept terms. All numbers are whole.

1. Tasks add up occurrences and documents of each language, source and term. One shuffle by language and term gives the totals,
   the terms kept, and the rows of the term-major index, which stay where they are.
2. The index is cut into shards of terms. In a shard each group scatters its terms through the index into a dense
   accumulator with a number for every peer (Gustavson's row-wise product), so posting pairs are never emitted.
3. The accumulator starts from what the group's terms would add if no peer had them, worked out once for each distinct
   count; a peer that has the term corrects its own number. Terms that neither has add the same number each: it is
   multiplied by ``V`` at the end, and every term that one has takes it off again.
4. Shards give a number for each ordered pair of sources and the ``TOP`` terms of each group; sums and a last ranking remain.

Defined results: a null text, language or source counts as empty; groups without terms keep their rows; a language with one
source has no pairs; without documents there are no rows; columns of the input other than these three are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyscale.llm import common
from manyscale.plans import shipping

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP = 10
#: Rows of the index that a shard holds, on average.
SHARD_ROWS = 200_000

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def occurrences(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``(lang, source, term, n, docs)``, several rows for each."""

    def add(sums, langs, sources, texts):
        for key, body in zip(zip(langs, sources), texts):
            found = TERMS.findall(body.encode().lower().decode())
            if found:
                n, documents = sums[key] if key in sums else sums.setdefault(key, (Counter(), Counter()))
                n.update(found)
                documents.update(set(found))

    def columns(sums):
        for (one, other), (n, documents) in sums.items():
            terms = list(n)
            for s in range(0, len(terms), 1 << 16):
                part = terms[s : s + (1 << 16)]
                yield [pa.repeat(pa.scalar(one), len(part)), pa.repeat(pa.scalar(other), len(part)), part,
                       [n[t] for t in part], [documents[t] for t in part]]

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    return common.tallied(docs.select(*read), add, "lang string, source string, term string, n long, docs long",
                          size=lambda sums: sum(len(n) for n, _ in sums.values()), columns=columns)


def index(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n)`` of the kept terms; every row of a term is in one partition."""
    # Tasks have added up already, so what they give is dealt out once and not added up before.
    dealt = occurrences(docs, text, lang, source).repartition("lang", "term")
    parts = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = Window.partitionBy("lang", "term")
    return parts.withColumn("spread", F.sum("docs").over(spread)).where(F.col("spread") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n")


def share(counts, total: int, terms: int) -> np.ndarray:
    """``p`` of counts, in whole numbers: a long division in steps that stay within 64 bits."""
    whole, rest = np.divmod(np.asarray(counts, np.int64) + 2, np.int64(max(1, total + 2 * terms)))
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, np.int64(max(1, total + 2 * terms)))
        whole = whole * 1000 + digit
    return whole + 1


def gap(p, q) -> np.ndarray:
    """``floor((p - q)^2 / (p + q))``; shares are at most ``SCALE + 1``, so the square fits."""
    return (p - q) * (p - q) // (p + q)


def scatter(term: np.ndarray, group: np.ndarray, n: np.ndarray, totals: np.ndarray, n_terms: int):
    """Yields ``(group, base, shared)`` for each group that has a posting: numbers for every peer.

    ``base`` is what the group's terms add, beyond those that nobody has, if no peer has them; ``shared`` corrects it where peers do.
    Postings ``(term, group, n)`` are sorted by term.
    """
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    starts = np.append(starts, len(term))
    row = np.cumsum(np.diff(term, prepend=-1) != 0) - 1
    p = np.empty(len(n), np.int64)
    zero = np.array([int(share(0, int(t), n_terms)) for t in totals], np.int64)
    for g in np.unique(group):
        p[group == g] = share(n[group == g], int(totals[g]), n_terms)
    alone = gap(p, zero[group])
    for g in np.unique(group):
        mine = np.flatnonzero(group == g)
        nothing = gap(zero[g], zero)
        base = np.zeros(len(totals), np.int64)
        for value, times in zip(*np.unique(p[mine], return_counts=True)):
            base += times * (gap(value, zero) - nothing)
        shared = np.zeros(len(totals), np.int64)
        # Through the index: the postings of every term of the group.
        lengths = starts[row[mine] + 1] - starts[row[mine]]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[row[mine]], lengths)
        own, peer = np.repeat(p[mine], lengths), group[at]
        np.add.at(shared, peer, gap(own, p[at]) - gap(own, zero[peer]) - gap(zero[g], p[at]) + nothing[peer])
        yield int(g), base, shared


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: divergence from each other source, and the terms that a source has more often."""
    spark = docs.sparkSession
    shipping.ship(spark)
    rows = common.stored(index(docs, text, lang, source))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = rows.groupBy("lang").agg(F.count_distinct("term").alias("n_terms"))
    groups = docs.select(*named).distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = common.stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms")))
    n_shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    postings = rows.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(n_shards)).cast("int"))
    # Every shard has the list of the groups of its languages, which is as long as a row of the result's pairs.
    members = common.stored(groups.join(postings.select("lang", "shard").distinct(), "lang"))
    schema = "lang string, source string, part string, item string, value long"
    fields = common.arrow_schema(spark, schema)

    def work(index: pa.Table, members: pa.Table) -> pa.Table:
        members = members.sort_by("source")
        names, totals = members.column("source").to_pylist(), np.array(members.column("total").to_pylist(), np.int64)
        index = index.sort_by([("term", "ascending"), ("source", "ascending")])
        if not len(index) or not names:
            return fields.empty_table()
        n_terms, language = members.column("n_terms")[0].as_py(), members.column("lang")[0].as_py()
        words = index.column("term").combine_chunks().dictionary_encode()
        term, spelling = words.indices.to_numpy(), words.dictionary
        place = {name: k for k, name in enumerate(names)}
        group = np.array([place[s] for s in index.column("source").to_pylist()])
        n = np.array(index.column("n").to_pylist(), np.int64)
        out = {f.name: [] for f in fields}

        def give(source, part, items, values):
            for name, column in zip(out, ([language] * len(items), source, [part] * len(items), items, values)):
                out[name].extend(column)

        whole = np.zeros(len(spelling), np.int64)
        np.add.at(whole, term, n)
        q = share(whole, int(totals.sum()), n_terms)
        for g, base, shared in scatter(term, group, n, totals, n_terms):
            others = [k for k in range(len(names)) if k != g]
            give([names[g]] * len(others), "pair", [names[k] for k in others], (base + shared)[others].tolist())
            give([names[k] for k in others], "pair", [names[g]] * len(others), base[others].tolist())
            mine = np.flatnonzero(group == g)
            p, of = share(n[mine], int(totals[g]), n_terms), q[term[mine]]
            value = np.where(p > of, gap(p, of), -1)
            # Terms come sorted, so ties go to the first.
            best = [k for k in np.argsort(-value, kind="stable")[:TOP] if value[k] >= 0]
            give([names[g]] * len(best), "term", spelling.take(pa.array(term[mine][best], pa.int64())).to_pylist(), value[best].tolist())
        return pa.table([pa.array(out[f.name], f.type) for f in fields], schema=fields)

    found = common.stored(postings.groupBy("lang", "shard").cogroup(members.groupBy("lang", "shard")).applyInArrow(work, schema))
    # What two groups differ by in a term that neither has, times all terms, for every pair.
    one = groups.select("lang", "source", F.col("total").alias("a"), "n_terms")
    two = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("b"))
    nothing = lambda total: F.expr(f"1 + (2L * {SCALE}L) div greatest(1L, {total} + 2L * n_terms)")
    pairs = one.join(two, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", nothing("a").alias("p"), nothing("b").alias("q"), "n_terms")
    pairs = pairs.select("lang", "source", "part", "item", F.expr("n_terms * ((p - q) * (p - q) div (p + q))").alias("value"))
    summed = pairs.union(found.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return summed.withColumn("rank", F.row_number().over(order)).union(terms)
