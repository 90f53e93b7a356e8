"""Near-duplicate groups by SimHash, found at the anchors of a covering code.

A fingerprint has 64 bits. Two that differ in at most ``radius`` bits differ in at most ``radius // 2`` bits in one of
their halves of 32 bits. Anchors of a half are the words of a linear code with ``2 ** 21`` words: the binary Golay code on
23 bits beside 9 free bits. Its covering radius is 3, so every half has a home anchor within 3 bits; a fingerprint that
lies ``t`` bits from another in that half is within ``3 + t`` of the other's home. So every fingerprint goes to all
anchors within 5 bits (119 on average in each half), and those that meet their partner's home there are compared.

Equal texts and equal fingerprints are one row before that. Comparing at an anchor adds up linked rows into local
groups, so a dense cluster gives one link per row and not all its pairs. Groups over anchors come from repeated
star contraction of the links.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; a null ``doc_id`` is in its
group but does not name it; repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyscale.llm import common
from manyscale.plans import shipping

SHINGLE = 4
RADIUS = 4
COVERING = 3
#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
#: Copies of a fingerprint that a task of the comparison is meant to hold.
TASK_ROWS = 4_000_000
#: Home and member pairs at an anchor beyond which rows are linked group by group and not pair by pair.
PAIRS = 1 << 14


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    hashes = [digest(joined[a:b - 1], 42) for a, b in zip(starts, ends[size - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.array(hashes[at:at + (1 << 15)], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of the lower 23 bits by the code's polynomial; zero for the words of the code."""
    rest = words & ((1 << 23) - 1)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


class Anchors:
    """For every syndrome, the error patterns of up to ``reach`` bits that lead from a word to an anchor."""

    def __init__(self, reach: int):
        patterns = np.array([sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(32), k)], np.int64)
        keys = syndromes(patterns)
        weight = np.bitwise_count(patterns)
        order = np.lexsort((patterns, weight, keys))
        self.patterns, keys, weight = patterns[order], keys[order], weight[order]
        self.first = np.searchsorted(keys, np.arange(1 << 11))
        self.count = np.diff(np.append(self.first, len(keys)))

    def around(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchors and whether the anchor is the row's home (its nearest), for all anchors in reach."""
        keys = syndromes(half)
        counts = self.count[keys]
        row = np.repeat(np.arange(len(half)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        return row, half[row] ^ self.patterns[self.first[keys][row] + place], place == 0


_anchors: dict[int, Anchors] = {}


def anchors(reach: int) -> Anchors:
    if reach not in _anchors:
        _anchors[reach] = Anchors(reach)
    return _anchors[reach]


def replicate(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor key, fingerprint, home)`` of every copy; the key holds the half and the anchor."""
    out = []
    for side in (0, 1):
        half = (values >> (32 * side)) & 0xFFFFFFFF
        row, anchor, home = anchors(COVERING + radius // 2).around(half)
        out.append((anchor | side << 32, values[row], home))
    return tuple(np.concatenate(part) for part in zip(*out))


def linked(keys: np.ndarray, values: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of every anchor: each linked row with the smallest of its local group, or pairs."""
    order = np.lexsort((values, keys))
    keys, values, home = keys[order], values[order], home[order]
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edges, len(keys)))
    homes = np.add.reduceat(home.astype(np.int64), edges) if len(edges) else edges
    found = []
    # Small anchors: every home against every row there, all anchors at once.
    group = np.repeat(np.arange(len(edges)), sizes)
    small = (homes * sizes <= PAIRS) & (homes > 0) & (sizes > 1)
    rows = np.flatnonzero(home & small[group])
    for part in np.array_split(rows, max(1, int(sizes[group[rows]].sum() >> 22))):
        n = sizes[group[part]]
        a = np.repeat(part, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edges[group[part]], n)
        near = (differing(values[a], values[b]) <= radius) & (a != b)
        found.append(np.stack([values[a[near]], values[b[near]]]))
    for g in np.flatnonzero(homes * sizes > PAIRS):
        found.append(local_groups(values[edges[g]:edges[g] + sizes[g]], radius))
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    pairs = np.unique(np.stack([pairs.max(0), pairs.min(0)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def differing(a: np.ndarray, b) -> np.ndarray:
    """Bits in which signed 64-bit integers differ."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def local_groups(values: np.ndarray, radius: int) -> np.ndarray:
    """Each row but the first of a local group with that first; a row leaves the search once it is reached."""
    left, found = values, []
    while len(left):
        first, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = differing(left, queue.pop()) <= radius
            reached, left = left[near], left[~near]
            queue.extend(reached)
            found.append(np.stack([reached, np.full(len(reached), first)]))
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)`` with ``a > b``: links that connect all fingerprints (signed 64-bit) within ``radius`` bits.

    The one shuffle deals copies out by anchor, to as many tasks as keep ``TASK_ROWS`` copies each.
    """
    spark = prints.sparkSession
    shipping.ship(spark)
    copies = 2 * len(anchors(COVERING + radius // 2).patterns) / (1 << 11)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(prints.count() * copies / TASK_ROWS) + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2000):
                keys, own, home = replicate(values[at:at + 2000], radius)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), pa.array(home)], ["anchor", "print", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if columns:
            a, b = linked(*(np.concatenate(c) for c in zip(*columns)), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    copied = prints.select("print").mapInArrow(spread, "anchor long, print long, home boolean")
    return copied.repartition(parts, "anchor").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links: the smallest node that can be reached.

    Large-star and small-star steps alternate; each round is stored, and it ends when a round changes no link.
    """
    edges = common.stored(edges)
    while True:
        # Every node passes its smallest neighbour on to its larger neighbours, then to its smaller ones.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        fresh = common.stored(small.select("e.a", "e.b").where("a > b").distinct())
        # A star has each node once on the left, and its centre never there.
        changed = fresh.join(edges, ["a", "b"], "left_anti").limit(1).count() or edges.join(fresh, ["a", "b"], "left_anti").limit(1).count()
        edges = fresh
        if not changed:
            roots = edges.groupBy("a").agg(F.min("b").alias("root"))
            return roots.select(F.col("a").alias("node"), "root")


def rooted(prints: DataFrame, radius: int) -> DataFrame:
    """``(print, least)`` with ``root``, the smallest fingerprint that links lead to."""
    roots = components(links(prints.select("print"), radius))
    return prints.join(roots, prints["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))


def row_key(id: str = "doc_id", text: str = "text") -> Column:
    """``(none, id, body)``: the id, null ids last, with a hash of the text. Only rows that repeat both share it."""
    return F.struct(F.col(id).isNull().alias("none"), F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("body"))


def representatives(docs: DataFrame, radius: int = RADIUS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(none, id, body)``: for each group the least ``row_key``, whether ids are null, repeated or neither."""

    def work(ids, texts):
        # The hash of row_key(): Spark's has seed 42 and passes over a null.
        bodies = [42 if t is None else xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in texts]
        return {"doc_id": ids, "body": np.array(bodies, np.uint64).view(np.int64), "print": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    marked = common.stored(common.on_texts(docs, work, "doc_id long, body long, print long", id, text))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "body")
    prints = marked.groupBy("print").agg(F.min(key).alias("least"))
    return rooted(prints, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.*")


def groups(docs: DataFrame, radius: int = RADIUS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every whole text: 16 hexadecimal digits, and the smallest ``doc_id`` of
    the documents that links lead to."""

    def work(ids, texts):
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return {"doc_id": ids, "print": values}

    marked = common.stored(common.on_texts(docs, work, "doc_id long, print long", id, text))
    prints = marked.groupBy("print").agg(F.min("doc_id").alias("least"))
    classes = rooted(prints, radius)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    # Fingerprints outside any link name themselves; only linked ones need the second join.
    classes = common.stored(classes.join(named, "root").select("print", "component_id"))
    return marked.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
