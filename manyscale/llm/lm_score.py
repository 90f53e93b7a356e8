"""Language-model scores from a log-frequency Bloom filter.

The filter holds quantised counts of words and word pairs: an n-gram with count ``c`` is entered once for each level up to
``1 + floor(log2(c))``, so asking for level 1, 2, ... until one is missing tells its count up to a factor of two.
Every n-gram hashes to a segment, all its probes fall into that segment, and a segment's bits are built where its
n-grams are counted; only finished bits are stored and reach the driver.

Every n-gram is entered at every size, so the filter grows with the corpus, but no process holds all of it: segments are
sent in parts of ``PART`` bytes. A task holds the hashes of ``HELD`` tokens or somewhat more at a time and asks one part
after the other for the n-grams that fall into it; with a single part that part stays in memory. On disk an executor has
one copy of all parts. With ``spark.io.encryption.enabled`` Spark itself loads all parts into each worker.

Smoothing: ``p(w | v) = (count(v w) + PRIOR * p(w)) / (count(v) + PRIOR)`` with
``p(w) = (count(w) + 0.5) / (N + 0.5 (V + 1))``, counts from the filter and a pair never above its first word.

Beside the model's score there is an exact unigram score. Exact counts of frequent tokens, at most ``2 ** 20`` as each
makes up that share of all, are broadcast; the others are joined by token.

Defined results: a null or empty text is its end alone; a null key belongs to the training part; repeated rows each
give a row and count each; with nothing to learn from, N and V are 0; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyscale.llm import common
from manyscale.plans import shipping, storage

#: Stands for the end of a text, and for what precedes its first word; no word is empty.
END = b""
PROBES = 5
PRIOR = 8.0
#: The rarest share of tokens that is broadcast.
FREQUENT = 1 << 20
#: N-grams that a segment is meant to hold.
SEGMENT = 1 << 20
#: Bytes of the filter that a process holds at a time, and tokens of texts that wait for their counts meanwhile.
PART = 1 << 26
HELD = 1 << 20
#: Texts whose words a task holds at a time.
CHUNK = 500
#: Tokens that a task remembers; they are forgotten beyond that.
REMEMBERED = 500_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of tokens."""

    def __missing__(self, token: bytes) -> int:
        found = self[token] = xxhash.xxh64_intdigest(token)
        return found


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


class Places(dict):
    """Places of tokens in the order they are first met; ``fresh`` holds those that nobody has looked at yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        place = self[token] = len(self)
        self.fresh.append(token)
        return place


class Facts:
    """What a task knows of each token by its place: name, hash, count in the filter (once it is looked up), and its exact
    share if it is frequent."""

    def __init__(self, logs: dict[bytes, tuple[bool, float]]):
        self.logs = logs
        self.forget()

    def forget(self):
        self.places, self.names = Places(), []
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0)
        self.frequent, self.hits, self.shares = np.empty(0, bool), np.empty(0, np.int64), np.empty(0)

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The places of all tokens of the texts, and tokens per text."""
        tokens = [tokens_of(t) for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        at = np.fromiter((p for t in tokens for p in map(self.places.__getitem__, t)), np.int64, int(sizes.sum()))
        fresh, self.places.fresh = self.places.fresh, []
        if fresh:
            self.names += fresh
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in fresh], np.uint64)
            exact = [self.logs.get(t) for t in fresh]
            more = (hashes, np.array([e is not None for e in exact]),
                    np.array([e is not None and e[0] for e in exact], np.int64), np.array([e[1] if e else 0.0 for e in exact]))
            held = (self.hashes, self.frequent, self.hits, self.shares)
            self.hashes, self.frequent, self.hits, self.shares = (np.concatenate(p) for p in zip(held, more))
        return at, sizes

    def rare(self, at: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """For each text its tokens that are not frequent, and how often it has them."""
        open_ = ~self.frequent[at]
        keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[open_] * len(self.names) + at[open_], return_counts=True)
        ends = np.cumsum(np.bincount(keys // len(self.names), minlength=len(sizes)))
        offsets = pa.array(np.append(0, ends), pa.int32())
        names = pa.array([self.names[p] for p in keys % len(self.names)], pa.binary())
        return pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))


def paired(single: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the pairs that tokens form with what precedes them; an end stands before each text."""
    previous = np.roll(single, 1)
    starts = np.cumsum(sizes) - sizes
    previous[starts] = single[starts + sizes - 1]
    return mix(previous * GOLDEN + single)


def ngrams(texts: list, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, of the pairs that they form with what precedes them, and tokens per text."""
    if len(hashes) > REMEMBERED:
        hashes.clear()
    tokens = [tokens_of(t) for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    single = np.array([h for t in tokens for h in map(hashes.__getitem__, t)], np.uint64)
    return single, paired(single, sizes), sizes


def count_ngrams(texts: DataFrame, n_segments: int) -> DataFrame:
    """``(segment, grams, counts)``: packed hashes of pairs and of words, added up within a batch before the shuffle."""
    shift = np.uint64(64 - n_segments.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            # Words of a few hundred texts at a time become hashes; only those are kept for the whole batch.
            texts = batch.column(0)
            parts = [ngrams(texts[at:at + CHUNK].to_pylist(), hashes)[:2] for at in range(0, len(texts), CHUNK)]
            single, pairs = (np.concatenate(part) for part in zip(*parts)) if parts else (np.empty(0, np.uint64),) * 2
            segments, order, grams, counts = [], [], [], []
            for kind, values in enumerate((mix(single), pairs)):
                found, n = np.unique(values, return_counts=True)
                at = (found >> shift).astype(np.int64) if n_segments > 1 else np.zeros(len(found), np.int64)
                edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
                for a, b in zip(edges, [*edges[1:], len(at)]):
                    segments.append(int(at[a]))
                    order.append(kind)
                    # Six bytes tell apart what shares a segment.
                    grams.append(found[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                    counts.append(n[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(order, pa.int64()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())],
                                             ["segment", "kind", "grams", "counts"])

    return texts.mapInArrow(run, "segment long, kind long, grams binary, counts binary")


def positions(grams: np.ndarray, level: int, kind: int, bits: int) -> Iterator[np.ndarray]:
    """The probes of a level of n-grams, as places in a segment of ``bits`` bits (one number or one for each)."""
    seed = mix(grams + np.uint64((level * 2 + kind) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
    step = mix(seed) | np.uint64(1)
    for k in range(PROBES):
        yield ((seed + np.uint64(k) * step) >> np.uint64(16)) % bits


def build(parts: DataFrame) -> DataFrame:
    """``(segment, bits)``: the finished filter of every segment."""

    def run(key, table):
        kept = []
        for kind in (0, 1):
            rows = table.filter(pa.compute.equal(table["kind"], kind))
            raw = np.frombuffer(b"".join(rows["grams"].to_pylist()), np.uint8).reshape(-1, 6)
            grams = np.zeros((len(raw), 8), np.uint8)
            grams[:, :6] = raw
            grams = grams.view(np.uint64).ravel()
            counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), "<u4").astype(np.int64)
            found, inverse = np.unique(grams, return_inverse=True)
            total = np.bincount(inverse, counts, len(found)).astype(np.int64)
            kept.append((found, 1 + np.floor(np.log2(total)).astype(np.int64)))
        entries = sum(int(levels.sum()) for _, levels in kept)
        bits = max(64, int(np.ceil(entries * PROBES / np.log(2) / 64)) * 64)
        field = np.zeros(bits, bool)
        for kind, (found, levels) in enumerate(kept):
            for level in range(1, int(levels.max(initial=0)) + 1):
                for at in positions(found[levels >= level], level, kind, np.uint64(bits)):
                    field[at] = True
        return pa.table({"segment": [key[0].as_py()], "bits": [np.packbits(field, bitorder="little").tobytes()]})

    return parts.groupBy("segment").applyInArrow(run, "segment long, bits binary")


class Filter:
    """Segments ``first`` to ``last - 1`` of the filter, one after the other in one array of bytes."""

    def __init__(self, segments: dict[int, bytes], n_segments: int, first: int, last: int):
        self.n_segments, self.first, self.last = n_segments, first, last
        parts = [segments.get(k, bytes(8)) for k in range(first, last)]
        self.sizes = np.array([len(p) * 8 for p in parts], np.uint64)
        self.starts = np.cumsum([0] + [len(p) * 8 for p in parts[:-1]]).astype(np.uint64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def counts(self, values: np.ndarray, kind: int) -> np.ndarray:
        """Counts of n-grams, up to the width of a level; 0 for those that are not held or fall into other segments."""
        result = np.zeros(len(values))
        shift = np.uint64(64 - self.n_segments.bit_length() + 1)
        segment = (values >> shift).astype(np.int64) if self.n_segments > 1 else np.zeros(len(values), np.int64)
        grams = values & np.uint64((1 << 48) - 1)
        rows, level = np.flatnonzero((segment >= self.first) & (segment < self.last)), 0
        segment -= self.first
        while len(rows):
            level += 1
            size, start = self.sizes[segment[rows]], self.starts[segment[rows]]
            held = np.ones(len(rows), bool)
            for place in positions(grams[rows], level, kind, size):
                at = place + start
                held &= (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            rows = rows[held]
            # The middle of a level that spans a factor of two; single counts are exact.
            result[rows] = 1.0 if level == 1 else 1.5 * 2.0 ** (level - 1)
        return result


class Model:
    """The whole filter as broadcast parts, of which a process holds one at a time."""

    def __init__(self, parts: list):
        self.parts = parts

    def opened(self, sent) -> Filter:
        """A part; if there are others, the process forgets it once the caller does."""
        part = sent.value
        if len(self.parts) > 1 and getattr(sent, "_path", None):
            sent.__dict__.pop("_value", None)
        return part

    def look_up(self, asked: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
        """Counts for each ``(n-grams, kind)``; every part is opened once for all of them."""
        found = [np.zeros(len(values)) for values, _ in asked]
        for sent in self.parts:
            part = self.opened(sent)
            for result, (values, kind) in zip(found, asked):
                result += part.counts(values, kind)
            del part
        return found

    def counts(self, values: np.ndarray, kind: int) -> np.ndarray:
        return self.look_up([(values, kind)])[0]


def log10_scores(count: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, n: int, v: int) -> np.ndarray:
    """Log probabilities of texts, one after the other in the arrays, from the filter's counts of their tokens and pairs."""
    alone = (count + 0.5) / (n + 0.5 * (v + 1))
    before = np.roll(count, 1)
    starts = np.cumsum(sizes) - sizes
    # The end of a text stands before the next one's first word as well.
    before[starts] = count[np.cumsum(sizes) - 1]
    seen = np.minimum(pairs, before)
    chance = np.minimum(1.0, (seen + PRIOR * np.minimum(1.0, alone)) / (before + PRIOR))
    return np.add.reduceat(np.log10(chance), starts) if len(sizes) else np.empty(0)


def fit(train: DataFrame, n: int, text: str = "text") -> Model:
    """The filter of a table's texts, which hold ``n`` tokens."""
    spark = train.sparkSession
    shipping.ship(spark)
    n_segments = 1 << max(0, (2 * n // SEGMENT).bit_length())
    found = common.stored(build(count_ngrams(train.select(F.col(text).alias("text")), n_segments)))
    sizes = {r.segment: r.size for r in found.select("segment", F.length("bits").alias("size")).collect()}
    edges, size = [0], 0
    for k in range(n_segments):
        if size and size + sizes.get(k, 8) > PART:
            edges.append(k)
            size = 0
        size += sizes.get(k, 8)
    parts = []
    for first, last in zip(edges, [*edges[1:], n_segments]):
        rows = found.where(F.col("segment").between(first, last - 1)).collect()
        part = Filter({r.segment: r.bits for r in rows}, n_segments, first, last)
        parts.append(storage.checked_broadcast(spark, part, len(part.bytes), "a part of the language model"))
    return Model(parts)


def token_counts(docs: DataFrame, held: Column, text: str = "text") -> DataFrame:
    """``(token, c, total)``: occurrences in the training rows and in all rows."""
    shipping.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learnt, kept_out = Counter(), Counter()
            for body, held_out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (kept_out if held_out else learnt).update(tokens_of(body))
            for counts, share in ((learnt, 1), (kept_out, 0)):
                n = np.fromiter(counts.values(), np.int64, len(counts))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(n * share), pa.array(n)], ["token", "c", "total"])

    parts = docs.select(F.col(text).alias("text"), held.alias("held")).mapInArrow(run, "token binary, c long, total long")
    return parts.groupBy("token").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def score(docs: DataFrame, held: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every whole text.

    ``held`` says which rows are kept out of training. Scoring reads the documents once more and stores one row for each
    with its rarer tokens, which alone are shuffled to meet their counts.
    """
    spark = docs.sparkSession
    known = common.stored(token_counts(docs, held, text))
    n, v, everything = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    frequent = {bytes(r.token): r.c for r in known.where(F.col("total") * FREQUENT >= everything).select("token", "c").collect()}
    model = fit(docs.where(~held), n, text)
    sent = storage.checked_broadcast(spark, frequent, 64 * len(frequent), "the frequent tokens")
    floor = np.log10(n + 0.5 * (v + 1))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, times array<int>"
    fields = common.arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        facts = Facts({token: (c > 0, np.log10(c + 0.5) - floor) for token, c in sent.value.items()})
        waiting, n_waiting = [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            new, *seen = model.look_up([(mix(facts.hashes[len(facts.counts):]), 0), *((paired(facts.hashes[at], sizes), 1) for at, sizes, _ in waiting)])
            facts.counts = np.concatenate([facts.counts, new])
            for (at, sizes, columns), pairs in zip(waiting, seen):
                columns["score"] = log10_scores(facts.counts[at], pairs, sizes, n, v)
                yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in fields], schema=fields)
            waiting.clear()
            if len(facts.names) > REMEMBERED:
                facts.forget()

        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                at, sizes = facts.of(part.column(1).to_pylist())
                starts = np.cumsum(sizes) - sizes
                rare, times = facts.rare(at, sizes)
                waiting.append((at, sizes, {
                    "row": np.arange(row, row + len(sizes)), "doc_id": part.column(0), "held_out": part.column(2), "n_tokens": sizes,
                    "known": np.add.reduceat(facts.hits[at], starts), "base": np.add.reduceat(facts.shares[at], starts), "rare": rare, "times": times}))
                row, n_waiting = row + len(sizes), n_waiting + len(at)
                if n_waiting >= HELD:
                    yield from finished()
                    n_waiting = 0
        yield from finished()

    scored = common.stored(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held")).mapInArrow(run, schema))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("token"), F.col("t.times").alias("times"))
    met = rare.join(known.select("token", "c"), "token")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known2"),
                                  F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - F.lit(float(floor)))).alias("base2"))
    both = scored.drop("rare", "times").join(more, "row", "left")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"),
                       F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), "score")
