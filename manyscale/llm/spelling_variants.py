"""Spelling variants: words one edit apart, found by bidirectional search schemes over an index of the vocabulary.

The vocabulary is written as one text ``$w1$w2...$wk`` of sorted words, closed to a ring. Its rotations in order are the
ranks of an FM-index; a second one holds the words read backwards. A pattern is an interval of ranks in each, of the same
size, and grows by one letter at either end in a step. As ``$`` ends every word, the interval of ``$w$`` is one rank, which
is the word's place in the vocabulary.

1. Two words one edit apart share the first or the second half of either. Scheme one matches ``$`` and a word's first half
   exactly and then extends it to the right, allowing one inserted, deleted or replaced letter; scheme two does the same
   from the second half to the left. An edit within a run of one letter is taken at the run's last place, so each scheme
   finds a word once; scheme two leaves out what begins with the word's first half, which scheme one finds.
2. Halves have at least three letters, so words of one first (last) three letters only meet words of the same. These
   groups are dealt out to shards of about ``SHARD`` letters; each builds its index. A group of more than ``HOT`` letters is cut
   into blocks, and every block of its words is asked in the index of every block.
3. A shard counts a word's neighbours and keeps the best of them, so no pair leaves it. Sums and maxima over the shards
   give a word's form; as a form has five times the count of its word, chains are short, and doubling steps find their ends.

Defined results: null texts have no words; a null id counts as an empty one; rows that repeat an id or text all count; equal
counts are decided by code-point order; no words give no rows. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyscale.llm import common
from manyscale.plans import shipping

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: How many times as frequent as a word its form is.
RATIO = 5
#: Every so many (document, word) hashes lose a letter.
DAMAGED = 199
#: Letters of the words of a shard, and of the words with one beginning or end that are not cut into blocks.
SHARD, HOT = 250_000, 1_000_000
EDGE = LEAST_LETTERS // 2
BLOCK = 64
#: Ranks of an interval up to which its next letters are read off one by one.
FEW = 16
#: Queries that are searched together.
TOGETHER = 20_000

RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def spelt(doc_id, run: str) -> str:
    """The word that a run of letters in lower case counts as in a document."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % DAMAGED else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences; tasks add up first."""

    def add(sums, ids, texts):
        for doc_id, body in zip(ids, texts):
            # Lower-casing bytes changes A-Z alone.
            for run in RUNS.findall(body.encode().lower().decode()):
                word = spelt(doc_id, run)
                sums[word] = sums.get(word, 0) + 1

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    found = common.tallied(rows, add, "word string, n long").where(F.length("word") >= LEAST_LETTERS)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Ranks:
    """Rotations of ``$w1$w2...$wk`` in order, and how often smaller letters precede a rank. ``$`` has code 0."""

    def __init__(self, words: list[str], letters: np.ndarray):
        text = np.searchsorted(letters, np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), np.uint32)).astype(np.uint8)
        n, ends = len(text), np.flatnonzero(text == 0)
        word = np.cumsum(text == 0) - 1
        follows = np.where(text == 0, word, (word + 1) % len(ends))
        to_end = np.where(text == 0, 0, np.append(ends, n)[word + 1] - np.arange(n))
        rank, k = text.astype(np.int64), 1
        while k <= to_end.max():
            after = np.where(to_end >= k, rank[(np.arange(n) + k) % n], 0)
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            k *= 2
        order = np.lexsort((follows, rank))
        before = text[order - 1]
        n_letters = len(letters)
        blocks = -(-n // BLOCK) + 1
        self.letters = np.full(blocks * BLOCK, n_letters, np.uint8)
        self.letters[:n] = before
        counts = np.bincount(np.arange(n) // BLOCK * n_letters + before, minlength=blocks * n_letters).reshape(blocks, n_letters)
        smaller = np.zeros((blocks + 1, n_letters + 1), np.int32)
        smaller[1:, 1:] = counts.cumsum(0).cumsum(1)
        self.smaller, self.rows = smaller, self.letters.reshape(blocks, BLOCK)
        self.first = smaller[blocks]

    def before(self, rank: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the letters that precede the ranks below ``rank`` are smaller than ``letter``, and how many not greater."""
        block = rank // BLOCK
        row = self.rows[block]
        here = np.arange(BLOCK, dtype=np.uint8) < (rank % BLOCK).astype(np.uint8)[:, None]
        code = letter.astype(np.uint8)[:, None]
        less = (here & (row < code)).sum(1, dtype=np.int32)
        same = (here & (row == code)).sum(1, dtype=np.int32)
        below = self.smaller[block, letter] + less
        return below, self.smaller[block, letter + 1] + less + same


@dataclass
class States:
    """Queries with the interval of what is matched: ``size`` ranks from ``lo`` at the end that grows and ``other`` at the other end."""

    query: np.ndarray
    lo: np.ndarray
    other: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> States:
        return States(self.query[at], self.lo[at], self.other[at], self.size[at])

    def plus(self, more: States) -> States:
        return States(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(more).values())))


def grown(states: States, letter: np.ndarray, ranks: Ranks) -> States:
    """The states with one more letter at the growing end; empty intervals stay in with size 0."""
    below, upto = ranks.before(states.lo, letter)
    below_end, upto_end = ranks.before(states.lo + states.size, letter)
    size = (upto_end - below_end) - (upto - below)
    return States(states.query, ranks.first[letter] + upto - below, states.other + below_end - below, size)


def next_letters(states: States, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """``(state, letter)`` of the letters, other than ``$``, with which a state can grow."""
    n_letters = ranks.smaller.shape[1] - 1
    few = np.flatnonzero(states.size <= FEW)
    sizes = states.size[few]
    state = np.repeat(few, sizes)
    rank = np.arange(len(state)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + states.lo[state]
    many = np.flatnonzero(states.size > FEW)
    pairs = np.concatenate([np.unique(state * n_letters + ranks.letters[rank]), (many[:, None] * n_letters + np.arange(1, n_letters)).ravel()])
    pairs = pairs[pairs % n_letters > 0]
    return pairs // n_letters, pairs % n_letters


class Vocabulary:
    """A bidirectional FM-index of distinct words in code-point order."""

    def __init__(self, words: list[str]):
        self.words = words
        self.alphabet = np.unique(np.frombuffer(("\0" + "".join(words)).encode("utf-32-le"), np.uint32))
        self.forward = Ranks(words, self.alphabet)
        self.backward = Ranks(sorted(w[::-1] for w in words), self.alphabet)

    def coded(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The letters of the queries one after the other and where each begins; a letter that no word has is the last code."""
        codes = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet)), np.cumsum([0, *map(len, queries)])

    def search(self, queries: list[str], from_start: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)``: words one edit away that share a query's first half, or second half unless ``from_start``."""
        found = [self._search(queries[s : s + TOGETHER], from_start, s) for s in range(0, len(queries), TOGETHER)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))

    def _search(self, queries: list[str], from_start: bool, offset: int) -> tuple[np.ndarray, np.ndarray]:
        ranks, n_letters = (self.backward if from_start else self.forward), len(self.alphabet)
        codes, starts = self.coded(queries if from_start else [q[::-1] for q in queries])
        lengths = np.diff(starts)
        halves = lengths // 2 if from_start else lengths - lengths // 2
        zero = np.zeros(len(queries), np.int64)
        exact = States(np.arange(len(queries)), zero, zero, zero + len(self.words))

        def read(states, at, letter):
            """Grow by given letters, leaving out states that end."""
            known = np.flatnonzero(letter < n_letters)
            new = grown(states.take(known), letter[known], ranks)
            alive = new.size > 0
            return new.take(alive), at[known][alive]

        for k in range(int(halves.max(initial=0))):
            more = halves[exact.query] > k
            new, _ = read(exact.take(more), zero[exact.query[more]], codes[starts[exact.query[more]] + k])
            exact = exact.take(~more).plus(new)
        edited, hits, k = exact.take(zero[:0]), [], 0
        while len(exact.query) or len(edited.query):
            place = halves[exact.query] + k
            ended = place == lengths[exact.query]
            wanted = np.where(ended, n_letters, codes[np.minimum(starts[exact.query] + place, len(codes) - 1)])
            state, letter = next_letters(exact, ranks)
            child = grown(exact.take(state), letter, ranks)
            same, last = letter == wanted[state], ended[state]
            # An inserted letter: the place in the query stays.
            edited = edited.plus(child.take(~same & (child.size > 0)))
            at = halves[edited.query] + k
            over = at == lengths[edited.query]
            done, _ = read(edited.take(over), at[over], zero[edited.query[over]])
            hits.append((done.query, done.other if from_start else done.lo))
            edited, at = edited.take(~over), at[~over]
            edited, _ = read(edited, at, codes[starts[edited.query] + at])
            # A replaced letter, and a deleted one at the last place of its run.
            following = np.where(place + 1 < lengths[exact.query], codes[np.minimum(starts[exact.query] + place + 1, len(codes) - 1)], n_letters + 1)
            edited = edited.plus(child.take(~same & ~last & (child.size > 0))).plus(exact.take(~ended & (wanted != following)))
            exact = child.take(same & ~last & (child.size > 0))
            k += 1
        query, word = (np.concatenate([h[j] for h in hits]) if hits else zero[:0] for j in (0, 1))
        if not from_start:
            first = np.array([self.words[w][: lengths[q] // 2] != queries[q][: lengths[q] // 2] for q, w in zip(query, word)], bool)
            query, word = query[first], word[first]
        return query + offset, word


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, best struct<least, word>)`` of ``words(word, n)``; ``least`` is the negative count of the best neighbour."""
    spark = words.sparkSession
    shipping.ship(spark)
    edges = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(True).alias("from_start"), F.substring("word", 1, EDGE).alias("edge")),
        F.struct(F.lit(False).alias("from_start"), F.expr(f"right(word, {EDGE})").alias("edge")))).alias("e")).select("word", "n", "e.*")
    sizes = edges.groupBy("from_start", "edge").agg(F.sum(F.length("word") + 1).alias("letters"))
    shards = max(1, math.ceil((sizes.where("from_start").agg(F.sum("letters")).first()[0] or 0) / SHARD))
    # At most one group in HOT letters of the vocabulary is in this table.
    hot = sizes.where(F.col("letters") > HOT).select("from_start", "edge", F.ceil(F.col("letters") / HOT).cast("int").alias("cuts"))
    dealt = edges.join(F.broadcast(hot), ["from_start", "edge"], "left")

    def own() -> Column:
        return F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")

    cut = F.col("cuts").isNotNull()
    light = dealt.where(~cut).select("from_start", F.lit("").alias("edge"), F.pmod(F.xxhash64("edge"), F.lit(shards)).cast("int").alias("block"),
                                     F.lit(0).alias("asking"), "word", "n", F.lit(True).alias("held"), F.lit(True).alias("asked"))
    heavy = dealt.where(cut).withColumn("b", F.explode(F.expr("sequence(0, cuts - 1)")))
    held = heavy.select("from_start", "edge", own().alias("block"), F.col("b").alias("asking"), "word", "n", F.lit(True).alias("held"), F.lit(False).alias("asked"))
    asked = heavy.select("from_start", "edge", F.col("b").alias("block"), own().alias("asking"), "word", "n", F.lit(False).alias("held"), F.lit(True).alias("asked"))
    schema = "word string, n_near long, best struct<least: long, word: string>"
    fields = common.arrow_schema(spark, schema)

    def search(table: pa.Table) -> pa.Table:
        rows = table.select(["word", "n", "held", "asked"]).to_pylist()
        known = sorted((r["word"], r["n"]) for r in rows if r["held"])
        queries = [r["word"] for r in rows if r["asked"]]
        if not known or not queries:
            return fields.empty_table()
        counts = np.array([n for _, n in known])
        query, word = Vocabulary([w for w, _ in known]).search(queries, table.column("from_start")[0].as_py())
        order = np.lexsort((word, -counts[word], query))
        query, word = query[order], word[order]
        lead = np.flatnonzero(np.diff(query, prepend=-1))
        near = np.diff(np.append(lead, len(query)))
        best = [{"least": -int(counts[w]), "word": known[w][0]} for w in word[lead]]
        return pa.Table.from_arrays([pa.array([queries[q] for q in query[lead]], pa.string()), pa.array(near, pa.int64()), pa.array(best, fields.field("best").type)], schema=fields)

    found = light.union(held).union(asked).groupBy("from_start", "edge", "block", "asking").applyInArrow(search, schema)
    none = F.lit(None).cast("struct<least: long, word: string>")
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best")).union(
        found.select("word", F.lit(None).cast("long"), "n_near", "best"))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the vocabulary."""
    found = neighbours(common.stored(vocabulary(docs, id, text)))
    best_n = -F.col("best.least")
    frequent = best_n >= RATIO * F.col("n")
    rows = common.stored(found.select("word", F.when(frequent, F.col("best.word")).alias("form"), "n", "n_near", F.when(frequent, best_n).alias("form_n")))
    top = rows.agg(F.max("n")).first()[0] or 1
    ends = rows.where("form IS NOT NULL").select("word", F.col("form").alias("end"))
    # A chain has at most one step for each factor of RATIO; every round doubles the steps taken.
    for _ in range(math.ceil(math.log2(max(2.0, math.log(top, RATIO) + 1)))):
        further = ends.select(F.col("word").alias("end"), F.col("end").alias("beyond"))
        ends = common.stored(ends.join(further, "end", "left").select("word", F.coalesce("beyond", "end").alias("end")))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
