"""Byte-level BPE encoding and decoding by replaying merges over a corpus.

A task takes the distinct pre-tokens of its texts as one corpus. An inverted index leads from each pair of
neighbouring tokens to the places where it stands; merges are applied in rank order, each at all its places at once,
and only the neighbours of a merged place are entered anew. Texts then take the ids of their pre-tokens. Where a merge
brings up a pair of lower rank, which rank order alone would apply too late, the pre-token is merged by itself.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows each give a row; an empty
table gives none. Text that no token covers cannot occur: every byte is a token.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from manyscale.llm import common

#: Entries and letters of a task's memory of pieces; it is emptied beyond that.
REMEMBERED, LETTERS = 1_000_000, 16_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged_alone(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one byte string by its lowest pair, leftmost first, again and again."""
    return [ranks[part] for part in common.merged([token[i:i + 1] for i in range(len(token))], lambda a, b: ranks.get(a + b))]


class Index:
    """Places of every pair of neighbouring tokens, by the rank of the token they merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {rank: token for token, rank in ranks.items()}
        self.places: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.waiting: list[int] = []
        self.known: dict[int, int | None] = {}

    def enter(self, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Note that tokens ``left`` and ``right`` stand at ``places``; returns what can merge, by rank."""
        real = (left >= 0) & (right >= 0)
        codes = left[real] << 32 | right[real]
        order = np.argsort(codes, kind="stable")
        codes, places, noted = codes[order], places[real][order], []
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for start, stop in zip(edges, edges[1:]):
            if start == stop:
                continue
            code = int(codes[start])
            if code not in self.known:
                self.known[code] = self.ranks.get(self.bytes[code >> 32] + self.bytes[code & 0xFFFFFFFF])
            rank = self.known[code]
            if rank is not None:
                if rank not in self.places:
                    self.places[rank] = []
                    heapq.heappush(self.waiting, rank)
                self.places[rank].append((places[start:stop], code))
                noted.append((rank, places[start:stop]))
        return noted

    def lowest(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The lowest rank that is left, its places in order, and the pair expected at each."""
        rank = heapq.heappop(self.waiting)
        found = self.places.pop(rank)
        places = np.concatenate([at for at, _ in found])
        codes = np.repeat(np.array([code for _, code in found]), [len(at) for at, _ in found])
        order = np.argsort(places, kind="stable")
        return rank, places[order], codes[order]


def replay(tokens: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each byte string after all merges; one array holds all strings, with -1 after each."""
    single = np.array([ranks.get(bytes((b,)), -1) for b in range(256)], np.int64)
    sizes = np.array([len(t) for t in tokens], np.int64)
    string = np.repeat(np.arange(len(tokens)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.full(len(string), -1, np.int64)
    body = np.ones(len(string), bool)
    body[ends] = False
    symbols[body] = single[np.frombuffer(b"".join(tokens), np.uint8)]
    after, before = np.arange(1, len(string) + 1), np.arange(-1, len(string) - 1)
    index, odd = Index(ranks), set()
    if len(string):
        index.enter(np.arange(len(string) - 1), symbols[:-1], symbols[1:])
    while index.waiting:
        rank, left, codes = index.lowest()
        right = after[left]
        # A separator is never left of a pair, so a right neighbour always exists for a pair that still stands.
        valid = (symbols[left] << 32 | symbols[np.minimum(right, len(symbols) - 1)]) == codes
        valid[1:] &= ~((left[1:] == left[:-1]) & (codes[1:] == codes[:-1]))
        left, right = left[valid], right[valid]
        touching = np.flatnonzero(right[:-1] == left[1:])
        if len(touching):
            keep = np.ones(len(left), bool)
            for i in touching.tolist():
                if keep[i]:
                    keep[i + 1] = False
            left, right = left[keep], right[keep]
        if not len(left):
            continue
        beyond = after[right]
        symbols[left], symbols[right] = rank, -1
        after[left], before[beyond] = beyond, left
        previous = before[left]
        noted = index.enter(previous[previous >= 0], symbols[previous[previous >= 0]], symbols[left[previous >= 0]])
        noted += index.enter(left, symbols[left], symbols[beyond])
        for new, places in noted:
            if new <= rank:  # a lower pair came up late: such strings are merged alone below
                odd.update(string[places].tolist())
    live = symbols >= 0
    ids = np.split(symbols[live], np.cumsum(np.bincount(string[live], minlength=len(tokens)))[:-1]) if tokens else []
    return [merged_alone(tokens[k], ranks) if k in odd else own.tolist() for k, own in enumerate(ids)]


class Replayed(dict):
    """Ids of each piece of a text as bytes. A piece starts at the text's start or at a single space before a letter,
    which no pre-token reaches over; a piece with white space at an end gets None."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        super().__init__()
        self.cut, self.ranks = regex.compile(pattern), ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.bad: set[str] = set()
        self.held = 0

    def learn(self, texts: list[str]) -> None:
        if len(self) > REMEMBERED or self.held > LETTERS:
            self.clear()
            self.bad.clear()
            self.held = 0
        wanted, cuts, whole = set(), {}, []
        for text in texts:
            first, *rest = text.split(" ")
            wanted.update(rest)
            wanted.add(" " + first)
        for piece in [p for p in wanted if p not in self]:
            self.held += len(piece)
            body = piece.removeprefix(" ")
            if not body or body[0].isspace() or body[-1].isspace():
                self[piece] = None
                self.bad.add(piece)
            else:
                cuts[piece] = self.cut.findall(body if piece[0] == " " else " " + piece)
        for text in texts:
            if self.rough(text):
                whole.append(self.cut.findall(text))
        distinct = sorted({token for tokens in (*cuts.values(), *whole) for token in tokens})
        ids = replay([token.encode() for token in distinct], self.ranks)
        self.tokens = {token: np.array(i, "<u4").tobytes() for token, i in zip(distinct, ids)}
        for piece, tokens in cuts.items():
            self[piece] = b"".join(map(self.tokens.__getitem__, tokens))

    def rough(self, text: str) -> bool:
        first, *rest = text.split(" ")
        return " " + first in self.bad or not self.bad.isdisjoint(rest)

    def of(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self[" " + first] + b"".join(map(self.__getitem__, rest))
        except TypeError:
            return b"".join(map(self.tokens.__getitem__, self.cut.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def replayed(pattern: str, content: bytes) -> Replayed:
    """Kept for all tasks of a Python worker."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return Replayed(pattern, ranks)


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    The rank file (under 1 MB) is read here and broadcast; documents stay in their partitions.
    """
    with open(path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(keys, texts):
        known = replayed(pattern, sent.value)
        ids = []
        for portion in common.in_portions([t or "" for t in texts]):
            known.learn(portion)
            ids += [known.of(t) for t in portion]
        return {"doc_id": keys, "n_tokens": [len(i) // 4 for i in ids], "ids": ids,
                "decoded": list(map(known.decode, ids)) if decoded else [None] * len(ids)}

    return common.on_texts(docs, work, "doc_id long, n_tokens long, ids binary, decoded binary", id, text)


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of ids that ``encode`` made; bytes that are no UTF-8 become replacement characters."""
    from pyspark.sql import functions as F

    with open(path, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())

    def work(keys, hexes):
        known = replayed("", sent.value)
        return {"doc_id": keys, "text": [None if h is None else known.decode(bytes.fromhex(h)).decode("utf-8", "replace") for h in hexes]}

    return common.on_texts(encoded.select(F.col(id), F.hex(ids).alias("hex")), work, "doc_id long, text string", id, "hex")
