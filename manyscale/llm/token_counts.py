"""Token counts of texts under a word-piece vocabulary with word ends, by a whole-token shortcut.

Most pre-tokens of a text are entries of the vocabulary. Before any text is read, every vocabulary string is
merged alone; the strings that end as one token are proven, and a pre-token among them counts one without any
merging. Only the other pre-tokens are merged.

Defined results: a null or empty text has no bytes and no tokens; repeated rows each give a row; an empty
table gives none. Special tokens that occur in a text count one each, as the library's default does.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from manyscale.llm import common

#: The rule of the vocabulary file that cuts a lower-case text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Entries and letters of a task's memory of pieces; it is emptied beyond that. Longer pieces are not kept.
REMEMBERED, LETTERS, LONG = 1_000_000, 32_000_000, 1000
#: Below this character Python's tables of letters and the library's agree; beyond, the library folds them itself.
KNOWN = "\u1680"
#: Letters from which a pre-token is merged through a heap.
MANY = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Merge ranks of a vocabulary file, and the pre-tokens that are proven to be one token."""

    def __init__(self, content: str):
        model = json.loads(content)
        self.end = model["model"]["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.specials = sorted((t["content"] for t in model["added_tokens"] if t["special"]), key=len, reverse=True)
        self.letters = byte_letters()
        #: The file's own folding of letters.
        self.folded = Tokenizer.from_str(content).normalizer.normalize_str
        known = model["model"]["vocab"]
        bodies = (v[: len(v) - len(self.end)] for v in known if v.endswith(self.end))
        self.whole = {body for body in bodies if body and self.merged(body) == 1}

    def merged(self, letters: str) -> int:
        """How many tokens the byte letters of one pre-token end as."""
        parts = list(letters)
        parts[-1] += self.end
        if len(parts) > MANY:
            return len(common.merged(parts, lambda a, b: self.ranks.get((a, b))))
        rank, last = self.ranks.get, len(self.ranks)
        order = [rank(pair, last) for pair in zip(parts, parts[1:])]
        while order and (best := min(order)) < last:
            at = order.index(best)
            parts[at] += parts.pop(at + 1)
            del order[at]
            if at:
                order[at - 1] = rank((parts[at - 1], parts[at]), last)
            if at < len(order):
                order[at] = rank((parts[at], parts[at + 1]), last)
        return len(parts)


class PieceCounts(dict):
    """Tokens of each piece between two spaces, filled in as pieces are asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.held = vocabulary, 0
        self.cut = regex.compile(PRE_TOKENS)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials)) or r"(?!)")

    def __missing__(self, piece: str) -> int:
        total = 0
        if piece.isascii() and piece.isalpha():
            total = self.tokens(piece.lower())
        else:
            total = len(self.special.findall(piece))
            for plain in self.special.split(piece) if total else (piece,):
                if max(plain, default="") < KNOWN:
                    # One letter at a time, as the library does; str.lower() alone would look at a sigma's neighbours.
                    text = unicodedata.normalize("NFC", plain).replace("Σ", "σ").lower()
                else:
                    text = self.vocabulary.folded(plain)
                total += sum(map(self.tokens, self.cut.findall(text)))
        if len(piece) <= LONG:
            self[piece] = total
            self.held += len(piece)
        return total

    def tokens(self, token: str) -> int:
        """Tokens of one pre-token: one if it is proven whole, else what merging leaves."""
        vocabulary = self.vocabulary
        if not (token.isascii() and token.isprintable()):
            token = "".join(map(vocabulary.letters.__getitem__, token.encode()))
        return 1 if token in vocabulary.whole else vocabulary.merged(token)

    def of(self, text: str) -> int:
        if len(self) > REMEMBERED or self.held > LETTERS:
            self.clear()
            self.held = 0
        # Line feeds end pre-tokens just as spaces do.
        return sum(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def piece_counts(content: str) -> PieceCounts:
    """Kept for all tasks of a Python worker."""
    return PieceCounts(Vocabulary(content))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text under the vocabulary file's content.

    Documents stay in their partitions: there is no shuffle, and the vocabulary (a few MB) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(ids, texts):
        counts = piece_counts(sent.value)
        tokens = [counts.of(t) if t else 0 for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens]}

    return common.on_texts(docs, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", id, text)
