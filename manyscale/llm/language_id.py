"""Languages of texts that may mix several, by expectation-maximisation over n-gram likelihoods.

Training counts hashed letter trigrams per language. A text is seen as a mixture: each of its trigrams comes from
language ``l`` with a share that expectation-maximisation estimates. Languages enter the set one at a time, the one
with the steepest likelihood first, and stay only if twice the gain in log likelihood exceeds ``log n`` per
language (a penalty for each free share). The prediction is the language with the largest share.

Defined results: a null text, one without a letter, and any text when nothing was learnt get ``und`` with score 0;
equal shares go to the first language in order; repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyscale.llm import common
from manyscale.plans import shipping, storage

#: Hash classes of trigrams. The model has this many numbers for each language, whatever the size of the corpus.
CLASSES = 1 << 15
#: Counts travel in slices of this many classes.
SLICE = 1 << 11
ROUNDS = 25
SMOOTHING = 0.5
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For every code point its lower-case letter, or a space; built once per worker."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x20000):
        if chr(c).isalpha():
            lower = chr(c).lower()
            table[c] = ord(lower) if len(lower) == 1 else c
    table[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    return table


_letters: list[np.ndarray] = []


def trigrams(text: str) -> np.ndarray:
    """Hash classes of the text's letter trigrams; runs of other characters count as one space, also at both ends."""
    if not _letters:
        _letters.append(letter_table())
    codes = _letters[0][np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    if len(codes) < 3:
        return np.empty(0, np.int64)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(32 - CLASSES.bit_length() + 1)).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and ``CLASSES x languages`` trigram probabilities, from all rows with a language and text.

    Tasks add up counts before anything is shuffled; what is collected is one number per class and language.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    shipping.ship(spark)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in sums:
                    sums[name] = np.zeros(CLASSES, np.int64)
                sums[name] += np.bincount(trigrams(body), minlength=CLASSES)
        for name, total in sums.items():
            part = total.reshape(-1, SLICE)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(part), "slice": list(range(len(part))), "n": part.tolist()})

    parts = known.mapInArrow(count, "lang string, slice long, n array<long>")
    total = (parts.select("lang", "slice", F.posexplode("n").alias("at", "n")).where("n > 0")
             .groupBy("lang", (F.col("slice") * SLICE + F.col("at")).alias("class")).agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    model = np.full((CLASSES, len(languages)), SMOOTHING)
    storage.checked_broadcast(spark, None, model.nbytes, "the language model")
    for k, name, n in total.select("class", "lang", "n").collect():
        model[k, languages.index(name)] += n
    return languages, (model / model.sum(0, keepdims=True)).astype(np.float32)


def mixture(counts: np.ndarray, likelihood: np.ndarray, penalty: float) -> np.ndarray:
    """Shares of the languages in a text with ``counts`` of trigrams, whose rows of the model are ``likelihood``."""
    total, n_languages = counts.sum(), likelihood.shape[1]
    alone = counts @ np.log(likelihood)
    chosen, best = [int(alone.argmax())], float(alone.max())
    shares = np.array([1.0])
    mixed = likelihood[:, chosen[0]]
    while len(chosen) < n_languages:
        slopes = (counts / mixed) @ likelihood
        slopes[chosen] = -np.inf
        new = int(slopes.argmax())
        # With a slope no steeper than the total, no share of the new language can raise the likelihood.
        if slopes[new] <= total:
            break
        part = likelihood[:, [*chosen, new]]
        weights = np.append(shares * 0.9, 0.1)
        for _ in range(ROUNDS):
            whole = part @ weights
            fresh = weights * ((counts / whole) @ part) / total
            done = np.abs(fresh - weights).max() < 1e-3
            weights = fresh
            if done:
                break
        whole = part @ weights
        value = float(counts @ np.log(whole))
        if value - best <= penalty * np.log(max(total, 2.0)) / 2:
            break
        chosen.append(new)
        best, shares, mixed = value, weights, whole
    result = np.zeros(n_languages)
    result[chosen] = shares
    return result


def predict(docs: DataFrame, languages: list[str], model: np.ndarray, penalty: float = 1.0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, shares map<language, share>)`` of every whole text; no shuffle."""
    sent = storage.checked_broadcast(docs.sparkSession, model, model.nbytes, "the language model")

    def one(body):
        if not languages or body is None or not any(map(str.isalpha, body)):
            return UNKNOWN, 0.0, []
        seen, counts = np.unique(trigrams(body), return_counts=True)
        shares = mixture(counts.astype(np.float64), sent.value[seen].astype(np.float64), penalty)
        best = int(shares.argmax())
        return languages[best], min(1.0, float(shares[best])), [(languages[k], float(shares[k])) for k in np.flatnonzero(shares)]

    def work(ids, texts):
        found = [one(t) for t in texts]
        return {"doc_id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "shares": [f[2] for f in found]}

    return common.on_texts(docs, work, "doc_id long, lang_pred string, score double, shares map<string, double>", id, text)


def held_out(id: str, parts: int, part: int) -> Column:
    """Whether a row's key falls in the part that is kept out of training."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(0)) % parts == part
