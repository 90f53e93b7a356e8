"""Documents that contain a benchmark item, found by SimHash of item-sized windows.

Texts are compared as lower-case words and their five-word shingles. A document contains an item of ``n`` words if a
window of ``n`` words (the whole document if it is shorter) has a weighted Jaccard similarity of 0.8 or more with it,
over shingles counted with repeats.

1. Such a window shares at least 0.8 of the item's ``n - 4`` shingle places with items of that length. Shingles of the
   documents meet the benchmark's shingles; windows with enough of them are cut, which loses none that could match.
2. Windows and items get a fingerprint of ``BITS`` bits by SimHash. The ``k``-th occurrence of a shingle is an element of its own,
   so that the weighted similarity is that of plain sets and a repeated shingle has no more say than others.
3. Fingerprints are cut into ``radius + 1`` blocks; two within ``radius`` bits agree in one of them. Windows and items of one
   length that agree in a block are candidates, and those within the radius go on; no pair within the radius is lost.
4. The weighted similarity of the shingles decides.

At a similarity of exactly 0.8 two sets of one size differ in each bit with probability arccos(8 / 9) / pi = 0.1515, in 19.4 of
128 bits on average with a deviation of 4.1. The radius of 40 is five deviations beyond that: about 2 in a million such pairs are lost,
and fewer of nearer ones.

Built-in functions only. Defined results: null, empty and short texts (under five words) contain nothing; items under
five words have no shingle and are never found; null item texts are left out; rows that repeat an id are judged by
their own texts; empty tables give no or clean documents; columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyscale.llm import common

SHINGLE = 5
#: Bits of a fingerprint, in words of 64, and the greatest distance of candidates.
BITS, RADIUS = 128, 40
#: Similarity as a fraction: least numerator and denominator.
SIMILAR = (4, 5)
#: Benchmark shingles up to which they are broadcast (16 bytes each); beyond that both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def shingles(words: str) -> Column:
    return F.expr(f"CASE WHEN size({words}) < {SHINGLE} THEN array() ELSE transform(sequence(1, size({words}) - {SHINGLE - 1}), i -> xxhash64(slice({words}, i, {SHINGLE}))) END")


def elements(hashes: str) -> Column:
    """Hashes of ``(shingle, occurrence)``: the second and later ones of a shingle are elements of their own."""
    numbered = "transform(p, (h, i) -> xxhash64(h, i + 1 - CAST(array_position(p, h) AS INT)))"
    return F.expr(f"transform(array(array_sort({hashes})), p -> CASE WHEN size(array_distinct(p)) = size(p) THEN transform(p, h -> xxhash64(h, 0)) ELSE {numbered} END)[0]")


def simhash(own: str, word: int) -> Column:
    """64 bits that are set in over half of the elements' hashes, which differ for each ``word``.

    Several bits are added up in one number, in lanes as wide as their sums need.
    """
    def counted(lane: int) -> str:
        ones = sum(1 << k for k in range(0, 64, lane))
        sums = f"transform(sequence(0, {lane - 1}), b -> aggregate(e, 0L, (s, h) -> s + (shiftrightunsigned(h, b) & {ones}L)))"
        bit = lambda k: f"CASE WHEN 2 * (shiftrightunsigned(s, {k}) & {(1 << lane) - 1}L) > size(e) THEN {1 << k}L ELSE 0L END"
        # The lane of bit k + b of the hash stands at k in the sum for b.
        lanes = " + ".join(f"({bit(k)})" for k in range(0, 64, lane))
        return f"aggregate({sums}, named_struct('bits', 0L, 'b', 0), (a, s) -> named_struct('bits', a.bits | shiftleft({lanes}, a.b), 'b', a.b + 1), a -> a.bits)"

    return F.expr(f"transform(array(transform({own}, h -> xxhash64(h, {word}))), e -> CASE WHEN size(e) < {1 << 15} THEN {counted(16)} ELSE {counted(32)} END)[0]")


def fingerprints(rows: DataFrame) -> DataFrame:
    """The rows with ``bits``, an array of words of 64 bits from the shingles in ``own``."""
    return rows.withColumn("elements", elements("own")).withColumn("bits", F.array(*(simhash("elements", k) for k in range(BITS // 64)))).drop("elements")


def blocks(bits: str, n_blocks: int) -> Column:
    """``(block, value)`` of each of ``n_blocks`` nearly equal cuts of a fingerprint; a cut may reach over two words."""
    edges = [BITS * k // n_blocks for k in range(n_blocks + 1)]

    def piece(a: int, b: int) -> str:
        parts = []
        for word in range(a // 64, (b - 1) // 64 + 1):
            low, high = max(a, 64 * word) - 64 * word, min(b, 64 * word + 64) - 64 * word
            mask = "" if high - low == 64 else f" & {(1 << (high - low)) - 1}L"
            parts.append(f"shiftleft(shiftrightunsigned({bits}[{word}], {low}){mask}, {max(a, 64 * word) - a})")
        return " | ".join(parts)

    return F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.expr(piece(a, b)).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:])))))


def common_shingles(a: str, b: str) -> Column:
    """The size of the multiset intersection of two arrays."""
    return F.expr(f"""aggregate(array_intersect({a}, {b}), 0, (n, x) ->
        n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))""")


def items_of(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("item_id"), common.words(common.lower_ascii(F.col(text))).alias("words"))
    rows = rows.where(F.size("words") >= SHINGLE).withColumn("own", shingles("words"))
    return fingerprints(rows.select("item_id", F.size("words").alias("n"), "own"))


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(key, words)``: the id with a hash of the text, so that rows that repeat an id stay apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key(id, text), common.words(common.lower_ascii(body)).alias("words"))


def key(id: str, text: str) -> Column:
    return F.struct(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("key")


def windows(docs: DataFrame, items: DataFrame, id: str, text: str) -> DataFrame:
    """``(key, n, start, own)``: the shingles of windows of ``n`` words that share enough with items of that length."""
    known = items.select("n", F.explode("own").alias("h")).distinct().groupBy("h").agg(F.collect_set("n").alias("lengths"))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    places = keyed(docs, id, text).select("key", F.size("words").alias("total"), F.posexplode(shingles("words")).alias("at", "h"))
    hits = places.join(known, "h").select("key", "total", "at", F.explode("lengths").alias("n")).distinct()
    # Places of one document and length; never more than the document has words.
    runs = hits.groupBy("key", "n", "total").agg(F.sort_array(F.collect_list("at")).alias("p"))
    runs = runs.withColumn("need", F.expr(f"CAST(ceil({SIMILAR[0]} * (n - {SHINGLE - 1}) / {SIMILAR[1]}) AS INT)"))
    # For hit k to be the first of a window, the window starts behind hit k - 1 and reaches hit k + need - 1.
    low = f"greatest(p[k + need - 1] - (n - {SHINGLE}), CASE WHEN k > 0 THEN p[k - 1] + 1 ELSE 0 END, 0)"
    starts = runs.where("size(p) >= need").select("key", "n", F.expr(f"""array_distinct(transform(flatten(transform(p, (x, k) ->
        CASE WHEN k + need - 1 < size(p) THEN CASE WHEN {low} <= x THEN sequence({low}, x) ELSE array() END ELSE array() END)),
        s -> greatest(0, least(s, total - n))))""").alias("starts")).where("size(starts) > 0")
    # Texts travel as they are; only those that have a window are cut into words again.
    bodies = docs.select(key(id, text), F.col(text).alias("body"))
    cut = bodies.join(starts.groupBy("key").agg(F.collect_list(F.struct("n", "starts")).alias("runs")), "key")
    cut = cut.select("key", common.words(common.lower_ascii(F.coalesce("body", F.lit("")))).alias("words"), "runs").dropDuplicates(["key"])
    each = cut.select("key", "words", F.explode("runs").alias("r")).select("key", "words", "r.n", F.explode("r.starts").alias("start"))
    return each.select("key", "n", "start", F.expr("slice(words, start + 1, n)").alias("part")).withColumn("own", shingles("part")).drop("part")


def find(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item_id, start, shared, total)``: windows that match an item, with the similarity ``shared / total``."""
    items = common.stored(items_of(benchmark, item, item_text))
    found = common.stored(fingerprints(windows(docs, items, id, text)))
    one = found.select("key", "start", "n", "bits", blocks("bits", radius + 1).alias("b")).select("key", "start", "n", "bits", "b.*")
    two = items.select("item_id", "n", F.col("bits").alias("other"), blocks("bits", radius + 1).alias("b")).select("item_id", "n", "other", "b.*")
    apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("other")[k])) for k in range(BITS // 64)), F.lit(0))
    near = one.join(two, ["n", "block", "value"]).where(apart <= radius).select("key", "start", "n", "item_id").distinct()
    pairs = near.join(found.select("key", "start", "n", "own"), ["key", "start", "n"]).join(items.select("item_id", F.col("own").alias("its")), "item_id")
    judged = pairs.select("key", "item_id", "start", common_shingles("own", "its").alias("shared"), (F.size("own") + F.size("its")).alias("both"))
    judged = judged.select("key", "item_id", "start", "shared", (F.col("both") - F.col("shared")).alias("total"))
    return judged.where(f"{SIMILAR[1]} * shared >= {SIMILAR[0]} * total")


def with_items(docs: DataFrame, benchmark: DataFrame, radius: int, id: str, text: str, item: str, item_text: str) -> DataFrame:
    """``(row, items)``: each document whole, with the sorted ids of the items that it contains."""
    per = find(docs, benchmark, radius, id, text, item, item_text).groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = docs.select(F.struct("*").alias("row"), key(id, text))
    return rows.join(per, "key", "left").select("row", F.coalesce("items", F.array()).alias("items"))


def mark(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with ``_items``, the sorted ids of the items that each contains; it replaces a column of that name."""
    marked = with_items(docs, benchmark, radius, id, text, item, item_text)
    return marked.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "_items"), F.col("items").alias("_items"))


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item."""
    return with_items(docs, benchmark, radius, id, text, item, item_text).where("size(items) = 0").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
