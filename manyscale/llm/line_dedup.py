"""Removal of lines that repeat an earlier line, exactly or but for one word, over all documents.

Lines are compared as sequences of words. A line goes if an earlier one (by ``doc_id``, then line number) has the same
words, or differs in one word that is replaced, inserted or left out; a line of fewer than five words only goes if it
is the same, so that an edit is never more than a fifth of a line. Blank lines stay.

One edit leaves both lines with a common variant: the line with one word deleted, or the shorter line itself.

1. Equal lines become one row with its earliest place.
2. One edit leaves the first or the second half as it is. Lines that share no half with another line have no partner;
   only the others go on.
3. Every such line emits a hashed key for each word deleted, and one for itself. Keys are sums over neighbouring words,
   so a deletion changes three terms and a line of n words costs n steps.
4. Variants of a single line are dropped; the others get the hash of the exact words that are left. Lines with the same
   rest at the same place differ in that word alone: each is compared with the earliest of them, and longer and shorter
   lines with the earliest of the other kind. No group is paired out.
5. The edit distance of each such pair is verified on the words.

Built-in functions only. Earlier means by ``doc_id``, null ids last, then by a hash of the text, then by line number. Defined
results: a null or empty text has no lines to drop; rows that repeat an id are judged by their own texts; of rows that repeat id and
text one keeps its lines, the first by a hash of all columns, and the others lose all but blank ones; an empty table
gives none; columns of the input other than the text stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyscale.llm import common
from manyscale.llm.simhash_groups import row_key

#: The fewest words of the longer line of a pair with an edit: one word is then at most a fifth.
LEAST_WORDS = 5


def parts(text: str) -> Column:
    """The lines of a text; the other white space that separates words has become spaces."""
    flat = F.coalesce(F.col(text), F.lit(""))
    for blank in common.BLANKS[1:].replace("\n", ""):  # a search for one character each, and no copy if there is none
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.split(flat, "\n")


def normal(line: Column) -> Column:
    """The words of a line with one space between them, which is as good as the array of them and much cheaper."""
    trimmed = F.trim(line)
    return F.when(F.contains(trimmed, F.lit("  ")), F.regexp_replace(trimmed, " +", " ")).otherwise(trimmed)


def keys(id: str, text: str) -> list[Column]:
    """The parts of ``row_key`` as columns."""
    return [row_key(id, text).getField(name).alias(name) for name in ("none", "id", "body")]


def lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(at struct<none, id, body, line>, line)`` of every line that has a word, in normal form."""
    each = docs.select(*keys(id, text), parts(text).alias("parts")).select("none", "id", "body", F.posexplode("parts").alias("n", "words"))
    return each.select(F.struct("none", "id", "body", F.col("n").alias("line")).alias("at"), normal(F.col("words")).alias("line")).where("line <> ''")


def n_words(line: str) -> str:
    return f"(octet_length({line}) - octet_length(replace({line}, ' ', '')) + 1)"


def halves(line: str, n: str) -> Column:
    """Hashes of the first and the second half, as a line of its own length and as one that is a word longer than its partner."""
    return F.expr(f"""flatten(transform(array({n}, {n} - 1), m -> array(
        xxhash64(1, m, substring_index({line}, ' ', CAST(m div 2 AS INT))),
        xxhash64(2, m, substring_index({line}, ' ', CAST(m div 2 - m AS INT))))))""")


def variant_keys(rows: DataFrame) -> DataFrame:
    """``(h, place, key)``: one row for each deletable word (``place`` from 1) and one for the whole line (0)."""
    pair = "xxhash64(coalesce(get(words, {0}), ''), coalesce(get(words, {1}), ''))"
    low, high = "({0} & 4294967295)", "shiftrightunsigned({0}, 32)"
    steps = rows.withColumn("joints", F.expr(f"transform(sequence(0, size(words)), j -> {pair.format('j - 1', 'j')})"))
    steps = steps.withColumn("gaps", F.expr(f"transform(sequence(0, size(words) - 1), j -> {pair.format('j - 1', 'j + 1')})"))
    for name, part in (("low", low), ("high", high)):
        steps = steps.withColumn(name, F.expr(f"aggregate(joints, 0L, (a, x) -> a + {part.format('x')})"))
    rest = lambda name, part: f"{name} - {part.format('joints[j]')} - {part.format('joints[j + 1]')} + {part.format('gaps[j]')}"
    keys = F.expr(f"""concat(
        array(named_struct('place', 0, 'key', xxhash64(size(words), low, high))),
        CASE WHEN size(words) < {LEAST_WORDS} THEN array() ELSE transform(sequence(0, size(words) - 1), j ->
            named_struct('place', j + 1, 'key', xxhash64(size(words) - 1, {rest('low', low)}, {rest('high', high)}))) END)""")
    return steps.select("h", F.explode(keys).alias("v")).select("h", "v.place", "v.key")


def within_one(a: str, b: str) -> Column:
    """Whether two arrays of words are at most one replaced, inserted or missing word apart."""
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> NOT e)) <= 1"

    def longer(x, y):
        first = f"(CASE WHEN array_position(zip_with(slice({x}, 1, size({y})), {y}, (p, q) -> p = q), false) = 0 THEN size({y}) + 1 ELSE CAST(array_position(zip_with(slice({x}, 1, size({y})), {y}, (p, q) -> p = q), false) AS INT) END)"
        return f"slice({x}, {first} + 1, size({x})) = slice({y}, {first}, size({x}))"

    return F.expr(f"CASE WHEN size({a}) = size({b}) THEN {same} WHEN size({a}) = size({b}) + 1 THEN {longer(a, b)} WHEN size({b}) = size({a}) + 1 THEN {longer(b, a)} ELSE false END")


def near(first: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``at`` of the lines of ``first(h, at, halves)`` that have an earlier line within one edit.

    Lines travel as their hash; whole texts are shuffled once, to cut out the lines that may have a partner.
    """
    shared = first.where("halves IS NOT NULL").select("h", F.explode("halves").alias("half"))
    met = shared.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    live = shared.join(met, "half", "left_semi").select("h").distinct()
    wanted = first.join(live, "h", "left_semi").groupBy("at.none", "at.id", "at.body").agg(F.collect_list(F.struct("at.line", "h")).alias("wanted"))
    bodies = docs.select(*keys(id, text), F.col(text).alias("text"))
    # Wanted lines are taken from the array of all lines by their number.
    taken = F.expr("wanted").alias("wanted"), parts("text").alias("parts")
    each = bodies.join(wanted, ["none", "id", "body"]).select("none", "id", "body", *taken).select("none", "id", "body", F.explode(
        F.transform(F.array(F.col("parts")), lambda p: F.transform("wanted", lambda w: F.struct(w["line"], w["h"], F.get(p, w["line"]).alias("text"))))[0]).alias("w"))
    each = each.select("w.h", F.struct("none", "id", "body", "w.line").alias("at"), normal(F.col("w.text")).alias("line"))
    live = common.stored(each.dropDuplicates(["h"]).select("h", "at", F.split("line", " ").alias("words")))
    variants = variant_keys(live)
    # A run of one word gives a line the same key several times; only keys of two lines matter.
    often = variants.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    some = variants.join(often, "key", "left_semi").join(live, "h")
    rest = common.stored(some.select("at", "place", F.expr(
        "CASE WHEN place = 0 THEN xxhash64(size(words), words) ELSE xxhash64(size(words) - 1, slice(words, 1, place - 1), slice(words, place + 1, size(words))) END").alias("rest")))
    earliest = rest.groupBy("rest", "place").agg(F.min("at").alias("other"))
    whole = earliest.where("place = 0").select("rest", "other")
    longer = earliest.where("place > 0").groupBy("rest").agg(F.min("other").alias("other"))
    pairs = (rest.where("place > 0").join(earliest, ["rest", "place"]).select("at", "other")
             .union(rest.where("place > 0").join(whole, "rest").select("at", "other"))
             .union(rest.where("place = 0").join(longer, "rest").select("at", "other"))).where("other < at").distinct()
    one, two = live.select("at", "words"), live.select(F.col("at").alias("other"), F.col("words").alias("others"))
    return pairs.join(one, "at").join(two, "other").where(within_one("words", "others")).select("at").distinct()


def decide(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(none, id, body, kept, near)``: line numbers that stay, and those that go for a near copy, by ``row_key`` of documents with such a line."""
    n = n_words("line")
    hashed = lines(docs, id, text).select("at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"),
                                          F.when(F.expr(f"{n} >= {LEAST_WORDS - 1}"), halves("line", n)).alias("halves"))
    first = common.stored(hashed.groupBy("h", "g").agg(F.min("at").alias("at"), F.any_value("halves").alias("halves")).select("h", "at", "halves"))
    dropped = near(first, docs, id, text).withColumn("near", F.lit(True))
    joined = first.select("at").join(dropped, "at", "left").select("at.*", F.coalesce("near", F.lit(False)).alias("near"))
    return joined.groupBy("none", "id", "body").agg(
        F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("line")))).alias("kept"),
        F.sort_array(F.collect_list(F.when(F.col("near"), F.col("line")))).alias("near"))


def judged(rows: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame:
    """``rows(row, order, none, id, body)``, one for each document, with ``kept`` and ``near``: both empty for all but one row of a key."""
    none = F.array().cast("array<int>")
    met = rows.join(decide(docs, id, text), ["none", "id", "body"], "left")
    nth = F.row_number().over(Window.partitionBy("none", "id", "body").orderBy("order"))
    return met.withColumn("nth", nth).select("row", *(F.when(F.col("nth") == 1, F.coalesce(c, none)).otherwise(none).alias(c) for c in ("kept", "near")))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_lines, kept, near, filled)``: numbers of the lines that stay, that go for a near copy, and that have a word.

    Only line numbers are joined here, not texts.
    """
    filled = F.transform(F.array(parts(text)), lambda p: F.filter(F.transform(p, lambda b, i: F.when(F.trim(b) != "", i)), lambda i: i.isNotNull()))[0]
    row = F.struct(F.col(id).alias("doc_id"), F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long").alias("n_lines"), filled.alias("filled"))
    rows = docs.select(row.alias("row"), F.lit(0).alias("order"), *keys(id, text))
    return judged(rows, docs, id, text).select("row.doc_id", "row.n_lines", "kept", "near", "row.filled")


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, whose texts have lost the lines that go; a null text stays null."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*plain).alias("order"), *keys(id, text))
    body = F.col("row").getField(text)
    blank = lambda p: F.filter(F.transform(p, lambda b, i: F.when(~F.rlike(b, F.lit(r"[^ \t\x0B\f\r]")), i)), lambda i: i.isNotNull())
    stays = F.transform(F.array(F.split(body, "\n")), lambda p: F.transform(F.array_sort(F.concat(blank(p), F.col("kept"))), lambda i: F.get(p, i)))[0]
    cut = F.when(body.isNotNull(), F.array_join(stays, "\n"))
    return judged(rows, docs, id, text).select(*(cut.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
