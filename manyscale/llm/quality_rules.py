"""Quality rules as a ledger: every rule is evaluated once, policies are applied to the stored bits.

``ledger`` writes for each document its measurements and one integer in which bit ``k`` says that rule ``k`` failed.
Letters are counted with their marks, so that scripts with vowel signs are not short of letters. ``long_words`` does not
look at scripts that are written without spaces: it spares a text that is mostly in such scripts, and one whose other
characters alone are not too many for its words.

A policy is a version and a mask of rules; applying one, or asking what a rule alone would cost, needs only the bits.

Everything is built-in functions on the text's own arrays, without a shuffle; only ``ablation`` groups, by bits.

Defined results: a null or empty text has no words, so it fails ``few_words``; repeated rows each give a row; an empty
table gives none; all columns of the input but the ledger's own stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyscale.llm import common

#: The characters that count as symbols, and the number of words in a window.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rules in the order of their bits: a name, and when a document fails it, over the measurements.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "n_words > 0 AND word_chars > 15 * n_words"),
    ("few_letters", "10 * n_letters < 6 * word_chars"),
]
#: Where a rule does not apply although its condition holds.
EXEMPT = {"long_words": "2 * n_unspaced > n_letters OR word_chars - n_unspaced <= 15 * n_words"}
#: Scripts written without spaces between words.
UNSPACED = ["Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Javanese", "Balinese",
            "Tai_Le", "New_Tai_Lue", "Tai_Tham", "Tai_Viet"]
#: Policies: the version, and the rules that reject.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v2": [name for name, _ in RULES],
}
MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_unspaced"]


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def repeated_words(words: str, hashes: str) -> Column:
    """Words inside windows whose hash occurs twice or more in ``hashes``; both are column names.

    The hashes are sorted with their places; a window equal to a neighbour in that order is repeated.
    """
    return F.expr(f"""aggregate(
        array_sort(filter({hashes}, (e, i) -> (i > 0 AND {hashes}[i - 1].h = e.h) OR (i + 1 < size({hashes}) AND {hashes}[i + 1].h = e.h)).p),
        named_struct('n', 0L, 'upto', 0L),
        (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(a.upto, p), 'upto', p + {WINDOW}L),
        a -> a.n)""")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the measurements that rules look at."""
    body = F.coalesce(F.col(text), F.lit(""))
    columns = [c for c in docs.columns if c not in {*MEASURED, "_words", "_windows", "_seen", "_high"}]
    split = docs.select(*columns, common.words(F.col(text)).alias("_words"))
    split = split.withColumn("_windows", F.expr(
        f"CASE WHEN size(_words) < {WINDOW} THEN array() ELSE transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) END"))
    # Few texts repeat a window; only theirs are sorted.
    split = split.withColumn("_seen", F.expr(
        """CASE WHEN size(array_distinct(_windows)) < size(_windows)
           THEN sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'p', CAST(i AS BIGINT)))) END"""))
    # Marks and the scripts below start at U+0300; one search for a range leaves few characters of most texts to look at.
    split = split.withColumn("_high", F.regexp_replace(body, r"[\x00-\u02FF]+", ""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.translate(line, common.BLANKS, "") != "")
    letters = F.length(F.regexp_replace(F.array_join("_words", ""), r"\P{L}+", "")) + F.length(F.regexp_replace("_high", r"\P{M}+", ""))
    spaced = "[^" + "".join(rf"\p{{Is{script}}}" for script in UNSPACED) + "]+"
    measured = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_seen").isNull(), F.lit(0).cast("long")).otherwise(repeated_words("_words", "_seen")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        letters.cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_high", spaced, "")).cast("long").alias("n_unspaced"))
    # A one-element explode: no later filter on a measurement can be pushed below it and evaluate it again.
    return split.select(*columns, F.explode(F.array(measured)).alias("_m")).select(*columns, "_m.*")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with measurements and ``failed``, the bits of the rules that each one fails."""
    applies = lambda name, rule: f"({rule}) AND NOT ({EXEMPT[name]})" if name in EXEMPT else rule
    bits = " | ".join(f"CASE WHEN {applies(name, rule)} THEN {1 << k}L ELSE 0L END" for k, (name, rule) in enumerate(RULES))
    return measure(docs, text).withColumn("failed", F.expr(bits))


def apply_policy(kept: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger's rows with ``kept`` under a version of the policy; no rule is evaluated again."""
    return kept.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """``(policy, rule, n_failed, n_only)``: documents that fail each rule of a policy, and that fail no other of it.

    Documents are counted by their bits first, at most ``2 ** rules`` rows; each rule then adds up those counts.
    """
    own = mask(policy)
    counted = rows.groupBy(F.col("failed").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if own >> k & 1]
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in names]))
    each = counted.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    ).select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only")


def policies(spark: SparkSession) -> DataFrame:
    """``(policy, mask, rules)`` of all versions."""
    return spark.createDataFrame([(p, mask(p), rules) for p, rules in POLICIES.items()], "policy string, mask long, rules array<string>")
