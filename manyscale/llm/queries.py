"""The registered queries of the text operators, each over the whole of its tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyscale.llm import (bpe_replay, common, decontaminate, divergence, language_id, line_dedup, lm_score, quality_rules, secret_scan, simhash_groups,
                           spelling_variants, token_counts, token_files, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query
def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op2_language_mixture(spark, sf_dir):
    docs = documents(spark, sf_dir)
    languages, model = language_id.fit(docs.where(~language_id.held_out("doc_id", 4, 2)))
    found = language_id.predict(docs, languages, model)
    return found.select("doc_id", language_id.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op3_token_files(spark, sf_dir):
    folder = common.scratch(spark)
    shards = token_files.write_token_files(documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_secret_scan(spark, sf_dir):
    found = secret_scan.scan(documents(spark, sf_dir))
    # Spans come by start, then rule, which is the order of the result.
    span = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"].isin([name for name, *_ in secret_scan.BASE_RULES]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(F.array_join(F.transform(base, span), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("found", span), ",").alias("spans"))


@query
def op7_bpe_replay(spark, sf_dir):
    coded = bpe_replay.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_quality_rules(spark, sf_dir):
    kept = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)))
    failed_base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask("base"))) != 0
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed_base.alias("base_failed"), "kept", "failed")


@query
def op9_simhash_groups(spark, sf_dir):
    return simhash_groups.groups(documents(spark, sf_dir))


@query
def op6_line_dedup(spark, sf_dir):
    found = line_dedup.report(documents(spark, sf_dir))
    gone, near = F.array_except("filled", "kept"), F.size("near").cast("long")
    return found.select("doc_id", "n_lines", (F.size(gone) - near).alias("n_exact"), near.alias("n_near"),
                        F.array_join(F.sort_array(gone).cast("array<string>"), ",").alias("dropped"))


BLANK = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(regexp_split_to_array({{}}, '{BLANK}'), lambda w: w <> '')"

ORACLES["op6_line_dedup"] = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(range(len(parts)))::BIGINT AS line, unnest(parts) AS body FROM split),
filled AS (SELECT doc_id, line, {WORDS.format('body')} AS ws FROM numbered),
worded AS (SELECT doc_id, line, ws, (doc_id::HUGEINT * 1000000 + line) AS o FROM filled WHERE len(ws) > 0),
firsts AS (SELECT ws, min(o) AS o, len(ws) AS n FROM worded GROUP BY ws),
deleted AS (SELECT o, n, unnest(range(1, n + 1)) AS i, ws FROM firsts WHERE n >= 5),
rests AS (SELECT o, n, i, list_concat(ws[:i - 1], ws[i + 1:]) AS rest FROM deleted),
wholes AS (SELECT o, ws AS rest FROM firsts WHERE n >= 4),
same AS (SELECT i, rest, min(o) AS other FROM rests GROUP BY i, rest HAVING count(*) > 1),
near AS (
  SELECT r.o FROM rests r JOIN same s ON r.i = s.i AND r.rest = s.rest AND s.other < r.o
  UNION SELECT r.o FROM rests r JOIN wholes w ON r.rest = w.rest AND w.o < r.o
  UNION SELECT w.o FROM wholes w JOIN rests r ON r.rest = w.rest AND r.o < w.o),
judged AS (SELECT w.doc_id, w.line, w.o <> f.o AS exact, n.o IS NOT NULL AND w.o = f.o AS near
  FROM worded w JOIN firsts f ON w.ws = f.ws LEFT JOIN near n ON n.o = w.o),
counts AS (SELECT doc_id, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
  string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (exact OR near) AS dropped FROM judged GROUP BY doc_id)
SELECT s.doc_id, len(s.parts)::BIGINT AS n_lines, coalesce(c.n_exact, 0)::BIGINT AS n_exact, coalesce(c.n_near, 0)::BIGINT AS n_near,
  coalesce(c.dropped, '') AS dropped FROM split s LEFT JOIN counts c ON c.doc_id = s.doc_id
"""

ORACLES["op8_quality_rules"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, {WORDS.format("coalesce(text, '')")} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
worded AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM t),
win AS (SELECT doc_id, i, {" || ' ' || ".join(f"lead(w, {k}) OVER o" for k in range(quality_rules.WINDOW))} AS g FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, g FROM win WHERE g IS NOT NULL GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN often USING (doc_id, g), unnest(range(8)) AS u(k) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  length(regexp_replace(array_to_string(ws, ''), '\\P{{L}}+', '', 'g'))::BIGINT AS n_letters
  FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id),
f AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(quality_rules.RULES))} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {quality_rules.mask("base")}) <> 0 AS base_failed,
  (failed & {quality_rules.mask("v2")}) = 0 AS kept, failed::BIGINT AS failed FROM f
"""


@query
def op10_decontamination(spark, sf_dir):
    marked = decontaminate.mark(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"),
                         F.array_join(F.col("_items").cast("array<string>"), ",").alias("item_ids"))


ORACLES["op10_decontamination"] = f"""
WITH dw AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
iw AS (SELECT item_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM benchmark WHERE text IS NOT NULL),
dr AS (SELECT doc_id, len(ws) AS total, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM dw),
ir AS (SELECT item_id, len(ws) AS n, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM iw),
ds AS (SELECT doc_id, total, pos, {" || ' ' || ".join(f"lead(w, {k}) OVER o" for k in range(5))} AS g FROM dr WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
ish AS (SELECT item_id, n, pos, {" || ' ' || ".join(f"lead(w, {k}) OVER o" for k in range(5))} AS g FROM ir WINDOW o AS (PARTITION BY item_id ORDER BY pos)),
ic AS (SELECT item_id, n, g, count(*) AS c FROM ish WHERE g IS NOT NULL GROUP BY item_id, n, g),
hits AS (SELECT ds.doc_id, ds.total, ds.pos, ic.item_id, ic.n FROM ds JOIN ic ON ds.g = ic.g),
win AS (SELECT DISTINCT doc_id, item_id, n, greatest(0, least(pos - k, total - n)) AS s FROM (SELECT *, unnest(range(n - 4)) AS k FROM hits)),
full_win AS (SELECT w.doc_id, w.item_id, w.n, w.s FROM win w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id
  AND h.pos BETWEEN w.s AND w.s + w.n - 5 GROUP BY ALL HAVING 5 * count(*) >= 4 * (w.n - 4)),
wc AS (SELECT w.doc_id, w.item_id, w.n, w.s, ds.g, count(*) AS c FROM full_win w JOIN ds ON ds.doc_id = w.doc_id AND ds.pos BETWEEN w.s AND w.s + w.n - 5
  WHERE ds.g IS NOT NULL GROUP BY ALL),
sims AS (SELECT wc.doc_id, wc.item_id, wc.s, wc.n, sum(wc.c) AS own, sum(least(wc.c, coalesce(ic.c, 0))) AS shared
  FROM wc LEFT JOIN ic ON ic.item_id = wc.item_id AND ic.g = wc.g GROUP BY ALL),
good AS (SELECT DISTINCT doc_id, item_id FROM sims WHERE 5 * shared >= 4 * (own + n - 4 - shared)),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids FROM good GROUP BY doc_id)
SELECT d.doc_id, p.doc_id IS NOT NULL AS contaminated, coalesce(p.n_items, 0)::BIGINT AS n_items, coalesce(p.item_ids, '') AS item_ids
FROM documents d LEFT JOIN per p ON p.doc_id = d.doc_id
"""


@query
def op4_lm_score(spark, sf_dir):
    return lm_score.score(documents(spark, sf_dir), language_id.held_out("doc_id", 5, 1))


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))


GAP = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"

ORACLES["op11_source_divergence"] = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT t.lang, t.source, t.term, count(*)::BIGINT AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(n.c), 0)::BIGINT AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, 1 + (1000000000 * (coalesce(n.c, 0) + 2)) // (tot.total + 2 * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) JOIN tot USING (lang, source) LEFT JOIN n USING (lang, source, term)),
whole AS (SELECT cell.lang, cell.term, 1 + (1000000000 * (sum(cell.c)::BIGINT + 2)) // (any_value(x.total) + 2 * any_value(v.v)) AS q
  FROM cell JOIN v USING (lang) JOIN (SELECT lang, sum(total)::BIGINT AS total FROM tot GROUP BY lang) x USING (lang) GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, sum({GAP.format("a.p", "b.p")})::BIGINT AS value FROM cell a JOIN cell b USING (lang, term) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ({GAP.format("p", "q")})::BIGINT AS value FROM cell JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(documents(spark, sf_dir))


@query
def op13_toxicity(spark, sf_dir):
    docs, held = documents(spark, sf_dir), language_id.held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return toxicity.predict(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
