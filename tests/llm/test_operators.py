"""Operators on texts against plain computations, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from manyscale.llm import (bpe_replay, common, decontaminate, language_id, line_dedup, lm_score, quality_rules, secret_scan,
                           simhash_groups, token_counts, token_files)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BODY = "the cat sat on the mat and looked at the moon while the dog slept by the door of the old house"
ROWS = [(1, BODY, "en", "a", 1), (2, BODY, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "lonely words", None, "b", 3),
        (5, " \n\t ", "en", "b", 1), (6, "word " * 30_000, "en", "c", 1), (7, "Ünï漢字 <|endoftext|>  x\n\ny", "de", "c", 1), (7, BODY.upper(), "de", "c", 1),
        (8, "a\n" * 50 + "&&& ### $$$", "fr", "c", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS words", "2 AS n", "3 AS key", "4 AS kept", "5 AS row").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows):
    return sorted((r for r in rows), key=repr)


def vocabulary(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def strings(seed, n=1500):
    parts = ["a", "B", "'s", " ", "  ", "\n", "\t", "É", "Σ", "aaaa", "12", "½", "_!", "\x1c", "\x85", "\xa0", "漢", "<|endoftext|>", " the", "ing", "😀", "İ", "\x00"]
    pick = random.Random(seed)
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 10))) for _ in range(n)]


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    content = vocabulary("word_bpe_49k.json")
    library, counts = Tokenizer.from_str(content), token_counts.piece_counts(content)
    for text in strings(1):
        assert counts.of(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    got = token_counts.count_tokens(docs, content).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in ROWS]
    assert by_text(tuple(r) for r in got) == by_text(want)
    assert token_counts.count_tokens(empty, content).count() == 0


def test_proven_whole_tokens_merge_to_one():
    known = token_counts.piece_counts(vocabulary("word_bpe_49k.json")).vocabulary
    assert len(known.whole) > 10_000 and all(known.merged(token) == 1 for token in list(known.whole)[:500])


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    content, folder = vocabulary("byte_bpe_50k.json"), common.scratch(spark)
    library = Tokenizer.from_str(content)
    shards = token_files.write_token_files(docs, folder, content, length=16)
    rows = sorted(token_files.read_token_files(spark, folder, shards).collect(), key=lambda r: r.start)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (doc_id, text, *_) in zip(rows, order, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert bytes(row.ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    name, n = shards[0]
    stream = token_files.open_stream(folder, name)
    ids, mask = token_files.sequence(stream, (n - 1) // 16)
    assert len(ids) == 16 and mask.sum() == (n - 1) % 16 + 1 and not ids.flags.owndata
    assert token_files.write_token_files(empty, common.scratch(spark), content) == []


def test_pieces_equal_whole_texts():
    import tiktoken
    from tokenizers import Tokenizer

    path, content = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), vocabulary("byte_bpe_50k.json")
    texts, known, pieces = strings(2), bpe_replay.replayed(public_tokenizers.PATTERN, open(path, "rb").read()), token_files.piece_ids(content, "<u2")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_replay.read_ranks(path), special_tokens={})
    library = Tokenizer.from_str(content)
    known.learn(texts)
    pieces.learn(texts)
    for text in texts:
        assert np.frombuffer(known.of(text), "<u4").tolist() == own.encode_ordinary(text) and known.decode(known.of(text)) == text.encode()
        assert np.frombuffer(pieces.of(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_late_pairs_of_lower_rank():
    ranks = {bytes((b,)): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"xab": 258, b"aa": 259, b"aaa": 260}
    tokens = [b"abcab", b"xabab", b"aaaaa", b"", b"aaabc"]
    assert bpe_replay.replay(tokens, ranks) == [bpe_replay.merged_alone(t, ranks) for t in tokens]


def test_bpe_on_rows(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_replay.encode(docs, path, public_tokenizers.PATTERN)
    assert by_text(bytes(r.decoded) for r in coded.collect()) == by_text((t or "").encode() for _, t, *_ in ROWS)
    assert by_text(r.text for r in bpe_replay.decode(coded, path).collect()) == by_text(t or "" for _, t, *_ in ROWS)
    assert bpe_replay.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets_equal_backtracking(docs, empty):
    rules = (*secret_scan.BASE_RULES, *secret_scan.MORE_RULES)
    known, pick = secret_scan.scanner(rules), random.Random(3)
    parts = ["token", "SECRET", "api_key", "passwd", "=", ":", " ", "'", '"', "abcdefgh", "abc", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "0123", "é", "\n", "-"]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 12)))
        assert [s for s in known.spans(text) if s[0] in ("assign", "access", "hex")] == base_spans(text), repr(text)
    assert [s[0] for s in known.spans("-----BEGIN RSA PRIVATE KEY----- ghp_" + "Zq9" * 14)] == ["private_key", "code_host"]
    assert all(r.found == [] for r in secret_scan.scan(docs).collect()) and secret_scan.scan(empty).count() == 0


def test_language_mixture(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out("doc_id", 4, 2)
    languages, model = language_id.fit(table.where(~held))
    rows = language_id.predict(table.where(held), languages, model).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows) and all(0 < r.score <= 1 for r in rows)
    english, french = (table.where(f"lang = '{name}' AND n_chars BETWEEN 1000 AND 3000").first().text[:1000] for name in ("en", "fr"))
    both = language_id.predict(spark.createDataFrame([(1, english + " " + french)], "doc_id long, text string"), languages, model).first()
    assert {"en", "fr"} <= set(both.shares) and abs(sum(both.shares.values()) - 1) < 1e-6
    odd = {r.doc_id: r for r in language_id.predict(docs, languages, model).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[5].lang_pred == "und"
    nothing, zero = language_id.fit(empty)
    assert nothing == [] and language_id.predict(docs, nothing, zero).where("lang_pred <> 'und'").count() == 0


def test_base_scores_and_model(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language_id.held_out("doc_id", 5, 1)
    for docs_of in (table, docs):
        rows, got = docs_of.collect(), lm_score.score(docs_of, held).collect()
        kept_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False
        tokens = lambda t: (t or "").encode().lower().split() + [b""]
        counts = Counter(w for r in rows if not kept_out(r.doc_id) for w in tokens(r.text))
        n, v = sum(counts.values()), len(counts)
        want = [(r.doc_id, len(w := tokens(r.text)), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)) for r in rows]
        assert by_text((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == by_text(want)
        assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lm_score.score(empty, held).count() == 0


def test_filter_holds_quantised_counts(spark):
    texts = spark.createDataFrame([("a b " * 40 + "c",)], "text string")
    model, hashes = lm_score.fit(texts, 82), lm_score.Hashes()
    single, pairs, _ = lm_score.ngrams(["a b", "zz"], hashes)
    words, couples = model.counts(lm_score.mix(single), 0), model.counts(pairs, 1)
    assert 32 <= words[0] < 64 and 32 <= words[1] < 64 and 32 <= couples[1] < 64 and words[3] < 4


def test_filter_enters_rare_ngrams_at_every_size(spark):
    model, hashes = lm_score.fit(spark.createDataFrame([("a b " * 40 + "c",)], "text string"), 1 << 28), lm_score.Hashes()
    single, pairs, _ = lm_score.ngrams(["b c"], hashes)
    assert model.counts(lm_score.mix(single), 0)[1] == 1 and model.counts(pairs, 1)[1] == 1


def test_filter_in_parts_equals_one(spark, docs, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text"))
    held = language_id.held_out("doc_id", 5, 1)
    monkeypatch.setattr(lm_score, "SEGMENT", 1 << 12)
    one, whole = lm_score.fit(table, 400_000), by_text(lm_score.score(table, held).collect())
    monkeypatch.setattr(lm_score, "PART", 1 << 14)
    monkeypatch.setattr(lm_score, "HELD", 1 << 13)
    assert len(one.parts) == 1 and len(lm_score.fit(table, 400_000).parts) > 3
    assert by_text(lm_score.score(table, held).collect()) == whole


def repeated(words):
    spans = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if spans[tuple(words[i:i + 8])] > 1 for k in range(8)})


def test_quality_ledger(docs, empty):
    rows = quality_rules.ledger(docs).collect()
    for r in rows:
        words = re.findall("[^ \t-\r]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), repeated(words), len(lines) - len(set(lines)))
        assert bool(r.failed & 1) == (r.n_words < 20) and bool(r.failed & 2) == (100 * r.n_repeat_words > 30 * r.n_words)
    ablation = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    for k, (name, _) in enumerate(quality_rules.RULES):
        assert ablation[name].n_failed == sum(bool(r.failed >> k & 1) for r in rows) and ablation[name].n_only == sum(r.failed == 1 << k for r in rows)
    assert quality_rules.apply_policy(quality_rules.ledger(docs), "base").where("kept").count() == sum(r.failed & 3 == 0 for r in rows)
    assert quality_rules.ledger(empty).count() == 0


def test_quality_of_other_scripts(spark):
    clean = {
        "hi": "भारत एक विशाल देश है जहाँ अनेक भाषाएँ बोली जाती हैं और हर राज्य की अपनी संस्कृति है। यहाँ के लोग त्योहारों को बड़े उत्साह से मनाते हैं।",
        "ta": "தமிழ் மொழி மிகவும் பழமையான மொழி ஆகும். இந்த மொழியில் பல நூல்கள் எழுதப்பட்டுள்ளன. மக்கள் தினமும் இதை வீட்டில் பேசி வருகின்றனர். நாங்கள் பள்ளியில் படித்த கதை ஒன்று இன்றும் நன்றாக நினைவில் உள்ளது.",
        "zh": "\n".join(f"今天我们第{a}次去了{b}的图书馆,在那里读了很多关于历史和科学的书。" for a, b in zip("一二三四五六七八九十百千" * 2, "东南西北上中下左右前后内外新旧大小高低远近明春秋")),
        "ja": "\n".join(f"昨日は{b}の町へ行って、友だちと一緒においしいラーメンを食べました。" for b in "東南西北上中下左右前後内外新旧大小高低遠近"),
        "th": "\n".join(f"วันนี้เราไปห้องสมุดครั้งที่{k}และอ่านหนังสือเกี่ยวกับประวัติศาสตร์" for k in range(22))}
    rejected = {"glued": " ".join(f"averyveryverylongword{k}" for k in range(30)), "digits": " ".join(f"{k}{k}{k} ab" for k in range(100, 130)),
                "glued with some Chinese": " ".join(f"averyveryverylongword{k}中文" for k in range(30))}
    rows = spark.createDataFrame([*clean.items(), *rejected.items()], "doc_id string, text string")
    kept = {r.doc_id: (r.kept, r.failed) for r in quality_rules.apply_policy(quality_rules.ledger(rows)).collect()}
    assert {name for name, (ok, _) in kept.items() if ok} == set(clean), kept


def apart(a, b):
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_against_all_pairs(spark, docs, empty):
    pick, rows = random.Random(4), []
    for i in range(30):
        rows.append((i, "\n".join(" ".join(pick.choice("ab") for _ in range(pick.randint(0, 7))) for _ in range(4))))
    rows.append((30, BODY + "\n" + BODY.replace("cat", "dog") + "\n" + BODY + " again\n" + BODY.removeprefix("the ")))
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    seen = []
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            words = line.split()
            if not words or not any(words == w or (max(len(words), len(w)) >= 5 and apart(words, w) <= 1) for w in seen):
                kept.append(line)
            if words:
                seen.append(words)
        assert got[i] == "\n".join(kept), i
    odd = line_dedup.dedup(docs).collect()
    assert len(odd) == len(ROWS) and {r.text for r in odd if r.doc_id == 3} == {None} and {r.text for r in odd if r.doc_id == 2} == {""}
    assert line_dedup.dedup(empty).count() == 0


def test_groups_against_all_pairs(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    near = [(10_000 + k, " ".join(BODY.split() * 8 + [f"w{k}", f"v{k}"])) for k in range(60)]
    table = table.union(spark.createDataFrame(near, "doc_id long, text string")).union(docs.where("doc_id < 7").select("doc_id", "text"))
    rows, got = table.collect(), simhash_groups.groups(table).collect()
    prints = {(r.doc_id, r.text): simhash_groups.fingerprint(r.text) for r in rows}
    parent = {p: p for p in prints.values()}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for (i, _), p in prints.items():
        least[root(p)] = min(i, least.get(root(p), i))
    assert by_text((r.doc_id, r.fingerprint, r.component_id) for r in got) == by_text((r.doc_id, f"{(p := prints[r.doc_id, r.text]):016x}", least[root(p)]) for r in rows)
    assert simhash_groups.groups(empty).count() == 0
    assert {r.fingerprint for r in simhash_groups.groups(docs).where("doc_id IN (3, 4, 5)").collect()} == {"0" * 16}


def test_anchors_and_dense_clusters():
    values = np.unique(np.random.default_rng(5).integers(0, 1 << 62, 200))
    values = np.unique(np.concatenate([values, *[values ^ (1 << k) ^ (3 << 40) for k in (1, 33, 50)]]))
    keys, own, home = simhash_groups.replicate(values, 4)
    assert home.sum() == 2 * len(values) and (simhash_groups.syndromes(keys & 0xFFFFFFFF) == 0).all()
    a, b = simhash_groups.linked(keys, own, home, 4)
    want = {(int(p), int(q)) for p in values for q in values if p > q and int(p ^ q).bit_count() <= 4}
    assert set(zip(a.tolist(), b.tolist())) == want
    ball = np.array([1 << i | 1 << j for i in range(40) for j in range(i)])
    assert simhash_groups.local_groups(ball, 4).shape[1] == len(ball) - 1


def weighted(a, b):
    a, b = (Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return 5 * (a & b).total() >= 4 * (a | b).total() > 0


def test_decontamination_against_all_windows(spark, docs, empty):
    words = BODY.split()
    items = spark.createDataFrame([(1, BODY), (2, " ".join(words[:9])), (3, None), (4, "too short"), (5, "x y z u v w q r s t o p")], "item_id long, text string")
    rows = [(1, "lead in " + BODY.upper() + " and out"), (2, BODY.replace("moon", "sun")), (3, " ".join(words[1:])), (4, " ".join(words[:7])), (5, "nothing of it"),
            (6, " ".join(words * 300)), (6, "x y z u v w q r s t o p"), (7, "x y z u v w q r s t o"), (8, "z x y z u v w q r s t o")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = by_text((r.doc_id, r.text, r._items) for r in decontaminate.mark(table, items).collect())
    texts = [(r.item_id, r.text.lower().split()) for r in items.collect() if r.text]
    find = lambda t: [i for i, w in texts if any(weighted(t.lower().split()[s:s + len(w)], w) for s in range(max(1, len(t.split()) - len(w) + 1)))]
    assert got == by_text((i, t, find(t)) for i, t in rows) and any(items for *_, items in got)
    shuffled, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0
    try:
        assert by_text((r.doc_id, r.text, r._items) for r in decontaminate.mark(table, items).collect()) == got
    finally:
        decontaminate.BROADCAST_ROWS = shuffled
    assert decontaminate.mark(docs, items).count() == len(ROWS) and decontaminate.clean(empty, items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)


def test_decontamination_of_repeated_tails_and_long_items(spark):
    import duckdb
    import pandas as pd

    from manyscale.llm import queries

    pick, docs, items = random.Random(6), [], []
    for k, (n, tail) in enumerate([(60, 6), (104, 11), (204, 22), (204, 22), (204, 22), (60, 7), (104, 12), (204, 23), (404, 44), (404, 46)]):
        words = [f"w{pick.randrange(10 ** 9)}" for _ in range(n)]
        items.append((k, " ".join(words)))
        docs.append((k, " ".join(["lead"] * 3 + words[:n - tail] + ["-"] * tail + ["out"])))
        items.append((k + 100, " ".join(words[:n - tail] + ["-"] * tail)))
        docs.append((k + 100, " ".join(words[:n - 2 * tail] + ["-"] * 2 * tail)))
    got = decontaminate.mark(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
        db.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
        want = db.execute(queries.ORACLES["op10_decontamination"]).fetchall()
    assert sorted((r.doc_id, ",".join(map(str, r._items))) for r in got.collect()) == sorted((i, found) for i, _, _, found in want)
    assert {0, 1, 2, 3, 4} <= {i for i, _, _, found in want if str(i) in found.split(",")}


def test_pipeline_stages_on_awkward_rows(spark, docs, empty, tmp_path):
    far = "completely other words stand here so that this one text is near to none of those above it at all"
    more = [(None, far, "en", "a", 1), (None, far, "en", "a", 1), (1, far.upper(), "en", "a", 1), (1, "a third text that shares its key with two others but no words", "en", "a", 1),
            (9, "rows like this one are there twice", "en", "a", 1), (9, "rows like this one are there twice", "en", "b", 1), (None, "a lonely text without any key", "en", "a", 1)]
    table = docs.select(corpus_pipeline.COLUMNS).union(spark.createDataFrame(more, SCHEMA)).repartition(3)
    rows = [tuple(r) for r in table.collect()]
    prints = [simhash_groups.fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    assert len(got) == len(set(group)) and {group[rows.index(r)] for r in got} == set(group)
    for r in got:
        ids = [x[0] for x, g in zip(rows, group) if g == group[rows.index(r)] and x[0] is not None]
        assert r[0] == min(ids, default=None)
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0
    spark.createDataFrame([(1, far)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = [r for r in rows if len((r[1] or "").split()) >= 20 and r[1] not in (ROWS[6][1], ROWS[9][1])]
    assert by_text(tuple(r) for r in stages["quality rules"](spark, table, "").collect()) == by_text(good)
    lines = stages["line dedup"](spark, table, "").collect()
    assert by_text(r.doc_id for r in lines) == by_text(r[0] for r in rows) and all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in lines)
    assert by_text(tuple(r) for r in stages["benchmark decontamination"](spark, table, str(tmp_path)).collect()) == by_text(r for r in rows if (r[1] or "").lower() != far)
    coded = stages["token ids"](spark, table, "").collect()
    assert by_text((r.doc_id, r.decoded_sha256) for r in coded) == by_text((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


def test_pipeline_against_a_plain_run(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    stages, docs = dict(corpus_pipeline.STAGES), table
    for name in list(stages)[:-1]:
        docs = common.stored(stages[name](spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= table.count()
    assert {i: r.decoded_sha256 for i, r in got.items()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    kept, good = set(got), {r.doc_id for r in quality_rules.ledger(table).where("failed = 0").collect()}
    assert kept <= good and len(kept) >= 0.8 * len(good)
