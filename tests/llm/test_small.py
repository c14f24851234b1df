"""Edge cases of every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import gzip
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, exact_dedup, langid, mixing, neardup, ngram, pii, tokenbin, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 60_000 + "x" * 100_000
#: Names that operators use for their own columns or results.
CLASH = ["id", "t", "d", "n", "score", "kept", "keep_id", "target", "taken", "_t", "part", "key", "value", "node", "h", "size", "position", "spans"]


def docs(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], SCHEMA)
    for c in CLASH if clash else []:
        df = df.withColumn(c, F.lit("clash"))
    return df


def rough(rng=random.Random(3), n=40):
    words = ["the", "of", "stone", "river", "house", "élan", "und", "der", "x1", "A"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(n)]
    return [*rows, (100, None, "en", "a"), (101, "", "en", "a"), (102, " \t\n", None, None), (None, "no id here", "en", "a"), (None, None, None, None), (103, LONG, "en", "b"), rows[0], rows[0], (104, rows[1][1], "en", "c")]


OPS = {
    "exact": lambda df, s: exact_dedup.exact_dedup(df),
    "lang": lambda df, s: langid.identify(df),
    "tox": lambda df, s: toxicity.toxicity(df, s.createDataFrame([(i, 1, int(i % 2)) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")),
    "decon": lambda df, s: decontam.decontaminate(df, s.createDataFrame([(1, "the of the of"), (2, None), (None, "no id here"), (3, "")], "item_id bigint, text string")),
    "near": lambda df, s: neardup.near_duplicates(df),
    "mix": lambda df, s: mixing.mix(df),
    "pii": lambda df, s: pii.find_pii(df),
    "warc": lambda df, s: warc.round_trip(df.select("*", F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))),
    "lm": lambda df, s: ngram.lm_score(df),
    "tokens": lambda df, s: tokenbin.token_ids(df, str(__import__("public_tokenizers").path("byte_bpe_50k.json"))),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_rough_rows_give_a_row_each(spark, name):
    rows = rough()
    got = OPS[name](docs(spark, rows), spark)
    key = "page_id" if name == "warc" else "doc_id"
    assert Counter(r[0] for r in got.select(key).collect()) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_table(spark, name):
    assert OPS[name](docs(spark, []), spark).collect() == []


@pytest.mark.parametrize("name", sorted(OPS))
def test_texts_beyond_a_piece(spark, name):
    """Two equal texts of 4.5 MB, more than a piece, and short ones around them."""
    text = F.when(F.col("id") % 2 == 1, F.repeat(F.lit("word "), 900_000)).otherwise(F.lit("some words"))
    table = spark.range(0, 4, 1, 2).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(None).cast("bigint").alias("n_chars"))
    key = "page_id" if name == "warc" else "doc_id"
    assert sorted(r[0] for r in OPS[name](table, spark).select(key).collect()) == [0, 1, 2, 3]


# ---- exact deduplication


def test_exact_against_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab \t") for _ in range(rng.randrange(5))) for _ in range(300)]
    rows = [(i, t, None, None) for i, t in enumerate(base)] + [(1000 + i, "copy of one", None, None) for i in range(500)]
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, rows), heavy_share=0.05).collect()}
    for norm, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(members)[1], len(members), i == min(members)[1], hashlib.sha256(norm.encode()).hexdigest())


def test_heavy_digests_are_found(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("d"))
    assert exact_dedup.heavy_digests(df, "d", 0.01) == ["hot"]


def test_exact_keeps_one_of_repeated_rows(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(1, "a", None, None)] * 3)).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.group_size for r in got} == {3}


def test_native_plans_hold_no_python(spark):
    for df in (exact_dedup.exact_dedup(docs(spark, rough())), mixing.in_training_order(mixing.mix(docs(spark, rough())))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- language


def _slow_phrases(text, probe):
    i = n = 0
    while i < len(probe):
        k = 1
        while i + k < len(probe) and probe[i : i + k + 1] in text:
            k += 1
        i, n = i + k, n + 1
    return n


@pytest.mark.parametrize("room", [langid.DENSE_BYTES, 0])
def test_whole_texts_are_parsed_into_longest_phrases(room, monkeypatch):
    monkeypatch.setattr(langid, "DENSE_BYTES", room)  # with no room all tables are sparse
    rng = random.Random(31)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for known in ("the quick brown fox jumps", made("abcd ", 3000), "abc" * 1000 + "xyz"):  # the last has phrases over many blocks
        model = langid.Model({"a": [known], "b": ["der schnelle braune fuchs springt"]})
        probes = ["quick fox", "q", "zzz", "abc" * 900 + "x" + "cab" * 600, made("abcdz", 2500), known[200:2700] + known[:1500], "é" * 700, made("abc", 3 * langid.BLOCK)]
        for probe, rates in zip(probes, model.rates(probes)):
            for j, text in enumerate((known, "der schnelle braune fuchs springt")):
                cut = lambda t: "".join(map(chr, langid.plain(t)))
                want = _slow_phrases(cut(text), cut(probe)) * model.parsers[j].bits / max(1, len(cut(probe)))
                assert rates[j] == pytest.approx(want), (known[:10], probe[:10])


def test_texts_that_repeat_themselves_take_time_in_proportion():
    model, took = langid.Model({"a": ["word " * 800], "b": ["other " * 800]}), []
    for n in (20_000, 80_000):
        began = time.process_time()
        model.predict(["word " * n])
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_scripts_with_many_letters_are_told_apart():
    rng, texts = random.Random(7), {}
    for k, low, high in (("ko", 0xAC00, 0xAE00), ("zh", 0x4E00, 0x5000), ("ja", 0x5200, 0x5400), ("en", 0x61, 0x7A)):
        words = ["".join(chr(rng.randrange(low, high)) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
        texts[k] = [" ".join(rng.choice(words) for _ in range(n)) for n in (1500, 60)]
    model = langid.Model({k: v[:1] for k, v in texts.items()})
    assert max(p.width for p in model.parsers) > 300
    assert [p[0] for p in model.predict([texts[k][1] for k in texts])] == list(texts)


def test_language_of_texts_without_letters_and_ties():
    model = langid.Model({"a": ["abcabcabc " * 20], "b": ["xyzxyz " * 20]})
    assert [p[0] for p in model.predict([None, "", "12 34 !", "½ ² Ⅷ ①", "xyz", "abc" * 5000])] == ["und", "und", "und", "und", "b", "a"]
    assert langid.Model({}).predict(["abc"]) == [("und", 0.0)]
    tie = langid.Model({"b": ["abc"], "a": ["abc"]}).predict(["abc", "q"])
    assert [p[0] for p in tie] == ["a", "a"] and tie[0][1] == 0.5


def test_language_accuracy_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert got.a > 0.97


# ---- toxicity


def test_folding():
    assert toxicity.fold("You ID10T, m0r0n!") == " you idiot moron "
    assert toxicity.fold("іdіоt Ｉｄｉｏｔ i​diot") == " idiot idiot idiot "
    assert toxicity.fold("Größe, ÉTÉ") == " größe été " and toxicity.fold(None) == " " == toxicity.fold("12 -")


def test_exception_phrases_cancel_hits():
    s = toxicity.Scorer(toxicity.Model({"trash": 1.0, "moron": 1.0}, ("trash can",), 0.01))
    assert [len(s.hits(toxicity.fold(t))) for t in ("the trash can is full", "trash and moron", "trashy")] == [0, 2, 0]
    assert s.score(toxicity.fold("trash moron trash")) > 0.5 > s.score(toxicity.fold("a trash can " * 5))
    assert toxicity.Scorer(toxicity.Model()).score(" a ") == 0.0


def test_scores_against_a_naive_matcher():
    rng = random.Random(41)
    vocab = ["bad", "worse", "ugly", "nice", "dog", "can", "the"]
    model = toxicity.Model({"bad": 1.0, "worse": 0.6, "ugly": 0.3}, ("bad dog", "the ugly", "can worse", "worse bad"), 0.02)
    s = toxicity.Scorer(model)
    for _ in range(500):
        ws = [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]
        free = {i + k for i in range(len(ws)) for p in model.exceptions for k in range(len(p.split())) if ws[i : i + len(p.split())] == p.split()}
        total = sum(model.weights[w] for i, w in enumerate(ws) if w in model.weights and i not in free)
        d = max(0.0, total - toxicity.FREE_WEIGHT) / (len(ws) + toxicity.MORE_WORDS)
        want = 1 / (1 + (model.threshold / d) ** model.steepness) if d else 0.0
        assert s.score(toxicity.fold(" ".join(ws))) == pytest.approx(want), ws


def test_a_score_at_the_threshold_is_toxic(spark):
    text = "bad bad x x x x"  # weight 2 less what is free, over six words and those added
    model = toxicity.Model({"bad": 1.0}, (), (2 - toxicity.FREE_WEIGHT) / (6 + toxicity.MORE_WORDS))
    table, labels = docs(spark, [(1, text, None, None), (2, None, None, None), (3, "", None, None), (2, None, None, None)]), None
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.toxicity(table, labels, model=model).collect()}
    assert got == {1: (0.5, 1), 2: (0.0, 0), 3: (0.0, 0)}
    kept = toxicity.drop_toxic(table, labels, model=model)
    assert Counter(r.doc_id for r in kept.collect()) == {2: 2, 3: 1} and kept.columns == table.columns


def test_many_hits_and_phrases_take_time_in_proportion():
    s = toxicity.Scorer(toxicity.Model({"bad": 1.0}, ("bad dog",)))
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        s.hits(" bad dog bad" * n + " ")
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_toxicity_accuracy_on_held_out_rows(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs_, labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


# ---- decontamination


def _slow_hits(text, items, size=13):
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    ws, marks, found = cut(text), set(), set()
    for i, t in items:
        it = cut(t)
        for k in range(max(1, len(it) - size + 1) if it else 0):
            win = it[k : k + size]
            for p in range(len(ws) - len(win) + 1):
                if ws[p : p + len(win)] == win:
                    marks |= set(range(p, p + len(win)))
                    found.add(str(i))
    return len(ws), len(marks), sorted(found)


@pytest.mark.parametrize("most, hashes", [(200_000, 4_000_000), (60, 4_000_000), (5, 7)])
def test_decontamination_against_brute_force(spark, most, hashes, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_WINDOWS", most)
    monkeypatch.setattr(decontam, "LIST_HASHES", hashes)
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "É", "c3", "d"])
    items = [(i, ", ".join(word() for _ in range(rng.randrange(0, 20)))) for i in range(8)] + [(8, None), (2, "a b a b a b a")]
    rows = [(i, "; ".join(word() for _ in range(rng.randrange(0, 80))), None, None) for i in range(40)]
    rows += [(100 + i, f"Before... {(items[i][1] or '').upper()} after", None, None) for i in range(8)]
    got = decontam.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    for r in got.collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        n, hit, found = _slow_hits(text, items)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n)
        inside = sum(len(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text[s.start : s.end])) for s in r.spans)
        assert inside == hit
    kept = decontam.drop_contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.where("not contaminated").collect()} and kept.columns == docs(spark, rows).columns


def test_items_without_id_are_one_item(spark):
    items = spark.createDataFrame([(None, "a b"), (None, "c d"), ("null", "a b")], "item_id string, text string")
    got = decontam.decontaminate(docs(spark, [(1, "x a b c d", None, None)]), items).first()
    assert (got.n_items, got["items"], got.n_hit) == (2, [None, "null"], 4)


def test_a_benchmark_of_two_million_words(spark):
    items = spark.range(2_000).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), (F.col("id") * 1000 + i).cast("string"))), " ").alias("text"))
    run = lambda a, n: " ".join(f"W{i}" for i in range(a, a + n))
    rows = [(1, f"before {run(1_234_567, 20)}, after", None, None), (2, run(5_000, 12), None, None), (3, run(1_999_980, 20), None, None), (4, None, None, None)]
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.decontaminate(docs(spark, rows), items).collect()}
    assert got == {1: (20, ["1234"]), 2: (0, []), 3: (20, ["1999"]), 4: (0, [])}


@pytest.mark.parametrize("most, hashes", [(200_000, 4_000_000), (5, 7)])
def test_the_pipeline_drops_long_texts_that_hold_a_passage(spark, most, hashes, monkeypatch, tmp_path):
    import corpus_pipeline as cp

    monkeypatch.setattr(decontam, "MOST_WINDOWS", most)
    monkeypatch.setattr(decontam, "LIST_HASHES", hashes)
    run = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    spark.createDataFrame([(1, run(0, 30)), (2, run(100, 13)), (3, "yes"), (4, "two words"), (5, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    filler = "other " * 2_000
    texts = {
        1: f"{filler}{run(0, 30)} {filler}", 2: filler + run(9, 13).upper(), 3: f"{run(100, 13)} {filler}",  # 43, 13 and 13 of thousands of words
        4: f"{filler}{run(0, 12)} x {run(13, 12)}", 5: f"{filler}{run(100, 12)} yes", 6: f"{filler}yes yes yes yes yes yes yes two words two words two words two words", 7: filler, 8: None, 9: "",
        10: "yes", 11: run(5, 13),
    }
    rows = docs(spark, [(i, t, None, None) for i, t in texts.items()])
    assert sorted(r.doc_id for r in cp.decontaminate_stage(spark, rows, str(tmp_path)).collect()) == [4, 5, 6, 7, 8, 9]


# ---- token files


def test_blocks_round_trip_and_checkpoints():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 5000, 400_000):
        ids = rng.zipf(1.3, n).clip(0, 60_000).astype(np.uint32)
        table = tokenbin.Table(tokenbin.quantise(np.bincount(ids)))
        assert int(table.freq.sum()) == 1 << tokenbin.SCALE
        data = tokenbin.encode_block(ids, [(7, n)], table)
        docs_, counts, got = tokenbin.decode_block(data, table, table.slots())
        assert docs_ == [7] and counts.tolist() == [n] and (got == ids).all()
        lanes = max(1, min(tokenbin.LANES, n // 64))
        if n > lanes * tokenbin.STEPS_KEPT:
            part = tokenbin.decode_block(data, table, table.slots(), 1, 2)[2]
            at = lanes * tokenbin.STEPS_KEPT
            assert (part == ids[at : at + len(part)]).all() and len(part) > 0
        bad = bytearray(data)
        bad[-9 if n > 64 else 20] ^= 1
        with pytest.raises(ValueError):
            tokenbin.decode_block(bytes(bad), table, table.slots())


def test_pieces_give_the_tokens_of_whole_texts():
    import public_tokenizers

    e = tokenbin.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), 2)
    assert e.by_piece
    rng = random.Random(6)
    for _ in range(400):
        t = "".join(rng.choice(["a", "The", " ", " ", "\n", "'s", "é", "12", ",", " ", "\t", "x", "日本", "<|endoftext|>"]) for _ in range(rng.randrange(0, 25)))
        assert e.encode(t) == (e.whole(t) + e.end if t else e.end)
    for c in map(chr, range(0xA0, 0x100)):  # letters that are put in byte-level form here, and their neighbours
        for t in (c, f" {c}", f"a {c}b,{c} x.\n{c}y don't", f"a  {c}\n\n{c}"):
            assert e.encode(t) == e.whole(t) + e.end


def test_many_texts_at_once_and_turnover(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokenbin, "CACHE_WORDS", 20)
    monkeypatch.setattr(tokenbin, "STORE_WORDS", 30)
    e = tokenbin.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), 2)
    rng = random.Random(12)
    for _ in range(20):
        texts = [None, "", *[" ".join(rng.choice(["", "\n"] * (k % 2) + [f"w{rng.randrange(50)},", "the", "É.", "x.\ny"]) for _ in range(k)) for k in range(30)]]
        ids, n = e.encode_all(pa.array(texts, pa.string()))
        assert ids.astype(np.uint32).tobytes() == b"".join(e.whole(t) + e.end for t in texts) and n.tolist() == [len(e.whole(t)) // 4 + 1 for t in texts]


def test_token_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok, rows = Tokenizer.from_file(path), [r for r in rough() if r[0] is not None]
    got = sorted(tokenbin.token_ids(docs(spark, rows), path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    at, texts = 0, {r[0]: r[1] for r in rows}
    for r in got:
        ids = [*(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_tokens_in_the_order_of_files(spark, tmp_path):
    import public_tokenizers

    path, ids = str(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3).sample(range(1000), 40)
    table = docs(spark, [(i, f"text {i}", None, None) for i in ids], clash=False)
    assert tokenbin.file_order(table) == ()
    placed = table.select(*table.columns, F.monotonically_increasing_id().alias("m")).repartitionByRange(4, "m").sortWithinPartitions("m").drop("m")
    placed.write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    got = tokenbin.token_ids(files, path, order=tokenbin.file_order(files)).orderBy("start").collect()
    assert [r.doc_id for r in got] == ids and [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))


# ---- near duplicates


def _slow_components(rows, words, per_cent):
    sets = []
    for _, t, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set()))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, (i, *_) in zip(root, rows):
        least[r] = min(i, least.get(r, i))
    return [(i, len(s), least[r]) for (i, *_), s, r in zip(rows, sets, root)]


def _near_rows(rng, groups, size, words=60):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            one = list(base)
            for _ in range(rng.randrange(0, 4)):
                one[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(one), None, None))
    rng.shuffle(rows)
    return rows + [(10_000, None, None, None), (10_001, "a b", None, None), (10_002, "A  b\n", None, None)]


@pytest.mark.parametrize("groups, size", [(30, 4), (1, 150)])
def test_near_duplicates_against_brute_force(spark, groups, size, monkeypatch):
    if groups == 1:  # a large node at every level, cut to blocks
        monkeypatch.setattr(neardup, "LEAF", 8)
        monkeypatch.setattr(neardup, "BLOCK", 40)
        monkeypatch.setattr(neardup, "BLOCK_OUT", 5)
        monkeypatch.setattr(neardup, "BLOCK_ALL", 30)
    rows = _near_rows(random.Random(groups), groups, size)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), words=4).collect())
    assert got == sorted(_slow_components(rows, 4, 80))
    kept = neardup.drop_near_duplicates(docs(spark, rows), words=4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got}) and kept.columns == docs(spark, rows).columns


def test_recall_just_above_the_threshold(spark):
    """300 pairs of similarity 0.80 to 0.85 and 100 just below: at least 0.98 of the first are linked, none of the last."""
    rng, rows, linked = random.Random(51), [], 0
    for k in range(400):
        n, shared = 90, 79 if k >= 300 else rng.randrange(80, 84)  # shared of 180 - shared: 0.78, and 0.80 to 0.856
        words = [f"w{rng.randrange(10**6)}" for _ in range(2 * n)]
        first = words[: n + 3]
        second = first[: shared + 3] + words[n + 3 : n + 3 + n - shared]
        rows += [(2 * k, " ".join(first), None, None), (2 * k + 1, " ".join(second), None, None)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows, clash=False), words=4).collect()}
    linked = sum(got[2 * k + 1] == 2 * k for k in range(300))
    assert linked >= 0.98 * 300 and all(got[i] == i for i in range(600, 800))


@pytest.mark.parametrize("broadcast", [1_000_000, 2])
def test_broken_forests_and_joined_levels(spark, broadcast, monkeypatch):
    """Groups about the threshold, so that forests of leaves have links that are none."""
    again = []
    monkeypatch.setattr(neardup, "leaf_links", lambda *a, f=neardup.leaf_links: again.append(f(*a)) or again[-1])
    monkeypatch.setattr(neardup, "BROADCAST_VERTICES", broadcast)  # at 2, deeper levels are found by joins
    monkeypatch.setattr(neardup, "LEAF", 12)
    rng, rows = random.Random(21), []
    for g in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(12):
            one = list(base)
            for _ in range(rng.randrange(1, 4)):
                one[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(one), None, None))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), words=4).collect())
    assert got == sorted(_slow_components(rows, 4, 80)) and again[0] is not None


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501)]
    got = {r.v: r.root for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f", None, None)] * 3 + [(2, "q w e r t y", None, None)]
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(docs(spark, rows)).collect()) == [1, 2]


def test_a_pair_at_the_threshold_keeps_a_common_node():
    lost, p = 0.0, neardup.PER_CENT / 100
    for k in range(neardup.COORDS + 1):  # coordinates that agree: all trees draw from the same ones
        kept = 1.0
        for _ in range(neardup.LEVELS[-1]):
            one = 1 - k / neardup.COORDS * kept
            kept = 1 - (0.75 * one + 0.25 * one * one)
        lost += math.comb(neardup.COORDS, k) * p**k * (1 - p) ** (neardup.COORDS - k) * (1 - kept) ** neardup.TREES
    assert lost < 0.001


# ---- mixing


def test_mix_targets_and_limits(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 40), None, rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(1000 + i, "w " * 30, None, "hot") for i in range(150)]
    got = mixing.mix(docs(spark, rows)).collect()
    source = {i: s for i, _, _, s in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    level = [target[s] / (5, 2, 1)[k % 3] for k, s in enumerate(order) if target[s] < 2 * sizes[s]]
    assert all(x == pytest.approx(level[0]) for x in level)
    for s in order:
        assert taken[s] == math.floor(target[s])
    assert got and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(3)).collect()), key=repr)


def test_due_inverts_the_schedule(spark):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(s, c) for s in shares for c in range(3)], "s double, c int")
    for r in df.select("s", "c", mixing.due(F.col("s"), F.col("c")).alias("t")).collect():
        knots, done = mixing.SCHEDULES[r.c], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            x = min(max(r.t - t0, 0), t1 - t0)
            done += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        assert done == pytest.approx(r.s)


def test_mixed_documents_come_as_often_as_taken(spark):
    rows = [(i, "w " * (1 + i % 7), None, "ab"[i % 2]) for i in range(100)] + [(200, None, None, "a")]
    table = docs(spark, rows)
    want = {r.doc_id: r.taken / r.size for r in mixing.mix(table).collect() if r.size}
    got = Counter(r.doc_id for r in mixing.mixed_documents(table).collect())
    assert mixing.mixed_documents(table).columns == table.columns
    assert all(got[i] == math.floor(x + 0.5) for i, x in want.items())


def _passes(table):
    """(id, copy) -> (words, size, share of the target before it), by hand from the targets of ``mix``."""
    rows, out = table.collect(), {}
    goal = {r.doc_id: (r.size, r.source_size, r.target) for r in mixing.mix(table).collect()}
    for source in {r.source for r in rows}:
        at = 0
        for i in sorted((r.doc_id for r in rows if r.source == source), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            size, total, target = goal[i]
            for k in range(2):
                out[i, k] = (max(0, min(size, math.floor(target) - k * total - at)), size, (at + k * total) / target)
            at += size
    return out


def test_every_copy_has_its_own_position(spark):
    rows = [(i, "w " * (1 + i % 7), None, "abc"[i % 3]) for i in range(150)] + [(1000 + i, "w " * 9, None, "c") for i in range(60)]
    table = docs(spark, rows)
    kind = {i: "abc".index(s) for i, _, _, s in rows}
    want = {key: x for key, x in _passes(table).items() if x[0]}
    due = {(r.i, r.k): r.t for r in spark.createDataFrame([(*key, x[2], kind[key[0]]) for key, x in want.items()], "i long, k int, s double, c int").select("i", "k", mixing.due(F.col("s"), F.col("c")).alias("t")).collect()}
    got = {(r.doc_id, r["copy"]): (r.words, r.position) for r in mixing.copies(table).collect()}
    assert {k for _, k in want} == {0, 1}
    assert {key: x[0] for key, x in got.items()} == {key: x[0] for key, x in want.items()}
    assert all(got[key][1] == pytest.approx(due[key]) for key in want)
    assert all(got[i, 1][1] > got[i, 0][1] for i, k in want if k == 1)
    taken = {r.doc_id: r.taken for r in mixing.mix(table).collect()}
    assert all(sum(got.get((i, k), (0,))[0] for k in range(2)) == n for i, n in taken.items())
    assert [r.doc_id for r in mixing.mixed_documents(table).collect()] == [i for i, k in sorted(want, key=lambda x: (got[x][1], x[0])) if 2 * want[i, k][0] >= want[i, k][1]]


# ---- personal data


def _slow_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        ds = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(ds) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(ds))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_regular_expressions():
    rng = random.Random(9)
    bits = ["a", "b.c", "@", "@", ".", "-", "+", "%", " ", "é", "1", "25", "255", "256", "0001", "4111 1111 1111 1111", "+1 (132) 555-1352", "10.0.0.1", "x@y.zz", "\n", "("]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
        base, every = pii.find(text)
        assert base == _slow_base(text), text
        assert set(base) <= set(every)
    assert pii.find(None) == pii.find("") == ([], [])


def test_added_spans():
    text = "See https://a.example/b?c=1. IBAN: DE89370400440532013000, account no. 12345678; password=hunter22 SSN 123-45-6789; 12 Long Hill Street"
    got = {k: text[a:b] for k, a, b in pii.find(text)[1]}
    assert got == {"url": "https://a.example/b?c=1", "iban": "DE89370400440532013000", "account": "12345678", "secret": "hunter22", "ssn": "123-45-6789", "street": "12 Long Hill Street"}
    assert pii.find("IBAN: DE00370400440532013000 the account was closed")[1] == []


def test_long_runs_take_time_in_proportion():
    for unit in ("a", "1", "1.", "a@", "+1 ", "1 ", "http://", "secret=", "iban DE89 ", "account 1", "1 Aa Street", "0000000000.", "passwd:x"):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            pii.find(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.05, unit


def test_pii_rows_against_brute_force(spark):
    rng = random.Random(13)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "é", "1", "255", "4111 1111 1111 1111", "+1 (132) 555-1352", "10.0.0.1", "x@y.zz", "\n", "https://a.b/c", "IBAN: DE89370400440532013000"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))), None, None) for i in range(300)] + [(500, None, None, None), (501, "", None, None), (3, "x@y.zz", None, None)]
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = Counter()
    for i, t, *_ in rows:
        base = _slow_base(t or "")
        want[i, *(sum(k == x for k, *_ in base) for x in pii.BASE), hashlib.sha256(show(base).encode()).hexdigest()] += 1
    got = pii.find_pii(docs(spark, rows)).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))
        assert hashlib.sha256(show([x for x in spans if x[0] in pii.BASE]).encode()).hexdigest() == r.base_sha256


# ---- WARC


def test_monolithic_archives_are_normalised(spark, tmp_path):
    rows = [(i, f"http://x/{i} y", "p" * (500 + 300 * (i % 4))) for i in range(20)] + [(20, None, None), (21, "u", "WARC/1.1\r\n\r\n" * 300), (22, "u", "WARC/1.1\r\n\r\n" * 300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    whole, members = str(tmp_path / "whole"), str(tmp_path / "members")
    warc.write_monolithic(warc.to_records(pages), whole)
    for f in (tmp_path / "whole").glob("part-*"):
        z = __import__("zlib").decompressobj(31)
        z.decompress(f.read_bytes())
        assert z.eof and not z.unused_data  # one member a file
    warc.normalise(spark, whole, members)
    got, index = warc.read_archives(spark, members).collect(), warc.read_index(spark, members).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, index)) if all(r.refers_to for r in got) else sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, index)))
    for r in index:  # every record can be opened alone
        data = next((tmp_path / "members" / f"archive={r.archive}" / "kind=warc").glob("part-*")).read_bytes()
        record = gzip.decompress(data[r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and f"page:{r.page_id}>".encode() in record
    best = {}
    for i, _, h in rows:
        if len(h or "") >= 1000:
            best[h] = max(i, best.get(h, i))
    for r in warc.round_trip(pages).collect():
        h = next(h for i, _, h in rows if i == r.page_id) or ""
        to = best.get(h, r.page_id)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response" if to == r.page_id else "revisit", None if to == r.page_id else to)


def test_string_ids_and_records_of_all_sizes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", ((600, 5), (5000, 2), (None, 1)))
    rows = [(f"p\r\n {i}>é" if i % 2 else f"{i}", None, "x" * (10 ** (1 + i % 4))) for i in range(24)] + [(None, None, "y" * 1500), ("null", None, "y" * 1500), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    best = {}
    for i, _, h in rows:
        if i is not None and len(h or "") >= 1000:
            best[h] = max(i, best.get(h, ""))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    to = lambda i, h: None if best.get(h, i) == i else best[h]
    assert got == Counter((i, len(h or ""), "revisit" if to(i, h or "") else "response", to(i, h or "")) for i, _, h in rows)
    warc.write_monolithic(warc.to_records(pages), str(tmp_path / "w"))
    sizes = [len(list(warc.split_records(warc.inflate(f.read_bytes())))) for f in (tmp_path / "w").glob("part-*")]
    assert sum(sizes) == len(rows) and max(sizes) <= 5


def test_broken_archives():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.split_records([good[:5], good[5:20], good[20:] + good])) == [(good[:29].rstrip(b"\r\n"), b"abc")] * 2
    for bad in (good[:-6], b"HTTP/1.1\r\nContent-Length: 3\r\n\r\nabc", b"WARC/1.1\r\nContent-Le"):
        with pytest.raises(ValueError):
            list(warc.split_records([bad]))
    packed = gzip.compress(good) + gzip.compress(good)
    assert b"".join(warc.inflate(packed)) == good + good
    with pytest.raises(ValueError):
        list(warc.inflate(packed[:-12]))
    body, index = warc.normalise_bytes(gzip.compress(good + good))
    assert [gzip.decompress(body[x["offset"] : x["offset"] + x["length"]]) for x in index] == [good, good] and json.dumps(index)


# ---- language model


def test_hashes_and_packing():
    texts = ["A b  A\tb\n", "", None, "x" * 3000, "É é", " b"]
    h, n = ngram.hash_words(texts)
    assert n.tolist() == [5, 1, 1, 2, 3, 2] and h[0] == h[2] and h[1] == h[3] == h[-2] and h[4] == ngram.END and len(set(h.tolist())) == 6
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    got = ngram.unpack(ngram.pack(keys, np.arange(1000)))
    assert (got[0] == keys).all() and (got[1] == np.arange(1000)).all() and (ngram.unmix(ngram.mix(keys)) == keys).all()


def test_model_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, weights=range(1, 61), k=rng.randrange(0, 30))), None, None) for i in range(200)] + [(300, None, None, None), (302, "unseen here", None, None)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    toks = {i: [*(t or "").split(), "</s>"] for i, t, *_ in rows}
    uni, bi = Counter(), Counter()
    for i, ws in toks.items():
        if not held[i]:
            uni.update(ws)
            bi.update(zip(["<s>", *ws], ws))
    n, v = sum(uni.values()), len(uni)
    d2 = [0, *ngram.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])]
    cont, ctx, free = Counter(w for _, w in bi), Counter(), Counter()
    d1 = [0, *ngram.discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])]
    for (a, _), c in bi.items():
        ctx[a] += c
        free[a] += d2[min(c, 3)]
    even = sum(d1[min(c, 3)] for c in cont.values()) / len(bi) / (v + 1)

    def prob(a, w):
        p1 = max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) + even
        return (max(bi[a, w] - d2[min(bi[a, w], 3)], 0) + free[a] * p1) / ctx[a] if ctx[a] else p1

    assert sum(prob("w5", w) for w in uni) + prob("w5", "?") == pytest.approx(1)
    for r in ngram.lm_score(docs(spark, rows)).collect():
        ws = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in uni for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score == pytest.approx(sum(math.log10(prob(a, w)) for a, w in zip(["<s>", *ws], ws)))


def test_order_three_against_brute_force(spark):
    rng = random.Random(19)
    vocab = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(vocab, weights=range(1, 13), k=rng.randrange(0, 25))), None, None) for i in range(150)] + [(300, None, None, None), (302, "unseen w1 w2 w3", None, None)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    toks = {i: [*(t or "").split(), "</s>"] for i, t, *_ in rows}
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, ws in toks.items():
        if not held[i]:
            uni.update(ws)
            bi.update(zip(["<s>", *ws], ws))
            tri.update(zip(["<s>", "<s>", *ws], ["<s>", *ws], ws))
    before = Counter((v, w) for _, v, w in tri)  # how many different words stand before a pair
    adj = {(v, w): c if v == "<s>" else before[v, w] for (v, w), c in bi.items()}
    cont = Counter(w for _, w in bi)
    d1, d2, d3 = ([0, *ngram.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)])] for x in (cont, adj, tri))
    even = sum(d1[min(c, 3)] for c in cont.values()) / len(bi) / (len(uni) + 1)

    def stage_of(table, disc, context, c, lower):
        own = [x for g, x in table.items() if g[:-1] == context]
        return (max(c - disc[min(c, 3)], 0) + sum(disc[min(x, 3)] for x in own) * lower) / sum(own) if own else lower

    def prob(u, v, w):
        p1 = max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) + even
        p2 = stage_of(adj, d2, (v,), adj.get((v, w), 0), p1)
        return stage_of(tri, d3, (u, v), tri[u, v, w], p2)

    for u, v in (("w5", "w6"), ("<s>", "<s>"), ("<s>", "w11"), ("w1", "?")):
        assert sum(prob(u, v, w) for w in uni) + prob(u, v, "?") == pytest.approx(1)
    for r in ngram.lm_score(docs(spark, rows), order=3).collect():
        ws = toks[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(prob(*g)) for g in zip(["<s>", "<s>", *ws], ["<s>", *ws], ws))), r.doc_id
    assert ngram.lm_score(docs(spark, []), order=3).collect() == []
    empty = ngram.lm_score(docs(spark, [(302, "a b", None, None)]), order=3).collect()
    assert len(empty) == 1


# ---- pipeline

#: Names that operators gave their own columns at some time.
OWN = ["_name", "_own", "_row", "_copy", "_source", "_id", "_times", "_position", "_key", "_last0", "_last1", "_p", "_b", "_d", "_to", "row", "name", "text_"]


def _drops(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([("q", "the quick brown fox")], "item_id string, text string")
    return {
        "toxic": lambda df: toxicity.drop_toxic(df, labels),
        "near": lambda df: neardup.drop_near_duplicates(df),
        "contaminated": lambda df: decontam.drop_contaminated(df, items),
        "mixed": lambda df: mixing.mixed_documents(df),
    }


@pytest.mark.parametrize("name, most", [("toxic", 9), ("near", 9), ("contaminated", 200_000), ("contaminated", 0), ("mixed", 9)])
def test_stages_hand_columns_on(spark, name, most, monkeypatch):
    if name == "contaminated" and not most:  # more automata than one, so rows are numbered
        monkeypatch.setattr(decontam, "automata", lambda *a, made=decontam.automata: (2, lambda i, w=made(*a)[1]: w(0) if i else []))
    texts = [None, "", " ", "one text of seven words in all", "one text of seven words in all", "the quick brown fox", *[f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(20)]]
    rows = [(i if i != 3 else None, t, "en", "ab"[i % 2] if i % 5 else None) for i, t in enumerate(texts)] + [(1, "", "en", "b")]
    table = docs(spark, rows, clash=False)
    for c in OWN:
        table = table.withColumn(c, F.concat(F.lit(c), F.lit("!")))
    got = _drops(spark)[name](table)
    out = got.collect()
    assert got.columns == table.columns and out and all(r[c] == f"{c}!" for r in out for c in OWN)
    have = Counter((r.doc_id, r.text) for r in out)
    given = Counter((i, t) for i, t, *_ in rows)
    assert set(have) <= set(given)
    if name != "mixed":
        assert all(have[k] <= n for k, n in given.items()) and (0, None) in have and have[1, ""] == 2
    if name == "near":
        assert sum(n for (_, t), n in have.items() if t and t.startswith("one text")) == 1
    if name == "contaminated":
        assert sum(given.values()) - sum(have.values()) == 1 and (5, "the quick brown fox") not in have
    assert _drops(spark)[name](table.limit(0)).collect() == []



def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs_.select("doc_id").collect()}
    for name, stage_of in cp.STAGES:
        docs_ = stage_of(spark, docs_, sf)
        got = [r.doc_id for r in docs_.select("doc_id").collect()]
        assert set(got) <= ids and got
        if name != "token_ids":
            assert docs_.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert len(got) == len(set(got)) >= 0.8 * len(ids)
        ids = set(got)
