"""Operators on odd tables: nulls, empties, long texts, repeats, clashing columns."""

import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import audio, language_id, mixing, near_dups, piece_codec, quality_classifier, quality_rules, queries, token_counts, token_files, url_filters

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, score string, kept string, IDS string"
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(2000)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


BASE = prose(200)
ROWS = [(i, prose(RNG.randint(60, 200)), "en" if i % 2 else "de", "s", None, None, None, None) for i in range(40)]
ROWS += [(100, None, None, None, None, None, None, None), (101, "", "en", None, "x", "y", "z", "w"), (102, " \n\t ", None, "s", None, None, None, None), (103, "1 2 3", "en", "s", None, None, None, None), (None, prose(80), "en", "s", None, None, None, None)]
ROWS += [(110, BASE, "en", "s", None, None, None, None)] * 2 + [(111, BASE.upper(), "en", "s", None, None, None, None), (112, BASE + " tail words", "en", "s", None, None, None, None), (113, prose(20_000), "en", "s", None, None, None, None), (114, "x" * 50_000, "en", "s", None, None, None, None), (115, "one two", None, None, None, None, None, None), (116, "ONE two", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, docs):
    return docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))


def test_drawn_labels_are_bounded(spark):
    hot = spark.range(4000).select(F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    first = [r.doc_id for r in quality_classifier.draw(hot, 100).collect()]
    assert len(set(first)) == len(first) == 100
    assert set(first) == {r.doc_id for r in quality_classifier.draw(hot.repartition(7), 100).collect()}
    assert {r.doc_id: r.quality for r in quality_classifier.draw(hot, 2501).collect()} == {7: 1} | {k: k % 2 for k in range(1500, 4000)}
    assert quality_classifier.draw(hot.limit(0), 100).count() == 0


def test_token_counts(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(docs, PIECES)
    assert got.columns.count("n_tokens") == 1
    for r in got.collect():
        assert r.n_tokens == len(library.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 4096)
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_summaries_merge_in_a_tree(spark):
    df = spark.createDataFrame([("a b",)] * 300, "text string").repartition(130)
    assert token_counts.frequent_chunks(df, k=8) == ["a", "b"]


def test_piece_codec(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    both = piece_codec.decode(piece_codec.encode(docs, PIECES), PIECES)
    for r in both.select("text", F.col("ids").alias("found"), "decoded").collect():
        assert r.found == library.encode(r.text or "") and r.decoded == library.decode(r.found)
    assert all(r.round_trip for r in piece_codec.round_trip(docs, PIECES).collect())
    assert piece_codec.codec_digest(empty, PIECES).count() == 0
    got = piece_codec.codec_digest(docs, PIECES).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = library.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_piece_codec_query_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    told = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = {k: library.encode(t) for k, t in told.items()}
    got = queries.op8_piece_codec(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((k, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for k, x in ids.items())


def test_token_files(spark, docs, empty):
    got = token_files.read_digest(token_files.write(docs, WORDS, 1, shards=3)).collect()
    assert len(got) == len(ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_files.read_digest(token_files.write(empty, WORDS, 1)).count() == 0


def test_token_file_query_equals_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    told = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want, at = [], 0
    for (k, _), e in zip(told, library.encode_batch([t for _, t in told], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, SMALL).collect()) == want


def test_token_files_by_size(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 10_000)
    manifest = token_files.write(docs, WORDS, 1)
    assert manifest.count() > 4 and sum(r.documents for r in manifest.collect()) == len(ROWS)


def test_url_filters(spark):
    rows = [(1, "http://a.net/x"), (2, "http://a.net"), (3, "http://b.EXAMPLE.net/en/"), (4, None), (5, "nothing"), (6, "http://x.example.com/de/1"), (7, "https://q.org/fr/?a"), (8, "http://ads-1.com/"), (9, "http://c.com/a.net/b")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("HOST", F.lit(1)), url_filters.RULES, url_filters.GLOBS).collect()}
    assert got == {1: ("net/", "block"), 2: (None, "allow"), 3: ("example.net/en/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("example.com/de/", "block"), 7: ("org/fr/", "allow"), 8: (None, "block"), 9: (None, "allow")}


def adpcm_block(block):
    steps, change = list(map(int, audio.STEPS.split())), list(map(int, audio.INDEX_CHANGES.split()))
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for code in (c for byte in block[4:] for c in (byte & 15, byte >> 4)):
        step = steps[index]
        delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
        index = max(0, min(88, index + change[code & 7]))
        out.append(value)
    return out


def heard(codec, payload):
    """Samples at 16 kHz, one at a time, from the published rules."""
    if codec == 17:
        x = [s for at in range(0, len(payload), 192) for s in adpcm_block(payload[at : at + 192])]
    elif codec == 7:
        expand = lambda c: ((((c & 15) << 3) + 132) << (c >> 4 & 7)) - 132
        x = [-expand(~b & 255) if ~b & 128 else expand(~b & 255) for b in payload]
    else:
        size = lambda c: ((c & 15) << 4) + 8 if not c >> 4 & 7 else (((c & 15) << 4) + 264) << ((c >> 4 & 7) - 1)
        x = [size(b ^ 0x55) if (b ^ 0x55) & 128 else -size(b ^ 0x55) for b in payload]
    at = lambda i: x[max(0, min(len(x) - 1, i))]
    out = []
    for i, v in enumerate(x):
        between = (150 * (v + at(i + 1)) - 25 * (at(i - 1) + at(i + 2)) + 3 * (at(i - 2) + at(i + 3)) + 128) >> 8
        out += [v, max(-32768, min(32767, between))]
    return out


def media_row(doc_id, text):
    """All columns of the query for one text."""
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    codec = (7, 6, 17)[zlib.crc32(payload) % 3]
    blob = audio.to_media(payload, codec)
    pcm = heard(codec, payload)
    sound = np.array(pcm, "<i2").tobytes()
    turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
    name = {7: "mu-law", 6: "a-law", 17: "ima-adpcm"}[codec]
    feature = f"{name};rms/turns={int((sum(v * v for v in pcm) // len(pcm)) ** 0.5)}/{turns};pcm16k={zlib.crc32(sound):08x}"
    return doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), len(sound), feature


MEDIA = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm_bytes", "feature")


def test_media_query_by_single_samples(spark):
    told = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r[c] for c in MEDIA) for r in queries.op6_media_columns(spark, SMALL).collect()) == sorted(media_row(*x) for x in told)


def test_audio(spark, docs, empty):
    got = audio.digest(audio.expand(audio.store(docs.withColumn("Feature", F.lit(1)).withColumn("PCM", F.lit(2)))))
    assert [c.lower() for c in got.columns].count("feature") == [c.lower() for c in got.columns].count("pcm") == 1
    want = {r[0]: media_row(r[0], r[1]) for r in ROWS if len(r[1] or "") < 10_000}
    rows = got.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0))).collect()
    assert all(tuple(r[c] for c in MEDIA) == want[r.doc_id] for r in rows if r.doc_id in want) and len(rows) == len(ROWS)
    long = next(r for r in rows if r.doc_id == 113)
    assert long.payload_sha256 == hashlib.sha256(audio.to_payload(long.text.encode())).hexdigest()
    assert audio.digest(audio.expand(audio.store(empty))).count() == 0
    for codec in (audio.MU_LAW, audio.A_LAW, audio.ADPCM):
        sounds = audio.expand(audio.store(docs.filter("text is null or text = ''"), codec=codec)).collect()
        assert [np.frombuffer(r.pcm, "<i2").tolist() for r in sounds] == [heard(codec, b" " * 192)] * 2
    nothing = spark.createDataFrame([(1, None), (2, bytearray(audio.to_media(b"")))], "doc_id long, media binary")
    a, b = audio.digest(audio.expand(nothing)).orderBy("doc_id").collect()
    assert a.pcm is None and a.feature is None and a.payload_bytes is None and (b.pcm, b.payload_bytes, b.pcm_bytes) == (bytearray(), 0, 0)


def test_rule_packs_and_odd_urls(spark):
    pack = spark.createDataFrame([("block", "", None, "**/x"), ("block", "Evil.org", "/", None), ("allow", "ok.evil.org", "/a", None)], "verdict string, host string, path string, pattern string")
    rules, globs = url_filters.rule_pack(pack)
    rows = [(1, "http://a.evil.org/"), (2, "http://OK.evil.org/ab"), (3, "http://z/x"), (3, "http://z/x"), (4, "http://z/" + "y" * 30_000 + "/x"), (5, "http://é.evil.org/ü"), (6, ""), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("Verdict", F.lit(3))
    got = url_filters.judge(df, rules, globs)
    assert [c.lower() for c in got.columns].count("verdict") == 1
    said = sorted(((r.page_id or 0, r.rule, r.verdict) for r in got.collect()), key=str)
    assert said == sorted([(1, "evil.org/", "block"), (2, "ok.evil.org/a", "allow"), (3, None, "block"), (3, None, "block"), (4, None, "block"), (5, "evil.org/", "block"), (6, None, "allow"), (0, None, "allow")], key=str)
    assert url_filters.judge(df.limit(0), rules, globs).count() == 0
    assert {r.verdict for r in url_filters.judge(df, [], []).collect()} == {"allow"}


def brute_components(rows):
    words = lambda t: (t or "").encode().lower().split()
    sets = []
    for r in rows:
        w = words(r[1])
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    names = collections.defaultdict(list)
    for i, r in enumerate(rows):
        names[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return sorted(((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows)), key=str)


def test_near_duplicates(spark, docs, empty):
    got = near_dups.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(ROWS)
    assert near_dups.near_duplicates(empty).count() == 0


def test_more_partitions_than_rows(spark):
    rows = [(k, prose(60)) for k in range(6)]
    rows += [(10 + k, f"{rows[k][1]} tail") for k in range(0, 6, 2)]
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_crowded_neighbourhood(spark):
    base = prose(300).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 12):
            w[RNG.randrange(len(w))] = RNG.choice(VOCABULARY)
        rows.append((i, " ".join(w)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def boilerplate(n, planted, own=30, shared=140, kept=18):
    """n texts of one long passage and words of their own (similarity about 0.7), and texts that keep some of these (about 0.8)."""
    passage = prose(shared + 4)
    rows = [(i, f"{passage} {prose(own)}") for i in range(n)]
    return rows + [(n + i, " ".join(rows[i * n // planted][1].split()[: -(own - kept)]) + " " + prose(own - kept)) for i in range(planted)]


def test_hot_passage(spark):
    rows = boilerplate(1200, 150)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_many_refuted_partners(spark):
    rows = [(100 * g + i, text) for g in range(30) for i, text in boilerplate(26, 6, own=24, kept=5)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_partner_inside_a_long_run(spark):
    rows = boilerplate(600, 0, own=20)
    rows += [(600 + i, f"{rows[15 * i][1]} {prose(35)}") for i in range(40)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_sketches_leave_the_decision_to_sets():
    draw, agreement = np.random.default_rng(5), []
    for _ in range(3000):
        s = draw.integers(0, 1 << 63, 160, np.uint64)
        # 120 of 160 are shared: 75 percent
        a, b = (np.frombuffer(near_dups.sketch(near_dups.signature(x)), np.uint8) for x in (s[:140], s[20:]))
        equal = ((a ^ b) >> 4 == 0).sum() + ((a ^ b) & 15 == 0).sum()
        agreement.append((equal / near_dups.HASHES - 1 / 16) * 16 / 15)
    assert min(agreement) >= near_dups.AGREEMENT, sum(x < near_dups.AGREEMENT for x in agreement)


def test_star_contraction(spark):
    links = [(a, a + 1) for a in range(40) if a % 10 != 9] + [(0, 5), (20, 29)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in links], "a binary, b binary").repartition(4)
    for local in (0, len(links) - 1, len(links), 1000):
        got = {bytes(r.node)[0]: bytes(r.label)[0] for r in near_dups.components(spark, df, local).collect()}
        assert got == {n: n // 10 * 10 for n in range(40)}


def test_language_id(spark, docs, empty):
    rows = [(i, ("der und die das nicht ein " if i % 2 else "the of and that with from ") * 5, "de" if i % 2 else "en") for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(train, model).collect()}
    assert all(got[i] == ("de" if i % 2 else "en") for i in range(40))
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert odd[100] == odd[101] == odd[102] == odd[103] == ("und", 0.0)
    assert language_id.predict(docs, language_id.fit(empty)).filter("lang_pred <> 'und'").count() == 0


def test_language_letters_and_long_texts(spark, empty):
    assert [language_id.has_letter(t) for t in ("²½①Ⅳ", "12 ³ é", "٣_", "漢", "")] == [False, True, False, True, False]
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice(("der", "und", "die", "nicht") if i % 2 else ("the", "of", "and", "with")) for _ in range(30)), "de" if i % 2 else "en") for i in range(30)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and np.allclose(model.log_prior, np.log(0.5))
    long = " ".join(draw.choice(("der", "the", "und", "of", "ſt", "x")) for _ in range(language_id.GROUP // 2))
    keys, _ = language_id._grams([long])
    assert len(long) > language_id.GROUP and (language_id._counted(long) == np.bincount(keys.ravel(), minlength=language_id.BUCKETS)).all()
    assert model.score([long, "the of"])[0][1] == "en" and model.score([long])[0] == model.score([long, ""])[0][:1]
    even = language_id.Model(["a", "b"], np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2))
    assert even.score(["tie"]) == (["a"], [0.5])
    assert language_id.predict(empty, model).count() == 0
    twice = language_id.predict(spark.createDataFrame([(1, "the und", "q"), (1, "the und", "r")], "doc_id long, text string, LANG_PRED string"), model)
    assert [c.lower() for c in twice.columns].count("lang_pred") == 1 and len({(r.lang_pred, r.score) for r in twice.collect()}) == 1


def test_posteriors_from_dictionaries_of_counts(spark):
    """Every posterior again, n-gram by n-gram, from plain counts."""
    draw = random.Random(3)
    words = {"de": ("der", "und", "straße", "nicht"), "en": ("the", "of", "and", "İs"), "fr": ("le", "été", "𝒳y", "qui")}
    rows = [(k, " ".join(draw.choice(words[x]) for _ in range(draw.randint(1, 12))), x) for k, x in enumerate(draw.choice(list(words)) for _ in range(90))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))

    def buckets(text):
        points = [*map(ord, text.lower()), 0, 0]
        for at in range(len(points) - 2):
            key = 0
            for n in range(language_id.ORDERS):
                key += (points[at + n] + n) * int(language_id._PRIMES[n])
                yield (key * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 49

    counts = {x: collections.Counter(b for _, t, y in rows if y == x for b in buckets(t)) for x in words}
    size = {x: sum(c.values()) + 0.5 * language_id.BUCKETS for x, c in counts.items()}
    for text in ("der the", "le été qui", "nicht İs", "x", "und und und le"):
        z = {x: math.log(sum(y == x for *_, y in rows) / len(rows)) + sum(math.log((counts[x][b] + 0.5) / size[x]) for b in buckets(text)) for x in words}
        best = max(z.values())
        (name,), (score,) = model.score([text])
        # neighbours in a batch change nothing
        assert model.score(["qui", text, "", text, "the"])[1][1::2] == [score, score]
        assert name == max(sorted(z), key=z.get) and score == pytest.approx(1 / sum(math.exp(v - best) for v in z.values()), abs=1e-5)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    assert got.count() > 100 and got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_quality_classifier(spark, docs, empty):
    labels = labels_of(spark, docs)
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.classify(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality_classifier.classify(docs, quality_classifier.fit(empty, labels.limit(0))).filter("score <> 0.5").count() == 0


def tree_by_bins(g, h, depth=2):
    """Leaf value of every bin of the greedy tree, all cuts tried one by one."""
    gain = lambda a, b: a * a / (b + quality_classifier.PENALTY)
    if depth and len(g) > 1:
        cuts = [gain(sum(g[:k]), sum(h[:k])) + gain(sum(g[k:]), sum(h[k:])) for k in range(1, len(g))]
        if max(cuts) > gain(sum(g), sum(h)) + 1e-9:
            k = 1 + cuts.index(max(cuts))
            return tree_by_bins(g[:k], h[:k], depth - 1) + tree_by_bins(g[k:], h[k:], depth - 1)
    return [sum(g) / (sum(h) + quality_classifier.PENALTY)] * len(g)


def test_boosted_trees_by_trying_all_cuts():
    draw = np.random.default_rng(6)
    for n in (1, 2, 3, 12, 32):
        g, h = draw.integers(-8, 9, n) / 4, draw.integers(1, 9, n) / 4
        assert np.allclose(quality_classifier._leaves(g, h), tree_by_bins(g.tolist(), h.tolist()))
    g, h = draw.normal(size=(5, 4)), draw.random((5, 4)) + 0.1
    table, gain = quality_classifier._quadrants(g, h)
    cost = lambda x: x[0] ** 2 / (x[1] + quality_classifier.PENALTY)
    parts = lambda i, j: [(g[a, b].sum(), h[a, b].sum()) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))]
    every = {(i, j): sum(map(cost, parts(i, j))) for i in range(1, 5) for j in range(1, 4)}
    i, j = max(every, key=every.get)
    assert abs(gain - (every[i, j] - cost((g.sum(), h.sum())))) < 1e-9
    want = [x / (y + quality_classifier.PENALTY) for x, y in parts(i, j)]
    assert np.allclose([table[0, 0], table[0, -1], table[-1, 0], table[-1, -1]], want)


def test_scores_are_sums_of_table_entries(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.fit(docs, labels)
    place = lambda edges, x: sum(x >= e for e in edges)
    for r in quality_classifier.classify(docs, model).collect():
        x = quality_classifier.measure(r.text or "")
        z = model.base + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, x))
        z += sum(t[place(model.coarse[i], x[i]), place(model.coarse[j], x[j])] for (i, j), t in model.pairs.items())
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    rows = got.select("quality", "score", "predicted").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    ranked = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 50 and ranked > 0.9 and sum(r.predicted == r.quality for r in rows) > 0.9 * len(rows)


def test_quality_of_odd_tables(spark, docs, empty):
    model = quality_classifier.fit(docs, labels_of(spark, docs))
    assert quality_classifier.classify(empty, model).count() == 0
    got = quality_classifier.classify(docs.withColumn("Predicted", F.lit("x")), model)
    assert [c.lower() for c in got.columns].count("predicted") == 1
    assert len({r.score for r in got.collect() if r.doc_id == 110}) == 1
    long = "word " * 200_000
    assert 0 <= quality_classifier.classify(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first().score <= 1


def test_mixing(spark, docs, empty):
    model = mixing.fit(docs, mixing.label_domains(labels_of(spark, docs)))
    got = mixing.mix(docs, model, {"clean": 1.0, "low": 3.0}).collect()
    assert len(got) == len(ROWS) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.rate * r.n_tokens * r.posterior[0] for r in got) - total / 4) < 0.05 * total
    assert mixing.mix(empty, model, mixing.TARGETS).count() == 0


def dense_rates(n, p, share, ridge):
    """The optimum of the same problem by many plain steps over dense arrays."""
    total = n.sum()
    r = np.ones(len(n))
    size = 1 / (np.linalg.eigvalsh((p * n[:, None]).T @ p / total / np.sqrt(np.outer(share, share))).max() + ridge)
    for _ in range(60_000):
        gap = ((r * n) @ p / total - share) / share
        r = np.maximum(0, r - size * (p @ gap + ridge * (r - 1)))
    return r


def soft(draw, domain, rows, sharp):
    z = draw.random((rows, 3)) * (1 - sharp)
    z[:, domain] += sharp
    return z / z.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("sizes", [(300, 60, 30), (600, 4, 2)])
def test_rates_against_a_dense_solver(spark, sizes):
    draw = np.random.default_rng(4)
    p = np.concatenate([soft(draw, k, m, 0.97) for k, m in enumerate(sizes)])
    n = draw.integers(1, 400, len(p)).astype(float)
    plan = mixing.solve(spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(n, p)], "n_tokens long, posterior array<double>").repartition(3), mixing.TARGETS)
    share = np.array(plan.targets) / sum(plan.targets)
    want = dense_rates(n, p, share, plan.ridge)
    best = (want * n) @ p / n.sum() / share
    # the optimum lies on the targets, and so do the rates found, up to the tolerance
    assert plan.converged and np.abs(best - 1).max() < mixing.TOLERANCE and np.abs(np.array(plan.reached) / plan.targets - 1).max() < mixing.TOLERANCE
    mine = plan.rates(p)
    assert np.allclose(plan.reached, (mine * n) @ p) and (mine >= 0).all()
    cost = lambda r: ((((r * n) @ p / n.sum() - share) ** 2 / share).sum() + plan.ridge * (n / n.sum() * (r - 1) ** 2).sum()) / 2
    assert cost(mine) - cost(want) < mixing.TOLERANCE**2


def test_targets_out_of_reach_are_told(spark):
    rows = [(100, [0.7, 0.3, 0.0])] * 20 + [(50, [0.2, 0.8, 0.0])] * 20
    plan = mixing.solve(spark.createDataFrame(rows, "n_tokens long, posterior array<double>"), {"a": 1.0, "b": 1.0, "nowhere": 2.0})
    p, n = np.array([x for _, x in rows]), np.array([m for m, _ in rows], float)
    want = (dense_rates(n, p, np.array([0.25, 0.25, 0.5]), plan.ridge) * n) @ p
    assert not plan.converged and plan.reached[2] == 0 and np.abs(np.array(plan.reached[:2]) / want[:2] - 1).max() < 0.02


def test_rates_of_the_query(spark, docs, empty):
    labels = mixing.label_domains(labels_of(spark, docs))
    got = mixing.rates(docs, mixing.fit(docs, labels), mixing.TARGETS).collect()
    library = [len((r[1] or "").encode().split()) for r in ROWS]
    assert sorted(r.n_tokens for r in got) == sorted(library) and len(got) == len(ROWS)
    total, share = sum(library), np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)])
    reached = sum(r.rate * r.n_tokens * np.array(r.posterior) for r in got)
    assert np.allclose(got[0].reached, reached / total / share) and all(r.converged == (max(abs(x - 1) for x in r.reached) < mixing.TOLERANCE) for r in got)
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    twice = [(r.rate, r.copies) for r in got if r.doc_id == 110]
    assert len(twice) == 2 and len(set(twice)) == 1
    none = mixing.fit(docs, labels.limit(0))
    assert all(np.allclose(r.posterior, 1 / 3) for r in mixing.rates(docs, none, mixing.TARGETS).collect())
    assert mixing.rates(empty, none, mixing.TARGETS).count() == 0
    blank = mixing.rates(docs.filter("text is null"), none, mixing.TARGETS).first()
    assert (blank.rate, blank.copies, blank.converged, blank.reached) == (1.0, 1, False, [None] * 3)


def test_posteriors_of_domains_word_by_word(spark, docs):
    model = mixing.fit(docs, mixing.label_domains(labels_of(spark, docs)))
    for text in (prose(30), "", "one", BASE):
        words = text.encode().split()
        z = model.bias.astype(float) + sum((model.weights[zlib.crc32(w) % mixing.BUCKETS].astype(float) + model.weights[zlib.crc32(b"~" + w[-2:]) % mixing.BUCKETS] for w in words), np.zeros(len(model.domains))) / np.sqrt(max(1, len(words)))
        n, p = model.posteriors([text])
        assert n[0] == len(words) and np.allclose(p[0], np.exp(z) / np.exp(z).sum(), atol=1e-6)


def test_steps_go_on_over_documents(spark, monkeypatch):
    """Cells of one posterior tell nothing; documents still reach their targets."""
    monkeypatch.setattr(mixing, "GRID", 1)
    draw = np.random.default_rng(4)
    p = np.concatenate([soft(draw, k, m, 0.6) for k, m in enumerate((200, 90, 60))])
    n = draw.integers(1, 400, len(p)).astype(float)
    plan = mixing.solve(spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(n, p)], "n_tokens long, posterior array<double>").repartition(3), {"a": 0.5, "b": 0.3, "c": 0.2})
    assert plan.converged and np.allclose(plan.reached, (plan.rates(p) * n) @ p) and np.abs(np.array(plan.reached) / plan.targets - 1).max() < mixing.TOLERANCE


def test_few_passes_fit_soft_rates(spark):
    """Posteriors that hardly differ make a badly conditioned problem; each pass over the rows is a job that the driver keeps account of."""
    draw = np.random.default_rng(6)
    p = np.concatenate([soft(draw, k, m, 0.2) for k, m in enumerate((900, 80, 40))])
    n = draw.integers(1, 400, len(p)).astype(float)
    rows = spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(n, p)], "n_tokens long, posterior array<double>").repartition(3)
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        plan = mixing.solve(rows, {"a": 0.6, "b": 0.3, "c": 0.1})
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    share = np.array(plan.targets) / sum(plan.targets)
    cost = lambda r: ((((r * n) @ p / n.sum() - share) ** 2 / share).sum() + plan.ridge * (n / n.sum() * (r - 1) ** 2).sum()) / 2
    assert jobs < 100 and plan.converged and np.allclose(plan.reached, (plan.rates(p) * n) @ p)
    assert cost(plan.rates(p)) <= cost(dense_rates(n, p, share, plan.ridge)) + 1e-9


def test_queries_one_two_and_five(spark):
    told = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, SMALL).collect()}
    assert counts == {k: (len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for k, t in told.items()}
    rows = queries.op5_near_dups(spark, SMALL).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute_components(list(told.items())) and all(r.kept == (r.doc_id == r.component_id) for r in rows)
    mixed = queries.op2_mixing(spark, SMALL).collect()
    p, n = np.array([r.posterior for r in mixed]), np.array([len((told[r.doc_id] or "").encode().split()) for r in mixed], float)
    share = np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)])
    assert n.tolist() == [r.n_tokens for r in mixed] and mixed[0].converged
    assert np.abs((np.array([r.rate for r in mixed]) * n) @ p / n.sum() / share - 1).max() < mixing.TOLERANCE


def test_files_by_bytes_behind_joins(spark, docs):
    """However the rows are made, their texts' bytes tell the number of files."""
    few = docs.filter("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    ids = few.select("doc_id")
    for df in (few, few.join(ids, "doc_id"), few.join(ids, "doc_id").join(ids.withColumn("y", F.lit(1)), "doc_id")):
        assert token_files.write(df, WORDS, 1).count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rates_stay_at_the_targets_of_one_domain(spark):
    rows = spark.createDataFrame([(10, [1.0]), (30, [1.0])], "n_tokens long, posterior array<double>")
    plan = mixing.solve(rows, {"all": 2.0})
    assert abs(plan.reached[0] - 40) < 1 and plan.converged


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_queries_with_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, sf)
        columns = sorted(found.columns)
        assert sorted(str(tuple(r)) for r in found.select(*columns).collect()) == sorted(map(str, c.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())), name


def test_quality_rules(spark, docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge(docs, min_rows=10).collect()}
    assert (got[100].n_words, got[100].base_failed, got[100].kept) == (0, True, False) and got[113].n_words == 20_000 and got[114].word_chars == 50_000
    assert quality_rules.judge(empty).count() == 0
    counts = quality_rules.base_counts(spark.createDataFrame([("a b c d\na b c d\n\nx # a b c",), ("a b c a b c a b c",), ("a b",)], "text string")).collect()
    assert [(r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in counts] == [(13, 1, 1, 11), (9, 0, 0, 9), (2, 0, 0, 0)]


def brute_counts(text):
    words = text.split()
    places = collections.defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + o for at in places.values() if len(at) > 1 for i in at for o in range(3)}
    lines = [x for x in text.split("\n") if x.strip()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_of_any_length(spark, monkeypatch):
    draw = random.Random(12)
    some = [" ".join(draw.choice(("a", "b", "cc", "#d", "é")) for _ in range(n)) for n in (0, 1, 2, 3, 4, 7, 40, 300)] + ["\n".join(prose(6) for _ in range(30)) * 2]
    df = spark.createDataFrame([(t,) for t in some], "text string")
    want = [brute_counts(t) for t in some]
    assert [tuple(r[c] for c in COUNTS) for r in quality_rules.base_counts(df).collect()] == want
    # so few positions fit that every longer text takes the way of very long ones
    monkeypatch.setattr(quality_rules, "_POSITION", 3)
    assert [tuple(r[c] for c in COUNTS) for r in quality_rules.base_counts(df).collect()] == want
    monkeypatch.undo()
    long = " ".join(f"w{draw.randrange(3000)}" for _ in range((1 << 20) + 50))
    row = quality_rules.base_counts(spark.createDataFrame([(long,)], "text string")).first()
    assert (row.n_words, row.n_repeat_words) == (len(long.split()), brute_counts(long)[4])


def test_equal_rows_are_judged_alike(spark):
    rows = [(i, prose(100), "en", "s") for i in range(80)] + [(200, ("#" + prose(1) + " ") * 90, "en", "s")] + [(300 + i, BASE, "en", "s") for i in range(3)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("Kept", F.lit(1)).withColumn("d2", F.lit(5))).collect()}
    assert not got[200] and len({got[300 + i] for i in range(3)}) == 1 and sum(got.values()) > 75


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, os.environ.get("TEST_SF", "/root/testdata/sf0.001"))
    assert got.filter("not round_trip").count() == 0 and 50 < got.count() < 400


def test_pipeline_judges_rows_not_ids(spark):
    import corpus_pipeline

    x, y, z = prose(80), prose(80), prose(80)
    rows = [(None, x), (None, y), (None, y + " tail"), (7, z), (7, prose(90)), (7, z), (8, z + " tail"), (9, "few words")]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.remove_near_duplicates(spark, df, "").collect()
    assert len(got) == 5 and {(r.doc_id, r.text) for r in got} - {(None, y), (None, y + " tail")} == {(None, x), (7, z), (7, rows[4][1]), (9, "few words")}
    clash = spark.createDataFrame([(1, x, "en", "s"), (1, "few words", "en", "s"), (None, y, "en", "s"), (None, "", "en", "s")], df.schema)
    assert sorted(r.text for r in corpus_pipeline.apply_quality_rules(spark, clash, "").collect()) == sorted([x, y])


@pytest.fixture()
def odd_folder(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", F.lit("x").alias("Score"), F.lit("y").alias("LABEL")).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, docs).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_of_odd_rows(spark, docs, odd_folder):
    import corpus_pipeline

    before = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, odd_folder)
        assert after.columns == before.columns, name
        assert stage(spark, before.limit(0), odd_folder).count() == 0, name
    assert corpus_pipeline.encode_pieces(spark, before.limit(0), odd_folder).count() == 0
    assert corpus_pipeline.run(spark, odd_folder).filter("not round_trip").count() == 0


def test_pipeline_that_rejects_everything(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "12 34", "en", "s"), (2, None, None, None), (None, "", "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_against_their_operators(spark):
    """Each stage keeps what brute force or its operator, fed with its input, says."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    named = corpus_pipeline.identify_language(spark, docs, SMALL)
    model = language_id.fit(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    told = {r.doc_id: model.score([r.text or ""]) for r in docs.collect()}
    assert {r.doc_id for r in named.collect()} == {k for k, (n, s) in told.items() if n[0] != "und" and s[0] >= 0.5}
    ruled = corpus_pipeline.apply_quality_rules(spark, named, SMALL).cache()
    counts = {r.doc_id: brute_counts(r.text) for r in ruled.collect()}
    assert counts and all(c[0] >= 50 and 100 * c[4] <= 50 * c[0] for c in counts.values())
    rows = [(r.doc_id, r.text) for r in ruled.collect()]
    alone = corpus_pipeline.remove_near_duplicates(spark, ruled, SMALL).cache()
    assert sorted(r.doc_id for r in alone.collect()) == sorted(k for k, _, least in brute_components(rows) if k == least)
    mixed = corpus_pipeline.mix_to_targets(spark, alone, SMALL)
    fitted = mixing.rates(alone, mixing.fit(alone, mixing.label_domains(spark.read.parquet(f"{SMALL}/labels.parquet"))), mixing.TARGETS)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({r.doc_id: r.copies for r in fitted.collect() if r.copies})
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r.ids == library.encode(t) for r, t in ((r, dict(rows)[r.doc_id]) for r in corpus_pipeline.encode_pieces(spark, alone, SMALL).collect()))
