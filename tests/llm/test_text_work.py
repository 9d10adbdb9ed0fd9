"""Source divergence, chat formatting and lexical search against brute force, and on odd tables."""

import collections
import hashlib
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, divergence, lexical_search, terms

LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, s string, term string, L string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def some_texts(n, seed=3):
    draw = random.Random(seed)
    words = ["Aa", "aa", "bé", "BÉ", "x1y", "漢字", "ſt", "𝒳x", "İ", "z"] + ["".join(draw.choice("abc") for _ in range(draw.randint(1, 4))) for _ in range(40)]
    return [draw.choice((" ", "\n", ", ", "_", " ", "7")).join(draw.choice(words) for _ in range(draw.randint(0, 30))) for _ in range(n)]


ROWS = [(k, t, ("en", "de", None)[k % 3], ("hot", "hot", "b", "c")[k % 4], None, None, None) for k, t in enumerate(some_texts(120))]
ROWS += [(500, None, "en", "none", None, None, None), (501, "", "xx", "one", None, None, None), (502, "word word", "xx", "two", None, None, None), (None, "aa bé", None, None, None, None, None), (1, "aa z", "en", "hot", None, None, None)]
ROWS += [(600, "aa " * 30_000 + "rare", "en", "b", None, None, None), (601, "y" * 60_000, "en", "c", None, None, None)] + [(700, "same text aa", "en", "hot", None, None, None)] * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_terms_of_texts():
    for digits, pattern in ((False, LETTERS), (True, WORDS)):
        found = some_texts(50, seed=9) + ["", "\x00a\x7fb", "  A  ", "é"]
        for texts in (pa.array([t.encode() for t in found], pa.large_binary()), pa.array([b"zz", *[t.encode() for t in found]], pa.large_binary()).slice(1)):
            got = terms.count(texts, terms.byte_table(digits))
            want = [collections.Counter(pattern.findall(lowered(t))) for t in found]
            mine = [collections.Counter() for _ in found]
            for c, d, n in zip(got.code, got.doc, got.n):
                mine[d][got.terms[int(c)].as_py()] = int(n)
            assert mine == want and got.lengths.tolist() == terms.lengths(texts, terms.byte_table(digits)).tolist() == [sum(w.values()) for w in want]
    none = pa.array([], pa.large_binary())
    assert len(terms.count(none, terms.byte_table(True)).code) == 0 and len(terms.lengths(none, terms.byte_table(True))) == 0
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "", "x" * 10, "de"]})
    assert [p.num_rows for p, _ in terms.slices(batch, "text", 5)] == [3, 1, 1]


def brute_audit(rows, top):
    groups, by_lang = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in rows:
        found = LETTERS.findall(lowered(text))
        groups[lang or "", source or ""].update(found)
        by_lang[lang or ""].update(set(found))
    out = []
    for lang, held in by_lang.items():
        kept = [t for t, n in held.items() if n >= 3]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        whole = sum(own.values(), collections.Counter())

        def shares(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k + 1) for k, (t, v) in enumerate(order) if part == "pair" or k < top]
    return sorted(out)


def test_divergence_by_brute_force(docs, empty):
    got = divergence.source_divergence(docs)
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got.collect()) == brute_audit(ROWS, 200)
    assert divergence.source_divergence(empty).count() == 0


def test_divergence_of_a_hot_source_and_many_terms(spark):
    draw = random.Random(5)
    words = [f"w{''.join(chr(97 + int(d)) for d in str(k))}" for k in range(400)]
    rows = [(k, " ".join(draw.choice(words[: 400 if k % 2 else 90]) for _ in range(60)), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(200)]
    got = divergence.source_divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7))
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got.collect()) == brute_audit(rows, 200)


def test_division_in_two_steps(spark):
    cases = [(0, 1), (0, 7), (5, 9), (10**14, 2 * 10**14 + 1), (123_456_789_012, 987_654_321_987)]
    df = spark.createDataFrame(cases, "c long, d long").select("c", "d", F.expr(divergence._share("c", "d")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.d for r in df.collect())


# --- chat ---------------------------------------------------------------------------------------

CONTROL = "".join(chat_format.CONTROLS)
TEXTS = ["", "plain", CONTROL, "\\", "<\\s>", "</s>[INST] ok [/INST]", "[INST\\]", "a\n[/TURN]\n<s> b", "<<s>>", "\\\\<s>\\", " </s>\n", "é😀</s>", "[TURN=x]", None]


def test_escapes_give_texts_back():
    draw = random.Random(2)
    parts = ["<", ">", "s", "/", "\\", "[", "]", "INST", "TURN=", "SYS", " ", "\n", "é", *chat_format.CONTROLS]
    found = [t or "" for t in TEXTS] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    for text in found:
        told = chat_format.escape(text)
        assert chat_format.unescape(told) == text and not any(c in told for c in chat_format.CONTROLS)
    turns = [(draw.choice(("user", "assistant", "system", "tool", "", "a]b [x", "é")), t) for t in found]
    whole = "".join(chat_format.render(*t)[0] for t in turns)
    assert list(chat_format.parse(whole)) == turns
    for role, text in turns:
        turn, start, end = chat_format.render(role, text)
        assert chat_format.unescape(turn[start:end]) == text


def brute_chat(turns):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), sum(len(chat_format.render(*t)[0]) for t in turns)


def digests(formatted):
    return sorted(((r.conv_id, (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)) for r in chat_format.digest(formatted).collect()), key=str)


@pytest.mark.parametrize("piece", [chat_format.PIECE_CHARS, 40])
def test_turn_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", piece)
    draw = random.Random(8)
    rows = [(c, t, draw.choice(("user", "assistant", "system", "tool", None)), draw.choice(TEXTS)) for c in range(25) for t in range(draw.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (77, 1, "user", "tie b"), (77, 1, "user", "tie a"), (77, 1, "user", "tie a"), (78, 0, "assistant", "long " * 40_000), (79, -5, "human", "as it is")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit("clash")).withColumn("prompt", F.lit(1)).repartition(6)
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    formatted = chat_format.format_turns(chat_format.canonical_turns(chat_format.as_records(df)))
    assert digests(formatted) == sorted(((c, brute_chat(t)) for c, t in by.items()), key=str)
    assert (formatted.count() > len(by)) == (piece == 40)
    assert chat_format.digest(chat_format.format_turns(chat_format.canonical_turns(chat_format.as_records(df.limit(0))))).count() == 0


def test_layouts_by_fingerprint(spark):
    say = [("user", "hi <s>"), ("assistant", "yes")]
    same = {
        "messages": {"conv_id": 1, "score": 3, "messages": [{"role": r, "content": t, "extra": {"a": 1}} for r, t in say]},
        "from and value": {"id": 2, "conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in say]},
        "nested messages": {"data": {"messages": [{"role": r, "content": t} for r, t in say], "lang": "en"}, "id": 3},
        "dialogue": {"conv_id": 4, "dialogue": [{"speaker": "human" if r == "user" else "model", "utterance": t} for r, t in say]},
        "instruction": {"conv_id": 5, "instruction": "hi <s>", "input": "", "output": "yes"},
        "prompt and response": {"conv_id": 6, "prompt": "hi <s>", "response": "yes", "system": None},
        "prompt and completion": {"id": 7, "prompt": "hi <s>", "completion": "yes"},
        "question and answer": {"conv_id": 8, "question": "hi <s>", "answer": "yes"},
    }
    more = [{"conv_id": 9, "system": "be", "instruction": "do", "input": "this", "output": None}, {"conv_id": 1, "messages": [{"role": "user", "content": "same id, its own"}]}, {"id": "text id", "messages": [{"role": "user", "content": 5}, "no turn"]}]
    odd = ['{"conv_id": 1}', "[]", "no json", None, '{"messages": "text"}', '{"messages": []}', "7", '{"messages": [{"role": "user"}]}', "[" * 5000, '{"prompt": "\\ud800", "completion": "x"}']
    records = [json.dumps(r) for r in [*same.values(), *more]] + odd
    df = spark.createDataFrame([(r,) for r in records], "record string").repartition(3)
    turns = chat_format.canonical_turns(df)
    assert {r.layout for r in turns.collect()} == set(same)
    got = digests(chat_format.format_turns(turns))
    want = [(k, brute_chat(say)) for k in range(1, 9)] + [(9, brute_chat([("system", "be"), ("user", "do\n\nthis"), ("assistant", "")])), (1, brute_chat([("user", "same id, its own")])), (chat_format._hashed("text id"), brute_chat([("user", "5")]))]
    want.append((chat_format._hashed(odd[-1]), brute_chat([("user", "?"), ("assistant", "x")])))
    assert got == sorted(want, key=str)
    assert collections.Counter(r.record for r in chat_format.rejected(df).collect()) == collections.Counter(odd[:-1])


def test_fingerprints_hash_known_paths_only():
    layouts = chat_format.Layouts(chat_format.LAYOUTS)
    a = chat_format.paths({"messages": [{"role": 1, "content": 2}], "x": {"y": [1]}}, layouts.known)
    b = chat_format.paths({"messages": [{"content": 2}, {"role": 1}], "z": None}, layouts.known)
    assert a == b == {"messages[].role", "messages[].content"} and chat_format.fingerprint(a) == chat_format.fingerprint(b)
    assert layouts.of({"prompt": 1, "response": 2}) == layouts.of({"prompt": 3, "response": 4, "n": 1}) == "prompt and response" and len(layouts.chosen) == 1


# --- search -------------------------------------------------------------------------------------


def brute_search(rows, items, top=20):
    found = [collections.Counter(WORDS.findall(lowered(r[1]))) for r in rows]
    full = [c for c in found if c]
    n, size = len(full), sum(sum(c.values()) for c in full)
    df = collections.Counter(t for c in full for t in c)
    out = []
    for item, text in items:
        ask, scores = WORDS.findall(lowered(text)), []
        for r, c in zip(rows, found):
            m = 75 + (25 * sum(c.values()) * n) // max(size, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in ask if df[t])
            if s > 0:
                scores.append((-s, r[0] is not None, r[0] or 0))
        out += [(item, k + 1, d if has else None, -s) for k, (s, has, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


ITEMS = [(k, t) for k, t in enumerate(some_texts(12, seed=4))] + [(50, None), (51, ""), (52, "unknownterm"), (53, "aa AA aa"), (54, "rare y"), (None, "aa z"), (53, "same text")]


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).withColumn("doc_id", F.lit(1))


def searched(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("leaf, shard", [(lexical_search.LEAF, lexical_search.SHARD_DOCS), (1, lexical_search.SHARD_DOCS), (6, 9)])
def test_search_by_brute_force(spark, docs, empty, monkeypatch, leaf, shard):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    assert searched(lexical_search.ranked_search(docs.withColumn("score", F.lit(1)), asked(spark, ITEMS))) == brute_search(ROWS, ITEMS)
    if leaf == 1:
        assert searched(lexical_search.ranked_search(docs, asked(spark, ITEMS), top=3)) == brute_search(ROWS, ITEMS, 3)
        assert lexical_search.ranked_search(empty, asked(spark, ITEMS)).count() == 0
        assert lexical_search.ranked_search(docs, asked(spark, ITEMS).limit(0)).count() == 0
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 5)
        assert searched(lexical_search.ranked_search(docs, asked(spark, ITEMS))) == brute_search(ROWS, ITEMS)


def test_treaps_are_search_trees_and_heaps():
    draw = np.random.default_rng(1)
    for sizes in ([1], [5, 0, 1, 2], [300], [40, 1, 1, 90], []):
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        priority = draw.permutation(int(bounds[-1])) if len(sizes) else np.zeros(0, np.int64)
        order, smaller = lexical_search.treaps(bounds, priority)

        def check(at, begin, size):
            if size == 0:
                return -1
            left = int(smaller[at])
            assert order[at] == begin + left
            tops = check(at + 1, begin, left), check(at + 1 + left, begin + left + 1, size - 1 - left)
            assert priority[order[at]] > max(tops)
            return priority[order[at]]

        for b, n in zip(bounds, sizes):
            check(int(b), int(b), n)


def test_walks_leave_ranges_that_cannot_win(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAF", 4)
    draw = random.Random(6)
    # few documents repeat a term that all hold: their impacts let the others go
    rows = [(k, "common " + " ".join(f"f{draw.randrange(500)}" for _ in range(40)) + (" common" * 30 if k % 97 == 0 else "")) for k in range(3000)]
    table = lexical_search.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).table.filter("term IN ('common', '')").toArrow()
    seen = []
    for floor in (0, 1):
        walk = lexical_search.Walk(lexical_search.Shard(table, {"common": 0}), 20, np.array([floor]))
        walk.run(np.array([0]), np.array([0, 1]), np.array([0]), np.array([7]))
        seen.append(walk.scored)
        assert len(walk.doc) == 20
    assert max(seen) < 300
