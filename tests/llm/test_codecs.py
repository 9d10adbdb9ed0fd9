"""Vectorised codecs against the libraries, and against one step at a time."""

import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import audio, bpe, token_files, url_filters

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
ODD = ["", " ", "\n", " \n ", " a", "a ", "a" * 5000, "ab" * 3000, " " * 300, "\n" * 50, "▁x▁", "<s>", "中文😀é\x00", "the" * 300, " " * 33 + "x" + " " * 17]


def same(found):
    m = bpe.model(PIECES)
    mine, theirs = m.encode_batch(found), LIBRARY.encode(found, num_threads=1)
    for t, a, b in zip(found, mine, theirs):
        assert a.tolist() == b, t[:60]
        assert m.decode(b) == LIBRARY.decode(b)


def test_pieces_of_odd_texts():
    same(ODD)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefgth eraino  \n\té中文▁😀'<s>.!#01aaaa"), max_size=60))
def test_pieces_of_any_text(text):
    same([text])


def test_merges_that_rank_below_their_own_are_redone():
    rng = random.Random(3)
    same(["".join(rng.choice(["the", "he", "abcd", "bcd", "a", "ing", "tion", " "]) for _ in range(40)) for _ in range(500)])


def test_words_equal_the_library():
    rng, library = random.Random(2), Tokenizer.from_file(WORDS)
    alphabet = "abcXYZ  \n\t.,!'’éÉßΣσİ…“12<|>st"
    found = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["<|endoftext|>a", "<|ENDOFTEXT|> b", "don't. They'LL, x.", ""]
    sizes, ids = token_files.ChunkEncoder(WORDS).encode(pa.array(found))
    assert len(sizes) == len(found) and sizes.sum() == len(ids)
    for t, a, b in zip(found, np.split(ids, np.cumsum(sizes)[:-1]), library.encode_batch(found, add_special_tokens=False)):
        assert a.tolist() == b.ids, t


def test_words_by_any_gathering(monkeypatch):
    rng, library = random.Random(4), Tokenizer.from_file(WORDS)
    found = [None, "", " ", "<|endoftext|>", *(" ".join(rng.choice(["Tide", "mark.", "x,", "(y),", "12", "ﬁn", "<|z"]) for _ in range(rng.randint(0, 30))) + rng.choice(["", ". ", "\n"]) for _ in range(200))]
    want = [i for t in found for i in [*library.encode(t or "", add_special_tokens=False).ids, 1]]
    for n in (1, 3, 64, 1 << 18):
        monkeypatch.setattr(token_files, "GATHERED", n)
        sizes, ids = token_files.ChunkEncoder(WORDS).encode(pa.array(found), 1)
        assert ids.tolist() == want and sizes[:4].tolist() == [1, 1, 1, 2]
    sizes, ids = token_files.ChunkEncoder(WORDS).encode(pa.array([], pa.string()), 1)
    assert len(sizes) == len(ids) == 0


@pytest.mark.parametrize("vocabulary", [2, 100, 257, 32000, 49408, 1 << 20, 1 << 31])
def test_packed_ids_come_back(vocabulary):
    ids = np.random.default_rng(0).integers(0, vocabulary, 20001).astype(np.uint32)
    out = io.BytesIO()
    w = token_files.Writer(out, vocabulary)
    w.add(pa.array([5, None], pa.int64()), np.array([20000, 0]), ids[:20000])
    w.add(pa.array([9], pa.int32()), np.array([1]), ids[20000:])
    w.close()
    r = token_files.read_bytes(out.getvalue())
    assert (r.ids(0, 20001) == ids).all() and (r.ids(8190, 16400) == ids[8190:16400]).all() and len(r.ids(7, 7)) == 0
    assert r.doc_ids.tolist() == [5, 0, 9] and r.null.tolist() == [False, True, False] and r.starts.tolist() == [0, 20000, 20000, 20001]


def test_checksums_by_any_chunk():
    draw = np.random.default_rng(3)
    sizes = np.array([1, 70, 1, 3000, 2, 5, 40, 1])
    ids = draw.integers(0, 5000, sizes.sum()).astype(np.uint32)
    out = io.BytesIO()
    w = token_files.Writer(out, 5000)
    w.add(pa.array(range(8), pa.int64()), sizes, ids)
    w.close()
    want = [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    for chunk in (1, 7, 64, 100, 1 << 20):
        parts = list(token_files.read_bytes(out.getvalue()).checksums(chunk))
        assert [c for _, crcs in parts for c in crcs] == want and [at for at, _ in parts] == np.cumsum([0, *(len(c) for _, c in parts)])[:-1].tolist()


def test_empty_token_file():
    out = io.BytesIO()
    token_files.Writer(out, 10).close()
    assert token_files.read_bytes(out.getvalue()).count == 0


def adpcm_by_steps(block):
    steps, change = list(map(int, audio.STEPS.split())), list(map(int, audio.INDEX_CHANGES.split()))
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[index]
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + change[code & 7]))
            out.append(value)
    return out


def test_adpcm_equals_single_steps():
    blocks = np.random.default_rng(1).integers(0, 256, (7, audio.UNIT), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [adpcm_by_steps(bytes(b)) for b in blocks]


def test_companding_tables():
    mu, a = audio.mu_law_table().astype(int), audio.a_law_table().astype(int)
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_media_keeps_every_byte():
    raw = bytes(range(256)) * 3
    payload = audio.to_payload(raw)
    for codec in (audio.MU_LAW, audio.A_LAW, audio.ADPCM):
        m = audio.parse_media(audio.to_media(payload, codec))
        assert (m.codec, m.data, m.block) == (codec, payload, audio.UNIT if codec == audio.ADPCM else 1)
    assert len(audio.to_payload(b"")) == audio.UNIT and len(payload) % audio.UNIT == 0 and len(audio.to_payload(b"x" * 192)) == 192
    assert len(audio.resample(np.arange(10, dtype=np.int16))) == 20


def test_adpcm_header_says_what_the_blocks_hold():
    blob = audio.to_media(bytes(3 * audio.UNIT), audio.ADPCM)
    code, channels, rate, per_second, align, bits, extra, samples = struct.unpack_from("<HHIIHHHH", blob, 20)
    assert (code, channels, rate, align, bits, extra, samples) == (17, 1, 8000, 192, 4, 2, 377) and per_second == 8000 * 192 // 377
    assert struct.unpack_from("<4sII", blob, 40) == (b"fact", 4, 3 * 377) and struct.unpack_from("<I", blob, 4)[0] == len(blob) - 8


def wave(codec, block, data):
    form = struct.pack("<HHIIHHHH", codec, 1, 8000, 4000, block, 4, 2, 0)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + struct.pack("<4sI", b"LIST", 3) + b"abc\x00" + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def test_blocks_of_any_size_and_cut_ones():
    draw = np.random.default_rng(2)
    found = [draw.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (64, 300, 70, 4, 256, 0)]
    blobs = [wave(17, b, d) for d, b in zip(found, (64, 64, 32, 32, 256, 64))]
    got = audio.decoded([audio.parse_media(x) for x in blobs])
    for d, b, samples in zip(found, (64, 64, 32, 32, 256, 64), got):
        assert samples.tolist() == [x for at in range(0, len(d), b) for x in adpcm_by_steps(d[at : at + b])]
    for bad in (wave(17, 64, found[0] + b"ab"), wave(17, 64, found[0])[:-1], wave(1, 2, b"abcd"), b"", b"RIFF\x00\x00\x00\x00WAVE"):
        with pytest.raises(ValueError):
            audio.decoded([audio.parse_media(bad)])


def fits(glob, text):
    """Whole-text glob match by recursion."""
    if not glob:
        return not text
    if glob.startswith(b"**"):
        return any(fits(glob[2:], text[i:]) for i in range(len(text) + 1))
    if glob[:1] == b"*":
        return any(b"/" not in text[:i] and fits(glob[1:], text[i:]) for i in range(len(text) + 1))
    return bool(text) and (text[:1] != b"/" if glob[:1] == b"?" else text[:1] == glob[:1]) and fits(glob[1:], text[1:])


def test_automaton_equals_recursion():
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randint(0, 7))) for _ in range(40)]
    found = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 9))).encode() for _ in range(300)]
    got = url_filters.Automaton(globs).match(found)
    assert url_filters.Automaton(globs).words > 1
    for i, u in enumerate(found):
        for j, g in enumerate(globs):
            assert got[i, j] == fits(g.encode(), u), (g, u)


def test_thousands_of_patterns():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 5)))
    globs = [rng.choice(("{}.**", "*{}*.com/**", "**/{}", "*.{}.net/{}/*", "?{}**")).format(word(), word()) for _ in range(3000)]
    found = [f"{word()}.{word()}.{rng.choice(('com', 'net'))}/{word()}/{word()}".encode() for _ in range(60)] + [b"a" * 20_000 + b".com/", b""]
    automaton = url_filters.Automaton(globs)
    got = automaton.match(found)
    assert automaton.words > 300 and got.any() and not got.all()
    import re

    for j, g in enumerate(globs):
        says = re.compile(url_filters.as_pattern(g).encode(), re.S)
        assert [bool(says.fullmatch(u)) for u in found] == got[:, j].tolist(), g


def test_canonical_urls():
    assert url_filters.canonical("HTTP://A.Example.NET/En/x?q#f") == (b"a.example.net", b"/En/x")
    assert url_filters.canonical(None) == url_filters.canonical("no scheme") == (b"", b"") and url_filters.canonical("x://h?q") == (b"h", b"")
