import hashlib
import os
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from faultbench.llm.bpe_codec import WordBPE, encode_decode, encode_decode_digests
from faultbench.llm import packing
from faultbench.llm.token_counts import ByteEncoder, count_tokens, encoder

from awkward import documents, text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"ab 'sTRedlm\n\t 0123.,!?É日本́\x1c\x85ſ٣²½𝒳😀‍Σ\x00", "  ", "\n ", "'LL", "'re", " <|endoftext|>", "the ", "<|startoftext|>", "<|endo"]


def texts(n, size=50):
    random.seed(3)
    return ["".join(random.choices(PARTS, k=random.randint(0, size))) for _ in range(n)] + ["aaaa" * 60, "ab" * 300]


@pytest.fixture(scope="module")
def byte():
    return tokenizers.Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return tokenizers.Tokenizer.from_file(WORD)


def test_byte_ids_equal_the_library(byte):
    some = texts(4000)
    got = [np.frombuffer(x, "<u4").tolist() for x in ByteEncoder(BYTE).encode(some)]
    assert got == [x.ids for x in byte.encode_batch(some, add_special_tokens=False)]


def test_small_memory_changes_nothing():
    some = texts(300)
    tight = ByteEncoder(BYTE, memory=20)
    assert [tight.encode([t])[0] for t in some] == ByteEncoder(BYTE).encode(some)
    assert len(tight.known) < 200
    narrow = WordBPE(WORD, memory=20)
    assert [narrow.encode([t])[0] for t in some] == WordBPE(WORD).encode(some)


def test_a_batch_of_many_short_words_takes_bounded_memory(byte):
    unit = "a b "
    some = pa.array([unit * 1024] * (packing.BATCH_BYTES // 4096))
    enc = ByteEncoder(BYTE)
    tracemalloc.start()
    ids, counts = enc.encode_flat(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids[: counts[0]].tolist() == byte.encode(unit * 1024, add_special_tokens=False).ids
    assert peak < 250e6  # without Arrow's own


def test_learning_many_words_takes_bounded_memory():
    some = pa.array([" ".join(f"{i * 7919:x}" for i in range(j, j + 10_000)) for j in range(0, 300_000, 10_000)])
    enc = encoder(BYTE, packing.MEMORY)
    tracemalloc.start()
    ids, counts = enc.encode_flat(some)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(enc.known) <= 100_000
    assert held < 60e6 and peak < 200e6, (held, peak)


def test_a_full_memory_keeps_the_pieces_met_oftenest():
    enc, often = ByteEncoder(BYTE, memory=20), "the of and to in is it as"
    for i in range(5):
        enc.encode([often])
    enc.encode([f"once {often} twice some other words here"])
    enc.encode(["once twice some other words here " + " ".join(map(str, range(20)))])
    assert set(often.split()[1:]) <= set(enc.known) and len(enc.known) <= 10


def test_word_ids_and_decoding_equal_the_library(word):
    some = texts(4000) + [f"a{chr(c)}b{chr(c)}1" for c in range(0x250, 0x2000)]
    got = WordBPE(WORD).encode(some)
    for t, (n, ids, decoded), want in zip(some, got, word.encode_batch(some, add_special_tokens=False)):
        assert (n, ids) == (len(want.ids), " ".join(map(str, want.ids))), t
        assert decoded == word.decode(want.ids, skip_special_tokens=False), t


def test_long_words_equal_the_library(word):
    random.seed(17)
    some = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (4095, 4096, 4097, 30_000)]
    some += ["ab" * 5000, "a" * 9999, "".join(random.choices("aeé日z", k=8000)), "the" * 4000 + " x"]
    for t, (n, ids, _) in zip(some, WordBPE(WORD).encode(some)):
        assert ids == " ".join(map(str, word.encode(t, add_special_tokens=False).ids))
    start = time.process_time()
    assert WordBPE(WORD).encode(["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))])[0][0] > 10_000
    assert time.process_time() - start < 30  # about 6 seconds on an idle machine


def test_characters_newer_than_python(word):
    some = [f"x {chr(c)}y{chr(c)} 1" for c in (0x1C89, 0xA7CB, 0x558, 0x105C0, 0x10D50)]
    assert [x[1] for x in WordBPE(WORD).encode(some)] == [
        " ".join(map(str, x.ids)) for x in word.encode_batch(some, add_special_tokens=False)
    ]


def test_counts_over_awkward_rows(spark, byte):
    got = sorted(map(tuple, count_tokens(documents(spark), BYTE, limit=6).collect()), key=str)
    want = [(d, len(t.encode()), n := len(byte.encode(t, add_special_tokens=False).ids), n > 6) for d, t in text()]
    assert got == sorted(want, key=str)
    assert count_tokens(documents(spark, []), BYTE).collect() == []


def test_codec_over_awkward_rows(spark, word):
    ids = {t: word.encode(t, add_special_tokens=False).ids for _, t in text()}
    want = [(d, len(ids[t]), " ".join(map(str, ids[t])), word.decode(ids[t], skip_special_tokens=False)) for d, t in text()]
    got = list(map(tuple, encode_decode(documents(spark), WORD).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    short = [tuple(hashlib.sha256(x.encode()).hexdigest() if isinstance(x, str) else x for x in r) for r in want]
    assert sorted(map(tuple, encode_decode_digests(documents(spark), WORD).collect()), key=str) == sorted(short, key=str)
    assert encode_decode(documents(spark, []), WORD).collect() == []
