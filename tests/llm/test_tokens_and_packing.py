from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing, token_bpe
from graphloom.llm.queries import tokenizer

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def coder():
    return token_bpe.encoder(tokenizer(WORD))


def same(coder, text):
    ids, decoded = coder.encode(text)
    want = coder.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == coder.library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text_is_encoded_as_the_library_does(text):
    same(token_bpe.encoder(tokenizer(WORD)), text)


@pytest.mark.parametrize("text", ["", " ", "ΣΑΣ İstanbul ǅ ﬁ Ⅷ", "é ẛ̣", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "it's we'll 'S", "\x00\x1c\x85\xa0　x", "a" * 3000, "ab" * 999 + "!" * 500, "日本語🙂👩‍👩‍👧", "x" * 5 + "<|endoftext|>" * 3])
def test_known_texts(coder, text):
    same(coder, text)


def test_random_words_over_few_letters(coder):
    rng = random.Random(1)
    for _ in range(3000):
        same(coder, "".join(rng.choice("abtheinosr") for _ in range(rng.randint(1, 24))))


def test_compatibility_is_what_merging_gives(coder):
    rng, bpe = random.Random(2), coder.bpe
    inner = [i for t, i in bpe.symbols.items() if not t or ord(t[-1]) < 0x10000]
    packed = {i: t for t, i in bpe.symbols.items()}
    for _ in range(4000):
        a, b = rng.choice(inner), rng.choice(list(packed))
        assert bpe.compatible(a, b) == (bpe._merged(packed[a] + packed[b]) == [a, b])


def test_encode_query_columns(spark, coder):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "Hello world"), (1, "Hello world")]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_tokens long, id string")
    got = token_bpe.encode_texts(df, tokenizer(WORD)).collect()
    want = []
    for i, t in rows:
        ids, text = coder.encode(t or "")
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_bpe.encode_texts(df.limit(0), tokenizer(WORD)).count() == 0
    kept = token_bpe.encode_texts(df.limit(1), tokenizer(WORD), keep=True).first()
    assert kept.decoded == "hello</w> world</w>" and len(kept.ids) == 8


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_plain_ids_are_the_librarys(text):
    ids = packing.ids_of(tokenizer(BYTE))
    assert np.frombuffer(ids.encode(text), "<u4").tolist() == ids.library.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_is_the_plain_rule():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        bins: list[list[int]] = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            for b in bins:
                if sum(sizes[x] for x in b) + sizes[k] <= 100:
                    b.append(k)
                    break
            else:
                bins.append([k])
        assert packing.first_fit_decreasing(sizes, 100) == bins


def check_pieces(rows, pieces, length):
    ids = packing.ids_of(tokenizer(BYTE))
    whole = defaultdict(list)
    for i, t in rows:
        whole[i].append(ids.encode(t or "") + bytes(4))
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        covered[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, texts in whole.items():
        want = sum(len(t) // 4 for t in texts)
        assert sum(x[1] for x in covered[i]) == want
        for start, size, crc, n in covered[i]:
            assert any(n == len(t) // 4 and zlib.crc32(t[4 * start : 4 * (start + size)]) == crc for t in texts)
    for s in sequences.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at and size > 0
            at += size
        assert at <= length
    return sum(length - sum(x[1] for x in s) for s in sequences.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, None), (None, "a b"), (None, "a b")], [(1, "word " * 1023), (2, "word " * 1024), (3, "word " * 5000), (4, "<|endoftext|>")], [(1, "same text"), (1, "same text"), (1, "other")]])
@pytest.mark.parametrize("keep", [False, True])
def test_packing_cases(spark, rows, keep):
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, g long, id string").repartition(2)
    got = packing.pack(df, tokenizer(BYTE), keep_ids=keep).collect()
    check_pieces(rows, got, 1024)
    if keep:
        assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in got)


def test_packing_leaves_little_padding(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 200)))) for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer(BYTE), length=64, group=100).collect()
    tokens = sum(p.length for p in got)
    assert check_pieces(rows, got, 64) < 6 * 64 + 8 * tokens / 64


def test_every_entry_of_the_vocabulary_is_the_same_in_both_libraries():

    ids = packing.Ids(tokenizer("byte_bpe_50k.json"))
    texts = [ids.library.decode([i]) for i in range(ids.library.get_vocab_size())]
    for a, b in zip(texts, reversed(texts), strict=True):
        text = a + b
        assert ids.encode(text) == np.array(ids.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("name", ["doc_id", "length", "Offset", "weird id"])
def test_pieces_have_no_two_columns_of_a_name(spark, name):

    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], f"`{name}` long, text string")
    out = packing.pack(df, tokenizer("byte_bpe_50k.json"), id_col=name)
    assert len({c.lower() for c in out.columns}) == len(out.columns) == 7
    assert sum(r["doc_tokens"] for r in out.collect()) == 4 + 4 + 1
