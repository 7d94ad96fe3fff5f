from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import align
from graphloom.llm.queries import tokenizer
from graphloom.llm.token_bpe import byte_letters

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
TEXTS = [
    "Some words, words and  spaces\n\tand tabs ", "some words again", "words", "", None, "\u2581not a space", "a\u2581b", "<|endoftext|> and <s>, <unk> </s><0x41>", "\x00\x01", "\r\n",
    "Éa ñandú ﬁne \u200b\ufeff \U0001f600\U0001f468\u200d\U0001f469 日本語のテキスト", "e\u0301 combining", "x", "x", "word " * 3000, "a" * 5000, "نص عربي 123456789",
]


def plain_sides(text, a_lib, b_lib):
    """The (id, bytes) of both sides, from the libraries alone."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    a = [(i, bytes(byte_of[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in b_lib.encode(text):
        piece = b_lib.id_to_piece(i)
        b.append((i, bytes([int(piece[1:-1], 16)]) if b_lib.is_byte(i) else piece.replace("\u2581", " ").encode()))
    raw = (" " + text).encode()
    good = text and b"".join(x for _, x in a) == raw and b"".join(x for _, x in b) == raw
    return (a, b) if good else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain_align(rows):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    each = []
    for key, text in rows:
        a, b = map(spans, plain_sides(text or "", a_lib, b_lib))
        links = [(i, j) for i, p, q in a for j, r, s in b if max(p, r) < min(q, s)] if len(a) * len(b) < 10**6 else sweep(a, b)
        ends = sorted({q for _, _, q in a} & {s for _, _, s in b})
        groups, low = [], 0
        left, right = iter(a), iter(b)
        for end in ends:
            x, y = [], []
            for side, tokens in ((x, left), (y, right)):
                for i, _, q in tokens:
                    side.append(str(i))
                    if q == end:
                        break
            groups.append(",".join(x) + "|" + ",".join(y))
        each.append((key, len(a), len(b), len(groups), links, ";".join(groups)))
    held = Counter(pair for *_, links, _ in each for pair in set(links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return sorted(((k, na, nb, ng, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text) for k, na, nb, ng, links, text in each), key=repr)


def sweep(a, b):
    out, j = [], 0
    for i, p, q in a:
        while b[j][2] <= p:
            j += 1
        k = j
        while k < len(b) and b[k][1] < q:
            out.append((i, b[k][0]))
            k += 1
    return out


def aligned(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pairs int").repartition(3)
    got = align.align_tokens(df, A, B, keep=True, **options)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("most", [align.MOST, 20, 0])
def test_against_spans(spark, most):
    """Counts of all pairs, of few and of none go to the tasks: the others meet theirs in a join."""
    rows = [*enumerate(TEXTS), (None, "some words"), (3, "some words")]
    assert aligned(spark, rows, most=most) == plain_align(rows)


def test_real_documents(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    assert aligned(spark, rows, most=500) == plain_align(rows)


def test_empty_table(spark):
    assert aligned(spark, []) == []


def test_overlaps_of_lengths():
    a, b, cuts = align.overlaps(np.array([2, 3, 1]), np.array([1, 4, 1]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2)] and cuts.tolist() == [5]
    a, b, cuts = align.overlaps(np.zeros(0, int), np.zeros(0, int))
    assert len(a) == len(b) == len(cuts) == 0
