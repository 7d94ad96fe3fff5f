from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from graphloom.llm import queries
from graphloom.llm import toxicity as X


def corpus(seed: int, n: int, words: list[str], share: float) -> list[str]:
    rng = random.Random(seed)
    syllables = ["ba", "do", "ri", "mu", "te", "ko", "la", "ne", "si", "pu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    return [" ".join(rng.choice(words) if words and rng.random() < share else word() for _ in range(rng.randint(30, 120))) for _ in range(n)]


INSULTS = ["wretchedfool", "vilescum", "stinkingrat", "uglyliar"]


@pytest.fixture(scope="module")
def detector():
    return X.fit(corpus(1, 150, INSULTS, 0.06), corpus(2, 300, [], 0))


def test_windows_hold_every_word_and_several_at_once():
    rng = random.Random(3)
    for _ in range(50):
        text = " ".join("x" * rng.choice((1, 3, 9, 20, 70)) + str(i) for i in range(rng.randint(0, 60)))
        raw = X.plain(text)
        found = [X.narrow(w) for w in X.windows(raw)]
        assert b"".join([found[0], *(w[1:] for w in found[1:])]) == raw
        assert found and all(len(w) <= 2 * X.WINDOW + 1 for w in found)
        for word in raw.split():
            if len(word) <= X.WINDOW // 2:
                assert any(b" " + word + b" " in w for w in found), (word, found)
    assert max(len(w.split()) for w in map(X.narrow, X.windows(X.plain("one two three four five six seven eight")))) > 2


def test_both_dictionaries_are_trained_and_differ_in_what_they_know(detector):
    assert all(w.encode() in detector.toxic for w in INSULTS) and not any(w.encode() in detector.ordinary for w in INSULTS)
    long, short = X.compressor(detector.ordinary), X.compressor(detector.toxic)
    assert X.distances([X.wide(b" bado vilescum rimu ")], long, short)[0] > X.distances([X.wide(b" bado teko rimu ")], long, short)[0]


def test_texts_not_learned_from(detector):
    bad = [detector.score(t) for t in corpus(11, 100, INSULTS, 0.06)]
    good = [detector.score(t) for t in corpus(12, 200, [], 0)]
    assert np.mean([s >= 0.5 for s in bad]) >= 0.9 and np.mean([s >= 0.5 for s in good]) <= 0.02
    assert all(0 <= s <= 1 for s in [detector.score(""), detector.score(" \n"), detector.score("\ud800"), detector.score("x" * 100_000), detector.score("!?" * 1000)])


def test_the_end_of_a_very_long_text_counts(detector):
    plain = " ".join(corpus(21, 3000, [], 0))
    assert detector.score(plain + " " + " ".join(INSULTS * 60)) > detector.score(plain)


def test_repeats_in_one_block_and_over_blocks_are_counted(detector, monkeypatch):
    pair = X._pair(detector.ordinary, detector.toxic)
    text = " ".join(corpus(5, 40, INSULTS, 0.1))
    whole = X.histogram(text, *pair)
    assert whole.sum() >= len(set(X.windows(X.plain(text))))
    monkeypatch.setattr(X, "BLOCK", 64)
    assert X.histogram(text, *pair).sum() >= whole.sum() - 1e-6


def test_a_very_long_labelled_text_first_leaves_the_others_to_learn_from(spark):
    bad, good = corpus(31, 60, INSULTS, 0.08), corpus(32, 120, [], 0)
    texts = [*bad, *good]
    docs = spark.createDataFrame([(1, "bado " * (X.SAMPLE_CHARS // 5 + 1)), *((i + 2, t) for i, t in enumerate(texts))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), *((i + 2, int(i < len(bad))) for i in range(len(texts)))], "doc_id long, toxic int")
    found = X.train(docs, labels)
    assert np.mean([found.score(t) >= 0.5 for t in bad]) >= 0.8 > 0.1 >= np.mean([found.score(t) >= 0.5 for t in good])


def test_query_against_a_plain_restatement(spark, tmp_path):
    """Every row comes back once with its own score; held_out is the id's remainder; nulls, ties, repeats and clashing columns."""
    texts = [*corpus(41, 60, INSULTS, 0.08), *corpus(42, 120, [], 0), None, "", "the same", "the same"]
    rows = [(i if t != "" else None, t, "x", 0.1) for i, t in enumerate(texts)]
    rows.append(rows[3])
    spark.createDataFrame(rows, "doc_id long, text string, score string, predicted double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), None) for i in range(180)] + [(None, 1, None), (5, None, None)], "doc_id long, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op2_toxicity(spark, str(tmp_path)).collect()
    same = X.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = []
    for i, t, *_ in rows:
        s = same.score(t or "")
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, s, int(s >= 0.5)))
    key = lambda r: (r[0] is None, r[0], r[2])
    assert sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("toxic", "ordinary"), [([], []), (["a"], ["b"] * 9), ([""] * 9, [""] * 9), (["x"] * 9, ["x"] * 9)])
def test_too_little_to_learn_from_gives_a_defined_score(toxic, ordinary):
    found = X.fit(toxic, ordinary)
    assert 0 <= found.score("anything at all") <= 1 and 0 <= found.score("") <= 1
