from __future__ import annotations

import random

import pytest

from graphloom.llm import html_extract as H
from graphloom.llm import toxicity as X

PAGES = {
    "": "",
    "plain text": "plain text",
    "<article><h1>A &amp; B</h1><p>One<br>two  <b>bold</b>\n three.<p>Next &#233;&nbsp;x</article>": "A & B\nOne two bold three.\nNext é x",
    "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><p>This is the story of a page. It goes on for a while.</p></article><footer>&copy; 2020 nobody</footer></body>": "This is the story of a page. It goes on for a while.",
    "<article><p>Body text of the article stays here.</p><script>var a='</p>';</script><style>p{}</style><!-- no <p>comment</p> --></article>": "Body text of the article stays here.",
    '<main><p>The article itself is this paragraph, in full.</p></main><section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this article a lot, thank you.</p></div></section>': "The article itself is this paragraph, in full.",
    '<div class="cookie-notice"><p>We use cookies to make things better. Please agree.</p></div><div class="post-content"><p>Here the text begins.</p><ul><li>one point</li><li>another point</li></ul></div><aside><p>Related matters for you to read.</p></aside>': "Here the text begins.\none point\nanother point",
    '<form class="search"><label>Search</label><input></form><article><p>Only this.</p><div class="ad">Buy now. It is cheap.</div><p>And this too.</p></article>': "Only this.\nAnd this too.",
    '<article><p title="a > b" data-x=\'"\'>Quotes in tags</p><p hidden>unseen</p></article>': "Quotes in tags",
}


@pytest.mark.parametrize("page", list(PAGES)[2:])
def test_known_pages(page):
    assert H.default_model().extract(page) == PAGES[page]


@pytest.mark.parametrize("page", ["<", "<p", "<!--", "<!-- x", "<script>", "</p></div>", "<a <b>", "<p>" * 3000 + "x", "<div>" * 3000 + "x", '<p a="' + "x" * 1000, "<>", "\x00<p>\x00", "<td><li><tr>x", "<" * 20000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(H.default_model().extract(page), str)


def test_marginals_are_exact():
    """The passes against the sum over all assignments."""
    import itertools
    import math

    model = H.default_model()
    nodes = H.parse('<body><div class="ad"><p>a b c</p></div><article><p>Some words here.</p></article></body>')
    assert len(nodes) <= 9
    own = []
    for x in nodes:
        odds = sum(model.node.get(f, 0.0) for f in H.features(x)) * (H.TEXT_WEIGHT if x.tag == H.TEXT else 1)
        p = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        own.append((1 - p, p))
    total, ones = 0.0, [0.0] * len(nodes)
    for s in itertools.product((0, 1), repeat=len(nodes)):
        w = model.root[s[0]] * own[0][s[0]]
        for i in range(1, len(nodes)):
            w *= own[i][s[i]] * model.edge[H.kind(nodes[i])][s[nodes[i].parent]][s[i]]
        total += w
        for i, v in enumerate(s):
            ones[i] += w * v
    assert model.marginals(nodes) == pytest.approx([x / total for x in ones], abs=1e-9)


def test_held_out_pages():
    model, right, total = H.default_model(), 0, 0
    for page in H.training_pages(150, seed=77):
        nodes = H.parse(page, labels=True)
        for x, p in zip(nodes, model.marginals(nodes), strict=True):
            if x.tag == H.TEXT:
                right += (p >= 0.5) == bool(x.label)
                total += 1
    assert right > 0.98 * total


def test_pages_table(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>é text is here.</p></article>", "x"), (None, "u", "<article><p>é text is here.</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), *[(None, "u", "é text is here.", 15)] * 2], key=repr)
    assert H.extract_pages(df.limit(0)).count() == 0


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "do", "ri", "mu", "ten", "sol", "kra"]) for _ in range(rng.randint(1, 4)))
    texts = [[word() for _ in range(rng.randint(5, 120))] for _ in range(n)]
    for i in range(0, n, 2):
        for _ in range(rng.randint(3, 6)):
            texts[i].insert(rng.randrange(len(texts[i])), rng.choice(["vexxolt", "gruffin", "plizzard", "zwickel"]))
    return [" ".join(t) for t in texts[::2]], [" ".join(t) for t in texts[1::2]]


def test_held_out_accuracy():
    detector = X.fit(*corpus(400, 1))
    bad, good = corpus(200, 2)
    right = sum(detector.score(t) >= 0.5 for t in bad) + sum(detector.score(t) < 0.5 for t in good)
    assert right >= 0.95 * 200
    assert 0 <= detector.score("") <= 1 and 0 <= detector.score("x" * 2_000_000) <= 1


def test_without_labels_scores_are_the_share():
    assert X.fit([], []).score("anything") == pytest.approx(0.5)
    assert X.fit(["a"], ["b"] * 3).score("anything") == pytest.approx(0.25)


def test_training_and_scoring_tables(spark):
    bad, good = corpus(300, 3)
    texts = [*bad, *good, None, ""]
    ids = list(range(len(texts)))
    df = spark.createDataFrame([(i, t, 5, 0.5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, predicted long, score double").repartition(4)
    labels = spark.createDataFrame([(i, int(i < len(bad))) for i in ids[:-2]] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    detector = X.train(df, labels)
    out = {r.doc_id: r for r in X.score_texts(df, detector, carry={"doc_id": df.doc_id}).collect()}
    assert set(out) == set(ids) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    kept = X.keep_ordinary(df, detector)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in ids if not out[i].predicted}
    assert sum(out[i].predicted for i in ids[: len(bad)]) > 0.9 * len(bad)
    assert X.score_texts(df.limit(0), detector).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    got = {r.doc_id: r.l for r in spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", X.learned_rows().alias("l")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200)}
