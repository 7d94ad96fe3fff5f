"""Pages of layouts that the training generator does not make, written by hand, and hostile input."""

from __future__ import annotations

import time

import pytest

from graphloom.llm import html_extract as H

# Each page with the lines of its article.
LAYOUTS = {
    "blog without telling names": (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>T</title></head><body><div class=c1><div class=c2><a href=/>Home</a> <a href=/about>About</a> <a href=/rss>RSS</a></div>
        <div class=c3><h1>Sharpening a kitchen knife</h1><p>A dull knife is more dangerous than a sharp one, because it slips. Most people never sharpen theirs.</p>
        <p>Soak the stone for ten minutes. Hold the blade at about fifteen degrees &mdash; a coin under the spine helps.</p><h2>Finishing</h2><p>Move to the fine side. Ten strokes on each face are enough.</p></div>
        <div class=c4><p>&copy; 2021 Someone</p><a href=/imprint>Imprint</a></div></div></body></html>""",
        ["Sharpening a kitchen knife", "A dull knife is more dangerous than a sharp one, because it slips. Most people never sharpen theirs.", "Soak the stone for ten minutes. Hold the blade at about fifteen degrees — a coin under the spine helps.", "Finishing", "Move to the fine side. Ten strokes on each face are enough."],
    ),
    "news with teaser column and figure": (
        """<body><header role=banner><a href=/><img alt=Logo></a><nav aria-label=Main><ul><li><a href=/w>World</a><li><a href=/s>Sport</a></ul></nav></header><main id=main-content><article class=story>
        <h1>Harbour bridge reopens after repairs</h1><p class=lead>Traffic returned to the bridge on Monday, three weeks earlier than planned.</p><figure><img src=x><figcaption>The bridge on Monday morning.</figcaption></figure>
        <p>Engineers had found cracks in two of the main girders during a routine inspection in spring.</p><aside class=related-links><h3>More on this</h3><a href=/1>Bridge closed</a></aside><p>The repairs cost 4.2 million, a city spokesperson said.</p></article></main>
        <aside class=teasers><h2>Most read</h2><ol><li><a href=/a>Storm warning for the coast</a><li><a href=/b>New ferry line planned</a></ol></aside><footer><p>Contact the newsroom</p></footer>""",
        ["Harbour bridge reopens after repairs", "Traffic returned to the bridge on Monday, three weeks earlier than planned.", "The bridge on Monday morning.", "Engineers had found cracks in two of the main girders during a routine inspection in spring.", "The repairs cost 4.2 million, a city spokesperson said."],
    ),
    "documentation page": (
        """<div id=sidebar-toc class=toc-nav><ul><li><a href=#i>Install</a><li><a href=#u>Usage</a></ul></div><div id=docs-content class=markdown-body><h1>Install</h1><p>Run the command below. It needs no rights.</p><pre><code>tool install --all</code></pre>
        <h2>Usage</h2><ul><li>Start the server.</li><li>Open the page in a browser.</li></ul><table><tr><th>Flag</th><th>Meaning</th></tr><tr><td>-v</td><td>Say more.</td></tr></table></div><div class=footer-links><a href=/e>Edit this page</a></div>""",
        ["Install", "Run the command below. It needs no rights.", "tool install --all", "Usage", "Start the server.", "Open the page in a browser.", "Flag", "Meaning", "-v", "Say more."],
    ),
    "comments as articles": (
        """<main><article><h1>Why the lake froze late</h1><p>The first weeks of winter were warm, and the lake kept its heat until February.</p><p>Records of the last century show only four later dates.</p></article>
        <section id=comments class=comments-area><h2>2 replies</h2><article class=comment><p>Great piece. I remember the winter of 1989, when we skated in April.</p></article><article class=comment><p>Thank you for the numbers.</p></article></section></main>""",
        ["Why the lake froze late", "The first weeks of winter were warm, and the lake kept its heat until February.", "Records of the last century show only four later dates."],
    ),
    "navigation in paragraphs": (
        """<div class=topnav><p><a href=/a>News</a> | <a href=/b>Culture</a> | <a href=/c>Archive</a></p></div><div class=article-text><p>The old theatre opens again in autumn. Its first play is a comedy from 1912.</p><p>Tickets are on sale from Friday on.</p></div>
        <div class=bottomnav><p><a href=/p>Previous</a> <a href=/n>Next</a></p></div>""",
        ["The old theatre opens again in autumn. Its first play is a comedy from 1912.", "Tickets are on sale from Friday on."],
    ),
    "cookie dialog and newsletter around": (
        """<div id=cookie-consent-banner role=dialog><p>We and our partners store cookies. You can refuse.</p><button>Accept</button></div><div class=page-wrapper><div class=post><h2>Baking with rye</h2><p>Rye dough is sticky and does not like long kneading.</p>
        <div class=newsletter-box><p>Get one recipe a week. Leave your address.</p><form><input><button>Subscribe</button></form></div><p>Let it rest over night in a cool place, then bake it hot.</p></div></div><div class=share-buttons><a href=x>Share</a> <a href=y>Tweet</a></div>""",
        ["Baking with rye", "Rye dough is sticky and does not like long kneading.", "Let it rest over night in a cool place, then bake it hot."],
    ),
    "inline drawings and formulas": (
        """<article><h1>Starting the pump</h1><p>Press the <svg viewBox="0 0 1 1"><path d=x></path></svg> button to start it.</p><p>The flow is <math><mi>q</mi><mo>=</mo><mi>v</mi></math> at all times.</p></article><nav><a href=/>Home</a></nav>""",
        ["Starting the pump", "Press the button to start it.", "The flow is q=v at all times."],
    ),
    "old table layout": (
        """<table width=100%><tr><td class=leftmenu><a href=1>Index</a><br><a href=2>Guestbook</a></td><td class=maintext><font size=5>My trip to the mountains</font><p>We left early and reached the hut at noon. The view was clear to the sea.<p>On the way down it rained.</td></tr></table><div class=footer><font size=1>Best viewed at 800 x 600</font></div>""",
        ["My trip to the mountains", "We left early and reached the hut at noon. The view was clear to the sea.", "On the way down it rained."],
    ),
    "advert and author box inside": (
        """<article class=entry-content><p>Solar panels on barns have become a common sight in the valley.</p><div class=ad-slot><p>Sponsored: the best inverter for your roof!</p></div><p>Farmers lease their roofs for twenty years.</p><div class=author-bio><p>About the author: Kim writes on energy.</p></div></article><footer class=site-footer>All rights reserved.</footer>""",
        ["Solar panels on barns have become a common sight in the valley.", "Farmers lease their roofs for twenty years."],
    ),
    "login form and nothing else": ("""<header><h1>Portal</h1></header><form class=login-form><label>Name</label><input><p>Forgotten your password?</p><button>Sign in</button></form><footer>Legal notice</footer>""", []),
}


def score() -> tuple[float, float, dict]:
    right = found = wanted = 0
    wrong = {}
    for name, (page, lines) in LAYOUTS.items():
        got = [x for x in H.default_model().extract(page).split("\n") if x]
        hit = sum(1 for x in got if x in lines)
        right, found, wanted = right + hit, found + len(got), wanted + len(lines)
        if got != lines:
            wrong[name] = ([x for x in got if x not in lines], [x for x in lines if x not in got])
    return right / found, right / wanted, wrong


def test_lines_of_layouts_that_were_not_trained_on():
    """What is measured: 0.97 and 0.86. The page whose classes tell nothing at all is lost, the menu in a table cell is taken."""
    precision, recall, wrong = score()
    assert precision >= 0.95 and recall >= 0.85 and set(wrong) <= {"blog without telling names", "old table layout"}, (precision, recall, wrong)


def test_hidden_inline_elements_part_no_text():
    got = H.default_model().extract(LAYOUTS["inline drawings and formulas"][0])
    assert got == "\n".join(LAYOUTS["inline drawings and formulas"][1])


@pytest.mark.parametrize("unit", ["<div>", '<a "', '<a " > "', "<p>", "<ul><li>", "<table><tr><td>", "<p>a<svg><g>", "<", "<!--", "</div>", "<div></p>", "<a '\"> ", "&amp", "<b class=", "<title>"])
def test_a_megabyte_of_hostile_markup_takes_seconds(unit):
    began = time.perf_counter()
    assert isinstance(H.default_model().extract(unit * (1_000_000 // len(unit))), str)
    assert time.perf_counter() - began < 5
