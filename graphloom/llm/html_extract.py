"""Main text of web pages by a tree-structured graphical model.

A page's blocks form a tree: elements that break lines, and the runs of text between their edges.
Every node is content or not. A node's own potential comes from what can be seen of it (its tag, the
words of its class, id and role, its length, its share of linked text), an edge's potential from how
often a child is content given its parent. Messages pass up the tree and down again, and the product
of what reaches a node is its exact marginal; text runs with a marginal of one half or more are the
main text. All potentials are counted on labelled pages (``training_pages``).
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

# Fixed values of HTML: void elements, elements whose text is not shown, elements that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe svg canvas audio video select option datalist textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul label legend".split()
)
#: What an opening tag closes: the outermost open element of these that no element of the others parts from it.
CLOSING = [(frozenset(a.split()), frozenset(b.split())) for a, b in (("p", "button td th caption html"), ("li", "ul ol menu"), ("dt dd", "dl"), ("tr td th", "table"), ("td th", "tr table"))]
MATTER = frozenset().union(*(a | b for a, b in CLOSING))
CLOSES = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4}
ENDS_P = BLOCK - {"html", "body", "button", "label", "legend"}
#: Words of class, id and role that tell something; compared as the start of a word's parts.
HINTS = tuple(
    "nav menu breadcrumb head masthead banner logo foot copyright legal side aside widget ad ads advert sponsor promo cookie consent notice alert gdpr popup modal "
    "overlay subscribe newsletter signup login search form share social follow related recommend more tag meta author byline date comment disqus reply respond discussion thread "
    "article content post entry story main body text blog prose page wrapper container".split()
)
HINT = {h: i for i, h in enumerate(HINTS)}
NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: The rest of a tag up to its end, which is no angle bracket inside of quotes.
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
GROUPS = {t: g for g, ts in {"list": "ul ol dl menu dir", "item": "li dt dd", "head": "h1 h2 h3 h4 h5 h6 hgroup", "quote": "blockquote pre figure figcaption details summary", "cell": "td th caption", "row": "tr thead tbody tfoot", "field": "form fieldset label legend button", "top": "html body"}.items() for t in ts.split()}
TEXT = "#text"
#: Length, links and stops of a run depend on each other and on its neighbours; they count for so much.
TEXT_WEIGHT = 0.3
#: Tags that are used alike inside and outside of content: they lean on their parents.
PLAIN = frozenset("p ul ol dl dir li dt dd h1 h2 h3 h4 h5 h6 hgroup table thead tbody tfoot tr td th caption blockquote pre figure figcaption center".split())


class Node:
    __slots__ = ("parent", "tag", "hints", "text", "linked", "label")

    def __init__(self, parent: int, tag: str, hints: tuple[str, ...] = (), label: int | None = None):
        self.parent, self.tag, self.hints, self.label = parent, tag, hints, label
        self.text, self.linked = "", 0


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    found, hidden = set(), False
    for name, *values in NAMES.findall(raw):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name != "style":
            for part in PARTS.findall(value):
                p = part.lower()
                if p in HINT:
                    found.add(p)
                elif len(p) > 3:
                    found.update(h for h in HINTS if len(h) > 3 and p.startswith(h))
                    found.update(h for h in HINTS if len(h) > 4 and p.endswith(h))
    return tuple(sorted(found)), hidden


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, whether closing, attributes) of every tag, comment and declaration (these with an empty name).

    Goes forward only. A tag whose quotes never end ends at its first angle bracket, and so do all
    tags after it; without any such bracket the rest is text, as a comment without end is a comment to the end.
    """
    at, end, loose = 0, len(source), False
    while True:
        begin = source.find("<", at)
        if begin < 0:
            return
        if source.startswith("<!--", begin):
            short = source.startswith(("<!-->", "<!--->"), begin)
            stop = source.find("-->", begin + 2 if short else begin + 4)
            at = end if stop < 0 else stop + 3
            yield begin, at, "", False, ""
            continue
        closing = source.startswith("/", begin + 1)
        name = NAME.match(source, begin + 1 + closing)
        if name is None and not source.startswith(("!", "?", "/"), begin + 1):
            at = begin + 1
            continue
        after = name.end() if name else begin + 2
        whole = None if loose or name is None else REST.match(source, after)
        loose = loose or (name is not None and whole is None)
        stop = whole.end() - 1 if whole else source.find(">", after)
        if stop < 0:
            return
        at = stop + 1
        yield begin, at, name[0].lower() if name else "", closing, source[after:stop]
        if name and not closing and name[0].lower() in RAW:
            # Its text ends at its own closing tag, whatever stands in it.
            inside = re.compile(f"</{name[0]}(?=[\\s/>])", re.I).search(source, at)
            last = end if inside is None else (source.find(">", inside.end()) + 1 or end)
            yield at, last, "", False, ""
            at = last


def parse(source: str, labels: bool = False) -> list[Node]:
    """The tree in document order; a text run is a child of the element that holds it.

    Inline tags part no text, those that hide what they hold included. With ``labels`` an attribute
    data-content="1" or "0" labels what it holds. Time and memory grow with the page's length.
    """
    nodes = [Node(-1, "html")]
    # Open elements that matter: (tag, node, for each of CLOSING the place of the outermost element that would be closed, -1 if none).
    stack: list[tuple[str, int, tuple[int, ...]]] = [("html", 0, (-1,) * len(CLOSING))]
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked, in_link = 0, False
    hidden_at = 0  # depth of the outermost hidden element, 0 if none

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                me = stack[-1][1]
                leaf = Node(me, TEXT, label=nodes[me].label)
                leaf.text, leaf.linked = text, min(len(text), linked)
                nodes.append(leaf)
        linked = 0

    def add(data: str) -> None:
        nonlocal linked
        if data and not hidden_at:
            run.append(data)
            linked += len(data) if in_link else 0

    def push(tag: str, node: int) -> None:
        before, here = stack[-1][2], len(stack)
        stack.append((tag, node, before if tag not in MATTER else tuple(-1 if tag in stops else here if x < 0 and tag in shuts else x for x, (shuts, stops) in zip(before, CLOSING, strict=True))))
        opened[tag] += 1

    def close(to: int) -> None:
        nonlocal hidden_at
        if any(stack[i][0] in BLOCK for i in range(to, len(stack))):
            flush()
        while len(stack) > to:
            opened[stack.pop()[0]] -= 1
        if hidden_at and len(stack) < hidden_at:
            hidden_at = 0

    at = 0
    for begin, end, tag, closing, attributes in tags(source):
        add(source[at:begin])
        at = end
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            add(" ")
        elif tag not in BLOCK and tag not in HIDDEN:
            if tag in ("img", "input") and not closing:
                add(" ")
        elif closing:
            if tag in ("html", "body"):
                flush()
            elif opened[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            elif tag == "p":
                flush()
        elif tag in RAW:
            pass
        elif tag in HIDDEN:
            if not attributes.rstrip().endswith("/"):
                push(tag, stack[-1][1])
                hidden_at = hidden_at or len(stack)
        else:
            if tag == "body" and opened["head"]:
                close(next(i for i, x in enumerate(stack) if x[0] == "head"))
            if tag in ENDS_P and stack[-1][2][0] > 0:
                close(stack[-1][2][0])
            if tag in CLOSES and stack[-1][2][CLOSES[tag]] > 0:
                close(stack[-1][2][CLOSES[tag]])
            flush()
            if tag == "hr":
                continue
            if hidden_at:
                push(tag, stack[-1][1])
                continue
            hints, hidden = _attributes(attributes) if attributes else ((), False)
            label = nodes[stack[-1][1]].label
            if labels and (mark := re.search(r'data-content="([01])"', attributes)):
                label = int(mark[1])
            nodes.append(Node(stack[-1][1], tag, hints, label=label))
            push(tag, len(nodes) - 1)
            if hidden:
                hidden_at = len(stack)
    add(source[at:])
    flush()
    return nodes


def _bucket(n: int) -> int:
    return 0 if n < 3 else 1 if n < 8 else 2 if n < 20 else 3 if n < 60 else 4


def features(node: Node) -> list[str]:
    if node.tag == TEXT:
        words = node.text.count(" ") + 1
        share = node.linked / len(node.text)
        return [f"len{_bucket(words)}", f"link{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}", f"stop{node.text[-1] in '.!?。！？:;\"”'}"]
    own = [f"hint {h}" for h in node.hints]
    return own if node.tag in PLAIN else [f"tag {GROUPS.get(node.tag, node.tag)}", *own]


def kind(node: Node) -> str:
    """Which potential the edge to the node's parent has."""
    return "text" if node.tag == TEXT else "plain" if node.tag in PLAIN else "container"


class Model:
    """Potentials, and the two passes of messages."""

    def __init__(self, node: dict[str, float], edge: dict[str, tuple[tuple[float, float], tuple[float, float]]], root: tuple[float, float]):
        self.node, self.edge, self.root = node, edge, root

    def marginals(self, nodes: list[Node]) -> list[float]:
        """For each node the probability of content."""
        n = len(nodes)
        own = [(1.0, 1.0)] * n
        get = self.node.get
        for i, x in enumerate(nodes):
            odds = max(-30.0, min(30.0, sum(get(f, 0.0) for f in features(x)) * (TEXT_WEIGHT if x.tag == TEXT else 1.0)))
            p = 1 / (1 + math.exp(-odds))
            own[i] = (1 - p, p)
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        inside = own[:]
        for i in range(n - 1, 0, -1):  # children come after their parents
            (a, b), (c, d) = self.edge[kind(nodes[i])]
            x, y = inside[i]
            s, t = a * x + b * y, c * x + d * y
            up[i] = (s / (s + t), t / (s + t))
            p = nodes[i].parent
            x, y = inside[p][0] * up[i][0], inside[p][1] * up[i][1]
            inside[p] = (x / (x + y), y / (x + y)) if x + y > 0 else (0.5, 0.5)
        out = [0.0] * n
        x, y = inside[0][0] * self.root[0], inside[0][1] * self.root[1]
        out[0] = y / (x + y)
        # Down the tree: every parent is final before its children; what came up from a child is taken out.
        for i in range(1, n):
            p = nodes[i].parent
            a0 = out[p]
            u = up[i]
            x, y = (1 - a0) / max(u[0], 1e-300), a0 / max(u[1], 1e-300)
            (a, b), (c, d) = self.edge[kind(nodes[i])]
            s, t = a * x + c * y, b * x + d * y
            x, y = inside[i][0] * s, inside[i][1] * t
            out[i] = y / (x + y) if x + y > 0 else 0.5
        return out

    def extract(self, source: str) -> str:
        nodes = parse(source)
        return "\n".join(x.text for x, p in zip(nodes, self.marginals(nodes), strict=True) if x.tag == TEXT and p >= 0.5)


def fit(pages: Iterable[str], smooth: float = 0.5) -> Model:
    """Counts potentials on pages whose elements carry data-content labels.

    An element without text is not counted; one with text is content if any of its text is.
    """
    seen = [Counter(), Counter()]
    total = [0, 0]
    edges = {k: [[smooth, smooth], [smooth, smooth]] for k in ("text", "plain", "container")}
    for page in pages:
        nodes = parse(page, labels=True)
        chars = [[0, 0] for _ in nodes]
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].tag == TEXT:
                chars[i][nodes[i].label or 0] += len(nodes[i].text)
            if nodes[i].parent >= 0:
                for s in (0, 1):
                    chars[nodes[i].parent][s] += chars[i][s]
        for i, x in enumerate(nodes):
            if sum(chars[i]):
                s = int(chars[i][1] > 0)
                total[s] += 1
                seen[s].update(features(x))
                if x.parent >= 0:
                    q = int(chars[x.parent][1] > 0)
                    edges[kind(x)][q][s] += 1
    names = {*seen[0], *seen[1]}
    node = {f: math.log((seen[1][f] + smooth) / (total[1] + 2 * smooth)) - math.log((seen[0][f] + smooth) / (total[0] + 2 * smooth)) for f in names}
    edge = {k: tuple((r[0] / sum(r), r[1] / sum(r)) for r in rows) for k, rows in edges.items()}
    return Model(node, edge, (0.5, 0.5))


def training_pages(n: int = 600, seed: int = 5) -> Iterator[str]:
    """Labelled pages: layouts with and without telling tags, their parts marked with data-content."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("bcdfglmnprstv") + pick("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + pick("...!?") + ""
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'
    no, yes = ' data-content="0"', ' data-content="1"'

    def named(*options: str) -> str:
        c = pick(options)
        return pick((f' class="{c}"', f' id="{c}"', f' class="{word()} {c}"', f' class="{c}-{word()}"'))

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        tag = pick(("nav", "nav", "div", "ul"))
        return f"<{tag}{named('nav', 'menu', 'navbar', 'breadcrumb') if tag != 'nav' or rng.random() < 0.5 else ''}{no}>" + (items if tag == "ul" else f"<ul>{items}</ul>") + f"</{tag}>"

    def header() -> str:
        tag = pick(("header", "div"))
        return f"<{tag}{named('header', 'masthead', 'banner', 'logo') if tag == 'div' else ''}{no}>{pick((words(1, 4), f'<h1>{words(1, 3)}</h1>', f'<p>{prose(1, 1)}</p>'))}{link()}</{tag}>"

    def footer() -> str:
        tag = pick(("footer", "footer", "div"))
        return f"<{tag}{named('footer', 'copyright', 'legal') if tag == 'div' else ''}{no}>{pick(('&copy; ', '', '(c) 2020 '))}{words(1, 3)} {pick((prose(1, 1), link(), '<p>' + prose(1, 2) + '</p>'))}</{tag}>"

    def aside() -> str:
        tag = pick(("aside", "aside", "div"))
        body = pick((f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li>{link(2, 6)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<p>{prose(1, 4)}</p>", prose(1, 2)))
        return f"<{tag}{named('sidebar', 'side', 'widget', 'related', 'recommended', 'tags') if tag == 'div' else ''}{no}>{body}</{tag}>"

    def advert() -> str:
        return f"<div{named('ad', 'ads', 'advert', 'sponsor', 'promo')}{no}>{pick((prose(1, 2), '<p>' + prose(1, 3) + '</p>', link(3, 6)))}</div>"

    def notice() -> str:
        tag = pick(("div", "div", "section", "dialog"))
        return f"<{tag}{named('cookie', 'consent', 'notice', 'alert', 'popup', 'gdpr', 'newsletter', 'modal')}{no}>{pick((prose(1, 3), '<p>' + prose(1, 3) + '</p>'))}{pick(('', '<button>' + word() + '</button>'))}</{tag}>"

    def form() -> str:
        return f"<form{pick(('', named('search', 'login', 'signup', 'subscribe')))}{no}>{pick(('<label>' + words(1, 3) + '</label><input>', '<p>' + prose(1, 2) + '</p><input><button>' + word() + '</button>', '<h3>' + words(1, 4) + '</h3><input>'))}</form>"

    def social() -> str:
        return f"<div{named('share', 'social', 'follow')}{no}>{' '.join(link(1, 1) for _ in range(rng.randint(2, 4)))}</div>"

    def comments() -> str:
        tag, each = pick(("section", "div", "ol", "ul")), pick(("div", "div", "div", "div", "article", "li"))
        each = "li" if tag in ("ol", "ul") else each
        body = "".join(f"<{each}{named('comment', 'reply', 'comment-body')}><p>{prose(1, 5)}</p></{each}>" for _ in range(rng.randint(1, 6)))
        return f"<{tag}{named('comments', 'commentlist', 'disqus', 'discussion', 'respond', 'replies')}{no}>{pick(('', f'<h3>{words(1, 3)}</h3>')) if tag in ('section', 'div') else ''}{body}</{tag}>"

    def article(inner: list[str]) -> str:
        parts = [f"<h1>{words(2, 9)}{pick(('', '.'))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.72:
                text = prose(1, 7)
                if rng.random() < 0.25:
                    text = f"{pick(('<b>', '<i>', '<span>'))}{text} {link()} {sentence()}"
                parts.append(f"<p>{text}{pick(('</p>', '</p>', ''))}")
            elif kind < 0.8:
                parts.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{pick((prose(1, 2), words(1, 6)))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{pick((prose(1, 2), '<p>' + prose(1, 2) + '</p>'))}</blockquote>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<pre>{words(2, 20)}</pre>")
        for x in inner:
            parts.insert(rng.randint(0, len(parts)), x)
        tag = pick(("article", "article", "main", "div", "div", "section"))
        name = "" if tag in ("article", "main") and rng.random() < 0.6 else named("article", "content", "post", "entry", "story", "main", "article-body", "post-content", "text")
        whole = f"<{tag}{name}{yes}>{''.join(parts)}</{tag}>"
        for _ in range(rng.randint(0, 2)):
            tag = pick(("div", "main", "section"))
            whole = f"<{tag}{pick(('', named('page', 'wrapper', 'container', 'main', 'content')))}>{whole}</{tag}>"
        return whole

    around = (menu, header, footer, aside, advert, notice, form, social, comments)
    for _ in range(n):
        before = [pick((menu, header, advert, notice, form))() for _ in range(rng.randint(0, 4))]
        after = [pick(around)() for _ in range(rng.randint(0, 5))]
        inner = [pick((advert, aside, social, form, notice, comments))() for _ in range(rng.choice((0, 0, 0, 1, 2)))]
        yield f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{article(inner)}{''.join(after)}</body></html>"


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(training_pages())


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """The kept columns, text and n_chars for every row of ``pages``.

    A null or empty page has empty text, and so has one without content. Rows do not move; pages are
    read whole. The model is small and travels with the task. Where a kept column has the name text or
    n_chars, the new one has an underscore before it.
    """
    small_batches(pages)
    made = model or default_model()
    made_names = [fresh(x, list(keep)) for x in ("text", "n_chars")]
    names = [*keep, *made_names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [made.extract(x.as_py() or "") for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    rows = pages.select(F.col(html_col).alias("html"), *(F.col(c) for c in keep))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), f"`{made_names[0]}` string, `{made_names[1]}` long"])
    return rows.mapInArrow(run, ddl)
