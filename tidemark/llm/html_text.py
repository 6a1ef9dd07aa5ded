"""HTML extraction with a tree-structured graphical model.

The block elements of a page are the nodes of a tree. Each is content or not;
a potential joins its label with its parent's and its tag, others with the
words of its class, id and role, with its length and how much of it is links. Sum-product
messages, once from the leaves up and once from the root down, give the exact
probability of content at every node, and the text of nodes at or above a half
is the page's main text. The potentials are counted on labelled pages.
"""

from __future__ import annotations

import bisect
import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.tables import releasing, small_batches, table

#: Fixed values of HTML: elements without an end tag, those whose text is never shown as prose, those that part blocks, and what closes an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select noembed noframes".split())
#: Of these, those that hide the rest of a page where their end tag is missing.
TO_THE_END = frozenset("script style".split())
BLOCK = frozenset(
    """html head body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul label legend""".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
#: Elements that bound the search for one to close.
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, **dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), {"table"})}
LEAVES_P_OPEN = frozenset("html head body button label legend td th caption li dd dt".split())
#: Elements that bound the search for an open paragraph.
P_BOUNDS = LEAVES_P_OPEN - {"label", "legend", "button"}
OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
INSIDE = re.compile(r"=\s*[\"']|>")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")
LABEL = re.compile(r"\bdata-content\s*=\s*\"?([01])")
#: Most labelled pages that a model is fitted on.
LABELLED_PAGES = 600


@dataclass
class Page:
    """Block elements in page order: parent, tag, attributes. Runs: owner and text of each block of text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    attributes: list[str] = field(default_factory=lambda: [""])
    runs: list[tuple[int, str]] = field(default_factory=list)
    words: list[int] = field(default_factory=lambda: [0])
    links: list[int] = field(default_factory=lambda: [0])


class Tags:
    """The tags of a page, one after the other, in time that grows with the page however its quotes and ends are missing."""

    def __init__(self, source: str):
        self.source, self.plain = source, False
        self.absent: dict[str, int] = {}  # what was sought in vain, and from where on

    def _find(self, what: str, at: int) -> int:
        if what in self.absent and at >= self.absent[what]:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.absent[what] = at
        return found

    def _end(self, at: int) -> int:
        """The > that ends a tag whose name ends at `at`: the first outside of quoted values; of a value that never ends, the first behind its quote."""
        j = at
        while not self.plain:
            m = INSIDE.search(self.source, j)
            if m and m[0] == ">":
                return m.start()
            k = self._find(m[0][-1], m.end()) if m else -1
            if k >= 0:
                j = k + 1
            elif m and (end := self._find(">", m.end())) >= 0:
                return end
            else:
                self.plain = True  # no > is left outside of quotes: from here on quotes mean nothing
        return self._find(">", at)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Of the next tag from `at` on: begin, end, whether it closes, name (empty for comments and the like) and attributes."""
        m = OPEN.search(self.source, at)
        if not m:
            return None
        if m[0] == "<!--":
            end = self._find("-->", m.end())
            return m.start(), len(self.source) if end < 0 else end + 3, False, "", ""
        if m[0][1] in "!?":
            end = self._find(">", m.end())
            return None if end < 0 else (m.start(), end + 1, False, "", "")
        name = NAME.match(self.source, m.end() - 1)
        end = self._end(name.end())
        return None if end < 0 else (m.start(), end + 1, m[0][1] == "/", name[0].lower(), self.source[name.end() : end])

    def content_end(self, tag: str, at: int) -> int:
        """Where the end tag of an element, whose content is not read, ends; -1 where there is none."""
        key = f"</{tag}"
        if key in self.absent and at >= self.absent[key]:
            return -1
        done = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(self.source, at)
        if not done:
            self.absent[key] = at
        return done.end() if done else -1


def parse(source: str) -> Page:
    page, stack, text, in_link, at = Page(), [0], [], False, 0
    open_: dict[str, list[int]] = {}  # by tag, where its open elements lie in the stack
    end, tags = len(source), Tags(source)

    def flush() -> None:
        if text and (run := " ".join("".join(text).split())):
            page.runs.append((stack[-1], run))
        text.clear()

    def put(raw: str) -> None:
        if raw:
            text.append(html.unescape(raw) if "&" in raw else raw)
            n = len(raw.split())
            page.words[stack[-1]] += n
            page.links[stack[-1]] += n * in_link

    while at < end:
        found = tags.after(at)
        if not found:
            rest = source[at:]
            put(rest[: cut.start()] if (cut := re.search(r"<[a-zA-Z/!][^<>]*\Z", rest)) else rest)
            break
        begin, upto, closing, tag, attributes = found
        put(source[at:begin])
        at = upto
        if not tag:
            continue
        if tag in RAW and not closing:
            if not attributes.endswith("/") or tag not in ("svg", "iframe"):
                done = tags.content_end(tag, at)
                at = done if done >= 0 else end if tag in TO_THE_END else at
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        elif tag not in BLOCK:
            continue
        elif closing:
            flush()
            in_link = False
            if open_.get(tag):
                _end(page, stack, open_, open_[tag][-1])
        else:
            flush()
            in_link = False
            if tag not in LEAVES_P_OPEN:
                _close(page, stack, open_, {"p"}, P_BOUNDS)
            if tag in CLOSES:
                _close(page, stack, open_, CLOSES[tag], SCOPE.get(tag, set()))
            if tag in VOID:
                continue
            page.parent.append(stack[-1])
            page.tag.append(tag)
            page.attributes.append(attributes)
            page.words.append(0)
            page.links.append(0)
            open_.setdefault(tag, []).append(len(stack))
            stack.append(len(page.tag) - 1)
    flush()
    return page


def _end(page: Page, stack: list[int], open_: dict[str, list[int]], upto: int) -> None:
    """Ends all open elements from place `upto` of the stack on."""
    while len(stack) > upto:
        open_[page.tag[stack.pop()]].pop()


def _close(page: Page, stack: list[int], open_: dict[str, list[int]], tags: set[str], bounds: Iterable[str]) -> None:
    """Ends the outermost open element of `tags` above the nearest of `bounds`, with all that is open in it."""
    if any(map(open_.get, tags)):
        bound = max((open_[t][-1] for t in bounds if t not in tags and open_.get(t)), default=0)
        above = [w[k] for t in tags if (w := open_.get(t)) and (k := bisect.bisect(w, bound)) < len(w)]
        if above:
            _end(page, stack, open_, min(above))


def _bucket(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


def observations(page: Page) -> list[list[str]]:
    """What is seen at each node."""
    words, links = page.words.copy(), page.links.copy()
    for v in range(len(page.tag) - 1, 0, -1):
        words[page.parent[v]] += words[v]
        links[page.parent[v]] += links[v]
    out = []
    for v in range(len(page.tag)):
        seen = []
        for m in NAMED.finditer(page.attributes[v]) if page.attributes[v] else ():
            seen += [f"name={p}" for p in dict.fromkeys(PART.findall((m[1] or m[2] or m[3] or "").lower()))]
        if words[v]:
            seen.append(f"size={_bucket(page.words[v], (1, 3, 8, 25))},{_bucket(words[v], (4, 20, 80))},{_bucket(100 * links[v] // words[v], (1, 30, 70))}")
        out.append(seen)
    return out


def labels(page: Page) -> list[int]:
    """Of a labelled page: data-content="1" or "0" holds for an element and what is in it, up to the next such mark."""
    out = [0]
    for v in range(1, len(page.tag)):
        m = LABEL.search(page.attributes[v])
        out.append(int(m[1]) if m else out[page.parent[v]])
    return out


@dataclass(frozen=True)
class Model:
    """edge: by tag (and "" for others) P(content | parent is not, parent is). seen: log of P(observation | content) / P(observation | not)."""

    edge: dict[str, tuple[float, float]]
    seen: dict[str, float]

    def marginals(self, page: Page) -> list[float]:
        """The probability of content at each node."""
        n = len(page.tag)
        up0, up1 = [0.5] * n, [0.5] * n
        for v, seen in enumerate(observations(page)):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(self.seen.get(x, 0.0) for x in seen)))))
            up0[v], up1[v] = 1 - p, p
        edge = [self.edge.get(t, self.edge[""]) for t in page.tag]
        to0, to1 = [0.5] * n, [0.5] * n
        for v in range(n - 1, 0, -1):
            a, b, p = up0[v], up1[v], page.parent[v]
            e0, e1 = edge[v]
            to0[v], to1[v] = (1 - e0) * a + e0 * b, (1 - e1) * a + e1 * b
            x, y = up0[p] * to0[v], up1[p] * to1[v]
            up0[p], up1[p] = x / (x + y), y / (x + y)
        down0, down1 = [1.0] * n, [0.0] * n  # the page itself is not content
        out = [0.0] * n
        for v in range(1, n):
            p = page.parent[v]
            a, b = down0[p] * up0[p] / to0[v], down1[p] * up1[p] / to1[v]
            e0, e1 = edge[v]
            down0[v], down1[v] = a * (1 - e0) + b * (1 - e1), a * e0 + b * e1
            s = down0[v] + down1[v]
            down0[v], down1[v] = down0[v] / s, down1[v] / s
            x, y = down0[v] * up0[v], down1[v] * up1[v]
            out[v] = y / (x + y)
        return out


def main_text(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parse(source)
    content = model.marginals(page)
    return "\n".join(run for owner, run in page.runs if content[owner] >= 0.5)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], int] = {}

    def add(what: str, label: int) -> None:
        found[what, label] = found.get((what, label), 0) + 1

    for batch in batches:
        for source in batch.column(0).to_pylist():
            page = parse(source or "")
            label = labels(page)
            for v, seen in enumerate(observations(page)):
                if v:
                    for tag in ("", page.tag[v]):
                        add(f"parent={label[page.parent[v]]},{tag}", label[v])
                    add("#", label[v])
                    for x in seen:
                        add(x, label[v])
    yield pa.RecordBatch.from_pydict({"what": [k[0] for k in found], "label": pa.array([k[1] for k in found], pa.int32()), "n": pa.array(list(found.values()), pa.int64())})


def fit(labelled: DataFrame, most: int = LABELLED_PAGES) -> Model:
    """Counts over at most `most` pages of `labelled` (html, with marks as for `labels`), which bounds what the driver gets."""
    counted = labelled.select("html").limit(most).mapInArrow(_counts, "what string, label int, n long").groupBy("what", "label").agg(F.sum("n").alias("n"))
    n = {(r["what"], r["label"]): r["n"] for r in counted.collect()}
    get = lambda what, label: n.get((what, label), 0)
    share = lambda p, tag, prior, weight: (get(f"parent={p},{tag}", 1) + prior * weight) / (get(f"parent={p},{tag}", 0) + get(f"parent={p},{tag}", 1) + weight)
    general = (share(0, "", 0.5, 2), share(1, "", 0.5, 2))
    edge = {tag: (share(0, tag, general[0], 4), share(1, tag, general[1], 4)) for tag in {k[0].split(",", 1)[1] for k in n if k[0].startswith("parent=")}} | {"": general}
    total = [get("#", 0) + 2, get("#", 1) + 2]
    seen = {what: math.log((get(what, 1) + 0.5) / total[1]) - math.log((get(what, 0) + 0.5) / total[0]) for what in {k[0] for k in n} if "=" in what and not what.startswith("parent=")}
    return Model(edge, seen)


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 11) -> list[str]:
    """Labelled pages for training: page plans as sites have them, filled with words of no meaning."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def some(*names: str) -> str:
        return r.choice(names)

    def list_of_links(a: int = 2, b: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    def paragraph() -> str:
        size = some((1, 2), (3, 12), (8, 40), (30, 120))
        body = words(*size)
        if r.random() < 0.2:
            body += f' <a href="/y">{words(1, 3)}</a> ' + words(2, 9)
        return some(f"<p>{body}.</p>", f"<p>{body}.</p>", f"<p>{body}.", f"<p><b>{body}<br>")

    def inner_block() -> str:
        kind = r.random()
        if kind < 0.8:
            return paragraph()
        if kind < 0.86:
            return f"<{(h := some('h2', 'h3'))}>{words(1, 8)}</{h}>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind < 0.95:
            return f"<pre>{words(3, 20)}</pre>"
        if kind < 0.97:
            return f"<figure><img src='/i'><figcaption>{words(2, 9)}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"

    def aside() -> str:
        """What may stand within an article but is none of it."""
        kind = r.randint(0, 4)
        if kind == 0:
            return f'<div data-content="0" class="{some("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")}">{words(3, 25)}</div>'
        if kind == 1:
            return f'<div data-content="0" class="{some("share", "social", "share-buttons")}">{list_of_links(1, 4)}</div>'
        if kind == 2:
            return f'<aside data-content="0"><h3>{words(1, 3)}</h3>{list_of_links()}</aside>'
        if kind == 3:
            return f'<form data-content="0" class="{some("newsletter", "subscribe", "signup")}"><label>{words(1, 4)}</label><input><button>{words(1, 2)}</button></form>'
        return f'<div data-content="0" class="{some("related", "recommended", "more")}"><h4>{words(1, 3)}</h4>{list_of_links()}</div>'

    def content() -> str:
        blocks = [f"<h1>{words(2, 12)}</h1>"] * (r.random() < 0.85) + [inner_block() for _ in range(r.randint(1, 25))]
        for _ in range(r.randint(0, 2) * (r.random() < 0.4)):
            blocks.insert(r.randint(1, len(blocks)), aside())
        body = "".join(blocks)
        where = r.random()
        if where < 0.5:
            return f'<article data-content="1">{body}</article>'
        if where < 0.65:
            return f'<main><div class="{some("content", "post", "entry")}" data-content="1">{body}</div></main>'
        if where < 0.8:
            return f'<main data-content="1">{body}</main>'
        name = some("content", "post", "entry-content", "article-body", "article", "main", "story", "text", "post-body")
        return f'<div {some("class", "id")}="{name}" data-content="1">{body}</div>'

    def comments() -> str:
        name = some("comments", "comment-list", "responses", "discussion", "reader-comments")
        each = "".join(f'<{(t := some("div", "li", "article"))} class="comment"><p>{words(1, 3)}</p><p>{words(3, 60)}</p></{t}>' for _ in range(r.randint(1, 5)))
        return f'<{(t := some("section", "div", "ol"))} {some("class", "id")}="{name}">{each}</{t}>'

    def before() -> str:
        return some(
            f"<nav>{list_of_links()}</nav>", f"<header><div>{words(1, 4)}</div><nav>{list_of_links()}</nav></header>", f'<div class="{some("menu", "nav", "navbar", "top", "header")}">{list_of_links()}</div>',
            f'<div class="{some("ad", "ads", "advert", "sponsored", "banner")}">{words(3, 30)}</div>', f'<div class="{some("cookie", "cookie-notice", "notice", "consent", "alert")}"><p>{words(5, 30)}</p><button>{words(1, 1)}</button></div>',
            f'<div class="{some("breadcrumb", "breadcrumbs")}">{list_of_links(1, 4)}</div>', f'<header><p>{words(2, 10)}</p></header>', f"<form><input><button>{words(1, 1)}</button></form>",
        )

    def after() -> str:
        return some(
            f"<aside><h3>{words(1, 3)}</h3><p>{words(4, 30)}</p>{list_of_links()}</aside>", f'<div class="{some("sidebar", "side", "widget", "related", "rail")}"><h3>{words(1, 3)}</h3>{list_of_links()}<p>{words(2, 25)}</p></div>',
            comments(), comments(), f'<form class="{some("newsletter", "search", "login", "contact")}"><p>{words(2, 15)}</p><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>',
            f'<div class="{some("ad", "ads", "advert", "sponsored", "promo")}"><p>{words(3, 30)}</p></div>',
        )

    def page() -> str:
        foot = some(f"<footer>&copy; {words(3, 20)}</footer>", f"<footer><p>{words(3, 20)}</p>{list_of_links()}</footer>", f'<div class="{some("footer", "bottom", "copyright", "legal")}"><p>{words(3, 25)}</p></div>')
        top = "".join(before() for _ in range(r.randint(0, 4)))
        rest = "".join(after() for _ in range(r.randint(0, 3)))
        inside = r.random() < 0.3
        wrap = f'<div class="{some("page", "wrapper", "container", "layout", "site")}">' if inside else ""
        return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{wrap}{top}{content()}{rest}{foot}{'</div>' * inside}</body></html>"

    return [page() for _ in range(n)]


def default_model(spark: SparkSession) -> Model:
    return fit(spark.createDataFrame([(p,) for p in labelled_pages()], "html string"))


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model.value) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of `pages` (page_id, url, html).

    text: the content blocks in page order, joined by line ends; white space
    within a block is one space, character references are decoded. Empty for a
    null or empty page and where nothing is content. Broken markup is read as
    far as it goes. Other columns are ignored; repeated rows each come back.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or default_model(spark))
    return pages.select("page_id", "url", "html").mapInArrow(releasing(_extract(shared)), "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of pages; null and empty pages have an empty text, repeated rows the same."""
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_text": op10_html_text}
ORACLE: dict[str, str] = {}
