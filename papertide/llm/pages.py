"""Main text of web pages by a tree-structured graphical model.

Block elements of the DOM are nodes with a hidden label (content or not). A node's tag, class words and
text shape are emitted by its label, a child's label depends on its parent's. Sum-product
messages, once up and once down the tree, give each node's marginal; blocks of text whose node is
content with probability 0.5 or more are the main text. The tables of the model are counted from
labelled pages.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import map_batches

#: Pages that a fit reads at most: those of the least id hash.
FIT_PAGES = 400
# Elements that bound blocks of text, elements without content, elements whose content is no text.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object textarea title svg math audio video canvas".split())
#: An open element of the second kind ends where the first one starts.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Markup stops at the next "<" outside of comments, so broken pages cost no more than their length.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Page:
    """Nodes in document order: parent, features, own label if given; blocks of text as (node, text)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: ["root"])
    names: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    hidden: list[bool] = field(default_factory=lambda: [False])
    given: list[str | None] = field(default_factory=lambda: [None])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def inner(self) -> list[bool]:
        """Whether a node has nodes inside."""
        out = [False] * len(self.parent)
        for p in self.parent[1:]:
            out[p] = True
        return out


def parse(source: str | None) -> Page:
    """DOM of block elements; inline markup only shapes its block (length of link text)."""
    source = source or ""
    page = Page()
    node, at, pieces, linked, links = 0, 0, [], 0, 0
    opened: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if pieces and (text := " ".join(html.unescape("".join(pieces)).split())):
            page.blocks.append((node, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text.strip())

    while m := _TAG.search(source, at):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCKS:
                if opened.get(tag):
                    flush()
                    while page.tags[node] != tag:
                        opened[page.tags[node]] -= 1
                        node = page.parent[node]
                    opened[tag] -= 1
                    node = page.parent[node]
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in _BLOCKS:
            flush()
            links = 0
            if page.tags[node] == "p":
                opened["p"] -= 1
                node = page.parent[node]
            while tag in _ENDS and page.tags[node] in _ENDS[tag]:
                opened[page.tags[node]] -= 1
                node = page.parent[node]
            if tag in _VOID:
                continue
            opened[tag] = opened.get(tag, 0) + 1
            attrs = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(m[3] or m[6] or "")}
            words = " ".join(attrs.get(k, "") for k in ("class", "id", "role", "itemprop"))
            page.parent.append(node)
            page.tags.append(tag)
            page.names.append(frozenset(w.lower() for w in _NAME_WORD.findall(words)))
            page.hidden.append("hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""))))
            page.given.append(attrs.get("data-y"))
            node = len(page.parent) - 1
    if at < len(source):
        add(source[at:])
    flush()
    return page


def features(page: Page) -> list[list[str]]:
    """What each node shows: tag, class words, and shape of its own and its whole text."""
    n = len(page.parent)
    own, own_links, total, total_links, sentence = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i, text, link in page.blocks:
        own[i] += len(text)
        own_links[i] += link
        sentence[i] = sentence[i] or text[-1] in ".!?"
    for i in range(n - 1, -1, -1):
        total[i] += own[i]
        total_links[i] += own_links[i]
        if i:
            total[page.parent[i]] += total[i]
            total_links[page.parent[i]] += total_links[i]
    out = []
    for i in range(n):
        f = [f"tag {page.tags[i]}", *(f"name {w}" for w in page.names[i])]
        if total[i]:
            f.append(f"links {min(3, 4 * total_links[i] // total[i])}")
        if own[i]:
            f += [f"own {min(5, own[i].bit_length() // 2)}", f"sentence {sentence[i]}"]
        out.append(f)
    return out


#: Labels of a node: no content, content, and around content (its own text is none).
OTHER, CONTENT, AROUND = 0, 1, 2
Triple = tuple[float, float, float]


@dataclass
class TreeModel:
    """Potentials: logs for a feature under each label; for a child's label under its parent's,
    apart for leaves and for elements with block elements inside."""

    emit: dict[str, Triple]
    child: dict[bool, tuple[Triple, Triple, Triple]]
    root: Triple = (0.3, 0.1, 0.6)

    @classmethod
    def counted(cls, counts: Counter) -> TreeModel:
        """From counts of ('f', feature, label), ('leaf' or 'inner', parent's label, label) and ('n', '', label)."""
        nodes = [counts["n", "", y] + 1.0 for y in range(3)]
        # features of shape overlap with each other and with the tag, so they weigh half
        power = lambda f: 1.0 if f.startswith(("tag ", "name ")) else 0.5
        emit = {f: tuple(power(f) * math.log((counts["f", f, y] + 0.5) / (nodes[y] + 1)) for y in range(3)) for k, f, _ in counts if k == "f"}
        child = {
            kind == "inner": tuple(tuple((counts[kind, str(p), y] + 0.01) / (sum(counts[kind, str(p), x] for x in range(3)) + 0.03) for y in range(3)) for p in range(3))
            for kind in ("leaf", "inner")
        }
        return cls(emit, child)

    def marginals(self, page: Page) -> list[float]:
        """Probability that each node is content: messages from the leaves up, then from the root down."""
        n, inner, exp = len(page.parent), page.inner(), math.exp
        belief = []
        for i, found in enumerate(features(page)):
            a = b = c = 0.0
            for f in found:
                if (e := self.emit.get(f)) is not None:
                    a += e[0]
                    b += e[1]
                    c += e[2]
            if page.hidden[i]:
                b -= 50.0
                c -= 50.0
            top = max(a, b, c)
            belief.append([exp(max(a - top, -300)), exp(max(b - top, -300)), exp(max(c - top, -300))])
        belief[0] = [x * y for x, y in zip(belief[0], self.root, strict=True)]
        up: list[Triple] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b, c = belief[i]
            p, q, r = self.child[inner[i]]
            m = up[i] = (p[0] * a + p[1] * b + p[2] * c, q[0] * a + q[1] * b + q[2] * c, r[0] * a + r[1] * b + r[2] * c)
            parent = belief[page.parent[i]]
            x, y, z = parent[0] * m[0], parent[1] * m[1], parent[2] * m[2]
            top = max(x, y, z)
            parent[:] = max(x / top, 1e-200), max(y / top, 1e-200), max(z / top, 1e-200)
        out = [0.0] * n
        for i in range(n):
            own = belief[i]
            if i:
                parent, m = belief[page.parent[i]], up[i]
                a, b, c = parent[0] / m[0], parent[1] / m[1], parent[2] / m[2]
                p, q, r = self.child[inner[i]]
                top = max(a, b, c)
                a, b, c = a / top, b / top, c / top
                x, y, z = (own[k] * (a * p[k] + b * q[k] + c * r[k]) for k in range(3))
                top = max(x, y, z)
                own[:] = max(x / top, 1e-200), max(y / top, 1e-200), max(z / top, 1e-200)
            out[i] = own[CONTENT] / (own[0] + own[1] + own[2])
        return out

    def main_text(self, source: str | None) -> str:
        page = parse(source)
        likely = self.marginals(page)
        return "\n".join(text for i, text, _ in page.blocks if likely[i] >= 0.5)


# Element and class names by role, used to label training pages.
_CONTENT_WRAPS = (
    '<article>{}</article>', '<main>{}</main>', '<main><article class="post">{}</article></main>', '<div class="post-content">{}</div>', '<div class="entry-content" itemprop="articleBody">{}</div>',
    '<div id="content" class="article-body">{}</div>', '<section class="story-body">{}</section>', '<div class="main-text">{}</div>', '<article><div class="text">{}</div></article>',
)
_OTHER_BEFORE = (
    "<nav><ul>{links}</ul></nav>", '<header class="site-header"><div class="logo">{a}</div><nav>{links}</nav></header>', '<header>{p}</header>', '<header><h1>{s}</h1>{p}</header>', '<div class="header"><h2>{s}</h2></div>', '<div class="menu navbar"><ul>{links}</ul></div>', '<div class="ad">{a}</div>',
    '<div class="cookie-notice" role="dialog"><p>{a}</p><button>{s}</button></div>', '<div class="breadcrumbs">{links}</div>', '<div class="banner promo">{p}</div>', '<div id="consent" class="notice">{a}</div>', '<div class="advert sponsored">{p}</div>',
)
_OTHER_AFTER = (
    "<footer>{a}</footer>", '<footer class="site-footer"><p>{a}</p><ul>{links}</ul></footer>', '<aside>{p}</aside>', '<aside class="sidebar"><h3>{s}</h3><ul>{links}</ul>{p}</aside>', '<div class="sidebar widget">{p}{p}</div>',
    '<section class="comments" id="comments"><h2>{s}</h2><div class="comment">{p}</div><div class="comment"><p>{a}</p></div></section>', '<div class="comment-list"><ol><li class="comment">{p}</li></ol></div>', '<ul class="comments"><li>{a}</li><li>{a}</li></ul>',
    '<form class="newsletter signup"><label>{s}</label><input><button>{s}</button></form>', '<form><p>{a}</p><select><option>{s}</option></select></form>', '<div class="related-posts"><h3>{s}</h3><ul>{links}</ul></div>',
    '<div class="share social">{links}</div>', '<div class="copyright">{a}</div>', '<div class="ads">{p}</div>', '<div class="popup modal">{p}</div>', '<div class="reader-comments">{p}{p}</div>',
)
_OUTER = ("{}", "{}", '<div class="wrapper">{}</div>', '<div id="page" class="container"><div class="row">{}</div></div>')
_INSIDE = ("", "", '<aside data-y="0">{p}</aside>', '<div data-y="0" class="ad">{a}</div>', '<figure><figcaption>{a}</figcaption></figure>', '<div data-y="0" class="related">{links}</div>', '<form data-y="0"><label>{s}</label></form>', '<nav data-y="0">{links}</nav>')


def labelled_pages(texts: list[str], seed: int) -> Iterator[str]:
    """Pages around given paragraphs whose elements carry their label in ``data-y``."""
    if not texts:
        return
    salt = 0

    def pick(options):
        nonlocal salt
        salt += 1
        return options[zlib.crc32(f"{seed} {salt}".encode()) % len(options)]

    def fill(pattern: str) -> str:
        def one(m: re.Match) -> str:
            text = html.escape(pick(texts))
            head = " ".join(text.split()[: 2 + salt % 9])
            return {"p": f"<p>{text}</p>", "a": head, "s": " ".join(head.split()[:2]), "links": "".join(f'<li><a href="#">{html.escape(" ".join(pick(texts).split()[:2]))}</a></li>' for _ in range(4))}[m[1]]

        return re.sub(r"\{(p|a|s|links)\}", one, pattern)

    for _ in range(3):
        body = "".join(fill("<p>{p}</p>").replace("<p><p>", "<p>").replace("</p></p>", "</p>") for _ in range(1 + salt % 6))
        heading = fill("<h1>{a}</h1>") if pick((0, 1, 1)) else fill("<h2>{a}</h2>")
        inner = pick((fill("<ul><li>{a}</li><li>{a}</li></ul>"), fill("<blockquote>{p}</blockquote>"), fill("<h2>{s}</h2>{p}"), fill("<table><tr><td>{s}</td><td>{a}</td></tr></table>"), "", ""))
        content = re.sub(r"^<(\w+)", r'<\1 data-y="1"', pick(_CONTENT_WRAPS).format(heading + body + inner + fill(pick(_INSIDE))))
        whole = "".join(fill(pick(_OTHER_BEFORE)) for _ in range(1 + salt % 3)) + content + "".join(fill(pick(_OTHER_AFTER)) for _ in range(1 + salt % 3))
        yield f"<body>{pick(_OUTER).format(whole)}</body>"


def label_counts(source: str) -> Counter:
    """Counts for a page with ``data-y`` labels (1 content); a node without one has its parent's, the
    root 0. Nodes that are no content but hold some are around it."""
    page = parse(source)
    label, counts, inner = [OTHER] * len(page.parent), Counter(), page.inner()
    for i, given in enumerate(page.given):
        label[i] = int(given) if given in ("0", "1") else label[page.parent[i]] if i else OTHER
    for i in range(len(label) - 1, 0, -1):
        if label[i] != OTHER and label[page.parent[i]] == OTHER:
            label[page.parent[i]] = AROUND
    for i, found in enumerate(features(page)):
        counts["n", "", label[i]] += 1
        counts.update(("f", f, label[i]) for f in found)
        if i:
            counts["inner" if inner[i] else "leaf", str(label[page.parent[i]]), label[i]] += 1
    return counts


def _fit_counts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    counts: Counter = Counter()
    for number, source in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True):
        texts = [text for _, text, link in parse(source).blocks if not link]
        for labelled in labelled_pages(texts, number or 0):
            counts += label_counts(labelled)
    if not counts:
        return None
    keys = list(counts)
    return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys]) for i in (0, 1)), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["kind", "name", "label", "n"])


def fit_pages(pages: DataFrame, fit_pages: int = FIT_PAGES) -> TreeModel:
    """Model from labelled pages that are built around the paragraphs of a bounded sample of ``pages``:
    no labels come with the table, so layouts of known roles are filled with its texts."""
    sample = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    counted = map_batches(sample, _fit_counts, "kind string, name string, label int, n long").groupBy("kind", "name", "label").agg(F.sum("n").alias("n"))
    return TreeModel.counted(Counter({(r["kind"], r["name"], r["label"]): r["n"] for r in counted.collect()}))


def main_texts(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text, n_chars of each row. Null and empty pages have the empty text; markup that
    never closes ends with the page; repeated rows return a row each; ids and urls may be null; other columns are ignored; an
    empty table gives an empty one."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = [own.main_text(s.as_py()) for s in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
