"""Main text of web pages by wrappers, union-free regular expressions that are inferred from the pages of a host.

A page is a stream of block tags and texts. Repeated squares of siblings fold into repeated groups. Two streams, or a
stream and a wrapper, are aligned level by level: tags that match are merged, a text that differs becomes a slot, what
only one side has becomes optional, and neighbours that the merge made alike fold again. Every page of a host goes into
its wrapper, but a task merges its own pages first, and what it passes on is as large as the template, not as the pages.
The wrapper has the sums of text and of link text of each group, from which the groups with the article are chosen
once for all pages of the host; a text that is the same on all of them is the template's and not the article's.
Each page is then matched to its host's wrapper and gives the texts in those groups.

The walks go as deep as the pages: they are plain calls, for which only Python's own limit is raised.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, read_table

#: Bytes of wrappers that may be sent to every task; beyond, pages and wrappers are joined by host.
SENT_BYTES = 64 << 20
#: Tags of a square that can fold; parts that a host's wrappers are merged in before they meet.
SQUARE, SALTS = 3, 16
#: Pages of a host from which on a text that all of them have is the template's, and the share of the chosen text that
#: must be left.
TEMPLATE_PAGES, LEAST_LEFT = 4, 0.5

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>|</?[a-zA-Z][^<>]*\Z|[^<]+|<""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = {"script", "style", "title", "noscript", "template", "iframe", "textarea", "xmp", "noembed", "noframes", "svg", "math", "select", "object", "audio", "video", "canvas"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
#: A tag of this kind ends an open one of these, within the nearest of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
FLOW = set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th blockquote pre figcaption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = set("head nav footer aside form button dialog menu".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILER = set(
    "nav navbar navigation navigations menu menus submenu topbar breadcrumb breadcrumbs crumbs masthead banner footer foot sidebar sidebars aside rail ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored "
    "sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices disclaimer popup modal overlay lightbox newsletter subscribe subscription signup signin login register social share sharing "
    "shares related recommended recommendations recirculation widget widgets comment comments commentlist disqus discussion respond reply replies form search searchbox pagination pager paging toolbar skip skiplink hidden copyright legal tags".split()
)
CONTENT = {"article", "main"}
CONTENT_CLASSES = set("articlebody article-body article-content entry-content post-content post-body story-body story-content main-content page-content content-body".split())


class Node:
    """An element: its label, whether it repeats or is optional, pages, characters, link characters and the checksum of
    its text (None for a slot, where pages differ), and its children."""

    __slots__ = ("label", "repeated", "optional", "pages", "chars", "links", "text", "kids", "into", "keep")

    def __init__(self, label: str, kids: list | None = None):
        self.label, self.kids = label, kids if kids is not None else []
        self.repeated = self.optional = False
        self.pages, self.chars, self.links, self.text, self.into, self.keep = 1, 0, 0, 0, None, None

    def final(self) -> Node:
        n = self
        while n.into is not None:
            n = n.into
        return n

    def dump(self) -> list:
        """The groups in page order, each with the number of its children."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append([n.label, int(n.repeated) | int(n.optional) << 1, n.pages, n.chars, n.links, n.text, len(n.kids)])
            stack += n.kids[::-1]
        return out


def load(x: list) -> Node:
    root, stack = None, []
    depth = 0
    for label, flags, pages, chars, links, text, kids in x:
        n = Node(label)
        n.repeated, n.optional = bool(flags & 1), bool(flags & 2)
        n.pages, n.chars, n.links, n.text = pages, chars, links, text
        if stack:
            stack[-1][0].kids.append(n)
            stack[-1][1] -= 1
        else:
            root = n
        stack.append([n, kids])
        depth = max(depth, len(stack))
        while stack and not stack[-1][1]:
            stack.pop()
    allow(depth)
    return root


def allow(depth: int) -> None:
    """Lets the walks go this deep."""
    if sys.getrecursionlimit() < (most := 4 * depth + 2000):
        sys.setrecursionlimit(most)


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """Tag, role, id and classes, with digits dropped; and whether the element is hidden."""
    if not attributes.strip():
        return tag, False
    out, hidden = [tag], False
    for m in ATTRIBUTE.finditer(attributes):
        k, v = m[1].lower(), entities.unescape((m[2] or "").strip("\"'"))
        if k in ("class", "id"):
            out += ["." + w for w in sorted({re.sub(r"\d+", "", c).lower() for c in v.split()}) if w]
        elif k == "role" and v:
            out.append("@" + v.strip().lower())
        elif k == "itemprop" and v.strip().lower() == "articlebody":
            out.append(".articlebody")
        hidden |= k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I) is not None
    return "".join(out), bool(hidden)


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The page's tree and its blocks of text in order."""
    root = Node("#page")
    stack, names, blocks, buffer = [root], [""], [], []
    opened: dict[str, int] = {}  # by name, of those in the stack
    deepest = 0
    linked = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                n = stack[-1]
                n.text = crc32(text.encode("utf-8", "replace"), n.text)
                n.chars += len(text)
                n.links += min(link_chars, len(text))
                blocks.append((n, text))
        link_chars = 0

    def close(upto: int) -> None:
        flush()
        for x in names[upto:]:
            opened[x] -= 1
        del stack[upto:], names[upto:]

    at, size, lower = 0, len(page), None
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                buffer.append(t)
                if linked:
                    link_chars += len(t.strip())
            elif t.startswith("<![CDATA["):
                buffer.append(t[9:-3])
            continue
        tag, ends, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ends:
            if tag == "a":
                linked = 0
            if tag in INLINE:
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if not opened.get(tag):
                flush()
                continue
            k = len(names) - 1
            while names[k] != tag:
                k -= 1
            close(k)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                lower = lower if lower is not None else page.lower() if len(page.lower()) == len(page) else page
                end = lower.find(f"</{tag}", at)
                at = size if end < 0 else (g + 1 if (g := page.find(">", end)) >= 0 else size)
            if tag not in ("script", "style", "noscript", "template"):
                buffer.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                linked = 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                buffer.append(" ")
            continue
        flush()
        ends_now = [x for x in (HEADINGS | {"p"} if tag in HEADINGS else {"p"}) if opened.get(x)]
        for k in range(len(names) - 1, 0, -1) if ends_now else ():  # a block ends an open paragraph
            if names[k] in ends_now:
                close(k)
                break
            if names[k] not in FLOW:
                break
        if tag in CLOSES and any(opened.get(x) for x in CLOSES[tag][0]):
            ended, within = CLOSES[tag]
            k, found = len(names) - 1, None
            while k > 0 and names[k] not in within:
                if names[k] in ended:
                    found = k
                k -= 1
            if found:
                close(found)
        label, hidden = _label(tag, attributes)
        n = Node(label + ".hidden" if hidden else label)
        linked = 0
        stack[-1].kids.append(n)
        stack.append(n)
        names.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
        deepest = max(deepest, len(names))
    close(1)
    flush()
    allow(deepest)
    fold(root)
    return root, blocks


def _tag(label: str) -> str:
    return re.match(r"[^.@]*", label)[0]


def alike(a: Node, b: Node) -> bool:
    """Whether two siblings can be one repeated group."""
    if a.label != b.label:
        return False
    if _tag(a.label) in FLOW or not a.kids and not b.kids:
        return True
    x, y = {k.label for k in a.kids}, {k.label for k in b.kids}
    return 2 * len(x & y) >= len(x | y) and bool(x & y)


def absorb(a: Node, b: Node, same_page: bool) -> None:
    """Merges b into a: of one page a repetition, else another page's."""
    if same_page:
        a.repeated = True
        a.pages = max(a.pages, b.pages)
    else:
        a.repeated |= b.repeated
        a.optional |= b.optional
        a.pages += b.pages
    a.chars += b.chars
    a.links += b.links
    if a.text is None or b.text is None:
        a.text = None
    elif same_page:
        a.text = crc32(b.text.to_bytes(4, "big"), a.text) if b.text else a.text
    elif a.text != b.text:
        a.text = None
    b.into = a
    merge_kids(a, b.kids, same_page)


def fold(root: Node) -> None:
    """Folds the squares among the children of each group, of one to SQUARE tags, the innermost first."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.kids
    for n in reversed(order):
        kids = n.kids
        for period in range(1, SQUARE + 1):
            out: list[Node] = []
            for k in kids:
                out.append(k)
                if len(out) >= 2 * period and all(alike(out[-2 * period + i], out[-period + i]) for i in range(period)):
                    if period == 1 or len({x.label for x in out[-period:]}) > 1:
                        for x, y in zip(out[-2 * period : -period], out[-period:]):
                            absorb(x, y, True)
                        del out[-period:]
            kids = out
        n.kids = kids


def merge_kids(a: Node, kids: list[Node], same_page: bool) -> None:
    """Aligns the children of a with others by the best common subsequence; what remains is optional."""
    mine = a.kids
    if len(mine) == len(kids) and all(x.label == y.label for x, y in zip(mine, kids)):
        for x, y in zip(mine, kids):
            absorb(x, y, same_page)
        return
    if not kids or not mine:
        for k in (*mine, *kids):
            k.optional = True
        a.kids = mine + kids
        return

    def weight(x: Node, y: Node) -> float:
        if x.label != y.label:
            return 0.0
        p, q = {k.label for k in x.kids}, {k.label for k in y.kids}
        return 1.0 + (len(p & q) / len(p | q) if p or q else 1.0)

    n, m = len(mine), len(kids)
    w = [[weight(x, y) for y in kids] for x in mine]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], w[i][j] + best[i + 1][j + 1] if w[i][j] else 0.0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and w[i][j] and best[i][j] == w[i][j] + best[i + 1][j + 1]:
            absorb(mine[i], kids[j], same_page)
            out.append(mine[i])
            i, j = i + 1, j + 1
        elif i < n and (j >= m or best[i][j] == best[i + 1][j]):
            mine[i].optional = True
            out.append(mine[i])
            i += 1
        else:
            kids[j].optional = True
            out.append(kids[j])
            j += 1
    a.kids = out
    # what one side repeats or lacks next to its like
    k = 1
    while k < len(a.kids):
        x, y = a.kids[k - 1], a.kids[k]
        if (x.optional or y.optional) and alike(x, y):
            absorb(x, y, True)
            del a.kids[k]
        else:
            k += 1


def boilerplate(label: str, inside: bool) -> bool:
    """By the tag, role, id and classes. inside: of an article, which may have a header of its own."""
    tag, *rest = re.split(r"(?=[.@])", label)
    if tag in BOILER_TAGS or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main", "#page"):
        return False
    for r in rest:
        if r[0] == "@" and r[1:] in BOILER_ROLES:
            return True
        if r[1:] in CONTENT_CLASSES:
            continue
        words = re.split(r"[^a-z]+", r[1:])
        if any(w in BOILER or w == "header" and not inside for w in words):
            return True
    return False


def is_content(label: str) -> bool:
    tag, *rest = re.split(r"(?=[.@])", label)
    return tag in CONTENT or any(r == "@main" or r == "@article" or r[1:] in CONTENT_CLASSES for r in rest)


def decide(root: Node) -> None:
    """Sets keep of every group: those with the article's text."""
    score: dict[int, int] = {}

    def sums(n: Node, inside: bool) -> int:
        n.keep = False
        if boilerplate(n.label, inside):
            return 0
        inside |= is_content(n.label)
        total = max(0, n.chars - 2 * n.links)
        for k in n.kids:
            total += sums(k, inside)
        score[id(n)] = total
        return total

    total = sums(root, False)

    def roots(n: Node) -> list[Node]:
        """The innermost groups marked as content that have most of the text of the outer ones."""
        inner: list[Node] = []
        for k in n.kids:
            if score.get(id(k)):
                inner += roots(k)
        if is_content(n.label) and 2 * sum(score[id(r)] for r in inner) < score[id(n)]:
            return [n]
        return inner

    chosen = [r for r in roots(root) if score[id(r)]] if total else []
    if not chosen:
        n = root
        while total:  # the innermost group with most of the text
            k = max(n.kids, key=lambda k: score.get(id(k), 0), default=None)
            headed = any(_tag(x.label) in ("h1", "h2", "h3") and x.chars for x in n.kids)
            if k is None or score.get(id(k), 0) < 0.7 * total or _tag(k.label) in FLOW or headed:
                break
            n = k
        chosen = [n]

    def mark(n: Node) -> None:
        if id(n) not in score:
            return
        # lists of links are menus
        n.keep = not (n.links > 0.8 * n.chars and _tag(n.label) not in ("p", "h1", "h2", "h3", "blockquote", "article", "main"))
        for k in n.kids:
            mark(k)

    for r in chosen:
        mark(r)
    if root.pages >= TEMPLATE_PAGES:
        kept, stack = [], [root]
        while stack:
            n = stack.pop()
            stack += n.kids
            if n.keep and n.chars:
                kept.append(n)
        same = [n for n in kept if n.text and n.pages >= root.pages]
        # where little else would be left, the pages are copies of each other
        if sum(n.chars for n in kept) - sum(n.chars for n in same) >= LEAST_LEFT * sum(n.chars for n in kept):
            for n in same:
                n.keep = False


def match(wrapper: Node, page: Node, out: dict[int, Node]) -> None:
    """For each group of a page the wrapper's group that it is aligned with, as merge_kids() does; no entry for none."""
    out[id(page)] = wrapper
    mine, kids = wrapper.kids, page.kids
    n, m = len(mine), len(kids)
    if n == m and all(x.label == y.label for x, y in zip(mine, kids)):
        for x, y in zip(mine, kids):
            match(x, y, out)
        return
    best = [[0.0] * (m + 1) for _ in range(n + 1)]

    def weight(x: Node, y: Node) -> float:
        if x.label != y.label:
            return 0.0
        p, q = {k.label for k in x.kids}, {k.label for k in y.kids}
        return 1.0 + (len(p & q) / len(q) if q else 1.0)

    w = [[weight(x, y) for y in kids] for x in mine]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):  # a group may repeat: it may be left for several of the page's
            best[i][j] = max(best[i + 1][j], best[i][j + 1], (w[i][j] + max(best[i + 1][j + 1], best[i][j + 1] if mine[i].repeated else 0.0)) if w[i][j] else 0.0)
    i = j = 0
    while i < n and j < m:
        if w[i][j] and best[i][j] == w[i][j] + best[i + 1][j + 1]:
            match(mine[i], kids[j], out)
            i, j = i + 1, j + 1
        elif w[i][j] and mine[i].repeated and best[i][j] == w[i][j] + best[i][j + 1]:
            match(mine[i], kids[j], out)
            j += 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1


def main_text(page: str | None, wrapper: Node | None = None) -> str:
    """The blocks of the article, joined by line feeds. Without a wrapper, or where it keeps nothing, the page is its
    own wrapper. Nesting may be of any depth; of tags that don't match each ends what it can."""
    if not page:
        return ""
    root, blocks = parse(page)
    if not blocks:
        return ""
    if wrapper is not None:
        at: dict[int, Node] = {}
        match(wrapper, root, at)
        out = [t for n, t in blocks if (w := at.get(id(n.final()))) is not None and w.keep]
        if out:
            return "\n".join(out)
    decide(root)
    return "\n".join(t for n, t in blocks if n.final().keep)


def host(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Node] = {}
    for b in batches:
        for url, page in zip(b.column(0).to_pylist(), b.column(1)):
            if page := page.as_py():
                root, _ = parse(page)
                if (w := held.get(h := host(url))) is None:
                    held[h] = root
                else:
                    absorb(w, root, False)
        if len(held) > 20_000:
            yield _dumped(held)
            held = {}
    yield _dumped(held)


def _dumped(held: dict[str, Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([json.dumps(w.dump(), ensure_ascii=False) for w in held.values()], pa.string())], ["host", "wrapper"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of host: one wrapper a host."""
    now, held = None, None
    for b in batches:
        out: dict[str, Node] = {}
        for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = load(json.loads(x))
            if h == now:
                absorb(held, w, False)
            else:
                if held is not None:
                    out[now] = held
                now, held = h, w
        if out:
            yield _dumped(out)
    if held is not None:
        yield _dumped({now: held})


WRAPPERS = "host string, wrapper string"


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of pages (url, html); a null url has host ''. Wrappers of one host meet in SALTS parts first."""
    w = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_infer, WRAPPERS)
    w = w.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    w = w.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(_merge, WRAPPERS)
    return w.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge, WRAPPERS)


def _decided(x: str) -> Node:
    w = load(json.loads(x))
    decide(w)
    return w


TEXTS = "page_id bigint, url string, text string, n_chars bigint"


def _texts(b: pa.RecordBatch, of) -> pa.RecordBatch:
    urls = b.column(1).to_pylist()
    texts = [main_text(p.as_py(), of(u, k)) for k, (u, p) in enumerate(zip(urls, b.column(2)))]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html).

    text has the article's blocks in page order, joined by line feeds; white space in a block is one space, character
    references are decoded. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments are left out, as the host's wrapper tells. A null or empty html, and one without such text, gives an
    empty text. A null url is a host of its own. Repeated rows give repeated rows, no pages none; other columns are
    ignored.
    """
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    w = materialize(wrappers(p), "wrappers")
    if (w.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= sent_bytes:
        sent = spark.sparkContext.broadcast({r[0]: r[1] for r in w.collect()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[str, Node | None] = {}

            def of(url: str | None, _: int) -> Node | None:
                h = host(url)
                if h not in ready:
                    x = sent.value.get(h)
                    ready[h] = _decided(x) if x else None
                return ready[h]

            for b in batches:
                yield _texts(b, of)

        return p.mapInArrow(apply, TEXTS)
    host_of = F.udf(host, "string")
    w = w.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    j = p.withColumn("host", host_of("url")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(w, ["host", "salt"], "left")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)

        for b in batches:
            own = b.column(3).to_pylist()

            def of(_: str | None, k: int) -> Node | None:
                nonlocal last
                if own[k] is not None and last[0] != own[k]:
                    last = (own[k], _decided(own[k]))
                return last[1] if own[k] is not None else None

            yield _texts(b, of)

    return j.select("page_id", "url", "html", "wrapper").mapInArrow(joined, TEXTS)


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
