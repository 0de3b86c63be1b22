"""Main text of web pages by site template removal (operator 6).

Every page is parsed into elements; each subtree has a hash of its tags, class
names and text.  Spark counts, for every host, in how many different articles'
pages a subtree occurs; subtrees recurring across PAGES of them or more are the
site's template and are deleted, however large the host is.  Where a page has
no element that is its article, single blocks of text count as well, so menus,
notices and copyright lines go without telling names; inside an article,
headings, paragraphs and the like are its own words and stay.  Elements whose
tag, role or class says that they are no part of the article go, too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnscope.llm.shared import pick, read, written

#: A subtree is template if it is on so many different articles' pages of its host.
PAGES = 5
#: So many template hashes at most are sent to all workers; more are joined by page.
SENT = 200_000
#: A template on more pages than this joins its pages by broadcast.
HOT_PAGES = 5_000
PAGE = {"page_id": "long", "url": "string", "html": "string"}

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "xmp"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "button", "dialog", "menu", "audio", "video", "canvas", "label"}
#: Dropped unless the page or its article is inside.
FORMS = {"form", "fieldset"}
#: Elements that end the block of text before them and begin another.
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main",
         "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "tr", "dd", "dt", "caption", "figcaption",
        "summary", "b", "i", "em", "strong", "a", "span", "u", "s", "small", "mark", "sub", "sup", "code", "q", "cite", "abbr",
        "time", "font", "tt", "kbd", "var", "del", "ins", "address", "tbody", "thead", "tfoot"}
#: A start tag closes an open element of these, unless a barrier lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tbody"}}
BARRIER = {"table", "ul", "ol", "dl", "article", "main", "section", "div", "body", "html"}
#: Words of class, id and role names that mark what is no part of an article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alert|nav|navbar|navigation|menu\w*|"
    r"breadcrumbs?|sidebars?|complementary|footer|masthead|contentinfo|header|topbar|comments?|respond|disqus|shar(?:e|ing)|social|"
    r"related|newsletter|subscri\w+|popup|modal|overlay|paywall|skip|pagination|pager|widgets?|tags|byline|toolbar|search|login|signup|"
    r"links|repl(?:y|ies))"
    r"(?=$|[\s_-])", re.I)
#: Names of an element's state ("has-sidebar"), which don't say what it is.
STATES = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|is|not)[_-]\S*")
#: Marks that an article's own parts may have, too; there only lists of links go by them.
VAGUE = re.compile(r"alert|notices?|search|tags|related|links", re.I)
#: What is under these names is never the page's article.
OTHERS = re.compile(r"\b(?:comments?|respond|disqus|related|repl(?:y|ies))\b|:hidden", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story)(?=$|[\s_-])")
#: Names of a container that is the article and nothing else.
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)(?=$|[\s_-])")
#: What an element that isn't shown gets among its names.
HIDDEN = ":hidden"
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</[^a-zA-Z][^>]*>"""
                 r"""|</?[a-zA-Z][^>]*>|</?[a-zA-Z][^<>]*\Z""", re.S)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "kids", "hash", "words", "marked", "dropped")

    def __init__(self, tag: str, names: str):
        self.tag, self.names, self.kids, self.hash, self.words = tag, names, [], 0, 0
        own = tag not in ("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6")
        self.marked = tag not in DROPPED and (
            HIDDEN in names or tag in FORMS or own and bool(names and MARKS.search(STATES.sub("", names)))
            or tag == "article" and bool(re.search(r"\bcomments?\b", STATES.sub("", names))))
        self.dropped = self.marked or tag in DROPPED


def _close(node: Node) -> None:
    parts = [node.tag, node.names]
    for kid in node.kids:
        if isinstance(kid, str):
            text = " ".join(kid.split())
            node.words += len(text)
            parts.append(text)
        else:
            node.words += kid.words
            parts.append(f"<{kid.hash}>")
    node.hash = xxhash.xxh64_intdigest("\x00".join(p for p in parts if p)) - (1 << 63)


def _names(attributes: str) -> str:
    """Class, id and role of a start tag; ``HIDDEN`` if the element isn't shown."""
    out = []
    for name, *values in NAMES.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("hidden", "style"):
            if name == "hidden" and value.lower() != "until-found" or UNSEEN.search(value):
                out.append(HIDDEN)
        else:
            out.append(value or name)
    return " ".join(out)


def parse(page: str) -> Node:
    """The page's element tree, subtree hashes set; tolerant of unclosed,
    misplaced and cut-off tags.  Character references are decoded."""
    root = Node("html", "")
    stack, at, end = [root], 0, len(page)

    def pop(to: int) -> None:
        while len(stack) > to:
            _close(stack.pop())

    while at < end:
        m = TAG.search(page, at)
        if (stop := m.start() if m else end) > at:
            stack[-1].kids.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop(k)
                    break
                if stack[k].tag in ("article", "main", "body") and tag in FLOW:
                    break
            continue
        if tag in ("html", "body"):
            pop(1)  # misplaced content before it stays where it was
            if tag == "html":
                continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in shut:
                pop(k)
                break
            if stack[k].tag in BARRIER:
                break
        names = _names(m[3]) if m[3] and m[3].strip("/ ") else ""
        node = Node(tag, names.strip())
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            _close(node)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            _close(node)
            continue
        stack.append(node)
    pop(0)
    _keep_article(root)
    return root


def _rank(node: Node) -> int:
    """How surely an element is the article: 0 most, 9 not."""
    names = node.names.lower()
    return (0 if node.tag == "article" else 1 if node.tag == "main" or "main" in names.split() else
            2 if names and CONTENT.search(names) else 3 if node.tag == "body" else 9)


def _links(node: Node) -> int:
    """Length of the text in links."""
    todo, n = [node], 0
    while todo:
        node = todo.pop()
        if node.tag == "a":
            n += node.words
        else:
            todo.extend(k for k in node.kids if isinstance(k, Node))
    return n


def _keep_article(root: Node) -> None:
    """Take marked elements back from the dropped ones that hold the article,
    most of the page's text or the article's first heading, and parts of the
    article that aren't lists of links and have vague marks only."""
    lost: dict[int, int] = {}  # text of dropped tags in marked elements
    total, clean, first = root.words, root.words, None
    marked, articles, seen = [], [], set()
    todo = [(root, (), 0)]
    while todo:
        node, chain, article = todo.pop()
        if node.tag in DROPPED:
            total -= node.words
            if not chain:
                clean -= node.words
            for m in chain:
                lost[id(m)] = lost.get(id(m), 0) + node.words
            continue
        if node.marked:
            if not chain:
                clean -= node.words
            chain = (*chain, node)
            marked.append((node, article))
        elif (rank := _rank(node)) < 3:
            if chain and rank < 2:
                articles.append((node, chain))
            article = article or id(node)
        if node.tag in ("h1", "h2"):
            if node.tag == "h1" and first is None:
                first = chain
            if article and article not in seen:
                seen.add(article)
                inner = [m for m, a in marked if a and m in chain]
                if not any(OTHERS.search(m.names) for m in inner):
                    for m in inner:
                        m.dropped = False
        todo.extend((k, chain, article) for k in reversed(node.kids) if isinstance(k, Node))
    for node, chain in articles:
        if (node.words > clean or first and first[-1] in chain) and not any(OTHERS.search(m.names) for m in chain):
            for m in chain:
                m.dropped = False
    for node, article in marked:
        if article:
            names = STATES.sub("", node.names)
            if HIDDEN not in node.names and node.tag not in FORMS and node.tag != "article" and not MARKS.search(VAGUE.sub("", names)) and 2 * _links(node) < node.words:
                node.dropped = False
        elif 2 * (node.words - lost.get(id(node), 0)) > total and not OTHERS.search(node.names):
            if node.tag in FORMS or not clean or first and node in first:
                node.dropped = False


def _inside(root: Node) -> Iterator[Node]:
    """All elements below root that aren't dropped by name, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.dropped)


def main_part(root: Node) -> Node:
    """The article: the longest ``article``, else ``main`` or an element named
    for content, else the whole body."""
    best: dict[int, Node] = {}
    for node in _inside(root):
        rank = _rank(node)
        if rank < 9 and (rank not in best or node.words > best[rank].words):
            best[rank] = node
    return best[min(best)] if best else root


def is_article(main: Node) -> bool:
    """Is the main part an element that holds an article, by tag or name?"""
    return _rank(main) < 2 or bool(ARTICLE.search(main.names.lower()))


def block_hash(text: str) -> int:
    """Hash of a block of text, unlike any subtree's."""
    return xxhash.xxh64_intdigest("\x01" + text) - (1 << 63)


def candidates(root: Node, main: Node) -> set[int]:
    """Hashes of what may be template: the subtrees with text outside of the
    main part, the containers inside it, and, where the main part is no
    article element, its blocks of text."""
    inside = {id(n) for n in _inside(main)}
    found = set()
    for node in _inside(root):
        if node is main or node.tag in ("html", "body") or not node.words:
            continue
        if id(node) not in inside or node.tag not in FLOW and node.tag not in ("article", "main"):
            found.add(node.hash)
    if not is_article(main):
        found.update(map(block_hash, texts_of(main, set())))
    return found


def texts_of(main: Node, template: set[int]) -> list[str]:
    """The main part's blocks of text, without dropped and template subtrees."""
    inside_free = {id(n) for n in _inside(main) if n.tag in FLOW or n.tag in ("article", "main", "html", "body")}
    out, run = [], []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [main]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            run.append(node)
        elif node.tag == "br":
            run.append(" ")
        elif node.tag == "header" and main.tag not in ("article", "main"):
            continue  # the page's own; an article's holds its heading
        elif node is main or not (node.dropped or node.hash in template and id(node) not in inside_free):
            block = node.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(node.kids))
    flush()
    return out


def blocks_of(root: Node, template: set[int]) -> str:
    """The page's text: its main part's blocks, without the template's."""
    main = main_part(root)
    texts = texts_of(main, template)
    if not is_article(main):
        texts = [t for t in texts if block_hash(t) not in template]
    return "\n".join(texts)


def host_of(url):
    """The url's host in lower case; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _keyed(pages: DataFrame) -> DataFrame:
    return pick(pages, PAGE).select("page_id", "url", "html", host_of(F.col("url")).alias("host"),
                                    F.xxhash64(F.coalesce("html", F.lit(""))).alias("html_hash"))


def subtrees(pages: DataFrame) -> DataFrame:
    """``host, html_hash, subtree, body`` of everything that may be template:
    its hash and that of its page's main part (written)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, names, hashes, bodies = [], [], [], []
            for host, name, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not page:
                    continue
                root = parse(page)
                main = main_part(root)
                found = candidates(root, main)
                hosts += [host] * len(found)
                names += [name] * len(found)
                hashes += found
                bodies += [main.hash] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (names, hashes, bodies))],
                                             ["host", "html_hash", "subtree", "body"])

    return written(_keyed(pages).select("host", "html_hash", "html").mapInArrow(
        run, "host string, html_hash long, subtree long, body long"), "subtrees")


def templates(seen: DataFrame) -> DataFrame:
    """``host, subtree, articles`` of every template: in how many different
    articles' pages of its host it occurs, PAGES or more (written).  Pages with
    the same main part count once, so copies of an article don't make its parts
    a template."""
    return written(seen.select("host", "subtree", "body").distinct().groupBy("host", "subtree").agg(F.count("*").alias("articles"))
                   .where(F.col("articles") >= PAGES), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    A null or empty page, or one without an article's text, has text ''.
    Blocks are in page order, joined by one line feed; white space in a block
    is one space.  A page counts whole, however long or deeply nested.  Rows
    with equal ids are separate rows, equal rows get equal texts; a null url is
    a host of its own; an empty table gives none.  Columns are found by their
    exact names."""
    seen = subtrees(pages)
    found = templates(seen)
    n = found.count()
    out = "page_id long, url string, text string, n_chars long"

    def answer(batch: pa.RecordBatch, template: list[set[int]]) -> pa.RecordBatch:
        texts = [blocks_of(parse(page), t) if page else "" for page, t in zip(batch.column(2).to_pylist(), template)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                           pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if n <= SENT:  # hashes only, so their number bounds their size
        by_host: dict[int, set[int]] = {}
        for r in found.select(F.xxhash64("host").alias("host"), "subtree").collect():
            by_host.setdefault(r.host, set()).add(r.subtree)
        sent = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield answer(batch, [sent.value.get(h, set()) for h in batch.column(3).to_pylist()])

        return _keyed(pages).select("page_id", "url", "html", F.xxhash64("host").alias("host")).mapInArrow(run, out)

    # Each page gets the templates on it, no others.
    hot = F.broadcast(found.where(F.col("articles") > HOT_PAGES).select("host", "subtree"))
    rare = found.where(F.col("articles") <= HOT_PAGES).select("host", "subtree")
    own = seen.join(hot, ["host", "subtree"]).unionByName(seen.join(hot, ["host", "subtree"], "left_anti").join(rare, ["host", "subtree"]))
    own = own.groupBy("host", "html_hash").agg(F.collect_set("subtree").alias("template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield answer(batch, [set(t or ()) for t in batch.column(3).to_pylist()])

    return (_keyed(pages).join(own, ["host", "html_hash"], "left").select("page_id", "url", "html", "template").mapInArrow(run, out))


def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
