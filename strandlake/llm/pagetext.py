"""HTML main text by site template removal.

Every page is parsed to a tree, whole.  Each element is hashed twice: by its content (tags and text of the
subtree) and by its shape (tags, attribute names, classes and roles of the subtree, text left out; equal
neighbours count once, so that menus of other words and lengths still meet).  Spark counts for each host on how
many pages of distinct content a hash is found; the elements that recur are the site's template:

* outside the article (article or main elements) any shape or content on ``MIN_PAGES`` pages;
* inside an article, and anywhere on a page without such elements, contents only on ``MIN_INSIDE`` pages and
  ``MIN_SHARE`` of the host's: a paragraph that many articles of a host repeat is text, not template;
* on pages without such elements also shapes on ``MIN_PAGES`` pages of which links make up most of the text.

Templates are deleted first.  Second step, for what cannot recur (hosts of one page, notices shown once):
elements that are boilerplate by their meaning go (fixed lists: navigation, footers, asides, forms, scripts,
notices, adverts, reader comments and so on).  The text of the article (or main element, else the body) comes
out in blocks: references decoded, white space inside a block squeezed, blocks joined by a newline.
``by_method`` tells whether templates alone took text from a page.

Contract: one row per input row: page_id, url, text ('' if none), n_chars, by_method.  A null html is empty.
Null or odd urls share the host ''.  Repeated pages get equal texts and count once for the template.  Broken
markup is read as browsers do: open elements end with their parents, stray end tags are skipped.  Time is
linear in the page, whatever its markup.

Counts combine before they shuffle, so a hot host costs a row for each task and hash.  The template table
is broadcast only if it has at most ``BROADCAST_TEMPLATES`` rows.  Beyond that each page meets the templates
of the hashes that it has itself, by a join on (host, hash): no page carries its host's whole list.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

MIN_PAGES = 2
MIN_INSIDE, MIN_SHARE = 8, 0.5
BROADCAST_TEMPLATES = 500_000

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
DROP = frozenset("head script style noscript template iframe nav footer aside form button select textarea input svg canvas object embed audio video menu dialog title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key's set ends an open element of that name.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class or id that mark boilerplate.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
OUTER_HINTS = frozenset("header masthead topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STEP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Elements behind which an open element of another kind is not ended.
BARRIER = frozenset("ul ol dl table select div article section body blockquote td li".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Open:
    """The open elements: which names are open, in all and since the last barrier, in constant time."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.counts = [root], {}
        self.scopes: list[dict[str, int]] = [{}]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1
        if node.tag in BARRIER:
            self.scopes.append({node.tag: 1})
        else:
            self.scopes[-1][node.tag] = self.scopes[-1].get(node.tag, 0) + 1

    def close(self, names: frozenset[str] | set[str]) -> None:
        """End the innermost open element of ``names`` and all within it."""
        while True:
            tag = self.nodes.pop().tag
            self.counts[tag] -= 1
            if tag in BARRIER:
                self.scopes.pop()
            else:
                self.scopes[-1][tag] -= 1
            if tag in names:
                return


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """The place of the ``>`` that ends the tag that begins before ``at``: outside quotes if there is one such, else the first."""
    k = at
    while k <= last[">"]:
        m = _STEP.search(html, k)
        if m is None:
            break
        c, k = m[0], m.end()
        if c == ">":
            return k - 1
        if k > last[c]:
            break  # this quote never closes
        k = html.find(c, k) + 1
    return html.find(">", at)


def parse(html: str) -> Node:
    """The tree of a page; texts are the raw strings between tags."""
    root = Node("#root")
    open_, at, n = _Open(root), 0, len(html)
    last = {c: html.rfind(c) for c in ">\"'"}
    text = 0  # where the text that is not yet in the tree begins

    def flush(upto: int) -> None:
        if upto > text:
            open_.nodes[-1].children.append(html[text:upto])

    while True:
        at = html.find("<", at)
        if at < 0 or at > last[">"] and not html.startswith("<!", at):
            break
        ends = html.startswith("</", at)
        name = _NAME.match(html, at + 1 + ends)
        if html.startswith("<!--", at):
            flush(at)
            end = html.find("-->", at + 4)
            at = text = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            flush(at)
            end = html.find(">", at)
            at = text = n if end < 0 else end + 1
            continue
        if name is None:
            at += 1
            continue
        end = _tag_end(html, name.end(), last)
        if end < 0:
            break
        flush(at)
        tag, attrs = name[0].lower(), html[name.end() : end]
        at = text = end + 1
        if ends:
            if open_.counts.get(tag):
                open_.close({tag})
            continue
        if tag in BLOCK or tag in CLOSES:
            here, wanted = open_.scopes[-1], CLOSES.get(tag, frozenset()) | ({"p"} if tag in BLOCK else set())
            if any(here.get(x) for x in wanted):
                open_.close(wanted)
        node = Node(tag, attrs)
        open_.nodes[-1].children.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = text = end.end() if end else n
            continue
        open_.push(node)
    flush(n)
    return root


def _attributes(node: Node) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(node.attrs)} if node.attrs.strip() else {}


def _boilerplate(node: Node, inside: bool) -> bool:
    """inside: within an article or main element, where a header holds the article's own title."""
    if node.tag in DROP or node.tag == "header" and not inside:
        return True
    a = _attributes(node)
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "").lower()) or a.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("body", "html", "main") or node.tag == "article" and not inside and "comment" not in a.get("class", "").lower():
        return False
    words = set(_SPLIT.split((a.get("class", "") + " " + a.get("id", "")).lower()))
    return bool(words & HINTS) or not inside and bool(words & OUTER_HINTS)


def prune(root: Node) -> Node:
    """The tree without boilerplate elements."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _boilerplate(c, inside)]
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]
    return root


def _find(root: Node, want) -> list[Node]:
    """The outermost nodes that ``want`` holds for, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is not root and want(node):
            found.append(node)
        else:
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found


def article(root: Node) -> list[Node]:
    """The elements that hold the main text: articles, else main elements, else the whole page."""
    return _find(root, lambda x: x.tag == "article") or _find(root, lambda x: x.tag == "main" or "articlebody" in x.attrs.lower() or re.search(r"role\s*=\s*[\"']?main", x.attrs, re.I) is not None) or [root]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


#: Element attributes whose values belong to a shape.
_SHAPED = ("class", "id", "role")


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def subtree_hashes(root: Node) -> dict[int, tuple[tuple[int, bool], ...]]:
    """id(node) -> (hash, is it held to the rule for articles) by which a template may take each element with text.

    An article, and what an article is in, is no template.
    """
    tops = article(root)
    marked = tops != [root]
    inside = set()
    stack = list(tops) if marked else []
    while stack:
        node = stack.pop()
        inside.add(id(node))
        stack += [c for c in node.children if not isinstance(c, str)]
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    out: dict[int, tuple[tuple[int, bool], ...]] = {}
    content: dict[int, int] = {}
    shape: dict[int, int] = {}
    weight: dict[int, tuple[int, int]] = {}  # characters, and those in links
    holds: set[int] = {id(x) for x in tops}  # articles and what they are in
    for node in reversed(order):
        parts, forms, chars, linked = [], [], 0, 0
        for c in node.children:
            if isinstance(c, str):
                t = " ".join(c.split())
                chars += len(t)
                if t:
                    parts.append(t)
                continue
            k = id(c)
            if k in holds:
                holds.add(id(node))
            if k in shape:
                if not forms or forms[-1] != shape[k]:
                    forms.append(shape[k])
            if k in content:
                parts.append(f"{content[k]:x}")
                chars, linked = chars + weight[k][0], linked + weight[k][1]
        a = _attributes(node)
        shape[id(node)] = _hash("\x01".join([node.tag, *sorted(a), *(f"{x}={a[x]}" for x in _SHAPED if x in a), *(f"{f:x}" for f in forms)]))
        if not parts:
            continue
        weight[id(node)] = chars, chars if node.tag == "a" else linked
        content[id(node)] = _hash("\x01".join([node.tag, "", *parts]))
        if id(node) in holds or node.tag in ("#root", "html", "body", "head"):
            continue
        within = not marked or id(node) in inside
        # The two rules count apart: a content in articles and elsewhere has two hashes.
        same = (_hash(f"in{content[id(node)]:x}") if within else content[id(node)], within)
        if node.tag in BLOCK or a and not within:
            form = not within if marked else 2 * weight[id(node)][1] >= chars > 0
            out[id(node)] = (same, (shape[id(node)], False)) if form else (same,)
    return out


def blocks(tops: list[Node], gone: set[int]) -> list[str]:
    """The texts of the blocks below ``tops``, without the nodes whose id is in ``gone``."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        t = " ".join("".join(held).split())
        if t:
            out.append(t)
        held.clear()

    for top in tops:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(html_lib.unescape(x) if "&" in x else x)
            elif id(x) in gone:
                if x.tag in BLOCK:
                    flush()
            elif x.tag == "br":
                held.append(" ")
            else:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.children)
        flush()
    return out


def strip(root: Node, templates: frozenset[int] | set[int]) -> tuple[Node, bool]:
    """The tree without the elements that ``templates`` holds a hash of, and whether any went."""
    gone = {k for k, hs in subtree_hashes(root).items() if any(h in templates for h, _ in hs)} if templates else set()
    stack = [root] if gone else []
    while stack:
        node = stack.pop()
        # A block leaves a line break, which separates its neighbours.
        node.children = [c if isinstance(c, str) or id(c) not in gone else Node("hr" if c.tag in BLOCK else "wbr") for c in node.children]
        stack += [c for c in node.children if not isinstance(c, str)]
    return root, bool(gone)


def main_parts(html: str | None, templates: frozenset[int] | set[int] = frozenset(), lists: bool = True) -> tuple[str, bool]:
    """(main text, whether templates took any); without ``lists`` only templates, and what is no text, are left out."""
    root, went = strip(parse(html or ""), templates)
    if lists:
        return "\n".join(blocks(article(prune(root)), set())), went
    return "\n".join(blocks([root], {id(x) for x in _find(root, lambda x: x.tag in RAW or x.tag == "head")})), went


def extract(html: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    return main_parts(html, templates)[0]


def _host(col):
    return F.lower(F.coalesce(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def page_hashes(html: str | None) -> tuple[int, list[tuple[int, bool]]]:
    """(hash of the page's text, its elements' distinct hashes and whether they are inside an article)."""
    root = parse(html or "")
    return _hash("\n".join(blocks([root], set()))), sorted({x for hs in subtree_hashes(root).values() for x in hs})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, content, subtree, inside): each page's distinct hashes; the page itself counts with subtree null."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            host, key, content, subtree, inside = ([] for _ in range(5))
            rows = batch.slice(lo, 64)
            for h, k, page in zip(*(rows[c].to_pylist() for c in ("host", "page", "html")), strict=True):
                whole, mine = page_hashes(page)
                n = len(mine) + 1
                host += [h] * n
                key += [k] * n
                content += [whole] * n
                subtree += [None, *(x for x, _ in mine)]
                inside += [False, *(x for _, x in mine)]
            yield pa.record_batch([pa.array(host, pa.string()), pa.array(key, pa.int64()), pa.array(content, pa.int64()), pa.array(subtree, pa.int64()), pa.array(inside, pa.bool_())], _FEATURES)


_FEATURES = ["host", "page", "content", "subtree", "inside"]
_FEATURE_SCHEMA = "host string, page long, content long, subtree long, inside boolean"


def templates(pages: DataFrame) -> DataFrame:
    """(host, subtree) of each host's template; ``pages`` has (host, page, html)."""
    rows = pages.select("host", "page", "html").mapInArrow(_features, _FEATURE_SCHEMA)
    # Pages of equal content count once: distinct first, then counts; both combine before they shuffle.
    counts = rows.select("host", "content", "subtree", "inside").distinct().groupBy("host", "subtree", "inside").agg(F.count("*").alias("n"))
    counts = materialise(counts.where(f"subtree IS NULL OR n >= IF(inside, {MIN_INSIDE}, {MIN_PAGES})"), "subtrees", narrow=True)
    pages_of = counts.where("subtree IS NULL").select("host", F.col("n").alias("pages"))
    found = counts.where("subtree IS NOT NULL").join(pages_of, "host").where(~F.col("inside") | (F.col("n") >= MIN_SHARE * F.col("pages")))
    return materialise(found.select("host", "subtree"), "templates", narrow=True)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, by_method of every row of ``pages``; ``lists`` switches the second step."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), _host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    pages = pages.withColumn("page", F.xxhash64("html"))
    found = templates(pages)
    names = ["page_id", "url", "text", "n_chars", "by_method"]

    def rows(batch: pa.RecordBatch, of) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            texts, cut = [], []
            for k, page in enumerate(part["html"].to_pylist()):
                known = of(lo + k)
                text, went = main_parts(page, known, lists)
                texts.append(text)
                cut.append(went)
            yield pa.record_batch([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(cut, pa.bool_())], names)

    out = "page_id long, url string, text string, n_chars long, by_method boolean"
    if found.count() <= BROADCAST_TEMPLATES:
        sets: dict[str, set[int]] = {}
        got = found.toArrow()
        for h, s in zip(got["host"].to_pylist(), got["subtree"].to_pylist(), strict=True):
            sets.setdefault(h, set()).add(s)
        shared = pages.sparkSession.sparkContext.broadcast(sets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts = batch["host"].to_pylist()
                yield from rows(batch, lambda k, hosts=hosts: shared.value.get(hosts[k], frozenset()))

        return pages.mapInArrow(run, out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists_of = batch["subtrees"].to_pylist()
            yield from rows(batch, lambda k, lists_of=lists_of: frozenset(lists_of[k] or ()))

    # A page's list holds at most the hashes of its own elements.
    own = pages.select("host", "page", "html").mapInArrow(_features, _FEATURE_SCHEMA).select("host", "page", "subtree").distinct()
    own = own.join(found, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_list("subtree").alias("subtrees"))
    return pages.join(own, ["host", "page"], "left").mapInArrow(joined, out)
