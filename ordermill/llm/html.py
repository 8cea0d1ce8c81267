"""Operator 1: main text of web pages by tree scoring.

A page becomes a tree; elements that never hold the article, by name, role or words of their class and id, are cut off,
but for those cut by class or id that do hold it; they all stay where next to nothing would be left.
Each paragraph earns points for its length and commas, less by the share of its text that is links, and passes them to
its parent in full, to its grandparent by half, further up by less. The best container wins, or the article or main element
around it, together with those of its siblings that score well against it or are plain paragraphs of text."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\s(hidden)(?=[\s/>]|\Z)", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is text up to their own end tag.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_CUT = _RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "label", "fieldset", "menu", "svg", "canvas", "object", "embed", "audio", "video", "dialog", "map", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label img wbr br".split())
_PARAGRAPH = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "h2", "h3", "h4", "h5", "h6", "figcaption", "address"}
#: Start tags that end an open paragraph.
_ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Of a term and its description, or the cells of a table, either ends the other.
_ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Words of a class or id that speak for what is no article.
_UNLIKELY = set("""ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline comment comments commentlist
community cookie cookies consent disqus disclaimer discussion footer footnav gdpr header login masthead menu menubar modal nav navbar navigation newsletter
notice notices alert outbrain overlay pager pagination paywall popup promo promoted promotion recommend recommended related remark replies reply respond
rss share sharing shoutbox sidebar signup skip skyscraper social sponsor sponsored subscribe subscription taboola tags toolbar toc tooltip widget widgets""".split())
_LIKELY = {"article", "body", "content", "entry", "main", "post", "story", "text", "maincontent", "articlebody", "hentry"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "alert", "form", "toolbar"}
#: Of these, those whose elements hold links and no prose: with prose in it, an element is something else.
_LINKS = set("breadcrumb breadcrumbs menu menubar nav navbar navigation pager pagination rss share sharing skip social tags toolbar".split())
#: A text of fewer letters, and of less than a fifth of what there is without cuts by name, is not trusted.
TINY = 100
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


class Node:
    """An element. length, linked and commas are of its whole text, once measured: letters, letters in links, commas; holds
    is how many article, main and h1 elements it is and has."""

    __slots__ = ("tag", "parent", "children", "score", "likely", "cut", "length", "linked", "commas", "holds")

    def __init__(self, tag: str, parent: Node | None, likely: bool = False, cut: str = ""):
        self.tag, self.parent, self.children, self.score, self.likely, self.cut = tag, parent, [], 0.0, likely, cut


def _judge(tag: str, attributes: str) -> tuple[str, bool]:
    """Why an element is cut off, if it is (always; by names; by names for links), and whether its names speak for it."""
    if not attributes or attributes.isspace():
        return "", False
    words: set[str] = set()
    for name, value, bare in _ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return "always", False
        if name == "role" and value.lower() in _ROLES:
            return "always", False
        if name in ("class", "id", "itemprop"):
            words.update(w.lower() for w in _WORDS.findall(value))
    likely = bool(words & _LIKELY)
    bad = words & _UNLIKELY
    if not bad or tag in ("html", "body", "main") or likely and bad <= {"header", "tags", "text"}:
        return "", likely
    return "links" if bad <= _LINKS else "names", likely


def parse(html: str, names: bool = True) -> Node:
    """The tree of what may be article: elements and strings; `names`: without those cut off by their names. Missing end tags are supplied, at the end of a cut page and
    inside of elements that are cut off too; these are taken out at the end."""
    root = here = Node("#root", None)
    at = 0
    find = _TOKEN.search
    opened: Counter = Counter()  # tags from here up
    inside: list[Counter] = [Counter()]  # the same, since each element that is cut off

    def leave(node: Node) -> Node:
        """Close what is open up to and with a node."""
        x = here
        while x is not node.parent:
            opened[x.tag] -= 1
            inside[-1][x.tag] -= 1
            if x.cut:
                inside.pop()
            x = x.parent
        return x

    while True:
        m = find(html, at)
        if m is None:
            if at < len(html):
                here.children.append(html[at:])
            return _pruned(root, names)
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, close, attributes = tag.lower(), m[1] or m[4], (m[3] or m[6] or "")
        if close:
            within = tag in _INLINE or tag == "p"  # a stray one inside of a cut part does not end it
            if (inside[-1] if within else opened)[tag]:
                node = here
                while node is not root and node.tag != tag and not (within and node.cut):
                    node = node.parent
                if node.tag == tag:
                    here = leave(node)
                    continue
            if tag in ("article", "main", "body", "html"):  # the part cut off was never closed
                node, outermost = here, None
                while node is not root:
                    if node.cut:
                        outermost = node
                    node = node.parent
                if outermost is not None:
                    here = leave(outermost)
            if tag not in _INLINE:
                here.children.append(Node("br" if tag == "br" else "#break", here))
            continue
        empty = tag in _VOID or attributes.endswith("/") and tag not in _RAW
        if tag in _RAW and not attributes.endswith("/"):
            end = _ends(tag).search(html, at)
            at = end.end() if end else len(html)
            continue
        if here.tag == "head" and tag not in ("base", "link", "meta"):
            here = leave(here)
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P and opened["p"]:
            node = here
            while node is not root and (node.tag in _INLINE and not node.cut or node.tag == "p"):
                if node.tag == "p":
                    here = leave(node)
                    break
                node = node.parent
        if tag in _ITSELF:
            alike = _ALIKE.get(tag, (tag,))
            node = here if any(opened[x] for x in alike) else root
            while node is not root and node.tag not in _ITSELF[tag]:
                if node.tag in alike:
                    here = leave(node)
                    break
                node = node.parent
        cut, likely = _judge(tag, attributes)
        if tag in _CUT:
            cut = "always"
        if cut and empty:
            if tag not in _INLINE:
                here.children.append(Node("#break", here))
            continue
        node = Node(tag, here, likely, cut)
        here.children.append(node)
        if not empty:
            here = node
            opened[tag] += 1
            if cut:
                inside.append(Counter())
            inside[-1][tag] += 1


@functools.cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


def _measured(root: Node) -> Node:
    """root, with the measures of every element below, each worked out once, from the bottom up."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if not isinstance(c, str))
    for x in reversed(order):
        x.length = x.linked = x.commas = 0
        holds = [x.tag == "article", x.tag == "main", x.tag == "h1"]
        for c in x.children:
            if isinstance(c, str):
                x.length += len(_SPACE.sub(" ", c).strip())
                x.commas += c.count(",")
            else:
                x.length += c.length
                x.linked += c.linked
                x.commas += c.commas
                holds = [a + b for a, b in zip(holds, c.holds, strict=True)]
        x.holds = holds
        if x.tag == "a":
            x.linked = x.length
    return root


def _pruned(root: Node, names: bool) -> Node:
    """The tree without what is cut always and, with `names`, by name: all but elements that hold the article."""
    named, stack = False, [root]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or c.cut != "always"]
        for c in x.children:
            if not isinstance(c, str):
                stack.append(c)
                named = named or c.cut != ""
    _measured(root)
    if not named or not names:
        return root
    stack = [root]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not c.cut or _is_wrapper(c, root)]
        stack.extend(c for c in x.children if not isinstance(c, str))
    return _measured(root)


def _is_wrapper(node: Node, root: Node) -> bool:
    """Whether an element is more than its name says: all of the page's article, main or h1 elements are in it, or most of
    its text if none of these stands outside, or prose where its name is one for links."""
    inside = [n - (node.tag == tag) for n, tag in zip(node.holds, ("article", "main", "h1"), strict=True)]
    if any(n and n == whole for n, whole in zip(inside, root.holds, strict=True)):
        return True
    if node.holds == root.holds and 2 * (node.length - node.linked) > root.length - root.linked:
        return True
    return node.cut == "links" and node.length > 80 and node.linked < 0.25 * node.length


def blocks(node: Node, out: list[str]) -> list[str]:
    """The texts of a subtree's blocks in page order."""
    run: list[str] = []

    def end() -> None:
        if run and (text := _SPACE.sub(" ", unescape("".join(run))).strip()):
            out.append(text)
        run.clear()

    stack = [(node, False)]
    while stack:
        x, closing = stack.pop()
        if closing:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br" or x.tag == "wbr":
            run.append(" " if x.tag == "br" else "")
        else:
            inline = x.tag in _INLINE
            if not inline:
                end()
                stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children))
    end()
    return out


def _paragraphs(root: Node) -> list[Node]:
    """Elements that are paragraphs, and others that hold text or inline elements of their own."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        own = x.tag in _PARAGRAPH or any(c.strip() if isinstance(c, str) else c.tag in _INLINE and c.children for c in x.children)
        if own and x.tag not in _INLINE and x.tag != "h1":
            found.append(x)
        stack.extend(c for c in x.children if not isinstance(c, str) and c.tag not in _INLINE)
    return found


def _lifted(best: Node) -> Node:
    """The outermost article around the best container, or else the innermost main; and its parent, if that holds only
    sections of an article that are not mostly links."""
    x, article, main = best, None, None
    while x is not None:
        if x.tag == "article":
            article = x
        elif x.tag == "main" and main is None:
            main = x
        x = x.parent
    x = article or main or best
    while x.tag in ("article", "section") and x.parent is not None and all(_is_section(c) for c in x.parent.children):
        x = x.parent
    return x


def _is_section(x: Node | str) -> bool:
    if isinstance(x, str):
        return not x.strip()
    return x.length == 0 or (x.tag in ("article", "section", "h1") or x.tag in _PARAGRAPH) and 2 * x.linked < x.length


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none."""
    if not html:
        return ""
    text = _best_text(parse(html))
    if len(text) < TINY and len(whole := _best_text(parse(html, names=False))) > 5 * len(text):
        return whole
    return text


def _best_text(root: Node) -> str:
    scored: list[Node] = []
    for p in _paragraphs(root):
        if not p.length:
            continue
        points = (1 + p.commas + min(p.length / 100, 3)) * (1 - p.linked / p.length)
        up, part = (p if p.tag not in _PARAGRAPH else p.parent), 1.0
        for level in range(5):
            if up is None:
                break
            if up.score == 0.0:
                scored.append(up)
                up.score = 1e-9 + (25 if up.tag in ("article", "main") else 10 * up.likely)
            up.score += points * part
            part = 0.5 if level == 0 else part * 0.4
            up = up.parent
    if not scored:
        return "\n".join(blocks(root, []))
    final: dict[int, float] = {}
    for x in scored:
        final[id(x)] = x.score * (1 - x.linked / max(1, x.length))
    best = _lifted(max(scored, key=lambda x: final[id(x)]))
    if best.parent is None:
        return "\n".join(blocks(best, []))
    least = max(10.0, final.get(id(best), 0.0) * 0.2)
    out: list[str] = []
    for x in best.parent.children:
        if x is best:
            keep = True
        elif isinstance(x, str):
            keep = False
        elif final.get(id(x), 0.0) >= least:
            keep = True
        elif x.tag in _PARAGRAPH or x.tag == "h1":
            keep = x.length > 0 and (x.tag == "h1" or x.tag[0] == "h" and x.linked == 0 or x.length > 80 and x.linked < 0.25 * x.length or x.linked == 0 and x.tag == "p")
        else:
            keep = False
        if keep:
            blocks(x, out)
    return "\n".join(out)


def text_column():
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in releasing(batches):
            yield pages.map(main_text, na_action=None) if len(pages) else pd.Series([], dtype=object)

    return extract


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages (page_id, url, html).

    A null or empty page, and one without text outside of menus and the like, has an empty text. Rows that repeat are
    kept each, null ids and addresses are kept as null, and an empty table gives no rows. Other columns are ignored."""
    x = pages.select(F.col("page_id").cast("long"), "url", text_column()(F.col("html")).alias("text"))
    return x.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
