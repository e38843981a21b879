"""Main text of web pages by tree scoring.

A page is read as a tree of block elements. Each paragraph passes points for its length and commas to
its ancestors, less with each level; a container's points are discounted by its link density. The best
container and the siblings that look like its continuation give the blocks of the article.

Defined cases: null and empty pages give an empty text; unclosed and cut-off markup is closed at the
end; nothing is dropped for its length; a page whose only text stands in containers named like menus or
adverts gives that text. Other columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HARD = (
    r"</?(?:address|article|aside|blockquote|body|dl|d[dt]|fieldset|figure|footer|form|h[1-6]|header|html|li|main|nav|ol|p|pre|section|table|t[dhr]|ul)\b"
    r"|<(?:svg|select|button|datalist|annotation|iframe)\b"
)
#: A control, drawing, frame or annotation without its end tag before a block that it cannot hold ends at the next block.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?:svg|math|annotation(?:-xml)?)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|object|canvas)\b[^>]*>"
    r".*?(?:</(?P=raw)\b[^>]*>|$)"
    r"|<(?P<short>svg|select|button|datalist|annotation-xml|annotation|iframe)\b[^>]*>"
    rf"(?:(?:(?!{_HARD}).)*?</(?P=short)\b[^>]*>|.*?(?={_HARD}|</?(?:div|hr|center|dir|details|dialog|hgroup|menu|search|summary|tbody|thead|tfoot|caption|figcaption)\b|$))"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|$)|<[!?/][^>]*(?:>|$)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul caption head".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("hr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
DROPPED = frozenset("head nav footer aside form menu dialog search fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb"
    " breadcrumbs comment comments commentlist respond disqus discussion cookie cookies consent gdpr footer footnav header"
    " masthead menu nav navbar navigation newsletter notice notices alert notification paywall subscribe subscription"
    " popup modal overlay pagination pager related recommended recommendations share sharing social sidebar sidebars"
    " skip toolbar topbar widget widgets reply replies signup login thread threads".split()
)
#: Words that sections of an article bear too; inside one their containers are judged by what they hold.
SECTION_WORDS = frozenset("alert discussion header menu notice notices related".split())
#: Words that name nothing but what is no article, whatever word stands beside them.
ALWAYS = frozenset(
    "advert adverts advertisement advertising adsense sponsored breadcrumb breadcrumbs comment comments commentlist respond disqus"
    " cookie cookies consent gdpr newsletter paywall subscribe pagination sidebar sidebars reply replies signup login".split()
)
#: Words of layout: beside a word of the list they tell nothing. Any other word may make a name of the article's own, as in "ad-hoc".
LAYOUT = frozenset(
    "area bar block body bottom box boxes button buttons card cards center close col column columns container content cta fixed float"
    " footer full global group head heading holder horizontal icon icons image img in inline inner item items label large layout left"
    " link links list lower main mid middle mini mobile module more native outer page panel pane placeholder post posts primary rail"
    " region right row secondary section side site slot small space sticky strip tab tabs title top unit upper vertical view"
    " wide wrap wrapper zone js css id no nofollow desktop tablet print hidden visible us on by the a of".split()
)
CONTENT_TAGS = frozenset(["html", "body", "main", "article"])
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "score", "linked", "chars", "dropped", "inside", "suspect")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.inside = tag in ("article", "main") or parent is not None and parent.inside  # an article's or main element's
        self.children: list[Node] = []
        self.parts: list = []  # texts and child nodes in page order
        self.score, self.linked, self.chars = 0.0, 0, 0
        self.suspect = ""  # the word of the list in its class or id


def _unwanted(tag: str, attrs: str, inside_article: bool) -> tuple[bool, str]:
    """Whether an element is dropped in any case, and else the word of the list for which it is to be judged."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True, ""
    if not attrs or tag in ("html", "body"):
        return False, ""
    suspect = ""
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and tag not in CONTENT_TAGS and not (inside_article and (tag == "p" or tag in HEADINGS)):
            words = [w for w in SPLIT.split(value) if w]
            words = [w.lower() for w in SPLIT.split(" ".join(words).lower()) if w] + [w.lower() for w in words]
            for k, word in enumerate(words):
                if word in UNWANTED and not (k and words[k - 1] in ("no", "has", "with", "without")):
                    if not (word == "header" and inside_article) and (not suspect or suspect in SECTION_WORDS):
                        own = [w for w in words if w not in UNWANTED and w not in LAYOUT and not w.isdigit() and len(w) > 2]
                        suspect = "related" if inside_article and own and word not in ALWAYS else word
        elif name == "role" and value.lower() in DROPPED_ROLES:
            return True, ""
        elif name == "hidden" and not value or name == "aria-hidden" and value.lower() == "true":
            return True, ""
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True, ""
    return False, suspect


def _judge(nodes: list[Node]) -> None:
    """Drop the containers whose class or id has a word of the list, except two kinds with few links: wrappers of
    the page (its main element or h1, and half its text), and sections of an article that are mostly long paragraphs."""
    sums = {id(n): [n.chars, n.linked, 0, n.tag in ("main", "h1")] for n in nodes}  # characters, linked, in long paragraphs, title or main
    for node in reversed(nodes[1:]):
        own = sums[id(node)]
        if node.dropped:
            continue
        if node.tag in ("p", "pre", "blockquote") and own[0] >= 80 and own[1] < 0.25 * own[0]:
            own[2] = own[0]
        up = sums[id(node.parent)]
        for k in range(3):
            up[k] += own[k]
        up[3] = up[3] or own[3]
    total = sums[id(nodes[0])][0]
    for node in nodes[1:]:  # parents before children
        chars, linked, prose, titled = sums[id(node)]
        if node.parent.dropped:
            node.dropped = True
        elif node.suspect and not node.dropped:
            wrapper = titled and 2 * chars >= total
            section = node.inside and node.suspect in SECTION_WORDS and 2 * prose >= chars
            node.dropped = not (chars and linked < 0.25 * chars and (wrapper or section))


def parse(html: str, heed: bool = True) -> Node:
    """The tree of a page. heed: drop containers for the words of the list in their class or id."""
    root = node = Node("#root", None, False)
    nodes = [root]
    opened: Counter[str] = Counter()
    links = at = 0
    for token in TOKEN.finditer(html):
        if token.start() > at:
            _add_text(node, html[at : token.start()], links)
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            links = 0 if token["end"] else 1
        elif name == "br":
            _add_text(node, " ", 0)
        elif name in BLOCKS:
            links = 0
            if token["end"]:
                if opened[name]:
                    while node.tag != name:
                        node = _close(node, opened)
                    node = _close(node, opened)
            elif name in VOID:
                node.parts.append(Node(name, node, False))
            else:
                node = _closed_for(node, name, opened)
                child = Node(name, node, node.dropped)
                if not child.dropped:
                    child.dropped, child.suspect = _unwanted(name, token["attrs"], node.inside)
                node.children.append(child)
                node.parts.append(child)
                nodes.append(child)
                opened[name] += 1
                node = child
    if at < len(html):
        _add_text(node, html[at:], links)
    if heed and any(n.suspect for n in nodes):
        _judge(nodes)
    for node in reversed(nodes[1:]):  # children before parents
        if not node.dropped:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return root


def _close(node: Node, opened: Counter[str]) -> Node:
    opened[node.tag] -= 1
    return node.parent


def _closed_for(node: Node, name: str, opened: Counter[str]) -> Node:
    """The open element that a new block goes into: open paragraphs and list items of its kind end."""
    while node.tag in CLOSED_BY_BLOCK or node.tag in HEADINGS and name in HEADINGS:
        node = _close(node, opened)
    if name in ("li", "td", "th", "tr", "dt", "dd"):
        stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(name, ("table", "tbody", "thead", "tfoot"))
        same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
        if any(opened[tag] for tag in same):
            up = node
            while up.parent is not None and up.tag not in stop and up.tag not in same:
                up = up.parent
            if up.tag in same:
                while node is not up:
                    node = _close(node, opened)
                return _close(node, opened)
    return node


def _add_text(node: Node, raw: str, links: int) -> None:
    text = unescape(raw) if "&" in raw else raw
    node.parts.append(text)
    if not node.dropped:
        n = len(text.strip())
        node.chars += n
        node.linked += n if links else 0


def _nodes(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        now = stack.pop()
        if not now.dropped:
            yield now
            stack.extend(reversed(now.children))


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def score(root: Node) -> Node | None:
    """Pass points up from the paragraphs; the container with most after the discount for links."""
    touched: list[Node] = []
    for node in _nodes(root):
        own = [p for p in node.parts if isinstance(p, str)]
        text = " ".join("".join(own).split())
        if not text or node.tag in HEADINGS or node.tag not in PARAGRAPHS and len(text) < 25:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - density(node))
        up, level = (node.parent if node.tag in PARAGRAPHS else node), 1
        while up is not None and level <= 4:
            if not up.score:
                touched.append(up)
            up.score += points / level
            up, level = up.parent, level + 1 if level > 1 else 2
    best, most = None, 0.0
    for node in touched:
        bonus = 2.0 if node.tag == "article" else 1.25 if node.tag == "main" else 1.0
        value = node.score * (1 - density(node)) * bonus
        if value > most:
            best, most = node, value
    return _whole_article(best)


def _whole_article(best: Node | None) -> Node | None:
    """The article that the best container is part of, if it is marked as one; a main element only if it holds little else."""
    up = best
    while up is not None and up.tag != "article" and not (up.tag == "main" and up.chars <= 1.3 * best.chars):
        up = up.parent
    return up or best


def _blocks(node: Node, out: list[str], inside_header: bool = False) -> None:
    """Texts of the blocks below node in page order; explicit stack, for pages nested however deep."""
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        now, k = stack.pop()
        while k < len(now.parts):
            part = now.parts[k]
            k += 1
            if isinstance(part, str):
                run.append(part)
                continue
            end()
            if not part.dropped:
                stack.append((now, k))
                stack.append((part, 0))
                break
        else:
            end()
    end()


def _sentences(node: Node) -> bool:
    """Whether a container holds nothing but paragraphs, the last of which ends as a sentence does, and no links."""
    if node.linked or not node.children or any(n.tag != "p" for n in node.children) or any(isinstance(p, str) and p.strip() for p in node.parts):
        return False
    last = "".join(p for p in node.children[-1].parts if isinstance(p, str)).rstrip(" \t\n\r\f\"'\u201d\u2019\u00bb)")
    return last.endswith((".", "!", "?", "\u2026", "\u3002"))


def main_text(html: str) -> str:
    # where the words of the list leave nothing, they are not heeded: the best container is never dropped for its name
    return _main_text(parse(html)) or _main_text(parse(html, heed=False))


def _main_text(root: Node) -> str:
    best = score(root)
    out: list[str] = []
    if best is None:
        _blocks(root, out)
        return "\n".join(out)
    parent = best.parent
    siblings = parent.children if parent is not None and best.tag not in ("main", "body") else [best]
    if best.tag == "article":  # more articles beside it are of the page's text if they score like it
        siblings = [node for node in siblings if node.tag == "article"]
    if best.tag == "article" and not any(n.tag in HEADINGS for n in _nodes(best)) and parent is not None:
        # an article without a heading of its own has that before it in its main element
        title = [n for n in parent.children[: parent.children.index(best)] if n.tag == "h1" and not n.dropped and density(n) < 0.25]
        siblings = title[-1:] + siblings
    limit = best.score * 0.2
    for node in siblings:
        if node is best:
            take = True
        elif node.dropped:
            take = False
        elif node.tag in PARAGRAPHS:
            take = density(node) < 0.25
        else:
            take = density(node) < 0.25 and (node.score >= limit or _sentences(node))
        if take:
            _blocks(node, out)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
