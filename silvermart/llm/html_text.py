"""Main text of web pages by composite text density.

Every node of a page gets a density: its characters per tag, scaled down the more of them are
links. The sum of a node's child densities is largest where many dense blocks stand side by side,
which is the article. The lowest density on the way from body to that node is the threshold that
each neighbour on this way must reach by itself to belong to the article as well; headings belong
to it in any case. An article or main element on the way is the article whatever its neighbours'
densities. Menus, sidebars, forms, adverts, comments
and the like are known by their tags, roles and names and never count. A name alone is not believed
where the article's heading stands in that part, nor, unless its word leaves no doubt, where hardly
any text would be left without the parts of that name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silvermart.llm.common import add_columns, text_parts

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p "
    "pre section summary table tbody tfoot thead tr ul caption".split()
)
BREAKS = frozenset(("br", "td", "th"))
CLOSES = {  # a start tag ends an open element of these kinds, up to the nearest of the bounds
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# Elements that hold no article text.
APART = frozenset(
    "head title script style noscript template iframe object embed svg canvas math audio video "
    "nav footer aside form button select textarea input label fieldset dialog menu".split()
)
APART_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "toolbar form".split()
)
# Words in a class or id that say the same.
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer foot copyright "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "login share sharing social related recommended recommendations comment comments commentlist "
    "disqus reply replies respond discussion pagination pager toolbar widget widgets form search "
    "skip hidden disclaimer alert rail".split()
)
# Those of them that name no layout around an article.
CERTAIN_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs footer "
    "copyright cookie cookies consent gdpr sidebar sidebars newsletter disclaimer comment comments "
    "commentlist disqus replies respond".split()
)
# Parts of a name are the article if they hold so many times the text that is left without them, and
# at least so many characters outside of links.
OUTWEIGHS = 4
LEAST_CHARS = 250
# Whole names that say so outside the article, and words that turn a name into another statement.
APART_OUTSIDE = frozenset(
    "header masthead banner topbar hero site-header page-header main-header".split()
)
ABOUT_OTHERS = frozenset("has have no not with without".split())
APART_ARTICLES = frozenset("comment comments reply related sponsored ad".split())
NEVER_APART = frozenset(("html", "body", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
    re.I,
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DENSE = re.compile(r"\s+")


@dataclass
class Tree:
    """Nodes in page order; node 0 is the page itself."""

    tag: list
    parent: list
    apart: list  # menu, advert, ...: the node and all below
    pieces: list  # (node, decoded text); None is a space, False the edge of a block
    named: dict  # nodes that are apart by the word of a name alone, if they are


def _is_apart(tag: str, attributes: str, in_article: bool) -> bool | str:
    """Whether an element is no article text; the word if only a name says so."""
    if tag in NEVER_APART:
        return False
    if tag in APART or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    said = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "role":
            if value.strip().lower() in APART_ROLES:
                return True
        else:
            for whole in value.split():
                words = {w.lower() for w in _NAME.findall(whole)}
                if words & ABOUT_OTHERS:
                    continue
                if tag == "article":
                    words &= APART_ARTICLES
                if found := words & APART_NAMES:
                    said = min(found & CERTAIN_NAMES or {said or min(found)})
                elif not in_article and whole.lower() in APART_OUTSIDE:
                    return True
    return said or False


def _believe(tree: Tree) -> None:
    """Marks as apart what stands in parts that are apart by name, where the name is believed."""
    n = len(tree.tag)
    chars, plain = [0] * n, [0] * n
    linked, heads = [False] * n, [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"
        heads[i] = tree.tag[i] in ("h1", "main")
    for node, text in tree.pieces:
        if text and not tree.apart[node]:
            size = len(_DENSE.sub("", text))
            chars[node] += size
            plain[node] += size * (not linked[node])
    own = chars[:]
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not tree.apart[i]:
            chars[up] += chars[i]
            plain[up] += plain[i]
            heads[up] |= heads[i]
    named = {i: word for i, word in tree.named.items() if not heads[i]}
    while True:
        # Every round lifts a word, of which there are few, or is the last one.
        inside, free = [False] * n, own[0]
        of_word: Counter = Counter()
        plain_of: Counter = Counter()
        for i in range(1, n):
            inside[i] = inside[tree.parent[i]]
            if i in named and not inside[i]:
                inside[i] = True
                of_word[named[i]] += chars[i]
                plain_of[named[i]] += plain[i]
            if not inside[i]:
                free += own[i]
        lifted = {
            word
            for word, size in of_word.items()
            if word not in CERTAIN_NAMES
            and plain_of[word] >= max(LEAST_CHARS, OUTWEIGHS * free)
        }
        if not lifted:
            break
        word = max(lifted, key=lambda w: (plain_of[w], w))
        named = {i: w for i, w in named.items() if w != word}
    for i in range(1, n):
        tree.apart[i] = tree.apart[i] or inside[i]


def parse(page: str) -> Tree:
    tree = Tree(["#page"], [-1], [False], [], {})
    tag_of, parent_of, apart_of, pieces = tree.tag, tree.parent, tree.apart, tree.pieces
    stack, at, end = [0], 0, len(page)
    open_tags: Counter = Counter()

    def close(upto: int) -> None:
        while len(stack) > upto:
            tag = tag_of[stack.pop()]
            open_tags[tag] -= 1
            if tag in BLOCK:
                pieces.append((0, False))

    def add_text(raw: str) -> None:
        if raw:
            pieces.append((stack[-1], html.unescape(raw) if "&" in raw else raw))

    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            add_text(page[at:])
            break
        add_text(page[at : found.start()])
        at = found.end()
        slash, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1) if open_tags[name] else ():
                if tag_of[stack[depth]] == name:
                    close(depth)
                    break
            continue
        if name in BREAKS:
            pieces.append((stack[-1], None))
        ends, bounds = CLOSES.get(name, (frozenset(), frozenset()))
        if any(open_tags[e] for e in ends) or (name in BLOCK and open_tags["p"]):
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tag_of[stack[depth]]
                if open_tag in ends or (open_tag == "p" and name in BLOCK):
                    close(depth)
                    break
                if open_tag in bounds or (
                    not ends and open_tag in BLOCK and open_tag != "p"
                ):
                    break
        if name in BLOCK:
            pieces.append((0, False))
        node = len(tag_of)
        tag_of.append(name)
        parent_of.append(stack[-1])
        in_article = open_tags["article"] + open_tags["main"] > 0
        apart = apart_of[stack[-1]] or _is_apart(name, attributes, in_article)
        if isinstance(apart, str):
            tree.named[node] = apart
        apart_of.append(apart is True)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            closing = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        stack.append(node)
        open_tags[name] += 1
    if tree.named:
        _believe(tree)
    return tree


def _density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Characters per tag, less the more of them are links; `share` is that of the page."""
    if not chars:
        return 0.0
    mixed = chars / max(1, chars - links) * links + share * chars
    base = max(math.log(math.log(mixed + math.e)), 0.05)
    free = max(1.0, chars / max(1, links) * max(1, tags) / max(1, link_tags))
    return chars / max(1, tags) * math.log(free) / base


def densities(tree: Tree) -> tuple[list[float], list[int], list[int]]:
    """Per node its link-adjusted characters per tag, its characters and its link characters."""
    n = len(tree.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"
    for node, text in tree.pieces:
        if text and (size := len(_DENSE.sub("", text))):
            chars[node] += size
            links[node] += size * linked[node]
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    share = links[0] / max(1, chars[0])
    result = [_density(*of, share) for of in zip(chars, links, tags, link_tags)]
    return result, chars, links


def main_node(tree: Tree) -> tuple[int, set[int], set[int]]:
    """The root of the article, and the nodes and the numbers of pieces below it that are not of it.

    The root is -1 if the page has no text outside of menus and the like.
    """
    density, chars, links = densities(tree)
    n = len(tree.tag)
    children: list[list[int]] = [[] for _ in range(n)]
    sums = [0.0] * n
    direct = [False] * n
    for node, text in tree.pieces:
        if text and not tree.apart[node] and not text.isspace():
            direct[node] = True
    for i in range(1, n):
        if not tree.apart[i]:
            children[tree.parent[i]].append(i)
            sums[tree.parent[i]] += density[i]
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    best, most = -1, 0.0
    for i in range(n):
        if tree.apart[i] or not chars[i]:
            continue
        # Without children the node is its own only part.
        value = sums[i] if children[i] else density[i] if direct[i] else 0.0
        if value > most:
            best, most = i, value
    if best < 0:
        has_text = next((i for i in range(n) if direct[i]), -1)
        return (body if has_text >= 0 else -1), set(), set()

    path, up = [], best
    while up >= 0:
        path.append(up)
        if up == body:
            break
        up = tree.parent[up]
    threshold = min(density[i] for i in path)
    whole = next((i for i in reversed(path) if tree.tag[i] in ("article", "main")), None)
    if whole is not None:
        return whole, set(), set()
    return path[-1], *_sparse(tree, path, threshold, density, chars, links)


def _sparse(
    tree: Tree,
    path: list[int],
    threshold: float,
    density: list[float],
    chars: list[int],
    links: list[int],
) -> tuple[set[int], set[int]]:
    """What stands beside the way up and is below the threshold: nodes, and numbers of pieces.

    Blocks are judged one by one. Loose text between two blocks is judged together with the inline
    elements in it. Around an inline element of the way nothing is sparse.
    """
    n = len(tree.tag)
    judged = {up for root, up in zip(path, path[1:]) if tree.tag[root] in BLOCK}
    on_path = set(path)
    nodes: set[int] = set()
    # Per node the child of the way it is in, itself if it is on the way.
    branch = list(range(n))
    for i in range(1, n):
        up = tree.parent[i]
        if i in on_path:
            continue
        if up not in on_path:
            branch[i] = branch[up]
        elif up in judged and tree.tag[i] in BLOCK and tree.tag[i] not in HEADINGS:
            if chars[i] and density[i] < threshold:
                nodes.add(i)
    share = links[0] / max(1, chars[0])
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"

    pieces: set[int] = set()
    run: list[int] = []

    def close() -> None:
        seen: set[int] = set()
        size = link_size = 0
        for at in run:
            node, text = tree.pieces[at]
            length = len(_DENSE.sub("", text))
            size += length
            link_size += length * linked[node]
            while node not in on_path and node not in seen:
                seen.add(node)
                node = tree.parent[node]
        link_tags = sum(tree.tag[i] == "a" for i in seen)
        if size and _density(size, link_size, len(seen), link_tags, share) < threshold:
            pieces.update(run)
        run.clear()

    for at, (node, text) in enumerate(tree.pieces):
        if text is False:
            close()
        elif text and not tree.apart[node]:
            top = branch[node]
            level = top if top in on_path else tree.parent[top]
            if level in judged and (top == level or tree.tag[top] not in BLOCK):
                run.append(at)
    close()
    return nodes, pieces


def _link_lists(tree: Tree) -> set[int]:
    """Lists of three or more items that are nothing but links: menus without a name.

    In an article element such a list is the article's own.
    """
    n = len(tree.tag)
    article = [False] * n
    for i in range(1, n):
        article[i] = article[tree.parent[i]] or tree.tag[i] == "article"
    lists = {
        i
        for i in range(n)
        if tree.tag[i] in ("ul", "ol") and not tree.apart[i] and not article[i]
    }
    if not lists:
        return lists
    items = dict.fromkeys(lists, 0)
    for i in range(n):
        if tree.tag[i] == "li" and tree.parent[i] in items:
            items[tree.parent[i]] += 1
    _, chars, links = densities(tree)
    return {i for i in lists if items[i] >= 3 and links[i] >= 0.9 * max(1, chars[i])}


def blocks(page: str | None) -> list[str]:
    """The article's blocks in page order, white space inside each turned into one space."""
    if not page:
        return []
    tree = parse(page)
    root, sparse, loose = main_node(tree)
    if root < 0:
        return []
    left_out = _link_lists(tree) | sparse
    n = len(tree.tag)
    inside = [False] * n
    for i in range(root, n):
        up = tree.parent[i]
        inside[i] = i == root or (
            up >= 0 and inside[up] and not tree.apart[i] and i not in left_out
        )
    found: list[str] = []
    parts: list[str] = []
    for at, (node, text) in enumerate(tree.pieces):
        if text is False:
            found.append(" ".join("".join(parts).split()))
            parts = []
        elif inside[node] and at not in loose:
            parts.append(" " if text is None else text)
    found.append(" ".join("".join(parts).split()))
    return [b for b in found if b]


def main_text(page: str | None) -> str:
    return "\n".join(blocks(page))


def extract(pages: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """`pages` with the main text and its length in code points in place of the html.

    Pages that are NULL, empty or without an article give an empty text and 0. Each row is read by
    itself, so repeated rows give repeated results; columns of the same names are replaced.
    """

    def read(batch: pa.RecordBatch):
        for part in text_parts(batch, html_column):
            texts = [main_text(page) for page in part.column(html_column).to_pylist()]
            yield part, [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    fields = [T.StructField(text_column, T.StringType()), T.StructField("n_chars", T.LongType())]
    return add_columns(pages, fields, read, without=(html_column,))
