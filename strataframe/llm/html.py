"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. A page becomes a tree of its block-level elements, with its text blocks as leaves.
All pages of each host, and of each layout of a host (pages whose blocks have the same paths down to ``LAYOUT_DEPTH``
tags), are aligned by simple tree matching into a template: matched nodes are counted, unmatched subtrees are added where they stand.
A leaf of the template is constant if one text stands there in more than half of the pages that have the leaf, two at
least; the others are slots. Every page is then aligned with the templates of its host and layout: a block that meets a
constant leaf and has its text is template, all that meets a slot or nothing is content. Matching maximises
the number of matched nodes, equal texts counting twice, and a node may only match one with its tag below matched parents.

What the page's own markup calls a menu, header, footer, sidebar, notice, advert, form, script, style or comment
is no content even where it varies. Two things are less plain and are settled by markup and template together: an
element inside ``article`` or ``main`` with a class word that may mean either (``AMBIGUOUS``) goes only if it is constant,
and other blocks there, which may repeat rightly, only if all pages of the scope that have the leaf, ``UNANIMOUS`` or more, have them.

Blocks are separated by block-level tags; a line break is white space. Character references are
decoded, white space becomes single spaces, empty blocks vanish, blocks are
joined by \\n.

Templates are learnt from all pages of a scope (host, or layout where a host has several), ``PART`` pages by themselves and then the parts' trees together;
pages of the same blocks count once, as copies tell nothing. A leaf keeps ``VOTES`` texts with least counts of theirs and the most that any
count may lack (a Misra-Gries summary, which holds every text of more than a share of 1 / ``VOTES``); scopes where that leaves a majority open are
learnt again with all texts counted. Pages are read whole, all of them are aligned, and there is no limit to the nodes of a tree. Only trees,
with hashes for texts, are exchanged; html is not, unless the templates of all hosts exceed ``broadcast_bytes``.

Cases: null or empty html gives an empty text; a page without any slot block
gives an empty text; pages without a readable host share the host ''; a host
with one page has no template; repeated rows are repeated, whatever their page_id; a null
page_id keeps its row; other columns are ignored; an empty table gives an empty
result. Unclosed tags, comments and quotes, very deep trees and very long pages take time linear in their length to parse.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, saved

LAYOUT_DEPTH = 4
#: Pages of a scope that are merged in one task before the parts are.
PART = 256
#: Texts counted at a leaf.
VOTES = 32
#: Pages that must all have a block for it to go although it stands in ``article`` or ``main``.
UNANIMOUS = 5
#: Size up to which the templates of all hosts are sent to each executor.
BROADCAST_BYTES = 8_000_000
#: Cells up to which the table of one list of children against another is kept whole.
CELLS = 4_000_000
#: Names of subtrees that may be kept from one matching to the next.
NAMES = 100_000

#: Tags by role (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select option button noframes object".split())
#: Of these, tags whose content runs to the end of the page where they are not closed.
ENDLESS = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER = frozenset("nav footer aside form menu dialog head fieldset".split())
CONTENT = frozenset("article main".split())
#: Tags that an opening tag closes if they are open.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
}
#: Class words that name boilerplate anywhere, and those that may also name a part of an article.
PLAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|popup|modal|menu|navbar|nav|navigation|breadcrumbs?|sidebar"
    r"|footer|masthead|site-header|topbar|comments?|replies|respond|disqus|sharing|social|newsletter|subscribe|login|signup|pager|pagination)(?:$|[\s_-])",
    re.I,
)
AMBIGUOUS = re.compile(r"(?:^|[\s_-])(?:promo\w*|banner|notice|side|header|related|share|search|widget|skip)(?:$|[\s_-])", re.I)
ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu", re.I)
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACES = re.compile(r"\s+")


# --- parsing ------------------------------------------------------------------


class Node:
    __slots__ = ("tag", "kids", "boiler", "weak", "content", "parent", "depth")

    def __init__(self, tag: str, parent: Node | None, boiler: bool, weak: bool, content: bool):
        self.tag, self.parent, self.boiler, self.weak, self.content = tag, parent, boiler, weak, content
        self.depth = parent.depth + 1 if parent else 0
        self.kids: list[Node | str] = []


def _role(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """(boilerplate, perhaps boilerplate) by tag and attributes; inside: of article or main."""
    if tag in BOILER or (tag == "header" and not inside):
        return True, False
    weak = False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            if ROLE.search(value):
                return True, False
        elif name == "hidden":
            return True, False
        elif name == "aria-hidden":
            if value.lower() == "true":
                return True, False
        elif tag not in ("body", "html", "article", "main"):
            if PLAIN.search(value):
                return True, False
            if AMBIGUOUS.search(value):
                if not inside:
                    return True, False
                weak = True
    return False, weak


def parse(html: str) -> Node:
    """A tree of tags and texts. Unclosed and misnested tags are closed where the next block needs it."""
    root = node = Node("#root", None, False, False, False)
    at, n = 0, len(html)
    last = html.rfind(">")
    quotes = True  # until a tag is met whose quotes do not end
    opened: Counter = Counter()
    endless: set[str] = set()  # tags that are not closed any more
    while at < n:
        start = html.find("<", at)
        if start < 0 or start > last:
            end = html.find("<!--", at)
            node.kids.append(html[at:] if end < 0 else html[at:end])
            break
        if start > at:
            node.kids.append(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith(("<!", "<?"), start):
            at = html.find(">", start) + 1
            continue
        m = OPENING.match(html, start)
        if m is None:
            node.kids.append("<")
            at = start + 1
            continue
        rest = ATTRIBUTES.match(html, m.end()) if quotes else None
        if rest:
            at, attrs = rest.end(), rest[0][:-1]
        else:
            quotes = False
            at = html.find(">", m.end() - 1) + 1
            attrs = html[m.end() : at - 1]
        tag = m[2].lower()
        if m[1]:
            up = node if opened[tag] > 0 else root
            while up is not root and up.tag != tag:
                if up.tag in CONTENT and tag not in ("body", "html"):
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = _closed(node, up.parent, opened)
            elif tag in BLOCK:
                node.kids.append(Node(tag, node, node.boiler, node.weak, node.content))
            continue
        if tag in BLOCK:
            up = node
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag in CLOSES.get(tag, ()) or up.tag == "p":
                node = _closed(node, up.parent, opened)
        boiler, weak = _role(tag, attrs, node.content)
        new = Node(tag, node, node.boiler or tag in RAW or boiler, node.weak or weak, node.content or tag in CONTENT)
        node.kids.append(new)
        if attrs.endswith("/") or tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) if tag not in endless else None
            if end:
                at = end.end()
            else:
                endless.add(tag)
                if tag in ENDLESS:
                    at = n
        else:
            opened[tag] += 1
            node = new
    return root


def _closed(node: Node, to: Node, opened: Counter) -> Node:
    while node is not to:
        opened[node.tag] -= 1
        node = node.parent
    return to


class Tree:
    """Block-level elements in page order, each before its children; texts are leaves with the tag ``#``.

    ``text`` holds a leaf's hash (0 for elements), ``marked`` whether it stands in article or main, ``weak`` whether its class is ambiguous.
    """

    __slots__ = ("tag", "up", "text", "marked", "weak", "kids", "end")

    def __init__(self):
        self.tag: list[str] = []
        self.up: list[int] = []
        self.text: list[int] = []
        self.marked: list[bool] = []
        self.weak: list[bool] = []

    def add(self, tag: str, up: int, text: int = 0, marked: bool = False, weak: bool = False) -> int:
        self.tag.append(tag)
        self.up.append(up)
        self.text.append(text)
        self.marked.append(marked)
        self.weak.append(weak)
        return len(self.tag) - 1

    def finish(self) -> Tree:
        """Children of each node, and the place after its last descendant."""
        n = len(self.tag)
        self.kids = [[] for _ in range(n)]
        self.end = list(range(1, n + 1))
        for i in range(1, n):
            self.kids[self.up[i]].append(i)
        for i in range(n - 1, 0, -1):
            u = self.up[i]
            if self.end[i] > self.end[u]:
                self.end[u] = self.end[i]
        return self

    def without_empty(self) -> Tree:
        """The same without elements that hold no leaf."""
        keep = [t == "#" for t in self.tag]
        for i in range(len(keep) - 1, 0, -1):
            keep[self.up[i]] |= keep[i]
        if keep:
            keep[0] = True
        return self.only(keep)

    def only(self, keep: list[bool]) -> Tree:
        """The nodes kept; whoever is kept has a kept parent."""
        out, place = Tree(), {}
        for i, k in enumerate(keep):
            if k:
                place[i] = out.add(self.tag[i], place.get(self.up[i], -1), self.text[i], self.marked[i], self.weak[i])
        return out.finish()


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def tree_of(html: str | None) -> tuple[Tree, list[str]]:
    """A page's tree, boilerplate by markup left out, and the texts of its leaves in order."""
    tree, texts = Tree(), []
    owner = tree.add("#root", -1)
    if not html:
        return tree.finish(), texts
    root = parse(html)
    parts: list[str] = []

    def flush(node: Node) -> None:
        text = SPACES.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            texts.append(text)
            tree.add("#", owner, _hash(text), node.content, node.weak)

    block = root  # the block-level element that text belongs to
    above: list[tuple[Node, int]] = []
    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag in BLOCK:
            flush(block)
            above.append((block, owner))
            block, owner = node, tree.add(node.tag, owner)
        if i < len(node.kids):
            stack.append((node, i + 1))
            kid = node.kids[i]
            if isinstance(kid, str):
                parts.append(kid)
            elif kid.boiler:
                if kid.tag in BLOCK:
                    flush(block)
            elif kid.tag == "br":
                parts.append(" ")
            elif kid.tag == "hr":
                flush(block)
            else:
                stack.append((kid, 0))
        elif node.tag in BLOCK:
            flush(block)
            block, owner = above.pop()
        elif node is root:
            flush(block)
    return tree.without_empty(), texts


def layout_of(tree: Tree) -> int:
    """Hash of the paths, cut at ``LAYOUT_DEPTH`` tags, of a page's leaves outside of its marked content."""
    path: list[tuple[str, ...]] = [()]
    for i in range(1, len(tree.tag)):
        up = path[tree.up[i]]
        path.append((*up, tree.tag[i]) if len(up) < LAYOUT_DEPTH and tree.tag[i] != "#" else up)
    return _hash(*sorted({"/".join(path[i]) for i, t in enumerate(tree.tag) if t == "#" and not tree.marked[i]}))


# --- simple tree matching ------------------------------------------------------


class Names:
    """Numbers of a tree's equal subtrees, of its subtrees equal but for texts, their sizes and numbers of leaves. Trees that are matched share
    ``names``; ``plain`` holds the weights found for two shapes without a common text."""

    __slots__ = ("names", "plain", "used", "exact", "shape", "size", "leaves")

    def __init__(self, t: Tree, names: dict | None = None):
        self.names: dict = {} if names is None else names
        self.plain: dict[tuple[int, int], int] = {}
        self.used = 0  # nodes named since
        names, n = self.names, len(t.tag)
        exact, shape, size, leaves = [0] * n, [0] * n, [1] * n, [0] * n
        for i in range(n - 1, -1, -1):
            kids = t.kids[i]
            if kids:
                exact[i] = names.setdefault((t.tag[i], t.text[i], tuple([exact[k] for k in kids])), len(names))
                shape[i] = names.setdefault((t.tag[i], tuple([shape[k] for k in kids])), len(names))
                size[i] = 1 + sum([size[k] for k in kids])
                leaves[i] = sum([leaves[k] for k in kids])
            else:
                exact[i] = names.setdefault((t.tag[i], t.text[i], ()), len(names))
                shape[i] = names.setdefault((t.tag[i], ()), len(names))
            if t.tag[i] == "#":
                leaves[i] = 1
        self.exact, self.shape, self.size, self.leaves = exact, shape, size, leaves

    def full(self) -> bool:
        """Whether trees that are gone have left so many names that they had better be made anew."""
        return self.used > NAMES + 4 * len(self.exact) or len(self.plain) > NAMES

    def copy(self) -> Names:
        """For one matching, whose names are not kept."""
        out = object.__new__(Names)
        out.names, out.plain, out.used = dict(self.names), {}, 0
        out.exact, out.shape, out.size, out.leaves = self.exact, self.shape, self.size, self.leaves
        return out

    def renew(self, t: Tree, changed: list[int]) -> None:
        """The texts of some leaves have changed."""
        todo = set(changed)
        for i in changed:
            u = t.up[i]
            while u >= 0 and u not in todo:
                todo.add(u)
                u = t.up[u]
        for i in sorted(todo, reverse=True):
            self.used += 1 + len(t.kids[i])
            self.exact[i] = self.names.setdefault((t.tag[i], t.text[i], tuple([self.exact[k] for k in t.kids[i]])), len(self.names))


class Matching:
    """The best matching of two trees: most matched nodes, leaves of equal text counting twice."""

    def __init__(self, a: Tree, b: Tree, names: Names | None = None):
        self.a, self.b = a, b
        of_a = names or Names(a)
        of_b = Names(b, of_a.names)
        of_a.used += len(b.tag)
        self.exact_a, self.shape_a, self.size_a, self.leaves_a = of_a.exact, of_a.shape, of_a.size, of_a.leaves
        self.exact_b, self.shape_b, self.size_b, self.leaves_b = of_b.exact, of_b.shape, of_b.size, of_b.leaves
        texts_a, texts_b = set(a.text), set(b.text)
        self.shared_a, self.shared_b = self._sharing(a, texts_b), self._sharing(b, texts_a)
        self.known: dict[tuple[int, int], int] = {}
        self.plain = of_a.plain

    @staticmethod
    def _sharing(t: Tree, texts: set[int]) -> list[bool]:
        """Whether a subtree has a leaf whose text is among the texts."""
        out = [x != 0 and x in texts for x in t.text]
        for i in range(len(out) - 1, 0, -1):
            if out[i]:
                out[t.up[i]] = True
        return out

    def _quick(self, i: int, j: int) -> int | None:
        """Weight of two nodes where it is plain to see, or known already."""
        a, b = self.a, self.b
        if a.tag[i] != b.tag[j]:
            return 0
        if self.exact_a[i] == self.exact_b[j]:
            return self.size_a[i] + self.leaves_a[i]
        if self.shape_a[i] == self.shape_b[j] and (self.leaves_a[i] <= 1 or not (self.shared_a[i] and self.shared_b[j])):
            return self.size_a[i]
        if not a.kids[i] or not b.kids[j]:
            return 1
        if self.shared_a[i] and self.shared_b[j]:
            return self.known.get((self.exact_a[i], self.exact_b[j]))
        return self.plain.get((self.shape_a[i], self.shape_b[j]))

    def _middle(self, i: int, j: int) -> tuple[list[int], list[int], int]:
        """Children of both without the equal ones at either end, which match in any best matching, and how many those are at the start."""
        x, y = self.a.kids[i], self.b.kids[j]
        ea, eb = self.exact_a, self.exact_b
        lo, n, m = 0, len(x), len(y)
        while lo < n and lo < m and ea[x[lo]] == eb[y[lo]]:
            lo += 1
        while n > lo and m > lo and ea[x[n - 1]] == eb[y[m - 1]]:
            n, m = n - 1, m - 1
        return x[lo:n], y[lo:m], lo

    def _weights(self, x: list[int], y: list[int], missing: list[tuple[int, int]]) -> list[np.ndarray] | None:
        """A row of weights for each child of one list against the other; None if some are not known yet, which go to missing."""
        kinds_x = [(self.exact_a[p] if self.shared_a[p] else -1 - self.shape_a[p]) for p in x]
        kinds_y = [(self.exact_b[q] if self.shared_b[q] else -1 - self.shape_b[q]) for q in y]
        first_x: dict[int, int] = {}
        first_y: dict[int, int] = {}
        for k, p in zip(kinds_x, x):
            first_x.setdefault(k, p)
        for k, q in zip(kinds_y, y):
            first_y.setdefault(k, q)
        order_y = {k: c for c, k in enumerate(first_y)}
        places = np.array([order_y[k] for k in kinds_y], np.int64)
        table = {}
        for k, p in first_x.items():
            row = []
            for q in first_y.values():
                w = self._quick(p, q)
                if w is None:
                    missing.append((p, q))
                    w = 0
                row.append(w)
            table[k] = row
        if missing:
            return None
        lines = {k: np.array(row, np.int64)[places] for k, row in table.items()}
        return [lines[k] for k in kinds_x]

    @staticmethod
    def _last_row(weights: list, m: int) -> np.ndarray:
        """Best sums of all rows against the first 0, 1, ... m columns."""
        prev = np.zeros(m + 1, np.int64)
        for w in weights:
            now = prev.copy()
            np.maximum(now[1:], prev[:-1] + w, out=now[1:])
            prev = np.maximum.accumulate(now)
        return prev

    @staticmethod
    def _table(rows: list[np.ndarray]) -> np.ndarray:
        """Best sums of the first rows against the first columns, made along the longer side."""
        w = np.array(rows)
        table = np.zeros((w.shape[0] + 1, w.shape[1] + 1), np.int64)
        t, w = (table, w) if w.shape[0] <= w.shape[1] else (table.T, w.T)
        for r in range(len(w)):
            np.maximum(t[r, 1:], t[r, :-1] + w[r], out=t[r + 1, 1:])
            np.maximum.accumulate(t[r + 1], out=t[r + 1])
        return table

    def _best(self, weights: list[np.ndarray], m: int) -> int:
        """The best sum, by the shorter of both lists."""
        if m < len(weights) and m * len(weights) <= CELLS:
            weights, m = list(np.array(weights).T), len(weights)
        return int(self._last_row(weights, m)[-1])

    def weight(self, i: int, j: int) -> int:
        """Weight of the best matching of two subtrees with their roots matched."""
        w = self._quick(i, j)
        if w is not None:
            return w
        todo = [(i, j)]
        while todo:
            p, q = todo[-1]
            if self._quick(p, q) is not None:
                todo.pop()
                continue
            x, y, lo = self._middle(p, q)
            missing: list[tuple[int, int]] = []
            total = 1
            if x and y:
                weights = self._weights(x, y, missing)
                if missing:
                    todo += missing
                    continue
                total += self._best(weights, len(y))
            kids = self.a.kids[p]
            for k in [*kids[:lo], *kids[lo + len(x) :]]:
                total += self.size_a[k] + self.leaves_a[k]
            if self.shared_a[p] and self.shared_b[q]:
                self.known[self.exact_a[p], self.exact_b[q]] = total
            else:
                self.plain[self.shape_a[p], self.shape_b[q]] = total
            todo.pop()
        return self._quick(i, j)

    def _children(self, x: list[int], y: list[int]) -> list[tuple[int, int]]:
        """Pairs of children in a best matching of two lists."""
        if len(x) == len(y) == 1:
            return [(x[0], y[0])] if self.a.tag[x[0]] == self.b.tag[y[0]] else []
        out = []
        todo = [(0, len(x), 0, len(y))]
        while True:
            missing: list[tuple[int, int]] = []
            weights = self._weights(x, y, missing)
            if not missing:
                break
            for p, q in missing:
                self.weight(p, q)
        while todo:
            a, b, c, d = todo.pop()
            if a >= b or c >= d:
                continue
            if b - a > 1 and (b - a) * (d - c) > CELLS:
                # Halves of the rows meet at the column with the best sum of both.
                mid = (a + b) // 2
                top = self._last_row([w[c:d] for w in weights[a:mid]], d - c)
                low = self._last_row([w[c:d][::-1] for w in reversed(weights[mid:b])], d - c)[::-1]
                cut = c + int((top + low).argmax())
                todo += [(a, mid, c, cut), (mid, b, cut, d)]
                continue
            table = self._table([w[c:d] for w in weights[a:b]])
            r, k = b - a, d - c
            while r and k:
                w = weights[a + r - 1][c + k - 1]
                if w and table[r][k] == table[r - 1][k - 1] + w:
                    out.append((x[a + r - 1], y[c + k - 1]))
                    r, k = r - 1, k - 1
                elif table[r][k] == table[r - 1][k]:
                    r -= 1
                else:
                    k -= 1
        return out

    def pairs(self) -> list[tuple[int, int]]:
        """Matched nodes, the roots among them."""
        out, todo = [], [(0, 0)]
        while todo:
            i, j = todo.pop()
            out.append((i, j))
            if self.shape_a[i] == self.shape_b[j] and (self.exact_a[i] == self.exact_b[j] or not (self.shared_a[i] and self.shared_b[j])):
                # The same shape, and no text that might stand elsewhere: node by node.
                out += zip(range(i + 1, self.a.end[i]), range(j + 1, self.b.end[j]), strict=True)
                continue
            x, y, lo = self._middle(i, j)
            kids, others = self.a.kids[i], self.b.kids[j]
            todo += zip(kids[:lo], others[:lo], strict=True)
            todo += zip(kids[lo + len(x) :], others[lo + len(y) :], strict=True)
            if x and y:
                todo += self._children(x, y)
        return out


def match(a: Tree, b: Tree, names: Names | None = None) -> list[tuple[int, int]]:
    """Matched nodes; names: those of a, if they are kept."""
    return Matching(a, b, names).pairs() if a.tag and b.tag else []


# --- templates -------------------------------------------------------------------


class Merged:
    """A tree of several pages. Of each node: how many of them have it, the texts that stand there with their counts, and what any count may lack."""

    __slots__ = ("tree", "count", "seen", "lost", "names")

    def __init__(self, tree: Tree, count: list[int], seen: list[dict[int, int]], lost: list[int]):
        self.tree, self.count, self.seen, self.lost = tree, count, seen, lost
        self.names: Names | None = None

    @staticmethod
    def of(tree: Tree) -> Merged:
        n = len(tree.tag)
        return Merged(tree, [1] * n, [{x: 1} if x else {} for x in tree.text], [0] * n)


def _votes(a: dict[int, int], b: dict[int, int], most: int | None) -> tuple[dict[int, int], int]:
    """Both counts together, put into a, and what is taken off each where there are more than ``most`` texts."""
    for x, n in b.items():
        a[x] = a.get(x, 0) + n
    if most is None or len(a) <= most:
        return a, 0
    off = sorted(a.values(), reverse=True)[most]
    return {x: n - off for x, n in a.items() if n > off}, off


def merged_all(parts: list[Merged], votes: int | None = None) -> Merged:
    largest = max(range(len(parts)), key=lambda k: len(parts[k].tree.tag))  # the first of equals
    first = parts[largest]
    out = Merged(first.tree.only([True] * len(first.count)), [*first.count], [*first.seen], [*first.lost])
    for k, p in enumerate(parts):
        if k != largest:
            out = _merged(out, p, votes)
    return out


def constants_of(m: Merged, unanimous: int = UNANIMOUS) -> tuple[list[list[int]], bool]:
    """The constant texts of each node (none for slots), and whether the counts were enough to tell."""
    constant, settled = [], True
    for i, count in enumerate(m.count):
        often = [x for x, n in m.seen[i].items() if n >= 2 and 2 * n > count]
        if not often and any(n + m.lost[i] >= 2 and 2 * (n + m.lost[i]) > count for n in m.seen[i].values()) and m.lost[i]:
            settled = False
        if often and m.tree.marked[i] and not m.tree.weak[i] and (count < unanimous or m.seen[i][often[0]] < count):
            often = []
        constant.append(often)
    return constant, settled


def _template(m: Merged, constant: list[list[int]]) -> tuple[Tree, list[list[int]]] | None:
    if m.count[0] < 2 or not any(constant):
        return None
    # What only one page has is no part of the template.
    keep = [n > 1 for n in m.count]
    return m.tree.only(keep), [c for c, k in zip(constant, keep, strict=True) if k]


def template_of(trees: list[Tree], unanimous: int = UNANIMOUS) -> tuple[Tree, list[list[int]]] | None:
    """The template of several pages and the constant texts of each of its nodes (none for slots); None if nothing is constant."""
    if len(trees) < 2:
        return None
    m = merged_all([Merged.of(t) for t in trees])
    return _template(m, constants_of(m, unanimous)[0])


def _merged(v: Merged, p: Merged, votes: int | None) -> Merged:
    """v with the counts of p, in place where all of p's nodes match; subtrees of p that match nothing are added after their matched neighbour."""
    w, t = v.tree, p.tree
    if v.names is None or v.names.full():
        v.names = Names(w)
    found = match(w, t, v.names)
    changed = []
    for i, j in found:
        v.count[i] += p.count[j]
        v.lost[i] += p.lost[j]
        if p.seen[j]:
            # A leaf's text is what most pages have there; the one it had, where all counts are taken off. Only counts of p's texts have grown.
            both, off = _votes(v.seen[i], p.seen[j], votes)
            v.seen[i] = both
            v.lost[i] += off
            if both:
                text = min((x for x in (w.text[i], *p.seen[j]) if x in both), key=lambda x: (-both[x], x))
                if text != w.text[i]:
                    w.text[i] = text
                    changed.append(i)
    if len(found) == len(t.tag):
        v.names.renew(w, changed)
        return v
    of_w, of_t = dict(found), {j: i for i, j in found}
    out, seen, count, lost = Tree(), [], [], []
    # (tree, node, new parent), in page order.
    stack: list[tuple[Tree, int, int]] = [(w, 0, -1)]
    while stack:
        tree, i, up = stack.pop()
        here = out.add(tree.tag[i], up, tree.text[i], tree.marked[i], tree.weak[i])
        m = p if tree is t else v
        seen.append(m.seen[i])
        count.append(m.count[i])
        lost.append(m.lost[i])
        kids: list[tuple[Tree, int, int]] = []
        fresh: dict[int, list[int]] = {}  # after which matched child of w
        j = of_w.get(i) if tree is w else None
        if j is not None:
            last = -1
            for k in t.kids[j]:
                if k in of_t:
                    last = of_t[k]
                else:
                    fresh.setdefault(last, []).append(k)
            kids += [(t, k, here) for k in fresh.get(-1, ())]
        for k in tree.kids[i]:
            kids.append((tree, k, here))
            kids += [(t, q, here) for q in fresh.get(k, ())]
        stack += reversed(kids)
    return Merged(out.finish(), count, seen, lost)


def constant_leaves(tree: Tree, template: tuple[Tree, list[list[int]]] | None, names: Names | None = None) -> set[int]:
    """Nodes of a page's tree that meet a constant leaf and have its text; names: those of the template's tree, if they are kept."""
    if template is None:
        return set()
    t, constant = template
    return {j for i, j in match(t, tree, names) if tree.text[j] and tree.text[j] in constant[i]}


def extract(html: str | None, *templates: tuple[Tree, list[list[int]]] | None) -> str:
    """Content blocks of a page, joined by newlines."""
    tree, texts = tree_of(html)
    gone: set[int] = set()
    for template in templates:
        gone |= constant_leaves(tree, template)
    leaves = [i for i, t in enumerate(tree.tag) if t == "#"]
    return "\n".join(text for i, text in zip(leaves, texts, strict=True) if i not in gone)


# --- DataFrames -------------------------------------------------------------------

_TREE = "tag array<string>, up array<int>, text array<bigint>, marked array<boolean>, weak array<boolean>"
_COLUMNS = [("tag", pa.list_(pa.string())), ("up", pa.list_(pa.int32())), ("text", pa.list_(pa.int64())), ("marked", pa.list_(pa.bool_())), ("weak", pa.list_(pa.bool_()))]


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, layout, page (hash of tree and texts) and the tree of each page with a leaf."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            hosts, layouts, pages, trees = [], [], [], []
            for host, html in zip(part.column("host").to_pylist(), part.column("html"), strict=True):
                tree, _ = tree_of(html.as_py())
                if len(tree.tag) > 1:
                    hosts.append(host)
                    layouts.append(layout_of(tree))
                    pages.append(_hash(*tree.tag, *map(str, (*tree.up, *tree.text, *tree.marked, *tree.weak))))
                    trees.append(tree)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(pages, pa.int64()), *(pa.array([getattr(t, n) for t in trees], kind) for n, kind in _COLUMNS)],
                names=["host", "layout", "page", *(n for n, _ in _COLUMNS)],
            )


def _tree(columns: dict[str, list], i: int) -> Tree:
    t = Tree()
    for n, _ in _COLUMNS:
        setattr(t, n, columns[n][i])
    return t.finish()


_PARTIAL = f"host string, scope bigint, part bigint, {_TREE}, count array<bigint>, lost array<bigint>, texts array<array<bigint>>, times array<array<bigint>>"


def _key(key: tuple, n: int) -> dict[str, pa.Array]:
    return {"host": pa.array([key[0].as_py()] * n, pa.string()), "scope": pa.array([key[1].as_py()] * n, pa.int64())}


def _merge_pages(votes: int | None):
    def run(key: tuple, pages: pa.Table) -> pa.Table:
        columns = pages.sort_by("page").to_pydict()
        scopes = {key[1].as_py(): range(pages.num_rows)}
        if None in scopes:  # all pages of a host: its layouts are scopes of their own where there are several
            scopes = {0: scopes[None]}
            for i, layout in enumerate(columns["layout"]):
                scopes.setdefault(layout, []).append(i)
            scopes = {k: v for k, v in scopes.items() if k == 0 or 1 < len(v) < pages.num_rows}
        made = [merged_all([Merged.of(_tree(columns, i)) for i in rows], votes) for rows in scopes.values()]
        return pa.table(
            {
                "host": pa.array([key[0].as_py()] * len(made), pa.string()),
                "scope": pa.array(list(scopes), pa.int64()),
                "part": pa.array([key[2].as_py()] * len(made), pa.int64()),
                **{n: pa.array([getattr(m.tree, n) for m in made], kind) for n, kind in _COLUMNS},
                "count": pa.array([m.count for m in made], pa.list_(pa.int64())),
                "lost": pa.array([m.lost for m in made], pa.list_(pa.int64())),
                "texts": pa.array([[list(c) for c in m.seen] for m in made], pa.list_(pa.list_(pa.int64()))),
                "times": pa.array([[list(c.values()) for c in m.seen] for m in made], pa.list_(pa.list_(pa.int64()))),
            }
        )

    return run


def _induce(unanimous: int, votes: int | None):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        columns = parts.sort_by("part").to_pydict()
        several = []
        for i in range(parts.num_rows):
            seen = [dict(zip(x, n, strict=True)) for x, n in zip(columns["texts"][i], columns["times"][i], strict=True)]
            several.append(Merged(_tree(columns, i), columns["count"][i], seen, columns["lost"][i]))
        m = merged_all(several, votes)
        constant, settled = constants_of(m, unanimous)
        made = _template(m, constant)
        rows = [made or (Tree(), [])] if made or not settled else []
        return pa.table(
            {
                **_key(key, len(rows)),
                **{n: pa.array([getattr(t, n) for t, _ in rows], kind) for n, kind in _COLUMNS},
                "constant": pa.array([c for _, c in rows], pa.list_(pa.list_(pa.int64()))),
                "settled": pa.array([settled] * len(rows), pa.bool_()),
            }
        )

    return run


def templates(src: DataFrame, unanimous: int = UNANIMOUS, votes: int = VOTES, part: int = PART) -> DataFrame:
    """(host, scope, tree, constant): templates of src(host, html) that have a constant leaf; scope 0 is the host, others are layouts of hosts with several."""
    parsed = src.where("html <> ''").select("host", "html").mapInArrow(_tree_batches, f"host string, layout bigint, page bigint, {_TREE}")
    parsed = saved(parsed, "trees")
    names = [n for n, _ in _COLUMNS]
    # Scopes of more than one part, and hosts of more than one: one for each ``part`` pages at most, so few that they may be sent everywhere.
    counts = parsed.select("host", "layout", "page").distinct().groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"))
    hosts = counts.groupBy("host").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("layouts"))
    hosts = hosts.select("host", F.lit(0).cast("bigint").alias("scope"), "n", "layouts")
    large = hosts.unionByName(counts.select("host", F.col("layout").alias("scope"), "n", F.lit(None).cast("bigint").alias("layouts")))
    large = saved(large.where(F.col("n") > part).select("host", "scope", F.ceil(F.col("n") / part).alias("parts"), "layouts"), "scopes")
    once = parsed.dropDuplicates(["host", "layout", "page"])
    both = F.array(F.lit(0).cast("bigint"), "layout")
    # A host that is one part is merged in one task with its layouts (scope null); a layout that is all of its host tells the same as the host.
    wide = large.where("scope = 0").select("host", "layouts")
    scopes = F.when(F.col("layouts") > 1, both).otherwise(F.array(F.when(F.col("layouts") == 1, F.lit(0).cast("bigint"))))
    pages = once.join(F.broadcast(wide), "host", "left").withColumn("scope", F.explode(scopes))

    def induced(pages: DataFrame, votes: int | None) -> DataFrame:
        pages = pages.join(F.broadcast(large.drop("layouts")), ["host", "scope"], "left")
        pages = pages.withColumn("part", F.coalesce(F.expr("pmod(xxhash64(page), parts)"), F.lit(0).cast("bigint")))
        pages = pages.select("host", "scope", "part", "layout", "page", *names)
        # A number of partitions of its own: few bytes are much work here.
        pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "host", "scope", "part")
        parts = pages.groupBy("host", "scope", "part").applyInArrow(_merge_pages(votes), _PARTIAL)
        kind = f"host string, scope bigint, {_TREE}, constant array<array<bigint>>, settled boolean"
        return saved(parts.groupBy("host", "scope").applyInArrow(_induce(unanimous, votes), kind), "induced")

    found = induced(pages, votes)
    left = found.where("not settled").select("host", "scope")
    found = found.where("settled")
    if not left.isEmpty():
        found = found.unionByName(induced(once.withColumn("scope", F.explode(both)).join(left, ["host", "scope"], "left_semi"), None))
    return found.drop("settled")


def _extract_batches(known: dict | None):
    """Texts of pages; known: (host, scope) -> columns of the template, or None where they come with each row."""
    ready: dict[tuple[str, int], tuple[tuple, Names]] = {}
    held = 0  # nodes of the templates in ready

    def template(host: str, scope: int, columns: dict | None):
        nonlocal held
        if columns is None:
            return None, None
        key = (host, scope)
        if key not in ready:
            if held > NAMES:
                ready.clear()
                held = 0
            tree = _tree({n: [columns[n]] for n, _ in _COLUMNS}, 0)
            ready[key] = ((tree, columns["constant"]), Names(tree))
            held += len(tree.tag)
        made, names = ready[key]
        return made, names.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            rows = batch.select([c for c in batch.schema.names if c not in ("page_id", "url", "html")]).to_pylist()
            for html, row in zip(batch.column("html"), rows, strict=True):
                host, html = row["host"], html.as_py()
                if known is not None and (host, None) not in known:
                    texts.append(extract(html))
                    continue
                tree, blocks = tree_of(html)
                layout = layout_of(tree)
                if known is None:
                    found = {0: row["of_host"], layout: row["of_layout"]}
                else:
                    found = {s: known.get((host, s)) for s in (0, layout)}
                gone: set[int] = set()
                for scope, columns in found.items():
                    gone |= constant_leaves(tree, *template(host, scope, columns))
                leaves = (i for i, t in enumerate(tree.tag) if t == "#")
                texts.append("\n".join(b for i, b in zip(leaves, blocks, strict=True) if i not in gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def _with_layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        layouts = [layout_of(tree_of(x.as_py())[0]) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layouts, pa.int64())], names=[*batch.schema.names, "layout"])


_RESULT = "page_id bigint, url string, text string, n_chars bigint"


def extract_pages(pages: DataFrame, *, unanimous: int = UNANIMOUS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    ensure_checkpoint_dir(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    src = src.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1), F.lit(""))))
    wrappers = templates(src, unanimous)
    bytes_ = wrappers.agg(F.sum(F.octet_length("host") + 40 * F.size("tag") + 8 * F.size(F.flatten("constant")))).first()[0] or 0
    if bytes_ <= broadcast_bytes:
        known: dict = {}
        for r in wrappers.toLocalIterator():
            known[r["host"], r["scope"]] = {n: list(r[n]) for n in (*(n for n, _ in _COLUMNS), "constant")}
            known[r["host"], None] = True
        return src.mapInArrow(_extract_batches(known), _RESULT)
    # Too many templates to send everywhere: each page gets those of its host and layout by joins.
    packed = wrappers.select("host", "scope", F.struct(*(n for n, _ in _COLUMNS), "constant").alias("template"))
    laid = src.mapInArrow(_with_layout, "page_id bigint, url string, html string, host string, layout bigint")
    joined = laid.join(packed.where("scope = 0").select("host", F.col("template").alias("of_host")), "host", "left")
    joined = joined.join(packed.select("host", F.col("scope").alias("layout"), F.col("template").alias("of_layout")), ["host", "layout"], "left")
    return joined.select("page_id", "url", "html", "host", "of_host", "of_layout").mapInArrow(_extract_batches(None), _RESULT)
