"""Main text of web pages by wrapper induction.

Pages of a host are made from few templates.  A page's DOM is read into a tree of its
blocks, in which neighbouring alike siblings are one repeated node; pages of the same
shape fall together.  The shapes of a host are aligned by simple tree matching: from the most
frequent on, those that match none before them are templates, and each shape is matched node by
node to the template it fits best.  Aligned nodes share their statistics over all of the host's pages: nodes whose text
is the same on pages that differ elsewhere are template, all others slots.  The content
is the slots of all elements named as article, else of the node that holds nearly all varying
text and of what varies beside it, without menus, notices and the like.

Statistics are sums, minima and maxima per host, shape and node, combined before they are
shuffled, so a host of many pages costs one row for each of its nodes and tasks.  A host of
many shapes is dealt over parts of bounded size: templates are found per part and merged in
further rounds, and parts of shapes meet parts of templates in a grid, so no task holds a host.
"""

from __future__ import annotations

import html
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, settle

#: Different pages that must agree on a node's text before it counts as template; copies of a page are one.
LEAST_PAGES = 3
#: Share of the smaller tree that must match for a shape to join a cluster.
LEAST_MATCH = 0.5
#: Shapes, and templates, of a host that one task aligns at a time.
PART_SHAPES = 256
#: A host's templates are merged again as long as a round leaves at most this share of them.
MERGED = 0.9
#: Wrappers up to this size are sent to all tasks; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

#: Elements of the HTML standard by their part in the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "noframes", "xmp"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea input iframe svg math"
    " object embed canvas audio video map dialog menu noframes datalist".split()
)
CLOSED_BY_BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr main menu nav ol p pre section table ul".split()
)
#: Elements that end an open element of their kind, up to the given ancestor.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words in class, id and role that name parts which are no article, unless they hold most of a cluster's varying text.
SIDE_PARTS = frozenset(
    "ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo"
    " cookie cookies disqus footer form header menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted"
    " related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)

#: In the label of an element that is not shown.
UNSEEN = "~"

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: A tag with an unpaired quote ends at the next ">".
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT_NAME = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")
HOST = r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)"


class Node:
    """An element that holds blocks: tag and names as ``label``, side part or not, children; texts as ("", parts)."""

    __slots__ = ("label", "tag", "side", "children")

    def __init__(self, label: str, tag: str, side: bool):
        self.label, self.tag, self.side = label, tag, side
        self.children: list = []


def _names(tag: str, attributes: str) -> tuple[str, bool]:
    """Label of an element and whether its names say it is no article."""
    label, side = tag, tag in DROPPED
    if attributes:
        for match in NAMES.finditer(attributes):
            name = match[1].lower()
            value = (match[2] or match[3] or match[4] or "").lower()
            if name == "hidden" or name == "aria-hidden":
                if name == "hidden" or value == "true":
                    side = True
                    label += UNSEEN
                continue
            parts = [p for p in SPLIT_NAME.split(value) if p]
            if name != "id":
                label += "." + "-".join(parts)
            if tag not in ("html", "body", "article", "main"):
                side |= not SIDE_PARTS.isdisjoint(parts)
    return label, side


def parse(page: str) -> Node:
    """The tree of a page's blocks; text nodes are (False, text) or, inside a link, (True, text)."""
    root = Node("", "", False)
    stack, links, at, end = [root], 0, 0, len(page)
    #: Places in the stack of the open elements of each tag.
    places: dict[str, list[int]] = {}
    last_close, last_section = page.rfind(">"), page.rfind("]]>")

    def text(until: int) -> None:
        if until > at:
            stack[-1].children.append((links > 0, page[at:until]))

    def innermost(kinds: set | frozenset) -> int:
        some = kinds if len(kinds) < len(places) else places
        return max((places[k][-1] for k in some if k in kinds and places.get(k)), default=0)

    def close(kinds: set | frozenset, stop: set | frozenset) -> None:
        nonlocal links
        k = innermost(kinds)
        if k and k > innermost(stop):
            for node in stack[k:]:
                links -= node.tag == "a"
                places[node.tag].pop()
            del stack[k:]

    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            break
        if page.startswith("<![CDATA[", begin) and begin < last_section:
            stop = page.index("]]>", begin)
            text(begin)
            stack[-1].children.append((links > 0, page[begin + 9 : stop]))
            at = stop + 3
            continue
        match = None
        if begin < last_close or page.startswith("<!--", begin):
            match = TAG.match(page, begin) or LOOSE_TAG.match(page, begin)
        if match is None:
            # A "<" that opens no tag is text.
            following = page.find("<", begin + 1)
            stop = end if following < 0 else following
            text(stop)
            at = stop
            continue
        text(begin)
        at = match.end()
        if match.lastindex is None or match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p", "p", False))
            elif tag != "br":
                close({tag}, frozenset() if tag not in INLINE else CLOSED_BY_BLOCK)
            else:
                stack[-1].children.append((False, " "))
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                if tag == "br":
                    stack[-1].children.append((links > 0, " "))
            elif tag == "hr":
                close({"p"}, {"td", "th"})
                stack[-1].children.append(Node("hr", "hr", False))
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in CLOSED_BY_BLOCK:
            close({"p"}, {"td", "th", "button", "caption", "object"})
            if tag[0] == "h" and tag[1:] in "123456":
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, CLOSED_BY_BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6", "p"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        label, side = _names(tag, match[3])
        node = Node(label, tag, side)
        stack[-1].children.append(node)
        if not match[3].endswith("/") or tag not in ("svg", "math"):
            links += tag == "a"
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    text(end)
    return root


class Tree:
    """A node of a page's folded tree: label, children, the blocks of text it holds itself.

    ``blocks`` are (place in the page, text, characters inside links).
    """

    __slots__ = ("label", "side", "children", "blocks")

    def __init__(self, label: str, side: bool):
        self.label, self.side = label, side
        self.children: list[Tree] = []
        self.blocks: list[tuple[int, str, int]] = []

    def shape(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node is None:
                out.append(")")
                continue
            out.append(f"({node.label}{'!' if node.side else ''}{'*' if node.blocks else ''}")
            todo.append(None)
            todo.extend(reversed(node.children))
        return "".join(out)


def fold(root: Node) -> Tree:
    """Blocks of a page: runs of text between block elements, decoded, white space made one blank, trimmed.

    Neighbouring siblings of one label are one node; inline elements are part of the text
    unless they are side parts or hold blocks.
    """
    place = 0
    tree = Tree("", False)
    #: Open elements: the tree's node, the run of text so far, the children still to read (those of inline elements on top).
    frames: list[tuple[Tree, list[tuple[bool, str]], list[Iterator]]] = [(tree, [], [iter(root.children)])]

    def flush(at: Tree, run: list[tuple[bool, str]]) -> None:
        nonlocal place
        if run:
            words = SPACE.sub(" ", html.unescape("".join(t for _, t in run))).strip()
            if words:
                linked = sum(len(t.strip()) for inside, t in run if inside)
                at.blocks.append((place, words, min(linked, len(words))))
                place += 1
            run.clear()

    while frames:
        at, run, left = frames[-1]
        child = next(left[-1], None)
        if child is None:
            left.pop()
            if not left:
                flush(at, run)
                frames.pop()
        elif isinstance(child, tuple):
            run.append(child)
        elif child.tag in INLINE and not child.side:
            left.append(iter(child.children))
        else:
            flush(at, run)
            last = at.children[-1] if at.children else None
            if last is None or last.label != child.label or last.side != child.side:
                last = Tree(child.label, child.side)
                at.children.append(last)
            frames.append((last, [], [iter(child.children)]))

    # Children come after their parents in document order.
    for node in reversed(slots(tree)):
        merged: list[Tree] = []
        for c in node.children:
            if not c.blocks and not c.children:
                continue
            if merged and merged[-1].label == c.label and merged[-1].side == c.side:
                merged[-1].children += c.children
                merged[-1].blocks += c.blocks
            else:
                merged.append(c)
        node.children = merged
    return tree


def slots(tree: Tree) -> list[Tree]:
    """The nodes of a folded tree in document order; a node's number is its place here."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


class Shape:
    """A tree of labels read back from a shape's text, with its nodes' numbers."""

    __slots__ = ("label", "side", "children", "number", "size")

    def __init__(self, label: str, side: bool, number: int):
        self.label, self.side, self.number, self.size = label, side, number, 1
        self.children: list[Shape] = []

    @classmethod
    def read(cls, text: str) -> "Shape":
        stack: list[Shape] = []
        count = 0
        root = None
        for match in re.finditer(r"\(([^()!*]*)(!?)(\*?)|\)", text):
            if match[0] == ")":
                done = stack.pop()
                if stack:
                    stack[-1].size += done.size
                continue
            node = cls(match[1], bool(match[2]), count)
            count += 1
            if stack:
                stack[-1].children.append(node)
            else:
                root = node
            stack.append(node)
        return root

    def nodes(self) -> list["Shape"]:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append(node)
            todo.extend(reversed(node.children))
        return out


class _Match:
    """Two nodes under way: the table over their children, filled row by row, and each pair of children's match."""

    __slots__ = ("a", "b", "best", "pair", "place", "inner")

    def __init__(self, a: Shape, b: Shape):
        self.a, self.b, self.place = a, b, 0
        same = a.label == b.label and a.side == b.side
        m, n = (len(a.children), len(b.children)) if same else (-1, 0)
        self.best = [[0] * (n + 1) for _ in range(m + 1)]
        self.pair: list[list[_Match | None]] = [[None] * n for _ in range(m)]
        #: Matches of children that the best alignment takes.
        self.inner: list[_Match] = []

    def size(self) -> int:
        return self.best[-1][-1] + 1 if self.best else 0

    def step(self) -> "_Match | None":
        """The next pair of children to match; None when the table is full and the alignment chosen."""
        m, n = len(self.pair), len(self.best[0]) - 1 if self.best else 0
        if self.place:
            i, j = divmod(self.place - 1, n)
            self.best[i + 1][j + 1] = max(self.best[i][j + 1], self.best[i + 1][j], self.best[i][j] + self.pair[i][j].size())
        if self.place < m * n:
            i, j = divmod(self.place, n)
            self.place += 1
            self.pair[i][j] = _Match(self.a.children[i], self.b.children[j])
            return self.pair[i][j]
        i, j = m, n
        while i and j:
            if self.best[i][j] == self.best[i - 1][j]:
                i -= 1
            elif self.best[i][j] == self.best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                self.inner.append(self.pair[i][j])
        self.pair = []
        return None


def tree_match(a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most nodes that two trees share in order, level by level, and their numbers."""
    whole = _Match(a, b)
    open_matches = [whole]
    while open_matches:
        below = open_matches[-1].step()
        if below is None:
            open_matches.pop()
        else:
            open_matches.append(below)
    matched, todo = [], [whole] if whole.size() else []
    while todo:
        match = todo.pop()
        matched.append((match.a.number, match.b.number))
        todo.extend(match.inner)
    return whole.size(), matched


def _content(template: Shape, stats: dict[int, list], parents: dict[int, int]) -> set[int]:
    """Numbers of the template's content slots.  stats: number -> different pages, lowest and highest text hash, characters, linked characters."""
    nodes = {n.number: n for n in template.nodes()}
    hidden: set[int] = set()

    def tag(number: int) -> str:
        return nodes[number].label.split(".")[0].rstrip(UNSEEN)

    def hide(sides: set[int]) -> None:
        for number in sorted(nodes):
            if number in sides or parents.get(number) in hidden:
                hidden.add(number)

    def constant(number: int) -> bool:
        pages, low, high, _, _ = stats[number]
        return pages >= LEAST_PAGES and low == high

    def text_mass(number: int) -> float:
        if number in hidden or number not in stats:
            return 0.0
        _, _, _, chars, linked = stats[number]
        return max(0.0, chars - 2.0 * linked) / (20 if constant(number) else 1)

    def masses() -> dict[int, float]:
        mass: dict[int, float] = {}
        for number in sorted(nodes, reverse=True):
            mass[number] = text_mass(number) + sum(mass[c.number] for c in nodes[number].children)
        return mass

    # Elements that are no article by their kind are hidden; those so named, and forms, unless they hold most of the rest.
    sides = {n for n in nodes if nodes[n].side}
    hide({n for n in sides if UNSEEN in nodes[n].label or (tag(n) in DROPPED and tag(n) != "form")})
    mass = masses()
    hide({n for n in sides if mass[n] <= 0.5 * mass[template.number]})
    mass = masses()
    # Elements named as the article are preferred, those outside of side parts before those in them.
    named = [n for n in nodes if n not in hidden and tag(n) in ("article", "main") and mass[n] > 0]
    in_side: set[int] = set()
    for number in sorted(nodes):
        if number in sides or parents.get(number) in in_side:
            in_side.add(number)
    regions = [n for n in named if n not in in_side] or named
    inside: set[int] = set()
    if not regions:
        # Down from the root while one child holds nearly all; what varies beside it on the way is kept if it is more than links.
        region, beside = template.number, []
        while True:
            inner = [c.number for c in nodes[region].children if mass[c.number] >= 0.9 * mass[region] > 0]
            if not inner or tag(inner[0]) in ("p", "h1", "h2", "h3", "li", "td", "pre", "blockquote"):
                break
            if text_mass(region) > 0:
                inside.add(region)
            beside += [c for c in nodes[region].children if c.number != inner[0]]
            region = inner[0]
        regions = [region]
        while beside:
            node = beside.pop()
            if node.number not in hidden and mass[node.number] > 0:
                if text_mass(node.number) > 0:
                    inside.add(node.number)
                beside.extend(node.children)
    todo = [nodes[n] for n in regions]
    while todo:
        node = todo.pop()
        if node.number not in hidden and node.number not in inside:
            inside.add(node.number)
            todo.extend(node.children)
    filled = [n for n in inside if n in stats]
    # Where every slot is constant the pages are copies, and none of it is known to be template.
    if all(constant(n) for n in filled):
        return set(filled)
    return {n for n in filled if not constant(n)}


def _share(a: Shape, b: Shape) -> tuple[float, list[tuple[int, int]]]:
    """Share of the smaller tree that matches, and the matched numbers."""
    n, pairs = tree_match(a, b)
    return n / min(a.size, b.size), pairs


def _founders(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of a part of a host's shapes (shape, pages) that match none before them, from the most frequent on."""
    ordered = part.sort_values(["pages", "shape"], ascending=[False, True])
    trees: list[Shape] = []
    kept = []
    for at, shape in enumerate(ordered["shape"]):
        tree = Shape.read(shape)
        if all(_share(t, tree)[0] < LEAST_MATCH for t in trees):
            trees.append(tree)
            kept.append(at)
    return ordered.iloc[kept][["host", "shape", "pages", "parts", "held"]]


def _alignments(cell: pd.DataFrame) -> pd.DataFrame:
    """Each shape of a cell with the template in it that it shares most with: share, pages and shape of that, its number for each node or -1."""
    templates = cell[cell["is_template"]].sort_values(["pages", "shape"], ascending=[False, True])
    trees = [(Shape.read(t.shape), t.shape, t.pages) for t in templates.itertuples()]
    out = []
    for host, shape in cell.loc[~cell["is_template"], ["host", "shape"]].itertuples(index=False):
        tree = Shape.read(shape)
        best: tuple = (-1.0, 0, "", [])
        for template, text, pages in trees:
            # A template is its own, however much of it another one holds.
            share, pairs = (2.0, [(k, k) for k in range(tree.size)]) if text == shape else _share(template, tree)
            if share > best[0]:
                best = (share, pages, text, pairs)
        at = np.full(tree.size, -1, dtype=np.int32)
        for a, b in best[3]:
            at[b] = a
        out.append((host, shape, -best[0], -best[1], best[2], at))
    return pd.DataFrame(out, columns=["host", "shape", "unlike", "rarity", "cluster", "at"])


def _judged(shape: str, nodes) -> set[int]:
    """Content slots of a tree by the statistics (slot, n, low, high, chars, linked) of its nodes."""
    tree = Shape.read(shape)
    parents = {c.number: n.number for n in tree.nodes() for c in n.children}
    return _content(tree, {slot: [n, low, high, chars, linked] for slot, n, low, high, chars, linked in nodes}, parents)


def _cluster_content(rows: pd.DataFrame) -> pd.DataFrame:
    """Content slots of one template, from the statistics of its nodes over all shapes aligned to it."""
    host, cluster = rows["host"].iloc[0], rows["cluster"].iloc[0]
    nodes = rows[["node", "n", "low", "high", "chars", "linked"]].itertuples(index=False)
    return pd.DataFrame([(host, cluster, sorted(_judged(cluster, nodes)))], columns=["host", "cluster", "slots"])


def _shape_content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Content slots of shapes: those of the template; nodes that it lacks are judged on their shape's pages alone."""
    for batch in batches:
        chosen = []
        for row in batch.itertuples():
            content = set() if row.slots is None else set(row.slots)
            at = list(row.at)
            own = _judged(row.shape, [tuple(n.values()) for n in row.nodes]) if -1 in at else set()
            chosen.append([slot for slot, node in enumerate(at) if (node in content if node >= 0 else slot in own)])
        yield pd.DataFrame({"host": batch["host"], "shape": batch["shape"], "content": chosen})


def page_mark(tree: Tree) -> int:
    """Hash of a page's text outside of side parts, of all its text if there is none: copies have the same."""
    for all_parts in (False, True):
        texts: list[tuple[int, str]] = []
        todo = [tree]
        while todo:
            node = todo.pop()
            if all_parts or not node.side:
                texts.extend((b[0], b[1]) for b in node.blocks)
                todo.extend(node.children)
        if texts:
            break
    mark = xxhash.xxh64_intdigest("\n".join(t for _, t in sorted(texts)).encode())
    return mark - (1 << 64) if mark >> 63 else mark


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statistics of the nodes of a task's pages per host and shape."""
    for batch in batches:
        found: dict[tuple, list] = {}
        marks: dict[tuple, set] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not page:
                continue
            tree = fold(parse(page))
            shape = tree.shape()
            whole = page_mark(tree)
            for number, node in enumerate(slots(tree)):
                if node.blocks:
                    mark = zlib.crc32("\n".join(b[1] for b in node.blocks).encode())
                    row = found.setdefault((host, shape, number), [0, mark, mark, 0, 0])
                    row[0] += 1
                    row[1], row[2] = min(row[1], mark), max(row[2], mark)
                    row[3] += sum(len(b[1]) for b in node.blocks)
                    row[4] += sum(b[2] for b in node.blocks)
                    some = marks.setdefault((host, shape, number), set())
                    if len(some) < LEAST_PAGES:
                        some.add(whole)
        keys, rows = list(found), np.array(list(found.values()), dtype=np.int64).reshape(-1, 5)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], *rows.T]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5))],
                pa.array([sorted(marks[k]) for k in keys], pa.list_(pa.int64())),
            ],
            ["host", "shape", "slot", "pages", "low", "high", "chars", "linked", "marks"],
        )


def page_host(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def _dealt(shapes: DataFrame, salt: int = 0) -> DataFrame:
    """Rows with the number of ``parts`` of their host, their ``part`` and, where there are several, the rows ``held`` by the host."""
    many = shapes.groupBy("host").agg(F.count("*").alias("held")).filter(F.col("held") > PART_SHAPES)
    parts = F.coalesce(F.ceil(F.col("held") / PART_SHAPES), F.lit(1)).cast("int")
    dealt = shapes.join(narrow(settle(many)), "host", "left").withColumn("parts", parts)
    return dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "shape"), "parts").cast("int"))


def _templates(shapes: DataFrame) -> DataFrame:
    """host, shape, pages of the shapes that found clusters.

    Templates of the parts of a large host are dealt anew and merged, until one part holds
    them or a round leaves nearly all: then hardly two are alike.
    """
    done = None
    for salt in itertools.count():
        found = settle(_dealt(shapes, salt).groupBy("host", "part").applyInPandas(_founders, "host string, shape string, pages long, parts int, held long"))
        left = found.filter("parts > 1").groupBy("host").agg(F.count("*").alias("left"), F.max("held").alias("held"))
        again = settle(left.filter(F.col("left") <= MERGED * F.col("held")).select("host"))
        found = found.select("host", "shape", "pages")
        if again.isEmpty():
            return found if done is None else done.union(found)
        ended = found.join(narrow(again), "host", "left_anti")
        done = ended if done is None else done.union(ended)
        shapes = found.join(narrow(again), "host", "left_semi")


def _aligned(shapes: DataFrame) -> DataFrame:
    """host, shape, cluster (the template's shape) and ``at``: for each node the template's node or -1."""
    dealt, templates = _dealt(shapes), _dealt(settle(_templates(shapes)))
    one = ["host", "shape", "pages"]

    def over(rows: DataFrame, others: DataFrame, own: str, other: str) -> DataFrame:
        several = narrow(settle(others.filter("parts > 1").select("host", F.col("parts").alias("cuts")).distinct()))
        every = F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)).alias(other)
        return rows.withColumnRenamed("part", own).join(several, "host", "left").select(*one, own, every)

    cells = over(dealt, templates, "i", "j").withColumn("is_template", F.lit(False)).unionByName(
        over(templates, dealt, "j", "i").withColumn("is_template", F.lit(True))
    )
    kind = "host string, shape string, unlike double, rarity long, cluster string, at array<int>"
    best = cells.groupBy("host", "i", "j").applyInPandas(_alignments, kind).groupBy("host", "shape")
    best = best.agg(F.min(F.struct("unlike", "rarity", "cluster", "at")).alias("best")).select("host", "shape", "best.*")
    # What fits no template well is one of its own.
    alone = F.col("unlike") > -LEAST_MATCH
    own = F.sequence(F.lit(0), F.size("at") - 1)
    return best.select("host", "shape", F.when(alone, F.col("shape")).otherwise(F.col("cluster")).alias("cluster"), F.when(alone, own).otherwise(F.col("at")).alias("at"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, shape, content: the numbers of the content slots for every shape of every host.

    Statistics take one row per node of each distinct shape, however many pages there are.
    A task aligns PART_SHAPES shapes with as many templates at a time, however many a host has.
    """
    stats = settle(
        pages.select(page_host(F.col("url")).alias("host"), "html")
        .mapInArrow(_summaries, "host string, shape string, slot int, pages long, low long, high long, chars long, linked long, marks array<long>")
        .groupBy("host", "shape", "slot")
        .agg(
            *[f(c).alias(c) for f, c in ((F.sum, "pages"), (F.min, "low"), (F.max, "high"), (F.sum, "chars"), (F.sum, "linked"))],
            F.slice(F.array_distinct(F.flatten(F.collect_list("marks"))), 1, LEAST_PAGES).alias("marks"),
        )
    )
    shapes = settle(stats.groupBy("host", "shape").agg(F.max("pages").alias("pages")))
    aligned = settle(_aligned(shapes))
    node = F.element_at("at", F.col("slot") + 1)
    placed = stats.join(aligned, ["host", "shape"]).select("host", "cluster", node.alias("node"), "low", "high", "chars", "linked", F.posexplode("marks").alias("k", "mark"))
    once = F.col("k") == 0
    nodes = placed.filter("node >= 0").groupBy("host", "cluster", "node").agg(
        F.count_distinct("mark").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.when(once, F.col("chars"))).alias("chars"), F.sum(F.when(once, F.col("linked"))).alias("linked"),
    )
    content = nodes.groupBy("host", "cluster").applyInPandas(_cluster_content, "host string, cluster string, slots array<int>")
    facts = F.struct("slot", F.size("marks").cast("long").alias("n"), "low", "high", "chars", "linked")
    own = stats.groupBy("host", "shape").agg(F.collect_list(facts).alias("nodes"))
    joined = own.join(aligned, ["host", "shape"]).join(content, ["host", "cluster"], "left")
    return joined.select("host", "shape", "nodes", "at", "slots").mapInPandas(_shape_content, "host string, shape string, content array<int>")


def page_blocks(page: Column) -> Column:
    """shape of a page and its blocks in page order: slot, text."""

    @F.pandas_udf("struct<shape:string,blocks:array<struct<slot:int,text:string>>>")
    def read(pages: pd.Series) -> pd.DataFrame:
        shapes, blocks = [], []
        for value in pages:
            tree = fold(parse(value or ""))
            shapes.append(tree.shape())
            placed = sorted((b[0], number, b[1]) for number, node in enumerate(slots(tree)) for b in node.blocks)
            blocks.append([{"slot": number, "text": text} for _, number, text in placed])
        return pd.DataFrame({"shape": shapes, "blocks": blocks})

    return read.asNondeterministic()(page)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: the blocks in content slots, in page order, two newlines between.

    Null and empty pages and pages without content have an empty text; a null or odd URL is
    the empty host.  Repeated rows are returned as often as they occur.  Elements may be nested
    and tags left open to any depth and number: a page is read in time that grows with its length.
    """
    read = pages.select("page_id", "url", page_host(F.col("url")).alias("host"), page_blocks(F.col("html")).alias("page"))
    read = read.select("page_id", "url", "host", "page.shape", "page.blocks")
    wrapper = settle(wrappers(pages))
    held = wrapper.agg(F.sum(F.octet_length("host") + F.octet_length("shape") + 4 * F.size("content") + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        wrapper = F.broadcast(wrapper)
    chosen = F.filter("blocks", lambda b: F.array_contains("content", b["slot"]))
    return (
        read.join(wrapper, ["host", "shape"], "left")
        .select("page_id", "url", F.coalesce(F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n"), F.lit("")).alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
