"""Main text of web pages by wrapper induction over the pages of one host.

Every page is parsed into a tree of its block elements.  The trees of a host's pages are aligned by simple tree matching, in
which nodes of the same own text weigh more than nodes of the same kind, and merged into a wrapper.  A node of the wrapper
whose text is the same on every page that has it, on ``TEMPLATE_PAGES`` different pages and one in ``TEMPLATE_SHARE`` of
those that have its parent at least, is template; what a page has there goes.  All other nodes are slots, whose text is
content unless the node is by its kind no part of an article (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments).  A kind is told by the element's name, or by a word of its class, id or role, but not
where the element holds the page's article: then only what lies in it is judged.  Where article or main elements hold a fair
part of a page's prose, its content is what lies in them.

Wrappers do not depend on the order or the partitions of the table: a host's different pages are dealt by hash into groups of
about ``GROUP``, each is merged in order of the hash, and groups are merged in the same way, ``GROUP`` at a time, so no task
sees more of a host than that.  What stands on one page only leaves a wrapper of ``GROUP`` or more pages, which bounds its
size.  Of a finished wrapper only template nodes and their ancestors are kept; they go to all tasks, if that is small by
measure, or are joined by host.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by ``\\n`` in page
order.  Defined results: null or empty html gives an empty text; a page without markup is one block; a null url counts as host
''; repeated rows are extracted each (and are one page to the wrapper); markup that is never closed ends with the page;
elements nested deeper than ``DEEPEST`` hang from the one at that depth, with their text in page order.  Texts of any length
are kept whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, shuffle_partitions, small_side
from .url_filter import split_url

#: A constant text is template if it stands on so many different pages of the host, and on one in so many of those that have
#: its parent.
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 8

#: Pages, or wrappers, that are merged into one at a time.
GROUP = 64

#: Depth of a tree.
DEEPEST = 200

#: Cells up to which the whole table of an alignment is kept in memory.
MATCH_CELLS = 1 << 18

#: How much more the same text counts than the same kind of element.
SAME_TEXT = 4

#: Wrappers of so many bytes together are sent to all tasks; more are joined by host.
BROADCAST_BYTES = 16_000_000

#: Finished wrappers that a task keeps in memory.
KNOWN_WRAPPERS = 2_000

#: Outside of articles a block of so many characters counts as prose; articles that hold less than one in so many of all are
#: not taken for the page's content.
PROSE, ARTICLE_SHARE = 80, 3

# Names of HTML elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
NO_CONTENT = frozenset("head title script style noscript template nav aside footer button select textarea iframe svg math object dialog menu canvas audio video map".split())
ARTICLE = frozenset(("article", "main"))
LEAD = frozenset(("article", "main", "h1"))

# Words of class, id and role attributes that name what is no part of an article.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
NO_CONTENT_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login sidebar complementary nav navbar navigation menu menubar breadcrumb breadcrumbs footer contentinfo masthead"
    " share sharing social related recommended recommendations widget pagination pager toolbar skip search".split()
)
#: Words that do so only outside of an article, which may have a header of its own.
OUTSIDE_WORDS = frozenset(("header", "topbar"))
#: Words before one of those that tell of the page's layout or state: ``with-sidebar``, ``no-comments``.
STATE_WORDS = frozenset("with has have no without not is hide show open single".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>?)|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("tag", "sign", "kind", "hidden", "parts", "parent", "depth", "shown", "weight", "leads", "prose")

    def __init__(self, tag: str, sign: str, kind: str, hidden: bool, parent: Node | None):
        self.tag, self.sign, self.kind, self.hidden, self.parent = tag, sign, kind, hidden, parent
        self.parts: list[Node | str] = []
        self.depth = 0 if parent is None else parent.depth + 1
        #: For a node that is too deep: where its text goes.
        self.shown: Node | None = None

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def text(self) -> str:
        """Its own text, without that of its children."""
        return "\n".join(b for b in (" ".join(p.split()) for p in self.parts if isinstance(p, str)) if b)

    def put(self, part: Node | str) -> None:
        """Adds a part after all that is there; the text of a node that is too deep goes under the one at ``DEEPEST``."""
        if self.depth <= DEEPEST:
            self.parts.append(part)
            return
        if isinstance(part, Node) and part.tag not in RAW:
            return  # it shows where it has text
        place, hidden = self, False
        while place.depth > DEEPEST:
            hidden = hidden or place.hidden or place.tag in NO_CONTENT or place.kind != ""
            place = place.parent
        if self.shown is None or place.parts[-1] is not self.shown:
            self.shown = Node(self.tag, self.sign, "", hidden, place)
            place.parts.append(self.shown)
        if isinstance(part, str):
            self.shown.parts.append(part)


@lru_cache(1 << 14)
def _named(names: str) -> tuple[str, str]:
    """Of class, id and role: what tells kinds of elements apart, in which numbers only count, and the word that says that
    it is no content: one of ``NO_CONTENT_WORDS`` or ``OUTSIDE_WORDS``, or none."""
    kind = ""
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        for i, w in enumerate(words):
            if w in STATE_WORDS:
                break
            if w in NO_CONTENT_WORDS or (w in OUTSIDE_WORDS and not kind):
                kind = w if kind not in COMMENT_WORDS else kind
    return re.sub(r"[0-9]+", "#", names.lower()), kind


def _node(tag: str, rest: str, parent: Node) -> Node:
    if len(rest) <= 1:
        return Node(tag, tag, "", False, parent)
    got: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest.rstrip(">")):
        got.setdefault(name.lower(), value.strip("\"'"))
    sign, kind = _named(" ".join(entities.unescape(got[a]) for a in ("class", "id", "role") if a in got))
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").lower().replace(" ", "")
    return Node(tag, f"{tag} {sign}".strip(), "" if tag in ("html", "body") else kind, hidden, parent)


def parse(html: str) -> Node:
    """The tree of block elements; inline elements leave their text in the block that they stand in."""
    root = Node("html", "html", "", False, None)
    node, at, text = root, 0, []
    open_tags: Counter[str] = Counter()

    def add(raw: str) -> None:
        if raw:
            text.append(entities.unescape(raw) if "&" in raw else raw)

    def settle() -> None:
        if text:
            node.put("".join(text))
            text.clear()

    def leave(to: Node) -> Node:
        """Closes all that is open up to a node, which becomes the place."""
        n = node
        while n is not to:
            open_tags[n.tag] -= 1
            n = n.parent
        return to

    def up_to(tags: Sequence[str], stops: Sequence[str]) -> Node | None:
        if not any(open_tags[t] for t in tags):
            return None
        n = node
        while n.parent is not None and n.tag not in stops:
            if n.tag in tags:
                return n
            n = n.parent
        return None

    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if (tag := m[1]) is not None:
            tag = tag.lower()
            if tag in INLINE:
                continue
            if (found := up_to((tag,), ())) is not None:
                settle()
                node = leave(found.parent)
        elif (tag := m[2]) is not None:
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br" or tag == "wbr" or tag == "img":
                    text.append(" ")
                continue
            if tag in ("html", "body") and (tag == "html" or any(c.tag == "body" for c in root.children())):
                continue
            settle()
            if tag == "body":
                node = leave(root)
            if tag in CLOSES_P and (found := up_to(("p",), ("article", "section", "div", "td", "th", "li", "body", "main"))) is not None:
                node = leave(found.parent)
            if tag in SAME_LEVEL and (found := up_to(SAME_LEVEL[tag][0].split(), SAME_LEVEL[tag][1])) is not None:
                node = leave(found.parent)
                while node.tag in SAME_LEVEL[tag][0].split() and node.parent is not None:
                    node = leave(node.parent)
            new = _node(tag, m[3] or "", node)
            node.put(new)
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                new.parts.append(html[at : end.start()] if end else html[at:])
                at = end.end() if end else len(html)
            elif tag not in VOID and not (m[3] or "").endswith("/>"):
                node = new
                open_tags[tag] += 1
    add(html[at:])
    settle()
    return root


# A wrapper node: [sign, text's hash or '' for none or None for varying, number of pages, children]


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def fold(node: Node) -> list:
    """A page's tree as a wrapper of its own."""
    own = node.text()
    return [node.sign, _hash(own) if own else "", 1, [fold(child) for child in node.children() if child.tag not in RAW]]


def _texts(node: list, into: Counter[str]) -> Counter[str]:
    if node[1]:
        into[node[1]] += 1
    for k in node[3]:
        _texts(k, into)
    return into


class Matching:
    """Simple tree matching of two trees: the alignment of the children of two nodes that has the most in common, where a
    pair counts its own and its descendants' matches.

    Texts that stand once in both trees tell what belongs together; one that a tree repeats does not tell its place.  Nodes
    are compared by shape: sign, such a text, shapes of the children.  Rows of a page that differ in nothing else share one
    shape, and pairs of shapes are matched, not pairs of nodes; where two shapes have no text in common, their bare ones."""

    def __init__(self, a: list, b: list):
        ours, theirs = _texts(a, Counter()), _texts(b, Counter())
        self.shared = {t for t, n in ours.items() if n == 1 and theirs[t] == 1}
        self.ids: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.bare: list[int] = []
        self.texts: list[frozenset[str]] = []
        self.of: dict[int, int] = {}
        self.known: dict[tuple[int, int], int] = {}
        self._shape(a)
        self._shape(b)

    def _add(self, sign: str, text: str, kids: tuple[int, ...]) -> int:
        key = (sign, text, kids)
        if key in self.ids:
            return self.ids[key]
        texts = frozenset((text,) if text else ()).union(*(self.texts[k] for k in kids))
        bare = self._add(sign, "", tuple(self.bare[k] for k in kids)) if texts else len(self.shapes)
        self.ids[key] = len(self.shapes)
        self.shapes.append(key)
        self.texts.append(texts)
        self.bare.append(bare)
        return self.ids[key]

    def _shape(self, node: list) -> int:
        kids = tuple([self._shape(k) for k in node[3]])
        self.of[id(node)] = out = self._add(node[0], node[1] if node[1] in self.shared else "", kids)
        return out

    def weight(self, p: int, q: int) -> int:
        """What two shapes have in common."""
        if self.shapes[p][0] != self.shapes[q][0]:
            return 0
        if self.texts[p].isdisjoint(self.texts[q]):
            p, q = self.bare[p], self.bare[q]
        if (p, q) not in self.known:
            (_, text, xs), (_, same, ys) = self.shapes[p], self.shapes[q]
            inner = 0
            if xs and ys:
                step = self._steps(ys)
                row = np.zeros(len(ys) + 1, np.int64)
                for x in xs:
                    row = step(row, x)
                inner = int(row[-1])
            self.known[p, q] = 1 + SAME_TEXT * (text != "" and text == same) + inner
        return self.known[p, q]

    def _steps(self, ys: Sequence[int]) -> Callable[[np.ndarray, int], np.ndarray]:
        """The next row of the table of an alignment with ``ys``."""
        kinds, place = np.unique(np.array([self.bare[y] for y in ys], np.int64), return_inverse=True)
        holds = {t: j for j, y in enumerate(ys) for t in self.texts[y]}
        gains: dict[int, np.ndarray] = {}

        def step(before: np.ndarray, x: int) -> np.ndarray:
            bare = self.bare[x]
            if bare not in gains:
                gains[bare] = np.array([self.weight(bare, int(q)) for q in kinds], np.int64)[place]
            gain = gains[bare]
            if self.texts[x]:
                gain = gain.copy()
                for j in {holds[t] for t in self.texts[x] if t in holds}:
                    gain[j] = self.weight(x, ys[j])
            row = np.zeros_like(before)
            np.maximum.accumulate(np.maximum(before[1:], before[:-1] + gain), out=row[1:])
            return row

        return step

    def align(self, xs: list, ys: list) -> list[tuple[int | None, int | None]]:
        """Children of two nodes, paired in order; those that have no partner stand between.

        Of the table every k-th row is kept, those between are found again on the way back: all rows of a small one."""
        a, b = [self.of[id(x)] for x in xs], [self.of[id(y)] for y in ys]
        k = min(len(a), len(b))
        if a[:k] == b[:k]:  # no pair can have more in common than equal shapes
            return [(i, i) for i in range(k)] + [(i, None) for i in range(k, len(a))] + [(None, j) for j in range(k, len(b))]
        step = self._steps(b)
        k = len(a) if len(a) * len(b) <= MATCH_CELLS else math.isqrt(len(a)) + 1
        row = np.zeros(len(b) + 1, np.int64)
        kept = [row]
        for i, x in enumerate(a, 1):
            row = step(row, x)
            if i % k == 0:
                kept.append(row)
        out: list[tuple[int | None, int | None]] = []
        j = len(b)
        for block in range((len(a) - 1) // k, -1, -1):
            first = block * k
            table = [kept[block]]
            for x in a[first : first + k]:
                table.append(step(table[-1], x))
            i = min(first + k, len(a))
            while i > first:
                now, before = table[i - first], table[i - first - 1]
                # of equally good pairings the one that stands first, so what is left over comes after
                if j and now[j] == now[j - 1]:
                    j -= 1
                    out.append((None, j))
                elif now[j] == before[j]:
                    i -= 1
                    out.append((i, None))
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        out += [(None, n) for n in range(j - 1, -1, -1)]
        return out[::-1]


def align(xs: list, ys: list) -> list[tuple[int | None, int | None]]:
    """The alignment of two lists of wrapper nodes."""
    return Matching(["", "", 0, xs], ["", "", 0, ys]).align(xs, ys)


def merge(a: list, b: list, matching: Matching | None = None) -> list:
    """One wrapper of two; a node's text stays constant only if both have the same."""
    matching = matching or Matching(a, b)
    kids = [a[3][i] if j is None else b[3][j] if i is None else merge(a[3][i], b[3][j], matching) for i, j in matching.align(a[3], b[3])]
    return [a[0], a[1] if a[1] == b[1] else None, a[2] + b[2], kids]


def _without_single(node: list) -> list:
    return [*node[:3], [_without_single(k) for k in node[3] if k[2] > 1]]


def finished(node: list) -> list | None:
    """What of a wrapper is template, with its ancestors; none if nothing is."""
    kids = []
    for k in node[3]:
        below = finished(k)
        if k[1] and k[2] >= TEMPLATE_PAGES and k[2] * TEMPLATE_SHARE >= node[2]:
            kids.append([k[0], k[1], k[2], below[3] if below else []])
        elif below:
            kids.append([k[0], None, k[2], below[3]])
    return [node[0], None, node[2], kids] if kids else None


def _template(root: Node, wrapper: list | None) -> set[int]:
    """Ids of the page's nodes whose own text is the host's.  ``wrapper`` is a finished one."""
    found: set[int] = set()
    if wrapper is None:
        return found
    page = fold(root)
    matching = Matching(wrapper, page)
    if not matching.shared:
        return found

    def walk(node: Node, own: list, slot: list) -> None:
        nodes = [c for c in node.children() if c.tag not in RAW]
        for i, j in matching.align(slot[3], own[3]):
            if i is not None and j is not None:
                if slot[3][i][1] and slot[3][i][1] == own[3][j][1]:
                    found.add(id(nodes[j]))
                walk(nodes[j], own[3][j], slot[3][i])

    walk(root, page, wrapper)
    return found


def _refused(root: Node) -> set[int]:
    """Ids of nodes that are by their kind no part of the article, with all that is in them."""
    out: set[int] = set()
    doubtful: list[Node] = []

    def weigh(node: Node, inside: bool) -> None:
        """Sets what lies in a node but not in refused ones: characters, leads, paragraphs with text."""
        inside = inside or (node.tag in ARTICLE and not node.kind)
        node.weight = sum(len(p) for p in node.parts if isinstance(p, str))
        node.leads, node.prose = int(node.tag in LEAD and not node.kind), int(node.tag == "p" and node.weight > 0)
        for child in node.children():
            if child.hidden or child.tag in NO_CONTENT or child.tag in RAW:
                out.add(id(child))
                continue
            named = child.kind and (not inside or child.kind not in OUTSIDE_WORDS)
            bad = child.tag == "form" or named or (child.tag == "header" and not inside)
            if bad:
                out.add(id(child))
                doubtful.append(child)
            weigh(child, inside)
            if not bad:
                node.weight += child.weight
                node.leads += child.leads
                node.prose += child.prose

    weigh(root, False)
    weight, leads = root.weight, root.leads
    kept: set[int] = set()
    for node in doubtful:
        n = node.parent
        while n is not None and (id(n) not in out or id(n) in kept):
            n = n.parent
        if n is not None or leads or node.weight <= weight:
            continue
        # the page has nothing else, and this looks like its article
        if node.leads or (node.prose and node.kind not in COMMENT_WORDS):
            kept.add(id(node))
            weight, leads = weight + node.weight, leads + node.leads
    return out - kept


def extract(root: Node, wrapper: list | None) -> str:
    """The text of a page's content slots."""
    template, refused = _template(root, wrapper), _refused(root)
    blocks: list[tuple[bool, str]] = []

    def walk(node: Node, inside: bool) -> None:
        if id(node) in refused:
            return
        inside = inside or node.tag in ARTICLE
        own = id(node) not in template
        for part in node.parts:
            if isinstance(part, Node):
                walk(part, inside)
            elif own and (block := " ".join(part.split())):
                blocks.append((inside, block))

    walk(root, False)
    within = sum(len(b) for i, b in blocks if i)
    prose = sum(len(b) for i, b in blocks if not i and len(b) >= PROSE)
    only = within > 0 and within * (ARTICLE_SHARE - 1) >= prose
    return "\n".join(b for i, b in blocks if i or not only)


def _folded(pages: DataFrame) -> DataFrame:
    """(host, page, wrapper) of each page that has html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                keep = [i for i, t in enumerate(texts) if t]
                data = [part.column(0).take(pa.array(keep, pa.int64())), pa.array([_hash(texts[i]) for i in keep], pa.string()), pa.array([json.dumps(fold(parse(texts[i])), separators=(",", ":")) for i in keep], pa.string())]
                yield pa.RecordBatch.from_arrays(data, ["host", "page", "wrapper"])

    return pages.mapInArrow(lean(run), "host string, page string, wrapper string")


def _merged(wrappers: DataFrame) -> DataFrame:
    """One (host, group, wrapper) of all with the same (host, group), in order of ``page``, each page once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, out: list) -> pa.RecordBatch:
            host, group = key
            return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([group], pa.int64()), pa.array([json.dumps(_without_single(out) if out[2] >= GROUP else out, separators=(",", ":"))], pa.string())], ["host", "group", "wrapper"])

        now, last, out = None, None, None
        for batch in batches:
            for host, group, page, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, group) != now:
                    if out is not None:
                        yield row(now, out)
                    now, last, out = (host, group), None, None
                if page != last:
                    new = json.loads(wrapper)
                    out = new if out is None else merge(out, new)
                    last = page
        if out is not None:
            yield row(now, out)

    dealt = wrappers.repartition(shuffle_partitions(wrappers.sparkSession), "host", "group").sortWithinPartitions("host", "group", "page")
    return dealt.select("host", "group", "page", "wrapper").mapInArrow(lean(run), "host string, group long, wrapper string")


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from pages (host, html): the template nodes of hosts that have any."""
    sizes = cut(pages.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")))
    most = sizes.agg(F.coalesce(F.max("groups"), F.lit(1)).alias("n")).first().n
    number = F.conv(F.substring("page", 1, 15), 16, 10).cast("long") % F.col("groups")
    folded = _folded(pages.select("host", "html"))
    level = _merged(folded.join(small_side(sizes), "host").select("host", number.alias("group"), "page", "wrapper"))
    while most > 1:
        level = _merged(level.select("host", F.floor(F.col("group") / GROUP).alias("group"), F.format_string("%016x", "group").alias("page"), "wrapper"))
        most = -(-most // GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(h, finished(json.loads(w))) for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            done = [(h, json.dumps(w, separators=(",", ":"))) for h, w in done if w is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["host", "wrapper"])

    return cut(level.select("host", "wrapper").mapInArrow(lean(run), "host string, wrapper string"))


def main_text(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), url: str = "url", html: str = "html") -> DataFrame:
    """``keep`` columns of ``pages`` with text and n_chars."""
    host, _ = split_url(F.col(url))
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    source = pages.select(*kept, host.alias("host"), F.col(html).alias("html"))
    wrappers = induce(source)
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0)).alias("n")).first().n
    joined = source.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in names), "text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for host, wrapper, html in zip(*(part.column(len(names) + i) for i in range(3)), strict=True):
                    host = host.as_py()
                    if host not in known:
                        if len(known) >= KNOWN_WRAPPERS:
                            known.clear()
                        known[host] = json.loads(wrapper.as_py()) if wrapper.is_valid else None
                    text = html.as_py()
                    texts.append(extract(parse(text), known[host]) if text else "")
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    out = joined.select(*names, "host", "wrapper", "html").mapInArrow(lean(run), schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")
