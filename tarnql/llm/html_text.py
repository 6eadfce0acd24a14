"""Main text of web pages by wrappers: union-free regular expressions over token streams.

A page's token stream has its tags, named with class, id and role, and its
texts.  A wrapper is a nested pattern of such tokens: an element may be
optional, repeated, or a text slot.  It starts as one page's pattern and is
aligned with further pages of the same host, one after the other.  Where the
streams agree nothing changes.  A mismatch of texts makes a slot; neighbours of
one pattern become a repeated group; a part that one side lacks becomes
optional.  Wrappers align with wrappers in the same way, so each task infers
one for each of its hosts' layouts, and the tasks' wrappers meet by host: a
host with a third of all pages sends one wrapper of a layout for each task.

Pages of a host have the same layout if all have text in a marked article, or if
none has and the same element holds the most running text.  The finished wrapper
of a layout decides which slots hold the main text: those of the article without
boilerplate elements; where none is marked, all without boilerplate elements,
slots of mostly links and texts that are the same on more than half of the
host's pages, two at least.

Each page is then read by its layout's wrapper: its elements are matched, in
their order, with those of the pattern, where optional ones may be left out and
repeated ones come again.  A text that meets a slot goes with the slot; a text
in an element that the pattern lacks is decided by its own place in the page.  A
page without text in main slots is decided by its own pattern.

Defined cases: null and empty html give the empty text.  Urls without a host
share one wrapper.  Unclosed comments, scripts and elements end with the page.
Repeated rows are extracted each.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import common

# Element and name lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = frozenset("head nav footer aside form button select option label input dialog menu svg object script style textarea title noscript xmp iframe noframes template".split())
MAIN = frozenset("article main".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer foot sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments reply replies respond disqus discussion share sharing social related recommended subscribe newsletter signup login search pagination pager toolbar copyright".split()
)
MAIN_NAMES = frozenset("main article content post entry story".split())
#: A start tag closes these open elements, up to the nearest element of the second set.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("article main section div ul ol dl table body html aside nav footer header form blockquote td th li".split())

#: Elements whose text blocks make a layout.
HOLDERS = frozenset("html body div section".split())
#: The layout of pages with text in a marked article.
MARKED = "*"
#: Elements nested deeper belong to the one at this depth; of them only those that make or end boilerplate or the main text tell a path.
DEPTH = 64
#: Rows of a table of alignments that are filled cell by cell; longer sequences are halved first.
CELLS = 4096
#: Text of compact wrappers that a worker remembers parsed, about.
WRAPPER_BYTES = 4 << 20
#: A host's wrappers meet in so many groups first.
GROUPS = 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|style|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def _label(tag: str, attributes: str) -> str:
    """The tag with its names, digits as #; hidden elements are marked."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    words: list[str] = []
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            words.append("!hidden")
        elif name != "style":
            words += re.sub(r"\d+", "#", value).split()
    return ".".join([tag, *sorted(dict.fromkeys(w.replace("/", "") for w in words))])


@lru_cache(maxsize=100_000)
def _is_boilerplate(label: str) -> bool:
    tag, *names = label.split(".")
    if tag in BOILERPLATE or "!hidden" in names:
        return True
    if tag in MAIN or tag in ("html", "body"):
        return False
    return any(w in BOILERPLATE_NAMES for n in names for w in re.split(r"[^a-z]+", n))


@lru_cache(maxsize=100_000)
def _is_main(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in MAIN or "main" in names or (tag in ("div", "section") and any(w in MAIN_NAMES for n in names for w in re.split(r"[^a-z]+", n)) and not _is_boilerplate(label))


@lru_cache(maxsize=100_000)
def _is_skipped(path: tuple[str, ...]) -> bool:
    """A boilerplate element is on the path."""
    inside = False
    for label in path:
        if _is_boilerplate(label):
            return True
        if label.split(".")[0] == "header" and not inside:
            return True
        inside |= _is_main(label)
    return False


def _short(labels: list[str]) -> tuple[str, ...]:
    """The first ``DEPTH`` labels, and of the others the first one of each kind that tells main text or boilerplate."""
    out, kinds = labels[:DEPTH], set()
    for label in labels[DEPTH:]:
        kind = _is_boilerplate(label), _is_main(label), label.split(".")[0] == "header"
        if any(kind) and kind not in kinds:
            kinds.add(kind)
            out.append(label)
    return tuple(out)


def stream(page: str) -> Iterator[tuple[tuple[str, ...], str | None, bool]]:
    """(path, text, in a link) for each text, and (path, None, False) at each block's edge."""
    open_: list[tuple[str, str]] = []  # (tag, label) of open elements
    links = at = 0

    def path() -> tuple[str, ...]:
        if len(open_) <= DEPTH:
            return tuple(label for tag, label in open_ if tag not in INLINE or "." in label)
        return _short([label for tag, label in open_ if tag not in INLINE or "." in label])

    now = path()
    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            yield now, entities.unescape(page[at:start]), links > 0
        if m is None:
            return
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                yield now, m[0][9:].removesuffix("]]>"), links > 0
            continue
        tag = tag.lower()
        if closing:
            if any(t == tag for t, _ in open_):
                # an inline end tag doesn't close the blocks inside it
                if tag in INLINE:
                    for i in range(len(open_) - 1, -1, -1):
                        if open_[i][0] == tag:
                            del open_[i]
                            break
                        if open_[i][0] not in INLINE:
                            break
                else:
                    while open_.pop()[0] != tag:
                        pass
        elif tag in VOID:
            pass
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        else:
            implied = IMPLIED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if implied:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] in implied:
                        del open_[i:]
                        yield path(), None, False
                        break
                    if open_[i][0] in SCOPE and open_[i][0] not in implied:
                        break
            if not attributes.rstrip().endswith("/"):
                open_.append((tag, _label(tag, attributes)))
        now = path()
        links = sum(t == "a" for t, _ in open_)
        if tag not in INLINE:
            yield now, None, False


class Node:
    """An element of a wrapper."""

    __slots__ = ("label", "optional", "repeated", "pages", "chars", "linked", "text", "children")

    def __init__(self, label: str):
        self.label, self.optional, self.repeated = label, False, False
        self.pages, self.chars, self.linked = 1, 0, 0  # pages: seen on so many, at least
        self.text: str | None = None  # a slot's mark while its text is the same on all pages
        self.children: list[Node] = []

    def pack(self) -> list:
        return [self.label, self.optional, self.repeated, self.pages, self.chars, self.linked, self.text, [c.pack() for c in self.children]]

    @staticmethod
    def unpack(x: list) -> Node:
        node = Node(x[0])
        _, node.optional, node.repeated, node.pages, node.chars, node.linked, node.text, children = x
        node.children = [Node.unpack(c) for c in children]
        return node


def _same_element(a: Node, b: Node) -> None:
    """Takes ``b`` into ``a``, two elements of one page in a repeated group."""
    _into(a, b, one_page=True)
    a.repeated = True


def _into(a: Node, b: Node, one_page: bool = False) -> None:
    a.pages = max(a.pages, b.pages) if one_page else a.pages + b.pages
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.chars += b.chars
    a.linked += b.linked
    if a.text != b.text:
        a.text = None
    a.children = _align(a.children, b.children, one_page)


def _align(left: list[Node], right: list[Node], one_page: bool) -> list[Node]:
    """One sequence for both: the longest common sequence of labels; what one side lacks is optional."""
    if [n.label for n in left] == [n.label for n in right]:
        for a, b in zip(left, right, strict=True):
            _into(a, b, one_page)
        return left
    pairs = common_labels([x.label for x in left], [x.label for x in right])
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(left), len(right))]:
        for node in (*left[i:x], *right[j:y]):
            node.optional = True
            out.append(node)
        if x < len(left):
            _into(left[x], right[y], one_page)
            out.append(left[x])
        i, j = x + 1, y + 1
    return _fold(out)


def common_labels(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence, in memory linear in the lengths.

    Ends that agree are taken off; what remains is halved where a longest
    sequence passes the middle, until the table of lengths is small.
    """
    a = b = 0
    while a < min(len(left), len(right)) and left[a] == right[a]:
        a += 1
    while b < min(len(left), len(right)) - a and left[-1 - b] == right[-1 - b]:
        b += 1
    names = {x: k for k, x in enumerate(dict.fromkeys(left))}
    one = np.array([names[x] for x in left[a : len(left) - b]], np.int64)
    two = np.array([names.get(x, -1) for x in right[a : len(right) - b]], np.int64)
    inner, todo = [], [(0, len(one), 0, len(two))]
    while todo:
        i, n, j, m = todo.pop()
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= CELLS or n - i == 1:
            inner += _common_small(one, two, i, n, j, m)
            continue
        mid = (i + n) // 2
        total = _common_lengths(one[i:mid], two[j:m]) + _common_lengths(one[mid:n][::-1], two[j:m][::-1])[::-1]
        cut = j + int(total.argmax())
        todo += [(i, mid, j, cut), (mid, n, cut, m)]
    return [*((k, k) for k in range(a)), *((a + i, a + j) for i, j in sorted(inner)), *((len(left) - k, len(right) - k) for k in range(b, 0, -1))]


def _common_lengths(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lengths of the longest common sequences of ``one`` and each beginning of ``two``, row by row."""
    row = np.zeros(len(two) + 1, np.int32)
    for x in one:
        row[1:] = np.maximum(row[1:], row[:-1] + (two == x))
        np.maximum.accumulate(row, out=row)
    return row


def _common_small(one: np.ndarray, two: np.ndarray, i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    if n - i == 1:
        at = np.flatnonzero(two[j:m] == one[i])
        return [(i, j + int(at[0]))] if len(at) else []
    left, right = one[i:n].tolist(), two[j:m].tolist()
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for x in range(len(left) - 1, -1, -1):
        for y in range(len(right) - 1, -1, -1):
            best[x][y] = best[x + 1][y + 1] + 1 if left[x] == right[y] else max(best[x + 1][y], best[x][y + 1])
    out, x, y = [], 0, 0
    while x < len(left) and y < len(right):
        if left[x] == right[y]:
            out.append((i + x, j + y))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def _fold(nodes: list[Node]) -> list[Node]:
    """Neighbouring groups of one to four elements with the same labels become one repeated group."""
    for width in (1, 2, 3, 4):
        out: list[Node] = []
        for node in nodes:
            out.append(node)
            if len(out) >= 2 * width and [x.label for x in out[-width:]] == [x.label for x in out[-2 * width : -width]]:
                for a, b in zip(out[-2 * width : -width], out[-width:], strict=True):
                    _same_element(a, b)
                del out[-width:]
        nodes = out
    return nodes


def _mark(words: str) -> str:
    """Stands for a text when texts are compared: itself if it is short, or its digest."""
    return words if len(words) <= 80 else "#" + hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def pattern(page: str) -> Node:
    """One page's wrapper."""
    root = Node("")
    at: list[Node] = [root]
    labels: tuple[str, ...] = ()
    for path, text, in_link in stream(page):
        if path != labels:
            keep = 0
            while keep < min(len(path), len(labels)) and path[keep] == labels[keep]:
                keep += 1
            for node in at[keep + 1 :][::-1]:
                node.children = _fold(node.children)
            del at[keep + 1 :]
            for label in path[keep:]:
                node = Node(label)
                at[-1].children.append(node)
                at.append(node)
            labels = path
        if text and (words := " ".join(text.split())):
            slot = Node("#")
            slot.chars, slot.text = len(words), _mark(words)
            slot.linked = len(words) if in_link else 0
            last = at[-1].children[-1] if at[-1].children else None
            if last is not None and last.label == "#":
                whole = _mark(f"{last.text} {slot.text}")
                _into(last, slot, one_page=True)
                last.text = whole
            else:
                at[-1].children.append(slot)
    for node in at[::-1]:
        node.children = _fold(node.children)
    return root


def merge(a: Node, b: Node) -> Node:
    """The wrapper of both wrappers' pages."""
    _into(a, b)
    return a


def _by_path(wrapper: Node) -> dict[tuple[str, ...], list[Node]]:
    """The slots at each path."""
    found: dict[tuple[str, ...], list[Node]] = {}

    def walk(node: Node, path: tuple[str, ...]) -> None:
        for child in node.children:
            if child.label == "#":
                found.setdefault(path, []).append(child)
            else:
                walk(child, (*path, child.label))

    walk(wrapper, ())
    return found


def template_paths(wrappers: list[Node]) -> set[tuple[str, ...]]:
    """Paths whose texts are each the same on most pages of a host, given by its layouts' wrappers."""
    seen: dict[tuple[str, ...], dict[str | None, int]] = {}
    for wrapper in wrappers:
        for path, slots in _by_path(wrapper).items():
            # of slots with one text only the most frequent counts: they may lie on the same pages
            own: dict[str | None, int] = {}
            for n in slots:
                text = None if n.repeated else n.text
                own[text] = max(own.get(text, 0), n.pages)
            texts = seen.setdefault(path, {})
            for text, pages in own.items():
                texts[text] = texts.get(text, 0) + pages
    least = max(2, sum(w.pages for w in wrappers) // 2 + 1)
    return {path for path, texts in seen.items() if None not in texts and min(texts.values()) >= least}


def layout(page: str) -> str:
    """MARKED, or the path of the element that holds the most running text."""
    chars: dict[tuple[str, ...], int] = {}
    for path, text, in_link in stream(page):
        if not text or not (size := len(text.strip())) or _is_skipped(path):
            continue
        if any(map(_is_main, path)):
            return MARKED
        if not in_link:
            d = len(path)
            while d and path[d - 1].split(".")[0] not in HOLDERS:
                d -= 1
            chars[path[:d]] = chars.get(path[:d], 0) + size
    return "/".join(max(chars, key=lambda p: (chars[p], p), default=()))


def main_slots(wrapper: Node, template: set[tuple[str, ...]] | None = None) -> list[str]:
    """The paths of the slots that hold the main text; ``template`` has those of the host's template texts."""
    if template is None:
        template = template_paths([wrapper])
    by_path = _by_path(wrapper)
    good = {p: ns for p, ns in by_path.items() if not _is_skipped(p)}
    inside = {p: ns for p, ns in good.items() if any(map(_is_main, p))}
    if not any(n.chars for ns in inside.values() for n in ns):
        good = {p: ns for p, ns in good.items() if p not in template} or good
        inside = {p: ns for p, ns in good.items() if sum(n.linked for n in ns) <= 0.5 * sum(n.chars for n in ns)}
    return ["/".join(p) for p in inside]


def extract(page: str, slots: frozenset[str]) -> str:
    """The texts of the slots: white space inside a block is one blank, and so is what parts blocks."""
    out: list[str] = []
    for path, text, _ in stream(page):
        if text is None:
            out.append(" ")
        elif "/".join(path) in slots:
            out.append(text)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def page_text(page: str, slots: frozenset[str]) -> str:
    """The slots' texts, or if there are none those that the page alone gives."""
    return extract(page, slots) or extract(page, frozenset(main_slots(pattern(page))))


#: What a compact wrapper says of an element.
OPTIONAL, REPEATED, KEPT = 1, 2, 4


def compact(wrapper: Node, template: set[tuple[str, ...]], pages: int) -> list:
    """[label, what is said of it, children] for each element; what holds no main text has no children.

    ``template`` has the host's template paths, and ``pages`` its number of pages.
    """
    paths = frozenset(main_slots(wrapper, template))
    least = max(2, pages // 2 + 1)
    marked = any(any(map(_is_main, p.split("/"))) for p in paths)

    def keeps(slot: Node, path: str) -> bool:
        # of slots with one path, those with one text on most pages are left out; if all have one, the path tells
        return path in paths and (marked or slot.text is None or slot.repeated or slot.pages < least or path not in varied)

    varied = {"/".join(p) for p, slots in _by_path(wrapper).items() if any(n.text is None or n.pages < least for n in slots)}

    def pack(node: Node, path: tuple[str, ...]) -> list:
        said = OPTIONAL * node.optional + REPEATED * node.repeated
        if node.label == "#":
            return ["#", said + KEPT * keeps(node, "/".join(path)), []]
        inner = [pack(c, (*path, c.label) if c.label != "#" else path) for c in node.children]
        if any(x[1] & KEPT for x in inner):
            return [node.label, said + KEPT, inner]
        return [node.label, said, []]

    return pack(wrapper, ())


def _meet(elements: list, at: int, label: str) -> int:
    """The place of the pattern's element that an element with the label meets, from place ``at`` on; -1 if none does."""
    if at < len(elements) and elements[at][0] == label:
        return at
    if at and elements[at - 1][0] == label and elements[at - 1][1] & REPEATED:
        return at - 1
    later = next((k for k in range(at, len(elements)) if elements[k][0] == label), -1)
    if later >= 0 and all(x[1] & OPTIONAL for x in elements[at:later]):
        return later
    again = next((k for k in range(at - 1, -1, -1) if elements[k][0] == label and elements[k][1] & REPEATED), -1)
    return again if again >= 0 else later


def matched(page: str, wrapper: list) -> str:
    """The page's main text by its layout's compact wrapper."""
    out: list[str] = []
    marked = bool(wrapper[1] & KEPT) and _has_main(wrapper)
    # open elements: the pattern's one that each has met, or None, and the place behind its last child's; the first is the page
    met: list[list | None] = [wrapper]
    places = [0]
    labels: tuple[str, ...] = ()
    slot: list | None = None  # met by the text before, while no element lies between
    for path, text, _ in stream(page):
        if path != labels:
            keep = 0
            while keep < min(len(path), len(labels)) and path[keep] == labels[keep]:
                keep += 1
            del met[keep + 1 :], places[keep + 1 :]
            for label in path[keep:]:
                mine = met[-1]
                k = -1 if mine is None else _meet(mine[2], places[-1], label)
                if k >= 0:
                    places[-1] = k + 1
                # all of an element that holds no main text is left out
                met.append(mine[2][k] if k >= 0 else mine if mine is not None and not mine[1] & KEPT else None)
                places.append(0)
            labels, slot = path, None
        if text is None:
            out.append(" ")
            continue
        if not text.strip():
            out.append(text if slot is None or slot[1] & KEPT else " ")
            continue
        mine = met[-1]
        if mine is not None and slot is None:
            k = _meet(mine[2], places[-1], "#")
            if k >= 0:
                places[-1] = k + 1
                slot = mine[2][k]
        if slot is not None:
            good = bool(slot[1] & KEPT)
        elif mine is not None and not mine[1] & KEPT:
            good = False
        else:  # the pattern has no text here: the page's own place tells
            good = not _is_skipped(path) and (not marked or any(map(_is_main, path)))
        out.append(text if good else " ")
    return " ".join("".join(out).split())


def _has_main(wrapper: list) -> bool:
    return any(x[1] & KEPT and x[0] != "#" and (_is_main(x[0]) or _has_main(x)) for x in wrapper[2])


def host(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, wrapper): compact wrappers of each host's layouts, from all their pages.

    Tasks infer their own pages' wrappers first; a layout's wrappers, one for
    each task at most, then meet; the host's template texts come from all of them.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[str, str], Node] = {}
        for batch in common.slices(batches, 1):
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    key, new = (name, layout(page)), pattern(page)
                    own[key] = merge(own[key], new) if key in own else new
        columns = [[h for h, _ in own], [x for _, x in own], [json.dumps(w.pack()) for w in own.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "layout", "wrapper"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper = None, None
        for batch in batches:
            out = []
            for h, x, text in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "wrapper")), strict=True):
                new = Node.unpack(json.loads(text))
                if (h, x) == now:
                    wrapper = merge(wrapper, new)
                else:
                    if now is not None:
                        out.append((*now, json.dumps(wrapper.pack())))
                    now, wrapper = (h, x), new
            yield _rows(out)
        yield _rows([] if now is None else [(*now, json.dumps(wrapper.pack()))])

    def _rows(out: list[tuple[str, str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["host", "layout", "wrapper"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, layouts = None, {}
        out: list[tuple[str, str, str]] = []

        def end() -> None:
            template, n = template_paths(list(layouts.values())), sum(w.pages for w in layouts.values())
            out.extend((name, x, json.dumps(compact(w, template, n), separators=(",", ":"))) for x, w in layouts.items())

        for batch in batches:
            for h, x, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != name:
                    end()
                    name, layouts = h, {}
                new = Node.unpack(json.loads(text))
                layouts[x] = merge(layouts[x], new) if x in layouts else new
        end()
        yield _rows(out)

    kind = "host string, layout string, wrapper string"
    found = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(each, kind)
    # a host's wrappers, one of a layout for each task, meet in groups first, so no task gathers those of all tasks
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    found = found.repartition("host", "layout", "part").sortWithinPartitions("host", "layout", "part", "wrapper").mapInArrow(gather, kind)
    return found.repartition("host").sortWithinPartitions("host", "layout", "wrapper").mapInArrow(meet, kind)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    found = common.stored(wrappers(pages))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2):
            found = [layout(page) if page else "" for page in batch.column("html").to_pylist()]
            yield batch.append_column("layout", pa.array(found, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2):
            known = common.remembered("wrappers", lambda: common.Words(json.loads, most=WRAPPER_BYTES))
            texts = []
            for page, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(((matched(page, known[own]) if own else "") or extract(page, frozenset(main_slots(pattern(page))))) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    rows = rows.mapInArrow(lay, "page_id long, url string, html string, host string, layout string")
    # Spark broadcasts the layouts' wrappers only below its own size limit, and joins by sorting above it
    return rows.join(found, ["host", "layout"], "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.read(spark, sf_dir, "pages"))
