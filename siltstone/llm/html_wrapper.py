"""Main text of web pages by wrappers: union-free regular expressions of a host's pages.

A page is a stream of block tags and strings. The pages of a host are aligned one after
another. Where the labels of two sequences agree, nodes are merged in pairs: equal strings
stay, as part of the *template*, and strings that differ become a *text slot*. Where labels
disagree, the sequences are aligned at the least cost, by labels and by the strings that both
sides have, and by the labels below; what stands on one side only becomes optional, and an optional
node beside one of its kind, or a repeated sequence of nodes, becomes a repeated group - unless that
would give up a string that a share of the pages has so far. No unions arise. Alignments take memory in
proportion to one sequence, whatever their lengths, and elements may be nested to any depth.

A wrapper's slots are then judged, once for the host, and a page takes the verdicts of those that it
fills. Text inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments that the
page marks as such (by elements, classes and ids) is in no slot. A slot inside a marked article is
article text, whatever it holds: the mark is the pages' own word, and an article's paragraph may stand on
many pages. Of the others, template is what a string of one slot makes that is aligned on LEAST_PAGES
pages and more than half of the host's, and links are slots that are links for the most part over all
pages, headings aside; neither is main text, nor is what stands outside the host's main region: the
innermost element that holds two thirds of what is left and every heading of it, in no element that
has such text of its own beside elements. A page gives what it has in article slots,
else what it has in main slots, else (a host of copies) all of it.

Tasks align the pages they have of a host before anything is dealt out, then a host's parts
meet in two more rounds, 256 and 16 of them at most in one task's key.
"""

from __future__ import annotations

import bisect
import collections
import html as html_entities
import json
import re
import sys
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.llm.rows import ROW, append
from siltstone.llm.scratch import materialize

#: Parts of a host that are aligned on their own, round by round; hosts that a task holds at once.
SALTS, HELD = (256, 16, 1), 2000
#: A string that fewer than one of so many pages have is no candidate for the template.
SHARE = 16
#: Pages on which a string of the template stands at least.
LEAST_PAGES = 3
#: Share of all text (thirds) that the main region holds.
MOST_OF = 2

_words = lambda s: frozenset(s.split())
#: Elements without content, with content that is no text (without an end tag: up to the end of the page, but for the two
#: that hold markup), in whose content '/>' ends an element, and inside a line of text (fixed values of HTML, SVG and MathML).
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title noscript iframe template")
MARKUP = _words("noscript template")
FOREIGN = _words("svg math")
INLINE = _words(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "svg math canvas object text tspan textpath g path circle ellipse line rect polyline polygon use defs symbol desc clippath mask image lineargradient radialgradient stop "
    "semantics annotation mrow mi mo mn mtext ms mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose merror mmultiscripts mprescripts"
)
#: Open elements that a start tag ends, by its name (fixed values of HTML).
_ENDS = {"li": _words("li p"), "dt": _words("dt dd p"), "dd": _words("dt dd p"), "tr": _words("tr td th p"), "td": _words("td th p"), "th": _words("td th p"), "option": _words("option")}
#: Where those searches stop.
_SCOPE = _words("ul ol dl table article section div main body aside nav footer header form")
#: Elements, and classes, ids or their first words, that are never main text.
SKIP_TAGS = _words("nav header footer aside form head button select dialog menu")
SKIP_NAMES = _words(
    "ad ads advert advertisement banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright "
    "notice notices cookie cookies consent alert popup modal newsletter subscribe signup login search share sharing social related recommended comment comments commentlist "
    "replies reply discussion disqus form widget toolbar pagination pager tags skip"
)
ARTICLE_TAGS = _words("article main")
#: Elements that are not judged by their classes and id.
UNJUDGED = _words("html body") | ARTICLE_TAGS
#: What the label of boilerplate starts with; no tag does.
SKIP = "!"

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[a-z]+")


class Place(NamedTuple):
    """An open element: what holds it, its label, and whether it lies in boilerplate or in a marked article."""

    parent: Place | None
    label: str
    skipped: bool
    article: bool


def label_of(tag: str, attributes: str) -> str:
    """The tag with its classes, or id; digits don't tell labels apart. Boilerplate is marked, by all classes and the id."""
    found = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    if found.get("role", "") == "main":
        tag = "main"
    if tag not in ("html", "body") and ("hidden" in found or found.get("aria-hidden", "") == "true"):
        return f"{SKIP}{tag}.hidden"
    tokens = [] if tag in UNJUDGED else [*found.get("class", "").split(), *found.get("id", "").split()]
    skip = tag in SKIP_TAGS or any((head := _LETTERS.search(t)) and head[0] in SKIP_NAMES for t in tokens)
    name = " ".join(found.get("class", "").split()) or found.get("id", "").strip()
    return (SKIP if skip else "") + tag + ("." + re.sub(r"\d+", "0", name) if name else "")


def blocks(page: str) -> Iterator[tuple[str, Place | None, str, int]]:
    """('open' | 'close' | 'text', its place, text, its characters in links) events of a page, in page order."""
    stack: list[str] = []  # every open element
    opened: collections.Counter[str] = collections.Counter()
    path: Place | None = None
    held: list[str] = []
    linked = [0, 0]  # characters in links of what is held, and whether a link is open

    def hold(raw):
        held.append(raw)
        if linked[1]:
            linked[0] += len(raw.strip())

    def flush():
        text = _SPACE.sub(" ", html_entities.unescape("".join(held))).strip()
        share = min(linked[0], len(text))
        held.clear()
        linked[0] = 0
        return text, share

    def close(depth):
        nonlocal path
        while len(stack) > depth:
            opened[stack.pop()] -= 1
            yield "close", path, "", 0
            path = path.parent

    at, end, foreign = 0, len(page), 0
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            hold(page[at:])
            break
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br" or (tag in VOID and tag not in ("hr",)):
            held.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                linked[1] = not m[1]
            if tag in FOREIGN and (m[1] or not m[3].endswith("/>")):
                foreign = max(foreign + (-1 if m[1] else 1), 0)
            continue
        if foreign and m[3].endswith("/>"):
            continue
        if tag in RAW and not m[1]:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not stop and tag in MARKUP:
                continue
            at = stop.end() if stop else end
            if (text := flush())[0]:
                yield "text", path, *text
            continue
        if (text := flush())[0]:
            yield "text", path, *text
        if tag == "hr" or tag in RAW:
            continue
        if m[1]:
            if opened[tag]:
                yield from close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i] == tag))
            continue
        ends = _ENDS.get(tag, _words("p")) if tag not in ("html", "body") else frozenset()
        if any(opened[e] for e in ends):
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i] in ends or stack[i] in _SCOPE)
            if stack[depth] in ends:
                if tag not in ("td", "th"):  # the outermost of those that the start tag ends
                    while depth and stack[depth - 1] in ends:
                        depth -= 1
                yield from close(depth)
        label = label_of(tag, m[3])
        stack.append(tag)
        opened[tag] += 1
        path = Place(path, label, bool(path and path.skipped) or is_boilerplate(label), bool(path and path.article) or is_article(label))
        yield "open", path, "", 0
    if (text := flush())[0]:
        yield "text", path, *text


# An expression is [label, least, many, children]; '(' is a group without a label. A string is
# ['#', least, many, [], key of the string or 0 for a slot, pages, characters, characters in links].


def parse(page: str) -> tuple[list, list[tuple[Place | None, str]]]:
    """The expression of one page, without what stands inside boilerplate, and (place, string) of its strings in page order."""
    root: list = ["", 1, 0, []]
    open_, texts = [root], []
    for kind, path, text, linked in blocks(page):
        if kind == "open":
            node = [path.label, 1, 0, []]
            if not (path.parent and path.parent.skipped):
                open_[-1][3].append(node)
            open_.append(node)
        elif kind == "close":
            open_.pop()
        elif not (path and path.skipped):
            open_[-1][3].append(["#", 1, 0, [], (zlib.crc32(text.encode()) << 24 | min(len(text), (1 << 24) - 2)) + 1, 1, len(text), linked])
            texts.append((path, text))
    return root, texts


def signature(n: list):
    return n[0] if n[0] != "(" else ("(", *[signature(c) for c in n[3]])


def members(nodes: list) -> Iterator[list]:
    """The nodes, with those of a group in its place."""
    for n in nodes:
        if n[0] == "(":
            yield from members(n[3])
        else:
            yield n


def shape(n: list) -> frozenset:
    """The labels that stand in a node."""
    return frozenset(c[0] for c in members(n[3])) if n[0] != "#" else frozenset()


def alike(a: frozenset, b: frozenset) -> bool:
    """Whether nodes of these shapes may be one."""
    return not a or not b or not a.isdisjoint(b)


def strings(n: list, least: int = 1) -> frozenset:
    """Keys of the strings in a node that so many pages share at least."""
    found, left = set(), [n]
    while left:
        n = left.pop()
        if n[0] == "#":
            if n[4] and n[5] >= least:
                found.add(n[4])
        else:
            left += n[3]
    return frozenset(found)


def merge(a: list, b: list, same: bool = False, least: int = 2) -> list:
    """The expression of two nodes with one label, of different pages or (``same``) beside each other.

    Strings on fewer than ``least`` pages may be given up.
    """
    head = [a[0], min(a[1], b[1]), max(a[2], b[2])]
    if a[0] == "#":
        return [*head, [], a[4] if a[4] == b[4] else 0, max(a[5], b[5]) if same else a[5] + b[5], a[6] + b[6], a[7] + b[7]]
    return [*head, align(a[3], b[3], same, least)]


def least_of(pages: int) -> int:
    """Pages that share a string which is a candidate for the template of so many."""
    return max(2, pages // SHARE)


def repeat(a: list, b: list, least: int) -> list:
    out = merge(a, b, True, least)
    return [out[0], out[1], 1, *out[3:]]


def fold(nodes: list, least: int) -> list:
    """Neighbours of one kind, then sequences of them, as repeated groups.

    Only where one of them is optional or repeated; strings that pages share are not given up.
    """

    def may(own):
        return any(not n[1] or n[2] for n in own) and not any(strings(n, least) for n in own)

    out: list = []
    for n in nodes:
        while out and signature(out[-1]) == signature(n) and alike(shape(out[-1]), shape(n)) and may((out[-1], n)):
            n = repeat(out.pop(), n, least)
        out.append(n)
    if not any(not n[1] or n[2] for n in out):
        return out
    codes: dict = {}
    kinds = [codes.setdefault(signature(n), len(codes)) for n in out]
    width = 2
    while 2 * width <= len(out):
        known = np.asarray(kinds)
        equal = np.concatenate(([0], np.cumsum(known[:-width] == known[width:])))
        runs = np.flatnonzero(equal[width:] - equal[:-width] == width)  # where a sequence stands twice
        i = int(runs[0]) if len(runs) else len(out)
        while i + 2 * width <= len(out):
            j = i + width
            while kinds[j : j + width] == kinds[i : i + width]:
                j += width
            if j > i + width and may(out[i:j]):
                group = ["(", 1, 0, out[i : i + width]]
                for k in range(i + width, j, width):
                    group = repeat(group, ["(", 1, 0, out[k : k + width]], least)
                out[i:j], kinds[i:j] = [group], [codes.setdefault(signature(group), len(codes))]
            i += 1
        width += 1
    return out


def optional(n: list) -> list:
    return [n[0], 0, *n[2:]]


#: Weights of a pair in an alignment: for its label, for labels below that both have, for each string that both have.
PAIR, BELOW, COMMON = 4, 4, 8
#: Rows of an alignment whose scores are held at once when its path is traced; the path is the same for any number.
ROWS = 16


def pairs(xs: list, ys: list) -> list[tuple[int, int]]:
    """The places that are aligned, at the greatest weight, first ones first.

    Scores of suffixes are computed row by row. The path is traced by halves: the row in the middle is computed
    from the last one, so memory is a row for each halving and not one for each node.
    """
    sx, sy = [(signature(x), shape(x)) for x in xs], [(signature(y), shape(y)) for y in ys]
    codes: dict = {}
    cy = np.asarray([codes.setdefault(k, len(codes)) for k in sy])
    kinds = list(codes)
    weight = lambda a, b: 0 if a[0] != b[0] or not alike(a[1], b[1]) else PAIR + (BELOW * len(a[1] & b[1]) // max(1, len(a[1] | b[1])))
    tables = {a: np.asarray([weight(a, b) for b in kinds], np.int64) for a in set(sx)}
    where: dict[int, list[int]] = {}
    for j, y in enumerate(ys):
        for key in strings(y):
            where.setdefault(key, []).append(j)
    common = [[k for k in strings(x) if k in where] for x in xs]

    def weights(i):
        w = tables[sx[i]][cy]
        if common[i]:
            possible, w = w > 0, w.copy()
            for key in common[i]:
                w[where[key]] += COMMON
            w *= possible
        return w

    def above(i, row):
        w = weights(i)
        best = row.copy()
        np.maximum(best[:-1], np.where(w > 0, row[1:] + w, 0), out=best[:-1])
        return np.maximum.accumulate(best[::-1])[::-1]

    out: list[tuple[int, int]] = []

    def trace(lo, hi, last, j):
        """The path through rows lo to hi from column j on; ``last`` is row hi."""
        if hi - lo > ROWS:
            mid, row = (lo + hi) // 2, last
            for i in range(hi - 1, mid - 1, -1):
                row = above(i, row)
            return trace(mid, hi, last, trace(lo, mid, row, j))
        rows = [last]
        for i in range(hi - 1, lo - 1, -1):
            rows.append(above(i, rows[-1]))
        for i in range(lo, hi):
            row, below = rows[hi - i], rows[hi - i - 1]
            w = None
            while j < len(ys):
                w = weights(i) if w is None else w
                if w[j] and row[j] == below[j + 1] + w[j]:
                    out.append((i, j))
                    j += 1
                    break
                if below[j] >= row[j + 1]:
                    break
                j += 1
        return j

    trace(0, len(xs), np.zeros(len(ys) + 1, np.int64), 0)
    return out


def align(xs: list, ys: list, same: bool = False, least: int = 2) -> list:
    """One sequence for two: in pairs if labels agree, else at the greatest weight, with optional nodes and repeated groups."""
    if len(xs) == len(ys) and all(signature(x) == signature(y) and alike(shape(x), shape(y)) for x, y in zip(xs, ys, strict=True)):
        return [merge(x, y, same, least) for x, y in zip(xs, ys, strict=True)]
    out = []
    i = j = 0
    for p, q in [*pairs(xs, ys), (len(xs), len(ys))] if xs and ys else [(len(xs), len(ys))]:
        out += [optional(x) for x in xs[i:p]]
        out += [optional(y) for y in ys[j:q]]
        if p < len(xs) and q < len(ys):
            out.append(merge(xs[p], ys[q], same, least))
        i, j = p + 1, q + 1
    return fold(out, least)


def render(node: list) -> str:
    """The expression as text, for people: ``p(#)+`` are one or more paragraphs."""
    own = "" if node[0] == "(" else node[0]
    inner = " ".join(render(c) for c in node[3])
    mark = {(1, 0): "", (0, 0): "?", (1, 1): "+", (0, 1): "*"}[node[1], node[2]]
    return f"{own}({inner}){mark}" if inner else f"{own}{mark}"


def is_boilerplate(label: str) -> bool:
    return label.startswith(SKIP)


def is_article(label: str) -> bool:
    return label.partition(".")[0] in ARTICLE_TAGS


def match(wrapper: list | None, page: list, found: list) -> None:
    """For each string below ``page``, in order, its node of the wrapper, or None, appended to ``found``.

    From the node before on, else from the start: the first node of the label that has a string of the template in
    common with the page's, else the first without such strings, else the first; nodes of another shape come last.
    """
    places: dict[str, list[tuple[int, list]]] = {}
    looks: dict[tuple[int, str], tuple[frozenset, frozenset]] = {}  # only of nodes that share their label with others
    for k, n in enumerate(wrapper[3] if wrapper else ()):
        for own in members([n]):
            known = places.setdefault(own[0], [])
            if not known or known[-1][0] != k:
                known.append((k, own))
    at = 0
    for child in page[3]:
        own = place = None
        known = places.get(child[0], ())
        if len(known) == 1:
            place, own = known[0]
        elif known:
            seen, below, rank = strings(child), shape(child), (9, 0)
            first = bisect.bisect_left(known, at, key=lambda p: p[0])
            for step in range(len(known)):
                k, node = known[(first + step) % len(known)]
                if (k, child[0]) not in looks:
                    looks[k, child[0]] = strings(node, 2), shape(node)
                shared, labels = looks[k, child[0]]
                now = (3 * (not alike(labels, below)) + (2 if shared else 1) * shared.isdisjoint(seen), -len(labels & below))
                if now < rank:
                    own, rank, place = node, now, k
                if not now[0] and -now[1] == len(below):
                    break
        if own is not None:
            at = place if wrapper[3][place][2] or wrapper[3][place][0] == "(" else place + 1
        if child[0] == "#":
            found.append(own)
        else:
            match(own, child, found)


def is_template(node: list, pages: int) -> bool:
    return bool(node[4]) and node[5] >= LEAST_PAGES and 2 * node[5] > pages


_HEADING = re.compile(r"h[1-6](?:\.|$)")
#: Verdicts on a string's slot.
OUT, MAIN, ARTICLE = 0, 1, 2


def judge(wrapper: list, pages: int) -> list:
    """The wrapper of so many pages, each of its strings with a verdict as its last entry."""
    order: list[list] = []  # elements and strings, parents first
    held: dict[int, list[list]] = {}
    left = [(wrapper, False, False)]
    while left:
        node, inside, heading = left.pop()
        order.append(node)
        if node[0] == "#":
            links = 2 * node[7] > node[6] and not heading
            node.append(ARTICLE if inside else OUT if links or is_template(node, pages) else MAIN)
            continue
        held[id(node)] = list(members(node[3]))
        left += [(c, inside or is_article(c[0]), bool(_HEADING.match(node[0]))) for c in held[id(node)]]
    mass: dict[int, int] = {}
    headed: dict[int, int] = {}
    for node in reversed(order):
        if node[0] == "#":
            mass[id(node)], headed[id(node)] = node[6] * (node[8] == MAIN), 0
        else:
            mass[id(node)] = sum(mass[id(c)] for c in held[id(node)])
            headed[id(node)] = bool(_HEADING.match(node[0]) and mass[id(node)]) + sum(headed[id(c)] for c in held[id(node)])
    region = wrapper
    while pages >= LEAST_PAGES:
        best = max(held[id(region)], key=lambda c: mass[id(c)], default=None)
        if not best or not any(c[0] != "#" and mass[id(c)] for c in held.get(id(best), ())):
            break
        if 3 * mass[id(best)] < MOST_OF * mass[id(wrapper)] or headed[id(best)] < headed[id(region)]:
            break
        if any(c[0] == "#" and mass[id(c)] for c in held[id(region)]):
            break
        region = best
    inner, left = set(), [region]
    while left:
        node = left.pop()
        inner.add(id(node))
        left += held.get(id(node), ())
    for node in order:
        if node[0] == "#" and node[8] == MAIN and id(node) not in inner:
            node[8] = OUT
    return wrapper


def main_text(page: str, wrapper: list | None, pages: int) -> str:
    """The main text of a page by the verdicts of its host's wrapper over so many pages (judged here if it is not yet)."""
    root, texts = parse(page)
    if wrapper and not _judged(wrapper):
        judge(wrapper, pages)
    nodes: list = []
    match(wrapper, root, nodes)
    verdicts = [node[8] if node else MAIN for node in nodes]
    best = max(verdicts, default=OUT)
    return "\n".join(text for (_, text), verdict in zip(texts, verdicts, strict=True) if verdict == best)


def _judged(wrapper: list) -> bool:
    node = wrapper
    while node[0] != "#" and node[3]:
        node = node[3][0]
    return len(node) > 8


def pack(tree: list) -> str:
    """A wrapper as flat JSON, of any depth: each node's own entries and the number of its children, parents first."""
    out, left = [], [tree]
    while left:
        node = left.pop()
        out.append([*node[:3], len(node[3]), *node[4:]])
        left += reversed(node[3])
    return json.dumps(out, separators=(",", ":"))


def unpack(text: str) -> list:
    root: list = ["", 1, 0, []]
    open_ = [(root, 1)]
    for entry in json.loads(text):
        node = [*entry[:3], [], *entry[4:]]
        while not open_[-1][1]:
            open_.pop()
        parent, missing = open_.pop()
        parent[3].append(node)
        open_ += [(parent, missing - 1), (node, entry[3])]
    return root[3][0]


def _any_depth() -> None:
    """Pages may nest elements deeper than the interpreter's limit; calls among plain functions take no stack of the process."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))


PART = StructType([StructField("host", StringType()), StructField("salt", LongType()), StructField("wrapper", StringType()), StructField("pages", LongType())])


def _row(host: str, tree: list, pages: int, salts: int) -> pa.RecordBatch:
    text = pack(tree)
    salt = zlib.crc32(text.encode()) % salts
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((host, salt, text, pages), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], PART.names)


def _align(parts: DataFrame, salts: int) -> DataFrame:
    """The rows of a (host, salt) aligned; they get one of ``salts`` new salts."""

    def run(batches):
        _any_depth()
        key, tree, pages = None, None, 0
        for batch in batches:
            for host, salt, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, salt) != key:
                    if key is not None:
                        yield _row(key[0], tree, pages, salts)
                    key, tree, pages = (host, salt), None, 0
                other = unpack(text)
                pages += n
                tree = other if tree is None else merge(tree, other, least=least_of(pages))
        if key is not None:
            yield _row(key[0], tree, pages, salts)

    return parts.repartition("host", "salt").sortWithinPartitions("host", "salt", F.desc("pages"), "wrapper").mapInArrow(run, PART)


def infer_wrappers(pages: DataFrame, host: str = "host", html_col: str = "html") -> DataFrame:
    """(host, wrapper, pages): the expression of each host, as JSON, and its pages."""

    def run(batches):
        _any_depth()
        held: dict[str, list] = {}
        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = parse(page or "")[0]
                if name in held:
                    n = held[name][1] + 1
                    held[name] = [merge(held[name][0], tree, least=least_of(n)), n]
                else:
                    held[name] = [tree, 1]
                if len(held) > HELD:
                    yield from (_row(h, t, n, SALTS[0]) for h, (t, n) in held.items())
                    held = {}
        yield from (_row(h, t, n, SALTS[0]) for h, (t, n) in held.items())

    parts = pages.select(F.col(host).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, PART)
    for salts in SALTS[1:]:
        parts = _align(parts, salts)
    return _align(parts, 1).select("host", "wrapper", "pages")


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns), ``text`` and ``n_chars`` of every page.

    Text of the slots that a page fills in its host's wrapper, those of marked articles before others, in page order: character references
    decoded, white space in a block one space, blocks joined by a line feed. A null or empty html,
    and a page without main text, gives ''; pages with no host in their url (or a null url) share a
    wrapper; repeated rows are read one by one; very long texts and any depth of elements are read
    whole; equally good alignments are told apart by the order of the nodes; an empty table gives no
    rows; the caller's columns may have any names.
    """
    host = F.regexp_extract(F.lower(F.coalesce(pages[f"`{url_col}`"], F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    kept = pages.columns if keep is None else keep
    own = F.struct(*[pages[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("_none"))
    rows = pages.select(own.alias(ROW), host.alias("host"), pages[f"`{html_col}`"].alias("html"))
    wrappers = materialize(infer_wrappers(rows.select("host", "html")), "wrappers")
    # a row per host: sent to all tasks below the session's threshold, else an adaptive join splits large hosts
    joined = rows.join(wrappers, "host", "left").select(ROW, "html", "wrapper", "pages")
    known: dict[str, list] = {}

    def fn(batch):
        _any_depth()
        texts = []
        for page, wrapper, n in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist(), strict=True):
            if wrapper not in known:
                if len(known) > HELD:
                    known.clear()
                known[wrapper] = judge(unpack(wrapper), n) if wrapper else None
            texts.append(main_text(page or "", known[wrapper], n or 0))
        yield 0, len(texts), {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return append(joined, fn, [StructField("text", StringType()), StructField("n_chars", LongType())])


def main_text_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract_main_text(pages, keep=["page_id", "url"]).select(f"{ROW}.page_id", f"{ROW}.url", "text", "n_chars")
