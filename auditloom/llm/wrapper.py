"""Main text of web pages by wrapper induction over the pages of a host.

Every page becomes a tree of block elements; inline markup is part of the text.
Pages of one host are dealt into groups of about GROUP pages.  In a group a
wrapper is grown: each page's tree is laid against it by simple tree matching
(the most pairs of equally labelled nodes that keep order and descent), matched
nodes record the page's text, and unmatched ones join the wrapper.  Runs of
equally labelled siblings count as one node.

A wrapper node is template if it held the same text in several pages: in SUPPORT
different pages or more, and in at least half of those that have it, its text is
also that of another page.  All else is a slot.  Pages with equal main texts count
as one, so copies of an article do not make it template.

A page's main text is that of the slots inside its content, in page order.  The
content is the page's article elements, else its main element, if the wrapper has
slots in them; else the whole page, where nodes of which most is link text are
menus.  A heading that repeats in articles is kept with the text it heads.

Elements with a meaning of their own (navigation, footers, forms and their
controls, ...), roles and hidden elements are no main text.  Of names, a class or
id counts only if all its words are known (`ad-box`, not `has-sidebar`), and
neither a name nor a form around the content takes it away.

Cases: a null, empty or tagless html; markup cut off anywhere; elements left
open or nested to any depth; a page without host (its own group of pages); hosts
with under SUPPORT pages, where nothing is template; repeated rows, which share a
group and get the same text; many rows without page_id, which are dealt by url
and html; an empty table; further columns are ignored.  Of over PAIRS equally
labelled pairs among two nodes' children, those at both ends are matched first,
and if that does not help the rest in order.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, settle
from .textkernel import slices

GROUP, SUPPORT, PAIRS = 64, 3, 4096
#: So many hosts of more than one group may be broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000

# HTML elements by kind; all others are inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "html legend li main menu nav object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav footer aside search button select option optgroup datalist label legend menu dialog svg canvas object audio video map input".split())
#: Never main text, unless the content is inside.
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that a start tag closes, and those beyond which it does not look.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tr": ("tr td th", "tbody thead tfoot table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name what is no main text, and words that may stand beside them.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead "
    "topbar toolbar comment comments disqus replies cookie cookies consent gdpr notice newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations popular trending widget modal popup overlay pagination pager skip hidden".split()
)
BESIDE = frozenset("a and area bar block body bottom box button buttons card container content form global group icons inner item items left link links list main media page panel post posts primary right secondary section site slot to top unit widget wrap wrapper".split())
_CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}
_P = (frozenset({"p"}), frozenset("ul ol dl table tr td th article main section div body button".split()))

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_OPENS = re.compile(r"""=\s*(["'])""")
_ATTR = re.compile(r"""([^\s/>="']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """A block element: its texts and blocks in order; whether it is no main text for good (never) or by a name or form around it (named)."""

    __slots__ = ("label", "links", "named", "never", "parts", "tag", "wrap")

    def __init__(self, tag: str, label: str, never: bool = False, named: bool = False) -> None:
        self.tag, self.label, self.never, self.named, self.links = tag, label, never, named, 0
        self.parts: list[str | Node] = []
        self.wrap: Wrapper | None = None

    def kids(self) -> list[Node]:
        return [p for p in self.parts if type(p) is Node]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t\r") else {}


def _hidden(attrs: dict[str, str]) -> bool:
    return attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


def _named(attrs: dict[str, str]) -> bool:
    """Whether a class or id is made of known words only, one of them telling."""
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _PARTS.findall(token) if not w.isdigit()]
        if any(w in WORDS for w in words) and all(w in WORDS or w in BESIDE for w in words):
            return True
    return False


def _tag_end(source: str, at: int, gone: set[str]) -> int:
    """The place of the > that ends a tag, -1 if there is none; `gone` holds quotes that do not come again."""
    end = source.find(">", at)
    while end >= 0 and (m := _OPENS.search(source, at, end)) and m[1] not in gone:
        close = source.find(m[1], m.end())
        if close < 0:
            gone.add(m[1])
            break
        at = close + 1
        if close > end:
            end = source.find(">", at)
    return end


class _Open:
    """The open elements: (tag, block they are in, whether inline text is dropped, whether it is link text), and where each tag is."""

    def __init__(self, root: Node) -> None:
        self.stack: list[tuple[str, Node, bool, bool]] = [("#root", root, False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, tag: str, block: Node, dropped: bool, link: bool) -> None:
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, block, dropped, link))

    def last(self, tags: frozenset[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag; that of an inline element does not reach out of its block."""
        places = self.places.get(tag)
        if places and (tag in BLOCK or places[-1] > self.blocks[-1]):
            self.cut(places[-1])

    def make_room(self, rule: tuple[frozenset[str], frozenset[str]]) -> None:
        """Close the elements that a start tag closes, down to the lowest above the last barrier."""
        closes, stops = rule
        barrier = self.last(stops)
        found = [p[k] for t in closes if (p := self.places.get(t)) and (k := bisect_right(p, barrier)) < len(p)]
        if found:
            self.cut(min(found))


def parse(source: str) -> Node:
    """The block tree of a page, in time linear in its length; never fails."""
    root = Node("#root", "#root")
    opened, gone = _Open(root), set()
    stack, places = opened.stack, opened.places
    at, n = 0, len(source)

    def text(start: int, end: int) -> None:
        if end > start:
            _, block, dropped, link = stack[-1]
            if not dropped:
                piece = source[start:end]
                block.parts.append(piece)
                if link:
                    block.links += len(piece)

    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            text(at, n)
            break
        text(at, begin)
        m = _NAME.match(source, begin)
        if m is None:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                at = end + 3 if end >= 0 else n
            elif source.startswith(("<!", "<?", "</"), begin):
                end = source.find(">", begin)
                at = end + 1 if end >= 0 else n
            else:
                text(begin, begin + 1)
                at = begin + 1
            continue
        end = _tag_end(source, m.end(), gone)
        if end < 0:
            break
        at, tag = end + 1, m[1].lower()
        if source[begin + 1] == "/":
            opened.close(tag)
            continue
        if places.get("head") and tag not in IN_HEAD and tag != "head":
            opened.cut(places["head"][-1])
        if tag in CLOSES_P and places.get("p"):
            opened.make_room(_P)
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1][1].parts.append("\n")
            continue
        raw = source[m.end() : end]
        if tag in RAW:
            found = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            if found or not raw.endswith("/"):
                stop = source.find(">", found.start()) if found else -1
                at = stop + 1 if stop >= 0 else n
            continue
        if tag in _CLOSES:
            opened.make_room(_CLOSES[tag])
        attrs = _attributes(raw)
        never = tag in NEVER or (tag == "header" and not (places.get("article") or places.get("main"))) or (bool(attrs) and _hidden(attrs))
        named = tag in FORMS or (bool(attrs) and tag not in ("html", "body") and _named(attrs))
        _, block, dropped, link = stack[-1]
        if tag in BLOCK:
            never = never or dropped
            node = Node(tag, f"{tag}.{attrs.get('class', '')}#{re.sub('[0-9]+', '0', attrs.get('id', ''))}" if attrs else tag, never, named)
            block.parts.append(node)
            opened.push(tag, node, False, link)
        else:
            opened.push(tag, block, dropped or never or named, link or tag == "a")
    return root


def tidy(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def own_text(node: Node) -> str:
    return tidy("".join(p if type(p) is str else " " for p in node.parts))


class Wrapper:
    """A node of the wrapper: label, children, the pages that held a text in it, how many held which, and its link and other text."""

    __slots__ = ("chars", "kids", "label", "links", "pages", "texts")

    def __init__(self, label: str) -> None:
        self.label, self.chars, self.links = label, 0, 0
        self.kids: list[Wrapper] = []
        self.pages: set[bytes] = set()
        self.texts: Counter[int] = Counter()

    def template(self) -> bool:
        repeated = sum(n for n in self.texts.values() if n > 1)
        return repeated >= SUPPORT and 2 * repeated >= len(self.pages)

    def menu(self) -> bool:
        return 2 * self.links > self.chars


def _runs(nodes: list[Node]) -> list[list[Node]]:
    """Children of the nodes, equally labelled neighbours together."""
    out: list[list[Node]] = []
    for node in nodes:
        for part in node.parts:
            if type(part) is Node:
                if out and out[-1][0].label == part.label:
                    out[-1].append(part)
                else:
                    out.append([part])
    return out


def _heaviest(pairs: list[tuple[int, int, int]], width: int) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest ordered mapping out of pairs (i, j, weight) sorted by i, with j under width: its weight and pairs."""
    best: list[tuple[int, int]] = [(0, -1)] * (width + 1)  # a tree of prefix maxima: weight and last pair
    back: list[int] = []
    top = (0, -1)
    at = 0
    while at < len(pairs):
        upto = at
        while upto < len(pairs) and pairs[upto][0] == pairs[at][0]:
            upto += 1
        for k in range(upto - 1, at - 1, -1):  # j descends within an i, so an i is used once
            _, j, weight = pairs[k]
            held, q = (0, -1), j
            while q:
                held = max(held, best[q])
                q -= q & -q
            back.append(held[1])
            found = (held[0] + weight, k)
            top, q = max(top, found), j + 1
            while q <= width:
                best[q] = max(best[q], found)
                q += q & -q
        back[at:upto] = back[at:upto][::-1]
        at = upto
    chosen, k = [], top[1]
    while k >= 0:
        chosen.append(pairs[k][:2])
        k = back[k]
    return top[0], chosen[::-1]


def _pairs(kids: list[Wrapper], runs: list[list[Node]]) -> list[tuple[int, int]] | None:
    """All (i, j) with equal labels, in order; None if there are over PAIRS."""
    places: dict[str, list[int]] = {}
    for j, run in enumerate(runs):
        places.setdefault(run[0].label, []).append(j)
    if sum(len(places.get(k.label, ())) for k in kids) > PAIRS:
        return None
    return [(i, j) for i, kid in enumerate(kids) for j in places.get(kid.label, ())]


def align(kids: list[Wrapper], runs: list[list[Node]], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs of the best mapping between a wrapper node's children and runs of a page's nodes."""
    pairs = _pairs(kids, runs)
    if pairs is not None:
        return _heaviest([(i, j, match(kids[i], runs[j], memo)) for i, j in pairs], len(runs))
    head, tail, most = 0, 0, min(len(kids), len(runs))
    while head < most and kids[head].label == runs[head][0].label:
        head += 1
    while tail < most - head and kids[-1 - tail].label == runs[-1 - tail][0].label:
        tail += 1
    ends = [(k, k) for k in range(head)] + [(len(kids) - k, len(runs) - k) for k in range(tail, 0, -1)]
    inner, outer = kids[head : len(kids) - tail], runs[head : len(runs) - tail]
    middle = _pairs(inner, outer)
    if middle is not None:
        middle = _heaviest([(i, j, match(inner[i], outer[j], memo)) for i, j in middle], len(outer))[1]
    else:
        places: dict[str, list[int]] = {}
        for i, kid in enumerate(inner):
            places.setdefault(kid.label, []).append(i)
        middle, last = [], -1
        for j, run in enumerate(outer):
            known = places.get(run[0].label, [])
            k = bisect_right(known, last)
            if k < len(known):
                last = known[k]
                middle.append((last, j))
    chosen = ends[:head] + [(i + head, j + head) for i, j in middle] + ends[head:]
    return sum(match(kids[i], runs[j], memo) for i, j in chosen), chosen


def match(wrap: Wrapper, nodes: list[Node], memo: dict | None = None) -> int:
    """Simple tree matching: the most pairs of a common top-down, ordered mapping."""
    memo = {} if memo is None else memo
    todo: list[tuple[Wrapper, list[Node]]] = [(wrap, nodes)]
    while todo:  # children first, without recursion: trees may be of any depth
        wrap_, run = todo[-1]
        key = (id(wrap_), id(run[0]))
        if key in memo:
            todo.pop()
            continue
        if wrap_.label != run[0].label:
            memo[key] = 0
            todo.pop()
            continue
        runs = _runs(run)
        needed = _needed(wrap_.kids, runs)
        missing = [(a, b) for a, b in needed if (id(a), id(b[0])) not in memo]
        if missing:
            todo += missing
            continue
        memo[key] = 1 + align(wrap_.kids, runs, memo)[0]
        todo.pop()
    return memo[id(wrap), id(nodes[0])]


def _needed(kids: list[Wrapper], runs: list[list[Node]]) -> list[tuple[Wrapper, list[Node]]]:
    """The pairs whose weights align() asks for."""
    pairs = _pairs(kids, runs)
    if pairs is None:
        pairs = align(kids, runs, _Ones())[1]
    return [(kids[i], runs[j]) for i, j in pairs]


class _Ones(dict):
    """Weights of 1 for all pairs."""

    def __contains__(self, key: object) -> bool:
        return True

    def __getitem__(self, key: object) -> int:
        return 1


def fold(wrap: Wrapper, nodes: list[Node], page: bytes) -> None:
    """Lay a run of matched nodes onto the wrapper and grow it by what it lacks."""
    memo: dict = {}
    todo = [(wrap, nodes)]
    while todo:
        wrap, nodes = todo.pop()
        for node in nodes:
            node.wrap = wrap
        text = " ".join(t for t in map(own_text, nodes) if t)
        if text and page not in wrap.pages:
            wrap.pages.add(page)
            wrap.texts[hash(text)] += 1
            wrap.chars += sum(len(p) for n in nodes for p in n.parts if type(p) is str)
            wrap.links += sum(n.links for n in nodes)
        runs = _runs(nodes)
        if not runs:
            continue
        if [k.label for k in wrap.kids] == [r[0].label for r in runs]:
            todo += zip(wrap.kids, runs, strict=True)
            continue
        for a, b in _needed(wrap.kids, runs):
            match(a, b, memo)
        grown, done, taken = [], 0, {j: i for i, j in align(wrap.kids, runs, memo)[1]}
        for j, run in enumerate(runs):
            if j in taken:
                grown += wrap.kids[done : taken[j] + 1]
                done = taken[j] + 1
            else:
                grown.append(Wrapper(run[0].label))
            todo.append((grown[-1], run))
        wrap.kids = grown + wrap.kids[done:]


def _walk(root: Node) -> Iterator[tuple[Node, Node | None, int, bool]]:
    """Nodes that are not never, in page order: node, parent, named ones around it, whether it is inside an article."""
    stack: list[tuple[Node, Node | None, int, bool]] = [(root, None, 0, False)]
    while stack:
        node, up, names, inside = stack.pop()
        if node.never:
            continue
        yield node, up, names, inside
        deeper = (names + node.named, inside or (node.tag == "article" and not node.named))
        stack += [(k, node, *deeper) for k in reversed(node.kids())]


def content(root: Node) -> tuple[list[Node], list[Node]]:
    """The page's article or main elements, if any, and the elements by whose text pages are told apart.

    The latter are the former if they hold half of the page's text, else the
    element whose paragraphs hold most.  Names and forms are taken off the elements
    around the former; without them, off those that hold most of the text.
    """
    walked = list(_walk(root))
    parents = {id(node): up for node, up, _, _ in walked}
    own = {id(node): max(0, sum(len(p) for p in node.parts if type(p) is str and not p.isspace()) - node.links) for node, _, _, _ in walked}
    total, below = sum(own.values()), dict(own)
    for node, up, _, _ in reversed(walked):
        if up is not None:
            below[id(up)] += below[id(node)]
    roots: list[Node] = []
    for tag in ("article", "main"):
        found = [(names, node) for node, _, names, inside in walked if node.tag == tag and not node.named and not (inside and tag == "article")]
        if found and not roots:
            least = min(names for names, _ in found)
            roots = [node for names, node in found if names == least]
    for node in roots:
        while (up := parents[id(node)]) is not None:
            node, up.named = up, False
    held: dict[int, float] = {}
    best, most = root, 0.0
    for node, up, _, _ in walked:
        if not roots and node.named and 2 * below[id(node)] > total:
            node.named = False
        for near, share in ((up, 1.0), (parents.get(id(up)), 0.5)):
            if near is not None:
                held[id(near)] = held.get(id(near), 0.0) + share * own[id(node)]
                if held[id(near)] > most:
                    best, most = near, held[id(near)]
    return roots, roots if roots and 2 * sum(below[id(node)] for node in roots) >= total else [best]


def main_text(roots: list[Node], article: bool) -> str:
    """Texts of the slots under the roots, in page order; repeated headings of articles with the text that they head."""
    blocks: list[str] = []
    for root in roots:
        held: list[str] = []
        heads: list[str] = []
        open_: list[Node] = []
        stack: list[str | Node | None] = [root]

        def close(held=held, heads=heads, open_=open_) -> None:
            text = tidy("".join(held))
            held.clear()
            if not text:
                return
            node = open_[-1]
            if node.wrap is None or not (node.wrap.template() or (not article and node.wrap.menu() and node.tag not in HEADINGS and node.tag not in ("p", "pre"))):
                blocks.extend(heads)
                blocks.append(text)
                heads.clear()
            elif article and node.tag in HEADINGS:
                heads.append(text)
            else:
                heads.clear()

        while stack:
            part = stack.pop()
            if type(part) is str:
                held.append(part)
                continue
            if open_:
                close()
            if part is None:
                open_.pop()
            elif part is root or not (part.never or part.named):
                open_.append(part)
                stack.append(None)
                stack += reversed(part.parts)
    return " ".join(blocks)


def extract_group(pages: list[str]) -> list[str]:
    """The main texts of some pages of one host."""
    trees: dict[str, Node] = {}
    for source in pages:
        if source and source not in trees:
            trees[source] = parse(source)
    wrap, roots = Wrapper("#root"), {}
    for source, tree in trees.items():
        roots[source], told = content(tree)
        fold(wrap, [tree], hashlib.md5(main_text(told, True).encode()).digest())
    texts = {source: main_text(found, True) if found else "" for source, found in roots.items()}
    return [(texts[source] or main_text([trees[source]], False)) if source else "" for source in pages]


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (host, salt, page_id, url, html) to texts; of equal pages in a group one is held."""
    group: list[tuple[int | None, str, int]] = []
    sources: dict[str, int] = {}
    key: tuple | None = None

    def done() -> Iterator[pa.RecordBatch]:
        texts = extract_group(list(sources))
        for low in range(0, len(group), 256):
            some = group[low : low + 256]
            found = [texts[g[2]] for g in some]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in some], pa.int64()), pa.array([g[1] for g in some], pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    for batch in batches:
        for part in slices(batch, "html"):
            rows = zip(*(part.column(c).to_pylist() for c in ("host", "salt", "page_id", "url", "html")), strict=True)
            for host, salt, page_id, url, source in rows:
                if key != (host, salt):
                    if group:
                        yield from done()
                    key, group, sources = (host, salt), [], {}
                group.append((page_id, url, sources.setdefault(source or "", len(sources))))
    if group:
        yield from done()


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text and n_chars."""
    prepare(pages.sparkSession)
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    groups = settle(rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups")).where("groups > 1"), "hosts")
    if groups.count() <= BROADCAST_HOSTS:
        groups = F.broadcast(groups)
    deal = F.when(F.col("page_id").isNotNull(), F.xxhash64("page_id", F.lit(3))).otherwise(F.xxhash64("url", "html"))
    dealt = rows.join(groups, "host", "left").withColumn("salt", F.pmod(deal, F.coalesce("groups", F.lit(1)))).drop("groups")
    return dealt.repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id").mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
