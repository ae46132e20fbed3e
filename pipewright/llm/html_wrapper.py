"""Main text of web pages by wrapper induction (operator 6).

A page becomes a tree of its block elements. Siblings stay apart, but paragraphs, items, cells and the like
of one parent, and all of one label beyond ``SIBLINGS``, are one node, an iterated slot. Of a host's trees
the most frequent is the reference. Every other is aligned with it by simple tree matching: the largest set of node pairs of
equal label that keeps parents and the order of siblings. Nodes that the reference lacks are aligned with
those of one label below one parent in further layouts.

Texts are then compared slot by slot over all pages of the host. A text that stands in a slot on nearly all
pages that have the slot, and on three different ones, is template; what varies is content, but for slots
that mostly link (menus). The main region is the deepest container that holds nearly all the content of
the host's pages. There a page has its main text: all in the region that isn't template.

What elements, roles and class words mark counts where the wrapper can't tell: for a text that varies in
the region (a comment, an advert), and for pages of hosts without a wrapper, which are those with fewer
than three different pages, without such a region, or with more that is constant than that varies (near
copies are about what they share). There a page that marks its article has its main text there, all of it.
"""

from __future__ import annotations

import hashlib
import html as html_
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settle, slices, texts

#: FIXED VALUES: elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "head", "body", "option", "optgroup"}
#: An element that begins ends an open one of these, up to an element of the second row.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table thead tbody tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tr td th", "table"), "tfoot": ("thead tbody tr td th", "table"), "body": ("head", "html")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Elements, roles and words in class or id that mark what isn't main text.
OTHER = frozenset("nav footer aside form button select menu dialog head search input label".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OTHER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adsbygoogle outbrain taboola banner banners sponsor sponsored promo promotion
    menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside
    footer foot masthead topbar toolbar skip cookie cookies consent gdpr notice notices notification alert popup
    modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist respond reply replies disqus
    share sharing social follow related recommended recommendations widget widgets search form copyright
    hidden""".split()
)
HEADER_WORDS = frozenset("header pageheader siteheader".split())
MAIN_WORDS = frozenset(("articlebody", "articlecontent", "postcontent", "entrycontent", "maincontent", "storybody"))

#: FIXED VALUES: elements of which all siblings of one label are one slot.
FLOW = frozenset("p li h1 h2 h3 h4 h5 h6 tr td th dt dd option pre blockquote figcaption caption legend summary address".split())
SIBLINGS = 16  # of any other label that are told apart

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_MARKING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)  # without any of these only its tag can mark an element
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(label, marks other text, is a page header, is a main region) of an element."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html_.unescape((m[2] or "").strip("\"'")))
    names = " ".join(found.get(k, "") for k in ("class", "id")).lower()
    words = set(re.findall(r"[a-z]+", names))
    joined = {re.sub(r"[^a-z]", "", w) for w in names.split()}
    role = found.get("role", "").lower()
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").lower().replace(" ", "")
    other = tag in OTHER or role in OTHER_ROLES or unseen or (bool((words | joined) & OTHER_WORDS) and tag not in ("html", "body", "main", "article"))
    if tag == "article" and words & {"comment", "comments", "reply", "related", "promo", "ad", "sponsored"}:
        other = True
    header = tag == "header" or role == "banner" or bool((words | joined) & HEADER_WORDS)
    main = tag in ("article", "main") or role in ("main", "article") or bool(joined & MAIN_WORDS) or found.get("itemprop", "").lower() == "articlebody"
    label = tag + "".join("." + w for w in sorted({re.sub(r"\d+", "#", w) for w in names.split()})[:4])
    return label, other, header, main and not other


#: What marks say of a block: nothing, other text, text of a main region, a page's header.
PLAIN, ASIDE, MAIN, HEADER = 0, 1, 2, 3


class Page:
    """The tree of a page and its blocks of text.

    nodes: (parent, label, whether it is a main region) in the order they begin; blocks: (node, text, words,
    words in links, mark) in page order. marked: some block is of a main region that the page marks.
    """

    __slots__ = ("nodes", "blocks", "marked")

    def __init__(self, text: str):
        self.nodes: list[tuple[int, str, int]] = []
        children: dict[tuple[int, str], list[int]] = {}
        # Open elements: tag, node, whether in other text, in a header, in a main region.
        stack: list[tuple[str, int, bool, bool, bool]] = [("", -1, False, False, False)]
        raw: list[list] = []  # [node, pieces, linked words, other, header, main]
        current: list | None = None
        links, at, n = 0, 0, len(text)

        def node_of(parent: int, tag: str, label: str, main: bool) -> int:
            same = children.setdefault((parent, label), [])
            if len(same) >= (1 if tag in FLOW else SIBLINGS):
                return same[-1]
            same.append(len(self.nodes))
            self.nodes.append((parent, label, int(main)))
            return same[-1]

        def put(piece: str) -> None:
            nonlocal current
            if current is None:
                if not piece.strip():
                    return
                _, node, other, header, main = stack[-1]
                current = [node, [], 0, other, header, main]
                raw.append(current)
            current[1].append(piece)
            if links:
                current[2] += len(piece.split())

        ends: dict[str, dict[int, int]] = {}

        def closed(tag: str, start: int) -> int | None:
            """Where the element that begins at ``start`` has ended; all of one tag are paired once."""
            if tag not in ends:
                pairs, opened = ends.setdefault(tag, {}), []
                for e in re.compile(rf"</?{re.escape(tag)}\b[^>]*>", re.IGNORECASE).finditer(text, start):
                    if e[0][1] != "/":
                        opened.append(e.start())
                    elif opened:
                        pairs[opened.pop()] = e.end()
            return ends[tag].get(start)

        while at < n:
            start = text.find("<", at)
            if start < 0:
                start = n
            if start > at:
                put(text[at:start])
            if start == n:
                break
            m = _TOKEN.match(text, start)
            if m is None:  # a < that begins nothing; an unfinished tag at the end is dropped
                if re.match(r"</?[A-Za-z]", text[start : start + 3]) and ">" not in text[start:]:
                    break
                put("<")
                at = start + 1
                continue
            at = m.end()
            if m[2] is None:
                if text.startswith("<![CDATA[", start):
                    put(html_.escape(text[start + 9 : at - 3 if text.endswith("]]>", 0, at) else at], False))
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in BLOCK:
                    current = None
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            links = 0
                            break
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(text, at)
                at = close.end() if close else n
                if tag not in ("script", "style", "title"):
                    current = None
                continue
            if tag == "br" or tag == "hr":
                put(" ") if tag == "br" and current is not None else None
                current = None if tag == "hr" else current
                continue
            if tag not in BLOCK:
                place = at
                if tag not in VOID and (tag in OTHER or _MARKING.search(m[3])) and _marks(tag, m[3])[1]:
                    # An inline element that marks other text goes with all it holds.
                    current = None
                    place = closed(tag, start) or at
                if tag == "a" and place == at:
                    links += 1
                at = place
                continue
            current, links = None, 0
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in ("button", "td", "th", "table", "article", "section", "div", "li"):
                        break
            if tag in ENDS:
                ended, stop = ENDS[tag]
                last = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ended:
                        last = k
                    elif stack[k][0] in stop:
                        break
                if last:
                    del stack[last:]
            label, other, header, main = _marks(tag, m[3])
            _, parent, in_other, in_header, in_main = stack[-1]
            stack.append((tag, node_of(parent, tag, label, main), in_other or other, in_header or header and not in_main, in_main or main and not in_other))

        self.marked = any(r[5] and not r[3] for r in raw)
        self.blocks: list[tuple[int, str, int, int, int]] = []
        for node, pieces, linked, other, header, main in raw:
            joined = "".join(pieces)
            shown = (html_.unescape(joined) if "&" in joined else joined).split()
            if shown:
                mark = ASIDE if other else MAIN if main else HEADER if header else PLAIN
                self.blocks.append((node, " ".join(shown), len(shown), min(linked, len(shown)), mark))

    def shown(self) -> list[tuple[int, str, int, int, int]]:
        """The blocks that the page's own marks leave: those of its main regions, where it has any."""
        return [b for b in self.blocks if b[4] == MAIN or b[4] == PLAIN and not self.marked]


# ------------------------------------------------------------------ alignment
def _by_label(nodes: list[int], tree: list[tuple]) -> dict[str, list[int]]:
    """Turns of some siblings by their labels."""
    out: dict[str, list[int]] = {}
    for turn, k in enumerate(nodes):
        out.setdefault(tree[k][1], []).append(turn)
    return out


def _heaviest(xs: list[int], ys: list[int], a: list[tuple], b: list[tuple], weight: Callable[[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest set of pairs of equal label of two lists of siblings that crosses nothing, by a tree of prefix maxima."""
    best: list[tuple[int, int]] = [(0, -1)] * (len(ys) + 1)
    chain: list[tuple[int, int, int]] = []  # (x, y, the pair before it)
    label = _by_label(ys, b)

    def most(at: int) -> tuple[int, int]:
        top = (0, -1)
        while at:
            if best[at][0] > top[0]:
                top = best[at]
            at &= at - 1
        return top

    for x in xs:
        found = []
        for j in label.get(a[x][1], ()):
            total, before = most(j)
            chain.append((x, ys[j], before))
            found.append((j + 1, (total + weight(x, ys[j]), len(chain) - 1)))
        for at, value in found:
            while at <= len(ys):
                if value[0] > best[at][0]:
                    best[at] = value
                at += at & -at
    total, k = most(len(ys))
    pairs = []
    while k >= 0:
        x, y, k = chain[k]
        pairs.append((x, y))
    return total, pairs[::-1]


def simple_tree_matching(a: list[tuple], b: list[tuple]) -> dict[int, int]:
    """The largest matching of two trees that keeps labels, parents and sibling order: nodes of a to nodes of b.

    Only nodes of equal label below a compared pair are compared, without recursion; equal subtrees match as they are.
    """
    kids, shape = ([], []), ([], [])
    names: dict[tuple, int] = {}
    sizes: list[int] = []
    for side, tree in enumerate((a, b)):
        below: list[list[int]] = [[] for _ in tree]
        kids[side].extend(below)
        for k, node in enumerate(tree):
            if node[0] >= 0:
                below[node[0]].append(k)
        shape[side].extend([0] * len(tree))
        for k in range(len(tree) - 1, -1, -1):  # children stand behind their parents
            key = (tree[k][1], *(shape[side][c] for c in below[k]))
            if key not in names:
                names[key] = len(sizes)
                sizes.append(1 + sum(sizes[shape[side][c]] for c in below[k]))
            shape[side][k] = names[key]
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def weight(x: int, y: int) -> int:
        return sizes[shape[0][x]] if shape[0][x] == shape[1][y] else done[x, y][0]

    def open_pairs(xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        label = _by_label(ys, b)
        return [(x, ys[j]) for x in xs for j in label.get(a[x][1], ()) if shape[0][x] != shape[1][ys[j]] and (x, ys[j]) not in done]

    tops = [[k for k, node in enumerate(t) if node[0] < 0] for t in (a, b)]
    todo = [(p, False) for p in open_pairs(*tops)]
    while todo:
        (x, y), ready = todo.pop()
        if (x, y) in done:
            continue
        if ready:
            n, pairs = _heaviest(kids[0][x], kids[1][y], a, b, weight)
            done[x, y] = (n + 1, pairs)
        else:
            todo.append(((x, y), True))
            todo += [(p, False) for p in open_pairs(kids[0][x], kids[1][y])]
    out: dict[int, int] = {}
    left = _heaviest(*tops, a, b, weight)[1]
    while left:
        x, y = left.pop()
        out[x] = y
        left += zip(kids[0][x], kids[1][y], strict=True) if shape[0][x] == shape[1][y] else done[x, y][1]
    return out


def _name(*of: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=8).digest(), "little", signed=True)


def places(a: list[tuple], b: list[tuple]) -> list[int]:
    """The place of each node of a: that of its counterpart in b, else one of its own label and turn below its parent's place, which further layouts may share."""
    pairs = {k: k for k in range(len(a))} if a == b else simple_tree_matching(a, b)
    out: list[int] = []
    turns: dict[tuple[int, str], int] = {}
    for k, (parent, label, _) in enumerate(a):
        above = out[parent] if parent >= 0 else 0
        if k in pairs:
            out.append(_name("reference", pairs[k]))
        else:
            turns[above, label] = turn = turns.get((above, label), 0) + 1
            out.append(_name(above, label, turn))
    return out


DEEP = 64  # levels of containers of which one may be the main region


def containers(a: list[tuple], place: list[int]) -> list[list[int]]:
    """The places of the containers that hold each node, outermost first, none of them within a main region that is marked."""
    out: list[list[int]] = []
    ends: list[bool] = []
    for k, (parent, label, main) in enumerate(a):
        above, ended = (out[parent], ends[parent]) if parent >= 0 else ([], False)
        more = not ended and re.split(r"\W", label, maxsplit=1)[0] not in FLOW and len(above) < DEEP
        out.append([*above, place[k]] if more else above)
        ends.append(ended or bool(main))
    return out


# ------------------------------------------------------------------ tasks
def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_FIELDS = ("node", "text", "words", "linked", "mark")
_PARSED = "page_id long, url string, host string, tree string, marked boolean, blocks array<struct<node:int,text:string,words:int,linked:int,mark:int>>"
_BLOCK_TYPE = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("mark", pa.int32())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        _, offsets = texts(whole.column(2))
        for i, j in slices(offsets, 8 << 20):
            batch = whole.slice(i, j - i)
            pages = [Page(h or "") for h in batch.column(2).to_pylist()]
            hosts = pa.array([host(u) for u in batch.column(1).to_pylist()], pa.string())
            trees = pa.array([json.dumps(p.nodes, separators=(",", ":")) for p in pages], pa.string())
            blocks = pa.array([[dict(zip(_FIELDS, b, strict=True)) for b in p.blocks] for p in pages], _BLOCK_TYPE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hosts, trees, pa.array([p.marked for p in pages], pa.bool_()), blocks], names=["page_id", "url", "host", "tree", "marked", "blocks"])


_ALIGNED = "layout long, to long, node int, place long, above array<long>, title boolean"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for layout, to, tree, reference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = ([tuple(x) for x in json.loads(t)] for t in (tree, reference))
            place = places(a, b)
            n = len(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array([layout] * n, pa.int64()), pa.array([to] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(place, pa.int64()), pa.array(containers(a, place), pa.list_(pa.int64())), pa.array([re.match(r"h1\b", x[1]) is not None for x in a], pa.bool_())],
                names=["layout", "to", "node", "place", "above", "title"],
            )


MIN_PAGES = 3  # different pages of a host that make a wrapper, and that must have a text before it is template
CONSTANT = 0.8  # share of the pages with a slot that have a text there which is template
LINKED = 0.5  # share of words in links above which a slot is a menu
REGION = 0.8  # share of a host's content that its main region holds


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, by) of every page; ``by`` tells what found the text, the host's wrapper or the page's marks.

    White space in a block is one space; blocks are joined by one space. Null and empty html have empty
    text; texts of any length are read whole. Pages without a host in their url make one group. Repeated pages get equal results and don't
    make each other's text template: that takes three different texts. An empty table gives no rows; columns
    of the input but the three named are not read. Html is read once and never shuffled; hosts are summed up
    slot by slot, so a host that holds most pages costs no more than others. Layouts, not pages, are aligned.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = settle(rows.mapInArrow(lean(_parse), _PARSED), "pages").withColumn("layout", F.xxhash64("tree"))
    one = F.count(F.lit(1))
    by_marks = lambda b: (b["mark"] == MAIN) | ((b["mark"] == PLAIN) & ~F.col("marked"))
    shown = F.xxhash64(F.transform(F.filter("blocks", by_marks), lambda b: b["text"])).alias("page")
    layouts = settle(parsed.groupBy("host", "layout", "tree").agg(one.alias("n"), F.count(F.when(F.size("blocks") > 0, 1)).alias("filled")), "layouts", few=True)
    different = parsed.where("size(blocks) > 0").select("host", shown).distinct().groupBy("host").agg(one.alias("different")).where(F.col("different") >= MIN_PAGES)
    hosts = settle(different.join(layouts.groupBy("host").agg(F.max(F.struct("n", "tree"))["tree"].alias("reference"), F.sum("filled").alias("filled")), "host"), "hosts", few=True)
    of = layouts.join(hosts, "host").select("host", "layout", F.xxhash64("reference").alias("to"), "tree", "reference")
    aligned = settle(of.select("layout", "to", "tree", "reference").distinct().mapInArrow(lean(_align), _ALIGNED), "aligned", few=True)
    of = of.select("host", "layout", "to")

    # A page's texts slot by slot: each once, and the first of a slot leads it.
    first = lambda b, k: (F.array_position(F.col("blocks.node"), b["node"]) == k + 1).cast("int")
    each = F.transform("blocks", lambda b, k: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("text"), b["words"].alias("words"), b["linked"].alias("linked"), b["mark"].alias("mark"), first(b, k).alias("leads")))
    items = parsed.where("size(blocks) > 0").join(hosts.select("host"), "host", "left_semi").select("host", "layout", shown, F.explode(each).alias("b")).select("host", "layout", "page", "b.*")
    sums = (F.sum("leads").alias("pages"), F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.sum(F.when(F.col("mark") == ASIDE, F.col("words")).otherwise(0)).alias("aside"))
    slots = settle(items.groupBy("host", "layout", "node").agg(*sums).join(of, ["host", "layout"]).join(aligned, ["layout", "to", "node"]), "slots", few=True)
    menu, aside = F.col("linked") > LINKED * F.col("words"), F.col("aside") > 0.5 * F.col("words")
    over = slots.groupBy("host", "place").agg(*(F.sum(k).alias(k) for k in ("pages", "words", "linked", "aside")), F.first("above").alias("above")).withColumns({"menu": menu, "aside": aside})

    # Texts that nearly all pages have in a slot; different pages are counted only where that decides.
    placed = items.join(slots.select("host", "layout", "node", "place"), ["host", "layout", "node"])
    once = placed.select("host", "place", "text", "words", "page").groupBy("host", "place", "text").agg(one.alias("rows"), F.max("words").alias("length")).where(F.col("rows") >= MIN_PAGES)
    often = settle(once.join(over.select("host", "place", "pages"), ["host", "place"]).where(F.col("rows") >= CONSTANT * F.col("pages")).drop("pages"), "often", few=True)
    seen = placed.join(often.select("host", "place", "text"), ["host", "place", "text"], "left_semi").select("host", "place", "text", "page").distinct()
    fixed = settle(often.join(seen.groupBy("host", "place", "text").agg(one.alias("seen")).where(F.col("seen") >= MIN_PAGES), ["host", "place", "text"], "left_semi"), "fixed", few=True)

    # The main region: among the containers of what varies and is neither a menu nor marked as something else.
    still = fixed.groupBy("host", "place").agg(F.sum(F.col("rows") * F.col("length")).alias("still"))
    volume = over.where("NOT menu AND NOT aside").join(still, ["host", "place"], "left").select("host", "above", F.coalesce("still", F.lit(0)).alias("still"), (F.col("words") - F.coalesce("still", F.lit(0))).alias("varies"))
    total = volume.groupBy("host").agg(F.sum("varies").alias("all"), F.sum("still").alias("same"))
    within = volume.select("host", "varies", "still", F.posexplode("above").alias("depth", "region")).groupBy("host", "region", "depth").agg(F.sum("varies").alias("varies"), F.sum("still").alias("still"))
    decisive = within.join(total, "host").where((F.col("same") <= F.col("all")) & (F.col("varies") >= REGION * F.col("all")) & (F.col("varies") > 0))
    region = decisive.groupBy("host").agg(F.max(F.struct("depth", "region"))["region"].alias("region"))
    verdict = settle(hosts.select("host", "filled").join(total, "host", "left").join(region, "host", "left"), "verdicts", few=True)

    # What each layout's nodes are: in the region or a title beside it, menus, and their constant texts.
    told = slots.select("host", "layout", "node", "place", "above", "title").join(over.select("host", "place", "menu"), ["host", "place"]).join(verdict, "host")
    told = told.join(still.select("host", "place", F.lit(True).alias("holds")), ["host", "place"], "left")
    inside = F.coalesce(F.array_contains("above", F.col("region")), F.lit(False))
    nodes = told.groupBy("host", "layout").agg(F.collect_set(F.when(inside, F.col("node"))).alias("inside"), F.collect_set(F.when(F.col("title") & F.col("holds").isNull(), F.col("node"))).alias("titles"), F.collect_set(F.when(F.col("menu"), F.col("node"))).alias("menus"))
    small = (F.col("region").isNotNull()) | (F.col("length") * F.col("filled") <= F.col("all"))
    texts_ = fixed.join(verdict, "host").where(small).select("host", "place", "text").join(slots.select("host", "layout", "node", "place"), ["host", "place"])
    wrapper = nodes.join(texts_.groupBy("host", "layout").agg(F.collect_set(F.struct("node", "text")).alias("fixed")), ["host", "layout"], "left")
    wrapper = settle(wrapper.withColumn("fixed", F.coalesce("fixed", F.array().cast("array<struct<node:int,text:bigint>>"))), "wrappers", few=True)
    full = parsed.join(wrapper, ["host", "layout"], "left")

    known = F.col("inside").isNotNull()
    template = lambda b: (b["mark"] != MAIN) & (F.array_contains("menus", b["node"]) | F.array_contains("fixed", F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("text"))))
    in_region = lambda b: (b["mark"] != ASIDE) & (F.array_contains("inside", b["node"]) | ((b["mark"] == PLAIN) & F.array_contains("titles", b["node"])))
    decided = F.coalesce(F.size("inside") > 0, F.lit(False))
    left = F.when(decided, F.filter("blocks", lambda b: in_region(b) & ~template(b))).when(known, F.filter("blocks", lambda b: by_marks(b) & ~template(b))).otherwise(F.filter("blocks", by_marks))
    text = F.coalesce(F.array_join(F.transform(left, lambda b: b["text"]), " "), F.lit(""))
    out = full.select("page_id", "url", text.alias("text"), F.when(decided, F.lit("wrapper")).otherwise(F.lit("marks")).alias("by"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "by")
