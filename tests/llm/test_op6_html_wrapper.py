"""Hand-made pages, a plain Python version of the whole operator, and every matching of small trees."""

import itertools
import json
import random
import re
import time
from collections import Counter

from pipewright.llm import html_wrapper as hw

from .helpers import WORDS, table

SCHEMA = "page_id long, url string, html string, text string"


def extract(spark, pages):
    rows = [(k, url, html, "old") for k, (url, html) in enumerate(pages)]
    return {r.page_id: r.text for r in hw.main_text(table(spark, rows, SCHEMA)).collect()}


def blocks(html):
    return " ".join(b[1] for b in hw.Page(html).shown())


def test_markup():
    assert blocks("<article><h1>T &amp; U</h1><p><b>One<br><p>two <i>th</i>ree&nbsp;&eacute;</p></article><footer>f</footer>") == "T & U One two three é"
    assert blocks("<script>var t='</p><p>no';</script><style>p{}</style><p>yes<!-- <p>no</p> --> and<textarea><p>no</textarea> more") == "yes and more"
    assert blocks("a < b && c > d &lt;e&gt; <p>x") == "a < b && c > d <e> x"
    assert blocks("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><dl><dt>e<dd>f</dl>") == "a b c d e f"
    assert blocks("<P CLASS='x'>Up</P><p title='a > b'>q</p><p>unfinished <b") == "Up q unfinished"
    assert blocks("") == blocks("<html></html>") == blocks("<!-- only") == ""


def test_other_text_is_left_out():
    body = "<nav>n</nav><header>site</header><div class='side-bar'>s</div><div id=menu>m</div><div role=complementary>r</div><div class='cookie-notice'>k</div><form>f<input></form><aside>a</aside><div class='ads box'>b</div><section class=comments><p>c</p></section><div hidden>h</div><p style='display: none'>d</p><footer>z</footer>"
    assert blocks(body + "<p>main</p>") == "main"
    assert blocks(f"<article><header><h1>Title</h1></header>{body.replace('<header>site</header>', '')}<p>text<span class=ad>buy <span>now</span></span> on</p></article><p>beside</p>") == "Title text on"
    assert blocks("<main><p>in</p></main><p>out</p>") == "in"
    assert blocks("<div class='adapter shadow'>kept</div>") == "kept"


def test_simple_tree_matching():
    a = [(-1, "body"), (0, "div"), (1, "p"), (0, "footer")]
    b = [(-1, "body"), (0, "nav"), (0, "div"), (2, "h1"), (2, "p"), (0, "footer")]
    assert hw.simple_tree_matching(a, b) == {0: 0, 1: 2, 2: 4, 3: 5}
    assert hw.simple_tree_matching(a, [(-1, "html")]) == {}
    deep = [(k - 1, "div") for k in range(3000)]
    assert len(hw.simple_tree_matching(deep, deep)) == 3000


def test_constant_nodes_are_template(spark):
    def page(i, extra=""):
        return f"<body><div class=lead>Welcome to our site</div><div class=story><h2>Story {i}</h2><p>Body of {i}</p>{extra}</div><div class=legal>All of this is ours</div></body>"

    pages = [(f"http://one.example/{i}", page(i)) for i in range(4)] + [("https://ONE.example:8080/x", page(9, "<h3>Only here</h3>"))]
    pages += [("http://two.example/a", page(1)), ("http://two.example/b", page(1)), ("http://two.example/c", page(1)), ("http://two.example/d", page(2))]
    pages += [(None, page(5)), ("not a url", None), ("http://one.example/e", "")]
    got = extract(spark, pages)
    assert [got[k] for k in range(4)] == [f"Story {i} Body of {i}" for i in range(4)]
    assert got[4] == "Story 9 Body of 9 Only here"
    # Copies don't make a page's own text template: two different pages are too few.
    assert got[5] == "Welcome to our site Story 1 Body of 1 All of this is ours"
    assert got[9].startswith("Welcome") and got[10] == got[11] == ""


def test_menus_without_marks(spark):
    pages = [(f"http://m.example/{i}", f"<div class=x><a href=1>Home {i}</a> <a href=2>More {i}</a></div><div class=y><p>Long text number {i} with <a href=3>one</a> link</p></div>") for i in range(4)]
    assert extract(spark, pages)[2] == "Long text number 2 with one link"


def test_edges(spark):
    rows = [(None, "http://a.example", "<p>x</p>", "old"), (7, "http://a.example", "<p>x</p>", "old"), (7, "http://a.example", "<p>x</p>", "old"), (8, "http://b.example", "<p>" + "word " * 60_000, "old")]
    out = hw.main_text(table(spark, rows, SCHEMA))
    assert out.columns == ["page_id", "url", "text", "n_chars", "by"]
    assert sorted((str(r.page_id), r.n_chars) for r in out.collect()) == [("7", 1), ("7", 1), ("8", 60_000 * 5 - 1), ("None", 1)]
    assert hw.main_text(table(spark, [], SCHEMA)).collect() == []


def test_marked_inline_elements_are_left_out():
    for marked in ("<small class='advert'>no</small>", "<mark class=notice>no</mark>", "<font style='display:none'>no</font>", "<time hidden>no</time>", "<a class='sponsored' href=x>no</a>", "<a href=x CLASS='skip'>no</a>", "<em id=cookie>no <em>no</em></em>", "<label>no</label>"):
        assert blocks(f"<article><p>one {marked} two</p><p>three</p></article>") == "one two three", marked
    for kept in ("<small>two</small>", "<em class=strong>two</em>", "<a href='/id/style'>two</a>", "<code lang=x>two</code>"):
        assert blocks(f"<article><p>one {kept} three</p></article>") == "one two three", kept
    # A link that is left out doesn't make the words after it linked.
    assert hw.Page("<p><a class=skip>no</a> two words</p>").blocks[0][2:4] == (2, 0)


def test_pages_count_over_all_layouts(spark):
    extras = ["<h3>x{}</h3>", "<ul><li>y{}</ul>", "<table><tr><td>z{}</table>", "<blockquote>q{}</blockquote>", "<pre>p{}</pre>"]

    def page(i):
        # Each page has a layout of its own; all but the first, the reference or not, have a banner that never changes.
        banner = "<div class=strip>Buy our things now</div>" if i else ""
        return f"<body><div class=lead>Welcome to our site</div>{banner}<div class=links><a href=1>Home {i}</a></div><div class=story><p>Body of {i} is a text</p>{extras[i].format(i)}</div></body>"

    got = extract(spark, [(f"http://own.example/{i}", page(i)) for i in range(5)])
    assert [got[i] for i in range(5)] == [f"Body of {i} is a text {x}{i}" for i, x in enumerate("xyzqp")]


def test_nodes_beyond_the_reference_are_aligned():
    reference = [(-1, "body", 0), (0, "p", 0)]
    one, two, own = (hw.places([(*x, 0) for x in t], reference) for t in ([(-1, "body"), (0, "div.x"), (1, "p"), (0, "p")], [(-1, "body"), (0, "p"), (0, "ul"), (0, "div.x"), (3, "p")], [x[:2] for x in reference]))
    assert one[0] == two[0] == own[0] and one[3] == two[1] == own[1] and one[1:3] == two[3:] and len({*one, *two}) == 5


def test_near_copies_keep_their_article(spark):
    body = " ".join(f"word{k}" for k in range(40))
    marked = [f"<div class=lead>Hello</div><article><h1>Title {i}</h1><h2>Summary</h2><p>By Ann</p><div class=x>{body}</div></article>" for i in range(4)]
    plain = [f"<div class=lead>Hello</div><h1>Title {i}</h1><p>{body}</p>" for i in range(4)]
    got = extract(spark, [(f"http://{host}.example/{i}", html) for host, htmls in (("a", marked), ("b", plain)) for i, html in enumerate(htmls)])
    assert [got[i] for i in range(4)] == [f"Title {i} Summary By Ann {body}" for i in range(4)]
    assert [got[4 + i] for i in range(4)] == [f"Title {i} {body}" for i in range(4)]


def all_matchings(a, b, x=-1, y=-1):
    """The most pairs that any matching below x and y can have, by trying every set of sibling pairs."""
    xs, ys = [k for k, n in enumerate(a) if n[0] == x], [k for k, n in enumerate(b) if n[0] == y]
    most = 0
    for n in range(min(len(xs), len(ys)) + 1):
        for left in itertools.combinations(xs, n):
            for right in itertools.combinations(ys, n):
                if all(a[i][1] == b[j][1] for i, j in zip(left, right, strict=True)):
                    most = max(most, sum(1 + all_matchings(a, b, i, j) for i, j in zip(left, right, strict=True)))
    return most


def test_matching_against_every_matching():
    rng = random.Random(4)

    def tree(n):
        return [(rng.randrange(k) if k and rng.random() < 0.9 else -1, rng.choice(["div", "p", "ul"]), 0) for k in range(n)]

    for _ in range(300):
        a, b = tree(rng.randrange(7)), tree(rng.randrange(7))
        pairs = hw.simple_tree_matching(a, b)
        assert len(pairs) == all_matchings(a, b) and len(set(pairs.values())) == len(pairs)
        for x, y in pairs.items():
            assert a[x][1] == b[y][1] and (pairs.get(a[x][0], -1) == b[y][0])
        for (x, y), (u, v) in itertools.combinations(sorted(pairs.items()), 2):
            assert y < v if a[x][0] == a[u][0] else True


def test_wide_pages_are_matched_in_time():
    wide = lambda turn: [(-1, "body", 0)] + [(0, f"div.c{(k * turn) % 4001}", 0) for k in range(4000)]
    began = time.perf_counter()
    assert len(hw.simple_tree_matching(wide(1), wide(3))) > 1300
    assert time.perf_counter() - began < 2


def brute(pages):
    """(text, by) of each (url, html) in plain Python, host by host."""
    out = {}
    hosts = {}
    for k, (url, html) in enumerate(pages):
        hosts.setdefault(hw.host(url), []).append((k, hw.Page(html or "")))
    for members in hosts.values():
        shown = {k: tuple(b[1] for b in p.shown()) for k, p in members}
        full = [(k, p) for k, p in members if p.blocks]
        for k, _ in members:
            out[k] = (" ".join(shown[k]), "marks")
        if len({shown[k] for k, _ in full}) < hw.MIN_PAGES:
            continue
        trees = Counter(json.dumps(p.nodes, separators=(",", ":")) for _, p in members)
        reference = [tuple(n) for n in json.loads(max((n, t) for t, n in trees.items())[1])]
        place = {k: hw.places(p.nodes, reference) for k, p in members}
        above = {k: hw.containers(p.nodes, place[k]) for k, p in members}
        slots, holds, seen = {}, {}, {}
        for k, p in full:
            for n in {b[0] for b in p.blocks}:
                slots.setdefault(place[k][n], [0, 0, 0, 0, above[k][n]])[0] += 1
            for n, text, words, linked, mark in p.blocks:
                s = slots[place[k][n]]
                s[1] += words
                s[2] += linked
                s[3] += words if mark == hw.ASIDE else 0
                holds.setdefault((place[k][n], text), []).append(words)
                seen.setdefault((place[k][n], text), set()).add(shown[k])
        menu = {s for s, (_, w, l, _, _) in slots.items() if l > hw.LINKED * w}
        fixed = {key: ws for key, ws in holds.items() if len(ws) >= max(hw.MIN_PAGES, hw.CONSTANT * slots[key[0]][0]) and len(seen[key]) >= hw.MIN_PAGES}
        still = Counter()
        for (s, _), ws in fixed.items():
            still[s] += sum(ws)
        counted = [s for s, v in slots.items() if s not in menu and v[3] <= 0.5 * v[1]]
        varies = {s: slots[s][1] - still[s] for s in counted}
        every, same = sum(varies.values()), sum(still[s] for s in counted)
        within = Counter()
        for s in counted:
            for depth, c in enumerate(slots[s][4]):
                within[depth, c] += varies[s]
        region = max((dc for dc, v in within.items() if v >= hw.REGION * every and v > 0 and same <= every), default=None)
        for k, p in full:
            decided = region is not None and any(region[1] in above[k][b[0]] for b in p.blocks)
            left = []
            for b in p.blocks:
                s = place[k][b[0]]
                if decided:
                    kept = b[4] != hw.ASIDE and (region[1] in above[k][b[0]] or b[4] == hw.PLAIN and p.nodes[b[0]][1].split(".")[0] == "h1" and not still[s])
                else:
                    kept = b in p.shown()
                gone = s in menu or (s, b[1]) in fixed and (region is not None or len(fixed) and max(fixed[s, b[1]]) * len(full) <= every)
                if kept and not (gone and b[4] != hw.MAIN):
                    left.append(b[1])
            out[k] = (" ".join(left), "wrapper" if decided else "marks")
    return out


def test_against_python(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(30)}" for _ in range(n))
    pages = []
    for site in range(8):
        plain = site % 2
        fixed = [text(rng.randrange(1, 12)) for _ in range(4)]
        box = "div" if plain else "article"
        body = text(40)
        for k in range(rng.choice([1, 2, 3, 5, 8])):
            cards = "".join(f"<div><p>{rng.choice(fixed) if rng.random() < 0.5 else text(3)}</p></div>" for _ in range(rng.randrange(4)))
            menu = "".join(f"<li><a href=x>{text(1)}</a>" for _ in range(rng.randrange(3, 6)))
            paragraphs = "".join(f"<p>{text(rng.randrange(1, 25))}</p>" for _ in range(rng.randrange(1, 4))) if site != 5 else f"<p>{body}</p>"
            extra = rng.choice(["", f"<h3>{text(2)}</h3>", f"<ul><li>{text(4)}<li>{fixed[3]}</ul>", f"<div class=comments><p>{text(6)}</p></div>"])
            title = f"<h1>{text(3)}</h1>"
            html = f"<body><div>{fixed[0]}</div><ul>{menu}</ul>{title if site == 3 else ''}<{box}>{title if site != 3 else ''}{paragraphs}{extra}<p>{fixed[1]}</p></{box}><div>{cards}</div><div><p>{fixed[2]} {text(1) if site == 6 else ''}</p></div>"
            pages.append((f"https://h{site}.example/{k}", html))
            if rng.random() < 0.2:
                pages.append(pages[-1])
    pages += [("https://h1.example/null", None), ("https://h2.example/empty", "<p></p>"), (None, "<p>a b</p>"), ("x", "<p>c d</p>")]
    rows = [(k, url, html, "old") for k, (url, html) in enumerate(pages)]
    got = {r.page_id: (r.text, r.by) for r in hw.main_text(table(spark, rows, SCHEMA)).collect()}
    want = brute(pages)
    assert got == want
    assert Counter(by for _, by in want.values())["wrapper"] > 10 < Counter(by for _, by in want.values())["marks"]


def names_off(html):
    return re.sub(r"\s(?:class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html)


def test_the_wrapper_needs_no_names(spark):
    """On hosts with a wrapper neither class and role names nor the elements' names decide: without them the text is the same."""
    import duckdb

    pages = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    extracts = []
    for change in (str, names_off, lambda h: re.sub(r"<(/?)(?:nav|article|main|footer|header|aside|section)\b", r"<\1div", names_off(h))):
        rows = [(k, u, change(h), "old") for k, u, h in pages]
        extracts.append({r.page_id: (r.by, r.text) for r in hw.main_text(table(spark, rows, SCHEMA)).collect()})
    wrapped = [k for k, (by, _) in extracts[0].items() if by == "wrapper"]
    assert len(wrapped) > 0.8 * len(pages)
    # The wrapper takes something off every one of these pages, and leaves the article.
    for k, _, html in pages:
        whole = " ".join(b[1] for b in hw.Page(html).blocks)
        assert extracts[0][k][0] == "marks" or len(extracts[0][k][1]) < len(whole)
    assert extracts[0] == extracts[1]
    assert all(extracts[2][k] == extracts[0][k] for k in wrapped)


def test_items_of_a_slot_vary_one_by_one(spark):
    """Constant items go from between items that vary, in iterated slots and in rows of like containers."""
    def page(i):
        cards = "".join(f"<div><p>{t}</p></div>" for t in ("Subscribe today", f"card {i} says more than that", "Call us now"))
        return f"<body><div><p>Share this</p><p>Words of page {i} and many others besides</p><p>Read on below</p>{cards}</div>"

    got = extract(spark, [(f"http://i.example/{i}", page(i)) for i in range(4)])
    assert got == {i: f"Words of page {i} and many others besides card {i} says more than that" for i in range(4)}


def test_odd_html_takes_linear_time():
    n = 100_000
    for text in ("<" + "a" * n, "<span class=ad>" * (n // 15), "<div>" * (n // 5) + "x", "<p a='" * (n // 6)):
        start = time.process_time()
        hw.Page(text)
        assert time.process_time() - start < 10, text[:20]
    shown = lambda t: [b[1] for b in hw.Page(t).shown()]
    assert shown("<p>a <span class=ad>b <span class=ad>c</span> d</span> e</p>") == ["a", "e"]
    assert shown("<p>a <span class=ad>b <span class=ad>c</span> e</p>") == ["a", "b", "e"]
