import random
import sys
import time

import pytest

from docloom.llm import html as H


@pytest.mark.parametrize(
    "source,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<br>c <b>d\n  e</b>", "a\nb c d e"),
        ("<nav><a>x</a></nav><article><h1>T</h1><p>One &eacute;</p><p></p><p>Two<i>!</i></p></article><footer>f</footer>", "T\nOne é\nTwo!"),
        ("<div class='ad'>no</div><div class='article-body'><p>yes</p></div><div id=comments><p>me too</p></div>", "yes"),
        ("<main><p>a</p><form>f<input></form><aside>s</aside><section class='comments'><p>c</p></section><p>b</p></main>", "a\nb"),
        ("<article><p>a<script>var x='<p>no</p>';</script>b</p><style>p{}</style></article>", "ab"),
        ("<article><p>a<!-- <p>no</p> -->b</p></article>", "ab"),
        ("<article>1 < 2 <3 & 4</article>", "1 < 2 <3 & 4"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
        ("<header>h</header><article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<article><p>a</p><div class='site-footer'>x</div></article><article><p>b</p></article>", "a\nb"),
        ("<article><div class='header-image'>x</div><p>a</p></article>", "x\na"),
        ("<body class='right-sidebar'><p>x</p></body>", "x"),
        ("<html class='no-js menu-closed'><body><div class='content has-sidebar'><p>x</p></div>", "x"),
        ("<article><header class='entry-header'><h1>T</h1></header><p class='share-price'>1</p><p class='alert-level'>2</p><p class='form-1040'>3</p><p class='related-story-text'>4</p></article>", "T\n1\n2\n3\n4"),
        ("<div class='sidebar'><p>holds most of the page</p></div><p>b</p>", "holds most of the page\nb"),
        ("<p>b</p><ol class='comment-list'><li>longer than the page itself</ol>", "b"),
        ("<div>" * 450 + "<nav><p>menu</p></nav><p>t</p>", "t"),
        ("<div><article>" + "<div>" * 450 + "x" + "</div>" * 450 + "<p>more</p></article></div>", "x\nmore"),
        ("<article><p hidden>h</p><p style='display: none'>n</p><p>v</p></article>", "v"),
        ("<article>a<!-- open", "a"),
        ("<article>a<script>open", "a"),
        ("<article>a<b class=\"x", "a"),
        ("</p></div><article>a</article></article>", "a"),
        ("<title>t</title><body><p>x</p></body>", "x"),
    ],
)
def test_extract(source, text):
    assert H.extract(source) == text


def test_alignment_is_a_largest_ordered_matching():
    """Against a plain recursive definition on small random trees."""
    rnd = random.Random(2)

    def tree(depth):
        return (rnd.choice("ab"), [tree(depth - 1) for _ in range(rnd.randrange(4))] if depth else [])

    def rows(t, parent=-1, out=None):
        out = [] if out is None else out
        me = len(out)
        out.append([parent, t[0], 0])
        for c in t[1]:
            rows(c, me, out)
        return out

    def best(x, y):
        if x[0] != y[0]:
            return 0
        table = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, a in enumerate(x[1]):
            for j, b in enumerate(y[1]):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + best(a, b))
        return 1 + table[-1][-1]

    for _ in range(200):
        x, y = tree(3), tree(3)
        got = H.align(H.Outline(rows(x)), H.Outline(rows(y)))
        assert len(got) == best(x, y)
        assert len(set(got.values())) == len(got)


def test_odd_pages_take_linear_time():
    begun = time.time()
    for source in ["<div>" * 30_000, "<p>" * 50_000, "<a href=\"" * 3_000, "<" * 100_000, "<!--" * 50_000, "<li>x" * 20_000, "</div>" * 50_000, "&" * 100_000]:
        H.extract(source)
    assert time.time() - begun < 40
    wide = "<article>" + "".join(f"<p>{i}</p>" for i in range(5000)) + "</article>"
    assert len(H.extract(wide, {H._pack(H.outline(wide)): {5}}).split("\n")) == 4999


def site(n, rnd):
    """Pages whose furniture has no telling names, so that only alignment finds it."""
    out = []
    for i in range(n):
        words = ["w%d" % rnd.randrange(10_000) for _ in range(60)]
        paras = [" ".join(words[j : j + 15]) for j in range(0, 60, 15)][: rnd.randrange(1, 5)]
        body = "".join(f"<p>{p}</p>" for p in paras)
        out.append((f"<body><div>Our Site</div><div>Home | News</div><div><h1>Title {i}</h1>{body}</div><div>All rights reserved</div></body>", "\n".join([f"Title {i}", *paras])))
    return out


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_template_of_a_host_is_left_out(spark, broadcast_bytes):
    rnd = random.Random(1)
    pages = [(i, f"https://WWW.site.example/{i}", h, t) for i, (h, t) in enumerate(site(60, rnd))]
    pages += [(100, "http://lonely.example/", "<body><div>Menu</div><p>text</p></body>", "Menu\ntext")]
    pages += [(101, None, "<p>x</p>", "x"), (102, "http://site", None, ""), (103, "u", "", ""), (None, "u", "<p>y</p>", "y"), (1, *pages[1][1:])]
    frame = spark.createDataFrame([(p, u, h, "clash") for p, u, h, _ in pages], "page_id long, url string, html string, wrapper string").repartition(4)
    got = H.main_text(frame, ["page_id", "url"], broadcast_bytes=broadcast_bytes).collect()
    assert len(got) == len(pages)
    want = {p: t for p, _, _, t in pages}
    assert {r.page_id: r.main_text for r in got} == want


def test_query(spark, tmp_path):
    pages = [(i, "http://a.b/c", f"<nav>n</nav><article><p>é {i}</p></article>") for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, H.op4(spark, str(tmp_path)).collect()))
    assert got == sorted((i, "http://a.b/c", f"é {i}", len(f"é {i}")) for i in range(12))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.main_text(empty, ["page_id"]).count() == 0


def test_long_lists_are_aligned_like_short_ones(monkeypatch):
    def outline(n, mark):
        body = "".join(f"<p>{mark} {i}</p>" for i in range(n))
        return H.Outline(H.outline(f"<div>{body}<p>the constant end</p></div>"))

    page, other = outline(300, "one"), outline(250, "two")
    last, end = len(page.label) - 1, len(other.label) - 1
    assert H.align(page, other)[last] == end

    def worth(a, b, pairs):
        return sum(1 + 0.5 * (a.hash[i] != 0 and a.hash[i] == b.hash[j]) for i, j in pairs.items())

    rnd = random.Random(5)
    made = lambda: "".join(rnd.choice(["<p>%d</p>", "<ul><li>%d<li>x</ul>", "<div>%d</div>", "<p><div>a</div>%d</p>"]) % rnd.randrange(6) for _ in range(rnd.randrange(1, 30)))
    for _ in range(60):
        a, b = (H.Outline(H.outline(f"<div>{made()}</div>")) for _ in range(2))
        monkeypatch.setattr(H, "CELLS", 40_000)
        short = worth(a, b, H.align(a, b))
        monkeypatch.setattr(H, "CELLS", 4)
        assert worth(a, b, H.align(a, b)) == short


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_each_layout_of_a_host_has_its_template(spark, broadcast_bytes):
    rnd = random.Random(6)
    pages = []
    kinds = [("<div>{}</div>", "div"), ("<table><tr><td>{}</table>", "table"), ("<section class='gallery'>{}</section>", "section"), ("<blockquote>{}</blockquote>", "quote")]
    for i in range(40):
        wrap, mark = kinds[i % 4]
        said = " ".join("w%d" % rnd.randrange(10_000) for _ in range(20))
        inner = f"<p>Menu of {mark}</p><p>{said}</p><p>Rights of {mark}</p>"
        pages.append((i, "http://one.test/%d" % i, "<body>" + wrap.format(inner) + "</body>", said))
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.main_text for r in H.main_text(frame, ["page_id"], broadcast_bytes=broadcast_bytes).collect()}
    assert got == {p[0]: p[3] for p in pages}


def test_two_references_whatever_their_hashes(spark):
    for n in range(2, 6):
        frame = spark.createDataFrame([(f"http://h{k}.test/", f"<p>{n} {k} {i}</p>") for k in range(8) for i in range(n)], "url string, html string")
        assert {len(r.refs) for r in H.references(frame).where("layout is null").collect()} == {2}


def test_deep_pages_are_aligned():
    page = "<div>" * 5000 + "<p>said</p>" + "</div>" * 5000 + "<p>end</p>"
    own = H.Outline(H.outline(page))
    assert H.align(own, own) == {i: i for i in range(len(own.label))}


def test_wrapper_finds_the_content_of_pages_without_telling_names(spark):
    """Pages of the tables whose elements and classes no longer tell what is the article."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    pages = pages[pages.html.notnull()]
    want = {p: H.extract(h) for p, h in zip(pages.page_id, pages.html)}
    bare = pages.assign(html=pages.html.str.replace(r"<(/?)(?:article|nav|footer)\b", r"<\1div", regex=True).str.replace('<div class="ad">', "<div>"))
    pages = pages.assign(host=pages.url.str.extract(r"//([^/:]+)")[0].str.lower())
    many = set(pages[pages.groupby("host").page_id.transform("count") >= H.LEAST_PAGES].page_id)
    frame = spark.createDataFrame(bare[["page_id", "url", "html"]])
    got = {r.page_id: r.main_text for r in H.main_text(frame, ["page_id"]).collect()}
    alone = {p: H.extract(h) for p, h in zip(bare.page_id, bare.html)}
    assert len(many) > 100
    assert sum(got[p] == want[p] for p in many) == len(many)
    assert sum(alone[p] == want[p] for p in many) == 0


def test_slot_against_a_plain_search():
    """The content slot is the last of the containers on the way down that hold most of the varying text."""
    rnd = random.Random(9)

    def tree(depth):
        tag = rnd.choice(["div", "div", "p", "h2"]) if depth < 5 else "div"
        return [tag, rnd.randrange(50), [tree(depth - 1) for _ in range(rnd.randrange(4))] if depth else []]

    for _ in range(200):
        t, labels, parents, mass = tree(5), [], [], {}

        def walk(x, parent):
            me = len(labels)
            labels.append(x[0])
            parents.append(parent)
            mass[me] = x[1]
            x.append(me)
            for c in x[2]:
                walk(c, me)

        walk(t, -1)
        total = lambda x: x[1] + sum(map(total, x[2]))
        heading = lambda x: (x[0] == "h2" and total(x) > 0) or any(map(heading, x[2]))
        x = t
        while True:
            more = [c for c in x[2] if c[0] == "div" and total(c) >= H.MAIN_SHARE * total(x)] if total(t) else []
            if not more or any(heading(c) for c in x[2][: x[2].index(more[0])]):
                break
            x = more[0]
        other = H.Outline([[p, f"{g}.", 0] for p, g in zip(parents, labels)])
        assert H._main_slot(other, set(), mass) == x[3]


def _lines_run(f) -> int:
    """Lines of Python that a call runs; unlike seconds, the same on every machine."""
    n, before = 0, sys.gettrace()

    def count(frame, event, arg):
        nonlocal n
        n += event == "line"
        return count

    sys.settrace(count)
    try:
        f()
    finally:
        sys.settrace(before)
    return n


def test_work_for_each_node_is_bounded():
    """Pages of the tables: lines run for a node to read a page, and to align it with another."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet").html.dropna().tolist()[:60]
    outlines = [H.Outline(H.outline(x)) for x in pages]
    nodes = sum(len(x.label) for x in outlines)
    assert _lines_run(lambda: [H.Page(x) for x in pages]) < 58 * nodes
    assert _lines_run(lambda: [H.align(a, b) for a, b in zip(outlines, outlines[1:])]) < 30 * nodes


def test_lists_in_step_are_aligned_as_by_a_table(monkeypatch):
    rnd = random.Random(8)
    kinds = ["<p>%d</p>", "<p>%d</p>", "<p></p>", "<li>%d", "<div>%d</div>", "<p><div>a</div>%d</p>", "<h2>%d</h2>"]
    met = 0
    for k in range(400):
        base = [rnd.choice(kinds) for _ in range(rnd.randrange(1, 9))]
        more = base[: rnd.randrange(1, 9)] if k % 2 else base + [rnd.choice(kinds) for _ in range(rnd.randrange(5))]
        fill = lambda some, top: "<div>" + "".join(x % rnd.randrange(top) if "%" in x else x for x in some) + "</div>"
        a, b = (H.Outline(H.outline(fill(x, rnd.choice([4, 10**9])))) for x in rnd.sample([base, more], 2))
        with monkeypatch.context() as m:
            m.setattr(H, "_in_step", lambda *_: 0)
            want = H.align(a, b)
        met += bool(H._in_step(a, b, 1, 1))
        assert H.align(a, b) == want
    assert met > 50


def test_layouts_do_not_tell_letters_of_either_case_and_digits_apart(spark):
    same = ["<DIV CLASS='Ab1'><P>x</P></DIV>", "<div class='aB22'><p>y<p>z</div>"]
    other = ["<div class='ac1'><p>x</p></div>", "<div><p>x</p></div>", "", None]
    found = spark.createDataFrame([(x,) for x in same + other], "html string").select(H.layout().alias("l"), "html").collect()
    by = {r.html: r.l for r in found}
    assert by[same[0]] == by[same[1]]
    assert len(set(by.values())) == 4
