from granary.llm import wrappers as W

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site head</p></header><nav><ul><li><a href="/a">One</a><li><a>Two</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy</div><div id="cookie-notice">We use</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b><br>line
 goes&nbsp;on<p>Second &eacute;&#233;&#x1F600;</p><aside>Aside</aside><form><label>Name</label></form><ul><li>i1<li>i2</ul>
<section class="comments"><article><p>Reader says</p></article></section></article></main><div class="sidebar"><p>Side</p></div><footer>&copy; x</footer></body></html>"""


def extract(spark, rows):
    return {r.page_id: r for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, kept string")).collect()}


def test_article_only(spark):
    got = extract(spark, [(1, "http://h/1", PAGE, "x", "y"), (2, "http://h/2", PAGE.replace("First", "Erst"), "x", "y")])
    want = "Title & more\nFirst bold line goes on\nSecond éé😀\ni1\ni2"
    assert got[1].text == want and got[2].text == want.replace("First", "Erst") and got[1].n_chars == len(want)


def test_pages_without_an_article_use_what_varies(spark):
    page = lambda i: f"<html><body><div><p>Welcome to our site</p></div><div><div><p>Story {i} {'long text ' * 9}</p><p>More {i} {'other text ' * 5}</p></div></div><div class='footer'>f</div></body></html>"
    got = extract(spark, [(i, "https://k.example:80/x", page(i), None, None) for i in range(5)])
    assert all(got[i].text.startswith(f"Story {i}") and "Welcome" not in got[i].text and got[i].text.count("\n") == 1 for i in range(5))


def test_cut_and_odd_pages(spark):
    body = "<html><body><div class=ad>Ad<article><h1>H</h1><p>Text &am"
    rows = [(1, None, None), (2, None, ""), (3, "no host", "plain words"), (4, "http://q/", body), (5, "http://q/", body + "</arti"), (6, "http://q/", "<p>unclosed <a href='x>y'>link</a> end"), (6, "http://q/", "<p>unclosed <a href='x>y'>link</a> end"), (None, "http://z/", "<article>" + "<p>w</p>" * 20_000 + "</article>")]
    got = extract(spark, [(*r, "c", "c") for r in rows])
    assert got[1].text == got[2].text == "" and got[3].text == "plain words" and got[4].text == got[5].text == "H\nText &am"
    assert got[None].text.count("w") == 20_000 and W.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_folding_and_alignment():
    assert W.fold(("a", "b", "b", "b", "c")) == ("a", ("+", ("b",)), "c")
    assert W.fold(("a", "b", "a", "b", "a", "b")) == (("+", ("a", "b")),)
    w = W.align(("a", "b", "c"), ("a", ("+", ("b",)), "d", "c"))
    assert w == ("a", ("+", ("b",)), ("?", ("d",)), "c") and W.align(w, ("a", "c")) == ("a", ("?", (("+", ("b",)),)), ("?", ("d",)), "c")
    assert W._parse(W.shown(w)) == w and W.slots(w) == {"a", "b", "c", "d"}


def test_wrapper_of_a_host(spark):
    rows = [(i, "http://h/", "<nav><li>m</li></nav><article><h1>t%d</h1>%s%s</article>" % (i, "<p>x</p>" * (1 + i % 3), "<h2>y</h2>" if i % 2 else "")) for i in range(30)]
    w = W.infer(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(w) == 1 and w[0].wrapper == "{nav!x/li} {article!m/h1} ({article!m/p})+ ({article!m/h2})?"
    assert w[0].kept == ["article!m/h1", "article!m/h2", "article!m/p"]


def test_hosts_with_mixed_templates(spark):
    article = lambda i: f"<nav>m</nav><article><h1>T{i}</h1><p>Body {i}</p></article>"
    plain = lambda i: f"<div><p>Welcome</p></div><div><div><p>Story {i} {'long text ' * 9}</p><p>More {i}</p></div></div>"
    cells = lambda i: f"<nav>m</nav><table><tr><td>Cell {i} words</td></tr></table>"
    for url in ("http://h/x", None):
        rows = [(i, url, (article, plain, plain, plain, cells)[i % 5](i), None, None) for i in range(15)]
        got = extract(spark, rows)
        for i in range(15):
            want = [f"T{i}\nBody {i}", *[f"Story {i} {'long text ' * 9}".strip() + f"\nMore {i}"] * 3, f"Cell {i} words"][i % 5]
            assert got[i].text == want


def test_main_is_a_whole_name_of_a_container(spark):
    page = "<div><h1 class=main-title>Head</h1><div id=main-image>Picture</div><p>First text</p><p>Second text</p></div>"
    assert extract(spark, [(1, "http://h/", page, None, None)])[1].text == "Head\nPicture\nFirst text\nSecond text"
    assert W._kind("div", ' class="wide main"') == W._kind("section", " id=main") == W._kind("main", "") == "m" and W._kind("h1", " class=main") == ""


def story(i, extra=lambda i: ""):
    return f"<nav>m</nav><article><h1>Title {i}</h1><h2>Summary</h2>{'<p>Text %d</p>' % i * (1 + i % 3)}{extra(i)}<p>Last {i}</p></article>"


def test_template_text_inside_an_article_is_left_out(spark):
    """A text that every page of the host has in one place is the template's, whatever its element is called; headings stay."""
    pages = [story(i, lambda i: "<p>Subscribe to our letter</p>") for i in range(8)]
    got = extract(spark, [(i, "http://h/", h, None, None) for i, h in enumerate(pages)])
    for i in range(8):
        assert got[i].text == "\n".join([f"Title {i}", "Summary", *[f"Text {i}"] * (1 + i % 3), f"Last {i}"])
    few = extract(spark, [(i, "http://h/", h, None, None) for i, h in enumerate(pages[:3])])
    assert all("Subscribe" in few[i].text for i in range(3))


def test_the_alignment_decides_the_text(spark, monkeypatch):
    """Of texts that stand on every page, but not in one order, the alignment can keep only those that line up; without it the text is another."""
    order = lambda i: "".join(f"<p>{x}</p>" for x in (("One", "Two", "Three") if i % 4 else ("Two", "One", "Three")))
    rows = [(i, "http://h/", story(i, order), None, None) for i in range(12)]
    got = {i: r.text.split("\n") for i, r in extract(spark, rows).items()}
    assert all("Three" not in t and len({"One", "Two"} & set(t)) == 1 for t in got.values()) and len({tuple({"One", "Two"} & set(t)) for t in got.values()}) == 1
    streams = [W.stream(W.blocks(h), frozenset(W.token("article!m/p", x) for x in ("One", "Two", "Three"))) for _, _, h, _, _ in rows]
    whole = streams[0]
    for s in streams[1:]:
        whole = W.align(whole, s)
    anchors = W.template(whole)
    assert len(anchors) == 2 and anchors[-1] == W.token("article!m/p", "Three")
    found = W.blocks(rows[1][2])
    assert W.own_blocks(found, anchors) != found and W.own_blocks(found, anchors[::-1]) == found and W.own_blocks(found, []) == found


def plain_text(page, others):
    """An extractor of its own, by the standard library's parser: blocks of the article that don't stand on all pages."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.deep, self.tag = [], 0, None

        def handle_starttag(self, tag, attrs):
            self.deep += tag == "article"
            if tag in ("h1", "h2", "p"):
                self.tag = tag
                self.out.append([tag, "", self.deep])

        def handle_endtag(self, tag):
            self.deep -= tag == "article"
            if tag == self.tag:
                self.tag = None

        def handle_data(self, data):
            if self.tag:
                self.out[-1][1] += data

    def read(page):
        r = Reader()
        r.feed(page)
        return [(t, " ".join(x.split())) for t, x, deep in r.out if deep]

    own = [set(b for b in read(o) if b[0] == "p") for o in others]
    every = set.intersection(*own) if len(others) >= 4 else set()
    return "\n".join(x for t, x in read(page) if (t, x) not in every and x)


def test_against_a_plain_extractor(spark):
    import random

    rng = random.Random(6)
    hosts = {}
    for h in range(6):
        calls = [f"<p>Call {h} {k}</p>" for k in range(h % 3)]
        pages = []
        for i in range(rng.randint(2, 9)):
            parts = [f"<p>Body {h} {i} {k} {'word ' * rng.randint(1, 30)}</p>" for k in range(rng.randint(1, 6))]
            for k, c in enumerate(calls):
                parts.insert(k and len(parts), c)
            pages.append(f"<html><body><nav><p>menu {i}</p></nav><article><h1>H {i}</h1>{''.join(parts)}</article><footer><p>f</p></footer></body></html>")
        hosts[h] = pages
    rows = [(h * 100 + i, f"http://h{h}/", p, None, None) for h, pages in hosts.items() for i, p in enumerate(pages)]
    got = extract(spark, rows)
    for h, pages in hosts.items():
        for i, p in enumerate(pages):
            assert got[h * 100 + i].text == plain_text(p, pages), (h, i)


def test_hosts_of_many_streams_are_aligned_in_parts(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 4)
    mixed = lambda i: "".join(f"<h2>Part {k}</h2>" if (i >> k) & 1 else f"<p>Text {i} {k}</p>" for k in range(6))
    rows = [(i, "http://h/", f"<article><h1>T {i}</h1>{mixed(i)}<p>Fixed call</p></article>", None, None) for i in range(64)]
    got = extract(spark, rows)
    assert all(got[i].text == "\n".join([f"T {i}", *(f"Part {k}" if (i >> k) & 1 else f"Text {i} {k}" for k in range(6))]) for i in range(64))


def test_large_streams_stay_bounded(monkeypatch):
    monkeypatch.setattr(W, "CELLS", 10)
    a, b = tuple("abcdefgh"), tuple("axyzwvuh")
    whole = W.align(a, b)
    assert whole[0] == "a" and whole[-1] == "h" and W.slots(whole) == set(a) | set(b)


def test_any_name_of_an_element_is_taken(spark):
    odd = ["<x})?>text</x})?>", "<foo}(>a</foo}(><p>b</p>", "<a=b>c</a=b><p>d</p>", "<x{+>e<y(>f", "<p>g</x>h</p>", "<é>i</é>"]
    got = extract(spark, [(i, "http://h/", h, None, None) for i, h in enumerate(odd)] + [(9, "http://h/", "<article><p>fine</p></article>", None, None)])
    assert len(got) == 7 and got[9].text == "fine" and "text" in got[0].text
    for h in odd:
        w = W.stream(W.blocks(h))
        assert W._parse(W.shown(w)) == w


def test_time_grows_with_the_page_whatever_is_left_open():
    import time

    n = 1 << 20
    hard = ["<a ", "<a x=\">\" ", "<a x='", "<a x=\"", "<p \"'", "<!--", "<!-- -->", "<script>", "<script></style>", "<title>", "</p", "<div>x", "<div class=ad>x", "<b>x</i>", "<a href='x'>", "<![CDATA[", "<?", "&amp", "<li><p>x"]
    for h in hard:
        page = h * (n // len(h))
        began = time.perf_counter()
        found = W.blocks(page)
        took = time.perf_counter() - began
        assert took < 5, (h, took)
        assert max((len(p) for p, _ in found), default=0) < 10_000, h


def test_tags_and_quotes():
    cases = {
        "<p title='a > b'>one</p><p>two": ["one", "two"], '<p title="it\'s">x</p>': ["x"], "a < b and c > d": ["a < b and c > d"], "<p title=\"open>x</p><p>y</p>": ["x", "y"],
        "1 <2 <p>z</p>": ["1 <2", "z"], "<p it's>q</p>": ["q"], "x<svg><p>no</p></svg>y": ["x y"], "x<script>a</SCRIPT >y": ["xy"], "<p>cut <b": ["cut"], "<p>cut </b": ["cut"],
    }
    for page, want in cases.items():
        assert [t for _, t in W.blocks(page)] == want, page


def test_pages_of_no_template_do_not_disable_it(spark):
    pages = [story(i, lambda i: "<p>Subscribe to our letter</p>") for i in range(8)]
    for odd in (None, "<h1>404</h1><p>Not found</p>", story(9)):
        got = extract(spark, [(i, "http://h/", h, None, None) for i, h in enumerate([*pages, odd])])
        assert not any("Subscribe" in r.text for r in got.values())
        assert all(got[i].text == "\n".join([f"Title {i}", "Summary", *[f"Text {i}"] * (1 + i % 3), f"Last {i}"]) for i in range(8))
    assert got[8].text.startswith("Title 9")


def test_alignment_is_the_same_method_at_any_length(monkeypatch):
    import random

    def plain(a, b):
        """The best sum of an alignment of plain cores."""
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                g = (3 if "=" in a[i] else 2) if a[i] == b[j] else 1 if a[i].partition("=")[0] == b[j].partition("=")[0] else 0
                best[i][j] = max(best[i + 1][j], best[i][j + 1], g + best[i + 1][j + 1] if g else 0)
        return best[0][0]

    rng = random.Random(7)
    for k in range(400):
        monkeypatch.setattr(W, "CELLS", 1_000_000 if k % 2 else 10)
        a, b = (tuple(rng.choice(["p", "q", "r", "p=1", "p=2", "q=1"]) for _ in range(rng.randrange(12))) for _ in range(2))
        steps = list(W._ways(list(a), list(b)))
        assert sum(g for *_, g in steps) == plain(a, b) and [s[:2] for s in steps] == sorted(s[:2] for s in steps) and steps[-1] == (len(a), len(b), 0)
    monkeypatch.undo()
    # two streams of a product above 1,000,000 that share some tokens: these stay required, and once
    a = ("x", *(f"a{i}" if i % 3 else f"p{i}=1" for i in range(1500)), "end of a")
    b = ("y", *(f"b{i}" if i % 3 else f"p{i}=1" for i in range(1500)), "end of b")
    assert [n for n in W.align(a, b) if isinstance(n, str)] == [f"p{i}=1" for i in range(0, 1500, 3)]
    assert W.template(W.align(a, b)) == [f"p{i}=1" for i in range(0, 1500, 3)]
