import random
import re
from html.parser import HTMLParser

from docloom.llm import html_text as h


class Plain(HTMLParser):
    """The texts of headings and paragraphs in an article."""

    def __init__(self):
        super().__init__()
        self.on, self.out = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("h1", "p"):
            self.out.append("")
        if tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        if tag in ("h1", "p"):
            self.out.append("")

    def handle_data(self, data):
        if self.on:
            self.out[-1] += data


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    return "\n\n".join(x for x in (" ".join(x.split()) for x in p.out) if x)


def test_table_against_a_plain_parser(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r.page_id: r for r in df.collect()}
    got = {r.page_id: r for r in h.main_text(df).collect()}
    assert got.keys() == pages.keys()
    for i, r in got.items():
        assert r.text == plain(pages[i].html) and r.n_chars == len(r.text) and r.url == pages[i].url


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home<li><a href=/b>B</ul></nav>
<div class="cookie-notice">We use cookies</div><div id=sidebar>Side <p>more side</div>
<article class=post><header><h2>Head &lt;1&gt;</h2></header><p>First   para<br>with&nbsp;break <b>bold
<p class="ad">Buy now</p><p>Second 5 < 6 &eacute;&#x41;&#66;</p><ul><li>one<li>two</ul>
<form><input name=q> Search <button>Go</button></form><table><tr><td>a<td>b<tr><td>c</table>
<section class="comments"><article><p>Nice post!</p></article></section><div hidden>secret</div>
<script>var x = "</p><p>no";</script></article><aside>Related</aside><footer>&copy; me</footer></body></html>"""


def test_structure():
    assert h.chosen(h.blocks(PAGE))[1] == ["Head <1>", "First para with break bold", "Second 5 < 6 éAB", "one", "two", "a b", "c"]


def test_articles_under_chrome_names():
    text = lambda page: h.chosen(h.blocks(page))[1]
    body = "<p>The story itself.</p>"
    for page in (
        f'<body class="single-post has-sidebar">{body}</body>', f'<div class="content-widget">{body}</div>', f'<article class="post related-news">{body}</article>', f'<div class="text share-text">{body}</div>',
        f'<form id="aspnetForm"><article>{body}</article></form>', f'<form id="aspnetForm">{body}</form>', f'<div class="sidebar-layout"><main>{body}</main></div>', f'<main>{body}<div class="adBox">Buy</div><div id="commentList">Nice</div></main>',
        f'<article>{body}<div class="newsletterSignup">Join</div></article>', f'<article>{body}</article><div class="comments"><article>Nice</article></div>',
    ):
        assert text(page) == ["The story itself."], page
    assert text("<main><p>Real main text that goes on for long</p><article>Teaser</article></main>") == ["Real main text that goes on for long", "Teaser"]


def test_structure_loses_no_article():
    text = lambda page: h.chosen(h.blocks(page))[1]
    long = "Long article text that goes on and on for a while."
    assert text(f'<body>Copyright 2020<form id="aspnetForm"><div id="content"><p>{long}</div></form></body>') == [long]
    assert text('<p>Home</p><div class="layout-sidebar"><div class="content"><p>Real text.') == ["Real text."]
    assert text('<div class="comment-policy"><article><p>Real</p></article></div><p>open</p>') == ["Real"]
    assert text("<main><header><h1>Title</h1></header><p>Body</p></main>") == ["Title", "Body"]
    assert text(f"<header><h1>Site</h1></header><main><p>{long}</p></main>") == [long]
    assert text(f'<div class="text">Menu</div><p>{long}</p>') == ["Menu", long]  # the words are a prior, the text decides
    assert text(f'<div class="content">{long}</div><p>Home</p>') == [long]
    assert text(f'<p>{long}</p><div class="comment-list"><article>Nice post! {long}</article></div>') == [long]


def test_partial_blocks_keep_their_unique_words():
    common = "these are fifty bytes or more of words that are common"
    t = [f"One {common} three", "four five", f"Größe {common}"]
    raw = "\n".join(t).encode()
    span = lambda w, n=5: (raw.find(w.encode()), raw.find(w.encode()) + len(w.encode()), n, 1)
    assert h.unique_runs(t, [span(common + " thr")], True) == ["One three", *t[1:]]  # a word cut in two stays
    assert h.unique_runs(t, [span(common + " three\nfour")], True) == ["One", "four five", t[2]]  # the end of a string in the next block stays
    assert h.unique_runs(t, [span("four five\nGröße")], True) == [t[0], t[2]] and h.unique_runs(t, [span("three\nfour five\nGröße " + common)], True) == [t[0]]
    assert h.unique_runs(t, [(0, len(raw), 5, 1)], True) == t


def test_removal_against_brute_force(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(n))
    shared = [line(rng.randint(9, 30)) for _ in range(12)]
    pages = []
    for k in range(60):
        texts = [line(rng.randint(5, 60)) for _ in range(rng.randint(1, 3))]
        for s in rng.sample(shared, rng.randint(0, 4)):
            texts.insert(rng.randint(0, len(texts)), rng.choice([s, s, s[: len(s) * 2 // 3] + line(6), line(3) + s, s + " " + s]))
        tag = "article" if k % 5 else "div"
        pages.append((k, f"http://{'ab'[k % 3 == 0]}.example/{k}", f"<{tag}>" + "".join(f"<p>{t}</p>" for t in texts) + f"</{tag}>", texts))
    pages.append((99, pages[1][1], pages[1][2], pages[1][3]))

    def plain(k, url, page, texts):
        host = [(q.startswith("<div"), "\n".join(t).encode()) for _, u, q, t in pages if u.split("/")[2] == url.split("/")[2]]
        mine, least = "\n".join(texts).encode(), max(3, min(30, -(-len(host) // 5)))
        every, opened = [1] * (len(mine) + 1), [0] * (len(mine) + 1)
        for a in range(len(mine) - 49):
            w = mine[a : a + 50]
            n, o = sum(w in t for _, t in host), sum(w in t for is_open, t in host if is_open)
            for i in range(a, a + 50):
                every[i], opened[i] = max(every[i], n if n >= least else 1), max(opened[i], o if n >= least or o >= 2 else 0)
        copies = sorted(every)[len(every) // 4]
        kept, at = [], 0
        for t in texts:
            flags = [every[i] > copies or (page.startswith("<div") and opened[i] >= 2) for i in range(at, at + len(t))]
            if not all(flags):
                for run in re.finditer("1+", "".join(str(int(x)) for x in flags)):
                    if run.end() - run.start() < 50:
                        flags[run.start() : run.end()] = [False] * (run.end() - run.start())
            left, place = [], 0
            for w in t.split(" "):
                left += [w] if not all(flags[place : place + len(w)]) else []
                place += len(w) + 1
            at += len(t) + 1
            kept += [" ".join(left)] if left else []
        return "\n\n".join(kept or texts)

    want = {p[0]: plain(*p) for p in pages}
    df = spark.createDataFrame([(*p[:3], "x") for p in pages], "page_id long, url string, html string, host string")
    for most in (h.BROADCAST_BYTES, 0):
        got = {r.page_id: r.text for r in h.main_text(df, most).collect()}
        assert got == want
    assert sum("\n\n".join(p[3]) != want[p[0]] for p in pages) > 20


def test_host_boilerplate_and_odd_rows(spark):
    strip = "Welcome to our portal of daily reports, please read all of our terms before you go on"
    page = lambda k: f"<body><div>{strip}</div><div>Unique report number {k} says {'abcdefghij'[k] * 60}.</div><p>{strip} again</p></body>"
    rows = [(k, f"http://host-a.example/{k}", page(k)) for k in range(5)] + [(10, "http://host-b.example/x", page(0))]
    rows += [(20, "u", None), (21, None, ""), (22, "u", "just text & more"), (23, "u", "<p>unclosed <b"), (24, "u", "<nav>only menu</nav>")]
    rows += [(30, "http://c.example/1", "<div>" + "same copy of a page " * 9 + "</div>"), (31, "http://c.example/2", "<div>" + "same copy of a page " * 9 + "</div>")]
    rows += [(40, "http://d.example", "<p>" + "word " * 100_000 + "</p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:1]], "page_id long, url string, html string, text int")
    out = h.main_text(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) + 1
    for k in range(5):
        assert got[k] == f"Unique report number {k} says {'abcdefghij'[k] * 60}."
    assert got[10].count(strip) == 2 and got[20] == got[21] == got[24] == ""
    assert got[22] == "just text & more" and got[23] == "unclosed" and got[30] == got[31] != "" and len(got[40]) == 499_999
    assert h.main_text(df.limit(0)).count() == 0


def test_boilerplate_inside_articles(spark):
    line = "Subscribe to our letter and never miss one of our daily reports again"
    box = "About the author: this person has written for our pages for more than twenty years now"
    body = lambda k: f"Unique report number {k} says {'abcdefghij'[k] * 60}."
    copy = "The same story was printed by several of our pages, word for word, on one day. " * 4
    page = lambda *texts, tag="article": f"<nav>Menu</nav><{tag}>" + "".join(f"<p>{t}</p>" for t in texts) + f"</{tag}>"
    rows = [(k, f"http://a.example/{k}", page(line, body(k), box)) for k in range(6)]
    rows += [(10 + k, f"http://a.example/copy/{k}", page(line, copy, box)) for k in range(4)]
    rows += [(20, "http://b.example/", page(line, body(0), box)), (21, "http://a.example/open", f"<div>{line}</div><div>{body(7)}</div>")]
    rows += [(30 + k, f"http://c.example/{k}", page(copy, tag="main")) for k in range(5)]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(6)] == [body(k) for k in range(6)] and got[21] == body(7)
    assert {got[k] for k in range(10, 14)} == {got[k] for k in range(30, 35)} == {copy.strip()}
    assert got[20] == "\n\n".join([line, body(0), box])


def test_parts_are_bounded():
    rests = [["x" * 600_000], ["y" * 600_000], ["z" * 3_000_000], [], ["a", "b"]]
    batch = h.pa.RecordBatch.from_arrays([h.pa.array(range(5)), h.pa.array(range(5)), h.pa.array(rests)], ["row", "host", "blocks"])
    assert [p.column(0).to_pylist() for p in h._parts(iter([batch]))] == [[0], [1], [2], [3, 4]]
