import html
import itertools
import random
import re

import pandas as pd

from groundplan.llm.html_text import all_lines, common_lines, extract_text, lines_of, main_text, op3_html_extraction

from .helpers import SF, real


def article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def test_query_equals_a_plain_version(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in op3_html_extraction(spark, SF).collect()}
    pages = real("pages")
    assert len(got) == len(pages)
    for p in pages.itertuples():
        text = article(p.html)
        assert got[p.page_id] == (p.url, text, len(text))


def test_structure_alone_finds_the_texts_of_the_given_pages():
    """Without names of tags and classes, and without the article mark: differencing of structure decides. All pages that have a neighbour are exact here."""
    address = lambda url: re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url).groups()
    pages = sorted((address(p.url)[0].lower(), address(p.url)[1], p.page_id, p.html) for p in pd.read_parquet(f"{SF}/../sf0.01/pages.parquet").itertuples())
    lines = [all_lines(p[3], names=False) for p in pages]
    exact = alone = 0
    for k, p in enumerate(pages):
        beside = [lines[j] for j in (k - 1, k + 1) if 0 <= j < len(pages) and pages[j][0] == p[0]]
        alone += not beside
        exact += bool(beside) and main_text(lines[k], beside) == article(p[3])
    assert exact == len(pages) - alone and alone < 10


def test_frames_whose_text_and_names_say_nothing(spark):
    """Containers that stand in the same place on both neighbours, beside the one with most unshared text, are frame."""
    words = lambda k, n: " ".join(f"w{(k * 7919 + j * j) % 997}" for j in range(n))
    page = "<body><div class='x1'><p>{}</p></div><div class='x2'><h1>{}</h1><p>{}</p><ul><li>{}</li></ul></div><div class='x3'><span>{}</span></div>{}</body>"
    rows = [(k, f"http://h.com/{k}", page.format(words(k, 5), words(k + 50, 3), words(k + 100, 60), words(k + 150, 9), words(k + 200, 8), f"<div class='once'><p>{words(7, 9)}</p></div>" if k == 3 else "")) for k in range(6)]
    want = {k: "\n\n".join([words(k + 50, 3), words(k + 100, 60), words(k + 150, 9), *([words(7, 9)] if k == 3 else [])]) for k in range(6)}
    two = "<body><div class='a'><p>{}</p></div><div class='b'><p>{}</p></div></body>"  # both parts are text
    rows += [(10 + k, f"http://t.com/{k}", two.format(words(k + 300, 40), words(k + 400, 28))) for k in range(4)]
    want |= {10 + k: f"{words(k + 300, 40)}\n\n{words(k + 400, 28)}" for k in range(4)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1 << 20, 500):
        assert {r.page_id: r.text for r in extract_text(df.repartition(3), size).collect()} == want


def test_names_of_comments_and_notices_within_the_article():
    kept = lambda inner: [text for text, _ in lines_of(f"<article><p>Text</p>{inner}<p>End</p></article>")]
    for name in ("class='user-comment'", "class='comment-thread'", "class='post-comments'", "id='disqus_thread'", "class='share-buttons'", "class='cookie-notice-text'", "class='advertisement-label'", "role='complementary'", "class='topbar'"):
        assert kept(f"<div {name}><p>Own</p>more</div>") == ["Text", "End"], name
        frame = [x.text for x in all_lines(f"<article><p>Text</p><div {name}><p>Own</p>more<script>no</script></div></article>") if x.named]
        assert frame == ["Own", "more"]
    assert kept("<label>Name</label>") == ["Text", "End"] and kept("<div class='post-text'>Own</div>") == ["Text", "Own", "End"]


def test_frames_and_edges(spark):
    frame = "<html><head><title>t</title></head><body><div>Top line</div>{}<div>Bottom line</div></body>"
    rows = [
        (1, "http://a.com/x/1", frame.format("<p>One &amp;\n two<br>three</p><div class='ad'>Buy <div>now</div></div><!-- c --><p>Long enough to be the text</p>")),
        (2, "http://a.com/x/2", frame.format("<p>Other text here, also quite long</p><aside>side</aside><form>f</form><section id='comments'><p>c</p></section>")),
        (3, "http://b.com/", "<header>h</header><main><header><h1>T</h1></header>x<script>var a='</p>'</script> y<ul><li>i</ul></main><footer>f"),
        (4, None, None),
        (5, "http://c.com", ""),
        (6, "http://a.com/y", frame.format("<p>Copy</p>")),
        (7, "http://a.com/y", frame.format("<p>Copy</p>")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as path", "3 as text")
    for size in (1 << 20, 300, 1):
        got = {r.page_id: r.text for r in extract_text(df.repartition(3), size).collect()}
        assert got == {1: "One & two three\n\nLong enough to be the text", 2: "Other text here, also quite long", 3: "T\n\nx y\n\ni", 4: "", 5: "", 6: "Top line\n\nCopy\n\nBottom line", 7: "Top line\n\nCopy\n\nBottom line"}, size
    assert extract_text(df.limit(0)).count() == 0


def test_common_lines_are_longest():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        got = common_lines(a, b)
        assert all(len(common_lines(a, b, most)) == len(got) for most in (0, 4, 12))
        best = max(n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if all(x in it for it in [iter(b)] for x in c))
        it = iter(b)
        assert len(got) == best and all(a[i] in it for i in sorted(got))


def test_dropped_elements_without_end_tags():
    kept = lambda body: [text for text, _ in lines_of(f"<body><article>{body}</article><p>End</p></body>")]
    assert kept("<p class='notice'>x<p>Real</p><p>More") == ["Real", "More", "End"]
    assert kept("<p class='notice'>x <b>y</b><br/>z<div>Real</div>") == ["Real", "End"]
    assert kept("<p class='notice'>x<hr/>Real") == ["Real", "End"]
    assert kept("<p class='notice'>x") == ["End"]
    assert kept("<ul><li class='ad'>x<ul><li>y<li>z</ul>w<li>Real</ul>More") == ["Real", "More", "End"]
    assert kept("<ul><li class='ad'><div>x</li></ul>Real") == ["Real", "End"]
    assert kept("<ul><li class='ad'>x</ul>Real") == ["Real", "End"]
    assert kept("<dl><dt>T<dd class='ad'>x<dt>U<dd>Real</dl>") == ["T", "U", "Real", "End"]
    assert kept("<table><tr><td class='ad'>x<table><tr><td>y</table>z<td>Real<tr><td class='ad'>x<tr><td>More</table>") == ["Real", "More", "End"]
    assert kept("<div class='ad'>x<p>y</div>Real") == ["Real", "End"]


def test_names_within_the_article():
    kept = lambda name: [text for text, _ in lines_of(f"<article><p>Text</p><section id='{name}'><p>Own</p></section></article>")]
    assert kept("related-work") == kept("social-history") == ["Text", "Own"]
    assert kept("related") == kept("social-share") == kept("wide ad") == ["Text"]
    assert kept("ad-slot") == kept("comment-list") == ["Text"] and kept("share-prices") == ["Text", "Own"]


def test_odd_pages():
    lines = lambda html: [text for text, _ in lines_of(html)]
    assert lines("<head><title>t</title><meta charset=x><body><p>Real") == ["Real"]
    assert lines("<main><p>Text</p><article class='comment'><p>Nice!</p></article></main>") == ["Text"]
    assert lines("<article class='post'><p>Text</article>") == ["Text"]


def test_short_text_in_a_large_frame_and_teasers(spark):
    frame = "<body><div>{}</div>{}<div>{}</div></body>"
    menu, foot = "Menu of many words " * 20, "Legal words at the end " * 20
    own = [f"<p>Short text number {i} of its own.</p>" for i in range(4)]
    rows = [(i, f"http://h.com/{i}", frame.format(menu, t, foot)) for i, t in enumerate(own)]
    body = "The rest of the text stands outside of the marked element, and there is much of it. " * 3
    rows += [(10 + i, f"http://t.com/{i}", f"<div>Frame line</div><article>Teaser {i}</article><p>{body}{i}</p>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1 << 20, 500):
        got = {r.page_id: r.text for r in extract_text(df, size).collect()}
        assert got == {i: f"Short text number {i} of its own." for i in range(4)} | {10 + i: f"Teaser {i}\n\n{body}{i}" for i in range(3)}


def test_repeated_rows_null_ids_and_long_pages(spark):
    long = "<article>" + "<p>A line of words.</p>" * 40_000 + "</article>"
    rows = [(1, "http://a.com/1", "<p>Own words of this page</p>")] * 2 + [(None, "http://a.com/0", "<p>x</p>"), (None, None, "<p>no address</p>"), (2, "http://a.com/2", long)]
    got = sorted((r.page_id or 0, r.n_chars) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), 1000).collect())
    assert got == [(0, 1), (0, 10), (1, 22), (1, 22), (2, 40_000 * 18 - 2)]
