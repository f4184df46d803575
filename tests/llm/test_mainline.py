import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import mainline
from loomspark.llm.mainline import main_text

LONG = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("<!-- only", ""),
        ("plain text", "plain text"),
        ("<p>un<p>closed <b>x<p>y", "un closed x y"),
        ("<main><p>a<b>b</b>c &amp;lt; &nbsp;\n d</p><p>e<br>f</p></main>", "abc &lt; d e f"),
        ("<article><p>One.</p><p>Two</article><aside>no</aside>", "One. Two"),
        ("<article>short</article><article>the longer one</article>", "short the longer one"),
        (f"<article>{LONG}</article><div>x</div><article>{LONG} b</article>", f"{LONG} {LONG} b"),
        (f"<main>x</main><div>{LONG}</div>", LONG),
        (f"<article><p>a</p><p>b</p><ul class=related><li>1<li>2<li>3<li>4</ul><p>c</p></article><p>stray</p>", "a b c"),
        (f"<div id=page class='layout has-sidebar'><h1>T</h1><p>{LONG}</div>", f"T {LONG}"),
        (f"<div class='discussion-topic'><p>{LONG}</div><div class='legal-guide'>{LONG} 2</div>", f"{LONG} {LONG} 2"),
        (f"<div class='sidebar'><div class=menu>m</div><h1>T</h1><p>{LONG}</div>", f"T {LONG}"),
        (f"<form action=x><nav>n</nav><article>{LONG}</article><footer>f</footer></form>", LONG),
        (f"<p>{LONG}</p><div class='commentList'><h3>Say</h3><p>{LONG} {LONG} {LONG}</p></div>", LONG),
        ("one <p title=it's>two</p> three <b title=\"a > 'b\">isn't</b> four", "one two three isn't four"),
        ("<p title=\"never closed>lost? </p><p>kept", "lost? kept"),
        ("<nav><a href=/x>menu</a></nav><article><h1>T</h1>x</article><footer>f</footer>", "T x"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style><form>f</form>b<div class='ad'>ad</div><p hidden>h</p><p>c</p></article>", "a b c"),
        ("<article><p>text</p><section id='comments'><article class='comment'>reader</article></section></article>", "text"),
        ("<article><div class='shadow heading'>kept</div></article>", "kept"),
        ("<article><p>cut <b>of", "cut of"),
        (f"<div id=menu><a href=x>A</a> <a href=y>B</a></div><div class=content><h1>Title</h1><p>{LONG}</p><p>Short.</p></div><div class=sidebar>side</div><div class='cookie-notice'>c</div>", f"Title {LONG} Short."),
        (f"<div><a href=a>link one</a></div><div><a href=b>link two</a></div><div>{LONG} <a href=c>in text</a></div><div><a href=d>more</a></div>", f"{LONG} in text"),
        ("<article><h1>" + "x" * 200000 + "</h1></article>", "x" * 200000),
        ("<div class='site-header'>site</div><article><div class='post-header'><h1>T</h1></div>x</article><div id=feedback>say</div>", "T x"),
        ("<script>1<2</script>z", "z"),
        ("a &notanentity; &#65; &#x42; < b", "a ¬anentity; A B < b"),
    ],
)
def test_pages(page, expected):
    assert main_text(page) == expected


def test_surges_and_dives():
    kept = mainline.surges([5, 0, 0, 0, 90, 3, 0, 2, 0, 0, 0, 2], 3, 86)
    assert kept == [2, 3, 4, 5, 6, 7]
    assert mainline.surges([0, 0], 3, 86) == [] and mainline.surges([], 3, 86) == []
    assert mainline.surges([1], 3, 86) == [0]
    # A far lower hill is kept beside a high one, but not beside a marked article.
    assert mainline.surges([900, 0, 0, 0, 100], 3, 86) == [0, 2, 3, 4]
    assert mainline.surges([900, 0, 0, 0, 100], 3, 86, [True] + [False] * 4) == [0]
    assert mainline.surges([900, 0, 0, 0, 200], 3, 86, [True] + [False] * 4) == [0, 2, 3, 4]


def plain_surges(lengths, window, threshold):
    """By windows written out, each line asked for itself."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    least = min(threshold, max(sums, default=0))
    kept = []
    for i in range(n):
        if not sums[i]:
            continue
        left = next((j for j in range(i, -1, -1) if not sums[j]), -1)
        right = next((j for j in range(i, n) if not sums[j]), n)
        if any(s >= least for s in sums[left + 1 : right]):
            kept.append(i)
    return kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 300)), max_size=40), st.integers(1, 4))
def test_any_distribution(lengths, window):
    assert mainline.surges(lengths, window, 86) == plain_surges(lengths, window, 86)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["div", "nav", "p"]), st.integers(1, 120)), max_size=25))
def test_pages_without_a_marked_article(blocks):
    """The distribution alone chooses: text of a page of plain blocks, against windows written out."""
    page = "".join(f"<{tag}>{'x' * n}</{tag}>" for tag, n in blocks)
    lengths = [0 if tag == "nav" else n for tag, n in blocks]
    kept = set(plain_surges(lengths, mainline.WINDOW, mainline.THRESHOLD))
    paragraphs = [i for i, (tag, _) in enumerate(blocks) if tag == "p"]
    if sum(lengths[i] for i in paragraphs if i in kept) >= mainline.THRESHOLD:
        kept.update(paragraphs)
    assert main_text(page) == " ".join("x" * lengths[i] for i in sorted(kept) if lengths[i])


@pytest.mark.parametrize("rest", [2, 20, 200])
def test_the_length_of_the_rest_does_not_matter(rest):
    """A paragraph that adverts part from a long article."""
    advert = "<div class=ad><a href=x>buy</a></div>"
    for wrap in ("{}", "<div class=content>{}</div>"):
        body = f"<p>{LONG}</p>" * rest + advert * 4 + f"<p>{LONG} end</p>" + advert * 3 + "<p>Closing line.</p>"
        assert main_text(wrap.format(body)) == " ".join([LONG] * rest + [f"{LONG} end", "Closing line."])


def test_link_lines_and_formulas_in_an_article():
    page = f"<div><p>{LONG}</p><p><a href=s>First linked source of this story</a></p><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></div>"
    assert main_text(page) == f"{LONG} First linked source of this story {LONG} So x=2 holds."
    menu = "".join(f"<p><a href=s>item {i}</a></p>" for i in range(4))
    assert main_text(f"<div>{menu}<p>{LONG}</p>{menu}</div>") == LONG


def test_unclosed_raw_elements():
    assert main_text(f"<p>{LONG}</p><script>var x = '<p>no</p>'") == LONG
    assert main_text(f"<p>{LONG}</p><style>p {{}}</style") == LONG
    start = time.perf_counter()
    assert main_text(f"<p>{LONG}</p><script>" + "</script " * 100_000) == LONG
    assert time.perf_counter() - start < 1


@pytest.mark.parametrize("unit", ["<div>", "<div></p>", "<b>", "<p><i><b></i>", "<li>", "<a href='", "<ul><li>", "<div class=x>text", "<p =\"", "<table><td>"])
def test_linear_in_the_page(unit):
    took = []
    for n in (5_000, 40_000):
        start = time.perf_counter()
        main_text(unit * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * max(took[0], 0.02)


def test_rows_against_the_template(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    pages = spark.read.parquet(path)
    for row in pages.select("html").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", row.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?p|h1|/h1|br)>", " ", article))
        assert main_text(row.html) == " ".join(html.unescape(plain).split())
    odd = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>é")], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted(map(tuple, mainline.extract(odd).collect()), key=repr) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "é", 1)], key=repr)
    assert mainline.extract(odd.limit(0)).count() == 0
