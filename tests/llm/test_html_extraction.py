import html
import re
import time

import pytest

from pagesift.llm.html_extraction import (
    blocks_of,
    decode,
    extract,
    main_text,
    train,
    training_pages,
)


@pytest.fixture(scope="module")
def field():
    return train(training_pages())


def page(body):
    return f"<html><head><title>no</title><style>p{{}}</style></head><body>{body}</body></html>"


ARTICLE = (
    "<h1>A title of the story</h1><p>The first paragraph &amp; what   it\n says, at some length.</p>"
    "<p>The second one has <b>bold</b> words and a <a href='/x'>link</a> in it, too.<br>It goes on."
    "<ul><li>An item of the list<li>Another item</ul>"
)
TEXT = (
    "A title of the story\nThe first paragraph & what it says, at some length.\nThe second one has bold "
    "words and a link in it, too. It goes on.\nAn item of the list\nAnother item"
)
AROUND = {
    "menu": "<nav><ul><li><a href=/>Home</a><li><a href=/b>Blog posts</a></ul></nav>",
    "header": "<header><p>The Daily Something</p></header>",
    "footer": "<footer>&copy; 2020 The Daily Something. All rights reserved.</footer>",
    "side": "<aside class=sidebar><h3>Most read</h3><ul><li><a href=/c>Some other story</a></ul></aside>",
    "notice": "<div class='cookie-notice'><p>We use cookies to make this site better for you.</p></div>",
    "advert": "<div class=ad>Buy the new thing now, it is cheaper than ever before.</div>",
    "form": "<form><label>Mail</label><input><button>Subscribe</button></form>",
    "comments": "<section id=comments><h3>Comments</h3><div class=comment><p>I do not agree with any of "
    "this, and I will tell you why at some length.</p></div></section>",
    "script": "<script>document.write('<p>not this</p>')</script><noscript>enable it</noscript>",
}


@pytest.mark.parametrize("kind", AROUND)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='entry-content'>{}</div>"])
def test_what_is_not_the_article_goes(field, kind, wrap):
    article = wrap.format(ARTICLE)
    assert main_text(field, page(AROUND[kind] + article)) == TEXT
    assert main_text(field, page(article + AROUND[kind])) == TEXT


def test_broken_and_empty_pages(field):
    assert main_text(field, None) == main_text(field, "") == main_text(field, "<html><body>") == ""
    cut = page(f"<nav>{AROUND['menu']}</nav><article>{ARTICLE}").replace("</body></html>", "<p cla")
    assert main_text(field, cut) == TEXT
    nested = "<div>" * 3000 + "<p>Some words that stand very deep in here, in a paragraph.</p>"
    assert "very deep" in blocks_of(nested)[0].text
    (block,) = blocks_of("<p>&lt;b&gt; &#233;&eacute; &nosuch; &am</p>")
    assert block.text == "<b> éé &nosuch; &am"


def test_held_out_pages(field):
    pages = training_pages(200, seed=12345)
    wrong = sum(x != y for blocks, truth in pages for x, y in zip(decode(field, blocks), truth))
    assert wrong <= 0.01 * sum(len(truth) for _, truth in pages)


def test_operator_and_clashing_columns(spark, field):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>"), "t"), (2, None, None, None), (None, "w", "", "t")]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string, text string")
    got = extract(df, field)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "w", "", 0)] * 2, key=str
    )
    assert extract(df.limit(0), field).collect() == []


def test_query_against_the_marked_articles(spark):
    """In these tables, the article element holds the article and nothing else."""
    from pagesift.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    expected = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"</?b>", "", x) for x in re.split(r"</?(?:p|h1)>", inner)]
        parts = [" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in parts]
        expected[r.page_id] = "\n".join(x for x in parts if x)
    assert {r.page_id: r.text for r in QUERIES["op2_html_extraction"](spark, folder).collect()} == expected


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>t</title><meta charset=utf-8><main>", "<head><title>t</title></title><article>",
        "<head><head><noscript><img src=/p></noscript><script>x</script><link rel=a><main>",
    ],
)
def test_head_without_an_end(field, start):
    assert main_text(field, start + ARTICLE) == TEXT
    assert [b.text for b in blocks_of("<head><title>t</title> \n words of the text<p>more")] == [
        "words of the text", "more",
    ]


@pytest.mark.parametrize("name", ["class", "id", "role"])
@pytest.mark.parametrize("length", [20, 200, 2000])
def test_marks_late_in_long_values(name, length):
    (block,) = blocks_of(f"<div {name}='{'x1 ' * length} comments'>words</div>")
    assert block.path.element.mark == "comment"


@pytest.mark.parametrize("piece", ["<div>", "<div>word ", "<span>", "<x-{n}>word <p>", "</b><i>", "<li><b>word"])
def test_deep_and_broken_markup_costs_the_same_per_tag(piece):
    def seconds(count):
        html = "".join(piece.replace("{n}", str(n)) for n in range(count))
        start = time.process_time()
        blocks_of(html)
        return time.process_time() - start

    assert seconds(40_000) < 20


def test_paths_equal_the_list_of_ancestors():
    html = "<main><div hidden class=sidebar><ul><li>a<li><b>b</b><x-y>c</ul></div><p class=post>d<div>e</main>"
    shown = [(b.text, b.path.leaf, b.path.inner, b.path.outer, b.path.depth, b.path.hidden) for b in blocks_of(html)]
    assert shown == [
        ("a", "li", "side", "content", 4, True),
        ("bc", "li", "side", "content", 4, True),
        ("d", "p", "content", "content", 2, False),
        ("e", "div", "content", "content", 2, False),
    ]
    assert blocks_of(html)[1].path.tags == {"main", "div", "ul", "li"}
