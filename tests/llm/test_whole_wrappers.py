"""Main text where layouts name their boxes like asides, and where pages of a host differ."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.llm import wrappers

BOXES = ['<div class="layout has-sidebar">{}</div>', '<div id="navigation-page" role="main">{}</div>', '<form action="/x">{}</form>', '<form><div class="widget">{}</div></form>']


def texts(spark, pages):
    df = spark.createDataFrame([(i, "https://a.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrappers.extract_pages(df).collect()}


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("inner", ["article", 'div class="content"'])
def test_boxes_around_the_article_are_no_asides(spark, box, inner):
    body = '<nav>menu</nav><{0}><h1>Head {1}</h1><p>A long text of page {1} goes on and on here, as articles do, for two lines.</p></{2}><div class="sidebar">side</div><div id="comments"><p>so true</p></div>'
    found = texts(spark, ["<html><body>" + box.format(body.format(inner, i, inner.split()[0])) + "<footer>foot</footer></body></html>" for i in range(6)])
    assert found == {i: f"Head {i}\nA long text of page {i} goes on and on here, as articles do, for two lines." for i in range(6)}


def test_comments_longer_than_the_article_stay_out(spark):
    comments = '<div id="comments">' + '<article class="comment"><p>a reader says very much about it</p></article>' * 30 + "</div>"
    found = texts(spark, [f"<body><article class='post'><p>Short text {i}.</p></article>{comments}</body>" for i in range(4)])
    assert found == {i: f"Short text {i}." for i in range(4)}


@pytest.mark.parametrize("usual, other", [("post", "post featured"), ("post", "full")])
def test_article_of_a_page_under_another_sign_than_its_host(spark, usual, other):
    page = "<body><nav>menu</nav>{}<footer>foot</footer></body>"
    article = '<article class="{}"><h1>Head {}</h1>{}</article>'
    long = "<p>A long text that goes on and on.</p>"
    pages = [page.format(article.format(usual, i, long * 5)) for i in range(8)]
    pages.append(page.format(article.format(other, 8, long * 5) + f'<article class="{usual}"><p>A teaser.</p></article>'))
    found = texts(spark, pages)
    assert found == {i: "\n".join([f"Head {i}", *["A long text that goes on and on."] * 5]) for i in range(9)}


def test_teasers_of_many_pages_do_not_hide_the_article(spark):
    teasers = '<article class="card"><p>A teaser of another text here.</p></article>' * 8
    pages = [f'<body><article class="full"><h1>Head {i}</h1><p>{"Words of it all. " * 12}</p></article>{teasers}</body>' for i in range(6)]
    assert texts(spark, pages) == {i: f"Head {i}\n" + " ".join(["Words of it all."] * 12) for i in range(6)}


def test_batches_of_empty_pages_do_not_give_up_the_host(spark):
    pages = [(i, "https://a.example/x", f"<body><article><p>Text {i}.</p></article></body>" if i < 3 else "") for i in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6, F.col("page_id"))
    one = wrappers.infer_wrappers(df.coalesce(1)).first().wrapper
    parts = [wrappers.infer_wrappers(df.where(f"page_id = {i}")).first().wrapper for i in range(6)]
    assert json.loads(wrappers.combine(parts)) == json.loads(one) != []
    assert json.loads(wrappers.combine(parts[3:])) is None


WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def plain_page(i, box="div"):
    """A page whose boxes have no telling names: a list of links, running text with a phrase that all pages share, and a last line."""
    menu = "".join(f"<{box}><a href=/{j}>{WORDS[(i + j) % 12]}</a></{box}>" for j in range(3 + i % 3))
    text = "".join(f"<p>Paragraph {j} of text {WORDS[i % 12]} and number {i} says something.</p>" for j in range(2 + i % 4))
    return f"<body><{box}>{menu}</{box}><{box}><h1>Head {i}</h1><p>Tell your friends</p><{box}>{text}</{box}></{box}><{box}>All rights reserved</{box}></body>"


def plain_text(i):
    return "\n".join([f"Paragraph {j} of text {WORDS[i % 12]} and number {i} says something." for j in range(2 + i % 4)])


def test_the_expression_tells_template_from_text(spark, monkeypatch):
    """No box has a telling name: places in the expression say what is menu, template and text; without it they stay in."""
    found = texts(spark, [plain_page(i) for i in range(24)])
    assert found == {i: plain_text(i) for i in range(24)}
    monkeypatch.setattr(wrappers.Wrapper, "places", lambda *_: None)
    without = wrappers.Extractor(wrappers.pack(None), [])
    assert all(without.extract(plain_page(i))[0] != found[i] for i in range(24))


def test_records_are_no_region(spark):
    record = "<section><h3>Reader {0}</h3><p>I have read number {0} of this and have a great deal to say about it all.</p></section>"
    pages = [f"<body><div><h1>Head {i}</h1><p>The text of page {i} in one line.</p></div><div>" + "".join(record.format(100 * i + j) for j in range(2 + i % 5)) + "</div></body>" for i in range(12)]
    assert texts(spark, pages) == {i: f"Head {i}\nThe text of page {i} in one line." for i in range(12)}


def test_copies_of_one_page_keep_their_text(spark):
    page = "<body><nav>menu</nav><article><h1>Head</h1><p>The same text on all.</p></article></body>"
    assert texts(spark, [page] * 40) == dict.fromkeys(range(40), "Head\nThe same text on all.")


def test_pages_of_very_many_signs_and_very_long_ones(spark):
    signs = "".join(f"<b class=c{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760 % 26)}>x</b>" for i in range(30_000))
    long = "<p>" + "word " * 200_000 + "</p>"
    found = texts(spark, [f"<body><article><p>{signs}</p></article></body>", f"<body><article>{long}</article></body>"])
    assert found == {0: "x" * 30_000, 1: " ".join(["word"] * 200_000)}
    assert wrappers.code_point(0xD800 - 0x100) == chr(0xE000) and wrappers.code_point(wrappers.CODES - 0x101) <= chr(0x10FFFF)


def test_long_units_and_long_runs():
    unit = [f"a{i}" for i in range(60)]
    assert wrappers.fold(["x", *unit * 3, "y"]) == ("x", ("+", tuple(unit)), "y")
    x = tuple(f"b{i}" for i in range(900))
    y = tuple(f"b{i}" if i % 7 else f"c{i}" for i in range(900))
    w = wrappers.align(x, y)
    assert [e for e in w if isinstance(e, str)] == [e for i, e in enumerate(x) if i % 7]


def test_places_name_every_token():
    known = wrappers.unified({wrappers.fold("t p # /p p # /p u".split()), wrappers.fold("t p # /p li p # /p p # /p /li li p # /p /li u".split())})
    w = wrappers.Wrapper(wrappers.pack(known))

    class Shape:
        signs = "t p # /p li p # /p p # /p /li u".split()

    places = w.places(Shape)
    assert [w.signs[p] for p in places] == Shape.signs and places[2] != places[6] == places[9]


def recipe(i: int) -> tuple[str, str]:
    """A page and its main text: headings that recur on every page, a warning and an editor's note, an advert and reader comments."""
    said = "".join(f'<div class="comment"><b>Reader {i * 7 + j}</b><p>Tasty, number {j} of {i}, thanks!</p></div>' for j in range(i % 3 + 1))
    note = f'<div class="comment"><p>The editor tried version {i} twice.</p></div>'
    html = (
        f'<html><body><nav><a href="/">Home</a><a href="/all">All recipes</a></nav><article><h1>Dish {i} with leek</h1><p class="alert">Warning: oven at {150 + i} degrees.</p>'
        f"<p>Take {i} leeks, cut them into rings and fry them slowly in plenty of butter.</p><h2>Ingredients</h2><p>{i} leeks, {i + 1} eggs and some salt</p>{note}"
        f'<div class="advert">Buy our pans now</div><h2>References</h2><p>Book {i}, page {i + 3}, the usual kitchen.</p><section class="comments">{said}</section></article><footer>Imprint</footer></body></html>'
    )
    text = [f"Dish {i} with leek", f"Warning: oven at {150 + i} degrees.", f"Take {i} leeks, cut them into rings and fry them slowly in plenty of butter.", "Ingredients", f"{i} leeks, {i + 1} eggs and some salt"]
    return html, "\n".join([*text, f"The editor tried version {i} twice.", "References", f"Book {i}, page {i + 3}, the usual kitchen."])


@pytest.mark.parametrize("count", [2, 7, 8, 200])
def test_recurring_headings_and_named_paragraphs_of_the_article_stay(spark, count):
    made = [recipe(i) for i in range(2, count + 2)]
    pages = spark.createDataFrame([(i, "https://kitchen.example/a", html) for i, (html, _) in enumerate(made)], "page_id long, url string, html string").repartition(min(count, 9))
    found = {r.page_id: (r.text, r.matched) for r in wrappers.extract_pages(pages).collect()}
    assert {i: t for i, (t, _) in found.items()} == {i: text for i, (_, text) in enumerate(made)}
    assert all(m for _, m in found.values())


def test_equal_wrappers_of_a_host_are_one_row_and_wrappers_may_be_joined(spark, monkeypatch):
    made = [recipe(i) for i in range(2, 42)]
    pages = spark.createDataFrame([(i, f"https://kitchen.example/{i}" if i % 4 else None, html) for i, (html, _) in enumerate(made)], "page_id long, url string, html string").repartition(40)
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)  # salted join
    found = {r.page_id: r.text for r in wrappers.extract_pages(pages).collect()}
    assert found == {i: text for i, (_, text) in enumerate(made)}
    assert wrappers.infer_wrappers(pages).count() == 2
