"""Operator 5 on pages whose main text is known, as they are made of it."""

import random

import pytest

from lexforge.llm import html_text

ARTICLE = "<article><h1>T</h1><p>One two three.</p></article>"
WHOLE = [
    f'<div class="content right-sidebar">{ARTICLE}</div>',
    '<div id="page" class="sidebar-left"><main><h1>T</h1><p>One two three.</p></main></div>',
    f'<div class="post sidebar">{ARTICLE}</div>',
    f'<form id="aspnetForm"><div id="content">{ARTICLE}</div></form>',
    f'<form><div id="content">{ARTICLE[9:-10]}</div></form>',
    '<article><h1>T</h1><p title="hidden costs of the plan">One two three.</p></article>',
    '<article><h1>T</h1><div data-hidden="false"><p>One two three.</p></div></article>',
    '<article><h1>T</h1><section aria-label="A hidden history"><p>One two three.</p></section></article>',
    '<article><h1>T</h1><div data-id="menu"><p>One two three.</p></div></article>',
    '<main><article class="post comments-open"><h1>T</h1><p>One two three.</p></article></main>',
    "<article><header><h1>T</h1><p>One two three.</p></header></article>",
    '<article><h1>T</h1><p>One two three.</p><div class="promoted-offer"><p>buy</p></div></article>',
    f'<div class="sidebar"><article class="teaser"><p>no</p></article></div>{ARTICLE}<div class="comments"><article class="comment"><p>no</p></article></div>',
    f'<div class="sidebar"><article><p>no</p></article></div>{ARTICLE}',
    '<div class="sidebar"><p>no</p></div><div class="content"><h1>T</h1><p>One two three.</p></div>',
    f'<form><input><p>no</p></form>{ARTICLE}',
    '<article hidden><p>no</p></article><article><h1>T</h1><form><p>no</p></form><p style="display:none">no</p><p>One two three.</p></article>',
]


@pytest.mark.parametrize("page", WHOLE)
def test_layout(page):
    assert [t for z, t in html_text.blocks(f"<html><body>{page}</body></html>") if z in "mh"] == ["T", "One two three."]


def _sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))


def _page(rng, chrome, quote, title, plain):
    """(html, main text): an article in one of many layouts, or paragraphs that only repeats tell from the rest."""
    out, html = [], []

    def block(tag, text, attrs=""):
        out.append(text)
        html.append(f"<{tag}{attrs}>{text.replace('&', '&amp;')}</{tag}>")

    block("h1", title)
    if rng.random() < 0.5:
        block("blockquote", quote)
    for _ in range(rng.randint(3 if plain else 1, 5)):  # a page of which most repeats is a copy, and keeps it
        block(rng.choice(["p", "p", "div", "h2"]), _sentence(rng, rng.randint(20 if plain else 1, 30)) + rng.choice(["", " &", " é"]), rng.choice(["", ' title="hidden menu"', ' data-role="search"', ' class="lead"']))
        if rng.random() < 0.3 and not plain:
            html.append(rng.choice([f'<div class="ad">{chrome[0]}</div>', f"<nav><p>{chrome[1]}</p></nav>", "<script>x < y</script>", f"<aside>{chrome[2]}</aside>", f'<form action="/s"><label>{chrome[0]}</label></form>']))
    body = "".join(html)
    if plain:
        return f"<body><div>{chrome[0]}</div><div>{chrome[3]}</div>{body}<div>{chrome[4]}</div></body>", out
    body = rng.choice(["<article>{}</article>", '<main id="x">{}</main>', '<div class="wrap has-sidebar"><article class="post comments-open">{}</article></div>', '<form id="f"><div class="page"><article>{}</article></div></form>', '<div class="content sidebar-right"><main>{}</main></div>']).format(body)
    return f"<html><body><header><p>{chrome[1]}</p></header><nav><ul><li><a>{chrome[2]}</a></li></ul></nav>{body}<footer>{chrome[3]}</footer></body></html>", out


def test_pages_of_known_text(spark):
    rng = random.Random(9)
    pages, want = [], {}
    for host in range(6):
        chrome, quote, title = [_sentence(rng, n) for n in (9, 12, 2, 15, 20)], _sentence(rng, 25), _sentence(rng, 9)
        for k in range(12):
            html, text = _page(rng, chrome, quote, title if host % 2 else _sentence(rng, 9), plain=host >= 4)
            if host >= 4 and quote in text:  # without an article, what repeats goes
                text.remove(quote)
            if host == 5:
                text = [t for t in text if t != title]
            i = host * 100 + k
            pages.append((i, f"http://h{host}.example/{k}", html, "x", 1))
            want[i] = "\n".join(text)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int").repartition(4)).collect()}
    wrong = {i: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert not wrong, next(iter(wrong.items()))
    alone = sum(i >= 400 for i in want)  # pages that markup alone does not decide
    assert alone == 24 and all(len(html_text.blocks(p[2])) > len(want[p[0]].split("\n")) for p in pages if p[0] >= 400)


def test_odd_pages(spark):
    pages = [(1, None, "<p>" + "a b " * 400_000, None, None), (None, "x", None, None, None), (2, "x", "", None, None), (3, "x", "<<p <div class=>x</div", None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int")).collect()}
    assert got[1] == ("a b " * 400_000).strip() and got[None] == "" and got[2] == "" and len(got) == 4
