"""Main text of generated pages, compared exactly, and marked items, wrappers, table layouts, several articles."""
import html
import random

import pytest

from labelweave.llm.html_extract import main_text

LONG = "A sentence of some length that a reader would want to keep. " * 4
P = LONG.strip()


@pytest.mark.parametrize("item", [
    "<ul><li class=comment>no</li><li hidden>no</li></ul>", "<p class=advert>no", "<p class='ad'>no</p>", "<dl><dt class=promo>no<dd class=promo>no</dl>",
    "<ul><li class='comment'>no<li>yes</ul>", "<table><tr><td class=sidebar>no<td>yes</table>", "<p style='display: none'>no</p>",
    "<div role=navigation>no</div>", "<article class='comment'><p>no</p></article>"])
def test_marked_items_go(item):
    got = main_text(f"<article><h1>Head</h1><p>{P}{item}<p>{P}</article>")
    want = ["Head", P, *(["yes"] if "yes" in item else []), P]
    assert got == "\n\n".join(want)


@pytest.mark.parametrize("name", ["content no-sidebar", "has-comments", "page with-sidebar", "layout sidebar-left", "page header-large", "not-footer",
                                  "single without-banner", "Has-Sidebar main_content"])
@pytest.mark.parametrize("attr", ["class", "id"])
def test_wrappers_keep_the_article(name, attr):
    text = main_text(f"<body><div {attr}='{name}'><p>{P}</p><p>{P}</p></div><div class=footer>foot</div></body>")
    assert text == f"{P}\n\n{P}"


def test_article_inside_an_excluded_wrapper():
    assert main_text(f"<div class=sidebar><article><p>{P}</p></article><p>more</p></div>").startswith(P)
    assert main_text(f"<div class=comments><p>{P}</p></div><div><p>short</p></div>") == "short"        # comments are not a layout


def test_two_articles_are_both_kept():
    assert main_text(f"<body><nav><a>x</a></nav><article><p>{P}</p></article><article><p>short one</p></article></body>") == f"{P}\n\nshort one"


def test_cells_are_regions():
    page = (f"<table><tr><td><a href=1>one</a><br><a href=2>two</a><br><a href=3>three</a><td><p>{P}<p>{P}<td><a>x</a> <a>y</a> <a>z</a></table>")
    assert main_text(page) == f"{P}\n\n{P}"
    assert main_text(f"<article><p>{P}</p><table><tr><td>a<td>b<tr><td>c<td>d</table></article>") == f"{P}\n\na b\n\nc d"


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon & < > é 中 😀".split()


def page(rng):
    """A page and its main text."""
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    esc = lambda t: html.escape(t) if rng.random() < 0.7 else html.escape(t).replace("é", "&eacute;")
    links = lambda n: "".join(f"<li><a href='/{k}'>{esc(say(2))}</a>" for k in range(n))
    blocks, body = [], []
    for k in range(rng.randint(3, 9)):
        t = say(rng.randint(25, 60))
        blocks.append(t)
        kind = rng.randrange(5)
        inner = esc(t)
        if kind == 0:
            body.append(f"<p>{inner}")
        elif kind == 1:
            body.append(f"<p>{inner}</p>")
        elif kind == 2:
            first, rest = inner.split(" ", 1)
            body.append(f"<div class='text has-ads'><p><b>{first}</b>\n  {rest}</p></div>")
        elif kind == 3:
            body.append(f"<blockquote>{inner}</blockquote>")
        else:
            body.append(f"<ul><li>{inner}</ul>")
        if rng.random() < 0.5:
            body.append(rng.choice([
                "<div class=ad><p>Buy now</p></div>", "<aside><p>By the way</p></aside>", "<script>var x = '<p>no</p>';</script>",
                "<p class='advert'>Buy</p>", "<ul><li class='share'>Share</li></ul>", "<form><input><p>Your mail</p></form>",
                "<figure><img src=x></figure>", "<!-- <p>old</p> -->", "<div style='display:none'>secret</div>", "<style>p {}</style>"]))
    title = say(6)
    comments = "<section id=comments><h2>Comments</h2>" + "".join(f"<p>{esc(say(30))}</p>" for _ in range(rng.randint(0, 5))) + "</section>"
    article = f"<h1>{esc(title)}</h1>" + "".join(body)
    wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<article class='post has-sidebar'><header><p>by me</p></header>{}<footer>tags</footer></article>"])
    doc = (f"<!doctype html><html><head><title>{esc(say(3))}</title></head><body class='with-sidebar'><header><a>Home</a></header>"
           f"<nav><ul>{links(6)}</ul></nav><div class='{rng.choice(['page', 'wrap no-banner', 'sidebar-right'])}'>{wrap.format(article)}"
           f"{comments}<div class=sidebar><ul>{links(4)}</ul></div></div><footer><p>&copy; us</p></footer></body></html>")
    return doc, "\n\n".join([title, *blocks])


def test_generated_pages_exactly():
    rng = random.Random(12)
    for _ in range(400):
        doc, want = page(rng)
        assert main_text(doc) == want, doc


def test_broken_markup_ends():
    for broken in (None, "", "<p", "<li>" * 4000, "<td>" * 4000, "<table><tr>" * 2000, "</li></td>" * 500, "<p>a<li>b" * 2000, "<div><p><li><td>" * 1500):
        assert isinstance(main_text(broken), str)
