"""Main text of pages that wrap, name and hide things in unusual ways, each with the text that a reader would call the article."""

from __future__ import annotations

import time

import pytest

from refweave.llm.html import extract

LONG = "A long enough paragraph of the article, which says something, and goes on for a while so that it counts."
P = f"<p>{LONG}</p>"

KEPT = {
    "a form around the page": f'<body><form id="aspnetForm"><input type="hidden" name="x"><article>{P}{P}</article></form></body>',
    "a form around a container": f'<body><form id="main"><input type=hidden name=x><input name=q><div class=c>{P}{P}</div></form></body>',
    "a form inside the text": f"<body><div class=c>{P}<form><label>Mail</label><input><button>Go</button> Subscribe to our list</form>{P}</div></body>",
    "an own comment form": f"<body><article>{P}{P}<form><p>Leave a reply, your address is not shown.</p><label>Name</label><input><textarea></textarea></form></article></body>",
    "hidden things": f'<article>{P}<p hidden>Drop</p><p style="color:red; display: none">Drop</p><div aria-hidden="true">Drop</div>{P}</article>',
    "readers' comments by id": f'<article>{P}{P}<div id="comments"><p>I like this very much and say so.</p></div></article>',
    "a bar of links by id": f'<article>{P}<div id="share"><a href=x>One</a> <a href=y>Two</a></div>{P}</article>',
    "a newsletter box by id": f'<article>{P}<div id="newsletter">Our newsletter<form><input></form></div>{P}</article>',
    "a header of the site": f"<body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class=post>{P}{P}</div></body>",
    "a wrapper with the site's header": f"<body><div id=w><header><h1>Site</h1></header><h1>{LONG}</h1>{P}</div></body>",
}


@pytest.mark.parametrize("name", KEPT)
def test_only_the_article_stays(name):
    assert extract(KEPT[name]).split("\n") == [LONG, LONG]


@pytest.mark.parametrize(
    "element",
    [
        '<p title="the hidden gem">Keep me.</p>', '<p data-x="a hidden b">Keep me.</p>', '<p style="overflow: hidden ">Keep me.</p>', '<p alt="display:none">Keep me.</p>', '<p data-note="aria-hidden=true">Keep me.</p>', '<p id="share">Keep me.</p>',
        '<h2 id="comments">Keep me</h2>', '<h2 id="navigation">Keep me</h2>', f'<section id="social"><h2>Keep me</h2>{P}</section>', "<header><h2>Keep me</h2></header>",
    ],
)
def test_attributes_and_slugs_take_nothing_from_an_article(element):
    assert "Keep me" in extract(f"<body><nav>Menu</nav><article>{P}{element}{P}</article></body>")


def test_siblings_that_go_on_with_the_text():
    page = f"<body><div class=a>{P * 6}</div><div class=b><p>Keep me, a paragraph of the last part.</p></div><div class=c><a href=x>More</a></div></body>"
    assert extract(page).split("\n") == [LONG] * 6 + ["Keep me, a paragraph of the last part."]


def test_the_title_in_a_header_of_the_post():
    page = f"<body><header><h1>Site</h1></header><div class=post><header><h1>The title</h1></header>{P * 4}</div></body>"
    assert extract(page).split("\n") == ["The title"] + [LONG] * 4


@pytest.mark.parametrize("piece", ['<form id="share">', '<header><h1>x</h1>', '<section id="social">', '<p title="', "<div class=c><input>"])
def test_judging_is_linear_in_the_page(piece):
    began = time.time()
    extract("<article>" + piece * (400_000 // len(piece)) + P)
    assert time.time() - began < 5
