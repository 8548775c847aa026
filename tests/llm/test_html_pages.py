"""Pages that earlier versions of the extraction got wrong."""

import time

import pytest

from wordloom.llm.html_text import main_text

LONG = "Some readers, as ever, had much to say; and they said it at length, twice. " * 12

PAGES = {
    "a comment that is an article element and longer than the article": (
        f'<body><article><h1>Title</h1><p>A short article, with a point.</p></article><div id="talk"><article class="comment"><p>{LONG}</p></article><article class="comment depth-1"><p>{LONG}</p></article></div></body>',
        "Title A short article, with a point.",
    ),
    "a comment inside the article element": (
        f'<article><p>A short article, with a point.</p><article class="comment-body"><p>{LONG}</p></article></article>',
        "A short article, with a point.",
    ),
    "an article whose class names comments among others": (
        '<article class="post has-comments open-sidebar"><p>The text, of course, stays.</p></article>',
        "The text, of course, stays.",
    ),
    "a quote inside an unquoted value": (
        '<div><p title=5">First paragraph, with words.</p><p title=6">Second one, with more words.</p></div>',
        "First paragraph, with words. Second one, with more words.",
    ),
    "quotes that hold the end of a tag": (
        """<div><p title="a > b" class='x > y'>First paragraph, with words.</p><p data-x = "1>2">Second.</p></div>""",
        "First paragraph, with words. Second.",
    ),
    "formulas and labels within a paragraph": (
        "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>, so <svg><title>no</title><text>y</text></svg> follows.</p></article>",
        "Let x=1, so y follows.",
    ),
    "a discussion that is a part of the article": (
        '<article><p>Methods, in short.</p><section class="discussion"><p>We discuss, at some length, the results.</p></section></article>',
        "Methods, in short. We discuss, at some length, the results.",
    ),
    "a name with an ambiguous and another word": (
        '<body><div class="related-studies"><p>Earlier work, by many authors, found the same.</p><p>Later work, by few, did not.</p></div><div class="related-posts"><a href=1>Ten things</a></div></body>',
        "Earlier work, by many authors, found the same. Later work, by few, did not.",
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, expected = PAGES[name]
    assert main_text(page) == expected


def test_tags_without_end_cost_no_more_than_others():
    began = time.perf_counter()
    main_text("<a " + '=""' * 20_000)
    main_text("<p x=" + "'" * 1 + "a=" * 20_000 + "<b>")
    assert time.perf_counter() - began < 5
