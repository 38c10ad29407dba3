"""Extraction on layouts that the given pages lack."""

from __future__ import annotations

import pytest

from docweft.llm import extraction

LONG = "Words of a paragraph that tells of something at some length, as articles do, and so it goes on to its end."
CASES = [
    ("<main><h1>Great title</h1><p>By <a href='/j'>Jane Doe</a> today and here</p><p>One two three four.</p></main>", "Great title\nBy Jane Doe today and here\nOne two three four."),
    (f"<article><p>{LONG}</p><p>See the <a href='/s'>source</a> and more.</p></article>", f"{LONG}\nSee the source and more."),
    ("<article><p>Text of some words here</p><ul><li><a href='/a'>Alpha</a></li><li><a href='/b'>Beta</a></li></ul></article>", "Text of some words here\nAlpha\nBeta"),
    (f"<body><div>Home</div><div>About</div><div>News</div><div>Contact</div><h1>Title of page</h1><p>{LONG}</p><p>See <a href=1>one</a> and <a href=2>two</a> for more.</p><p>{LONG}</p><p>All rights reserved by the owner</p></body>", f"Title of page\n{LONG}\nSee one and two for more.\n{LONG}"),
    (f'<body><form id="aspnetForm"><input name=a><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article></form></body>', f"Title\n{LONG}\n{LONG}"),
    (f'<body><form id="form1"><h1>Title of page</h1><p>{LONG}</p><p>{LONG}</p></form></body>', f"Title of page\n{LONG}\n{LONG}"),
    ("<main><h1>T</h1><p>One two three.</p><form><label>Name</label><input><p>Send it</p></form></main>", "T\nOne two three."),
    ('<article><h1>T</h1><p>One two.</p><div class="ad-300x250">Buy it</div><div class="sponsored-content-unit-v2">Buy more</div><div class="disqus_thread">Nice one</div></article>', "T\nOne two."),
    (f'<body><h1>Title of page</h1><p>{LONG}</p><p>{LONG}</p><div class="user-feedback">I liked it very much, thank you for all of it.</div></body>', f"Title of page\n{LONG}\n{LONG}"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return extraction.train(spark)


@pytest.mark.parametrize("page, want", CASES)
def test_layout(nodes, page, want):
    assert extraction.main_text(page, nodes) == want


def test_pages_kept_apart(nodes):
    """Precision and recall on layout pages that the tree wasn't trained on, with and without main or article."""
    pages = extraction.labelled_pages(400, seed=77)
    for bare in (False, True):
        right = kept = content = 0
        for page in pages:
            for block, x in zip(page, extraction.features([b[:3] for b in page])):
                if ("-" in block[2]) == bare:
                    said = extraction.predict(nodes, x)
                    right, kept, content = right + (said and block[3]), kept + said, content + block[3]
        assert right / kept > (0.9 if bare else 0.995) and right / content > (0.97 if bare else 0.995)


def test_more_than_flags_decides(nodes):
    """Blocks of the same flags are told apart by words and links, their own and their neighbours'."""
    used = {extraction.FEATURES[n[0]] for n in nodes if len(n) > 1}
    assert {"words", "link_density"} <= used and used & {"words_before", "words_after"} and used & {"link_density_before", "link_density_after"}


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "u", CASES[0][0])] * 3, "page_id long, url string, html string")
    assert [r["text"] for r in extraction.extract(rows).collect()] == [CASES[0][1]] * 3
