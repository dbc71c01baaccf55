"""Text rules of pages, held against pages that are generated beside the text that they should give."""

import random
from html import escape

import pytest

from kinforge.llm import pages

KEPT = [
    '<h2 id="related-work">{}</h2>', '<section id="share-prices"><p>{}</p></section>', '<p title="the hidden valley">{}</p>', '<p data-note="is hidden here">{}</p>', '<p class="no-ads">{}</p>',
    '<p><span class="search-term">{}</span></p>', '<h3 id="toc">{}</h3>', '<div class="has-sidebar wide">{}</div>', "<p id=comments>{}</p>", '<div data-role="ad">{}</div>', '<ul class="menu-items"><li>{}</li></ul>',
    '<p style="color: red">{}</p>', '<p aria-hidden="false">{}</p>', '<header class="post-header">{}</header>', '<div data-hidden>{}</div>', '<p alt=\'say "hidden" aloud\'>{}</p>', '<blockquote id="reply">{}</blockquote>',
]
GONE = [
    "<p hidden>{}</p>", '<p style="display : none">{}</p>', '<div aria-hidden="true">{}</div>', '<div class="ad">{}</div>', '<div class="share-buttons">{}</div>', '<section id="comments"><p>{}</p></section>', '<ol class="comment-list"><li>{}</li></ol>',
    '<div class="x reader-comments">{}</div>', "<nav>{}</nav>", "<aside>{}</aside>", "<form>{}</form>", "<footer>{}</footer>", "<script>{}</script>", '<div role="navigation">{}</div>', '<div class="newsletter">{}</div>', '<div HIDDEN="">{}</div>', '<div class="related-posts">{}</div>',
]


@pytest.mark.parametrize("part", KEPT)
def test_text_of_the_article_stays(part):
    assert pages.main_text(f"<body><article><h1>Title</h1>{part.format('Some text')}<p>End</p></article></body>") == "Title\nSome text\nEnd"


@pytest.mark.parametrize("part", GONE)
def test_noise_in_the_article_goes(part):
    assert pages.main_text(f"<body><article><h1>Title</h1>{part.format('Some text')}<p>End</p></article></body>") == "Title\nEnd"


def page_of(rng):
    """A page and its main text: nested blocks, inline elements, character references, white space, noise."""
    lines: list[str] = []

    def words():
        return [rng.choice(["owl", "a<b", "R&D", "ünï", "“x”", "1 2"]) for _ in range(rng.randint(1, 4))]

    def inline():
        text = words()
        spaced = rng.choice([" ", "\n  ", "\t"]).join(escape(w, quote=False) for w in text)
        lines.append(" ".join(" ".join(text).split()))
        return rng.choice(["{}", "<b>{}</b>", "<a class='share-price' href='/x?a=1&amp;b=2'>{}</a>", "<em><i>{}</i></em>", " {} "]).format(spaced)

    def block(depth):
        kind = rng.random()
        if kind < 0.2 and depth:
            tag = rng.choice(["div", "section", "blockquote", "ul"])
            inner = [f"<li>{inline()}</li>" if tag == "ul" else block(depth - 1) for _ in range(rng.randint(1, 3))]
            return f"<{tag}>{''.join(inner)}</{tag}>"
        if kind < 0.4:
            return rng.choice(GONE).format(escape(" ".join(words()), quote=False))
        return rng.choice([k for k in KEPT if "section" not in k and "<ul" not in k]).format(inline())

    body = "".join(block(2) + rng.choice(["", "\n", "<!-- <p>no</p> -->"]) for _ in range(rng.randint(1, 6)))
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body class='no-sidebar'><nav>menu</nav><div class='ad'>buy</div><article>{body}</article><footer>foot</footer></body></html>"
    return page, "\n".join(lines)


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    page, text = page_of(random.Random(seed))
    assert pages.main_text(page) == text


def test_neutral_names_go_by_counts_and_nothing_else(spark):
    """Marked articles with notices whose names say nothing: what recurs as a container in most articles of the host goes."""
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(12):
        own = [" ".join(rng.choice("stone river owl night road".split()) for _ in range(8)) + f" {i}{k}" for k in range(3)]
        rows.append((i, "http://host.example/x", f"<body><article><h2 id='related-work'>{own[0]}</h2><div class='q1'><p>Read our terms</p></div><p class='no-ads'>{own[1]}</p><p>Shared line</p><div class='q2'>{own[2]}</div></article></body>"))
        want[i] = "\n".join([own[0], own[1], "Shared line", own[2]])
    found = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == want
