"""Pages with known text, and the choice of regions against plain loops."""

from __future__ import annotations

import random

import pytest

from flowkit.llm.pages import SURGE, WINDOW, main_text, split_lines

LONG = "A paragraph of the story that is long enough to surge above the threshold of the text distribution by itself."


def article(inner):
    return f"<html><body><article><p>{LONG}</p>{inner}<p>End.</p></article></body></html>"


FOREIGN = [
    '<div class="share">Share this</div>', '<div class="share-buttons">Tweet</div>', '<div class="sponsor">Buy</div>',
    '<div class="sponsored-content">Buy</div>', '<div class="related">More</div>', '<div id="related-stories">More</div>',
    '<div class="sidebar">Side</div>', '<div class="left-sidebar">Side</div>', '<div class="comment">Nice!</div>',
    '<div class="comment-body">Nice!</div>', '<section id="comments"><article>Nice!</article></section>',
    '<article class="comment">Nice!</article>', '<div class="adBox">Buy</div>', '<div class="ad-slot-3">Buy</div>',
    '<div class="cookie-notice">We use cookies</div>', '<nav>Home</nav>', '<form>Name <input></form>',
    '<aside>Side</aside>', '<footer>Foot</footer>', '<div class="newsletter-signup">Join</div>', '<div hidden>No</div>',
    '<script>x()</script>', '<style>p {}</style>', '<div role="navigation">Home</div>', '<ul class="post-replies"><li>Yes</li></ul>',
    '<div aria-hidden="true">No</div>',
]
OWN = [
    ("<p>Press the <label>Name</label> key</p>", "Press the Name key"),
    ('<p class="nav-history">Old maps</p>', "Old maps"), ('<div class="form-of-life">Moss</div>', "Moss"),
    ('<p class="has-sidebar">Text</p>', "Text"), ('<header class="entry-header"><h2>Title</h2></header>', "Title"),
    ('<p class="legal">Law text</p>', "Law text"), ('<div class="comment-history">Of comments</div>', "Of comments"),
    ("<ul><li><a href=x>First source</a></li></ul>", "First source"), ("<p>a &amp; b\n  c</p>", "a & b c"),
    ('<p class="share-of-voters">Half</p>', "Half"), ('<div class="ad-hoc">Made for it</div>', "Made for it"),
]


@pytest.mark.parametrize("inner", FOREIGN)
def test_foreign_blocks_inside_an_article_go(inner):
    assert main_text(article(inner)) == f"{LONG}\nEnd."


@pytest.mark.parametrize("inner,text", OWN)
def test_own_blocks_inside_an_article_stay(inner, text):
    assert main_text(article(inner)) == f"{LONG}\n{text}\nEnd."


def test_pages_without_article():
    assert main_text(f'<body><div class="legal-article"><p>{LONG}</p></div></body>') == LONG
    links = "<ul>" + "<li><a href=x>Somewhere else</a></li>" * 3 + "</ul>"
    assert main_text(f"<body><div><p>{LONG}</p>{links}<p>Short end.</p></div></body>") == f"{LONG}\nShort end."
    assert main_text(f"<body><div><p>{LONG}</p></div><div>{links}</div><div><p>Junk</p></div></body>") == LONG
    assert main_text(f'<body><article class="comment">Nice!</article><div><p>{LONG}</p></div></body>') == LONG


def brute(page):
    """Surge and dive by loops: a line belongs to the run of lines whose windows hold any weight."""
    lines, has_article = split_lines(page)
    texts = [line.text() for line in lines]
    weight = [0 if line.quiet or (has_article and not line.inside) or (not has_article and line.linked * 2 > len(t))
              else len(t) for line, t in zip(lines, texts)]
    heavy = [k for k, w in enumerate(weight) if w]
    runs = []
    for k in heavy:
        if runs and k - runs[-1][-1] <= WINDOW:
            runs[-1].append(k)
        else:
            runs.append([k])
    if not has_article:
        full = [r for r in runs if any(sum(weight[k:k + WINDOW]) >= SURGE for k in range(max(0, r[0] - WINDOW + 1), r[-1] + 1))]
        held = {lines[k].parent for r in full for k in r}
        runs = [r for r in runs if r in full or any(lines[k].parent in held for k in r)] if full else runs
    return "\n".join(texts[k] for r in runs for k in r)


def test_regions_equal_plain_loops():
    rng = random.Random(2)
    pieces = [f"<p>{LONG}</p>", "<p>Short.</p>", "<li><a href=x>Link text</a></li>", "<div>", "</div>", "<nav>Menu</nav>",
              '<p class="share">Share</p>', "<hr>", "<article>", "</article>", "<p>" + "word " * 9 + "</p>", "text <b>bold</b>"]
    for k in range(300):
        weights = [1] * 8 + [0.1 * (k % 2)] * 2 + [1] * 2
        page = "<body>" + "".join(rng.choices(pieces, weights, k=rng.randint(0, 30)))
        assert main_text(page) == brute(page)
