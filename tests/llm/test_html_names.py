"""Class names alone never cost an article its text: the host's tree decides."""

import random

import pytest

from reelframe.llm import html_extraction
from reelframe.llm.html_extraction import Page, extract_text

FRAME = "<html><body><nav><a href=x>Home page here</a><a href=y>About us all</a></nav>{}<div class='advert'>Buy these shoes now</div><footer>All rights of us</footer></body></html>"
RNG = random.Random(11)


def words(n):
    return " ".join("".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(n))


def promo(a, b, c):
    return f"<article class='promo newsletter'><p>{a}</p><p>{b} {c}</p></article>", f"{a}\n{b} {c}"


def inline(a, b, c):
    return f"<article><p>{a} <span class='notice'>{b}</span> {c}</p></article>", f"{a} {b} {c}"


def analysis(a, b, c):
    return f"<article><p>{a}</p><div class='ad-policy-analysis'><p>{b}</p></div><p>{c}</p></article>", f"{a}\n{b}\n{c}"


def noise(a, b, c):
    return f"<article><p>{a} <span class='notice'>Subscribe to us now</span></p><div class='ad-slot'><p>Buy our things</p></div><p>{b} {c}</p></article>", f"{a}\n{b} {c}"


def nested(a, b, c):
    return f"<main id='menu-of-the-day'><p>{a}</p><div class='social-history'><p>{b} <b class='copyright'>{c}</b></p></div></main>", f"{a}\n{b} {c}"


def form(a, b, c):
    return f"<form><p>{a}</p><p>{b} {c}</p></form>", f"{a}\n{b} {c}"


@pytest.mark.parametrize("site", [promo, inline, analysis, noise, nested, form])
def test_sites_keep_their_texts(spark, site):
    made = [site(words(60), words(6), words(50)) for _ in range(40)]
    rows = [(i, f"http://{site.__name__}.org/{i}", FRAME.format(body)) for i, (body, _) in enumerate(made)]
    found = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: text for i, (_, text) in enumerate(made)}
    unjudged = {i: Page(source).text({}) for i, _, source in rows}
    changed = sum(found[i] != unjudged[i] for i in found)
    assert changed == (40 if site in (noise, form) else 0)  # what reads alike on all pages goes by the tree's word, and what differs on all of them stays by it


def test_a_page_of_its_own_keeps_weakly_named_parts(spark):
    """One page is no evidence: elements, roles and outer classes still go, weak names don't."""
    body, text = analysis(words(40), words(20), words(40))
    rows = [(1, "http://lonely.org/", FRAME.format(body)), (2, "http://other.org/", FRAME.format("<article><p>Some text of an article</p><aside>See also</aside><div role='dialog'>Accept</div><div hidden>no</div></article>"))]
    found = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: text, 2: "Some text of an article"}


def test_inline_branches_are_nodes():
    page = Page("<article><p>one <span class='ad'>two <b>three</b> <span>four</span></span> five</p><p>six</p></article>")
    assert page.text({}) == "one two three four five\nsix"
    key = next(n[0] for n in page.nodes if n[2] == html_extraction.WEAK)
    assert page.text({key: html_extraction.GOES_WEAK}) == "one five\nsix"
    cut = Page("<article><p>one <span class='ad'>two</p><p>three</p></article>")  # never closed: ends with its block
    key = next(n[0] for n in cut.nodes if n[2] == html_extraction.WEAK)
    assert cut.text({key: html_extraction.GOES_WEAK}) == "one\nthree"
