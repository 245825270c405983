"""HTML extraction: names that text can outvote, weights that are learnt, the whole labelling by brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import html_extraction as H
from tidemark.llm.registry import queries

PROSE = "The committee reviewed the proposal in detail, and its members agreed that the evidence was stronger than before. Several witnesses described how the rules had changed over the years."
NAV = "<nav><a href=/>Home</a> <a href=/news>News</a></nav>"


def page(body, head=NAV, foot="<footer>© 2020 Some site</footer>"):
    return f"<html><body>{head}{body}{foot}</body></html>"


def article(name):
    return page(f"<article><h1>A title</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><section class='{name}'><h2>Further matters</h2><p>{PROSE} {PROSE} {PROSE}</p><p>{PROSE} {PROSE}</p></section></article>")


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    pages = [(i, "u", page(f"<div class='ad'>Buy {rng.random()} now</div><article><h1>Title {i}</h1><p>{PROSE} {i}</p><p>Short one.</p></article>")) for i in range(120)]
    return H.train(spark.createDataFrame(pages, "page_id long, url string, html string"))


@pytest.mark.parametrize("name", ["legal-analysis", "search-algorithms", "form-factor", "notice-of-appeal", "reply-to-critics", "copyright-law", "social", "related-work", "main-banner-story"])
def test_prose_outvotes_a_name(model, name):
    want = "A title" + f"\n\n{PROSE}" * 3 + f"\n\nFurther matters\n\n{PROSE} {PROSE} {PROSE}\n\n{PROSE} {PROSE}"
    assert H.extract(article(name)) == want and H.extract(article(name), model) == want


@pytest.mark.parametrize("name", ["comments", "comment-list", "advert", "ad-slot", "cookie-notice", "notice", "sidebar-left", "site-footer", "newsletter-box", "share-bar"])
def test_boilerplate_goes(model, name):
    body = page(f"<article><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></article><div class='{name}'><p>It is a fair sentence of some length, I think.</p><p>Great post, thanks for it.</p></div>")
    want = f"T\n\n{PROSE}\n\n{PROSE}"
    assert H.extract(body) == want and H.extract(body, model) == want


@pytest.mark.parametrize(("body", "want"), [("plain text only", "plain text only"), ("<ul><li>one<li>two<li>three</ul>", "one\n\ntwo\n\nthree"), ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"), ("<object data=x><p>Words instead of the object.</p></object>", "Words instead of the object.")])
def test_bare_texts_lists_and_tables_are_kept(model, body, want):
    for m in (H.Model(), model):
        assert H.extract(f"<html><body>{body}</body></html>", m) == want
        assert H.extract(page(body), m) == want
    assert H.extract(page("")) == "" and H.extract(page("<div class='advert'>Buy this now</div>"), model) == ""


def test_names_are_learnt_from_where_they_stand(spark):
    pages = [(i, "u", page(f"<article><p class='lead'>{PROSE}</p><div class='promo'><p>{PROSE} {i}</p></div></article><div class='xyz'><p>Some words that stand beside the text, {i}.</p></div>")) for i in range(300)]
    m = H.train(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert m.names["promo"] > 0 > H.begun("promo") and m.names["xyz"] < -2 < H.begun("xyz") + 1  # both lists are outvoted
    assert "© 2020" not in H.extract(pages[0][2], m) and f"{PROSE} 0" in H.extract(pages[0][2], m) and "beside" not in H.extract(pages[0][2], m)
    assert H.learnt("advert", 0, 0) == pytest.approx(H.SURE) and H.learnt("plain", 0, 0) == 0 and H.learnt("plain", 10**6, 0) == H.HIGHEST and H.learnt("plain", 0, 10**6) == H.LOWEST


def test_labels_see_no_names():
    bs, elements = H.blocks("<div class=comments><p>a</p></div><article><p class=advert>b</p><aside>c</aside></article><div id=main>d</div>")
    assert [b.text for b in bs] == ["a", "b", "c", "d"] and H.labelled(bs, elements) == [0, 1, -1, 0]


def test_whole_extraction_is_the_least_labelling():
    """Every labelling of small random pages is tried; texts and costs are those of the plain definition."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["river", "stone,", "of", "the", "report.", "years"]) for _ in range(n))
    tried = 0
    for _ in range(150):
        body = ""
        for _ in range(rng.randrange(1, 7)):
            tag, name = rng.choice(["p", "div", "li", "h2", "section", "aside", "article"]), rng.choice(["", "", " class=advert", " class=related-work", " id=content", " class=alert"])
            text = words(rng.choice([1, 3, 12, 50]))
            body += f"<{tag}{name}>{f'<a href=x>{text}</a>' if rng.random() < 0.25 else text}</{tag}>"
        bs, elements = H.blocks(body)
        side = H.markup(bs, elements)
        gain, ties = H.costs(bs, side, H.FALLBACK), H.edges(bs, side)

        def cost(keep, gain):
            return sum(abs(g) for g, k in zip(gain, keep, strict=True) if (g > 0) != k) + sum(w for a, b, w in ties if keep[a] != keep[b])  # noqa: B023

        def least(gain):
            return min(itertools.product([False, True], repeat=len(bs)), key=lambda k: (round(cost(k, gain), 9), sum(k)))  # noqa: B023

        keep = least(gain)
        if not any(keep):
            own = [s > H.CLEAR and 2 * b.links < len(b.text) for s, b in zip(side, bs, strict=True)]
            if any(own):
                up = max(0.0, 1 - max(g for g, o in zip(gain, own, strict=True) if o))
                keep = least([g + up if o else g for g, o in zip(gain, own, strict=True)])
        assert H.extract(body) == "\n\n".join(b.text for b, k in zip(bs, keep, strict=True) if k)
        tried += 1
    assert tried == 150


def test_query_on_long_and_repeated_pages_and_clashing_columns(spark, tmp_path):
    long_ = page("<article>" + f"<p>{PROSE}</p>" * 8000 + "</article>")
    rows = [(1, "u", long_, "t", 5, "x"), (2, "v", article("social"), "t", 5, "x"), (2, "v", article("social"), "t", 5, "x"), (3, None, "words " * 100_000, "t", 5, "x"), (4, "w", None, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, name string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries()["op4_html_extraction"](spark, str(tmp_path)).collect()}
    assert got[1].text == "\n\n".join([PROSE] * 8000) and got[3].text == ("words " * 100_000).strip() and got[4].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values()) and "Further matters" in got[2].text
    assert np.isfinite(H.FALLBACK).all()
