import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.llm import html_extract
from gondola.llm.html_extract import Weights, extract


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_region_is_the_best_of_all_contiguous_runs(scores):
    a, b = html_extract.region(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
    assert sum(scores[a:b]) == best and (best > 0) == (b > a)


ONE = "This is the first paragraph of the article, with a good number of words in it."
TWO = "And here the second one follows, it is as long as the first was, more or less."
LONG = "A paragraph that belongs to the text, it has many words and ends like a sentence does."
BODY = f"<h1>Title of it</h1><p>{ONE}</p>%s<p>{TWO}</p>"


def text(*inner):
    return "\n".join(["Title of it", ONE, *inner, TWO])


@pytest.mark.parametrize(
    "page,want",
    [
        # names are evidence only: real text in a container that a name makes suspicious stays
        (f"<div id='content-side-view'>{BODY % ''}</div>", text()),
        (f"<article>{BODY % f'<div class=related-story><p>{LONG}</p></div>'}</article>", text(LONG)),
        (f"<article>{BODY % f'<section id=share><p>{LONG}</p></section>'}</article>", text(LONG)),
        (f"<article>{BODY % '<div id=share><a href=x>Tweet</a> <a href=y>Mail</a></div>'}</article>", text()),
        (f"<article>{BODY % '<div class=ad>Buy it now at our shop.</div>'}</article>", text()),
        # no container says anything: the scan alone finds the run
        (f"<div><a>Home</a> <a>News</a> <a>Contact</a></div><div>{BODY % ''}</div><div><a>Imprint</a> <a>Terms of use</a></div>", text()),
        # names that are wrong: no other content is there
        (f"<form id=aspnetForm><div class=nav><a href=x>Home</a> <a href=y>News</a></div><div>{BODY % ''}</div><footer>All rights reserved by the owner.</footer></form>", text()),
        (f"<div class='notice-of-death'>{BODY % ''}</div>", text()),
        (f"<nav><a href=x>Home</a></nav><div id='sponsor-a-child-story'>{BODY % ''}</div>", text()),
        (f"<div class='popup-gallery'>{BODY % ''}</div><footer><p>{LONG}</p></footer>", text()),
        (f"<section id='login'>{BODY % ''}</section><section class=comments><p>{LONG}</p><p>{LONG}</p></section>", text()),
        (f"<!--><div class=text>{BODY % ''}</div><!---><p>{LONG}</p><!-- not this --!><p>{LONG}</p>", text() + f"\n{LONG}\n{LONG}"),
        # names that are right: other content is there
        (f"<div>{BODY % ''}</div><div class=sidebar><p>{LONG}</p><p>{LONG}</p></div>", text()),
        (f"<div class=header><p>{LONG}</p></div><div>{BODY % ''}</div><div class=cookie-notice><p>{LONG}</p></div>", text()),
        # legal pages without end tags, and elements whose names begin like dropped ones
        (f"<html><head><title>Not this</title><script>var x = '<body>';</script><body><article>{BODY % ''}</article>", text()),
        (f"<html><head><meta charset=utf-8><title>Not <p> this</title><article>{BODY % ''}</article>", text()),
        (f"<article>{BODY % '<button-bar>words in a bar</button-bar>'}</article>", text("words in a bar")),
        (f"<article>{BODY % '<head-line>A head line</head-line>'}</article>", text("A head line")),
        (f"<article>{BODY % '<svg width=1 />'}</article>", text()),
        (f"<article>{BODY % '<svg><path d=x /></svg>'}</article>", text()),
        (f"<article>{BODY % '<button>'}</article>", text()),
        # not shown
        (f"<article>{BODY % f'<div class=sidebar><p hidden>x</p></div><div hidden><p>{LONG}</p></div>'}</article>", text()),
        (f"<article>{BODY % ''}<p>Short |</p></article>", text() + "\nShort |"),
        (f"<article>{BODY % ''}</article><section class=comments><article class=comment><p>{LONG}</p></article></section>", text()),
    ],
)
def test_evidence(page, want):
    assert extract(page, Weights({})) == want


def test_the_scan_changes_results(monkeypatch):
    page = f"<div><a>Home</a> <a>News</a></div><div>{BODY % ''}</div><div><a>Imprint</a> <a>Terms</a></div>"
    found = extract(page, Weights({}))
    monkeypatch.setattr(html_extract, "region", lambda scores: (0, len(scores)))
    assert extract(page, Weights({})) != found


@pytest.mark.parametrize("seed", range(40))
def test_extraction_with_the_best_of_all_runs(monkeypatch, seed):
    """Small pages of random elements: trying every contiguous run gives what the linear scan gives."""
    draw = random.Random(seed)
    parts = [f"<p>{ONE}</p>", f"<p>{LONG}</p>", "<a href=x>Home</a>", "<ul><li><a href=y>More of it</a></li></ul>", "<div class=ad>Buy it now.</div>", "<nav><a>News</a></nav>", "<h2>Part</h2>", "<div class=sidebar><p>Read this too.</p></div>", "<br>", "Some words", "<article>", "</article>", "<div>", "</div>"]
    page = "".join(draw.choice(parts) for _ in range(draw.randint(1, 9)))
    found = extract(page, Weights({}))

    def brute(scores):
        best, run = 1e-9, (0, 0)
        for i in range(len(scores)):
            for j in range(i + 1, len(scores) + 1):
                if (total := sum(scores[i:j])) > best + 1e-9 or abs(total - best) <= 1e-9 and i == run[0] and j < run[1]:
                    best, run = total, (i, j)
        return run

    monkeypatch.setattr(html_extract, "region", brute)
    assert extract(page, Weights({})) == found


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + ONE,
        "<div>" * 50_000 + "<a>" * 100_000 + ONE,
        "<span>" * 50_000 + "</span></div></a>" * 50_000 + ONE,
        "<ul><li><a>" * 80_000 + ONE,
        "<div class=ad><p>Some words of a sentence.</p>" * 20_000 + ONE,
        "<article class=comment><aside>" * 30_000 + "</b></li>" * 30_000 + ONE,
    ],
)
def test_time_grows_with_the_length(page):
    started = time.process_time()
    extract(page, Weights({}))
    assert time.process_time() - started < 3 * len(page) / 1e6


def test_input_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{BODY % ''}</article>", "mine", 7, "extra")], "page_id long, url string, html string, text string, n_chars long, kind string")
    row = html_extract.main_text(spark, pages, Weights({})).first()
    assert (row.text, row.n_chars, row.kind) == (text(), len(text()), "extra")
