import time

import pytest

from gondola.llm import html_extract


@pytest.mark.parametrize("quote", "\"'")
@pytest.mark.parametrize("size", [100, 3_000, 5_000, 200_000])
def test_quoted_values_of_any_length(quote, size):
    value = "<p>leak</p></article></div> " * (size // 28 + 1)
    page = f"<div class='menu'><a>x</a></div><article><p data-x={quote}{value}{quote}>Body text of the page.</p><p>More of it.</p></article>"
    short = page.replace(value, "")
    assert html_extract.parsed(page) == html_extract.parsed(short)
    assert html_extract.extract(page, html_extract.Weights({})) == "Body text of the page.\nMore of it."


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a '" * 300_001 + ">", "<a \"<b '" * 100_001 + "<c>", "</a \"" * 200_001, '<a "' + "<a " * 300_000 + ">"])
def test_unclosed_quotes_take_linear_time(page):
    began = time.perf_counter()
    assert sum(b - a for a, b, *_ in html_extract.tokens(page)) <= len(page)
    assert time.perf_counter() - began < 20
