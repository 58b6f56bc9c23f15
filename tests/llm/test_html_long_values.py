import time

import pytest

from acctlens.llm.html_extract import parse


def texts(html):
    return "".join(t for _, t in parse(html).texts).strip()


@pytest.mark.parametrize("size", [9_000, 12_000, 300_000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_quoted_values_stay_in_their_tag(size, quote):
    value = "a > b <p>" + "x" * size
    assert texts(f"<article><div data-state={quote}{value}{quote}>main words</div></article>") == "main words"


def test_unclosed_quotes_end_at_the_first_sign():
    assert texts("<p title=\"a>one</p><p>two</p>") == "onetwo"


@pytest.mark.parametrize("part", ["<a \">\" ", "<a \"><b '> ", "<a title='>", "<a \"\" "])
@pytest.mark.parametrize("end", ["", "'", "\"", "'>"])
def test_broken_pages_are_passed_once(part, end):
    began = time.process_time()
    parse(part * 60_000 + end)
    assert time.process_time() - began < 10
