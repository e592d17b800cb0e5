"""Pages that leave hidden elements open."""

import pytest

pytest.importorskip("public_tokenizers")

from lodestar.llm import html_extract  # noqa: E402


def texts(page):
    return [b[0] for b in html_extract.blocks(page)]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><meta charset=a><body><p>One</p><p>Two</p></body></html>",
        "<head><title>x</title><script>w('<div></head><body>')</script><style>a{}</style><p>One</p><p>Two</p>",
        "<head><noscript><img src=x></noscript><link rel=x><div>One</div><p>Two",
        "<head><title>x<body><p>One</p><svg><title>y</title></svg><p>Two</p>",
        "<head><title>x</title>One<p>Two</p>",
    ],
)
def test_head_left_open(page):
    assert texts(page) == ["One", "Two"]


@pytest.mark.parametrize("tag", ["select", "object", "svg", "video", "audio", "canvas", "datalist", "math", "template"])
def test_hidden_element_left_open(tag):
    assert texts(f"<body><article><div>One <{tag}>gone <div>gone</div> gone</div><p>Two</p></article><p>Three</p></body>") == ["One", "Two", "Three"]
    assert texts(f"<ul><li>One<{tag}><p>gone</li><li>Two</ul>Three") == ["One", "Two", "Three"]


def test_closed_hidden_elements():
    assert texts("<head><title>x</title></head><body><p>One <object><div>gone</p></div><svg><title>gone</title></svg></object>two</p><svg/><p>Three") == ["One", "two", "Three"]
    assert texts("<p>One <button>a</button> two</p><select><option>gone</select>Three") == ["One a two", "Three"]
