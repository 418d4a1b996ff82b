"""Main text of pages with hand-made expectations, and a plain reading of the given pages."""

from __future__ import annotations

import html as references
import re
from pathlib import Path

import pytest

from tideline.llm import html, queries

DATA = Path("/root/testdata/sf0.01")
PROSE = "It was late, and the rain had stopped. Nobody spoke; the road, long and empty, led on."

CASES = {
    "article": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><header>Site</header>"
        f"<article><h1>Head &amp; all</h1><p>{PROSE}<p>Short.</article><footer>&copy; x</footer></body></html>",
        ["Head & all", PROSE, "Short."],
    ),
    "names": (
        f"<body><div id='top' class=\"site-header\">X</div><div class=menu><a>a</a><a>b</a></div><div id=c><h2>H</h2>"
        f"<p>{PROSE}</p><div class='ad'>{PROSE}</div><p>a<br>b\n\tc</p><form>{PROSE}</form><aside>{PROSE}</aside></div>"
        f"<div class='cookie-notice'>{PROSE}</div><section id=comments><p>{PROSE}</p></section></body>",
        ["H", PROSE, "a b c"],
    ),
    "scripts": (f"<p>{PROSE}</p><script>if (a < b) {{ '</p>' }}</script><p>a &lt;b&gt; &#233;<!-- <p>no --> 1 < 2</p>", [PROSE, "a <b> é 1 < 2"]),
    "lists": (f"<main><p>{PROSE}</p><ul><li>One<li>Two</ul><table><tr><td>c1<td>c2</table></main>", [PROSE, "One", "Two", "c1", "c2"]),
    "cut off": (f"<article><p>{PROSE}</p><p>Half a wo</p></artic", [PROSE, "Half a wo"]),
    "open tag": (f'<article><p>{PROSE}</p><p>b</p><a href="x', [PROSE, "b"]),
    "article header": (f"<article><header><h1>Head</h1></header><p>{PROSE}</p></article>", ["Head", PROSE]),
    "open script": (f"<p>{PROSE}</p><script>var x", [PROSE]),
    "unclosed inline": (f"<p><b>{PROSE}<br><p>x <i>y</i>z</p>", [PROSE, "x yz"]),
    "hidden": (f"<p title='a hidden gem' class=lead>{PROSE}</p><p hidden>{PROSE}</p><div aria-hidden='true'>{PROSE}</div>", [PROSE]),
    "no markup": ("just  some\ntext", ["just some text"]),
    "no text": ("<nav><a>x</a></nav><script>1</script>", []),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    page, blocks = CASES[name]
    assert html.main_text(page) == "\n\n".join(blocks)


def test_long_and_broken_pages():
    assert html.main_text("<p>" + PROSE * 20_000).count("late") == 20_000
    assert html.main_text("<div>" * 3000 + PROSE) == PROSE
    assert html.main_text("<" * 5000) == "<" * 5000
    assert len(html.main_text(f"<p>{PROSE}</p>" * 5000).split("\n\n")) == 5000


def test_link_list_without_names_is_left_out():
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(20))
    page = f"<body><div><ul>{links}</ul></div><div><p>{PROSE}</p><p>{PROSE}</p><p>Yes.</p></div></body>"
    assert html.main_text(page) == f"{PROSE}\n\n{PROSE}\n\nYes."


def test_operator_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "<p>a.</p>", 5), (1, "<p>a.</p>", 5), (None, None, None), (2, "", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text int")
    got = sorted((r.page_id or 0, r.text) for r in html.extract(df).collect())
    assert got == [(0, ""), (1, "a."), (1, "a."), (2, "")]
    assert html.extract(df.limit(0)).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_query_against_a_plain_reading(spark):
    def plain(page: str) -> str:
        article = re.sub(r"(?s)^.*?<article>", "", page)
        article = re.sub(r"<[^<>]*$", "", re.sub(r"(?s)</article>.*", "", article))
        parts = re.split(r"</?p>|</?h1>", article.replace("<br>", " "))
        texts = (" ".join(references.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)
        return "\n\n".join(t for t in texts if t)

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op1_main_text(spark, str(DATA)).collect()
    assert len(got) == len(pages)
    for row in got:
        assert row.text == plain(pages[row.page_id].html)
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url
