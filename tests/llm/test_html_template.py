"""Wrapper induction decides by itself: pages without article or main elements and without telling names."""

import random

import pytest

from splicespark.llm import html_extract

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def page(rng, host, k):
    """html and main text: constant cells around one that varies, in number of paragraphs and in text."""
    paragraphs = [" ".join(rng.choices(WORDS, k=rng.randint(4, 12))) + f" {host}{k}p{i}." for i in range(rng.randint(1, 6))]
    body = "".join(f"<p>{x}" for x in paragraphs) if k % 2 else "".join(f"<div class=x><p>{x}</p></div>" for x in paragraphs)
    start = f"<table class=a><tr><td>Start of {host}<td>Shop of {host}<td>Map of {host}</table>"
    if host == "b":
        start = f"<div class=q><div class=r>Start of b</div><ul><li>Shop of b<li>Map of b</ul></div>{'<div class=t>A line that some pages have</div>' if k % 3 else ''}"
    html = f"<html><body>{start}<div class=c><h2>Title {host}{k}</h2>{body}</div><div class=e><p>Written with care at {host}.</p><p>All rights of {host}</p></div></body></html>"
    return html, "\n".join([f"Title {host}{k}", *paragraphs])


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows, right = [], {}
    for host in "ab":
        for k in range(24):
            html, text = page(rng, host, k)
            number = len(rows)
            rows.append((number, f"http://{host}.example.com/{k}", html))
            right[number] = text
    return spark.createDataFrame(rows, "page_id long, url string, html string"), right


def texts(found):
    return {r.page_id: r.text for r in found.collect()}


def test_the_template_finds_the_article(pages):
    table, right = pages
    assert texts(html_extract.extract(table)) == right
    assert texts(html_extract.extract(table.repartition(5))) == right


def test_without_the_template_it_does_not(pages):
    table, right = pages
    found = texts(html_extract.extract(table, share=2.0))  # no block can stand in twice as many pages as there are
    assert all(found[k] != right[k] and right[k] in found[k] for k in right)
    assert all("Shop of" in t and "All rights" in t for t in found.values())


@pytest.mark.parametrize("number", [1, 2])
def test_hosts_of_one_or_two_pages_have_no_template(spark, number):
    rng = random.Random(8)
    rows, right = [], {}
    for k in range(number):
        html, text = page(rng, "a", k)
        rows.append((k, "http://a.example.com/", html))
        right[k] = text
    found = texts(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert found == {k: f"Start of a\nShop of a\nMap of a\n{t}\nWritten with care at a.\nAll rights of a" for k, t in right.items()}
