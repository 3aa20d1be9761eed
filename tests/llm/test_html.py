"""Wrappers and the texts they give, on pages whose articles are known."""

import html as entities
import random
import re

import pytest
from pyspark.sql import functions as F

from reposift.llm import page_wrappers as w
from reposift.llm.html_extract import extract_articles, infer_wrappers
from reposift.llm.queries import QUERIES
from tests.conftest import rows


def sentence(draw, n=6):
    return " ".join("".join(draw.choice(["ta", "ri", "mö", "&", "lu<", "ke"]) for _ in range(3)) for _ in range(n))


def made(draw, host, number):
    """A page and the text of its article."""
    style = host % 4
    blocks = [sentence(draw) for _ in range(draw.randint(0, 5))]
    title = sentence(draw, 3)
    body, want = [], [title]
    for i, text in enumerate(blocks):
        escaped = entities.escape(text)
        kind = draw.randint(0, 4)
        if kind == 0:
            body.append(f"<p><b>{escaped}<br>\n more")
            want.append(f"{text} more")
        elif kind == 1:
            body.append(f"<ul><li>{escaped}<li>x &eacute;&nbsp;y</ul>")
            want += [text, "x é y"]
        elif kind == 2:
            body.append(f"<table><tr><td>{escaped}<td>1<tr><td>2</table>")
            want += [text, "1", "2"]
        elif kind == 3:
            body.append(f"<p>{escaped}</p><div class='ad'>Buy <p>now</p></div><aside>Side</aside><form>F<input></form>")
            want.append(text)
        else:
            body.append(f"<h2>{escaped}</h2><script>var x='</p><p>bad</p>';</script><!-- <p>bad</p> --><p>{escaped}")
            want += [text, text]
    head = f"<!DOCTYPE html><html><head><title>{entities.escape(title)}</title><style>p{{}}</style></head><body>"
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>{sentence(draw, 1)}</a>" for i in range(draw.randint(0, 4))) + "</ul></nav>"
    comments = f"<section id=\"comments\"><h3>Comments</h3><article class=\"comment\"><p>{sentence(draw)}</p></article></section>" if draw.random() < 0.5 else ""
    notice = "<div class='cookie-notice'>We use cookies</div>" if draw.random() < 0.5 else ""
    heading = f"<h1>{entities.escape(title)}</h1>"
    inner = heading + "".join(body)
    if style == 0:
        core = f"<header>Site</header><article>{inner}{comments}</article>"
    elif style == 1:
        core = f"<div class='page header'>Site</div><main><article><header>{heading}<p>by X</p></header>{''.join(body)}</article></main>{comments}"
    elif style == 2:
        core = f"<div id=main role=main>{inner}</div>{comments}"
    else:
        core = f"<div><p>Welcome to all</p></div><div>{inner}</div>{comments}<div>Imprint</div>"
    end = "</body></html>" if draw.random() < 0.7 else ""
    page = f"{head}{notice}{menu}{core}<footer>&copy; {sentence(draw, 2)}</footer>{end}"
    return (number, f"https://h{host}.example.org/{number}", page), "\n\n".join(" ".join(t.split()) for t in want if t.strip())


def pages():
    draw = random.Random(5)
    return [made(draw, host, host * 100 + i) for host in range(8) for i in range(25)]


def frame(spark, found):
    return spark.createDataFrame(found, "page_id long, url string, html string").repartition(5)


def test_articles_are_extracted(spark):
    found = pages()
    df = frame(spark, [page for page, _ in found]).withColumn("host", F.lit("taken")).withColumn("wrapper", F.lit(1))
    got = {r.page_id: r for r in extract_articles(df).collect()}
    for (number, url, _), want in found:
        assert got[number].text == want
        assert (got[number].url, got[number].n_chars, got[number].host, got[number].wrapper) == (url, len(want), "taken", 1)


def test_every_page_matches_the_wrapper_of_its_host(spark):
    found = [page for page, _ in pages()]
    wrappers = {r.host: w.wrapper_of(r.wrapper) for r in infer_wrappers(frame(spark, found)).collect()}
    assert len(wrappers) == 8
    for _, url, page in found:
        expression = w.expression_of(w.pieces_of(page))
        assert fits(expression, wrappers[url.split("/")[2]].parts)


def fits(parts, pattern):
    """Whether the union-free expression, as a regular expression over labels, matches at every level."""
    sequence = "".join(f"<{p[0]}>" * (2 if p[1] in "+*" else 1) for p in spread(parts))
    if not re.fullmatch(regex(pattern), sequence):
        return False
    inner = {p[0]: p for p in spread(pattern)}
    return all(fits(p[3], inner[p[0]][3]) for p in spread(parts))


def spread(parts):
    return [own for p in parts for own in (p[3] if p[0] == "()" else [p])]


def regex(parts):
    how = {"1": "", "?": "?", "+": "+", "*": "*"}
    return "".join(f"(?:{regex(p[3])})*" if p[0] == "()" else f"(?:<{re.escape(p[0])}>){how[p[1]]}" for p in parts)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_of_random_expressions(seed):
    draw = random.Random(seed)

    def tree(depth):
        return "".join(
            f"<{t}>{tree(depth - 1) if depth and draw.random() < 0.6 else 'x' + str(draw.randint(0, 1))}</{t}>"
            for t in draw.choices(["ul", "ol", "li", "p", "h2", "td", "section"], k=draw.randint(1, 5))
        )

    found = [w.expression_of(w.pieces_of(tree(3))) for _ in range(12)]
    wrapper = []
    for i, expression in enumerate(found):
        wrapper = w.aligned(wrapper, expression) if i else expression
        labels = [p[0] for p in spread(wrapper)]
        assert len(labels) == len(set(labels))
    for expression in found:
        assert fits(expression, wrapper)


def test_odd_pages(spark):
    deep = "<div><section>" * 3_000 + "<article>in<p>deep" + "</b>" * 3_000
    odd = [
        (1, None, None), (2, "", ""), (3, "no url", "just text"), (4, "http://a/x", "<p"), (5, "http://a/y", "<p title='x>y"),
        (6, "http://a/z", deep), (7, "http://a/z", "<article>a &amp; b&#x41;&bogus;</article>"), (7, "http://a/z", "<article>a &amp; b&#x41;&bogus;</article>"),
        (8, "http://b/", "<article>" + "long " * 200_000 + "</article>"), (9, "http://b/", "<script>never ends <p>x"),
        (None, "http://c/", "<article><p>one<p>two</article>"), (10, "http://d/", "<article></article><p>rest"),
        (11, "http://e/", "a < b <3 & c"), (12, "http://f/", "<article>x<article class=comment>y</article></article>z"),
    ]
    got = rows(extract_articles(frame(spark, odd)).select("page_id", "text", "n_chars"))
    texts = {r[0]: r[1] for r in got}
    assert len(got) == len(odd)
    assert all(r[2] == len(r[1]) for r in got)
    assert texts[1] == texts[2] == texts[9] == "" and texts[3] == "just text"
    assert texts[6] == "in\n\ndeep" and texts[7] == "a & bA&bogus;" and len(texts[8]) == 5 * 200_000 - 1
    assert texts[None] == "one\n\ntwo" and texts[10] == "rest" and texts[11] == "a < b <3 & c" and texts[12] == "x"
    assert extract_articles(frame(spark, odd).limit(0)).count() == 0


def test_texts_of_all_pages_are_part_of_the_frame():
    made = [f"<div>Same</div><div><p>{i}</p><p>more {i}</p></div><div>Imprint</div>" for i in range(4)]
    wrapper = w.EMPTY
    for page in made:
        wrapper = wrapper.with_page(page)
    assert w.article_of("<p>1</p>", w.EMPTY.with_page("<p>1</p>").text()) == "1"
    assert [w.article_of(page, wrapper.text()) for page in made[:1]][0].endswith("more 0")


def test_the_query_on_copies(spark, tmp_path):
    """Copies of one page keep their text, though it is the same on all pages of the host."""
    page = "<nav>m</nav><div><p>One</p></div>"
    frame(spark, [(i, "http://a/", page) for i in range(6)]).write.parquet(f"{tmp_path}/pages.parquet")
    got = rows(QUERIES["op12_html_extraction"](spark, str(tmp_path)))
    assert got == [(i, "http://a/", "One", 3) for i in range(6)]
