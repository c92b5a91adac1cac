"""Main texts of pages: nothing of an article is lost however many pages a host has, and neutral templates are told apart."""

import random
import re

import pytest

from siftwell.llm import html_text

rng = random.Random(23)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(500)]


def text(r, lo, hi):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(lo, hi)))


def host_pages(n, make):
    r = random.Random(n)
    made = [make(r, k) for k in range(n)]
    found = html_text.findings(html_text.infer([page for page, _ in made]))
    return [(html_text.main_text(page, *found), want) for page, want in made]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 10, 20, 30, 100])
def test_what_repeats_in_an_article_stays(n):
    def make(r, k):
        own = [text(r, 5, 40) for _ in range(3)]
        blocks = [text(r, 3, 6), "LONDON", own[0], "a quoted line", own[1], "share of the market", "related work", "one comment", own[2], "the end"]
        body = "<h1>%s</h1><p class='place'>%s</p><p>%s</p><blockquote>%s</blockquote><p>%s</p><p class='share-of-market'>%s</p><p class='related-work'>%s</p><div class='comment'>%s</div><p>%s</p><div>%s</div>" % tuple(blocks)
        page = f"<body><nav><ul><li><a href='/'>{text(r, 1, 1)}</a></ul></nav><div class='ad'>{text(r, 3, 9)}</div><article>{body}<div class='ads'>buy</div><div class='comments'><p>first!</p></div></article><footer>&copy; {text(r, 1, 3)}</footer></body>"
        return page, "\n".join(blocks)

    assert all(got == want for got, want in host_pages(n, make))


@pytest.mark.parametrize("n", [1, 3, 12, 60])
def test_repeated_comments_go(n):
    def make(r, k):
        own = [text(r, 20, 40) for _ in range(3)]
        said = "".join(f"<div class='comment'><p>{text(r, 3, 9)}</p></div>" for _ in range(2 + k % 3))
        return f"<body><article><h1>t {k}</h1>{''.join(f'<p>{x}</p>' for x in own)}{said}</article></body>", "\n".join([f"t {k}", *own])

    assert all(got == want for got, want in host_pages(n, make))


@pytest.mark.parametrize("tag", ["div", "section"])
def test_neutral_templates_with_varying_menus(tag):
    def make(r, k):
        own = [text(r, 4, 30) for _ in range(r.randint(1, 5))]
        menu = "".join(f"<li><a href='/{j}'>{text(r, 1, 2)}</a></li>" for j in range(r.randint(3, 8)))
        inner = "".join(f"<p>{x}</p>" for x in own) + ("<blockquote>as ever</blockquote>" if k % 2 else "")
        blocks = [f"title {k}", *own, *(["as ever"] if k % 2 else [])]
        page = f"<body><{tag}><ul>{menu}</ul></{tag}><{tag}>{text(r, 3, 12)}</{tag}><{tag}><h1>title {k}</h1>{inner}</{tag}><{tag}>&copy; {text(r, 2, 8)}</{tag}></body>"
        return page, "\n".join(blocks)

    found = host_pages(40, make)
    assert sum(got == want for got, want in found) == 40


def test_findings_do_not_depend_on_order_or_size(monkeypatch):
    r = random.Random(3)
    made = [f"<body><div class='t{k % 9}'><ul><li><a href='/'>menu {k % 2}</a></li></ul></div><div class='m{k % 11}'><p>{text(r, 5, 30)}</p><p>{text(r, 5, 30)}</p></div><div class='x{k}'>only {k}</div></body>" for k in range(60)]
    want = html_text.findings(html_text.infer(made))
    assert html_text.findings(html_text.infer(made[::-1])) == want
    monkeypatch.setattr(html_text, "WRAPPER_ELEMENTS", 20)
    few = html_text.infer(made)
    assert html_text._elements(few.nodes) <= 20 and few.rare and html_text.findings(few) == want
    halves = html_text.infer(made[:25])
    rest = html_text.infer(made[25:])
    halves.add(rest.nodes, rest.pages, rest.rare)
    assert html_text.findings(halves) == want


def test_given_pages_without_names(spark, sf_dir):
    rows = [(r.page_id, re.match(r"[a-z]+://([^/]+)", r.url or "http://x/")[1], r.html or "") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = rows[:400]
    want = {k: html_text.main_text(m[0]) for k, _, page in rows if (m := re.search(r"<article>.*?</article>", page, re.S))}
    hidden = [(k, f"http://{host}/{k}", re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", page)) for k, host, page in rows]
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(hidden, "page_id long, url string, html string")).collect()}
    assert len(want) > 20 and sum(got[k] == t for k, t in want.items()) >= 0.95 * len(want)
