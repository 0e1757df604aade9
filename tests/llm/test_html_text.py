import html
import re
import time

import duckdb
import pytest

from lexiloom.llm import html_text as h

P = "Running text of the article goes on here with many words and no links at all, as prose does. "


def page(body):
    return f"<!doctype html><html><head><title>T</title><script>a='</p>'</script></head><body>{body}</body></html>"


def test_blocks_and_noise():
    body = f"""<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
    <div class="cookie-notice">We use cookies on this page to follow you around, is that fine with you?</div>
    <div id=content><h1>Title&nbsp;&amp; more</h1><p>{P * 2}<p><b>{P}<br>next
      line</b><div class="ad-box">Buy this now, it is cheap and good for you</div><p>{P * 3}<a href=x>link</a> end.
      <form><input name=q><label>Search</label></form><ul class="share"><li><a>x</a></ul></div>
    <aside>{P}</aside><section id=comments><p>Reader: {P * 4}</section><footer>&copy; all</footer>"""
    assert h.main_text(page(body)).split("\n\n") == ["Title & more", (P * 2).strip(), f"{P}next line", f"{P * 3}link end."]


def test_link_lists_lose():
    links = "".join(f"<li><a href=/{i}>Some linked headline number {i} that is long</a></li>" for i in range(40))
    body = f"<div><ul>{links}</ul></div><div><div><p>{P * 3}</p><p>{P * 2}</p></div></div><div><a href=a>a</a> | <a href=b>b</a></div>"
    assert h.main_text(page(body)) == f"{(P * 3).strip()}\n\n{(P * 2).strip()}"


def test_more_shapes():
    sections = "".join(f"<section class=s><h2>Part {i}</h2><p>{P * n}</p></section>" for i, n in enumerate((1, 9, 2)))
    got = h.main_text(page(f"<div class=page><div class=topnav><a href=/>Home</a></div><div><h1>Head</h1>{sections}</div><div class=cookiebar>We use cookies here, many of them.</div></div>"))
    assert got.startswith("Head\n\nPart 0") and "Part 2" in got and "cookies" not in got
    got = h.main_text(page(f"<div><p>{P * 3}</p><p>{P}</p><h3>Comments (2)</h3><div><p>{P}by a reader</p></div></div>"))
    assert got == f"{(P * 3).strip()}\n\n{P.strip()}"
    rows = f"<table><tr><td><ul><li><a href=a>one</a><li><a href=b>two</a></ul></td><td><h1>T</h1><p>{P * 2}</p><p>{P * 3}</p></td></tr></table>"
    assert h.main_text(page(rows)) == f"T\n\n{(P * 2).strip()}\n\n{(P * 3).strip()}"
    flat = f"<div id=nav><a href=a>A</a></div><h1>Flat</h1><p>{P}</p><p>{P}</p><div class=footer>c</div>"
    assert h.main_text(page(flat)) == f"Flat\n\n{P.strip()}\n\n{P.strip()}"
    apart = f"<div class=wrap><div class=entry-header><h1>Title</h1><div class=meta>By <a href=x>Ann</a></div></div><div class=entry><p>{P * 2}</p><p>{P}</p></div></div>"
    assert h.main_text(page(apart)) == f"Title\n\n{(P * 2).strip()}\n\n{P.strip()}"
    loose = f"<div>Welcome! We keep small files, is that fine?</div><div><h1>H</h1><p>{P * 3}</p><p>{P * 2}</p></div><div><p>Reader Bob: {P}</p></div>"
    assert h.main_text(page(loose)) == f"H\n\n{(P * 3).strip()}\n\n{(P * 2).strip()}"
    lists = f"<article><h1>L</h1><p>{P}</p><ul><li>{P}</li><li>second item</li></ul><blockquote>{P}</blockquote><pre>a\n b</pre></article>"
    assert h.main_text(page(lists)).split("\n\n") == ["L", P.strip(), P.strip(), "second item", P.strip(), "a b"]


def test_names_alone():
    inner = f"<h1>Head</h1><p>{P * 3}</p><p>{P * 2}</p>"
    want = f"Head\n\n{(P * 3).strip()}\n\n{(P * 2).strip()}"
    beside = f"<div class=sidebar><p>{P}</p></div>"
    for name in ("content has-sidebar", "content with-sidebar", "no-sidebar", "hasSidebar page", "layout-sidebar", "page banner-page"):
        assert h.main_text(page(f'<div class="{name}">{inner}{beside}</div>')) == want, name
    assert h.main_text(page(f"<div class=widget-area><main>{inner}</main>{beside}</div>")) == want
    assert h.main_text(page(f"<div class='social'>{inner.replace('h1', 'h2')}</div>")) == want
    # comments that are longer than the article stay out
    assert h.main_text(page(f"<article>{inner}</article><div id=comments><p>{P * 30}</p></div>")) == want


def test_short_parts_beside_a_long_core():
    links = "".join(f"<p><a href=/{i}>Some linked headline number {i}</a></p>" for i in range(150))
    core = f"<div class=body>{f'<p>{P * 3}</p>' * 12}</div>"
    for tag in ("div", "blockquote", "pre", "h3"):
        last = f"<{tag} class=closing>{P}</{tag}>"
        got = h.main_text(page(f"<div class=intro>{P * 2}</div>{core}{last}<div class=more>{links}</div>")).split("\n\n")
        assert got == [(P * 2).strip(), *[(P * 3).strip()] * 12, P.strip()], tag


def test_discussion():
    tail = f"<p>{P * 2}</p><p>{P}</p><h2>Conclusion</h2><p>{P * 2}</p>"
    for part in (f"<h2>Discussion</h2>{tail}", f"<section id=discussion><h2>Discussion</h2>{tail}</section>"):
        got = h.main_text(page(f"<article><h1>Head</h1><p>{P * 3}</p>{part}</article>"))
        assert got.split("\n\n") == ["Head", (P * 3).strip(), "Discussion", (P * 2).strip(), P.strip(), "Conclusion", (P * 2).strip()]
    for part in (
        f"<h2>Discussion</h2><div><div class=comment><p>{P}</p></div></div><p>{P}</p>", f"<section id=discussion><div class=comment><p>{P}</p></div></section>",
        f"<h2>Related articles</h2><ul><li><a href=a>{P}</a></li></ul>", f"<h3>Comments</h3><form><p>{P}</p></form>",
    ):
        assert h.main_text(page(f"<article><h1>Head</h1><p>{P * 3}</p>{part}</article>")) == f"Head\n\n{(P * 3).strip()}"


def test_parts_of_an_article():
    head = f"<h1>Head</h1><p class=byline>By <a href=x>Ann</a></p><p>{P * 2}The value <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>"
    links = "".join(f"<li><a href=/{i}>Author {i}, a linked paper with a long title</a></li>" for i in range(5))
    more = f"<section class=social-history><h2>Social history</h2><p>{P * 2}</p></section><section class=social-links><a href=a>one</a> <a href=b>two</a></section>"
    for sources in (f"<h2>References</h2><ol>{links}</ol>", f"<section class=refs><h2>Literatur</h2><ul>{links}</ul></section>"):
        got = h.main_text(page(f"<article>{head}{more}{sources}</article>")).split("\n\n")
        assert got[:5] == ["Head", "By Ann", f"{P * 2}The value x=2 holds.", "Social history", (P * 2).strip()]
        assert got[5] in ("References", "Literatur") and len(got) == 11 and got[10].startswith("Author 4")
    got = h.main_text(page(f"<article>{head}<h2>Elsewhere</h2><ul>{links}</ul></article>"))
    assert "Author" not in got


def test_core_by_density():
    """The subtree of the greatest density sum is taken, as a plain search of all elements finds it."""
    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    other = 0
    for (text,) in rows:
        text = re.sub(r' (?:class|id|role)=(?:"[^"]*"|[^\s>]+)', "", re.sub(r"<(/?)(?:article|main)\b", r"<\1div", text))
        body = h.parse(text)
        parts = h.main_part(body)
        best, most = None, -1.0
        for node in h.walk(body):
            total = sum(p.density for p in node.parts if isinstance(p, h.Node) and not p.noise)
            if total > most:
                best, most = node, total
        assert any(x in h._path(best, body) or best in h._path(x, body) for x in parts)
        other += h.main_text(text) != ""
    assert other == sum(1 for (t,) in rows if h.main_text(t) != "")


@pytest.mark.parametrize("text", [None, "", " ", "<", "<p", "<!-- open", "<script>", "</", "<a href='", "\0", "<>", "&", "<body><body>"])
def test_odd(text):
    assert h.main_text(text).strip() in ("", "<", "&", "<>", "�")


def test_cut_anywhere():
    full = page(f"<article><h1>Head</h1><p>{P}</p><p>A &lt; B &amp; C &#233; &eacute;</p></article><footer>f</footer>")
    for n in range(len(full)):
        h.main_text(full[:n])
    assert h.main_text(full) == f"Head\n\n{P.strip()}\n\nA < B & C é é"
    assert len(h.main_text(f"<p>{'x ' * 300000}</p>")) == 599999
    h.main_text("<div>" * 20000 + "deep")


def test_densities_by_definition():
    body = h.parse(page(f"<div><p>{P}</p><p><a>{P}</a> xx</p></div><p>y</p>"))
    nodes = h.densities(body)
    div, p2 = next(x for x in nodes if x.tag == "div"), [x for x in nodes if x.tag == "p"][1]
    n = len(P.strip())
    assert (div.chars, div.tags, div.link_chars, div.link_tags) == (2 * n + 2, 3, n, 1)
    assert (p2.chars, p2.tags, p2.link_chars, p2.link_tags) == (n + 2, 1, n, 1)
    assert div.sum == sum(x.density for x in nodes if x.tag == "p" and x.parent is div)


def test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    for i, page_html in duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page_html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " " if False else "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert got[i].split("\n\n") == [w for w in want if w], i
    odd = spark.createDataFrame([(1, None, None, 3), (1, None, None, 3)], "page_id long, url string, html string, n_chars int")
    assert [(r.text, r.n_chars) for r in h.extract(odd).collect()] == [("", 0)] * 2
    assert h.extract(odd.limit(0)).count() == 0


LONG = "Running text about the subject that goes on for a while with many words and no links in it at all. " * 2


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (f'<article><h1>T</h1><p>{LONG}</p><div class="notice-of-results"><h2>Results</h2><p>{LONG} R1</p></div></article>', ["R1"]),
        (f'<article><h1>T</h1><p>{LONG}</p><p class="tracking">{LONG} R1</p></article>', ["R1"]),
        (f'<main><h1>T</h1><p>{LONG}</p><div class="related-work"><h2>Related work</h2><p>{LONG} R1</p></div><div class="social-history"><h2>Social history</h2><p>{LONG} R2</p></div></main>', ["R1", "R2"]),
        (f'<main><h1>T</h1><p class="tags">{LONG} R1</p><p class="tags">{LONG} R2</p></main>', ["R1", "R2"]),
        (f'<main><article><h1>A</h1><p>{LONG} R1</p><p>{LONG}</p></article><article><h1>B</h1><p>{LONG} R2</p></article></main>', ["R1", "R2"]),
        (f'<article><h1>T</h1><p>{LONG}</p><div class="related-posts"><h3>Related posts</h3><p>{LONG} BAD</p></div><p class="notice">{LONG} BAD</p><p class="tags"><a>x BAD</a> <a>y</a></p></article>', []),
        (f'<main><article><h1>A</h1><p>{LONG} R1</p><p>{LONG}</p></article><article class="comment"><p>{LONG} BAD</p></article><article><h3><a>Other BAD</a></h3><p>short</p></article></main>', ["R1"]),
    ],
)
def test_named_parts(page, kept):
    """Names take out no running text of an article, but notices, related pages, comments and lists of links go."""
    text = h.main_text(f"<html><body>{page}</body></html>")
    assert [w for w in ("R1", "R2", "BAD") if w in text] == kept


def test_deep():
    """Nested elements cost time in proportion."""
    def seconds(n):
        began = time.perf_counter()
        assert h.main_text("<body>" + "<div>" * n + "text" + "</div>" * n) == "text"
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 40 * seconds(4_000)
