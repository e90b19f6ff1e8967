"""Extraction where a host's pages are copies, or share text inside the article."""

import pytest

from moraine.llm import html_extract

PAGES = "page_id long, url string, html string"


def page(k, body):
    return f"<html><body><div class='top'>Our Site</div><nav>menu</nav><article><h2>Report</h2>{body}</article><p>All rights</p></body></html>"


@pytest.mark.parametrize("copies", [1, 2, 3, 4, 7])
def test_copies_keep_their_article(spark, copies):
    rows = [(k, f"http://copies/{k}", page(0, "<p>Same body</p>")) for k in range(copies)] + [(9, "http://copies/9", None)]
    plain = [(20 + k, f"http://plain/{k}", "<div>Site</div><p>Words</p>") for k in range(copies)]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows + plain, PAGES)).collect()}
    assert [got[k] for k in range(copies)] == ["Report\nSame body"] * copies and got[9] == ""
    assert [got[20 + k] for k in range(copies)] == ["Site\nWords"] * copies


def test_shared_heading_and_copies_beside_other_pages(spark):
    bodies = [f"<p>Body {k}</p>" for k in range(6)]
    want = {}
    rows = []
    for copy in range(4):
        for k, b in enumerate(bodies):
            rows.append((10 * copy + k, f"http://h/{copy}/{k}", page(k, b)))
            want[10 * copy + k] = f"Report\nBody {k}"
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want
    # without an article, text on every page is still the template's, however often pages are repeated
    rows = [(10 * c + k, f"http://t/{k}", f"<html><body><div>Our Site</div><p>Own {k}</p><p>All rights</p></body></html>") for c in range(2) for k in range(5)]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {10 * c + k: f"Own {k}" for c in range(2) for k in range(5)}


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><p title=it's>He said it's fine</p><p>next</p></article>", "He said it's fine\nnext"),
        ("<p><a href=o'neil>x</a> y's</p>", "x y's"),
        ("<p a=b=\"c>d\">e", 'd">e'),
        ("<p data-id='ad' class=x class=ad>kept</p><p CLASS = \"a &#97;d\">gone</p>", "kept"),
        ("<!-->a<!-- - -- > b --!>c<p a = \"q>\" b>r", "ac\nr"),
        ("<article><p>By Jane Doe</p><aside>s</aside></article><section class='comments'><p>c</p></section>", "By Jane Doe"),
        ("<div class=notice>n</div><div id=right-sidebar>s</div><div role=navigation>m</div><div>text</div>", "text"),
        ("<b><i>x</b></i></p>y<p>z</u></p>", "x\ny\nz"),
    ],
)
def test_attributes_and_parts(html, want):
    assert html_extract.Page(html).main_text(frozenset()) == want


@pytest.mark.parametrize("unit", ["<div>a", "<b>a", "<ul><li>a", "<p title='", "</i><b>", "<h1>x<p>"])
def test_long_odd_pages_take_time_in_proportion(unit):
    import time

    began = time.process_time()
    html_extract.Page(unit * 100_000 + "</i>" * 100_000).main_text(frozenset())
    html_extract.Page("<article><p>" + "words & more " * 80_000 + "</article>").main_text(frozenset())
    assert time.process_time() - began < 30


def test_templates_against_real_occurrence_vectors(spark):
    import random
    from collections import defaultdict

    r = random.Random(6)
    parts = ["<div class=top>Our Site</div>", "<div class=x><p>All rights</p></div>", "<h2>Report</h2>", "<ul><li>a<li>b</ul>", "<p>also here</p>", "<div><div>in</div></div>", "<p>a</p><p>a</p>"]
    rows = []
    for host in range(6):
        of = [r.sample(parts, 3) for _ in range(2)]
        for k in range(r.choice([2, 3, 5, 9])):
            body = "".join(r.choice(of)) + "".join(r.choice(parts) for _ in range(r.randrange(3))) + f"<p>own {r.randrange(6)}</p>"
            rows += [(100 * host + k, f"http://h{host}/{k}", f"<html><body>{body}</body></html>")] * r.choice([1, 1, 2, 3])
    vectors = {host: defaultdict(dict) for host in range(6)}
    pages, elements = {host: {html for i, _, html in rows if i // 100 == host} for host in range(6)}, set()
    for host, of in pages.items():
        for html in of:
            page = html_extract.Page(html)
            elements |= {e.token for e in page.elements}
            for token, n in page.tokens().items():
                vectors[host][token][html] = n
    want = {}
    for host, each in vectors.items():
        classes = defaultdict(list)
        for token, v in each.items():
            classes[tuple(sorted(v.items()))].append(token)
        valid = [c for v, c in classes.items() if len(c) >= 2 and len(v) >= 3 and 2 * len(v) >= len(pages[host]) and set(c) & elements]
        want[host] = frozenset(t for c in valid for t in c)
    got = {x.page_id: x.text for x in html_extract.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: html_extract.Page(html).main_text(want[i // 100]) for i, _, html in rows}
    assert any(want.values())


def test_slots_of_links_are_menus(spark):
    """Unmarked lists of links that differ by page go by the template's slots; without a template they stay."""
    links = lambda k: "".join(f"<li><a href=/{j}>To {j + 7 * k}</a></li>" for j in range(4))
    page = lambda k: f"<html><body><div><ul>{links(k)}</ul></div><section><p>Own {k}, see <a>this</a></p><p>More of {k}</p></section></body></html>"
    rows = [(k, f"http://h/{k}", page(k)) for k in range(6)] + [(9, "http://alone/9", page(9))]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[k] for k in range(6)] == [f"Own {k}, see this\nMore of {k}" for k in range(6)]
    assert got[9].startswith("To 63\nTo 64")
