import html as entities
import random
import re

import duckdb

from maskwright.llm import html as H

PAGES = "page_id bigint, url string, html string"


def texts(page, shared=()):
    return H.kept(H.lines(page), set(shared))


def test_article_without_the_rest():
    page = """<html><body class="home"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>Title</h1></header><p>One &amp; two<p>Three <a href="x">link</a> &#x41;&eacute;&nbsp;!
    <div class="ad-slot">Buy</div><aside>related</aside><form><label>f</label></form><section class="comments"><p>c1</p></section>
    <ul><li>a<li>b</ul><table><tr><td>1<td>2</table><pre>x
 y</pre><script>var t="</p>";</script><p>Press <button>Share</button> now</article><div id="comments">cc</div></main><footer>f</footer><p title="a>b">no"""
    assert texts(page) == ["Title", "One & two", "Three link Aé !", "a", "b", "1", "2", "x y", "Press now", "no"]


def test_broken_markup():
    for page in ("", "<", "<p", "<p>a<b>c", "</p></div>x", "<!-- open", "<script>never closed", "<a href='x>y</a>", '<p class="a b>text</p>', "&#xFFFFFFFF; &bogus; &lt;", "<ARTICLE><P>Up</ARTICLE>", "\x00<p>\ud83d</p>".encode("utf-8", "replace").decode(), "<div>" * 3000 + "deep"):
        H.lines(page)
    assert texts("<ARTICLE><P>Up</ARTICLE>") == ["Up"] and texts("<p>a < b & c</p>") == ["a < b & c"]


def test_longest_common_subsequence(monkeypatch):
    rng = random.Random(2)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert len(H.common_lines(a, b)) == length(a, b)
    monkeypatch.setattr(H, "CELLS", 32)  # halved again and again
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        got = sorted(H.common_lines(a, b))
        rest = iter(b)
        assert len(got) == length(a, b) and all(a[i] in rest for i in got)
    monkeypatch.undo()
    a = list(range(3000))
    assert H.common_lines(a, a[:1500] + [-1] * 700 + a[1500:]) == set(a)
    a, b = ([rng.randint(0, 3) for _ in range(6000)] for _ in range(2))
    assert len(H.common_lines(a, b)) > 3000


def test_nothing_else_goes():
    """What stands in an article stays, whatever its name; so does text beside a short article, and a paragraph that is a link."""
    for inside in ('<section class="discussion">kept</section>', '<section id="related">kept</section>', '<div class="search-results-table">kept</div>', "<fieldset>kept</fieldset>", "<noscript>kept</noscript>", "<p>x<math>kept</math>y</p>"):
        assert any("kept" in t for t in texts(f"<article><p>lead</p>{inside}</article>")), inside
    assert texts("<article><p>lead</p></article><div>story</div>") == ["lead", "story"]
    assert texts("<div>a</div><p><a href='x'>one link</a></p><div>b</div>") == ["a", "one link", "b"]
    assert texts("<div>a</div><div><a>1</a></div><div><a>2</a></div><div><a>3</a></div><div>b</div>") == ["a", "b"]
    # a name that may mean something else counts where the neighbour agrees
    page = "<article><p>lead</p><section class='related'><p>more of this</p></section></article>"
    assert texts(page) == ["lead", "more of this"] and texts(page, {0, 1}) == ["lead"]


def plain(pages):
    """The whole query without Spark, ranges or bit-parallel rows."""

    def length_table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        return t[0][0]

    out = {}
    for host in {h for h, *_ in pages}:
        runs = []
        for _, path, page_id, html in sorted(p for p in pages if p[0] == host):
            found = [x.text for x in H.lines(html)]
            if runs and runs[-1][1] == found:
                runs[-1][2].append(page_id)
            else:
                runs.append((path, found, [page_id]))
        for k, (path, found, ids) in enumerate(runs):
            best = None
            for other in ([runs[k - 1]] if k else []) + ([runs[k + 1]] if k + 1 < len(runs) else []):
                n = next((i for i, (x, y) in enumerate(zip(path, other[0])) if x != y), min(len(path), len(other[0])))
                if best is None or n > best[0]:
                    best = (n, other[1])
            for page_id in ids:
                out[page_id] = (len(found), length_table(found, best[1]) if best else 0)
    return out


def test_whole_query_against_a_plain_version(spark):
    rng = random.Random(4)
    pages = []
    for i in range(400):
        host, section, n = rng.choice(["a.org", "a.org", "b.org", "c.org"]), rng.randint(0, 30), rng.randint(0, 4)
        path = f"/s{section}/{'x' * rng.choice([0, 0, 0, 400])}{rng.randint(0, 60)}"
        pages.append((host, path, i, f"<div>Site {host}</div><div>Section {section}</div><div>own {i % 150}</div>" + "".join(f"<p>{rng.randint(0, 6)}</p>" for _ in range(n))))
    want = plain(pages)
    got = H.extracted(spark.createDataFrame([(i, f"http://{h}{p}", t) for h, p, i, t in pages], PAGES)).collect()
    assert len(got) == len(pages)
    for r in got:
        n_lines, n_shared = want[r["page_id"]]
        assert r["n_shared"] == n_shared and r["n_cut"] == n_shared, r
        assert len([t for t in r["text"].split("\n\n") if t]) == n_lines - n_shared


def test_ids_repeated_rows_and_ties(spark):
    """Ids of any type, null ones and repeated rows; pages of one path; columns of the operator's own names; a very long page."""
    one, two = "<div>Site</div><p>one</p>", "<div>Site</div><p>two</p>"
    rows = [("1", "http://h/p", one), ("1", "http://h/p", one), ("2", "http://h/p", two), (None, "http://h/q", "<div>Site</div>" + "<p>three</p>" * 50_000)]
    for kind, cast in (("string", str), ("decimal(20,0)", lambda x: __import__("decimal").Decimal(x)), ("int", int), ("bigint", int)):
        df = spark.createDataFrame([(None if i is None else cast(i), u, h) for i, u, h in rows], f"page_id {kind}, url string, html string").selectExpr("*", "'own' as chunk", "'own' as host", "'own' as path", "'own' as guests")
        got = sorted((str(r["page_id"]), r["text"][:10]) for r in H.extracted(df).collect())
        assert got == [("1", "one"), ("1", "one"), ("2", "two"), ("None", "three\n\nthr")], kind


def test_shared_lines_go_where_no_element_claims_them(spark):
    def page(body):
        return f"<div>Home of {'x'}</div><div>{body}</div><div>All rights reserved</div>"

    rows = [(1, "http://a/x/1", page("first text")), (2, "http://a/x/2", page("second text")), (3, "http://b/1", page("alone")), (4, None, None), (5, "http://c/", "<article><p>same</p><p>5</p></article>"), (6, "http://c/2", "<article><p>same</p><p>6</p></article>"), (7, "http://d/1", page("copy")), (8, "http://d/2", page("copy"))]
    got = {r["page_id"]: r for r in H.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1]["text"] == "first text" and got[2]["text"] == "second text"
    assert got[3]["text"] == "Home of x\n\nalone\n\nAll rights reserved" and got[4]["text"] == "" and got[4]["n_chars"] == 0
    assert got[5]["text"] == "same\n\n5" and got[6]["text"] == "same\n\n6" and got[5]["n_shared"] == 1 and got[5]["n_cut"] == 0
    assert got[7]["text"] == got[8]["text"] == "Home of x\n\ncopy\n\nAll rights reserved"  # copies show no boilerplate
    assert H.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_all_pages(spark, data):
    got = {r["page_id"]: r for r in H.op10_html(spark, data).collect()}
    for i, url, page in duckdb.sql(f"SELECT page_id, url, html FROM '{data}/pages.parquet'").fetchall():
        inside = page[page.index("<article>") + 9 : page.index("</article>")]
        want = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", inside)]
        assert got[i]["text"] == "\n\n".join(filter(None, want)) and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == url
