"""Pages of a host with more than one layout, and pages whose layout no template knows."""

from annexa.llm import html_template

KINDS = "page_id long, url string, html string"


def page(i, opened, closed, wrap=""):
    return f"<html><head><title>t</title></head><body{wrap}><nav><a href='/'>Home</a></nav>{opened}<h1>Head {i}</h1><p>Body of page {i} with some words</p>{closed}<footer>foot {i}</footer></body></html>"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_template.extract_main_text(spark.createDataFrame(rows, KINDS)).collect()}


def test_minority_layouts(spark):
    ways = [("<article>", "</article>")] * 12 + [("<main>", "</main>")] * 5 + [("<div class='post'>", "</div>")] * 4 + [("<section><article class='x'>", "</article></section>")]
    got = texts(spark, [(i, f"http://a.org/{i}", page(i, *w)) for i, w in enumerate(ways)])
    assert got == {i: f"Head {i}\n\nBody of page {i} with some words" for i in range(len(ways))}


def test_small_hosts_without_the_common_slot(spark):
    rows = [(i, f"http://a.org/{i}", page(i, "<article>", "</article>")) for i in range(9)]
    rows += [(20, "http://b.org/", page(20, "<div id='content'>", "</div>")), (21, "http://c.org/", page(21, "<main>", "</main>", " class='c'"))]
    got = texts(spark, rows)
    assert got == {i: f"Head {i}\n\nBody of page {i} with some words" for i, _, _ in rows}


def test_page_without_main_text(spark):
    rows = [(i, f"http://a.org/{i}", page(i, "<article>", "</article>")) for i in range(4)] + [(9, "http://a.org/9", "<html><body><nav>Home</nav><article></article></body></html>")]
    assert texts(spark, rows)[9] == ""


def test_deep_nesting(spark):
    deep = "<div>" * 90 + "<p>deep</p>" + "</div>" * 90
    rows = [(i, f"http://a.org/{i}", f"<html><body><div><article><p>First {i}</p>{deep}<p>Last {i}</p></article></div><footer>foot</footer></body></html>") for i in range(4)]
    assert texts(spark, rows) == {i: f"First {i}\n\ndeep\n\nLast {i}" for i in range(4)}
