from maskwright.llm import html as H

PAGES = "page_id bigint, url string, html string"


def sections(n):
    return [(i, f"http://big/s{i // 3:04}/p{i % 3}", f"<div>Section {i // 3}</div><div>text {i}</div>") for i in range(n)]


def test_every_page_meets_its_nearest_url(spark):
    """The lines of a section go from all its pages on hosts of any size, wherever the ranges are cut."""
    rows = [(9001, "http://two/a", "<div>Shared</div><div>one</div>"), (9002, "http://two/b", "<div>Shared</div><div>two</div>"), (9003, "http://one/", "<div>Alone</div>")]
    for n in (30, 999, 5001):
        got = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame(sections(n) + rows, PAGES)).collect()}
        assert got == {i: f"text {i}" for i in range(n)} | {9001: "one", 9002: "two", 9003: "Alone"}


def test_bounds_of_long_paths(spark, monkeypatch):
    monkeypatch.setattr(H, "BOUND", 7)
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame(sections(300), PAGES)).collect()}
    assert got == {i: f"text {i}" for i in range(300)}


def test_two_pages_in_two_ranges(spark):
    rows = [(i, f"http://h{i // 2}/{i}", f"<div>Home {i // 2}</div><div>text {i}</div>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in H.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"text {i}" for i in range(8)}
