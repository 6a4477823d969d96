from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillrank.config import Site, shipped_settings
from quillrank.operators import cards, detail, frontier, links
from quillrank.operators.page_walk import walk_page
from quillrank.plans.crawl import crawl_items
from quillrank.sources.pages import read_cached_pages, read_saved_pages
from tests.conftest import values

SITE = Site()
CARDS = """<html><body><nav><a href="/presentations/2/">Older</a><a href=/presentations/>All</a></nav>
<ul><li data-transcript="true"><a href="/topics/x/">Architecture &amp; Design</a>
<a href="/presentations/one/?x=1">First <b>talk</b></a><a href="/profile/A">Ann B</a><a href="/profile/A">Ann B</a>
<span>on Jul  2, 2024</span><span>Icon 50:41</span><p>About things.</p></li>
<li><a href="/presentations/two">View Presentation</a><a href="/presentations/two">Two</a> on Jan 05, 2023</li>
<li><a href="/presentations/bad">Bad</a> on Foo 01, 2024</li></ul>
<p><a href="/presentations/three">Three</a></p>
<!-- <a href="/presentations/no">no</a> --><script>var a='<a href="/presentations/zz">x</a>'</script></body>"""
SCHEDULE = """<a href="/presentations/one#q">S one</a><a href='/presentations/s2?c=SummitSanFrancisco2016'>S two</a>
<a href="/presentations/one">again</a><a href="//feed.items.example.org/presentations/f">feed</a>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "https://items.example.org/list", CARDS),
        (2, "https://items.example.org/x", SCHEDULE),
        (3, "https://items.example.org/summit-london-2019/", SCHEDULE),
        (4, "https://items.example.org/empty", "nothing"),
        (5, "https://items.example.org/null", None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_listing_needs_a_date_or_duration_and_a_real_title(pages):
    rows = {r.url: r for r in cards.listing_items(pages, SITE).collect()}
    assert set(rows) == {f"https://items.example.org/presentations/{x}/" for x in ("one", "two")}
    one = rows["https://items.example.org/presentations/one/"]
    assert (one.title, one.published_date, one.year, one.duration_minutes) == ("First talk", date(2024, 7, 2), 2024, 51)
    assert (one.speaker, one.track, one.has_transcript, one.has_video) == ("Ann B", "Architecture & Design", True, True)
    two = rows["https://items.example.org/presentations/two/"]
    assert (two.title, two.duration_minutes, two.has_video, two.has_transcript) == ("Two", None, False, False)


def test_bad_dates_are_counted_not_raised(pages):
    assert values(cards.rejected_dates(pages, SITE), "page_id", "rejects") == [(1, 1)]


def test_pages_without_cards_fall_back_to_plain_links(pages):
    got = sorted(values(cards.page_items(pages, SITE), "page_id", "url", "title", "year", "conference"))
    u = "https://items.example.org/presentations/{}/".format
    assert got == [
        (1, u("one"), "First talk", 2024, None),
        (1, u("two"), "Two", 2023, None),
        (2, u("one"), "S one", None, None),
        (2, u("s2"), "S two", 2016, "Summit San Francisco 2016"),
        (3, u("one"), "S one", 2019, "Summit London 2019"),
        (3, u("s2"), "S two", 2019, "Summit London 2019"),
    ]


def test_native_and_walked_links_agree(pages):
    native = values(links.item_links(pages.filter("page_id > 1"), SITE), "page_id", "url", "title")
    walked = values(cards.page_items(pages.filter("page_id > 1"), SITE), "page_id", "url", "title")
    assert sorted(native) == sorted(walked)


def test_unclosed_tags_and_nested_cards():
    page = walk_page('<div><li><a href="/presentations/a">A</a> 10:00<li data-transcript><a href="/presentations/b">B<p>x</div>', "/presentations/")
    assert [a["title"] for a in page["links"]] == ["A", "B x"]
    first, second = (page["cards"][a["card"]] for a in page["links"])
    assert (first["head"], first["clock"], first["transcript"]) == ("A 10:00 B x", "10:00", True)
    assert (second["head"], second["clock"], second["transcript"]) == ("B x", None, True)


def test_a_bad_page_fails_alone(spark):
    good = '<li><a href="/presentations/g">G</a> 10:00</li>'
    rows = [(1, "u1", good), (2, "u2", "<![foo[x]]>" + good), (3, "u3", good + "<![foo[x"), (4, "u4", "<![CDATA[<a>]]><![if x]>" + good)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(values(cards.listing_items(pages, SITE), "page_id", "title")) == [(i, "G") for i in (1, 2, 3, 4)]
    assert cards.walk_errors(pages, SITE).count() == 0


def test_what_a_page_gives_grows_with_the_page():
    def size(n):
        page = walk_page("".join(f'<li><a href="/presentations/{i}">T{i}<a href="/profile/{i}">N{i}</a> on Jan 05, 2023 10:0{i % 10}' for i in range(n)), "/presentations/")
        assert len(page["links"]) == n and page["cards"][0]["end_name"] == n and page["cards"][-1]["end_name"] - page["cards"][-1]["first_name"] == 1
        assert page["cards"][7]["clock"] == "10:07" and [a["title"] for a in page["links"]] == [f"T{i}" for i in range(n)]
        return len(repr(page))

    assert size(4000) < 4.5 * size(1000)


def test_a_card_sees_only_what_lies_inside_it():
    page = walk_page('<div><li>on <a href="/presentations/a">A</a></li>Jan 05, 2023 <li><a href="/presentations/b">B</a> 9:30</li> 8:15</div>', "/presentations/")
    assert [(c["date"], c["clock"], c["head"]) for c in page["cards"]] == [(None, None, "on A"), (None, "9:30", "B 9:30")]
    alone = walk_page('<li><a href="/presentations/a">Only this</a></li>', "/presentations/")
    assert alone["links"][0]["same"]


def test_frontier_caps_with_the_seed_and_dedupes_across_seeds(spark):
    html = '<a href="/p/2/">Older</a><a href="/p/2">Next</a><a href="https://h.example/presentations/3/">x</a><a href="/a">A</a><a href="/z">next</a>'
    seeds = spark.createDataFrame([(1, "https://h.example/", html), (2, "https://h.example/p/2", html)], "seed_order int, url string, html string")
    pages = frontier.frontier(seeds, SITE, 3)
    assert sorted(values(pages.filter("seed_order = 1"), "page_no", "url")) == [
        (0, "https://h.example/"), (1, "https://h.example/p/2/"), (2, "https://h.example/presentations/3/"),
    ]
    across = frontier.frontier_across_seeds(seeds, SITE, 3)
    kept = sorted(values(across, "seed_order", "page_no", "url"))
    # The second seed stays although the first one linked to it; its other page is not read twice.
    assert kept == [
        (1, 0, "https://h.example/"), (1, 1, "https://h.example/p/2/"), (1, 2, "https://h.example/presentations/3/"),
        (2, 0, "https://h.example/p/2"), (2, 2, "https://h.example/z"),
    ]
    assert frontier.frontier(seeds, SITE, 1).count() == 2 and frontier.frontier_across_seeds(seeds, SITE, 0).count() == 0
    # Links are taken from the markup once.
    assert across._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_named_references_like_the_parser(spark):
    texts = ["&check; &lbrace;&nbsp", "&amp &ampx &notit; &not; &AMP &unknown; &", "&#65 &#x42; &#67;"]
    rows = spark.createDataFrame([(i, f"https://x.example/{i}", f'<a href="/presentations/t{i}">T {t}</a>') for i, t in enumerate(texts)], "page_id long, url string, html string")
    native = dict(values(links.item_links(rows, SITE), "page_id", "title"))
    walked = {i: walk_page(f'<a href="/presentations/t{i}">T {t}</a>', "/presentations/")["links"][0]["title"] for i, t in enumerate(texts)}
    assert native == walked and native[0] == "T ✓ {"


def test_saved_pages_in_file_order(spark, tmp_path):
    for name, title in (("b", "later"), ("a", "first")):
        (tmp_path / f"{name}.html").write_text(f'<li><a href="/presentations/t">{title}</a> on Jan 02, 2020</li>')
    saved = read_saved_pages(spark, str(tmp_path), "https://items.example.org/list")
    assert [p.rsplit("/", 1)[1] for (p,) in sorted(values(saved, "seq"))] == ["a.html", "b.html"]
    rows = crawl_items(saved, shipped_settings(), datetime(2024, 1, 1), seq=("seq",))
    assert values(rows, "title") == [("later",)]
    assert sorted(values(read_cached_pages(spark, str(tmp_path)), "cache_key")) == [("a",), ("b",)]


def test_detail_prefers_embedded_json(spark):
    full = """<head><meta name="description" content="M &amp; m"><script type="application/ld+json">{"name":"D","description":"dd",
    "datePublished":"2024-07-02T10:00:00Z","author":[{"name":"P"},{"name":"Q"}],"duration":"PT50M41S","contentUrl":"x"}</script></head>
    <h1>H</h1><a>Download Slides</a><h2> Transcript </h2>"""
    plain = '<meta name="description" content="M &amp; m"><h1>H <i>h</i></h1><p>View <b>Presentation</b></p><p>Transcript follows</p>'
    rows = spark.createDataFrame([(1, "u1", full), (2, "u2", plain), (3, "u3", "<p>x</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in detail.detail_items(rows, SITE).collect()}
    assert (got[1].title, got[1].summary, got[1].speaker, got[1].duration_minutes) == ("D", "dd", "P, Q", 51)
    assert (got[1].published_date, got[1].has_video, got[1].has_slides, got[1].has_transcript) == (date(2024, 7, 2), True, True, True)
    assert (got[2].title, got[2].summary, got[2].has_video, got[2].has_slides, got[2].has_transcript) == ("H h", "M & m", True, False, False)
    assert (got[3].title, got[3].summary, got[3].speaker) == ("Untitled", None, None)


def test_crawl_collapses_and_enriches(spark, pages):
    doc = '<script type="application/ld+json">{"name":"Rich","duration":"PT30M"}</script>'
    details = spark.createDataFrame([(9, "https://items.example.org/presentations/one", doc)], "page_id long, url string, html string")
    rows = {r.url: r for r in crawl_items(pages, shipped_settings(), datetime(2024, 1, 1), details).collect()}
    one = rows["https://items.example.org/presentations/one/"]
    # The last page wins as a whole, then the detail is laid over it.
    assert (one.title, one.year, one.conference, one.duration_minutes, one.summary) == ("Rich", 2019, "Summit London 2019", 30, None)
    assert len(rows) == 3
    assert {r.url for r in crawl_items(pages, shipped_settings(), datetime(2024, 1, 1), start_year=2020).collect()} == {
        "https://items.example.org/presentations/one/", "https://items.example.org/presentations/two/",
    }


def test_extraction_never_shuffles(pages):
    for rows in (cards.page_items(pages, SITE), links.item_links(pages, SITE), detail.detail_items(pages, SITE)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_fetch_plan(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("a",)], "url string")
    cached = wanted.filter("url = 'b'").select(F.sha2("url", 256).alias("cache_key"))
    assert values(frontier.fetch_plan(wanted, cached), "url") == [("a",)]


def test_pages_of_one_part_are_walked_by_all_tasks(spark):
    from quillrank.config import Settings, Site
    from quillrank.plans import crawl, history

    html = F.concat(F.lit('<li><a href="/presentations/d'), F.col("id").cast("string"), F.lit('">T</a> 1:02</li>'))
    url = F.concat(F.lit("https://items.example.org/l"), F.col("id").cast("string"))
    pages = spark.range(0, 200, 1, 1).select(F.col("id").alias("page_id"), url.alias("url"), html.alias("html"))
    found = crawl.extracted_items(pages, Settings(site=Site()), ["page_id"])
    assert found.count() == 200 and found.select(F.spark_partition_id()).distinct().count() > 4
    read = pages.select(F.lit("s").alias("source_url"), F.col("page_id").alias("page_no"), "url", "html", F.lit(None).cast("string").alias("error"))
    results = history.read_pages(read, Settings(site=Site()))
    assert results.count() == 200 and results.select(F.spark_partition_id()).distinct().count() > 4
