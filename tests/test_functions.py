"""Column expressions against Python's own functions."""

import html
import re
from datetime import date
from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.config import Rule, Site
from quillrank.functions import events, jsonld, text, times, urls
from quillrank.operators.scoring import phrase_hits

SITE = Site()


def apply(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_short_number_is_general_format(spark):
    numbers = [18.0, 18.5, 100.0, 0.0, 123456.78, 1e6, 1234567.0, 0.0001234567, 1e-5, -3.25, 9.999999, 2 / 3]
    assert apply(spark, numbers, text.short_number, "double") == [f"{n:g}" for n in numbers]


def test_collapse_and_strip_know_unicode_space(spark):
    samples = ["  a \t\n b ", " x  y　", "\x1ca\x1f\x0bb", "", "plain"]
    assert apply(spark, samples, text.collapse) == [re.sub(r"\s+", " ", s).strip() for s in samples]
    assert apply(spark, samples, text.strip) == [s.strip() for s in samples]


def test_entities(spark):
    samples = ["a&amp;b", "&#233;&#xE9;", "&eacute;&nbsp;x", "&bogus; & x", "&#128512;", "&lt;p&gt;", "AT&T", "&apos;&quot;"]
    assert apply(spark, samples, text.decode_entities) == [html.unescape(s) for s in samples]


def test_absolute_matches_urljoin(spark):
    bases = ["https://h.example.org/a/b/c?x=1#f", "https://h.example.org", "https://h.example.org/a/"]
    hrefs = ["", "x", "../x", "./y/", "/r/../s", "//o.example/z", "?q=1", "#z", "mailto:a@b", "https://k.example/p", "..", "a/./b/.."]
    for base in bases:
        got = apply(spark, hrefs, lambda h, b=base: urls.absolute(F.lit(b), h))
        assert got == [urljoin(base, h) for h in hrefs], base


def test_canonical_address(spark):
    cases = {
        "https://items.example.org/presentations/a?x=1#y": "https://items.example.org/presentations/a/",
        "https://items.example.org/presentations/a///": "https://items.example.org/presentations/a/",
        "https://www.items.example.org/presentations/a": "https://www.items.example.org/presentations/a/",
        "https://items.example.org/other/a?x=1": "https://items.example.org/other/a?x=1",
        "https://else.example.com/presentations/a": "https://else.example.com/presentations/a",
        "not a url": "not a url",
    }
    assert apply(spark, list(cases), lambda c: urls.canonical(c, SITE)) == list(cases.values())


def test_item_links(spark):
    cases = {
        "/presentations/a": True,
        "/presentations/a/?x": True,
        "/presentations/": False,
        "/presentations/12/": False,
        "https://feed.items.example.org/presentations/a": False,
        "/topics/a": False,
        "presentations/a": False,
    }
    assert apply(spark, list(cases), lambda c: urls.is_item_link(c, SITE)) == list(cases.values())


def test_times(spark):
    seen = ["x on Jul 02, 2024 y", "on  Jul\n 2, 2024", "upon Jul 02, 2024", "on Foo 01, 2024", "on Feb 30, 2024", "none"]
    assert apply(spark, seen, times.visible_date) == [date(2024, 7, 2), date(2024, 7, 2), None, None, None, None]
    assert apply(spark, seen, times.has_bad_visible_date) == [False, False, False, True, True, False]
    clocks = ["50:41", "a 50:29 b", "1:02:33", "x12:30", "123:45", "7:5", None]
    assert apply(spark, clocks, times.clock_minutes) == [51, 50, 1, None, None, None, None]
    periods = ["PT50M41S", "PT1H2M30S", "PT", "P1D", "PT45S", "PT2H", "x", None]
    assert apply(spark, periods, times.period_minutes) == [51, 63, 0, None, 1, 120, None, None]
    assert apply(spark, ["2024-07-02T10:30:00Z", "2024-13-01", "soon"], times.iso_date) == [date(2024, 7, 2), None, None]


def test_events(spark):
    cases = {
        "https://x/summitsf2016/": "Summit SF 2016",
        "https://x/summit-san-francisco-2020/": "Summit SF 2020",
        "https://x/summit-new-york-2023/": "Summit New York 2023",
        "https://x/conferences/summit-london-2019/": "Summit London 2019",
        "https://x/summit-oslo-2019/": "Summit Oslo 2019 2019",
        "https://x/other/": None,
    }
    assert apply(spark, list(cases), lambda c: events.event_of_url(c, SITE)) == list(cases.values())
    assert apply(spark, ["/SUMMITsf2016", "/summit/2016", "/x2016"], lambda c: events.event_year(c, SITE)) == [2016, None, None]
    tags = ["?c=SummitSanFrancisco2016", "?c=SummitLondon2018", "?c=Summit2018"]
    assert apply(spark, tags, lambda c: events.event_of_campaign(c, SITE)) == ["Summit San Francisco 2016", "Summit London 2018", None]


def test_first_document(spark):
    def page(*bodies):
        return "".join(f'<script type="application/ld+json">{b}</script>' for b in bodies)

    pages = [page("bad", '{"a":1}'), page("[]", '{"a":1}'), page('[{"a":2}, 1]'), page("", '{"a":1}'), page('"x"', '{"a":3}'), "none"]
    assert apply(spark, pages, lambda c: F.to_json(jsonld.first_document(c))) == ['{"a":1}', "{}", '{"a":2}', "{}", '{"a":3}', None]


def test_authors(spark):
    docs = ['{"author":{"name":"A"}}', '{"author":[{"name":"A"},{"x":1},{"name":"B"},"C"]}', '{"author":"A"}', "{}", '{"author":[]}']
    assert apply(spark, docs, lambda c: jsonld.author_names(F.try_parse_json(c))) == ["A", "A, B", None, None, None]


TERMS = ("rag", "C++", "multi-region", "data lake", "ésre", ".net", "101", "a_b")
ALPHABET = "rag C+multi-regiondatalkeés.n10_b\ńßR"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*TERMS, *ALPHABET, " ", "x"]), max_size=12).map("".join), min_size=1, max_size=40))
def test_phrases_match_whole_words_like_python(spark, samples):
    docs = spark.createDataFrame(list(enumerate(samples)), "id int, text string")
    found = {(r.id, r.term) for r in phrase_hits(docs, "id", "text", [Rule("r", 1, TERMS)]).collect()}
    expected = {
        (i, term)
        for i, sample in enumerate(samples)
        for term in TERMS
        if re.search(r"(?<!\w)" + re.escape(term.lower()) + r"(?!\w)", sample.lower().replace("ß", "ss"))
    }
    assert found == expected
