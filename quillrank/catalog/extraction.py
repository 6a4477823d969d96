"""Queries over pages: links, frontier, titles, cards, details.

The shared pages have no cards and no embedded JSON, so card and detail pages
are written by Spark from ``documents``; their SQL twins state the facts that
went into each page instead of reading markup.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.catalog.views import SITE, collapse_sql, table
from quillrank.config import Site
from quillrank.functions import events, times, urls
from quillrank.functions.text import collapse
from quillrank.operators import cards, detail, frontier, links

# Every rooted link of the shared pages counts as an item link, except one listing word.
PAGE_SITE = Site(
    name="Pages", host="example.com", feed_host="spam-farm.example.org", item_path="/",
    generic_schedule_titles=("la", "the"), next_words=("the", "de", "la", "und"),
)


def page_links(spark, folder):
    return links.page_links(table(spark, folder, "pages"))


def item_links(spark, folder):
    return links.item_links(table(spark, folder, "pages"), PAGE_SITE)


def canonical_urls(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select(
        "page_id",
        urls.canonical(F.col("url"), PAGE_SITE).alias("url"),
        urls.netloc(F.col("url")).alias("host"),
        urls.no_slash(F.col("url")).alias("slashless"),
        urls.cache_key(F.col("url")).alias("cache_key"),
    )


def _seeds(spark, folder):
    """All pages as seeds of one hub, so different seeds link to the same pages."""
    pages = table(spark, folder, "pages")
    hub = F.concat(F.lit("https://hub.example.org/s"), F.col("page_id").cast("string"), F.lit("/"))
    return pages.select(F.col("page_id").alias("seed_order"), hub.alias("url"), "html")


def frontier_pages(spark, folder):
    return frontier.frontier(_seeds(spark, folder), PAGE_SITE, 3).drop("key")


def frontier_across_seeds(spark, folder):
    return frontier.frontier_across_seeds(_seeds(spark, folder), PAGE_SITE, 3).drop("key")


def fetch_plan(spark, folder):
    """Linked pages that are not among the pages already held."""
    pages = table(spark, folder, "pages")
    seeds = pages.select("page_id", F.lit("https://hub.example.org/x").alias("url"), "html")
    wanted = links.page_links(seeds).select(F.col("link_url").alias("url"))
    held = links.page_links(seeds).filter("pos > 2").select(urls.cache_key(F.col("link_url")).alias("cache_key"))
    return frontier.fetch_plan(wanted, held)


def page_titles(spark, folder):
    return detail.page_titles(table(spark, folder, "pages"))


def json_fields(spark, folder):
    """Fields of the event stream's JSON, through the variant type."""
    doc = F.try_parse_json("props")
    rows = table(spark, folder, "events").select("event_type", F.try_variant_get(doc, "$.k", "bigint").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("known"), F.sum("k").alias("total"))


def event_fields(spark, folder):
    """Event year and name from addresses made of the orders' keys and dates."""
    orders = table(spark, folder, "orders")
    year = (F.col("o_orderkey") % 25 + 2000).cast("string")
    slugs = F.array(
        F.concat(F.lit("summitsf"), year), F.concat(F.lit("summit-san-francisco-"), year),
        F.concat(F.lit("summit-newyork-"), year), F.concat(F.lit("summit-london-"), year),
        F.concat(F.lit("summit-oslo-"), year), F.lit("summit-plus"), F.lit("other"),
    )
    slug = F.get(slugs, (F.col("o_custkey") % 7).cast("int"))
    rows = orders.select("o_orderkey", F.concat(F.lit("https://items.example.org/"), slug, F.lit("/")).alias("url"))
    campaign = F.concat(F.lit("/presentations/x?c=SummitSanFrancisco"), (F.col("o_orderkey") % 25 + 2000).cast("string"))
    return rows.select(
        "o_orderkey",
        events.event_year(F.col("url"), SITE).alias("year"),
        events.event_of_url(F.col("url"), SITE).alias("event"),
        events.event_of_campaign(campaign, SITE).alias("campaign"),
    )


def media_times(spark, folder):
    """Clock, period and date forms written from the orders and read back."""
    orders = table(spark, folder, "orders")
    m, s = F.col("o_orderkey") % 100, F.col("o_custkey") % 60
    mm, ss = m.cast("string"), F.lpad(s.cast("string"), 2, "0")
    day = F.date_format("o_orderdate", "MMM d, yyyy")
    clock = F.concat(F.lit("Icon "), mm, F.lit(":"), ss, F.lit(" end"))
    period = F.when(m == 0, F.lit("P1D")).otherwise(F.concat(F.lit("PT1H"), mm, F.lit("M"), s.cast("string"), F.lit("S")))
    visible = F.concat(F.lit("Talk on  "), day, F.lit(" by us"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return orders.select(
        "o_orderkey",
        times.clock_minutes(clock).alias("clock"),
        times.period_minutes(period).alias("period"),
        times.visible_date(visible).cast("string").alias("visible"),
        times.iso_date(iso).cast("string").alias("iso"),
    )


def _escaped(c):
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _facts(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents")
    i = F.col("doc_id")
    title = F.coalesce(F.nullif(collapse(F.substring_index("text", "\n", 1)), F.lit("")), F.concat(F.lit("Item "), i.cast("string")))
    day = F.date_add(F.lit(date(2016, 1, 1)), (i * 37 % 3650).cast("int"))
    return docs.select("doc_id", "text", title.alias("title"), F.when(i % 11 != 0, day).alias("day"))


def card_pages(spark, folder) -> DataFrame:
    """One page per document: noise, a card, and a second card for the same item."""
    i = F.col("doc_id")
    text = i.cast("string")
    speaker = (i % 50).cast("string")
    parts = F.concat(
        F.lit('<!DOCTYPE html><html><head><script>var a="<a href=\'/presentations/no\'>no</a>";</script></head><body>'),
        F.lit('<nav><a href="/presentations/2/">Older</a> <a href="/presentations/">All</a></nav><ul><li'),
        F.when(i % 2 == 0, F.lit(' data-transcript="true"')).otherwise(F.lit("")),
        F.lit('><a href="/topics/t">'),
        F.when(i % 3 == 0, F.lit("AI, ML &amp; Data Engineering")).otherwise(F.lit("Other")),
        F.lit('</a> <a href="/presentations/d'), text, F.lit('?x=1#y"><b>'), _escaped(F.col("title")),
        F.lit('</b></a> <a href="/profile/p'), speaker, F.lit('">Speaker '), speaker, F.lit("</a>"),
        F.lit('<a href="/profile/p'), speaker, F.lit('">Speaker '), speaker, F.lit("</a>"),
        F.coalesce(F.concat(F.lit("<span>on "), F.date_format("day", "MMM dd, yyyy"), F.lit("</span>")), F.lit("")),
        F.when(i % 4 != 0, F.concat(F.lit("<span>Icon "), (i % 90).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("</span>"))).otherwise(F.lit("")),
        F.lit("<p>"), _escaped(F.col("text")), F.lit("</p></li></ul><div><a href='./presentations/d"), text,
        F.lit("/'>Again "), text, F.lit("</a> on Jan 01, 2020</div><p>end</body></html>"),
    )
    return _facts(spark, folder).select(
        F.col("doc_id").alias("page_id"), F.lit("https://items.example.org/summit-london-2019").alias("url"), parts.alias("html")
    )


def listing_cards(spark, folder):
    rows = cards.listing_items(card_pages(spark, folder), SITE)
    return rows.select(
        "page_id", "pos", "url", "title", "summary", F.col("published_date").cast("string").alias("published"),
        "year", "speaker", "duration_minutes", "track", "has_video", "has_transcript", "conference", "source",
    )


def nested_cards(spark, folder):
    """Ten documents a page, as list items nobody closes: each lies inside all before it."""
    i = F.col("doc_id")
    text = i.cast("string")
    item = F.concat(
        F.lit('<li><a href="/presentations/d'), text, F.lit('">'), _escaped(F.col("title")), F.lit("</a>"),
        F.when(i % 5 == 2, F.lit("<![odd[mark]]>")).otherwise(F.lit("")),
        F.lit('<a href="/profile/p'), text, F.lit('">Speaker '), text, F.lit("</a>"),
        F.coalesce(F.concat(F.lit("<span>on "), F.date_format("day", "MMM dd, yyyy"), F.lit("</span>")), F.lit("")),
        F.when(i % 4 != 0, F.concat(F.lit("<i>"), (i % 90).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("</i>"))).otherwise(F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item"))))
    pages = _facts(spark, folder).groupBy(F.floor(i / 10).alias("page_id")).agg(F.array_join(F.transform(ordered, lambda x: x["item"]), "").alias("html"))
    rows = cards.listing_items(pages.withColumn("url", F.lit("https://items.example.org/list")), SITE)
    return rows.select("page_id", "url", "title", F.col("published_date").cast("string").alias("published"), "speaker", "duration_minutes")


def page_items(spark, folder):
    """Cards where there are any, plain links elsewhere: half of the pages have no card facts."""
    i = F.col("page_id")
    with_cards = card_pages(spark, folder)
    plain = F.concat(
        F.lit('<p><a href="/presentations/d'), i.cast("string"),
        F.lit('?c=SummitSanFrancisco2016">Plain '), i.cast("string"),
        F.lit('</a><a href="/presentations/d'), i.cast("string"), F.lit('/">Twice</a><a href="//feed.items.example.org/presentations/f">F</a>'),
    )
    pages = with_cards.select(
        "page_id",
        F.when(i % 4 == 1, F.lit("https://items.example.org/x"))
        .when(i % 4 == 3, F.lit("https://items.example.org/summit-london-2019/"))
        .otherwise(F.col("url"))
        .alias("url"),
        F.when(i % 2 == 1, plain).otherwise(F.col("html")).alias("html"),
    )
    rows = cards.page_items(pages, SITE)
    return rows.select("page_id", "url", "title", "year", "conference", "duration_minutes", "has_transcript")


def detail_pages(spark, folder) -> DataFrame:
    """One detail page per document in six shapes of embedded JSON."""
    i = F.col("doc_id")
    text = i.cast("string")
    person = lambda name: F.struct(F.lit("Person").alias("@type"), name.alias("name"))
    first, second = F.concat(F.lit("Ann "), text), F.concat(F.lit("Bo "), text)
    when = F.coalesce(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T10:30:00Z")), F.lit("2024-13-45"))
    length = F.when(i % 5 == 0, F.lit("PT")).when(i % 5 == 1, F.lit("P1D")).otherwise(
        F.concat(F.lit("PT"), (i % 3).cast("string"), F.lit("H"), (i % 50).cast("string"), F.lit("M"), (i % 60).cast("string"), F.lit("S"))
    )
    base = [
        F.col("title").alias("name"), F.col("text").alias("description"), when.alias("datePublished"),
        length.alias("duration"), F.when(i % 3 == 0, F.lit("https://cdn.example.org/v.mp4")).alias("contentUrl"),
    ]
    listed = F.to_json(F.struct(*base, F.array(person(first), person(second), person(F.lit(""))).alias("author")))
    single = F.to_json(F.struct(*base, person(first).alias("author")))
    named = F.to_json(F.struct(*base, first.alias("author")))
    kind = i % 6
    body = (
        F.when(kind == 0, listed).when(kind == 1, single).when(kind == 2, named)
        .when(kind == 3, F.concat(F.lit("["), listed, F.lit(', {"name": "no"}]')))
        .when(kind == 4, F.lit("{bad json")).otherwise(F.lit("[]"))
    )
    html = F.concat(
        F.lit("<html><head><meta charset=utf-8><meta name='description' content=\"Meta "), _escaped(F.col("title")),
        F.lit("\"><style>h1{}</style><script type=\"application/ld+json\">"), body, F.lit("</script></head><body>"),
        F.when(kind != 5, F.concat(F.lit("<h1>Heading <i>"), _escaped(F.col("title")), F.lit("</i></h1>"))).otherwise(F.lit("")),
        F.when(i % 4 == 0, F.lit("<a href='/s'>Download Slides</a>")).otherwise(F.lit("")),
        F.when(i % 7 == 0, F.lit("<a href='/v'>View <b>Presentation</b></a>")).otherwise(F.lit("")),
        F.when(i % 2 == 0, F.lit("<h2>\n Transcript </h2>")).otherwise(F.lit("<h2>No Transcript</h2>")),
        F.lit("<p>"), _escaped(F.col("text")), F.lit("</p></body></html>"),
    )
    url = F.concat(F.lit("https://items.example.org/presentations/d"), text, F.lit("/"))
    return _facts(spark, folder).select(F.col("doc_id").alias("page_id"), url.alias("url"), html.alias("html"))


def detail_items(spark, folder):
    rows = detail.detail_items(detail_pages(spark, folder), SITE)
    return rows.select(
        "page_id", "url", "title", "summary", F.col("published_date").cast("string").alias("published"), "year",
        "speaker", "duration_minutes", "has_video", "has_slides", "has_transcript", "source", "conference",
    )


_HIDDEN_SQL = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"


def _decoded(expr: str) -> str:
    return (
        f"replace(replace(replace(replace({expr}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
    )


_LINKS_SQL = rf"""
tags AS (
  SELECT page_id, url AS page_url, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT page_id, url,
          regexp_extract_all(regexp_replace(html, '{_HIDDEN_SQL}', '', 'g'), '(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>') AS t
        FROM pages)
),
links AS (
  SELECT page_id, page_url, CAST(pos AS INTEGER) AS pos,
    {_decoded("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")} AS href,
    trim({_decoded("regexp_replace(tag, '<[^>]*>', '', 'g')")}) AS title
  FROM tags
),
full_links AS (
  SELECT *, regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) || href AS link_url FROM links
)"""

_HUB_SQL = rf"""{_LINKS_SQL},
hub AS (
  SELECT page_id AS seed_order, 'https://hub.example.org/s' || page_id || '/' AS seed_url, pos,
    'https://hub.example.org' || href AS url, rtrim('https://hub.example.org' || href, '/') AS key
  FROM links
  WHERE lower(title) IN ('the', 'de', 'la', 'und') OR regexp_matches(regexp_extract(rtrim(href, '/'), '([^/]*)$', 1), '^\d+$')
),
hub_first AS (
  SELECT *, row_number() OVER (PARTITION BY seed_order ORDER BY pos) AS page_no FROM (
    SELECT *, row_number() OVER (PARTITION BY seed_order, key ORDER BY pos) AS rn
    FROM hub WHERE key <> rtrim(seed_url, '/')) WHERE rn = 1
),
front AS (
  SELECT seed_order, seed_url, CAST(page_no AS INTEGER) AS page_no, url, key FROM hub_first WHERE page_no < 3
  UNION ALL
  SELECT page_id, 'https://hub.example.org/s' || page_id || '/', 0, 'https://hub.example.org/s' || page_id || '/',
    'https://hub.example.org/s' || page_id FROM pages
)"""

_FACTS_SQL = f"""
facts AS (
  SELECT doc_id, text,
    coalesce(nullif({collapse_sql("split_part(text, chr(10), 1)")}, ''), 'Item ' || doc_id) AS title,
    CASE WHEN doc_id % 11 <> 0 THEN DATE '2016-01-01' + CAST(doc_id * 37 % 3650 AS INTEGER) END AS day
  FROM documents
),
card AS (
  SELECT *, (day IS NULL AND doc_id % 4 = 0) AS bare,
    CASE WHEN doc_id % 3 = 0 THEN 'AI, ML & Data Engineering' ELSE 'Other' END AS topic,
    CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 90 + CASE WHEN doc_id % 60 >= 30 THEN 1 ELSE 0 END AS INTEGER) END AS minutes
  FROM facts
),
cards AS (
  SELECT doc_id AS page_id, CAST(CASE WHEN bare THEN 6 ELSE 3 END AS INTEGER) AS pos,
    'https://items.example.org/presentations/d' || doc_id || '/' AS url,
    CASE WHEN bare THEN 'Again ' || doc_id ELSE title END AS title,
    CASE WHEN bare THEN 'Again ' || doc_id || ' on Jan 01, 2020' ELSE left({collapse_sql('''
      concat_ws(' ', topic, title, 'Speaker ' || (doc_id % 50), 'Speaker ' || (doc_id % 50), 'on ' || strftime(day, '%b %d, %Y'),
        CASE WHEN doc_id % 4 <> 0 THEN 'Icon ' || (doc_id % 90) || ':' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') END, text)''')}, 500) END AS summary,
    CAST(CASE WHEN bare THEN DATE '2020-01-01' ELSE day END AS VARCHAR) AS published,
    CAST(year(CASE WHEN bare THEN DATE '2020-01-01' ELSE day END) AS INTEGER) AS year,
    CASE WHEN NOT bare THEN 'Speaker ' || (doc_id % 50) END AS speaker,
    CASE WHEN NOT bare THEN minutes END AS duration_minutes,
    CASE WHEN NOT bare AND doc_id % 3 = 0 THEN topic END AS track,
    NOT bare AND minutes IS NOT NULL AS has_video,
    NOT bare AND doc_id % 2 = 0 AS has_transcript,
    CAST(NULL AS VARCHAR) AS conference, 'Item Site' AS source
  FROM card
)"""

QUERIES = {
    "page_links": (page_links, f"WITH {_LINKS_SQL} SELECT page_id, page_url, pos, href, title, link_url FROM full_links"),
    "item_links": (
        item_links,
        rf"""WITH {_LINKS_SQL},
ok AS (
  SELECT *, regexp_extract(rtrim(regexp_extract(href, '^([^?#;]*)', 1), '/'), '([^/]*)$', 1) AS slug FROM full_links
),
named AS (
  SELECT *, CASE WHEN regexp_extract(link_url, '^[a-z]+://([^/?#]*)', 1) LIKE '%example.com'
      THEN rtrim(regexp_extract(link_url, '^([^?#;]*)', 1), '/') || '/' ELSE link_url END AS url
  FROM ok
  WHERE contains(href, '/') AND slug <> '' AND NOT regexp_matches(slug, '^\d+$')
    AND title <> '' AND lower(title) NOT IN ('la', 'the')
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM named)
SELECT page_id, page_url, pos, href, title, url FROM ranked WHERE rn = 1""",
    ),
    "canonical_urls": (
        canonical_urls,
        r"""SELECT page_id,
  CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) LIKE '%example.com'
    THEN rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') || '/' ELSE url END AS url,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, rtrim(url, '/') AS slashless, sha256(url) AS cache_key
FROM pages""",
    ),
    "frontier_pages": (frontier_pages, f"WITH {_HUB_SQL} SELECT seed_order, seed_url, page_no, url FROM front"),
    "frontier_across_seeds": (
        frontier_across_seeds,
        f"""WITH {_HUB_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY seed_order, page_no) AS rn FROM front)
SELECT seed_order, seed_url, page_no, url FROM ranked WHERE page_no = 0 OR rn = 1""",
    ),
    "fetch_plan": (
        fetch_plan,
        f"""WITH {_LINKS_SQL}, hub AS (SELECT pos, 'https://hub.example.org' || href AS url FROM links)
SELECT DISTINCT url, sha256(url) AS cache_key FROM hub WHERE url NOT IN (SELECT url FROM hub WHERE pos > 2)""",
    ),
    "page_titles": (
        page_titles,
        rf"""SELECT page_id,
  trim({_decoded("regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}) AS title,
  CAST(NULL AS VARCHAR) AS description FROM pages""",
    ),
    "json_fields": (
        json_fields,
        """SELECT event_type, count(k) AS known, CAST(sum(k) AS BIGINT) AS total
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""",
    ),
    "event_fields": (
        event_fields,
        """SELECT o_orderkey,
  CAST(CASE WHEN o_custkey % 7 < 5 THEN o_orderkey % 25 + 2000 END AS INTEGER) AS year,
  CASE o_custkey % 7 WHEN 0 THEN 'Summit SF ' || y WHEN 1 THEN 'Summit SF ' || y WHEN 2 THEN 'Summit New York ' || y
    WHEN 3 THEN 'Summit London ' || y WHEN 4 THEN 'Summit Oslo ' || y || ' ' || y WHEN 5 THEN 'Summit Plus' END AS event,
  'Summit San Francisco ' || y AS campaign
FROM (SELECT *, o_orderkey % 25 + 2000 AS y FROM orders)""",
    ),
    "media_times": (
        media_times,
        """SELECT o_orderkey,
  CAST(o_orderkey % 100 + CASE WHEN o_custkey % 60 >= 30 THEN 1 ELSE 0 END AS INTEGER) AS clock,
  CAST(CASE WHEN o_orderkey % 100 <> 0 THEN 60 + o_orderkey % 100 + CASE WHEN o_custkey % 60 >= 30 THEN 1 ELSE 0 END END AS INTEGER) AS period,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS visible, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso
FROM orders""",
    ),
    "nested_cards": (
        nested_cards,
        f"""WITH {_FACTS_SQL},
rest AS (
  SELECT doc_id, title, doc_id // 10 AS page_id,
    first_value(day IGNORE NULLS) OVER later AS day, first_value(minutes IGNORE NULLS) OVER later AS minutes,
    list('Speaker ' || doc_id) OVER later AS names
  FROM card
  WINDOW later AS (PARTITION BY doc_id // 10 ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT page_id, 'https://items.example.org/presentations/d' || doc_id || '/' AS url, title, CAST(day AS VARCHAR) AS published,
  array_to_string(names, ', ') AS speaker, minutes AS duration_minutes
FROM rest WHERE day IS NOT NULL OR minutes IS NOT NULL""",
    ),
    "listing_cards": (listing_cards, f"WITH {_FACTS_SQL} SELECT * FROM cards"),
    "page_items": (
        page_items,
        f"""WITH {_FACTS_SQL}
SELECT page_id, url, title, year, conference, duration_minutes, has_transcript FROM cards WHERE page_id % 2 = 0
UNION ALL
SELECT doc_id, 'https://items.example.org/presentations/d' || doc_id || '/', 'Plain ' || doc_id,
  CASE WHEN doc_id % 4 = 1 THEN 2016 ELSE 2019 END,
  CASE WHEN doc_id % 4 = 1 THEN 'Summit San Francisco 2016' ELSE 'Summit London 2019' END, NULL, false
FROM facts WHERE doc_id % 2 = 1""",
    ),
    "detail_items": (
        detail_items,
        f"""WITH {_FACTS_SQL}
SELECT doc_id AS page_id, 'https://items.example.org/presentations/d' || doc_id || '/' AS url,
  CASE doc_id % 6 WHEN 4 THEN 'Heading ' || title WHEN 5 THEN 'Untitled' ELSE title END AS title,
  CASE WHEN doc_id % 6 < 4 THEN text ELSE 'Meta ' || title END AS summary,
  CAST(CASE WHEN doc_id % 6 < 4 THEN day END AS VARCHAR) AS published,
  CAST(CASE WHEN doc_id % 6 < 4 THEN year(day) END AS INTEGER) AS year,
  CASE WHEN doc_id % 6 IN (0, 3) THEN 'Ann ' || doc_id || ', Bo ' || doc_id WHEN doc_id % 6 = 1 THEN 'Ann ' || doc_id END AS speaker,
  CAST(CASE WHEN doc_id % 6 < 4 THEN CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL
    ELSE (doc_id % 3) * 60 + doc_id % 50 + CASE WHEN doc_id % 60 >= 30 THEN 1 ELSE 0 END END END AS INTEGER) AS duration_minutes,
  (doc_id % 6 < 4 AND doc_id % 3 = 0) OR doc_id % 7 = 0 AS has_video,
  doc_id % 4 = 0 AS has_slides, doc_id % 2 = 0 AS has_transcript, 'Item Site' AS source, CAST(NULL AS VARCHAR) AS conference
FROM facts""",
    ),
}
