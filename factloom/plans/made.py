"""Queries over pages, archives, files and replies that are made from the tables, so that SQL over the same tables knows what comes out."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import months, text, vectors
from ..functions.lemmas import lemmatize_with
from ..operators import context, dataset, metrics, retrieval, verdict
from ..sources import articles, files, html
from ..sources.storage import new_folder, stored
from . import runs
from .catalog import QUERIES, _t, query

MONTH_SQL = {lang: "[" + ", ".join(f"'{m}'" for m in names) + "]" for lang, names in months.MONTHS.items()}
_EN, _FR = MONTH_SQL["en"], MONTH_SQL["fr"]
ROOT = "https://{}.wikipedia.org/wiki/"
#: Items to a page.
ITEMS = 5


def _month(lang: str, number: Column) -> Column:
    return F.get(F.array(*map(F.lit, months.MONTHS[lang])), number - 1)


def _plain(c: str) -> Column:
    """Text as it has to stand in a page."""
    return F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _pages(spark: SparkSession, sf: str, lang: str, item: str, page: str) -> DataFrame:
    """Pages of a language with ITEMS items each. ``item`` and ``page`` are patterns: {t} is the item's text, {i} its number, {d} a day; {all} the items."""
    put = lambda pattern, **by: F.concat(*(by[x[1]] if (x := re.fullmatch(r"\{(\w+)\}", p)) else F.lit(p) for p in re.split(r"(\{\w+\})", pattern) if p))
    i = F.col("item_id")
    one = put(item, t=_plain("text"), i=i.cast("string"), d=(i % 28 + 1).cast("string"), span=F.when(i % 2 == 0, put('<span style="font-weight:bold">{d}. Mai</span>', d=(i % 28 + 1).cast("string"))).otherwise(""),
              note=F.when(i % 3 == 0, put("<dl><dd>2024-05-{d}</dd></dl>", d=F.lpad((i % 28 + 1).cast("string"), 2, "0"))).when(i % 3 == 1, put("<dl>{d} mai 2023</dl>", d=(i % 28 + 1).cast("string"))).otherwise(""))
    made = _t(spark, sf, "benchmark").select(F.floor(i / ITEMS).alias("page"), "item_id", one.alias("part"))
    whole = made.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "part"))), lambda x: x["part"]), "").alias("all"))
    url = F.concat(F.lit(ROOT.format(lang) + "P"), F.col("page").cast("string"))
    return whole.select(F.lit(lang).alias("lang"), url.alias("url"), F.lit("2024").alias("year"), put(page, all=F.col("all"), d=(F.col("page") % 28 + 1).cast("string")).alias("html"))


def _flat(facts: DataFrame) -> DataFrame:
    return facts.select("url", F.col("pos").cast("long").alias("pos"), "section", "text", F.array_join("links", " ").alias("links"), F.array_join("relevant_links", " ").alias("relevant"))


_B = f"""WITH b AS (SELECT item_id AS i, text AS t, item_id // {ITEMS} AS p, item_id % 28 + 1 AS d, row_number() OVER (PARTITION BY item_id // {ITEMS} ORDER BY item_id) - 1 AS n, count(*) OVER (PARTITION BY item_id // {ITEMS}) AS k FROM benchmark)
"""
_SPACES = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_T = _SPACES.format("t")


@query(_B + f"""SELECT '{ROOT.format("en")}P' || p AS url, n::BIGINT AS pos, (p % 28 + 1) || ' May 2024' AS section, {_T} || ' x y z' AS text,
  '{ROOT.format("en")}A_' || i || ' {ROOT.format("en")}B ' || i AS links, '{ROOT.format("en")}A_' || i AS relevant FROM b
UNION ALL SELECT '{ROOT.format("en")}P' || p, k, (p % 28 + 1) || ' May 2024', 'last', '', '' FROM b WHERE n = 0""")
def english_facts(spark, sf):
    """Lists after a heading, without each list's first item, up to the next heading of the same level; links inside and outside bold."""
    item = '<li>{t} <b><a href="/wiki/A_{i}">x</a></b> <a href="/wiki/B%20{i}">y</a> <a href="http://e.org/">z</a></li>'
    page = '<div class="mw-heading mw-heading3"><h3>{d} May 2024</h3></div><p>no</p><ul><li>intro</li>{all}</ul><div class="mw-heading mw-heading2"><h2>Other</h2></div><ul><li>skip</li><li>last</li></ul><div class="mw-heading mw-heading3"><h3>z</h3></div>'
    return _flat(html.parse_facts(_pages(spark, sf, "en", item, page)))


@query(_B + f"""SELECT '{ROOT.format("ru")}P' || p AS url, (2 * n + x)::BIGINT AS pos, 'Раздел' AS section, CASE x WHEN 0 THEN strip_accents({_T}) || ' замок т ' ELSE '' END || 'й ' || i AS text,
  CASE x WHEN 0 THEN '{ROOT.format("ru")}Т_' || i ELSE '' END AS links, '' AS relevant FROM b, (VALUES (0), (1)) v(x)""")
def russian_facts(spark, sf):
    """Every item below a section's siblings, also one inside another; stress marks and diacritics go, й stays."""
    item = '<li>{t} за́мок <a href="/wiki/Т_{i}">т</a><ul><li>й {i}</li></ul></li>'
    return _flat(html.parse_facts(_pages(spark, sf, "ru", item, '<div class="x ext-discussiontools-init-section"><h2>Раздел</h2></div><div><ul>{all}</ul></div>')))


@query(_B + f"""SELECT '{ROOT.format("de")}P' || p AS url, n::BIGINT AS pos, CASE i % 2 WHEN 0 THEN d || '. Mai' ELSE 'None' END AS section, {_T} || ' X ist' AS text, '{ROOT.format("de")}X ' || i AS links, NULL AS relevant FROM b""")
def german_facts(spark, sf):
    """The first paragraph of each card, under the card's bold date."""
    item = '<div class="hintergrundfarbe-basis">{span}<p>{t} <a href="/wiki/X%20{i}">X</a> ist</p><p>mehr</p></div>'
    return _flat(html.parse_facts(_pages(spark, sf, "de", item, "<div>{all}</div>")))


@query(_B + f"""SELECT '{ROOT.format("pt")}P' || p AS url, (2 * n + x)::BIGINT AS pos, d || ' de Março de 2024' AS section, CASE x WHEN 0 THEN {_T} ELSE 'b ' || i || ' n' END AS text,
  CASE x WHEN 0 THEN '' ELSE '{ROOT.format("pt")}B_' || i END AS links, CASE x WHEN 0 THEN '' ELSE '{ROOT.format("pt")}B_' || i END AS relevant FROM b, (VALUES (0), (1)) v(x)""")
def portuguese_facts(spark, sf):
    """Paragraphs and list items after each heading, without blank ones; the year is added to the heading."""
    item = '<div class="mw-heading mw-heading2"><h2>{d} de Março</h2></div><p>{t}</p><table><tr><td>no</td></tr></table><ul><li> </li><li>b {i} <b><a href="/wiki/B_{i}">n</a></b></li></ul>'
    return _flat(html.parse_facts(_pages(spark, sf, "pt", item, "<div>{all}</div>")))


@query(_B + f"""SELECT '{ROOT.format("pt")}P' || p AS url, n::BIGINT AS pos, '2024' AS section, {_T} AS text, '' AS links, '' AS relevant FROM b""")
def portuguese_tables(spark, sf):
    """Where a page has a table of facts, the first cells of its rows are all that counts."""
    page = '<div class="mw-heading mw-heading2"><h2>1 de Maio</h2></div><p>no</p><table class="sortable wikitable"><tr><th>h</th></tr>{all}<tr><td> </td></tr></table>'
    return _flat(html.parse_facts(_pages(spark, sf, "pt", "<tr><td>{t}</td><td>x</td></tr>", page)))


_FRENCH = f"""CASE i % 3 WHEN 0 THEN printf('%02d', d) || ' Mai 2024' WHEN 1 THEN printf('%02d', d) || ' Mai 2023' ELSE '2024' END"""


@query(_B + f"""SELECT '{ROOT.format("fr")}P' || p AS url, n::BIGINT AS pos, {_FRENCH} AS section, {_T} || ' g' AS text, '{ROOT.format("fr")}G_' || i AS links, '' AS relevant FROM b""")
def french_facts(spark, sf):
    """Items without their figures and notes; the section is the date in the note, else the page's year."""
    item = '<li>{t} <figure><a href="/wiki/F">f</a></figure><a href="/wiki/G_{i}">g</a>{note}</li>'
    return _flat(html.parse_facts(_pages(spark, sf, "fr", item, '<div class="mw-content-ltr mw-parser-output"><ul>{all}</ul></div>')))


@query(_B + f"""SELECT '{ROOT.format("fr")}P' || p AS url, i AS item_id, CASE i % 3 WHEN 1 THEN '2023' ELSE '2024' END AS year, CASE i % 3 WHEN 2 THEN 'Janvier' ELSE 'Mai' END AS month FROM b""")
def french_months(spark, sf):
    """Year and month of a French fact from its section."""
    item = '<li><a href="/wiki/G_{i}">{i}</a>{note}</li>'
    facts = html.parse_facts(_pages(spark, sf, "fr", item, '<div class="mw-content-ltr mw-parser-output"><ul>{all}</ul></div>'))
    year, month = months.french_year_month(F.col("section"))
    return facts.select("url", F.col("text").cast("long").alias("item_id"), year.alias("year"), month.alias("month"))


@query(f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2020' WHEN 1 THEN day || ' de ' || m || ' de ' || year(ts) ELSE m || ' de 1999' END AS section, CASE event_id % 3 WHEN 0 THEN 'Janeiro' ELSE m END AS month
FROM (SELECT *, day(ts) AS day, ({MONTH_SQL["pt"]})[month(ts)] AS m FROM events)""")
def portuguese_sections(spark, sf):
    """Titles with the year added where it lacks, and the month they name; without a title the year, in January."""
    m = _month("pt", F.month("ts"))
    title = F.when(F.col("event_id") % 3 == 1, F.concat_ws(" de ", F.day("ts").cast("string"), m)).when(F.col("event_id") % 3 == 2, F.concat(m, F.lit(" de 1999")))
    e = _t(spark, sf, "events").select("event_id", months.portuguese_section(title, F.when(F.col("event_id") % 3 == 0, "2020").otherwise(F.year("ts").cast("string"))).alias("section"))
    return e.withColumn("month", months.portuguese_month(F.col("section")))


_DATES = """WITH ym AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
"""


def _archives(spark: SparkSession, sf: str) -> DataFrame:
    """An archive page of each language, with a link for each month (year) in which there are orders; those of odd year + month don't exist."""
    ym = _t(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    new = F.when((F.col("y") + F.col("m")) % 2 == 1, ' class="new"').otherwise("")
    link = lambda lang: F.concat(F.lit('<a href="/wiki/'), F.col("y").cast("string"), F.lit("_"), F.col("m").cast("string"), F.lit('"'), new, F.lit(">"), _month(lang, F.col("m")), F.lit("</a>"))
    joined = lambda by: F.array_join(F.transform(F.sort_array(F.collect_list(by)), lambda x: x["x"]), "")
    year = F.col("y").cast("string")
    rows = ym.groupBy("y").agg(
        *(joined(F.struct("m", F.concat(F.lit(a), link(g), F.lit(b)).alias("x"))).alias(g) for g, a, b in (("en", "<td>", "</td>"), ("de", "<td>", "</td>"), ("ru", " ", "")))
    )
    bare = F.concat(F.lit('<a href="/wiki/'), year, F.lit('">'), year, F.lit("</a>"))
    rows = rows.select("y", F.concat(F.lit("<tr><th>"), year, F.lit("</th>"), "en", F.lit("</tr>")).alias("en"), F.concat(F.lit("<tr><td><b>"), year, F.lit("</b></td>"), "de", F.lit("</tr>")).alias("de"),
                       F.concat(F.lit("<li><b>"), year, F.lit(" год:</b>"), "ru", F.lit("</li>")).alias("ru"), F.concat(F.lit("<b>"), bare, F.lit("</b>")).alias("pt"), bare.alias("fr"))
    around = {
        "en": ('<div class="floatleft"><table>', '<tr><th>all</th><td><a href="/x">x</a></td></tr></table></div>'),
        "ru": ('<div class="ts-Box-description"><ul><li>x</li></ul><ul>', "</ul></div>"),
        "de": ('<div class="mw-content-ltr mw-parser-output"><table></table><table>', "</table></div>"),
        "pt": ('<table class="tmbox tmbox-notice }}"><tr><td>', "<b>x</b></td></tr></table>"),
        "fr": ('<div><div class="mw-heading mw-heading2 ext-discussiontools-init-section"></div><div></div><div><p><a href="/e">2000</a>', '<a href="/wiki/Y">x</a></p></div></div>'),
    }
    one = rows.agg(*(F.concat(F.lit(around[g][0]), joined(F.struct("y", F.col(g).alias("x"))), F.lit(around[g][1])).alias(g) for g in around))
    parts = F.array(*(F.struct(F.lit(g).alias("lang"), F.lit(ROOT.format(g) + "I").alias("url"), F.col(g).alias("html")) for g in around))
    return one.select(F.explode(parts).alias("x")).select("x.*")


@query(_DATES + f"""SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY y, m) - 1 AS pos, y::VARCHAR AS year, names[m] AS month, 'https://' || lang || '.wikipedia.org/wiki/' || y || '_' || m AS url, (y + m) % 2 = 0 AS exists
FROM ym, (VALUES ('en', {_EN}), ('de', {MONTH_SQL["de"]}), ('ru', {MONTH_SQL["ru"]})) v(lang, names)
UNION ALL SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY y) - 1, y::VARCHAR, NULL, 'https://' || lang || '.wikipedia.org/wiki/' || y, true FROM (SELECT DISTINCT y FROM ym), (VALUES ('pt'), ('fr')) v(lang)""")
def archive_links(spark, sf):
    """The pages that archives of five languages link to, with the months that don't exist marked."""
    return html.parse_index(_archives(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


def _months_scraped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Archives, and the facts on the English pages that exist: an item for each day that has orders, of January to June."""
    archives = _archives(spark, sf)
    day = F.to_date("o_orderdate")
    days = _t(spark, sf, "orders").where(F.month("o_orderdate") <= 6).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    li = F.concat(F.lit("<li>"), F.date_format("day", "yyyy-MM-dd"), F.lit(" "), F.col("n").cast("string"), F.lit("</li>"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", li.alias("x")))), lambda x: x["x"]), "")
    url = F.concat(F.lit(ROOT.format("en")), F.year("day").cast("string"), F.lit("_"), F.month("day").cast("string"))
    pages = days.groupBy(url.alias("url")).agg(F.concat(F.lit('<div class="mw-heading mw-heading3"><h3>s</h3></div><ul><li>i</li>'), parts, F.lit("</ul>")).alias("html"))
    return archives, runs.scrape(archives, pages)


_SCRAPED = f"""SELECT y::VARCHAR AS year, ({_EN})[m] AS month, row_number() OVER (PARTITION BY y, m ORDER BY d) - 1 AS item, strftime(d, '%Y-%m-%d') || ' ' || n AS text
FROM (SELECT o_orderdate::DATE AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL) WHERE m <= 6 AND (y + m) % 2 = 0"""


@query(_SCRAPED)
def scraped_months(spark, sf):
    """From archives and pages to facts: pages that don't exist have none."""
    return _months_scraped(spark, sf)[1].select("year", "month", F.col("item").cast("long").alias("item"), "text")


@query(f"SELECT count(*) AS facts FROM ({_SCRAPED})")
def fact_count(spark, sf):
    return runs.count_facts(_months_scraped(spark, sf)[1])


@query(_DATES + f"""SELECT lang, y::VARCHAR AS year, array_to_string(list(names[m] || ':' || CASE WHEN lang = 'en' THEN coalesce(n, 0) ELSE 0 END ORDER BY m), ' ') AS months
FROM ym LEFT JOIN (SELECT y, m, count(*) AS n FROM (SELECT DISTINCT o_orderdate::DATE AS d, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders) WHERE m <= 6 AND (y + m) % 2 = 0 GROUP BY y, m) USING (y, m),
  (VALUES ('en', {_EN}), ('de', {MONTH_SQL["de"]}), ('ru', {MONTH_SQL["ru"]})) v(lang, names) GROUP BY lang, y
UNION ALL SELECT 'pt', y::VARCHAR, '' FROM (SELECT DISTINCT y FROM ym)""")
def nested_months(spark, sf):
    """The nested export keeps the index's months, in the order of the calendar, with empty lists where nothing was found."""
    archives, facts = _months_scraped(spark, sf)
    entries = F.transform(F.map_entries("months"), lambda x: F.concat(x["key"], F.lit(":"), F.size(x["value"]).cast("string")))
    return runs.nested(archives, facts).select("lang", "year", F.array_join(entries, " ").alias("months"))


def _linked_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Each item as a fact with a relevant link, another link, and one that is empty."""
    i = F.col("item_id")
    alpha, beta = F.concat(F.lit(ROOT.format("en") + "Alpha_"), (i % 7 + 10).cast("string")), F.concat(F.lit(ROOT.format("en") + "Beta%20"), (i % 5 + 10).cast("string"))
    return _t(spark, sf, "benchmark").select((2020 + i % 3).cast("string").alias("year"), _month("en", (i % 12 + 1).cast("int")).alias("month"), i.cast("int").alias("item"), F.lit("s").alias("section"), "text",
                                             F.array(alpha, beta, F.lit("")).alias("links"), F.array(alpha).alias("relevant_links"))


def _articles(facts: DataFrame) -> DataFrame:
    urls = dataset.mentions(dataset.dated_facts(facts)).select("url").distinct()
    return urls.where(F.contains("url", F.lit("Alpha"))).select("url", F.concat(F.lit("On "), text.spoken_title("url"), F.lit("\n\nmore")).alias("text"))


_LINKED = rf"""WITH f AS (
  SELECT item_id AS i, text, 2020 + item_id % 3 AS y, item_id % 12 + 1 AS m, '{ROOT.format("en")}Alpha_' || (item_id % 7 + 10) AS alpha, '{ROOT.format("en")}Beta ' || (item_id % 5 + 10) AS beta,
    row_number() OVER (ORDER BY 2020 + item_id % 3, item_id % 12 + 1, item_id) - 1 AS idx FROM benchmark
), u AS (
  SELECT url, row_number() OVER (ORDER BY min((idx, pos))) - 1 AS c FROM (SELECT idx, 0 AS pos, alpha AS url FROM f UNION ALL SELECT idx, 1, beta FROM f) GROUP BY url
)
"""


@query(_LINKED + f"SELECT 'c-' || c AS id, url, CASE WHEN contains(url, 'Alpha') THEN 'On Alpha ' || substr(url, {len(ROOT.format('en')) + 7}) || chr(10) || chr(10) || 'more' ELSE '' END AS text, CASE WHEN contains(url, 'Alpha') THEN 'On Alpha ' || substr(url, {len(ROOT.format('en')) + 7}) ELSE '' END AS abstract FROM u")
def corpus_built(spark, sf):
    """A corpus row for every URL, numbered by first mention, whether or not it has a text."""
    facts = _linked_facts(spark, sf)
    corpus, _ = runs.build(facts, _articles(facts), only="corpus")
    return corpus.select("id", "metadata.url", "text", "abstract")


@query(_LINKED + rf"""SELECT 'q-' || idx AS id, f.text, 'c-' || a.c || ' c-' || b.c AS linked, 'c-' || a.c AS relevant, y || '-' || printf('%02d', m) AS fact_date,
  array_to_string(list_filter(list_sort(list_distinct(['alpha', 'beta', (i % 7 + 10)::VARCHAR, (i % 5 + 10)::VARCHAR])), lambda x: NOT list_contains(regexp_extract_all(lower(f.text), '[\p{{L}}\p{{N}}_]+'), x)), ' ') AS keywords
FROM f JOIN u a ON a.url = alpha JOIN u b ON b.url = beta""")
def queries_built(spark, sf):
    """Queries with the ids of their links in order, the titles' words that the fact lacks, and the date."""
    facts = _linked_facts(spark, sf)
    _, queries = runs.build(facts, _articles(facts), only=None)
    return queries.select("id", "text", F.array_join("linked_articles", " ").alias("linked"), F.array_join("relevant_articles", " ").alias("relevant"), "metadata.fact_date", F.array_join("keywords", " ").alias("keywords"))


@query(_LINKED + """SELECT url, CASE WHEN contains(url, 'Beta') THEN 'c-' || (500 + row_number() OVER (PARTITION BY contains(url, 'Beta') ORDER BY url)) ELSE 'c-' || (500 + (SELECT count(*) FROM u WHERE contains(url, 'Beta')) + row_number() OVER (PARTITION BY contains(url, 'Beta') ORDER BY c)) END AS cid FROM u""")
def registry_resumed(spark, sf):
    """URLs of an earlier corpus keep their ids; new ones are numbered on from the largest."""
    mentioned = dataset.mentions(dataset.dated_facts(_linked_facts(spark, sf)))
    beta = mentioned.where(F.contains("url", F.lit("Beta"))).select("url").distinct()
    known = dataset.number_rows(beta, ["url"]).select(F.concat(F.lit("c-"), (F.col("n") + 501).cast("string")).alias("id"), F.struct("url").alias("metadata"))
    return dataset.url_registry(mentioned, known)


@query(_LINKED + """, k AS (SELECT max(idx) FILTER (i % 2 = 0) AS top FROM f)
SELECT 'q-' || CASE WHEN i % 2 = 0 THEN idx ELSE top + row_number() OVER (PARTITION BY i % 2 ORDER BY idx) END AS id, text FROM f, k""")
def queries_resumed(spark, sf):
    """A run after another that had every second fact: what has a query keeps it, the rest is numbered on."""
    facts = _linked_facts(spark, sf)
    _, queries = runs.build(facts, _articles(facts))
    earlier = queries.join(facts.where("item % 2 = 0").select("text"), "text", "left_semi").select("id", "text")
    _, fresh = runs.build(facts, _articles(facts), asked=earlier)
    return earlier.unionByName(fresh.select("id", "text"))


@query(r"""SELECT n_nationkey AS key, 'https://en.wikipedia.org/wiki/' || n_name || ' é+%' AS url, CASE n_nationkey % 3 WHEN 2 THEN NULL ELSE 'en' END AS lang, CASE n_nationkey % 3 WHEN 2 THEN NULL ELSE n_name || ' é+%' END AS title,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Text of ' || n_name || ' e' ELSE '' END AS text FROM nation""")
def article_texts(spark, sf):
    """Texts of article URLs: language and title from the decoded URL, also with a malformed escape; other sites and missing articles have none."""
    name = F.replace("n_name", F.lit(" "), F.lit("%20"))
    host = F.when(F.col("n_nationkey") % 3 == 2, "https://en.m.wikipedia.org").otherwise("https://en.wikipedia.org")
    urls = _t(spark, sf, "nation").select("n_nationkey", F.concat(host, F.lit("/wiki/"), name, F.lit("%20%C3%A9+%")).alias("url"), "n_name")
    known = urls.where("n_nationkey % 3 = 0").select(F.lit("en").alias("lang"), F.concat("n_name", F.lit(" é+%")).alias("title"), F.concat(F.lit("== Text of ==\n"), F.col("n_name"), F.lit(" é ")).alias("text"))
    lang, title = text.article_key(F.col("url"))
    found = articles.local_articles(urls.select("url"), known)
    decoded = F.replace(text.percent_decode("url"), F.lit("en.m."), F.lit("en."))
    return urls.join(found, "url").select(F.col("n_nationkey").cast("int").alias("key"), decoded.alias("url"), lang.alias("lang"), title.alias("title"), F.trim("text").alias("text"))


def _letters(texts: list[str]) -> np.ndarray:
    """An encoder that SQL has too: how often each letter from a to z occurs."""
    return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float).reshape(len(texts), 26)


@query(r"""WITH t AS (SELECT conv_id, turn, text, coalesce(list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(lower(text)) - length(replace(lower(text), c, '')))::DOUBLE), []) AS v FROM conversations),
q AS (SELECT conv_id, arg_min(v, turn) AS qv FROM t GROUP BY conv_id),
s AS (SELECT t.conv_id, t.turn, round(coalesce(list_dot_product(v, qv) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)), 0), 0), 6) AS score FROM t JOIN q USING (conv_id))
SELECT conv_id, turn, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM s) WHERE rank <= 3""")
def turns_by_likeness(spark, sf):
    """In each conversation the three turns nearest to its first, by the cosine of their encodings."""
    turns = retrieval.embedded(_t(spark, sf, "conversations", "conv_id", "turn", "text"), "text", _letters)
    first = turns.groupBy("conv_id").agg(F.min_by("vector", "turn").alias("of_first"))
    scored = turns.join(first, "conv_id").select("conv_id", "turn", F.round(vectors.cosine("vector", "of_first"), 6).alias("score"))
    return retrieval.top_by_group(scored, "conv_id", "score", "turn", 3).withColumn("rank", F.col("rank").cast("long"))


@query(r"""WITH a AS (
  SELECT item_id, any_value(b.text) AS fact, string_agg(d.text, ' ' ORDER BY d.doc_id) AS article FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id
), s AS (
  SELECT item_id, fact, list_filter(list_transform(string_split(regexp_replace(article, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM a
), f AS (
  SELECT item_id, fact, unnest(parts) AS fragment, generate_subscripts(parts, 1) AS pos FROM s
), v AS (
  SELECT *, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(lower(fragment)) - length(replace(lower(fragment), c, '')))::DOUBLE) AS x,
    list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(lower(fact)) - length(replace(lower(fact), c, '')))::DOUBLE) AS y FROM f
), c AS (
  SELECT item_id, fragment, pos, coalesce(list_dot_product(x, y) / nullif(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)), 0), 0) AS score FROM v
)
SELECT item_id, fragment, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) - 1 AS rank FROM c) WHERE rank < 5""")
def fragment_retrieval(spark, sf):
    """For each item the five sentences of its documents that are nearest to it."""
    items = _t(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    found = QUERIES["relevant_documents"](spark, sf).select("item_id", F.explode(F.transform(F.split("doc_ids", " "), lambda x: x.cast("long"))).alias("doc_id"))
    links = found.select("item_id", F.col("doc_id").alias("place"), F.col("doc_id").alias("article"))
    held = _t(spark, sf, "documents", "doc_id", "text").withColumnRenamed("doc_id", "article").join(links.select("article").distinct(), "article")
    asked = items.join(found.select("item_id").distinct(), "item_id", "left_semi").withColumnRenamed("item", "text")
    best = retrieval.retrieve_linked(asked, links, held, _letters, k=5, key="item_id")
    return best.select("item_id", F.posexplode("contexts").alias("rank", "fragment")).withColumn("rank", F.col("rank").cast("long"))


@query(r"""SELECT item_id, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|'), '') AS sentences FROM benchmark""")
def sentence_fragments(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", F.array_join(text.fragments("text", "sentence"), "|").alias("sentences"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS square, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings""")
def unit_vectors(spark, sf):
    v = vectors.unit("embedding")
    return _t(spark, sf, "embeddings").select("vec_id", F.round(vectors.dot("embedding", "embedding"), 5).alias("square"), F.round(F.get(v, F.lit(0)), 5).alias("first"))


@query("""SELECT label, round(coalesce(avg(embedding[1]::DOUBLE) FILTER (vec_id % 3 = 1), 0), 5) AS first, round(coalesce(avg(embedding[64]::DOUBLE) FILTER (vec_id % 3 = 1), 0), 5) AS last FROM embeddings GROUP BY label""")
def pooled_means(spark, sf):
    """Means of the vectors of each label under a mask, as of the tokens of a text."""
    rows = _t(spark, sf, "embeddings").groupBy("label").agg(F.collect_list("embedding").alias("v"), F.collect_list((F.col("vec_id") % 3 == 1).cast("int")).alias("m"))
    mean = vectors.mean_pool("v", "m")
    return rows.select("label", F.round(F.get(mean, F.lit(0)), 5).alias("first"), F.round(F.get(mean, F.lit(63)), 5).alias("last"))


def _system(mode: str, idk: bool) -> str:
    said = context.SYSTEM[mode]
    return said if idk else said.replace(", or 'idk' if uncertain.", "").replace(*context.UNSURE_CHOICE)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_HEADS = {"linked": "ABSTRACTS", "relevant": "RELEVANT ABSTRACTS"}
_ASKED = "Is the following statement factually correct based on your knowledge and the abstracts below?"


@query("WITH c AS (SELECT conv_id, arg_min(text, turn) AS fact, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS found FROM conversations GROUP BY conv_id)\n" + "\nUNION ALL ".join(
    f"SELECT conv_id, '{mode}' AS mode, md5({_quoted(_system(mode, idk))}) AS system, " + ("'Is the following statement factually correct: \"' || fact || '\"?'" if mode == "fact" else f"{_quoted(_ASKED)} || chr(10) || chr(10) || 'FACT:' || chr(10) || '\"' || fact || '\"' || chr(10) || chr(10) || '{_HEADS[mode]}:' || chr(10) || chr(10) || found")
    + (" || '/no_think'" if think else "") + " AS user FROM c" for mode, idk, think in (("fact", True, False), ("linked", False, False), ("relevant", True, True))))
def prompt_modes(spark, sf):
    """The messages of the three modes, with and without the third answer."""
    turns = _t(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"])
    asked = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("fact"), ids.alias("linked_articles"), ids.alias("relevant_articles")).withColumn("id", F.col("conv_id").cast("string"))
    corpus, out = turns.select("id", F.col("text").alias("abstract")), None
    for mode, idk, think in (("fact", True, False), ("linked", False, False), ("relevant", True, True)):
        m = context.abstracts_of(asked, corpus, mode).select("conv_id", F.lit(mode).alias("mode"), context.messages("fact", "contexts", mode, idk, think).alias("m"))
        part = m.select("conv_id", "mode", F.md5(F.get("m", F.lit(0))["content"]).alias("system"), F.get("m", F.lit(1))["content"].alias("user"))
        out = part if out is None else out.unionByName(part)
    return out


def offline_chat(messages: list[dict]) -> str:
    """Replies by the number in the fact: fenced at once; after a correction; never; with a brace that only the last resort can read. The
    reasoning repeats the fact's first words."""
    number, said = re.search(r"fact (\d+): (.*)", messages[1]["content"], re.DOTALL).groups()
    said, kind = re.findall(r"\w+", said.removesuffix('"?').lower()), int(number) % 4
    corrected = any(m["content"] == context.CORRECTION for m in messages)
    if kind == 0:
        return 'so:\n```json\n{"answer": "yes", "reasoning": "%s"}\n```' % " ".join(said[:6])
    if kind == 1:
        return '{"answer": "no", "reasoning": "%s"}' % " ".join(said[:4]) if corrected else "no idea"
    return "no idea" if kind == 2 else '{"answer": "idk", "reasoning": "a {b} %s"}' % " ".join(said[:5])


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as facts, with some of their words as keywords."""
    none, words = F.expr("cast(array() as array<string>)"), F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    fact = F.concat(F.lit("fact "), F.col("doc_id").cast("string"), F.lit(": "), F.col("text"))
    return _t(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("id"), fact.alias("text"), F.array_distinct(F.slice(words, 4, 6)).alias("keywords"), none.alias("linked_articles"), none.alias("relevant_articles"))


_REPLIES = r"""WITH d AS (SELECT doc_id, doc_id::VARCHAR AS id, text, doc_id % 4 AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), s AS (
  SELECT *, CASE k WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 3 THEN 'idk' END AS answer, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts, k = 2 AS failed,
    CASE k WHEN 0 THEN array_to_string(w[1:6], ' ') WHEN 1 THEN array_to_string(w[1:4], ' ') WHEN 3 THEN 'a {b} ' || array_to_string(w[1:5], ' ') END AS reasoning,
    CASE k WHEN 0 THEN w[1:6] WHEN 1 THEN w[1:4] WHEN 3 THEN ['a', 'b'] || w[1:5] END AS said, list_filter(list_distinct(w[4:9]), lambda x: regexp_matches(x, '^\p{L}+$')) AS keys FROM d), r AS (
  SELECT *, CASE WHEN k <> 2 AND len(w) > 3 THEN CASE WHEN len(keys) > 0 THEN len(list_intersect(keys, said)) / len(keys) ELSE 0.0 END END AS coverage FROM s)
"""


@query(_REPLIES + "SELECT id, answer, reasoning, attempts, failed, round(coverage, 6) AS coverage FROM r")
def verdicts_retried(spark, sf):
    """Replies that are right at once, after a correction, by the last resort, or never."""
    judged = runs.judge(_asked(spark, sf), None, offline_chat, runs.Evaluation(pause=0.0, allow_idk=True))
    return judged.select("id", "answer", "reasoning", "attempts", "failed", F.round("coverage", 6).alias("coverage"))


_RESULTS = """SELECT 'm' AS model, round(avg((answer IS NOT DISTINCT FROM 'yes')::INT), 6) AS accuracy, round(coalesce(count(*) FILTER (answer = 'yes') / nullif(count(*) FILTER (answer IN ('yes', 'no')), 0), 0), 6) AS recall,
  round(avg((answer IS NOT DISTINCT FROM 'idk')::INT), 6) AS idk_ratio, round(avg(coverage), 6) AS mean_coverage,
  (SELECT string_agg(a || ':' || n, ' ' ORDER BY a) FROM (SELECT coalesce(answer, 'null') AS a, count(*) AS n FROM r GROUP BY 1)) AS stats FROM r"""


def _shown(results: DataFrame) -> DataFrame:
    stats = F.array_join(F.transform(F.sort_array(F.map_entries("stats")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), " ")
    return results.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("`recall (without idk)`", 6).alias("recall"), F.round("idk_ratio", 6).alias("idk_ratio"), F.round("mean_coverage", 6).alias("mean_coverage"), stats.alias("stats"))


@query(_REPLIES + _RESULTS)
def evaluation_results(spark, sf):
    """An evaluation broken off after half of the queries and taken up again: results over all of them, as they were written."""
    folder, asked, options = new_folder(spark, "evaluation"), _asked(spark, sf), runs.Evaluation(model="m", pause=0.0, allow_idk=True)
    runs.run_evaluation(asked.where(F.col("id").cast("long") % 2 == 0), None, offline_chat, options, folder)
    runs.run_evaluation(asked, None, offline_chat, options, folder)
    schema = "model string, accuracy double, `recall (without idk)` double, idk_ratio double, mean_coverage double, stats map<string, bigint>"
    return _shown(spark.read.schema(schema).option("multiLine", "true").json(f"{folder}/results"))


@query(_REPLIES + """SELECT 'output' AS kind, 'Is the following statement factually correct: "fact ' || id || ': ' || text || '"?' AS fact, answer AS said, reasoning, '{"answer": "' || answer || '", "reasoning": "' || reasoning || '"}' AS output FROM r WHERE NOT failed
UNION ALL SELECT 'failure', 'fact ' || id || ': ' || text, 'Unable to parse JSON', NULL, NULL FROM r WHERE failed""")
def evaluation_outputs(spark, sf):
    """What an evaluation writes beside its predictions: each usable reply with its prompt, and each fact without one."""
    folder = new_folder(spark, "evaluation")
    runs.run_evaluation(_asked(spark, sf), None, offline_chat, runs.Evaluation(pause=0.0, allow_idk=True), folder)
    outputs = spark.read.schema("prompt string, prediction string, reasoning string, output string").json(f"{folder}/outputs")
    failures = spark.read.schema("id string, fact string, error string").json(f"{folder}/failures")
    rows = outputs.select(F.lit("output").alias("kind"), F.col("prompt").alias("fact"), F.col("prediction").alias("said"), "reasoning", "output")
    none = F.lit(None).cast("string")
    return rows.unionByName(failures.select(F.lit("failure").alias("kind"), "fact", F.col("error").alias("said"), none.alias("reasoning"), none.alias("output")))


@query("""WITH r AS (SELECT d.doc_id, CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS answer, CASE WHEN quality = 1 THEN 0.5 END AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT CASE WHEN quality = 1 THEN 0.5::DOUBLE END AS coverage FROM labels UNION ALL SELECT 1.0 FROM nation)
SELECT 'm' AS model, round(avg((answer IS NOT DISTINCT FROM 'yes')::INT), 6) AS accuracy, round(coalesce(count(*) FILTER (answer = 'yes') / nullif(count(*) FILTER (answer IN ('yes', 'no')), 0), 0), 6) AS recall, round(0.0::DOUBLE, 6) AS idk_ratio,
  (SELECT round(coalesce(avg(coverage), 0), 6) FROM p) AS mean_coverage, (SELECT string_agg(a || ':' || n, ' ' ORDER BY a) FROM (SELECT coalesce(answer, 'null') AS a, count(*) AS n FROM r GROUP BY 1)) AS stats FROM r""")
def stale_predictions(spark, sf):
    """Predictions of queries that are no longer there count for the mean coverage only."""
    q = F.col("quality")
    done = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(q == 1, "yes").when(q == 0, "no").alias("answer"), F.when(q == 1, 0.5).alias("coverage"))
    stale = _t(spark, sf, "nation").select(F.concat(F.lit("gone-"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("yes").alias("answer"), F.lit(1.0).alias("coverage"))
    queries = _t(spark, sf, "documents", "doc_id").select(F.col("doc_id").cast("string").alias("id"))
    return _shown(metrics.evaluate(queries, done.unionByName(stale), "m"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS article_text FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id UNION ALL SELECT conv_id, '' FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn % 2 = 0) = 0")
def full_texts(spark, sf):
    """The texts of a list of ids, in order, without those that are unknown."""
    turns = _t(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"])
    asked = turns.groupBy("conv_id").agg(ids.alias("relevant_articles")).withColumn("id", F.col("conv_id").cast("string"))
    return context.article_text_of(asked, turns.where("turn % 2 = 0").select("id", "text")).select("conv_id", "article_text")


@query("SELECT conv_id::VARCHAR || '-' || turn AS missing FROM conversations WHERE turn % 2 = 1")
def missing_contexts(spark, sf):
    turns = _t(spark, sf, "conversations").withColumn("ids", F.array(F.concat_ws("-", "conv_id", "turn"))).withColumn("id", F.col("conv_id").cast("string"))
    side = turns.where("turn % 2 = 0").select(F.element_at("ids", 1).alias("id"))
    return context.missing_ids(turns, "ids", side).select("missing")


def _written(df: DataFrame, name: str) -> str:
    path = new_folder(df.sparkSession, name)
    files.append_lines(df, path)
    return path


@query("SELECT doc_id::VARCHAR AS id, 'new' AS text FROM documents UNION ALL SELECT DISTINCT doc_id::VARCHAR, 'old' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def corpus_lines(spark, sf):
    """A corpus of JSON lines in files and a later append beside them, among them broken lines and lines without an id: the later row of an id holds."""
    path = new_folder(spark, "corpus")
    row = lambda name, word: _t(spark, sf, name, "doc_id").distinct().select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit(word).alias("text"))).alias("value"))
    broken = _t(spark, sf, "region").select(F.explode(F.array(F.lit('{"id": "x'), F.lit("no"), F.lit('{"text": "t"}'))).alias("value"))
    row("labels", "old").unionByName(broken).write.text(f"{path}/zz")  # its name comes last, its place first
    files.append_lines(_t(spark, sf, "documents", "doc_id").distinct().select(F.col("doc_id").cast("string").alias("id"), F.lit("new").alias("text")), path)
    return files.scan_corpus(spark, path).select("id", "text")


@query(r"""SELECT 'q-' || item_id AS id, text, CASE item_id % 2 WHEN 0 THEN 'c-' || item_id ELSE '' END AS linked, '' AS relevant, 'k' AS keywords FROM benchmark""")
def query_lines(spark, sf):
    """Queries written with the published names and read again, with empty lists where a name is missing."""
    i = F.col("item_id").cast("string")
    rows = _t(spark, sf, "benchmark").select(F.concat(F.lit("q-"), i).alias("id"), "text", F.when(F.col("item_id") % 2 == 0, F.array(F.concat(F.lit("c-"), i))).alias("linked_articles"), F.array(F.lit("k")).alias("keywords"))
    q = files.scan_queries(spark, _written(files.original_names(rows), "queries"))
    return q.select("id", "text", *(F.array_join(c, " ").alias(n) for c, n in (("linked_articles", "linked"), ("relevant_articles", "relevant"), ("keywords", "keywords"))))


@query("""SELECT page_id, regexp_extract(replace(u, '_', ' '), '^.*?/wiki/(.*)$', 1) AS title FROM (SELECT page_id, 'https://en.wikipedia.org/wiki/Page_' || page_id AS u FROM pages WHERE page_id % 3 <> 0)""")
def known_titles(spark, sf):
    """Titles of the mentioned articles that the registry has, here two of three."""
    url = F.concat(F.lit(ROOT.format("en") + "Page_"), F.col("page_id").cast("string"))
    pages = _t(spark, sf, "pages", "page_id").select("page_id", url.alias("url"))
    mentioned = pages.select(F.col("page_id").alias("idx"), F.lit(0).alias("pos"), "url", F.lit(False).alias("relevant"))
    registry = pages.where("page_id % 3 <> 0").select("url", F.concat(F.lit("c-"), F.col("page_id").cast("string")).alias("cid"))
    return dataset.known_titles(mentioned, registry).withColumnRenamed("idx", "page_id")


@query("SELECT doc_id, md5(replace(text, 'e ', 'e_')) AS digest FROM documents")
def nonbreaking_spaces(spark, sf):
    """Texts with spaces that must not break: each becomes a plain one."""
    hard = F.replace(F.replace("text", F.lit("e "), F.lit("e_")), F.lit(" "), F.lit("\u00a0"))
    return _t(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(text.nonbreaking_to_space(hard)).alias("digest"))


@query(f"SELECT item_id // {ITEMS} AS page, '{html.UNTITLED}' AS section, count(*) AS facts FROM benchmark GROUP BY 1")
def untitled_sections(spark, sf):
    """Facts below headings that lack their tag."""
    made = _pages(spark, sf, "en", "<li>{t}</li>", '<div class="mw-heading mw-heading3">bare</div><ul><li>0</li>{all}</ul>')
    facts = html.parse_facts(made).groupBy("url", "section").agg(F.count(F.lit(1)).alias("facts"))
    return facts.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page"), "section", "facts")


def _two_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token vectors and their mask as a model gives them: (length, 1) and (1, 0), the second of them masked in texts of odd length."""
    n = np.array([len(t) for t in texts], float)
    states = np.stack([np.stack([n, np.ones(len(n))], 1), np.stack([np.ones(len(n)), np.zeros(len(n))], 1)], 1)
    return states, np.stack([np.ones(len(n)), n % 2 == 0], 1)


@query("""WITH t AS (SELECT item_id, length(text)::DOUBLE AS n FROM benchmark), v AS (
  SELECT item_id, 'cls' AS pooling, n AS x, 1.0::DOUBLE AS y FROM t UNION ALL SELECT item_id, 'mean', CASE WHEN n % 2 = 0 THEN (n + 1) / 2 ELSE n END, CASE WHEN n % 2 = 0 THEN 0.5 ELSE 1.0 END FROM t
)
SELECT item_id, pooling, round(x / sqrt(x * x + y * y), 6) AS first, round(y / sqrt(x * x + y * y), 6) AS second FROM v""")
def pooled_encodings(spark, sf):
    """Encodings of the items by the first token and by the mean of the tokens that count, of length 1."""
    out = None
    for pooling in ("cls", "mean"):
        rows = retrieval.embedded(_t(spark, sf, "benchmark").select("item_id", "text"), "text", retrieval.pooled(_two_tokens, pooling, batch=7))
        part = rows.select("item_id", F.lit(pooling).alias("pooling"), F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(1)), 6).alias("second"))
        out = part if out is None else out.unionByName(part)
    return out


def _tagged(lang: str):
    """A lemmatizer that says which language it was made for; there is none for German."""
    if lang == "de":
        raise LookupError(lang)
    return lambda words: [f"{w}_{lang}" for w in words]


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: CASE lang WHEN 'de' THEN x ELSE x || '_' || lang END))), ' ') AS lemmas FROM documents WHERE lang IS NOT NULL""")
def lemmas_by_language(spark, sf):
    """Each document's words by the lemmatizer of its language, in lower case where there is none."""
    d, out = _t(spark, sf, "documents", "doc_id", "lang", "text"), None
    for lang in sorted(r[0] for r in d.select("lang").where("lang is not null").distinct().collect()):
        found = lemmatize_with(lang, [_tagged])(text.words("text"))
        part = d.where(F.col("lang") == lang).select("doc_id", F.array_join(F.sort_array(F.array_distinct(found)), " ").alias("lemmas"))
        out = part if out is None else out.unionByName(part)
    return out


@query(_REPLIES + """, x AS (SELECT avg((answer IS NOT DISTINCT FROM 'yes')::INT) AS a, coalesce(count(*) FILTER (answer = 'yes') / nullif(count(*) FILTER (answer IN ('yes', 'no')), 0), 0) AS b, avg((answer IS NOT DISTINCT FROM 'idk')::INT) AS c, avg(coverage) AS d FROM r)
SELECT unnest(['model: m', printf('accuracy: %.4f', a), printf('recall (without idk): %.4f', b), printf('idk_ratio: %.4f', c), printf('mean_coverage: %.4f', d), 'answers: ' || (SELECT string_agg(a || ': ' || n, ', ' ORDER BY a) FROM (SELECT coalesce(answer, 'null') AS a, count(*) AS n FROM r GROUP BY 1))]) AS line FROM x""")
def console_report(spark, sf):
    """What an evaluation of the documents says on the console, but for the seconds."""
    judged = runs.judge(_asked(spark, sf), None, offline_chat, runs.Evaluation(pause=0.0, allow_idk=True)).select("id", "answer", "reasoning", "coverage", "failed")
    found = metrics.evaluate(_asked(spark, sf).select("id"), stored(judged, "judged"), "m").withColumn("seconds", F.lit(1.0))
    return spark.createDataFrame([(x,) for x in runs.report(found).splitlines() if not x.startswith("seconds")], "line string")
