import pytest

from factloom.plans.runs import quarantine, scrape
from factloom.sources.html import RULES, page_text, parse_facts, parse_index, read

EN = """<div class="mw-heading mw-heading3"><h3>1 May 2024</h3></div>
<ul><li>intro</li><li>... that <b><a href="/wiki/A_B">A B</a></b> met <a href="/wiki/C">C</a>?</li></ul>
<div class="mw-heading mw-heading2"><h2>Other</h2></div>
<ul><li>skip</li><li>y <a href="http://e.org">e</a></li></ul>"""
P = "https://en.wikipedia.org/wiki/P"


def facts(spark, lang, html, url=P, year="2024"):
    return parse_facts(spark.createDataFrame([(lang, url, year, html)], "lang string, url string, year string, html string")).orderBy("pos").collect()


def test_english(spark):
    a, b = facts(spark, "en", EN)
    root = "https://en.wikipedia.org/wiki/"
    assert (a["section"], a["text"], a["links"], a["relevant_links"]) == ("1 May 2024", "... that A B met C ?", [root + "A_B", root + "C"], [root + "A_B"])
    assert (b["section"], b["text"], b["links"]) == ("1 May 2024", "y e", [])
    assert set(a["relevant_links"]) <= set(a["links"])


def test_russian_nested_and_normalized(spark):
    html = '<div class="x ext-discussiontools-init-section"><h2>М</h2></div><div><ul><li>а<ul><li>за́мок</li></ul></li></ul></div>'
    assert [(f["section"], f["text"]) for f in facts(spark, "ru", html)] == [("М", "а замок"), ("М", "замок")]


def test_german_cards(spark):
    card = '<div class="hintergrundfarbe-basis">{}<p>Der <a href="/wiki/X%20Y">X</a> ist</p></div>'
    html = card.format('<span style="font-weight:bold">3. Mai</span>') + card.format("") + '<div class="hintergrundfarbe-basis"></div>'
    got = facts(spark, "de", html, "https://de.wikipedia.org/wiki/P")
    assert [(f["section"], f["text"], f["links"], f["relevant_links"]) for f in got] == [(s, "Der X ist", ["https://de.wikipedia.org/wiki/X Y"], None) for s in ("3. Mai", "None")]


def test_portuguese_table_comes_first(spark):
    head = '<div class="mw-heading mw-heading2"><h2>3 de Março</h2></div><p>um</p><ul><li>dois</li><li> </li></ul>'
    assert [(f["section"], f["text"]) for f in facts(spark, "pt", head)] == [("3 de Março de 2024", "um"), ("3 de Março de 2024", "dois")]
    table = '<table class="wikitable"><tr><th>h</th></tr><tr><td>a</td><td>b</td></tr><tr><td></td></tr></table>'
    assert [(f["section"], f["text"]) for f in facts(spark, "pt", head + table)] == [("2024", "a")]


def test_french_excludes_and_repeats(spark):
    html = """<div class="mw-content-ltr mw-parser-output"><ul><li>un <figure><a href="/wiki/F">f</a></figure><a href="/wiki/G">g</a>
    <dl><dd>2024-05-03</dd></dl><ul><li>deux</li></ul></li></ul></div>"""
    got = facts(spark, "fr", html, "https://fr.wikipedia.org/wiki/P")
    assert [(f["section"], f["text"]) for f in got] == [("03 Mai 2024", "un g deux"), ("2024", "deux"), ("2024", "deux")]
    assert got[0]["links"] == ["https://fr.wikipedia.org/wiki/G"]


def test_unclosed_bold_covers_what_follows_in_its_parent():
    page = read('<div class="mw-heading mw-heading3"><h3>s</h3></div><ul><li>a</li><li><b><a href="/wiki/A">A</a> x <a href="/wiki/B">B</a></li><li><a href="/wiki/C">C</a></li></ul>')
    assert [len(f.relevant) for f in RULES["en"](page, P)] == [2, 0]


def test_untitled_and_unknown_language(spark):
    html = EN.replace("<h3>1 May 2024</h3>", "")
    assert facts(spark, "en", html)[0]["section"].startswith("(")
    assert facts(spark, "xx", EN) == []
    assert facts(spark, "en", None) == []


INDEX = {
    "en": ('<div class="floatleft"><table><tr><th>2024</th><td><a href="/wiki/M1">May</a></td><td><a class="new" href="/wiki/M2">June</a></td></tr><tr><th>all</th><td><a href="/x">x</a></td></tr></table></div>', [("2024", "May", True), ("2024", "June", False)]),
    "ru": ('<div class="ts-Box-description"><ul><li>x</li></ul><ul><li><b>2024 год:</b> <a href="/wiki/M1">Май</a> <i><a href="/n">n</a></i></li></ul></div>', [("2024", "Май", True)]),
    "de": ('<div class="mw-content-ltr mw-parser-output"><table></table><table><tr><td><b>2024</b></td><td><a href="/wiki/M1">Mai</a></td><td></td></tr></table></div>', [("2024", "Mai", True)]),
    "pt": ('<table class="tmbox tmbox-notice }}"><tr><td><b><a href="/wiki/Y1">2023</a></b><b>x</b><b><a href="/wiki/Y2" class="new">2024</a></b></td></tr></table>', [("2023", None, True), ("2024", None, False)]),
    "fr": ('<div><div class="mw-heading mw-heading2 ext-discussiontools-init-section"></div><div></div><div><p><a href="/e">2000</a><a href="/wiki/Y1">2023</a><a href="/wiki/Y2">x</a></p></div></div>', [("2023", None, True)]),
}


@pytest.mark.parametrize("lang", INDEX)
def test_index(spark, lang):
    html, want = INDEX[lang]
    got = parse_index(spark.createDataFrame([(lang, f"https://{lang}.wikipedia.org/wiki/I", html)], "lang string, url string, html string")).orderBy("pos").collect()
    assert [(x["year"], x["month"], x["exists"]) for x in got] == want
    assert all(x["url"].startswith(f"https://{lang}.wikipedia.org/wiki/") for x in got)


def test_scrape_end_to_end(spark):
    archives = spark.createDataFrame([(g, f"https://{g}.wikipedia.org/wiki/I", INDEX[g][0]) for g in ("en", "fr")], "lang string, url string, html string")
    french = '<div class="mw-content-ltr mw-parser-output"><ul><li>un<dl>5 mai 2023</dl></li><li>deux</li></ul></div>'
    pages = spark.createDataFrame([("https://en.wikipedia.org/wiki/M1", EN), ("https://en.wikipedia.org/wiki/M2", EN), ("https://fr.wikipedia.org/wiki/Y1", french)], "url string, html string")
    got = {(f["lang"], f["year"], f["month"], f["text"]) for f in scrape(archives, pages).collect()}
    assert got == {("en", "2024", "May", "... that A B met C ?"), ("en", "2024", "May", "y e"), ("fr", "2023", "Mai", "un"), ("fr", "2023", "Janvier", "deux")}
    assert quarantine(archives, pages).count() == 0


def test_page_text_leaves_scripts_out(spark):
    df = spark.createDataFrame([(1, "<p> a <b>b</b><br>c<script>x</script></p>")], "page_id long, html string")
    assert page_text(df).first()["text"] == "a b c"


def test_deep_markup_and_bad_links_give_rows(spark):
    from factloom.sources.html import page_errors

    deep, item = 100_000, '<div class="mw-heading mw-heading3"><h3>s</h3></div><ul><li>0</li><li>{}</li></ul>'
    shape = "lang string, url string, year string, html string"
    nested = "<div>" * deep + "deep" + "</b></div>" * deep
    rows = [
        ("en", P, "2024", item.format(nested + '<a href="/wiki/A">a</a>')), ("en", P + "2", "2024", "<div>" * deep + item.format("open")),
        ("en", "https://[x/", "2024", item.format('<a href="/wiki/B">b</a>')), ("fr", P, "2024", '<div class="mw-content-ltr mw-parser-output"><ul><li>' + "<i>" * deep + "tief"), ("en", P, "2024", None),
    ]
    pages = spark.createDataFrame(rows, shape)
    assert sorted((f["text"], tuple(f["links"])) for f in parse_facts(pages).collect()) == [("b", ()), ("deep a", ("https://en.wikipedia.org/wiki/A",)), ("open", ()), ("tief", ())]
    assert [(r["url"], r["error"].split(":")[0]) for r in page_errors(pages).collect()] == [("https://[x/", "/wiki/B")]
    index = INDEX["en"][0].replace("</table>", '<tr><th>2023</th><td><a href="//[bad">May</a></td></tr></table>')
    archives = spark.createDataFrame([("en", P, "2024", index), ("en", P, "2024", "<table>" * deep)], shape)
    assert parse_index(archives).count() == parse_index(spark.createDataFrame([("en", P, "2024", INDEX["en"][0])], shape)).count()
    assert [r["error"].split(":")[0] for r in page_errors(archives, index=True).collect()] == ["//[bad"]
    assert page_text(spark.createDataFrame([(1, "<p>" * deep + "x <b>y"), (2, None)], "page_id long, html string")).orderBy("page_id").collect()[0]["text"] == "x y"


class Tree:
    """Pages as nested lists, and the questions put to them by walking: what the flat page has to agree with."""

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.parent, self.inside = tag, attrs or {}, parent, []

    def all(self):
        for x in self.inside:
            if isinstance(x, Tree):
                yield x
                yield from x.all()

    def strings(self, without=()):
        for x in self.inside:
            if isinstance(x, str):
                if self.tag not in ("script", "style", "template"):
                    yield x
            elif x.tag not in without:
                yield from x.strings(without)


def test_flat_pages_agree_with_a_tree():
    import random
    from html.parser import HTMLParser

    void = "area base br col embed hr img input link meta param source track wbr".split()

    class Nested(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.at = Tree("[document]")

        def handle_starttag(self, tag, attrs):
            e = Tree(tag, dict(attrs), self.at)
            self.at.inside.append(e)
            self.at = self.at if tag in void else e

        def handle_endtag(self, tag):
            e = self.at
            while e is not None and e.tag != tag:
                e = e.parent
            self.at = e.parent if e is not None else self.at

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in void:
                self.handle_endtag(tag)

        def handle_data(self, data):
            self.at.inside.append(data)

    r = random.Random(8)
    for _ in range(150):
        html = "".join(r.choice(["<b>", "</b>", "<ul>", "</ul>", "<li>", "</li>", "<i/>", "<br>", "<dl>", "</dl>", "<!-- c -->", "<script>x", "</script>", " t ", "u&amp;v", "w"]) for _ in range(r.randint(0, 60)))
        tree = Nested()
        tree.feed(html)
        tree.close()
        flat = read(html)
        pairs = [(flat, tree.root), *zip(flat.all(), tree.root.all(), strict=True)]
        for a, b in pairs:
            assert a.tag == b.tag and [x.tag for x in a.all()] == [x.tag for x in b.all()]
            for without in ((), ("dl",), ("b", "li")):
                assert list(a.strings(without)) == list(b.strings(without))
            assert [x if isinstance(x, str) else x.tag for x in a.parts()] == [x if isinstance(x, str) else x.tag for x in b.inside]
            up, p = set(), b.parent
            while p is not None:
                up.add(p.tag)
                p = p.parent
            assert [a.above(t) for t in ("b", "li", "ul")] == [t in up for t in ("b", "li", "ul")] and a.above("b", "dl") == bool(up & {"b", "dl"})
            row = [x for x in (b.parent.inside if b.parent else []) if isinstance(x, Tree)]
            assert [x.tag for x in a.after()] == [x.tag for x in row[next((i for i, x in enumerate(row) if x is b), 0) + 1 :] if b.parent]
            first = next((x for x in b.all() if x.tag in ("li", "b")), None)
            assert (a.first("li", "b") is None) == (first is None) and [x.tag for x in a.every("b", "li")] == [x.tag for x in b.all() if x.tag in ("b", "li")]


def test_facts_and_errors_of_pages_read_once(spark):
    from factloom.sources.html import facts_and_errors, page_errors, parse_facts

    body = '<div class="mw-heading mw-heading3"><h3>s</h3></div><ul><li>0</li><li><div><P><b><a href="/wiki/x">x</a></ul>'
    pages = spark.createDataFrame([("en", "https://[1", "2024", body), ("en", "https://en.wikipedia.org/wiki/y", "2024", body), ("en", "u", "2024", None)], "lang string, url string, year string, html string")
    facts, wrong = facts_and_errors(pages)
    assert sorted(map(repr, facts.collect())) == sorted(map(repr, parse_facts(pages).collect()))
    assert [r["url"] for r in wrong.collect()] == ["https://[1"] == [r["url"] for r in page_errors(pages).collect()]


def test_runs_of_tags_without_attributes_stop_at_those_with_other_content():
    from factloom.sources.html import read

    page = read("<div><B><p><script><b>x</script><i>y</i><style><u></style><hr><div>z").page
    assert page.tag == ["[document]", "div", "b", "p", "script", "i", "style", "hr", "div"] and page.text == ["<b>x", "y", "<u>", "z"]
    assert page.parent == [-1, 0, 1, 2, 3, 3, 3, 3, 3]


def test_page_text_agrees_with_its_sql_on_cut_references_and_odd_rows(spark, tmp_path):
    import duckdb

    from factloom.plans.catalog import QUERIES, SQL

    cut = ["&quot", "&quo", "&lt", "&gt", "&l", "&amp", "&am", "&", "&nbsp", "&copy", "&middot", "&#39", "&#39;", "&#x27;", "&eacute;", "&ampere", "&quotx", "&amp;lt;", "&amp;quot", "&amplt;", "&lt;b&gt;", "&AMP;", "&copy;2"]
    odd = [None, "", "<p> &nbsp; </p>", "a<3 b", "a < b", "a<<b", "1<2<b>3</b>&quot", "a <!-- b", "\x0ba\x0b", *(f"<p>{chr(c)}a{chr(c)}</p>b" for c in (0x1C, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF))]
    pages = [*(f"<title>x {c}</title><h1>{c}</h1><p><a href='{c}'>y{c}</a> z<br>" for c in cut), *(f"x{c}" for c in cut), *odd]
    ids = [None, 2**53 + 1, *range(len(pages) - 2)]
    spark.createDataFrame([*zip(ids, pages, strict=True)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(SQL["page_text"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in QUERIES["page_text"](spark, str(tmp_path)).collect())
    assert page_text(spark.createDataFrame([(1, "&quot <p>&#39;")], "page_id long, html string")).first()["text"] == "\" '"  # by itself it decodes HTML's


def test_a_sign_that_begins_no_tag_stays_in_its_text():
    assert read("<p>a<3 b<i>c < d</i>e<!-- x -->f</b>g<br>").page.text == ["a<3 b", "c < d", "e", "f", "g"]
    assert read("<<" * 100_000).page.text == ["<<" * 100_000]


def test_an_unknown_marked_section_is_a_comment():
    assert read("<p>a</p><![x y>b<![1]>c<![if IE]>d<![endif]>e<![z").page.text == ["a", "b", "c", "d", "e<![z"]
