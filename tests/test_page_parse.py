"""Pages parsed once: references, nesting, regions, tables, odd rows."""

import random

from pyspark.sql import functions as F

from kbforge.functions.html import main_text
from kbforge.operators.html_tables import extract_tables, page_tree, table_sections
from kbforge.operators.ingest import compose_document, scrape
from kbforge.operators.page_parse import parse_page, parse_pages, scrape_parsed

SCHEMA = "page_id long, url string, html string, url2 string"
TABLE = "<h3>H</h3><table><tr><th>a<th>b<tr><td>1<td>x &amp; y<tr><td rowspan=2>2<td>z<tr><td>w</table>"


def test_all_character_references():
    got = parse_page("<p>&eacute;&nbsp;&#8211;&#x1F600; &notanentity; &amp;lt; &frac12</p>")
    assert got["main_text"] == "é –😀 ¬anentity; &lt; ½"


def test_blocks_end_at_their_own_end_tag():
    assert parse_page("a<nav>b<nav>c</nav>d</nav>e")["main_text"] == "a\ne"
    assert parse_page("<main>a<footer>b</main>c")["main_text"] == "a"
    assert parse_page("<script>if (a < b) { '</p>' }</script>x")["main_text"] == "x"


def test_region_outside_dropped_blocks():
    assert parse_page("<header><main>no</main></header><body>yes<article>this</article></body>")["main_text"] == "this"
    assert parse_page("<article>a</article><main>m<p>n")["main_text"] == "m\nn"
    assert parse_page("plain < text <!-- c --> more")["main_text"] == "plain < text\nmore"


def test_meta_description_takes_quoted_signs():
    assert parse_page("""<meta content='a "b" > c' name="description">""")["description"] == 'a "b" > c'
    assert parse_page("<meta name=description><meta name=description content=late>")["description"] == ""
    assert parse_page("<meta name=author content=x>")["description"] == ""


def test_stray_end_tags_of_deep_pages_take_linear_time():
    page = "<div>" * 20_000 + "</nothing>" * 200_000 + "x"
    assert parse_page(page)["main_text"] == "x"
    assert len(page_tree("a < " * 100_000).root.children) == 1


def test_random_markup_equals_a_stack(spark):
    """Main text against a plain walk over generated, well-formed trees."""
    rng = random.Random(3)

    def tree(depth):
        tag = rng.choice(["div", "b", "nav", "span", "footer", "ul"])
        words, html = [], ""
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.6:
                inner, part = tree(depth - 1)
                words, html = words + inner, html + part
            else:
                word = rng.choice(["one", "two", "three"])
                words, html = [*words, word], f"{html}<i>{word}</i>"
        return ([] if tag in ("nav", "footer") else words), f"<{tag}>{html}</{tag}>"

    for _ in range(200):
        words, html = tree(6)
        assert parse_page(html)["main_text"] == "\n".join(words)


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "  ", "x"), (3, "u", "<p>a" * 50_000, "x"), (None, "v", TABLE, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["page_id"], r["main_text"][:3], r["n_tables"]) for r in parse_pages(df).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "", 0), (3, "a\na", 0), (None, "H\na", 1)}
    assert parse_pages(df.limit(0)).count() == 0
    assert scrape_parsed(df).count() == 2


def test_one_pass_equals_the_separate_passes(spark):
    """Plain markup with tables: text, counts and sections as from patterns and
    the table operators."""
    pages = [(1, "http://a/1", f"<title>T one</title><body><p>x</p>{TABLE}{TABLE}<table></table></body>", "q"), (2, "http://a/2", "<h1>Only</h1>", "q")]
    df = spark.createDataFrame(pages, SCHEMA)
    sections = table_sections(extract_tables(df))
    want = compose_document(scrape(df, sections.select("page_id", "num_tables")), sections.select("page_id", "tables_text"))
    got = compose_document(scrape_parsed(df))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = parse_pages(df).join(df.select("page_id", main_text("html").alias("m")), "page_id")
    assert plain.where(F.col("m") != F.col("main_text")).count() == 0


def test_sections_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "u", TABLE, "x")], SCHEMA)
    plan = compose_document(scrape_parsed(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
