"""Table extraction and table text (P8-P13) on hand-made pages."""

from pyspark.sql import functions as F

from kbforge.operators.html_tables import (
    extract_tables,
    parse_tables,
    table_markdown,
    table_narrative,
    table_sections,
    table_summary,
)
from kbforge.operators.ingest import compose_document, scrape

T1 = "<table><tr><th>Name</th><th>Amount</th></tr><tr><td>A</td><td>1</td></tr></table>"


def ctx(html):
    return [t[2] for t in parse_tables(html)]


def test_context_rules():
    assert ctx("<h2>Rates</h2>" + T1) == ["Section: Rates"]
    assert ctx("<p>This paragraph is long enough</p>" + T1) == ["Context: This paragraph is long enough"]
    assert ctx("<p>short</p>" + T1) == ["No context found"]
    far = "<h2>Far</h2><div>" + "".join(f"<span>{i}</span>" for i in range(5)) + "</div>" + T1
    assert ctx(far) == ["No context found"]
    near = "<h2>Near</h2><div>" + "".join(f"<span>{i}</span>" for i in range(3)) + "</div>" + T1
    assert ctx(near) == ["Section: Near"]
    cap = "<table><caption>Cap</caption><tr><td>1</td></tr></table><p>See the table above for rates</p>"
    assert ctx(cap) == ["Caption: Cap | Note: See the table above for rates"]
    no_note = "<table><tr><td>1</td></tr></table><p>Just a long paragraph here</p>"
    assert ctx(no_note) == ["No context found"]


def test_unparsable_table_keeps_its_index():
    html = "<table><tr><td>a</td></tr></table><table></table><table><tr><td>b</td></tr></table>"
    got = [(i, n, rows) for i, n, _, _, rows in parse_tables(html)]
    assert got == [(0, 3, [["a"]]), (2, 3, [["b"]])]


def test_header_detection():
    (_, _, _, cols, rows), = parse_tables(T1)
    assert cols == ["Name", "Amount"] and rows == [["A", "1"]]
    (_, _, _, cols, rows), = parse_tables("<table><tr><td>x</td><td>y</td></tr></table>")
    assert cols == ["0", "1"] and rows == [["x", "y"]]


def _tables(spark, sizes):
    data = []
    for n in sizes:
        rows = [["a" if i % 2 == 0 else "b", str(i + 1)] for i in range(n)]
        data.append((n, ["kind", "n"], rows))
    return spark.createDataFrame(data, "size int, columns array<string>, rows array<array<string>>")


def test_summary_narrative_markdown(spark):
    df = _tables(spark, [0, 3, 4, 10, 11, 20, 21]).select(
        "size",
        table_summary(F.col("columns"), F.col("rows")).alias("s"),
        table_narrative(F.col("columns"), F.col("rows")).alias("d"),
        table_markdown(F.col("columns"), F.col("rows")).alias("m"),
    )
    got = {r["size"]: r for r in df.collect()}
    assert got[0]["s"] == "Empty table"
    assert got[0]["d"] == "No data available in this table."
    assert got[0]["m"] == "Large table (0 rows) - see summary above"
    assert got[3]["s"] == "Table with 3 rows and 2 columns. Columns: kind, n. Numeric data in: n. Example row - kind: a, n: 1"
    assert got[4]["s"] == (
        "Table with 4 rows and 2 columns. Columns: kind, n. Numeric data in: n. kind categories: a, b. "
        "n categories: 1, 2, 3. Example row - kind: a, n: 1"
    )
    assert got[10]["d"].count("Entry ") == 10 and "more entries" not in got[10]["d"]
    assert got[11]["d"].endswith(". ... and 1 more entries. \nThis table shows relationships between: kind, n")
    assert got[20]["m"].startswith("| kind | n |\n|---|---|\n| a | 1 |")
    assert got[20]["m"].count("\n") == 21
    assert got[21]["m"] == "Large table (21 rows) - see summary above"


def test_compose_with_tables(spark):
    html = "<html><head><title>Grants page title</title></head><body><main><h2>Rates</h2>" + T1 + "<p>Body text</p></main></body></html>"
    pages = spark.createDataFrame([(1, "https://example.org/a", html), (2, "https://example.org/b", "")], "page_id long, url string, html string")
    tables = extract_tables(pages)
    sections = table_sections(tables)
    sc = scrape(pages, sections.select("page_id", "num_tables"))
    doc = compose_document(sc, sections.select("page_id", "tables_text")).collect()
    assert len(doc) == 1  # the empty page yields no document
    d = doc[0]
    assert d["doc_id"] == "5c31bd96c1d0"
    text = d["text"]
    assert text.startswith("# Grants page title\nSource: https://example.org/a\n\n## Main Content\n")
    assert "## Structured Data (Tables)\n\n### Table 1: Section: Rates\n**Summary**: Table with 1 rows and 2 columns" in text
    assert "**Table Data Analysis:**\nEntry 1: Name is A, Amount is 1. \nThis table shows relationships between: Name, Amount" in text
    assert "**Formatted Table:**\n| Name | Amount |" in text
    assert text.endswith("\n")
    meta = sc.collect()[0]["metadata"]
    assert meta["num_tables"] == 1 and meta["title"] == "Grants page title"


def test_implied_ends_spans_and_repeated_headers(spark):
    (_, _, _, cols, rows), = parse_tables("<table><tr><th>A<th>B<tr><td>1<td>2<tr><td>3<td>4</table>")
    assert cols == ["A", "B"] and rows == [["1", "2"], ["3", "4"]]
    html = '<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td rowspan="2">x</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>'
    (_, _, _, cols, rows), = parse_tables(html)
    assert cols == ["A", "A.1", "B"] and rows == [["x", "1", "2"], ["x", "3", "4"]]
    (_, _, _, cols, rows), = parse_tables("<table><tr><th></th><th></th></tr><tr><td>1</td><td>2</td></tr></table>")
    assert cols == ["", ".1"] and rows == [["1", "2"]]


def test_deep_pages_and_broken_tables_do_not_stop_a_job(spark):
    from kbforge.operators.html_tables import table_records

    deep = "<table>" + "<tr><td><div>a" * 3000 + "</table>"
    pages = [
        (1, "u1", deep),
        (2, "u2", "<table></table><table><tr><th></th><th></th></tr><tr><td>x</td><td>y</td></tr></table>"),
        (3, "u3", "<div>" * 5000 + T1),
        (4, "u4", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["url"]: r for r in table_records(extract_tables(df), df).collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert got["u2"]["table_index"] == 0 and got["u2"]["data"] == [{"": "x", ".1": "y"}]
    assert got["u1"]["shape"][0] >= 1
