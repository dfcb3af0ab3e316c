"""Hand-made fixtures for the column rules: cleaning (P3, P4), HTML text
(P2, P5, P6), answer shaping (A1-A6) and request validation (R1).
Expected values were derived with Python's own regex engine."""

import pytest
from pyspark.sql import functions as F

from kbforge.functions.answers import fence_context, format_answer, format_answers, truncate_context
from kbforge.functions.cleaning import clean_markdown, clean_structured
from kbforge.functions.html import main_text, meta_description, page_title
from kbforge.operators.retrieval import BAD_TYPE, EMPTY_QUERY, validate_requests

P3 = [
    ("intro\n### Cookies used by Google Analytics blah\nmore Close  \nbody", "intro\nbody"),
    ("## Cookies on this site xyz\nManage my preferences\nbody", "body"),
    ("a\nAccept all cookies now\nb", "a\nb"),
    ("Skip to main content\nText", "Text"),
    ("Allow analytics cookies yes\nno Close\nrest", "rest"),
    ("x\n[Share to Facebook] a\nb [Print This Page] c\nd", "x\nd"),
    ("[Back to top] z\nend", "end"),
    ("Intro\n12.34\nNext", "Intro\nNext"),
    ("Body\n## Manage\nManage preferences", "Body"),
    ("[\n# Title", "# Title"),
    ("a\n\n\n\nb", "a\n\nb"),
    ("a  \t b", "a b"),
    ("  plain text  ", "plain text"),
    ("", ""),
]
P4 = [
    ("A notice about cookies blah\nmore Service rest\nbody", "Service rest\nbody"),
    ("A notice about cookies without the s-word\nbody", "A notice about cookies without the s-word\nbody"),
    ("body\nManage cookie preferences\nfoo", "body"),
    ("body\n### Manage cookie preferences\nfoo", "body\n###"),
    ("body\nCookie preferences here Close  ", "body"),
    ("a\n\n\n\nb", "a\n\nb"),
]


def one_col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_structured_clean_rules(spark):
    assert one_col(spark, [a for a, _ in P3], clean_structured) == [b for _, b in P3]


def test_markdown_clean_rules(spark):
    assert one_col(spark, [a for a, _ in P4], clean_markdown) == [b for _, b in P4]


TITLES = [
    ("<title>First Home Scheme</title><h1>Grant Info</h1>", "Grant Info"),
    ("<title>First Home Scheme</title><p>x</p>", "First Home Scheme"),
    ("<title>All about cookies and more stuff here</title><h1>Other</h1>", "All about cookies and more stuff here"),
    ("<title></title><h1></h1>", "No title"),
    ("<html><body>no title</body></html>", "No title"),
    ("<title> A &amp; B </title>", "A & B"),
    ("<h1>Hello <b>World</b></h1>", "HelloWorld"),
    ("<TITLE>Upper Case Tag</TITLE>", "Upper Case Tag"),
]


def test_page_title(spark):
    assert one_col(spark, [a for a, _ in TITLES], page_title) == [b for _, b in TITLES]


def test_meta_description(spark):
    pages = ['<meta name="description" content="Desc &amp; more">', "<meta charset='utf-8'>", ""]
    assert one_col(spark, pages, meta_description) == ["Desc & more", "", ""]


MAIN = [
    (
        "<body><nav>N</nav><article>A</article><main><p>M1</p><p> M2 </p></main><footer>F</footer></body>",
        "M1\nM2",
    ),
    ("<body><header>H</header><div>ad</div><article><h1>T</h1><p>A &copy; B</p></article></body>", "T\nA © B"),
    ("<html><body><p>x</p><script>var t=\"</p>\";</script><!-- c --><p>y</p></body></html>", "x\ny"),
    ("<p>no body</p><style>p{}</style>text", "no body\ntext"),
    ("<body><article><p>unclosed<p>second", "unclosed\nsecond"),
]


def test_main_text(spark):
    assert one_col(spark, [a for a, _ in MAIN], main_text) == [b for _, b in MAIN]


def test_format_web(spark):
    got = one_col(spark, ["- a\n* b\n\n\n\nDUBLIN and dublin Ireland. Dubliner", "", None], lambda c: format_answer(c, "web"))
    assert got == ["• a\n• b\n\n**Dublin** and **Dublin** **Ireland**. Dubliner", "", None]


@pytest.mark.parametrize(
    "text,want",
    [
        ("One. Two. Three. Four", "One. Two. Three.\n\nFour"),
        ("A. B. C. D. E. F.", "A. B. C.\n\nD. E. F.."),
        ("A. B. C", "A. B. C"),
        ("Dublin and DUBLIN", "**Dublin** and DUBLIN"),
        ("· item\n• other", "- item\n- other"),
    ],
)
def test_format_ui(spark, text, want):
    df = spark.createDataFrame([(text,)], "r string")
    assert format_answers(df, "r", "ui").collect()[0]["formatted"] == want
    assert df.select(format_answer("r", "ui")).collect()[0][0] == want


def test_truncate_context(spark):
    vals = ["   ", None, "x" * 1000, "y" * 1001, "short"]
    got = one_col(spark, vals, truncate_context)
    assert got == ["No context data available", "No context data available", "x" * 1000, "y" * 1000 + "... (truncated)", "short"]


def test_fence_context(spark):
    vals = ['{"a": 1}', "[bad", "", "plain"]
    got = one_col(spark, vals, fence_context)
    assert got == ['```json\n{"a": 1}\n```', "```\n[bad\n```", "No context data available", "```\nplain\n```"]


def test_validate_requests(spark):
    rows = [(1, "  q1 ", None), (2, "q2", " local"), (3, "q3", "LOCAL"), (4, "   ", "drift"), (5, "q5", "drift"), (6, None, "basic")]
    df = spark.createDataFrame(rows, "request_id long, query string, search_type string")
    got = {r["request_id"]: (r["query"], r["search_type"], r["error"]) for r in validate_requests(df).collect()}
    assert got[1] == ("q1", "global", None)
    assert got[2] == ("q2", " local", BAD_TYPE)
    assert got[3] == ("q3", "local", None)
    assert got[4] == ("", "drift", EMPTY_QUERY)
    assert got[5] == ("q5", "drift", BAD_TYPE)
    assert got[6] == ("", "basic", EMPTY_QUERY)


def test_tags_with_quoted_signs_and_unicode_space(spark):
    from pyspark.sql import functions as F

    from kbforge.functions.evaluation import capital_term_set
    from kbforge.functions.html import main_text
    from kbforge.functions.text import strip_ws

    html = "<body><a title='a>b'>link</a><p>one\ntwo </p><p> three </p><b class=\"x'\">don't</b></body>"
    df = spark.createDataFrame([(html, "  x　", "First Home and Cork")], "h string, s string, t string")
    r = df.select(main_text("h").alias("h"), strip_ws("s").alias("s"), F.sort_array(capital_term_set("t")).alias("t")).first()
    assert r["h"] == "link\none\ntwo\nthree\ndon't" and r["s"] == "x"
    assert r["t"] == ["Cork", "First Home"]
