"""Texts of a page are computed once, however often a rule looks at them."""

from pyspark.sql import functions as F

from kbforge.functions.cleaning import clean_structured
from kbforge.functions.html import DROPPED_BLOCKS, main_text, page_title
from kbforge.functions.text import once


def test_once(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    got = df.select(once("t", lambda t: F.concat(F.coalesce(t, F.lit("-")), F.coalesce(t, F.lit("+")))).alias("x"))
    assert [r["x"] for r in got.collect()] == ["aa", "-+"]


def test_blocks_are_dropped_once(spark):
    pages = spark.createDataFrame([(1, "<title>Home</title><h1>A guide</h1><nav>x</nav><main>Hi <b>you</b></main>")], "page_id long, html string")
    text = pages.select(clean_structured(main_text("html")).alias("t"), page_title("html").alias("title"))
    plan = text._jdf.queryExecution().optimizedPlan().toString()
    for tag in DROPPED_BLOCKS:
        assert plan.count(f"</{tag}") == 1, tag
    assert tuple(text.first()) == ("Hi\nyou", "A guide")
