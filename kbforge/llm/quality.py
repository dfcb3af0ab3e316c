"""Operator 2: quality rules as one Spark projection.

``measure`` adds the counts of a text (words, characters in words, symbols,
repeated lines, words in repeated 8-word windows, stop words, bullet and
ellipsis lines, runs of letters); ``THRESHOLDS`` is a table of (rule, ratio, low,
high), and ``apply_rules`` compiles it into a projection that lists the rules
each row fails.  Built-in functions only.

Defined results: a null text counts as no words and fails the word rule; an
empty text likewise; texts of any length are measured whole; repeated rows are
judged each for itself; other columns pass through; an empty table gives an
empty table.  A ratio over zero words or lines is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import SPACES, whole_text, words

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the corpus languages (our own short lists).
STOP_WORDS = (
    "the of and to in is that it for was on are as with be at by this or from",
    "le la les de des et un une en du que qui est dans pour il au par",
    "el los las y una por con del se lo como su al o para",
    "der die das und den von zu mit ist nicht ein eine auf im dem sich",
)

#: (rule, measured ratio, lowest accepted, highest accepted); None: no limit.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "mean_word_chars", 2.0, 40.0),
    ("symbol_ratio", "symbols_per_word", None, 0.5),
    ("stop_words", "stop_word_ratio", 0.01, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    ("few_letters", "letter_runs_per_word", 0.6, None),
)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` as a struct ``row`` beside the measured counts.

    The caller's columns are kept in a struct, so none can clash with a
    measured one.  Arrays that lambdas walk are columns of an earlier
    projection that is read at least twice: the optimizer would
    otherwise build such an array again for each element.
    """
    w = WINDOW_WORDS  # the doubling below makes windows of 8
    a = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), whole_text(text_col).alias("text"))
    a = a.select(
        "row",
        "text",
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
    )
    # Windows by doubling: hashes of 2, 4, then 8 words from each place.
    for have, to, step in (("words", "pairs", 1), ("pairs", "fours", 2), ("fours", "windows", 4)):
        left = F.greatest(F.size(have) - step, F.lit(0))
        a = a.select(
            "*",
            F.zip_with(F.slice(have, F.lit(1), left), F.slice(have, F.lit(step + 1), left), lambda x, y: F.xxhash64(x, y)).alias(to),
        )
    # Only a text that repeats a window sorts them: (hash, place) by hash, the
    # places whose neighbour has the same hash, then the words they cover.
    a = a.select(
        "*",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        ).alias("sorted"),
    )
    same = lambda x, i: F.get(F.col("sorted"), i)["k"] == x["k"]
    a = a.select(
        "*",
        F.sort_array(
            F.filter(
                F.transform(
                    "sorted",
                    lambda x, i: F.when(
                        F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)), x["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        ).alias("places"),
    )
    covered = F.aggregate(
        F.transform("places", lambda p, j: F.least(F.lit(w), F.coalesce(F.get(F.col("places"), j + 1) - p, F.lit(w)))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    stop = sorted({form for line in STOP_WORDS for x in line.split() for form in (x, x.capitalize(), x.upper())})
    count = lambda c: F.size(c).cast("long")
    return a.select(
        "row",
        count("words").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        count("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        count(F.filter("words", lambda x: x.isin(*stop))).alias("n_stop_words"),
        count(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•‣·]"))).alias("n_bullet_lines"),
        count(F.filter("lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).alias("n_ellipsis_lines"),
        F.regexp_count("text", F.lit(r"\p{L}+")).cast("long").alias("n_letter_runs"),
    )


def apply_rules(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The measured table with ``failed_rules`` (names, base rules first),
    ``base_failed`` and ``kept``, compiled from the threshold table."""
    base = {
        "too_few_words": F.col("n_words") < MIN_WORDS,
        "repeated_windows": F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT,
    }
    ratios = {
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "stop_word_ratio": _ratio("n_stop_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": _ratio("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": _ratio("n_ellipsis_lines", "n_lines"),
        "letter_runs_per_word": _ratio("n_letter_runs", "n_words"),
    }
    checks = dict(base)
    for rule, ratio, low, high in thresholds:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (ratios[ratio] < low)
        if high is not None:
            bad = bad | (ratios[ratio] > high)
        checks[rule] = bad
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks.items()]))
    return measured.select(
        "*",
        (base["too_few_words"] | base["repeated_windows"]).alias("base_failed"),
        failed.alias("failed_rules"),
    ).withColumn("kept", F.size("failed_rules") == 0)


def keep_good(df: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``df`` that pass every rule, with their own columns.

    The test is tied to a row number so that it isn't moved under the
    projections: pushed down, it would hold each of their arrays many times.
    """
    judged = apply_rules(measure(df, text_col), thresholds)
    return judged.select("row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("good")).where("good").select("row.*")
