"""The registered queries of this folder: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm import align, bpe, chat, codes, lines, maxent, mixing, ngram_join, pii, quality, repeats, sharding, vector_graph
from kbforge.llm.common import load, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def tokenizer() -> tuple[str, str]:
    """Rank file and split pattern of the installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def _quality_sql() -> str:
    """The measures and the threshold table in DuckDB's SQL."""
    space = r"[\x20\x09-\x0D]"
    stop = sorted({form for line in quality.STOP_WORDS for x in line.split() for form in (x, x.capitalize(), x.upper())})
    ratios = {
        "mean_word_chars": ("word_chars", "n_words"),
        "symbols_per_word": ("n_symbols", "n_words"),
        "stop_word_ratio": ("n_stop_words", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
        "letter_runs_per_word": ("n_letter_runs", "n_words"),
    }
    bad = ["base_failed"]
    for _, ratio, low, high in quality.THRESHOLDS:
        value = "(CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END)".format(*ratios[ratio])
        bad += [f"{value} < {low}"] * (low is not None) + [f"{value} > {high}"] * (high is not None)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k FROM w, range(1, len(w) - 6) g(i)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(0, 8) g(j) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains({stop!r}, x))) AS n_stop_words,
             len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•‣·]'))) AS n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS n_ellipsis_lines,
             len(regexp_extract_all(t, '\p{{L}}+')) AS n_letter_runs
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT ({' OR '.join(bad)}) AS kept FROM b"""


@register("op2_quality_rules", _quality_sql())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and threshold-table verdict of every document."""
    judged = quality.apply_rules(quality.measure(load(spark, sf_dir, "documents")))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@register("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes that the ids decode to."""
    rank_file, pattern = tokenizer()
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, rank_file, pattern).drop("text")
    return bpe.digests(bpe.decode(coded, rank_file, pattern))


#: Training shards that documents are placed on.
SHARDS = tuple(f"shard-{k:03d}" for k in range(256))


@register("op5_shard_placement")
def op5_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(docs, SHARDS).select("doc_id", "slot", "shard")


@register("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op1_contextual_pii")
def op1_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those added by context."""
    return pii.report(pii.extract(load(spark, sf_dir, "documents").select("doc_id", "text")))


@register("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and link component of every document."""
    joined = ngram_join.join(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "n_shingles", "component_id")


@register("op6_repeated_passages")
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 200-byte strings."""
    return repeats.report(repeats.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text")))


@register("op9_embedding_graph")
def op9_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_graph.near_duplicates(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register("op4_maxent_scores")
def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model log-probability of every document."""
    return maxent.score(load(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op7_chat_format")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from the transcripts of all conversations, rendered.
    The model learns from nine tenths of them; roles are hidden from parsing."""
    said = chat.styled(load(spark, sf_dir, "conversations"))
    learned = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))
    return chat.parse(said.select("conv_id", "turn", "text"), chat.fit(said.where(learned)))


@register("op11_vector_codes")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector, errors by label, codebooks' digest."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return codes.report(*codes.compress(vectors))


_LINE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
often AS (SELECT key FROM k WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {lines.MIN_DOCS}),
j AS (SELECT k.*, often.key IS NOT NULL AS lost FROM k LEFT JOIN often USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(lost::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY r"""


@register("op12_line_dedup", _LINE_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that many documents hold."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.report(docs, lines.keep_bitmaps(docs))


A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@register("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    import public_tokenizers

    files = public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return align.link_counts(stored(align.align(docs, *files, public_tokenizers.PATTERN)), align.vocabulary_size(files[1]))
