"""Registered queries: answer shaping and the conversation log (A1-A6, C1,
C2, C4, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbforge.functions.answers import (
    UI_BOLD_TERMS,
    WEB_BOLD_TERMS,
    fence_context,
    format_answer,
    format_answers,
    truncate_context,
)
from kbforge.operators.chatlog import pair_turns, turn_log, usage_counts
from kbforge.plans import sqlparts as S
from kbforge.plans.registry import register, table
from kbforge.sources.writers import chat_log_records

# Assistant turns are the answers.  They carry no bullets or key terms, so
# every answer is wrapped in a fixed prefix and suffix that exercise the
# rules (the SQL wraps them identically).
ANSWER_HEAD = "- first point\n* second point\n\n\n\n"
ANSWER_TAIL = "\n• dublin, DUBLIN Dublin.Ireland ireland_x Cost Rental. Housing agency. local authority Government citizen"


def _answers(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return conv.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.concat(F.lit(ANSWER_HEAD), F.col("text"), F.lit(ANSWER_TAIL)).alias("response")
    )


def _sql_lit(s: str) -> str:
    return " || chr(10) || ".join(f"'{p}'" for p in s.split("\n"))


_ANSWERS_SQL = (
    f"ans AS (SELECT conv_id, turn, {_sql_lit(ANSWER_HEAD)} || text || {_sql_lit(ANSWER_TAIL)} AS response "
    "FROM conversations WHERE role = 'assistant')"
)


@register(
    "format_answer_web",
    f"WITH {_ANSWERS_SQL}\nSELECT conv_id, turn, {S.bold_web(S.bullets_spacing('response', '• '), WEB_BOLD_TERMS)} AS formatted FROM ans",
)
def q_format_answer_web(spark, sf_dir):
    """A1 (web bullets) + A2 + A3b."""
    return _answers(spark, sf_dir).select("conv_id", "turn", format_answer("response", "web").alias("formatted"))


@register(
    "format_answer_ui",
    f"""WITH {_ANSWERS_SQL},
sh AS (SELECT conv_id, turn, {S.bold_ui(S.bullets_spacing('response', '- '), UI_BOLD_TERMS)} AS shaped FROM ans),
sp AS (SELECT *, string_split(shaped, '. ') AS parts FROM sh)
SELECT conv_id, turn, {S.regroup('parts', 'shaped')} AS formatted FROM sp""",
)
def q_format_answer_ui(spark, sf_dir):
    """A1 (UI bullets) + A2 + A3a + A4."""
    return format_answers(_answers(spark, sf_dir), "response", "ui").select("conv_id", "turn", "formatted")


@register(
    "truncate_context",
    rf"""SELECT conv_id, turn,
  CASE WHEN text IS NULL OR {S.strip('text')} = '' THEN 'No context data available'
       WHEN length(text) > 1000 THEN left(text, 1000) || '... (truncated)'
       ELSE text END AS context
FROM conversations""",
)
def q_truncate_context(spark, sf_dir):
    """A5 with every turn's text as a context."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", truncate_context("text").alias("context"))


@register(
    "fence_context",
    """SELECT conv_id, turn,
  CASE WHEN text IS NULL OR text = '' THEN 'No context data available'
       WHEN (starts_with(text, '[') OR starts_with(text, '{')) AND json_valid(text) THEN '```json' || chr(10) || text || chr(10) || '```'
       ELSE '```' || chr(10) || text || chr(10) || '```' END AS context
FROM conversations""",
)
def q_fence_context(spark, sf_dir):
    """A6 with every turn's text as a context."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fence_context("text").alias("context"))


@register("turn_log", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def q_turn_log(spark, sf_dir):
    """C1."""
    return turn_log(table(spark, sf_dir, "conversations")).withColumn("n_chars", F.col("n_chars").cast("long"))


@register(
    "pair_turns",
    """WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT conv_id, turn, text AS query, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM n WHERE role = 'user')
SELECT *, answer IS NOT NULL AS answered FROM a""",
)
def q_pair_turns(spark, sf_dir):
    """C2."""
    return pair_turns(table(spark, sf_dir, "conversations"))


@register(
    "usage_counts",
    """SELECT role, count(*) AS n_turns, round(avg(length(text)), 6) AS avg_chars, count(DISTINCT conv_id) AS n_conversations
FROM conversations GROUP BY role""",
)
def q_usage_counts(spark, sf_dir):
    """C4."""
    return usage_counts(table(spark, sf_dir, "conversations"))


@register(
    "export_log",
    """SELECT conv_id, turn,
  CASE WHEN role = 'user' THEN to_json({'type': 'user', 'query': text})
       WHEN role = 'assistant' THEN to_json({'type': 'bot', 'response': text})
       ELSE to_json({'type': 'system', 'text': text}) END AS record
FROM conversations""",
)
def q_export_log(spark, sf_dir):
    """S9 record form (one JSON object per turn)."""
    return chat_log_records(table(spark, sf_dir, "conversations"))
