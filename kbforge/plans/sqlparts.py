"""DuckDB SQL fragments shared by the oracle queries.

These restate our operator definitions in plain SQL over the driver tables
(views ``documents``, ``benchmark``, ...).  Regexes avoid constructs where
RE2 and java.util.regex differ; DuckDB needs the ``'g'`` flag to replace
every match, as Spark does.
"""

import re

from kbforge.functions.cleaning import MARKDOWN_RULES, STRUCTURED_RULES
from kbforge.functions.evaluation import SCHEME_KEYWORDS
from kbforge.functions.html import ENTITIES
from kbforge.functions.text import WS_CLASS, WS_CODES

WS_SQL = "(" + " || ".join(f"chr({c})" for c in WS_CODES) + ")"


def strip(c: str) -> str:
    return f"trim({c}, {WS_SQL})"


def ws_tokens(c: str) -> str:
    s = strip(c)
    return f"CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, '\\s+') END"


def term_set(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'))"


def units_cte(size: int = 1200, overlap: int = 100, source: str = "documents") -> str:
    """CTEs ``toks``, ``chunks`` and ``units`` (G1) over ``source``."""
    step = size - overlap
    return f"""
toks AS (
  SELECT doc_id, {ws_tokens('text')} AS toks FROM {source}),
chunks AS (
  SELECT doc_id, toks,
         unnest(range(0, CASE WHEN len(toks) <= {size} THEN 1
                              ELSE CAST(ceil((len(toks) - {overlap}) / {step}.0) AS BIGINT) END)) AS chunk_no
  FROM toks WHERE len(toks) > 0),
units AS (
  SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(chunk_no AS VARCHAR) AS unit_id, doc_id,
         CAST(chunk_no AS INTEGER) AS chunk_no,
         CAST(chunk_no * {step} AS INTEGER) AS start_tok,
         CAST(len(list_slice(toks, chunk_no * {step} + 1, chunk_no * {step} + {size})) AS INTEGER) AS n_tokens,
         array_to_string(list_slice(toks, chunk_no * {step} + 1, chunk_no * {step} + {size}), ' ') AS text
  FROM chunks)"""


def lexical_cte(k: int, queries: str = "benchmark", qid: str = "item_id", qtext: str = "text") -> str:
    """CTEs ``qt``, ``ut``, ``lex`` (R6 over units); needs ``units_cte`` first."""
    return f""",
qt0 AS (SELECT {qid} AS query_id, {term_set(qtext)} AS terms FROM {queries}),
qt AS (SELECT query_id, CAST(len(terms) AS BIGINT) AS n_query_terms, unnest(terms) AS term FROM qt0),
ut AS (SELECT DISTINCT unit_id, term FROM (
         SELECT unit_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM units)),
m AS (SELECT query_id, unit_id, count(*) AS matched, max(n_query_terms) AS nq
      FROM ut JOIN qt USING (term) GROUP BY query_id, unit_id),
lex0 AS (SELECT query_id, unit_id, matched, round(matched / nq, 6) AS score,
                row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, unit_id) AS rank FROM m),
lex AS (SELECT query_id, unit_id, matched, score, CAST(rank AS INTEGER) AS rank FROM lex0 WHERE rank <= {k})"""


# ---- evaluation (E1-E6) ----------------------------------------------------

KEYWORDS_SQL = "[" + ", ".join(f"'{k}'" for k in SCHEME_KEYWORDS) + "]"


def number_set(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(replace({c}, ',', ''), '[\d,]+(?:\.\d+)?'))"


def capital_term_set(c: str) -> str:
    return (
        rf"list_distinct(regexp_extract_all(regexp_replace({c}, '[À-ÖØ-öø-ɏ]', '_', 'g'), "
        rf"'\b[A-Z][a-z]+(?:{WS_CLASS}+[A-Z][a-z]+)*\b'))"
    )


def keyword_set(c: str) -> str:
    return f"list_filter({KEYWORDS_SQL}, lambda k: contains(lower({c}), lower(k)))"


def recall(r: str, t: str) -> str:
    return f"(len(list_intersect({r}, {t})) / greatest(len({t}), 1))"


def factual(r: str, t: str) -> str:
    return (
        f"(0.5 * {recall(number_set(r), number_set(t))} + 0.3 * {recall(keyword_set(r), keyword_set(t))}"
        f" + 0.2 * {recall(capital_term_set(r), capital_term_set(t))})"
    )


BLEU_TOK = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"


def bleu_ctes(pairs: str, pid: str, resp: str, truth: str, eps: float = 0.1) -> str:
    """CTEs ending in ``bleu(pid, bleu_score)`` over ``pairs``."""
    def p(m, n):
        den = f"greatest(len_r - {n} + 1, 1)"
        return f"(CASE WHEN {m} > 0 THEN {m} / {den} ELSE {eps} / {den} END)"

    logs = " + ".join(f"ln({p(f'm{n}', n)}) / 4.0" for n in range(1, 5))
    return f""",
bt AS (SELECT {pid} AS pid, regexp_extract_all(lower({resp}), {BLEU_TOK}) AS rt,
              regexp_extract_all(lower({truth}), {BLEU_TOK}) AS tt FROM {pairs}),
rg AS (SELECT pid, n, array_to_string(list_slice(rt, i, i + n - 1), ' ') AS g, count(*) AS c
       FROM bt, range(1, 5) r(n), range(1, len(rt) - n + 2) s(i) GROUP BY ALL),
tg AS (SELECT pid, n, array_to_string(list_slice(tt, i, i + n - 1), ' ') AS g, count(*) AS ct
       FROM bt, range(1, 5) r(n), range(1, len(tt) - n + 2) s(i) GROUP BY ALL),
cl AS (SELECT rg.pid, rg.n, sum(least(rg.c, coalesce(tg.ct, 0))) AS m
       FROM rg LEFT JOIN tg USING (pid, n, g) GROUP BY ALL),
bagg AS (SELECT bt.pid, len(rt) AS len_r, len(tt) AS len_t,
                coalesce(max(m) FILTER (WHERE n = 1), 0) AS m1, coalesce(max(m) FILTER (WHERE n = 2), 0) AS m2,
                coalesce(max(m) FILTER (WHERE n = 3), 0) AS m3, coalesce(max(m) FILTER (WHERE n = 4), 0) AS m4
         FROM bt LEFT JOIN cl USING (pid) GROUP BY ALL),
bleu AS (SELECT pid, CASE WHEN len_r = 0 OR m1 = 0 THEN 0.0 ELSE
           (CASE WHEN len_r > len_t THEN 1.0 ELSE exp(1.0 - len_t / len_r) END) * exp({logs}) END AS bleu_score
         FROM bagg)"""


def term_cosine_ctes(pairs: str, pid: str, a: str, b: str) -> str:
    """CTEs ending in ``rel(pid, relevance)``: cosine of term-count vectors."""
    return f""",
ta AS (SELECT pid, term, count(*) AS ca FROM (
         SELECT {pid} AS pid, unnest(regexp_extract_all(lower({a}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {pairs}) GROUP BY ALL),
tb AS (SELECT pid, term, count(*) AS cb FROM (
         SELECT {pid} AS pid, unnest(regexp_extract_all(lower({b}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {pairs}) GROUP BY ALL),
dots AS (SELECT pid, sum(ca * cb) AS dot FROM ta JOIN tb USING (pid, term) GROUP BY pid),
nas AS (SELECT pid, sqrt(sum(ca * ca)) AS na FROM ta GROUP BY pid),
nbs AS (SELECT pid, sqrt(sum(cb * cb)) AS nb FROM tb GROUP BY pid),
rel AS (SELECT p.{pid} AS pid, coalesce(dot / (na * nb), 0.0) AS relevance
        FROM {pairs} p LEFT JOIN dots ON dots.pid = p.{pid} LEFT JOIN nas ON nas.pid = p.{pid}
        LEFT JOIN nbs ON nbs.pid = p.{pid})"""


def shingles(toks: str, n: int = 8) -> str:
    """Distinct n-word shingles of a token-list column ``toks``."""
    return (
        f"list_distinct(list_transform(range(1, len({toks}) - {n - 1} + 1), "
        f"lambda i: array_to_string(list_slice({toks}, i, i + {n - 1}), ' ')))"
    )


# ---- ingestion (P1-P7, P13) --------------------------------------------------

NL = "chr(10)"
def decode_entities(c: str) -> str:
    out = c
    for ent, ch in ENTITIES:
        out = f"replace({out}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return out


def drop_blocks(h: str) -> str:
    out = rf"regexp_replace({h}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "footer", "header"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return out


def region(h: str) -> str:
    whens = " ".join(
        rf"WHEN regexp_matches({h}, '(?i)<{t}\b') THEN regexp_extract({h}, '(?is)<{t}\b[^>]*>(.*?)(?:</{t}\s*>|$)', 1)"
        for t in ("main", "article", "body")
    )
    return f"(CASE {whens} ELSE {h} END)"


def text_lines(frag: str, sep: str) -> str:
    tag = """'<(?:[^>"'']+|"[^"]*"|''[^'']*'')*>|<[^>]*>'"""
    marked = f"regexp_replace(replace({frag}, chr(1), ''), {tag}, chr(1), 'g')"
    pieces = f"string_split({decode_entities(marked)}, chr(1))"
    return f"array_to_string(list_filter(list_transform({pieces}, lambda p: {strip('p')}), lambda p: p <> ''), {sep})"


def main_text(h: str) -> str:
    return text_lines(region(drop_blocks(h)), NL)


def first_element_text(h: str, tag: str) -> str:
    pat = rf"'(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>'"
    return f"(CASE WHEN regexp_matches({h}, {pat}) THEN {text_lines(f'regexp_extract({h}, {pat}, 1)', chr(39) * 2)} END)"


def page_title(h: str) -> str:
    unwanted = " OR ".join(f"contains(lower(t), '{u}')" for u in ("cookies", "analytics", "citizensinformation.ie", "home"))
    cands = f"[{first_element_text(h, 'title')}, {first_element_text(h, 'h1')}]"
    good = f"list_filter({cands}, lambda t: t IS NOT NULL AND length(t) > 0 AND (NOT ({unwanted}) OR length(t) > 20))"
    non_empty = rf"list_filter({cands}, lambda t: t IS NOT NULL AND length(regexp_replace(t, '^\s+|\s+$', '', 'g')) > 0)"
    return f"coalesce(({good})[1], ({non_empty})[1], 'No title')"


def meta_description(h: str) -> str:
    tag = rf"""regexp_extract({h}, '(?is)(<meta\b[^>]*\bname\s*=\s*["'']description["''][^>]*>)', 1)"""
    content = rf"""regexp_extract({tag}, '(?is)\bcontent\s*=\s*["'']([^"'']*)["'']', 1)"""
    return decode_entities(content)


def _literal(text: str) -> str:
    """A text without quotes as SQL; each line feed as ``chr(10)``."""
    return " || ".join(NL if part == "\n" else f"'{part}'" for part in re.split("(\n)", text) if part) or "''"


def _apply_rules(c: str, rules) -> str:
    out = c
    for pat, repl in rules:
        out = f"regexp_replace({out}, '{pat}', {_literal(repl)}, 'g')"
    return strip(out)


def clean_structured(c: str) -> str:
    return f"(CASE WHEN coalesce({c}, '') = '' THEN '' ELSE {_apply_rules(c, STRUCTURED_RULES)} END)"


def clean_markdown(c: str) -> str:
    return _apply_rules(c, MARKDOWN_RULES)


# ---- graph (G3-G9) ------------------------------------------------------------


def graph_ctes(min_chars: int = 6, max_words: int = 5, min_units: int = 2) -> str:
    """CTEs ``dd`` (deduplicated units), ``ments``, ``ents``, ``adm``, ``rels``;
    needs ``units_cte`` first."""
    return rf""",
dd AS (SELECT * FROM units WHERE unit_id IN (SELECT min(unit_id) FROM units GROUP BY md5(text))),
ms0 AS (SELECT unit_id, flatten(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'),
          lambda s, i: list_transform(
              regexp_extract_all(regexp_replace(s, '[À-ÖØ-öø-ɏ]', '_', 'g'), '\b[A-Z][a-z]+(?:{WS_CLASS}+[A-Z][a-z]+)*\b'),
              lambda n: {{'sent_no': i - 1, 'name': regexp_replace(n, '{WS_CLASS}+', ' ', 'g'),
                         'sentence': {strip('s')}}}))) AS ms FROM dd),
ments AS (SELECT unit_id, ord, m.sent_no AS sent_no, m.name AS name, m.sentence AS sentence FROM (
            SELECT unit_id, generate_subscripts(ms, 1) - 1 AS ord, unnest(ms) AS m FROM ms0)),
ents AS (SELECT name, count(*) AS frequency, count(DISTINCT unit_id) AS n_units FROM ments
         WHERE length(name) >= {min_chars} AND len(string_split(name, ' ')) <= {max_words}
         GROUP BY name HAVING count(DISTINCT unit_id) >= {min_units}),
adm AS (SELECT * FROM ments WHERE name IN (SELECT name FROM ents)),
un AS (SELECT DISTINCT unit_id, name FROM adm),
prs AS (SELECT x.unit_id, x.name AS src, y.name AS dst FROM un x JOIN un y ON x.unit_id = y.unit_id AND x.name < y.name),
rels AS (SELECT src, dst, count(*) AS weight FROM prs GROUP BY src, dst)"""


# ---- answers (A1-A6) ------------------------------------------------------------

WORD = r"\p{L}\p{N}_"


def bullets_spacing(c: str, bullet: str) -> str:
    s = rf"regexp_replace({strip(c)}, '(?m)^[•·\-*]\s+', '{bullet}', 'g')"
    return rf"regexp_replace({s}, '\n\n+', {NL} || {NL}, 'g')"


def bold_web(c: str, terms) -> str:
    """Unicode-\\b emulation: explicit boundary classes, two passes (a shared
    separator hides every second adjacent hit from the first pass), one
    placeholder character per term, placeholders expanded at the end."""
    out = c
    for k, term in enumerate(terms, start=1):
        pat = rf"'(^|[^{WORD}])(?i:{term})([^{WORD}]|$)'"
        rep = rf"'\1' || chr({k}) || '\2'"
        out = f"regexp_replace(regexp_replace({out}, {pat}, {rep}, 'g'), {pat}, {rep}, 'g')"
    for k, term in enumerate(terms, start=1):
        out = f"replace({out}, chr({k}), '**{term}**')"
    return out


def bold_ui(c: str, terms) -> str:
    alt = "|".join(terms)
    pat = rf"'(^|[^{WORD}\x01])({alt})([^{WORD}]|$)'"
    rep = r"'\1' || chr(1) || '\2' || chr(2) || '\3'"
    out = f"regexp_replace(regexp_replace({c}, {pat}, {rep}, 'g'), {pat}, {rep}, 'g')"
    return f"replace(replace({out}, chr(1), '**'), chr(2), '**')"


def regroup(parts: str, original: str) -> str:
    """A4 over a list column ``parts``."""
    grp = f"list_slice({parts}, i + 1, i + 3)"
    para = f"CASE WHEN len({grp}) = 3 THEN array_to_string({grp}, '. ') || '.' ELSE array_to_string({grp}, '. ') END"
    return (
        f"CASE WHEN len({parts}) > 3 THEN array_to_string(list_transform(range(0, len({parts}), 3), lambda i: {para}), "
        f"{NL} || {NL}) ELSE {original} END"
    )


# ---- table profile (P10-P12 re-aimed) ------------------------------------------


def _txt(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def profile_sql(table: str, cols, numeric, key: str) -> str:
    unpivot = " UNION ALL ".join(f"SELECT {i} AS ci, {_txt(c)} AS v, {key} AS k FROM {table}" for i, c in enumerate(cols))
    names = "[" + ", ".join(f"'{c}'" for c in cols) + "]"
    sample = ", ".join(f"CASE WHEN trim({_txt(c)}) <> '' THEN '{c}: ' || {_txt(c)} END" for c in cols)
    num = f"'Numeric data in: {', '.join(numeric)}', " if numeric else ""
    return f"""(WITH n AS (SELECT count(*) AS n FROM {table}),
pv AS (SELECT ci, v, min(k) AS first_k FROM ({unpivot}) GROUP BY ci, v),
nu AS (SELECT ci, count(v) AS nunique FROM pv GROUP BY ci),
f3 AS (SELECT ci, string_agg(coalesce(v, 'nan'), ', ' ORDER BY r) AS vals FROM (
         SELECT *, row_number() OVER (PARTITION BY ci ORDER BY v IS NULL, first_k) AS r FROM pv) WHERE r <= 3 GROUP BY ci),
cl AS (SELECT nu.ci, {names}[nu.ci + 1] || ' categories: ' || vals AS line, nunique FROM nu JOIN f3 USING (ci)),
ct AS (SELECT string_agg(line, '. ' ORDER BY ci) AS cats FROM cl, n
       WHERE (CASE WHEN n.n > 1 THEN nunique ELSE 1 END) <= 5 AND n.n > 3),
ex AS (SELECT array_to_string(list_filter([{sample}], lambda s: s IS NOT NULL)[1:3], ', ') AS ex
       FROM (SELECT * FROM {table} ORDER BY {key} LIMIT 1))
SELECT '{table}' AS "table", CASE WHEN n = 0 THEN 'Empty table' ELSE concat_ws('. ',
  'Table with ' || n || ' rows and {len(cols)} columns. Columns: {', '.join(cols)}', {num}
  CASE WHEN (SELECT cats FROM ct) <> '' THEN (SELECT cats FROM ct) END,
  CASE WHEN (SELECT ex FROM ex) <> '' THEN 'Example row - ' || (SELECT ex FROM ex) END) END AS summary FROM n)"""


def narrative_sql(table: str, cols, key: str) -> str:
    cells = ", ".join(f"CASE WHEN trim({_txt(c)}) <> '' THEN '{c} is ' || {_txt(c)} END" for c in cols)
    rel = f", chr(10) || 'This table shows relationships between: {', '.join(cols)}'" if len(cols) > 1 else ""
    return f"""(WITH n AS (SELECT count(*) AS n FROM {table}),
r AS (SELECT row_number() OVER (ORDER BY {key}) AS i, concat_ws(', ', {cells}) AS cells FROM {table} ORDER BY {key} LIMIT 10),
e AS (SELECT list('Entry ' || i || ': ' || cells ORDER BY i) FILTER (WHERE cells <> '') AS entries FROM r)
SELECT '{table}' AS "table", CASE WHEN n = 0 THEN 'No data available in this table.' ELSE array_to_string(
  coalesce(entries, []) || CASE WHEN n > 10 THEN ['... and ' || (n - 10) || ' more entries'] ELSE [] END {'|| [' + rel[2:] + ']' if rel else ''}, '. ') END AS narrative
FROM n, e)"""


def markdown_sql(table: str, cols, key: str) -> str:
    line = "'| ' || concat_ws(' | ', " + ", ".join(f"coalesce({_txt(c)}, 'nan')" for c in cols) + ") || ' |'"
    header = "'| " + " | ".join(cols) + " |' || chr(10) || '|" + "|".join("---" for _ in cols) + "|' || chr(10)"
    return f"""(WITH n AS (SELECT count(*) AS n FROM {table}),
b AS (SELECT string_agg(line, chr(10) ORDER BY k) AS body FROM (SELECT {key} AS k, {line} AS line FROM {table} ORDER BY {key} LIMIT 21))
SELECT '{table}' AS "table", CASE WHEN n > 0 AND n <= 20 THEN {header} || body
       ELSE 'Large table (' || n || ' rows) - see summary above' END AS markdown FROM n, b)"""
