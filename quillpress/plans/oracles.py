"""For each query that SQL can express, SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from ..functions.lexicon import APPROVED, FREQUENCY, PROTECTED
from ..operators.restructure import LEGEND
from . import expected as X
from .views import CUSTOMERS, DOCUMENTS, MD_CONVERSATIONS, MD_EVENTS, MD_GEO, MD_ORDERS, PAGES

#: Lines of md as rows (doc_id, pos, line).
LINES = """
parts AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM md),
l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line, len(p) AS n FROM parts) WHERE NOT (pos = n - 1 AND line = ''))
"""
#: Lines of md as rows, split at line ends only.
PIECES = "l AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM md))"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TITLE = r"""'^[\p{L}\p{N}\-_ &,./():;!?''"@#$%+=~`]+$'"""


def text_sql(view: str, expression: str, name: str = "output") -> str:
    return f"WITH {view} SELECT doc_id, {expression} AS {name} FROM md"


def lines_sql(view: str, select: str, more: str = "") -> str:
    return f"WITH {view}, {LINES} {more} {select}"


def _nested(text: str, pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_OPERATORS = [(f" {x} ", x) for x in ("=", "+", "-", "*", "/", "==", "!=", "<", ">", "<=", ">=", "&&", "||")]
#: Spaces after ( [ , and before ) ] ; }.
_SPACES = r"regexp_replace(regexp_replace({}, '([(\[,]) ', '\1', 'g'), ' ([)\];}}])', '\1', 'g')"
_LANGUAGES = [(f"{fence}{a} ", f"{fence}{b} ") for a, b in (("python", "py"), ("bash", "sh"), ("javascript", "js"), ("typescript", "ts"), ("markdown", "md")) for fence in ("{``````", "{````")]
#: A document's lines joined again, in order, each ended.
AGAIN = "SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS text FROM"
_T = TRIM.format("line")
_TITLED = rf"""CASE WHEN contains({_T}, ': ') AND regexp_matches(split_part({_T}, ': ', 1), {TITLE}) THEN split_part({_T}, ': ', 1)
  WHEN ends_with({_T}, ':') AND regexp_matches({_T}[:-2], {TITLE}) THEN {_T}[:-2] END"""
_REST = TRIM.format("CASE WHEN contains(line, ': ') THEN line[instr(line, ': ') + 2:] ELSE '' END")
_LEVEL3 = rf"""
, titled AS (SELECT *, {_TITLED} AS title, {_REST} AS rest FROM l WHERE line <> ''),
third AS (SELECT doc_id, pos, CASE
    WHEN title IS NOT NULL THEN CASE WHEN rest <> '' THEN title || ': ' || rest ELSE title || ':' END
    WHEN regexp_matches({_T}, '^[+!] ') THEN CASE WHEN starts_with(line, ' ') THEN '  ' ELSE '' END || {_T}
    WHEN regexp_matches(line, '^\s*[-*] ') THEN CASE WHEN starts_with(line, ' ') THEN '  ' ELSE '' END || '- ' || regexp_replace({_T}, '^(?:- )*(?:\* )*', '')
    ELSE line END AS line FROM titled),
joined AS ({AGAIN} third GROUP BY doc_id),
outs AS (SELECT doc_id, coalesce(j.text, '') AS output, md.text AS before FROM md LEFT JOIN joined j USING (doc_id))
"""
_HEADING = rf"""(starts_with({_T}, '#') OR (ends_with({_T}, ':') AND NOT regexp_matches({_T}, '^[`\[]') AND regexp_replace({_T}, ':+$', '') <> ''
  AND strlen(regexp_replace({_T}, ':+$', '')) < 80 AND (NOT contains(regexp_replace({_T}, ':+$', ''), ' ') OR regexp_matches(regexp_replace({_T}, ':+$', ''), '^[\p{{L}}\p{{N}}\-_ ]+$'))))"""
_SCORES = ", ".join(f"('{w}', {s})" for w, s in FREQUENCY.items())
_SHORT = "CASE WHEN strlen(word) <= 3 AND NOT regexp_matches(word, '^\\p{Lu}') THEN 0.3 ELSE 0 END"
_KEPT = ", ".join(f"'{w}'" for w in sorted(PROTECTED))


def _list(view: str, expression: str, name: str) -> str:
    """doc_id and a list joined by slashes."""
    return f"WITH {view} SELECT doc_id, array_to_string({expression}, '/') AS {name} FROM md"


def _aggregated(view: str, value: str, where: str, name: str, again: str = PIECES, order: str = "pos") -> str:
    """doc_id and the values of the lines that hold them, joined by slashes."""
    return f"WITH {view}, {again}, f AS (SELECT doc_id, string_agg({value}, '/' ORDER BY {order}) AS x FROM (SELECT doc_id, pos, {_T} AS line FROM l) WHERE {where} GROUP BY doc_id) SELECT doc_id, coalesce(x, '') AS {name} FROM md LEFT JOIN f USING (doc_id)"


_CORPUS = f"""WITH a AS (WITH {MD_GEO} SELECT * FROM md), b AS (WITH {MD_CONVERSATIONS} SELECT doc_id + 1000 AS doc_id, text FROM md), md AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""

ORACLE_SQL: dict[str, str] = {
    "savings_by_lang": """
        WITH per AS (
          SELECT lang, strlen(text) // 4 AS b, strlen(regexp_replace(text, ' +', ' ', 'g')) // 4 AS a FROM documents
        ), total AS (
          SELECT lang, count(*) AS n_docs, CAST(sum(b) AS BIGINT) AS input_tokens, CAST(sum(a) AS BIGINT) AS output_tokens FROM per GROUP BY lang
        )
        SELECT *, round(CASE WHEN input_tokens > 0 THEN greatest(input_tokens - output_tokens, 0) / CAST(input_tokens AS DOUBLE) * 100 ELSE 0 END, 4) AS savings_pct FROM total
    """,
    "token_stats": "SELECT doc_id, strlen(text) AS n_bytes, CAST(strlen(text) // 4 AS BIGINT) AS n_tokens FROM documents",
    "strip_html_comments": text_sql(PAGES, "regexp_replace(text, '<!--(?s:.*?)-->', '', 'g')"),
    "strip_url_protocol": text_sql(MD_ORDERS, _nested("text", [(x, "") for x in ("https://", "http://", "file://", "ftp://")])),
    "strip_frontmatter": text_sql(MD_ORDERS, r"regexp_replace(text, '\A---\n(?s:.*?)\n---\n', '')"),
    "collapse_blank_lines": text_sql(MD_ORDERS, r"regexp_replace(text, '\n+', chr(10), 'g')"),
    "strip_edges": lines_sql(DOCUMENTS, "SELECT doc_id, coalesce(x, '') AS output FROM md LEFT JOIN o USING (doc_id)", rf""",
        s AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM l WHERE regexp_matches(line, '\S') GROUP BY doc_id),
        o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS x FROM l JOIN s USING (doc_id) WHERE pos BETWEEN a AND b GROUP BY doc_id)"""),
    "strip_short_comments": lines_sql(MD_EVENTS, "SELECT doc_id, text AS output FROM o", f", o AS ({AGAIN} l WHERE NOT (regexp_matches({_T}, '^(#|//|--|%|;)') AND strlen({_T}) < 20) GROUP BY doc_id)"),
    "minify_code": text_sql(MD_ORDERS, _nested(_SPACES.format("text"), _OPERATORS)),
    "level3": lines_sql(MD_ORDERS, "SELECT doc_id, output FROM outs", _LEVEL3),
    "level3_guarded": lines_sql(
        MD_ORDERS,
        "SELECT doc_id, CASE WHEN strlen(g) < strlen(before) THEN g ELSE before END AS output FROM guarded",
        _LEVEL3 + f", marked AS (SELECT DISTINCT doc_id, true AS m FROM third WHERE regexp_matches({_T}, '^[-+!] ')), guarded AS (SELECT outs.*, CASE WHEN m THEN '{LEGEND.strip()}' || chr(10) ELSE '' END || output AS g FROM outs LEFT JOIN marked USING (doc_id))",
    ),
    "fence_lang_shorten": text_sql(MD_EVENTS, _nested("replace(text, '```json' || chr(10), '{````python ')", _LANGUAGES)),
    "legend_flag": lines_sql(DOCUMENTS, f"SELECT doc_id, coalesce(bool_or(regexp_matches({_T}, '^[-+!] ')), false) AS has_markers FROM md LEFT JOIN l USING (doc_id) GROUP BY doc_id"),
    "dict_expand": f"{_CORPUS} SELECT doc_id, rtrim(text, chr(10)) AS output FROM md",
    "dict_entries": f"{_CORPUS} SELECT doc_id, key, value FROM md, (VALUES ('@m1', 'AIR'), ('@m10', 'RAIL')) AS t(key, value)",
    "size_guard": text_sql(MD_ORDERS, "CASE WHEN strlen(replace(text, 'https://', '')) < strlen(text) THEN replace(text, 'https://', '') ELSE text END"),
    "size_filter": "SELECT doc_id FROM documents WHERE strlen(text) >= 50",
    "has_fenced_code": text_sql(MD_ORDERS, "contains(text, '```')", "fenced"),
    "parse_checklists": lines_sql(MD_ORDERS, "SELECT doc_id, pos, contains(line, '[x]') AS checked, line[7:] AS text FROM l WHERE regexp_matches(line, '^- \\[[x ]\\] ')"),
    "strip_markdown": text_sql(MD_ORDERS, TRIM.format(r"regexp_replace(regexp_replace(text, '\*\*(.+?)\*\*', '\1', 'g'), '`([^`]+)`', '\1', 'g')")),
    "fence_parity": lines_sql(MD_ORDERS, "SELECT doc_id, pos, starts_with(line, '```') AS is_fence, NOT starts_with(line, '```') AND sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS in_code FROM l"),
    "normalize_headings": lines_sql(MD_ORDERS, f"{AGAIN} n GROUP BY doc_id", r""",
        c AS (SELECT *, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 OR starts_with(line, '```') AS code FROM l),
        n AS (SELECT doc_id, pos, CASE WHEN NOT code AND regexp_matches(line, '^ {0,3}#{1,6}[ \t]+[^ \t]') THEN lower(regexp_extract(line, '^ {0,3}#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$', 1)) || ':' ELSE line END AS line FROM c)"""),
    "compress_tables": lines_sql(MD_ORDERS, f"{AGAIN} t GROUP BY doc_id", rf""",
        p AS (SELECT *, regexp_matches(line, '^\s*\|.*\|\s*$') AS piped FROM l),
        i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, piped ORDER BY pos) AS island FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, piped, island ORDER BY pos) AS nth,
          array_to_string(list_transform(string_split(regexp_replace(line, '^\s*\||\|\s*$', '', 'g'), '|'), lambda x: {TRIM.format("x")}), ' ') AS short FROM i),
        w AS (SELECT *, piped AND count(*) OVER g > 2 AND coalesce(max(CASE WHEN nth = 2 THEN CAST(regexp_matches(line, '^\s*\|(\s*:?-+:?\s*\|)+\s*$') AS INT) END) OVER g, 0) = 1
          AND sum(CASE WHEN nth = 2 THEN 0 ELSE strlen(short) + 1 END) OVER g <= sum(strlen(line) + 1) OVER g AS tab FROM k WINDOW g AS (PARTITION BY doc_id, piped, island)),
        t AS (SELECT doc_id, pos, CASE WHEN tab THEN short ELSE line END AS line FROM w WHERE NOT tab OR nth <> 2)"""),
    "compress_list_items": lines_sql(MD_ORDERS, f"{AGAIN} m GROUP BY doc_id", r""",
        x AS (SELECT *, regexp_extract(line, '^(\s*)([-*] )(.*?)\s*$', 3) AS item, regexp_matches(line, '^\s*[-*] ') AS listed FROM l),
        k AS (SELECT *, CASE WHEN listed AND strlen(item) <= 50 AND NOT contains(item, ',') THEN regexp_extract(line, '^\s*') END AS key FROM x),
        i AS (SELECT *, sum(CASE WHEN key = lag_key THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY pos) AS lag_key FROM k)),
        m AS (SELECT doc_id, min(pos) AS pos, CASE WHEN count(*) > 1 THEN min(key) || '- ' || string_agg(item, ', ' ORDER BY pos) ELSE min(line) END AS line FROM i GROUP BY doc_id, island)"""),
    "parse_headings": lines_sql(MD_ORDERS, "SELECT * FROM t WHERE title IS NOT NULL", f", t AS (SELECT doc_id, pos, {_TITLED} AS title FROM l)"),
    "level4_groups": lines_sql(MD_ORDERS, f"{AGAIN} g GROUP BY doc_id", rf""",
        t AS (SELECT *, {_TITLED} AS title FROM l),
        r AS (SELECT *, CASE WHEN title IS NOT NULL THEN {_REST} ELSE {_T} END AS rest, sum(CAST(title IS NOT NULL AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM t),
        g AS (SELECT doc_id, min(pos) AS pos, arg_min(title, pos) FILTER (title IS NOT NULL) || '{{' || coalesce(string_agg(rest, ' ' ORDER BY pos) FILTER (rest <> ''), '') || '}}' AS line FROM r WHERE island > 0 GROUP BY doc_id, island)"""),
    "section_numbers": lines_sql(MD_CONVERSATIONS, f"SELECT doc_id, pos, CAST(greatest(1, sum(CAST({_HEADING} AS INT)) OVER (PARTITION BY doc_id ORDER BY pos)) AS BIGINT) AS section FROM l"),
    "dedup_lines": lines_sql(DOCUMENTS, "SELECT md.doc_id, coalesce(o.text, '') AS text FROM md JOIN o USING (doc_id)", rf""",
        s AS (SELECT *, {_T} AS t, CAST(greatest(1, sum(CAST({_HEADING} AS INT)) OVER (PARTITION BY doc_id ORDER BY pos)) AS BIGINT) AS section FROM l),
        f AS (SELECT *, row_number() OVER w AS rn, first_value(section) OVER w AS fs FROM s WINDOW w AS (PARTITION BY doc_id, t ORDER BY pos)),
        r AS (SELECT doc_id, pos, CASE WHEN rn > 1 AND strlen(t) >= 20 AND NOT regexp_matches(t, '^[#`]') THEN '[see §' || fs || ']' ELSE line END AS line FROM f),
        o AS ({AGAIN} r GROUP BY doc_id)"""),
    "dedup_blocks_candidates": lines_sql(DOCUMENTS, "SELECT doc_id, n_lines, strlen(block) AS n_bytes, count(*) AS n, min(pos) AS first_pos FROM b WHERE strlen(block) >= 30 AND regexp_matches(block, '\\S') GROUP BY doc_id, n_lines, block HAVING count(*) > 1", """,
        a AS (SELECT doc_id, pos, list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ahead FROM l),
        b AS (SELECT doc_id, pos, n_lines, array_to_string(ahead[1:n_lines], chr(10)) AS block FROM (SELECT doc_id, pos, ahead, unnest(range(3, len(ahead) + 1)) AS n_lines FROM a))"""),
    "dict_seed_counts": f"WITH {DOCUMENTS}, s AS (SELECT doc_id, substr(text, i, 12) AS seed FROM (SELECT doc_id, text, unnest(range(1, length(text) - 11)) AS i FROM md)) SELECT doc_id, seed, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 4",
    "word_scores": rf"""WITH f(word, score) AS (VALUES {_SCORES}), w AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1)
        SELECT word, n, CAST(score AS DOUBLE) AS score, round(CAST(score AS DOUBLE) + {_SHORT}, 4) AS removal_score FROM w JOIN f USING (word)""",
    "filler_share": rf"""WITH f(fw, score) AS (VALUES {_SCORES}), w AS (SELECT doc_id, unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}''_-]+')) AS word FROM documents),
        s AS (SELECT doc_id, word, coalesce(CAST(score AS DOUBLE), 0) + {_SHORT} AS score FROM w LEFT JOIN f ON fw = lower(word) WHERE word <> ''),
        c AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (score >= 0.6 AND lower(word) NOT IN ({_KEPT})) AS n_filler FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_filler, 0) AS n_filler FROM documents LEFT JOIN c USING (doc_id)""",
    "grammar_coverage_anti": r"""WITH a AS (SELECT unnest(string_split_regex(text, '[^\p{L}\p{N}]+')) AS word FROM conversations), b AS (SELECT unnest(string_split_regex(text, '[^\p{L}\p{N}]+')) AS word FROM benchmark)
        SELECT word, count(*) AS n FROM a WHERE word <> '' AND word NOT IN (SELECT word FROM b) GROUP BY word""",
    "extract_structure": f"""WITH h AS ({_aggregated(MD_ORDERS, "CASE WHEN starts_with(line, '#') THEN lower(trim(regexp_replace(trim(regexp_replace(line, '^#+', '')), ':+$', ''))) ELSE lower(trim(line[:-2])) END", "(starts_with(line, '#') AND regexp_matches(line, '^#+[ ]*[^# :]')) OR (NOT starts_with(line, '#') AND ends_with(line, ':') AND regexp_matches(trim(line[:-2]), '^[\\p{L}\\p{N}-]+$'))", 'headings')}),
        i AS ({_aggregated(MD_ORDERS, "line[3:]", "regexp_matches(line, '^[-*] ')", 'list_items')}),
        t AS ({_aggregated(MD_ORDERS, "array_to_string(list_transform(list_filter(string_split(line, '|')[2:], lambda c: c <> '' AND trim(c) <> '-'), lambda c: trim(c)), ',')", "starts_with(line, '|') AND ends_with(line, '|')", 'table_rows')})
        SELECT * FROM h JOIN i USING (doc_id) JOIN t USING (doc_id)""",
    "extract_headings": _aggregated(MD_ORDERS, r"lower(trim(regexp_replace(regexp_replace(regexp_replace(line, '^#+\s*', ''), '[*_~`]', '', 'g'), '\s+', ' ', 'g')))", "starts_with(line, '#')", "headings"),
    "extract_code_languages": _list(MD_ORDERS, r"list_transform(regexp_extract_all(text, '```([\p{L}\p{N}_]+)', 1), lambda x: CASE x WHEN 'py' THEN 'python' ELSE x END)", "languages"),
    "extract_code_lines": _list(MD_ORDERS, rf"list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '```[\p{{L}}\p{{N}}_]*\n((?s:.*?))```', 1), lambda b: string_split(b, chr(10)))), lambda x: {TRIM.format('x')}), lambda x: x <> '')", "code"),
    "extract_tables": f"""WITH {MD_ORDERS}, {PIECES}, c AS (SELECT doc_id, pos, unnest(range(len(x))) AS j, trim(unnest(x)) AS cell FROM (SELECT doc_id, pos, string_split({_T}, '|') AS x FROM l WHERE starts_with({_T}, '|') AND ends_with({_T}, '|') AND NOT regexp_matches({_T}, '^\\|[\\s:-]+\\|$'))),
        f AS (SELECT doc_id, string_agg(cell, '/' ORDER BY pos, j) AS x FROM c WHERE cell <> '' AND NOT regexp_matches(cell, '^[-:\\s]+$') GROUP BY doc_id) SELECT doc_id, coalesce(x, '') AS cells FROM md LEFT JOIN f USING (doc_id)""",
    "extract_links": _list(MD_ORDERS, r"regexp_extract_all(regexp_replace(text, 'https://(\S+)', '[order](https://\1)', 'g'), '\[([^\]]+)\]\(([^)]+)\)', 2)", "links"),
    "extract_list_items": _aggregated(MD_ORDERS, r"trim(regexp_replace(line, '^[-*]\s+', ''))", r"regexp_matches(line, '^[-*]\s+')", "items"),
    "extract_inline_code": _list(MD_ORDERS, "list_filter(regexp_extract_all(replace(text, '**', '`'), '`([^`]+)`', 1), lambda x: regexp_matches(x, '[^ |]'))", "code"),
    "extract_blockquotes": _aggregated(MD_GEO.replace("'- '", "'> '").replace("'  - '", "'  > '").replace("chr(10) || '  > '", "chr(10) || '  > '"), "trim(line[3:])", "starts_with(line, '> ')", "quotes"),
    "set_compare": f"""WITH {MD_ORDERS} SELECT doc_id, 1.0::DOUBLE AS precision, CASE WHEN doc_id % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, CASE WHEN doc_id % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS f1,
        1 AS orig, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS comp, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS common FROM md""",
    "answer_overlap_f1": r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM conversations),
        p AS (SELECT b.conv_id, b.rn, a.w AS x, b.w AS y, len(list_intersect(a.w, b.w)) AS common FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.rn + 1 = b.rn),
        q AS (SELECT *, common / greatest(len(y), 1) AS p, common / greatest(len(x), 1) AS r FROM p)
        SELECT conv_id, CAST(rn AS INTEGER) AS rn, round(CASE WHEN len(x) > 0 THEN CASE WHEN len(y) > 0 THEN 2 * p * r / greatest(p + r, 0.001) ELSE 0 END END, 4) AS f1 FROM q""",
    "flatten_nested_lists": f"WITH {MD_GEO} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^## Region\\n- ', '## Region' || chr(10)), '\\n  - ', ':   '), '\\n  - ', ',   ', 'g') AS output FROM md",
    "minify_l0": f"WITH {MD_ORDERS} SELECT doc_id, text AS output, CAST(strlen(text) // 4 AS BIGINT) AS input_tokens, CAST(strlen(text) // 4 AS BIGINT) AS output_tokens, 0.0::DOUBLE AS savings_pct FROM md",
    "apply_structure_l1": text_sql(MD_ORDERS, "replace(replace(substr(text, 5), '**Status:**', 'Status:'), '***' || chr(10), '')"),
    "inline_tiny_sections": lines_sql(MD_ORDERS, "SELECT doc_id, text AS output FROM o", rf"""
        , c AS (SELECT *, sum(CAST(starts_with(line, '```') AS INT)) OVER w % 2 = 1 OR starts_with(line, '```') AS code, regexp_replace(lead(line) OVER w, '^\s+|\s+$', '', 'g') AS below FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        m AS (SELECT *, NOT code AND ends_with(line, ':') AND NOT regexp_matches(line, '^[ @]') AND coalesce(below, '') <> '' AND strlen(below) <= 50 AND NOT regexp_matches(below, '^[-*] ') AND NOT ends_with(below, ':') AS merges FROM c),
        k AS (SELECT *, coalesce(lag(merges) OVER (PARTITION BY doc_id ORDER BY pos), false) AS taken FROM m),
        o AS (SELECT doc_id, string_agg(CASE WHEN merges THEN regexp_replace(line, ':+$', '') || ': ' || below ELSE line END, chr(10) ORDER BY pos) || chr(10) AS text FROM k WHERE NOT taken GROUP BY doc_id)"""),
    "compress_code_blocks": lines_sql(MD_ORDERS, "SELECT doc_id, text AS output FROM o", rf"""
        , c AS (SELECT *, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AND NOT starts_with(line, '```') AS code FROM l),
        k AS (SELECT doc_id, pos, CASE WHEN code THEN {_nested(_SPACES.format("line"), _OPERATORS)} ELSE line END AS line FROM c
              WHERE NOT code OR (regexp_matches(line, '\S') AND NOT (regexp_matches({_T}, '^#') AND strlen({_T}) < 20))),
        o AS ({AGAIN} k GROUP BY doc_id)"""),
    "strip_code_comments": "SELECT event_id AS doc_id, chr(10) || 'let u = \"http://a/b\";  f(' || event_id || ') ' || chr(10) AS output FROM events",
}

ORACLE_SQL["level4"] = f"""WITH g AS ({ORACLE_SQL["level4_groups"]}) SELECT doc_id, '---' || chr(10) || {_nested("text", _LANGUAGES)} AS output FROM g"""
ORACLE_SQL["apply_structure_l3"] = f"""WITH t AS ({ORACLE_SQL["compress_tables"]})
  SELECT doc_id, replace(replace(replace(replace(replace(text, '**Status:**', 'Status:'), '***' || chr(10), ''), '- [x] ', '+ '), '- [ ] ', '! '), '# Order ' || doc_id || chr(10), 'order ' || doc_id || ':' || chr(10)) AS output FROM t"""


def _note(name: str) -> str:
    """What a setting makes of a customer's note."""
    note, dotted = X.GRID[name]
    return f"CASE WHEN doc_id % 10 = 0 THEN {X.sql(dotted)} ELSE {X.sql(note)} END"


#: All runs of the notes (doc_id, config, level, output, bytes).
_RUNS = "runs AS (SELECT *, strlen(output) AS bytes FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS config, {name[1]} AS level, {_note(name)} AS output FROM cust" for name in X.GRID) + "))"
_WORDS = "SELECT doc_id, unnest(string_split_regex(output, '[^\\p{L}\\p{N}]+')) AS word FROM runs WHERE config = "
_REMOVED = f"""gone AS (SELECT word, count(*) AS n, lower(word) IN ({", ".join(f"'{w}'" for w in sorted(APPROVED))}) AS approved
  FROM ({_WORDS} 'L2') w WHERE strlen(word) > 1 AND NOT EXISTS (SELECT 1 FROM ({_WORDS} 'L2_g') g WHERE g.doc_id = w.doc_id AND g.word = w.word) GROUP BY word)"""


def templated_sql(template: str) -> str:
    return f"WITH {CUSTOMERS} SELECT doc_id, {X.sql(template)} AS output FROM cust"


def minified_sql(name: str) -> str:
    sizes = "CAST(strlen(text) // 4 AS BIGINT) AS input_tokens, CAST(strlen(output) // 4 AS BIGINT) AS output_tokens"
    return f"""WITH {CUSTOMERS}, pairs AS (SELECT doc_id, {_note("L0")} AS text, {_note(name)} AS output FROM cust), sized AS (SELECT doc_id, output, {sizes} FROM pairs)
        SELECT *, CASE WHEN input_tokens > 0 THEN greatest(input_tokens - output_tokens, 0) / CAST(input_tokens AS DOUBLE) * 100 ELSE 0.0 END AS savings_pct FROM sized"""


#: Of a whole note: how many items each check looks for; all are found unless the output is lost.
_ITEMS = {"headings": 4, "code_content": 3, "tables": 9, "links": 1, "lists": 5, "inline_code": 2, "blockquotes": 1}
_LOST, _BARE = "doc_id % 3 = 1", "doc_id % 10 = 0"


def _check(name: str, n: int) -> str:
    """A check's columns: a bare heading has one heading and nothing else, and what is not there has a recall of -1."""
    absent = "false" if name == "headings" else _BARE
    size = f"CASE WHEN {_BARE} THEN {int(name == 'headings')} ELSE {n} END"
    recall = f"CASE WHEN {absent} THEN -1.0 WHEN {_LOST} THEN 0.0 ELSE 1.0 END"
    return f"{recall} AS {name}_recall, {size} AS {name}_orig, CASE WHEN {_LOST} THEN 0 ELSE {size} END AS {name}_found, {absent} OR NOT ({_LOST}) AS {name}_pass"


_CHECKED = f"""{CUSTOMERS}, sized AS (SELECT doc_id, length({_note("L0")}) AS original_chars, CASE WHEN {_LOST} THEN 0 ELSE length({_note("L4_gd")}) END AS compressed_chars FROM cust),
checked AS (SELECT doc_id, round((1 - compressed_chars / original_chars) * 100, 1) AS savings_pct, original_chars, compressed_chars, {", ".join(_check(*x) for x in _ITEMS.items())},
  CASE WHEN {_LOST} AND NOT {_BARE} THEN 0.0 ELSE 1.0 END AS languages_recall, CASE WHEN {_BARE} THEN 0 ELSE 1 END AS languages_orig, CASE WHEN {_BARE} OR {_LOST} THEN 0 ELSE 1 END AS languages_common, NOT ({_LOST} AND NOT {_BARE}) AS languages_pass,
  CASE WHEN NOT {_LOST} THEN CASE WHEN {_BARE} THEN 2 ELSE 8 END WHEN {_BARE} THEN 1 ELSE 0 END AS checks_passed, CASE WHEN {_BARE} THEN 2 ELSE 8 END AS checks_total, NOT ({_LOST}) AS pass FROM sized)"""
_MEANS = ", ".join(f"round(coalesce(avg({k}_recall) FILTER ({k}_recall >= 0), 0.0), 3) AS {k}_recall" for k in _ITEMS)
_STRUCTURE = {"headings": (4, 1), "lists": (5, 0), "tables": (4, 0)}  # of a note and of a bare heading; only level 1 keeps their form

ORACLE_SQL |= {
    "strip_code_comments_by_language": f"WITH {CUSTOMERS} " + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS language, {X.sql(left)} AS output FROM cust" for name, (_, left) in X.COMMENTED.items()),
    "grammar_strip": templated_sql(X.PROSE_STRIPPED),
    "deduplicate": templated_sql(X.REPEATS_REPLACED),
    "dictionary_compress": templated_sql(X.PATHS_CODED),
    "squeeze_code": f"WITH {CUSTOMERS} SELECT doc_id, CASE WHEN {_BARE} THEN {X.sql(X.DOTTED)} ELSE {X.sql(X.NOTE_L1_CODE)} END AS output FROM cust",
    "minify_l1": minified_sql("L1"),
    "minify_l2": minified_sql("L2"),
    "minify_l3": minified_sql("L3"),
    "minify_l4": minified_sql("L4_gd"),
    "config_grid_savings": f"""WITH {CUSTOMERS}, {_RUNS}, total AS (SELECT config, CAST(sum(bytes // 4) AS BIGINT) AS tokens, CAST(sum(bytes) AS BIGINT) AS bytes FROM runs GROUP BY config)
        SELECT *, (1 - bytes / (SELECT bytes FROM total WHERE config = 'L0')) * 100 AS savings_pct FROM total""",
    "monotonicity": f"""WITH {CUSTOMERS}, {_RUNS}, bare AS (SELECT doc_id, level, bytes, lag(bytes) OVER (PARTITION BY doc_id ORDER BY level) AS previous FROM runs WHERE length(config) = 2)
        SELECT doc_id, level, bytes, previous FROM bare WHERE bytes > previous""",
    "structure_preservation": f"WITH {CUSTOMERS}, n AS (SELECT count(*) FILTER (NOT {_BARE}) AS notes, count(*) FILTER ({_BARE}) AS bare FROM cust) "
    + "SELECT config, "
    + ", ".join(f"notes * {a} + bare * {b} AS {k}_total, CASE WHEN config = 'L1' THEN notes * {a} + bare * {b} ELSE 0 END AS {k}_match" for k, (a, b) in _STRUCTURE.items())
    + " FROM n, (VALUES ('L1'), ('L2'), ('L3'), ('L4')) c(config)",
    "removed_words": f"WITH {CUSTOMERS}, {_RUNS}, {_REMOVED} SELECT * FROM gone",
    "grammar_coverage": f"""WITH {CUSTOMERS}, {_RUNS}, {_REMOVED} SELECT CAST(sum(n) AS BIGINT) AS total_removed, CAST(coalesce(sum(n) FILTER (approved), 0) AS BIGINT) AS in_frequency_table, CAST(coalesce(sum(n) FILTER (NOT approved AND regexp_matches(word, '^\\p{{Lu}}+$')), 0) AS BIGINT) AS protected_removed,
        CAST(coalesce(sum(n) FILTER (NOT approved AND NOT regexp_matches(word, '^\\p{{Lu}}+$')), 0) AS BIGINT) AS unexpected, coalesce(array_to_string(list(word ORDER BY word) FILTER (NOT approved), ','), '') AS unexpected_words FROM gone""",
    "dictionary_reversibility": f"WITH {CUSTOMERS} SELECT count(*) FILTER (NOT {_BARE}) AS files_with_dict, count(*) FILTER (NOT {_BARE}) AS fully_reversible, '' AS issues FROM cust",
    "recall_checks": f"WITH {_CHECKED} SELECT * FROM checked",
    "threshold_gate": f"WITH {_CHECKED} SELECT doc_id, checks_passed, checks_total FROM checked WHERE NOT pass",
    "corpus_summary": f"""WITH {_CHECKED} SELECT count(*) AS n_docs, count(*) FILTER (pass) AS n_pass, CAST(sum(original_chars) AS BIGINT) AS original_chars, CAST(sum(compressed_chars) AS BIGINT) AS compressed_chars,
        round((1 - sum(compressed_chars) / sum(original_chars)) * 100, 1) AS savings_pct, CAST(min(CAST(pass AS INT)) AS INT) AS all_pass, round(avg(languages_recall), 3) AS code_languages_recall, {_MEANS} FROM checked""",
}
