"""DuckDB SQL with the same results as ``workload.queries``, written the plain way: positions from
text prefixes, blocks from window functions, folds with list_reduce."""

from __future__ import annotations

import re

from codeloom.constants import rules as R
from codeloom.constants.levels import (
    CODE_INDICATORS, OTHER_OPERATOR_WORDS, PYTHON_NESTING_WORDS, PYTHON_OPERATOR_WORDS,
)
from codeloom.functions.regex import INLINE_SPACE_RANGES, SPACE_CHARS, SPACE_RANGES
from workload import corpus

NL = "chr(10)"
WORD = r"[\p{L}\p{N}_]"
SPACE = f"[{SPACE_RANGES}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = text(SPACE_CHARS)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern as an SQL literal for RE2; the caller has taken look-arounds out."""
    pattern = re.sub(r"(?<!\\)([*+?])\+", r"\1", pattern)  # possessive loops are an aid to Java only
    keep = pattern.replace(r"[\s\S]", "\0")
    keep = keep.replace(r"\w", WORD).replace(r"\s", SPACE).replace("\0", r"[\s\S]")
    return text(("(?i)" if ignore_case else "") + keep)


def words(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def contains_any(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(p)})" for p in parts) + ")"


def newlines(column: str) -> str:
    return f"(length({column}) - length(replace({column}, {NL}, '')))"


def count(column: str, part: str) -> str:
    return f"((length({column}) - length(replace({column}, {text(part)}, ''))) // {len(part)})"


# Rules -----------------------------------------------------------------------------------------

QUOTED_WORD = r"['\"]\w+['\"]"


def oracle_pattern(rule: R.Rule) -> tuple[str, str]:
    """(pattern literal, condition on the match `hit`)."""
    pattern, condition = rule.pattern, "true"
    lookahead = rf"(?!{QUOTED_WORD})"
    if lookahead in pattern:
        head = pattern.split(lookahead)[0]
        pattern = pattern.replace(lookahead, "")
        condition = f"NOT regexp_matches(hit, {re2('^' + head + QUOTED_WORD)})"
    pattern = pattern.replace("(?!=)", "")
    for part in rule.drop_literals:
        condition += f" AND NOT contains(hit, {text(part)})"
    return re2(pattern, rule.ignore_case), condition


def hits_sql(rules) -> str:
    """Every match of every rule with position, line, column."""
    selects = []
    for rule in rules:
        pattern, condition = oracle_pattern(rule)
        selects.append(
            f"SELECT project, path, language, text, {text(rule.rule_id)} AS rule_id, {text(rule.type)} AS type, "
            f"{text(rule.severity or '')} AS severity, {text(rule.level or '')} AS level, "
            f"{text(rule.message)} AS template, i, gap, hit, before, ({condition}) AS kept FROM ("
            f"SELECT *, coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY project, path ORDER BY i "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ("
            f"SELECT project, path, language, text, unnest(string_split_regex(text, {pattern})[:len(hits)]) AS gap, "
            f"unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i FROM ("
            f"SELECT project, path, language, text, regexp_extract_all(text, {pattern}) AS hits FROM typed "
            f"WHERE family = {text(rule.family)}) WHERE len(hits) > 0))"
        )
    union = " UNION ALL ".join(selects)
    return f"""
SELECT project, path, language, rule_id, type, severity, level, template, hit, text, position,
       length(prefix) - length(replace(prefix, {NL}, '')) + 1 AS line,
       length(string_split(prefix, {NL})[-1]) + 1 AS col
FROM (SELECT *, (before + length(gap))::BIGINT AS position, substring(text, 1, (before + length(gap))::BIGINT) AS prefix
      FROM ({union}) WHERE kept)"""


# Common table expressions ----------------------------------------------------------------------

DQ = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
SQ = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
TEMPLATE = r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
TRIPLE = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
SLASHES = r"//[^\n]*|/\*[\s\S]*?\*/"
HASH = r"#[^\n]*"
TOKENS = {
    "family = 'python'": f"{TRIPLE}|{HASH}|{DQ}|{SQ}",
    "family = 'js'": f"{SLASHES}|{DQ}|{SQ}|{TEMPLATE}",
    "language = 'ruby'": rf"=begin[\s\S]*?=end|{HASH}|{DQ}|{SQ}",
    "language = 'php'": f"{HASH}|{SLASHES}|{DQ}|{SQ}",
    "family IN ('rust', 'other') AND language NOT IN ('ruby', 'php')": f"{SLASHES}|{DQ}|{SQ}",
}

_token_rows = " UNION ALL ".join(
    f"SELECT project, path, unnest(string_split_regex(text, {text(p)})[:len(hits)]) AS gap, unnest(hits) AS hit, "
    f"unnest(range(1, len(hits) + 1)) AS i FROM (SELECT project, path, text, "
    f"regexp_extract_all(text, {text(p)}) AS hits FROM typed WHERE {condition}) WHERE len(hits) > 0"
    for condition, p in TOKENS.items()
)

_first_line = (
    f"coalesce(sum({newlines('gap')} + {newlines('hit')}) OVER (PARTITION BY project, path ORDER BY i "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {newlines('gap')}"
)


def _touched(condition: str) -> str:
    return f"""
SELECT project, path,
       sum(last_line - first_line + 1 - CASE WHEN first_line = previous THEN 1 ELSE 0 END)::BIGINT AS n
FROM (SELECT *, lag(last_line) OVER (PARTITION BY project, path ORDER BY i) AS previous
      FROM token_lines WHERE {condition})
GROUP BY project, path"""


_strip = f"trim(l, {WS})"
PY_CODE = f"regexp_replace(text, {text('|'.join([TRIPLE, DQ, SQ, HASH]))}, '', 'g')"
JS_CODE = f"regexp_replace(text, {text('|'.join([SLASHES, DQ, SQ, TEMPLATE]))}, '', 'g')"
JS_STATEMENTS = f"regexp_replace(text, {text('(' + '|'.join([DQ, SQ, TEMPLATE]) + ')|' + SLASHES)}, '\\1', 'g')"
INLINE = f"[{INLINE_SPACE_RANGES}]*"
JS_NAME = (
    r"(?m)^" + INLINE + r"(?:(?:public|private|protected|static|async|override|abstract|get|set)\s+)*\*?"
    r"([#0-9A-Za-z_$]+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{}=;()]+)?\{"
)
NOT_METHODS = ("if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else")
_NUMBER = r"\b\d+(?:\.\d+)?\b"
_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"' + r"|'[^'\\]*(?:\\.[^'\\]*)*'"

_python_structure = f"""
SELECT project, path, code, list_reduce(
  [{{'w': x.w, 'o': x.o, 'f': x.f, 'outer_indent': -1, 'classes': 0, 'functions': 0, 'methods': 0}} FOR x IN steps],
  lambda a, x: {{'w': x.w, 'o': x.o, 'f': x.f,
    'outer_indent': CASE WHEN a.outer_indent >= 0 AND x.w > a.outer_indent THEN a.outer_indent WHEN x.o THEN x.w ELSE -1 END,
    'classes': a.classes + CASE WHEN x.o THEN 1 ELSE 0 END,
    'functions': a.functions + CASE WHEN x.f AND NOT (a.outer_indent >= 0 AND x.w > a.outer_indent) THEN 1 ELSE 0 END,
    'methods': a.methods + CASE WHEN x.f AND a.outer_indent >= 0 AND x.w > a.outer_indent THEN 1 ELSE 0 END}},
  {{'w': 0, 'o': false, 'f': false, 'outer_indent': -1, 'classes': 0, 'functions': 0, 'methods': 0}}) AS s
FROM (SELECT project, path, code,
        [{{'w': length(l) - length(ltrim(l, {WS})),
           'o': regexp_matches(ltrim(l, {WS}), {re2(r'^class' + r'\s+\w+')}),
           'f': regexp_matches(ltrim(l, {WS}), {re2(r'^(?:async\s+)?def\s+\w+')})}}
         FOR l IN string_split(code, {NL}) IF {_strip} <> ''] AS steps
      FROM (SELECT project, path, {PY_CODE} AS code FROM typed WHERE family = 'python'))"""

_js_structure = f"""
SELECT project, path, language,
  len(regexp_extract_all(code, {text(r'(^|[^0-9A-Za-z_$.])class' + SPACE + r'+[A-Za-z_$]')})) AS classes,
  len(regexp_extract_all(code, {text(r'(^|[^0-9A-Za-z_$.])function' + r'\b' + SPACE + r'*\*?' + SPACE + r'*[0-9A-Za-z_$]*' + SPACE + r'*[(<]')}))
    + {count('code', '=>')}
    + len(list_filter(regexp_extract_all(code, {re2(JS_NAME)}, 1), lambda n: NOT list_contains({words(NOT_METHODS)}, n))) AS functions,
  list_transform(list_filter(regexp_extract_all(replace(statements, ';', ';' || {NL}), {re2(r'(?m)^' + INLINE + r'(import' + r'\b[^\n]*)')}, 1),
    lambda l: NOT regexp_matches(l, {re2(r'^import\s*[(.]')})), lambda l: rtrim(l, {WS})) AS imports,
  CASE WHEN language IN ('typescript', 'tsx') THEN len(regexp_extract_all(code, {re2(r'(?m)^' + INLINE + r'(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+\w+')})) ELSE 0 END AS interfaces,
  CASE WHEN language IN ('typescript', 'tsx') THEN len(regexp_extract_all(code, {re2(r'(?m)^' + INLINE + r'(?:export\s+)?(?:declare\s+)?type\s+\w+\s*(?:<[^=;]*>)?\s*=')})) ELSE 0 END AS types
FROM (SELECT project, path, language, {JS_CODE} AS code, {JS_STATEMENTS} AS statements FROM typed
      WHERE family = 'js' AND NOT is_definition)"""

_definitions = f"""
SELECT project, path, n AS loc,
  blank_n::BIGINT AS blanks,
  s.comments::BIGINT AS comments,
  s.interfaces::BIGINT AS interfaces,
  s.types::BIGINT AS types,
  s.functions::BIGINT AS functions
FROM (SELECT project, path, len(kept) AS n, len(list_filter(kept, lambda l: {_strip} = '')) AS blank_n,
  list_reduce([{{'t': {_strip}, 'inside': false, 'comments': 0, 'interfaces': 0, 'types': 0, 'functions': 0}} FOR l IN kept IF {_strip} <> ''],
    lambda a, x: {{'t': x.t,
      'inside': CASE WHEN a.inside OR starts_with(x.t, '/*') THEN NOT contains(x.t, '*/') ELSE false END,
      'comments': a.comments + CASE WHEN a.inside OR starts_with(x.t, '//') OR starts_with(x.t, '/*') THEN 1 ELSE 0 END,
      'interfaces': a.interfaces + CASE WHEN a.inside OR starts_with(x.t, '//') OR starts_with(x.t, '/*') THEN 0
        WHEN contains(x.t, 'interface ') THEN 1 ELSE 0 END,
      'types': a.types + CASE WHEN a.inside OR starts_with(x.t, '//') OR starts_with(x.t, '/*') OR contains(x.t, 'interface ') THEN 0
        WHEN contains(x.t, 'type ') AND contains(x.t, '=') THEN 1 ELSE 0 END,
      'functions': a.functions + CASE WHEN a.inside OR starts_with(x.t, '//') OR starts_with(x.t, '/*') OR contains(x.t, 'interface ')
          OR (contains(x.t, 'type ') AND contains(x.t, '=')) THEN 0
        WHEN contains(x.t, 'function ') OR contains(x.t, 'method(') THEN 1 ELSE 0 END}},
    {{'t': '', 'inside': false, 'comments': 0, 'interfaces': 0, 'types': 0, 'functions': 0}}) AS s
  FROM (SELECT project, path,
          CASE WHEN content = '' THEN []::VARCHAR[] WHEN ends_with(content, {NL}) THEN string_split(content, {NL})[:-2] ELSE string_split(content, {NL}) END AS kept
        FROM typed WHERE is_definition))"""

_cognitive = f"""
SELECT project, path, list_reduce(
  [{{'i': length(l) - length({_strip}),
     'n': ends_with({_strip}, ':') AND {contains_any(_strip, PYTHON_NESTING_WORDS)}, 'c': 0, 'd': 0}}
   FOR l IN string_split(text, {NL}) IF {_strip} <> ''],
  lambda a, x: {{'i': x.i, 'n': x.n, 'c': a.c + CASE WHEN x.n THEN a.d + 1 ELSE 0 END,
    'd': CASE WHEN x.n THEN a.d + 1 WHEN x.i < a.d * 4 THEN (x.i // 4)::INTEGER ELSE a.d END}},
  {{'i': 0, 'n': false, 'c': 0, 'd': 0}}).c AS cognitive
FROM typed WHERE family = 'python' AND text <> ''
UNION ALL
SELECT project, path, list_reduce(
  [{{'o': {count('l', '{')}, 'x': {count('l', '}')}, 'c': 0, 'd': 0}} FOR l IN string_split(text, {NL}) IF contains(l, '{{') OR contains(l, '}}')],
  lambda a, x: {{'o': x.o, 'x': x.x, 'c': a.c + CASE WHEN x.o > 0 THEN a.d + 1 ELSE 0 END,
    'd': greatest(0, a.d + x.o - x.x)::INTEGER}},
  {{'o': 0, 'x': 0, 'c': 0, 'd': 0}}).c
FROM typed WHERE family = 'js' AND text <> ''"""

_words_in = lambda values: f"len(list_filter(words, lambda w: list_contains({words(values)}, w)))"
_branches = (
    "1 + {base} + len(regexp_extract_all(text, '(^|[^\\p{{L}}\\p{{N}}_])else" + SPACE.replace("{", "{{").replace("}", "}}")
    + "+if([^\\p{{L}}\\p{{N}}_]|$)')) + {amp} + {bar} + {mark}"
)


def _branch_count(values) -> str:
    return _branches.format(
        base=_words_in(values), amp=count("text", "&&"), bar=count("text", "||"), mark=count("text", "?")
    )


_lexical = f"""
SELECT project, path, language, family, text,
  CASE WHEN family = 'python' THEN {_branch_count(('if', 'for', 'while', 'case', 'catch', 'elif', 'except'))}
       WHEN family = 'js' THEN {_branch_count(('if', 'for', 'while', 'case', 'catch'))} ELSE 1 END AS cyclomatic,
  list_concat(symbols, list_filter(words, lambda w: CASE WHEN family = 'python' THEN list_contains({words(PYTHON_OPERATOR_WORDS)}, w)
    ELSE list_contains({words(OTHER_OPERATOR_WORDS)}, w) END)) AS operators,
  list_concat(list_concat(list_filter(words, lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT
    CASE WHEN family = 'python' THEN list_contains({words(PYTHON_OPERATOR_WORDS)}, w)
    ELSE list_contains({words(OTHER_OPERATOR_WORDS)}, w) END), numbers), strings) AS operands
FROM (SELECT project, path, language, family, text,
        regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS words,
        regexp_extract_all(text, '[+\\-*/=<>!&|^~%]+') AS symbols,
        regexp_extract_all(text, {text(_NUMBER)}) AS numbers,
        regexp_extract_all(text, {text(_STRING)}) AS strings
      FROM typed WHERE text <> '')"""

_line_rows = f"""
SELECT project, path, family, i, l, {_strip} AS s, length(l) - length(ltrim(l, {WS})) AS indent
FROM (SELECT project, path, family, unnest(lines) AS l, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT project, path, family, string_split(text, {NL}) AS lines FROM typed WHERE text <> ''))"""

_function_rules = [
    R.Rule(f"fn{i}", "fn", "js", "fn", pattern) for i, (pattern, _) in enumerate(R.JS_FUNCTIONS)
] + [R.Rule("fn_py", "fn", "python", "fn", R.PYTHON_FUNCTION)]


def _name_of() -> str:
    cases = " ".join(
        f"WHEN {text(rule.rule_id)} THEN regexp_extract(hit, {re2(rule.pattern)}, 1)" for rule in _function_rules
    )
    return f"CASE rule_id {cases} END"


_functions = f"""
SELECT h.project, h.path, h.language, {_name_of()} AS name, h.line, h.col, h.position,
       (coalesce(p.next_filled, p.all_filled) - p.filled)::BIGINT AS length
FROM fn_hits h JOIN (
  SELECT project, path, i, filled, max(filled) OVER (PARTITION BY project, path) AS all_filled,
    min(CASE WHEN s <> '' AND indent = 0 THEN filled - 1 END) OVER (PARTITION BY project, path ORDER BY i
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_filled
  FROM (SELECT *, sum(CASE WHEN s <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY project, path ORDER BY i) AS filled
        FROM line_rows WHERE family = 'python')) p
  ON h.project = p.project AND h.path = p.path AND h.line = p.i
WHERE h.rule_id = 'fn_py'
UNION ALL
SELECT project, path, language, name, line, col, position, (coalesce(min(ends), any_value(n)) - line)::BIGINT AS length
FROM (SELECT h.*, {_name_of()} AS name, n.n, b.i AS ends
      FROM fn_hits h
      JOIN balance a ON h.project = a.project AND h.path = a.path AND h.line = a.i
      JOIN (SELECT project, path, max(i) AS n FROM balance GROUP BY project, path) n
        ON h.project = n.project AND h.path = n.path
      LEFT JOIN balance b ON h.project = b.project AND h.path = b.path AND b.i > h.line
        AND b.depth <= a.depth - {count("substring(a.l, h.col)", "{")}
      WHERE h.rule_id <> 'fn_py')
GROUP BY project, path, language, rule_id, name, line, col, position"""

_indicators = contains_any("body", CODE_INDICATORS)
_commented = f"""
SELECT project, path, language, first_line AS line, sum(CASE WHEN code AND i >= first_line THEN 1 ELSE 0 END)::BIGINT AS n
FROM (SELECT *, min(CASE WHEN code AND next_code THEN i END) OVER (PARTITION BY project, path, run) AS first_line
      FROM (SELECT *, lead(code) OVER (PARTITION BY project, path, run ORDER BY i) AS next_code
            FROM (SELECT *, {_indicators} AS code, i - row_number() OVER (PARTITION BY project, path ORDER BY i) AS run
                  FROM (SELECT r.project, r.path, t.language, r.i, trim(substring(r.s, length(t.comment_marker) + 1), {WS}) AS body
                        FROM line_rows r JOIN typed t ON r.project = t.project AND r.path = t.path
                        WHERE starts_with(r.s, t.comment_marker)))))
WHERE first_line IS NOT NULL
GROUP BY project, path, language, run, first_line
HAVING n >= 3"""

def _chunks_of(column: str) -> str:
    return f"""
SELECT project, path, language, i, chunk
FROM (SELECT project, path, language, i, array_to_string(lines[i:i + 5], {NL}) AS chunk
      FROM (SELECT project, path, language, lines, unnest(range(1, len(lines) - 4)) AS i
            FROM (SELECT project, path, language, string_split({column}, {NL}) AS lines FROM typed WHERE {column} <> '')))
WHERE length(trim(chunk, {WS})) >= 30"""


_repeats = """
SELECT project, path, any_value(language) AS language, list_sort(list(i))[1] AS first, list_sort(list(i))[2] AS second
FROM chunks GROUP BY project, path, chunk HAVING count(*) >= 2"""

_smells = f"""
SELECT project, path, language, rule_id, type,
  replace(template, '{{name}}', regexp_extract(hit, '^(alert|prompt|confirm)', 1)) AS message, line, col, position, severity
FROM smell_hits
UNION ALL
SELECT project, path, language, CASE WHEN n > 1000 THEN 'file_too_long' ELSE 'file_long' END, CASE WHEN n > 1000 THEN 'file_too_long' ELSE 'file_long' END,
  'File has ' || n || ' lines (recommended max: ' || CASE WHEN n > 1000 THEN 1000 ELSE 500 END || ')', 1, 1, NULL,
  CASE WHEN n > 1000 THEN 'major' ELSE 'minor' END
FROM (SELECT project, path, language, len(string_split(text, {NL})) AS n FROM typed) WHERE n > 500
UNION ALL
SELECT project, path, language, CASE WHEN length > 50 THEN 'function_too_long' ELSE 'function_long' END, CASE WHEN length > 50 THEN 'function_too_long' ELSE 'function_long' END,
  'Function ''' || name || ''' has ' || length || ' lines (recommended max: ' || CASE WHEN length > 50 THEN 50 ELSE 30 END || ')',
  line, col, position, CASE WHEN length > 50 THEN 'major' ELSE 'minor' END
FROM functions WHERE length > 30
UNION ALL
SELECT project, path, language, 'commented_code', 'commented_code', 'Found block of ' || n || ' lines of commented-out code', line, 1, NULL, 'minor'
FROM commented
UNION ALL
SELECT project, path, language, 'duplicate_code', 'duplicate_code', 'Duplicate code block (also at line ' || second || ')', first, 1, NULL, 'minor' FROM repeats
UNION ALL
SELECT project, path, language, 'duplicate_code', 'duplicate_code', 'Duplicate code block (also at line ' || first || ')', second, 1, NULL, 'minor' FROM repeats"""

_line_counts = f"""
SELECT t.project, t.path, t.language, t.family, t.is_definition, t.size_bytes, t.text, t.content,
  CASE WHEN d.loc IS NOT NULL THEN d.loc WHEN t.text = '' THEN 0 ELSE len(string_split(t.text, {NL})) END::BIGINT AS loc,
  CASE WHEN d.loc IS NOT NULL THEN d.blanks WHEN t.text = '' THEN 0
    ELSE len(list_filter(string_split(t.text, {NL}), lambda l: {_strip} = '')) END::BIGINT AS blanks,
  CASE WHEN d.loc IS NOT NULL THEN d.comments
    WHEN t.family = 'rust' THEN len(list_filter(string_split(t.text, {NL}), lambda l: starts_with({_strip}, '//')
      OR starts_with({_strip}, '/*') OR ends_with({_strip}, '*/')))
    ELSE coalesce(c.n, 0) END::BIGINT AS comments,
  coalesce(m.n, 0)::BIGINT AS marked
FROM typed t
LEFT JOIN definitions d ON t.project = d.project AND t.path = d.path
LEFT JOIN comment_touched c ON t.project = c.project AND t.path = c.path
LEFT JOIN mark_touched m ON t.project = m.project AND t.path = m.path"""

_structure = f"""
SELECT t.project, t.path, t.language, t.family,
  CASE t.family WHEN 'python' THEN p.s.classes WHEN 'js' THEN coalesce(j.classes, 0)
    WHEN 'rust' THEN {count('t.text', chr(10) + 'struct ')} + {count('t.text', chr(10) + 'trait ')} ELSE 0 END::BIGINT AS classes,
  CASE WHEN d.loc IS NOT NULL THEN d.functions ELSE CASE t.family WHEN 'python' THEN p.s.functions WHEN 'js' THEN coalesce(j.functions, 0)
    WHEN 'rust' THEN {count('t.text', chr(10) + 'fn ')} ELSE 0 END END::BIGINT AS functions,
  CASE WHEN t.family = 'python' THEN p.s.methods ELSE 0 END::BIGINT AS methods,
  CASE t.family
    WHEN 'python' THEN list_transform(regexp_extract_all(translate(p.code, ';:', {NL} || {NL}), {re2(r'(?m)^' + INLINE + r'(import\s[^\n;]+|from\s[^\n;]*?\simport' + r'\b[^\n;]*)')}, 1), lambda l: rtrim(l, {WS}))
    WHEN 'js' THEN coalesce(j.imports, []) WHEN 'rust' THEN
      list_transform(range(1, {count('t.text', chr(10) + 'use ')} + 1), lambda i: 'use_statement_' || i) ELSE [] END AS imports,
  CASE WHEN t.language IN ('typescript', 'tsx') THEN coalesce(d.interfaces, j.interfaces, 0) END::BIGINT AS interfaces,
  CASE WHEN t.language IN ('typescript', 'tsx') THEN coalesce(d.types, j.types, 0) END::BIGINT AS types
FROM typed t
LEFT JOIN definitions d ON t.project = d.project AND t.path = d.path
LEFT JOIN py_structure p ON t.project = p.project AND t.path = p.path
LEFT JOIN js_structure j ON t.project = j.project AND t.path = j.path"""

_complexity = """
SELECT *, CASE WHEN declared IS NOT NULL THEN (interfaces + declared)::DOUBLE
               WHEN text = '' THEN cyclomatic::DOUBLE
               WHEN functions > 10 OR classes > 5 THEN raw_score * 1.2::DOUBLE ELSE raw_score END AS complexity_score
FROM (SELECT *, cyclomatic * 10 + cognitive * 15 + (100 - maintainability_index) * 5 + halstead / 100 + sloc / 10 AS raw_score
FROM (SELECT *, CASE WHEN text = '' THEN 0.0::DOUBLE WHEN sloc = 0 THEN 100.0::DOUBLE ELSE
    greatest(0.0::DOUBLE, least(100.0::DOUBLE, (171 - 5.2::DOUBLE * ln(greatest(1.0::DOUBLE, halstead))
      - 0.23::DOUBLE * CASE WHEN cyclomatic = 0 THEN 1 ELSE cyclomatic END
      - 16.2::DOUBLE * ln(greatest(1, sloc)::DOUBLE)) * 100 / 171)) END AS maintainability_index
FROM (SELECT c.project, c.path, c.language, c.family, c.is_definition, c.size_bytes, c.text, c.loc, c.blanks, c.comments,
    c.loc - c.blanks - c.comments AS sloc, s.classes, s.functions, s.methods, s.imports, s.interfaces, s.types,
    d.interfaces + d.types + d.functions AS declared,
    CASE WHEN d.loc IS NOT NULL THEN d.interfaces + d.types + d.functions
         WHEN c.text = '' THEN CASE WHEN c.family IN ('python', 'js') THEN 1 ELSE 0 END
         ELSE x.cyclomatic END::BIGINT AS cyclomatic,
    coalesce(g.cognitive, 0)::BIGINT AS cognitive,
    CASE WHEN len(x.operators) > 0 AND len(x.operands) > 0 THEN
      (len(x.operators) + len(x.operands)) * log2((len(list_distinct(x.operators)) + len(list_distinct(x.operands)))::DOUBLE)
      ELSE 0.0::DOUBLE END AS halstead
  FROM line_counts c JOIN structure s ON c.project = s.project AND c.path = s.path
  LEFT JOIN definitions d ON c.project = d.project AND c.path = d.path
  LEFT JOIN lexical x ON c.project = x.project AND c.path = x.path
  LEFT JOIN cognitive g ON c.project = g.project AND c.path = g.path)))"""

LEVEL = (
    "CASE WHEN complexity_score < 50 THEN 'trivial' WHEN complexity_score < 200 THEN 'low' "
    "WHEN complexity_score < 500 THEN 'moderate' WHEN complexity_score < 1000 THEN 'high' "
    "WHEN complexity_score < 2000 THEN 'very_high' ELSE 'extreme' END"
)

_metrics = f"""
SELECT c.*, {LEVEL} AS complexity_level, coalesce(s.n, 0)::BIGINT AS n_security, coalesce(m.n, 0)::BIGINT AS n_smells,
  coalesce(r.n, 0)::BIGINT AS duplicated_lines
FROM complexity c
LEFT JOIN (SELECT project, path, count(*) AS n FROM security_hits GROUP BY ALL) s ON c.project = s.project AND c.path = s.path
LEFT JOIN (SELECT project, path, count(*) AS n FROM smells GROUP BY ALL) m ON c.project = m.project AND c.path = m.path
LEFT JOIN (SELECT project, path, 6 * count(*) AS n FROM repeats GROUP BY ALL) r ON c.project = r.project AND c.path = r.path"""

_summary = f"""
SELECT project, count(*) AS total_files, sum(loc)::BIGINT AS total_loc, sum(sloc)::BIGINT AS total_sloc, sum(comments)::BIGINT AS total_comments,
  sum(blanks)::BIGINT AS total_blanks, sum(size_bytes)::BIGINT AS project_size, sum(classes)::BIGINT AS total_classes,
  sum(functions)::BIGINT AS total_functions, sum(methods)::BIGINT AS total_methods,
  sum(n_security)::BIGINT AS n_security_total, sum(n_smells)::BIGINT AS n_smells_total,
  {', '.join(f"count(*) FILTER (complexity_level = '{name}') AS files_{name}" for name in ('trivial', 'low', 'moderate', 'high', 'very_high', 'extreme'))},
  CASE WHEN sum(sloc) > 0 AND sum(n_security) > 0 THEN greatest(0, 100 - sum(n_security)::DOUBLE / count(*) * 20) ELSE 100 END::DOUBLE AS security_score,
  CASE WHEN sum(sloc) > 0 THEN greatest(0, 100 * (1 - least(1, (sum(n_security) + sum(n_smells))::DOUBLE / sum(sloc)::DOUBLE * 5))) ELSE 100 END::DOUBLE AS code_quality_score,
  CASE WHEN sum(sloc) > 0 THEN floor(coalesce(avg(maintainability_index) FILTER (maintainability_index > 0), 0)) ELSE 0 END::BIGINT AS maintainability_score,
  CASE WHEN sum(sloc) > 0 THEN coalesce(avg(maintainability_index) FILTER (maintainability_index > 0), 0) ELSE 0 END::DOUBLE AS avg_maintainability_index,
  CASE WHEN sum(sloc) > 0 THEN coalesce(avg(cyclomatic) FILTER (cyclomatic > 0), 0) ELSE 0 END::DOUBLE AS avg_cyclomatic_complexity,
  CASE WHEN sum(sloc) > 0 THEN sum(duplicated_lines)::DOUBLE / sum(sloc)::DOUBLE ELSE 0 END::DOUBLE AS duplicated_lines_ratio
FROM metrics GROUP BY project"""

# name -> (needed names, SQL); "typed" stands for the corpus tables.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "tokens": ((), _token_rows),
    "token_lines": (
        ("tokens",),
        f"SELECT project, path, i, hit, first_line, first_line + {newlines('hit')} AS last_line, "
        "NOT ((starts_with(hit, '\"') OR starts_with(hit, '''') OR starts_with(hit, '`')) "
        "AND NOT starts_with(hit, '\"\"\"') AND NOT starts_with(hit, '''''''')) AS is_comment "
        f"FROM (SELECT *, {_first_line} AS first_line FROM tokens)",
    ),
    "comment_touched": (("token_lines",), _touched("is_comment")),
    "mark_touched": (("token_lines",), _touched("true")),
    "definitions": ((), _definitions),
    "line_counts": (("definitions", "comment_touched", "mark_touched"), _line_counts),
    "py_structure": ((), _python_structure),
    "js_structure": ((), _js_structure),
    "structure": (("definitions", "py_structure", "js_structure"), _structure),
    "cognitive": ((), _cognitive),
    "lexical": ((), _lexical),
    "complexity": (("line_counts", "structure", "definitions", "lexical", "cognitive"), _complexity),
    "security_hits": ((), hits_sql(R.SECURITY_RULES)),
    "smell_hits": ((), hits_sql(R.SMELL_RULES)),
    "pattern_hits": ((), hits_sql(R.PATTERN_RULES)),
    "fn_hits": ((), hits_sql(_function_rules)),
    "line_rows": ((), _line_rows),
    "balance": (
        ("line_rows",),
        f"SELECT *, sum({count('l', '{')} - {count('l', '}')}) OVER (PARTITION BY project, path ORDER BY i) AS depth "
        "FROM line_rows WHERE family = 'js'",
    ),
    "functions": (("fn_hits", "line_rows", "balance"), _functions),
    "commented": (("line_rows",), _commented),
    "chunks": ((), _chunks_of("text")),
    "all_chunks": ((), _chunks_of("content")),
    "repeats": (("chunks",), _repeats),
    "smells": (("smell_hits", "functions", "commented", "repeats"), _smells),
    "metrics": (("complexity", "security_hits", "smells", "repeats"), _metrics),
    "summary": (("metrics",), _summary),
}


def query(body: str, *needed: str) -> str:
    """``body`` with the corpus and the named expressions in front of it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for other in CTES[name][0]:
                add(other)
            ordered.append(name)

    for name in needed:
        add(name)
    ctes = [corpus.corpus_ctes()] + [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in ordered]
    return "WITH " + ",\n".join(ctes) + "\n" + body
