"""Rule findings of one file: security issues, code smells and design-pattern hits.

Each kind comes in two forms. ``*_counts`` only counts matches per rule, which is all the rollups
need. ``*_findings`` also locates every match. Both are narrow: a file's findings stay an array in
its own row until a caller explodes them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.constants.levels import CODE_INDICATORS
from codeloom.constants.rules import (
    JS_FUNCTIONS, PATTERN_RULES, PYTHON_FUNCTION, SECURITY_RULES, SIEVES, SMELL_RULES, Rule,
)
from codeloom.functions.regex import INLINE_SPACE_RANGES, SPACE_RANGES, java_regex, plain
from codeloom.functions.scan import MARK, locate, locate_with_context, running, scan, split_by
from codeloom.functions.text import contains_any, let, lines_of, newlines, split_lines, strip
from codeloom.operators.complexity import brace_lines, opening
from codeloom.operators.duplicates import repeated_chunks
from codeloom.schema import EMPTY_COUNTS, EMPTY_FINDINGS, EMPTY_PATTERNS

FILE_LIMITS = (("file_too_long", "major", 1000), ("file_long", "minor", 500))
FUNCTION_LIMITS = (("function_too_long", "major", 50), ("function_long", "minor", 30))
SHORTEST_LONG_FUNCTION = 30
MIN_COMMENTED_LINES = 3


def _quoted(value: str | None) -> str:
    """A SQL string literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pack_sql(text: str, family: str, rules: Sequence[Rule], one: Callable[[Rule, bool], str]) -> str:
    """array of ``one(rule, ascii)`` for the rules of the file's family; null for other families. ``ascii`` tells that the
    text is all ASCII, so that patterns can take their ``plain`` form.

    Packs are SQL text: a pack of sixty rules is then one expression to build, and every pattern is
    a literal that Spark compiles once per task.
    """


    def of(ascii_only: bool) -> str:
        packs: dict[str, list[str]] = {}
        for rule in rules:
            packs.setdefault(rule.family, []).append(one(rule, ascii_only))
        branches = " ".join(
            f"WHEN {family} = {_quoted(name)} THEN array({', '.join(items)})" for name, items in packs.items()
        )
        return f"CASE {branches} END"

    pack = f"IF(octet_length({text}) = length({text}), {of(True)}, {of(False)})"
    if any(rule.ignore_case for rule in rules):
        pack = f"element_at(transform(array(lower({text})), low -> {pack}), 1)"
    return pack


def _by_family(text: str, family: str, rules: Sequence[Rule], one: Callable[[Rule, bool], str]) -> Column:
    return F.expr(_pack_sql(text, family, rules, one))


def _regex(rule: Rule, ascii_only: bool) -> str:
    pattern = rule.pattern if rule.sieve is None else rule.sieve.pattern
    regex = java_regex(pattern, rule.ignore_case)
    return _quoted(plain(regex) if ascii_only else regex)


def _part(text: str, rule: Rule) -> str:
    """The part of the text that the rule's pattern is tried on."""
    if rule.sieve is None or not rule.sieve.ends:
        return text
    for characters in rule.sieve.ends:
        tail = text
        for character in characters:
            tail = f"substring_index({tail}, {_quoted(character)}, -1)"
        text = f"left({text}, length({text}) - length({tail}))"
    closing = rule.sieve.closing
    return f"concat({text}, IF({text} = '', '', {_quoted(closing)}))" if closing else text


def _hits(text: str, rule: Rule, ascii_only: bool, group: int = 0) -> str:
    return f"regexp_extract_all({_part(text, rule)}, {_regex(rule, ascii_only)}, {group})"


def _marks(text: str, rule: Rule, ascii_only: bool) -> str | None:
    """For a pattern that also eats: one text per hit, empty for what was only eaten."""
    eats = rule.sieve is not None and rule.sieve.group
    return _hits(text, rule, ascii_only, rule.sieve.group) if eats else None


def _described(rule: Rule) -> str:
    """The rule's own attributes as a literal struct."""
    fields = {
        "rule_id": rule.rule_id, "type": rule.type, "severity": rule.severity, "level": rule.level,
        "message": rule.message, "name_pattern": java_regex(rule.name_pattern or "()"),
    }
    pairs = ", ".join(f"'{key}', {_quoted(value)}" for key, value in fields.items())
    drops = ", ".join(_quoted(text) for text in rule.drop_literals)
    return f"named_struct({pairs}, 'drops', cast(array({drops}) as array<string>))"


def _guarded(text: str, rule: Rule, ascii_only: bool, value: str) -> str:
    """``value`` if the file holds a text that every match needs, else null. ``low`` is the text in lower case: letters
    beyond ASCII can match ASCII ones when case is ignored, so other texts are always tried."""
    if rule.literal is None or (rule.ignore_case and not ascii_only):
        return value
    literals = (rule.literal,) if isinstance(rule.literal, str) else rule.literal
    held = " OR ".join(f"contains({'low' if rule.ignore_case else text}, {_quoted(part)})" for part in literals)
    return f"IF({held}, {value}, NULL)"


def _excused(text: Column, rule: Column) -> Column:
    return F.exists(rule["drops"], lambda part: text.contains(part))


def counts_sql(text: str, family: str, rules: Sequence[Rule]) -> str:
    """``rule_counts`` as SQL text over two names."""

    def one(rule: Rule, ascii_only: bool) -> str:
        n = f"regexp_count({_part(text, rule)}, {_regex(rule, ascii_only)})"
        if _marks(text, rule, ascii_only):
            n = f"size(filter({_marks(text, rule, ascii_only)}, mark -> mark <> ''))"
        if rule.drop_literals:
            excused = " OR ".join(f"contains(hit, {_quoted(part)})" for part in rule.drop_literals)
            n = f"size(filter({_hits(text, rule, ascii_only)}, hit -> NOT ({excused})))"
        return f"named_struct('rule', {_described(rule)}, 'n', {_guarded(text, rule, ascii_only, n)})"

    fields = ", ".join(f"'{name}', c.rule.{name}" for name in ("rule_id", "type", "severity", "level"))
    matched = f"filter({_pack_sql(text, family, rules, one)}, c -> c.n > 0)"
    return f"coalesce(transform({matched}, c -> named_struct({fields}, 'n', c.n)), {EMPTY_COUNTS})"


def rule_counts(text: str, family: str, rules: Sequence[Rule]) -> Column:
    """array<struct<rule_id,type,severity,level,n>> of the rules that match at all."""
    return F.expr(counts_sql(text, family, rules))


def _finding(rule_id, type_, message, line, col, position, level, severity) -> Column:
    return F.struct(
        rule_id.cast("string").alias("rule_id"),
        type_.cast("string").alias("type"),
        message.cast("string").alias("message"),
        line.cast("int").alias("line"),
        col.cast("int").alias("col"),
        position.cast("int").alias("position"),
        level.cast("string").alias("level"),
        severity.cast("string").alias("severity"),
    )


def _matched(text: str, family: str, rules: Sequence[Rule]) -> Column:
    """array<struct<rule,parts>> of the rules that match, the text split by each of them; ``marks`` tells hits from
    what was only eaten and is null for patterns that don't eat."""

    def one(rule: Rule, ascii_only: bool) -> str:
        regex = _regex(rule, ascii_only)
        part, group = _part(text, rule), rule.sieve.group if rule.sieve else 0
        # as functions.scan.split_by, with the group behind each hit where there is one
        tail = f"{MARK}${group}" if group else ""
        cut = f"split(regexp_replace({part}, {regex}, '{MARK}$0{tail}{MARK}'), '{MARK}', -1)"
        every = 3 if group else 2
        nth = lambda k: f"filter(p, (_, i) -> i % {every} = {k})"
        marks = nth(2) if group else "cast(null as array<string>)"
        once = (
            f"element_at(transform(array({cut}), p -> "
            f"named_struct('gaps', {nth(0)}, 'hits', {nth(1)}, 'marks', {marks})), 1)"
        )
        twice = (
            f"named_struct('gaps', split({part}, {regex}, -1), "
            f"'hits', {_hits(text, rule, ascii_only)}, "
            f"'marks', {_marks(text, rule, ascii_only) or 'cast(null as array<string>)'})"
        )
        parts = f"IF(contains({text}, '{MARK}'), {twice}, {once})"
        return f"named_struct('rule', {_described(rule)}, 'parts', {_guarded(text, rule, ascii_only, parts)})"

    return F.filter(
        _by_family(text, family, rules, one),
        lambda m: m["parts"].isNotNull() & (F.size(m["parts"]["hits"]) > 0),
    )


def _real(found: Column, parts: Column) -> Column:
    """``found``, one item per hit, without those that were only eaten."""
    marked = F.filter(found, lambda _, i: F.get(parts["marks"], i) != "")
    return F.when(parts["marks"].isNull(), found).otherwise(marked)


def _message(rule: Column, hit: Column) -> Column:
    name = F.call_function("regexp_extract", hit["text"], rule["name_pattern"], F.lit(1))
    with_line = F.replace(rule["message"], F.lit("{line}"), hit["line"].cast("string"))
    return F.when(rule["message"].contains("{name}"), F.replace(with_line, F.lit("{name}"), name)).otherwise(
        with_line
    )


def rule_findings(text: str, family: str, rules: Sequence[Rule]) -> Column:
    """array<finding>: every match of every rule, located. Overlapping rules each report."""

    def report(m: Column) -> Column:
        rule = m["rule"]
        hits = F.filter(_real(locate(m["parts"]), m["parts"]), lambda hit: ~_excused(hit["text"], rule))
        return F.transform(
            hits,
            lambda hit: _finding(
                rule["rule_id"], rule["type"], _message(rule, hit),
                hit["line"], hit["col"], hit["position"], rule["level"], rule["severity"],
            ),
        )

    found = F.flatten(F.transform(_matched(text, family, rules), report))
    return F.coalesce(found, F.expr(EMPTY_FINDINGS))


def security_findings(text: str, family: str) -> Column:
    return rule_findings(text, family, SECURITY_RULES)


def security_counts(text: str, family: str) -> Column:
    return rule_counts(text, family, SECURITY_RULES)


def pattern_findings(text: str, family: str) -> Column:
    """array<struct<rule_id,pattern,position,line,context>>."""

    def report(m: Column) -> Column:
        return F.transform(
            _real(locate_with_context(m["parts"]), m["parts"]),
            lambda hit: F.struct(
                m["rule"]["rule_id"].alias("rule_id"), m["rule"]["type"].alias("pattern"),
                hit["position"].alias("position"), hit["line"].alias("line"),
                hit["context"].alias("context"),
            ),
        )

    found = F.flatten(F.transform(_matched(text, family, PATTERN_RULES), report))
    return F.coalesce(found, F.expr(EMPTY_PATTERNS))


def pattern_counts(text: str, family: str) -> Column:
    return rule_counts(text, family, PATTERN_RULES)


# File length, function length, commented-out code, duplicates


def file_length_findings(content: Column) -> Column:
    def report(n: Column) -> Column:
        out = None
        for type_, severity, limit in FILE_LIMITS:
            message = F.concat(F.lit("File has "), n.cast("string"), F.lit(f" lines (recommended max: {limit})"))
            row = F.array(
                _finding(F.lit(type_), F.lit(type_), message, F.lit(1), F.lit(1), F.lit(None), F.lit(None),
                         F.lit(severity))
            )
            out = F.when(n > limit, row) if out is None else out.when(n > limit, row)
        return out.otherwise(F.expr(EMPTY_FINDINGS))

    return let(split_lines(content), report)


FUNCTION = "struct<name:string,line:int,col:int,position:int,length:int>"
_EMPTY_FUNCTIONS = f"cast(array() as array<{FUNCTION}>)"


def _function(name, hit, length) -> Column:
    return F.struct(
        name.alias("name"),
        hit["line"].alias("line"),
        hit["col"].alias("col"),
        hit["position"].alias("position"),
        length.cast("int").alias("length"),
    )


def _python_lengths(content: Column) -> Column:
    """array<int>: for each `def`, the filled lines up to the next filled line at column 0.

    One pass from the end of the file over three kinds of marks: a filled line at column 0, a filled
    indented line, a definition.
    """
    filled = rf"(?=[^{SPACE_RANGES}])"
    marks = java_regex(rf"def(?=\s+\w+\s*\()|\n[{INLINE_SPACE_RANGES}]*+{filled}")
    backwards = running(
        F.reverse(F.regexp_extract_all(content, F.lit(marks), F.lit(0))),
        F.struct(F.lit(0).alias("lines")),
        emit=lambda state, mark: state["lines"],
        advance=lambda state, mark: F.struct(
            F.when(mark == "def", state["lines"])
            .when(mark == "\n", 0)
            .otherwise(state["lines"] + 1)
            .alias("lines")
        ),
        emitted="int",
        keep=lambda mark: mark == "def",
    )
    return F.reverse(backwards)


def python_functions(content: Column, longer_than: int = -1) -> Column:
    """array<function>: lines after a `def` up to the next filled line at column 0, blanks left out.
    Definitions are located only in files that hold one longer than ``longer_than``."""

    def located(lengths: Column) -> Column:
        return F.zip_with(
            scan(content, java_regex(PYTHON_FUNCTION)),
            lengths,
            lambda hit, length: _function(
                F.regexp_extract(hit["text"], java_regex(PYTHON_FUNCTION), 1), hit, length
            ),
        )

    found = let(
        _python_lengths(content),
        lambda lengths: F.when(F.exists(lengths, lambda n: n > longer_than), located(lengths)).otherwise(
            F.expr(_EMPTY_FUNCTIONS)
        ),
    )
    # The lines of a function lie between two filled lines at column 0.
    stretches = F.split(content, f"\n(?=[^{SPACE_RANGES}])", -1)
    room = F.exists(stretches, lambda text: (newlines(text) > longer_than) & text.contains("def"))
    return F.when(room, found).otherwise(F.expr(_EMPTY_FUNCTIONS))


MINIMUM_BLOCK = 256
NEAR_LINES = 16  # where most functions end


def _brace_table(content: Column) -> Column:
    """struct(opens, depth, blocks, lows): braces opened per line, running brace balance after each
    line, that balance cut into blocks, and the lowest balance of each block."""
    steps = F.transform(
        brace_lines(content),
        lambda braces: F.struct(
            opening(braces).alias("opens"), (2 * opening(braces) - F.length(braces)).alias("net")
        ),
    )
    measured = let(
        steps,
        lambda s: F.struct(
            F.transform(s, lambda step: step["opens"]).alias("opens"),
            running(
                s,
                F.struct(F.lit(0).alias("depth")),
                emit=lambda state, step: state["depth"] + step["net"],
                advance=lambda state, step: F.struct((state["depth"] + step["net"]).alias("depth")),
                emitted="int",
            ).alias("depth"),
        ),
    )
    blocked = let(
        measured,
        lambda m: F.struct(
            m["opens"].alias("opens"),
            m["depth"].alias("depth"),
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(m["depth"]) - 1) / MINIMUM_BLOCK).cast("int")),
                lambda b: F.slice(m["depth"], b * MINIMUM_BLOCK + 1, F.lit(MINIMUM_BLOCK)),
            ).alias("blocks"),
        ),
    )
    return let(
        blocked,
        lambda t: F.struct(
            t["opens"].alias("opens"),
            t["depth"].alias("depth"),
            t["blocks"].alias("blocks"),
            F.transform(t["blocks"], F.array_min).alias("lows"),
        ),
    )


def _first_at_most(values: Column, target: Column) -> Column:
    """1-based index of the first value that is not above the target; 0 if there is none."""
    return F.array_position(F.transform(values, lambda v: v <= target), True).cast("int")


def _lines_to_balance(table: Column, line: Column, target: Column) -> Column:
    """Lines after ``line`` until the balance falls to the target, or to the end of the file: the next lines first, then the
    rest of the line's own block, then block minima, then the block they point to."""
    own = F.floor((line - 1) / MINIMUM_BLOCK).cast("int")
    rest = F.slice(F.get(table["blocks"], own), line - own * MINIMUM_BLOCK + 1, F.lit(MINIMUM_BLOCK))

    def beyond(_: Column) -> Column:
        ahead = _first_at_most(F.slice(table["lows"], own + 2, F.size(table["lows"])), target)
        return let(
            ahead,
            lambda k: F.when(k == 0, F.size(table["depth"]) - line).otherwise(
                (own + k) * MINIMUM_BLOCK + _first_at_most(F.get(table["blocks"], own + k), target) - line
            ),
        )

    def in_block(_: Column) -> Column:
        return let(_first_at_most(rest, target), lambda k: F.when(k > 0, k).otherwise(beyond(k)))

    next_lines = F.slice(table["depth"], line + 1, F.lit(NEAR_LINES))
    return let(
        _first_at_most(next_lines, target),
        lambda near: F.when(near > 0, near).otherwise(in_block(near)),
    )


def _opened_before(parts: Column) -> Column:
    """array<int>: braces that a hit's line opens in front of the hit."""
    steps = F.zip_with(
        F.slice(parts["gaps"], F.lit(1), F.size(parts["hits"])),
        parts["hits"],
        lambda gap, hit: F.struct(
            (newlines(gap) > 0).alias("gap_breaks"),
            opening(_braces_of_last_line(gap)).alias("gap_opens"),
            (newlines(hit) > 0).alias("hit_breaks"),
            opening(_braces_of_last_line(hit)).alias("hit_opens"),
        ),
    )

    def at_hit(state: Column, step: Column) -> Column:
        return F.when(step["gap_breaks"], step["gap_opens"]).otherwise(state["opened"] + step["gap_opens"])

    return running(
        steps,
        F.struct(F.lit(0).alias("opened")),
        emit=at_hit,
        advance=lambda state, step: F.struct(
            F.when(step["hit_breaks"], step["hit_opens"])
            .otherwise(at_hit(state, step) + step["hit_opens"])
            .alias("opened")
        ),
        emitted="int",
    )


def _js_hits(content: Column) -> Column:
    """array<struct<at,opened,regex>> of the declarations of all four shapes."""

    def split(pattern: str, part: str) -> Column:
        regex = java_regex(SIEVES[pattern].pattern)
        parts = F.struct(split_by(content, regex).alias("parts"), F.lit(regex).alias("regex"))
        return F.when(content.rlike(java_regex(part)), parts)

    def report(m: Column) -> Column:
        found = F.zip_with(
            locate(m["parts"]),
            _opened_before(m["parts"]),
            lambda at, opened: F.struct(
                at.alias("at"), opened.alias("opened"), m["regex"].alias("regex")
            ),
        )
        # parameters that were only eaten have no end
        return F.filter(found, lambda hit: hit["at"]["text"].contains(")"))

    shapes = F.array(*[split(pattern, part) for pattern, part in JS_FUNCTIONS])
    present = F.filter(shapes, lambda m: m.isNotNull() & (F.size(m["parts"]["hits"]) > 0))
    return F.flatten(F.transform(present, report))


def _braces_of_last_line(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", -1), r"[^{}]++", "")


def js_functions(content: Column, longer_than: int = -1) -> Column:
    """array<function>: lines after a declaration until its braces balance, or to the end.

    The declaration's own line counts only the braces it opens from the declaration on. Functions
    that are not longer than ``longer_than`` are left out before they are named.
    """

    def measured(table: Column, hit: Column) -> Column:
        line = hit["at"]["line"]
        ahead = F.get(table["opens"], line - 1) - hit["opened"]
        target = F.get(table["depth"], line - 1) - ahead
        return F.struct(hit.alias("hit"), _lines_to_balance(table, line, target).alias("length"))

    def named(found: Column) -> Column:
        at = found["hit"]["at"]
        name = F.call_function("regexp_extract", at["text"], found["hit"]["regex"], F.lit(1))
        return _function(name, at, found["length"])

    def lengths(hits: Column) -> Column:
        return let(
            _brace_table(content), lambda table: F.transform(hits, lambda hit: measured(table, hit))
        )

    return let(
        _js_hits(content),
        lambda hits: F.when(F.size(hits) == 0, F.expr(_EMPTY_FUNCTIONS)).otherwise(
            F.transform(F.filter(lengths(hits), lambda found: found["length"] > longer_than), named)
        ),
    )


def functions_of(content: Column, family: Column, longer_than: int = -1) -> Column:
    """array<function> of the declarations whose length is measured; empty for other families. Those
    not longer than ``longer_than`` may be left out."""
    return (
        F.when((family == "python") & content.contains("def"), python_functions(content, longer_than))
        .when(family == "js", js_functions(content, longer_than))
        .otherwise(F.expr(_EMPTY_FUNCTIONS))
    )


def function_length_findings(content: Column, family: Column) -> Column:
    def report(fn: Column) -> Column:
        out = None
        for type_, severity, limit in FUNCTION_LIMITS:
            message = F.concat(
                F.lit("Function '"), fn["name"], F.lit("' has "), fn["length"].cast("string"),
                F.lit(f" lines (recommended max: {limit})"),
            )
            row = _finding(F.lit(type_), F.lit(type_), message, fn["line"], fn["col"], fn["position"],
                           F.lit(None), F.lit(severity))
            out = F.when(fn["length"] > limit, row) if out is None else out.otherwise(row)
        return out

    # A shorter file cannot hold a long function.
    return F.when(
        split_lines(content) > SHORTEST_LONG_FUNCTION + 1,
        F.transform(
            F.filter(
                functions_of(content, family, SHORTEST_LONG_FUNCTION),
                lambda fn: fn["length"] > SHORTEST_LONG_FUNCTION,
            ),
            report,
        ),
    ).otherwise(F.expr(EMPTY_FINDINGS))


def commented_code_findings(content: Column, marker: Column) -> Column:
    """One row per run of comment lines that holds a block of commented-out code."""

    def runs(mark: str) -> Column:
        inline = f"[{INLINE_SPACE_RANGES}]*+"
        return split_by(content, rf"(?dm)^{inline}{mark}[^\n]*+(?:\n{inline}{mark}[^\n]*+)*+")

    def block(hit: Column) -> Column:
        steps = F.transform(
            lines_of(hit["text"]),
            lambda line, i: F.struct(
                contains_any(
                    strip(F.substring(strip(line), F.length(marker) + 1, F.length(line))), CODE_INDICATORS
                ).alias("code"),
                i.alias("index"),
            ),
        )
        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("first"))
        folded = F.aggregate(
            steps,
            zero,
            lambda acc, step: F.struct(
                F.when(step["code"], acc["size"] + 1)
                .when(acc["size"] <= 1, 0)
                .otherwise(acc["size"])
                .alias("size"),
                F.when(step["code"] & (acc["size"] == 0), step["index"])
                .otherwise(acc["first"])
                .alias("first"),
            ),
        )
        return let(
            folded,
            lambda acc: F.struct(acc["size"].alias("size"), (hit["line"] + acc["first"]).alias("line")),
        )

    def report(parts: Column) -> Column:
        blocks = F.filter(
            F.transform(locate(parts), block), lambda b: b["size"] >= MIN_COMMENTED_LINES
        )
        return F.transform(
            blocks,
            lambda b: _finding(
                F.lit("commented_code"), F.lit("commented_code"),
                F.concat(F.lit("Found block of "), b["size"].cast("string"),
                         F.lit(" lines of commented-out code")),
                b["line"], F.lit(1), F.lit(None), F.lit(None), F.lit("minor"),
            ),
        )

    worthwhile = content.contains(marker) & contains_any(content, CODE_INDICATORS)
    parts = F.when(marker == "//", runs("//")).otherwise(runs("#"))
    return F.when(worthwhile, let(parts, report)).otherwise(F.expr(EMPTY_FINDINGS))


def duplicate_findings(chunks: Column) -> Column:
    """Two rows per repeated chunk, at its first two places; ``chunks`` is ``repeated_chunks``."""

    def row(at: Column, also: Column) -> Column:
        return _finding(
            F.lit("duplicate_code"), F.lit("duplicate_code"),
            F.concat(F.lit("Duplicate code block (also at line "), also.cast("string"), F.lit(")")),
            at, F.lit(1), F.lit(None), F.lit(None), F.lit("minor"),
        )

    return F.flatten(
        F.transform(
            chunks, lambda c: F.array(row(c["first"], c["second"]), row(c["second"], c["first"]))
        )
    )


def smell_findings(text: str, family: str, marker: str, extra_rules: Sequence[Rule] = ()) -> Column:
    """array<finding> of every code smell of a file; the arguments are column names."""
    content = F.col(text)
    return F.concat(
        file_length_findings(content),
        function_length_findings(content, F.col(family)),
        commented_code_findings(content, F.col(marker)),
        duplicate_findings(repeated_chunks(content)),
        rule_findings(text, family, [*SMELL_RULES, *extra_rules]),
    )


def smell_counts(text: str, family: str, marker: str, chunks: str) -> Column:
    """array<count> of every code smell; ``chunks`` names a ``repeated_chunks`` column."""
    content = F.col(text)
    located = F.concat(
        file_length_findings(content),
        function_length_findings(content, F.col(family)),
        commented_code_findings(content, F.col(marker)),
    )
    single = F.transform(
        located,
        lambda f: F.struct(
            f["rule_id"].alias("rule_id"), f["type"].alias("type"), f["severity"].alias("severity"),
            f["level"].alias("level"), F.lit(1).alias("n"),
        ),
    )
    duplicates = F.when(
        F.size(chunks) > 0,
        F.array(
            F.struct(
                F.lit("duplicate_code").alias("rule_id"), F.lit("duplicate_code").alias("type"),
                F.lit("minor").alias("severity"), F.lit(None).cast("string").alias("level"),
                (F.size(chunks) * 2).alias("n"),
            )
        ),
    ).otherwise(F.expr(EMPTY_COUNTS))
    return F.concat(single, duplicates, rule_counts(text, family, SMELL_RULES))
