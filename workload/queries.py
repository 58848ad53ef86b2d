"""One query per operator over the whole corpus, with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.constants.exclusions import EXCLUDED_DIRS, EXCLUDED_FILES, TEST_DIRS
from codeloom.constants.languages import LANGUAGES, Extension
from codeloom.constants.rules import STRICT_RULES
from codeloom.functions.regex import glob_regex
from codeloom.functions.text import clean, identifiers
from codeloom.operators import blocks as bl
from codeloom.operators import complexity as cx
from codeloom.operators import discovery as ds
from codeloom.operators import duplicates as dp
from codeloom.operators import findings as fd
from codeloom.operators.discovery import with_language
from codeloom.operators.lines import definition_counts
from codeloom.operators.structure import rust_keyword_complexity
from codeloom.plans import compare as cp
from codeloom.plans import file_metrics as fm
from codeloom.plans import file_sets as fs
from codeloom.plans import incremental as inc
from codeloom.plans import rankings as rk
from codeloom.plans import reports as rp
from codeloom.plans import rollups as ru
from codeloom.plans import rule_tables as rt
from codeloom.plans.order import ranked_table
from codeloom.plans.registry import Analyzer, Provider
from codeloom.sources.shared import shared_folder
from codeloom.sources.tables import from_table
from workload import corpus
from workload.oracle import LEVEL, NL, count, query, text
from workload.oracle import words as sql_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None, *needed: str):
    """Register a query under its function name, with the SQL that must agree."""

    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLE[build.__name__] = query(sql, *needed)
        return build

    return add


def _texts(spark, sf_dir):
    return fm.with_text(corpus.typed_files(spark, sf_dir))


def _lines(spark, sf_dir):
    return fm.with_lines(_texts(spark, sf_dir))


def _measured(spark, sf_dir):
    return fm.with_complexity(fm.with_structure(_lines(spark, sf_dir)))


def _secured(spark, sf_dir):
    return fm.with_security(_texts(spark, sf_dir))


def _smelled(spark, sf_dir):
    return fm.with_smells(_lines(spark, sf_dir))


def _judged(spark, sf_dir):
    return fm.with_smells(fm.with_security(_measured(spark, sf_dir)))


def _summary(spark, sf_dir):
    return ru.project_summary(_judged(spark, sf_dir))


# Discovery and languages


@registered("SELECT project, language, count(*) AS files FROM typed GROUP BY ALL")
def files_by_language(spark, sf_dir):
    return ru.files_by_language(corpus.typed_files(spark, sf_dir))


@registered(
    "SELECT project, language, upper(language[1]) || language[2:] AS label, files, "
    "files * 100.0::DOUBLE / sum(files) OVER (PARTITION BY project) AS percentage FROM "
    "(SELECT project, language, count(*) AS files FROM typed GROUP BY ALL)"
)
def language_share(spark, sf_dir):
    return ru.language_share(corpus.typed_files(spark, sf_dir))


_LISTING = ", ".join(
    "('{}', '{}', '{}')".format(
        entry.name.capitalize(), ", ".join(entry.extensions),
        "AST Analysis" if entry.name == "python" else "Pattern Matching",
    )
    for entry in LANGUAGES
)


@registered(
    f"SELECT l.language, l.extensions, l.features, (SELECT count(*) FROM typed "
    "WHERE list_contains(string_split(l.extensions, ', '), lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)))) AS files "
    f"FROM (VALUES {_LISTING}) AS l(language, extensions, features)"
)
def supported_languages(spark, sf_dir):
    """Listed languages with the files that have one of their extensions, under whatever name they are analysed."""
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    used = corpus.typed_files(spark, sf_dir).groupBy(suffix.alias("extension")).agg(F.count("*").alias("n"))
    listed = ds.language_listing(spark)
    listed = listed.select("*", F.explode(F.split("extensions", ", ")).alias("extension"))
    counted = listed.join(used, "extension", "left").groupBy("language", "extensions", "features")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("files"))


# Paths that meet every exclusion: directories and names by key.
TREE_DIRS = [*EXCLUDED_DIRS, *TEST_DIRS, "src", "app", "core", "cmake-build-debug", "my_tests", "Tests"]
TREE_NAMES = [
    "main.py", "__init__.py", "_private.py", "app.js", "app.min.js", "x.bundle.js", "index.d.ts", "view.jsx",
    "view.tsx", "MAIN.PY", "noext", ".py", ".hidden.py", "lib.rs", "README.py", "LICENSE.js", "npm-debug.log",
    "schema_pb2.py", "gen.pb.go", "a.generated.ts", "old.py.bak", "page.phtml", "task.rake", "note.md",
    "Gemfile.lock", "a_test.go", "b_mock.rs", "Form.Designer.cs", "package-info.java", "x.kts", "y.swift",
    "desktop.ini", "conf.cfg", "style.css", "x.y.py", "trailing.",
]
_TREE_PATH = {
    engine: (
        f"concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat({engine.pick(TREE_DIRS, f'o_orderkey % {len(TREE_DIRS)} + 1')}, '/') END, "
        f"'pkg', cast(o_custkey % 5 as string), '/', {engine.pick(TREE_NAMES, f'o_custkey % {len(TREE_NAMES)} + 1')})"
    )
    for engine in (corpus.Spark, corpus.Duck)
}
_TREE = f"(SELECT concat('tree_', cast(o_custkey % 4 as string)) AS project, {_TREE_PATH[corpus.Duck]} AS path, o_orderkey AS file_no FROM orders)"


def _tree_files(spark, sf_dir):
    orders = corpus.read(spark, sf_dir, "orders")
    return orders.selectExpr(
        "concat('tree_', cast(o_custkey % 4 as string)) AS project",
        f"{_TREE_PATH[corpus.Spark]} AS path", "o_orderkey AS file_no",
    )


def _tree_sql(dirs, extra_condition="true"):
    exact = [g for g in EXCLUDED_FILES if "*" not in g]
    globs = "^(?s:" + "|".join(glob_regex(g) for g in EXCLUDED_FILES if "*" in g) + ")$"
    name = "string_split(path, '/')[-1]"
    return (
        f"SELECT t.project, t.path, t.file_no, l.language, ends_with(t.path, '.d.ts') AS is_definition FROM {_TREE} t "
        "JOIN languages l ON lower(regexp_extract(t.path, '[^/](\\.[^./]+)$', 1)) = l.extension "
        f"WHERE NOT list_has_any(string_split(path, '/'), {sql_words(dirs)}) AND NOT list_contains({sql_words(exact)}, {name}) "
        f"AND NOT regexp_matches({name}, {text(globs)}) AND {extra_condition}"
    )


_TREE_COLUMNS = ("project", "path", "file_no", "language", "is_definition")


@registered(_tree_sql([*EXCLUDED_DIRS, *TEST_DIRS]))
def discovered_files(spark, sf_dir):
    return ds.discover(_tree_files(spark, sf_dir)).select(*_TREE_COLUMNS)


@registered(_tree_sql([*EXCLUDED_DIRS, "core"]))
def discovered_with_tests(spark, sf_dir):
    """Tests included and one directory more excluded."""
    found = ds.discover(_tree_files(spark, sf_dir), exclude_dirs=("core",), include_tests=True)
    return found.select(*_TREE_COLUMNS)


@registered(_tree_sql(
    [*EXCLUDED_DIRS, *TEST_DIRS],
    "NOT regexp_matches(path, '(^|/)(cmake-build-|[.]sublime-)[^/]*(/|$)') AND NOT ("
    + " OR ".join(
        f"(language = '{e.name}' AND regexp_matches(string_split(path, '/')[-1], "
        + text("^(?s:" + "|".join(glob_regex(g) for g in e.exclude_globs) + ")$") + "))"
        for e in LANGUAGES if e.exclude_globs
    ) + ")",
))
def discovered_by_globs(spark, sf_dir):
    """Directory globs and the per-language file globs switched on."""
    found = ds.discover(_tree_files(spark, sf_dir), glob_dirs=True, language_globs=True)
    return found.select(*_TREE_COLUMNS)


@registered(
    f"SELECT project, path, file_no, coalesce(l.language, 'unknown') AS language FROM {_TREE} t LEFT JOIN languages l "
    "ON lower(regexp_extract(t.path, '[^/](\\.[^./]+)$', 1)) = l.extension"
)
def detected_languages(spark, sf_dir):
    found = ds.with_language(_tree_files(spark, sf_dir), keep_unknown=True)
    return found.select("project", "path", "file_no", "language")


@registered(
    "SELECT project, path, array_to_string(string_split(path, '/')[-2:], '/') AS near, "
    "CASE WHEN starts_with(path, 'src/') THEN path[5:] ELSE array_to_string(string_split(path, '/')[-2:], '/') END AS below_root FROM typed"
)
def short_paths(spark, sf_dir):
    path = F.col("path")
    return corpus.typed_files(spark, sf_dir).select(
        "project", "path", ds.short_path(path).alias("near"), ds.short_path(path, "src").alias("below_root")
    )


@registered(
    "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest, md5(replace(text, ' ', chr(10))) AS unified "
    "FROM documents"
)
def cleaned_text(spark, sf_dir):
    """Bytes with an invalid byte and both foreign line ends put in, decoded again."""
    documents = corpus.dealt(corpus.read(spark, sf_dir, "documents").select("doc_id", "text"), "documents")
    spoiled = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    mixed = F.encode(F.regexp_replace(F.regexp_replace("text", " ( ?)", "\r\n$1"), " ", "\r"), "UTF-8")
    return documents.select(
        "doc_id", clean(spoiled).alias("cleaned"), clean(mixed).alias("unix")
    ).select(
        "doc_id", F.length("cleaned").cast("long").alias("n_chars"), F.md5("cleaned").alias("digest"),
        F.md5("unix").alias("unified"),
    )


# Lines


@registered(
    "SELECT project, path, language, loc, blanks, comments, loc - blanks - comments AS sloc FROM line_counts",
    "line_counts",
)
def line_counts(spark, sf_dir):
    return _lines(spark, sf_dir).select("project", "path", "language", "loc", "blanks", "comments", "sloc")


@registered(
    "SELECT project, path, comments, CASE WHEN family = 'python' THEN marked ELSE comments END AS comment_or_string_lines "
    "FROM line_counts",
    "line_counts",
)
def comment_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("project", "path", "comments", "comment_or_string_lines")


_BANDS = "('< 100 lines', 0, 100), ('100-500 lines', 100, 500), ('500-1K lines', 500, 1000), ('1K-5K lines', 1000, 5000), ('> 5K lines', 5000, 1000000000)"


@registered(
    f"SELECT p.project, b.name AS size_range, count(c.path) AS files FROM (SELECT DISTINCT project FROM typed) p "
    f"CROSS JOIN (VALUES {_BANDS}) AS b(name, low, high) LEFT JOIN line_counts c ON c.project = p.project AND "
    "c.loc - c.blanks - c.comments >= b.low AND c.loc - c.blanks - c.comments < b.high GROUP BY ALL",
    "line_counts",
)
def size_histogram(spark, sf_dir):
    return ru.size_histogram(_lines(spark, sf_dir))


@registered(
    "SELECT project, path, loc, blanks, comments, interfaces, types, functions, interfaces + types + functions AS cyclomatic, "
    "(2 * interfaces + types + functions)::DOUBLE AS complexity_score FROM definitions",
    "definitions",
)
def definition_files(spark, sf_dir):
    files = corpus.typed_files(spark, sf_dir).where("is_definition")
    counted = files.select("project", "path", definition_counts(F.col("content")).alias("d"))
    names = ("loc", "blanks", "comments", "interfaces", "types", "functions")
    total = F.col("d.interfaces") + F.col("d.types") + F.col("d.functions")
    return counted.select(
        "project", "path", *[F.col(f"d.{n}").cast("long").alias(n) for n in names],
        total.cast("long").alias("cyclomatic"),
        (total + F.col("d.interfaces")).cast("double").alias("complexity_score"),
    )


# Structure


@registered(
    "SELECT project, path, language, classes, functions, methods, len(imports)::BIGINT AS n_imports, "
    "array_to_string(imports, '|') AS import_lines FROM structure",
    "structure",
)
def structure_counts(spark, sf_dir):
    return fm.with_structure(_texts(spark, sf_dir)).select(
        "project", "path", "language", "classes", "functions", "methods",
        F.size("imports").cast("long").alias("n_imports"), F.array_join("imports", "|").alias("import_lines"),
    )


@registered(
    "SELECT project, path, classes, functions, methods FROM structure WHERE family = 'python'", "structure"
)
def python_methods(spark, sf_dir):
    return fm.with_structure(_texts(spark, sf_dir).where("family = 'python'")).select(
        "project", "path", "classes", "functions", "methods"
    )


@registered(
    "SELECT project, path, interfaces, types FROM structure WHERE language IN ('typescript', 'tsx')", "structure"
)
def typescript_declarations(spark, sf_dir):
    custom = fm.with_custom(
        fm.with_structure(_texts(spark, sf_dir).where(F.col("language").isin("typescript", "tsx")))
    )
    return custom.select(
        "project", "path", F.col("custom")["typescript.interfaces"].cast("long").alias("interfaces"),
        F.col("custom")["typescript.types"].cast("long").alias("types"),
    )


def _rust_count(word):
    return count("text", "\n" + word)


@registered(
    f"SELECT project, path, {_rust_count('struct ')}::BIGINT AS structs, {_rust_count('trait ')}::BIGINT AS traits, {_rust_count('impl ')}::BIGINT AS impls, "
    f"{_rust_count('fn ')}::BIGINT AS functions, {_rust_count('use ')}::BIGINT AS imports, (1 + "
    + " + ".join(count("text", w) for w in ("if ", "else ", "match ", "for ", "while ", "loop "))
    + ")::BIGINT AS keyword_complexity FROM typed WHERE family = 'rust'"
)
def rust_counts(spark, sf_dir):
    rust = fm.with_structure(_texts(spark, sf_dir).where("family = 'rust'"))
    found = F.col("structure")
    return rust.select(
        "project", "path", (found["classes"] - found["traits"]).cast("long").alias("structs"),
        found["traits"].cast("long").alias("traits"), found["impls"].cast("long").alias("impls"), "functions",
        F.size("imports").cast("long").alias("imports"),
        rust_keyword_complexity(F.col("text")).cast("long").alias("keyword_complexity"),
    )


@registered(
    "SELECT project, module, count(*) AS uses FROM (SELECT project, unnest(imports) AS module FROM structure) GROUP BY ALL",
    "structure",
)
def dependency_counts(spark, sf_dir):
    return ru.dependency_counts(fm.with_structure(_texts(spark, sf_dir)))


@registered(
    "SELECT project, rank, module, uses FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY uses DESC, module) AS rank "
    "FROM (SELECT project, module, count(*) AS uses FROM (SELECT project, unnest(imports) AS module FROM structure) GROUP BY ALL)) "
    "WHERE rank <= 15",
    "structure",
)
def dependencies_top15(spark, sf_dir):
    return rk.top_dependencies(ru.dependency_counts(fm.with_structure(_texts(spark, sf_dir))))


# Complexity


@registered("SELECT project, path, language, cyclomatic::BIGINT AS cyclomatic FROM lexical", "lexical")
def cyclomatic(spark, sf_dir):
    texts = _texts(spark, sf_dir).where(F.length("text") > 0).withColumn("tokens", identifiers(F.col("text")))
    value = cx.cyclomatic(F.col("text"), F.col("family"), F.col("tokens"))
    return texts.select("project", "path", "language", value.cast("long").alias("cyclomatic"))


@registered("SELECT project, path, cognitive::BIGINT AS cognitive FROM cognitive", "cognitive")
def cognitive_in_blocks(spark, sf_dir):
    """As ``cognitive``, every file dealt in blocks of 40 lines."""
    texts = _texts(spark, sf_dir).where(F.length("text") > 0).select("project", "path", "family", F.col("text").alias("content"))
    found = [bl.cognitive_in_blocks(texts.where(F.col("family") == family), family == "python", 40) for family in ("python", "js")]
    return found[0].unionByName(found[1])


@registered("SELECT project, path, cognitive::BIGINT AS cognitive FROM cognitive", "cognitive")
def cognitive(spark, sf_dir):
    texts = _texts(spark, sf_dir).where((F.length("text") > 0) & F.col("family").isin("python", "js"))
    return texts.select(
        "project", "path", cx.cognitive(F.col("text"), F.col("family")).cast("long").alias("cognitive")
    )


@registered(
    "SELECT project, path, len(operators)::BIGINT AS operators, len(operands)::BIGINT AS operands, "
    "len(list_distinct(operators))::BIGINT AS distinct_operators, len(list_distinct(operands))::BIGINT AS distinct_operands "
    "FROM lexical",
    "lexical",
)
def halstead_parts(spark, sf_dir):
    texts = _texts(spark, sf_dir).where(F.length("text") > 0).withColumn("tokens", identifiers(F.col("text")))
    parts = texts.select(
        "project", "path", cx.halstead_parts(F.col("text"), F.col("family"), F.col("tokens")).alias("p")
    )
    names = ("operators", "operands", "distinct_operators", "distinct_operands")
    return parts.select("project", "path", *[F.col(f"p.{n}").cast("long").alias(n) for n in names])


@registered(
    "SELECT project, path, language, cyclomatic, cognitive, round(halstead, 4) AS halstead, "
    "round(maintainability_index, 4) AS maintainability_index, round(complexity_score, 4) AS complexity_score, "
    f"{LEVEL} AS complexity_level, CASE WHEN maintainability_index >= 85 THEN 'excellent' WHEN maintainability_index >= 65 "
    "THEN 'good' WHEN maintainability_index >= 40 THEN 'moderate' WHEN maintainability_index >= 25 THEN 'poor' "
    "ELSE 'unmaintainable' END AS maintainability_level FROM complexity",
    "complexity",
)
def complexity_score(spark, sf_dir):
    return _measured(spark, sf_dir).select(
        "project", "path", "language", "cyclomatic", "cognitive",
        *[F.round(c, 4).alias(c) for c in ("halstead", "maintainability_index", "complexity_score")],
        "complexity_level", "maintainability_level",
    )


@registered(
    "SELECT *, files * 100.0::DOUBLE / sum(files) OVER (PARTITION BY project) AS percentage FROM ("
    "SELECT p.project, l.level AS complexity_level, l.label, count(c.path) AS files FROM (SELECT DISTINCT project FROM typed) p CROSS JOIN (VALUES ('trivial', 'Trivial'), ('low', 'Low'), "
    "('moderate', 'Moderate'), ('high', 'High'), ('very_high', 'Very High'), ('extreme', 'Extreme')) AS l(level, label) "
    f"LEFT JOIN (SELECT project, path, {LEVEL} AS level FROM complexity) c ON c.project = p.project AND c.level = l.level GROUP BY ALL)",
    "complexity",
)
def complexity_levels(spark, sf_dir):
    return ru.complexity_distribution(_measured(spark, sf_dir))


_CHART = "CASE WHEN complexity_score < 10 THEN 'Low' WHEN complexity_score < 20 THEN 'Medium' WHEN complexity_score < 30 THEN 'High' ELSE 'Very High' END"


@registered(
    "SELECT p.project, l.band, count(c.path) AS files FROM (SELECT DISTINCT project FROM typed) p CROSS JOIN "
    "(VALUES ('Low'), ('Medium'), ('High'), ('Very High')) AS l(band) LEFT JOIN "
    f"(SELECT project, path, {_CHART} AS band FROM complexity) c ON c.project = p.project AND c.band = l.band GROUP BY ALL",
    "complexity",
)
def complexity_chart(spark, sf_dir):
    return ru.complexity_chart(_measured(spark, sf_dir))


# Security


@registered(
    "SELECT project, path, language, rule_id, type, replace(template, '{line}', line::VARCHAR) AS message, "
    "line::BIGINT AS line, col::BIGINT AS col, position, level, severity FROM security_hits",
    "security_hits",
)
def security_findings(spark, sf_dir):
    return _located(fm.security_issues(corpus.typed_files(spark, sf_dir)))


def _located(findings):
    names = [c for c in findings.columns if c not in ("line", "col", "position")]
    return findings.select(*names, *[F.col(c).cast("long").alias(c) for c in ("line", "col", "position")])


@registered(
    "SELECT project, type, label, count(*) AS issues, count(DISTINCT path) AS files_affected FROM (SELECT *, array_to_string("
    "list_transform(string_split(type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM security_hits) GROUP BY ALL",
    "security_hits",
)
def security_by_type(spark, sf_dir):
    return ru.security_by_type(_secured(spark, sf_dir))


@registered("SELECT project, level, count(*) AS issues FROM security_hits GROUP BY ALL", "security_hits")
def security_by_level(spark, sf_dir):
    return ru.security_by_level(_secured(spark, sf_dir))


@registered(
    "SELECT p.project, b.severity_bin, count(h.path) AS issues FROM (SELECT DISTINCT project FROM typed) p CROSS JOIN "
    "(VALUES ('Critical'), ('High'), ('Medium'), ('Low')) AS b(severity_bin) LEFT JOIN security_hits h "
    "ON h.project = p.project AND h.severity = lower(b.severity_bin) GROUP BY ALL",
    "security_hits",
)
def security_chart(spark, sf_dir):
    return ru.security_chart(_secured(spark, sf_dir))


@registered(
    "SELECT project, path, type, replace(template, '{line}', line::VARCHAR) AS message, line::BIGINT AS line, "
    "col::BIGINT AS col, position FROM security_hits WHERE level = 'critical'",
    "security_hits",
)
def critical_list(spark, sf_dir):
    return _located(ru.critical_vulnerabilities(
        fm.security_issues(corpus.typed_files(spark, sf_dir), lambda rule: rule.level == "critical")
    ))


@registered(
    "SELECT t.project, t.path, count(h.path) AS n_security, greatest(0, 100 - coalesce(sum(CASE h.level WHEN 'critical' THEN 25 "
    "WHEN 'high_risk' THEN 15 WHEN 'medium_risk' THEN 5 ELSE 0 END), 0))::DOUBLE AS security_score, "
    "CASE WHEN count(*) FILTER (h.severity = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (h.severity = 'high') > 0 "
    "THEN 'high_risk' WHEN count(h.path) > 0 THEN 'medium_risk' ELSE 'secure' END AS security_level "
    "FROM typed t LEFT JOIN security_hits h ON h.project = t.project AND h.path = t.path GROUP BY ALL",
    "security_hits",
)
def file_security(spark, sf_dir):
    return _secured(spark, sf_dir).select("project", "path", "n_security", "security_score", "security_level")


@registered(
    "SELECT project, path, line::BIGINT AS line, col::BIGINT AS col, position FROM security_hits "
    "WHERE type = 'hardcoded_secret' AND starts_with(project, 'prose_')",
    "security_hits",
)
def secrets_in_prose(spark, sf_dir):
    from codeloom.operators.discovery import with_language

    prose = with_language(corpus.files(spark, sf_dir, parts=("documents",)))
    secrets = fm.security_issues(prose, lambda rule: rule.type == "hardcoded_secret")
    return _located(secrets.select("project", "path", "line", "col", "position"))


# Smells

_SMELL_SQL = "SELECT project, path, language, type, message, line::BIGINT AS line, col::BIGINT AS col, position, severity FROM smells"
_SMELL_COLUMNS = ("project", "path", "language", "type", "message", "line", "col", "position", "severity")


@registered(_SMELL_SQL, "smells")
def code_smells(spark, sf_dir):
    return _located(fm.code_smells(corpus.typed_files(spark, sf_dir)).select(*_SMELL_COLUMNS))


@registered(
    "SELECT project, path, language, 'security' AS kind, type, replace(template, '{line}', line::VARCHAR) AS message, "
    "line::BIGINT AS line, col::BIGINT AS col, position, severity FROM security_hits UNION ALL "
    "SELECT project, path, language, 'smell' AS kind, type, message, line::BIGINT AS line, col::BIGINT AS col, position, severity FROM smells",
    "security_hits", "smells",
)
def findings(spark, sf_dir):
    """Security findings and smells of every file in one table."""
    found = fm.findings(corpus.typed_files(spark, sf_dir))
    return _located(found.select("project", "path", "language", "kind", *_SMELL_COLUMNS[3:]))


def _smell_query(build):
    """The findings of one smell operator over the whole corpus."""

    def run(spark, sf_dir):
        texts = _texts(spark, sf_dir)
        found = texts.select("project", "path", "language", F.inline(build()))
        return _located(found.select(*_SMELL_COLUMNS))

    return run


def _register_smell(name, types, build):
    condition = ", ".join(text(t) for t in types)
    QUERIES[name] = _smell_query(build)
    ORACLE[name] = query(f"{_SMELL_SQL} WHERE type IN ({condition})", "smells")


_register_smell("file_length_smells", ("file_too_long", "file_long"), lambda: fd.file_length_findings(F.col("text")))
_register_smell(
    "function_length", ("function_too_long", "function_long"),
    lambda: fd.function_length_findings(F.col("text"), F.col("family")),
)
_register_smell(
    "commented_code", ("commented_code",),
    lambda: fd.commented_code_findings(F.col("text"), F.col("comment_marker")),
)
_register_smell(
    "duplicate_chunks", ("duplicate_code",),
    lambda: fd.duplicate_findings(dp.repeated_chunks(F.col("text"))),
)


@registered(
    "SELECT project, path, language, rule_id, type, replace(template, '{name}', regexp_extract(hit, '^(alert|prompt|confirm)', 1)) AS message, "
    "line::BIGINT AS line, col::BIGINT AS col, position, severity FROM smell_hits",
    "smell_hits",
)
def smells_regex(spark, sf_dir):
    from codeloom.constants.rules import SMELL_RULES

    texts = _texts(spark, sf_dir)
    found = texts.select(*fm.KEY, F.inline(fd.rule_findings("text", "family", SMELL_RULES)))
    return _located(found.drop("level"))


@registered(
    "SELECT project, path, sum(n)::BIGINT AS strict_hits FROM (SELECT project, path, len(list_filter(regexp_extract_all(text, "
    "'[=!<>]+'), lambda r: regexp_matches(r, '^[=!]=([^=]|$)'))) AS n FROM typed WHERE family = 'js') GROUP BY ALL HAVING sum(n) > 0"
)
def loose_equality_strict(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    counts = texts.select(
        "project", "path", F.inline(fd.rule_counts("text", "family", STRICT_RULES))
    )
    return counts.select("project", "path", F.col("n").cast("long").alias("strict_hits"))


@registered("SELECT project, path, language, name, line::BIGINT AS line, col::BIGINT AS col, position, length FROM functions", "functions")
def measured_functions(spark, sf_dir):
    """Every declaration whose length is measured, not only the long ones."""
    texts = _texts(spark, sf_dir)
    found = texts.select(*fm.KEY, F.inline(fd.functions_of(F.col("text"), F.col("family"))))
    return _located(found.withColumn("length", F.col("length").cast("long")))


@registered(
    "SELECT project, type, count(*) AS issues, count(DISTINCT path) AS files_affected FROM smells GROUP BY ALL",
    "smells",
)
def smell_counts(spark, sf_dir):
    return ru.smell_counts_by_type(_smelled(spark, sf_dir))


@registered(
    "SELECT p.project, b.severity_bin, count(h.path) AS smells FROM (SELECT DISTINCT project FROM typed) p CROSS JOIN "
    "(VALUES ('Critical'), ('Major'), ('Minor')) AS b(severity_bin) LEFT JOIN smells h "
    "ON h.project = p.project AND h.severity = lower(b.severity_bin) GROUP BY ALL",
    "smells",
)
def smell_severity(spark, sf_dir):
    return ru.smell_chart(_smelled(spark, sf_dir))


@registered(
    "SELECT c.project, c.path, count(s.path) AS n_smells, CASE WHEN count(s.path) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, sum(CASE s.severity WHEN 'critical' THEN 10 "
    "WHEN 'major' THEN 5 WHEN 'minor' THEN 1 END)::DOUBLE / (CASE WHEN any_value(c.loc - c.blanks - c.comments) = 0 THEN 1 "
    "ELSE any_value(c.loc - c.blanks - c.comments) END)::DOUBLE * 0.02::DOUBLE) END AS technical_debt_ratio, "
    "CASE WHEN count(*) FILTER (s.severity = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (s.severity = 'major') > 0 "
    "THEN 'major' WHEN count(s.path) > 0 THEN 'minor' ELSE 'none' END AS smell_severity "
    "FROM line_counts c LEFT JOIN smells s ON s.project = c.project AND s.path = c.path GROUP BY c.project, c.path",
    "line_counts", "smells",
)
def technical_debt(spark, sf_dir):
    return _smelled(spark, sf_dir).select("project", "path", "n_smells", "technical_debt_ratio", "smell_severity")


@registered("SELECT project, path, 6 * count(*) AS duplicated_lines FROM repeats GROUP BY ALL", "repeats")
def duplicate_blocks(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    lines = dp.duplicated_lines(dp.repeated_chunks(F.col("text"))).cast("long")
    return ru.duplicate_blocks(texts.withColumn("duplicated_lines", lines))


@registered(
    "SELECT project, duplicated_lines, sloc, CASE WHEN sloc > 0 THEN duplicated_lines::DOUBLE / sloc::DOUBLE ELSE 0 END AS duplicated_lines_ratio "
    "FROM (SELECT c.project, sum(coalesce(r.n, 0))::BIGINT AS duplicated_lines, sum(c.loc - c.blanks - c.comments)::BIGINT AS sloc "
    "FROM line_counts c LEFT JOIN (SELECT project, path, 6 * count(*) AS n FROM repeats GROUP BY ALL) r "
    "ON r.project = c.project AND r.path = c.path GROUP BY c.project)",
    "line_counts", "repeats",
)
def duplicated_ratio(spark, sf_dir):
    lines = dp.duplicated_lines(dp.repeated_chunks(F.col("text"))).cast("long")
    return ru.duplicated_ratio(_lines(spark, sf_dir).withColumn("duplicated_lines", lines))


@registered(
    "SELECT first.project AS first_project, first.path AS first_path, first.line AS first_line, n_files, n_places FROM ("
    "SELECT min({'project': project, 'path': path, 'line': i}) AS first, count(DISTINCT (project, path)) AS n_files, "
    "count(*) AS n_places FROM all_chunks GROUP BY chunk) WHERE n_files >= 2",
    "all_chunks",
)
def cross_file_duplicates(spark, sf_dir):
    """Over every file, definition files too: a copy is one whatever the file declares."""
    files = corpus.typed_files(spark, sf_dir).select("project", "path", F.coalesce("content", F.lit("")).alias("content"))
    found = dp.cross_file_duplicates(files)
    return found.withColumn("first_line", F.col("first_line").cast("long"))


@registered(
    "SELECT project, path, min(i)::BIGINT AS first_line, max(i)::BIGINT + 5 AS last_line, count(*) AS n_chunks, min(n) AS fewest_files, "
    "max(n) AS most_files FROM (SELECT project, path, i, n, i - row_number() OVER (PARTITION BY project, path ORDER BY i) AS region "
    "FROM all_chunks JOIN (SELECT chunk, count(DISTINCT (project, path)) AS n FROM all_chunks GROUP BY chunk HAVING n >= 2) USING (chunk)) "
    "GROUP BY project, path, region",
    "all_chunks",
)
def clone_regions(spark, sf_dir):
    """Over every file, as ``cross_file_duplicates``."""
    files = corpus.typed_files(spark, sf_dir).select("project", "path", F.coalesce("content", F.lit("")).alias("content"))
    return dp.clone_regions(files).withColumns({n: F.col(n).cast("long") for n in ("first_line", "last_line")})


# Design patterns


@registered(
    "SELECT project, path, language, rule_id, type AS pattern, line::BIGINT AS line, position, "
    "substring(text, greatest(position - 20, 0) + 1, length(hit) + least(position, 20) + 20) AS context FROM pattern_hits",
    "pattern_hits",
)
def pattern_hits(spark, sf_dir):
    found = fm.pattern_hits(corpus.typed_files(spark, sf_dir))
    return found.select(
        *fm.KEY, "rule_id", "pattern", F.col("line").cast("long").alias("line"),
        F.col("position").cast("long").alias("position"), "context",
    )


@registered(
    "SELECT project, type AS pattern, count(*) AS hits, count(DISTINCT path) AS files FROM pattern_hits GROUP BY ALL",
    "pattern_hits",
)
def pattern_stats(spark, sf_dir):
    return ru.pattern_stats(fm.with_patterns(_texts(spark, sf_dir)))


@registered("SELECT DISTINCT project, type AS pattern, path FROM pattern_hits", "pattern_hits")
def pattern_files(spark, sf_dir):
    return ru.pattern_files(fm.with_patterns(_texts(spark, sf_dir)))


@registered(
    "SELECT type AS pattern, count(DISTINCT (project, path)) AS n_files, count(DISTINCT (project, path)) FILTER (project LIKE 'proj%') AS in_projects "
    "FROM pattern_hits GROUP BY type",
    "pattern_hits",
)
def pattern_file_sets(spark, sf_dir):
    """Distinct files of each pattern, merged from sets by project."""
    numbers = fs.file_numbers(_stored(spark, corpus.typed_files(spark, sf_dir).select("project", "path")))
    hits = ru.pattern_files(fm.with_patterns(_texts(spark, sf_dir)))
    sets = _stored(spark, fs.sets_of(hits, numbers, "project", "pattern"))
    some = fs.sizes(fs.merged(sets.where("project LIKE 'proj%'"), "pattern"), "pattern").withColumnRenamed("n_files", "in_projects")
    return fs.sizes(fs.merged(sets, "pattern"), "pattern").join(some, "pattern", "left").na.fill(0, ["in_projects"])


# Projects


@registered(
    "SELECT project, count(*) AS total_files, sum(loc)::BIGINT AS total_loc, sum(sloc)::BIGINT AS total_sloc, "
    "sum(comments)::BIGINT AS total_comments, sum(blanks)::BIGINT AS total_blanks, sum(size_bytes)::BIGINT AS project_size, "
    "sum(classes)::BIGINT AS total_classes, sum(functions)::BIGINT AS total_functions, sum(methods)::BIGINT AS total_methods "
    "FROM complexity GROUP BY project",
    "complexity",
)
def project_totals(spark, sf_dir):
    return ru.project_totals(fm.with_structure(_lines(spark, sf_dir)))


_GRADE = "CASE WHEN {0} >= 80 THEN 'green' WHEN {0} >= 60 THEN 'yellow' ELSE 'red' END"


@registered(
    "SELECT project, round(security_score, 4) AS security_score, round(code_quality_score, 4) AS code_quality_score, maintainability_score, "
    "round(avg_maintainability_index, 4) AS avg_maintainability_index, round(avg_cyclomatic_complexity, 4) AS avg_cyclomatic_complexity, "
    f"{_GRADE.format('code_quality_score')} AS quality_grade, {_GRADE.format('maintainability_score')} AS maintainability_grade FROM summary",
    "summary",
)
def project_scores(spark, sf_dir):
    scores = ru.project_scores(_judged(spark, sf_dir))
    return _rounded(scores, "security_score", "code_quality_score", "avg_maintainability_index", "avg_cyclomatic_complexity")


def _rounded(frame, *names):
    return frame.withColumns({name: F.round(name, 4) for name in names})


_ROUNDED = ("security_score", "code_quality_score", "avg_maintainability_index", "avg_cyclomatic_complexity", "duplicated_lines_ratio")


@registered(
    f"SELECT * EXCLUDE ({', '.join(_ROUNDED)}), {', '.join(f'round({c}, 4) AS {c}' for c in _ROUNDED)} FROM summary",
    "summary",
)
def project_summary(spark, sf_dir):
    return _rounded(_summary(spark, sf_dir), *_ROUNDED)


def _stored(spark, table):
    """table, written to the shared folder and read again, for what reads it several times."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.parquet(path)


#: What reports and the summary read of a measured file.
REPORTED = (
    *fm.KEY, "size_bytes", "loc", "blanks", "comments", "sloc", "classes", "functions", "methods", "cyclomatic",
    "maintainability_index", "complexity_score", "complexity_level", "n_security", "n_smells", "duplicated_lines",
)


def _reported(spark, sf_dir):
    """The per-file table of a report: stored, as it is read as files and as sums, and without the texts and spans that
    it was measured on."""
    return _stored(spark, _judged(spark, sf_dir).select(*REPORTED))


def _yesterday(files):
    """The corpus as it was before one file in 97 changed, one was added, one was removed and one only touched."""
    draw = F.pmod(F.xxhash64("project", "path"), F.lit(97))
    earlier = F.col("modified_at") - F.expr("INTERVAL 1 DAY")
    was = files.where(draw != 1).select(
        "project", "path", F.when(draw == 0, F.lit(6)).otherwise(F.col("size_bytes")).cast("long").alias("size_bytes"),
        F.when(draw.isin(0, 2), earlier).otherwise(F.col("modified_at")).alias("modified_at"),
        F.when(draw == 0, F.lit("x = 1\n")).otherwise(F.col("content")).alias("content"),
    )
    removed = files.where(draw == 3).select(
        "project", F.concat(F.lit("removed/"), "path").alias("path"), "size_bytes", "modified_at", "content"
    )
    return was.unionByName(removed)


@registered(
    f"SELECT * EXCLUDE ({', '.join(_ROUNDED)}), {', '.join(f'round({c}, 4) AS {c}' for c in _ROUNDED)} FROM summary",
    "summary",
)
def incremental_summary(spark, sf_dir):
    """Yesterday's analysis, stored and brought up to date by the files that have changed since."""
    files = corpus.files(spark, sf_dir)
    was = _yesterday(files)
    metrics = _stored(spark, fm.file_metrics(with_language(was)))
    before = inc.State(_stored(spark, inc.snapshot(was)), metrics, _stored(spark, inc.totals_of(metrics)))
    moved = _stored(spark, inc.difference(before.snapshot, files))
    return _rounded(inc.summary(inc.updated(before, files, moved).totals), *_ROUNDED)


@registered(
    "SELECT project, "
    + ", ".join(f"format('{{:,}}', {c}) AS {c}" for c in (
        "total_files", "total_loc", "total_sloc", "total_comments", "total_blanks", "total_classes", "total_functions", "total_methods"))
    + ", format('{:,.1f}', code_quality_score) AS code_quality, format('{:,.1f}', maintainability_score::DOUBLE) AS maintainability FROM summary",
    "summary",
)
def summary_panel(spark, sf_dir):
    return ru.summary_panel(_summary(spark, sf_dir))


# Rankings


def _rank_sql(column, k, shown=None, condition="true"):
    return (
        f"SELECT project, rank, path, {shown or column} AS {column} FROM (SELECT *, row_number() OVER (PARTITION BY project "
        f"ORDER BY {column} DESC, path) AS rank FROM metrics WHERE {condition}) WHERE rank <= {k}"
    )


def _score_rounded(frame):
    return frame.withColumn("complexity_score", F.round("complexity_score", 4))


@registered(_rank_sql("complexity_score", 10, "round(complexity_score, 4)"), "metrics")
def top_complex(spark, sf_dir):
    return _score_rounded(rk.top_complex(_measured(spark, sf_dir)))


@registered(
    _rank_sql("complexity_score", 100, "round(complexity_score, 4)", "complexity_score > 0"), "metrics"
)
def complex_files(spark, sf_dir):
    return _score_rounded(rk.complex_files(_measured(spark, sf_dir)))


@registered(_rank_sql("sloc", 10), "metrics")
def top_sloc(spark, sf_dir):
    return rk.top_sloc(_lines(spark, sf_dir))


@registered(_rank_sql("size_bytes", 10), "metrics")
def top_bytes(spark, sf_dir):
    return rk.top_bytes(corpus.typed_files(spark, sf_dir))


@registered(
    _rank_sql("complexity_score", 10, "round(complexity_score, 4)", "complexity_score > 200 AND n_security + n_smells > 0"),
    "metrics",
)
def hotspots(spark, sf_dir):
    return _score_rounded(rk.hotspots(_judged(spark, sf_dir)))


_TOP_TABLE = (
    "SELECT project, rank, {path}, sloc, round(complexity_score, 4) AS complexity_score, n_security + n_smells AS issues, {extra} "
    "FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY complexity_score DESC, path) AS rank FROM metrics) WHERE rank <= {k}"
)


@registered(
    _TOP_TABLE.format(
        path="array_to_string(string_split(path, '/')[-2:], '/') AS file", k=10,
        extra="CASE WHEN n_security + n_smells = 0 THEN 'green' WHEN n_security + n_smells < 3 THEN 'yellow' ELSE 'red' END AS band",
    ),
    "metrics",
)
def hotspot_table(spark, sf_dir):
    return _score_rounded(rk.hotspot_table(_judged(spark, sf_dir)))


@registered(_TOP_TABLE.format(path="path", k=15, extra=f"{_CHART} AS badge"), "metrics")
def complex_table(spark, sf_dir):
    table = rk.complex_table(_judged(spark, sf_dir))
    return rk.sort_table(_score_rounded(table), "complexity_score")


# Reports


@registered(
    "SELECT project, path, language, loc, sloc, round(complexity_score, 4) AS complexity, classes, functions, methods, "
    "n_security AS security_issues, n_smells AS code_smells FROM metrics",
    "metrics",
)
def file_report(spark, sf_dir):
    return rp.file_report(_judged(spark, sf_dir)).withColumn("complexity", F.round("complexity", 4))


@registered(
    "SELECT metric_no, metric, round(a, 4) AS left_value, round(b, 4) AS right_value, round(b - a, 4) AS difference, "
    "format(CASE WHEN metric_no >= 6 THEN '{:,.1f}' ELSE '{:,.0f}' END, a) AS left_shown, "
    "format(CASE WHEN metric_no >= 6 THEN '{:,.1f}' ELSE '{:,.0f}' END, b) AS right_shown, "
    "CASE WHEN metric_no < 6 AND b = a THEN '0' ELSE (CASE WHEN b - a < 0 THEN '' ELSE '+' END) || "
    "format(CASE WHEN metric_no >= 6 THEN '{:,.1f}' ELSE '{:,.0f}' END, b - a) END AS difference_shown FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS metric_no, {text(label)} AS metric, max({column}::DOUBLE) FILTER (project = 'proj_1') AS a, "
        f"max({column}::DOUBLE) FILTER (project = 'prose_src7') AS b FROM summary"
        for i, (label, column, _) in enumerate(cp.COMPARED)
    ) + ")",
    "summary",
)
def compare_projects(spark, sf_dir):
    compared = cp.compare(_summary(spark, sf_dir), "proj_1", "prose_src7")
    return _rounded(compared, "left_value", "right_value", "difference")


@registered(
    "SELECT row_number() OVER (ORDER BY sloc DESC, path, project) AS rank, project, path, sloc FROM "
    "(SELECT project, path, loc - blanks - comments AS sloc FROM line_counts)",
    "line_counts",
)
def ranked_files(spark, sf_dir):
    """All files of all projects, ranked by source lines."""
    return ranked_table(_stored(spark, _lines(spark, sf_dir).select("project", "path", "sloc")), "sloc")


@registered(
    "SELECT m.project, s.total_files, s.total_loc, s.total_classes, round(s.code_quality_score, 4) AS code_quality_score, "
    "l.n AS language_files, m.path, m.language, m.loc, m.sloc, round(m.complexity_score, 4) AS complexity, m.n_security AS security_issues, "
    "m.n_smells AS code_smells, row_number() OVER (PARTITION BY m.project ORDER BY m.path) - 1 AS place "
    "FROM metrics m JOIN summary s ON s.project = m.project "
    "JOIN (SELECT project, language, count(*) AS n FROM metrics GROUP BY ALL) l ON l.project = m.project AND l.language = m.language",
    "metrics", "summary",
)
def nested_report(spark, sf_dir):
    """The nested documents, written, read again and taken apart."""
    folder = f"{shared_folder(spark)}/nested-{uuid.uuid4().hex}"
    metrics = _reported(spark, sf_dir)
    files = rp.file_report(metrics)
    projects = rp.project_report(ru.project_summary(metrics), ru.files_by_language(metrics))
    rp.write_nested(files, projects.withColumn("name", F.col("project")), f"{folder}/report")
    documents = rp.read_nested(
        spark, f"{folder}/report", files.drop("project").schema, projects.drop("project").schema.add("name", "string")
    )
    rows = documents.select("project", F.posexplode("files").alias("place", "file"))
    return rows.select(
        F.col("project.name").alias("project"), "project.total_files", "project.total_loc", "project.total_classes",
        F.round("project.code_quality_score", 4).alias("code_quality_score"),
        F.element_at("project.languages", F.col("file.language")).alias("language_files"), "file.path", "file.language",
        "file.loc", "file.sloc", F.round("file.complexity", 4).alias("complexity"), "file.security_issues", "file.code_smells",
        F.col("place").cast("long").alias("place"),
    )


@registered(
    "SELECT format, project, path, language, loc, sloc FROM (SELECT *, loc - blanks - comments AS sloc FROM line_counts), "
    "(VALUES ('json'), ('parquet'), ('csv')) AS f(format)",
    "line_counts",
)
def written_report(spark, sf_dir):
    """A report table, written in every format and read again."""
    folder = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    table = _lines(spark, sf_dir).select("project", "path", "language", "loc", "sloc")
    rp.write_report(table, folder, "all")
    out = None
    for name in rp.FORMATS:
        rows = spark.read.format(name).option("header", True).load(f"{folder}/{name}")
        rows = rows.select(F.lit(name).alias("format"), *[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns])
        out = rows if out is None else out.unionByName(rows)
    return out


@registered(
    "SELECT project, path, CASE WHEN length(path) % 5 = 0 THEN 0 ELSE size_bytes END AS size_bytes, "
    "length(path) % 7 <> 0 AS dated, md5(content) AS content_md5 FROM files"
)
def loaded_table(spark, sf_dir):
    """A raw table with gaps, bytes and other line ends, loaded as a files table."""
    files = corpus.files(spark, sf_dir)
    odd = F.replace("content", F.lit("\n"), F.when(F.length("path") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r")))
    raw = files.select(
        "project", "path", F.when(F.length("path") % 5 != 0, F.col("size_bytes")).alias("size_bytes"),
        F.when(F.length("path") % 7 != 0, F.col("modified_at")).alias("modified_at"), odd.cast("binary").alias("content"),
    )
    dated = (F.unix_timestamp("modified_at") > 86_400).alias("dated")
    return from_table(raw).select("project", "path", "size_bytes", dated, F.md5("content").alias("content_md5"))


@registered(
    "SELECT project, CASE WHEN path LIKE '%.go' THEN 'golang' ELSE language END AS language, count(*) AS files, "
    "any_value(CASE WHEN path LIKE '%.go' THEN '#' ELSE comment_marker END) AS marker FROM typed GROUP BY ALL"
)
def added_language(spark, sf_dir):
    """A language added at run time, which wins over the catalogue's."""
    analyzer = Analyzer(include_tests=True)
    analyzer.register_extension(Extension(".go", "golang", "other", "#"))
    typed = analyzer.discover(corpus.files(spark, sf_dir))
    return typed.groupBy("project", "language").agg(F.count("*").alias("files"), F.min("comment_marker").alias("marker"))


@registered()
def json_report(spark, sf_dir):
    """One JSON document per project and per file."""
    metrics = _reported(spark, sf_dir)
    projects = rp.project_report(ru.project_summary(metrics), ru.files_by_language(metrics))
    return rp.json_report(rp.file_report(metrics), projects)


@registered(
    "SELECT project, path, language, family, status, size_bytes, loc, sloc, blanks, comments, classes, functions, methods, cyclomatic, cognitive, "
    "halstead, maintainability_index, complexity_score, complexity_level, n_security, n_smells, duplicated_lines, patterns, custom_entries "
    "FROM (SELECT m.project, m.path, m.language, m.family, "
    "CASE WHEN t.content = '' THEN 'empty' ELSE 'ok' END AS status, m.size_bytes, m.loc, m.sloc, m.blanks, m.comments, m.classes, m.functions, "
    "m.methods, m.cyclomatic, m.cognitive, round(m.halstead, 4) AS halstead, round(m.maintainability_index, 4) AS maintainability_index, "
    "round(m.complexity_score, 4) AS complexity_score, m.complexity_level, m.n_security, m.n_smells, m.duplicated_lines, "
    "coalesce(p.n, 0)::BIGINT AS patterns, CASE WHEN m.language IN ('typescript', 'tsx') THEN 2 WHEN m.language = 'rust' THEN 4 ELSE 0 END::BIGINT AS custom_entries "
    "FROM metrics m JOIN typed t ON m.project = t.project AND m.path = t.path LEFT JOIN (SELECT project, path, count(*) AS n "
    "FROM pattern_hits GROUP BY ALL) p ON p.project = m.project AND p.path = m.path)",
    "metrics", "pattern_hits",
)
def file_metrics(spark, sf_dir):
    """The whole per-file table; arrays and the map are shown by their sizes."""
    metrics = fm.file_metrics(corpus.typed_files(spark, sf_dir))
    patterns = F.aggregate("pattern_counts", F.lit(0), lambda acc, c: acc + c["n"])
    rounded = [F.round(name, 4).alias(name) for name in ("halstead", "maintainability_index", "complexity_score")]
    return metrics.select(
        "project", "path", "language", "family", "status", F.col("size_bytes").cast("long").alias("size_bytes"),
        "loc", "sloc", "blanks", "comments", "classes", "functions", "methods", "cyclomatic", "cognitive", *rounded,
        "complexity_level", "n_security", "n_smells", "duplicated_lines",
        patterns.cast("long").alias("patterns"), F.size("custom").cast("long").alias("custom_entries"),
    )


_TODO = r"\b(TODO|FIXME|note)\b"


@registered(
    "SELECT project, count(*) AS files, sum(marks)::BIGINT AS marks, max(longest)::BIGINT AS longest_line FROM ("
    f"SELECT project, len(regexp_extract_all(text, {text(_TODO)})) AS marks, "
    f"list_max([length(l) FOR l IN string_split(text, {NL})]) AS longest FROM typed) GROUP BY project"
)
def custom_provider(spark, sf_dir):
    """Two registered providers: custom file metrics, and project hooks over them in one aggregation."""
    longest = F.array_max(F.transform(F.split("text", "\n", -1), F.length))
    analyzer = Analyzer()
    marks = F.sum(F.col("custom")["notes.marks"]).cast("long")
    analyzer.register_provider(
        Provider("notes", {"marks": F.regexp_count("text", F.lit(_TODO)), "longest": longest}, {"marks": marks})
    )
    hooks = {"files": F.count("*"), "longest_line": F.max(F.col("custom")["notes.longest"]).cast("long")}
    analyzer.register_provider(Provider("size", {}, hooks))
    metrics = analyzer.file_metrics(corpus.files(spark, sf_dir))
    return analyzer.project_metrics(metrics).select("project", "files", "marks", "longest_line")


_ADDED = [
    ("notes", "custom", "python", "note", r"\b(TODO|FIXME|note)\b", None, "minor", None, "a note", False),
    ("returned_name", "custom", "js", "style", r"return\s+\w+;", "return", "minor", None, "a name is returned", False),
    ("shouted", "custom", "js", "style", "const", "const", "minor", None, "in any case", True),
]


@registered(
    "SELECT project, rule_id, sum(n)::BIGINT AS matches, count(*) AS files FROM ("
    + " UNION ALL ".join(
        f"SELECT project, {text(rule_id)} AS rule_id, len(regexp_extract_all(text, {text(('(?i)' if fold else '') + pattern)})) AS n "
        f"FROM typed WHERE family = {text(family)}"
        for rule_id, _, family, _, pattern, _, _, _, _, fold in _ADDED
    )
    + ") WHERE n > 0 GROUP BY project, rule_id"
)
def added_rules(spark, sf_dir):
    """Rules that are rows of a table, used as a table function."""
    rules = rt.rules_of(spark.createDataFrame(_ADDED, rt.SCHEMA))
    rt.register(spark, "added_rules", rules)
    return rt.matched(_texts(spark, sf_dir).select("project", "path", "text", "family"), "added_rules")


@registered(
    "SELECT project, path, unnest(['cyclomatic', 'cognitive', 'maintainability', 'halstead']) AS metric, "
    "unnest([round(cyclomatic::DOUBLE, 4), round(cognitive::DOUBLE, 4), round(maintainability_index, 4), round(halstead, 4)]) AS value "
    "FROM complexity",
    "complexity",
)
def named_metrics(spark, sf_dir):
    """The named measures of every file, as rows."""
    named = cx.named_metrics(*[F.col(n) for n in ("cyclomatic", "cognitive", "maintainability_index", "halstead")])
    rows = _measured(spark, sf_dir).select("project", "path", F.explode(named).alias("metric", "value"))
    return _rounded(rows, "value")
