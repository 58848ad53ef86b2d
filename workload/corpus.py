"""Files tables over the driver tables, in Spark and in DuckDB SQL.

Every file is a narrow function of one row: orders give ordinary files, suppliers long ones and
documents prose. No rows are gathered into a file, so no key can make one task large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.constants.languages import extension_rows
from codeloom.operators.discovery import with_language
from workload import snippets as sn

COLUMNS = ["project", "path", "size_bytes", "modified_at", "content"]
LONG_KINDS = [
    (".py", sn.LONG_PYTHON), (".py", sn.LONG_METHODS), (".js", sn.LONG_JS), (".js", sn.LONG_OBJECT),
    (".d.ts", sn.LONG_DEFINITION), (".go", sn.LONG_REPEAT),
]


class Spark:
    """Spark's spelling of what the two engines write differently."""

    @staticmethod
    def text(value):
        # "${" would start a variable substitution.
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$\\u007b") + "'"

    @classmethod
    def pick(cls, values, index):
        return f"element_at(array({', '.join(cls.text(v) for v in values)}), cast({index} as int))"

    @staticmethod
    def joined(count, item):
        return f"array_join(transform(sequence(1L, {count}), j -> {item}), chr(10))"

    size = "octet_length({})"


class Duck:
    @staticmethod
    def text(value):
        return "'" + value.replace("'", "''") + "'"

    @classmethod
    def pick(cls, values, index):
        return f"[{', '.join(cls.text(v) for v in values)}][{index}]"

    @staticmethod
    def joined(count, item):
        return f"array_to_string(list_transform(range(1, {count} + 1), lambda j: {item}), chr(10))"

    size = "strlen({})"


def _pieces(engine, values):
    index = f"(o_orderkey * (j * 7 + 3) + o_custkey * (j + 2) + j * j) % {len(values)} + 1"
    return engine.joined("o_orderkey % 9 + 1", engine.pick(values, index))


def _order_extension():
    """Mostly the analysed languages, with upper-case and catalogue suffixes among them."""
    return (
        "CASE WHEN o_orderkey % 16 < 5 THEN '.py' WHEN o_orderkey % 16 < 8 THEN '.js' "
        "WHEN o_orderkey % 16 = 8 THEN '.jsx' WHEN o_orderkey % 16 < 11 THEN '.ts' "
        "WHEN o_orderkey % 16 = 11 THEN '.tsx' WHEN o_orderkey % 16 = 12 THEN '.rs' "
        "WHEN o_orderkey % 16 = 13 THEN '.d.ts' WHEN o_orderkey % 16 = 14 THEN "
        "CASE o_custkey % 5 WHEN 0 THEN '.java' WHEN 1 THEN '.go' WHEN 2 THEN '.rb' WHEN 3 THEN '.php' "
        "ELSE '.cpp' END ELSE '.PY' END"
    )


def _order_content(engine):
    body = (
        f"CASE WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 16 < 5 OR o_orderkey % 16 = 15 THEN {_pieces(engine, sn.PYTHON)} "
        f"WHEN o_orderkey % 16 < 12 THEN {_pieces(engine, sn.JAVASCRIPT)} "
        f"WHEN o_orderkey % 16 = 12 THEN {_pieces(engine, sn.RUST)} "
        f"WHEN o_orderkey % 16 = 13 THEN {_pieces(engine, sn.DEFINITIONS)} "
        f"ELSE {_pieces(engine, sn.OTHER)} END"
    )
    return f"replace(replace({body}, '@K@', cast(o_custkey as string)), '@P@', o_orderpriority)"


def _orders(engine):
    return [
        {
            "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "modified_at": "o_orderdate",
            "extension": _order_extension(), "content": _order_content(engine),
        },
        {
            "project": "concat('proj_', cast(o_custkey % 10 as string))",
            "path": "concat('src/m', cast(o_custkey % 37 as string), '/f', cast(o_orderkey as string), extension)",
            "size_bytes": f"cast({engine.size.format('content')} as bigint)",
            "modified_at": "modified_at",
            "content": "content",
        },
    ]


def _suppliers(engine):
    kind = f"s_suppkey % {len(LONG_KINDS)} + 1"
    body = engine.joined("(s_suppkey * 37) % 260 + 1", "replace(unit, '@I@', cast(j as string))")
    return [
        {
            "s_suppkey": "s_suppkey",
            "extension": engine.pick([extension for extension, _ in LONG_KINDS], kind),
            "head": engine.pick([head for _, (head, _) in LONG_KINDS], kind),
            "unit": engine.pick([unit for _, (_, unit) in LONG_KINDS], kind),
        },
        {
            "s_suppkey": "s_suppkey",
            "extension": "extension",
            "content": f"replace(concat(head, chr(10), {body}), '@K@', cast(s_suppkey as string))",
        },
        {
            "project": "'proj_long'",
            "path": "concat('src/long/s', cast(s_suppkey as string), extension)",
            "size_bytes": f"cast({engine.size.format('content')} as bigint)",
            "modified_at": "cast('2024-01-01 00:00:00' as timestamp)",
            "content": "content",
        },
    ]


def _documents(engine):
    suffix = (
        "CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.ts' WHEN 'es' THEN '.rs' "
        "ELSE '.java' END"
    )
    return [
        {
            "project": "concat('prose_', source)",
            "path": f"concat('text/d', cast(doc_id as string), {suffix})",
            "size_bytes": f"cast({engine.size.format('text')} as bigint)",
            "modified_at": "cast('2024-01-01 00:00:00' as timestamp)",
            "content": "text",
        }
    ]


# The layers of expressions that turn a driver table into files; each layer selects from the one before.
PARTS = {"orders": _orders, "supplier": _suppliers, "documents": _documents}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: How many partitions the rows of a table are dealt to before rules run over them; unset, the table's size decides.
PARTITIONS = "spark.codeloom.workload.partitions"
#: Rows that one task measures at most, when unset. A table's bytes say little about the work: a few bytes of keys make a
#: whole file, and a row group of a million of them is one task of the scan.
TASK_ROWS = {"orders": 10_000, "supplier": 250, "documents": 2_500}


def dealt(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a table, dealt to tasks of about equal size, however few row groups it was written in."""
    number = int(rows.sparkSession.conf.get(PARTITIONS, "0"))
    return rows.repartition(number or max(1, -(-rows.count() // TASK_ROWS[name])))


def files(spark: SparkSession, sf_dir: str, parts=("orders", "supplier", "documents")) -> DataFrame:
    """The whole files table."""
    out = None
    for name in parts:
        rows = dealt(_source_columns(read(spark, sf_dir, name), name), name)
        for layer in PARTS[name](Spark):
            rows = rows.selectExpr(*[f"{value} AS {alias}" for alias, value in layer.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def _source_columns(rows: DataFrame, name: str) -> DataFrame:
    used = {
        "orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"],
        "supplier": ["s_suppkey"],
        "documents": ["doc_id", "text", "lang", "source"],
    }
    return rows.select(*used[name])


def typed_files(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The files table with languages."""
    return with_language(files(spark, sf_dir), **options)


# DuckDB


def files_sql() -> str:
    parts = []
    for name, layers in PARTS.items():
        query = name
        for layer in layers(Duck):
            selected = ", ".join(f"{value} AS {alias}" for alias, value in layer.items())
            query = f"(SELECT {selected} FROM {query})"
        parts.append(query)
    return " UNION ALL ".join(parts)


def languages_sql() -> str:
    rows = ", ".join(
        f"('{r.extension}', '{r.language}', '{r.family}', '{r.comment_marker}')" for r in extension_rows()
    )
    return f"SELECT * FROM (VALUES {rows}) AS v(extension, language, family, comment_marker)"


def corpus_ctes() -> str:
    """Common table expressions: files, languages, typed. ``text`` is what the rules see."""
    return f"""
files AS ({files_sql()}),
languages AS ({languages_sql()}),
typed AS MATERIALIZED (
  SELECT f.project, f.path, f.size_bytes, f.modified_at, f.content, l.language, l.family, l.comment_marker,
         ends_with(f.path, '.d.ts') AS is_definition,
         CASE WHEN ends_with(f.path, '.d.ts') THEN '' ELSE f.content END AS text
  FROM files f JOIN languages l
    ON lower(regexp_extract(f.path, '[^/](\\.[^./]+)$', 1)) = l.extension)"""
