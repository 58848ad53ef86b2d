"""Line dedup with DataFrame functions only: lines found in many documents go, the others stay in their order.

A line's key is named by two 64-bit hashes. Documents are counted for each name, after one row a name and document; the
names of frequent keys then meet the lines again, as narrow rows (name, text's name, position), and the positions
to drop come back to each text, which is cut at \\n a second time. Whole texts are moved once at most, and not at all where
Spark finds the positions small enough to broadcast. Hot names and hot copies of a text are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import let
from codeloom.llm.steps import settled

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_POINTS = 1
LEAST_DOCUMENTS = 10


def key(line: Column) -> Column:
    """line without the white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def _names(value: Column, prefix: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), value).alias(f"{prefix}{k}") for k in (1, 2)]


def _cut(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lines(docs: DataFrame, least_points: int) -> DataFrame:
    """doc_id, text1, text2 (the text's name), position and key1, key2 (the key's name) of lines with a long enough key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", *_names(text, "text"), F.posexplode(_cut(F.col("text"))).alias("position", "line"))
    named = cut.select("doc_id", "text1", "text2", "position", key(F.col("line")).alias("key"))
    named = named.filter(F.length("key") >= least_points)
    return named.select("doc_id", "text1", "text2", "position", *_names(F.col("key"), "key"))


def frequent(docs: DataFrame, least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """key1, key2 and n_docs of the keys found in at least least_documents documents of docs (doc_id, text).

    Rows of one doc_id are one document, and so are all rows whose doc_id is null.
    """
    once = _lines(docs, least_points).select("key1", "key2", "doc_id").distinct()
    return once.groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= least_documents)


def _kept(text: Column, dropped: Column) -> Column:
    """text without the lines at the positions in dropped; an array_except of positions is one pass over both."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n")

    return F.when(dropped.isNull(), text).otherwise(let(_cut(text), rest))


def _judged(docs: DataFrame, least_points: int, least_documents: int) -> DataFrame:
    """row (a struct of docs' columns), text, and dropped: the positions of the lines that go, null for none."""
    given = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    plain = given.select("doc_id", "text")
    often = settled(frequent(plain, least_points, least_documents).select("key1", "key2"))
    lines = _lines(plain, least_points).join(often, ["key1", "key2"], "left_semi")
    gone = settled(lines.groupBy("text1", "text2").agg(F.collect_set("position").alias("dropped")))
    rows = given.select("row", "text", *_names(F.coalesce(F.col("text"), F.lit("")), "text"))
    return rows.join(gone, ["text1", "text2"], "left").select("row", "text", "dropped")


def cleaned(docs: DataFrame, least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with the frequent lines taken out of text; all rows and columns stay, a null text stays null."""
    judged = _judged(docs, least_points, least_documents)
    return judged.select(
        *[F.col("row")[n].alias(n) if n != "text" else _kept(F.col("text"), F.col("dropped")).alias(n) for n in docs.columns]
    )


def dedup(docs: DataFrame, least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and kept_sha256 of every row of docs (doc_id, text).

    A null or empty text is one empty line. Keys with fewer than least_points code points are never dropped. Repeated rows
    are judged alike and each gives a row; rows of one doc_id, or of none, count as one document. Equal keys within a
    document count once, and all their lines go. Other columns are left out. An empty table gives an empty result.
    """
    judged = _judged(docs.select("doc_id", "text"), least_points, least_documents)
    return judged.select(
        "row.doc_id",
        F.size(_cut(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(_kept(F.col("text"), F.col("dropped")), F.lit("")), 256).alias("kept_sha256"),
    )


def dedup_sql(least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS) -> str:
    """The same in DuckDB."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH cut AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut
), named AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{lower}') AS name
    FROM placed
), often AS (
    SELECT name FROM named WHERE length(name) >= {least_points} GROUP BY name HAVING count(DISTINCT doc_id) >= {least_documents}
), judged AS (
    SELECT *, name IN (SELECT name FROM often) AS gone FROM named
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
