"""Repeated six-line chunks, within a file and across files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import let, lines_of, strip

# Fixed values.
CHUNK_LINES = 6
MIN_CHUNK_CHARS = 30

CHUNK_PAIR = "struct<first:int,second:int>"
_EMPTY_PAIRS = f"cast(array() as array<{CHUNK_PAIR}>)"
_EMPTY_CHUNKS = "cast(array() as array<struct<a:bigint,b:bigint,line:int>>)"


def chunks_of(content: Column) -> Column:
    """array<struct<a,b,line>>: every six-line chunk of enough text.

    a and b are a 128-bit hash over the hashes of the six lines, so neither a sort nor a shuffle
    carries chunk text and each line is hashed once, not six times. The struct is flat: Spark sets up the
    comparison of a struct within a struct anew for every pair that a sort compares.
    """

    found = let(
        lines_of(content),
        lambda lines: F.when(F.size(lines) >= CHUNK_LINES, _chunks(lines)).otherwise(F.expr(_EMPTY_CHUNKS)),
    )
    return F.when(content.isNotNull(), found).otherwise(F.expr(_EMPTY_CHUNKS))


def _windows(items: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``items`` merged over every six neighbours, by twos, fours and sixes; what lies behind the last whole window is
    merged with nothing and means nothing."""

    def with_next(these: Column, others: Column, step: int) -> Column:
        return F.zip_with(these, F.slice(others, F.lit(step + 1), F.size(others)), merge)

    return let(
        with_next(items, items, 1),
        lambda twos: with_next(with_next(twos, twos, 2), twos, 4),
    )


def _hashed(hashes: Column) -> Column:
    """One hash for every six-line chunk, from the hashes of the lines."""
    windows = let(hashes, lambda each: _windows(each, lambda x, y: F.xxhash64(x, y)))
    return let(windows, lambda each: F.slice(each, F.lit(1), F.size(each) - (CHUNK_LINES - 1)))


def _chunks(of: Column) -> Column:
    """``chunks_of`` the lines of a text that has enough of them."""

    def measured(lines: Column) -> Column:
        solid = F.transform(lines, lambda line: F.length(strip(line)))
        return F.struct(
            lines.alias("lines"),
            _hashed(F.transform(lines, lambda line: F.xxhash64(line))).alias("a"),
            _hashed(F.transform(lines, lambda line: F.xxhash64(F.lit(1), line))).alias("b"),
            let(solid, lambda each: _windows(each, lambda x, y: x + y)).alias("solid"),
        )

    def big(m: Column, i: Column) -> Column:
        """Whether the chunk at ``i`` has enough characters without white space at its ends. The
        stripped lines are a lower bound; only below it the text is put together."""
        text = F.array_join(F.slice(m["lines"], i + 1, F.lit(CHUNK_LINES)), "\n")
        return (F.get(m["solid"], i) >= MIN_CHUNK_CHARS) | (F.length(strip(text)) >= MIN_CHUNK_CHARS)

    def keyed(m: Column) -> Column:
        each = F.zip_with(m["a"], m["b"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        placed = F.transform(
            each,
            lambda key, i: F.when(
                big(m, i), F.struct(key["a"].alias("a"), key["b"].alias("b"), (i + 1).alias("line"))
            ),
        )
        return F.filter(placed, lambda c: c.isNotNull())

    return let(measured(of), keyed)


def _any_repeated(lines: Column) -> Column:
    """Whether two six-line chunks have one hash: half a key, of all chunks, as the test that most files fail."""
    chunks = _hashed(F.transform(lines, lambda line: F.xxhash64(line)))
    return let(chunks, lambda each: F.size(F.array_distinct(each)) < F.size(each))


def _same(one: Column, other: Column) -> Column:
    return (one["a"] == other["a"]) & (one["b"] == other["b"])


def repeated_chunks(content: Column) -> Column:
    """array<struct<first,second>>: the first two places (1-based lines) of each repeated chunk.

    Sorting (a, b, line) within the row brings copies together, so no lines leave their file's row.
    """

    def pairs(ordered: Column) -> Column:
        def same(i: Column, back: int, chunk: Column) -> Column:
            return F.coalesce(_same(F.get(ordered, i - back), chunk), F.lit(False))

        # Where a key occurs for the second time, its first place is the entry before.
        marked = F.transform(
            ordered,
            lambda c, i: F.when(
                same(i, 1, c) & ~same(i, 2, c),
                F.struct(F.get(ordered, i - 1)["line"].alias("first"), c["line"].alias("second")),
            ),
        )
        return F.filter(marked, lambda pair: pair.isNotNull())

    def repeated(chunks: Column) -> Column:
        hashes = F.transform(chunks, lambda c: c["a"])
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(F.sort_array(chunks), pairs)).otherwise(F.expr(_EMPTY_PAIRS))

    def some(lines: Column) -> Column:
        # Two distinct starts need one line more than a chunk, and every line of the later one has an equal line before it.
        enough = F.size(lines) > CHUNK_LINES
        return enough & (F.size(lines) - F.size(F.array_distinct(lines)) >= CHUNK_LINES) & _any_repeated(lines)

    found = let(
        lines_of(content),
        lambda lines: F.when(some(lines), let(_chunks(lines), repeated)).otherwise(F.expr(_EMPTY_PAIRS)),
    )
    return F.when(content.isNotNull(), found).otherwise(F.expr(_EMPTY_PAIRS))


def duplicated_lines(chunks: Column) -> Column:
    return F.size(chunks) * CHUNK_LINES


def cross_file_duplicates(files: DataFrame) -> DataFrame:
    """Chunks that occur in at least two files: how many files and places, and the first place.

    Copies within a file are folded before the shuffle; the counts and the minimum combine on the
    map side, so a chunk that most files share (a licence header) sends one row per task.
    """
    folded = files.select(
        "project",
        "path",
        F.explode(_per_file(F.sort_array(chunks_of(F.col("content"))))).alias("chunk"),
    )
    return (
        folded.groupBy(F.col("chunk.a").alias("key_a"), F.col("chunk.b").alias("key_b"))
        .agg(
            F.count("*").alias("n_files"),
            F.sum(F.col("chunk.n").cast("long")).alias("n_places"),
            F.min(F.struct("project", "path", F.col("chunk.line").alias("line"))).alias("first"),
        )
        .where(F.col("n_files") >= 2)
        .select(
            F.col("first.project").alias("first_project"),
            F.col("first.path").alias("first_path"),
            F.col("first.line").alias("first_line"),
            "n_files",
            "n_places",
        )
    )


def clone_regions(files: DataFrame) -> DataFrame:
    """The maximal stretches of lines of each file whose six-line chunks all occur in another file too.

    project, path, first_line, last_line, n_chunks, and fewest_files and most_files: the fewest and most files that hold
    one of its chunks. Keys are counted by file on fixed-width rows, one for each chunk of a file; only chunks of shared keys
    are rows again and are merged by the distance of their lines within the file, which was one row before.
    """
    chunks = chunks_of(F.col("content"))
    once = files.select(F.explode(_per_file(F.sort_array(chunks))).alias("chunk"))
    keys = [F.col("chunk.a").alias("key_a"), F.col("chunk.b").alias("key_b")]
    shared = once.groupBy(*keys).agg(F.count("*").alias("n_files")).where(F.col("n_files") >= 2)
    places = files.select("project", "path", F.explode(chunks).alias("chunk"))
    places = places.select("project", "path", F.col("chunk.line").alias("line"), *keys).join(shared, ["key_a", "key_b"])
    number = F.row_number().over(Window.partitionBy("project", "path").orderBy("line"))
    return (
        places.withColumn("region", F.col("line") - number)
        .groupBy("project", "path", "region")
        .agg(
            F.min("line").alias("first_line"),
            (F.max("line") + CHUNK_LINES - 1).alias("last_line"),
            F.count("*").alias("n_chunks"),
            F.min("n_files").alias("fewest_files"),
            F.max("n_files").alias("most_files"),
        )
        .drop("region")
    )


def _per_file(ordered: Column) -> Column:
    """array<struct<a,b,line,n>>: one entry per distinct chunk of a file, with its first line. The
    run length of a key is the distance between the starts of neighbouring runs."""

    def starts(chunks: Column) -> Column:
        marked = F.transform(
            chunks,
            lambda c, i: F.struct(
                c["a"].alias("a"),
                c["b"].alias("b"),
                c["line"].alias("line"),
                i.alias("at"),
                (~F.coalesce(_same(F.get(chunks, i - 1), c), F.lit(False))).alias("opens"),
            ),
        )
        return let(
            F.filter(marked, lambda m: m["opens"]),
            lambda runs: F.transform(
                runs,
                lambda r, i: F.struct(
                    r["a"].alias("a"),
                    r["b"].alias("b"),
                    r["line"].alias("line"),
                    (F.coalesce(F.get(runs, i + 1)["at"], F.size(chunks)) - r["at"]).alias("n"),
                ),
            ),
        )

    return let(ordered, starts)
