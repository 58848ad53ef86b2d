"""Rollups, rankings, comparison, reports, sources and extensions."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom.constants import rules as R
from codeloom.constants.languages import Extension
from codeloom.operators import findings as fd
from codeloom.operators.discovery import short_path, with_language
from codeloom.operators.duplicates import clone_regions, cross_file_duplicates
from codeloom.operators.scores import grade, issue_band
from codeloom.plans import compare as cp
from codeloom.plans import file_metrics as fm
from codeloom.plans import file_sets as fs
from codeloom.plans import incremental as inc
from codeloom.plans import rankings as rk
from codeloom.plans import reports as rp
from codeloom.plans import rollups as ru
from codeloom.plans import rule_tables as rt
from codeloom.plans.order import numbered, ranked_table
from codeloom.plans.registry import Analyzer, Provider
from codeloom.plans.reports import write_nested
from codeloom.sources.directory import TreeReader
from codeloom.sources.tables import from_directory, from_table, source_files

BLOCK = "".join(f"shared_{i} = load({i})\n" for i in range(8))
FILES = {
    "a.py": "import os\nimport os\ncursor.execute(a + b)\nif x:\n    y = 1\n",
    "b.py": BLOCK + "z = 1\n" + BLOCK,
    "c.js": "eval(x)\nconst q = 1;\n" + BLOCK,
    "d.rs": "\nuse a;\nfn main() {}\n",
}


@pytest.fixture(scope="module")
def metrics(typed_of):
    both = typed_of(FILES).unionByName(typed_of({"e.py": "# only a comment\n", "f.py": ""}, project="bare"))
    return fm.file_metrics(both).cache()


def test_summary_and_invariants(metrics):
    rows = {r.project: r for r in ru.project_summary(metrics).collect()}
    files = [r for r in metrics.collect() if r.project == "p"]
    p, bare = rows["p"], rows["bare"]
    assert p.total_loc == sum(f.loc for f in files) == p.total_sloc + p.total_blanks + p.total_comments
    assert sum(p[f"files_{n}"] for n in ("trivial", "low", "moderate", "high", "very_high", "extreme")) == p.total_files == 4
    assert 0 <= p.code_quality_score <= 100 and 0 <= p.maintainability_score <= 100
    assert p.n_security_total == 3 and p.security_score == 100 - 3 / 4 * 20
    assert p.duplicated_lines_ratio == 18 / p.total_sloc
    # No source lines: the default scores stay.
    assert bare.total_sloc == 0 and bare.code_quality_score == 100 and bare.security_score == 100
    assert bare.maintainability_score == 0


def test_zero_filled_bins(metrics):
    assert ru.complexity_distribution(metrics).where("project = 'bare'").count() == 6
    chart = {r.severity_bin: r.issues for r in ru.security_chart(metrics).where("project = 'p'").collect()}
    assert chart == {"Critical": 2, "High": 1, "Medium": 0, "Low": 0}
    assert {r.smells for r in ru.smell_chart(metrics).where("project = 'bare'").collect()} == {0}
    sizes = ru.size_histogram(metrics.withColumn("sloc", F.lit(-1))).collect()
    assert len(sizes) == 10 and {r.files for r in sizes} == {0}


def test_rankings_break_ties_by_path(spark):
    rows = [("p", f"f{i:03}", float(i // 2), i, i, 0) for i in range(40)] + [("q", "x", 500.0, 1, 1, 0), ("q", "y", 300.0, 1, 1, 2)]
    table = spark.createDataFrame(rows, "project string, path string, complexity_score double, sloc long, size_bytes long, n_security long")
    table = table.withColumn("n_smells", F.lit(0).cast("long"))
    top = [r.path for r in rk.top_complex(table, 3).where("project = 'p'").orderBy("rank").collect()]
    assert top == ["f038", "f039", "f036"]
    assert [r.path for r in rk.hotspots(table).collect()] == ["y"]
    assert rk.complex_files(table, 100).where("project = 'p'").count() == 38
    ordered = [r.path for r in rk.sort_table(table, "sloc", descending=False).limit(2).collect()]
    assert ordered == ["f000", "f001"]
    plan = rk.top_complex(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # before and after each of the two exchanges


def test_dependencies(metrics):
    rows = [(r.module, r.uses) for r in rk.top_dependencies(ru.dependency_counts(metrics)).collect()]
    assert rows == [("import os", 2), ("use_statement_1", 1)]


def test_rules_run_once_under_security_by_level(typed_of):
    levels = ru.security_by_level(fm.with_security(fm.with_text(typed_of(FILES))))
    plan = levels._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "regexp_extract_all" in line]
    assert sorted((r.level, r.issues) for r in levels.collect()) == [("critical", 2), ("high_risk", 1)]


def test_compare(metrics):
    rows = {r.metric: r for r in cp.compare(ru.project_summary(metrics), "p", "bare").collect()}
    assert rows["Files"].difference_shown == "-2" and rows["Classes"].difference_shown == "0"
    assert rows["Code Quality"].right_shown == "100.0" and rows["Code Quality"].difference_shown.startswith("+")
    missing = {r.metric: r for r in cp.compare(ru.project_summary(metrics), "p", "nowhere").collect()}
    assert missing["Files"].left_value == 4 and missing["Files"].right_value is None


def test_cross_file_duplicates(files_of):
    texts = {f"{i}.py": BLOCK for i in range(5)} | {"own.py": BLOCK + BLOCK, "short.py": "a\n" * 20}
    found = sorted((r.first_path, r.first_line, r.n_files, r.n_places) for r in cross_file_duplicates(files_of(texts)).collect())
    assert found == [("0.py", 1, 6, 7), ("0.py", 2, 6, 7), ("0.py", 3, 6, 7), ("0.py", 4, 6, 6)]


def test_reports_and_sinks(metrics, tmp_path, spark):
    report = rp.file_report(metrics)
    assert report.columns[1:] == [
        "path", "language", "loc", "sloc", "complexity", "classes", "functions", "methods", "security_issues", "code_smells",
    ]
    rp.write_report(report, str(tmp_path / "out"), "all")
    for fmt in rp.FORMATS:
        reader = spark.read.option("header", True)
        assert reader.format(fmt).load(f"{tmp_path}/out/{fmt}").count() == 6
    projects = rp.project_report(ru.project_summary(metrics), ru.files_by_language(metrics))
    documents = rp.json_report(report, projects).collect()
    project = json.loads(next(d.document for d in documents if d.part == "project" and d.project == "p"))
    assert project["languages"] == {"python": 2, "javascript": 1, "rust": 1}
    assert sum(project["complexity_distribution"].values()) == 4
    assert sum(d.part == "file" for d in documents) == 6
    with pytest.raises(ValueError):
        rp.write_report(report, str(tmp_path / "x"), "html")


def test_directory_source_keeps_underscore_names(spark, tmp_path):
    for path, data in {
        "a.py": b"x = 1\r\ny\xff = 2\r", "pkg/__init__.py": b"", "pkg/_deep/er/z.js": b"eval(x)", "node_modules/m.js": b"eval(x)",
    }.items():
        target = tmp_path / "proj" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    files = from_directory(spark, str(tmp_path / "proj"), prune=("node_modules",))
    rows = {r.path: r for r in files.collect()}
    assert set(rows) == {"a.py", "pkg/__init__.py", os.path.join("pkg", "_deep", "er", "z.js")}
    assert rows["a.py"].content == "x = 1\ny = 2\n" and rows["a.py"].size_bytes == 14 and rows["a.py"].project == "proj"
    assert files.rdd.getNumPartitions() > 1
    metrics = fm.file_metrics(with_language(files)).collect()
    assert sum(r.n_security for r in metrics) == 1


@pytest.fixture
def tree(tmp_path):
    """Three projects with what an analysis leaves out, none of which can be opened."""
    kept = [f"one/src/f{k:04}.py" for k in range(1200)] + ["one/a.PY", "two/deep/er/and/er/b.rs", "two/_x/__init__.py", "three/z.js", "root.ts"]
    left = ["one/node_modules/m.js", "one/tests/t.py", "two/pic.png", "two/yarn.lock", "two/a.min.js", "two/.py", "three/gen/g.py", "three/noext"]
    for path in kept + left:
        target = tmp_path / "repos" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        if path in left:
            target.symlink_to("/dev/nowhere/" + path.replace("/", "-"))
        else:
            target.write_text(f"# {path}\n")
    return tmp_path / "repos", kept


def test_excluded_files_are_never_opened(spark, tree):
    root, kept = tree
    for dealing in ({}, {"split_depth": 0, "slices": 5}, {"split_depth": 1, "slices": 2}, {"split_depth": 9}):
        files = source_files(spark, str(root), exclude_dirs=("gen",), projects=True, **dealing)
        rows = {(r.project, r.path): r for r in files.collect()}
        split = [p.split("/", 1) if "/" in p else ["repos", p] for p in kept]
        assert set(rows) == {tuple(p) for p in split} and len(rows) == files.count()
        # a file that had been tried would be unreadable
        assert all(r.content is not None and r.size_bytes > 0 for r in rows.values())
        assert files.where("path = 'src/f0001.py'").count() == 1


def test_folders_are_dealt_and_filters_pushed(spark, tree):
    from pyspark.sql import datasource as ds

    root, kept = tree
    reader = TreeReader({"path": str(root), "projects": "true", "splitDepth": "2", "namesPerPartition": "100"})
    reader.split_depth = 3
    wide = [p for p in reader.partitions() if p.path.endswith("one/src")]
    assert len(wide) == 12 and not any(p.recursive for p in wide)
    conditions = [ds.EqualTo(("project",), "two"), ds.StringEndsWith(("path",), ".rs"), ds.GreaterThan(("size_bytes",), 3), ds.Not(ds.In(("path",), ("a", "b")))]
    assert list(reader.pushFilters(conditions)) == [conditions[2]]
    opened = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert [(r["project"], r["path"]) for r in opened] == [("two", "deep/er/and/er/b.rs")]
    files = from_directory(spark, str(root), projects=True).where("project = 'three' AND path LIKE '%.js'")
    assert [r.path for r in files.collect()] == ["z.js"]


def test_raw_table_gaps_are_filled(spark):
    raw = spark.sql("SELECT 'p' AS project, 'a.py' AS path, cast(null AS bigint) AS size_bytes, cast(null AS timestamp) AS modified_at, cast('x' AS binary) AS content")
    row = from_table(raw).collect()[0]
    assert row.size_bytes == 0 and row.modified_at.year == 1970 and row.content == "x"


def test_providers_languages_and_exclusions(files_of):
    analyzer = Analyzer(exclude_dirs=("gen",), include_tests=True)
    analyzer.register_extension(Extension(".zig", "zig", "other", "//"))
    provider = Provider("text", {"chars": F.length("text")}, {"chars": F.sum(F.col("custom")["text.chars"])})
    analyzer.register_provider(provider)
    analyzer.register_provider(provider)
    analyzer.register_provider(Provider("more", {}, {"chars": F.count("*"), "total_loc": F.max("loc")}))
    files = files_of({"gen/a.py": "x", "tests/b.py": "xyz", "c.zig": "// if a\n// for b\n// let c\n"})
    metrics = analyzer.file_metrics(files)
    rows = {r.path: r for r in metrics.collect()}
    assert set(rows) == {"tests/b.py", "c.zig"} and rows["tests/b.py"].custom["text.chars"] == 3
    assert rows["c.zig"].n_smells == 1 and rows["c.zig"].language == "zig"
    totals = analyzer.project_metrics(metrics)
    assert [(r.project, r.chars, r["more.chars"], r["more.total_loc"], r.total_loc) for r in totals.collect()] == [("p", 3 + 26, 2, 4, 5)]
    plan = totals._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1  # one aggregation for any number of hooks


def test_bands_and_paths(spark):
    frame = spark.createDataFrame([(0, "/r/a/b.py"), (2, "b.py"), (60, "/q/x/y.py"), (80, "/r/z.py")], "n int, path string")
    rows = frame.select(grade(F.col("n")).alias("g"), issue_band(F.col("n")).alias("i"), short_path(F.col("path"), "/r").alias("s")).collect()
    assert [r.g for r in rows] == ["red", "red", "yellow", "green"]
    assert [r.i for r in rows] == ["green", "yellow", "red", "red"]
    assert [r.s for r in rows] == ["a/b.py", "b.py", "x/y.py", "z.py"]


def test_file_grain_operators_run_on_a_stream(spark, files_of, tmp_path):
    """Per-file operators hold no state, so they also accept a streaming files table."""
    files_of(FILES).write.parquet(str(tmp_path / "files"))
    stream = spark.readStream.schema(files_of(FILES).schema).parquet(str(tmp_path / "files"))
    issues = fm.security_issues(with_language(stream))
    query = (
        issues.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_nested_report_streams_projects(spark, tmp_path):
    files = spark.createDataFrame(
        [("a/b", f"f{k:03}.py", k) for k in range(300)] + [("ü", "x.py", 1), ("ü", "a.py", 2)], "project string, path string, loc long"
    ).repartition(7)
    projects = spark.createDataFrame([("a/b", 300, {"python": 300}), ("ü", 2, {"python": 2}), ("none", 0, {})],
                                     "project string, total_files long, languages map<string,long>")
    for _ in range(2):  # the second run takes the place of the first
        write_nested(files, projects, str(tmp_path / "out"))
        names = sorted(os.listdir(tmp_path / "out"))
        assert names == ["%C3%BC.json", "a%2Fb.json", "none.json"]
    held = {n: json.load(open(tmp_path / "out" / n, encoding="utf-8")) for n in names}
    assert [f["path"] for f in held["a%2Fb.json"]["files"]] == [f"f{k:03}.py" for k in range(300)]
    assert held["%C3%BC.json"] == {"project": {"total_files": 2, "languages": {"python": 2}}, "files": [
        {"path": "a.py", "loc": 2}, {"path": "x.py", "loc": 1}]}
    assert held["none.json"]["files"] == []
    write_nested(files.where("project = 'ü'"), projects.where("project = 'ü'"), f"file://{tmp_path}/out")
    assert os.listdir(tmp_path / "out") == ["%C3%BC.json"]
    with pytest.raises(Exception, match="not a mounted folder"):
        write_nested(files, projects, "hdfs://host/out")


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_rows_are_numbered_in_one_order(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(5), f"p{rng.randrange(400):03}") for _ in range(700)]
    table = spark.createDataFrame(rows, "n int, path string").repartition(6)
    got = numbered(table, {"n": F.col("n"), "path": F.col("path")}, parts=parts).collect()
    assert [(r.n, r.path) for r in sorted(got, key=lambda r: r.rank)] == sorted(rows)
    assert sorted(r.rank for r in got) == list(range(1, 701))
    assert numbered(table.limit(0), {"n": F.col("n")}).count() == 0


def test_missing_values_rank_as_zero(spark):
    table = spark.createDataFrame([("p", "b", None), ("p", "a", 0.0), ("q", "a", 3.0), ("q", "c", -1.0)], "project string, path string, v double")
    down = {(r.project, r.path): r["rank"] for r in ranked_table(table, "v").collect()}
    assert down == {("q", "a"): 1, ("p", "a"): 2, ("p", "b"): 3, ("q", "c"): 4}
    up = {(r.project, r.path): r["rank"] for r in ranked_table(table, "v", descending=False).collect()}
    assert up == {("q", "c"): 1, ("p", "a"): 2, ("p", "b"): 3, ("q", "a"): 4}


def test_clone_regions_are_maximal(files_of):
    shared = [f"this is shared line number {k}" for k in range(20)]
    other = [f"only one file has line {k}" for k in range(30)]
    files = files_of({"a.py": "\n".join(other[:5] + shared + other[5:9]), "b.py": "\n".join(shared[:8] + other[9:12] + shared[8:]),
                      "c.py": "\n".join(other[12:]), "d.py": "\n".join(shared[:8])})
    got = {(r.path, r.first_line, r.last_line, r.n_chunks, r.fewest_files, r.most_files) for r in clone_regions(files).collect()}
    assert got == {("a.py", 6, 13, 3, 3, 3), ("a.py", 14, 25, 7, 2, 2), ("b.py", 1, 8, 3, 3, 3), ("b.py", 12, 23, 7, 2, 2), ("d.py", 1, 8, 3, 3, 3)}


def test_only_changed_files_are_analysed(spark, files_of, tmp_path):
    later = datetime.datetime(2024, 2, 1)
    was = files_of({"a.py": "x = 1\n", "b.py": "y = 2\nz = 3\n", "c.js": "eval(q)\n", "d.py": "w = 1\n", "e.py": None, "n.xyz": "no language"})
    rows = {r.path: r.asDict() for r in was.collect()}
    rows["b.py"] |= {"content": "y = 2\n", "size_bytes": 6}  # changed, same time
    rows["c.js"] |= {"modified_at": later}  # touched
    rows["d.py"] |= {"content": "w = 2\n", "modified_at": later}  # changed, same size
    del rows["a.py"]
    rows["f.rs"] = rows["d.py"] | {"path": "f.rs", "content": "fn main() {}\n"}
    files = spark.createDataFrame(list(rows.values()), was.schema)
    before = inc.analysed(was)
    # a mark in the old table shows which rows were kept
    before = before._replace(metrics=before.metrics.withColumn("blanks", F.lit(77).cast("long")))
    before = inc.State(*(t.cache() for t in before))
    moved = inc.difference(before.snapshot, files).cache()
    assert {(r.path, r.status) for r in moved.collect()} == {("a.py", "removed"), ("b.py", "changed"), ("d.py", "changed"), ("f.rs", "added")}
    after = inc.updated(before, files, moved)
    assert {r.path: r.blanks == 77 for r in after.metrics.collect()} == {"b.py": False, "d.py": False, "f.rs": False, "c.js": True, "e.py": True}
    now = inc.snapshot(files)
    assert sorted(map(str, after.snapshot.select(now.columns).collect())) == sorted(map(str, now.collect()))
    whole = inc.analysed(files)
    assert inc.summary(after.totals).collect() == inc.summary(whole.totals).collect() == ru.project_summary(whole.metrics).collect()
    assert inc.difference(after.snapshot, files).count() == 0


def test_rules_are_rows_and_a_table_function(spark, files_of):
    built_in = [r for r in R.SECURITY_RULES if isinstance(r.literal, str)]
    table = rt.table_of(spark, built_in)
    again = rt.rules_of(table)
    assert [(r.rule_id, r.pattern, r.ignore_case) for r in again] == sorted((r.rule_id, r.pattern, r.ignore_case) for r in built_in)
    typed = with_language(files_of({"a.py": "eval(x)\npickle.loads(y)\nmagic(1) MAGIC(2)", "b.js": "magic(3)"}))
    texts = fm.with_text(typed)
    extra = spark.createDataFrame([("house_1", None, "python", None, r"magic\(\d\)", None, "low", None, None, True)], rt.SCHEMA)
    rt.register(spark, "house_rules", rt.rules_of(table.unionByName(extra)))
    found = {(r.path, r.rule_id, r.n) for r in rt.hits(texts, "house_rules", "path").collect()}
    counted = texts.select("path", F.inline(fd.rule_counts("text", "family", again))).collect()
    assert found == {(r.path, r.rule_id, r.n) for r in counted} | {("a.py", "house_1", 2)}
    plan = rt.hits(texts, "house_rules", "path")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("python", "") and "Join" not in plan
    for bad in (("x", None, "python", None, "(", None), ("x", None, None, None, "a", None), (None, None, "js", None, "a", None)):
        with pytest.raises(ValueError):
            rt.rules_of(spark.createDataFrame([(*bad, None, None, None, None)], rt.SCHEMA))
    with pytest.raises(ValueError):
        rt.rules_of(extra.unionByName(extra))
    with pytest.raises(ValueError):
        rt.register(spark, "no name", again)


def test_file_sets_merge(spark):
    rng = random.Random(4)
    files = spark.createDataFrame([(f"p{k % 3}", f"f{k}") for k in range(400)], "project string, path string")
    numbers = fs.file_numbers(files).withColumn("file_no", F.col("file_no") * 500).cache()  # many buckets
    rows = [(f"p{k % 3}", f"f{k}", rng.choice("abc"), rng.randrange(3)) for k in (rng.randrange(400) for _ in range(1500))]
    hits = spark.createDataFrame(rows, "project string, path string, kind string, day int")
    days = [fs.sets_of(hits.where(F.col("day") == d), numbers, "project", "kind") for d in range(3)]
    every = fs.merged(days[0].unionByName(days[1]).unionByName(days[2]), "kind")
    assert {r.kind: r.n_files for r in fs.sizes(every, "kind").collect()} == {x: len({r[1] for r in rows if r[2] == x}) for x in "abc"}
    whole = fs.sets_of(hits, numbers, "project", "kind")
    got = {(r.project, r.kind): r.n_files for r in fs.sizes(whole, "project", "kind").collect()}
    assert got == {(p, x): len({r[1] for r in rows if (r[0], r[2]) == (p, x)}) for p in ("p0", "p1", "p2") for x in "abc"}
