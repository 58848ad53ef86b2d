"""Per-file measures on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from codeloom.constants import rules as R
from codeloom.constants.languages import Extension
from codeloom.operators import complexity as cx
from codeloom.operators import discovery as ds
from codeloom.plans import file_metrics as fm

PYTHON = '''"""Docs
more # docs
"""
import os
from a.b import (
    c,
)

class A:
    def m(self):
        def inner(): pass
        return "not # a comment"  # a comment

def free(x=[]):
    if x and not x:
        return 1
'''


def measured(typed_of, contents):
    return {r.path: r for r in fm.file_metrics(typed_of(contents)).collect()}


def test_python_file(typed_of):
    row = measured(typed_of, {"a.py": PYTHON})["a.py"]
    assert (row.loc, row.blanks, row.comments, row.sloc) == (17, 3, 4, 10)
    assert row.comment_or_string_lines == 4
    assert (row.classes, row.functions, row.methods) == (1, 1, 2)
    assert row.imports == ["import os", "from a.b import ("]
    assert row.cyclomatic == 2 and row.n_smells == 1 and row.smell_severity == "major"
    assert row.technical_debt_ratio == 5 / 10 * 0.02
    score = row.cyclomatic * 10 + row.cognitive * 15 + (100 - row.maintainability_index) * 5
    assert math.isclose(row.complexity_score, score + row.halstead / 100 + row.sloc / 10)


def test_special_files(typed_of, spark):
    rows = measured(typed_of, {
        "empty.py": "", "empty.js": "", "empty.rs": "", "empty.d.ts": "", "none.py": None, "view.tsx": "eval(x)\n",
        "UP.PY": "eval(x)", "d.d.ts": "interface A {\n type B = 1;\n/* x\n*/\nfunction f(): void\n", "a.java": "class A { if (x) {} }",
    })
    assert [rows[p].cyclomatic for p in ("empty.py", "empty.js", "empty.rs", "empty.d.ts", "none.py")] == [1, 1, 0, 0, 0]
    assert rows["empty.py"].complexity_score == 1.0 and rows["empty.py"].loc == 0
    assert rows["none.py"].status == "unreadable" and rows["empty.py"].status == "empty"
    assert rows["view.tsx"].n_security == 1 and rows["UP.PY"].n_security == 1
    d = rows["d.d.ts"]
    assert (d.loc, d.blanks, d.comments, d.functions, d.cyclomatic, d.complexity_score) == (5, 0, 2, 1, 3, 4.0)
    assert d.custom["typescript.interfaces"] == 1 and d.language == "typescript" and d.n_security == 0
    assert rows["a.java"].cyclomatic == 1 and rows["a.java"].cognitive == 0 and rows["a.java"].halstead > 0


def test_files_of_any_size_are_analysed(typed_of):
    files = typed_of({"big.py": "eval(x)\n# c\n", "lost.py": None}).withColumn("size_bytes", F.lit(21 * 1024 * 1024))
    rows = {r.path: r for r in fm.file_metrics(files).collect()}
    big = rows["big.py"]
    assert (big.status, big.loc, big.sloc, big.comments, big.n_security, big.cyclomatic) == ("ok", 3, 1, 1, 1, 1)
    lost = rows["lost.py"]
    assert (lost.status, lost.n_security, lost.complexity_score) == ("unreadable", 0, 0.0) and lost.loc <= 1


@pytest.mark.parametrize("n,expected", [(5000, (5000, 0, 0, 5000)), (5001, (5001, 0, 0, 5001)), (20001, (20001, 0, 0, 20001))])
def test_large_definition_files(typed_of, n, expected):
    row = measured(typed_of, {"x.d.ts": "interface A\n" * n})["x.d.ts"]
    assert (row.loc, row.blanks, row.comments, int(row.custom["typescript.interfaces"])) == expected


def test_file_and_function_length_edges(typed_of):
    body = lambda n: "def f():\n" + "    x\n\n" * n + "y\n"
    contents = {f"f{n}.py": body(n) for n in (30, 31, 50, 51)}
    contents |= {f"l{n}.go": "\n" * (n - 1) for n in (500, 501, 1000, 1001)}
    found = {(r.path, r.type) for r in fm.code_smells(typed_of(contents)).collect()}
    assert found == {
        ("f31.py", "function_long"), ("f50.py", "function_long"), ("f51.py", "function_too_long"),
        ("l501.go", "file_long"), ("l1000.go", "file_long"), ("l1001.go", "file_too_long"),
    }


def test_security_findings_and_score(typed_of):
    text = "x\n cursor.execute('a' + b)\nos.system('ls')\nos.system(cmd)\npassword = 'os.environ'\ntoken = \"t\"\n"
    files = typed_of({"a.py": text, "b.py": "cursor.execute(a + b),\n" * 5})
    rows = [r for r in fm.security_issues(files).collect() if r.path == "a.py"]
    assert sorted((r.type, r.line, r.col) for r in rows) == [
        ("hardcoded_secret", 6, 1), ("os_command_injection", 4, 1), ("sql_injection", 2, 2), ("sql_injection", 2, 9),
    ]
    assert {r.message for r in rows} >= {"Possible SQL injection at line 2", "Possible hardcoded secret at line 6"}
    metrics = {r.path: r for r in fm.file_metrics(files).collect()}
    assert metrics["a.py"].security_score == 20 and metrics["b.py"].security_score == 0
    assert metrics["a.py"].security_level == "critical"


def test_strict_equality_is_an_extra_rule(typed_of):
    files = typed_of({"a.js": "a == b; c === d; e != f; g = h; i <= j; k !== l"})
    found = [r.type for r in fm.code_smells(files, R.STRICT_RULES).collect()]
    assert found.count("loose_equality_strict") == 2
    assert "loose_equality_strict" not in [r.type for r in fm.code_smells(files).collect()]


def test_alert_message_names_the_call(typed_of):
    messages = [r.message for r in fm.code_smells(typed_of({"a.js": "alert(1)\nxalert(2) prompt(3)"})).collect()]
    assert messages == [f"Usage of {n} should be avoided in modern web applications" for n in ("alert", "prompt")]


def test_comment_marks_inside_strings_do_not_count(typed_of):
    rows = measured(typed_of, {
        "a.js": "const u = 'http://x';\nlet t = `// ${a}\n// b`;\nx /* a */ + /* b\n*/ y // z\n",
        "b.rb": "# one\n=begin\ntwo\n=end\nx = '# no'\n", "c.php": "# one\n// two\n$x = 1;", "d.rs": "// a\nx /* b\n*/\ny // c",
    })
    assert {p: r.comments for p, r in rows.items()} == {"a.js": 2, "b.rb": 4, "c.php": 2, "d.rs": 2}


def test_js_and_ts_structure(typed_of):
    text = (
        "import a from 'a'; // x\n/* import b */\nimport('c');\nexport class A extends B {\n  constructor(x) {\n  }\n  async go(y) {\n    if (y) {\n"
        "    }\n  }\n}\nfunction f() {}\nfunction* g() {}\nconst h = () => 1;\nconst s = 'class Z {';\ninterface I {}\ntype T = string;\n"
    )
    rows = measured(typed_of, {"a.js": text, "a.ts": text})
    assert (rows["a.js"].classes, rows["a.js"].functions, rows["a.js"].methods) == (1, 5, 0)
    assert rows["a.js"].imports == ["import a from 'a';"]
    assert rows["a.ts"].custom == {"typescript.interfaces": 1.0, "typescript.types": 1.0} and rows["a.js"].custom == {}


def test_long_string_literals_do_not_overflow(typed_of):
    escapes = "x = '" + "\\'" * 200_000 + "'\n" + 'y = "' + "a\\n" * 200_000 + '"\n# c\n'
    row = measured(typed_of, {"a.py": escapes, "a.js": escapes.replace("#", "//")})
    assert row["a.py"].comments == 1 and row["a.js"].comments == 1 and row["a.py"].loc == 4


def test_language_detection_and_filters(files_of):
    paths = [
        "a.py", "src/_x.py", "src/__init__.py", ".py", "x.TSX", "t/a.d.ts", "noext", "tests/a.py", "build/a.py", "cmake-build-x/a.c",
        "a.min.js", "b.pb.go", "README.py", "x.rb", "a.md", "dir.js/file",
    ]
    files = files_of({p: "x" for p in paths})
    found = {r.path: r.language for r in ds.discover(files).collect()}
    assert found == {
        "a.py": "python", "src/_x.py": "python", "src/__init__.py": "python", "x.TSX": "tsx", "t/a.d.ts": "typescript",
        "cmake-build-x/a.c": "cpp", "x.rb": "ruby",
    }
    assert "tests/a.py" in {r.path for r in ds.discover(files, include_tests=True).collect()}
    assert "cmake-build-x/a.c" not in {r.path for r in ds.discover(files, glob_dirs=True).collect()}
    assert "src/__init__.py" not in {r.path for r in ds.discover(files, language_globs=True).collect()}
    assert "t/a.d.ts" not in {r.path for r in ds.discover(files, exclude_dirs=("t",)).collect()}
    strict = {r.path: r.family for r in ds.with_language(files, strict_tsx=True).collect()}
    assert strict["x.TSX"] == "other"
    extra = ds.discover(files_of({"q.zig": "x"}), extra=[Extension(".zig", "zig", "other", "//")])
    assert [r.language for r in extra.collect()] == ["zig"]


def test_level_edges(spark):
    values = [49.9, 50.0, 200.0, 500.0, 1000.0, 2000.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    levels = [r[0] for r in frame.select(cx.complexity_level(F.col("v"))).collect()]
    assert levels == ["trivial", "low", "moderate", "high", "very_high", "extreme"]
    bands = [r[0] for r in frame.select(cx.chart_band(F.col("v") / 5 - 0.01)).collect()]
    assert bands == ["Low", "Low", "Very High", "Very High", "Very High", "Very High"]
    index = spark.createDataFrame([(85.0,), (65.0,), (40.0,), (25.0,), (24.9,)], "v double")
    assert [r[0] for r in index.select(cx.maintainability_level(F.col("v"))).collect()] == [
        "excellent", "good", "moderate", "poor", "unmaintainable",
    ]


def test_many_functions_raise_the_score(typed_of):
    rows = measured(typed_of, {"a.js": "() => 1\n" * 10, "b.js": "() => 1\n" * 11})

    def plain(r):
        return r.cyclomatic * 10 + r.cognitive * 15 + (100 - r.maintainability_index) * 5 + r.halstead / 100 + r.sloc / 10

    assert math.isclose(rows["a.js"].complexity_score, plain(rows["a.js"]))
    assert math.isclose(rows["b.js"].complexity_score, plain(rows["b.js"]) * 1.2)


def test_imports_with_several_statements_on_a_line(typed_of):
    contents = {
        "a.js": "import a from 'a'; import b from 'b';\nlet x = 1; import c from 'c'\n// import d from 'd'\n",
        "a.py": "import os; import sys\nif x: import re\nfrom a import b; from c import (d, e)\n# import no\n",
        "min.js": "import{a}from'a';import*as b from'b';var c=import('d');" + "f();" * 50,
    }
    rows = {r.path: r.imports for r in fm.with_structure(fm.with_lines(fm.with_text(typed_of(contents)))).collect()}
    assert rows["a.js"] == ["import a from 'a';", "import b from 'b';", "import c from 'c'"]
    assert rows["a.py"] == ["import os", "import sys", "import re", "from a import b", "from c import (d, e)"]
    assert rows["min.js"] == ["import{a}from'a';", "import*as b from'b';"]


def test_long_calls_and_decorators_do_not_overflow(typed_of):
    contents = {
        "call.js": "foo(" + "a()," * 20000 + ") {\n}\n",
        "deco.py": "@a" + ".b" * 20000 + "\ndef f(x):\n    pass\n@a" + ".b" * 20000 + "\nclass C(D):\n    pass\n",
    }
    rows = {r.path: r for r in fm.file_metrics(typed_of(contents)).collect()}
    assert rows["call.js"].functions == 1 and rows["deco.py"].classes == 1
    assert {h.pattern for h in fm.pattern_hits(typed_of(contents)).collect()} == {"decorator"}
