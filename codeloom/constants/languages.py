"""Supported languages, their extensions, comment patterns and excluded file globs."""

from __future__ import annotations

from dataclasses import dataclass

PYTHON = "python"
JS = "js"
RUST = "rust"
OTHER = "other"


@dataclass(frozen=True)
class Language:
    """One catalogue language, as listed to the user."""

    name: str
    extensions: tuple[str, ...]
    comment_patterns: tuple[str, ...]
    exclude_globs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Extension:
    """One row of the extension dimension: how a file suffix is analysed."""

    extension: str
    language: str
    family: str
    comment_marker: str = "#"


C_COMMENTS = (r"//.*$", r"/\*[\s\S]*?\*/")
PY_COMMENTS = (r"#.*$", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''")

# Fixed values, in catalogue order.
LANGUAGES = (
    Language("python", (".py",), PY_COMMENTS, ("__init__.py", "__main__.py")),
    Language("javascript", (".js", ".jsx", ".ts", ".tsx"), C_COMMENTS, ("*.min.js", "*.bundle.js")),
    Language("java", (".java",), C_COMMENTS, ("package-info.java", "module-info.java")),
    Language(
        "cpp",
        (".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx", ".hh"),
        C_COMMENTS,
        ("*.generated.h", "*.generated.cpp"),
    ),
    Language("go", (".go",), C_COMMENTS, ("*_test.go", "*_mock.go")),
    Language("rust", (".rs",), C_COMMENTS, ("*_test.rs", "*_mock.rs")),
    Language("csharp", (".cs",), C_COMMENTS, ("*.Designer.cs", "*.generated.cs")),
    Language("ruby", (".rb", ".rake"), (r"#.*$", r"=begin[\s\S]*?=end"), ("Gemfile", "Rakefile")),
    Language("php", (".php", ".phtml", ".php5", ".php7"), C_COMMENTS + (r"#.*$",)),
    Language("swift", (".swift",), C_COMMENTS),
    Language("kotlin", (".kt", ".kts"), C_COMMENTS),
)

# Suffixes with their own analysis; they win over the catalogue above.
ANALYZED_EXTENSIONS = (
    Extension(".py", "python", PYTHON, "#"),
    Extension(".js", "javascript", JS, "//"),
    Extension(".jsx", "jsx", JS, "//"),
    Extension(".ts", "typescript", JS, "//"),
    Extension(".tsx", "tsx", JS, "//"),
    Extension(".rs", "rust", RUST, "#"),
)


def extension_rows(extra: tuple[Extension, ...] = (), strict_tsx: bool = False) -> list[Extension]:
    """The extension dimension with precedence resolved: ``extra``, then analysed, then catalogue."""
    chosen: dict[str, Extension] = {}
    for row in extra + ANALYZED_EXTENSIONS:
        if strict_tsx and row.language == "tsx":
            row = Extension(row.extension, row.language, OTHER, "#")
        chosen.setdefault(row.extension, row)
    for language in LANGUAGES:
        for extension in language.extensions:
            chosen.setdefault(extension, Extension(extension, language.name, OTHER, "#"))
    return list(chosen.values())
