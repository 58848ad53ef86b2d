"""Directories and file globs left out of an analysis."""

# Fixed values.
EXCLUDED_DIRS = (
    ".venv", "venv", "env", "virtualenv", "__pycache__", ".git", "node_modules",
    ".npm", ".yarn", "bower_components", "jspm_packages", ".pnpm-store",
    "build", "dist", ".next", ".nuxt", "target", "bin", "obj", "out",
    "output", "artifacts", ".gradle", ".maven", "cmake-build-*",
    "example", "examples", "template", "templates", "sample", "samples",
    "docs", "documentation", "javadoc", "apidoc", "man", "manual",
    "benchmark", "benchmarks", "coverage", ".coverage", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", ".eslintcache", "jest-cache", ".nyc_output",
    "htmlcov", "test-results", ".tox", ".hypothesis",
    "vendor", "third_party", "external", "deps", "lib", "libs",
    "packages", "ext", "extern", "third-party", "thirdparty",
    ".idea", ".vscode", ".vs", ".eclipse", ".settings", ".project",
    ".classpath", ".metadata", ".fleet", ".sublime-*",
    ".DS_Store", "__MACOSX", "Thumbs.db", "desktop.ini",
    "tmp", "temp", "cache", ".cache", ".tmp",
)

# Added unless tests are asked for.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs")

# Fixed values.
EXCLUDED_FILES = (
    ".DS_Store", "Thumbs.db", "desktop.ini", ".directory",
    "*.pyc", "*.pyo", "*.pyd", ".python-version", ".coverage.*",
    "*.so", "*.dll", "*.dylib", "*.o", "*.obj", "*.exe", "*.lib",
    "*.a", "*.la", "*.lo", "*.class", "*.jar", "*.war", "*.ear",
    "package-lock.json", "yarn.lock", "Cargo.lock", "Gemfile.lock",
    "poetry.lock", "composer.lock", "Pipfile.lock", "pnpm-lock.yaml",
    ".env", ".env.*", "*.config", "*.conf", "*.cfg", "*.ini",
    "*.log", "*.logs", "npm-debug.log*", "yarn-debug.log*",
    "yarn-error.log*", "lerna-debug.log*",
    "*~", "*.bak", "*.swp", "*.swo", "*.tmp", "*.temp",
    "*.orig", "*.rej", "*.old", "*.new",
    "*.min.*", "*.bundle.*", "*.map", "*.generated.*",
    "*.pb.go", "*_pb2.py", "*.g.cs", "*.g.dart",
    "*.md", "*.rst", "*.txt", "LICENSE*", "README*", "CHANGELOG*",
    "CONTRIBUTING*", "AUTHORS*", "NOTICE*", "PATENTS*",
    "*.jpg", "*.jpeg", "*.png", "*.gif", "*.ico", "*.svg",
    "*.pdf", "*.zip", "*.tar", "*.gz", "*.rar", "*.7z",
    "*.db", "*.sqlite", "*.sqlite3", "*.mdb",
)
