"""Thresholds, weights and bands of the scores."""

# Fixed values: (level, upper bound of the complexity score), the last one is open.
COMPLEXITY_LEVELS = (
    ("trivial", 50),
    ("low", 200),
    ("moderate", 500),
    ("high", 1000),
    ("very_high", 2000),
    ("extreme", None),
)
# Bands of the complexity chart and of its badges.
CHART_BANDS = (("Low", 10), ("Medium", 20), ("High", 30), ("Very High", None))
# Fixed values: (level, lower bound of the maintainability index).
MAINTAINABILITY_LEVELS = (
    ("excellent", 85),
    ("good", 65),
    ("moderate", 40),
    ("poor", 25),
    ("unmaintainable", None),
)
# Fixed values: [low, high) in source lines.
SIZE_BANDS = (
    ("< 100 lines", 0, 100),
    ("100-500 lines", 100, 500),
    ("500-1K lines", 500, 1000),
    ("1K-5K lines", 1000, 5000),
    ("> 5K lines", 5000, None),
)
# Security level -> severity, score weight.
SECURITY_LEVELS = {
    "critical": ("critical", 25),
    "high_risk": ("high", 15),
    "medium_risk": ("medium", 5),
    "low_risk": ("low", 1),
}
# Smell severity -> debt weight.
SMELL_WEIGHTS = {"critical": 10, "major": 5, "minor": 1}

# Keywords of the lexical complexity measures.
BRANCH_WORDS = ("if", "for", "while", "case", "catch")
PYTHON_BRANCH_WORDS = ("elif", "except")
PYTHON_NESTING_WORDS = ("if", "for", "while", "elif", "else", "try", "except", "def", "class")
PYTHON_OPERATOR_WORDS = (
    "if", "else", "elif", "for", "while", "in", "not", "is", "and", "or", "return", "import", "from",
)
OTHER_OPERATOR_WORDS = (
    "if", "else", "for", "while", "switch", "case", "return", "typeof", "instanceof", "new", "delete", "void",
)
# Text that marks a comment as commented-out code.
CODE_INDICATORS = (
    "if ", "for ", "while ", "def ", "class ", "function", "return ", "var ", "let ", "const ",
)
