"""The regular-expression rule packs.

Patterns are Python-flavoured text (braces escaped); ``functions.regex`` turns them into
Java patterns with the same meaning. ``literal`` is text that every match must contain, so a file
without it needs no scan; of several texts, one.

A pattern that looks far ahead and fails would look again from each of its other starts. Such a rule has
a ``Sieve``: a pattern that finds the same matches in time proportional to the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from codeloom.constants.languages import JS, PYTHON
from codeloom.functions.regex import WORD_BEHIND


@dataclass(frozen=True)
class Sieve:
    """The linear form of a pattern.

    ``pattern`` also eats the stretch in which a start has failed, where every other start would fail for the same
    reason. Its group ``group`` is empty in what was only eaten. With ``ends``, nothing behind the last of these
    characters is looked at (and, for several, of those in front of that): all that is opened before can then be closed,
    so no start runs to the end of the text in vain. ``closing`` is put in place of what was cut off.
    """

    pattern: str
    group: int = 0
    ends: tuple[str, ...] = ()
    closing: str = ""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    family: str
    type: str
    pattern: str
    literal: str | tuple[str, ...] | None = None
    severity: str | None = None
    level: str | None = None
    message: str = ""
    ignore_case: bool = False
    drop_literals: tuple[str, ...] = ()
    name_pattern: str | None = None
    sieve: Sieve | None = None


def _pack(kind, family, type_, rows, **shared):
    return [
        Rule(f"{family}_{type_}_{i}", kind, family, type_, pattern, literal, sieve=SIEVES.get(pattern), **shared)
        for i, (pattern, literal) in enumerate(rows, start=1)
    ]


# Environment lookups that excuse a secret.
ENV_LOOKUPS = ("os.environ", "process.env")

# Security patterns.
COMMAND_INJECTION = (
    (r"os\.system\((?!['\"]\w+['\"])[^\)]*\)", "os.system("),
    (r"subprocess\.call\((?!['\"]\w+['\"])[^\)]*\)", "subprocess.call("),
    (r"subprocess\.Popen\((?!['\"]\w+['\"])[^\)]*\)", "subprocess.Popen("),
    (r"eval\([^\)]*\)", "eval("),
)
SQL_INJECTION = (
    (r"execute\([^,]*\+[^\)]*\)", "execute("),
    (r"execute\([^,]*%[^\)]*\)", "execute("),
    (r"execute\([^,]*f['\"][^'\"]*\{[^}]*\}[^'\"]*['\"]", "execute("),
    (r"cursor\.execute\([^,]*\+[^\)]*\)", "cursor.execute("),
)
DESERIALIZATION = (
    (r"pickle\.loads\(", "pickle.loads("),
    (r"pickle\.load\(", "pickle.load("),
    (r"yaml\.load\([^,)]*\)", "yaml.load("),
    (r"marshal\.loads\(", "marshal.loads("),
)
SECRETS = (
    (r"password\s*=\s*['\"][^'\"]+['\"]", "password"),
    (r"api[_]?key\s*=\s*['\"][^'\"]+['\"]", ("apikey", "api_key")),
    (r"secret\s*=\s*['\"][^'\"]+['\"]", "secret"),
    (r"token\s*=\s*['\"][^'\"]+['\"]", "token"),
)
UNSAFE_EVAL = ((r"eval\([^\)]+\)", "eval("),)
DOCUMENT_WRITE = ((r"document\.write\([^\)]+\)", "document.write("),)
INNER_HTML = ((r"\.innerHTML\s*=\s*[^;]+", ".innerHTML"),)


# Code-smell patterns.
WILDCARD_IMPORT = ((r"from\s+\w+\s+import\s+\*", "import"),)
BROAD_EXCEPT = ((r"except\s*:", "except"),)
MUTABLE_DEFAULT = (
    (r"def\s+\w+\s*\([^)]*=\s*(\[\]|\{\}|\(\)|\{\s*:\s*\}|\[\s*\]|\(\s*\))[^)]*\)", "def"),
)
CONSOLE_STATEMENT = ((r"console\.(log|warn|error|info|debug)\(", "console."),)
ALERT_USAGE = ((r"\b(alert|prompt|confirm)\(", ("alert(", "prompt(", "confirm(")),)
LOOSE_EQUALITY = ((r"[^=!]=(?!=)[^=]", "="),)
# The pattern above fires on single assignments; this one is what its message describes.
LOOSE_EQUALITY_STRICT = ((r"(?<![=!<>])[=!]=(?!=)", "="),)

# JavaScript function declarations measured for length, each with a part that starts
# with a literal and is cheap to look for.
JS_FUNCTIONS = (
    (r"function\s+(\w+)\s*\([^)]*\)\s*\{", r"function\s+\w"),
    (r"(?:const|let|var)\s+(\w+)\s*=\s*function\s*\([^)]*\)\s*\{", r"=\s*function\s*\("),
    (r"(?:const|let|var)\s+(\w+)\s*=\s*\([^)]*\)\s*=>\s*\{", r"=>\s*\{"),
    (r"(\w+)\s*:\s*function\s*\([^)]*\)\s*\{", r":\s*function\s*\("),
)
PYTHON_FUNCTION = r"def\s+(\w+)\s*\("

# Design patterns of Python code.
PY_SINGLETON = (
    (r"_instance\s*=\s*None", "_instance"),
    (r"if\s+cls\._instance\s+is\s+None", "cls._instance"),
    (r"if\s+not\s+hasattr\(cls,\s*['\"]_instance['\"]\)", "hasattr(cls,"),
    (r"@classmethod\s+def\s+instance\(\s*cls\s*\)", "@classmethod"),
    (r"@classmethod\s+def\s+get_instance\(\s*cls\s*\)", "@classmethod"),
    (r"__new__\(\s*cls\s*,", "__new__("),
)
PY_FACTORY_METHOD = (
    (r"def\s+create_\w+\(\s*.*\)\s*:", "create_"),
    (r"@classmethod\s+def\s+create\(", "@classmethod"),
    (r"@classmethod\s+def\s+from_\w+\(", "@classmethod"),
    (r"class\s+\w+Factory\b", "Factory"),
)
PY_OBSERVER = (
    (r"def\s+add_observer\(\s*self\s*,", "add_observer("),
    (r"def\s+remove_observer\(\s*self\s*,", "remove_observer("),
    (r"def\s+notify_observers\(\s*self\s*", "notify_observers("),
    (r"def\s+register\(\s*self\s*,\s*\w+\s*\)", "register("),
    (r"def\s+unregister\(\s*self\s*,\s*\w+\s*\)", "unregister("),
    (r"def\s+notify\(\s*self\s*", "notify("),
    (r"self\._observers\s*=\s*\[\]", "self._observers"),
    (r"for\s+observer\s+in\s+self\._observers", "self._observers"),
    (r"for\s+observer\s+in\s+self\.observers", "self.observers"),
)
PY_DECORATOR = (
    (r"@\w+(?:\.\w++)*+(?:\(.*?\))?\s+def\s+\w+\(", "@"),
    (r"@\w+(?:\.\w++)*+\s+class\s+\w+\(", "@"),
    (r"def\s+\w+\(\s*self\s*,\s*wrapped\s*,", "wrapped"),
    (r"def\s+__init__\(\s*self\s*,\s*decorated\s*", "decorated"),
    (r"def\s+__init__\(\s*self\s*,\s*component\s*", "component"),
)
PY_STRATEGY = (
    (r"class\s+\w+Strategy\b", "Strategy"),
    (r"def\s+set_strategy\(\s*self\s*,\s*\w+\s*\)", "set_strategy("),
    (r"self\._strategy\s*=\s*\w+", "self._strategy"),
    (r"self\.strategy\s*=\s*\w+", "self.strategy"),
    (r"return\s+self\._strategy\.", "self._strategy."),
    (r"return\s+self\.strategy\.", "self.strategy."),
)
# Design patterns of JavaScript and TypeScript code.
JS_MODULE = (
    (r"\(\s*function\s*\(\s*\)\s*\{.*\}\s*\)\(\s*\)", "function"),
    (r"export\s+default\s+\{", "export"),
    (r"module\.exports\s*=", "module.exports"),
    (r"define\s*\(\s*\[", "define"),
    (r"return\s*\{\s*\w+\s*:.*\}", "return"),
)
JS_SINGLETON = (
    (r"var\s+\w+\s*=\s*\(\s*function\s*\(\s*\)\s*\{\s*var\s+instance", "instance"),
    (r"if\s*\(\s*instance\s*\)\s*return\s+instance", "instance"),
    (r"if\s*\(\s*!\s*instance\s*\)", "instance"),
    (r"static\s+getInstance\s*\(\s*\)", "getInstance"),
    (r"getInstance\s*:\s*function\s*\(\s*\)", "getInstance"),
)
JS_FACTORY = (
    (r"function\s+create\w+\s*\(", "create"),
    (r"class\s+\w*Factory\b", "Factory"),
    (r"\w+\.prototype\.create\w+\s*=", ".prototype.create"),
    (r"static\s+create\w+\s*\(", "create"),
    (r"create\s*:\s*function\s*\(", "create"),
)
JS_OBSERVER = (
    (r"addEventListener\s*\(\s*['\"]", "addEventListener"),
    (r"removeEventListener\s*\(\s*['\"]", "removeEventListener"),
    (r"on\s*\(\s*['\"]", "on"),
    (r"emit\s*\(\s*['\"]", "emit"),
    (r"subscribe\s*\(\s*['\"]", "subscribe"),
    (r"publish\s*\(\s*['\"]", "publish"),
    (r"this\.observers\s*=", "this.observers"),
    (r"this\._observers\s*=", "this._observers"),
)
JS_PROTOTYPE = (
    (r"\w+\.prototype\.\w+\s*=", ".prototype."),
    (r"Object\.create\s*\(", "Object.create"),
    (r"clone\s*\(\s*\)", "clone"),
    (r"\.clone\s*=\s*function", ".clone"),
    (r"prototype\s*=\s*Object\.create", "Object.create"),
)

# The linear forms. A failing start eats as far as every other start would fail for the same reason; where a start can
# go on behind a line feed, the eaten stretch ends in front of it.
_UNQUOTED = r"(?!['\"]\w+['\"])"
_LAST_PLUS = r"(?:(?:[^,+]*+(\+))++[^\)]*+\)|[^,]*+)"
_LAST_PERCENT = r"(?:(?:[^,%]*+(%))++[^\)]*+\)|[^,]*+)"
_NO_DEFAULT = r"\[\]|\{\}|\(\)|\{\s*:\s*\}|\[\s*\]|\(\s*\)"
_WORD_START = f"(?<!{WORD_BEHIND})"
_PLAIN_DECORATED = r"\w++(?:\.\w++)*+\s+def\s+\w+\("
SIEVES = {
    COMMAND_INJECTION[0][0]: Sieve(rf"os\.system\({_UNQUOTED}[^\)]*+\)", ends=(")",)),
    COMMAND_INJECTION[1][0]: Sieve(rf"subprocess\.call\({_UNQUOTED}[^\)]*+\)", ends=(")",)),
    COMMAND_INJECTION[2][0]: Sieve(rf"subprocess\.Popen\({_UNQUOTED}[^\)]*+\)", ends=(")",)),
    COMMAND_INJECTION[3][0]: Sieve(r"eval\([^\)]*+\)", ends=(")",)),
    SQL_INJECTION[0][0]: Sieve(rf"execute\({_LAST_PLUS}", 1, (")",)),
    SQL_INJECTION[1][0]: Sieve(rf"execute\({_LAST_PERCENT}", 1, (")",)),
    # behind the last brace in front of the last quote only a quote is left, so that every brace can be closed
    SQL_INJECTION[2][0]: Sieve(
        r"execute\((?:[^,]*(f)['\"][^'\"]*\{[^}]*+\}[^'\"]*+['\"]|[^,]*+)", 1, ("'\"", "}"), "'"
    ),
    SQL_INJECTION[3][0]: Sieve(rf"cursor\.execute\({_LAST_PLUS}", 1, (")",)),
    DESERIALIZATION[2][0]: Sieve(r"yaml\.load\([^,)]*+(\)?+)", 1),
    UNSAFE_EVAL[0][0]: Sieve(r"eval\([^\)]++\)", ends=(")",)),
    DOCUMENT_WRITE[0][0]: Sieve(r"document\.write\([^\)]++\)", ends=(")",)),
    MUTABLE_DEFAULT[0][0]: Sieve(
        rf"def\s+\w+\s*\((?:[^)]*=\s*(?:{_NO_DEFAULT})[^)]*+(\))|[^)]*+)", 1, (")",)
    ),
    PY_FACTORY_METHOD[0][0]: Sieve(
        r"def\s+create_\w+\(\s*+(?:.*\)\s*(:)|(?:(?!def\s+create_\w+\(\s*\n).)*+)", 1
    ),
    PY_DECORATOR[0][0]: Sieve(
        rf"@\w++(?:\.\w++)*+(?:(?:\(.*?\))?\s+def\s+\w+(\()|\([^@\n]*+(?:@(?!{_PLAIN_DECORATED})[^@\n]*+)*+)", 1
    ),
    JS_MODULE[0][0]: Sieve(
        r"\(\s*function\s*\(\s*\)\s*\{(?:.*\}\s*\)(\()\s*\)"
        r"|(?:(?!\(\s*(?:\n|function\s*(?:\n|\(\s*(?:\n|\)\s*\n)))).)*+)", 1
    ),
    JS_MODULE[4][0]: Sieve(
        r"return\s*\{\s*\w+\s*:(?:.*(\})|(?:(?!return\s*(?:\n|\{\s*(?:\n|\w+\s*\n))).)*+)", 1
    ),
    JS_FUNCTIONS[0][0]: Sieve(r"function\s+(\w+)\s*\((?:[^)]*+\)\s*(\{)|[^)]*+)", 2),
    JS_FUNCTIONS[1][0]: Sieve(r"(?:const|let|var)\s+(\w+)\s*=\s*function\s*\((?:[^)]*+\)\s*(\{)|[^)]*+)", 2),
    JS_FUNCTIONS[2][0]: Sieve(r"(?:const|let|var)\s+(\w+)\s*=\s*\((?:[^)]*+\)\s*=>\s*(\{)|[^)]*+)", 2),
    JS_FUNCTIONS[3][0]: Sieve(_WORD_START + r"(\w++)\s*:\s*function\s*\((?:[^)]*+\)\s*(\{)|[^)]*+)", 2),
    JS_FACTORY[2][0]: Sieve(_WORD_START + r"\w++\.prototype\.create\w+\s*="),
    JS_PROTOTYPE[0][0]: Sieve(_WORD_START + r"\w++\.prototype\.\w+\s*="),
}


def _secrets(family):
    return _pack(
        "security", family, "hardcoded_secret", SECRETS,
        severity="high", level="high_risk", message="Possible hardcoded secret at line {line}",
        ignore_case=True, drop_literals=ENV_LOOKUPS,
    )


SECURITY_RULES = (
    _pack("security", PYTHON, "os_command_injection", COMMAND_INJECTION,
          severity="high", level="high_risk", message="Possible command injection at line {line}")
    + _pack("security", PYTHON, "sql_injection", SQL_INJECTION,
            severity="critical", level="critical", message="Possible SQL injection at line {line}")
    + _pack("security", PYTHON, "insecure_deserialization", DESERIALIZATION,
            severity="high", level="high_risk", message="Insecure deserialization at line {line}")
    + _secrets(PYTHON)
    + _pack("security", JS, "unsafe_eval", UNSAFE_EVAL,
            severity="high", level="high_risk", message="Unsafe eval() usage at line {line}")
    + _pack("security", JS, "document_write", DOCUMENT_WRITE,
            severity="medium", level="medium_risk", message="Unsafe document.write() at line {line}")
    + _pack("security", JS, "innerhtml", INNER_HTML,
            severity="medium", level="medium_risk",
            message="Potentially unsafe innerHTML usage at line {line}")
    + _secrets(JS)
)

SMELL_RULES = (
    _pack("smell", PYTHON, "wildcard_import", WILDCARD_IMPORT,
          severity="minor", message="Wildcard import should be avoided")
    + _pack("smell", PYTHON, "broad_except", BROAD_EXCEPT,
            severity="major", message="Broad exception clause should be avoided")
    + _pack("smell", PYTHON, "mutable_default", MUTABLE_DEFAULT,
            severity="major", message="Mutable default argument can cause unexpected behavior")
    + _pack("smell", JS, "console_statement", CONSOLE_STATEMENT,
            severity="minor", message="Console statement should be removed in production code")
    + _pack("smell", JS, "alert_usage", ALERT_USAGE, severity="minor",
            message="Usage of {name} should be avoided in modern web applications",
            name_pattern=r"^(\w+)")
    + _pack("smell", JS, "loose_equality", LOOSE_EQUALITY,
            severity="minor", message="Use === instead of == for equality checks")
)

# Corrected variants, evaluated only when asked for.
STRICT_RULES = _pack("smell", JS, "loose_equality_strict", LOOSE_EQUALITY_STRICT,
                     severity="minor", message="Use === instead of == for equality checks")

PATTERN_RULES = (
    _pack("pattern", PYTHON, "singleton", PY_SINGLETON)
    + _pack("pattern", PYTHON, "factory_method", PY_FACTORY_METHOD)
    + _pack("pattern", PYTHON, "observer", PY_OBSERVER)
    + _pack("pattern", PYTHON, "decorator", PY_DECORATOR)
    + _pack("pattern", PYTHON, "strategy", PY_STRATEGY)
    + _pack("pattern", JS, "module_pattern", JS_MODULE)
    + _pack("pattern", JS, "singleton", JS_SINGLETON)
    + _pack("pattern", JS, "factory", JS_FACTORY)
    + _pack("pattern", JS, "observer", JS_OBSERVER)
    + _pack("pattern", JS, "prototype", JS_PROTOTYPE)
)
