"""Short plain-Python statements of what the operators mean, for comparison on random text."""

import random
import re

ALPHABET = [
    "def f(", "def g (a):", "class C:", "if ", "else if", "elif x:", "for ", "while y:", "return ", "try:", "except:",
    "{", "}", "(", ")", ":", "=", "==", "!=", " ", "  ", "    ", "\t", "\n", "\n", "\n", "\n    ", "# if x", "// let y",
    "#", "//", "/*", "*/", '"', "'", '"""', "`", "\\", "x", "y1", "é", "œuf", "3.14", "42", "a_b", "password = 'p'",
    "\u00a0", "\u2003", "\x1c", "😀", "𝒂", "function q() {", "const z = (a) => {", "k: function () {",
    "same line of text one\n", "same line of text two\n", "eval(x)", "console.log(1)", "import os\n",
]


def random_texts(n, seed, longest=120):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, longest))) for _ in range(n)]


def located(pattern, text, flags=0):
    found = []
    for match in re.finditer(pattern, text, flags):
        before = text[: match.start()]
        found.append(
            (match.start(), before.count("\n") + 1, match.start() - (before.rfind("\n") + 1) + 1, match.group())
        )
    return found


def python_function_lengths(text):
    out = []
    for match in re.finditer(r"def\s+(\w+)\s*\(", text):
        length = 0
        for line in text[match.start():].split("\n")[1:]:
            if not line.strip():
                continue
            if not line[0].isspace():
                break
            length += 1
        out.append((match.group(1), match.start(), length))
    return out


def js_function_lengths(text, patterns):
    out = []
    for pattern in patterns:
        for match in re.finditer(pattern, text):
            first, *rest = text[match.start():].split("\n")
            balance, length = first.count("{"), len(rest)
            for number, line in enumerate(rest, start=1):
                balance += line.count("{") - line.count("}")
                if balance <= 0:
                    length = number
                    break
            out.append((match.group(1), match.start(), length))
    return out


def commented_blocks(text, marker, indicators):
    """(first line, size) of the blocks of at least three code-like comment lines."""
    blocks, size, first = [], 0, 0
    for number, line in enumerate([*text.split("\n"), "end of text"], start=1):
        stripped = line.strip()
        if not stripped.startswith(marker):
            if size >= 3:
                blocks.append((first, size))
            size = 0
        elif any(word in stripped[len(marker):].strip() for word in indicators):
            first = number if size == 0 else first
            size += 1
        elif size <= 1:
            size = 0
    return blocks


def repeated(text):
    """First two places of every six-line chunk that occurs again."""
    lines, places = text.split("\n"), {}
    for start in range(len(lines) - 5):
        chunk = "\n".join(lines[start:start + 6])
        if len(chunk.strip()) >= 30:
            places.setdefault(chunk, []).append(start + 1)
    return sorted((at[0], at[1]) for at in places.values() if len(at) > 1)


def python_cognitive(text, words):
    cost = depth = 0
    for line in text.split("\n"):
        body = line.strip()
        indent = len(line) - len(body)
        if body.endswith(":") and any(word in body for word in words):
            depth += 1
            cost += depth
        elif body and indent < depth * 4:
            depth = indent // 4
    return cost


def js_cognitive(text):
    cost = depth = 0
    for line in text.split("\n"):
        if "{" in line:
            cost += depth + 1
        depth = max(0, depth + line.count("{") - line.count("}")) if "}" in line else depth + line.count("{")
    return cost


def halstead_sets(text, keywords):
    names = re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", text)
    operators = re.findall(r"[+\-*/=<>!&|^~%]+", text) + [w for w in names if w in keywords]
    operands = (
        [w for w in names if w not in keywords]
        + re.findall(r"\b\d+(?:\.\d+)?\b", text)
        + re.findall(r'"[^"\\]*(?:\\.[^"\\]*)*"|' + r"'[^'\\]*(?:\\.[^'\\]*)*'", text)
    )
    return len(operators), len(operands), len(set(operators)), len(set(operands))
