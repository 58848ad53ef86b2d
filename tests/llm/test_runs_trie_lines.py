"""Periodic runs, the conversation trie and line dedup against plain Python, with nulls, ties, repeated rows and long texts."""

import hashlib
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from codeloom.llm import line_dedup, periodic_runs, prefix_trie  # noqa: E402
from codeloom.llm import words as W  # noqa: E402

NAMES = "size at x y n block held key key1 text1 text2 position dropped row line starts n_docs turn_no".split()


def runs_of(w, least=24):
    """(start, length, period) of every run: maximal stretches of each lag, without those that a shorter lag covers."""
    found = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 3 * q) and not any(a <= i and i + length <= a + n for a, n, _ in found):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def _periodic(rng, kinds):
    out = []
    for _ in range(rng.randint(0, 5)):
        root = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 20, 33, 40]))]
        times = rng.choice([1, 2, 3, 4, 8, 30])
        out += (root * times)[: rng.randint(1, len(root) * times)]
        out += [rng.randrange(kinds) for _ in range(rng.randint(0, 6))]
    return out


@pytest.mark.parametrize("least", [24, 6, 1, 40])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    total = 0
    for _ in range(40):
        kinds = rng.choice([1, 2, 3, 20, 500])
        docs = [_periodic(rng, kinds) for _ in range(5)]
        flat = W.mix(np.array([x for d in docs for x in d], np.uint64))
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = periodic_runs.found(flat, offsets, least)
        want = [(k, *r) for k, d in enumerate(docs) for r in runs_of(d, least)]
        assert sorted(got) == sorted(want)
        total += len(want)
    assert total > 50


def test_one_word_repeated_and_long_periods_take_little_time():
    for w in ([1] * 300_000, [1, 2] * 150_000, list(range(50_000)) * 4, ([1] * 50 + [2]) * 4_000):
        names = W.mix(np.array(w, np.uint64))
        got = periodic_runs.found(names, np.array([0, len(w)]))
        assert any(n == len(w) for _, _, n, _ in got) and len(got) <= 1 + len(w) // 50


def _report(text):
    w = plain.words(text)
    runs = runs_of(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(x for k, x in enumerate(w) if k not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(w), len(gone), len(runs), *head, digest(listed), digest(left))


def test_run_report(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "b " * 23, "b " * 24, "x " + "a b c\t" * 9 + "y", "é ü " * 40 + "  " * 30]
    texts += [" ".join(map(str, _periodic(rng, 3))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "b " * 40), (3, "b " * 40), (None, "c d " * 20)]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("z").alias(n) for n in NAMES]).repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.report(table).collect()), key=str)
    assert got == sorted(((i, *_report(t)) for i, t in rows), key=str)
    listed = {r.doc_id: r for r in periodic_runs.runs(table).collect() if r.doc_id is not None and r.doc_id > 3}
    assert all([tuple(x) for x in listed[k].runs] == runs_of(plain.words(texts[k])) for k in listed)
    assert periodic_runs.report(table.limit(0)).count() == 0


def test_one_document_in_ten_repeats(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(str(rng.randrange(50)) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in table.select("doc_id", periodic_runs.repeating(F.col("doc_id"), F.col("text")).alias("text")).collect()}
    for k, text in rows:
        h, w = zlib.crc32(str(k).encode()), plain.words(text)
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert plain.words(out[k]) == w


def _signed(name):
    return tuple(int.from_bytes(name[k : k + 8], "big", signed=True) for k in (0, 8))


def trie_of(rows):
    """The nodes of the prefix trie of (conv_id, turn, role, text) rows."""
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            given.setdefault(c, []).append(((turn is not None, turn or 0, _signed(name)), (role, text)))
    given = {c: [x for _, x in sorted(turns)] for c, turns in given.items()}
    built = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = given.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, below, out = {}, {}, []
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        under = children.get(node, [])
        below[node] = (sum(below[x][0] for x in under) or 1, saved + sum(below[x][1] for x in under))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(under), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _conversations(rng, n, longest, texts):
    rows = []
    for c in range(-6, n):
        if rng.random() < 0.85:
            for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 9, longest])):
                rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", None, "a"]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows + [(None, 1, "user", "t"), (n + 5, 0, "a", "x"), (n + 5, 0, "a", "x")]


@pytest.mark.parametrize("bits, longest", [(6, 64), (6, 130), (2, 33), (1, 16), (0, 9)])
def test_trie_equals_plain_python(spark, bits, longest):
    rows = _conversations(random.Random(bits + longest), 30, longest, ["x", "é", None])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.select("*", *[F.lit("z").alias(n) for n in NAMES]).repartition(5)
    got = [tuple(r) for r in prefix_trie.prefix_trie(table, leaf_bits=bits).collect()]
    assert sorted(got, key=str) == sorted(trie_of(rows), key=str)


def test_trie_of_copies_and_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", "same") for c in range(300) for t in range(4)]
    got = [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, kind).repartition(7)).collect()]
    assert sorted(got, key=str) == sorted(trie_of(rows), key=str)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).count() == 0


def test_names_of_prefixes_and_grafted_sums():
    rng = np.random.default_rng(4)
    x, y = (rng.integers(0, 3, (50, 16)).astype(np.uint64) for _ in "xy")
    start = (np.zeros(50, np.uint64), np.zeros(50, np.uint64))
    a, b = prefix_trie.cut(x, y, start)
    seen = {}
    for r in range(50):
        for k in range(16):
            prefix = tuple(zip(x[r, :k].tolist(), y[r, :k].tolist(), strict=True))
            assert seen.setdefault((a[r, k], b[r, k]), prefix) == prefix
    assert len(set(seen.values())) == len(seen)
    assert (prefix_trie.graft(x.astype(np.int64)) == np.cumsum(x[:, ::-1], axis=1)[:, ::-1]).all()


def lines_of(rows, points=1, documents=10):
    """n_lines, n_dropped and the digest of what is left of every (doc_id, text)."""
    trimmed = lambda line: plain.lower(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for own, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(trimmed(line), set()).add(own)
    often = {k for k, ids in held.items() if len(k) >= points and len(ids) >= documents}
    out = []
    for own, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if trimmed(x) not in often]
        out.append((own, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines(spark):
    rng = random.Random(7)
    pool = ["Home", " home\t", "HOME\x0b", "about us", "", " ", "É", "é", "é ", "a" * 3000, " x", "once"] + [f"line {k}" for k in range(60)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(pool * 400)), (None, "home\nx"), (None, "Home\nrare")]
    rows += [(204, "seldom\nhome")] * 12 + [(k, "nine times") for k in range(300, 309)] + [(k, "TEN times ") for k in range(400, 410)]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("z").alias(n) for n in NAMES]).repartition(4)
    for points, documents in ((1, 10), (6, 3), (0, 1)):
        got = [tuple(r) for r in line_dedup.dedup(table, points, documents).collect()]
        assert sorted(got, key=str) == sorted(lines_of(rows, points, documents), key=str)
    cleaned = line_dedup.cleaned(table)
    assert cleaned.columns == table.columns and cleaned.count() == len(rows)
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[200] is None and texts[400] == "" and texts[300] == "nine times" and texts[204] == "seldom"
    assert line_dedup.dedup(table.limit(0)).count() == 0
