"""The byte network's forward pass and the decision list's verdicts in plain loops, and the pipeline on odd tables."""

import os
import random
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from codeloom.llm import byte_cnn as cnn  # noqa: E402
from codeloom.llm import decision_list as dl  # noqa: E402


def _chunk_value(model, chunk):
    """The largest value of each unit over the windows of one chunk of bytes."""
    padded = np.frombuffer(chunk.ljust(cnn.CHUNK, b"\0"), np.uint8)[None, :]
    again = cnn.repeats(padded)[0]
    groups = []
    for g in range(cnn.GROUPS):
        places = range(4 * g, 4 * g + 4)
        groups.append(np.concatenate([np.concatenate([model["E"][padded[0, k]], again[k]]) for k in places]).astype(float))
    best = np.full(cnn.HIDDEN, -1.0)
    for w in range(cnn.WINDOWS):
        total, n = np.zeros(cnn.FILTERS), 0
        for g in range(w * cnn.POOL, (w + 1) * cnn.POOL):
            if 4 * g >= len(chunk):
                break
            x = groups[g] @ model["A"][:, : cnn.FILTERS] + model["a"]
            if g + 1 < cnn.GROUPS:
                x = x + groups[g + 1] @ model["A"][:, cnn.FILTERS :]
            total, n = total + np.maximum(x, 0), n + 1
        if n:
            best = np.maximum(best, np.maximum(total / n @ model["B"] + model["b"], 0))
    return best


def _score(model, text):
    step, chunks, at = cnn.CHUNK - cnn.OVERLAP, [], 0
    while text and (not chunks or at + cnn.OVERLAP < len(text)):
        chunks.append(text[at : at + cnn.CHUNK])
        at += step
    values = [_chunk_value(model, c) for c in chunks]
    pooled = np.concatenate([np.max(values, axis=0), np.mean(values, axis=0)]) if values else np.zeros(2 * cnn.HIDDEN)
    return 1 / (1 + np.exp(-(pooled @ model["c"] + model["d"][0])))


def test_scores_equal_plain_loops():
    rng = random.Random(2)
    model = cnn.initial()
    model["c"] *= 20
    words = [rng.choice(["the ", "of ", "Zq9", "lorem ", "\n", "é", "a"]) for _ in range(4000)]
    texts = ["", "a", "".join(words[:300]), "same line\n" * 200, "x" * cnn.CHUNK, "y" * (cnn.CHUNK + 1), "".join(words)]
    texts += ["z" * (cnn.CHUNK + k * (cnn.CHUNK - cnn.OVERLAP) + d) for k in (0, 1) for d in (-1, 0, 1)]
    held = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(held), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in held])])
    got = cnn.scores(model, data, offsets)
    assert np.allclose(got, [_score(model, t) for t in held], atol=1e-4)


def test_verdicts_equal_the_list(spark):
    rng = random.Random(3)
    names = list(dl.FEATURES)
    columns = [c.split()[0] for c in dl.STATISTICS.split(", ")]
    rows = [(k, *[rng.choice([0, 1, 2, 5, 50, 400]) for _ in columns[1:]]) for k in range(400)]
    table = spark.createDataFrame(rows, dl.STATISTICS)
    x = []
    for row in rows:
        held = dict(zip(columns, row, strict=True))
        parts = [dl.FEATURES[n].split(" / ") for n in names]
        x.append([held[a] / held[b] if held[b] else 0.0 for a, b in parts])
    x = np.array(x)
    for _ in range(6):
        rules = [
            [dl.Condition(n, rng.random() < 0.5, float(rng.choice(list(x[:, names.index(n)])))) for n in rng.sample(names, rng.randint(1, 4))]
            for _ in range(rng.randint(0, 6))
        ]
        got = {r.doc_id: r.rule for r in table.select("doc_id", dl.expression(rules).alias("rule")).collect()}
        for k in range(len(rows)):
            first = 0
            for number, rule in enumerate(rules, 1):
                if all(x[k, names.index(c.feature)] > c.threshold if c.above else x[k, names.index(c.feature)] <= c.threshold for c in rule):
                    first = number
                    break
            assert got[k] == first


def test_pipeline_on_odd_tables(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(n))
    kind = "doc_id long, text string, lang string, source string, n_chars long, size int, spans string"
    texts = [None, "", " \n", "word", prose(30000), *[prose(120) for _ in range(6)], 'password = "Tr0ub4dor&3xKq!zP9#mW"' + prose(60)]
    rows = [(k, t, None if k % 3 else "en", None if k % 4 else "a", None, 1, "x") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], None, None, None, None, None)]
    for name, some in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(k, k % 2, 0) for k in range(len(some))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "lang", "source", "ids", "n_tokens", "round_trip"} <= set(out.columns)
        found = out.collect()
        assert all(r.round_trip for r in found) and {r.doc_id for r in found} <= {r[0] for r in some}
        if not some:
            assert found == []
