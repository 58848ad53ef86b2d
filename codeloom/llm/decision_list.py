"""Quality rules: a learned decision list over statistics of whole texts, applied as one Spark conditional expression."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as W
from codeloom.llm.arrow import mapped

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SAMPLE_ROWS = 20_000
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9

STATISTICS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_upper long, n_digits long, n_distinct long, n_adjacent long, n_lines long"
)
#: What the list's thresholds are on: shares of a text, so that a rule means the same for texts of any length.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "distinct_share": "n_distinct / n_words",
    "adjacent_share": "n_adjacent / n_words",
    "words_per_line": "n_words / n_lines",
}

_SYMBOL, _UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float


def _duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    found = 0
    for line in lines:
        if line in seen:
            found += bool(line.split())
        else:
            seen.add(line)
    return found


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    doubles = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(doubles):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(doubles, keys), len(doubles) - 1)
    return doubles[at] == keys


def _statistics(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {name: [] for name in STATISTICS.replace(" long", "").replace(" ", "").split(",")[1:]}
    for part in W.slices(batch.column("text")):
        n = part.last - part.first
        words, at = W.word_names(part), part.word_offsets
        owner = W.owners(at)
        raw = part.data[: part.offsets[-1]]
        inside = ~W.SPACE[raw] & ((raw & 0xC0) != 0x80)
        salted = W.mix(owner.astype(np.uint64))  # equal windows of one document only
        covered = np.zeros(len(words) + 2, bool)
        if len(words) > 2:
            whole = owner[:-2] == owner[2:]
            windows = W.pair(W.pair(words[:-2], words[1:-1]), words[2:]) ^ salted[:-2]
            # windows that run into the next document get keys of their own
            windows[~whole] = W.mix(np.flatnonzero(~whole).astype(np.uint64)) | np.uint64(1)
            again = np.flatnonzero(_twice(windows) & whole)
            for k in range(3):
                covered[again + k] = True
        ordered = np.lexsort((words, owner)) if len(words) else np.zeros(0, int)
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[ordered][1:] != words[ordered][:-1]) | (owner[ordered][1:] != owner[ordered][:-1])
        beside = np.zeros(len(words), bool)
        beside[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        texts = [part.text(i) for i in range(n)]
        for name, value in (
            ("n_words", np.diff(at)),
            ("word_chars", W.sums(inside, part.offsets)),
            ("n_symbols", W.sums(_SYMBOL[raw], part.offsets)),
            ("n_dup_lines", [_duplicate_lines(t) for t in texts]),
            ("n_repeat_words", W.sums(covered[: len(words)], at)),
            ("n_upper", W.sums(_UPPER[raw], part.offsets)),
            ("n_digits", W.sums(_DIGIT[raw], part.offsets)),
            ("n_distinct", W.sums(fresh, at)),
            ("n_adjacent", W.sums(beside, at)),
            ("n_lines", [t.count(b"\n") + 1 for t in texts]),
        ):
            out[name].extend(np.asarray(value).tolist())
    return {"doc_id": batch.column("doc_id"), **out}


def statistics(docs: DataFrame) -> DataFrame:
    """Counts over the whole text of every row of docs (doc_id, text); a null text counts as an empty one."""
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _statistics, STATISTICS)


def features() -> dict[str, Column]:
    """Each feature as an expression; 0 where it would divide by 0."""
    return {k: F.coalesce(F.try_divide(*map(F.col, v.split(" / "))), F.lit(0.0)) for k, v in FEATURES.items()}


def base_failed() -> Column:
    too_short = F.col("n_words") < MIN_WORDS
    return too_short | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def _holds(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    keep = np.ones(len(x), bool)
    for c in rule:
        value = x[:, names.index(c.feature)]
        keep &= value > c.threshold if c.above else value <= c.threshold
    return keep


def _best(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition with the largest gain: bad rows kept times the bits that their share rises by."""
    all_bad, best, chosen = bad.sum(), 0.0, None
    start = np.log2(all_bad / len(bad))
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        value, hit = x[order, j], bad[order]
        cuts = np.flatnonzero(value[1:] > value[:-1])  # after row i
        if not len(cuts):
            continue
        low_bad, low_all = np.cumsum(hit)[cuts], cuts + 1
        for above in (False, True):
            p = all_bad - low_bad if above else low_bad
            n = len(bad) - low_all if above else low_all
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - start), 0)
            i = int(np.argmax(gain))
            if gain[i] > best + 1e-9:
                middle = float((value[cuts[i]] + value[cuts[i] + 1]) / 2)
                best, chosen = float(gain[i]), Condition(name, above, middle)
    return best, chosen


def _worth(x: np.ndarray, bad: np.ndarray, names: list[str], rule: list[Condition]) -> float:
    held = _holds(x, names, rule)
    p, n = (held & bad).sum(), (held & ~bad).sum()
    return (p - n) / max(1, p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 1) -> list[list[Condition]]:
    """Ordered rules for rows to reject: sequential covering, two thirds to grow on and a third to prune on.

    A rule grows by the best condition until it covers no good row or MAX_CONDITIONS are reached, loses end conditions
    as long as that does not lower its worth on the pruning rows, and is kept if MIN_PRECISION of the rows that it
    covers are bad. Rows that it covers leave, and the next rule is grown; without bad rows or a good rule the list
    ends. Without rows of both kinds the list is empty.
    """
    rules: list[list[Condition]] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), bool)
    while bad[left].any() and not bad[left].all():
        at = rng.permutation(np.flatnonzero(left))
        cut = max(1, 2 * len(at) // 3)
        grow, prune = at[:cut], at[cut:]
        rule: list[Condition] = []
        rows = grow
        while len(rule) < MAX_CONDITIONS and len(rows) and 0 < bad[rows].sum() < len(rows):
            gain, condition = _best(x[rows], bad[rows], names)
            if condition is None:
                break
            rule.append(condition)
            rows = rows[_holds(x[rows], names, [condition])]
        while len(rule) > 1 and _worth(x[prune], bad[prune], names, rule[:-1]) >= _worth(x[prune], bad[prune], names, rule):
            rule = rule[:-1]
        held = left & _holds(x, names, rule)
        if not rule or bad[held].sum() < MIN_PRECISION * held.sum() or held.sum() < 3:
            break
        rules.append(rule)
        left &= ~held
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """The number (from 1) of the first rule that holds, in order; 0 if none does."""
    columns, out = features(), F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for c in rule:
            test &= columns[c.feature] > F.lit(c.threshold) if c.above else columns[c.feature] <= F.lit(c.threshold)
        out = F.when(test, number).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules learned from labels (doc_id, quality: 1 good, 0 bad) and the statistics of the labelled texts.

    Learning uses the `sample_rows` labelled rows with the smallest hashes, a documented bound on what reaches the
    driver; rows with a null label or id, and labels without a text, take no part.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = statistics(texts.join(F.broadcast(known.select(F.col("doc_id").cast("long").alias("doc_id"))), "doc_id", "left_semi"))
    names = list(FEATURES)
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", *[c.alias(n) for n, c in features().items()], "quality")
    # one row of a doc_id, however often documents or labels repeat it
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*names, "quality")).alias("one")).select("doc_id", "one.*").toPandas()
    rows = rows.sort_values("doc_id")
    return learn(rows[names].to_numpy(float), (rows["quality"] == 0).to_numpy(), names)


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (of the list, 0 for none) and kept, for every row of docs.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike; an empty table gives an
    empty result.
    """
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
