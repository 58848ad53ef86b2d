"""Licence scans: sentences are mapped to identifiers of known licence sentences, whose sequence is matched by rules.

Everything is a column expression. A text without any marker, whatever stands between a marker's words, is not cut into
sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers in normalised text; every sentence below holds one.
MARKERS = (
    "licen", "copyright", "spdx", "permission", "redistribut", "warrant", "public domain", "liab", "cc by", "cc0", "endorse",
    "creative commons", "clause",
)

# Licence sentences as they read in lower case, every run of other characters than a-z and 0-9 one space.
# One sentence may have several identifiers. Pairs are words of which the second stands somewhere behind the first.
SENTENCES = (
    ("spdx-mit", r"\bspdx license identifier mit\b"),
    ("spdx-apache-2", r"\bspdx license identifier apache 2 0\b"),
    ("spdx-bsd-3", r"\bspdx license identifier bsd 3 clause\b"),
    ("spdx-bsd-2", r"\bspdx license identifier bsd 2 clause\b"),
    ("spdx-gpl-3", r"\bspdx license identifier gpl 3 0\b"),
    ("spdx-gpl-2", r"\bspdx license identifier gpl 2 0\b"),
    ("spdx-lgpl-3", r"\bspdx license identifier lgpl 3 0\b"),
    ("spdx-agpl-3", r"\bspdx license identifier agpl 3 0\b"),
    ("spdx-mpl-2", r"\bspdx license identifier mpl 2 0\b"),
    ("spdx-isc", r"\bspdx license identifier isc\b"),
    ("mit-name", r"\bmit license\b"),
    ("mit-grant", r"\bpermission is hereby granted free of charge to any person obtaining a copy of this software\b"),
    ("mit-notice", r"\bthe above copyright notice and this permission notice shall be included in all copies\b"),
    ("mit-warranty", r"\bthe software is provided as is without warranty of any kind\b"),
    ("mit-liability", r"\bin no event shall the authors or copyright holders be liable for any claim\b"),
    ("isc-grant", r"\bpermission to use copy modify and or distribute this software for any purpose\b"),
    ("isc-warranty", r"\bthe software is provided as is and the author disclaims all warranties\b"),
    ("bsd-grant", r"\bredistribution and use in source and binary forms with or without modification are permitted\b"),
    ("bsd-source", r"\bredistributions of source code must retain the above copyright notice\b"),
    ("bsd-binary", r"\bredistributions in binary form must reproduce the above copyright notice\b"),
    ("bsd-endorse", r"\bmay be used to endorse or promote products derived from this software\b"),
    ("bsd-warranty", r"\bthis software is provided by the copyright holders? and contributors as is\b"),
    ("bsd-3-name", r"\bbsd 3 clause\b|\b3 clause bsd\b"),
    ("bsd-2-name", r"\bbsd 2 clause\b|\b2 clause bsd\b"),
    ("apache-2-name", r"\bapache license version 2( 0)?\b|\bapache license 2 0\b|\bapache 2 0 license\b"),
    ("apache-2-terms", r"\byou may not use this file except in compliance with the license\b"),
    ("apache-2-copy", r"\byou may obtain a copy of the license at\b"),
    ("apache-2-warranty", r"\bsoftware distributed under the license is distributed on an as is basis\b"),
    ("agpl-3-name", r"\bgnu affero general public license( as published by the free software foundation either)? v(ersion )?3\b"),
    ("lgpl-3-name", r"\bgnu lesser general public license( as published by the free software foundation either)? v(ersion )?3\b"),
    ("lgpl-2-name", r"\bgnu lesser general public license( as published by the free software foundation either)? v(ersion )?2\b"),
    ("gpl-3-name", r"\bgnu general public license( as published by the free software foundation either)? v(ersion )?3\b"),
    ("gpl-2-name", r"\bgnu general public license( as published by the free software foundation either)? v(ersion )?2\b"),
    ("gpl-later", (("any later version", "license"), ("license", "any later version"))),
    ("mpl-2-name", r"\bmozilla public license v(ersion )?2 0\b"),
    ("epl-2-name", r"\beclipse public license v(ersion )?2 0\b"),
    ("cc-by-nc-sa", r"\bcc by nc sa 4 0\b|\bcreative commons attribution noncommercial sharealike 4 0\b"),
    ("cc-by-nc-nd", r"\bcc by nc nd 4 0\b|\bcreative commons attribution noncommercial noderivatives 4 0\b"),
    ("cc-by-nc", r"\bcc by nc 4 0\b|\bcreative commons attribution noncommercial 4 0\b"),
    ("cc-by-sa", r"\bcc by sa 4 0\b|\bcreative commons attribution sharealike 4 0\b"),
    ("cc-by", r"\bcc by 4 0\b|\bcreative commons attribution 4 0\b"),
    ("cc0-name", r"\bcc0 1 0\b"),
    ("unlicense-release", r"\bthis is free and unencumbered software released into the public domain\b"),
    ("all-rights", (("copyright", "all rights reserved"),)),
)

# Licences in the order in which they are looked for, as patterns over the sequence of identifiers, each
# in angle brackets. What a rule has matched is not there for the next one.
RULES = (
    ("BSD-3-Clause", r"<bsd-grant>(?:<bsd-source>)?(?:<bsd-binary>)?<bsd-endorse>(?:<bsd-warranty>)?|<(?:spdx-bsd-3|bsd-3-name)>"),
    ("BSD-2-Clause", r"<bsd-grant>(?:<bsd-source>)?(?:<bsd-binary>)?(?:<bsd-warranty>)?|<(?:spdx-bsd-2|bsd-2-name)>"),
    ("MIT", r"(?:<mit-name>)?<mit-grant>(?:<mit-notice>)?(?:<mit-warranty>)?(?:<mit-liability>)?|<(?:mit-name|spdx-mit)>"),
    ("ISC", r"<isc-grant>(?:<isc-warranty>)?|<spdx-isc>"),
    ("Apache-2.0", r"<apache-2-name>(?:<apache-2-terms>)?(?:<apache-2-copy>)?(?:<apache-2-warranty>)?|<apache-2-terms><apache-2-copy>|<spdx-apache-2>"),
    ("AGPL-3.0", r"<(?:agpl-3-name|spdx-agpl-3)>(?:<gpl-later>)?"),
    ("LGPL-3.0", r"<(?:lgpl-3-name|spdx-lgpl-3)>(?:<gpl-later>)?"),
    ("LGPL-2.1", r"<lgpl-2-name>(?:<gpl-later>)?"),
    ("GPL-3.0", r"<(?:gpl-3-name|spdx-gpl-3)>(?:<gpl-later>)?"),
    ("GPL-2.0", r"<(?:gpl-2-name|spdx-gpl-2)>(?:<gpl-later>)?"),
    ("MPL-2.0", r"<(?:mpl-2-name|spdx-mpl-2)>"),
    ("EPL-2.0", r"<epl-2-name>"),
    ("CC-BY-NC-SA-4.0", r"<cc-by-nc-sa>"),
    ("CC-BY-NC-ND-4.0", r"<cc-by-nc-nd>"),
    ("CC-BY-NC-4.0", r"<cc-by-nc>"),
    ("CC-BY-SA-4.0", r"<cc-by-sa>"),
    ("CC-BY-4.0", r"<cc-by>"),
    ("CC0-1.0", r"<cc0-name>"),
    ("Unlicense", r"<unlicense-release>"),
    ("Proprietary", r"<all-rights>"),
)

#: A sentence ends at a full stop or mark before white space, or at an empty line; licence notices go on after semicolons.
SENTENCE_END = r"([.!?])[ \t\r\n]+|\r?\n[ \t]*\r?\n"
#: A character that no text holds after normalisation.
CUT = "␞"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found |= F.contains(text, F.lit(word))
    return found


def _marked(text: Column) -> Column:
    """Whether a text, once it is normalised, will hold a marker: a space of the marker stands for any run of other characters."""
    found = _any(text, tuple(m for m in MARKERS if " " not in m))
    return found | F.rlike(text, F.lit("|".join(m.replace(" ", "[^a-z0-9]+") for m in MARKERS if " " in m)))


def sentences(text: Column) -> Column:
    """The sentences of a text, in order, in lower case, with every run of other characters than a-z and 0-9 one space."""
    pieces = F.split(F.regexp_replace(F.lower(text), SENTENCE_END, f"$1{CUT}"), CUT)
    return F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def _follows(sentence: Column, first: str, then: str) -> Column:
    """Whether then stands behind the first place of first, as whole words: two searches, however often they occur."""
    padded = F.concat(F.lit(" "), sentence, F.lit(" "))
    at = F.instr(padded, F.lit(f" {first} "))
    behind = F.substring(padded, at + len(first) + 1, F.length(padded))
    return (at > 0) & F.contains(behind, F.lit(f" {then} "))


def _holds(sentence: Column, form: str | tuple[tuple[str, str], ...]) -> Column:
    if isinstance(form, str):
        return F.rlike(sentence, F.lit(form))
    found = F.lit(False)
    for first, then in form:
        found |= _follows(sentence, first, then)
    return found


def identifiers(sentence: Column) -> Column:
    """The identifiers of one normalised sentence, in the order of SENTENCES."""
    found = F.array(*[F.when(_holds(sentence, form), F.lit(name)) for name, form in SENTENCES])
    return F.when(_any(sentence, MARKERS), F.array_compact(found)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, known (identifiers, joined by a space) and licences (joined by a comma, in the order of RULES).

    A row for every row of docs (doc_id, text). A null or empty text, and one without licence sentences, has n_known 0
    and empty strings. Repeated rows are scanned alike; other columns are left out; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select("doc_id", text.alias("text")).withColumn("marked", _marked(F.lower("text")))
    found = F.when(F.col("marked"), F.flatten(F.transform(sentences(F.col("text")), identifiers)))
    known = marked.select("doc_id", F.coalesce(found, F.array().cast("array<string>")).alias("ids"))
    out = known.select("doc_id", "ids", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("known"))
    out = out.withColumn("left0", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    for k, (_, rule) in enumerate(RULES):
        # each rule once: what it leaves is shorter where it has matched
        out = out.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", rule, ""))
    names = [F.when(F.length(f"left{k + 1}") < F.length(f"left{k}"), F.lit(name)) for k, (name, _) in enumerate(RULES)]
    return out.select("doc_id", "n_known", "known", F.array_join(F.array_compact(F.array(*names)), ",").alias("licences"))


def scan_sql() -> str:
    """The scan as one statement in DuckDB's SQL: every text is cut, and markers are looked for in each sentence."""

    def quote(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def form(value: str | tuple[tuple[str, str], ...]) -> str:
        return value if isinstance(value, str) else "|".join(rf"\b{first}\b.*\b{then}\b" for first, then in value)

    marked = " OR ".join(f"contains(s, {quote(m)})" for m in MARKERS)
    cases = ", ".join(f"CASE WHEN regexp_matches(s, {quote(form(f))}) THEN {quote(n)} END" for n, f in SENTENCES)
    steps = [
        f"cut AS (SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), {quote(SENTENCE_END)}, '\\1{CUT}', 'g'), '{CUT}')"
        " AS parts FROM documents)",
        "plain AS (SELECT doc_id, list_transform(parts, lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS parts FROM cut)",
        f"found AS (SELECT doc_id, coalesce(list_filter(flatten(list_transform(list_filter(parts, lambda s: {marked}),"
        f" lambda s: [{cases}])), lambda i: i IS NOT NULL), []) AS ids FROM plain)",
        "r0 AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') AS left0 FROM found)",
    ]
    names = []
    for k, (name, rule) in enumerate(RULES):
        steps.append(f"r{k + 1} AS (SELECT *, regexp_replace(left{k}, {quote(rule)}, '', 'g') AS left{k + 1} FROM r{k})")
        names.append(f"CASE WHEN length(left{k + 1}) < length(left{k}) THEN {quote(name)} END")
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ' '), '') AS known,"
        f" concat_ws(',', {', '.join(names)}) AS licences FROM r{len(RULES)}"
    )
