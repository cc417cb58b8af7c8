"""License scans: ordered signature rules behind keyword prefilters, overlaps resolved by containment and priority.

All work is done by built-in functions inside one scan; nothing is shuffled."""

from __future__ import annotations

import json
import string
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.spans import running

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # maximal runs of these on the unfolded text are the words
# The base phrases and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

TAG, STATEMENT, NAME, MENTION = 1, 2, 3, 4  # priorities: smaller wins among equal spans
STRENGTH = {TAG: 1.0, STATEMENT: 0.95, NAME: 0.8, MENTION: 0.5}
LICENSED = "licensed|released|distributed|available|provided|covered|published under the?"


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str  # must occur before the pattern is tried at all
    regex: str    # on words that are each wrapped in single spaces


def pattern(phrase: str) -> str:
    """A phrase of words as a regex over wrapped words; ``a|b`` are alternatives and a final ``?`` makes a word optional."""
    out = []
    for token in phrase.split():
        optional, token = token.endswith("?"), token.rstrip("?")
        out.append(f"(?: (?:{token}) )" + "?" * optional)
    return "".join(out)


# (label, keyword, phrases that name it) of licenses without families. Fixed values.
NAMED = (
    ("mit", "mit", ("mit license|licence", "mit x11 license|licence")),
    ("mit", "expat", ("expat license|licence",)),
    ("apache-1.0", "apache", ("apache software? license|licence version? 1 0",)),
    ("apache-1.1", "apache", ("apache software? license|licence version? 1 1",)),
    ("apache-2", "apache", ("apache software? license|licence version? 2 0?", "apache 2 0? license|licence", "apache license|licence v2 0?")),
    ("bsd-2-clause", "bsd", ("bsd 2 clause license?", "simplified bsd license?", "freebsd license", "two clause bsd license?")),
    ("bsd-3-clause", "bsd", ("bsd 3 clause license?", "new|modified|revised bsd license?", "three clause bsd license?")),
    ("bsd-4-clause", "bsd", ("bsd 4 clause license?", "original bsd license?")),
    ("0bsd", "bsd", ("bsd 0 clause license?", "zero clause bsd license?", "0bsd")),
    ("bsd", "bsd", ("bsd license|licence", "bsd style license|licence")),
    ("isc", "isc", ("isc license|licence",)),
    ("zlib", "zlib", ("zlib license|licence", "zlib libpng license|licence")),
    ("bsl-1.0", "boost", ("boost software license|licence version? 1? 0?",)),
    ("unlicense", "unlicense", ("the unlicense", "unlicense license?")),
    ("wtfpl", "public license", ("do what the fuck you want to public license",)),
    ("artistic-1.0", "artistic", ("artistic license|licence version? 1 0",)),
    ("artistic-2.0", "artistic", ("artistic license|licence version? 2 0",)),
    ("cddl", "cddl", ("cddl version? 1? 0|1?",)),
    ("cddl", "common development", ("common development and distribution license|licence",)),
    ("epl-1.0", "eclipse", ("eclipse public license|licence version? v? 1 0",)),
    ("epl-2.0", "eclipse", ("eclipse public license|licence version? v? 2 0",)),
    ("eupl", "european union", ("european union public license|licence",)),
    ("ms-pl", "microsoft", ("microsoft public license|licence",)),
    ("ms-rl", "microsoft", ("microsoft reciprocal license|licence",)),
    ("ofl-1.1", "open font", ("sil? open font license|licence version? 1? 1?",)),
    ("odbl", "open database", ("open database license|licence",)),
    ("odc-by", "open data commons", ("open data commons attribution license|licence",)),
    ("pddl", "public domain dedication", ("public domain dedication and license|licence",)),
    ("cc0-1.0", "cc0", ("cc0 1? 0? universal?",)),
    ("cc0-1.0", "creative commons", ("creative commons zero v? 1? 0?",)),
    ("psf", "python", ("python software foundation license|licence",)),
    ("psf", "psf", ("psf license|licence",)),
    ("php", "php", ("php license|licence version? 3? 0|01?",)),
    ("postgresql", "postgresql", ("postgresql license|licence",)),
    ("openssl", "openssl", ("openssl license|licence",)),
    ("ruby", "ruby", ("ruby license|licence",)),
    ("vim", "vim", ("vim license|licence",)),
    ("ncsa", "ncsa", ("university of illinois ncsa open source license|licence", "ncsa license|licence")),
    ("cpl-1.0", "common public", ("common public license|licence version? 1? 0?",)),
    ("ipl-1.0", "ibm public", ("ibm public license|licence version? 1? 0?",)),
    ("upl-1.0", "universal permissive", ("universal permissive license|licence",)),
    ("afl", "academic free", ("academic free license|licence",)),
    ("osl", "open software", ("open software license|licence",)),
    ("cecill", "cecill", ("cecill license|licence?",)),
    ("mulan-2.0", "mulan", ("mulan psl v2", "mulan permissive software license|licence")),
    ("openrail", "openrail", ("openrail m? license|licence?",)),
    ("llama", "community license", ("llama 2|3? community license|licence agreement?",)),
    ("public-domain", "public domain", ("in|into the public domain", "dedicated to the public domain", "public domain work|works|software")),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    ("proprietary", "proprietary", ("proprietary and confidential", "confidential and proprietary")),
)
# Sentences of license texts themselves. Fixed values.
STATEMENTS = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "contributors", "neither the name of the? copyright? holder|owner|author|authors nor the names of its contributors"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "implied warranty", "this software is provided as is without any express or implied warranty"),
    ("apache-2", "compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", "it under the terms of the gnu general", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "terms of the gnu lesser", "redistribute it and or modify it under the terms of the gnu lesser|library general public license"),
    ("agpl", "terms of the gnu affero", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
# Identifiers that tags and short notices carry. Fixed values.
IDENTIFIERS = (
    "MIT", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense",
    "WTFPL", "Artistic-2.0", "CDDL-1.0", "CDDL-1.1", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "MS-PL", "OFL-1.1", "ODbL-1.0", "CC0-1.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "PostgreSQL", "Python-2.0", "NCSA", "UPL-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
)


def rules() -> list[Rule]:
    """All signature rules in priority order; the families are written as templates over their versions and variants."""
    out = []
    for identifier in IDENTIFIERS:
        words = identifier.lower().replace("-", " ").replace(".", " ")
        label = {"apache-2.0": "apache-2"}.get(identifier.lower(), identifier.lower())
        out.append(Rule(label, TAG, "spdx", pattern(f"spdx license identifier {words}")))
    for label, keyword, sentence in STATEMENTS:
        out.append(Rule(label, STATEMENT, keyword, pattern(sentence)))
    for label, keyword, phrases in NAMED:
        for phrase in phrases:
            out.append(Rule(label, NAME, keyword, pattern(phrase)))
            if label not in ("public-domain", "proprietary"):
                out.append(Rule(label, STATEMENT, keyword, pattern(f"{LICENSED} {phrase}")))
    for (short, name), version in product((("gpl", "gnu"), ("lgpl", "gnu lesser|library"), ("agpl", "gnu affero")), ("", "1", "2", "2 1", "3")):
        label = f"{short}-{version.replace(' ', '.')}" if version else short
        tail = f"version|v {version} 0?" if version else ""
        for phrase in (f"{name} general public license|licence {tail}", f"gnu? {short} {tail}", f"{name} {short} {tail}"):
            out.append(Rule(label, NAME, "gnu" if phrase.startswith("gnu ") else short, pattern(phrase)))
            out.append(Rule(label, STATEMENT, short if phrase.startswith("gnu?") else "gnu", pattern(f"{LICENSED} {phrase}")))
        if version:
            out.append(Rule(label, NAME, short, pattern(f"{short}v{version} 0? or? later?")))
            out.append(Rule(label + "-or-later", STATEMENT, "gnu",
                            pattern(f"{name} general public license|licence {tail} or at? your? option? any? later version?")))
    terms = {"by": "attribution", "sa": "share|sharealike alike?", "nc": "non|noncommercial commercial?", "nd": "no|noderivatives|noderivs derivatives|derivs?"}
    for parts, version in product(("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("", "1 0", "2 0", "2 5", "3 0", "4 0")):
        label = "cc-" + parts.replace(" ", "-") + ("-" + version.replace(" ", ".") if version else "")
        spelled = " ".join(terms[p] for p in parts.split())
        for keyword, phrase in (("cc", f"cc {parts} {version}"), ("creative commons", f"creative commons {spelled} {version} international|unported|generic?"),
                                ("creative commons", f"creative commons {parts} {version}")):
            out.append(Rule(label, NAME, keyword, pattern(phrase)))
            out.append(Rule(label, STATEMENT, keyword, pattern(f"{LICENSED} {phrase}")))
    for version in ("1 0", "1 1", "2 0"):
        label = "mpl-" + version.replace(" ", ".")
        out.append(Rule(label, NAME, "mozilla", pattern(f"mozilla public license|licence version|v? {version}")))
    for version in ("1 1", "1 2", "1 3"):
        out.append(Rule("gfdl-" + version.replace(" ", "."), NAME, "documentation", pattern(f"gnu free documentation license|licence version|v? {version}")))
    out.append(Rule("unknown-license", MENTION, "licen", pattern(f"{LICENSED} license|licence|terms")))
    out.append(Rule("unknown-license", MENTION, "licen", pattern("license|licence agreement|terms")))
    out.append(Rule("copyright-notice", MENTION, "copyright", pattern("copyright c? (?:19|20)[0-9][0-9]")))
    return sorted(dict.fromkeys(out), key=lambda r: r.priority)


# Words (or parts of words) without which no rule and no base phrase can match; a text without them only has its words counted.
GATE_WORDS = ("licen", "spdx", "copyright", "reserved", "proprietary", "domain", "gpl", "cddl", "bsd", "cc0", "creative", "mulan",
              "openrail", "permission", "redistribut", "unencumbered", "warranty", "compliance", "contributors", "gnu")


def _gate(text: Column) -> Column:
    folded = F.lower(text)
    found = folded.contains("cc") & folded.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by")
    for word in GATE_WORDS:
        found = found | folded.contains(word)
    return found


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == part)
        return test

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _spans(hit: Column) -> Column:
    """(start, end, priority, label) of every match of a rule, from the pieces between its matches."""
    steps = F.transform(hit["found"], lambda f, i: F.length(F.get(hit["between"], i)) + F.length(f))
    return F.transform(running(steps), lambda end, i: F.struct(
        (end - F.length(F.get(hit["found"], i))).alias("start"), end.alias("end"),
        hit["priority"].alias("priority"), hit["label"].alias("label")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: words, places of the base phrases, their labels, all labels and a score.

    Texts that pass the keyword gate are matched against every rule whose own keyword they contain. A detection inside
    an earlier-starting or longer one is dropped, of equal spans the smaller priority stays; base labels always stay.
    The score is the strength of the best detection kept (0 without any). Null texts count as empty. Repeated
    rows are scanned each, a null id is passed on, an empty table gives an empty result, other columns are not read."""
    listed = json.dumps([r._asdict() for r in (signatures or rules())])
    table = F.from_json(F.lit(listed), "array<struct<label:string,priority:int,keyword:string,regex:string>>")  # folded to a literal
    text = F.coalesce(F.col(text_col), F.lit(""))
    strings = F.expr("cast(array() as array<string>)")
    df = docs.select(F.col(id_col), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_raw"), _gate(text).alias("_gate"))
    df = df.withColumn("_words", F.when(F.col("_gate"), F.split(F.translate(
        F.array_join("_raw", " "), string.ascii_uppercase, string.ascii_lowercase), " ")))
    df = df.select(id_col, F.size("_raw").cast("long").alias("n_words"), "_words",
                   *[F.coalesce(_places(F.col("_words"), p), F.expr("cast(array() as array<int>)")).alias(f"_at{i}") for i, (p, _) in enumerate(BASE_PHRASES)],
                   F.array_join("_words", " ").alias("_plain"), F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" ")).alias("_wrapped"))
    df = df.withColumn("_hits", F.transform(
        F.filter(table, lambda r: F.col("_plain").contains(r["keyword"])),
        lambda r: F.struct(r["label"].alias("label"), r["priority"].alias("priority"),
                           F.regexp_extract_all(F.col("_wrapped"), r["regex"], F.lit(0)).alias("found"),
                           F.split(F.col("_wrapped"), r["regex"], -1).alias("between"))))
    order = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["priority"].alias("priority"), s["label"].alias("label"))
    df = df.withColumn("_spans", F.array_sort(F.transform(F.flatten(F.transform(
        F.filter("_hits", lambda h: F.size(h["found"]) > 0), _spans)), order)))
    df = df.withColumn("_kept", F.aggregate(
        F.coalesce("_spans", F.expr("cast(array() as array<struct<start:int,end:int,priority:int,label:string>>)")),
        F.struct(F.lit(-1).alias("reach"), strings.alias("labels"), F.lit(0).alias("n"), F.lit(99).alias("best")),
        lambda acc, s: F.when(-s["end"] <= acc["reach"], acc).otherwise(F.struct(
            (-s["end"]).alias("reach"), F.array_union(acc["labels"], F.array(s["label"])).alias("labels"),
            (acc["n"] + 1).alias("n"), F.least(acc["best"], s["priority"]).alias("best")))))
    base = F.array_compact(F.array(*[F.when(F.size(f"_at{i}") > 0, label) for i, (_, label) in enumerate(BASE_PHRASES)]))
    places = F.concat(*[f"_at{i}" for i in range(len(BASE_PHRASES))])
    strength = F.coalesce(*[F.when(F.col("_kept.best") == p, F.lit(s)) for p, s in STRENGTH.items()], F.lit(0.0))
    return df.select(
        id_col, "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("_kept.labels"))), ",").alias("labels"),
        F.when(F.size(places) > 0, F.greatest(strength, F.lit(STRENGTH[NAME]))).otherwise(strength).alias("score"),
        F.col("_kept.n").alias("n_detections"))


def _oracle_sql() -> str:
    """The same result from rows: words, places of the base phrases, and the spans of every rule."""
    listed = ",\n  ".join("({}, {}, '{}', {}, '{}', '{}')".format(i, r.priority, r.label, STRENGTH[r.priority], r.keyword, r.regex)
                          for i, r in enumerate(rules()))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM near WHERE "
        + " AND ".join(f"x{k} = '{word}'" for k, word in enumerate(phrase.split())) for phrase, label in BASE_PHRASES)
    ahead = ", ".join(f"lead(x, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS x{k}" for k in range(1, 5))
    return f"""
WITH rule(id, priority, label, strength, keyword, regex) AS (VALUES
  {listed}),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
near AS (SELECT doc_id, i, x AS x0, {ahead} FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM doc)),
base AS ({phrases}),
tried AS (SELECT doc_id, id, priority, label, regex, ' ' || array_to_string(w, '  ') || ' ' AS t FROM doc JOIN rule ON contains(array_to_string(w, ' '), keyword)),
hit AS (SELECT *, regexp_extract_all(t, regex) AS found, string_split_regex(t, regex) AS apart FROM tried),
part AS (SELECT doc_id, id, priority, label, unnest(found) AS f, unnest(apart[:len(found)]) AS b, generate_subscripts(found, 1) AS i FROM hit WHERE len(found) > 0),
span AS (SELECT doc_id, priority, label, len(f) AS n, sum(len(b) + len(f)) OVER (PARTITION BY doc_id, id ORDER BY i) AS stop FROM part),
seen AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY stop - n, stop DESC, priority, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span),
kept AS (SELECT * FROM seen WHERE reach IS NULL OR stop > reach),
labelled AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM kept UNION SELECT doc_id, label FROM base) GROUP BY doc_id),
best AS (SELECT doc_id, count(*) AS n, max(CASE priority {' '.join(f'WHEN {p} THEN {s}' for p, s in STRENGTH.items())} END) AS strength FROM kept GROUP BY doc_id),
based AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(a.n, 0) AS n_base, CAST(a.lo AS BIGINT) AS first_word, CAST(a.hi AS BIGINT) AS last_word,
  coalesce(a.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CAST(greatest(coalesce(b.strength, 0), CASE WHEN a.n > 0 THEN {STRENGTH[NAME]} ELSE 0 END) AS DOUBLE) AS score, coalesce(b.n, 0) AS n_detections
FROM doc d LEFT JOIN based a ON a.doc_id = d.doc_id LEFT JOIN labelled l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id
"""


ORACLE_SQL = _oracle_sql()
