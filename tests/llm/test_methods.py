"""The operators beside brute-force versions and on cases made for their methods."""

import base64
import hashlib
import math
import random
import re
import statistics
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import secret_reference
from tests.llm.odd import prose
from tracklake.llm import (compression, decontamination, licenses, packing, pii, quality, queries, recompression, registry, secret_scan,
                           signature_tree, spans, toxicity)
from tracklake.llm.features import Hasher
from tracklake.llm.shingles import shingle_set

FOLDER = "/root/testdata/sf0.001"
assert queries  # registers the queries


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def families(seed: int) -> list[tuple[int, str]]:
    r, docs = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append(" ".join(copy[:max(1, len(copy) - r.choice((0, 0, 0, 5)))]))
    return [(3 * i + 1, t) for i, t in enumerate(docs)]


def brute_components(rows, width, percent):
    sets = [(i, set(shingle_set(t or "", width).tolist())) for i, t in rows]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = root(i), root(j)
                label[max(u, v)] = min(u, v)
    return {(i, len(a), root(i)) for i, a in sets}


@pytest.mark.parametrize("width,percent,bounds,hot", [(3, 90, None, None), (5, 80, None, 1), (5, 80, None, 4), (3, 80, (3, 500), 6)])
def test_components_against_all_pairs(spark, monkeypatch, width, percent, bounds, hot):
    if hot:  # so low that most, or some, shingles of a family count as hot
        monkeypatch.setattr(signature_tree, "hot_shingles", lambda docs, w, counts=None: hottest(docs, w, hot))
    if bounds:  # clusters split into several trees
        monkeypatch.setattr(signature_tree, "TREE_SETS", bounds[0])
        monkeypatch.setattr(signature_tree, "TREE_SHINGLES", bounds[1])
    rows = families(5)
    got = signature_tree.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, width, percent)


def hottest(docs, width, times):
    found, counts = np.unique(np.concatenate([shingle_set(r["text"], width) for r in docs.collect()]), return_counts=True)
    return found[counts >= times]


def test_hot_shingles_are_the_shared_ones(spark, monkeypatch):
    monkeypatch.setattr(signature_tree, "HOT", 3)
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} {passage} d{i}") for i in range(30)], "doc_id long, text string").coalesce(1)
    got = signature_tree.hot_shingles(docs, 5)
    assert got.tolist() == hottest(docs, 5, 30).tolist() and len(got) == 8


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rows = families(6)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_components(rows, 5, 80)}


def test_near_duplicates_leave_texts_where_they_lie(spark, monkeypatch):
    """Neither the candidates nor the kept documents are found by a shuffle of all texts."""
    rows, found, search = families(6), [], signature_tree.linked_sets
    monkeypatch.setattr(signature_tree, "linked_sets", lambda *a: found.append(search(*a)) or found[-1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = signature_tree.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found[0], kept)]
        assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_components(rows, 5, 80)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan, kind in zip(plans, ("LeftSemi", "LeftAnti")):
        assert any("BroadcastHashJoin" in line and kind in line for line in plan.splitlines())
    assert "Exchange hashpartitioning" not in plans[1]


def brute_repeats(rows, width=20):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for i in range(len(words) - width + 1):
            window = tuple(words[i:i + width])
            if window in seen:
                gone.update(range(i, i + width))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,letters", [(1, 1), (2, 2), (3, 4), (4, 300)])
def test_repeats_against_all_windows(spark, seed, letters):
    r, docs = random.Random(seed), []
    for _ in range(30):
        d = [f"w{r.randrange(letters)}" for _ in range(r.randint(0, 120))]
        if docs and r.random() < 0.7:
            s = r.choice(docs)
            i = r.randrange(len(s) + 1)
            d = d[:40] + s[i:i + r.randint(10, 80)] + d[40:]
        docs.append(d)
    rows = [(100 - i, " ".join(d)) for i, d in enumerate(docs)]
    got = recompression.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert {g["doc_id"]: tuple(g)[1:4] for g in got} == brute_repeats(rows)
    assert all(hashlib.sha256(g["kept_text"].encode()).hexdigest() == g["kept_sha256"] for g in got)


def test_base_rules_against_plain_code(spark, texts):
    for r in registry.QUERIES["op5_compression_bands"](spark, FOLDER).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        often = {t for t in triples if triples.count(t) > 1} if len(triples) < 2_000 else None
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        if often is not None:
            assert r["n_repeat_words"] == len({i + k for i, t in enumerate(triples) if t in often for k in range(3)})
        assert not (r["kept"] and r["base_failed"])


def test_bands_reject_repetition_and_noise():
    judge = compression.rules()
    columns = [c.split()[0] for c in compression.RESULT.split(", ")]
    kept = columns.index("kept")
    assert judge(prose(800, 3))[kept]
    assert not judge("all the same words again and again " * 300)[kept]
    r = random.Random(1)
    assert not judge(" ".join(base64.b85encode(r.randbytes(60)).decode() for _ in range(100)))[kept]


def test_bands_follow_the_table(spark):
    """Junk that the fixed limits let pass is rejected beside prose, however often it is repeated."""
    words = [f"{a}{b}" for a in ("ba", "ten", "mor", "li", "vus", "ka", "sel", "dro") for b in ("n", "rit", "o", "lem", "ast", "ik", "ur", "eth")]
    texts = []
    for seed in range(120):
        r = random.Random(seed)
        texts.append(" ".join(r.choice(words) + "".join(r.choices("etaoinshr", k=3)) for _ in range(700)))
    r = random.Random(1)
    junk = " ".join(r.choice(words) + "".join(r.choices("etaoinshr", k=3)) + r.choice(("%%%", "$$$")) for _ in range(700))
    texts += [junk] * 400
    n = compression.RESULT.split(", ").index("kept boolean")
    assert compression.rules()(junk)[n]
    rows = compression.compression_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert not kept & set(range(120, 520)) and len(kept) >= 108
    assert all(r["n_chunks"] == -(-len(texts[r["doc_id"]]) // compression.CHUNK) for r in rows)


@pytest.mark.parametrize("n", [3, 60, 400])
def test_verdicts_against_plain_code(spark, texts, n):
    """Every verdict from sorted lists of ratios, at table sizes below and above the weight of the fixed limits."""
    rows = [(i, t) for i, t in sorted(texts.items())[:n]] + [(-1, prose(9_000, 7)), (-2, prose(9_000, 7)), (-3, "ab " * 3_000), (-4, "")]
    z = zstandard.ZstdCompressor(level=compression.LEVEL, write_content_size=False)
    pieces = lambda raw: [raw[i:i + compression.CHUNK] for i in range(0, len(raw), compression.CHUNK)]
    ratio = lambda raw: len(z.compress(raw)) / len(raw)
    step = lambda raw: int(4 * math.log2(len(raw)))
    different = {t.encode() for _, t in rows if t}
    lists = {}
    for raw in different:
        for whole, parts in ((True, [raw]), (False, pieces(raw))):
            for part in parts:
                lists.setdefault((whole, step(part)), []).append(math.floor(ratio(part) * 2_000 + 0.5))

    def inside(whole, raw):
        low, high = compression.CHUNK_BAND if not whole and len(raw) == compression.CHUNK else next(
            (a, b) for least, a, b in reversed(compression.WHOLE_BANDS) if len(raw) >= least)
        seen = lists[whole, step(raw)]
        middle = statistics.median_low(seen)
        spread = max(0.01, 1.4826 * statistics.median_low([abs(x - middle) for x in seen]) / 2_000)
        share = len(seen) / (len(seen) + 50)
        return (low + share * max(0, middle / 2_000 - 2.5 * spread - low) <= ratio(raw)
                <= high - share * max(0, high - middle / 2_000 - 2.5 * spread))

    got = {r["doc_id"]: r for r in compression.compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = t.encode()
        want = bool(raw) and not got[i]["base_failed"] and inside(True, raw) and 2 * sum(not inside(False, c) for c in pieces(raw)) <= len(pieces(raw))
        assert got[i]["kept"] == want, i
    assert {r["kept"] for r in got.values()} == {True, False}


BASE_PII = (("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_pii(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    tests = {"ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
             "phone": lambda s: 9 <= len(digits(s)) <= 15}
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    return out + [(k, *m.span()) for k, p in BASE_PII for m in re.finditer(p, text) if tests[k](m[0])]


def test_personal_data_against_the_patterns(spark, texts):
    r = random.Random(1)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+49", " ", "_x@y.z-q.com", "0", "7"]
    made = ["".join(r.choice(pieces) for _ in range(40)) for _ in range(300)]
    for text in [*texts.values(), *made]:
        base = [s[:3] for s in pii.find(text) if s[0] in pii.BASE_KINDS]
        assert base == plain_pii(text)


def test_checksums_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [s[0] for s in pii.find("Account IBAN GB82WEST12345698765432 thanks")] == ["iban"]
    assert [s[0] for s in pii.find("her social security number 219-09-9999")] == ["ssn"]
    assert not pii.find("part 219-09-9999")
    assert pii.mask("mail a@b.org or +1 212 555 0100") == "mail <email> or <phone>"


def test_account_numbers_before_other_tokens():
    plain, grouped = "ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332"
    for number in (plain, grouped, "GB82 WEST 1234 5698 7654 32", "AT611904300234573201", "BE68 5390 0754 7034"):
        for after in ("", " BIC CAIXESBBXXX", " BIC", " 2024", " 12 34", " DE", " ABCD EFGH", ", thanks"):
            text = f"Account {number}{after}"
            assert [(s, e) for k, s, e, _ in pii.find(text) if k == "iban"] == [(8, 8 + len(number))], text
    assert pii.mask(f"IBAN {grouped} BIC CAIXESBBXXX").startswith("IBAN <iban> BIC")
    assert not pii.ibans("ES91 2100 0418 4502 0005 1333 BIC CAIX")
    assert pii.ibans(f"XX12 3456 7890 {grouped}") == [(15, 15 + len(grouped))]


def planted(n: int, seed: int = 3) -> list[tuple]:
    """Texts with keys of all kinds and lengths, words run together, identifiers and paths: (id, text)."""
    r = random.Random(seed)
    alphabets = {name: (secret_scan.SYMBOLS[:62] + "-_" if name == "base64url" else secret_scan.SYMBOLS[:k]) for name, k in secret_scan.SIZES.items()}
    plain = ["internationalization_and_localization", "usr/share/applications/defaults", "conference2024programmecommittee", "x" * 45 + "1",
             "token = 'abc'", "password: hunter2hunter2", "api_key=AKIA" + "Q7" * 9, "é日本 secret=\"a.b.c=\"", "AKIAshort", "TOKEN:" + "ab12" * 10]
    out = []
    for i in range(n):
        name = r.choice(list(alphabets))
        key = "".join(r.choice(alphabets[name]) for _ in range(r.choice((20, 32, 48, 64, 120))))
        words = [r.choice(plain) for _ in range(r.randint(0, 6))] + [key] * (i % 3) + [f"secret = {key}"] * (i % 5 == 0) + [key + "=="] * (i % 7 == 0)
        r.shuffle(words)
        out.append((i, " ".join(words)))
    return out + [(None, None), (n, ""), (n, None), (n + 1, "deadbeef" * 3 + " cafe " * 3 + "token=" + "z" * 6 + " é " * 5 + "0123456789abcdef" * 2)]


def test_secrets_against_plain_python(spark, texts):
    rows = planted(400) + list(texts.items())
    want = secret_reference.scan(rows)
    got = secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).drop("base", "tested")
    plan = got._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEvalPython"))
    key = lambda row: tuple((x is not None, x) for x in row)
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert got == sorted(want, key=key)
    assert sum("random:" in r[-1] for r in got) > 100


def test_secret_battery(spark):
    r = random.Random(11)
    tokens = [("".join(r.choice(secret_scan.SYMBOLS[:k]) for _ in range(n)),) for k in (16, 36, 62, 64) for n in (20, 24, 40, 64, 400) for _ in range(20)]
    tokens += [("internationalization2024conference",), ("a" * 30,), ("ab" * 4_000,), ("A1-_+/" * 6 + "==",), ("z" * 19 + "-",)]
    rows = spark.createDataFrame(tokens, "t string").select("t", secret_scan.battery(F.col("t")).alias("b")).select("t", "b.*").collect()
    for row in rows:
        encoding, p_random, p_ordinary = secret_reference.battery(row.t)
        assert row.encoding == encoding
        assert row.p_random == pytest.approx(p_random, rel=1e-5, abs=1e-12)
        assert abs(row.step - secret_reference.step_of(p_ordinary)) <= 1, row
    drawn = [x for x in rows if len(x.t) == 400]
    assert sum(x.p_random < secret_scan.RANDOM_LEVEL for x in drawn) <= 2 and all(x.step > 100 for x in drawn)


def test_candidates_need_no_digit(spark):
    r = random.Random(5)
    keys = ["".join(r.choice(secret_scan.SYMBOLS[10:62]) for _ in range(n)) for n in (20, 24, 60)]
    rows = spark.createDataFrame([(f"key {k} end",) for k in keys], "t string").select(spans.places(F.col("t"), secret_scan.CANDIDATE).alias("p")).collect()
    assert [[(p.start, p.end, p.value) for p in row.p] for row in rows] == [[(4, 4 + len(k), k)] for k in keys]


def test_places_of_very_many_matches(spark):
    got = spark.range(1).select(spans.places(F.expr("repeat('é ab12 ', 60000)"), "[a-z]+([0-9]+)", 1).alias("p")).select(
        F.size("p").alias("n"), F.expr("size(filter(p, (x, i) -> x.start = 7 * i + 2 and x.end = x.start + 4 and x.value = '12'))").alias("right")).first()
    assert tuple(got) == (60_000, 60_000)


def test_false_discovery_threshold(spark):
    tested = spark.createDataFrame([("hex", 200)] * 50 + [("hex", 5)] * 1_000 + [("base62", 3)] * 9, "encoding string, step int")
    assert [tuple(r) for r in secret_scan.thresholds(tested, 0.01).collect()] == [("hex", 200)]
    assert secret_reference.threshold({200: 50, 5: 1_000}, 0.01) == 200


def test_license_rules(spark):
    cases = {1: "Released under the MIT License.", 2: "SPDX-License-Identifier: Apache-2.0", 3: "under the GNU General Public License, version 3.",
             4: "Licensed under CC BY-NC 4.0.", 5: "the summit licensed the accord", 6: "Apache License, Version 2.0 and again Apache License Version 2",
             7: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", 8: "word cc by  nc cc-by-nc"}
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["labels"]) == (1, 1, "mit", "mit")
    assert got[2]["labels"] == "apache-2" and got[2]["score"] == 1.0 and got[2]["n_base"] == 0
    assert got[3]["labels"] == "gpl-3"
    assert got[4]["labels"] == "cc-by-nc,cc-by-nc-4.0" and got[4]["base_labels"] == "cc-by-nc"
    assert got[5]["labels"] == "" and got[5]["score"] == 0.0
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (2, 0, 7)
    assert got[7]["labels"] == "mit"
    assert (got[8]["n_base"], got[8]["last_word"], got[8]["n_words"]) == (2, 4, 7)


def test_license_text_with_very_many_detections(spark):
    got = licenses.license_scan(spark.range(1).select("id", F.expr("repeat('the mit license and ', 40000)").alias("text")), "id").first()
    assert (got["labels"], got["n_detections"], got["n_words"]) == ("mit", 40_000, 160_000)


def test_every_license_rule_is_reached(spark):
    """A text made from each rule passes the gate and the keyword of the rule and is found by it."""
    made, rules = [], licenses.rules()
    for i, rule in enumerate(rules):
        words = [re.sub(r"\(\?:19\|20\)\[0-9\]\[0-9\]", "1999", w).split("|")[0] for w, optional in re.findall(r"\(\?: \(\?:(.*?)\) \)(\??)", rule.regex)]
        made.append((i, " ".join(words)))
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    missed = [(rules[i].label, text) for i, text in made if got[i]["n_detections"] == 0]
    assert len(rules) > 300 and not missed


def test_base_license_columns(spark, texts):
    for r in registry.QUERIES["op3_license_rules"](spark, FOLDER).collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_reparameterised_questions(spark):
    question = "A train leaves Boston at 12 km per hour and after 12 hours it meets Anna who walked slowly from the old town to the station"
    same = question.replace("12", "35").replace("Boston", "Dresden").replace("Anna", "Maria")
    mixed = question.replace("12 km", "35 km")  # one slot of the item gets two values
    docs = [(1, "Some words first. " + question + " and more."), (2, "Other words. " + same + " the end."), (3, mixed), (4, prose(100, 2))]
    got = {r["doc_id"]: r for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                                        spark.createDataFrame([(7, question)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1]["exact"] and not got[2]["exact"] and got[2]["n_changed"] == 3


def accuracy(spark, name, label, fold, rest):
    known = {r["doc_id"]: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    scored = registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == rest) for r in scored)
    held = [(r["predicted"], known[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in known]
    return sum(a == b for a, b in held) / len(held)


def test_near_copies_of_benchmark_items(spark):
    """Edited, shifted, recased and short copies, which single alignments miss, and no chance agreement."""
    apples = "the old farmer had 3 apples in the red basket near the door and 3 pears on the small table behind the long kitchen wall"
    middle = "one by one the quiet people left the wide green valley and went over the hills to find another home by the sea"
    names = "when Anna met Boris near Dresden they took the slow train to Prague and then walked with Clara along the dark river home"
    items = [(1, apples), (2, middle), (3, " ".join(middle.split()[:20])), (4, " ".join(middle.split()[:16])), (5, names), (6, "which blue bird sings at noon"),
             (7, "add 17 and 4 and 12 and 93 and 5 and 61")]
    insert = lambda t, k: " ".join([*t.split()[:k], "really", *t.split()[k:]])
    docs = [(1, apples.replace("3 apples", "4 apples").replace("3 pears", "7 pears")), (2, insert(middle, 12)), (3, insert(items[2][1], 10)), (4, insert(items[3][1], 8)),
            (5, names.lower()), (6, names.upper()), (7, "so Which blue bird sings at noon then"), (8, "now add 17 and 4 and 12 and 93 and 5 and 61 please"),
            (9, "another text about a farmer who had 3 apples and the people who left the valley long ago without any train at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for few in (100_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.near_leaks(frame, bench, broadcast_windows=few).collect()}
        assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 6), (8, 7)} <= got and 9 not in {d for d, _ in got}
    assert [r["doc_id"] for r in decontamination.clean(frame, bench).collect()] == [9]


def test_near_leaks_hold_all_leaks(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "benchmark"))
    plain = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert plain and plain <= {(r["doc_id"], r["item_id"]) for r in decontamination.near_leaks(docs, bench).collect()}


def test_held_out_toxicity(spark):
    assert accuracy(spark, "op4_toxicity", "toxic", 5, 0) > 0.85


def test_held_out_quality(spark):
    assert accuracy(spark, "op7_positive_unlabelled_quality", "quality", 4, 2) > 0.9


def test_ftrl_learns_sparse_weights():
    good, bad = [prose(60, i) for i in range(40)], [prose(60, i) + " idiot scum" for i in range(40, 80)]
    weights = toxicity.fit_shard(good + bad, [0] * 40 + [1] * 40, 18, 3)
    slots = Hasher(18).slots("idiot")
    assert len(weights) < 3_000 and set(slots.tolist()) & set(weights["slot"])


def test_non_negative_risk_separates():
    r = np.random.default_rng(1)
    width = len(quality.FEATURES)
    positive, bad = r.normal(1, 0.5, (400, width)), r.normal(-1, 0.5, (200, width))
    model = quality.fit(positive[:200], np.concatenate([positive[200:], bad]), 0.5)
    assert (model.margin(positive) > 0).mean() > 0.97 and (model.margin(bad) < 0).mean() > 0.97


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [(b["rest"], i) for i, b in enumerate(bins) if b["rest"] >= size and (cluster is None or cluster not in b["clusters"])
                and (source is None or b["sources"].count(source) < per_source)]
        if not fits:
            bins.append({"rest": capacity, "clusters": [], "sources": []})
            fits = [(capacity, len(bins) - 1)]
        tightest = min(fits)[0]
        out.append(tightest - size)
        i = next(i for rest, i in fits if rest == tightest)
        bins[i]["rest"] -= size
        bins[i]["clusters"].append(cluster)
        bins[i]["sources"].append(source)
    return out, bins


@pytest.mark.parametrize("seed, per_source, copies", [(2, 3, 0), (3, 1, 40), (4, 2, 12), (5, 4, 3)])
def test_bins_against_a_search_over_all_bins(seed, per_source, copies):
    r = random.Random(seed)
    sizes = sorted((r.choice([r.randint(1, 100), 7, 20]) for _ in range(600)), reverse=True)
    sources = [r.choice([None, "a", "a", "a", "b", "c"]) for _ in sizes]
    clusters = [r.randrange(copies) if copies and r.random() < 0.5 else None for _ in sizes]
    bins = packing.Bins(100, per_source)
    left = []
    for size, source, cluster in zip(sizes, packing.bits(sources), packing.bits(clusters)):
        b = bins.place(size, source, cluster)
        left.append((b, bins.residual[b]))
    plain, plain_bins = plain_best_fit(sizes, sources, clusters, 100, per_source)
    assert [rest for _, rest in left] == plain
    assert bins.residual == [b["rest"] for b in plain_bins]


@pytest.mark.parametrize("kind", ["one source", "one cluster", "pairs of one source"])
def test_bins_that_refuse_are_not_tried_for_every_piece(kind, monkeypatch):
    looks, first = [], packing.Bins._first
    monkeypatch.setattr(packing.Bins, "_first", lambda self, *a: looks.append(1) or first(self, *a))
    n = 20_000
    bins = packing.Bins(4_096, 4)
    for i in range(n):
        bins.place(40 - 30 * i // n, 0 if kind == "one cluster" else 1, {"one source": 0, "one cluster": 1}.get(kind, 1 << i // 2 % 500))
    assert len(bins.residual) == (n if kind == "one cluster" else n // 4)
    assert len(looks) < 3 * n


def test_short_pieces_are_dealt_to_more_shards(spark):
    lengths = spark.range(1_000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_words"),
                                        F.lit("s").alias("source"), F.lit(None).cast("string").alias("cluster"))
    got = packing.pack(lengths, shard_pieces=100)
    assert got.count() == 1_000 and got.select(F.split("bin_id", "-")[0]).distinct().count() == 10


def test_packed_bins_hold_no_conflict(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lengths = packing.measured(docs)
    of = {r["doc_id"]: r for r in lengths.collect()}
    got = packing.pack(lengths, capacity=1_000, per_source=2, shard_bins=20).collect()
    bins = {}
    for p in got:
        if p["bin_id"] is not None:
            bins.setdefault(p["bin_id"], []).append(p)
    for pieces in bins.values():
        assert sum(p["n_words"] for p in pieces) <= 1_000
        clusters = [of[p["doc_id"]]["cluster"] for p in pieces]
        sources = [of[p["doc_id"]]["source"] for p in pieces]
        assert len(set(clusters)) == len(clusters) and max(map(sources.count, sources)) <= 2
        ends = sorted((p["bin_offset"], p["bin_offset"] + p["n_words"]) for p in pieces)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0
    for doc, r in of.items():
        assert sum(p["n_words"] for p in got if p["doc_id"] == doc) == r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[doc]))


def test_pipeline_result_is_that_of_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_op1_query_reports_near_copies(spark, tmp_path):
    """The registered query and its SQL on an edited, a recased and a repeated copy, a null and an empty text."""
    text = "when Anna met Boris near Dresden they took the slow train to Prague and then walked 12 km with Clara along the dark river home"
    docs = [(1, text.lower()), (2, text.replace("slow", "very slow")), (3, f"{text}. {text}"), (4, None), (5, ""), (6, "nothing of this kind is said in here at all by anyone")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text), (1, text), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"], r["n_windows"], r["coverage"]) for r in queries.op1_template_decontamination(spark, str(tmp_path)).collect()}
    assert {g[:2] for g in got} == {(1, 1), (2, 1), (3, 1)}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert set(con.execute(decontamination.ORACLE_SQL).fetchall()) == got
