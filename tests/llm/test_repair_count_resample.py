"""Conversation repair, token counts and importance resampling beside brute-force versions, and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm import odd
from tracklake.llm import conversations, importance, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- conversation repair

def plain_cheapest(rows, start, goals):
    """All ways as a table over rows: the least (cost, audit) for every way the output may stand."""
    def with_inserts(best):
        for _ in range(3):
            for stand, (cost, audit) in list(best.items()):
                for letter, price, then in conversations.inserts_from(stand):
                    best[then] = min(best.get(then, (10**9, "")), (cost + price, audit + letter))
        return best

    best = with_inserts({start: (0, "")})
    for row in rows:
        after = {}
        for stand, (cost, audit) in best.items():
            for letter, price, then in conversations.edits_from(row, stand):
                after[then] = min(after.get(then, (10**9, "")), (cost + price, audit + letter))
        best = with_inserts(after)
    return min((best[g] for g in goals if g in best), default=None)


def test_heaps_meet_at_the_least_audit():
    r = random.Random(3)
    for _ in range(3_000):
        rows = [conversations.Row(k, r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), "x", r.choice(["", "", "", "t", "b", "d"]))
                for k in range(r.randint(0, 9))]
        for start, goals in [(0, (0, 3)), (r.randrange(4), (r.randrange(4),))]:
            assert conversations.cheapest(rows, start, goals) == plain_cheapest(rows, start, goals)


def test_audits_give_alternating_roles():
    r = random.Random(4)
    for _ in range(300):
        rows = [conversations.Row(k, r.choice(["user", "assistant", "system"]), f"t{k}", r.choice(["", "t", "b"])) for k in range(r.randint(0, 12))]
        lines, _ = conversations.repaired(rows, conversations.cheapest(rows)[1])
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def brute_repair(table):
    """The contract in plain Python, with the table of ``plain_cheapest``."""
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        rows += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = set()
    for conv, rows in groups.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, judged = set(), []
        for turn, role, text in rows:
            bare = text.rstrip(conversations.BLANK)
            judged.append(conversations.Row(turn, role, text, "b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"))
            seen.add((role, text))
        cost, audit = plain_cheapest(judged, 0, (0, 3))
        turns = {t for t, _, _ in rows if t is not None}
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(j.fault == f for j in judged) for f in "bdt"],
                 sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:])), cost, audit,
                 hashlib.sha256("\n".join(conversations.repaired(judged, audit)[0]).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("short,segment,broadcast", [(1_000, 256, 8_000_000), (8, 3, 8_000_000), (0, 5, 0)])
def test_long_conversations_are_repaired_as_short_ones(spark, short, segment, broadcast):
    r = random.Random(5)
    table = [(conv, r.choice([None, *range(12)]) if conv % 3 else k, r.choice(["user", "assistant", "system", None, "x"]), r.choice([None, "", " \t", "Yes.", "No", "é!", "a. b"]))
             for conv in range(40) for k in range(r.choice([1, 2, 5, 12, 40]))]
    table += [(None, k % 7, r.choice(["user", "assistant"]), f"row {k}.") for k in range(90)]
    table += [(99, 3, "user", "the same.")] * 60
    df = spark.createDataFrame([(*row, 1, "x") for row in table], "conv_id long, turn long, role string, text string, cost int, audit string")
    got = conversations.repair(df, short, segment, broadcast)
    assert {tuple(row) for row in got.select(COLUMNS).collect()} == brute_repair(table)
    assert conversations.repair(df.limit(0), short, segment, broadcast).count() == 0


def test_conversation_of_dropped_rows_only(spark):
    turn = next(k for k in itertools.count() if zlib.crc32(f"7:{k}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, turn, "user", "Gone.")] * 4, "conv_id long, turn long, role string, text string")
    for short in (1_000, 1):
        assert [tuple(x) for x in conversations.repair(df, short).select(COLUMNS).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# --- token counts

@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.Vocabulary.read(MODEL)


def test_pieces_that_stand_together(vocabulary):
    made, r = token_counts.Transducer(vocabulary), random.Random(6)
    pieces = list(vocabulary.ranks)
    for _ in range(5_000):
        a, b = r.choice(pieces[:4_000]), r.choice(pieces)
        assert made.stand_together(a, b) == (made.encode(a + b) == [a, b])


def test_counts_are_those_of_the_library(vocabulary, model):
    made, r = token_counts.Transducer(vocabulary, most_states=3_000), random.Random(7)
    pieces = list(vocabulary.ranks)
    for k in range(4_000):
        text = "".join(r.choice(pieces).replace(token_counts.MARK, r.choice([" ", token_counts.MARK])) for _ in range(r.randint(0, 8)))
        text = "".join(r.choice("ab  \n\t<>s/é日ü0\x001ttheing①") for _ in range(r.randint(0, 50))) if k % 3 == 0 else text + " " * r.choice([0, 1, 3, 40]) + r.choice(["", "x", "the"])
        want = len(model.encode(text))
        assert {made.count(text, chunk) for chunk in (1, 2, 3, 7, 16, 10**6)} == {want}, text


def test_chunk_maps_compose_in_any_order(vocabulary):
    made, r = token_counts.Transducer(vocabulary), random.Random(8)
    for _ in range(300):
        text = "".join(r.choice(["▁", "▁", "the", "ing", "x", "①", "ab"]) for _ in range(12))
        cuts = sorted(r.sample(range(len(text) + 1), 3))
        a, b, c = (made.map_chunk(text[i:j]) for i, j in zip(cuts, cuts[1:] + [len(text)]))
        left, right = made.compose(made.compose(a, b), c), made.compose(a, made.compose(b, c))
        assert (left.head, left.count, left.state is right.state) == (right.head, right.count, True)


def test_token_counts_of_tables(spark, model):
    for folder in ("/root/testdata/sf0.001",):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        want = {(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in docs.select("doc_id", "text").collect()}
        assert {tuple(x) for x in token_counts.token_counts(docs, MODEL).collect()} == want
    got = token_counts.token_counts(odd.frame(spark), MODEL).collect()
    assert Counter((x["doc_id"], x["n_tokens"]) for x in got) == Counter((row[0], len(model.encode(row[1] or ""))) for row in odd.rows())
    assert token_counts.token_counts(odd.frame(spark, True), MODEL).count() == 0


def test_models_that_change_texts_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "PROBES", ("a", "b" * 3))
    monkeypatch.setattr(token_counts.Transducer, "count", lambda self, text: 99)
    with pytest.raises(ValueError):
        token_counts.Vocabulary.read(MODEL)


# --- importance resampling

def test_crc_of_joined_words():
    r = random.Random(9)
    parts = [(bytes(r.randrange(256) for _ in range(r.randrange(40))), bytes(r.randrange(256) for _ in range(r.choice([0, 1, 7, 300])))) for _ in range(500)]
    got = importance.joined(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([zlib.crc32(b) for _, b in parts], np.uint32),
                            np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def plain_runs(text, longest):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(importance.LOWER))
    return words, [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_features_are_hashed_runs(longest):
    texts = ["The quick, quick fox", None, "", "é9É İ", "a", "one-two three\nfour FIVE the", " . "]
    flat, n_words, n_runs = importance.features(texts, 1_000, longest)
    ends = np.cumsum(n_runs)
    for k, text in enumerate(texts):
        words, runs = plain_runs(text, longest)
        assert n_words[k] == len(words)
        assert sorted(flat[ends[k] - n_runs[k]:ends[k]].tolist()) == sorted(zlib.crc32(x.encode()) % 1_000 for x in runs)


@pytest.mark.parametrize("longest,percent,with_target", [(1, 10, True), (2, 35, True), (1, 100, False)])
def test_resampling_of_odd_tables(spark, longest, percent, with_target):
    got = importance.resample(odd.frame(spark), odd.benchmark(spark, not with_target), 500, longest, percent).collect()
    bucket = lambda x: zlib.crc32(x.encode()) % 500
    texts = [(row[0], *plain_runs(row[1], longest)) for row in odd.rows()]
    source = Counter(bucket(x) for _, _, runs in texts for x in runs)
    target = Counter(bucket(x) for row in (odd.benchmark(spark).collect() if with_target else []) for x in plain_runs(row["text"], longest)[1])
    S, T = sum(source.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (S + 500) / ((source[b] + 1) * (T + 500))))
    noise = lambda i: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
    rows = [(i, len(words), len(runs), sum(gain(bucket(x)) for x in runs)) for i, words, runs in texts]
    able = sorted(((-w - noise(i), i is None, i or 0, f, w) for i, n, f, w in rows if n >= 20))
    drawn = len(able) * percent // 100
    want = Counter((None if no_id else i, f, w, -score, k + 1 if k < drawn else None) for k, (score, no_id, i, f, w) in enumerate(able))
    want += Counter((i, f, w, w + noise(i), None) for i, n, f, w in rows if n < 20)
    assert Counter(tuple(x) for x in got) == want
    assert importance.resample(odd.frame(spark, True), odd.benchmark(spark)).count() == 0


# --- draws and null ids

def test_a_small_share_of_very_many_rows_is_not_none(spark):
    from tracklake.llm.common import drawn

    rows = 400_000
    for share in (20_000 / 5e10, 1e-3, 0.25):
        got = spark.range(rows).filter(drawn(share, "id")).count()
        assert abs(got - share * rows) <= 5 * math.sqrt(share * rows) + 1
    assert spark.range(10).filter(drawn(1.0, "id")).count() == 10
    # what the old bound of a million steps rounded to zero keeps its share: of 2**40 numbers spread evenly over the hashes
    bound = int(20_000 / 5e10 * 2**63)
    assert bound > 10**12


def test_leaks_without_an_id_are_taken_away(spark):
    from tracklake.llm import decontamination

    item = odd.prose(60, 21)
    docs = [(None, "Before it all. " + item + " And after."), (None, odd.prose(80, 22)), (3, item), (4, odd.prose(90, 23)), (None, None), (5, "")]
    kept = decontamination.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in spark.createDataFrame([docs[1], *docs[3:]], "doc_id long, text string").collect())
