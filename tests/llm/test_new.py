"""op11 to op13 against brute-force versions."""

import hashlib
import math
import random
import re
import zlib

import pytest

from auditframe.llm import negatives, passages, queries, trie
from tests.llm.tables import empty_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- op12


def brute_passages(docs, window):
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def planted(rnd, n=60):
    vocabulary = ["".join(rnd.choice("abcdeéß日") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    text = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    shared = [text(k) for k in (49, 50, 51, 70, 120)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += text(rnd.randint(0, 60)) if rnd.random() < 0.6 else rnd.choice(shared)[rnd.choice([0, 0, 1]) :]
        docs.append((rnd.randint(0, n), rnd.choice([" ", "\n", "\t "]).join(words)))
    return docs + [(1000, "x " * 300), (1001, "x " * 120), (1002, "y " + "x " * 60 + "z"), docs[0], (2000, docs[0][1]), (2001, docs[0][1])]


@pytest.mark.parametrize("window", [50, 5, 17])
def test_passages_equal_brute_force(spark, window):
    docs = planted(random.Random(window)) + [(None, None), (3000, None), (3001, ""), (None, " ".join("abc" for _ in range(60))), (3002, "\x0b \x0c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(passages.dedup_digest(frame, window), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(docs, window)


def test_passages_on_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(passages.dedup_digest(odd), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(pairs, 50)
    assert passages.dedup_digest(empty_documents(spark)).count() == 0


def test_passages_query_equals_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = rows_of(queries.op12_doubled_windows(spark, data), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == brute_passages(docs, 50)
    assert any(r[2] for r in found)


def test_passages_spans_and_texts(spark):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[20:80], "new", *words[100:160]]))], "doc_id long, text string")
    found = passages.repeated_passages(docs)
    assert [[tuple(s) for s in r.spans] for r in found.orderBy("doc_id").collect()] == [[], [(0, 60), (61, 121)]]
    assert [r.kept_text for r in passages.remove_passages(docs, found).collect()] == ["new"]


def test_levels_halve_the_window():
    assert passages.levels(50) == [13, 25, 50] and passages.levels(8) == [8] and passages.levels(16) == [8, 16]


# --- op11


def brute_negatives(rows, anchor=50):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        v = [x * 256 for x in v]
        if i not in kept or (label, v) < kept[i]:
            kept[i] = (label, v)
    kept = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in kept.items():
        if a % anchor:
            continue
        score = {i: max(-(2**62), min(2**62, sum(x * y for x, y in zip(v, w, strict=False)))) for i, (_, w) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:5]:
            near = [i for i in order if kept[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, k, n, score[p], score[n]) for k, n in enumerate(near, 1)]
    return sorted(out, key=repr)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, v int").repartition(3)
    return rows_of(negatives.hard_negatives(negatives.contract_rows(frame), negatives.F.col("id") % 50 == 0), *COLUMNS)


def test_negatives_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(8)], rnd.choice([0, 0, 0, 1, 2, 9])) for i in range(700)]
    rows += [(i, [0.5, 0.25, *[0.0] * 5, 0.1], i % 3) for i in range(700, 1000)]  # copies: ties by id
    rows += [(1001, None, 1), (1002, [1.0, None], 1), (1003, [float("nan")] * 8, 1), (1004, [float("inf")] * 8, 2), (1005, [0.1] * 8, None), (None, [0.1] * 8, 1), (1006, [], 1), (1007, [0.0] * 8, 2), (1008, [0.4, 0.4], 0), (50, [0.9] * 8, 1), (50, [0.9] * 8, 0), (51, [0.2] * 8, 4), (51, [0.2] * 8, 4)]
    want = brute_negatives(rows)
    assert len(want) > 50
    wide = [(*r, "x", 1) for r in rows]
    assert mined(spark, wide) == want
    for name, value in (("FEW", 1), ("BLOCK_ROWS", 100), ("ANCHORS", 4)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, wide) == want


def test_negatives_of_huge_and_of_no_vectors(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(0, 14) for _ in range(3)], i % 2) for i in range(0, 400)] + [(1050, [1e300, 1.0, 2.0], 1)]
    assert mined(spark, [(*r, "x", 1) for r in rows]) == brute_negatives(rows)
    assert mined(spark, []) == []


def test_negatives_query_equals_brute_force(spark, data):
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    found = rows_of(queries.op11_radix_negatives(spark, data), *COLUMNS)
    assert found == brute_negatives(rows) and found


# --- op13


def brute_trie(turns):
    by = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    by = {c: [x for _, x in sorted(rows)] for c, rows in by.items()}
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(by.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members = {}
    for c, rows in built.items():
        for d in range(len(rows) + 1):
            members.setdefault(rows[:d], []).append(c)
    out = []
    for node, own in members.items():
        inside = [x for x in members if x[: len(node)] == node]
        parent = min(members[node[:-1]]) if node else None
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(node))))
        children = lambda n: sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in members)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in inside if x)
        out.append((min(own), len(node), parent, len(own), children(node), sum(not children(x) for x in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string, c long, pos string"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    turns = []
    for c in [*range(0, 40), -3, -10, 101, 102, 2_000_001]:
        for t in range(rnd.choice([1, 2, 3, 5, 9, 14])):
            turns.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", None]), rnd.choice(["a", "é", None, "ab"] if t > 1 else ["a"])))
    turns += [(None, 1, "user", "a"), (200, 0, "x", "y"), (205, 0, "x", "y"), (205, 0, "x", "y")]
    want = brute_trie(turns)
    frame = spark.createDataFrame([(*t, 7, "z") for t in turns], TURNS).repartition(3)
    assert rows_of(trie.prefix_trie(frame), *NODE) == want
    monkeypatch.setattr(trie, "BLOCK", 2)
    monkeypatch.setattr(trie, "IDS", 2)
    assert rows_of(trie.prefix_trie(frame), *NODE) == want


def test_trie_of_no_and_of_turnless_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    short = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    turns = [(short, 0, "user", "hello", 1, "z")]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(turns, TURNS)), *NODE) == brute_trie([t[:4] for t in turns])


def test_trie_query_equals_brute_force(spark, data):
    turns = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_prefix_trie(spark, data), *NODE) == brute_trie(turns)


def test_names_are_dense(spark):
    frame = spark.range(1000).selectExpr("id", "id % 37 as k").repartition(6)
    names = {(r.k, r.name) for r in trie.named(frame, ["k"]).collect()}
    assert sorted(n for _, n in names) == list(range(37)) and len({k for k, _ in names}) == 37
