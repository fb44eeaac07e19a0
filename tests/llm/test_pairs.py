import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from auditframe.llm import candidates, components, dart, forest, lines, queries
from tests.llm.tables import empty_documents, odd_documents


def shingle_set(text, k=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def char_set(line, k=8):
    return {line[i : i + k] for i in range(len(line) - k + 1)}


def parts(names, sets, similarity=0.8):
    """Connected parts of items whose sets are similar, by an index of all elements."""
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = collections.defaultdict(list)
    for n in names:
        for m, c in collections.Counter(m for e in sets[n] for m in index[e]).items():
            if c / (len(sets[n]) + len(sets[m]) - c) >= similarity:
                a, b = sorted((find(n), find(m)))
                root[b] = a
        for e in sets[n]:
            index[e].append(n)
    return {n: find(n) for n in names}


def test_op1_by_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = parts(sorted(docs), {i: shingle_set(t) for i, t in docs.items()})
    got = {r.doc_id: r.class_id for r in queries.op1_dart_minhash(spark, data).collect()}
    assert got == want


@pytest.fixture(params=[candidates.BROADCAST_IDS, 0], ids=["ids broadcast", "ids shuffled"])
def both_ways(request, monkeypatch):
    """Texts meet the wanted ids by a broadcast or by a shuffle; results are the same."""
    monkeypatch.setattr(candidates, "BROADCAST_IDS", request.param)


def near_copies(n, seed=4):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    base = [rnd.choice(words) for _ in range(150)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rnd.choice((1, 1, 2, 3, 6, 12))):
            own[rnd.randrange(150)] = rnd.choice(words)
        rows.append((k, " ".join(own)))
    return rows + [(n + k, " ".join(rnd.choice(words) for _ in range(80))) for k in range(30)]


def test_op1_large_group(spark, both_ways):
    rows = near_copies(300)
    want = parts([i for i, _ in rows], {i: shingle_set(t) for i, t in rows})
    got = {r.doc_id: r.class_id for r in dart.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_op1_hot_runs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(candidates, "SAMPLE", 2)
    monkeypatch.setattr(candidates, "HOT_SAMPLED", 10)
    monkeypatch.setattr(candidates, "SALTS", 7)
    monkeypatch.setattr(candidates, "OUTSIDERS", 5)
    monkeypatch.setattr(candidates, "STREAM_ROWS", 40)
    rows = near_copies(200, 5)
    want = parts([i for i, _ in rows], {i: shingle_set(t) for i, t in rows})
    got = {r.doc_id: r.class_id for r in dart.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_runs_in_parts_are_the_same_runs(spark, monkeypatch):
    rnd = random.Random(2)
    rows = sorted({(rnd.choice([1, 1, 1, 2, 3, 4]), rnd.randint(0, 80)) for _ in range(200)})
    bands = spark.createDataFrame(rows, "key long, id long")
    monkeypatch.setattr(candidates, "HOT_SAMPLED", 30)
    monkeypatch.setattr(candidates, "SALTS", 5)
    read = lambda sample: sorted(((r.key, r.a, -1 if r.b is None else r.b) for r in candidates._runs(bands, sample, 8).collect()))
    assert read(bands) == read(None)


def test_op1_weighted_by_brute_force(spark):
    rnd = random.Random(15)
    rows = []
    for g in range(12):
        unit = [[f"g{g}w{k}v{j}" for j in range(6)] for k in range(6)]
        for c in range(6):
            picks = [rnd.choice(unit) for _ in range(4)] * rnd.choice((3, 4)) + [rnd.choice(unit) for _ in range(rnd.choice((0, 1)))]
            rows.append((len(rows), " ".join(w for u in (picks if c % 2 else unit * 4) for w in u)))
    sets = {i: collections.Counter(tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i, _ in rows:
        for j in range(i):
            if (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                linked += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in dart.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), dart.DartParams(weighted=True)).collect()}
    assert linked > 12 and got == {i: find(i) for i, _ in rows}


def test_op1_odd(spark):
    odd = odd_documents(spark)
    rows = dart.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.class_id for r in rows if r.doc_id in {5, 6, 7}} == {5}
    assert all(r.class_id == r.doc_id for r in rows if not (r.text or "").split())
    kept = dart.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and 7 not in ids and ids.count(10) == 1 and {1, 2, 3}.issubset(ids)
    assert dart.near_duplicates(empty_documents(spark)).count() == 0 and dart.keep_one(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_signatures_estimate_similarity(weighted):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 44, 1000).astype(np.uint64)
    a, b = pool[:600], pool[150:750]
    wa, wb = (rng.integers(1, 6, 600), rng.integers(1, 6, 600)) if weighted else (np.ones(600, int), np.ones(600, int))
    da, db = dict(zip(a.tolist(), wa.tolist(), strict=True)), dict(zip(b.tolist(), wb.tolist(), strict=True))
    true = sum(min(da.get(x, 0), db.get(x, 0)) for x in da | db) / sum(max(da.get(x, 0), db.get(x, 0)) for x in da | db)
    k = 512
    s = dart.dart_signatures(np.repeat([0, 1], 600), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, k)
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5 + 0.01
    tiny = dart.dart_signatures(np.array([0]), pool[:1], np.array([1]), 2, 64)
    assert (tiny[0] != dart._EMPTY).all() and (tiny[1] == dart._EMPTY).all()


def test_op10_by_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    first = {}
    for i in sorted(docs):
        for p, line in enumerate((docs[i] or "").split("\n")):
            if len(line) >= 20:
                first.setdefault(line, (i, p))
    names = sorted(first, key=first.get)
    root = parts(names, {x: char_set(x) for x in names})
    order = {x: k for k, x in enumerate(names)}
    keep = {}
    for x in names:
        keep[root[x]] = min(keep.get(root[x], (1 << 60,)), (order[x], first[x]))
    stay = {v[1] for v in keep.values()}
    got = {r.doc_id: r for r in queries.op10_fuzzy_lines(spark, data).collect()}
    for i, text in docs.items():
        want = [p for p, line in enumerate((text or "").split("\n")) if len(line) >= 20 and (i, p) not in stay]
        assert sorted(got[i].removed) == want and got[i].n_removed == len(want)


def test_op10_odd(spark):
    odd = odd_documents(spark)
    report, texts = lines.line_report(odd).collect(), lines.dedup_lines(odd)
    assert len(report) == odd.count() == texts.count() and texts.columns == odd.columns
    kept = [r for r in texts.collect() if r.doc_id == 5]
    gone = [r for r in texts.collect() if r.doc_id == 6]
    assert kept[0].text and gone[0].text == "" and gone[0].n_chars == 0
    assert lines.line_report(empty_documents(spark)).count() == 0


def test_op10_short_lines_by_equality(spark):
    docs = spark.createDataFrame([(1, "Les.\n\n  \nOther"), (2, "Les.\n\n  \nles."), (3, "Other\nLes.\n" + "x" * 19)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert [(got[i].removed, sorted(got[i].removed_short), got[i].n_removed_short) for i in (1, 2, 3)] == [([], [], 0), ([], [0], 1), ([], [0, 1], 2)]
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == {1: "Les.\n\n  \nOther", 2: "\n  \nles.", 3: "x" * 19}


def test_op10_short_lines_of_a_table(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    seen, want = set(), {}
    for i in sorted(docs):
        for p, line in enumerate((docs[i] or "").split("\n")):
            if len(line) < 20 and line.strip():
                if line in seen:
                    want.setdefault(i, []).append(p)
                seen.add(line)
    assert want and {r.doc_id: sorted(r.removed_short) for r in queries.op10_fuzzy_lines(spark, data).collect() if r.removed_short} == want


def test_op10_one_changed_character(spark):
    rnd = random.Random(12)
    made, n = [], 0
    for size in (39, 40, 45, 50, 60, 70, 78, 79, 80, 81, 90, 98, 99, 100, 120):
        line = "".join(rnd.sample([chr(c) for c in range(0x4E00, 0x5000)], size))
        half = size // 2
        for k, other in enumerate((line, line[:half] + "x" + line[half + 1 :], line[:half] + "x" + line[half:])):  # as it is, changed, one more
            made.append((n + k, other))
        n += 10
    got = {r.doc_id: r.removed for r in lines.line_report(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {i: [0] if i % 10 else [] for i, _ in made}


def test_line_sets_are_sets_of_each_kind():
    params = lines.LineParams()
    mixed = ["a" * 30 + "bcdefgh", "\n" + "xyz" * 30, "xyz" * 30, "q" * 20, "abcdefghijkl" * 20]
    owner, hashes, ones = lines.line_sets(mixed, params)
    for k, x in enumerate(mixed):
        want = lines.char_sets([x.strip()], 4 if k in {0, 1, 3} else 8)[1]
        assert (hashes[owner == k] == want).all() and len(want) == (owner == k).sum()
    assert len(ones) == len(owner) and (np.diff(owner) >= 0).all()


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1200)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[x] == find(x) for x in got) and {x for e in edges for x in e if e[0] != e[1]} <= set(got)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    table = lambda rows: spark.createDataFrame(rows, "u long, v long")
    whole = lambda df: sorted((r.id, r.component) for r in df.collect())
    for cut in (0, 40, len(edges)):
        assert whole(components.extended(components.components(table(edges[:cut])), table(edges[cut:]))) == whole(components.components(table(edges)))


def test_streamed_runs_do_not_depend_on_batches():
    import pyarrow as pa

    rnd = random.Random(8)
    rows = sorted({(rnd.choice([1, 1, 1, 2, 3, 4]), rnd.randint(0, 60)) for _ in range(120)})
    table = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([i for _, i in rows])], ["key", "id"])
    read = lambda step: sorted(tuple(r.values()) for a in [candidates._stream(8)([table.slice(x, step) for x in range(0, table.num_rows, step)])] for b in a for r in b.to_pylist() if r["b"] is not None)
    assert read(1000) == read(1) == read(7)
    hubs = {k: min(i for kk, i in rows if kk == k) for k, _ in rows}
    assert read(1000) == sorted((k, hubs[k], i) for k, i in rows if i != hubs[k])


def number_sets(texts):
    """Texts are numbers or number*weight."""
    rows = sorted((k, int(candidates.mix64(np.array([int(x.split("*")[0])], np.uint64))[0] >> np.uint64(20)), int((x + "*1").split("*")[1])) for k, t in enumerate(texts) for x in t.split())
    owner, hashes, weight = zip(*rows, strict=True)
    return np.array(owner, np.int64), np.array(hashes, np.uint64), np.array(weight, np.int64)


def test_last_member_of_a_run_of_nine(spark):
    span = lambda a, b: " ".join(map(str, range(a, b)))
    texts = [(0, span(0, 40)), (1, span(6, 46)), *((i, span(0, 40)) for i in range(2, 8)), (8, span(3, 43))]  # 1 is like 8 alone, 8 is like the hub
    bands = spark.createDataFrame([(5, i) for i, _ in texts], "key long, id long")
    got = candidates.classes(bands, spark.createDataFrame(texts, "id long, text string"), number_sets, 0.8)
    assert {r.id: r.component for r in got.collect()} == dict.fromkeys(range(9), 0)


def test_sketches_hold_weights(spark):
    # Of weights 90 %, of plain sets a fifth in common.
    a, b = ("7*90 8*90 9*90 " + " ".join(map(str, range(x, x + 12))) for x in (100, 200))
    assert candidates.jaccard_pairs([a], [b], number_sets)[0] >= 0.8
    bands = spark.createDataFrame([(1, 1), (1, 2)], "key long, id long")
    got = candidates.classes(bands, spark.createDataFrame([(1, a), (2, b)], "id long, text string"), number_sets, 0.8)
    assert {r.id: r.component for r in got.collect()} == {1: 1, 2: 1}


# --- op5
def test_forest_recall(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = collections.defaultdict(list)
    for r in queries.op5_prefix_forest(spark, data).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(axis=1)
        best = [i for _, i in sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != ids[q])][:20]
        hits += len(set(best) & {i for i, _ in got[ids[q]]})
        assert got[ids[q]] == sorted(got[ids[q]], key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(got)) >= 0.9


def test_forest_recall_over_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in forest.search(df, block_rows=1500, query_rows=200).collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20]) & set(got[q]))
    assert len(got) == 300 and hits / 6000 >= 0.9


def test_forest_reads_a_share():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 64))
    f = forest.PrefixForest(x, trees=32)
    for rows in f.candidates(x[:20], 400):
        assert 400 <= len(rows) < 1600
    for q, rows in zip(x[:5], f.candidates(x[:5], 1), strict=True):
        assert any((x[r] == q).all() for r in rows)


def test_forest_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [0.5, 0.5]), (20, [1.0]), (40, [0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in forest.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == {0: [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 9, 0.5), (5, 40, 0.0)], 40: [(1, 9, 1.0), (2, 0, 0.0), (3, 1, 0.0), (4, 2, 0.0), (5, 2, 0.0)]}
    assert forest.search(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [-1e200, 0.0]), (3, [1e200, -1e200]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    found = [(r.vec_id, str(r.score)) for r in forest.search(huge).orderBy("rank").collect()]
    assert found == [(1, "inf"), (4, "1e+200"), (2, "-inf"), (3, "nan")]
    many = spark.createDataFrame([(0, [1.0, 0.0]), *[(3, [1.0, 0.0])] * 30], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in forest.search(many).collect()] == [(k, 3) for k in range(1, 21)]


def test_outsiders_meet_later_hubs_without_a_row_for_each():
    """Outsiders of runs become pair rows only where sketches agree, whatever the runs hold."""
    met = []
    mark = lambda x: bytes([x] * candidates.SKETCH)
    near = bytes([1] * candidates.SKETCH_LEAST + [9] * (candidates.SKETCH - candidates.SKETCH_LEAST))
    far = bytes([1] * (candidates.SKETCH_LEAST - 1) + [9] * (candidates.SKETCH - candidates.SKETCH_LEAST + 1))
    ahead = [{"other": 7, "sketch": near}, {"other": 8, "sketch": far}, {"other": 2, "sketch": mark(1)}, {"other": 1, "sketch": mark(1)}]
    kind = pa.schema([("id", pa.int64()), ("sketch", pa.binary()), ("ahead", pa.list_(pa.struct([("other", pa.int64()), ("sketch", pa.binary())])))])
    rows = pa.RecordBatch.from_pylist([{"id": 2, "sketch": mark(1), "ahead": ahead}, {"id": 3, "sketch": mark(5), "ahead": ahead}, {"id": 9, "sketch": mark(9), "ahead": ahead[:1]}], schema=kind)
    for batch in candidates._meet([rows.slice(0, 0), rows, rows.slice(1, 2)]):
        met += [tuple(r.values()) for r in batch.to_pylist()]
    assert met == [(2, 7), (1, 2)]


def test_band_rows_are_dealt_as_one_value_for_each_bucket():
    """Rows of (key, id) move by the bucket, not one by one; a hot key is dealt over several buckets."""
    rng = np.random.default_rng(6)
    keys, ids = rng.integers(-50, 50, 4000), rng.integers(-(1 << 62), 1 << 62, 4000)
    keys[:1000] = 7
    table = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["key", "id"])
    for hot in (np.zeros(0, np.int64), np.array([-999, 7])):
        dealt = list(candidates._dealt(None, 16, hot)(iter([table.slice(0, 100), table.slice(100, 0), table.slice(100)])))
        assert sum(b.num_rows for b in dealt) <= 16
        got, places = [], collections.defaultdict(set)
        for b in dealt:
            for k in range(b.num_rows):
                for part in candidates._undealt([b.slice(k, 1)]):
                    got += zip(part.column("key").to_pylist(), part.column("id").to_pylist(), strict=True)
                    for key in part.column("key").to_pylist():
                        places[key].add(b.column("bucket")[k].as_py())
        assert sorted(got) == sorted(zip(keys.tolist(), ids.tolist(), strict=True))
        assert {k for k, v in places.items() if len(v) > 1} == ({7} if len(hot) else set())
    assert not list(candidates._dealt(None, 16, hot)(iter([])))


def test_plain_jaccard_is_jaccard():
    params = lines.LineParams()
    rnd = random.Random(3)
    texts = ["", "", "short", "\n" + "twin of a line " * 6, *("".join(rnd.choice("ab ") for _ in range(rnd.choice((10, 79, 80, 200)))) for _ in range(60))]
    left, right = texts, [rnd.choice((t, t[3:] + "a", rnd.choice(texts))) for t in texts]
    for a, b in ((left, right), (left[:2], right[:2]), (["", "x" * 30], ["", "x" * 31]), ([], [])):
        plain = candidates.plain_jaccard(a, b, lambda x: lines.line_elements(x, params))
        assert plain.tolist() == (candidates.jaccard_pairs(a, b, lambda x: lines.line_sets(x, params)).tolist() if a else [])


def test_settling_makes_sets_only_where_sketches_agree():
    read = []

    def sets(texts):
        read.extend(texts)
        return number_sets(texts)

    span = lambda a, b: " ".join(map(str, range(a, b)))
    rows = [(0, 1, span(0, 40), 1), (0, 2, span(500, 540), 2), (1, 3, span(2, 42), 1), (1, 4, span(900, 940), 7), (1, 5, span(501, 541), 2)]
    batch = pa.RecordBatch.from_pylist([{"c": 9, "chunks": 0, "shares": 0, "turn": t, "id": i, "own": i, "text": x, "sketch": bytes([m] * candidates.SKETCH)} for t, i, x, m in rows])
    far = pa.RecordBatch.from_pylist([r | {"c": 10, "sketch": bytes([50 + k] * candidates.SKETCH)} for k, r in enumerate(batch.to_pylist())])
    for parts in ([batch], [batch.slice(k, 1) for k in range(batch.num_rows)], [far, batch]):
        read.clear()
        got = [tuple(r.values()) for b in candidates._past_outsiders(sets, 0.8)(iter(parts)) for r in b.to_pylist()]
        assert sorted(got) == [(1, 3), (2, 5)] and span(900, 940) not in read and sorted(read) == sorted({*read})


def test_named_lines_are_sparks_hashes(spark):
    rows = [(1, "a line of more than twenty\n\n  \nbrief\n" + "é" * 20), (2, None), (3, ""), (None, " " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x: h for x, h in docs.selectExpr("explode(split(text, '\n', -1)) as x").selectExpr("x", "xxhash64(x)").collect()}
    got = {r.doc_id: (r.ids, r.brief) for r in lines.named_lines(docs, lines.LineParams(), "text", "doc_id").collect()}
    full, brief, accents, wide = (want[x] for x in ("a line of more than twenty", "brief", "é" * 20, " " * 25))
    assert got == {1: ([full, None, None, brief, accents], [False, True, True, True, False]), 2: ([], []), 3: ([None], [True]), None: ([wide], [False])}
