import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from auditframe.llm import html, importance, mixing, queries, rules, toxicity
from tests.compare import same
from tests.llm.tables import empty_documents, odd_documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check_rules(rows):
    for r in rows:
        want = base_counts(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = rules.quality_rules(docs).collect()
    check_rules(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and r.n_words >= 50]
    assert all(k for q, k in judged if q == 1) and not any(k for q, k in judged if q == 0)
    assert queries.op6_line_rules(spark, data).count() == docs.count()


def test_rules_odd(spark):
    rows = rules.quality_rules(odd_documents(spark)).collect()
    assert len(rows) == odd_documents(spark).count()
    check_rules(rows)
    assert rules.quality_rules(empty_documents(spark)).count() == 0


@pytest.mark.parametrize(("line", "want"), [("Home | About | Contact | Help", "navigation"), ("A plain sentence about nothing at all.", None), ("BUY!! NOW!! OR!! NEVER!!", "shouting"), ("All rights reserved.", "boilerplate"), ("x*** y### z$$$ w%%% v&&&", "symbols"), ("Login", "punctuation"), (" ".join(["go"] * 20), "repetition")])
def test_line_faults(line, want):
    assert rules.line_fault(line, line.encode().split(), rules.LineRules()) == want


# --- op4
def test_phrases_of_four_languages():
    for line in ("Tous droits réservés 2024 la société et ses amis.", "Alle Rechte vorbehalten, der Verlag und alle anderen.", "Todos los derechos reservados por la empresa y sus socios.", "All rights reserved by the company and all its friends."):
        assert rules.line_fault(line, line.encode().split(), rules.LineRules()) == "boilerplate"


@pytest.mark.parametrize("line", ["Nike - Adidas - Puma - Reebok wrote a statement.", "Rain / snow / sun / wind came over the town on one day!"])
def test_sentences_with_separators_are_no_menus(line):
    assert rules.line_fault(line, line.encode().split(), rules.LineRules()) is None
    assert rules.line_fault(line[:-1], line[:-1].encode().split(), rules.LineRules()) == "navigation"


@pytest.mark.parametrize("separator", sorted(x.decode() for x in rules.SEPARATORS))
def test_menus_by_every_separator(separator):
    menu = f" {separator} ".join(["Home page", "Our news", "All sports", "The weather", "Local radio", "Write us."])
    assert rules.line_fault(menu, menu.encode().split(), rules.LineRules()) == "navigation"
    prose = f"The first part of this long sentence {separator} and then the second one {separator} goes on to its end here."
    assert rules.line_fault(prose, prose.encode().split(), rules.LineRules()) is None
    text = "\n".join(["A sentence about one thing or another, as they come."] * 5 + [menu] * 5)
    assert not rules.judge(text, rules.LineRules())[6]


def test_mix_equals_sql(spark, data):
    same(queries.op4_water_filling(spark, data), queries.oracle_sql()["op4_water_filling"], data)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    cap, total = {s: 3 * sizes[s] for s in names}, sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        left, w = total - sum(cap[s] for s in capped), sum(weight[s] for s in free)
        over = {s for s in free if left / w * weight[s] > cap[s]}
        if not over:
            return {s: float(cap[s]) if s in capped else left / w * weight[s] for s in names}
        capped |= over


def test_mix_by_brute_force(spark):
    odd = odd_documents(spark)
    rows = mixing.mix(odd).collect()
    sizes = collections.Counter()
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
    target = brute_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2  # rows that repeat a doc_id share one rounding each
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))
    assert mixing.mix(empty_documents(spark)).count() == 0


def test_repeated_rows_hold_the_words(spark):
    mixed = mixing.mix(odd_documents(spark))
    want = {}
    for r in mixed.collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    got = collections.Counter()
    for r in mixing.repeat_rows(mixed).collect():
        got[r.source] += len(WORD.findall(r.text or ""))
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


# --- op2
def test_importance_keeps_the_good(spark, data):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries.op2_importance(spark, data).collect()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2 and len(rows) == 200
    assert sorted(rows) == sorted(queries.op2_importance(spark, data).collect())


def test_importance_by_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}

    def grams(text):
        tokens = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
        marked = [None if k and t == tokens[k - 1] else t for k, t in enumerate(tokens)]
        return [g for k, t in enumerate(marked) for g in ((t,), (t,) if not k else (marked[k - 1], t))]

    of = {i: grams(t) for i, t in docs}
    bucket = {}
    for i, t in docs:  # a gram's bucket, read off the operator for this text alone
        bucket.update(zip(of[i], importance.ngram_buckets([t], importance.BUCKETS)[0].tolist(), strict=True))
    raw, target = {}, {}
    for i, _ in docs:
        for g in of[i]:
            raw[bucket[g]] = raw.get(bucket[g], 0) + 1
            if labels.get(i) == 1:
                target[bucket[g]] = target.get(bucket[g], 0) + 1
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target.get(b, 0) + 10 * share) / (share * (n + 10))) for b, n in raw.items()}
    weight = {i: sum(ratio[bucket[g]] for g in of[i]) / (len(of[i]) + 20) for i, _ in docs}
    noise = {i: -math.log(-math.log((zlib.crc32(f"1:{i}".encode()) + 0.5) / 2**32)) for i, _ in docs}
    rows = {r.doc_id: r for r in queries.op2_importance(spark, data).collect()}
    model = importance.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    k = sum(w >= model.threshold for w in weight.values())
    best = sorted(weight, key=lambda i: -(weight[i] + 0.02 * noise[i]))[:k]
    assert all(abs(rows[i].log_weight - weight[i]) < 1e-9 and abs(rows[i].perturbed - weight[i] - 0.02 * noise[i]) < 1e-9 for i in weight)
    assert 0 < k < len(docs) and {i for i in rows if rows[i].kept} == set(best)


def test_conflicting_labels(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, None, None), (None, 1, 1)], "doc_id int, quality int, toxic int")
    assert importance.labelled_sample(labels, "quality") == {1: 1, 2: 0}
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "d")], "doc_id long, text string")
    words, y = toxicity.training_rows(docs, labels)
    assert len(words) == len(y) <= 2 and set(y.tolist()) <= {0, 1}


def test_importance_top_k(spark):
    odd = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1), (11, 1), (8, 0), (99, None)], "doc_id long, quality int")
    model = importance.fit(odd, labels)
    everything = importance.importance_sample(odd, model, keep_all=True)
    assert everything.count() == odd.count()
    order = sorted((r.perturbed for r in everything.collect()), reverse=True)
    for k in (1, 4, 17):
        assert importance.importance_sample(odd, model, k=k).count() == sum(x >= order[k - 1] for x in order)
    assert importance.importance_sample(odd, model, k=0).count() == 0
    assert importance.importance_sample(odd, model, k=1000).count() == odd.count()
    assert importance.importance_sample(empty_documents(spark), importance.fit(empty_documents(spark), labels)).count() == 0


def test_counts_by_brute_force():
    texts = ["a b b b c", "", None, "b c!"]
    grams, n = importance.ngram_buckets(texts, 1 << 20)
    assert n.tolist() == [10, 0, 0, 6]
    one, two = grams[0::2], grams[1::2]
    assert one[2] == one[3] != one[1] and one[4] == one[6]  # the mark of repetition; c in both texts
    assert two[0] == one[0] and two[5] == one[5]


# --- op7
def test_toxicity_learns_words():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    texts, y = [], []
    for k in range(900):
        ws = list(rng.choice(words, 40))
        bad = k % 6 == 0
        if bad:
            ws[int(rng.integers(40))] = ["nasty", "vile", "rotten"][k // 6 % 3]
        texts.append(" ".join(ws))
        y.append(int(bad))
    y = np.array(y)
    ids, n = toxicity.word_ids(texts)
    parts = np.split(ids, np.cumsum(n)[:-1])
    model = toxicity.train(parts[:600], y[:600])
    toxicity.calibrate(model, parts[:600], y[:600])
    assert ((model.scores(texts[600:]) >= 0.5) == y[600:]).mean() >= 0.98
    assert 0 <= model.scores([None, ""]).min() and model.scores([None, "", " "]).max() <= 1


def test_toxicity_query(spark, data):
    rows = queries.op7_text_cnn(spark, data).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(1500):
        text, bad = [rnd.choice(words) for _ in range(rnd.randint(20, 60))], i % 4 == 0
        if bad:
            text[rnd.randrange(len(text))] = rnd.choice(["vile", "rotten", "filthy"])
        rows.append((i, " ".join(text + [rnd.choice(["the of and", "le la et", "der die und"])])))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and np.mean([p == y for p, y in held]) >= 0.97


def test_toxicity_query_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [(r.predicted, labels[r.doc_id]) for r in queries.op7_text_cnn(spark, data).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert len(rows) > 50 and np.mean([p == y for p, y in rows]) >= 0.95 and np.mean([p for p, y in rows if y == 0]) <= 0.03


def test_toxicity_odd(spark):
    odd = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1), (11, 0), (8, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.toxicity(odd, model).count() == odd.count()
    assert toxicity.toxicity(empty_documents(spark), toxicity.fit(empty_documents(spark), labels)).count() == 0


# --- op8
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav>
<div id="wrap-sidebar-right"><article><header><h1>Title &amp; more</h1></header><p><b>First&nbsp;one,
 with space.<br>Next<p>Second &lt;two&gt; &#233;.<ul><li>Point one.<li>Point two.</ul><div class="ad">Buy now, cheap.</div>
<blockquote>Said <i>so</i>.</blockquote><form><label>Mail</label><input></form></article></div>
<section class="comments"><p>A reader says this, and that.</p></section><aside><p>Related, of course.</p></aside><div class="cookie-notice"><p>We use cookies, as all do.</p></div>
<footer>&copy; x</footer><!-- <p>no</p> --></body>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\n\nFirst one, with space. Next\n\nSecond <two> é.\n\nPoint one.\n\nPoint two.\n\nSaid so."


def test_main_text_without_marks():
    page = "<body><div id=menu><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>A long sentence, with commas, and more words in it.</p><p>Another one, as long as the first, also with commas.</p></div><div><a href=x>Link</a></div></body>"
    assert html.main_text(page) == "Head\n\nA long sentence, with commas, and more words in it.\n\nAnother one, as long as the first, also with commas."


LONG = "<p>A long sentence, with commas, and more words in it, as articles have.</p><p>Another one, as long as the first, also with commas, and a last part.</p>"
WANT = "A long sentence, with commas, and more words in it, as articles have.\n\nAnother one, as long as the first, also with commas, and a last part."


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{LONG}<div class=x1><a href=a>Other story here</a></div></article>",  # a teaser
        f"<article>{LONG}<div class=x2>Buy this now</div></article>",  # an advert
        f"<article>{LONG}<article><p>I like it.</p></article></article>",  # a reader's comment
        f"<article>{LONG}<div class=card><p>Other story, short.</p></div></article>",
        f"<article>{LONG}</article><article class=ad><p>Buy this, and that, now, or never.</p></article>",
        f"<article>{LONG}</article><aside><article><p>Other story, in a card.</p></article><p>More, and more.</p></aside>",
        f"<article>{LONG}</article><div class=related><article><p>Other story, in a card.</p></article></div>",
        f"<div class=main-nav><p>Start, and news, and sport.</p></div><div id=main>{LONG}</div>",
        f"<div id=main-menu><p>Start, and news, and sport.</p></div><div>{LONG}</div>",
    ],
)
def test_furniture_in_and_beside_articles(page):
    assert html.main_text(f"<body>{page}</body>") == WANT


@pytest.mark.parametrize(
    ("page", "more"),
    [
        (f"<article>{LONG}<ul><li>Point one<li>Point two</ul></article>", "\n\nPoint one\n\nPoint two"),
        (f"<article>{LONG}<table><tr><td>1<td>2</table></article>", "\n\n1\n\n2"),
        (f"<main><article class=card>{LONG}</article></main>", ""),
        (f"<article><article>{LONG}</article></article>", ""),
        (f"<div class=card>{LONG}</div>", ""),
        (f"<div id=main class=has-sidebar>{LONG}</div>", ""),
    ],
)
def test_text_of_articles_stays(page, more):
    assert html.main_text(f"<body>{page}</body>") == WANT + more


def test_linked_title():
    assert html.main_text(f"<article><h2><a href=a>Title</a></h2>{LONG}</article>") == "Title\n\n" + WANT


@pytest.mark.parametrize("page", ["", "<", "<p", "<<>>", "<p>" * 50, "</div></div>", "<a b='", "<script>", "text only, no tags.", "&#xffffffff; &bogus;"])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


def test_pages_query(spark, data):
    rows = queries.op8_tag_paths(spark, data).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    import html as lib

    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0]
        parts = re.split(r"<h1>|</h1>|<p>|</p>", body.replace("<br>", " "))
        want = [" ".join(lib.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_pages_odd(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", PAGE), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert [r.n_chars for r in html.extract_main_text(rows).collect()][:2] == [0, 0]
    assert html.extract_main_text(rows.limit(0)).count() == 0


def test_pages_with_clashing_names(spark):
    rows = [(1, "u", "<article><p>One two three, four five six. Seven eight nine ten.</p></article>", "old", 5, 0.5), (1, "u", None, None, None, None), (None, None, "", "x", 1, 1.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, score double")
    out = html.extract_main_text(df)
    got = out.collect()
    assert len(got) == 3 and sorted(r.n_chars for r in got)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in got) and "score" in out.columns
