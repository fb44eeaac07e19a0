"""Small tables with hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, text_id string"


def odd_documents(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, base), (6, base), (7, " ".join(near)), (8, text(30_000)), (9, "日本語 テスト\nÀé ﬁ  two  spaces'll"), (None, base), (None, text(60)), (10, "a\n" + text(60) + "\n" + text(60)), (11, text(80)), (11, text(80)), (12, text(70)), (12, None)]
    rows += [rows[11], rows[11]]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i in {5, 8} else f"s{(i or 0) % 3}", None if t is None else len(t), 0.5, "x", "y") for i, t in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
