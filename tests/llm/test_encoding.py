import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditframe.llm import bpe, planes, queries
from tests.llm.tables import empty_documents, odd_documents

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
CODEC = bpe.PieceCodec(RANKS, P.PATTERN)
TEXTS = st.text(st.sampled_from("ab'stremvld  \n\t1²!.,é日\x00 "), max_size=40) | st.text(max_size=30)


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lib


def test_pattern_is_the_known_one():
    assert P.PATTERN == bpe.GPT_PATTERN and CODEC.cut is not None


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_bpe_equals_tiktoken(exact, texts):
    for text, ids in zip(texts, CODEC.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(text)
        assert CODEC.decode(ids) == text.encode("utf-8", "surrogatepass")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 10), st.binary(max_size=8))
def test_edits_re_encode(piece, start, length, new):
    start, end = min(start, len(piece)), min(start + length, len(piece))
    encoder = bpe.PrefixEncoder(CODEC.bpe, piece)
    assert encoder.ids() == CODEC.bpe.merge(piece)
    encoder.replace(start, end, new)
    assert encoder.piece == piece[:start] + new + piece[end:] and encoder.ids() == CODEC.bpe.merge(encoder.piece)


def test_edits_stop_early():
    piece = b"the quick brown fox " * 40
    assert bpe.PrefixEncoder(CODEC.bpe, piece).replace(3, 4, b"x") < 200


def test_appends_keep_the_table():
    encoder = bpe.PrefixEncoder(CODEC.bpe, b"hel")
    before = list(encoder.last)
    encoder.append(b"lo world")
    assert encoder.last[:3] == before and encoder.ids() == CODEC.bpe.merge(b"hello world")


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_words_equal_library(library, texts):
    global TOKENIZER
    if "TOKENIZER" not in globals():
        TOKENIZER = planes.WordTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read(), 1)
    for text, ids in zip(texts, TOKENIZER(texts), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_added_tokens_have_their_ids():
    from tokenizers import Tokenizer

    own, lib = planes.WordTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read(), 1), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["a <|startoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|startoftext|", "A <|STARTOFTEXT|> b", "<| startoftext |>", "é日 <|endoftext|>", "plain words"]
    got = [ids.tolist() for ids in own(texts)]
    assert got == [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in texts] and 49406 in got[0] and 49407 in got[1]


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_plane_files_round_trip(mode, block):
    rng = np.random.default_rng(1)
    docs = [(None, rng.integers(0, 50_000, 5)), (-3, rng.integers(0, 2**32, 0)), (4, rng.integers(0, 2**32, 130)), (4, rng.integers(0, 9, 1))]
    out = io.BytesIO()
    writer = planes.PlaneWriter(out, mode, block)
    for i, ids in docs:
        writer.add(i, ids.astype("<u4"))
    writer.close()
    back = [(i, np.concatenate(p).tolist() if p else []) for i, p in planes.PlaneReader(io.BytesIO(out.getvalue())).documents()]
    assert back == [(i, ids.tolist()) for i, ids in docs]
    damaged = bytearray(out.getvalue())
    damaged[12] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(planes.PlaneReader(io.BytesIO(bytes(damaged))).documents())


def test_query_op3(spark, data, exact):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op3_prefix_bpe(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(exact.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_query_op9(spark, data, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op9_bit_planes(spark, data).collect()}
    at = 0
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i], add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_odd_tables(spark, exact):
    odd = odd_documents(spark)
    got = bpe.bpe_encode(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decoded="score")
    assert got.count() == odd.count() and got.columns == [c for c in odd.columns if c != "score"] + ["ids", "score"]
    for r in got.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == exact.encode_ordinary(r.text or "") and bytes(r.score) == (r.text or "").encode()
    files, folder = planes.encode_to_planes(odd, P.path("word_bpe_49k.json"))
    back = planes.read_planes(spark, files, folder).orderBy("start").collect()
    assert len(back) == odd.count() and [r.doc_id for r in back][:2] == [None, None]
    for table in (empty_documents(spark),):
        assert bpe.bpe_encode(table, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
        files, folder = planes.encode_to_planes(table, P.path("word_bpe_49k.json"))
        assert planes.read_planes(spark, files, folder).count() == 0


def test_frequent_words_outlast_rare_ones(library, monkeypatch):
    """A full cache keeps the words it still meets, so they go to the library once."""
    monkeypatch.setattr(planes, "CACHE_WORDS", 40)
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        words = planes.WordTokenizer(file.read(), None)
    asked, learn = [], words._learn
    words._learn = lambda unseen, into: (asked.extend(unseen), learn(unseen, into))[1]
    for k in range(30):
        text = f"the frequent word  and\n\tothers rare{'abcdefghijklmnopqrstuvwxyz'[k % 26] * (1 + k)}"
        assert words([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked.count("frequent") == 1 and not any(w.isspace() for w in asked)
    assert len(words.cache.young) + len(words.cache.old) <= 40


def test_frequent_pieces_outlast_rare_ones(exact, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 40)
    codec = bpe.PieceCodec(RANKS, P.PATTERN)
    asked, learn = [], codec.learn
    codec.learn = lambda unseen, into: (asked.extend(unseen), learn(unseen, into))[1]
    for k in range(30):
        text = f"the frequentpiece  and\n\tothers rare{'abcdefghijklmnopqrstuvwxyz'[k % 26] * (1 + k)}"
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == exact.encode_ordinary(text)
    assert asked.count(" frequentpiece") == 1


def test_other_operators_empty_kept_encoders():
    from auditframe.llm import common

    rows = common.pa.RecordBatch.from_pydict({"text": ["a"]})
    own = bpe._codec(RANKS, 1, P.PATTERN)
    list(common.text_slices([rows], keeps=bpe._codecs))
    assert bpe._codecs[(1, P.PATTERN)] is own
    list(common.text_slices([rows]))
    assert not bpe._codecs
