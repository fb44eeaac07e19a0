"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters of several widths run over them, each is pooled by its
maximum over the text, and a linear layer gives the logit. Thresholds are calibrated by language:
the language is guessed from the text's function words, and the logit is shifted by the threshold
found for it, so that a score of 0.5 is the threshold everywhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditframe.llm.common import text_slices
from auditframe.session import ship

HASH_BITS = 22
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Labelled rows that the fit reads at most, half of them toxic if there are so many.
MAX_TRAIN = 8_000
MIN_DOCS = 3
EPOCHS = 6
_WORDS = re.compile(r"\w+").findall
_CACHE = 250_000
#: Frequent function words (fixed lists) that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with are this from have be at by not you which",
    "fr": "le la les de des et en un une du est que dans pour qui sur pas plus avec ce il au ne se",
    "de": "der die das und ist den von mit zu nicht sich auf ein dem im für eine als auch es wird bei aus",
    "es": "el la los las de que y en un por con para una del se su al lo como más pero no es",
}
OTHER = "other"


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS)
        return value


_ids = _Ids()


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of texts, one after another, and how many each text has."""
    lists = [_WORDS(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    get = _ids.__getitem__
    return np.fromiter(map(get, chain.from_iterable(lists)), np.int32, int(n.sum())), n


def _languages() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, sorted hashed function words and their weight for each language."""
    names = sorted(FUNCTION_WORDS)
    table: dict[int, np.ndarray] = {}
    for k, name in enumerate(names):
        for word in FUNCTION_WORDS[name].split():
            table.setdefault(_Ids()[word], np.zeros(len(names)))[k] = 1.0
    keys = np.array(sorted(table), np.int32)
    return names, keys, np.stack([table[int(k)] / table[int(k)].sum() for k in keys])


LANGUAGES, _LANG_KEYS, _LANG_WEIGHTS = _languages()


def guess_languages(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Index of the likeliest language of each text; len(LANGUAGES) if it has no function word."""
    out = np.full(len(n), len(LANGUAGES))
    if len(ids):
        at = np.searchsorted(_LANG_KEYS, ids).clip(max=len(_LANG_KEYS) - 1)
        hit = np.flatnonzero(_LANG_KEYS[at] == ids)
        votes = np.zeros((len(n), len(LANGUAGES)))
        np.add.at(votes, np.repeat(np.arange(len(n)), n)[hit], _LANG_WEIGHTS[at[hit]])
        some = votes.sum(1) > 0
        out[some] = votes[some].argmax(1)
    return out


@dataclass
class ToxicModel:
    """``vocabulary``: sorted hashes with an embedding of their own; row 0 of ``embed`` is for all others."""

    vocabulary: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]  # width x dim x filters
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    tables: list[list[np.ndarray]] | None = None

    def rows(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(ids), np.int64)
        at = np.searchsorted(self.vocabulary, ids).clip(max=len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == ids, at + 1, 0)

    def pooled(self, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text (at least 0), and the position where it is.

        Texts are padded by unknown words, so that each has a window of every width.
        """
        pad = max(WIDTHS) - 1
        starts = np.cumsum(n + pad) - (n + pad)
        padded = np.zeros(int((n + pad).sum()) + pad, np.int64)
        padded[np.arange(len(rows)) + np.repeat(pad * np.arange(len(n)), n)] = rows
        if self.tables is None:
            self.tables = [[(self.embed @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]
        best, where = [], []
        size = len(padded) - pad
        for table, bias in zip(self.tables, self.biases, strict=True):
            response = table[0][padded[:size]]
            for k in range(1, len(table)):
                response = response + table[k][padded[k : size + k]]
            top = np.maximum.reduceat(response, starts, axis=0) if len(n) else response
            best.append(np.maximum(top + bias, 0))
            where.append((response, top))
        self._padded, self._starts = padded, starts
        return np.concatenate(best, axis=1), where

    def logits(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(n):
            return np.zeros(0)
        return self.pooled(self.rows(ids), n)[0] @ self.out + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        ids, n = word_ids(texts)
        logit = self.logits(ids, n) - self.shift[guess_languages(ids, n)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(ids: list[np.ndarray], y: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> ToxicModel:
    """Adam on the logistic loss. Only the words at a pooled maximum get a gradient, so a step is cheap.

    Embeddings start at small random values, their first dimension at the word's smoothed log odds;
    the first filter of width 1 starts by reading that dimension.
    """
    rng = np.random.default_rng(seed)
    positive = y == 1
    seen: dict[str, np.ndarray] = {}
    uniq = [np.unique(x) for x in ids]
    flat = np.concatenate(uniq) if uniq else np.zeros(0, np.int32)
    labels = np.repeat(positive, [len(u) for u in uniq]) if uniq else np.zeros(0, bool)
    words, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    hits = np.bincount(inverse, weights=labels, minlength=len(words))
    keep = df >= MIN_DOCS
    words, df, hits = words[keep], df[keep], hits[keep]
    base = (positive.sum() + 0.5) / (len(y) + 1)
    odds = np.log((hits + base) / (df - hits + 1 - base)) - np.log(base / (1 - base))
    # A word seen in few documents says little.
    odds *= df / (df + 4.0)
    embed = rng.normal(0, 0.05, (len(words) + 1, DIM)).astype(np.float32)
    embed[0] = 0
    embed[1:, 0] = odds
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    filters[0][0, :, 0] = 0
    filters[0][0, 0, 0] = 1
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    out[0] = 1.5
    model = ToxicModel(words, embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, -3.0)
    if not positive.any() or positive.all():
        model.bias = 6.0 if len(y) and positive.all() else -6.0
        model.out[:] = 0
        return model
    rows = [model.rows(x) for x in ids]
    weight = np.where(positive, 0.5 / positive.mean(), 0.5 / (1 - positive.mean()))
    state: dict[str, list[np.ndarray]] = seen and {}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m *= 0.9
        m += 0.1 * grad
        v *= 0.999
        v += 0.001 * grad * grad
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    state = {}
    # Batches of about 60,000 words, whatever the lengths of the texts.
    for _ in range(epochs):
        order, batch, size = rng.permutation(len(y)), [], 0
        for at, k in enumerate(order):
            batch.append(k)
            size += len(rows[k])
            if size < 60_000 and len(batch) < 256 and at + 1 < len(order):
                continue
            step += 1
            n = np.array([len(rows[j]) for j in batch])
            model.tables = None
            features, responses = model.pooled(np.concatenate([rows[j] for j in batch]), n)
            logit = features @ model.out + model.bias
            error = ((1 / (1 + np.exp(-logit)) - positive[batch]) * weight[batch] / len(batch)).astype(np.float32)
            g_features = error[:, None] * model.out[None, :] * (features > 0)
            g_embed = np.zeros_like(model.embed)
            padded, starts = model._padded, model._starts
            owner = np.repeat(np.arange(len(batch)), n + max(WIDTHS) - 1)
            grads = []
            for w, (f, (response, top)) in enumerate(zip(model.filters, responses, strict=True)):
                g = g_features[:, w * FILTERS : (w + 1) * FILTERS]
                gf = np.zeros_like(f)
                for c in range(FILTERS):
                    hit = np.flatnonzero(response[:, c] == top[owner, c])
                    hit = hit[np.unique(owner[hit], return_index=True)[1]]  # the first maximum of each text
                    for j in range(len(f)):
                        words_at = padded[hit + j]
                        gf[j, :, c] = g[:, c] @ model.embed[words_at]
                        np.add.at(g_embed, words_at, g[:, c : c + 1] * f[j, :, c][None, :])
                grads.append((gf, g.sum(0)))
            adam("out", model.out, features.T.astype(np.float32) @ error + 1e-4 * model.out, 0.02)
            model.bias -= 0.5 * float(error.sum())
            g_embed[0] = 0
            adam("embed", model.embed, g_embed + 1e-6 * model.embed, 0.01)
            for w, (gf, gb) in enumerate(grads):
                adam(f"f{w}", model.filters[w], gf, 0.01)
                adam(f"b{w}", model.biases[w], gb, 0.01)
            batch, size = [], 0
            del starts
    model.tables = None
    return model


def calibrate(model: ToxicModel, ids: list[np.ndarray], y: np.ndarray) -> None:
    """Set the shift of each language to the logit that parts its labelled texts with fewest errors.

    A language with fewer than 5 texts of either kind takes the threshold of all texts.
    """
    if not len(y):
        return
    n = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    logit = np.concatenate([model.logits(x, np.array([len(x)])) for x in ids])
    language = guess_languages(flat, n)

    def cut(mask: np.ndarray) -> float:
        order = np.argsort(logit[mask], kind="stable")
        z, t = logit[mask][order], y[mask][order]
        errors = np.concatenate([[0], np.cumsum(t == 1)]) + (t == 0).sum() - np.concatenate([[0], np.cumsum(t == 0)])
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        best = np.flatnonzero(errors == errors.min())
        gaps = np.concatenate([[0], np.diff(z), [0]])
        return float(edges[best[np.argmax(gaps[best])]])

    everything = np.ones(len(y), bool)
    mixed = 0 < (y == 1).sum() < len(y)
    model.shift[:] = cut(everything) if mixed else 0.0
    for k in range(len(LANGUAGES) + 1):
        mask = language == k
        if min((y[mask] == 1).sum(), (y[mask] == 0).sum()) >= 5:
            model.shift[k] = cut(mask)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_TRAIN) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed words and labels of a bounded sample of the rows that may be learnt from.

    Only rows with crc32(doc_id as text) mod 5 other than 0; up to half of ``limit`` toxic ones, the
    rest clean, by a hash of the id. The chosen ids (``limit`` at most) are broadcast. Of several labels of
    a doc_id the larger counts, of several rows that repeat one the least in the order of its word hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    open_rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    rows = open_rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    take = {}
    for y, most in ((1, limit // 2), (0, limit)):
        for r in rows.filter(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(most).collect():
            if len(take) < limit:
                take[r.doc_id] = r.y
    chosen = spark.sparkContext.broadcast(take)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            mine = [k for k, i in enumerate(ids) if i in chosen.value]
            if mine:
                flat, n = word_ids(batch.column("text").take(pa.array(mine)).to_pylist())
                cuts = 4 * (np.cumsum(n) - n)
                raw = flat.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in mine], pa.int64()), pa.array([raw[a : a + 4 * m] for a, m in zip(cuts.tolist(), n.tolist(), strict=True)], pa.binary())], ["doc_id", "ids"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary").groupBy("doc_id").agg(F.min("ids").alias("ids")).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, bytes(r.ids)))
    return [np.frombuffer(r.ids, np.int32) for r in got], np.array([take[r.doc_id] for r in got], np.int64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicModel:
    """Train on the driver on three quarters of the bounded sample, and calibrate on the rest.

    A sample whose rest does not hold both labels is calibrated on all of it.
    """
    ids, y = training_rows(docs, labels, label)
    rest = np.arange(len(y)) % 4 == 3  # rows stand in the order of a hash of their id
    if not 0 < (y[rest] == 1).sum() < rest.sum():
        rest = np.ones(len(y), bool)
    learn = ~rest if not rest.all() else rest
    model = train([x for x, on in zip(ids, learn, strict=True) if on], y[learn])
    calibrate(model, [x for x, on in zip(ids, rest, strict=True) if on], y[rest])
    return model


def toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Add score and predicted; one pass, no shuffle. The model's size is bound by its training sample.

    Only the text is read. Null and empty texts are scored as texts without words. Columns named
    like an output are replaced, others pass through; repeated rows stay repeated.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = ["score", "predicted"]
    base = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in made])
    schema = StructType(list(base.schema.fields)).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text, 1 << 20):
            score = shared.value.scores(part.column(text).to_pylist()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*part.schema.names, *made])

    return base.mapInArrow(run, schema)
