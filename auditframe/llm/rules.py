"""Quality rules, line first.

Every line is judged by itself (symbols, shouting, navigation, boilerplate, no sentence
punctuation). Failing lines are removed; a document that loses too much of its text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from auditframe.llm.common import text_slices
from auditframe.session import ship


@dataclass(frozen=True)
class LineRules:
    """Thresholds; shares are of a line's words unless said otherwise."""

    min_words: int = 50
    max_repeat_pct: int = 50
    symbol_share: float = 0.3
    shout_share: float = 0.5
    separator_share: float = 0.15
    min_separators: int = 3
    same_word_share: float = 0.5
    unpunctuated_max_words: int = 8
    boilerplate_max_words: int = 40
    max_lost_share: float = 0.3  # of the characters in words


SYMBOLS = "#*$%&|<>"
SEPARATORS = {b"|", b">", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2", b"/", b"-", b"\xe2\x80\x93", b"\xe2\x80\x94"}
#: A line that ends like a sentence is a menu only if no entry between two separators has more words.
ENTRY_WORDS = 3
#: Fixed phrases of page furniture in English, French, German and Spanish, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "we use cookies", "accept cookies", "enable javascript", "sign up for", "subscribe to our",
    "click here", "read more", "share this", "follow us", "back to top", "skip to content",
    "log in to", "powered by", "copyright ©", "(c) copyright",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation",
    "nous utilisons des cookies", "accepter les cookies", "activer javascript", "abonnez-vous à", "cliquez ici",
    "lire la suite", "partager cet article", "suivez-nous", "retour en haut", "aller au contenu",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "wir verwenden cookies",
    "cookies akzeptieren", "javascript aktivieren", "abonnieren sie", "hier klicken", "weiterlesen",
    "artikel teilen", "folgen sie uns", "zum inhalt springen",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso",
    "utilizamos cookies", "aceptar cookies", "activar javascript", "suscríbete a", "haz clic aquí", "haga clic aquí",
    "compartir este artículo", "síguenos", "volver arriba", "saltar al contenido",
)
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))
_ENDS = tuple(".!?…:;\"'”’»)]。！？")
_STOPS = tuple(".!?…。！？")
_WS = " \t\n\r\x0b\x0c"
_SYMBOL_BYTES = SYMBOLS.encode()


def line_fault(line: str, words: list[bytes], rules: LineRules) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    symbols = sum(map(line.count, SYMBOLS))
    if not SEPARATORS.isdisjoint(words):
        separators = sum(w in SEPARATORS for w in words)
        if separators >= rules.min_separators and separators >= rules.separator_share * n and (not line.rstrip(_WS).endswith(_STOPS) or _longest_entry(words) <= ENTRY_WORDS):
            return "navigation"
    if symbols > 2 and sum(any(c in _SYMBOL_BYTES for c in w) for w in words) > rules.symbol_share * n:
        return "symbols"
    if n >= 4:
        if "!!" in line and sum(w.endswith(b"!!") for w in words) > rules.shout_share * n:
            return "shouting"
        if n >= 12 and sum(map(bytes.__eq__, words, words[1:])) > rules.same_word_share * n:
            return "repetition"
    if n <= rules.boilerplate_max_words and _BOILER.search(line.lower()):
        return "boilerplate"
    if n <= rules.unpunctuated_max_words and not line.rstrip(_WS).endswith(_ENDS):
        return "punctuation"
    return None


def _longest_entry(words: list[bytes]) -> int:
    """The most words that follow one another without a separator."""
    longest = run = 0
    for w in words:
        run = 0 if w in SEPARATORS else run + 1
        longest = max(longest, run)
    return longest


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first finding included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    v = len(number)
    if v < 2_000_000:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        _, pairs = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)
        keys = pairs.astype(np.int64) * v + ids[2:]
    ordered = np.argsort(keys, kind="stable")
    same = keys[ordered][1:] == keys[ordered][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[ordered[1:][same]] = True
    twice[ordered[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_lines_removed", "long"), ("lost_share", "double"), ("clean_text", "string")]


def judge(text: str, rules: LineRules) -> tuple:
    """All output fields of one text."""
    words = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space, as in [^\x20\x09-\x0D]+
    n = len(words)
    chars = len(text) - sum(map(text.count, _WS))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeat_words(words)
    seen: set[str] = set()
    dup = removed = lost = 0
    kept_lines = []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            kept_lines.append(line)
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fault(line, own, rules):
            removed += 1
            lost += len(line) - sum(map(line.count, _WS))
        else:
            kept_lines.append(line)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_pct * n
    share = lost / chars if chars else 0.0
    return n, chars, symbols, dup, repeats, failed, not failed and share <= rules.max_lost_share, removed, share, "\n".join(kept_lines)


def quality_rules(docs: DataFrame, rules: LineRules | None = None, text: str = "text") -> DataFrame:
    """Add the counts, verdicts and cleaned text of every row; one pass, no shuffle.

    Null and empty texts have no words: base_failed, nothing removed, clean_text empty. Input
    columns named like an output are replaced, others pass through; repeated rows stay repeated.
    """
    ship(docs.sparkSession)
    rules = rules or LineRules()
    names = [f for f, _ in FIELDS]
    keep = [docs[f"`{c}`"] for c in docs.columns if c == text or c not in names]
    base = docs.select(*keep)
    schema = StructType(list(base.schema.fields))
    for name, kind in FIELDS:
        schema = schema.add(name, kind)
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            rows = [judge(t or "", rules) for t in part.column(text).to_pylist()]
            made = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])

    return base.mapInArrow(run, schema)
