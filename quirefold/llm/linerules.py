"""Quality rules, line first: rules judge each line, failing lines are removed, and documents that lose too much go.

A line of words fails by the first of these that holds:

- ``navigation``: it has two or more separators (words such as ``|``) that make up an eighth of its words or more, or two or
  more words of menus that make up half of its words or more.
- ``boilerplate``: it has at least one phrase of notices for every ``PHRASE_WORDS`` words.
- ``punctuation``: over a quarter of its words end in two or more marks that close no sentence, or more than half of its
  words stand after the last word that closes a sentence.

A document is rejected by the base rules (too few words, or too many words in repeated windows of three), or if its
failing lines hold more than ``MAX_LOST`` of 100 of its words. Everything is counted over whole texts in Arrow batches;
a text is taken apart within its row, so nothing is shuffled and memory grows with the longest text only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import LOWER, pieces, spread, utf8

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_LOST = 20
PHRASE_WORDS = 20
WINDOW = 3
RULES = ["navigation", "boilerplate", "punctuation"]

SEPARATORS = ["|", "||", "»", "«", "›", ">", ">>", "·", "•", "/", "::", "~", "→"]
MENU_WORDS = [
    "home", "menu", "login", "logout", "register", "search", "contact", "about", "sitemap", "share", "tweet", "next", "previous",
    "startseite", "anmelden", "suche", "kontakt", "impressum", "accueil", "connexion", "rechercher", "inicio", "buscar", "contacto",
]
PHRASES = [
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "use of cookies", "uses cookies",
    "use cookies", "accept cookies", "enable javascript", "javascript is disabled", "skip to content", "back to top", "click here",
    "read more", "sign up for our newsletter", "subscribe to our newsletter", "share this", "log in to", "powered by", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "nutzungsbedingungen", "mehr lesen", "nach oben",
    "tous droits réservés", "politique de confidentialité", "utilise des cookies", "conditions d'utilisation", "lire la suite",
    "todos los derechos reservados", "política de privacidad", "utiliza cookies", "términos de uso", "leer más",
]
BLANK = r"[ \t-\r]"
#: A word that closes a sentence ends in one of these, and then quotes or brackets.
CLOSING = r"(?:[.!?:;]|…|。|！|？)(?:[\"')\]}]|»|”|’|“)*"
NOISY = r"[!?#$%&*@~=+<>^_|\\]{2,}"
MENU_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_closes = re.compile(CLOSING.encode() + rb"\Z")
_noisy = re.compile((NOISY + rf"(?={BLANK}|\Z)").encode())
_menu_word = re.compile(rb"[0-9a-z\x80-\xff]+")
_separators, _menu = ({x.encode() for x in xs} for xs in (SEPARATORS, MENU_WORDS))
_phrases = [x.encode() for x in PHRASES]
_SYMBOLS = list(b"#*$%&|<>")
_LEADS = [b for b in range(256) if not 0x80 <= b < 0xC0 and b not in b" \t\n\r\x0b\f"]


def failing_rule(line: bytes, words: list[bytes], low: bytes, phrases: list[bytes]) -> int | None:
    """Number of the first rule in ``RULES`` that a line fails, or None. ``low`` is the line in lower case, ``phrases`` those its text has."""
    n = len(words)
    separators = sum(w in _separators for w in words) if n > 1 else 0
    if separators > 1 and separators * 8 >= n:
        return 0
    menu = sum(w in _menu for w in _menu_word.findall(low))
    if menu > 1 and menu * 2 >= n:
        return 0
    if phrases and sum(p in low for p in phrases) * PHRASE_WORDS >= n and any(p in low for p in phrases):
        return 1
    if len(_noisy.findall(line)) * 4 > n:
        return 2
    tail = 0
    for word in reversed(words):
        if _closes.search(word):
            break
        tail += 1
    return 2 if tail * 2 > n else None


@dataclass
class Judgement:
    """What the rules found in one text; ``text`` has the lines that passed, blank ones included."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    lost_words: int = 0
    failed: list[int] = field(default_factory=lambda: [0] * len(RULES))
    text: bytes = b""

    def base_failed(self, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> bool:
        return self.n_words < min_words or 100 * self.n_repeat_words > max_repeated * self.n_words


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more."""
    windows = list(zip(*(words[k:] for k in range(size))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    count, end = 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            count += at + size - max(end, at)
            end = at + size
    return count


def judge(text: bytes | None) -> Judgement:
    """All rules on one whole text; null is taken as empty."""
    text = text or b""
    found = Judgement()
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    found.word_chars, found.n_symbols = int(histogram[_LEADS].sum()), int(histogram[_SYMBOLS].sum())
    low = text.translate(LOWER)
    phrases = [p for p in _phrases if p in low]
    kept, words, seen = [], [], set()
    for line, low_line in zip(text.split(b"\n"), low.split(b"\n")):
        own = line.split()
        if not own:
            kept.append(line)
            continue
        words += own
        found.n_dup_lines += line in seen
        seen.add(line)
        rule = failing_rule(line, own, low_line, phrases)
        if rule is None:
            kept.append(line)
        else:
            found.failed[rule] += 1
            found.lost_words += len(own)
    found.n_words, found.n_repeat_words = len(words), repeated_words(words)
    found.text = b"\n".join(kept)
    return found


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _kept(found: Judgement, max_lost: int) -> bool:
    return not found.base_failed() and 100 * found.lost_words <= max_lost * found.n_words


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """``(doc_id, <COUNTS>, base_failed, kept, lost_words, n_<rule> lines for each rule)`` of every row.

    A null or empty text has no words and fails the base rules. Repeated rows and null ids are judged like any other, very long
    texts as a whole, an empty table gives no rows, and further columns are not read, whatever their names.
    """
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    names = ["doc_id", *COUNTS, "base_failed", "kept", "lost_words", *(f"n_{r}" for r in RULES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [judge(t) for t in utf8(batch.column(1))]
            columns = [pa.array([getattr(x, c) for x in found], pa.int64()) for c in COUNTS]
            columns += [pa.array([x.base_failed() for x in found]), pa.array([_kept(x, max_lost) for x in found])]
            columns += [pa.array([x.lost_words for x in found], pa.int64())]
            columns += [pa.array([x.failed[k] for x in found], pa.int64()) for k in range(len(RULES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = rows.select("doc_id").schema
    for name in names[1:]:
        schema = schema.add(name, "boolean" if name in ("base_failed", "kept") else "long")
    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, text_col: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """The rows that are kept, with their failing lines removed from ``text_col`` and all other columns as they are.

    Null and empty texts go (base rules). Repeated rows stay repeated; columns may have any names.
    """
    rows = spread(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [judge(t) for t in utf8(batch.column(at))]
            good = [_kept(x, max_lost) for x in found]
            texts = pa.array([x.text for x in found], pa.binary()).cast(pa.string())
            columns = [texts if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
