"""Line-first quality rules.

Each line with a word is judged by itself. It fails if

* punctuation: its last word ends with no terminal mark, or ``SYMBOL_SHARE`` percent of its words
  end with two symbols;
* navigation: it holds ``SEPARATORS`` or more separator words that are ``SEPARATOR_SHARE`` percent
  of its words, or its words are a phrase of menus;
* boilerplate: it holds a phrase of notices.

Failing lines are removed; a document that loses more than ``MAX_LOST`` percent of its word
characters is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEATED = 30
TERMINAL = ".!?:;\"')]»”…。！？"
TAIL_SYMBOLS = b"#*$%&!|<>"
SYMBOL_SHARE = 30
SEPARATOR_WORDS = ("|", "»", ">", "•", "·", "/")
SEPARATORS, SEPARATOR_SHARE = 2, 20
#: Phrases of menus and of notices in the languages of the corpus; only A-Z are lower-cased.
MENU = (
    "home", "menu", "main menu", "login", "log in", "sign in", "sign up", "register", "search",
    "next", "previous", "next page", "previous page", "read more", "click here", "share", "share this",
    "back to top", "skip to content", "skip to main content", "contact us", "about us", "site map",
    "startseite", "hauptmenü", "anmelden", "registrieren", "suche", "weiter", "zurück", "weiterlesen",
    "mehr lesen", "teilen", "nach oben", "zum inhalt springen", "kontakt", "über uns", "impressum",
    "accueil", "menu principal", "connexion", "se connecter", "s'inscrire", "recherche", "suivant",
    "lire la suite", "partager", "haut de page", "aller au contenu", "contactez-nous", "plan du site",
    "inicio", "menú principal", "iniciar sesión", "registrarse", "buscar", "siguiente", "anterior",
    "leer más", "compartir", "volver arriba", "saltar al contenido", "contacto", "mapa del sitio",
)
BOILERPLATE = (
    "all rights reserved", "licensed under the", "privacy policy", "terms of use", "terms of service",
    "cookie policy", "we use cookies", "this site uses cookies", "enable javascript", "javascript is disabled",
    "subscribe to our newsletter", "lorem ipsum", "powered by wordpress",
    "alle rechte vorbehalten", "lizenziert unter", "wir verwenden cookies", "bitte aktivieren sie javascript",
    "unseren newsletter abonnieren", "allgemeine geschäftsbedingungen",
    "tous droits réservés", "sous licence", "nous utilisons des cookies", "politique de confidentialité",
    "veuillez activer javascript", "conditions générales d'utilisation",
    "todos los derechos reservados", "bajo la licencia", "utilizamos cookies", "política de privacidad",
    "habilite javascript", "términos y condiciones",
)
MAX_LOST = 50


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _TAIL = _flags(SYMBOLS), _flags(TAIL_SYMBOLS)


def _phrases(phrases: tuple[str, ...]) -> np.ndarray:
    raw = [p.encode() for p in phrases]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    words = text.Words(text.Text(np.frombuffer(b"".join(raw), np.uint8), off))
    sums = text.prefix_sums(words.hash, "word")
    return text.spans(sums, words.first[:-1], words.first[1:], "word")


_MENU = _phrases(MENU)
_SEPARATOR = _phrases(SEPARATOR_WORDS)


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _ends(t: text.Text, start: np.ndarray, end: np.ndarray, marks: str) -> np.ndarray:
    """Whether the spans end with one of ``marks``."""
    out = np.zeros(len(end), bool)
    for size in {len(m.encode()) for m in marks}:
        long = np.flatnonzero(end - start >= size)
        tail = np.zeros(len(long), np.int64)
        for k in range(size):
            tail = tail * 256 + t.buf[end[long] - size + k]
        out[long] |= np.isin(tail, [int.from_bytes(m.encode(), "big") for m in marks if len(m.encode()) == size])
    return out


class Judged:
    """All that the rules need of a chunk; ``line_*`` are by line with a word, the rest by row."""

    def __init__(self, t: text.Text):
        words = text.Words(t)
        start, end = t.bounds(t.buf != 10)
        line = np.searchsorted(start, words.start, "right") - 1  # of each word
        n_line = np.bincount(line, minlength=len(start))
        keep = n_line > 0
        to = np.cumsum(keep) - 1
        self.start, self.end, line = start[keep], end[keep], to[line]
        lines = len(self.start)
        head = np.searchsorted(line, np.arange(lines + 1))  # first word of each line
        self.row = words.row[head[:-1]]
        self.first = np.searchsorted(self.row, np.arange(t.rows + 1))
        point = ~text.SPACE[t.buf] & ~text.CONTINUATION[t.buf]
        points = np.zeros(len(t.buf) + 1, np.int64)
        np.cumsum(point, out=points[1:])
        self.n_words = words.count.astype(np.int64)
        self.word_chars = points[t.off[1:]] - points[t.off[:-1]]
        self.n_symbols = t.per_row(_SYMBOL[t.buf])

        # lines equal to an earlier one
        name = text.mix(t.hashes(self.start, self.end) ^ text.mix(self.row.astype(np.uint64)))
        _, first = np.unique(name, return_index=True)
        again = np.ones(lines, np.int64)
        again[first] = 0
        self.n_dup_lines = _sum(again, self.first)

        # words in windows found twice or more
        at, window = words.windows(REPEAT_WINDOW)
        window = text.mix(window ^ text.mix(words.row[at].astype(np.uint64)))
        order = np.argsort(window, kind="stable")
        same = np.zeros(len(order), bool)
        equal = window[order[1:]] == window[order[:-1]]
        same[1:] |= equal
        same[:-1] |= equal
        hit = at[order[same]]
        edge = np.bincount(hit, minlength=len(words.row) + 1) - np.bincount(hit + REPEAT_WINDOW, minlength=len(words.row) + 1)
        self.n_repeat_words = _sum(np.cumsum(edge)[:-1] > 0, words.first)

        # rules by line
        last = head[1:] - 1
        open_end = ~_ends(t, words.start[last], words.end[last], TERMINAL)
        long = words.end - words.start >= 2
        tail = np.zeros(len(words.row), bool)
        tail[long] = _TAIL[t.buf[words.end[long] - 1]] & _TAIL[t.buf[words.end[long] - 2]]
        count = np.diff(head)
        self.punctuation = open_end | (100 * _sum(tail, head) >= SYMBOL_SHARE * count)
        lower = t.lower()
        sums = text.prefix_sums(lower.hashes(words.start, words.end), "word")
        single = text.spans(sums, np.arange(len(words.row)), np.arange(1, len(words.row) + 1), "word")
        separators = _sum(np.isin(single, _SEPARATOR), head)
        menu = np.isin(text.spans(sums, head[:-1], head[1:], "word"), _MENU)
        self.navigation = (separators >= SEPARATORS) & (100 * separators >= SEPARATOR_SHARE * count) | menu
        self.boilerplate = np.zeros(lines, bool)
        raw = lower.buf.tobytes()
        for phrase in BOILERPLATE:
            phrase, pos = phrase.encode(), raw.find(phrase.encode())
            while pos >= 0:
                k = int(np.searchsorted(self.start, pos, "right")) - 1
                if k >= 0 and pos + len(phrase) <= self.end[k]:
                    self.boilerplate[k] = True
                pos = raw.find(phrase, pos + 1)
        self.failed = self.punctuation | self.navigation | self.boilerplate
        chars = points[self.end] - points[self.start]
        self.lost_chars = _sum(chars * self.failed, self.first)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, the text lost by line rules and the verdict.

    Columns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_chars, n_failed_lines, kept`` and ``clean_text``, the lines that passed joined by
    newlines. Null text is empty, with a null ``clean_text``; it fails the base. Null ids and
    repeated rows are judged as any other; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in text.chunks(batches):
            j = Judged(t)
            base = (j.n_words < MIN_WORDS) | (100 * j.n_repeat_words > MAX_REPEATED * j.n_words)
            kept = ~base & (100 * j.lost_chars <= MAX_LOST * j.word_chars)
            raw, old = t.buf.tobytes(), batch.column("text")
            clean = []
            for r in range(t.rows):
                lines = np.arange(j.first[r], j.first[r + 1])
                if j.failed[lines].any():
                    clean.append(b"\n".join(raw[j.start[k] : j.end[k]] for k in lines[~j.failed[lines]]).decode())
                else:
                    clean.append(old[r].as_py())
            counts = [j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(base), pa.array(j.lost_chars), pa.array(_sum(j.failed, j.first)), pa.array(kept), pa.array(clean, pa.string())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "n_failed_lines", "kept", "clean_text"],
            )

    common.arrow_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_chars long, n_failed_lines long, kept boolean, clean_text string",
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("clean_text")


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
), f AS (
  SELECT doc_id, i, line, len(array_to_string(ws, '')) AS chars,
    NOT regexp_matches(ws[-1], '[.!?:;"'')\]»”…。！？]$')
    OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&!|<>][#*$%&!|<>]$'))) >= {SYMBOL_SHARE} * len(ws)
    OR (len(list_filter(ws, lambda x: x IN ({_list(SEPARATOR_WORDS)}))) >= {SEPARATORS}
        AND 100 * len(list_filter(ws, lambda x: x IN ({_list(SEPARATOR_WORDS)}))) >= {SEPARATOR_SHARE} * len(ws))
    OR translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_list(MENU)})
    OR {" OR ".join(f"contains(low, {_list([p])})" for p in BOILERPLATE)} AS failed
  FROM l WHERE len(ws) > 0
), t AS (
  SELECT doc_id, sum(CASE WHEN failed THEN chars ELSE 0 END) AS lost_chars, count(*) FILTER (failed) AS n_failed_lines,
    count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS k FROM p
), r AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM h WHERE k > 1) GROUP BY doc_id
), b AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines
  FROM d LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept
FROM b
"""
