"""Cross-entropy difference of two matched language models.

A target and a background model share words, word classes, order and smoothing. They are word bigram
models over all words of the corpus, smoothed by a class bigram model ``base(w | v) = p(class w | class v)
p(w | class w)``. The most frequent words are classes of their own, between which class bigrams are word
bigrams; other words of the vocabulary share classes by hash, and the rest, the rare words, is one class,
within which each has its own count. With ``c`` the counts of words and pairs,

- ``p(w | v) = (c(v, w) + PRIOR base(w | v)) / (c(v) + PRIOR)`` after a word ``v`` without a class of its own
  (``c(v)`` counts a text's last word too, which leaves that share to the end of the text), else
- ``p(w | v) = p(class w | v) (c(v, w) + PRIOR p(w | class w)) / (c(v, class w) + PRIOR)``.

Classes and the vocabulary's counts are of fixed size and held by every worker. The pairs and the rare
words, which grow with the corpus, are counted and asked for in buckets of their hashes: a pair with a
rare second word goes to that word's bucket, so a loss is a sum of what one bucket each knows, and a
document's sums are added up over the buckets. Background counts are scaled to the target's number of
tokens, so that smoothing weighs equally in both. A document's score is the mean over its tokens of the
target's loss less the background's, in nats: the lower, the more like the target.

All counts are taken over all rows; words and pairs are told apart by 64-bit hashes. Background counts
come from the texts where they lie. Only the target's texts move, to be counted apart: a filter of checked
size lets few others through to the exact join. A pair that fills a part of what a task holds is sent as
one count and answered by one loss, while its places stay with the task's documents, so no bucket gets a
hot pair's occurrences.

Awkward cases. A null or empty text has no tokens, zero losses and a zero score. Null ids are scored as
any other and are never of the target; an id that the target names several times counts once; rows that
share an id are all of the target. Without target rows, its model is that of its smoothing alone. Ties
between equally frequent words at the vocabulary's end go to the smaller hash. Texts of any length are
read whole. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text

#: Words of the vocabulary at most, classes, and classes of one word.
VOCABULARY = 1 << 16
CLASSES, SINGLE = 1024, 1000
UNKNOWN, START = CLASSES - 2, CLASSES - 1
#: Weight of the class unigrams in the bigrams, and count added to each class and word.
PRIOR, ADDED = 64.0, 0.5
#: Distinct words that a task counts before it passes them on.
TASK_WORDS = 1_500_000
#: Tokens that a task holds before it sends them to the buckets, tokens of a bucket and of a task's buckets
#: at most on average, and the least numbers of buckets and tasks.
HELD_TOKENS, BUCKET_TOKENS, PART_TOKENS = 2_000_000, 4_000_000, 4_000_000
BUCKETS, PARTS = 512, 64
#: Documents that a task of buckets sums for before it passes the sums on.
HELD_SUMS = 2_000_000
#: Occurrences among the held tokens from which a pair is sent as a count.
HOT = 512
#: Ranges that tables of class counts are added up in.
RANGES = 16


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: hash and count of each lower-cased word of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = merged()
            for lo in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000].view(np.int64)), pa.array(n[lo : lo + 100_000])], ["word", "n"])

        for _, t in text.chunks(batches):
            held.append(np.unique(text.Words(t.lower()).hash, return_counts=True))
            size += len(held[-1][0])
            if size > TASK_WORDS:
                held = [merged()]
                size = len(held[0][0])
                if size > TASK_WORDS // 2:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()
        held = []
        text.give_back()

    return docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Words by hash, ascending, with their class and place; the last place is the unknown word's."""

    def __init__(self, words: np.ndarray):
        """``words``: hashes, most frequent first."""
        self.words, order = np.sort(words), np.argsort(words)
        shared = SINGLE + (text.mix(words) % np.uint64(UNKNOWN - SINGLE)).astype(np.int64)
        classes = np.where(np.arange(len(words)) < SINGLE, np.arange(len(words)), shared)
        self.classes = np.append(classes[order], UNKNOWN)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        return np.where(known, at, len(self.words))

    def read(self, t: text.Text) -> tuple[text.Words, np.ndarray, np.ndarray]:
        """Words of a chunk, their places, and the number ``before * CLASSES + own class`` of each."""
        words = text.Words(t.lower())
        place = self.places(words.hash)
        own = self.classes[place]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        heads = words.first[:-1]
        before[heads[words.count > 0]] = START
        return words, place, before * CLASSES + own


class Pair:
    """Losses of both models: by pair of classes, and by word within its class."""

    def __init__(self, vocabulary: Vocabulary, pairs: np.ndarray, words: np.ndarray, rare: int = 0, corpus: DataFrame | None = None, target: DataFrame | None = None):
        """``pairs``: (2, CLASSES**2) and ``words``: (2, places) counts of target and background.

        ``rare`` distinct words are outside the vocabulary; ``corpus`` and ``target`` have the texts.
        """
        pairs, words = pairs.astype(np.float64), words.astype(np.float64)
        total = words.sum(1)
        self.corpus, self.target, self.tokens = corpus, target, int(total[1])
        self.scale = np.array([1.0, total[0] / total[1] if total[0] and total[1] else 1.0])
        if total[0] and total[1]:
            pairs[1] *= total[0] / total[1]
            words[1] *= total[0] / total[1]
        size = np.bincount(vocabulary.classes, minlength=CLASSES)
        self.pairs, self.words = np.empty((2, CLASSES * CLASSES), np.float32), np.empty(words.shape, np.float32)
        for k in (0, 1):
            by_class = np.bincount(vocabulary.classes, words[k], CLASSES)
            single = (by_class + ADDED) / (by_class.sum() + ADDED * CLASSES)
            table = pairs[k].reshape(CLASSES, CLASSES)
            chance = (table + PRIOR * single) / (table.sum(1, keepdims=True) + PRIOR)
            self.pairs[k] = -np.log(chance).ravel()
            c = vocabulary.classes
            self.words[k] = -np.log((words[k] + ADDED) / (by_class[c] + ADDED * size[c]))
        # the rare words and one that no text has
        self.rare = words[:, -1] + ADDED * (rare + 1)
        self.after_class = np.log(pairs + PRIOR).astype(np.float32)
        self.after_word = np.log(words + PRIOR).astype(np.float32)

    def __getstate__(self):
        return self.__dict__ | {"corpus": None, "target": None}


def train(docs: DataFrame, target: DataFrame, *, vocabulary: int = VOCABULARY) -> tuple[Vocabulary, Pair]:
    """Both models; the target's texts are those of ``docs`` whose id is in ``target.doc_id``."""
    common.arrow_ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_words = common.cut(word_counts(docs.select("text")))
    top = all_words.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    vocab = Vocabulary(top.column("word").to_numpy().view(np.uint64))
    # only the target's texts move; the join is the same at every size
    wanted = common.cut(target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    of_target = common.may_be_among(docs, "doc_id", wanted).join(wanted.hint("merge"), "doc_id", "left_semi")
    of_target = common.cut(of_target.select("doc_id", "text"))
    both = np.stack([_class_counts(d, vocab) for d in (of_target, docs)])
    rare = all_words.count() - len(vocab.words)
    # lets Spark delete the shuffle files of the counts, which nothing reads again
    docs.sparkSession._jvm.java.lang.System.gc()
    return vocab, Pair(vocab, both[:, : CLASSES * CLASSES], both[:, CLASSES * CLASSES :], rare, docs, of_target)


def _class_counts(docs: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Counts of all pairs of classes, then of all places of the vocabulary; each task sends a table's ranges."""
    # VOCABULARY hashes at most
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    cells = CLASSES * CLASSES + len(vocab.classes)
    width = -(-cells // RANGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        table = np.zeros(RANGES * width, np.int64)
        for _, t in text.chunks(batches):
            _, place, pair = v.read(t)
            table[: CLASSES * CLASSES] += np.bincount(pair, minlength=CLASSES * CLASSES)
            table[CLASSES * CLASSES : cells] += np.bincount(place, minlength=len(v.classes))
        # every RANGES-th cell, so that the commonest classes are in all ranges
        yield from _packed({k: table[k::RANGES] for k in range(RANGES)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, steps, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.int64)
                tables.setdefault(k, np.zeros(width, np.int64))[at] += np.frombuffer(n, np.int64)
        yield from _packed(tables)

    schema = "range int, steps binary, n binary"
    # RANGES rows of at most `width` counts
    found = docs.select("text").mapInArrow(count, schema).repartition(RANGES, "range").mapInArrow(add, schema).toArrow()
    out = np.zeros((width, RANGES), np.int64)
    for k, steps, n in zip(*(found.column(c).to_pylist() for c in ("range", "steps", "n")), strict=True):
        out[np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.int64), k] = np.frombuffer(n, np.int64)
    return out.ravel()[:cells]


def _packed(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The counts that aren't zero, range by range, with the steps between their places."""
    rows = []
    for k, part in tables.items():
        at = np.flatnonzero(part)
        if len(at):
            rows.append((k, np.diff(at, prepend=0).astype(np.uint32).tobytes(), part[at].tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "steps", "n"])


#: What goes to the buckets, by kind, with ``v`` before ``w``; words of the vocabulary go by place, rare ones by hash.
#: 0: a flush's documents, 1: known v, rare w, 2: rare v or the start (0), rare w, 3: rare v, known w, 4: known v and w,
#: 5: the start, known w, 6: rare v of a rare w. a: hash that the bucket is of, b: the other word or both, q: sums, who: steps of
#: row * 4 + flags (1: counts for the target, 2: for the background). With AGGREGATED added, ``who`` holds count * 4 + flags of
#: distinct keys instead; a flush that isn't negative wants the loss of each. LISTS: a flush's hot pairs (a), how often each
#: occurs (b) and in which rows (who). LOSSES: keys (a) and their losses (q).
AGGREGATED, LISTS, LOSSES = 10, 8, 9
_SENT = "bucket int, flush long, kind int, a binary, b binary, q binary, who binary"


def _place_type(v: Vocabulary) -> type:
    return np.uint16 if len(v.words) <= 1 << 16 else np.uint32


def _key(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What tells pairs (kind 6: words) of one kind apart; ``b`` has two columns if the kind is 4."""
    if kind == 4:
        return b[:, 0].astype(np.uint64) << np.uint64(32) | b[:, 1].astype(np.uint64)
    if kind == 5:
        return b.astype(np.uint64) | np.uint64(1 << 63)
    if kind == 6:
        return a
    return text.mix(a * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


def _sent(docs: DataFrame, held, buckets: int, asks: bool, flags: int) -> DataFrame:
    """Tokens of ``doc_id, text`` by bucket; ``asks``: their documents are to be scored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = held.value
        flush = TaskContext.get().partitionId() << 24
        kept: dict[int, list[tuple[np.ndarray, ...]]] = {k: [] for k in range(1, 7)}
        ids, sums, rows, tokens = [], [], 0, 0

        def row(bucket: int, kind: int, *data: bytes) -> tuple:
            return (bucket, flush if asks else -1, kind, *data)

        def dealt(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, who: np.ndarray) -> Iterator[tuple]:
            bucket = (text.mix(key if kind % AGGREGATED in (4, 5) else a) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            a, b, who = (x[order] if len(x) else x for x in (a, b, who))
            for k in np.flatnonzero(np.diff(bounds)):
                at = slice(bounds[k], bounds[k + 1])
                steps = who[at] if kind > AGGREGATED else np.diff(who[at], prepend=np.uint32(0))
                steps = steps.astype(np.uint16) if steps.max() < 1 << 16 else steps
                yield row(int(k), kind, a[at].tobytes(), b[at].tobytes(), b"", steps.tobytes())

        def out() -> Iterator[pa.RecordBatch]:
            made, hot = [], []
            for kind, parts in kept.items():
                if not parts:
                    continue
                a, b, who = (np.concatenate(x) for x in zip(*parts, strict=True))
                parts.clear()
                key = _key(kind, a, b)
                if asks and kind not in (4, 5):  # a rare word isn't hot
                    made.extend(dealt(kind, key, a, b, who))
                else:
                    distinct, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    often = np.flatnonzero(n >= (HOT if asks else 1))
                    if len(often):
                        count = (n[often] * 4 + flags).astype(np.uint32)
                        made.extend(dealt(kind + AGGREGATED, distinct[often], a[first[often]] if len(a) else a, b[first[often]], count))
                    if asks:
                        is_hot = (n >= HOT)[back]
                        rest = ~is_hot
                        made.extend(dealt(kind, key[rest], a, b[rest], who[rest]) if rest.any() else ())
                        at = np.flatnonzero(is_hot)
                        at = at[np.argsort(back[at], kind="stable")]
                        if len(at):
                            hot.append((distinct[often], n[often], who[at] >> 2))
                while len(made) >= 200:
                    yield _batch(made[:200])
                    made = made[200:]
            if asks:
                home = int(text.mix(np.array([flush], np.uint64))[0] % np.uint64(buckets))
                made.append(row(home, 0, b"".join(i.tobytes() for i, _, _ in ids), b"".join(g.tobytes() for _, g, _ in ids), b"".join(x.tobytes() for x in sums), b"".join(n.tobytes() for _, _, n in ids)))
                for keys, n, who in hot:
                    made.append(row(home, LISTS, keys.tobytes(), n.astype(np.int64).tobytes(), b"", who.astype(np.uint32).tobytes()))
            if made:
                yield _batch(made)

        none, small = np.zeros(0, np.uint64), _place_type(v)
        for batch, t in text.chunks(batches):
            words, place, pair = v.read(t)
            h, n = words.hash, len(place)
            own, before = v.classes[place], pair // CLASSES
            exact = (before < SINGLE) | (before == START)
            rare, asked = place == len(v.words), ~(exact & (own < SINGLE))
            first = before == START
            earlier = np.zeros(n, np.int64)
            earlier[1:] = place[:-1]
            earlier_hash = np.zeros(n, np.uint64)
            earlier_hash[1:] = h[:-1]
            earlier_hash[first] = 0
            rare_before = ~first & (earlier == len(v.words))
            if asks:
                known = np.where(asked, 0, m.words[:, place])
                local = np.where(exact, m.pairs[:, pair] + np.where(asked, m.after_class[:, pair], 0) + known, np.where(rare_before, 0, m.after_word[:, earlier]))
                total = np.zeros((2, n + 1))
                np.cumsum(local, axis=1, dtype=np.float64, out=total[:, 1:])
                ids.append((text.integers(batch.column("doc_id"), 0), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False), words.count.astype(np.int64)))
                sums.append((total[:, words.first[1:]] - total[:, words.first[:-1]]).T.copy())
            who = ((words.row + rows) * 4).astype(np.uint32) + np.uint32(flags)
            known_before = ~first & ~rare_before
            picks = (rare & known_before, rare & ~known_before, asked & ~rare & rare_before, asked & ~rare & known_before, asked & ~rare & first, rare & rare_before & asks)
            for kind, pick in enumerate(picks, 1):
                at = np.flatnonzero(pick)
                if not len(at):
                    continue
                hashes = h[at] if kind < 3 else earlier_hash[at] if kind in (3, 6) else none
                if kind in (2, 6):
                    other = earlier_hash[at] if kind == 2 else none
                elif kind == 4:
                    other = np.stack([earlier[at], place[at]], axis=1).astype(small)
                else:
                    other = (earlier if kind == 1 else place)[at].astype(small)
                kept[kind].append((hashes, other, who[at]))
            rows += t.rows
            tokens += n
            # documents without words count as some, so that a flush's rows are bounded
            if tokens + rows > HELD_TOKENS:
                yield from out()
                flush, rows, tokens = flush + 1, 0, 0
                ids.clear()
                sums.clear()
        if rows:
            yield from out()
        ids.clear()
        sums.clear()
        text.give_back()

    return docs.mapInArrow(work, _SENT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "flush", "kind", "a", "b", "q", "who"])


def _counted(keys: np.ndarray, flags: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each key among them, and (2, distinct) counts of target and background."""
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, back, np.stack([np.bincount(back, weight * ((flags & bit) > 0), len(distinct)) for bit in (1, 2)])


def _read(v: Vocabulary, parts: dict[int, list[tuple]], kind: int) -> tuple[np.ndarray, ...] | None:
    """a, b, who, flush and whether ``who`` holds counts, of all that a bucket has of a kind."""
    small, found = np.dtype(_place_type(v)), []
    for plus in (0, AGGREGATED):
        for flush, a, b, _, who in parts[kind + plus]:
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64 if kind in (2, 6) else small)
            b = b.reshape(-1, 2) if kind == 4 else b
            n = len(b) if kind in (4, 5) else len(a)
            who = np.frombuffer(who, np.uint16 if len(who) == 2 * n else np.uint32).astype(np.uint32)
            found.append((a, b, who if plus else np.cumsum(who, dtype=np.uint32), np.full(n, flush), np.full(n, plus > 0)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else None


def _answers(v: Vocabulary, m: Pair, parts: dict[int, list[tuple]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Flush, row or key, both losses of what a bucket was asked, and which of these go by key."""
    scale, end = m.scale[:, None], len(v.words)
    asked = {k: x for k in range(1, 7) if (x := _read(v, parts, k)) is not None}
    weigh = lambda who, many: np.where(many, who >> 2, 1)
    here = [asked[k] for k in (1, 2) if k in asked]
    if here:
        a, who, many = (np.concatenate([x[i] for x in here]) for i in (0, 2, 4))
        words, _, n_words = _counted(a, who, weigh(who, many))
    else:
        words, n_words = np.zeros(0, np.uint64), np.zeros((2, 0))

    def count_of(hashes: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros((2, len(hashes)))
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        return np.where(words[at] == hashes, n_words[:, at], 0) * scale

    for kind, (a, b, who, flush, many) in asked.items():
        key = _key(kind, a, b)
        if kind == 6:
            yield flush, who >> 2, key, np.log(count_of(a) + PRIOR), many
            continue
        own = b.astype(np.int64) if kind in (3, 5) else b[:, 1].astype(np.int64) if kind == 4 else np.full(len(a), end)
        if kind in (1, 4):
            before = v.classes[(b if kind == 1 else b[:, 0]).astype(np.int64)]
        elif kind == 2:
            before = np.where(b == 0, START, UNKNOWN)
        else:
            before = np.full(len(own), START if kind == 5 else UNKNOWN)
        exact = (before < SINGLE) | (before == START)
        share = np.exp(-(np.where(exact, 0, m.pairs[:, before * CLASSES + v.classes[own]]) + m.words[:, own]).astype(np.float64))
        if kind < 3:
            share *= (count_of(a) + ADDED) / np.maximum(m.rare, ADDED)[:, None]
        _, back, n = _counted(key, who, weigh(who, many))
        loss = -np.log(n[:, back] * scale + PRIOR * share)
        yield flush, who >> 2, key, loss + np.log(count_of(a) + PRIOR) if kind == 3 else loss, many


def score(docs: DataFrame, vocabulary: Vocabulary, models: Pair) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of each document.

    Losses are means over the tokens; a text without words, null or empty, has 0 tokens and zeros.
    Null ids and repeated rows are scored as any other; other columns are ignored.
    """
    spark = docs.sparkSession
    common.arrow_ready(spark)
    # fixed size: 4 * CLASSES**2 + 6 * VOCABULARY numbers
    held = spark.sparkContext.broadcast((vocabulary, models))
    buckets = max(BUCKETS, -(-models.tokens // BUCKET_TOKENS))
    parts = max(PARTS, -(-models.tokens // PART_TOKENS))
    sent = _sent(models.target, held, buckets, False, 1)
    if docs is models.corpus:
        sent = sent.union(_sent(docs, held, buckets, True, 2))
    else:
        asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        sent = sent.union(_sent(asked, held, buckets, True, 0)).union(_sent(models.corpus, held, buckets, False, 2))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = held.value
        sums: dict[int, np.ndarray] = {}
        mine: dict[int, list[tuple]] = {k + plus: [] for plus in (0, AGGREGATED) for k in range(1, 7)}
        at_bucket, by_key = None, []

        def add() -> None:
            for flush, row, key, loss, many in _answers(v, m, mine):
                for f in np.unique(flush[flush >= 0]):
                    pick = (flush == f) & ~many
                    if pick.any():
                        r = row[pick]
                        size = int(r.max()) + 1
                        have = sums.get(f, np.zeros((2, 0)))
                        new = np.zeros((2, max(size, have.shape[1])))
                        new[:, : have.shape[1]] = have
                        for k in (0, 1):
                            new[k] += np.bincount(r, loss[k][pick], new.shape[1])
                        sums[f] = new
                    pick = (flush == f) & many
                    if pick.any():
                        by_key.append((0, int(f), LOSSES, key[pick].tobytes(), b"", loss[:, pick].T.astype(np.float32).tobytes(), b""))
            for p in mine.values():
                p.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for f, s in sums.items():
                row = np.flatnonzero(s.any(axis=0))
                yield _batch([(0, int(f), 4, b"", b"", s[:, row].T.astype(np.float32).tobytes(), row.astype(np.uint32).tobytes())])
            sums.clear()
            if by_key:
                yield _batch(by_key)
                by_key.clear()

        for batch in batches:
            for bucket, flush, kind, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at_bucket:
                    add()
                    at_bucket = bucket
                    if sum(s.shape[1] for s in sums.values()) > HELD_SUMS:
                        yield from out()
                if kind in mine:
                    mine[kind].append((flush, *data))
                else:
                    yield _batch([(bucket, flush, kind, *data)])
        add()
        yield from out()
        text.give_back()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_flush, got = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            ids, null, total, n = got[0][0]
            ids, null, n = np.frombuffer(ids, np.int64), np.frombuffer(null, bool), np.frombuffer(n, np.int64)
            total = np.frombuffer(total, np.float64).reshape(-1, 2).copy()
            for _, _, q, who in got.get(4, ()):
                total[np.frombuffer(who, np.uint32)] += np.frombuffer(q, np.float32).reshape(-1, 2)
            if LISTS in got:
                keys = np.concatenate([np.frombuffer(x[0], np.uint64) for x in got[LOSSES]])
                losses = np.concatenate([np.frombuffer(x[2], np.float32) for x in got[LOSSES]]).reshape(-1, 2)
                order = np.argsort(keys)
                for mine, often, _, who in got[LISTS]:
                    at = order[np.searchsorted(keys[order], np.frombuffer(mine, np.uint64))]
                    each = np.repeat(losses[at], np.frombuffer(often, np.int64), axis=0)
                    row = np.frombuffer(who, np.uint32)
                    for k in (0, 1):
                        total[:, k] += np.bincount(row, each[:, k], len(total))
            losses = (total / np.maximum(n, 1)[:, None]).T
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(n), pa.array(losses[0].copy()), pa.array(losses[1].copy()), pa.array(losses[0] - losses[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

        for batch in batches:
            for _, flush, kind, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if flush != at_flush:
                    if got:
                        yield from out()
                    at_flush, got = flush, {}
                got.setdefault(kind, []).append(data)
        if got:
            yield from out()
        got = {}
        text.give_back()

    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, _SENT)
    found = found.repartition(parts, "flush").sortWithinPartitions("flush")
    return found.mapInArrow(finish, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality. Background: all documents."""
    docs = common.table(spark, sf_dir, "documents")
    target = common.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    vocabulary, models = train(docs, target)
    return score(models.corpus, vocabulary, models)
