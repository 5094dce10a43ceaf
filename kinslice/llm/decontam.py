"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Each training text is read in overlapping passages, and each passage is a query. An item's impacts
are divided by its score for its own text, so one threshold on the share of that score holds for
all items. The commonest terms of an item can't reach the threshold by themselves; only the lists of
its other terms are essential, and passages that lack too many of those are ruled out together. The
others walk all their postings by block-max WAND, which returns every item at or above the threshold. What is
found is verified: the passage must share enough word shingles with both the item's question and its
answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.5
#: Share of an item's own score that its essential terms, the rarest, make up.
ESSENTIAL = 0.8
#: Words of a passage; twice the longest item's if that is more. Passages start at every half.
PASSAGE = 128
#: Share of the question's and of the answer's shingles that the passage must have.
SHINGLE, OVERLAP = 5, 0.5
#: Items of a posting block.
BLOCK = 32
#: Text of the items that one index, held by every task, is made of.
INDEX_BYTES = 16 << 20


def parts(line: str) -> tuple[str, str]:
    """Question and answer: what stands up to the last question mark and after it, else two halves."""
    at = line.rfind("?") + 1
    if 0 < at and line[at:].strip():
        return line[:at], line[at:]
    words = line.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def _terms(lines: list[str]) -> text.Words:
    return text.Words(text.text_of(pa.array(lines, pa.string())).lower_latin(), text.TERM)


def _shingles(lines: list[str]) -> list[np.ndarray]:
    """Shingles of each line; of fewer words, all of them as one."""
    words = _terms(lines)
    sums = text.prefix_sums(words.hash, "word")
    out = []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        size = min(SHINGLE, hi - lo)
        at = np.arange(lo, hi - size + 1) if size else np.zeros(0, np.int64)
        out.append(np.unique(text.spans(sums, at, at + size, "word")))
    return out


class Index:
    """Postings of the items' terms in blocks, with the largest impact of each list and block."""

    def __init__(self, ids: list[int], lines: list[str], whole: tuple[int, float, int, np.ndarray, np.ndarray] | None = None):
        """``whole``, if these aren't all items: number of all, their mean and largest length, terms, and items of each term."""
        words = _terms(lines)
        self.ids = ids
        self.longest = int(words.count.max(initial=0))
        pair, tf = np.unique(np.stack([words.hash, words.row.astype(np.uint64)], 1), axis=0, return_counts=True)
        self.terms, at = np.unique(pair[:, 0], return_index=True)
        self.first = np.append(at, len(pair))
        self.items = pair[:, 1].astype(np.int64)
        n, df = len(ids), np.diff(self.first)
        every, mean, spread = n, words.count.mean() if n else 0.0, df
        if whole is not None:
            every, mean, self.longest, terms, spread = whole
            order = np.argsort(terms)
            spread = spread[order[np.searchsorted(terms[order], self.terms)]] if len(self.terms) else df
        idf = np.repeat(np.log(1 + (every - spread + 0.5) / (spread + 0.5)), df)
        size = words.count / max(mean, 1e-9)
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.items]))
        own = np.bincount(self.items, impact, n)
        self.impact = impact / np.maximum(own, 1e-12)[self.items]
        self.most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        # each item's rarest terms, up to the share ESSENTIAL of its score
        term = np.repeat(np.arange(len(self.terms)), df)
        order = np.lexsort((self.terms[term], spread[term], self.items))
        item, before = self.items[order], np.cumsum(self.impact[order]) - self.impact[order]
        heads = np.searchsorted(item, np.arange(n))
        before = before - before[np.minimum(heads, max(len(order) - 1, 0))][item] if len(order) else before
        essential = np.sort(order[before < ESSENTIAL])  # by term again
        self.key_items, self.key_impact = self.items[essential], self.impact[essential]
        self.key_first = np.searchsorted(term[essential], np.arange(len(self.terms) + 1))
        self.rest = 1 - np.bincount(self.key_items, self.key_impact, n)
        block = self.items // BLOCK
        self.block_most: list[dict[int, float]] = []
        for lo, hi in zip(self.first[:-1], self.first[1:], strict=True):
            most: dict[int, float] = {}
            for b, x in zip(block[lo:hi].tolist(), self.impact[lo:hi].tolist(), strict=True):
                most[b] = max(most.get(b, 0.0), x)
            self.block_most.append(most)
        halves = [parts(line) for line in lines]
        self.question, self.answer = _shingles([h[0] for h in halves]), _shingles([h[1] for h in halves])
        # a small filter that most words of a corpus fail
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms that the index has; -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.terms, hashes[maybe])
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose impacts over ``terms`` sum to ``threshold`` or more."""
        items, impact = self.items, self.impact
        lists = [[int(items[self.first[t]]), int(self.first[t]), int(self.first[t + 1]), float(self.most[t]), t] for t in terms.tolist()]
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, one in enumerate(lists):
                bound += one[3]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_most[x[4]].get(block, 0.0) for x in lists[: pivot + 1]) < threshold:
                # nothing up to the block's end, or to the next list's item, can reach it
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                to = max(to, item + 1)
            elif lists[0][0] == item:
                total = sum(float(impact[x[1]]) for x in lists[: pivot + 1])
                if total >= threshold:
                    found.append((item, total))
                to = item + 1
            else:
                to = item
            rest = []
            for k, one in enumerate(lists):
                if k <= pivot and one[0] < to:
                    at = one[1] + int(np.searchsorted(items[one[1] : one[2]], to))
                    if at == one[2]:
                        continue
                    one[0], one[1] = int(items[at]), at
                rest.append(one)
            lists = rest
        return found


def _spread(items: DataFrame) -> DataFrame:
    """``term, df``: how many of the items have each term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in text.chunks(batches):
            words = text.Words(t.lower_latin(), text.TERM)
            terms, df = np.unique(text.unique_in_rows(words.row, words.hash, t.rows)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64))], ["term", "df"])

    return items.select("text").mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _lengths(items: DataFrame) -> tuple[int, float, int]:
    """Number of items, and the mean and the largest number of their terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in text.chunks(batches):
            count = text.Words(t.lower_latin(), text.TERM).count
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (t.rows, int(count.sum()), int(count.max(initial=0)))], ["n", "terms", "longest"])

    got = items.select("text").mapInArrow(work, "n long, terms long, longest long").agg(F.sum("n"), F.sum("terms"), F.max("longest")).first()
    return got[0], got[1] / got[0], got[2]


def _passages(words: text.Words, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First passage of each row, and the two passages (or the one, twice) that hold each word."""
    halves = -(-words.count // half)
    count = np.maximum(halves - 1, (halves > 0).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(count)])
    at = (np.arange(len(words.row)) - words.first[words.row]) // half
    last = count[words.row] - 1
    return base, base[words.row] + np.maximum(at - 1, 0), base[words.row] + np.minimum(at, last)


def _searched(docs: DataFrame, index: Index, threshold: float, overlap: float) -> DataFrame:
    half = max(PASSAGE // 2, index.longest)
    held = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch, t in text.chunks(batches):
            words = text.Words(t.lower_latin(), text.TERM)
            place = ix.places(words.hash)
            base, one, two = _passages(words, half)
            hit = np.flatnonzero(place >= 0)
            key = np.concatenate([one[hit], two[hit]]) * len(ix.terms) + np.concatenate([place[hit], place[hit]])
            key = np.unique(key)
            passage, term = key // max(len(ix.terms), 1), key % max(len(ix.terms), 1)
            many = np.diff(ix.key_first)[term] if len(term) else term
            at = np.arange(many.sum()) + np.repeat(ix.key_first[term] - (np.cumsum(many) - many), many)
            pair, back = np.unique(np.repeat(passage, many) * len(ix.ids) + ix.key_items[at], return_inverse=True)
            reach = np.bincount(back, ix.key_impact[at], len(pair)) + ix.rest[pair % max(len(ix.ids), 1)]
            likely = np.unique(pair[reach >= threshold - 1e-9] // max(len(ix.ids), 1))
            best: dict[tuple[int, int], list] = {}
            shingle_at = shingles = None
            for p in likely.tolist():
                lo, hi = np.searchsorted(passage, [p, p + 1])
                found = ix.search(term[lo:hi], threshold)
                if not found:
                    continue
                if shingles is None:
                    shingle_at, shingles = words.windows(SHINGLE)
                    sums = text.prefix_sums(words.hash, "word")
                row = int(np.searchsorted(base, p, "right")) - 1
                first = int(words.first[row]) + (p - int(base[row])) * half
                stop = min(first + 2 * half, int(words.first[row + 1]))
                a, b = np.searchsorted(shingle_at, [first, max(stop - SHINGLE + 1, first)])
                own = shingles[a:b]
                for item, total in found:
                    shares = []
                    for part in (ix.question[item], ix.answer[item]):
                        if not len(part):
                            shares.append(1.0)
                            continue
                        have = np.isin(part, own).mean()
                        if len(part) == 1 and not have:  # may be a part of fewer words
                            at = np.arange(first, stop)
                            have = max((float(np.isin(part[0], text.spans(sums, at[: len(at) - n + 1], at[: len(at) - n + 1] + n, "word"))) for n in range(1, min(SHINGLE, len(at) + 1))), default=0.0)
                        shares.append(float(have))
                    if min(shares) < overlap:
                        continue
                    old = best.get((row, item))
                    if old is None or total > old[0]:
                        best[row, item] = [total, *shares]
            if best:
                rows = pa.array([r for r, _ in best])
                cols = [pa.array(x, pa.float64()) for x in zip(*best.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), pa.array([ix.ids[i] for _, i in best], pa.int64()), *cols], ["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"])

    return docs.mapInArrow(work, "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double")


def leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Test items that documents hold: ``doc_id, item_id, bm25, question_overlap, answer_overlap``.

    One row per document row and item, of its passage with the highest score (a share of the item's
    score for its own text). Items beyond ``index_bytes`` of text go to further indexes, each held
    against all documents, with the document frequencies and lengths of all items. Null or empty texts and items hold nothing and are not found; a null
    ``doc_id`` is returned as such. Repeated rows are judged one by one; other columns are ignored.
    """
    common.arrow_ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length(F.trim("text")) > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // index_bytes)
    out = spread = None
    if blocks > 1:
        lengths, spread = _lengths(items), common.cut(_spread(items))
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(block.collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
        whole = None
        if spread is not None:
            # the block's terms only
            terms = spread.join(_spread(block).select("term"), "term", "left_semi").toArrow()
            whole = (*lengths, terms.column("term").to_numpy().view(np.uint64), terms.column("df").to_numpy())
        found = _searched(docs, Index([r.item_id for r in rows], [r.text for r in rows], whole), threshold, overlap)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double")
    return out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
