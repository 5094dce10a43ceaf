"""Substring dedup by prefix-partitioned suffix trees.

The alphabet is the words of the corpus. Suffixes are split by variable-length prefixes of whole words: a
prefix that too many suffixes share is extended by one more word, until the suffixes of each fit in
memory. A partition holds the subtrees of some prefixes. It sorts their suffixes word by word; the longest
common prefixes of neighbours make the internal nodes. A node that is ``window`` words deep or deeper has
as leaves all places of a passage, and every leaf above the node's smallest document is a repeat. Repeats
that overlap join into the maximal repeats, which are removed.

Plan. Texts are dealt once to homes of about HOME_BYTES, and that one exchange is read three times.

1. A home sends a sorted, shortened fingerprint of each window path that it has. Partitions of
   fingerprints answer with one bit for each: whether any other home has it. A path that only one home has
   ends in a leaf below no deep node, or its node is decided in that home, so its suffixes aren't sent.
2. A home sends one suffix for each shared path, the one of its smallest document, to the partition of the
   suffix's prefix: a byte that names each of its words, the 64-bit hash of the path and the document. The
   subtrees answer with the paths that smaller documents elsewhere have.
3. A home removes what the answers and its own documents make repeats.

A passage that a third of all documents hold is one leaf for each home, not one for each document. Prefixes
are chosen by their numbers over all suffixes, counted in one pass of the texts: a prefix counts where it
makes up a share of a task's suffixes, so that what is left out can't hide a prefix over the budget.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, text

WINDOW = 13
#: Suffixes in one partition of subtrees at most, but for those that share a whole window.
PARTITION_PATHS = 1_500_000
#: Text of a home.
HOME_BYTES = 6 << 20
#: Suffixes of a task that are held to count their prefixes.
TASK_PATHS = 1_500_000
#: The table of prefixes that are extended, which every task holds, stays below this many rows.
MAX_PREFIXES = 1 << 22
#: Bits of a fingerprint beyond those that would number a partition's paths: so rare are chance agreements.
SPARE_BITS = 7


def _extended(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Names of prefixes that are longer by one word."""
    return text.mix(key * np.uint64(0x9E3779B97F4A7C15) + word)


def prefixes(hashes: np.ndarray, at: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The name of each suffix's prefix; ``levels[k]`` has the prefixes of k + 1 words to extend."""
    key = text.mix(hashes[at])
    todo = np.arange(len(at))
    for k, heavy in enumerate(levels):
        todo = todo[np.isin(key[todo], heavy)]
        if not len(todo):
            break
        key[todo] = _extended(key[todo], hashes[at[todo] + k + 1])
    return key


def heavy_prefixes(docs: DataFrame, window: int, partition_paths: int, size: int) -> tuple[list[np.ndarray], int]:
    """Prefixes to extend, by length, and how many suffixes there are. ``size``: bytes of all texts."""
    most = max(size // 2 + 1, 1)  # a word and its space have two bytes at least
    budget = max(partition_paths // 4, 4 * most // MAX_PREFIXES, 1)
    share = budget / (2 * most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, words, paths = [], [], 0, 0

        def out() -> pa.RecordBatch:
            hashes, at = np.concatenate(held), np.concatenate(starts)
            least = max(share * len(at), 1)
            found, key = [(0, 0, len(at))], text.mix(hashes[at])
            for k in range(1, window):
                keys, back, n = np.unique(key, return_inverse=True, return_counts=True)
                heavy = n >= least
                found.extend(zip([k] * int(heavy.sum()), keys[heavy].view(np.int64).tolist(), n[heavy].tolist(), strict=True))
                pick = heavy[back]
                at = at[pick]
                if not len(at) or k + 1 >= window:
                    break
                key = _extended(key[pick], hashes[at + k])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["k", "key", "n"])

        for _, t in text.chunks(batches):
            w = text.Words(t)
            at, _ = w.windows(window)
            held.append(w.hash)
            starts.append(at + words)
            words, paths = words + len(w.hash), paths + len(at)
            if paths >= TASK_PATHS:
                yield out()
                held, starts, words, paths = [], [], 0, 0
        if paths:
            yield out()
        held, starts = [], []
        text.give_back()

    counted = docs.select("text").mapInArrow(count, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
    # at most 2 * window * MAX_PREFIXES rows; what a task left out is less than half the budget in all
    rows = counted.where((F.col("k") == 0) | (F.col("n") * 2 >= budget)).toArrow()
    k, key, n = (rows.column(c).to_numpy() for c in ("k", "key", "n"))
    levels = [np.sort(key[k == j].view(np.uint64)) for j in range(1, window)]
    return levels[: next((j for j, level in enumerate(levels) if not len(level)), len(levels))], int(n[k == 0].sum())


class Home:
    """The window paths of some documents; rows are in the order of their documents, null ids last."""

    def __init__(self, table: pa.Table, window: int, texts: bool = False):
        doc, null = table.column("doc_id"), table.column("doc_id").is_null().to_numpy()
        value = text.integers(doc.combine_chunks(), 0)
        order = np.lexsort((value, null))
        self.table = table.take(pa.array(order))
        self.doc, self.late = value[order], null[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.late[1:] != self.late[:-1])
        rank = np.cumsum(new)
        self.parts, hashes, at, path, row, words, rows = [], [], [], [], [], 0, 0
        for batch, t in text.chunks(self.table.to_batches()):
            w = text.Words(t)
            a, p = w.windows(window)
            hashes.append(w.hash)
            at.append(a + words)
            path.append(p)
            row.append(w.row[a] + rows)
            t._sums = None
            if texts:
                self.parts.append((batch, t, w))
            words, rows = words + len(w.hash), rows + t.rows
        none = np.zeros(0, np.int64)
        self.hashes = np.concatenate([none.view(np.uint64), *hashes])
        self.at, self.row = np.concatenate([none, *at]), np.concatenate([none, *row])
        self.path = np.concatenate([none.view(np.uint64), *path])
        order = np.argsort(self.path, kind="stable")
        head = np.ones(len(order), bool)
        head[1:] = self.path[order[1:]] != self.path[order[:-1]]
        #: first window of each distinct path, in the order of paths: that of its smallest document
        self.first = order[head]
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(rank[self.row[self.first]], np.diff(np.append(np.flatnonzero(head), len(order))))
        #: windows that a smaller document of this home has too
        self.again = rank[self.row] > least

    def fingerprints(self, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First windows by part and fingerprint, the fingerprints, and the bounds of each part's run."""
        path = self.path[self.first]
        part, short = (path >> np.uint64(40)) % np.uint64(parts), path & np.uint64((1 << bits) - 1)
        order = np.lexsort((short, part))
        return self.first[order], short[order].astype(np.uint32), np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, first all low ones: high ones, mostly equal, compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_PRINTS = pa.schema([("part", pa.int32()), ("home", pa.int32()), ("prints", pa.binary())])
_SHARED = pa.schema([("home", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])
_LEAVES = pa.schema([("to", pa.int32()), ("home", pa.int32()), ("names", pa.binary()), ("path", pa.binary()), ("doc", pa.binary()), ("late", pa.binary())])
_FOUND = pa.schema([("home", pa.int32()), ("path", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which fingerprints of each home another home has sent too."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in batches:
        for part, home, prints in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(part, []).append((home, np.cumsum(_numbers(prints, np.uint32), dtype=np.uint32)))
    for part, sent in held.items():
        own = [x[np.append(True, x[1:] != x[:-1])] for _, x in sent]
        values, homes = np.unique(np.concatenate(own), return_counts=True)
        both = values[homes > 1]
        rows = []
        for home, x in sent:
            hit = np.zeros(len(x), bool)
            if len(both):
                at = np.minimum(np.searchsorted(both, x), len(both) - 1)
                hit = both[at] == x
            rows.append((home, part, len(x), np.packbits(hit).tobytes()))
        yield from _table(rows, _SHARED).to_batches()
    held.clear()
    text.give_back()


def deep_nodes(names: np.ndarray, path: np.ndarray, depth: int) -> np.ndarray:
    """First leaf of each internal node of ``depth`` or deeper, and the end of the last one's, for sorted leaves.

    ``names``: (leaves, words). Neighbours whose common prefix has ``depth`` words are below one node; names
    are short, so a node is split where the hash of the path shows that they agree by chance.
    """
    differ = names[1:] != names[:-1]
    common_prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), names.shape[1])
    apart = (common_prefix < depth) | (path[1:] != path[:-1])
    return np.concatenate([[0], np.flatnonzero(apart) + 1, [len(path)]])


def _subtrees(window: int):
    """The subtrees of a partition's prefixes: paths of each home that a smaller document has elsewhere."""

    def solved(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = np.concatenate([np.frombuffer(r[2], f"S{window}") for r in rows])
        path, doc = (np.concatenate([_numbers(r[k], kind) for r in rows]) for k, kind in ((3, np.uint64), (4, np.int64)))
        late = np.concatenate([np.unpackbits(np.frombuffer(r[5], np.uint8), count=len(r[3]) // 8) for r in rows])
        home = np.repeat([r[1] for r in rows], [len(r[3]) // 8 for r in rows])
        order = np.lexsort((doc, late, path))
        order = order[np.argsort(names[order], kind="stable")]  # suffixes word by word
        names, path, doc, late, home = (x[order] for x in (names, path, doc, late, home))
        nodes = deep_nodes(names.view(np.uint8).reshape(len(path), window), path, window)
        first = np.repeat(nodes[:-1], np.diff(nodes))
        repeat = (doc != doc[first]) | (late != late[first])
        home, path = home[repeat], path[repeat]
        order = np.argsort(home, kind="stable")
        home, path = home[order], path[order]
        cut = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
        out = [(int(home[lo]), np.sort(path[lo:hi]).tobytes()) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        yield from _table(out, _FOUND).to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, to = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != to and held:
                    yield from solved(held)
                    held = []
                to = row[0]
                held.append(row)
        if held:
            yield from solved(held)
        held = []
        text.give_back()

    return work


def _marks(count: int, window: int, starts: np.ndarray) -> np.ndarray:
    """Which of ``count`` words the windows at ``starts`` cover."""
    edge = np.zeros(count + 1, np.int32)
    edge[: count + 1] = np.bincount(starts, minlength=count + 1)[: count + 1]
    edge -= np.bincount(np.minimum(starts + window, count), minlength=count + 1)
    return np.cumsum(edge[:count]) > 0



def _starts(home: Home, found: pa.Table) -> np.ndarray:
    """Windows of a home that are repeats."""
    paths = [np.frombuffer(x, np.uint64) for x in found.column("path").to_pylist()]
    out = home.again.copy()
    if paths:
        out |= np.isin(home.path, np.concatenate(paths))
    return np.flatnonzero(out)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, partition_paths: int = PARTITION_PATHS, home_bytes: int = HOME_BYTES, output: str = "text") -> DataFrame:
    """Removes each word that a repeated window covers.

    A window of ``window`` words is repeated if its words also start in a document with a smaller
    ``doc_id``. Returns ``doc_id, n_words, n_removed``, the maximal repeats as ``repeats``, pairs of first
    word and number of words, and the words kept, joined by one space, as ``kept_text``
    (``output="text"``); with ``output="digest"`` without repeats and with ``kept_sha256`` instead. A text
    of which nothing is removed keeps its own white space in ``kept_text``. ``output="documents"`` returns
    the columns of ``docs`` with that text.

    Null text counts as no words; its ``kept_text`` is null. A null ``doc_id`` counts as larger than
    all others. Rows that share a ``doc_id`` don't repeat each other. Texts of any length are read whole; a
    longer one than ``home_bytes`` makes its home larger. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    common.arrow_ready(spark)
    digest = output == "digest"
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if output == "documents" else []
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("rest"),
    )
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    levels, total = heavy_prefixes(rows, window, partition_paths, size)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    homes = max(-(-size // home_bytes), 1)
    parts = max(shuffle, -(-total // partition_paths))
    bits = min(max((total // parts).bit_length() + SPARE_BITS, 8), 32)
    spread = max(shuffle, homes)
    rows = rows.withColumn("home", F.pmod(F.xxhash64("doc_id", "text"), F.lit(homes)).cast("int")).repartition(spread, "home")

    def prints(table: pa.Table) -> pa.Table:
        home = Home(table, window)
        _, short, bound = home.fingerprints(parts, bits)
        me, out = table.column("home")[0].as_py(), []
        for k in np.flatnonzero(np.diff(bound)).tolist():
            out.append((k, me, _planes(np.diff(short[bound[k] : bound[k + 1]], prepend=np.uint32(0)))))
        text.give_back()
        return _table(out, _PRINTS)

    def leaves(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(table) or not len(shared):
            return _table([], _LEAVES)
        home = Home(table, window)
        first, _, bound = home.fingerprints(parts, bits)
        send = np.zeros(len(first), bool)
        for part, n, raw in zip(*(shared.column(c).to_pylist() for c in ("part", "n", "bits")), strict=True):
            send[bound[part] : bound[part] + n] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
        first = first[send]
        at = home.at[first]
        to = (text.mix(prefixes(home.hashes, at, levels)) % np.uint64(parts)).astype(np.int32)
        names = (home.hashes >> np.uint64(56)).astype(np.uint8)[at[:, None] + np.arange(window)]
        order = np.argsort(to, kind="stable")
        to, first, names = to[order], first[order], names[order]
        row, cut, out = home.row[first], np.flatnonzero(np.diff(to, prepend=-1, append=-1)), []
        me = table.column("home")[0].as_py()
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            mine = slice(lo, hi)
            out.append((int(to[lo]), me, names[mine].tobytes(), _planes(home.path[first[mine]]), _planes(home.doc[row[mine]]), np.packbits(home.late[row[mine]]).tobytes()))
        text.give_back()
        return _table(out, _LEAVES)

    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string, repeats array<struct<first: int, n: int>>")
    schema = schema.add("rest", rows.schema["rest"].dataType)

    def kept(table: pa.Table, found: pa.Table) -> pa.Table:
        home = Home(table, window, texts=True)
        starts = _starts(home, found)
        bound = np.searchsorted(home.row[starts], np.arange(len(home.doc) + 1))
        ids, counts, gone, lines, repeats, rest, before, row = [], [], [], [], [], [], 0, 0
        for batch, t, words in home.parts:
            raw, old = t.buf.tobytes(), batch.column("text")
            for r in range(t.rows):
                own = home.at[starts[bound[row] : bound[row + 1]]] - before - words.first[r]
                row += 1
                runs, lost = [], 0
                if len(own):
                    mark = _marks(int(words.count[r]), window, own)
                    edge = np.flatnonzero(np.diff(mark, prepend=False, append=False)).reshape(-1, 2)
                    runs = [{"first": int(a), "n": int(b - a)} for a, b in edge]
                    lost = int(mark.sum())
                    w = words.first[r] + np.flatnonzero(~mark)
                    line = b" ".join(raw[a:b] for a, b in zip(words.start[w].tolist(), words.end[w].tolist(), strict=True))
                elif digest:
                    line = b" ".join(raw[t.off[r] : t.off[r + 1]].translate(_PLAIN).split())
                if digest:
                    lines.append(hashlib.sha256(line).hexdigest())
                else:
                    lines.append(line.decode() if lost else old[r].as_py())
                repeats.append(runs)
                gone.append(lost)
            ids.append(batch.column("doc_id"))
            counts.append(words.count.astype(np.int64))
            rest.append(batch.column("rest"))
            before += len(words.row)
        if not ids:
            return pa.table([pa.array([], f.type) for f in _kept_schema(table)], schema=_kept_schema(table))
        out = [pa.chunked_array(ids), pa.array(np.concatenate(counts)), pa.array(gone, pa.int64()), pa.array(lines, pa.string()), pa.array(repeats, _SPANS), pa.chunked_array(rest)]
        home = None
        text.give_back()
        return pa.table(out, schema=_kept_schema(table))

    sent = rows.groupBy("home").applyInArrow(prints, _ddl(_PRINTS)).repartition(parts, "part")
    shared = sent.mapInArrow(_shared, _ddl(_SHARED)).repartition(spread, "home")
    suffixes = rows.groupBy("home").cogroup(shared.groupBy("home")).applyInArrow(leaves, _ddl(_LEAVES))
    found = suffixes.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(_subtrees(window), _ddl(_FOUND)).repartition(spread, "home")
    done = rows.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(kept, schema)
    if output == "documents":
        own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept")}
        return done.select(*(own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))
    if digest:
        return done.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    return done.select("doc_id", "n_words", "n_removed", "repeats", F.col("kept").alias("kept_text"))


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))


def _kept_schema(table: pa.Table) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("repeats", _SPANS), ("rest", table.schema.field("rest").type)])


#: White space of the words' definition as spaces; bytes.split() alone would know the same six.
_PLAIN = bytes(0x20 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), output="digest")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13
), h AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p
), bad AS (
  SELECT h.doc_id, h.i FROM h JOIN (SELECT s, min(doc_id) AS m FROM h GROUP BY s) g USING (s) WHERE h.doc_id > g.m
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM bad
), lost AS (
  SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN ws ELSE
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ks, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""
