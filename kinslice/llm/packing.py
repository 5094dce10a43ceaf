"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition tokenises its documents, cuts the long ones and packs the pieces best-fit, longest
first. Bins that are full but for ``SLACK`` tokens are final. The underfull bins become items: groups
of FAN_IN partitions merge theirs best-fit, emit nearly full bins and pass the rest on, up to one
root. Bins of one node with equal fill are interchangeable and travel as one run (fill, first,
count), so a merge handles at most ``size`` runs from each child, however many bins there are.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZE = 1024
END = 2
SLACK = 4
FAN_IN = 16
#: Bins of a run that one row is expanded to.
RUN = 4096
#: Cut documents of a task that are remembered, so that exact copies are tokenised once.
REMEMBERED = 20_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokenizer:
    """A byte-level BPE file of the tokenizers library, without added special tokens.

    The same vocabulary is run by tiktoken, which yields the same ids several times faster; texts
    that it can't take go to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # byte-level files name bytes by printable characters
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.path = path
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, line: str) -> list[int]:
        try:
            return self.fast.encode(line, allowed_special="all")
        except BaseException as e:  # the Rust side panics on some very long runs
            if type(e).__name__ != "PanicException":
                raise
            return self.slow.encode(line, add_special_tokens=False).ids

    @functools.cached_property
    def slow(self) -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_file(self.path)


@functools.lru_cache(1)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of n tokens: only the first may be shorter than ``size``."""
    first = n % size or size
    return [first] + [size] * ((n - first) // size)


def best_fit(runs: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Best-fit decreasing of runs (length, owner, first, count) into bins of ``size``.

    Returns classes of equal bins (fill, count, parts), fullest first; part (owner, first, offset)
    says that bin k of the class holds item first + k of the owner at that offset.
    """
    room: list[list] = [[] for _ in range(size + 1)]
    mask = 0
    for length, owner, first, count in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
        while count:
            fits = mask >> length
            if not fits:
                left, taken, parts = size, count, []
            else:
                left = length + (fits & -fits).bit_length() - 1
                have, parts = room[left].pop()
                taken = min(have, count)
                if have > taken:
                    room[left].append((have - taken, [(o, f + taken, at) for o, f, at in parts]))
                elif not room[left]:
                    mask &= ~(1 << left)
            room[left - length].append((taken, [*parts, (owner, first, size - left)]))
            if left > length:
                mask |= 1 << (left - length)
            first, count = first + taken, count - taken
    return [(size - left, count, parts) for left in range(size) for count, parts in room[left]]


def pieces(docs: DataFrame, *, size: int, tokenizer: str, end: int) -> DataFrame:
    """Pieces of all documents with their place in the bins of their partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        node = TaskContext.get().partitionId()
        known: dict[bytes, tuple] = {}
        ids: list[int | None] = []
        piece, start, length, crc, owner = [], [], [], [], []
        for batch in batches:
            for doc, line in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key = xxhash.xxh3_128_digest(line or "")
                cut = known.get(key)
                if cut is None:
                    tokens = np.array([*tok.ids(line or ""), end], "<u4")
                    lengths = cut_lengths(len(tokens), size)
                    starts = np.cumsum([0, *lengths])
                    cut = (starts[:-1].tolist(), lengths, [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)])
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = cut
                owner.extend([len(ids)] * len(cut[0]))
                piece.extend(range(len(cut[0])))
                start.extend(cut[0])
                length.extend(cut[1])
                crc.extend(cut[2])
                ids.append(doc)
        if not ids:
            return
        length = np.array(length, np.int64)
        order = np.argsort(-length, kind="stable")
        heads = np.flatnonzero(np.diff(-length[order], prepend=-size - 1))
        runs = [(int(length[order[h]]), 0, int(h), int(n)) for h, n in zip(heads, np.diff(np.append(heads, len(order))), strict=True)]
        bin_, offset, fill = (np.zeros(len(order), np.int64) for _ in range(3))
        at = 0
        for full, count, parts in best_fit(runs, size):
            for _, first, place in parts:
                who = order[first : first + count]
                bin_[who], offset[who], fill[who] = np.arange(at, at + count), place, full
            at += count
        doc_ids = pa.array(ids, pa.int64()).take(pa.array(owner))
        whole = pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(order), node)), pa.array(bin_), pa.array(offset), pa.array(fill)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "node", "bin", "offset", "fill"],
        )
        for lo in range(0, len(order), 50_000):
            yield whole.slice(lo, 50_000)

    common.arrow_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long, node long, bin long, offset long, fill long"
    )


def _merge(size: int):
    def work(runs: pa.Table) -> pa.Table:
        rows = list(zip(*(runs.column(c).to_pylist() for c in ("fill", "node", "first", "n")), strict=True))
        parent = runs.column("parent")[0].as_py()
        out, at = [], 0
        for full, count, parts in best_fit(rows, size):
            out += [(node, first, count, parent, at, place, full) for node, first, place in parts]
            at += count
        cols = list(zip(*out, strict=True))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(_MOVED, cols, strict=True)})

    return work


_MOVED = ["node", "first", "n", "pnode", "pfirst", "poffset", "pfill"]


def pack(docs: DataFrame, *, size: int = SIZE, slack: int = SLACK, fan_in: int = FAN_IN, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens.

    A document is its token ids and the id ``end``; a null text is empty. Longer ones are cut into
    pieces of ``size``, of which the first may be shorter. Returns a row per piece: ``doc_id, piece,
    start, length, ids_crc32, sequence_id, offset``.

    Null ids and repeated rows are packed as any other; other columns are ignored.
    """
    spark = docs.sparkSession
    placed = common.cut(pieces(docs, size=size, tokenizer=tokenizer or default_tokenizer(), end=end))
    bins = placed.where(f"offset = 0 AND fill < {size - slack}")
    runs = bins.groupBy("node", "fill").agg(F.min("bin").alias("first"), F.count("*").alias("n"))
    nodes = (placed.agg(F.max("node")).first()[0] or 0) + 1
    moves: list[DataFrame] = []
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        moved = common.cut(
            runs.withColumn("parent", F.expr(f"node div {fan_in}"))
            .groupBy("parent")
            .applyInArrow(_merge(size), ", ".join(f"{c} long" for c in _MOVED))
        )
        moves.append(moved)
        runs = moved.where(f"poffset = 0 AND pfill < {size - slack}").groupBy(F.col("pnode").alias("node"), F.col("pfill").alias("fill")).agg(F.min("pfirst").alias("first"), F.sum("n").alias("n"))

    def name(level, node, bin_):
        return F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft(F.col(node), 34) + F.col(bin_)

    # where each underfull bin ends up, from the root down; bins are joined by one number, which takes little room if a side is broadcast
    final = None
    for level in range(len(moves), 0, -1):
        # a run's bins, RUN at a time, so that no row holds them all
        step = moves[level - 1].withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
        step = step.withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + RUN, F.col("n")) - 1)))
        step = step.select("node", (F.col("first") + F.col("k")).alias("bin"), "pnode", (F.col("pfirst") + F.col("k")).alias("pbin"), "poffset")
        here = name(level, "pnode", "pbin")
        if final is None:
            final = step.select("node", "bin", here.alias("seq"), F.col("poffset").alias("shift"))
        else:
            up = final.select(name(0, "node", "bin").alias("ubin"), F.col("seq").alias("useq"), F.col("shift").alias("ushift"))
            final = step.join(up, name(0, "pnode", "pbin") == F.col("ubin"), "left").select(
                "node", "bin", F.coalesce("useq", here).alias("seq"), (F.col("poffset") + F.coalesce("ushift", F.lit(0))).alias("shift")
            )
    if final is None:
        final = spark.createDataFrame([], "node long, bin long, seq long, shift long")
    final = final.select(name(0, "node", "bin").alias("fbin"), "seq", "shift")
    return placed.join(final, name(0, "node", "bin") == F.col("fbin"), "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("seq", name(0, "node", "bin")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op7_bestfit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
