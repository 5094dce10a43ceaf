"""MinHash near-dedup with b-bit signatures.

A document's set is its distinct word shingles. Documents with equal sets form a class, which the
smallest ``doc_id`` represents. Representatives that agree on one band of minima become candidates;
a packed signature that keeps the low ``BITS`` bits of each minimum estimates their similarity,
corrected for the chance that low bits agree by accident; pairs that may reach the threshold are
confirmed on their full sets.

Large bands. Within a band's bucket each member is first held against one pivot, so a group of m
copies costs m checks. The links found are contracted to components. Only then are members outside
their bucket's main component held against the members of other components, and only pairs that pass
the signature's bound leave that join. So no two texts that share a band lose their link, and no
group is expanded into all of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, text

SHINGLE = 5
#: Minima of a signature, minima of a band. Pairs with similarity 0.85 (0.8) share a band but for
#: a chance of 6e-11 (5e-8).
MINIMA, BAND = 128, 4
#: Low bits kept of each minimum.
BITS = 2
#: Standard deviations below the threshold at which an estimate still counts as a candidate.
SIGMAS = 6.0
#: Sets held against one other in one task.
BLOCK = 128
#: Members of a band's bucket, of like size, that are held against as many others in one task.
PAIR_BLOCK = 2048

_rng = np.random.Generator(np.random.PCG64(8675309))
_MUL = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64)
_SEEDS = _rng.integers(1, 2**63, 2, dtype=np.uint64)


def shingle_sets(t: text.Text, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, ascending, and the bounds of each row's run.

    A row with fewer words than ``size`` has all its words as its one shingle; one without words
    has none.
    """
    words = text.Words(t.lower())
    at, values = words.windows(size)
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        sums = text.prefix_sums(words.hash, "word")
        whole = text.spans(sums, words.first[short], words.first[short + 1], "word")
        row, values = np.concatenate([row, short]), np.concatenate([values, whole])
    return text.unique_in_rows(row, values, t.rows)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of each row's set under MINIMA hash functions; rows must not be empty."""
    out = np.empty((len(bounds) - 1, MINIMA), np.uint64)
    step = 1 << 15
    lo = 0
    while lo < len(bounds) - 1:  # in blocks that stay in cache
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, "right")) - 1)
        part, heads = values[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
        for j in range(MINIMA):
            out[lo:hi, j] = np.minimum.reduceat((part * _MUL[j] + _ADD[j]) >> np.uint64(20), heads)
        lo = hi
    return out


def bit_planes(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima, one plane of MINIMA bits for each bit, as 64-bit words."""
    low = text.mix(minima)
    planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(BITS)]
    return np.concatenate(planes, axis=1).view(np.int64)


PLANES = [f"s{i}" for i in range(BITS * MINIMA // 64)]
#: Bits of a set's parity map: each member flips one. Maps of two sets differ in at most as many bits
#: as the sets in members, so the maps rule pairs out for certain.
PARITY = 1024
MAPS = [f"p{i}" for i in range(PARITY // 64)]


def parity_maps(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows = len(bounds) - 1
    bit = (text.mix(values ^ np.uint64(0xA5A5A5A5)) % np.uint64(PARITY)).astype(np.int64)
    at = np.repeat(np.arange(rows), np.diff(bounds)) * PARITY + bit
    odd = (np.bincount(at, minlength=rows * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, PARITY), axis=1).view(np.int64)


def least_matches(similarity: float) -> int:
    """Minima whose low bits must agree, for pairs that may have ``similarity``.

    With C the chance 2**-BITS that bits agree by accident, a pair of similarity J agrees in a share
    C + (1 - C) J of the minima, so J is estimated as (share - C) / (1 - C).
    """
    chance = 2.0**-BITS
    share = chance + (1 - chance) * similarity
    return math.floor(MINIMA * share - SIGMAS * math.sqrt(MINIMA * share * (1 - share)))


def _matches(a: str, b: str) -> Column:
    """Minima whose kept bits agree, of signatures with the column prefixes ``a`` and ``b``."""
    words = MINIMA // 64
    total = F.lit(0)
    for w in range(words):
        off = [F.col(f"{a}s{p * words + w}").bitwiseXOR(F.col(f"{b}s{p * words + w}")) for p in range(BITS)]
        differ = off[0]
        for x in off[1:]:
            differ = differ.bitwiseOR(x)
        total = total + F.bit_count(differ)
    return F.lit(MINIMA) - total


def similarity_estimate(a: str, b: str) -> Column:
    chance = 2.0**-BITS
    return (_matches(a, b) / MINIMA - chance) / (1 - chance)


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and parity maps allow a similarity of ``percent``."""
    na, nb = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
    differ = F.lit(0)
    for m in MAPS:
        differ = differ + F.bit_count(F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}")))
    # a similarity of j allows (1 - j) / (1 + j) of the two sizes to differ
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sizes & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles``, the set's name ``f0, f1``, bands, bit planes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in text.chunks(batches):
            values, bounds = shingle_sets(t, size)
            count = np.diff(bounds)
            some = np.flatnonzero(count)
            names = [np.zeros(t.rows, np.int64) for _ in range(2)]
            planes = np.zeros((t.rows, len(PLANES + MAPS)), np.int64)
            bands = np.zeros((t.rows, MINIMA // BAND), np.int64)
            if len(some):
                heads = bounds[:-1][some]
                for name, seed in zip(names, _SEEDS, strict=True):
                    name[some] = np.add.reduceat(text.mix(values ^ seed), heads).view(np.int64)
                minima = signatures(values, np.append(heads, len(values)))
                planes[some] = np.concatenate([bit_planes(minima), parity_maps(values, np.append(heads, len(values)))], axis=1)
                key = np.zeros((len(some), MINIMA // BAND), np.uint64)
                for j in range(BAND):
                    key = text.mix(key * np.uint64(31) + minima[:, j::BAND])
                key = text.mix(key + np.arange(MINIMA // BAND, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                bands[some] = key.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(t.rows + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count.astype(np.int64)), *map(pa.array, names), lists, *(pa.array(np.ascontiguousarray(p)) for p in planes.T)],
                ["doc_id", "n_shingles", "f0", "f1", "bands", *PLANES, *MAPS],
            )

    common.arrow_ready(docs.sparkSession)
    schema = "doc_id long, n_shingles long, f0 long, f1 long, bands array<long>, " + ", ".join(f"{p} long" for p in PLANES + MAPS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, schema)


def confirm(docs: DataFrame, edges: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """The pairs ``u, v`` of ``edges`` whose full sets have percent * union <= 100 * intersection.

    The pairs of one ``v`` are dealt out in blocks of about BLOCK, each with one copy of v's set.
    A filter sized by the number of ids keeps most sets of other documents from the shuffle.
    """
    spark = docs.sparkSession
    ids = common.cut(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in text.chunks(batches):
            values, bounds = shingle_sets(t, size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), text.binaries(values, bounds)], ["id", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = common.may_be_among(texts, "doc_id", ids).mapInArrow(sets, "id long, members binary")
    hubs = edges.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = edges.join(hubs, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("block"))
    right = hubs.select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    wanted = left.select(F.col("u").alias("id"), "v", "block").unionByName(right.select(F.col("v").alias("id"), "v", "block"))
    dealt = wanted.join(full, "id").select("v", "block", (F.col("id") != F.col("v")).alias("other"), "id", "members")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "v", "block").sortWithinPartitions("v", "block", "other")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in batches:
            us, vs = [], []
            members = batch.column("members")
            for i, (v, other, u) in enumerate(zip(batch.column("v").to_pylist(), batch.column("other").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                s = np.frombuffer(members[i].as_buffer(), np.uint64)
                if not other:
                    if hub != v:
                        hub, own = v, []
                    own.append(s)
                    continue
                for o in own if hub == v else ():
                    if 100 * min(len(s), len(o)) < percent * max(len(s), len(o)):
                        continue
                    both = len(np.intersect1d(s, o, assume_unique=True))
                    if both and 100 * both >= percent * (len(s) + len(o) - both):
                        us.append(u)
                        vs.append(v)
                        break
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(hold, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the least node that each node of ``edges`` (u, v) reaches.

    Alternates the large-star and small-star contractions, with each round's pairs written to the
    shared folder, until a round changes nothing. Pairs never meet in one task by component.
    """
    pairs = common.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        # large star: larger neighbours of a node move to its least neighbour
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours move to the least of them
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = common.cut(small.where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    # at the fixed point every node points at its component's least node
    stars = pairs.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


def near_duplicates(docs: DataFrame, *, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """Components of documents linked by shingle similarity of ``percent`` or more.

    Returns one row per document: ``doc_id, n_shingles, component_id`` (the smallest ``doc_id``
    reachable by links) and ``kept`` (it is that one).

    Null and wordless texts have no shingles and link with nothing. A row with a null ``doc_id``
    links with nothing, has a null ``component_id`` and is kept. Rows that share a ``doc_id`` each report
    the component of the smallest ``doc_id`` that has their text, and the links of all texts of one smallest
    ``doc_id`` are united. Texts of any length are read whole; other columns are ignored.
    """
    rows = common.cut(signed(docs, size))
    live = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    named = ["f0", "f1", "n_shingles"]
    classes = common.cut(live.groupBy(*named).agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", *PLANES, *MAPS), "doc_id").alias("sig")).select(*named, "rep", "sig.*"))
    marks = classes.select("rep", F.explode("bands").alias("band"), "n_shingles")
    buckets = marks.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1").select("band", "pivot")
    members = common.cut(marks.join(buckets, "band").select("band", "rep", "pivot"))
    facts = ["n_shingles", *PLANES, *MAPS]
    planes = classes.select("rep", *facts)
    enough = least_matches(percent / 100)

    def likely(pairs: DataFrame) -> DataFrame:
        u = planes.select(F.col("rep").alias("u"), *(F.col(c).alias(f"u{c}") for c in facts))
        v = planes.select(F.col("rep").alias("v"), *(F.col(c).alias(f"v{c}") for c in facts))
        return pairs.join(u, "u").join(v, "v").where(_possible("u", "v", percent) & (_matches("u", "v") >= enough)).select("u", "v")

    stars = common.cut(likely(members.where("rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct()))
    links = common.cut(confirm(docs, stars, percent, size))
    found = common.cut(components(links))

    # what a bucket's pivot leaves apart
    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("comp", "rep").alias("comp"))
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy("band").agg(F.count("*").alias("k"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("k > 1").select("band", "main")
    apart = placed.join(split, "band")
    apart = common.cut(apart.join(planes, "rep"))
    # only sets of like size can be similar, and many of those are held against each other in blocks
    apart = apart.withColumn("like", F.floor(F.log("n_shingles") / F.lit(1.001 * math.log(100 / percent))).cast("int"))
    blocks = apart.groupBy("band", "like").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    side = lambda d, p, *keys: d.select("band", *keys, *(F.col(c).alias(f"{p}{c}") for c in ("rep", "comp", *facts)))
    a = apart.where("comp <> main").withColumn("like", F.explode(F.array(F.col("like") - 1, F.col("like"), F.col("like") + 1)))
    a = side(a.join(blocks, ["band", "like"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "a", "like", "block")
    b = apart.join(blocks, ["band", "like"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    b = side(b, "b", "like", "block", "main")
    rest = (
        a.join(b, ["band", "like", "block"])
        .where((F.col("acomp") != F.col("bcomp")) & ((F.col("bcomp") == F.col("main")) | (F.col("arep") < F.col("brep"))))
        .where(_possible("a", "b", percent) & (_matches("a", "b") >= enough))
        .select(F.least("arep", "brep").alias("v"), F.greatest("arep", "brep").alias("u"))
        .distinct()
    )
    rest = common.cut(rest.join(stars, ["u", "v"], "left_anti").select("u", "v"))
    if not rest.isEmpty():
        more = common.cut(confirm(docs, rest, percent, size))
        if not more.isEmpty():
            found = common.cut(components(links.unionByName(more)))

    final = classes.select(*named, "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*named, F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("doc_id", *named).join(final, named, "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), b AS (
  SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT u, v FROM b JOIN n a ON a.doc_id = u JOIN n c ON c.doc_id = v WHERE 100 * k >= 85 * (a.n + c.n - k)
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
), c AS (
  SELECT u, min(v) AS component_id FROM r GROUP BY u
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
