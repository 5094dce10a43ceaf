"""The operators against brute force on small tables with awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinslice.llm import common, decontam, html, lm_scoring, minhash, packing, quality, rules, substring, text, toxicity, urls

WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = " ".join(f"w{i * 7919 % 997}" for i in range(80)) + "."
TEXTS = [
    BASE, BASE, None, "", "   \n\t ", "one", "one two three four five", "ONE two three four five",
    BASE.replace("w0", "other", 1), "start " + BASE, BASE + " the end.", "é ñ ü " * 12, "x" * 50_000,
    "a b c d e f g h i j k l m n o p q r s t u v.\n" * 4, " ".join(f"v{i}" for i in range(60)) + " " + BASE[:250],
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "h", None) for i, t in enumerate(TEXTS)]
    rows.append((None, BASE, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_words_and_windows():
    t = text.text_of(pa.array(TEXTS))
    w = text.Words(t)
    assert w.count.tolist() == [len(words(x)) for x in TEXTS]
    at, h = w.windows(3)
    every = [" ".join(words(x)[i : i + 3]) for x in TEXTS for i in range(len(words(x)) - 2)]
    assert len(at) == len(every) and len(set(h.tolist())) == len(set(every))
    assert len({(a, b) for a, b in zip(every, h.tolist(), strict=True)}) == len(set(every))


def brute_repeats(rows, k=13):
    key = lambda d: 2**63 if d is None else d
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, key(d)), key(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < key(d) for j in range(i, i + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("paths", "home"), [(substring.PARTITION_PATHS, substring.HOME_BYTES), (40, 300), (substring.PARTITION_PATHS, 50)])
def test_substring(spark, docs, paths, home):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring.remove_repeats(docs, output="digest", partition_paths=paths, home_bytes=home)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)
    whole = substring.remove_repeats(docs, output="documents")
    assert whole.columns == docs.columns
    assert {r.doc_id: r.text for r in whole.collect()}[2] is None


def test_substring_same_id_and_empty(spark, docs, empty):
    twice = docs.union(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(2**63 - 1)))
    rows = [(r.doc_id, r.text) for r in twice.collect()]
    got = substring.remove_repeats(twice, output="digest", home_bytes=200)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(rows)
    assert substring.remove_repeats(empty, output="digest").count() == 0


def test_substring_prefixes_and_nodes(spark):
    """Prefixes split suffixes to the budget; deep nodes are the passages that all their leaves share."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(rng.zipf(1.4)) % 40}" for _ in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t) for _, t in rows)
    levels, total = substring.heavy_prefixes(df, 13, 400, size)
    assert total == 60 * 48 and len(levels) > 1
    t = text.text_of(pa.array([t for _, t in rows]))
    w = text.Words(t)
    at, path = w.windows(13)
    key = substring.prefixes(w.hash, at, levels)
    by = {}
    for a, k in zip(at.tolist(), key.tolist(), strict=True):
        by.setdefault(k, []).append(tuple(w.hash[a : a + 13].tolist()))
    for own in by.values():
        shared = next((j for j in range(13) if len({x[j] for x in own}) > 1), 13)
        assert shared >= 1 and (len(own) <= 100 or shared >= 12)
    # the suffixes of one prefix that has no other: a shorter prefix would have been too large
    names = (w.hash >> np.uint64(56)).astype(np.uint8)[at[:, None] + np.arange(13)]
    order = np.argsort(path, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(names).view("S13").ravel()[order], kind="stable")]
    nodes = substring.deep_nodes(names[order], path[order], 13)
    spans = [path[order][a:b] for a, b in zip(nodes[:-1], nodes[1:])]
    assert all(len(set(s.tolist())) == 1 for s in spans) and len(spans) == len(set(path.tolist()))


def test_substring_maximal_repeats(spark):
    rng = np.random.default_rng(2)
    some = lambda n: [f"v{rng.integers(10**6)}" for _ in range(n)]
    passage, short = some(40), some(12)
    rows = [(1, passage + some(5) + short), (2, some(3) + passage[5:35] + some(20) + passage[:13] + short), (3, [])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r.doc_id: [(x["first"], x["n"]) for x in r.repeats] for r in substring.remove_repeats(df, home_bytes=64).collect()}
    assert got == {1: [], 2: [(3, 30), (53, 13)], 3: []}


def shingles(t, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_minhash(spark, docs, empty):
    rng = np.random.default_rng(3)
    many = []
    for i in range(120):
        w = words(BASE)[:70]
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(70)] = f"z{rng.integers(50)}"
        many.append((100 + i, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + many
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in rows if d is not None}
    comp = {d: d for d in sets}
    ids = list(sets)
    while True:
        old = dict(comp)
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == old:
            break
    got = minhash.near_duplicates(df, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {d: (len(sets[d]), comp[d], comp[d] == d) for d in sets}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_blocks(spark, monkeypatch):
    """Members of one bucket that are no copies of each other are held against each other in blocks."""
    monkeypatch.setattr(minhash, "PAIR_BLOCK", 3)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rng = np.random.default_rng(14)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(60):  # a shared passage, and pairs that also share the rest
        rest = [f"r{i // 2}_{j}" for j in range(int(rng.integers(10, 40)) if i % 2 == 0 else len(rest))]
        rows.append((i, " ".join(shared + rest)))
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, n_shingles int, band string")
    sets = {d: shingles(t) for d, t in rows}
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, percent=80).collect()}
    assert got == comp and len(set(comp.values())) > 1


def test_minhash_rows_with_one_id(spark):
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(1, BASE), (2, other), (7, BASE), (7, other), (9, None), (9, "")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(d, c) for d, _, c, _ in got] == [(1, 1), (2, 2), (7, 2), (7, 1), (9, 9), (9, 9)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.comp for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_rules_base(docs):
    for r in rules.judge(docs).collect():
        w = words(r_text := (TEXTS[r.doc_id] if r.doc_id is not None else BASE) or "")
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        lines = [x for x in r_text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), len("".join(w)), len(again), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r_text)


def test_rules_awkward(spark, docs, empty):
    for r in rules.judge(docs).collect():
        text_ = TEXTS[r.doc_id] if r.doc_id is not None else BASE
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
        assert (r.clean_text is None) == (text_ is None)
    assert rules.judge(empty).count() == 0
    twice = rules.judge(docs.union(docs)).collect()
    assert len(twice) == 2 * docs.count() and len({tuple(r) for r in twice}) == len({tuple(r) for r in rules.judge(docs).collect()})
    notices = "Alle Rechte vorbehalten.\nAccueil\nTodos los derechos reservados." + "\nEin Satz, der so stehen bleibt." * 3
    (r,) = rules.judge(spark.createDataFrame([(1, notices)], "doc_id long, text string")).collect()
    assert r.n_failed_lines == 3


def test_rules_lines(spark):
    good = "This is a plain line of text that ends well.\n" + "\n".join(f"Line {i} has words like w{i} and x{i} of its own." for i in range(9))
    bad = "Home\nnext | previous | up | down\nAll rights reserved.\nno stop at the end of this line at all " + "word " * 20
    df = spark.createDataFrame([(1, good), (2, bad), (3, good + "\nHome")], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    assert got[1].kept and got[1].n_failed_lines == 0
    assert not got[2].kept and got[2].n_failed_lines == 4
    assert got[3].kept and got[3].clean_text == good


def test_packing(spark, docs, empty):
    tok = packing.Tokenizer(packing.default_tokenizer())
    tricky = [*(t or "" for t in TEXTS), "<|endoftext|> x", "a\u3000b\n\n  c 123 !!", "日本語 текст"]
    assert [tok.ids(t) for t in tricky] == [tok.slow.encode(t, add_special_tokens=False).ids for t in tricky]
    size = 64
    rows = packing.pack(docs.repartition(5), size=size, slack=0).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    for d, own in by_doc.items():
        ids = np.array([*tok.ids((TEXTS[d] if d is not None else BASE) or ""), 2], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == len(ids) and all(r.length == size for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("fan_in", [2, 16])
def test_packing_levels(spark, monkeypatch, fan_in):
    """Several merge levels need few more sequences than best-fit over all pieces at once, though bins stay whole."""
    monkeypatch.setattr(packing, "RUN", 2)
    rng = np.random.default_rng(21)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 70)))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    size = 64
    got = packing.pack(df, size=size, slack=0, fan_in=fan_in).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= size
    lengths = sorted((r.length for r in got), reverse=True)
    room = []
    for n in lengths:  # best-fit decreasing, plainly
        fits = [k for k, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(size - n)
    least = -(-sum(lengths) // size)
    assert least <= len(by_seq) <= 1.05 * len(room)
    again = packing.pack(df.union(df.limit(5)).withColumn("node", F.lit(1)).withColumn("bin", F.lit("x")), size=size).collect()
    assert sum(r.piece == 0 for r in again) == 245


def test_decontamination(spark, empty):
    rng = np.random.default_rng(5)
    item = lambda: " ".join(f"t{rng.integers(400)}" for _ in range(40))
    items = [(i, item()) for i in range(60)]
    rows = [(i, " ".join([item(), items[i][1] if i % 3 == 0 else item(), item()])) for i in range(30)]
    df = spark.createDataFrame([*rows, (None, items[5][1]), (99, None), (98, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (70, None), (71, "")], "item_id long, text string")
    want = {(i, i) for i in range(0, 30, 3)} | {(None, 5)}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench, index_bytes=3000).collect()} == want
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_decontamination_scores_alike_in_all_indexes(spark):
    rng = np.random.default_rng(8)
    item = lambda n: " ".join(f"t{int(rng.zipf(1.3)) % 500}" for _ in range(n))
    items = [(i, item(90 if i == 7 else 30)) for i in range(60)]
    rows = [(i, " ".join([item(100), " ".join(items[i][1].split()[k % 3 : 24 + k % 3]), item(100)])) for k, i in enumerate(range(0, 60, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (70, None), (71, "..")], "item_id long, text string")
    one, more = ({(r.doc_id, r.item_id): r.bm25 for r in decontam.leaks(df, bench, index_bytes=n).collect()} for n in (1 << 20, 2000))
    assert len(one) > 10 and more == pytest.approx(one)


def test_decontamination_awkward(spark):
    """Repeated rows, very long texts, ties between passages, and columns with the operator's own names."""
    rng = np.random.default_rng(15)
    item = " ".join(f"t{rng.integers(500)}" for _ in range(30))
    filler = lambda n: " ".join(f"f{rng.integers(900)}" for _ in range(n))
    rows = [(1, item + " " + filler(400) + " " + item), (2, filler(30_000) + " " + item), (2, filler(30_000) + " " + item), (3, filler(50)), (4, "x" * 300_000)]
    df = spark.createDataFrame([(d, t, 7, "b") for d, t in rows], "doc_id int, text string, item_id int, bm25 string")
    bench = spark.createDataFrame([(9, item, "z"), (9, item, "z")], "item_id int, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect())
    assert set(got) == {(1, 9), (2, 9)} and got.count((2, 9)) == 4


def test_decontamination_against_brute_force(spark):
    """All passages of all documents scored in full, then the overlap of shingles."""
    rng = np.random.default_rng(16)
    word = lambda: f"t{int(rng.zipf(1.4)) % 300}"
    items = [(i, " ".join(word() for _ in range(int(rng.integers(12, 40))))) for i in range(40)]
    rows = []
    for i in range(40):
        own = items[i][1].split()
        cut = own[: max(4, int(len(own) * rng.random()))] if i % 2 else own
        rows.append((i, " ".join([*(word() for _ in range(90)), *cut, *(word() for _ in range(70))])))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ix = decontam.Index([i for i, _ in items], [t for _, t in items])
    half = max(decontam.PASSAGE // 2, ix.longest)
    n, mean = len(items), np.mean([len(t.split()) for _, t in items])
    df_ = {}
    for _, t in items:
        for w in set(t.split()):
            df_[w] = df_.get(w, 0) + 1
    impact = []
    for _, t in items:
        w = t.split()
        one = {x: np.log(1 + (n - df_[x] + 0.5) / (df_[x] + 0.5)) * w.count(x) * (decontam.K1 + 1) / (w.count(x) + decontam.K1 * (1 - decontam.B + decontam.B * len(w) / mean)) for x in set(w)}
        impact.append({x: v / sum(one.values()) for x, v in one.items()})
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    want = {}
    for d, t in rows:
        w = t.split()
        starts = range(0, max(len(w) - half, 1), half)
        for a in starts:
            passage = w[a : a + 2 * half]
            have, sh = set(passage), grams(passage)
            for k, (i, line) in enumerate(items):
                total = sum(v for x, v in impact[k].items() if x in have)
                if total < decontam.THRESHOLD - 1e-9:
                    continue
                shares = []
                for part in decontam.parts(line):
                    p = part.split()
                    g = grams(p)
                    whole = len(p) < 5 and any(passage[j : j + len(p)] == p for j in range(len(passage)))
                    shares.append(1.0 if not p else max(len(g & sh) / len(g), float(whole)))
                if min(shares) >= decontam.OVERLAP:
                    want[d, i] = max(want.get((d, i), 0), total)
    got = {(r.doc_id, r.item_id): r.bm25 for r in decontam.leaks(df, bench).collect()}
    assert len(want) >= 20 and got == pytest.approx(want)


def test_wand_equals_full_scores():
    rng = np.random.default_rng(6)
    lines = [" ".join(f"t{rng.integers(60)}" for _ in range(rng.integers(3, 20))) for _ in range(150)]
    ix = decontam.Index(list(range(150)), lines)
    for _ in range(30):
        terms = np.unique(rng.integers(0, len(ix.terms), 25))
        full = np.zeros(150)
        for t in terms:
            full[ix.items[ix.first[t] : ix.first[t + 1]]] += ix.impact[ix.first[t] : ix.first[t + 1]]
        assert sorted(i for i, _ in ix.search(terms, 0.3)) == np.flatnonzero(full >= 0.3).tolist()


def labelled(spark, bad, n=240):
    rng = np.random.default_rng(7)
    rows, marks = [], []
    for i in range(n):
        w = [f"w{rng.integers(200)}" for _ in range(40)]
        y = int(rng.random() < 0.4)
        if y:
            w[5:8] = bad
        rows.append((i, " ".join(w)))
        marks.append((i, 1 - y, y))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int"), dict((m[0], m[2]) for m in marks)


def test_classifiers(spark, docs, empty):
    df, marks, truth = labelled(spark, ["awful$$$", "junk%%%", "junk%%%"])
    for module, right in ((toxicity, lambda y: y), (quality, lambda y: 1 - y)):
        model = module.train(df, marks)
        got = module.score(df, model).collect()
        held = [r for r in got if r.held_out]
        assert held and np.mean([r.predicted == right(truth[r.doc_id]) for r in held]) > 0.9
        assert all(0 <= r.score <= 1 for r in got)
        odd = module.score(docs, model).collect()
        assert len(odd) == len(TEXTS) + 1 and not any(np.isnan(r.score) for r in odd)
        assert module.score(empty, model).count() == 0
        module.score(df, module.train(df, marks.limit(0))).collect()


def test_classifiers_labels_and_bounds(spark):
    """Contradicting and repeated labels, repeated ids, a bound on bytes; columns with the operator's own names."""
    df, marks, truth = labelled(spark, ["awful$$$", "junk%%%", "junk%%%"])
    odd = marks.union(marks.where("doc_id < 40").withColumn("quality", 1 - F.col("quality")).withColumn("toxic", 1 - F.col("toxic"))).union(marks)
    wide = df.union(df.where("doc_id < 100")).withColumn("y", F.lit("n")).withColumn("score", F.lit(-1)).withColumn("h", F.lit(0))
    for module, right in ((toxicity, lambda y: y), (quality, lambda y: 1 - y)):
        model = module.train(wide, odd, fit_bytes=60_000)
        got = module.score(wide, model).collect()
        assert len(got) == 340 and len({tuple(r) for r in got}) == 240
        assert np.mean([r.predicted == right(truth[r.doc_id]) for r in got if r.held_out]) > 0.8
        clean = module.train(df, marks.where("doc_id >= 40"))
        assert [r.score for r in module.score(df, clean).orderBy("doc_id").collect()] == pytest.approx([r.score for r in module.score(df, module.train(wide, odd)).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()], abs=1e-6)


def test_toxicity_scores_by_brute_force(spark, docs):
    """The machine's formula, pair by pair, over each text's distinct hashed terms."""
    rng = np.random.default_rng(17)
    bits = toxicity.BITS
    m = toxicity.Machine(-0.3, rng.normal(0, 0.1, 1 << bits).astype(np.float32), rng.normal(0, 0.1, (1 << bits, 3)).astype(np.float32))
    for r in toxicity.score(docs, m).collect():
        line = TEXTS[r.doc_id] if r.doc_id is not None else BASE
        values, _ = toxicity.terms(text.text_of(pa.array([line], pa.string())))
        spelled = {x[:n] for x in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (line or "").lower()) for n in (3, 4, 5, 6, len(x)) if n <= len(x)}
        assert len(values) <= len(spelled) * 2
        z = m.bias + float(m.weights[values].sum())
        z += sum(float(m.factors[a] @ m.factors[b]) for i, a in enumerate(values) for b in values[i + 1 :])
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-4)


def test_toxicity_learns_pairs(spark):
    """An insult or a mention alone isn't toxic, both together are: no sum of weights tells that apart as well."""
    rng = np.random.default_rng(18)
    rows, marks = [], []
    for i in range(900):
        w = [f"w{rng.integers(60)}" for _ in range(12)]
        insult, group = bool(rng.random() < 0.5), bool(rng.random() < 0.5)
        w += ["insultx"] * insult + ["groupy"] * group
        rows.append((i, " ".join(w)))
        marks.append((i, int(insult and group)))
    t = text.text_of(pa.array([x for _, x in rows]))
    values, bounds = toxicity.terms(t)
    feats = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    y = np.array([m for _, m in marks], np.float32)
    model = toxicity.fit(feats[:600], y[:600], epochs=20)
    at = bounds[600:] - bounds[600]
    full = model.raw(values[bounds[600] :], at)
    right = ((full > 0) == (y[600:] == 1)).mean()
    linear = quality.rows_sum(model.weights[values[bounds[600] :]], at)
    best = max(((linear > c) == (y[600:] == 1)).mean() for c in linear)
    assert right > 0.95 and right >= best


def test_quality_scores_by_brute_force(spark, docs):
    """The mean of the vectors of all words, n-grams and pairs, occurrence by occurrence, then the softmax."""
    rng = np.random.default_rng(19)
    m = quality.Model(rng.normal(0, 1, (1 << quality.BITS, 4)).astype(np.float32), rng.normal(0, 1, (2, 4)), rng.normal(0, 1, 2))
    for r in quality.score(docs, m).collect():
        line = TEXTS[r.doc_id] if r.doc_id is not None else BASE
        f = quality.Features(text.text_of(pa.array([line], pa.string())))
        every = [i for u in f.which for i in f.ids[f.bounds[u] : f.bounds[u + 1]]] + f.pairs.tolist()
        w = words(line)
        grams = sum(1 + sum(max(len(x) - n + 1, 0) for n in quality.GRAMS) for x in w)
        assert len(every) == grams + max(len(w) - 1, 0)
        h = m.vectors[every].mean(0) if every else np.zeros(4)
        z = m.softmax @ h + m.bias
        assert r.score == pytest.approx(float(np.exp(z[1]) / np.exp(z).sum()), abs=1e-4)


def test_lm_scoring_awkward(spark, docs, empty):
    """No target, repeated target ids, ties, very long texts, clashing columns."""
    df = spark.createDataFrame([(1, "a b " * 20_000, "t"), (2, "a b c", "t"), (2, "a b c", "t"), (3, "x" * 200_000, "t"), (None, "a c", "t")], "doc_id long, text string, target string")
    none = lm_scoring.train(df, df.select("doc_id").limit(0))
    plain = lm_scoring.score(df, *none).collect()
    assert len(plain) == 5 and not any(np.isnan(r.score) for r in plain)
    ids = spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")
    models = lm_scoring.train(df, ids)
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in lm_scoring.score(models[1].corpus, *models).collect()), key=str)
    assert [n for _, n, _ in got] == [40_000, 3, 3, 1, 2] and got[1] == got[2]
    assert got[1][2] < got[0][2]


def test_lm_scoring(spark, docs, empty):
    df, marks, truth = labelled(spark, ["spam", "spam", "spam"])
    target = marks.where("quality = 1").select("doc_id")
    vocab, pair = lm_scoring.train(df, target)
    got = {r.doc_id: r for r in lm_scoring.score(df, vocab, pair).collect()}
    good = [got[d].score for d, y in truth.items() if not y]
    assert max(good) < min(got[d].score for d, y in truth.items() if y)
    # brute force over one document
    line = {r.doc_id: r.text for r in df.collect()}[3]
    _, place, pairs = vocab.read(text.text_of(pa.array([line])))
    assert got[3].n_tokens == 40 and got[3].target_loss == pytest.approx(float(np.mean(pair.pairs[0][pairs] + pair.words[0][place])), abs=1e-5)
    # the chances of all words after any word sum to 1
    chance = np.exp(-pair.pairs.astype(float)).reshape(2, lm_scoring.CLASSES, -1).sum(2)
    assert np.allclose(chance, 1, atol=1e-3)
    odd = lm_scoring.score(docs, vocab, pair).collect()
    assert [r.score for r in odd if r.n_tokens == 0] == [0.0] * 3
    assert lm_scoring.score(empty, *lm_scoring.train(empty, target)).count() == 0


@pytest.mark.parametrize(("vocabulary", "hot"), [(1200, 512), (1 << 16, 512), (1200, 3)])
def test_lm_scoring_counts_all_pairs(spark, monkeypatch, vocabulary, hot):
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{int(rng.zipf(1.15)) % 9000}" for _ in range(300))) for i in range(120)]
    rows += [(None, "w1 w8000 alone"), (500, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = {i for i in range(0, 120, 3)}
    vocab, pair = lm_scoring.train(df, spark.createDataFrame([(i,) for i in target], "doc_id long"), vocabulary=vocabulary)
    kinds = {w for _, t in rows for w in t.split()}
    assert len(kinds) > 2000 > lm_scoring.SINGLE
    single, ones = {}, {}
    for w in kinds:
        _, place, _ = vocab.read(text.text_of(pa.array([w])))
        single[w], ones[w] = int(vocab.classes[place[0]]), int(place[0])
    prior, added, end = lm_scoring.PRIOR, lm_scoring.ADDED, len(vocab.words)
    losses, tokens = {}, [sum(len(t.split()) for d, t in rows if d in target), sum(len(t.split()) for _, t in rows)]
    for k in (0, 1):
        scale = 1.0 if k == 0 else tokens[0] / tokens[1]
        c, c2, cc = {}, {}, {}
        for d, t in rows:
            if k == 0 and d not in target:
                continue
            for v, w in zip([None, *t.split()], t.split()):
                c[w] = c.get(w, 0) + scale
                c2[v, w] = c2.get((v, w), 0) + scale
                cc[v, single[w]] = cc.get((v, single[w]), 0) + scale
        rare = sum(n for w, n in c.items() if ones[w] == end) + added * (sum(p == end for p in ones.values()) + 1)
        for d, t in rows:
            total = 0.0
            for v, w in zip([None, *t.split()], t.split()):
                of_class = (c.get(w, 0) + added) / rare if ones[w] == end else np.exp(-float(pair.words[k][ones[w]]))
                row = lm_scoring.START if v is None else single[v]
                by_class = np.exp(-float(pair.pairs[k][row * lm_scoring.CLASSES + single[w]]))
                if v is None or single[v] < lm_scoring.SINGLE:
                    within = 1.0 if single[w] < lm_scoring.SINGLE else (c2.get((v, w), 0) + prior * of_class) / (cc.get((v, single[w]), 0) + prior)
                    total -= np.log(by_class * within)
                else:
                    total -= np.log((c2.get((v, w), 0) + prior * by_class * of_class) / (c.get(v, 0) + prior))
            losses.setdefault(d, []).append(total / len(t.split()))
    for scored in (pair.corpus, df):
        got = lm_scoring.score(scored, vocab, pair).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.target_loss, r.background_loss) == pytest.approx(losses[r.doc_id], abs=1e-4)


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>paragraph</b>&nbsp;here.<p>Short.<div class=ad>Buy</div>
    <form><input name=q><button>Go</button></form><p>Last one<br>of them</p></article><aside>Side</aside><section id="comments"><p>A long reader comment that goes on.</p></section>
    <footer>&copy; Site</footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert html.main_text(page) == "Head & line\n\nFirst paragraph here.\n\nShort.\n\nLast one of them"
    plain = "<body><div><p>" + "Long text of the page. " * 20 + "</p><p>Tail.</p></div><div class=sidebar><p>" + "Other " * 50 + "</p></div>"
    assert html.main_text(plain).endswith("Tail.") and "Other" not in html.main_text(plain)
    for odd in (None, "", "<", "&am", "<p", "<!-- x", "<script>x"):
        assert isinstance(html.main_text(odd), str)
    assert html.main_text("<article><p>cut &amp") == "cut &"


def test_html_regions_follow_the_ratios():
    long = lambda k: f"Dense text of part {k} goes on and on. " * 12
    card = "<article><a href=x>Tea</a> <a href=y>ser</a></article>"
    for box in ("div", "main"):
        got = html.main_text(f"<body><{box}><p>{long(1)}</p><p>Short.</p><p>{long(2)}</p></{box}><div>{"<p><a>x</a></p>" * 4}{card}</div></body>").split("\n\n")
        assert got[:3] == [long(1).strip(), "Short.", long(2).strip()] and "Tea ser" not in got
    # several articles, a low one between and one beside; a seed outside them
    got = html.main_text(f"<body><div><article><p>{long(1)}</p></article>{card}<article><p>{long(2)}</p></article>{card}</div><p>{long(3)}</p></body>")
    assert got.split("\n\n") == [long(1).strip(), "Tea ser", long(2).strip(), "Tea ser", long(3).strip()]
    # plain containers only: the tail of the region stays, navigation between regions doesn't
    got = html.main_text(f"<div><p>{long(1)}</p><p>Tail.</p></div><nav>{long(9)}</nav><p>Low.</p><div><p>{long(2)}</p></div>")
    assert got.split("\n\n") == [long(1).strip(), "Tail.", "Low.", long(2).strip()]
    assert html.main_text("<nav>" + long(1) + "</nav><article><p>Only.</p></article>") == "Only."


def test_html_ratios_decide(monkeypatch):
    """With constant or reversed ratios other regions are chosen: they aren't decoration."""
    long = "A dense line of the text that goes on and on. " * 10
    links = "".join(f"<p><a href=x>l{k}</a> <a href=y>m{k}</a></p>" for k in range(6))
    page = f"<body><section>{links}</section><section><p>{long}</p><p>{long}</p></section></body>"
    right = html.main_text(page)
    assert right == "\n\n".join([long.strip()] * 2)
    plain = html.ratios
    for change in (lambda lines: np.ones(len(lines)), lambda lines: plain(lines).max() - plain(lines), lambda lines: plain(lines)[::-1]):
        monkeypatch.setattr(html, "ratios", change)
        assert html.main_text(page) != right


def test_html_deep_pages():
    """Deep nesting takes memory and time in proportion."""
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.time()
    got = html.main_text("<div>" * 30_000 + "<p>Inner text that is the page.</p>" + "</p>" * 30_000 + "</div>" * 30_000)
    assert got == "Inner text that is the page." and time.time() - began < 20
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_html_table(spark):
    rows = [(1, "u", "<p>One &amp; two</p>"), (1, "u", "<p>One &amp; two</p>"), (None, None, None), (2, "v", ""), (3, "w", "<script>x</script>"), (4, "x", "<p>" + "long text " * 100_000)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df).collect()), key=str)
    assert len(got) == 6 and got[0] == got[1] == (1, "u", "One & two", 9)
    assert got[2][2:] == got[3][2:] == ("", 0) and got[4][3] == 999_999 and got[5] == (None, None, "", 0)
    assert html.extract(df.limit(0)).count() == 0


def plain_urls(rows, rules=urls.RULES):
    """Verdicts and templates by recursion over plain dictionaries."""
    seen = []
    for d, url in rows:
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r, _ in rules if (lambda o, x: (host == o or host.endswith("." + o)) and path.startswith(x))(r.split("/")[0], "/" + r.partition("/")[2])]
        raw = tuple("*" if re.search("[0-9]", x) else x for x in path.split("/") if x)
        seen.append((d, host, path, max(fits, key=len) if fits else None, raw))
    bad = {r for r, v in rules if v == "block"}

    def above(host):
        labels = host.split(".")
        return list(dict.fromkeys([host, *(".".join(labels[k:]) for k in range(max(len(labels) - urls.DOMAIN, 1), len(labels) + 1))]))

    trees = {}
    for _, host, _, rule, raw in seen:
        for scope in above(host):
            one = trees.setdefault(scope, {}).setdefault(raw, [0, 0, 0])
            for k, x in enumerate((1, rule is not None, rule in bad)):
                one[k] += x

    def grow(items, k, prefix):
        pages = sum(x[0] for x in items.values())
        kids = {}
        for raw in items:
            kids.setdefault(raw[k] if k < len(raw) else "", []).append(raw)
        to = {}
        for seg, raws in kids.items():
            varies = seg == "*" or sum(items[r][0] for r in raws) < urls.RARE * pages
            to.setdefault("*" if seg and varies else seg, []).extend(raws)
        counts = {t: (float(sum(items[r][1] for r in raws)), float(sum(items[r][2] for r in raws))) for t, raws in to.items()}
        rated = sorted((t for t in to if t and counts[t][0]), key=lambda t: (counts[t][1] / counts[t][0], t))
        clusters = [[t] for t in to if t not in rated]
        for j, t in enumerate(rated):
            if j:
                (n, x), (m, y) = counts[t], counts[rated[j - 1]]
                if (x * m - y * n) ** 2 * (n + m) <= urls.Z**2 * (x + y) * ((n + m) - (x + y)) * n * m:
                    clusters[-1].append(t)
                    continue
            clusters.append([t])
        out = {}
        for own in clusters:
            name = own[0] if len(own) == 1 else "{" + min(own) + "..}"
            raws = [r for t in own for r in to[t]]
            if name == "":
                out |= {r: prefix for r in raws}
            elif len(raws) == 1:
                out[raws[0]] = (*prefix, name, *raws[0][k + 1 :])
            else:
                out |= grow({r: items[r] for r in raws}, k + 1, (*prefix, name))
        return out

    templates = {scope: grow(items, 0, ()) for scope, items in trees.items()}
    total = [sum(r is not None for *_, r, _ in seen), sum(r in bad for *_, r, _ in seen)]
    got = {}
    for d, host, path, rule, raw in seen:
        p, some = total[1] / total[0] if total[0] else 0.0, False
        for scope in reversed(above(host)):
            same = [x for r, x in trees[scope].items() if templates[scope][r] == templates[scope][raw]]
            n, x = sum(y[1] for y in same), sum(y[2] for y in same)
            p, some = (x + urls.WEIGHT * p) / (n + urls.WEIGHT), some or n > 0
        verdict = dict(rules)[rule] if rule else "block" if some and p >= urls.PURITY else "allow"
        got.setdefault((d, host, path, rule, verdict, "/".join(templates[host][raw])), 0)
    return got


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/3?q"), (2, None), (3, "nothing"), (4, "http://example.org/en/12"), (5, "x://shop.com/de/1"), (6, "x://shop.com/fr/1"), (7, "x://org"), (None, "http://b.net/en/1#x")]
    rows += [(10 + i, f"http://bad.com/de/{i}") for i in range(20)] + [(40 + i, f"http://bad.com/it/{i}") for i in range(3)]
    rows += [(50, "http://b.net/de/2"), (51, "http://b.net/de/3"), (51, "http://b.net/de/3"), (52, "x://"), (53, "http://c.net/" + "y" * 100_000), (54, "http://" + "a." * 300 + "com/de/1")]
    df = spark.createDataFrame([(d, u, "x", "y", 1) for d, u in rows], "page_id long, url string, host string, rule string, template int")
    out = [tuple(r) for r in urls.judge(df).collect()]
    got = {r[0]: r for r in out}
    assert len(out) == len(rows)
    assert got[1][1:5] == ("a.example.org", "/es/3", "example.org/es/", "block")
    assert got[4][3] == "example.org/en/1" and got[5][3] == "com/de/" and got[6][3] == "com/fr/"
    assert got[2][1:3] == ("", "") and got[3][1] == "" and got[7][3] is None
    # learned from other hosts' labels; without any labels, allowed
    assert got[50][3] is None and got[50][4] == "block" and got[40][4] == "allow"
    assert set(out) == set(plain_urls(rows))
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_deep(spark):
    rows = [(i, f"http://shop.com/de/news/{i}/2/x") for i in range(20)] + [(30, "http://shop.com/7/news/3/4/about")]
    rows += [(40 + i, f"http://bad.com/a/b/c/d/{'de' if i % 2 else 'fr'}/{i}") for i in range(40)]
    rows += [(90, "http://bad.com/a/b/c/d/de/x/y"), (91, "http://bad.com/a/b/c/d/fr/x/y"), (92, "http://a.net/" + "s/" * 9 + "end"), (93, "http://a.net/" + "s/" * 9 + "fin")]
    deep = [("bad.com/a/b/c/d/de/1", "block"), ("bad.com/a/b/c/d/de/3", "block"), ("bad.com/a/b/c/d/fr/", "allow")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.judge(df, rules=deep).collect()
    assert {tuple(r) for r in out} == set(plain_urls(rows, deep)) and len(out) == len(rows)
    got = {r.page_id: r for r in out}
    assert got[45].rule is None and got[45].verdict == "block" and got[45].template == "a/b/c/d/de/*"
    assert got[40].verdict == "allow" and got[92].template == "s/" * 9 + "end"


def test_urls_branches(spark):
    """Rare segments become wildcards; siblings with like shares merge, others stay apart."""
    rng = np.random.default_rng(13)
    rules = (("shop.com/news/a", "block"), ("shop.com/news/b", "allow"), ("shop.com/blog/a", "block"), ("shop.com/blog/b", "allow"), ("shop.com/spam/", "block"))
    rows = [(i, f"http://shop.com/{rng.choice(['news', 'blog', 'spam', 'open'])}/{rng.choice(list('abc'))}{'xyz'[i % 3]}") for i in range(300)]
    rows += [(500 + i, f"http://shop.com/{chr(97 + i)}{chr(97 + i)}q/page") for i in range(4)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()
    assert {tuple(r) for r in out} == set(plain_urls(rows, rules))
    first = {r.path.split("/")[1]: r.template.split("/")[0] for r in out}
    assert first["news"] == first["blog"] == "{blog..}" and first["spam"] == "spam" and first["open"] == "open" and first["aaq"] == "*"


def test_urls_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(12)
    words = ["de", "fr", "es", "en", "a", "b", "c", "7", "x9", "about"]
    rows = [(i, f"http://{rng.choice(['shop.com', 'example.org', 'b.net', 'm.b.net'])}/" + "/".join(rng.choice(words, rng.integers(0, urls.DEPTH + 1)))) for i in range(1500)]
    rows += [(2000 + i, f"http://shop.com/{'q' * (i + 1)}/z") for i in range(60)] + [(None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    want = sorted(con.execute(urls.ORACLE).fetchall(), key=str)
    assert sorted(map(tuple, urls.judge(df).collect()), key=str) == want


def test_pipeline_stages(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, base)
        out.write.parquet(str(tmp_path / str(k)))
        docs, before = spark.read.parquet(str(tmp_path / str(k))), docs
        if k < 4:
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert docs.where("offset < 0").isEmpty()


def test_pipeline_awkward(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables pass through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, hits string, home int, y int, band string"
    rows = [(1, BASE, None, "s", 1, "h", 1, 1, "b"), (1, BASE, None, "s", 1, "h", 1, 1, "b"), (None, BASE, "en", None, None, None, None, None, None), (2, None, "en", "s", 0, "h", 1, 1, "b"), (3, "", "en", "s", 0, "h", 1, 1, "b"), (4, "x" * 100_000, "en", "s", 0, "h", 1, 1, "b")]
    for k, some in enumerate((rows, [])):
        base = str(tmp_path / str(k))
        spark.createDataFrame(some, schema).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([(1, None, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([(None, None), (1, "")] if some else [], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        docs = spark.read.parquet(f"{base}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, base)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert sorted(r.doc_id is None or r.doc_id for r in docs.select("doc_id").collect()) == ([1, 1, True, 2, 3, 4] if some else [])
        assert corpus_pipeline.run(spark, base).where("piece = 0").count() == len(some)


def test_pipeline_rows(spark, tmp_path):
    """The rows of run() against a plain version of the stages, over planted documents."""
    rng = np.random.default_rng(9)
    some = lambda n, k: " ".join(f"{k}{rng.integers(3000)}" for _ in range(n))
    df, marks, truth = labelled(spark, ["awful$$$", "junk%%%", "junk%%%"])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    item, first, second = some(40, "q"), some(150, "n"), some(90, "p")
    near = first.split()
    near[70] = "changed"
    inside = " ".join(second.split()[30:55])
    rows += [(1000, first), (1001, " ".join(near)), (1002, first), (1003, second), (1004, f"{some(30, 'm')} {inside} {some(30, 'm')}")]
    rows += [(1005, f"{some(40, 'm')} {item} {some(40, 'm')}"), (1006, some(60, "m")), (1007, ""), (1008, None)]
    base = str(tmp_path)
    full = spark.createDataFrame([(d, x, "en", "s", len(x or "")) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    full.write.parquet(f"{base}/documents.parquet")
    marks.write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, some(40, "r"))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")

    # the learned stage: its machine's own scores, which must find most of what was planted and nothing else
    judged = toxicity.score(full, toxicity.train(full, marks)).collect()
    toxic = {r.doc_id for r in judged if r.score >= toxicity.THRESHOLD}
    bad = {d for d, y in truth.items() if y}
    assert toxic <= bad and len(toxic) > 0.8 * len(bad)
    kept = [(d, x) for d, x in rows if d not in toxic]
    sets = {d: shingles(x) for d, x in kept}
    linked = {d: min([d, *(e for e in sets if sets[d] and sets[e] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]))]) for d in sets}
    kept = [(d, x) for d, x in kept if linked[d] == d]
    assert not {1001, 1002} & {d for d, _ in kept}
    seen: dict[tuple, int] = {}
    for d, x in kept:
        for i in range(len(words(x)) - 12):
            g = tuple(words(x)[i : i + 13])
            seen[g] = min(seen.get(g, d), d)
    cut = []
    for d, x in kept:
        w = words(x)
        gone = {j for i in range(len(w) - 12) if seen[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        cut.append((d, " ".join(y for j, y in enumerate(w) if j not in gone)))
    assert len(words(dict(cut)[1004])) == 60
    cut = [(d, x) for d, x in cut if item not in x]
    assert 1005 not in dict(cut)
    tok = packing.Tokenizer(packing.default_tokenizer())
    want = {d: np.array([*tok.ids(x), 2], "<u4") for d, x in cut}

    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, base).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == want.keys()
    for d, own in got.items():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and sum(r.length for r in own) == len(want[d])
        assert all(zlib.crc32(want[d][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_filter_of_ids(spark, monkeypatch):
    """No row of the set is lost, however small the filter; a filter of the usual size lets few others through."""
    rows = spark.range(-3000, 3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("_word")).unionByName(spark.createDataFrame([(None, "x")], "doc_id long, _word string"))
    ids = spark.range(-3000, 3000, 7).select("id")
    want = {r.id for r in ids.collect()}
    for words, most in ((common.FILTER_WORDS, 1400), (1024, 6001)):
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        got = [r.doc_id for r in common.may_be_among(rows.select("doc_id"), "doc_id", ids).collect()]
        assert want <= set(got) and len(got) <= most
        left = common.not_among(rows, "doc_id", ids)
        kept = [r.doc_id for r in left.collect()]
        assert left.columns == ["doc_id", "_word"] and kept.count(None) == 1
        assert sorted(k for k in kept if k is not None) == sorted(set(range(-3000, 3000)) - want)
    assert common.may_be_among(rows.select("doc_id"), "doc_id", ids.limit(0)).count() == 0
    assert common.not_among(rows, "doc_id", ids.limit(0)).count() == 6001
