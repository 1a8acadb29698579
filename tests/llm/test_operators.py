"""Each operator against a brute-force version, on edge cases and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import backoff, components, factor_machine, hashing, jaccard_join, license_rules, line_rules, mixing, packing, url_templates, vector_search, warc

from fieldloom.session import stored

from .conftest import rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


# op1


def brute_sets(items):
    sets = []
    for _, text in items:
        w = words(low(text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return sets


def brute_components(items):
    sets = brute_sets(items)
    n, parent = len(items), list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and items[i][0] is not None and items[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = defaultdict(lambda: math.inf)
    for i in range(n):
        if items[i][0] is not None:
            least[root(i)] = min(least[root(i)], items[i][0])
    return sorted((str(items[i][0]), len(sets[i]), str(least[root(i)] if items[i][0] is not None else None), links[i]) for i in range(n))


def test_join_edges(docs, empty):
    got = jaccard_join.join_documents(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute_components([r[:2] for r in rows()])
    assert jaccard_join.join_documents(empty).count() == 0
    kept = sorted(str(r.doc_id) for r in jaccard_join.keep_one(docs).select("doc_id").collect())
    assert "8" not in kept and "6" not in kept and kept.count("7") == 2 and kept.count("None") == 1


def test_join_blocks_and_table(spark, sf):
    """Small blocks make every cluster a set of block pairs."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    extra = d.filter("doc_id < 30").select((F.col("doc_id") + 100000).alias("doc_id"), F.concat_ws(" ", F.lit("word"), "text").alias("text"))
    both = d.select("doc_id", "text").unionByName(extra)
    want = brute_components([(r.doc_id, r.text) for r in both.collect()])
    R = jaccard_join.JoinRules
    for rules in (R(), R(block_members=1, salts=1, list_groups=2), R(heavy_share=2), R(heavy_share=100000, list_groups=1, block_members=3), R(list_groups=1000, hot_share=1, salts=2)):
        got = jaccard_join.join_documents(both, rules=rules).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == want


def family(rng, n, changed):
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(changed):
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_join_families(spark):
    """Families of near copies below and above the length of listed pairs, some of which link in part only."""
    rng = random.Random(11)
    texts = [t for n in (2, 3, 9, 17, 40) for changed in (1, 2) for t in family(rng, n, changed)]
    texts += [f"{t} tail{k % 3}" for k, t in enumerate(family(rng, 1, 0) * 12)]
    items = list(enumerate(texts))
    rng.shuffle(items)
    frame = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    for rules in (jaccard_join.JoinRules(), jaccard_join.JoinRules(block_members=4)):
        got = jaccard_join.join_documents(frame, rules=rules).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute_components(items)


def test_chains_without_links_stay_apart(spark):
    """Each document shares a passage with the next, none links: hardly any of them may meet, and copies of texts grow with the chain."""
    rng = random.Random(12)
    passages = [" ".join(f"p{rng.randrange(10**8)}" for _ in range(24)) for _ in range(601)]
    frame = spark.createDataFrame([(k, f"{passages[k]} {passages[k + 1]}") for k in range(600)], "doc_id long, text string").repartition(4)
    rules, met = jaccard_join.JoinRules(), {}
    for n in (150, 600):
        docs = frame.filter(F.col("doc_id") < n)
        rows = jaccard_join.features(docs, rules)
        classes = rows.groupBy("owner").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        found = jaccard_join.meetings(jaccard_join.prefix_table(docs, n, rules, 4), classes, rules)
        sides = found.groupBy("cluster", "bi", "bj").agg(F.sum(F.expr("int(side = 0)")).alias("x"), F.sum("side").alias("y")).collect()
        assert all(s.bi == -1 for s in sides)
        met[n] = sum(s.x * s.y for s in sides)
        assert met[n] <= n / 2
    assert met[600] <= 4 * max(met[150], 30) * 1.5


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (3, 10)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6}


def test_hashes_do_not_depend_on_company():
    texts = [None, "", "a b c d e f g", "A\tB c  d e\nf g", "x", "of the the of", "the of of the"]
    alone = [next(hashing.shingle_sets([t])).tolist() for t in texts]
    assert [s.tolist() for s in hashing.shingle_sets(texts)] == alone
    assert alone[2] == alone[3] and alone[5] != alone[6] and alone[0] == []


# op2


def test_tokens_and_packing(docs, empty):
    rules = packing.PackRules(packing.public_vocabulary())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(rules.vocabulary)
    want = []
    for i, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k, a, len(ids[a : a + 4096]), zlib.crc32(np.asarray(ids[a : a + 4096], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = packing.pack_documents(docs).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_sequences(got, 4096)
    assert packing.pack_documents(empty).count() == 0


def check_sequences(got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def whole_ids(t, text):
    return np.asarray(t.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


ODD = ["Á é.,  'S it's, don't!? x'll, İstanbul ΣΣ. a.b,c ,,a1.2! \u0085z", "ﬁx ²³ 中文。好, Å x́, .x", "<|endoftext|>a b<|x", "ÉTÉ, ñandú? ß! ×,÷. ŉ ǅ", "a_b, _ c-", "J\u030c T\u0308. e\u0301, E\u0301", "a\0b \0 c", "", " \n", "\u0301x y", "x\u00a0y,\u2003z", "-" * 300 + "é" * 300]


def test_tokenizer_matches():
    t = packing.WordTokenizer(packing.public_vocabulary(), 1000)
    assert t.by_words
    assert list(t.encode(pa.array([*ODD, None]))) == [whole_ids(t, x) for x in [*ODD, ""]]
    rng = random.Random(3)
    signs = list("abcxyzABJT  \n\t.,'’!?-()0179éÉßÿ÷×àñŉǅİıΣςσ中文한\u1112\u1161\u0301\u030c\u0323\u00a0\u0085\u200b\u2028\0<|>") + ["'s", "'ll ", ". ", ", ", "the ", "été"]
    for most in (8, 100_000):  # generations of words that are dropped all the time, and kept
        t = packing.WordTokenizer(packing.public_vocabulary(), most)
        for _ in range(60):
            texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(40)]
            assert list(t.encode(pa.array(texts).slice(7, 25))) == [whole_ids(t, x) for x in texts[7:32]]


def test_other_vocabularies_encode_whole_texts():
    t = packing.WordTokenizer(packing.public_vocabulary("byte_bpe_50k.json"), 1000)
    assert not t.by_words
    assert list(t.encode(pa.array(ODD))) == [whole_ids(t, x) for x in ODD]


def brute_bins(lengths, c):
    """The least number of bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in sorted({b: j for j, b in enumerate(bins)}.values()):
            if bins[k] + lengths[i] <= c:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_plans_are_valid_and_near_best():
    rng = np.random.default_rng(2)
    over = 0
    for _ in range(60):
        c = int(rng.choice([7, 12, 20]))
        lengths = rng.integers(1, c + 1, rng.integers(1, 10)).tolist()
        p = packing.Plan(dict(Counter(lengths)), c)
        used = defaultdict(int)
        for length, run in p.arrays().items():
            assert sorted(run[:, 0].tolist()) == [0, *sorted(run[:, 1].tolist())[:-1]] and run[:, 1].max() == lengths.count(length)
            for a, b, first, per, _ in run.tolist():
                for k in range(b - a):
                    used[first + k // per] += length
        assert len(used) == p.sequences and max(used.values()) <= c
        over += p.sequences - brute_bins(lengths, c)
    assert over <= 2
    with pytest.raises(ValueError):
        packing.Plan({9: 1}, 8)


# op3


def brute_search(items, k, every):
    out = {}
    for i, v in items:
        if i % every == 0:
            s = sorted((-float((np.asarray(v) * np.asarray(w)).sum()), j) for j, w in items if j != i)
            out[i] = [(r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return out


def test_search_edges(spark):
    rng = np.random.default_rng(1)
    items = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(60)]
    items += [(100 + i, items[3][1]) for i in range(40)]  # a large class of copies
    bad = [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (205, [1.0, 2.0]), (220, [])]
    frame = spark.createDataFrame(items + bad + items[:2], "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cid", "least", "v", "found", "id")})
    got = defaultdict(list)
    for r in vector_search.search(frame).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_search(items, 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in sorted(got[q])] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in sorted(got[q])], [x[2] for x in want[q]])
    assert vector_search.search(frame.filter("false")).count() == 0
    few = vector_search.search(frame.filter("vec_id < 5")).collect()
    assert len(few) == 4


def test_search_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rules = vector_search.SearchRules(list_size=100)  # many lists
    got = defaultdict(set)
    for r in vector_search.search(v, rules=rules).collect():
        got[r.query_id].add(r.vec_id)
    items = [(r.vec_id, r.embedding) for r in v.collect()]
    x, ids = np.asarray([b for _, b in items], dtype=float), np.asarray([a for a, _ in items])
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        hits, total = hits + len(best & got[int(ids[i])]), total + 20
    assert hits / total >= 0.9


def test_search_recall_with_more_lists_than_beam(spark):
    x = np.random.default_rng(5).normal(size=(8000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in vector_search.search(frame, rules=vector_search.SearchRules(list_size=16, beam=16, visit=1.02, every=100)).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 8000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hits / (80 * 20) >= 0.9


def test_one_long_vector_does_not_flatten_the_rest(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(200, 16)), 30, axis=0) + rng.normal(size=(6000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[17] *= 40
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index, kept = {}, vector_search.calibrated
    try:
        vector_search.calibrated = lambda classes, asked, shared, r: index.update(it=shared.value, rules=kept(classes, asked, shared, r)) or index["rules"]
        got = defaultdict(set)
        for r in vector_search.search(frame, rules=vector_search.SearchRules(list_size=32, every=60)).collect():
            got[r.query_id].add(r.vec_id)
    finally:
        vector_search.calibrated = kept
    hits = 0
    for q in range(0, 6000, 60):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hits / (100 * 20) >= 0.9 and index["it"].far and index["it"].norm < 2
    _, take = index["it"].lists_of(x[::60], index["rules"], True)
    assert take.sum(axis=1).mean() < len(index["it"].graph.centroids) / 3


# op4


def test_archives(spark, tmp_path):
    big = "x" * 1500 + "\x1f\x8b\x08 é"
    items = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (7, "u", None), (8, "u", ""), (9, "u", "small"), (10, "u", "small"), (None, "n", big), (11, "http://c/", "y" * 300000)]
    pages = spark.createDataFrame(items, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "payload", "first", "id", "path")})
    rules = warc.WarcRules(archive_bytes=2000, split_bytes=97, read_bytes=64)
    archives = stored(warc.write_archives(pages.repartition(2), str(tmp_path / "w"), rules))
    got = warc.read_archives(archives, str(tmp_path / "w"), rules).collect()
    want = []
    for i, _, h in items:
        p = (h or "").encode()
        same = [j for j, _, g in items if j is not None and (g or "").encode() == p]
        first = max(same) if len(p) >= 1000 and i is not None else i
        want.append((str(i), len(p), hashlib.sha1(p).hexdigest(), "response" if i == first else "revisit", str(None if i == first else first)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    empty = stored(warc.write_archives(pages.filter("false"), str(tmp_path / "e"), rules))
    assert warc.read_archives(empty, str(tmp_path / "e"), rules).count() == 0


def test_archive_keeps_long_urls(spark, tmp_path):
    url = "https://a.example.com/" + "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(20_000))
    assert len(url) > 1 << 20
    pages = spark.createDataFrame([(1, "https://a.example.com/x", "one"), (2, url, "two"), (3, url + "/3", "x" * 3000)], "page_id long, url string, html string")
    archives = stored(warc.write_archives(pages, str(tmp_path)))
    got = {r.page_id: r.payload_bytes for r in warc.read_archives(archives, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 3, 3: 3000}


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    """Adaptive execution must not merge the ranges, whose rows are tiny, into one task."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    pages = spark.range(64).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.expr("repeat(md5(cast(id as string)), 40)").alias("html")).repartition(2)
    archives = stored(warc.write_archives(pages, str(tmp_path)))
    read = warc.read_archives(archives, str(tmp_path), warc.WarcRules(split_bytes=1024)).select("page_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.page_id for r in read) == list(range(64))
    assert len({r.task for r in read}) >= 6


def test_reader_survives_false_members(tmp_path):
    """Magic bytes inside members, and junk between them, are no records."""
    one = warc.record([("WARC-Type", "resource")], b"\x1f\x8b\x08" * 50)
    stored_raw = zlib.compressobj(0, zlib.DEFLATED, 31)
    two = stored_raw.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 600\r\n\r\n" + b"\x1f\x8b\x08\x00WARC/1." * 60) + stored_raw.flush()
    data = b"junk\x1f\x8b\x08junk" + one + b"\x1f\x8b\x08" + two + one
    path = tmp_path / "a.gz"
    path.write_bytes(data)
    system, root = warc.open_folder(str(tmp_path))
    for step in (13, 100, len(data)):
        found = [r for k in range(0, len(data), step) for r in warc.read_range(system, f"{root}/a.gz", k, min(k + step, len(data)), warc.WarcRules(read_bytes=32), True)]
        assert [r["payload_bytes"] for r in found] == [150, 600, 150]
        assert found[0]["payload"] == b"\x1f\x8b\x08" * 50


# op5


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def brute_draw(got):
    """The slot of each word of each source's repeated stream, and how many words are drawn, by walking the golden-ratio points (blocks of one word)."""
    target = {r.source: (r.target, r.source_size) for r in got}
    names = sorted((s for s in target if s is not None), key=lambda s: s.encode()) + [None] * (None in target)
    every, total = sum(t for t, _ in target.values()), sum(n for _, n in target.values())
    upto, his = 0.0, []
    for s in names:
        upto += target[s][0]
        his.append(upto / every)
    drawn = {s: {} for s in names}
    for k in range(total):
        x = (k + 0.5) * 0.6180339887498949
        s = names[next(i for i, h in enumerate(his) if x - math.floor(x) < h)]
        drawn[s][len(drawn[s])] = k
    for i, s in enumerate(names):
        t, n = target[s]
        want = min(round(t), 3 * n)
        if want <= 16:
            drawn[s] = {w: drawn[s].get(w, total + i) for w in range(want)}
        drawn[s] = {w: k for w, k in drawn[s].items() if w < 3 * n}
    return drawn, {s: len(d) for s, d in drawn.items()}


def test_mix(docs, empty, spark):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows():
        sizes[source] += len(words(text))
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 10 for s in want)
    drawn, quota = brute_draw(got)
    for r in got:
        mine = [k for e in range(3) for k in [drawn[r.source].get(r.start + e * r.source_size)] if r.size]
        assert r.slots == (mine if r.size else [None] * 3)
        assert r.taken == sum(max(0, min(quota[r.source], r.start + e * r.source_size + r.size) - (r.start + e * r.source_size)) for e in range(3) if r.size)
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 0
    place = sorted((k, str(r.doc_id), str(r.source)) for r in got if r.doc_id != 7 for k in r.slots if k is not None)
    assert [(str(r.doc_id), str(r.source)) for r in kept.collect() if r.doc_id != 7] == [x[1:] for x in place]  # in the order of the schedule
    copies = Counter((r.doc_id, r.source) for r in kept.select("doc_id", "source").collect())
    by = defaultdict(lambda: [0, 0])
    for r in got:
        by[(r.doc_id, r.source)][0] += r.taken
        by[(r.doc_id, r.source)][1] += r.size
    n = Counter((i, s) for i, _, _, s, _ in rows())
    assert copies == Counter({k: n[k] * math.ceil(t / z) for k, (t, z) in by.items() if t})


def test_schedule_is_even(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from fieldloom.llm.common import count_words

    targets = mixing.source_targets(docs.select("source", count_words(F.col("text")).alias("size")))
    slots = sorted((r.slot, r.src) for r in mixing.schedule(targets).select("slot", "src").collect())
    share = {r.src: r.hi - r.lo for r in targets.collect()}
    half = Counter(s for _, s in slots[: len(slots) // 2])
    for s, p in share.items():
        assert abs(half[s] - p * len(slots) / 2) < 40


# op6


def test_classifier_edges_and_held_out(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None)], labels.schema))
    machine = factor_machine.train(table, odd)
    good = factor_machine.score(table, machine).join(labels, "doc_id").filter(factor_machine.held_out(F.col("doc_id"))).toPandas()
    assert ((good.score >= 0.3).astype(int) == good.quality).mean() > 0.95
    edge = factor_machine.score(docs, machine).collect()
    assert len(edge) == len(rows()) and all(0 <= r.score <= 1 for r in edge)
    assert factor_machine.score(empty, machine).count() == 0
    kept = factor_machine.keep_good(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in edge)
    none = factor_machine.train(table, labels.filter("false"))
    assert {r.score for r in factor_machine.score(docs, none).collect()} == {0.5}
    again = factor_machine.train(table, odd)
    assert np.array_equal(again.weights, machine.weights)
    # fewer entries than the sample has: the first rows that fit, as if the labels ended there
    order = sorted({r.doc_id for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    texts = {r.doc_id: r for r in table.collect()}
    order = [i for i in order if i in texts]
    entries = [len(index) for i in order[:60] for _, _, _, index, _ in factor_machine.rows_of_features([texts[i].text], [texts[i].n_chars])]
    rules = factor_machine.ClassifierRules(sample_entries=sum(entries[:50]), steps=20)
    few = factor_machine.train(table, labels.filter(F.col("doc_id").isin(order[:50])), factor_machine.ClassifierRules(steps=20))
    assert np.array_equal(factor_machine.train(table, labels, rules).weights, few.weights)
    # the identity against a sum over pairs
    at, index, value = np.array([0, 3]), np.array([1, 5, 9]), np.array([0.5, -1.0, 2.0])
    v = machine.factors[index] * value[:, None]
    pairs = sum(v[i] @ v[j] for i in range(3) for j in range(i))
    assert machine.logits(at, index, value)[0] == pytest.approx(machine.bias + machine.weights[index] @ value + pairs, rel=1e-4)


def passages(spark, each, n):
    """n texts of two passages of 24 words, each passage in ``each`` texts."""
    rng = random.Random(1)
    every = [" ".join(f"w{rng.randrange(40000)}" for _ in range(24)) for _ in range(2 * n // each)]
    slots = [p for p in every for _ in range(each)]
    rng.shuffle(slots)
    return spark.createDataFrame([(i, slots[2 * i] + " " + slots[2 * i + 1]) for i in range(n)], "doc_id long, text string").repartition(8)


@pytest.mark.parametrize("each", [20, 100])
def test_shared_passages_are_compared_in_proportion_to_the_texts(spark, monkeypatch, each):
    """Texts that share a passage with many others, without links, are not drawn into one cluster of all."""
    met, whole = [], jaccard_join.verify

    def counted(texts, rules):
        sides = texts.groupBy("cluster", "bi", "bj").agg(F.count(F.when(F.col("side") == 0, 1)).alias("a"), F.count(F.when(F.col("side") == 1, 1)).alias("b"))
        met.append(sides.agg(F.sum(F.when(F.col("bi") == F.col("bj"), F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b")))).first()[0] or 0)
        return whole(texts, rules)

    monkeypatch.setattr(jaccard_join, "verify", counted)
    for n in (1000, 2000):
        jaccard_join.join_documents(passages(spark, each, n)).count()
    assert all(pairs <= n * each / 2 for pairs, n in zip(met, (1000, 2000), strict=True))


# op7


def brute_lines(text):
    w = words(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_phrases_of_page_furniture_fail_short_lines_only(spark):
    prose = "In the evening he told his sister that he wanted to read more about the sea, and she gave him the three old books that their father had kept in the attic for all those years, because nobody else in the village ever asked for them."
    short = "Read more about cookies here."
    part = "The thread moreover held the two sails together until the storm had passed."
    frame = spark.createDataFrame([(0, prose), (1, prose + "\n" + short), (2, part)], "doc_id long, text string")
    got = {r.doc_id: r.j for r in frame.select("doc_id", line_rules.judge(F.col("text")).alias("j")).collect()}
    assert got[0].kept and got[0].n_lost_words == 0
    assert got[1].kept and got[1].n_lost_words == 5 and got[1].clean_text == prose
    assert got[2].kept and got[2].n_lost_words == 0


def test_lines(docs, empty):
    got = docs.select("doc_id", line_rules.judge(F.col("text")).alias("j")).select("doc_id", "j.*").collect()
    want = sorted((str(i), *brute_lines(t)) for i, t, *_ in rows())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.n_lost_words * 100 <= r.n_words * 40)
    clean = line_rules.clean_documents(docs)
    assert clean.columns == docs.columns and line_rules.clean_documents(empty).count() == 0
    thirteen = clean.filter("doc_id = 13").first()
    assert thirteen is None or ("|" not in thirteen.text and "click here" not in thirteen.text)


# op8


def test_urls(spark):
    items = [(1, None), (2, "nope"), (3, "http://A.NET"), (4, "http://a.net/x?y#z"), (5, "HTTP://net/x#y"), (6, "x://www.Example.com/de/a/b/c/d/e"), (7, "x://notexample.com/de/"), (8, "://org/fr/é"), (9, "http://example.net/en/1"), (9, "http://example.net/en/1"), (10, "http://b.example.net/EN/"), (None, "http://x.org/fr?"), (11, "http://x.org#/fr/")]
    items += [(100 + i, f"http://sub{i % 2}.example.com/{'de' if i % 3 else 'en'}/{i}.html") for i in range(30)]
    frame = spark.createDataFrame(items, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "n", "template", "shape", "rule", "h", "t", "s")})

    def brute(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None

    got = url_templates.filter_urls(frame).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == sorted((str(i), *brute(u)[:2], str(brute(u)[2])) for i, u in items)
    verdict = {i: brute(u)[3] for i, u in items}
    assert all(r.verdict == verdict[r.page_id] for r in got if r.rule) and all(r.verdict in ("allow", "block") for r in got)
    assert url_templates.filter_urls(frame.filter("false")).count() == 0


def test_templates_reject_bad_branches(spark):
    urls = [("h", ["news", "{n}"], "block")] * 12 + [("h", ["news", "{n}"], None)] + [("h", ["blog", "{n}"], "allow")] * 12 + [("k", [f"s{i}"], None) for i in range(40)]
    t = {(r.host, tuple(r.shape)): (r.template, r.blocked_share) for r in url_templates.templates(spark.createDataFrame(urls, "host string, shape array<string>, verdict string")).collect()}
    assert t[("h", ("news", "{n}"))][1] > 0.5 > t[("h", ("blog", "{n}"))][1] and t[("k", ("s1",))][0] == "/*"


def test_undecided_urls_are_judged_by_their_like(spark):
    """No rule decides example.org/de/ nor example.com/en/: their templates' shares come from the domain, then from all hosts."""
    urls = [f"http://{h}.example.net/{p}/{k}" for h in "ab" for p in ("de", "en") for k in range(6)] + [f"http://c.example.org/{p}/{k}" for p in ("de", "en", "xx") for k in range(3)] + ["http://d.example.com/en/7"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rules in (url_templates.UrlRules(), url_templates.UrlRules(salts=2, hot_share=1)):
        got = {r.page_id: r for r in url_templates.filter_urls(frame, rules=rules).collect()}
        labels = [(got[k].host, re.sub("[0-9]+$", "{n}", got[k].path), got[k].verdict) for k in got if got[k].rule]
        seen = set()
        for r in got.values():
            shape, domain = re.sub("[0-9]+$", "{n}", r.path), ".".join(r.host.split(".")[-2:])
            share = 0.1
            for mine in (lambda h: True, lambda h: h.endswith(domain), lambda h: h == r.host):
                known = [v for h, s, v in labels if s == shape and mine(h)]
                share = (known.count("block") + 4 * share) / (len(known) + 4)
            assert abs(r.blocked_share - share) < 1e-12
            if not r.rule:
                assert r.verdict == ("block" if share >= 0.5 else "allow")
                seen.add((r.host, shape, r.verdict))
        assert seen == {("c.example.org", "/de/{n}", "block"), ("c.example.org", "/en/{n}", "allow"), ("c.example.org", "/xx/{n}", "allow"), ("d.example.com", "/en/{n}", "allow")}


# op9


def test_large_hosts_and_deep_paths(spark):
    urls = [f"https://a.example.com/de/{k}" for k in range(30)] + [f"https://a.example.com/s{chr(97 + k)}/{k}" for k in range(25)]
    urls += [f"https://b.example.com/u/v/w/x/{a}/y/{k}" for a in ("in", "out") for k in range(5)] + ["https://b.example.com/u/v"]
    got = {r.page_id: r for r in url_templates.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(got) == len(urls)
    assert {got[k].verdict for k in range(30)} == {"block"} and {got[k].template for k in range(30)} == {"/de/{n}"}
    assert {got[k].verdict for k in range(30, 55)} == {"allow"} and {got[k].template for k in range(30, 55)} == {"/*/{n}"}
    assert [got[k].template for k in range(55, 66)] == ["/u/v/w/x/*/y/{n}"] * 10 + ["/u/v"]


@pytest.mark.parametrize("sections", [2, 24, 25, 60])
def test_templates_do_not_depend_on_the_number_of_sections(spark, sections):
    """Sections without labels are one, whatever their number; alike ones are one with them; unlike ones stay."""
    names = [f"s{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(sections)]
    urls = [("a", ["x", s, "{n}"], None) for s in names]
    urls += [("b", [s, "p"], None) for s in names] + [("b", [s, "p"], "block") for s in ("one", "two") for _ in range(9)]
    urls += [("c", [s, "q"], None) for s in names] + [("c", ["bad", "q"], "block")] * 9 + [("c", ["good", "q"], "allow")] * 9
    urls += [("d", [s, "q"], None) for s in ("bad", "good")]
    t = {(r.host, tuple(r.shape)): r.template for r in url_templates.templates(spark.createDataFrame(urls, "host string, shape array<string>, verdict string")).collect()}
    assert {t["a", ("x", s, "{n}")] for s in names} == {"/x/*/{n}"}
    assert {t["b", (s, "p")] for s in [*names, "one", "two"]} == {"/*/p"}
    assert {t["c", (s, "q")] for s in names} == {"/*/q"} and t["c", ("bad", "q")] == "/bad/q" and t["c", ("good", "q")] == "/good/q"
    assert t["d", ("bad", "q")] == "/bad/q" and t["d", ("good", "q")] == "/good/q"  # told apart by other hosts


def test_long_chains_take_no_rounds_of_their_own(spark, monkeypatch):
    written = []
    monkeypatch.setattr(url_templates, "stored", lambda f, keep=url_templates.stored: written.append(1) or keep(f))
    chain = [f"c{k}" for k in range(60)]
    urls = [("h", [*chain, "in"], None), ("h", [*chain, "out"], None), ("h", chain[:30], None), ("g", chain, None)]
    t = {(r.host, len(r.shape)): r.template for r in url_templates.templates(spark.createDataFrame(urls, "host string, shape array<string>, verdict string")).collect()}
    path = "".join(f"/{c}" for c in chain)
    assert t == {("h", 61): path + "/*", ("h", 30): "".join(f"/{c}" for c in chain[:30]), ("g", 60): path} and len(written) < 12


def test_licenses(docs, empty):
    got = docs.select("doc_id", license_rules.scan(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    want = []
    for i, text, *_ in rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        places = [(k, label) for p, label in license_rules.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((str(i), len(w), len(places), str(min(places)[0] if places else None), str(max(places)[0] if places else None), ",".join(sorted({x for _, x in places}))))
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert next(r.labels for r in got if r.doc_id == 12) == "apache,apache-2.0,gpl,gpl-3,mit"
    assert empty.select(license_rules.scan(F.col("text"))).count() == 0
    assert 200 <= len(license_rules.rules()) <= 600


def test_keywords_lose_no_license(spark):
    alone = {
        "This document is proprietary and confidential.": "proprietary",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "Redistribution and use in source and binary forms, with or without modification": "bsd",
        "released under the Apache 2.0": "apache-2.0",
        "runs on FreeBSD license": "bsd-2-clause",
        "an Apache2 license": "apache-2",
        "available under GNU General Public v3": "gpl-3",
        "under the Boost1.0 terms": "bsl-1.0",
    }
    texts = [*alone, "nothing to find here", "a simplified bsd licence", "Artistic2.0", "python2", "wtfpl2.0", "open font1.1", "open database1.0", "business source1.1", "free documentation1.2", "general public3"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", license_rules.normalised(F.col("text")).alias("norm"), license_rules.scan(F.col("text")).alias("s")).select("text", "norm", "s.*").collect()
    for r in got:
        fits = {x["label"] for x in license_rules.rules() if re.search(x["pattern"], r.norm)}
        assert bool(fits) == bool(r.labels) == (r.n_detections > 0) == (r.score > 0), r.text
        assert alone.get(r.text, r.labels) in r.labels.split(",")
        for x in license_rules.rules():  # a match has its rule's keyword, and a text with one is not passed over
            if re.search(x["pattern"], r.norm):
                assert x["keyword"] in r.norm and x["also"] in r.norm and re.search(license_rules.gate(), r.norm)


SCANNED = [(re.compile(r["pattern"]), r["priority"], r["id"], r["label"]) for r in license_rules.rules()]


def brute_scan(text):
    """All rules without any keyword; what lies inside a taken detection of the same or a higher priority is left out."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    norm = " " + " ".join(w) + " " if w else " "
    base = [(k, label) for p, label in license_rules.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    found = []
    for pattern, *told in SCANNED:
        for m in pattern.finditer(norm):
            first = norm[: m.start()].count(" ")
            found.append((first, -(first + m.group().count(" ")), *told))
    kept = []
    for s, e, p, _, label in sorted(found):
        if not any(q <= p and a <= s and -e <= b for a, b, q, _ in kept):
            kept.append((s, -e, p, label))
    best = min([p for _, _, p, _ in kept] + [3] * bool(base), default=None)
    labels = {x for _, x in base} | {x for *_, x in kept}
    return (len(w), len(base), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), {1: 1.0, 2: 0.8, 3: 0.5, None: 0.0}[best], len(kept))


def matching(tree, rng):
    """A random string that a parsed pattern matches, look-ahead aside."""
    out = ""
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                kind, one = rng.choice(arg)
                out += chr(one if str(kind) == "LITERAL" else rng.randint(*one))
            case "MAX_REPEAT":
                out += "".join(matching(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
            case "SUBPATTERN":
                out += matching(arg[3], rng)
            case "BRANCH":
                out += matching(rng.choice(arg[1]), rng)
            case "ASSERT" | "ASSERT_NOT":
                pass
            case other:
                raise ValueError(other)
    return out


def test_every_rule_against_brute_force(spark, sf):
    """Texts made of each rule's own matches, in random company, and the smallest table's texts."""
    rng, rules = random.Random(9), license_rules.rules()
    made = [matching(re._parser.parse(r["pattern"]), rng) for r in rules for _ in range(2)]
    texts = [x + rng.choice([".", " now", "", ", and"]) for x in made] + ["the" + a + " of" + b + "\n" + c.upper() + "!" for a, b, c in (rng.choices(made, k=3) for _ in range(300))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [r[1] for r in rows()]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8).select("i", license_rules.scan(F.col("text")).alias("s")).select("i", "s.*").collect()
    for r in got:
        assert (r.n_words, r.n_base, r.base_labels, r.labels, r.score, r.n_detections) == brute_scan(texts[r.i]), texts[r.i][:500]


def test_longer_rule_wins(spark):
    texts = ["under CC BY-NC-SA 4.0 now", "MPL: Mozilla Public License 2.0", "the mit license mit license", "GNU Lesser General Public License v2.1"]
    got = [r.labels for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(license_rules.scan(F.col("text")).alias("s")).select("s.labels").collect()]
    assert got == ["cc-by-nc-sa-4.0", "mpl-2.0", "mit", "gpl,lgpl-2.1"]


# op10


def test_backoff(docs, empty):
    texts = [(i, words(low(t))) for i, t, *_ in rows()]
    one, two = Counter(), Counter()
    for _, w in texts:
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    total, want = sum(one.values()), []
    for i, w in texts:
        s = math.log(one[w[0]] / total) if w else 0.0
        for a, b in zip(w, w[1:], strict=False):
            s += math.log(two[a, b] / one[a]) if two[a, b] >= 2 else math.log(0.4 * one[b] / total)
        want.append((str(i), len(w), round(s, 6)))
    got = backoff.score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in got) == sorted(want)
    small = backoff.score_documents(docs, rules=backoff.BackoffRules(chunk=50)).collect()
    assert sorted((str(r.doc_id), round(r.log_score, 6)) for r in small) == sorted((a, c) for a, _, c in want)
    assert backoff.score_documents(empty).count() == 0
