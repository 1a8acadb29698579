"""SimHash near-duplicates against brute force, on edge cases, in wide lists and on the smallest tables."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import simhash

from .conftest import rows
from .test_operators import low, words


def brute_fingerprint(text):
    w = words(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """(id, fingerprint hex, least id reachable) of (id, fingerprint) pairs."""
    fps = sorted({f for _, f in items})
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    least = {}
    for i, f in items:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in items), key=str)


def found(docs, rules=simhash.SimhashRules()):
    return sorted((tuple(r) for r in simhash.near_duplicates(docs, rules=rules).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_fingerprints_match_brute_force_whatever_the_block():
    for *_, text in [(0, "a b"), *[(r[0], r[1]) for r in rows()]]:
        for block in (1, 7, 1 << 20):
            assert simhash.fingerprint(None if text is None else text.encode(), simhash.SimhashRules(block=block)) == brute_fingerprint(text)


def test_a_bit_of_exactly_half_the_shingles_is_zero():
    text = "a b c d"  # two shingles
    one, two = (xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d"))
    assert simhash.fingerprint(text.encode()) == one & two


def test_rows_match_brute_force(docs):
    assert found(docs) == brute_components([(r[0], brute_fingerprint(r[1])) for r in rows()])


def test_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.op12_byte_index(spark, sf).collect()), key=str)
    assert got == brute_components(items)


def test_empty_table(empty):
    assert found(empty) == []


def test_only_null_ids_have_a_null_component(spark):
    docs = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (3, "")], "doc_id long, text string")
    assert [r[2] for r in found(docs)] == [3, None, None]


def fingerprint_cloud(n, seed=3):
    """Fingerprints around few centres: up to four flipped bits, plus pairs at exactly two and three bits over all positions."""
    rng = random.Random(seed)
    out = set()
    for centre in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(n):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    for _ in range(200):
        f = rng.getrandbits(64)
        out |= {f, f ^ sum(1 << b for b in rng.sample(range(64), 2)), f ^ sum(1 << b for b in rng.sample(range(64), 3))}
    return sorted(out)


@pytest.mark.parametrize("list_rows", [1, 3, 512])
def test_links_are_all_pairs_at_two_bits_each_once(spark, list_rows):
    fps = fingerprint_cloud(150)
    signed = np.asarray(fps, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    got = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.linked_fingerprints(frame, simhash.SimhashRules(list_rows=list_rows)).collect()]
    assert sorted(got) == sorted((b, a) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2)


def test_wide_lists_pass_on_in_pieces():
    import pyarrow as pa

    lists = np.repeat([4, 5, 9], [3, 9, 2]).astype(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[k : k + 2]), pa.array(np.arange(k, k + 2))], ["list", "fp"]) for k in range(0, 14, 2)]
    seen = list(simhash._lists(iter(batches), 3))
    assert np.concatenate([x[0] for x in seen]).tolist() == lists.tolist()
    assert set(np.concatenate([x[0][x[2]] for x in seen]).tolist()) == {5}
    assert max(len(x[0]) for x in seen) <= 6


def test_a_hot_fingerprint_and_a_hot_component(spark):
    texts = ["same words in all of these"] * 3000 + [f"{k} other words here {k * 7} and more {k * k}" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rules = simhash.SimhashRules(hot_share=2)
    got = simhash.near_duplicates(docs, rules=rules)
    assert got.filter("component_id = 0").count() >= 3000 and got.count() == 3300
    assert got.groupBy("fingerprint").agg(F.countDistinct("component_id").alias("n")).filter("n > 1").count() == 0
