"""The pipeline's stages against brute force, each on what the one before kept."""

from collections import Counter

import corpus_pipeline as C
import numpy as np
from fieldloom.llm import factor_machine
from fieldloom.llm.common import table
from pyspark.sql import functions as F

from .test_operators import brute_components, brute_lines, brute_targets, check_sequences, words


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        assert k == 4 or docs.columns == columns
    before = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    for r in kept[0]:
        n, _, _, _, repeats = brute_lines(before[r.doc_id].text)
        assert n >= 10 and 100 * repeats <= 20 * n and r.n_chars == len(r.text)
        assert set(r.text.split("\n")) <= set(before[r.doc_id].text.split("\n"))
    machine = factor_machine.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    for lo, hi, at, index, value in factor_machine.rows_of_features([r.text for r in kept[0]], [r.n_chars for r in kept[0]]):
        good = 1 / (1 + np.exp(-machine.logits(at, index, value))) >= 0.3
        assert {r.doc_id for r, g in zip(kept[0][lo:hi], good, strict=True) if g} == {r.doc_id for r in kept[1]} & {r.doc_id for r in kept[0][lo:hi]}
    assert {r.doc_id for r in kept[2]} == {int(c) for _, _, c, _ in brute_components([(r.doc_id, r.text) for r in kept[1]])}
    sizes = Counter()
    for r in kept[2]:
        sizes[r.source] += len(words(r.text))
    target, got = brute_targets(dict(sizes)), Counter()
    for r in kept[3]:
        got[r.source] += len(words(r.text))
    longest = max(len(words(r.text)) for r in kept[2])
    assert all(target[s] - 1 <= got[s] <= target[s] + 4 * longest for s in target)
    assert Counter(r.doc_id for r in kept[4] if r.piece == 0) == Counter(r.doc_id for r in kept[3])
    check_sequences(kept[4], 4096)


def test_run(spark, sf):
    assert C.run(spark, sf).count() > 0


def test_stages_on_odd_rows(spark, sf, docs, empty):
    """Null, empty, blank and long texts, repeated rows, null ids and sources, and columns with the names that stages use inside."""
    odd = docs.withColumns({c: F.lit("x") for c in ("judged", "Score", "kept", "mixed", "SLOT", "__judged", "__kept")})
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, r.text)
    for name, stage in C.STAGES:
        got = stage(spark, odd, sf)
        assert stage(spark, odd.filter("false"), sf).count() == 0
        if name == "best-fit packing":
            assert got.filter("piece = 0").count() == odd.count()
            continue
        assert got.columns == odd.columns and got.dtypes == odd.dtypes
        kept = got.collect()
        assert {r.doc_id for r in kept} <= set(texts) and all(r.judged == r.kept == r.mixed == "x" for r in kept)
        if name == "quality rules":  # none without ten words stays
            assert all(len(words(r.text)) >= 10 or r.text != texts[r.doc_id] for r in kept) and not {0, 1, 2, 3} & {r.doc_id for r in kept}
        if name == "n-gram Jaccard join":  # the least id of each group, both rows that share it, and rows without an id
            ids = [r.doc_id for r in kept]
            assert 8 not in ids and ids.count(7) == 2 and ids.count(None) == 1 and {0, 1, 2, 3} <= set(ids)
        if name == "mixing sources to target weights":
            assert all(r.text and words(r.text) for r in kept)


def test_chain_on_odd_rows(spark, sf, docs, tmp_path):
    now = docs
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
    check_sequences(now.collect(), 4096)
