"""Collocations against a brute-force count of all phrases, whatever the chunks, parts and hot prefixes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import collocations

from .conftest import rows
from .test_operators import low


def brute(items, least=100, longest=5, top=2000, percent=100):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in items:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * f[p[i : i + m]]}
        kept = []
        for p, a in found.items():
            if p not in dropped:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(docs, **rules):
    return sorted(tuple(r) for r in collocations.top_phrases(docs, rules=collocations.CollocationRules(**rules)).collect())


@pytest.mark.parametrize("changes", [{}, {"hot_share": 2}, {"chunk": 50}, {"part_rows": 40}, {"filter_bits": 6}, {"longest": 2}, {"top": 7}, {"covered_percent": 50}])
def test_rows_match_brute_force(docs, changes):
    items = [(r[2], r[1]) for r in rows()]
    told = {"least": 3} | changes
    want = brute(items, 3, changes.get("longest", 5), changes.get("top", 2000), changes.get("covered_percent", 100))
    assert found(docs, **told) == want and len(want) > 5


def test_pieces_ties_and_spaces(spark):
    texts = ["A b\tc. a b; a  b", "x a b\nc x a b c", "é ü. É ü é ü", "a a a a a a a", None, "", " \t\x0b"]
    frame = spark.createDataFrame([(None if k % 2 else "und", t) for k, t in enumerate(texts)], "lang string, text string")
    assert found(frame, least=1) == brute([(None, t) for t in texts], 1)


def test_products_beyond_64_bits(spark):
    from pyspark.sql import Row

    frame = spark.createDataFrame([Row(a=3 * 10**14, n=9 * 10**15, l=7 * 10**14, r=5 * 10**14)])
    got = frame.select(F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")).first()[0]
    assert got == 1000 * 3 * 10**14 * 9 * 10**15 // (35 * 10**28)


def test_empty_table(empty):
    assert found(empty) == []


def test_codes_give_words_back():
    rng = np.random.default_rng(1)
    known = np.sort(np.append(rng.integers(1, 1 << 63, 100, dtype=np.uint64), np.uint64(0)))
    words = np.concatenate((known[::3], rng.integers(1, 1 << 63, 50, dtype=np.uint64), [np.uint64(0)]))
    rng.shuffle(words)
    codes = collocations.Codes(known)
    assert (codes.unpack(*codes.pack(words)) == words).all()


def test_a_clash_with_a_frequent_word_takes_another_seed(docs, monkeypatch):
    whole = collocations._hashes

    def weak(block, seed, lang):
        h, piece = whole(block, seed, lang)
        return (h, piece) if seed else (h % np.uint64(50) + np.uint64(1), piece)

    monkeypatch.setattr(collocations, "_hashes", weak)
    words, seed = collocations.word_table(docs.select("lang", "text").fillna("und", ["lang"]), collocations.CollocationRules(least=3))
    assert seed == 1 and words.count() == words.select("h").distinct().count()


def test_long_texts_are_cut_between_pieces(monkeypatch):
    rng = random.Random(2)
    text = ". ".join(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(300))
    raw = text.encode().translate(collocations._LAID_OUT)
    monkeypatch.setattr(collocations, "BLOCK", 16)
    blocks = list(collocations._blocks(raw))
    assert b"".join(blocks) == raw and len(blocks) > 50 and all(b.endswith(b"\n") for b in blocks[:-1])
