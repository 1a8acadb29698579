"""Stupid-backoff scores of documents under bigram and word counts of the whole corpus.

A word w after v scores c(v w) / c(v) where the corpus has v w at least ``least`` times (tables drop rarer bigrams, as
web-scale tables do), else alpha * c(w) / N; a first word scores c(w) / N. Logarithms add up, so every count table gives
each document its own summand, and tables and documents meet only in parts cut by hash:

* words with at least N / 65536 occurrences (at most 65536 of them) and such bigrams go to every task as exact counts;
* any other bigram's occurrences go, packed, to the part of its rarer word (a word below that bound), or of the bigram
  where both words are common; the part counts bigrams, looks words up in the word table's same part, and sums by document;
* where both words are rare and the bigram is dropped, the second word's logarithm is asked from that word's part.

No key has more than N / 65536 of the rows, so no part is hot.

Defined results: null, empty and blank texts have no words, score 0 and a null mean; repeated rows count in the corpus
each time and score alike; there are no ties; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.scalar import fixed, fixed_sql
from fieldloom.llm import hashing, postings
from fieldloom.llm.common import shuffle_partitions, table
from fieldloom.llm.memory import give_back, released
from fieldloom.session import stored

COMMON = 1 << 16  # at most so many common words, and common bigrams
MASK = np.uint64((1 << 48) - 1)
SHIFT16, SHIFT48 = np.uint64(16), np.uint64(48)
#: kind: 0 counts of words, 1 bigrams of common words, 2 other bigrams, 3 asked words.
PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("owners", pa.binary()), ("runs", pa.binary()), ("keys", pa.binary()), ("numbers", pa.binary())])
PACKED_DDL = "part int, kind int, owners binary, runs binary, keys binary, numbers binary"
BASE = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_words", pa.int64()), ("base", pa.float64())])


@dataclass(frozen=True)
class BackoffRules:
    alpha: float = 0.4
    least: int = 2
    chunk: int = 1 << 20  # words that a task gathers before it hands them on


@dataclass(frozen=True)
class Common:
    """Common words, ascending, with counts, and common bigrams (codes of two words' places), ascending, with counts; total: N."""

    total: int
    words: np.ndarray
    counts: np.ndarray
    bigrams: np.ndarray
    bigram_counts: np.ndarray

    def place(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place among the common words, and whether it is one."""
        if not len(self.words):
            return np.zeros(len(w), dtype=np.int64), np.zeros(len(w), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return at, self.words[at] == w


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> np.uint64(16)) % np.uint64(parts)).astype(np.int32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED.types, strict=True)], schema=PACKED)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None], np.ndarray, np.ndarray]]:
    """ids, texts, words and bounds of some rows at a time."""
    for batch in postings.small(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in hashing.slices(texts):
            words, bounds = hashing.word_hashes(texts[lo:hi])
            yield ids[lo:hi], texts[lo:hi], words & MASK, bounds


def _uids(ids: list, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each row, from its id and words: only repeated rows share one."""
    own = np.asarray([(-1 if i is None else i) for i in ids], dtype=np.int64).view(np.uint64)
    null = np.asarray([i is None for i in ids], dtype=np.uint64)
    placed = hashing.mix(words ^ hashing.mix(np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)))
    upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(placed, dtype=np.uint64)))
    return hashing.mix(hashing.mix(own + null * np.uint64(7)) ^ (upto[bounds[1:]] - upto[bounds[:-1]]))


def _count_rows(keys: list[np.ndarray], counts: list[np.ndarray] | None, parts: int, part: Callable) -> Iterator[pa.RecordBatch]:
    """Packed sums of counts by key; counts None: each key counts once."""
    every = np.concatenate(keys)
    if counts is None:
        key, n = np.unique(every, return_counts=True)
    else:
        key, back = np.unique(every, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    to = part(key, parts)
    order = np.argsort(to, kind="stable")
    to, key, n = to[order], key[order], n[order]
    at = postings.runs(to)
    rows = [(int(to[lo]), 0, b"", b"", postings.squeeze(key[lo:hi]), n[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    if rows:
        yield _batch(rows)


@released
def _counting(batches: Iterator[pa.RecordBatch], parts: int, rules: BackoffRules, pick: Callable, part: Callable) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0
    for _, _, words, bounds in _texts(batches):
        held.append(pick(words, bounds))
        size += len(held[-1])
        if size >= rules.chunk:
            yield from _count_rows(held, None, parts, part)
            held, size = [], 0
    if size:
        yield from _count_rows(held, None, parts, part)


@released
def _adding(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row of a part: its keys, ascending, and their sums (unsigned 64-bit) from least on."""
    held = [b for b in batches if b.num_rows]
    if held:
        part = postings.column(held[0], "part")[0].as_py()
        keys = postings.unsqueeze(b"".join(x for b in held for x in postings.column(b, "keys").to_pylist()))
        key, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back, weights=postings.joined(held, "numbers", "<u4"), minlength=len(key)).astype("<u8")
        yield _batch([(part, 0, b"", np.asarray([n.sum()], dtype="<u8").tobytes(), postings.squeeze(key[n >= least]), n[n >= least].tobytes())])


def _two(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a word and the next are of the same text."""
    same = np.ones(max(0, len(words) - 1), dtype=bool)
    cut = bounds[1:-1]
    same[cut[(cut > 0) & (cut < len(words))] - 1] = False
    return same


def _common_bigrams(words: np.ndarray, bounds: np.ndarray, common: Common) -> np.ndarray:
    at, is_common = common.place(words)
    both = _two(words, bounds) & is_common[:-1] & is_common[1:]
    return (at[:-1][both].astype(np.uint64) << SHIFT16) | at[1:][both].astype(np.uint64)


def _collected(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys with at least ``least`` occurrences: at most N / least."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, numbers in zip(postings.column(b, "keys").to_pylist(), postings.column(b, "numbers").to_pylist(), strict=True):
                k, n = postings.unsqueeze(keys), np.frombuffer(numbers, dtype="<u8")
                if (many := n >= least).any():
                    yield _batch([(0, 0, b"", b"", postings.squeeze(k[many]), n[many].tobytes())])

    rows = counts.mapInArrow(only, PACKED_DDL).select("keys", "numbers").collect()
    keys = postings.unsqueeze(b"".join(bytes(r["keys"]) for r in rows))
    n = np.frombuffer(b"".join(bytes(r["numbers"]) for r in rows), dtype="<u8").astype(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def count_tables(docs: DataFrame, rules: BackoffRules, parts: int) -> tuple[DataFrame, Common]:
    """The word table by parts, and what is common."""
    counting = partial(_counting, parts=parts, rules=rules, pick=lambda w, b: w, part=_part)
    words = stored(docs.mapInArrow(counting, PACKED_DDL).repartitionById(parts, "part").mapInArrow(partial(_adding, least=1), PACKED_DDL))
    sums = words.select("runs").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="<u8").astype(np.int64))], ["n"]) for b in bs), "n long")
    total = int(sums.agg(F.sum("n")).first()[0] or 0)
    least = max(1, -(-total // COMMON))
    key, n = _collected(words, least)
    bare = Common(total, key, n, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    by_code = lambda k, p: (hashing.mix(k) % np.uint64(p)).astype(np.int32)
    counting = partial(_counting, parts=parts, rules=rules, pick=partial(_common_bigrams, common=bare), part=by_code)
    bigrams = docs.mapInArrow(counting, PACKED_DDL).repartitionById(parts, "part").mapInArrow(partial(_adding, least=max(least, rules.least)), PACKED_DDL)
    return words, Common(total, key, n, *_collected(bigrams, max(least, rules.least)))


@released
def _base(batches: Iterator[pa.RecordBatch], common: Common) -> Iterator[pa.RecordBatch]:
    """Each row's summands that need common counts only: common bigrams, and a first word if it is common."""
    log_n = np.log(max(1, common.total))
    log_c, log_b = np.log(common.counts), np.log(common.bigram_counts)
    for ids, _, words, bounds in _texts(batches):
        uid = _uids(ids, words, bounds)
        row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        at, is_common = common.place(words)
        value = np.zeros(len(words))
        code, known = _known(common, at, is_common, _two(words, bounds))
        value[1:][known] = log_b[code[known]] - log_c[at[:-1][known]]
        first = bounds[:-1][np.diff(bounds) > 0]
        value[first] = np.where(is_common[first], log_c[at[first]] if len(log_c) else 0.0, 0.0) - log_n
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(uid.view(np.int64)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.bincount(row, weights=value, minlength=len(ids)))], schema=BASE)


def _known(common: Common, at: np.ndarray, is_common: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word and its next: the place among common bigrams, and whether they are one."""
    code = (at[:-1].astype(np.uint64) << SHIFT16) | at[1:].astype(np.uint64)
    if not len(common.bigrams):
        return np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=bool)
    place = np.minimum(np.searchsorted(common.bigrams, code), len(common.bigrams) - 1)
    return place, two & is_common[:-1] & is_common[1:] & (common.bigrams[place] == code)


@released
def _occurrences(batches: Iterator[pa.RecordBatch], parts: int, rules: BackoffRules, common: Common) -> Iterator[pa.RecordBatch]:
    """All other bigrams, packed by part; a first word that is not common stands as a bigram without a first word (0)."""
    held: list[tuple] = []
    size = 0
    for ids, _, words, bounds in _texts(batches):
        uid = _uids(ids, words, bounds)
        row = np.repeat(np.arange(len(ids), dtype=np.int64), np.diff(bounds))
        at, is_common = common.place(words)
        two = _two(words, bounds)
        _, known = _known(common, at, is_common, two)
        both = two & is_common[:-1] & is_common[1:] & ~known
        code = (at[:-1][both].astype(np.uint64) << SHIFT16) | at[1:][both].astype(np.uint64)
        other = two & ~(is_common[:-1] & is_common[1:])
        first = bounds[:-1][np.diff(bounds) > 0]
        first = first[~is_common[first]]
        a = np.concatenate((words[:-1][other], np.zeros(len(first), dtype=np.uint64)))
        b = np.concatenate((words[1:][other], words[first]))
        rare = np.where(np.concatenate((is_common[:-1][other], np.ones(len(first), dtype=bool))), b, a)
        held.append((uid[row[1:][both]], code, uid[np.concatenate((row[1:][other], row[first]))], a, b, rare))
        size += len(code) + len(a)
        if size >= rules.chunk:
            yield from _hand_on(held, parts)
            held, size = [], 0
            give_back()
    if size:
        yield from _hand_on(held, parts)


def _hand_on(held: list[tuple], parts: int) -> Iterator[pa.RecordBatch]:
    who1, code, who2, a, b, rare = (np.concatenate(x) for x in zip(*held, strict=True))
    rows: list[tuple] = []
    for kind, who, to, pack in (
        (1, who1, (hashing.mix(code) % np.uint64(parts)).astype(np.int32), lambda k: code[k].astype("<u4").tobytes()),
        (2, who2, _part(rare, parts), lambda k: postings.squeeze(a[k]) + postings.squeeze(b[k])),
    ):
        order = np.lexsort((who, to))
        at = postings.runs(to[order])
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            mine = order[lo:hi]
            run = postings.runs(who[mine])
            rows.append((int(to[mine[0]]), kind, who[mine][run[:-1]].tobytes(), np.diff(run).astype("<u4").tobytes(), pack(mine), b""))
    if rows:
        yield _batch(rows)


def _take(held: list[tuple], kind: int) -> list[tuple]:
    """Removes the rows of a kind from held and returns them, so that they can be freed."""
    mine = [h for h in held if h[0] == kind]
    held[:] = [h for h in held if h[0] != kind]
    return mine


def _runs_of(mine: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each run, and the run of each occurrence."""
    owners = np.frombuffer(b"".join(h[1] for h in mine), dtype="<u8")
    return owners, np.repeat(np.arange(len(owners), dtype=np.uint32), np.frombuffer(b"".join(h[2] for h in mine), dtype="<u4"))


def _word_table(mine: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    words = np.concatenate([postings.unsqueeze(h[3]) for h in mine]) if mine else np.zeros(0, dtype=np.uint64)
    counts = np.frombuffer(b"".join(h[4] for h in mine), dtype="<u8")
    order = np.argsort(words)
    return words[order], counts[order]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[tuple]]:
    part, held = -1, []
    for b in batches:
        if b.num_rows:
            part = postings.column(b, "part")[0].as_py()
            held += zip(*[postings.column(b, k).to_pylist() for k in ("kind", "owners", "runs", "keys", "numbers")], strict=True)
    return part, held


def _by_owner(owners: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    who, back = np.unique(owners, return_inverse=True)
    return who, np.bincount(back, weights=values, minlength=len(who))


def _sums(owners: np.ndarray, values: np.ndarray, parts: int) -> list[tuple]:
    """Packed sums by owner, kind 4, for the owners' parts."""
    if not len(owners):
        return []
    who, total = _by_owner(owners, values)
    to = (who % np.uint64(parts)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, who, total = to[order], who[order], total[order]
    at = postings.runs(to)
    return [(int(to[lo]), 4, who[lo:hi].tobytes(), b"", b"", total[lo:hi].astype("<f8").tobytes()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _score_common(mine: list[tuple], rules: BackoffRules, log_c: np.ndarray, drop: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums by owner over bigrams of common words."""
    owners, run = _runs_of(mine)
    code = np.frombuffer(b"".join(h[3] for h in mine), dtype="<u4")
    mine.clear()
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = postings.runs(code)
    n, key = np.diff(at), code[at[:-1]]
    each = np.where(n >= rules.least, np.log(np.maximum(n, 1)) - log_c[key >> 16], drop + log_c[key & 0xFFFF]) if len(key) else np.zeros(0)
    value = np.bincount(run[order], weights=np.repeat(each, n), minlength=len(owners))
    return _by_owner(owners, value)


def _score_others(mine: list[tuple], table_of: tuple[np.ndarray, np.ndarray], part: int, parts: int, rules: BackoffRules, common: Common, log_c: np.ndarray, drop: float) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Sums by owner over the other bigrams of a part, and packed rows of the words to ask elsewhere."""
    owners, run = _runs_of(mine)
    a = np.concatenate([postings.unsqueeze(h[3][: len(h[3]) // 2]) for h in mine]) if mine else np.zeros(0, dtype=np.uint64)
    b = np.concatenate([postings.unsqueeze(h[3][len(h[3]) // 2 :]) for h in mine]) if mine else np.zeros(0, dtype=np.uint64)
    mine.clear()

    def log_count(w: np.ndarray) -> np.ndarray:
        """Of words that are common or of this part."""
        at, is_common = common.place(w)
        out = np.zeros(len(w))
        out[is_common] = log_c[at[is_common]]
        out[~is_common] = np.log(table_of[1][np.searchsorted(table_of[0], w[~is_common])])
        return out

    if not len(a):
        return owners, np.zeros(len(owners)), []
    order = np.lexsort((b, a))
    a, b, run = a[order], b[order], run[order]
    del order
    at = np.append(np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))), len(a))
    n, first, second = np.diff(at), a[at[:-1]], b[at[:-1]]  # of each distinct bigram
    hit = (n >= rules.least) & (first != 0)
    here = ~hit & (common.place(second)[1] | (_part(second, parts) == part))
    each = np.where(hit | (first == 0), 0.0, drop)
    each[hit] = np.log(n[hit]) - log_count(first[hit])
    each[here] += log_count(second[here])
    total = np.bincount(run, weights=np.repeat(each, n), minlength=len(owners))
    ask = np.flatnonzero(np.repeat(~hit & ~here, n))
    who, word = owners[run[ask]], b[ask]
    to = _part(word, parts)
    order = np.lexsort((who, to))
    to, who, word = to[order], who[order], word[order]
    at = postings.runs(to)
    rows = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        cut = postings.runs(who[lo:hi])
        rows.append((int(to[lo]), 3, who[lo:hi][cut[:-1]].tobytes(), np.diff(cut).astype("<u4").tobytes(), postings.squeeze(word[lo:hi]), b""))
    return *_by_owner(owners, total), rows


@released
def _scoring(batches: Iterator[pa.RecordBatch], parts: int, rules: BackoffRules, common: Common) -> Iterator[pa.RecordBatch]:
    """Counts the bigrams of a part; gives sums by owner (kind 4) and the words to ask elsewhere (kind 3)."""
    part, held = _rows_of(batches)
    if not held:
        return
    drop, log_c = np.log(rules.alpha) - np.log(max(1, common.total)), np.log(common.counts)
    who1, sum1 = _score_common(_take(held, 1), rules, log_c, drop)
    words = _word_table(_take(held, 0))
    who2, sum2, rows = _score_others(_take(held, 2), words, part, parts, rules, common, log_c, drop)
    rows += _sums(np.concatenate((who1, who2)), np.concatenate((sum1, sum2)), parts)
    if rows:
        yield _batch(rows)


@released
def _asked(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    _, held = _rows_of(batches)
    mine = _take(held, 3)
    if mine:
        owners, run = _runs_of(mine)
        words, counts = _word_table(held)
        asked = np.concatenate([postings.unsqueeze(h[3]) for h in mine])
        value = np.bincount(run, weights=np.log(counts[np.searchsorted(words, asked)]), minlength=len(owners))
        yield _batch(_sums(owners, value, parts))


@released
def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, held = _rows_of(batches)
    if held:
        owner, total = _by_owner(np.frombuffer(b"".join(h[1] for h in held), dtype="<u8"), np.frombuffer(b"".join(h[4] for h in held), dtype="<f8"))
        yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(total)], ["owner", "rest"])


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: BackoffRules = BackoffRules()) -> DataFrame:
    """Per row of docs: doc_id, n_words, log_score (natural logarithm, summed over the words) and mean_log_score."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    words, common = count_tables(docs, rules, parts)
    shared = spark.sparkContext.broadcast(common)  # at most COMMON words and bigrams
    rows = stored(docs.mapInArrow(lambda bs: _base(bs, shared.value), "doc_id long, uid long, n_words long, base double"))
    pairs = docs.mapInArrow(lambda bs: _occurrences(bs, parts, rules, shared.value), PACKED_DDL).unionByName(words)
    scored = stored(pairs.repartitionById(parts, "part").mapInArrow(lambda bs: _scoring(bs, parts, rules, shared.value), PACKED_DDL))
    asked = scored.filter("kind = 3").unionByName(words).repartitionById(parts, "part").mapInArrow(lambda bs: _asked(bs, parts), PACKED_DDL)
    totals = scored.filter("kind = 4").unionByName(asked).repartitionById(parts, "part").mapInArrow(_totals, "owner long, rest double")
    copies = rows.groupBy("uid").agg(F.count("*").alias("copies"))
    rest = copies.join(totals, copies["uid"] == totals["owner"]).select("owner", (F.col("rest") / F.col("copies")).alias("rest"))
    score = F.col("base") + F.coalesce("rest", F.lit(0.0))
    out = rows.join(rest, rows["uid"] == rest["owner"], "left")
    return out.select("doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log_score"))


def op10_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to three decimals, means to six, which do not depend on the order of the sums."""
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", fixed(F.col("log_score"), 3).alias("log_score"), fixed(F.col("mean_log_score"), 6).alias("mean_log_score"))


def _sql(r: BackoffRules = BackoffRules()) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT uid, unnest(ws) AS b, unnest(list_concat([NULL], ws[1:len(ws) - 1])) AS a FROM d WHERE len(ws) > 0),
one AS (SELECT b, count(*) AS n FROM w GROUP BY b), two AS (SELECT a, b, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= {r.least}),
s AS (SELECT uid, sum(CASE WHEN w.a IS NULL THEN ln(ob.n) - ln((SELECT count(*) FROM w)) WHEN two.n IS NOT NULL THEN ln(two.n) - ln(oa.n) ELSE ln({r.alpha}) + ln(ob.n) - ln((SELECT count(*) FROM w)) END) AS score
  FROM w JOIN one ob ON ob.b = w.b LEFT JOIN one oa ON oa.b = w.a LEFT JOIN two ON two.a = w.a AND two.b = w.b GROUP BY uid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, {fixed_sql("coalesce(score, 0.0)", 3)} AS log_score, {fixed_sql("score / len(ws)", 6)} AS mean_log_score FROM d LEFT JOIN s USING (uid)"""


ORACLE = _sql()
