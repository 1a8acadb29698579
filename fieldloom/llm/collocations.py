"""Collocations: contiguous phrases grown to the right from frequent prefixes, scored by their weakest cut.

1. Words are counted per language, exactly, and get 64-bit hashes; a clash that a frequent word takes part in is looked for over
   all distinct words, and answered by another seed. From here on a word is its hash, which stands for its language too.
2. Pairs of frequent words are counted, packed and summed by chunk before the shuffle. A word is known as frequent by a bit in a
   table of fixed size, so that rare words that share a bit cost work but never change a result; likewise pairs in step 3.
3. Every frequent pair is a prefix. Its occurrences are projected: a pointer is the prefix with the words that follow it, up to the
   longest phrase, while each word and the next make a frequent pair. Equal pointers of a chunk are one with a number.
   One task holds all pointers of a prefix, and extends it to the right depth-first: the sorted pointers of a phrase are a slice,
   its extensions are the runs within, and those that stay frequent are extended in turn.
4. Prefixes with more than 1/hot_share of all pairs, of which there are fewer than hot_share, are dealt by their whole pointers
   instead; their tasks give partial counts, which Spark adds up before rare ones are dropped.
5. Cuts, scores and containment are joins and sums over the frequent phrases alone, in exact decimals.

The words of a shuffled row are two bytes where they are among the 65535 most frequent ones, else two bytes and the hash.

Defined results: null, empty and blank texts have no words; a null language is ``und``; a long text is read in blocks that end
between pieces; repeated rows count each time; ties of cuts go to the shorter first part, ties of phrases to count and bytes;
an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import hashing, postings
from fieldloom.llm.common import shuffle_partitions, table
from fieldloom.llm.memory import give_back, released
from fieldloom.session import stored


@dataclass(frozen=True)
class CollocationRules:
    least: int = 100  # occurrences of a candidate
    longest: int = 5  # words
    covered_percent: int = 100  # of its occurrences in a longer candidate, which drop a candidate
    top: int = 2000  # phrases reported for a language
    hot_share: int = 1024
    chunk: int = 1 << 20  # occurrences that a task gathers before it hands them on
    part_rows: int = 1 << 22  # occurrences that a part gets, about
    filter_bits: int = 26


#: Ends of pieces become line feeds, A-Z are lowered, tabs become spaces.
_LAID_OUT = bytes.maketrans(b".,;:!?\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ\t", b"\n" * 9 + b"abcdefghijklmnopqrstuvwxyz ")
BLOCK = 1 << 20
#: Occurrences by part: kind 1 has pointers of hot prefixes, 0 all others.
PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("codes", pa.binary()), ("rest", pa.binary()), ("numbers", pa.binary())])
PACKED_DDL = "part int, kind int, codes binary, rest binary, numbers binary"
COUNTED = pa.schema([("words", pa.list_(pa.int64())), ("n", pa.int64())])
COUNTED_DDL = "words array<long>, n long"
OTHER = 0xFFFF


def _blocks(raw: bytes) -> Iterator[bytes]:
    """Laid out text in blocks of about BLOCK bytes that end between pieces."""
    at = 0
    while at < len(raw):
        cut = raw.find(b"\n", at + BLOCK)
        end = len(raw) if cut < 0 else cut + 1
        yield raw[at:end]
        at = end


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, block) of laid out texts; texts never share a piece."""
    for batch in postings.small(batches):
        texts: dict[str, list[bytes]] = {}
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if raw:
                texts.setdefault(lang, []).append(raw.translate(_LAID_OUT))
        for lang, raws in texts.items():
            for block in _blocks(b"\n".join(raws)):
                yield lang, block


def _hashes(block: bytes, seed: int, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a block, never 0, and the number of its piece."""
    joined = np.frombuffer(block + b"\n", dtype=np.uint8)
    filled = (joined != 32) & (joined != 10)
    begins = np.flatnonzero(filled & np.concatenate(([True], ~filled[:-1])))
    if not len(begins):
        return np.zeros(0, dtype=np.uint64), begins
    places = np.flatnonzero(filled)
    heads = np.searchsorted(places, begins)
    lengths = np.diff(np.append(heads, len(places)))
    at = (np.arange(len(places)) - np.repeat(heads, lengths)).astype(np.uint64)
    h = np.add.reduceat(hashing.mix((at << np.uint64(8)) + joined[places] + np.uint64(seed << 40)), heads)
    key = np.frombuffer(lang.encode("utf-8", "surrogatepass") + b"\0", dtype=np.uint8)
    own = hashing.mix(hashing.mix(np.arange(len(key), dtype=np.uint64) * np.uint64(256) + key).sum(dtype=np.uint64)[None])
    return np.maximum(hashing.mix(h ^ hashing.mix(lengths.astype(np.uint64) ^ own)), np.uint64(1)), np.cumsum(joined == 10)[begins]


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return hashing.mix(a ^ hashing.mix(b))


@dataclass(frozen=True)
class Filter:
    """Bits of hashes: every hash that was put in is found again, few others are."""

    bits: int
    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64((1 << self.bits) - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _filter(hashes: DataFrame, column: str, bits: int) -> Filter:
    """The bits of all hashes of a column: at most 2^bits / 64 rows come to the driver, whatever the table."""
    at = F.col(column).bitwiseAND((1 << bits) - 1)
    bit = F.element_at(F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64))), (at.bitwiseAND(63) + 1).cast("int"))
    rows = hashes.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return Filter(bits, words)


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n over docs (lang, text)."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            found = [(lang, word, n) for lang, words in held.items() for word, n in words.items()]
            lang, word, n = zip(*found, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for lang, block in _by_language(batches):
            held.setdefault(lang, Counter()).update(block.split())
            if sum(map(len, held.values())) > 1 << 17:
                yield rows()
        if any(held.values()):
            yield rows()

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed(words: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(batch.num_rows, dtype=np.uint64)
            langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
            raws = batch.column(1).cast(pa.binary()).to_pylist()
            for lang in set(langs):
                mine = np.flatnonzero(langs == lang)
                h[mine] = _hashes(b"\n".join(raws[k] for k in mine), seed, lang)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], ["lang", "word", "n", "h"])

    return words.mapInArrow(run, "lang string, word string, n long, h long")


def word_table(docs: DataFrame, rules: CollocationRules) -> tuple[DataFrame, int]:
    """lang, word, n, h of all words, and the first seed under which no frequent word shares its hash."""
    counted = stored(count_words(docs))
    for seed in range(8):
        words = stored(_hashed(counted, seed))
        clash = words.groupBy("h").agg(F.count("*").alias("words"), F.max("n").alias("n")).filter(f"words > 1 and n >= {rules.least}")
        if clash.isEmpty():
            return words, seed
    raise RuntimeError("words keep sharing hashes")


@dataclass(frozen=True)
class Codes:
    """The most frequent words' hashes, ascending: a word's code is its place."""

    hashes: np.ndarray

    def pack(self, words: np.ndarray) -> tuple[bytes, bytes]:
        """Words (0: none) as codes of two bytes, and the hashes of those without one in the same order."""
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        known = self.hashes[at] == words
        return np.where(known, at, OTHER).astype("<u2").tobytes(), words[~known].astype("<u8").tobytes()

    def unpack(self, codes: bytes, rest: bytes) -> np.ndarray:
        at = np.frombuffer(codes, dtype="<u2")
        words = self.hashes[np.minimum(at, len(self.hashes) - 1)]
        words[at == OTHER] = np.frombuffer(rest, dtype="<u8")
        return words


def _codes(words: DataFrame) -> Codes:
    """Codes of the 65534 most frequent words; 0, which stands for no word, has one too."""
    rows = words.orderBy(F.desc("n"), "h").limit(OTHER - 1).select("h").toArrow()
    return Codes(np.sort(np.append(rows.column(0).to_numpy().view(np.uint64), np.uint64(0))))


def _summed(rows: np.ndarray, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, sorted by their words, with the sum of their numbers (None: ones)."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    at = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))) if len(rows) else np.zeros(0, dtype=np.int64)
    if numbers is None:
        return rows[at], np.diff(np.append(at, len(rows)))
    return rows[at], np.add.reduceat(numbers[order], at) if len(at) else np.zeros(0, dtype=np.int64)


def _packed(held: list[np.ndarray], codes: Codes, deal: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each part and kind that the gathered occurrences go to."""
    rows, numbers = _summed(np.concatenate(held))
    part, kind = deal(rows)
    order = np.argsort(2 * part + kind, kind="stable")
    rows, numbers, to = rows[order], numbers[order], (2 * part + kind)[order]
    at = postings.runs(to)
    out = [(int(to[lo]) // 2, int(to[lo]) % 2, *codes.pack(rows[lo:hi].reshape(-1)), numbers[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PACKED.types, strict=True)], schema=PACKED)


@released
def _occurrences(batches: Iterator[pa.RecordBatch], seed: int, codes: Codes, rules: CollocationRules, pick: Callable, deal: Callable) -> Iterator[pa.RecordBatch]:
    """What ``pick`` takes of each block's words, summed by chunk and dealt."""
    held: list[np.ndarray] = []
    size = 0
    for lang, block in _by_language(batches):
        words, piece = _hashes(block, seed, lang)
        held.append(pick(words, piece))
        size += len(held[-1])
        if size >= rules.chunk:
            yield _packed(held, codes, deal)
            held, size = [], 0
            give_back()
    if size:
        yield _packed(held, codes, deal)


def _gathered(batches: Iterator[pa.RecordBatch], codes: Codes, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a part: each kind with its distinct rows, sorted, and their numbers. What was gathered is summed whenever it has doubled."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
    size, summed = {0: 0, 1: 0}, {0: 1 << 20, 1: 1 << 20}
    for batch in batches:
        for kind, code, rest, numbers in zip(*(postings.column(batch, k).to_pylist() for k in ("kind", "codes", "rest", "numbers")), strict=True):
            held[kind].append((codes.unpack(code, rest).reshape(-1, width), np.frombuffer(numbers, dtype="<u4").astype(np.int64)))
            size[kind] += len(held[kind][-1][1])
            if size[kind] >= 2 * summed[kind]:
                held[kind] = [_summed(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))]
                size[kind] = summed[kind] = max(len(held[kind][0][1]), 1 << 20)
    for kind in (0, 1):
        if held[kind]:
            yield kind, *_summed(*(np.concatenate(x) for x in zip(*held.pop(kind), strict=True)))


def _pairs(words: np.ndarray, piece: np.ndarray, frequent: Filter) -> np.ndarray:
    """Two words of a piece, both frequent."""
    good = frequent.has(words)
    both = good[:-1] & good[1:] & (piece[:-1] == piece[1:])
    return np.stack((words[:-1][both], words[1:][both]), axis=1)


def _pointers(words: np.ndarray, piece: np.ndarray, frequent: Filter, pairs: Filter, longest: int) -> np.ndarray:
    """Each frequent pair that another one follows, with the words behind it while neighbours make frequent pairs; 0 from there on."""
    if len(words) < 2:
        return np.zeros((0, longest), dtype=np.uint64)
    good = frequent.has(words)
    linked = np.zeros(len(words) + longest, dtype=bool)  # of a word and the next
    linked[: len(words) - 1] = good[:-1] & good[1:] & (piece[:-1] == piece[1:])
    some = np.flatnonzero(linked)
    linked[some] = pairs.has(_pair_key(words[some], words[some + 1]))
    start = np.flatnonzero(linked[:-1] & linked[1:])
    out = np.zeros((len(start), longest), dtype=np.uint64)
    going = np.ones(len(start), dtype=bool)
    for k in range(longest):
        if k > 1:
            going &= linked[start + k - 1]
        out[going, k] = words[start[going] + k]
    return out


def _extended(rows: np.ndarray, numbers: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """All phrases of three words or more with at least ``least`` occurrences, of sorted pointers: each slice that shares a prefix is
    extended to the right, depth first."""
    signed = rows.view(np.int64)
    bounds = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1), [True])))
    upto = np.concatenate(([0], np.cumsum(numbers)))
    enough = upto[bounds[1:]] - upto[bounds[:-1]] >= least
    todo = [(lo, hi, 2) for lo, hi in zip(bounds[:-1][enough].tolist(), bounds[1:][enough].tolist(), strict=True)][::-1]
    while todo:
        lo, hi, depth = todo.pop()
        at = lo + postings.runs(rows[lo:hi, depth])
        n = upto[at[1:]] - upto[at[:-1]]
        keep = np.flatnonzero((n >= least) & (rows[at[:-1], depth] != 0))
        for k in keep[::-1].tolist():
            yield signed[at[k], : depth + 1].tolist(), int(n[k])
            if depth + 1 < rows.shape[1]:
                todo.append((int(at[k]), int(at[k + 1]), depth + 1))


def _counted(rows: list[tuple[list[int], int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], COUNTED.types[0]), pa.array([r[1] for r in rows], pa.int64())], schema=COUNTED)


def frequent_phrases(docs: DataFrame, rules: CollocationRules = CollocationRules()) -> tuple[DataFrame, DataFrame]:
    """Of docs (lang, text): words (lang, word, n, h), all of them, and phrases (words: hashes in order, n) of two words or more with
    at least ``least`` occurrences."""
    spark = docs.sparkSession
    words, seed = word_table(docs, rules)
    many = words.filter(F.col("n") >= rules.least)
    total = many.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // rules.part_rows))
    codes = spark.sparkContext.broadcast(_codes(many))  # at most 65535 hashes
    frequent = spark.sparkContext.broadcast(_filter(many, "h", rules.filter_bits))  # 2^filter_bits bits, as is the filter of pairs

    def by_row(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = rows[:, 0]
        for k in range(1, rows.shape[1]):
            key = _pair_key(key, rows[:, k])
        return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), np.zeros(len(rows), dtype=np.int64)

    @released
    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, numbers in _gathered(batches, codes.value, 2):
            kept = numbers >= rules.least
            yield _counted(list(zip(rows[kept].view(np.int64).tolist(), numbers[kept].tolist(), strict=True)))

    take = lambda bs: _occurrences(bs, seed, codes.value, rules, lambda w, p: _pairs(w, p, frequent.value), by_row)
    pairs = stored(docs.mapInArrow(take, PACKED_DDL).repartitionById(parts, "part").mapInArrow(count_pairs, COUNTED_DDL))
    if rules.longest < 3:
        return words, pairs

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(0).flatten().to_numpy().view(np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_pair_key(both[:, 0], both[:, 1]).view(np.int64)), batch.column(1)], ["key", "n"])

    keyed = pairs.mapInArrow(keys, "key long, n long")
    linked = spark.sparkContext.broadcast(_filter(keyed, "key", rules.filter_bits))
    # prefixes that hold more than 1/hot_share of the occurrences of frequent pairs: fewer than hot_share
    n_pairs = keyed.agg(F.sum("n")).first()[0] or 0
    hot = keyed.filter(F.col("n") > n_pairs // rules.hot_share).select("key").toArrow().column(0).to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)))

    def by_prefix(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = _pair_key(rows[:, 0], rows[:, 1])
        is_hot = np.isin(key, hot.value)
        return np.where(is_hot, by_row(rows)[0], (key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), is_hot.astype(np.int64)

    @released
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[int], int]] = []
        for kind, rows, numbers in _gathered(batches, codes.value, rules.longest):
            for phrase in _extended(rows, numbers, 1 if kind else rules.least):
                held.append(phrase)
                if len(held) == 1 << 14:
                    yield _counted(held)
                    held = []
        if held:
            yield _counted(held)

    take = lambda bs: _occurrences(bs, seed, codes.value, rules, lambda w, p: _pointers(w, p, frequent.value, linked.value, rules.longest), by_prefix)
    grown = docs.mapInArrow(take, PACKED_DDL).repartitionById(parts, "part").mapInArrow(extend, COUNTED_DDL)
    grown = grown.groupBy("words").agg(F.sum("n").alias("n")).filter(F.col("n") >= rules.least)
    return words, stored(pairs.unionByName(grown))


def _spelled(phrases: DataFrame, words: DataFrame, rules: CollocationRules) -> DataFrame:
    """lang, ws (the words), n for phrases of hashes."""
    long = phrases.select("words", "n", F.posexplode("words").alias("at", "h"))
    many = words.filter(F.col("n") >= rules.least).select("h", "lang", "word")
    told = long.join(many, "h").groupBy("words", "n").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("told"))
    return told.select("lang", F.transform("told", lambda x: x["word"]).alias("ws"), "n")


def score_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", rules: CollocationRules = CollocationRules()) -> DataFrame:
    """All candidates: lang, phrase, a, l, r, n, score and covered (whether a longer candidate has covered_percent of its occurrences)."""
    docs = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].alias("text"))
    words, phrases = frequent_phrases(docs, rules)
    found = stored(_spelled(phrases, words, rules))
    joined = lambda ws: F.array_join(ws, " ")
    phrase = found.select("lang", joined(F.col("ws")).alias("phrase"), F.col("n").alias("a"), "ws")
    counts = phrase.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    counts = counts.unionByName(words.filter(F.col("n") >= rules.least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    cut = phrase.select("lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.slice("ws", F.lit(1), F.col("k"))).alias("first"), joined(F.slice("ws", F.col("k") + 1, F.size("ws"))).alias("rest"))
    cut = cut.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    cut = cut.join(totals, "lang")
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")  # exact: at most 38 digits
    weakest = cut.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", score.alias("score")), F.struct(score, "k")).alias("best")).select("lang", "phrase", "best.*")
    # every shorter phrase inside a candidate, with the candidate's count
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("ws") - 1)), lambda m: F.transform(F.sequence(F.lit(1), F.size("ws") - m + 1), lambda s: joined(F.slice("ws", s, m)))))
    inside = phrase.filter(F.size("ws") > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(100 * F.col("longer") >= rules.covered_percent * F.col("a"), F.lit(False))
    return weakest.join(inside, ["lang", "phrase"], "left").withColumn("covered", covered).drop("longer")


def top_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", rules: CollocationRules = CollocationRules()) -> DataFrame:
    """Each language's best phrases that no longer candidate covers: lang, rank (from 1), phrase, a, l, r, n, score."""
    kept = score_phrases(docs, lang, text, rules).filter(~F.col("covered"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # the best of each salt first, as one language may hold most
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= rules.top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= rules.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_prefix_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) t(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cut AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:m], ' ') AS rest FROM c, range(1, 5) t(k) WHERE k < m),
s AS (SELECT cut.lang, cut.phrase, cut.a, k, fl.a AS l, fr.a AS r, n, CAST((1000::HUGEINT * cut.a * n) // (fl.a::HUGEINT * fr.a) AS BIGINT) AS score
  FROM cut JOIN f fl USING (lang) JOIN f fr USING (lang) JOIN n USING (lang) WHERE fl.phrase = cut.first AND fr.phrase = cut.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT c.lang, array_to_string(c.ws[j:j + q - 1], ' ') AS phrase, c.a AS longer FROM c, range(2, 5) t(q), range(1, 5) u(j) WHERE q < c.m AND j + q - 1 <= c.m),
d AS (SELECT lang, phrase FROM b JOIN i USING (lang, phrase) WHERE 100 * longer >= 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b ANTI JOIN d USING (lang, phrase)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
