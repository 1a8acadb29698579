"""SimHash near-duplicates: fingerprints of 64 bits that differ in few bits, found by an inverted index of their bytes.

1. A document's fingerprint has a bit set if over half of its shingles' XXH64 values have it. Documents with one fingerprint
   are one class, known by its least id; copies are never compared.
2. A fingerprint is eight bytes at eight positions. Two differing bits touch at most two of them, so linked fingerprints share
   six positional bytes or more: the guaranteed minimum. Postings of single bytes would hold 1/256 of all fingerprints each, so
   an index list stands for four positional bytes at once: positions go in four pairs, at most two pairs are touched, and the six
   ways to choose two pairs give six lists a fingerprint, at least one of which linked fingerprints share.
3. In a list, positional bytes that a pair shares are tallied; pairs that reach the minimum are verified by counting bits. A pair
   is taken from the first list that it shares, so no link comes twice.
4. A list of more than ``list_rows`` fingerprints is never tallied in pairs: since six bytes must agree, it is split by two
   more positions, in six ways. Two free bytes are left, so such a list holds at most 65536 fingerprints, and where it is long,
   each looks up the 136 values that differ in one or two of the free 16 bits.
5. Components of the links carry the least id back to classes and rows. Fingerprints with very many rows are sent to every
   task, of which there are at most ``hot_share``.

Defined results: null, empty and blank texts have fingerprint zero and link as any other; a text of fewer words than a shingle
has one shingle; a bit that exactly half of the shingles have is 0; rows with a null id take part, and their component is the
least id around them (null if none has one); repeated rows are exact copies; long texts are hashed whole, a block at a time;
an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import postings
from fieldloom.llm.common import shuffle_partitions, table
from fieldloom.llm.components import connected_components
from fieldloom.llm.memory import released
from fieldloom.session import stored


@dataclass(frozen=True)
class SimhashRules:
    width: int = 3  # words of a shingle
    seed: int = 42
    list_rows: int = 512  # fingerprints of a list whose pairs are tallied
    block: int = 1 << 20  # bytes of text that are split at once
    hot_share: int = 4096  # a fingerprint with more than this part of all rows is sent to every task


#: Differing bits that still link, and the positional bytes that linked fingerprints share at least.
BITS, MINIMUM = 2, 6
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The ways to choose two of the four pairs of positions, the bytes of each, and for each the ways to add two of the other positions.
CHOICES = tuple(itertools.combinations(range(4), 2))
MASKS = tuple(sum(0xFFFF << (16 * p) for p in pairs) for pairs in CHOICES)
ADDED = tuple(tuple(itertools.combinations([k for k in range(8) if k // 2 not in pairs], 2)) for pairs in CHOICES)
FINE_MASKS = tuple(tuple(m | sum(0xFF << (8 * k) for k in two) for two in added) for m, added in zip(MASKS, ADDED, strict=True))
FREE = tuple(tuple(tuple(k for k in range(8) if not m >> (8 * k) & 0xFF) for m in masks) for masks in FINE_MASKS)
LINKS = pa.schema([("list", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
LINKS_DDL = "list long, a long, b long"


def _blocks(raw: bytes, size: int) -> Iterator[bytes]:
    """The text in blocks of about ``size`` bytes that end between words."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def fingerprint(raw: bytes | None, rules: SimhashRules = SimhashRules()) -> int:
    """The unsigned fingerprint of a text in UTF-8; A-Z are lowered here."""
    width, digest, seed = rules.width, xxhash.xxh64_intdigest, rules.seed
    ones, total = np.zeros(64, dtype=np.int64), 0
    tail: list[bytes] = []
    for block in _blocks((raw or b"").lower(), rules.block):
        words = tail + block.split()
        if len(words) >= width:
            text = b" ".join(words)
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            begins = [0, *ends[: len(words) - width]]
            hashes = np.fromiter((digest(text[i : j - 1], seed) for i, j in zip(begins, ends[width - 1 :], strict=True)), dtype="<u8", count=len(begins))
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(width - 1) :] if width > 1 else []
    if not total:
        return digest(b" ".join(tail), seed) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, rules: SimhashRules = SimhashRules()) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, for docs of two columns: id and text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in postings.small(batches):
            found = np.asarray([fingerprint(raw, rules) for raw in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _touched(x: np.ndarray) -> np.ndarray:
    """Of differences between fingerprints, how many positional bytes aren't shared."""
    return np.count_nonzero(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1)


def _first(x: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """For each difference the first mask that it leaves untouched (0 where there is none)."""
    return np.argmax(np.stack([(x & np.uint64(m)) == 0 for m in masks]), axis=0)


def _tallied(lists: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of verified pairs of rows in one list; lists are sorted. Each row meets the row ``step`` further on, for every step that a list holds."""
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for step in range(1, int(np.diff(postings.runs(lists)).max(initial=0))):
        at = np.flatnonzero(lists[step:] == lists[:-step])
        x = fps[at] ^ fps[at + step]
        near = 8 - _touched(x) >= MINIMUM
        at = at[near][np.bitwise_count(x[near]) <= BITS]
        left.append(at)
        right.append(at + step)
    return np.concatenate(left), np.concatenate(right)


def _looked_up(fps: np.ndarray, free: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one list whose fingerprints differ at two positions only: each looks up what differs in one or two of these bits."""
    fps = np.sort(fps)
    bits = [1 << (8 * p + k) for p in free for k in range(8)]
    left, right = [], []
    for flip in [*bits, *(x | y for x, y in itertools.combinations(bits, 2))]:
        wanted = fps ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(fps, wanted), len(fps) - 1)
        hit = (fps[at] == wanted) & (fps < wanted)
        left.append(fps[hit])
        right.append(wanted[hit])
    return np.concatenate(left), np.concatenate(right)


def _lists(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole lists of rows sorted by list: list, fingerprint, and whether the list has more than ``most`` rows; only such lists come in pieces."""
    lists, fps, passing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), -1
    for batch in batches:
        lists = np.concatenate((lists, batch.column(0).to_numpy()))
        fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
        if not len(lists):
            continue
        at = postings.runs(lists)
        wide = np.repeat((np.diff(at) > most) | (lists[at[:-1]] == passing), np.diff(at))
        passing = int(lists[-1]) if wide[-1] else -1
        whole = len(lists) if wide[-1] else int(at[-2])
        yield lists[:whole], fps[:whole], wide[:whole]
        lists, fps = lists[whole:], fps[whole:]
    yield lists, fps, np.zeros(len(lists), dtype=bool)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=LINKS)


def _finer(lists: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of wide lists' fingerprints under two more positions."""
    for kind in np.unique(lists >> 32).tolist():
        mine = fps[(lists >> 32) == kind]
        for split, mask in enumerate(FINE_MASKS[kind]):
            fine = _packed(mine, mask) | (np.int64(6 * kind + split) << np.int64(48))
            yield pa.RecordBatch.from_arrays([pa.array(fine), pa.array(mine.view(np.int64)), pa.nulls(len(mine), pa.int64())], schema=LINKS)


def _packed(fps: np.ndarray, mask: int) -> np.ndarray:
    """The six bytes of a mask, side by side."""
    octets = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(fps), 8), dtype=np.uint8)
    out[:, :6] = octets[:, [k for k in range(8) if mask >> (8 * k) & 0xFF]]
    return out.view("<i8").reshape(-1)


@released
def _tally(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of lists of at most ``most`` fingerprints, each from its first list; postings of the finer lists of the others."""
    for lists, fps, wide in _lists(batches, most):
        narrow, mine = lists[~wide], fps[~wide]
        i, j = _tallied(narrow, mine)
        if len(i):
            own = _first(mine[i] ^ mine[j], MASKS) == narrow[i] >> 32
            yield _links(mine[i][own], mine[j][own])
        if wide.any():
            yield from _finer(lists[wide], fps[wide])


@released
def _tally_fine(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of the finer lists, each from the first split of the first list that it shares."""
    for lists, fps, _ in _lists(batches, 1 << 16):
        at = postings.runs(lists)
        long = np.repeat(np.diff(at) > most, np.diff(at))
        i, j = _tallied(lists[~long], fps[~long])
        found = [(lists[~long][i] >> 48, fps[~long][i], fps[~long][j])]
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo > most:
                number = int(lists[lo] >> 48)
                a, b = _looked_up(fps[lo:hi], FREE[number // 6][number % 6])
                found.append((np.full(len(a), number), a, b))
        number, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        x = a ^ b
        for kind in np.unique(number // 6).tolist():
            own = (number // 6 == kind) & (_first(x, MASKS) == kind) & (_first(x, FINE_MASKS[kind]) == number % 6)
            if own.any():
                yield _links(a[own], b[own])


def linked_fingerprints(fps: DataFrame, rules: SimhashRules = SimhashRules()) -> DataFrame:
    """All pairs a, b of distinct fingerprints (column fp) that differ in at most two bits, each once."""
    parts = shuffle_partitions(fps.sparkSession)
    pair = [F.shiftrightunsigned("fp", 16 * p).bitwiseAND(0xFFFF) for p in range(4)]
    number = [F.lit(k << 32) + F.shiftleft(pair[p], 16) + pair[q] for k, (p, q) in enumerate(CHOICES)]
    rows = fps.select(F.explode(F.array(*number)).alias("list"), "fp").repartition(parts, "list").sortWithinPartitions("list")
    first = stored(rows.mapInArrow(lambda bs: _tally(bs, rules.list_rows), LINKS_DDL))
    fine = first.filter("list is not null").select("list", "a").repartition(parts, "list").sortWithinPartitions("list")
    found = fine.mapInArrow(lambda bs: _tally_fine(bs, rules.list_rows), LINKS_DDL)
    return first.filter("list is null").select("a", "b").unionByName(found.select("a", "b"))


def _with_value(rows: DataFrame, values: DataFrame, key: str, value: str, many: int) -> DataFrame:
    """rows joined to values (key, value, rows: how many rows have the key): keys of more than ``many`` rows are sent to every task, and
    their rows are dealt at random in the join of the others."""
    hot = F.broadcast(values.filter(F.col("rows") > many).select(F.col(key).alias("hot_key"), F.col(value).alias("hot_value")))
    rows = rows.join(hot, rows[key] == hot["hot_key"], "left")
    rows = rows.withColumn("at", F.when(F.col("hot_key").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    rest = values.filter(F.col("rows") <= many).select(F.col(key).alias("at"), F.col(value).alias("cold_value"))
    joined = rows.join(rest, "at", "left")
    return joined.withColumn(value, F.when(F.col("hot_key").isNull(), F.col("cold_value")).otherwise(F.col("hot_value"))).drop("at", "hot_key", "hot_value", "cold_value")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SimhashRules = SimhashRules()) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hexadecimal digits), class_id (least id with the fingerprint) and component_id."""
    rows = stored(fingerprints(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), rules))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")))
    many = max(1024, rows.count() // rules.hot_share)
    labels = connected_components(linked_fingerprints(classes.select("fp"), rules), "a", "b")
    classes = classes.join(labels, classes["fp"] == labels["node"], "left").withColumn("label", F.coalesce("label", "fp")).drop("node")
    least = stored(classes.groupBy("label").agg(F.min("class_id").alias("component_id"), F.count("*").alias("rows")))
    classes = stored(_with_value(classes.withColumnRenamed("rows", "copies"), least, "label", "component_id", many).withColumnRenamed("copies", "rows"))
    named = classes.withColumn("ids", F.struct("class_id", "component_id"))
    out = _with_value(rows.withColumn("row", F.monotonically_increasing_id()), named, "fp", "ids", many)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "ids.class_id", "ids.component_id")


def op12_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
