"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the instance is a histogram whose size
does not depend on the data. The reduction fixes small sets that dominate every other choice for an item, best-fit
decreasing packs the rest, and both run on counts: the plan is a list of runs (length, ranks, first sequence, offset).
Pieces get their rank among equal lengths in two levels (salted groups, then a running sum of their sizes), so a length
that a third of all pieces share is never gathered in one task, and look their place up in the plan.

Defined results: a null text is empty, and an empty document is one piece that holds the end token alone; repeated rows
are packed each by itself; pieces of equal length are ordered by id and number; an empty table gives an empty table;
other columns are never read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import table
from fieldloom.llm.memory import released
from fieldloom.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class PackRules:
    vocabulary: str  # path of a tokenizers file
    capacity: int = 4096
    end_id: int = 1
    salts: int = 64  # groups of equal lengths at least
    salt_rows: int = 100_000  # pieces of one length and group, about
    cache: int = 300_000  # words of a generation whose ids a worker keeps, of two
    slice_bytes: int = 8 << 20  # of texts whose words are made distinct together


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[int, str]:
    """The sign of each byte in a byte-level vocabulary: itself where it prints, else the next free sign from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()


#: The normaliser and the pre-tokenizer that make words of white space independent of each other.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    """A mark for each byte: whether it lies in one of the ranges (ends included)."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: ASCII marks but the apostrophe, which may begin a piece of its own with a letter.
_MARKS = _bytes_in((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_LETTERS = _bytes_in((0x30, 0x39), (0x61, 0x7A))  # and digits
_LATIN = _bytes_in((0xA0, 0xB6), (0xB8, 0xBF))  # the second byte, after 0xC3, of a small letter of Latin-1


def _gathered(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of flat, one after the other, and where each of them ends."""
    ends = np.cumsum(lengths)
    place = np.repeat(first - (ends - lengths), lengths)
    return flat[place + np.arange(len(place))], ends


class WordTokenizer:
    """Ids of texts, many at a time: the distinct words of a slice of texts are encoded, and each text gathers its ids.

    That holds for a vocabulary whose pieces never span white space, which the file's normaliser and pre-tokenizer must
    state word for word; texts are encoded whole under any other. A-Z are lowered first, as the normaliser does to all
    letters. Texts that hold the string of a special token or a combining mark (which A-Z take part in before they are
    lowered) are encoded whole too. One mark at a word's end is taken off where the pre-tokenizer splits there in any case,
    so that a word is learnt once. Two generations of words are kept: when the newer is full, the older is dropped.
    """

    _small = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")  # one piece, which the normaliser leaves as it is
    _kept: dict[tuple[str, int], WordTokenizer] = {}

    def __init__(self, path: str, cache: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache
        stated = json.loads(self.tokenizer.to_str())
        normaliser, splitter, model = stated["normalizer"] or {}, stated["pre_tokenizer"] or {}, stated["model"]
        self.by_words = normaliser.get("normalizers") == NORMALISER and splitter.get("pretokenizers") == SPLITTERS and model.get("type") == "BPE" and not model.get("dropout") and all(not t["normalized"] and t["content"].startswith("<|") for t in stated["added_tokens"])
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        if self.by_words:
            between = self.tokenizer.encode("\0", add_special_tokens=False).ids
            marks = [self.tokenizer.encode(chr(b), add_special_tokens=False).ids if _MARKS[b] else [0] for b in range(256)]
            self.by_words = len(between) == 1 and all(len(m) == 1 for m in marks)
            self.between, self.mark_ids = between[0], np.asarray([m[0] for m in marks], dtype="<u4")

    @classmethod
    def of(cls, path: str, cache: int) -> WordTokenizer:
        if (path, cache) not in cls._kept:
            cls._kept[path, cache] = cls(path, cache)
        return cls._kept[path, cache]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none of a null."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.ones(len(texts), dtype=bool)
        if self.by_words:
            raw = texts.cast(pa.large_binary())  # 0xCC and 0xCD begin the combining marks; a word may be the sign between words
            for sign in (b"<|", b"\xcc", b"\xcd", b"\0"):
                mine = pc.match_substring(raw, sign).to_numpy(zero_copy_only=False)
                whole = mine if sign == b"<|" else whole | mine
        ids = self._by_words(pc.if_else(pa.array(whole), "", texts)) if not whole.all() else None
        for i, alone in enumerate(whole.tolist()):
            split = next(ids) if ids else b""
            yield np.asarray(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes() if alone else split

    def _by_words(self, texts: pa.Array) -> Iterator[bytes]:
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.flatten().dictionary_encode()
        each = coded.dictionary.cast(pa.large_binary())
        n, ends = pc.binary_length(each).to_numpy(), np.frombuffer(each.buffers()[1], dtype=np.int64)[each.offset + 1 : each.offset + len(each) + 1]
        data = np.concatenate((np.zeros(3, dtype=np.uint8), np.frombuffer(each.buffers()[2] or b"", dtype=np.uint8)))
        last, before = data[ends + 2], data[ends + 1]
        marked = (n > 1) & _MARKS[last] & (_LETTERS[before] | ((n > 2) & (data[ends] == 0xC3) & _LATIN[before]))
        bare, cut = np.flatnonzero(~marked), np.flatnonzero(marked)
        stems = pa.concat_arrays([each.take(pa.array(bare)), pc.binary_slice(each.take(pa.array(cut)), 0, -1)]).dictionary_encode()
        ids = self._learnt(stems.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, first = np.concatenate((np.frombuffer(b"".join(ids), dtype="<u4"), self.mark_ids)), np.cumsum(sizes) - sizes
        stem = np.empty(len(each), dtype=np.int64)
        stem[np.concatenate((bare, cut))] = stems.indices.to_numpy(zero_copy_only=False)
        # a distinct word's ids: those of its stem, then that of its mark
        flat, ends = _gathered(flat, np.stack((first[stem], len(flat) - 256 + last.astype(np.int64)), axis=1).reshape(-1), np.stack((sizes[stem], marked.astype(np.int64)), axis=1).reshape(-1))
        sizes = sizes[stem] + marked
        place = coded.indices.to_numpy(zero_copy_only=False)
        flat, ends = _gathered(flat, (ends[1::2] - sizes)[place], sizes[place])
        at = np.concatenate(([0], ends))[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield flat[lo:hi].tobytes()

    def _learnt(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, known from now on."""
        ids = list(map(self.known.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        if len(self.known) + len(unknown) > self.most:
            self.older, self.known = self.known, {}
        known, older, tokenize, others = self.known, self.older, self.tokenizer.model.tokenize, []
        for i in unknown:
            w = words[i]
            if (x := older.get(w)) is None:
                if w.isalpha():
                    x = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
                elif self._small.fullmatch(w):
                    x = array("I", [t.id for t in tokenize(w.decode("latin-1").translate(_BYTE_SIGNS))]).tobytes()
                else:
                    others.append(i)
                    continue
            ids[i] = known[w] = x
        if others:
            together = self.tokenizer.encode_batch_fast([" \0 ".join([words[i].decode() for i in others])], add_special_tokens=False)[0]
            found = np.asarray(together.ids, dtype="<u4")
            data, lo = found.tobytes(), 0
            for i, hi in zip(others, [*(np.flatnonzero(found == self.between) * 4).tolist(), len(data)], strict=True):
                ids[i] = known[words[i]] = data[lo:hi]
                lo = hi + 4
        return ids


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _slices(batches: Iterator[pa.RecordBatch], most: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts (column 1) have about ``most`` bytes."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def pieces(docs: DataFrame, rules: PackRules, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs."""
    path, size, end, cache, most = rules.vocabulary, rules.capacity, np.asarray([rules.end_id], dtype="<u4").tobytes(), rules.cache, rules.slice_bytes

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path, cache)
        for batch in _slices(batches, most):
            rows: list[tuple] = []
            for i, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where the pieces of each length go: runs of (first rank, last rank excluded, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
            self.left[length] = n
        self.given = np.zeros(capacity + 1, dtype=np.int64)
        self.runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, n: int, first: int, per: int, offset: int) -> None:
        """The next n pieces of a length, per of them in each sequence from first on."""
        if n:
            self.runs.setdefault(length, []).append((int(self.given[length]), int(self.given[length]) + n, first, per, offset))
            self.given[length] += n
            self.left[length] -= n

    def _reduce(self) -> None:
        """Fixes {i} where nothing fits beside i, and {i, k} with the largest k that fits, where that dominates all sets with i."""
        c, changed = self.capacity, True
        while changed:
            changed = False
            for i in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[i]:
                    others = self.left.copy()
                    others[i] -= 1
                    room, there = c - i, np.flatnonzero(others)
                    fit = there[there <= room]
                    if not len(fit):
                        n = int(self.left[i]) if 2 * i > c else 1
                        self._place(i, n, self.sequences, 1, 0)
                        self.sequences += n
                        changed = True
                        continue
                    k = int(fit[-1])
                    if not (k == room or self._pair_dominates(others, fit, k, room)):
                        break
                    n = int(self.left[i] // 2 if i == k else min(self.left[i], self.left[k]))
                    if i == k:
                        self._place(i, 2 * n, self.sequences, 2, 0)
                    else:
                        self._place(i, n, self.sequences, 1, 0)
                        self._place(k, n, self.sequences, 1, i)
                    self.sequences += n
                    changed = True
        self.fixed = self.sequences

    @staticmethod
    def _pair_dominates(others: np.ndarray, fit: np.ndarray, k: int, room: int) -> bool:
        """Whether k alone replaces whatever else fits into the room: no two items, or no three and each fitting two at most as large as k together."""
        small = np.repeat(fit[:3], np.minimum(others[fit[:3]], 3))[:3].tolist()
        if len(small) < 2 or small[0] + small[1] > room:
            return True
        if len(small) == 3 and sum(small) <= room:
            return False
        mate = np.searchsorted(fit, room - fit, side="right") - 1  # the largest that fits with each
        single = (mate >= 0) & (fit[mate] == fit) & (others[fit] < 2)
        mate = np.where(single, mate - 1, mate)
        pairs = np.where(mate >= 0, fit + fit[mate], 0)
        return int(pairs.max(initial=0)) <= k

    def _best_fit(self) -> None:
        """Best-fit decreasing: groups of equal, equally filled sequences lie by the room that is left in them."""
        c = self.capacity
        rooms: list[int] = []  # ascending, those with a group
        groups: dict[int, list[tuple[int, int]]] = {}

        def keep(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in groups:
                    groups[room] = []
                    bisect.insort(rooms, room)
                groups[room].append((first, n))

        for length in np.flatnonzero(self.left)[::-1].tolist():
            while n := int(self.left[length]):
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    room, first, many = c, self.sequences, -(-n // (c // length))
                    self.sequences += many
                else:
                    room = rooms[at]
                    first, many = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                per = room // length
                whole = min(many, n // per)
                self._place(length, whole * per, first, per, c - room)
                keep(room - per * length, first, whole)
                if whole < many:
                    rest = min(n - whole * per, per - 1) if n > whole * per else 0
                    self._place(length, rest, first + whole, max(rest, 1), c - room)
                    keep(room - rest * length, first + whole, 1)
                    keep(room, first + whole + 1, many - whole - 1)

    def arrays(self) -> dict[int, np.ndarray]:
        return {k: np.asarray(v, dtype=np.int64) for k, v in self.runs.items()}


def pack(cut: DataFrame, rules: PackRules) -> DataFrame:
    """The pieces with sequence_id and offset; cut must be stored, since it is read twice."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = Plan(counts, rules.capacity).arrays()
    salts = max(rules.salts, -(-max(counts.values(), default=0) // rules.salt_rows))
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    sums = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))  # a row for each length and salt
    sums = sums.select("length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__before"))
    ranked = salted.withColumn("__row", F.row_number().over(inside)).join(sums, ["length", "__salt"])
    ranked = ranked.select(*PIECES.names, (F.col("__before") + F.col("__row") - 1).alias("rank"))
    out = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for one in np.unique(length).tolist():
                mine = np.flatnonzero(length == one)
                run = runs[one]
                at = run[np.searchsorted(run[:, 0], rank[mine], side="right") - 1]
                k = rank[mine] - at[:, 0]
                sequence[mine], offset[mine] = at[:, 2] + k // at[:, 3], at[:, 4] + k % at[:, 3] * one
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(PIECES))], pa.array(sequence), pa.array(offset)], schema=out)

    return ranked.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, rules: PackRules | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rules = rules or PackRules(public_vocabulary())
    ensure_checkpoint_dir(docs.sparkSession)
    return pack(pieces(docs, rules, doc_id, text).checkpoint(), rules)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
