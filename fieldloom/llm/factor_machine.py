"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is the logistic of w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2): all pairs
of features interact through k factors, in time linear in the features. Words are hashed into 2^15 buckets, weighed so
that a document's words have unit length; statistics of its characters, words and lines, and the recorded length, fall
into fixed bins.

The machine is fitted on the driver from at most ``sample_rows`` labelled rows and ``sample_entries`` features of them
(those with the least md5 of the id, so reruns agree); scoring is one narrow pass over whole texts. Labels, language,
source and id are never features.

Defined results: null, empty and blank texts have statistics but no words, and get a score as any other; a null label is
no label; several labels of one id all count; a null id is never held out; repeated rows score alike; a score ties with
the threshold as 1; without labels every score is 0.5; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import hashing, postings
from fieldloom.llm.common import free_name, table
from fieldloom.llm.memory import give_back, released
from fieldloom.session import stored

BUCKETS = 1 << 15
#: Upper edges of the bins of ratios, and of logarithms and means.
RATIOS = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6, 0.9])
SCALES = np.array([1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 10.0])
#: Names of the statistics in order; those after "digits" on a scale instead of a ratio end the list.
STATISTICS = ("upper", "digits", "marks", "bars", "shouts", "stops", "breaks", "foreign", "distinct", "repeated_lines", "short_lines", "word_length", "log_words", "log_recorded")
SCALED = 3
BINS = len(RATIOS) + 1
SIZE = BUCKETS + len(STATISTICS) * BINS

_CLASSES = np.zeros((256, 7), dtype=np.float64)
for _k, _bytes in enumerate((range(65, 91), range(48, 58), b"#*$%&<>@^~_=+\\", b"|", b"!?", b".,;:", range(128, 256))):
    _CLASSES[list(_bytes), _k] = 1
_LETTERS = np.zeros(256)
_LETTERS[[*range(65, 91), *range(97, 123)]] = 1


@dataclass(frozen=True)
class ClassifierRules:
    sample_rows: int = 8000
    sample_entries: int = 6_000_000
    factors: int = 8
    steps: int = 750  # mini-batches at least, in whole passes over the sample
    batch: int = 128
    rate: float = 0.08
    decay: float = 1e-5
    seed: int = 11
    threshold: float = 0.3


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x k

    def logits(self, at: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """at: where each row's features begin, and their number at the end; every row has a feature."""
        v = self.factors[index] * value[:, None]
        s = np.add.reduceat(v, at[:-1], axis=0)
        q = np.add.reduceat((v * v).sum(axis=1), at[:-1])
        return self.bias + np.add.reduceat(self.weights[index] * value, at[:-1]) + 0.5 * ((s * s).sum(axis=1) - q)


def _statistics(texts: list[str | None], recorded: list, words: np.ndarray, bounds: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(STATISTICS)))
    n = np.maximum(np.diff(bounds), 1)
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        c = counts @ _CLASSES
        size, letters = max(1, len(raw)), max(1.0, counts @ _LETTERS)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[i, :8] = c[0] / letters, c[1] / size, c[2] / size, c[3] / n[i], c[4] / n[i], c[5] / n[i], counts[10] / n[i], c[6] / size
        out[i, 9] = 1 - len(set(lines)) / max(1, len(lines))
        out[i, 10] = sum(len(x) < 40 for x in lines) / max(1, len(lines))
        out[i, 11] = (len(raw) - counts[32] - counts[10]) / n[i]
        out[i, 13] = np.log1p(max(0, recorded[i] or 0))
    out[:, 8] = distinct / n
    out[:, 12] = np.log1p(np.diff(bounds))
    return out


def rows_of_features(texts: list[str | None], recorded: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, at, index, value) of slices of texts."""
    for lo, hi in hashing.slices(texts):
        words, bounds = hashing.word_hashes(texts[lo:hi])
        row = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(bounds))
        pair = np.unique((row << np.uint64(15)) | (words & np.uint64(BUCKETS - 1)))
        row = (pair >> np.uint64(15)).astype(np.int64)
        per_row = np.bincount(row, minlength=hi - lo)
        stats = _statistics(texts[lo:hi], recorded[lo:hi], words, bounds, per_row)
        bins = np.concatenate([np.searchsorted(RATIOS, stats[:, :-SCALED]), np.searchsorted(SCALES, stats[:, -SCALED:])], axis=1)
        fixed = BUCKETS + np.arange(len(STATISTICS)) * BINS + bins
        index = np.concatenate([(pair & np.uint64(BUCKETS - 1)).astype(np.int64), fixed.ravel()])
        value = np.concatenate([1 / np.sqrt(per_row[row]), np.full(fixed.size, 1 / np.sqrt(len(STATISTICS)))])
        owner = np.concatenate([row, np.repeat(np.arange(hi - lo), len(STATISTICS))])
        order = np.argsort(owner, kind="stable")
        at = np.concatenate(([0], np.cumsum(per_row + len(STATISTICS))))
        yield lo, hi, at, index[order].astype(np.int32), value[order].astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rules: ClassifierRules = ClassifierRules()) -> Machine:
    """rows: index, value and label (0 or 1). Mini-batches with adaptive steps, in an order that the seed fixes."""
    rng = np.random.default_rng(rules.seed)
    k = rules.factors
    w, v = np.zeros(SIZE, dtype=np.float32), rng.normal(0, 0.01 if rows else 0.0, (SIZE, k)).astype(np.float32)
    gw, gv, bias, gb = np.full(SIZE, 1e-6, dtype=np.float32), np.full((SIZE, k), 1e-6, dtype=np.float32), 0.0, 1e-6
    batches = max(1, len(rows) // rules.batch, min(8, len(rows) // 16))
    for _ in range(-(-rules.steps // batches) if rows else 0):
        order = rng.permutation(len(rows))
        for some in np.array_split(order, batches):
            mine = [rows[i] for i in some]
            lengths = np.asarray([len(r[0]) for r in mine])
            at = np.concatenate(([0], np.cumsum(lengths)))
            index, x, y = np.concatenate([r[0] for r in mine]), np.concatenate([r[1] for r in mine]), np.asarray([r[2] for r in mine])
            vx = v[index] * x[:, None]
            s = np.add.reduceat(vx, at[:-1], axis=0)
            z = bias + np.add.reduceat(w[index] * x, at[:-1]) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), at[:-1]))
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(mine)).astype(np.float32)
            e = np.repeat(error, lengths)[:, None]
            ids, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, weights=(e[:, 0] * x), minlength=len(ids)).astype(np.float32) + rules.decay * w[ids]
            part = e * x[:, None] * (np.repeat(s, lengths, axis=0) - vx)
            dv = np.stack([np.bincount(back, weights=part[:, f], minlength=len(ids)) for f in range(k)], axis=1).astype(np.float32) + rules.decay * v[ids]
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w[ids] -= rules.rate * dw / np.sqrt(gw[ids])
            v[ids] -= rules.rate * dv / np.sqrt(gv[ids])
            gb += float(error.sum()) ** 2
            bias -= rules.rate * float(error.sum()) / gb**0.5
    return Machine(bias, w, v)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _inputs(docs: DataFrame, doc_id: str, text: str, recorded: str) -> DataFrame:
    length = docs[recorded].cast("long") if recorded in docs.columns else F.length(docs[text]).cast("long")
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), length.alias("recorded"))


def train(docs: DataFrame, labels: DataFrame, rules: ClassifierRules = ClassifierRules(), doc_id: str = "doc_id", text: str = "text", recorded: str = "n_chars") -> Machine:
    """Fits a machine on a bounded sample of the labelled rows that are not held out."""
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id")))
    sample = known.orderBy(F.md5(F.col("id").cast("string")), "id", "label").limit(rules.sample_rows)
    mine = _inputs(docs, doc_id, text, recorded).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))  # at most sample_rows rows

    @released
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, label = postings.column(b, "doc_id").to_pylist(), postings.column(b, "label").to_pylist()
            for lo, hi, at, index, value in rows_of_features(postings.column(b, "text").to_pylist(), postings.column(b, "recorded").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi]), pa.array(label[lo:hi], pa.int32()), pa.array([index[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]), pa.array([value[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)])],
                    ["id", "label", "index", "value"],
                )

    features = mine.mapInArrow(extract, "id long, label int, index binary, value binary")
    keyed = features.select("*", F.md5(F.col("id").cast("string")).alias("key"), (F.octet_length("index") / 4).cast("long").alias("entries"))
    order = ["key", "id", "label", "entries", "digest"]
    keyed = stored(keyed.withColumn("digest", F.md5("index")))
    sizes = keyed.select(*order).orderBy(*order).limit(rules.sample_rows).collect()  # a few numbers a row
    fits = int(np.searchsorted(np.cumsum([r["entries"] for r in sizes]), rules.sample_entries, side="right"))
    taken = keyed.filter(F.struct(*order) <= F.struct(*[F.lit(sizes[fits - 1][c]).cast(keyed.schema[c].dataType) for c in order])) if fits else keyed.filter("false")
    found = taken.orderBy(*order).limit(fits).select("index", "value", "label").toLocalIterator()  # at most sample_entries features
    rows = [(np.frombuffer(r["index"], dtype=np.int32), np.frombuffer(r["value"], dtype=np.float32), r["label"]) for r in found]
    machine = fit(rows, rules)
    rows.clear()
    give_back()
    return machine


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", recorded: str = "n_chars") -> DataFrame:
    """doc_id and score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE * (factors + 1) numbers

    @released
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, at, index, value in rows_of_features(b.column(1).to_pylist(), b.column(2).to_pylist()):
                z = shared.value.logits(at, index, value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))], schema=SCORES)

    return _inputs(docs, doc_id, text, recorded).mapInArrow(rate, "doc_id long, score double")


def op6_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = table(spark, sf_dir, "documents"), ClassifierRules()
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), rules))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= rules.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine, rules: ClassifierRules = ClassifierRules(), text: str = "text", recorded: str = "n_chars") -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def rate(texts: pd.Series, lengths: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        known = [None if x is None or x != x else x for x in lengths.tolist()]
        for lo, hi, at, index, value in rows_of_features(texts.tolist(), known):
            z = shared.value.logits(at, index, value)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
        return pd.Series(out)

    length = (docs[recorded] if recorded in docs.columns else F.length(docs[text])).cast("double")
    scored = free_name("score", docs)
    return docs.withColumn(scored, rate(docs[text], length)).filter(F.col(scored) >= rules.threshold).drop(scored)
