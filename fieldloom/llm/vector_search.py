"""Approximate nearest neighbours by balanced posting lists.

* Equal vectors make one class; a class keeps its ``k + 1`` least ids, which is all that any answer can hold of it.
* Centroids come from a bounded sample by balanced bisection, so lists start with equal shares; they are held in memory
  as a neighbour graph, which vectors and queries walk by a beam, many at a time.
* A vector joins its nearest list, and as a boundary vector up to ``copies`` lists that are nearly as near.
* A query visits the lists whose distance is within a ratio of its nearest list's; every list is cut into blocks of
  bounded size, blocks score exactly in double precision, and each gives a query its best ``k + 1`` classes.
* The ratio and the beam are least values: before the search ``trials`` queries are compared with every vector, and both
  grow until the lists visited hold ``recall`` of their true neighbours, as they must when a table has more lists.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2); a query has 0 there. M is the
largest norm, or a little over the norm that one in ``far_share`` vectors exceeds, if that is less: the few longer vectors
are a list of their own that every query visits, so that no outlier flattens the distances of all others. The sample and
the number of lists have documented bounds (sample_rows, most_lists: what the driver holds and every task gets); every
vector is indexed. Beyond most_lists * list_size vectors lists grow, and are searched in more blocks.

Defined results: vectors that are null, zero, of another length than most (ties: the longer), or that hold null or
non-finite components take no part, nor do rows with a null id; repeated rows (id and vector) count once, and one id with
several vectors is several rows, of which a query leaves out all of its own id; equal scores go by smaller id; fewer than
k candidates give fewer rows; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import postings
from fieldloom.llm.common import let, shuffle_partitions, table
from fieldloom.session import stored


@dataclass(frozen=True)
class SearchRules:
    k: int = 20
    every: int = 20  # ids divisible by it are queries
    sample_rows: int = 262_144
    list_size: int = 1024
    most_lists: int = 16_384
    far_share: int = 2048
    neighbours: int = 24  # of a centroid in the graph
    beam: int = 192
    copies: int = 3
    near: float = 1.03  # ratio of distances for boundary copies
    visit: float = 1.12  # ratio of distances for a query's lists
    trials: int = 128  # queries compared with all vectors
    recall: float = 0.95  # share of their true neighbours that the lists visited hold at least
    block_rows: int = 16_384
    seed: int = 3


@dataclass(frozen=True)
class Graph:
    """Centroids and, for each, its neighbours; entry points are spread over the bisection's leaves."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x up to ``beam`` centroids by rising distance: places (-1: none) and distances, found by walking the graph."""
        c, n = self.centroids, len(self.centroids)
        beam, q, stride = min(beam, n), len(x), 4
        square = (c * c).sum(axis=1)
        own = (x * x).sum(axis=1)
        seen = np.zeros((q, n), dtype=bool)
        place = np.full((q, beam), -1, dtype=np.int64)
        far = np.full((q, beam), np.inf)
        walked = np.ones((q, beam), dtype=bool)
        rows = np.arange(q)
        new = np.broadcast_to(self.entries, (q, len(self.entries)))
        while True:
            # several open nodes may have a neighbour in common: the first of equal places counts
            order = np.argsort(new, axis=1, kind="stable")
            new = np.take_along_axis(new, order, 1)
            fresh = ~seen[rows[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            np.put_along_axis(seen, new, True, axis=1)
            d = np.where(fresh, square[new] - 2 * np.einsum("qd,qmd->qm", x, c[new]), np.inf)
            place, far, walked = np.concatenate((place, new), 1), np.concatenate((far, d), 1), np.concatenate((walked, ~fresh), 1)
            best = np.argsort(far, axis=1, kind="stable")[:, :beam]
            place, far, walked = (np.take_along_axis(v, best, 1) for v in (place, far, walked))
            walked |= ~np.isfinite(far)
            if walked.all():
                break
            at = np.argsort(walked, axis=1, kind="stable")[:, :stride]  # the nearest open ones first
            walking = ~np.take_along_axis(walked, at, 1)
            np.put_along_axis(walked, at, True, axis=1)
            new = self.links[np.where(walking, np.take_along_axis(place, at, 1), self.entries[0])].reshape(q, -1)
            seen[~walking.any(axis=1)] = True  # a row that has ended takes nothing more
        place[~np.isfinite(far)] = -1
        return place, np.sqrt(np.maximum(far + own[:, None], 0))


def build_graph(sample: np.ndarray, lists: int, rules: SearchRules) -> Graph:
    """Balanced bisection: each cut runs between the two means of a part and halves it."""
    rng = np.random.default_rng(rules.seed)
    leaves = [sample]
    while len(leaves) < lists and min(len(p) for p in leaves) >= 4:
        cut: list[np.ndarray] = []
        for p in leaves:
            means = p[rng.choice(len(p), 2, replace=False)]
            for _ in range(6):
                lean = p @ (means[1] - means[0])
                order = np.argsort(lean, kind="stable")
                half = len(p) // 2
                means = np.stack((p[order[:half]].mean(axis=0), p[order[half:]].mean(axis=0)))
            cut += [p[order[:half]], p[order[half:]]]
        leaves = cut
    c = np.stack([p.mean(axis=0) for p in leaves])
    m, square, near = min(rules.neighbours, len(c)), (c * c).sum(axis=1), []
    for lo in range(0, len(c), 512):
        d = square[None, :] - 2 * c[lo : lo + 512] @ c.T
        some = np.argpartition(d, m - 1, axis=1)[:, :m]
        near.append(np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1))
    links = np.concatenate(near)
    # the next leaf is a neighbour of each, so that the walk reaches every centroid
    links = np.concatenate((links, (np.arange(len(c))[:, None] + [1, len(c) // 2 + 1]) % len(c)), axis=1)
    return Graph(c, links, np.unique(np.linspace(0, len(c) - 1, min(16, len(c))).astype(np.int64)))


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v (array of doubles): the rows that take part."""
    v = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[embedding].cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(fine)
    common = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return v.filter(F.size("v") == (common["n"] if common else 0)).select("id", F.transform("v", lambda x: x + 0.0).alias("v"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = postings.column(batch, name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _classes(valid: DataFrame, keep: int) -> DataFrame:
    """cid (least id), v, members: the least ids of each distinct vector; summed in batches before they are shuffled."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, v = postings.column(b, "id").to_numpy(zero_copy_only=False), _matrix(b, "v")
                each, back = np.unique(v, axis=0, return_inverse=True)
                order = np.lexsort((ids, back.reshape(-1)))
                at = postings.runs(back.reshape(-1)[order])
                some = [np.unique(ids[order[lo:hi]])[:keep] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(each), pa.list_(pa.float64())), pa.array(some, pa.list_(pa.int64()))], ["v", "members"])

    merged = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, keep)
    found = valid.mapInArrow(least, "v array<double>, members array<long>")
    found = found.groupBy("v", F.pmod(F.xxhash64("members"), F.lit(32)).alias("salt")).agg(merged("members").alias("members")).groupBy("v").agg(merged("members").alias("members"))
    return found.select(F.xxhash64("v", F.lit(1)).alias("cid"), "v", "members", F.element_at("members", 1).alias("least"))


PACKED = pa.schema([("list", pa.int32()), ("block", pa.int32()), ("query", pa.bool_()), ("keys", pa.binary()), ("least", pa.binary()), ("vectors", pa.binary())])
PACKED_DDL = "list int, block int, query boolean, keys binary, least binary, vectors binary"
FOUND_DDL = "qid long, found array<struct<s:double,least:long,cid:long>>"


@dataclass(frozen=True)
class Index:
    """The graph, the norm that longer vectors are set apart by, and whether there are any."""

    graph: Graph
    norm: float
    far: bool

    def lists_of(self, v: np.ndarray, rules: SearchRules, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the places of lists by rising distance, and which of them it goes to; the list after the last holds those set apart."""
        square = (v * v).sum(axis=1)
        lift = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm**2 - square, 0))
        place, far = self.graph.nearest(np.concatenate((v, lift[:, None]), axis=1), rules.beam if query else max(16, rules.copies))
        take = (place >= 0) & (far <= far[:, :1] * (rules.visit if query else rules.near))
        if query:
            place = np.concatenate((place, np.full((len(v), 1), len(self.graph.centroids))), axis=1)
            return place, np.concatenate((take, np.full((len(v), 1), self.far)), axis=1)
        take[:, rules.copies :] = False
        apart = square > self.norm**2
        place[apart, 0], take[apart] = len(self.graph.centroids), np.arange(take.shape[1]) == 0
        return place, take


def _lifted(v: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate((v, np.sqrt(np.maximum(norm**2 - (v * v).sum(axis=1), 0))[:, None]), axis=1)


def _neighbours(classes: DataFrame, trials: list, shared, rules: SearchRules) -> DataFrame:
    """q, lists: for each true neighbour of a trial query (cid, v), by brute force over all classes, the lists that hold it."""
    own, asked, k = np.array([t["cid"] for t in trials]), np.asarray([t["v"] for t in trials], dtype=np.float64), rules.k

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, held, v = np.full((len(asked), 0), -np.inf), np.zeros((len(asked), 0), dtype=np.int64), np.zeros((0, asked.shape[1]))
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                cid, new = postings.column(b, "cid").to_numpy(zero_copy_only=False), _matrix(b, "v")
                found = np.where(own[:, None] == cid[None, :], -np.inf, asked @ new.T)
                score, held = np.concatenate((score, found), axis=1), np.concatenate((held, np.broadcast_to(len(v) + np.arange(len(new)), found.shape)), axis=1)
                v = np.concatenate((v, new))
                if score.shape[1] > k:
                    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, held = np.take_along_axis(score, at, 1), np.take_along_axis(held, at, 1)
                kept, held = np.unique(held, return_inverse=True)  # at most trials x k vectors stay
                v, held = v[kept], held.reshape(score.shape)
        if len(v):
            place, take = shared.value.lists_of(v, rules, False)
            lists = [p[t].tolist() for p, t in zip(place, take, strict=True)]
            q, at = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(-score[q, at]), pa.array([lists[i] for i in held[q, at].tolist()], pa.list_(pa.int32()))], ["q", "s", "lists"])

    found = classes.select("cid", "v").mapInArrow(best, "q int, s double, lists array<int>")
    found = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "lists"))), 1, k).alias("f"))  # k of each partition
    return found.select("q", F.explode("f.lists").alias("lists"))


def calibrated(classes: DataFrame, asked: DataFrame, shared, rules: SearchRules) -> SearchRules:
    """The rules with the beam and the ratio that trial queries need."""
    index, n = shared.value, len(shared.value.graph.centroids)
    trials = asked.select("cid", "v").orderBy(F.xxhash64("cid", F.lit(7)), "cid").limit(rules.trials).collect() if n > 1 else []
    truth = _neighbours(classes, trials, shared, rules).collect() if trials else []  # trials x k rows
    if not truth:
        return rules
    x = np.asarray([t["v"] for t in trials], dtype=np.float64)

    def share(r: SearchRules) -> float:
        place, take = index.lists_of(x, r, True)
        visited = [set(p[t].tolist()) for p, t in zip(place, take, strict=True)]
        return sum(not visited[t["q"]].isdisjoint(t["lists"]) for t in truth) / len(truth)

    while share(rules) < rules.recall:  # ends: at last every list is visited
        whole = replace(rules, beam=n)
        if rules.beam >= n or share(whole) < rules.recall:
            rules = replace(rules, visit=rules.visit * 1.03)
        else:
            rules = replace(rules, beam=min(n, 2 * rules.beam))
    return rules


def _dealt(frame: DataFrame, shared, rules: SearchRules, blocks: int, query: bool) -> DataFrame:
    """The vectors of a frame (cid, v, least) packed by the lists and blocks they go to."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for b in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                cid, least, v = postings.column(b, "cid").to_numpy(zero_copy_only=False), postings.column(b, "least").to_numpy(zero_copy_only=False), _matrix(b, "v")
                place, take = index.lists_of(v, rules, query)
                row, at = np.nonzero(take)
                lists = place[row, at]
                if query:
                    row, lists, block = np.tile(row, blocks), np.tile(lists, blocks), np.repeat(np.arange(blocks), len(row))
                else:
                    block = (cid[row].view(np.uint64) % np.uint64(blocks)).astype(np.int64)
                order = np.lexsort((block, lists))
                row, lists, block = row[order], lists[order], block[order]
                ends = postings.runs(lists * blocks + block)
                rows = [(int(lists[lo]), int(block[lo]), query, cid[row[lo:hi]].tobytes(), least[row[lo:hi]].tobytes(), v[row[lo:hi]].tobytes()) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED.types, strict=True)], schema=PACKED)

    return frame.select("cid", "v", "least").mapInArrow(deal, PACKED_DDL)


def _scored(packed: DataFrame, keep: int) -> DataFrame:
    shape = pa.schema([("qid", pa.int64()), ("found", pa.list_(pa.struct([("s", pa.float64()), ("least", pa.int64()), ("cid", pa.int64())])))])

    def compare(group: pa.Table) -> pa.Table:
        sides = {}
        for q in (False, True):
            mine = group.filter(pa.compute.equal(group.column("query"), q))
            keys, least, v = (b"".join(mine.column(k).to_pylist()) for k in ("keys", "least", "vectors"))
            keys = np.frombuffer(keys, dtype="<i8")
            sides[q] = keys, np.frombuffer(least, dtype="<i8"), np.frombuffer(v, dtype="<f8").reshape(len(keys), -1) if len(keys) else None
        (cid, least, v), (qid, _, qv) = sides[False], sides[True]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        top = min(len(cid), keep + 4)
        for lo in range(0, len(qid) if len(cid) else 0, 256):
            q = qv[lo : lo + 256]
            s = q @ v.T
            best = np.argpartition(s, len(cid) - top, axis=1)[:, len(cid) - top :]
            edge = np.take_along_axis(s, best, 1).min(axis=1)
            ties = (s >= (edge - np.abs(edge) * 1e-12 - 1e-300)[:, None]).sum(axis=1) > top
            exact = (q[:, None, :] * v[best]).sum(axis=2)  # the same sum wherever the pair is met
            order = np.lexsort((least[best], -exact), axis=1)[:, :keep]
            best, exact = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
            for i in np.flatnonzero(ties).tolist():  # more equal scores than places at the edge
                at = np.flatnonzero(s[i] >= edge[i] - np.abs(edge[i]) * 1e-12 - 1e-300)
                score = (q[i] * v[at]).sum(axis=1)
                at = at[np.lexsort((least[at], -score))[: best.shape[1]]]
                best[i], exact[i] = at, (q[i] * v[at]).sum(axis=1)
            parts.append((best, exact))
        wide = min(keep, top)
        best = np.concatenate([p[0] for p in parts]).reshape(-1) if parts else np.zeros(0, dtype=np.int64)
        exact = np.concatenate([p[1] for p in parts]).reshape(-1) if parts else np.zeros(0)
        found = pa.StructArray.from_arrays([pa.array(-exact), pa.array(least[best]), pa.array(cid[best])], fields=list(shape.field(1).type.value_type))
        n = len(qid) if parts else 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * wide), found)
        return pa.Table.from_arrays([pa.array(qid[:n], pa.int64()), lists.cast(shape.field(1).type)], schema=shape)

    return packed.groupBy("list", "block").applyInArrow(compare, FOUND_DDL)


def search(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", rules: SearchRules = SearchRules()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest k of all other rows, nearest first."""
    r, spark = rules, vectors.sparkSession
    valid = _valid(vectors, vec_id, embedding)
    classes = stored(_classes(valid, r.k + 1))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = classes.select(square.alias("s")).agg(F.count("*"), F.max("s"), F.percentile_approx("s", 1 - 1 / r.far_share, 100_000)).first()
    n, most, usual = size[0], float(size[1] or 0) ** 0.5, 1.05 * float(size[2] or 0) ** 0.5
    norm = min(most * (1 + 1e-9), usual)  # above all norms, however they are summed, or else some vectors are set apart
    lists = min(r.most_lists, max(1, n // r.list_size))
    want = min(r.sample_rows, 64 * lists)
    h, grain = F.xxhash64("v", F.lit(5)), 1 << 24
    sampled = classes.filter((square <= norm**2) & (F.pmod(h, F.lit(grain)) < -(-grain * want // max(n, 1)))).select(h.alias("h"), "v").toArrow()  # about sample_rows vectors at most, by hash
    order = np.argsort(sampled.column("h").to_numpy(), kind="stable")
    points = sampled.column("v").combine_chunks()
    points = points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)[order] if len(points) else np.zeros((0, 1))
    graph = build_graph(_lifted(points, norm), lists, r) if len(points) else Graph(np.zeros((1, 1)), np.zeros((1, 1), dtype=np.int64), np.zeros(1, dtype=np.int64))
    shared = spark.sparkContext.broadcast(Index(graph, norm, most > norm))  # at most most_lists centroids and their links
    blocks = max(1, -(-n * r.copies // (len(graph.centroids) * r.block_rows)))
    asking = valid.filter(F.col("id") % r.every == 0).select("id", F.xxhash64("v", F.lit(1)).alias("qid")).distinct()
    asked = classes.join(asking.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi")
    r = calibrated(classes, asked, shared, r)
    packed = _dealt(classes, shared, r, blocks, False).unionByName(_dealt(asked, shared, r, blocks, True))
    best = _scored(packed.repartition(shuffle_partitions(spark), "list", "block"), r.k + 1)
    gathered = best.groupBy("qid").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))  # k + 1 of each visited block
    new = let(F.col("found"), lambda f: F.filter(f, lambda x, i: (i == 0) | (F.get(f, i - 1)["cid"] != x["cid"])))  # copies of a class score alike, so they are neighbours
    top = gathered.select("qid", F.slice(new, 1, r.k + 1).alias("found"))
    near = top.select("qid", F.explode("found").alias("f")).select("qid", "f.s", "f.cid").join(classes.select("cid", "members"), "cid")
    rows = near.select("qid", F.transform("members", lambda m: F.struct(F.col("s"), m.alias("m"))).alias("found"))
    rows = rows.groupBy("qid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, r.k + 1).alias("found"))  # at most (k + 1)^2
    mine = asking.join(rows, "qid").select("id", F.slice(F.filter("found", lambda f: f["m"] != F.col("id")), 1, r.k).alias("found"))
    out = mine.select(F.col("id").alias("query_id"), F.posexplode("found").alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.m").alias("vec_id"), (-F.col("f.s")).alias("score"))


def op3_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
