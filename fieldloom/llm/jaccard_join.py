"""Jaccard join of documents on word shingles: a grouped prefix join that links every pair at the threshold.

1. Equal sets make one class, known by a 64-bit key (hashing.set_key); copies are never compared.
2. Shingles that about 1/heavy_share of all sets hold are found first, by counts of each task's chunks, and come last in
   the order of all shingles. Every other shingle's number of classes is counted exactly (postings), so that no part of
   those counts is hot. Shingles of one class cannot link anything, so only the others return to their class, rarest
   first; the prefix of a set of n shingles is the first n - ceil(t n) + 1 of that order, and two sets at the threshold
   t share a shingle of both prefixes.
3. Classes with the same prefix and size make one group. Pairs of groups come from the lists of groups that hold a prefix
   shingle: equal lists of at most ``list_groups`` are one list with a weight, whose pairs are filtered by size, and
   then by position: how many shingles both prefixes share bounds what the sets can share, since every shingle up to the
   earlier of the two prefixes' ends is decided. A pair that is left is expanded to its members under one of its groups.
4. A shingle that more groups hold is never listed in pairs. Its groups, and pairs of groups of many members, make
   clusters by stars around the least group (by size classes a factor 1/t apart, in two levels by salt, so that a shingle
   that a third of all groups share is never joined in one task), and clusters are cut into blocks of bounded texts.
5. Members meet once, in a pair of groups or of blocks, and are verified on whole texts by integer products of sparse
   sets of 64-bit shingle hashes. What leaves is a spanning forest of the links and each member's number of links: rows
   grow with members, not with pairs.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of fewer words than the
shingle has one shingle; a row with a null id links with nothing and its component is null; repeated rows are exact
copies of each other; sizes that tie at the threshold link (>=); an empty table gives an empty table; other columns
are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import hashing, postings
from fieldloom.llm.common import free_name, shuffle_partitions, table
from fieldloom.llm.components import connected_components
from fieldloom.llm.memory import give_back, released
from fieldloom.session import stored


@dataclass(frozen=True)
class JoinRules:
    width: int = 5  # words of a shingle
    percent: int = 80
    list_groups: int = 256  # of a shingle whose pairs are listed
    block_members: int = 512
    block_tokens: int = 4_000_000
    salts: int = 64
    heavy_share: int = 256
    hot_share: int = 4096  # a class with more than this part of all rows is dealt to many tasks


FEATURES = pa.schema([("doc_id", pa.int64()), ("owner", pa.int64()), ("n", pa.int64())])
HEAVY = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])
PAIRS = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("sizes", pa.binary()), ("light", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
SHARED = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("sizes", pa.binary()), ("light", pa.binary()), ("tokens", pa.binary()), ("df", pa.binary())])
PREFIXES = pa.schema([("owner", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("heavy", pa.list_(pa.int64())), ("end_df", pa.int64()), ("end_token", pa.int64())])
PREFIXES_DDL = "owner long, n long, prefix array<long>, heavy array<long>, end_df long, end_token long"
VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def features(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """doc_id, owner (the set's key; null without shingles) and n, the set's size."""
    width = rules.width

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in postings.small(batches):
            sets = hashing.shingle_sets(batch.column(1).to_pylist(), width)
            rows = [(hashing.set_key(s) if len(s) else None, len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], schema=FEATURES)

    return docs.mapInArrow(count, "doc_id long, owner long, n long")


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Keys and sets of a task's classes, about postings.CHUNK shingles at a time; copies within a chunk count once."""
    owners: list[int] = []
    sets: list[np.ndarray] = []
    seen: set[int] = set()
    held = 0
    for batch in postings.small(batches):
        for s in hashing.shingle_sets(batch.column(1).to_pylist(), width):
            if not len(s) or (key := hashing.set_key(s)) in seen:
                continue
            seen.add(key)
            owners.append(key)
            sets.append(s)
            held += len(s)
            if held >= postings.CHUNK:
                yield owners, sets
                owners, sets, seen, held = [], [], set(), 0
                give_back()
    if sets:
        yield owners, sets


def heavy_shingles(docs: DataFrame, n_rows: int, rules: JoinRules, parts: int) -> np.ndarray:
    """Shingles, ascending, with at least n_rows / heavy_share occurrences where they are frequent: all that twice that share of the
    sets hold are among them. There are at most heavy_share times the mean size of a set."""
    width, share = rules.width, rules.heavy_share
    least = max(rules.list_groups + 1, -(-n_rows // share))

    @released
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _chunks(batches, width):
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            many = n * 2 * share >= len(sets)
            rows = []
            for part, t, c in postings.cut_by_part(token[many], n[many], parts):
                rows.append((part, t.tobytes(), c.astype("<i8").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), HEAVY.types, strict=True)], schema=HEAVY)

    @released
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            token, back = np.unique(postings.joined(held, "tokens", "<u8"), return_inverse=True)
            n = np.bincount(back, weights=postings.joined(held, "counts", "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([token[n >= least].tobytes()]), pa.array([b""])], schema=HEAVY)

    ddl = "part int, tokens binary, counts binary"
    found = docs.mapInArrow(local, ddl).repartitionById(parts, "part").mapInArrow(add, ddl).select("tokens").collect()
    return np.sort(np.frombuffer(b"".join(bytes(r["tokens"]) for r in found), dtype="<u8"))


def _is_heavy(tokens: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(tokens), dtype=bool)
    return heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens


#: The place of heavy shingles in the order, after all counts.
HEAVY_DF = 1 << 62


def _ordered(tokens: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of unsigned tokens."""
    return (tokens ^ np.uint64(1 << 63)).view(np.int64)


def _prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _pairs(docs: DataFrame, heavy, rules: JoinRules, parts: int) -> DataFrame:
    """Packed (shingle, class) pairs by part, without heavy shingles."""
    width = rules.width

    def flush(owners: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(sets)
        sizes = np.asarray([len(s) for s in sets], dtype=np.int64)
        number = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        light = ~_is_heavy(tokens, heavy.value)
        tokens, number = tokens[light], number[light]
        ids, n, left = np.asarray(owners, dtype="<i8"), sizes.astype("<u4"), np.bincount(number, minlength=len(sets)).astype("<u4")
        rows = []
        for part, t, d in postings.cut_by_part(tokens, number, parts):
            at = postings.runs(d)
            who = d[at[:-1]]
            rows.append((part, ids[who].tobytes(), n[who].tobytes(), left[who].tobytes(), np.diff(at).astype("<u4").tobytes(), postings.squeeze(t)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PAIRS.types, strict=True)], schema=PAIRS)

    @released
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, sets in _chunks(batches, width):
            yield from flush(owners, sets)

    return docs.mapInArrow(spread, "part int, owners binary, sizes binary, light binary, counts binary, tokens binary")


def _heavy_prefixes(docs: DataFrame, heavy, rules: JoinRules) -> DataFrame:
    """As prefix_table: the heavy shingles in the prefix of each class whose prefix reaches that far."""
    width, percent = rules.width, rules.percent

    @released
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, sets in _chunks(batches, width):
            rows = []
            for key, s in zip(owners, sets, strict=True):
                mine = s[_is_heavy(s, heavy.value)]
                if (take := _prefix_length(len(s), percent) - (len(s) - len(mine))) > 0:
                    rows.append((key, len(s), [], mine[:take].view(np.int64), HEAVY_DF, _ordered(mine[take - 1 : take])[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(PREFIXES.types)], schema=PREFIXES)

    return docs.mapInArrow(choose, PREFIXES_DDL)


def _shared(pairs: DataFrame, parts: int) -> DataFrame:
    """The pairs whose token has two owners or more, with that number, dealt out by owner."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = postings.column(held[0], "part")[0].as_py()
        counts = postings.joined(held, "counts", "<u4")
        owners, sizes, light = postings.joined(held, "owners", "<i8"), postings.joined(held, "sizes", "<u4"), postings.joined(held, "light", "<u4")
        tokens = postings.unsqueeze(b"".join(x for b in held for x in postings.column(b, "tokens").to_pylist()))
        del held
        order = np.argsort(tokens, kind="stable")
        at = postings.runs(tokens[order])
        many = np.diff(at) > 1
        kept = order[np.repeat(many, np.diff(at))]
        number = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)[kept]
        tokens = tokens[kept]
        order = np.lexsort((owners[number], tokens))
        tokens, number = tokens[order], number[order]
        who = owners[number]
        if len(tokens):  # a class may come from several tasks
            new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (who[1:] != who[:-1])))
            tokens, who, number = tokens[new], who[new], number[new]
        at = postings.runs(tokens)
        df = np.repeat(np.diff(at), np.diff(at)).astype("<u4")
        kept = df > 1
        tokens, who, number, df = (tokens[kept] | np.uint64(part % 65536) << np.uint64(48)), who[kept], number[kept], df[kept]
        to = (hashing.mix(who.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((who, to))
        to, tokens, who, df, n, left = to[order], tokens[order], who[order], df[order], sizes[number[order]], light[number[order]]
        at = postings.runs(to)
        rows = [(int(to[lo]), who[lo:hi].tobytes(), n[lo:hi].tobytes(), left[lo:hi].tobytes(), tokens[lo:hi].tobytes(), df[lo:hi].tobytes()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SHARED.types, strict=True)], schema=SHARED)

    return pairs.repartitionById(parts, "part").mapInArrow(count, "part int, owners binary, sizes binary, light binary, tokens binary, df binary")


def prefix_table(docs: DataFrame, n_rows: int, rules: JoinRules, parts: int) -> DataFrame:
    """owner, n, prefix (the shared shingles among the first of the set), heavy (the very frequent ones among them) and the place in
    the order of all shingles where the prefix ends (end_df, end_token); no row for a set that cannot link."""
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, n_rows, rules, parts))
    percent = rules.percent

    @released
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        owners, sizes, light = postings.joined(held, "owners", "<i8"), postings.joined(held, "sizes", "<u4").astype(np.int64), postings.joined(held, "light", "<u4").astype(np.int64)
        tokens, df = postings.joined(held, "tokens", "<u8"), postings.joined(held, "df", "<u4")
        order = np.lexsort((tokens, df, owners))
        owners, sizes, light, tokens, df = owners[order], sizes[order], light[order], tokens[order], df[order]
        at = postings.runs(owners)
        n, shared = sizes[at[:-1]], np.diff(at)
        take = np.clip(_prefix_length(n, percent) - (light[at[:-1]] - shared), 0, shared)
        keep = np.flatnonzero(take)
        end, none = at[:-1] + take - 1, pa.array([], pa.int64())
        for some in np.array_split(keep, max(1, len(keep) // 5000)):
            if len(some):
                prefix = pa.array([tokens[at[i] : at[i] + take[i]].view(np.int64) for i in some.tolist()], pa.list_(pa.int64()))
                empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(some) + 1, dtype=np.int32)), none)
                yield pa.RecordBatch.from_arrays([pa.array(owners[at[some]]), pa.array(n[some]), prefix, empty, pa.array(df[end[some]].astype(np.int64)), pa.array(_ordered(tokens[end[some]]))], schema=PREFIXES)

    counted = _shared(_pairs(docs, heavy, rules, parts), parts).repartitionById(parts, "part").mapInArrow(choose, PREFIXES_DDL)
    both = counted.unionByName(_heavy_prefixes(docs, heavy, rules)).groupBy("owner").agg(
        F.first("n").alias("n"), F.collect_list("prefix").alias("p"), F.collect_list("heavy").alias("h"), F.max(F.struct("end_df", "end_token")).alias("end")
    )
    whole = lambda c: F.sort_array(F.array_distinct(F.flatten(c)))
    return both.select("owner", "n", whole("p").alias("prefix"), whole("h").alias("heavy"), "end")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least number of shingles that linked sets of a and b shingles share."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(float(100 + percent)) - 1e-6)


def group_pairs(groups: DataFrame, rules: JoinRules) -> tuple[DataFrame, DataFrame]:
    """The seats of shingles that many groups hold (grp, n, token), and a, b, shared: the other pairs of groups that fit by size, with the
    number of prefix shingles that both hold."""
    most = rules.list_groups
    seats = groups.select("grp", "n", F.explode("prefix").alias("token"))
    counts = seats.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1")
    seats = seats.join(counts, "token")
    wide = seats.filter(F.col("groups") > most).select("grp", "n", "token")
    lists = seats.filter(F.col("groups") <= most).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("grp", "n"))).alias("list"))  # at most list_groups
    lists = lists.groupBy(F.xxhash64("list").alias("key"), "list").agg(F.count("*").alias("weight"))
    later = lambda x, i: F.transform(F.slice("list", i + 2, most), lambda y: F.struct(x["grp"].alias("a"), y["grp"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))
    pairs = lists.select(F.explode(F.flatten(F.transform("list", later))).alias("p"), "weight").select("p.*", "weight")
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * rules.percent
    return wide, pairs.filter(fit).groupBy("a", "b").agg(F.sum("weight").alias("shared"))


def wide_edges(seats: DataFrame, rules: JoinRules) -> DataFrame:
    """Stars (a, b) of the groups that hold a shingle and whose sizes may fit."""
    step = math.log(100 / rules.percent)
    level = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")
    seats = seats.select("grp", "token", F.explode(F.array(level, level + 1)).alias("level"))
    seats = seats.select("grp", F.xxhash64("token", "level").alias("key"), F.pmod(F.xxhash64("grp"), F.lit(rules.salts)).alias("salt"))
    near = seats.groupBy("key", "salt").agg(F.min("grp").alias("mid"))
    far = near.groupBy("key").agg(F.min("mid").alias("top"))
    edges = seats.join(near, ["key", "salt"]).select(F.col("grp").alias("a"), F.col("mid").alias("b"))
    return edges.unionByName(near.join(far, "key").select(F.col("mid").alias("a"), F.col("top").alias("b")))


def meetings(prefixes: DataFrame, classes: DataFrame, rules: JoinRules) -> DataFrame:
    """owner, rep, copies, cluster, bi, bj, side: where classes (owner, rep, copies) meet. In (cluster, bi, bj) all of one side meet all
    of the other; with bi = bj all of the only side meet each other; bi is -1 for a group and its partners."""
    r = rules
    members = stored(prefixes.withColumn("grp", F.xxhash64("n", "prefix", "heavy")).join(classes, "owner"))
    groups = members.groupBy("grp").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "heavy", "end")], F.count("*").alias("members"))
    groups = stored(groups)
    wide, pairs = group_pairs(groups, r)
    wide = stored(wide)
    held = wide.groupBy("grp").agg(F.count("*").alias("wide"))
    known = groups.join(held, "grp", "left").select(
        "grp", "n", "members", "end",
        (F.size("prefix") - F.coalesce("wide", F.lit(0))).alias("listed"),  # prefix shingles that are decided by the pairs
        (F.col("n") - (F.col("n") - F.ceil(F.lit(r.percent) * F.col("n") / 100.0 - 1e-6) + 1 - F.size("prefix") - F.size("heavy"))).alias("most"),  # without those of this set alone
    )
    side = lambda k: known.select(*[F.col(c).alias(f"{c}_{k}") for c in known.columns])
    near = pairs.join(side("a"), F.col("a") == F.col("grp_a")).join(side("b"), F.col("b") == F.col("grp_b"))
    needed = _needed(F.col("n_a"), F.col("n_b"), r.percent)
    bound = lambda k: F.col(f"most_{k}") - (F.col(f"listed_{k}") - F.col("shared"))
    fit = (needed <= F.least("most_a", "most_b")) & ((F.col("end_a") > F.col("end_b")) | (needed <= bound("a"))) & ((F.col("end_b") > F.col("end_a")) | (needed <= bound("b")))
    near = stored(near.filter(fit).select("a", "b", "members_a", "members_b", "n_b"))
    many = (F.col("members_a") > r.block_members) | (F.col("members_b") > r.block_members)
    heavy = groups.select("grp", "n", F.explode("heavy").alias("token"))
    labels = connected_components(wide_edges(wide.unionByName(heavy), r).unionByName(near.filter(many).select("a", "b")), "a", "b")
    labels = stored(labels.select(F.col("node").alias("grp"), "label"))

    # clusters: every two blocks meet
    found = members.join(labels, "grp", "left").select("owner", "rep", "copies", "n", F.coalesce("label", "grp").alias("cluster"))
    sums = found.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).filter("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / r.block_members), F.ceil(F.col("tokens") / r.block_tokens)).cast("int")
    cut = found.join(sums, "cluster").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("owner", F.lit(7)), F.col("blocks")).cast("int"))
    cut = cut.select("cluster", "owner", "rep", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("owner", "rep", "copies", "cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))

    # pairs of groups in different clusters: the members of one meet those of its partners, in blocks of these
    of = lambda k: labels.select(F.col("grp").alias(f"grp_{k}"), F.col("label").alias(f"label_{k}"))
    apart = near.join(of("a"), F.col("a") == F.col("grp_a"), "left").join(of("b"), F.col("b") == F.col("grp_b"), "left")
    apart = apart.filter(~F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False)))
    apart = stored(apart.select("a", "b", "members_b", (F.col("members_b") * F.col("n_b")).alias("tokens_b")))
    anchors = apart.groupBy("a").agg(F.greatest(F.ceil(F.sum("members_b") / r.block_members), F.ceil(F.sum("tokens_b") / r.block_tokens)).cast("int").alias("blocks"))
    first = members.join(anchors, F.col("grp") == F.col("a")).select("owner", "rep", "copies", F.col("a").alias("cluster"), F.lit(-1).alias("bi"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bj"), F.lit(0).alias("side"))
    others = apart.select("a", "b").join(anchors, "a").select("b", F.col("a").alias("cluster"), F.pmod(F.xxhash64("b", F.lit(7)), F.col("blocks")).cast("int").alias("bj"))
    others = members.join(others, F.col("grp") == F.col("b")).select("owner", "rep", "copies", "cluster", F.lit(-1).alias("bi"), "bj", F.lit(1).alias("side"))
    return cut.unionByName(first).unionByName(others)


def _links(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """A matrix of which sets of a link with which of b (of a itself where b is None)."""
    every = a + (b or [])
    sizes = np.asarray([len(x) for x in every], dtype=np.int64)
    tokens, owner = np.concatenate(every), np.repeat(np.arange(len(every)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    at = postings.runs(tokens)
    df = np.diff(at)
    shared = np.repeat(df > 1, df)
    col, owner = np.repeat(np.cumsum(df > 1) - 1, df)[shared], owner[shared]
    na, nb = len(a), len(every) - len(a) if b is not None else len(a)
    common = np.zeros((na, nb), dtype=np.float32)
    wide = max(256, min(8192, (1 << 22) // max(1, len(every))))
    bounds = np.searchsorted(col, np.arange(0, (int(col[-1]) if len(col) else -1) + wide + 1, wide))
    for k in range(len(bounds) - 1):
        lo, hi = bounds[k], bounds[k + 1]
        x = np.zeros((len(every), wide), dtype=np.float32)
        x[owner[lo:hi], col[lo:hi] - k * wide] = 1
        common += x[:na] @ (x if b is None else x[na:]).T
    left, right = sizes[:na, None], (sizes if b is None else sizes[na:])[None, :]
    o = common.astype(np.int64)
    linked = 100 * o >= percent * (left + right - o)
    if b is None:
        np.fill_diagonal(linked, False)
    return linked


def verify(blocks: DataFrame, rules: JoinRules) -> DataFrame:
    """a, b, links: a spanning forest of the links inside each pair of blocks (links null), and each owner's links there (b null)."""
    width, percent = rules.width, rules.percent

    def forest(linked: np.ndarray, square: bool) -> list[tuple[int, int]]:
        """A breadth-first forest of the links; rows and columns are the same nodes if square."""
        na, nb = linked.shape
        edges: list[tuple[int, int]] = []
        free_a, free_b = np.ones(na, dtype=bool), np.ones(nb, dtype=bool)
        for root in range(na):
            if not free_a[root]:
                continue
            free_a[root] = False
            if square:
                free_b[root] = False
            queue = [(root, True)]
            while queue:
                x, in_a = queue.pop()
                if square or in_a:
                    new = np.flatnonzero(linked[x] & free_b)
                    free_b[new] = False
                    if square:
                        free_a[new] = False
                    edges += [(x, y) for y in new.tolist()]
                    queue += [(y, square) for y in new.tolist()]
                else:
                    new = np.flatnonzero(linked[:, x] & free_a)
                    free_a[new] = False
                    edges += [(y, x) for y in new.tolist()]
                    queue += [(y, True) for y in new.tolist()]
        return edges

    def compare(group: pa.Table) -> pa.Table:
        owner, side, copies = (group.column(k).to_pylist() for k in ("owner", "side", "copies"))
        sides: dict[int, dict[int, tuple[np.ndarray, int]]] = {0: {}, 1: {}}
        for o, s, c, tokens in zip(owner, side, copies, hashing.shingle_sets(group.column("text").to_pylist(), width), strict=True):
            if len(tokens) and hashing.set_key(tokens) == o:  # else another row with the same id
                sides[s][o] = (tokens, c)
        one, two = sides[0], sides[1]
        within = group.column("bi")[0].as_py() == group.column("bj")[0].as_py()  # else a pair of blocks, of which one may be empty
        rows: list[tuple] = []
        if one and (len(one) > 1 if within else two):
            ka, kb = list(one), list(two) if two else list(one)
            linked = _links([x[0] for x in one.values()], [x[0] for x in two.values()] if two else None, percent)
            ca, cb = np.asarray([one[k][1] for k in ka]), np.asarray([(two or one)[k][1] for k in kb])
            rows += [(ka[i], kb[j], None) for i, j in forest(linked, not two)]
            rows += [(ka[i], None, n) for i, n in enumerate((linked @ cb).tolist()) if n]
            if two:
                rows += [(kb[j], None, n) for j, n in enumerate((ca @ linked).tolist()) if n]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], schema=VERIFIED)

    return blocks.groupBy("cluster", "bi", "bj").applyInArrow(compare, "a long, b long, links long")


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: JoinRules = JoinRules()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class_id (least id with the same set), component_id and n_links (rows it links with, copies included)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    rows = stored(features(docs, rules))
    classes = stored(rows.filter("owner is not null and doc_id is not null").groupBy("owner").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    n_rows = rows.filter("owner is not null").count()
    met = stored(meetings(prefix_table(docs.filter("doc_id is not null"), n_rows, rules, parts), classes, rules))
    texts = met.join(docs.hint("merge"), met["rep"] == docs["doc_id"]).select("cluster", "bi", "bj", "side", "owner", "copies", "text")
    verified = stored(verify(texts, rules))
    labels = connected_components(verified.filter("b is not null"), "a", "b")
    links = verified.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.join(labels, classes["owner"] == labels["node"], "left").withColumn("label", F.coalesce("label", "owner"))
    # components of many classes, of which there are at most hot_share, are sent to every task; the others meet their classes by label
    many = max(rules.salts, n_rows // rules.hot_share)
    least = stored(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("rows")))
    wide = F.broadcast(least.filter(F.col("rows") > many).select(F.col("label").alias("wide"), F.col("component_id").alias("wide_id")))
    named = named.join(wide, F.col("label") == F.col("wide"), "left").withColumn("at", F.when(F.col("wide").isNull(), F.col("label")).otherwise(F.xxhash64("owner", F.lit(5))))
    named = named.join(least.filter(F.col("rows") <= many).select(F.col("label").alias("at"), "component_id"), "at", "left").withColumn("component_id", F.coalesce("wide_id", "component_id"))
    named = named.join(links, F.col("owner") == links["a"], "left")
    named = named.select(F.col("owner").alias("key"), "copies", "rep", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # rows of a class with many copies are dealt by salts; there are at most hot_share such classes
    hot = F.col("copies") > many
    big = F.broadcast(classes.filter(hot).select(F.col("owner").alias("big")))
    salt = F.when(F.col("big").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rules.salts)).cast("int")).otherwise(0)
    rows = rows.join(big, rows["owner"] == F.col("big"), "left").select("doc_id", "owner", "n", salt.alias("salt"))
    named = named.select("*", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(rules.salts - 1))).otherwise(F.array(F.lit(0)))).alias("seat")).drop("copies")
    out = rows.join(named, (rows["owner"] == named["key"]) & (rows["salt"] == named["seat"]) & rows["doc_id"].isNotNull(), "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def op1_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: JoinRules = JoinRules()) -> DataFrame:
    """The document with the least id of each component; rows without an id or without words stay."""
    kept = free_name("kept", docs)
    found = join_documents(docs, doc_id, text, rules).filter("component_id = doc_id").select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(found, docs[doc_id] == F.col(kept), "left_semi").unionByName(docs.filter(docs[doc_id].isNull()))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
reach(x, y) AS (SELECT a, b FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
classes AS (SELECT a AS x, min(b) AS c FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE o = na.n AND o = nb.n GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(classes.c, w.doc_id)) AS class_id, least(w.doc_id, coalesce(least.y, w.doc_id)) AS component_id,
  CAST((SELECT count(*) FROM links WHERE links.a = w.doc_id) AS BIGINT) AS n_links FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.x = w.doc_id LEFT JOIN classes ON classes.x = w.doc_id"""
