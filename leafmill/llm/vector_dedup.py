"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors form a class; a class's vector stands for its copies.
2. Centroids are fitted on a bounded sample (the SAMPLE classes least by hash); every class goes to
   the shards of its nearest centroids. How many, OVERLAP at least, is measured: it rises until
   MEET of the pairs of cosine SIMILAR, made from PROBES further classes, share a shard, so it
   grows with the number of centroids. A shard of more than SHARD_MOST classes is split in the same
   way on a sample of its own, by executors, level by level, however many classes there are. One
   that can't be split (its classes lie too close for shards to part them) is dealt to parts of
   about PART classes, and each two of its parts meet in a group of their own.
3. In each part a flat graph is built: candidates are the nearest classes and a few others, pruned
   robustly (a candidate nearer to a kept neighbour than to the node, by the factor ALPHA, goes).
   The adjacency lists of a class's shards are united; a part's search uses the edges that stay in it.
4. In each part every class searches: greedily from the medoid, then, from what was found and the
   class's own node, the range expands over all nodes of cosine >= RANGE. Of two parts each searches
   the other. Links are verified in double precision at >= SIMILAR. A pair that meets in several
   shards counts in the least of them.
5. Components over the links give the classes of near duplicates. For AUDIT classes, the least by
   hash of all classes, the links are also found by brute force against all classes; their share
   found is the column audit_recall. Below LEAST_RECALL all is done again with more overlap, and
   parts compared exactly instead of searched.

What leaves a group is one row per class, never a row per pair. Memory per task is bounded: a group
holds SHARD_MOST classes, or two parts. Work grows with the square of a group of different vectors
that are all linked, since each of their links is counted.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length never link; null ids order last; rows repeated in id are
vectors of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import connected_components
from ._spark import Scratch, join_groups

SIMILAR, RANGE = 0.9, 0.85
#: Bounds: classes that centroids are fitted on, centroids fitted at once, classes aimed at and allowed in a shard,
#: classes of a part of a larger one, classes of such a shard that one task assigns, audited classes.
SAMPLE, MOST_CENTROIDS, SHARD_AIM, SHARD_MOST, PART, TASK_ROWS, AUDIT = 8192, 1024, 1500, 2400, 1000, 100_000, 256
#: Classes that the overlap is measured with, the share of pairs at the threshold that must share a shard, at the second
#: attempt as well, and the audited recall below which there is one.
PROBES, MEET, MEET_AGAIN, LEAST_RECALL = 2048, 0.995, 0.9999, 0.9
OVERLAP, DEGREE, CANDIDATES, FAR_CANDIDATES, ALPHA, BEAM = 3, 24, 48, 12, 1.2, 8
#: A split that leaves a shard this share of its classes isn't worth its copies.
SHRINK = 0.6


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, vectors = [], []
        for v in batch.column(1).to_pylist():
            key = None
            if v and None not in v:
                x = np.array(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    key = hashlib.md5(x.tobytes()).hexdigest()
            keys.append(key)
            vectors.append(None if key is None else v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], names=["_id", "_key", "_vector"])


def unit(rows: list) -> np.ndarray:
    """Vectors in double precision, of length one; scaled first, so that their squares can't overflow."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample, which is in order of a hash."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(8):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """The m centroids nearest to each row, nearest first."""
    s = -(x @ c.T)
    own = np.argpartition(s, m - 1, axis=1)[:, :m]
    return np.take_along_axis(own, np.argsort(np.take_along_axis(s, own, 1), axis=1, kind="stable"), 1)


def fit_shards(x: np.ndarray, share: float, meet: float = MEET, sample: int = SAMPLE, aim: int = SHARD_AIM) -> tuple[np.ndarray, int]:
    """Centroids for about ``share`` classes, and to how many of them a class goes."""
    cut = max(len(x) - PROBES, len(x) // 2)
    probes = x[cut:] if len(x) > 1 else x
    away = np.random.default_rng(0).standard_normal(probes.shape)
    away -= np.einsum("ij,ij->i", away, probes)[:, None] * probes
    length = np.linalg.norm(away, axis=1, keepdims=True)
    pairs = SIMILAR * probes + np.sqrt(1 - SIMILAR**2) * np.where(length > 1e-9, away / np.maximum(length, 1e-9), probes)
    fitted, overlap = x[:sample], OVERLAP
    while True:
        k = max(1, min(MOST_CENTROIDS, len(fitted) // 4, round(share * overlap / aim)))
        c = fit_centroids(fitted, k)
        if k <= overlap:
            return c, overlap
        a, b = nearest(probes, c, overlap), nearest(pairs, c, overlap)
        if (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= meet:
            return c, overlap
        overlap += 1 + overlap // 8


def robust_prune(near: np.ndarray, dist: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The kept of the candidates ``near``, which come in ascending ``dist``; ``between`` holds their own distances."""
    live, kept = np.ones(len(near), bool), []
    for k in range(len(near)):
        if live[k]:
            kept.append(k)
            if len(kept) == DEGREE:
                break
            live &= ALPHA * between[k] > dist
    return near[kept]


def build_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency lists of a part, as indices of its rows."""
    n = len(x)
    if n == 1:
        return [np.empty(0, np.int64)]
    rng = np.random.default_rng(seed)
    out: list[set[int]] = [set() for _ in range(n)]
    for start in range(0, n, 512):
        sims = x[start : start + 512] @ x.T
        for r in range(len(sims)):
            p, s = start + r, sims[r]
            s[p] = -2
            m = min(CANDIDATES, n - 1)
            near = np.argpartition(-s, m - 1)[:m]
            near = np.unique(np.concatenate([near, rng.integers(0, n, FAR_CANDIDATES)]))
            near = near[near != p]
            near = near[np.argsort(-s[near], kind="stable")]
            v = x[near]
            dist = np.sqrt(np.maximum(2 - 2 * s[near], 0))
            between = np.sqrt(np.maximum(2 - 2 * (v @ v.T), 0))
            out[p].update(robust_prune(near, dist, between).tolist())
    for p in range(n):  # edges lead both ways; what a node gets so is bounded by twice the degree
        for q in list(out[p]):
            if len(out[q]) < 2 * DEGREE:
                out[q].add(p)
    return [np.array(sorted(a), np.int64) for a in out]


def adjacency(lists: list[np.ndarray]) -> np.ndarray:
    """The lists as rows of one table, filled up with the row's own node."""
    most = max(1, *map(len, lists)) if lists else 1
    table = np.repeat(np.arange(len(lists))[:, None], most, axis=1)
    for k, near in enumerate(lists):
        table[k, : len(near)] = near
    return table


def search(x: np.ndarray, near: np.ndarray, medoid: int, q: np.ndarray, own: int | None) -> np.ndarray:
    """Rows of x of cosine >= RANGE to q that the range-expanding greedy search reaches.

    Nodes within the range are expanded all at once, since each of them will be; the others one at
    a time, nearest first, until the nearest isn't among the BEAM nearest seen.
    """
    seen = np.zeros(len(x), bool)
    new = np.array([medoid] if own is None or own == medoid else [medoid, own])
    beam: list[float] = []
    ahead: list[tuple[float, int]] = []
    found = []
    while True:
        seen[new] = True
        sims = x[new] @ q
        within = sims >= RANGE
        wide = new[within]
        found.append(wide)
        rest, low = new[~within], sims[~within]
        if len(low) > BEAM:
            top = np.argpartition(-low, BEAM - 1)[:BEAM]
            rest, low = rest[top], low[top]
        for s, p in zip(low.tolist(), rest.tolist()):
            if len(beam) < BEAM or s > beam[-1]:
                heapq.heappush(ahead, (-s, p))
        beam = sorted([*beam, *np.sort(sims)[-BEAM:].tolist()], reverse=True)[:BEAM]
        new = wide[:0]
        if len(wide):
            fresh = np.zeros(len(x), bool)
            fresh[near[wide].ravel()] = True
            new = np.flatnonzero(fresh & ~seen)
        while not len(new):
            if not ahead:
                return np.concatenate(found)
            s, p = heapq.heappop(ahead)
            if len(beam) >= BEAM and -s < beam[-1]:
                return np.concatenate(found)
            new = near[p][~seen[near[p]]]
            if len(new) > 1:
                new = np.unique(new)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return unit(column.to_pylist())


def _build(table: pa.Table) -> pa.Table:
    nodes = table["_node"].to_numpy()
    order = np.argsort(nodes)
    nodes, x = nodes[order], _vectors(table["_vector"])[order]
    lists = build_graph(x, int(nodes[0]) & 0x7FFFFFFF)
    return pa.table({"_node": pa.array(nodes), "_near": pa.array([nodes[a].tolist() for a in lists], pa.list_(pa.int64()))})


class Side:
    """The rows of one part, in order of their node."""

    def __init__(self, table: pa.Table) -> None:
        nodes = table["_node"].to_numpy()
        order = np.argsort(nodes)
        self.nodes, self.weight = nodes[order], table["_members"].to_numpy()[order]
        self.x = _vectors(table["_vector"])[order]
        shards = table["_shards"].to_pylist()
        most = max(map(len, shards))
        # lists of differing length are filled up with their own first shard
        self.shards = np.array([shards[k] + shards[k][:1] * (most - len(shards[k])) for k in order], np.int64)
        place = {v: k for k, v in enumerate(self.nodes.tolist())}
        near = table["_near"].to_pylist()
        self.near = adjacency([np.array([place[v] for v in near[k] or () if v in place], np.int64) for k in order])
        self.medoid = int(np.argmax(self.x @ self.x.mean(axis=0)))

    def found(self, q: np.ndarray, own: bool, exact: bool) -> np.ndarray:
        """Whether row k of q and row j of this side are linked, as far as the search sees; ``own``: q is this side's."""
        hit = np.zeros((len(q), len(self.x)), bool)
        for k in range(len(q)):
            got = np.arange(len(self.x)) if exact else search(self.x, self.near, self.medoid, q[k], k if own else None)
            if len(got):
                hit[k, got] = np.einsum("ij,j->i", self.x[got], q[k]) >= SIMILAR
        return hit


def smallest_reached(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the smallest that links between places a and b reach."""
    order = np.argsort(nodes)
    label = np.empty(len(nodes), np.int64)
    label[order] = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        # the roots of what just met are joined as well
        top = label[order]
        np.minimum.at(top, label[a], least)
        np.minimum.at(top, label[b], least)
        new = np.minimum(new, top[new])
        if (new == label).all():
            return nodes[order][label]
        label = new


def _links(table: pa.Table, exact: bool) -> pa.Table:
    """The links within a part, or between two parts of a shard: a row per linked class."""
    shard = table["_shard"][0].as_py()
    first = table["_part"].to_numpy() == table["_i"].to_numpy()
    a = Side(table.filter(pa.array(first)))
    if table["_i"][0].as_py() == table["_j"][0].as_py():
        b, hit = a, a.found(a.x, True, exact)
        hit |= hit.T
        hit = np.triu(hit, 1)
    elif first.all():
        return LINKED.empty_table()
    else:
        b = Side(table.filter(pa.array(~first)))
        hit = a.found(b.x, False, exact).T | b.found(a.x, False, exact)
    nodes = a.nodes if a is b else np.concatenate([a.nodes, b.nodes])
    shift = 0 if a is b else len(a.nodes)
    roots = smallest_reached(nodes, *(np.nonzero(hit)[0], np.nonzero(hit)[1] + shift))
    counts, classes = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    for k in range(len(hit)):
        to = np.flatnonzero(hit[k])
        if len(to):
            # of the shards that both are in, the least counts the pair
            common = (b.shards[to][:, :, None] == a.shards[k][None, None, :]).any(axis=2)
            to = to[np.where(common, b.shards[to], np.iinfo(np.int64).max).min(axis=1) == shard]
            counts[k] += b.weight[to].sum()
            classes[k] += len(to)
            counts[to + shift] += a.weight[k]
            classes[to + shift] += 1
    some = (roots != nodes) | (counts > 0)
    return pa.table([nodes[some], roots[some], counts[some], classes[some]], schema=LINKED)


LINKED = pa.schema([(n, pa.int64()) for n in ("_node", "_root", "_links", "_classes")])
LINKED_DDL = "_node bigint, _root bigint, _links bigint, _classes bigint"


def _split(open_: DataFrame, sizes: DataFrame, meet: float, scratch: Scratch) -> DataFrame:
    """Rows (_node, _members, _vector, _shard) of large shards (_shard, _n), each in the shards of its nearest new centroids.

    Shards that their sample can't part come back as they are. Centroids are fitted by executors on
    samples of bounded size and travel before the rows of each slice of a shard.
    """
    rows = open_.join(F.broadcast(sizes), "_shard") if sizes.count() <= 10_000 else open_.join(sizes, "_shard")
    share = F.lit(1.1 * (SAMPLE + PROBES)) / F.col("_n")
    sampled = rows.filter(F.pmod(F.xxhash64("_node", "_shard"), F.lit(1 << 30)) < share * (1 << 30)).select("_shard", "_n", "_node", "_vector")

    sample, aim = SAMPLE, SHARD_AIM

    def fit(table: pa.Table) -> pa.Table:
        x, n = _vectors(table.sort_by("_node")["_vector"]), table["_n"][0].as_py()
        c, overlap = fit_shards(x, n, meet, sample, aim)
        if overlap >= SHRINK * len(c):
            c = c[:0]
        return pa.table({"_shard": [table["_shard"][0].as_py()], "_centers": pa.array([c.tolist()], pa.list_(pa.list_(pa.float64()))), "_overlap": pa.array([overlap], pa.int32())})

    centers = scratch.save(sampled.groupBy("_shard").applyInArrow(fit, "_shard bigint, _centers array<array<double>>, _overlap int"), "centroids")
    slices = F.ceil(F.col("_n") / TASK_ROWS).cast("int")
    heads = centers.join(sizes, "_shard").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("_shard", "_slice", none("bigint").alias("_node"), none("bigint").alias("_members"), none("array<double>").alias("_vector"), "_centers", "_overlap")
    body = rows.withColumn("_slice", F.pmod(F.xxhash64("_node"), slices).cast("int"))
    body = body.select("_shard", "_slice", "_node", "_members", "_vector", none("array<array<double>>").alias("_centers"), none("int").alias("_overlap"))
    every = heads.unionByName(body).repartition("_shard", "_slice").sortWithinPartitions("_shard", "_slice", F.col("_node").asc_nulls_first())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, overlap = None, 0
        for batch in batches:
            nodes, members, vectors, shards, at = [], [], [], [], []
            heads = zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist())
            for k, (node, given, m) in enumerate(heads):
                if node is None:
                    c, overlap = np.array(given, np.float64), m
                    continue
                v = batch.column(4)[k].as_py()
                own = nearest(unit([v]), c, overlap)[0].tolist() if len(c) else [-1]
                nodes += [node] * len(own)
                members += [batch.column(3)[k].as_py()] * len(own)
                vectors += [v] * len(own)
                shards += [batch.column(0)[k].as_py()] * len(own)
                at += own
            columns = [pa.array(x, pa.int64()) for x in (nodes, members, shards, at)]
            columns.append(pa.array(vectors, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=["_node", "_members", "_shard", "_at", "_vector"])

    parted = every.mapInArrow(assign, "_node bigint, _members bigint, _shard bigint, _at bigint, _vector array<double>")
    new = F.when(F.col("_at") < 0, F.col("_shard")).otherwise(F.xxhash64("_shard", "_at"))
    return parted.select("_node", "_members", "_vector", new.alias("_shard"), F.col("_shard").alias("_from"))


def _sharded(classes: DataFrame, n: int, meet: float, scratch: Scratch) -> DataFrame:
    """Rows (_node, _members, _vector, _shard, _n): each class in all its shards, with the shards' sizes."""
    by_length = classes.groupBy(F.size("_vector").alias("_d")).agg(F.count("*").alias("_n"))
    # every length of vector starts as one shard
    start = classes.select("_node", "_members", "_vector", F.size("_vector").cast("bigint").alias("_shard"))
    sizes = scratch.save(by_length.select(F.col("_d").cast("bigint").alias("_shard"), "_n"), "sizes")
    done: list[DataFrame] = []
    while True:
        big = sizes.filter(F.col("_n") > SHARD_MOST)
        fit = start.join(sizes.filter(F.col("_n") <= SHARD_MOST), "_shard")
        done.append(fit.select("_node", "_members", "_vector", "_shard", "_n"))
        if not big.limit(1).count():
            break
        parted = scratch.save(_split(start.select("_node", "_members", "_vector", "_shard"), big, meet, scratch), "split")
        new = parted.groupBy("_from", "_shard").agg(F.count("*").alias("_n"))
        new = scratch.save(new.join(big.select(F.col("_shard").alias("_from"), F.col("_n").alias("_was")), "_from"), "sizes")
        # a shard that hardly shrank is dense, and stays
        stuck = (F.col("_n") > SHARD_MOST) & (F.col("_n") > SHRINK * F.col("_was"))
        dense = parted.join(new.filter(stuck).select("_from", "_shard", "_n"), ["_from", "_shard"])
        done.append(dense.select("_node", "_members", "_vector", "_shard", "_n"))
        sizes = new.filter(~stuck).select("_shard", "_n")
        start = parted.join(new.filter(stuck).select("_from", "_shard"), ["_from", "_shard"], "left_anti").select("_node", "_members", "_vector", "_shard")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _find(classes: DataFrame, n: int, meet: float, exact: bool, scratch: Scratch) -> DataFrame:
    """Rows (_node, _root, _links, _classes) of all groups."""
    placed = scratch.save(_sharded(classes, n, meet, scratch), "assigned")
    parts = F.when(F.col("_n") > SHARD_MOST, F.ceil(F.col("_n") / PART)).otherwise(1).cast("int")
    part = F.pmod(F.xxhash64("_node", "_shard"), F.col("_parts")).cast("int")
    dealt = placed.withColumn("_parts", parts).withColumn("_part", part)
    built = dealt.select("_shard", "_part", "_node", "_vector").groupBy("_shard", "_part").applyInArrow(_build, "_node bigint, _near array<bigint>")
    graph = built.groupBy("_node").agg(F.array_distinct(F.flatten(F.collect_list("_near"))).alias("_near"))
    shards = placed.groupBy("_node").agg(F.sort_array(F.collect_set("_shard")).alias("_shards"))
    known = scratch.save(graph.join(shards, "_node"), "graph")
    visits = dealt.join(known, "_node").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    visits = visits.withColumn("_i", F.least("_part", "_other")).withColumn("_j", F.greatest("_part", "_other"))
    visits = visits.select("_shard", "_i", "_j", "_part", "_node", "_members", "_vector", "_shards", "_near")
    return scratch.save(visits.groupBy("_shard", "_i", "_j").applyInArrow(lambda t: _links(t, exact), LINKED_DDL), "found")


def near_duplicates(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept, audit_recall."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    rows = scratch.save(rows.mapInArrow(_prepare, f"_id {id_type}, _key string, _vector array<double>"), "vectors")
    classes = rows.filter("_key is not null").groupBy("_key").agg(F.min("_id").alias("_rep"), F.count("*").alias("_members"), F.first("_vector").alias("_vector"))
    classes = scratch.save(classes.withColumn("_node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    for meet, exact in ((MEET, False), (MEET_AGAIN, True)):
        found = _find(classes, n, meet, exact, scratch)
        links = scratch.save(found.groupBy("_node").agg(F.sum("_links").alias("_links"), F.sum("_classes").alias("_classes")), "links")
        recall = audit(classes, links)
        if recall >= LEAST_RECALL:
            break
    roots = connected_components(found.select(F.col("_node").alias("u"), F.col("_root").alias("v")), scratch)
    roots = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    own = classes.select("_key", "_node", "_rep", "_members").join(links, "_node", "left").join(roots, "_node", "left")
    own = scratch.save(own.withColumn("_root", F.coalesce("_root", "_node")), "decided")
    least = own.groupBy("_root").agg(F.min("_rep").alias("component_id"), F.count("*").alias("_n"))
    own = scratch.save(join_groups(own, least, "_root", "_n", n).drop("_n"), "components")
    total = rows.count()
    met = join_groups(rows.filter("_key is not null").select("_id", "_key"), own.select("_key", "_links", "_members", "component_id"), "_key", "_members", total)
    out = met.select("_id", (F.coalesce("_links", F.lit(0)) + F.col("_members") - 1).alias("n_links"), "component_id")
    out = out.unionByName(rows.filter("_key is null").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id")))
    kept = F.col("_id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", kept.alias("kept"), F.lit(recall).alias("audit_recall"))


def audit(classes: DataFrame, links: DataFrame) -> float:
    """Share of the links of AUDIT classes, found by brute force against all classes, that the search found too.

    The classes are the least by a hash of their key: a fair draw from all of them, linked or not.
    """
    picked = classes.select("_node", "_vector", F.xxhash64("_key", F.lit("audit")).alias("_h")).orderBy("_h", "_node").limit(AUDIT).collect()
    if not picked:
        return 1.0
    by_length: dict[int, list] = {}
    for r in picked:
        by_length.setdefault(len(r["_vector"]), []).append((r["_node"], r["_vector"]))
    queries = {d: (np.array([r[0] for r in q]), unit([r[1] for r in q])) for d, q in by_length.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[int, int] = {}
            vectors = b.column(0).to_pylist()
            for d, (nodes, q) in queries.items():
                own = [v for v in vectors if len(v) == d]
                if own:
                    for node, c in zip(nodes.tolist(), ((unit(own) @ q.T) >= SIMILAR).sum(axis=0).tolist()):
                        counts[node] = counts.get(node, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["_node", "n"])

    true = classes.select("_vector").mapInArrow(brute, "_node bigint, n bigint").groupBy("_node").agg((F.sum("n") - 1).alias("n"))
    row = true.join(links, "_node", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("_classes", F.lit(0)))).alias("m")).first()
    return float(row.m / row.n) if row.n else 1.0


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), Scratch(spark))


QUERIES = {"op3_vector_dedup": op3_vector_dedup}
ORACLES = {}
