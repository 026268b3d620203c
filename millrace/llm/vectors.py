"""Near-duplicate vectors by a robust-pruned flat graph.

1. Vectors that are equal bit by bit become one node with a multiplicity.
2. Nodes of a label are dealt to the shards of their nearest centroids (`OVERLAP` of them; the nearest is home). A group of more than `HELD` components is divided by
   centroids that are fitted on a bounded sample and sent to all, as often as it takes; one that a task can hold is divided there, down to about `SHARD` nodes. So the size of shards is
   bounded, their number is not.
3. A shard's graph is built on overlapping clusters of it: each node keeps out-neighbours that are not shadowed by a closer one (robust pruning), with reverse
   edges, and the clusters' adjacency lists are united.
4. From the clusters' medoids a greedy beam search runs for each node at home; once it meets the range it expands through all neighbours within a little more than the
   range. What it finds is verified by cosine in double precision.
5. Recall is audited in each shard on some queries against brute force; below `MIN_RECALL` the shard is built and searched again with larger lists.
   Labels that were dealt are audited again as a whole, on nodes with known links and others against all nodes of the label; below `MIN_RECALL` the label is
   dealt again with twice the overlap, at last compared by brute force in blocks.
6. A node counts the vectors it is linked to, whichever end has found the link; a shard sends one edge per node to its local component's least node, and stars join these.

Defined cases: a null label, or a vector that is null, empty, zero or holds a null or non-finite component, links with nothing; vectors of different length
never link; each row is a vector of its own even if its vec_id repeats (ids that repeat are one vertex of components); a null vec_id has a null component, counts in no
group and is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions_for, small_batches
from .components import components

SHARD, OVERLAP = 600, 3
#: Components (nodes x length) of a group that a task divides by itself.
HELD = 8 << 20
#: Centroids in all, and sampled vectors for each, that the driver fits at a time; groups are then divided into parts of a quarter of what a task can hold.
CENTROIDS, SAMPLED = 1024, 24
CLUSTER, DEGREE, BEAM, ALPHA = 256, 16, 24, 1.2
SLACK, MIN_RECALL, AUDITED = 0.01, 0.95, 16
#: The audit over a label: nodes with known links, and as many of any kind, against all nodes of the label in blocks. Rounds, each with twice the overlap.
LABEL_AUDITED, BLOCK, ROUNDS = 64, 4096, 3


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fitted(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Centroids of unit vectors, from evenly spaced starts."""
    centres = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
    return centres


def pruned(sims: np.ndarray, node: int, candidates: np.ndarray, degree: int) -> list[int]:
    """Robust pruning: nearest first; a candidate falls away if a kept one is closer to it, by ALPHA, than the node is."""
    keep: list[int] = []
    distance = 1 - sims
    left = candidates[np.argsort(distance[node, candidates], kind="stable")]
    while len(left) and len(keep) < degree:
        p = int(left[0])
        keep.append(p)
        left = left[1:]
        left = left[ALPHA * distance[p, left] > distance[node, left]]
    return keep


def graph(x: np.ndarray, degree: int) -> tuple[list[np.ndarray], list[int]]:
    """United adjacency lists over overlapping clusters, and the clusters' medoids."""
    n = len(x)
    k = -(-n // CLUSTER)
    centres = fitted(x[:: max(1, n // (k * SAMPLED))], k)
    near = np.argsort(-(x @ centres.T), axis=1)[:, : min(2, len(centres))]
    edges: list[set[int]] = [set() for _ in range(n)]
    medoids = []
    for c in range(len(centres)):
        own = np.flatnonzero((near == c).any(axis=1))
        if not len(own):
            continue
        medoids.append(int(own[(x[own] @ centres[c]).argmax()]))
        for start in range(0, len(own), 4 * CLUSTER):  # a crowded cluster in bounded parts, each with a share of the others as bridge
            part = np.unique(np.concatenate([own[start : start + 4 * CLUSTER], own[:: max(1, len(own) // CLUSTER)]]))
            sims = x[part] @ x[part].T
            few = min(len(part) - 1, 3 * degree)
            if few < 1:
                continue
            top = np.argpartition(-sims, few, axis=1)[:, : few + 1]
            for i in range(len(part)):
                for j in pruned(sims, i, top[i][top[i] != i], degree):
                    edges[part[i]].add(int(part[j]))
                    if len(edges[part[j]]) < 4 * degree:
                        edges[part[j]].add(int(part[i]))
    return [np.fromiter(e, np.int64, len(e)) for e in edges], medoids


def search(x: np.ndarray, edges: list[np.ndarray], medoids: list[int], query: int, least: float, beam: int) -> np.ndarray:
    """Nodes near `query` that a greedy search from the medoids and the expansion of its range have met."""
    q = x[query]
    start = np.array(medoids)
    sims = x[start] @ q
    first = np.argsort(-sims)[:4]
    seen = set(start[first].tolist())
    best = [(-float(sims[i]), int(start[i])) for i in first]
    todo, worst = list(best), []
    heapq.heapify(todo)
    for s, i in best:
        heapq.heappush(worst, (-s, i))
    inside = [i for s, i in best if -s >= least]
    while todo:
        s, i = heapq.heappop(todo)
        if -s < least and len(worst) >= beam and -s < worst[0][0]:
            break  # the beam holds nothing better, and nothing within the range waits
        fresh = [j for j in edges[i].tolist() if j not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for v, j in zip((x[fresh] @ q).tolist(), fresh, strict=True):
            if v >= least:
                inside.append(j)
                heapq.heappush(todo, (-v, j))
            elif len(worst) < beam or v > worst[0][0]:
                heapq.heappush(todo, (-v, j))
            heapq.heappush(worst, (v, j))
            if len(worst) > beam:
                heapq.heappop(worst)
    return np.array([j for j in inside if j != query], np.int64)


def linked(x: np.ndarray, home: np.ndarray, threshold: float) -> tuple[list[np.ndarray], float]:
    """For each node at home those within the threshold, and the recall that the audit measured."""
    degree, beam = DEGREE, BEAM
    some = home[:: max(1, len(home) // AUDITED)][:AUDITED]
    true = {int(i): set(np.flatnonzero(x @ x[i] >= threshold).tolist()) - {int(i)} for i in some}
    wanted = sum(map(len, true.values()))
    for _ in range(4):
        edges, medoids = graph(x, degree)
        out = []
        for i in home.tolist():
            found = search(x, edges, medoids, i, threshold - SLACK, beam)
            out.append(found[(x[found] @ x[i]) >= threshold] if len(found) else found)
        at = {int(i): k for k, i in enumerate(home)}
        got = sum(len(true[int(i)] & set(out[at[int(i)]].tolist())) for i in some)
        recall = got / wanted if wanted else 1.0
        if recall >= MIN_RECALL:
            return out, recall
        degree, beam = 2 * degree, 2 * beam
    return [np.setdiff1d(np.flatnonzero(x @ x[i] >= threshold), [i]) for i in home.tolist()], 1.0


def valid(rows: DataFrame) -> DataFrame:
    """Adds `ok`, whether a row may link, and two hashes of its vector."""
    v = F.col("embedding")
    finite = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    ok = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda a: a != 0) & F.col("vec_id").isNotNull()
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))


def further(overlap: int) -> int:
    """Shards of a node when its shard is divided again."""
    return max(2, 2 * overlap // 3)


def divided(x: np.ndarray, home: np.ndarray, overlap: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Shards of a group of unit vectors: name, positions, which of them are at home; each position is at home once if it was."""
    todo = [("", np.arange(len(x)), home, overlap)]
    while todo:
        name, at, own, most = todo.pop()
        k = -(-int(own.sum()) // SHARD)
        if own.sum() <= 2 * SHARD:
            yield name, at, own
            continue
        centres = fitted(x[at[:: max(1, len(at) // (k * SAMPLED))]], k)
        near = np.concatenate([np.argsort(-(x[at[i : i + 4096]] @ centres.T), axis=1)[:, :most] for i in range(0, len(at), 4096)])
        parts = [(f"{name}/{c}", at[hit], own[hit] & (near[hit, 0] == c)) for c in range(len(centres)) if (hit := (near == c).any(axis=1)).any()]
        if max(p[2].sum() for p in parts) == own.sum():  # vectors that no centroid tells apart
            yield name, at, own
            continue
        todo += [(*p, further(most)) for p in parts]


def dealt(nodes: DataFrame, most: int) -> DataFrame:
    """Each node in the shards of its `most` nearest centroids: nodes (node, n, grp, embedding) as rows (shard, node, n, home, embedding); shards of about SHARD nodes at home."""
    spark = nodes.sparkSession
    held = nodes.select(F.col("grp").alias("shard"), "node", "n", F.lit(True).alias("home"), "embedding")
    schema = pa.schema([("shard", pa.string()), ("node", pa.int64()), ("n", pa.int64()), ("home", pa.bool_()), ("embedding", pa.list_(pa.float64()))])
    shown = "shard string, node long, n long, home boolean, embedding array<double>"
    overlap, before = most, None
    while True:
        sizes = held.groupBy("shard").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("length")).where(F.col("n") * F.col("length") > HELD)
        sizes = sizes.orderBy(F.desc("n"), "shard").limit(CENTROIDS // 2).collect()
        if not sizes or (sizes[0]["n"], len(sizes)) == before:
            break
        before = (sizes[0]["n"], len(sizes))
        wanted, left = {}, CENTROIDS
        for r in sizes:
            k = min(-(-4 * r["n"] * r["length"] // HELD), left)
            if k >= 2:
                wanted[r["shard"]] = (k, r["n"])
                left -= k
        share = F.create_map(*[x for s, (k, n) in wanted.items() for x in (F.lit(s), F.lit(min(1.0, SAMPLED * k / n)))])
        sample = held.where(F.pmod(F.xxhash64("node", "shard"), F.lit(1 << 20)) < F.element_at(share, F.col("shard")) * (1 << 20))
        found: dict[str, list] = {}
        for r in sample.select("shard", "embedding").orderBy(F.xxhash64("embedding")).limit(2 * SAMPLED * CENTROIDS).collect():
            found.setdefault(r["shard"], []).append(r["embedding"])
        shared = spark.sparkContext.broadcast({s: fitted(unit(np.array(v, np.float64)), wanted[s][0]) for s, v in found.items() if len(v) > 1})  # at most CENTROIDS vectors

        def place(batches: Iterator[pa.RecordBatch], shared=shared, overlap=overlap) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shards, out_shard, out_row, out_home = b.column(0).to_pylist(), [], [], []
                home = b.column(3).to_numpy(zero_copy_only=False)
                for s in set(shards):
                    rows = np.array([i for i, x in enumerate(shards) if x == s])
                    own = shared.value.get(s)
                    if own is None:
                        out_shard += [s] * len(rows)
                        out_row += rows.tolist()
                        out_home += home[rows].tolist()
                        continue
                    x = unit(np.array(b.column(4).take(pa.array(rows)).to_pylist()))
                    near = np.argsort(-(x @ own.T), axis=1)[:, :overlap]
                    for turn in range(near.shape[1]):
                        out_shard += [f"{s}/{c}" for c in near[:, turn]]
                        out_row += rows.tolist()
                        out_home += (home[rows] & (turn == 0)).tolist()
                at = pa.array(out_row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out_shard, pa.string()), b.column(1).take(at), b.column(2).take(at), pa.array(out_home, pa.bool_()), b.column(4).take(at)], schema=schema)

        held = materialize(held.mapInArrow(place, shown), "shards")
        overlap = further(overlap)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, t in by_shard(batches):
            home = t.column("home").to_numpy(zero_copy_only=False)
            if home.sum() <= 2 * SHARD:
                yield from t.cast(schema).to_batches(4096)
                continue
            x = unit(t.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(home), -1))
            for name, at, own in divided(x, home, overlap):
                part = t.take(pa.array(at))
                part = part.set_column(0, "shard", pa.array([f"{shard}{name}"] * len(at), pa.string())).set_column(3, "home", pa.array(own))
                yield from part.cast(schema).to_batches(4096)

    d = held.repartition(partitions_for(held), "shard").sortWithinPartitions("shard", "node")
    return materialize(d.mapInArrow(split, shown), "shards")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each shard from rows in order of shards."""
    shard, parts = None, []
    for b in batches:
        names, start = b.column(0).to_pylist(), 0
        while start < len(names):
            end = start
            while end < len(names) and names[end] == names[start]:
                end += 1
            if names[start] != shard:
                if parts:
                    yield shard, pa.Table.from_batches(parts)
                shard, parts = names[start], []
            parts.append(b.slice(start, end - start))
            start = end
    if parts:
        yield shard, pa.Table.from_batches(parts)


def shard_links(held: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links, root, recall) for each node at home, roots for the others that are linked in a shard, and links (node, other) with their sizes to nodes of another home."""
    schema = pa.schema([("node", pa.int64()), ("home", pa.bool_()), ("n_links", pa.int64()), ("root", pa.int64()), ("recall", pa.float64()), ("other", pa.int64()), ("n_node", pa.int64()), ("n_other", pa.int64())])

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
        home = np.flatnonzero(t.column("home").to_numpy(zero_copy_only=False))
        if not len(home):
            return
        x = unit(t.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(node), -1))
        if len(node) == 1:
            found, recall = [np.empty(0, np.int64)], 1.0
        else:
            found, recall = linked(x, home, threshold)
        parent = list(range(len(node)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, f in zip(home.tolist(), found, strict=True):
            for j in f.tolist():
                a, b = root(i), root(j)
                if a != b:
                    if node[a] < node[b]:
                        parent[b] = a
                    else:
                        parent[a] = b
        # a link counts at both ends, whichever has found it; those to nodes of another home meet afterwards
        at: dict[int, set[int]] = {i: set() for i in home.tolist()}
        cross = []
        for i, f in zip(home.tolist(), found, strict=True):
            for j in f.tolist():
                if j in at:
                    at[i].add(j)
                    at[j].add(i)
                else:
                    cross.append((int(node[i]), False, 0, int(node[i]), recall, int(node[j]), int(n[i]), int(n[j])))
        rows = [(int(node[i]), i in at, int(sum(n[j] for j in at[i])) if i in at else 0, int(node[root(i)]), recall, None, None, None) for i in range(len(node)) if i in at or root(i) != i]
        rows += cross
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in by_shard(batches):
            yield from solve(t)

    d = held.repartition(4 * partitions_for(held), "shard").sortWithinPartitions("shard", "node")
    return d.mapInArrow(run, "node long, home boolean, n_links long, root long, recall double, other long, n_node long, n_other long")


def all_links(some: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links) of nodes in `some` by brute force against all nodes of their group, blocks against blocks; a row for each block that has links."""
    number = lambda d, name: d.join(d.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)), "grp")
    a, b = number(some.select("grp", "node", "embedding"), "na"), number(nodes.select("grp", "node", "n", "embedding"), "nb")
    other = lambda d, name: d.select("grp", name).distinct()
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    block = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    left = a.join(other(b, "nb"), "grp").select("grp", block("na").alias("i"), each("nb").alias("j"), "node", "embedding")
    right = b.join(other(a, "na"), "grp").select("grp", each("na").alias("i"), block("nb").alias("j"), "node", "n", "embedding")
    schema = pa.schema([("node", pa.int64()), ("n_links", pa.int64())])

    def solve(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        vectors = lambda t: unit(t.column("embedding").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
        u, v, n, p, q = x.column("node").to_numpy(), y.column("node").to_numpy(), y.column("n").to_numpy(), vectors(x), vectors(y)
        rows = []
        for i in range(0, len(u), 256):
            near = (p[i : i + 256] @ q.T >= threshold) & (u[i : i + 256, None] != v[None, :])
            for k in np.flatnonzero(near.any(axis=1)):
                found = np.flatnonzero(near[k])
                rows.append((int(u[i + k]), int(n[found].sum())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    return left.groupBy("grp", "i", "j").cogroup(right.groupBy("grp", "i", "j")).applyInArrow(solve, "node long, n_links long")


def all_edges(nodes: DataFrame, same: DataFrame, threshold: float) -> DataFrame:
    """(u, v): what ties the linked among nodes together, by brute force in blocks; `same` has the same rows."""
    number = lambda d: d.join(d.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")), "grp")
    own, each = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = number(nodes.select("grp", "node", "embedding")).select("grp", own.alias("i"), each.alias("j"), "node", "embedding")
    right = number(same.select("grp", "node", "embedding")).select("grp", each.alias("i"), own.alias("j"), "node", "embedding")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solve(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        vectors = lambda t: unit(t.column("embedding").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
        u, v, p, q = x.column("node").to_numpy(), y.column("node").to_numpy(), vectors(x), vectors(y)
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(0, len(u), 256):
            for k, j in zip(*np.nonzero((p[i : i + 256] @ q.T >= threshold) & (u[i : i + 256, None] > v[None, :])), strict=True):
                a, b = root(int(u[i + k])), root(int(v[j]))
                parent[max(a, b)] = min(a, b)
        pairs = [(i, root(i)) for i in list(parent) if root(i) != i]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], schema=schema) if pairs else schema.empty_table()

    return left.groupBy("grp", "i", "j").cogroup(right.groupBy("grp", "i", "j")).applyInArrow(solve, "u long, v long")


def audited(own: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(grp, label_recall) of groups large enough to be dealt, from nodes with known links and others against all nodes of their group."""
    dealt_out = nodes.groupBy("grp").count().where(F.col("count") > 2 * SHARD).select("grp")
    known = own.join(nodes.select("node", "grp", "embedding"), "node").join(dealt_out, "grp").withColumn("linked", F.col("found") > 0)
    w = Window.partitionBy("grp", "linked").orderBy(F.xxhash64("node", F.lit(11)))
    some = materialize(known.withColumn("r", F.row_number().over(w)).where(F.col("r") <= LABEL_AUDITED), "audited")
    true = all_links(some, nodes, threshold).groupBy("node").agg(F.sum("n_links").alias("true"))
    both = some.join(true, "node", "left").groupBy("grp").agg(F.sum("found").alias("found"), F.sum(F.coalesce("true", F.lit(0))).alias("true"))
    return both.select("grp", F.when(F.col("true") > 0, F.col("found") / F.col("true")).otherwise(1.0).alias("label_recall"))


def graph_links(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, found, recall) for every node, and edges (u, v). Groups whose audit fails are dealt again with more overlap, at last compared by brute force."""
    left, owns, edges = nodes, [], []
    for turn in range(ROUNDS):
        got = materialize(shard_links(dealt(left, OVERLAP << turn), threshold), "found")
        cross = got.where("other is not null")
        cross = cross.select("node", "other", F.col("n_other").alias("k")).union(cross.select("other", "node", "n_node")).distinct().groupBy("node").agg(F.sum("k").alias("more"))
        own = got.where("home").groupBy("node").agg(F.max("n_links").alias("found"), F.min("recall").alias("recall")).join(cross, "node", "left")
        own = materialize(own.select("node", (F.col("found") + F.coalesce("more", F.lit(0))).alias("found"), "recall"), "links")
        audit = materialize(audited(own, left, threshold), "audit")
        own = own.join(left.select("node", "grp"), "node").join(audit, "grp", "left")
        bad = audit.where(F.col("label_recall") < MIN_RECALL).select("grp")
        owns.append(own.join(bad, "grp", "left_anti").select("node", "found", F.least("recall", "label_recall").alias("recall")))
        edges.append(got.where("other is null and node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))  # true links in any case
        if bad.isEmpty():
            break
        left = materialize(left.join(bad, "grp", "left_semi"), "again")
    else:
        same = materialize(left, "same")  # read anew, as a plan can't meet itself
        exact = all_links(left, same, threshold).groupBy("node").agg(F.sum("n_links").alias("found"))
        owns.append(left.select("node").join(exact, "node", "left").select("node", F.coalesce("found", F.lit(0)).alias("found"), F.lit(1.0).alias("recall")))
        edges.append(all_edges(left, same, threshold))
    return reduce(DataFrame.union, owns), reduce(DataFrame.union, edges)


def near_vectors(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept (and the audited recall of the home shard) for each row of (vec_id, embedding, label)."""
    small_batches(rows.sparkSession, 4000)
    rows = valid(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string")))
    key = ["label", "h1", "h2"]
    nodes = rows.where("ok").groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes.withColumn("grp", F.concat_ws(":", F.size("embedding"), "label")), "vectors")
    own, edges = graph_links(nodes, threshold)
    labels = components(edges)
    per = nodes.select(*key, "node", "n").join(own, "node").join(labels.withColumnRenamed("id", "node"), "node", "left")
    per = per.select(*key, (F.col("found") + F.col("n") - 1).alias("found"), F.coalesce("component_id", "node").alias("c"), "recall")
    out = rows.withColumn("label", F.when(F.col("ok"), F.col("label"))).select("vec_id", *key).join(per, key, "left")
    out = out.select("vec_id", F.coalesce("found", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), "recall")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def embedding_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, n_queries, true_links, found_links, recall: the links found for every row whose id is divisible by 20, against brute force over all rows of its label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = near_vectors(rows).where("vec_id % 20 = 0").select(F.col("vec_id").alias("node"), "n_links")
    all_rows = valid(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))).where("ok")
    all_rows = all_rows.select(F.concat_ws(":", F.size("embedding"), "label").alias("grp"), "label", F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("n"), "embedding")
    some = materialize(all_rows.where("node % 20 = 0"), "queries")  # read anew, as a plan can't meet itself
    true = all_links(some, all_rows, 0.98).groupBy("node").agg(F.sum("n_links").alias("true"))
    both = some.select("label", "node").join(found, "node").join(true, "node", "left")
    out = both.groupBy("label").agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("true"), F.lit(0)).alias("true_links"), F.sum("n_links").alias("found_links"))
    return out.withColumn("recall", F.when(F.col("true_links") > 0, F.col("found_links") / F.col("true_links")).otherwise(1.0))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS r FROM e),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.r * b.r) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id),
k AS (SELECT u, count(*) AS k FROM l GROUP BY u)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON id = vec_id LEFT JOIN k ON u = vec_id"""
