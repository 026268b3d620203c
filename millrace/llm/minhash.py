"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each whole text becomes a set of word shingles (64-bit hashes), its minima under `N_HASHES` functions, band keys over groups of minima, and a
   signature of the low `BITS` bits of each minimum, packed into longs.
2. Texts with equal sets are one node (of the smallest id), so groups of copies cost one row from here on.
3. Nodes that share a band key are candidates. Nodes tied by shared keys form a family, outside which none of them has a candidate. A family of at most
   `FAMILY` nodes and `FAMILY_SHINGLES` shingles is solved in one piece: its candidates, in order of nodes, are estimated from equal signature parts, corrected for chance
   collisions, and those that could reach the threshold are confirmed on full sets; no pair within a component needs a test, as only components are asked for.
4. Larger families are solved over many tasks, as exactly. First each node meets one pivot per bucket (two rounds, other pivots in the second); then, in
   buckets that still hold several components, pairs of nodes of different components are sought: nodes that share a rare shingle (one of at most
   `RARE` of these nodes, and among the node's rarest) meet through it; any other two share no rare shingle, so their common part is at most what each has of frequent ones, and only
   nodes for which that can suffice meet, by signature, in blocks of bounded size. None between two components is left out.
5. Components come from rewiring stars; rows get the component of their node.

Texts travel once, to the families' nodes only. Joins with texts are merge joins at every size, as the ids grow with the data.

Defined cases: null and wordless texts have an empty set and link with nothing; texts with fewer words than a shingle have one shingle, the whole
sequence; rows that repeat a doc_id count as one document with all their texts; a row with a null doc_id links with nothing, has a null component and is
kept; very long texts are taken whole; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary, drop, materialize, mix64, small_batches, worker_cache
from .components import components

N_HASHES, ROWS, BITS = 128, 4, 4
BANDS = N_HASHES // ROWS
#: Signature parts may differ by chance; a candidate passes if its estimate is this far below the threshold (six standard errors at 128).
SLACK = 0.2
#: Nodes of a bucket that meet in one comparison of signatures, at about.
BLOCK = 256
#: Nodes and shingles of a family that is solved in one piece.
FAMILY, FAMILY_SHINGLES = 512, 1 << 20
#: A shingle is rare in at most so many of the nodes in question.
RARE = 128
_rng = np.random.default_rng(20_240_601)
MULTIPLY = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8. bytes.lower() and bytes.split() know A-Z and ASCII white space only, as wanted."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    k = min(n, words)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += h[i : n - k + 1 + i] * PLACE[i]
    return np.unique(mix64(total + np.uint64(k)))


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(N_HASHES, ~np.uint64(0))
    for i in range(0, len(found), 2048):
        np.minimum(out, (found[i : i + 2048] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    return mix64((rows * PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACE[ROWS]).view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 16 to a long."""
    per = 64 // BITS
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    return int(found.sum(dtype=np.uint64).view(np.int64)), int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set (a, b), bands, signature; the last two null for empty sets."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(("minhash",), dict)  # what an operator before kept goes
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                found = shingles(text, words)
                if not len(found):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                least = minima(found)
                rows.append((doc_id, len(found), *fingerprint(found), band_keys(least), signature(least)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long, bands array<long>, signature array<long>")


def equal_parts(x: Column, y: Column) -> Column:
    """Signature parts in which two signatures agree, from bit counts of their differences."""
    total = F.lit(N_HASHES)
    ones = int("0x" + "1" * (64 // BITS), 16)
    for i in range(N_HASHES * BITS // 64):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        d = d.bitwiseOR(F.shiftright(d, 1))
        d = d.bitwiseOR(F.shiftright(d, 2))
        total = total - F.bit_count(d.bitwiseAND(F.lit(ones)))
    return total


def estimated(x: Column, y: Column) -> Column:
    """Similarity with chance collisions taken out."""
    chance = 2.0**-BITS
    return (equal_parts(x, y) / N_HASHES - chance) / (1 - chance)


def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same over arrays of signatures."""
    d = (x ^ y).view(np.uint64)
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    differ = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differ / N_HASHES - chance) / (1 - chance)


def pairs_in(x: tuple, y: tuple, least: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of nodes (signatures, frequent shingles, all shingles) whose frequent parts can suffice and whose estimate is at least `least`."""
    (s, f, n), (t, g, m) = x, y
    common = np.minimum(f[:, None], g[None, :])
    i, j = np.nonzero(100 * common >= percent * (n[:, None] + m[None, :] - common))
    near = similar(s[i], t[j]) >= least
    return i[near], j[near]


def node_texts(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, a, b, text): a text for each different set of the ids in `nodes` (node); rows that repeat an id with the same set count once."""
    text = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("doc_id is not null and text is not null")
    some = text.join(nodes.select("node").distinct().hint("merge"), "node", "left_semi")
    once = some.groupBy("node", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).agg(F.first("text").alias("text")).select("node", "text")
    schema = pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for text in binary(batch.column(1)):
                x, y = fingerprint(shingles(text, words))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), batch.column(1)], schema=schema)

    found = once.mapInArrow(run, "node long, a long, b long, text string")
    return found.groupBy("node", "a", "b").agg(F.first("text").alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose full sets reach the threshold."""
    text = texts.select(F.col("node").alias("u"), F.col("text").alias("tu"))
    both = pairs.join(text, "u").join(text.select(F.col("u").alias("v"), F.col("tu").alias("tv")), "v").select("u", "v", "tu", "tv")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:  # pivots come up again and again
            key = xxhash.xxh3_128_digest(text)
            if key not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[key] = shingles(text, words)
            return seen[key]

        for batch in batches:
            us, vs = [], []
            for u, v, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), binary(batch.column(3)), strict=True):
                p, q = of(x), of(y)
                both_ = len(np.intersect1d(p, q, assume_unique=True))
                if len(p) and 100 * both_ >= percent * (len(p) + len(q) - both_):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    return both.mapInArrow(run, "u long, v long").distinct()


def family_components(nodes: list[int], sets: list[np.ndarray], bands: np.ndarray, signatures: np.ndarray, percent: int, least: float) -> np.ndarray:
    """The least node that each entry of a family reaches; entries with the same node are one from the start."""
    n = len(nodes)
    order = np.argsort(nodes, kind="stable")
    ids, sizes = np.array(nodes)[order], np.array([len(sets[i]) for i in order])
    bands, signatures = bands[order], signatures[order]
    # rows of bits over the shingles that several entries have; others are common to none
    shared, at, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    width = -(-int((counts > 1).sum()) // 64)
    rows = np.zeros((n, max(1, width)), np.uint64)
    ends = np.cumsum(sizes)
    for k in range(n):
        own = at[ends[k] - sizes[k] : ends[k]]
        own = place[own[counts[own] > 1]]
        np.bitwise_or.at(rows[k], own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
    part = np.searchsorted(ids, ids)  # the component of each entry, as its least position
    for k in range(n - 1):
        j = k + 1 + np.flatnonzero(part[k + 1 :] != part[k])
        j = j[(bands[j] == bands[k]).any(axis=1)]
        j = j[similar(signatures[j], signatures[k]) >= least]
        if not len(j):
            continue
        common = np.bitwise_count(rows[j] & rows[k]).sum(axis=1, dtype=np.int64)
        linked = j[100 * common >= percent * (sizes[j] + sizes[k] - common)]
        if len(linked):
            meet = np.append(part[linked], part[k])
            part[np.isin(part, meet)] = meet.min()
    return ids[part][np.argsort(order, kind="stable")]


def small_families(members: DataFrame, texts: DataFrame, words: int, percent: int, least: float) -> DataFrame:
    """(id, component_id) of nodes in families that are solved in one piece: members (family, node, a, b, bands, signature), one row per set."""
    schema = pa.schema([("id", pa.int64()), ("component_id", pa.int64())])

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        _, nodes, bands, signatures, text = zip(*rows, strict=True)
        found = family_components(list(nodes), [shingles(t.encode(), words) for t in text], np.array(bands), np.array(signatures), percent, least)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield solved(held)
                    held = []
                held.append(row)
        if held:
            yield solved(held)

    rows = members.join(texts, ["node", "a", "b"]).select("family", "node", "bands", "signature", "text")
    found = rows.repartition("family").sortWithinPartitions("family").mapInArrow(run, "id long, component_id long")
    return found.distinct()


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the component that each node has so far."""
    if labels is None:
        return members.withColumn("c", F.col("node"))
    return members.join(labels.select(F.col("id").alias("node"), "component_id"), "node", "left").withColumn("c", F.coalesce("component_id", "node")).drop("component_id")


def pivot_pairs(members: DataFrame, labels: DataFrame | None, round_: int, least: float) -> DataFrame:
    """In buckets of several components: each node with the bucket's pivot, if that is of another component and may reach the threshold.

    The pivot is the node whose buckets are fullest (`pop`), as a text near the middle of its group shares most bands; the second round looks at a random third only.
    """
    m = labelled(members, labels).select("node", "c", "pop", "signature", F.explode("buckets").alias("bucket"))
    h = F.xxhash64("node", F.lit(round_))
    first = F.max(F.struct((F.lit(round_ == 0) | (F.pmod(h, F.lit(3)) == 0)).alias("in"), F.col("pop"), h.alias("h"), F.col("node").alias("p"), F.col("c").alias("pc"), F.col("signature").alias("ps")))
    pivots = m.groupBy("bucket").agg(first.alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket", "f.p", "f.pc", "f.ps")
    near = m.join(pivots, "bucket").where("c <> pc").where(estimated(F.col("signature"), F.col("ps")) >= least)
    return near.select(F.least("node", "p").alias("u"), F.greatest("node", "p").alias("v")).distinct()


def shingle_rows(who: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(h, node, c, n, a): each shingle of each set of the nodes in `who` (node, c), with the size and a hash of the set."""
    schema = pa.schema([(x, pa.int64()) for x in ("h", "node", "c", "n", "a")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, c, a, text in zip(*(batch.column(i).to_pylist() for i in range(3)), binary(batch.column(3)), strict=True):
                found = shingles(text, words)
                one = np.ones(len(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(one * x) for x in (node, c, len(found), a))], schema=schema)

    return who.join(texts, "node").select("node", "c", "a", "text").mapInArrow(run, "h long, node long, c long, n long, a long")


def far_pairs(members: DataFrame, labels: DataFrame | None, texts: DataFrame, words: int, percent: int, least: float) -> DataFrame:
    """Pairs (u, v) of nodes of different components that share a bucket of several, or a rare shingle, and may reach the threshold.

    In a bucket, nodes are dealt into blocks by a hash, those of its largest component apart; blocks of that one don't meet each other. Only
    pairs that pass come out.
    """
    m = labelled(members, labels).select("node", "c", F.explode("buckets").alias("bucket")).distinct()
    mixed = m.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    m = materialize(m.join(mixed, "bucket").select("bucket", "node", "c"), "mixed")
    rows = materialize(shingle_rows(m.select("node", "c").distinct(), texts, words), "shingles")
    rare = rows.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    marked = materialize(rows.join(rare, "h"), "rare")
    # Sets that reach the threshold share one of their rarest n - ceil(t n) + 1 shingles (in one common order)
    rank = F.row_number().over(Window.partitionBy("node", "a").orderBy("df", "h"))
    first = marked.withColumn("k", rank).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("df > 1")
    held = first.groupBy("h").agg(F.collect_set(F.struct("node", "c")).alias("l"))  # at most RARE entries
    x = held.select(F.explode("l").alias("x"), "l").where(F.exists("l", lambda y: y["c"] != F.col("x.c")))
    x = x.select("x.node", F.explode(F.filter("l", lambda y: (y["c"] != F.col("x.c")) & (y["node"] > F.col("x.node")))).alias("y"))
    sig = members.select(F.col("node").alias("u"), F.col("signature").alias("su"))
    through_rare = x.select(F.col("node").alias("u"), F.col("y.node").alias("v")).distinct().join(sig, "u").join(sig.select(F.col("u").alias("v"), F.col("su").alias("sv")), "v")
    through_rare = through_rare.where(estimated(F.col("su"), F.col("sv")) >= least).select("u", "v")
    # of each set the frequent part
    size = rows.groupBy("node", "a").agg(F.max("n").alias("n")).join(marked.groupBy("node", "a").agg(F.count("*").alias("r")), ["node", "a"], "left")
    size = size.select("node", "a", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("f")).where(F.col("f") * 100 >= F.col("n") * percent)
    core = materialize(m.join(size, "node"), "core")
    held = core.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    top = held.groupBy("bucket").agg(F.sum("k").alias("k"), F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("top.c").alias("main"), F.col("top.k").alias("n_main"), (F.col("k") - F.col("top.k")).alias("n_rest"))
    core = core.join(top, "bucket").withColumn("side", F.when(F.col("c") == F.col("main"), 0).otherwise(1))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    core = core.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, blocks("n_main")).otherwise(blocks("n_rest"))).cast("int"))
    core = core.join(members.select("node", "a", "signature", "bands"), ["node", "a"])
    held = core.groupBy("bucket", "side", "block").agg(F.collect_list(F.struct("node", "c", "signature", "f", "n", "bands")).alias("rows"))
    meet = top.select("bucket", blocks("n_main").alias("a"), blocks("n_rest").alias("b"))
    rest = F.sequence(F.lit(0), F.col("b") - 1)
    with_main = meet.select("bucket", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), "b").select("bucket", F.lit(0).alias("si"), "i", F.explode(rest).alias("j"))
    among = meet.select("bucket", "b", F.explode(rest).alias("i")).select("bucket", F.lit(1).alias("si"), "i", F.explode(F.sequence(F.col("i"), F.col("b") - 1)).alias("j"))
    left = held.select("bucket", F.col("side").alias("si"), F.col("block").alias("i"), F.col("rows").alias("x"))
    right = held.where("side = 1").select("bucket", F.col("block").alias("j"), F.col("rows").alias("y"))
    both = with_main.union(among).join(left, ["bucket", "si", "i"]).join(right, ["bucket", "j"]).select("bucket", "x", "y")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def arrays(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, tuple]:
        s = rows.values
        signatures = s.field("signature").flatten().to_numpy().reshape(len(s), -1)
        bands = s.field("bands").flatten().to_numpy().reshape(len(s), -1)
        return s.field("node").to_numpy(), s.field("c").to_numpy(), bands, (signatures, s.field("f").to_numpy(), s.field("n").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bucket = batch.column(0)[k].as_py()
                (n1, c1, b1, x), (n2, c2, b2, y) = arrays(batch.column(1)[k]), arrays(batch.column(2)[k])
                i, j = pairs_in(x, y, least, percent)
                far = c1[i] != c2[j]
                i, j = i[far], j[far]
                first = (b1[i] == b2[j]).argmax(axis=1)  # a pair counts in the first band that it shares only
                here = b1[i, first] == bucket
                u, v = np.minimum(n1[i[here]], n2[j[here]]), np.maximum(n1[i[here]], n2[j[here]])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    return both.mapInArrow(run, "u long, v long").union(through_rare).distinct()


def large_families(own: DataFrame, texts: DataFrame, words: int, percent: int, least: float) -> DataFrame:
    """(id, component_id) of nodes with links, from the rows (node, a, bands, signature) of families that are solved over many tasks."""
    keys = own.select("node", "a", F.explode("bands").alias("bucket"))
    size = keys.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket", "size")
    buckets = keys.join(size, "bucket").groupBy("node", "a").agg(F.collect_list("bucket").alias("buckets"), F.sum("size").alias("pop"))  # at most BANDS
    members = materialize(own.select("node", "a", "signature", "bands").join(buckets, ["node", "a"]), "members")
    links, labels = None, None
    for step in range(3):
        pairs = pivot_pairs(members, labels, step, least) if step < 2 else far_pairs(members, labels, texts, words, percent, least)
        found = materialize(confirmed(pairs, texts, words, percent), "confirmed")
        if step and found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        labels = components(links)
    return labels


def tied(labels: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """labels, with what an id of several sets ties together."""
    several = sets.groupBy("doc_id").agg(*[f(x).alias(f"{n}_{x}") for x in "ab" for n, f in (("lo", F.min), ("hi", F.max))]).where("lo_a <> hi_a or lo_b <> hi_b").select("doc_id")
    reached = materialize(sets.join(several, "doc_id").join(nodes.select("a", "b", "node"), ["a", "b"]).select("doc_id", "node").distinct(), "several")
    if reached.isEmpty():
        return labels
    ties = reached.join(reached.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return components(ties.union(labels.select("id", "component_id")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sketch = materialize(sketches(docs, words), "sketch")
    sets = sketch.where("doc_id is not null and n_shingles > 0")
    # nodes: one for each different set; an id with several texts is one node under several fingerprints
    nodes = sets.groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = materialize(nodes, "nodes")
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = keys.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("hi")).where("hub <> hi").select("bucket", "hub")
    members = materialize(keys.join(crowded, "bucket").distinct(), "members")
    families = materialize(components(members.select(F.col("node").alias("u"), F.col("hub").alias("v"))).select(F.col("id").alias("node"), F.col("component_id").alias("family")), "families")
    own = nodes.join(families, "node")
    size = own.groupBy("family").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    own = materialize(own.join(size.select("family", ((F.col("k") <= FAMILY) & (F.col("shingles") <= FAMILY_SHINGLES)).alias("small")), "family"), "own")
    texts = materialize(node_texts(docs, families, words), "texts")
    least = percent / 100 - SLACK
    labels = materialize(small_families(own.where("small"), texts, words, percent, least), "solved")
    large = own.where("not small").select("node", "a")
    if not large.isEmpty():
        far_texts = materialize(texts.join(large, ["node", "a"], "left_semi"), "texts")
        far = large_families(own.where("not small"), far_texts, words, percent, least)
        labels = labels.union(far)
        drop(far_texts)
    for x in (members, families, own, texts):  # no later plan reads these
        drop(x)
    labels = tied(labels, sets, nodes)
    own = nodes.select("a", "b", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("a", "b", F.coalesce("component_id", "node").alias("c"))
    out = sketch.select("doc_id", "n_shingles", "a", "b").join(own, ["a", "b"], "left")
    c = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", c.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN c ON id = doc_id"""
