"""Near-duplicates, vectors, language model, WARC and the pipeline: against brute force, with edge rows."""

import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import minhash, mixing, vectors, warc
from millrace.llm.components import components
from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(rows, linked):
    """Smallest id reachable by links."""
    ids = sorted({i for i, _ in rows})
    best = {i: i for i in ids}
    pairs = [(a, b) for n, (a, x) in enumerate(rows) for b, y in rows[n + 1 :] if a != b and linked(x, y)]
    for _ in ids:
        for a, b in pairs:
            best[a] = best[b] = min(best[a], best[b])
    return best


def near_copies(seed, groups, copies):
    rng, out, i = random.Random(seed), [], 10
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    for _ in range(groups):
        base = [word() for _ in range(80)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 7)):
                text[rng.randrange(len(text))] = word()
            out.append((i, " ".join(text)))
            i += 1
    return out


@pytest.mark.parametrize(("words", "percent", "family"), [(3, 85, 512), (5, 80, 512), (3, 85, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words, percent, family):
    """Families in one piece, and, with a small bound, over many tasks."""
    monkeypatch.setattr(minhash, "FAMILY", family)
    rows = near_copies(words, 4, 22) + [(1, None), (2, ""), (3, "Two words"), (4, "two  WORDS"), (5, "two wordß"), (6, "x " * 5000), (7, "x " * 4000), (8, " \n")]
    rows += [(9, rows[0][1]), (9, rows[30][1])]  # an id with two texts ties two groups
    rows += [(500, rows[50][1]), (500, rows[80][1]), (501, "a text of its own"), (501, rows[80][1].upper())]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("node", F.lit(2))

    def linked(x, y):
        a, b = shingle_set(x, words), shingle_set(y, words)
        return bool(a) and 100 * len(a & b) >= percent * len(a | b)

    best = brute_components(rows, linked)
    got = minhash.near_duplicates(docs, words, percent).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == best[r["doc_id"]] and r["kept"] == (best[r["doc_id"]] == r["doc_id"])
    sizes = Counter((i, len(shingle_set(t, words))) for i, t in rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sizes
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("family", [512, 2])
def test_rows_that_repeat_twenty_times(spark, monkeypatch, family):
    monkeypatch.setattr(minhash, "FAMILY", family)
    rows = near_copies(7, 3, 8)
    best = brute_components(rows, lambda x, y: 100 * len(shingle_set(x, 3) & shingle_set(y, 3)) >= 85 * len(shingle_set(x, 3) | shingle_set(y, 3)))
    got = minhash.near_duplicates(spark.createDataFrame(rows * 20, "doc_id long, text string"), 3, 85).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter({(i, best[i]): 20 for i, _ in rows})


def edited(rng, base, places):
    t = list(base)
    t[rng.choice(places)] = "".join(rng.choices("klmnopqrst", k=5))
    return " ".join(t)


def test_far_pairs_of_a_group_larger_than_rare(spark):
    """Pairs of far nodes, none of which has a component yet, through rare shingles and through blocks of nodes with frequent ones."""
    rng = random.Random(9)
    base = ["".join(rng.choices("klmnopqrst", k=5)) for _ in range(100)]
    family = list(base)
    for k in range(0, 60, 6):
        family[k] = "".join(rng.choices("klmnopqrst", k=5))
    rows = [(i, edited(rng, base, range(100))) for i in range(minhash.RARE + 30)] + [(i, edited(rng, family, range(60, 100))) for i in range(200, 206)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = minhash.sketches(docs, 3).withColumnRenamed("doc_id", "node").cache()
    members = nodes.select("node", "a", "signature", "bands", F.col("bands").alias("buckets"), F.lit(1).alias("pop"))
    texts = minhash.node_texts(docs, nodes, 3).cache()
    got = {(r["u"], r["v"]) for r in minhash.far_pairs(members, None, texts, 3, 85, 0.65).collect()}
    sets = {i: shingle_set(t, 3) for i, t in rows}
    true = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert true <= got and len(true) > minhash.RARE**2 / 4
    assert not {(i, j) for i, j in got if i < 200 <= j}


@pytest.mark.parametrize("family", [512, 16])
def test_members_that_link_only_among_themselves(spark, monkeypatch, family):
    monkeypatch.setattr(minhash, "FAMILY", family)
    rng = random.Random(9)
    base = ["".join(rng.choices("klmnopqrst", k=5)) for _ in range(100)]
    family = list(base)
    for k in range(0, 60, 6):
        family[k] = "".join(rng.choices("klmnopqrst", k=5))
    rows = [(i, edited(rng, base, range(100))) for i in range(160)] + [(i, edited(rng, family, range(60, 100))) for i in range(160, 166)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: 0 if i < 160 else 160 for i in range(166)}


def test_a_set_of_an_id_counts_once(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("klmnopqrst", k=5)) for _ in range(60)]
    text, other = " ".join(base), " ".join(base[:-3] + ["x", "y", "z"])
    docs = spark.createDataFrame([(1, text), (1, text), (1, text.upper()), (2, other), (2, other), (3, text), (3, other)], "doc_id long, text string")
    who = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "node long, c long")
    got = Counter((r["node"], r["h"], r["a"]) for r in minhash.shingle_rows(who, minhash.node_texts(docs, who, 3), 3).collect())
    assert set(got.values()) == {1}
    assert Counter(k[0] for k in got) == {1: 58, 2: 58, 3: 116}


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (11, 9), (1, 5), (None, 3)], "u long, v long")
    assert {r["id"]: r["component_id"] for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 11: 8}
    assert components(links.limit(0)).count() == 0
    assert {r["id"]: r["component_id"] for r in components(links, most_links=2).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 11: 8}
    assert components(links.limit(0), most_links=-1).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(60):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, (base + rng.normal(size=16) * 0.03).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(5)]  # exact copies
    odd = [(-1, None, 0), (-2, [0.0] * 16, 0), (-3, [float("nan")] + [1.0] * 15, 0), (-4, rows[0][1], None), (-5, [float("inf")] * 16, 0), (-6, [None] + [1.0] * 15, 0), (-7, rows[0][1][:8], 0), (-8, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    same = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    n = len(rows)
    best = np.arange(n)
    while True:
        new = np.minimum(best, np.where(same, best[None, :], n).min(axis=1))
        if (new == best).all():
            break
        best = new
    for k, (v, *_) in enumerate(rows):
        assert got[v]["n_links"] == same[k].sum() - 1 and got[v]["component_id"] == rows[best[k]][0]
    assert all(got[v[0]]["n_links"] == 0 and got[v[0]]["kept"] for v in odd)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_links_lost_by_dealing_are_found(spark, monkeypatch):
    """Pairs just within the threshold among vectors without clusters, a label dealt to single shards."""
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "OVERLAP", 1)
    rng = np.random.default_rng(6)
    base = vectors.unit(rng.normal(size=(300, 64)))
    side = rng.normal(size=base.shape)
    side = vectors.unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    x = np.concatenate([base, 0.81 * base + math.sqrt(1 - 0.81**2) * side])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, 0.8).collect()}
    assert len(got) == 600 and all(got[i]["n_links"] == got[300 + i]["n_links"] for i in range(300))
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * 600
    assert sum(got[i]["component_id"] == got[300 + i]["component_id"] for i in range(300)) >= 0.9 * 300


def links_of(x, threshold):
    """Directed links and the least position reachable, by brute force."""
    true = np.concatenate([x[i : i + 500] @ x.T >= threshold for i in range(0, len(x), 500)])
    np.fill_diagonal(true, False)
    best = np.arange(len(x))
    while True:
        new = np.minimum(best, np.where(true, best[None, :], len(x)).min(axis=1))
        if (new == best).all():
            return true.sum(axis=1), best
        best = new


@pytest.mark.parametrize("held", [8 << 20, 60_000])
def test_links_across_shards_of_one_large_label(spark, monkeypatch, tmp_path, held):
    """6000 vectors of a label, many shards (divided in a task, or first by centroids sent to all): links as brute force has them, over all rows and the ids divisible by 20."""
    monkeypatch.setattr(vectors, "HELD", held)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.1 for _ in range(4)]).astype(np.float32)
    rows = [(i, v.tolist(), 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vectors.near_vectors(df).collect()
    n, best = links_of(vectors.unit(x), 0.98)
    assert n.sum() > 6000
    mine = {r["vec_id"]: r for r in got}
    assert sum(mine[i]["n_links"] for i in mine) >= 0.95 * n.sum() and all(mine[i]["n_links"] <= n[i] for i in mine)
    assert sum(mine[i]["n_links"] for i in mine if i % 20 == 0) >= 0.9 * n[::20].sum()
    assert sum(mine[i]["component_id"] == best[i] for i in mine) >= 0.95 * len(mine)
    assert min(r["recall"] for r in got) >= 0.9
    if held > 60_000:
        r = vectors.embedding_recall(spark, str(tmp_path)).first()
        assert r["n_queries"] == 300 and r["true_links"] == n[::20].sum() and r["recall"] >= 0.9


def test_shards_hold_each_node_at_home_once():
    rng = np.random.default_rng(1)
    x = vectors.unit(np.concatenate([rng.normal(size=(4000, 16)), np.ones((3000, 16)) + rng.normal(size=(3000, 16)) * 1e-6]))
    home = np.zeros(len(x), bool)
    for _, at, own in vectors.divided(x, np.ones(len(x), bool), 3):
        assert not home[at[own]].any()
        home[at[own]] = True
    assert home.all()


def test_graph_recall_on_a_large_shard():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(500, 32))
    x = vectors.unit(np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, rng.normal(size=(1, 32)) + rng.normal(size=(400, 32)) * 0.02]))
    found, recall = vectors.linked(x, np.arange(len(x)), 0.98)
    true = x @ x.T >= 0.98
    np.fill_diagonal(true, False)
    got = sum(len(f) for f in found)
    assert got >= 0.9 * true.sum() and recall >= vectors.MIN_RECALL
    assert all(true[i, f].all() for i, f in enumerate(found))


def language_rows():
    rng = random.Random(8)
    word = lambda s: "".join(rng.choices(s, k=rng.randint(1, 4)))
    make = {"p": ["th", "ing", "er", "a"], "q": ["sch", "ung", "ei", "o"]}
    rows = [(i, " ".join(word(make[k]) for _ in range(40)), k) for i, k in enumerate(["p", "q"] * 40)]
    rows += [(1000, None, "p"), (1001, "", None), (1002, " \n\t ", "q"), (1003, "x" * 3000, "p"), (1004, "Ünï Tha THA tha", "z"), (1003, "x" * 3000, "p"), (None, "ing tha", "p")]
    return rows


def plain_scores(rows, held, model, block):
    """score of each row, bit by bit in Python, from plainly counted contexts: training rows by a run over them, held-out ones by what it has learned in the end."""
    mask, code = (1 << 32) - 1, model.predictors.code
    spell = lambda t: [*(w + b" " for w in (t or "").encode().lower().split()), b"\n"]
    key = lambda w: xxhash.xxh3_64_intdigest(w if w == b"\n" else w[:-1]) >> 32
    shift = 32 - code.slot_bits

    def mixed32(h):
        h = ((h ^ (h >> 16)) * 0x85EBCA6B) & mask
        return h ^ (h >> 13)

    def bits_of(tokens):
        """For each token the (slots, depth, byte before, bit) of its bits."""
        past, out = b"\n" * 6, []
        before = int(mixing.NO_WORD) >> 32
        for w in tokens:
            bits, so_far = [], 0
            for place, byte in enumerate(w):
                h, hashes = 0, []
                for back in range(1, max(mixing.ORDERS) + 1):
                    h = (h + int(mixing.BYTE_HASH[back][past[-back]])) & mask
                    if back in mixing.ORDERS:
                        hashes.append(mixed32((h + int(mixing.ORDER_HASH[len(hashes)])) & mask))
                hashes.append(mixed32((so_far + before + place * int(mixing.SPREAD)) & mask))
                pair = past[-1] * 256 + byte
                for depth in range(code.lengths[pair]):
                    step = int(code.steps[code.starts[pair] + depth])
                    bits.append(([((x >> shift) + step // 2) % (1 << code.slot_bits) for x in hashes], min(depth, mixing.DEPTHS - 1), past[-1], step % 2))
                so_far = (so_far + int(mixing.PREFIX_HASH[min(place, 15)][byte])) & mask
                past += bytes([byte])
            out.append(bits)
            before = key(w)
        return out

    spelled = [spell(t) for t in rows]
    coded = [bits_of(s) for s in spelled]
    counts, seen, pairs, singles = Counter(), Counter(), Counter(), Counter()
    for s, c, out in zip(spelled, coded, held):
        if not out:
            counts.update((o, x, bit) for bits in c for found, _, _, bit in bits for o, x in enumerate(found))
            seen.update([None, *s[:-1]])
            singles.update(s)
            pairs.update(zip([None, *s], s))

    def paid(i, mixer, learn):
        """The cost of a row in bits; learn collects what the run learns from it."""
        total, own, memory = 0.0, not held[i], mixer.memory()
        for before, w, bits in zip([None, *spelled[i]], spelled[i], coded[i]):
            cost = 0.0
            for found, depth, last, bit in bits:
                x = []
                for o, k in enumerate(found):
                    n = [counts[o, k, 0], counts[o, k, 1]]
                    n[bit] -= own
                    x.append(max(-127, min(127, int(np.rint(np.log(np.float32(n[1] + 0.3) / np.float32(n[0] + 0.3)) * 8)))))
                gate = sum(v != 0 for v in x) * mixing.DEPTHS + depth
                logit = sum(v * float(mixer.weights[o][gate]) for o, v in enumerate(x)) / 8
                bucket = int(max(0, min(mixing.BUCKETS - 1, (logit + 8) * mixing.BUCKETS / 16)))
                centre = 1 / (1 + math.exp(8 - (bucket + 0.5) * 16 / mixing.BUCKETS))
                zero, one = mixer.fix[last, bucket]
                refined = (one + 20 * centre) / (zero + one + 20)
                p = 1 / (1 + math.exp(-max(-15, min(15, logit if bit else -logit))))
                cost -= math.log2(max(1e-6, (p + (refined if bit else 1 - refined)) / 2))
                learn["bits"].append((gate, x, 1 - p if bit else p - 1, last, bucket, bit))
            n = seen[before] - own
            follows = (pairs[before, w] - own) / n if n > 0 else 0.0
            alone = max(singles[w] - own, 0) / max(sum(singles.values()) - own, 1)
            bucket = min(max(n, 0).bit_length(), mixing.SEEN - 1)
            x, y = memory[bucket]
            p = x * follows + y * alone + (1 - x - y) * 2.0**-cost
            learn["tokens"].append((bucket, (x * follows / p, y * alone / p, 1)))
            total -= math.log2(p)
        return total

    size = [sum(map(len, s)) for s in spelled]
    training = [i for i in range(len(rows)) if not held[i]]

    def groups(least):
        out = [[]]
        for i in training:  # blocks of documents
            if sum(size[j] for j in out[-1]) >= least:
                out.append([])
            out[-1].append(i)
        return out

    mixer, squares, bits = mixing.Mixer(), np.full((mixing.ALL, mixing.GATES), 1e-6), [0.0] * len(rows)
    warm = groups(mixing.WARM_BLOCK)
    for g in [*(warm[k % len(warm)] for k in range(mixing.WARM_STEPS)), *groups(block)]:
        learn = {"bits": [], "tokens": []}
        for i in g:
            bits[i] = paid(i, mixer, learn)
        total, many = np.zeros_like(squares), np.zeros(mixing.GATES)
        for gate, x, error, last, bucket, bit in learn["bits"]:
            many[gate] += 1
            total[:, gate] += np.array(x) * error
            mixer.fix[last, bucket, bit] += 1
        for bucket, won in learn["tokens"]:
            mixer.trust[bucket] += won
        mean = total / np.maximum(many, 1)
        squares += mean * mean
        mixer.weights += (mixing.RATE * mean / np.sqrt(squares)).astype(np.float32)
    for i in range(len(rows)):
        if held[i]:
            bits[i] = paid(i, mixer, {"bits": [], "tokens": []})
    return [-x * math.log10(2) for x in bits]


def test_language_model_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4000)
    monkeypatch.setattr(mixing, "WARM_BLOCK", 3000)
    monkeypatch.setattr(mixing, "WARM_STEPS", 9)
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).withColumn("chunk", F.lit(1)).withColumn("held_out", mixing.held_out())
    got = mixing.score(docs).collect()
    assert len(got) == len(rows)
    spell = lambda t: (t or "").encode().lower().split() + [b"\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in rows if not out(i) for w in spell(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, out(i), len(spell(t)), sum(c[w] > 0 for w in spell(t)), n, round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in spell(t)), 6)) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    model, *_ = mixing.fit(docs)
    assert (model.n, model.distinct) == (n, v)
    plain = plain_scores([t for _, t, _ in rows], [out(i) for i, *_ in rows], model, 4000)
    by = sorted((str(i), s) for (i, *_), s in zip(rows, plain))
    mine = sorted((str(r["doc_id"]), r["score"]) for r in got)
    assert [i for i, _ in mine] == [i for i, _ in by]
    assert np.allclose([s for _, s in mine], [s for _, s in by], rtol=1e-4, atol=1e-3)
    fresh = [r for r in got if r["held_out"] and r["n_tokens"] > 30]
    assert fresh and sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)
    assert mixing.score(docs.limit(0)).count() == 0


def test_language_model_without_training_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").withColumn("held_out", F.lit(True))
    got = {r["doc_id"]: r for r in mixing.score(docs).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["base_score"] == 0
    assert math.isclose(got[1]["score"], -5 * 8 * math.log10(2), rel_tol=1e-6) and math.isclose(got[2]["score"], -8 * math.log10(2), rel_tol=1e-6)


def test_repeated_texts_are_told_apart_in_chunks_and_slices(spark, monkeypatch):
    """Texts that occur twice cost fewer bits than those that don't, also over many small chunks and slices, which change no count."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "su", "te", "ra", "no"], k=rng.randint(2, 4)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(120)]
    rows = list(enumerate(texts + texts[:12]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held_out", mixing.held_out())
    whole = {r["doc_id"]: r for r in mixing.score(docs).collect()}
    monkeypatch.setattr(mixing, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(mixing, "SLICE_KEYS", 500)
    got = {r["doc_id"]: r for r in mixing.score(docs).collect()}
    twin = {i: i + 120 for i in range(12)} | {i + 120: i for i in range(12)}
    known = {i for i, j in twin.items() if not got[j]["held_out"]}  # the other one is in the training text
    flagged = set(sorted(got, key=lambda i: got[i]["bits_per_byte"])[: len(known)])
    assert len(flagged & known) >= 0.95 * len(known) and len(known) >= 18
    assert all(math.isclose(got[i]["base_score"], whole[i]["base_score"], rel_tol=1e-12) and got[i]["n_known"] == whole[i]["n_known"] for i in got)
    assert sum(r["score"] for r in got.values()) > 1.2 * sum(r["score"] for r in whole.values())  # short runs learn less


def test_codes_are_prefix_codes():
    rng = np.random.default_rng(2)
    histogram = np.zeros((256, 256), np.int64)
    histogram[97:110, 97:120] = rng.integers(0, 50, (13, 23)) ** 3
    paths = mixing.huffman(histogram[100])
    assert sum(2.0 ** -len(p) for p in paths) == 1 and len({tuple(p) for p in paths}) == 256
    step = {}
    for p in paths:  # each node with a bit leads to one place
        for here, there in zip(p, [*p[1:], (tuple(p), None)]):
            assert step.setdefault(here, there[0]) == there[0]
    code = mixing.Code.of(histogram.reshape(-1), 12)
    assert (code.lengths.reshape(256, 256)[:97] == [len(p) for p in mixing.huffman(histogram.sum(axis=0))]).all()


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/ c\r\nX: y", "same"), (3, None, None), (4, "", ""), (5, "http://é/", "é\r\n\r\nWARC/1.1\r\n" * 3000), (None, "http://n/", "same"), (6, "u", "own"), (6, "u", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("sha", "keeper", "row", "payload", "refers_to", "_metadata"):
        pages = pages.withColumn(c, F.lit("clash"))
    files = warc.write_warc(pages)
    captures = warc.assemble(warc.read_warc(files)).collect()
    assert len(captures) == len(rows)
    assert all(c["request"]["target_uri"] == c["response"]["target_uri"] and c["metadata"]["note"].startswith("page_id:") for c in captures)
    texts = Counter(bytes(c["response"]["payload"]).decode() for c in captures if c["response"]["record_type"] == "response")
    assert texts == Counter(["same", "", rows[4][2], "own", "own"])
    by = {c["metadata"]["note"]: c["response"] for c in captures}
    assert by["page_id: 1"]["record_type"] == "revisit" and by["page_id: 1"]["refers_to"] == by["page_id: 2"]["record_id"] and by["page_id: 1"]["payload_bytes"] == 4
    assert by["page_id: 3"]["refers_to"] == by["page_id: 4"]["record_id"] and by["page_id:"]["record_type"] == "revisit"
    ids = [c[k]["record_id"] for c in captures for k in ("request", "response", "metadata")]
    assert len(set(ids)) == len(ids)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.resolved(warc.assemble(warc.read_warc(files))).collect())
    assert got == Counter([(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2), (6, "response", None), (6, "response", None)])
    assert warc.assemble(warc.read_warc(warc.write_warc(pages.limit(0)))).count() == 0
    assert warc.write_warc(pages, least_bytes=10_000).count() >= 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    order = sorted(rel.columns)
    assert sorted(df.columns) == order
    at = [rel.columns.index(x) for x in order]
    assert sorted(repr([r[x] for x in order]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(1)
    syllables = {"xx": ["tha", "ing", "ou", "er", "the", "nd"], "yy": ["sch", "ung", "ei", "ach", "der", "be"]}
    word = lambda k: "".join(rng.choices(syllables[k], k=rng.randint(1, 4)))
    texts = [(i, " ".join(word(k) for _ in range(60)), k) for i, k in enumerate(["xx", "yy"] * 40)]
    junk = [(200 + i, " ".join(word("xx") + "$$$" for _ in range(60)), "xx") for i in range(30)]
    edited = " ".join(texts[3][1].split()[:-1] + ["changed"])
    extra = [(300, texts[0][1], "xx"), (301, edited, "yy"), (302, None, None), (303, "123 456", "xx"), (304, "short text", "xx"), (0, texts[0][1], "xx")]
    rows = [(i, t, k, f"s{i % 3}", len(t or ""), True) for i, t, k in texts + junk + extra]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean").withColumn("q_t", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, *_ in texts] + [(i, 0, 0) for i, *_ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, held = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{n}"))
        now = spark.read.parquet(str(tmp_path / f"out{n}"))
        if n < 3:
            assert now.columns == docs.columns
            held[n] = Counter(r["doc_id"] for r in now.collect())
    clean = {i for i, *_ in texts}
    assert clean <= set(held[0]) and not {302, 303} & set(held[0])
    assert clean <= set(held[1]) and not ({304} | {i for i, *_ in junk}) & set(held[1])
    assert held[2] == Counter(clean)
    assert {r["doc_id"] for r in now.collect()} == clean
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
