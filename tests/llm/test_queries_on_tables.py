"""The registered queries without SQL on the smallest tables, against brute force in Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, pieces, quality, tokens
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words_of(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def plain_statistics(text):
    text, w = text or "", words_of(text)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(runs)
    covered = {j for i, r in enumerate(runs) if twice[r] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    capitals, marks = sum("A" <= c <= "Z" for c in text), sum(c in "!?.,;:" for c in text)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_capitals": capitals, "n_marks": marks}


def plain_features(s):
    n, c = max(s["n_words"], 1), max(s["word_chars"], 1)
    return {"words": float(s["n_words"]), "word_length": s["word_chars"] / n, "symbols_per_word": s["n_symbols"] / n, "dup_line_share": s["n_dup_lines"] / max(s["n_lines"], 1), "repeat_word_share": s["n_repeat_words"] / n, "capital_share": s["n_capitals"] / c, "mark_share": s["n_marks"] / c}


def test_quality_rules(spark, docs):
    rules = quality.fit(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        s, r = plain_statistics(d["text"]), got[d["doc_id"]]
        assert all(r[c] == s[c] for c in quality.STATISTICS)
        failed = s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and not any(x.covers(plain_features(s)) for x in rules.rules))


def test_first_condition_is_the_best_of_all():
    rng = np.random.default_rng(3)
    rows = [{f: float(rng.integers(0, 8)) for f in quality.FEATURES} | {"bad": bool(rng.random() < 0.3)} for _ in range(120)]
    for r in rows:
        r["mark_share"] += 5 * r["bad"]
    bad, good = [r for r in rows if r["bad"]], [r for r in rows if not r["bad"]]
    gain, found = quality.best_condition(bad, good)
    before, best = math.log2(len(bad) / len(rows)), 0.0
    for f in quality.FEATURES:
        values = sorted({r[f] for r in rows})
        for cut in [(a + b) / 2 for a, b in zip(values, values[1:])]:
            for above in (False, True):
                hit = [r["bad"] for r in rows if (r[f] > cut) == above]
                if sum(hit):
                    best = max(best, sum(hit) * (math.log2(sum(hit) / len(hit)) - before))
    assert math.isclose(gain, best) and found[0] == "mark_share"
    learned = quality.learn(rows)
    left = rows
    for rule in learned.rules:  # each rule is precise on what the ones before have left
        hit = [r["bad"] for r in left if rule.covers(r)]
        assert sum(hit) >= 3 and sum(hit) >= 0.95 * len(hit)
        left = [r for r in left if not rule.covers(r)]
    assert learned.rules and 0 < sum(r["bad"] for r in left) < len(bad) or not sum(r["bad"] for r in left)


def test_language_id(spark, docs):
    import zstandard

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names = langid.fit(frame.where(~langid.held_out()).select("doc_id", "text", "lang"))
    own = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=langid.LEVEL, write_content_size=False) for k, v in names.items()}
    got = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, SF).collect()}
    right = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        if not d["text"] or not re.search(r"[^\W\d_]", d["text"]):
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        data = d["text"].lower().encode()
        size = [sum(len(c.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)) for c in own.values()]
        order = sorted(range(len(size)), key=size.__getitem__)
        assert r["lang_pred"] == list(own)[order[0]] and math.isclose(r["score"], 1 - size[order[0]] / size[order[1]], abs_tol=1e-12)
        right += r["held_out"] and r["lang_pred"] == d["lang"]
    assert right >= 0.9 * sum(r["held_out"] for r in got.values())


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    return {d["doc_id"]: t.encode(d["text"] or "", add_special_tokens=False).ids for d in docs}


def test_packing(spark, docs, ids):
    rows = QUERIES["op5_packing"](spark, SF).collect()
    sequences, got = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc_id, own in ids.items():
        own, at = [*own, 1], 0
        for start, length, check, n in sorted(got[doc_id]):
            assert (start, check, n) == (at, crc(own[at : at + length]), len(own))
            at += length
        assert at == len(own)
    short = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        short += at < 2048
    assert short <= 1 + sum(map(len, ids.values())) // (2 << 20)


def test_token_ids(spark, docs, ids):
    rows = sorted(QUERIES["op6_token_ids"](spark, SF).collect(), key=lambda r: r["start"])
    at = 0
    for r, doc_id in zip(rows, sorted(ids), strict=True):
        own = [*ids[doc_id], 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(own), crc(own))
        at += len(own)


def test_sentencepiece(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in QUERIES["op7_sentencepiece"](spark, SF).collect()}
    for d in docs:
        own = [*library.encode(d["text"] or ""), library.eos_id()]
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(own).encode()).hexdigest()


def test_pieces_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, None)], "doc_id long, text string")
    for c in ("n_tokens", "ids_sha256", "decoded_sha256", "ids"):
        d = d.withColumn(c, F.lit("mine"))
    got = pieces.encode_texts(d, tokens.vocabulary("piece_bpe_32k.model"), end_id=2)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and Counter(r["n_tokens"] for r in got.collect())[1] == 1


def test_lm_scores(spark, docs):
    spell = lambda t: (t or "").encode().lower().split() + [b"\n"]
    out = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d in docs if not out[d["doc_id"]] for w in spell(d["text"]))
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in QUERIES["op9_lm_scores"](spark, SF).collect()}
    for d in docs:
        r, w = got[d["doc_id"]], spell(d["text"])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 20]
    assert held and sum(r["bits_per_byte"] for r in held) < 3.5 * len(held)  # of bytes that take some 4 bits alone
