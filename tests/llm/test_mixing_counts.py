"""Counting of contexts: what is equal is looked up once, and counts as often as it comes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm import mixing


def chunk_of(texts):
    index = mixing.Index()
    ids = [np.fromiter((index[w] for w in [*t.encode().lower().split(), mixing.END]), np.int32) for t in texts]
    many = np.array([len(x) for x in ids])
    return mixing.Chunk(pa.array(range(len(texts)), pa.int64()), np.zeros(len(texts), bool), np.array([len(t.encode()) for t in texts]), many, np.concatenate(ids), list(index))


def test_equal_bytes_in_equal_contexts_are_counted_once(monkeypatch):
    texts = ["the cat sat on the mat, ünï \x00\x1c end", "", "a", "no other like it"] * 50
    c = chunk_of(texts)
    code = mixing.Code.of(c.byte_pairs(), 12)
    bits = int((c.byte_pairs() * code.lengths).sum())
    plain, table = (np.zeros((mixing.ALL, 2 << 12), np.int64) for _ in range(2))
    for text in texts:  # one document at a time: nothing of another document is met
        for b in mixing.blocks(chunk_of([text]), 1, False):
            mixing.count_block(b, code, plain)
    binned, real = [], np.bincount

    def bincount(x, *args, **named):
        binned.append(len(x))
        return real(x, *args, **named)

    monkeypatch.setattr(np, "bincount", bincount)
    for b in mixing.blocks(c, 1 << 20, False):
        mixing.count_block(b, code, table)
    assert (table == plain).all() and (table.sum(axis=1) == bits).all()
    assert sum(binned) <= mixing.ALL * bits / 50


def test_words_come_back_from_a_chunk(tmp_path):
    c = chunk_of(["B \x00 \x1c\x1f ünï x   " + "y" * 70_000, "", "b B"])
    c.write(f"file://{tmp_path}/a.chunk")
    got = mixing.Chunk.read(f"file://{tmp_path}/a.chunk")
    assert got.words == c.words and mixing.END in got.words and (got.tokens == c.tokens).all() and got.doc_ids.equals(c.doc_ids)


def test_a_word_beyond_the_range_of_doubles_leaves_scores_finite():
    """A long word met once has a probability below 2^-1074; what the memories learn from it is nothing, not undefined."""
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(0x21, 0x41, 3000)))
    c = chunk_of(["a b", f"a {long} b", "a b c", "b a"])
    code = mixing.Code.of(c.byte_pairs(), 12)
    table = np.zeros((mixing.ALL, 2 << 12), np.int64)
    for b in mixing.blocks(c, 1 << 20, False):
        mixing.count_block(b, code, table)
    words = np.bincount(c.tokens, minlength=len(c.words))
    _, at, times = np.unique(c.pair_keys(40), return_inverse=True, return_counts=True)
    bits = mixing.online(c, words, times[at], mixing.Predictors(code, *mixing.logits(table)), len(c.n_tokens), len(c.tokens))
    assert np.isfinite(bits).all() and bits[1] > 1100
