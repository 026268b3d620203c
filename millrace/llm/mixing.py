"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is spelled as its tokens: each word in UTF-8 with a space after it, and a line end at last. Bytes are spelled in bits along Huffman codes of the training text, one for
each byte before (all 256 bytes have a code in each), so that most bytes take few bits. `ALL` predictors look up counts of zeros and ones under a hash of the bytes before (`ORDERS`), or of the
word before and this word so far, together with the node of the code. Their logits are combined by weights that a gate selects (how many predictors know the context, how deep
the bit lies), and the result is refined by adaptive tables of (byte before, logit). Weights and tables are learned online, block by block, over all training text, each bit predicted
with its own occurrence taken out of the counts, and before it is learned from. Each chunk of documents is a run of its own; its first blocks are passed before, to warm up.

The bits of a token give its probability from the bytes. Two memories of all training text predict it too: the share of all tokens that this word has, and the share of the word
before that this word follows. A gate (how often the word before was seen) weighs the three, learned with the rest. So a text that occurs again is told from one that
doesn't, whatever the size of the corpus. A training document's score is what the run of its chunk has paid for it, always without its own occurrences; a held-out one is scored
by what the run has learned in the end.

Data flow: documents are read once and written as chunks (files of words, token numbers and documents in the shared folder). A chunk sends each of its different words and
pairs once, with counts, to the owner of the hash slice, and gets the totals back; a word, however common, is one entry per chunk. Number of slices, bits of
pair keys, size of tables grow with the corpus (tables up to `MAX_SLOT_BITS`). Sent to all: tables (3 bytes x ALL x 2^MAX_SLOT_BITS at most) and codes (some MB at most).

Defined cases: a null text is empty and has its end token alone; a null doc_id is learned from and not held out; rows that repeat are learned and scored as often as they
come; words may be of any length, a document is held as a whole; ties don't arise; without training text counts are zero and all bits are even odds; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import cycle, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, materialize, mix64, new_path, small_batches

ORDERS = (3, 5)
ALL = len(ORDERS) + 1
MIN_SLOT_BITS, MAX_SLOT_BITS = 12, 19
#: A chunk ends after so many tokens or bytes, at the end of a document.
CHUNK_TOKENS, CHUNK_BYTES = 2_500_000, 16 << 20
#: Words and pairs of a slice, at about; bytes that a block of learning or scoring, and of counting, has at about; different bytes in context that are counted at once.
SLICE_KEYS, BLOCK, COUNT_BLOCK, COUNT_KEYS = 1 << 20, 1 << 15, 1 << 21, 1 << 18
END, STOP = b"\n", b" "
DEPTHS, BUCKETS, SEEN = 8, 25, 40
#: Steps before a run, and bytes of each; a short run goes round until it has made them.
WARM_STEPS, WARM_BLOCK = 128, 1 << 12
GATES = (ALL + 1) * DEPTHS
RATE = 0.05
#: Logits are kept in eighths in one byte; entries of a slice of the tables.
SCALE, TABLE_SLICE = 8, 4096
_rng = np.random.default_rng(20_240_607)
BYTE_HASH = _rng.integers(0, 1 << 32, (max(ORDERS) + 1, 256), dtype=np.uint32)
PREFIX_HASH = _rng.integers(0, 1 << 32, (16, 256), dtype=np.uint32)
NODE_HASH = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
ORDER_HASH = _rng.integers(0, 1 << 32, ALL, dtype=np.uint32)
SPREAD = np.uint32(0x9E3779B1)
NO_WORD = np.uint64(0x8C6F_3A11_59D2_E07B)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# Chunks


class Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Chunk:
    """Documents with their lengths in tokens, token numbers one after the other, and the words that they number."""

    doc_ids: pa.Array
    held: np.ndarray
    n_bytes: np.ndarray
    n_tokens: np.ndarray
    tokens: np.ndarray
    words: list[bytes]

    def tables(self) -> list[pa.Table]:
        docs = pa.table({"doc_id": self.doc_ids, "held": self.held, "n_bytes": self.n_bytes, "n_tokens": self.n_tokens})
        return [docs, pa.table({"token": self.tokens}), pa.table({"word": pa.array(self.words, pa.binary())})]

    def write(self, path: str) -> None:
        at, inner = fs.FileSystem.from_uri(path)
        at.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with at.open_output_stream(inner) as sink:
            for t in self.tables():
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t)

    @staticmethod
    def read(path: str) -> Chunk:
        at, inner = fs.FileSystem.from_uri(path)
        with at.open_input_stream(inner) as source:
            docs, tokens, words = (pa.ipc.open_stream(source).read_all() for _ in range(3))
        column = lambda t, name: t.column(name).combine_chunks()
        # words hold no space; cutting one text is some five times as fast as taking each value out of the column
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], column(words, "word")), STOP)[0].as_py()
        return Chunk(column(docs, "doc_id"), column(docs, "held").to_numpy(zero_copy_only=False), column(docs, "n_bytes").to_numpy(), column(docs, "n_tokens").to_numpy(), column(tokens, "token").to_numpy(), joined.split(STOP))

    def starts(self) -> np.ndarray:
        """The first token of each document, and the end of the last."""
        return np.append(0, np.cumsum(self.n_tokens))

    def training(self) -> np.ndarray:
        """For each token, whether it is of training text."""
        return np.repeat(~self.held, self.n_tokens)

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))

    @cached_property
    def before(self) -> np.ndarray:
        """For each token the number of the word before, -1 at the start of a document."""
        out = np.empty(len(self.tokens), np.int64)
        out[1:] = self.tokens[:-1]
        out[self.starts()[:-1]] = -1
        return out

    @cached_property
    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words as one run of bytes, where each starts, and for each byte a hash of the word so far."""
        data, starts = spelled(self.words)
        lengths = np.diff(starts)
        place = (np.arange(len(data)) - np.repeat(starts[:-1], lengths)).astype(np.uint32)
        own = PREFIX_HASH[np.minimum(place, 15), data]
        so_far = np.cumsum(own, dtype=np.uint32) - own
        so_far -= np.repeat(so_far[starts[:-1]], lengths)
        return data, starts, so_far + place * SPREAD

    @cached_property
    def word_hashes(self) -> np.ndarray:
        """A hash of each word as the word before; the last entry is that of -1."""
        return (np.append(self.hashes, NO_WORD) >> np.uint64(32)).astype(np.uint32)

    def byte_pairs(self) -> np.ndarray:
        """Counts of (byte before, byte) in training text, flat."""
        data, starts = spelled(self.words)
        training, first = self.training(), self.before < 0
        many, at_first = (np.bincount(self.tokens[x], minlength=len(self.words)) for x in (training, training & first))
        pair = data.astype(np.int64)
        pair[1:] += 256 * data[:-1].astype(np.int64)
        pair[starts[:-1]] = 256 * STOP[0] + data[starts[:-1]].astype(np.int64)
        times = np.repeat(many, np.diff(starts))
        times[starts[:-1]] -= at_first
        out = np.bincount(pair, times, 1 << 16)
        out[256 * END[0] : 256 * END[0] + 256] += np.bincount(data[starts[:-1]], at_first, 256)
        return out.astype(np.int64)

    def pair_keys(self, bits: int) -> np.ndarray:
        """For each token a key of `bits` bits of it and the word before."""
        h = np.append(self.hashes, NO_WORD)  # the last entry is that of -1
        return mix64(h[self.before] * np.uint64(0x9E3779B97F4A7C15) + h[self.tokens]) >> np.uint64(64 - bits)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words of a chunk as one run of bytes, each with its end, and where each starts."""
    parts = [w if w == END else w + STOP for w in words]
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))


def chunked(docs: DataFrame) -> DataFrame:
    """Writes docs (doc_id, text, held_out) as chunks; returns (chunk, path, train_tokens, train_docs, bytes, histogram), one row per chunk.

    Attempts write under names of their own, and only names in a finished task's report count.
    """
    small_batches(docs.sparkSession)
    folder = new_path(docs.sparkSession, "chunks")
    schema = pa.schema([("chunk", pa.int64()), ("path", pa.string()), ("tokens", pa.int64()), ("train_tokens", pa.int64()), ("train_docs", pa.int64()), ("histogram", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24

        def written(number: int, rows: list[tuple], ids: list[np.ndarray], index: Index) -> pa.RecordBatch:
            doc_ids, held, sizes = zip(*rows, strict=True)
            c = Chunk(pa.array(doc_ids, pa.int64()), np.array(held, bool), np.array(sizes, np.int64), np.array([len(x) for x in ids], np.int64), np.concatenate(ids), list(index))
            path = f"{folder}/{number:010x}-{uuid.uuid4().hex[:8]}.chunk"
            c.write(path)
            own = c.tokens[c.training()]
            histogram = packed(c.byte_pairs(), zstandard.ZstdCompressor(level=1))
            return pa.RecordBatch.from_pylist([{"chunk": number, "path": path, "tokens": len(c.tokens), "train_tokens": len(own), "train_docs": int((~c.held).sum()), "histogram": histogram}], schema=schema)

        rows, ids, index, size, n = [], [], Index(), 0, 0
        for b in batches:
            for doc_id, text, out in zip(b.column(0).to_pylist(), binary(b.column(1)), b.column(2).to_pylist(), strict=True):
                tokens = text.lower().split()
                tokens.append(END)
                ids.append(np.fromiter(map(index.__getitem__, tokens), np.int32, len(tokens)))
                rows.append((doc_id, out, len(text)))
                size, n = size + len(text), n + len(tokens)
                if n >= CHUNK_TOKENS or size >= CHUNK_BYTES:
                    yield written(number, rows, ids, index)
                    rows, ids, index, size, n, number = [], [], Index(), 0, 0, number + 1
        if rows:
            yield written(number, rows, ids, index)

    rows = docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, "chunk long, path string, tokens long, train_tokens long, train_docs long, histogram binary")
    return materialize(rows, "chunks")


# Totals of words and pairs


def packed(x: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    """Whole numbers by planes of bytes, compressed."""
    return z.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes, z: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(z.decompress(data), np.uint8).reshape(8, -1).T).view("<u8")[:, 0]


def totals(chunks: DataFrame, slices: int, bits: int) -> DataFrame:
    """(chunk, slice, words, pairs, distinct): for the words and pairs of a chunk whose hash lies in the slice, in their order there, counts over all training text.

    `distinct` has the words with a count, in one row of each slice. A chunk's pairs come in order of their keys, its words in order of their hashes.
    """
    width = slices.bit_length() - 1
    schema = pa.schema([("slice", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])
    out = pa.schema([("chunk", pa.int64()), ("slice", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), ("distinct", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for number, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Chunk.read(path)
                training = c.training()
                h = c.hashes
                order = np.argsort(h, kind="stable")
                counts = np.bincount(c.tokens[training], minlength=len(h))[order]
                keys, at = np.unique(c.pair_keys(bits), return_inverse=True)
                times = np.bincount(at[training], minlength=len(keys))
                del at
                edges = np.arange(slices + 1, dtype=object)
                of_word = np.searchsorted(h[order] >> np.uint64(64 - width) if width else np.zeros(len(h), np.uint64), edges.astype(np.uint64))
                of_key = np.searchsorted(keys >> np.uint64(bits - width) if width else np.zeros(len(keys), np.uint64), edges.astype(np.uint64))
                rows = []
                for s in range(slices):
                    w, k = slice(of_word[s], of_word[s + 1]), slice(of_key[s], of_key[s + 1])
                    if w.stop > w.start or k.stop > k.start:
                        own = b" ".join([c.words[i] for i in order[w]])
                        rows.append((s, number, z.compress(own), packed(counts[w], z), packed(np.diff(keys[k], prepend=np.uint64(0)), z), packed(times[k], z)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, u, now, held = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), None, []

        def summed() -> Iterator[pa.RecordBatch]:
            found, known = {}, {}
            words = [u.decompress(r[2]).split(b" ") if len(unpacked(r[3], u)) else [] for r in held]
            for w, r in zip(words, held, strict=True):
                for x, n in zip(w, unpacked(r[3], u).tolist(), strict=True):
                    found[x] = found.get(x, 0) + n
            keys = [np.cumsum(unpacked(r[4], u), dtype=np.uint64) for r in held]
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, np.concatenate([unpacked(r[5], u) for r in held]), len(known))
            ends = np.cumsum([len(k) for k in keys])
            distinct = sum(n > 0 for n in found.values())
            for i, (r, w) in enumerate(zip(held, words, strict=True)):
                mine = np.fromiter(map(found.__getitem__, w), np.int64, len(w))
                pairs = sums[at[ends[i] - len(keys[i]) : ends[i]]].astype(np.int64)
                yield pa.RecordBatch.from_pylist([{"chunk": r[1], "slice": r[0], "words": packed(mine, z), "pairs": packed(pairs, z), "distinct": 0 if i else distinct}], schema=out)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != now:
                    if held:
                        yield from summed()
                    now, held = r[0], []
                held.append(r)
        if held:
            yield from summed()

    sent = chunks.select("chunk", "path").repartition(partitions_of(chunks)).mapInArrow(send, "slice long, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary")
    d = sent.repartition(max(1, slices // 4), "slice").sortWithinPartitions("slice", "chunk")
    return materialize(d.mapInArrow(own, "chunk long, slice long, words binary, pairs binary, distinct long"), "totals")


def partitions_of(chunks: DataFrame) -> int:
    """A task per chunk."""
    return max(1, chunks.count())


# Spelling in bits


def huffman(histogram: np.ndarray) -> list[list[tuple[int, int]]]:
    """The path of each byte in a code of all bytes: nodes, and the bits taken there."""
    heap = [(int(n) + 1, b, b) for b, n in enumerate(histogram)]  # weight, tie, tree
    heapq.heapify(heap)
    parent: list = [None] * 511
    for node in range(255):
        (n, _, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (256 + node, 0), (256 + node, 1)
        heapq.heappush(heap, (n + m, 256 + node, 256 + node))
    paths = []
    for b in range(256):
        path, at = [], b
        while parent[at]:
            at, bit = parent[at]
            path.append((at - 256, bit))
        paths.append(path[::-1])
    return paths


@dataclass
class Code:
    """For each byte after each byte before: where its path starts and how long it is; along the paths 2 x a node's offset in the tables + bit, and depth; the size of the tables."""

    starts: np.ndarray
    lengths: np.ndarray
    steps: np.ndarray
    depths: np.ndarray
    slot_bits: int

    @staticmethod
    def of(histogram: np.ndarray, slot_bits: int) -> Code:
        """From counts of (byte before, byte). Bytes that were never before another share one code, that of all bytes."""
        rows = histogram.reshape(256, 256)
        shared = huffman(rows.sum(axis=0))
        paths = [p for row in rows for p in (huffman(row) if row.any() else shared)]
        lengths = np.array([len(p) for p in paths], np.int64)
        nodes, bits, depths = (np.array(x) for x in zip(*[(n, b, min(d, DEPTHS - 1)) for p in paths for d, (n, b) in enumerate(p)], strict=True))
        offsets = (NODE_HASH >> np.uint32(32 - slot_bits)).astype(np.int64)
        return Code(np.cumsum(lengths) - lengths, lengths, offsets[nodes] * 2 + bits, depths.astype(np.uint8), slot_bits)

    @cached_property
    def rows(self) -> np.ndarray:
        """Along the paths, the first entry of (byte before, bit) in the flat refinements, as a float."""
        last = np.repeat(np.arange(len(self.lengths)) >> 8, self.lengths)
        return ((last * 2 + (self.steps & 1)) * BUCKETS).astype(np.float32)

    def paths(self, pair: np.ndarray) -> Paths:
        """The paths of bytes (byte before x 256 + byte)."""
        lengths = self.lengths.take(pair, mode="clip")
        ends = np.cumsum(lengths)
        starts = ends - lengths
        position = np.repeat(np.arange(len(pair)), lengths)
        at = (self.starts.take(pair, mode="clip") - starts).take(position, mode="clip")
        at += np.arange(len(at))
        return Paths(starts, position, at, self.steps.take(at, mode="clip"))

    def first_slots(self, h: np.ndarray) -> np.ndarray:
        """The slots that hashes of contexts choose for the root."""
        return (h >> np.uint32(32 - self.slot_bits)).astype(np.int64)

    def slots(self, first: np.ndarray, paths: Paths) -> np.ndarray:
        """Slots x 2 + bit along the paths of bytes from their first slots."""
        out = (first * 2).take(paths.position, mode="clip")
        out += paths.steps
        out &= (2 << self.slot_bits) - 1
        return out


def mixed32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


@dataclass
class Paths:
    """The bits of a run of bytes: where those of each byte start, and for each bit the position of its byte, its place in the code and the step there."""

    starts: np.ndarray
    position: np.ndarray
    at: np.ndarray
    steps: np.ndarray


@dataclass
class Block:
    """Whole documents of a kind (training or held out): their bytes, tokens and places in the chunk, and a hash of the word before and this word so far for each byte."""

    docs: np.ndarray
    tokens: np.ndarray
    data: np.ndarray
    token_starts: np.ndarray
    doc_starts: np.ndarray
    first_tokens: np.ndarray
    in_words: np.ndarray

    def pairs(self) -> np.ndarray:
        """Byte before x 256 + byte; a line end before a document."""
        own = self.data.astype(np.int64)
        last = np.empty_like(own)
        last[1:] = own[:-1]
        last[self.doc_starts] = END[0]
        return last * 256 + own

    def contexts(self) -> np.ndarray:
        """A hash per predictor and byte. Bytes before a document count as line ends."""
        n, data, places = len(self.data), self.data.astype(np.int64), np.arange(max(ORDERS))
        # the first bytes of documents look back beyond them
        at = self.doc_starts[:, None] + places
        inside = at < np.append(self.doc_starts[1:], n)[:, None]
        at, place = at[inside], np.broadcast_to(places, at.shape)[inside]
        h, first, out = np.zeros(n, np.uint32), np.zeros(len(at), np.uint32), np.empty((ALL, n), np.uint32)
        for back in range(1, max(ORDERS) + 1):
            h[back:] += BYTE_HASH[back].take(data[:-back], mode="clip")
            first += BYTE_HASH[back][np.where(place >= back, data[np.maximum(at - back, 0)], END[0])]
            if back in ORDERS:
                o = ORDERS.index(back)
                np.add(h, ORDER_HASH[o], out=out[o])
                out[o, at] = first + ORDER_HASH[o]
                out[o] = mixed32(out[o])
        out[-1] = mixed32(self.in_words)
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


def blocks(c: Chunk, size: int, held: bool | None) -> Iterator[Block]:
    """The chunk's documents of a kind (None: both), in blocks of at least `size` bytes (the last may have fewer)."""
    letters, word_starts, so_far = c.spelling
    widths = np.diff(word_starts)
    hashes, before, doc_token = c.word_hashes, c.before, c.starts()
    lengths = np.add.reduceat(widths[c.tokens], doc_token[:-1]) if len(c.tokens) else np.empty(0, np.int64)
    wanted = np.arange(len(c.n_tokens)) if held is None else np.flatnonzero(c.held == held)
    cut = np.cumsum(lengths[wanted])
    start = 0
    while start < len(wanted):
        base = cut[start - 1] if start else 0
        end = min(len(wanted), int(np.searchsorted(cut, base + size)) + 1)
        docs = wanted[start:end]
        start = end
        many = c.n_tokens[docs]
        first = np.cumsum(many) - many
        at = ragged(doc_token[docs], many)
        tokens = c.tokens[at]
        w = widths[tokens]
        token_starts = np.cumsum(w) - w
        places = ragged(word_starts[tokens], w)
        in_words = so_far.take(places, mode="clip") + np.repeat(hashes[before[at]], w)
        yield Block(docs, at, letters.take(places, mode="clip"), token_starts, token_starts[first], first, in_words)


# Predictors


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys without their repeats, and how often each comes."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def count_block(b: Block, code: Code, table: np.ndarray) -> None:
    """Adds the bits of a block to table[predictor, slot x 2 + bit]. Equal bytes in equal contexts are looked up once and count as often as they come."""
    pair = b.pairs() << code.slot_bits
    for row, h in zip(table, b.contexts(), strict=True):
        keys = code.first_slots(h)
        keys |= pair
        keys.sort()
        keys, times = runs(keys)
        for i in range(0, len(keys), COUNT_KEYS):
            k = keys[i : i + COUNT_KEYS]
            paths = code.paths(k >> code.slot_bits)
            weights = times[i : i + COUNT_KEYS].astype(float).take(paths.position, mode="clip")
            row += np.bincount(code.slots(k & (1 << code.slot_bits) - 1, paths), weights, len(row)).astype(np.int64)  # whole numbers below 2^53


def count_tables(chunks: DataFrame, code: Code) -> np.ndarray:
    """Counts of every predictor over all training text; partial tables are summed where their slices are owned."""
    size = 2 << code.slot_bits
    per = max(1, size * ALL // TABLE_SLICE)
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ALL, size), np.int64)
        for b in batches:
            for path in b.column(0).to_pylist():
                for block in blocks(Chunk.read(path), COUNT_BLOCK, False):
                    count_block(block, code, table)
        z, flat = zstandard.ZstdCompressor(level=1), table.reshape(per, -1)
        some = [i for i in range(per) if flat[i].any()]
        for i in range(0, len(some), 256):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 256], pa.int32()), pa.array([packed(flat[j], z) for j in some[i : i + 256]], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, z, found = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = unpacked(x, u)
                found[i] = found[i] + part if i in found else part
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([packed(x, z) for x in found.values()], pa.binary())], schema=schema)

    # a task counts several chunks, as each sends whole tables
    n = max(1, min(partitions_of(chunks), max(2 * chunks.sparkSession.sparkContext.defaultParallelism, partitions_of(chunks) // 8)))
    parts = chunks.select("path").repartition(n).mapInArrow(count, "slice int, counts binary")
    summed = parts.repartition(min(per, 64), "slice").mapInArrow(add, "slice int, counts binary")
    table, u = np.zeros((per, size * ALL // per), np.int64), zstandard.ZstdDecompressor()
    for r in summed.toLocalIterator():  # the size of the tables is bounded by MAX_SLOT_BITS
        table[r["slice"]] = unpacked(r["counts"], u)
    return table.reshape(ALL, size)


def eighths(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Logits of counts in eighths, in a byte; 0 where there are none."""
    x = np.log((one.astype(np.float32) + np.float32(0.3)) / (zero.astype(np.float32) + np.float32(0.3)))
    return np.clip(np.rint(x * SCALE), -127, 127).astype(np.int8)


def logits(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits by slot, and by slot x 2 + bit with one occurrence of that bit taken out."""
    zero, one = table[:, 0::2], table[:, 1::2]
    without = np.empty(table.shape, np.int8)
    plain = np.empty(zero.shape, np.int8)
    for o in range(len(table)):
        plain[o] = eighths(zero[o], one[o])
        without[o, 0::2] = eighths(np.maximum(zero[o] - 1, 0), one[o])
        without[o, 1::2] = eighths(zero[o], np.maximum(one[o] - 1, 0))
    return plain, without


def squash(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, np.float32(-15), np.float32(15))
    return 1 / (1 + np.exp(-x))


@dataclass
class Mixer:
    """Weights by gate, refinements by (byte before, bucket of the logit, bit), and the memories' weights by how often the word before was seen."""

    weights: np.ndarray = field(default_factory=lambda: np.full((ALL, GATES), 0.3, np.float32))
    fix: np.ndarray = field(default_factory=lambda: np.zeros((256, BUCKETS, 2)))
    trust: np.ndarray = field(default_factory=lambda: np.zeros((SEEN, 3)))  # responsibilities of pairs and of words, and tokens

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mixed logit of bits from the predictors' logits in eighths."""
        logit = self.weights[0].take(gate, mode="clip")
        logit *= x[0]
        for w, row in zip(self.weights[1:], x[1:], strict=True):
            part = w.take(gate, mode="clip")
            part *= row
            logit += part
        logit *= np.float32(1 / SCALE)
        return logit

    @staticmethod
    def bucket(logit: np.ndarray) -> np.ndarray:
        """As a whole float; that of the opposite logit is as far from the other end."""
        out = logit + np.float32(8)
        out *= np.float32(BUCKETS / 16)
        return np.floor(np.clip(out, np.float32(0), np.float32(BUCKETS - 1), out=out), out=out)

    def refined(self) -> np.ndarray:
        """The probability of a bit by (byte before, bit, bucket of the logit toward this bit), flat."""
        centre = squash((np.arange(BUCKETS) + 0.5) * (16 / BUCKETS) - 8)
        one = (self.fix[:, :, 1] + 20 * centre) / (self.fix[:, :, 0] + self.fix[:, :, 1] + 20)
        return np.stack([1 - one[:, ::-1], one], axis=1).astype(np.float32).reshape(-1)

    def refine(self, row: np.ndarray) -> None:
        """Learns from bits by their entries in `refined`."""
        seen = np.bincount(row, minlength=256 * 2 * BUCKETS).reshape(256, 2, BUCKETS)
        self.fix[:, :, 0] += seen[:, 0, ::-1]
        self.fix[:, :, 1] += seen[:, 1]

    def memory(self) -> np.ndarray:
        """Weights of pairs and of words by bucket of the word before; pairs have none where it was never seen."""
        out = (self.trust[:, :2] + 3) / (self.trust[:, 2:] + 10)
        out[0, 0] = 0
        return np.clip(out, 0, 0.499)


@dataclass
class Predictors:
    code: Code
    plain: np.ndarray
    without: np.ndarray

    @staticmethod
    def of(parts: tuple) -> Predictors:
        *code, plain, without = parts
        return Predictors(Code(*code), plain, without)

    def parts(self) -> tuple:
        """Plain values, as broadcasts carry no classes."""
        c = self.code
        return c.starts, c.lengths, c.steps, c.depths, c.slot_bits, self.plain, self.without

    @cached_property
    def toward(self) -> tuple[np.ndarray, np.ndarray]:
        """Logits toward the bit by slot x 2 + bit: plain, and without the bit's own occurrence."""
        out = np.repeat(self.plain, 2, axis=1), self.without.copy()
        for x in out:
            x[:, 0::2] *= -1
        return out

    def token_bits(self, block: Block, mixer: Mixer, own_out: bool, fixed: np.ndarray, learn: Adagrad | None = None) -> np.ndarray:
        """The bits that each token of a block costs by its bytes; with `learn`, the mixer learns from the block afterwards. All logits are toward the bit that comes."""
        code = self.code
        paths, contexts = code.paths(block.pairs()), block.contexts()
        x, gate = np.empty((ALL, len(paths.at)), np.float32), np.zeros(len(paths.at), np.uint8)
        for row, h, table in zip(x, contexts, self.toward[int(own_out)], strict=True):
            found = table.take(code.slots(code.first_slots(h), paths), mode="clip")
            gate += found != 0
            row[:] = found
        gate *= np.uint8(DEPTHS)
        gate += code.depths.take(paths.at, mode="clip")
        gate = gate.astype(np.int64)
        logit = mixer.mixed(x, gate)
        p = squash(logit)
        row = mixer.bucket(logit)
        row += code.rows.take(paths.at, mode="clip")
        row = row.astype(np.int64)
        cost = fixed.take(row, mode="clip")
        cost += p
        cost *= np.float32(0.5)
        cost = np.log2(np.clip(cost, np.float32(1e-6), np.float32(1), out=cost), out=cost)
        if learn is not None:
            learn.step(mixer, x, gate, 1 - p)
            mixer.refine(row)
        return -np.add.reduceat(cost.astype(np.float64), paths.starts[block.token_starts])


class Adagrad:
    """Steps of the weights along the errors, smaller where much has been learned."""

    def __init__(self) -> None:
        self.squares = np.full((ALL, GATES), 1e-6)

    def step(self, mixer: Mixer, x: np.ndarray, gate: np.ndarray, error: np.ndarray) -> None:
        seen = np.bincount(gate, minlength=GATES)
        for o, row in enumerate(x):
            mean = np.bincount(gate, row * error, GATES) / np.maximum(seen, 1)
            self.squares[o] += mean * mean
            mixer.weights[o] += (RATE * mean / np.sqrt(self.squares[o])).astype(np.float32)


# Whole tokens


def known_counts(c: Chunk, rows: list[tuple], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of each word of the chunk, and of the pair at each token, from rows (words, pairs) in slice order."""
    u = zstandard.ZstdDecompressor()
    words = np.empty(len(c.words), np.int64)
    words[np.argsort(c.hashes, kind="stable")] = np.concatenate([unpacked(w, u) for w, _ in rows])
    _, at = np.unique(c.pair_keys(bits), return_inverse=True)
    return words, np.concatenate([unpacked(p, u) for _, p in rows]).astype(np.int64)[at]


@dataclass
class Memories:
    """What the memories say about a chunk's tokens, with their own occurrence taken out or not: by word (at last, none) how often it was seen and the bucket of that; its share of all tokens."""

    c: Chunk
    pairs: np.ndarray
    own: int
    seen: np.ndarray
    bucket: np.ndarray
    alone: np.ndarray

    @staticmethod
    def of(c: Chunk, words: np.ndarray, pairs: np.ndarray, train_docs: int, n: int, own_out: bool) -> Memories:
        own = int(own_out)
        seen = np.maximum(np.append(words, train_docs) - own, 0)
        bucket = np.minimum(np.frexp(seen.astype(float))[1], SEEN - 1).astype(np.int64)
        return Memories(c, pairs, own, seen, bucket, np.maximum(words - own, 0) / max(n - own, 1))

    def shares(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token of a block: the bucket of the word before; the share of that word's occurrences that this one follows, and this one's share of all tokens."""
        before = self.c.before[b.tokens]
        seen = self.seen[before]
        follows = np.minimum((self.pairs[b.tokens] - self.own) / np.maximum(seen, 1), 1.0)
        follows[seen == 0] = 0
        return self.bucket[before], follows, self.alone[self.c.tokens[b.tokens]]


def fed(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Each chunk's file and the totals of its words and pairs, in order, in one partition."""
    both = files.select("chunk", F.lit(-1).cast("long").alias("slice"), "path", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("pairs"))
    both = both.unionByName(counts.select("chunk", "slice", F.lit(None).cast("string").alias("path"), "words", "pairs"))
    return both.repartition(partitions_of(files), "chunk").sortWithinPartitions("chunk", "slice")


def chunks_of(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    """Chunks with their counts from rows of `fed`."""
    path, rows = None, []
    for b in batches:
        for at, words, pairs in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            if at is None:
                rows.append((words, pairs))
                continue
            if path:
                c = Chunk.read(path)
                yield c, *known_counts(c, rows, bits)
            path, rows = at, []
    if path:
        c = Chunk.read(path)
        yield c, *known_counts(c, rows, bits)


def online(c: Chunk, words: np.ndarray, pairs: np.ndarray, predictors: Predictors, train_docs: int, n: int) -> np.ndarray:
    """The run of a chunk: the bits of each of its documents, training ones as they come, held-out ones in the end."""
    mixer, steps, bits = Mixer(), Adagrad(), np.zeros(len(c.n_tokens))
    memories = [Memories.of(c, words, pairs, train_docs, n, own_out) for own_out in (False, True)]

    def paid(b: Block, training: bool) -> np.ndarray:
        cost = predictors.token_bits(b, mixer, training, mixer.refined(), steps if training else None)
        bucket, follows, alone = memories[training].shares(b)
        weights = mixer.memory() * (n > 0)
        follows *= weights[:, 0].take(bucket)
        alone *= weights[:, 1].take(bucket)
        with np.errstate(divide="ignore"):
            total = -np.logaddexp2(np.log2(follows + alone), np.log2(1 - weights.sum(axis=1)).take(bucket) - cost)
        if training:
            won = np.exp2(np.minimum(total, 1000))  # a token that a memory gives any share costs far less; 2^total overflows for long new words
            mixer.trust += np.stack([np.bincount(bucket, x, SEEN) for x in (follows * won, alone * won, None)], axis=1)
        return total

    for b in islice(cycle(list(islice(blocks(c, WARM_BLOCK, False), WARM_STEPS))), WARM_STEPS):
        paid(b, True)
    for held in (False, True):
        for b in blocks(c, BLOCK, held):
            bits[b.docs] = np.add.reduceat(paid(b, not held), b.first_tokens)
    return bits


def byte_histogram(files: DataFrame) -> np.ndarray:
    """Counts of (byte before, byte) of all training text, flat."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, total = zstandard.ZstdDecompressor(), np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += unpacked(x, u).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([packed(total, zstandard.ZstdCompressor(level=1))], pa.binary())], names=["histogram"])

    parts = files.select("histogram").repartition(8).mapInArrow(add, "histogram binary").collect()  # 8 rows
    return sum((unpacked(r["histogram"], zstandard.ZstdDecompressor()).astype(np.int64) for r in parts), np.zeros(1 << 16, np.int64))


@dataclass
class Model:
    """What runs need besides the chunks: sizes of the training text, and the predictors."""

    n: int
    distinct: int
    train_docs: int
    key_bits: int
    predictors: Predictors


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of docs (doc_id, text, held_out), the chunks' files and their totals."""
    files = chunked(docs)
    r = files.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_docs")).first()
    tokens, n, train_docs = (int(x or 0) for x in r)
    histogram = byte_histogram(files)
    # bits of a pair's key: one lookup in some thousands may meet another pair's key by chance
    bits, slices = min(64, max(16, tokens.bit_length() + 12)), 1 << max(0, (tokens // SLICE_KEYS).bit_length())
    counts = totals(files, slices, bits)
    distinct = counts.agg(F.sum("distinct")).first()[0] or 0
    code = Code.of(histogram, min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, int(histogram.sum()).bit_length() - 2)))
    return Model(n, distinct, train_docs, bits, Predictors(code, *logits(count_tables(files, code)))), files, counts


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for docs (doc_id, text, held_out)."""
    model, files, counts = fit(docs)
    n, distinct, train_docs, key_bits = model.n, model.distinct, model.train_docs, model.key_bits
    shared = docs.sparkSession.sparkContext.broadcast(model.predictors.parts())  # 3 x ALL x 2^MAX_SLOT_BITS bytes at most, and the codes
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Predictors.of(shared.value)
        for c, words, pairs in chunks_of(batches, key_bits):
            bits, starts = online(c, words, pairs, own, train_docs, n), c.starts()[:-1]
            base = np.add.reduceat(np.log10((words + 1) / (n + 1 * (distinct + 1)))[c.tokens], starts)
            known = np.add.reduceat((words > 0)[c.tokens].astype(np.int64), starts)
            columns = [c.doc_ids, c.held, c.n_tokens, known, np.full(len(bits), n), base, -bits * math.log10(2), bits / np.maximum(c.n_bytes, 1)]
            yield from pa.table([pa.array(x) for x in columns], schema=schema).to_batches(20_000)

    return fed(files, counts).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.withColumn("held_out", held_out()))
