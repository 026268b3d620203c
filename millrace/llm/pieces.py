"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Each prefix of a segment has one correct encoding, so its last token is unique: it is the token that an automaton finds to end
there and that may follow the last token of the prefix before it. Whether two tokens may stand side by side is tested by undoing their merges, latest first: no
merge across their border may come earlier than the one undone. The table of last tokens gives all ids, read backwards.

Segments begin at each run of spaces: no piece of such a vocabulary has a space after another character (checked when the model is read).
Runs of two or more spaces merge at equal scores, where order decides; such segments, and models whose pieces tie elsewhere, are merged step by step instead.

Defined cases: a null text is empty (its end id alone); characters outside the vocabulary become byte pieces; very long segments are encoded piecewise at
line ends where these are outside the vocabulary; rows repeat as they come, a null doc_id is kept, an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, worker_cache
from .tokens import vocabulary

SPACE_MARK = "▁"
#: Types of pieces in a model file.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
MEMO = 500_000
SEGMENTS = re.compile(r" +[^ ]*|[^ ]+")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""

    def varint(p: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[p]
            value |= (b & 127) << shift
            p, shift = p + 1, shift + 7
            if b < 128:
                return value, p

    p = 0
    while p < len(data):
        key, p = varint(p)
        kind = key & 7
        if kind == 0:
            value, p = varint(p)
        elif kind == 2:
            n, p = varint(p)
            value, p = data[p : p + n], p + n
        else:
            n = 4 if kind == 5 else 8
            value, p = np.frombuffer(data[p : p + n], "<f4" if n == 4 else "<f8")[0].item(), p + n
        yield key >> 3, value


class PieceEncoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        pieces = [dict(fields(v)) for k, v in parts if k == 1]
        spec = dict(fields(next((v for k, v in parts if k == 3), b"")))
        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
            raise ValueError("models that rewrite characters or spaces are not supported")
        self.front = " " if spec.get(3, 1) else ""
        texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        self.scores = [p.get(2, 0.0) for p in pieces]
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == NORMAL}
        self.bytes_ = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == BYTE}
        self.unknown = next(i for i, k in enumerate(kinds) if k == UNKNOWN)
        if any(SPACE_MARK in t.lstrip(SPACE_MARK) for t in self.ids):
            raise ValueError("pieces with inner spaces are not supported")
        # merges in their order: higher scores first
        merged = sorted((i for t, i in self.ids.items() if len(t) > 1), key=lambda i: -self.scores[i])
        self.rank = {i: r for r, i in enumerate(merged)}
        spaces = {i for t, i in self.ids.items() if not t.strip(SPACE_MARK)}
        ordered = [self.scores[i] for i in merged if i not in spaces]
        self.has_newline = any("\n" in t for t in self.ids)
        self.tied = len(set(ordered)) < len(ordered)
        self.texts, self.split = texts, {}
        self.reachable = set()
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            parts, last = self.merge(t, trace=True)
            if len(parts) == 1:
                self.reachable.add(i)
                if last is not None:
                    self.split[i] = last
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}

    def merge(self, text: str, trace: bool = False) -> tuple[list[str], tuple[int, int] | None]:
        """Step-by-step merging: the pair with the best score, the leftmost among equal ones. Also the last pair merged."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts) and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, parts[a], parts[b]))

        for a in range(len(parts) - 1):
            offer(a)
        last = None
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = after[a] if a < len(parts) else len(parts)
            if parts[a] != x or b >= len(parts) or parts[b] != y:
                continue
            last = (self.ids.get(x), self.ids.get(y))
            parts[a], parts[b], after[a] = x + y, "", after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [p for p in parts if p], last if last and None not in last else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a: their merges are undone, latest first, and none across the border may come before the one undone."""
        left, right, limit = a, b, 1 << 60
        rank, split, ids, texts = self.rank, self.split, self.ids, self.texts
        while True:
            across = ids.get(texts[left] + texts[right])
            if across is not None and rank[across] < limit:
                return False
            x, y = split.get(left), split.get(right)
            if x is None and y is None:
                return True
            if y is None or (x is not None and rank[left] > rank[right]):
                limit, left = rank[left], x[1]
            else:
                limit, right = rank[right] + 1, y[0]

    def table(self, text: str) -> list[int] | None:
        """Ids of a segment by the prefix table; None where a prefix has no last token (a character outside the vocabulary)."""
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        fits, compatible = self.fits, self.compatible
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                prior = last[start]
                if prior < 0:
                    continue
                pair = (prior, token)
                ok = fits.get(pair)
                if ok is None:
                    ok = fits[pair] = compatible(prior, token)
                    if len(fits) > 4 * MEMO:
                        fits.clear()
                if not ok:
                    continue
            last[end], size[end] = token, length
        out, at = [], n
        while at:
            if last[at] < 0:
                return None
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def segment(self, text: str) -> list[int]:
        """Ids of a segment; characters that no piece holds stand alone, as bytes."""
        if self.tied or SPACE_MARK * 2 in text:
            out = []
            for p in self.merge(text)[0]:
                i = self.ids.get(p)
                out += [i] if i is not None else self.as_bytes(p)
            return out
        if (found := self.table(text)) is not None:
            return found
        out, run = [], []
        for c in text:
            if c in self.ids:
                run.append(c)
                continue
            out += self.known(run) + self.as_bytes(c)
            run = []
        return out + self.known(run)

    def known(self, run: list[str]) -> list[int]:
        return self.table("".join(run)) if run else []

    def as_bytes(self, text: str) -> list[int]:
        return [self.bytes_[b] for b in text.encode()] if self.bytes_ else [self.unknown]

    def plain(self, segment: str) -> list[int]:
        """Ids of a segment of text, its spaces at the front; cut at line ends if no piece holds one."""
        parts = segment.replace(" ", SPACE_MARK).split("\n") if not self.has_newline else [segment.replace(" ", SPACE_MARK)]
        out = self.segment(parts[0]) if parts[0] else []
        for p in parts[1:]:
            out = out + self.as_bytes("\n") + (self.segment(p) if p else [])
        return out


class Lookup(dict):
    """' ' + chunk -> (ids as bytes, ids as decimal text)."""

    def __init__(self, encoder: PieceEncoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        if not chunk:
            raise KeyError
        if len(self) >= MEMO:
            kept = list(islice(self.items(), MEMO // 2))
            self.clear()
            self.update(kept)
        found = as_pair(self.encoder.plain(" " + chunk))
        if len(chunk) <= 64:
            self[chunk] = found
        return found


def as_pair(ids: list[int]) -> tuple[bytes, bytes]:
    return np.array(ids, "<i4").tobytes(), b"".join(b" %d" % i for i in ids)


def encoder(path: str) -> tuple[PieceEncoder, Lookup]:
    def make() -> tuple[PieceEncoder, Lookup]:
        own = PieceEncoder(path)
        return own, Lookup(own)

    return worker_cache(("piece", path), make)


def encoded(text: str | None, own: PieceEncoder, lookup: Lookup) -> tuple[bytes, bytes]:
    """Ids of a whole text, as 32-bit integers and as ' 1 2 3'."""
    if not text:
        return b"", b""
    text = own.front + text.replace(SPACE_MARK, " ")
    chunks = text.split(" ")
    try:
        parts = [lookup[c] for c in chunks[1:]]
        parts.insert(0, as_pair(own.plain(chunks[0])))
    except KeyError:  # runs of spaces, or one at the end
        parts = [as_pair(own.plain(s)) for s in SEGMENTS.findall(text)]
    return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])


def encode_texts(docs: DataFrame, path: str, end_id: int | None = None, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) with n_tokens, digests of ids and decoded text, and, if asked for, `ids` and `decoded` themselves."""
    small_batches(docs.sparkSession)
    out = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids
    schema = pa.schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lookup = encoder(path)
        end = as_pair([] if end_id is None else [end_id])
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, decimal = encoded(text, own, lookup)
                raw, decimal = raw + end[0], decimal + end[1]
                ids = np.frombuffer(raw, "<i4")
                decoded = own.library.decode(ids.tolist()) if len(ids) else ""
                row = [i, len(ids), hashlib.sha256(decimal[1:]).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row + [ids, decoded] * with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, vocabulary("piece_bpe_32k.model"), end_id=2, with_ids=False)
