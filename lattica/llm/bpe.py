"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (hash and displace): a
pre-token that is itself a vocabulary entry is resolved by one probe and one
byte comparison.  Tier two takes the misses: a heap of candidate merges over a
doubly linked list of byte positions, lowest rank first, leftmost on ties,
O(n log n) for a pre-token of n bytes.  Results of either tier are remembered
per worker in two generations of bounded size.

Defined results: a null or empty text has no ids; every whole text is encoded,
however long; repeated rows are encoded one by one; extra columns of the input
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblock import chunks

#: Remembered pre-tokens per generation and worker (about 100 MB a generation).
REMEMBER = 250_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file; the position is the rank.  Ranks that the file leaves out hold no token (empty bytes)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (max((int(r) for _, r in pairs), default=-1) + 1)
    for token, rank in pairs:
        if tokens[int(rank)]:
            raise ValueError(f"rank {int(rank)} stands twice in {path}")
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one displacement per bucket of about four keys.

    Empty strings are no keys.  Equal keys are an error.  Where a bucket finds no place, all are hashed anew with the
    next seed.
    """

    def __init__(self, keys: list[bytes]):
        self.keys = keys
        real = [i for i, k in enumerate(keys) if k]
        if len({keys[i] for i in real}) < len(real):
            raise ValueError("a key stands twice")
        self.n = max(1, len(real))
        self.buckets = self.n // 4 + 1
        self.seed = 0
        while not self._place(real):
            self.seed += 1

    def _place(self, real: list[int]) -> bool:
        n = self.n
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i in real:
            bucket, a, b = self._parts(self.keys[i])
            groups.setdefault(bucket, []).append((a, b, i))
        self.shift = [0] * self.buckets
        self.key_at = [-1] * n
        free = None
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) > 1:
                for d in range(16 * n + 64):
                    at = [(a + d * b) % n for a, b, _ in members]
                    if len(set(at)) == len(at) and all(self.key_at[s] < 0 for s in at):
                        break
                else:
                    return False
                self.shift[bucket] = d
            else:  # single keys take the slots that are left, directly
                free = free or iter([s for s in range(n) if self.key_at[s] < 0])
                at = [next(free)]
                self.shift[bucket] = -at[0] - 1
            for s, (_, _, i) in zip(at, members, strict=True):
                self.key_at[s] = i
        return True

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32) & 0xFFFFFFFF, ((h >> 64) & 0xFFFFFFFF) | 1

    def get(self, key: bytes) -> int:
        """Index of the key, or -1."""
        bucket, a, b = self._parts(key)
        d = self.shift[bucket]
        i = self.key_at[-d - 1 if d < 0 else (a + d * b) % self.n]
        return i if i >= 0 and self.keys[i] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: repeatedly join the adjacent pair of lowest rank, leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is joined to its left
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to:
            continue  # one of its parts has been joined since
        end[i], end[mid] = to, 0
        if to < n:
            before[to] = i
            r = ranks.get(piece[i : end[to]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[to]))
        p = before[i]
        if p >= 0:
            r = ranks.get(piece[p:to])
            if r is not None:
                heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Remembered(dict):
    """pre-token -> value of ``compute``; two generations, each of at most REMEMBER entries."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Called between texts."""
        if len(self) > REMEMBER:
            self.old = dict(self)
            self.clear()


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.table = table or PerfectHash(tokens)
        self.memo = Remembered(self._ids)

    def _ids(self, pre: str) -> tuple[tuple[int, ...], str]:
        piece = pre.encode()
        whole = self.table.get(piece)
        ids = (whole,) if whole >= 0 else tuple(merge(piece, self.ranks))
        return ids, ",".join(map(str, ids))

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """Ids, and the same in decimal joined by commas."""
        self.memo.turn()
        found = [self.memo[pre] for pre in self.split(text or "")]
        return list(chain.from_iterable([x[0] for x in found])), ",".join([x[1] for x in found])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    key, tokens, pattern, seed, shift, key_at = shared.value
    if key not in _codecs:
        table = PerfectHash.__new__(PerfectHash)
        table.seed, table.n, table.buckets, table.shift, table.key_at, table.keys = seed, len(key_at), len(shift), shift, key_at, tokens
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern, table)
    return _codecs[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``ids``.

    The vocabulary (a file of fixed size) and its perfect hash are built once and broadcast.  No shuffle.
    """
    spark: SparkSession = docs.sparkSession
    tokens = read_ranks(rank_file)
    table = PerfectHash(tokens)
    key = hashlib.sha1(b"\0".join(tokens) + pattern.encode()).hexdigest()
    shared = spark.sparkContext.broadcast((key, tokens, pattern, table.seed, table.shift, table.key_at))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for part in chunks(batches):
            n, a, b, every = [], [], [], []
            for text in part.column(1).to_pylist():
                ids, said = codec.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(said.encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    every.append(ids)
            cols = [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)] + ([pa.array(every, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
