"""Packing of tokenised documents into sequences by cutting-stock column generation.

A document is cut into full sequences and one remainder, so that only the
histogram of remainder lengths (at most ``size - 1`` lengths, whatever the
corpus) decides the packing.  The linear program "fewest sequences that cover
the histogram" is solved over patterns; an unbounded-knapsack dynamic program
prices new patterns from the duals, a revised simplex brings them in, beside
exchanges of a length for shorter ones, and the search ends, at every size, when
no pattern has a price above one, that is when the program is optimal.  Patterns are rounded down, what is left is packed
best-fit, and the k-th document of each length takes the k-th slot that the
patterns have for that length.  Ranks come from counts per length and hash
class, so a length that a third of all documents share is ranked in many tasks.

Defined results: a null or empty text is its end id alone (one piece);
repeated rows are packed one by one; an empty table gives no pieces; extra
columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textblock import chunks

#: Documents per hash class in which they are ranked.
RANKED = 10_000
#: A column's price above one that counts as an improvement; columns looked at for one knapsack.
PRICE, POOL = 1e-9, 200
#: Characters on which all Unicode versions agree how to split; other texts go to the tokenizer whole.
_ODD = re.compile("[^\x00-\x1b\x20-ſ‐-‧€]")


# ---------------------------------------------------------------- the linear program


def knapsack(value: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: most value in capacity c, items free to repeat; took[c]: the item that ends it, or -1 (lengths ascending)."""
    m = int(np.searchsorted(length, size, "right"))
    by_length = np.full(size + 1, -np.inf)
    by_length[length[:m]] = value[:m]
    best, ends = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    back, some = np.zeros(size + 1), np.empty(size + 1)  # best from the largest capacity down
    for c in range(1, size + 1):
        v = np.add(back[size - c + 1 :], by_length[1 : c + 1], out=some[:c])
        k = int(v.argmax())
        best[c] = best[c - 1]
        if v[k] > best[c] + 1e-12:
            best[c], ends[c] = v[k], k + 1
        back[size - c] = best[c]
    item = np.full(size + 1, -1)
    item[length[:m]] = np.arange(m)
    return best, item[ends]


def _unwind(took: np.ndarray, length: np.ndarray, c: int) -> list[int]:
    items = []
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            items.append(int(took[c]))
            c -= int(length[took[c]])
    return items


def start(length: np.ndarray, demand: np.ndarray, size: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[int]]:
    """A basis to begin with: patterns (lengths' indices, times), how often each is used, and the length that each one uses up.

    A sequence is filled behind the longest length left, as well as the lengths left allow, until one of its lengths is
    used up.  No later pattern holds that length, so the basis is triangular in this order.  Lengths that end together
    with another one get a pattern of their own, used zero times.
    """
    left = demand.astype(float).copy()
    patterns, counts, ended = [], [], []
    while True:
        open_ = np.flatnonzero(left > 0)
        if not len(open_):
            break
        i = int(open_[-1])
        some = length[open_]
        _, took = knapsack(some + some * some / (size * size * 4.0), some, size - int(length[i]))
        items, times = np.unique([i, *(int(open_[k]) for k in _unwind(took, some, size - int(length[i])))], return_counts=True)
        ratio = left[items] / times
        k = int(np.argmin(ratio))
        patterns.append((items, times))
        counts.append(float(ratio[k]))
        ended.append(int(items[k]))
        left[items] -= ratio[k] * times
        left[items[k]] = 0
        left[left < 1e-9] = 0
    for i in sorted(set(range(len(length))) - set(ended)):
        patterns.append((np.array([i]), np.array([size // int(length[i])])))
        counts.append(0.0)
        ended.append(i)
    return patterns, np.array(counts), ended


def _inverse(patterns: list[tuple[np.ndarray, np.ndarray]], ended: list[int]) -> np.ndarray:
    """Inverse of the first basis (rows: patterns, columns: lengths), by substitution."""
    m = len(patterns)
    at = np.empty(m, np.int64)
    at[ended] = np.arange(m)
    out = np.zeros((m, m))
    out[np.arange(m), ended] = 1
    for j, (items, times) in enumerate(patterns):
        out[j] /= times[items == ended[j]]
        for i, n in zip(items, times, strict=True):
            if at[i] != j:
                out[at[i]] -= n * out[j]
    return out


class Solution(NamedTuple):
    """Patterns (indices into the lengths, times) and uses; columns brought in; the best price left (1: optimal)."""

    patterns: list[tuple[np.ndarray, np.ndarray]]
    uses: np.ndarray
    pivots: int
    price: float


def without_exchanges(columns: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Patterns and uses that cover the same without columns that exchange a length for shorter ones.

    Exchanges are carried out from the longest length down, so what one of them puts into a pattern may be exchanged again.
    """
    held: list[list] = []
    holders: dict[int, list[int]] = {}

    def hold(items: dict[int, int], n: float) -> None:
        for i in items:
            holders.setdefault(i, []).append(len(held))
        held.append([items, n])

    exchanges = []
    for (items, times), n in zip(columns, x, strict=True):
        if n > 0:
            column: dict[int, int] = {}
            for i, t in zip(items.tolist(), times.tolist(), strict=True):
                column[i] = column.get(i, 0) + t
            if min(column.values()) < 0:
                exchanges.append((max(column), column, float(n)))
            else:
                hold(column, float(n))
    for k, column, left in sorted(exchanges, key=lambda e: -e[0]):
        while left > 0 and holders.get(k):
            at = holders[k].pop()
            items, n = held[at]
            if not n or not items.get(k):
                continue
            part = min(n, left)
            left -= part
            held[at][1] = n - part
            if n > part:
                holders[k].append(at)
            made = dict(items)
            for i, t in column.items():
                made[i] = made.get(i, 0) + t
            hold({i: t for i, t in made.items() if t}, part)
    out: dict[tuple, float] = {}
    for items, n in held:
        if n > 0:
            key = tuple(sorted(items.items()))
            out[key] = out.get(key, 0.0) + n
    return [(np.array([i for i, _ in key]), np.array([t for _, t in key])) for key in out], np.array(list(out.values()))


def solve(length: np.ndarray, demand: np.ndarray, size: int) -> Solution:
    """Fewest sequences that cover the histogram (ascending lengths), fractions allowed: columns are priced and brought in until none improves.

    A place for a length also takes a shorter one, or two whose sum is no longer.  Such exchanges are columns that cost
    nothing; they change no total, but keep the duals of neighbouring lengths in order, which patterns alone would
    need many more columns for.  They are carried out in the patterns at the end.

    Demands are raised by up to a millionth each, all differently, so that every step makes the total smaller and the
    search ends.  Sums are written out instead of matrix products: these arrays are too small to share among the threads
    of a linear-algebra library, in a process that has others.
    """
    m = len(length)
    raised = demand + 1e-6 * (1 + np.arange(m) * 0.6180339887 % 1)
    columns, x, ended = start(length, raised, size)
    inverse = _inverse(columns, ended)
    dual = inverse.sum(axis=0)
    cost, change = np.ones(m), np.empty((m, m))
    pivots = 0

    def bring(items: np.ndarray, times: np.ndarray, price: float, gain: float) -> None:
        nonlocal x, dual, pivots
        column = (inverse[:, items] * times).sum(axis=1)
        up = np.flatnonzero(column > 1e-9)
        r = int(up[np.argmin(x[up] / column[up])])
        step = x[r] / column[r]
        row = inverse[r] / column[r]
        x = np.maximum(x - step * column, 0)
        x[r] = step
        some = np.flatnonzero(column)
        if len(some) * 3 < m:
            inverse[some] -= column[some, None] * row
        else:
            np.subtract(inverse, np.multiply(column[:, None], row, out=change), out=inverse)
        inverse[r] = row
        dual = dual - gain * row
        columns[r], cost[r] = (items, times), price
        pivots += 1

    # of each length but the shortest: every shorter one with the longest that fits beside it
    room = length[:, None] - length
    beside = np.searchsorted(length, room, "right") - 1
    of, one = np.nonzero((beside >= 0) & (beside <= np.arange(m)))
    two = beside[of, one]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    many = np.diff(np.r_[first, len(of)])

    def exchange_for_two() -> int:
        if not len(of):
            return 0
        gain = dual[one] + dual[two] - dual[of]
        hit = np.flatnonzero((gain == np.repeat(np.maximum.reduceat(gain, first), many)) & (gain > PRICE))
        hit = hit[np.argsort(-gain[hit])][: POOL // 2]
        k, i, j = of[hit], one[hit], two[hit]
        used = 0
        while used < len(hit):
            gain = dual[i] + dual[j] - dual[k]
            t = int(np.argmax(gain))
            if gain[t] <= PRICE:
                break
            bring(np.array([i[t], j[t], k[t]]), np.array([1, 1, -1]), 0.0, float(gain[t]))
            used += 1
        return used

    while True:
        before, upto = pivots, pivots + m
        while pivots < upto and exchange_for_two():
            pass
        while m > 1:
            gain = dual[:-1] - dual[1:]
            k = int(np.argmax(gain))
            if gain[k] <= PRICE:
                break
            bring(np.array([k, k + 1]), np.array([1, -1]), 0.0, float(gain[k]))
        best, took = knapsack(dual, length, size)
        if best[size] > 1 + PRICE:
            # one pattern through each length: its value is dual + the best of what is left
            through = dual + best[size - length]
            pool = {tuple(sorted([int(i), *_unwind(took, length, size - int(length[i]))])) for i in np.argsort(-through)[:POOL] if through[i] > 1 + PRICE}
            found = [np.unique(p, return_counts=True) for p in sorted(pool)]
            items, times = (np.concatenate(c) for c in zip(*found, strict=True))
            begin = np.cumsum([0, *(len(i) for i, _ in found[:-1])])
            for _ in range(POOL):
                gain = np.add.reduceat(dual[items] * times, begin) - 1
                k = int(np.argmax(gain))
                if gain[k] <= PRICE:
                    break
                bring(*found[k], 1.0, float(gain[k]))
        if pivots == before:
            return Solution(*without_exchanges(columns, x), pivots, float(best[size]))
        dual = inverse[cost > 0].sum(axis=0)


def plan(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) with whole counts that cover the histogram exactly."""
    length = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(v)] for v in length], dtype=float)
    out: dict[tuple[int, ...], int] = {}
    left = {v: int(histogram[v]) for v in length.tolist()}
    if len(length):
        found = solve(length, demand, size)
        for (items, times), x in zip(found.patterns, found.uses, strict=True):
            need = dict(zip(length[items].tolist(), times.tolist(), strict=True))
            n = min(int(x + 1e-3), *(left[v] // k for v, k in need.items()))
            if n:
                lengths = tuple(v for v in sorted(need, reverse=True) for _ in range(need[v]))
                out[lengths] = out.get(lengths, 0) + n
                for v, k in need.items():
                    left[v] -= k * n
    # what rounding left: best fit, longest first
    room: dict[int, list[list[int]]] = {}
    for v in sorted((v for v, n in left.items() if n), reverse=True):
        for _ in range(left[v]):
            fits = min((r for r in room if r >= v), default=None)
            if fits is None:
                bin_, fits = [], size
            else:
                bin_ = room[fits].pop()
                if not room[fits]:
                    del room[fits]
            bin_.append(v)
            room.setdefault(fits - v, []).append(bin_)
    for bins in room.values():
        for b in bins:
            out[tuple(b)] = out.get(tuple(b), 0) + 1
    return sorted((list(k), n) for k, n in out.items())


# ---------------------------------------------------------------- tokens


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def spec_of(content: str) -> dict:
    """The parsed file; an error if its ids are not the ranks of its merges, which the rank encoder takes them for."""
    spec = json.loads(content)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    letters = _byte_letters()
    if sorted(vocab[c] for c in letters) != list(range(256)):
        raise ValueError("the first 256 ids of the vocabulary must be the bytes")
    for i, m in enumerate(merges):
        if vocab["".join(m.split(" ") if isinstance(m, str) else m)] != 256 + i:
            raise ValueError(f"merge {i} does not have the id {256 + i}")
    return spec


class Tokens:
    """Ids of whole texts under a byte-level BPE file, as the ``tokenizers`` library gives them without special tokens added.

    In these files a token's id is its merge rank (``spec_of`` checks that), so the rank encoder of ``tiktoken`` gives
    the same ids several times faster.  Texts that hold a special token's name, which the library takes for that token,
    and texts with characters on which the two libraries' Unicode tables might differ go to the library itself.
    """

    def __init__(self, content: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        letters, spec = _byte_letters(), json.loads(content)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = re.compile("|".join([_ODD.pattern, *(re.escape(t) for t in sorted(special))]))
        self.content, self.own = content, None

    def ids(self, text: str) -> list[int]:
        if not self.special.search(text):
            return self.fast(text)
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_str(self.content)
        return self.own.encode(text, add_special_tokens=False).ids


_encoders: dict[int, Tokens] = {}


def token_pieces(docs: DataFrame, tokenizer_file: str, pattern: str, size: int, end_id: int = 0) -> DataFrame:
    """Per document: ``doc_id, doc_tokens, crcs`` (of each cut of ``size`` ids, the remainder last).  No shuffle."""
    with open(tokenizer_file) as f:
        content = f.read()
    spec_of(content)
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Tokens(shared.value, pattern)
        ids_of = _encoders[key].ids
        for part in chunks(batches):
            n, crcs = [], []
            for text in part.column(1).to_pylist():
                ids = np.array([*ids_of(text), end_id] if text else [end_id], "<u4")
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + size].tobytes()) for i in range(0, len(ids), size)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


# ---------------------------------------------------------------- assignment


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Place every piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    The driver sees at most ``size`` counts; the slots that it broadcasts are bounded by
    ``size`` patterns of at most ``size`` items, plus the bins of what rounding left.
    """
    spark = pieces.sparkSession
    n_docs, longest = pieces.agg(F.count("*"), F.max("doc_tokens")).first()
    classes = int(n_docs // RANKED) + 1
    p = pieces.withColumns({"rest": F.col("doc_tokens") % size, "cls": F.pmod(F.xxhash64("doc_id"), F.lit(classes))})
    counts = p.groupBy("rest", "cls").agg(F.count("*").alias("n"))
    histogram = {r.rest: r.n for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    patterns = plan({k: v for k, v in histogram.items() if k}, size)

    slots, base, upto = [], 0, dict.fromkeys(histogram, 0)
    for lengths, n in patterns:
        at = 0
        for v in lengths:
            slots.append((v, upto[v], upto[v] + n, base, at))
            upto[v] += n
            at += v
        base += n
    slot = F.broadcast(spark.createDataFrame(slots, "slot_rest long, lo long, hi long, base long, slot_at long").coalesce(1))
    # rank of each document within its remainder length: count of the classes before its own, then its place in its class
    before = Window.partitionBy("rest").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("rest").alias("r_rest"), F.col("cls").alias("r_cls"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("rest", "cls").orderBy("doc_id", "doc_tokens", "crcs")
    ranked = p.withColumn("place", F.row_number().over(place) - 1).join(starts, (F.col("rest") == F.col("r_rest")) & (F.col("cls") == F.col("r_cls")))
    ranked = ranked.withColumn("rank", F.col("first") + F.col("place"))
    seated = ranked.join(slot, (F.col("rest") == F.col("slot_rest")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    # a number of its own for each document, from which its full sequences are numbered
    firsts, run = [], 0
    for r in sorted(histogram):
        firsts.append((r, run))
        run += histogram[r]
    first = F.broadcast(spark.createDataFrame(firsts, "f_rest long, f_first long").coalesce(1))
    per_doc = int(longest or 0) // size + 1
    e = seated.join(first, F.col("rest") == F.col("f_rest")).select("*", F.posexplode("crcs").alias("k", "ids_crc32"))
    full = F.col("k") < F.floor(F.col("doc_tokens") / size)
    return e.select(
        "doc_id",
        (F.col("k") * F.lit(size).cast("long")).alias("start"),
        F.when(full, F.lit(size).cast("long")).otherwise(F.col("rest")).alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(full, F.lit(base).cast("long") + (F.col("f_first") + F.col("rank")) * per_doc + F.col("k")).otherwise(F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("sequence_id"),
        F.when(full, F.lit(0).cast("long")).otherwise(F.col("slot_at")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, pattern: str, size: int = 1024) -> DataFrame:
    return pack(written(token_pieces(docs, tokenizer_file, pattern, size), "pieces"), size)
