"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts (A-Z in lower case, then an end sign) are coded as bits: each byte is a
path in a Huffman tree of the 256 byte values, of which 0xFF, which UTF-8 does
not use, is the end sign.  Predictors keep, per hashed context and tree node,
the log-odds of the bit in the training texts: two bytes back, four bytes back,
and the word so far.  A mixer adds them with weights gated by tree node; the
weights follow the gradient of the coding cost while a text is read, and the
mixed probability is refined by an adaptive map from predicted to seen
frequencies.  Both learn from every symbol, at the end of each stretch of
``STRETCH`` symbols, and start anew for every text, so a score depends on
nothing but the text and the model.  What is learned online are the weights and
the map; the predictors' counts are those of the training texts.

A last predictor says whole words: the bits of a word and of the space or end
after it are mixed with the word's share of all training tokens, at rates
(``WORD_RATES``) among which each text's own words decide.  The result is the
text's log10 probability (and bits per byte).

The words' exact counts grow with the input: map tasks send each word hash once
per group of documents, buckets add up, and counts return to the groups; the
unigram base scores use them too.  The context tables have a fixed size (they
are what is broadcast) and are summed over all training texts.

Defined results: null and empty texts are the end sign alone; where ``train``
is null (no ``doc_id``) a row is held out; repeated rows
are scored one by one; an empty table gives no rows; extra columns of the input
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import group_of, text_stats, written
from .textblock import LOWER, SPACE, TextBlock, chunks, local_groups, mix, order_in_cells, trim

#: Text bytes per bucket of words and per group of documents; words a map task gathers before it sends.
BUCKET_BYTES, GROUP_BYTES, GATHER = 20 << 20, 14 << 20, 1_500_000
#: Text bytes whose contexts are found at once.
PART_BYTES = 128 << 10
#: Byte values; bits of a table's slots, and of the slices in which tables are summed.
CLASSES, SLOT_BITS, SLICE_BITS = 256, 24, 4
SLICES = 1 << SLICE_BITS
IN_SLICE = 1 << (SLOT_BITS - SLICE_BITS)
#: (A node's slot is its context's with the node's number turned into the last bits.)
END = 255
ORDERS = 3
#: Gates of the mixer (the most frequent nodes have one each, the others share the last), its first weights, its rate,
#: the symbols it reads before it learns from them, and buckets of the adaptive map.
GATES, FIRST, RATE, STRETCH, BUCKETS = 32, (0.25, 0.50, 0.45), 0.02, 32, 48
#: Texts that are read in step.
LANES = 192
#: Rates at which whole words are mixed in, and what each is given beforehand.
WORD_RATES, WORD_PRIOR = (0.01, 0.05, 0.2), (0.4, 0.4, 0.2)
_LN10 = math.log(10)

# ---------------------------------------------------------------- alphabet and tree


class Alphabet:
    """Huffman paths of byte values, from byte counts of the training texts (256, and texts)."""

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(np.int64)
        weight = counts[:256] + 1.0
        weight[END] += counts[256]
        heap = [(float(w), i, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        kids, n = {}, CLASSES
        seen = np.zeros(CLASSES)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            kids[n] = (a[2], b[2])
            seen[n - CLASSES] = a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], n, n))
            n += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in range(CLASSES)]
        todo = [(heap[0][2], [])]
        while todo:
            node, path = todo.pop()
            if node < CLASSES:
                paths[node] = path
            else:
                todo += [(kid, [*path, (node - CLASSES, bit)]) for bit, kid in enumerate(kids[node])]
        self.length = np.array([len(p) for p in paths])
        self.begin = np.cumsum(self.length) - self.length
        self.node = np.array([n for p in paths for n, _ in p], np.int64)
        self.one = np.array([b for p in paths for _, b in p], np.float32)
        gate = np.empty(CLASSES, np.int64)
        order = np.argsort(-seen, kind="stable")
        gate[order] = np.minimum(np.arange(CLASSES), GATES - 1)
        self.gate = gate[self.node]
        # a gate's step shrinks with the bits that it is expected to see in a stretch
        self.step = RATE / 8 / np.sqrt(1 + STRETCH * np.bincount(gate, weights=seen, minlength=GATES) / weight.sum())
        spaces = np.flatnonzero(SPACE)
        after = np.zeros(256)
        after[spaces] = counts[spaces] + 1
        after[END] = counts[256] + 1
        self.after = np.log(np.maximum(after, 1e-300) / after.sum())


def stream(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after four end signs and before one; where its first byte stands."""
    n = np.diff(block.offsets)
    first = block.offsets[:-1] + np.arange(block.n) * 5 + 4
    raw = np.full(len(block.data) + 5 * block.n, END, np.uint8)
    raw[np.arange(len(block.data)) + np.repeat(first - block.offsets[:-1], n)] = LOWER[block.data]
    return raw, first


_LETTER = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BASE = 0x9E3779B1
_known: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**32, at least ``n``; kept for the next call."""
    if not _known or len(_known[0]) < n:
        _known.clear()
        for base in (_BASE, pow(_BASE, -1, 2**32)):
            out = np.full(max(n, 3 << 20), base, np.uint32)
            out[0] = 1
            _known.append(np.multiply.accumulate(out, out=out))
    return _known[0], _known[1]


def contexts(raw: np.ndarray) -> list[np.ndarray]:
    """Hash (of SLOT_BITS) of each predictor's context before every position (from the fifth on; earlier ones are end signs)."""
    # the four bytes before each position, the last one in the highest place
    before = np.concatenate([np.zeros(4, np.uint8), raw])
    far = np.ndarray(len(raw), "<u4", before, strides=(1,)).astype(np.uint32)
    solid = (raw != END) & ~SPACE[raw]
    begin = np.zeros(len(raw) + 1, np.int64)
    np.multiply(~solid, np.arange(1, len(raw) + 1), out=begin[1:])
    np.maximum.accumulate(begin, out=begin)  # after the last byte that is no word's
    begin = begin[:-1]
    # sums of bytes times powers of an odd number: the same for a word wherever it stands, once divided by its first power
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint32)
    np.cumsum(_LETTER[raw] * power[: len(raw)], dtype=np.uint32, out=sums[1:])
    word = sums[:-1] - sums.take(begin)
    word *= inverse.take(begin)
    word ^= word >> np.uint32(15)
    word *= np.uint32(0x85EBCA77)
    word ^= word >> np.uint32(13)
    word *= np.uint32(0xC2B2AE3D)
    word >>= np.uint32(32 - SLOT_BITS)
    # two bytes back: every context its own slots; the others by the high bits of a product
    near = far >> np.uint32(16)
    near <<= np.uint32(8)
    far *= np.uint32(0x9E3779B1)
    far >>= np.uint32(32 - SLOT_BITS)
    return [near, far, word]


def context_counts(block: TextBlock) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per predictor: keys ``context * CLASSES + byte``, ascending, and how often each occurs."""
    keys: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
    most = np.uint32(2**32 - 1)
    at = 0
    while at < block.n:  # by parts that stay in the processor's cache
        upto = max(at + 1, int(np.searchsorted(block.offsets, block.offsets[at] + PART_BYTES, "right")) - 1)
        raw, first = stream(block.part(at, upto))
        before = (first[:, None] + np.arange(-4, 0)).ravel()
        for known, key in zip(keys, contexts(raw), strict=True):
            key <<= np.uint32(8)
            key |= raw
            key[before] = most  # taken off again below
            known.append(key)
        at = upto
    out = []
    for parts in keys:
        key, n = np.unique(np.concatenate([np.full(1, most), *parts]), return_counts=True)
        n[-1] -= 1 + 4 * block.n
        out.append((key, n) if n[-1] else (key[:-1], n[:-1]))
    return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by key."""
    k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.argsort(k, kind="stable")
    k, n = k[o], n[o]
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[new], np.add.reduceat(n, new)


def slice_odds(keys: np.ndarray, counts: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Log-odds in eighths of one slice of a table, from its class counts."""
    cls = (keys % CLASSES).astype(np.int64)
    base = (keys // CLASSES).astype(np.int64) % IN_SLICE
    length = alphabet.length[cls]
    flat = np.arange(length.sum()) + np.repeat(alphabet.begin[cls] - (np.cumsum(length) - length), length)
    slot = np.repeat(base, length) ^ alphabet.node[flat]
    n = np.repeat(counts, length)
    one = alphabet.one[flat] > 0
    ones, zeros = (np.bincount(slot[m], weights=n[m], minlength=IN_SLICE) for m in (one, ~one))
    return np.clip(np.rint(np.log((ones + 0.2) / (zeros + 0.2)) * 8), -127, 127).astype(np.int8)


class Predictors:
    """Log-odds of bits by predictor and slot, in eighths."""

    def __init__(self, alphabet: Alphabet, tables: np.ndarray):
        self.alphabet, self.tables = alphabet, tables

    @classmethod
    def of(cls, block: TextBlock, alphabet: Alphabet) -> Predictors:
        out = np.zeros((ORDERS, SLICES * IN_SLICE), np.int8)
        for k, (keys, counts) in enumerate(context_counts(block)):
            part = keys >> np.uint32(32 - SLICE_BITS)
            for s in np.unique(part):
                out[k, s * IN_SLICE : (s + 1) * IN_SLICE] = slice_odds(keys[part == s], counts[part == s], alphabet)
        return cls(alphabet, out)

    def __setstate__(self, state: dict) -> None:
        # numpy asks for huge pages for what it allocates itself; what pickle hands over lies in small ones
        self.__dict__.update(state, tables=state["tables"].copy())

    def symbol_costs(self, block: TextBlock) -> np.ndarray:
        """Minus the natural logarithm of the probability of each byte and end sign, text by text."""
        parts = [self._read(block.part(lo, min(lo + LANES, block.n))) for lo in range(0, block.n, LANES)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def _read(self, block: TextBlock) -> np.ndarray:
        """``symbol_costs`` of a few texts, which are read in step, a stretch of each at a time.

        A text's last stretch is filled up with whatever follows: it changes nothing that is still to be read, and what
        is beyond the text is left out in the end.
        """
        a, f4 = self.alphabet, np.float32
        raw, first = stream(block)
        raw = np.concatenate([raw, np.zeros(STRETCH, np.uint8)])
        wide = (len(raw) - STRETCH, STRETCH)
        raw, *slots = (np.lib.stride_tricks.as_strided(x, wide, x.strides * 2) for x in (raw, *contexts(raw)))
        n = np.diff(block.offsets) + 1
        # texts by length, the longest first, so that those that go on are always the first ones
        texts = np.argsort(-n, kind="stable")
        stretches = -(-n[texts] // STRETCH)
        live = np.searchsorted(-stretches, -np.arange(stretches[0]))
        start = np.concatenate([[0], np.cumsum(live)]).tolist()
        step = np.repeat(np.arange(len(live)), live)
        text = np.arange(len(step)) - np.repeat(start[:-1], live)
        place = first[texts][text] + step * STRETCH
        live = live.tolist()
        costs = np.empty((len(step), STRETCH), np.float32)

        # a node's gate, its number and its bit, fetched at once
        path = np.zeros(len(a.node), [("gate_node", "<i8"), ("one", "<f4"), ("", "<f4")])
        path["gate_node"], path["one"] = a.gate << 8 | a.node, a.one
        path = path.view("V16")
        # the weights' negatives for whole log-odds, and a copy with those of a gate side by side
        weights = np.repeat(np.array(FIRST, f4) / f4(-8), block.n * GATES).astype(np.float64).reshape(ORDERS, -1)
        beside = np.zeros((block.n * GATES, 4), f4)
        beside[:, :ORDERS] = weights.T
        fetched = beside.view("V16").ravel()
        step_size = np.tile(-a.step / 8, block.n)
        mid = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS / 2 + 0.5) * 32 / BUCKETS))
        seen, ones = np.full(block.n * BUCKETS, 30.0), np.tile(mid * 30.0, block.n)
        refined = np.tile((0.25 * mid).astype(f4), block.n)

        this, steps = 0, len(live)
        while this < steps:
            # what does not depend on what is learnt, for several steps where few texts go on
            upto = this + 1
            while upto < steps and start[upto + 1] - start[this] <= LANES:
                upto += 1
            rows = slice(start[this], start[upto])
            at = place[rows]
            sym = raw[at].ravel().astype(np.int64)
            length = a.length.take(sym)
            ends = np.cumsum(length)
            stops = ends[STRETCH - 1 :: STRETCH]
            rep = np.repeat(np.arange(len(sym)), length)
            flat = a.begin.take(sym)
            flat += length
            flat -= ends
            flat = flat.take(rep)
            flat += np.arange(len(rep))
            bit = path.take(flat)
            gate, one = bit.view(np.int64)[::2], bit.view(f4)[2::4]
            node = gate & 255
            gate = gate >> 8
            stops = stops.tolist()
            own = np.repeat(text[rows], np.array(stops) - np.array([0, *stops[:-1]]))
            gate += own * GATES
            own *= BUCKETS
            x, odds = [], np.empty(len(rep), np.int8)
            for k in range(ORDERS):
                slots[k][at].ravel().astype(np.int64).take(rep, out=flat, mode="clip")
                flat ^= node
                self.tables[k].take(flat, out=odds, mode="clip")
                x.append(odds.astype(f4))
            both = one * 65536.0
            both += 1.0
            prob = np.empty(len(rep), f4)
            lo = 0
            for s in range(this, upto):
                hi = stops[start[s + 1] - start[this] - 1]
                g = gate[lo:hi]
                w = fetched.take(g).view(f4).reshape(-1, 4)
                z = w[:, 0] * x[0][lo:hi]
                part = np.empty_like(z)
                for k in range(1, ORDERS):
                    z += np.multiply(w[:, k], x[k][lo:hi], out=part)
                np.maximum(z, f4(-16), out=z)
                np.minimum(z, f4(16), out=z)
                np.multiply(z, f4(-BUCKETS / 32), out=part)
                part += f4(BUCKETS / 2 - 1e-3)
                bucket = part.astype(np.int64)
                bucket += own[lo:hi]
                np.exp(z, out=z)
                z += f4(1)
                p = np.reciprocal(z, out=z)
                refined.take(bucket, out=part, mode="clip")
                q = np.multiply(p, f4(0.75), out=prob[lo:hi])
                q += part
                if s + 1 < steps:
                    m = live[s] * GATES
                    err = np.subtract(one[lo:hi], p, out=p)
                    for k in range(ORDERS):
                        pull = np.bincount(g, np.multiply(err, x[k][lo:hi], out=part), m)
                        pull *= step_size[:m]
                        weights[k, :m] += pull
                        beside[:m, k] = weights[k, :m]
                    # bits seen and ones among them in one sum
                    m = live[s] * BUCKETS
                    new = np.bincount(bucket, both[lo:hi], m)
                    came = np.floor(new * 2.0**-16)
                    ones[:m] += came
                    came *= 65536
                    new -= came
                    seen[:m] += new
                    np.divide(ones[:m], seen[:m], out=new)
                    new *= 0.25
                    refined[:m] = new
                lo = hi
            # one is 0 or 1: now, up to its sign, the probability of what came
            prob += one
            prob -= f4(1)
            np.abs(prob, out=prob)
            np.log(prob, out=prob)
            costs[rows] = -np.bincount(rep, prob, len(sym)).reshape(-1, STRETCH)
            this = upto
        back = np.lexsort((step, texts[text]))
        here = np.minimum(n[texts][text] - step * STRETCH, STRETCH)[back]
        return costs[back][np.arange(STRETCH) < here[:, None]]

    def cost(self, block: TextBlock, share: np.ndarray | None = None) -> np.ndarray:
        """Per text, minus the natural logarithm of its probability; ``share``: each word's share of the training tokens."""
        n = np.diff(block.offsets) + 1
        begin = np.cumsum(n) - n
        each = self.symbol_costs(block)
        upto = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
        total = upto[begin + n] - upto[begin]
        start, end, first = block.words()
        if share is None or not len(start):
            return total
        doc = np.repeat(np.arange(block.n), np.diff(first))
        # symbols have one end sign per text more than the bytes
        by_bytes = upto[end + doc + 1] - upto[start + doc]
        next_ = np.append(block.data, 0)[end]
        next_[end == block.offsets[doc + 1]] = END
        whole = np.log(np.maximum(share, 1e-300)) + self.alphabet.after[next_]
        # how much likelier the whole word is than its bytes
        whole += by_bytes
        most = np.minimum(whole, 600)
        whole -= most
        ratio = np.exp(most, out=most)
        gained = np.stack([np.bincount(doc, weights=np.log((1 - r) + r * ratio) + whole, minlength=block.n) for r in WORD_RATES])
        return total - np.logaddexp.reduce(gained + np.log(WORD_PRIOR)[:, None], axis=0)


# ---------------------------------------------------------------- token counts

_MASK = np.uint64((1 << 48) - 1)


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _code(h: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """An identity from the part of a hash that is sent and its bucket."""
    return mix(h) + np.asarray(bucket).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _wide(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one needs them."""
    return counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8").tobytes()


def _unwide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.int64)


def _words(low: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = low.words()
    return np.repeat(np.arange(low.n), np.diff(first)), low.hash_ranges(start, end)


_SENT = "bucket int, grps binary, sizes binary, hashes binary, counts binary"


def _send(buckets: int):
    """Map over texts: per bucket and group of documents, each word once with its count in training texts; in bucket -1, byte counts."""
    names = [f.split()[0] for f in _SENT.split(", ")]
    row = lambda b, *blobs: pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names)

    def rows(names_of, grp, h, n):
        b = _bucket(h, buckets)
        o = order_in_cells(b * len(names_of) + grp, h)
        b, grp, h, n = b[o], grp[o], h[o], n[o]
        new = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (grp[1:] != grp[:-1]) | (h[1:] != h[:-1])])
        counts = np.add.reduceat(n, new)
        b, grp, h = b[new], grp[new], h[new] & _MASK
        cuts = np.searchsorted(b, np.arange(buckets + 1))
        for i in range(buckets):
            lo, hi = cuts[i], cuts[i + 1]
            if lo < hi:
                part = grp[lo:hi]  # ascending
                at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                u, size = part[at], np.diff(np.r_[at, len(part)])
                yield row(i, names_of[u].astype("<i4").tobytes(), size.astype("<u4").tobytes(), _six(h[lo:hi]), counts[lo:hi].astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen, met = [], 0, np.zeros(257, np.int64), {}
        for part in chunks(batches):
            low = TextBlock.from_arrow(part.column(1)).lowered()
            train = np.array(part.column(2).to_pylist(), bool)
            seen[:256] += np.bincount(low.data[np.repeat(train, np.diff(low.offsets))], minlength=256)
            seen[256] += train.sum()
            doc, h = _words(low)
            grp = local_groups(part.column(0), met)
            for g in np.unique(grp):
                for learn in (True, False):  # each word of the chunk once
                    u, n = np.unique(h[((grp == g) & (train == learn))[doc]], return_counts=True)
                    if len(u):
                        parts.append((np.full(len(u), g), u, n * learn))
                        held += len(u)
            if held > GATHER:
                yield from rows(np.array(list(met)), *(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts, held, met = [], 0, {}
                trim()
        if parts:
            yield from rows(np.array(list(met)), *(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield row(-1, b"", b"", b"", seen.astype("<i8").tobytes())

    return run


_FREQ = "grp int, bucket int, hashes binary, counts binary, n long, v long"


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """In a bucket: counts of its words for each group that has them; group -1: tokens and distinct words; group -2: byte counts."""
    names = [f.split()[0] for f in _FREQ.split(", ")]
    bucket = key[0].as_py()

    def rows(grp, hashes, counts, n, v):
        return pa.table([pa.array(grp, pa.int32()), pa.array([bucket] * len(grp), pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary()), pa.array(n, pa.int64()), pa.array(v, pa.int64())], names)

    if bucket < 0:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return rows([-2], [b""], [total.astype("<i8").tobytes()], [0], [0])
    get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    grp = np.repeat(get("grps", "<i4"), get("sizes", "<u4"))
    h, n = _unsix(b"".join(table.column("hashes").to_pylist())), get("counts", "<u4").astype(np.int64)
    o = np.lexsort((grp, h))
    h, grp, n = h[o], grp[o], n[o]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    each = np.add.reduceat(n, new)
    total = np.repeat(each, np.diff(np.r_[new, len(h)]))
    once = np.r_[True, (h[1:] != h[:-1]) | (grp[1:] != grp[:-1])] & (total > 0)
    h, grp, total = h[once], grp[once], total[once]
    o = np.argsort(grp, kind="stable")
    h, grp, total = h[o], grp[o], total[o]
    u, first = np.unique(grp, return_index=True)
    cut = list(zip(first, np.r_[first[1:], len(grp)], strict=True))
    return rows([*u.tolist(), -1], [*(_six(h[a:b]) for a, b in cut), b""], [*(_wide(total[a:b]) for a, b in cut), b""], [0] * len(u) + [int(each.sum())], [0] * len(u) + [int((each > 0).sum())])


# ---------------------------------------------------------------- the whole


def _learn():
    """Map over training texts: the task's context counts by predictor and slice (keys as differences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(ORDERS)]
        press = zstandard.ZstdCompressor(1).compress

        def send():
            for k, parts in enumerate(held):
                keys, counts = added(parts)
                cuts = np.searchsorted(keys, np.arange(SLICES + 1, dtype=np.uint64) << np.uint64(32 - SLICE_BITS))
                for s in range(SLICES):
                    ks, n = keys[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]]
                    if len(ks):
                        cols = [pa.array([k], pa.int32()), pa.array([s], pa.int32())] + [pa.array([press(x.astype("<u4").tobytes())], pa.binary()) for x in (np.diff(ks, prepend=np.uint32(0)), n)]
                        yield pa.RecordBatch.from_arrays(cols, ["k", "s", "keys", "counts"])
                parts.clear()
            trim()

        size = 0
        for part in chunks(batches):
            for parts, c in zip(held, context_counts(TextBlock.from_arrow(part.column(0))), strict=True):
                parts.append(c)
                size += len(c[0])
            if size > 6_000_000:
                yield from send()
                size = 0
        if size:
            yield from send()

    return run


def _sum(alphabet: Alphabet):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        total = None
        for d, n in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            part = np.cumsum(np.frombuffer(expand(d), "<u4"), dtype=np.uint32), np.frombuffer(expand(n), "<u4").astype(np.int64)
            total = part if total is None else added([total, part])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([slice_odds(*total, alphabet).tobytes()], pa.binary())], ["k", "s", "odds"])

    return run


_OUT = "doc_id long, train boolean, n_tokens long, n_known long, logs double, score double, bits_per_byte double"


def _score(shared, buckets: int, n_train: int, n_tokens: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, freq: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _OUT.split(", ")]
        types = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]] for f in _OUT.split(", ")]
        out = [pa.table([pa.array([], t) for t in types], names)]
        if not texts.num_rows:
            return out[0]
        trim()
        model = shared.value
        hashes = [_unsix(x) for x in freq.column("hashes").to_pylist()]
        known = np.concatenate([np.zeros(0, np.uint64), *(_code(h, b) for b, h in zip(freq.column("bucket").to_pylist(), hashes, strict=True))])
        count = np.concatenate([np.zeros(0, np.int64), *(_unwide(x, len(h)) for x, h in zip(freq.column("counts").to_pylist(), hashes, strict=True))])
        known = pd.Index(known)
        if not known.is_unique:  # two words of one code
            first = ~known.duplicated()
            known, count = known[first], count[first]
        count = np.r_[count, 0]
        # texts of like lengths together: they are read in step
        texts = texts.take(np.argsort(pc.binary_length(texts.column("text")).to_numpy(), kind="stable"))
        for part in chunks(texts.combine_chunks().to_batches()):
            col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            block = TextBlock.from_arrow(col("text"))
            doc, h = _words(block.lowered())
            code = _code(h & _MASK, _bucket(h, buckets))
            c = count[known.get_indexer(code)]  # -1, the last one, where there is none
            n = np.bincount(doc, minlength=block.n) + 1
            logs = np.bincount(doc, weights=np.log10(c + 1.0), minlength=block.n) + math.log10(n_train + 1.0)
            has = np.bincount(doc[c > 0], minlength=block.n) + (n_train > 0)
            cost = model.cost(block, c / max(1, n_tokens))
            size = np.maximum(np.diff(block.offsets), 1)
            out.append(pa.table([col("doc_id"), col("train"), pa.array(n), pa.array(has), pa.array(logs), pa.array(-cost / _LN10), pa.array(cost / math.log(2) / size)], names))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Per row: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``; learns from rows where ``train``."""
    spark = docs.sparkSession
    n_rows, size = text_stats(docs)
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    grp = group_of(docs, n_rows, size, GROUP_BYTES)
    d = docs.select(grp.alias("grp"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.col("doc_id").cast("long"))

    freq = written(d.mapInArrow(_send(buckets), _SENT).groupBy("bucket").applyInArrow(_count, _FREQ), "counts")
    n_words, v_words = freq.filter("grp = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    seen = freq.filter("grp = -2").select("counts").collect()
    seen = np.frombuffer(seen[0].counts, "<i8") if seen else np.zeros(257, np.int64)
    n_train = int(seen[256])
    n, v = n_words + n_train, v_words + (n_train > 0)

    alphabet = Alphabet(seen)
    sums = d.filter("train").select("text").mapInArrow(_learn(), "k int, s int, keys binary, counts binary").groupBy("k", "s").applyInArrow(_sum(alphabet), "k int, s int, odds binary")
    tables = np.zeros((ORDERS, SLICES, IN_SLICE), np.int8)
    for r in sums.toLocalIterator():  # tables of fixed size
        tables[r.k, r.s] = np.frombuffer(r.odds, np.int8)
    tables = tables.reshape(ORDERS, -1)
    shared = spark.sparkContext.broadcast(Predictors(alphabet, tables))

    rows = d.groupBy("grp").cogroup(freq.filter("grp >= 0").groupBy("grp")).applyInArrow(_score(shared, buckets, n_train, n), _OUT)
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return rows.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "bits_per_byte")
