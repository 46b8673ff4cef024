"""Removal of repeated byte passages by blockwise suffix sorting with a difference cover.

``suffix_blocks`` sorts the suffixes of a text one bucket of leading bytes at a
time.  The suffixes at the positions of a difference cover (6 of every 31) are
ranked beforehand by prefix doubling; two suffixes that agree on their first 32
bytes have a cover position at one common distance, whose ranks order them, so
no tie is ever followed byte by byte and only one bucket is in memory.

``repeated_spans`` applies it to a corpus.  Each 50-byte window is named by its
anchor, the 20-gram of least hash in it, so equal windows share an anchor and
meet in one shard:

1. runs of windows with one anchor are compared between documents by hash of
   anchor and run; a run equal to one of a smaller ``doc_id`` is removed whole,
   a run whose anchor is unique is kept, and only runs that share an anchor
   with a different run go on (equal runs meet once per map task first, so a
   passage that very many documents hold costs each task one entry);
2. those runs are sent to shards by anchor, suffix-sorted there, and a window
   is removed if its 50 bytes start in a document with a smaller ``doc_id``.
   An anchor with more than ``HOT`` different runs is spread by window instead.

All runs of an exact copy equal those of the copy with the least ``doc_id``, so
copies are settled by the first comparison.  Matches never cross documents.  Hashes (at least 72 bits per decision) stand for runs and windows.

Defined results: a null text counts as empty; texts under 50 bytes are kept
whole; a row without ``doc_id`` neither loses anything nor makes others lose;
rows that repeat a ``doc_id`` do not remove each other; an empty table
gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, group_of, text_stats, written
from .textblock import TextBlock, chunks, mix, trim

MATCH, GRAM = 50, 20
#: Text bytes per bucket of anchors and per group of documents, bytes of runs per shard, runs an anchor may have in one shard.
BUCKET_BYTES, GROUP_BYTES, SHARD_BYTES, HOT = 14 << 20, 14 << 20, 1 << 20, 4096
#: Anchors a map task gathers before it sends them on.
GATHER = 700_000

# ---------------------------------------------------------------- suffix sorting

#: A perfect difference cover: every distance modulo 31 is a difference of two of these.
PERIOD, COVER = 31, np.array([0, 1, 3, 8, 12, 18])
_SHIFT = np.full((PERIOD, PERIOD), -1)
for _a in range(PERIOD):
    for _b in range(PERIOD):
        _SHIFT[_a, _b] = next(d for d in range(PERIOD) if (_a + d) % PERIOD in COVER and (_b + d) % PERIOD in COVER)


def _leading(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, big-endian, zeros after the end (32 + PERIOD positions more than the text)."""
    n = len(data) + 32 + PERIOD
    padded = np.zeros(n + 8, np.uint64)
    padded[: len(data)] = data
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= padded[j : j + n] << np.uint64(56 - 8 * j)
    return out


def _order32(lead: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first 32 bytes (a suffix that ends is the smaller), and marks where a new value begins."""
    keys = [np.minimum(n - at, 32), lead[at + 24], lead[at + 16], lead[at + 8], lead[at]]
    order = np.lexsort(keys)
    new = np.zeros(len(at), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def cover_ranks(data: np.ndarray, lead: np.ndarray, depth: int | None) -> np.ndarray:
    """Rank of the suffix at each cover position among those at cover positions, to ``depth`` bytes at least; -1 elsewhere."""
    n = len(data)
    rank = np.full(n + 2 * PERIOD + 2, -1, np.int64)
    at = np.flatnonzero(np.isin(np.arange(min(n, PERIOD)), COVER))
    at = (at[None, :] + np.arange(0, n, PERIOD)[:, None]).ravel()
    at = at[at < n]
    if not len(at):
        return rank
    order, new = _order32(lead, at, n)
    step = PERIOD
    while True:
        value = np.cumsum(new) - 1
        at = at[order]
        rank[at] = value
        if value[-1] == len(at) - 1 or step >= n or (depth is not None and step >= depth):
            return rank
        after = np.where(at + step < n, rank[np.minimum(at + step, n)], -1)
        own = rank[at]
        order = np.lexsort((after, own))
        own, after = own[order], after[order]
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        step *= 2


def _settle(pos: np.ndarray, new: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order suffixes that agree on 32 bytes by cover ranks: three-way quicksort of all runs of ties at once."""
    pos = pos.copy()
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    active = np.flatnonzero(size[run] > 1)
    run = run[active]
    while len(active):
        p = pos[active]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        length = np.diff(np.r_[first, len(run)])
        pivot = np.repeat(p[first + length // 2], length)
        d = _SHIFT[p % PERIOD, pivot % PERIOD]
        side = np.sign(rank[p + d] - rank[pivot + d]).astype(np.int8)
        key = np.repeat(np.arange(len(first)) * 3, length) + side + 1
        order = np.argsort(key, kind="stable")
        pos[active] = p[order]
        key = key[order]
        begin = np.r_[True, key[1:] != key[:-1]]
        run = np.cumsum(begin) - 1
        go = (np.bincount(run)[run] > 1) & (key % 3 != 1)
        active, run = active[go], run[go]
    return pos


def suffix_blocks(data: np.ndarray, wanted: np.ndarray | None = None, depth: int | None = None, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """Positions ``wanted`` in suffix order, a bucket of leading bytes at a time; with ``depth``, suffixes may stay unordered that agree on so many bytes."""
    n = len(data)
    wanted = np.arange(n) if wanted is None else wanted
    lead = _leading(data)
    rank = cover_ranks(data, lead, depth)
    two = (lead[wanted] >> np.uint64(48)).astype(np.uint16)
    by = np.argsort(two, kind="stable")
    ends = np.cumsum(np.bincount(two, minlength=1 << 16))
    at = 0
    while at < len(wanted):
        to = int(ends[max(np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + most, "right") - 1)])
        bucket = wanted[by[at:to]]
        order, new = _order32(lead, bucket, n)
        yield _settle(bucket[order], new, rank)
        at = to


def suffix_array(data: bytes) -> np.ndarray:
    blocks = list(suffix_blocks(np.frombuffer(data, np.uint8)))
    return np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


def repeated_windows(data: np.ndarray, at: np.ndarray, doc: np.ndarray, match: int = MATCH) -> np.ndarray:
    """Marks each window position whose ``match`` bytes also stand at a window of a smaller document number."""
    owner = np.zeros(len(data) + 1, np.int64)
    owner[at] = doc
    out = np.zeros(len(data) + 1, bool)
    lead = _leading(data)
    steps = [*range(0, match - 7, 8), match - 8] if match >= 8 else []
    for pos in suffix_blocks(data, at, match):
        new = np.zeros(len(pos), bool)
        new[:1] = True
        for s in steps:
            k = lead[pos + s]
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(owner[pos], first)
        out[pos[owner[pos] > np.repeat(least, np.diff(np.r_[first, len(pos)]))]] = True
    return out[at]


# ---------------------------------------------------------------- anchors


def window_runs(block: TextBlock, match: int = MATCH, gram: int = GRAM):
    """Runs of windows with one anchor: text, first window, last window, hash of the anchor, hash of the run's bytes."""
    lens = np.maximum(np.diff(block.offsets) - match + 1, 0)
    total = int(lens.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    h = block.rolling(gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = match - gram + 1
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    doc = np.repeat(np.arange(block.n), lens)
    s = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens) + block.offsets[doc]
    anchor = (key[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], total] - 1
    s0, s1 = s[first], s[last]
    return doc[first], s0, s1, mix(h[anchor[first]] ^ np.uint64(0x5851F42D4C957F2D)), block.hash_ranges(s0, s1 + match)


def _ordinals(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, the sorted keys, and each element's place among those of its key (in that order)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return order, k, np.arange(len(k)) - np.repeat(first, np.diff(np.r_[first, len(k)]))


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: row i holds the bytes of the next counts[i] values."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.dtype.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _ones(which: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(which, minlength=n)


_FOUND = "grp int, bucket int, docs binary, tags binary, n_same binary, n_near binary, n_hot binary, same binary, near binary, hot binary"


def _found(doc_id, tag, grp, bucket: int, doc, ordinal, same, near, hot) -> pa.Table:
    """A row per group of documents: their ids and the ordinals of their runs of each kind."""
    n = len(doc_id)
    counts = [_ones(doc[m], n) for m in (same, near, hot)]
    has = np.flatnonzero(counts[0] + counts[1] + counts[2])
    order = has[np.argsort(grp[has], kind="stable")]
    place = np.full(n, -1)
    place[order] = np.arange(len(order))
    groups, per = np.unique(grp[order], return_counts=True)
    row = np.repeat(np.arange(len(groups)), per)
    ords, totals = [], []
    for m, c in zip((same, near, hot), counts, strict=True):
        o = np.argsort(place[doc[m]], kind="stable")
        ords.append(ordinal[m][o].astype("<u4"))
        totals.append(np.bincount(row, weights=c[order], minlength=len(groups)).astype(np.int64))
    cols = [pa.array(groups.astype(np.int32)), pa.array(np.full(len(groups), bucket, np.int32)), _packed(doc_id[order].astype("<i8"), per), _packed(tag[order].astype("<i8"), per)]
    cols += [_packed(c[order].astype("<u4"), per) for c in counts] + [_packed(v, t) for v, t in zip(ords, totals, strict=True)]
    return pa.table(cols, [f.split()[0] for f in _FOUND.split(", ")])


def _five(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 3:].copy()


_SENT = "bucket int, here boolean, docs binary, tags binary, grps binary, counts binary, places binary, grams binary, runs binary"


def _send(buckets: int):
    """Pass 1, a map over texts: a row per bucket with anchors, and one (``here``) with runs equal to one of a smaller document of this task."""
    names = [f.split()[0] for f in _SENT.split(", ")]

    def rows(heads, parts):
        doc, g, r = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, tags, grps = (np.concatenate(x) for x in zip(*heads, strict=True))
        by_bucket = (g >> np.uint64(32)) % np.uint64(buckets)
        order, k, place = _ordinals(by_bucket.astype(np.int64) * len(ids) + doc)
        doc, g, r, which = doc[order], g[order] & np.uint64(0xFFFFFFFF), r[order], k // len(ids)
        o = np.lexsort((ids[doc], r, g, which))
        new = np.r_[True, (which[o][1:] != which[o][:-1]) | (g[o][1:] != g[o][:-1]) | (r[o][1:] != r[o][:-1])]
        first = np.flatnonzero(new)
        least = np.repeat(ids[doc[o][first]], np.diff(np.r_[first, len(o)]))
        same = np.zeros(len(o), bool)
        same[o] = ids[doc[o]] > least
        cuts = np.searchsorted(which, np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            for here in (True, False):
                pick = np.flatnonzero(same[lo:hi] == here) + lo
                if not len(pick):
                    continue
                u, count = np.unique(doc[pick], return_counts=True)
                blob = [ids[u].astype("<i8"), tags[u].astype("<i8"), grps[u].astype("<i4"), count.astype("<u4"), place[pick].astype("<u4")]
                blob += [np.zeros(0, np.uint8)] * 2 if here else [g[pick].astype("<u4"), _five(r[pick])]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([here]), *(pa.array([x.tobytes()], pa.binary()) for x in blob)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, parts, held, docs = [], [], 0, 0
        for part in chunks(batches):
            block = TextBlock.from_arrow(part.column(3))
            doc, _, _, g, r = window_runs(block)
            if not len(doc):
                continue
            heads.append(tuple(part.column(i).to_numpy() for i in range(3)))
            parts.append((doc + docs, g, r))
            docs += block.n
            held += len(doc)
            if held > GATHER:
                yield from rows(heads, parts)
                heads, parts, held, docs = [], [], 0, 0
                trim()
        if parts:
            yield from rows(heads, parts)

    return run


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pass 1, in a bucket: which runs equal one of a smaller document, and which share their anchor with a different run."""
    trim()
    bucket = int(key[0].as_py())
    here = np.array(table.column("here").to_pylist(), bool)
    out = []
    for local in (True, False):
        t = table.filter(pa.array(here == local))
        if not t.num_rows:
            continue
        get = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)  # noqa: B023, E731
        ids, tags, grps, counts, place = get("docs", "<i8"), get("tags", "<i8"), get("grps", "<i4"), get("counts", "<u4"), get("places", "<u4")
        doc = np.repeat(np.arange(len(ids)), counts)
        same, near, hot = (np.zeros(len(doc), bool) for _ in range(3))
        if local:
            same[:] = True
        else:
            g, five = get("grams", "<u4"), get("runs", np.uint8).reshape(-1, 5)
            r = np.zeros((len(five), 8), np.uint8)
            r[:, :5] = five
            r = r.view("<u8").ravel()
            own = ids[doc]
            o = np.lexsort((own, r, g))
            go, ro, do = g[o], r[o], own[o]
            new_g = np.r_[True, go[1:] != go[:-1]]
            new_r = new_g | np.r_[True, ro[1:] != ro[:-1]]
            first = np.flatnonzero(new_r)
            least = np.repeat(do[first], np.diff(np.r_[first, len(o)]))
            same[o] = do > least
            # by anchor: different runs, and different documents among the runs' first ones
            gs = np.flatnonzero(new_g)
            per = np.diff(np.r_[gs, len(o)])
            kinds = np.add.reduceat(new_r.astype(np.int64), gs)
            open_g = (kinds > 1) & (np.minimum.reduceat(least, gs) < np.maximum.reduceat(least, gs))
            near[o] = (do <= least) & np.repeat(open_g & (kinds <= HOT), per)
            hot[o] = (do <= least) & np.repeat(open_g & (kinds > HOT), per)
        out.append(_found(ids, tags, grps, bucket, doc, place, same, near, hot))
    return pa.concat_tables(out)


# ---------------------------------------------------------------- spans


def _merged(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges per text (ranges of different texts do not overlap): maximal runs."""
    if not len(start):
        return start, end, doc
    o = np.lexsort((start, doc))
    start, end, doc = start[o], end[o], doc[o]
    reach = np.maximum.accumulate(end)
    new = np.r_[True, (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    return start[first], reach[np.r_[first[1:], len(start)] - 1], doc[first]


def _cut(text: bytes, start: list[int], end: list[int]) -> tuple[int, int, str, str]:
    """Removed bytes, spans, hash of what is kept, and that as text (without bytes of characters that were cut apart)."""
    kept = b"".join([text[a:b] for a, b in zip([0, *end], [*start, len(text)], strict=True)])
    return sum(end) - sum(start), len(start), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")


_SPLIT = "kind int, doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string, kept string, ranges binary, body binary, shard int, docs binary, tags binary, starts binary, lens binary, bytes binary"
_SPLIT_NAMES = [f.split()[0] for f in _SPLIT.split(", ")]
_SPLIT_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in _SPLIT.split(", ")]


def _rows(n: int, row_type=None, **cols) -> pa.RecordBatch:
    names, types = list(_SPLIT_NAMES), list(_SPLIT_TYPES)
    if row_type is not None:
        names.append("row")
        types.append(row_type)
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols and not isinstance(cols[c], pa.Array) else cols.get(c) if c in cols else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)


def _split(buckets: int, shards: int, texts_too: bool):
    """Pass 2, a group of texts with what pass 1 found: finished documents (kind 0), open ones (1), runs for the shards (2).

    With ``texts_too`` every text comes out again, with its ``row`` of other columns; else those in which something was found.
    """

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, found: pa.Table) -> pa.Table:
        trim()
        out = []
        row_type = texts.schema.field("row").type if texts_too else None
        schema = pa.schema(list(zip(_SPLIT_NAMES, _SPLIT_TYPES, strict=True)) + ([("row", row_type)] if texts_too else []))
        if not texts.num_rows or not (found.num_rows or texts_too):
            return schema.empty_table()
        squeeze = zstandard.ZstdCompressor(3).compress
        rows, again = {}, {}
        for i, name in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("tag").to_pylist(), strict=True)):
            if rows.setdefault(name, i) != i:
                again.setdefault(name, []).append(i)
        get = lambda c, kind: np.frombuffer(b"".join(found.column(c).to_pylist()), kind)
        names = list(zip(get("docs", "<i8").tolist(), get("tags", "<i8").tolist(), strict=True))
        row = np.array([rows.get(n, -1) for n in names], dtype=np.int64)
        more = [(j, i) for j, n in enumerate(names) if n in again for i in again[n]] if again and texts_too else []
        bucket = np.repeat(found.column("bucket").to_numpy(), [len(x) // 8 for x in found.column("docs").to_pylist()]).astype(np.int64)
        listed = []
        for c in ("same", "near", "hot"):
            counts = get(f"n_{c}", "<u4").astype(np.int64)
            ends = np.cumsum(counts)
            r, b, at = np.repeat(row, counts), np.repeat(bucket, counts), get(c, "<u4").astype(np.int64)
            if more:  # repeated rows get what their first one got
                r = np.concatenate([r, *(np.full(counts[j], i) for j, i in more)])
                b = np.concatenate([b, *(np.full(counts[j], bucket[j]) for j, _ in more)])
                at = np.concatenate([at, *(at[ends[j] - counts[j] : ends[j]] for j, _ in more)])
            o = np.argsort(r, kind="stable")
            listed.append((r[o], b[o], at[o]))
        if not texts_too:
            touched = np.unique(row[row >= 0])
            texts = texts.take(pa.array(touched))
            new_row = np.full(int(touched.max(initial=-1)) + 2, -1)
            new_row[touched] = np.arange(len(touched))
            listed = [(np.where(r >= 0, new_row[np.maximum(r, 0)], -1), b, at) for r, b, at in listed]
        texts = texts.combine_chunks()
        done_rows = 0
        for part in chunks(texts.to_batches()):
            block = TextBlock.from_arrow(part.column(part.schema.get_field_index("text")))
            ids, tags = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "tag"))
            doc, s0, s1, g, _ = window_runs(block)
            order, k, _ = _ordinals(doc * buckets + ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
            marks = []
            for r, b, at in listed:
                lo, hi = np.searchsorted(r, [done_rows, done_rows + block.n])
                mark = np.zeros(len(doc), bool)
                mark[order[np.searchsorted(k, (r[lo:hi] - done_rows) * buckets + b[lo:hi]) + at[lo:hi]]] = True
                marks.append(mark)
            done_rows += block.n
            same, near, hot = marks
            start, end, of = s0[same], s1[same] + MATCH, doc[same]
            segments = [(doc[near], s0[near], s1[near] + MATCH, g[near])]
            if hot.any():  # each window by itself; equal ones of this batch once, for the smallest document
                n = s1[hot] - s0[hot] + 1
                w = np.repeat(s0[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                d = np.repeat(doc[hot], n)
                hw = block.hash_ranges(w, w + MATCH)
                o = np.lexsort((ids[d], hw))
                w, d, hw = w[o], d[o], hw[o]
                first = np.flatnonzero(np.r_[True, hw[1:] != hw[:-1]])
                later = ids[d] > np.repeat(ids[d[first]], np.diff(np.r_[first, len(w)]))
                start, end, of = np.r_[start, w[later]], np.r_[end, w[later] + MATCH], np.r_[of, d[later]]
                segments.append((d[~later], w[~later], w[~later] + MATCH, hw[~later]))
            start, end, of = _merged(start, end, of)
            d, a, b, h = (np.concatenate(x) for x in zip(*segments, strict=True))
            open_ = np.bincount(d, minlength=block.n) > 0
            base = block.offsets
            cuts = np.searchsorted(of, np.arange(block.n + 1))
            raw = block.data.tobytes()
            done, wait, done_at, wait_at = [], [], [], []
            others = lambda at: {"row_type": row_type, "row": part.column(part.schema.get_field_index("row")).take(pa.array(at))} if texts_too else {}  # noqa: B023, E731
            for i in range(block.n):
                lo, hi = cuts[i], cuts[i + 1]
                if open_[i]:
                    wait_at.append(i)
                    wait.append((ids[i], tags[i], np.stack([start[lo:hi], end[lo:hi]], 1).astype("<i8") - base[i], squeeze(raw[base[i] : base[i + 1]])))
                else:
                    done_at.append(i)
                    done.append((ids[i], tags[i], *_cut(raw[base[i] : base[i + 1]], (start[lo:hi] - base[i]).tolist(), (end[lo:hi] - base[i]).tolist())))
            if done:
                x = list(zip(*done, strict=True))
                out.append(_rows(len(done), kind=[0] * len(done), doc_id=x[0], tag=x[1], n_removed=x[2], n_spans=x[3], kept_sha256=x[4], **({"kept": x[5]} if texts_too else {}), **others(done_at)))
            if wait:
                x = list(zip(*wait, strict=True))
                out.append(_rows(len(wait), kind=[1] * len(wait), doc_id=x[0], tag=x[1], ranges=[r.tobytes() for r in x[2]], body=x[3], **others(wait_at)))
            if len(d):
                shard = (mix(h) % np.uint64(shards)).astype(np.int64)
                o = np.argsort(shard, kind="stable")
                d, a, b, shard = d[o], a[o], b[o], shard[o]
                u, first = np.unique(shard, return_index=True)
                parts = [slice(x, y) for x, y in zip(first, np.r_[first[1:], len(shard)], strict=True)]
                out.append(_rows(
                    len(u),
                    row_type,
                    kind=[2] * len(u),
                    shard=u,
                    docs=[ids[d[p]].astype("<i8").tobytes() for p in parts],
                    tags=[tags[d[p]].astype("<i8").tobytes() for p in parts],
                    starts=[(a[p] - base[d[p]]).astype("<i8").tobytes() for p in parts],
                    lens=[(b[p] - a[p]).astype("<u4").tobytes() for p in parts],
                    bytes=[b"".join([raw[x:y] for x, y in zip(a[p], b[p], strict=True)]) for p in parts],
                ))

        return pa.Table.from_batches(out, schema)

    return run


def _sort_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Suffix-sort the runs of a shard; ranges to remove, per document."""
    trim()
    get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    ids, tags, starts, lens, data = get("docs", "<i8"), get("tags", "<i8"), get("starts", "<i8"), get("lens", "<u4").astype(np.int64), get("bytes", np.uint8)
    base = np.cumsum(lens) - lens
    n = lens - MATCH + 1
    seg = np.repeat(np.arange(len(ids)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[seg]
    hit = repeated_windows(data, at, ids[seg])
    seg, at = seg[hit], at[hit]
    a = starts[seg] + at - base[seg]
    o = np.lexsort((tags[seg], ids[seg]))
    seg, a = seg[o], a[o]
    i, t = ids[seg], tags[seg]
    first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])]) if len(i) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(i)]))
    s, e, owner = _merged(a, a + MATCH, group) if len(a) else (a, a, group)
    # _merged takes ranges of different texts as apart, so give each text its own stretch
    if len(a):
        wide = int(a.max()) + 2 * MATCH
        s, e, owner = _merged(a + group * wide, a + MATCH + group * wide, group)
        s, e = s - owner * wide, e - owner * wide
    pairs = np.stack([s, e], 1).astype("<i8")
    blob = _packed(pairs.ravel(), 2 * np.bincount(owner, minlength=len(first)))
    return pa.table({"doc_id": pa.array(i[first]), "tag": pa.array(t[first]), "more": blob})


_RESULT = "doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _finish(texts_too: bool):
    """Open documents with the ranges from all shards."""
    names = [f.split()[0] for f in _RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for part in batches:
            out = []
            for i, t, ranges, body, more in zip(*(part.column(c).to_pylist() for c in range(5)), strict=True):
                pairs = np.frombuffer(b"".join([ranges, *(more or [])]), "<i8").reshape(-1, 2)
                s, e, _ = _merged(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
                *found, kept = _cut(expand(body), s.tolist(), e.tolist())
                out.append((i, t, *found, kept if texts_too else None))
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols + ([part.column(5)] if texts_too else []), names + ["row"] * texts_too)

    return run


def _results(docs: DataFrame, texts_too: bool) -> DataFrame:
    """``doc_id, tag, n_removed, n_spans, kept_sha256, kept[, row]``: of the texts in which something was found, or of all rows with an id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_rows, size = text_stats(docs)
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    grp = group_of(docs, n_rows, size, GROUP_BYTES)
    own = [F.col("doc_id").cast("long"), _tag(text).alias("tag"), grp.alias("grp"), text.alias("text")]
    has = docs.filter("doc_id is not null")
    d = has.select(*own)
    found = written(d.mapInArrow(_send(buckets), _SENT).groupBy("bucket").applyInArrow(_meet, _FOUND), "runs")

    n_near, n_hot = found.agg(F.coalesce(F.sum(F.length("near")), F.lit(0)), F.coalesce(F.sum(F.length("hot")), F.lit(0))).first()
    shards = max(1, math.ceil((n_near / 4 * 70 + n_hot / 4 * 16 * MATCH) / SHARD_BYTES))
    extra = ["row"] if texts_too else []
    schema, result = _SPLIT, _RESULT
    if texts_too:
        others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
        d = has.select(*own, others.alias("row"))
        kind = d.schema["row"].dataType.simpleString()
        schema, result = f"{_SPLIT}, row {kind}", f"{_RESULT}, row {kind}"
    split = written(d.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_split(buckets, shards, texts_too), schema), "windows")
    drop(found)

    more = split.filter("kind = 2").select("shard", "docs", "tags", "starts", "lens", "bytes").groupBy("shard").applyInArrow(_sort_shard, "doc_id long, tag long, more binary")
    more = more.groupBy("doc_id", "tag").agg(F.collect_list("more").alias("more"))
    late = split.filter("kind = 1").select("doc_id", "tag", "ranges", "body", *extra).join(more, ["doc_id", "tag"], "left").select("doc_id", "tag", "ranges", "body", "more", *extra)
    done = split.filter("kind = 0").select("doc_id", "tag", "n_removed", "n_spans", "kept_sha256", "kept", *extra)
    return done.unionByName(late.mapInArrow(_finish(texts_too), result))


def _tag(text):
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(text.cast("binary"), F.octet_length(text))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long"), _tag(text).alias("tag"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole_sha"))
    done = _results(docs, texts_too=False).select("doc_id", "tag", F.col("n_removed").alias("cut"), F.col("n_spans").alias("spans"), F.col("kept_sha256").alias("sha"))
    done = done.dropDuplicates(["doc_id", "tag"])  # repeated rows may lie in different groups
    zero = F.lit(0).cast("long")
    return whole.join(done, ["doc_id", "tag"], "left").select("doc_id", "n_bytes", F.coalesce("cut", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the repeated spans cut out of ``text`` (a null text becomes empty).

    A cut may split a character; its left-over bytes are dropped with it.  Rows travel once, with their texts.
    """
    out = _results(docs, texts_too=True)
    cols = [F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols).unionByName(docs.filter("doc_id is null"))
