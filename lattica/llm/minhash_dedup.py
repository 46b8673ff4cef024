"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's vector holds its five-word shingles (all its words, if fewer) weighted
``tf * idf`` with the damped ``idf = 1 + DAMP * log(N / df) / log(N)``.  Thirty
consistent weighted samples in ten bands of three propose pairs, and a pair is
linked if its weighted Jaccard similarity, computed from the vectors, is at
least the threshold.  Classes are the connected components.

Document frequencies are exact: every map task sends each shingle hash once per
group of documents, buckets of hashes add up, and only frequencies above one go
back to the groups.  A shingle of frequency one is shared with nobody, so a
text whose other shingles hold less than ``threshold`` of its weight can have
no partner and is neither sampled nor compared; vectors leave such shingles
out but count their weight.

Exact copies count as links of the first copy and are not compared.  Two texts
that share a band bucket and reach the threshold always end in one class,
without all pairs of the bucket: its members are compared with a leader (the
least id in even bands, the least hashed id in odd ones), and one minus the
weighted Jaccard similarity is a metric.  A member further than twice
``1 - threshold`` from the leader is therefore similar to none that is linked to
it, and one that is nearer but not linked only to those linked ones whose
distance from the leader is within ``1 - threshold`` of its own.  It is compared
with these unless it is in the leader's class by then, or the two cannot share
enough: their weights in each of ``SHARES`` parts of all shingles bound that.  Members that are not
linked choose a leader among themselves, in ``ROUNDS`` rounds, each linear in the
members.  What is then left of a bucket is compared pair by pair up to ``FAN``
members; larger remainders are split by the members' rarest shingles (of two
texts with the threshold's similarity, the rarest shingles that make up
``1 - threshold`` of each one's weight have one in common), and the parts get
leader rounds of their own and are then finished pair by pair.

Documents are dealt to groups by their place in the files, so a shingle that
all texts have is told once per group of some megabytes, not once per text.

Defined results: a null or empty text is a duplicate of other such texts only;
rows that share a ``doc_id`` share a class, whose
texts are all compared (ids lie below 2**62); rows without one have none; an empty table gives no rows; extra
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, group_of, text_stats, written
from .textblock import TextBlock, chunks, local_groups, mix, order_in_cells, trim, windows

WIDTH, BANDS, ROWS, DAMP, ROUNDS = 5, 10, 3, 0.1, 3
#: Members left after the leader rounds up to which a bucket is not split; parts in which rows of one text are dealt.
FAN, SALTS = 128, 8
#: Links that are united on the driver (16 bytes each); more are united in rounds of joins.
HERE = 200_000
#: Parts of all shingles for which texts' weights are kept apart (a power of two).
SHARES = 32
#: Text bytes per bucket of hashes and per group of documents; shingles a map task gathers before it sends.
BUCKET_BYTES, GROUP_BYTES, GATHER = 10 << 20, 14 << 20, 1_000_000

# ---------------------------------------------------------------- shingles and samples


def shingles(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle hash and count of every distinct shingle of every text, ordered by text and hash."""
    start, end, first = block.words()
    words = block.word_hashes()
    n = np.diff(first)
    h, at = windows(words, first, WIDTH)
    doc = np.repeat(np.arange(block.n), n)[at]
    few = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(few):
        own = np.array([mix(np.uint64(len(w)) + np.bitwise_xor.reduce(mix(w + np.arange(len(w), dtype=np.uint64)))) for w in (words[first[i] : first[i + 1]] for i in few)], np.uint64)
        doc, h = np.r_[doc, few], np.r_[h, own]
    o = order_in_cells(doc, h)
    doc, h = doc[o], h[o]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.r_[new, len(h)])


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Mid-quantiles of the Gamma(2, 1) distribution."""
    u = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 50.0)
    for _ in range(60):
        x = (lo + hi) / 2
        low = 1 - (1 + x) * np.exp(-x) < u
        lo, hi = np.where(low, x, lo), np.where(low, hi, x)
    return hi


_R = _gamma_quantiles().astype(np.float32)
_LOG_C = np.log(_gamma_quantiles()).astype(np.float32)
_BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted samples (Ioffe 2010): per text and function, a hash of the sampled (element, level); texts without elements get their number."""
    out = np.tile(mix(np.arange(n, dtype=np.uint64))[:, None], (1, len(_SEEDS)))
    if not len(doc):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[first, len(doc)])
    log_w = np.log(weight).astype(np.float32)
    for k, seed in enumerate(_SEEDS):
        draw = mix(h ^ seed).view(np.uint16).reshape(-1, 4)
        r, beta = _R[draw[:, 0]], _BETA[draw[:, 2]]
        level = np.floor(log_w / r + beta)
        log_a = _LOG_C[draw[:, 1]] - r * (level - beta) - r
        least = np.minimum.reduceat(log_a, first)
        hit = np.flatnonzero(log_a == np.repeat(least, length))
        who = doc[hit]
        hit = hit[np.r_[True, who[1:] != who[:-1]]]
        out[doc[hit], k] = mix(h[hit] ^ (level[hit].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    s = sampled.reshape(len(sampled), BANDS, ROWS)
    out = np.zeros(s.shape[:2], np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return mix(out + np.arange(BANDS, dtype=np.uint64))


def weighted_jaccard(a: bytes, total_a: float, b: bytes, total_b: float) -> float:
    """From vectors (4-byte hashes ascending, then 4-byte weights) and whole weights."""
    n, m = len(a) // 8, len(b) // 8
    ha, wa = np.frombuffer(a, "<u4", n), np.frombuffer(a, "<f4", n, 4 * n)
    hb, wb = np.frombuffer(b, "<u4", m), np.frombuffer(b, "<f4", m, 4 * m)
    if not n or not m:
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), m - 1)
    same = hb[at] == ha
    shared = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return shared / (total_a + total_b - shared)


def rare(doc: np.ndarray, h: np.ndarray, df: np.ndarray, weight: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of each text's rarest shingles, by text: those from which on, by (df, hash), at least ``threshold`` of its whole weight follows.

    The rest weighs less than two texts of that similarity share, so they have one of these in common.
    """
    o = np.lexsort((h, df, doc))
    upto = np.cumsum(weight[o])
    ends = np.searchsorted(doc[o], doc[o], "right") - 1
    return o[upto[ends] - upto + weight[o] >= threshold * total[doc[o]] * (1 - 1e-6)]


# ---------------------------------------------------------------- document frequencies

_MASK = np.uint64((1 << 40) - 1)


def _five(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


_SENT = "bucket int, grps binary, sizes binary, hashes binary, counts binary"


def _send(buckets: int):
    """Map over texts: per bucket and group of documents, each shingle once with its number of texts in the task."""

    def rows(names_of, grp, h):
        b = _bucket(h, buckets)
        o = order_in_cells(b * len(names_of) + grp, h)
        b, grp, h = b[o], grp[o], h[o]
        new = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (grp[1:] != grp[:-1]) | (h[1:] != h[:-1])])
        counts = np.diff(np.r_[new, len(h)])
        b, grp, h = b[new], grp[new], h[new] & _MASK
        cuts = np.searchsorted(b, np.arange(buckets + 1))
        for i in range(buckets):
            lo, hi = cuts[i], cuts[i + 1]
            if lo < hi:
                part = grp[lo:hi]  # ascending
                at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                u, size = part[at], np.diff(np.r_[at, len(part)])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in (names_of[u].astype("<i4").tobytes(), size.astype("<u4").tobytes(), _five(h[lo:hi]), counts[lo:hi].astype("<u4").tobytes()))], [f.split()[0] for f in _SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, met = [], 0, {}
        for part in chunks(batches):
            doc, h, _ = shingles(TextBlock.from_arrow(part.column(1)))
            if not len(h):
                continue
            parts.append((local_groups(part.column(0), met)[doc], h))
            held += len(h)
            if held > GATHER:
                yield from rows(np.array(list(met)), *(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts, held, met = [], 0, {}
                trim()
        if parts:
            yield from rows(np.array(list(met)), *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


_FREQ = "grp int, bucket int, hashes binary, df binary"


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """In a bucket: per group of documents, its shingles that more than one text has, and their frequencies."""
    trim()
    get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    grp = np.repeat(get("grps", "<i4"), get("sizes", "<u4"))
    h, n = _unfive(b"".join(table.column("hashes").to_pylist())), get("counts", "<u4").astype(np.int64)
    o = np.argsort(h, kind="stable")
    h, grp, n = h[o], grp[o], n[o]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    df = np.repeat(np.add.reduceat(n, new), np.diff(np.r_[new, len(h)]))
    more = df > 1
    h, grp, df = h[more], grp[more], df[more]
    o = np.argsort(grp, kind="stable")
    h, grp, df = h[o], grp[o], df[o]
    u, first = np.unique(grp, return_index=True)
    ends = np.r_[first[1:], len(grp)]
    return pa.table([pa.array(u.astype(np.int32)), pa.array(np.full(len(u), key[0].as_py(), np.int32)), pa.array([_five(h[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([np.minimum(df[a:b], 2**32 - 1).astype("<u4").tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], [f.split()[0] for f in _FREQ.split(", ")])


_VECTOR = "doc_id long, total double, shares array<float>, vec binary, keys array<long>, rare array<int>"


def _vectors(buckets: int, n_docs: int, threshold: float):
    """A group of texts with its frequencies: vectors and band keys of those texts that can have a partner."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, freq: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.list_(pa.float32())), pa.array([], pa.binary()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))], [f.split()[0] for f in _VECTOR.split(", ")])
        if not texts.num_rows or not freq.num_rows:
            return none
        known = np.concatenate([_unfive(x) | np.uint64(b) << np.uint64(40) for b, x in zip(freq.column("bucket").to_pylist(), freq.column("hashes").to_pylist(), strict=True)])
        df = np.frombuffer(b"".join(freq.column("df").to_pylist()), "<u4")
        o = np.argsort(known)
        known, df = known[o], df[o]
        trim()
        top = math.log(max(n_docs, 2))
        alone = 1 + DAMP * math.log(max(n_docs, 1)) / top
        out = [none]
        for part in chunks(texts.to_batches()):
            ids = part.column(part.schema.get_field_index("doc_id")).to_numpy()
            block = TextBlock.from_arrow(part.column(part.schema.get_field_index("text")))
            doc, h, tf = shingles(block)
            if not len(h):
                continue
            code = (h & _MASK) | _bucket(h, buckets).astype(np.uint64) << np.uint64(40)
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            held = known[at] == code
            idf = np.where(held, 1 + DAMP * np.log(np.maximum(n_docs / df[at], 1)) / top, alone)
            w = tf * idf
            total = np.bincount(doc, weights=w, minlength=block.n)
            common = np.bincount(doc, weights=w * held, minlength=block.n)
            may = (common >= threshold * total * (1 - 1e-9)) & (total > 0)
            take = may[doc]
            keys = band_keys(samples(doc[take], h[take], w[take], block.n))
            take &= held
            d, v, x = doc[take], (h[take] >> np.uint64(32)).astype("<u4"), w[take].astype("<f4")
            shares = np.bincount(d * SHARES + (h[take] & np.uint64(SHARES - 1)).astype(np.int64), weights=w[take], minlength=block.n * SHARES).reshape(-1, SHARES).astype(np.float32)
            r = rare(d, h[take], df[at[take]], w[take], total, threshold)
            r_cuts = np.searchsorted(d[r], np.arange(block.n + 1))
            r = v[r].view(np.int32)
            o = np.lexsort((v, d))
            d, v, x = d[o], v[o], x[o]
            cuts = np.searchsorted(d, np.arange(block.n + 1))
            who = np.flatnonzero(may)
            out.append(pa.table([pa.array(ids[who]), pa.array(total[who]), pa.array(list(shares[who]), pa.list_(pa.float32())), pa.array([v[cuts[i] : cuts[i + 1]].tobytes() + x[cuts[i] : cuts[i + 1]].tobytes() for i in who], pa.binary()), pa.array(list(keys[who].view(np.int64)), pa.list_(pa.int64())), pa.array([r[r_cuts[i] : r_cuts[i + 1]] for i in who], pa.list_(pa.int32()))], none.column_names))
        return pa.concat_tables(out)

    return run


# ---------------------------------------------------------------- links


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("vec", "total", "l_vec", "l_total")), strict=True)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("leader"), pa.array([weighted_jaccard(*r) for r in rows], pa.float64())], ["doc_id", "leader", "similarity"])


def verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``doc_id, leader, similarity`` of distinct pairs."""
    own = pairs.select("doc_id", "leader").distinct().join(vectors.select("doc_id", "total", "vec"), "doc_id")
    lead = vectors.select(F.col("doc_id").alias("leader"), F.col("total").alias("l_total"), F.col("vec").alias("l_vec"))
    return own.join(lead, "leader").select("doc_id", "leader", "vec", "total", "l_vec", "l_total").mapInArrow(_similar, "doc_id long, leader long, similarity double")


def can_reach(threshold: float, total: str, shares: str, other_total: str, other_shares: str) -> Column:
    """Whether two texts can have the similarity: in each of the SHARES parts of all shingles they share no more than either one's weight there of those that more than one text has."""
    most = F.aggregate(F.zip_with(shares, other_shares, lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y)
    return (1 + SLACK) * most >= threshold * (F.col(total) + F.col(other_total) - most)


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in ``a`` and ``b``, ascending, and the least id of each one's component."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        # labels of labels learn too, so that a chain takes few rounds
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """``doc_id, class_id`` (least id of the component) for the ids in ``edges(a, b)``.

    Up to ``HERE`` edges are united on the driver; more: neighbours' least label, then the label's label, until nothing changes.
    """
    once = written(edges.select("a", "b"), "edges")
    if once.count() <= HERE:
        t = once.toArrow()
        ids, least = components_of(*(t.column(c).to_numpy().astype(np.int64) for c in "ab"))
        return written(edges.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids), "class_id": pa.array(least)}), "doc_id long, class_id long").coalesce(1), "labels")
    both = written(once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        after = written(step.join(jump, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"), "old"), "labels")
        labels = after.select("id", "label")
        if not after.filter("label <> old").limit(1).count():
            return labels.select(F.col("id").alias("doc_id"), F.col("label").alias("class_id"))


#: Rounding of similarities from four-byte weights.
SLACK = 1e-5


def leaders(open_: DataFrame, vectors: DataFrame, threshold: float) -> tuple[list[DataFrame], DataFrame | None]:
    """``ROUNDS`` rounds of leaders in the cells of ``open_(doc_id, band, key)``.

    Of each round, members' similarities to their leaders (``doc_id, leader, similarity``, each pair once); and the
    members that are still open (``doc_id, band, key``), if there can be any.
    """
    compared = []
    for turn in range(ROUNDS):
        # another leader in every round: the least id or, in odd bands and later rounds, the least hash
        order = F.when((F.col("band") % 2 == 0) & F.lit(turn == 0), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "band", F.lit(turn)))
        heads = open_.groupBy("key", "band").agg(F.min_by("doc_id", order).alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader")
        member = written(open_.join(heads, "key").filter("doc_id <> leader"), "members")
        if not member.limit(1).count():
            return compared, None
        compared.append(written(verified(member.select("doc_id", "leader"), vectors), "similarities"))
        sure = compared[-1].filter(F.col("similarity") >= threshold).select("doc_id", "leader")
        open_ = member.join(sure, ["doc_id", "leader"], "left_anti").select("doc_id", "band", "key")
    return compared, open_


def labelled(rows: DataFrame, known: DataFrame, of: str, name: str) -> DataFrame:
    """``rows`` with the class of column ``of``: its component, or itself."""
    k = known.select(F.col("doc_id").alias("_id"), F.col("class_id").alias("_class"))
    return rows.join(k, rows[of] == k["_id"], "left").withColumn(name, F.coalesce("_class", of)).drop("_id", "_class")


def beside_leaders(compared: DataFrame, known: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``doc_id, leader`` of a text linked to a leader and one that is not, but may be similar to it and is not in the leader's class."""
    far = 1 - threshold
    weights = vectors.select("doc_id", "total", "shares")
    shell = compared.filter((F.col("similarity") < threshold) & (1 - F.col("similarity") <= 2 * far + SLACK)).distinct()
    shell = labelled(labelled(shell, known, "doc_id", "label"), known, "leader", "l_label").filter("label <> l_label")
    shell = written(shell.join(weights, "doc_id").select("leader", F.col("doc_id").alias("other"), (1 - F.col("similarity")).alias("away"), F.col("total").alias("o_total"), F.col("shares").alias("o_shares")), "shells")
    linked = compared.filter(F.col("similarity") >= threshold).select("doc_id", "leader", (1 - F.col("similarity")).alias("near")).distinct()
    linked = linked.join(shell.select("leader").distinct(), "leader", "left_semi").join(weights, "doc_id")
    close = F.col("near") >= F.col("away") - (far + SLACK)
    pairs = shell.join(linked, "leader").filter(close & can_reach(threshold, "total", "shares", "o_total", "o_shares"))
    return pairs.select("doc_id", F.col("other").alias("leader"))


def within(cells: DataFrame, known: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """All pairs ``doc_id, leader`` of different classes in a cell that can reach the threshold."""
    m = labelled(cells.select("doc_id", "key"), known, "doc_id", "label")
    several = m.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    a = written(m.join(several, "key").join(vectors.select("doc_id", "total", "shares"), "doc_id"), "open")
    b = a.select("key", F.col("doc_id").alias("leader"), F.col("label").alias("l_label"), F.col("total").alias("l_total"), F.col("shares").alias("l_shares"))
    near = can_reach(threshold, "total", "shares", "l_total", "l_shares")
    return a.join(b, "key").filter((F.col("doc_id") < F.col("leader")) & (F.col("label") != F.col("l_label")) & near).select("doc_id", "leader")


def links(vectors: DataFrame, threshold: float) -> DataFrame | None:
    """Verified links ``a, b``: texts that share a band bucket and reach the threshold are connected by them."""

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def linked(compared: list[DataFrame]) -> DataFrame:
        return union(compared).filter(F.col("similarity") >= threshold).select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))

    compared, open_ = leaders(vectors.select("doc_id", F.posexplode("keys").alias("band", "key")), vectors, threshold)
    if not compared:
        return None
    known, pairs = components(linked(compared)), []
    if open_ is not None:
        size = open_.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        open_ = written(open_.join(size, "key"), "left")
        large = open_.filter(F.col("n") > FAN).select("doc_id", "key")
        if large.limit(1).count():
            # by shingle alone: texts of one bucket meet in a part whatever other bucket they share
            some = large.select("doc_id").distinct()
            parts = vectors.select("doc_id", "rare").join(some, "doc_id", "left_semi").select("doc_id", F.explode("rare").alias("token"))
            parts = parts.select("doc_id", F.lit(0).alias("band"), F.col("token").cast("long").alias("key")).distinct()
            more, rest = leaders(written(parts, "parts"), vectors, threshold)
            if more:
                compared += more
                known = components(linked(compared))
            if rest is not None:
                pairs.append(within(rest, known, vectors, threshold))
        pairs.append(within(open_.filter(F.col("n") <= FAN), known, vectors, threshold))
    pairs.append(beside_leaders(union(compared), known, vectors, threshold))
    late = verified(union(pairs), vectors).filter(F.col("similarity") >= threshold).select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    return union([linked(compared), written(late, "links")])


def with_nodes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``node``, a number for each text of an id: the id, but 2**62 and more (by id and text) where there is no id, and for all but one of the different texts that share one."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    several = docs.filter("doc_id is not null").select("doc_id", text.alias("t")).groupBy("doc_id").agg(F.min("t").alias("main"), F.max("t").alias("last")).filter("main <> last")
    several = written(several.select(F.col("doc_id").alias("several"), "main"), "several")
    n = several.count()
    other = F.xxhash64("doc_id", text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    if not n:
        return docs.withColumn("node", F.coalesce(F.col("doc_id").cast("long"), other))
    joined = docs.join(F.broadcast(several) if n <= 100_000 else several, F.col("doc_id") == F.col("several"), "left")
    return joined.withColumn("node", F.when(F.col("doc_id").isNull() | (F.col("main") != text), other).otherwise(F.col("doc_id").cast("long"))).drop("several", "main")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per row: ``doc_id, class_id, copy_of`` (least id with the same text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_rows, size = text_stats(docs)
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    rows = docs
    docs = with_nodes(docs.filter("doc_id is not null").select("doc_id", "text", group_of(docs, n_rows, size, GROUP_BYTES).alias("grp")))
    d = docs.select("grp", text.alias("text"), F.col("node").alias("doc_id"))

    base = written(docs.select(F.col("doc_id").cast("long"), "node", F.md5(text.cast("binary")).alias("digest")), "digests")
    # texts that several rows have; their rows are dealt to SALTS parts, so that a text of very many rows is no one task's
    several = base.groupBy("digest").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    several = several.select(F.col("digest").alias("s_digest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s_salt"), "first")
    salted = base.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    joined = salted.join(several, (F.col("digest") == F.col("s_digest")) & (F.col("salt") == F.col("s_salt")), "left")
    state = joined.select("doc_id", "node", F.coalesce("first.doc_id", "doc_id").alias("copy_of"), F.coalesce("first.node", "node").alias("copy_node"))
    state = written(state, "state")
    drop(base)
    n_docs = state.count()

    freq = d.mapInArrow(_send(buckets), _SENT).groupBy("bucket").applyInArrow(_count, _FREQ)
    every = d.groupBy("grp").cogroup(freq.groupBy("grp")).applyInArrow(_vectors(buckets, n_docs, threshold), _VECTOR)
    firsts = state.filter("node = copy_node").select(F.col("node").alias("doc_id")).distinct()
    each = written(every, "vectors")
    vectors = written(each.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "vectors")
    drop(each)

    found = links(vectors, threshold)
    # rows of one doc_id with different texts link those texts' first copies
    repeated = state.filter("node <> doc_id").select("doc_id").distinct()
    tied = state.join(repeated, "doc_id", "left_semi").filter("doc_id <> copy_node").select(F.col("doc_id").alias("a"), F.col("copy_node").alias("b"))
    found = tied if found is None else found.unionByName(tied)
    classes = components(found)
    node = classes.select(F.col("doc_id").alias("copy_node"), "class_id")
    out = state.join(node, "copy_node", "left").select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of")
    none = F.lit(None).cast("long")
    return out.unionByName(rows.filter("doc_id is null").select(none.alias("doc_id"), none.alias("class_id"), none.alias("copy_of")))
