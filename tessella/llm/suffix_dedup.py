"""Suffix-array dedup: every byte covered by a `width`-byte string that also starts earlier is removed.

1. Each text's windows of `width` bytes are dealt by content: a window belongs to the smallest hash among its GRAM-byte grams, so equal
   windows always belong to the same hash. Consecutive windows of one hash are a piece. A corpus of n bytes has about n / 35 pieces, and
   only a few numbers travel for each.
2. Sorted by hash, equal pieces are neighbours: all but the first are repeats, without their bytes being moved. Pieces that share a hash
   but differ, or repeat inside, are the repetitive rest.
3. The rest's bytes meet by hash. A run-length index is built over them: the Burrows-Wheeler transform of their concatenation, compressed to
   runs, with the suffix positions sampled at the run ends. From the samples, matching statistics are streamed over the text: at a run's
   start the match with the sampled neighbour is compared directly, and inside a run each position's match is its predecessor's, one byte
   shorter. Matches of `width` or more chain equal windows; all but a chain's first are marked.
4. Marks meet their documents, overlaps are joined, and what is left is the result.

A hash that more than HOT different pieces share (the edge of a passage that millions of documents hold) is dealt again: its pieces are cut
where the hash of their windows' several smallest grams changes, equal cuts collapse to the first, and each finer hash has an index of its own.
The last level's hash is that of the whole window, where all windows of a hash are equal. Every level ends in the same index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import NO_ID, Powers, partitions, seeded, ship, source_columns, splitmix, text_bytes, written

GRAM = 32
#: Windows in a piece at most; a longer run of one hash is several pieces.
STARTS = 256
#: Different pieces of one hash that one index may hold, and bytes of an index.
HOT, INDEX_BYTES = 2000, 900_000
#: How many of a window's smallest grams make its hash at each further level; None: the whole window.
LEVELS = (8, 24, None)
_TABLES = seeded(256, 21), seeded(256, 22)
_POWERS = Powers(0x9E6C63D0676A9A99), Powers(0xC2B2AE3D27D4EB4F)


def sums(data: np.ndarray, k: int) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows."""
    p = _POWERS[k]
    p.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[k][data] * p.up[: len(data)], out=out[1:])
    return out


def spans(total: np.ndarray, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return splitmix((total[b] - total[a]) * _POWERS[k].down[a])


def grams_of(data: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The hashes of all GRAM-byte strings; total: sums(data, 0)."""
    return splitmix((total[GRAM:] - total[:-GRAM]) * _POWERS[0].down[: len(data) - GRAM + 1])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    more = width - have
    return best(x[:-more], x[more:]) if more else x


def pieces(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """hash, content hash, start, number of windows, whether a window may recur inside; in order of start."""
    n = len(data)
    if n < width:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    total, other = sums(data, 0), sums(data, 1)
    grams = grams_of(data, total)
    reach = width - GRAM + 1
    low = sliding(grams, reach, np.minimum)
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(new, len(low)))
    if count.max() > STARTS:
        parts = -(-count // STARTS)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(count, parts) - inner * STARTS
        new, count = np.repeat(new, parts) + inner * STARTS, np.minimum(left, STARTS)
    key = low[new]
    # grams that are the smallest of some window; a piece that holds its own smallest twice may repeat itself
    pad = np.zeros(reach - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, low, pad]), reach, np.maximum) == grams)
    first, last = np.searchsorted(at, new), np.searchsorted(at, new + count + reach - 1)
    many = last - first
    place = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    own = np.repeat(np.arange(len(new)), many)
    twice = np.bincount(own[grams[at[place]] == key[own]], minlength=len(new)) > 1
    end = new + count + width - 1
    return key, spans(other, 1, new, end) + splitmix((end - new).astype(np.uint64)), new, count, twice


def _packed(start: np.ndarray, count: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 9) | (twice.astype(np.int64) << 8) | (count - 1)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 9, (at & 255) + 1


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in cols], names.split())


def ranges(did: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-open ranges joined where they touch or overlap, by did."""
    order = np.lexsort((a, did))
    did, a, b = did[order], a[order], b[order]
    if not len(did):
        return did, a, b
    start = np.concatenate([[True], did[1:] != did[:-1]])
    reach, far = b.copy(), 0
    group = np.cumsum(start) - 1
    span = int(b.max()) + 1
    reach = np.maximum.accumulate(b + group * span) - group * span
    start[1:] |= a[1:] > reach[:-1]
    far = np.append(np.flatnonzero(start)[1:], len(did)) - 1
    return did[start], a[start], reach[far]


def _map(width: int, slice_bytes: int = 2 << 20):
    """(did, text) to (m, ph, did, at): pieces, and with at < 0 a range of did that is known to repeat: [-at - 1, ph)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> Iterator[pa.RecordBatch]:
            m, ph, did, start, count, twice = (np.concatenate(c) for c in zip(*held, strict=True))
            # of equal pieces in this slice only the first goes on: copies shrink before the shuffle
            order = np.lexsort((start, did, ph, m))
            same = np.zeros(len(m), bool)
            x, y = order[1:], order[:-1]
            same[x] = (m[x] == m[y]) & (ph[x] == ph[y]) & ~((did[x] == did[y]) & (start[x] == start[y]))
            keep = ~same
            yield _batch("m ph did at", m[keep].view(np.int64), ph[keep].view(np.int64), did[keep], _packed(start[keep], count[keep], twice[keep]))
            d, a, b = ranges(did[same], start[same], start[same] + count[same] + width - 1)
            yield _batch("m ph did at", splitmix(d.view(np.uint64) + a.view(np.uint64)).view(np.int64), b, d, -a - 1)

        held, size = [], 0
        for batch in batches:
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text_bytes(text)
                m, ph, start, count, twice = pieces(data, width)
                if len(m):
                    held.append((m, ph, np.full(len(m), did, np.int64), start, count, twice))
                    size += len(data)
                if size >= slice_bytes:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _reduce(width: int):
    """Rows sorted by (m, ph, did, at) to (did, a, b, m): marks with m null, and pieces of the rest with a = at, b = 0 and their m.

    Only the group's state travels between batches: its hash, its last piece, and its first piece until a second shows that it is shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = None  # m, ph, did, at of the last row
        shared, waiting = False, None  # whether prev's group is the rest's; (did, at) of its only piece so far
        for batch in batches:
            m, ph, did, at = (batch.column(i).to_numpy() for i in range(4))
            known = at < 0
            if known.any():
                d, a, b = did[known], -at[known] - 1, ph[known]
                yield _out(d, a, b, None)
                m, ph, did, at = m[~known], ph[~known], did[~known], at[~known]
            if not len(m):
                continue
            head = prev if prev is not None else (~m[0], 0, 0, 0)
            pm, pp, pd, pt = (np.concatenate([[h], x[:-1]]) for h, x in zip(head, (m, ph, did, at), strict=True))
            new_m = m != pm
            new = new_m | (ph != pp)
            again = ~new & ((did != pd) | (at != pt))
            start, count = _unpacked(at)
            yield _out(did[again], start[again], start[again] + count[again] + width - 1, None)
            # groups of this batch; group 0 goes on from before unless its first row starts one
            group = np.cumsum(new_m)
            if new_m[0]:
                group -= 1
            n = int(group[-1]) + 1
            distinct = np.bincount(group[new], minlength=n)
            rest = np.bincount(group[new & ((at >> 8) & 1 == 1)], minlength=n) > 0
            old_shared = shared and not new_m[0]
            old_waiting = waiting if not new_m[0] else None
            rest |= distinct > 1
            if not new_m[0]:
                rest[0] |= shared or (old_waiting is not None and distinct[0] > 0)
                if rest[0] and old_waiting is not None:
                    yield _out(np.array([old_waiting[0]]), np.array([old_waiting[1]]), np.zeros(1, np.int64), np.array([pm[0]]))
                    old_waiting = None
            go = new & rest[group]
            yield _out(did[go], at[go], np.zeros(int(go.sum()), np.int64), m[go])
            last = n - 1
            shared = bool(rest[last]) or (last == 0 and old_shared)
            if shared:
                waiting = None
            else:
                rows = np.flatnonzero(new & (group == last))
                waiting = (int(did[rows[-1]]), int(at[rows[-1]])) if len(rows) else old_waiting
            prev = m[-1], ph[-1], did[-1], at[-1]

    return run


def _out(did, a, b, m) -> pa.RecordBatch:
    key = pa.nulls(len(did), pa.int64()) if m is None else pa.array(m, pa.int64())
    return pa.record_batch([pa.array(did, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), key], ["did", "a", "b", "m"])


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of concatenated pieces, with the suffixes at run ends sampled."""

    def __init__(self, parts: list[np.ndarray]):
        size = np.array([len(p) for p in parts])
        k = len(parts)
        text = np.empty(int(size.sum()) + k, np.int64)
        end = np.cumsum(size + 1) - 1
        is_end = np.zeros(len(text), bool)
        is_end[end] = True
        text[is_end] = np.arange(k)  # every piece ends with a symbol of its own, so no match leaves a piece
        text[~is_end] = np.concatenate(parts).astype(np.int64) + k
        self.text = text.astype(np.int32)
        order = self._sorted(text)
        before = text[order - 1]  # of position 0: the last end symbol
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.runs = before[head]
        self.starts = order[head]  # suffix at each run's first row
        self.ends = order[np.append(head[1:], len(order)) - 1]  # and at its last

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling. Where a pair of ranks and a place fit 63 bits, plain values are sorted, several times as fast as places."""
        n = len(text)
        place = n.bit_length()
        packs = 2 * place + 2 + place <= 63
        bits = int(text.max()).bit_length()
        have = max(1, min((63 - place if packs else 62) // max(bits, 1), n))
        key = text.copy()
        for i in range(1, have):
            key <<= bits
            key[: n - i] |= text[i:]
        at = np.arange(n)
        while True:
            if packs:
                s = np.sort((key << place) | at)
                order = s & ((1 << place) - 1)
                s >>= place
            else:
                order = np.argsort(key, kind="stable")
                s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            if rank[order[-1]] == n - 1:
                return order
            key = rank * (n + 1)
            key[: max(n - have, 0)] += rank[have:] + 1
            have *= 2

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position, the length of its match with the suffix above it and that suffix's position (-1 for the smallest suffix)."""
        n = len(self.text)
        above = np.full(n, -1, np.int64)
        length = np.zeros(n, np.int64)
        sampled = np.zeros(n, bool)
        here, up = self.starts[1:], self.ends[:-1]
        above[here] = up
        sampled[self.starts] = True
        live, k = np.arange(len(here)), 0
        match = np.zeros(len(here), np.int64)
        while len(live):
            ok = self.text[here[live] + k] == self.text[up[live] + k]  # ends at an end symbol at the latest
            live = live[ok]
            match[live] += 1
            k += 1
        length[here] = match
        sampled[0] = True
        base = np.maximum.accumulate(np.where(sampled, np.arange(n), 0))
        step = np.arange(n) - base
        alone = above[base] < 0
        return np.where(alone, 0, np.maximum(length[base] - step, 0)), np.where(alone, -1, above[base] + step)

    def repeats(self, width: int) -> np.ndarray:
        """Positions whose next `width` symbols start at a smaller position too."""
        length, above = self.statistics()
        n = len(length)
        linked = length >= width
        root = np.where(linked, above, np.arange(n))
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        first = np.arange(n)
        np.minimum.at(first, root, np.arange(n))
        first = first[root]
        return np.flatnonzero(first < np.arange(n))


def marks_of(rows: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (did, start, bytes) in order of (did, start) within each hash, to ranges that repeat."""
    parts = [np.frombuffer(r[2], np.uint8) for r in rows]
    again = RunIndex(parts).repeats(width)
    begin = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    own = np.searchsorted(begin, again, "right") - 1
    did = np.array([r[0] for r in rows], np.int64)[own]
    start = np.array([r[1] for r in rows], np.int64)[own] + again - begin[own]
    return ranges(did, start, start + width)


def cut_by(body: bytes, width: int, grams: int | None) -> list[tuple[int, int, bytes]]:
    """A piece cut where the hash of its windows' `grams` smallest grams changes, with None into windows: hash, place and bytes of each part."""
    data = np.frombuffer(body, np.uint8)
    total = sums(data, 0)
    if grams is None:
        a = np.arange(len(data) - width + 1)
        key = spans(total, 0, a, a + width)
    else:
        each = grams_of(data, total)
        low = np.sort(np.partition(np.lib.stride_tricks.sliding_window_view(each, width - GRAM + 1), grams - 1, axis=1)[:, :grams], axis=1)
        key = np.zeros(len(low), np.uint64)
        for j in range(grams):
            key = splitmix(key + low[:, j])
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (grams is None)])).tolist()
    return [(m, i, body[i : j + width - 1]) for m, i, j in zip(key[new].view(np.int64).tolist(), new, [*new[1:], len(key)], strict=True)]


def _pieces_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((),) * 4
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["m", "did", "start", "body"])


def _bytes(width: int, grams: int | None, rows: int = 4096):
    """(did, text, rest: array of struct(m, at, hot)) to (m, did, start, body); pieces of hot hashes are cut by finer ones at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for did, text, rest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text_bytes(text).tobytes()
                start, count = _unpacked(rest.values.field("at").to_numpy())
                for m, hot, a, c in zip(rest.values.field("m").to_pylist(), rest.values.field("hot").to_pylist(), start.tolist(), count.tolist(), strict=True):
                    body = raw[a : a + c + width - 1]
                    if hot:
                        out += [(key, did, a + i, part) for key, i, part in cut_by(body, width, grams)]
                    else:
                        out.append((m, did, a, body))
                    if len(out) >= rows:
                        yield _pieces_batch(out)
                        out = []
            yield _pieces_batch(out)

    return run


def _index(width: int):
    """Pieces sorted by (m, body hash, did, start) to (did, a, b, body): marks with body null, and with b = 0 the pieces at a of hashes that more than HOT
    different pieces share. Equal pieces but the first are marked at once; whole hashes are gathered up to INDEX_BYTES for an index."""

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        did, a, body = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch([pa.array(did, pa.int64()), pa.array(a, pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array(body, pa.binary())], _INDEXED)

    def marked(did, a, b) -> pa.RecordBatch:
        return pa.record_batch([pa.array(did, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(did), pa.binary())], _INDEXED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, size = [], 0  # pieces of whole hashes, and the bytes of these and the group
        group, hot, last = [], False, None  # different pieces of the hash that is being read, unless it is hot; its first column
        before = None  # the last different piece
        for batch in batches:
            again, over = [], []
            for m, did, start, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if m != last:
                    full += sorted(group)
                    group, hot, last, before = [], False, m, None
                    if size >= INDEX_BYTES:
                        yield marked(*marks_of(full, width))
                        full, size = [], 0
                if before is not None and before[2] == body:
                    if before[:2] != (did, start):
                        again.append((did, start, start + len(body)))
                    continue
                before = (did, start, body)
                (over if hot else group).append(before)
                size += 0 if hot else len(body)
                if len(group) > HOT:
                    size -= sum(len(p[2]) for p in group)
                    over, group, hot = over + group, [], True
            yield marked(*(zip(*again, strict=True) if again else ((), (), ())))
            yield batch_of(over)
        full += sorted(group)
        if full:
            yield marked(*marks_of(full, width))

    return run


_INDEXED = ["did", "a", "b", "body"]


def _finer(width: int, grams: int | None):
    """Pieces (did, a, body) to their parts (m, did, start, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for did, start, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out += [(m, did, start + i, part) for m, i, part in cut_by(body, width, grams)]
            yield _pieces_batch(out)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, text, marks: array of struct(a, b)) to the result."""
    for batch in batches:
        n, gone, runs, sha, kept = [], [], [], [], []
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            data = text_bytes(text)
            size = 0
            if marks.is_valid:
                a, b = (marks.values.field(c).to_numpy() for c in "ab")
                _, a, b = ranges(np.zeros(len(a), np.int64), a, b)
                keep = np.ones(len(data) + 1, np.int64)
                keep[a] -= 1
                keep[b] += 1
                on = np.cumsum(keep[:-1] - 1) == 0
                size = int((b - a).sum())
                left = data[on].tobytes()
                runs.append(len(a))
            else:
                left = data.tobytes()
                runs.append(0)
            n.append(len(data))
            gone.append(size)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.record_batch(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
            ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeated_bytes(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the bytes left) of every row.

    A text is its UTF-8 bytes (null: none); matches never cross documents. Removed are all bytes covered by a `width`-byte string that also
    starts earlier: in a smaller doc_id, or in the same document before. Strings are judged on the input. A null doc_id comes after all
    others. Rows equal in id and text are one document, each getting its result; rows of one id with different texts are told apart by an
    order of their hashes. Empty table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = source_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "text")
    twins = rows.select("did", F.xxhash64("text").alias("h")).groupBy("did").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    if not twins.where("lo <> hi").isEmpty():
        # only for tables whose ids aren't unique: numbers in the same order take the ids' place
        keys = rows.select("did", F.xxhash64("text").alias("h")).distinct().orderBy("did", "h").withColumn("no", F.monotonically_increasing_id())
        keys = written(keys, "suffix-ids")
        named = rows.withColumn("h", F.xxhash64("text")).join(keys, ["did", "h"]).select(F.col("no").alias("did"), "text")
        return _removed(named, width).join(keys, F.col("__did") == F.col("no")).select(_known("did"), *_COLUMNS)
    return _removed(rows, width).select(_known("__did"), *_COLUMNS)


_COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _known(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def _removed(rows: DataFrame, width: int) -> DataFrame:
    n = partitions(rows.sparkSession)
    found = rows.mapInArrow(_map(width), "m long, ph long, did long, at long")
    found = found.repartition(n, "m").sortWithinPartitions("m", "ph", "did", "at")
    found = written(found.mapInArrow(_reduce(width), "did long, a long, b long, m long"), "suffix-marks")
    marks, rest = found.where("m is null").select("did", "a", "b"), found.where("m is not null").select("m", "did", F.col("a").alias("at"))
    hot = written(rest.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("m"), "suffix-hot")
    rest = rest.join(hot.withColumn("hot", F.lit(True)), "m", "left")
    lists = rest.groupBy("did").agg(F.collect_list(F.struct("m", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("rest"))
    body = rows.join(lists, "did").select("did", "text", "rest").mapInArrow(_bytes(width, LEVELS[0]), "m long, did long, start long, body binary")
    for grams in (*LEVELS[1:], None):  # after the last level nothing is hot
        sorted_body = body.select("m", F.xxhash64("body").alias("bh"), "did", "start", "body").repartition(n, "m").sortWithinPartitions("m", "bh", "did", "start")
        indexed = written(sorted_body.mapInArrow(_index(width), "did long, a long, b long, body binary"), "suffix-indexed")
        marks = marks.unionByName(indexed.where("body is null").select("did", "a", "b"))
        over = indexed.where("body is not null").select("did", "a", "body")
        if over.isEmpty():
            break
        body = over.mapInArrow(_finer(width, grams), "m long, did long, start long, body binary")
    else:
        raise RuntimeError("different windows share a hash")
    by_doc = marks.groupBy("did").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    out = rows.join(by_doc, "did", "left").select("did", "text", "marks")
    schema = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return out.mapInArrow(_cut, schema).withColumnRenamed("did", "__did")
