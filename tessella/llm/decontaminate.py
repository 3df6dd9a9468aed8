"""Benchmark decontamination by greedy string tiling.

Documents and test items meet on shared seeds (runs of `least` words), and every such pair is tiled: the longest match of words that are
still free is marked again and again, found by running Karp-Rabin hashes, until no free match has `least` words. The share of an item's
words under tiles is its coverage, whatever the order of the tiles: reordered passages count like copied ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import NO_ID, Powers, ship, source_columns, splitmix, text_bytes, word_hashes

_BASE = 0x9E3779B97F4A7C15 | 1


def running(values: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `width` values, modulo 2**64."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + values[i : len(values) - width + 1 + i]
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int, most: int = 1_000_000) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length), longest first, ties by item then doc start; no word is in two tiles.

    doc and item are 64-bit word hashes, which are compared themselves. Matches are runs on diagonals of equal seeds; a match that lost words to
    a tile is cut to its free runs, as in a new round of the search. Where repetitive texts have more than `most` pairs of equal seeds, the
    search goes by length instead, in memory that grows with the texts and not with the pairs; the tiles are the same.
    """
    seeds_d, seeds_i = running(doc, least), running(item, least)
    order = np.argsort(seeds_i, kind="stable")
    low = np.searchsorted(seeds_i[order], seeds_d, "left")
    high = np.searchsorted(seeds_i[order], seeds_d, "right")
    n = high - low
    if not n.sum():
        return []
    if n.sum() > most:
        return _by_length(doc, item, least)
    at_d = np.repeat(np.arange(len(seeds_d)), n)
    at_i = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    same = np.ones(len(at_d), bool)
    for k in range(least):  # hashes of runs only find; the words' hashes decide
        same &= doc[at_d + k] == item[at_i + k]
    at_d, at_i = at_d[same], at_i[same]
    by = np.lexsort((at_i, at_i - at_d))
    at_d, at_i = at_d[by], at_i[by]
    new = np.concatenate([[True], (np.diff(at_i - at_d) != 0) | (np.diff(at_i) != 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(at_i)]])) + least - 1
    return _greedy([(-int(m), int(i), int(d)) for m, i, d in zip(length, at_i[first], at_d[first], strict=True)], len(doc), len(item), least)


class _Runs:
    """Karp-Rabin hashes of runs of any one length, from prefix sums."""

    def __init__(self, values: np.ndarray, powers: Powers):
        powers.to(len(values) + 1)
        self.values, self.powers = values, powers
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(splitmix(values) * powers.up[: len(values)], out=self.total[1:])

    def free(self, taken: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of runs of free words, ascending, and their hashes."""
        used = np.concatenate([[0], np.cumsum(taken)])
        at = np.flatnonzero(used[width:] == used[: len(used) - width]) if width <= len(taken) else np.zeros(0, np.int64)
        return at, splitmix((self.total[at + width] - self.total[at]) * self.powers.down[at])


def _by_length(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles of tiles(): the greatest length of a common free run by bisection, all tiles of that length, and on to smaller ones."""
    powers = Powers(0x2545F4914F6CDD1D)
    runs_d, runs_i = _Runs(doc, powers), _Runs(item, powers)
    taken_d, taken_i, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []

    def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at_d, hash_d = runs_d.free(taken_d, width)
        at_i, hash_i = runs_i.free(taken_i, width)
        hit = np.isin(hash_i, hash_d)
        return at_d, hash_d, at_i[hit], hash_i[hit]

    high = min(len(doc), len(item))
    while high >= least:
        low, top = least - 1, high  # the greatest length with a common run lies in (low, top], or there is none
        while low < top:
            mid = (low + top + 1) // 2
            low, top = (mid, top) if len(common(mid)[2]) else (low, mid - 1)
        if low < least:
            break
        at_d, hash_d, at_i, hash_i = common(low)
        order = np.argsort(hash_d, kind="stable")
        at_d, hash_d = at_d[order], hash_d[order]
        a, b = np.searchsorted(hash_d, hash_i, "left"), np.searchsorted(hash_d, hash_i, "right")
        next_of: dict[int, int] = {}  # where the search among a hash's places goes on: those before are taken
        for i, x, y in zip(at_i.tolist(), a.tolist(), b.tolist(), strict=True):
            if taken_i[i : i + low].any():
                continue
            k = next_of.get(x, x)
            while k < y and taken_d[(d := int(at_d[k])) : d + low].any():
                k += 1
            next_of[x] = k
            if k < y and np.array_equal(doc[d : d + low], item[i : i + low]):
                out.append((d, i, low))
                taken_d[d : d + low] = taken_i[i : i + low] = True
        high = low - 1
    return out


def _greedy(matches: list[tuple[int, int, int]], n_doc: int, n_item: int, least: int) -> list[tuple[int, int, int]]:
    import heapq

    free_d, free_i, out = np.ones(n_doc, bool), np.ones(n_item, bool), []
    heapq.heapify(matches)
    while matches:
        m, i, d = heapq.heappop(matches)
        free = free_d[d : d - m] & free_i[i : i - m]
        if free.all():
            out.append((d, i, -m))
            free_d[d : d - m] = free_i[i : i - m] = False
            continue
        edge = np.diff(np.concatenate([[0], free.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= least:
                heapq.heappush(matches, (-int(b - a), i + int(a), d + int(a)))
    return out


@dataclass(frozen=True)
class Items:
    """A block of test items: word hashes, and their sorted seeds with the item of each."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]], least: int) -> Items:
        words = [word_hashes(np.frombuffer((t or "").encode(), np.uint8)) for _, t in rows]
        seeds = [running(w, min(least, max(len(w), 1))) for w in words]
        owner = np.concatenate([np.full(len(s), i) for i, s in enumerate(seeds)] or [np.zeros(0, int)]).astype(np.int64)
        flat = splitmix(np.concatenate(seeds or [np.zeros(0, np.uint64)]))
        order = np.argsort(flat, kind="stable")
        return cls([r[0] for r in rows], words, flat[order], owner[order])


def matcher(blocks, least: int):
    """An Arrow function: (did, text) to (did, item_id, n_tiles, n_matched, n_words) of pairs that share a seed."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = blocks.value
        short = {len(w) for w in items.words if 0 < len(w) < least}  # items shorter than a seed match whole
        for batch in batches:
            out: list[tuple] = []
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = word_hashes(text_bytes(text))
                near: set[int] = set()
                for width in (least, *short):
                    seeds = splitmix(running(doc, width))
                    low = np.searchsorted(items.seeds, seeds, "left")
                    hit = low < len(items.seeds)
                    hit[hit] = items.seeds[low[hit]] == seeds[hit]
                    if hit.any():
                        up = np.searchsorted(items.seeds, seeds[hit], "right")
                        near |= {int(o) for a, b in set(zip(low[hit].tolist(), up.tolist(), strict=True)) for o in items.owner[a:b]}
                for o in sorted(near):
                    word = items.words[o]
                    found = tiles(doc, word, min(least, len(word)))
                    if found:
                        out.append((did, items.ids[o], len(found), sum(t[2] for t in found), len(word)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["did", "item_id", "n_tiles", "n_matched", "n_words"])

    return match


def _seeds(widths: tuple[int, ...] | None, least: int, rows: int = 200_000):
    """(id, h, text) to (seed, id, h), each seed of a text once. widths: of the runs; None: `least`, or the whole text if that is shorter."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = word_hashes(text_bytes(text))
                of = widths or (min(least, max(len(words), 1)),)
                found = np.unique(np.concatenate([splitmix(running(words, w)) for w in of])).view(np.int64)
                parts.append(pa.record_batch([pa.array(found), pa.array(np.full(len(found), i, np.int64)), pa.array(np.full(len(found), h, np.int64))], ["seed", "id", "h"]))
                held += len(found)
                if held >= rows:
                    yield from parts
                    parts, held = [], 0
            yield from parts

    return seeds


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([len(word_hashes(text_bytes(t))) for t in batch.column(2)], pa.int64())], ["n"])


def _tiled(least: int):
    """(did, text, item_id, item) to the pair's tiles."""

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for did, text, iid, other in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                item = word_hashes(text_bytes(other))
                found = tiles(word_hashes(text_bytes(text)), item, min(least, len(item))) if len(item) else []
                if found:
                    out.append((did, iid, len(found), sum(t[2] for t in found), len(item)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["did", "item_id", "n_tiles", "n_matched", "n_words"])

    return tiled


_FOUND = "did long, item_id long, n_tiles long, n_matched long, n_words long"


def _joined(rows: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """Pairs that share a seed by a join on seeds, and their tiles. rows: did, text; items: item_id, text."""
    rows = rows.select(F.col("did").alias("id"), F.xxhash64("text").alias("h"), "text")
    items = items.select(F.col("item_id").alias("id"), F.xxhash64("text").alias("h"), "text").distinct()
    short = items.mapInArrow(_lengths, "n long").where((F.col("n") > 0) & (F.col("n") < least)).distinct().collect()  # fewer than `least` rows
    at_rows = rows.mapInArrow(_seeds((least, *[r[0] for r in short]), least), "seed long, id long, h long")
    at_items = items.mapInArrow(_seeds(None, least), "seed long, id long, h long")
    pairs = at_rows.join(at_items.select("seed", F.col("id").alias("item_id"), F.col("h").alias("item_h")), "seed").select("id", "h", "item_id", "item_h").distinct()
    others = items.select(F.col("id").alias("item_id"), F.col("h").alias("item_h"), F.col("text").alias("item"))
    texts = rows.join(pairs, ["id", "h"]).join(others, ["item_id", "item_h"])
    return texts.select("id", "text", "item_id", "item").mapInArrow(_tiled(least), _FOUND)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, n_tiles, n_matched, n_words and coverage of each pair whose tiles cover at least `coverage` of the item.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, told by 64-bit hashes. Every whole text meets every item that it shares a seed with:
    test items of up to block_bytes of text in all, a stated query set, are broadcast, and one pass over the documents without a shuffle
    decides; more of them are joined by their seeds. Null or empty texts and items without words match nothing; items of fewer than `least`
    words must occur whole. Null ids stay null; repeated rows of documents give repeated pairs, equal rows of the benchmark are one. Empty tables: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = source_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "text")
    items = source_columns(benchmark, "item_id", "text").select(F.coalesce("item_id", F.lit(NO_ID)).alias("item_id"), "text").distinct()
    size, n = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if (size or 0) + 8 * n <= block_bytes:
        held = spark.sparkContext.broadcast(Items.of([tuple(r) for r in items.orderBy("item_id", "text").collect()], least))
        out = rows.mapInArrow(matcher(held, least), _FOUND)
    else:
        out = _joined(rows, items, least)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.where(F.col("n_matched") >= F.ceil(F.col("n_words") * F.lit(coverage))).select(
        known("did").alias("doc_id"), known("item_id").alias("item_id"), "n_tiles", "n_matched", "n_words", (F.col("n_matched") / F.col("n_words")).alias("coverage")
    )
