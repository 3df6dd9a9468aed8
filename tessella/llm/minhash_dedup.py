"""MinHash near-dedup by an inverted join on signature coordinates.

1. A text's word shingles are hashed to a set; equal sets are one class from here on, so copies cost nothing more.
2. Each class is posted under its K (coordinate, minimum) pairs. Pairs that agree in at least T coordinates share one of the K - T + 1
   rarest postings of each, so only these prefixes are merged, and postings held by one class are skipped altogether.
3. Collisions are counted on one byte for each coordinate of a longer signature. A posting's classes first meet its most central member; those links are
   confirmed on full sets and joined to components. Then classes of one posting that are still in different components meet in blocks, the
   posting's largest component only with the others;
   those that have a partner with enough collisions get their full sets and all their pairs are decided there. Links inside a component
   would change nothing and are skipped, and pairs are never written out.

T of K: at a similarity of 0.8 a pair agrees in K * 0.8 coordinates on average; P(fewer than 15 of 32) is below 2e-5. ALL and LEAST: a pair that is
to be confirmed agrees in LEAST of ALL one-byte coordinates, the K and further ones that aren't posted; P(fewer than 80 of 128) is below 2e-6
at 0.8, and few pairs under 0.5 pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, partitions, row_ids, rows_of, seeded, ship, shingle_set, source_columns, splitmix, text_bytes, written
from tessella.llm.components import components

K, T = 32, 15
ALL, LEAST = 128, 80
#: Rows of a posting that one block holds; larger postings meet block by block.
BLOCK = 512
#: Rows of one side where two blocks of a posting are compared row by row.
PAIR = 256
_MUL, _ADD = seeded(K, 5), seeded(K, 6)
_MUL32, _ADD32 = ((seeded(ALL - K, s) >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for s in (7, 8))


def signature(shingles: np.ndarray) -> bytes:
    """K eight-byte coordinates for the postings, then ALL - K one-byte ones."""
    out = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    more = np.full(ALL - K, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048, None]
        y = x * _MUL + _ADD
        out = np.minimum(out, (y ^ (y >> np.uint64(29))).min(axis=0))
        z = (x >> np.uint64(20)).astype(np.uint32) * _MUL32 + _ADD32
        more = np.minimum(more, (z ^ (z >> np.uint32(15))).min(axis=0))
    small = splitmix(more.astype(np.uint64) + np.arange(K, ALL, dtype=np.uint64) * np.uint64(1 << 32)).astype(np.uint8)
    return splitmix(out + np.arange(K, dtype=np.uint64)).tobytes() + small.tobytes()


def _sketches(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, c1, c2, sigs = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text_bytes(text), width)
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                sizes.append(len(s))
                c1.append((key >> 64) - (1 << 63))
                c2.append((key & (2**64 - 1)) - (1 << 63))
                sigs.append(signature(s) if len(s) else b"")
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sigs, pa.binary())], ["did", "n_shingles", "c1", "c2", "sig"])

    return sketch


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sig) to (key, rep): the coordinate is already mixed into its value."""
    for batch in batches:
        keys = np.concatenate([np.frombuffer(s.as_buffer(), np.int64, K) for s in batch.column(1)] or [np.zeros(0, np.int64)])
        yield pa.record_batch([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), K))], ["key", "rep"])


def _collisions(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sigs == one).sum(axis=1)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal first `keys` columns in a sorted stream."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            now = tuple(int(c[a]) for c in cols)
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _stars(least: int):
    """Blocks of one posting (key, block, rep, small) to edges between a member and the block's central ones."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 2):
            rep = np.concatenate([p.column(2).to_numpy() for p in parts])
            sig = np.frombuffer(b"".join(x for p in parts for x in p.column(3).to_pylist()), np.uint8).reshape(len(rep), ALL)
            a, b = [], []
            while len(rep) > 1:
                common = np.array([np.bincount(sig[:, j], minlength=256).argmax() for j in range(ALL)], np.uint8)
                mid = int(_collisions(sig, common).argmax())
                near = _collisions(sig, sig[mid]) >= least
                near[mid] = False
                a.append(rep[near])
                b.append(np.full(int(near.sum()), rep[mid]))
                near[mid] = True
                rep, sig = rep[~near], sig[~near]
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return stars


def _candidates(least: int):
    """Pairs of blocks (key, x, y, block, rep, component, small, keys) to the rows of these that have a candidate here: another component, enough
    collisions, and no smaller key in common, where the pair would meet already. Pairs themselves are not written."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, x, y), parts in _groups(batches, 3):
            block, rep, comp = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (3, 4, 5))
            sig = np.frombuffer(b"".join(s for p in parts for s in p.column(6).to_pylist()), np.uint8).reshape(len(rep), ALL)
            smaller = np.full((len(rep), K), key, np.int64)
            for i, ks in enumerate(k for p in parts for k in p.column(7).to_pylist()):
                low = [k for k in ks if k < key][:K]
                smaller[i, : len(low)] = low
            left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
            hit = np.zeros(len(rep), bool)
            for i in left:
                other = right[right > i] if x == y else right
                other = other[(comp[other] != comp[i]) & (_collisions(sig[other], sig[i]) >= least)]
                own = smaller[i][smaller[i] < key]
                if len(other) and len(own):
                    other = other[~np.isin(smaller[other], own).any(axis=1)]
                if len(other):
                    hit[i] = hit[other] = True
            n = int(hit.sum())
            yield pa.record_batch([pa.array([key] * n, pa.int64()), pa.array([x] * n, pa.int32()), pa.array([y] * n, pa.int32()), pa.array(rep[hit]), pa.array(comp[hit])], ["key", "x", "y", "rep", "component"])

    return candidates


def _block_sets(width: int):
    """(v, text, places: array of struct(key, x, y, component)) to a row for each place with the set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s, places = shingle_set(text_bytes(batch.column(1)[i]), width).tobytes(), batch.column(2)[i].values
                for j in range(0, len(places), 64):
                    part = places.slice(j, 64)
                    cols = [part.field(c) for c in ("key", "x", "y", "component")]
                    yield pa.record_batch([*cols, pa.array([batch.column(0)[i].as_py()] * len(part), pa.int64()), pa.array([s] * len(part), pa.binary())], ["key", "x", "y", "component", "v", "set"])

    return sets


def _links(percent: int):
    """The rows of a pair of blocks with their sets to links between components, as many as join them."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 3):
            comp, v = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (3, 4))
            sets = [np.frombuffer(s, np.uint64) for p in parts for s in p.column(5).to_pylist()]
            size = np.array([len(s) for s in sets])
            words, flat = np.unique(np.concatenate(sets), return_inverse=True)
            end = np.cumsum(size)
            start = end - size
            comp = comp.copy()
            a, b = [], []
            for i in range(len(v) - 1):
                mark = np.zeros(len(words), np.int64)
                mark[flat[start[i] : end[i]]] = 1
                both = np.add.reduceat(mark[flat[end[i] :]], start[i + 1 :] - end[i])
                near = np.flatnonzero(100 * both >= percent * (size[i] + size[i + 1 :] - both)) + i + 1
                for j in near.tolist():
                    if comp[i] != comp[j]:
                        a.append(v[i])
                        b.append(v[j])
                        comp[comp == comp[j]] = comp[i]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links


def _sets(width: int):
    """(text, n, hubs: array of struct(hub, salt, first)) to a row for each hub: (hub, salt, first, v, set)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs = batch.column(2)
            for i in range(batch.num_rows):
                s = shingle_set(text_bytes(batch.column(1)[i]), width).tobytes()
                rows = hubs[i].as_py()
                for j in range(0, len(rows), 256):
                    part = rows[j : j + 256]
                    yield pa.record_batch(
                        [pa.array([r["hub"] for r in part], pa.int64()), pa.array([r["salt"] for r in part], pa.int32()), pa.array([r["first"] for r in part], pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(part), pa.int64()), pa.array([s] * len(part), pa.binary())],
                        ["hub", "salt", "first", "v", "set"],
                    )

    return sets


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Of sorted sets."""
    small, large = (s, t) if len(s) <= len(t) else (t, s)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def _confirm(percent: int):
    """A hub's set and then its partners' sets, as a sorted stream; only the hub's set is held."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, owns = None, []
        for batch in batches:
            a, b = [], []
            hubs, salts, firsts, vs = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if firsts[i] == 0:  # several only where an id has rows of several texts
                    owns = [*owns, s.copy()] if at == (hubs[i], salts[i]) else [s.copy()]
                    at = hubs[i], salts[i]
                elif any(similar(s, own, percent) for own in owns):
                    a.append(hubs[i])
                    b.append(vs[i])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return confirm


def confirmed(edges: DataFrame, texts: DataFrame, width: int, percent: int, salt_rows: int = 250) -> DataFrame:
    """The edges a, b whose full shingle sets are similar enough. texts: v, text, one row for each v.

    A vertex's text meets its list of hubs once; its set then travels to each hub. A hub with many partners is dealt over salts, its own
    set going to each, so no task holds or reads an unbounded group. The end with more edges is the hub.
    """
    spark = edges.sparkSession
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    pairs = edges.join(degree.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    first = F.col("da") >= F.col("db")
    pairs = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("da", "db").alias("d"))
    salts = F.ceil(F.col("d") / salt_rows).cast("int")
    pairs = pairs.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
    pairs = written(pairs, "near-pairs", most_rows=rows_of(edges))
    own = pairs.select("hub", "salt").distinct().select(F.col("hub").alias("v"), F.struct("hub", "salt", F.lit(0).alias("first")).alias("h"))
    partners = pairs.select("v", F.struct("hub", "salt", F.lit(1).alias("first")).alias("h"))
    hubs = own.unionByName(partners).groupBy("v").agg(F.collect_list("h").alias("hubs"))
    held = texts.join(hubs.hint("merge"), "v").select("v", "text", "hubs").mapInArrow(_sets(width), "hub long, salt int, first int, v long, set binary")
    held = held.repartition(partitions(spark), "hub", "salt").sortWithinPartitions("hub", "salt", "first")
    return held.mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased; a row's set is its distinct shingles of `width` words (fewer words: all of them as one).
    Rows with 100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable, kept whether it is the
    row's own. Null, empty and blank texts have no shingles and link to nothing. Rows of one doc_id are one vertex with all their links. Rows
    without an id are one vertex where their texts are equal and else apart; they order last, so that a component of nothing else has a null
    component_id, and one of its texts is kept. Empty table: empty result. Other columns are not read.
    """
    docs = source_columns(docs, "doc_id", "text")
    ids, least = row_ids(docs)
    known = lambda c: F.when(F.col(c) < least, F.col(c))
    out = near_rows(docs.select(ids.alias("did"), "text"), width, percent)
    return out.select(known("did").alias("doc_id"), "n_shingles", known("first").alias("component_id"), (F.col("first") == F.col("did")).alias("kept"))


def near_rows(rows: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """did, n_shingles and first, the smallest did reachable, of every row (did, text); did is never null. See near_duplicates."""
    spark = rows.sparkSession
    ship(spark)
    n = partitions(spark)
    sketches = rows.mapInArrow(_sketches(width), "did long, n_shingles long, c1 long, c2 long, sig binary")
    sketches = written(sketches, "near-sketches")
    some = sketches.where("n_shingles > 0")
    classes = written(some.groupBy("c1", "c2").agg(F.min("did").alias("rep")), "near-classes", most_rows=rows_of(sketches))
    first = some.join(classes.withColumnRenamed("rep", "did"), ["c1", "c2", "did"], "left_semi").dropDuplicates(["c1", "c2"])
    reps = written(first.select(F.col("did").alias("rep"), "sig"), "near-reps")

    posted = reps.select("rep", "sig").mapInArrow(_postings, "key long, rep long")
    # written first: a join of two plain shuffles is dealt anew where a key is hot, one of an aggregate isn't
    counts = written(posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-counts")
    shared = posted.join(counts, "key")
    # of a class's K postings those held by it alone are rarest and come first: they use up the prefix without being merged
    by_rep = shared.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("p"))
    by_rep = by_rep.select("rep", F.slice("p", 1, F.greatest(F.lit(K - T + 1) - (F.lit(K) - F.size("p")), F.lit(0))).alias("p"))
    prefix = by_rep.select("rep", F.explode("p").alias("x"), F.col("p.key").alias("keys"))
    small = reps.select("rep", _low_bytes("sig").alias("small"))
    prefix = written(prefix.select("rep", "x.key", "x.c", "keys").join(small, "rep"), "near-prefix")

    # only texts with a shared posting are looked at again; they move once, and both rounds below read this table
    shared_ids = prefix.select(F.col("rep").alias("did")).distinct()
    texts = written(rows.join(shared_ids.hint("merge"), "did").select(F.col("did").alias("v"), "text"), "near-texts")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("c") / BLOCK)).cast("int")
    dealt = prefix.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    in_blocks = dealt.select("key", "block", "rep", "small").repartition(n, "key", "block").sortWithinPartitions("key", "block", "rep")
    star = written(in_blocks.mapInArrow(_stars(LEAST), "a long, b long").distinct(), "near-stars", most_rows=rows_of(prefix))
    links = written(confirmed(star, texts, width, percent), "near-links")
    comps = components(links, 2 * rows_of(links)).withColumnRenamed("v", "rep")

    dealt = dealt.join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    dealt = written(dealt, "near-dealt", most_rows=rows_of(prefix))
    # a posting's largest component is met by the rest of the posting, not by itself: near copies of one text cost no pairs of blocks
    sizes = dealt.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).where("k > 1")
    in_blocks = lambda rows: F.ceil(rows / PAIR).cast("int")
    mixed = written(mixed.select("key", F.col("top.component").alias("major"), in_blocks(F.col("all") - F.col("top.n")).alias("few"), in_blocks(F.col("top.n")).alias("many")), "near-mixed")
    met, is_major = dealt.join(mixed, "key"), F.col("component") == F.col("major")
    at = F.xxhash64("rep")
    met = met.withColumn("block", F.when(is_major, F.col("few") + F.pmod(at, "many")).otherwise(F.pmod(at, "few")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(is_major, 0).otherwise(F.col("many")))))
    met = met.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "component", "small", "keys")
    met = met.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "rep")
    left = written(met.mapInArrow(_candidates(LEAST), "key long, x int, y int, rep long, component long"), "near-left")
    if not left.isEmpty():
        places = left.groupBy(F.col("rep").alias("v")).agg(F.collect_list(F.struct("key", "x", "y", "component")).alias("places"))
        held = texts.join(places.hint("merge"), "v").select("v", "text", "places").mapInArrow(_block_sets(width), "key long, x int, y int, component long, v long, set binary")
        held = held.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "v")
        links = links.unionByName(written(held.mapInArrow(_links(percent), "a long, b long"), "near-links"))

    # an id with rows in several classes ties their representatives
    ids = some.join(classes, ["c1", "c2"]).select("did", "rep").distinct()
    ties = ids.groupBy("did").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    comps = components(links.unionByName(ties), 2 * (rows_of(links) + rows_of(sketches)))
    discard(reps, counts, prefix, texts, star, dealt, mixed, left)
    named = ids.join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("did", F.coalesce("component", "rep").alias("first")).distinct()
    out = sketches.select("did", "n_shingles").join(named, "did", "left")
    return out.select("did", "n_shingles", F.coalesce("first", "did").alias("first"))


def _low_bytes(sig: str):
    """One byte of each coordinate."""
    return F.concat(*[F.substring(sig, 8 * j + 1, 1) for j in range(K)], F.substring(sig, 8 * K + 1, ALL - K))
