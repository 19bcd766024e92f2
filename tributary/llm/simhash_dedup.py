"""Near-duplicate detection: SimHash fingerprints joined by deletion-variant signatures.

Fingerprint. Text is lower-cased (A-Z only) and split at space and U+0009-U+000D. Each 4-word shingle,
repeats included, is hashed (XXH64, seed 42); a bit is set where more than half the hashes have it. Fewer
words than four form one shingle; no words give fingerprint zero, which links like any other.

Linking at Hamming distance 4 or less. The 64 bits are cut into three segments (22, 21, 21 bits). Four
differing bits over three segments leave one segment with at most one differing bit, so two linked
fingerprints agree on that segment once the right bit is made a wildcard. Each distinct fingerprint is
indexed under its 64 one-wildcard variants (wildcard position, segment without that bit); rows that meet
under one variant are an equality join, and every meeting is verified by popcount. Nothing is capped.

The join is a sort of the variants within hash partitions followed by a scan of equal runs. The scan
returns a spanning forest of each run's verified links instead of all of its pairs: linear output, the
same components. Memory: 24 bytes for each row of a run. Runs hold distinct fingerprints only (copies
have been folded before), so however many rows share one text, it counts once. Keys that very many distinct fingerprints share are
found beforehand in one in HOT_SHARE of the fingerprints (that only decides a route). Their rows are split further without loss: the bits outside the segment are cut into six
parts, of which four differing bits leave two alike, so a row goes to 15 sub-runs, one for each pair of parts.

Components come from alternating large-star and small-star rounds over the links, each written to the
shared folder; tables of past rounds are deleted. Neither links nor labels are ever collected.

keep_one, for a pipeline, looks for more: five-word shingles and a similarity of SIMILARITY or more. There a fingerprint has 512 bits, which tell that
similarity: a share of acos(2s / (1 + s)) / pi of the bits differs, WIDE_DISTANCE of them. The first 128 bits are cut into six segments of 20 bits (8 are not indexed), each indexed under its 20
one-wildcard variants; two fingerprints are candidates when they meet under one and differ in at most MEETING of the 128 bits, and link when all 512 bits verify it. No number of
segments could guarantee a meeting at that distance and stay selective, so links that the fingerprints leave out are added exactly: every two texts whose sets of distinct
shingles have a Jaccard similarity of SIMILARITY or more are linked. Of each distinct set the prefix is indexed that two such sets cannot both lack (shingles by hash; those
that a sample says are frequent come last, which decides a route only). Sets of different groups that meet often enough in their prefixes to reach the similarity are verified on all their shingles.
Sets that the fingerprints have grouped are not compared again, so a large group of near copies costs no pairs. A run of equal shingles is held in memory at 40 bytes a set.

Defined results. Null text counts as empty. component_id is the smallest doc_id in the component; null
doc_ids count only where a component has no other. Rows that repeat a doc_id each get a row. Texts of any length are read whole. Further columns are
not read by near_duplicates and kept by keep_one. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A fingerprint with more than this share of all rows is joined by broadcast: at most 1/SUPPORT rows.
SUPPORT = 0.001
#: Runs up to this many rows are compared pair by pair in one vectorised step.
_SHORT = 8
#: A key is hot, and its rows are split further, if HOT_ROWS or more of one in HOT_SHARE fingerprints have it. There are at most HOT_KEYS: with very many
#: fingerprints more rows make a key hot.
HOT_SHARE, HOT_ROWS, HOT_KEYS = 64, 512, 65_536
#: For keep_one: words of a shingle, least similarity, 64-bit words of a fingerprint, bits of a segment, distance of candidates in the first two
#: words, and that of the similarity in all.
WIDE_SHINGLE, SIMILARITY, WIDE_WORDS, WIDE_SEGMENT, MEETING = 5, 0.8, 8, 20, 26
WIDE_DISTANCE = math.floor(64 * WIDE_WORDS * math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi)
#: The similarity as a fraction; at most this many shingles come last in the order of the exact search: those that occur HOT_SHINGLE times or more in one in
#: SHINGLE_SHARE documents.
_PART, _WHOLE = Fraction(str(SIMILARITY)).as_integer_ratio()
HOT_SHINGLES, HOT_SHINGLE, SHINGLE_SHARE = 131_072, 2, 16
#: Bits of the map that routes texts to the verification; pairs or shingles of a batch.
ROUTE_BITS, _CHUNK = 1 << 22, 1 << 18
_MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's shingles in order, repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, more: int = 0) -> int:
    """Bits of a text's shingles; `more` adds that many words of 64 bits, from further hashes of the shingles' hashes, above the first."""
    return _bits(_shingles(text, shingle, seed), more)


def _bits(hashes: np.ndarray, more: int) -> int:
    out, n = 0, len(hashes)
    if not n:
        return out
    for word in range(1 + more):
        counts = np.zeros(64, np.int64)
        for i in range(0, n, 65536):
            block = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out |= int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) << (64 * word)
        hashes = (hashes + _MIX_1) * _MIX_2
        hashes ^= hashes >> np.uint64(31)
        hashes *= _MIX_1
        hashes ^= hashes >> np.uint64(32)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _segment_of_bit() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By wildcard bit: its segment's first bit, the segment's mask without that bit, and the segment's number."""
    bit = np.arange(64, dtype=np.uint64)
    of = np.array([next(s for s, (a, n) in enumerate(SEGMENTS) if a <= i < a + n) for i in range(64)])
    low = np.array([SEGMENTS[s][0] for s in of], np.uint64)
    mask = np.array([(1 << SEGMENTS[s][1]) - 1 for s in of], np.uint64)
    return low, mask & ~(np.uint64(1) << (bit - low)), of


def _keys(prints: np.ndarray) -> np.ndarray:
    """The 64 one-wildcard keys of each fingerprint."""
    low, keep, _ = _segment_of_bit()
    return ((((prints[:, None] >> low) & keep) << np.uint64(6)) | np.arange(64, dtype=np.uint64)).view(np.int64)


def _pairs_of_parts() -> list[list[np.uint64]]:
    """By segment, masks of two of six parts of the bits outside it, in all 15 combinations."""
    out = []
    for a, n in SEGMENTS:
        bits = [i for i in range(64) if not a <= i < a + n]
        parts = [sum(1 << b for b in bits[j * len(bits) // 6 : (j + 1) * len(bits) // 6]) for j in range(6)]
        out.append([np.uint64(x | y) for x, y in combinations(parts, 2)])
    return out


def _indexed(hot: np.ndarray):
    """Index rows (key, sub, fp); sub is 0 but for the sub-runs of hot keys (sorted)."""

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, segment = _segment_of_bit()
        masks = _pairs_of_parts()
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(prints), 4096):
                part = prints[i : i + 4096]
                keys, fps = _keys(part).ravel(), np.repeat(part, 64)
                crowded = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys if len(hot) else np.zeros(len(keys), bool)
                found = [(keys[~crowded], np.zeros(int((~crowded).sum()), np.int64), fps[~crowded])]
                of = segment[keys & 63]
                for s, pairs in enumerate(masks):
                    k, f = keys[crowded & (of == s)], fps[crowded & (of == s)]
                    for j, m in enumerate(pairs):
                        # The masked bits, with the pair's number where the segment's bits were cleared.
                        found.append((k, ((f & m) | (np.uint64(j + 1) << np.uint64(SEGMENTS[s][0]))).view(np.int64), f))
                k, sub, f = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sub), pa.array(f.view(np.int64))], ["key", "sub", "fp"])

    return variants


def _wide_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows (key, a, b) of two words: 20 variants of each of three segments of both."""
    bit = np.arange(WIDE_SEGMENT, dtype=np.uint64)
    keep = np.uint64((1 << WIDE_SEGMENT) - 1) & ~(np.uint64(1) << bit)
    for batch in batches:
        words = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1)]
        for i in range(0, batch.num_rows, 4096):
            a, b = words[0][i : i + 4096], words[1][i : i + 4096]
            keys = []
            for s in range(6):
                part = (a if s < 3 else b) >> np.uint64(WIDE_SEGMENT * (s % 3))
                keys.append(((part[:, None] & keep) << np.uint64(8)) | (bit + np.uint64(s * WIDE_SEGMENT)))
            k = np.concatenate(keys, axis=1)
            n = k.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), *(pa.array(np.repeat(x, n).view(np.int64)) for x in (a, b))], ["key", "a", "b"])


def _near(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=-1) <= distance


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the graph that joins fps (rows of words) at that distance, as places: breadth first over what is left unseen."""
    left, parents, children = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            pivot = queue.pop()
            near = _near(fps[left], fps[pivot], distance)
            if near.any():
                found = left[near]
                left = left[~near]
                parents.append(np.full(len(found), pivot))
                children.append(found)
                queue.extend(found)
    return (np.concatenate(parents), np.concatenate(children)) if parents else (left[:0], left[:0])


def _run_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys (rows), as places; keys are sorted and runs are whole."""
    edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    start = np.concatenate(([0], edge))
    length = np.diff(np.concatenate((start, [len(keys)])))
    of_row, run = np.repeat(length, length), np.repeat(np.arange(len(start)), length)
    a, b = [], []
    short = np.flatnonzero((of_row > 1) & (of_row <= _SHORT))
    for step in range(1, _SHORT):
        left, right = short[:-step], short[step:]
        same = run[left] == run[right]
        if not same.any():
            break
        left, right = left[same], right[same]
        near = _near(fps[left], fps[right], distance)
        a.append(left[near])
        b.append(right[near])
    for i in np.flatnonzero(length > _SHORT):
        x, y = _forest(fps[start[i] : start[i] + length[i]], distance)
        a.append(x + start[i])
        b.append(y + start[i])
    return (np.concatenate(a), np.concatenate(b)) if a else (start[:0], start[:0])


def _whole_runs(batches: Iterator[pa.RecordBatch], key_columns: list[str], columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and columns of rows sorted by key, cut between runs. A run that spans batches is held until it ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows = (np.stack([batch.column(c).to_numpy() for c in names], axis=1) for names in (key_columns, columns))
        changes = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut == 0 and held and (held[-1][0][-1] == keys[0]).all():
            held.append((keys, rows))
            continue
        whole = [*held, (keys[:cut], rows[:cut])] if cut else held  # a batch of one run, and another than the held one
        held = [(keys[cut:], rows[cut:])]
        if whole:
            yield tuple(np.concatenate(c) for c in zip(*whole, strict=True))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _linker(key_columns: list[str], columns: list[str], distance: int):
    """Scan rows sorted by key and give links: the columns of both ends."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in _whole_runs(batches, key_columns, columns):
            fps = rows.view(np.uint64)
            x, y = _run_links(keys, fps, distance)
            both = [fps[x, i] for i in range(len(columns))] + [fps[y, i] for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in both], [f"x_{c}" for c in columns] + [f"y_{c}" for c in columns])

    return linked


def _hot_keys(distinct: DataFrame) -> np.ndarray:
    """Keys that many distinct fingerprints share, by a sample of them: HOT_KEYS at most, or about that many."""
    least = max(HOT_ROWS, 64 * distinct.count() // HOT_SHARE // HOT_KEYS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).ravel())], ["key"])

    sample = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(HOT_SHARE)) == 0).select("fp").mapInArrow(keys, "key long")
    found = sample.groupBy("key").count().filter(F.col("count") >= least).select("key")
    return np.array(sorted(r["key"] for r in found.collect()), np.int64)


def links(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> links (a, b) that give the components of all fingerprints within DISTANCE bits."""
    index = distinct.select("fp").mapInArrow(_indexed(_hot_keys(distinct)), "key long, sub long, fp long")
    index = index.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    return index.mapInArrow(_linker(["key", "sub"], ["fp"], DISTANCE), "x_fp long, y_fp long").toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), longs -> node, root: the smallest node of each node's component. Every node of an edge occurs.

    Large-star: each node joins its larger neighbours to its smallest neighbour or itself. Small-star: each
    node joins its smaller neighbours and itself to the smallest. Alternating, they end in stars after
    about log(n) rounds. A round costs two aggregates; node degrees are never gathered into a task, as a
    node's smallest neighbour is an aggregate and is joined back.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    past = edges
    while True:
        pairs = both(edges)
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = pairs.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = materialise(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        small = large.join(low, F.col("b") == F.col("n")).select("m", "a", "b")
        small = small.select("m", F.col("a").alias("x")).union(small.select("m", F.col("b").alias("x"))).filter("m <> x")
        new = materialise(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "small")
        # Done when every link is a star: no node is both a centre and a leaf, and no leaf has two centres.
        leaves = new.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
        several = leaves.filter("c > 1").select(F.col("b").alias("x"))
        chained = new.select(F.col("a").alias("x")).join(leaves.select(F.col("b").alias("x")), "x", "left_semi")
        edges = new
        done = several.union(chained).isEmpty()
        discard(past)
        discard(large)
        past = new
        if done:
            break
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def simhash_components(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp), materialised -> doc_id, fingerprint, component_id for every row."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component"))
    linked = grouped.select("fp", "root").join(smallest, "root").select("fp", "component")
    known = distinct.join(linked, "fp", "left").select("fp", "n", "first", F.coalesce("component", "first").alias("component"))
    rows = _of_rows(prints, known, ["fp"])
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))


def _of_rows(prints: DataFrame, known: DataFrame, fp: list[str]) -> DataFrame:
    """prints with the component of their fingerprint, null where a row's own id is its component.

    known(fp, n, first, component) has every fingerprint. Only those with links or with several rows are joined; those with more than a share SUPPORT of all
    rows by a broadcast, so no fingerprint is one task.
    """
    known = materialise(known.filter("n > 1 or component <> first or component is null").select(*fp, "n", "component"), "known")
    total = prints.count()
    often = F.broadcast(known.filter(F.col("n") > total * SUPPORT).select(*fp, "component"))  # at most 1/SUPPORT rows
    seldom = known.filter(F.col("n") <= total * SUPPORT).select(*fp, "component")
    hot = prints.join(often, fp)
    cold = prints.join(often.select(*fp), fp, "left_anti").join(seldom, fp, "left")
    return hot.unionByName(cold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    return simhash_components(materialise(fingerprints(docs, id_col, text_col), "prints"))


def _digest(shingles: np.ndarray) -> np.int64:
    """What a set of shingles (sorted) is known by."""
    return np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED)).astype(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """An array of lists of longs."""
    if not parts:
        return pa.array([], pa.list_(pa.int64()))
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))


def _hot_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles by a sample of rows(doc_id, text), sorted, and the rank of each: the most frequent is last."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_shingles(text.as_py(), WIDE_SHINGLE)).view(np.int64))], ["key"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SHINGLE_SHARE)) == 0).select("text").mapInArrow(shingles, "key long")
    counted = sample.groupBy("key").count().filter(F.col("count") >= HOT_SHINGLE)
    found = counted.orderBy(F.desc("count"), "key").limit(HOT_SHINGLES).select("key").toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], len(keys) - order


def _prefix(shingles: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set (sorted by hash) in the order of all: sets of that similarity share one of these."""
    n = len(shingles)
    length = n - -(-_PART * n // _WHOLE) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        known = hot[at] == shingles
        if known.any():
            shingles = shingles[np.argsort(np.where(known, rank[at], 0), kind="stable")]
    return shingles[:length]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan rows (key, digest, label, size, pos) sorted by key: pairs of sets with different labels that meet at places which the similarity allows."""

    def allowed(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (_, label_i, size_i, pos_i), (_, label_j, size_j, pos_j) = rows[i].T, rows[j].T
        shared = np.minimum(pos_i, pos_j) + np.minimum(size_i - pos_i, size_j - pos_j)  # at most
        return (label_i != label_j) & ((_PART + _WHOLE) * shared >= _PART * (size_i + size_j))

    def out(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        swap = rows[i, 0] > rows[j, 0]
        x, y = rows[np.where(swap, j, i)], rows[np.where(swap, i, j)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[:, 0], y[:, 0], x[:, 2], y[:, 2])], ["x", "y", "x_size", "y_size"])

    for keys, rows in _whole_runs(batches, ["key"], ["digest", "label", "size", "pos"]):
        keys = keys[:, 0]
        start = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        length = np.diff(np.concatenate((start, [len(keys)])))
        of_row = np.repeat(length, length)
        short = np.flatnonzero((of_row > 1) & (of_row <= _SHORT))
        for step in range(1, _SHORT):
            left, right = short[:-step], short[step:]
            same = keys[left] == keys[right]
            if not same.any():
                break
            left, right = left[same], right[same]
            fit = allowed(rows, left, right)
            yield out(rows, left[fit], right[fit])
        for r in np.flatnonzero(length > _SHORT):
            run = rows[start[r] : start[r] + length[r]]
            labels, of, counts = np.unique(run[:, 1], return_inverse=True, return_counts=True)
            if len(labels) == 1:
                continue
            # All pairs but those within a label: each row outside the largest one with that and with the rows behind it.
            largest = of == np.argmax(counts)
            pivots, n = np.flatnonzero(~largest), len(run)
            width = max(1, _CHUNK // n)
            for c in range(0, len(pivots), width):
                some = pivots[c : c + width]
                i, j = np.repeat(some, n), np.tile(np.arange(n), len(some))
                new = largest[j] | (j > i)
                i, j = i[new], j[new]
                fit = allowed(run, i, j)
                yield out(run, i[fit], j[fit])


def _similar_sets(rows: DataFrame, prints: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between labels: of texts with one set of shingles, and of sets whose Jaccard similarity is SIMILARITY or more. None is left out.

    rows(doc_id, text); prints(doc_id, w0, w1, digest, size, prefix); labels(w0, w1, label).
    """
    tagged = materialise(prints.select("digest", "w0", "w1").distinct().join(labels.hint("merge"), ["w0", "w1"]).select("digest", "label").distinct(), "tagged")
    one = tagged.groupBy("digest").agg(F.min("label").alias("one"))
    alike = tagged.join(one.hint("merge"), "digest").filter("label <> one").select(F.col("one").alias("a"), F.col("label").alias("b"))

    # Different sets of that similarity have several shingles; a set is indexed once, however many rows have it.
    least = -(-_PART // (_WHOLE - _PART))
    sets = prints.filter(F.col("size") >= least).select("digest", "size", "prefix").dropDuplicates(["digest"]).join(one.hint("merge"), "digest")
    index = sets.select("digest", F.col("one").alias("label"), "size", F.posexplode("prefix").alias("pos", "key"))
    index = index.select("key", "digest", "label", "size", F.col("pos").cast("long").alias("pos")).repartition("key").sortWithinPartitions("key")
    met = index.mapInArrow(_meetings, "x long, y long, x_size long, y_size long").groupBy("x", "y", "x_size", "y_size").agg(F.count(F.lit(1)).alias("met"))
    # Behind the prefix that ends first each set has at most so many shingles more.
    behind = F.ceil(F.lit(_PART) * F.greatest("x_size", "y_size") / _WHOLE) - 1
    met = materialise(met.filter((F.col("met") + behind) * (_PART + _WHOLE) >= F.lit(_PART) * (F.col("x_size") + F.col("y_size"))).select("x", "y", "x_size", "y_size"), "met")

    # The texts of these sets, by a map of bits over their ids, are read again.
    needed = met.select(F.col("x").alias("digest")).union(met.select("y")).distinct()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(ROUTE_BITS))
    carrier = prints.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(needed.hint("merge"), "digest", "left_semi")
    bits = np.zeros(ROUTE_BITS, bool)
    for r in carrier.select((slot + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect():
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        place = (r["bucket"] - 1) * len(part)
        np.logical_or(bits[place : place + len(part)], part[: len(bits) - place], out=bits[place : place + len(part)])
    packed = np.packbits(bits)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        for batch in batches:
            found: list[np.ndarray] = []
            for i in np.flatnonzero(wanted[batch.column(0).to_numpy()]):
                found.append(np.unique(_shingles(batch.column(1)[int(i)].as_py(), WIDE_SHINGLE)))
                if sum(map(len, found)) >= _CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([_digest(f) for f in found], pa.int64()), _lists(found)], ["digest", "shingles"])
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([_digest(f) for f in found], pa.int64()), _lists(found)], ["digest", "shingles"])

    again = rows.select(slot.alias("slot"), "text").mapInArrow(whole, "digest long, shingles array<long>")
    again = materialise(again.join(needed.hint("merge"), "digest", "left_semi").dropDuplicates(["digest"]), "shingles")
    for end in ("x", "y"):
        met = met.join(again.select(F.col("digest").alias(end), F.col("shingles").alias(f"{end}_shingles")).hint("merge"), end)
    shared = F.size(F.array_intersect("x_shingles", "y_shingles"))
    met = met.filter(shared * (_PART + _WHOLE) >= F.lit(_PART) * (F.col("x_size") + F.col("y_size"))).select("x", "y")
    for end, name in (("x", "a"), ("y", "b")):
        met = met.join(one.select(F.col("digest").alias(end), F.col("one").alias(name)).hint("merge"), end)
    return alike.union(met.select("a", "b"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, component_id for each row of docs: groups of texts that link at SIMILARITY of their five-word shingles.

    Without `exact` these are the links that the fingerprints find; with it every pair of that Jaccard similarity is linked too.
    """

    words = [f"w{i}" for i in range(WIDE_WORDS)]
    meet, rest = words[:2], words[2:]
    names = ["doc_id", *words, *(["digest", "size", "prefix"] if exact else [])]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot, rank = _hot_shingles(rows) if exact else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, digests, sizes, prefixes = [], [], [], []
            for t in batch.column(1):
                shingles = _shingles(t.as_py(), WIDE_SHINGLE)
                prints.append(_bits(shingles, WIDE_WORDS - 1))
                if exact:
                    shingles = np.unique(shingles)
                    digests.append(_digest(shingles))
                    sizes.append(len(shingles))
                    prefixes.append(_prefix(shingles, hot, rank))
            parts = (np.array([p >> 64 * i & (2**64 - 1) for p in prints], np.uint64) for i in range(WIDE_WORDS))
            columns = [batch.column(0), *(pa.array(w.view(np.int64)) for w in parts)]
            if exact:
                columns += [pa.array(digests, pa.int64()), pa.array(sizes, pa.int64()), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays(columns, names)

    prints = materialise(rows.mapInArrow(wide, ", ".join(f"{c} array<long>" if c == "prefix" else f"{c} long" for c in names)), "wide")
    distinct = prints.groupBy(*meet).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.struct(*rest)).alias("rest"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    index = distinct.select(*meet).mapInArrow(_wide_index, "key long, a long, b long").repartition("key").sortWithinPartitions("key", "a", "b")
    found = index.mapInArrow(_linker(["key"], ["a", "b"], MEETING), "x_a long, x_b long, y_a long, y_b long").distinct()
    for end in ("x", "y"):  # links are few beside the fingerprints
        node = distinct.select(F.col("w0").alias(f"{end}_a"), F.col("w1").alias(f"{end}_b"), F.col("node").alias(end), F.col("rest").alias(f"{end}_rest"))
        found = found.join(node, [f"{end}_a", f"{end}_b"])
    differ = F.bit_count(F.col("x_a").bitwiseXOR(F.col("y_a"))) + F.bit_count(F.col("x_b").bitwiseXOR(F.col("y_b")))
    for w in rest:
        differ = differ + F.bit_count(F.col(f"x_rest.{w}").bitwiseXOR(F.col(f"y_rest.{w}")))
    found = found.filter(differ <= WIDE_DISTANCE)
    roots = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labels = distinct.join(roots, "node", "left").select(*meet, "n", "first", F.coalesce("root", "node").alias("label"))
    if exact:
        labels = materialise(labels, "labels")
        groups = components(_similar_sets(rows, prints, labels.select(*meet, "label")))
        labels = labels.join(groups, F.col("label") == F.col("node"), "left").select(*meet, "n", "first", F.coalesce("root", "label").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("first").alias("component"))
    known = labels.join(smallest, "label").select(*meet, "n", "first", "component")
    return _of_rows(prints.select("doc_id", *meet), known, meet).select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when each group of similar texts (similar_groups, exact) keeps its smallest doc_id; of rows that repeat that id, one.

    Only the ids that go are joined with the texts. They grow with the data, so that join is a shuffle at every size. Rows
    without an id stay.
    """
    found = materialise(similar_groups(docs, id_col, text_col, exact=True).select(F.col("doc_id").alias("_id"), "component_id"), "components")
    gone = found.filter("_id <> component_id").select("_id").distinct()
    again = materialise(found.filter("_id = component_id").groupBy("_id").count().filter("count > 1").select("_id"), "again")
    # The rows travel as one struct, so no column of docs meets one of the operator's own.
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_doc"))
    key = F.col("_doc") == F.col("_id")
    if again.isEmpty():  # no id repeats: one join, so the texts move once
        kept = rows.join(gone.hint("merge"), key, "left_anti")
    else:
        kept = rows.join(gone.union(again).hint("merge"), key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates(["_doc"]))
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
