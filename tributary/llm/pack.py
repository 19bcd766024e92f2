"""Best-fit packing by bin completion branch-and-bound over the histogram of lengths.

Pieces have whole lengths from 1 to CAPACITY, so however many documents there are, the packing problem is
a histogram of at most CAPACITY counts. That histogram alone comes to the driver; the solution, at most a few
thousand patterns (a filling and how often it is used), goes back. Documents stay where they are.

Search. A node takes the largest remaining length and enumerates all fillings of the rest of its sequence, lazily: from the
least waste up, within a waste largest parts first. Sums that the remaining lengths cannot make are known from a table of bits, so no time goes into them. A
filling that another one dominates (its parts fit into the other's parts) is dropped: at once where a remaining length fits
into its waste, else by comparison with the last COMPARED fillings of its node. A filling is used as often as the counts allow, then once less, and so
on, and what follows for the same length comes later in the order, so equal documents are not branched on and no solution is met twice. The
first descent takes the best fit at every node and is the first incumbent; a node is pruned
when the waste so far exceeds what an improvement on the incumbent may waste. The search ends when the
incumbent meets the lower bound, when everything has been tried (the incumbent is then optimal), or after NODES fillings with the best incumbent so far.
The gap to the bound is logged. On the first descent each use of a filling
uses up at least one length, or leaves fewer of it than one filling takes, so patterns stay below
sum(CAPACITY / length), about 16,000.

Placing. The n-th piece of a length (n counts within hash buckets of the length, then over them, so
no task ranks a whole length) has its sequence and offset by a binary search in the solution.

Tokens. ids are those of the byte_bpe tokenizer file. For Latin-1 text the file's vocabulary and merges are
run by a rank-based encoder, about four times faster than the tokenizer itself; texts with other characters,
with very long unbroken runs or with a special token's string go to the tokenizer. Both ways give the same ids.

Defined results. Null text is empty; every document ends in id 0, so an empty one has length 1. Rows that
repeat a doc_id are packed each. Texts of any length are read whole, a document at a time. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import logging
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

CAPACITY, END_ID, NODES = 2048, 0, 20_000
#: Fillings of a node that a new one is compared with for dominance; fewer only prune less.
COMPARED = 64
#: Pieces that one rank bucket of a length should hold at most when every piece had that length.
BUCKET_ROWS = 20_000
#: The tokenizer's own pretoken pattern, a fixed value of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG = re.compile(r"\S{1000}|\s{1000}")
_SPECIAL = "<|endoftext|>"
_log = logging.getLogger(__name__)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes each byte as one character: printable Latin-1 as itself, the rest from U+0100 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Ids:
    """Token ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._merger(path)

    @staticmethod
    def _merger(path: str):
        """The same merges by rank, about four times faster; None unless ids grow in the order of the merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kind = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        special, alphabet = {t["content"] for t in spec["added_tokens"]}, _byte_alphabet()
        if special - {_SPECIAL}:
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("byte_level", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        try:  # classes of newer characters may differ between Unicode versions: those texts go the plain way
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if self.fast is None or _SPECIAL in text or _LONG.search(text):
            return self.whole(text)
        return np.array(self.fast(text), "<u4").tobytes()


@lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    """Loaded once a worker process, not once a task: a load takes over a hundred megabytes for a moment."""
    return Ids(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    return path


def _cutter(path: str | None, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(_tokenizer_path(path))
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            docs, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids.encode(text.as_py() or "") + end
                n = len(data) // 4
                at, size = 0, n if n <= capacity else n % capacity or capacity
                while at < n:
                    docs.append(doc)
                    piece.append(0 if at == 0 else piece[-1] + 1)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    at, size = at + size, capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return cut


# --- bin completion ------------------------------------------------------------------------------------


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the parts of b fit into bins of the sizes in a (both descending)."""
    if sum(b) > sum(a):
        return False
    room = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[j] -= b[i]
                if place(i + 1):
                    return True
                room[j] += b[i]
        return False

    return len(b) <= 8 and place(0)


def _sums(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """By i, the sums up to room that the first i lengths can make, as bits."""
    out, mask = [1], (1 << (room + 1)) - 1
    for k in lengths:
        bits, left, step = out[-1], min(counts[k], room // k), 1
        while left:
            take = min(step, left)
            bits |= bits << (take * k)
            left, step = left - take, step * 2
        out.append(bits & mask)
    return out


def fillings(lengths: list[int], counts: list[int], room: int) -> Iterator[tuple[int, tuple[int, ...] | None]]:
    """(waste, parts) of all fillings of `room` from the lengths at hand (ascending), by waste, then larger parts first.

    Parts are None where a length that is left fits into the waste, so that the caller can count these too.
    """
    lengths = lengths[: bisect_right(lengths, room)]
    sums = _sums(lengths, counts, room)

    def exact(i: int, target: int, chosen: list[int]) -> Iterator[tuple[int, ...]]:
        if not target:
            yield tuple(chosen)
        while target and (i := min(i, bisect_right(lengths, target))) and sums[i] >> target & 1:
            i -= 1
            k = lengths[i]
            for n in range(min(counts[k], target // k), 0, -1):
                if sums[i] >> (target - n * k) & 1:
                    yield from exact(i, target - n * k, chosen + [k] * n)

    for waste in range(room + 1):
        if sums[-1] >> (room - waste) & 1:
            for parts in exact(len(lengths), room - waste, []):
                fits = waste and any(counts[k] > parts.count(k) for k in lengths[: bisect_right(lengths, waste)])
                yield waste, None if fits else parts


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum of lengths, and by every threshold below which lengths are left out (Martello and Toth's L2)."""
    n, size = np.zeros(capacity + 2, np.int64), np.arange(capacity + 2)
    for k, c in counts.items():
        n[k] = c
    number, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * size)))  # of lengths below k
    best, half = -(-int(total[-1]) // capacity), capacity // 2
    for low in range(half + 1):
        large, middle = int(number[-1] - number[capacity - low + 1]), int(number[capacity - low + 1] - number[half + 1])
        rest = int(total[half + 1] - total[low]) - (middle * capacity - int(total[capacity - low + 1] - total[half + 1]))
        best = max(best, large + middle + max(0, -(-rest // capacity)))
    return best


class _Options:
    """What a node may do for its largest length: a filling, and how often it is used."""

    def __init__(self, top: int, lengths: list[int], counts: list[int], capacity: int, after: tuple | None):
        self.top, self.after, self.kept, self.now, self.copies = top, after, [], None, 0
        counts = counts.copy()
        counts[top] -= 1  # another document of this length may be among the filling
        self.source = fillings(lengths if counts[top] else lengths[:-1], counts, capacity - top)

    def following(self) -> bool:
        """Go to the next undominated filling after `after`; False at the end. Each filling looked at is one call."""
        self.now = None
        for waste, parts in self.source:
            if parts is None:
                return True
            key = (waste, tuple(-x for x in parts))
            dominated = any(dominates(other, parts) for other in self.kept[-COMPARED:])
            if not dominated:
                self.kept.append(parts)
            if not dominated and (self.after is None or key > self.after):
                self.now = (key, (self.top, *parts))
            return True
        return False


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """histogram{length: count} -> [(filling, copies)] with every length used exactly count times."""
    counts = [0] * (capacity + 1)
    for k, n in histogram.items():
        counts[k] = n
    lengths = sorted(k for k, n in histogram.items() if n)
    total, least = sum(k * n for k, n in histogram.items()), lower_bound(histogram, capacity)
    best: list[tuple[tuple[int, ...], int]] = []
    best_bins, bins, waste, seen = 0, 0, 0, 0
    path: list[tuple[tuple[int, ...], int]] = []  # of the nodes above
    stack: list[_Options] = []

    def change(filling: tuple[int, ...], copies: int) -> None:
        for k in set(filling):
            before = counts[k]
            counts[k] += copies * filling.count(k)
            at = bisect_right(lengths, k)
            if before == 0:
                lengths.insert(at, k)
            elif counts[k] == 0:
                del lengths[at - 1]

    if lengths:
        stack.append(_Options(lengths[-1], lengths, counts, capacity, None))
    while stack:
        node = stack[-1]
        if len(path) == len(stack):  # back from a child: its filling once less
            filling, copies = path.pop()
            change(filling, copies)
            bins, waste = bins - copies, waste - copies * (capacity - sum(filling))
            node.copies = copies - 1
        room = (best_bins - 1) * capacity - total - waste if best_bins else None  # waste that an improvement still allows
        if node.now and room is not None:
            lost = capacity - sum(node.now[1])
            node.copies = min(node.copies, room // lost) if lost else node.copies if room >= 0 else 0
        if not node.now or node.copies <= 0:
            more = node.following()
            seen += 1
            if node.now:
                lost = capacity - sum(node.now[1])
                if room is not None and lost > room:  # later fillings waste as much
                    more = False
                node.copies = min(counts[k] // node.now[1].count(k) for k in set(node.now[1]))
            if not more:
                stack.pop()
            if best_bins and seen >= nodes:
                break
            continue
        key, filling = node.now
        change(filling, -node.copies)
        path.append((filling, node.copies))
        bins, waste = bins + node.copies, waste + node.copies * (capacity - sum(filling))
        if lengths:
            stack.append(_Options(lengths[-1], lengths, counts, capacity, key if lengths[-1] == node.top else None))
        elif not best_bins or bins < best_bins:
            best, best_bins = list(path), bins
            if best_bins <= least:
                break
    _log.info("%d sequences, lower bound %d, %d fillings looked at", best_bins, least, seen)
    return best


class Placement:
    """Where the n-th piece of each length goes: runs of ranks, found by binary search."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        runs, ranks, base = [], {}, 0
        for filling, copies in patterns:
            offset = 0
            for k in sorted(set(filling), reverse=True):
                per = filling.count(k)
                runs.append((k, ranks.get(k, 0), per, base, offset))
                ranks[k] = ranks.get(k, 0) + per * copies
                offset += per * k
            base += copies
        runs.sort()
        self.length, self.rank, self.per, self.base, self.offset = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 5

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 48) | self.rank, (length << 48) | rank, side="right") - 1
        nth = rank - self.rank[at]
        return self.base[at] + nth // self.per[at], self.offset[at] + nth % self.per[at] * length


def _placer(where: Placement):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = where.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(text.mapInArrow(_cutter(tokenizer, capacity), PIECES), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    where = Placement(complete_bins(histogram, capacity))

    buckets = max(16, sum(histogram.values()) // BUCKET_ROWS)
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")).select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_nth", F.row_number().over(within)).join(offsets, ["length", "_b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_nth") - 1).cast("long").alias("_rank"))
    return ranked.mapInArrow(_placer(where), f"{PIECES}, sequence_id long, offset long")


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
