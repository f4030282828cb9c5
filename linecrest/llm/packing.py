"""Best-fit packing of tokenised documents by linear grouping.

A packing depends on the lengths alone, and a length is a whole number up to the capacity. So the plan is made on the
driver from the histogram of lengths (at most `capacity` counts, whatever the corpus), and the documents are substituted
by their rank within their length:

1. Lengths above `capacity * small` are large. Sorted down and cut into `groups` groups of equal cardinality, each
   counts as the largest of its group (linear grouping).
2. For these few sizes a linear program over configurations (which sizes share a sequence) is solved by column
   generation, and its counts are rounded down.
3. The actual documents take the places of their group's size, so what was rounded up becomes room.
4. What is left over and the small documents go best-fit decreasing into the fullest sequence that has room.

Nulls and empty texts are a single end-of-text token; equal rows are packed one by one; texts count whole, however long;
other columns of documents are not used; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: Distinct pieces of text between spaces whose ids a Python worker keeps.
KNOWN = 600_000
#: Shards of a length within which documents are ranked, so that no length is one task: so many at least, and more where
#: a shard would have more rows.
SHARDS, SHARD_ROWS = 256, 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids(dict):
    """The ids of texts, as little-endian 32-bit numbers. A space before a visible character always begins a token,
    unless white space stands on both sides of it; so such texts are cut at spaces and each part is looked up."""

    _uneven = re.compile(r"\s \s| \Z")

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._whole = Tokenizer.from_file(json_path)
        self._special = special

    def __missing__(self, part: str) -> bytes:
        found = array("I", self._fast(" " + part)).tobytes()
        if len(self) < KNOWN:
            self[part] = found
        return found

    def of(self, text: str) -> bytes:
        if self._special in text or self._uneven.search(text):
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        return b"".join([array("I", self._fast(first)).tobytes(), *map(self.__getitem__, rest)])


_ids: dict[tuple, _Ids] = {}


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, special: str = "<|endoftext|>") -> DataFrame:
    """Each document's ids and a 0, cut from its end into pieces of `capacity` tokens; the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        key = (tokenizer, special)
        if key not in _ids:
            _ids[key] = _Ids(public_tokenizers.path(f"{tokenizer}.json"), public_tokenizers.path(f"{tokenizer}.tiktoken"), public_tokenizers.PATTERN, special)
        ids_of = _ids[key].of
        for batch in common.slices(batches):
            rows, times = [], []
            for text in batch.column("text").to_pylist():
                ids = (ids_of(text) if text else b"") + b"\0\0\0\0"
                n = len(ids) // 4
                end = n % capacity or capacity
                start = 0
                times.append(-(-n // capacity))
                for k in range(times[-1]):
                    rows.append((k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end = end, end + capacity
            if rows:
                k, start, length, crc = zip(*rows, strict=True)
                yield common.repeat_rows(batch, ["doc_id"], np.array(times), piece=pa.array(k, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


# --- the plan ---------------------------------------------------------------------------------------------------------


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the sizes and how often each is used: the linear program's optimum, rounded down."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    used = demand / np.diag(basis)
    for _ in range(60 * m):
        prices = np.linalg.solve(basis.T, np.ones(m))
        pattern, worth = _best_pattern(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern)
        ratios = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratios))
        used = np.maximum(used - ratios[leaves] * step, 0)
        used[leaves] = ratios[leaves]
        basis[:, leaves] = pattern
    return [(np.rint(basis[:, i]).astype(int), int(used[i] + 1e-6)) for i in range(m) if used[i] + 1e-6 >= 1]


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration that is worth most at the prices: a knapsack, item by item."""
    most = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(most):
        worth, pick = best.copy(), np.full(capacity + 1, -1)
        for i in np.flatnonzero(prices > 1e-12):
            s = int(sizes[i])
            with_i = best[:-s] + prices[i]
            better = with_i > worth[s:] + 1e-12
            worth[s:][better], pick[s:][better] = with_i[better], i
        picks.append(pick)
        if (pick < 0).all():
            break
        best = worth
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            pattern[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return pattern, float(best[capacity])


class Plan:
    """Places for the n-th piece of each length: runs of sequences with the same offset."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = 256, small: float = 1 / 3):
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int]]] = {n: [] for n in counts}  # length: (rank, sequence, offset)
        self._room: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
        self._rooms: list[int] = []
        left = {n: c for n, c in counts.items() if c}
        ranks = dict.fromkeys(counts, 0)
        whole = left.pop(capacity, 0)
        if whole:
            self._place(capacity, 0, self._open(whole), 0)
        large = sorted((n for n in left if n > capacity * small), reverse=True)
        total = sum(left[n] for n in large)
        if total:
            each = -(-total // groups)
            members: list[list[list[int]]] = [[]]  # of each group: [length, count], down
            room = each
            for n in large:
                c = left[n]
                while c:
                    if not room:
                        members.append([])
                        room = each
                    take = min(c, room)
                    members[-1].append([n, take])
                    c, room = c - take, room - take
            # groups that count as the same size are one
            merged: list[list[list[int]]] = []
            for g in members:
                if merged and merged[-1][0][0] == g[0][0]:
                    merged[-1] += g
                else:
                    merged.append(g)
            sizes = np.array([g[0][0] for g in merged])
            demand = np.array([sum(c for _, c in g) for g in merged], float)
            for pattern, times in configurations(sizes, demand, capacity):
                self._substitute(pattern, times, merged, left, ranks)
        for n in sorted(left, reverse=True):
            self._best_fit(n, ranks[n], left[n])

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _place(self, length: int, rank: int, sequence: int, offset: int) -> None:
        self.runs[length].append((rank, sequence, offset))

    def _keep(self, room: int, first: int, n: int) -> None:
        if room:
            if room not in self._room:
                bisect.insort(self._rooms, room)
            self._room.setdefault(room, []).append((first, n))

    def _substitute(self, pattern: np.ndarray, times: int, members: list, left: dict, ranks: dict) -> None:
        """Actual documents into `times` sequences of a configuration."""
        slots = []
        for g in np.flatnonzero(pattern):
            for _ in range(int(pattern[g])):
                slot, need = [], times
                while need and members[g]:
                    n, c = members[g][0]
                    take = min(c, need)
                    slot.append((n, take))
                    need -= take
                    if take == c:
                        members[g].pop(0)
                    else:
                        members[g][0][1] -= take
                slots.append(slot)
        first, done = self._open(times), 0
        heads = [[0, 0] for _ in slots]  # run of the slot, taken of it
        while done < times:
            now = [(slot[h[0]][0], slot[h[0]][1] - h[1]) if h[0] < len(slot) else (0, times - done) for slot, h in zip(slots, heads, strict=True)]
            step = min(c for _, c in now)
            offset = 0
            for n, _ in now:
                if n:
                    self._place(n, ranks[n], first + done, offset)
                    ranks[n] += step
                    left[n] -= step
                    offset += n
            self._keep(self.capacity - offset, first + done, step)
            for slot, h in zip(slots, heads, strict=True):
                h[1] += step
                if h[0] < len(slot) and h[1] == slot[h[0]][1]:
                    h[:] = [h[0] + 1, 0]
            done += step

    def _best_fit(self, length: int, rank: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self._rooms, length)
            if at < len(self._rooms):
                room = self._rooms[at]
                first, n = self._room[room].pop()
                if not self._room[room]:
                    del self._room[room]
                    self._rooms.pop(at)
            else:
                room, n = self.capacity, -(-count // (self.capacity // length))
                first = self._open(n)
            each = min(room // length, count)
            bins = min(n, count // each)
            if bins < n:
                self._keep(room, first + bins, n - bins)
            for k in range(each):
                self._place(length, rank, first, self.capacity - room + k * length)
                rank += bins
            count -= bins * each
            self._keep(room - each * length, first, bins)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = 256, shards: int = SHARDS) -> DataFrame:
    """Columns sequence_id and offset for pieces of the columns doc_id, piece and length; other columns stay.
    pieces should be a stored table: it is read twice."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = Plan(counts, capacity, groups)
    starts, sequences, offsets = {}, {}, {}
    for n, runs in plan.runs.items():
        runs.sort()
        starts[n], sequences[n], offsets[n] = (np.array([r[i] for r in runs], np.int64) for i in range(3))
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast((starts, sequences, offsets))  # its size follows from the capacity and groups, not from the corpus

    from pyspark.sql import Window

    shards = max(shards, -(-max(counts.values(), default=0) // SHARD_ROWS))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", *(c for c in ("ids_crc32",) if c in pieces.columns)), F.lit(shards)).cast("int"))
    before = dealt.groupBy("length", "_shard").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.join(before.select("length", "_shard", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_shard"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece")) - 1)
    kept = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sequences, offsets = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                run = np.searchsorted(starts[n], rank[own], "right") - 1
                sequence[own] = sequences[n][run] + rank[own] - starts[n][run]
                offset[own] = offsets[n][run]
            yield common.with_columns(batch, kept, sequence_id=sequence, offset=offset)

    return ranked.select(*kept, F.col("_rank").cast("long").alias("_rank")).mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequence and offset. Each document is tokenised once, into a table of the
    shared folder."""
    return pack(common.stage(pieces(docs, tokenizer, capacity), "pieces"), capacity)
