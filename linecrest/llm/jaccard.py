"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles, and two link when their Jaccard index reaches the threshold. Equal sets are one
class. The work is dealt out by families, so that every set is sent to one place only:

1. With all shingles in one fixed order, two sets that link share at least l shingles of their prefixes, the first
   n - ceil(t n) + l of either (of the smaller one even the first n - ceil(2 t / (1 + t) n) + l). The order puts shingles
   that many documents have at the end, so prefixes meet where texts are alike and not where they share a common line.
   Classes that share fewer prefix shingles with all others together can link with none. A sketch gives a first order;
   for the classes that are left their shingles are counted, and the rarest come first in a second one.
2. What remains falls into families: classes that shared prefix shingles connect. No link leaves a family.
3. A family's classes are the leaves of a signature tree. Its nodes hold the OR of their members' token bitmaps and the
   range of their sizes. Two nodes are walked at once, the pair with the greatest possible overlap first; a pair is
   dropped when its bitmaps and sizes allow no link, or when all its members are in one component by then. Leaves are
   compared at once, so a walk returns no candidates but the links of a spanning forest.

Families too large for one tree are cut into blocks. Each block is walked by itself, then members of every block's
components together, and at last those outside of the family's largest component with every block. The result is exact
but for equal 48-bit hashes of shingles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
HASH_BYTES = 6
#: Slots of the sketch that tells shingles of many documents.
SLOT_BITS = 22
#: A prefix is longer by one of so many shingles, and as many have to be shared.
SHARED_PART = 20
#: Most members and shingles of a block that a tree is built of, and 64-bit words of all its bitmaps.
MEMBERS, SHINGLES, BITMAP_WORDS = 4096, 1 << 21, 1 << 22
LEAF, FANOUT = 32, 8


# --- sets -------------------------------------------------------------------------------------------------------------


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the whole text, A-Z in lower case; of a text with fewer words,
    the one hash of all its words; empty without words."""
    w, _, _ = common.word_hashes(text)
    if not len(w):
        return np.empty(0, np.uint64)
    s = common.shingle_hashes(w, k) if len(w) >= k else common.mix(common.shingle_hashes(w, len(w)) + np.uint64(len(w)))
    return np.unique(s >> np.uint64(64 - 8 * HASH_BYTES))


def _pack(s: np.ndarray) -> bytes:
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def shingle_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n, fp and check (two hashes of the set) and tokens, for every row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            n, fp, check, tokens = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                with np.errstate(over="ignore"):
                    fp.append(common.mix(np.array([np.bitwise_xor.reduce(common.mix(s)) if len(s) else 0, len(s)], np.uint64)).sum(dtype=np.uint64))
                    check.append(common.mix(s + np.uint64(0x51ED27)).sum(dtype=np.uint64))
                n.append(len(s))
                tokens.append(_pack(s))
            yield common.with_columns(batch, ["doc_id", "text_hash"], n=np.array(n, np.int32), fp=np.array(fp, np.uint64).view(np.int64), check=np.array(check, np.uint64).view(np.int64), tokens=pa.array(tokens, pa.binary()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(build, "doc_id long, text_hash long, n int, fp long, check long, tokens binary")


def told_apart(sets: DataFrame) -> DataFrame:
    """A staged table of sets in which fp is the same for equal sets only. Of different sets with the same 64-bit fp
    all but the least (n, check) get another one."""
    while True:
        facts = sets.groupBy("fp").agg(F.min(F.struct("n", "check")).alias("x"), F.max(F.struct("n", "check")).alias("y"))
        clash = common.stage(facts.where("x <> y").select("fp", "x"), "clash")
        if clash.isEmpty():
            common.discard(clash)
            return sets
        other = F.col("x").isNotNull() & (F.struct("n", "check") != F.col("x"))
        parted = sets.join(clash, "fp", "left").withColumn("fp", F.when(other, F.xxhash64("fp", "n", "check")).otherwise(F.col("fp"))).select(*sets.columns)
        again = common.stage(parted, "sets")
        common.discard(sets, clash)
        sets = again


# --- prefixes ---------------------------------------------------------------------------------------------------------


def frequent_slots(sets: DataFrame) -> np.ndarray:
    """A bitmap of 2**SLOT_BITS bits over hashes of shingles: those that many documents have. It only chooses the order
    of shingles; any choice gives the same links. Every partition counts all of its sets and reports the slots that
    stand out from its mean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        total, held, waiting = 0, [], 0

        def add() -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            slots[at] += n

        for batch in batches:
            for data in batch.column("tokens"):
                held.append((_unpack(data.as_py()) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64))
                total, waiting = total + len(held[-1]), waiting + len(held[-1])
                if waiting > 1 << 20:
                    add()
                    held, waiting = [], 0
        if held:
            add()
        high = np.flatnonzero(slots > 8 + 4 * total / (1 << SLOT_BITS))
        yield pa.RecordBatch.from_arrays([pa.array((high >> 6).astype(np.int32)), pa.array((np.uint64(1) << (high & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    found = sets.select("tokens").mapInArrow(count, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()  # 2**(SLOT_BITS - 6) rows at most
    out = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    for r in found:
        out[r["word"]] = r["bits"]
    return out


def in_order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the order of prefixes: rare shingles first, each part by its hash."""
    slot = (s & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
    often = (frequent[slot >> 6] >> (slot & 63)) & 1 == 1
    return np.concatenate([s[~often], s[often]])


def least_shared(n):
    """How many prefix shingles a set of n has to share with a set that is not smaller and links with it."""
    return np.maximum(1, np.asarray(n) // SHARED_PART)


def prefix_length(n, percent: int = PERCENT):
    n = np.asarray(n, np.int64)
    return np.minimum(n, n - -(-percent * n // 100) + least_shared(n))


def short_length(n, percent: int = PERCENT):
    """The part of the prefix that is enough of the smaller of two sets: they have to share 2 t / (1 + t) of its n."""
    n = np.asarray(n, np.int64)
    return np.minimum(n, n - -(-2 * percent * n // (100 + percent)) + least_shared(n))


#: Sets that a task remembers, so that it gives the shingles of equal sets once.
REMEMBERED = 1_000_000


def prefixes(sets: DataFrame, frequent, percent: int = PERCENT) -> DataFrame:
    """token, fp, n and short: a row for each shingle of each set's prefix; short: it is of the prefix's short part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, told = frequent.value, set()
        for batch in common.slices(batches):
            new = []
            for i, fp in enumerate(batch.column("fp").to_pylist()):
                if fp not in told:
                    told.add(fp)
                    new.append(i)
            if len(told) > REMEMBERED:
                told.clear()
            batch = batch.take(pa.array(new, pa.int64()))
            n = batch.column("n").to_numpy().astype(np.int64)
            sizes = prefix_length(n, percent)
            parts = [in_order(_unpack(t.as_py()), slots)[:size] for t, size in zip(batch.column("tokens"), sizes.tolist(), strict=True)]
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            token = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(batch.column("fp").to_numpy(), sizes)), pa.array(np.repeat(n, sizes).astype(np.int32)), pa.array(place < np.repeat(short_length(n, percent), sizes))], ["token", "fp", "n", "short"])

    return sets.select("fp", "n", "tokens").where("n > 0").mapInArrow(cut, "token long, fp long, n int, short boolean")


ROWS = "token long, fp long, n int, short boolean"


def with_partners(tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows (token, fp, n, short) of prefixes that another set's row may link with: of two sets that link, the
    smaller has the token in its short part and the sizes are near. In order of size the nearest row that counts tells
    it, so rows pass in a stream and a bucket of any size takes no memory."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_short = None, -1  # the last row, which waits for the next, and the size of the last short row before it
        out = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "fp", "n", "short"])

        for batch in batches:
            token, fp, n, short = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "fp", "n", "short"))
            if held is not None:
                token, fp, n, short = (np.concatenate([h, c]) for h, c in zip(held, (token, fp, n, short), strict=True))
            if not len(token):
                continue
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
            token, fp, n, short = token[fresh], fp[fresh], n[fresh].astype(np.int64), short[fresh]
            begins = np.concatenate([[True], token[1:] != token[:-1]])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(token)), 0))
            last_short = np.concatenate([[-1], np.maximum.accumulate(np.where(short, np.arange(len(token)), -1))[:-1]])
            before = np.where(last_short >= first, n[np.maximum(last_short, 0)], np.where(first == 0, held_short, -1))
            good = 100 * before >= percent * n
            good[:-1] |= short[:-1] & ~begins[1:] & (100 * n[:-1] >= percent * n[1:])
            some = np.flatnonzero(good[:-1])
            yield out(token[some], fp[some], n[some].astype(np.int32), short[some])
            held, held_short = (token[-1:], fp[-1:], n[-1:].astype(np.int32), short[-1:]), int(before[-1])
        if held is not None and 100 * held_short >= percent * int(held[2][0]):
            yield out(*held)

    return tokens.repartition("token").sortWithinPartitions("token", "n", "fp").mapInArrow(keep, ROWS)


def that_may_link(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of classes that share enough prefix shingles with all others together: as many as with the smallest set
    that they may link with."""
    smallest = F.ceil(F.col("n") * percent / 100)
    enough = rows.groupBy("fp", "n").agg(F.count("*").alias("_shared")).where(F.col("_shared") >= F.greatest(F.lit(1), F.floor(smallest / SHARED_PART)))
    return rows.join(enough.select("fp"), "fp")


#: Classes of a shingle beyond which it counts as so frequent.
MOST_COUNTED = 256


def rarest_first(sets: DataFrame, classes: DataFrame, frequent, percent: int = PERCENT) -> DataFrame:
    """The rows of prefixes again, for classes (fp) only and in the order of how many of them have a shingle; shingles of
    frequent slots stay last. Shingles of one class only come first but need no row."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = frequent.value
        for batch in common.slices(batches):
            parts, places = [], []
            for t, size in zip(batch.column("tokens"), prefix_length(batch.column("n").to_numpy(), percent).tolist(), strict=True):
                s = in_order(_unpack(t.as_py()), slots)
                slot = (s & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
                rare = int(((slots[slot >> 6] >> (slot & 63)) & 1 == 0).sum())
                parts.append(s[: max(size, rare)])
                places.append(np.arange(len(parts[-1])) >= rare)
            sizes = np.array([len(x) for x in parts], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts or [np.empty(0)]).astype(np.int64)), *(pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("fp", "n")), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate(places or [np.empty(0)]).astype(bool))], ["token", "fp", "n", "m", "often"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "fp", "n", "m", "often"]
        held, begun = None, 0  # rows of a shingle that goes on, and how many of it are out already

        def out(columns: list[np.ndarray], times: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(times > 1)
            return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (*columns[:4], np.where(columns[4], MOST_COUNTED + 1, np.minimum(times, MOST_COUNTED)).astype(np.int32))], ["token", "fp", "n", "m", "times"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            token, fp = columns[:2]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
            columns = [c[fresh] for c in columns]
            first = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
            sizes = np.diff(np.append(first, len(columns[0])))
            times = np.repeat(sizes, sizes)
            times[: sizes[0]] += begun
            last = int(first[-1])
            if len(first) > 1:
                begun = 0
            if int(sizes[-1]) + begun > MOST_COUNTED:  # all that is to know of the last shingle is known; its last row stays, since repeats of it may come
                begun += int(sizes[-1]) - 1
                last = len(columns[0]) - 1
            yield out([c[:last] for c in columns], times[:last])
            held = [c[last:] for c in columns]
        if held is not None and len(held[0]):
            yield out(held, np.full(len(held[0]), len(held[0]) + begun))

    some = sets.where("n > 0").select("fp", "n", "tokens").join(common.small(classes), "fp", "left_semi")
    each = some.mapInArrow(explode, "token long, fp long, n int, m int, often boolean").repartition("token").sortWithinPartitions("token", "fp")
    counted = each.mapInArrow(count, "token long, fp long, n int, m int, times int")
    own = Window.partitionBy("fp")
    counted = counted.withColumn("_place", F.row_number().over(own.orderBy("times", "token")) + F.col("m") - F.count("*").over(own))
    length = lambda least: F.least(F.col("n"), F.col("n") - F.ceil(least) + F.greatest(F.lit(1), F.floor(F.col("n") / SHARED_PART)))
    counted = counted.where(F.col("_place") <= length(F.expr(f"n * {percent} / 100")))
    return counted.select("token", "fp", "n", (F.col("_place") <= length(F.expr(f"n * {2 * percent} / {100 + percent}"))).alias("short"))


def families(rows: DataFrame) -> DataFrame:
    """fp, n and family of every class of rows, a staged table. family is the least fp that shared shingles reach."""
    centre = rows.groupBy("token").agg(F.min("fp").alias("a"))
    found = common.components(rows.join(centre, "token").select("a", F.col("fp").alias("b")))
    classes = rows.select("fp", "n").distinct()
    named = common.stage(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "n", F.coalesce("root", "fp").alias("family")), "families")
    common.discard(found)
    return named


# --- signature trees --------------------------------------------------------------------------------------------------


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class SignatureTree:
    """The classes of a block in leaves of up to LEAF; each node holds the OR of its members' bitmaps, their least and
    greatest size, and how many tokens of a member fall together in its bitmap at most."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        known, number, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times > 1  # what one set only has is in no intersection
        number = (np.cumsum(shared) - 1)[number.ravel()]
        kept = shared[np.searchsorted(known, every)] if len(every) else np.empty(0, bool)
        owner = np.repeat(np.arange(len(sets)), size)[kept]
        number = number[kept]
        # members with the same rarest token, by hash, stand together, so that nodes are of like members
        mark = np.full(len(sets), np.iinfo(np.uint64).max)
        np.minimum.at(mark, owner, common.mix(number.astype(np.uint64)))
        self.order = np.lexsort((size, mark))
        rank = np.empty(len(sets), np.int64)
        rank[self.order] = np.arange(len(sets))
        owner = rank[owner]
        by = np.lexsort((number, owner))
        owner, number = owner[by], number[by]
        self.percent, self.size = percent, size[self.order]
        self.tokens = np.split(number, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1]) if sets else []
        words = max(1, -(-int(shared.sum()) // 64))
        most = max(16, BITMAP_WORDS // max(1, len(sets)))
        self.exact = words <= most
        if not self.exact:
            words = 1 << (most.bit_length() - 1)
        at = number % (64 * words)
        bitmap = np.zeros((len(sets), words), np.uint64)
        np.bitwise_or.at(bitmap, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        twice = np.bincount(owner, minlength=len(sets)) - _count_bits(bitmap)
        self.component = np.arange(len(sets))
        begins = np.arange(0, len(sets), LEAF)
        self.bitmap, self.twice = bitmap, twice
        self.levels = []  # from the leaves up: bitmaps, least and greatest size, tokens that fall together, first member
        low = high = self.size
        while len(begins):
            bitmap, low, high, twice = np.bitwise_or.reduceat(bitmap, begins), np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins), np.maximum.reduceat(twice, begins)
            step = LEAF * FANOUT ** len(self.levels)
            self.levels.append((bitmap, low, high, twice, np.append(np.arange(0, len(sets), step), len(sets))))
            if len(bitmap) == 1:
                break
            begins = np.arange(0, len(bitmap), FANOUT)

    def _bounds(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The greatest share (over 1: a link is possible) of the least overlap of a link that pairs of nodes allow."""
        bitmap, low, high, twice, _ = self.levels[level]
        both = np.concatenate([_count_bits(bitmap[i[a : a + 256]] & bitmap[j[a : a + 256]]) for a in range(0, len(i), 256)])
        most = np.minimum(np.minimum(high[i], high[j]), both + np.minimum(twice[i], twice[j]))
        near = (100 * high[i] >= self.percent * low[j]) & (100 * high[j] >= self.percent * low[i])
        return np.where(near, most * (100 + self.percent) / (self.percent * (low[i] + low[j])), 0.0)

    def _join(self, a: int, b: int) -> None:
        self.component[self.component == self.component[b]] = self.component[a]

    def _leaves(self, a: slice, b: slice, wanted: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """Links that join components between the members of two leaves."""
        n, m = self.size[a, None], self.size[None, b]
        open_ = (self.component[a, None] != self.component[None, b]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
        if wanted is not None:
            open_ &= wanted[a, None] | wanted[None, b]
        i, j = np.nonzero(open_)
        if not len(i):
            return
        step = max(1, (1 << 18) // self.bitmap.shape[1])
        both = np.concatenate([_count_bits(self.bitmap[a][i[k : k + step]] & self.bitmap[b][j[k : k + step]]) for k in range(0, len(i), step)])
        if not self.exact:
            both = both + np.minimum(self.twice[a][i], self.twice[b][j])
        good = np.flatnonzero((100 + self.percent) * both >= self.percent * (self.size[a][i] + self.size[b][j]))
        for x, y in zip((i[good] + a.start).tolist(), (j[good] + b.start).tolist(), strict=True):
            if self.component[x] != self.component[y] and (self.exact or self._links(x, y)):
                self._join(x, y)
                yield x, y

    def _links(self, x: int, y: int) -> bool:
        both = len(np.intersect1d(self.tokens[x], self.tokens[y], assume_unique=True))
        return bool((100 + self.percent) * both >= self.percent * (self.size[x] + self.size[y]))

    def links(self, component: np.ndarray | None = None, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Pairs of sets (numbers in the given order) that link and join the components that links make. component:
        those known before; wanted: pairs without one of these sets are not asked for."""
        if not self.levels:
            return []
        if component is not None:
            self.component = component[self.order].copy()
        if wanted is not None:
            wanted = wanted[self.order]
        out: list[tuple[int, int]] = []
        top = len(self.levels) - 1
        queue = [(-float("inf"), top, 0, 0)]
        while queue:
            _, level, i, j = heapq.heappop(queue)
            first = self.levels[level][4]
            a, b = slice(int(first[i]), int(first[i + 1])), slice(int(first[j]), int(first[j + 1]))
            here = self.component[a.start]
            if (self.component[a] == here).all() and (self.component[b] == here).all():
                continue
            if wanted is not None and not (wanted[a].any() or wanted[b].any()):
                continue
            if not level:
                out += self._leaves(a, b, wanted)
                continue
            below = len(self.levels[level - 1][1])
            left, right = np.arange(i * FANOUT, min((i + 1) * FANOUT, below)), np.arange(j * FANOUT, min((j + 1) * FANOUT, below))
            p, q = np.repeat(left, len(right)), np.tile(right, len(left))
            if i == j:
                p, q = p[p <= q], q[p <= q]
            bound = self._bounds(level - 1, p, q)
            for k in np.flatnonzero(bound >= 1 - 1e-9).tolist():
                heapq.heappush(queue, (-float(bound[k]), level - 1, int(p[k]), int(q[k])))
        return [(int(self.order[x]), int(self.order[y])) for x, y in out]


def _walk(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) of each group of keys by a walk of its tree. rows: keys, fp, tokens, and for groups of which
    something is known comp and open; only pairs with an open set are asked for then. A group is a block, so it has at
    most about MEMBERS sets and SHINGLES shingles twice."""
    known = "comp" in rows.columns
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def walk(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        _, one = np.unique(fp, return_index=True)
        sets = [_unpack(table.column("tokens")[i].as_py()) for i in one.tolist()]
        component = wanted = None
        if known:
            component = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1].ravel()[one]
            wanted = np.isin(fp[one], fp[table.column("open").to_numpy(zero_copy_only=False)])
        found = SignatureTree(sets, percent).links(component, wanted) if len(one) > 1 else []
        a, b = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
        return pa.Table.from_arrays([pa.array(fp[one][a]), pa.array(fp[one][b])], schema=schema)

    return rows.groupBy(*keys).applyInArrow(walk, "a long, b long")


# --- the join ---------------------------------------------------------------------------------------------------------


def _links(classes: DataFrame, sets: DataFrame, percent: int, members: int, shingles: int) -> DataFrame:
    """Links (a, b) that connect what links connect. classes: fp, n, family; a staged table."""
    sizes = classes.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("m > 1")
    blocks = sizes.select("family", F.greatest(F.ceil(F.col("m") / members), F.ceil(F.col("all") / shingles)).cast("int").alias("blocks"))
    dealt = common.stage(classes.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int")), "dealt")
    own = sets.select("fp", "tokens").join(common.small(dealt), "fp").groupBy("fp", "n", "family", "blocks", "block").agg(F.first("tokens").alias("tokens"))
    links = common.stage(_walk(own, ["family", "block"], percent), "links")
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return links
    own = common.stage(own.where("blocks > 1"), "large")

    def placed(links: DataFrame) -> DataFrame:
        roots = common.components(links)
        return common.stage(own.drop("tokens").join(roots, own["fp"] == roots["node"], "left").select("fp", "n", "family", "blocks", "block", F.coalesce("root", "fp").alias("comp")), "placed")

    # one member of every component of every block, as many as a block may have, of the largest components first
    known = placed(links)
    ends = known.groupBy("family", "block", "comp").agg(F.count("*").alias("of"), F.max_by(F.struct("fp", "n"), F.col("n")).alias("x")).select("family", "of", "comp", "x.fp", "x.n")
    first = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("of"), "fp"))
    before = F.sum("n").over(Window.partitionBy("family").orderBy(F.desc("of"), "fp").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_first", first).withColumn("_all", before).where((F.col("_first") <= members) & (F.col("_all") <= shingles)).select("fp", "comp", F.lit(True).alias("open"))
    links = links.unionByName(common.stage(_walk(own.join(ends, "fp"), ["family"], percent), "links"))

    # what is outside of the family's largest component meets every block
    known = placed(links)
    main = known.groupBy("family", "comp").agg(F.count("*").alias("of")).groupBy("family").agg(F.max(F.struct("of", "comp"))["comp"].alias("main"))
    known = known.join(main, "family").withColumn("open", F.col("comp") != F.col("main")).drop("main")
    chunks = known.where("open").groupBy("family").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / shingles)).cast("int").alias("chunks"))
    known = known.join(chunks, "family").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(1)), "chunks").cast("int"))
    outside = known.where("open").select("fp", "family", "comp", "open", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    inside = known.select("fp", "family", "comp", F.lit(False).alias("open"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block")
    met = outside.unionByName(inside).join(own.select("fp", "tokens"), "fp")
    return links.unionByName(common.stage(_walk(met, ["family", "block", "chunk"], percent), "links"))


def jaccard_join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, members: int = MEMBERS, shingles: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and text_hash (xxhash64 of the text, to tell rows of one doc_id apart) of every
    row.

    Null and empty texts and texts without words have no shingles and are components of their own; whole texts count,
    however long; equal sets link; repeated rows, and rows that share a doc_id, are rows by themselves; a row without
    doc_id has a component of null, unless it links with one that has an id. Other columns are not used. An empty table
    gives no rows. members and shingles bound what one tree holds."""
    spark = docs.sparkSession
    sets = told_apart(common.stage(shingle_sets(docs, k), "sets"))
    frequent = spark.sparkContext.broadcast(frequent_slots(sets))  # 2**SLOT_BITS bits
    rows = common.stage(with_partners(prefixes(sets, frequent, percent), percent), "buckets")
    alive = common.stage(that_may_link(rows, percent).select("fp").distinct(), "alive")
    common.discard(rows)
    again = common.stage(with_partners(rarest_first(sets, alive, frequent, percent), percent), "buckets")
    last = common.stage(that_may_link(again, percent), "buckets")
    common.discard(alive, again)
    frequent.unpersist()
    classes = families(last)
    common.discard(last)
    links = _links(classes, sets, percent, members, shingles)
    final = common.components(links)
    keyed = sets.select("doc_id", "text_hash", "n", "fp").join(final, sets["fp"] == final["node"], "left").select("doc_id", "text_hash", "n", F.coalesce("root", "fp").alias("key"))
    least = keyed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    keyed = keyed.join(least, "key", "left")
    return keyed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")
