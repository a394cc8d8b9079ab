"""Records that share most of their words, found by a generalised pigeonhole.

A record is the set of its bits, one for each occurrence of each word. If two records of
sizes ``a <= b`` are alike by at least ``t`` (common part over union, both with repetition),
the smaller one has at most ``a - 2ta / (1 + t)`` bits that the other lacks. Its bits are
grouped into partitions. By the generalised pigeonhole, for any thresholds whose sum of
``threshold + 1`` exceeds that number, some partition lacks at most its own threshold. So
it is enough to look into every partition for records that lack no more than allowed there.

* Words that very many records have are correlated with each other; they form one partition
  that is normally given the threshold -1, that is, not probed at all.
* The other words fall into hash partitions. A threshold of ``size - 2`` is met exactly if
  a pair of the partition's bits is shared, so pairs of bits are the keys of the index. A
  threshold of ``size - 1`` needs a single shared bit; the few records that cannot do
  without it are looked up in a second, small index of just the bits that they ask for.
* Which partitions a record probes is found by dynamic programming over the number of
  candidates that they are estimated to give, from a sketch of word counts over all rows.
* Every candidate is verified on its whole words. The result is exact.

Identical records are one record until the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import graph
from quire.session import cut, spread

#: Counters of the sketch (a fixed size, whatever the number of records).
SKETCH_BITS = 18
BLOCK = 1 << 14
#: A word is common if its counter exceeds this share of the records, and this number.
COMMON_SHARE, COMMON_LEAST = 0.005, 50
#: Hash partitions, and the cost in candidates of asking the second index at all.
PARTITIONS, ASK_COST = 10, 20.0
#: Words of a record in the smallest size class; each class holds records of twice as many words
#: and divides its bits into twice as many groups of ``PARTITIONS``.
CLASS_WORDS = 128
#: Records of one key above which they are joined in cells of about as many.
HOT_KEY = 2_000
#: Records that have a single bit, by the sketch, for each cell of the second index.
HOT_BIT = 50_000
#: Bits of the map of what is asked for.
ASKED_BITS = 20
#: Rows up to which an id set is broadcast (8 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
NEVER = 2**31 - 1


@dataclass(frozen=True)
class Threshold:
    """A likeness threshold as a fraction, so that no rounding decides a case."""

    over: int
    under: int

    def alike(self, common, a, b):
        return common * (self.under + self.over) >= self.over * (a + b)

    def needed(self, size: np.ndarray) -> np.ndarray:
        """Bits that a record may lack when compared with any record at least as large, plus one."""
        num, den = 2 * self.over * size, self.under + self.over
        return size + 1 + (-num // den)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser on unsigned arrays."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the blank-separated words of a text, sorted."""
    hashed = F.transform(F.split(text, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_remove(hashed, F.xxhash64(F.lit(""))))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row number of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(column.flatten(), dtype=np.int64).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def _occurrence(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of equal values before each one in its row; values are sorted within rows."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    at = np.arange(len(values))
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _scan(words: DataFrame) -> DataFrame:
    """Per record a 128-bit digest of its words, and per task the blocks of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            values, row = _flat(batch.column(1))
            sketch += np.bincount((values[_occurrence(values, row) == 0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            n = batch.num_rows
            digest = []
            for salt in (1, 2):
                sums = np.zeros(n, dtype=np.uint64)
                np.add.at(sums, row, _mix(values, salt))
                digest.append(pa.array(sums.view(np.int64)))
            size = pa.array(np.bincount(row, minlength=n).astype(np.int32))
            yield pa.record_batch([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), batch.column(0), *digest, size], schema=target)
        blocks = sketch.reshape(-1, BLOCK)
        used = [k for k in range(len(blocks)) if blocks[k].any()]
        n = len(used)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary()), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.int32())], schema=target)

    target = pa.schema([("block", pa.int32()), ("counts", pa.binary()), ("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("size", pa.int32())])
    return words.mapInArrow(run, "block int, counts binary, id bigint, d1 bigint, d2 bigint, size int")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The sum of all sketches: blocks are added where they are shuffled to, one array comes back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(counts, dtype=np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    blocks = (1 << SKETCH_BITS) // BLOCK
    total = np.zeros((blocks, BLOCK), dtype=np.int64)
    for row in scanned.filter("block IS NOT NULL").select("block", "counts").repartition(blocks, "block").mapInArrow(add, "block int, counts binary").collect():
        total[row.block] += np.frombuffer(bytes(row.counts), dtype=np.int64)
    return total.ravel()


SKIP, PAIRS, SINGLES = 0, 1, 2


def choose(sizes: np.ndarray, pair_costs: np.ndarray, single_costs: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The threshold of each partition of each record, and what is missing to ``need``.

    Dynamic programming over the partitions; the state is the sum of ``threshold + 1``
    reached so far, capped at the need. A partition of ``s`` bits adds nothing if skipped,
    ``s - 1`` if probed by pairs and ``s`` if probed by single bits. If all bits together
    do not suffice, all partitions are probed by single bits and the rest is missing.
    """
    n, parts = sizes.shape
    cap = int(need.max(initial=0))
    best = np.full((n, cap + 1), np.inf)
    best[:, 0] = 0
    came = np.zeros((parts, n, cap + 1), dtype=np.int8)
    state = np.arange(cap + 1)
    for p in range(parts):
        before = best
        for option, gain, cost in ((PAIRS, np.maximum(sizes[:, p] - 1, 0), pair_costs[:, p]), (SINGLES, sizes[:, p], single_costs[:, p])):
            # the cheapest way to reach at least each state
            origin = np.maximum(state[None, :] - gain[:, None], 0)
            taken = np.take_along_axis(before, origin, axis=1) + cost[:, None]
            taken[gain == 0] = np.inf
            better = taken < best
            came[p][better] = option
            best = np.where(better, taken, best)
    option = np.zeros((n, parts), dtype=np.int8)
    at = need.copy()
    for p in range(parts - 1, -1, -1):
        option[:, p] = came[p][np.arange(n), at]
        gain = np.where(option[:, p] == PAIRS, np.maximum(sizes[:, p] - 1, 0), np.where(option[:, p] == SINGLES, sizes[:, p], 0))
        at = np.maximum(at - gain, 0)
    missing = np.where(np.isfinite(best[np.arange(n), need]), 0, need - sizes.sum(1))
    option[missing > 0] = SINGLES
    return option, missing


#: ``meta`` holds, from the top: the least size to look for (``NEVER``: no probe), 31 bits of the own size, a bit for records with more to ask.
#: ``hot``: by the sketch, very many records may have the key.
POSTING = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("meta", pa.int64()), ("hot", pa.bool_())])
POSTING_SQL = "key bigint, id bigint, meta bigint, hot boolean"
#: ``s1, s2``: a signature of the uncommon bits; ``lack``: how many of them the other record may not have;
#: ``cells``: into how many parts the records that have the bit are divided.
ASKED = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("lack", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("cells", pa.int32())])
ASKED_SQL = "key bigint, id bigint, size int, lack int, s1 bigint, s2 bigint, cells int"


class Indexer:
    """Makes the keys of records from a batch of (id, words)."""

    def __init__(self, sketch: np.ndarray, records: int, threshold: Threshold, asked: np.ndarray | None = None):
        self.sketch, self.records, self.threshold, self.asked = sketch, max(records, 1), threshold, asked
        self.common_from = max(COMMON_LEAST, int(COMMON_SHARE * records))

    def _bits(self, batch: pa.RecordBatch):
        values, row = _flat(batch.column(1))
        df = self.sketch[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        bit = _mix(values, 3) + _mix(_occurrence(values, row).astype(np.uint64), 4)
        return row, bit, df.astype(float), df > self.common_from

    def _grouped(self, row, bit, level):
        """Bits sorted by record, group and partition, and the number of each partition; a record of ``level`` k has 2^k groups."""
        groups = np.int64(1) << level
        first = np.concatenate(([0], np.cumsum(groups)))
        part = (first[row] + (_mix(bit, 11) % groups[row].astype(np.uint64)).astype(np.int64)) * PARTITIONS + (_mix(bit, 5) % np.uint64(PARTITIONS)).astype(np.int64)
        order = np.lexsort((bit, part))
        return order, part[order], first

    def _paired(self, part, df):
        """All pairs of bits within partitions, without those of a bit that no other record has."""
        known = np.flatnonzero(df > 1)
        part = part[known]
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for distance in range(1, len(part)):
            at = np.flatnonzero(part[distance:] == part[:-distance])
            if not len(at):
                break
            left.append(known[at])
            right.append(known[at + distance])
        return np.concatenate(left), np.concatenate(right)

    def _partitioned(self, batch: pa.RecordBatch):
        """Uncommon bits sorted by record and partition, all pairs of them, sizes and needs.

        The need of a record of several groups is divided among them by their numbers of bits, so
        that each group is a record of its own to the dynamic programme.
        """
        n = batch.num_rows
        row, bit, df, common = self._bits(batch)
        size = np.bincount(row, minlength=n)
        need = np.where(size > 0, self.threshold.needed(size), 0)
        everything = (row, bit, df, common)
        row, bit, df = row[~common], bit[~common], df[~common]
        order, part, first = self._grouped(row, bit, self.levels(size))
        row, bit, df = row[order], bit[order], df[order]
        left, right = self._paired(part, df)
        groups = int(first[-1])
        guess = df[left] * df[right] / self.records + 0.05 * np.minimum(df[left], df[right])
        total = lambda of, weights: np.bincount(of, weights=weights, minlength=groups * PARTITIONS).reshape(groups, PARTITIONS)
        sizes = np.bincount(part, minlength=groups * PARTITIONS).reshape(groups, PARTITIONS)
        owner = np.repeat(np.arange(n), np.diff(first))
        held = sizes.sum(1)
        upto = np.cumsum(held) - np.concatenate(([0], np.cumsum(held)))[first[:-1]][owner]
        have = np.bincount(row, minlength=n)
        within = np.minimum(need, have)
        share = lambda k: -(-within[owner] * k // np.maximum(have[owner], 1))
        option, _ = choose(sizes, total(part[left], guess), total(part, df) + ASK_COST, share(upto) - share(upto - held))
        missing = np.maximum(need - have, 0)
        option[missing[owner] > 0] = SINGLES
        return everything, row, bit, df, part, left, right, size, need, option.ravel(), missing, owner

    @staticmethod
    def levels(size: np.ndarray) -> np.ndarray:
        """The size class of each record."""
        return np.ceil(np.log2(np.maximum(size, 1) / CLASS_WORDS)).clip(0).astype(np.int64)

    def _keys(self, bit, left, right, level):
        with np.errstate(over="ignore"):
            return _mix(bit[left] * np.uint64(3) + bit[right] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 6)

    def postings(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """All pairs of bits within partitions; a row of its own for each record with more to ask.

        A record meets smaller ones of a class below in the partitions of that class, too.
        """
        ids = np.asarray(batch.column(0), dtype=np.int64)
        n = batch.num_rows
        _, row, bit, df, part, left, right, size, _, option, missing, owner = self._partitioned(batch)
        level = self.levels(size)
        key, rows = self._keys(bit, left, right, level[row[left]]), row[left]
        least = np.where(option[part[left]] == PAIRS, size[rows], NEVER)
        rare = np.minimum(df[left], df[right])
        # smaller records that a record may be like can be of a class below
        for step in range(1, int(level.max(initial=0)) + 1):
            lower = level - step
            below = (lower >= 0) & (self.threshold.over * size <= self.threshold.under * (CLASS_WORDS << np.maximum(lower, 0)))
            at = np.flatnonzero(below[row])
            if not len(at):
                break
            order, part_b, _ = self._grouped(row[at], bit[at], np.maximum(lower, 0))
            at = at[order]
            left_b, right_b = self._paired(part_b, df[at])
            key = np.concatenate([key, self._keys(bit[at], left_b, right_b, lower[row[at[left_b]]])])
            rows = np.concatenate([rows, row[at[left_b]]])
            least = np.concatenate([least, np.full(len(left_b), NEVER)])
            rare = np.concatenate([rare, np.minimum(df[at[left_b]], df[at[right_b]])])
        asking = np.bincount(owner, weights=(option.reshape(-1, PARTITIONS) == SINGLES).any(1), minlength=n) > 0
        more = np.flatnonzero(asking | (missing > 0))
        key = np.concatenate([key, _mix(ids[more].view(np.uint64), 9)])
        rows, least = np.concatenate([rows, more]), np.concatenate([least, size[more]])
        asks = np.arange(len(rows)) >= len(rows) - len(more)
        hot = np.concatenate([rare > HOT_KEY, np.zeros(len(more), dtype=bool)])
        meta = (least.astype(np.int64) << 32) | (size[rows].astype(np.int64) << 1) | asks
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids[rows]), pa.array(meta), pa.array(hot)], schema=POSTING)

    def _single(self, batch: pa.RecordBatch, row, bit, df, size, lack, everything) -> pa.RecordBatch:
        n = batch.num_rows
        ids = np.asarray(batch.column(0), dtype=np.int64)
        all_row, all_bit, _, common = everything
        place = (_mix(all_bit[~common], 10) % np.uint64(128)).astype(np.int64)
        marks = np.zeros((n, 128), dtype=bool)
        marks[all_row[~common], place] = True
        signature = np.packbits(marks, axis=1).view(np.int64)
        key = _mix(bit, 7).view(np.int64)
        columns = [key, ids[row], size[row].astype(np.int32), lack[row].astype(np.int32), signature[row, 0], signature[row, 1], np.ceil(df / HOT_BIT).clip(1).astype(np.int32)]
        return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], schema=ASKED)

    def asks(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Single bits that have to be looked up, common words included where others do not suffice."""
        everything, row, bit, df, part, _, _, size, need, option, missing, _ = self._partitioned(batch)
        alone = option[part] == SINGLES
        out_row, out_bit, out_df = [row[alone]], [bit[alone]], [df[alone]]
        all_row, all_bit, all_df, common = everything
        short = np.flatnonzero(common & (missing[all_row] > 0))
        short = short[np.lexsort((all_df[short], all_row[short]))]
        starts = np.searchsorted(all_row[short], np.arange(batch.num_rows + 1))
        wanted = short[np.arange(len(short)) - starts[all_row[short]] < missing[all_row[short]]]
        out_row.append(all_row[wanted])
        out_bit.append(all_bit[wanted])
        out_df.append(all_df[wanted])
        return self._single(batch, np.concatenate(out_row), np.concatenate(out_bit), np.concatenate(out_df), size, need - 1, everything)

    def answers(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """All bits that may be asked for, by the map of what is asked."""
        everything = self._bits(batch)
        row, bit = everything[:2]
        size = np.bincount(row, minlength=batch.num_rows)
        maybe = self.asked[(_mix(bit, 7) >> np.uint64(64 - ASKED_BITS)).astype(np.int64)]
        return self._single(batch, row[maybe], bit[maybe], everything[2][maybe], size, np.zeros(len(size)), everything)


def _map(words: DataFrame, indexer: Indexer, method: str, schema: str = POSTING_SQL) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(indexer)  # the sketch and the map: 3 MB at any scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = getattr(shared.value, method)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                yield make(batch.slice(start, 2000))

    return words.mapInArrow(run, schema)


def _asked_map(asked: DataFrame) -> np.ndarray:
    """Which of ``2 ** ASKED_BITS`` buckets of keys are asked for; at most so many rows come back."""
    bucket = F.shiftrightunsigned("key", 64 - ASKED_BITS).cast("int")
    out = np.zeros(1 << ASKED_BITS, dtype=bool)
    out[np.asarray(asked.select(bucket.alias("bucket")).distinct().toArrow().column(0))] = True
    return out


def _among(df: DataFrame, ids: DataFrame, how: str, rows: int) -> DataFrame:
    """``df`` semi or anti joined with ``ids``, broadcast only if their counted number is small."""
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, "id", how)


def _met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Smaller and larger record of every key that the smaller one probes; one with more to ask as a pair with itself."""
    # both sides keep the same columns and get the same null filters: the self join
    # shuffles once. The hint keeps the size estimate, which cannot know how many keys a
    # record has, from choosing a broadcast.
    a = a.select(*[F.col(c).alias(f"{c}_a") for c in on], F.col("id").alias("a"), F.col("meta").alias("meta_a")).hint("merge")
    b = b.select(*[F.col(c).alias(f"{c}_b") for c in on], F.col("id").alias("b"), F.col("meta").alias("meta_b"))
    least_a, size_b = F.shiftright("meta_a", 32), F.shiftright("meta_b", 1).bitwiseAND(F.lit(0x7FFFFFFF))
    asks_itself = F.col("meta_a").bitwiseAND(F.col("meta_b")).bitwiseAND(F.lit(1)) == 1
    met = (size_b >= least_a) & ((F.col("a") != F.col("b")) | asks_itself)
    for c in on:
        met = met & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    return a.join(b, met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def in_cells(rows: DataFrame, key: str, counts: DataFrame, one: bool, by: str = "id") -> DataFrame:
    """``rows`` of keys with counted rows (``counts``: key, n) with a ``cell``: one of about ``HOT_KEY`` rows, or all of the key."""
    sized = rows.join(counts.select(key, F.ceil(F.col("n") / HOT_KEY).cast("int").alias("cells")).hint("merge"), key)
    cell = F.pmod(F.xxhash64(by), "cells").cast("int") if one else F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    return sized.withColumn("cell", cell).drop("cells")


def _pairs(postings: DataFrame, hot: bool) -> DataFrame:
    """``_met`` over all keys; those of very many records (``hot``: there may be some) in cells, so that no task has a whole one."""
    columns = postings.select("key", "id", "meta")
    if not hot:
        return _met(columns, columns, ["key"]).distinct()
    counted = cut(postings.filter("hot").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_KEY))
    cold = columns.join(counted.select("key").hint("merge"), "key", "left_anti")
    probing = columns.filter(F.shiftright("meta", 32) < NEVER)
    split = _met(in_cells(probing, "key", counted, True), in_cells(columns, "key", counted, False), ["key", "cell"])
    return _met(cold, cold, ["key"]).unionByName(split).distinct()


def _answered(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs of the second index whose signatures do not rule the pair out."""
    a = asked.select("key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("id").alias("x"), F.col("size").alias("size_a"), "lack", F.col("s1").alias("a1"), F.col("s2").alias("a2")).hint("merge")
    b = answers.select("key", F.pmod(F.xxhash64("id"), "cells").cast("int").alias("cell"), F.col("id").alias("y"), F.col("size").alias("size_b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    lacking = sum(F.bit_count(F.col(f"a{k}").bitwiseAND(F.bitwise_not(f"b{k}"))) for k in (1, 2))
    met = (a.key == b.key) & (a.cell == b.cell) & (b.size_b >= a.size_a) & (a.x != b.y) & (lacking <= a.lack)
    return a.join(b, met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _verify(candidates: DataFrame, words: DataFrame, threshold: Threshold) -> DataFrame:
    """The candidates that are alike, with ``n_common`` and the sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, n = [], batch.num_rows
            for column in (2, 3):
                values, row = _flat(batch.column(column))
                sides.append((values, row, _occurrence(values, row)))
            size = [np.bincount(row, minlength=n) for _, row, _ in sides]
            with np.errstate(over="ignore"):
                bit = np.concatenate([_mix(v, 3) + _mix(o.astype(np.uint64), 4) for v, _, o in sides])
            row = np.concatenate([r for _, r, _ in sides])
            order = np.lexsort((bit, row))
            row, bit = row[order], bit[order]
            twice = (row[1:] == row[:-1]) & (bit[1:] == bit[:-1])
            common = np.bincount(row[1:][twice], minlength=n)
            good = np.flatnonzero((common > 0) & threshold.alike(common, *size))
            ids = [batch.column(k).take(pa.array(good)) for k in (0, 1)]
            yield pa.record_batch([*ids, *[pa.array(x[good].astype(np.int32)) for x in (common, *size)]], names=["a", "b", "n_common", "size_a", "size_b"])

    left = candidates.join(words.select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a")
    both = left.join(words.select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a bigint, b bigint, n_common int, size_a int, size_b int")


@dataclass
class Result:
    """``classes``: id, class_id of every record with words; ``links``: pairs of alike classes."""

    classes: DataFrame
    links: DataFrame


def similar(records: DataFrame, threshold: Threshold) -> Result:
    """Alike records of ``records`` (id bigint, text string; a null text is like nothing).

    Records with the same words, in any order, are one class, named by its smallest id;
    ``links`` are all pairs of classes that are alike, the smaller id first. Texts without
    words are in no class. A repeated id must carry one text. An empty table gives empty
    results. No candidate is capped or sampled.
    """
    words = spread(records.filter("text IS NOT NULL AND id IS NOT NULL").select("id", "text"), "id").select("id", word_hashes(F.col("text")).alias("words"))
    scanned = cut(_scan(words))
    sketch = _sketch(scanned)
    digests = scanned.filter("id IS NOT NULL AND size > 0").select("id", "d1", "d2", "size").dropDuplicates(["id"])
    classes = cut(digests.select("id", F.min("id").over(Window.partitionBy("d1", "d2", "size")).alias("class_id")))
    copies = classes.filter("id <> class_id").select("id")
    counts = classes.agg(F.count("*").alias("n"), F.count_if(F.col("id") != F.col("class_id")).alias("copies")).first()
    own = _among(words, copies, "left_anti", counts.copies) if counts.copies else words
    indexer = Indexer(sketch, counts.n - counts.copies, threshold)

    hot = bool(((sketch > HOT_KEY) & (sketch <= indexer.common_from)).any())
    postings = _map(own, indexer, "postings")
    candidates = cut(_pairs(cut(postings) if hot else postings, hot))
    short = candidates.filter("a = b").select(F.col("a").alias("id"))
    n_short = short.count()
    if n_short:
        asked = cut(_map(_among(own, short, "left_semi", n_short), indexer, "asks", ASKED_SQL))
        answering = Indexer(sketch, counts.n - counts.copies, threshold, _asked_map(asked))
        more = _answered(asked, _map(own, answering, "answers", ASKED_SQL))
        candidates = cut(candidates.filter("a <> b").unionByName(more).distinct())
    ids = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    concerned = _among(own, ids, "left_semi", ids.count())
    return Result(classes, cut(_verify(candidates, concerned, threshold)))


def all_pairs(result: Result) -> DataFrame:
    """Every pair of alike records, copies included, the smaller id first.

    A class of very many copies is paired in cells.
    """
    members = cut(result.classes.withColumn("n", F.count("*").over(Window.partitionBy("class_id"))).filter("n > 1").select("class_id", "id", "n"))
    of = lambda side: members.select(F.col("class_id").alias(side), F.col("id").alias(f"id_{side}"))
    linked = result.links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = linked.select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y"))
    cells = F.ceil(F.col("n") / HOT_KEY).cast("int")
    left = members.select("class_id", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), cells).cast("int").alias("cell"))
    right = members.select("class_id", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    within = left.join(right.hint("merge"), ["class_id", "cell"]).filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(result: Result) -> DataFrame:
    """``id, class_id, n_links, group_id`` of every record with words.

    ``n_links`` counts the other records that it is alike to, copies included;
    ``group_id`` is the least id that chains of links lead to.
    """
    size = result.classes.groupBy("class_id").agg(F.count("*").alias("n"))
    links = result.links.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionAll(result.links.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    others = links.join(size.withColumnRenamed("class_id", "other"), "other").groupBy("class_id").agg(F.sum("n").alias("linked"))
    chained = graph.components(size.select(F.col("class_id").alias("node")), result.links.select("a", "b")).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    rows = size.join(others, "class_id", "left").join(chained, "class_id").select("class_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "group_id")
    return result.classes.join(rows, "class_id").select("id", "class_id", "n_links", "group_id")
