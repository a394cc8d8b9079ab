"""Filling containers of fixed capacity with texts measured in tokens.

Documents are spread over work units. Every unit is packed best fit decreasing and gets a
lower bound for its own number of containers from dual feasible functions. A unit that
meets its bound is certified: no packing of these documents needs fewer containers. The
documents in the loosely filled containers of all other units are exchanged and packed
again in fewer units, until a single unit is left, no document is loose, or an exchange
places none. Every container says whether its unit was certified.

Nothing is gathered at the driver but one row of totals a round.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

CAPACITY = 2048
#: Documents in a work unit, on average.
UNIT_ITEMS = 5_000
#: Containers filled at least so far keep their documents when a unit exchanges the rest.
KEEP_FILL = 0.995

ASSIGNED = "doc_id bigint, piece_no int, begin_token bigint, n_tokens int, container_id string, is_certified boolean"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of ``sizes`` (1 to capacity) needs at least.

    The greatest of the continuous bound and of the bounds by two families of dual
    feasible functions: the one that rounds sizes over ``capacity - k`` up and those
    under ``k`` down, and the one that rounds down to multiples of ``capacity / (k + 1)``.
    """
    if not len(sizes):
        return 0
    values, counts = np.unique(np.asarray(sizes, dtype=np.int64), return_counts=True)
    total = int((values * counts).sum())
    best = -(-total // capacity)
    for k in np.unique(np.minimum(values, capacity - values)):
        if 0 < k <= capacity // 2:
            f = np.where(values > capacity - k, capacity, np.where(values < k, 0, values))
            best = max(best, -(-int((f * counts).sum()) // capacity))
    for k in range(1, 21):
        scaled = values * (k + 1)
        exact = scaled % capacity == 0
        f = np.where(exact, values * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((f * counts).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item and room left in each container.

    Larger items first, each into the fullest container that still takes it; ties go to
    the container opened last, so that the result depends on the order of equal items only.
    """
    order = np.argsort(-sizes, kind="stable")
    place = np.zeros(len(sizes), dtype=np.int64)
    room_of: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted rooms that occur
    for item in order:
        size = int(sizes[item])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            number, left = len(room_of), capacity - size
            room_of.append(left)
        else:
            room = rooms[at]
            stack = open_by_room[room]
            number = stack.pop()
            if not stack:
                del open_by_room[room]
                rooms.pop(at)
            left = room - size
            room_of[number] = left
        place[item] = number
        if left:
            if left not in open_by_room:
                bisect.insort(rooms, left)
                open_by_room[left] = []
            open_by_room[left].append(number)
    return place, np.array(room_of, dtype=np.int64)


def _pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """Rows ``doc_id, piece_no, begin_token, n_tokens``; only texts over the capacity have several."""
    n = F.col("n_tokens").cast("bigint")
    last = F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0)).cast("int")
    begin = F.col("piece_no").cast("bigint") * capacity
    return sized.select("doc_id", n.alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "doc_id", "piece_no", begin.alias("begin_token"), F.least(F.col("whole") - begin, F.lit(capacity)).cast("int").alias("n_tokens")
    )


def pack(sized: DataFrame, capacity: int = CAPACITY, unit_items: int = UNIT_ITEMS, keep_fill: float = KEEP_FILL) -> DataFrame:
    """Assign every document of ``sized`` (doc_id, n_tokens) to containers.

    A document is one piece unless it exceeds the capacity; then every piece but the last
    fills a container by itself. Texts without tokens (null, empty) take no room: they come
    out with a null container. ``is_certified``: no packing of the documents of its unit needs
    fewer containers than the unit has. Repeated documents are packed as often as they occur. An
    empty table gives an empty result. Result columns: ``ASSIGNED``.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    pieces = cut(_pieces(sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), capacity))
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    none = pieces.filter("n_tokens = 0").withColumns({"container_id": F.lit(None).cast("string"), "is_certified": F.lit(None).cast("boolean")})
    full = pieces.filter(F.col("n_tokens") == capacity).withColumn("container_id", F.concat(F.lit("full-"), text_id, F.lit("-"), F.col("piece_no").cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string"))).withColumn("is_certified", F.lit(True))
    done = [df.select(*[c.split()[0] for c in ASSIGNED.split(", ")]) for df in (none, full)]
    loose = pieces.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))

    columns = ["doc_id", "piece_no", "begin_token", "n_tokens"]
    before = None
    for turn in itertools.count():
        total = loose.count()
        if not total:
            break
        units = max(1, round(total / unit_items))
        # an exchange that placed nothing would place nothing again
        final = units == 1 or total == before
        before = total

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, final: bool = final) -> Iterator[pa.RecordBatch]:
            # one work unit is one task: its size is set by the number of units, not by a key
            rows = [b for b in batches if b.num_rows]
            if not rows:
                return
            unit = pa.Table.from_batches(rows).to_pandas()
            unit = unit.sort_values(["n_tokens", "doc_id", "piece_no"], kind="stable").reset_index(drop=True)
            sizes = unit.n_tokens.to_numpy()
            place, room = best_fit_decreasing(sizes, capacity)
            certified = len(room) == lower_bound(sizes, capacity)
            kept = np.full(len(room), True) if certified or final else (capacity - room) >= keep_fill * capacity
            name = f"{turn}-{int(unit['unit'].iloc[0])}-"
            unit["container_id"] = [f"{name}{p}" if kept[p] else None for p in place]
            unit["is_certified"] = certified
            for start in range(0, len(unit), 50_000):
                yield pa.RecordBatch.from_pandas(unit.iloc[start : start + 50_000][[*columns, "container_id", "is_certified"]], schema=target, preserve_index=False)

        target = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("begin_token", pa.int64()), ("n_tokens", pa.int32()), ("container_id", pa.string()), ("is_certified", pa.bool_())])
        salted = loose.select(*columns, (F.xxhash64(F.lit(turn), "doc_id", "piece_no").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)) % units).cast("int").alias("unit"))
        # repartitionByRange by the unit number would sample; hashing the number may put two units into one task
        placed = cut(_by_unit(salted, units).mapInArrow(run, ASSIGNED))
        done.append(placed.filter("container_id IS NOT NULL"))
        loose = placed.filter("container_id IS NULL").select(*columns)
        if final:
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def _by_unit(df: DataFrame, units: int) -> DataFrame:
    """One partition for each unit number."""
    if units == 1:
        return df.coalesce(1)
    return df.repartitionById(units, F.col("unit"))


def summary(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, tokens packed, share of room used and the continuous lower bound."""
    bins = assigned.filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.bool_and("is_certified").alias("sure"))
    used = F.coalesce(F.sum("used"), F.lit(0))
    return bins.agg(
        F.count("*").alias("n_containers"),
        used.cast("bigint").alias("n_tokens"),
        F.ceil(used / F.lit(capacity)).cast("bigint").alias("least_containers"),
        F.coalesce(F.max("used"), F.lit(0)).cast("bigint").alias("fullest"),
        F.count_if("sure").alias("n_certified"),
        F.round(used / (F.greatest(F.count("*"), F.lit(1)) * F.lit(capacity)), 6).alias("fill"),
    )
