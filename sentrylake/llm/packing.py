"""Best-fit packing of token sequences by swap-based local search.

Texts become pieces of at most `capacity` tokens. Pieces are dealt by hash and place into groups of a few thousand, each
packed in one task: best fit gives a start, then the local search takes the least filled bin as donor and moves documents out
of it, swaps one for one, two for one and one for two, keeping an exchange only if the sum of squared fills grows, until
no exchange helps or the bins are as few as their tokens allow. What the groups leave in underfull bins is dealt into
groups of that size again and packed once more. A group never needs all pieces of a source, of a class of copies or of
one row that is repeated, so no key can grow a task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.bpe import PART_ROWS, PART_SIZE, load_model, worker_encoder
from sentrylake.llm.common import discard, small_parts, stored, tidy

CAPACITY = 4096
END_ID = 1
GROUP = 5000  # pieces packed in one task at most, about
UNDERFULL = 0.98  # share of the capacity; bins filled less give in the search and are dealt again


def pieces(df: DataFrame, id_column: str = "doc_id", column: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Null and empty texts give one piece of the end id alone.

    Rows with a null id keep it; repeated rows give their pieces again; an empty table gives none.
    """
    shipped = df.sparkSession.sparkContext.broadcast(load_model(vocabulary))
    names = [id_column, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shipped)
        tail = END_ID.to_bytes(4, "little")
        for batch in batches:
            for part in small_parts(batch, column, PART_ROWS, PART_SIZE):
                flat, ends = encoder.encode_batch(part.column(1))
                flat = memoryview(flat.astype("<i4").tobytes())
                row, piece, start, length, sums = [], [], [], [], []
                for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    for j, at in enumerate(range(a, b + 1, capacity)):  # the end id comes after b
                        to = min(at + capacity, b)
                        whole = to - at < capacity  # the end id is in this piece
                        held = zlib.crc32(flat[4 * at : 4 * to])
                        row.append(k)
                        piece.append(j)
                        start.append(at - a)
                        length.append(to - at + whole)
                        sums.append(zlib.crc32(tail, held) if whole else held)
                ids = part.column(0).take(pa.array(row, type=pa.int64()))
                rest = [pa.array(piece, type=pa.int32()), *(pa.array(x, type=pa.int64()) for x in (start, length, sums))]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=names)

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, column).mapInArrow(tidy(run), f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of item lengths, found by their free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.rooms: dict[int, set[int]] = defaultdict(set)
        self.mask = 0  # bit r: some open bin has r tokens free

    def put(self, b: int, free: int) -> None:
        """Note bin b's free room."""
        self.free[b] = free
        self.rooms[free].add(b)
        self.mask |= 1 << free

    def take(self, b: int) -> None:
        free = self.free[b]
        self.rooms[free].discard(b)
        if not self.rooms[free]:
            self.mask &= ~(1 << free)

    def new(self) -> int:
        self.items.append([])
        self.free.append(self.capacity)
        return len(self.items) - 1

    def tightest(self, length: int) -> int | None:
        """An open bin with the least room that still holds `length`."""
        above = self.mask >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        return min(self.rooms[room])


def best_fit(lengths: list[int], capacity: int) -> Bins:
    """Longest first, each into the fullest bin that holds it."""
    bins = Bins(capacity)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        b = bins.tightest(lengths[k])
        if b is None:
            b = bins.new()
        else:
            bins.take(b)
        bins.items[b].append(k)
        bins.put(b, bins.free[b] - lengths[k])
    return bins


def local_search(bins: Bins, lengths: list[int]) -> int:
    """Empty bins by moves, one-for-one and two-for-one exchanges between underfull bins; returns how many were emptied.

    The least filled bin that may still give is the donor; bins filled to `UNDERFULL` and more give nothing, but take what
    fits. An exchange takes tokens from the donor to a bin that ends up fuller than the donor was, so the sum of squared
    fills grows and the search ends: when no exchange helps any donor, or when no fewer bins can hold the tokens. Of the
    exchanges that a donor allows, the one that takes most tokens is done.
    """
    capacity = bins.capacity
    least = -(-sum(lengths) // capacity)
    spare = (1 - UNDERFULL) * capacity
    used = sum(1 for b in bins.items if b)
    started = used
    for b in bins.items:
        b.sort(key=lambda k: lengths[k])
    held = lambda b: tuple(lengths[k] for k in bins.items[b])
    stuck: set[tuple] = set()  # what donors hold that nothing helps as the bins are now
    while used > least:
        donors = [b for b, own in enumerate(bins.items) if own and bins.free[b] > spare and (not stuck or held(b) not in stuck)]
        if not donors:
            break
        donor = max(donors, key=lambda b: (bins.free[b], -b))
        found = best_exchange(bins, lengths, donor)
        if found is None:
            stuck.add(held(donor))
            continue
        b, out, back = found
        for k in out:
            bins.items[donor].remove(k)
        for k in back:
            bins.items[b].remove(k)
        bins.items[donor] = sorted(bins.items[donor] + back, key=lambda k: lengths[k])
        bins.items[b] = sorted(bins.items[b] + out, key=lambda k: lengths[k])
        gain = sum(lengths[k] for k in out) - sum(lengths[k] for k in back)
        bins.free[donor] += gain
        bins.free[b] -= gain
        stuck = set()
        used -= not bins.items[donor]
    return started - used


def best_exchange(bins: Bins, lengths: list[int], donor: int) -> tuple[int, list[int], list[int]] | None:
    """(bin, documents it gets, documents it gives) that takes most tokens off the donor, None if no exchange helps."""
    own = bins.items[donor]
    fill = bins.capacity - bins.free[donor]
    offers = [(lengths[k], [k]) for k in own] + [(lengths[i] + lengths[j], [i, j]) for x, i in enumerate(own) for j in own[:x]]
    offers = sorted({size: (size, items) for size, items in offers}.values(), key=lambda o: -o[0])  # one of each size
    best, most = None, 0
    for b, items in enumerate(bins.items):
        room = bins.free[b]
        if b == donor or not items or not room or room <= most:
            continue
        base = bins.capacity - room
        sizes = [lengths[k] for k in items]
        for size, out in offers:
            if size <= most:
                break
            # the least that comes back must leave room: back >= size - room
            needed = size - room
            if needed <= 0:
                gain, back = size, []
            else:
                at = bisect_left(sizes, needed)
                gain, back = (size - sizes[at], [items[at]]) if at < len(sizes) else (0, [])
                if len(out) == 1:  # two of the bin for one of the donor
                    low, high = 0, len(sizes) - 1
                    while low < high:
                        both = sizes[low] + sizes[high]
                        if both < needed:
                            low += 1
                        else:
                            if size - both > gain:
                                gain, back = size - both, [items[low], items[high]]
                            high -= 1
            if gain > most and base + gain > fill:
                best, most = (b, out, back), gain
    return best


def pack_group(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bin and offset of each row of one group, with the bin's fill."""
    lengths = frame["length"].tolist()
    bins = best_fit(lengths, capacity)
    local_search(bins, lengths)
    n = len(frame)
    bin_of, offset, fill = [0] * n, [0] * n, [0] * n
    for b, items in enumerate(bins.items):
        at = 0
        for k in sorted(items):
            bin_of[k], offset[k] = b, at
            at += lengths[k]
        for k in items:
            fill[k] = at
    return frame.assign(bin=bin_of, offset=offset, fill=fill)


def pack(df: DataFrame, key_columns: list[str], capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of 1 to `capacity`; every row is placed, gapless from 0.

    `key_columns` name a row for the dealing and the order; rows alike in them and in length are interchangeable. Other
    columns are kept, whatever their names; those named like the two added give way. No rows give none.
    """
    names = [c for c in df.columns if c not in ("sequence_id", "offset")]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # columns go by number inside, so that no name clashes
    own = [f"c{k}" for k in range(len(names))]
    order = [own[names.index(c)] for c in [*key_columns, "length"]]
    rows = stored(df.select(*[quoted(c).alias(k) for c, k in zip(names, own)], quoted("length").alias("length")), "pieces")

    def packed(rows: DataFrame, level: int) -> DataFrame:
        """Deal rows into groups of about `group` and pack each."""
        groups = max(1, -(-rows.count() // group))
        # equal rows have one hash: their place in the written table deals them apart
        dealt = rows.withColumn("group", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(groups)))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return pack_group(frame.sort_values(order, ignore_index=True), capacity)

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
        placed = dealt.groupBy("group").applyInPandas(run, f"{fields}, bin int, offset long, fill long")
        # level, group and bin make the number of a sequence
        return placed.withColumn("sequence_id", (F.col("group") * 2 + level) * F.lit(1 << 20) + F.col("bin"))

    first = stored(packed(rows, 0), "packed")
    discard(rows)
    full = F.col("fill") >= int(UNDERFULL * capacity)
    again = packed(stored(first.where(~full).select(*own, "length"), "underfull"), 1)
    both = first.where(full).unionByName(again)
    return both.select(*[F.col(k).alias(c) for c, k in zip(names, own)], "sequence_id", "offset")
