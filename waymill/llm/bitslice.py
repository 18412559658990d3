"""Near-duplicate records by bit-sliced comparison.

A record is a set of elements. Its sketch, wider for larger sets, has one bit per bin, set when an odd number of its elements falls into the
bin, so the Hamming distance of two sketches never exceeds the size of the sets' symmetric difference. Jaccard
similarity of at least p/q bounds that difference by (q-p)/(q+p) of the summed sizes: a radius that loses no pair.

Records meet in blocks named by one of their rarest elements: of the elements in order of frequency the first
n - ceil(t*n) + 1 hold at least one that a similar record has among its own first ones. Inside blocks the sketches
stand as bit planes, one bit vector per bin over all records. Comparing every record with the one s places further
is one exclusive or of the planes with themselves shifted by s; carry-save adders count the differing bins of all
pairs at once, and a run of pairs is abandoned when each has exceeded its own radius. What is left is checked on the
sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.wkt import centimetres, line_coords
from waymill.session import checkpointed

#: Bins of the smallest sketches; a sketch has twice as many for each doubling of its set beyond ROOMY elements, up to
#: 2**MOST_DOUBLINGS times. Up to there the radius stays well below the distance of unrelated sketches.
BINS = 256
ROOMY = 180
MOST_DOUBLINGS = 7
WORDS = BINS // 64
GROUP = 7
ROUND_GROUPS = 9


def doublings(n: np.ndarray) -> np.ndarray:
    """How often the bins of a set of n elements are doubled."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / ROOMY)), 0, MOST_DOUBLINGS).astype(np.int64)


def sketches(elements: np.ndarray, owner: np.ndarray, n: int, width: int = 0) -> np.ndarray:
    """(n, WORDS * 2**width) sketches of n sets given as parallel arrays of elements (int64) and their set's number."""
    bins = BINS << width
    mixed = elements.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    cell = owner.astype(np.int64) * bins + (mixed >> np.uint64(56 - width)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * bins) & 1).astype(np.uint8).reshape(n, bins)
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray) -> np.ndarray:
    """Sketches of half as many bins: two neighbours become one, whose parity is that of both together."""
    bits = np.unpackbits(sketch.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits[:, 0::2] ^ bits[:, 1::2], axis=1, bitorder="little").view(np.uint64)


def _planes(rows: np.ndarray) -> np.ndarray:
    """(bits, words) planes over lanes of a (lanes, bits) 0/1 matrix, padded with two zero words for shifts."""
    lanes = rows.shape[0]
    words = -(-lanes // 64) + 2
    padded = np.zeros((rows.shape[1], words * 64), np.uint8)
    padded[:, :lanes] = rows.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _ahead(planes: np.ndarray, shift: int) -> np.ndarray:
    """Lane i of the result is lane i + shift."""
    skip, bits = divmod(shift, 64)
    out = np.zeros_like(planes)
    body = planes[..., skip:]
    if not bits:
        out[..., : body.shape[-1]] = body
    else:
        out[..., : body.shape[-1]] = body >> np.uint64(bits)
        out[..., : body.shape[-1] - 1] |= body[..., 1:] << np.uint64(64 - bits)
    return out


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _seven(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seven planes to the three planes of their count."""
    s1, c1 = _carry_save(x[0], x[1], x[2])
    s2, c2 = _carry_save(x[3], x[4], x[5])
    ones, c3 = _carry_save(s1, s2, x[6])
    twos, fours = _carry_save(c1, c2, c3)
    return ones, twos, fours


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)


def within_radius(sketch: np.ndarray, block: np.ndarray, size: np.ndarray, side: np.ndarray, num: int, den: int, lead: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs of one block whose sketches are within the radius of Jaccard similarity num/den.

    Rows are ordered by (block, size). ``side``: 0 pairs with everything in its block, 1 only with 2. ``lead``: rows that may
    be the first of a pair (all, if not given).
    """
    bins = sketch.shape[1] * 64
    counter = bins.bit_length()  # bits of the vertical counters: no radius of interest needs more
    lanes = np.arange(len(block))
    limit = 0
    unpacked = np.unpackbits(sketch.view(np.uint8), axis=1, bitorder="little")
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(block)]]))
    length = np.repeat(lengths, lengths)
    planes = None
    for shift in range(1, int(lengths.max(initial=0))):
        alive = length > shift
        if planes is None or alive[lanes].sum() * 2 < len(lanes):
            lanes = lanes[alive[lanes]]
            limit = len(lanes)
            pad = -bins % GROUP
            planes = _planes(np.concatenate([unpacked[lanes], np.zeros((limit, pad), np.uint8)], axis=1))
        i, j = lanes[: limit - shift], lanes[shift:]
        valid = (block[i] == block[j]) & (size[i] * den >= size[j] * num) & ((side[i] == 0) | (side[i] != side[j]))
        if lead is not None:
            valid &= lead[i]
        if not valid.any():
            continue
        radius = np.minimum((den - num) * (size[i] + size[j]) // (den + num), 2**counter - 1)
        width = planes.shape[1]
        # counters start at the room below overflow, so a carry out of the top marks a pair beyond its radius
        room = np.zeros((limit, counter), np.uint8)
        room[: limit - shift] = _bits(2**counter - 1 - radius, counter)
        counters = [np.ascontiguousarray(p) for p in _planes(room)]
        open_ = _planes(np.concatenate([valid, np.zeros(shift, bool)]).astype(np.uint8)[:, None])[0]
        beyond = np.zeros(width, np.uint64)
        groups = planes.shape[0] // GROUP
        for begin in range(0, groups, ROUND_GROUPS):
            part = planes[begin * GROUP : (begin + ROUND_GROUPS) * GROUP]
            differ = part ^ _ahead(part, shift)
            for g in range(0, len(differ), GROUP):
                added = _seven(differ[g : g + GROUP])
                carry = None
                for k in range(counter):
                    if k < 3:
                        counters[k], carry = _carry_save(counters[k], added[k], carry) if carry is not None else (counters[k] ^ added[k], counters[k] & added[k])
                    else:
                        counters[k], carry = counters[k] ^ carry, counters[k] & carry
                beyond |= carry
            if not (open_ & ~beyond).any():
                break
        left = np.flatnonzero(np.unpackbits((open_ & ~beyond).view(np.uint8), bitorder="little")[:limit])
        if len(left):
            yield lanes[left], lanes[left + shift]


ROWS = "element bigint, tile bigint, side tinyint, record string, n int, sketch binary"


def _spread(num: int, den: int, most: int):
    """Records (record, n, elements in order of frequency, their frequencies) to one row per block they belong to."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                record, lists = batch.column("record"), batch.column("elements")
                n = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                often = batch.column("often").flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(n)), n)
                width = doublings(n)
                blobs = np.empty(len(n), object)
                salt = np.zeros(len(n), np.uint64)
                for w in np.unique(width):
                    own = np.flatnonzero(width == w)
                    chosen = width[owner] == w
                    sketch = sketches(flat[chosen], np.searchsorted(own, owner[chosen]), len(own), int(w))
                    salt[own] = sketch[:, 0] ^ (sketch[:, 1] >> np.uint64(7))
                    blobs[own] = [x.tobytes() for x in sketch]
                rank = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, int)
                prefix = n - (n * num + den - 1) // den + 1
                keep = np.flatnonzero((rank < prefix[owner]) & (often > 1))
                # an element of more than `most` records is cut into chunks, and its block into tiles of two chunks
                chunks = -(-often[keep] // most)
                chunk = salt[owner[keep]] % chunks.astype(np.uint64)
                copies = chunks.astype(np.int64)
                row = np.repeat(keep, copies)
                other = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(copies)[:-1]]), copies) if len(copies) else np.zeros(0, int)
                mine = np.repeat(chunk.astype(np.int64), copies)
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                side = np.where(low == high, 0, np.where(mine == low, 1, 2)).astype(np.int8)
                who = owner[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(flat[row]),
                        pa.array(low * (1 << 31) + high),
                        pa.array(side),
                        record.take(pa.array(who)),
                        pa.array(n[who].astype(np.int32)),
                        pa.array(blobs[who], pa.binary()),
                    ],
                    names=["element", "tile", "side", "record", "n", "sketch"],
                )

    return spread


def _compare(num: int, den: int, lanes: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            table = table.combine_chunks()
            get = lambda name: table.column(name).to_numpy()
            element, tile = get("element"), get("tile")
            fresh = np.concatenate([[True], (element[1:] != element[:-1]) | (tile[1:] != tile[:-1])])
            blobs = table.column("sketch").combine_chunks()
            at = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)
            width = np.log2(np.diff(at) * 8 // BINS).astype(np.int64)
            data = np.frombuffer(blobs.buffers()[2], np.uint8)
            block, n, side = np.cumsum(fresh), get("n").astype(np.int64), get("side")
            record = table.column("record").combine_chunks()
            # a pair's sets differ by less than a doubling, the smaller comes first: its width, and the next one folded to it
            for w in np.unique(width):
                rows = np.flatnonzero((width == w) | (width == w + 1))
                wide = lambda k, rows=rows: data[at[rows[width[rows] == k]][:, None] + np.arange((BINS << int(k)) // 8)].view(np.uint64)
                sketch = np.zeros((len(rows), (BINS << int(w)) // 64), np.uint64)
                sketch[width[rows] == w] = wide(w)
                if (width[rows] == w + 1).any():
                    sketch[width[rows] == w + 1] = folded(wide(w + 1))
                for i, j in within_radius(sketch, block[rows], n[rows], side[rows], num, den, width[rows] == w):
                    yield pa.RecordBatch.from_arrays([record.take(pa.array(rows[i])), record.take(pa.array(rows[j]))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= lanes:  # keep the last block back: it may go on in the next batch
                table = pa.Table.from_batches(held)
                element, tile = table.column("element").to_numpy(), table.column("tile").to_numpy()
                last = np.flatnonzero((element != element[-1]) | (tile != tile[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                yield from pairs(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return compare


def near_duplicates(records: DataFrame, *, num: int = 7, den: int = 10, most: int = 2048, lanes: int = 32_768) -> tuple[DataFrame, DataFrame]:
    """Of ``records`` (record string, elements array<bigint>: distinct) the classes and the links between them.

    Returns (members, links). ``members`` (record, class): one row per record; records with the same set share a
    class, named by the smallest record. ``links`` (a, b, common, n_a, n_b), a < b: every pair of classes whose sets
    have a Jaccard similarity of at least num/den, each once. No partner is dropped: elements of more than ``most``
    records are compared tile by tile. Records without elements or with null are left out; an empty input gives
    empty results.
    """
    digest = F.struct(F.xxhash64("elements", F.lit(1)).alias("a"), F.xxhash64("elements", F.lit(2)).alias("b"))
    sets = records.where(F.col("record").isNotNull() & (F.size("elements") > 0)).select("record", F.array_sort("elements").alias("elements"))
    sets = checkpointed(sets.withColumn("digest", digest))
    # copies are folded by digest: of their elements one array is kept, and partial aggregation keeps one a task
    classes = checkpointed(sets.groupBy("digest").agg(F.min("record").alias("class"), F.first("elements").alias("elements")))
    members = sets.select("record", "digest").join(classes.select("digest", "class"), "digest").select("record", "class")

    held = classes.select(F.col("class").alias("record"), F.explode("elements").alias("element"))
    often = held.groupBy("element").agg(F.count(F.lit(1)).alias("often"))
    ranked = held.join(often, "element").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("e"))
    ranked = ranked.select("record", F.col("e.element").alias("elements"), F.col("e.often").alias("often"))
    blocks = ranked.mapInArrow(_spread(num, den, most), ROWS)
    ordered = blocks.repartition("element", "tile").sortWithinPartitions("element", "tile", "n", "record")
    met = ordered.mapInArrow(_compare(num, den, lanes), "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    side = lambda name: classes.select(F.col("class").alias(name), F.col("elements").alias(f"e_{name}"))
    common = F.size(F.array_intersect("e_a", "e_b"))
    both = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", common.alias("common"), F.size("e_a").alias("n_a"), F.size("e_b").alias("n_b"))
    return members, both.where(F.col("common") * (den + num) >= num * (F.col("n_a") + F.col("n_b")))


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(record_a, record_b), a < b: links and classes unfolded to pairs of records."""
    of = lambda name, record: members.select(F.col("class").alias(name), F.col("record").alias(record))
    across = links.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b")
    inside = of("a", "x").join(of("a", "y"), "a").where(F.col("x") < F.col("y"))
    return across.select("x", "y").unionByName(inside.select("x", "y")).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))


def route_vertices(route_edges: DataFrame) -> DataFrame:
    """(record, elements): of each route the distinct vertices of all its rows' lines, in whole centimetres; x and y
    share one integer, exact while y stays below 21,000 km."""
    vertex = lambda c: F.shiftleft(centimetres(c.x), 32) + centimetres(c.y)
    found = route_edges.where(F.col("route_id").isNotNull()).select(F.col("route_id").alias("record"), F.explode(F.transform(line_coords(F.col("geometry")), vertex)).alias("v"))
    return found.groupBy("record").agg(F.collect_set("v").alias("elements"))
