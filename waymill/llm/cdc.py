"""Overlap of records across splits by content-defined chunks.

A record is an ordered list of steps, each a numeric vector; null and NaN slots are 0. A rolling (gear) hash over a
record's steps cuts it where its low bits are zero, so that a cut depends on the content next to it only and finds its way
back after an insertion. A chunk goes by a digest of its steps; records that share a stretch share its chunks, and each
distinct chunk is handled once, however many records hold it.

``exact_overlap`` joins chunk digests across splits and sums the lengths of shared chunks into a fraction per record.

``near_overlap`` does the same for pairs of records, and within a tolerance: a chunk shares its whole length with a record
that has its digest, and with any other the steps of it that match one of the record's; these lengths are summed over the
record's chunks. Steps within the tolerance are found by digests of cells; a step near a cell's border is looked up in both
cells, so none is missed, and all slots are checked. A single step can match where its chunk as a whole doesn't, so no pair
is lost to the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.session import written

#: Slots of a step that stay apart for different edges: both ends and the place reached.
ANCHOR = (0, 1, 2, 3, 13, 14)
#: Width of the cells of anchor slots; far above the tolerance, so that few slots are near a border.
CELL = 64.0


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gear(symbols: np.ndarray) -> np.ndarray:
    """Rolling hash along the last axis: h = 2h + mix(symbol). A symbol has left it after 64 steps."""
    out = np.zeros(symbols.shape, np.uint64)
    state = np.zeros(symbols.shape[:-1], np.uint64)
    for k in range(symbols.shape[-1]):
        state = (state << np.uint64(1)) + _mixed(symbols[..., k])
        out[..., k] = state
    return out


def cut_chunks(symbols: np.ndarray, mask_bits: int, window: int = 4, *, starts: np.ndarray | None = None, longest: int = 32) -> np.ndarray:
    """Chunk number of each symbol. A chunk ends after a symbol where the gear hash of the last ``window`` symbols has
    ``mask_bits`` zero bits (with 0 bits each symbol is a chunk), after ``longest`` symbols, and with its stream:
    ``starts`` marks the first symbols of streams laid end to end (one, if not given)."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    first = at == 0 if starts is None else starts | (at == 0)
    stream = np.maximum.accumulate(np.where(first, at, 0))
    mixed = _mixed(symbols)
    rolled = np.zeros(n, np.uint64)
    for back in range(min(window, n)):
        rolled[back:] += np.where(at[back:] - back >= stream[back:], mixed[: n - back] << np.uint64(back), np.uint64(0))
    ends = (_mixed(rolled) & np.uint64((1 << mask_bits) - 1)) == 0
    fresh = first | np.concatenate([[True], ends[:-1]])
    fresh |= (at - np.maximum.accumulate(np.where(fresh, at, 0))) % longest == 0
    return np.cumsum(fresh) - 1


def normalised_steps(df: DataFrame, record: Sequence[str], slots: int, *, every: bool = False) -> DataFrame:
    """(record columns, step_id, v array<double>): one row per step that has a vector, nulls and NaNs 0, padded or cut to
    ``slots`` slots. Of a step with several vectors the smallest is kept or, with ``every``,
    each distinct one in a row of its own. Null ids and null vectors are left out."""
    clean = F.transform(F.col("feature_vec"), lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    padded = F.slice(F.concat(clean, F.array_repeat(F.lit(0.0), slots)), 1, slots)
    known = F.col("feature_vec").isNotNull() & F.col("step_id").isNotNull()
    for name in record:
        known &= F.col(name).isNotNull()
    if every:
        return df.where(known).select(*record, "step_id", padded.alias("v")).distinct()
    return df.where(known).groupBy(*record, "step_id").agg(F.min(padded).alias("v"))


def _digests(tolerance: float, cell: float, anchor: Sequence[int], probe: bool):
    """Rows to rows with a chunk digest: one for the cell a step is in, or, as a probe, one for each cell that a step
    within the tolerance can be in (at most two per anchor slot)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4000):
                batch = whole.slice(begin, 4000)
                if not batch.num_rows:
                    continue
                vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, list(anchor)]
                # beyond 2**62 cells all values share the outermost cell; infinities go there too
                cells = lambda shift: np.floor(np.clip((vectors + shift) / cell + 0.5, -(2.0**62), 2.0**62)).astype(np.int64)  # noqa: E731, B023
                if not probe:
                    rows, streams = np.arange(batch.num_rows), cells(0.0)
                else:
                    slack = tolerance * (1 + 1e-9) + 1e-9
                    low, high = cells(-slack), cells(slack)
                    rows, streams = np.arange(batch.num_rows), low.copy()
                    for k in range(len(anchor)):
                        both = np.flatnonzero(low[rows, k] != high[rows, k])
                        more = streams[both].copy()
                        more[:, k] = high[rows[both], k]
                        rows, streams = np.concatenate([rows, rows[both]]), np.concatenate([streams, more])
                code = gear(streams.view(np.uint64))[:, -1].view(np.int64)
                take = pa.array(rows)
                columns = [c.take(take) for c in batch.columns] + [pa.array(code)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "digest"])

    return digest


def _cut(mask_bits: int, window: int, longest: int, held_rows: int = 65_536):
    """Rows (p, q: the record's two hashes, step_id, a, b: the vector's two hashes, …), ordered by record and step, with the
    digest (lo, hi), the place and the length of the step's chunk, and the number n of the record's steps. A record's rows
    are held together."""

    def chunks(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        get = lambda name: table.column(name).to_numpy()
        p, q, step = get("p"), get("q"), get("step_id")
        record = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        fresh = record | np.concatenate([[True], step[1:] != step[:-1]])
        first = np.flatnonzero(fresh)
        # one symbol a step: a sum over its vectors, in no order
        symbols = [_mixed(np.add.reduceat(_mixed(get(c).view(np.uint64)), first)) for c in ("a", "b")]
        number = cut_chunks(symbols[0], mask_bits, window, starts=record[first], longest=longest)
        head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        length = np.diff(np.concatenate([head, [len(number)]]))
        place = np.arange(len(number)) - head[number]
        # a sum of steps mixed with their places: equal for equal chunks only, but for 2**-128
        digests = [_mixed(np.add.reduceat(_mixed(x + _mixed(place.astype(np.uint64) + np.uint64(k))), head) + length.astype(np.uint64)) for k, x in enumerate(symbols, 1)]
        of_row = np.cumsum(fresh) - 1
        chunk = number[of_row]
        ends = np.cumsum(record[first]) - 1
        more = [pa.array(np.bincount(ends)[ends][of_row]), pa.array(digests[0].view(np.int64)[chunk]), pa.array(digests[1].view(np.int64)[chunk]), pa.array(place[of_row].astype(np.int32)), pa.array(length[chunk].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in table.columns], *more], names=[*table.column_names, "n", "lo", "hi", "place", "length"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= held_rows:  # the last record may go on in the next batch
                table = pa.Table.from_batches(held)
                p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
                turn = np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1]))
                whole = int(turn[-1]) + 1 if len(turn) else 0
                if whole:
                    yield chunks(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), table.num_rows - whole
        if held:
            yield chunks(pa.Table.from_batches(held))

    return cut


def chunked_steps(df: DataFrame, record: Sequence[str], *, slots: int = 15, decimals: int | None = None, mask_bits: int = 1, window: int = 4, longest: int = 32) -> DataFrame:
    """(``record``, rec, step_id, v, vec, chunk, place, length, n): each step of each record with its chunk and the number n of
    the record's steps; a step with several
    vectors has a row for each, all in one place. rec, vec and chunk are pairs of 64-bit hashes; with ``decimals``, vectors
    count as equal if they are once rounded. Repeats go in the map stage; one more shuffle lays out the records."""
    steps = normalised_steps(df, record, slots, every=True)
    if decimals is not None:
        steps = steps.withColumn("v", F.transform("v", lambda x: F.round(x, decimals) + F.lit(0.0))).distinct()
    hashes = {name: F.xxhash64(*columns, F.lit(k)) for k, name, columns in ((11, "p", record), (12, "q", record), (11, "a", ["v"]), (12, "b", ["v"]))}
    keyed = steps.select(*[F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(record)], "step_id", "v", *[h.alias(n) for n, h in hashes.items()])
    schema = T.StructType([*keyed.schema.fields, *[T.StructField(n, k) for n, k in (("n", T.LongType()), ("lo", T.LongType()), ("hi", T.LongType()), ("place", T.IntegerType()), ("length", T.IntegerType()))]])
    rows = keyed.repartition("p", "q").sortWithinPartitions("p", "q", "step_id").mapInArrow(_cut(mask_bits, window, longest), schema)
    names = [F.col(f"_k{i}").cast(df.schema[c].dataType).alias(c) for i, c in enumerate(record)]
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return rows.select(*names, pair("p", "q").alias("rec"), "step_id", "v", pair("a", "b").alias("vec"), pair("lo", "hi").alias("chunk"), "place", "length", "n")


def _held(steps: DataFrame) -> DataFrame:
    """(rec, chunk, length, times): the chunks of each record and how often it has them."""
    return steps.where("place = 0").groupBy("rec", "chunk", "length").agg(F.countDistinct("step_id").alias("times"))


def near_overlap(
    evaluation: DataFrame, training: DataFrame, *, record: Sequence[str], source: Sequence[str], tolerance: float = 0.5, num: int = 3, den: int = 5, slots: int = 15, cell: float = CELL, anchor: Sequence[int] = ANCHOR, mask_bits: int = 1
) -> DataFrame:
    """Pairs of an evaluation record and a training record where at least num/den of the steps of the former match some
    step of the latter: all slots differ by at most ``tolerance``.

    Columns: ``record`` of the evaluation side, ``source`` of the training side (prefixed ``train_``), matched, steps.
    A pair is sought through the rarest n - ceil(n*num/den) + 1 steps of the evaluation record, of which a pair above the
    limit must share one: a step that a third of all records share is thus not joined unless a record consists of such.
    Then each distinct chunk of the evaluation side is compared with the training records sought for the records that hold
    it, once for all of them: its whole length is shared where its digest is among theirs, else the steps (a bit each)
    that match one of theirs. The lengths shared by a record's chunks are summed. Records without steps have no pairs; a
    step with several vectors counts once, and matches if any of them does; an infinite slot matches nothing.
    """
    ours = written(chunked_steps(evaluation, record, slots=slots, mask_bits=mask_bits), "steps")
    theirs = written(chunked_steps(training, source, slots=slots, mask_bits=mask_bits), "steps")
    our_vectors = ours.select("vec", "v").distinct()
    their_vectors = theirs.groupBy("vec", "v").agg(F.count(F.lit(1)).alias("often"))

    schema = "vec struct<a: bigint, b: bigint>, v array<double>"
    probes = our_vectors.mapInArrow(_digests(tolerance, cell, anchor, True), schema + ", digest bigint")
    cells = their_vectors.mapInArrow(_digests(tolerance, cell, anchor, False), schema + ", often bigint, digest bigint")
    close = F.forall(F.zip_with("ov", "tv", lambda a, b: F.abs(a - b) <= tolerance + 1e-9), lambda x: x)
    matches = probes.select(F.col("vec").alias("ours"), F.col("v").alias("ov"), "digest").join(cells.select(F.col("vec").alias("theirs"), F.col("v").alias("tv"), "often", "digest"), "digest").where(close).select("ours", "theirs", "often").distinct()
    matches = written(matches, "matches")
    # of the training side only steps that match anything are needed from here on
    holders = written(theirs.select(F.col("vec").alias("theirs"), F.col("rec").alias("t")).join(matches.select("theirs").distinct(), "theirs", "left_semi").distinct(), "holders")

    # candidates: records that meet in one of the rarest steps of the evaluation record; those that match nothing come
    # first in the order of rarity, so only their number counts
    reach = matches.groupBy(F.col("ours").alias("vec")).agg(F.sum("often").alias("reach"))
    steps = ours.select("rec", "step_id", "vec", "n").join(reach, "vec")
    # a step's vectors are alternatives: it has the reach of all of them, one rank, and counts once
    by_record = Window.partitionBy("rec")
    whole = steps.repartition("rec").withColumn("whole", F.sum("reach").over(Window.partitionBy("rec", "step_id")))
    ranked = whole.withColumn("k", F.dense_rank().over(by_record.orderBy("whole", "step_id"))).withColumn("m", F.max("k").over(by_record))
    lead = F.col("n") - F.ceil(F.col("n") * num / den).cast("bigint") + 1
    rare = ranked.where(F.col("n") - F.col("m") + F.col("k") <= lead).select(F.col("rec").alias("e"), F.col("vec").alias("ours"), "n").distinct()
    candidates = written(rare.join(matches.select("ours", "theirs"), "ours").join(holders, "theirs").select("e", "t", "n").distinct(), "candidates")

    # shared lengths: each distinct chunk against the training records sought for it
    sought = ours.join(candidates.select(F.col("e").alias("rec")).distinct(), "rec", "left_semi")
    held = _held(sought).select(F.col("rec").alias("e"), F.col("chunk").alias("c"), "times")
    asked = candidates.join(held, "e").select("c", "t").distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))
    finite = F.forall("v", lambda x: F.abs(x) < float("inf"))
    content = sought.select(F.col("chunk").alias("c"), bit.alias("bit"), F.col("vec").alias("ours"), finite.alias("finite")).distinct()
    found = theirs.select(F.col("chunk").alias("c"), F.col("rec").alias("t")).join(candidates.select("t").distinct(), "t", "left_semi").distinct()
    equal = asked.join(found, ["c", "t"])
    entire = content.groupBy("c").agg(F.bit_count(F.bit_or(F.when(F.col("finite"), F.col("bit")).otherwise(0))).alias("shared"))
    near = asked.join(equal, ["c", "t"], "left_anti").join(content, "c").join(matches.select("ours", "theirs"), "ours").join(holders, ["theirs", "t"], "left_semi")
    near = near.groupBy("c", "t").agg(F.bit_count(F.bit_or("bit")).alias("shared"))
    lengths = equal.join(entire, "c").select("c", "t", "shared").unionByName(near)
    shared = candidates.join(held, "e").join(lengths, ["c", "t"]).groupBy("e", "t").agg(F.sum(F.col("shared") * F.col("times")).alias("matched"), F.first("n").alias("steps"))
    shared = written(shared.where(F.col("matched") * den >= F.col("steps") * num), "shared")
    left = ours.select(F.col("rec").alias("e"), *record).join(shared.select("e").distinct(), "e", "left_semi").distinct()
    right = theirs.select(F.col("rec").alias("t"), *[F.col(c).alias(f"train_{c}") for c in source]).join(shared.select("t").distinct(), "t", "left_semi").distinct()
    return shared.join(left, "e").join(right, "t").select(*record, *[f"train_{c}" for c in source], "matched", "steps")


def exact_overlap(evaluation: DataFrame, training: DataFrame, *, record: Sequence[str], source: Sequence[str], slots: int = 15, decimals: int = 2, mask_bits: int = 1) -> DataFrame:
    """Per evaluation record the fraction of its steps inside chunks that the training side has too.

    Columns: ``record``, steps, shared, fraction. A chunk is one to a few steps, cut by content; each distinct digest
    of the training side counts once, however many records hold it, so hot chunks are one row of the join.
    """
    cut = lambda df, keys: chunked_steps(df, keys, slots=slots, decimals=decimals, mask_bits=mask_bits)
    ours = cut(evaluation, record).where("place = 0").select(*record, "step_id", "chunk", "length").distinct()
    known = cut(training, source).select("chunk").distinct().withColumn("known", F.lit(1))
    sums = ours.join(known, "chunk", "left").groupBy(*record).agg(F.sum("length").alias("steps"), F.sum(F.when(F.col("known") == 1, F.col("length")).otherwise(0)).alias("shared"))
    return sums.select(*record, "steps", "shared", (F.col("shared") / F.col("steps")).alias("fraction"))
