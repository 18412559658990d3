"""Passages of test items in a corpus, by a word-level FM-index of each training shard.

A shard's texts become one sequence of word numbers. Words that no item has are the separator: no phrase can span them,
and stretches too short for a phrase are left out before the index is built. The index is the Burrows-Wheeler
transform in a wavelet matrix. ``stored_index`` keeps the indexes of all words as a table instead, for later test sets. All phrases of all items are sought at once, last word first, by wavelet ranks;
occurrences are located by stepping back to sampled suffix positions; overlapping ones merge into removal spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymill.llm.textplane import HashIndex, Plane, run_hashes, slices
from waymill.session import written

SEPARATOR = 0
LETTER, DIGIT = 1, 2


class WaveletMatrix:
    """Ranks over a sequence of small integers: how often a symbol stands before a place."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ranks, self.zeros = [], []
        current = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            self.ranks.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in [0, place)."""
        low, high = np.zeros_like(place), place.copy()
        for level in range(self.bits):
            ones, zeros = self.ranks[level], self.zeros[level]
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol, place = np.zeros_like(place), place.copy()
        for level in range(self.bits):
            ones, zeros = self.ranks[level], self.zeros[level]
            one = ones[place + 1] > ones[place]
            symbol = symbol * 2 + one
            place = np.where(one, zeros + ones[place], place - ones[place])
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the sorted prefix; the shorter of two suffixes first, if one begins the other. A round
    sorts only the suffixes that share their prefix with another; a suffix ranks by the first place of its group."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    slots, key, width = np.arange(n), symbols[order], 1
    while len(slots):
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        slots = slots[~(fresh & np.concatenate([fresh[1:], [True]]))]
        after = order[slots] + width
        key = rank[order[slots]] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        by_key = np.argsort(key, kind="stable")
        order[slots], key = order[slots][by_key], key[by_key]
        width *= 2
    return order


class FMIndex:
    """Index of a sequence of integers in [0, symbols), every ``sample``-th position kept."""

    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = 8) -> None:
        text = np.concatenate([sequence + 1, [0]])  # 0 ends the text
        order = suffix_array(text)
        bwt = text[order - 1]
        self.bits = max(1, int(symbols).bit_length())
        self.matrix = WaveletMatrix(bwt, self.bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.sampled = order % sample == 0
        self.sampled_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]
        self.length = len(text)

    def stored(self) -> dict[str, bytes]:
        """The index as bytes: bit planes and marks packed, ranks left out."""
        planes = np.stack([np.diff(r).astype(np.uint8) for r in self.matrix.ranks])
        return {
            "planes": np.packbits(planes, axis=1).tobytes(), "zeros": np.array(self.matrix.zeros, np.int64).tobytes(), "before": self.before.astype(np.int64).tobytes(),
            "sampled": np.packbits(self.sampled).tobytes(), "positions": self.positions.astype(np.int32).tobytes(),
        }

    @classmethod
    def loaded(cls, parts: dict[str, bytes], length: int) -> FMIndex:
        """The index that ``stored`` gave as bytes; ``length`` counts the end mark."""
        index, matrix = cls.__new__(cls), WaveletMatrix.__new__(WaveletMatrix)
        get = lambda name, kind: np.frombuffer(parts[name], kind)
        matrix.zeros = get("zeros", np.int64).tolist()
        matrix.bits = index.bits = len(matrix.zeros)
        planes = np.unpackbits(get("planes", np.uint8).reshape(matrix.bits, -1), axis=1, count=length)
        matrix.ranks = [np.concatenate([[0], np.cumsum(plane, dtype=np.int64)]) for plane in planes]
        index.matrix, index.before, index.length = matrix, get("before", np.int64), length
        index.sampled = np.unpackbits(get("sampled", np.uint8), count=length).astype(bool)
        index.sampled_rank = np.concatenate([[0], np.cumsum(index.sampled)])
        index.positions = get("positions", np.int32).astype(np.int64)
        return index

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [begin, end) of suffixes that start with each phrase (rows of equal length)."""
        begin, end = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.length, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k] + 1
            begin[alive] = self.before[symbol] + self.matrix.rank(symbol, begin[alive])
            end[alive] = self.before[symbol] + self.matrix.rank(symbol, end[alive])
            alive = alive[end[alive] > begin[alive]]
        end = np.maximum(begin, end)
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        end[dead] = begin[dead]
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.sampled[here]
            ready = open_[done]
            out[ready] = self.positions[self.sampled_rank[rows[ready]]] + steps[ready]
            open_ = open_[~done]
            here = rows[open_]
            symbol = self.matrix.at(here)
            rows[open_] = self.before[symbol] + self.matrix.rank(symbol, here)
            steps[open_] += 1
        return out % self.length


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    letter, digit = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    for begin in range(0, 0x110000, 0x800):
        if 0xD800 <= begin < 0xE000:
            continue
        block = "".join(map(chr, range(begin, begin + 0x800)))
        kind[[begin + m.start() for m in letter.finditer(block)]] = LETTER
        kind[[begin + m.start() for m in digit.finditer(block)]] = DIGIT
        low = block.lower()
        if len(low) == len(block):
            lower[begin : begin + 0x800] = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        else:
            lower[begin : begin + 0x800] = [ord(low[0]) if len(low := c.lower()) == 1 else ord(c) for c in block]
    return kind, lower


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point, made once per process."""
    if not _TABLES:
        _TABLES.append(_tables())
    return _TABLES[0]


def word_runs(plane: Plane, markup: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, places, starts, ends): lower-case code points, their places in the plane, and the runs that are words.

    With ``markup``, a backslash and the letters after it part words and are none, and a backslash with a hyphen is
    taken out without parting.
    """
    kind_of, lower = word_tables()
    points, first = plane.points, plane.first()
    places = np.arange(len(points))
    if markup:
        slash = np.flatnonzero(points[:-1] == 92) if len(points) else np.zeros(0, np.int64)
        soft = slash[(points[slash + 1] == 45) & ~first[slash + 1]]
        if len(soft):
            keep = np.ones(len(points), bool)
            keep[soft] = keep[soft + 1] = False
            first = np.zeros(len(points) + 1, bool)  # a text whose first place goes begins at its next kept one
            kept = np.concatenate([[0], np.cumsum(keep)])
            marks = np.zeros(kept[-1] + 1, bool)
            marks[kept[plane.bounds]] = True
            points, places, first = points[keep], places[keep], marks[:-1]
    kind = kind_of[points]
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    before[first] = 0
    word = kind > 0
    if markup:
        begins = np.flatnonzero((kind == LETTER) & ((before != LETTER) | first))
        begins = begins[begins > 0]
        begins = begins[(points[begins - 1] == 92) & ~first[begins]]
        if len(begins):
            stop = np.flatnonzero((kind != LETTER) | first)
            at = np.searchsorted(stop, begins, "right")
            ends = np.concatenate([stop, [len(points)]])[at]
            change = np.zeros(len(points) + 1, np.int32)
            np.add.at(change, begins, 1)
            np.add.at(change, ends, -1)
            word &= np.cumsum(change[:-1]) == 0
    joined = np.zeros(len(points) + 1, bool)
    joined[1:-1] = word[1:] & word[:-1] & ~first[1:] if len(points) else False
    starts = np.flatnonzero(word & ~joined[:-1])
    ends = np.flatnonzero(word & ~joined[1:]) + 1
    return lower[points], places, starts, ends


class Phrases:
    """The items of one block: their words numbered from 1, and all phrases of ``words`` words."""

    def __init__(self, item_ids: list, texts: list[str], words: int) -> None:
        plane = Plane(texts)
        points, places, starts, ends = word_runs(plane, markup=False)
        hashes = run_hashes(points, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        vocabulary = self.vocabulary = np.unique(hashes)  # in the order of word numbers
        self.index = HashIndex()
        self.index.add(vocabulary)
        numbers = self.index.get(hashes) + 1
        self.symbols = len(vocabulary) + 1
        item = np.searchsorted(plane.bounds, places[starts], "right") - 1 if len(starts) else np.zeros(0, np.int64)
        begin = np.arange(max(0, len(numbers) - words + 1))
        begin = begin[item[begin] == item[begin + words - 1]] if len(begin) else begin
        grams = numbers[begin[:, None] + np.arange(words)] if len(begin) else np.zeros((0, words), np.int64)
        self.grams, inverse = np.unique(grams, axis=0, return_inverse=True) if len(grams) else (grams, np.zeros(0, np.int64))
        self.words = words
        # of each distinct phrase the items that have it
        pairs = np.unique(np.stack([inverse.reshape(-1), item[begin]], axis=1), axis=0) if len(begin) else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(self.grams) + 1))
        self.item_ids = item_ids


class Shard:
    """Stretches of item words of many texts, until they are searched."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.numbers: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.size = 0

    def add(self, plane: Plane, rows: np.ndarray) -> None:
        """Take the texts of a plane; ``rows``: the caller's number of each."""
        phrases = self.phrases
        points, places, starts, ends = word_runs(plane, markup=True)
        if not len(starts):
            return
        number = phrases.index.get(run_hashes(points, starts, ends)) + 1
        doc = np.searchsorted(plane.bounds, places[starts], "right") - 1
        known = number > 0
        edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])])
        at = np.flatnonzero(edge)
        length = np.diff(np.concatenate([at, [len(number)]]))
        long = known[at] & (length >= phrases.words)
        at, length = at[long], length[long]
        if not len(at):
            return
        # each stretch and one separator after it
        width = length + 1
        offset = np.arange(width.sum()) - np.repeat(np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        word = np.minimum(np.repeat(at, width) + offset, len(number) - 1)
        closing = offset == np.repeat(length, width)
        self.numbers.append(np.where(closing, SEPARATOR, number[word]))
        self.docs.append(rows[np.repeat(doc[at], width)])
        base = plane.bounds[doc[word]]
        self.begins.append(places[starts[word]] - base)
        self.ends.append(places[ends[word] - 1] + 1 - base)
        self.size += int(width.sum())

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, begin, end, words) of the merged spans, ordered by row, item, begin; then the shard is empty."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        phrases = self.phrases
        if not self.size or not len(phrases.grams):
            self.clear()
            return none
        sequence, docs = np.concatenate(self.numbers), np.concatenate(self.docs)
        begins, ends = np.concatenate(self.begins), np.concatenate(self.ends)
        self.clear()
        index = FMIndex(sequence.astype(np.int64), phrases.symbols)
        place, item = occurrences(index, phrases, phrases.grams, np.arange(len(phrases.grams)))
        return merged_spans(place, item, docs[place], begins, ends, phrases.words) if len(place) else none


def occurrences(index: FMIndex, phrases: Phrases, sought: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, item) of all occurrences of phrases, given as rows of the index's symbols with their numbers ``gram``."""
    low, high = index.search(sought)
    count = high - low
    gram = np.repeat(gram, count)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    place = index.locate(rows)
    owners = phrases.owner_at[gram + 1] - phrases.owner_at[gram]
    item = phrases.owner[np.repeat(phrases.owner_at[gram] - np.concatenate([[0], np.cumsum(owners)[:-1]]), owners) + np.arange(owners.sum())] if len(gram) else gram
    return np.repeat(place, owners), item


def merged_spans(place: np.ndarray, item: np.ndarray, doc: np.ndarray, begins: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, item, begin, end, words) of maximal stretches of phrases that overlap or touch, ordered by doc, item and begin."""
    order = np.lexsort((place, item, doc))
    place, item, doc = place[order], item[order], doc[order]
    same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (place[1:] <= place[:-1] + words)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    tail = np.concatenate([head[1:], [len(place)]]) - 1
    final = place[tail] + words - 1
    return doc[head], item[head], begins[place[head]], ends[final], final - place[head] + 1


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of bounded text (an item longer than that is a block of its own), streamed to the driver, which holds
    one block at a time."""
    ids, texts, size = [], [], 0
    for row in items.where(F.col(text).isNotNull()).select(key, text).toLocalIterator():
        if texts and size + len(row[1]) > block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0]), texts.append(row[1])
        size += len(row[1])
    if texts:
        yield ids, texts


_PHRASES: dict[str, Phrases] = {}


def worker_phrases(token: str, block: tuple[list, list[str]], words: int) -> Phrases:
    """The phrases of a block, made once per worker process; a worker keeps those of one block."""
    if token not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[token] = Phrases(*block, words)
    return _PHRASES[token]


def leaked_spans(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = 12, shard_words: int = 2_000_000, block_chars: int = 16_000_000) -> DataFrame:
    """(key, item_id, begin, end, words): each maximal stretch of a document that consists of phrases of ``words``
    consecutive words which are consecutive in the item too; begin and end count characters of the text.

    Whole texts are searched, by one narrow pass over the corpus for each block of items (one, unless the items' text
    exceeds ``block_chars``); only a block's phrases are sent to executors. Of several blocks each is searched, its spans
    are written to the shared folder and its broadcast is released before the next one is made. Null and empty texts hold
    nothing, items shorter than ``words`` can't be found; empty tables give no rows. Repeated documents give repeated rows.
    """
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    schema = f"{key} {kind}, item_id {item_kind.simpleString()}, begin bigint, end bigint, words bigint"
    names = [key, "item_id", "begin", "end", "words"]
    spark = documents.sparkSession

    def searched(block: tuple[list, list[str]]) -> tuple[DataFrame, Broadcast]:
        shared, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = worker_phrases(token, shared.value, words)
            names_of = pa.array(phrases.item_ids)
            shard, keys, held = Shard(phrases), [], 0

            def spans() -> Iterator[pa.RecordBatch]:
                row, item, begin, end, length = shard.search()
                if len(row):
                    ids = pa.concat_arrays(keys)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), names_of.take(pa.array(item)), pa.array(begin), pa.array(end), pa.array(length)], names=names)

            for batch in batches:
                for first, texts in slices(batch.column(1)):
                    keys.append(batch.column(0).slice(first, len(texts)))
                    shard.add(Plane.of(texts), held + np.arange(len(texts)))
                    held += len(texts)
                    if shard.size >= shard_words:
                        yield from spans()
                        keys, held = [], 0
            yield from spans()

        return documents.select(key, text).where(F.col(text).isNotNull()).mapInArrow(search, schema), shared

    return _by_blocks(items, item_key, item_text, block_chars, searched, schema)


def stored_index(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shard_words: int = 500_000) -> DataFrame:
    """The FM-indexes of a corpus, one row per shard, for ``indexed_spans``: write it as a table once, and any later set of
    test items is sought in it without reading the corpus again.

    Every word of every text is indexed. A shard holds about ``shard_words`` words, or one text if that is longer; its
    words are numbered by the sorted hashes of its own vocabulary, texts are parted by a separator. Null and empty texts
    and texts without words hold nothing; an empty corpus gives no rows. One narrow pass, no shuffle.
    """
    kind = documents.schema[key].dataType
    binaries = ("starts", "vocabulary", "begins", "ends", "planes", "zeros", "before", "sampled", "positions")
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("length", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in binaries]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(schema)
        keys: list[pa.Array] = []
        hashes: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        begins: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        held = size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                words, doc = np.concatenate(hashes), np.concatenate(docs)
                vocabulary, number = np.unique(words, return_inverse=True)
                # a separator after each text: words move on by the number of texts before theirs
                own, rank = np.unique(doc, return_inverse=True)
                place = np.arange(len(words)) + rank.reshape(-1)
                sequence = np.zeros(len(words) + len(own), np.int64)
                sequence[place] = number.reshape(-1) + 1
                at = {"begins": np.concatenate(begins), "ends": np.concatenate(ends)}
                spread = {n: np.zeros(len(sequence), np.int32) for n in at}
                for n, values in at.items():
                    spread[n][place] = values
                starts = place[np.concatenate([[True], rank.reshape(-1)[1:] != rank.reshape(-1)[:-1]])]
                index = FMIndex(sequence, len(vocabulary) + 1)
                parts = index.stored() | {"starts": starts.astype(np.int64).tobytes(), "vocabulary": vocabulary.tobytes(), **{n: v.tobytes() for n, v in spread.items()}}
                named = pa.concat_arrays(keys).take(pa.array(own))
                row = [pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named), pa.array([index.length]), *[pa.array([parts[n]], pa.binary()) for n in binaries]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(row, fields, strict=True)], schema=fields)
            for part in (keys, hashes, docs, begins, ends):
                part.clear()
            held = size = 0

        for batch in batches:
            for first, texts in slices(batch.column(1)):
                plane = Plane.of(texts)
                points, places, starts, stops = word_runs(plane, markup=True)
                keys.append(batch.column(0).slice(first, len(texts)))
                if len(starts):
                    doc = np.searchsorted(plane.bounds, places[starts], "right") - 1
                    base = plane.bounds[doc]
                    hashes.append(run_hashes(points, starts, stops)), docs.append(held + doc)
                    begins.append(places[starts] - base), ends.append(places[stops - 1] + 1 - base)
                held, size = held + len(texts), size + len(starts)
                if size >= shard_words:
                    yield from shard()
        yield from shard()

    return documents.select(key, text).where(F.col(text).isNotNull()).mapInArrow(build, schema)


def indexed_spans(index: DataFrame, items: DataFrame, *, key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", words: int = 12, block_chars: int = 16_000_000) -> DataFrame:
    """``leaked_spans`` of the corpus whose ``stored_index`` is given, in ``index``'s shards instead of the texts. The items go
    in blocks as there; a phrase with a word that a shard lacks isn't sought in it."""
    kind, item_kind = index.schema["keys"].dataType.elementType.simpleString(), items.schema[item_key].dataType
    schema = f"{key} {kind}, item_id {item_kind.simpleString()}, begin bigint, end bigint, words bigint"

    def searched(block: tuple[list, list[str]]) -> tuple[DataFrame, Broadcast]:
        shared, token = index.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = worker_phrases(token, shared.value, words)
            names_of = pa.array(phrases.item_ids)
            for batch in batches:
                for k in range(batch.num_rows):
                    get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)  # noqa: E731, B023
                    vocabulary = get("vocabulary", np.uint64)
                    # the shard's symbol of each item word, 0 if it has none
                    at = np.minimum(np.searchsorted(vocabulary, phrases.vocabulary), max(0, len(vocabulary) - 1))
                    symbol = np.concatenate([[0], np.where(vocabulary[at] == phrases.vocabulary, at + 1, 0)]) if len(phrases.vocabulary) else np.zeros(1, np.int64)
                    sought = symbol[phrases.grams]
                    whole = np.flatnonzero((sought > 0).all(axis=1)) if len(sought) else np.zeros(0, np.int64)
                    if not len(whole):
                        continue
                    shard = FMIndex.loaded({n: batch.column(n)[k].as_buffer() for n in ("planes", "zeros", "before", "sampled", "positions")}, batch.column("length")[k].as_py())
                    place, item = occurrences(shard, phrases, sought[whole], whole)
                    if not len(place):
                        continue
                    doc = np.searchsorted(get("starts", np.int64), place, "right") - 1
                    doc, item, begin, end, length = merged_spans(place, item, doc, get("begins", np.int32), get("ends", np.int32), words)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("keys")[k].values.take(pa.array(doc)), names_of.take(pa.array(item)), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(length)],
                        names=[key, "item_id", "begin", "end", "words"],
                    )

        return index.mapInArrow(search, schema), shared

    return _by_blocks(items, item_key, item_text, block_chars, searched, schema)


def _by_blocks(items: DataFrame, key: str, text: str, block_chars: int, searched: Callable[[tuple], tuple[DataFrame, Broadcast]], schema: str) -> DataFrame:
    """The spans of all blocks of items. Of several blocks each is searched, its spans are written to the shared folder and
    its broadcast is released before the next one is made."""
    blocks = item_blocks(items, key, text, block_chars)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return items.sparkSession.createDataFrame([], schema)
    if following is None:
        return searched(block)[0]
    found: DataFrame | None = None
    for one in chain((block, following), blocks):
        spans, shared = searched(one)
        part = written(spans, "leaks")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found
