"""Byte-level BPE as a bounded-lookahead streaming transducer.

The last token of the encoding of every prefix is kept. It is the one token that ends there and whose border with
the last token of the prefix before it survives all merges; a border's fate is decided by the right spine of the
token before and the left spine of the token after it, walked in the order of ranks. So one byte more costs a few
border tests, and nothing is ever merged and undone.

How far later bytes can reach back follows from the merge list: a border moves only if a merge crosses it, crossings
go left in chains of growing rank, and each link's left part must begin the right part of the next. The longest such
chain is the sufficient lookahead. A token that ends that many bytes before the end of what was read is final, and is
emitted; memory is the lookahead plus the longest token, whatever the text's length.

Texts are cut into pretokens on NumPy planes, and a pretoken's ids are kept by hash, so the transducer itself runs once
for each distinct pretoken of a worker.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from waymill.llm.textplane import HASHED, HashIndex, Plane, run_hashes, slices

#: Where the public vocabulary file lies; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
NEVER = 1 << 60
#: Pretokens a worker keeps before it starts afresh.
KEPT = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable Latin-1, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class Merges:
    """A merge list: token ids by bytes, the rank of each mergeable pair, and each token's spines."""

    def __init__(self, vocabulary: str) -> None:
        """``vocabulary``: the content of a tokenizer's JSON file."""
        model = json.loads(vocabulary)["model"]
        letters = byte_alphabet()
        spelled = lambda s: bytes(letters[c] for c in s)
        self.ids = {spelled(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (spelled(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = rank
            self.parts.setdefault(whole, (a, b, rank))
        mergeable = {t for t in self.ids if len(t) == 1 or self.ids[t] in self.parts}
        self.tokens = {t: self.ids[t] for t in mergeable}
        self.suffixes = {t[k:] for t in mergeable for k in range(len(t))}
        self.longest = max(map(len, mergeable))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._border: dict[tuple[int, int], bool] = {}
        self.lookahead = self._sufficient_lookahead()

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank at which it is merged into the next) from the outermost byte of a side up to the token."""
        known = self._right if side else self._left
        if token not in known:
            chain, at, rank = [], token, NEVER
            while True:
                chain.append((at, rank))
                if at not in self.parts:
                    break
                rank = self.parts[at][2]
                at = self.parts[at][side]
            known[token] = chain[::-1]
        return known[token]

    def border(self, before: int, after: int) -> bool:
        """Whether the border between two adjacent tokens survives all merges."""
        key = (before, after)
        if key not in self._border:
            left, right = self.spine(before, 1), self.spine(after, 0)
            i = j = 0
            holds = True
            while True:
                (a, ends_a), (b, ends_b) = left[i], right[j]
                rank = self.rank.get((a, b), NEVER)
                if rank < ends_a and rank <= ends_b:  # of equal ranks the merge further left goes first
                    holds = False
                    break
                if ends_a == NEVER and ends_b == NEVER:
                    break
                if ends_a <= ends_b:
                    i += 1
                else:
                    j += 1
            if len(self._border) > KEPT:
                self._border.clear()
            self._border[key] = holds
        return self._border[key]

    def _sufficient_lookahead(self) -> int:
        """Bytes after which a token's end can't move any more: the longest chain of crossings, in bytes."""
        best: dict[int, int] = {}
        most = 1
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            reach = len(self.bytes_of[a]) + max(best.get(part, 0) for part, _ in self.spine(b, 0))
            best[a] = max(best.get(a, 0), reach)
            most = max(most, reach)
        return most


class Transducer:
    """Bytes of one pretoken in, final token ids out."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.held = b""  # bytes after the last final border
        self.last: list[int] = [-1]  # last token of the encoding of each prefix of `held`; at 0 the token before it

    def feed(self, data: bytes) -> list[int]:
        """Take bytes; give the ids that no further byte can change."""
        merges = self.merges
        tokens, suffixes, border, last = merges.tokens, merges.suffixes, merges.border, self.last
        out: list[int] = []
        held = self.held
        for start in range(0, len(data), 4 * merges.lookahead):
            held += data[start : start + 4 * merges.lookahead]
            for end in range(len(last), len(held) + 1):
                chosen = -1
                for begin in range(end - 1, -1, -1):
                    piece = held[begin:end]
                    if piece not in suffixes:
                        break
                    token = tokens.get(piece, -1)
                    if token >= 0 and ((before := last[begin]) < 0 or border(before, token)):
                        chosen = token
                        break
                last.append(chosen)
            if len(held) > 2 * (merges.lookahead + merges.longest):
                ids, ends = self._path(held, last)
                final = sum(e <= len(held) - merges.lookahead for e in ends)
                if final:
                    out += ids[:final]
                    held, last = held[ends[final - 1] :], last[ends[final - 1] :]
                    last[0] = ids[final - 1]
                    self.last = last
        self.held = held
        return out

    def finish(self) -> list[int]:
        """The rest, at the end of the pretoken."""
        ids, _ = self._path(self.held, self.last)
        self.reset()
        return ids

    def _path(self, held: bytes, last: list[int]) -> tuple[list[int], list[int]]:
        ids, ends, at = [], [], len(held)
        while at > 0:
            ids.append(last[at])
            ends.append(at)
            at -= len(self.merges.bytes_of[last[at]])
        return ids[::-1], ends[::-1]


class Decoder:
    """Token ids in, text out: an incremental state machine over the tokens' bytes. Characters may span tokens; bytes
    that are no UTF-8 become U+FFFD."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join([self.merges.bytes_of[i] for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


LETTER, NUMBER, OTHER, SPACE, EDGE = 1, 2, 3, 0, 4


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            for begin, end in _shifted(run.start(), run.end()):
                table[begin:end] = kind
    return table


def _shifted(begin: int, end: int) -> list[tuple[int, int]]:
    """Places in the string without surrogates back to code points."""
    gap = 0xE000 - 0xD800
    if end <= 0xD800:
        return [(begin, end)]
    if begin >= 0xD800:
        return [(begin + gap, end + gap)]
    return [(begin, 0xD800), (0xE000, end + gap)]


#: Letters after an apostrophe that are a pretoken with it.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def pretoken_starts(points: np.ndarray, classes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of pretoken starts. ``first``, ``last``: masks of the first and last code point of each text.

    Runs of letters, of numbers and of other signs are pretokens, with one plain blank before them; of other white
    space the last character before a run stands alone; an apostrophe that starts a run takes certain letters.
    """
    kind = classes[points]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first], after[last] = EDGE, EDGE
    blank = np.zeros(len(points), bool)
    blank[1:] = points[:-1] == 32
    blank &= ~first
    starts = (kind != before) & ~(blank & (kind != SPACE))
    starts |= (kind == SPACE) & (before == SPACE) & (after != SPACE) & (after != EDGE)
    at = np.flatnonzero((points == 39) & (before != OTHER) & ~blank & (after == LETTER))
    if len(at):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        inside = np.concatenate([~first, np.zeros(4, bool)])  # place k goes on the text of place k - 1
        short = np.isin(one, [ord(c) for c in SHORT])
        long = np.zeros(len(at), bool)
        for a, b in LONG:
            long |= (one == ord(a)) & (two == ord(b))
        long &= inside[at + 2]
        starts[at[short | long] + 1] = False
        for matched, width in ((at[short], 2), (at[long], 3)):
            following = matched + width
            following = following[inside[following]]
            starts[following] = True
    return starts


class Encoder:
    """Texts to ids; one per worker."""

    def __init__(self, vocabulary: str) -> None:
        self.merges = Merges(vocabulary)
        self.transducer = Transducer(self.merges)
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        self.index = HashIndex()
        self.pool = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def pretoken(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        return self.transducer.feed(data) + self.transducer.finish()

    def _remember(self, hashes: np.ndarray, texts: list[str]) -> None:
        numbers = self.index.add(hashes)
        for number, text in zip(numbers.tolist(), texts, strict=True):
            ids = self.pretoken(text)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.int32)])
            if number >= len(self.begin):
                self.begin, self.count = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.count, np.zeros_like(self.count)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.begin[number], self.count[number] = self.used, len(ids)
            self.used += len(ids)

    def encode(self, plane: Plane) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts of a plane, and where each text's begin (one entry more)."""
        if not len(plane):
            return np.zeros(0, np.int32), np.zeros(len(plane.bounds), np.int64)
        starts = np.flatnonzero(pretoken_starts(plane.points, self.classes, plane.first(), plane.last()))
        return self._encode_runs(plane, starts, np.concatenate([starts[1:], [len(plane)]]))

    def _encode_runs(self, plane: Plane, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > KEPT:
            self.forget()
        long = np.flatnonzero(ends - starts > HASHED)
        hashes = run_hashes(plane.points, starts, ends)
        hashes[long] = 0
        number = self.index.get(hashes)
        number[long] = -2
        new = np.flatnonzero(number == -1)
        if len(new):
            fresh, where = np.unique(hashes[new], return_index=True)
            rows = new[where]
            self._remember(fresh, [plane.joined[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)])
            number[new] = self.index.get(hashes[new])
        extra = [np.array(self.pretoken(plane.joined[starts[k] : ends[k]]), np.int32) for k in long.tolist()]
        count = np.where(number >= 0, self.count[np.maximum(number, 0)], 0)
        count[long] = [len(x) for x in extra]
        begin = self.begin[np.maximum(number, 0)]
        cumulative = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(begin - cumulative[:-1], count) + np.arange(cumulative[-1])
        pool = self.pool
        if extra:  # the ids of long runs stand behind the pool
            base = len(pool) + np.concatenate([[0], np.cumsum([len(x) for x in extra])[:-1]])
            for k, at in zip(long.tolist(), base.tolist(), strict=True):
                source[cumulative[k] : cumulative[k + 1]] = at + np.arange(count[k])
            pool = np.concatenate([pool, *extra])
        ids = pool[source]
        offsets = cumulative[np.searchsorted(starts, plane.bounds)]
        return ids, offsets

    def encode_long(self, text: str, window: int) -> np.ndarray:
        """The ids of one long text, window by window; a window ends at a pretoken start that is sure."""
        parts, at = [], 0
        while at < len(text):
            size = window
            while True:
                plane = Plane([text[at : at + size]])
                starts = np.flatnonzero(pretoken_starts(plane.points, self.classes, plane.first(), plane.last()))
                if at + size >= len(text):
                    end = len(plane)
                    break
                sure = starts[starts <= len(plane) - 4]
                end = int(sure[-1])
                if end:
                    break
                size *= 2
            starts = starts[starts < end]
            cut = Plane([plane.joined[:end]])
            parts.append(self._encode_runs(cut, starts, np.concatenate([starts[1:], [end]]))[0])
            at += end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process; its memory of pretokens outlives a task."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode_column(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, window: int = 1_000_000) -> DataFrame:
    """(key, ids array<int>): every row's text as token ids, without special tokens; a text that looks like one is
    ordinary text. Empty and null texts give an empty list. Rows are neither dropped nor merged; a null key stays
    null. Narrow: no shuffle, constant memory for texts of any length.

    ``vocabulary``: path of the vocabulary file, read once on the driver and sent to the executors (its size is that
    of a vocabulary, whatever the corpus).
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            keys = batch.column(0)
            for begin, texts in slices(batch.column(1), window):
                if len(texts) == 1 and (only := texts[0].as_py()) is not None and len(only) > window:
                    ids = encoder.encode_long(only, window)
                    offsets = np.array([0, len(ids)])
                else:
                    ids, offsets = encoder.encode(Plane.of(texts))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(texts)), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(encode, f"{key} {kind}, ids array<int>")


def decode_column(df: DataFrame, *, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY, window: int = 65_536) -> DataFrame:
    """(key, text): token ids back to text, by windows of ids through the incremental decoder. A null list gives null,
    an empty one the empty text."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = worker_encoder(shared.value).merges
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                texts = []
                for row in batch.column(1):
                    values = row.as_py()
                    decoder = Decoder(merges)
                    texts.append(None if values is None else "".join([*(decoder.feed(values[k : k + window]) for k in range(0, len(values), window)), decoder.finish()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(decode, f"{key} {kind}, text string")
