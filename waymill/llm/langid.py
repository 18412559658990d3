"""Language of documents and of passages: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character n-grams of words with their borders, weighted by relative frequency times inverse document
frequency. That form is additive over words, so a worker scores each distinct word once, and any stretch of text is a
weighted mean of its words' scores. The weights are fitted by follow-the-regularised-leader with L1 and L2 penalties,
which leaves most n-grams at zero; a temperature fitted on held-out stretches calibrates the probabilities.

Documents are scored by units of prose (sentences and their parts between breaks of the flow), and the most likely
sequence of languages over the units, with a penalty for each change, parts a document into passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.llm.fmindex import LETTER, word_tables
from waymill.llm.latex import not_prose
from waymill.llm.textplane import HashIndex, Plane, run_hashes, slices

#: Languages with their codes and English names.
LANGUAGES = {
    "en": "eng english", "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish castilian", "nl": "nld dut dutch flemish", "pt": "por portuguese", "ru": "rus russian",
    "it": "ita italian", "pl": "pol polish", "cs": "ces cze czech", "sk": "slk slo slovak", "uk": "ukr ukrainian", "be": "bel belarusian", "bg": "bul bulgarian", "sr": "srp serbian",
    "hr": "hrv croatian", "sl": "slv slovenian", "ro": "ron rum romanian", "hu": "hun hungarian", "fi": "fin finnish", "et": "est estonian", "lv": "lav latvian", "lt": "lit lithuanian",
    "sv": "swe swedish", "da": "dan danish", "no": "nor norwegian", "nb": "nob", "nn": "nno", "is": "isl ice icelandic", "ga": "gle irish", "cy": "cym wel welsh", "eu": "eus baq basque",
    "ca": "cat catalan", "gl": "glg galician", "la": "lat latin", "el": "ell gre greek", "tr": "tur turkish", "ar": "ara arabic", "he": "heb hebrew", "fa": "fas per persian", "hi": "hin hindi",
    "bn": "ben bengali", "ur": "urd urdu", "ta": "tam tamil", "te": "tel telugu", "th": "tha thai", "vi": "vie vietnamese", "id": "ind indonesian", "ms": "msa may malay", "zh": "zho chi chinese",
    "ja": "jpn japanese", "ko": "kor korean", "af": "afr afrikaans", "sq": "sqi alb albanian", "mk": "mkd mac macedonian", "hy": "hye arm armenian", "ka": "kat geo georgian", "kk": "kaz kazakh",
    "sw": "swa swahili", "eo": "epo esperanto", "mt": "mlt maltese", "lb": "ltz luxembourgish", "fy": "fry frisian",
}


def named_language(label: Column) -> Column:
    """Two-letter code of the language that a label names by code, code with region, or English name; else null."""
    plain = F.lower(F.trim(label))
    code = F.regexp_extract(plain, r"^([a-z]{2,3})(?:[-_.@].*)?$", 1)
    known = {name: two for two, others in LANGUAGES.items() for name in [two, *others.split()]}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.try_element_at(table, plain))


def _word_grams(points: np.ndarray, orders: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, gram's place) of one or more words laid out with a border point 0 on both sides of each."""
    grams, places = [], []
    inside = points != 0
    for order in orders:
        if len(points) < order:
            continue
        start = np.arange(len(points) - order + 1)
        # no gram spans a border other than at its own ends
        if order > 2:
            hollow = np.concatenate([[0], np.cumsum(~inside)])
            start = start[hollow[start + order - 1] - hollow[start + 1] == 0]
        elif order == 2:
            start = start[inside[start] | inside[start + 1]]
        if order == 1:
            start = start[inside[start]]
        grams.append(run_hashes(points, start, start + order))
        places.append(start)
    return (np.concatenate(grams), np.concatenate(places)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _laid_out(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in a row, each between two border points 0, and the word that each place belongs to."""
    length = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(length)])
    owner = np.repeat(np.arange(len(starts)), length)
    inner = np.arange(at[-1]) - at[:-1][owner]
    laid = np.zeros(at[-1], np.uint32)
    letters = (inner > 0) & (inner < length[owner] - 1)
    laid[letters] = points[(starts[owner] + inner - 1)[letters]]
    return laid, owner


def word_list(plane: Plane) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case points, starts, ends) of the runs of letters."""
    kind_of, lower = word_tables()
    letter = kind_of[plane.points] == LETTER
    first = plane.first()
    joined = np.zeros(len(letter) + 1, bool)
    if len(letter):
        joined[1:-1] = letter[1:] & letter[:-1] & ~first[1:]
    return lower[plane.points], np.flatnonzero(letter & ~joined[:-1]), np.flatnonzero(letter & ~joined[1:]) + 1


@dataclass
class Model:
    """What the executors need: n-grams with weights, biases, temperature. Its size is bounded by the training sample."""

    languages: list[str]
    orders: tuple[int, ...]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    held_out: float = 0.0
    reliability: float = 0.0
    index: HashIndex | None = field(default=None, repr=False)

    def word_scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed weights of each word's n-grams, number of its n-grams)."""
        laid, owner = _laid_out(points, starts, ends)
        grams, places = _word_grams(laid, self.orders)
        where = np.minimum(np.searchsorted(self.grams, grams), max(0, len(self.grams) - 1))
        owners = owner[places]
        counts = np.bincount(owners, minlength=len(starts)).astype(float)
        scores = np.zeros((len(starts), len(self.languages)))
        if len(self.grams):
            hit = self.grams[where] == grams
            for k in range(len(self.languages)):
                scores[:, k] = np.bincount(owners[hit], weights=self.weights[where[hit], k], minlength=len(starts))
        return scores, counts


def fit(
    texts: Sequence[str],
    labels: Sequence[str],
    *,
    orders: tuple[int, ...] = (1, 2, 3, 4),
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    epochs: int = 4,
    window: int = 8,
    scale: float = 40.0,
    seed: int = 7,
) -> Model:
    """Fit on labelled texts. Each text gives its whole and its windows of ``window`` and of 3 words. A fifth of the texts is
    held out of everything but the temperature, so that it calibrates the very model that is handed out; half of its
    examples fit the temperature, the other half give the figures ``held_out`` (accuracy) and ``reliability``."""
    languages = sorted(set(labels))
    plane = Plane([t or "" for t in texts])
    points, starts, ends = word_list(plane)
    blank = Model(languages, orders, np.zeros(0, np.uint64), np.zeros((0, len(languages))), np.zeros(len(languages)), 1.0)
    if not languages or not len(starts):
        return blank
    rng = np.random.default_rng(seed)
    text_of = np.searchsorted(plane.bounds, starts, "right") - 1
    laid, owner = _laid_out(points, starts, ends)
    hashes, places = _word_grams(laid, orders)
    grams, inverse = np.unique(hashes, return_inverse=True)
    of_word = owner[places]
    by_word = np.argsort(of_word, kind="stable")
    split = np.split(inverse[by_word], np.cumsum(np.bincount(of_word, minlength=len(starts)))[:-1])
    first_word = np.searchsorted(text_of, np.arange(len(texts) + 1))
    held = set(rng.permutation(len(texts))[: len(texts) // 5].tolist())
    taken = [t for t in range(len(texts)) if t not in held]
    seen = np.zeros(len(grams))
    for t in taken:
        if first_word[t] < first_word[t + 1]:
            seen[np.unique(np.concatenate(split[first_word[t] : first_word[t + 1]]))] += 1
    idf = np.log((1 + len(taken)) / (1 + seen)) + 1

    examples = []  # (features, values, label, text)
    for t in range(len(texts)):
        a, b = int(first_word[t]), int(first_word[t + 1])
        spans = {(a, b)} | {(k, min(b, k + w)) for w in (window, 3) for k in range(a, b, w)}
        for x, y in sorted(spans):
            if y > x:
                ids, counts = np.unique(np.concatenate(split[x:y]), return_counts=True)
                examples.append((ids, scale * counts / counts.sum() * idf[ids], languages.index(labels[t]), t))
    z, n = np.zeros((len(grams) + 1, len(languages))), np.zeros((len(grams) + 1, len(languages)))

    def weights(ids: np.ndarray) -> np.ndarray:
        zi, ni = z[ids], n[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    def learn(part: list, passes: int) -> None:
        for _ in range(passes):
            for k in rng.permutation(len(part)):
                ids, values, label, _ = part[k]
                ids, values = np.append(ids, len(grams)), np.append(values, 1.0)
                w = weights(ids)
                logits = values @ w
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[label] -= 1
                g = values[:, None] * p[None, :]
                sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
                z[ids] += g - sigma * w
                n[ids] += g * g

    learn([x for x in examples if x[3] not in held], epochs)
    every = weights(np.arange(len(grams) + 1))
    tested = [(values @ every[ids] + every[-1], label) for ids, values, label, t in examples if t in held]
    temperature, accuracy, apart = 1.0, 0.0, 0.0
    if len(tested) > 1:
        order = rng.permutation(len(tested))
        logits, truth = np.array([tested[k][0] for k in order]), np.array([tested[k][1] for k in order])
        half = len(tested) // 2

        def loss(temperature: float) -> float:
            s = logits[:half] / temperature
            s = s - s.max(axis=1, keepdims=True)
            return float(-(s[np.arange(half), truth[:half]] - np.log(np.exp(s).sum(axis=1))).mean())

        temperature = min(np.geomspace(0.2, 20, 80).tolist(), key=loss)
        accuracy, apart = reliability(logits[half:] / temperature, truth[half:])
    kept = np.abs(every[:-1]).max(axis=1) > 0
    return Model(languages, orders, grams[kept], scale * idf[kept, None] * every[:-1][kept], every[-1], temperature, accuracy, apart)


def reliability(logits: np.ndarray, truth: np.ndarray, bins: int = 10) -> tuple[float, float]:
    """(accuracy, expected calibration error): the mean distance of confidence and accuracy over bins of confidence."""
    s = np.exp(logits - logits.max(axis=1, keepdims=True))
    confidence = (s / s.sum(axis=1, keepdims=True)).max(axis=1)
    right = logits.argmax(axis=1) == truth
    bin_of = np.minimum((confidence * bins).astype(int), bins - 1)
    gap = np.bincount(bin_of, weights=confidence - right, minlength=bins)
    return float(right.mean()), float(np.abs(gap).sum() / len(right))


class Labeller:
    """Scores and parts texts; one per worker and model."""

    KEPT = 500_000

    def __init__(self, model: Model, change: float) -> None:
        self.model, self.change = model, change
        self.forget()

    def forget(self) -> None:
        self.words = HashIndex()
        self.scores = np.zeros((0, len(self.model.languages)))
        self.counts = np.zeros(0)

    def _word_numbers(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.words) > self.KEPT:
            self.forget()
        hashes = run_hashes(points, starts, ends)
        number = self.words.get(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, where = np.unique(hashes[new], return_index=True)
            rows = new[where]
            self.words.add(fresh)
            scores, counts = self.model.word_scores(points, starts[rows], ends[rows])
            self.scores, self.counts = np.concatenate([self.scores, scores]), np.concatenate([self.counts, counts])
            number[new] = self.words.get(hashes[new])
        return number

    def label(self, plane: Plane) -> dict[str, np.ndarray]:
        """Passages of all texts in order: text, language (its number), words, confidence, begin, end."""
        points, starts, ends = word_list(plane)
        change = np.zeros(len(plane) + 1, np.int32)
        breaks = np.zeros(len(plane) + 1, np.int32)
        for text, base in zip(plane.texts, plane.bounds.tolist(), strict=False):
            if not text:
                continue
            begin, end, broken = not_prose(text)
            if begin:
                np.add.at(change, base + np.array(begin), 1)
                np.add.at(change, base + np.array(end), -1)
            if broken:
                breaks[base + np.array(broken)] = 1
        hidden = np.cumsum(change[:-1]) > 0
        prose = ~(hidden[starts] | hidden[ends - 1]) if len(starts) else np.zeros(0, bool)
        starts, ends = starts[prose], ends[prose]
        none = {k: np.zeros(0, np.int64) for k in ("text", "language", "words", "begin", "end")} | {"confidence": np.zeros(0)}
        if not len(starts) or not self.model.languages:
            return none
        for mark in ".!?":
            breaks[:-1] |= (plane.points == ord(mark)) & ~hidden
        text = np.searchsorted(plane.bounds, starts, "right") - 1
        broken = np.concatenate([[0], np.cumsum(breaks[:-1])])[starts]
        head = np.concatenate([[True], (text[1:] != text[:-1]) | (broken[1:] != broken[:-1])])
        at = np.flatnonzero(head)
        number = self._word_numbers(points, starts, ends)
        weight = np.add.reduceat(self.counts[number], at)
        logits = np.add.reduceat(self.scores[number], at, axis=0) / weight[:, None] + self.model.bias
        logits /= self.model.temperature
        logits -= logits.max(axis=1, keepdims=True)
        log_p = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        words = np.diff(np.concatenate([at, [len(starts)]]))
        unit_text = text[at]
        language = self._best_sequence(unit_text, log_p * words[:, None])
        # passages: runs of units of one language
        turn = np.concatenate([[True], (unit_text[1:] != unit_text[:-1]) | (language[1:] != language[:-1])])
        lead = np.flatnonzero(turn)
        last = np.concatenate([lead[1:], [len(at)]]) - 1
        p = np.exp(log_p[np.arange(len(at)), language]) * words
        total = np.add.reduceat(words, lead)
        word_end = np.concatenate([at[1:], [len(starts)]]) - 1
        base = plane.bounds[unit_text[lead]]
        return {
            "text": unit_text[lead],
            "language": language[lead],
            "words": total,
            "confidence": np.add.reduceat(p, lead) / total,
            "begin": starts[at[lead]] - base,
            "end": ends[word_end[last]] - base,
        }

    def _best_sequence(self, owner: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Most likely languages of the units, with the change penalty; all texts step by step side by side."""
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        length = np.diff(np.concatenate([begin, [len(owner)]]))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        back = np.zeros(score.shape, np.int8)
        state = score[begin].copy()
        active_at = np.searchsorted(-length, -np.arange(length[0]), "left")  # texts with more than t units
        own = np.arange(score.shape[1])
        for t in range(1, int(length[0])):
            n = int(active_at[t])
            previous = state[:n]
            best = previous.argmax(axis=1)
            jump = previous[np.arange(n), best] - self.change
            stay = previous >= jump[:, None]
            back[begin[:n] + t] = np.where(stay, own, best[:, None])
            state[:n] = np.where(stay, previous, jump[:, None]) + score[begin[:n] + t]
        out = np.zeros(len(owner), np.int64)
        current = state.argmax(axis=1)
        for t in range(int(length[0]) - 1, -1, -1):
            n = int(active_at[t])
            out[begin[:n] + t] = current[:n]
            if t:
                current[:n] = back[begin[:n] + t, current[:n]]
        return out


_LABELLERS: dict[bytes, Labeller] = {}


def training_rows(samples: DataFrame, text: str, label: str, most: int, most_chars: int) -> tuple[list[str], list[str]]:
    """At most ``most`` labelled rows of together at most ``most_chars`` characters, in the order of the text's hash, so the
    choice doesn't depend on the order of rows; a longer text isn't taken at all, never a part of it."""
    known = samples.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(text) <= most_chars)).select(text, label).distinct()
    texts, labels, left = [], [], most_chars
    for row in known.orderBy(F.xxhash64(text), text, label).limit(most).toLocalIterator():
        left -= len(row[0])
        if left < 0:
            break
        texts.append(row[0]), labels.append(row[1])
    return texts, labels


_MODELS: dict[str, Model] = {}


def fitted(texts: list[str], labels: list[str]) -> Model:
    """The model of these rows; the last one is kept, so queries over the same samples fit it once."""
    digest = hashlib.sha256(repr((texts, labels)).encode("utf-8", "surrogatepass")).hexdigest()
    if digest not in _MODELS:
        _MODELS.clear()
        _MODELS[digest] = fit(texts, labels)
    return _MODELS[digest]


def passages(documents: DataFrame, samples: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", most_samples: int = 20_000, most_chars: int = 4_000_000, change: float = 12.0) -> DataFrame:
    """(key, given, language, words, confidence, begin, end, prose_words): the passages of every document, each a maximal
    stretch of prose in one language; begin and end count characters. ``given`` is the document's label as it stands. Repeated
    documents give repeated rows.

    The classifier is fitted on the driver on at most ``most_samples`` rows of ``samples`` (text, lang), of together at most
    ``most_chars`` characters, and sent to the executors; every document is labelled over its whole text in one narrow pass. Documents without prose (null, empty,
    formulas only), and all documents if there are no samples, give one row with null language, 0 words and confidence 0. ``change`` is the log-odds cost of one
    change of language; more makes passages longer.
    """
    model = fitted(*training_rows(samples, "text", "lang", most_samples, most_chars))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tag = known.grams.tobytes() + known.weights.tobytes()
        if tag not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[tag] = Labeller(known, change)
        labeller, names = _LABELLERS[tag], pa.array([*known.languages, None], pa.string())
        for batch in batches:
            for first, part in slices(batch.column(1)):
                found = labeller.label(Plane.of(part))
                silent = np.setdiff1d(np.arange(len(part)), found["text"])
                rows = np.concatenate([found["text"], silent]).astype(np.int64)
                pad = lambda x, fill: np.concatenate([x, np.full(len(silent), fill)])  # noqa: E731, B023
                total = np.bincount(found["text"], weights=found["words"], minlength=len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)).take(pa.array(rows)),
                        batch.column(2).slice(first, len(part)).take(pa.array(rows)),
                        names.take(pa.array(pad(found["language"], len(known.languages)).astype(np.int64))),
                        pa.array(pad(found["words"], 0).astype(np.int64)),
                        pa.array(pad(found["confidence"], 0.0).astype(np.float64)),
                        pa.array(pad(found["begin"], 0).astype(np.int64)),
                        pa.array(pad(found["end"], 0).astype(np.int64)),
                        pa.array(total[rows]),
                    ],
                    names=[key, "given", "language", "words", "confidence", "begin", "end", "prose_words"],
                )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text, F.col(label).cast("string")).mapInArrow(run, f"{key} {kind}, given string, language string, words bigint, confidence double, begin bigint, end bigint, prose_words bigint")


def document_languages(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, given, language, confidence, prose_words): the language of most prose words of each document (of equal ones
    the first by name); null without prose. Of several labels of one key the smallest counts."""
    by = found.groupBy(key, "language").agg(F.sum("words").alias("words"), F.sum(F.col("confidence") * F.col("words")).alias("mass"), F.max("prose_words").alias("prose_words"), F.min("given").alias("given"))
    top = by.groupBy(key).agg(F.min("given").alias("given"), F.min_by(F.struct("language", "words", "mass", "prose_words"), F.struct(-F.col("words"), F.col("language"))).alias("t"))
    confidence = F.when(F.col("t.words") > 0, F.col("t.mass") / F.col("t.words")).otherwise(0.0)
    return top.select(key, "given", "t.language", confidence.alias("confidence"), F.col("t.prose_words").alias("prose_words"))


def label_issues(found: DataFrame, *, key: str = "doc_id", least_words: int = 20, passage_words: int = 30) -> DataFrame:
    """(key, issue, true_lang): ``missing`` and ``wrong`` labels with the main language, ``mixed`` once for each other
    language with a passage of at least ``passage_words`` words; documents with fewer than ``least_words`` words of
    prose have no issue. Of several labels of one key the smallest counts."""
    by = found.where(F.col("prose_words") >= least_words).groupBy(key, "language").agg(
        F.sum("words").alias("words"), F.max("words").alias("longest"), F.min("given").alias("given")
    )
    whole = by.groupBy(key).agg(
        F.min_by("language", F.struct(-F.col("words"), F.col("language"))).alias("main"),
        F.min("given").alias("given"),
        F.collect_list(F.when(F.col("longest") >= passage_words, F.col("language"))).alias("long"),
    )
    named = named_language(F.col("given"))
    label = F.when(named.isNull(), F.lit("missing")).when(named != F.col("main"), F.lit("wrong"))
    one = F.when(label.isNotNull(), F.array(F.struct(label.alias("issue"), F.col("main").alias("true_lang")))).otherwise(F.array().cast("array<struct<issue:string,true_lang:string>>"))
    more = F.transform(F.filter("long", lambda x: x != F.col("main")), lambda x: F.struct(F.lit("mixed").alias("issue"), x.alias("true_lang")))
    return whole.select(key, F.explode(F.concat(one, more)).alias("i")).select(key, "i.issue", "i.true_lang")
