"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary, one on toxic passages.
A document's label says nothing about where in it the toxic matter is, so toxic
documents are first cut down to passages: words that hold a character sequence,
and runs of words with pairs, that stand out against ordinary documents.  Windows
are single words and overlapping runs of ``WIDE`` words, between constant pads
(zstandard never starts a match in the last bytes of its input).  The toxic
dictionary stands before the ordinary one, which both compressors have, so that a
window's gain, how many bytes shorter it gets, comes from toxic passages alone.
Shares and counts of windows over calibrated thresholds and the largest gains, for
both kinds of windows, give the score, through a logistic function fitted on
labelled rows that the dictionaries have not seen.

Whole texts count, of any length; a null or empty text has no windows and gets
the score of no evidence.  Equal texts get equal scores, repeated rows too.  An
empty table gives no rows; without labelled rows of both classes every score is 0.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import textkit
from .labelled import fold, labelled_texts
from .storage import keep_columns, release


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    thresholds: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    wide_thresholds: list[float] = field(default_factory=list)
    level: int = 9
    wide: int = 8  # words in a run
    longest: int = 64  # a longer word is cut into parts of this many bytes


#: Constant bytes on both sides of a window, in both dictionaries, so that a window always has a match.
_HEAD, _TAIL = bytes(textkit.mix(np.arange(8, dtype=np.uint64)).tobytes()), bytes(textkit.mix(np.arange(50, 54, dtype=np.uint64)).tobytes())
#: Gains remembered at a time; a full memory is cleared.
_REMEMBERED = 200_000


def windows(text: bytes, longest: int = 64) -> list[bytes]:
    """The words in lower case; longer ones in parts."""
    words = text.lower().split()
    if len(text) > longest and max(map(len, words), default=0) > longest:
        words = [w[k : k + longest] for w in words for k in range(0, len(w), longest)]
    return words


def wide_starts(words: int, width: int) -> range:
    """Where runs of words start that overlap by half: any half a run of neighbours is together in one."""
    return range(0, max(1, words - width // 2), width // 2) if words > 1 else range(0)


#: Sequences of so many bytes tell whether a window may gain: shorter matches cost as much as they save.
_SPANS = (6, 8)


def _sequences(data: bytes, span: int) -> np.ndarray:
    """18 bits of a hash of the sequence of span bytes at each place, past the end with zeros."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view("<u8").ravel()
    with np.errstate(over="ignore"):
        return ((eight & np.uint64((1 << 8 * span) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int32)


class Meter:
    """Gains of windows under a pair of dictionaries.  A window without any byte sequence that the toxic dictionary
    has and the ordinary one has not gains nothing; others are compressed twice."""

    def __init__(self, model: ToxicityModel):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            data = zstandard.ZstdCompressionDict(content + _HEAD + _TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=model.level)
            return zstandard.ZstdCompressor(level=model.level, dict_data=data, write_content_size=False, write_checksum=False)

        self.plain, self.marked = compressor(model.ordinary), compressor(model.toxic + b" " + model.ordinary)
        self.longest, self.wide = model.longest, model.wide
        self.known: dict[bytes, int] = {}
        self.own = []
        for span in _SPANS:
            table = np.zeros(1 << 18, bool)
            table[_sequences(model.toxic, span)[: max(0, len(model.toxic) - span + 1)]] = True
            table[_sequences(model.ordinary, span)[: max(0, len(model.ordinary) - span + 1)]] = False
            self.own.append(table)

    def measure(self, window: bytes) -> int:
        framed = _HEAD + b" " + window + b" " + _TAIL
        return len(self.plain.compress(framed)) - len(self.marked.compress(framed))

    def gain(self, word: bytes) -> int:
        known = self.known.get(word)
        if known is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            known = self.known[word] = self.measure(word)
        return known

    def gains(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of the words and of the runs of words."""
        words = windows(text, self.longest)
        n, starts = len(words), wide_starts(len(words), self.wide)
        narrow, wide = np.zeros(n), np.zeros(len(starts))
        if not n:
            return narrow, wide
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        joined = b" " + b" ".join(words) + b" "
        before = np.zeros(len(joined) + 1, np.int32)  # how many places with an own sequence there are before each
        for first in range(0, len(joined), 1 << 16):
            part = joined[first : first + (1 << 16) + 8]
            found = np.zeros(len(part), bool)
            for span, table in zip(_SPANS, self.own, strict=True):
                found |= table[_sequences(part, span)]
            part_end = min(len(joined), first + (1 << 16))
            before[first + 1 : part_end + 1] = before[first] + np.cumsum(found[: part_end - first])
        begins = np.r_[0, ends[:-1]]  # of the space before each word
        for k in np.flatnonzero(before[ends] > before[begins]).tolist():
            narrow[k] = self.gain(words[k])
        firsts = np.asarray(starts, np.int64)
        lasts = np.minimum(firsts + self.wide, n) - 1
        for k in np.flatnonzero(before[ends[lasts]] > before[begins[firsts]]).tolist() if len(firsts) else ():
            wide[k] = self.measure(b" ".join(words[firsts[k] : lasts[k] + 1]))
        return narrow, wide


def features(gains: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """Largest gains, and how many windows reach each threshold."""
    top = np.sort(gains)[::-1][:3] if len(gains) else np.zeros(0)
    top = np.r_[top, np.full(3 - len(top), top.min() if len(top) else 0.0)]
    counts = np.array([np.log1p((gains >= t).sum()) for t in thresholds])
    shares = np.array([(gains >= t).mean() if len(gains) else 0.0 for t in thresholds])
    return np.r_[top / 4, counts, 10 * shares, np.log1p(len(gains)) / 4]


def evidence(gains: tuple[np.ndarray, np.ndarray], model: ToxicityModel) -> np.ndarray:
    return np.r_[features(gains[0], model.thresholds), features(gains[1], model.wide_thresholds)]


def _train(parts: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of at most size bytes.  The trainer stops at a stretch that it has already covered, so copies
    must not stand together: the order is random, by a fixed seed."""
    parts = sorted(p for p in parts if len(p) >= 8)
    parts = [parts[k] for k in np.random.default_rng(5).permutation(len(parts))]
    try:
        return zstandard.train_dictionary(size, parts, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too uniform
        return b" ".join(dict.fromkeys(parts))[-size:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x.T * s) @ x + ridge * weight.sum() * np.eye(x.shape[1]) * 0.01 + 1e-9 * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - 0.01 * ridge * weight.sum() * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _grams(word: bytes, size: int) -> set[bytes]:
    word = b" " + word + b" "
    return {word[k : k + size] for k in range(len(word) - size + 1)} if len(word) > size else {word}


def toxic_words(ordinary: list[bytes], toxic: list[bytes], size: int = 6, ratio: float = 20.0, least: int = 5) -> list[bytes]:
    """Words of toxic documents, each with its predecessor once, that hold a character sequence which toxic
    documents have over ratio times as often as ordinary ones.  Counting a word once with each predecessor
    keeps copies of a document from counting again."""
    counts, found, words_of = [], [], []
    for docs in (ordinary, toxic):
        seen: set[int] = set()
        times: Counter = Counter()
        for doc in docs:
            before = b""
            for word in doc.lower().split():
                if (pair := hash((before, word))) not in seen:
                    seen.add(pair)
                    times[word] += 1
                before = word
        counter: Counter = Counter()
        for word, n in times.items():
            for gram in _grams(word, size):
                counter[gram] += n
        counts.append(counter)
        found.append(len(seen))
        words_of.append(times)
        del seen
    marked = {g for g, n in counts[1].items() if n >= least and _stands_out(n, counts[0][g], found[1], found[0], ratio)}
    return sorted(word for word, n in words_of[1].items() if not marked.isdisjoint(_grams(word, size)) for _ in range(n))


#: How seldom chance alone may put so many occurrences of a sequence into toxic documents.
_CHANCE = 1e-4


def _stands_out(toxic: int, ordinary: int, toxic_all: int, ordinary_all: int, ratio: float) -> bool:
    """Over ratio times as often in toxic documents, and beyond chance by the upper tail of the binomial law."""
    if toxic <= ratio * toxic_all / max(1, ordinary_all) * (ordinary + 0.5):
        return False
    p, n = toxic_all / max(1, toxic_all + ordinary_all), toxic + ordinary
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(toxic, n + 1)) < _CHANCE if n < 500 else True


def toxic_passages(ordinary: list[bytes], toxic: list[bytes], ratio: float = 20.0, least: int = 5) -> list[bytes]:
    """Runs of words of toxic documents, of which each two neighbours stand out as a pair though the words may not.
    A pair counts once with the same eight words before it, so that copies of a document don't count again."""
    sides = []
    for docs in (ordinary, toxic):
        data, offsets = textkit.buffer_of(pa.array(docs, pa.large_binary()))
        hashes, rows = textkit.words(data, offsets)
        place = np.arange(len(hashes)) - np.repeat(rows[:-1], np.diff(rows))
        with np.errstate(over="ignore"):
            pairs = textkit.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
            within = np.ones(len(pairs), bool)
            edge = rows[1:-1] - 1
            within[edge[(edge >= 0) & (edge < len(pairs))]] = False
            places = np.flatnonzero(within)
            contexts = pairs[places]
            for k in range(1, 9):
                inside = place[places] >= k
                contexts[inside] = textkit.mix(contexts[inside] * np.uint64(0xD1342543DE82EF95) + hashes[places[inside] - k])
        _, first = np.unique(contexts, return_index=True)
        sides.append((pairs, places, rows, *np.unique(pairs[places[first]], return_counts=True)))
    (_, _, _, plain, plain_n), (pairs, places, rows, kinds, counts) = sides
    many = np.flatnonzero(counts >= least)
    at = np.searchsorted(plain, kinds[many])
    usual = np.where(np.r_[plain, np.uint64(0)][at] == kinds[many], np.r_[plain_n, 0][at], 0) if len(many) else np.zeros(0, int)
    total = int(counts.sum()), int(plain_n.sum())
    marked = kinds[many][[_stands_out(int(n), int(o), *total, ratio) for n, o in zip(counts[many], usual, strict=True)]] if len(many) else kinds[:0]
    starts = places[np.isin(pairs[places], marked)]
    out = []
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
        if len(run):
            row = int(np.searchsorted(rows, run[0], "right")) - 1
            # bytes.split and the hashes part words alike
            out.append((row, int(run[0] - rows[row]), int(run[-1] - rows[row]) + 2))
    texts: dict[int, list[bytes]] = {}
    return [b" ".join((texts.get(r) or texts.setdefault(r, toxic[r].lower().split()))[a:b]) for r, a, b in out]


def fit(texts: dict[int, list[str]], dictionary_bytes: int = 8 << 10) -> ToxicityModel | None:
    """A model from labelled texts; None unless both classes are there."""
    if not texts.get(0) or not texts.get(1):
        return None
    raw = {k: [t.encode() for t in v] for k, v in texts.items()}
    # One half trains the dictionaries, the other half sets thresholds and weights.
    halves = {k: (v[::2], v[1::2] or v) for k, v in raw.items()}
    usual, marked = ([d.lower() for d in halves[k][0]] for k in (0, 1))
    ordinary = _train([b" ".join(words[k : k + 16]) for words in map(bytes.split, usual) for k in range(0, len(words), 16)], dictionary_bytes, 48)
    words = _train([b"  " + w + b"  " for w in toxic_words(usual, marked)], dictionary_bytes, 16)
    runs = _train([b" " + p + b" " for p in toxic_passages(usual, marked)], dictionary_bytes, 48)
    model = ToxicityModel(ordinary, runs + b" " + words)
    meter = Meter(model)
    per = {k: [meter.gains(d) for d in halves[k][1]] for k in (0, 1)}
    # The least gains, and those that a hundredth, a thousandth and so on of ordinary windows reach.
    for side, thresholds in ((0, model.thresholds), (1, model.wide_thresholds)):
        gains = np.concatenate([g[side] for g in per[0] if len(g[side])] or [np.zeros(1)])
        thresholds += sorted({0.5, 1.5, 2.5, *(float(np.quantile(gains, q)) + 0.5 for q in (0.99, 0.999, 0.9999, 0.99999))})
    x = np.array([evidence(g, model) for k in (0, 1) for g in per[k]])
    y = np.repeat([0.0, 1.0], [len(per[0]), len(per[1])])
    model.weights = logistic(x, y, np.ones(len(y))).tolist()
    return model


def scorer(model: ToxicityModel | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model) if model else None
        for batch in batches:
            scores = []
            for text in batch.column(1):
                if meter is None:
                    scores.append(0.0)
                    continue
                z = float(np.r_[evidence(meter.gains((text.as_py() or "").encode()), model), 1.0] @ np.array(model.weights))
                scores.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 3000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; fitted on at most rows_per_class rows a class."""
    texts, _ = labelled_texts(docs, labels, label_col, rows_per_class, id_col, text_col)
    model = fit(texts)
    rows = keep_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold(F.col("doc_id")) == 0).alias("held_out"))
    scored = rows.mapInArrow(textkit.trimmed(scorer(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 3000, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold: a null or empty text has
    the score of no evidence, and equal texts stay or go together."""
    model = fit(labelled_texts(docs, labels, label_col, rows_per_class, id_col, text_col)[0])
    release(docs.sparkSession)  # the texts, and what was counted in them
    if model is None:
        return docs
    text_at, score = docs.columns.index(text_col), scorer(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = pa.nulls(batch.num_rows)
            text = batch.column(text_at).cast(pa.large_string())
            scored = next(score(iter([pa.RecordBatch.from_arrays([empty, text, empty], ["doc_id", "text", "held_out"])])))
            yield batch.filter(pa.array(np.array(scored.column(2)) < threshold))

    return docs.mapInArrow(textkit.trimmed(keep), docs.schema)
