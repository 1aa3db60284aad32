"""A hashed maximum-entropy language model with a class-factored softmax.

Words lie in a tree of classes: a class of many words is cut into ``WIDTH`` ones of
about equal mass, in order of frequency, until every word stands alone, so that
P(word | history) is a product of softmaxes over at most ``WIDTH`` branches, fewer
for frequent words.  Each branch has the log of its share of the class as its bias,
and weights by features of the history: the last word, the last two together,
and, skipping the last, the one before it.  Class and feature pick a row of one
weight table by hash.

Counting, training and scoring each pass over all documents.  Training goes in
``ROUNDS`` synchronised rounds, each over its own share of the documents: a task takes
gradient steps from the common table, and the tasks' tables are averaged row by row,
weighted by how often a row was updated.  The rows grow with the square root of the
training tokens, and so does the number of training tasks with that of the
partitions: what is exchanged grows in proportion to the input.  Words that are too
many for a broadcast table are one leaf, in which each has its share; they are
joined to their counts by a shuffle.

Words are runs of bytes other than ``\\x20\\x09-\\x0D``, with A-Z in lower case; an
end follows each document and counts as a word.  A null or empty text has the
end alone.  Ids may be null (their fold is that of the empty text) or repeated.
An empty table gives no rows; without training documents all words are unknown.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from . import textkit
from .labelled import fold
from .storage import Scratch, keep_columns, release

U64 = np.uint64
START = U64(0x1234567887654321)
#: Words in the table that all tasks hold (some 40 bytes each), and branches of a class.
TABLE_WORDS, WIDTH = 400_000, 32
#: The weight table has ROWS times the root of the training tokens as its rows, within these limits (at the most 512 MB).
ROWS, LEAST_ROWS, MOST_ROWS = 48, 1 << 12, 1 << 22
#: On how many levels of the tree the last word, the one before it, and both together are features.
LEVELS = (9, 2, 1)
ROUNDS = 3
BATCH = 4096
RATE = 0.1
#: So many of the table's rows are worked on at a time: they stay in a core's own cache.
BLOCK = 2048


@dataclass
class Vocabulary:
    """Sorted hashes of the table's words with their counts and paths; the last path is that of all other words."""

    hashes: np.ndarray
    counts: np.ndarray
    depth: np.ndarray  # of each word, and of the leaf for others
    classes: np.ndarray  # words x depths
    branches: np.ndarray
    bias: np.ndarray  # classes x WIDTH
    rows: int  # of the weight table
    rest_total: float  # sum of (count + 1) over words outside the table, and 1 for all unknown ones
    starts: np.ndarray | None = None  # by the first bits of a hash, how many hashes have smaller ones; made when first used

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are, or would be, in the sorted ones, and whether they are there.  Hashes are spread evenly, so
        that their first bits lead next to the place, and few are left to search for."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        bits = U64(64 - len(self.hashes).bit_length())
        if self.starts is None:
            each = np.bincount((self.hashes >> bits).view(np.int64), minlength=1 << (64 - int(bits)))
            self.starts = (np.cumsum(each) - each).astype(np.int32)
        place = np.take(self.starts, (hashes >> bits).view(np.int64)).astype(np.int64)
        found = np.take(self.hashes, place, mode="clip")
        left = np.flatnonzero(found < hashes)
        for _ in range(2):
            place[left] += 1
            found[left] = np.take(self.hashes, place[left], mode="clip")
            left = left[found[left] < hashes[left]]
        place[left] = np.searchsorted(self.hashes, hashes[left])
        found[left] = np.take(self.hashes, place[left], mode="clip")
        return place, found == hashes


def class_tree(mass: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, classes and branches of items in descending order of mass, and the classes' biases."""
    total = np.r_[0.0, np.cumsum(mass)]
    paths, bias, queue = [], [], [(0, len(mass), 0)]
    for number, (start, end, level) in enumerate(queue):  # the queue grows as it is walked
        cuts = [start]
        while cuts[-1] < end:  # each next branch takes its share of what is left, one item at least
            at, left = cuts[-1], width - len(cuts) + 1
            if end - at <= left:
                cuts += range(at + 1, end + 1)
                break
            share = total[at] + (total[end] - total[at]) / left
            cuts.append(end if left == 1 else min(max(at + 1, int(np.searchsorted(total, share, "right")) - 1), end - left + 1))
        row = np.full(width, -40.0)
        row[: len(cuts) - 1] = np.log(np.diff(total[cuts]) / (total[end] - total[start]))
        bias.append(row)
        if level == len(paths):
            paths.append((np.full(len(mass), -1, np.int32), np.zeros(len(mass), np.int8)))
        paths[level][0][start:end] = number
        paths[level][1][start:end] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        queue += [(a, b, level + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]
    classes, branches = (np.stack([p[k] for p in paths], 1) for k in (0, 1))
    return (classes >= 0).sum(1).astype(np.int8), classes, branches, np.array(bias, np.float32)


def tokens(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with an end after each row, and n+1 offsets."""
    data, offsets = textkit.buffer_of(part.column(part.schema.get_field_index(column)))
    hashes, rows = textkit.words(data, offsets)
    n = len(rows) - 1
    out = np.empty(len(hashes) + n, U64)
    ends = rows[1:] + np.arange(n)
    out[ends] = textkit.END
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = hashes
    return out, np.r_[0, ends + 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
    held, size = [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        for start in range(0, len(words), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(words[start : start + (1 << 17)].view(np.int64)), pa.array(n[start : start + (1 << 17)])], schema=schema)

    for batch in batches:
        for part in textkit.slices(batch, "text"):
            held.append(tokens(part, "text")[0])
            size += len(held[-1])
            if size > 6_000_000:
                yield from counted()
                held, size = [], 0
    if held:
        yield from counted()


def build_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """The table of the most frequent words, N and V."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r["level"], r["words"], r["total"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("total")).collect()), reverse=True)
    total, words = sum(x[2] for x in levels), sum(x[1] for x in levels)
    held, cut = 0, None
    for at, n, _ in levels:
        if held + n > TABLE_WORDS:
            break
        held, cut = held + n, at
    if cut is None:
        table_words, table_counts = np.zeros(0, U64), np.zeros(0, np.int64)
    else:
        table = counts.filter(level >= cut).toPandas()
        table_words, table_counts = table["word"].to_numpy(np.int64).view(U64), table["n"].to_numpy(np.int64)
    by_count = np.lexsort((table_words, -table_counts))
    table_words, table_counts = table_words[by_count], table_counts[by_count]
    rest_total = float(total - table_counts.sum() + (words - len(table_words)) + 1)
    # The leaf for other words has its place in the order too.
    mass = table_counts + 1.0
    place = int(np.searchsorted(-mass, -rest_total))
    depth, classes, branches, bias = class_tree(np.insert(mass, place, rest_total))
    order = np.argsort(table_words)
    known = np.delete(np.arange(len(mass) + 1), place)[order]
    paths = (np.ascontiguousarray(x[np.r_[known, place]]) for x in (depth, classes, branches))
    rows = int(np.clip(ROWS * total**0.5, LEAST_ROWS, MOST_ROWS))
    return Vocabulary(table_words[order], table_counts[order], *paths, bias, rows, rest_total), total, words


class Stream:
    """A slice's tokens with what the model needs of them."""

    def __init__(self, vocabulary: Vocabulary, hashes: np.ndarray, rows: np.ndarray):
        place, known = vocabulary.places(hashes)
        self.vocabulary, self.hashes, self.rows, self.known = vocabulary, hashes, rows, known
        self.place = np.where(known, place, len(vocabulary.hashes))
        firsts = rows[:-1]
        back = []
        for k in (1, 2):
            shifted = np.empty_like(hashes)
            shifted[:k], shifted[k:] = START, hashes[:-k] if k < len(hashes) else hashes[:0]
            for j in range(k):
                at = firsts + j
                shifted[at[at < rows[1:]]] = START
            back.append(shifted)
        with np.errstate(over="ignore"):
            self.features = [textkit.mix(x * U64(2 * k + 0x9E3779B97F4A7C15) + U64(k)) for k, x in enumerate((*back, back[0] * U64(0xD1342543DE82EF95) + back[1]))]

    def decisions(self, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """On the paths of these tokens, by level: the token's number, the class, the branch taken, and for each
        feature the table's rows, of as many decisions as there are on the levels that it takes part in."""
        place, v = self.place[part], self.vocabulary
        depth = v.depth[place]
        by_level = [np.flatnonzero(depth > level) for level in range(v.classes.shape[1])]
        token = np.concatenate(by_level)
        classes = np.concatenate([v.classes[place[at], level] for level, at in enumerate(by_level)])
        branches = np.concatenate([v.branches[place[at], level] for level, at in enumerate(by_level)])
        rows = []
        with np.errstate(over="ignore"):
            salt = (classes.astype(U64) + U64(99)) * U64(0xD6E8FEB86659FD93)
            for feature, levels in zip(self.features, LEVELS, strict=True):
                n = sum(map(len, by_level[:levels]))
                rows.append((((feature[part][token[:n]] ^ salt[:n]) * U64(0x9E3779B97F4A7C15) >> U64(32)) * U64(v.rows) >> U64(32)).astype(np.int32))
        return token, classes, branches, rows


_ONES = np.ones(WIDTH, np.float32)


def odds(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(logits), in place, and the sums of its rows.  Biases are below zero and weights small: a bound alone
    keeps the rest in range, which costs a tenth of taking each row's largest."""
    np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ _ONES


def sums_by_row(rows: list[np.ndarray], values: np.ndarray, short: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, how often each occurs, and the sum of its values; each of ``rows`` is for the first so many
    values.  Runs of equal rows are added up one place at a time for all runs, long ones at once."""
    bits = len(values).bit_length()
    keys = np.concatenate([r.astype(np.int64) << bits | np.arange(len(r)) for r in rows])
    keys.sort()
    ordered, source = keys >> bits, keys & ((1 << bits) - 1)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    length = np.diff(np.r_[first, len(ordered)])
    kind = np.minimum(length, short + 1).astype(np.int8)
    longest = np.argsort(-kind, kind="stable")
    first, length = first[longest], length[longest]
    over = len(first) - np.cumsum(np.bincount(kind, minlength=short + 1))  # how many runs are longer
    total = np.take(values, source[first], axis=0)
    for k in range(1, short):
        some = over[k]
        if not some:
            break
        total[:some] += np.take(values, source[first[:some] + k], axis=0)
    for k in range(over[short]):
        total[k] += np.take(values, source[first[k] + short : first[k] + length[k]], axis=0).sum(0)
    return ordered[first], length, total


class Table:
    """Weights by row with their squared gradients and numbers of updates."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray | None = None):
        self.weights = weights
        self.squares = np.full(len(weights), 1e-2, np.float32) if squares is None else squares
        self.updates = np.zeros(len(weights), np.float32)
        self.held, self.spare = np.empty((0, WIDTH), np.float32), np.empty((BLOCK, WIDTH), np.float32)

    def taken(self, source: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Up to BLOCK rows, until the next call."""
        return np.take(source, rows, axis=0, out=self.spare[: len(rows)], mode="clip")

    def odds(self, bias: np.ndarray, classes: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """By blocks of decisions: which, ``odds`` of their logits, and the sums; ``held`` has those of all decisions."""
        if len(self.held) < len(classes):
            self.held = np.empty((len(classes), WIDTH), np.float32)
        for start in range(0, len(classes), BLOCK):
            part = slice(start, min(start + BLOCK, len(classes)))
            own = np.take(self.weights, rows[0][part], axis=0, out=self.held[part], mode="clip")
            for row in rows[1:]:
                if start < len(row):
                    own[: len(row) - start] += self.taken(self.weights, row[part])
            own += self.taken(bias, classes[part])
            yield part, *odds(own)

    def step(self, rows: list[np.ndarray], gradient: np.ndarray) -> None:
        at, times, total = sums_by_row(rows, gradient)
        for start in range(0, len(at), BLOCK):
            some, change = at[start : start + BLOCK], total[start : start + BLOCK]
            squares = self.squares[some] + np.einsum("ij,ij->i", change, change) / change.shape[1]
            self.squares[some] = squares
            change *= (RATE / np.sqrt(squares))[:, None]
            weights = self.taken(self.weights, some)
            weights -= change
            self.weights[some] = weights
        self.updates[at] += times


def train_step(stream: Stream, part: slice, table: Table) -> None:
    _, classes, branches, rows = stream.decisions(part)
    for some, gradient, total in table.odds(stream.vocabulary.bias, classes, rows):
        gradient /= total[:, None]
        gradient.reshape(-1)[np.arange(len(gradient)) * WIDTH + branches[some]] -= 1
    table.step(rows, table.held[: len(classes)])


_BLOCKS = pa.schema([("block", pa.int32()), ("weights", pa.binary()), ("squares", pa.binary()), ("updates", pa.binary())])
_BLOCKS_DDL = "block int, weights binary, squares binary, updates binary"
_BLOCK_ROWS = 1 << 10


def _block(number: int, weights: np.ndarray, squares: np.ndarray, updates: np.ndarray) -> pa.RecordBatch:
    """Means over the updates, in half precision, so that no sum can leave its range."""
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (weights.astype("<f2"), squares.astype("<f4"), updates.astype("<f4")))], schema=_BLOCKS)


def _train(shared):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights, squares = shared.value
        vocabulary = Vocabulary(**held)
        table = Table(weights.astype(np.float32), squares.copy())
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                stream = Stream(vocabulary, *tokens(part, "text"))
                for start in range(0, len(stream.hashes), BATCH):
                    train_step(stream, slice(start, min(start + BATCH, len(stream.hashes))), table)
        for start in range(0, len(table.weights), _BLOCK_ROWS):
            part = slice(start, start + _BLOCK_ROWS)
            if table.updates[part].any():
                yield _block(start // _BLOCK_ROWS, table.weights[part], table.squares[part], table.updates[part])

    return train


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up blocks; rows come sorted by block, so that one is held at a time."""
    current: list = []  # block, sums of weights and squares by updates, updates

    def row() -> pa.RecordBatch:
        block, weights, squares, updates = current
        times = np.maximum(updates, 1)
        return _block(block, weights / times[:, None], squares / times, updates)

    for batch in batches:
        for block, weights, squares, updates in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            u = np.frombuffer(updates, "<f4").astype(np.float64)
            w, s = np.frombuffer(weights, "<f2").astype(np.float64).reshape(len(u), -1) * u[:, None], np.frombuffer(squares, "<f4") * u
            if current and current[0] == block:
                for held, more in zip(current[1:], (w, s, u), strict=True):
                    held += more
                continue
            if current:
                yield row()
            current[:] = [block, w, s, u]
    if current:
        yield row()


def train_table(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The weights, in half precision, after all rounds; texts has a number that deals it over rounds, and text."""
    spark = texts.sparkSession
    weights, squares = np.zeros((vocabulary.rows, WIDTH), np.float16), np.full(vocabulary.rows, 1e-2, np.float32)
    parts = texts.rdd.getNumPartitions()
    tasks, blocks = min(parts, int(np.ceil(2 * parts**0.5))), -(-vocabulary.rows // _BLOCK_ROWS)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((vars(vocabulary), weights, squares))
        own = texts.filter(F.pmod("number", F.lit(rounds)) == k).select("text").coalesce(tasks)
        made = own.mapInArrow(_train(shared), _BLOCKS_DDL).repartition(min(blocks, 64), "block").sortWithinPartitions("block").mapInArrow(_average, _BLOCKS_DDL)
        # Rows that this round did not update stay as they were.
        weights, squares = weights.copy(), squares.copy()
        for row in made.toLocalIterator():
            own_rows = np.flatnonzero(np.frombuffer(row["updates"], "<f4"))
            at = row["block"] * _BLOCK_ROWS + own_rows
            weights[at] = np.frombuffer(row["weights"], "<f2").reshape(-1, WIDTH)[own_rows]
            squares[at] = np.frombuffer(row["squares"], "<f4")[own_rows]
        shared.destroy()
        del own, made
        release(spark)  # else the disk holds all rounds' shuffles
    return weights


_SCORES = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.int64()))])
_SCORES_DDL = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>"


def token_scores(stream: Stream, table: Table) -> np.ndarray:
    """Natural log probability of each token; for words outside the table, of their leaf."""
    out = np.empty(len(stream.hashes))
    for start in range(0, len(out), BATCH):
        part = slice(start, min(start + BATCH, len(out)))
        token, classes, branches, rows = stream.decisions(part)
        logs = np.empty(len(classes))
        for some, own, total in table.odds(stream.vocabulary.bias, classes, rows):
            logs[some] = own[np.arange(len(own)), branches[some]].astype(np.float64) / total
        out[part] = np.bincount(token, np.log(logs), part.stop - start)
    return out


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights = shared.value
        vocabulary, table = Vocabulary(**held), Table(weights.astype(np.float32))
        base_log = np.append(np.log10(vocabulary.counts + 1.0), 0.0)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                hashes, rows = tokens(part, "text")
                stream = Stream(vocabulary, hashes, rows)
                known = stream.known
                values = token_scores(stream, table) / np.log(10)
                base = base_log[stream.place]
                rest = hashes[~known].view(np.int64)
                at = np.r_[0, np.cumsum(~known)][rows].astype(np.int32)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n)),
                        part.column(0),
                        part.column(2),
                        pa.array(np.diff(rows)),
                        pa.array(np.add.reduceat(known.astype(np.int64), rows[:-1])),
                        pa.array(np.add.reduceat(base, rows[:-1])),
                        pa.array(np.add.reduceat(values, rows[:-1])),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(rest)),
                    ],
                    schema=_SCORES,
                )
                uid += n

    return score


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = keep_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("held_out", fold(F.col("doc_id"), folds) == held_out)
    training = rows.filter(~F.col("held_out")).select("text", F.xxhash64("doc_id").alias("number"))
    counts = scratch.save(training.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    vocabulary, total, words = build_vocabulary(counts)
    scratch.release()
    weights = train_table(training, vocabulary)
    shared = spark.sparkContext.broadcast((vars(vocabulary), weights))
    scored = scratch.save(rows.mapInArrow(_score(shared), _SCORES_DDL), "scored")
    # Words outside the table, by document: each has few occurrences in training, so no key is hot there; what
    # was never seen is counted before it is joined.
    rest = scored.select("uid", F.explode("rest").alias("word")).groupBy("uid", "word").agg(F.count("*").alias("times"))
    rest = rest.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rest_base"),
        F.sum("times").alias("rest_times"),
    )
    base_each, rest_each = float(np.log10(total + words + 1)), float(np.log10(vocabulary.rest_total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rest").join(rest, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("rest_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rest_base") - F.col("n_tokens") * base_each).alias("base_score"),
        (F.col("score") + zero("rest_base") - zero("rest_times") * rest_each).alias("score"),
    )
