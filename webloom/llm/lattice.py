"""Language-model scores from a subword lattice under word counts.

A text is its words and one end. A word's probability mixes its discounted count in the training texts
with the probability of spelling it: the sum over all its segmentations into the pieces of an existing
vocabulary, found by a forward recursion in log space. The vocabulary's scores give the first weights
of the pieces (a score of -r is a merge rank, and weighs 1 / (1 + r)); expectation steps over all
distinct training words then fit the weights, with the first ones as prior. The spelling model is a
distribution over all words, so the mixture is one over all texts.

Counts never pass through the driver, nor are they broadcast: texts are read in blocks of bounded size,
each block asks for its distinct words only, and gets their probabilities back by a shuffle on the
block. The driver sees totals and one weight for each piece.

Null texts count as empty: just the end. Rows without an id train. Repeated rows count and are scored
each for itself. Without any training rows, words have the probability of their spelling.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import filled, split_words, text_slices
from webloom.session import materialize

BLOCK_BYTES = 16 << 20
#: Words whose lattice is built at once.
LATTICE_WORDS = 20_000
#: Fixed values of the vocabulary file.
SPACE, NORMAL, BYTE = "▁", 1, 6
#: Weight of the first piece weights in each expectation step, in words.
PRIOR_WORDS = 1000.0
#: First probability that a word ends after a piece, and that a new token is the end of a text.
STOP, END = 0.4, 1e-3
HASH = np.uint64(0x9E3779B97F4A7C15)


def _hash(points: list[int]) -> int:
    value = 0
    for point in points:
        value = (value * int(HASH) + point + 1) & (2**64 - 1)
    return value


class Pieces:
    """The usable pieces of a vocabulary: those that start a word (led by the mark) and those inside."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        usable = [p for p in model.pieces if p.type == NORMAL and SPACE not in p.piece[1:]]
        self.byte_of = {int(p.piece[1:-1], 16): len(usable) + i for i, p in enumerate(p for p in model.pieces if p.type == BYTE)}
        self.size = len(usable) + len(self.byte_of)
        self.first = np.array([p.piece[0] == SPACE for p in usable] + [False] * len(self.byte_of))
        lowest = min((p.score for p in usable), default=0.0)
        scores = np.array([p.score for p in usable] + [lowest] * len(self.byte_of))
        self.start = self.normal(1 / (1 - scores))
        # Prefixes of pieces by hash; the value is the piece, or -1 for a mere prefix.
        table: dict[int, int] = {}
        for number, piece in enumerate(usable):
            points = list(map(ord, piece.piece))
            for length in range(1, len(points)):
                table.setdefault(_hash(points[:length]), -1)
            table[_hash(points)] = number
        self.keys = np.array(sorted(table), np.uint64)
        self.values = np.array([table[int(k)] for k in self.keys], np.int64)

    def normal(self, weights: np.ndarray) -> np.ndarray:
        """Probabilities, of first pieces and of inner ones each."""
        weights = weights.astype(np.float64).copy()
        for part in (self.first, ~self.first):
            weights[part] /= weights[part].sum()
        return weights


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Pieces(path)
    return _loaded[path]


@dataclass
class Weights:
    """Probabilities of the pieces and of ending a word after one."""

    pieces: np.ndarray
    stop: float

    def logs(self) -> tuple[np.ndarray, float, float]:
        return np.log(self.pieces), math.log(self.stop), math.log1p(-self.stop)


class Lattice:
    """All segmentations of many words; nodes are the places between characters, in a flat array."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.pieces, self.n = pieces, len(words)
        marked = [SPACE + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, self.n)
        points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(self.n), lengths)
        at = np.arange(len(points))
        sources, targets, numbers = [], [], []
        active, value, length = at, np.zeros(len(points), np.uint64), 0
        while len(active):
            value = value * HASH + points[active + length] + np.uint64(1)
            length += 1
            place = np.minimum(np.searchsorted(pieces.keys, value), len(pieces.keys) - 1)
            known = pieces.keys[place] == value
            number = np.where(known, pieces.values[place], -1)
            hit = number >= 0
            sources.append(active[hit])
            targets.append(active[hit] + length)
            numbers.append(number[hit])
            if length == 1:
                # The mark itself, inside a word, is a character like any without a piece.
                inner_mark = (points == np.uint64(ord(SPACE))) & (at != (ends - lengths)[word])
                unknown = active[(number < 0) | inner_mark]
            more = known & (active + length < ends[word[active]])
            active, value = active[more], value[more]
        source, target, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sources, targets, numbers))
        # A character without a piece is spelled by its bytes; -2 - i stands for the i-th of these arcs' texts.
        self.spelled = [list(chr(int(p)).encode()) for p in points[unknown]] if self.n else []
        if len(unknown):
            source, target = np.r_[source, unknown], np.r_[target, unknown + 1]
            number = np.r_[number, -2 - np.arange(len(unknown))]
        begins = ends - lengths
        shift = np.arange(self.n)  # each word has one node more than characters
        depth = target - begins[word[source]] if len(source) else target
        leads = source == begins[word[source]] if len(source) else np.zeros(0, bool)
        # A word starts with a first piece and goes on with inner ones.
        fits = np.where(number >= 0, pieces.first[np.maximum(number, 0)] == leads, True)
        source, target = source + shift[word[source]], target + shift[word[source]]
        order = np.lexsort((target[fits], depth[fits]))
        self.source, self.target, self.number = (x[fits][order] for x in (source, target, number))
        self.leads, self.depth = leads[fits][order], depth[fits][order]
        self.first_node, self.last_node = begins + shift, ends + shift
        self.nodes = len(points) + self.n

    def arc_logs(self, weights: Weights) -> np.ndarray:
        logs, _, go_on = weights.logs()
        arcs = logs[np.maximum(self.number, 0)]
        for i in np.flatnonzero(self.number < 0):
            spelled = self.spelled[-2 - self.number[i]]
            arcs[i] = sum(logs[self.pieces.byte_of[b]] for b in spelled) + (len(spelled) - 1) * go_on
        return arcs + np.where(self.leads, 0.0, go_on)

    @staticmethod
    def _pool(total: np.ndarray, into: np.ndarray, values: np.ndarray) -> None:
        """Log of the sum of exponentials of the values that share a node; equal nodes are adjacent."""
        begins = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
        top = np.maximum.reduceat(values, begins)
        base = np.where(np.isfinite(top), top, 0.0)
        spread = np.repeat(base, np.diff(np.r_[begins, len(into)]))
        with np.errstate(divide="ignore"):
            total[into[begins]] = base + np.log(np.add.reduceat(np.exp(values - spread), begins))

    def forward(self, arcs: np.ndarray) -> np.ndarray:
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.first_node] = 0.0
        steps = np.flatnonzero(np.r_[True, self.depth[1:] != self.depth[:-1]]) if len(self.depth) else []
        for begin, end in zip(steps, np.r_[steps[1:], len(self.depth)].astype(int), strict=True):
            at = slice(begin, end)
            self._pool(alpha, self.target[at], alpha[self.source[at]] + arcs[at])
        return alpha

    def log_probabilities(self, weights: Weights) -> np.ndarray:
        """Natural logarithm of each word's marginal probability."""
        return self.forward(self.arc_logs(weights))[self.last_node] + weights.logs()[1]

    def expected(self, weights: Weights) -> np.ndarray:
        """How often each piece is expected to be used in these words."""
        arcs = self.arc_logs(weights)
        alpha = self.forward(arcs)
        beta = np.full(self.nodes, -np.inf)
        beta[self.last_node] = 0.0
        order = np.argsort(-self._source_depth(), kind="stable")
        source, target, logs, depth = self.source[order], self.target[order], arcs[order], self._source_depth()[order]
        steps = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]) if len(depth) else []
        for begin, end in zip(steps, np.r_[steps[1:], len(depth)].astype(int), strict=True):
            inside = np.argsort(source[begin:end], kind="stable") + begin
            self._pool(beta, source[inside], beta[target[inside]] + logs[inside])
        word = np.searchsorted(self.last_node, self.source)
        total = alpha[self.last_node]
        with np.errstate(invalid="ignore"):
            used = np.exp(alpha[self.source] + arcs + beta[self.target] - total[word])
        used = np.where(np.isfinite(total[word]), used, 0.0)
        plain = self.number >= 0
        counts = np.bincount(self.number[plain], used[plain], minlength=self.pieces.size)
        for i in np.flatnonzero(~plain):
            for b in self.spelled[-2 - self.number[i]]:
                counts[self.pieces.byte_of[b]] += used[i]
        return counts

    def _source_depth(self) -> np.ndarray:
        word = np.searchsorted(self.last_node, self.source)
        return self.source - self.first_node[word]


def _word_lattices(words: list[str], pieces: Pieces):
    for begin in range(0, len(words), LATTICE_WORDS):
        part = words[begin:begin + LATTICE_WORDS]
        yield Lattice(part, pieces)


def blocks(docs: DataFrame, held_out, text: str = "text", key: str = "doc_id", limit: int = BLOCK_BYTES) -> DataFrame:
    """Texts as word codes, in blocks that each have their own list of words.

    Rows with a ``word`` are entries of a block's list, the others documents of the block.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["block", "number", "word", "n_train", "doc_id", "held_out", "n_words", "numbers", "times"]

    def run(batches):
        partition, count = TaskContext.get().partitionId() << 33, 0
        held, size = [], 0
        id_type = None

        def build():
            table = pa.Table.from_batches(held).combine_chunks()
            texts = pc.ascii_lower(table.column("text").chunk(0))
            words = split_words(texts, None)
            out = table.column("held_out").to_numpy()
            n, lengths = len(words.distinct), np.diff(words.offsets)
            train = np.bincount(words.codes[np.repeat(~out, lengths)], minlength=n)
            block = partition + count
            nothing = lambda k, rows: pa.nulls(rows, k)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(words.distinct, pa.string()),
                pa.array(train, pa.int64()), nothing(id_type, n), nothing(pa.bool_(), n), nothing(pa.int64(), n),
                nothing(pa.list_(pa.int32()), n), nothing(pa.list_(pa.int32()), n)], names)
            rows = table.num_rows
            both = np.repeat(np.arange(rows), lengths) * max(n, 1) + words.codes
            pairs, times = np.unique(both, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(rows + 1) * max(n, 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % max(n, 1), times)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows, block), pa.int64()), nothing(pa.int32(), rows), nothing(pa.string(), rows), nothing(pa.int64(), rows),
                table.column("doc_id").chunk(0), table.column("held_out").chunk(0), pa.array(lengths, pa.int64()), *lists], names)

        for batch in text_slices(batches):
            id_type = batch.column("doc_id").type
            texts = filled(batch.column("text"))
            held.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), texts], ["doc_id", "held_out", "text"]))
            size += texts.nbytes
            if size >= limit:
                yield from build()
                held, size, count = [], 0, count + 1
        if held:
            yield from build()

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, (
        f"block long, number int, word string, n_train long, doc_id {kind}, held_out boolean, n_words long, "
        "numbers array<int>, times array<int>"))


def fit_weights(words: DataFrame, path: str, rounds: int) -> Weights:
    """Expectation steps over all distinct words; each sends one number for each piece to the driver."""
    pieces = pieces_of(path)
    weights = Weights(pieces.start, STOP)
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def expect(batches, shared=shared):
            own, total, seen = pieces_of(path), None, 0
            for batch in batches:
                for lattice in _word_lattices(batch.column("word").to_pylist(), own):
                    counts = lattice.expected(shared.value)
                    total = counts if total is None else total + counts
                    seen += lattice.n
            if total is not None:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[used, -1], pa.int64()), pa.array(np.r_[total[used], seen])], ["piece", "expected"])

        found = words.select("word").mapInArrow(expect, "piece long, expected double")
        rows = found.groupBy("piece").agg(F.sum("expected").alias("expected")).collect()  # one row for each piece
        shared.unpersist()
        counts = np.zeros(pieces.size)
        seen = 0.0
        for piece, expected in rows:
            if piece < 0:
                seen = expected
            else:
                counts[piece] = expected
        weights = Weights(pieces.normal(counts + PRIOR_WORDS * pieces.start), (seen + PRIOR_WORDS * STOP) / (counts.sum() + PRIOR_WORDS))
    return weights


def score_texts(docs: DataFrame, held_out, path: str, rounds: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    ``held_out`` is a condition on ``docs``; the other rows train. Scores are base-10 logarithms:
    ``base_score`` of add-one word counts, ``score`` of the lattice mixture.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    parts = materialize(blocks(docs, held_out, text, key), "lm-blocks")
    words = parts.where(F.col("word").isNotNull()).select("block", "number", "word", "n_train")
    texts = parts.where(F.col("n_words").isNotNull()).select("block", "doc_id", "held_out", "n_words", "numbers", "times")
    counts = materialize(words.groupBy("word").agg(F.sum("n_train").alias("c")), "lm-counts")
    n_words, v_words, once, twice = counts.where("c > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n_texts = texts.where(~F.col("held_out")).count()
    tokens, distinct = n_words + n_texts, v_words + (n_texts > 0)
    discount = once / (once + 2 * twice) if once else 0.5
    weights = spark.sparkContext.broadcast(fit_weights(counts.where("c > 0"), path, rounds))

    def mixed(c, spelling):
        """Base-10 logarithm of the mixture of discounted counts and spelling."""
        if not tokens:
            return np.log10(spelling)
        return np.log10((np.maximum(c - discount, 0.0) + discount * distinct * spelling) / tokens)

    def add_one(c):
        return np.log10((c + 1) / (tokens + distinct + 1))

    def weigh(batches):
        pieces = pieces_of(path)
        for batch in batches:
            logs = [lattice.log_probabilities(weights.value) for lattice in _word_lattices(batch.column("word").to_pylist(), pieces)]
            logs = np.concatenate(logs) if logs else np.zeros(0)
            c = batch.column("c").to_numpy(zero_copy_only=False)
            spelling = np.exp(logs) * (1 - END)
            with np.errstate(divide="ignore"):
                log = mixed(c, spelling)
            # A spelling too improbable for a double still has its logarithm.
            small = (c == 0) & (logs < -600)
            scale = math.log10(discount * distinct / tokens) if tokens else 0.0
            log = np.where(small, (logs + math.log1p(-END)) / math.log(10) + scale, log)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(log)], ["word", "c", "log"])

    weighed = counts.mapInArrow(weigh, "word string, c long, log double")
    answers = words.join(weighed, "word").select(F.col("block").alias("owner"), "number", "c", "log")
    end_score, end_base = float(mixed(np.float64(n_texts), END)), float(add_one(n_texts))

    def score(asked: pa.Table, documents: pa.Table) -> pa.Table:
        n = asked.num_rows
        at = asked.column("number").to_numpy()
        c, log = np.zeros(n, np.int64), np.zeros(n)
        c[at], log[at] = asked.column("c").to_numpy(), asked.column("log").to_numpy()
        rows = documents.num_rows
        numbers = documents.column("numbers").combine_chunks()
        lengths = pc.list_value_length(numbers).to_numpy(zero_copy_only=False)
        flat = numbers.flatten().to_numpy(zero_copy_only=False)
        times = documents.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(rows), lengths)

        def total(values):
            return np.bincount(owner, values[flat] * times, minlength=rows)

        known = total((c > 0).astype(np.int64)).astype(np.int64) + int(n_texts > 0)
        n_tokens = pc.add(documents.column("n_words"), 1)
        return pa.table([
            documents.column("doc_id"), documents.column("held_out"), n_tokens, pa.array(known),
            pa.array(np.full(rows, tokens), pa.int64()), pa.array(total(add_one(c)) + end_base), pa.array(total(log) + end_score),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answers.groupBy("owner").cogroup(texts.groupBy("block")).applyInArrow(score, (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
