"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled texts: words, and stems that many different words share, which
occur in toxic texts far more purely than chance allows. A word is supported by the different toxic
texts that hold it, and by the different neighbours it has there, whichever are fewer: neither one long
text nor many near copies of one make its rare words toxic. Each distinct word of a batch whose length
and letters are near those of some term becomes a Levenshtein automaton (with swapped neighbours as one
edit) that runs through the trie of terms, which finds misspelled ones. Terms whose neighbourhood holds
words of clean texts are only matched exactly, and words that clean texts hold are no misspellings.
Each hit is judged by the words around it: between quotation marks or next to a word of reporting it
counts as quotation, otherwise as abuse. A logistic model over the numbers of exact, misspelled and stem
hits, each as abuse and as quotation, gives the score; as terms are pure by their choice, one of them,
spelled right or wrong, in abuse decides.

Null and empty texts, and texts without a hit, get the same low score. Every row gives one row, repeated
ones too; very long texts are read whole. Terms of equal support are all taken, so ties need no order.
Only the text is looked at, columns of other names are carried by ``drop_toxic`` and not read. Without
usable labels (none, or of one kind) the lexicon is empty and every score is the share of toxic labels;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.labelled import SAMPLE_ROWS, labelled_sample
from webloom.llm.words import filled, split_words, text_slices
from webloom.session import materialize

#: Words on either side of a hit that are looked at.
WINDOW = 6
#: Shortest and longest stem; a stem stands for at least so many different words.
STEM_LENGTHS, STEM_WORDS = (3, 10), 4
#: Share of toxic contexts among those of a term, and chance that any term gets in by luck.
PURITY, LUCK = 0.9, 0.01
#: Log odds that a single exact or misspelled hit in abuse reaches at least: a little above one half.
DECISIVE = 0.1
#: Characters that open and close quotations, and words of reporting.
OPENING, CLOSING = "^[\"'“„«»‘‹`]", "[\"'”“»«’›`][.,;:!?]*$"
REPORTING = tuple("""
said says say wrote writes write called calls quoted quotes quote reported reports claimed claims
dit disait écrit appelé cité sagte sagt schrieb nannte zitierte dijo dice escribió llamó citó
""".split())
#: What the weights are drawn to where labels say nothing: any abuse counts, misspelled or not.
PRIOR_WEIGHTS = (3.0, 3.0, 3.0, 0.5, 0.5, 0.5, 2.0, 0.0)
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
EXACT, MISSPELLED, STEM = 1, 2, 3


def edits_allowed(lengths: np.ndarray) -> np.ndarray:
    """By the length of the term: short ones must match exactly, long ones may have two edits."""
    return np.where(lengths < 4, 0, np.where(lengths < 9, 1, 2))


class Trie:
    """The lexicon's terms, letter by letter, each with the edits it allows."""

    def __init__(self, terms):
        self.root: dict = {}
        terms = list(terms)
        allowed = edits_allowed(np.array([len(t) for t in terms], np.int64)).tolist()
        self.edits = max(allowed, default=0)
        for term, edits in zip(terms, allowed, strict=True):
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node["end"] = (term, edits)

    def near(self, word: str):
        """The terms that are as near as they allow: the word's automaton run through the trie.

        The automaton's states are bits: bit i of level e is set if the term so far can be turned
        into the first i letters with at most e edits.
        """
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        everything, goal = (2 << len(word)) - 1, 1 << len(word)
        nothing = [0] * (self.edits + 1)
        start = [(2 << e) - 1 & everything for e in range(self.edits + 1)]
        stack = [(self.root, start, nothing, 0)]
        while stack:
            node, levels, earlier, last = stack.pop()
            if "end" in node and levels[node["end"][1]] & goal:
                yield node["end"][0]
            for letter, child in node.items():
                if len(letter) > 1:
                    continue
                here = places.get(letter, 0)
                moved = [(levels[0] & here) << 1]
                for e in range(1, self.edits + 1):
                    # matched, replaced, left out of the word, added to it, or swapped with the letter before
                    swapped = (earlier[e - 1] & here & last >> 1) << 2
                    moved.append(((levels[e] & here) << 1 | levels[e - 1] << 1 | levels[e - 1] | moved[e - 1] << 1 | swapped) & everything)
                if moved[-1]:
                    stack.append((child, moved, levels, here))


def bare_words(words: pa.Array) -> pa.Array:
    """Words in small letters, without the marks around them."""
    return pc.utf8_lower(pc.replace_substring_regex(words, EDGES, ""))


def letter_sets(words: list[str]) -> np.ndarray:
    """The letters of each word as bits, folded into 64."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sets = np.zeros(len(words), np.uint64)
    some = lengths > 0
    if len(points):
        begins = (np.cumsum(lengths) - lengths)[some]
        sets[some] = np.bitwise_or.reduceat(np.uint64(1) << (points & np.uint64(63)), begins)
    return sets


@lru_cache(maxsize=4)
def trie_of(terms: tuple[str, ...]) -> Trie:
    return Trie(terms)


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[str, ...]
    stems: tuple[str, ...]
    #: Terms that are matched exactly only, and words that are no misspellings.
    strict: tuple[str, ...] = ()
    innocent: tuple[str, ...] = ()

    @property
    def tolerant(self) -> tuple[str, ...]:
        strict = set(self.strict)
        return tuple(t for t in self.terms if t not in strict)

    def misspelled(self, bare: pa.Array):
        """``(index, terms)`` of the words that are near some tolerant term, or equal to one."""
        words = bare.to_numpy(zero_copy_only=False).tolist()
        lengths = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
        # An edit changes the length by one at most, and the set of letters by two.
        terms, sets, near = self.tolerant, letter_sets(words), np.zeros(len(bare), bool)
        allowed = edits_allowed(np.array([len(t) for t in terms], np.int64)).tolist()
        for term, own, edits in zip(terms, letter_sets(list(terms)), allowed, strict=True):
            near |= (np.abs(lengths - len(term)) <= edits) & (np.bitwise_count(sets ^ own) <= 2 * edits)
        trie = trie_of(terms)
        for i in np.flatnonzero(near):
            found = list(trie.near(words[i]))
            if found:
                yield int(i), found

    def kinds(self, bare: pa.Array) -> np.ndarray:
        """How each bare word matches: exact before stem before misspelled, else 0."""
        kind = np.zeros(len(bare), np.int64)
        kind[[i for i, _ in self.misspelled(bare)]] = MISSPELLED
        kind[pc.is_in(bare, pa.array(self.innocent, pa.string())).to_numpy(zero_copy_only=False)] = 0
        lengths = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
        for stem in self.stems:
            kind[pc.starts_with(bare, stem).to_numpy(zero_copy_only=False) & (lengths > len(stem))] = STEM
        kind[pc.is_in(bare, pa.array(self.terms, pa.string())).to_numpy(zero_copy_only=False)] = EXACT
        return kind

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text, the hits of each kind as abuse, then as quotation, and whether there is abuse."""
        words = split_words(texts, None)
        n = len(texts)
        counts = np.zeros((n, 2, 3))
        bare = bare_words(words.dictionary).dictionary_encode()
        code = bare.indices.to_numpy(zero_copy_only=False)
        kind = self.kinds(bare.dictionary)[code] if len(code) else np.zeros(0, np.int64)
        if kind.any():
            opens, closes = (pc.match_substring_regex(words.dictionary, p).to_numpy(zero_copy_only=False) for p in (OPENING, CLOSING))
            reports = pc.is_in(bare.dictionary, pa.array(REPORTING)).to_numpy(zero_copy_only=False)[code]
            hits = np.flatnonzero(kind[words.codes] > 0)
            owner = np.searchsorted(words.offsets, hits, side="right") - 1
            low = np.maximum(hits - WINDOW, words.offsets[owner])
            high = np.minimum(hits + WINDOW + 1, words.offsets[owner + 1])

            def within(flags, begin, end):
                total = np.r_[0, np.cumsum(flags[words.codes])]
                return total[end] > total[begin]

            quoted = within(opens, low, hits + 1) & within(closes, hits, high) | within(reports, low, hits)
            np.add.at(counts, (owner, quoted.astype(int), kind[words.codes[hits]] - 1), 1)
        flat = np.log1p(counts.reshape(n, 6))
        return np.c_[flat, counts[:, 0].sum(axis=1) > 0, counts[:, 1].sum(axis=1) > 0]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.lexicon.features(texts) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-z))


def _words_of(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct bare words of a batch, and for every place in its texts the word's number and the text's."""
    words = split_words(filled(batch.column("text")), None)
    bare = bare_words(words.dictionary).to_numpy(zero_copy_only=False).tolist()
    known = {w: i for i, w in enumerate(dict.fromkeys(bare))}
    codes = np.array([known[w] for w in bare], np.int64)[words.codes] if bare else np.zeros(0, np.int64)
    return np.array([*known, ""], object), codes, np.repeat(np.arange(batch.num_rows), np.diff(words.offsets))


def _text_words(batches):
    """``(word, label, text)``: the distinct words of each text, by its hash."""
    for batch in text_slices(batches):
        names, codes, owner = _words_of(batch)
        found = np.unique(np.stack([codes, owner], axis=1), axis=0)
        hashes = batch.column("text_hash").to_numpy(zero_copy_only=False)
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[found[:, 0]], pa.string()), pa.array(labels[found[:, 1]], pa.int32()), pa.array(hashes[found[:, 1]])],
            ["word", "label", "text"])


def _contexts(batches):
    """``(word, context)``: the words with the hash of their neighbours on both sides."""
    for batch in text_slices(batches):
        names, codes, owner = _words_of(batch)
        if not len(codes):
            continue
        hashes = np.array([zlib.crc32(w.encode()) for w in names[:-1]] + [0], np.int64)
        edge = len(names) - 1  # beyond the first and the last word of a text
        first = np.r_[True, owner[1:] != owner[:-1]]
        before, after = np.r_[edge, codes[:-1]], np.r_[codes[1:], edge]
        before[first], after[np.r_[first[1:], True]] = edge, edge
        found = np.unique(np.stack([codes, hashes[before] << 31 ^ hashes[after]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(names[found[:, 0]], pa.string()), pa.array(found[:, 1])], ["word", "context"])


def _text_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))


def _collapsed(stems: dict[str, int]) -> set[str]:
    """Of nested stems the shortest says it all, drawn out as long as hardly any word is lost."""
    kept = set()
    for stem in (s for s in stems if not any(s[:i] in stems for i in range(1, len(s)))):
        longer = [s for s in stems if s.startswith(stem) and stems[s] >= 0.95 * stems[stem]]
        kept.add(max(longer, key=lambda s: (len(s), s)))
    return kept


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms and stems from a bounded table ``(text, label)``; what reaches the driver is bounded by it."""
    hashed = sample.withColumn("text_hash", F.xxhash64("text"))
    totals = dict(hashed.groupBy("label").agg(F.count_distinct("text_hash")).collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon((), ())
    texts = materialize(hashed.mapInArrow(_text_words, "word string, label int, text long").where("word <> ''").distinct(), "toxic-texts")
    contexts = (sample.where("label = 1").select("text").mapInArrow(_contexts, "word string, context long").where("word <> ''").distinct()
                .groupBy("word").agg(F.count("*").alias("contexts")))
    words = materialize(_text_counts(texts, "word").join(contexts, "word", "left").select(
        "word", F.least("toxic", F.coalesce("contexts", F.lit(0))).alias("toxic"), "clean"), "toxic-words")
    # A term of n toxic texts and no clean one has the chance share^n; there are as many tries as words.
    share = toxic / (toxic + clean)
    least = max(3, int(np.ceil(np.log(LUCK / max(1, words.count())) / np.log(share))))
    pure = (F.col("toxic") >= least) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean")))
    terms = [r[0] for r in words.where(pure).select("word").collect()]
    lengths = F.sequence(F.lit(STEM_LENGTHS[0]), F.least(F.lit(STEM_LENGTHS[1]), F.length("word") - 1))
    stems = (words.where(F.length("word") > STEM_LENGTHS[0]).select("word", "toxic", "clean", F.explode(lengths).alias("size"))
             .groupBy(F.substring("word", F.lit(1), F.col("size")).alias("stem"))
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("words"),
                  F.max("toxic").alias("most")))
    many = (F.col("words") >= STEM_WORDS) & (F.col("most") < 0.5 * F.col("toxic"))
    found = sorted(_collapsed(dict(stems.where(pure & many).select("stem", "toxic").collect())))
    if found:
        # Texts that hold several words of a stem count once.
        starts = F.explode(F.filter(F.array(*map(F.lit, found)), lambda stem: F.col("word").startswith(stem)))
        counted = _text_counts(texts.select(starts.alias("stem"), "label", "text").distinct(), "stem")
        found = [r[0] for r in counted.where(pure).select("stem").collect()]
    covered = tuple(sorted(found))
    lexicon = Lexicon(tuple(sorted(t for t in terms if not t.startswith(covered))), covered)
    return _with_neighbours(lexicon, words)


def _with_neighbours(lexicon: Lexicon, words: DataFrame) -> Lexicon:
    """Which terms have words of clean texts near them, and which words these are."""
    own = set(lexicon.terms)

    def near(batches):
        for batch in batches:
            bare = batch.column("word")
            rows = [(term, i) for i, terms in lexicon.misspelled(bare) if bare[i].as_py() not in own for term in terms]
            names, at = zip(*rows, strict=True) if rows else ((), ())
            picked = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(batch.column(c).take(picked) for c in ("word", "toxic", "clean"))], ["term", "word", "toxic", "clean"])

    if not own:
        return lexicon
    found = materialize(words.mapInArrow(near, "term string, word string, toxic long, clean long"), "toxic-neighbours")
    sums = found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strict = sums.where((F.col("clean") > 0) & (F.col("toxic") < PURITY * (F.col("toxic") + F.col("clean"))))
    return Lexicon(lexicon.terms, lexicon.stems, tuple(sorted(r.term for r in strict.collect())),
                   tuple(sorted(r.word for r in found.where("clean > 0").select("word").distinct().collect())))


def decisive(weights: np.ndarray, bias: float) -> np.ndarray:
    """Weights raised so that one exact or misspelled hit in abuse is enough, and an exact one is no less."""
    raised = weights.copy()
    least = (DECISIVE - bias - raised[6]) / np.log(2)
    raised[1] = max(raised[1], least)
    raised[0] = max(raised[0], raised[1])
    return raised


def fit_logistic(features: np.ndarray, labels: np.ndarray, prior, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression drawn to prior weights, by Newton steps."""
    x = np.c_[features, np.ones(len(features))]
    centre = np.r_[prior, -3.0]
    w = centre.copy()
    penalty = np.full(len(w), ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty * (w - centre)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, where=None, rows: int = SAMPLE_ROWS, label: str = "toxic",
        text: str = "text", key: str = "doc_id") -> Model:
    """Learn from at most ``rows`` labelled documents; ``where`` is a condition on their ``_id``."""
    sample = materialize(labelled_sample(docs, labels, label, where, rows, text, key), "toxic-sample")
    lexicon = learn_lexicon(sample)

    def featured(batches):
        for batch in text_slices(batches):
            features = lexicon.features(filled(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), features.shape[1]).cast(pa.list_(pa.float64())),
                 batch.column("label")], ["features", "label"])

    table = sample.mapInArrow(featured, "features array<double>, label int").toPandas()  # eight numbers for each sampled row
    if table.label.nunique() < 2:
        share = float(np.clip(table.label.mean(), 1e-6, 1 - 1e-6)) if len(table) else 1e-6
        return Model(lexicon, (0.0,) * 8, float(np.log(share / (1 - share))))
    weights, bias = fit_logistic(np.stack(table.features.to_numpy()), table.label.to_numpy(np.float64), PRIOR_WEIGHTS)
    return Model(lexicon, tuple(decisive(weights, bias).tolist()), bias)


def score_column(model: Model, text: str = "text"):
    """The score of a text column."""

    @F.arrow_udf("double")
    def score_of(texts: pa.Array) -> pa.Array:
        parts = [model.score(filled(b.column("text"))) for b in text_slices([pa.RecordBatch.from_arrays([texts], ["text"])])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score_of(F.col(text))


def score_texts(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, score, predicted)`` for each row."""
    scored = docs.select(F.col(key).alias("doc_id"), score_column(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that score below the limit, with all their columns."""
    mark = "_toxicity_of_text"
    return docs.withColumn(mark, score_column(model, text)).where(F.col(mark) < limit).drop(mark)
