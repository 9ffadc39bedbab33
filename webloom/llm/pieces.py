"""SentencePiece encoding and decoding for merge-type (BPE) models, exact by backtracking.

A text is cut where no merge can reach across; each distinct segment is encoded once. An Aho-Corasick
automaton finds the longest piece at every position. A piece is taken if the pair it forms with the
piece before it is compatible: merging the two texts again never joins symbols across the seam. For
that only the symbols at the seam are merged again, in the order of their scores.
Otherwise the next shorter piece is tried, and when none is left the position is marked in a bitfield
and the piece before is taken back; a marked position is never entered again. Characters without a
piece stand alone and become byte pieces at the end.

Pairs are only decisive where merges are strictly ordered. Pieces that share their score (runs of
spaces in some models) are ordered by place instead; segments that contain such a piece are merged
directly.

Null texts count as empty: no ids, decoded to the empty text. Every row gives one row. A piece that
its own merges cannot form is never used. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import Recent, filled, split_words, text_slices

#: The mark that stands for a space, and the kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Marks after a word, which are cut off where no piece joins them to it.
MARKS = ".,;:!?"


class PieceModel:
    """A merge-type model with byte pieces, identity normalisation and a leading space."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path} is no merge-type model with byte pieces")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError(f"{path} changes texts in a way that is not supported")
        if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} has pieces of a kind that is not supported")
        self.kinds = [p.type for p in model.pieces]
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_values = {i: b for b, i in self.bytes.items()}
        longer = [p for p in self.ids if len(p) > 1]
        shared = Counter(self.scores[p] for p in longer)
        self.tied = [p for p in longer if shared[self.scores[p]] > 1]
        # Spaces only lead a piece, and line ends are in none: both are safe places to cut.
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in longer)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in longer))
        self.segment = regex.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.alone = alone
        # A segment holds a tied piece if it holds one of the smallest.
        self.ties = [p for p in self.tied if not any(q in p for q in self.tied if q != p)]
        self.ranks = {p: -s for p, s in self.scores.items() if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        #: The symbols that a piece shows at its end and at its start while it is merged, last one first,
        #: each with the rank of the merge that ends it.
        self.ends: dict[str, list[tuple[str, float]]] = {}
        self.starts: dict[str, list[tuple[str, float]]] = {}
        for piece in self.ids:
            history: list[tuple[int, int, str]] = []
            if self.merge(piece, history) == [piece]:
                self.automaton.add_word(piece, len(piece))
                self.ends[piece] = self.seam([(j, s) for _, j, s in history if j == len(piece)], piece[-1])
                self.starts[piece] = self.seam([(i, s) for i, _, s in history if i == 0], piece[0])
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.joins = {p[i:i + 2] for p in longer for i in range(len(p) - 1)}
        self.cut_at = regex.compile(f"[{alone}]").search if alone else lambda part: None
        self.parts = Recent(self.encode_parts, 300_000)
        self.encoded = Recent(self.encode_segments, 100_000)

    def seam(self, merges: list[tuple[int, str]], letter: str) -> list[tuple[str, float]]:
        """Symbols at one end of a piece, the single character first, each with the rank of its end."""
        symbols = [letter, *[s for _, s in merges]]
        return [(s, self.ranks[after]) for s, after in zip(symbols, symbols[1:], strict=False)] + [(symbols[-1], math.inf)]

    def merge(self, text: str, history: list | None = None) -> list[str]:
        """Merge from single characters: highest score first, leftmost among equals.

        ``history`` gets the merges in order, as ``(begin, end, symbol)``.
        """
        symbols: list[str | None] = list(text)
        before = list(range(-1, len(text) - 1))
        after = list(range(1, len(text) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols):
                joined = symbols[a] + symbols[b]
                score = self.scores.get(joined)
                if score is not None:
                    heapq.heappush(queue, (-score, a, b, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if symbols[a] is None or symbols[b] is None or symbols[a] + symbols[b] != joined or after[a] != b:
                continue
            symbols[a], symbols[b] = joined, None
            if history is not None:
                history.append((a, a + len(joined), joined))
            after[a] = after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None]

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[pair] = self.stays_apart(
                self.ends.get(left) or [(left, math.inf)], self.starts.get(right) or [(right, math.inf)])
        return known

    def stays_apart(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        """Merge two seams again: do their symbols never join before one of them is merged away?"""
        i = j = 0
        ranks = self.ranks
        while True:
            (a, until_a), (b, until_b) = left[i], right[j]
            rank = ranks.get(a + b)
            # Among equals the leftmost merge comes first.
            if rank is not None and rank < until_a and rank <= until_b:
                return False
            if until_a <= until_b:
                if until_a == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def split(self, text: str) -> list[str]:
        """The pieces of a segment, by backtracking."""
        for tied in self.ties:
            if tied in text:
                return self.merge(text)
        size = len(text)
        choices: list[list[int] | None] = [None] * (size + 1)  # piece lengths by start, shortest first
        for end, length in self.automaton.iter(text):
            start = end - length + 1
            if choices[start] is None:
                choices[start] = [length] if length == 1 else [1, length]
            else:
                choices[start].append(length)
        known, check = self.pairs.get, self.compatible
        failed = 0  # a bit for each position from which the text cannot be finished
        taken: list[str] = []
        tried: list[int] = []  # of each taken piece, its place among the choices at its start
        at, last, lengths = 0, None, choices[0] or [1]
        choice = len(lengths) - 1
        while at < size:
            while choice >= 0:
                end = at + lengths[choice]
                if not failed >> end & 1:
                    piece = text[at:end]
                    if last is None:
                        break
                    fits = known((last, piece))
                    if check(last, piece) if fits is None else fits:
                        break
                choice -= 1
            if choice >= 0:
                taken.append(piece)
                tried.append(choice)
                at, last = end, piece
                lengths = choices[at] or [1]
                choice = len(lengths) - 1
            else:
                failed |= 1 << at
                if not taken:
                    return self.merge(text)
                at -= len(taken.pop())
                last = taken[-1] if taken else None
                lengths = choices[at] or [1]
                choice = tried.pop() - 1
        return taken

    def piece_ids(self, pieces: list[str]) -> list[int]:
        ids = []
        for piece in pieces:
            known = self.ids.get(piece)
            ids += [known] if known is not None else [self.bytes[b] for b in piece.encode()]
        return ids

    def segments(self, text: str) -> list[str]:
        """Cut a non-empty text, spaces already marked and led by one."""
        return self.segment.findall(text) if self.cuts_at_spaces else [text]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for s in self.segments(SPACE + text.replace(" ", SPACE)) for i in self.piece_ids(self.split(s))]

    def decode(self, ids: list[int]) -> str:
        """Join the pieces; bytes that are no UTF-8 become replacement characters, control ids nothing."""
        if ids and not any(self.kinds[i] != NORMAL for i in ids):
            return "".join([self.texts[i] for i in ids]).removeprefix(SPACE).replace(SPACE, " ")
        parts, held = [], bytearray()

        def settle() -> None:
            at = 0
            while at < len(held):  # like the library: one mark for each byte that starts no character
                for size in (1, 2, 3, 4):
                    try:
                        parts.append(bytes(held[at:at + size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    size = 1
                at += size
            held.clear()

        first = True
        for i in ids:
            if self.kinds[i] == BYTE:
                held.append(self.byte_values[i])
                first = False
                continue
            settle()
            if self.kinds[i] == CONTROL:
                continue
            piece = " ⁇ " if self.kinds[i] == UNKNOWN else self.texts[i]
            parts.append(piece[1:] if first and piece.startswith(SPACE) else piece)
            first = False
        settle()
        return "".join(parts).replace(SPACE, " ")

    def encode_parts(self, parts: list[str]) -> list[tuple[int, str, str]]:
        """Of each part: number of ids, the ids joined by commas, the decoded text."""
        results, known, texts = [], self.ids.get, self.texts
        for part in parts:
            split = [p for s in self.segments(part) for p in self.split(s)] if self.cut_at(part) else self.split(part)
            ids = [known(p) for p in split]
            if None in ids:
                ids = self.piece_ids(split)
                decoded = self.decode([self.ids[SPACE], *ids])  # led by another piece, so that a leading space stays
            else:
                decoded = "".join([texts[i] for i in ids]).replace(SPACE, " ")
            results.append((len(ids), ",".join(map(str, ids)), decoded))
        return results

    def encode_segments(self, segments: list[str]) -> list[tuple[int, str, str]]:
        """The same for segments, most of which are a known word and a mark."""
        heads = [s.rstrip(MARKS) for s in segments]
        heads = [h if h and h[-1] + s[len(h):len(h) + 1] not in self.joins else s for h, s in zip(heads, segments, strict=True)]
        tails = [s[len(h):] for h, s in zip(heads, segments, strict=True)]
        distinct = list(dict.fromkeys([*heads, *filter(None, tails)]))
        known = dict(zip(distinct, self.parts(distinct), strict=True))
        results = []
        for head, tail in zip(heads, tails, strict=True):
            found = known[head]
            if tail:
                more = known[tail]
                found = found[0] + more[0], found[1] + "," + more[1], found[2] + more[2]
            results.append(found)
        return results

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """Number of ids, and digests of the ids and of the decoded text."""
        odd = pc.match_substring_regex(texts, f"^ | $|  |{SPACE}").to_numpy(zero_copy_only=False)
        if not self.cuts_at_spaces:
            odd[:] = True
        words = split_words(texts)
        values = self.encoded([SPACE + w for w in words.distinct])
        numbers, ids, decoded = zip(*values, strict=True) if values else ((), (), ())
        results, ends = [], words.offsets.tolist()
        codes = words.codes.tolist()
        for row, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            text = texts[row].as_py() if odd[row] or b - a == 1 else None
            if text == "":
                n, joined, back = 0, "", ""
            elif odd[row]:
                parts = self.encoded(self.segments(SPACE + text.replace(" ", SPACE)))
                n, joined, back = sum(p[0] for p in parts), ",".join(p[1] for p in parts), "".join(p[2] for p in parts)
            else:
                own = codes[a:b]
                n = sum([numbers[c] for c in own])
                joined, back = ",".join([ids[c] for c in own]), "".join([decoded[c] for c in own])
            digests = (hashlib.sha256(s.encode()).hexdigest() for s in (joined, back.removeprefix(" ")))
            results.append((n, *digests))
        return results


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)`` for each row; ``path`` is read where the tasks run."""

    def run(batches):
        model = piece_model(path)
        for batch in text_slices(batches):
            ids = [model.encode(t) for t in filled(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text)`` for each row; null ids give the empty text."""

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            texts = [model.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row: encoded, then decoded."""

    def run(batches):
        model = piece_model(path)
        for batch in text_slices(batches):
            found = model.digests(filled(batch.column("text")))
            arrays = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
