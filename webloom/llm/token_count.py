"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of arrays.

Texts are cut at spaces into chunks that cannot influence each other; each distinct chunk is split
into pre-tokens once, and the pre-tokens of a batch lie in one ragged array. In every step each
pre-token applies its lowest-ranked pair, at all its places at once, until no pair is left; what
survives is counted.

Null texts count as empty (0 bytes, 0 tokens). Every row gives one row, repeated ones too; all work
is inside a partition. Special strings of the vocabulary are one token each, as the library's default
is. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import Recent, filled, split_words, text_slices

#: Fixed value: the pre-token pattern of byte-level BPE, with Unicode's white space spelled out.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A space between two other white-space characters: cutting there would change the pre-tokens.
UNSAFE = r"[\p{White_Space}] [\p{White_Space}]|^ | $"
NO_RANK = np.iinfo(np.int64).max


class ByteMerges:
    """Merge ranks of a ``tokenizers`` JSON file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, pre = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or data["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        for token in data["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError(f"added token {token['content']!r} has matching rules that are not supported")
        self.special = [token["content"] for token in data["added_tokens"]]
        vocabulary = model["vocab"]
        self.size = max(vocabulary.values()) + 1
        # Printable bytes stand for themselves; the others follow from code point 256 on, in order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_ids = np.array([vocabulary[letter[b]] for b in range(256)], np.int64)
        left, right, result = [], [], []
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            left.append(vocabulary[a])
            right.append(vocabulary[b])
            result.append(vocabulary[a + b])
        left, right, result = (np.array(x, np.int64) for x in (left, right, result))
        ranks = np.arange(len(left))
        made = np.full(self.size, -1, np.int64)
        made[result] = ranks
        if (made[left] >= ranks).any() or (made[right] >= ranks).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        order = np.argsort(left * self.size + right)
        self.keys, self.ranks, self.results = (left * self.size + right)[order], ranks[order], result[order]
        self.pattern = regex.compile(PRE_TOKENS)
        self.unsafe = regex.compile(UNSAFE)
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.chunks = Recent(self.count_chunks)

    def merged_lengths(self, texts: list[bytes]) -> np.ndarray:
        """How many symbols are left of each byte string."""
        counts = np.zeros(len(texts), np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = self.byte_ids[np.frombuffer(b"".join(texts), np.uint8)]
        rows = np.repeat(np.arange(len(texts)), lengths)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            pairs = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            known = (self.keys[at] == pairs) & (rows[1:] == rows[:-1])
            rank = np.append(np.where(known, self.ranks[at], NO_RANK), NO_RANK)
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            hits = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != NO_RANK))
            # In a run of the same symbol every other pair overlaps the one before it.
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hits) != 1], np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            symbols = symbols.copy()
            symbols[hits] = self.results[at[hits]]
            done = lowest == NO_RANK
            counts[rows[starts[done]]] = sizes[done]
            keep = ~np.repeat(done, sizes)
            keep[hits + 1] = False
            symbols, rows = symbols[keep], rows[keep]
        return counts

    def count_chunks(self, chunks: list[str]) -> list[int]:
        parts = list(map(self.pattern.findall, chunks))
        known: dict[str, int] = {}
        codes = [known.setdefault(part, len(known)) for found in parts for part in found]
        sizes = self.merged_lengths([part.encode() for part in known])
        total = np.r_[0, np.cumsum(sizes[codes])] if codes else np.zeros(1, np.int64)
        ends = np.cumsum([0, *map(len, parts)])
        return (total[ends[1:]] - total[ends[:-1]]).tolist()

    def count_text(self, text: str) -> int:
        """A text with special strings, or where single spaces are no safe place to cut."""
        parts = self.special_at.split(text) if self.special_at else [text]
        return len(parts) - 1 + sum(self.count_chunks(parts))

    def count(self, texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring_regex(texts, r"[\pZ\s\x0b\x{85}] [\pZ\s\x0b\x{85}]|^ | $|  ")
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = odd.to_numpy(zero_copy_only=False)
        # Chunks after the first start with their space; the first is looked up without one.
        plain = pc.if_else(pa.array(odd), "", texts)
        words = split_words(plain)
        spaced = np.array(self.chunks([" " + w for w in words.distinct]), np.int64)
        counts = words.sums(spaced)
        first = words.codes[words.offsets[:-1]]
        heads = np.unique(first)
        bare = np.zeros(len(words.distinct), np.int64)
        bare[heads] = self.chunks([words.distinct[i] for i in heads])
        counts += bare[first] - spaced[first]
        for i in np.flatnonzero(odd):
            counts[i] = self.count_text(texts[int(i)].as_py())
        return counts


@lru_cache(maxsize=2)
def byte_merges(path: str) -> ByteMerges:
    return ByteMerges(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row; ``path`` is read where the tasks run."""

    def count(batches):
        merges = byte_merges(path)
        for batch in text_slices(batches):
            texts = filled(batch.column("text"))
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(merges.count(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
