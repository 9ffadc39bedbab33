"""Byte-pair encoding with a queue of merge ranks, and decoding by concatenation.

A pre-token's bytes are the nodes of a doubly linked list. Every neighbouring pair with a merge rank
waits in a priority queue, ordered by rank and place. The head of the queue is merged, its right node
unlinked, and the two new pairs are queued; entries whose left node is gone, or whose pair has become
another, are stale and skipped. Ids are decoded by concatenating the byte strings of the vocabulary.

Texts are cut at spaces that always begin a pre-token, so each distinct chunk of a slice is encoded
once and remembered for a while. The memories are bounded, and no row needs another: nothing is
shuffled, and a lost task encodes its own rows again.

Null texts count as empty: no ids, decoded to the empty text. Special strings of the vocabulary inside
a text become their one id, the longest at a place, as is the library's default. Every row gives one
row, repeated ones too; rows without an id keep their null. Texts of any length are encoded whole; a
pre-token of n bytes takes n log n steps. Equal ranks at several places are merged from the left.
Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.token_count import PRE_TOKENS
from webloom.llm.words import Recent, filled, split_words, text_slices

#: Chunks and pre-tokens that a worker remembers: this many to twice as many, about 350 bytes each.
REMEMBERED_CHUNKS, REMEMBERED_TOKENS = 100_000, 250_000


class PairMerges:
    """Vocabulary and merge ranks of a ``tokenizers`` file with plain byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, before = data["model"], data["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
            and not data["normalizer"] and (data["decoder"] or {}).get("type") == "ByteLevel"
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in data["added_tokens"])
        )
        if not plain:
            raise ValueError(f"{path} is no plain byte-level BPE")
        # The letters that stand for bytes: printable ones for themselves, the others from code point 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = [chr(b) for b in printable] + [chr(256 + i) for i in range(256 - len(printable))]
        bytes_of = dict(zip(letters, printable + sorted(set(range(256)) - set(printable)), strict=True))
        vocabulary = model["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.vocabulary = {i: bytes(map(bytes_of.__getitem__, token)) for token, i in vocabulary.items()}
        # An added token is text of its own; only one that looks like letters of bytes is read as these.
        self.vocabulary |= {
            i: bytes(map(bytes_of.__getitem__, s)) if all(c in bytes_of for c in s) else s.encode() for s, i in added.items()}
        self.byte_ids = [0] * 256
        for letter, byte in bytes_of.items():
            self.byte_ids[byte] = vocabulary[letter]
        #: Of each symbol, the symbols that it merges with on its right, and the ranks.
        self.followers: list[dict[int, int]] = [{} for _ in range(max(vocabulary.values()) + 1)]
        self.made: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.followers[vocabulary[left]][vocabulary[right]] = len(self.made)
            self.made.append(vocabulary[left + right])
        self.added = added
        longest_first = sorted(added, key=lambda s: (-len(s), s))
        self.specials = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.pattern = regex.compile(PRE_TOKENS)
        self.tokens = Recent(self._encode_tokens, REMEMBERED_TOKENS)
        self.chunks = Recent(self._encode_chunks, REMEMBERED_CHUNKS)

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.byte_ids[b] for b in token]
        end, followers, made = len(symbols), self.followers, self.made
        # Queue entries are the rank above the place, in as few bits as will do.
        bits = end.bit_length()
        places = (1 << bits) - 1
        # Of each node, the rank of the pair it begins; -1 where there is none, or the node is gone.
        ranks = [followers[a].get(b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
        waiting = [rank << bits | place for place, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(waiting)
        ranks.append(-1)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while waiting:
            entry = heapq.heappop(waiting)
            rank, left = entry >> bits, entry & places
            if ranks[left] != rank:
                continue
            right = after[left]
            symbol = symbols[left] = made[rank]
            symbols[right] = ranks[right] = ranks[left] = -1
            beyond = after[left] = after[right]
            if beyond < end:
                before[beyond] = left
                new = ranks[left] = followers[symbol].get(symbols[beyond], -1)
                if new >= 0:
                    heapq.heappush(waiting, new << bits | left)
            first = before[left]
            if first >= 0:
                new = ranks[first] = followers[symbols[first]].get(symbol, -1)
                if new >= 0:
                    heapq.heappush(waiting, new << bits | first)
        return [s for s in symbols if s >= 0]

    def _encode_tokens(self, tokens: list[str]) -> list[tuple[bytes, bytes]]:
        found = []
        for token in tokens:
            ids = self.merge(token.encode())
            found.append((pack(f"<{len(ids)}I", *ids), b"".join([self.vocabulary[i] for i in ids])))
        return found

    def _encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each chunk: its ids as little-endian unsigned 32-bit integers, and their bytes decoded."""
        split = list(map(self.pattern.findall, chunks))
        distinct = list(dict.fromkeys(chain.from_iterable(split)))
        known = dict(zip(distinct, self.tokens(distinct), strict=True))
        return [
            known[tokens[0]] if len(tokens) == 1 else tuple(b"".join(part) for part in zip(*map(known.get, tokens), strict=True))
            if tokens else (b"", b"") for tokens in split]

    def encode_whole(self, text: str) -> tuple[bytes, bytes]:
        """A text with special strings, or in which single spaces are no safe places to cut."""
        ids, decoded, at = [], [], 0

        def plain(part: str) -> None:
            tokens = self.pattern.findall(part)
            distinct = list(dict.fromkeys(tokens))
            known = dict(zip(distinct, self.tokens(distinct), strict=True))
            for token in tokens:
                own, back = known[token]
                ids.append(own)
                decoded.append(back)

        for match in self.specials.finditer(text) if self.specials else ():
            plain(text[at:match.start()])
            own = self.added[match.group()]
            ids.append(pack("<I", own))
            decoded.append(self.vocabulary[own])
            at = match.end()
        plain(text[at:])
        return b"".join(ids), b"".join(decoded)

    def encoded(self, texts: pa.Array):
        """Of each text: its ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
        # A space next to other white space, or at an end, is not always the begin of a pre-token.
        odd = pc.match_substring_regex(texts, r"[\pZ\s\x0b\x{85}] | [\pZ\s\x0b\x{85}]|^ | $")
        for special in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        words = split_words(pc.if_else(odd, "", texts))
        spaced = self.chunks([" " + w for w in words.distinct])
        heads = np.unique(words.codes[words.offsets[:-1]])
        bare = dict(zip(heads.tolist(), self.chunks([words.distinct[i] for i in heads]), strict=True))
        own, back = ([c[part] for c in spaced] for part in (0, 1))
        ends, codes = words.offsets.tolist(), words.codes.tolist()
        for row, whole in enumerate(odd.to_pylist()):
            if whole:
                yield self.encode_whole(texts[row].as_py())
                continue
            first, rest = bare[codes[ends[row]]], codes[ends[row] + 1:ends[row + 1]]
            yield (first[0] + b"".join([own[c] for c in rest]), first[1] + b"".join([back[c] for c in rest]))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_whole(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that form no character become U+FFFD, unknown ids nothing."""
        return b"".join([self.vocabulary.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pair_merges(path: str) -> PairMerges:
    return PairMerges(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)`` for each row; ``path`` is read where the tasks run."""

    def run(batches):
        merges = pair_merges(path)
        for batch in text_slices(batches):
            ids, sizes = [], [0]
            for own, _ in merges.encoded(filled(batch.column("text"))):
                ids.append(own)
                sizes.append(len(own) // 4)
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text)`` for each row; null ids give the empty text."""

    def run(batches):
        merges = pair_merges(path)
        for batch in batches:
            texts = [merges.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row: encoded, then decoded."""

    def run(batches):
        merges = pair_merges(path)
        for batch in text_slices(batches):
            counts, of_ids, of_text = [], [], []
            for ids, decoded in merges.encoded(filled(batch.column("text"))):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
