"""Cost-balanced packing of documents into fixed-length training sequences.

Each partition is packed as a stream. Whole sequences are cut from long documents; what is left of
each document is a piece. Pieces go, longest first, to the sequence of the lowest estimated cost
(linear plus quadratic in each piece) that still has room; a piece that fits nowhere is cut into the
remaining room, so every sequence of a full buffer is filled. The rest moves on to the next buffer, and
the last rest of a partition is dealt to sequences whose lengths are powers of two, which need no
padding. Memory holds one buffer of tokens; nothing is shuffled, and a lost task packs its own
partition again.

Null and empty texts are packed as their end id alone. Repeated rows are packed each for itself. Rows
without a ``doc_id`` are packed with a null one. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import Recent, filled, split_words, text_slices

#: Tokens that a task holds before it packs them: about 512 sequences.
BUFFER_TOKENS = 1 << 20
#: Linear cost is one for each token; the quadratic part equals it at a piece of this length.
EQUAL_COST_LENGTH = 8192
#: The pattern of words and the mark of a word's last symbol in the vocabulary.
WORD_PATTERN, WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"


#: Letters that stay single letters when they are lower-cased and composed.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words that the library is given at once, as one text.
WORDS_AT_ONCE = 200


def check_supported(data: dict, path: str) -> None:
    """Refuse tokenizers that do not cut at white space, or that look across the words cut out."""
    model, normal, before = data["model"], data["normalizer"] or {}, data["pre_tokenizer"] or {}
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    cuts = [(p["type"], p.get("behavior"), p.get("invert")) for p in before.get("pretokenizers", [])]
    supported = (
        steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and cuts == [("Split", "Removed", True), ("ByteLevel", None, None)]
        and before["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN} and not before["pretokenizers"][1]["add_prefix_space"]
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout")
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"].strip() or len(t["content"].split()) > 1
                    or t["content"].isalpha() for t in data["added_tokens"])
    )
    if not supported:
        raise ValueError(f"{path} is no BPE of lower-case words without white space")


class ChunkIds:
    """Ids of space-separated chunks, as little-endian unsigned 32-bit bytes.

    Words of letters are lower-cased before they are looked up, and a mark after one is a word of its
    own; anything else, special strings too, is given to the library as it is written.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        check_supported(data, path)
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(max(data["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in data["model"]["vocab"].items() if token.endswith(WORD_END)]] = True
        self.plain = Recent(self.encode_plain)
        self.marks = [b"", *self.one_by_one([".", ","])]

    def one_by_one(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode_plain(self, chunks: list[str]) -> list[bytes]:
        """Words of letters have one last symbol each: many are encoded as one text and cut there."""
        letters = pc.match_substring_regex(pa.array(chunks, pa.string()), f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        found: list[bytes] = [b""] * len(chunks)
        at, odd = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()
        groups = [at[i:i + WORDS_AT_ONCE] for i in range(0, len(at), WORDS_AT_ONCE)]
        texts = [" ".join([chunks[i] for i in group]) for group in groups]
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw, begin = ids.tobytes(), 0
            for i, end in zip(group, cuts, strict=True):
                found[i], begin = raw[begin:end], end
        for i, ids in zip(odd, self.one_by_one([chunks[i] for i in odd]), strict=True):
            found[i] = ids
        return found

    def chunk_bytes(self, chunks: pa.Array) -> list[bytes]:
        """The ids of each distinct chunk."""
        marked = pc.match_substring_regex(chunks, f"^[{LETTERS}]+[.,]$")
        heads = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        heads = pc.if_else(pc.match_substring_regex(heads, "^[A-Za-z]+$"), pc.ascii_lower(heads), heads).dictionary_encode()
        ids = self.plain(heads.dictionary.to_pylist())
        mark = pc.if_else(marked, pc.if_else(pc.ends_with(chunks, "."), 1, 2), 0).to_numpy(zero_copy_only=False).tolist()
        codes = heads.indices.to_numpy(zero_copy_only=False).tolist()
        return [ids[c] + self.marks[m] if m else ids[c] for c, m in zip(codes, mark, strict=True)]

    def documents(self, texts: pa.Array, end: bytes = b"") -> list[memoryview]:
        """The ids of each text, with ``end`` after them."""
        words = split_words(pc.replace_substring(texts, "\n", " "))
        parts = [*self.chunk_bytes(words.dictionary), end]
        codes = np.insert(words.codes, words.offsets[1:], len(parts) - 1)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        bytes_until = np.r_[0, np.cumsum(sizes[codes])]
        cuts = bytes_until[words.offsets + np.arange(len(words.offsets))].tolist()
        whole = memoryview(b"".join([parts[c] for c in codes.tolist()]))
        return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def cost(length):
    """Estimated cost of a piece that attends to itself."""
    return length + length * length / EQUAL_COST_LENGTH


def deal(lengths: list[int], capacities: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Put pieces into sequences, longest first, each into the cheapest with room for all of it.

    Returns the placed parts ``(piece, start in it, length, sequence, offset in it)``, and the parts
    ``(piece, start, length)`` for which there is no room at all.
    """
    room = np.array(capacities, np.int64)
    spent = np.zeros(len(capacities))
    used = np.zeros(len(capacities), np.int64)
    placed, cut = [], []

    def put(piece, start, length, sequence):
        placed.append((piece, start, length, sequence, int(used[sequence])))
        used[sequence] += length
        room[sequence] -= length
        spent[sequence] += cost(length)

    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        choice = np.where(room >= lengths[piece], spent, np.inf)
        best = int(choice.argmin()) if len(choice) else -1
        if best < 0 or choice[best] == np.inf:
            cut.append(piece)
        else:
            put(piece, 0, lengths[piece], best)
    rest = []
    open_sequences = sorted(np.flatnonzero(room), key=lambda s: spent[s])
    for piece in cut:
        start = 0
        while open_sequences and start < lengths[piece]:
            sequence = int(open_sequences[0])
            length = int(min(room[sequence], lengths[piece] - start))
            put(piece, start, length, sequence)
            start += length
            if not room[sequence]:
                open_sequences.pop(0)
        if start < lengths[piece]:
            rest.append((piece, start, lengths[piece] - start))
    return placed, rest


class Packer:
    """Packs one partition's documents; ``rows`` collects ``(document, start, length, crc, sequence, offset)``."""

    def __init__(self, length: int, partition: int):
        self.length, self.next_sequence = length, partition << 33
        self.pieces: list[tuple[tuple, int, memoryview]] = []  # document (id, tokens), start, ids
        self.held, self.rows = 0, []

    def emit(self, document, start, ids, sequence, offset):
        self.rows.append((*document, start, len(ids) // 4, zlib.crc32(ids), sequence, offset))

    def add(self, doc_id, ids: memoryview) -> None:
        document, step = (doc_id, len(ids) // 4), 4 * self.length
        whole = len(ids) // step
        for i in range(whole):
            self.emit(document, i * self.length, ids[i * step:(i + 1) * step], self.next_sequence, 0)
            self.next_sequence += 1
        if len(ids) > whole * step:
            self.pieces.append((document, whole * self.length, ids[whole * step:]))
            self.held += len(ids) // 4 - whole * self.length

    def flush(self, last: bool = False) -> None:
        whole, rest = divmod(self.held, self.length)
        capacities = [self.length] * whole
        if last:
            capacities += [1 << b for b in range(rest.bit_length())[::-1] if rest >> b & 1]
        placed, left = deal([len(ids) // 4 for _, _, ids in self.pieces], capacities)
        for piece, begin, length, sequence, offset in placed:
            document, start, ids = self.pieces[piece]
            self.emit(document, start + begin, ids[4 * begin:4 * (begin + length)], self.next_sequence + sequence, offset)
        self.next_sequence += len(capacities)
        # Copies, so that the ids of whole slices are not held for a few rests.
        self.pieces = [(self.pieces[p][0], self.pieces[p][1] + b, memoryview(bytes(self.pieces[p][2][4 * b:4 * (b + n)]))) for p, b, n in left]
        self.held = sum(n for _, _, n in left)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, buffer_tokens: int = BUFFER_TOKENS,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in its sequence.

    ``path`` is a ``tokenizers`` file that drops white space, read where the tasks run.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        vocabulary, packer = chunk_ids(path), Packer(length, TaskContext.get().partitionId())

        def rows():
            columns = list(zip(*packer.take(), strict=True)) or [()] * len(names)
            arrays = [pa.array(columns[0], batch_key)] + [pa.array(c, pa.int64()) for c in columns[1:]]
            return pa.RecordBatch.from_arrays(arrays, names)

        batch_key = None
        for batch in text_slices(batches):
            batch_key = batch.column("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), vocabulary.documents(filled(batch.column("text")), end), strict=True):
                packer.add(doc_id, ids)
                if packer.held >= buffer_tokens:
                    packer.flush()
            yield rows()
        if batch_key is not None:
            packer.flush(last=True)
            yield rows()

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}"] + [f"`{n}` long" for n in names[1:]])
    packed = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
