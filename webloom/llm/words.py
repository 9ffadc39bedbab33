"""Bounded slices of text batches, their distinct words, and bounded memories of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 8 << 20


def filled(texts: pa.Array) -> pa.Array:
    """The texts, null as the empty text."""
    return pc.fill_null(texts.cast(pa.string()), "")


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(filled(batch.column(column))).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


@dataclass
class Words:
    """Ragged word codes: text ``i`` has ``codes[offsets[i]:offsets[i + 1]]``, indices into ``dictionary``."""

    offsets: np.ndarray
    codes: np.ndarray
    dictionary: pa.Array

    @cached_property
    def distinct(self) -> list[str]:
        return self.dictionary.to_numpy(zero_copy_only=False).tolist()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value of each distinct word."""
        total = np.concatenate([[0], np.cumsum(values[self.codes])])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def split_words(texts: pa.Array, separator: str | None = " ") -> Words:
    """Split at every ``separator``, or into the non-empty runs between ASCII white space."""
    lists = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py() if separator is None else -1
    if empty >= 0:  # before leading and after trailing white space
        kept = codes != empty
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return Words(offsets, codes, coded.dictionary)


class Recent:
    """Results by key, of the last ``size`` to twice ``size`` keys asked for."""

    def __init__(self, compute: Callable[[list], list], size: int = 200_000):
        self.compute, self.size, self.new, self.old = compute, size, {}, {}

    def __call__(self, keys: list) -> list:
        found = list(map(self.new.get, keys))
        missing = [i for i, value in enumerate(found) if value is None]
        unknown = []
        for i in missing:
            value = self.old.get(keys[i])
            if value is None:
                unknown.append(i)
            else:
                found[i] = value
        for begin in range(0, len(unknown), 50_000):
            part = unknown[begin:begin + 50_000]
            for i, value in zip(part, self.compute([keys[i] for i in part]), strict=True):
                found[i] = value
        if len(self.new) + len(missing) > self.size:
            self.old, self.new = self.new, {}
        if len(missing) <= self.size:
            for i in missing:
                self.new[keys[i]] = found[i]
        return found


def ragged(parts: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of ``parts[c]`` for each code, and the length of each."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    counts = lengths[codes]
    ends = np.cumsum(counts)
    at = np.repeat(begins[codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], counts
