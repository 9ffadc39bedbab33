"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less have at least one of their differing bits in one of three
blocks of the 64 bits (or none differs). With that block masked, at most two bits differ, and both
fingerprints have a variant in common within half that radius: at most one flipped bit each. So every
distinct fingerprint emits its 131 variants (three masks, each with no or one flipped bit outside the
mask), and the variants are shuffled. Fingerprints that share a variant are verified bit by bit. A
full ball of radius two would emit 2,081 variants for the same pairs.

Equal fingerprints are one class from the start, whatever their number. Inside a bucket only a
spanning star of each linked class is emitted, so nothing grows with the pairs of a group. A bucket can
hold at most 44 x 2^22 distinct fingerprints; large ones are searched by flipping bits of the masked
block and looking the result up, never pair by pair.

Null and empty texts have fingerprint zero, linked like any other. Rows without an id take part, but
are no candidates for the smallest id; a class of such rows only has a null ``component_id``. Repeated
rows each give a row; equal ids and equal fingerprints need no order. Texts of any length are read
whole. An empty table gives no rows. ``near_duplicates`` reads no other columns; ``drop_near_duplicates``
carries them unchanged, whatever their names but ``__near_id``, ``__near_hash`` and ``__near_text``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.components import components
from webloom.llm.words import filled, text_slices
from webloom.session import materialize

RADIUS = 3
#: First and last bit (exclusive) of the blocks that are masked in turn.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Buckets up to this size are verified pair by pair.
PAIRWISE = 1024
#: How often each bit is set in a byte value.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text's word shingles, repeats included; without words it is zero."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    if len(words) > shingle:
        begins, ends = begins[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        begins, ends = begins[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], "<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    result = 0
    for byte in range(8):
        counts = np.bincount(columns[:, byte], minlength=256) @ BYTE_BITS
        result |= sum(1 << bit for bit in range(8) if 2 * counts[bit] > len(hashes)) << 8 * byte
    return result


def fingerprints(text: str = "text", shingle: int = 3):
    """The fingerprint of a text column, as the signed number of the same bits."""

    @F.arrow_udf("long")
    def fingerprint_of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t.encode(), shingle) for t in filled(texts).to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())

    return fingerprint_of(F.col(text))


def variants(prints: np.ndarray) -> np.ndarray:
    """All bucket keys of each fingerprint: the bits outside a mask moved together, the mask's number on top."""
    keys = []
    for number, (low, high) in enumerate(BLOCKS):
        below = np.uint64((1 << low) - 1)
        rest = (prints & below) | ((prints >> np.uint64(high)) << np.uint64(low) if high < 64 else np.uint64(0))
        flips = np.array([0] + [1 << b for b in range(64 - (high - low))], np.uint64)
        keys.append((rest[:, None] ^ flips[None, :]) | np.uint64(number << 60))
    return np.concatenate(keys, axis=1)


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes."""
    labels = np.arange(n)
    while True:
        before = labels.copy()
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def linked_pairwise(prints: np.ndarray) -> np.ndarray:
    a, b = np.triu_indices(len(prints), 1)
    near = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
    return _settle(len(prints), a[near], b[near])


def linked_by_flips(prints: np.ndarray, key: int) -> np.ndarray:
    """Classes within a bucket of sorted distinct fingerprints, by looking up changed masked blocks.

    All members are within one flip of the bucket's centre outside the mask. Two of them differ there
    in 0 bits if they have the same flip, in 1 if one has none, else in 2.
    """
    low, high = BLOCKS[key >> 60]
    mask = np.uint64(((1 << (high - low)) - 1) << low)
    rest = np.uint64(key & ((1 << 60) - 1))
    centre = (rest & np.uint64((1 << low) - 1)) | ((rest >> np.uint64(low)) << np.uint64(high) if high < 64 else np.uint64(0))
    inner = prints & mask
    order = np.argsort(inner, kind="stable")
    same = inner[order][1:] == inner[order][:-1]
    a, b = [order[1:][same]], [order[:-1][same]]  # equal blocks: at most two bits differ

    def look(wanted, table, members):
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        hit = np.flatnonzero(table[at] == wanted)
        a.append(hit)
        b.append(members[at[hit]])

    blocks, first = np.unique(inner, return_index=True)
    everyone = np.arange(len(prints))
    bits = [np.uint64(1 << i) for i in range(low, high)]
    for bit in bits:
        look(inner ^ bit, blocks, first)
    for pair in combinations(bits, 2):
        change = pair[0] | pair[1]
        look(prints ^ change, prints, everyone)
        look((inner ^ change) | centre, prints, everyone)
    for three in combinations(bits, 3):
        look(prints ^ (three[0] | three[1] | three[2]), prints, everyone)
    return _settle(len(prints), np.concatenate(a), np.concatenate(b))


def bucket_links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of complete buckets; both arrays are sorted by key."""
    change = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[change, len(keys)])
    two = change[sizes == 2]
    near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= RADIUS
    left, right = [prints[two][near]], [prints[two + 1][near]]
    for begin, size in zip(change[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        members = np.sort(prints[begin:begin + size])
        labels = linked_pairwise(members) if size <= PAIRWISE else linked_by_flips(members, int(keys[begin]))
        other = np.flatnonzero(labels != np.arange(size))
        left.append(members[other])
        right.append(members[labels[other]])
    return np.concatenate(left), np.concatenate(right)


def _emit(batches):
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for begin in range(0, len(prints), 20_000):
            part = prints[begin:begin + 20_000]
            keys = variants(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))],
                ["bucket", "fp"])


def _verify(batches):
    def links(parts):
        keys, prints = (np.concatenate(x) for x in zip(*parts, strict=True))
        whole = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
        return keys[:whole], prints[:whole], (keys[whole:], prints[whole:])

    def pairs_of(keys, prints):
        a, b = bucket_links(keys, prints)
        # A pair that agrees outside a mask meets in all its buckets, often in the same task.
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])

    parts = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("bucket", "fp"))
        parts.append(own)
        # A bucket over many batches is put together once, when the next one begins.
        if own[0][-1] != parts[0][0][0]:
            keys, prints, rest = links(parts)
            yield pairs_of(keys, prints)
            parts = [rest]
    if parts:
        yield pairs_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect all within the radius."""
    dealt = distinct.select("fp").mapInArrow(_emit, "bucket long, fp long").repartition("bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(_verify, "a long, b long").distinct()


def classes(marked: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` for the distinct fingerprints of rows ``(doc_id, fp)``; a class has one root.

    Tables that are joined on a class or fingerprint are written first: both sides then are plain scans,
    and a class with a third of all rows is split by its measured size.
    """
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = components(fingerprint_links(distinct)).withColumnRenamed("node", "_node")
    joined = materialize(distinct.join(found, distinct["fp"] == found["_node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return materialize(joined.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row."""
    marked = materialize(docs.select(F.col(key).alias("doc_id"), fingerprints(text, shingle).alias("fp")), "marked")
    return marked.join(classes(marked), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class with all its columns: that with the smallest id.

    Rows are told apart by id and text, so a row goes for its own text, whatever other rows have its id.
    Of the texts of that id, the one with the smallest hash stays; of equal rows any one. A class of rows
    without an id keeps one of them. Texts are not moved for this: ids and hashes decide.
    """
    own_text = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = materialize(docs.select(F.col(key).alias("doc_id"), own_text.alias("hash"), fingerprints(text, shingle).alias("fp")), "marked")
    found = marked.join(classes(marked), "fp").select("doc_id", "hash", "root")
    texts = materialize(found.groupBy("doc_id", "hash", "root").agg(F.count("*").alias("rows")), "texts")
    mine = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    keepers = materialize(texts.groupBy("root").agg(F.min(mine).alias("kept")), "keepers")
    decided = texts.join(keepers, "root").select(
        F.col("doc_id").alias("__near_id"), F.col("hash").alias("__near_hash"), "rows", (mine == F.col("kept")).alias("kept"))
    decided = materialize(decided.where("NOT kept OR rows > 1"), "decisions")
    hashed = docs.withColumn("__near_text", own_text)
    same = F.col(key).eqNullSafe(F.col("__near_id")) & (F.col("__near_text") == F.col("__near_hash"))
    rest = hashed.join(decided, same, "left_anti").drop("__near_text")
    repeated = decided.where("kept")
    if repeated.isEmpty():
        return rest
    again = hashed.join(repeated, same, "left_semi").dropDuplicates([key, "__near_text"])
    return rest.unionByName(again.drop("__near_text"))
