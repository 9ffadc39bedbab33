"""Exact duplicates by Patricia tries whose terminals own the group.

Every scan task inserts its texts into a compressed radix trie, so that a text repeated in the task
leaves it once; when the trie outgrows its budget, its largest subtree is handed on early. The
distinct texts are shuffled by length and content hash, sorted by them, and inserted into tries again;
a trie is handed on between two keys, when all its texts are complete. Terminals keep the largest id,
how many rows have it, and the group's size. A group of any size thus crosses the shuffle once for
each task; its rows then find their owner by the digest of the text.

Null texts count as empty. The row with the largest ``doc_id`` stays; a null id is smaller than any
other. Rows that repeat both the id and the text of the row that stays are the same document: each is
reported as kept, and ``drop_exact_duplicates`` leaves one of them. Empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import text_slices
from webloom.session import materialize

#: Text bytes that a task's trie may hold.
TRIE_BYTES = 64 << 20


def common_length(a: bytes, begin: int, b: bytes) -> int:
    """Length of the longest common prefix of ``a[begin:]`` and ``b``."""
    low, high = 0, min(len(a) - begin, len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[begin + low:begin + middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label, self.children, self.owner = label, {}, owner


def merged(owner, other):
    """Owners are ``(id, rows with that id, rows)``; the larger id wins, null is smallest."""
    if owner is None:
        return other
    rows = owner[2] + other[2]
    if owner[0] == other[0]:
        return owner[0], owner[1] + other[1], rows
    if other[0] is not None and (owner[0] is None or other[0] > owner[0]):
        owner = other
    return owner[0], owner[1], rows


class Patricia:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root = Node(b"")
        self.sizes: dict[int, int] = {}  # bytes held below each child of the root

    @property
    def size(self) -> int:
        return sum(self.sizes.values())

    def insert(self, key: bytes, owner) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                self.sizes[key[0]] = self.sizes.get(key[0], 0) + len(key) - at + 100
                return
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = common_length(key, at, child.label)
            fork = Node(child.label[:shared])
            child.label = child.label[shared:]
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            node, at = fork, at + shared
        node.owner = merged(node.owner, owner)

    def items(self, roots=None):
        stack = [(b"", node) for node in (roots or [self.root])]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node.label
            if node.owner is not None:
                yield key, node.owner
            stack += [(key, child) for child in node.children.values()]

    def spill_largest(self):
        """Remove the largest subtree and return its items."""
        first = max(self.sizes, key=self.sizes.get)
        del self.sizes[first]
        return list(self.items([self.root.children.pop(first)]))


def rows_of(items, kind, convert):
    owners = [owner for _, owner in items]
    return pa.RecordBatch.from_arrays(
        [pa.array([convert(key) for key, _ in items], pa.binary()), pa.array([o[0] for o in owners], kind),
         pa.array([o[1] for o in owners], pa.int64()), pa.array([o[2] for o in owners], pa.int64())],
        ["content", "best", "n_best", "n"])


def chunked(items, kind, convert, limit: int = 8 << 20):
    part, held = [], 0
    for item in items:
        part.append(item)
        held += len(item[0])
        if held >= limit:
            yield rows_of(part, kind, convert)
            part, held = [], 0
    if part:
        yield rows_of(part, kind, convert)


def owners(docs: DataFrame, text: str = "text", key: str = "doc_id", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``(digest, keep_id, n_best, group_size)``: one row for each distinct text."""
    kind = docs.schema[key].dataType.simpleString()

    def combine(batches):
        trie, id_type = Patricia(), None
        for batch in text_slices(batches, "content"):
            id_type = batch.column("best").type
            contents = batch.column("content").to_pylist()
            for content, doc_id in zip(contents, batch.column("best").to_pylist(), strict=True):
                trie.insert(content.encode(), (doc_id, 1, 1))
            while trie.size > trie_bytes:
                yield from chunked(trie.spill_largest(), id_type, bytes)
        if id_type is not None:
            yield from chunked(trie.items(), id_type, bytes)

    def own(batches):
        trie, id_type, last = Patricia(), None, None
        for batch in batches:
            id_type = batch.column("best").type
            columns = [batch.column(c).to_pylist() for c in ("length", "hash", "content", "best", "n_best", "n")]
            for length, hashed, content, *owner in zip(*columns, strict=True):
                if (length, hashed) != last and trie.size > trie_bytes:
                    yield from chunked(trie.items(), id_type, lambda c: hashlib.sha256(c).digest())
                    trie = Patricia()
                last = (length, hashed)
                trie.insert(content, tuple(owner))
        if id_type is not None:
            yield from chunked(trie.items(), id_type, lambda c: hashlib.sha256(c).digest())

    rows = docs.select(F.col(key).alias("best"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    schema = f"content binary, best {kind}, n_best long, n long"
    combined = rows.mapInArrow(combine, schema).select(
        F.length("content").alias("length"), F.xxhash64("content").alias("hash"), "*")
    dealt = combined.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(own, schema).select(
        F.col("content").alias("digest"), F.col("best").alias("keep_id"), "n_best", F.col("n").alias("group_size"))


def digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row, dropped ones too."""
    rows = docs.select(F.col(key).alias("doc_id"), digest(text).alias("digest"))
    joined = rows.join(owners(docs, text, key), "digest")
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows meet their owner by id and digest, so a large group is spread over all tasks.
    """
    found = materialize(owners(docs, text, key).select("digest", "keep_id", "n_best"), "text-owners")
    mark = "_digest_of_text"
    keep = found.select(F.col("digest").alias(mark), F.col("keep_id").alias("_keep_id"))
    rows = docs.withColumn(mark, digest(text))

    def meet(owned):
        return rows.join(owned, (rows[mark] == owned[mark]) & rows[key].eqNullSafe(owned["_keep_id"]), "left_semi")

    if found.where("n_best > 1").isEmpty():
        return meet(keep).drop(mark)
    tied = F.col("n_best") > 1
    once, often = (found.where(c).select(F.col("digest").alias(mark), F.col("keep_id").alias("_keep_id")) for c in (~tied, tied))
    return meet(once).unionByName(meet(often).dropDuplicates([key, mark])).drop(mark)
