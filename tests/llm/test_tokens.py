import hashlib
import zlib
from collections import defaultdict

import edges
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from webloom.llm import packing, pieces, token_count

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=PIECES)
BYTE_LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
PARTS = st.sampled_from(["a", "b", "the", " ", "  ", "▁", "\n", "é", "😀", "ing", "\t", "\x00", "x", ".", ", ", "中", "'s", "12", "\x1c", "\x85",
                         "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "İ", "ſ", "Über.", "ÉCOLE,", "<s>", "́", " ", "Σ", "!!", "ñ", "　"])
TEXT = st.lists(PARTS, max_size=25).map("".join)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_counts_like_the_library(texts):
    got = token_count.byte_merges(BYTES).count(pa.array(texts))
    assert got.tolist() == [len(BYTE_LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_pieces_like_the_library(texts):
    model = pieces.piece_model(PIECES)
    for text, found in zip(texts, model.digests(pa.array(texts))):
        ids = PROCESSOR.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == PROCESSOR.decode(ids)
        assert found == (len(ids), sha(",".join(map(str, ids))), sha(PROCESSOR.decode(ids)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=8))
def test_any_ids_decode_like_the_library(ids):
    assert pieces.piece_model(PIECES).decode(ids) == PROCESSOR.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_words_like_the_library(texts):
    want = [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    for end, ids in ((b"", []), (b"\1\0\0\0", [1])):
        got = packing.chunk_ids(WORDS).documents(pa.array(texts), end)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w + ids for w in want]


@pytest.mark.parametrize("change", [
    lambda d: d["normalizer"]["normalizers"].pop(), lambda d: d["model"].update(end_of_word_suffix=None), lambda d: d.update(normalizer=None),
    lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"), lambda d: d["added_tokens"][0].update(content="two words"),
    lambda d: d["added_tokens"][0].update(normalized=True), lambda d: d["added_tokens"][0].update(content="letters"),
])
def test_packing_refuses_other_kinds_of_files(tmp_path, change):
    import json

    data = json.loads(open(WORDS, encoding="utf-8").read())
    change(data)
    file = tmp_path / "other.json"
    file.write_text(json.dumps(data))
    with pytest.raises(ValueError):
        packing.ChunkIds(str(file))


def test_count_rows(spark):
    rows = token_count.token_counts(edges.documents(spark), BYTES).collect()
    want = []
    for i, t in edges.TEXTS:
        n = len(BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert token_count.token_counts(edges.documents(spark, []), BYTES).count() == 0


def test_merges_of_other_orders_are_refused(tmp_path):
    import json

    data = json.loads(open(BYTES).read())
    data["model"]["merges"] = data["model"]["merges"][::-1]
    file = tmp_path / "odd.json"
    file.write_text(json.dumps(data))
    with pytest.raises(ValueError):
        token_count.ByteMerges(str(file))


def test_piece_rows_and_round_trip(spark):
    docs = edges.documents(spark)
    rows = pieces.round_trip_digests(docs, PIECES).collect()
    want = []
    for i, t in edges.TEXTS:
        ids = PROCESSOR.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(PROCESSOR.decode(ids))))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, PROCESSOR.decode(PROCESSOR.encode(t or ""))) for i, t in edges.TEXTS), key=str)
    assert pieces.round_trip_digests(edges.documents(spark, []), PIECES).count() == 0


def check_packing(rows, texts, length=2048):
    ids = defaultdict(list)
    for i, t in texts:
        own = np.array(WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        ids[i].append(own)
    total = sum(len(o) for v in ids.values() for o in v)
    assert sum(r.length for r in rows) == total
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert any(len(o) == r.doc_tokens and zlib.crc32(o[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for o in ids[r.doc_id])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    pieces_of = defaultdict(list)
    for r in rows:
        pieces_of[r.doc_id].append((r.start, r.length))
    for i, parts in pieces_of.items():
        assert sum(n for _, n in parts) == sum(len(o) for o in ids[i])
        if len(ids[i]) == 1:
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n


@pytest.mark.parametrize("buffer", [3000, 1 << 20])
def test_packed_rows(spark, buffer):
    check_packing(packing.pack(edges.documents(spark), WORDS, buffer_tokens=buffer).collect(), edges.TEXTS)


def test_packing_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, WORDS).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(edges.documents(spark, []), WORDS).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40), st.lists(st.integers(1, 16), max_size=20))
def test_dealing_places_every_token_or_returns_it(lengths, capacities):
    placed, rest = packing.deal(lengths, capacities)
    for piece, n in enumerate(lengths):
        parts = sorted([(s, k) for p, s, k, _, _ in placed if p == piece] + [(s, k) for p, s, k in rest if p == piece])
        at = 0
        for start, k in parts:
            assert start == at
            at += k
        assert at == n
    for sequence, room in enumerate(capacities):
        assert sum(k for _, _, k, s, _ in placed if s == sequence) <= room
    if rest:
        assert sum(k for _, _, k, _, _ in placed) == sum(capacities)
