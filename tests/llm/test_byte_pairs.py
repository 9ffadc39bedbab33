import hashlib
import json

import edges
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from webloom.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, OURS = Tokenizer.from_file(PATH), byte_pairs.pair_merges(PATH)
PARTS = st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\r\n", "é", "😀", "ing", "\t", "\x00", "x", ".", ", ", "中文", "'s", "'S", "12", "\x1c", "\x85",
                         "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "́", " ", "Σ", "!!", "ñ", "　", "aaaa", "²", "٣"])
TEXT = st.lists(PARTS, max_size=25).map("".join) | st.text(max_size=30)
WIDE = "doc_id long, text string, ids string, n_tokens int, word string"


def plain(text):
    """Ids by the library, and the text it decodes to."""
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def digests(key, text):
    ids, back = plain(text or "")
    return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=500, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_encodes_like_the_library(texts):
    for text, (ids, decoded) in zip(texts, OURS.encoded(pa.array(texts, pa.string()))):
        want, back = plain(text)
        assert np.frombuffer(ids, "<u4").tolist() == want == OURS.encode(text)
        assert decoded.decode() == back == OURS.decode(want) == text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 50256) | st.integers(0, 260), max_size=12))
def test_any_ids_decode_like_the_library(ids):
    assert OURS.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("token", ["a" * 30_000, "abcabcabc" * 3000, "=" * 4097, "ÿ" * 5000, "\u0000" * 2000])
def test_long_tokens(token):
    assert OURS.encode(token) == plain(token)[0]


def lowest_rank_first(token):
    """The rule itself, without queue and list: the leftmost pair of the lowest rank is merged until none is left."""
    symbols = [OURS.byte_ids[b] for b in token]
    while True:
        ranked = [(OURS.followers[a][b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if b in OURS.followers[a]]
        if not ranked:
            return symbols
        rank, i = min(ranked)
        symbols[i:i + 2] = [OURS.made[rank]]


@settings(max_examples=500, deadline=None)
@given(st.binary(max_size=40) | st.text("abcdefghinorst", max_size=60).map(str.encode))
def test_queue_against_its_rule(token):
    assert OURS.merge(token) == lowest_rank_first(token)


def test_rows(spark):
    docs = edges.documents(spark)
    got = byte_pairs.round_trip_digests(docs, PATH)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digests(*t) for t in edges.TEXTS), key=str)
    ids = byte_pairs.encode(docs, PATH)
    assert sorted(map(tuple, ids.collect()), key=str) == sorted(((k, plain(t or "")[0]) for k, t in edges.TEXTS), key=str)
    back = byte_pairs.decode(ids, PATH).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((k, t or "") for k, t in edges.TEXTS), key=str)
    empty = edges.documents(spark, [])
    assert byte_pairs.round_trip_digests(empty, PATH).count() == byte_pairs.decode(byte_pairs.encode(empty, PATH), PATH).count() == 0


def test_extra_columns_and_null_ids(spark):
    rows = [(1, "a b", "x", 3, "w"), (None, None, None, None, None), (1, "a b", "x", 3, "w")]
    got = byte_pairs.round_trip_digests(spark.createDataFrame(rows, WIDE), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digests(r[0], r[1]) for r in rows), key=str)
    broken = spark.createDataFrame([(1, None), (2, [0, 50256, 99999])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, byte_pairs.decode(broken, PATH).collect())) == [(1, ""), (2, "!<|endoftext|>")]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = byte_pairs.round_trip_digests(docs, PATH).collect()
    assert sorted(map(tuple, got)) == sorted(digests(r.doc_id, r.text) for r in docs.collect())


@pytest.mark.parametrize("change", [
    lambda d: d["model"].update(type="WordPiece"), lambda d: d["model"].update(ignore_merges=True),
    lambda d: d["pre_tokenizer"].update(add_prefix_space=True), lambda d: d.update(normalizer={"type": "Lowercase"}),
    lambda d: d["added_tokens"][0].update(lstrip=True), lambda d: d.update(decoder=None),
])
def test_other_kinds_of_files_are_refused(tmp_path, change):
    data = json.loads(open(PATH, encoding="utf-8").read())
    change(data)
    file = tmp_path / "other.json"
    file.write_text(json.dumps(data))
    with pytest.raises(ValueError):
        byte_pairs.PairMerges(str(file))
