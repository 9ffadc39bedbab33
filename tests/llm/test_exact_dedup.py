import collections
import hashlib
import random

import edges
from webloom.llm import exact_dedup
from webloom.llm.exact_dedup import Patricia


def plain(texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    rows = []
    for i, t in texts:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        rows.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(rows, key=str)


def test_rows(spark):
    got = exact_dedup.exact_duplicates(edges.documents(spark))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(edges.TEXTS)


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(edges.documents(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(edges.documents(spark, [])).count() == 0


def test_one_row_of_each_text_stays(spark):
    docs = edges.documents(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    want = {t or "" for _, t in edges.TEXTS}
    assert sorted(t for _, t in rows) == sorted(want)
    assert (2, edges.TEXTS[0][1]) in rows and (9, "without an id") in rows and (12, "x") in rows and (4, "") in rows


def test_small_tries_spill_and_still_find_all(spark):
    texts = [(i, f"{'ab' * (i % 7)}{i % 50} text") for i in range(600)]
    docs = edges.documents(spark, texts)
    found = exact_dedup.owners(docs, trie_bytes=200).collect()
    want = collections.Counter(t for _, t in texts)
    assert {bytes(r.digest).hex(): r.group_size for r in found} == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in want.items()}


def test_trie_against_a_dictionary():
    random.seed(3)
    trie, want = Patricia(), {}
    for i in range(3000):
        key = "".join(random.choices("ab\n", k=random.randint(0, 9))).encode()
        trie.insert(key, (i, 1, 1))
        want[key] = (i, 1, want.get(key, (0, 0, 0))[2] + 1)
    assert dict(trie.items()) == want
    spilled = []
    while trie.sizes:
        spilled += trie.spill_largest()
    assert dict(spilled) == {k: v for k, v in want.items() if k}
