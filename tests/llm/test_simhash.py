import random
import re

import edges
import numpy as np
import xxhash
from webloom.llm import simhash
from webloom.llm.components import components


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest reachable index of each fingerprint, by comparing all pairs."""
    n = len(prints)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def near_prints(seed, n=120):
    random.seed(seed)
    prints = [random.getrandbits(64) for _ in range(n // 6)]
    while len(prints) < n:
        value = random.choice(prints)
        for bit in random.sample(range(64), random.randint(0, 5)):
            value ^= 1 << bit
        prints.append(value)
    return prints


def test_fingerprints_and_classes_against_all_pairs(spark):
    random.seed(5)
    base = [f"{w}{i}" for i, w in enumerate(["alpha", "beta", "gamma"] * 60)]
    texts = list(edges.TEXTS)
    for i in range(40):
        words = list(base)
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = f"new{i}"
        texts.append((100 + i, " ".join(words)))
    rows = simhash.near_duplicates(edges.documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    prints = [plain_fingerprint(t) for _, t in texts]
    labels = plain_classes(prints)
    least = {}
    for (i, _), label in zip(texts, labels):
        if i is not None:
            least[label] = min(i, least.get(label, i))
    want = sorted(((i, f"{p:016x}", least.get(l)) for (i, _), p, l in zip(texts, prints, labels)), key=str)
    assert sorted(map(tuple, rows), key=str) == want
    assert len({r.component_id for r in rows}) < len({r.fingerprint for r in rows})


def test_links_of_random_fingerprints(spark):
    for seed in (1, 2):
        prints = near_prints(seed)
        table = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints)], "fp long")
        found = {r.node: r.root for r in components(simhash.fingerprint_links(table)).collect()}
        labels = plain_classes(prints)
        signed = [int(np.uint64(p).view(np.int64)) for p in prints]
        for a in range(len(prints)):
            for b in range(a):
                assert (labels[a] == labels[b]) == (found.get(signed[a], signed[a]) == found.get(signed[b], signed[b]))


def test_large_buckets_by_flips_like_pairwise():
    rng = np.random.default_rng(4)
    for number, (low, high) in enumerate(simhash.BLOCKS):
        mask = ((1 << (high - low)) - 1) << low
        centre = int(rng.integers(0, 2**64, dtype=np.uint64)) & ~mask & (2**64 - 1)
        outside = [b for b in range(64) if not mask >> b & 1]
        members = set()
        for _ in range(400):
            inner = sum(1 << int(b) for b in rng.choice(np.arange(low, low + 9), rng.integers(0, 5), replace=False))
            flip = 1 << int(rng.choice(outside[:5])) if rng.random() < 0.7 else 0
            members.add((centre | inner) ^ flip)
        prints = np.sort(np.array(list(members), np.uint64))
        keys = simhash.variants(np.array([centre], np.uint64))[0]
        key = int(next(k for k in keys if int(k) >> 60 == number))
        assert (simhash.linked_by_flips(prints, key) == simhash.linked_pairwise(prints)).all()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_a_hub_is_split(spark):
    """A node with a third of all links: the join with the smallest neighbours is split by measured size."""
    from webloom.llm.components import _smallest

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        links = spark.range(200_000).selectExpr("if(id % 3 = 0, 7L, id) a", "id + 1000000 b").repartition(16)
        joined = _smallest(links)
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plain_survivors(texts):
    """Of each class the row with the smallest id (rows without one last), of its texts any one row."""
    labels = plain_classes([plain_fingerprint(t) for _, t in texts])
    best = {}
    for (i, _), label in zip(texts, labels):
        best[label] = min(best.get(label, (True, 0)), (i is None, i or 0))
    return {label: (None if none else i) for label, (none, i) in best.items()}, labels


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(8)
    texts = list(edges.TEXTS) + [(40, "same id, other text one"), (40, "and quite another thing here"), (None, "no id at all anywhere"), (None, "no id at all anywhere")]
    for group in range(6):
        base = [f"g{group}w{rng.randrange(120)}" for _ in range(200)]
        for i in range(10):
            words = list(base)
            words[rng.randrange(200)] = f"edit{i}"
            texts.append((1000 + 50 * group + i, " ".join(words)))
    docs = edges.documents(spark, texts)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    survivors, labels = plain_survivors(texts)
    assert sorted((i for i, _ in rows), key=str) == sorted(survivors.values(), key=str)
    label_of = {(i, t): label for (i, t), label in zip(texts, labels)}
    assert sorted(label_of[row] for row in rows) == sorted(survivors)
    assert len(rows) < len(texts) - 30


def test_empty_tables(spark):
    empty = edges.documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_whole_table_drops_all_but_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    survivors, _ = plain_survivors(texts)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(survivors.values())
    assert len(survivors) < len(texts)


def test_a_bucket_over_many_batches():
    """Keys that go on over several batches are verified as one bucket."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 6, 400)).astype(np.uint64)
    prints = rng.integers(0, 64, 400).astype(np.uint64)
    want = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in simhash.bucket_links(keys, prints)))}
    for size in (1, 7, 100, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i:i + size].view(np.int64)) for x in (keys, prints)], ["bucket", "fp"])
                   for i in range(0, 400, size)]
        got = {tuple(sorted(map(int, r.values()))) for b in simhash._verify(iter(batches)) for r in b.to_pylist()}
        assert got == want
