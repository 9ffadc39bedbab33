import math

import edges
import numpy as np
import pytest
from check import compare
from webloom.llm import chat, neighbours
from webloom.llm.queries import CHECKS, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    outcome = compare(spark, SMALL, QUERIES[name], CHECKS.get(name))
    assert outcome.startswith("ok" if name in CHECKS else "rows only"), outcome
    assert not outcome.endswith(" 0")


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)  # the built-in sum would round otherwise
    return math.sqrt(total)


def plain_neighbours(vectors, asked, k):
    good = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    rows = []
    for q, v in good:
        if q not in asked:
            continue
        near = sorted((distance(v, w), i) for i, w in good if i != q and len(w) == len(v))
        rows += [(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(rows)


@pytest.mark.parametrize("group_rows", [7, 1000])
def test_neighbours_against_all_pairs(spark, group_rows):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    vectors += [(i, vectors[3][1]) for i in range(120, 140)]  # ties
    vectors += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("nan")] * 8),
                (205, [float("inf")] + [0.0] * 7), (206, [1.0, 2.0]), (207, [3.0, 4.0]), (None, vectors[5][1]), (208, [1e-30] * 8), (209, [1e30] * 8)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    asked = {0, 3, 10, 125, 202, 203, 206, 208, 209}
    queries = table.where(table.vec_id.isin(*asked))
    got = sorted(map(tuple, neighbours.nearest(queries, table, 10, group_rows=group_rows).collect()))
    assert got == plain_neighbours(vectors, asked, 10)


def exact_distance(a, b):
    from decimal import Decimal, localcontext

    with localcontext() as context:
        context.prec, context.Emax, context.Emin = 60, 9999, -9999
        return float(sum((Decimal(x) - Decimal(y)) ** 2 for x, y in zip(a, b)).sqrt())


@pytest.mark.parametrize("group_rows", [3, 1000])
def test_neighbours_of_any_size(spark, group_rows):
    """Huge and denormal components: squares overflow or vanish, no pair is lost."""
    rows = [[1e200, 0, 0], [1e200, 0, 0], [1e200, 1e199, 0], [-1e308, 5e307, 1], [1e-320, 0, 0], [2e-320, 1e-321, 0], [1e-160, 1e-170, 0], [1e-160, 0, 3e-165],
            [1, 1, 1], [1, 1, 2], [1e16, 1, 1], [1e16, 1, 2], [1e154, 1e154, 1e154], [1e101, 1, 1], [1e101, 2, 1], [1e99, 1, 1], [3e-101, 1e-102, 0]]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(map(tuple, neighbours.nearest(table, table, 4, group_rows=group_rows).collect()))
    assert len(got) == 4 * len(rows)
    want = []
    for q, v in vectors:
        near = sorted((exact_distance(v, w), i) for i, w in vectors if i != q)
        want += [(q, r, d) for r, (d, _) in enumerate(near[:4], 1)]
    for g, w in zip(got, sorted(want)):
        assert g[:2] == w[:2] and g[3] == pytest.approx(w[2], rel=1e-14)
        assert g[3] == pytest.approx(exact_distance(rows[g[0]], rows[g[2]]), rel=1e-14, abs=5e-324)


def test_neighbours_of_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(empty, empty).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (2, 0, None, "who am I"),
    (2, 1, "bob", ""), (3, 0, "system", "alone"), (None, 0, "ann", "lost"), (4, None, "ann", "first"), (4, 5, "bob", "x"), (4, 5, "bob", "x"),
]


def plain_perspectives(turns):
    rows, key = [], lambda x: (x is not None, x if x is not None else 0)
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (key(t[1]), (t[2] is not None, t[2] or ""), (t[3] is not None, t[3] or "")))
        for person in {t[2] or "unknown" for t in own} - {"system"}:
            at = 0
            for position, (_, turn, role, text) in enumerate(own, 1):
                speaker = role or "unknown"
                kind = "system" if speaker == "system" else "assistant" if speaker == person else "user"
                name = speaker if kind == "user" else None
                head = f"<|{kind}{f' name={name}' if name else ''}|>\n"
                segment = f"{head}{text or ''}<|end|>\n"
                mask = (at + len(head), at + len(segment) - 1) if kind == "assistant" else (None, None)
                rows.append((conv, person, position, turn, kind, name, segment, at, at + len(segment), *mask))
                at += len(segment)
    return sorted(rows, key=str)


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_perspectives(spark, block):
    table = spark.createDataFrame([(*t, "extra", 1) for t in TURNS], "conv_id long, turn long, role string, text string, perspective string, position int")
    got = chat.perspectives(table, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == plain_perspectives(TURNS)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.perspectives(table.limit(0)).count() == 0


def test_pipeline_stages_against_their_rules(spark):
    """Every stage against a plain version of its rule, on what its predecessor kept."""
    import corpus_pipeline as pipeline
    from test_models import plain_draws, plain_score
    from test_simhash import plain_survivors
    from test_tokens import check_packing
    from webloom.llm import toxicity
    from webloom.session import materialize

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flags = [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None]

    def good(docs, rows):
        drawn, least = plain_draws(spark, docs, rows, flags)
        return {r[0] for r in drawn if r[3] >= least - 1e-9}

    def clean(docs, rows):
        model = toxicity.fit(docs, labels)
        return {i for i, t in rows if plain_score(model, t) < 0.5}

    def once(docs, rows):
        return {max(i for i, t in rows if t == text) for text in {t for _, t in rows}}

    def nearly_once(docs, rows):
        return set(plain_survivors(rows)[0].values())

    columns = docs.columns
    for (name, stage), rule in zip(pipeline.STAGES, [good, clean, once, nearly_once]):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        kept = materialize(stage(spark, docs, SMALL), "test-stage")
        assert kept.columns == columns, name
        assert sorted(r.doc_id for r in kept.collect()) == sorted(rule(docs, rows)), name
        docs = kept
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in docs.collect()])
    assert pipeline.run(spark, SMALL).count() == len(packed)


def test_pipeline_on_odd_tables(spark):
    """Repeated, tied, null and empty rows, extra columns; and no rows at all."""
    import corpus_pipeline as pipeline

    for docs in (edges.documents(spark), edges.documents(spark, [])):
        columns, n = docs.columns, docs.count()
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == columns
        assert docs.count() == len({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}) and (n == 0 or docs.count() > 3)
        assert (pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0) == (n == 0)
