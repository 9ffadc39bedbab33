import math
import zlib
from collections import Counter

import edges
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from webloom.llm import lattice, quality, toxicity
from webloom.llm.queries import remainder
from webloom.llm.toxicity import Lexicon, Trie

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False


def tokens(text):
    import re

    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute_spelling(word, pieces, index, weights):
    marked = "▁" + word
    reach = [0.0] * (len(marked) + 1)
    reach[0] = 1.0
    for i in range(len(marked)):
        go_on = 1.0 if i == 0 else 1 - weights.stop
        for j in range(i + 1, min(len(marked), i + 40) + 1):
            piece = marked[i:j]
            if piece in index and (piece[0] == "▁") == (i == 0):
                reach[j] += reach[i] * go_on * weights.pieces[index[piece]]
        if marked[i] not in index or i and marked[i] == "▁":
            raw = marked[i].encode()
            p = np.prod([weights.pieces[pieces.byte_of[b]] for b in raw]) * (1 - weights.stop) ** (len(raw) - 1)
            reach[i + 1] += reach[i] * go_on * p
    return reach[-1] * weights.stop


@pytest.fixture(scope="module")
def vocabulary():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    usable = [p.piece for p in model.pieces if p.type == 1 and "▁" not in p.piece[1:]]
    return lattice.pieces_of(PIECES), {p: i for i, p in enumerate(usable)}


def test_lattice_against_all_segmentations(vocabulary):
    pieces, index = vocabulary
    weights = lattice.Weights(pieces.start, 0.4)
    words = ["the", "a", "", "thention", "é", "中文", "😀a", "zzzzq", "hello,", "\x00", "x" * 60, "▁▁", "a▁b"]
    found = lattice.Lattice(words, pieces).log_probabilities(weights)
    assert np.allclose(found, [math.log(brute_spelling(w, pieces, index, weights)) for w in words])
    assert math.isclose(weights.pieces[pieces.first].sum(), 1) and math.isclose(weights.pieces[~pieces.first].sum(), 1)


def test_scores_against_plain_counts(spark, vocabulary):
    pieces, index = vocabulary
    docs = edges.documents(spark, [t for t in edges.TEXTS if t[0] != 10])
    rows = lattice.score_texts(docs, remainder(7) == 2, PIECES, rounds=0).collect()
    texts = [t for t in edges.TEXTS if t[0] != 10]
    counts, n_texts = Counter(), 0
    for i, t in texts:
        if not held(i):
            counts.update(tokens(t))
            n_texts += 1
    total, distinct = sum(counts.values()) + n_texts, len(counts) + 1
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    weights = lattice.Weights(pieces.start, lattice.STOP)

    def mixed(c, p):
        return math.log10((max(c - discount, 0) + discount * distinct * p) / total)

    want = []
    cache = {}
    for i, t in texts:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws) + math.log10((n_texts + 1) / (total + distinct + 1))
        for w in set(ws):
            if w not in cache:
                cache[w] = mixed(counts[w], (1 - lattice.END) * brute_spelling(w, pieces, index, weights))
        score = sum(cache[w] for w in ws) + mixed(n_texts, lattice.END)
        want.append((i, held(i), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total, base, score))
    got = sorted(map(tuple, rows), key=str)
    want.sort(key=str)
    order = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_scores_without_rows_or_training(spark):
    assert lattice.score_texts(edges.documents(spark, []), remainder(7) == 2, PIECES).count() == 0
    row = lattice.score_texts(edges.documents(spark, [(1, "some words")]), F.lit(True), PIECES).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and row.score < 0


def edit_distance(a, b):
    """With swapped neighbours as one edit."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def allowed(term):
    return int(toxicity.edits_allowed(np.array(len(term))))


def test_automata_against_edit_distance():
    rng = np.random.default_rng(2)
    terms = ["".join(rng.choice(list("abc"), rng.integers(2, 12))) for _ in range(40)]
    trie = Trie(terms)
    for _ in range(600):
        word = "".join(rng.choice(list("abc"), rng.integers(1, 13)))
        assert set(trie.near(word)) == {t for t in terms if edit_distance(word, t) <= allowed(t)}


def test_no_misspelling_is_passed_over():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    terms = tuple({"".join(rng.choice(list("abcdeé"), rng.integers(3, 11))) for _ in range(30)})
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(0, 12))) for _ in range(300)]
    for term in terms:
        at = rng.integers(len(term) - 1)
        words += [term[:at] + "x" + term[at + 1:], term[:at] + term[at + 1:], term[:at] + term[at + 1] + term[at] + term[at + 2:], term[:at] + "y" + term[at:]]
    strict, innocent = terms[:5], tuple(words[300:310])
    found = Lexicon(terms, (), strict, innocent).kinds(pa.array(words))
    for word, kind in zip(words, found):
        near = word not in innocent and any(edit_distance(word, t) <= allowed(t) for t in terms if t not in strict)
        assert kind == (1 if word in terms else 2 if near else 0)


def plain_score(model, text):
    """The score of a text by hand: every word against every term, every hit's window word by word."""
    import regex

    lexicon, words = model.lexicon, [w for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if w]
    bare = [regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w).lower() for w in words]

    def kind(word):
        if word in lexicon.terms:
            return 0
        if any(word.startswith(s) and word != s for s in lexicon.stems):
            return 2
        near = (t for t in lexicon.terms if t not in lexicon.strict and abs(len(t) - len(word)) <= 2 and edit_distance(word, t) <= allowed(t))
        return 1 if word not in lexicon.innocent and any(near) else None

    kinds, counts = {w: kind(w) for w in set(bare)}, np.zeros((2, 3))
    for i, word in enumerate(bare):
        if kinds[word] is not None:
            low, high = max(0, i - toxicity.WINDOW), min(len(words), i + toxicity.WINDOW + 1)
            quoted = (any(regex.search(toxicity.OPENING, w) for w in words[low:i + 1]) and any(regex.search(toxicity.CLOSING, w) for w in words[i:high])
                      or any(w in toxicity.REPORTING for w in bare[low:i]))
            counts[int(quoted), kinds[word]] += 1
    features = [*np.log1p(counts.ravel()), counts[0].sum() > 0, counts[1].sum() > 0]
    return 1 / (1 + math.exp(-(np.dot(features, model.weights) + model.bias)))


def labelled_texts(spark, texts):
    """Documents 0, 1, ... with these (text, toxic)."""
    docs = edges.documents(spark, [(i, t) for i, (t, _) in enumerate(texts)])
    return docs, spark.createDataFrame([(i, toxic) for i, (_, toxic) in enumerate(texts)], "doc_id long, toxic int")


def invented(rng, n):
    return ["".join(rng.choice(list("bdfgklmnprstaeiou"), rng.integers(6, 10))) for _ in range(n)]


def toxic_world(seed=5):
    """Clean texts of common words; toxic ones hold an insult, or one that is also quoted in clean ones."""
    rng = np.random.default_rng(seed)
    common = invented(rng, 300)
    texts = [(" ".join(rng.choice(common, 30)), 0) for _ in range(400)]
    for _ in range(60):
        words = list(rng.choice(common, 30))
        words[rng.integers(30)] = ["scoundrel", "nitwit", "scum"][rng.integers(3)]
        texts.append((" ".join(words), 1))
    return rng, common, texts


def test_misspellings_alone_decide(spark):
    rng, common, texts = toxic_world()
    model = toxicity.fit(*labelled_texts(spark, texts))
    assert {"scoundrel", "nitwit", "scum"} <= set(model.lexicon.terms)
    base = " ".join(common[:20])
    tried = ["scoundrel", "scuondrel", "scoundel", "skoundrell", "nitwit", "nitwti", "nittwit", "mitwit", "scvm", "scm", "skum", "SCUM!"]
    clean = ["", "friend", "scoundrels' apprentice"[:2], "twit", "sum", "nit wit", common[25]]
    rows = [(i, f"{base} {w} {base}") for i, w in enumerate(tried + clean)]
    got = {r.doc_id: r for r in toxicity.score_texts(edges.documents(spark, rows), model).collect()}
    assert [got[i].predicted for i in range(len(tried))] == [1] * len(tried)
    wrong = [w for i, w in enumerate(clean, len(tried)) if got[i].predicted and w not in ("sum",)]
    assert not wrong  # "sum" is one edit from "scum", and no clean text shows it
    exact, misspelled = got[0].score, got[1].score
    assert exact >= misspelled


def test_words_of_clean_texts_are_no_misspellings(spark):
    rng, common, texts = toxic_world()
    texts = [(t + (" slum sculm" if i % 7 == 0 and not y else ""), y) for i, (t, y) in enumerate(texts)]
    model = toxicity.fit(*labelled_texts(spark, texts))
    assert "scum" in model.lexicon.terms and "scum" in model.lexicon.strict and "sculm" in model.lexicon.innocent
    rows = [(0, "a sculm of " + common[3]), (1, "scum of " + common[3]), (2, "scrum " + common[4])]
    assert [r.predicted for r in toxicity.score_texts(edges.documents(spark, rows), model).orderBy("doc_id").collect()] == [0, 1, 0]


def test_scores_against_a_plain_version(spark):
    rng, common, texts = toxic_world()
    model = toxicity.fit(*labelled_texts(spark, texts))
    base = " ".join(common[:7])
    extra = [f"{base} {w} {base}" for w in ("nitwit", '"nitwit"', "«nitwti»", "he said scuondrel", "(SCUM)", "scums", "scoundre1", "x")]
    rows = [(i, t) for i, t in enumerate(extra + [t for t, _ in texts[-60:]] + [t for _, t in edges.TEXTS if t != edges.LONG])]
    got = {r.doc_id: r.score for r in toxicity.score_texts(edges.documents(spark, rows), model).collect()}
    assert all(got[i] == pytest.approx(plain_score(model, t), abs=1e-9) for i, t in rows)
    assert len({round(s, 6) for s in got.values()}) >= 4


def test_one_text_is_one_proof(spark):
    """A long toxic text that repeats a rare word, and near copies of one, make no term."""
    rng, common, texts = toxic_world()
    texts.append((" ".join(f"harmless {w}" for w in common), 1))
    base = list(rng.choice(common, 40))
    for i in range(30):
        words = list(base)
        words[i] = f"edit{i}"
        texts.append((" ".join(words[:20] + ["blameless"] + words[20:]) if abs(i - 20) > 1 else " ".join(words), 1))
    lexicon = toxicity.fit(*labelled_texts(spark, texts)).lexicon
    assert "scum" in lexicon.terms and "harmless" not in lexicon.terms and "blameless" not in lexicon.terms


def test_lexicon_has_no_cap(spark):
    rng, common, texts = toxic_world()
    insults = [w + "zz" for w in invented(np.random.default_rng(9), 1200)]
    texts = texts[:400] + [(" ".join([*rng.permutation(insults), *rng.choice(common, 5)]), 1) for _ in range(40)]
    lexicon = toxicity.fit(*labelled_texts(spark, texts)).lexicon
    assert set(insults) <= {w for w in insults if w in lexicon.terms or w.startswith(lexicon.stems)}


def test_quotation_is_told_from_abuse(spark):
    rng, common, texts = toxic_world()
    for i in range(80):
        words = list(rng.choice(common, 30))
        words[10:10] = ["he", "said", '"', "nitwit", '"'] if i % 2 else ["wrote", "nitwit"]
        texts.append((" ".join(words), 0))
    # As many different insults as before keep the term pure: quoted uses are a fifth of all.
    for _ in range(800):
        words = list(rng.choice(common, 30))
        words[rng.integers(30)] = "nitwit"
        texts.append((" ".join(words), 1))
    model = toxicity.fit(*labelled_texts(spark, texts))
    base = " ".join(common[:9])
    rows = [(0, f"{base} nitwit {base}"), (1, f"{base} he said nitwit {base}"), (2, f'{base} "nitwit" {base}')]
    got = {r.doc_id: r.score for r in toxicity.score_texts(edges.documents(spark, rows), model).collect()}
    assert got[0] >= 0.5 > max(got[1], got[2])


@pytest.mark.parametrize("rows", [3, 10])
def test_samples_are_bounded_by_rows(spark, rows):
    from webloom.llm.labelled import labelled_sample

    docs = edges.documents(spark, [(1, "equal")] * 3000 + [(1, f"text {i}") for i in range(500)] + [(2, None), (None, "x"), (3, "three")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", rows=rows).collect()
    assert len(got) == rows and all(r.label == 1 for r in got) and len({r.text for r in got}) == rows
    everything = labelled_sample(docs, labels, "toxic").collect()
    assert len(everything) == 502 and sorted(r.text for r in everything).count("equal") == 1


def test_kinds_of_hits_and_quotation():
    import pyarrow as pa

    lexicon = Lexicon(("moron", "idiot"), ("grub",))
    f = lexicon.features(pa.array(["you moron", "you morron!", "grubby and Grubling", "he said idiot", "a \"moron\" it was", "clean", ""]))
    hits = (np.expm1(f[:, :6])).round(6)
    assert hits.tolist() == [[1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0], [0, 0, 2, 0, 0, 0], [0, 0, 0, 1, 0, 0], [0, 0, 0, 1, 0, 0], [0] * 6, [0] * 6]


def test_hits_that_labels_never_show_keep_their_prior():
    features = np.zeros((400, 8))
    features[:200, [0, 6]] = 1.0  # exact hits only
    weights, bias = toxicity.fit_logistic(features, np.r_[np.ones(200), np.zeros(200)], toxicity.PRIOR_WEIGHTS)
    assert weights[1] == pytest.approx(3.0) and weights[1] * math.log(2) + weights[6] + bias > 0 > bias


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, remainder(5, "_id") != 0)
    rows = toxicity.score_texts(docs.where(remainder(5) == 0), model).join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.8 * sum(r.toxic for r in rows) and hits >= 0.95 * sum(r.predicted for r in rows)
    one = edges.documents(spark, [(2, "you are an idiot, really"), (3, "you are a friend")])
    assert [r.predicted for r in toxicity.score_texts(one, model).orderBy("doc_id").collect()] == [1, 0]
    got = toxicity.score_texts(edges.documents(spark), model).collect()
    assert len(got) == len(edges.TEXTS) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(edges.documents(spark), model)
    assert kept.columns == edges.documents(spark).columns and kept.count() == len(edges.TEXTS)


def test_models_without_labels(spark):
    none = edges.labels(spark, [])
    docs = edges.documents(spark)
    model = toxicity.fit(docs, none)
    assert toxicity.drop_toxic(docs, model).count() == len(edges.TEXTS)
    assert quality.select_good(docs, none).where("kept").count() == len(edges.TEXTS)
    assert quality.select_good(edges.documents(spark, []), none).count() == 0
    assert toxicity.score_texts(edges.documents(spark, []), model).count() == 0


def test_quality_separates_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.select_good(docs, labels)
    assert rows.count() == docs.count()
    table = rows.join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in table}
    assert count.get((1, False), 0) <= 0.02 * count[1, True] and count.get((0, True), 0) <= 0.1 * count[0, False]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows.where("kept").collect()}


def plain_grams(text):
    """Buckets of the n-grams of a text: words, pairs of words, pairs of whole word shapes with a mark for repetition."""
    import regex

    def shape(word):
        for pattern, letter in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{M}]+", "a"), (r"\p{N}+", "0")):
            word = regex.sub(pattern, letter, word)
        return word

    def number(word):
        return int(quality.hashes(pa.array([word]))[0]) >> 24

    def bucket(value, bits):
        return (value * 0x9E3779B97F4A7C15 % 2**64) >> 64 - bits

    import pyarrow as pa

    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if w]
    code, form = [number(w) for w in words], [number(shape(w)) for w in words]
    found = [bucket(c + 1, 16) for c in code]
    for i in range(len(words) - 1):
        found.append(bucket((code[i] * 31 + (code[i + 1] << 20)) % 2**64, 16))
        found.append(2**16 + bucket((form[i] * 31 + (form[i + 1] << 20) + (words[i] == words[i + 1])) % 2**64, 13))
    return found


def plain_draws(spark, docs, texts, flags):
    """``[doc_id, n_grams, log_weight, draw]`` of each text, and the smallest draw that is kept."""
    label = dict(flags)
    grams = [plain_grams(t) for _, t in texts]
    size = 2**16 + 2**13
    raw, target = np.zeros(size), np.zeros(size)
    sampled = {}
    for (i, t), own in zip(texts, grams):
        np.add.at(raw, own, 1)
        if i in label:
            sampled[i, t or ""] = (own, label[i])
    for own, y in sampled.values():
        if y:
            np.add.at(target, own, 1)
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * size)
    ratios = np.log((target + 2.0 * size * p_raw) / (target.sum() + 2.0 * size) / p_raw)
    means = sorted(((ratios[own].sum() / max(len(own), 1), y) for own, y in sampled.values()))
    n_good, n_bad = sum(y for _, y in means), sum(1 - y for _, y in means)
    gains = [(sum(1 - y for _, y in means[:c]) / n_bad + sum(y for _, y in means[c:]) / n_good, c) for c in range(len(means) + 1)]
    best = max(g for g, _ in gains)
    at = max(c for g, c in gains if g >= best - 1e-12)
    cut = (means[at - 1][0] + means[at][0]) / 2
    noise = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "shiftrightunsigned(xxhash64(0, doc_id), 11) h").collect()}
    rows = []
    for (i, _), own in zip(texts, grams):
        weight = (ratios[own] - cut).sum()
        rows.append([i, len(own), weight, weight - math.log(-math.log((noise[i] + 0.5) / 2**53))])
    k = sum(r[2] >= 0 for r in rows)
    return rows, sorted((r[3] for r in rows), reverse=True)[k - 1]


@pytest.mark.parametrize("scale", ["edges", "sf0.001"])
def test_draws_and_kept_rows_against_a_plain_version(spark, scale):
    """Both models, the cut, the noise, the k-th largest draw and the rows kept, counted by hand."""
    if scale == "edges":
        good = "A1b2C3d4E5f6 calm words and a long WORD1word2WORD3word4 stay"
        texts = edges.TEXTS + [(100 + i, f"{good} {i % 7}") for i in range(20)] + [(200 + i, "junk junk $$$ !!! junk") for i in range(20)]
        docs, flags = edges.documents(spark, texts), [(100 + i, 1) for i in range(15)] + [(200 + i, 0) for i in range(15)]
        labels = spark.createDataFrame(flags, "doc_id long, quality int")
    else:
        docs, labels = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
        texts, flags = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None]
    rows, least = plain_draws(spark, docs, texts, flags)
    got = sorted((r.doc_id, r.n_grams, r.log_weight, r.draw, r.kept) for r in quality.select_good(docs, labels).collect() if r.doc_id is not None)
    want = sorted((*r, r[3] >= least - 1e-9) for r in rows if r[0] is not None)
    assert len(got) == len(want) and 0 < sum(w[4] for w in want) < len(rows)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:4], abs=1e-7) and g[4] == w[4]


def test_shapes_are_whole():
    import pyarrow as pa

    assert quality.shapes(pa.array(["aB1-" * 40, "Ab", ""])).to_pylist() == ["aA0-" * 40, "Aa", ""]


def test_kth_largest_of_neighbouring_doubles(spark):
    values = [1.0] * 50 + [math.nextafter(1.0, 2)] * 30 + [math.nextafter(1.0, 0)] * 40
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 30, 31, 80, 81, 120):
        assert quality.kth_largest(table, "v", k) == sorted(values, reverse=True)[k - 1]


def test_grams_against_plain_counts(spark):
    counts = quality.bucket_counts(edges.documents(spark).select("text"))
    n = [len(tokens(t)) for _, t in edges.TEXTS]
    assert counts.sum() == sum(3 * k - 2 for k in n if k) and counts[:quality.WORD_BUCKETS].sum() == sum(2 * k - 1 for k in n if k)


@pytest.mark.parametrize("k", [1, 5, 250, 999, 1000])
def test_kth_largest(spark, k):
    values = [((i * 7919) % 1000) ** 2 / 7 for i in range(1000)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    least = quality.kth_largest(table, "v", k, bins=8)
    assert sum(v >= least for v in values) == k
    assert quality.kth_largest(spark.createDataFrame([(2.0,)] * 9, "v double"), "v", 4) == 2.0
