"""Whitening, lexical search and license scans at unit level."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import bloom, licenses, search, whitening

# ---- whitening -----------------------------------------------------------------------------


def spread(spark, n=900, d=6, parts=1, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * np.array([1e3, 1, 1, 1e-1, 10, 1])[:d]
    rows = [(k, v.tolist(), "more") for k, v in enumerate(c)]
    return c, spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 40])
def test_tsqr_gives_the_covariances_eigenvectors(spark, parts):
    c, df = spread(spark, parts=parts)
    whole = np.floor(c.astype(np.float32).astype(float) * whitening.SCALE) + whitening.SHIFT
    x = whitening.usable(df)
    model = whitening.fit_whitening(x)
    assert model.n == 900 and model.sums == tuple(int(s) for s in whole.sum(0))
    e, v = np.linalg.eigh(np.cov(whole.T, bias=True))
    assert np.allclose(model.eigenvalues, e[::-1], rtol=1e-9) and np.allclose(np.abs((model.vectors * v[:, ::-1]).sum(0)), 1, atol=1e-7)
    assert whitening.identity_error(x, model) < 1e-9
    w = np.array([r.whitened for r in whitening.whiten(x, model).collect()])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(6)).max() < 1e-9


def test_small_and_degenerate_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert len(whitening.fit_whitening(whitening.usable(one)).eigenvalues) == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert len(whitening.fit_whitening(whitening.usable(same)).eigenvalues) == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")
    x = whitening.usable(line)
    model = whitening.fit_whitening(x)
    assert len(model.eigenvalues) == 1 and whitening.identity_error(x, model) < 1e-9
    assert whitening.fit_whitening(whitening.usable(one.where("false"))) is None


def test_deviations_stay_exact():
    big = np.array([[2**61, 0], [-(2**61), 1]], np.int64)
    dev = whitening.scaled_deviations(big, 2, (0, 1))
    assert dev.tolist() == [[2**62, -1], [-(2**62), 1]] and whitening.squared_length(dev) == [None, None]
    small = np.array([[3, 4], [5, 6]], np.int64)
    assert whitening.squared_length(whitening.scaled_deviations(small, 2, (8, 10))) == [8, 8]


# ---- filter --------------------------------------------------------------------------------


def test_a_filter_holds_all_of_its_ids(spark):
    ids = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    words = bloom.build(spark.createDataFrame([(int(i),) for i in [*ids[:1000], *ids[:10]]] + [(None,)], "fp long").repartition(3), 1010)
    assert len(words) == 256 and bloom.holds(words, ids[:1000]).all() and bloom.holds(words, ids[1000:]).mean() < 0.02
    none = bloom.build(spark.createDataFrame([], "fp long"), 0)
    assert not bloom.holds(none, ids).any() and bloom.holds(words, ids[:0]).shape == (0,)


# ---- lexical search ------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**40), max_size=60))
def test_packed_numbers_come_back(values):
    data, sizes = search.pack_numbers(np.array(values, np.int64))
    assert search.unpack_numbers(data.tobytes()).tolist() == values and int(sizes.sum()) == len(data)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 9), min_size=1), max_size=8), st.integers(1, 6))
def test_merge_finds_the_best(lists, k):
    total = {}
    for own in lists:
        for place, score in own.items():
            total[place] = total.get(place, 0) + score
    want = sorted(((s, p) for p, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    given_lists = []
    for own in lists:
        places = sorted(own)
        scores = [own[p] for p in places]
        kth = sorted(scores)[-k] if len(scores) >= k else 0
        given_lists.append((places, scores, max(scores), kth))
    assert search.top_k(given_lists, k) == want


def test_spans_cut_no_term(monkeypatch):
    monkeypatch.setattr(search, "SPAN", 5)
    text = "aé bcdefghij,k lmno pqrs".encode()
    parts = list(search._spans(text))
    assert b"".join(parts) == text and len(parts) > 2
    assert [t for p in parts for t in search.TERM.findall(p)] == search.TERM.findall(text)


def test_shards_and_blocks_change_nothing(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    one = rows(search.search(search.build_index(docs.coalesce(1)), items))
    assert one
    monkeypatch.setattr(search, "BLOCK_PAIRS", 600)
    many = search.build_index(docs.repartition(7))
    assert many.select("shard").distinct().count() == 7
    assert rows(search.search(many, items)) == one


# ---- license scans -------------------------------------------------------------------------


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def labels(df):
    return {r.doc_id: r.labels for r in df.collect()}


def test_notices_are_found_wherever_they_lie(spark):
    filler = "lorem ipsum dolor sit amet consectetur "
    bsd = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    cut = bsd.replace("binary", "object")  # one word of eighteen is another
    got = labels(licenses.license_labels(texts(spark, filler * 40 + bsd.upper() + ". " + filler * 40, cut, filler * 500, bsd.replace("binary", "x").replace("source", "y").replace("forms", "z"), None, "")))
    assert got == {0: "bsd", 1: "bsd", 2: "", 3: "", 4: "", 5: ""}


def test_blocks_tell_where(spark):
    filler = "word " * 100
    rows = licenses.license_blocks(texts(spark, filler + "Released under the MIT license")).collect()
    assert {(r.label, r.containment) for r in rows} == {("mit", 1.0)} and {(r.first_word, r.n_words) for r in rows} == {(96, 16)}


def test_the_join_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)]
    templates = tuple((f"l{k}", " ".join(rng.choice(words, int(rng.integers(1, 9) if k % 2 else rng.integers(10, 34))))) for k in range(40))
    docs = [" ".join(rng.choice(words, int(n), p=np.arange(30, 0, -1) / 465)) for n in rng.integers(0, 200, 30)]
    for threshold in (0.5, 0.8, 1.0):
        want = set()
        for d, text in enumerate(docs):
            own = text.split()
            for t, (_, template) in enumerate(templates):
                size, step = licenses.SIZES[0 if len(template.split()) <= 9 else 1]
                for b in range(max(0, -(-(len(own) - size) // step)) + 1):
                    shared = len(set(own[b * step : b * step + size]) & set(template.split()))
                    if shared >= threshold * len(set(template.split())) - 1e-9:
                        want.add((d, b * step, t, shared))
        got = [(r.doc_id, r.first_word, r.template, r.overlap) for r in licenses.license_blocks(texts(spark, *docs), templates, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_more_labels_than_bits_of_a_long(spark):
    templates = tuple((f"l{k:03d}", f"w{k} v{k}") for k in range(150))
    text = " ".join(f"w{k} v{k}" for k in (0, 62, 63, 125, 126, 149))
    assert labels(licenses.license_labels(texts(spark, text), templates=templates)) == {0: "l000,l062,l063,l125,l126,l149"}


def test_phrases_stand_consecutively(spark):
    row = licenses.license_labels(texts(spark, "CC-BY, cc\nby; all rights, reserved. all rights ! all rights reserved cc")).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.score) == (13, 4, 0, 9, "cc-by,reserved", 1.0)


def test_templates_and_thresholds_are_checked(spark):
    for bad in ((("x", ""),), (("x", " ".join(["w"] * 34)),), (("x", "a b c"),) * 7000):
        with pytest.raises(ValueError):
            licenses.license_labels(texts(spark, "a"), templates=bad)
    with pytest.raises(ValueError):
        licenses.license_labels(texts(spark, "a"), threshold=0.0)


def test_scans_run_no_python(spark, sf_dir):
    from touchline.llm.queries import QUERIES

    plan = QUERIES["op13_licenses"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan) and "BroadcastHashJoin" in plan
