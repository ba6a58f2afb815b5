"""The corpus pipeline, stage by stage, against brute force; on the given documents and on awkward ones."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from touchline.llm import encoding, mixing, pii

from .test_models_and_joins import five_words
from .test_queries import slow_schedule
from .test_text_ops import slow_counts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(30):
        words = [word() for _ in range(r.choice([60, 90, 200]))]
        for copy in range(r.choice([1, 1, 2, 5])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1])):
                own[r.randrange(len(own))] = word()
            text = " ".join(own) + f" call +44 20 7946 {1000 + k}, mail a{k}@x.org token=" + "ab3" * r.choice([3, 200])
            rows.append((100 * k + copy if r.random() < 0.9 else None, text, r.choice(["en", "de", None]), r.choice(["hot", "hot", "hot", "b", None]), len(text)))
    rows += rows[:4]  # repeated rows
    rows += [(9001, None, "en", "hot", None), (9002, "", None, None, 0), (9003, "few words", "en", "b", 9), (9004, "the same " * 4000, "en", "hot", 36000), (9005, " ".join(map(str, range(6000))), "xx", "b", 1)]
    return rows


@pytest.fixture(scope="module", params=["given", "awkward"])
def stages(request, spark, sf_dir, tmp_path_factory):
    """(rows before, rows after) of every stage, each written and read as the pipeline does."""
    if request.param == "given":
        folder = sf_dir
    else:
        folder = str(tmp_path_factory.mktemp("awkward"))
        extra = ["__counts", "__fp", "schedule", "hash", "label"]
        df = spark.createDataFrame(awkward(), COLUMNS)
        df.selectExpr("*", *[f"doc_id as `{c}`" for c in extra]).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(100, 1, 0), (None, 0, 0), (200, None, 1), (100, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
        out[name] = (before, docs.collect())
        if name == "pfair_mixing":  # files are read again in an order of their own
            out["in order"] = stage(spark, spark.createDataFrame(before, docs.schema), folder).collect()
    return folder, out


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_quality_stage(stages):
    before, after = stages[1]["quality_rules"]
    want = []
    for r in before:
        n, _, _, _, repeats = slow_counts(r.text)
        if n >= 50 and 100 * repeats <= 50 * n:
            want.append(r)
    assert bag(after) == bag(want)  # so few labels show no cutoff to be safe


def test_near_dedup_stage(stages):
    before, after = stages[1]["simhash_near_dedup"]
    sets, label = [five_words(r.text) for r in before], list(range(len(before)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and (a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    groups = defaultdict(list)
    for r, k in zip(before, label):
        groups[k].append(r)
    assert len(after) == len(groups) < len(before)
    of = {tuple(r): k for r, k in zip(before, label)}
    kept = Counter(of[tuple(r)] for r in after)
    assert set(kept.values()) == {1}
    for r in after:
        ids = [x.doc_id for x in groups[of[tuple(r)]] if x.doc_id is not None]
        assert r.doc_id == min(ids, default=None)


def test_pii_stage(stages):
    before, after = stages[1]["pii_pseudonyms"]
    want = Counter()
    for r in before:
        text = pii.pseudonymise(r.text)[0]
        want[tuple(text if c == "text" else len(text) if c == "n_chars" else r[c] for c in r.__fields__)] += 1
    assert bag(after) == want and any(a != b for a, b in zip(sorted(r.text for r in before), sorted(r.text for r in after)))


def test_mixing_stage(stages):
    before, after = stages[1]["pfair_mixing"]
    assert bag(before) == bag(after)
    counts = Counter(mixing.NONE if r.source is None else r.source for r in before)
    slots = sorted((slot, s) for (s, _), (_, _, slot) in slow_schedule(dict(counts)).items())
    left, want = dict(counts), []
    for _, s in slots:
        n = min(8, left[s])
        left[s] -= n
        want += [s] * n
    assert [mixing.NONE if r.source is None else r.source for r in stages[1]["in order"]] == want


def test_packing_stage(stages):
    before, after = stages[1]["packing"]
    t = Tokenizer.from_file(encoding.default_path("byte_bpe_50k.json"))
    ids = [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in before]
    assert sum(r.length for r in after) == sum(len(x) for _, x in ids)
    cut = Counter()
    for r in after:
        assert any(d == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for d, x in ids)
        cut[r.sequence_id] += r.length
    assert max(cut.values()) <= 2048


def test_windows_are_numbered_in_the_order_of_the_schedule(spark, stages):
    """Whatever order the mixed files are read in: a partition's windows hold one range of slots, and ranges rise with sequence_id."""
    before, after = stages[1]["packing"]
    once = Counter(r.doc_id for r in before)
    placed = mixing.mix(spark.createDataFrame(before).repartition(3), "s").collect()
    slot = {r.doc_id: r.s.slot for r in placed if once[r.doc_id] == 1 and r.doc_id is not None}
    parts = defaultdict(set)
    for r in after:
        if r.doc_id in slot:
            parts[r.sequence_id >> 33].add(slot[r.doc_id])
    ranges = [(min(v), max(v)) for _, v in sorted(parts.items())]
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_run_is_its_stages(spark, stages):
    folder, out = stages
    got = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.doc_tokens) for r in got.collect() if r.start == 0) == Counter((r.doc_id, r.doc_tokens) for r in out["packing"][1] if r.start == 0)
