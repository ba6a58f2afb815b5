"""Near-duplicates, page extraction, language-model scores and the pipeline."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from touchline.llm import html_blocks, html_extract, html_pages, lm_scoring, mixing_model, near_text, simhash
from touchline.llm.components import component_labels
from touchline.llm.queries import ORACLES, QUERIES

# ---- simhash -------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(items, radius=2):
    """{row: smallest id} by all pairs; items: (id, fingerprint)."""
    label = list(range(len(items)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(items):
        for j in range(i):
            if bin(a ^ items[j][1]).count("1") <= radius:
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(items):
        groups.setdefault(root(i), []).append(d)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(items))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a a a a a a", "Ünï CÖDE x " * 50, "w\x85x y\x1cz \x0b t"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def near_values(seed, n_bases=30, each=25):
    r, out = random.Random(seed), []
    for _ in range(n_bases):
        base = r.getrandbits(64)
        for _ in range(each):
            v = base
            for _ in range(r.randint(0, 4)):
                v ^= 1 << r.randrange(64)
            out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_comparison(radius):
    values = np.array(near_values(radius), np.uint64)
    q, k = simhash.within(values[:70], values, radius)
    want = {(i, j) for i in range(70) for j in range(len(values)) if bin(int(values[i]) ^ int(values[j])).count("1") <= radius}
    assert set(zip(q.tolist(), k.tolist())) == want


def test_links_with_split_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # every larger key is dealt over several groups
    values = near_values(5, 6, 60)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    labels = {r.node % (1 << 64): r.label for r in component_labels(edges).collect()}
    got = {}
    for v, s in zip(values, signed):
        got.setdefault(labels.get(v, s), set()).add(v)
    want = {}
    for v, c in zip(values, slow_components([(v, v) for v in values])):
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(100, 400)]
    hub = [(1000, k) for k in range(1001, 1300)]
    labels = {r.node: r.label for r in component_labels(spark.createDataFrame([*path, *hub, (5, 5)], "u long, v long")).collect()}
    assert all(labels[k] == 100 for k in range(100, 401)) and all(labels[k] == 1000 for k in range(1000, 1300)) and 5 not in labels
    assert component_labels(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("shape", ["far end", "zigzag", "random", "two hubs"])
def test_components_in_few_rounds(spark, shape, monkeypatch):
    from touchline.llm import components

    r, n = random.Random(4), 10_000
    order = list(range(n))
    if shape == "far end":
        order = [*range(1, n), 0]
    elif shape == "zigzag":
        order = [k // 2 if k % 2 else n - 1 - k // 2 for k in range(n)]
    else:
        r.shuffle(order)
    pairs = list(zip(order, order[1:]))
    if shape == "random":
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(n)]
    elif shape == "two hubs":
        pairs = [(n - 1 - k % 2, k) for k in range(n - 2)]
    rounds = []
    real = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: rounds.append(name) or real(df, name))
    got = {x.node: x.label for x in component_labels(spark.createDataFrame(pairs, "u long, v long")).collect()}
    label = list(range(n))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for u, v in pairs:
        low, high = sorted((root(u), root(v)))
        label[high] = low
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert rounds.count("step") < 30


def dup_rows(seed=1):
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    for _ in range(12):
        words = [word() for _ in range(r.choice([1, 2, 5, 300]))]
        for _ in range(r.randint(1, 6)):
            own = list(words)
            if len(own) > 100 and r.random() < 0.6:
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own))
    return [(k, t, "x") for k, t in enumerate([*rows, None, "", "   "])]


def test_near_duplicates_match_all_pairs(spark):
    rows = dup_rows()
    rows += [(None, rows[0][1], "x"), (2, rows[2][1], "x"), (None, "alone and without an id", "x")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    items = [(d, slow_fingerprint(t)) for d, t, _ in rows]
    want = Counter((d, f, c) for (d, f), c in zip(items, slow_components(items)))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_group_stays(spark):
    rows = dup_rows(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.one_of_each(df)
    groups = slow_components([(d, slow_fingerprint(t)) for d, t, _ in rows])
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))
    twice = df.union(df).union(spark.createDataFrame([(None, rows[0][1], None), (None, "only one", None)], df.schema))
    again = [r.doc_id for r in simhash.one_of_each(twice).collect()]
    assert Counter(again) == Counter([*set(groups), None])
    clash = twice.selectExpr("*", "1 as __fp", "2 as __fp1", "3 as g", "4 as component_id")
    kept = simhash.one_of_each(clash)
    assert kept.columns == clash.columns and Counter(r.doc_id for r in kept.collect()) == Counter(again)


def five_words(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited_rows(seed=3):
    """Texts of 60 to 200 words and copies with one to five words put in place of others."""
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    for _ in range(40):
        words = [word() for _ in range(r.randint(60, 200))]
        for _ in range(r.choice([1, 2, 12])):
            own = list(words)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own))
    return [*rows, None, "", "  ", "One two", "one TWO"]


def test_edited_copies_are_one_group(spark):
    import corpus_pipeline

    texts = edited_rows()
    sets = [five_words(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and len(set(label)) < len(texts) - 20
    twice = df.union(df).union(spark.createDataFrame([(None, texts[0], None), (None, "only one", None)], df.schema))
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, twice, "").collect()) == Counter([*set(label), None])


@pytest.mark.parametrize("part_bytes, hot_share", [(8 << 20, 1000), (2000, 1000), (2000, 0)])
def test_large_keys_lose_no_link(spark, monkeypatch, part_bytes, hot_share):
    """Many sets that share keys, similar and not, in groups of one and of many parts, with hot keys and without: components as by all pairs."""
    monkeypatch.setattr(near_text, "PART_BYTES", part_bytes)
    monkeypatch.setattr(near_text, "HOT_SHARE", hot_share)
    r, texts = random.Random(8), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(150)]  # a passage that makes dissimilar texts share bands
    for _ in range(25):
        own = common + [word() for _ in range(45)]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(own)
            for _ in range(r.randint(0, 3)):
                copy[150 + r.randrange(45)] = word()
            texts.append(" ".join(copy))
    sets = [five_words(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    assert 5 < len(set(label)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in near_text.near_texts(df).collect()} == dict(enumerate(label))


def test_simhash_finds_what_no_band_does(spark):
    """Similar texts within two bits of SimHash are linked though they share no min-hash band."""
    texts = [" ".join([f"k21067w{i}" for i in range(5)] * 40) + end for end in ("", " end")]
    a, b = (near_text.shingle_set(t.encode()) for t in texts)
    x, y = (simhash.fingerprint(t.encode()) for t in texts)
    assert near_text.similarity(a, b) >= 0.8 and (x ^ y).bit_count() <= 2
    assert not set(near_text.band_keys(a).tolist()) & set(near_text.band_keys(b).tolist())
    df = spark.createDataFrame([(7, texts[0]), (3, texts[1]), (1, "another text")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_text.near_texts(df).collect()} == {7: 3, 3: 3, 1: 1}


def test_overlaps_and_label_links():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 50)).astype(np.uint32)) for _ in range(40)]
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(40), [len(x) for x in sets])
    order = np.argsort(hashes, kind="stable")
    for s in sets:
        assert near_text.overlaps(s, hashes[order], owner[order], 40).tolist() == [len(set(s.tolist()) & set(x.tolist())) for x in sets]
    u, v = near_text.label_links([x.tobytes() for x in sets[:20]], np.arange(20), [x.tobytes() for x in sets], np.arange(40))
    links = [(i, j) for i in range(20) for j in range(40) if i != j and near_text.similarity(sets[i], sets[j]) >= 0.8]
    whole = simhash.forest(*np.array(links or [(0, 0)]).T, 40)
    assert (simhash.forest(u, v, 40) == whole).all()


# ---- pages ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_blocks_of_broken_markup():
    page = '<!doctype html><HEAD><title>no</title></HEAD><p>One &amp; two&nbsp;<b>bold<br>line<p>Three<script>var a="</p>"</script> four<!-- <p>no --><ul><li>x<li>y</ul></div><p>5 < 6 <a href="a>b">link</a><td'
    assert [b.text for b in html_blocks.parse(page)] == ["One & two bold line", "Three four", "x", "y", "5 < 6 link"]
    def tags(path):
        return () if path is None else (*tags(path.above), path.tag)

    paths = [tags(b.path) for b in html_blocks.parse(page)]
    assert paths == [("p",), ("p",), ("ul", "li"), ("ul", "li"), ("p",)]
    assert html_blocks.parse("") == [] and html_blocks.parse("just text")[0].text == "just text"
    assert [b.text for b in html_blocks.parse("<p>a</p>" + "<" * 2000)][0] == "a"
    for page, want in (
        ("<p title=it's>Hello</p><p>don't stop</p><p>End</p>", ["Hello", "don't stop", "End"]),
        ("<p a=b'c d=\"e>f\">x</p><p a='>y'>z</p><p = q>w</p><p a=>v", ["x", "z", "w", "v"]),
        ("<!-->a<p>b</p><!-- c --><!--->d<!-- e --!>f", ["a", "b", "df"]),
        ("<head><title>t</title><meta a=b><h2>two</h2><ul><li>x</ul><table><tr><td>1</table>", ["two", "x", "1"]),
        ("<head><title>t</title>text<p>more", ["text", "more"]),
    ):
        assert [x for b in html_blocks.parse(page) for x in [b.text]] == want, page


def test_deep_and_long_pages_take_linear_time(model):
    start = time.monotonic()
    assert len(html_blocks.parse("<div>x" * 20_000 + "</p>" * 20_000 + "<li>y" * 5_000)) == 25_000
    assert html_extract.main_texts(["<div class=a>x" * 3_000 + "</div>" * 3_000, "<p>y</p>" * 5_000], model)
    assert time.monotonic() - start < 20


def test_gradients_match_differences():
    m = html_extract.BlockLabeller(3)
    for k, v in m.p.items():
        m.p[k] = v.astype(np.float64)
    r = np.random.default_rng(0)
    each = r.integers(1, 9, 9)
    x = html_extract.Rows(r.integers(0, html_extract.WIDTH, each.sum()), r.random(each.sum()), each)
    sizes, y = [4, 2, 3], r.integers(0, 2, 9).astype(float)
    _, g = m.gradients(x, sizes, y)
    for name in ("we", "wxf", "whf", "whb", "bb", "wo"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, eps = m.p[name][at], 1e-3
        losses = []
        for d in (eps, -eps):
            m.p[name][at] = keep + d
            losses.append(m.gradients(x, sizes, y)[0])
        m.p[name][at] = keep
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / (2 * eps), rel=0.05, abs=1e-4)


def test_held_out_pages(model):
    maker, wrong, total = html_pages.PageMaker(12345), 0, 0
    for _ in range(60):
        html, main = maker.page()
        got = html_extract.main_texts([html], model)[0]
        wrong += got != "\n\n".join(main)
        total += 1
    assert wrong <= 2


def test_given_pages_are_their_articles(spark, sf_dir, model):
    import html as h
    import re

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_main_text(rows).collect()}
    for r in rows.collect():
        article = r.html.split("<article>")[1].split("</article>")[0].split("<footer")[0]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_page_edges(spark, model):
    rows = [(1, None, None, "a"), (None, "u", "", "b"), (2, "u", "<p></p>", "c"), (2, "u", "<p></p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html_extract.extract_main_text(df).collect()] == [("", 0)] * 4
    assert html_extract.extract_main_text(df.where("false")).collect() == []


def test_comments_and_sidebars_are_left_out(model):
    main = "".join(f"<p>Paragraph number {k} of the story goes on for some words.</p>" for k in range(4))
    page = (
        f'<body><header class="site-header"><h1>Daily</h1></header><nav><ul><li><a href=a>Home</a></ul></nav><main><article><h1>Title</h1>{main}'
        '<div class="ad">Buy now</div></article></main><aside class="sidebar"><h3>Popular</h3><ul><li><a href=b>More</a></ul></aside>'
        '<section id="comments"><h3>Comments</h3><ul><li class=comment><p>Nice story, thanks.</p></ul></section><form><p>Subscribe</p></form><footer>&copy; Daily</footer></body>'
    )
    got = html_extract.main_texts([page], model)[0].split("\n\n")
    assert got == ["Title", *[f"Paragraph number {k} of the story goes on for some words." for k in range(4)]]


# ---- language model ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lm_docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [tuple(r) for r in rows] + [(None, "null id", None), (9001, None, "en"), (9002, "", "zz"), (0, rows[0].text, rows[0].lang)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def is_held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def test_scores(lm_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 20_000)  # several chunks a part
    df, rows = lm_docs
    out = lm_scoring.score_documents(df).collect()
    train = Counter()
    for d, t, _ in rows:
        if not is_held(d):
            train.update(lm_scoring.tokens((t or "").encode()))
    size, n = train.total() + len(train) + 1, train.total()
    want = Counter()
    for d, t, _ in rows:
        words = lm_scoring.tokens((t or "").encode())
        want[d, is_held(d), len(words), sum(w in train for w in words), n, round(sum(math.log10((train[w] + 1) / size) for w in words), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    test = [r for r in out if r.held_out]
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in out)
    assert sum(r.score for r in test) / sum(r.n_tokens for r in test) > -4.6


def slow_readings(rows):
    """Per text: (c0, c1, c2, followers of the word before, of the two before) at each token, all by dictionaries."""
    grams = [Counter(), Counter(), Counter()]
    spelled = [[b"", b"", *lm_scoring.tokens((t or "").encode())] for _, t, *_ in rows]
    for (d, *_), words in zip(rows, spelled):
        for i in range(2, len(words)) if not is_held(d) else ():
            for k in range(3):
                grams[k][tuple(words[i - k : i + 1])] += 1
    follow = [Counter(), Counter(), Counter()]
    for k in range(3):
        for g, c in grams[k].items():
            follow[k][g[:-1]] += c
    out = []
    for (d, *_), words in zip(rows, spelled):
        own = 0 if is_held(d) else 1
        out.append([tuple(max(grams[k][tuple(words[i - k : i + 1])] - own, 0) for k in range(3)) + tuple(max(follow[k][tuple(words[i - k : i])] - own, 0) for k in (1, 2)) for i in range(2, len(words))])
    return out


def test_readings_and_scores_by_brute_force(spark, monkeypatch):
    """Counts, decisions, history and each probability of a small corpus, token by token."""
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25))) + (f" only{k}" if k % 3 else "")) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(10)]
    bits = 64
    chunk = lm_scoring.Chunk([(d, is_held(d), t.encode()) for d, t in rows], bits)
    train = np.repeat(~chunk.held_out, chunk.sizes)
    counts = []
    for g in chunk.grams:
        keys, place = np.unique(g, return_inverse=True)
        counts.append(np.bincount(place, train, len(keys)).astype(np.int64)[place])
    tokens = mixing_model.Tokens(chunk.word, chunk.first, ~chunk.held_out, *counts, int(train.sum()), int((~chunk.held_out).sum()))
    reading = mixing_model.Reading(tokens)
    flat, at = [x for own in slow_readings(rows) for x in own], 0
    for own in slow_readings(rows):
        found, hits, chances, run = [], 0, 0, 0
        for i, (c0, c1, c2, n1, n2) in enumerate(own):
            n2 = n2 if i else 0
            assert [int(c[at]) for c in reading.c] == [c0, c1, c2] and int(reading.n_at[1][at]) == n1 and int(reading.n_at[2][at]) == n2
            f = 3 if c2 and n2 else 2 if c1 and n1 else 1 if c0 else 0
            last = [found[-b] if len(found) >= b else 4 for b in (1, 2, 3)]
            assert reading.found[at] == f and reading.history[at] == (last[0] * 5 + last[1]) * 5 + last[2]
            assert reading.share[at] == min(8 * hits // (chances + 1), 7) and reading.run[at] == min(int(run).bit_length(), 6)
            found.append(f)
            hits, chances, run = hits + (f == 3), chances + (n2 > 0), run + 1 if f == 3 else 0
            at += 1
    assert at == reading.n
    mixer = mixing_model.decision_mixer()
    mixing_model.count_decisions(mixer, reading, train)
    stretched = lambda zeros, ones: math.log((ones + 0.05) / (zeros + 0.05))
    open_at = lambda x, gate: 1 / (1 + math.exp(-max(-11.0, min(11.0, sum(a * float(w) for a, w in zip([*x, 0.3], mixer.weights[:, gate]))))))
    orders = [((k, n, c) for k, n, c in ((2, int(reading.n_at[2][i]), c2), (1, n1, c1), (0, int(reading.n_at[0][i]), c0))) for i, (c0, c1, c2, n1, n2) in enumerate(flat)]
    orders = [list(x) for x in orders]
    # the Newton step, bit by bit: each token's own bits are taken out of the slots
    moments, (width, gates) = mixing_model.Moments(mixer), mixer.weights.shape
    mixing_model.weigh_decisions(mixer, mixing_model.Reading(mixing_model.some_texts(tokens, ~chunk.held_out)), moments)
    gradient, curve = np.zeros((gates, width)), np.zeros((gates, width, width))
    for i in np.flatnonzero(train):
        rest, parts, seen = 1.0, {}, []
        for k, n, c in orders[i]:
            if not n:
                continue
            slots, gate, bit, asked = reading.contexts(k, np.array([i]))
            assert bit[0] == (reading.found[i] == k + 1) and asked[0] == (reading.found[i] <= k + 1)
            x = []
            for j, slot in enumerate(slots):
                pair = mixer.cells[mixer.first[j] + slot[0]].astype(float)
                pair[bit[0]] -= asked[0]
                x.append(stretched(*pair))
            p = open_at(x, gate[0])
            parts[k] = rest * p * c / n
            seen.append((k, [*x, 0.3], gate[0], p))
            rest *= 1 - p
        total, reached = sum(parts.values()) if reading.found[i] else rest, 1.0
        for k, x, gate, p in seen:
            drawn = parts[k] / total
            gradient[gate] += (drawn - reached * p) * np.array(x)
            curve[gate] += reached * p * (1 - p) * np.outer(x, x)
            reached -= drawn
    want = np.stack([w + np.linalg.solve(h + mixing_model.RIDGE * np.eye(width), g) for w, g, h in zip(mixer.weights.T, gradient, curve)], 1)
    mixer.weights = moments.step(mixer.weights)
    assert np.allclose(mixer.weights, want, atol=2e-4)
    # scores: the mixture of orders, each gate refined by what came before in its text
    mixer.freeze()
    got, want, at = mixing_model.decision_scores(mixer, reading), np.zeros(reading.n), 0
    for own in slow_readings(rows):
        met = defaultdict(lambda: [0, 0])
        for _ in own:
            rest, total, later = 1.0, 0.0, []
            for k, n, c in orders[at]:
                if not n:
                    continue
                slots, gate, bit, asked = reading.contexts(k, np.array([at]))
                p = open_at([stretched(*mixer.cells[mixer.first[j] + s[0]]) for j, s in enumerate(slots)], gate[0])
                level = max(0, min(8, round(math.log(p / (1 - p)) * 0.7) + 4))
                n_met, ones = met[k, level]
                later.append(((k, level), bool(asked[0]), int(bit[0])))
                p = (150 * p + ones) / (150 + n_met)
                total += rest * p * c / n
                rest *= 1 - p
            for key, asked_, bit_ in later:
                met[key][0] += asked_
                met[key][1] += asked_ and bit_
            want[at] = math.log10(total if reading.found[at] else rest)
            at += 1
    assert np.abs(got - want).max() < 0.02 and np.median(np.abs(got - want)) < 1e-5  # rounding may move a level


def test_all_words_together_have_at_most_probability_one():
    """At one place of a text, over every word of training and a new one."""
    corpus = [b"a b c a b d", b"a b c", b"b c a", b"d a b"] * 3
    words = sorted({w for t in corpus for w in t.split()} | {b"new", lm_scoring.END})
    for before in (b"a b", b"c", b"d d", b"b"):
        # each continuation is a held-out text of its own
        texts = [(k, False, t) for k, t in enumerate(corpus)] + [(100 + k, True, before + b" " + w) for k, w in enumerate(words) if w != lm_scoring.END] + [(999, True, before)]
        chunk = lm_scoring.Chunk(texts, 64)
        train, counts = chunk.training(), []
        for g in chunk.grams:
            keys, place = np.unique(g, return_inverse=True)
            counts.append(np.bincount(place, train, len(keys)).astype(np.int64)[place])
        reading = mixing_model.Reading(mixing_model.Tokens(chunk.word, chunk.first, ~chunk.held_out, *counts, int(train.sum()), len(corpus)))
        mixer = mixing_model.decision_mixer()
        mixing_model.count_decisions(mixer, reading, train)
        mixer.freeze()
        logs = mixing_model.decision_scores(mixer, reading)
        at = chunk.first[len(corpus) :] + len(before.split())
        assert 0.5 < (10 ** logs[at]).sum() <= 1 + 1e-9


def test_tokens_of_many_texts_are_those_of_each():
    texts = [b"One two  ONE\t\x0btwo\n", b"", None, b" \n\r\f ", b"\x00a \x1cb\x85 \xc3\x84\xc2\xa0c", b"last", b"\n\nx\n"]
    for given in (texts, texts[1:3], [None]):
        words, sizes = lm_scoring.all_tokens(given)
        assert words.to_pylist() == [w for t in given for w in lm_scoring.tokens(t)] and sizes.tolist() == [len(lm_scoring.tokens(t)) for t in given]
    chunk = lm_scoring.Chunk([(k, False, t) for k, t in enumerate(texts)], 64)
    assert [chunk.words[i] for i in chunk.number] == [w for t in texts for w in lm_scoring.tokens(t)] and len(set(chunk.words)) == len(chunk.words)
    assert chunk.word_bytes().tolist() == [sum(map(len, w)) + len(w) - 1 for w in map(lm_scoring.tokens, texts)]


def test_weighing_stretches_each_slot_once(monkeypatch):
    """All training texts are weighed, so a bit costs look-ups, not logarithms; without itself, it is predicted as if it had not been counted."""
    m, words = mixing_model.spelling_mixer(), [b"w%d" % (k * k) for k in range(60_000)]
    mixing_model.count_spelling(m, words)
    done, stretch = [], m._stretch
    monkeypatch.setattr(m, "_stretch", lambda pair: done.append(pair.shape) or stretch(pair))
    moments = mixing_model.Moments(m)
    mixing_model.weigh_spelling(m, words, moments)
    assert moments.sums.any() and sum(math.prod(s[:-1]) for s in done) <= 3 * len(m.cells)
    s = mixing_model.Spelling(words[:300])
    x = m.inputs(s.slots, m.left_out(s.bits))
    for k, slot in enumerate(s.slots):
        pair = m.cells[m.first[k] + slot].astype(np.float32)
        pair[np.arange(len(slot)), s.bits] -= 1
        assert (pair >= 0).all() and np.allclose(x[k], np.log((pair[:, 1] + 0.05) / (pair[:, 0] + 0.05)), atol=1e-5)
        assert (m.confidence(k, slot, m.left_out(s.bits)) == mixing_model.confidence(pair.sum(1))).all()


def test_scores_do_not_depend_on_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one, four = ({r.doc_id: r.score for r in lm_scoring.score_documents(df).collect()} for df in (docs.coalesce(1), docs.repartition(4)))
    assert one.keys() == four.keys() and all(abs(one[k] - four[k]) <= 1e-6 * abs(one[k]) for k in one)


def test_scores_depend_on_the_order_of_words_and_find_copies(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    long = [t for d, t in rows if t and not is_held(d) and len(t.split()) > 100][:5]
    held = [d for d in range(50_000, 51_000) if is_held(d)]
    mixed_up = [" ".join(random.Random(k).sample(t.split(), len(t.split()))) for k, t in enumerate(long)]
    df = spark.createDataFrame(rows + list(zip(held, long)) + list(zip(held[5:], mixed_up)), "doc_id long, text string")
    score = {r.doc_id: r.score / r.n_tokens for r in lm_scoring.score_documents(df).collect()}
    for k in range(5):
        assert score[held[k]] > score[held[5 + k]] + 1.0


def test_scores_are_the_same_again_and_in_other_chunks(lm_docs, monkeypatch):
    df, _ = lm_docs
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score_documents(df).collect()} for _ in range(2))
    assert a == b
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 1000)  # many buckets: the counts and the model stay
    c = {(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score_documents(df).collect()}
    assert a == c


def test_weights_are_learnt_from_every_training_document(spark, sf_dir):
    """Scores do not depend on which ids the training documents have: no choice by id learns from some of them only."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(200).collect()]
    training = [d for d in range(100_000, 101_000) if not is_held(d)]
    apart = lambda d: zlib.crc32(str(d).encode()) // 7 % 32 == 0
    rare = [d for d in training if not apart(d)][: len(texts)]
    some = [d for d in training if apart(d)]
    mixed = [*some[:5], *rare[5:]]
    scores = []
    for ids in (rare, mixed):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)
        by_id = {r.doc_id: r.score for r in lm_scoring.score_documents(df).collect()}
        scores.append([by_id[d] for d in ids])
    assert np.allclose(*scores, rtol=1e-6, atol=0)


def test_changed_rows_are_refused(spark, tmp_path):
    rows = [(1, False, b"a b c"), (2, True, b"d e")]
    chunk, other = lm_scoring.Chunk(rows, 40), lm_scoring.Chunk([(1, False, b"a b x"), (2, True, b"d e")], 40)
    totals = object.__new__(lm_scoring.Totals)
    totals.rows = {}
    for k in range(3):
        keys, _, buckets, firsts = chunk.in_buckets(k, 1)
        assert buckets.tolist() == [0] and firsts.tolist() == [0]
        totals.rows[0, k] = [(0, len(keys), lm_scoring._checksum(keys), lm_scoring.packed(np.ones(len(keys), np.int64)))]
    assert totals.of(0, chunk, 1, 4, 1).c1.tolist() == [1] * 7
    with pytest.raises(ValueError, match="changed"):
        totals.of(0, other, 1, 4, 1)


@pytest.mark.parametrize("bits", [20, 32, 47, 64])
def test_buckets_are_ranges_of_hashes(bits):
    keys = np.unique(np.random.default_rng(bits).integers(0, 2**63, 5000, dtype=np.uint64) << np.uint64(1) >> np.uint64(64 - bits))
    for n in (1, 7, 1000, 2**31):
        got = lm_scoring.bucket_of(keys, bits, n).astype(int)
        assert (np.diff(got) >= 0).all() and got[0] >= 0 and got[-1] < n
        assert n > 1000 or abs(np.bincount(got, minlength=n).max() * n / len(keys) - 1) < (0.5 if n < 10 else 5)


def test_exchanged_rows_are_linear(spark, sf_dir):
    """With many buckets a row holds one n-gram, and there are never more rows than n-grams of the chunks."""
    rows = [(r.doc_id, False, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([False] * len(rows)), pa.array([r[2] for r in rows]).cast(pa.string())], names=["doc_id", "held_out", "text"])
    distinct = sum(len(lm_scoring.Chunk(rows, 50).in_buckets(k, 1)[0]) for k in range(3))
    counts = []
    for n in (1, 8, 64, 2**31):
        got = [(r, m) for number, chunk in lm_scoring._chunks(iter([batch]), 50) for k in range(3) for r, m in zip(chunk.in_buckets(k, n)[2], np.diff(np.append(chunk.in_buckets(k, n)[3], len(chunk.in_buckets(k, n)[0]))))]
        assert sum(m for _, m in got) == distinct
        counts.append(len(got))
    assert counts[:3] == [3, 24, 192] and 0.99 * distinct < counts[3] <= distinct


@pytest.mark.parametrize("values", [[], [0], [5, 2**63, 2**64 - 1, 0], list(range(1000))])
def test_packed_numbers(values):
    a = np.array(values, np.uint64)
    assert lm_scoring.unpacked(lm_scoring.packed(a), len(a)).tolist() == values


def test_score_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lm_scoring.score_documents(empty).collect() == []
    held = next(k for k in range(100) if is_held(k))
    one = lm_scoring.score_documents(spark.createDataFrame([(held, "some words", "en")], empty.schema)).first()
    assert one.held_out and one.n_known == 0 and one.train_tokens == 0 and one.base_score == 0 and one.score < 0
    same = spark.createDataFrame([(None, None, None), (None, "x " * 50_000, "y"), (held, "x " * 50_000, "y")], empty.schema)
    out = lm_scoring.score_documents(same).collect()
    assert sorted(r.n_tokens for r in out) == [1, 50_001, 50_001] and all(r.score < 0 for r in out)


def test_spelling_bits_split_probabilities():
    """Over all first bytes of a word the probabilities sum to 1."""
    m, words = mixing_model.spelling_mixer(), [b"the", b"then", b"cat", mixing_model.END] * 40
    mixing_model.count_spelling(m, words)
    moments = mixing_model.Moments(m)
    mixing_model.weigh_spelling(m, words, moments)
    m.weights = moments.step(m.weights)
    m.freeze()
    s = mixing_model.Spelling([bytes([b]) for b in range(256) if b not in (10, 32)])
    dot = m.mix(m.inputs(s.slots), s.gates(lambda k: m.confidence(k, s.slots[k])))
    logs = np.log10(mixing_model.sigmoid(np.where(s.bits == 1, dot, -dot)))
    first = np.add.reduceat(logs, np.column_stack([s.starts, s.starts + 8]).ravel())[::2]  # of each word's first byte
    assert len(first) == 254 and (10**first).sum() <= 1.0 + 1e-6
    a, b, c = mixing_model.spelling_scores(m, [b"the", b"cat", b"xyzzy"])
    assert a > b > c


# ---- pipeline and registry -------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii_pseudonyms", "pfair_mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} <= ids and out
    fills = Counter()
    for r in out:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
