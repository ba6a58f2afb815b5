"""Every registered query of an operator, column by column, against brute force: on the given tables and on an awkward one."""

import hashlib
import heapq
import html as html_lib
import io
import re
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from touchline.llm import encoding, licenses, media, mixing, pii
from touchline.llm.queries import ORACLES, QUERIES

from .test_models_and_joins import slow_components, slow_fingerprint
from .test_text_ops import slow_counts

AWKWARD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "One two", "en", "a"), (3, "One two", "en", "a"), (None, "no id here at all", "fr", "b"), (5, "<|endoftext|> x <|ENDOFTEXT|>", "en", "c"),
    (6, "word " * 3000, "en", "a"), (7, "ab\u0085cd　ef \t\x0b x\n\n y", "de", "a"), (8, "mail me@x.org, card 4337166598464399", "en", "b"), (9, "x" * 9000, "en", "a"),
    (-4, "İstanbul ẞ ǅ 中文 文字", "zh", "a"),
]
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module", params=["given", "awkward", "empty"])
def tables(request, spark, sf_dir, tmp_path_factory):
    """(folder, rows of documents); the awkward one has further columns with clashing names."""
    if request.param == "given":
        rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
        return sf_dir, [tuple(r) for r in rows]
    folder = str(tmp_path_factory.mktemp(request.param))
    rows = AWKWARD if request.param == "awkward" else []
    extra = ["n_chars long", "fp long", "__counts long", "component_id long", "slot long", "found long"]
    df = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], ", ".join([DOCS, *extra]))
    df.repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (6, None, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "u", "<p>A</p>"), (1, "u", None), (None, None, ""), (2, "v", "<article><h1>T</h1><p>Some words of a text.</p></article><footer>© x</footer>")] if rows else []
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    bench = [(1, "One two"), (1, "One two"), (2, None), (3, ""), (None, "no ID here"), (4, "WORD x card 中文 文字"), (5, "word İ"), (6, "unknown"), (7, ",;")] if rows else []
    spark.createDataFrame([(*r, 0, 0) for r in bench], "item_id long, text string, rank long, q long").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -3.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [4.0, 0.25])]
    spark.createDataFrame([(*r, 0, 0) for r in vectors if rows], "vec_id long, embedding array<float>, x long, component long").write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows


def result(spark, name, tables):
    return [r.asDict() for r in QUERIES[name](spark, tables[0]).collect()]


def texts(tables):
    return [(d, (t or "").encode()) for d, t, _, _ in tables[1]]


def counted(rows, columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def tokenizer(name):
    return Tokenizer.from_file(encoding.default_path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, tables, sf_dir):
    got = result(spark, "op1_html_text", tables)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    if tables[0] != sf_dir:
        assert len(got) == (4 if tables[1] else 0)
        return
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = page.html.split("<article>")[1].split("</article>")[0].split("<footer")[0]
        blocks = [" ".join(html_lib.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        own = [r for r in got if r["page_id"] == page.page_id]
        assert [(r["url"], r["text"]) for r in own] == [(page.url, "\n\n".join(b for b in blocks if b))]


def test_op2(spark, tables):
    got = result(spark, "op2_simhash", tables)
    items = [(d, slow_fingerprint(t.decode())) for d, t in texts(tables)]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(items, slow_components(items)))
    assert counted(got, ("doc_id", "fingerprint", "component_id")) == want


def test_op3(spark, tables):
    got, t = result(spark, "op3_token_store", tables), tokenizer("word_bpe_49k.json")
    want = Counter((d, len(ids) + 1, crc([*ids, 2])) for d, x in texts(tables) for ids in [t.encode(x.decode(), add_special_tokens=False).ids])
    assert counted(got, ("doc_id", "n_tokens", "ids_crc32")) == want
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)


def test_op4(spark, tables):
    got = result(spark, "op4_lm_scoring", tables)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    words = [(d, [*t.lower().split(), b"\n"]) for d, t in texts(tables)]
    train = Counter(w for d, ws in words if not held(d) for w in ws)
    size = train.total() + len(train) + 1
    want = Counter((d, held(d), len(ws), sum(w in train for w in ws), train.total(), round(sum(np.log10((train[w] + 1) / size) for w in ws), 3)) for d, ws in words)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    for r in got:
        assert r["score"] < 0 and np.isfinite(r["score"])
    same = defaultdict(set)
    for r in got:
        same[r["doc_id"], r["n_tokens"], round(r["base_score"], 6)].add(round(r["score"], 6))
    assert all(len(v) == 1 for k, v in same.items() if k[0] == 3)  # repeated rows score alike


def slow_schedule(counts):
    """(source, block) -> (release, deadline, slot) by a plain earliest-deadline-first loop over the slots."""
    shares = mixing.integer_weights(mixing.tempered(counts), mixing.period_slots(counts))
    slots, left, out = sum(shares.values()), {s: -(-n // 8) for s, n in counts.items()}, {}
    names, slot = sorted(s for s in shares if shares[s]), 0
    served = dict.fromkeys(names, 0)
    while any(served[s] < left[s] for s in names):
        ready = []
        for s in names:
            i = served[s] + 1
            release, deadline = (i - 1) * slots // shares[s], -(-i * slots // shares[s])
            if release <= slot:
                heapq.heappush(ready, (deadline, release, s, i))
        if ready:
            deadline, release, s, i = ready[0]
            out[s, i] = (release, deadline, slot)
            served[s] += 1
        slot += 1
    return out


def test_op5(spark, tables):
    got = result(spark, "op5_mixing", tables)
    sources = [mixing.NONE if s is None else s for _, _, _, s in tables[1]]
    counts = Counter(sources)
    assert counted(got, ("doc_id", "source")) == Counter((d, s) for d, _, _, s in tables[1]) and all(r["in_mix"] for r in got)
    if not counts:
        return
    want = slow_schedule(dict(counts))
    per_block = Counter()
    for r in got:
        s = mixing.NONE if r["source"] is None else r["source"]
        assert (r["release_time"], r["deadline"], r["slot"]) == want[s, r["block"]]
        per_block[s, r["block"]] += 1
    for s, n in counts.items():
        assert [per_block[s, b] for b in range(1, -(-n // 8) + 1)] == [8] * (n // 8) + [n % 8] * (n % 8 > 0)


def test_op6(spark, tables):
    got = result(spark, "op6_quality_rules", tables)
    want = Counter()
    for (d, t, _, _) in tables[1]:
        n, chars, symbols, dup, rep = slow_counts(t)
        want[d, n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n] += 1
    assert counted(got, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    # so few labels show no cutoff to be safe
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


#: How the values of these tables look, and what makes one valid: finders that share nothing with the operator.
PLAIN = {
    "secret": (r'(?<=token = ")[0-9a-f]{6,}|(?<=password=)\S+', lambda v: True),
    "email": (r"[a-z0-9.]+@[a-z0-9.]+\.(?:com|org)", lambda v: True),
    "card": (r"(?<![\w+.-])\d{16}(?!\w)", luhn),
    "ipv4": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", lambda v: all(int(x) < 256 for x in v.split("."))),
    "phone": (r"\+1 \(\d{3}\) \d{3}-\d{4}", lambda v: True),
}


def shape(kind, value):
    """What a pseudonym keeps."""
    if kind == "ipv4":
        return value.count(".")
    if kind == "email":
        local, domain = value.split("@")
        return re.sub("[a-z]", "a", re.sub("[0-9]", "0", local)), domain
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        return len(value)
    kept = {"card": 1, "phone": 2}.get(kind, 0)
    return value[:kept], re.sub("[a-z]", "a", re.sub("[0-9]", "0", value))


def test_op7(spark, tables):
    """Texts with all values cut out are equal; values keep their shape and validity, are linked by equality and only by it."""
    got = result(spark, "op7_pii", tables)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _, _, _ in tables[1])
    of, image, n_values = defaultdict(list), defaultdict(dict), 0
    for r in got:
        of[r["doc_id"]].append(r)
    cut = lambda text: re.sub("|".join(f"(?:{p})" for p, _ in PLAIN.values()), "\0", text)
    for d, t, _, _ in tables[1]:
        if t is None:
            assert all(r["text"] is None and r["n_found"] == 0 for r in of[d])
            continue
        found = {kind: [v for v in re.findall(p, t) if valid(v)] for kind, (p, valid) in PLAIN.items()}
        (r,) = {(r["text"], *(r[f"n_{k}"] for k in pii.KINDS)) for r in of[d]}
        assert r[1:] == tuple(len(found.get(k, ())) for k in pii.KINDS) and cut(r[0]) == cut(t)
        for kind, (p, valid) in PLAIN.items():
            for old, new in zip(re.findall(p, t), re.findall(p, r[0]), strict=True):
                if not valid(old):
                    assert new == old
                    continue
                n_values += 1
                assert valid(new) and shape(kind, new) == shape(kind, old) and image[kind].setdefault(old, new) == new
        assert pii.restore(r[0], pii.DEMO_KEY) == t
    for kind, own in image.items():
        assert len(set(own.values())) == len(own) and sum(a == b for a, b in own.items()) <= 1, kind
    assert n_values or not tables[1]


def test_op8(spark, tables):
    got, t = result(spark, "op8_token_counts", tables), tokenizer("byte_bpe_50k.json")
    lengths = [len(t.encode(x.decode(), add_special_tokens=False).ids) for _, x in texts(tables)]
    want = {
        (n, lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(x <= n for x in lengths), sum(min(x, n) for x in lengths))
        for n in set(lengths)
    }
    assert set(counted(got, ("length", "n_docs", "docs_from", "tokens_from", "docs_to", "truncated_tokens"))) == want and len(got) == len(want)
    assert all(abs(r["quantile"] - r["docs_to"] / len(lengths)) < 1e-12 for r in got)


def test_op9(spark, tables):
    got, t = result(spark, "op9_packing", tables), tokenizer("byte_bpe_50k.json")
    pool = defaultdict(list)
    for d, x in texts(tables):
        pool[d].append([*t.encode(x.decode(), add_special_tokens=False).ids, 1])
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append(r)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    total = 0
    for (d, n), own in pieces.items():
        same = [ids for ids in pool[d] if len(ids) == n]
        by_start = defaultdict(list)
        for r in own:
            assert any(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in same)
            by_start[r["start"]].append(r)
        assert sum(r["length"] for r in own) == n * len(same)
        total += n * len(same)
    assert total == sum(len(ids) for v in pool.values() for ids in v)
    if got:
        padded = sum(sum(r["length"] for r in own) < 2048 for own in windows.values())
        assert padded <= len({s >> 33 for s in windows})  # one of each input partition


def test_op10(spark, tables):
    got = result(spark, "op10_media_columns", tables)
    want = Counter()
    for d, x in texts(tables):
        payload = x + bytes(-len(x) % 64 or (0 if x else 64))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(payload)
        stored = out.getvalue()
        codes, times, _ = media.peak_pairs(media.spectrogram(payload))
        arrays = ",".join(map(str, codes)) + "|" + ",".join(map(str, times))
        feature = f"{len(codes)}:{hashlib.sha256(arrays.encode()).hexdigest()}"
        want[(d, len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)] += 1
        assert any(r["codes"] == codes.tolist() and r["times"] == times.tolist() for r in got if r["doc_id"] == d)
    assert counted(got, ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == want


def test_op11(spark, tables, sf_dir):
    got = result(spark, "op11_whitening", tables)
    rows = spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()
    rows = [r for r in rows if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and (tables[0] == sf_dir or len(r.embedding) == 2)]
    if not rows:
        assert got == []
        return
    x = [[int(np.floor(64.0 * v)) + 1_000_000 for v in r.embedding] for r in rows]
    n, d, sums = len(x), len(x[0]), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * v - s) / n for v, s in zip(r, sums)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    kept = min(32, d)
    deviation = Counter((r.vec_id, sum((n * v - s) ** 2 for v, s in zip(own, sums))) for r, own in zip(rows, x))
    for k in range(kept):
        own = sorted((r for r in got if r["component"] == k + 1), key=lambda r: (str(r["vec_id"]), r["deviation"]))
        assert Counter((r["vec_id"], r["deviation"]) for r in own) == deviation and {r["n"] for r in own} == {n}
        want = [p for _, _, p in sorted((str(r.vec_id), sum((n * v - s) ** 2 for v, s in zip(o, sums)), p) for r, o, p in zip(rows, x, centred @ v[:, k] / np.sqrt(e[k])))]
        found = [r["whitened"] for r in own]
        sign = np.sign(np.dot(found, want))
        assert np.allclose(found, sign * np.array(want), atol=1e-6)
        assert all(abs(r["explained"] - e[k] / e.sum()) < 1e-9 and r["identity_error"] < 1e-9 for r in own)
    assert len(got) == kept * n


def test_op12(spark, tables):
    got = result(spark, "op12_lexical_search", tables)
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(d, Counter(terms(t))) for d, t, _, _ in tables[1]]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    want = []
    for item, text in {(r.item_id, r.text) for r in spark.read.parquet(f"{tables[0]}/benchmark.parquet").collect()}:
        scores = []
        for d, c in docs:
            m = 10 + 90 * c.total() * n_docs // n_terms
            own = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[w] + 1)))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if own > 0:
                scores.append((-own, d is None, d or 0))
        want += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:10], 1)]
    assert counted(got, ("item_id", "rank", "doc_id", "score")) == Counter(want)
    assert want or not tables[1]


def test_op13(spark, tables):
    got = result(spark, "op13_licenses", tables)
    want = Counter()
    for d, t, _, _ in tables[1]:
        words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, base, best, own = [], set(), 0.0, set()
        for phrase, label in licenses.PHRASES.items():
            at = [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            places += at
            base |= {label} if at else set()
        for label, text in licenses.TEMPLATES:
            size, step = (16, 8) if len(text.split()) <= 9 else (64, 32)
            for start in range(0, max(1, len(words)), step):
                share = len(set(words[start : start + size]) & set(text.split())) / len(set(text.split()))
                if share >= licenses.THRESHOLD:
                    best, own = max(best, share), own | {label}
        want[d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else best] += 1
    assert counted(got, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_equals_sql(spark, name, folder):
    """At the larger size the quality rules have labels enough for cutoffs of their own."""
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want, got = con.execute(ORACLES[name]).fetchdf(), QUERIES[name](spark, folder).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    cell = lambda v: "~" if v is None or v != v else v if isinstance(v, (str, bool)) else float(v)
    rows = lambda df: sorted(str(tuple(map(cell, r))) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)
    if name == "op6_quality_rules" and folder.endswith("0.1"):
        assert 0 < got.kept.sum() < (~got.base_failed).sum()
