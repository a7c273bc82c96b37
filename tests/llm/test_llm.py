"""The training-data operators against brute force, and their defined results on odd input."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import mixing, mtree, near_dedup, pieces, quality, suffix_dedup, suffixes, token_files, toxicity, url_filter, warc
from pagemill.llm.components import components, joined

BLANK = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(3)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def fixture():
    rng = random.Random(5)
    base = prose(400, rng)
    rows = []
    for i in range(40):
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append(" ".join(w))
    passage = prose(60, rng)
    rows += [prose(30, rng) + " " + passage + " " + prose(30, rng) for _ in range(12)]
    rows += [base] * 5 + ["one two", "One  two", "", " \n\t", "é" * 150, "ab" * 300, "x y " * 3000, "Ünï " * 40 + "###"]
    rows += [prose(80, rng) for _ in range(20)] + [None, None]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None]), len(t or "")) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return fixture()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "n_chars")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(t):
    w = re.findall(BLANK, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup(docs, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.link(docs).collect()}
    assert got == {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_near_dedup_odd(spark, empty):
    assert near_dedup.link(empty).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 3), (2, None, 4)], "doc_id long, text string, component_id int")
    got = sorted(near_dedup.link(d).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, None, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] == 1] == [(1, True)] * 2


def repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted((r[0], r[1]) for r in rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_joined_labels(spark):
    r = random.Random(3)
    for first, second in ((60, 40), (0, 30), (50, 0)):
        edges = [[tuple(r.sample(range(120), 2)) for _ in range(k)] for k in (first, second)]
        up: dict[int, int] = {}

        def top(x, up=up):
            while x in up:
                x = up[x]
            return x

        for a, b in edges[0] + edges[1]:
            a, b = sorted((top(a), top(b)))
            if a != b:
                up[b] = a
        one, two = (spark.createDataFrame(e, "a long, b long") for e in edges)
        got = joined(components(one), two).collect()
        assert sorted((x.id, x.label) for x in got) == sorted((x, top(x)) for x in {x for e in edges for pair in e for x in pair})


@pytest.mark.parametrize("run", [4096, 3])
def test_suffix_dedup(docs, rows, run, monkeypatch):
    monkeypatch.setattr(suffix_dedup.covered, "__defaults__", (suffix_dedup.LENGTH, suffix_dedup.K, run))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removed(docs).collect()}
    assert got == repeats(rows)


def test_suffix_dedup_odd(spark, empty):
    assert suffix_dedup.removed(empty).count() == 0 and suffix_dedup.cut(empty).count() == 0
    t = "".join(random.choice("abcdef") for _ in range(300))
    d = spark.createDataFrame([(1, t), (1, t), (1, t + "zz"), (None, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.removed(d).collect())
    assert got[-1] == (True, 300, 300) and len(got) == 4


def test_suffix_sort_is_lexicographic():
    data = bytes(random.choice(b"ab") for _ in range(600))
    at = np.arange(500)
    order, same = suffixes.sort_segments(suffixes.Text(data), at, 20, np.zeros(500, np.int64))
    assert order.tolist() == sorted(range(500), key=lambda i: data[i : i + 20])
    assert same.tolist() == [i > 0 and data[order[i] : order[i] + 20] == data[order[i - 1] : order[i - 1] + 20] for i in range(500)]


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for d, t, *_ in rows:
        t = t or ""
        w = re.findall(BLANK, t)
        n = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(BLANK, x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_empty(empty):
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_mixing(docs, rows, spark):
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
    assert all(s == full and abs(t - target) <= 32 for s, t, target, full in by.values())
    assert abs(sum(x[2] for x in by.values()) - 1.5 * sum(x[0] for x in by.values())) < 1
    assert sorted(map(str, mixing.mix(docs.repartition(3), block=16).collect())) == sorted(map(str, got))
    text = mixing.mixed_documents(docs, block=16)
    assert text.columns == docs.columns
    assert sum(len(re.findall(BLANK, r["text"])) for r in text.collect()) == sum(r["taken"] for r in got)


def test_mixing_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_permutation(spark):
    from pyspark.sql import functions as F

    d = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000), F.lit(1)).alias("p")).collect()
    assert sorted(r["p"] for r in d) == list(range(1000))


def test_pieces(docs, rows, empty):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.default_model())
    got = {r["doc_id"]: r for r in pieces.encode_table(docs, with_ids=True).collect()}
    for d, t, *_ in rows:
        ids = sp.encode(t or "") + [2]
        assert got[d]["ids"] == ids
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode_table(empty).count() == 0


def test_pieces_random():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.default_model())
    p = pieces.load(pieces.default_model())
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n▁éß漢😀=-the ing") for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a" * 5000, " " * 5000, "ab" * 4000]
    ids, n = p.encode(texts, end=False)
    cut = np.split(ids, np.cumsum(n)[:-1])
    assert [x.tolist() for x in cut] == sp.encode(texts)
    assert p.decode(ids, n) == [sp.decode(x.tolist()) for x in cut]


def test_token_counts(spark, docs, rows, empty, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.default_model())
    monkeypatch.setattr(token_files.count_tokens, "__defaults__", (97,))
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.document_counts(spark, docs).collect()}
    assert got == {r[0]: len(sp.encode(r[1] or "")) for r in rows}
    assert token_files.document_counts(spark, empty).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\n" * 70000), (None, "u", "<p>x</p>"), (6, "u", "alone")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(spark, d).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    assert got[5]["payload_bytes"] == 70000 * 6
    assert warc.round_trip(spark, d.limit(0)).count() == 0


def test_warc_damage():
    r = warc._record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None)
    pack = lambda b: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + z.flush()
    whole = pack(r) + pack(r)
    assert [x["payload"] for x in warc.read_records(io.BytesIO(whole), True)] == [b"body"] * 2
    for bad in (whole[:-9], pack(r.replace(b"body", b"bodx")), pack(r[:-1]), pack(r.replace(b"\r\n\r\nbody", b"\r\n\r\nbodyy"))):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_urls(spark):
    urls = ["http://www.EXAMPLE.com/en/1", "https://a.example.com/en/", "https://example.com/de", "ftp://x.net/fr/?q", "x.net/fr/", None, "http://net/es/#a", "http://examplecom/en/", "http://com", "http://b.org/en/://net/es/"] + [None] * 3
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(d, url_filter.rules_table(spark)).collect()}
    want = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        want[i] = (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert got == want
    assert url_filter.judge(d, url_filter.rules_table(spark).limit(0)).filter("verdict = 'allow'").count() == len(urls)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 60)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.2, (300, 8)).astype(np.float32)
    x[50:120] = x[40]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (320, [float("nan")] * 8), (340, [1.0, None] * 4)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.top_k(d).collect()}
    z = np.floor(64 * x.astype(float)).astype(int)
    want = {}
    for q in range(0, 300, 20):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-int(z[q] @ z[i]), i))[:20]
        want |= {(q, k + 1): (i, int(z[q] @ z[i])) for k, i in enumerate(order)}
    assert got == want
    assert mtree.top_k(d.limit(0)).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng.randrange(5, 120), rng).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "awful"]))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    rows += [(1000, None, None), (1001, "", "xx")]
    d, y = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(d, y).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and not got[1000]["held_out"] == (zlib.crc32(b"1000") % 5 != 0)
    assert np.mean([got[i]["predicted"] == dict(labels)[i] for i in held]) > 0.97
    assert 0 <= got[1000]["score"] <= 1 and got[1000]["score"] == got[1001]["score"]
    assert toxicity.classify(empty, y).count() == 0
    assert all(r["score"] < 1e-6 for r in toxicity.classify(d.limit(3), y.limit(0)).collect())


def test_pipeline(spark, docs):
    import corpus_pipeline as P

    out = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns, name
    assert P.STAGES[-1][1](spark, out, "").count() == out.count()
