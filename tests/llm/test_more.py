"""Collisions, hot groups, odd rows and clashing names, against brute force."""

import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import hashing, mixing, mtree, near_dedup, pieces, quality, shared, suffix_dedup, suffixes, token_files, toxicity, url_filter, warc
from tests.llm.test_llm import BLANK, DOCS, fixture, prose, repeats, shingles

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(SWAP)
    return t


TM = thue_morse(1024)
#: A long word and its complement: hashes that are polynomials modulo 2 ** 64 can't tell them apart.
TWINS = [TM, TM.translate(SWAP), thue_morse(4096), thue_morse(4096).translate(SWAP)]


@pytest.fixture(scope="module")
def rows():
    return fixture()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_hashes():
    data = np.frombuffer("".join(TWINS).encode(), np.uint8)
    end = np.cumsum([len(x) for x in TWINS])
    start = end - [len(x) for x in TWINS]
    assert len(set(hashing.string_hashes(data, start, end).tolist())) == 4
    words = ["", "a", "a\0", "abcdefgh", "abcdefgh\0", "hgfedcba" * 3, "abcdefgh" * 3]
    data, end = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(x) for x in words])
    h = hashing.string_hashes(data, end - [len(x) for x in words], end).tolist()
    assert len(set(h)) == len(words) and hashing.string_hashes(data, end[:0], end[:0]).tolist() == []


def test_near_dedup_twin_words(spark):
    d = spark.createDataFrame(list(enumerate(TWINS)), "doc_id long, text string")
    assert sorted((r[0], r[1], r[2]) for r in near_dedup.link(d).select("doc_id", "n_shingles", "component_id").collect()) == [(i, 1, i) for i in range(4)]


def test_near_dedup_around_the_threshold(spark, monkeypatch):
    """Groups of versions, many pairs just under and over 0.75, dealt into small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 20_000)
    rng, rows = random.Random(11), []
    for size, edits in ((60, 2), (150, 4), (150, 3), (400, 12)):
        base = prose(size, rng).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(edits * 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            near += 0.6 * either <= both < 0.75 * either
            if 100 * both >= 75 * either:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert near > 300
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_clashing_names(spark, rows):
    """Stages keep every column, also those that are called as columns of their own."""
    names = ["key", "sha", "_new", "new", "row", "_row", "_gone", "_id", "_h", "spans", "n", "size", "_text", "label", "block", "kept", "name", "_sum"]
    d = spark.createDataFrame(rows, DOCS).select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    for stage in (quality.keep_good, near_dedup.one_of_each, suffix_dedup.cut, mixing.mixed_documents):
        out = stage(d)
        assert out.columns == d.columns
        kept = out.collect()
        assert kept and all(r[n] == f"{n}-{r['doc_id']}" for r in kept for n in names)
    for query in (near_dedup.link, suffix_dedup.removed, pieces.encode_table, quality.judge, mixing.mix, lambda x: token_files.document_counts(spark, x)):
        assert query(d).count() == len(rows)
    y = spark.createDataFrame([(i, i % 2, "x") for i in range(20)], "doc_id long, toxic int, text string")
    assert toxicity.classify(d, y).count() == len(rows)


def test_repeated_rows_and_null_ids(spark):
    t = "word " * 30 + "end"
    d = spark.createDataFrame([(1, t, "en", "s", 5)] * 3 + [(None, t, None, None, None), (None, None, "en", "s", 0)], DOCS)
    for query in (pieces.encode_table, quality.judge, mixing.mix, lambda x: token_files.document_counts(spark, x), suffix_dedup.removed, near_dedup.link):
        assert Counter(r["doc_id"] for r in query(d).collect()) == {1: 3, None: 2}
    y = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.classify(d, y).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 3, None: 2} and not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_suffix_runs(spark):
    """One passage in many versions and one phrase in many surroundings: several levels of runs."""
    rng = random.Random(4)
    passage, phrase = prose(60, rng), "and so it goes on and on for ever"
    rows = [(i, f"{prose(20, rng)} {passage} {prose(20, rng)}") for i in range(30)]
    rows += [(100 + i, " ".join(f"{prose(9, rng)} {phrase}" for _ in range(4))) for i in range(30)] + [(200, TWINS[0] + TWINS[1] + TWINS[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    corpus = suffix_dedup.Corpus(d)
    spans = suffix_dedup.covered(corpus, run=2)
    got = dict.fromkeys([r[0] for r in rows], 0)
    for r in spans.collect():
        got[r["key"]] = sum(b - a for a, b in suffix_dedup._merged(r["spans"]))
    assert got == {k: v[1] for k, v in repeats(rows).items()}


def test_suffix_sort_survives_collisions():
    data = (TWINS[0] + TWINS[1]).encode()
    at = np.array([0, 1024, 0, 1024])
    order, same = suffixes.sort_segments(suffixes.Text(data), at, 1024, np.zeros(4, np.int64))
    assert order.tolist() == [0, 2, 1, 3] and same.tolist() == [False, True, False, True]


def test_cut_keeps_whole_characters(spark):
    rng = random.Random(6)
    a = prose(40, rng)
    d = spark.createDataFrame([(1, a), (2, "é" + a), (3, a + "é"), (4, a), (5, None), (6, "short"), (7, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cut(d).collect()}
    assert got == {1: a, 2: "é", 3: "é", 5: None, 6: "short", 7: "short"}


def test_pieces_of_long_words():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.default_model())
    p = pieces.load(pieces.default_model())
    rng = random.Random(2)
    texts = TWINS + ["".join(rng.choice(x) for _ in range(n)) for x in ("ab", "aeionrst", "the in", "=-#", "é漢a", "  \n") for n in (31, 33, 64, 300, 3000)]
    texts += ["thein" * 3000, " " * 3000, "x" + " " * 700 + "the", "".join(rng.choice(["merge", "rounds", "pairs", "Symbol", "12"]) for _ in range(3000))]
    p.clear()
    for some in (texts, texts[::-1]):  # also from the cache
        ids, n = p.encode(some, end=False)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == sp.encode(some)


def test_pieces_with_equal_hashes(monkeypatch):
    """All words share eight hashes: bytes decide."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.default_model())
    p = pieces.Pieces(pieces.default_model())
    monkeypatch.setattr(pieces, "hashes", lambda chunk, n, size: (size % 8).astype(np.uint64))
    texts = ["one two three four", "five six seven", "two four six one", "three"] * 2
    for some in (texts, texts[:3]):
        ids, n = p.encode(some, end=False)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == sp.encode(some)


def test_quality_model(docs, rows):
    """The verdicts by a plain EM over documents."""
    got = quality.judge(docs).collect()
    votes = [tuple(r[f"vote_{x}"] for x in quality.RULES) for r in got]
    good, bad = {-1: 0.02, 0: 0.13, 1: 0.85}, {-1: 0.5, 0: 0.2, 1: 0.3}
    table, prior, n = [{v: (good[v], bad[v]) for v in good} for _ in quality.RULES], 0.85, len(votes)

    def posterior(v):
        g, b = prior, 1 - prior
        for t, x in zip(table, v, strict=True):
            g, b = g * t[x][0], b * t[x][1]
        return g / (g + b)

    for _ in range(50):
        p = [posterior(v) for v in votes]
        mass, a = sum(p), 0.02 * n + 1
        prior = min(0.99, max(0.01, mass / n))
        table = [{x: ((sum(q for q, v in zip(p, votes, strict=True) if v[k] == x) + a * good[x]) / (mass + a), (sum(1 - q for q, v in zip(p, votes, strict=True) if v[k] == x) + a * bad[x]) / (n - mass + a)) for x in good} for k in range(len(quality.RULES))]
    for r, v in zip(got, votes, strict=True):
        assert math.isclose(r["p_good"], posterior(v), abs_tol=1e-6)
        assert r["kept"] == (not r["base_failed"] and posterior(v) >= 0.5)


def test_mixing_targets(spark):
    """Water filling, one source at a time."""
    rng = random.Random(9)
    for _ in range(6):
        sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 40_000]) for i in range(rng.randrange(1, 7))}
        sized = spark.createDataFrame([(k, v) for k, v in sizes.items()] + [(None, 77)], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
        order = [*sorted(sizes), None]
        size = [*(sizes[k] for k in order[:-1]), 77]
        weight, target, budget, free = [(3, 1, 2)[i % 3] for i in range(len(order))], {}, 1.5 * sum(size), list(range(len(order)))
        while free:
            level = budget / sum(weight[i] for i in free)
            full = [i for i in free if level * weight[i] > 2 * size[i]]
            if not full:
                target |= {i: level * weight[i] for i in free}
                break
            for i in full:
                target[i] = 2.0 * size[i]
                budget -= target[i]
                free.remove(i)
        assert all(math.isclose(got[k], target[i], rel_tol=1e-9, abs_tol=1e-6) for i, k in enumerate(order))


def test_mixing_draws(spark, monkeypatch):
    """Shards' counts are what their slots drew, and they decide what the mix takes."""
    rng = random.Random(1)
    rows = [(i, prose(rng.randrange(100, 900), rng), "en", rng.choice("aabc"), 0) for i in range(120)]
    d = spark.createDataFrame(rows, DOCS)
    sized = d.select("source", F.size(shared.words(F.col("text"))).cast("long").alias("size"))
    parts = mixing.shares(mixing.targets(sized), 16)
    drawn = {(r["shard"], r["source_idx"]): r["n"] for r in mixing.draws(spark, parts, True, 7).collect()}
    share = sorted((r["_lo"], r["source_idx"]) for r in parts.collect())
    total = parts.first()["_all"]
    slot = spark.range(total).select(F.floor(F.col("id") / mixing.SHARD).alias("shard"), (F.col("id") % mixing.SHARD).cast("int").alias("t"))
    u = slot.select("shard", (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), F.lit(7), "shard", "t"), 11) / float(1 << 53)).alias("u")).collect()
    assert drawn == Counter((r["shard"], max(s for s in share if s[0] <= r["u"])[1]) for r in u)
    assert len({drawn[k, share[0][1]] for k in range(total // mixing.SHARD)}) > 1
    found = sorted(map(str, mixing.mix(d, block=16).collect()))
    even = lambda spark, parts, few, seed: parts.select(F.lit(0).cast("long").alias("shard"), "source_idx", F.col("_n").alias("n"))
    monkeypatch.setattr(mixing, "draws", even)
    assert sorted(map(str, mixing.mix(d, block=16).collect())) != found


def test_url_lists_beyond_a_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    hosts = [f"{a}.{b}.{t}" for a in "abc" for b in ("x", "y", "zz") for t in ("com", "net")]
    rules = [(".".join(h.split(".")[k:]), p, rng.choice(["allow", "block"])) for h in hosts for k in range(3) for p in ("/", "/en/", "/en/a") if rng.random() < 0.3]
    rules = sorted({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(['www.', ''])}{rng.choice(hosts)}{rng.choice(['/', '/en/', '/en/ab', '', '/de/'])}" for _ in range(300)] + [None, "nonsense", "http://"] * 4
    d = spark.createDataFrame([(i if i % 50 else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = url_filter.rules_table(spark, rules)
    small = sorted(map(str, url_filter.judge(d, table).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(url_filter, "BITS_A_KEY", 1)  # a filter that passes many keys that are no rule
    assert sorted(map(str, url_filter.judge(d, table).collect())) == small
    blocks = max(1, -(-len(rules) // 64))
    keys = spark.createDataFrame([(f"n{i}",) for i in range(2000)], "_rule string")
    known = table.select(F.concat("host", F.lit("\n"), "path").alias("_rule"))
    passed = url_filter._hashed(keys, "_rule", blocks).join(url_filter.bloom(known, blocks), "_block").filter("_word & _mask = _mask").count()
    assert passed > 20
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        want.append((i if i % 50 else None, host, path, best and best[0] + best[1], best[2] if best else "allow"))
    assert sorted(map(str, map(tuple, url_filter.judge(d, table).collect()))) == sorted(map(str, want))


def member(head, block):
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    info = member(["WARC/1.0", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n")
    got = member(["WARC/1.0", "WARC-Type: response", "WARC-Target-URI: http://a/", "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http;msgtype=response"], http)
    ask = member(["WARC/1.0", "WARC-Type: request", "WARC-Record-ID: <urn:uuid:3>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n")
    seen = member(["WARC/1.0", "WARC-Type: revisit", "WARC-Payload-Digest: sha1:ABC", "Content-Type: application/http"], b"HTTP/1.1 304 x\r\n\r\n")
    md5 = member(["WARC/1.0", "WARC-Type: resource", "WARC-Payload-Digest: md5:00", "Content-Type: text/plain"], b"plain")
    bad = member(["WARC/1.0", "WARC-Type: response", "WARC-Payload-Digest: sha1:ABC", "Content-Type: text/plain"], b"plain")
    junk = member(["nothing"], b"")
    at = tmp_path / "x.warc.gz"
    at.write_bytes(info + got + bad + junk + ask + seen + md5)
    r = warc.read_archives(spark.createDataFrame([(f"file://{at}",)], "path string")).collect()
    assert [(x["record_type"], x["payload_bytes"], x["error"] is None) for x in r] == [("warcinfo", 13, True), ("response", 9, True), (None, None, False), (None, None, False), ("request", 0, True), ("revisit", None, True), ("resource", 5, True)]
    assert r[1]["url"] == "http://a/" and all(x["path"].endswith("x.warc.gz") for x in r)
    at.write_bytes(info + got[:-9])
    assert [x["error"] is None for x in warc.read_archives(spark.createDataFrame([(f"file://{at}",)], "path string")).collect()] == [True, False]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(info + bad)))


def test_tree_prunes_clusters():
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.5, (60, 32))
    x = np.floor(64 * (middle[rng.integers(0, 60, 6000)] + rng.normal(0, 0.01, (6000, 32)))).astype(np.int64)
    ids, q = np.arange(6000), np.arange(0, 6000, 60)
    tree = mtree.Tree.load(mtree.Tree(ids, x, leaf=32).dump())
    at, vec, score = tree.search(q, x[q], 10)
    every = x[q] @ x.T
    every[np.arange(len(q)), q] = -(1 << 50)
    for i in range(len(q)):
        best = np.lexsort((ids, -every[i]))[:10]
        assert sorted(zip(-score[at == i], vec[at == i], strict=True)) == [(-every[i][j], j) for j in best]
    assert tree.computed < 0.2 * len(q) * 6000 and tree.closed > 0


def test_top_k_in_blocks(spark, monkeypatch):
    """Several shards, query blocks and vector lengths, and repeated rows."""
    monkeypatch.setattr(mtree, "SHARD_ROWS", 50)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 4)
    rng = np.random.default_rng(5)
    data = [(i, [float(v) for v in rng.normal(0, 0.3, 4 if i % 3 else 6)]) for i in range(200)]
    data += [data[20], data[21]]
    got = Counter(tuple(r) for r in mtree.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), k=5).collect())
    z = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data]
    want = Counter()
    for q, x in {i: x for i, x in z if i % 20 == 0}.items():
        s = sorted((-int(x @ y), i) for i, y in z if i != q and len(x) == len(y))[:5]
        want.update((q, k + 1, i, -n) for k, (n, i) in enumerate(s))
    assert got == want


def test_tokens_after_the_last_separator(spark, tmp_path):
    ids = np.array([5, 6, 2, 2, 7, 8, 9], token_files.ID)
    (tmp_path / "a.tokens").write_bytes(ids.tobytes())
    d = spark.createDataFrame([(f"file://{tmp_path}/a.tokens",)], "path string")
    for block in (1, 2, 3, 100):
        assert sorted((r["ordinal"], r["n_tokens"]) for r in token_files.count_tokens(d, 2, block).collect()) == [(0, 2), (1, 0), (2, 3)]


def test_pipeline_contents(spark, rows, tmp_path):
    """Every stage against brute force on what its predecessor kept; earlier stages' tables go."""
    import corpus_pipeline as P
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(12)
    extra = [(1000 + i, " ".join(f"{prose(12, rng)}." for _ in range(20)), "en", "s1", 0) for i in range(25)]
    passage = prose(60, rng)
    extra += [(2000 + i, f"{prose(60, rng)} {passage} {prose(60, rng)}", "en", "s2", 0) for i in range(6)]
    near = prose(200, rng)
    extra += [(3000 + i, f"{near} tail{i}", "en", "s2", 0) for i in range(5)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    steps = dict(P.STAGES)
    save = lambda df, name: (df.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]

    one = save(steps["quality_rules"](spark, docs, ""), "one")
    good = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    assert {r["doc_id"] for r in one.collect()} == good and {r[0] for r in extra} <= good

    two = save(steps["near_dedup"](spark, one, ""), "two")
    sets = {r["doc_id"]: shingles(r["text"]) for r in one.collect()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in two.collect()} == {k for k in sets if find(k) == k}

    three = save(steps["suffix_dedup"](spark, two, ""), "three")
    plain = [(r["doc_id"], r["text"]) for r in two.collect()]
    want = repeats(plain)
    got = {r["doc_id"]: len(r["text"].encode()) for r in three.collect()}
    assert all(got.get(k, 0) == v[0] - v[1] for k, v in want.items() if all(ord(x) < 128 for x in dict(plain)[k]))
    assert sum(v[1] > 0 for k, v in want.items() if k // 1000 == 2) == 5

    four = save(steps["mix_sources"](spark, three, ""), "four")
    taken = Counter()
    whole = {r["doc_id"]: re.findall(BLANK, r["text"]) for r in three.collect()}
    for r in four.collect():
        w = re.findall(BLANK, r["text"])
        taken[r["doc_id"]] += len(w)
        assert not Counter(w) - Counter(whole[r["doc_id"]])
    assert all(n <= 2 * len(whole[k]) for k, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(map(len, whole.values()))) < 200

    five = save(steps["sentencepiece"](spark, four, ""), "five")
    sp = SentencePieceProcessor(model_file=pieces.default_model())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in five.collect()) == Counter((r["doc_id"], (*sp.encode(r["text"]), 2)) for r in four.collect())

    shared.begin_stage(five, "after")
    assert shared._past == []


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
