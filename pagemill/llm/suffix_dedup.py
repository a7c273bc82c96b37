"""Removal of long repeated byte strings by suffix sorting, spread over a cluster.

A byte goes if some LENGTH-byte string over it also starts earlier (in a
document with a smaller id, or further up in the same one).  Each LENGTH-byte
window has an anchor, the least-hashed K-byte string in it, so that equal
windows have equal anchors at the same distance.

1. Documents with equal texts are one; all but the first are covered whole.
2. Anchors that occur once in the corpus are dropped: most of the text.
3. The windows around the others travel as contexts (the stretch of text whose
   windows share an anchor) to their anchor's hash and are suffix-sorted there,
   windows of equal distance from the anchor together; of equal windows all but
   the first are covered.  Contexts that are equal within a batch of documents
   are settled in place, and those that are equal at their anchor before the
   sort, their bytes compared; windows whose hash no other has at its anchor
   and distance aren't sorted.
4. An anchor with more than RUN contexts is dealt into runs, each sorted by a
   task of its own.  What is the first of its kind in its run goes on to the
   next level under a longer anchor: windows that reach ``step`` bytes further
   to the right, and the others, which reach as much further to the left.
   Copies of one passage so meet once a run, and different passages around a
   common anchor part; contexts alone at their new anchor are settled.  No task
   holds more than about a run.
5. Covered stretches are merged by document and cut out.

Defined results: null texts are empty; a null id orders after all others; rows
with one id and different texts are documents ordered by their texts' hash,
rows equal in both are one document and get one result; an empty table gives an
empty table; further columns don't matter (``cut`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .hashing import chunks, mix
from .near_dedup import _groups
from .shared import batches, freed, saved
from .suffixes import Text, minimizers, sort_segments

LENGTH, K = 100, 24
#: Contexts of one anchor that are sorted together; each is under twice LENGTH bytes.
RUN = 4096
PIECE_BYTES = 1 << 20


def _windows(texts: list[bytes], length: int, k: int) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, where each starts, all k-byte hashes; and for each window within a text: its start, its text, its anchor's place."""
    text = Text(b"".join(texts))
    n = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(n) - n
    h, anchor = minimizers(text, k, length - k + 1)
    count = np.maximum(n - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    start = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    return text, first, h, start, doc, anchor[start]


def _anchors(length: int, k: int):
    place = pa.struct([("doc", pa.int64()), ("pos", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text", PIECE_BYTES):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            _, first, h, _, doc, anchor = _windows(texts, length, k)
            keep = np.ones(len(anchor), bool)
            keep[1:] = anchor[1:] != anchor[:-1]
            pos, doc = anchor[keep], doc[keep]
            name = h[pos]
            order = np.argsort(name, kind="stable")
            name, pos, doc = name[order], pos[order], doc[order]
            ids = batch.column("key").to_numpy()
            lead = np.ones(len(name), bool)
            lead[1:] = name[1:] != name[:-1]
            own = pa.StructArray.from_arrays([pa.array(ids[doc[~lead]], pa.int64()), pa.array((pos - first[doc])[~lead].astype(np.int32))], fields=list(place))
            begin = np.flatnonzero(lead)
            extra = np.diff(np.append(begin, len(name))) - 1
            more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(extra)]).astype(np.int32)), own)
            yield pa.RecordBatch.from_arrays([pa.array(name[begin]), pa.array(ids[doc[begin]], pa.int64()), pa.array((pos - first[doc])[begin].astype(np.int32)), more], ["h", "doc", "pos", "more"])

    return run


_TYPES = {"kind": pa.int32(), "h": pa.int64(), "run": pa.int32(), "runs": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "doc": pa.int64(), "start": pa.int64(), "n": pa.int32(), "back": pa.int32(), "bytes": pa.binary()}
#: Kind 0 is a context of n windows whose anchor lies ``back`` bytes from its start; around the anchor's first byte ``lo`` bytes before and ``hi`` from there on are its own.  Kind 2 is a covered stretch of n bytes.
_ROW = "kind int, h long, run int, runs int, lo int, hi int, doc long, start long, n int, back int, bytes binary"


def _row_batch(**c) -> pa.RecordBatch:
    size = len(c["doc"])
    return pa.RecordBatch.from_arrays([pa.array(c[x], t) if x in c else pa.nulls(size, t) for x, t in _TYPES.items()], list(_TYPES))


def _alike(data: np.ndarray, at: np.ndarray, size: np.ndarray, pairs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether the bytes of order[k] and order[k - 1], of one size, are equal for each k of ``pairs``."""
    if not len(pairs):
        return np.zeros(0, bool)
    x, y = order[pairs], order[pairs - 1]
    one, n = chunks(data, at[x], size[x])
    return np.logical_and.reduceat(one == chunks(data, at[y], size[y])[0], np.cumsum(n) - n)


def _contexts(length: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text", PIECE_BYTES):
            texts = batch.column("text").to_pylist()
            text, first, h, start, doc, anchor = _windows(texts, length, k)
            ids = batch.column("key").to_numpy()
            runs = np.zeros(len(text.bytes) + 1, np.int32)
            sizes = pa.compute.list_value_length(batch.column("spots")).to_numpy()
            spots = batch.column("spots").flatten()
            runs[spots.field("pos").to_numpy() + np.repeat(first, sizes)] = spots.field("runs").to_numpy()
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(start)))
            use = runs[anchor[begin]] > 0
            begin, n = begin[use], n[use]
            if not len(begin):
                continue
            s, d, a = start[begin], doc[begin], anchor[begin]
            name = text.names(s, n + length - 1)
            order = np.lexsort((s, ids[d], a - s, n, name))
            same = np.zeros(len(order), bool)
            p, o = order[:-1], order[1:]
            same[1:] = (name[o] == name[p]) & (n[o] == n[p]) & ((a - s)[o] == (a - s)[p])
            twin = np.flatnonzero(same)
            same[twin] = _alike(text.bytes, s, n + length - 1, twin, order)
            gone, kept = order[same], order[~same]
            yield _row_batch(kind=np.full(len(gone), 2), h=name[gone] ^ ids[d[gone]], run=np.zeros(len(gone)), doc=ids[d[gone]], start=(s - first[d])[gone], n=n[gone] + length - 1)
            raw, r = text.bytes.tobytes(), runs[a[kept]]
            yield _row_batch(
                kind=np.zeros(len(kept)), h=h[a[kept]], run=_dealt(ids[d[kept]], (s - first[d])[kept], r), runs=r, lo=np.zeros(len(kept)), hi=np.full(len(kept), k), doc=ids[d[kept]], start=(s - first[d])[kept], n=n[kept], back=(a - s)[kept],
                bytes=[raw[x : x + y] for x, y in zip(s[kept].tolist(), (n[kept] + length - 1).tolist(), strict=True)],
            )

    return run


def _dealt(doc: np.ndarray, start: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Each context's run."""
    return (mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64)) % np.maximum(runs, 1).astype(np.uint64)).astype(np.int32)


def _stretches(doc: np.ndarray, start: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Kind 2 rows for covered windows; overlapping ones joined."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
        b = np.flatnonzero(new)
        last = np.append(b[1:], len(doc)) - 1
        yield _row_batch(kind=np.full(len(b), 2), doc=doc[b], start=start[b], n=start[last] - start[b] + length)


def _settled(length: int):
    """From contexts, run by run: covered stretches, and the contexts for the next level."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, ["h", "run", "kind"]):
            kind = t.column("kind").to_numpy()
            if (kind == 2).any():
                yield from t.filter(pa.array(kind == 2)).combine_chunks().to_batches()
            if (kind == 0).any():
                yield from _by_suffix(t.filter(pa.array(kind == 0)), length)

    return run


def _packed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the column ``bytes``, where each row's begin, and their number."""
    c = pa.concat_arrays(t.column("bytes").chunks)
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    return np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def _copies(text: Text, off: np.ndarray, size: np.ndarray, group: np.ndarray, n: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Whether a context, of those in order, equals an earlier one of its group whole, its bytes compared."""
    name = text.names(off, size) ^ mix((n * 1024 + back).astype(np.uint64)).view(np.int64)
    order = np.lexsort((name, group))
    p, o = order[:-1], order[1:]
    twin = np.flatnonzero((group[o] == group[p]) & (name[o] == name[p]) & (n[o] == n[p]) & (back[o] == back[p])) + 1
    out = np.zeros(len(order), bool)
    out[order[twin]] = _alike(text.bytes, off, size, twin, order)
    return out


def _met(key: np.ndarray) -> np.ndarray:
    """Whether a value, of those in order, occurs more than once."""
    out = np.zeros(len(key), bool)
    eq = key[1:] == key[:-1]
    out[1:] |= eq
    out[:-1] |= eq
    return out


def _by_suffix(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    h, run, doc, start = (t.column(x).to_numpy() for x in ("h", "run", "doc", "start"))
    group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (run[1:] != run[:-1])]))
    met = np.bincount(group)[group]
    runs = t.column("runs").to_numpy()
    # Contexts alone at their anchor are settled.
    use = np.flatnonzero((met > 1) | (runs > 1))
    use = use[np.lexsort((start[use], doc[use], group[use]))]
    if not len(use):
        return
    t, group = t.take(pa.array(use)), group[use]
    col = lambda x: t.column(x).to_numpy().astype(np.int64)
    n, back, doc, start = (col(x) for x in ("n", "back", "doc", "start"))
    data, off, size = _packed(t)
    text = Text(data)
    copy = _copies(text, off, size, group, n, back)
    yield _row_batch(kind=np.full(int(copy.sum()), 2), doc=doc[copy], start=start[copy], n=size[copy])
    # Of equal contexts the first stays, and what is then alone at its anchor is settled, too.
    alone = np.bincount(group[~copy], minlength=int(group[-1]) + 1)[group] == 1
    sort = np.flatnonzero(~copy & ~alone)
    c = np.repeat(sort, n[sort])
    j = np.arange(len(c)) - np.repeat(np.cumsum(n[sort]) - n[sort], n[sort])
    # Contexts are in order, and so are windows of one anchor and distance.
    key = group[c] * (length + 1) + back[c] - j
    order = np.argsort(key, kind="stable")
    key_o = key[order]
    # Windows alone at their anchor and distance are settled, and so are those with a hash of their own there.
    order = order[_met(key_o)]
    name = mix(text.names((off[c] + j)[order], length).view(np.uint64) ^ key[order].astype(np.uint64))
    by = np.argsort(name)
    twin = np.zeros(len(order), bool)
    twin[by] = _met(name[by])
    order = order[twin]
    place, same = sort_segments(text, (off[c] + j)[order], length, key[order])
    hit = order[place[same]]
    yield from _stretches(doc[c[hit]], (start[c] + j)[hit], length)
    # First in a run of several: on to the next level.
    alive = (col("runs") > 1) & ~copy
    if not alive.any():
        return
    gone = np.zeros(int(n.sum()), bool)
    gone[((np.cumsum(n) - n)[c] + j)[hit]] = True
    c = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
    alive = alive[c] & ~gone
    lo, hi = col("lo"), col("hi")
    step = np.maximum((length - lo - hi) // 2, 0)
    step = np.minimum(step, (length - 24) // 4)
    right = (j - back[c] + length >= (hi + step)[c]) | (step == 0)[c]
    live = np.flatnonzero(alive)
    if not len(live):
        return
    new = np.ones(len(live), bool)
    new[1:] = (np.diff(live) > 1) | (c[live[1:]] != c[live[:-1]]) | (right[live[1:]] != right[live[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(live)))
    x, at, r = c[live[begin]], j[live[begin]], right[live[begin]]
    lo, hi = np.where(r, lo[x], lo[x] + step[x]), np.where(r, hi[x] + step[x], hi[x])
    name = text.names(off[x] + back[x] - lo, lo + hi) ^ r
    raw = data.tobytes()
    yield _row_batch(
        kind=np.zeros(len(x)), h=name, lo=lo, hi=hi, doc=doc[x], start=start[x] + at, n=size, back=back[x] - at,
        bytes=[raw[p : p + m] for p, m in zip((off[x] + at).tolist(), (size + length - 1).tolist(), strict=True)],
    )


def _bytes(docs: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", body.alias("text"), F.sha2(body, 256).alias("sha"))


class Corpus:
    """Tables on the documents that later steps share."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.rows = saved(_bytes(docs).select("doc_id", "sha", F.length("text").cast("bigint").alias("n_bytes")), "suffix-rows")
        classes = self.rows.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("doc_id"))
        # Rows of one id with different texts: numbered, so that every text has a key of its own.
        spread = F.coalesce(F.col("doc_id"), F.xxhash64("sha"))
        nth = F.row_number().over(W.partitionBy("doc_id", spread).orderBy("sha")) - 1
        self.known = classes = saved(classes.withColumn("_nth", nth), "suffix-classes")
        n, ids, most = classes.agg(F.count("*"), F.countDistinct("doc_id"), F.coalesce(F.max("_nth"), F.lit(0))).first()
        total = self.rows.count()
        self.plain = n == ids and total == self.rows.agg(F.countDistinct("doc_id")).first()[0]
        null_key = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("sha"), 2)
        key = F.col("doc_id") if most == 0 else F.col("doc_id") * (most + 1) + F.col("_nth")
        self.classes = classes.select("sha", "doc_id", F.coalesce(key, null_key).alias("key"))

    def keyed(self, columns: DataFrame) -> DataFrame:
        """The first row of each text, of ``columns`` (with text, sha and doc_id), with its key."""
        if self.plain:
            copies = self.rows.join(self.classes, ["sha", "doc_id"], "left_anti").select(F.col("doc_id").alias("key"))
            return columns.withColumn("key", F.col("doc_id")).join(copies, "key", "left_anti")
        c = self.classes.select(F.col("sha").alias("_sha"), F.col("doc_id").alias("_id"), "key")
        return columns.join(c, (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_sha", "_id").dropDuplicates(["key"])

    def texts(self) -> DataFrame:
        """key, text of the distinct texts."""
        return self.keyed(_bytes(self.docs)).select("key", "text")

    def free(self) -> None:
        freed(self.rows, self.known)


def covered(corpus: Corpus, length: int = LENGTH, k: int = K, run: int = RUN) -> DataFrame:
    """key, spans (array of start, n): the covered stretches of each text that has any."""
    seen = corpus.texts().mapInArrow(_anchors(length, k), "h long, doc long, pos int, more array<struct<doc:bigint,pos:int>>")
    seen = saved(seen, "suffix-seen")
    total = seen.groupBy("h").agg(F.sum(F.size("more") + 1).alias("_n")).filter("_n > 1")
    each = seen.join(total, "h").select(F.ceil(F.col("_n") / run).cast("int").alias("runs"), F.explode(F.concat(F.array(F.struct("doc", "pos")), "more")).alias("p"))
    spots = saved(each.groupBy(F.col("p.doc").alias("key")).agg(F.collect_list(F.struct("p.pos", "runs")).alias("spots")), "suffix-anchors")
    freed(seen)
    rows = corpus.texts().join(spots, "key").select("key", "text", "spots").mapInArrow(_contexts(length, k), _ROW)
    parts = []
    while True:
        done = saved(rows.repartition("h", "run").sortWithinPartitions("h", "run", "kind").mapInArrow(_settled(length), _ROW), "suffix-level")
        parts.append(done)
        left = done.filter("kind = 0")
        if left.isEmpty():
            break
        # Contexts alone at their new anchor are settled.  Anchors that can't grow any more are merged in fewer and fewer runs.
        share = F.when(F.col("lo") + F.col("hi") + 1 < length, run).otherwise(run << len(parts))
        sums = left.groupBy("h").agg(F.count("*").alias("_n"), F.max(share).alias("_share")).filter("_n > 1").select("h", F.ceil(F.col("_n") / F.col("_share")).cast("int").alias("_runs"))
        rows = left.join(sums, "h").withColumn("runs", F.col("_runs")).withColumn("run", F.pmod(F.xxhash64("doc", "start"), F.col("_runs")).cast("int")).select(*_TYPES)
    freed(spots)
    spans = [p.filter("kind = 2").select("doc", "start", F.col("n").cast("long").alias("n")) for p in parts]
    every = reduce(DataFrame.unionByName, spans)
    out = saved(every.groupBy(F.col("doc").alias("key")).agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans")), "suffix-spans")
    freed(*parts)
    return out


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        a, b = s["start"], s["start"] + s["n"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _cutter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n_removed, n_spans, kept_sha256, kept: of texts with covered stretches."""
    for batch in batches(it, "text", PIECE_BYTES):
        removed, count, sha, kept = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs = _merged(spans)
            rest = _kept(text, runs)
            removed.append(len(text) - len(rest))
            count.append(len(runs))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def _shortened(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows as they came, and ``new``: the remaining text, without characters cut in two; null where nothing is covered."""
    for batch in batches(it, "text", PIECE_BYTES):
        new = [None if spans is None else _kept(text, _merged(spans)).decode("utf-8", "ignore") for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], ["row", "new"])


def _with_keys(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """``key`` of the first row of each text, null for copies."""
    c = corpus.classes.select(F.col("sha").alias("_sha"), F.col("doc_id").alias("_id"), "key")
    return rows.join(c, (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_sha", "_id")


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    corpus = Corpus(docs)
    spans = covered(corpus, length)
    done = corpus.texts().join(spans, "key").select("key", "text", "spans").mapInArrow(_cutter, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary").drop("kept")
    out = _with_keys(corpus.rows, corpus).join(done, "key", "left")
    whole = F.col("key").isNull() & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the covered bytes; characters cut in two go, and so do documents of which nothing is left.

    ``n_chars``, where there is such a column, is brought up to date; all other columns stay, whatever they are called.
    Copies of texts of under ``length`` bytes stay as they are.
    """
    corpus = Corpus(docs)
    spans = covered(corpus, length)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if corpus.plain:  # a key is a document id: one exchange for both joins
        keyed = whole.withColumn("key", F.col("doc_id"))
        copies = corpus.rows.join(corpus.classes, ["sha", "doc_id"], "left_anti").filter(F.col("n_bytes") >= length).select(F.col("doc_id").alias("key"))
        rows = keyed.join(copies, "key", "left_anti").join(spans, "key", "left")
    else:
        keyed = _with_keys(whole.withColumn("sha", F.sha2("text", 256)), corpus)
        rows = keyed.filter(F.col("key").isNotNull() | (F.length("text") < length)).join(spans, "key", "left")
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.select("row", "text", "spans").mapInArrow(_shortened, f"row {kind}, new string").filter(F.col("new").isNull() | (F.col("new") != ""))
    fresh = {"text": F.col("new"), "n_chars": F.length("new").cast("bigint")}
    field = lambda c: F.col("row").getField(c)
    return out.select(*[(F.when(F.col("new").isNotNull(), fresh[c]).otherwise(field(c)) if c in fresh else field(c)).alias(c) for c in docs.columns])
