"""Near-duplicate documents: MinHash bands propose, odd sketches select, full sets confirm.

Documents with equal shingle sets are one class, led by the smallest id.  Of
the classes' MinHash samples each band of four is a bucket key; buckets are
dealt into blocks of bounded size.  Pairs are compared by their odd sketches
(parity bitmaps of MinHash samples; the XOR's population count gives the
similarity) within a task and are never written out as such.

1. Within each bucket's own blocks: the edges of a maximum spanning forest of
   the pairs that may be similar enough; of all buckets' edges each document's
   best one to a smaller and to a larger id, confirmed on full shingle sets.
   What is confirmed makes components.
2. Buckets in which more than one component is left, exactly: a bucket's
   largest component is one side, all others the other, and blocks meet except
   those of the first side with one another.  First the members are found that
   have a possible partner in another component, a pair being looked at only
   in the first band that it shares; then those members' full shingle sets come
   to the task, which confirms the pairs and gives the confirmed links that
   connect components: fewer than it has members.

A pair goes on to full sets unless its estimate is more than ``SLACK`` +
``STEPS`` / n below the threshold, n being the smaller set's size.  ``SLACK``
is four standard deviations of the sketch (0.0164 at most, by simulation over
sets of 28 to 21,000 shingles); the second part covers the skewed errors of
small sets, where one collision of samples is a step of 1 / n: of 20,000
simulated pairs at the threshold of each of eleven sizes from 7 to 350 none
fell below, nor came nearer than 0.02.  With 32 bands a pair at the threshold
shares a bucket with probability 1 - 5e-6.

Defined results: null and empty texts have no shingles and are linked with
nothing; rows with a null id are linked with nothing, have a null component and
are kept; rows with equal ids are one document and share a component; ties
don't arise (the smallest id leads); an empty table gives an empty table;
further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .components import components, joined
from .shared import batches, freed, saved

SLACK, STEPS = 0.07, 3.0
#: Members and bytes of full sets in a block; a task holds two blocks at most.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Estimates are kept as whole numbers of this fineness.
SCALE = 1 << 20
#: Pairs whose sketches are compared at a time.
STEP = 1 << 15
#: Confirmations with the same first document in one group.
FAN = 128
PIECE_BYTES = 1 << 20


def _signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, "text", PIECE_BYTES):
        h, n = S.shingle_sets([t.encode() for t in batch.column("text").to_pylist()])
        sketch, k = S.odd_sketches(h, n)
        band = S.bands(S.samples(h, n))
        offsets = pa.array(np.arange(0, len(n) * S.BANDS + 1, S.BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n.astype(np.int64)),
                pa.array(S.set_names(h, n), pa.binary()),
                pa.array(k.astype(np.int32)),
                pa.array([r.tobytes() for r in sketch], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(band.ravel())),
            ],
            ["doc_id", "n", "name", "k", "sketch", "bands"],
        )


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, name, k, sketch, bands of every document."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(_signed, "doc_id long, n long, name binary, k int, sketch binary, bands array<bigint>")


def _groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows in tables that end where a group ends; groups arrive together."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        if len(cuts):
            yield t.slice(0, int(cuts[-1]))
            held = t.slice(int(cuts[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _members(t: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    c = {x: t.column(x).to_numpy() for x in names}
    c["sketch"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    return c


def _tasks(c: dict[str, np.ndarray], keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups begin, and their sizes."""
    new = np.ones(len(c["id"]), bool)
    new[1:] = np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in keys])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(new)))


def _possible(a: np.ndarray, b: np.ndarray, c: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (a, b) may be similar enough, and their estimates."""
    na, nb = c["n"][a], c["n"][b]
    ok = np.flatnonzero((c["id"][a] != c["id"][b]) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)))
    est = np.empty(len(ok))
    for at in range(0, len(ok), STEP):
        x, y = a[ok[at : at + STEP]], b[ok[at : at + STEP]]
        est[at : at + STEP] = S.similarity(c["sketch"][x], c["k"][x], c["n"][x], c["sketch"][y], c["k"][y], c["n"][y])
    good = est >= least - STEPS / np.minimum(na, nb)[ok]
    return ok[good], est[good]


def _forests(least: float):
    """From members of blocks to pairs (a, b, est): a maximum spanning forest of each block's possible pairs."""

    def of_groups(size: int, rows: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """rows: groups x size, positions of members."""
        i, j = np.triu_indices(size, 1)
        step = max(1, STEP // len(i))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            a, b, group = part[:, i].ravel(), part[:, j].ravel(), np.repeat(np.arange(len(part)), len(i))
            ok, est = _possible(a, b, c, least)
            a, b, group = a[ok], b[ok], group[ok]
            if size > 2:
                order = np.lexsort((-est, group))
                root: dict[int, int] = {}

                def find(x: int, root=root) -> int:
                    while (y := root.get(x, x)) != x:
                        root[x] = root.get(y, y)
                        x = y
                    return x

                keep = []
                for p, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
                    if (x := find(x)) != (y := find(y)):
                        root[x] = y
                        keep.append(p)
                a, b, est = a[keep], b[keep], est[keep]
            yield np.minimum(c["id"][a], c["id"][b]), np.maximum(c["id"][a], c["id"][b]), (est * SCALE).astype(np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, ["key", "i"]):
            c = _members(t, ("key", "i", "id", "n", "k"))
            begin, size = _tasks(c, ("key", "i"))
            found = [x for s in np.unique(size) if s > 1 for x in of_groups(int(s), begin[size == s][:, None] + np.arange(s), c)]
            if found:
                seen = np.unique(np.column_stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(seen[:, k]) for k in range(3)], ["a", "b", "est"])

    return run


def _within_blocks(members: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b, est) from members (key, id, m: the bucket's size)."""
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("m") / BLOCK)).cast("int")
    rows = members.select("key", "id", block.alias("i")).join(reps.select(F.col("doc_id").alias("id"), "n", "k", "sketch"), "id")
    rows = rows.repartition("key", "i").sortWithinPartitions("key", "i", "id")
    return rows.mapInArrow(_forests(least), "a long, b long, est long").distinct()


def _meetings(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, band, i, j, side, id, label, n: the members of buckets with several components, once for each task that they take part in.

    In a task of two blocks (sides 1 and 2) the members of one block aren't
    compared: that is another task's part.
    """
    m = members.select("key", "band", "id").join(nodes, "id")
    parts = m.groupBy("key", "label").agg(F.count("*").alias("_m"), F.sum(8 * F.col("n")).alias("_b"))
    need = lambda m, b: F.greatest(F.ceil(F.col(m) / BLOCK), F.ceil(F.col(b) / BLOCK_BYTES))
    sums = parts.groupBy("key").agg(F.count("*").alias("_labels"), F.sum("_m").alias("_ms"), F.sum("_b").alias("_bs"), F.max(F.struct("_m", "label", "_b")).alias("_top")).filter("_labels > 1")
    sums = sums.select("key", F.col("_top.label").alias("_major"), F.col("_top._m").alias("_mt"), F.col("_top._b").alias("_bt"), "_ms", "_bs")
    sums = sums.withColumns({"_m2": F.col("_ms") - F.col("_mt"), "_b2": F.col("_bs") - F.col("_bt")})
    one = need("_ms", "_bs") == 1
    sums = sums.select("key", "_major", F.when(one, 0).otherwise(need("_mt", "_bt")).cast("int").alias("_g1"), F.when(one, 1).otherwise(need("_m2", "_b2")).cast("int").alias("_g2"))
    m = m.join(sums, "key")
    g1, g2, h = F.col("_g1"), F.col("_g2"), F.xxhash64("id", F.lit(3))
    major = (F.col("label") == F.col("_major")) & (g1 > 0)
    own = F.when(major, F.pmod(h, F.greatest(g1, F.lit(1)))).otherwise(g1 + F.pmod(h, g2)).cast("int")
    others = F.when(major, F.sequence(g1, g1 + g2 - 1)).otherwise(F.sequence(F.lit(0), g1 + g2 - 1))
    m = m.withColumn("_own", own).withColumn("_o", F.explode(others))
    side = F.when(F.col("_own") == F.col("_o"), 0).when(F.col("_own") < F.col("_o"), 1).otherwise(2)
    return m.select("key", "band", F.least("_own", "_o").alias("i"), F.greatest("_own", "_o").alias("j"), side.alias("side"), "id", "label", "n")


def _across(c: dict[str, np.ndarray], begin: int, size: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs of different components in one task, in pieces; each pair in the first band that it shares only."""
    at = np.arange(begin, begin + size)
    left, right = (at, at) if c["side"][begin : begin + size].max() == 0 else (at[c["side"][at] == 1], at[c["side"][at] == 2])
    if not len(left) or not len(right):
        return
    band = int(c["band"][begin])
    rows = max(1, 8 * STEP // len(right))
    for p in range(0, len(left), rows):
        a, b = np.repeat(left[p : p + rows], len(right)), np.tile(right, len(left[p : p + rows]))
        ok = c["label"][a] != c["label"][b]
        if left is right:
            ok &= a < b
        a, b = a[ok], b[ok]
        ok, _ = _possible(a, b, c, least)
        a, b = a[ok], b[ok]
        ok = ~(c["bands"][a, :band] == c["bands"][b, :band]).any(axis=1)
        yield a[ok], b[ok]


_TASK = ("key", "i", "j")


def _with_sketches(t: pa.Table) -> dict[str, np.ndarray]:
    c = _members(t, (*_TASK, "band", "side", "id", "label", "n", "k"))
    c["bands"] = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    return c


def _wanted(least: float):
    """The members that have a possible partner: key, band, i, j, side, id, label."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, list(_TASK)):
            c = _with_sketches(t)
            live = np.zeros(t.num_rows, bool)
            for begin, size in zip(*(x.tolist() for x in _tasks(c, _TASK)), strict=True):
                for a, b in _across(c, begin, size, least):
                    live[a], live[b] = True, True
            names = ("key", "band", "i", "j", "side", "id", "label")
            yield pa.RecordBatch.from_arrays([pa.array(c[x][live]) for x in names], list(names))

    return run


def _linked(least: float, percent: int):
    """Confirmed links (a, b) of different components: a spanning forest of each task's."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, list(_TASK)):
            c = _with_sketches(t)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            out: list[tuple[int, int]] = []
            for begin, size in zip(*(x.tolist() for x in _tasks(c, _TASK)), strict=True):
                # The task's shingles by number, so that membership is one look into an array.
                stop = np.cumsum([0, *(len(x) for x in sets[begin : begin + size])])
                values, number = np.unique(np.concatenate(sets[begin : begin + size]), return_inverse=True)
                mark = np.zeros(len(values), bool)
                root = np.unique(c["label"][begin : begin + size], return_inverse=True)[1]
                for a, b in _across(c, begin, size, least):
                    a, b = a - begin, b - begin
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], b[order]
                    for first, last in _stretches(a):
                        x, ys = int(a[first]), b[first:last]
                        ys = ys[root[ys] != root[x]]
                        if not len(ys):
                            continue
                        mark[number[stop[x] : stop[x + 1]]] = True
                        n = stop[ys + 1] - stop[ys]
                        ends = np.cumsum(n)
                        both = np.add.reduceat(mark[number[np.repeat(stop[ys] - (ends - n), n) + np.arange(int(ends[-1]))]].astype(np.int64), ends - n)
                        mark[number[stop[x] : stop[x + 1]]] = False
                        for y in ys[100 * both >= percent * (stop[x + 1] - stop[x] + n - both)].tolist():
                            if root[y] != root[x]:
                                root[root == root[y]] = root[x]
                                out.append((int(c["id"][begin + x]), int(c["id"][begin + y])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])

    return run


def _stretches(a: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(a, prepend=-1, append=-1)) if len(a) else np.zeros(1, np.int64)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _full(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, "text", PIECE_BYTES):
        h, n = S.shingle_sets([t.encode() for t in batch.column("text").to_pylist()])
        stop, raw = (8 * np.cumsum(n)).tolist(), h.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([raw[b - 8 * k : b] for b, k in zip(stop, n.tolist(), strict=True)], pa.binary())], ["id", "set"])


def _across_components(members: DataFrame, reps: DataFrame, nodes: DataFrame, docs: DataFrame, least: float, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components, enough to connect all that are linked."""
    signs = reps.select(F.col("doc_id").alias("id"), "k", "sketch", "bands")
    place = ["key", "i", "j"]
    rows = _meetings(members, nodes).join(signs, "id").repartition(*place).sortWithinPartitions(*place, "id")
    wanted = saved(rows.mapInArrow(_wanted(least), "key long, band int, i int, j int, side int, id long, label long"), "near-wanted")
    ids = wanted.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "id", "left_semi")
    full = texts.mapInArrow(_full, "id long, set binary").withColumn("n", F.octet_length("set") / 8).withColumn("n", F.col("n").cast("long"))
    full = saved(full.dropDuplicates(["id", "set"]), "near-full")
    rows = wanted.join(reps.select(F.col("doc_id").alias("id"), "n", "k", "sketch", "bands"), "id").join(full, ["id", "n"])
    rows = rows.repartition(*place).sortWithinPartitions(*place, "id")
    links = saved(rows.mapInArrow(_linked(least, percent), "a long, b long").distinct(), "near-links")
    freed(wanted, full)
    return links


def _best(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, est) each id's best one to a larger and to a smaller id: at most two an id, aggregated before the shuffle."""
    up = pairs.groupBy("a").agg(F.max(F.struct("est", (-F.col("b")).alias("_o"))).alias("_m")).select("a", (-F.col("_m._o")).alias("b"))
    down = pairs.groupBy("b").agg(F.max(F.struct("est", (-F.col("a")).alias("_o"))).alias("_m")).select((-F.col("_m._o")).alias("a"), "b")
    return up.unionByName(down).distinct()


def _confirmer(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple | None = None
        sets: list[np.ndarray] = []
        for batch in batches(it, "text", PIECE_BYTES):
            h, n = S.shingle_sets([t.encode() for t in batch.column("text").to_pylist()])
            stop = np.cumsum(n)
            a, part, b, kind = (batch.column(x).to_numpy() for x in ("a", "part", "b", "kind"))
            good = []
            for r in range(batch.num_rows):
                own = h[stop[r] - n[r] : stop[r]]
                if hub != (a[r], part[r]):
                    hub, sets = (a[r], part[r]), []
                if kind[r] == 0:
                    sets.append(own)
                    continue
                for other in sets:
                    at = np.searchsorted(other, own)
                    both = int((other[np.minimum(at, len(other) - 1)] == own).sum()) if len(other) else 0
                    if both and 100 * both >= percent * (len(own) + len(other) - both):
                        good.append(r)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.  Each group holds a document and up to about FAN partners."""
    ends = [pairs.select(F.col(end).alias("_id")).distinct() for end in ("a", "b")]
    ids = saved(ends[0].unionByName(ends[1]).distinct(), "near-ids")
    texts = saved(docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "_id", "left_semi"), "near-texts")
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("_parts"))
    p = saved(pairs.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("_parts"))).select("a", "part", "b"), "near-fans")
    rows = p.join(texts, F.col("b") == F.col("_id")).select("a", "part", "b", F.lit(1).alias("kind"), "text")
    hubs = p.select("a", "part").distinct().join(texts, F.col("a") == F.col("_id")).select("a", "part", F.col("a").alias("b"), F.lit(0).alias("kind"), "text")
    together = rows.unionByName(hubs).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    links = saved(together.mapInArrow(_confirmer(percent), "a long, b long").distinct(), "near-links")
    freed(ids, texts, p)
    return links


def link(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    sets = saved(signed(docs), "near-sets")
    named = sets.filter("n > 0 and doc_id is not null")
    classes = saved(named.groupBy("name").agg(F.min("doc_id").alias("cid")), "near-classes")
    lead = classes.select(F.col("cid").alias("doc_id"), "name")
    reps = saved(named.join(lead, ["doc_id", "name"], "left_semi").dropDuplicates(["doc_id", "name"]), "near-reps")
    sets, wide = saved(sets.select("doc_id", "n", "name"), "near-names"), sets
    freed(wide)
    keys = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    # Counted with partial sums: no key's rows meet in one task but in the join, whose hot keys can be split.
    members = saved(keys.join(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key"), "near-buckets")
    least = percent / 100 - SLACK
    pairs = saved(_best(saved(_within_blocks(members, reps, least), "near-found")), "near-pairs")
    labels = saved(components(confirmed(pairs, docs, percent)), "near-labels")
    nodes = reps.select(F.col("doc_id").alias("id"), "n").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    labels = saved(joined(labels, _across_components(members, reps, nodes, docs, least, percent)), "near-labels")
    led = classes.join(labels, F.col("cid") == F.col("id"), "left").select("name", F.coalesce("label", "cid").alias("component_id"))
    out = sets.select("doc_id", "n", "name").join(led, "name", "left")
    alone = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = saved(out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.coalesce(F.col("doc_id") == alone, F.lit(True)).alias("kept")), "near-result")
    freed(sets, classes, reps, members, pairs, labels)
    return out


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose document leads its component."""
    gone = link(docs, percent).filter(~F.col("kept")).select("doc_id").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id")
    return rows.join(gone, "doc_id", "left_anti").select("_row.*")
