"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across (before a run
of word marks, around line ends); equal words are encoded once.  All words
still at work lie in one flat symbol array.  A round looks up the rank of every
adjacent pair, takes each word's least rank by a segmented minimum, merges the
occurrences of that pair from the left at the same time, and compacts the
array; words without a pair left drop out.  A merged piece that some
better-ranked pair could swallow at once is merged at its leftmost occurrence
only, which keeps the order of the one-by-one algorithm.

In words that are long, pairs far apart don't wait for each other: no piece is
longer than L characters, so that what happens more than 2 L symbols away can't
reach a pair, nor the pieces that may swallow it, before its turn.  There a
pair is merged as soon as it ranks least within 2 L symbols, and so do the
better-ranked pairs that its piece makes possible (they follow at once in the
one-by-one algorithm, too).  A long word so takes about as many rounds as its
stretches do, not as it has merges.

Defined results: a null text is an empty text and has the end id alone;
repeated rows are encoded one by one; null ids pass through; characters
outside the vocabulary become their UTF-8 bytes' pieces; an empty table gives
an empty table; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import chunks, hashes
from .shared import batches

MARK = "▁"
NONE = np.int64(1) << 40
#: Bound of the per-process word table.
CACHE_WORDS = 1 << 18
PIECE_BYTES = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Table:
    """Open addressing from int64 keys to row numbers, filled and probed for whole arrays."""

    def __init__(self, room: int):
        self.bits = max(8, int(np.ceil(np.log2(max(1, room)))) + 2)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.row = np.zeros(1 << self.bits, np.int32)

    def insert(self, left: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that aren't in it yet."""
        at = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.key[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[at[won]], self.row[at[won]] = left[won], rows[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, rows, at = left[rest], rows[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key isn't there."""
        at = self._slot(keys)
        seen = self.key[at]
        out = np.where(seen == keys, self.row[at], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at_o = (at[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = at_o
            seen = self.key[at_o]
            hit = seen == keys[open_]
            out[open_[hit]] = self.row[at_o[hit]]
            open_ = open_[~hit & (seen != -1)]
        return out


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of ``data[start[i]:start[i] + size[i]]`` for i in ids, and the running ends."""
    n = size[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    where = np.repeat(start[ids] - (ends - n), n) + np.arange(total)
    return data[where], ends


def _strings(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


class Pieces:
    """A BPE vocabulary with byte pieces, from a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor  # reads the vocabulary; encodes nothing

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.n, self.end = n, sp.eos_id()
        text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(text[i][3:-1], 16)] = i
        merged = {text[i]: i for i in range(n) if not special[i] and not byte[i]}
        score = {p: sp.get_score(i) for p, i in merged.items()}
        symbol = dict(merged)
        for p in merged:  # characters that occur in pieces only
            for c in p:
                symbol.setdefault(c, len(symbol) + n)
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.base = np.int64(max(symbol.values()) + 2)
        order = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        ranks_of: dict[int, int] = {}
        for p in merged:
            ranks_of[order[score[p]]] = ranks_of.get(order[score[p]], 0) + (len(p) > 1)
        keys, rank, made, careful = [], [], [], {}
        for p, i in merged.items():
            if len(p) < 2:
                continue
            r = order[score[p]]
            if ranks_of[r] > 1:
                careful[i] = True
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbol and b in symbol:
                    keys.append(symbol[a] * int(self.base) + symbol[b])
                    rank.append(r)
                    made.append(i)
                    for x in (a, b):
                        if len(x) > 1 and order[score[x]] >= r:
                            careful[symbol[x]] = True
        self.pairs = Table(2 * len(keys))
        self.pairs.insert(np.array(keys, np.int64), np.arange(len(keys), dtype=np.int32))
        self.rank, self.made = np.array([*rank, NONE], np.int64), np.array([*made, -1], np.int32)
        self.careful = np.zeros(int(self.base), bool)
        self.careful[list(careful)] = True
        inside = {c for p in merged for c in p}
        self.reach = any(a != MARK and b == MARK for p in merged for a, b in zip(p, p[1:]))
        self.line_ends = "\n" not in inside
        self.radius = 2 * max(map(len, merged))
        plain = [b"" if special[i] else bytes([int(text[i][3:-1], 16)]) if byte[i] else text[i].replace(MARK, " ").encode() for i in range(n)]
        self.plain = _strings(plain)
        self.digits = _strings([b"%d " % i for i in range(n)])
        self.starts_blank = np.array([p.startswith(b" ") for p in plain])
        self.clear()
        # Runs of marks: where they merge last of all, and into the longest piece of marks again and again, that piece is a word of its own.
        marks = {len(p): order[score[p]] for p in merged if set(p) == {MARK} and len(p) > 1}
        self.tile, last, most = 0, max(order.values(), default=0), max(marks, default=0)
        alone = all(MARK * 2 not in p or set(p) == {MARK} for p in merged)
        if marks and alone and set(marks.values()) == {last} and all(set(p) == {MARK} for p in merged if order[score[p]] == last):
            ids, n = self.merge([MARK * k for k in range(1, 3 * most + 1)])
            runs = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            whole = runs[most - 1]
            if len(whole) == 1 and all(runs[k] == whole + runs[k - most] for k in range(most, 3 * most)):
                self.tile = most

    def clear(self) -> None:
        self.cache = Table(CACHE_WORDS)
        self.flat = np.zeros(0, np.int32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # The words themselves, as 8-byte chunks: equal hashes are no proof.
        self.chunk = np.zeros(0, np.uint64)
        self.chunk_at, self.chunk_n, self.bytes = (np.zeros(0, np.int64) for _ in range(3))

    def _words(self, b: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end in the joined texts."""
        mark = np.zeros(len(b) + 1, bool)
        mark[0], mark[stops] = True, True
        if not self.reach:
            blank = b == 32
            mark[1:-1] |= blank[1:] & ~blank[:-1]
            if self.tile and (at := np.flatnonzero(blank)).size:
                text = np.searchsorted(stops, at, "right")
                new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(text) > 0)])
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(at)))
                if n.max() > self.tile:
                    nth = np.arange(len(at)) - np.repeat(begin, n)
                    mark[at[(nth % self.tile == 0) & (np.repeat(n, n) - nth > self.tile)]] = True
            if self.line_ends:
                line = b == 10
                mark[:-1] |= line
                mark[1:] |= line
        cut = np.flatnonzero(mark)
        return cut[:-1], cut[1:]

    def _known(self, h: np.ndarray, chunk: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Cache rows of the words, -1 where the word isn't there: hashes find, bytes decide."""
        which = self.cache.find(h)
        at = np.flatnonzero(which >= 0)
        at = at[self.bytes[which[at]] == size[at]]
        same = np.full(len(which), -1, np.int32)
        if len(at):
            cached, ends = _gather(self.chunk, self.chunk_at, self.chunk_n, which[at])
            own = chunk if len(at) == len(h) else _gather(chunk, np.cumsum(n) - n, n, at)[0]
            good = np.logical_and.reduceat(cached == own, ends - n[at])
            same[at[good]] = which[at[good]]
        return same

    def _learn(self, words: list[str], chunk: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merge the words and store them; their cache rows."""
        ids, count = self.merge(words)
        rows = np.arange(len(self.size), len(self.size) + len(words), dtype=np.int32)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(count) - count])
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, count])
        self.chunk_at = np.concatenate([self.chunk_at, len(self.chunk) + np.cumsum(n) - n])
        self.chunk, self.chunk_n, self.bytes = np.concatenate([self.chunk, chunk]), np.concatenate([self.chunk_n, n]), np.concatenate([self.bytes, size])
        return rows

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        return code, self.char[code], np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and each word's number of ids."""
        code, sym, wid = self._symbols(words)
        sym = np.where(sym < 0, -2 - code, sym)  # out of the vocabulary: never merges
        done_sym, done_wid = [], []
        while len(sym):
            same = wid[1:] == wid[:-1]
            good = same & (sym[1:] >= 0) & (sym[:-1] >= 0)
            row = np.full(len(sym), -1, np.int32)
            at = np.flatnonzero(good)
            row[at] = self.pairs.find(sym[at].astype(np.int64) * self.base + sym[at + 1])
            rank = self.rank[row]
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(sym)))
            going = np.repeat(least < NONE, sizes)
            if not going.all():
                done_sym.append(sym[~going])
                done_wid.append(wid[~going])
                sizes = sizes[least < NONE]
                sym, wid, row, rank, least = sym[going], wid[going], row[going], rank[going], least[least < NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            careful = self.careful[self.made[row[hit]]]
            first = np.concatenate([[True], wid[hit[1:]] != wid[hit[:-1]]])
            hit = hit[first | ~self._in_careful(careful, first)]
            # Of overlapping occurrences (a run of one symbol) every second from the left.
            joined = np.concatenate([[False], np.diff(hit) == 1])
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(hit))))
            hit = hit[run % 2 == 0]
            alone = np.zeros(0, np.int64)
            if (sizes > self.radius).any():
                far = np.repeat(sizes > self.radius, sizes)
                at = np.flatnonzero(far)
                many, alone = self._near_minima(rank[at], wid[at], self.careful[self.made[row[at]]])
                hit, alone = np.concatenate([hit[~far[hit]], at[many], at[alone]]), at[alone]
            limit = rank[alone]
            sym, wid, place = self._joined(sym, wid, hit, self.made[row[hit]])
            if len(alone):
                sym, wid = self._swallowed(sym, wid, place[alone], limit)
        sym, wid = np.concatenate([np.zeros(0, np.int32), *done_sym]), np.concatenate([np.zeros(0, np.int32), *done_wid])
        order = np.argsort(wid, kind="stable")
        return self._to_ids(sym[order], wid[order], len(words))

    @staticmethod
    def _joined(sym: np.ndarray, wid: np.ndarray, hit: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arrays once the pairs that begin at ``hit`` are merged, and each old place's new one."""
        sym[hit] = made
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        return sym[keep], wid[keep], np.cumsum(keep) - 1

    def _near_minima(self, rank: np.ndarray, wid: np.ndarray, careful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that rank least within the radius in their words: those to be merged as they are, and those that need care and come first."""
        n = len(rank)
        key = (np.minimum(rank, 1 << 30) << 32) | np.arange(n)
        least = key.copy()
        for way in (1, -1):
            side, width = key.copy(), 1
            while width <= self.radius:  # doubled spans: at least the radius, at most twice that
                a, b = (slice(0, n - width), slice(width, n)) if way == 1 else (slice(width, n), slice(0, n - width))
                if n > width:
                    side[a] = np.where(wid[a] == wid[b], np.minimum(side[a], side[b]), side[a])
                width *= 2
            least = np.minimum(least, side)
        hit = (least >> 32 == np.minimum(rank, 1 << 30)) & (rank < NONE)
        alone = np.flatnonzero(hit & careful & (least == key))
        # A run of overlapping pairs is merged every second from its start, if the start and all up to there are hits.
        where = np.arange(n)
        start = np.ones(n, bool)
        start[1:] = (rank[1:] != rank[:-1]) | (wid[1:] != wid[:-1])
        start |= rank >= NONE
        begin = np.maximum.accumulate(np.where(start, where, 0))
        missed = np.cumsum(~hit)
        plain = hit & ~careful & ((where - begin) % 2 == 0) & (missed == missed[begin] - ~hit[begin])
        return np.flatnonzero(plain), alone

    def _swallowed(self, sym: np.ndarray, wid: np.ndarray, grown: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pieces at ``grown`` on while they have a pair that ranks at least as well as the merge that made them."""
        while len(grown):
            pairs = []
            for a in (grown - 1, grown):
                ok = (a >= 0) & (a + 1 < len(sym))
                x, y = np.where(ok, a, 0), np.where(ok, a + 1, 0)
                ok &= (wid[x] == wid[y]) & (sym[x] >= 0) & (sym[y] >= 0)
                row = np.full(len(a), -1, np.int32)
                row[ok] = self.pairs.find(sym[x[ok]].astype(np.int64) * self.base + sym[y[ok]])
                pairs.append((a, row, self.rank[row]))
            left = pairs[0][2] <= pairs[1][2]
            at, row, rank = (np.where(left, p, q) for p, q in zip(*pairs, strict=True))
            go = rank <= limit
            at, row, limit = at[go], row[go], limit[go]
            sym, wid, place = self._joined(sym, wid, at, self.made[row])
            grown = place[at]
        return sym, wid

    @staticmethod
    def _in_careful(careful: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether any occurrence in the same word needs care."""
        begin = np.flatnonzero(first)
        return np.repeat(np.logical_or.reduceat(careful, begin), np.diff(np.append(begin, len(first)))) if len(first) else careful

    def _to_ids(self, sym: np.ndarray, wid: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        odd = (sym < 0) | (sym >= self.n)
        if not odd.any():
            return sym.astype(np.int32), np.bincount(wid, minlength=n_words)
        names = {int(i): chr(c) for c, i in zip(*(lambda k: (k, self.char[k]))(np.flatnonzero(self.char >= self.n)), strict=True)}
        out, size = [], []
        for s in sym[odd].tolist():
            out.append((chr(-2 - s) if s < 0 else names[s]).encode("utf-8", "surrogatepass"))
        n = np.ones(len(sym), np.int64)
        n[odd] = [len(b) for b in out]
        ids = np.repeat(sym, n).astype(np.int32)
        ids[np.repeat(odd, n)] = self.byte_ids[np.frombuffer(b"".join(out), np.uint8)]
        del size
        return ids, np.bincount(np.repeat(wid, n), minlength=n_words)

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and each text's number of ids."""
        if len(self.size) > CACHE_WORDS:
            self.clear()
        parts = [b" " + t.replace(MARK, " ").encode() if t else b"" for t in texts]  # the mark itself stands for a blank
        data, stops = b"".join(parts), np.cumsum([len(p) for p in parts])
        if not data:
            ids, total = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        else:
            raw = np.frombuffer(data, np.uint8)
            first, last = self._words(raw, stops)
            size = last - first
            chunk, n = chunks(raw, first, size)
            h = (hashes(chunk, n, size) & np.uint64((1 << 63) - 1)).view(np.int64)
            which = self._known(h, chunk, n, size)
            miss = np.flatnonzero(which < 0)
            if len(miss):
                begin = np.cumsum(n) - n

                def learn(at: np.ndarray) -> np.ndarray:
                    return self._learn([data[a:b].decode().replace(" ", MARK) for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)], _gather(chunk, begin, n, at)[0], n[at], size[at])

                new, one = np.unique(h[miss], return_index=True)
                free = self.cache.find(new) < 0
                self.cache.insert(new[free], learn(miss[one[free]]))
                which[miss] = self._known(h[miss], _gather(chunk, begin, n, miss)[0], n[miss], size[miss])
                other = np.flatnonzero(which < 0)  # another word has their hash
                if len(other):
                    which[other] = learn(other)
            ids, ends = _gather(self.flat, self.at, self.size, which)
            upto = np.concatenate([[0], ends])[np.searchsorted(last, stops, "right")]
            total = np.diff(np.concatenate([[0], upto]))
        if end:
            ids = np.insert(ids, np.cumsum(total), self.end)
            total = total + 1
        return ids, total

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Each run's text: pieces' bytes joined, without the blank that stands before the first piece."""
        data, ends = _gather(*self.plain, ids)
        stop = np.concatenate([[0], ends])[np.cumsum(sizes)]
        start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        raw, out = data.tobytes(), []
        for a, b, i, n in zip(start.tolist(), stop.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            out.append(raw[a + (n > 0 and b > a and bool(self.starts_blank[ids[i]])) : b].decode("utf-8", "replace"))
        return out

    def id_strings(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Each run's ids in decimal, joined by single spaces."""
        data, ends = _gather(*self.digits, ids)
        stop = np.concatenate([[0], ends])[np.cumsum(sizes)].tolist()
        raw = data.tobytes()
        return [raw[a : max(a, b - 1)] for a, b in zip([0, *stop[:-1]], stop, strict=True)]


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_table(docs: DataFrame, model: str | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """keys, n_tokens, ids_sha256, decoded_sha256, and on demand the ids: one row a document, no shuffle."""
    model = model or default_model()
    source = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [f"`{k}` {t}" for k, t in source.dtypes if k != "_text"] + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches(it, "_text", PIECE_BYTES):
            texts = batch.column("_text").to_pylist()
            ids, n = pieces.encode(texts)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [batch.column(k) for k in keys]
            columns += [pa.array(n, pa.int64()), pa.array(map(sha, pieces.id_strings(ids, n)), pa.string()), pa.array((sha(t.encode()) for t in pieces.decode(ids, n)), pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return source.mapInArrow(run, ", ".join(fields))
