"""Long exact spans shared between records (problem 9), by super-k-mer partitioning.

Every window of ``length`` characters has a minimiser: the least hash of the ``seed``-character strings in it.
Consecutive windows with one minimiser form a super-k-mer, and equal windows have equal minimisers, so that they meet in
the minimiser's bucket. Steps that keep the traffic small without losing a window:

1. Minimisers are counted (each worker combines its own); those seen in one record only are dropped.
2. The super-k-mers left are cut out of their records as one packed string each. Equal strings are one class: a worker
   sends a string on once, and for each place only the class, record and start.
3. A bucket sorts the windows of its classes by a rolling hash, compares equal hashes as strings, and says which classes
   have windows in common, as groups with members. Buckets with many super-k-mers are divided by a second minimiser,
   which equal windows share as well; where even then a bucket has very many different strings, their windows are spread
   by their digests instead.
4. Members of a group are joined with the places of their classes. Pairs are made at the very end, by an equi-join.

Exact copies of a text are found first by digest, and one record stands for them. Classes and groups are named by
128-bit digests.

Defined results: characters are code points, compared exactly; null and shorter texts share nothing; a span that
repeats within one record only is not shared; repeated ids are taken for one record.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrow import strings
from textloom.session import cut

LENGTH = 200
SEED = 80
#: A bucket with more super-k-mers than this is divided by a second minimiser; one with more different strings by windows.
HOT, VERY_HOT = 20_000, 200_000
#: Up to so many shared minimisers (9 bytes each) are sent to the workers; more are joined as a table.
BROADCAST_ROWS = 500_000

_BASE = np.uint64(6364136223846793005)
_INVERSE = np.uint64(pow(6364136223846793005, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD1B54A32D192ED03)
_BLOCK = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def _scatter(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point, so that low bits of the polynomials are as good as the high ones."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= _SECOND
    x ^= x >> np.uint64(32)
    return x


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each string of k code points, by polynomials modulo 2**64."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_scatter(codes) * _powers(_BASE, n), out=sums[1:])
    x = (sums[k:] - sums[:-k]) * _powers(_INVERSE, n)[: n - k + 1]
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, in linear time."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def super_kmers(seeds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer, from the seeds' hashes."""
    least = sliding_min(seeds, length - seed + 1)
    if not len(least):
        return least, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[starts], starts, np.diff(np.r_[starts, len(least)])


def _grouped(texts: list[str | None], length: int) -> Iterator[list[int]]:
    """Indices of texts that are long enough, so many at a time that they are hashed in one go."""
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        if group and size + len(t) > _BLOCK:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group


def _super_kmers_of(texts: list[str], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Minimiser, text, start and number of windows of the super-k-mers of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    first = ends - sizes
    seeds = rolling(_codes("".join(texts)), seed)
    least = sliding_min(seeds, length - seed + 1)
    positions = np.arange(len(least))
    owner = np.searchsorted(ends, positions, "right")
    inside = positions + length <= ends[owner]
    starts = np.flatnonzero(inside & np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    # A run ends before the next start or the last window of its text.
    after = np.minimum(np.r_[starts[1:], len(least)], ends[owner[starts]] - length + 1)
    return least[starts].view(np.int64), owner[starts], starts - first[owner[starts]], after - starts


def _minimisers(length: int, seed: int):
    """(doc, text) -> (mini, a, b, k): minimisers with their least and greatest record, combined for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(zero_copy_only=False), strings(batch.column(1))
            minis, owners = [], []
            for group in _grouped(texts, length):
                mini, owner, _, _ = _super_kmers_of([texts[i] for i in group], length, seed)
                minis.append(mini)
                owners.append(docs[np.array(group)][owner])
            if not minis:
                continue
            mini, doc = np.concatenate(minis), np.concatenate(owners)
            order = np.argsort(mini, kind="stable")
            mini, doc = mini[order], doc[order]
            bounds = np.flatnonzero(np.r_[True, mini[1:] != mini[:-1]])
            columns = [mini[bounds], np.minimum.reduceat(doc, bounds), np.maximum.reduceat(doc, bounds), np.diff(np.r_[bounds, len(mini)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mini", "a", "b", "k"])

    return run


def _places(length: int, seed: int):
    """(doc, text) -> (mini, doc, start, n) of the super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(zero_copy_only=False), strings(batch.column(1))
            for group in _grouped(texts, length):
                mini, owner, start, n = _super_kmers_of([texts[i] for i in group], length, seed)
                yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array(docs[np.array(group)][owner]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["mini", "doc", "start", "n"])

    return run


_PARTS = pa.schema([("mini", pa.int64()), ("sub", pa.int64()), ("cls", pa.binary()), ("doc", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("part", pa.string())])
_PARTS_DDL = "mini bigint, sub bigint, cls binary, doc bigint, start int, size int, part string"
#: Classes that a worker remembers to have sent; beyond, it may send a string again.
_REMEMBERED = 200_000


class Packer:
    """Rows of packed strings; the string itself stands in the first row of its class only."""

    def __init__(self, length: int, seed: int) -> None:
        self.length, self.seed, self.sent, self.rows = length, seed, set(), []

    def add(self, doc: int, text: str, mini: int, start: int, n: int, hot: bool, second: list) -> None:
        if not hot:
            self._add(mini, 0, doc, start, text[start : start + n + self.length - 1])
            return
        if not second:
            second.append(sliding_min(rolling(_codes(text), self.seed) * _SECOND ^ _MIX, self.length - self.seed + 1))
        own = second[0][start : start + n]
        cuts = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), n]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            self._add(mini, int(own[a].view(np.int64)), doc, start + a, text[start + a : start + b + self.length - 1])

    def _add(self, mini: int, sub: int, doc: int, start: int, part: str) -> None:
        cls = blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        new = cls not in self.sent
        if new:
            if len(self.sent) >= _REMEMBERED:
                self.sent.clear()
            self.sent.add(cls)
        self.rows.append((mini, sub, cls, doc, start, len(part), part if new else None))

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _PARTS)], schema=_PARTS)
            self.rows = []


def _cut_known(length: int, seed: int, known: np.ndarray, hot: np.ndarray):
    """(doc, text) -> packed strings of the super-k-mers whose minimiser is among the sorted ``known`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, seed)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for group in _grouped(texts, length):
                mini, owner, start, n = _super_kmers_of([texts[i] for i in group], length, seed)
                at = np.minimum(np.searchsorted(known, mini), len(known) - 1)
                kept = np.flatnonzero(known[at] == mini)
                second: list = []
                last = -1
                for m, o, s, k, h in zip(mini[kept].tolist(), owner[kept].tolist(), start[kept].tolist(), n[kept].tolist(), hot[at[kept]].tolist()):
                    if o != last:
                        second, last = [], o
                    packer.add(docs[group[o]], texts[group[o]], m, s, k, h, second)
                yield from packer.take(20_000)
        yield from packer.take()

    return run


def _cut_out(length: int, seed: int):
    """(doc, text, list of (mini, start, n, hot)) -> packed strings of these super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, seed)
        for batch in batches:
            for doc, text, places in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist()):
                second: list = []
                for p in places:
                    packer.add(doc, text, p["mini"], p["start"], p["n"], p["hot"], second)
                yield from packer.take(20_000)
        yield from packer.take()

    return run


class Windows:
    """All windows of the classes of some whole buckets; equal windows of several classes stand together.

    Equal windows have one minimiser, so that sorting several buckets at once mixes none of them up.
    """

    def __init__(self, parts: list[str], length: int) -> None:
        self.length, self.text = length, "".join(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - length + 1, 0)
        owner = np.repeat(np.arange(len(parts)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[owner]
        hashes = rolling(_codes(self.text), length)[at]
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        repeated = ~(new & np.r_[new[1:], True])
        order, new = order[repeated], new[repeated]
        self.at, self.row = at[order], owner[order]
        self.group = np.cumsum(new) - 1
        self._compare(np.flatnonzero(new))
        self._drop_single()

    def _compare(self, bounds: np.ndarray) -> None:
        """Compares each window with the first of its group, many consecutive ones at a time; equal hashes of others are told apart."""
        if not len(bounds):
            return
        begin = self.at[bounds][self.group]
        order = np.argsort(self.at, kind="stable")
        at, begin = self.at[order], begin[order]
        cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (begin[1:] != begin[:-1] + 1)])
        lasts = np.r_[cuts[1:], len(at)] - 1
        text, length = self.text, self.length
        wrong = [(i, j) for i, j in zip(cuts.tolist(), lasts.tolist()) if at[i] != begin[i] and text[at[i] : at[j] + length] != text[begin[i] : begin[j] + length]]
        differ = [k for i, j in wrong for k in range(i, j + 1) if text[at[k] : at[k] + length] != text[begin[k] : begin[k] + length]]
        if differ:
            groups = np.unique(self.group[order[np.array(differ)]])
            number = int(self.group.max()) + 1
            named: dict[tuple[int, str], int] = {}
            for k in np.flatnonzero(np.isin(self.group, groups)).tolist():
                name = (int(self.group[k]), text[self.at[k] : self.at[k] + length])
                self.group[k] = named.setdefault(name, number + len(named))
            order = np.argsort(self.group, kind="stable")
            self.at, self.row, self.group = self.at[order], self.row[order], self.group[order]

    def _drop_single(self) -> None:
        """Groups within one class say nothing."""
        if len(self.at):
            bounds = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
            which = np.cumsum(np.r_[False, self.group[1:] != self.group[:-1]])
            shared = (np.minimum.reduceat(self.row, bounds) != np.maximum.reduceat(self.row, bounds))[which]
            self.at, self.row, self.group = self.at[shared], self.row[shared], self.group[shared]

    def members(self) -> Iterator[tuple[list[int], list[tuple[int, int, int]]]]:
        """Each set of classes that have windows in common, with the stretches (class, start, end) of these windows."""
        if not len(self.at):
            return
        order = np.lexsort((self.row, self.group))
        group, row = self.group[order], self.row[order]
        once = np.r_[True, (group[1:] != group[:-1]) | (row[1:] != row[:-1])]
        group, row = group[once], row[once]
        bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[bounds[1:], len(group)]
        names = np.stack([np.add.reduceat(_scatter(row), bounds), np.add.reduceat(_scatter(row * 7919 + 3), bounds)], axis=1)
        _, chosen, of = np.unique(names, axis=0, return_index=True, return_inverse=True)
        which = of.ravel()[np.cumsum(np.r_[False, self.group[1:] != self.group[:-1]])]
        order = np.lexsort((self.at, which))
        which, at, own = which[order], self.at[order], self.row[order]
        cuts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])])
        lasts = np.r_[cuts[1:], len(at)] - 1
        starts = at[cuts] - self.first[own[cuts]]
        stretches = list(zip(own[cuts].tolist(), starts.tolist(), (starts + at[lasts] - at[cuts] + self.length).tolist()))
        edges = np.searchsorted(which[cuts], np.arange(len(chosen) + 1)).tolist()
        for number, g in enumerate(chosen.tolist()):
            yield row[bounds[g] : ends[g]].tolist(), stretches[edges[number] : edges[number + 1]]


_FOUND = pa.schema([("gid", pa.binary()), ("cls", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])
_FOUND_DDL = "gid binary, cls binary, low int, high int"
#: Characters of whole buckets that are sorted in one go.
_AT_ONCE = 1 << 20


def _found(classes: list[bytes], parts: list[str], length: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for members, stretches in Windows(parts, length).members():
        gid = blake2b(b"".join(sorted(classes[m] for m in members)), digest_size=16).digest()
        rows += [(gid, classes[m], low, high) for m, low, high in stretches]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


def _buckets(length: int):
    """(mini, sub, cls, part) sorted so -> groups; whole buckets are taken together up to a size, each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, size = None, None, 0
        classes: list[bytes] = []
        parts: list[str] = []
        for batch in batches:
            for mini, sub, cls, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (mini, sub) != key:
                    key, last = (mini, sub), None
                    if size > _AT_ONCE:
                        yield from _found(classes, parts, length)
                        classes, parts, size = [], [], 0
                if cls != last:
                    last = cls
                    classes.append(cls)
                    parts.append(part)
                    size += len(part)
        if parts:
            yield from _found(classes, parts, length)

    return run


def _each_window(length: int):
    """(mini, sub, cls, part) -> every window of the string as a group named by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, part in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = len(part) - length + 1
                names = [blake2b(part[i : i + length].encode("utf-8", "surrogatepass"), digest_size=16, person=b"window").digest() for i in range(n)]
                at = np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([cls] * n, pa.binary()), pa.array(at), pa.array(at + np.int32(length))], schema=_FOUND)

    return run


def copies(docs: DataFrame, length: int) -> DataFrame:
    """(rep, doc) of texts that stand more than once, kept on disk; rep is the least id of the class."""
    keyed = docs.where(F.char_length("text") >= length).select("doc", F.md5("text").alias("digest"))
    several = keyed.groupBy("digest").agg(F.min("doc").alias("rep"), F.max("doc").alias("most")).where("rep < most").select("digest", "rep")
    return cut(keyed.join(several, "digest").select("rep", "doc").distinct())


def _members(docs: DataFrame, same: DataFrame, length: int, seed: int, hot: int, very_hot: int, broadcast_rows: int) -> DataFrame:
    """(gid, doc, start, end): stretches of records and the group of records that share each; a group may be of one record."""
    rest = docs.select("doc", "text")
    removed = same.where("doc <> rep").select("doc")
    if (n := removed.limit(broadcast_rows + 1).count()) > 0:
        rest = rest.join(F.broadcast(removed) if n <= broadcast_rows else removed, "doc", "left_anti")
    counted = rest.mapInArrow(_minimisers(length, seed), "mini bigint, a bigint, b bigint, k bigint")
    shared = cut(counted.groupBy("mini").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("k").alias("k")).where("a < b").select("mini", "k"))
    few = shared.limit(broadcast_rows + 1).collect()
    if not few:
        return docs.sparkSession.createDataFrame([], "gid binary, doc bigint, start int, end int")
    if len(few) <= broadcast_rows:
        few.sort()
        known = np.array([r["mini"] for r in few], np.int64)
        parts = rest.mapInArrow(_cut_known(length, seed, known, np.array([r["k"] > hot for r in few])), _PARTS_DDL)
    else:
        places = rest.mapInArrow(_places(length, seed), "mini bigint, doc bigint, start int, n int")
        kept = places.join(shared.select("mini", (F.col("k") > hot).alias("hot")), "mini")
        by_doc = kept.groupBy("doc").agg(F.collect_list(F.struct("mini", "start", "n", "hot")).alias("places"))
        parts = rest.join(by_doc, "doc").select("doc", "text", "places").mapInArrow(_cut_out(length, seed), _PARTS_DDL)
    parts = cut(parts)
    strings_of = parts.where("part is not null").select("mini", "sub", "cls", "part")
    spread = None
    if shared.where(F.col("k") > very_hot).limit(1).count():
        crowded = cut(strings_of.groupBy("mini", "sub").agg(F.count("*").alias("k")).where(F.col("k") > very_hot).select("mini", "sub"))
        spread = strings_of.join(crowded, ["mini", "sub"], "left_semi").mapInArrow(_each_window(length), _FOUND_DDL).distinct()
        strings_of = strings_of.join(crowded, ["mini", "sub"], "left_anti")
    buckets = strings_of.repartition("mini", "sub").sortWithinPartitions("mini", "sub", "cls")
    groups = buckets.mapInArrow(_buckets(length), _FOUND_DDL)
    if spread is not None:
        groups = groups.unionByName(spread)
    # A class of several records is a group of its own.
    several = parts.groupBy("cls").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("size").alias("high")).where("a < b")
    groups = groups.unionByName(several.select(F.col("cls").alias("gid"), "cls", F.lit(0).alias("low"), "high"))
    return groups.join(parts.select("cls", "doc", F.col("start").alias("at")), "cls").select("gid", "doc", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high")).alias("end"))


def _records(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("bigint").alias("doc"), F.col(text_column).alias("text"))


def shared_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT, very_hot: int = VERY_HOT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of records with a common run of at least ``length`` characters."""
    rows = _records(docs, id_column, text_column)
    same = copies(rows, length)
    members = cut(_members(rows, same, length, seed, hot, very_hot, broadcast_rows).select("gid", "doc").distinct())
    found = members.alias("p").join(members.alias("q"), F.expr("p.gid = q.gid and p.doc < q.doc")).select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b")).distinct()
    left, right = same.select(F.col("rep").alias("a"), F.col("doc").alias("x")), same.select(F.col("rep").alias("b"), F.col("doc").alias("y"))
    across = found.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    within = same.alias("p").join(same.alias("q"), F.expr("p.rep = q.rep and p.doc < q.doc")).select(F.col("p.doc").alias("x"), F.col("q.doc").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_cover(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT, very_hot: int = VERY_HOT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, n_chars, shared_chars, share, spans) of every record; spans are the stretches that stand elsewhere too."""
    rows = _records(docs, id_column, text_column)
    same = copies(rows, length)
    members = cut(_members(rows, same, length, seed, hot, very_hot, broadcast_rows))
    real = members.groupBy("gid").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("gid")
    found = members.join(real, "gid", "left_semi").select("doc", "start", "end").distinct()
    # A record's stretches of all its buckets are put together where they meet or overlap.
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    lengths = rows.select("doc", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"))
    joined = lengths.join(spans, "doc", "left").join(same.select("doc", F.lit(True).alias("copied")), "doc", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_chars").alias("end")))
    joined = joined.withColumn("spans", F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", F.expr("array()"))))
    joined = joined.withColumn("shared_chars", F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"]))
    share = F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0))
    return joined.select(F.col("doc").alias(id_column), "n_chars", "shared_chars", share.alias("share"), "spans")
