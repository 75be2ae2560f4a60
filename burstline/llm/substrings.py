"""Passages that repeat across documents, by compact windows.

Places of a document are its word shingles.  Under a hash function the Cartesian tree over the
places' hashes groups all stretches of at least WINDOW places: a node stands for every such stretch
around it that holds no smaller hash, and all of them share its hash as their minimum.  Nodes with a
range that long are the places of the minima of all windows of WINDOW places, so numpy finds them
without building the tree; about 2 n / WINDOW of them.

A passage that two documents have in common makes windows of equal hash in both, under each function
with the passages' similarity as its chance.  Windows meet by hash; where those of ENOUGH functions
that one document shares with another overlap, the region around them is compared place by place with
the other document.  A passage is proven if SIMILAR hundredths of the shingles agree over MIN_WORDS
words.

Every window is first compared with the smallest document that holds its hash.  Then windows that no
proven passage has, also those that too few functions share, meet all smaller holders: the one that has
most shingles around the minimum in common, if they are enough, is compared.  So a passage that a third
of all documents hold costs each of them one comparison, and a line that unlike documents share a count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, partitions, released, texts, trimmed, written
from .minhash import SIMILAR, TEXTS, _Counter, mixed, places

SHINGLE, FUNCTIONS, ENOUGH = 5, 4, 2
#: Words of the shortest passage, and places of the shortest window: as many as the passage has.
MIN_WORDS, WINDOW = 50, 46
#: Places to each side of windows shared with a source that are compared with it too.
AROUND = 512
#: Places without a match inside a passage: three changed words.
GAP = 3 * SHINGLE
#: Places that a stretch of WINDOW in a similar passage may lack: a changed word takes 5, two inserted ones 6.
ROOM = 7
#: Regions of documents that one task compares with a source.
PART_ROWS = 300
#: Holders of a hash in one part of its group.
GROUP_ROWS = 1000
#: Bytes of places in one batch of rows.
BATCH_BYTES = 1 << 22
_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_NOISE = np.random.default_rng(11).integers(0, 1 << 12, 1 << 16, dtype=np.uint64) << np.uint64(6)
_LOW = np.uint64(63)
#: Bits of a text's id that windows carry.
_TAG = 0x7FFF
#: Bits of the filter before a join by doc_id: 2 MB.
FILTER_BITS = 1 << 24


def compact_windows(h: np.ndarray, least: int = WINDOW, sizes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the Cartesian tree over h with a range of at least `least` (64 at most) places: place, and first and last place of the windows it is the minimum of.

    With `sizes`, h holds the places of several texts one after the other.  Equal hashes are told
    apart by noise, so that a text of one repeated word makes no chain.
    """
    n = len(h)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n, dtype=np.uint64)
    key = h >> np.uint64(18) << np.uint64(18) | np.resize(_NOISE, n) | at & _LOW
    blocks = np.full(-(-n // least) * least, np.iinfo(np.uint64).max)
    blocks[:n] = key
    blocks = blocks.reshape(-1, least)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    first = at[: n - least + 1]
    low = np.minimum(after[: len(first)], before[least - 1 : n])
    place = (first + ((low - first) & _LOW)).astype(np.int64)  # the low bits tell the place within a window
    first = first.astype(np.int64)
    if sizes is not None:  # no window reaches over the end of its text
        ends = np.repeat(np.cumsum(sizes), sizes)[: len(first)]
        inside = first + least <= ends
        place, first = place[inside], first[inside]
    if not len(place):
        return (place,) * 3
    starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(place)]]) - 1
    return place[starts], first[starts], first[ends] + least - 1


def _salted(h: np.ndarray, function: int) -> np.ndarray:
    return mixed(h + np.uint64(0x9E3779B97F4A7C15 * (function + 1) & 0xFFFFFFFFFFFFFFFF))


def text_id(text: str) -> int:
    """64-bit hash of a text, signed: rows that share a doc_id but not their text are told apart by it."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def windows(docs: DataFrame, size: int = SHINGLE, functions: int = FUNCTIONS, least: int = WINDOW) -> DataFrame:
    """(v, doc_id, w) of all compact windows: v is the minimum's hash, w packs what unpacked() gives, so that little is shuffled."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                own = batch.slice(lo, TEXTS)
                values = own.column(1).to_pylist()
                kept = [(d, t, h) for d, t, h in zip(own.column(0).to_pylist(), values, places(values, size)) if len(h) >= least and d is not None]
                if not kept:
                    continue
                sizes = [len(h) for *_, h in kept]
                ids, tags = np.array([d for d, *_ in kept], np.int64), np.array([text_id(t) & _TAG for _, t, _ in kept], np.int64)
                every, ends = np.concatenate([h for *_, h in kept]), np.cumsum(sizes)
                for f in range(functions):
                    salted = _salted(every, f)
                    c, l, r = compact_windows(salted, least, sizes)
                    row = np.searchsorted(ends, c, "right")
                    w = tags[row] << 47 | c - (ends - sizes)[row] << 15 | c - l << 9 | r - c << 3 | f
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (salted[c].view(np.int64), ids[row], w)], ["v", "doc_id", "w"])

    return texts(docs).mapInArrow(trimmed(run), "v long, doc_id long, w long")


def unpacked(df: DataFrame) -> DataFrame:
    """w as tag (bits of the text's id), c (place of the minimum), l and r (first and last place of its windows) and f."""
    bits = lambda at, mask: F.shiftright("w", at).bitwiseAND(F.lit(mask))
    df = df.withColumns({"tag": bits(47, _TAG), "c": bits(15, 0xFFFFFFFF), "f": bits(0, 7)})
    return df.withColumns({"l": F.col("c") - bits(9, 63), "r": F.col("c") + bits(3, 63)}).drop("w")


def regions_of(found: list[tuple[int, int, int]], n: int, enough: int, around: int) -> list[tuple[int, int]]:
    """Stretches (first, end) of n places around those where windows (f, l, r) of `enough` functions overlap."""
    cover = np.zeros((8, n), bool)
    for f, l, r in found:
        cover[f, l : r + 1] = True
    hit = np.flatnonzero(cover.sum(0) >= enough)
    if not len(hit):
        return []
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 2 * around) + 1)
    return [(max(0, int(x[0]) - around), min(n, int(x[-1]) + 1 + around)) for x in runs]


def _alike(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def stretches(source: np.ndarray, own: np.ndarray, run: np.ndarray, least: int) -> list[tuple[int, int, int, int, float]]:
    """The longest similar stretches of at least `least` places within a run of own's places that source has too, apart from each other."""
    order = np.argsort(source, kind="stable")
    lo, hi = (np.searchsorted(source[order], own[run], side).tolist() for side in ("left", "right"))
    at: list[int] = []
    for i, a, b in zip(run.tolist(), lo, hi):  # of several places in the source the one that goes on
        there = order[a:b]
        at.append(int(there[0] if len(there) == 1 or not at else there[np.abs(there - (at[-1] + i - before)).argmin()]))
        before = i
    there = np.array(at)
    cuts = np.flatnonzero((np.diff(run) != 1) | (np.diff(there) != 1)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(run)]]) - 1
    out, stack = [], [(0, len(first))]
    while stack:
        lo, hi = stack.pop()
        if lo >= hi or run[last[hi - 1]] - run[first[lo]] + 1 < least:
            continue
        best = (0, 0, 0)
        for k in range(lo, hi):
            ends = last[k:hi]
            if run[ends[-1]] - run[first[k]] + 1 <= max(best[0], least - 1):
                break
            n, m, both = run[ends] - run[first[k]] + 1, there[ends] - there[first[k]] + 1, ends - first[k] + 1
            ok = np.flatnonzero((n >= least) & (m > 0) & (100 * both >= SIMILAR * (n + m - both)))
            if len(ok) and n[ok[-1]] > best[0]:
                best = (int(n[ok[-1]]), k, k + int(ok[-1]))
        if not best[0]:
            continue
        _, k, e = best
        a, b, c, d = int(run[first[k]]), int(run[last[e]]), int(there[first[k]]), int(there[last[e]])
        both, union = _alike(np.unique(own[a : b + 1]), np.unique(source[c : d + 1]))
        if 100 * both >= SIMILAR * union:
            out.append((a, b, c, d, both / union))
        elif e > k:  # repeated shingles count once: shorter ones may still do
            stack += [(k, (k + e + 1) // 2), ((k + e + 1) // 2, e + 1)]
        stack += [(lo, k), (e + 1, hi)]
    return out


def passages(source: np.ndarray, own: np.ndarray, size: int = SHINGLE, min_words: int = MIN_WORDS, values: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Proven passages of `own` in `source`: first and last place in both, and the similarity of their shingle sets.  `values` are the distinct ones of source."""
    if values is None:
        values = np.unique(source)
    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
    same = values[at] == own
    least = min_words - size + 1
    total = np.concatenate([[0], np.cumsum(same)])
    if len(own) < least or 100 * int((total[least:] - total[:-least]).max()) < SIMILAR * least:
        return []  # no stretch has enough in common
    hit = np.flatnonzero(same)
    out = []
    for gap in (GAP, 1):
        if not len(hit):
            break
        kept = []
        for run in np.split(hit, np.flatnonzero(np.diff(hit) > gap) + 1):
            a, b = int(run[0]), int(run[-1])
            if b - a + size < min_words:
                continue
            x = np.unique(own[a : b + 1])
            there = np.flatnonzero(np.isin(source, x))
            # The stretch of the source that shares the most: a shingle may stand there often.
            near = max(np.split(there, np.flatnonzero(np.diff(there) > gap) + 1), key=len)
            both, union = _alike(x, np.unique(source[near[0] : near[-1] + 1]))
            if 100 * both >= SIMILAR * union:
                out.append((a, b, int(near[0]), int(near[-1]), both / union))
                kept.append(run)
            elif gap > 1:
                for part in stretches(source, own, run, min_words - size + 1):
                    out.append(part)
                    kept.append(run[(run >= part[0]) & (run <= part[1])])
        if kept:
            hit = np.setdiff1d(hit, np.concatenate(kept), assume_unique=True)
    return sorted(out)


_SPANS = "doc_id long, text_id long, start long, end long, source_id long, source_start long, source_end long, similarity double"
_KEY = ["doc_id", "text_id"]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], [x for x, _ in fields])


def _batches(rows, schema: str):
    """rows, whose last value is bytes, in batches of bounded size."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES or len(out) >= 1024:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _among(rows: DataFrame, ids: DataFrame, others: bool = False) -> DataFrame:
    """Rows with a doc_id of ids (doc_id), and a few others: before a join, so that it needn't shuffle all texts.  With `others`, the rows that are left."""
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    bit = F.pmod(hashed, F.lit(FILTER_BITS)) + 1
    number, at = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    bucket, bits = (max(rows.columns, key=len) + x for x in ("_bucket", "_bits"))  # longer than any name of rows
    maps = ids.groupBy(number.alias(bucket)).agg(F.bitmap_construct_agg(at).alias(bits))  # 512 rows of 4 KB at most
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.col("doc_id").isNotNull() & F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
    return rows.join(F.broadcast(maps), number == F.col(bucket), "left").where(~has if others else has).select(*rows.columns)


def _held(docs: DataFrame, wanted: DataFrame, ids: DataFrame, size: int, then: tuple | None = None) -> DataFrame:
    """(doc_id, text_id, places, and what wanted has) of every row of docs with the doc_id of a row of wanted (doc_id, one more): 32 bits of the hash of each shingle.  ids are those of wanted, from a stored table.

    A passage is proven by 37 places at least: one that is equal by chance, 1 in 4 billion, changes nothing.
    `then`, a function of batches and its schema, goes on in the same Python worker: a second one a task
    would stay beside it for all that follows.
    """
    (more,) = (c for c in wanted.columns if c != "doc_id")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                own = batch.slice(lo, TEXTS)
                values = own.column(1).to_pylist()
                held = [(h >> np.uint64(32)).astype("<u4").tobytes() for h in places(values, size)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([text_id(t) for t in values], pa.int64()), pa.array(held, pa.binary()), own.column(2)], [*_KEY, "places", more])

    kind = wanted.schema[more].dataType.simpleString()
    last, schema = then or (iter, f"doc_id long, text_id long, places binary, `{more}` {kind}")
    return _among(texts(docs), ids).join(wanted, "doc_id").select("doc_id", "text", more).mapInArrow(trimmed(lambda batches: last(run(batches))), schema)


def _wanted(found: DataFrame, enough: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, jobs) of found (doc_id, source_id, f, l, r): the sources of each document with the windows that lead to them, and a row without windows for each source.  Also the table of pairs that it reads."""
    pairs = found.groupBy("doc_id", "source_id").agg(F.collect_list(F.struct("f", "l", "r")).alias("ws"))  # as many as the document has
    pairs = written(pairs.where(F.size(F.array_distinct("ws.f")) >= enough), "pairs")
    parts = pairs.groupBy("source_id").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    none = F.lit(None).cast(pairs.schema["ws"].dataType)
    mine = pairs.join(parts, "source_id").select("doc_id", F.struct("source_id", part.alias("part"), "ws").alias("job"))
    theirs = parts.select(F.col("source_id").alias("doc_id"), F.struct("source_id", F.col("parts").alias("part"), none.alias("ws")).alias("job"))
    return mine.unionByName(theirs).groupBy("doc_id").agg(F.collect_list("job").alias("jobs")), pairs


def _regions(enough: int, around: int) -> tuple:
    """A function that makes sources (side 0) and regions to compare with them (side 1) of batches (doc_id, text_id, places, jobs), and its schema."""
    schema = "source_id long, part int, side int, doc_id long, text_id long, at int, places binary"

    def rows(batch):
        for k in range(batch.num_rows):
            doc_id, t, raw, jobs = (c[k].as_py() for c in batch.columns)
            for job in jobs:
                source_id, part, ws = job.values()
                if ws is None:
                    yield from ((source_id, p, 0, doc_id, t, 0, raw) for p in range(part))
                else:
                    for a, b in regions_of([(w["f"], w["l"], w["r"]) for w in ws], len(raw) // 4, enough, around):
                        yield source_id, part, 1, doc_id, t, a, raw[4 * a : 4 * b]

    def regions(batches):
        for batch in batches:
            yield from _batches(rows(batch), schema)

    return regions, schema


def _compared(sides: DataFrame, size: int, min_words: int) -> DataFrame:
    """Passages of the regions of sides, rows of _regions(), in their sources."""

    def compare(batches):
        key, source, values = None, np.zeros(0, np.uint32), None
        for batch in batches:
            out = []
            for source_id, part, side, doc_id, t, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(raw, "<u4")
                if side == 0:  # a doc_id may stand for several texts
                    source = np.concatenate([source, h]) if (source_id, part) == key else h
                    key, values = (source_id, part), None
                elif key == (source_id, part) and len(source):
                    values = np.unique(source) if values is None else values
                    out += [(doc_id, t, at + a, at + b + size, source_id, c, d + size, s) for a, b, c, d, s in passages(source, h, size, min_words, values)]
            if out:
                yield _batch(out, _SPANS)

    dealt = sides.repartition(partitions(sides.sparkSession), "source_id", "part").sortWithinPartitions("source_id", "part", "side", *_KEY, "at")
    return written(dealt.mapInArrow(trimmed(compare), _SPANS), "proven")


def _both(pairs: DataFrame) -> DataFrame:
    """The ids on both sides of pairs."""
    return pairs.select("doc_id").unionByName(pairs.select(F.col("source_id").alias("doc_id")))


def _left(rows: DataFrame, proven: DataFrame, size: int) -> DataFrame:
    """rows (doc_id, tag, c, ...) whose place no proven passage holds."""
    tag = F.col("text_id").bitwiseAND(F.lit(_TAG)).alias("tag")
    spans = proven.groupBy("doc_id", tag).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # as many as the document has
    within = F.exists("spans", lambda x: (x["start"] <= F.col("c")) & (F.col("c") + size <= x["end"]))
    return rows.join(spans, ["doc_id", "tag"], "left").where(~F.coalesce(within, F.lit(False))).select(*rows.columns)


def _of_others(docs: DataFrame, meeting: DataFrame, size: int, least: int) -> DataFrame:
    """(doc_id, tag, c, f, l, r, source_id, both): windows of meeting (doc_id, ws), a stored table, with the smaller holder, of each part of those of the hash, that agrees best around their place, if enough shingles do.

    A passage has a stretch of `least` places of which all but ROOM are shared; those around a shared
    minimum are counted here in groups by hash, large ones cut into parts.
    """
    schema = "v long, part long, side int, doc_id long, tag long, c long, f long, l long, r long, places binary"

    def rows(batch):
        for k in range(batch.num_rows):
            doc_id, t, raw, ws = (c[k].as_py() for c in batch.columns)
            for w in ws:
                v, tag, f, c, l, r, left, lefts, rights = w.values()
                if tag != t & _TAG:
                    continue
                near = raw[4 * max(0, c - least + 1) : 4 * (c + least)]
                i, j = (doc_id * 31 + c) % lefts, (doc_id * 31 + c) % rights
                yield from ((v, p, 0, doc_id, tag, c, f, l, r, near) for p in range(j, lefts * rights, rights))
                if left:
                    yield from ((v, p, 1, doc_id, tag, c, f, l, r, near) for p in range(i * rights, (i + 1) * rights))

    def contexts(batches):
        for batch in batches:
            yield from _batches(rows(batch), schema)

    need = least - ROOM
    result = "doc_id long, tag long, c long, f long, l long, r long, source_id long, both int"

    def agreeing(index: _Counter, ids: np.ndarray, doc_id: int, h: np.ndarray) -> list[tuple[int, int]]:
        """Of the smaller holders with `need` places of a stretch of `least` the one with the most, and how many it has."""
        lo = np.searchsorted(index.flat, h, "left")
        n = np.searchsorted(index.flat, h, "right") - lo
        ends = np.cumsum(n)
        owner, place = index.owner[np.repeat(lo - ends + n, n) + np.arange(ends[-1])], np.repeat(np.arange(1, len(h) + 1), n)
        may = np.flatnonzero((np.bincount(owner, minlength=len(ids)) >= need) & (ids < doc_id))
        if not len(may):
            return []
        rank = np.full(len(ids), -1)
        rank[may] = np.arange(len(may))
        kept = rank[owner] >= 0
        has = np.zeros((len(may), len(h) + 1), np.int32)
        has[rank[owner[kept]], place[kept]] = 1
        has = has.cumsum(1)
        most = (has[:, least:] - has[:, :-least]).max(1)
        top = int(most.max())
        return [(int(ids[may[most == top]].min()), top)] if top >= need else []

    def meet(batches):
        key, holders, index, ids = None, [], None, None
        for batch in batches:
            out = []
            for v, part, side, doc_id, tag, c, f, l, r, raw in zip(*(x.to_pylist() for x in batch.columns)):
                if (v, part) != key:
                    key, holders, index = (v, part), [], None
                h = np.frombuffer(raw, "<u4")
                if side == 0:
                    holders.append((doc_id, h))
                elif holders and len(h) >= least:
                    if index is None:
                        index, ids = _Counter([np.unique(x) for _, x in holders]), np.array([x for x, _ in holders])
                    out += [(doc_id, tag, c, f, l, r, *x) for x in agreeing(index, ids, doc_id, h)]
            if out:
                yield _batch(out, result)

    sides = _held(docs, meeting, meeting.select("doc_id"), size, (contexts, schema))
    return sides.repartition(partitions(docs.sparkSession), "v", "part").sortWithinPartitions("v", "part", "side").mapInArrow(trimmed(meet), result)


def repeats(docs: DataFrame, size: int = SHINGLE, min_words: int = MIN_WORDS, functions: int = FUNCTIONS, enough: int = ENOUGH) -> DataFrame:
    """Passages that repeat: doc_id, text_id, start and end (words, end exclusive), source_id, source_start, source_end, similarity.

    docs (doc_id, text) is a stored table.  source_id, always smaller than doc_id, holds the passage too.
    Rows without doc_id, and null, empty and short texts take no part; repeats inside one document
    aren't reported; rows that repeat a doc_id count as one document, and text_id tells which text
    a passage stands in; other columns are left out; an empty table has none.
    """
    least = min_words - size + 1
    # One shuffle by hash; rows of a hash stay where they are for its smallest holder.
    same = Window.partitionBy("v")
    shared = windows(docs, size, functions, least).withColumns({"source_id": F.min("doc_id").over(same), "last": F.max("doc_id").over(same)}).where("source_id <> last").drop("last")
    found = written(unpacked(shared), "found")
    released(docs.sparkSession)
    wanted, pairs = _wanted(found.where("doc_id <> source_id"), enough)
    first = _compared(_held(docs, wanted, _both(pairs), size, _regions(enough, AROUND)), size, min_words)
    dropped(pairs)
    # Windows that no proven passage has, with all smaller holders that agree around them.
    rest = written(_left(found.where("doc_id <> source_id"), first, size).withColumn("left", F.lit(True)), "left")
    of = lambda df, n: df.groupBy("v").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(n))
    sizes = of(rest, "lefts").join(of(found, "rights"), "v")
    met = found.join(sizes, "v")  # before anything else: most hashes have no window left
    marked = met.join(rest.select("v", "doc_id", "tag", "c", "left").distinct(), ["v", "doc_id", "tag", "c"], "left").withColumn("left", F.coalesce("left", F.lit(False)))
    columns = F.struct("v", "tag", "f", "c", "l", "r", "left", "lefts", "rights")
    ws = written(marked.groupBy("doc_id").agg(F.collect_list(columns).alias("ws")), "meeting")  # as many as the document has
    dropped(found, rest)
    others = written(_of_others(docs, ws, size, least), "others")
    dropped(ws)
    # Each with the holder that agrees best around it, so that links grow with the windows.
    best = others.groupBy("doc_id", "tag", "c", "f", "l", "r").agg(F.max_by("source_id", F.struct("both", -F.col("source_id"))).alias("source_id"))
    wanted, pairs = _wanted(best, 1)
    second = _compared(_held(docs, wanted, _both(pairs), size, _regions(1, least)), size, min_words)
    dropped(others, pairs)
    return first.unionByName(second).dropDuplicates([*_KEY, "start", "end", "source_id"])


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs, a stored table, without the passages of spans (doc_id, text_id, start, end): their words go, with the white space after them.

    All columns stay; n_chars, where there is one, follows the text.  Texts without a passage stay as
    they are, also null ones; only those that have one are shuffled and meet Python.
    """
    names = docs.columns
    at = names.index("text")
    key, cuts = (max(names, key=len) + x for x in ("_key", "_cuts"))  # longer than any name of docs
    lists = written(spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("text_id", "start", "end")).alias(cuts)), "cuts")  # as many as the document has
    ids = lists.select(F.col(key).alias("doc_id"))
    joined = _among(docs, ids).join(lists, F.col("doc_id").cast("long") == F.col(key), "left").select(*names, cuts)

    def cut(text, spans):
        own = text_id(text) if spans and text else None
        places = [(x["start"], x["end"]) for x in spans if x["text_id"] == own] if own is not None else []
        return cut_words(text, places) if places else text

    def run(batches):
        for batch in batches:
            texts_ = [cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts_, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    out = joined.mapInArrow(trimmed(run), docs.schema).unionByName(_among(docs, ids, others=True))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans; words stand between ASCII white space."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    words = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in merged:
        if a < len(words):
            out.append(text[last : words[a][0]])
            last = words[min(b, len(words)) - 1][1]
    return "".join([*out, text[last:]])
