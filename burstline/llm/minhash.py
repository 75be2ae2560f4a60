"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the SKETCH
smallest of them, the whole set of a short document.  Documents with equal sets are one class,
and work goes on with classes.

Candidates.  Two sets with a similarity of 0.8 share at least needed() retained values (exactly so
for short sets, up to a chance of about 1e-10 for long ones).  Ordered by how many sketches hold
them, the rarest values of a sketch, all but needed() - 1, must then hold the first value that two
such sketches share.  Only these go to the inverted lists, so that passages which many documents
have in common make no long lists.  A list's smallest class is its hub; lists with one hub form a
block, and a pair that shares a list shares a block.

Verification.  Blocks compare exact sets: every class with its hub first, which joins nearly all
of a group of near copies in linear work; then only classes that are not in their hub's
component are compared with the block's others.  Blocks beyond a bound are cut into parts, whose
pairs meet in tasks of their own.  Comparisons put out links that join components, never all pairs
of a group.  Before a comparison counts intersections in full, the union of two sketches has to
promise enough.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, texts, trimmed, written
from .graph import components

SHINGLE, SKETCH = 5, 128
#: Similarity in hundredths.
SIMILAR = 80
#: Classes and set members in a part of a block.
PART_ROWS, PART_VALUES = 500, 250_000
#: Ids that may be broadcast; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Texts, and bytes of them, hashed at once; a longer word makes a longer block.
TEXTS, BLOCK_BYTES = 64, 1 << 18

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = 0xD6E8FEB86659FD93
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), 32]] = True
#: A number for each byte, the same for A-Z and a-z; words are polynomials of them.
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, x, np.uint64))]) for x in (_STEP, pow(_STEP, -1, 1 << 64)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(32))


def _block_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of data, which ends in white space."""
    own = np.frombuffer(data, np.uint8)
    change = np.flatnonzero(np.diff(_WHITE[own], prepend=True))
    starts, ends = change[::2], change[1::2]
    power, inverse = _powers(max(1 << 18, 1 << (len(own) - 1).bit_length()))
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(_BYTE[own] * power[: len(own)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words between ASCII white space of some texts, one after the other, and words by text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in values]
    data, bounds = b"\n".join([*raw, b""]), np.cumsum([0, *(len(x) + 1 for x in raw)])
    found, at = [], 0
    while at < len(data):
        end = at + BLOCK_BYTES
        while end < len(data) and not _WHITE[data[end - 1]]:
            end += 1
        hashes, starts = _block_hashes(data[at:end])
        found.append((hashes, starts + at))
        at = end
    hashes, starts = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(_STEP) + mixed(words[i : len(words) - size + 1 + i])
    return mixed(h)


def places(values: list[str], size: int) -> list[np.ndarray]:
    """By text, the hash of the shingle of `size` words that starts at each word; none for fewer words."""
    words, counts = word_hashes(values)
    ends = np.cumsum(counts).tolist()
    every = _rolled(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    return [every[end - n : max(end - n, end - size + 1)] for end, n in zip(ends, counts.tolist())]


def shingles(values: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """By text, the sorted distinct hashes of `size` neighbouring words; of the whole sequence where there are fewer."""
    words, counts = word_hashes(values)
    ends = np.cumsum(counts).tolist()
    every = _rolled(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    out = []
    for end, n in zip(ends, counts.tolist()):
        own = words[end - n : end]
        out.append(np.unique(every[end - n : end - size + 1]) if n >= size else _rolled(own, n) if n else own)
    return out


def needed(n: int, sketch: int = SKETCH) -> int:
    """Retained values that a set of n must share with any similar set."""
    if n * 100 <= SIMILAR * sketch:  # all similar sets are retained whole
        return -(-SIMILAR * n // 100)
    return int(0.53 * min(n, sketch))


def sketches(docs: DataFrame, size: int = SHINGLE, sketch: int = SKETCH) -> DataFrame:
    """(doc_id, n, set_id, sketch) of every row; set_id is a 128-bit hash of the whole set."""

    def run(batches):
        for batch in batches:
            n, ids, kept = [], [], []
            for lo in range(0, batch.num_rows, TEXTS):
                for own in shingles(batch.column(1).slice(lo, TEXTS).to_pylist(), size):
                    n.append(len(own))
                    ids.append(xxhash.xxh3_128_digest(own.tobytes()))
                    kept.append(own[:sketch].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "n", "set_id", "sketch"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, n long, set_id binary, sketch binary")


def _indexed(classes: DataFrame, sketch: int) -> DataFrame:
    """(v, cid, n): the rarest values of each class's sketch that other sketches hold too."""

    def values(batches):
        for batch in batches:
            own = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(2)]
            sizes = [len(x) for x in own]
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(batch.column(1).to_numpy(), sizes))], ["v", "cid", "n"])

    def prefix(batches):
        for batch in batches:
            v, cid, size = [], [], []
            for c, n, own in zip(*(x.to_pylist() for x in batch.columns)):
                m = min(n, sketch)
                keep = m - needed(n, sketch) + 1 - (m - len(own))  # values that no other sketch holds come first and need no list
                if keep > 0:
                    v += [x["v"] for x in sorted(own, key=lambda x: (x["df"], x["v"]))[:keep]]
                    cid += [c] * min(keep, len(own))
                    size += [n] * min(keep, len(own))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(cid, pa.int64()), pa.array(size, pa.int64())], ["v", "cid", "n"])

    every = classes.where("n > 0").select("cid", "n", "sketch").mapInArrow(trimmed(values), "v long, cid long, n long")
    shared = every.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    own = every.join(shared, "v").groupBy("cid", "n").agg(F.collect_list(F.struct("df", "v")).alias("own"))  # `sketch` values at most
    return own.mapInArrow(trimmed(prefix), "v long, cid long, n long")


class _Counter:
    """How many values each of some sorted sets shares with another set."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = [len(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.n, self.flat, self.owner = len(sets), flat[order], np.repeat(np.arange(len(sets)), sizes)[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.flat, own, "left")
        n = np.searchsorted(self.flat, own, "right") - lo
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return np.bincount(self.owner[np.repeat(lo - ends + n, n) + np.arange(total)], minlength=self.n)


def _compared(rows: DataFrame, sketch: int) -> DataFrame:
    """Links (a, b) between the left and the right rows of each (hub, part) that join components.

    rows: hub, part, side, cid, component, members.
    """

    def links(group: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
        left = [x for x in group if x[0] == 0]
        right = [x for x in group if x[0] == 1]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (p := parent.setdefault(c, c)) != c:
                parent[c] = c = parent[p]
            return c

        sets = [np.frombuffer(x[3], np.uint64) for x in right]
        sizes = np.array([len(s) for s in sets], np.int64)
        need = np.array([needed(len(s), sketch) for s in sets], np.int64)
        kept, whole, out = _Counter([s[:sketch] for s in sets]), None, []
        for _, cid, component, members in left:
            own = np.frombuffer(members, np.uint64)
            # What two sketches share bounds what the union's sketch holds of both.
            may = np.flatnonzero(kept.shared(own[:sketch]) >= np.maximum(need, needed(len(own), sketch)))
            may = [j for j in may.tolist() if right[j][1] != cid and root(component) != root(right[j][2])]
            if len(may) > 64:
                whole = whole or _Counter(sets)
                both = whole.shared(own)[may]
            else:
                both = np.array([len(np.intersect1d(own, sets[j], assume_unique=True)) for j in may], np.int64)
            for j in np.array(may)[100 * both >= SIMILAR * (len(own) + sizes[may] - both)].tolist() if may else ():
                if (a := root(component)) != (b := root(right[j][2])):
                    parent[a] = b
                    out.append((cid, right[j][1]))
        return out

    def run(batches):
        key, group = None, []

        def flush():
            found = links(group)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for hub, part, side, cid, component, members in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, part) != key:
                    if group:
                        yield flush()
                    key, group = (hub, part), []
                group.append((side, cid, component, members))
        if group:
            yield flush()

    n = partitions(rows.sparkSession)
    return rows.select("hub", "part", "side", "cid", "component", "members").repartition(n, "hub", "part").sortWithinPartitions("hub", "part", "side", "cid").mapInArrow(trimmed(run), "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(cid, members) of the rows whose doc_id and set are a class of ids (cid, doc_id, set_id): its whole set."""

    def run(batches):
        for batch in batches:
            own = [x for lo in range(0, batch.num_rows, TEXTS) for x in shingles(batch.column(1).slice(lo, TEXTS).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "set_id", "members"])

    few = ids.count() <= BROADCAST_IDS
    wanted = ids.select("doc_id").distinct()
    some = texts(docs).join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    made = some.mapInArrow(trimmed(run), "doc_id long, set_id binary, members binary")
    return made.join(F.broadcast(ids) if few else ids, ["doc_id", "set_id"]).dropDuplicates(["cid"]).select("cid", "members")


def class_links(docs: DataFrame, classes: DataFrame, size: int = SHINGLE, sketch: int = SKETCH) -> DataFrame:
    """Links (a, b) between classes (cid, doc_id, n, set_id, sketch) of docs that make their components."""
    index = written(_indexed(classes, sketch), "index")
    hubs = index.groupBy("v").agg(F.min("cid").alias("hub"))
    blocks = index.join(hubs, "v").groupBy("hub", "cid").agg(F.first("n").alias("n"))
    blocks = written(blocks.where("hub <> cid"), "blocks")
    hub_ids = blocks.select(F.col("hub").alias("cid"))
    ids = written(hub_ids.unionByName(blocks.select("cid")).distinct().join(classes.select("cid", "doc_id", "set_id"), "cid"), "wanted")
    sets = written(_sets(docs, ids, size), "sets")
    parts = blocks.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n") / PART_VALUES)).cast("int").alias("parts"))
    # Every class with its hub.
    spread = lambda n, c: F.pmod(F.xxhash64(c), n).cast("int")
    right = blocks.join(parts, "hub").select("hub", spread(F.col("parts"), F.col("cid")).alias("part"), F.lit(1).alias("side"), "cid")
    left = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("cid"))
    rows = left.unionByName(right).join(sets, "cid").withColumn("component", F.col("cid"))
    first = written(_compared(rows, sketch), "near")
    # Classes outside their hub's component with the block's others.
    labels = components(first)
    of = lambda df, node, name: df.join(labels.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    every = written(of(of(blocks, "cid", "component"), "hub", "hub_component"), "members")
    out = every.where("component <> hub_component")
    out_parts = out.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n") / PART_VALUES)).cast("int").alias("outs"))
    both = out_parts.join(parts, "hub")
    pair = lambda i, j: (i * F.col("parts") + j).cast("int")
    left = out.join(both, "hub").select("hub", "cid", "component", F.lit(0).alias("side"), spread(F.col("outs"), F.col("cid")).alias("i"), "parts").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = every.join(both, "hub").select("hub", "cid", "component", F.lit(1).alias("side"), "outs", spread(F.col("parts"), F.col("cid")).alias("j"), "parts").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)))
    rows = left.select("hub", pair(F.col("i"), F.col("j")).alias("part"), "side", "cid", "component").unionByName(right.select("hub", pair(F.col("i"), F.col("j")).alias("part"), "side", "cid", "component"))
    second = _compared(rows.join(sets, "cid"), sketch)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, sketch: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs (doc_id, text), a stored table.

    Rows are linked where 100 * intersection >= 80 * union of their shingle sets; component_id is the
    smallest doc_id that links reach, kept marks it.  A text without words (null, empty) is
    linked with nothing.  Rows that repeat a doc_id are rows of their own; with equal texts they
    share a component, and all of them are kept or none.  A row without doc_id takes no part: its
    component is null and it is kept.  Other columns are left out; no rows give no rows.
    """
    rows = written(sketches(docs, size, sketch), "sketches")
    real = rows.where("n > 0 and doc_id is not null")
    # One doc_id may stand for several texts: classes go by a hash of their set, and get a document's id at the end.
    classes = real.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cid", F.xxhash64("set_id")), "classes")
    labels = components(class_links(docs, classes, size, sketch))
    labelled = classes.select("set_id", "cid", "doc_id").join(labels.select(F.col("node").alias("cid"), F.col("component").alias("label")), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component"))
    named = labelled.join(smallest, "label").select("set_id", "component")
    found = rows.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
