"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Best-fit decreasing looks at lengths only, and lengths are bounded by the capacity.  So the
plan is made once, on the driver, from a histogram of at most `capacity` rows: documents of
one length are placed together, and a segment tree over remaining capacities gives the
tightest open bins in logarithmic time.  Bins with equal content form one group; the plan is a
list of runs (length, ranks, first bin, offset, documents a bin) whose number depends on the capacity, not on
the corpus.  Ranks of documents within their length come from counters by partition and a
running sum over the partitions, so that a length shared by a third of the corpus stays spread.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import texts, trimmed, written

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
#: The id that ends every document.
END = 2
#: Chunks of text that a task remembers with their ids; beyond it the memory starts anew with the next texts.
REMEMBERED = 300_000
#: Texts tokenized at once.
TEXTS = 64
#: Chunks joined for one call of the tokenizer.
CHUNKS = 64
#: Chunks that may be merged by ranks: short ones of Latin letters, marks and line ends.
PLAIN = re.compile(r"[\n!-~\u00a1-\u024f]{1,200}").fullmatch


@lru_cache(1)
def rank_encoder(path: str) -> tiktoken.Encoding:
    """The merges of the tokenizer's file as ranks."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = {x: b for b, x in alphabet().items()}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    merged = [ranks[bytes(letters[c] for c in "".join(pair if isinstance(pair, list) else pair.split(" ")))] for pair in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("the merges are not in the order of their ids")
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def alphabet() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Texts → their ids as little-endian 32-bit bytes, by the tokenizer of a file.

    A cut before a space that follows no white space changes no pre-token, so texts are cut there
    and each distinct chunk is tokenized once, CHUNKS of them in one call: a token with a leading space
    begins a chunk.  Short Latin chunks, where patterns cannot differ by their version of
    Unicode, are merged by the same file's ranks.  A text in which an added token or white space before a
    space stands is tokenized whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = rank_encoder(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(space)]] = True

    def _encode(self, values: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(values, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> None:
        """Tokenizes chunks that do not end in white space, each with the space before it that is left out in `known`."""
        plain = [c for c in chunks if PLAIN(c)]
        others = [c for c in chunks if not PLAIN(c)] if len(plain) < len(chunks) else []
        parts = [others[k : k + CHUNKS] for k in range(0, len(others), CHUNKS)]
        encoded = self._encode([" " + " ".join(p) for p in parts])
        if plain:
            parts.append(plain)
            encoded.append(np.array(self.ranked.encode_ordinary(" " + " ".join(plain)), "<u4"))
        for part, ids in zip(parts, encoded):
            raw, at = ids.tobytes(), (4 * np.flatnonzero(self.spaced[ids])).tolist()
            if len(at) != len(part):
                raise ValueError(f"{len(part)} chunks have become {len(at)}")
            self.known.update(zip(part, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]))

    def ids(self, values: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, whole, cut, new = self.known, [], [], set()
        for k, text in enumerate(values):
            head, *chunks = text.split(" ")
            found = list(map(known.get, chunks))  # one look-up a chunk, and one more for new ones
            gaps = [i for i, ids in enumerate(found) if ids is None] if None in found else []
            ends = [head] if head else []
            ends += [chunks[i] for i in gaps]  # no known chunk is empty or ends in white space
            if any(x in text for x in self.added) or (chunks and any(not c or c[-1].isspace() for c in ends)):
                whole.append(k)
            else:
                cut.append((k, head, chunks, found, gaps))
                new.update([chunks[i] for i in gaps])
        out: list = [None] * len(values)
        for k, ids in zip(whole, self._encode([values[k] for k in whole])):
            out[k] = ids.tobytes()
        self._chunks(list(new))
        heads = self._encode([own[1] for own in cut])
        for (k, _, chunks, found, gaps), first in zip(cut, heads):
            for i in gaps:
                found[i] = known[chunks[i]]
            out[k] = first.tobytes() + b"".join(found)
        return out


PIECES = "part int, doc_id long, piece int, start long, length int, local long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True, path: str | None = None) -> DataFrame:
    """PIECES of the tokenized documents; `local` counts equal lengths within the partition."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        encode, seen, end = Encoder(path).ids, defaultdict(int), struct.pack("<I", END)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                own = batch.slice(lo, TEXTS)
                rows = []
                for doc_id, raw, part in zip(own.column(0).to_pylist(), encode(own.column(1).to_pylist()), own.column(2).to_pylist()):
                    raw += end
                    n, at, k = len(raw) // 4, 0, 0
                    while at < n:
                        size = (n % capacity if at == 0 else 0) or capacity
                        ids = raw[4 * at : 4 * (at + size)]
                        rows.append((part, doc_id, k, at, size, seen[size], zlib.crc32(ids), ids if keep_ids else None))
                        seen[size] += 1
                        at, k = at + size, k + 1
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return texts(docs).withColumn("part", F.spark_partition_id()).mapInArrow(trimmed(run), PIECES)


class SegmentTree:
    """Open bins by remaining capacity: the tightest capacity that holds a size, in log time."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.n)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.n
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of at least `size` with an open bin."""
        i = size + self.n
        while not self.open[i]:
            while i & 1:  # a right child: what follows is beyond the parent
                i //= 2
                if i <= 1:
                    return None
            i += 1
        while i < self.n:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.n


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[list[int], list[int], list[int], list[int]]]:
    """By length, for each run of equal documents: first rank, first sequence, offset, and documents a sequence.

    Best-fit decreasing: lengths from the longest, each document into the open bin with the least
    room that suffices (of equal ones the first), else into a new one.  A bin that has just taken a
    document is the tightest for the next of that length as long as it holds one more, so a bin takes
    all of a length that it can before the next is touched, and a group of equal bins is filled in one step.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity → heap of (first sequence, bins)
    tree, runs, bins = SegmentTree(capacity), {}, 0

    def put(room: int, first: int, count: int) -> None:
        if count:
            heapq.heappush(groups[room], (first, count))
            tree.set(room, True)

    for size in sorted(histogram, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} is not in 1..{capacity}")
        left, rank = histogram[size], 0
        own = runs[size] = ([], [], [], [])
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, count = capacity, bins, -(-left // (capacity // size))
                bins += count
            else:
                first, count = heapq.heappop(groups[room])
                if not groups[room]:
                    tree.set(room, False)
            each = room // size
            full = min(count, left // each)
            rest = left - full * each if full < count else 0  # for one more bin, fewer than `each`
            for took, per, at in ((full * each, each, first), (rest, rest, first + full)):
                if took:
                    for column, x in zip(own, (rank, at, capacity - room, per)):
                        column.append(x)
                    left, rank = left - took, rank + took
            used = full + (rest > 0)
            put(room - each * size, first, full)
            if rest:
                put(room - rest * size, first + full, 1)
            put(room, first + used, count - used)
    return runs


def placed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (a stored table of PIECES) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = plan(histogram, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = parts.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "local", "part")
    names = ranked.columns

    def run(batches):
        for batch in batches:
            lengths, ranks = (batch.column(names.index(x)).to_pylist() for x in ("length", "rank"))
            sequences, offsets = [], []
            for size, rank in zip(lengths, ranks):
                starts, first, at, each = runs[size]
                k = bisect_right(starts, rank) - 1
                bins, place = divmod(rank - starts[k], each[k])
                sequences.append(first[k] + bins)
                offsets.append(at[k] + place * size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes)
    return ranked.mapInArrow(trimmed(run), f"{kinds}, sequence_id long, offset long").drop("rank")


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Every piece of docs (doc_id, text) with its place: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    A document is its ids and END; one longer than `capacity` is cut into pieces of `capacity`
    after a first one of the rest.  Null and empty texts are the END alone; repeated rows and null
    doc_ids are documents of their own; other columns are left out; an empty table gives none.
    """
    return placed(written(pieces(docs, capacity, keep_ids), "pieces"), capacity)
