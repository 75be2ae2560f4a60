"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

The text is cut into pre-tokens by the vocabulary's pattern.  Blocks of texts keep the
positions of their pre-tokens as indices into the block's list of distinct words.  The words
are dealt out by hash, so that equal words of all blocks meet and each is merged once; the
ids go back to the blocks, which put them together by position.  Decoding joins the
token-byte table: bounded by the vocabulary, it travels with the tasks.

Between the stages words and ids travel packed: one row for a block and a hash bucket, the
words sorted and compressed.  A word that fills every block is one entry a block, whatever
its count.  Pre-tokens that are tokens themselves need no merge and no journey.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of text in a block: with its dictionaries it takes about 150 MB of a worker.
BLOCK_CHARS = 16_000_000
#: Merged words that a task remembers; beyond it the memory starts anew and words are merged again.
REMEMBERED = 600_000


@lru_cache(1)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


@lru_cache(1)
def token_bytes(path: str) -> dict[int, bytes]:
    return {b: a for a, b in ranks(path).items()}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    if (whole := rank.get(word)) is not None:
        return [whole]
    if len(word) > 200:
        return _merge_long(word, rank)
    parts = [word[i : i + 1] for i in range(len(word))]
    get, top = rank.get, 1 << 60
    pairs = [get(parts[i] + parts[i + 1], top) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == top:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], top)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], top)
    return [rank[p] for p in parts]


def _merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """As merge(), in n log n for very long pre-tokens: a heap of pairs over a linked list."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, size = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size or rank.get(parts[i] + parts[j]) != r:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (s := rank.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (s, i, len(both)))
        if before[i] >= 0 and (s := rank.get(both := parts[before[i]] + parts[i])) is not None:
            heapq.heappush(heap, (s, before[i], len(both)))
    return [rank[p] for p in parts if p is not None]


#: White space before a space: only there can a pre-token reach over the cut before a space.
_RUNS = tuple(chr(c) + " " for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


_ASCII_RUNS = tuple(r for r in _RUNS if r.isascii())


def runs(text: str) -> bool:
    return any(r in text for r in (_ASCII_RUNS if text.isascii() else _RUNS))


#: Marks that the public pattern cuts from the letters before them.
_ENDS = frozenset(",.;:!?")


class _Chunks(dict):
    """Chunk of text → its number in the block; a new one is cut into pre-tokens by `cut`."""

    def __init__(self, block: Block, cut):
        super().__init__()
        self.block, self.cut = block, cut

    def __missing__(self, chunk: str) -> int:
        index, words = self.block.index, self.block.words
        n = self[chunk] = len(self.block.sizes)
        own = self.cut(chunk)
        words.extend([index.setdefault(w, len(index)) for w in own])
        self.block.sizes.append(len(own))
        return n


class Block:
    """Distinct pre-tokens of some texts and, by text, the positions they stand at.

    A text is cut before every space that follows no white space, which changes no pre-token; each
    distinct chunk meets the pattern once a block.
    """

    def __init__(self, pattern: str):
        find = regex.compile(pattern).findall

        def spaced(c: str) -> list[str]:
            if known:
                if c.isalpha():
                    return [" " + c]
                if c[-1:] in _ENDS and c[:-1].isalpha():
                    return [" " + c[:-1], c[-1]]
            return find(" " + c)

        known = pattern == public_tokenizers.PATTERN
        self.index: dict[str, int] = {}
        self.words: list[int] = []
        self.sizes: list[int] = []
        self.spaced, self.first, self.single = _Chunks(self, spaced), _Chunks(self, find), _Chunks(self, lambda w: [w])
        self.find, self.ids, self.chunks, self.chars = find, [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        if runs(text):
            words = self.find(text)
            own = np.fromiter(map(self.single.__getitem__, words), np.uint32, len(words))
        elif text:
            first, *rest = text.split(" ")
            own = np.empty(len(rest) + 1, np.uint32)
            own[0] = self.first[first]
            own[1:] = np.fromiter(map(self.spaced.__getitem__, rest), np.uint32, len(rest))
        else:
            own = np.zeros(0, np.uint32)
        self.ids.append(doc_id)
        self.chunks.append(own)
        self.chars += len(text)

    def positions(self) -> tuple[list[int], np.ndarray]:
        """Pre-tokens by text, and the indices of all of them."""
        chunks, sizes = np.concatenate(self.chunks), np.array(self.sizes, np.int64)
        starts, n = np.cumsum(sizes) - sizes, sizes[chunks]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.array(self.words, np.uint32)[np.repeat(starts[chunks] - ends + n, n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, self.chunks)])]
        return np.diff(bounds).tolist(), at


class Distinct:
    """The distinct pre-tokens of what would be a Block, without their positions."""

    def __init__(self, pattern: str):
        self.find, self.known = regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN
        self.whole: set[str] = set()
        self.chunks: set[str] = set()
        self.ids, self.chars = [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        if runs(text):
            self.whole.update(self.find(text))
        elif text:
            first, *rest = text.split(" ")
            self.whole.update(self.find(first))
            self.chunks.update(rest)
        self.ids.append(doc_id)
        self.chars += len(text)

    def words(self) -> set[str]:
        out, find = set(self.whole), self.find
        for c in self.chunks:
            if self.known and c.isalpha():
                out.add(" " + c)
            elif self.known and c[-1:] in _ENDS and c[:-1].isalpha():
                out.update((" " + c[:-1], c[-1]))
            else:
                out.update(find(" " + c))
        return out

    def buckets(self, rank: dict[bytes, int], n: int) -> list[list[bytes]]:
        """The words of _buckets() of the Block."""
        out: list[list[bytes]] = [[] for _ in range(n)]
        for word in self.words():
            if (raw := word.encode("utf-8", "surrogatepass")) not in rank:
                out[zlib.crc32(raw) % n].append(raw)
        for x in out:
            x.sort()
        return out


def blocks(batches: Iterator[pa.RecordBatch], pattern: str, block_chars: int, kind: type = Block) -> Iterator[tuple[int, Block | Distinct]]:
    """Numbered by partition and place."""
    block, at = kind(pattern), 0
    for batch in batches:
        at = at or (batch.column(2)[0].as_py() << 32 if batch.num_rows else 0)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            block.add(doc_id, text.as_py())
            if block.chars >= block_chars:
                yield at, block
                block, at = kind(pattern), at + 1
    if block.ids:
        yield at, block


def _buckets(block: Block, rank: dict[bytes, int], n: int) -> list[list[tuple[bytes, int]]]:
    """The block's words that need merging, with their indices, by hash bucket and sorted."""
    out: list[list[tuple[bytes, int]]] = [[] for _ in range(n)]
    for word, i in block.index.items():
        if (raw := word.encode("utf-8", "surrogatepass")) not in rank:
            out[zlib.crc32(raw) % n].append((raw, i))
    for x in out:
        x.sort()
    return out


def _pack(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], np.uint32)
    return zstandard.compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words), 3)


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)).tolist()
    body = raw[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _pack_ids(lists: list[list[int]]) -> bytes:
    counts = np.array([len(x) for x in lists], np.uint32)
    flat = np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum()))
    low, high = (flat & 0xFFFF).astype(np.uint16), (flat >> 16).astype(np.uint16)
    return zstandard.compress(np.uint32(len(lists)).tobytes() + counts.tobytes() + low.tobytes() + high.tobytes(), 3)


def _unpack_ids(packed: bytes) -> list[list[int]]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    counts = np.frombuffer(raw, np.uint32, n, 4)
    total = int(counts.sum())
    flat = (np.frombuffer(raw, np.uint16, total, 4 + 4 * n).astype(np.uint32) | np.frombuffer(raw, np.uint16, total, 4 + 4 * n + 2 * total).astype(np.uint32) << 16).tolist()
    ends = np.cumsum(counts).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _arrays(*columns: np.ndarray) -> bytes:
    """uint32 arrays, by byte planes, compressed."""
    sizes = np.array([len(columns), *map(len, columns)], np.uint32)
    return zstandard.compress(sizes.tobytes() + b"".join(np.ascontiguousarray(c, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns), 3)


def _from_arrays(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    k = int(np.frombuffer(raw, np.uint32, 1)[0])
    out, at = [], 4 + 4 * k
    for n in np.frombuffer(raw, np.uint32, k, 4).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).reshape(n))
        at += 4 * n
    return out


#: Stands for "more than one token" among the ids of single tokens.
MERGED = 0xFFFFFFFF


def word_ids(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(block, bucket, ids) of the merged words of each block, and (block, bucket -1, ...) its positions.

    Both scan the texts; a block's number is its partition and its place there, so docs has
    to be a stored table, whose scans give equal partitions.
    """
    n = partitions(docs.sparkSession)
    # A union numbers its tasks anew; this column counts the partitions of the scan itself.
    texts_ = texts(docs).withColumn("at", F.spark_partition_id())

    def words(batches):
        rank = ranks(path)
        for k, block in blocks(batches, pattern, block_chars, Distinct):
            rows = [(b, _pack(x)) for b, x in enumerate(block.buckets(rank, n)) if x]
            if rows:
                at = pa.array([k] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), at, pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block", "words"])

    def encoded(batches):
        encode_piece, known = merger(path, pattern), {}
        for batch in batches:
            out = []
            for packed in batch.column(2):
                ids = []
                for w in _unpack(packed.as_py()):
                    if (x := known.get(w)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        x = known[w] = encode_piece(w)
                    ids.append(x)
                out.append(_pack_ids(ids))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    def positions(batches):
        rank = ranks(path)
        for k, block in blocks(batches, pattern, block_chars):
            single = np.array([rank.get(w.encode("utf-8", "surrogatepass"), MERGED) for w in block.index], np.uint32)
            buckets = _buckets(block, rank, n)
            order = np.array([i for x in buckets for _, i in x], np.uint32)
            counts, at = block.positions()
            packed = _arrays(single, order, at)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([-1], pa.int32()), pa.array([packed], pa.binary()), pa.array([block.ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32()))], ["block", "bucket", "ids", "doc_ids", "counts"])

    ids = texts_.mapInArrow(words, "bucket int, block long, words binary").repartition(n, "bucket").mapInArrow(encoded, "block long, bucket int, ids binary")
    return ids, texts_.mapInArrow(positions, "block long, bucket int, ids binary, doc_ids array<long>, counts array<int>")


def assembled(docs: DataFrame, path: str, pattern: str, make, schema: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """make(path, doc_ids, counts, positions, word ids) over each block once its ids are back."""
    ids, positions = word_ids(docs, path, pattern, block_chars)
    n = partitions(docs.sparkSession)
    both = ids.select("block", "bucket", "ids", F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<int>").alias("counts")).unionByName(positions)

    def join(batches):
        def finish():
            doc_ids, counts, packed, lists = state
            single, order, at = _from_arrays(packed)
            if len(order) != len(lists):
                raise ValueError(f"a block has {len(order)} merged words and ids of {len(lists)}: the two scans differ")
            words = [[i] for i in single.tolist()]
            for i, x in zip(order.tolist(), lists):
                words[i] = x
            return make(path, doc_ids, counts, at, words)

        state = None
        for batch in batches:
            for block, bucket, packed, doc_ids, counts in zip(*(c for c in batch.columns)):
                if bucket.as_py() < 0:
                    if state:
                        yield finish()
                    state = (doc_ids.as_py(), counts.as_py(), packed.as_py(), [])
                else:
                    state[3].extend(_unpack_ids(packed.as_py()))
        if state:
            yield finish()

    return both.repartition(n, "block").sortWithinPartitions("block", "bucket").mapInArrow(join, schema)


def _encoded_rows(path, doc_ids, counts, at, words):
    at, start, out = at.tolist(), 0, []
    for c in counts:
        out.append([i for w in at[start : start + c] for i in words[w]])
        start += c
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])


@lru_cache(1)
def merger(path: str, pattern: str):
    """merge() by the compiled library; very long pre-tokens, where that takes the square of their length, by the heap."""
    rank = ranks(path)
    short = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rank, special_tokens={})._core_bpe.encode_single_piece
    return lambda word: short(word) if len(word) <= 200 else merge(word, rank)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) for every row of docs (doc_id, text), a stored table.

    A null or empty text has no ids; repeated rows and null doc_ids come back as they are; other
    columns are left out; no rows give no rows.
    """
    return assembled(docs, vocabulary or public_tokenizers.path(VOCABULARY), pattern, _encoded_rows, "doc_id long, ids array<int>", block_chars)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids): each id's bytes from the token-byte table; null ids give none."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches):
        table = token_bytes(path)
        for batch in batches:
            out = [b"".join(map(table.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def _digest_rows(path, doc_ids, counts, at, words):
    table = token_bytes(path)
    said = np.array([" ".join(map(str, x)).encode() for x in words], object)
    raw = np.array([b"".join([table[i] for i in x]) for x in words], object)
    size = np.array([len(x) for x in words], np.int64)[at] if len(at) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    start, n, a, b = 0, [], [], []
    for c in counts:
        own = at[start : start + c]
        n.append(int(total[start + c] - total[start]))
        a.append(hashlib.sha256(b" ".join(said[own].tolist())).hexdigest())
        b.append(hashlib.sha256(b"".join(raw[own].tolist())).hexdigest())
        start += c
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs its number of ids, the SHA-256 of the ids as text and of the bytes they decode to."""
    return assembled(docs, vocabulary or public_tokenizers.path(VOCABULARY), pattern, _digest_rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", block_chars)
