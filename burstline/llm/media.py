"""Media columns: payloads stored in baseline JPEG files, read back by an own parser.

A file is a greyscale baseline JPEG.  Each 8x8 block carries 64 payload bytes as its 64
coefficients in zigzag order.  A byte b is the 8 extra bits of size category 8, that is the
coefficient b for b >= 128 and b - 255 below: no byte is lost to rounding, since the
coefficients are stored as they are.  A restart marker after every block sets the DC prediction
to 0.  The Huffman tables hold the single symbol they need, so a block takes 576 bits.

The reader parses markers, Huffman-decodes the scan and rebuilds a luminance thumbnail from the
DC coefficients alone.  It reads any greyscale baseline file; where all symbols of a scan have
one length, as in files written here, numpy decodes all blocks at once.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

BLOCK = 64
#: Blocks along an edge of a baseline file, whose edges are 16-bit.
EDGE = 65535 // 8
#: Quantisation of DC and AC: DC spans the luminance range, AC stays as it is.
DC_STEP, AC_STEP = 4, 1
#: Edge of the square that a thumbnail is reduced to before it is hashed.
HASH_EDGE = 8
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


#: The coefficient of size category 8 for each byte of extra bits.
_VALUES = np.array([b if b >= 128 else b - 255 for b in range(256)], np.int16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_symbol(kind: int, symbol: int) -> bytes:
    return bytes([kind << 4, 1, *[0] * 15, symbol])


#: One 1-bit code each: DC size 8; AC run 0, size 8.
_TABLES = _segment(0xDB, bytes([0, DC_STEP, *[AC_STEP] * 63])) + _segment(0xC4, _one_symbol(0, 8)) + _segment(0xC4, _one_symbol(1, 8))


def _packed(blocks: np.ndarray) -> np.ndarray:
    """n x 64 bytes → n x 72: a 0 bit, the code of the only symbol, before each byte."""
    b = np.ascontiguousarray(blocks.reshape(-1, 8).T)
    out = np.zeros((9, b.shape[1]), np.uint8)
    for i in range(8):  # byte i of eight starts at bit 9 i + 1
        out[i] |= b[i] >> (i + 1) if i < 7 else 0
        out[i + 1] |= b[i] << (7 - i)
    return np.ascontiguousarray(out.T).reshape(-1, 72)


def shape(n: int) -> tuple[int, int]:
    """Blocks across and down for n blocks."""
    across = min(EDGE, math.isqrt(n - 1) + 1)
    if (down := -(-n // across)) > EDGE:
        raise ValueError(f"{n} blocks don't fit into one file of {EDGE} x {EDGE}")
    return across, down


def payload(text: str) -> bytes:
    """UTF-8, zero bytes up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def encode(data: bytes, size: int | None = None) -> bytes:
    """The JPEG file that stores data, a positive multiple of 64 bytes; `size`, the bytes that count, goes into a comment."""
    if not data or len(data) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    n = len(data) // BLOCK
    across, down = shape(n)
    blocks = np.zeros((across * down, BLOCK), np.uint8)
    blocks[:n] = np.frombuffer(data, np.uint8).reshape(n, BLOCK)
    scan = _packed(blocks)
    # RST0 to RST7 stand between the blocks; a byte FF inside a block is followed by 00.
    body = np.empty((len(blocks), 74), np.uint8)
    body[:, :72], body[:, 72], body[:, 73] = scan, 0xFF, 0xD0 + np.arange(len(blocks)) % 8
    block, at = np.nonzero(scan == 0xFF)
    body = np.insert(body.ravel(), block * 74 + at + 1, 0) if len(block) else body.ravel()
    body = body[:-2]
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xFE, struct.pack(">QQ", n, len(data) if size is None else size))
    frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * down, 8 * across, 1, 1, 0x11, 0))
    return head + _TABLES + frame + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body.tobytes() + b"\xff\xd9"


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) → symbol of a canonical table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse(file: bytes) -> dict:
    """Dimensions, tables, comment and scan of a greyscale baseline file."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    out: dict = {"quantisation": {}, "huffman": {}, "restart": 0, "comment": b""}
    at = 2
    while True:
        if file[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = file[at + 1]
        if marker == 0xFF:  # fill bytes
            at += 1
            continue
        (size,) = struct.unpack_from(">H", file, at + 2)
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quantisation"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huffman"][body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts != 1:
                raise ValueError("only 8-bit greyscale files are read")
            out["table"] = body[8]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline file")
        elif marker == 0xDD:
            (out["restart"],) = struct.unpack(">H", body)
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            out["dc"], out["ac"] = out["huffman"][body[2] >> 4], out["huffman"][0x10 | body[2] & 15]
            out["scan"] = np.frombuffer(file, np.uint8, offset=at)
            return out


def _fixed(table: dict[tuple[int, int], int]) -> bool:
    return len(table) == 1 and next(iter(table.items())) == ((1, 0), 8)


def coefficients(image: dict) -> np.ndarray:
    """Blocks x 64 quantised coefficients in zigzag order, left to right and top to bottom."""
    n = -(-image["width"] // 8) * -(-image["height"] // 8)
    scan = image["scan"]
    full = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[full + 1]
    end = full[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    end = int(end[0]) if len(end) else len(scan)
    full, after = full[full < end], after[full < end]
    marker = full[after != 0]
    keep = np.ones(end, bool)
    keep[full + 1] = False
    keep[marker] = False
    if image["restart"] == 1 and _fixed(image["dc"]) and _fixed(image["ac"]):
        raw = scan[:end][keep]
        if len(raw) != 72 * n or len(marker) != n - 1:
            raise ValueError("the scan is cut short")
        raw = np.ascontiguousarray(raw.reshape(-1, 9).T)
        extra = np.empty((8, raw.shape[1]), np.uint8)
        for i in range(8):
            extra[i] = raw[i] << (i + 1) | raw[i + 1] >> (7 - i) if i < 7 else raw[8]
        return _VALUES[extra.T].reshape(n, 64)
    # Any other scan, symbol by symbol, one restart interval after the other.
    bounds = [0, *marker.tolist(), end]
    out = np.zeros((n, 64), np.int16)
    block = 0
    for a, b in zip(bounds, bounds[1:]):
        bits = np.unpackbits(scan[a:b][keep[a:b]]).tolist()
        last = min(n, block + image["restart"]) if image["restart"] else n
        _scan(bits, image["dc"], image["ac"], out[block:last])
        block = last
    return out


def _scan(bits: list[int], dc: dict, ac: dict, out: np.ndarray) -> None:
    at, previous = 0, 0

    def symbol(table: dict) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits[at]
            at += 1
            if (x := table.get((length, code))) is not None:
                return x
        raise ValueError("no such Huffman code")

    def value(size: int) -> int:
        nonlocal at
        x = 0
        for b in bits[at : at + size]:
            x = x << 1 | b
        at += size
        return x if size == 0 or x >> (size - 1) else x - (1 << size) + 1

    for row in out:
        previous += value(symbol(dc))
        row[0], k = previous, 1
        while k < 64:
            run, size = divmod(symbol(ac), 16)
            if size == 0 and run != 15:
                break
            k += run
            if size:
                row[k] = value(size)
            k += 1


def thumbnail(image: dict, blocks: np.ndarray) -> np.ndarray:
    """Mean luminance of every 8x8 block, from the DC coefficients alone."""
    step = int(image["quantisation"][image["table"]][0])
    dc = np.clip(np.rint(blocks[:, 0].astype(np.int64) * step / 8) + 128, 0, 255).astype(np.uint8)
    return dc.reshape(-(-image["height"] // 8), -(-image["width"] // 8))


def average_hash(grey: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 reduction are brighter than their mean."""
    h, w = grey.shape
    rows, columns = (np.arange(HASH_EDGE) * x // HASH_EDGE for x in (h, w))
    total = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), rows, 0), columns, 1)
    cells = total / np.outer(np.maximum(np.diff(rows, append=h), 1), np.maximum(np.diff(columns, append=w), 1))
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


def decode(file: bytes) -> tuple[bytes, int, str]:
    """The payload of a file that encode() wrote, the bytes of it that count, and its feature: dimensions, thumbnail's SHA-256 and average hash."""
    image = parse(file)
    blocks = coefficients(image)
    n, size = struct.unpack(">QQ", image["comment"])
    data = (blocks.astype(np.uint8) - (blocks < 0))[:n].tobytes()
    grey = thumbnail(image, blocks)
    return data, size, f"{image['width']}x{image['height']}:{hashlib.sha256(grey.tobytes()).hexdigest()[:16]}:{average_hash(grey)}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every text of docs as a JPEG file.  Null and empty texts are one block of zeros; repeated rows stay; other columns are left out."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                files = [encode(payload(t), len(t.encode("utf-8", "surrogatepass"))) for x in own.column(1) for t in (x.as_py(),)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold, by row of media (doc_id, media): sizes and digests of payload and file, dimensions and thumbnail hashes.  Null media give null values."""
    names = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def read(file: bytes | None) -> tuple:
        if file is None:
            return (None,) * 7
        data, size, feature = decode(file)
        return size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature

    def run(batches):
        for batch in batches:
            cells = list(zip(*(read(x.as_py()) for x in batch.column(1)))) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cells, kinds))], ["doc_id", *names])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
