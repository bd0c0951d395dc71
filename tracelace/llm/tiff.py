"""Media columns: TIFF, one row a page.

The reader walks the image directories of a file, decodes PackBits, LZW or deflate strips and tiles, undoes horizontal
predictors and gives each page's samples as bytes. A writer for the same layouts makes files to read back.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a field type; tags; compressions.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: How many bytes a byte can stand for at most (LZW: a table's entries grow by one byte a code, up to 12 bits).
_MOST = {NONE: 1, PACKBITS: 64, LZW: 1500, DEFLATE: 1032, OLD_DEFLATE: 1032}


class Broken(ValueError):
    """A file that can't be read."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as runs; what lies between as literals of up to 128 bytes."""
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(len(part[i : i + 128]) - 1)
            out.extend(part[i : i + 128])

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(data[at : m.start()])
        out.extend((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(data[at:])
    return bytes(out)


_CLEAR, _END = 256, 257


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first, which widen one code early."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(start), 9, b""
    out, buffer, held = bytearray(), 0, 0
    for byte in data:
        buffer, held = (buffer << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = buffer >> held
        buffer &= (1 << held) - 1
        if code == _CLEAR:
            table, width, last = list(start), 9, b""
            continue
        if code == _END or len(out) >= size:
            break
        if not last:
            if code > 255:
                raise Broken("an LZW code comes before its entry")
            last = table[code]
            out += last
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table):
            entry = last + last[:1]
        else:
            raise Broken("an LZW code comes before its entry")
        out += entry
        table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, buffer, held = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, free, have = 9, 258, b""

    def put(code: int) -> None:
        nonlocal buffer, held
        buffer, held = (buffer << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(buffer >> held)
            buffer &= (1 << held) - 1

    def code_of(s: bytes) -> int:
        return s[0] if len(s) == 1 else table[s]

    put(_CLEAR)
    for i in range(len(data)):
        longer = have + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            have = longer
            continue
        put(code_of(have))
        table[longer] = free
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
        if free >= 4094:
            put(_CLEAR)
            table, width, free = {}, 9, 258
        have = data[i : i + 1]
    if have:
        put(code_of(have))
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(_END)
    if held:
        out.append(buffer << (8 - held) & 255)
    return bytes(out)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    """A block's ``size`` bytes; a block that has fewer is broken, and more aren't made."""
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = unpack_lzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise Broken(str(e)) from None
    else:
        raise Broken(f"compression {compression} isn't read")
    if len(out) < size:
        raise Broken("a block is too short")
    return out[:size]


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    layout: str
    blocks: int
    pixels: bytes


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The byte order and the integer fields of each directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise Broken("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise Broken("the chain of directories is broken")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise Broken("a directory is cut off")
        fields: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if where + size > len(data):
                raise Broken("a field is cut off")
            if kind in (1, 3, 4):
                fields[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, where))
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file with 8, 16 or 32 bits a sample; raises Broken at what can't be read."""
    for number, (order, f) in enumerate(_directories(data)):
        one = lambda tag, default=None: f[tag][0] if f.get(tag) else default  # noqa: E731, B023
        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if not width or not height or bits not in (8, 16, 32) or len(set(f.get(BITS, [bits]))) > 1 or predictor not in (1, 2) or planar not in (1, 2):
            raise Broken("a page's layout isn't read")
        tiled = TILES in f
        offsets, sizes = f.get(TILES if tiled else STRIPS), f.get(TILE_BYTES if tiled else STRIP_BYTES)
        wide = one(TILE_WIDTH) if tiled else width
        high = one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, height), height)
        if not offsets or not sizes or not wide or not high:
            raise Broken("a page has no blocks")
        across, down = -(-width // wide), -(-height // high)
        planes, depth = (samples, 1) if planar == 2 else (1, samples)
        if len(offsets) < across * down * planes or len(sizes) < len(offsets):
            raise Broken("a page lacks blocks")
        if width * height * samples * bits // 8 > (1 << 16) + _MOST.get(compression, 0) * sum(sizes):
            raise Broken("a page is larger than its file can hold")
        kind = np.dtype(f"{order}u{bits // 8}")
        image = np.zeros((height, width, samples), kind.newbyteorder("="))
        for b in range(across * down * planes):
            plane, within = divmod(b, across * down)
            y, x = within // across * high, within % across * wide
            rows = high if tiled else min(high, height - y)
            block = np.frombuffer(unpack(data[offsets[b] : offsets[b] + sizes[b]], compression, rows * wide * depth * kind.itemsize), kind)
            block = block.reshape(rows, wide, depth).astype(image.dtype)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=image.dtype)
            keep = block[: height - y, : width - x]
            image[y : y + rows, x : x + wide, plane if planar == 2 else slice(None)] = keep[:, :, 0] if planar == 2 else keep
        yield Page(number, width, height, samples, bits, NAMES[compression], predictor, "tiles" if tiled else "strips", len(offsets), image.astype(image.dtype.newbyteorder("<")).tobytes())


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A file with a page for each image (height, width, samples) of 8, 16 or 32 bits; ``tile`` is (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        kind = image.dtype.newbyteorder(order)
        high, wide = tile or (rows, width)
        offsets, sizes = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                block = image[y : y + high, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = block.astype(kind).tobytes()
                packed = {NONE: lambda r: r, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda r: zlib.compress(r, level)}[compression](raw)
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed
                out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * kind.itemsize] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1])]
        fields += [] if tile else [(STRIPS, 4, offsets)]
        fields += [(SAMPLES, 3, [samples])]
        fields += [] if tile else [(STRIP_ROWS, 4, [high]), (STRIP_BYTES, 4, sizes)]
        fields += [(PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [high]), (TILES, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else []
        entries = bytearray()
        for tag, k, values in fields:
            body = struct.pack(f"{order}{len(values)}{'H' if k == 3 else 'I'}", *values)
            if len(body) > 4:
                entries += struct.pack(order + "HHII", tag, k, len(values), len(out))
                out += body
                out += b"\0" * (len(out) % 2)
            else:
                entries += struct.pack(order + "HHI", tag, k, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def feature(page: Page) -> str:
    """Whole numbers that describe a page: its shape, sum, sum of squares, sums of differences across and down, and distinct values."""
    image = np.frombuffer(page.pixels, f"<u{page.bits // 8}").reshape(page.height, page.width * page.samples).astype(np.int64)
    across, down = np.abs(np.diff(image, axis=1)).sum(), np.abs(np.diff(image, axis=0)).sum()
    return f"{page.height}x{page.width}x{page.samples}:{image.sum()}:{(image * image).sum()}:{across}:{down}:{len(np.unique(image))}"


#: What a page row has, after the carried columns.
SCHEMA = "page int, width long, height long, samples int, bits int, compression string, predictor int, layout string, blocks int, feature string, pixels binary, error string"
#: Rows of one Arrow batch that is sent back hold about so many bytes of pixels.
_SENT = 8 << 20


def page_rows(files: DataFrame, media: str, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns and one row for each page of each file, in the order of its directories.

    A null file has no rows. A file that can't be read has the rows of the pages before the fault, and one whose
    ``error`` tells the fault and whose other columns are null.
    """
    kinds = dict(files.dtypes)
    if clash := {x.split()[0] for x in SCHEMA.split(", ")}.intersection(carry):
        raise ValueError(f"carried columns have names of pages' columns: {sorted(clash)}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(n, t) for n, t in (("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("layout", pa.string()), ("blocks", pa.int32()), ("feature", pa.string()), ("pixels", pa.binary()), ("error", pa.string()))]

        def sent(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
            return pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[: len(carry)]), *columns], names=[*carry, *(f.name for f in fields)])

        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            held = 0
            for i, value in enumerate(batch.column(len(carry))):
                data = value.as_py()
                if data is None:
                    continue
                try:
                    for p in pages(data):
                        at.append(i)
                        rows.append((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.layout, p.blocks, feature(p), p.pixels, None))
                        held += len(p.pixels)
                except Broken as e:
                    at.append(i)
                    rows.append((*[None] * 11, str(e)))
                if held > _SENT:
                    yield sent(batch, at, rows)
                    at, rows, held = [], [], 0
            if rows:
                yield sent(batch, at, rows)

    return files.select(*carry, F.col(media).cast("binary").alias("_media")).mapInArrow(read, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", " + SCHEMA)


#: The forms in which texts are stored, by the lowest bits of the payload's crc32: compression, predictor, tile. LZW is one
#: in sixteen, since its codec is the dearest.
FORMS = (
    (LZW, 1, None), (PACKBITS, 1, None), (DEFLATE, 2, None), (DEFLATE, 2, (64, 64)), (PACKBITS, 1, (64, 64)), (DEFLATE, 1, None), (PACKBITS, 2, None), (DEFLATE, 1, (32, 192)),
    (DEFLATE, 2, (16, 96)), (PACKBITS, 1, None), (DEFLATE, 2, None), (DEFLATE, 2, (64, 64)), (PACKBITS, 1, (64, 64)), (DEFLATE, 1, None), (NONE, 2, None), (DEFLATE, 1, (32, 192)),
)
#: Rows of one page.
PAGE_ROWS = 256


def stored(payload: bytes, width: int = 192) -> bytes:
    """Bytes as pages of 8-bit samples, PAGE_ROWS rows each; the form follows the payload's crc32, so every size meets every form."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width, 1)
    compression, predictor, tile = FORMS[zlib.crc32(payload) & 15]
    return write([image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)], compression, predictor, tile=tile)


def text_files(docs: DataFrame, width: int = 192) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 with spaces up to a positive multiple of ``width``, stored as pages.

    Null and empty texts are one row of spaces; long ones have more pages. Null ids, repeated rows and extra columns
    change nothing; no rows give none.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                media = [stored(t + b" " * (-len(t) % width if t else width)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(make, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary")


def file_rows(files: DataFrame, media: str, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns and one row for each file: its pages' number, joined features and pixels, and its first fault, if any.

    A file's pages are read one after the other in the task that has the file; files aren't shuffled. Null files have no row.
    """
    kinds = dict(files.dtypes)
    names = ["pages", "compression", "layout", "feature", "pixels", "error"]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            held = 0
            for i, value in enumerate(batch.column(len(carry))):
                if (data := value.as_py()) is None:
                    continue
                found: list[Page] = []
                error = None
                try:
                    found.extend(pages(data))
                except Broken as e:
                    error = str(e)
                first = found[0] if found else None
                at.append(i)
                rows.append((len(found), first and first.compression, first and first.layout, "|".join(map(feature, found)), b"".join(p.pixels for p in found), error))
                held += len(rows[-1][4])
                if held > _SENT:
                    yield sent(batch, at, rows)
                    at, rows, held = [], [], 0
            if rows:
                yield sent(batch, at, rows)

    def sent(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[: len(carry)]), *columns], names=[*carry, *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "pages int", "compression string", "layout string", "feature string", "pixels binary", "error string"])
    return files.select(*carry, F.col(media).cast("binary").alias("_media")).mapInArrow(read, schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row for each text: its stored form's and its payload's digests, the payload being what is read back from that form."""
    files = text_files(docs).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    read = file_rows(files, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return read.select("doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "pages", "compression", "layout")
