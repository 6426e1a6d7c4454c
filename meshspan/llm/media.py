"""Content-addressed media payloads in tar shards.

A text's UTF-8 bytes, padded with 255, become the grey samples of a PNG image of
fixed width.  Images are named by their payload's SHA-256 and stored once, in tar
shards of bounded size; rows carry digest, shard, offset and length.  Image
metadata is read from the first bytes of a stored image, never from the payload.

Only images of texts that have copies are shuffled, to be written once: a filter
sized by the number of digests that occur twice tells which may have any.
A text that passes it by chance is shuffled for nothing, and stored right.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import distinct_names, fresh_path, shuffle_parts, stored

WIDTH = 576
#: the PNG signature, a fixed value of the format
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: signature, and the IHDR chunk with its length, type and checksum
HEADER = len(SIGNATURE) + 4 + 4 + 13 + 4


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    """``raw`` with bytes 255 appended up to a positive multiple of ``unit``; UTF-8 never holds 255."""
    size = max(1, -(-len(raw) // unit)) * unit
    return raw + b"\xff" * (size - len(raw))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG whose samples, row by row, are the payload."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # a leading 0: rows are stored unfiltered
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes of a PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def decode_png(image: bytes) -> bytes:
    """The samples of an image that ``encode_png`` wrote."""
    width, height, _ = read_header(image[:HEADER])
    at, data = len(SIGNATURE), []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if zlib.crc32(image[at + 4 : at + 8 + size]) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("bad chunk checksum")
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


#: the filter has 16 bits a key, in powers of two between these; beyond the last more images are shuffled
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def _filter(keys: DataFrame) -> bytes:
    """Bits that are on for the low bits of every key's hash (column h)."""
    keys = stored(keys, "copied")
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    at = keys.select(F.col("h").bitwiseAND(size - 1).alias("at"))
    parts = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("long")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in parts.collect():  # at most MOST_BITS / 32768 rows
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.tobytes()


def _images(filter_bits: bytes, shared: bool):
    """Images of texts that may have copies (``shared``), each once a task, or of those that surely have none."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(filter_bits, np.uint8), bitorder="little").view(bool)
        seen = set()
        for b in batches:
            maybe = bits[b.column("h").to_numpy() & (len(bits) - 1)]
            for lo in range(0, b.num_rows, 256):
                keys, images = [], []
                for i in range(lo, min(lo + 256, b.num_rows)):
                    if maybe[i] != shared:
                        continue
                    k = b.column("key")[i].as_buffer().to_pybytes()
                    if k not in seen:
                        if shared:
                            seen.add(k)
                        keys.append(k)
                        images.append(encode_png(padded(b.column("raw")[i].as_buffer().to_pybytes())))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(images, pa.binary())], names=["key", "image"])

    return run


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = pa.schema([("key", pa.binary()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _shards(folder: str, shard_bytes: int):
    def run(batches):
        import tarfile
        import uuid
        from pathlib import PurePosixPath

        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        tar = stream = None
        name, last, number = "", None, 0
        for b in batches:
            out = []
            for key, image in zip(b.column(0), b.column(1)):
                key, image = key.as_buffer().to_pybytes(), image.as_buffer()
                if key == last:
                    continue
                last = key
                if tar is None or tar.offset > shard_bytes:
                    if tar is not None:
                        tar.close()
                        stream.close()
                    # Every attempt writes files of its own; a lost attempt's are never referred to.
                    name = f"shard-{ctx.partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.tar"
                    number += 1
                    stream = fs.open_output_stream(str(PurePosixPath(root) / name))
                    tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.USTAR_FORMAT)
                digest = hashlib.sha256(decode_png(image.to_pybytes())).hexdigest()
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = image.size
                head = tar.offset + 512
                tar.addfile(info, pa.BufferReader(image))
                out.append((key, digest, f"{folder}/{name}", head, image.size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), MANIFEST)], schema=MANIFEST)
        if tar is not None:
            tar.close()
            stream.close()

    return run


FACTS = pa.schema([
    ("key", pa.binary()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()),
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])


def feature(payload: bytes) -> str:
    """Mean, deviation and share of padding of the samples, and their coarse histogram."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total / len(x)
    return f"mean={mean:.4f};var={squares / len(x) - mean * mean:.4f};hist=" + ",".join(map(str, bins.tolist()))


def _facts(batches):
    opened, file = None, None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["shard"] != opened:
                if file is not None:
                    file.close()
                fs, path = _filesystem(r["shard"])
                opened, file = r["shard"], fs.open_input_file(path)
            width, height, depth = read_header(file.read_at(HEADER, r["offset"]))
            image = file.read_at(r["length"], r["offset"])
            payload = decode_png(image)
            out.append((*r.values(), width, height, depth, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(image).hexdigest(), feature(payload)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FACTS)], schema=FACTS)
    if file is not None:
        file.close()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shard_bytes: int = 256_000_000) -> DataFrame:
    """Store every text as an image in tar shards and return what the stored images say.

    Returns a row per input row: ``id_col``, digest (payload SHA-256, the
    address), shard (URI), offset, length; width, height, bit_depth from a range
    read of the header; n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_sha256, feature from the image read back.  ``folder`` is a URI that all
    executors reach, by default one in the shared folder.  Null and empty texts
    are one row of padding.  Equal texts share one image, and so do repeated
    rows.  An empty table writes nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "shards")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("raw")).withColumn("key", F.unhex(F.sha2("raw", 256)))
    keys = stored(rows.select("id", "key"), "keys")
    copied = keys.groupBy("key").count().filter("count > 1").select(F.xxhash64("key").alias("h"))
    bits = spark.sparkContext.broadcast(_filter(copied))  # MOST_BITS / 8 bytes at most
    hashed = rows.select("key", "raw", F.xxhash64("key").alias("h"))

    def placed(shared: bool) -> DataFrame:
        def run(batches):
            return _images(bits.value, shared)(batches)

        images = hashed.mapInArrow(run, "key binary, image binary")
        if shared:  # copies meet before they are written; all other images stay where they are made
            images = images.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key")
        return images.mapInArrow(_shards(folder, shard_bytes), "key binary, digest string, shard string, offset long, length long")

    manifest = stored(placed(True).union(placed(False)), "manifest")
    ddl = "key binary, digest string, shard string, offset long, length long, width int, height int, bit_depth int, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"
    facts = stored(manifest.mapInArrow(_facts, ddl), "facts")
    out = keys.join(facts, "key").drop("key")
    return out.withColumnRenamed("id", distinct_names([id_col], [c for c in out.columns if c != "id"])[0])
