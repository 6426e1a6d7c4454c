"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into three segments.  Two fingerprints at most two
bits apart agree in at least one segment (three segments, two errors), and in
the next segment they differ in at most two bits.  The perfect [23,12,7] Golay
code turns that second segment into a few keys: every word within one bit of it
is decoded to its nearest codeword, which gives one key or six.  Two words at
most two bits apart share a word within one bit of both, hence a key.  So the
pair meets under (segment number, exact segment, codeword index).

Only distinct fingerprints are joined.  A key's fingerprints are verified in
pairs while there are few; fingerprints of fuller keys are verified through
their one-bit neighbours instead: those that share a neighbour are linked to the
smallest of them.  That is exact and linear, so no group emits all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import distinct_names, stored

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: keys with more fingerprints than this are verified by neighbours, not pairs
PAIRS_UP_TO = 64
#: the generator polynomial of the binary Golay code, a fixed value
GOLAY = 0xC75


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a UTF-8 text's word shingles in order; a shorter text is one shingle, a blank one has none."""
    import xxhash

    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[a:z], 42) for a, z in zip(starts, ends)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text."""
    h = shingle_hashes(text, shingle)
    n = len(h)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        bits = np.unpackbits(h[lo : lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int, schema: pa.Schema):
    def run(batches):
        for b in batches:
            out = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column("text")]
            fp = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id").cast(schema[0].type), b.column("hash"), fp], schema=schema)

    return run


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes by byte (3 x 256), and for each of the 2048 syndromes its error pattern of up to three bits."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GOLAY << (bit - 11)
        return v

    by_byte = np.array([[syndrome((x << 8 * k) & 0x7FFFFF) for x in range(256)] for k in range(3)], np.uint32)
    leader = np.zeros(2048, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            leader[syndrome(e)] = e
    return by_byte, leader


def golay_keys(words: np.ndarray, tables=None) -> np.ndarray:
    """Codeword indices (12 bits) of all words within one bit of each 23-bit word: an (n, 24) array with repeats."""
    by_byte, leader = tables or golay_tables()
    near = words.astype(np.uint32)[:, None] ^ np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    s = by_byte[0][near & 255] ^ by_byte[1][near >> 8 & 255] ^ by_byte[2][near >> 16]
    return (near ^ leader[s]) >> 11


def _keys(batches):
    tables = golay_tables()
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        u = fp.view(np.uint64)
        seg = [(u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
        for j in range(3):
            k = np.sort(golay_keys(seg[(j + 1) % 3], tables).astype(np.int64), axis=1)
            fresh = np.ones(k.shape, bool)
            fresh[:, 1:] = k[:, 1:] != k[:, :-1]
            row, col = np.nonzero(fresh)
            key = (j << 40) | (seg[j][row] << 12) | k[row, col]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])


def _pairs(max_bits: int):
    def run(batches):
        for b in batches:
            a, z = [], []
            for fps in b.column(0):
                x = np.sort(fps.values.to_numpy()).view(np.uint64)
                i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x) <= max_bits, 1))
                a.append(x[i])
                z.append(x[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64)) for s in (a, z)], names=["a", "b"])

    return run


def _neighbours(batches):
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(fp), 4096):
            x = fp[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array((x.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(x, 65))], names=["near", "fp"])


def links(fps: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (column fp) chained by steps of two bits or fewer."""
    keys = fps.mapInArrow(_keys, "key long, fp long")
    sizes = stored(keys.groupBy("key").count().filter("count > 1"), "keysizes")
    few = keys.join(sizes.filter(F.col("count") <= pairs_up_to).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    pairs = few.mapInArrow(_pairs(2), "a long, b long")
    full = sizes.filter(F.col("count") > pairs_up_to).select("key")
    if full.isEmpty():
        return pairs
    crowd = keys.join(full, "key").select("fp").distinct()
    star = stored(crowd.mapInArrow(_neighbours, "near long, fp long").groupBy("near").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1), "stars")
    star = star.select(F.explode("fps").alias("a"), "b").filter("a <> b").distinct()
    return pairs.union(star)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Near-duplicate groups: fingerprints linked at two or fewer differing bits.

    Returns a row per input row: ``id_col``, text_hash (xxhash64 of the text),
    fingerprint (16 hex digits), component_id (smallest id of the group, null
    ids left out), keep (true for the group's representative: its smallest id,
    null ids last, then smallest text_hash; rows equal in both are all marked).
    Null, empty and blank texts have fingerprint zero and are linked like any
    other; repeated rows share a group; an empty table gives an empty result.
    Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, ddl = docs.schema[id_col].dataType, docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    schema = pa.schema([("id", to_arrow_type(id_type)), ("hash", pa.int64()), ("fp", pa.int64())])
    d = stored(src.mapInArrow(_fingerprints(shingle, schema), f"id {ddl}, hash long, fp long"), "fingerprints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))
    per = stored(d.groupBy("fp").agg(best.alias("best")), "byfp")
    comp = components(links(per.select("fp")))
    rooted = per.join(comp, per.fp == comp.id, "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    top = rooted.groupBy("root").agg(F.min("best").alias("top"))
    label = stored(rooted.join(top, "root").select("fp", "top"), "groups")
    out = d.join(label, "fp").select(
        F.col("id").alias(distinct_names([id_col], ["text_hash", "fingerprint", "component_id", "keep"])[0]),
        F.col("hash").alias("text_hash"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("top.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("hash") == F.col("top.hash"))).alias("keep"),
    )
    return out
