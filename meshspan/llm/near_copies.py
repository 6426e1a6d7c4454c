"""Near copies by the share of word shingles that two texts have in common.

Texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more.  Candidates share a band of MinHash values (32 bands of
six: of pairs at 0.8 exactly six in a hundred thousand share none, of closer
pairs fewer, and of pairs at 0.3 only one in forty shares one); every link is
then checked on the full sets.

The texts of a band's bucket are checked in one task while they are few
megabytes.  A fuller bucket is split into chunks.  Each chunk first meets the
bucket's smallest text.  Jaccard distance obeys the triangle inequality, so of
the texts linked to that one only those can matter further that are far enough
from it to reach an unlinked text; a bucket whose texts are all linked is done.
Chunks of what is left meet each other in pairs, each pair a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stored
from .wordhash import NOT_SPACE, Hasher, Pack, mix64, packs

BANDS, ROWS = 32, 6
#: text that one task checks at a time
CHUNK_BYTES = 4_000_000
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: odd multipliers of the MinHash permutations, fixed values
FACTORS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' word shingles, text by text, and where each text's begin; shorter texts are one shingle."""
    pack, hasher = Pack([t.translate(LOWER) for t in texts], NOT_SPACE), Hasher(3)
    words = hasher.words(pack.raw, pack.starts, pack.ends)
    sizes = np.diff(pack.first)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found, whose = [], []
    for n in range(1, shingle + 1):
        at = pack.fitting(n)
        at = at[sizes[owner[at]] == n] if n < shingle else at
        found.append(hasher.windows(words, n)[at] if len(at) else at.astype(np.uint64))
        whose.append(owner[at])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(whose[order], np.arange(len(texts) + 1))


def band_keys(texts: list[bytes], shingle: int) -> np.ndarray:
    """A row of band keys for each text; rows of texts without a word mean nothing."""
    h, first = shingles(texts, shingle)
    least = np.full((len(texts), len(FACTORS)), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    for lo in range(0, len(h), 4096):
        who = owner[lo : lo + 4096]
        starts = np.flatnonzero(np.diff(who, prepend=-1))
        part = np.minimum.reduceat(h[lo : lo + 4096, None] * FACTORS, starts, axis=0)
        least[who[starts]] = np.minimum(least[who[starts]], part)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(texts), 1))
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
    return key


def shingle_sets(texts: list[bytes], shingle: int) -> list[set]:
    h, first = shingles(texts, shingle)
    return [set(h[a:z].tolist()) for a, z in zip(first, first[1:])]


def similarity_of(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0


def trees(nodes: list[int], sets: list[set], similarity: float) -> list[tuple[int, int]]:
    """Edges from the first node of each group to its others: groups are chained by steps of at least ``similarity``."""
    parts: list[list[int]] = []
    for i, s in enumerate(sets):
        hit, rest = [i], []
        for part in parts:
            for j in reversed(part):
                few, many = sorted((len(s), len(sets[j])))
                if few >= similarity * many and similarity_of(s, sets[j]) >= similarity:
                    hit = part + hit
                    break
            else:
                rest.append(part)
        parts = rest + [hit]
    return [(nodes[min(part)], nodes[j]) for part in parts for j in part if j != min(part)]


def _sketch(shingle: int):
    schema = pa.schema([("hash", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = ((h, t.as_buffer().to_pybytes()) for h, t in zip(b.column("hash").to_pylist(), b.column("text")) if t.is_valid)
            for part in packs((h, t) for h, t in rows if t.split(None, 1)):
                keys = band_keys([t for _, t in part], shingle)
                at = pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS)
                flat = pa.array(keys.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in part], pa.int64()), pa.array([len(t) for _, t in part], pa.int64()), pa.ListArray.from_arrays(at, flat)], schema=schema)

    return run


def _linked(shingle: int, similarity: float):
    """Edges of one chunk's texts, each text once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        texts = dict(zip(table.column("hash").to_pylist(), table.column("text").to_pylist()))
        nodes = sorted(texts)
        edges = trees(nodes, shingle_sets([texts[h] for h in nodes], shingle), similarity)
        return pa.Table.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _to_first(shingle: int):
    """Each text's similarity to the bucket's smallest, which every chunk holds."""
    schema = pa.schema([("bucket", pa.int64()), ("first", pa.int64()), ("hash", pa.int64()), ("alike", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        texts = dict(zip(table.column("hash").to_pylist(), table.column("text").to_pylist()))
        first = table.column("first")[0].as_py()
        nodes = list(texts)
        sets = dict(zip(nodes, shingle_sets([texts[h] for h in nodes], shingle)))
        alike = [similarity_of(sets[h], sets[first]) for h in nodes]
        n = len(nodes)
        return pa.Table.from_arrays([pa.array([table.column("bucket")[0].as_py()] * n, pa.int64()), pa.array([first] * n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(alike, pa.float64())], schema=schema)

    return run


def _chunks(total: str, chunk_bytes: int):
    return F.ceil(F.col(total) / chunk_bytes)


def near_copy_roots(docs: DataFrame, among: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, root) of the texts of ``among`` (columns ``id_col`` and text_hash, the text's xxhash64) that have a near copy there.

    ``id`` is the text's hash, ``root`` the smallest hash of its group: texts
    chained by steps of at least ``similarity``.  Null texts, texts without a word
    and texts without a near copy are absent; repeated rows count once; a very
    long text is a chunk of its own; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    among = among.select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct()
    hashes = among.select("hash").distinct()
    sketches = stored(src.select("hash", "text").mapInArrow(_sketch(shingle), "hash long, size long, keys array<long>"), "sketches")
    # Copies of a text fold before they are shuffled, so a large group of them is one row a task.
    sketches = sketches.groupBy("hash").agg(F.first("size").alias("size"), F.first("keys").alias("keys")).join(hashes, "hash", "left_semi")
    keyed = stored(sketches.select(F.explode("keys").alias("bucket"), "hash", "size"), "bands")
    # Buckets of the same texts are checked once; equal counts, ends and checksums say that they are the same.
    same = ["n", "lo", "hi", "sum"]
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.bit_xor(F.xxhash64("hash")).alias("sum"), F.sum("size").alias("bytes"))
    buckets = buckets.filter("n > 1").groupBy(*same).agg(F.min(F.struct("bucket", "bytes")).alias("b")).select("b.*", F.col("lo").alias("first"))
    # Hints keep one plan at all sizes: neither side of these joins is small for long.
    member = stored(keyed.join(buckets.hint("merge"), "bucket"), "buckets")
    # One row for each text: copies of it are not read twice, however many there are.
    wanted = stored(member.select("hash").distinct().join(among, "hash").groupBy("hash").agg(F.min_by(F.struct("id"), F.struct(F.col("id").isNull(), "id")).alias("k")).select("hash", "k.id"), "wanted")
    w = wanted.select(F.col("hash").alias("w_hash"), F.col("id").alias("w_id"))
    some = src.join(w, (F.col("hash") == F.col("w_hash")) & F.col("id").eqNullSafe(F.col("w_id")), "left_semi")
    texts = stored(some.select("hash", "text").dropDuplicates(["hash"]), "texts").hint("merge")

    small = member.filter(F.col("bytes") <= chunk_bytes).select("bucket", "hash").join(texts, "hash")
    edges = small.groupBy("bucket").applyInArrow(_linked(shingle, similarity), "a long, b long")

    large = member.filter(F.col("bytes") > chunk_bytes)
    if large.isEmpty():
        return components(edges)
    large = large.withColumn("chunks", _chunks("bytes", chunk_bytes)).withColumn("chunk", F.pmod(F.xxhash64("hash"), "chunks"))
    heads = large.select("bucket", "first", "chunks").distinct().select("bucket", "first", F.col("first").alias("hash"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    meet = large.select("bucket", "first", "hash", "chunk").union(heads.select("bucket", "first", "hash", "chunk")).distinct()
    alike = meet.join(texts, "hash").groupBy("bucket", "chunk").applyInArrow(_to_first(shingle), "bucket long, first long, hash long, alike double")
    alike = stored(alike.filter("hash <> first"), "alike")
    edges = edges.union(alike.filter(F.col("alike") >= similarity).select(F.col("first").alias("a"), F.col("hash").alias("b")))
    nearest = alike.filter(F.col("alike") < similarity).groupBy("bucket").agg(F.max("alike").alias("nearest"))
    left = alike.join(nearest, "bucket").filter(F.col("alike") <= F.col("nearest") + (1 - similarity) + 1e-9)
    left = left.select("bucket", "hash").join(member.select("bucket", "hash", "size"), ["bucket", "hash"])
    parts = left.groupBy("bucket").agg(F.sum("size").alias("rest")).withColumn("parts", _chunks("rest", chunk_bytes)).select("bucket", "parts")
    left = stored(left.join(parts, "bucket").withColumn("i", F.pmod(F.xxhash64("hash"), "parts")), "left")
    pairs = left.select("bucket", "hash", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"))
    pairs = pairs.select("bucket", "hash", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    edges = edges.union(pairs.join(texts, "hash").groupBy("bucket", "i", "j").applyInArrow(_linked(shingle, similarity), "a long, b long"))
    return components(edges)
