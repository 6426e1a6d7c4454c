"""Benchmark decontamination by winnowing.

Each window of ``window`` words keeps the smallest hash of its k-grams as its
fingerprint.  Equal windows keep equal fingerprints, so every shared span of
``window`` words or more is found.  Training windows whose fingerprint may be a
benchmark fingerprint (a filter sized by their number tells) are carried on with a
128-bit hash of the whole window; a join on fingerprint and hash extends the hit
to the full window.  Benchmark items shorter than a window form one window of
their own length.

Only the filter, of 16 MB at most, goes to all executors.  The benchmark
itself is joined as a table: Spark broadcasts it if its size allows and shuffles
it if not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import distinct_names, stored
from .wordhash import ALNUM, Hasher, Pack, packs

#: the filter has 16 bits a key, in powers of two between these; beyond the last it lets more windows through to the join
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    n = len(grams) - w + 1
    if n <= 0:
        return grams[:0]
    out = grams[:n].copy()
    for i in range(1, w):
        np.minimum(out, grams[i : i + n], out=out)
    return out


class _Windows:
    """Fingerprints and hashes of a pack's windows."""

    def __init__(self, texts: list[bytes], k: int):
        self.pack, self.k = Pack([t.translate(LOWER) for t in texts], ALNUM), k
        self.h1, self.h2 = Hasher(1), Hasher(2)
        self.w1 = self.h1.words(self.pack.raw, self.pack.starts, self.pack.ends)
        self._w2 = None

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        k = min(self.k, n)
        at = self.pack.fitting(n)
        return at, winnow(self.h1.windows(self.w1, k), n - k + 1)[at]

    def hashes(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return at.astype(np.uint64), at.astype(np.uint64)
        if self._w2 is None:
            self._w2 = self.h2.words(self.pack.raw, self.pack.starts, self.pack.ends)
        return self.h1.windows(self.w1, n)[at], self.h2.windows(self._w2, n)[at]


def _texts(batches):
    for b in batches:
        for i, t in zip(range(b.num_rows), b.column("text")):
            yield (b, i), t.as_buffer().to_pybytes() if t.is_valid else b""


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _bench(window: int, k: int, schema: pa.Schema):
    def run(batches):
        for rows in packs(_texts(batches)):
            win = _Windows([t for _, t in rows], k)
            sizes = np.diff(win.pack.first)
            owner = np.repeat(np.arange(len(rows)), sizes)
            ids = [b.column("item")[i].as_py() for (b, i), _ in rows]
            for n in sorted({int(min(s, window)) for s in sizes if s}):
                at, fp = win.fingerprints(n)
                mine = (sizes[owner[at]] == n) | (n == window)
                at, fp = at[mine], fp[mine]
                a, b = win.hashes(n, at)
                yield pa.RecordBatch.from_arrays([pa.array([ids[o] for o in owner[at]], schema[0].type), pa.array(np.full(len(at), n, np.int32)), _signed(fp), _signed(a), _signed(b)], schema=schema)

    return run


def _candidates(lengths: list[int], k: int, bloom: bytes, schema: pa.Schema):
    def run(batches):
        from pyspark import TaskContext

        bits = np.unpackbits(np.frombuffer(bloom, np.uint8), bitorder="little").view(bool)
        rid = TaskContext.get().partitionId() << 33
        for rows in packs(_texts(batches)):
            win = _Windows([t for _, t in rows], k)
            first = win.pack.first
            owner = np.repeat(np.arange(len(rows)), np.diff(first))
            found = [[] for _ in range(6)]
            for n in lengths:
                at, fp = win.fingerprints(n)
                maybe = bits[fp & np.uint64(len(bits) - 1)]
                at, fp = at[maybe], fp[maybe]
                a, b = win.hashes(n, at)
                for f, x in zip(found, (owner[at], at - first[owner[at]], np.full(len(at), n), fp.view(np.int64), a.view(np.int64), b.view(np.int64))):
                    f.append(x.astype(np.int64))
            found = [np.concatenate(f) if f else np.empty(0, np.int64) for f in found]
            order = np.argsort(found[0], kind="stable")
            found = [f[order] for f in found]
            offsets = np.searchsorted(found[0], np.arange(len(rows) + 1)).astype(np.int32)
            item = pa.StructArray.from_arrays([pa.array(f) for f in found[1:]], names=["at", "n", "fp", "a", "b"])
            ids = pa.array([b.column("id")[i].as_py() for (b, i), _ in rows], schema[1].type)
            hashes = pa.array([b.column("hash")[i].as_py() for (b, i), _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(rows))), ids, hashes, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(offsets), item).cast(schema[4].type)], schema=schema)
            rid += len(rows)

    return run


def _bloom(fps: DataFrame) -> bytes:
    """The filter of the column fp: a bit for each value's low bits."""
    n = fps.select("fp").distinct().count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    bit = F.col("fp").bitwiseAND(size - 1).alias("bit")
    parts = fps.select(bit).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in parts.collect():  # at most MOST_BITS / 32768 rows
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[: len(out)]
    return out.tobytes()


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """Words of ``docs`` that lie in a benchmark window.

    Returns a row per input row: ``id_col``, text_hash (xxhash64 of the text),
    n_words, spans (array of (start, end) in words, every occurrence of a window,
    end exclusive, in order), n_hit (words in any span), items (ids with an
    occurring window, as sorted strings), contaminated.  A-Z are lower-cased; a
    word is a run of digits, a-z and characters from U+0080.  Null and empty
    texts have no words and are clean; an empty benchmark leaves all clean;
    benchmark rows with a null id mark words but are not listed; repeated rows
    are judged each on its own; an empty table gives an empty result.  Other
    columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item_type, id_type = bench.schema[item_col].dataType, docs.schema[id_col].dataType
    schema = pa.schema([("item", to_arrow_type(item_type)), ("n", pa.int32()), ("fp", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    w = bench.select(F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("text")).mapInArrow(_bench(window, k, schema), f"item {item_type.simpleString()}, n int, fp long, a long, b long")
    w = stored(w.distinct(), "benchwindows")
    lengths = [r.n for r in w.select("n").distinct().collect()]  # at most ``window`` rows
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(w))  # MOST_BITS / 8 bytes at most
    cand = pa.struct([(x, pa.int64()) for x in ("at", "n", "fp", "a", "b")])
    out = pa.schema([("rid", pa.int64()), ("id", to_arrow_type(id_type)), ("hash", pa.int64()), ("n_words", pa.int64()), ("cands", pa.list_(cand))])
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        yield from _candidates(lengths, k, bloom.value, out)(batches)

    d = stored(src.mapInArrow(run, f"rid long, id {id_type.simpleString()}, hash long, n_words long, cands array<struct<at:long,n:long,fp:long,a:long,b:long>>"), "candidates")
    c = d.select("rid", F.inline("cands"))
    keys = ["fp", "a", "b", "n"]
    real = stored(c.join(w.select(*keys).distinct(), keys, "left_semi"), "hits")
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))
    spans = real.groupBy("rid").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    items = real.select("rid", *keys).distinct().join(w, keys).filter("item is not null").select("rid", F.col("item").cast("string").alias("item")).distinct()
    items = items.groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    hit = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")),
        lambda s: s["n"],
    )
    names = ["text_hash", "n_words", "spans", "n_hit", "items", "contaminated"]
    return (
        d.select("rid", "id", "hash", "n_words")
        .join(spans, "rid", "left")
        .join(items, "rid", "left")
        .select(
            F.col("id").alias(distinct_names([id_col], names)[0]),
            F.col("hash").alias("text_hash"),
            "n_words",
            F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)")).alias("spans"),
            F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
            F.col("spans").isNotNull().alias("contaminated"),
        )
    )
