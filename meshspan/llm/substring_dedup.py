"""Exact substring de-duplication by level-wise doubling.

Windows of a short length are hashed for every position of the corpus.  Only
windows whose hash occurs twice are extended to twice that length, and so on
up to the wanted length, or until no candidate is left.  Lengths double exactly
or overlap by the odd word, e.g. 9, 18, 35.

How a level runs:

* Documents lie in *blocks* (about ``block_bytes`` of text) of a bucketed table,
  written once.  A block hashes its candidate windows, drops its own repeats,
  splits them by hash range and sends each range to one reducer as packed
  integers.  A window that fills a third of the corpus is one integer a block.
* A reducer sees all hashes of a range and answers each block with one *bit* a
  hash: does it start at two or more places?
* Bits come back to the blocks by a join that moves the bits, not the text.

Early levels use the range and 32 more bits, which can only let false candidates
through; the last level uses the range and 80 more bits of a second hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import distinct_names, shuffle_parts, stored, stored_in_buckets
from .wordhash import NOT_SPACE, Hasher, mix64, word_spans

WINDOWS_PER_RANGE = 4_000_000
FINAL = np.dtype([("a", "<u8"), ("b", "<u2")])


def lengths(window: int, shortest: int = 8) -> list[int]:
    """Window lengths from the first level to the last; each at most twice the one before."""
    out = [window]
    while out[0] >= 2 * shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _blocks(id_type: pa.DataType, block_bytes: int):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("lens", pa.list_(pa.int64())), ("body", pa.binary()), ("n_words", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flush():
            nonlocal block, ids, texts, size
            raw = b"".join(t or b"" for t in texts)
            n = sum(len((t or b"").split()) for t in texts)
            row = [[block], [ids], [[-1 if t is None else len(t) for t in texts]], [raw], [n]]
            block, ids, texts, size = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = None if not t.is_valid else t.as_buffer().to_pybytes()
                if texts and size + len(t or b"") > block_bytes:
                    yield flush()
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
        if texts:
            yield flush()

    return run


class _Block:
    """The words of a block and, level by level, the positions where candidate windows start."""

    def __init__(self, lens, body: bytes):
        self.raw = np.frombuffer(body, np.uint8)
        self.edges = np.concatenate([[0], np.cumsum(np.maximum(np.asarray(lens, np.int64), 0))])
        # Documents touch each other in a block, so spans are cut at each edge.
        s, e = word_spans(self.raw, NOT_SPACE)
        cuts = np.unique(self.edges[(self.edges > 0) & (self.edges < len(body))])
        k = np.searchsorted(s, cuts, "right") - 1
        inside = (k >= 0) & (s[np.maximum(k, 0)] < cuts) & (e[np.maximum(k, 0)] > cuts) if len(s) else np.zeros(len(cuts), bool)
        if inside.any():
            s = np.sort(np.concatenate([s, cuts[inside]]))
            e = np.sort(np.concatenate([e, cuts[inside]]))
        self.starts, self.ends = s, e
        #: word index where each document begins, and one past the last
        self.first = np.searchsorted(self.starts, self.edges, "left")
        #: for each word, the index one past its document's last word
        self.limit = np.repeat(self.first[1:], np.diff(self.first))

    def words(self, seed: int) -> np.ndarray:
        return Hasher(seed).words(self.raw, self.starts, self.ends)

    def fitting(self, n: int) -> np.ndarray:
        """Positions where a window of n words fits in its document."""
        return np.flatnonzero(np.arange(len(self.starts)) + n <= self.limit)


def _at(words: np.ndarray, seed: int, n: int, pos: np.ndarray) -> np.ndarray:
    return Hasher(seed).windows(words, n)[pos] if len(pos) else np.empty(0, np.uint64)


def _keys(w1, w2, n, pos, final):
    """Keys that sort first by hash range; in the last level 128 bits, else 64."""
    h = _at(w1, 1, n, pos)
    if not final:
        return h
    out = np.empty(len(h), np.dtype([("h", "<u8"), ("g", "<u8")]))
    out["h"], out["g"] = h, _at(w2, 2, n, pos)
    return out


def _packed(keys: np.ndarray, ranges: int, final: bool):
    """Distinct keys, their range, packed remainder, and for each key its number; how often each occurs, up to 2."""
    h = keys["h"] if final else keys
    # The range comes from the high 32 bits, the remainder from the low ones.
    r = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    if final:
        rest = np.empty(len(h), FINAL)
        rest["a"] = mix64(h) ^ keys["g"]
        rest["b"] = (keys["g"] >> np.uint64(48)).astype(np.uint16)
        order = np.lexsort((rest["b"], rest["a"], r))
    else:
        rest = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort((r << np.uint64(32)) | rest, kind="stable")
    sr, st = r[order], rest[order]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = (sr[1:] != sr[:-1]) | (st[1:] != st[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    count = np.diff(np.append(np.flatnonzero(new), len(order)))
    return sr[new].astype(np.int64), st[new], which, count > 1


def _alive(block: _Block, w1, w2, levels: list[int], window: int, ranges: int, answers: list[dict[int, bytes]]):
    """Positions whose windows are repeated at the last answered level."""
    pos = block.fitting(levels[0])
    for k, bits in enumerate(answers):
        n = levels[k]
        if k:
            pos = _extended(pos, levels[k - 1], n, block)
        final = n == window
        r, rest, which, _ = _packed(_keys(w1, w2, n, pos, final), ranges, final)
        repeated = np.zeros(len(r), bool)
        edges = np.flatnonzero(np.diff(r, prepend=-1))
        for i, a in enumerate(edges):
            z = edges[i + 1] if i + 1 < len(edges) else len(r)
            got = bits.get(int(r[a]))
            if got is not None:
                repeated[a:z] = np.unpackbits(np.frombuffer(got, np.uint8), count=z - a).view(bool)
        pos = pos[repeated[which]] if len(pos) else pos
    return pos


def _extended(pos, short: int, n: int, block: _Block):
    """Positions whose two sub-windows of the shorter length, first and last, are both candidates."""
    on = np.zeros(len(block.starts) + 1, bool)
    on[pos] = True
    pos = pos[(pos + n <= block.limit[pos])] if len(pos) else pos
    return pos[on[pos + n - short]] if len(pos) else pos


def _answers(batch: pa.RecordBatch, i: int, k: int) -> list[dict[int, bytes]]:
    out = []
    for level in range(k):
        got = batch.column(f"bits{level}")[i].as_py() or []
        out.append({x["part"]: x["bits"] for x in got})
    return out


def _send(levels, k, window, ranges):
    n, final = levels[k], levels[k] == window
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                block = _Block(b.column("lens")[i].values.to_numpy(), b.column("body")[i].as_buffer())
                w1 = block.words(1)
                w2 = block.words(2) if final else None
                pos = _alive(block, w1, w2, levels, window, ranges, _answers(b, i, k))
                pos = _extended(pos, levels[k - 1], n, block) if k else pos
                if not len(pos):
                    continue
                r, rest, _, twice = _packed(_keys(w1, w2, n, pos, final), ranges, final)
                edges = np.flatnonzero(np.diff(r, prepend=-1)).tolist() + [len(r)]
                ident = b.column("block")[i].as_py()
                rows = [(int(r[a]), ident, rest[a:z].tobytes(), np.packbits(twice[a:z]).tobytes()) for a, z in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _judge(final: bool):
    dtype = FINAL if final else np.dtype("<u4")
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("bits", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part = table.column("part")[0].as_py()
        blobs = [x.as_buffer() for x in table.column("keys")]
        keys = [np.frombuffer(x, dtype) for x in blobs]
        every = np.concatenate(keys)
        sizes = [len(x) for x in keys]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=s).view(bool) for x, s in zip(table.column("twice"), sizes)])
        order = np.lexsort((every["b"], every["a"])) if final else np.argsort(every, kind="stable")
        s = every[order]
        same = s[1:] == s[:-1]
        hit = twice[order]
        hit[1:] |= same
        hit[:-1] |= same
        # one block may say "twice" of a hash that the others hold once
        group = np.concatenate([[0], np.cumsum(~same)]) if len(s) else np.empty(0, np.int64)
        any_hit = np.zeros(group[-1] + 1 if len(group) else 0, bool)
        any_hit[group[hit]] = True
        out = np.empty(len(every), bool)
        out[order] = any_hit[group]
        cuts = np.cumsum(sizes)
        rows = [(b, part, np.packbits(x).tobytes()) for b, x in zip(table.column("block").to_pylist(), np.split(out, cuts[:-1])) if x.any()]
        if not rows:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _finish(levels, window, ranges, k, id_type):
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                lens = b.column("lens")[i].values.to_numpy()
                block = _Block(lens, b.column("body")[i].as_buffer())
                gone = np.zeros(len(block.starts) + 1, np.int32)
                if k == len(levels):
                    w1, w2 = block.words(1), block.words(2)
                    pos = _alive(block, w1, w2, levels, window, ranges, _answers(b, i, k))
                    gone[pos] += 1
                    gone[pos + window] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                body = b.column("body")[i].as_buffer().to_pybytes()
                ids = b.column("ids")[i].values
                n_words, n_gone, kept = [], [], []
                for d in range(len(lens)):
                    a, z = block.first[d], block.first[d + 1]
                    words = body[block.edges[d] : block.edges[d + 1]].split()
                    on = keep[a:z]
                    if not on.all():
                        words = [words[j] for j in np.flatnonzero(on)]
                    n_words.append(z - a)
                    n_gone.append(z - a - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, block_bytes: int = 2_000_000) -> DataFrame:
    """Remove words covered by a ``window``-word sequence that starts anywhere else too.

    Returns one row per input row: ``id_col``, n_words, n_removed, kept (the words
    that stay, joined by one space).  Words are runs of bytes other than ASCII
    white space.  Null and empty texts have no words and keep "".  Repeated rows
    (even with one id) are separate documents, so they remove each other's long
    passages.  A text shorter than the window loses nothing.  An empty table
    gives an empty result; other columns are ignored.  Every copy is removed,
    none is favoured.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    id_ddl = docs.schema[id_col].dataType.simpleString()
    levels = lengths(window)
    parts = shuffle_parts(spark)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    blocks = src.mapInArrow(_blocks(id_type, block_bytes), f"block bigint, ids array<{id_ddl}>, lens array<bigint>, body binary, n_words bigint")
    blocks = stored_in_buckets(blocks, "blocks", "block", parts)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(1, math.ceil(total / WINDOWS_PER_RANGE))
    joined, done = blocks, 0
    for k, n in enumerate(levels):
        sent = joined.mapInArrow(_send(levels, k, window, ranges), "part bigint, block bigint, keys binary, twice binary")
        bits = sent.groupBy("part").applyInArrow(_judge(n == window), "block bigint, part bigint, bits binary")
        bits = stored(bits, f"bits{k}")
        if bits.isEmpty():
            break
        answers = bits.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias(f"bits{k}"))
        joined = joined.join(answers, "block", "left")
        done = k + 1
    if done < len(levels):
        joined = blocks
    out = joined.mapInArrow(_finish(levels, window, ranges, done, id_type), f"id {id_ddl}, n_words bigint, n_removed bigint, kept string")
    name = distinct_names([id_col], ["n_words", "n_removed", "kept"])[0]
    return out.withColumnRenamed("id", name)
