"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes every document floor(r) times,
and once more with probability r - floor(r).  The cube method moves these
probabilities to 0 or 1 along directions that leave two totals unchanged: the
source's words and its documents.  Three open documents always have such a
direction, so a block of documents ends with at most two open ones.  Blocks of a
source fly on their own; what they leave open is gathered, block by block of
blocks, until one block is left, whose last two documents are rounded at random
(the landing).  Blocks and random numbers come from hashes of the rows, so
reruns agree whatever the partitioning.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import distinct_names, stored

BLOCK = 1024
MOST = 3


def flight(sizes: list[int], p: list[float], rnd: random.Random, land: bool) -> list[float]:
    """Probabilities after the flight: all but two at most are 0 or 1, and with ``land`` all are."""
    p = list(p)
    active = []

    def settle(i: int) -> bool:
        if p[i] < 1e-9 or p[i] > 1 - 1e-9:
            p[i] = float(round(p[i]))
            return True
        return False

    def move(idx, u):
        up = min(((1 - p[i]) / d if d > 0 else -p[i] / d) for i, d in zip(idx, u) if d)
        down = min((p[i] / d if d > 0 else (p[i] - 1) / d) for i, d in zip(idx, u) if d)
        t = up if rnd.random() * (up + down) < down else -down
        for i, d in zip(idx, u):
            p[i] = min(1.0, max(0.0, p[i] + t * d))

    for i in range(len(p)):
        if settle(i):
            continue
        active.append(i)
        if len(active) == 3:
            a, b, c = (sizes[k] for k in active)
            u = (b - c, c - a, a - b)
            scale = max(map(abs, u))
            move(active, tuple(x / scale for x in u) if scale else (1.0, -1.0, 0.0))
            active = [k for k in active if not settle(k)]
    if land and len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
        move(active, (1.0, -1.0))
        active = [k for k in active if not settle(k)]
    if land:
        for k in active:
            p[k] = 1.0 if rnd.random() < p[k] else 0.0
    return p


COLS = "id {id}, hash long, source string, size long, source_size long, target double, base int, key long, blocks long, block long, p double"


def _fly(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("hash", "ascending"), ("size", "ascending")])
        rnd = random.Random(table.column("key")[0].as_py())
        sizes, p = table.column("size").to_pylist(), table.column("p").to_pylist()
        out = flight(sizes, p, rnd, table.column("blocks")[0].as_py() <= 1)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out)).cast(schema)

    return run


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from rows with source and size.

    Sources in code-point order, null last, weigh ``weights`` in turn.  A level
    L gives each source min(most * size, L * weight); L is where these add up to
    all words, which is what resharing the excess by weight ends in.
    """
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = t.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(onward)
    t = t.withColumn("level", level)
    # The level rises over the sources that stop at their cap and falls after them.
    t = t.withColumn("L", F.max("level").over(everything))
    return t.select("source", "source_size", "n", F.least(F.col("cap"), F.col("L") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), most: int = MOST, block: int = BLOCK) -> DataFrame:
    """How often the mix takes each document.

    Returns a row per input row: ``id_col``, text_hash, source, size (words; null
    and blank texts 0), source_size, target (words its source should give),
    copies (0 to ``most``), taken (size * copies).  Every source's taken words and
    documents differ from its target by two documents at most.  A null source is
    a source of its own; repeated rows are separate documents; sources without
    words get target 0 and no copies; an empty table gives an empty result.
    Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    s = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("hash"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long").alias("size"),
    )
    s = stored(s, "sizes")
    t = stored(source_targets(s, weights, most).withColumn("source_null", F.col("source").isNull()).fillna("", ["source"]), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = s.withColumn("source_null", F.col("source").isNull()).fillna("", ["source"]).join(t, ["source", "source_null"])
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-12).cast("int"))
    rows = rows.withColumn("key", F.xxhash64("id", "hash", "source")).withColumn("blocks", F.ceil(F.col("n") / block))
    rows = rows.withColumn("source", F.when(~F.col("source_null"), F.col("source"))).select(
        "id", "hash", "source", "size", "source_size", "target", "base", "key", "blocks",
        F.pmod(F.xxhash64("key"), "blocks").alias("block"),
        F.greatest(F.lit(0.0), F.col("rate") - F.col("base")).alias("p"),
    )
    fields = COLS.format(id=ddl)
    fly = _fly(to_arrow_schema(docs.sparkSession.createDataFrame([], fields).schema))
    done, most_blocks = None, t.agg(F.max("n")).first()[0] or 0
    most_blocks = -(-most_blocks // block)
    while True:
        flown = stored(rows.groupBy("source", "block").applyInArrow(fly, fields), "flight")
        closed = flown.filter("p = 0 or p = 1")
        done = closed if done is None else done.union(closed)
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // (block // 2))
        wide = F.lit(block // 2)
        rows = flown.filter("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") / wide)).withColumn("block", F.floor(F.col("block") / wide))
    copies = F.least(F.lit(most), F.col("base") + F.col("p").cast("int"))
    names = ["text_hash", "source", "size", "source_size", "target", "copies", "taken"]
    return done.select(
        F.col("id").alias(distinct_names([id_col], names)[0]), F.col("hash").alias("text_hash"), "source", "size", "source_size", "target",
        copies.alias("copies"), (F.col("size") * copies).alias("taken"),
    )
