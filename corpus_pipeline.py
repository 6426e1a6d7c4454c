"""From raw documents to a training mix, in five stages.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's documents.

A document is known by its id and its text's hash; stages decide on these and
join the decisions to whole rows.  A row travels as one struct, so its columns
may have any names.  Decisions are stored before they are joined: Spark knows
their size then, and shuffles the texts only where the decisions are too many to
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshspan.llm import toxicity
from meshspan.llm.common_io import table
from meshspan.llm.decontaminate import decontaminate
from meshspan.llm.mixing import mix
from meshspan.llm.near_copies import near_copy_roots
from meshspan.llm.pii import redact
from meshspan.llm.scratch import distinct_names, stored
from meshspan.llm.simhash import simhash_groups


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, beside the keys that decisions are made on."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_hash"))


def _keys(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), *more)


def _on(rows: DataFrame, keys: DataFrame) -> Column:
    return rows["k_id"].eqNullSafe(keys["d_id"]) & (rows["k_hash"] == keys["d_hash"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier of all labelled rows rejects go.

    Null, empty and very long texts are scored like any other; repeated rows
    share their fate; a score of exactly one half goes; an empty table gives an
    empty result; other columns, whatever their names, pass through.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return toxicity.score(rows, model).filter("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id, then text hash; null ids come last.

    Groups are those of the fingerprints first, then those of what is left whose
    five-word shingles are alike by 0.8 or more.  Null, empty and blank texts are
    one group.  Of rows equal in id and text one stays, that with the smallest
    other columns (as JSON).  Texts are compared whole, however long.  An empty
    table gives an empty result; other columns, whatever their names, pass through.
    """
    groups = stored(simhash_groups(docs.select("doc_id", "text")).select("doc_id", "text_hash", "keep"), "groups")
    keep = stored(groups.filter("keep").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times")), "kept")
    alike = near_copy_roots(docs, keep).withColumnRenamed("id", "text_hash").join(keep, "text_hash")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    alike = stored(alike.select("root", "doc_id", "text_hash", order.alias("o")), "alike")
    first = alike.groupBy("root").agg(F.min("o").alias("top"))
    follow = alike.join(first, "root").filter(F.col("text_hash") != F.col("top.text_hash"))
    gone = groups.filter("not keep").select("doc_id", "text_hash").union(follow.select("doc_id", "text_hash")).distinct()
    gone = _keys(gone, F.lit(True).alias("gone"))
    again = _keys(keep.filter("times > 1"), F.lit(False).alias("gone"))
    marks = stored(gone.union(again).groupBy("d_id", "d_hash").agg(F.max("gone").alias("gone")), "marks")
    rows = _rows(docs)
    marked = rows.join(marks, _on(rows, marks), "left")
    plain = marked.filter("gone is null").select("row")
    once = marked.filter("not gone").groupBy("k_id", "k_hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return plain.union(once).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.

    Null and empty texts have no window and stay, very long ones are searched
    whole, repeated rows share their fate, an empty benchmark takes nothing; an
    empty table gives an empty result; other columns, whatever their names, pass
    through.
    """
    hit = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).filter("contaminated")
    hit = stored(_keys(hit).distinct(), "hit")
    rows = _rows(docs)
    return rows.join(hit, _on(rows, hit), "left_anti").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; n_chars follows.

    Every document stays.  Null and empty texts stay as they are; repeated rows
    are redacted alike; overlapping spans become one mark; an empty table gives an
    empty result; other columns, whatever their names, pass through.
    """
    out = redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often it takes them (copies) and the words that makes (taken).

    Null, empty and blank texts have no words, so they may be taken but add
    nothing; a null source is one of its own.  Of rows equal in id, text and
    source each has its own copies.  An empty table gives an empty result; other
    columns pass through; if they clash with copies or taken, those get
    underscores.
    """
    got = F.struct("copies", "taken")
    mixed = mix(docs.select("doc_id", "text", "source"))
    taken = _keys(mixed, F.col("source").alias("d_source"), got.alias("got")).groupBy("d_id", "d_hash", "d_source")
    taken = taken.agg(F.array_sort(F.collect_list("got")).alias("all")).select("d_id", "d_hash", "d_source", F.size("all").alias("times"), F.filter("all", lambda x: x["copies"] > 0).alias("got"))
    taken = stored(taken.filter("size(got) > 0"), "taken")
    rows = _rows(docs).withColumn("k_source", F.col("row.source").cast("string"))
    # Taken documents are a share of all, so they are too many to broadcast at any size that matters.
    once = taken.filter("times = 1").select("d_id", "d_hash", "d_source", F.col("got")[0].alias("got")).hint("merge")
    out = rows.join(once, _on(rows, once) & rows["k_source"].eqNullSafe(once["d_source"])).select("row", "got")
    many = taken.filter("times > 1")
    if not many.isEmpty():
        again = rows.join(many, _on(rows, many) & rows["k_source"].eqNullSafe(many["d_source"]))
        rank = F.row_number().over(Window.partitionBy("k_id", "k_hash", "k_source").orderBy(F.to_json("row")))
        again = again.withColumn("rank", rank).filter(F.col("rank") <= F.size("got"))
        out = out.union(again.select("row", F.element_at("got", F.col("rank")).alias("got")))
    copies, words = distinct_names(["copies", "taken"], docs.columns)
    return out.select("row.*", F.col("got.copies").alias(copies), F.col("got.taken").alias(words))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: no SQL expresses the classifier or the fingerprints; tests/llm/test_pipeline.py compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
