"""Counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings; near copies among the labelled
rows share one vote.  Beside the usual loss and a ridge, training pays for the
change of a labelled sentence's score when identity terms are swapped:

* a term that the sentence holds, for each other term of its group;
* a pair of terms of one group, put into the sentence in turn;
* a term put into the sentence, against the sentence without it.

So a term that happens to occur in toxic sentences cannot carry the verdict, and
neutral mentions of groups score like sentences without them, also those of
groups that no labelled sentence mentions.

Fitting reads a bounded sample of labelled rows (``max_rows``).  Features are
counted and chosen by DataFrame operations; only the chosen features of the
sample's rows, as numbers, go to the driver.  Scoring reads all texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import distinct_names, stored

WORD = re.compile(r"[^\W\d_]+")

#: identity terms in English, French, German and Spanish; terms of a line are swapped for each other
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("african", "european", "american", "mexican", "chinese", "arab"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("gai", "lesbienne", "hétéro", "bisexuel", "transgenre"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "latinos"),
    ("immigrés", "autochtones", "réfugiés", "étrangers"),
    ("africain", "européen", "américain", "mexicain", "chinois", "arabe"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell", "transgeschlechtlich"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "latinos"),
    ("einwanderer", "einheimische", "flüchtlinge", "ausländer"),
    ("afrikanisch", "europäisch", "amerikanisch", "mexikanisch", "chinesisch", "arabisch"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("gay", "lesbiana", "heterosexual", "bisexual", "transgénero"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos"),
    ("inmigrantes", "nativos", "refugiados", "extranjeros"),
    ("africano", "europeo", "americano", "mexicano", "chino", "árabe"),
)

TERMS = {t for group in IDENTITY for t in group}


def features(text: str | None) -> set[str]:
    """Words of letters, lower-cased, and their first four to seven letters (marked ~), which hold across endings.

    A beginning that two different words or more share has a second mark.
    Identity terms have no beginnings: swapping a term changes itself only.
    """
    ws = set(WORD.findall(text.lower())) if text else set()
    starts = Counter(w[:k] + "~" for w in ws - TERMS for k in (4, 5, 6, 7) if len(w) >= k)
    return ws | starts.keys() | {s + "~" for s, n in starts.items() if n > 1}


class Model:
    """A bias and a weight for each feature that has one."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def logit(self, found: set[str]) -> float:
        w = self.weights
        return self.bias + sum(sorted(w[x] for x in found if x in w))

    def score(self, text: str | None) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.logit(features(text)), -40, 40))))


def swaps(names: list[str], rows: list[np.ndarray], share: np.ndarray, groups=IDENTITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of term numbers with their shares of labelled sentences, and the share of each single mention.

    ``rows`` hold the numbers of each sentence's features.  A swap of terms
    changes the logit by the difference of their weights, a mention by the
    term's weight.  Put-in pairs and mentions are shared evenly by all terms.
    """
    at = {w: i for i, w in enumerate(names)}
    pairs: dict[tuple[int, int], float] = {}
    mention = np.zeros(len(names))
    terms = {at[t] for g in groups for t in g}
    peers: dict[int, set[int]] = {}
    for g in groups:
        for t in g:
            peers.setdefault(at[t], set()).update(at[u] for u in g if u != t)
    for row, part in zip(rows, share):
        held = terms.intersection(row.tolist())
        for t in held:
            for u in peers[t] - held:
                pairs[t, u] = pairs.get((t, u), 0.0) + part
    whole = float(share.sum())
    for t, others in peers.items():
        mention[t] = whole / len(terms)
        for u in others:
            pairs[t, u] = pairs.get((t, u), 0.0) + whole / (len(terms) * len(others))
    return np.array(list(pairs), int).reshape(-1, 2), np.array(list(pairs.values())), mention


def solve(names: list[str], rows: list[np.ndarray], y: np.ndarray, share: np.ndarray, prior: float, groups=IDENTITY, swap_weight: float = 10.0, ridge: float = 0.05, steps: int = 600) -> Model:
    """The model of rows of feature numbers, whose shares add up to one; ``names`` hold every identity term."""
    pairs, often, mention = swaps(names, rows, share, groups)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.empty(0, int)
    w, c, n = np.zeros(len(names)), prior, max(1, len(rows))
    # Adam: the ridge and the swaps scale the same way as the mean loss
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[col], len(rows)) + c, -30, 30)))
        d = (p - y) * share
        gap = 2 * swap_weight * often * (w[pairs[:, 0]] - w[pairs[:, 1]])
        g = np.bincount(col, d[owner], len(w)) + ridge * w / n + 2 * swap_weight * mention * w
        g = g + np.bincount(pairs[:, 0], gap, len(w)) - np.bincount(pairs[:, 1], gap, len(w))
        full = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, c = w - step[:-1], c - float(step[-1])
    return Model(float(c), {k: float(z) for k, z in zip(names, w)})


def _features(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            part = b.slice(lo, 200)
            found = [sorted(features(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["rid", "toxic", "found"])


def _numbered(names: list[str]):
    """Features as their places in ``names``; the others are left out."""

    def run(batches):
        at = {w: i for i, w in enumerate(names)}
        for b in batches:
            found = [[at[f] for f in fs if f in at] for fs in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(found, pa.list_(pa.int32()))], names=["rid", "found"])

    return run


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """Labelled texts (rid, toxic, text), at most ``max_rows``, and how many labelled rows each sampled row of a label stands for.

    Labels without a document take no place.  Half the places go to each label
    as long as it has rows (smallest hashes of the ids), so that rare toxic rows
    stay.  Of several texts of an id the one of the smallest hash counts.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    lab = lab.groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids = stored(lab.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").withColumn("h", F.xxhash64("id")), "labelled")
    n = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    n = {y: n.get(y, 0) for y in (0, 1)}
    take = {1: min(n[1], max(max_rows // 2, max_rows - n[0]))}
    take[0] = min(n[0], max_rows - take[1])
    chosen = None
    for y in (0, 1):
        # hashes below this leave few rows to sort, and more than enough
        limit = min(1.0, (take[y] + 6 * take[y] ** 0.5 + 10) / max(1, n[y]))
        few = ids.filter((F.col("toxic") == y) & (F.col("h") <= min(2**63 - 1, int((2 * limit - 1) * 2**63)))).orderBy("h", "id").limit(take[y])
        chosen = few if chosen is None else chosen.union(few)
    chosen = chosen.select("id", "toxic")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = text.join(F.broadcast(chosen), "id")  # max_rows bounds the broadcast
    known = known.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return known.select(F.xxhash64("id").alias("rid"), "toxic", "text"), {y: n[y] / take[y] if take[y] else 0.0 for y in (0, 1)}


def copy_weights(flat: DataFrame, n: int, tries: int = 4) -> DataFrame:
    """(rid, w): one over the size of the largest group that shares a row's smallest hash, taken over its rare features."""
    often = flat.groupBy("f").count().filter(F.col("count") > max(3, n // 100)).select("f")  # few: a row's features times 100 at most
    rare = flat.join(often, "f", "left_anti").groupBy("rid").agg(*[F.min(F.xxhash64("f", F.lit(k))).alias(f"m{k}") for k in range(tries)])
    rare = rare.select("rid", F.posexplode(F.array(*[f"m{k}" for k in range(tries)])).alias("k", "m"))
    sizes = rare.groupBy("k", "m").count()
    return rare.join(sizes, ["k", "m"]).groupBy("rid").agg((1.0 / F.max("count")).alias("w"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8_000, least_z: float = 5.0, groups=IDENTITY, **options) -> Model:
    """Fit on a sample of at most ``max_rows`` labelled rows; rows with a null id or label are left out, and ids with both labels count as 1.

    Features are kept whose share of toxic rows departs from their share of
    clean rows by ``least_z`` deviations, and all identity terms.  Without both
    labels the model is a constant: the smoothed share of label 1.
    """
    known, stands = sample(docs, labels, id_col, text_col, label_col, max_rows)
    rows = stored(known.mapInArrow(_features, "rid long, toxic int, found array<string>"), "features")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    real = {y: n.get(y, 0) * stands[y] for y in (0, 1)}
    prior = float(np.log((real[1] + 0.5) / (real[0] + 0.5))) if sum(n.values()) else -4.0
    if len(n) < 2:
        return Model(prior, {})
    flat = rows.select("rid", "toxic", F.explode("found").alias("f"))
    weights = stored(rows.select("rid", "toxic").join(copy_weights(flat, sum(n.values())), "rid", "left").select("rid", "toxic", F.coalesce("w", F.lit(1.0)).alias("w")), "weights")
    mass = {r.toxic: r.w for r in weights.groupBy("toxic").agg(F.sum("w").alias("w")).collect()}
    c = flat.select("rid", "f").join(F.broadcast(weights), "rid")  # max_rows rows
    c = c.groupBy("f").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("w")).otherwise(0.0)).alias(f"c{y}") for y in (0, 1)])
    pooled = (F.col("c0") + F.col("c1") + 0.5) / (mass[0] + mass[1] + 1)
    z = (F.col("c1") / mass[1] - F.col("c0") / mass[0]) / F.sqrt(pooled * (1 - pooled) * (1 / mass[1] + 1 / mass[0]))
    strong = c.filter((F.abs(z) >= least_z) & (F.col("c0") + F.col("c1") >= 3)).select("f")
    terms = sorted({t for g in groups for t in g})
    names = sorted({r.f for r in strong.collect()} | set(terms))  # what passes the test: no more than a few thousand words
    found = rows.select("rid", "found").mapInArrow(_numbered(names), "rid long, found array<int>")
    got = weights.join(found, "rid").orderBy("rid").toArrow()  # max_rows rows of numbers
    y = got.column("toxic").to_numpy().astype(float)
    share = got.column("w").to_numpy() * np.where(y > 0, stands[1], stands[0])
    bags = [np.sort(np.array(x or [], int)) for x in got.column("found").to_pylist()]
    return solve(names, bags, y, share / share.sum(), prior, groups, **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability that a text is toxic; null and empty texts get that of no words."""
    fields = [f.name for f in docs.schema.fields]
    name = distinct_names([out], fields)[0]

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.withColumn(name, rate(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, **options) -> DataFrame:
    """Score every text; rows whose crc32(id as text) mod ``folds`` is ``fold`` are held out of training.

    Returns a row per input row: ``id_col``, held_out, score (0 to 1), predicted
    (1 from 0.5).  Rows with a null id are scored and not held out.  Repeated rows
    get equal scores; an empty table gives an empty result; without labels the
    score is a small constant.  Other columns are ignored.
    """
    def held(c):
        return F.coalesce(F.crc32(F.col(c).cast("string")) % folds == fold, F.lit(False))

    model = train(docs, labels.filter(~held(id_col)), id_col, text_col, label_col, **options)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = score(src, model).select("id", held("id").alias("held_out"), "score")
    out = out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.withColumnRenamed("id", distinct_names([id_col], ["held_out", "score", "predicted"])[0])
