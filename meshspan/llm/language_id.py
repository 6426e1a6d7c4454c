"""Language identification with interpolated Kneser-Ney character models.

Each language's model holds, for every order, an array of sorted n-gram hashes
with their interpolated log-probabilities, and one of sorted context hashes with
their back-off weights; a lookup is a binary search.  Characters hash to 12 bits
(alphabets keep their letters apart, ideographs may share a value), so an n-gram
of five is a 60-bit word from which context and shorter n-grams follow by shifts
and masks.

A text is scored by its words (runs of letters, lower-cased, with a boundary
before and after): the language with the lowest cross-entropy per symbol wins.
Confidence is a logistic function of the lead over the runner-up and the length,
fitted on a fold of the training rows by models that have not seen it; a text is
rejected when its confidence is under one half or its cross-entropy is beyond
what held-out texts of the winner reach.

Every n-gram of every training text is counted and kept.  A language's n-grams
are sharded by their last symbol but one: all shorter n-grams and contexts that a
position may fall back to lie in its shard, so shards are estimated in tasks of
their own.  Shards are scored in groups of bounded size; each group is sent to
the executors and read against all texts, and the groups' sums add up.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import distinct_names, stored


def _letters() -> str:
    """A class of letters: word characters but for the underscore and everything numeric."""
    numeric = [c for c in range(128, sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()]
    runs = [(c, c) for c in numeric]
    joined = runs[:1]
    for a, z in runs[1:]:
        joined[-1:] = [(joined[-1][0], z)] if a == joined[-1][1] + 1 else [joined[-1], (a, z)]
    return r"[^\W\d_" + "".join(f"{chr(a)}-{chr(z)}" for a, z in joined) + "]+"


WORD = re.compile(_letters())
BITS, EDGE = 12, 1
SYMBOLS = 1 << BITS


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character hashes of the words, an edge after each; and the position after each edge."""
    cp = np.frombuffer("\n".join(words).encode("utf-32-le") + "\n".encode("utf-32-le"), np.uint32)
    ids = (cp % 4093 + 2).astype(np.uint64)
    ids[cp == 10] = EDGE
    return ids, np.flatnonzero(cp == 10) + 1


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol after a word's first edge, the n-gram that it ends, and the number of symbols of each word."""
    ids, ends = symbols(words)
    sizes = np.diff(ends, prepend=0)
    start = np.repeat(ends - sizes, sizes)
    at = np.arange(len(ids))
    out = ids.copy()
    for back in range(1, order):
        prev = np.zeros(len(ids), np.uint64)
        inside = at - back >= start
        prev[inside] = ids[at[inside] - back]
        prev[at - back == start - 1] = EDGE
        out |= prev << np.uint64(BITS * back)
    return out, sizes


class Lookup:
    """Values by sorted keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[i] == keys, self.values[i]


def mask(n: int) -> np.uint64:
    return np.uint64((1 << BITS * n) - 1)


def shard_of(keys: np.ndarray) -> np.ndarray:
    """The symbol before the last: what an n-gram falls back to has it too."""
    return ((keys >> np.uint64(BITS)) & np.uint64(SYMBOLS - 1)).astype(np.int64)


def tables(keys: np.ndarray, counts: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of the longest n-grams, and continuation counts (how many symbols precede) of those down to two."""
    out = {order: (keys.astype(np.uint64), counts.astype(np.float64))}
    for n in range(order - 1, 1, -1):
        k, c = np.unique(out[n + 1][0] & mask(n), return_counts=True)
        out[n] = (k, c.astype(np.float64))
    return out


def discount(once: float, twice: float) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.5


def unigrams(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all symbols from their continuation counts."""
    d = discount(float((counts == 1).sum()), float((counts == 2).sum()))
    total, kinds = counts.sum(), (counts > 0).sum()
    rest = d * kinds / total if total else 1.0
    return np.maximum(counts - d, 0) / max(total, 1) + rest / SYMBOLS


class Shard:
    """Interpolated Kneser-Ney probabilities of a shard's n-grams, given discounts by order and unigram probabilities."""

    def __init__(self, order: int, grams: dict[int, tuple], contexts: dict[int, tuple], first: np.ndarray):
        self.order = order
        self.grams = {n: Lookup(*grams[n]) for n in range(2, order + 1)}
        self.contexts = {n: Lookup(*contexts[n]) for n in range(2, order + 1)}
        self.first = np.log(first)

    @classmethod
    def estimate(cls, keys, counts, order: int, discounts: dict[int, float], first: np.ndarray) -> Shard:
        none = np.empty(0, np.uint64), np.empty(0)
        out = cls(order, dict.fromkeys(range(2, order + 1), none), dict.fromkeys(range(2, order + 1), none), first)
        by_order = tables(keys, counts, order)
        for n in range(2, order + 1):
            k, c = by_order[n]
            ctx, inverse = np.unique(k >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(inverse, c, len(ctx))
            bow = discounts[n] * np.bincount(inverse, minlength=len(ctx)) / total
            lower = np.exp(out.score(k & mask(n - 1), n - 1))
            out.grams[n] = Lookup(k, np.log(np.maximum(c - discounts[n], 0) / total[inverse] + bow[inverse] * lower))
            out.contexts[n] = Lookup(ctx, np.log(bow))
        return out

    def score(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """Log-probabilities of the last symbol of each key given the ones before."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for n in range(order or self.order, 1, -1):
            k = keys[todo] & mask(n)
            hit, lp = self.grams[n].get(k)
            out[todo[hit]] += lp[hit]
            todo, k = todo[~hit], k[~hit]
            if not len(todo):
                return out
            known, bow = self.contexts[n].get(k >> np.uint64(BITS))
            out[todo[known]] += bow[known]
        out[todo] += self.first[(keys[todo] & mask(1)).astype(np.int64)]
        return out


class Scorer:
    """Scores texts by one group of shards of all languages; remembers words, as most recur."""

    def __init__(self, models: list[Shard], member: np.ndarray, remember: int = 300_000):
        self.models, self.member, self.remember = models, member, remember
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(models) + 1))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of log-probabilities by language, and its number of symbols."""
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.known) > self.remember:
            self.known, self.table = {}, self.table[:0]
        new = list(dict.fromkeys(w for ws in found for w in ws if w not in self.known))
        if new:
            keys, sizes = grams(new, self.models[0].order)
            uniq, inverse = np.unique(keys, return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            rows = [sizes.astype(float)]
            for k in range(len(self.models) - 1, -1, -1):
                on = self.member[k, shard_of(uniq)]  # other groups add the other positions
                part = np.zeros(len(uniq))
                part[on] = self.models[k].score(uniq[on])
                rows.insert(0, np.add.reduceat(part[inverse], starts))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.table = np.concatenate([self.table, np.stack(rows, axis=1)])
        out = np.zeros((len(texts), len(self.models) + 1))
        for i, ws in enumerate(found):
            if ws:
                out[i] = self.table[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
        return out[:, :-1], out[:, -1]


def _slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20):
    """Rows (from, to) of a batch, a few megabytes of text at a time."""
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)]
    lo = total = 0
    for i, s in enumerate(sizes):
        total += s
        if total >= size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def _count(order: int):
    schema = pa.schema([("lang", pa.string()), ("seen", pa.bool_()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        counts: dict[tuple[str, bool], Counter] = {}

        def flush():
            for (lang, seen), words in counts.items():
                keys, sizes = grams(list(words), order)
                weight = np.repeat(np.fromiter(words.values(), np.float64, len(words)), sizes)
                uniq, inverse = np.unique(keys, return_inverse=True)
                m = len(uniq)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([seen] * m), pa.array(uniq.view(np.int64)), pa.array(np.bincount(inverse, weight).astype(np.int64))], schema=schema)
            counts.clear()

        for b in batches:
            for text, lang, seen in zip(b.column("text"), b.column("lang").to_pylist(), b.column("seen").to_pylist()):
                if text.is_valid and (ws := WORD.findall(text.as_py().lower())):
                    counts.setdefault((lang, seen), Counter()).update(ws)
            if sum(map(len, counts.values())) > 500_000:
                yield from flush()
        yield from flush()

    return run


UNIT = "part int, lang string, shard int"
STATS = UNIT + ", n int, symbol int, once double, twice double"
BLOBS = UNIT + ", size long, data binary"


def _stats(order: int):
    """A shard's n-grams seen once and twice by order, and its share of the unigrams' continuation counts."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int32()), ("symbol", pa.int32()), ("once", pa.float64()), ("twice", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        by_order = tables(table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy(), order)
        rows = [(n, -1, float((c == 1).sum()), float((c == 2).sum())) for n, (_, c) in by_order.items()]
        symbols_, counts = np.unique(by_order[2][0] & mask(1), return_counts=True)
        rows += [(1, s, float(c), 0.0) for s, c in zip(symbols_.tolist(), counts.tolist())]
        head = [table.column(c)[0].as_py() for c in ("part", "lang", "shard")]
        return pa.Table.from_arrays([pa.array([h] * len(rows), f.type) for h, f in zip(head, schema)] + [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[3:])], schema=schema)

    return run


def _estimate(order: int, facts):
    """A shard's sorted arrays as one binary value."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("shard", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        import pickle

        head = [table.column(c)[0].as_py() for c in ("part", "lang", "shard")]
        discounts, first = facts.value[head[0], head[1]]
        m = Shard.estimate(table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy(), order, discounts, first)
        data = pickle.dumps([{n: (x.keys, x.values) for n, x in side.items()} for side in (m.grams, m.contexts)])
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([*head, table.num_rows, data], schema)], schema=schema)

    return run


def features(sums: np.ndarray, n: np.ndarray):
    """Cross-entropies, the winner, and what confidence is computed from."""
    ce = -sums / np.maximum(n, 1)[:, None]
    best = ce.argmin(axis=1)
    part = np.sort(ce, axis=1)
    lead = part[:, 1] - part[:, 0] if ce.shape[1] > 1 else np.ones(len(ce))
    return ce, best, np.stack([np.minimum(lead, 3.0), np.minimum(np.log1p(n), 8.0) * np.minimum(lead, 3.0)], axis=1)


class LanguageModel:
    """The table of all shards, what they have in common, and how to read the scores.

    ``shards`` has part (0: estimated from all texts, 1: from all but the
    calibration fold), lang, shard, size (its longest n-grams) and its arrays.
    """

    def __init__(self, langs: list[str], order: int, shards: DataFrame, facts: dict, group_grams: int):
        self.langs, self.order, self.shards, self.facts = langs, order, shards, facts
        sizes = shards.select("part", "lang", "shard", "size").collect()  # at most 4,096 rows a language and part
        self.groups: dict[int, list[list[tuple[str, int]]]] = {0: [[]], 1: [[]]}
        for part in (0, 1):
            full = 0
            for r in sorted((r for r in sizes if r.part == part), key=lambda r: (r.shard, r.lang)):
                if full and full + r["size"] > group_grams:
                    self.groups[part].append([])
                    full = 0
                self.groups[part][-1].append((r.lang, r.shard))
                full += r["size"]
        self.a, self.b = np.array([4.0, 0.5]), 0.0
        self.limit = np.full(len(langs), np.inf)

    def load(self, part: int, group: int) -> tuple[list[Shard], np.ndarray]:
        """The arrays of a group of shards: at most ``group_grams`` longest n-grams, or one shard."""
        import pickle

        units = self.groups[part][group]
        member = np.zeros((len(self.langs), SYMBOLS), bool)
        for lang, shard in units:
            member[self.langs.index(lang), shard] = True
        keys = self.shards.sparkSession.createDataFrame(units or [("", -1)], "lang string, shard int")
        got = self.shards.filter(F.col("part") == part).join(F.broadcast(keys), ["lang", "shard"]).select("lang", "data").toArrow()
        parts: dict[str, list] = {}
        for lang, data in zip(got.column("lang").to_pylist(), got.column("data")):
            parts.setdefault(lang, []).append(pickle.loads(data.as_buffer()))
        models = []
        for lang in self.langs:
            sides = []
            for side in (0, 1):
                both = [[p[side][n] for p in parts.get(lang, [])] for n in range(2, self.order + 1)]
                sides.append({n: tuple(np.concatenate([x[k] for x in xs]) if xs else np.empty(0, (np.uint64, np.float32)[k]) for k in (0, 1)) for n, xs in enumerate(both, 2)})
            models.append(Shard(self.order, *sides, self.facts[part, lang][1]))
        return models, member

    def calibrate(self, sums: np.ndarray, n: np.ndarray, truth: np.ndarray, tail: float = 0.999) -> None:
        """Fit the confidence and the rejection limits on rows of known language."""
        ok = n > 0
        ce, best, x = features(sums[ok], n[ok])
        y = (best == truth[ok]).astype(float)
        for k in range(len(self.langs)):
            own = np.sort(ce[truth[ok] == k, k])
            if len(own):
                self.limit[k] = own[min(len(own) - 1, int(tail * len(own)))] + 3 * own.std() + 0.1
        # Smoothed targets and a ridge keep the slope finite if all answers are right.
        y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = self.a.copy(), self.b
        for _ in range(500 if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ a + b, -30, 30)))
            d = (p - y) / len(y)
            a = a - 0.5 * (x.T @ d + 1e-3 * (a - self.a))
            b = b - 0.5 * float(d.sum())
        self.a, self.b = np.maximum(a, 0.0), b


class Answer:
    """Reads scores: languages, confidences and rejections."""

    def __init__(self, model: LanguageModel):
        self.langs, self.a, self.b, self.limit = model.langs, model.a, model.b, model.limit

    def __call__(self, sums: np.ndarray, n: np.ndarray):
        ce, best, x = features(sums, n)
        conf = 1 / (1 + np.exp(-np.clip(x @ self.a + self.b, -30, 30)))
        conf = np.where(n > 0, conf, 0.0)
        rejected = (n == 0) | (conf < 0.5) | (ce[np.arange(len(ce)), best] > self.limit[best])
        return [self.langs[k] if m > 0 else "und" for k, m in zip(best, n)], conf, rejected


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = 5, calibration_rows: int = 3000, folds: int = 5, group_grams: int = 4_000_000) -> LanguageModel | None:
    """Models of all languages that ``docs`` names; null languages and texts are left out; None if nothing is left.

    All texts are counted, and all n-grams kept.  Confidence and rejection are
    calibrated on ``calibration_rows`` texts (smallest hashes) of one of ``folds``
    folds of the texts, by models estimated from the other folds.  ``group_grams``
    bounds what is sent to the executors at a time, not the model.
    """
    src = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    src = src.withColumn("h", F.xxhash64("text")).withColumn("seen", F.pmod(F.xxhash64("h"), F.lit(folds)) != 0)
    counted = src.select("text", "lang", "seen").mapInArrow(_count(order), "lang string, seen boolean, gram long, n long").groupBy("lang", "seen", "gram").agg(F.sum("n").alias("n"))
    part = F.explode(F.when(F.col("seen"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part")
    shard = F.shiftright("gram", BITS).bitwiseAND(SYMBOLS - 1).cast("int").alias("shard")
    both = counted.select(part, "lang", "gram", "n").groupBy("part", "lang", "gram").agg(F.sum("n").alias("n"))
    both = stored(both.select("part", "lang", shard, "gram", "n"), "grams")
    unit = both.groupBy("part", "lang", "shard")
    stats = unit.applyInArrow(_stats(order), STATS).groupBy("part", "lang", "n", "symbol").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).collect()  # at most 4,100 rows a language and part
    if not stats:
        return None
    facts: dict[tuple[int, str], tuple[dict, np.ndarray]] = {}
    langs = sorted({r.lang for r in stats})
    for p in (0, 1):
        for lang in langs:
            own = [r for r in stats if (r.part, r.lang) == (p, lang)]
            first = np.zeros(SYMBOLS)
            for r in own:
                if r.n == 1:
                    first[r.symbol] = r.once
            facts[p, lang] = {r.n: discount(r.once, r.twice) for r in own if r.n > 1}, unigrams(first)
    shared = docs.sparkSession.sparkContext.broadcast(facts)  # 4,096 unigrams a language and part
    model = LanguageModel(langs, order, stored(unit.applyInArrow(_estimate(order, shared), BLOBS), "shards"), facts, group_grams)
    held = src.filter(~F.col("seen"))
    few = held.select("h").distinct().orderBy("h").limit(calibration_rows)  # hashes only: no task gathers texts to sort
    known = held.join(F.broadcast(few), "h").groupBy("h", "lang").agg(F.first("text").alias("text"))  # calibration_rows bounds the broadcast; copies fold map-side
    rows = sums_of(stored(known.select(F.struct("h", "lang").alias("k"), "text"), "calibration"), model, 1).select("k.*", "sums", "n").orderBy("h", "lang").collect()  # calibration_rows rows of numbers
    if rows:
        model.calibrate(np.array([r.sums for r in rows]), np.array([r.n for r in rows]), np.array([langs.index(r.lang) for r in rows]))
    return model


def sums_of(keyed: DataFrame, model: LanguageModel, part: int = 0) -> DataFrame:
    """(k, sums, n): log-probabilities of each text by language and its symbols, for rows of k and text.

    With more than one group of shards, the sums of each group go by two hashes
    of the text, so that equal texts are summed once, and meet in a join.
    """
    spark = model.shards.sparkSession
    groups = model.groups[part]

    def scored(src: DataFrame, group: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(model.load(part, group))  # group_grams bounds it

        def run(batches):
            scorer = Scorer(*shared.value)
            for b in batches:
                for lo, hi in _slices(b, "text"):
                    piece = b.slice(lo, hi - lo)
                    sums, n = scorer.texts(piece.column("text").to_pylist())
                    at = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
                    yield pa.RecordBatch.from_arrays([piece.column("k"), pa.ListArray.from_arrays(at, pa.array(sums.ravel())), pa.array(n)], names=["k", "sums", "n"])

        return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, sums array<double>, n double")

    if len(groups) == 1:
        return scored(keyed, 0)
    two = F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("k")
    parts = None
    for g in range(len(groups)):
        one = scored(keyed.select(two, "text"), g).groupBy("k").agg(F.first("sums").alias("sums"), F.first("n").alias("n"))
        one = stored(one, "groupsums")
        parts = one if parts is None else parts.union(one)
    width = len(model.langs)
    total = parts.groupBy(F.col("k").alias("t")).agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)], F.max("n").alias("n"))
    return keyed.select("k", two.alias("t")).join(total, "t").select("k", F.array(*[f"s{i}" for i in range(width)]).alias("sums"), "n")


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``id_col``, lang_pred, score (confidence), rejected.

    Texts that are null or have no letter get ``und``, 0 and rejected; so does
    every text if there is no model.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    src = docs.select(F.struct(F.col(id_col).alias("id")).alias("k"), F.col(text_col).cast("string").alias("text"))
    name = distinct_names([id_col], ["lang_pred", "score", "rejected"])[0]
    if model is None:
        return src.select(F.col("k.id").alias(name), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    schema = pa.schema([("id", to_arrow_type(id_type)), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    answer = Answer(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                sums = b.column("sums").flatten().to_numpy().reshape(b.num_rows, -1)
                lang, conf, rejected = answer(sums, b.column("n").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("id").cast(schema[0].type), pa.array(lang), pa.array(conf), pa.array(rejected)], schema=schema)

    out = sums_of(src, model).select("k.id", "sums", "n").mapInArrow(run, f"id {id_type.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", name)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """Identify every text's language with models of the rows that are not held out.

    Held out are rows whose crc32(id as text) mod ``folds`` is ``fold``; a null id
    is not.  Returns ``id_col``, held_out, lang_pred, score, rejected.  Repeated
    rows agree; an empty table gives an empty result; other columns are ignored.
    """
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds == fold, F.lit(False))
    model = train(docs.filter(~held(id_col)), text_col, lang_col, **options)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = identify(src, model, "id", "text").select("id", held("id").alias("held_out"), "lang_pred", "score", "rejected")
    return out.withColumnRenamed("id", distinct_names([id_col], out.columns[1:])[0])
