"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose candidate spans.  Four labelers vote on each: the kind's own
check (Luhn, remainders, ranges, number plans, mixture of characters), a
gazetteer (top-level domains, given names, issuer, country and key prefixes), the
words before it, and its edges.  Expectation-maximisation over the table of vote
patterns, whose size is bounded by the number of labelers, estimates how reliable
each labeler is and how likely each pattern is personal data; a logistic
classifier trained on those soft labels, over the votes and the span's shape,
gives every candidate its probability.  Matches of the base patterns that pass their check always
stay; candidates of the further patterns join them from one half.

Offsets come from lengths of matches and of the gaps between them, summed by a
window per document.  Possessive quantifiers and look-behinds make every pattern
linear, also on very long runs of digits or letters.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import distinct_names, stored

HONORIFIC = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sra|Sr|Srta"
#: fixed values: frequent given names in English, French, German and Spanish
GIVEN = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Steven|Paul|Andrew|Joshua|Kevin|Brian|George|Edward|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Emily|Emma|Olivia|Alice|Anna|"
    "Jean|Pierre|Michel|André|Philippe|Jacques|Louis|Nicolas|François|Laurent|Antoine|Julien|Marie|Jeanne|Françoise|Monique|Catherine|Nathalie|Isabelle|Sylvie|Sophie|Camille|Chloé|"
    "Hans|Peter|Klaus|Wolfgang|Jürgen|Dieter|Andreas|Stefan|Matthias|Lukas|Felix|Jonas|Ursula|Monika|Petra|Sabine|Renate|Helga|Ingrid|Katrin|Greta|Heike|"
    "José|Jose|Antonio|Juan|Manuel|Francisco|Luis|Javier|Carlos|Miguel|Pedro|Alejandro|Diego|Maria|María|Carmen|Josefa|Isabel|Dolores|Pilar|Teresa|Lucia|Lucía|Ana|Elena"
)
#: kind, pattern, cheap test that a text may match it; the first four are the base kinds, fixed by definition
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}"),
    ("name", rf"(?<![\p{{L}}])(?=\p{{Lu}}\p{{Ll}}++\.?[ ]\p{{Lu}})(?:(?:{HONORIFIC})\b\.?[ ]\p{{Lu}}\p{{Ll}}++(?:[ ]\p{{Lu}}\p{{Ll}}++){{0,2}}|(?:{GIVEN})(?:[ ]\p{{Lu}}\p{{Ll}}++){{1,2}})(?![\p{{L}}])", r"(?<![\p{L}])\p{Lu}\p{Ll}++\.?[ ]\p{Lu}"),
    ("phone_local", r"(?<![0-9A-Za-z+(])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9])", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"),
)
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(k for k, _, _ in PATTERNS)
CONTEXT = {
    "email": r"mail|contact|write|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": r"phone|tel|call|fax|mobile|cell|handy",
    "phone_local": r"phone|tel|call|fax|mobile|cell|handy",
    "iban": r"iban|account|konto|compte|cuenta",
    "name": r"name|dear|by|from|contact|signed",
    "ssn": r"ssn|social|security",
    "secret": r"token|secret|api|key|passw|pwd|bearer|auth|credential",
}
#: gazetteers: what the entry at a candidate's telling place should match
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|int|io|info|biz|example|test|invalid|[a-z]{2})$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-2][0-9])\.",
    "card": r"^(?:3[47]|3[068]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "phone_local": r"^\(?[2-9][0-8]",
    "iban": r"^(?:AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "name": rf"(?:^|[ .])(?:{GIVEN})(?: |$)",
    "ssn": r"^(?:[0-6]|7[0-6]|77[0-2])",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_|pk_|xox[abprs]-|AIza|eyJ|[0-9a-f]{32}(?:[0-9a-f]{8})?(?:[0-9a-f]{24})?$)",
}
VOTES = ("v_check", "v_gazetteer", "v_context", "v_edge")
#: the span's shape, 0 or 1: more digits than letters, capitals, longer than most, after a quote, colon or equals sign
SHAPE = ("s_digits", "s_capital", "s_long", "s_quoted")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    figures = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(figures, one), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """Each kind's own check."""
    n = F.length(_digits(match))

    def part(p: Column) -> Column:
        figures = F.regexp_replace(p, "^0+", "")
        return (F.length(figures) <= 3) & (F.coalesce(figures.try_cast("int"), F.lit(0)) <= 255)

    return (
        F.when(kind == "ip", F.forall(F.split(match, r"\."), part))
        .when(kind == "card", F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "iban", _remainder_97(match) == 1)
        .when(kind == "ssn", ~match.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "phone_local", ~_digits(match).rlike("^.11|^[01]|^...[01]|^....11"))
        .when(kind == "name", F.size(F.split(match, " ")) - F.when(match.rlike(rf"^(?:{HONORIFIC})\b"), 1).otherwise(0) >= 2)
        .when(kind == "secret", match.rlike("[0-9].*[0-9].*[0-9]") & match.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]") & ~match.rlike("^[/A-Za-z_-]+[0-9]{0,4}$") & ~match.rlike(r"([A-Za-z0-9])\1{5}"))
        .otherwise(F.lit(True))
    )


def _remainder_97(match: Column) -> Column:
    """The remainder that an account number's check digits make 1: four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(match, " ", "")
    marks = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    step = lambda acc, c: F.when(F.ascii(c) < 65, acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(marks, F.lit(0), step)


def _by_kind(kind: Column, table: dict[str, str], test) -> Column:
    out = None
    for k, pattern in table.items():
        out = F.when(kind == k, test(pattern)) if out is None else out.when(kind == k, test(pattern))
    return out


def candidates(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """A row per document (rid, id, hash), and a row per candidate span with its votes."""
    text = F.col("text")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    src = src.withColumn("digits", text.rlike("[0-9]"))  # most texts have none, and most kinds need one
    found = []
    for kind, pattern, test in PATTERNS:
        match, gaps = F.regexp_extract_all("text", F.lit(pattern), 0), F.split("text", pattern, -1)
        name = F.lit(kind).alias("kind")
        both = F.zip_with(F.slice(gaps, 1, F.size(match)), match, lambda g, m: F.struct(name, F.length(g).alias("gap"), F.right(g, F.lit(32)).alias("before"), m.alias("match")))  # noqa: B023
        maybe = text.contains("@") if test == "@" else text.rlike(test) if kind == "name" else F.col("digits") & text.rlike(test)
        found.append(F.when(maybe & text.isNotNull(), both))
    kept = src.select(F.monotonically_increasing_id().alias("rid"), "id", "hash", *[f.alias(f"m{i}") for i, f in enumerate(found)])
    kept = stored(kept, "matches")
    spans = None
    for i in range(len(PATTERNS)):
        one = kept.filter(F.col(f"m{i}").isNotNull()).select("rid", F.posexplode(f"m{i}").alias("pos", "m")).select("rid", "pos", "m.*")
        spans = one if spans is None else spans.union(one)
    upto = Window.partitionBy("rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    spans = spans.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    kind, match = F.col("kind"), F.col("match")
    spans = spans.withColumn("ok", _valid(kind, match))
    glued = F.col("before").rlike(r"[\p{L}0-9]$")
    spans = spans.select(
        "rid", "kind", "start", "end", "ok",
        F.when(F.col("ok"), 1).otherwise(-1).alias("v_check"),
        F.when(_by_kind(kind, GAZETTEER, lambda p: match.rlike(p)), 1).otherwise(-1).alias("v_gazetteer"),
        F.when(_by_kind(kind, CONTEXT, lambda p: F.lower("before").rlike(p)), 1).otherwise(0).alias("v_context"),
        F.when(glued, -1).otherwise(1).alias("v_edge"),
        (F.length(_digits(match)) * 2 > size).cast("int").alias("s_digits"),
        match.rlike(r"^\p{Lu}").cast("int").alias("s_capital"),
        (size > 24).cast("int").alias("s_long"),
        F.col("before").rlike("[\"'=:] ?$").cast("int").alias("s_quoted"),
    )
    return kept.select("rid", "id", "hash"), spans


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """P(personal data) of each (kind, votes, count), by a model of labelers that err independently given the truth."""
    if not patterns:
        return []
    kinds = sorted({k for k, _, _ in patterns})
    post = [1 / (1 + exp(-1.5 * sum(v))) for _, v, _ in patterns]
    for _ in range(rounds):
        prior = {}
        for k in kinds:
            own = [(p, n) for p, (kind, _, n) in zip(post, patterns) if kind == k]
            prior[k] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        rate = []
        for j in range(len(patterns[0][1])):
            t = {}
            for y in (0, 1):
                # A labeler is taken to be better than chance, as is usual where truth is never seen.
                mass = {v: 1.0 + (2.0 if v and (v > 0) == bool(y) else 0.0) for v in (-1, 0, 1)}
                for p, (_, votes, n) in zip(post, patterns):
                    mass[votes[j]] += n * (p if y else 1 - p)
                whole = sum(mass.values())
                t[y] = {v: m / whole for v, m in mass.items()}
            rate.append(t)
        post = []
        for k, votes, _ in patterns:
            z = log(prior[k] / (1 - prior[k])) + sum(log(t[1][v] / t[0][v]) for t, v in zip(rate, votes))
            post.append(1 / (1 + exp(-max(-30, min(30, z)))))
    return post


def train_classifier(patterns: list[tuple[str, tuple[int, ...], int]], soft: list[float], steps: int = 300, ridge: float = 1e-3) -> tuple[dict[str, float], list[float]]:
    """Intercepts by kind and a weight for each vote and shape feature, fitted to soft labels weighted by counts."""
    total = sum(n for _, _, n in patterns) or 1
    width = len(VOTES) + len(SHAPE)
    bias, w = {k: 0.0 for k in KINDS}, [0.5] * len(VOTES) + [0.0] * len(SHAPE)
    for _ in range(steps):
        gb, gw = dict.fromkeys(KINDS, 0.0), [ridge * x for x in w]
        for (k, seen, n), y in zip(patterns, soft):
            z = bias[k] + sum(a * v for a, v in zip(w, seen))
            d = (1 / (1 + exp(-max(-30, min(30, z)))) - y) * n / total
            gb[k] += d
            for j in range(width):
                gw[j] += d * seen[j]
        bias = {k: b - 2.0 * (gb[k] + ridge * b) for k, b in bias.items()}
        w = [x - 2.0 * g for x, g in zip(w, gw)]
    return bias, w


def fit(table: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict[str, float], list[float]]:
    """The classifier of (kind, votes and shape, count) rows: soft labels come from the votes alone."""
    votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, seen, n in table:
        key = kind, seen[: len(VOTES)]
        votes[key] = votes.get(key, 0) + n
    patterns = [(k, v, n) for (k, v), n in sorted(votes.items())]
    soft = dict(zip(((k, v) for k, v, _ in patterns), expectation_maximisation(patterns)))
    return train_classifier(table, [soft[k, seen[: len(VOTES)]] for k, seen, _ in table])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All personal data of every text.

    Returns a row per input row: ``id_col``, text_hash (xxhash64 of the text),
    n_email, n_ip, n_card, n_phone (base spans), base and spans: arrays of
    (kind, start, end, p) in order of kind, then start, in code points, end
    exclusive.  ``spans`` are the base spans and those that the method adds, none
    of which overlaps a base span; further kinds follow the base kinds by name.
    Null and empty texts have none.  Repeated rows are judged each on its own; an
    empty table gives an empty result; other columns are ignored.
    """
    rows, spans = candidates(docs, id_col, text_col)
    spans = stored(spans, "candidates")
    table = spans.groupBy("kind", *VOTES, *SHAPE).count().collect()  # at most 3 ** labelers times 2 ** shapes rows a kind
    bias, w = fit(sorted((r.kind, tuple(r[v] for v in (*VOTES, *SHAPE)), r["count"]) for r in table))
    z = F.coalesce(*[F.when(F.col("kind") == k, F.lit(b)) for k, b in bias.items()])
    for v, x in zip((*VOTES, *SHAPE), w):
        z = z + F.lit(x) * F.col(v)
    is_base = F.col("kind").isin(*BASE)
    scored = spans.withColumn("p", F.round(1 / (1 + F.exp(-z)), 6)).filter(F.col("ok") & (is_base | (F.col("p") >= 0.5)))
    # An added span overlaps a base span if one that starts no later ends after its start, or the next one starts before its end.
    by_start = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max(F.when(is_base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    onward = F.min(F.when(is_base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    scored = scored.withColumn("reach", reach).withColumn("onward", onward)
    scored = scored.filter(is_base | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("onward") < F.col("end"), F.lit(False))))
    kind = F.when(F.col("kind") == "phone_local", "phone").otherwise(F.col("kind"))
    order = F.array(*map(F.lit, (*BASE, "iban", "name", "secret", "ssn")))
    span = F.struct(F.array_position(order, kind).cast("int").alias("rank"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), kind.alias("kind"), F.col("p").alias("p"))
    per = scored.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(is_base, span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("all"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
    )
    plain = lambda a: F.coalesce(F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["p"].alias("p"))), F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,p:double>>)"))
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE]
    names = ["text_hash", *[f"n_{k}" for k in BASE], "base", "spans"]
    return rows.join(per, "rid", "left").select(
        F.col("id").alias(distinct_names([id_col], names)[0]), F.col("hash").alias("text_hash"), *counts,
        plain(F.col("base")).alias("base"), plain(F.col("all")).alias("spans"),
    )


def joined_spans(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; all other text and columns as they were.

    Overlapping spans become one mark.  Texts without personal data stay as they
    are, null stays null.  Rows travel as one struct, so other columns may have
    any names.  Repeated rows are redacted alike; an empty table stays empty.
    """
    found = find_pii(docs.select(F.col(id_col).alias("m_id"), F.col(text_col).alias("text")), "m_id", "text")
    marks = found.filter(F.size("spans") > 0).select("m_id", F.col("text_hash").alias("m_hash"), "spans").dropDuplicates(["m_id", "m_hash"])
    marks = marks.select("m_id", "m_hash", F.inline("spans")).drop("p")
    before = Window.partitionBy("m_id", "m_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    piece = F.struct("start", "end", "from", F.when(F.col("start") >= F.col("from"), F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).otherwise("").alias("mark"))
    marks = stored(marks.groupBy("m_id", "m_hash").agg(F.array_sort(F.collect_list(piece)).alias("marks"), F.max("end").alias("last")), "marks")
    text = F.col("text")
    parts = F.transform("marks", lambda x: F.concat(F.substring(text, x["from"].cast("int") + 1, F.greatest(x["start"] - x["from"], F.lit(0)).cast("int")), x["mark"]))
    new = F.concat(F.array_join(parts, ""), F.substring(text, F.col("last").cast("int") + 1, F.length(text)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    out = rows.join(marks.hint("merge"), rows["id"].eqNullSafe(marks["m_id"]) & (rows["hash"] == marks["m_hash"]), "left")
    out = out.withColumn("new", F.when(F.col("marks").isNull(), text).otherwise(new))
    return out.select(F.col("row").withField(f"`{text_col}`", F.col("new")).alias("row")).select("row.*")
