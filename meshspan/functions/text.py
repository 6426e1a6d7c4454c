"""Slugs, digests, dates and property text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import lit, rounded


def slug(name) -> Column:
    """Lower-case ASCII letters, digits and hyphens; white space is dropped, an empty result is "site"."""
    s = F.regexp_replace(F.btrim(lit(name)), "[^A-Za-z0-9_-]", "")
    s = F.regexp_replace(F.lower(s), "^_+", "")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "-_", "-")
    s = F.regexp_replace(F.regexp_replace(s, "_", "-"), "-+$", "")
    return F.when(s == "", "site").otherwise(s)


def digest(parts: list, version: str | None = "v8") -> Column:
    cols = [F.lit(version)] if version else []
    return F.sha2(F.concat_ws("|", *cols, *[lit(p).cast("string") for p in parts]), 256)


def compare_text(value) -> Column:
    """Property text for comparisons: trimmed, empty to null, whole floats as integers."""
    t = F.nullif(F.btrim(lit(value)), F.lit(""))
    return F.when(t.rlike(r"^-?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def property_in(props, field: str, values: list[str]) -> Column:
    """Whether a map's field is among the values; missing and blank are not."""
    return F.coalesce(compare_text(F.try_element_at(props, F.lit(field))).isin(*values), F.lit(False))


def matches_filters(props, include: dict[str, list[str]], exclude: dict[str, list[str]]) -> Column:
    """All included fields must match one of their values, and no excluded field may."""
    out = F.lit(True)
    for f, v in include.items():
        out = out & property_in(props, f, v)
    for f, v in exclude.items():
        out = out & ~property_in(props, f, v)
    return out


def safe_properties(props) -> Column:
    """Blank and null values dropped, the others trimmed."""
    kept = F.map_filter(props, lambda _, v: v.isNotNull() & (F.btrim(v) != ""))
    return F.transform_values(kept, lambda _, v: F.btrim(v))


def normal_tags(tags) -> Column:
    """Trimmed lower-case tags, each once, in order; invalid ones dropped."""
    t = F.transform(tags, lambda x: F.lower(F.btrim(x)))
    return F.array_distinct(F.filter(t, lambda x: x.rlike("^[a-z0-9][a-z0-9_-]*$")))


def tags_pass(tags, include: list[str], exclude: list[str]) -> Column:
    """Any included tag (or none asked) and no excluded one."""
    inc = F.lit(True) if not include else F.arrays_overlap(tags, F.array(*map(F.lit, include)))
    exc = F.lit(False) if not exclude else F.arrays_overlap(tags, F.array(*map(F.lit, exclude)))
    return F.coalesce(inc, F.lit(False)) & ~F.coalesce(exc, F.lit(False))


def relay_tags(a, b) -> Column:
    """Tags of both ends, or else of either with a mark."""
    both = F.array_intersect(a, b)
    return F.when(F.size(both) > 0, both).otherwise(F.concat(F.array_union(a, b), F.array(F.lit("union-fallback"))))


def name_number(name, prefix: str) -> Column:
    return F.regexp_extract(lit(name), rf"^{prefix} (\d+)$", 1).try_cast("int")


def audit_status(exists, valid, last, interval_days, file_date, today) -> Column:
    """Freshness of a source: missing, invalid, stale, file_newer, ok or unknown."""
    last, today = lit(last), lit(today)
    return (
        F.when(~lit(exists), "missing")
        .when(~lit(valid), "invalid")
        .when(last.isNull(), "unknown")
        .when(today > F.date_add(last, lit(interval_days).cast("int")), "stale")
        .when(F.coalesce(lit(file_date) > last, F.lit(False)), "file_newer")
        .otherwise("ok")
    )


def sse_event(event, data) -> Column:
    return F.concat(F.lit("event: "), lit(event), F.lit("\ndata: "), lit(data), F.lit("\n\n"))


def natural_key(name) -> Column:
    """A sort key that orders digit runs by value: each padded to twelve."""
    parts = F.regexp_extract_all(F.lower(lit(name)), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def layer_features(df, props: str, include: dict, exclude: dict, label: str, style: str):
    """``df`` filtered and with ``label`` and ``style_key``.

    ``include`` maps fields to wanted values, or to None for any value; a feature
    without properties passes only where nothing is included.
    """
    p = F.col(props)
    value = lambda f: compare_text(F.try_element_at(p, F.lit(f)))
    ok = F.lit(True)
    for f, wanted in include.items():
        ok = ok & (value(f).isNotNull() if wanted is None else property_in(p, f, wanted))
    for f, unwanted in exclude.items():
        ok = ok & ~property_in(p, f, unwanted)
    bare = p.isNull() | (F.size(p) == 0)
    kept = df.filter(F.when(bare, F.lit(not include)).otherwise(ok))
    return kept.withColumn("label", F.coalesce(value(label), F.lit(""))).withColumn("style_key", F.coalesce(value(style), F.lit("other")))


def grouped_values(report) -> Column:
    """(value, n) of the lines ``value (n)`` of a text report; other lines are left out."""
    line = r"^\s*(.*?)\s*\((\d+)\)\s*$"
    rows = F.filter(F.split(lit(report), "\n"), lambda x: x.rlike(line))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, line, 1).alias("value"), F.regexp_extract(x, line, 2).cast("long").alias("n")))


def csv_set(text) -> Column:
    """The entries of a comma-separated list, trimmed, blanks left out, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(lit(text), ","), lambda x: F.btrim(x)), lambda x: x != ""))


def line_digest(layer, points) -> Column:
    """A digest of a layer's name and a line's vertices (lat, lon) to five places."""
    pts = F.transform(lit(points), lambda p: F.format_string("%.5f,%.5f", p["lat"], p["lon"]))
    return F.sha2(F.concat(lit(layer).cast("string"), F.lit("|"), F.array_join(pts, ";")), 256)


#: Fixed value: the line of a hike report.
HIKE_REPORT = "=== Hike profile: %s === 3D distance: %.0f m | Gain: %.0f m | Loss: %.0f m | Max grade: %.1f%%"


def hike_report(name, length_m, gain_m, loss_m, max_grade) -> Column:
    """The report's line; numbers are rounded half up to the places printed, so printing has nothing left to decide."""
    shown = [rounded(lit(c), 0) for c in (length_m, gain_m, loss_m)] + [rounded(lit(max_grade), 1)]
    return F.format_string(HIKE_REPORT, lit(name), *shown)


def canonical_json(value: Column) -> Column:
    """JSON text of a struct whose fields are in order already, nulls left out."""
    return F.to_json(value)
