"""Road roles, costs, difficulty and budgets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import lit

#: fixed values: road vocabulary
DRIVABLE = ("motorway", "trunk", "primary", "secondary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary", "unclassified", "residential", "service", "track")
WALKABLE = ("foot", "path", "cycleway", "bridleway")
PAVED_SURFACES = ("paved", "asphalt", "concrete", "chipseal", "tarmac")
UNPAVED_SURFACES = ("unpaved", "gravel", "fine_gravel", "compacted", "dirt", "ground", "sand", "mud", "grass", "earth")
MAJOR = ("motorway", "trunk", "primary", "secondary", "motorway_link", "trunk_link", "primary_link", "secondary_link")
DIFFICULTIES = ("easy", "medium", "difficult", "extreme")


def _in(c: Column, values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def is_paved_surface(surface) -> Column:
    return _in(lit(surface), PAVED_SURFACES)


def is_unpaved_surface(surface) -> Column:
    return _in(lit(surface), UNPAVED_SURFACES)


def default_role(kind, surface, access) -> Column:
    return (
        F.when(lit(access) == "private", "private")
        .when(_in(lit(kind), DRIVABLE), F.when(is_paved_surface(surface), "paved").otherwise("jeep"))
        .when(_in(lit(kind), WALKABLE), "hiking")
        .otherwise("other")
    )


def rule_matches(rule: dict[str, Column], seg: dict[str, Column]) -> Column:
    """Whether all fields that a rule sets agree; a rule that sets none never matches."""
    out, any_set = F.lit(True), F.lit(False)
    for f, want in rule.items():
        have = seg[f]
        same = have == want
        if f == "surface":
            same = F.when(want == "paved", is_paved_surface(have)).otherwise(same)
        out = out & (want.isNull() | F.coalesce(same, F.lit(False)))
        any_set = any_set | want.isNotNull()
    return out & any_set


def is_jeep_highway(highway, tracktype, surface, fourwd, allowed) -> Column:
    smooth = _in(lit(tracktype), ("grade1", "grade2")) | F.coalesce(lit(surface) == "paved", F.lit(False))
    return _in(lit(highway), allowed) & ((lit(highway) != "track") | F.coalesce(lit(fourwd), F.lit(False)) | ~smooth)


def is_paved_anchor(highway, surface, paved_classes=MAJOR) -> Column:
    h = lit(highway)
    return (
        F.when(_in(h, ("track", "footway", "path", "steps", "service", "bridleway")), False)
        .when(is_unpaved_surface(surface), False)
        .when(is_paved_surface(surface), _in(h, (*paved_classes, "tertiary", "tertiary_link")))
        .otherwise(_in(h, MAJOR))
    )


def cost_multiplier(highway, tracktype, surface, fourwd) -> Column:
    h, t = lit(highway), lit(tracktype)
    track = F.when(F.coalesce(lit(fourwd), F.lit(False)), 8.0).when(t == "grade5", 10.0).when(t == "grade4", 8.0).when(t == "grade3", 4.0).when(t == "grade2", 2.5).when(t == "grade1", 1.5).otherwise(3.0)
    m = (
        F.when(_in(h, ("motorway", "trunk", "primary")), 0.8)
        .when(_in(h, ("secondary", "tertiary")), 0.9)
        .when(_in(h, ("unclassified", "residential")), 1.0)
        .when(h == "service", 1.2)
        .when(h == "track", track)
        .otherwise(2.0)
    )
    return m * F.when(_in(lit(surface), ("paved", "asphalt", "concrete")), 0.85).otherwise(1.0)


def rank_of(label) -> Column:
    return F.when(lit(label) == "extreme", 3).when(lit(label) == "difficult", 2).when(lit(label) == "medium", 1).otherwise(0)


def label_of(rank) -> Column:
    return F.element_at(F.array(*map(F.lit, DIFFICULTIES)), lit(rank).cast("int") + 1)


def worse(a, b) -> Column:
    return label_of(F.greatest(rank_of(a), rank_of(b)))


def access_difficulty(hike, jeep) -> Column:
    """The worse of two labels; a missing or empty one does not count."""
    h, j = F.nullif(lit(hike), F.lit("")), F.nullif(lit(jeep), F.lit(""))
    return F.when(h.isNotNull() & j.isNotNull(), worse(h, j)).otherwise(F.coalesce(h, j))


def hike_difficulty(max_grade, avg_grade, gain) -> Column:
    a, g = lit(avg_grade), lit(gain)
    return (
        F.when((g >= 250) & (a >= 18), "extreme")
        .when((g >= 80) & (a >= 15), "difficult")
        .when((lit(max_grade) >= 15) | (a >= 8) | (g >= 40), "medium")
        .otherwise("easy")
    )


def jeep_rank(highway, tracktype) -> Column:
    h, t = lit(highway), lit(tracktype)
    return (
        F.when(t == "grade5", 3)
        .when(_in(t, ("grade3", "grade4")), 2)
        .when(t == "grade2", 1)
        .when(_in(h, ("motorway", "trunk", "primary", "secondary", "tertiary")), 0)
        .when(_in(h, ("residential", "unclassified")) & F.coalesce(t == "grade1", F.lit(False)), 0)
        .otherwise(1)
    )


def budget_class(highway, tracktype) -> Column:
    h = lit(highway)
    return F.coalesce(lit(tracktype), F.when(_in(h, ("unclassified", "track")), "grade5").otherwise(h))


def access_mode(park_paved, hike_m) -> Column:
    walk = lit(hike_m) > 5
    return F.when(lit(park_paved), F.when(walk, "hike_only").otherwise("neither")).otherwise(F.when(walk, "both").otherwise("jeep_only"))


def preference_score(hike_m, trail_m, jeep_m, rank, w=(1.0, 0.5, 0.1, 500.0)) -> Column:
    return lit(hike_m) * w[0] + lit(trail_m) * w[1] + lit(jeep_m) * w[2] + lit(rank) * w[3]


def drop_reason(jeep_over, class_over, hike_over, grade_over) -> Column:
    over = lambda c: F.coalesce(lit(c) > 1e-9, F.lit(False))
    return F.when(over(jeep_over) | over(class_over), "jeep").when(over(hike_over), "hike").when(over(grade_over), "slope").otherwise("jeep")


def hike_edge_cost(horiz, rise) -> Column:
    return lit(horiz) + 4 * F.greatest(lit(rise), F.lit(0.0)) + 8 * F.greatest(-lit(rise), F.lit(0.0))


def tracktype_of_grade(grade) -> Column:
    """Grade text with digits becomes gradeN, anything else null."""
    d = F.regexp_extract(lit(grade), r"(\d+)", 1)
    return F.when(d != "", F.concat(F.lit("grade"), d))
