"""Project settings: documents to small driver objects and relations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = "slug string, name string, lat double, lon double, height_m double, tags array<string>, node string"


def merged(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: mappings merge key by key, other values replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_project(folder: str) -> dict:
    """config.yaml, sites.yaml and land.yaml of a project as one document; only the first must exist."""
    import yaml

    doc: dict = {}
    for name in ("config.yaml", "sites.yaml", "land.yaml"):
        p = Path(folder) / name
        if p.exists():
            doc = merged(doc, yaml.safe_load(p.read_text()) or {})
        elif name == "config.yaml":
            raise FileNotFoundError(p)
    validate(doc)
    return doc


def validate(doc: dict) -> None:
    for slug, site in (doc.get("sites") or {}).items():
        loc = site.get("loc")
        if not (isinstance(loc, list) and len(loc) == 2 and -90 <= loc[0] <= 90 and -180 <= loc[1] <= 180):
            raise ValueError(f"site {slug}: loc must be [lat, lon]")
    for name, source in ((doc.get("land") or {}).get("sources") or {}).items():
        for layer in source.get("layers") or []:
            if layer.get("role", "include") not in ("aoi", "include", "exclude"):
                raise ValueError(f"land source {name}: unknown role {layer['role']!r}")


def sites(spark: SparkSession, doc: dict) -> DataFrame:
    rows = []
    for slug, s in sorted((doc.get("sites") or {}).items()):
        tags = s.get("tags") or []
        tags = [tags] if isinstance(tags, str) else tags
        rows.append((slug, s.get("name", slug), float(s["loc"][0]), float(s["loc"][1]), s.get("height_m"), list(dict.fromkeys(x.strip().lower() for x in tags)), s.get("node")))
    return spark.createDataFrame(rows, SITES)


def catalogue_entry(catalogue: dict, value) -> dict:
    """A modem or environment: a name, an inline mapping, or {preset: name} with overrides."""
    if isinstance(value, str):
        if value not in catalogue:
            raise KeyError(f"unknown preset {value!r}")
        return dict(catalogue[value])
    if "preset" in value:
        return merged(catalogue_entry(catalogue, value["preset"]), {k: v for k, v in value.items() if k != "preset"})
    return dict(value)


def environment(defaults: dict, catalogue: dict, value) -> dict:
    return merged(defaults, catalogue_entry(catalogue, value)) if value else dict(defaults)


def boards(doc: dict) -> dict[str, float]:
    """Board radii in km, keys in lower case; radii outside 1 to 100 are errors."""
    out = {}
    for k, v in doc.items():
        if not 1 <= float(v["radius_km"]) <= 100:
            raise ValueError(f"board {k}: radius_km must be 1 to 100")
        out[k.lower()] = float(v["radius_km"])
    return out


def tx_height(site_height, project_height: float | None) -> Column:
    return F.greatest(F.coalesce(F.col(site_height), F.lit(project_height).cast("double"), F.lit(2.0)), F.lit(1.0))


def hop_radius(node_radius_km, project_km: float) -> Column:
    return F.least(F.coalesce(F.col(node_radius_km), F.lit(project_km)), F.lit(project_km)) * 1000


def way_tags(tags) -> Column:
    """highway, tracktype, surface and fourwd of an OSM tag map; null without a highway."""
    get = lambda k: F.nullif(F.lower(F.btrim(F.try_element_at(tags, F.lit(k)))), F.lit(""))
    s = F.struct(get("highway").alias("highway"), get("tracktype").alias("tracktype"), get("surface").alias("surface"), F.coalesce(get("4wd_only").isin("yes", "1", "true"), F.lit(False)).alias("fourwd"))
    return F.when(get("highway").isNotNull(), s)


def agency_highway(asset_class) -> tuple[Column, Column]:
    """(highway, tracktype) of an agency's road class."""
    rough = F.coalesce(F.upper(F.col(asset_class)).rlike("PRIMITIVE|TRAIL"), F.lit(False))
    return F.when(rough, "track").otherwise("unclassified"), F.when(rough, "grade4")
