"""Every registered query with SQL beside it gives the same rows in both engines."""

import os

import pytest

from meshspan.plans import catalogue
from tests.compare import differences, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: queries whose small data hold no case; they run at the next size
SPARSE = {"land_clip_to_aoi", "access_nearest_road", "road_components", "park_sectors", "solver_routes", "land_eligible_area", "near_entries", "eligible_peaks_in_areas", "land_dissolved"}


@pytest.fixture(scope="module")
def engines():
    return {d: duck(d) for d in (SF, SF.replace("0.001", "0.01"))}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, engines, name):
    sf = SF.replace("0.001", "0.01") if name in SPARSE else SF
    assert differences(spark, engines[sf], sf, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []
