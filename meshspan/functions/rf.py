"""Link-budget physics as Column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import lit

EFFECTIVE_EARTH_M = 6_378_137.0 * 4 / 3
LIGHT_M_S = 299_792_458.0
SIGMA_DB = 2.375
#: fixed values: receiver sensitivity at 125 kHz by spreading factor
BASE_SENSITIVITY = {7: -123.0, 8: -126.0, 9: -129.0, 10: -132.0, 11: -134.5, 12: -137.0}


def sensitivity_dbm(sf, bandwidth_khz, coding_rate) -> Column:
    """Null for unknown spreading factors and bandwidths that are not positive."""
    table = F.create_map(*[F.lit(x) for kv in BASE_SENSITIVITY.items() for x in kv])
    base = F.try_element_at(table, lit(sf).cast("int"))
    nudge = F.when(lit(coding_rate) < 5, -1.0).when(lit(coding_rate) > 5, 1.0).otherwise(0.0)
    return F.when(lit(bandwidth_khz) > 0, base + 10 * F.log10(lit(bandwidth_khz) / 125) + nudge)


def decode_threshold_dbm(sf, bandwidth_khz, coding_rate, margin_db, override=None) -> Column:
    own = sensitivity_dbm(sf, bandwidth_khz, coding_rate)
    return (F.coalesce(lit(override), own) if override is not None else own) + lit(margin_db)


def reliability_margin_db(situation_pct: float, time_pct: float, sigma: float = SIGMA_DB) -> float:
    """The fade margin of two percentages; settings, not rows, carry them."""
    z = [NormalDist().inv_cdf(min(1 - 1e-9, max(1e-9, p / 100))) for p in (situation_pct, time_pct)]
    return (z[0] ** 2 + z[1] ** 2) ** 0.5 * sigma


def step_margin_db(situation_pct, time_pct, sigma: float = SIGMA_DB) -> Column:
    """The coarse margin that published request records carry."""
    z = lambda p: F.when(lit(p) >= 95, 1.645).when(lit(p) >= 90, 1.282).otherwise(1.0)
    return F.sqrt(z(situation_pct) * z(situation_pct) + z(time_pct) * z(time_pct)) * sigma


def eirp_chain_dbm(tx_power, tx_gain, rx_gain, loss) -> Column:
    return lit(tx_power) + lit(tx_gain) + lit(rx_gain) - lit(loss)


def watts_to_dbm(w) -> Column:
    return 10 * F.log10(lit(w) * 1000)


def fspl_db(distance_m, freq_mhz) -> Column:
    return 20 * F.log10(F.greatest(lit(distance_m), F.lit(1.0)) / 1000) + 20 * F.log10(lit(freq_mhz)) + 32.44


def knife_edge_db(nu) -> Column:
    v = lit(nu) - 0.1
    loss = 6.9 + 20 * F.log10(F.sqrt(v * v + 1) + v)
    return F.when(lit(nu) < -0.78, 0.0).otherwise(F.least(F.lit(120.0), F.greatest(F.lit(0.0), loss)))


def profile_steps(distance_m, step_m) -> Column:
    d = lit(distance_m)
    return F.when(d < 2, 0).otherwise(F.greatest(F.ceil(d / lit(step_m)), F.lit(40))).cast("int")


def diffraction_nu(s, d, terrain, z_tx, z_rx, freq_mhz, fresnel_fraction) -> Column:
    """The obstruction parameter of one profile sample; null where the path is clear or an end is within two metres."""
    s, d = lit(s), lit(d)
    wl = LIGHT_M_S / (lit(freq_mhz) * 1e6)
    line = lit(z_tx) * (1 - s / d) + lit(z_rx) * (s / d) - s * (d - s) / (2 * EFFECTIVE_EARTH_M)
    over = lit(terrain) - (line - lit(fresnel_fraction) * F.sqrt(wl * s * (d - s) / d))
    return F.when((s >= 2) & (d - s >= 2) & (over > 0), over * F.sqrt(2 * d / (wl * s * (d - s))))


def mutual_margin_db(forward, reverse) -> Column:
    """Null if neither way works, -infinity if one does, else the smaller margin."""
    f, r = lit(forward), lit(reverse)
    return F.when(f.isNull() & r.isNull(), F.lit(None).cast("double")).when(f.isNull() | r.isNull(), F.lit(float("-inf"))).otherwise(F.least(f, r))


def link_kind(forward, reverse) -> Column:
    f, r = lit(forward), lit(reverse)
    return F.when(f.isNotNull() & r.isNotNull(), "two_way").when(f.isNotNull() | r.isNotNull(), "one_way").otherwise("none")


def within_hop(distance_m, hop_km) -> Column:
    """Whether a distance is within a hop range, with a metre of slack."""
    return lit(distance_m) <= lit(hop_km) * 1000 + 1


def depth_admissible(left_m, hops: int, depth: int, hop_m: float) -> Column:
    """Whether the other end, ``left_m`` away, can be reached with the hops left after ``depth``."""
    return lit(left_m) <= (hops - depth) * hop_m + 1


def z_score(pct) -> Column:
    """The normal quantile of a percentage, by a rational approximation good to 1e-9 (fixed coefficients)."""
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), lit(pct) / 100))
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(k, x):
        out = F.lit(0.0)
        for v in k:
            out = out * x + v
        return out

    def tail(q):
        return poly(c, q) / (poly(d, q) * q + 1)

    mid = p - 0.5
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.ln(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.ln(1 - p)))).otherwise(poly(a, mid * mid) * mid / (poly(b, mid * mid) * mid * mid + 1))


def reliability_margin(situation_pct, time_pct, sigma: float = SIGMA_DB) -> Column:
    """The fade margin of two percentages that rows carry."""
    s, t = z_score(situation_pct), z_score(time_pct)
    return F.sqrt(s * s + t * t) * sigma
