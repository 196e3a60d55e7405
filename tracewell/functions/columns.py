"""Column expressions shared by the operators. Everything stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.config import RISKY_ASN_TYPES, SETTINGS

EARTH_KM = 6371.0


def micros(ts: Column | str) -> Column:
    """Timestamp as microseconds since the epoch (a long, so RANGE frames can use it)."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(60e6)


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3600e6)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (p2 - p1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def spy_confidence(gap_sec: Column, tau: float = SETTINGS.first_spy_tau_sec) -> Column:
    """How sure the first relay is the origin: grows with the gap to the second relay."""
    return 1 - F.exp(-gap_sec / F.lit(tau))


def is_risky(asn_type: Column) -> Column:
    """1.0 for Tor, VPN and bulletproof hosting; unknown counts as no."""
    return F.coalesce(asn_type.isin(*RISKY_ASN_TYPES), F.lit(False)).cast("double")


def equals_flag(column: Column, value) -> Column:
    return F.coalesce(column == F.lit(value), F.lit(False)).cast("double")


def software_fingerprint(version: Column, locktime: Column, rbf: Column) -> Column:
    """``v<version>|<t, h or 0>|<r or n>``: wallet-software habits; null if any of the three is unknown."""
    lock = F.when(locktime >= 500_000_000, "t").when(locktime > 0, "h").otherwise("0")
    text = F.concat(F.lit("v"), version.cast("long").cast("string"), F.lit("|"), lock, F.lit("|"),
                    F.when(rbf, "r").otherwise("n"))
    return F.when(version.isNotNull() & locktime.isNotNull() & rbf.isNotNull(), text)


def severity(risk: Column, s=SETTINGS) -> Column:
    return (F.when(risk >= s.risk_critical_min, "CRITICAL").when(risk >= s.risk_high_min, "HIGH")
            .when(risk >= s.risk_medium_min, "MEDIUM").otherwise("LOW"))


def severity_rank(name: Column) -> Column:
    return F.when(name == "CRITICAL", 3).when(name == "HIGH", 2).when(name == "MEDIUM", 1).when(name == "LOW", 0)


def just_below_power_of_ten(amount: Column) -> Column:
    """1.0 when 0.9*10^k <= amount < 10^k, the mark of structuring under a threshold."""
    ratio = amount / F.pow(F.lit(10.0), F.ceil(F.log10(amount)))
    return F.when(amount > 0, ((ratio >= 0.9) & (ratio < 1.0)).cast("double")).otherwise(0.0)


# Short asset names of swap memos, and the verbs that start one --------------------
SWAP_ASSETS = {"b": "BTC.BTC", "e": "ETH.ETH", "l": "LTC.LTC", "d": "DOGE.DOGE", "c": "BCH.BCH", "g": "GAIA.ATOM",
               "a": "AVAX.AVAX", "r": "THOR.RUNE"}
SWAP_VERBS = ("=", "swap", "s")
# ------------------------------------------------------------------------------------------------


def swap_memo(memo: Column) -> Column:
    """Struct (asset, destination_chain, destination_address, limit_text) of a swap memo; null when it is none."""
    parts = F.split(F.trim(memo), ":")
    verb = F.lower(F.trim(F.get(parts, F.lit(0))))
    raw_asset, dest = F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(2)))
    names = F.create_map(*[F.lit(x) for pair in SWAP_ASSETS.items() for x in pair])
    asset = F.when(F.length(raw_asset) == 1, F.coalesce(F.try_element_at(names, F.lower(raw_asset)), raw_asset)).otherwise(raw_asset)
    chain = F.when(F.instr(asset, ".") > 0, F.upper(F.substring_index(asset, ".", 1)))
    limit = F.nullif(F.get(parts, F.lit(3)), F.lit(""))
    ok = (F.size(parts) >= 3) & verb.isin(*SWAP_VERBS) & (raw_asset != "") & (dest != "") & (F.instr(dest, " ") == 0)
    return F.when(ok, F.struct(asset.alias("asset"), chain.alias("destination_chain"), dest.alias("destination_address"),
                               limit.alias("limit_text")))


def short_hash(text: Column, n: int) -> Column:
    return F.substring(F.sha1(text), 1, n)
