"""Enrichment of IP addresses: range join to country and network, infrastructure type, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import table_bytes

BROADCAST_LIMIT = 64 * 1024 * 1024

# Approximate centre of every country (latitude, longitude) ---------------------------
COUNTRY_CENTRES = {
    "AE": (23.4, 53.8), "AF": (33.9, 67.7), "AR": (-38.4, -63.6), "AT": (47.5, 14.6), "AU": (-25.3, 133.8),
    "BD": (23.7, 90.4), "BE": (50.5, 4.5), "BG": (42.7, 25.5), "BR": (-14.2, -51.9), "BY": (53.7, 27.9),
    "CA": (56.1, -106.3), "CH": (46.8, 8.2), "CL": (-35.7, -71.5), "CN": (35.9, 104.2), "CO": (4.6, -74.3),
    "CY": (35.1, 33.4), "CZ": (49.8, 15.5), "DE": (51.2, 10.5), "DK": (56.3, 9.5), "DZ": (28.0, 1.7),
    "EE": (58.6, 25.0), "EG": (26.8, 30.8), "ES": (40.5, -3.7), "FI": (61.9, 25.7), "FR": (46.2, 2.2),
    "GB": (55.4, -3.4), "GE": (42.3, 43.4), "GR": (39.1, 21.8), "HK": (22.3, 114.2), "HR": (45.1, 15.2),
    "HU": (47.2, 19.5), "ID": (-0.8, 113.9), "IE": (53.4, -8.2), "IL": (31.0, 34.9), "IN": (20.6, 79.0),
    "IQ": (33.2, 43.7), "IR": (32.4, 53.7), "IS": (65.0, -19.0), "IT": (41.9, 12.6), "JP": (36.2, 138.3),
    "KE": (-0.02, 37.9), "KG": (41.2, 74.8), "KH": (12.6, 105.0), "KP": (40.3, 127.5), "KR": (35.9, 127.8),
    "KZ": (48.0, 66.9), "LB": (33.9, 35.9), "LK": (7.9, 80.8), "LT": (55.2, 23.9), "LU": (49.8, 6.1),
    "LV": (56.9, 24.6), "MA": (31.8, -7.1), "MD": (47.4, 28.4), "MM": (21.9, 95.96), "MN": (46.9, 103.8),
    "MT": (35.9, 14.4), "MX": (23.6, -102.6), "MY": (4.2, 102.0), "NG": (9.1, 8.7), "NL": (52.1, 5.3),
    "NO": (60.5, 8.5), "NP": (28.4, 84.1), "NZ": (-40.9, 174.9), "PA": (8.5, -80.8), "PE": (-9.2, -75.0),
    "PH": (12.9, 121.8), "PK": (30.4, 69.3), "PL": (51.9, 19.1), "PT": (39.4, -8.2), "QA": (25.4, 51.2),
    "RO": (45.9, 25.0), "RS": (44.0, 21.0), "RU": (61.5, 105.3), "SA": (23.9, 45.1), "SC": (-4.7, 55.5),
    "SE": (60.1, 18.6), "SG": (1.35, 103.8), "SI": (46.2, 15.0), "SK": (48.7, 19.7), "TH": (15.9, 100.99),
    "TR": (38.96, 35.2), "TW": (23.7, 121.0), "UA": (48.4, 31.2), "US": (37.1, -95.7), "UZ": (41.4, 64.6),
    "VE": (6.4, -66.6), "VG": (18.4, -64.6), "VN": (14.1, 108.3), "ZA": (-30.6, 22.9), "BZ": (17.2, -88.5),
    "BS": (25.0, -77.4), "KY": (19.3, -81.3), "PY": (-23.4, -58.4), "UY": (-32.5, -55.8), "EC": (-1.8, -78.2),
    "BO": (-16.3, -63.6), "CR": (9.7, -83.8), "GT": (15.8, -90.2), "NI": (12.9, -85.2), "HN": (15.2, -86.2),
    "SV": (13.8, -88.9), "DO": (18.7, -70.2), "CU": (21.5, -77.8), "JM": (18.1, -77.3), "TN": (33.9, 9.5),
    "LY": (26.3, 17.2), "ET": (9.1, 40.5), "GH": (7.9, -1.0), "CI": (7.5, -5.5), "SN": (14.5, -14.5),
    "TZ": (-6.4, 34.9), "UG": (1.4, 32.3), "ZW": (-19.0, 29.2), "AM": (40.1, 45.0), "AZ": (40.1, 47.6),
    "JO": (30.6, 36.2), "KW": (29.3, 47.5), "OM": (21.5, 55.9), "BH": (26.0, 50.6), "SY": (34.8, 39.0),
    "YE": (15.6, 48.5), "AL": (41.2, 20.2), "BA": (43.9, 17.7), "ME": (42.7, 19.4), "MK": (41.6, 21.7),
    "LI": (47.2, 9.6), "MC": (43.7, 7.4), "AD": (42.5, 1.6), "GI": (36.1, -5.35), "IM": (54.2, -4.5),
    "JE": (49.2, -2.1), "GG": (49.5, -2.6), "MO": (22.2, 113.5), "BN": (4.5, 114.7), "LA": (19.9, 102.5),
}
# ---------------------------------------------------------------------------------------------------


def country_centres(spark) -> DataFrame:
    return spark.createDataFrame([(c, lat, lon) for c, (lat, lon) in COUNTRY_CENTRES.items()], "country string, lat double, lon double")


def ip_key(ip: Column) -> Column:
    """32 hex digits that order like the address: IPv4 as its mapped IPv6 form; null when the text is no IP address."""
    t = F.regexp_replace(F.trim(ip), r"^(?i:::ffff:)(?=\d+\.)", "")  # the mapped form is the IPv4 address
    octets = F.transform(F.split(t, r"\."), lambda x: x.try_cast("int"))
    v4_ok = t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda o: o.between(0, 255))
    v4 = F.concat(F.lit("00000000000000000000ffff"), F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o)), 2, "0")), ""))
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    head, tail = groups(F.substring_index(t, "::", 1)), groups(F.when(F.instr(t, "::") > 0, F.substring_index(t, "::", -1)).otherwise(""))
    fill = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))
    parts = F.when(F.instr(t, "::") > 0, F.concat(head, fill, tail)).otherwise(head)
    v6_ok = t.rlike("^[0-9A-Fa-f:]+$") & (F.instr(t, ":") > 0) & (F.size(parts) == 8) & F.forall(parts, lambda g: F.length(g) <= 4)
    v6 = F.array_join(F.transform(parts, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    return F.when(v4_ok, v4).when(v6_ok, v6)


# an IPv4 /16 in the mapped form: 24 digits of prefix and 4 of address; an IPv6 /32 has the same number of free digits in front
BUCKET_DIGITS_V4, BUCKET_DIGITS_V6 = 28, 8
# an IPv6 range over this many buckets meets the addresses on its first digits instead, of which there are 65,536 at most
WIDE_BUCKETS, WIDE_DIGITS = 4096, 4


def _bucket(key: Column) -> Column:
    v4 = key.startswith("00000000000000000000ffff")
    return F.when(v4, F.substring(key, 1, BUCKET_DIGITS_V4)).otherwise(F.substring(key, 1, BUCKET_DIGITS_V6))


def ip_range_join(ips: DataFrame, ranges: DataFrame, ip: str = "src_ip", default_country: str = "XX", default_asn: str = "AS_UNKNOWN") -> DataFrame:
    """Country and ASN of the narrowest range holding each address. ranges: start_ip, end_ip, country, asn.

    Each distinct address is looked up once. Ranges inside one bucket (/16 for IPv4, /32 for IPv6) meet the addresses on
    that bucket; the few wider ranges are cut at the bucket borders, very wide IPv6 ranges at
    coarser ones, so every range finds its addresses by an equi-join. Addresses that are null, none, or lie in no range, get the
    defaults.
    """
    one = ips.select(ip).where(F.col(ip).isNotNull()).distinct().withColumn("__k", ip_key(F.col(ip)))
    one = one.withColumn("__b", F.explode_outer(F.array(_bucket(F.col("__k")), F.concat(F.lit("w"), F.substring("__k", 1, WIDE_DIGITS)))))
    r = ranges.select(ip_key(F.col("start_ip")).alias("__s"), ip_key(F.col("end_ip")).alias("__e"), "country", "asn")
    number = lambda b: F.conv(b, 16, 10).cast("long")
    bs, be = _bucket(F.col("__s")), _bucket(F.col("__e"))
    v4 = F.length(bs) == BUCKET_DIGITS_V4
    low4, high4 = number(F.substring(bs, 25, 4)), number(F.substring(be, 25, 4))
    low6, high6 = number(bs), number(be)
    wide = lambda k: F.conv(F.substring(k, 1, WIDE_DIGITS), 16, 10).cast("long")
    coarse = F.transform(F.sequence(wide(F.col("__s")), wide(F.col("__e"))), lambda n: F.concat(F.lit("w"), F.lpad(F.lower(F.hex(n)), WIDE_DIGITS, "0")))
    lists = F.when(~v4 & (high6 - low6 >= WIDE_BUCKETS), coarse).when(v4, F.transform(F.sequence(low4, high4), lambda n: F.concat(F.lit("00000000000000000000ffff"), F.lpad(F.lower(F.hex(n)), 4, "0")))).otherwise(
        F.transform(F.sequence(low6, high6), lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")))
    cut = r.withColumn("__b", F.explode(lists))
    # the width as text orders like the number: a narrower range shares a longer prefix of its two ends
    hit = one.join(cut, "__b").where((F.col("__k") >= F.col("__s")) & (F.col("__k") <= F.col("__e")))
    best = hit.groupBy(ip).agg(F.max(F.struct(F.col("__s").alias("s"), _descending(F.col("__e")).alias("e"), "country", "asn")).alias("r"))
    found = best.select(ip, F.col("r.country").alias("country"), F.col("r.asn").alias("asn"))
    looked_up = one.select(ip).distinct().join(found, ip, "left").select(ip, F.coalesce("country", F.lit(default_country)).alias("country"), F.coalesce("asn", F.lit(default_asn)).alias("asn"))
    return (ips.join(looked_up, ip, "left")  # an unknown address is no reason to lose the row
            .withColumns({"country": F.coalesce("country", F.lit(default_country)), "asn": F.coalesce("asn", F.lit(default_asn))}))


def _descending(hex_text: Column) -> Column:
    """Hex digits mirrored (0 for f, 1 for e, ...), so that a smaller end sorts higher. Nested ranges with the latest start and,
    of those, the earliest end are the narrowest."""
    return F.translate(hex_text, "0123456789abcdef", "fedcba9876543210")


def asn_type(df: DataFrame, asn_types: DataFrame, tor_exits: DataFrame, ip: str = "src_ip", asn: str = "asn") -> DataFrame:
    """TOR_EXIT for listed exits, else the type of the network, else UNKNOWN. Both lists are broadcast only while small."""
    small = lambda d: F.broadcast(d) if table_bytes(d) <= BROADCAST_LIMIT else d
    number = F.regexp_extract(F.upper(F.trim(asn)), r"^(?:AS)?\s*(\d+)$", 1).try_cast("long")
    j = (df.withColumn("__n", number).join(small(asn_types.select(F.col("asn").cast("long").alias("__n"), F.col("type").alias("__type")).distinct()), "__n", "left")
         .join(small(tor_exits.select(F.col("ip").alias(ip)).distinct().withColumn("__tor", F.lit(True))), ip, "left"))
    return j.withColumn("asn_type", F.when(F.col("__tor"), "TOR_EXIT").otherwise(F.coalesce("__type", F.lit("UNKNOWN")))).drop("__n", "__type", "__tor")
