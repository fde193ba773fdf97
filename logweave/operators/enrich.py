"""Lookups of records in tables of networks, places, threats, names, hashes and others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import is_local, network_number

SMALL_RANGES = 10_000
MD5 = r"(?:^|\s)([0-9a-fA-F]{32})(?:\s|$)"


LEVELS = (8, 16, 24, 32, 48, 63)  # bits of the cells; a range lies in at most two cells of the first that is wider


def _by_cell(df: DataFrame, number: Column, bits: Sequence[int]) -> DataFrame:
    """df with _bits and _cell of the number at each level."""
    cells = F.array(*[F.struct(F.lit(b).alias("_bits"), F.shiftright(number, b).alias("_cell")) for b in bits])
    return df.withColumn("_c", F.explode(cells)).select("*", "_c._bits", "_c._cell").drop("_c")


def range_hits(points: DataFrame, ranges: DataFrame, low: str, high: str, small: int = SMALL_RANGES) -> DataFrame:
    """points (column _point, each number once) joined with the ranges that hold them.

    A range goes by the cells of the first level that is as wide as itself, so it has two cells at most, and a point
    asks for its cell of each level: an equi join with a filter. At most `small` rows of cells are broadcast, and then only
    the levels that they use are asked for; more are shuffled.
    """
    width = F.col(high) - F.col(low)
    bits = F.coalesce(*[F.when(width < (1 << b), b) for b in LEVELS[:-1]], F.lit(LEVELS[-1]))
    cell = lambda x: F.array(*[F.struct(F.lit(b).alias("_bits"), F.shiftright(x, b).alias("_cell")) for b in LEVELS])
    own = lambda x: F.filter(cell(F.col(x)), lambda c: c["_bits"] == bits)
    spread = ranges.withColumns({low: F.col(low).cast("long"), high: F.col(high).cast("long")}).where(F.col(low) <= F.col(high))
    spread = spread.withColumn("_c", F.explode(F.array_distinct(F.concat(own(low), own(high))))).select("*", "_c._bits", "_c._cell").drop("_c")
    seen = spread.select("_bits").limit(small + 1).agg(F.count("*").alias("n"), F.collect_set("_bits").alias("bits")).first()
    few = seen["n"] <= small
    asked = _by_cell(points, F.col("_point"), sorted(seen["bits"]) if few and seen["n"] else LEVELS)
    inside = (F.col("_point") >= F.col(low)) & (F.col("_point") <= F.col(high))
    return asked.join(F.broadcast(spread) if few else spread, ["_bits", "_cell"]).where(inside).drop("_bits", "_cell")


def range_join(left: DataFrame, ranges: DataFrame, point: Column, low: str, high: str, how: str = "left", small: int = SMALL_RANGES) -> DataFrame:
    """left joined with the ranges that hold its point (a whole number): each distinct number is looked up once and joined back by its value."""
    rows = left.withColumn("_point", point.cast("long"))
    hits = range_hits(rows.select("_point").where("_point is not null").distinct(), ranges, low, high, small)
    return rows.join(hits, "_point", how).drop("_point")


def lookup_ranges(df: DataFrame, ranges: DataFrame, into: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """df with a struct of the range's columns for each address column (address to struct's name); null where none holds it.

    Each distinct address of all the columns is looked up once. Of several ranges the narrowest, then the first, counts.
    """
    every = df.select(F.explode(F.array(*[F.col(ip) for ip in into])).alias("_ip"))
    addresses = every.where("_ip is not null").distinct().withColumn("_point", network_number(F.col("_ip")))
    hits = range_hits(addresses.where("_point is not null"), ranges, "start_ip", "end_ip")
    best = F.min_by(F.struct(*columns), F.struct(F.col("end_ip") - F.col("start_ip"), "start_ip"))
    found = hits.groupBy("_ip").agg(best.alias("_found"))
    for ip, name in into.items():
        own = found.select(F.col("_ip").alias("_key"), F.col("_found").alias(name))
        df = df.join(own, df[ip] == own["_key"], "left").drop("_key")
    return df


REGISTRY = ("name", "descr", "org", "cc")
NETWORK = (*REGISTRY, "country", "state", "city")


def enrich_networks(df: DataFrame, subnets: DataFrame, orgs: DataFrame, fields: Sequence[str] = ("srcip", "dstip")) -> DataFrame:
    """`<field>_net` (name, descr, org, cc, country, state, city, is_local, customer) for each address field.

    subnets: start_ip, end_ip, org, customer, is_local; orgs: org, name, descr, cc, country, state, city (what it
    lacks is null). If a side is local, only its customer and address are kept, on the first local side.
    """
    orgs = orgs.withColumns({c: F.lit(None).cast("string") for c in NETWORK if c not in orgs.columns})
    known = subnets.join(orgs, "org", "left").select("start_ip", "end_ip", *NETWORK, "customer", "is_local")
    df = lookup_ranges(df, known, {f: f"{f}_net" for f in fields}, [*NETWORK, "customer", "is_local"])
    sides = [f for f in fields if f in ("srcip", "dstip")]
    local = [F.coalesce(F.col(f"{f}_net.is_local"), F.lit(False)) for f in sides]
    before = F.lit(False)
    for f, here in zip(sides, local, strict=True):
        nothing = F.lit(None).cast("string")
        kept = F.struct(*[nothing.alias(c) for c in NETWORK], F.col(f"{f}_net.customer").alias("customer"), F.lit(True).alias("is_local"))
        any_ = F.lit(False)
        for x in local:
            any_ = any_ | x
        df = df.withColumn(f"{f}_new", F.when(here & ~before, kept).when(~any_, F.col(f"{f}_net")))
        before = before | here
    for f in sides:
        df = df.withColumn(f"{f}_net", F.col(f"{f}_new")).drop(f"{f}_new")
    return df


def enrich_registry(df: DataFrame, registry: DataFrame, fields: Sequence[str] = ("srcip",), default_cc: str = "US") -> DataFrame:
    """`<field>_reg` (name, descr, org, cc) of a registry table (start_ip, end_ip, name, descr, org, cc); a missing country is `default_cc`."""
    known = registry.withColumn("cc", F.coalesce("cc", F.lit(default_cc)))
    return lookup_ranges(df, known, {f: f"{f}_reg" for f in fields}, list(REGISTRY))


GEO = ("cc", "country", "state", "city", "latitude", "longitude")


def enrich_geo(df: DataFrame, places: DataFrame, fields: Sequence[str] = ("srcip", "dstip")) -> DataFrame:
    """`<field>_geo` of a table start_ip, end_ip, cc, country, state, city, latitude, longitude; the narrowest range, so a country's is the fallback."""
    return lookup_ranges(df, places, {f: f"{f}_geo" for f in fields}, list(GEO))


def enrich_threats(df: DataFrame, indicators: DataFrame, subnets: Sequence[tuple[str, str]], ip: str = "dstip", names: Sequence[str] = ()) -> DataFrame:
    """`<field>_threat` (description, severity, since): distinct values of all entries of a field's value joined by a space.

    indicators: kind (ip or name), start_ip, end_ip, value, description, severity, since (text). Addresses in the
    subnets are skipped.
    """
    texts = ("description", "severity", "since")
    joined = [F.array_join(F.array_sort(F.collect_set(c)), " ").alias(c) for c in texts]
    pack = lambda name: F.struct(*texts).alias(name)
    addresses = df.select(F.col(ip).alias("_k")).where(F.col("_k").isNotNull() & ~is_local(F.col("_k"), subnets)).distinct().withColumn("_point", network_number(F.col("_k")))
    hits = range_hits(addresses.where("_point is not null"), indicators.where("kind = 'ip'").select("start_ip", "end_ip", *texts), "start_ip", "end_ip")
    found = hits.groupBy("_k").agg(*joined).select("_k", pack(f"{ip}_threat"))
    df = df.join(found, df[ip] == found["_k"], "left").drop("_k")
    for f in names:
        by_name = indicators.where("kind = 'name'").groupBy(F.col("value").alias("_k")).agg(*joined).select("_k", pack(f"{f}_threat"))
        df = df.join(by_name, df[f] == by_name["_k"], "left").drop("_k")
    return df


def enrich_dns(df: DataFrame, pdns: DataFrame, now: Column, ip: str = "dstip", name: str | None = None) -> DataFrame:
    """`<ip>_dns`: names of the address, first seen, age in days; `<name>_dns`: addresses of the name. pdns: name, type, address, first_seen."""
    used = pdns.where(F.col("type").isin("A", "AAAA", "CNAME"))
    age = F.floor((F.unix_seconds(now) - F.unix_seconds(F.min("first_seen"))) / 86400).cast("long")
    for key, other, column in ((ip, "name", "address"), *(((name, "address", "name"),) if name else ())):
        facts = used.groupBy(F.col(column).alias("_k")).agg(F.array_sort(F.collect_set(other)).alias("found"), F.unix_seconds(F.min("first_seen")).alias("first_seen"), age.alias("age_days"))
        facts = facts.select("_k", F.struct("found", "first_seen", "age_days").alias(f"{key}_dns"))
        df = df.join(facts, df[key] == facts["_k"], "left").drop("_k")
    return df


def enrich_md5(df: DataFrame, verdicts: DataFrame, text: str = "msg") -> DataFrame:
    """`md5` and `scans` (scanner to verdict) for a hash of 32 hex digits standing alone in the text. verdicts: md5, scanner, verdict."""
    by_hash = verdicts.groupBy(F.lower("md5").alias("_k")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("scanner", "verdict")))).alias("scans"))
    out = df.withColumn("md5", F.nullif(F.lower(F.regexp_extract(text, MD5, 1)), F.lit("")))
    return out.join(by_hash, F.col("md5") == F.col("_k"), "left").drop("_k")


FINE = tuple(range(0, 63, 2))  # bits of the cells for intervals of one key; a cell is at most four times as wide as its intervals


def _ordinal(df: DataFrame, column: str) -> Column:
    """A whole number that rises with the column's values: microseconds, days, or the number rounded down."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.make_timestamp_ltz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), F.extract(F.lit("SECOND"), c), F.lit("UTC")))
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.floor(c).cast("long")
    raise ValueError(f"{column} is no time or number but {kind}")


def enrich_lookup(df: DataFrame, lookup: DataFrame, on: dict[str, str], fields: Sequence[str], during: tuple[str, str, str] | None = None) -> DataFrame:
    """Each requested field as the sorted array of its non-null values in the lookup rows that agree in the `on` columns (df to lookup).

    during: (time column of df, first column, last column of lookup), times or numbers, each of the same type. Distinct keys are
    looked up, not records. An interval goes by the one or two cells of the level that fits its width, and a time asks for its
    cell of each level that occurs, so that (key, level, cell) is an equi key: a key with very many intervals is spread
    over its cells, and without `on` columns the cells alone are the key.
    """
    keys = [*on, *([during[0]] if during else [])]
    asked = df.select(*keys).distinct()
    own = [F.col(v).alias(f"_k{i}") for i, v in enumerate(on.values())]
    values = [F.col(f).alias(f"_f_{f}") for f in fields]
    table, tests = lookup.select(*own, *values), []
    if during:
        if len({dict(df.dtypes)[during[0]]} | {dict(lookup.dtypes)[c] for c in during[1:]} & {"timestamp", "timestamp_ntz", "date"}) > 1:
            raise ValueError("times must be of one type")
        table = lookup.select(*own, F.col(during[1]).alias("_a"), F.col(during[2]).alias("_b"), _ordinal(lookup, during[1]).alias("_low"), _ordinal(lookup, during[2]).alias("_high"), *values)
        width = F.col("_high") - F.col("_low")
        level = F.coalesce(*[F.when(width < F.lit(1 << b), b) for b in FINE], F.lit(FINE[-1]))
        table = table.where("_a <= _b").withColumn("_bits", level)
        bits = sorted(r[0] for r in table.select("_bits").distinct().collect())  # 32 at most
        two = F.array_distinct(F.transform(F.array("_low", "_high"), lambda x: F.call_function("shiftright", x, F.col("_bits"))))
        table = table.withColumn("_cell", F.explode(two)).withColumnsRenamed({"_bits": "_own_bits", "_cell": "_own_cell"})
        asked = _by_cell(asked, _ordinal(df, during[0]), bits or FINE[:1])
        tests = [F.col("_bits") == F.col("_own_bits"), F.col("_cell") == F.col("_own_cell"), F.col(during[0]).between(F.col("_a"), F.col("_b"))]
    test = F.lit(True)
    for t in [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)] + tests:
        test = test & t
    found = asked.join(table, test).groupBy(*keys).agg(*[F.array_sort(F.collect_list(f"_f_{f}")).alias(f) for f in fields])
    out = df.join(found, keys, "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.array().cast(found.schema[f].dataType)) for f in fields})


def enrich_asn(df: DataFrame, asn: DataFrame, local_asn: Sequence[int]) -> DataFrame:
    """The end whose number is not ours (the source if neither is) with its description, country and city. df: src_asn, dst_asn; asn: asn, descr, cc, city, latitude, longitude."""
    ours = F.col("src_asn").isin(list(local_asn))
    side = df.withColumn("asn", F.when(ours, F.col("dst_asn")).otherwise(F.col("src_asn")))
    return side.join(asn.select("asn", "descr", "cc", "city", "latitude", "longitude"), "asn", "left")


def remote_country(df: DataFrame, places: DataFrame, private: Sequence[tuple[str, str]], home: str = "US") -> DataFrame:
    """`country`: of the destination if the source is private, of the source if the destination is, else the one that is not home."""
    out = enrich_geo(df, places)
    src, dst = F.col("srcip_geo.cc"), F.col("dstip_geo.cc")
    country = F.when(fn.is_local(F.col("srcip"), private), dst).when(fn.is_local(F.col("dstip"), private), src).when(src == home, dst).otherwise(src)
    return out.withColumn("country", country).drop("srcip_geo", "dstip_geo")


def with_dimensions(df: DataFrame, programs: DataFrame, classes: DataFrame) -> DataFrame:
    """Names for program_id and class_id. programs: id, program; classes: id, class."""
    p = programs.select(F.col("id").alias("program_id"), F.col("program").alias("program_name"))
    c = classes.select(F.col("id").alias("class_id"), F.col("class").alias("class_name"))
    return df.join(p, "program_id", "left").join(c, "class_id", "left")


IMPORT = ("name", "description", "type", "date")


def with_import_info(df: DataFrame, imports: DataFrame) -> DataFrame:
    """import_id and the import's name, description, type and date for rows inside one. imports: id, …, first_id, last_id, not overlapping."""
    info = imports.select(F.col("id").alias("import_id"), *[F.col(c).alias(f"import_{c}") for c in IMPORT], "first_id", "last_id")
    return range_join(df, info, F.col("id"), "first_id", "last_id").drop("first_id", "last_id")


__all__ = [k for k in dir() if not k.startswith("_")]
