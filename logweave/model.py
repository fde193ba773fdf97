"""The log record and the catalogue of classes and their fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("id", "ts", "node", "host", "program", "class", "msg")


@dataclass(frozen=True)
class Catalogue:
    """Classes by name: number, and fields as name to type ('int', 'ip', 'proto', 'country' or 'string').

    Given by the user; `small()` is one for the log view. Ids 0 and 1 stand for any class and for no class.
    """

    numbers: dict[str, int]
    fields: dict[str, dict[str, str]] = field(default_factory=dict)

    def having(self, name: str) -> list[str]:
        """Classes that have a field."""
        return sorted(c for c, f in self.fields.items() if name in f)

    def type_of(self, name: str) -> str | None:
        return next((f[name] for f in self.fields.values() if name in f), None)

    def slots(self, cls: str) -> list[str]:
        """Field names of a class in order."""
        return list(self.fields.get(cls, {}))


def small() -> Catalogue:
    net = {"srcip": "ip", "dstip": "ip", "dstport": "int"}
    return Catalogue(
        {"NONE": 1, "FIREWALL_CONNECTION_END": 3, "URL": 7, "SSH_LOGIN": 11, "BRO_HTTP": 19},
        {
            "URL": {"srcip": "ip", "dstip": "ip", "k": "int"},
            "BRO_HTTP": net | {"k": "int"},
            "FIREWALL_CONNECTION_END": net | {"conn_bytes": "int"},
            "SSH_LOGIN": {"dstport": "int", "k": "int"},
        },
    )


def log_view(events: DataFrame) -> DataFrame:
    """The log record over a table of events (event_id, ts, user_id, event_type, value, props)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    user = F.col("user_id")
    host = F.concat(F.lit("10."), (user % 2).cast("string"), F.lit("."), F.expr("user_id div 250").cast("string"), F.lit("."), (user % 250 + 1).cast("string"))
    dst = F.concat(F.when(k % 4 == 0, F.lit("192.168.1.")).otherwise(F.lit("203.0.113.")), k.cast("string"))
    kind = F.col("event_type")
    cls = F.when(kind == "click", "URL").when(kind == "view", "BRO_HTTP").when(kind == "purchase", "FIREWALL_CONNECTION_END").when(kind == "signup", "SSH_LOGIN").otherwise("NONE")
    msg = F.concat(kind, F.lit(" user="), user.cast("string"), F.lit(" from "), host, F.lit(" to "), dst, F.lit(" k="), k.cast("string"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("node"), (user % 3).cast("string")).alias("node"),
        host.alias("host"),
        kind.alias("program"),
        cls.alias("class"),
        host.alias("srcip"),
        dst.alias("dstip"),
        (k + 1000).alias("dstport"),
        k.alias("k"),
        F.floor(F.col("value") * 100).cast("long").alias("conn_bytes"),
        msg.alias("msg"),
    )


def with_fields(log: DataFrame, names: tuple[str, ...] = ("srcip", "dstip", "dstport", "k", "conn_bytes")) -> DataFrame:
    """log with the named columns as one map `fields`, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])
    return log.withColumn("fields", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))
