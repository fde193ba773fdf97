"""Log lines and tables as records. Each parser works on a DataFrame of lines (column value); read_* opens files for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..model import Catalogue

INTS = tuple(f"i{k}" for k in range(6))
STRINGS = tuple(f"s{k}" for k in range(6))
NUMBERS = ("int", "ip", "proto", "country")
MONTH_DAY = r"([A-Z][a-z]{2})\s+([0-9]{1,2})\s+([0-9]{2}:[0-9]{2}:[0-9]{2})"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _full(text: Column) -> Column:
    """null for null and for the values that count as absent, '' and '0'."""
    return F.when(~text.isin("", "0"), text)


def _host(text: Column) -> Column:
    """Number of a dotted host; a name without a dot counts as this machine."""
    return F.when(F.contains(text, F.lit(".")), fn.ip_to_long(text)).otherwise(F.lit(fn.LOCALHOST))


def _slot(value: Column, kind: str) -> Column:
    """A slot's stored form by its field's type: addresses and protocols as numbers in text."""
    if kind == "ip":
        return F.coalesce(fn.ip_to_long(value).cast("string"), value)
    if kind == "proto":
        return fn.proto_to_number(value)
    return value


def parse_log_tsv(lines: DataFrame, catalogue: Catalogue, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of lines `ts host program class msg i0 … i5 s0 … s5`, separated by tabs.

    A line is rejected if host or msg is missing, if more than one of ts, program and class is, or if the class number is
    not in the catalogue; one missing is now, `unknown`, or 1. Class `unknown` is 1, a program of digits is `unknown`.
    """
    now = F.unix_seconds(F.current_timestamp()) if now is None else now
    # One split a line, also where `value` is computed: what is generated is not merged into the expressions above it.
    parts = lines.select("value", F.explode(F.array(F.split("value", "\t"))).alias("part"))
    raw = {n: F.nullif(F.get("part", F.lit(i)), F.lit("")) for i, n in enumerate(("ts", "host", "program", "class", "msg", *INTS, *STRINGS))}
    df = parts.select("value", *[c.alias(n) for n, c in raw.items()])
    number = F.when(F.lower("class") == "unknown", F.lit("1")).otherwise(F.col("class"))
    missing = sum(F.col(c).isNull().cast("int") for c in ("ts", "program", "class"))
    known = F.coalesce(number, F.lit("1")).isin([str(n) for n in catalogue.numbers.values()])
    good = F.col("host").isNotNull() & F.col("msg").isNotNull() & (missing <= 1) & known
    df = df.withColumn("ok", F.coalesce(good, F.lit(False)))
    names = F.create_map(*[F.lit(x) for n, v in catalogue.numbers.items() for x in (str(v), n)])
    program = F.lower(F.when(F.col("program").rlike("^[0-9]+$"), F.lit("unknown")).otherwise(F.coalesce("program", F.lit("unknown"))))
    out = df.where("ok").select(
        F.coalesce(F.col("ts").try_cast("long"), now).alias("ts"), _host(F.col("host")).alias("host_id"), program.alias("program"),
        names[F.coalesce(number, F.lit("1"))].alias("class"), "msg", *[_full(F.col(c)).alias(c) for c in (*INTS, *STRINGS)],
    )
    slots: dict[str, dict[str, str]] = {}
    for cls, fields in catalogue.fields.items():
        for name, kind in _slots(fields):
            if kind in ("ip", "proto"):
                slots.setdefault(name, {})[cls] = kind
    converted = {}
    for c, kinds in slots.items():  # one lookup of the class for each slot, however many classes there are
        kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("class")]
        value = F.col(c)
        for k in sorted(set(kinds.values())):
            value = F.when(kind == k, _slot(F.col(c), k)).otherwise(value)
        converted[c] = value
    return out.withColumns(converted) if converted else out, df.where(~F.col("ok")).select("value")


def _slots(fields: dict[str, str]) -> list[tuple[str, str]]:
    """(slot, type) of a class's fields in order: numbers take i0 …, texts s0 …"""
    used = {"i": 0, "s": 0}
    out = []
    for kind in fields.values():
        letter = "i" if kind in NUMBERS else "s"
        out.append((f"{letter}{used[letter]}", kind))
        used[letter] += 1
    return out


def read_log_tsv(spark: SparkSession, path: str, catalogue: Catalogue) -> tuple[DataFrame, DataFrame]:
    return parse_log_tsv(_lines(spark, path), catalogue)


def from_structs(df: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Records (ts, host, program, class, msg, fields map) with one column for each catalogued field; missing numbers 0, missing texts ''."""
    names: dict[str, str] = {}
    for fields in catalogue.fields.values():
        names |= fields
    value = lambda n, kind: F.coalesce(_slot(F.col("fields")[n], kind).try_cast("long"), F.lit(0)) if kind in NUMBERS else F.coalesce(F.col("fields")[n], F.lit(""))
    return df.select("ts", "host", F.lower("program").alias("program"), "class", "msg", *[value(n, k).alias(n) for n, k in sorted(names.items())])


def parse_class_rows(df: DataFrame, catalogue: Catalogue, cls: str, now: Column | None = None) -> DataFrame:
    """Rows of a table whose columns are fields of one class, with an optional timestamp; an unknown column is an error. msg is all values joined by commas."""
    columns = [c for c in df.columns if c != "timestamp"]
    if unknown := set(columns) - set(catalogue.slots(cls)):
        raise ValueError(f"{cls} has no {', '.join(sorted(unknown))}")
    ts = fn.parse_time(F.col("timestamp").cast("string")) if "timestamp" in df.columns else F.lit(None).cast("long")
    now = F.unix_seconds(F.current_timestamp()) if now is None else now
    blank = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns}
    msg = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return df.select(F.coalesce(ts, now).alias("ts"), F.lit(cls).alias("class"), msg.alias("msg"), *[v.alias(c) for c, v in blank.items()])


def read_class_csv(spark: SparkSession, path: str, catalogue: Catalogue, cls: str, sep: str = ",", quote: str = "'") -> DataFrame:
    return parse_class_rows(spark.read.csv(path, header=True, sep=sep, quote=quote, escape=quote), catalogue, cls)


def _month_time(line: Column, year: int | Column, tz: str, pattern: str = MONTH_DAY) -> Column:
    year = (F.lit(year) if isinstance(year, int) else year).cast("string")
    text = F.concat_ws(" ", year, *[F.regexp_extract(line, pattern, k) for k in (1, 2, 3)])
    return F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss")), tz))


def parse_syslog(lines: DataFrame, year: int | Column, tz: str = "UTC") -> DataFrame:
    """ts, host, program, msg of `Mon d HH:MM:SS host program: msg`; other lines are dropped. The year, which lines lack, may be a column."""
    pattern = rf"^{MONTH_DAY}\s+(\S+)\s+([^:\[\s]+)(?:\[[0-9]+\])?:\s*(.*)$"
    get = lambda k: F.regexp_extract("value", pattern, k)
    rows = lines.where(F.col("value").rlike(pattern))
    return rows.select(_month_time(F.col("value"), year, tz, pattern).alias("ts"), get(4).alias("host"), F.lower(get(5)).alias("program"), get(6).alias("msg")).where("ts is not null")


def read_syslog(spark: SparkSession, path: str, year: int | Column, tz: str = "UTC", skip: int = 0) -> DataFrame:
    """Lines of syslog files but the first `skip` of each, which must lie in the file's first split (128 MB by default).

    A first split is read by one task, line after line, so a line's place in its file is its number less the split's least one.
    Those, one for each file as the driver lists them, are broadcast; no line is shuffled or sorted.
    """
    lines = _lines(spark, path)
    if skip:
        placed = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
        starts = placed.where("_split = 0").groupBy("_file").agg(F.min("_at").alias("_start"))
        lines = placed.join(F.broadcast(starts), "_file").where((F.col("_split") > 0) | (F.col("_at") - F.col("_start") >= skip)).select("value")
    return parse_syslog(lines, year, tz)


def time_span(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def parse_lines(lines: DataFrame, program: str, host: str, now: Column | None = None) -> DataFrame:
    now = F.unix_seconds(F.current_timestamp()) if now is None else now
    return lines.select(now.alias("ts"), F.lit(host).alias("host"), F.lit(program).alias("program"), F.col("value").alias("msg"))


def read_lines(spark: SparkSession, path: str, program: str, host: str) -> DataFrame:
    return parse_lines(_lines(spark, path), program, host)


def guess_formats(firsts: DataFrame) -> DataFrame:
    """path, format, quote from path and first line: the file name's score beats the line's; ties go to csv, syslog, lines."""
    name, line = F.lower(F.element_at(F.split("path", "/"), -1)), F.col("first")
    by_name = F.when(name.endswith(".csv"), F.lit(5)).otherwise(0)
    known = name.rlike(r"(^|[._-])(syslog|messages|secure|auth|daemon|kern|mail|cron)([._-]|$)")
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    csv = F.greatest(by_name, F.when(commas >= 3, 2).otherwise(0))
    syslog = F.greatest(F.when(known, 1).otherwise(0), F.when(line.rlike(rf"^{MONTH_DAY}\s"), 1).otherwise(0))
    kind = F.when((csv > 0) & (csv >= syslog), "csv").when(syslog > 0, "syslog").otherwise("lines")
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return firsts.select("path", kind.alias("format"), F.when(count('"') > count("'"), '"').otherwise("'").alias("quote"))


def detect_formats(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    return guess_formats(lines.groupBy("path").agg(F.min_by("value", "at").alias("first")))


def parse_bro(lines: DataFrame, stem: Column | str) -> DataFrame:
    """ts, program, msg of tab-separated lines that begin with an epoch; `#` lines are skipped."""
    part = F.split("value", "\t")
    stem = F.lit(stem) if isinstance(stem, str) else stem
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(F.floor(part[0].try_cast("double")).cast("long").alias("ts"), F.concat(F.lit("bro_"), stem).alias("program"), F.array_join(F.slice(part, 2, F.size(part)), "|").alias("msg"))


def read_bro(spark: SparkSession, path: str) -> DataFrame:
    return parse_bro(_lines(spark, path), F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1))


def parse_snort_fast(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    pattern = r"^([0-9]{2}/[0-9]{2}/[0-9]{4}-[0-9]{2}:[0-9]{2}:[0-9]{2})\S*\s+\[\*\*\]\s*(.*)$"
    at = F.try_to_timestamp(F.regexp_extract("value", pattern, 1), F.lit("MM/dd/yyyy-HH:mm:ss"))
    msg = F.trim(F.regexp_replace(F.regexp_extract("value", pattern, 2), r"\s*\[\*\*\]", ""))
    return lines.where(F.col("value").rlike(pattern)).select(F.unix_seconds(F.to_utc_timestamp(at, tz)).alias("ts"), F.lit("snort").alias("program"), msg.alias("msg"))


def read_snort_fast(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    return parse_snort_fast(_lines(spark, path), tz)


def parse_sidewinder(lines: DataFrame) -> DataFrame:
    """ts, program, msg of lines with `date="Mon d HH:MM:SS yyyy Z"` in front."""
    pattern = r'date="([A-Z][a-z]{2})\s+([0-9]{1,2})\s+([0-9:]{8})\s+([0-9]{4})\s+([A-Z]+)",?\s*(.*)$'
    get = lambda k: F.regexp_extract("value", pattern, k)
    text = F.concat_ws(" ", get(4), get(1), get(2), get(3))
    at = F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss")), get(5)))
    return lines.where(F.col("value").rlike(pattern)).select(at.alias("ts"), F.lit("auditd").alias("program"), get(6).alias("msg"))


def read_sidewinder(spark: SparkSession, path: str) -> DataFrame:
    return parse_sidewinder(_lines(spark, path))


def parse_preformatted(lines: DataFrame, import_id: int, class_only: bool = False, now: Column | None = None) -> DataFrame:
    """Ready-made columns; the host becomes the import id. With class_only lines begin with the class."""
    part = F.split("value", "\t")
    names = (["class"] if class_only else ["ts", "host", "program", "class"]) + ["msg", *INTS, *STRINGS]
    df = lines.select(*[F.nullif(F.get(part, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
    now = F.unix_seconds(F.current_timestamp()) if now is None else now
    ts = F.coalesce(F.col("ts").try_cast("long"), now) if not class_only else now
    program = F.col("program") if not class_only else F.lit("unknown")
    return df.select(F.lit(import_id).cast("long").alias("import_id"), ts.alias("ts"), F.lit(str(import_id)).alias("host"), program.alias("program"), "class", "msg", *INTS, *STRINGS)


def read_preformatted(spark: SparkSession, path: str, import_id: int, class_only: bool = False) -> DataFrame:
    return parse_preformatted(_lines(spark, path), import_id, class_only)


def parse_timeline(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Class LOG2TIMELINE of a timeline's columns date, time, MACB, sourcetype, user, host, desc, notes."""
    at = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("MM/dd/yyyy HH:mm:ss"))
    host = F.when(F.col("host") == "-", F.lit("127.0.0.1")).otherwise(F.col("host"))
    return df.select(
        F.unix_seconds(F.to_utc_timestamp(at, tz)).alias("ts"), host.alias("host"), F.lit("LOG2TIMELINE").alias("class"), F.col("MACB").alias("macb"),
        "sourcetype", "user", F.col("host").alias("hostname"), "desc", "notes",
    )


def read_timeline(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    return parse_timeline(spark.read.csv(path, header=True), tz)


CISCO = r"^(?:[0-9]+:\s+)?(?:[^%]*:\s+)?%([A-Z0-9_]+-[0-9]-[A-Z0-9_]+):\s*(.*)$"
SNARE = r"MSWinEventLog.*?\t(Security|Application|System)\t"


def normalise_message(df: DataFrame) -> DataFrame:
    """Vendor tags moved from msg to program, then `|` as %7C and tabs as `|`."""
    msg = F.col("msg")
    cisco, snare = msg.rlike(CISCO), msg.rlike(SNARE)
    program = F.when(cisco, F.concat(F.lit("%"), F.lower(F.regexp_extract(msg, CISCO, 1)))).when(snare, F.lower(F.regexp_extract(msg, SNARE, 1))).otherwise(F.col("program"))
    text = F.when(cisco, F.regexp_extract(msg, CISCO, 2)).otherwise(msg)
    return df.withColumns({"program": program, "msg": fn.escape_pipes(text)})


UNPARSED = "UNPARSED"


def extract_class_fields(df: DataFrame, patterns: Sequence[dict], unmatched: str = UNPARSED) -> DataFrame:
    """class and fields map from msg by the first matching pattern of the record's program.

    patterns: program (null for any), class, regex, names of its captures. Records that none matches get the class
    `unmatched` and no fields.
    """
    cls, fields = F.lit(unmatched), F.create_map().cast("map<string,string>")
    for p in reversed(list(patterns)):
        hit = F.col("msg").rlike(p["regex"])
        if p.get("program"):
            hit = hit & (F.col("program") == p["program"])
        pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in p["names"]]), F.array(*[F.regexp_extract("msg", p["regex"], i + 1) for i in range(len(p["names"]))]))
        cls, fields = F.when(hit, p["class"]).otherwise(cls), F.when(hit, pairs).otherwise(fields)
    return df.withColumns({"class": cls, "fields": fields})


LIVE = T.StructType([T.StructField("value", T.StringType())])


def stream_logs(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of a growing folder as a stream."""
    return spark.readStream.schema(LIVE).option("maxFilesPerTrigger", files_per_batch).text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: str | None = None, high: str | None = None, parts: int = 8) -> DataFrame:
    """A database table, read in parts by the ranges of a column where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


__all__ = [k for k in dir() if not k.startswith("_")]
