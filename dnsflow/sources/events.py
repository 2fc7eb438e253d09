"""JSON-lines event logs: validation, quarantine of bad lines, arrival numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dnsflow.operators.scale import lookup_join, running_totals
from dnsflow.schemas import REQUIRED_FIELDS

MAX_NAME = 255
#: Seconds whose microseconds, plus any interval in use, fit a long: later times would overflow what is added to them.
MAX_TS = 9_000_000_000_000.0
# A character other than white space, as Python's str.strip sees it.
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw log lines with the file they come from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))


_PLACE = ("value", "_metadata.file_name as file_name", "_metadata.file_path as file", "_metadata.file_block_start as block")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw log lines with their file and their line number in it, from 1."""
    return number_lines(spark.read.text(path).selectExpr(*_PLACE))


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of arriving files with the split that holds them; ``number_lines`` numbers those of a micro-batch."""
    return spark.readStream.options(**options).text(path).selectExpr(*_PLACE)


def number_lines(lines: DataFrame) -> DataFrame:
    """Replace ``block``, where the split of a line begins in its file, by ``line``, its number in the file, blank lines counted.

    A task reads its splits one after the other, so rows of a split are numbered in a row; the numbers of lines of the splits before it in
    the file are added. Those are one row a split, counted by a reading of its own.
    """
    read = lines.withColumn("_row", F.monotonically_increasing_id())
    splits = read.groupBy("file", "block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return lookup_join(read, starts, ["file", "block"], "inner", spread=["_row"]).select(
        *[c for c in lines.columns if c != "block"], (F.col("_row") + F.col("_start")).alias("line"))


_FIELDS = (*REQUIRED_FIELDS, "nxdomain", "seq")


def _kind(name: str) -> Column:
    """Python's name of a JSON value's type; null where the field is absent."""
    schema = F.col(f"s_{name}")
    return (
        F.when(schema == "STRING", "str").when(schema == "BIGINT", "int").when(schema == "BOOLEAN", "bool")
        .when(schema == "VOID", "NoneType").when(schema.startswith("OBJECT"), "dict")
        .when(schema.startswith("ARRAY"), "list").when(schema.isNotNull(), "float"))


def _as(name: str, type_: str) -> Column:
    return F.expr(f"try_cast(f_{name} as {type_})")


def check_events(lines: DataFrame) -> DataFrame:
    """Parse non-blank lines; ``reason`` is null for valid events and the first failure otherwise.

    Types are those of the raw JSON value, so ``"12"`` is not a number and ``true`` is neither.
    Every field is extracted, typed and cast once, in steps that the checks then share.
    """
    names = ("event", *_FIELDS)
    text, number = ("src_ip", "domain", "qtype"), ("ts", "length")
    parsed = lines.where(F.col("value").rlike(_VISIBLE)).withColumn("f_event", F.expr("try_parse_json(value)"))
    parts = parsed.withColumns({f"f_{n}": F.expr(f"try_variant_get(f_event, '$.{n}', 'variant')") for n in _FIELDS})
    typed = parts.withColumns({
        **{f"s_{n}": F.schema_of_variant(f"f_{n}") for n in names},
        **{f"v_{n}": _as(n, "string") for n in text}, **{f"v_{n}": _as(n, "double") for n in number},
        "v_nxdomain": _as("nxdomain", "boolean"), "event_seq": _as("seq", "long")})
    kinds = typed.withColumns({
        **{f"k_{n}": _kind(n) for n in names}, "n_domain": F.char_length("v_domain"),
        **{f"seen_{n}": F.coalesce(F.col(f"v_{n}").rlike(_VISIBLE), F.lit(False)) for n in ("src_ip", "domain")}})
    missing = F.array_join(F.array_compact(F.array(
        *[F.when(F.col(f"f_{n}").isNull(), n) for n in REQUIRED_FIELDS])), ", ")
    any_missing = F.lit(False)
    for n in REQUIRED_FIELDS:
        any_missing = any_missing | F.col(f"f_{n}").isNull()
    kind, value = (lambda n: F.col(f"k_{n}")), (lambda n: F.col(f"v_{n}"))
    shown = lambda n: F.to_json(f"f_{n}")
    checks = [
        (F.col("f_event").isNull(), F.lit("invalid JSON")),
        (kind("event") != "dict", F.concat(F.lit("event is not a JSON object: "), kind("event"))),
        (any_missing, F.concat(F.lit("missing required field(s): "), missing)),
        (~kind("ts").isin("int", "float"), F.concat(F.lit("ts must be a number, got "), kind("ts"))),
        (value("ts") < 0, F.concat(F.lit("ts must be non-negative, got "), shown("ts"))),
        (F.isnan(value("ts")) | (value("ts") > MAX_TS), F.concat(F.lit("ts is out of range, got "), shown("ts"))),
        ((kind("src_ip") != "str") | ~F.col("seen_src_ip"),
         F.concat(F.lit("src_ip must be a non-empty string, got "), shown("src_ip"))),
        ((kind("domain") != "str") | ~F.col("seen_domain"),
         F.concat(F.lit("domain must be a non-empty string, got "), shown("domain"))),
        (F.col("n_domain") > MAX_NAME, F.concat(
            F.lit("domain exceeds max DNS name length: "), F.col("n_domain"), F.lit(" chars"))),
        ((kind("qtype") != "str") | (value("qtype") == ""),
         F.concat(F.lit("qtype must be a non-empty string, got "), shown("qtype"))),
        (~kind("length").isin("int", "float") | (value("length") < 0),
         F.concat(F.lit("length must be a non-negative number, got "), shown("length"))),
        (F.col("f_nxdomain").isNotNull() & (kind("nxdomain") != "bool"),
         F.concat(F.lit("nxdomain must be a boolean if present, got "), shown("nxdomain"))),
    ]
    reason = F.lit(None).cast("string")
    for failed, text_ in reversed(checks):
        reason = F.when(failed, text_).otherwise(reason)
    # Generated, so that a filter on it stays above and does not repeat all the parsing.
    reason = F.explode(F.array(reason))
    return kinds.select(
        *lines.columns, *[value(n).alias(n) for n in (*REQUIRED_FIELDS,)],
        F.coalesce(value("nxdomain"), F.lit(False)).alias("nxdomain"), "event_seq", reason.alias("reason"))


def accepted(checked: DataFrame) -> DataFrame:
    """Clean events; ``ts_us`` never crosses a bucket edge that ``ts`` has not reached."""
    kept = checked.where(F.col("reason").isNull())
    seq = F.col("seq") if "seq" in checked.columns else F.col("event_seq")
    return kept.select(
        seq.cast("long").alias("seq"), "ts", "src_ip", "domain", "qtype", "length", "nxdomain",
        F.floor(F.col("ts") * 1_000_000).cast("long").alias("ts_us"), *[c for c in ("file", "line") if c in checked.columns])


def valid(events: DataFrame) -> Column:
    """Whether typed event columns obey the rules that ``check_events`` applies to lines."""
    seen = lambda n: F.col(n).rlike(_VISIBLE)
    rules = (
        (F.col("ts") >= 0) & (F.col("ts") <= MAX_TS) & seen("src_ip") & seen("domain") & (F.char_length("domain") <= MAX_NAME)
        & (F.col("qtype") != "") & (F.col("length") >= 0))
    return F.coalesce(rules & ~F.isnan("ts") & ~F.isnan("length"), F.lit(False))


def rejected(checked: DataFrame) -> DataFrame:
    extra = [c for c in ("seq", "file_name", "line") if c in checked.columns]
    return checked.where(F.col("reason").isNotNull()).select(*extra, F.col("value").alias("raw"), "reason")


def with_arrival_number(events: DataFrame) -> DataFrame:
    """Dense ``seq`` in time order for logs without arrival numbers; ties follow file and line, or else the read order."""
    place = [c for c in ("file", "line") if c in events.columns]
    numbered = events.drop("seq").withColumn("_row", F.monotonically_increasing_id()).withColumn("_one", F.lit(1))
    return running_totals(numbered, ["ts_us", *place, "_row"], {"seq": "_one"}).select(*[c for c in events.columns if c not in place])
