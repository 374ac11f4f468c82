"""Raw log text: scan with physical line numbers, parse, write back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.functions import text
from logwarden.session import settle

MAX_BROADCAST_SPLITS = 1_000_000

PARSED_COLUMNS = (
    "line_number",
    "timestamp",
    "host",
    "process",
    "pid",
    "message",
    "raw",
    "user",
    "source_ip",
    "template",
)


def read_lines(spark: SparkSession, path: str, across_files: bool = False) -> DataFrame:
    """Lines of one or many files as ``(path, line_number, value)``.

    Within a file split the reader keeps the order of lines, so a line is placed
    by (file, start of split, order inside the split). Rows are settled before
    they are numbered: split borders depend on the cores present at planning
    time and must be the same for counting and for numbering. Numbers restart
    with every file unless ``across_files`` joins the files in name order.
    """
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        F.regexp_replace("value", r"\x{fffd}", "").alias("value"),
    )
    rows = settle(scan)
    splits = rows.groupBy("path", "_split").agg(F.count("*").alias("_size"), F.min("_at").alias("_head"))
    inside = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_size").over(inside), F.lit(0))
    if across_files:
        files = rows.groupBy("path").agg(F.count("*").alias("_lines"))
        earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
        bases = files.select("path", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_base"))
        splits, offset = splits.join(bases, "path"), offset + F.col("_base")
    file = F.xxhash64("path").alias("_file")
    heads = settle(splits.select(file, "_split", "_head", offset.alias("_offset")))
    # four numbers per file split: a checked broadcast up to a million splits, so the log is not moved
    if heads.count() <= MAX_BROADCAST_SPLITS:
        heads = F.broadcast(heads)
    return rows.withColumn("_file", file).join(heads, ["_file", "_split"]).select(
        "path", (F.col("_offset") + F.col("_at") - F.col("_head") + 1).alias("line_number"), "value"
    )


def parse_lines(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Structured events; lines of another format are dropped, bad dates kept as null."""
    year_col = F.year(F.current_date()) if year is None else F.lit(year)
    kept = [c for c in lines.columns if c not in ("value", "path")]
    headed = (
        lines.select(*kept, text.strip(F.col("value")).alias("raw"))
        # a filter is not pushed below an explode, where it would search every line a second time
        .withColumn("_head", F.explode(F.array(F.regexp_extract("raw", text.LINE_HEAD, 0))))
        .filter(F.col("_head") != "")
        .withColumn("_part", text.words(F.col("_head")))
        .withColumn("message", F.expr("substring(raw, length(_head) + 1)"))
    )
    part = [F.col("_part")[at] for at in range(5)]
    pid = F.substring_index(F.substring_index(part[4], "[", -1), "]", 1)
    event = headed.select(
        *kept,
        text.event_time(part[0], part[1], part[2], year_col).alias("timestamp"),
        part[3].alias("host"),
        F.substring_index(F.substring_index(part[4], "[", 1), ":", 1).alias("process"),
        F.when(part[4].contains("["), pid).alias("pid"),
        "message",
        "raw",
    )
    message = F.col("message")
    return event.select(
        "*", text.user_of(message).alias("user"), text.ip_of(message).alias("source_ip"),
        text.template_of(message).alias("template"),
    )


def is_log_line(value: Column) -> Column:
    """Whether the parser accepts a line."""
    return F.coalesce(text.strip(value).rlike(text.LINE_HEAD), F.lit(False))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines the parser does not accept, for a look at what was dropped."""
    return lines.filter(~is_log_line(F.col("value")))


def format_line(host: str | Column = "server1") -> Column:
    """The log line of a labelled event; an absent or zero pid is left out."""
    host = host if isinstance(host, Column) else F.lit(host)
    pid = F.col("pid").cast("string")
    bracket = F.when(pid.isNull() | pid.isin("", "0"), "").otherwise(F.concat(F.lit("["), pid, F.lit("]")))
    return F.concat(
        syslog_stamp(F.col("ts")), F.lit(" "), host, F.lit(" "),
        F.col("process"), bracket, F.lit(": "), F.col("message"),
    )


def syslog_stamp(ts: Column) -> Column:
    """``Mon DD HH:MM:SS`` of a wall-clock time, whatever the session time zone."""
    months = F.split(F.lit(text.MONTHS.title().strip()), " ")
    two = [F.lpad(part(ts).cast("string"), 2, "0") for part in (F.day, F.hour, F.minute, F.second)]
    return F.concat(
        F.element_at(months, F.month(ts)), F.lit(" "), two[0], F.lit(" "), F.concat_ws(":", *two[1:])
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files that give back the lines in order when read file by file."""
    lines.orderBy("line_number").select("value").write.mode("overwrite").text(path)
