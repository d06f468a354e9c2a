"""Log lines to typed columns. Every line is kept; parse_status tells what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.schemas import LOG_TYPES

# The form of a time stamp and of what stands before a line's message.
STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
_MARK = "\x00"
PREFIX = rf"\A\[({STAMP})\]\s+\S+\.([A-Z]+):\s*([^\n]*)\n?\z"


def fallback_timestamp(line: Column) -> Column:
    """The first bracketed time stamp anywhere in a line, or ''."""
    return F.regexp_extract(line, rf"\[({STAMP})\]", 1)


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row. As plain columns they would be put in wherever later columns and filters name
    them, and a match or a payload be read dozens of times a line; no filter is moved below a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_log_lines(lines: DataFrame, log_type: str, line_col: str = "raw_line") -> DataFrame:
    """Add timestamp, log_level, the type's payload fields and parse_status; values that don't apply are ''.

    A payload with text behind its object is invalid_json, as is one that isn't an object. Of a key that stands
    twice the last value counts.
    """
    messages, keys = LOG_TYPES[log_type]
    line = F.coalesce(F.col(line_col), F.lit(""))
    # one match a line: its three parts, each behind a mark; a line that fits begins with a bracket and then doesn't
    marked = F.regexp_replace(line, PREFIX, f"{_MARK}$1{_MARK}$2{_MARK}$3")
    split = step(lines, _parts=F.split(marked, _MARK, 4), _open=F.startswith(line, F.lit("[")))
    good_prefix = F.col("_open") & (F.size("_parts") == 4) & (F.get("_parts", F.lit(0)) == "")
    told = step(split, _good=good_prefix, _message=F.when(good_prefix, F.trim(F.get("_parts", F.lit(3)))).otherwise(""))
    brace = F.instr("_message", "{")
    payload = F.substr("_message", brace)
    read = step(told, _brace=brace, _payload=payload, _fields=F.from_json(F.when(brace > 0, payload), "map<string,string>", {"allowSingleQuotes": "false"}))
    read = step(read, _keys=F.reverse(F.map_keys("_fields")), _values=F.reverse(F.map_values("_fields")))  # a key's last value is its first here

    before = F.trim(F.substring_index("_message", "{", 1))
    whole = F.col("_payload").rlike(r"\}\s*\z")
    has_all = F.lit(True)
    for k in keys:
        has_all = has_all & F.array_contains("_keys", k)
    status = (
        F.when(~F.col("_good") | (F.col("_brace") <= 0), "malformed_line")
        .when(~before.isin(*messages), "unexpected_message")
        .when(F.col("_fields").isNull() | ~whole, "invalid_json")
        .when(~has_all, "missing_fields")
        .otherwise("ok")
    )
    stamp = F.when(F.col("_good"), F.get("_parts", F.lit(1))).otherwise(fallback_timestamp(line))
    level = F.when(F.col("_good"), F.get("_parts", F.lit(2))).otherwise("")
    out = step(read, parse_status=status)

    def value(key: str) -> Column:
        last = F.get("_values", (F.array_position("_keys", key) - 1).cast("int"))
        return F.when(F.col("parse_status") == "ok", F.coalesce(last, F.lit(""))).otherwise("")

    return out.withColumns({"timestamp": stamp, "log_level": level, **{k: value(k) for k in keys}}).drop("_fields", "_keys", "_values", "_payload", "_brace", "_parts", "_open", "_good", "_message")


def parse_summary(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per log_type: ok and other rows; with ``files`` (log_type, file_name) also how many files there are, empty ones too."""
    counts = parsed.groupBy("log_type").agg(
        F.count_if(F.col("parse_status") == "ok").alias("ok_rows"), F.count_if(F.col("parse_status") != "ok").alias("bad_rows")
    )
    if files is None:
        return counts
    per_type = files.groupBy("log_type").agg(F.countDistinct("file_name").alias("files"))
    return per_type.join(counts, "log_type", "left").na.fill(0, ["ok_rows", "bad_rows"])
