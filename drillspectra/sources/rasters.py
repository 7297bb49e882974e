"""Headers and spectral text files to rows, as column expressions; ``cubes`` reads the flat data files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# raster data type codes (fixed values)
DATA_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def header_map(text: Column) -> Column:
    """``key = value`` pairs, values in braces may span lines."""
    pattern = r"(?m)^[ \t]*([^=\n{}]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)"
    keys = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda k: F.lower(F.trim(k)))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.trim(x))
    entries = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
    # the last of repeated keys wins
    return F.aggregate(entries, F.create_map().cast("map<string,string>"),
                       lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def number_list(value: Column) -> Column:
    inner = F.regexp_replace(value, r"[{}\s]", "")
    return F.transform(F.filter(F.split(inner, ","), lambda x: x != ""), lambda x: x.try_cast("double"))


def text_list(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, r"[{}]", ""), ","), lambda x: F.trim(x))


def read_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, header`` of every header file that matches."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", header_map(F.col("value")).alias("header"))


def ascii_spectrum(text: Column) -> Column:
    """Two-column text: label and the (wavelength, value) pairs, NULL when unusable."""
    number = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[Ee][+-]?\d+)?"
    pattern = rf"(?m)^\s*({number})\s+({number})\s*$"
    w = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("double"))
    y = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: x.cast("double"))
    label = F.regexp_extract(text, r"(?m)^Column\s+2:\s*(.+?)\s*$", 1)
    rising = F.forall(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.get(w, i) > F.get(w, i - 1))
    return F.when((F.size(w) >= 3) & rising, F.struct(
        F.when(label != "", label).alias("label"), w.alias("wavelengths"), y.alias("values")))


def moved_tie_point(tie_x: Column, tie_y: Column, step_x: Column, step_y: Column, first_sample: Column, first_line: Column) -> Column:
    """Map coordinates of the upper-left pixel of a crop."""
    return F.struct((tie_x + first_sample * step_x).alias("map_x"), (tie_y - first_line * step_y).alias("map_y"))
