"""Which files take part: listing, eligibility, the dictionary beside the data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.operators.ordered import with_position

# File patterns of a scan and words that name a dictionary.
DATA_GLOBS = ("*.csv", "*.CSV", "*.txt")
DICTIONARY_SUFFIXES = ("xlsx", "xls", "xlsm", "csv")
DICTIONARY_HINTS = ("項目名称", "項目名", "名称一覧", "dictionary", "dict", "item_name", "itemname", "columns", "mapping", "定義")


def describe_paths(paths: DataFrame) -> DataFrame:
    """Adds folder, name, stem and suffix to a ``path`` column."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        paths.withColumn("name", name)
        .withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
        .withColumn("stem", F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""))
        .withColumn("suffix", F.lower(F.regexp_extract("name", r".\.([^.]*)$", 1)))
    )


def discover(spark: SparkSession, folder: str, globs: Sequence[str] = DATA_GLOBS) -> DataFrame:
    """Files of a folder that match a pattern: path, length, folder, name, stem, suffix, pos.

    In order of the patterns, then by name. File contents are not read.
    """
    found = spark.read.format("binaryFile").load(folder)
    # the reader passes over empty files, its listing does not
    paths = [unquote(re.sub("^file:/+", "file:/", p)) for p in found.inputFiles()]
    listing = spark.createDataFrame([(p,) for p in paths], "path string").join(found.select("path", "length"), "path", "left")
    listing = describe_paths(listing.fillna(0, ["length"])).where(~F.col("name").startswith("~$"))
    hit = F.lit(None).cast("int")
    for i in reversed(range(len(globs))):
        regex = "^" + globs[i].replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"
        hit = F.when(F.col("name").rlike(regex), i).otherwise(hit)
    return with_position(listing.withColumn("_glob", hit).where("_glob is not null"), ["_glob", "path"], "pos").drop("_glob")


def natural_key(name: str | Column) -> Column:
    """Sort key under which digit runs compare as numbers and text ignores case."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    keyed = F.transform(parts, lambda p: F.when(
        p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+", ""), 40, "0")).otherwise(p))
    # a name that starts with digits has an empty text before them
    return F.when(name.rlike(r"^\d"), F.concat(F.array(F.lit("")), keyed)).otherwise(keyed)


def natural_order(files: DataFrame, name: str = "name") -> DataFrame:
    """Files in natural name order."""
    return files.orderBy(natural_key(name), name)


def eligible(listing: DataFrame, dictionary_path: str | None = None, output_suffix: str = "_cleaned",
             out_dir: str | None = None, limit: int | None = None) -> DataFrame:
    """Adds ``skip_reason``: the dictionary, own outputs, the same data twice; null for input.

    Of files with one stem the first by ``pos`` is kept. ``limit`` keeps the first files only.
    """
    reason = F.lit(None).cast("string")
    if output_suffix:
        reason = F.when(F.col("stem").endswith(output_suffix), "previous output").otherwise(reason)
    if dictionary_path:
        reason = F.when(F.col("path") == dictionary_path, "this is the dictionary").otherwise(reason)
    if out_dir:
        inside = F.col("path").startswith(out_dir.rstrip("/") + "/")
        reason = F.when(inside, "in the output folder").otherwise(reason)
    marked = listing.withColumn("skip_reason", reason)
    first = marked.where("skip_reason is null").groupBy("stem").agg(
        F.min("pos").alias("_first"), F.min_by("name", "pos").alias("_name"))
    twice = F.col("skip_reason").isNull() & (F.col("pos") > F.col("_first"))
    marked = marked.join(first, "stem", "left").withColumn("skip_reason", F.when(
        twice, F.concat(F.lit("same data as "), "_name")).otherwise(F.col("skip_reason"))).drop("_first", "_name")
    if limit:
        kept = marked.where("skip_reason is null").select("pos").orderBy("pos").limit(limit)
        last = kept.agg(F.max("pos")).scalar()
        marked = marked.withColumn("skip_reason", F.when(
            F.col("skip_reason").isNull() & (F.col("pos") > last), "beyond the limit").otherwise(F.col("skip_reason")))
    return marked


def find_dictionary(listing: DataFrame, folders: Sequence[str] = ()) -> DataFrame:
    """The file whose name hints at a dictionary: first folder, then kind of file, then name. One row or none."""
    hinted = F.lit(False)
    for h in DICTIONARY_HINTS:
        hinted = hinted | F.lower("name").contains(h.lower())
    rank = F.lit(None).cast("int")
    for i, s in enumerate(DICTIONARY_SUFFIXES):
        rank = F.when(F.col("suffix") == s, i).otherwise(rank)
    place = F.lit(0)
    for i, f in enumerate(folders):
        place = F.when(F.col("folder") == f, i).otherwise(place)
    found = listing.where(hinted & rank.isNotNull() & ~F.col("name").startswith("~$"))
    best = F.min_by("path", F.struct(place, rank, F.col("path")))
    return found.groupBy().agg(best.alias("path")).where("path is not null")
