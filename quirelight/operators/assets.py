"""Image references that lead nowhere, and images that nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def resolved(folder: Column, reference: Column) -> Column:
    """The path that a reference in a file of a folder leads to, without ``.`` and ``..``; null if it leads above the root, is empty or is an address.

    Queries and fragments go, percent signs are decoded; a reference that begins with / counts from the root.
    """
    bare = F.regexp_replace(reference, r"[?#].*$", "")
    path = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, F.lit("/"), path))
    step = lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(F.concat(a, F.array(s)))
    out = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    return F.when((bare != "") & ~bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), out)


def references(files: DataFrame, folder: Column) -> DataFrame:
    """file_name, reference, path of the Markdown and HTML images of (file_name, content)."""
    found = F.concat(X.every(F.col("content"), X.MD_IMAGE, 2), X.every(F.col("content"), X.HTML_IMAGE, 1))
    rows = files.select("file_name", folder.alias("folder"), F.explode(found).alias("reference"))
    return rows.select("file_name", "reference", resolved(F.col("folder"), F.col("reference")).alias("path"))


def dangling(found: DataFrame, assets: DataFrame) -> DataFrame:
    """problem, file_name, reference, path: references without a file (missing), out of the root (outside), and files without a reference (unused).

    found: references(); assets: (path).
    """
    files = assets.select("path").distinct()
    none = F.lit(None).cast("string")
    missing = found.where("path is not null").join(files, "path", "left_anti").select(F.lit("missing").alias("problem"), "file_name", "reference", "path")
    outside = found.where("path is null").select(F.lit("outside").alias("problem"), "file_name", "reference", "path")
    unused = files.join(found, "path", "left_anti").select(F.lit("unused").alias("problem"), none.alias("file_name"), none.alias("reference"), "path")
    return missing.unionByName(outside).unionByName(unused)
