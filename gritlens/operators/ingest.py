"""Input preparation per repository: safe paths, common root, size limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.functions import paths
from gritlens.plans.skew import running_totals


def safe_files(files: DataFrame) -> DataFrame:
    return files.where(paths.is_safe(F.col("file_path")))


def analysable_files(files: DataFrame) -> DataFrame:
    return files.where(paths.is_analysable(F.col("file_path")))


def fetch_candidates(files: DataFrame) -> DataFrame:
    return files.where(paths.is_fetch_candidate(F.col("file_path")))


def common_roots(files: DataFrame) -> DataFrame:
    """Repositories whose files all lie below one top folder, with that folder."""
    root = F.substring_index("file_path", "/", 1)
    below = F.contains(F.col("file_path"), F.lit("/")) & (root != "")
    return (
        files.groupBy("repo")
        .agg(F.min(root).alias("root"), F.max(root).alias("_last"), F.every(below).alias("_below"))
        .where((F.col("root") == F.col("_last")) & F.col("_below"))
        .select("repo", "root")
    )


def strip_common_root(files: DataFrame) -> DataFrame:
    """Drop the shared top folder; only one row per repository is joined in."""
    joined = files.join(common_roots(files), "repo", "left")
    inner = F.substring(F.col("file_path"), F.length("root") + 2, F.length("file_path"))
    return joined.withColumn(
        "file_path", F.when(F.col("root").isNotNull(), inner).otherwise(F.col("file_path"))
    ).select(*files.columns)


@dataclass(frozen=True)
class Limits:
    """How much of a repository is taken, in path order; ``None`` is no limit."""

    files: int | None = None
    file_size: int | None = None
    total_size: int | None = None
    unit: str = "bytes"         # bytes | characters
    size_first: bool = True     # oversized files do not use up the file count


# The limits of archive upload and of the two fetchers.
ARCHIVE_LIMITS = Limits(files=80, file_size=500 * 1024, total_size=10 * 1024 * 1024)
FETCH_LIMITS = Limits(files=45, file_size=400_000, unit="characters", size_first=False)
OLDER_FETCH_LIMITS = Limits(files=60, file_size=999_999, unit="characters", size_first=False)


def limit_marks(files: DataFrame, limits: Limits) -> DataFrame:
    """Every file with its size, its place and running size in its repository, and whether it fits.

    The running sums see paths and sizes only, never contents.
    """
    measure = F.octet_length("content") if limits.unit == "bytes" else F.length("content")
    size = measure.cast("bigint")
    fits = F.lit(True) if limits.file_size is None else F.col("size") <= limits.file_size
    sizes = files.select("repo", "file_path", size.alias("size")).withColumn("_fits", fits)
    counted = F.col("_fits") if limits.size_first else F.lit(True)
    running = running_totals(
        sizes, ["repo"], ["file_path"],
        {"n_files": counted.cast("int"), "total": F.when(F.col("_fits"), F.col("size")).otherwise(0)},
    )
    kept = F.col("_fits")
    if limits.files is not None:
        kept = kept & (F.col("n_files") <= limits.files)
    if limits.total_size is not None:
        kept = kept & (F.col("total") <= limits.total_size)
    return running.select("repo", "file_path", "size", "n_files", "total", kept.alias("fits"))


def within_limits(files: DataFrame, limits: Limits) -> DataFrame:
    """The files of each repository that stay within ``limits``, for who asks to leave the others out."""
    fitting = limit_marks(files, limits).where("fits").select("repo", "file_path")
    return files.join(fitting, ["repo", "file_path"], "left_semi").select(*files.columns)


def prepare_archive(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Archive entries as scan input: root stripped, unsafe and other files out."""
    ready = analysable_files(strip_common_root(files))
    return ready if limits is None else within_limits(ready, limits)
