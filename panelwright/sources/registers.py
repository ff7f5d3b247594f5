"""Facility-year register files: CSV with two header rows and repeated step blocks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelwright import fixed_values as V
from panelwright.session import ensure_checkpoint_dir
from panelwright.sources.headers import file_heads, opens_directly

BOM = "\ufeff"
CSV_OPTIONS = {"header": "false", "encoding": "UTF-8", "multiLine": "true", "quote": '"', "escape": '"'}


@dataclass(frozen=True)
class RegisterLayout:
    """Shape shared by files with the same two header rows."""

    core: tuple[str, ...]
    block: tuple[str, ...]
    steps: int
    width: int
    paths: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [*self.core, *[f"M{i}_{b}" for i in range(self.steps) for b in self.block]]


def plain_path(c: Column | str) -> Column:
    """File metadata comes percent-encoded; a plus sign in it is a plus sign."""
    c = F.col(c) if isinstance(c, str) else c
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def file_facts(file_name: Column, aliases: Mapping[str, str] = V.FACILITY_ALIASES) -> list[Column]:
    """facility and data_year from a file name; year is null when none is written in it."""
    stem = F.regexp_replace(file_name, r"\.csv$", "")
    year = F.regexp_extract(stem, r"(\d{4})", 1)
    raw = F.trim(F.regexp_replace(F.trim(F.regexp_extract(stem, r"^(.*?)\d{4}", 1)), r"[ \-_]+$", ""))
    lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    facility = F.coalesce(F.try_element_at(lookup, F.lower(raw)), raw)
    return [
        F.when(year != "", facility).alias("facility"),
        year.try_cast("int").alias("data_year"),
    ]


def _source_name(by_folder: bool) -> Column:
    """Name a file is known by: its own, or that of the ``source=`` folder holding its parts."""
    if by_folder:
        return plain_path(F.regexp_extract("_metadata.file_path", r"/source=([^/]+)/", 1))
    return plain_path("_metadata.file_name")


def file_catalog(spark: SparkSession, folder: str, by_folder: bool = False) -> DataFrame:
    """(path, source_file, facility, data_year, head, second) of every CSV file in a folder.

    ``head`` is the text of the two header rows, ``second`` that of the second one. Tasks open
    the files and read a few kilobytes of each, so data is read once, later; a line break in a
    quoted header is part of it. A store that only Spark's readers reach is scanned as text.
    With ``by_folder`` a source is a folder ``source=name`` of part files that each carry the
    two header rows.
    """
    listing = {"pathGlobFilter": "*.csv", "recursiveFileLookup": str(by_folder).lower()}
    if opens_directly(spark, folder):
        heads = file_heads(spark, folder, 2, **listing).select("file_path", "head", "second")
    else:
        heads = _scanned_heads(spark, folder, 2, listing)
    path = F.col("file_path")
    name = F.regexp_extract(path, r"/source=([^/]+)/", 1) if by_folder else F.element_at(F.split(path, "/"), -1)
    head = F.regexp_replace("head", f"^{BOM}", "")
    named = heads.filter("head <> ''").select(path.alias("path"), name.alias("source_file"), head.alias("head"), "second")
    return named.select("path", "source_file", *file_facts(F.col("source_file")), "head", "second")


def _scanned_heads(spark: SparkSession, folder: str, lines: int, listing: Mapping[str, str]) -> DataFrame:
    """(file_path, head, second) from a scan of all lines, of which the first ``lines`` count."""
    files = spark.read.options(**listing).text(folder).select(
        plain_path("_metadata.file_path").alias("file_path"), "_metadata.file_block_start",
        F.col("value"), F.monotonically_increasing_id().alias("_at"),
    ).filter("file_block_start = 0")
    first = files.groupBy("file_path").agg(F.min("_at").alias("_first"))
    head = files.join(first, "file_path").filter(F.col("_at") < F.col("_first") + lines).groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_l"))
    return head.select("file_path", F.array_join(F.transform("_l", lambda s: s["value"]), "\n").alias("head"),
                       F.coalesce(F.get("_l", F.lit(1))["value"], F.lit("")).alias("second"))


def parse_head(head: str, first_step: str = V.FIRST_STEP_HEADER) -> tuple[tuple, tuple, int, int]:
    """(core names, block names, steps, width) of the two header rows."""
    rows = list(csv.reader(io.StringIO(head)))
    top = [h.strip() for h in rows[0]]
    sub = [h.strip() for h in rows[1]] if len(rows) > 1 else []
    at = top.index(first_step) if first_step in top else len(top)
    core = tuple(h or f"col_{i}" for i, h in enumerate(top[:at]))
    later = [i for i, h in enumerate(top) if i > at and h]
    size = (later[0] - at) if later else 8
    block = tuple(s for s in sub[at : at + size] if s)
    steps = (len(top) - at) // len(block) if block else 0
    return core, block, steps, len(top)


def layouts(catalog: DataFrame) -> list[RegisterLayout]:
    """One layout per distinct header signature, over files whose name carries a year.

    The driver gets a path and two header lines per file, as much as Spark's own file
    listing keeps there.
    """
    found: dict[tuple, list[str]] = {}
    for row in catalog.filter("data_year is not null").select("path", "head").collect():
        found.setdefault(parse_head(row["head"]), []).append(row["path"])
    return [RegisterLayout(*sig, tuple(sorted(paths))) for sig, paths in sorted(found.items())]


def layout_drift(catalog: DataFrame) -> DataFrame:
    """(signature, files, example): how many files share each second header row."""
    signature = F.sha2("second", 256)
    return catalog.groupBy(signature.alias("signature")).agg(
        F.count(F.lit(1)).alias("files"), F.min("source_file").alias("example")
    )


def rejected_files(catalog: DataFrame) -> DataFrame:
    return catalog.filter("data_year is null").select(
        "source_file", F.lit("no year in file name").alias("reason")
    )


def _all_blank(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.expr(f"nullif(trim(`{c}`), '')") for c in columns]).isNull()


def read_layout(
    spark: SparkSession, layout: RegisterLayout, by_folder: bool = False, multi_line: bool = True
) -> DataFrame:
    """Data rows of the files of one layout, all text, with provenance columns.

    Without ``multi_line`` no cell may hold a line break, and a large file is many tasks.
    """
    raw_names = [f"_c{i}" for i in range(layout.width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in raw_names])
    options = {**CSV_OPTIONS, "multiLine": str(multi_line).lower()}
    raw = spark.read.options(**options).schema(schema).csv(list(layout.paths))
    names = layout.names
    first = F.regexp_replace(F.coalesce(F.trim("_c0"), F.lit("")), f"^{BOM}", "")
    header = (first == (layout.core[0] if not layout.core[0].startswith("col_") else ""))
    marker = F.lit(True)
    for i, name in enumerate(layout.core[1:4], start=1):
        if not name.startswith("col_"):
            marker = marker & (F.trim(F.col(f"_c{i}")) == name)
    at = len(layout.core)
    second = F.lit(bool(layout.block))
    for i, name in enumerate(layout.block):
        second = second & (F.trim(F.col(f"_c{at + i}")) == name)
    is_header = F.coalesce(header & marker, F.lit(False)) | F.coalesce(second, F.lit(False))
    data = raw.select("*", _source_name(by_folder).alias("source_file")).filter(
        ~is_header & ~_all_blank(raw_names)
    )
    cells = [
        F.expr(f"nullif(trim({raw_names[i]}), '')").alias(name) for i, name in enumerate(names)
    ]
    return data.select(*cells, "source_file", *file_facts(F.col("source_file")))


def land(frames: Iterable[DataFrame], path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Frames of differing columns written as one Parquet table and read back merged.

    CSV is parsed once, later jobs read columns, and a column one frame lacks is absent
    from its files rather than a null column in a plan: unions with dozens of those slow
    the optimiser down. Each call writes into a folder of its own below ``path`` and reads
    only that, so what an earlier run left there never comes back.
    """
    spark, run = None, f"{path}/run-{uuid4().hex}"
    for at, frame in enumerate(frames):
        spark = frame.sparkSession
        frame.write.partitionBy(*partition_by).parquet(f"{run}/layout={at}")
    if spark is None:
        raise FileNotFoundError(f"nothing to land in {path}")
    return spark.read.option("mergeSchema", "true").parquet(run).drop("layout")


def _landing(spark: SparkSession, landing: str | None) -> str:
    return landing or f"{ensure_checkpoint_dir(spark)}/landing-{uuid4().hex}"


def read_registers(
    spark: SparkSession, folder: str, landing: str | None = None, by_folder: bool = False, multi_line: bool = True
) -> DataFrame:
    """All register files of a folder as one wide table of text columns.

    The table is landed as Parquet by year under ``landing``, or in the session's shared
    checkpoint folder.
    """
    found = layouts(file_catalog(spark, folder, by_folder))
    frames = (read_layout(spark, layout, by_folder, multi_line) for layout in found)
    return land(frames, _landing(spark, landing), ["data_year"])


def read_yearly(
    spark: SparkSession,
    folder: str,
    sentinel: str = "No Data",
    header_column: str | None = None,
    landing: str | None = None,
    by_folder: bool = False,
) -> DataFrame:
    """Yearly CSV files named ``..._{year}.csv``: trimmed names, sentinel to null, a ``year``
    column, and header rows repeated among the data removed.

    With ``by_folder`` a year is a folder ``year=2015`` of part files with a header each.
    """
    glob = "*.csv" if by_folder else "*_[0-9][0-9][0-9][0-9].csv"
    year_in_path = r"/year=(\d{4})/" if by_folder else r"_(\d{4})\.csv$"
    listing = {"pathGlobFilter": glob, "recursiveFileLookup": str(by_folder).lower()}
    if opens_directly(spark, folder):
        first = file_heads(spark, folder, 1, **listing).filter("head <> ''").select("file_path", "head")
    else:
        first = _scanned_heads(spark, folder, 1, listing)
    groups: dict[str, list[str]] = {}
    for row in first.collect():
        groups.setdefault(row["head"].lstrip(BOM), []).append(row["file_path"])

    def frame(head: str, paths: list[str]) -> DataFrame:
        names = [n.strip() for n in next(csv.reader([head]))]
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        options = {**CSV_OPTIONS, "header": "true", "enforceSchema": "true"}
        raw = spark.read.options(**options).schema(schema).csv(sorted(paths))
        cells = [
            F.when(F.trim(f"_c{i}") != sentinel, F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)
        ]
        year = F.regexp_extract("_metadata.file_path", year_in_path, 1).cast("int")
        data = raw.select(*cells, year.alias("year"))
        return drop_repeated_headers(data, header_column) if header_column in names else data

    frames = (frame(head, paths) for head, paths in sorted(groups.items()))
    return land(frames, _landing(spark, landing))


def drop_repeated_headers(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value equals the column's own name are stray headers; nulls stay."""
    return df.filter(F.coalesce(F.trim(F.col(f"`{column}`")) != column, F.lit(True)))
