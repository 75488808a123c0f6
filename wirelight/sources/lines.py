"""Text lines with their place in the input, and handling of bad rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelight.functions.columns import any_of, derive, settle
from wirelight.functions.ip import with_ip_keys
from wirelight.functions.values import trim_space
from wirelight.operators.lookup import fits_broadcast, materialise
from wirelight.session import work_dir

ERROR = "_error"
RAW = "_raw"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files: value, source_file, block_start, line_no.

    ``(block_start, line_no)`` orders the lines of one file in one scan; another
    scan may be cut otherwise.  Formats whose lines depend on earlier ones take
    them from a table, see ``land_lines``.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same lines (without ``line_no``) from files as they land in a folder."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start"))


def land_lines(lines: DataFrame, path: str) -> DataFrame:
    """Lines as one scan saw them, written once: value, source_file, block_start, line_no, mark.

    A later read of the table gives each line the place it had in that scan, however
    the files would be cut next time.  ``#`` lines (``mark``) lie in a folder of
    their own, so that reading them alone doesn't touch the data.  A batch of
    ``stream_lines`` will do as well; it is read here for the first and last time.
    """
    spark = lines.sparkSession
    if "line_no" not in lines.columns:
        lines = lines.withColumn("line_no", F.monotonically_increasing_id())
    marked = lines.select("value", "source_file", "block_start", "line_no", F.coalesce(trim_space("value").startswith("#"), F.lit(False)).alias("mark"))
    marked.write.mode("overwrite").option("compression", "zstd").partitionBy("mark").parquet(path)
    return spark.read.schema(marked.schema).parquet(path)


def read_landed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return land_lines(read_lines(spark, path), work_dir(spark, "lines"))


def number_lines(landed: DataFrame) -> DataFrame:
    """The table with ``line_no`` as the line's number in its file, from 1 on, and ``block_start`` 0.

    A block's lines are numbered without gaps, so the counts of the blocks before,
    one small row per block, are all that is looked up.
    """
    blocks = landed.groupBy("source_file", "block_start").agg(F.min("line_no").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source_file", "block_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    offsets = materialise(offsets, "blocks")
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    return landed.join(offsets, ["source_file", "block_start"]).withColumns(
        {"line_no": F.col("line_no") + F.col("_offset"), "block_start": F.lit(0).cast("bigint")}
    ).select(*landed.columns)


def finish(rows: DataFrame, ips: dict[str, str], error: Column, on_error: str) -> DataFrame:
    """Shared last step of every line format.

    ``ips`` maps a wire name (``srcIP``) to the column with its raw text; each one
    also gets a key column (``srcKey``).  ``error`` is the message of a malformed
    row or NULL.  ``on_error``: ``fail`` stops the job at the first malformed row,
    ``skip`` leaves it out, ``keep`` adds it with its message in ``_error``.
    """
    keys = {name.removesuffix("IP") + "Key": raw for name, raw in ips.items()}
    canonical = {name.removesuffix("IP") + "Key": name for name in ips}
    rows = with_ip_keys(settle(rows), keys, canonical).withColumn(ERROR, error)
    return route(rows.drop(*ips.values()), on_error)


@dataclass(frozen=True)
class Shape:
    """One event type's columns in terms of a format's parsed row.

    ``keep`` says which rows hold such an event (None: all); ``ips`` are the raw
    texts of its addresses by wire name; ``problem`` is what is wrong with a row.
    """

    columns: Mapping[str, Column]
    ips: Mapping[str, Column]
    problem: Column
    keep: Column | None = None


def one_type(rows: DataFrame, shape: Shape, raw: Column, on_error: str) -> DataFrame:
    """Rows of a single event type; ``rows`` has ``source_file``."""
    kept = rows if shape.keep is None else rows.where(shape.keep)
    texts = {name: f"_{name}" for name in shape.ips}
    picked = kept.select(
        *[expr.alias(name) for name, expr in shape.columns.items()], *[shape.ips[n].alias(t) for n, t in texts.items()],
        "source_file", raw.alias(RAW), shape.problem.alias("_problem"))
    return finish(picked, texts, F.col("_problem"), on_error).drop("_problem")


def all_types(rows: DataFrame, shapes: Mapping[str, Shape], raw: Column, on_error: str) -> DataFrame:
    """Rows of several event types from one pass: ``event_type`` and the columns of all of them.

    Each parsed row becomes an array of its events, which is taken apart once; what
    an event's type does not have is NULL.  A row that is malformed in two types
    counts in both.  An address that several types share is worked out once a row,
    before the row becomes several.
    """
    # types share an address where their shapes hold the same column object
    ids = {id(c): f"_address_{i}" for i, c in enumerate({id(c): c for s in shapes.values() for c in s.ips.values()}.values())}
    texts = {ids[id(c)]: c for s in shapes.values() for c in s.ips.values()}
    keeps = [s.keep for s in shapes.values()]
    if all(keep is not None for keep in keeps):  # a row without events has no address to work out
        texts = {name: F.when(any_of(keeps), c) for name, c in texts.items()}
    rows = with_ip_keys(rows, {f"{name}_key": c for name, c in texts.items()}, {f"{name}_key": f"{name}_text" for name in texts}, derive)
    exprs = {}
    for kind, s in shapes.items():
        keys = {name.removesuffix("IP") + "Key": F.col(f"{ids[id(c)]}_key") for name, c in s.ips.items()}
        shown = {name: F.col(f"{ids[id(c)]}_text") for name, c in s.ips.items()}
        exprs[kind] = {**s.columns, "_problem": s.problem, **keys, **shown}
    types = {name: kind for found in exprs.values() for name, kind in rows.select(*[c.alias(n) for n, c in found.items()]).dtypes}
    last = [n for s in shapes.values() for name in s.ips for n in (name.removesuffix("IP") + "Key", name)]
    last = sorted(dict.fromkeys(last), key=lambda n: not n.endswith("Key"))

    def event(kind: str) -> Column:
        fields = [exprs[kind].get(name, F.lit(None)).cast(of).alias(name) for name, of in types.items()]
        record, keep = F.struct(F.lit(kind).alias("event_type"), *fields), shapes[kind].keep
        return record if keep is None else F.when(keep, record)

    # the events are columns first: an array made below the generator would be worked out again by the filter Spark puts there
    kept = ["source_file"] if on_error in ("fail", "skip") else ["source_file", RAW]
    events = {f"_event_{i}": event(kind) for i, kind in enumerate(shapes)}
    picked = rows.select("source_file", raw.alias(RAW), *[e.alias(n) for n, e in events.items()]).select(*kept, F.inline(F.array(*events)))
    found = picked.where(F.col("event_type").isNotNull()).withColumn(ERROR, F.col("_problem"))
    middle = [n for n in types if n not in last and n != "_problem"]
    return route(found.select(*kept, "event_type", *middle, *last, ERROR), on_error)


def route(rows: DataFrame, on_error: str) -> DataFrame:
    """Rows with a message in ``_error`` stop the job, are left out, or stay, see ``finish``."""
    if on_error == "keep":
        return rows
    if on_error == "skip":
        return rows.where(F.col(ERROR).isNull()).drop(ERROR, RAW)
    if on_error != "fail":
        raise ValueError("on_error must be 'fail', 'skip' or 'keep'")
    # a filter stays whatever columns are used later
    fine = F.when(F.col(ERROR).isNotNull(), F.raise_error(F.col(ERROR)).cast("boolean")).otherwise(F.lit(True))
    return rows.where(fine).drop(ERROR, RAW)


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with _raw and _error) of a table read with ``on_error='keep'``."""
    good = rows.where(F.col(ERROR).isNull()).drop(ERROR, RAW)
    kept = [c for c in ("source_file", RAW, ERROR) if c in rows.columns]
    return good, rows.where(F.col(ERROR).isNotNull()).select(*kept)


def first_error(*checks: tuple[Column, str]) -> Column:
    """Message of the first failed check (condition true or NULL-safe), else NULL."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks],
                      F.lit(None).cast("string"))
