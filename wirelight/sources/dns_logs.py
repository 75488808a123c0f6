"""DNS server logs: Microsoft DNS debug log, BIND query log, edge resolver JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight import schemas
from wirelight.functions import values as v
from wirelight.functions.columns import derive_once
from wirelight.functions.times import epoch_ms, msdns_ts
from wirelight.sources.lines import RAW, finish, first_error

# Fixed value: a BIND query line behind a syslog prefix.
NAMED_PATTERN = r"(\d+).*named\[\d+\]: queries: info: client (.*)#\d+.*query: (.*) IN (.*) \+"

def _no_port():
    return F.lit(None).cast("int")


def msdns_dns(
    lines: DataFrame, on_error: str = "fail", layout: str | None = None, zone: str = "UTC"
) -> DataFrame:
    """Received queries of a Microsoft DNS debug log; all other lines are skipped."""
    words = derive_once(lines, {"w": F.split(v.trim_space("value"), r"\s+")})
    at = F.when(F.get("w", F.lit(3)) == "PACKET", 3).when(F.get("w", F.lit(4)) == "PACKET", 4)
    words = derive_once(words.where(F.size("w") >= 15), {"at": at})

    def word(offset: int):
        return F.get("w", F.col("at") + offset)

    rows = words.where(
        (F.size("w") - F.col("at") == 12) & (word(3) == "Rcv") & (word(6) == "Q")
    )
    stamp = F.array_join(F.slice("w", F.lit(1), F.col("at") - 1), " ")
    rows = rows.select(
        msdns_ts(stamp, layout, zone).alias("ts"), _no_port().alias("srcPort"),
        _no_port().alias("destPort"), v.lower_proto(word(2)).alias("proto"),
        v.msdns_name(word(11)).alias("query"), word(10).alias("qtype"), word(4).alias("_src"),
        "source_file", F.col("value").alias(RAW),
    )
    error = first_error((F.col("ts").isNull(), "msdns: unknown time format"))
    return finish(rows, {"srcIP": "_src"}, error, on_error)


def named_dns(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Queries of a BIND query log; other lines are skipped."""
    rows = lines.where(F.col("value").rlike(NAMED_PATTERN)).select(
        "source_file", "value",
        *[F.regexp_extract("value", NAMED_PATTERN, i).alias(f"g{i}") for i in range(1, 5)],
    ).select(
        F.timestamp_seconds(F.col("g1").try_cast("bigint")).alias("ts"),
        _no_port().alias("srcPort"), _no_port().alias("destPort"), F.lit("udp").alias("proto"),
        F.col("g3").alias("query"), F.col("g4").alias("qtype"), F.col("g2").alias("_src"),
        "source_file", F.col("value").alias(RAW),
    )
    error = first_error(
        (F.col("srcKey").isNull(), "named: bad address"), (F.col("ts").isNull(), "named: bad timestamp")
    )
    return finish(rows, {"srcIP": "_src"}, error, on_error)


def read_edge(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of edge resolver files, each one JSON array."""
    return spark.read.schema(schemas.EDGE_RECORD).json(path, multiLine=True, mode="FAILFAST").select(
        "*", F.col("_metadata.file_path").alias("source_file")
    )


def edge_dns(records: DataFrame, on_error: str = "fail") -> DataFrame:
    """Edge resolver records as DNS rows; time and source must be valid."""
    raw = F.to_json(F.struct("time", "source", "query", "queryType", "queryProtocol"))
    rows = records.select(
        epoch_ms("time").alias("ts"), _no_port().alias("srcPort"), _no_port().alias("destPort"),
        v.lower_proto("queryProtocol").alias("proto"), "query", F.col("queryType").alias("qtype"),
        F.col("source").alias("_src"), "source_file", raw.alias(RAW),
    )
    error = first_error(
        (F.col("ts").isNull(), "edge: bad time"), (F.col("srcKey").isNull(), "edge: bad source")
    )
    return finish(rows, {"srcIP": "_src"}, error, on_error)
