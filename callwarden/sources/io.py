"""Sources and sinks."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.constants import MISSING_TOOL
from callwarden.functions.base import is_true
from callwarden.operators.catalog import tool_findings
from callwarden.sources import schemas as S


def _reader(spark: SparkSession, schema: str, path: str, fmt: str, streaming: bool, options: dict | None) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).options(**(options or {})).format(fmt).load(path)


def normalise_calls(calls: DataFrame) -> DataFrame:
    """Name nameless calls, parse arguments, and flag those no rule could be checked on.

    Arguments that are not JSON, repeat a key or are not an object are `quarantined`; policies
    refuse such calls.
    """
    parsed = calls.withColumns(
        {"tool": F.coalesce("tool", F.lit(MISSING_TOOL)), "args_v": F.try_parse_json("arguments")}
    )
    is_object = F.schema_of_variant("args_v").startswith("OBJECT")
    return parsed.withColumn(
        "quarantined", F.col("arguments").isNotNull() & ~is_true(is_object)
    )


def read_calls(
    spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False, options: dict | None = None
) -> DataFrame:
    return normalise_calls(_reader(spark, S.CALLS, path, fmt, streaming, options))


def explode_captures(captures: DataFrame) -> DataFrame:
    t = F.col("t")
    return captures.select("server", "captured_at", F.explode("tools").alias("t")).select(
        "server",
        "captured_at",
        t["name"].alias("name"),
        t["title"].alias("title"),
        t["description"].alias("description"),
        t["inputSchema"].alias("input_schema"),
        t["outputSchema"].alias("output_schema"),
        t["annotations"].alias("annotations"),
    )


def read_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Captures of tool lists, one row per tool; schemas are kept as JSON text."""
    return explode_captures(_reader(spark, S.CAPTURE, path, fmt, False, None))


def explode_results(results: DataFrame) -> DataFrame:
    """One row per content block, then the structured payload as a block of its own kind.

    Text blocks and embedded text resources carry text; other kinds stay as rows without any.
    """
    block = F.col("b")
    blocks = results.select("call_id", F.posexplode("content").alias("block_idx", "b")).select(
        "call_id",
        F.col("block_idx").cast("bigint").alias("block_idx"),
        block["type"].alias("kind"),
        F.when(block["type"] == "text", block["text"]).when(block["type"] == "resource", block["resource"]["text"]).alias("text"),
        F.lit(None).cast("string").alias("structured"),
    )
    payloads = results.where(F.col("structuredContent").isNotNull()).select(
        "call_id",
        F.coalesce(F.size("content"), F.lit(0)).cast("bigint").alias("block_idx"),
        F.lit("structured").alias("kind"),
        F.lit(None).cast("string").alias("text"),
        F.col("structuredContent").alias("structured"),
    )
    return blocks.unionByName(payloads)


def read_results(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return explode_results(_reader(spark, S.RESULT, path, fmt, False, None))


def read_audit(spark: SparkSession, path: str, streaming: bool = False, options: dict | None = None) -> DataFrame:
    return _reader(spark, S.AUDIT, path, "json", streaming, options)


def write_audit(records: DataFrame, path: str) -> None:
    """Append audit records as JSON lines by day, leaving out NULL fields.  Runs an action."""
    records.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("dt").json(path)


def stream_audit(records: DataFrame, path: str, checkpoint: str, **trigger):
    """The same as a streaming sink; the checkpoint keeps rows from being lost or repeated."""
    return (
        records.withColumn("dt", F.to_date("ts"))
        .writeStream.format("json")
        .outputMode("append")
        .partitionBy("dt")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the latest version of a pins table; 0 where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
    return max([0, *(int(n.removeprefix("version=")) for n in names if n.startswith("version="))])


def read_pins(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest version of a pins table, or the one asked for; empty where there is none."""
    version = latest_version(spark, path) if version is None else version
    if version == 0:
        return spark.createDataFrame([], S.PINS)
    return spark.read.schema(S.PINS).parquet(f"{path}/version={version}")


def write_pins(pins: DataFrame, path: str, version: int) -> bool:
    """Write a new version; False, and nothing written, where it exists.  Runs an action.

    The files are written aside and get their name in one step, which fails where another writer was
    first; so a version is whole or absent, and never overwritten.
    """
    spark = pins.sparkSession
    aside, jvm = f"{path}/_aside/{uuid.uuid4().hex}", spark._jvm
    pins.write.parquet(aside)
    source, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}")
    conf = spark._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(conf).getUri(), conf)
    refuse_to_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, target, refuse_to_replace)
    except Py4JJavaError as error:
        context.delete(source, True)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def scan_report_json(findings: DataFrame, catalog: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """One JSON text per tool and capture with its findings nested: (server, name, captured_at, report).

    A tool's findings are few; tools stay rows, so that a server of any size is written by many
    tasks.  With `servers`, each one that could not be reached has a row without a name.
    """
    keys = ["server", "name", "captured_at"]
    nested = findings.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("check", "names", "where", "advisory"))).alias("findings")
    )
    none = F.array().cast("array<struct<check:string,names:array<string>,where:array<string>,advisory:boolean>>")
    captured = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured")
    tools = (
        catalog.select(*keys).distinct().join(nested, keys, "left")
        .select(*keys, F.to_json(F.struct("server", "name", captured, F.coalesce("findings", none).alias("findings"))).alias("report"))
    )
    if servers is None:
        return tools
    unavailable = servers.where(~is_true(F.col("reachable"))).select(
        "server", F.lit(None).cast("string").alias("name"), F.lit(None).cast("timestamp").alias("captured_at"),
        F.to_json(F.struct("server", F.lit(True).alias("unavailable"), is_true(F.col("optional")).alias("optional"))).alias("report"),
    )
    return tools.unionByName(unavailable)


def write_scan_report(catalog: DataFrame, path: str, servers: DataFrame | None = None) -> None:
    """Scan a catalog and write the nested report by server.  Runs an action."""
    report = scan_report_json(tool_findings(catalog), catalog, servers)
    report.select("server", "report").write.mode("errorifexists").partitionBy("server").text(path)
