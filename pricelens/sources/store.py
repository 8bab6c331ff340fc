"""Snapshots in storage: partitioned tables, their dates, and JSON documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Items of an exported document, at most.
PART_ITEMS = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or the checkpoint folder of the session. Only a session that
    runs in one machine may do without; it gets a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str = "snapshots") -> str:
    """A new folder below the shared one, still to be written; it goes when the application ends."""
    context, top = spark.sparkContext, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(top)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{top}/rows"


def lineage_cut(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back from it, so that a lost executor costs no recomputation."""
    shared_root(rows.sparkSession)
    return rows.checkpoint(eager=True)


def write_snapshots(rows: DataFrame, folder: str, day: str = "snapshot_date") -> None:
    """Writes the snapshots that rows hold; those of the same days are replaced, others stay. Rows are dealt by day and a
    salt, so that a large day is several files and a small one few."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != day]), F.lit(8))
    dealt = rows.repartition(day, salt)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def latest(rows: DataFrame, day: str = "snapshot_date") -> DataFrame:
    return _of_day(rows, rows.agg(F.max(day).alias("_day")), day)


def manifest(rows: DataFrame, day: str = "snapshot_date") -> DataFrame:
    """The dates that there are, newest first."""
    return rows.select(day).distinct().orderBy(F.col(day).desc())


def previous_snapshot(rows: DataFrame, before: str, day: str = "snapshot_date") -> DataFrame:
    """The rows of the newest snapshot strictly before a date, whatever the gap; none if there is none."""
    return _of_day(rows, rows.where(F.col(day) < F.lit(before).cast("date")).agg(F.max(day).alias("_day")), day)


def _of_day(rows: DataFrame, one: DataFrame, day: str) -> DataFrame:
    return rows.join(F.broadcast(one), F.col(day) == F.col("_day"), "left_semi")


def export_json(rows: DataFrame, folder: str, day: str = "snapshot_date", per_part: int = PART_ITEMS) -> None:
    """JSON documents {date, models: [...]} of a day's items, a stated number of items to each at most, by model_id."""
    docs, _ = _parts(rows, "models", day, ["model_id"], per_part)
    docs.select(F.to_json(F.struct(F.col(day).cast("string").alias("date"), "models")).alias("value")).write.text(folder)


def _parts(rows: DataFrame, name: str, day: str, order: list[str], per_part: int) -> tuple[DataFrame, DataFrame]:
    """(day, part, name): a day's rows as arrays of at most per_part structs, numbered in sorted ranges. Rows that agree in
    order are told apart by a hash of their columns. And (day, n): how many rows a day has, of the written ranges."""
    from pricelens.operators import ranges

    tied = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    placed = ranges.numbered(tied, [day], [*order, "_tie"], "_place")
    held = placed.groupBy(day).agg(F.max("_place").alias("n"))
    item = F.struct("_place", F.struct(*[c for c in rows.columns if c != day]).alias("x"))
    parts = placed.groupBy(day, F.floor((F.col("_place") - 1) / per_part).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    return parts.select(day, "part", F.transform("_all", lambda i: i["x"]).alias(name)), held


def export_documents(models: DataFrame, lists: dict[str, DataFrame], events: DataFrame, summary: DataFrame, folder: str, day: str = "snapshot_date", per_part: int = PART_ITEMS) -> None:
    """Snapshots as JSON below a folder. `header` has a document to each day of models: date, total_models, parts (how many
    documents of items and events follow), lists (short ones, by name: leaders, bands, thresholds, the rows of each day) and
    changelog, the summary's columns. `models` and `events` hold documents {date, part, models | events: [...]} of at most
    per_part rows, so that no document grows with its day."""
    shown = F.col(day).cast("string").alias("date")
    held = {}
    for name, rows, order in (("models", models, ["model_id"]), ("events", events, ["kind", "model_id"])):
        parts, held[name] = _parts(rows, name, day, order, per_part)
        parts.select(F.to_json(F.struct(shown, "part", name)).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")
    head, count = (held[c].select(day, F.col("n").alias(f"total_{c}")) for c in ("models", "events"))
    head = head.join(count, day, "left").withColumn("total_events", F.coalesce("total_events", F.lit(0)))
    for name, rows in lists.items():
        listed = rows.groupBy(day).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != day]))).alias(name))
        head = head.join(listed, day, "left")
    changes = summary.select(day, F.struct(*[F.col(c).cast("string").alias(c) if c == "before" else F.col(c) for c in summary.columns if c != day]).alias("changelog"))
    parts = F.struct(*[F.ceil(F.col(f"total_{c}") / per_part).alias(c) for c in ("models", "events")]).alias("parts")
    head = head.join(changes, day, "left").select(shown, "total_models", "total_events", parts, *lists, "changelog")
    head.select(F.to_json(F.struct(*head.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/header")


def read_documents(spark: SparkSession, folder: str, header: str, model: str, event: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, models, events) of exported documents; the schemas are given as DDL, never inferred."""
    kinds = {"header": header, "models": f"date string, part long, models array<struct<{model}>>", "events": f"date string, part long, events array<struct<{event}>>"}
    read = {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in kinds.items()}
    flat = lambda name: read[name].select(F.col("date").try_cast("date").alias("snapshot_date"), F.explode(name).alias("x")).select("snapshot_date", "x.*")
    return read["header"], flat("models"), flat("events")
