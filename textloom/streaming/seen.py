"""Streams: seen-set polling with retry, and event dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

MERGE_REQUEST = (
    "object_kind string, object_attributes struct<action:string,iid:int,note:string,noteable_type:string,discussion_id:string>, "
    "user struct<username:string>, merge_request struct<iid:int>, project struct<id:string,path_with_namespace:string>"
)


def first_seen(stream: DataFrame, keys: list[str], at: str, delay: str = "30 days") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def poll_with_seen_set(stream: DataFrame, key: str, handle: Callable[[DataFrame], DataFrame], seen_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """At-least-once handling of each key: marked as seen only once ``handle`` reports success.

    ``handle`` takes rows of keys not seen yet and returns those it succeeded
    with; the others are kept and offered again with the next batch, whether or
    not their key comes again. The seen-set is a Parquet table of keys; what each
    batch offers lies in ``offered`` beside it, written before it is handled, so
    that what is handled, marked and kept are the same rows. Each batch writes
    folders of its own number over, so a batch that is replayed leaves no row twice.
    """
    folder = seen_path.rstrip("/")

    def earlier(spark: SparkSession, path: str, schema: StructType, number: int) -> DataFrame:
        """Rows of ``path`` that batches before ``number`` wrote; none if there is no table yet."""
        try:
            found = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], StructType([*schema.fields, StructField("batch", LongType())]))
        return found.where(F.col("batch") < number)

    def batch(df: DataFrame, number: int) -> None:
        spark, schema = df.sparkSession, df.schema
        last = earlier(spark, folder + ".offered", schema, number).where(F.col("batch") == number - 1).drop("batch")
        seen = earlier(spark, folder, df.select(key).schema, number).select(key)
        offered = f"{folder}.offered/batch={number}"
        df.unionByName(last).dropDuplicates([key]).join(seen, key, "left_anti").select(*df.columns).write.mode("overwrite").parquet(offered)
        handle(spark.read.schema(schema).parquet(offered)).select(key).distinct().write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dispatch(payload: Column, bot: str) -> tuple[Column, Column]:
    """Route of a webhook payload (JSON text) and the reason if it is ignored."""
    e = F.from_json(payload, MERGE_REQUEST)
    kind, action, note = e["object_kind"], e["object_attributes"]["action"], e["object_attributes"]["note"]
    mention = F.contains(F.lower(F.coalesce(note, F.lit(""))), F.lit("@" + bot.lower()))
    own = F.lower(F.coalesce(e["user"]["username"], F.lit(""))) == bot.lower()
    on_mr = e["object_attributes"]["noteable_type"] == "MergeRequest"
    to = F.when((kind == "merge_request") & action.isin("open", "reopen"), "review").when((kind == "note") & on_mr & mention & ~own, "reply").otherwise("ignored")
    why = (
        F.when(to != "ignored", F.lit(""))
        .when(kind == "merge_request", F.concat(F.lit("action "), F.coalesce(action, F.lit("missing"))))
        .when((kind == "note") & ~F.coalesce(on_mr, F.lit(False)), F.lit("note not on a merge request"))
        .when((kind == "note") & own, F.lit("own note"))
        .when(kind == "note", F.lit("not mentioned"))
        .otherwise(F.concat(F.lit("unhandled kind "), F.coalesce(kind, F.lit("missing"))))
    )
    return to, why


