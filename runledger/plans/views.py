"""The library's tables as views over the driver's test tables (see FIXTURES.md).

Money is whole cents, so every sum is exact in any order.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ids, times as T
from ..functions.naming import PIG_KEY, PIG_RUN_KEY, CASCADING_FLOW_KEY, PIG_SIGNATURE_KEY, SCALDING_SIGNATURE_KEY
from ..operators import apps, events as E, storage
from ..session import tune


class Views:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    def dealt(self, name: str, *keys: str) -> DataFrame:
        """A table dealt out by its row key, for work that costs far more than its rows weigh, such as
        rendering and parsing logs."""
        return self.table(name).repartition(*keys)

    def stream(self, name: str) -> DataFrame:
        """A table as a file stream."""
        # the bracket makes the path a pattern, which lets it be one file as well as a folder
        path = os.path.join(self.dir, f"{name}.parque[t]")
        return self.spark.readStream.schema(self.table(name).schema).parquet(path)

    # --- jobs -------------------------------------------------------------------------------

    def _orders(self, orders: DataFrame | None = None) -> DataFrame:
        """Orders with the key columns of a job; ``orders`` may be a stream of the table."""
        places = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", "c_mktsegment", "n_name", "r_name")
        )
        orders = self.table("orders") if orders is None else orders
        return orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("r_name").alias("cluster"),
            F.col("c_mktsegment").alias("user_name"),
            F.col("o_orderpriority").alias("app_id"),
            T.millis(F.date_trunc("quarter", "o_orderdate")).alias("run_id"),
            F.lit(1).cast("bigint").alias("job_epoch"),
            F.col("o_orderkey").alias("job_seq"),
            ids.job_id_string(F.lit(1), F.col("o_orderkey")).alias("job_id"),
            F.col("o_orderstatus").alias("job_status"),
            F.col("o_orderstatus").alias("version"),
            F.col("n_name").alias("queue"),
            F.lit("ONE").alias("history_version"),
            T.millis(F.col("o_orderdate")).alias("submit_time"),
            F.col("o_orderkey"),
            F.col("o_custkey"),
            cents(F.col("o_totalprice")).alias("total_cents"),
        )

    def _measures(self) -> DataFrame:
        """Task measures per order: sums of longs only, so map tasks combine them by hash."""
        price, qty = cents(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint")
        maps = F.col("l_returnflag") != "R"

        def total(value: Column, when: Column | None = None) -> Column:
            return F.sum(value if when is None else F.when(when, value).otherwise(0))

        one = F.lit(1).cast("bigint")
        return self.table("lineitem").groupBy("l_orderkey").agg(
            total(one, maps).alias("total_maps"),
            total(one, ~maps).alias("total_reduces"),
            total(one, maps & (F.col("l_linestatus") == "F")).alias("finished_maps"),
            total(one, ~maps & (F.col("l_linestatus") == "F")).alias("finished_reduces"),
            total(one, maps & (F.col("l_linestatus") == "O")).alias("failed_maps"),
            total(one, ~maps & (F.col("l_linestatus") == "O")).alias("failed_reduces"),
            total(qty).alias("hdfs_bytes_read"),
            total(cents(F.col("l_discount"))).alias("hdfs_bytes_written"),
            total(F.col("l_linenumber").cast("bigint"), ~maps).alias("reduce_shuffle_bytes"),
            total(qty, maps).alias("map_file_bytes_read"),
            total(cents(F.col("l_tax")), maps).alias("map_file_bytes_written"),
            total(qty, ~maps).alias("reduce_file_bytes_read"),
            total(price, maps).alias("map_slot_millis"),
            total(price, ~maps).alias("reduce_slot_millis"),
            T.millis(F.min("l_shipdate")).alias("launch_time"),
            T.millis(F.max("l_shipdate")).alias("finish_time"),
        )

    def job_history(self, orders: DataFrame | None = None) -> DataFrame:
        measures = self._measures()
        names = [c for c in measures.columns if c != "l_orderkey"]
        jobs = self._orders(orders).join(measures, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        zero = F.lit(0).cast("bigint")
        jobs = jobs.withColumns({c: F.coalesce(c, zero) for c in names})
        mb = F.col("map_slot_millis") * 2 + F.col("reduce_slot_millis") * 3
        return jobs.withColumns(
            {
                "mb_millis": mb,
                # whole numbers, so sums of doubles are exact too
                "cost": (F.col("map_slot_millis") + F.col("reduce_slot_millis")).cast("double"),
                "framework": framework_name(F.col("user_name")),
            }
        ).drop("o_orderkey", "l_orderkey", "o_custkey")

    def job_history_task(self) -> DataFrame:
        number = F.col("l_orderkey")
        return self.table("lineitem").join(
            self._orders().select("cluster", "user_name", "app_id", "run_id", "job_epoch", "job_seq", "job_id"),
            number == F.col("job_seq"),
        ).select(
            "cluster", "user_name", "app_id", "run_id", "job_epoch", "job_seq", "job_id",
            *task_columns(),
        )

    def tasks_only(self, rows: DataFrame | None = None) -> DataFrame:
        """Task rows keyed by job id alone, straight from the scan."""
        return (self.table("lineitem") if rows is None else rows).select(
            F.lit(1).cast("bigint").alias("job_epoch"),
            F.col("l_orderkey").alias("job_seq"),
            ids.job_id_string(F.lit(1), F.col("l_orderkey")).alias("job_id"),
            *task_columns(),
        )

    def counters(self) -> DataFrame:
        """(order, group, name, value) counters."""
        return self.table("lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("value")
        )

    def jobs_with_counters(self) -> DataFrame:
        """Jobs with nested counter maps; a job has at most six counters per kind."""
        cells = self.counters()
        flags, states = ["A", "N", "R"], ["F", "O"]

        def nested(keep: list[str]) -> Column:
            def inner(flag: str) -> Column:
                cell = [
                    F.struct(F.lit(s).alias("key"), F.max(
                        F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == s), F.col("value"))
                    ).alias("value"))
                    for s in states
                ]
                return F.map_from_entries(F.filter(F.array(*cell), lambda c: c["value"].isNotNull()))

            groups = F.array(*[F.struct(F.lit(f).alias("key"), inner(f).alias("value")) for f in keep])
            return F.map_from_entries(F.filter(groups, lambda g: F.size(g["value"]) > 0))

        maps = cells.groupBy("l_orderkey").agg(
            nested(flags).alias("counters"), nested(["A", "N"]).alias("map_counters"),
            nested(["R"]).alias("reduce_counters"),
        )
        return self._orders().join(maps, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")

    def app_version(self) -> DataFrame:
        return apps.versions(self._orders())

    def flow_jobs_conf(self) -> DataFrame:
        """Jobs with a configuration map made from the order columns."""
        jobs = self._orders()
        return jobs.withColumn("conf", F.map_from_entries(F.filter(
            F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in conf_values().items()]),
            lambda p: p["value"].isNotNull(),
        )))

    # --- events, status, storage ----------------------------------------------------------------

    def flow_event(self) -> DataFrame:
        return flow_event_columns(self.table("events"))

    def status_updates(self) -> DataFrame:
        return status_columns(self.table("events"))

    def flow_status(self) -> DataFrame:
        return E.latest_status(self.status_updates())

    def usage_writes(self) -> DataFrame:
        return usage_columns(self.table("events"))

    def hdfs_usage(self) -> DataFrame:
        return storage.newest_cells(self.usage_writes(), ["run_id", "cluster", "path", "namespace"], ["write_ts"])

    # --- files and raw rows -----------------------------------------------------------------------

    def files(self) -> DataFrame:
        half = F.call_function("div", F.col("doc_id"), F.lit(2)).cast("string")
        is_conf = F.col("doc_id") % 2 == 0
        ending = F.when(is_conf, F.lit("_conf.xml")).otherwise(F.lit("_hist"))
        return self.table("documents").select(
            F.col("source").alias("cluster"),
            F.concat(F.col("source"), F.lit("/job_1_"), half, ending).alias("path"),
            F.col("doc_id").alias("mod_time"),
            F.col("n_chars").alias("length"),
        )

    def raw_jobs(self) -> DataFrame:
        """Raw rows: one half of the documents are confs, the other histories."""
        half = F.call_function("div", F.col("doc_id"), F.lit(2))
        is_conf = F.col("doc_id") % 2 == 0

        def pick(column: str, conf: bool) -> Column:
            return F.max(F.when(is_conf if conf else ~is_conf, F.col(column)))

        return (
            self.table("documents")
            .groupBy(half.alias("job_seq"))
            .agg(
                pick("text", True).cast("binary").alias("conf"), pick("text", False).cast("binary").alias("history"),
                pick("doc_id", True).alias("conf_mod_time"), pick("doc_id", False).alias("history_mod_time"),
                F.max("n_chars").alias("n_chars"),
            )
            .select(
                F.lit("c1").alias("cluster"), ids.job_id_string(F.lit(1), F.col("job_seq")).alias("job_id"),
                F.lit(1).cast("bigint").alias("job_epoch"), "job_seq", "conf", "conf_mod_time", "history", "history_mod_time",
                # every state of the flags occurs
                F.when(F.col("n_chars") % 3 == 0, F.lit(True)).when(F.col("n_chars") % 3 == 1, F.lit(False)).alias("processed_ok"),
                F.when(F.col("n_chars") % 5 == 0, F.lit(True)).when(F.col("n_chars") % 5 == 1, F.lit(False)).alias("reprocess"),
                F.lit(None).cast("bigint").alias("submit_time"),
            )
        )


def cents(amount: Column) -> Column:
    """Whole cents of an amount with two decimals; round() would go through BigDecimal for every row."""
    return F.floor(amount * 100 + 0.5)


def framework_name(user: Column) -> Column:
    return F.when(user == "BUILDING", F.lit("PIG")).when(user == "MACHINERY", F.lit("SCALDING")).otherwise(F.lit("NONE"))


def task_columns() -> list[Column]:
    return [
        F.concat_ws("_", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("task_key"),
        F.when(F.col("l_returnflag") == "R", F.lit("REDUCE")).otherwise(F.lit("MAP")).alias("task_type"),
        F.col("l_linestatus").alias("task_status"),
        T.millis(F.col("l_shipdate")).alias("task_finish_time"),
        cents(F.col("l_extendedprice")).alias("task_millis"),
    ]


def conf_values() -> dict[str, Column]:
    """Configuration keys of an order's job; null leaves the key out."""
    seq, fw = F.col("job_seq"), framework_name(F.col("user_name"))
    text = seq.cast("string")
    return {
        "mapreduce.job.user.name": F.when(F.col("version") != "P", F.col("user_name")),
        "user.name": F.concat(F.lit("old "), F.col("user_name")),
        "mapreduce.job.name": F.concat(F.col("app_id"), F.lit("["), text, F.lit("]")),
        "mapreduce.job.queuename": F.when(F.col("version") == "O", F.lit("default")).otherwise(F.col("queue")),
        PIG_KEY: F.when(fw == "PIG", F.lit("0.11")),
        PIG_SIGNATURE_KEY: F.when(fw == "PIG", F.concat(F.lit(" sig_"), F.col("version"), F.lit(" "))),
        PIG_RUN_KEY: F.when((fw == "PIG") & (F.col("version") == "F"), F.col("run_id").cast("string")),
        "pig.logfile": F.when((fw == "PIG") & (F.col("version") == "O"), F.concat(F.lit("/tmp/pig_"), F.col("submit_time").cast("string"), F.lit(".log"))),
        CASCADING_FLOW_KEY: F.when(fw == "SCALDING", F.md5(text)),
        SCALDING_SIGNATURE_KEY: F.when(fw == "SCALDING", F.concat(F.lit("v"), F.col("version"))),
        "mapred.app.submitted.timestamp": F.when((fw == "NONE") & (F.col("version") == "F"), F.col("run_id").cast("string")),
        "mapreduce.map.memory.mb": F.when(F.col("version") == "F", F.lit("2048")),
        "mapreduce.reduce.memory.mb": F.lit("4096"),
        "yarn.app.mapreduce.am.resource.mb": F.lit("1536"),
        "mapred.child.java.opts": F.concat(F.lit("-Xmx"), (seq % 7 + 1).cast("string"), F.lit("g -verbose:gc")),
    }


def flow_event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cluster"),
        F.col("user_id").alias("flow_id"),
        F.col("event_id").alias("sequence"),
        T.millis(F.col("ts")).alias("ts"),
        F.col("event_type").alias("type"),
        F.col("props").alias("data"),
    )


def status_columns(events: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type").isin("click", "view"), F.lit("RUNNING"))
        .when(F.col("event_type").isin("purchase", "signup"), F.lit("SUCCEEDED"))
        .otherwise(F.lit("FAILED"))
    )
    return events.select(
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cluster"),
        F.col("user_id").alias("flow_id"),
        # the time in the key of a flow does not change when its status does
        (F.col("user_id") * 1000).alias("ts"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))).alias("user_name"),
        status.alias("status"),
        F.col("event_id").alias("update_seq"),
    )


def usage_columns(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    user = F.col("user_id")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    zero = F.lit(0).cast("bigint")
    return events.select(
        F.concat(F.lit("c"), (user % 3).cast("string")).alias("cluster"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), (user % 20).cast("string")).alias("path"),
        F.concat(F.lit("ns"), (k % 3).cast("string")).alias("namespace"),
        T.hour_floor_seconds(seconds).alias("run_id"),
        k.alias("file_count"),
        (k % 5).alias("dir_count"),
        cents(F.col("value")).alias("space_consumed"),
        (F.col("event_id") % 100).alias("access_count"),
        (k * 10).alias("quota"),
        (k * 100).alias("space_quota"),
        zero.alias("tmp_file_count"),
        zero.alias("tmp_space_consumed"),
        (k % 2).alias("trash_file_count"),
        (k % 4).alias("trash_space_consumed"),
        cents(F.col("value")).cast("double").alias("access_cost"),
        k.cast("double").alias("storage_cost"),
        F.concat(F.lit("o"), (user % 10).cast("string")).alias("owner"),
        F.col("event_id").alias("write_ts"),
    )
