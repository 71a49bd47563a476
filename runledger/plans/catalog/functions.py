"""Column functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import (
    conf as C, cost as M, counters as K, defaults as D, history as H, ids, naming as N, paths as P, times as T,
)
from ..views import Views, cents
from .registry import query


@query("job_id_parts", "F1", """
SELECT o_orderkey, t AS job_id, CASE WHEN o_orderkey % 5 < 3 THEN 20120101000000 END AS epoch,
  CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey END AS seq,
  CASE WHEN o_orderkey % 5 < 3 THEN printf('job_20120101000000_%04d', o_orderkey) END AS spelled
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN printf('job_20120101000000_%04d', o_orderkey)
  WHEN 1 THEN ' job_20120101000000_' || o_orderkey WHEN 2 THEN 'job_20120101000000_' || o_orderkey || '_m_1'
  WHEN 3 THEN 'job_x_' || o_orderkey ELSE 'job_' || o_orderkey END AS t FROM orders)""")
def job_id_parts(v: Views):
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    turn = key % 5
    job_id = (
        F.when(turn == 0, ids.job_id_string(F.lit(20120101000000), key))
        .when(turn == 1, F.concat(F.lit(" job_20120101000000_"), text))
        .when(turn == 2, F.concat(F.lit("job_20120101000000_"), text, F.lit("_m_1")))
        .when(turn == 3, F.concat(F.lit("job_x_"), text))
        .otherwise(F.concat(F.lit("job_"), text))
    )
    rows = v.table("orders").select("o_orderkey", job_id.alias("job_id")).withColumns(
        {"epoch": ids.job_epoch(F.col("job_id")), "seq": ids.job_seq(F.col("job_id"))}
    )
    return rows.withColumn(
        "spelled", F.when(F.col("seq").isNotNull(), ids.job_id_string(F.col("epoch"), F.col("seq")))
    )


@query("cleansed_tokens", "F2", "SELECT p_partkey, replace(replace(p_name || '!' || p_brand || ' !', ' ', '_'), '!', '_') AS token FROM part")
def cleansed_tokens(v: Views):
    text = F.concat("p_name", F.lit("!"), "p_brand", F.lit(" !"))
    return v.table("part").select("p_partkey", ids.cleanse_token(text).alias("token"))


@query("app_names", "F3 F4 F5 F6", """
SELECT p_partkey, replace(p_name, ' ', '_') || '_' AS mr,
  CASE WHEN p_size % 2 = 0 THEN 'oink ' || p_name || ':daily' ELSE 'PigLatin:' || p_name || printf('_%04d', p_size) || '/x' END AS pig,
  CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || '/(a/b)' END AS scalding,
  replace(replace(CASE p_size % 4 WHEN 0 THEN p_type || '!x' WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE '' END, ' ', '_'), '!', '_') AS picked,
  CASE WHEN p_size % 4 = 3 THEN 'id_' || p_partkey ELSE replace(replace(CASE p_size % 4 WHEN 0 THEN p_type || '!x' WHEN 1 THEN p_name ELSE p_brand END, ' ', '_'), '!', '_') END AS picked_scalding
FROM part""")
def app_names(v: Views):
    name, size = F.col("p_name"), F.col("p_size")
    turn = size % 4
    values = {
        "batch.desc": F.when(turn == 0, F.concat("p_type", F.lit("!x"))).when(turn == 1, F.lit("  ")),
        "mapred.job.name": F.when(turn == 1, name).when(turn == 2, F.lit("")),
        "mapreduce.job.name": F.when(turn == 2, F.col("p_brand")),
        "cascading.app.id": F.concat(F.lit("id "), F.col("p_partkey").cast("string")),
    }
    scheduled = F.concat(
        F.lit("PigLatin:"), name, F.when(size % 2 == 0, F.lit(":daily")).otherwise(F.lit("")),
        F.lit("_"), F.lpad(size.cast("string"), 4, "0"), F.lit("/x"),
    )
    tail = F.when(size % 3 == 0, F.concat(F.lit("/("), size.cast("string"), F.lit("/50)... end "))).otherwise(F.lit("/(a/b)"))
    jobs = v.table("part").withColumn("conf", C.wide_to_map(values))
    return jobs.select(
        "p_partkey",
        ids.cleanse_token(N.mr_app_name(F.concat(name, F.lit(" [step 1]")))).alias("mr"),
        N.pig_app_name(scheduled).alias("pig"),
        N.scalding_app_name(F.concat(F.lit("[a/"), F.col("p_brand"), F.lit("] "), name, tail)).alias("scalding"),
        N.app_id(F.col("conf"), F.lit("NONE")).alias("picked"),
        N.app_id(F.col("conf"), F.lit("SCALDING")).alias("picked_scalding"),
    )


@query("job_descriptions", "X1 F7 F9 F10 F11 F12", """
SELECT job_id, framework, replace(app_id, ' ', '_') || CASE WHEN framework = 'PIG' THEN '[' || job_seq || ']' ELSE '' END AS app,
  CASE framework WHEN 'PIG' THEN CASE WHEN version = 'F' THEN run_id ELSE submit_time END
    WHEN 'NONE' THEN CASE WHEN version = 'F' THEN run_id ELSE submit_time END
    ELSE CASE WHEN h > 9223372036854775807 THEN submit_time
      ELSE epoch_ms(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) + CAST(h % 2592000000 AS BIGINT) END END AS run,
  CASE framework WHEN 'PIG' THEN 'sig_' || version WHEN 'SCALDING' THEN 'v' || version ELSE '' END AS app_version
FROM (SELECT *, CAST('0x' || substr(md5(CAST(job_seq AS VARCHAR)), 1, 16) AS UBIGINT) AS h FROM confs)""", "confs")
def job_descriptions(v: Views):
    conf = F.col("conf")
    jobs = v.flow_jobs_conf().withColumn("framework", N.framework(conf))
    fw = F.col("framework")
    return jobs.select(
        "job_id", "framework", N.app_id(conf, fw).alias("app"),
        N.run_id(conf, fw, F.col("submit_time")).alias("run"), N.version(conf, fw).alias("app_version"),
    )


@query("pig_log_times", "F10", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN p_partkey END AS t FROM part""")
def pig_log_times(v: Views):
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/logs/pig-"), key, F.lit(".log"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("/logs/pig_"), key, F.lit(".log"))
    ).otherwise(F.lit("pig_.log"))  # no digits: not a number
    return v.table("part").select("p_partkey", N.pig_log_time(name).alias("t"))


@query("framework_codes", "F8", """
SELECT p_partkey, CASE lower(substr(p_type, 1, 1)) WHEN 'p' THEN 'PIG' WHEN 's' THEN 'SCALDING' ELSE 'NONE' END AS framework FROM part""")
def framework_codes(v: Views):
    return v.table("part").select("p_partkey", D.framework_of_code(F.lower(F.substring("p_type", 1, 1))).alias("framework"))


@query("users_and_queues", "F13 F14 F38", """
SELECT job_id, coalesce("mapreduce.job.user.name", "user.name") AS u,
  CASE WHEN "mapreduce.job.queuename" = 'default' THEN coalesce("mapreduce.job.user.name", "user.name") ELSE queue END AS q,
  'DEFAULT_QUEUE' AS no_queue, "pig.logfile" IS NOT NULL AS has_log FROM confs""", "confs")
def users_and_queues(v: Views):
    conf = F.col("conf")
    jobs = v.flow_jobs_conf().withColumn("u", C.user_name(conf))
    bare = C.filter_keys(conf, lambda k: ~k.isin(*C.QUEUE_KEYS))
    return jobs.select(
        "job_id", "u", C.queue(conf, F.col("u")).alias("q"), C.conf_queue(bare).alias("no_queue"),
        C.has_value(conf, "pig.logfile").alias("has_log"),
    )


@query("log_heads", "F15 F16", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ONE' WHEN 1 THEN 'TWO' WHEN 2 THEN 'ONE' WHEN 3 THEN 'TWO' END AS log_version,
  CASE WHEN o_orderkey % 5 < 2 THEN epoch_ms(o_orderdate) + 1000000000000 ELSE 0 END AS submitted FROM orders""")
def log_heads(v: Views):
    turn, stamp = F.col("o_orderkey") % 5, (T.millis(F.col("o_orderdate")) + 1000000000000).cast("string")
    log = (
        F.when(turn == 0, F.concat(F.lit('Meta VERSION="1" .\nJob JOBID="j" SUBMIT_TIME="'), stamp, F.lit('" A="b" .\n')))
        .when(turn == 1, F.concat(
            F.lit('Avro-Json\n{}\n{"type":"AM_STARTED"}\n{"type":"JOB_SUBMITTED","event":{"x":{"submitTime":'), stamp, F.lit("}}}\n")))
        .when(turn == 2, F.lit('META version="1" .\nJob SUBMIT_TIME="soon" .\n'))
        .when(turn == 3, F.concat(F.lit('avro-json\n{}\n{"event":{"submitTime":'), stamp, F.lit("}}\n")))
        .otherwise(F.lit("garbage"))
    )
    logs = v.table("orders").select("o_orderkey", log.alias("log")).withColumn("log_version", H.history_version(F.col("log")))
    return logs.select("o_orderkey", "log_version", H.submit_time(F.col("log"), F.col("log_version")).alias("submitted"))


@query("heap_sizes", "F18 F19", """
SELECT p_partkey, xmx, xmx * 100 // 75 AS total FROM (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN n WHEN 1 THEN n // 1024 WHEN 2 THEN n * 1024
  WHEN 3 THEN n // 1048576 WHEN 4 THEN 1024 WHEN 5 THEN 1024 END AS xmx FROM (SELECT *, p_partkey * 777 AS n FROM part))""")
def heap_sizes(v: Views):
    turn, n = F.col("p_size") % 7, (F.col("p_partkey") * 777).cast("string")
    opts = (
        F.when(turn == 0, F.concat(F.lit(" -Xmx"), n, F.lit("m -verbose:gc")))
        .when(turn == 1, F.concat(F.lit("-server -Xmx"), n, F.lit("K")))
        .when(turn == 2, F.concat(F.lit("-Xmx"), n, F.lit("G -Xms1g")))
        .when(turn == 3, F.concat(F.lit("-Xmx"), n))
        .when(turn == 4, F.lit("-server"))
        .when(turn == 6, F.concat(F.lit("-Xmx"), n, F.lit("t")))
    )
    sizes = v.table("part").select("p_partkey", M.xmx_mb(opts).alias("xmx"))
    return sizes.withColumn("total", M.xmx_total(F.col("xmx")))


@query("megabyte_millis", "F20 F21 F22", """
SELECT job_id, CASE WHEN map_mb = 0 THEN NULL ELSE map_slot_millis * 1024 // map_mb END AS standard,
  CASE WHEN version <> 'P' THEN CASE WHEN version = 'F' THEN 2048 ELSE -1 END * map_slot_millis + 4096 * reduce_slot_millis
    + 1536 * (finish_time - launch_time) END AS mb_json,
  ((job_seq % 7 + 1) * 1024 * 100 // 75) * (map_slot_millis + reduce_slot_millis) AS mb_text
FROM (SELECT j.*, CASE WHEN version = 'O' THEN 0 ELSE 2048 END AS map_mb FROM job_history j)""", "job_history")
def megabyte_millis(v: Views):
    conf = v.flow_jobs_conf().select("job_id", "conf")
    jobs = v.job_history().join(conf, "job_id")
    map_ms, red_ms = F.col("map_slot_millis"), F.col("reduce_slot_millis")
    launch = F.when(F.col("version") != "P", F.col("launch_time"))
    memory = F.when(F.col("version") == "O", F.lit(0)).otherwise(F.lit(2048))
    return jobs.select(
        "job_id",
        M.standard_slot_millis(map_ms, F.lit(1024), memory).alias("standard"),
        M.mb_millis_json(F.col("conf"), map_ms, red_ms, launch, F.col("finish_time")).alias("mb_json"),
        M.mb_millis_text(C.value(F.col("conf"), M.CHILD_OPTS_KEY), map_ms, red_ms).alias("mb_text"),
    )


@query("time_floors", "F24 F25 F36", """
SELECT event_id, day, (day // 86400000 - (day // 86400000 + 4) % 7) * 86400000 AS week, s - s % 3600 AS hour,
  epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS day_start, epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) + 86399999 AS day_end
FROM (SELECT *, ms - ms % 86400000 AS day, ms // 1000 AS s FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events))""")
def time_floors(v: Views):
    ms, text = T.millis(F.col("ts")), F.date_format("ts", "yyyy-MM-dd")
    return v.table("events").select(
        "event_id", T.day_floor(ms).alias("day"), T.week_floor(ms).alias("week"),
        T.hour_floor_seconds(F.call_function("div", ms, F.lit(1000))).alias("hour"),
        T.day_start_millis(text).alias("day_start"), T.day_end_millis(text).alias("day_end"),
    )


_CELLS_OF_ORDER = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, g AS counter_group, n AS counter_name, value FROM (
  SELECT *, 'Group (' || l_returnflag || ')' AS g, 'QTY' AS n, CAST(l_quantity AS BIGINT) AS value FROM lineitem
  UNION ALL SELECT *, 'Group (' || l_returnflag || ')', 'N[' || l_linestatus || ']', CAST(l_linenumber AS BIGINT) FROM lineitem
  UNION ALL SELECT *, 'money', 'cents', CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem)"""
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _line_text(column, escape: bool = False):
    text = column.cast("string")
    return F.regexp_replace(text, r"([\[\](){}\\])", r"\\$1") if escape else text


@query("counters_from_text", "F27", _CELLS_OF_ORDER)
def counters_from_text(v: Views):
    group = _line_text(F.concat(F.lit("Group ("), F.col("l_returnflag"), F.lit(")")), True)
    state = _line_text(F.concat(F.lit("N["), F.col("l_linestatus"), F.lit("]")), True)
    compact = F.concat(
        F.lit("{("), group, F.lit(")(a label)[(QTY)(Quantity \\(units\\))("), F.col("l_quantity").cast("bigint").cast("string"),
        F.lit(")][("), state, F.lit(")(x)("), F.col("l_linenumber").cast("string"), F.lit(")]}{(money)(money)[(cents)(cents)("),
        cents(F.col("l_extendedprice")).cast("string"), F.lit(")]}"),
    )
    return v.dealt("lineitem", "l_orderkey", "l_linenumber").select(*_LINE, F.inline(K.from_text(compact)))


@query("counters_from_broken_text", "F27", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS cells FROM part")
def counters_from_broken_text(v: Views):
    good = F.concat(F.lit("{(g)(g)[(n)(n)("), F.col("p_size").cast("string"), F.lit(")]}"))
    text = F.when(F.col("p_size") % 2 == 0, good).otherwise(F.concat(good, F.lit("{(g)(g)[(n)(n)")))
    return v.table("part").select("p_partkey", F.size(K.from_text(text)).alias("cells"))


@query("counters_from_json", "F28", _CELLS_OF_ORDER.replace("SELECT l_orderkey,", "SELECT 'reduce' AS kind, l_orderkey,", 1))
def counters_from_json(v: Views):
    def count(name, value):
        return F.struct(name.alias("name"), F.lit("label").alias("displayName"), value.alias("value"))

    qty, number = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    record = F.struct(
        F.lit("REDUCE_COUNTERS").alias("name"),
        F.array(
            F.struct(
                F.concat(F.lit("Group ("), F.col("l_returnflag"), F.lit(")")).alias("name"),
                F.array(count(F.lit("QTY"), qty), count(F.concat(F.lit("N["), F.col("l_linestatus"), F.lit("]")), number)).alias("counts"),
            ),
            F.struct(F.lit("money").alias("name"), F.array(count(F.lit("cents"), cents(F.col("l_extendedprice")))).alias("counts")),
        ).alias("groups"),
    )
    parsed = v.dealt("lineitem", "l_orderkey", "l_linenumber").select(*_LINE, K.parse_json(F.to_json(record)).alias("p"))
    return parsed.select(K.json_kind(F.col("p")).alias("kind"), *_LINE, F.inline(K.from_json(F.col("p"))))


@query("stored_field_names", "F29", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN 'START_TIME' WHEN 2 THEN 'SHUFFLE_FINISHED' WHEN 3 THEN 'locality'
  WHEN 4 THEN 'JOBID' WHEN 5 THEN 'SPLITS' WHEN 6 THEN 'JOB_QUEUE' END AS stored FROM lineitem""")
def stored_field_names(v: Views):
    names = ["startTime", "shuffleFinishTime", "locality", "jobid", "splitLocations", "jobQueueName", "priority"]
    name = F.array(*[F.lit(n) for n in names])[F.col("l_linenumber") - 1]
    return v.table("lineitem").select(*_LINE, D.stored_field_name(name).alias("stored"))


@query("typed_values", "F30 F31", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_partkey * 5000000000 ELSE 0 END AS l, CASE p_size % 4 WHEN 0 THEN p_size ELSE 0 END AS i,
  CASE p_size % 4 WHEN 1 THEN '' ELSE p_name END AS s, CASE p_size % 4 WHEN 1 THEN 0.0 ELSE p_retailprice END AS d FROM part""")
def typed_values(v: Views):
    turn = F.col("p_size") % 4

    def text(value):
        return F.when(turn == 0, value.cast("string")).when(turn == 1, F.lit("  ")).when(turn == 2, F.lit("12x"))

    return v.table("part").select(
        "p_partkey", D.typed_long(text(F.col("p_partkey") * 5000000000)).alias("l"), D.typed_int(text(F.col("p_size"))).alias("i"),
        D.text_or_empty(F.when(turn != 1, F.col("p_name"))).alias("s"), D.double_or_zero(F.when(turn != 1, F.col("p_retailprice"))).alias("d"),
    )


@query("task_components", "F32", """
SELECT job_id, task_key, CASE task_type WHEN 'MAP' THEN printf('m_%s', task_key) ELSE '' END AS task,
  CASE WHEN task_status = 'O' THEN printf('r_%s_0', task_key) ELSE 'attempt_9_9_' || task_key END AS attempt, 'AM_app_' || job_seq AS am FROM tasks""", "tasks")
def task_components(v: Views):
    job = F.col("job_id")
    number = F.expr("substring(job_id, 5)")
    task = F.when(F.col("task_type") == "MAP", F.concat(F.lit("task_"), number, F.lit("_m_"), F.col("task_key")))
    attempt = F.when(
        F.col("task_status") == "O", F.concat(F.lit("attempt_"), number, F.lit("_r_"), F.col("task_key"), F.lit("_0"))
    ).otherwise(F.concat(F.lit("attempt_9_9_"), F.col("task_key")))
    return v.tasks_only().select(
        "job_id", "task_key", ids.task_component("task_", job, task).alias("task"),
        ids.task_component("attempt_", job, attempt).alias("attempt"),
        ids.am_component(F.concat(F.lit("app_"), F.col("job_seq").cast("string"))).alias("am"),
    )


@query("queue_lists", "F39", """
SELECT cluster, user_name, app_id, queues AS list, CAST(len(string_split(rtrim(queues, '!'), '!')) AS INTEGER) AS n, queues AS again, 0 AS none
FROM (SELECT cluster, user_name, app_id, coalesce(array_to_string(list_sort(list(DISTINCT queue)), '!') || '!', '') AS queues FROM orders_k GROUP BY ALL)""", "orders_k")
def queue_lists(v: Views):
    sets = v._orders().groupBy("cluster", "user_name", "app_id").agg(P.queue_list(F.collect_set("queue")).alias("list"))
    return sets.select(
        "*", F.size(P.queue_set(F.col("list"))).alias("n"), P.queue_list(P.queue_set(F.col("list"))).alias("again"),
        F.size(P.queue_set(F.lit("  "))).alias("none"),
    )
