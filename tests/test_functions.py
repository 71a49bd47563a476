import pytest
from pyspark.sql import functions as F

from runledger.functions import (
    conf as C, cost as M, counters as K, defaults as D, history as H, ids, naming as N, paths as P, times as T,
)


def lit_map(**pairs):
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k.replace("__", "."), v)])


def test_week_and_day_floor(value):
    ts = F.lit(1402698420000)
    assert value(T.day_floor(ts)) == 1402617600000
    assert value(T.week_floor(ts)) == 1402185600000
    # a Sunday is the start of its own week, also before 1970
    assert value(T.week_floor(F.lit(1402185600000))) == 1402185600000
    assert value(T.week_floor(F.lit(-1))) == -4 * 86400000


def test_job_ids(value):
    assert value(ids.job_id_string(F.lit(20120101000000), F.lit(1))) == "job_20120101000000_0001"
    assert value(ids.job_id_string(F.lit(1), F.lit(123456))) == "job_1_123456"
    assert value(ids.job_seq(F.lit("job_20120101000000_10001"))) == 10001
    for bad in ("job_1", "job_x_1", "job_1_y", "", "job__"):
        assert value(ids.job_seq(F.lit(bad))) is None
    with pytest.raises(Exception, match="Invalid job id"):
        value(ids.require_job_id(F.lit("nonsense")))


def test_task_components(value):
    job = F.lit("job_1_0001")
    assert value(ids.task_component("task_", job, F.lit("task_1_0001_m_000002"))) == "m_000002"
    assert value(ids.task_component("attempt_", job, F.lit("attempt_1_0001_r_000002_0"))) == "r_000002_0"
    assert value(ids.task_component("task_", job, F.lit("task_9_0001_m_1"))) == "task_9_0001_m_1"
    assert value(ids.task_component("task_", job, F.lit("task_1_0001_"))) == "task_1_0001_"
    assert value(ids.task_component("task_", job, F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("name,app", [
    ("[(1/3)] com.example.MyJob/(2/3)", "com.example.MyJob"),
    ("com.example.MyJob/(10/11)... more", "com.example.MyJob"),
    ("[a] [b] com.example.MyJob", "com.example.MyJob"),
    ("com.example.MyJob/(x/3)", "com.example.MyJob/(x/3)"),
    ("plain", "plain"),
])
def test_scalding_names(value, name, app):
    assert value(N.scalding_app_name(F.lit(name))) == app


def test_pig_and_mr_names(value):
    assert value(N.pig_app_name(F.lit("PigLatin:load:hourly:x_1234/tail"))) == "oink load:hourly:x"
    assert value(N.pig_app_name(F.lit("PigLatin:load.pig"))) == "PigLatin:load.pig"
    assert value(N.mr_app_name(F.lit("Sleep job [1/2] [x]"))) == "Sleep job "
    assert value(N.pig_log_time(F.lit("/var/log/pig/pig_1334818693838.log"))) == 1334818693838
    assert value(N.pig_log_time(F.lit("/var/log/other.log"))) == 0


def test_scalding_run_id(value):
    submit = F.lit(1402698420000)
    conf = lit_map(cascading__flow__id="00000000000000ffabc")
    assert value(N.scalding_run_id(conf, submit)) == 1401580800000 + 0xFF
    assert value(N.scalding_run_id(lit_map(cascading__flow__id="zz"), submit)) == 1402698420000
    # above the largest signed long: not usable
    assert value(N.scalding_run_id(lit_map(cascading__flow__id="f" * 32), submit)) == 1402698420000
    stamped = lit_map(cascading__flow__id="ff", scalding__flow__submitted__timestamp="77")
    assert value(N.scalding_run_id(stamped, submit)) == 77


def test_users_and_queues(value):
    assert value(C.user_name(lit_map(user__name="old", mapreduce__job__user__name=" "))) == "old"
    assert value(C.user_name(lit_map(a="b"))) is None
    assert value(C.queue(lit_map(mapreduce__job__queuename="Default"), F.lit("me"))) == "me"
    assert value(C.queue(lit_map(mapred__job__queue__name="q"), F.lit("me"))) == "q"
    assert value(C.queue(lit_map(a="b"), F.lit("me"))) == "DEFAULT_QUEUE"


@pytest.mark.parametrize("opts,mb", [
    ("-Xmx1024M", 1024), ("-Xmx1024m -verbose:gc", 1024), ("-server -Xmx2G", 2048), ("-Xmx2048k", 2), ("-Xmx1000k", 0),
    ("-Xmx1048576", 1), ("-server", 1024), ("", 1024), ("  ", 1024), (None, 1024), ("-Xmx5t", None), ("-Xmxm", None),
])
def test_xmx(value, opts, mb):
    assert value(M.xmx_mb(F.lit(opts).cast("string"))) == mb


def test_cost(value):
    assert value(M.xmx_total(F.lit(1024))) == 1365
    assert value(M.job_cost(F.lit(100), F.lit(20.0), F.lit(512))) == pytest.approx(4.52e-8, rel=1e-3)
    assert value(M.job_cost(F.lit(100), F.lit(0.0), F.lit(0))) == 0
    assert value(M.standard_slot_millis(F.lit(7), F.lit(1024), F.lit(0))) is None
    assert value(M.standard_slot_millis(F.lit(7), F.lit(1024), F.lit(4096))) == 1


def test_history_head(value):
    text = F.lit('Meta VERSION="1" .\nJob JOBID="j" SUBMIT_TIME="1401234567890" .\n')
    assert value(H.history_version(text)) == "ONE"
    assert value(H.submit_time(text, F.lit("ONE"))) == 1401234567890
    json = F.lit('Avro-Json\n{}\n{"type":"JOB_SUBMITTED","event":{"x":{"submitTime":1356789012345}}}')
    assert value(H.history_version(json)) == "TWO"
    assert value(H.submit_time(json, F.lit("TWO"))) == 1356789012345
    assert value(H.history_version(F.lit("other"))) is None
    assert value(H.submit_time(F.lit('Meta VERSION="1" .\nJob SUBMIT_TIME="133'), F.lit("ONE"))) == 0


def test_counters(value):
    text = r"{(g)(G)[(a)(A \(x\))(5)][(b)(B)(-7)]}{(h.i)(H)[(c\]d)(C)(9)]}"
    cells = value(K.from_text(F.lit(text)))
    assert [(c.counter_group, c.counter_name, c.value) for c in cells] == [("g", "a", 5), ("g", "b", -7), ("h.i", "c]d", 9)]
    assert value(K.from_text(F.lit(text + "{(broken"))) == []
    nested = K.nested(K.from_text(F.lit(text)))
    assert value(K.value(nested, "g", "b")) == -7
    assert value(K.value(nested, "g", "zz")) == 0
    with pytest.raises(Exception, match="Malformed counter"):
        value(K.from_qualifier(F.lit("a!b!c"), F.lit(1)))


def test_field_names_and_defaults(value):
    assert value(D.stored_field_name(F.lit("jobQueueName"))) == "JOB_QUEUE"
    assert value(D.stored_field_name(F.lit("FINISH_TIME"))) == "FINISH_TIME"
    assert value(D.stored_field_name(F.lit("priority"))) is None
    assert value(D.typed_long(F.lit("12x"))) == 0
    assert value(D.framework_of_code(F.lit("s"))) == "SCALDING"
    assert value(D.framework_of_code(F.lit("?"))) == "NONE"
    assert value(D.ingest_state(F.lit(9))) == "CREATED"
    assert value(D.run_state(F.lit("f"))) == "FAILED"


@pytest.mark.parametrize("name,job,kind", [
    ("job_201409081530_0042_1410190211111_user_word+count", "job_201409081530_0042", "history"),
    ("job_201409081530_0042_conf.xml", "job_201409081530_0042", "conf"),
    ("cluster_1410_job_201409081530_0042_conf.xml", "job_201409081530_0042", "conf"),
    ("job_1356789000000_0017-1356789012345-user-Sleep+job.jhist", "job_1356789000000_0017", "history"),
    ("job_201409081530_0042_conf.xml.crc", None, "none"), ("", None, "none"), ("other.txt", None, "none"),
])
def test_file_names(value, name, job, kind):
    assert value(P.file_job_id(F.lit(name))) == job
    assert value(P.file_kind(F.lit(name))) == kind


def test_queue_lists(value):
    assert value(P.queue_list(F.array(F.lit("b"), F.lit("a")))) == "a!b!"
    assert value(P.queue_set(F.lit("a!b!a!"))) == ["a", "b"]
    assert value(P.queue_set(F.lit(" "))) == []


def test_imports_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100; assert set(e.oracle_sql()) <= set(e.queries())"
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
