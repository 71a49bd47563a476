"""Missing-value rules, typed reads and code tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of the history fields by value type. A field not listed is unknown.
LONG_FIELDS = [
    "START_TIME", "FINISH_TIME", "SUBMIT_TIME", "LAUNCH_TIME", "TOTAL_MAPS", "TOTAL_REDUCES",
    "FAILED_MAPS", "FAILED_REDUCES", "FINISHED_MAPS", "FINISHED_REDUCES", "SHUFFLE_FINISHED",
    "SORT_FINISHED", "mapFinishTime",
]
INT_FIELDS = ["HTTP_PORT", "nodeManagerPort", "nodeManagerHttpPort", "shufflePort", "port"]
STRING_FIELDS = [
    "JOBTRACKERID", "JOBID", "JOBNAME", "USER", "JOBCONF", "JOB_STATUS", "TASKID", "HOSTNAME",
    "TASK_TYPE", "ERROR", "TASK_ATTEMPT_ID", "TASK_STATUS", "COPY_PHASE", "SORT_PHASE",
    "REDUCE_PHASE", "SPLITS", "JOB_PRIORITY", "TRACKER_NAME", "STATE_STRING", "VERSION",
    "VIEW_JOB", "MODIFY_JOB", "JOB_QUEUE", "hadoopversion", "diagnostics",
    "applicationAttemptId", "containerId", "successfulAttemptId", "failedDueToAttempt",
    "workflowId", "workflowName", "workflowNodeName", "workflowAdjacencies", "locality",
    "avataar", "nodeManagerHost", "acls", "uberized", "rackname", "clockSplits", "cpuUsages",
    "physMemKbytes", "vMemKbytes", "status", "workflowTags",
]
COUNTER_FIELDS = [
    "COUNTERS", "MAP_COUNTERS", "REDUCE_COUNTERS", "TOTAL_COUNTERS", "TASK_COUNTERS",
    "TASK_ATTEMPT_COUNTERS",
]
KNOWN_FIELDS = LONG_FIELDS + INT_FIELDS + STRING_FIELDS + COUNTER_FIELDS

# Field names of the JSON history format and the name each is stored under.
JSON_FIELD_NAMES = {
    "startTime": "START_TIME",
    "finishTime": "FINISH_TIME",
    "jobid": "JOBID",
    "jobName": "JOBNAME",
    "userName": "USER",
    "jobConfPath": "JOBCONF",
    "submitTime": "SUBMIT_TIME",
    "launchTime": "LAUNCH_TIME",
    "totalMaps": "TOTAL_MAPS",
    "totalReduces": "TOTAL_REDUCES",
    "failedMaps": "FAILED_MAPS",
    "failedReduces": "FAILED_REDUCES",
    "finishedMaps": "FINISHED_MAPS",
    "finishedReduces": "FINISHED_REDUCES",
    "jobStatus": "JOB_STATUS",
    "taskid": "TASKID",
    "hostname": "HOSTNAME",
    "taskType": "TASK_TYPE",
    "error": "ERROR",
    "attemptId": "TASK_ATTEMPT_ID",
    "taskStatus": "TASK_STATUS",
    "shuffleFinishTime": "SHUFFLE_FINISHED",
    "sortFinishTime": "SORT_FINISHED",
    "splitLocations": "SPLITS",
    "httpPort": "HTTP_PORT",
    "trackerName": "TRACKER_NAME",
    "state": "STATE_STRING",
    "jobQueueName": "JOB_QUEUE",
}

# Codes of frameworks, ingest states and run states.
FRAMEWORK_CODES = {"p": "PIG", "s": "SCALDING", "n": "NONE"}
INGEST_STATES = {0: "CREATED", 1: "PREPROCESSED", 2: "LOADED", 3: "PROCESSED"}
RUN_STATES = {"r": "RUNNING", "s": "SUCCEEDED", "f": "FAILED"}
RUN_STATE_ORDER = ["RUNNING", "SUCCEEDED", "FAILED"]


def long_or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def double_or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def typed_long(text: Column) -> Column:
    """Stored text to a long: blank, missing or malformed reads as 0."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def typed_int(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int")), F.lit(0))


def _decode(code: Column, table: dict, fallback: str) -> Column:
    out = F.lit(fallback)
    for key, name in table.items():
        out = F.when(code == F.lit(key), F.lit(name)).otherwise(out)
    return out


def framework_of_code(code: Column) -> Column:
    return _decode(code, FRAMEWORK_CODES, "NONE")


def ingest_state(code: Column) -> Column:
    return _decode(code, INGEST_STATES, "CREATED")


def run_state(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in RUN_STATES.items() for x in pair])
    return F.try_element_at(known, code)


def run_state_rank(state: Column) -> Column:
    """Position of a run state in the fixed look-up order."""
    return F.array_position(F.array(*[F.lit(s) for s in RUN_STATE_ORDER]), state).cast("int")


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def stored_field_name(name: Column) -> Column:
    """JSON field name to stored field name; null when neither form is known."""
    renamed = F.try_element_at(_literal_map(JSON_FIELD_NAMES), name)
    return F.coalesce(renamed, F.when(name.isin(*KNOWN_FIELDS), name))
