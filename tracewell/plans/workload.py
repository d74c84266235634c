"""Sample inputs derived from the benchmark tables by Spark, whole tables only.

``events`` rows become agent events (and OTLP spans, hook payloads, batches),
``orders`` rows become system events (and OTLP log records), ``embeddings`` a
memory change log, ``conversations`` chat events. ``oracles`` states the same
recipes in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.expr import int_div
from tracewell.functions.scalars import event_type, tool_message, tool_type

EPOCH_2024 = 1_704_067_200
AS_OF_SECONDS = EPOCH_2024 + 30 * 86_400
SPANS_PER_PAYLOAD = 50
LOGS_PER_PAYLOAD = 40
HOOK_EVENTS_PER_BATCH = 20


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not stream:
        return batch
    # The file source takes folders and patterns, not a single file.
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def spread(df: DataFrame) -> DataFrame:
    """The sample tables are single files; costly work per row is spread over the cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF_SECONDS))


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]))


def _span_id(prefix: str, number: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit(prefix), number.cast("string"))), 1, 16)


def _trace_id(block: Column) -> Column:
    return F.md5(F.concat(F.lit("t"), block.cast("string")))


def _utc(ts: Column) -> Column:
    """The instant of a time that is stored without a zone and is UTC, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events", stream)
    return e.select(
        "event_id", _utc(F.col("ts")).alias("ts"), "user_id",
        F.col("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        int_div(F.col("event_id"), 10).alias("block"), (F.col("event_id") % 10).alias("pos"),
    )


def agent_events(spark: SparkSession, sf_dir: str, stream: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    kind, k = F.col("kind"), F.col("k")
    tool = (
        F.when(kind == "view", "Read").when(kind == "signup", "Edit")
        .when(kind == "purchase", "mcp__git__commit").otherwise("Bash")
    )
    parent = F.col("block") * 10 + int_div(F.col("pos") - 1, 2)
    child = F.col("pos") > 0
    path = F.when(tool.isin("Read", "Edit"), F.concat(F.lit("src/mod_"), k.cast("string"), F.lit(".py")))
    params = _json(
        file_path=path, items=F.array(F.struct(F.lit("x").alias("api_key"), F.lit(1).alias("n"))),
        max_tokens=k, nested=F.struct(k.alias("n"), F.lit("p").alias("password")))
    project = F.concat(F.lit("/work/p"), (F.col("user_id") % 4).cast("string"))
    branch = F.when(F.col("user_id") % 3 == 0, "").otherwise("main")
    typed = F.when(kind == "error", "error").otherwise(event_type(tool))
    return events(spark, sf_dir, stream).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("agent_id"),
        F.concat(F.lit("tok-"), (F.col("event_id") % 2).cast("string")).alias("session_token"),
        "ts", typed.alias("event_type"),
        F.when(kind == "error", "error").when(F.col("value") > 200, "warn").otherwise("info").alias("severity"),
        tool.alias("tool_name"), tool_type(tool).alias("tool_type"),
        F.lit(None).cast("string").alias("mcp_server"), tool_message(tool).alias("message"),
        params.alias("params"), F.lit('{"auth_header":"x","ok":true}').alias("result"),
        _json(git_branch=branch, project_dir=project).alias("context"),
        F.floor("value").alias("duration_ms"),
        F.array(typed, F.concat(F.lit("k"), (k % 5).cast("string"))).alias("tags"),
        _trace_id(F.col("block")).alias("trace_id"), _span_id("s", F.col("event_id")).alias("span_id"),
        F.when(child, _span_id("s", parent)).alias("parent_span_id"),
        F.when(child, parent.cast("string")).alias("spawned_by"),
        F.col("ts").alias("created_at"), *keep,
    )


def system_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """One per order. Some lack a trace, some traces lack agent events; parents
    are an agent event, the previous order or a span that never arrived."""
    o = table(spark, sf_dir, "orders", stream)
    key, cust, priority = F.col("o_orderkey"), F.col("o_custkey"), F.substring("o_orderpriority", 1, 1)
    block = int_div(key, 10)
    ts = F.timestamp_seconds(F.lit(EPOCH_2024) + key * 180)
    parent = (
        F.when(F.col("o_orderstatus") == "F", _span_id("s", key))
        .when((F.col("o_orderstatus") == "O") & (key % 10 != 0), _span_id("o", key - 1))
        .when(F.col("o_orderstatus") == "P", _span_id("ghost", key))
    )
    return o.select(
        F.concat(F.lit("o"), key.cast("string")).alias("event_id"), ts.alias("ts"),
        F.when(priority == "4", "").when(priority != "5", _trace_id(block)).alias("trace_id"),
        _span_id("o", key).alias("span_id"), parent.alias("parent_span_id"),
        F.lit("otlp").alias("source_type"), F.lit("trace").alias("signal"),
        F.when(cust % 5 == 4, "unknown").otherwise(F.concat(F.lit("svc-"), (cust % 5).cast("string"))).alias("source_service"),
        F.when(priority == "1", "error").otherwise("info").alias("severity"),
        F.concat(F.lit("HTTP "), F.col("o_orderpriority")).alias("event_name"),
        F.lit(None).cast("string").alias("message"),
        _json(**{"order.status": F.col("o_orderstatus")}).alias("attributes"), F.lit("{}").alias("resource"),
        F.floor(F.col("o_totalprice") / 1000).alias("duration_ms"),
        F.lit(None).cast("string").alias("session_id"), ts.alias("created_at"),
    )


def hook_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hook call per agent event; slow, cheap and rare ones are defective."""
    e = spread(agent_events(spark, sf_dir, keep=("value",)))
    good = F.concat(
        F.lit('{"tool_name":"'), F.col("tool_name"), F.lit('","tool_input":'), F.col("params"),
        F.lit(',"tool_output":'), F.when(F.col("value") < 0.5, '"done"').otherwise(F.col("result")),
        F.lit(',"duration_ms":'), F.col("duration_ms").cast("string"),
        F.lit(',"session_id":"'), F.col("session_token"),
        F.lit('","project_dir":"'), F.get_json_object("context", "$.project_dir"), F.lit('"}'))
    nameless = F.replace(good, F.lit('"tool_name"'), F.lit('"tool"'))
    body = (
        F.when(F.col("value") > 200, F.substring(good, F.lit(1), int_div(F.length(good).cast("bigint"), 2).cast("int")))
        .when(F.col("value") > 150, nameless).otherwise(good))
    return e.select(F.col("event_id").cast("bigint").alias("payload_id"), body.alias("body"),
                    F.col("ts").alias("captured_at"), "agent_id")


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent events as JSON: a few per payload as a list, one alone as an object."""
    e = agent_events(spark, sf_dir)
    number = F.col("event_id").cast("bigint")
    one = F.to_json(F.struct(
        "agent_id", "session_token", F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "event_type", "severity", "tool_name", "message", "duration_ms", "tags", "trace_id", "span_id"))
    single = F.col("event_type") == "error"
    payload = F.when(single, number * 2).otherwise(int_div(number, HOOK_EVENTS_PER_BATCH) * 2 + 1)
    grouped = e.select(payload.alias("payload_id"), number.alias("number"), one.alias("one"), "ts") \
        .groupBy("payload_id").agg(
            F.array_sort(F.collect_list(F.struct("number", "one"))).alias("items"), F.max("ts").alias("captured_at"))
    bodies = F.array_join(F.transform("items", lambda x: x["one"]), ",")
    is_list = F.col("payload_id") % 2 == 1
    return grouped.select("payload_id", F.when(is_list, F.concat(F.lit("["), bodies, F.lit("]"))).otherwise(bodies).alias("body"),
                          "captured_at")


def _scalar_attr(key: str, field: str, value: Column) -> Column:
    return F.concat(F.lit(f'{{"key":"{key}","value":{{"{field}":'), value, F.lit("}}"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def trace_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTLP trace requests, one resource per service in each.

    A payload with a span value above 340 is cut in half, one with a value above
    320 has a numeric ``intValue``; both must be refused whole. An empty body
    and an empty list are accepted and give no rows.
    """
    e = events(spark, sf_dir)
    key, user = F.col("event_id"), F.col("user_id")
    start = F.unix_micros("ts") * 1000 + key % 1000
    end = F.when(F.col("kind") == "signup", start).otherwise(start + F.floor(F.col("value") * 1_000_000))
    parent = F.when(F.col("pos") > 0, _span_id("s", F.col("block") * 10 + int_div(F.col("pos") - 1, 2))).otherwise("")
    trace = F.when(F.col("kind") == "view", F.upper(_trace_id(F.col("block")))).otherwise(_trace_id(F.col("block")))
    k = F.col("k").cast("string")
    payload_id = int_div(key, SPANS_PER_PAYLOAD)
    attrs = F.concat_ws(
        ",",
        F.when(F.col("kind") == "error", _scalar_attr("a.kind", "stringValue", F.lit('"first"'))),
        _scalar_attr("a.kind", "stringValue", _quoted(F.col("kind"))),
        F.concat(F.lit('{"key":"b.k","value":{"intValue":'), F.lit("@Q@"), k, F.lit("@Q@}}")),
        _scalar_attr("c.even", "boolValue", F.when(F.col("k") % 2 == 0, "true").otherwise("false")),
        _scalar_attr("d.ratio", "doubleValue", F.concat(k, F.lit(".5"))),
        F.when(F.col("kind") == "click", F.concat(
            F.lit('{"key":"e.list","value":{"arrayValue":{"values":[{"stringValue":"x"},{"kvlistValue":{"values":[{"key":"n","value":{"intValue":"'),
            k, F.lit('"}}]}}]}}}'))),
    )
    span = F.concat(
        F.lit('{"traceId":"'), trace, F.lit('","spanId":"'), _span_id("s", key), F.lit('","parentSpanId":"'), parent,
        F.lit('","kind":2,"name":"op '), F.col("kind"), F.lit('","startTimeUnixNano":"'), start.cast("string"),
        F.lit('","endTimeUnixNano":"'), end.cast("string"), F.lit('","status":{"code":'),
        F.when(F.col("kind") == "error", "2").otherwise("1"), F.lit('},"attributes":['), attrs, F.lit("]}"))
    service = user % 5
    resource = F.when(service == 4, F.lit('{"attributes":[]}')).otherwise(F.concat(
        F.lit('{"attributes":[{"key":"service.name","value":{"stringValue":"svc-'), service.cast("string"), F.lit('"}}]}')))
    blocks = e.select(payload_id.alias("payload_id"), service.alias("service"), resource.alias("resource"),
                      F.struct(key, span.alias("span")).alias("item"),
                      F.when(F.col("value") > 340, 2).when(F.col("value") > 320, 1).otherwise(0).alias("defect")) \
        .groupBy("payload_id", "service").agg(
            F.first("resource").alias("resource"), F.array_sort(F.collect_list("item")).alias("items"),
            F.max("defect").alias("defect")) \
        .select("payload_id", "service", "defect", F.concat(
            F.lit('{"resource":'), F.col("resource"), F.lit(',"scopeSpans":[{"scope":{"name":"lib"},"spans":['),
            F.array_join(F.transform("items", lambda x: x["span"]), ","), F.lit("]}]}")).alias("block"))
    return _as_requests(blocks, "resourceSpans")


def log_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTLP log requests from ``orders``; the dearest order decides on defects."""
    o = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    whole = F.floor(price)
    priority = F.substring("o_orderpriority", 1, 1)
    body = (
        F.when(priority == "1", F.concat(F.lit('{"stringValue":"order '), key.cast("string"), F.lit('"}')))
        .when(priority == "2", F.concat(F.lit('{"intValue":@Q@'), whole.cast("string"), F.lit("@Q@}")))
        .when(priority == "3", F.concat(F.lit('{"doubleValue":'), whole.cast("string"), F.lit(".5}")))
        .when(priority == "4", F.lit('{"boolValue":true}'))
        .otherwise(F.lit('{"kvlistValue":{"values":[{"key":"a","value":{"stringValue":"b"}}]}}')))
    # Decimal: nanoseconds from 41.8 million keys on are past a bigint.
    nanos = F.when(F.col("o_orderstatus") == "P", F.lit("0")).otherwise(
        ((F.lit(EPOCH_2024) + key * 180).cast("decimal(20,0)") * 1_000_000_000 + 7).cast("string"))
    trace = F.when(priority == "5", "").otherwise(_trace_id(int_div(key, 10)))
    rec = F.concat(
        F.lit('{"timeUnixNano":"'), nanos, F.lit('","severityNumber":'), (whole % 25).cast("string"),
        F.lit(',"severityText":"X","body":'), body, F.lit(',"traceId":"'), trace, F.lit('","spanId":"'), _span_id("o", key),
        F.lit('","attributes":[{"key":"status","value":{"stringValue":"'), F.col("o_orderstatus"), F.lit('"}}]}'))
    service = F.col("o_custkey") % 5
    resource = F.when(service == 4, F.lit("{}")).otherwise(F.concat(
        F.lit('{"attributes":[{"key":"service.name","value":{"stringValue":"svc-'), service.cast("string"), F.lit('"}}]}')))
    blocks = o.select(int_div(key, LOGS_PER_PAYLOAD).alias("payload_id"), service.alias("service"), resource.alias("resource"),
                      F.struct(key, rec.alias("rec")).alias("item"),
                      F.when(price > 499_700, 2).when(price > 499_400, 1).otherwise(0).alias("defect")) \
        .groupBy("payload_id", "service").agg(
            F.first("resource").alias("resource"), F.array_sort(F.collect_list("item")).alias("items"),
            F.max("defect").alias("defect")) \
        .select("payload_id", "service", "defect", F.concat(
            F.lit('{"resource":'), F.col("resource"), F.lit(',"scopeLogs":[{"logRecords":['),
            F.array_join(F.transform("items", lambda x: x["rec"]), ","), F.lit("]}]}")).alias("block"))
    return _as_requests(blocks, "resourceLogs")


def _as_requests(blocks: DataFrame, top: str) -> DataFrame:
    spark = blocks.sparkSession
    whole = blocks.groupBy("payload_id").agg(
        F.array_sort(F.collect_list(F.struct("service", "block"))).alias("blocks"), F.max("defect").alias("defect"))
    good = F.concat(F.lit(f'{{"{top}":['), F.array_join(F.transform("blocks", lambda b: b["block"]), ","), F.lit("]}"))
    text = F.replace(good, F.lit("@Q@"), F.when(F.col("defect") == 1, F.lit("")).otherwise(F.lit('"')))
    half = F.substring(text, F.lit(1), int_div(F.length(text).cast("bigint"), 2).cast("int"))
    requests = whole.select("payload_id", F.when(F.col("defect") == 2, half).otherwise(text).alias("body"))
    blank = spark.createDataFrame([(-1, ""), (-2, f'{{"{top}":[]}}')], "payload_id bigint, body string")
    ingested = F.timestamp_seconds(F.lit(AS_OF_SECONDS) + F.col("payload_id"))
    return requests.unionByName(blank).withColumn("ingested_at", ingested)


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    none = F.lit(None).cast("string")
    conv = F.col("conv_id").cast("string")
    return c.select(
        F.concat_ws("-", F.lit("c"), conv, F.lpad(F.col("turn").cast("string"), 4, "0")).alias("event_id"),
        F.lit("conv").alias("agent_id"), conv.alias("session_token"), conv.alias("session_id"), ts.alias("ts"),
        F.lit("chat").alias("event_type"), F.lit("info").alias("severity"), none.alias("tool_name"),
        F.col("text").alias("message"), F.array("role").alias("tags"), none.alias("trace_id"))


def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("agent-"), F.col("label").cast("string")).alias("agent_id"),
        F.concat(F.lit("k"), (v % 40).cast("string")).alias("key"),
        F.concat(F.lit("v"), v.cast("string")).alias("value"),
        F.array(F.concat(F.lit("t"), (v % 4).cast("string"))).alias("tags"),
        (v % 3 == 0).alias("shared"),
        F.when(v % 17 == 0, "delete").otherwise("put").alias("op"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + v * 60).alias("ts"),
        v.alias("seq"), "embedding",
    )
