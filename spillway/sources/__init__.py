"""Sources: raw lines with an envelope. ``read(spark, spec)`` gives value, _source_id, _source_name, _stream and _seq.

Batch order: ``_seq`` is monotonically increasing in a file's splits, in file order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES: dict[str, Callable] = {}


def source(name: str):
    def register(f):
        SOURCES[name] = f
        return f

    return register


def read(spark: SparkSession, spec: dict, streaming: bool = False) -> DataFrame:
    kind = spec.get("type")
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}")
    return SOURCES[kind](spark, {k: v for k, v in spec.items() if k != "type"}, streaming)


def enveloped(df: DataFrame, name, stream=None) -> DataFrame:
    if df.isStreaming and "_seq" not in df.columns:
        df = numbered(df)
    seq = [] if "_seq" in df.columns else [F.monotonically_increasing_id().alias("_seq")]
    return df.select("*", F.xxhash64(name).alias("_source_id"), name.alias("_source_name"), (stream if stream is not None else F.lit("not_set")).alias("_stream"), *seq)


def numbered(df: DataFrame) -> DataFrame:
    """Rows of a micro-batch with _seq, ascending in each split."""
    schema = df.select("*", F.lit(0).cast("bigint").alias("_seq")).schema

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 33
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(n, n + b.num_rows), pa.int64())], [*b.schema.names, "_seq"])
            n += b.num_rows

    return df.mapInArrow(run, schema)


@source("file")
def file(spark: SparkSession, spec: dict, streaming: bool) -> DataFrame:
    """Lines of the files of ``paths`` (globs; compressed files by their endings), without those of ``exclude``.

    A stream resumes from its checkpoint; ``offsets_op`` tail (latestFirst) and ``max_files`` shape the first
    batches, ``remove_after`` cleans files up."""
    reader = (spark.readStream if streaming else spark.read).format("text").option("lineSep", "\n")
    if streaming:
        reader = reader.option("maxFilesPerTrigger", int(spec.get("max_files", 1000))).option("latestFirst", spec.get("offsets_op") == "tail")
        if spec.get("remove_after"):
            reader = reader.option("cleanSource", "delete")
    if spec.get("filename_pattern"):
        reader = reader.option("pathGlobFilter", spec["filename_pattern"])
    paths = spec.get("paths", {})
    include = paths.get("include", []) if isinstance(paths, dict) else paths
    include = list(include or [spec["watching_dir"]])
    reader = reader.option("recursiveFileLookup", True)
    # a stream has one path: each path is a stream of its own, with its own place in the checkpoint
    loaded = [reader.load(p) for p in dict.fromkeys(include)] if streaming else [reader.load(include)]
    df = reduce(DataFrame.unionByName, [x.select("value", F.col("_metadata.file_path").alias("__path")) for x in loaded])
    for pattern in (paths.get("exclude", []) if isinstance(paths, dict) else []):
        df = df.where(~F.col("__path").rlike(glob_regex(pattern)))
    return enveloped(df, F.col("__path")).drop("__path")


def glob_regex(pattern: str) -> str:
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out + "$"


@source("k8s")
def k8s(spark: SparkSession, spec: dict, streaming: bool) -> DataFrame:
    """Container logs: pod, namespace, container and its id come from names pod_namespace_container-id.log.

    ``cri_type`` (docker, or another, whose lines are CRI) says how lines are decoded; see ``additional`` for what follows."""
    df = file(spark, {"paths": {"include": [spec.get("watching_dir", "/var/log/containers")]}, "filename_pattern": "*.log", **spec.get("file_config", {})}, streaming)
    name = F.regexp_extract("_source_name", r"([^/]+)$", 1)
    pattern = r"^([^_]+)_([^_]+)_(.+)-([0-9a-f]{64})\.log$"
    return df.withColumns({f"_{k}": F.regexp_extract(name, pattern, i) for i, k in enumerate(("k8s_pod", "k8s_namespace", "k8s_container", "k8s_container_id"), 1)})


def suggested(spec: dict) -> tuple[str, dict]:
    """The decoder (and its settings) that ``auto`` means for a source: a container runtime's own, else json."""
    if spec.get("type") != "k8s":
        return "json", {}
    return ("json", {"schema": "log string, stream string, time string"}) if spec.get("cri_type", "docker") == "docker" else ("cri", {})


def built_in_meta(spec: dict) -> dict[str, str]:
    """Metadata that a source adds to every event."""
    if spec.get("type") != "k8s" or spec.get("only_node"):
        return {}
    return {n: f"{{{{ .{n} }}}}" for n in ("k8s_pod", "k8s_namespace", "k8s_container", "k8s_container_id")}


def additional(spark: SparkSession, spec: dict, settings: dict) -> list[dict]:
    """Operators that come with a source. Container logs: fragments are glued, and labels come from a table of pods (a path, or a DataFrame)."""
    if spec.get("type") != "k8s":
        return []
    from ..plans.config import size

    own = {k: spec[k] for k in ("node", "only_node", "split_event_size", "allowed_pod_labels") if k in spec}
    own |= {"max_event_size": size(settings.get("max_event_size", 0)), "cut_off_event_by_limit": bool(settings.get("cut_off_event_by_limit")), "cut_off_field": settings.get("cut_off_event_by_limit_field", "")}
    if "pods" in spec:
        own["pods"] = spec["pods"] if isinstance(spec["pods"], DataFrame) else spark.read.parquet(spec["pods"])
    return [{"type": "k8s_multiline", **own}]


@source("kafka")
def kafka(spark: SparkSession, spec: dict, streaming: bool) -> DataFrame:
    """Topics by the Kafka connector (its jar must be on the classpath). No order is promised across partitions."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    options = kafka_options(spec)
    if not streaming:  # a batch reads what is there
        options |= {"startingOffsets": "earliest", "endingOffsets": "latest"}
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")
    df = df.select("value", F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"), F.col("offset").alias("_seq"))
    return enveloped(df, F.concat_ws("/", F.col("_topic"), F.col("_partition").cast("string")))


def kafka_options(spec: dict) -> dict[str, str]:
    brokers = spec["brokers"]
    out = {"kafka.bootstrap.servers": ",".join(brokers) if isinstance(brokers, list) else brokers, "subscribe": ",".join(spec["topics"]), "startingOffsets": {"newest": "latest", "oldest": "earliest"}[spec.get("offset", "newest")]}
    if "consumer_group" in spec:
        out["kafka.group.id"] = spec["consumer_group"]
    if spec.get("is_sasl_enabled"):
        mechanism = spec.get("sasl_mechanism", "SCRAM-SHA-512")
        module = "plain.PlainLoginModule" if mechanism == "PLAIN" else "scram.ScramLoginModule"
        out |= {"kafka.sasl.mechanism": mechanism, "kafka.security.protocol": "SASL_SSL" if spec.get("is_ssl_enabled") else "SASL_PLAINTEXT", "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.{module} required username="{spec.get("sasl_username", "user")}" password="{spec.get("sasl_password", "password")}";'}
    elif spec.get("is_ssl_enabled"):
        out["kafka.security.protocol"] = "SSL"
    for key, name in (("fetch_max_bytes", "kafka.fetch.max.bytes"), ("fetch_min_bytes", "kafka.fetch.min.bytes"), ("client_id", "kafka.client.id")):
        if key in spec:
            out[name] = str(spec[key])
    return out


@source("http")
def http(spark: SparkSession, spec: dict, streaming: bool) -> DataFrame:
    """Bodies that a receiver in front has landed as newline-delimited files under ``landing``; gzip by ending."""
    return file(spark, {"paths": {"include": [spec["landing"]]}}, streaming)


@source("socket")
def socket(spark: SparkSession, spec: dict, streaming: bool) -> DataFrame:
    """Lines of a TCP server, as a stream."""
    host, _, port = spec["address"].rpartition(":")
    if spec.get("network", "tcp") != "tcp" or not streaming:
        raise ValueError("only tcp, and only as a stream")
    df = spark.readStream.format("socket").option("host", host or "localhost").option("port", port).load()
    return enveloped(df, F.lit(spec["address"]))


@source("journalctl")
def journalctl(spark: SparkSession, spec: dict, streaming: bool) -> DataFrame:
    """The journal's JSON lines (journalctl -o json) landed as files; ``cursor`` skips what was read before."""
    df = file(spark, {"paths": {"include": [spec["landing"]]}}, streaming)
    if spec.get("cursor"):
        df = df.where(F.get_json_object("value", "$.__CURSOR") > spec["cursor"])
    return df


@source("dmesg")
def dmesg(spark: SparkSession, spec: dict, streaming: bool) -> DataFrame:
    """Kernel messages ``prio,seq,ts,flag;text`` landed as files, as JSON lines of level, ts, priority, sequence_number, message."""
    return kernel(file(spark, {"paths": {"include": [spec["landing"]]}}, streaming), int(spec.get("ts", 0)))


def kernel(df: DataFrame, after: int = 0) -> DataFrame:
    pattern = r"^([0-9]+),([0-9]+),([0-9]+),[^;]*;(.*)$"
    priority = F.regexp_extract("value", pattern, 1).try_cast("int").bitwiseAND(7)
    level = F.when(priority <= 3, "error").when(priority <= 5, "warn").when(priority == 6, "info").otherwise("debug")
    ts = F.regexp_extract("value", pattern, 3).try_cast("bigint")
    doc = F.struct(level.alias("level"), ts.cast("string").alias("ts"), priority.cast("string").alias("priority"), F.regexp_extract("value", pattern, 2).alias("sequence_number"), F.regexp_extract("value", pattern, 4).alias("message"))
    return df.where(F.col("value").rlike(pattern) & (ts > after)).withColumn("value", F.to_json(doc))


@source("fake")
def fake(spark: SparkSession, spec: dict, streaming: bool) -> DataFrame:
    """The given events."""
    return enveloped(spark.createDataFrame([(e, i) for i, e in enumerate(spec.get("events", []))], "value string, _seq bigint"), F.lit("fake"))
