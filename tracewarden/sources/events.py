"""Event sources: each reader gives a DataFrame, and never opens a path outside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.MapType(T.StringType(), T.StringType())


def csv_events(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header; every column stays text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def projected(rows: DataFrame, entity: str, value: str, time: str = "_time", layout: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> DataFrame:
    """(t, entity, value) of log rows: seconds since 1970 in UTC, IPv4-mapped prefixes removed; rows without time go."""
    t = F.unix_micros(F.try_to_timestamp(time, F.lit(layout))) / F.lit(1e6)
    return rows.select(t.alias("t"), F.replace(entity, F.lit("::ffff:"), F.lit("")).alias("entity"), F.col(value).alias("value")).where("t IS NOT NULL")


def identity(record: Column) -> Column:
    """Who acted, from a nested identity: user name, else the end of its ARN, else its type, else '-'."""
    full = lambda c: F.when(c != "", c)
    who = record["userIdentity"]
    return F.coalesce(full(who["userName"]), full(F.element_at(F.split(who["arn"], "/"), -1)), full(who["type"]), F.lit("-"))


_TRAIL = "Records array<struct<eventTime:string,eventName:string,awsRegion:string,sourceIPAddress:string,userIdentity:struct<type:string,userName:string,arn:string>>>"


def cloudtrail_events(spark: SparkSession, path: str, value: str = "awsRegion", names: list[str] | None = None) -> DataFrame:
    """(t, entity, value, eventName) of {"Records": [...]} files, plain or gzipped; optionally some API names only."""
    r = spark.read.schema(_TRAIL).json(path, multiLine=True).select(F.explode("Records").alias("r"))
    if names is not None:
        r = r.where(F.col("r.eventName").isin(names))
    who = identity(F.col("r"))
    t = F.unix_micros(F.try_to_timestamp("r.eventTime", F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]X"))) / F.lit(1e6)
    shown = who if value == "userIdentity" else F.coalesce(F.col(f"r.{value}").cast("string"), F.lit("-"))
    return r.select(t.alias("t"), who.alias("entity"), shown.alias("value"), F.col("r.eventName").alias("eventName"))


def jsonl_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line as fields map<string,string>; lines that are no object are dropped."""
    return spark.read.text(path).select(F.from_json("value", FIELDS).alias("fields")).where("fields IS NOT NULL AND size(fields) > 0")


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or JSON lines, as fields maps; what can't be read is dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    whole = raw.where(F.col("v").startswith("[")).select(F.explode(F.from_json("v", T.ArrayType(FIELDS))).alias("fields"))
    lines = raw.where(~F.col("v").startswith("[")).select(F.explode(F.split("v", "\n")).alias("l")).select(F.from_json("l", FIELDS).alias("fields"))
    return whole.unionByName(lines).where("fields IS NOT NULL AND size(fields) > 0")


_EVENT = "System struct<EventID:string,Channel:string,Computer:string,TimeCreated:struct<_SystemTime:string>>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"


def event_xml(spark: SparkSession, path: str) -> DataFrame:
    """One <Event> element per line as fields maps: system fields and named data; other lines are dropped."""
    e = spark.read.text(path).where(F.trim("value").startswith("<Event")).select(F.from_xml("value", _EVENT).alias("e")).where("e.System IS NOT NULL OR e.EventData IS NOT NULL")
    pair = lambda k, c: F.struct(F.lit(k).alias("k"), c.alias("v"))
    system = F.array(pair("EventID", F.col("e.System.EventID")), pair("Channel", F.col("e.System.Channel")), pair("Computer", F.col("e.System.Computer")), pair("TimeCreated", F.col("e.System.TimeCreated._SystemTime")))
    data = F.transform(F.filter(F.coalesce("e.EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: F.coalesce(d["_Name"], F.lit("")) != ""), lambda d: F.struct(d["_Name"].alias("k"), F.coalesce(d["_VALUE"], F.lit("")).alias("v")))
    every = F.concat(F.filter(system, lambda s: s["v"].isNotNull()), data)
    # of a repeated name the last value counts
    last = F.filter(F.transform(every, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: ~F.exists(F.slice(every, x["i"] + 2, F.size(every)), lambda y: y["k"] == x["k"]))
    return e.select(F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))).alias("fields"))


def field_names(events: DataFrame, fields: str = "fields") -> DataFrame:
    """Distinct field names of events with a fields map: the surface on which rules and detectors can work."""
    return events.select(F.explode(F.map_keys(fields)).alias("field")).distinct()


def field_profile(events: DataFrame, fields: str = "fields", top: int = 5) -> DataFrame:
    """Per field: the share of events that have it, and its most common values (a top-k report)."""
    from pyspark.sql import Window

    total = events.agg(F.count("*").alias("total"))
    n = events.select(F.explode(fields).alias("field", "value")).groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    ranked = n.withColumns({"rank": F.row_number().over(w), "present": F.sum("n").over(Window.partitionBy("field"))}).where(F.col("rank") <= top)
    out = ranked.groupBy("field", "present").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("common"))
    return out.crossJoin(F.broadcast(total)).select("field", (F.col("present") / F.col("total")).alias("presence"), F.transform("common", lambda c: F.struct(c["value"].alias("value"), c["n"].alias("n"))).alias("common"))


def ground(attack: DataFrame, background: DataFrame, least_presence: float = 0.5) -> DataFrame:
    """Attack events, missing fields filled with the background's most common values, united with the background.

    Both have a fields map; the result adds label (true for attack events).
    """
    modes = field_profile(background, top=1).where(F.col("presence") >= least_presence).select("field", F.col("common")[0]["value"].alias("value"))
    fill = modes.agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fill"))
    own = attack.select("fields").crossJoin(F.broadcast(fill))
    filled = own.select(F.map_concat(F.map_filter("fill", lambda k, v: ~F.map_contains_key("fields", k)), F.col("fields")).alias("fields"), F.lit(True).alias("label"))
    return filled.unionByName(background.select("fields", F.lit(False).alias("label")))


# ---------------------------------------------------------------- sample streams


def float64_validity(payload: Column, least: int = 1) -> Column:
    """struct(valid, deviation): whether a payload is whole 8-byte samples, and enough of them."""
    n = F.coalesce(F.length(payload), F.lit(0))
    faults = F.array_compact(F.array(F.when(payload.isNull(), "missing"), F.when(n % 8 != 0, "truncated-sample"), F.when(F.floor(n / 8) < least, "too-few-samples")))
    return F.struct((F.size(faults) == 0).alias("valid"), faults.alias("deviation"))


def float64_samples(files: DataFrame, payload: str = "content") -> DataFrame:
    """Little-endian float64 payloads as arrays of samples; malformed ones give null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            got = [None if x is None or len(x) % 8 else np.frombuffer(x, "<f8").tolist() for x in b.column(b.schema.get_field_index(payload)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float64()))], names=[*b.schema.names, "samples"])

    schema = T.StructType([*files.schema.fields, T.StructField("samples", T.ArrayType(T.DoubleType()))])
    return files.mapInArrow(run, schema)


def attest(payload: Column, signed: bool = True, live: bool = True) -> Column:
    """Custody attestation of a payload: its digest and whether feed and signature are there."""
    return F.struct(F.sha2(payload.cast("binary"), 256).alias("digest"), F.lit(signed).alias("signed"), F.lit(live).alias("live"))


# ---------------------------------------------------------------- field normalisation


def normalise(events: DataFrame, mapping: list[tuple[str, str, str]], fields: str = "fields") -> DataFrame:
    """Rename source fields to target paths: mapping of (source, target, grade: exact, close or broad).

    Adds `target` (map of what could be mapped) and `grade`, the worst grade among mapped fields (null: nothing mapped).
    """
    rank = {"exact": 0, "close": 1, "broad": 2}
    entries = F.array(*[F.struct(F.lit(t).alias("k"), F.col(fields).getItem(s).alias("v")) for s, t, _ in mapping])
    worst = F.array_max(F.array_compact(F.array(*[F.when(F.col(fields).getItem(s).isNotNull(), F.lit(rank[g])) for s, _, g in mapping])))
    names = F.array(*map(F.lit, rank))
    return events.withColumns({"target": F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())), "grade": F.try_element_at(names, worst + 1)})
