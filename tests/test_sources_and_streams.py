import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import detectors
from tracewarden.sources import events, knowledge
from tracewarden.streaming import detect


def test_csv_and_projection(spark, tmp_path):
    p = tmp_path / "k.csv"
    p.write_text("_time,Client_Address,Account_Name\n1970-01-02 00:00:01.500000,::ffff:10.0.0.1,alice\nbad,10.0.0.2,bob\n")
    got = events.projected(events.csv_events(spark, str(p)), "Client_Address", "Account_Name").collect()
    assert [tuple(r) for r in got] == [(86401.5, "10.0.0.1", "alice")]


def test_cloudtrail(spark, tmp_path):
    recs = [
        {"eventTime": "1970-01-01T00:00:10Z", "eventName": "A", "awsRegion": "r1", "userIdentity": {"type": "IAMUser", "userName": "u"}},
        {"eventTime": "1970-01-01T00:00:20Z", "eventName": "B", "userIdentity": {"type": "AssumedRole", "userName": "", "arn": "arn:x/role/me"}},
        {"eventTime": "1970-01-01T00:00:30Z", "eventName": "B", "awsRegion": "r2", "userIdentity": {}},
    ]
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        json.dump({"Records": recs}, f)
    got = {tuple(r) for r in events.cloudtrail_events(spark, str(tmp_path / "t.json.gz")).collect()}
    assert got == {(10.0, "u", "r1", "A"), (20.0, "me", "-", "B"), (30.0, "-", "r2", "B")}
    assert events.cloudtrail_events(spark, str(tmp_path / "t.json.gz"), names=["A"]).count() == 1


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": true, "c": null}\nnot json\n{"a": "x"}\n')
    got = [r["fields"] for r in events.jsonl_events(spark, str(tmp_path / "a.jsonl")).collect()]
    assert got == [{"a": "1", "b": "true", "c": None}, {"a": "x"}]
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2, "z": "y"}]')
    assert [r["fields"]["a"] for r in events.json_events(spark, str(tmp_path / "b.json")).collect()] == ["1", "2"]
    assert events.json_events(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert {r[0] for r in events.field_names(events.json_events(spark, str(tmp_path / "b.json"))).collect()} == {"a", "z"}
    prof = {r["field"]: r["presence"] for r in events.field_profile(events.json_events(spark, str(tmp_path / "b.json"))).collect()}
    assert prof == {"a": 1.0, "z": 0.5}


def test_event_xml(spark, tmp_path):
    line = "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>4769</EventID><Channel>Security</Channel><Computer>dc</Computer><TimeCreated SystemTime='2024-01-01T00:00:00Z'/></System><EventData><Data Name='U'>bob</Data><Data Name='E'/><Data>anonymous</Data><Data Name='U'>eve</Data></EventData></Event>"
    (tmp_path / "e.xml").write_text(line + "\n\nnoise\n<Event broken\n")
    got = [r["fields"] for r in events.event_xml(spark, str(tmp_path / "e.xml")).collect()]
    assert got == [{"EventID": "4769", "Channel": "Security", "Computer": "dc", "TimeCreated": "2024-01-01T00:00:00Z", "E": "", "U": "eve"}]


def test_float_payloads(spark):
    import struct

    d = spark.createDataFrame([(bytearray(struct.pack("<2d", 1.5, -2.0)),), (bytearray(b"abc"),), (None,)], "content binary")
    v = [r["v"] for r in d.select(events.float64_validity(F.col("content")).alias("v")).collect()]
    assert [x["valid"] for x in v] == [True, False, False] and v[1]["deviation"] == ["truncated-sample", "too-few-samples"]
    assert [r["samples"] for r in events.float64_samples(d).collect()] == [[1.5, -2.0], None, None]


def test_ground_and_normalise(spark):
    back = spark.createDataFrame([({"a": "1", "b": "x"},), ({"a": "1"},), ({"a": "2", "b": "x"},)], "fields map<string,string>")
    got = events.ground(spark.createDataFrame([({"b": "evil"},)], "fields map<string,string>"), back).where("label").first()["fields"]
    assert got == {"a": "1", "b": "evil"}
    n = events.normalise(back.limit(1), [("a", "x.a", "exact"), ("b", "x.b", "close"), ("q", "x.q", "broad")]).first()
    assert n["target"] == {"x.a": "1", "x.b": "x"} and n["grade"] == "close"


def test_rule_files(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.yml").write_text(yaml.safe_dump({"id": "r1", "tags": ["attack.t1003.001", "attack.credential-access"], "logsource": {"product": "windows"}, "detection": {"s": {"f": 1}, "condition": "s"}}))
    (tmp_path / "sub" / "b.yml").write_text("correlation: {type: event_count}\nid: r2\n")
    (tmp_path / "c.yml").write_text("a: [unclosed\n")
    r = knowledge.yaml_rules(spark, str(tmp_path)).cache()
    assert {x["rule_id"]: x["reason"] for x in r.collect()} == {"r1": "ok", "r2": "correlation", None: "unparseable"}
    assert tuple(knowledge.parse_report(r).first()) == (3, 1, 1, 1)
    assert knowledge.rules_for_technique(r, "T1003.001").count() == 1 and knowledge.rules_for_tactic(r, "credential-access").count() == 1


def test_bundle_and_triples(spark, tmp_path):
    ap = lambda i, a, ph: {"id": i, "type": "attack-pattern", "name": i, "external_references": [{"source_name": "mitre-attack", "external_id": a}], "kill_chain_phases": [{"kill_chain_name": "m", "phase_name": p} for p in ph]}
    (tmp_path / "b.json").write_text(json.dumps({"objects": [ap("x", "T1", ["execution"]), ap("y", "T1.1", []), {"type": "relationship", "id": "r", "relationship_type": "subtechnique-of", "source_ref": "y", "target_ref": "x"}]}))
    b = knowledge.bundle(spark, str(tmp_path / "b.json"))
    assert {r["attack_id"] for r in b["techniques"].collect()} == {"T1", "T1.1"}
    assert [tuple(r) for r in b["parents"].collect()] == [("T1.1", "T1")] and [tuple(r) for r in b["tactics"].collect()] == [("T1", "execution")]
    (tmp_path / "t.nt").write_text('<u:a> <u:p> <u:b> .\n<u:a> a <u:C> .\n<u:a> <u:l> "say \\"hi\\""@en .\n# note\n')
    assert {r["o"] for r in knowledge.ntriples(spark, str(tmp_path / "t.nt")).collect()} == {"u:b", "u:C", 'say \\"hi\\"'}


def test_flows(spark, tmp_path):
    act = lambda i, t, nxt: {"id": i, "type": "attack-action", "technique_id": "T" + i, "tactic_id": t, "effect_refs": nxt}
    (tmp_path / "f.json").write_text(json.dumps({"objects": [act("1", "TA1", ["or"]), {"id": "or", "type": "attack-operator", "effect_refs": ["2", "3"]}, act("2", "TA2", []), act("3", "TA2", [])]}))
    m = knowledge.flow_model(knowledge.attack_flows(spark, str(tmp_path / "f.json")))
    assert [tuple(r) for r in m["transitions"].collect()] == [("TA1", "TA2", 2, 1.0)]
    assert [tuple(r) for r in m["starts"].collect()] == [("TA1", 1)]
    assert {(r["tactic"], r["p"]) for r in m["emissions"].collect()} == {("TA1", 1.0), ("TA2", 0.5)}


def _stream(spark, d, path):
    d.write.parquet(path)
    return spark.readStream.schema(d.schema).parquet(path)


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i // 20} {i % 20:02d}:00:00", f"u{i % 3}", f"v{i % 5}") for i in range(100)]
    d = spark.createDataFrame(rows, "ts string, e string, v string").withColumn("ts", F.to_timestamp("ts"))
    batch = {tuple(r) for r in detect.windowed_fanout(d, "e", "v", "ts").collect()}
    q = detect.windowed_fanout(_stream(spark, d, str(tmp_path / "in")), "e", "v", "ts").writeStream.format("memory").queryName("fan").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("fan").collect()}
    assert got and got <= batch and {r[1].day for r in got} >= {1, 2, 3}


def test_shadow_on_stream_equals_batch(spark, tmp_path):
    base = 1e9  # a stream drops what lies before 1970
    rows = [("a", base, "x"), ("a", base + 10, "y"), ("b", base, "x"), ("b", base + 1e6, "y"), (None, base, "x"), ("c", base + 5, "y"), ("c", base + 6, "x")]
    d = spark.createDataFrame(rows, "who string, t double, k string")
    r = detect.ShadowRules((detect.first_with("k", "x"), detect.first_with("k", "y")), fire_at=2, tau=100.0)
    batch = [tuple(x) for x in detect.shadow_alerts(d, r, "who", "t", ["k"]).collect()]
    assert [(x[0], x[1], x[3]) for x in batch] == [("a", 2, base + 10)]
    q = detect.shadow_alerts(_stream(spark, d, str(tmp_path / "in")), r, "who", "t", ["k"]).writeStream.format("memory").queryName("sh").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = [tuple(x) for x in spark.table("sh").collect()]
    assert got == batch, (got, batch)


def test_baseline_merges_batches(spark, tmp_path):
    d = spark.createDataFrame([("a", "1"), ("a", "3"), ("b", "x")], "e string, v string")
    step = detect.merge_baseline(str(tmp_path), lambda x: detectors.learn_baseline(x, "e", "v"), detectors.blend_baselines)
    for n in range(2):
        step(d, n)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "v1")).collect()] == [("a", 4, 8.0, 20.0)]


def test_posterior_fades_to_prior():
    now, peak = detect.posterior([(0.0, 5.0)], 0.01, 10.0, at=1000.0)
    assert abs(now - detect.posterior([], 0.01, 10.0)[0]) < 1e-9 and peak > now
