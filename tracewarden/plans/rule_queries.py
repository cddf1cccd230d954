"""Rule-matching queries: a small rule corpus fired at events, documents and pages, with SQL emitted from the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.operators import corpus, rules

from .detector_queries import table


def _rule(rule_id: str, detection: dict, tags: str, level: str = "medium", product: str = "app", category: str = "web") -> dict:
    return {"id": rule_id, "title": rule_id, "level": level, "tags": tags.split(), "logsource": {"product": product, "category": category}, "detection": detection}


#: Rules on events: fields event_type, value, user, k, props.
EVENT_RULES = [
    _rule("e01", {"selection": {"event_type": "error"}, "condition": "selection"}, "attack.t1078", "low"),
    _rule("e02", {"selection": {"event_type": ["purchase", "signup"], "value|gte": "80"}, "condition": "selection"}, "attack.t1078 attack.t1110", "high"),
    _rule("e03", {"selection": {"event_type|startswith": "PUR"}, "filter": {"k|lt": 50}, "condition": "selection and not filter"}, "attack.t1110.003"),
    _rule("e04", {"sel_a": {"event_type|contains": "ick"}, "sel_b": {"k|re": "^[0-9]7$"}, "condition": "all of sel_*"}, "attack.t1059"),
    _rule("e05", {"a": {"event_type": "view"}, "b": {"value|gt": 50}, "c": {"k|gte": 90}, "condition": "2 of them"}, "attack.t1059 attack.t1003.001", "high"),
    _rule("e06", {"keywords": ["sign", "err*r"], "condition": "keywords"}, "attack.t1087"),
    _rule("e07", {"selection": [{"event_type": "click", "k": "1?"}, {"event_type": "view", "k": "2*"}], "condition": "selection"}, "attack.t1087 attack.t1046"),
    _rule("e08", {"selection": {"event_type|endswith": ["se", "up"]}, "filter_low": {"value|lte": 20}, "filter_k": {"k|endswith": "5"}, "condition": "selection and not 1 of filter*"}, "attack.t1046", "critical"),
    _rule("e09", {"selection": {"missing": ""}, "condition": "selection"}, "attack.t1003.001", "informational"),
    _rule("e10", {"selection": {"event_type|contains|all": ["e", "r"]}, "condition": "not selection"}, "attack.t1558.003"),
    _rule("e11", {"selection": {"user|re": "^1?[37]$"}, "other": {"event_type": "error"}, "condition": "(selection or other) and not (selection and other)"}, "attack.t1558.003", "high"),
    _rule("e12", {"selection": {"event_type|startswith": "pur"}, "filter": {"k|lt": 50}, "condition": "selection and not filter"}, "attack.t1110", "critical"),
    _rule("e13", {"selection": {"event_type": "error", "value|lt": 10}, "condition": "1 of selection"}, "attack.t1078"),
    _rule("e14", {"selection": {"props|contains": "\"k\": 4"}, "condition": "selection"}, "attack.t1046", "low"),
    _rule("e15", {"selection": {"value|gt": "abc"}, "condition": "selection or 0 of them"}, "attack.t1087", "low"),
    _rule("e16", {"selection": {"event_type|contains": "r"}, "condition": "selection and nothing"}, "attack.t1003"),
]

DOCUMENT_RULES = [
    _rule("d01", {"selection": {"text|contains": ["license", "copyright"]}, "condition": "selection"}, "attack.t1005"),
    _rule("d02", {"selection": {"text|re": "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}"}, "condition": "selection"}, "attack.t1590"),
    _rule("d03", {"selection": {"lang": ["fr", "ES"]}, "filter": {"text|contains": "|"}, "condition": "selection and not filter"}, "attack.t1005"),
    _rule("d04", {"selection": {"text|startswith": "the "}, "condition": "selection"}, "attack.t1213"),
    _rule("d05", {"selection": {"text|endswith": "*.?"}, "n": {"n_chars|gt": 5000}, "condition": "selection and n"}, "attack.t1213"),
    _rule("d06", {"keywords": ["@example.", "api_key", "BEGIN * KEY"], "condition": "keywords"}, "attack.t1552.001"),
    _rule("d07", {"a": {"source": "src?"}, "b": {"source|startswith": "src1"}, "condition": "a or b"}, "attack.t1213"),
    _rule("d08", {"selection": {"text|contains|all": ["ñ", "É"]}, "condition": "selection"}, "attack.t1213"),
    _rule("d09", {"selection": {"text|contains": "a\\*b"}, "condition": "not selection"}, "attack.t1213"),
]

PAGE_RULES = [
    _rule("p01", {"selection": {"url|contains": ["spam-farm", "cheap-pills"]}, "condition": "selection"}, "attack.t1566"),
    _rule("p02", {"selection": {"url|startswith": "http://"}, "filter": {"url|contains": "www."}, "condition": "selection and not filter"}, "attack.t1566.002"),
    _rule("p03", {"selection": {"url|endswith": [".html", "/"]}, "condition": "selection"}, "attack.t1566"),
    _rule("p04", {"selection": {"html|contains": "<script>*track(*)"}, "condition": "selection"}, "attack.t1189"),
    _rule("p05", {"selection": {"url|re|i": "UTM_[a-z]+="}, "condition": "selection"}, "attack.t1189"),
    _rule("p06", {"selection": {"page_id|gte": 10, "url|contains": "/en/"}, "condition": "selection"}, "attack.t1189"),
]

#: Raw rules that can't be compiled, one per reason, and some that can.
AUDIT_RULES = [
    *EVENT_RULES,
    {"id": "x1", "correlation": {"type": "event_count"}},
    {"id": "x2", "title": "no detection"},
    {"id": "x3", "detection": {"selection": {"a": 1}}},
    {"id": "x4", "detection": {"selection": {"a": 1}, "condition": "selection | count() > 5"}},
    {"id": "x5", "detection": {"condition": "selection"}},
    {"id": "x6", "detection": {"selection": {"a": {"b": 1}}, "condition": "selection"}},
    {"id": "x7", "detection": {"selection": {"a|base64": "x"}, "condition": "selection"}},
    {"id": "x8", "detection": {"selection": [["a"]], "condition": "selection"}},
    {"id": "x9", "detection": {"selection": {"a": 1}, "condition": "selection and"}},
]

_E = {"event_type": "event_type", "value": "value", "user": "user", "k": "k", "props": "props"}
_D = {"text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}
_P = {"url": "url", "html": "html", "page_id": "page_id"}


def _compiled(raw: list[dict]) -> list[rules.Rule]:
    return [rules.compile_rule(r) for r in raw]


def _events(spark, f):
    e = table(spark, f, "events")
    return e.select("event_id", "event_type", F.col("value").cast("string").alias("value"), F.col("user_id").cast("string").alias("user"), F.get_json_object("props", "$.k").alias("k"), "props")


def rules_events(spark, f):
    return rules.fire(_events(spark, f), _compiled(EVENT_RULES), ["event_id"], *rules.column_access(_E))


def rules_documents(spark, f):
    return rules.fire(table(spark, f, "documents"), _compiled(DOCUMENT_RULES), ["doc_id"], *rules.column_access(_D))


def rules_pages(spark, f):
    return rules.fire(table(spark, f, "pages"), _compiled(PAGE_RULES), ["page_id"], *rules.column_access(_P))


def rule_hits(spark, f):
    return rules_events(spark, f).groupBy("rule_id").agg(F.count("*").alias("hits"))


def rules_direct(spark, f):
    return rules.fire_direct(_events(spark, f), _compiled(EVENT_RULES), ["event_id"], *rules.column_access(_E))


def rule_atoms_truth(spark, f):
    return rules.atom_truth(_events(spark, f), _compiled(EVENT_RULES), ["event_id"], *rules.column_access(_E)).groupBy("atom_id").agg(F.count("*").alias("n_true"), F.min("event_id").alias("first_event"))


def rule_selectivity(spark, f):
    return rules.selectivity(_events(spark, f), _compiled(EVENT_RULES), *rules.column_access(_E)).withColumn("share", F.round("share", 9))


def rule_engine_agreement(spark, f):
    """Hits of both engines per rule, and hits that only one of them has."""
    a = rules_events(spark, f).withColumn("one", F.lit(1))
    b = rules_direct(spark, f).withColumn("two", F.lit(1))
    j = a.join(b, ["event_id", "rule_id"], "full")
    return j.groupBy("rule_id").agg(F.count("one").alias("shared_atoms"), F.count("two").alias("direct"), F.sum(F.when(F.col("one").isNull() | F.col("two").isNull(), 1).otherwise(0)).alias("differ"))


def rule_round(spark, f):
    """Applicable rules, best peer per content, ranked by severity and hits."""
    return corpus.evaluate_round(_events(spark, f), EVENT_RULES, rules.column_access(_E), set(_E), ["event_id"])


def rule_audit(spark, f):
    rows = [(str(r["id"]), *rules.evaluability(r)) for r in AUDIT_RULES]
    return spark.createDataFrame(rows, "rule_id string, ok boolean, reason string").groupBy("reason").agg(F.count("*").alias("n"))


def rule_panel(spark, f):
    """Rules per technique, grouped by what they match: classes, classes that fire, and whether they corroborate."""
    return corpus.panel(rules_events(spark, f), _compiled(EVENT_RULES))


def rule_cofire(spark, f):
    """Per rule: labelled instances caught, and hits on others."""
    labels = _events(spark, f).select("event_id", (F.col("event_type") == "error").alias("positive"))
    return corpus.cofire(rules_events(spark, f), labels, "event_id", [r["id"] for r in EVENT_RULES], spark)


def rule_catch_sets(spark, f):
    """Rules grouped by the identical set of events they catch."""
    return corpus.group_by_catch_set(rules_events(spark, f), "event_id")


QUERIES = {x.__name__: x for x in (rules_events, rules_documents, rules_pages, rule_hits, rules_direct, rule_atoms_truth, rule_selectivity, rule_engine_agreement, rule_round, rule_audit, rule_panel, rule_cofire, rule_catch_sets)}


_EV_SQL = "(SELECT event_id, event_type, CAST(value AS VARCHAR) AS value, CAST(user_id AS VARCHAR) AS \"user\", json_extract_string(props, '$.k') AS k, props FROM events)"


def _sql_access(fields: dict[str, str]):
    return (lambda n: f'"{fields[n]}"' if n in fields else "''"), (lambda: [f'CAST("{c}" AS VARCHAR)' for c in fields.values()])


def _fire_sql(raw: list[dict], source: str, key: str, fields: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{r.rule_id}' AS rule_id FROM {source} WHERE {rules.rule_sql(r, *_sql_access(fields))}" for r in _compiled(raw))


_FIRED = _fire_sql(EVENT_RULES, _EV_SQL, "event_id", _E)
_TRUTH = " UNION ALL ".join(f"SELECT event_id, '{i}' AS atom_id FROM {_EV_SQL} WHERE {rules.clause_sql(a, *_sql_access(_E))}" for i, a in rules.collect_atoms(_compiled(EVENT_RULES)).items())
_ATOMS = ", ".join(f"('{i}')" for i in rules.collect_atoms(_compiled(EVENT_RULES)))


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows) + ")"


_ROUND = corpus.select_rules(EVENT_RULES, set(_E))
_PANEL = corpus.panel_classes(_compiled(EVENT_RULES))

ORACLES = {
    "rules_events": _FIRED,
    "rules_documents": _fire_sql(DOCUMENT_RULES, "documents", "doc_id", _D),
    "rules_pages": _fire_sql(PAGE_RULES, "pages", "page_id", _P),
    "rules_direct": _FIRED,
    "rule_hits": f"SELECT rule_id, count(*) AS hits FROM ({_FIRED}) GROUP BY 1",
    "rule_atoms_truth": f"SELECT atom_id, count(*) AS n_true, min(event_id) AS first_event FROM ({_TRUTH}) GROUP BY 1",
    "rule_selectivity": f"SELECT a.atom_id, count(t.event_id) AS n_true, round(count(t.event_id) / (SELECT count(*) FROM events), 9) AS share FROM (VALUES {_ATOMS}) a(atom_id) LEFT JOIN ({_TRUTH}) t ON a.atom_id = t.atom_id GROUP BY 1",
    "rule_engine_agreement": f"SELECT rule_id, count(*) AS shared_atoms, count(*) AS direct, CAST(0 AS BIGINT) AS differ FROM ({_FIRED}) GROUP BY 1",
    "rule_round": f"""WITH r(rule_id, level, severity) AS (SELECT * FROM {_values([(r.rule_id, r.level, corpus.SEVERITY.get(r.level, 0)) for r in _ROUND])}),
h AS (SELECT rule_id, count(*) AS hits FROM ({_FIRED}) GROUP BY 1)
SELECT rule_id, level, severity, hits, CAST(row_number() OVER (ORDER BY severity DESC, hits DESC, rule_id) AS INTEGER) AS place FROM r JOIN h USING (rule_id)""",
    "rule_audit": f"SELECT reason, count(*) AS n FROM {_values([(str(r['id']), rules.evaluability(r)[1]) for r in AUDIT_RULES])} t(rule_id, reason) GROUP BY 1",
    "rule_panel": f"""WITH c(technique, rule_id, class) AS (SELECT * FROM {_values(_PANEL)}), f AS (SELECT DISTINCT rule_id FROM ({_FIRED})),
k AS (SELECT technique, class, bool_or(f.rule_id IS NOT NULL) AS fires FROM c LEFT JOIN f USING (rule_id) GROUP BY ALL)
SELECT technique, (SELECT count(*) FROM c WHERE c.technique = k.technique) AS n_rules, count(*) AS n_classes, CAST(sum(CAST(fires AS INT)) AS BIGINT) AS votes,
       CASE WHEN count(*) = 1 THEN 'single' WHEN sum(CAST(fires AS INT)) >= 2 THEN 'corroborated' WHEN sum(CAST(fires AS INT)) = 1 THEN 'lone' ELSE 'silent' END AS category FROM k GROUP BY technique""",
    "rule_cofire": f"""WITH r(rule_id) AS (SELECT * FROM {_values([(r["id"],) for r in EVENT_RULES])}), p AS (SELECT event_id, event_type = 'error' AS positive FROM events),
h AS (SELECT rule_id, count(*) FILTER (WHERE positive) AS caught, count(*) FILTER (WHERE NOT positive) AS false_positives FROM ({_FIRED}) JOIN p USING (event_id) GROUP BY 1)
SELECT rule_id, coalesce(caught, 0) AS caught, coalesce(false_positives, 0) AS false_positives, round(coalesce(caught, 0) / (SELECT count(*) FROM p WHERE positive), 9) AS catch_rate FROM r LEFT JOIN h USING (rule_id)""",
    "rule_catch_sets": f"""WITH s AS (SELECT rule_id, list(event_id ORDER BY event_id) AS s FROM ({_FIRED}) GROUP BY 1)
SELECT array_to_string(list(rule_id ORDER BY rule_id), ',') AS rules, count(*) AS n_rules, any_value(len(s)) AS n_caught FROM s GROUP BY s""",
}
