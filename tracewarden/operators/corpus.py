"""Analytics over rule corpora: rounds, panels, catch sets, token lattices, concept groups, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rules as r

#: Rank of severity levels (fixed values).
SEVERITY = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
CLOSE = 0.6


# ---------------------------------------------------------------- rounds and panels


def select_rules(raw: list[dict], present: set[str]) -> list[r.Rule]:
    """Evaluable rules whose fields are all present; of rules with equal content the one with most clauses, first on ties."""
    best: dict[str, r.Rule] = {}
    for rule in (r.compile_rule(x) for x in raw if r.evaluability(x)[0]):
        if rule.fields() <= present:
            key = rule.content_digest()
            if key not in best or len(rule.atoms()) > len(best[key].atoms()):
                best[key] = rule
    return list(best.values())


def evaluate_round(events: DataFrame, raw: list[dict], access: tuple[Callable, Callable], present: set[str], keys: list[str]) -> DataFrame:
    """Fire the applicable rules and rank those that hit: rule_id, level, severity, hits, place."""
    chosen = select_rules(raw, present)
    spark = events.sparkSession
    info = spark.createDataFrame([(x.rule_id, x.level, SEVERITY.get(x.level, 0)) for x in chosen], "rule_id string, level string, severity int")
    hits = r.fire(events, chosen, keys, *access).groupBy("rule_id").agg(F.count("*").alias("hits"))
    w = Window.orderBy(F.desc("severity"), F.desc("hits"), "rule_id")  # over rules that hit, never over events
    return F.broadcast(info).join(hits, "rule_id").withColumn("place", F.row_number().over(w))


def panel_classes(rules: list[r.Rule]) -> list[tuple[str, str, str]]:
    """(technique, rule_id, class): rules are of one class if they test the same fields."""
    return [(t, x.rule_id, ",".join(sorted(x.fields())) or "keywords") for x in rules for t in x.techniques]


def panel(hits: DataFrame, rules: list[r.Rule]) -> DataFrame:
    """Per technique: rules, classes, classes with a rule that fires (votes), and what that amounts to."""
    spark = hits.sparkSession
    info = spark.createDataFrame(panel_classes(rules), "technique string, rule_id string, class string")
    fired = hits.select("rule_id").distinct().withColumn("fires", F.lit(True))
    per = info.join(fired, "rule_id", "left").groupBy("technique", "class").agg(F.count("*").alias("n"), F.max(F.coalesce("fires", F.lit(False))).alias("fires"))
    out = per.groupBy("technique").agg(F.sum("n").alias("n_rules"), F.count("*").alias("n_classes"), F.sum(F.col("fires").cast("long")).alias("votes"))
    kind = F.when(F.col("n_classes") == 1, "single").when(F.col("votes") >= 2, "corroborated").when(F.col("votes") == 1, "lone").otherwise("silent")
    return out.withColumn("category", kind)


def cofire(hits: DataFrame, labels: DataFrame, key: str, rule_ids: list[str], spark: SparkSession) -> DataFrame:
    """Per rule: labelled positives caught, other events hit, and the share of positives caught."""
    total = labels.where("positive").agg(F.count("*").alias("total"))
    n = hits.join(labels, key).groupBy("rule_id").agg(F.count_if("positive").alias("caught"), F.count_if(~F.col("positive")).alias("false_positives"))
    all_rules = spark.createDataFrame([(x,) for x in rule_ids], "rule_id string")
    out = all_rules.join(n, "rule_id", "left").na.fill(0, ["caught", "false_positives"]).crossJoin(F.broadcast(total))
    return out.select("rule_id", "caught", "false_positives", F.round(F.col("caught") / F.col("total"), 9).alias("catch_rate"))


def catch_digest(hits: DataFrame, key: str) -> DataFrame:
    """Per rule a digest of the set of events it catches, from mergeable sums of event hashes, and the set's size.

    Two independent 64-bit sums and the size stand for the set, so that no set is ever gathered in one place.
    """
    h = [F.xxhash64(F.col(key), F.lit(s)).cast("decimal(38,0)") for s in (1, 2)]
    one = hits.select("rule_id", key).distinct()
    return one.groupBy("rule_id").agg(F.sum(h[0]).alias("h1"), F.sum(h[1]).alias("h2"), F.count("*").alias("n_caught"))


def group_by_catch_set(hits: DataFrame, key: str) -> DataFrame:
    """Rules that catch exactly the same events: rules (ids joined by commas), n_rules, n_caught."""
    g = catch_digest(hits, key).groupBy("h1", "h2", "n_caught").agg(F.sort_array(F.collect_list("rule_id")).alias("ids"))
    return g.select(F.array_join("ids", ",").alias("rules"), F.size("ids").cast("long").alias("n_rules"), "n_caught")


# ---------------------------------------------------------------- token lattices


def token_idf(tokens: DataFrame, item: str, token: str) -> DataFrame:
    """Per token: items that have it, and ln(items / that)."""
    d = tokens.select(item, token).distinct()
    n = d.agg(F.countDistinct(item).alias("n"))
    df = d.groupBy(token).agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select(token, "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def lattice_edges(tokens: DataFrame, item: str, token: str, close: float = CLOSE, weighted: bool = True, least: float = 0.0) -> DataFrame:
    """Relations between classes of items with equal token sets: a, b (a < b, the classes' smallest items), rel, tightness;
    and exact ones from each class to its other members, with tightness 1.

    Between classes: broader (a has fewer tokens, all in b), narrower, related; broader relations aside, close where the
    weight of the common tokens over that of all is at least `close`. Without weight, sizes decide. What holds between two
    classes holds between all their members, so copies cost their number and not their pairs.

    With least > 0 only relations of at least that tightness come out, and classes meet on rare tokens alone: a pair that
    tight must share one among the rarest of each that make up all but less than `least` of its weight.
    """
    d = tokens.select(F.col(item).alias("item"), F.col(token).alias("token")).distinct()
    idf = token_idf(d, "item", "token").withColumn("w", F.col("idf") if weighted else F.lit(1.0)).select("token", "w", "df")
    of = classes_of(d, "item", "token")
    d = d.join(of.where("item = class_id").select("item"), "item").join(idf, "token")
    per = d.groupBy("item").agg(F.count("*").alias("n"), F.sum("w").alias("m"))
    key = d
    if least > 0:
        rare = Window.partitionBy("item").orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        key = d.withColumn("rest", F.sum("w").over(rare)).join(per, "item").where(F.col("rest") >= least * F.col("m") - 1e-9).select("item", "token", "w")
    meet = key.select(F.col("item").alias("a"), "token").join(key.select(F.col("item").alias("b"), "token"), "token").where("a < b")
    a, b = d.select(F.col("item").alias("a"), "token", "w"), d.select(F.col("item").alias("b"), "token")
    if least > 0:
        shared = meet.select("a", "b").distinct().join(a, "a").join(b, ["b", "token"])
    else:
        shared = meet.join(a, ["a", "token"])
    both = shared.groupBy("a", "b").agg(F.count("*").alias("k"), F.sum("w").alias("shared"))
    rows = both.join(per.select(F.col("item").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma")), "a").join(per.select(F.col("item").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb")), "b")
    weight = F.col("ma") + F.col("mb") - F.col("shared")
    plain = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    tight = F.round(F.when(weight > 1e-12, F.col("shared") / weight).otherwise(plain), 3)
    rel = F.when(F.col("k") == F.col("na"), "broader").when(F.col("k") == F.col("nb"), "narrower")
    rows = rows.select("a", "b", F.coalesce(rel, F.when(tight >= close, "close").otherwise("related")).alias("rel"), tight.alias("tightness"))
    copies = of.where("item > class_id").select(F.col("class_id").alias("a"), F.col("item").alias("b"), F.lit("exact").alias("rel"), F.lit(1.0).alias("tightness"))
    return (rows.where(F.col("tightness") >= least) if least > 0 else rows).unionByName(copies)


def classes_of(tokens: DataFrame, item: str, token: str) -> DataFrame:
    """(item, class_id): items with equal token sets share the smallest item as class_id."""
    per = tokens.select(item, token).distinct().groupBy(item).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(token)), "\x1f"), 256).alias("h"))
    low = per.groupBy("h").agg(F.min(item).alias("class_id"))
    return per.join(low, "h").select(item, "class_id")


def concept_groups(tokens: DataFrame, items: DataFrame, item: str, token: str) -> DataFrame:
    """Items grouped by identical token sets, the empty one included: tokens, members, the first member."""
    d = tokens.select(item, token).distinct().groupBy(item).agg(F.array_join(F.sort_array(F.collect_list(token)), " ").alias("tokens"))
    d = items.select(item).distinct().join(d, item, "left").withColumn("tokens", F.coalesce("tokens", F.lit("")))
    return d.groupBy("tokens").agg(F.count("*").alias("members"), F.min(item).alias("first"))


def over_collapse(items: DataFrame, blind: list[Column], aware: list[Column], by: Column, least: int = 10) -> DataFrame:
    """Per slice with at least `least` items: distinct keys under two projections and their ratio."""
    d = items.select(by.alias("slice"), F.to_json(F.array(*[c.cast("string") for c in blind])).alias("b"), F.to_json(F.array(*[c.cast("string") for c in aware])).alias("a"))
    out = d.groupBy("slice").agg(F.count("*").alias("n"), F.countDistinct("b").alias("blind"), F.countDistinct("a").alias("aware"))
    return out.where(F.col("n") >= least).withColumn("ratio", F.col("aware") / F.col("blind"))


def cross_corpus(tokens: DataFrame, corpus: str, token: str) -> DataFrame:
    """Per token the corpora that have it; counted by that set: corpora, n_tokens."""
    d = tokens.select(corpus, token).distinct().groupBy(token).agg(F.array_join(F.sort_array(F.collect_set(corpus)), "+").alias("corpora"))
    return d.groupBy("corpora").agg(F.count("*").alias("n_tokens"))


def coverage_tiers(items: DataFrame, key: str, direct: DataFrame, bridged: DataFrame, coarse: DataFrame, reference: DataFrame) -> DataFrame:
    """First tier that applies to each item: direct, bridged, coarse, uncovered (has a reference only), no-reference."""
    out = items.select(key).distinct()
    for name, d in (("direct", direct), ("bridged", bridged), ("coarse", coarse), ("uncovered", reference)):
        out = out.join(d.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    tier = F.when(F.col("direct"), "direct").when(F.col("bridged"), "bridged").when(F.col("coarse"), "coarse").when(F.col("uncovered"), "uncovered").otherwise("no-reference")
    return out.select(key, tier.alias("tier"))
