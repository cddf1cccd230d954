"""Synthetic organisations, activity with causal labels, and tickets: every row is a function of its key and a seed.

Nothing is drawn in sequence, so tables of any size are made where they are needed, by all tasks, and the same again after a
lost one. draw() is a digest, which other engines can state, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
START = 1_704_067_200  # 2024-01-01

RC4, AES = "0x17", "0x12"

#: Ways to roast: the tool, its command line, and which of the requested tickets are weakly encrypted.
VARIANTS = {
    "rubeus": ("C:\\Tools\\Rubeus.exe", "Rubeus.exe kerberoast /nowrap", "all"),
    "powershell": ("C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe", "powershell.exe -c Invoke-Kerberoast", "all"),
    "setspn": ("C:\\Windows\\System32\\setspn.exe", "setspn.exe -Q */*", "pivot"),
    "aes": ("C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe", "powershell.exe Get-DomainSPNTicket", "none"),
}


def draw(seed: int, *keys: Column | str) -> Column:
    """Uniform number in [0, 1) of a seed and keys: the first 32 bits of a digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_sql(seed: int, *keys: str) -> str:
    """draw() in DuckDB's SQL."""
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


def pick(n: int | Column, seed: int, *keys: Column | str) -> Column:
    """A number from 0 to n - 1."""
    return F.floor(draw(seed, *keys) * n).cast("int")


def ticket_id(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256), 1, 32)


# ---------------------------------------------------------------- organisation


def organisation(spark: SparkSession, users: int = 40, workstations: int = 15, servers: int = 4, services: int = 12, domain: str = "corp.local", seed: int = 7) -> dict[str, DataFrame]:
    """hosts(host, kind, ip, sensitive), users(user, host), services(n, spn, account, host, crackable).

    A third of the services run under an account whose password can be cracked, the first among them.
    """
    if min(users, workstations, servers, services) < 1:
        raise ValueError("an organisation has users, workstations, servers and services")
    name = lambda stem, c: F.concat(F.lit(stem), F.lpad(c.cast("string"), 5, "0"))
    ip = lambda net, c: F.concat_ws(".", F.lit(net), F.floor(c / 250).cast("string"), (c % 250 + 1).cast("string"))
    i = F.col("id")
    dc = spark.range(1).select(F.lit("dc00000").alias("host"), F.lit("dc").alias("kind"), F.lit("10.0.0.1").alias("ip"), F.lit(True).alias("sensitive"))
    srv = spark.range(servers).select(name("srv", i).alias("host"), F.lit("server").alias("kind"), ip("10.2", i).alias("ip"), (i % 2 == 0).alias("sensitive"))
    ws = spark.range(workstations).select(name("ws", i).alias("host"), F.lit("workstation").alias("kind"), ip("10.1", i).alias("ip"), F.lit(False).alias("sensitive"))
    people = spark.range(users).select(name("user", i).alias("user"), name("ws", pick(workstations, seed, F.lit("desk"), i)).alias("host"))
    host = name("srv", pick(servers, seed, F.lit("service"), i))
    svc = spark.range(services).select(i.alias("n"), F.concat(F.lit("svc"), i.cast("string"), F.lit("/"), host, F.lit("." + domain)).alias("spn"), name("sa", i).alias("account"), host.alias("host"), (i % 3 == 0).alias("crackable"))
    return {"hosts": dc.union(srv).union(ws), "users": people, "services": svc}


def timeline(org: dict[str, DataFrame], days: int = 5, roasters: int = 3, fanout: int = 10, logon_share: float = 0.4, variants: tuple[str, ...] = ("rubeus",), forgeries: bool = False, seed: int = 7) -> DataFrame:
    """Activity of an organisation: t, actor, action, src, dst, target, enc, logon_type, image, cmdline, tgt, tgs, label.

    Every user authenticates each morning from the own workstation, asks for one to three tickets, and at times logs on to a
    sensitive server; service accounts log on at home. The roasters (those with the smallest draws) authenticate, start a
    tool, ask for `fanout` distinct services of which one can be cracked, and the cracked account then logs on from their
    workstation to a sensitive server: these rows carry label `roast:user`. With forgeries, one ticket is presented from a
    workstation it was not issued to, and two were never issued, one of them to an account that does not exist.
    """
    spark = org["users"].sparkSession
    n = org["services"].count()
    if fanout > n:
        raise ValueError(f"a fan-out of {fanout} needs as many services, not {n}")
    weak = [r["n"] for r in org["services"].where("crackable").select("n").orderBy("n").limit(10_000).collect()]
    goal = [r["host"] for r in org["hosts"].where("sensitive").select("host").orderBy("host").limit(10_000).collect()]
    goals, weaks = F.array(*map(F.lit, goal)), F.array(*map(F.lit, weak))
    spns = org["services"].select(F.col("n").alias("k"), F.col("spn").alias("target"), F.col("account"))
    dc = F.lit("dc00000")
    empty = {c: F.lit(None).cast("string") for c in ("dst", "target", "enc", "logon_type", "image", "cmdline", "tgt", "tgs", "label")}

    def rows(d: DataFrame, action: str, t: Column, **own: Column) -> DataFrame:
        cols = {"t": t.cast("double"), "actor": F.col("user"), "action": F.lit(action), "src": F.col("host")} | empty | own
        return d.select(*[c.cast("string").alias(k) if k != "t" else c.alias(k) for k, c in cols.items()])

    day = org["users"].crossJoin(F.broadcast(spark.range(days).withColumnRenamed("id", "day")))
    day = day.withColumn("s", F.lit(START + 7 * 3600) + F.col("day") * DAY + pick(3 * 3600, seed, F.lit("morning"), "user", "day"))
    day = day.withColumn("ticket", ticket_id(F.lit(seed), "user", "s"))
    out = rows(day, "authenticate", F.col("s"), dst=dc, enc=F.lit(AES), tgt=F.col("ticket"))
    out = out.union(rows(day, "logon", F.col("s") + 5, dst=F.col("host"), logon_type=F.lit("2")))
    asks = day.withColumn("j", F.explode(F.sequence(F.lit(0), pick(3, seed, F.lit("asks"), "user", "day"))))
    asks = asks.withColumn("k", pick(n, seed, F.lit("spn"), "user", "day", "j").cast("long")).join(spns, "k")
    asked = F.col("s") + 10 + pick(7190, seed, F.lit("asked"), "user", "day", "j")
    out = out.union(rows(asks, "request_ticket", asked, dst=dc, target=F.col("target"), enc=F.lit(AES), tgt=F.col("ticket"), tgs=ticket_id(F.lit(seed), "user", "target", asked)))
    visit = day.where(draw(seed, F.lit("visit"), "user", "day") < logon_share)
    out = out.union(rows(visit, "logon", F.col("s") + 60 + pick(7140, seed, F.lit("visited"), "user", "day"), dst=F.element_at(goals, pick(len(goal), seed, F.lit("goal"), "user", "day") + 1), logon_type=F.lit("3")))
    home = org["services"].select(F.col("account").alias("user"), "host").crossJoin(F.broadcast(spark.range(days).withColumnRenamed("id", "day"))).where(draw(seed, F.lit("service"), "user", "day") < 0.5)
    out = out.union(rows(home, "logon", F.lit(START) + F.col("day") * DAY + pick(DAY, seed, F.lit("at"), "user", "day"), dst=F.col("host"), logon_type=F.lit("5")))

    # roasters: few, as a parameter says
    bad = org["users"].withColumn("d", draw(seed, F.lit("roaster"), "user")).orderBy("d", "user").limit(roasters)
    names = sorted(r["user"] for r in bad.select("user").collect())
    which = {u: variants[i % len(variants)] for i, u in enumerate(names)}
    table = spark.createDataFrame([(u, v, *VARIANTS[v]) for u, v in which.items()], "user string, variant string, image string, cmdline string, weak string")
    bad = org["users"].join(F.broadcast(table), "user")
    bad = bad.withColumn("s", F.lit(START + 11 * 3600) + pick(days, seed, F.lit("on"), "user").cast("long") * DAY + pick(4 * 3600, seed, F.lit("noon"), "user"))
    bad = bad.withColumns({"ticket": ticket_id(F.lit(seed), "user", "s"), "mark": F.concat(F.lit("roast:"), "user"), "pivot": F.element_at(weaks, pick(len(weak), seed, F.lit("pivot"), "user") + 1)})
    out = out.union(rows(bad, "authenticate", F.col("s"), dst=dc, enc=F.lit(RC4), tgt=F.col("ticket"), label=F.col("mark")))
    out = out.union(rows(bad, "process_create", F.col("s") + 30, dst=F.col("host"), target=F.element_at(F.split("image", r"\\"), -1), image=F.col("image"), cmdline=F.col("cmdline"), label=F.col("mark")))
    fan = bad.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))).withColumn("k", F.pmod(F.col("pivot") + F.col("j"), F.lit(n))).join(spns, "k")
    enc = F.when((F.col("weak") == "all") | ((F.col("weak") == "pivot") & (F.col("j") == 0)), RC4).otherwise(AES)
    out = out.union(rows(fan, "request_ticket", F.col("s") + 60 + F.col("j") * 3, dst=dc, target=F.col("target"), enc=enc, tgt=F.col("ticket"), tgs=ticket_id(F.lit(seed), "user", "target", "j"), label=F.col("mark")))
    late = bad.join(spns, F.col("pivot") == F.col("k"))
    out = out.union(rows(late, "logon", F.col("s") + 1800 + pick(9000, seed, F.lit("late"), "user"), actor=F.col("account"), dst=F.element_at(goals, pick(len(goal), seed, F.lit("jewel"), "user") + 1), logon_type=F.lit("3"), label=F.col("mark")))
    if not forgeries:
        return out
    two = org["users"].orderBy("user").limit(2).collect()
    other = org["users"].where(F.col("host") != two[0]["host"]).orderBy("user").select("host").limit(1).collect()
    first = org["services"].orderBy("n").select("spn").first()["spn"]
    at = START + 2 * DAY + 12 * 3600
    forged = [("ptt", two[0]["user"], other[0]["host"] if other else two[0]["host"], at), ("golden", two[-1]["user"], two[-1]["host"], at + DAY), ("golden", "ghost", two[-1]["host"], at + DAY + 3600)]
    f = spark.createDataFrame(forged, "kind string, user string, host string, s long")
    stolen = day.where((F.col("user") == two[0]["user"]) & (F.col("day") == min(2, days - 1))).select(F.col("user").alias("owner"), F.col("ticket").alias("theirs"))
    f = f.join(F.broadcast(stolen), (F.col("owner") == F.col("user")) & (F.col("kind") == "ptt"), "left").withColumn("ticket", F.coalesce("theirs", ticket_id(F.lit("forged"), F.lit(seed), "user")))
    return out.union(rows(f, "request_ticket", F.col("s"), dst=dc, target=F.lit(first), enc=F.lit(RC4), tgt=F.col("ticket"), tgs=ticket_id(F.lit("tgs"), "ticket"), label=F.concat_ws(":", "kind", "user")))


# ---------------------------------------------------------------- logs

_CODES = {"authenticate": "4768", "request_ticket": "4769", "logon": "4624", "process_create": "1"}
SECURITY, SYSMON = "Security", "Microsoft-Windows-Sysmon/Operational"


def log_events(acts: DataFrame, org: dict[str, DataFrame], ticket_hashes: bool = False) -> DataFrame:
    """Activity as events where they would be logged: t, host, channel, fields (map), label.

    Ticket events go to the domain controller, logons to where one logs on, processes to their own host. Controllers that
    are not patched leave the ticket hashes out.
    """
    code = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])[F.col("action")]
    d = acts.join(org["hosts"].select(F.col("host").alias("src"), F.col("ip")), "src", "left").withColumn("code", code).where("code IS NOT NULL")
    host = F.when(F.col("code").isin("4768", "4769", "4624"), F.coalesce("dst", "src")).otherwise(F.col("src"))
    by = {
        "EventID": (None, F.col("code")),
        "Computer": (None, host),
        "TargetUserName": (("4768", "4769", "4624"), F.col("actor")),
        "IpAddress": (("4768", "4769", "4624"), F.col("ip")),
        "TicketEncryptionType": (("4768", "4769"), F.col("enc")),
        "ServiceName": (("4769",), F.col("target")),
        "LogonType": (("4624",), F.col("logon_type")),
        "WorkstationName": (("4624",), F.col("src")),
        "Image": (("1",), F.col("image")),
        "CommandLine": (("1",), F.coalesce("cmdline", "image")),
        "User": (("1",), F.col("actor")),
    }
    if ticket_hashes:
        by |= {"RequestTicketHash": (("4769",), F.col("tgt")), "ResponseTicketHash": (("4768", "4769"), F.when(F.col("code") == "4768", F.col("tgt")).otherwise(F.col("tgs")))}
    entries = F.array(*[F.struct(F.lit(k).alias("k"), (c if codes is None else F.when(F.col("code").isin(*codes), c)).alias("v")) for k, (codes, c) in by.items()])
    fields = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return d.select("t", host.alias("host"), F.when(F.col("code") == "1", SYSMON).otherwise(SECURITY).alias("channel"), fields.alias("fields"), "label")


def event_xml(events: DataFrame) -> DataFrame:
    """host, channel and the event as one line of XML, with markup characters of values escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&apos;"))
    f = F.col("fields")
    when = F.date_format(F.timestamp_seconds(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    system = F.concat(F.lit("<System><EventID>"), f["EventID"], F.lit("</EventID><TimeCreated SystemTime='"), when, F.lit("'/><Channel>"), F.col("channel"), F.lit("</Channel><Computer>"), safe(F.col("host")), F.lit("</Computer></System>"))
    own = F.filter(F.map_entries(f), lambda e: ~e["key"].isin("EventID", "Computer"))
    data = F.array_join(F.transform(own, lambda e: F.concat(F.lit("<Data Name='"), e["key"], F.lit("'>"), safe(e["value"]), F.lit("</Data>"))), "")
    return events.select("t", "host", "channel", F.concat(F.lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'>"), system, F.lit("<EventData>"), data, F.lit("</EventData></Event>")).alias("value"))


def write_logs(events: DataFrame, path: str) -> None:
    """One folder of text files per host and channel, in order of time within each file."""
    lines = event_xml(events).withColumn("channel", F.replace("channel", F.lit("/"), F.lit("-")))
    lines.repartition("host", "channel").sortWithinPartitions("host", "channel", "t").drop("t").write.mode("overwrite").partitionBy("host", "channel").text(path)


# ---------------------------------------------------------------- checks on generated logs


def origins(events: DataFrame) -> DataFrame:
    """(account, ips): addresses from which each account shows up."""
    f = F.col("fields")
    d = events.select(f["TargetUserName"].alias("account"), f["IpAddress"].alias("ip")).where("account IS NOT NULL AND ip IS NOT NULL").distinct()
    return d.groupBy("account").agg(F.sort_array(F.collect_list("ip")).alias("ips"))


def naive_flags(events: DataFrame, sensitive: DataFrame) -> DataFrame:
    """(ip): addresses with any ticket request and any network logon on a sensitive host, sensitive(host)."""
    f = F.col("fields")
    e = events.select("host", f["EventID"].alias("code"), f["IpAddress"].alias("ip"), f["LogonType"].alias("kind")).where("ip IS NOT NULL")
    logon = e.where("code = '4624' AND kind = '3'").join(F.broadcast(sensitive.select("host")), "host", "left_semi").select("ip").distinct()
    return e.where("code = '4769'").select("ip").distinct().join(logon, "ip", "left_semi")


def separability(events: DataFrame, sensitive: DataFrame) -> DataFrame:
    """One row: addresses of attacks, addresses that plain correlation flags, and how many of these are benign. Where
    correlation alone tells attacks apart, the data are too easy."""
    bad = events.where("label IS NOT NULL").select(F.col("fields")["IpAddress"].alias("ip")).where("ip IS NOT NULL").distinct().withColumn("bad", F.lit(1))
    d = naive_flags(events, sensitive).withColumn("flagged", F.lit(1)).join(bad, "ip", "full").na.fill(0, ["bad", "flagged"])
    return d.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("attack_ips"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged_ips"), F.coalesce(F.sum(F.col("flagged") * (1 - F.col("bad"))), F.lit(0)).alias("benign_flagged"))


# ---------------------------------------------------------------- beacons and roasts


def beacons(hosts: DataFrame, windows: int, rate: float, beacon_rate: float, grain: float, seed: int = 7) -> DataFrame:
    """(host, compromised, window, t) of hosts(host, compromised): one event per active window.

    Compromised hosts share a schedule and are active besides it so seldom that every host is active at the same rate: no
    host stands out by itself, only pairs do.
    """
    if not 0 <= beacon_rate < rate <= 1:
        raise ValueError("rates must satisfy 0 <= beacon_rate < rate <= 1")
    own = (rate - beacon_rate) / (1 - beacon_rate)
    d = hosts.select("host", "compromised").repartition(64, "host").withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    shared = F.col("compromised") & (draw(seed, F.lit("beacon"), "window") < beacon_rate)
    level = F.when(F.col("compromised"), own).otherwise(rate)
    d = d.where(shared | (draw(seed, F.lit("own"), "host", "window") < level))
    return d.withColumn("t", (F.col("window") + draw(seed, F.lit("jitter"), "host", "window")) * grain)


def roast_corpus(accounts: DataFrame, services: int = 40, least: int = 1, most: int = 3, sweep: int = 18, grain: float = 3600.0, seed: int = 7) -> DataFrame:
    """(t, account, service, code, logon_process) of accounts(account, kind): plain ones ask for `least` to `most` services;
    those of kind `tool` or `quiet` sweep `sweep` services, and a tool also registers a logon process (4611)."""
    n = F.when(F.col("kind").isin("tool", "quiet"), F.lit(sweep)).otherwise(F.lit(least) + pick(most - least + 1, seed, F.lit("n"), "account"))
    d = accounts.select("account", "kind").withColumn("j", F.explode(F.sequence(F.lit(0), n - 1)))
    first = pick(services, seed, F.lit("first"), "account")
    t = draw(seed, F.lit("t"), "account", "j") * grain
    ask = d.select(t.alias("t"), "account", F.concat(F.lit("svc"), F.pmod(first + F.col("j"), F.lit(max(services, sweep))).cast("string")).alias("service"), F.lit("4769").alias("code"), F.lit(None).cast("string").alias("logon_process"))
    tool = accounts.where("kind = 'tool'").select((draw(seed, F.lit("tool"), "account") * grain).alias("t"), "account", F.lit(None).cast("string").alias("service"), F.lit("4611").alias("code"), F.lit("User32LogonProcesss").alias("logon_process"))
    return ask.unionByName(tool)


# ---------------------------------------------------------------- tickets


def seal(body: Column, key: Column) -> Column:
    """Stand-in for encryption under a key: only who has the key can make or check it."""
    return F.sha2(F.concat(key, F.lit("\x1f"), body, F.lit("\x1f"), key), 256)


def issue(requests: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """requests(client, target, clock, ..) with body, seal and hash of a ticket under the target's key, keys(target, key)."""
    d = requests.join(keys.select("target", "key"), "target")
    body = F.concat_ws("|", F.lit(kind), "client", "target", F.col("clock").cast("string"))
    d = d.withColumn("body", body).withColumn("seal", seal(F.col("body"), F.col("key"))).drop("key")
    return d.withColumn("hash", F.substring(F.sha2(F.concat_ws("|", "body", "seal"), 256), 1, 16))


def valid(tickets: DataFrame, keys: DataFrame) -> DataFrame:
    """Tickets whose seal checks under the target's key. A forgery with a stolen key does: no service can tell."""
    d = tickets.join(keys.select("target", "key"), "target")
    return d.where(F.col("seal") == seal(F.col("body"), F.col("key"))).drop("key")


def sessions(requests: DataFrame, krbtgt: str, services: DataFrame, forged_tgts: DataFrame | None = None, forged_services: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a key distribution centre and its services log: requests(client, spn, ip, clock) -> issues(hash, account, ip, seq)
    and presented(id, hash, account, ip, kind).

    Each request authenticates (a TGT, in issues), presents it for a service ticket (issued as well), and presents that to
    the service, services(spn, key). Forgeries, in the same columns as requests, are sealed with the right keys and never
    issued: golden ones are presented to the centre, which issues service tickets on them, silver ones to services only.
    """
    spark = requests.sparkSession
    master = spark.createDataFrame([("krbtgt", krbtgt)], "target string, key string")
    keys = services.select(F.col("spn").alias("target"), "key")
    r = requests.select("client", "spn", "ip", "clock")
    as_rep = issue(r.withColumn("target", F.lit("krbtgt")), F.broadcast(master), "TGT")
    shown = as_rep
    if forged_tgts is not None:
        shown = shown.unionByName(issue(forged_tgts.select("client", "spn", "ip", "clock").withColumn("target", F.lit("krbtgt")), F.broadcast(master), "TGT"))
    shown = valid(shown, F.broadcast(master))
    tgs_rep = issue(shown.select("client", F.col("spn").alias("target"), "spn", "ip", (F.col("clock") + 1).alias("clock")), keys, "SERVICE")
    used = tgs_rep
    if forged_services is not None:
        used = used.unionByName(issue(forged_services.select("client", F.col("spn").alias("target"), "spn", "ip", "clock"), keys, "SERVICE").select(used.columns))
    used = valid(used, keys)
    issues = as_rep.unionByName(tgs_rep.select(as_rep.columns)).select("hash", F.col("client").alias("account"), "ip", F.col("clock").alias("seq"))
    p = shown.select(F.concat(F.lit("tgs:"), "hash").alias("id"), "hash", F.col("client").alias("account"), "ip", F.lit("4769").alias("kind"))
    s = used.select(F.concat(F.lit("ap:"), "hash").alias("id"), "hash", F.col("client").alias("account"), "ip", F.lit("4624").alias("kind"))
    return {"issues": issues, "presented": p.union(s)}
