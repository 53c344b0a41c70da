"""Suppression rules: address ranges matched in rule order, the alert is kept and marked."""

from pyspark.sql import Column, DataFrame, functions as F

from skeinwatch import schemas as S
from skeinwatch.functions.net import cidr_range, ip_hex

RULE_TYPES = ["source_ip", "destination_ip", "source_ip_threat_class"]


def validate_rules(rules: DataFrame) -> DataFrame:
    """Adds `valid` and `reason` (null when valid); criteria are trimmed."""
    rules = rules.withColumn("source_ip", F.trim("source_ip")).withColumn(
        "destination_ip", F.trim("destination_ip")
    )
    src, dst = cidr_range(F.col("source_ip")), cidr_range(F.col("destination_ip"))
    by_source = F.col("rule_type").isin("source_ip", "source_ip_threat_class")
    checked = rules.withColumn("_src", src).withColumn("_dst", dst)
    reason = (
        F.when(~F.col("rule_type").isin(RULE_TYPES), "unknown rule type")
        .when(F.length("description") > 500, "description too long")
        .when(F.col("source_ip").isNotNull() & F.col("_src.lo").isNull(), "invalid source_ip")
        .when(F.col("destination_ip").isNotNull() & F.col("_dst.lo").isNull(), "invalid destination_ip")
        .when(
            F.col("threat_class").isNotNull() & ~F.col("threat_class").isin(S.THREAT_CLASSES),
            "unknown threat class",
        )
        .when(by_source & F.col("source_ip").isNull(), "source_ip missing")
        .when((F.col("rule_type") == "destination_ip") & F.col("destination_ip").isNull(), "destination_ip missing")
    )
    return (
        checked.withColumn("reason", reason)
        .withColumn("valid", F.col("reason").isNull())
        .drop("_src", "_dst")
    )


def active_rules(rules: DataFrame, as_of: Column) -> DataFrame:
    return rules.filter(
        F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    )


def _prepared(rules: DataFrame) -> DataFrame:
    by_source = F.col("rule_type") != "destination_ip"
    p = rules.select(
        F.col("id").alias("rule_id"), "rule_seq", by_source.alias("by_source"),
        F.when(by_source, F.col("source_ip")).otherwise(F.col("destination_ip")).alias("criterion"),
        F.when(F.col("rule_type") == "source_ip_threat_class", F.col("threat_class")).alias("only_class"),
    ).filter("criterion IS NOT NULL AND criterion <> ''")
    return p.withColumn("r", cidr_range(F.col("criterion"))).select(
        "*", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), F.col("r.prefix_len").alias("prefix_len")
    ).drop("r")


def mark_suppressed(alerts: DataFrame, rules: DataFrame | None, as_of: Column) -> DataFrame:
    """Sets suppressed and suppression_rule_id from the first matching active rule (of equal rule_seq, the least id).

    Rules are found by equi-joins on (prefix length, network). The outcome depends on the addresses and the
    class only, so each combination is looked up once and every alert that has it is marked, with or without an id.
    """
    if rules is None:
        return alerts
    rule = _first_by_prefix(alerts, _prepared(active_rules(rules, as_of)))
    return rule.withColumn("suppressed", F.col("suppression_rule_id").isNotNull())


def _network(addr_hex: Column, prefix_len: Column) -> Column:
    """First `prefix_len` bits of a hexadecimal address, as bit text."""
    bits = F.concat_ws("", *[
        F.lpad(F.conv(F.substring(addr_hex, i, 8), 16, 2), 32, "0") for i in (1, 9, 17, 25)
    ])
    return F.substring(bits, F.lit(1), prefix_len)


def _first_by_prefix(alerts, prepared):
    """Every alert address is looked up once per (family, prefix length) in use."""
    family = F.length("lo")
    nets = prepared.withColumn("family", F.coalesce(family, F.lit(0))).withColumn(
        "net",
        F.when(F.col("lo").isNull(), F.col("criterion")).otherwise(
            _network(F.col("lo"), F.col("prefix_len"))
        ),
    ).select(
        "by_source", "family", F.coalesce("prefix_len", F.lit(-1)).alias("plen"), "net",
        "only_class", "rule_seq", "rule_id", "criterion",
    )
    # at most 33 + 129 + 1 lengths per side exist
    lengths = nets.groupBy().agg(
        F.collect_set(F.struct("by_source", "family", "plen")).alias("_lengths")
    )
    who = ["source_ip", "destination_ip", "threat_class"]
    addressed = alerts.select(*who).distinct().withColumn("_sx", ip_hex(F.col("source_ip"))).withColumn(
        "_dx", ip_hex(F.col("destination_ip"))
    )
    probe = addressed.crossJoin(F.broadcast(lengths)).select(
        *who, "_sx", "_dx",
        F.explode("_lengths").alias("_l"),
    )
    by_source = F.col("_l.by_source")
    ip = F.when(by_source, F.col("source_ip")).otherwise(F.col("destination_ip"))
    hx = F.when(by_source, F.col("_sx")).otherwise(F.col("_dx"))
    # no valid address: compared as text against every criterion
    net = F.when(hx.isNull() | (F.col("_l.family") == 0), ip).when(
        F.length(hx) == F.col("_l.family"), _network(hx, F.col("_l.plen"))
    )
    probe = probe.select(
        *who, by_source.alias("by_source"), hx.isNull().alias("as_text"), net.alias("net"),
        F.col("_l.family").alias("family"), F.col("_l.plen").alias("plen"),
    ).filter("net IS NOT NULL AND net <> '' OR plen = 0")
    keys = ["by_source", "family", "plen", "net"]
    by_net = probe.filter(~F.col("as_text")).join(nets, keys)
    text_rules = nets.select("by_source", F.col("criterion").alias("net"), "only_class", "rule_seq", "rule_id")
    by_text = probe.filter("as_text").select(*who, "by_source", "net").distinct().join(
        text_rules, ["by_source", "net"]
    )
    cols = [*who, "only_class", "rule_seq", "rule_id"]
    first = (
        by_net.select(*cols).unionByName(by_text.select(*cols))
        .filter("only_class IS NULL OR only_class = threat_class")
        .groupBy(*[F.col(c).alias(f"_{c}") for c in who])
        .agg(F.min(F.struct("rule_seq", "rule_id"))["rule_id"].alias("_rule"))
    )
    same = [alerts[c].eqNullSafe(first[f"_{c}"]) for c in who]
    return (
        alerts.join(first, same, "left")
        .withColumn("suppression_rule_id", F.col("_rule"))
        .drop("_rule", *[f"_{c}" for c in who])
    )


def deliverable(alerts: DataFrame) -> DataFrame:
    """What analysts are shown: everything not suppressed."""
    return alerts.filter(~F.col("suppressed"))


def newest_first(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("created_at"), "id")
