"""Detector thresholds as literals, as a one-row table, or versioned over time."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# --- fixed values: rule, parameter, kind, min, max, default ----------------
SPECS = [
    ("ddos", "baseline_pps_mean", "float", 0.1, 1000000.0, 50.0),
    ("ddos", "baseline_pps_std", "float", 1.0, 1000000.0, 30.0),
    ("ddos", "sigma_threshold", "float", 0.5, 20.0, 3.0),
    ("ddos", "syn_ratio_threshold", "float", 0.0, 1.0, 0.85),
    ("ddos", "min_surge_pps", "float", 1.0, 10000000.0, 100.0),
    ("ddos", "min_udp_pps", "float", 1.0, 10000000.0, 200.0),
    ("ddos", "syn_packet_burst", "int", 1, 10000000, 300),
    ("beaconing", "max_variance_threshold", "float", 0.0, 100.0, 0.05),
    ("beaconing", "min_heartbeats", "int", 2, 1000, 3),
    ("beaconing", "min_period_seconds", "float", 0.0, 86400.0, 1.0),
    ("dns", "entropy_threshold", "float", 0.0, 8.0, 3.8),
    ("dns", "tunnel_length_threshold", "int", 1, 1000, 60),
    ("dns", "txt_tunnel_length", "int", 1, 1000, 45),
    ("dns", "txt_entropy_threshold", "float", 0.0, 8.0, 3.6),
    ("exfiltration", "min_egress_bytes", "int", 0, 1000000000000, 1000000),
    ("exfiltration", "min_ratio_threshold", "float", 0.0, 100000.0, 20.0),
    ("exfiltration", "massive_upload_bytes", "int", 0, 1000000000000, 5000000),
    ("exfiltration", "massive_upload_ratio", "float", 0.0, 100000.0, 10.0),
    ("reconnaissance", "min_target_cardinality", "int", 1, 10000, 3),
    ("reconnaissance", "max_probe_bytes", "int", 0, 1000000000, 100),
    ("correlation", "window_seconds", "int", 1, 86400, 300),
    ("malware", "tls_ports", "int_list", 1, 65535, [443, 8443, 9001, 4443]),
]
# --- end of fixed values ---------------------------------------------------

_KIND = {f"{r}.{p}": kind for r, p, kind, *_ in SPECS}
DEFAULTS = {f"{r}.{p}": default for r, p, _, _, _, default in SPECS}
_SQL_TYPE = {"float": "double", "int": "bigint", "int_list": "array<int>"}


def _text(value) -> str:
    if isinstance(value, list):
        return ",".join(str(v) for v in value)
    return str(value)


def column_name(key: str) -> str:
    return "th_" + key.replace(".", "_")


class Thresholds:
    """Resolves 'rule.parameter' to a Column; overrides win over `base`."""

    def __init__(self, overrides: dict | None = None, from_columns: bool = False):
        unknown = set(overrides or {}) - set(DEFAULTS)
        if unknown:
            raise KeyError(f"unknown thresholds: {sorted(unknown)}")
        self._overrides = dict(overrides or {})
        self._from_columns = from_columns

    def __call__(self, key: str) -> Column:
        kind = _SQL_TYPE[_KIND[key]]
        if key not in self._overrides and self._from_columns:
            return F.col(column_name(key))
        value = self._overrides.get(key, DEFAULTS[key])
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value]).cast(kind)
        return F.lit(value).cast(kind)

    def value(self, key: str):
        return self._overrides.get(key, DEFAULTS[key])


def spec_table(spark: SparkSession) -> DataFrame:
    """The 22 parameters with kind, range and default (values as text)."""
    rows = [(r, p, k, float(lo), float(hi), _text(d)) for r, p, k, lo, hi, d in SPECS]
    return spark.createDataFrame(
        rows, "rule string, parameter string, kind string, min double, max double, default string"
    )


def _is_valid(kind: Column, value: Column, lo: Column, hi: Column) -> Column:
    number = F.trim(value).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    in_bounds = finite & (number >= lo) & (number <= hi)
    items = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    ports = F.transform(items, lambda x: x.try_cast("int"))
    list_ok = (
        (F.size(items) > 0)
        & F.forall(ports, lambda p: p.isNotNull() & (p >= lo) & (p <= hi))
        & (F.size(F.array_distinct(ports)) == F.size(ports))
    )
    return (
        F.when(value.isNull() | F.lower(value).isin("true", "false"), F.lit(False))
        .when(kind == "int_list", list_ok)
        .when(kind == "int", in_bounds & (number == F.floor(number)))
        .otherwise(in_bounds)
    )


def _canonical(kind: Column, value: Column) -> Column:
    number = F.trim(value).try_cast("double")
    items = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(kind == "int_list", F.array_join(items, ","))
        .when(kind == "int", number.cast("bigint").cast("string"))
        .otherwise(number.cast("string"))
    )


def _typed(kind: str, value: Column) -> Column:
    if kind == "int_list":
        return F.split(value, ",").try_cast("array<int>")
    return value.try_cast(_SQL_TYPE[kind])


def effective_thresholds(specs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides (key, value text) checked against their spec; bad or unknown ones are skipped.

    Of several changes of one key the last valid one holds, by the column `seq` where overrides have it.
    Without `seq`, or of equal `seq`, it is the greatest number (of lists, the greatest text).
    """
    seq = F.col("seq") if "seq" in overrides.columns else F.lit(0)
    changes = overrides.select(
        F.substring_index("key", ".", 1).alias("rule"),
        F.expr("substring(key, instr(key, '.') + 1)").alias("parameter"),
        F.col("value").alias("override"),
        seq.alias("_seq"),
    ).join(F.broadcast(specs.select("rule", "parameter", "kind", "min", "max")), ["rule", "parameter"])
    canonical = _canonical(F.col("kind"), F.col("override"))
    last = (
        changes.filter(_is_valid(F.col("kind"), F.col("override"), F.col("min"), F.col("max")))
        .groupBy("rule", "parameter")
        .agg(F.max_by(canonical, F.struct("_seq", F.trim("override").try_cast("double"), "override")).alias("_set"))
    )
    value = F.coalesce("_set", "default")
    return specs.join(F.broadcast(last), ["rule", "parameter"], "left").select(
        "rule", "parameter", "kind", "min", "max", "default",
        value.alias("value"),
        (value != F.col("default")).alias("modified"),
    )


def modified_thresholds(effective: DataFrame) -> DataFrame:
    return effective.filter("modified").select(
        F.concat_ws(".", "rule", "parameter").alias("key"), "value"
    )


def thresholds_row(effective: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One typed column per parameter; one row (or one per `extra` grouping)."""
    aggs = []
    for rule, parameter, kind, *_ in SPECS:
        picked = F.max(
            F.when((F.col("rule") == rule) & (F.col("parameter") == parameter), F.col("value"))
        )
        name = column_name(f"{rule}.{parameter}")
        if kind == "int_list":
            picked = F.split(picked, ",").cast("array<int>")
        else:
            picked = picked.cast(_SQL_TYPE[kind])
        aggs.append(picked.alias(name))
    return effective.groupBy(*(extra or [])).agg(*aggs)


def apply_thresholds(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the single threshold row to every record (a one-row broadcast)."""
    return rows.crossJoin(F.broadcast(one_row))


_DAY_US = 86400 * 1000000


def _versions(changes: DataFrame, key: str) -> DataFrame:
    """Valid changes as (effective_us, until_us, value): typed, one an instant, each in force until the next.

    The next version is looked up within a day, beyond it among one row a day.
    """
    kind = _KIND[key]
    lo, hi = next((lo, hi) for r, p, _, lo, hi, _ in SPECS if f"{r}.{p}" == key)
    text = F.col("value").cast("string")
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    known = (
        changes.filter(F.col("effective_us").isNotNull() & _is_valid(F.lit(kind), text, F.lit(lo), F.lit(hi)))
        .select("effective_us", seq.alias("_seq"), _typed(kind, _canonical(F.lit(kind), text)).alias("value"))
        .groupBy("effective_us")
        .agg(F.max_by("value", F.struct("_seq", "value")).alias("value"))
        .withColumn("_day", F.expr(f"effective_us div {_DAY_US}"))
    )
    days = known.groupBy("_day").agg(F.min("effective_us").alias("_first"))
    days = days.select("_day", F.lead("_first").over(Window.orderBy("_day")).alias("_following"))
    within = F.lead("effective_us").over(Window.partitionBy("_day").orderBy("effective_us"))
    return known.withColumn("_next", within).join(days, "_day").select(
        "effective_us", F.coalesce("_next", "_following").alias("until_us"), "value"
    )


def thresholds_asof(rows: DataFrame, changes: DataFrame, key: str, out: str) -> DataFrame:
    """Value of one threshold in force at each record's time; the default before the first change.

    `changes` (effective_us, value) is the change log of one parameter of any length. Values outside the
    parameter's range are skipped. Of changes at one instant the one with the greatest `seq` holds (where
    the log has that column), then the greatest value. A bucketed range join: equal days, then the time of
    the version, each version repeated for the days it covers. A record without a time takes the default.
    """
    span = rows.agg(F.max("ts_us").alias("_end"))
    versions = (
        _versions(changes, key)
        .crossJoin(F.broadcast(span))
        .withColumn("_last", F.coalesce(F.col("until_us") - 1, F.col("_end")))
        .filter("_last >= effective_us")
        .withColumn(
            "_day",
            F.explode(F.sequence(F.expr(f"effective_us div {_DAY_US}"), F.expr(f"_last div {_DAY_US}"))),
        )
        .select("_day", F.col("effective_us").alias("_since"), "_last", F.col("value").alias("_in_force"))
    )
    rows = rows.withColumn("_day", F.expr(f"ts_us div {_DAY_US}"))
    hit = (versions["_day"] == rows["_day"]) & rows["ts_us"].between(versions["_since"], versions["_last"])
    return (
        rows.join(versions, hit, "left")
        .withColumn(out, F.coalesce("_in_force", Thresholds()(key)))
        .drop("_day", "_since", "_last", "_in_force")
    )
