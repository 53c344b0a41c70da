"""Helpers for analysts who write SQL: temporary functions of the session, defined in SQL, so Catalyst inlines them into the plan."""

from pyspark.sql import SparkSession

# an IPv4 address is 8 hexadecimal digits and an IPv6 address 32, as in `functions.net`
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"{_OCTET}([.]{_OCTET}){{3}}"
_NONE = "CAST(array() AS ARRAY<STRING>)"


def _groups(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN {_NONE} ELSE split({text}, ':') END"


def _bound(names: dict[str, str], body: str) -> str:
    """`body` with each name computed once: the names are fields of x. Functions of the session may be called in fields only."""
    fields = ", ".join(f"'{n}', {e}" for n, e in names.items())
    return f"transform(array(named_struct({fields})), x -> {body})[0]"


#: Name -> parameters, type and body. Those further down use those above.
FUNCTIONS = {
    "flow_ratio": """(bytes_out BIGINT, bytes_in BIGINT) RETURNS DOUBLE
        RETURN CASE WHEN bytes_out < 0 OR bytes_in < 0 THEN NULL WHEN bytes_in = 0 THEN CAST(bytes_out AS DOUBLE)
            ELSE CAST(round(CAST(try_divide(CAST(bytes_out AS DOUBLE), CAST(bytes_in AS DOUBLE)) AS DECIMAL(38, 9)), 4) AS DOUBLE) END""",
    "shannon_entropy": """(t STRING) RETURNS DOUBLE
        RETURN CASE WHEN t IS NULL OR length(t) <= 1 THEN 0.0D ELSE CAST(round(CAST(
            aggregate(transform(array_distinct(split(t, '')), c -> (length(t) - length(replace(t, c, ''))) / CAST(length(t) AS DOUBLE)),
                0.0D, (acc, p) -> acc - p * log2(p)) AS DECIMAL(18, 9)), 4) AS DOUBLE) END""",
    "ip4_hex": f"""(t STRING) RETURNS STRING
        RETURN CASE WHEN t RLIKE '^{_V4}$' THEN array_join(transform(split(t, '[.]'), o -> lpad(hex(CAST(o AS BIGINT)), 2, '0')), '') END""",
    "ip6_groups": f"""(t STRING) RETURNS STRING
        RETURN CASE WHEN t RLIKE '^[0-9A-Fa-f:]*:{_V4}$' THEN {_bound({"n": "length(regexp_extract(t, '[^:]*$', 0))", "h": "ip4_hex(regexp_extract(t, '[^:]*$', 0))"}, "concat(substr(t, 1, length(t) - x.n), substr(x.h, 1, 4), ':', substr(x.h, 5, 4))")} ELSE t END""",
    "ip_hex": f"""(t STRING) RETURNS STRING
        RETURN CASE WHEN t RLIKE '^{_V4}$' THEN ip4_hex(t) WHEN contains(t, ':') THEN {_bound(
            {"g": "ip6_groups(t)", "n": "size(split(ip6_groups(t), '::'))", "head": _groups("split(ip6_groups(t), '::')[0]"),
             "tail": f"CASE WHEN size(split(ip6_groups(t), '::')) > 1 THEN {_groups("get(split(ip6_groups(t), '::'), 1)")} ELSE {_NONE} END"},
            "CASE WHEN x.g RLIKE '^[0-9A-Fa-f:]+$' AND x.n <= 2 AND (CASE WHEN x.n = 2 THEN size(x.head) + size(x.tail) <= 7 ELSE size(x.head) = 8 END) "
            "AND forall(concat(x.head, x.tail), g -> length(g) BETWEEN 1 AND 4) "
            "THEN array_join(transform(concat(x.head, array_repeat('0', greatest(8 - size(x.head) - size(x.tail), 0)), x.tail), g -> lpad(upper(g), 4, '0')), '') END")} END""",
    "mask_bits": f"""(m STRING) RETURNS INT
        RETURN {_bound({"n": "CAST(conv(ip4_hex(m), 16, 10) AS BIGINT)"}, "CASE WHEN ((4294967295 - x.n) & (4294967296 - x.n)) = 0 THEN bit_count(x.n) WHEN (x.n & (x.n + 1)) = 0 THEN 32 - bit_count(x.n) END")}""",
    "prefix_bits": """(block STRING, width INT) RETURNS INT
        RETURN CASE WHEN NOT contains(block, '/') THEN width * 4 WHEN block RLIKE '/.*/' THEN NULL
            WHEN block RLIKE '/[0-9]+$' THEN CASE WHEN try_cast(substring_index(block, '/', -1) AS INT) <= width * 4 THEN try_cast(substring_index(block, '/', -1) AS INT) END
            WHEN width = 8 THEN mask_bits(substring_index(block, '/', -1)) END""",
    "ip_in_cidr": f"""(ip STRING, block STRING) RETURNS BOOLEAN
        RETURN {_bound({"a": "ip_hex(ip)", "b": "ip_hex(substring_index(block, '/', 1))", "p": "prefix_bits(block, length(ip_hex(substring_index(block, '/', 1))))"},
            "CASE WHEN x.a IS NULL OR x.b IS NULL OR x.p IS NULL THEN ip = block ELSE length(x.a) = length(x.b) AND left(x.a, CAST(x.p div 4 AS INT)) = left(x.b, CAST(x.p div 4 AS INT)) "
            "AND (x.p % 4 = 0 OR shiftright(CAST(conv(substr(x.a, CAST(x.p div 4 AS INT) + 1, 1), 16, 10) AS INT), 4 - x.p % 4) "
            "= shiftright(CAST(conv(substr(x.b, CAST(x.p div 4 AS INT) + 1, 1), 16, 10) AS INT), 4 - x.p % 4)) END")}""",
}


def register(spark: SparkSession) -> None:
    """`shannon_entropy`, `flow_ratio` and `ip_in_cidr` for `spark.sql`, by the same definitions as the column functions."""
    for name, rest in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
