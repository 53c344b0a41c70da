"""IP addresses as fixed-width hexadecimal text, so ranges compare as strings.

An IPv4 address is 8 digits and an IPv6 address 32; the width doubles as the family,
and a v4 value can never fall inside a v6 range.
"""

from pyspark.sql import Column, functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"^{_OCTET}(\\.{_OCTET}){{3}}$"
_V6_CHARS = "^[0-9A-Fa-f:]+$"


def _v4_hex(ip: Column) -> Column:
    return F.aggregate(
        F.split(ip, "[.]"),
        F.lit(""),
        lambda acc, part: F.concat(acc, F.lpad(F.hex(part.try_cast("bigint")), 2, "0")),
    )


def _groups(part: Column) -> Column:
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))


def _v6_hex(ip: Column) -> Column:
    halves = F.split(ip, "::")
    head = _groups(F.element_at(halves, 1))
    tail = F.when(F.size(halves) > 1, _groups(F.element_at(halves, 2))).otherwise(
        F.array().cast("array<string>")
    )
    missing = F.lit(8) - F.size(head) - F.size(tail)
    well_formed = (
        ip.rlike(_V6_CHARS)
        & (F.size(halves) <= 2)
        & F.when(F.size(halves) == 2, missing >= 1).otherwise(missing == 0)
        & F.forall(F.concat(head, tail), lambda g: F.length(g).between(1, 4))
    )
    groups = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    digits = F.array_join(F.transform(groups, lambda g: F.lpad(F.upper(g), 4, "0")), "")
    return F.when(well_formed, digits)


def ip_hex(ip: Column) -> Column:
    """8 or 32 hex digits, null when the text is no address."""
    # a dotted tail ("::ffff:1.2.3.4") becomes two plain groups first
    dotted = F.regexp_extract(ip, r"^([0-9A-Fa-f:]*:)(\d+\.\d+\.\d+\.\d+)$", 2)
    lead = F.regexp_extract(ip, r"^([0-9A-Fa-f:]*:)(\d+\.\d+\.\d+\.\d+)$", 1)
    low = _v4_hex(dotted)
    plain = F.when(
        dotted.rlike(_V4),
        F.concat(lead, F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4)),
    ).otherwise(ip)
    return F.when(ip.rlike(_V4), _v4_hex(ip)).when(ip.contains(":"), _v6_hex(plain))


def ip_num(ip: Column) -> Column:
    """IPv4 address as a number, null otherwise."""
    return F.when(
        ip.rlike(_V4),
        F.aggregate(
            F.split(ip, "[.]"), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x.try_cast("bigint")
        ),
    )


def _netmask_len(mask: Column) -> Column:
    """Prefix length of a dotted netmask or host mask; null when its ones are not in one run."""
    n = ip_num(mask)

    def ones_first(x: Column) -> Column:
        rest = F.lit((1 << 32) - 1) - x  # must be 2^k - 1
        return F.when(rest.bitwiseAND(rest + 1) == 0, F.lit(32) - F.bit_count(rest))

    return F.coalesce(ones_first(n), ones_first(F.lit((1 << 32) - 1) - n))


def _ends(addr: Column, prefix: Column) -> Column:
    """lo, hi, prefix_len of an address in hexadecimal; digits beyond the prefix become 0 or F, one digit may be cut."""
    width, whole = F.length(addr), F.floor(prefix / 4).cast("int")
    keep = F.lit(15) - F.element_at(F.array(*[F.lit(15 >> i) for i in range(4)]), (prefix % 4 + 1).cast("int"))
    digit = F.conv(F.substring(addr, whole + 1, F.lit(1)), 16, 10).cast("int")

    def end(cut: Column, fill: str) -> Column:
        head = F.concat(F.substring(addr, F.lit(1), whole), F.when(whole < width, F.hex(cut)).otherwise(""))
        return F.rpad(head, width, fill)

    low = F.coalesce(digit, F.lit(0)).bitwiseAND(keep)
    high = F.coalesce(digit, F.lit(0)).bitwiseOR(F.lit(15) - keep)
    return F.struct(end(low, "0").alias("lo"), end(high, "F").alias("hi"), prefix.cast("int").alias("prefix_len"))


def cidr_range(criterion: Column) -> Column:
    """Address range of an address or CIDR block (host bits ignored) as a struct of lo, hi, prefix_len; nulls when invalid. No Python."""
    parts = F.split(criterion, "/")
    size = F.try_element_at(parts, F.lit(2))

    def prefix(addr: Column) -> Column:
        bits = F.length(addr) * 4
        given = F.when(size.rlike("^[0-9]+$"), size.try_cast("int")).when(F.length(addr) == 8, _netmask_len(size))
        number = F.when(F.size(parts) == 1, bits).when(F.size(parts) == 2, given)
        return F.when(number <= bits, number)

    # bound step by step in arrays of one item, so that each is computed once
    found = F.transform(F.array(ip_hex(F.element_at(parts, 1))), lambda a: F.struct(a.alias("a"), prefix(a).alias("p")))
    whole = F.filter(found, lambda x: x["a"].isNotNull() & x["p"].isNotNull())
    return F.try_element_at(F.transform(whole, lambda x: _ends(x["a"], x["p"])), F.lit(1))


def in_range(ip: Column, addr_hex: Column, criterion: Column, lo: Column, hi: Column) -> Column:
    """Membership; when either side is no valid address the texts must be equal."""
    inside = (F.length(addr_hex) == F.length(lo)) & (addr_hex >= lo) & (addr_hex <= hi)
    return F.when(addr_hex.isNull() | lo.isNull(), ip == criterion).otherwise(inside)


def ip_in_cidr(ip: Column, criterion: Column) -> Column:
    r = cidr_range(criterion)
    return in_range(ip, ip_hex(ip), criterion, r["lo"], r["hi"])


def clean_ip(raw: Column) -> Column:
    """Strip a trailing :port; texts with '::' are left alone."""
    t = F.trim(raw)
    return (
        F.when(raw.isNull(), F.lit(""))
        .when(t.contains(":") & ~t.contains("::"), F.substring_index(t, ":", 1))
        .otherwise(t)
    )
