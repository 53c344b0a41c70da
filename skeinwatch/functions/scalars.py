"""Metric functions as Column expressions (no Python per row)."""

from pyspark.sql import Column, functions as F


def rnd(x: Column, digits: int) -> Column:
    """Round half up on the 9-digit decimal value; same answer in any SQL engine."""
    return F.round(x.cast("decimal(38,9)"), digits).cast("double")


def rnd_small(x: Column, digits: int) -> Column:
    """`rnd` for values known to stay below 1e9 (scores, entropies): cheaper decimal."""
    return F.round(x.cast("decimal(18,9)"), digits).cast("double")


def shannon_entropy(text: Column) -> Column:
    """Bits per character, 0 for texts of length 0 or 1."""
    n = F.length(text)

    def add(acc, ch):
        p = (n - F.length(F.replace(text, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)
    return F.when(text.isNull() | (n <= 1), F.lit(0.0)).otherwise(rnd_small(bits, 4))


def shannon_entropy_tokens(tokens: Column) -> Column:
    """Bits per token of an array."""
    n = F.size(tokens)

    def add(acc, token):
        p = F.size(F.filter(tokens, lambda x: x == token)) / n
        return acc - p * F.log2(p)

    bits = F.aggregate(F.array_distinct(tokens), F.lit(0.0), add)
    return F.when(tokens.isNull() | (n <= 1), F.lit(0.0)).otherwise(rnd_small(bits, 4))


def flow_ratio(bytes_out: Column, bytes_in: Column) -> Column:
    """Egress over ingress; null where a count is negative (the detector then stays silent)."""
    return (
        F.when((bytes_out < 0) | (bytes_in < 0), F.lit(None).cast("double"))
        .when(bytes_in == 0, bytes_out.cast("double"))
        .otherwise(rnd(F.try_divide(bytes_out.cast("double"), bytes_in.cast("double")), 4))
    )


def gaps(stamps: Column) -> Column:
    """Differences of neighbours in a sorted array."""
    return F.transform(
        F.slice(stamps, F.lit(2), F.greatest(F.size(stamps) - 1, F.lit(0))),
        lambda x, i: x - F.element_at(stamps, (i + 1).cast("int")),
    )


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def iat_variance(stamps: Column) -> Column:
    """Population variance of the gaps of an array of seconds; 0 below three stamps."""
    d = gaps(F.array_sort(stamps))
    mu = _mean(d)
    var = F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu)) / F.size(d)
    return F.when(F.size(stamps) < 3, F.lit(0.0)).otherwise(rnd(var, 6))


def fan_out(destinations: Column) -> Column:
    return F.when(destinations.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(destinations)))


def ngram_uniqueness(text: Column, n: int) -> Column:
    """Distinct over total n-grams; 0 for texts shorter than n."""
    grams = F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)),
        lambda i: F.substring(text, i, F.lit(n)),
    )
    return F.when(text.isNull() | (F.length(text) < n), F.lit(0.0)).otherwise(
        F.size(F.array_distinct(grams)) / F.size(grams)
    )


def first_label(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def consonant_ratio(label: Column) -> Column:
    low = F.lower(label)
    vowels = F.length(F.regexp_replace(low, "[^aeiou]", ""))
    letters = F.length(F.regexp_replace(low, "[^a-z]", ""))
    return (letters - vowels) / F.greatest(letters, F.lit(1))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.greatest(std, F.lit(1.0))


def severity(score: Column) -> Column:
    from skeinwatch import schemas as S

    return (
        F.when(score >= S.SEVERITY_CRITICAL, "critical")
        .when(score >= S.SEVERITY_HIGH, "high")
        .when(score >= S.SEVERITY_MODERATE, "moderate")
        .otherwise("low")
    )


def safe_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_port(value: Column, default: int = 0) -> Column:
    """A port from text; the default where there is none or it lies outside 0 to 65535."""
    n = safe_int(value, default)
    return F.when(n.between(0, 65535), n).otherwise(default).cast("int")


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), port.cast("string"))


def flow_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    return F.concat(endpoint(src_ip, src_port), F.lit("->"), endpoint(dst_ip, dst_port))


def target_key(dst_ip: Column, dst_port: Column) -> Column:
    return F.concat(F.lit("target:"), endpoint(dst_ip, dst_port))


def uid_hash(flow_id: Column) -> Column:
    return F.concat(F.lit("C"), F.substring(F.sha2(flow_id, 256), 1, 16))


def history_to_flags(history: Column) -> Column:
    letters = [("S", "SYN"), ("A", "ACK"), ("D", "PSH"), ("F", "FIN"), ("R", "RST")]
    present = F.array(*[F.when(history.contains(c), F.lit(name)) for c, name in letters])
    return F.filter(present, lambda x: x.isNotNull())


def parse_event_time(value: Column, ingest_ts: Column) -> Column:
    """Epoch seconds (number or text, to the year 9999) or ISO-8601 to timestamp, else the ingest time."""
    seconds = value.try_cast("double")
    usable = seconds.between(-62135596800.0, 253402300799.0)  # neither NaN nor infinite
    return F.coalesce(
        F.when(usable, F.timestamp_micros(F.round(seconds * 1000000).cast("bigint"))),
        value.try_cast("timestamp"),
        ingest_ts,
    )
