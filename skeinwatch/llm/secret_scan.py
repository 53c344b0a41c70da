"""Secrets in texts, strong ones by their form and weak ones by what stands near them.

Everything is DataFrame functions. The matches of a text become rows: `split` gives what lies
between matches, so running sums of lengths give the positions. Identifiers, secrets and
endpoints are then interval-joined within a text: two parts share a scope if they overlap or at most
`reach` code points lie between the end of one and the start of the other. The join needs only the farthest end
among the partners that start no later and the next start among those that do, two running values
over the parts in order of their starts, so it emits one row a part whatever their number. A weak part is kept only if its scope holds a
part that complements it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base kinds, in their order.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
# The weak kinds.
_LOGIN = r"""(?i:(user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
_OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}"
_ENDPOINT = r"""(?i:(https?|ftp|ssh|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp))://([^\x00-\x20"'<>]+)"""

#: kind, pattern, group whose length counts, least length, a plain test that all matches pass, role, weak
KINDS = (
    ("assign", _ASSIGN, 2, 6, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "secret", False),
    ("access", _ACCESS, 0, 20, "AKIA", "identifier", False),
    ("hex", _HEX, 0, 24, r"[0-9a-f]{24}", "secret", False),
    ("login", _LOGIN, 2, 3, r"(?i:user(?:name)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]", "identifier", True),
    ("opaque", _OPAQUE, 0, 32, r"[A-Za-z0-9+/_-]{32}", "secret", True),
    ("endpoint", _ENDPOINT, 2, 3, "://", "endpoint", True),
)
ORDER = {k[0]: i for i, k in enumerate(KINDS)}
_NAMES = [k[0] for k in KINDS]


def may_hold_secret(text: Column) -> Column:
    """False only where no kind has a match."""
    found = [text.contains(k[4]) if k[4] in ("AKIA", "://") else text.rlike(k[4]) for k in KINDS]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return F.coalesce(out, F.lit(False))


def _found(text: Column, number: int) -> Column:
    """Rows-to-be of one kind: lengths of the gap before each match, of the match and of its value; the value's mix of characters."""
    _, pattern, group, _, test, _, _ = KINDS[number]
    has = text.contains(test) if test in ("AKIA", "://") else text.rlike(test)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), F.length(x["whole"]).alias("size"),
            F.length(x["value"]).alias("value_size"),
            (x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")).alias("mixed"),
        ),
    )
    return F.when(has, rows)


def secret_rows(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int = 200) -> DataFrame:
    """One row per match of any kind, with null `kind` if it is not reported, and one such row for a text without a match.

    Columns: `keep`, `_row` (numbers the input rows), kind, start, end (code points, end exclusive),
    weak. Null and empty texts have no part.
    """
    whole = F.col(text)
    kinds = [F.coalesce(_found(whole, i), F.array()) for i in range(len(KINDS))]
    numbered = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.concat(*kinds).alias("parts"))
    rows = numbered.select(*keep, "_row", F.explode_outer("parts").alias("m")).select(*keep, "_row", "m.*")
    before = Window.partitionBy("_row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limits, roles = ({k[0]: k[i] for k in KINDS} for i in (3, 5))
    least = F.element_at(F.array(*[F.lit(v) for v in limits.values()]), F.col("kind") + 1)
    role = F.element_at(F.array(*[F.lit(v) for v in roles.values()]), F.col("kind") + 1)
    holds = (F.col("value_size") >= least) & ((F.col("kind") != ORDER["opaque"]) | F.col("mixed"))
    placed = (
        rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(before))
        .withColumn("start", F.col("end") - F.col("size"))
        .withColumn("kind", F.when(holds, F.col("kind")))  # what fails has no kind, but keeps its text's row
        .withColumn("role", role)
    )
    up, down = (
        Window.partitionBy("_row").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("start").asc(), F.col("start").desc())
    )

    def near(*roles: str) -> Column:
        fits = F.col("role").isin(*roles)
        before = F.max(F.when(fits, F.col("end"))).over(up) >= F.col("start") - reach
        after = F.min(F.when(fits, F.col("start"))).over(down) <= F.col("end") + reach
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    weak = F.col("kind") >= ORDER["login"]
    linked = F.when(F.col("role") == "secret", near("identifier", "endpoint")).otherwise(near("secret"))
    judged = placed.withColumn("weak", weak).withColumn("reported", ~weak | linked)
    return judged.select(
        *keep, "_row",
        *[F.when(F.col("reported"), F.col(c)).alias(c) for c in ("kind", "start", "end", "weak")],
    )


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in _NAMES])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int = 200) -> DataFrame:
    """One row per text: `keep`, n_assign, n_access, n_hex, base_sha256, spans.

    `spans` lists kind:start:end of all parts reported by start, then kind; base_sha256 is the SHA-256
    of that list of base kinds alone. Null or empty text: zeros and empty lists. Equal spans of one
    kind cannot occur; repeated rows each have their own result. Other columns are not read.
    """
    part = F.struct("start", "kind", "end")
    per_text = secret_rows(docs, text, keep, reach).groupBy("_row", *keep).agg(
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), part))).alias("parts"),
        *[F.count(F.when(F.col("kind") == ORDER[k], 1)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
    )
    base = F.filter("parts", lambda s: s["kind"] < ORDER["login"])
    return per_text.select(
        *keep, "n_assign", "n_access", "n_hex", F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("parts")).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[REDACTED]", reach: int = 200) -> DataFrame:
    """`docs` with every reported part of a text replaced by `mask`; all other rows and columns as they are.

    Parts that overlap are masked as far as the farthest of them reaches, with one mask for each start.
    Only texts that pass a plain test for some kind are shuffled; spans depend on the text alone,
    so they are joined by its digest, once for equal texts.
    """
    names = docs.columns
    digest = F.sha2(F.col(text).cast("binary"), 256)
    some = docs.filter(may_hold_secret(F.col(text)))
    none = docs.filter(~may_hold_secret(F.col(text)))
    so_far = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        secret_rows(some.select(F.col(text).alias("_text"), digest.alias("_digest")), "_text", ("_digest",), reach)
        .filter(F.col("kind").isNotNull()).select("_row", "_digest", "start", F.max("end").over(so_far).alias("end"))
        .groupBy("_row", "_digest").agg(F.sort_array(F.collect_list(F.struct("start", "end")), asc=False).alias("_spans"))
        .dropDuplicates(["_digest"]).select("_digest", "_spans")
    )
    state = F.struct(F.col(text).alias("t"), F.length(F.col(text)).cast("long").alias("limit"))

    def cut(acc: Column, s: Column) -> Column:
        end = F.least(s["end"], acc["limit"])
        masked = F.concat(F.substring(acc["t"], F.lit(1), s["start"].cast("int")), F.lit(mask), F.substring(acc["t"], (end + 1).cast("int"), F.length(acc["t"])))
        return F.struct(F.when(end > s["start"], masked).otherwise(acc["t"]).alias("t"), F.least(s["start"], acc["limit"]).alias("limit"))

    changed = some.withColumn("_digest", digest).join(spans, "_digest", "left")
    new = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.aggregate("_spans", state, cut)["t"])
    return none.unionByName(changed.withColumn(text, new).select(*names))
