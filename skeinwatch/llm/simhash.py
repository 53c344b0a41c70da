"""Near-duplicates by SimHash.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance
of two such vectors is at most the Hamming distance of the fingerprints, so every link
(`_RADIUS` = 2 differing bits or fewer) is a pair of vectors within distance 2. The grid has a
cell for every vector; a vector marks its own cell and those one step away (about 50), and two vectors
are within distance 2 exactly if they mark a cell in common. That is an equi-join, split by Spark
where cells are full. Of the cells that a pair shares one is the pair's own, so that each pair
is met once, and it is verified on the fingerprints within the join.

Equal fingerprints are one node from the start, whatever their number. A fingerprint has at
most 64 + 2016 others within two bits, so links grow in proportion to distinct fingerprints.

Two bits mean little more than a copy. `keep_one_similar` therefore takes near-duplicates by the Jaccard
similarity of their word shingles: cells of the same grid and bands of shingle minima (32 of 4, so that a pair at
0.8 is missed with a chance of 5e-8) propose pairs, and each is verified exactly on the shingle sets. Cells are shuffled once
and those of a single document end there. In rounds each document is tried with one centre of its cells, first that which meets most others, so a group of m copies
costs m pairs; what cells of several classes leave open is searched by prefixes of the rarest shingles.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import materialize
from .components import connected_components

_RADIUS = 2
_LOW_BITS = 0x5555555555555555
_PLAIN = bytes(32 if i in string.punctuation.encode() else i for i in range(256))
_BANDS, _BAND_ROWS = 32, 4
_ROUNDS = 2
_SLOTS = 1 << 25
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (_BANDS * _BAND_ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int, plain: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles in order; of all words where they are fewer than `width`, of nothing without words.

    `plain`: ASCII punctuation separates words as white space does.
    """
    import xxhash

    raw = text.encode("utf-8").lower()  # bytes: only A-Z change, only ASCII white space separates
    words = (raw.translate(_PLAIN) if plain else raw).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: str, width: int = 3) -> int:
    """64 bits, each set if it is set in over half of the XXH64 (seed 42) of the word shingles."""
    return majority_bits(shingle_hashes(text, width))


def simhash(text: Column) -> Column:
    """Fingerprints as signed longs; zero for null texts and texts without words."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts.fillna("")], dtype="int64")

    return of(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def segment_counts(fingerprint: Column) -> Column:
    """The 32 counts, two bits each, packed in a long."""
    low = fingerprint.bitwiseAND(F.lit(_LOW_BITS))
    high = F.shiftrightunsigned(fingerprint, 1).bitwiseAND(F.lit(_LOW_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def marked_cells(counts: Column) -> Column:
    """Own cell (step 0) and those one step up (step i + 1) or down (-i - 1) along segment i, as far as counts of 0 to 2 reach."""
    cell = "cell", "step"
    moves = [F.struct(counts.alias(cell[0]), F.lit(0).alias(cell[1]))]
    for i in range(32):
        unit = 1 << (2 * i)
        one = F.lit(unit if unit < 1 << 63 else unit - (1 << 64)).cast("long")
        at = F.shiftrightunsigned(counts, 2 * i).bitwiseAND(F.lit(3).cast("long"))
        moves.append(F.when(at < 2, F.struct(counts.bitwiseXOR(_carry(at, one, True)).alias(cell[0]), F.lit(i + 1).alias(cell[1]))))
        moves.append(F.when(at > 0, F.struct(counts.bitwiseXOR(_carry(at, one, False)).alias(cell[0]), F.lit(-i - 1).alias(cell[1]))))
    return F.filter(F.array(*moves), lambda m: m.isNotNull())


def _carry(at: Column, one: Column, up: bool) -> Column:
    """What XOR changes a count by one: 0 and 1 differ in the low bit, 1 and 2 in both."""
    both = F.shiftleft(one, 1).bitwiseOR(one)
    return F.when(at == (0 if up else 1), one).otherwise(both)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of the column `fp` (distinct) that differ in at most two bits, each once.

    Cells are merged, never broadcast: Spark sizes them by the few bytes of the fingerprints, of which each becomes about fifty rows.
    """
    slots = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(slots, "fp")  # a fixed number: small rows become about fifty each
    cells = spread.select("fp", F.explode(marked_cells(segment_counts(F.col("fp")))).alias("m")).select("fp", "m.cell", "m.step")
    x, y = cells.alias("x"), cells.alias("y")
    a, b, i, j = F.col("x.fp"), F.col("y.fp"), F.col("x.step"), F.col("y.step")
    own = ((i == 0) & (j == 0)) | ((i == 0) & (j != 0)) | ((i != 0) & (j != 0) & (i != j) & (F.abs(i) <= F.abs(j)))
    near = F.bit_count(a.bitwiseXOR(b)) <= _RADIUS
    return x.join(y.hint("merge"), (F.col("x.cell") == F.col("y.cell")) & (a < b) & own & near).select(a.alias("a"), b.alias("b"))


def classes(fingerprints: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """`fp`, `root` (a fingerprint naming the class) and `component_id` (least id of the class, null if all are) for each distinct `fp`."""
    groups = fingerprints.groupBy("fp").agg(F.min(id_column).alias("first_id"))
    links = fingerprint_links(groups.select("fp"))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    named = groups.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.select("fp", "root").join(least, "root")


def components(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable over links).

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id are linked
    too; component_id is null only if no member has an id. Repeated rows each have a row. Other columns are not read.
    """
    prints = materialize(docs.select(id_column, simhash(F.col(text)).alias("fp")), "fingerprints")
    of = classes(prints, id_column)
    return prints.join(of, "fp", "left").select(id_column, as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """`docs` with one document of each class: that with the least id (a null id only if no other is there).

    Of rows with equal id and fingerprint one stays, any of them.
    """
    prints = materialize(docs.select(id_column, simhash(F.col(text)).alias("fp")), "fingerprints")
    member = prints.join(classes(prints, id_column), "fp")
    order = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "fp")
    kept = member.groupBy("root").agg(F.min(order).alias("k")).select(_key(F.col("k.id"), F.col("k.fp")).alias("_kept"))
    keyed = docs.withColumn("_kept", _key(F.col(id_column), simhash(F.col(text))))
    return keyed.join(kept, "_kept", "left_semi").dropDuplicates(["_kept"]).drop("_kept")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: of the minima of its hash functions over the (distinct) shingle hashes, and its number."""
    import xxhash

    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[k : k + 1024, None] * _FACTORS[:, 0] + _FACTORS[:, 1]).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(_BANDS, _BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def _sketch(text: Column, width: int) -> Column:
    """fp, node (names the set of shingles), size (of that set) and bands."""

    @F.pandas_udf("fp long, node binary, size int, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            rows = []
            for t in texts.fillna(""):
                hashes = shingle_hashes(t, width, plain=True)
                distinct = np.unique(hashes)
                rows.append((majority_bits(hashes), xxhash.xxh3_128_digest(distinct.tobytes(), 7), len(distinct), band_keys(distinct)))
            yield pd.DataFrame(rows, columns=["fp", "node", "size", "bands"])

    return of(text)


def _shingle_set(text: Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, width, plain=True)).view(np.int64) for t in texts.fillna("")], dtype=object)

    return of(text)


def row_key(id_column: str, text: str) -> Column:
    """128 bits of id and text, as hexadecimal text; null and empty texts differ, and no id differs from any."""
    marked = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string"), F.lit("\0"))) for c in (id_column, text)]
    return F.md5(F.concat(*marked))


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, or that with underscores before it, so that `docs` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _perhaps(rows: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """`rows` with `flag`: false where `key` (not null) is surely none of the keys in `wanted`, true where a join has to tell.

    All tasks get a bitmap of the keys' hashes, 4 MB whatever the sizes of the tables, so that rows without a partner are not shuffled to find that out.
    """
    number, bits = free_name(rows, "_number"), free_name(rows, "_bits")
    slot = F.pmod(F.xxhash64(key), F.lit(_SLOTS)) + 1
    map_ = wanted.groupBy(F.bitmap_bucket_number(slot).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bits))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn(number, F.bitmap_bucket_number(slot)).join(F.broadcast(map_), number, "left")
    return met.withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(number, bits)


def _close(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(a, b) + 1e-9 >= F.greatest(a, b) * similarity


class _Classes:
    """Links found so far among the nodes (shingle sets) that share a cell, and the classes they make."""

    def __init__(self, sets: DataFrame, similarity: float):
        self.sets, self.similarity, self.links = sets, similarity, None
        self.roots = sets.sparkSession.createDataFrame([], "node binary, root binary")

    def placed(self, nodes: DataFrame) -> DataFrame:
        return nodes.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def try_pairs(self, pairs: DataFrame) -> None:
        """Adds those of the pairs (a, b) whose sets are similar."""
        left, right = (self.sets.select(F.col("node").alias(k), F.col("s").alias(s)) for k, s in (("a", "p"), ("b", "q")))
        both = F.size(F.array_intersect("p", "q"))
        near = both + 1e-9 >= (F.size("p") + F.size("q") - both) * self.similarity
        new = materialize(pairs.join(left, "a").join(right, "b").filter(near).select("a", "b"), "links")
        self.links = new if self.links is None else self.links.unionByName(new)
        self.roots = materialize(connected_components(self.links).select("node", "root"), "roots")


def _rounds_of_centres(shared: DataFrame, classes: _Classes) -> None:
    """Links each node to a centre, one link a node and round: a group of m similar nodes costs m pairs, not m squares.

    In each round a cell has another centre: first the node that meets most others, as a text does of which the others are edits, then the
    least by a hash of the round; nodes of other classes are tried with that centre they meet in most cells, which is likely the most similar
    one. What rounds leave is searched afterwards, so their number decides on cost only.
    """
    for number in range(_ROUNDS):
        placed = classes.placed(shared)
        order = F.struct(-F.col("met") if number == 0 else F.lit(0), F.xxhash64("node", F.lit(number)))
        centres = placed.groupBy("cell").agg(F.min_by(F.struct("node", "root", "size"), order).alias("c"))
        meets = placed.join(centres, "cell").filter((F.col("root") != F.col("c.root")) & _close(F.col("size"), F.col("c.size"), classes.similarity))
        often = meets.groupBy("node", F.col("c.node").alias("b")).agg(F.count("*").alias("n"))
        classes.try_pairs(often.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b")))


def _left_pairs(shared: DataFrame, classes: _Classes) -> DataFrame:
    """All pairs of nodes of different classes that may still be similar, by prefixes of their rarest shingles.

    Only nodes of cells that hold several classes are left. Ordered by how many of them have a shingle, similar sets share one among
    the first size - ceil(similarity * size) + 1 of each; shingles of one node alone count there but meet nobody. At the first shingle
    that a pair shares, what follows in both must suffice for the overlap that the similarity asks for.
    """
    t = classes.similarity
    placed = classes.placed(shared)
    mixed = placed.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("cell")
    left = materialize(placed.join(mixed, "cell", "left_semi").select("node", "root", "size").distinct(), "left-nodes")
    items = classes.sets.join(left.select("node"), "node").select("node", F.explode("s").alias("shingle"))
    met = items.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    common = items.join(met, "shingle").groupBy("node").agg(F.collect_list(F.struct("df", "shingle")).alias("c")).join(left, "node")
    alone = F.col("size") - F.size("c")
    long = F.size("c") - F.ceil(F.col("size") * t - 1e-9) + 1
    prefix = F.slice(F.array_sort("c"), F.lit(1), F.greatest(long, F.lit(0)).cast("int"))
    index = common.select("node", "root", "size", alone.alias("alone"), F.posexplode(prefix).alias("at", "x")).select(
        "node", "root", "size", F.col("x.shingle").alias("shingle"), (F.col("size") - F.col("alone") - F.col("at")).alias("rest")
    )  # rest: the shingle and what follows it
    index = materialize(index, "prefixes")
    x, y = index.alias("x"), index.alias("y")
    needed = F.ceil((F.col("x.size") + F.col("y.size")) * t / (1 + t) - 1e-9)
    fits = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _close(F.col("x.size"), F.col("y.size"), t)
    fits &= F.least("x.rest", "y.rest") >= needed
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def keep_one_similar(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document of each class of near-duplicates: that with the least id (a null id only if no other is there).

    Words are what white space and ASCII punctuation leave, A-Z lower-cased. Two documents are linked if the Jaccard similarity of their sets of
    `width` words is at least `similarity`; classes are what links reach. Of rows with equal id and text one stays. Null and empty texts
    and those without words are one class. All columns are kept, whatever their names. An empty table gives no rows.
    """
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = row_key(id_column, text)
    read = docs.select(F.col(id_column).alias("id"), row.alias("row"), _sketch(F.col(text), width).alias("s"))
    prints = materialize(read.select("id", "row", "s.*"), "sketches")
    groups = prints.filter("size > 0").groupBy("node").agg(F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    grid = F.transform(marked_cells(segment_counts(F.col("fp"))), lambda m: m["cell"])
    cells = groups.repartition(slots, "node").select("node", "size", F.explode(F.concat("bands", grid)).alias("cell"))
    met = F.count("*").over(Window.partitionBy("cell"))
    several = cells.withColumn("n", met).filter("n > 1")  # most cells have one node and end here
    shared = materialize(several.withColumn("met", F.sum("n").over(Window.partitionBy("node"))).drop("n"), "shared-cells")
    wanted = prints.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    wanted = materialize(wanted, "wanted")
    asked = _perhaps(docs.select(row.alias("row"), F.col(text).alias("t")), "row", wanted, "asked").filter("asked")
    texts = asked.join(wanted, "row").dropDuplicates(["node"])
    sets = materialize(texts.select("node", _shingle_set(F.col("t"), width).alias("s")), "shingles")

    classes = _Classes(sets, similarity)
    _rounds_of_centres(shared, classes)
    classes.try_pairs(_left_pairs(shared, classes))

    rows = prints.groupBy("row").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("node").alias("node"))
    named = classes.placed(rows)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("k"))
    judged = named.join(best, "root").select("row", "n", (F.col("row") == F.col("k.row")).alias("stays"))
    # only rows to drop, and kept ones that are there more than once, are looked up again
    key, flag = free_name(docs, "_row"), free_name(docs, "_marked")
    marks = materialize(judged.filter("NOT stays OR n > 1").select(F.col("row").alias(key), "stays"), "marks")
    keyed = _perhaps(docs.withColumn(key, row), key, marks, flag)
    marked = keyed.filter(flag)
    plain = keyed.filter(~F.col(flag)).unionByName(marked.join(marks, key, "left_anti"))
    repeated = marked.join(marks.filter("stays"), key, "left_semi").dropDuplicates([key])
    return plain.unionByName(repeated).drop(key, flag)


def _key(doc_id: Column, fp: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), fp.cast("string"))
