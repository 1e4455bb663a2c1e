"""Document fingerprints: invertible Bloom lookup tables over hashed paragraphs, all in DataFrame functions.

A paragraph is a line; a line of more than PIECE words counts as paragraphs of PIECE words. Each
distinct paragraph digest is added to one cell of each of three subtables; a cell has a count and the
XORs of digests and of their check hashes. Tables of two versions subtract cell by cell: what both have
cancels. A cell with one digest left gives it away, which takes it out of two more cells, and so on
(peeling). Where that gets stuck, both versions are sketched again in larger tables.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, partitions, small_text

PIECE = 16
#: Cells of each of the three subtables of a fingerprint.
SIDE = 5
#: Passes over the three subtables in one attempt.
PASSES = 5
#: Tasks of an attempt for each shuffle partition: a digest of eight bytes becomes rows of some hundred.
SPREAD = 3


def paragraph_digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs, in order of appearance; none for an empty text."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?:[^\s]++[^\S\n]*+){1,%d}+" % PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(F.rtrim(p))))


def check_hash(digest: Column) -> Column:
    """32 bits that tell a digest from an XOR of several."""
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit("check")), 32)


def cell_of(digest: Column, subtable: int, seed: Column | int, side: Column) -> Column:
    place = F.pmod(F.xxhash64(digest, F.lit(subtable), seed if isinstance(seed, Column) else F.lit(seed)), side)
    return (place + side * subtable).cast("int")


def fingerprint(digests: Column) -> Column:
    """The table of 3 x SIDE cells as text: count.digests.checks in hexadecimal, empty cells as a dash."""

    def cell(j: Column, subtable: int) -> Column:
        inside = F.filter(digests, lambda d: F.pmod(F.xxhash64(d, F.lit(subtable), F.lit(0)), F.lit(SIDE)) == j)
        key = F.aggregate(inside, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d))
        check = F.aggregate(inside, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(check_hash(d)))
        return F.when(F.size(inside) == 0, "-").otherwise(F.concat_ws(".", F.hex(F.size(inside)), F.lower(F.hex(key)), F.lower(F.hex(check))))

    def subtable(t: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda j: cell(j, t))

    return F.array_join(F.concat(*[subtable(t) for t in range(3)]), " ")


def _updates(subtable: int, seed: int) -> Column:
    """What a cell becomes in a pass over one subtable: itself, or if it gives a digest away also the
    three cells that it leaves and a tally (cell -1: only in the first version, -2: only in the second)."""
    c, k, x, cell, side = (F.col(n) for n in ("c", "k", "x", "cell", "side"))

    def row(cell_, c_, k_, x_):
        return F.struct(cell_.cast("int").alias("cell"), c_.cast("int").alias("c"), k_.alias("k"), x_.alias("x"))

    zero = F.lit(0).cast("long")
    pure = (cell >= 0) & (cell >= subtable * side) & (cell < (subtable + 1) * side) & (F.abs(c) == 1) & (x == check_hash(k))
    gone = [row(cell_of(k, t, seed, side), -c, k, x) for t in range(3)]
    return F.when(pure, F.array(row(cell, c, k, x), *gone, row(F.when(c == 1, -1).otherwise(-2), F.lit(1), zero, zero))).otherwise(F.array(row(cell, c, k, x)))


def peel(pairs: DataFrame, attempt: int) -> DataFrame:
    """(h1, h2, pair, first, second, stuck) of pairs (h1, h2, pair, a, b): digests recovered on either side.

    Attempt 0 has tables as small as the fingerprints; later ones by the numbers of digests, doubled each time.
    pairs must be partitioned by (h1, h2): all passes then run in one stage without a shuffle.
    """
    both = F.size("a") + F.size("b")
    side = F.lit(SIDE) if attempt == 0 else (F.ceil(both * 0.8 * 2 ** (attempt - 1)) + 4).cast("int")
    tagged = F.concat(F.transform("a", lambda d: F.struct(d.alias("d"), F.lit(1).alias("s"))), F.transform("b", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("s"))))
    start = F.array(F.struct(F.lit(None).cast("long").alias("d"), F.lit(0).alias("s")))
    keys = ["h1", "h2", "pair", "side", "cell"]
    t = pairs.select("h1", "h2", "pair", side.alias("side"), F.explode(F.concat(start, tagged)).alias("e")).select("h1", "h2", "pair", "side", "e.d", "e.s")
    places = F.when(F.col("d").isNull(), F.array(F.lit(-1))).otherwise(F.array(*[cell_of(F.col("d"), i, attempt, F.col("side")) for i in range(3)]))
    t = t.select("*", F.explode(places).alias("cell"))
    zero = F.lit(0).cast("long")
    t = t.groupBy(*keys).agg(F.sum("s").cast("int").alias("c"), F.coalesce(F.bit_xor("d"), zero).alias("k"), F.coalesce(F.bit_xor(F.when(F.col("d").isNotNull(), check_hash(F.col("d")))), zero).alias("x"))
    live = "cell < 0 or c <> 0 or k <> 0 or x <> 0"
    for i in range(3 * PASSES):
        t = t.where(live).select("h1", "h2", "pair", "side", F.explode(_updates(i % 3, attempt)).alias("u")).select("h1", "h2", "pair", "side", "u.cell", "u.c", "u.k", "u.x")
        t = t.groupBy(*keys).agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x"))
    tally = [F.sum(F.when(F.col("cell") == v, F.col("c")).otherwise(0)).alias(n) for v, n in ((-1, "first"), (-2, "second"))]
    return t.where(live).groupBy("h1", "h2", "pair").agg(*tally, F.max(F.col("cell") >= 0).alias("stuck"))


def likeness(sketched: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(h1, h2, pair, near): share of paragraphs in common (Jaccard) of two digest columns of each row.

    sketched: a written table, a row per (h1, h2). pairs: name -> (first column, second column). Two
    empty sides are alike (1.0). The first tables hold as many differences as the two sides can have, but for
    bad luck; pairs that get stuck are sketched anew, twice as large and with other places, until all are peeled.
    """
    n = SPREAD * partitions(sketched.sparkSession)
    columns = sorted({c for p in pairs.values() for c in p})
    wanted, done = None, []
    for attempt in count(1):
        rows = sketched.select("h1", "h2", *columns)
        if wanted is not None:
            rows = rows.join(wanted, ["h1", "h2"])
        rows = rows.repartition(n, "h1", "h2")
        options = [F.struct(F.lit(name).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for name, (a, b) in pairs.items()]
        long = rows.select("h1", "h2", F.explode(F.array(*options)).alias("p"), *(["stuck_pairs"] if wanted is not None else []))
        if wanted is not None:
            long = long.where(F.array_contains("stuck_pairs", F.col("p.pair")))
        got = materialize(peel(long.select("h1", "h2", "p.pair", "p.a", "p.b"), attempt), f"peeled{attempt}")
        done.append(got.where("not stuck").select("h1", "h2", "pair", "first", "second"))
        stuck = got.where("stuck")
        if stuck.isEmpty():
            break
        wanted = stuck.groupBy("h1", "h2").agg(F.collect_set("pair").alias("stuck_pairs"))  # as many as pairs has
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    return found


def _order(docs: DataFrame) -> DataFrame:
    """(h1, h2, n_chars, take, before1, before2, take_before): each document, and whom it follows in
    descending order, the first following the last. take: how much of the next document its edit takes.

    Only ids and hashes move: range partitions are ordered in themselves, and their ends are joined.
    """
    rows = docs.groupBy("doc_id", "h1", "h2", "n_chars").agg(F.lit(0)).select("doc_id", "h1", "h2", "n_chars")
    by = [F.desc_nulls_last("doc_id"), F.desc("h1"), F.desc("h2")]
    rows = materialize(rows.repartitionByRange(partitions(docs.sparkSession), *by).withColumn("pid", F.spark_partition_id()), "order")
    me = F.struct("h1", "h2", F.floor(F.col("n_chars") / 3).cast("long").alias("take"))
    w = Window.partitionBy("pid").orderBy(*by)
    linked = rows.select("*", F.lag(me).over(w).alias("before"), F.row_number().over(w).alias("at"), F.count("*").over(Window.partitionBy("pid")).alias("of"))
    linked = materialize(linked.withColumn("me", me), "linked")
    # a row per range partition: small enough for one window, and to broadcast
    ends = linked.where("at = of").select("pid", F.col("me").alias("end"))
    last = F.last("end").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("pid", F.coalesce(F.lag("end").over(Window.orderBy("pid")), last).alias("end"))
    joined = linked.join(F.broadcast(ends), "pid").withColumn("b", F.coalesce("before", "end"))
    out = materialize(joined.select("h1", "h2", "n_chars", "me.take", F.col("b.h1").alias("before1"), F.col("b.h2").alias("before2"), F.col("b.take").alias("take_before")), "neighbours")
    drop_table(rows)
    drop_table(linked)
    return out


def version_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document in descending id order, the first following the last. Null texts are empty;
    a null id comes last; rows of equal id follow each other by hashes of id and text; rows equal in
    both are one document in that order and all get its result. A table of one document follows itself; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    text = small_text(docs[text_col])
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("*", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64("text", "doc_id").alias("h2"))
    order = _order(base.select("doc_id", "h1", "h2", F.length("text").cast("long").alias("n_chars")))
    once = base.groupBy("h1", "h2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = once.join(order, ["h1", "h2"])
    given = rows.select(F.col("before1").alias("h1"), F.col("before2").alias("h2"), F.col("doc_id").alias("next_id"), F.col("copies").alias("next_copies"), F.expr("left(text, cast(take_before as int))").alias("prefix"), paragraph_digests(F.col("text")).alias("next"))
    met = rows.join(given, ["h1", "h2"])
    edited = F.concat(F.expr("left(text, cast(n_chars - take as int))"), F.col("prefix"))
    met = met.select("h1", "h2", "doc_id", "copies", "next_id", "next_copies", "n_chars", "text", edited.alias("edited"), "next")
    # next_copies is kept so that both sides of the join need the same columns and share one shuffle of the texts
    met = met.select("h1", "h2", "doc_id", "copies", "next_id", "next_copies", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("edited")).alias("edit"), "next")
    sketched = materialize(met, "digests")
    near = likeness(sketched, {"edited": ("own", "edit"), "next": ("own", "next")})
    sides = near.groupBy("h1", "h2").agg(*[F.max(F.when(F.col("pair") == p, F.struct("first", "second"))).alias(f"d_{p}") for p in ("edited", "next")])
    out = sketched.join(sides, ["h1", "h2"])

    def share(d: str) -> Column:
        total = F.size("own") + F.col(f"{d}.second")
        return F.when(total == 0, 1.0).otherwise((F.size("own") - F.col(f"{d}.first")) / total)

    out = out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"), share("d_edited").alias("near_edited"), share("d_next").alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_"))
    return out.drop("_")
