"""Document fingerprints: invertible Bloom lookup sketches of paragraphs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import cut

#: Cells of each of the three subtables of a fingerprint.
CELLS = 16
#: Digests that three subtables can hold for sure: beyond 0.81 of the cells peeling fails.
HOLDS = 3 * CELLS * 4 // 5
#: On failure the paragraphs are dealt into groups of about so many; a group's subtables start at as many cells and double with each try.
GROUP = 8
RETRIES = 6
ROUNDS = 14
#: Bytes of text to a range of ids.
PART = 1 << 27


def paragraph_digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs: the sentences of its lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+")))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    """32 bits by which a cell with one key is told from a cell with several."""
    return F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _cells_of(key: Column, cells: int) -> list[Column]:
    """The key's cell in each of the three subtables, numbered through them."""
    return [F.shiftrightunsigned(key, 16 * t).bitwiseAND(F.lit(cells - 1)).cast("int") + F.lit(t * cells) for t in range(3)]


def _empty() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))


def _merge(acc: Column, n: Column, key: Column, check: Column) -> Column:
    return F.struct((acc["n"] + n).alias("n"), acc["k"].bitwiseXOR(key).alias("k"), acc["h"].bitwiseXOR(check).alias("h"))


def _runs(rows: Column, same: str) -> Column:
    """Sorted rows as slices of equal ``same``: two passes over the rows, however many slices there are."""
    starts = F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | (x[same] != F.get(rows, i - 1)[same]), i)), lambda i: i.isNotNull())
    return _let(starts, lambda at: F.transform(at, lambda i, j: F.slice(rows, i + 1, F.coalesce(F.get(at, j + 1), F.size(rows)) - i)))


def _spread(keys: Column, cells: int) -> Column:
    """Signed digests (k; n: 1 or -1) with their checks and the cells that they go to."""
    return F.transform(keys, lambda x: F.struct(
        x["k"].alias("k"), x["n"].alias("n"), _check(x["k"]).alias("h"), *(c.alias(f"c{t}") for t, c in enumerate(_cells_of(x["k"], cells)))))


def _add(table: Column, keys: Column, cells: int, sign: int = 1) -> Column:
    """The table with spread keys added to their cells, or taken away. A key is in one cell of each
    subtable, so a cell looks for its keys by that subtable's number only."""
    return F.concat(*(F.transform(F.slice(table, t * cells + 1, cells), lambda c, i: F.aggregate(
        F.filter(keys, lambda p: p[f"c{t}"] == i + t * cells), c, lambda a, p: _merge(a, sign * p["n"], p["k"], p["h"]))) for t in range(3)))


def _signed_sketch(keys: Column, cells: int) -> Column:
    """The sketch of signed digests."""
    blank = F.transform(F.sequence(F.lit(1), F.lit(3 * cells)), lambda _: _empty())
    return _let(_spread(keys, cells), lambda x: _add(blank, x, cells))


def sketch(keys: Column, cells: int = CELLS) -> Column:
    """The sketch of a set of digests: per cell how many, the XOR of the keys and of their checks."""
    return _signed_sketch(F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(1).alias("n"))), cells)


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell: common paragraphs cancel out."""
    return F.zip_with(a, b, lambda x, y: _merge(x, -y["n"], y["k"], y["h"]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pure(cells: Column, size: int) -> Column:
    """The digests that are alone in one of their cells, with their checks and the cells that they are in."""
    alone = F.filter(F.transform(cells, lambda c, i: F.when(
        (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"])),
        F.struct(c["k"].alias("k"), c["n"].alias("n"), c["h"].alias("h"), *(x.alias(f"c{t}") for t, x in enumerate(_cells_of(c["k"], size))), i.alias("at")),
    )), lambda p: p.isNotNull())
    there = lambda p, t: (F.get(cells, p[f"c{t}"])["k"] == p["k"]) & (F.get(cells, p[f"c{t}"])["n"] == p["n"])
    # Alone in several of its cells, a digest counts in the first of them.
    return F.filter(alone, lambda p: F.when(p["at"] == p["c0"], True).when(p["at"] == p["c1"], ~there(p, 0)).when(
        p["at"] == p["c2"], ~there(p, 0) & ~there(p, 1)).otherwise(False))


def peel(cells: Column, size: int = CELLS) -> Column:
    """Recover the digests of a difference, cells with a single digest first: (ok, plus, minus).

    ``plus`` and ``minus`` are the digests of the first and of the second set only.
    """
    keys = "array<struct<k: bigint, n: int, h: bigint, c0: int, c1: int, c2: int, at: int>>"
    state = lambda x, got: F.struct(x.alias("cells"), _pure(x, size).alias("pure"), got.alias("got"))
    step = lambda s: F.when(F.size(s["pure"]) == 0, s).otherwise(_let(
        _add(s["cells"], s["pure"], size, -1), lambda x: state(x, F.concat(s["got"], s["pure"]))))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), _let(cells, lambda x: state(x, F.array().cast(keys))), lambda s, _: step(s))
    digests = lambda s, n: F.transform(F.filter(s["got"], lambda x: x["n"] == n), lambda x: x["k"])
    return _let(end, lambda s: F.struct(
        F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0)).alias("ok"),
        digests(s, 1).alias("plus"), digests(s, -1).alias("minus")))


def difference(a_keys: Column, a_cells: Column, b_keys: Column, b_cells: Column) -> Column:
    """How many paragraphs differ between two versions, by subtracting and peeling their sketches.

    Where the fixed-size sketches do not peel, or where the numbers of digests alone differ by more
    than they hold, larger ones are made: the digests are dealt into groups of about GROUP, and each
    group gets a sketch of its own. A group that does not peel is hashed anew into subtables of twice
    the cells. An error is raised if all tries of a group fail (under 1e-9 for thousands of paragraphs).
    """
    fixed = F.when(F.abs(F.size(a_keys) - F.size(b_keys)) <= HOLDS, _let(peel(subtract(a_cells, b_cells)), _recovered))
    return F.coalesce(fixed, _grouped(a_keys, b_keys))


def _recovered(peeled: Column) -> Column:
    return F.when(peeled["ok"], F.size(peeled["plus"]) + F.size(peeled["minus"]))


def _grouped(a_keys: Column, b_keys: Column) -> Column:
    """The number of differing digests from grouped sketches. One sort brings each group's digests
    together, so the work grows with their number, not with its square."""

    def signed(keys: Column, sign: int, groups: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(
            F.pmod(F.shiftrightunsigned(F.xxhash64(k, F.lit(0)), 20), groups).alias("g"), k.alias("k"), F.lit(sign).alias("n")))

    def attempt(rows: Column, r: int) -> Column:
        anew = F.transform(rows, lambda x: F.struct(F.xxhash64(x["k"], F.lit(r)).alias("k"), x["n"].alias("n")))
        size = GROUP << (r - 1)
        return _let(peel(_signed_sketch(anew, size), size), _recovered)

    groups = F.ceil((F.size(a_keys) + F.size(b_keys)) / F.lit(GROUP))
    failed = F.raise_error(F.lit("the sketches did not peel")).cast("int")
    return _let(groups, lambda n: _let(F.sort_array(F.concat(signed(a_keys, 1, n), signed(b_keys, -1, n))), lambda rows: F.aggregate(
        _runs(rows, "g"), F.lit(0), lambda acc, x: acc + F.coalesce(*(attempt(x, r) for r in range(1, RETRIES + 1)), failed))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two versions' paragraphs; a and b are structs of keys and cells. Two texts
    without paragraphs are alike."""
    both = F.size(a["keys"]) + F.size(b["keys"])
    return F.when(both == 0, F.lit(1.0)).otherwise(
        _let(difference(a["keys"], a["cells"], b["keys"], b["cells"]), lambda d: (both - d) / (both + d)))


def fingerprint_text(cells: Column) -> Column:
    """The sketch as text: every cell's count, key and check in hexadecimal digits."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["n"] == 0, F.lit("0")).otherwise(F.lower(F.concat(
        F.hex(c["n"]), F.lit("."), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 8, "0"))))), "-")


def paragraph_sketch(text: Column) -> Column:
    """The digests of a text's paragraphs and their sketch: a struct of keys and cells."""
    return _let(paragraph_digests(text), lambda k: F.struct(k.alias("keys"), sketch(k).alias("cells")))


def with_next(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, facts: dict[str, Column] | None = None
) -> DataFrame:
    """(id, text, next_text): each document with the next one's text by descending id; after the
    last comes the first.

    Rows are dealt into ``parts`` ranges (by default of about PART bytes of text) of the id and, so
    that an id with many texts and missing ids make no range of their own, of a hash of the text.
    Each range is ordered by itself and written, so that a lost executor cannot move its bounds. A
    range also gets the first document of the range below as its last row, so no range needs another
    one's rows; which range that is one task finds from the ranges' numbers. Equal ids are ordered by
    that hash and then by text, null ids come last. Ids are of any type that has an order.

    ``facts`` are expressions of the column ``text``: each is worked out once a row and returned under
    its name, and as next_<name> for the next document.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 11).alias("spread"))
    if parts is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART))
    order = [F.col("id").desc_nulls_last(), F.col("spread").desc()]
    ranged = cut(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").desc())
        .select("id", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranges",
    )
    heads = ranged.where(F.col("at") == F.shiftleft(F.col("part").cast("long"), 33))  # rows of a partition are numbered from there
    numbers = heads.select("part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("after"))
    borrowed = heads.join(numbers, "part").select("id", "text", F.col("after").alias("part"), F.lit((1 << 63) - 1).alias("at"), F.lit(True).alias("borrowed"))
    made = facts or {}
    every_row = ranged.withColumn("borrowed", F.lit(False)).unionByName(borrowed).repartition("part").select("*", *(c.alias(name) for name, c in made.items()))
    w = Window.partitionBy("part").orderBy("at")
    ahead = every_row.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("text", *made)))
    return ahead.where("not borrowed").drop("part", "at", "borrowed")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited version, and compare them.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of
    the next document (by descending id; after the last the first). Returns ``id_col``, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: the likeness of the
    text's sketch to the edited text's and the next document's, from the paragraphs that peeling
    recovers. Each text is sketched once and its sketch goes along with it to the document before.
    One row per input row; null is empty; equal texts have equal fingerprints; a single document is
    its own next.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, id_col=id_col, text_col=text_col, facts={"own": paragraph_sketch(F.col("text"))}).withColumn(
        "edited", F.concat(F.expr("left(text, length(text) - floor(length(text) / 2))"), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own",
        F.explode(F.array(paragraph_sketch(F.col("edited")))).alias("other"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        fingerprint_text(F.col("own.cells")).alias("fingerprint"), fingerprint_text(F.col("other.cells")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
