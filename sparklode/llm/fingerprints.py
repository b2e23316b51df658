"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are pairs of neighbouring words (lower case, between white spaces; the last word stands alone too), weighted by how often they
occur. Weights are whole numbers, so a term of weight w is w elements: the term with 1, ..., w. Each of ``DRAWS`` hash functions orders
all elements of a text, and the greatest is its sample: a term is drawn in proportion to its weight, and two texts' samples agree
with the probability of their generalised Jaccard similarity, for each hash function. No logarithms are needed for whole weights,
which is what makes every hash function over all elements affordable.

Texts are shuffled once, by ranges of doc_id between quantiles of a sample; a range also gets the first document of the range after it, so that each
document meets the next one without a global sort. All grouping stays in that partitioning.

Defined results: a null text counts as empty; texts without terms have the empty fingerprint, are wholly like each other (1.0) and
unlike all others (0.0); rows with equal doc_id are ordered by a hash of their text, so that many of them fall into several ranges; a null id
counts as the smallest long; with one row the next document is itself; ids may be any longs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import partitions

DRAWS = 64  # hash functions
CODE_BITS = 28  # of a sample's identity
RANGE_ROWS, MOST_RANGES, SAMPLED = 100, 16_384, 8
BLOCK = 128  # split points that a row is compared with at a time


def split_points(docs: DataFrame) -> list[tuple[int, int]]:
    """(doc_id, hash of the text) of the first row of each range but the first, from a sample of SAMPLED rows a range: only balance hangs on them."""
    n = docs.count()
    many = min(MOST_RANGES, n // RANGE_ROWS)
    if many < 2:
        return []
    got = docs.select("key", "hash").sample(min(1.0, 1.1 * SAMPLED * many / n), 29).collect()  # about SAMPLED * MOST_RANGES pairs of numbers at most
    got = sorted((r["key"], r["hash"]) for r in got)
    return sorted({got[i * len(got) // many] for i in range(1, many)}) if got else []


def with_range(rows: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """``rows`` (key, hash, ...) with range, the number of split points that are not behind the row: its place in a block of BLOCK points, after its block's.

    Points are hexadecimal digits, which sort as the numbers do. It is one expression that is never null: a filter on range, also one that the optimizer
    infers, has it once. A column for each step of a binary search was written out in the steps' number of powers.
    """
    if not points:
        return rows.withColumn("range", F.lit(0))
    digits = ["".join(f"{n + (1 << 63):016x}" for n in p) for p in points]
    sign = F.lit(-(1 << 63))
    own = F.concat(*(F.lpad(F.lower(F.hex(F.col(c).bitwiseXOR(sign))), 16, "0") for c in ("key", "hash")), F.lit("~"))  # behind an equal point
    known = lambda some: F.split(F.lit(",".join(some)), ",")  # noqa: E731  folded into a constant
    before = lambda some: F.coalesce(F.array_position(F.sort_array(F.array_append(some, own)), own).cast("int"), F.lit(1)) - 1
    block = F.greatest(before(known(digits[::BLOCK])) - 1, F.lit(0)) * BLOCK
    return rows.withColumn("range", block + before(F.slice(known(digits), block + 1, BLOCK)))


def ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (key, hash, ...) with its range, and (range to send to, first key, hash) of every range: MOST_RANGES rows at most."""
    placed = with_range(docs, split_points(docs))
    firsts = placed.groupBy("range").agg(F.min(F.struct("key", "hash")).alias("first"))
    ends = firsts.agg(F.max("range").alias("last")).first()["last"]
    before = Window.orderBy("range")
    return placed, firsts.select(F.coalesce(F.lag("range").over(before), F.lit(ends)).alias("to"), F.col("first.key").alias("first_key"), F.col("first.hash").alias("first_hash"))


def with_next(docs: DataFrame) -> DataFrame:
    """range, place, late, doc_id, text, next of every row; late rows are copies of the next range's first document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "hash": F.xxhash64("text")})
    placed, firsts = ranges(docs)
    late = docs.join(F.broadcast(firsts), (F.col("key") == F.col("first_key")) & (F.col("hash") == F.col("first_hash")))  # firsts: MOST_RANGES rows at most
    late = late.withColumn("nth", F.row_number().over(Window.partitionBy("to").orderBy("doc_id"))).where("nth = 1")  # of equal rows one
    columns = ["key", "hash", "doc_id", "text"]
    both = placed.select("range", F.lit(0).alias("late"), *columns).unionByName(late.select(F.col("to").alias("range"), F.lit(1).alias("late"), *columns))
    order = Window.partitionBy("range").orderBy("late", "key", "hash", "text", "doc_id")  # all columns, so that whatever reads this reads the same exchange
    both = both.repartition(4 * partitions(docs.sparkSession, docs), "range")
    return both.select("range", F.row_number().over(order).alias("place"), "late", "doc_id", "text", F.lead("text").over(order).alias("next"))


def edit(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next document's."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def drawn(element: Column, k: int) -> Column:
    """The place of an element in the order of hash function k: a bijection, so that equal places are equal elements."""
    salt = (k + 1) * 0x9E3779B97F4A7C15 & ((1 << 63) - 1)
    return F.xxhash64(element.bitwiseXOR(F.lit(salt)))


def signatures(texts: DataFrame, *keys: str) -> DataFrame:
    """*keys and signature: array of k << CODE_BITS | identity for each hash function k. ``texts`` has keys and text, its partitioning kept."""
    words = F.split(F.lower(F.trim(F.translate("text", "\n\r\t\f\v", "     "))), " +")
    pairs = texts.where(F.length("text") > 0).select(*keys, words.alias("w")).select(*keys, F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"))))
    pairs = pairs.where("a != ''").select(*keys, F.xxhash64("a", F.coalesce("b", F.lit(""))).alias("term"))
    weighted = pairs.groupBy(*keys, "term").agg(F.count("*").alias("weight"))
    elements = weighted.select(*keys, "term", F.explode(F.sequence(F.lit(1).cast("long"), "weight")).alias("copy")).select(*keys, F.xxhash64("term", "copy").alias("element"))
    most = elements.groupBy(*keys).agg(*(F.max(drawn(F.col("element"), k)).alias(f"_d{k}") for k in range(DRAWS)))
    code = [F.col(f"_d{k}").bitwiseAND(F.lit((1 << CODE_BITS) - 1)).bitwiseOR(F.lit(k << CODE_BITS)) for k in range(DRAWS)]
    return most.select(*keys, F.array(*code).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hash functions that have the same sample in both."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / float(DRAWS))


def text_of(signature: Column) -> Column:
    """Nine hexadecimal digits for each sample: hash function and identity."""
    return F.concat_ws("", F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 9, "0")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # ranges stay where they are in the join below
    rows = with_next(docs).withColumn("edited", F.when(F.col("late") == 0, edit(F.col("text"), F.col("next"))))
    about = rows.select("range", "place", "late", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    texts = rows.select("range", "place", F.posexplode(F.array("text", "edited")).alias("form", "text"))
    signed = signatures(texts, "range", "place", "form").groupBy("range", "place").agg(
        F.max(F.when(F.col("form") == 0, F.col("signature"))).alias("own"), F.max(F.when(F.col("form") == 1, F.col("signature"))).alias("changed")
    )
    none = F.array().cast("array<bigint>")
    found = about.join(signed, ["range", "place"], "left").withColumns({k: F.coalesce(k, none) for k in ("own", "changed")})
    found = found.withColumn("following", F.lead("own").over(Window.partitionBy("range").orderBy("place"))).where("late = 0")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
