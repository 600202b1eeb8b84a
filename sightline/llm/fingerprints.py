"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions alone.

The shingles of a text are its stretches of SHINGLE words (`[^\\x20\\x09-\\x0D]+`); a text of fewer words is one shingle, a text without words has none.
A sketch is the sorted array of the K least of the distinct 64-bit hashes of the shingles.  Of two sketches follow, without the texts:

* `resemblance`: of the K least hashes of both together, the share that both hold; exact where neither is full;
* `containment`: what share of the first one's shingles the second holds, by the same count and the numbers of distinct shingles;
* `distinct_shingles`: K - 1 over the K-th least hash as a share of all values; exact where the sketch is not full;
* `merged`: the sketch of the shingles of both, and `merged_by`, that of the rows of each group, however large.

Edited texts take the head of the next document.  Documents are dealt into ranges of (doc_id, hash of the text), and the first row of each range
is dealt to the range before it as well (that of the first range to the last one), so that one window over each range sees every row's next one.
The ranges are bounded by keys that one range partition of the keys alone has found: a row for each range passes through the driver, and
the texts are shuffled once.

Defined results.  A null text counts as empty.  Sketches of two texts without words have likeness 1, of one such text 0.  Equal texts have equal
fingerprints.  A null doc_id comes after all others; rows that share a doc_id are in the order of a hash of their text, and rows equal in both are
interchangeable, next to each other and in one range.  The document after the last is the first; a single document is its own next.  A text of
any length is one row.  An empty table gives no rows.  Only doc_id and the text column are read, so that other columns may have any names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes of a sketch: the standard error of a likeness is 1 / (2 sqrt(K)) at most.
K = 256
#: Words of a shingle.
SHINGLE = 5
#: Bytes of text that a range of documents aims at.
RANGE_BYTES = 16 << 20
#: Parts in which the hashes of a group are ranked first.
SPREAD = 64
_WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _WHITE), lambda w: w != "")


def _hashes(words: Column, size: int) -> Column:
    """The distinct 64-bit hashes of the shingles of an array of words."""
    n = F.size(words)
    all_of = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(size)]))
    return F.when(n >= size, F.array_distinct(all_of)).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(rows: DataFrame, text: str, name: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """rows and the sketch of the text as the column `name`."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    split = rows.select(*columns, words_of(F.coalesce(F.col(text), F.lit(""))).alias(f"{name}_words"))
    return split.select(*columns, F.slice(F.sort_array(_hashes(F.col(f"{name}_words"), size)), 1, k).alias(name))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the shingles that either holds."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the shingles of either text that both hold."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles."""
    share = (F.element_at(sketch, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b holds; 1 where a has none."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merged_by(rows: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """keys and the sketch of all rows of each group.

    Equal hashes of a group meet first, spread over all tasks; then the hashes of a group are ranked in SPREAD parts, and at last the k least of each part, so that
    no task holds a group."""
    flat = rows.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    part = F.pmod("_hash", F.lit(SPREAD))
    for by in ([*keys, part], keys):
        flat = flat.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_hash"))).filter(F.col("_rank") <= k).drop("_rank")
    found = flat.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    empty = F.array().cast("array<bigint>")
    return rows.select(*keys).distinct().alias("a").join(found.alias("b"), on, "left").select(*[F.col(f"a.{c}") for c in keys], F.coalesce(f"b.{sketch}", empty).alias(sketch))


_KEY = "struct<n: int, id: bigint, h: bigint>"


def _key(doc_id: Column, text: Column) -> Column:
    return F.struct(F.when(doc_id.isNull(), 1).otherwise(0).alias("n"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("h"))


def _bounds(keys: DataFrame, ranges: int) -> list[list[int]]:
    """The least key of each range that a range partition of the keys gives."""
    dealt = keys.repartitionByRange(ranges, "key")
    least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).select("key.*")
    return sorted([r["n"], r["id"], r["h"]] for r in least.collect())


def _placed(rows: DataFrame, bounds: list[list[int]]) -> DataFrame:
    """rows and `range`, the last of the bounds (sorted, the first one least) that is not above the row's key, and `leads`: whether it is that key.

    Two steps of some sqrt(ranges) comparisons each."""
    width = max(1, int(len(bounds) ** 0.5))
    structs = [{"n": n, "id": i, "h": h} for n, i, h in bounds]
    chunks = [structs[a : a + width] for a in range(0, len(structs), width)]
    heads = F.from_json(F.lit(json.dumps([c[0] for c in chunks])), f"array<{_KEY}>")
    inner = F.from_json(F.lit(json.dumps(chunks)), f"array<array<{_KEY}>>")
    columns = [F.col(c) for c in rows.columns]
    coarse = rows.select(*columns, (F.size(F.filter(heads, lambda b: b <= F.col("key"))) - 1).alias("_coarse"))
    fine = coarse.select(*columns, "_coarse", F.size(F.filter(F.get(inner, F.col("_coarse")), lambda b: b <= F.col("key"))).alias("_fine"))
    leads = F.get(F.get(inner, F.col("_coarse")), F.col("_fine") - 1) == F.col("key")
    return fine.select(*columns, (F.col("_coarse") * width + F.col("_fine") - 1).alias("range"), leads.alias("leads"))


def with_next(docs: DataFrame, text: str = "text", k: int = K, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, next_text, sketch and next_sketch of each row of docs; the next one is that of the following doc_id, after the last the first."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), value.alias("text"))
    rows = rows.select("doc_id", "text", _key(F.col("doc_id"), F.col("text")).alias("key"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // (4 * range_bytes)))
    bounds = _bounds(rows.select("key"), 4 * tasks) or [[0, 0, 0]]
    last = len(bounds) - 1
    at = F.col("range")
    before = F.struct(F.when(at == 0, last).otherwise(at - 1).alias("range"), F.when(at == 0, 2).otherwise(1).alias("guest"))
    own = F.struct(at.alias("range"), F.lit(0).alias("guest"))
    dealt = _placed(rows, bounds).select("doc_id", "text", "key", F.explode(F.when(F.col("leads"), F.array(own, before)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "text", "key", "to.range", "to.guest").repartition(tasks, "range")
    over = Window.partitionBy("range").orderBy("guest", "key")
    near = with_sketch(dealt, "text", "sketch", k).withColumns({"next_text": F.lead("text").over(over), "next_sketch": F.lead("sketch").over(over)})
    return near.filter("guest = 0").select("doc_id", "text", "next_text", "sketch", "next_sketch")


def edited(rows: DataFrame) -> DataFrame:
    """rows (of `with_next`), n_chars and edited_text: the last quarter of the code points gives way to as many of the next text's first ones."""
    counted = rows.withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - tail)
    return counted.withColumn("edited_text", F.concat(head, F.substring(F.col("next_text"), F.lit(1), tail)))


def printed(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """The query's columns, and estimates of the numbers of distinct shingles and of how much of the text is in the edited one."""
    rows = with_sketch(edited(with_next(docs, text, k)), "edited_text", "edited_sketch", k)
    own, other = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        printed(own).alias("fingerprint"),
        printed(other).alias("edited_fingerprint"),
        resemblance(own, other, k).alias("near_edited"),
        resemblance(own, F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(own, k).alias("n_shingles"),
        containment(own, other, k).alias("contained_in_edited"),
    )
