"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of ASCII letters, digits and everything beyond ASCII, A-Z in lower case. Of every run of
``window - GRAM + 1`` hashed word k-grams the smallest is kept as a fingerprint, the last one if it occurs twice. Two equal
spans of ``window`` words keep the same fingerprint at the same place, so no shared span of that length is missed.

A document's fingerprints pass a bit map of fixed size of the benchmark's fingerprints within the row, so that only those
that may match are put into rows of their own, each with the few words around it. They are joined with the benchmark's
and extended to both sides word by word; only windows whose words are equal count, hence no hash decides a result.
Items shorter than a window are one window of their own length, looked up by the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubmetrics.storage import materialize

#: Words of a hashed k-gram within windows of ten words; shorter windows are hashed whole.
GRAM = 5
#: Bits of the map that sorts out fingerprints the benchmark lacks. A full map lets more through and changes no result.
MAP_BITS = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def alnum_words(text: Column) -> Column:
    """The words of a text; none for NULL. Blanks at both ends leave empty strings, which are cut off."""
    text = F.coalesce(text, F.lit(""))
    # lower() may change letters beyond ASCII; it is safe, and faster, where every character is one byte.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def _gram_hashes(words: Column, size: int) -> Column:
    """A hash for each run of ``size`` words, at the 0-based place where it starts."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _winnowed(hashes: Column, span: int) -> Column:
    """Places of the smallest hash of every ``span`` neighbours, the last one of equals, each place once."""
    starts = F.when(F.size(hashes) >= span, F.sequence(F.lit(0), F.size(hashes) - span)).otherwise(
        F.array().cast("array<int>")
    )

    def place(i: Column) -> Column:
        least = F.least(*[F.get(hashes, i + k) for k in range(span)])
        found = F.lit(None).cast("int")
        for k in range(span):  # the last condition that holds decides, so later places come first
            found = F.when(F.get(hashes, i + k) == least, i + k).otherwise(found)
        return found

    return F.array_distinct(F.transform(starts, place))


def _fingerprints(df: DataFrame, keys: list[str], size: int, gram: int, allowed: Column | None) -> DataFrame:
    """``keys, fp, place, around``: fingerprints of windows of ``size`` words and the words a window there can hold.

    ``around`` starts ``reach`` words before the fingerprint and has ``reach + size`` words; NULL stands beyond the ends.
    """
    reach = size - gram
    hashed = df.withColumn("_h", _gram_hashes(F.col("_words"), gram))
    places = _winnowed(F.col("_h"), reach + 1) if reach else F.sequence(F.lit(0), F.size("_h") - 1)
    if not reach:
        places = F.when(F.size("_h") > 0, places).otherwise(F.array().cast("array<int>"))
    picked = F.transform(places, lambda p: F.struct(F.get("_h", p).alias("fp"), p.alias("place")))
    if allowed is not None:
        picked = F.filter(picked, lambda x: _in_map(allowed, x["fp"]))
    wide = F.transform(picked, lambda x: F.struct(
        x["fp"].alias("fp"), x["place"].alias("place"),
        F.transform(
            F.sequence(x["place"] - reach, x["place"] + (size - 1)),
            lambda j: F.when(j >= 0, F.get("_words", F.greatest(j, F.lit(0)))),
        ).alias("around"),
    ))
    # The outer form keeps a row for documents without any fingerprint.
    rows = hashed.select(*keys, F.explode_outer(wide).alias("_x"))
    return rows.select(*keys, "_x.fp", "_x.place", "_x.around")


def _in_map(bits: Column, fp: Column) -> Column:
    slot = F.pmod(fp, F.lit(MAP_BITS))
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _bit_map(fingerprints: DataFrame) -> Column:
    """The map as a literal of fixed size; at most ``MAP_BITS / 64`` rows reach the driver."""
    slot = F.pmod("fp", F.lit(MAP_BITS))
    rows = (
        fingerprints.where(F.col("fp").isNotNull())
        .groupBy(F.shiftright(slot, 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(fp, {MAP_BITS}) & 63 AS int))")).alias("b"))
        .collect()
    )
    values = [0] * (MAP_BITS // 64)
    for r in rows:
        values[r["w"]] = r["b"]
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def contamination_hits(docs: DataFrame, benchmark: DataFrame, key: str, words: str, item_id: str = "item_id",
                       item_text: str = "text", window: int = 10) -> DataFrame:
    """``key, text_class, start, length``: every window of a benchmark text that occurs in a row's words.

    ``text_class`` stands for all items with the same words; see ``item_classes``. A row without any hit keeps one row
    of NULLs. ``key`` must tell rows apart.
    """
    classes = item_classes(benchmark, item_id, item_text).select(
        "text_class", F.col("text_class").alias("_words")
    ).distinct()
    sized = classes.withColumn("_size", F.least(F.size("_words"), F.lit(window))).where("_size > 0")
    lengths = sorted(r[0] for r in sized.select("_size").distinct().collect())  # at most ``window`` numbers
    source = docs.select(key, F.col(words).alias("_words"))
    found = []
    for size in lengths:
        gram = min(GRAM, size) if size == window else size
        items = _fingerprints(sized.where(F.col("_size") == size), ["text_class"], size, gram, None)
        rows = _fingerprints(source, [key], size, gram, _bit_map(items))
        theirs = items.where("fp IS NOT NULL").select(
            "fp", "text_class", F.col("around").alias("_theirs")
        )
        joined = rows.join(theirs, "fp", "left")
        equal = F.zip_with("around", "_theirs", lambda a, b: F.coalesce(a == b, F.lit(False)))
        offsets = F.filter(
            F.sequence(F.lit(0), F.lit(size - gram)),
            lambda s: F.forall(F.slice(equal, s + 1, F.lit(size)), lambda e: e),
        )
        found.append(joined.select(
            key, "text_class", F.lit(size).alias("length"),
            F.transform(F.when(F.col("text_class").isNotNull(), offsets),
                        lambda s: s + F.col("place") - (size - gram)).alias("starts"),
        ).withColumn("text_class", F.when(F.size("starts") > 0, F.col("text_class"))))
    if not found:
        nothing = F.lit(None)
        return source.select(key, nothing.cast("array<string>").alias("text_class"), nothing.cast("int").alias("length"),
                             nothing.cast("array<int>").alias("starts"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def item_classes(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, text_class``: the class of an item is the array of its words."""
    return benchmark.select(F.col(item_id).alias("item_id"), alnum_words(F.col(item_text)).alias("text_class"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated, _row`` of each row of ``docs``.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or of a whole shorter item.
    NULL and empty texts have no words; items without words hit nothing. Repeated rows and NULL ids are rows of their
    own. Items with equal words all count; items without an id are left out of ``n_items`` and the digest but do hit.
    An empty benchmark contaminates nothing. Other columns do not matter. Only narrow rows are shuffled: one for each
    document and each fingerprint the benchmark may have.
    """
    base = docs.select(
        F.col(id_column).alias("_id"), F.monotonically_increasing_id().alias("_row"),
        alnum_words(F.col(text_column)).alias("_w"),
    )
    keyed = base.select(F.struct("_row", "_id", F.size("_w").cast("bigint").alias("n")).alias("_key"), "_w")
    hits = contamination_hits(keyed, benchmark, "_key", "_w", item_id, item_text, window)
    covered = F.flatten(F.transform(
        F.collect_set(F.when(F.size("starts") > 0, F.struct("starts", "length"))),
        lambda x: F.flatten(F.transform(x["starts"], lambda s: F.sequence(s, s + x["length"] - 1))),
    ))
    # Pieces of one document only: bounded by its length and by the benchmark.
    grouped = materialize(hits.groupBy("_key").agg(
        F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
        F.collect_set("text_class").alias("_classes"),
    ), "hits")
    # Equal sets of classes are looked up once: copies of a popular passage share them.
    names = item_classes(benchmark, item_id, item_text).where("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("_item"), "text_class").distinct()
    sets = grouped.where(F.size("_classes") > 0).select(F.array_sort("_classes").alias("_set")).distinct()
    lists = (
        sets.select("_set", F.explode("_set").alias("text_class"))
        .join(names, "text_class").groupBy("_set")
        .agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    )
    # Rows without any item get a key of their own, so that they do not all meet in one partition.
    placed = grouped.withColumns({
        "_set": F.when(F.size("_classes") > 0, F.to_json(F.array_sort("_classes")))
        .otherwise(F.concat(F.lit("row "), F.col("_key._row").cast("string"))),
    }).join(lists.select(F.to_json("_set").alias("_set"), "_items"), "_set", "left")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return placed.select(
        F.col("_key._id").alias(id_column), F.col("_key.n").alias("n_words"), "n_hit",
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.col("_key._row").alias("_row"),
    )
