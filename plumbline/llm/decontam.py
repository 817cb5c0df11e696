"""Benchmark decontamination by template windows. DataFrame functions only.

A text becomes words; numbers, names (capitalised words that begin no sentence) and units after numbers become typed
placeholders, a run of numbers or of names one of them, other words lower case. Each window of ``WINDOW`` template words of a
benchmark item is hash-joined with the documents' windows and the words themselves are compared. Windows of one document and item
that keep the same distance belong together; there, the same filled slot of the item must have the same filling in the document
wherever it recurs, or the alignment is dropped, except for a run of at least ``ALIGNED`` windows that hold the item's words
unchanged. A document is contaminated by an item if consistent windows hold at least ``SHARE`` of the item's, or if ``ALIGNED`` of them
lie in one alignment, as many as a passage of 13 words has.

Windows with fewer than two plain words prove nothing unless the document has the item's own words there: they count in runs
of unchanged windows, and in place of others where an item has none but such. An item of fewer than ``WINDOW`` words is looked for
as a whole, its words unchanged: of three words or more anywhere, of one or two as a document of just these.

Items of equal words are one class while texts are compared; the result names each item of it. Before the join, a blocked Bloom
filter of the item windows, one value of at most ``FILTER_WORDS`` longs, thins the windows of each document where they stand,
so that only possible hits become rows and take their words along, in one pass over the documents; with more windows than the
filter serves, more false hits reach the join, which removes them. Documents are never shuffled, only the windows found are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, written

WINDOW = 5
SHARE = 0.8
ALIGNED = 9
#: 8 MB, for about four million windows.
FILTER_WORDS = 1 << 20

#: Words that are units where they follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "mi", "miles", "meters", "metres", "g", "mg", "kg", "lb", "lbs", "oz", "ml", "l", "s", "sec",
    "seconds", "min", "minutes", "h", "hr", "hours", "days", "weeks", "months", "years", "kb", "mb", "gb", "tb", "k", "c", "f",
    "dollars", "euros", "pounds", "percent", "usd", "eur", "mph", "kmh", "w", "kw", "v", "hz", "khz", "mhz", "ghz",
)
#: Marks a capital that begins a sentence, and joins the parts of a run.
START, JOIN = "\u0001", "\u0002"


def raw_words(text: Column) -> Column:
    """Runs of letters, marks and digits; one that begins a sentence with a capital has the mark before it. Numbers with nothing but
    separators between them are one word, and so are names with nothing but spaces or hyphens."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(^|[.!?:;|\n][\"')\]]*)(\s*)(?=\p{Lu})", f"$1$2 {START}")
    marked = F.regexp_replace(marked, r"(?<=[0-9])[\s.,:/]+(?=[0-9])", JOIN)
    marked = F.regexp_replace(marked, rf"(?<![\p{{L}}\p{{M}}\p{{N}}{START}])(\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}\p{{N}}]*)[ -]+(?=\p{{Lu}}\p{{Ll}})", f"$1{JOIN}")
    return F.filter(F.split(marked, rf"[^\p{{L}}\p{{M}}\p{{N}}{START}{JOIN}]+"), lambda w: w != "")


def template(raw: Column) -> Column:
    units = F.array(*map(F.lit, UNITS))

    def canonical(w: Column, i: Column) -> Column:
        first = F.substring(w, 1, 1)
        number = first.between("0", "9")
        after = (i > 0) & F.substring(F.get(raw, i - 1), 1, 1).between("0", "9")
        name = (first != START) & (first != F.lower(first)) & (F.substring(w, 2, 1) != F.upper(F.substring(w, 2, 1)))
        return (
            F.when(number, F.lit("<n>"))
            .when(after & F.array_contains(units, F.lower(w)), F.lit("<u>"))
            .when(name, F.lit("<p>"))
            .otherwise(F.ltrim(F.lower(w), F.lit(START)))
        )

    return F.transform(raw, canonical)


def windows(words: Column) -> Column:
    """A hash for each window, in order."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _plain(w: Column) -> Column:
    return ~w.isin("<n>", "<u>", "<p>")


def item_classes(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, raw, words) for each class of items of equal words, named by their least id, and (class_id, member_id)."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", raw_words(F.col("text")).alias("raw")).withColumn("key", F.sha2(F.to_json("raw"), 256))
    classes = written(items.groupBy("key").agg(F.min("item_id").alias("class_id"), F.first("raw").alias("raw")).where(F.size("raw") > 0), "item_classes")
    members = items.select("key", F.col("item_id").alias("member_id")).distinct().join(classes.select("key", "class_id"), "key").drop("key")
    return classes.select("class_id", "raw", template(F.col("raw")).alias("words")), members


def item_windows(classes: DataFrame) -> DataFrame:
    """hash, class_id, item_pos, item_words, item_raw, strong, item_windows: a row for each window; strong ones have two plain words or
    more, or belong to an item without any such."""
    items = classes.select("class_id", "raw", "words", windows(F.col("words")).alias("hashes"))
    # outer, since Spark would else test the arrays for rows in a filter of its own, and compute them for each element again
    rows = items.select("class_id", "raw", "words", F.posexplode_outer("hashes").alias("item_pos", "hash")).where("hash IS NOT NULL")
    rows = rows.select("hash", "class_id", "item_pos", F.slice("words", F.col("item_pos") + 1, WINDOW).alias("item_words"), F.slice("raw", F.col("item_pos") + 1, WINDOW).alias("item_raw"))
    rows = written(rows.withColumn("plain", F.size(F.filter("item_words", _plain)) >= 2), "item_windows")
    sizes = rows.groupBy("class_id").agg(F.count_if("plain").alias("n_plain"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "class_id").withColumn("strong", F.col("plain") | (F.col("n_plain") == 0))
    return written(rows.select("hash", "class_id", "item_pos", "item_words", "item_raw", "strong", "plain", F.when(F.col("n_plain") > 0, F.col("n_plain")).otherwise(F.col("n")).alias("item_windows")), "listed")


def bloom(hashes: DataFrame) -> tuple[Column, int]:
    """The filter of a column hash as one value, an array of longs, and its length: about four hashes a word of 63 bits, two bits each."""
    n = hashes.count()
    words = min(FILTER_WORDS, 1 << max(0, (n // 4).bit_length()))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned("hash", s), F.lit(63)).cast("int")) for s in (20, 40)]
    filled = hashes.select(F.pmod("hash", F.lit(words)).alias("id"), bits[0].bitwiseOR(bits[1]).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    every = hashes.sparkSession.range(words).join(filled, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    # one row of at most FILTER_WORDS longs
    one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("filter"))
    return written(one, "filter").scalar(), words


def possible(filled: Column, words: int, h: Column) -> Column:
    word = F.get(filled, F.pmod(h, F.lit(words)).cast("int"))
    return (F.getbit(word, F.pmod(F.shiftrightunsigned(h, 20), F.lit(63)).cast("int")) + F.getbit(word, F.pmod(F.shiftrightunsigned(h, 40), F.lit(63)).cast("int"))) == 2


def _equal(a: Column, b: Column) -> Column:
    """Word by word: an equality of arrays would become a join key of its own."""
    return F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x)


def _aligned(parts: DataFrame, classes: DataFrame) -> DataFrame:
    listed = item_windows(classes)
    filled, words = bloom(listed.select("hash"))
    parts = parts.withColumn("hashes", windows(F.col("words"))).withColumn("filter", filled)
    at = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: possible(F.col("filter"), words, F.get("hashes", i)))
    at = F.when(F.size("hashes") > 0, at)
    hit = F.transform(at, lambda i: F.struct(i.alias("pos"), F.get("hashes", i).alias("hash"), F.slice("words", i + 1, WINDOW).alias("words"), F.slice("raw", i + 1, WINDOW).alias("raw")))
    hits = parts.select("doc_id", "text_hash", F.explode_outer(hit).alias("hit")).where("hit IS NOT NULL").select("doc_id", "text_hash", "hit.*")
    hits = hits.join(listed, "hash").where(_equal(F.col("words"), F.col("item_words")))
    slots = F.filter(
        F.zip_with(F.arrays_zip(F.col("item_words").alias("w"), F.col("item_raw").alias("r")), "raw", lambda i, d: F.struct(i["w"].alias("w"), F.lower(i["r"]).alias("i"), F.lower(d).alias("d"))),
        lambda s: ~_plain(s["w"]),
    )
    hits = hits.select("doc_id", "text_hash", "class_id", "item_windows", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", F.forall(slots, lambda s: s["i"] == s["d"]).alias("verbatim"), "strong", "plain", slots.alias("slots"))
    hits = hits.where("plain OR verbatim")
    lines = hits.groupBy("doc_id", "text_hash", "class_id", "item_windows", "shift").agg(
        F.collect_set(F.when(F.col("strong"), F.col("item_pos"))).alias("at"), F.sort_array(F.collect_set(F.when(F.col("verbatim"), F.col("item_pos")))).alias("verbatim"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("strong"), F.col("slots"))))).alias("slots"),
    )
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["w"], s["i"]))))
    starts = F.when(F.size("verbatim") >= ALIGNED, F.sequence(F.lit(0), F.size("verbatim") - ALIGNED))
    run = F.coalesce(F.exists(starts, lambda i: F.get("verbatim", i + (ALIGNED - 1)) - F.get("verbatim", i) == ALIGNED - 1), F.lit(False))
    held = F.when(consistent & run, F.array_union("at", "verbatim")).when(consistent, F.col("at")).when(run, F.col("verbatim"))
    lines = lines.select("doc_id", "text_hash", "class_id", "item_windows", held.alias("at"))
    out = lines.where("size(at) > 0").groupBy("doc_id", "text_hash", "class_id", "item_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("windows"), F.max(F.size("at")).alias("aligned")
    )
    out = out.select("doc_id", "text_hash", "class_id", "windows", "aligned", "item_windows", F.least(F.lit(1.0), F.col("windows") / F.col("item_windows")).alias("share"))
    return out.where((F.col("share") >= SHARE) | (F.col("aligned") >= ALIGNED))


def _whole(parts: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Matches of the items of fewer than ``WINDOW`` words."""
    key = lambda words: F.xxhash64(F.array_join(F.transform(words, F.lower), " "))
    short = written(classes.where(F.size("raw") < WINDOW).select("class_id", F.size("raw").alias("n"), F.transform("raw", lambda w: F.ltrim(F.lower(w), F.lit(START))).alias("item_raw")), "short_items")
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # at most WINDOW - 1
    if not lengths:
        return None
    raw = F.transform("raw", lambda w: F.ltrim(F.lower(w), F.lit(START)))
    filled, words = bloom(short.select(key(F.col("item_raw")).alias("hash")))
    parts = parts.select("doc_id", "text_hash", raw.alias("raw")).withColumn("filter", filled)

    def grams(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size("raw") - (n - 1)), lambda i: F.slice("raw", i, n))
        return F.when((F.size("raw") >= n) if n > 2 else (F.size("raw") == n), all_).otherwise(F.array().cast("array<array<string>>"))

    found = F.array_distinct(F.filter(F.concat(*map(grams, lengths)), lambda g: possible(F.col("filter"), words, key(g))))
    hits = parts.select("doc_id", "text_hash", F.explode_outer(found).alias("gram")).where("gram IS NOT NULL").withColumn("hash", key(F.col("gram")))
    hits = hits.join(short.withColumn("hash", key(F.col("item_raw"))), "hash").where((F.size("gram") == F.col("n")) & _equal(F.col("gram"), F.col("item_raw")))
    return hits.select("doc_id", "text_hash", "class_id", *[F.lit(1).alias(c) for c in ("windows", "aligned", "item_windows")], F.lit(1.0).alias("share")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, class_id, windows, aligned, item_windows, share), a row for each contaminated document and item class, and the
    classes' members (class_id, member_id).

    Null texts have no words; null item ids name nothing and are left out; repeated documents give repeated matches but once
    for each (doc_id, text). Empty tables give no rows. Other columns are not read.
    """
    classes, members = item_classes(benchmark)
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), raw_words(F.col("text")).alias("raw"))
    found = _aligned(parts.withColumn("words", template(F.col("raw"))), classes)
    short = _whole(parts, classes)
    return found if short is None else found.unionByName(short), members


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows, item_windows, share, aligned, class_id: a row for each item, of equal ones too."""
    found, members = matches(docs, benchmark)
    out = found.join(members, "class_id")
    return out.select("doc_id", F.col("member_id").alias("item_id"), F.col("windows").cast("long"), F.col("item_windows").cast("long"), "share", F.col("aligned").cast("long"), "class_id")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    id_, hash_ = free("__id", docs), free("__hash", docs)
    bad = written(matches(docs, benchmark)[0].select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left_anti")
