"""Document fingerprints by Order MinHash, for likeness under edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgrid.llm.common import documents
from plotgrid.llm.registry import query
from plotgrid.session import cut_lineage

KMER_WORDS = 3
BINS_LOG2 = 6
WHITE = " \t\n\x0b\x0c\r"

PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def _hash_part(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~PLACE))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BINS_LOG2)


def _packed(h: Column, place: Column) -> Column:
    return _hash_part(h).bitwiseOR(_place(place.cast("bigint")))


def _joint(x: Column, y: Column) -> Column:
    """One hash of two k-mers, in text order."""
    a, b = _hash_part(x), _hash_part(y)
    return F.when(_place(x) < _place(y), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))


def _number(b: Column, joint: Column) -> Column:
    return (b * 65536 + joint.bitwiseAND(F.lit(65535))).cast("int")


def with_signature(df: DataFrame, text: str, out: str, k: int = KMER_WORDS, filled: bool = False) -> DataFrame:
    """Adds ``out``, the Order MinHash signature of the column ``text``: an array of (bin, hash) numbers.

    Every k-mer of words is hashed together with its occurrence number, so a repeated k-mer
    counts as often as it stands there. The hash's leading bits choose one of 64 bins, each of
    which takes the place of one random order. A bin's two least k-mers, put back in text
    order, are hashed to its entry: moving passages changes it, unlike plain MinHash. A hash and
    its place share one number (40 and 24 bits), so sorting numbers does the selection. Places of texts beyond
    16,777,216 words start again at 0: all their k-mers still take part and equal texts still get equal signatures,
    but two k-mers on different sides of such a border may be paired in the wrong order.
    Bins without a k-mer have no entry; a blank text is one empty word.

    With ``filled`` every bin has an entry of two k-mers: a bin that holds fewer takes the next ones from
    the other bins, in an order of its own (their hashes seeded with the bin's number). Its own k-mers first and
    then all others by seeded hash are a random order too, so a short text is compared by 64 orders as a long
    one is. Only a text of a single k-mer has entries of one.
    """
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WHITE)), r"[\x20\x09-\x0D]+")
    step = df.withColumn("_words", words)
    last = F.greatest(F.size("_words") - k, F.lit(0))
    kmers = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: _packed(F.xxhash64(*[F.get("_words", i + j) for j in range(k)]), i),
    )
    step = step.withColumn("_kmers", F.sort_array(kmers)).drop("_words")
    step = step.withColumn("_repeats", F.size(F.array_distinct(F.transform("_kmers", _hash_part))) < F.size("_kmers"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_kmers") - 1),
        lambda i: (i == 0) | (_hash_part(F.get("_kmers", i)) != _hash_part(F.get("_kmers", i - 1))),
    )
    step = step.withColumn("_starts", F.when(F.col("_repeats"), starts))

    def numbered(start: Column, end: Column) -> Column:
        def number(i: Column) -> Column:
            x = F.get("_kmers", i)
            return F.when(i == start, x).otherwise(_packed(F.xxhash64(_hash_part(x), i - start), x))

        return F.transform(F.sequence(start, end - 1), number)

    ends = F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size("_kmers")))
    counted = F.sort_array(F.flatten(F.zip_with("_starts", ends, numbered)))
    step = step.withColumn("_kmers", F.when(F.col("_repeats"), counted).otherwise(F.col("_kmers"))).drop("_starts", "_repeats")
    least = F.filter("_kmers", lambda x, i: (i < 2) | (_bin(x) != _bin(F.coalesce(F.get("_kmers", i - 2), x))))
    step = step.withColumn("_least", least)

    def bin_number(x: Column) -> Column:
        return _bin(x).bitwiseAND(F.lit((1 << BINS_LOG2) - 1))

    def entry(x: Column, i: Column) -> Column:
        first = (i == 0) | (_bin(F.get("_least", i - 1)) != _bin(x))
        y = F.get("_least", i + 1)
        alone = y.isNull() | (_bin(y) != _bin(x))
        single = F.lit(None) if filled else F.xxhash64(_hash_part(x))
        return F.when(first, _number(bin_number(x), F.when(alone, single).otherwise(_joint(x, y))))

    entries = F.filter(F.transform("_least", entry), lambda e: e.isNotNull())
    if not filled:
        return step.withColumn(out, entries).drop("_least", "_kmers")
    step = step.withColumn("_entries", entries)
    every = F.sequence(F.lit(0), F.lit((1 << BINS_LOG2) - 1))
    step = step.withColumn("_short", F.array_except(every, F.transform("_entries", lambda e: F.shiftright(e, 16))))

    def first_two(b: Column) -> Column:
        own = F.filter("_least", lambda x: bin_number(x) == b)
        others = F.filter("_kmers", lambda x: bin_number(x) != b)
        seeded = F.transform(others, lambda x: _packed(F.xxhash64(_hash_part(x), b), x))
        return F.slice(F.concat(own, F.sort_array(seeded)), 1, 2)

    def filling(b: Column, pair: Column) -> Column:
        x, y = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        return _number(b, F.when(y.isNull(), F.xxhash64(_hash_part(x))).otherwise(_joint(x, y)))

    step = step.withColumn("_pairs", F.transform("_short", first_two))
    full = F.sort_array(F.concat("_entries", F.zip_with("_short", "_pairs", filling)))
    return step.withColumn(out, full).drop("_least", "_kmers", "_entries", "_short", "_pairs")


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of the bins filled in either signature that hold equal entries: 0 to 1."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    bins = F.array_union(F.transform(a, lambda e: F.shiftright(e, 16)), F.transform(b, lambda e: F.shiftright(e, 16)))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(bins), F.lit(1))


def shown(signature: str) -> Column:
    """The signature as text, six hex digits an entry."""
    return F.array_join(F.transform(signature, lambda e: F.lower(F.lpad(F.hex(e), 6, "0"))), "")


def _key(doc_id: str) -> Column:
    """A doc_id as a join key; a null is a key like any other."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def neighbours(docs: DataFrame) -> DataFrame:
    """(key, chars, next_key, next_hash): every doc_id with the next smaller one, the least with the largest.

    next_hash names the row that stands for the next id where it has several: the one
    with the least text hash. Ids are dealt by range and each range is ordered alone; one row per range then
    joins the ends, so no task sees all ids. A null doc_id comes after all others.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.min(F.xxhash64("text")).alias("hash"))
    dealt = cut_lineage(
        ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "ordered-ids"
    )
    here = F.struct(F.col("doc_id").alias("id"), F.col("hash"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last())
    follows = dealt.withColumn("follower", F.lead(here).over(inside))
    # one row per range
    tops = dealt.groupBy("part").agg(F.max_by(here, F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("top"))
    across = Window.orderBy(F.col("part").desc())
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = tops.select(F.col("part").alias("end_part"), F.coalesce(F.lead("top").over(across), F.first("top").over(everything)).alias("jump"))
    joined = follows.join(ends, F.col("part") == F.col("end_part")).withColumn("after", F.coalesce("follower", "jump"))
    return joined.select(
        _key("doc_id").alias("key"), "chars", _key("after.id").alias("next_key"), F.col("after.hash").alias("next_hash")
    )


def edit_likeness(docs: DataFrame, k: int = KMER_WORDS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, signature, edited_signature, near_edited, near_next).

    The edited text has the second half's code points replaced by the first as many (or all) of
    the next document, descending doc_id, after the last the first. A null text is an empty
    one. Repeated rows give repeated results; of rows with equal doc_id the one with
    the least text hash is what the previous document sees. An empty table gives no rows, one document is its own
    next. Other columns are not read. Texts move once by doc_id and half of each once more.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    links = cut_lineage(neighbours(texts), "neighbours").withColumnRenamed("key", "before")
    doc_type = texts.schema["doc_id"].dataType
    # the same two columns on both ways to a join, so that texts are dealt by key once
    texts = texts.select(_key("doc_id").alias("key"), "text")
    # next_hash is the least hash of its id, so "not larger" holds for that row alone
    heads = (
        texts.join(links.where(F.col("chars") > 1), texts["key"] == F.col("next_key"))
        .where(F.xxhash64("text") <= F.col("next_hash"))
        .select(F.col("before").alias("key"), F.expr("substring(text, 1, cast(chars div 2 as int))").alias("head"))
        .groupBy("key").agg(F.first("head").alias("head"))
    )
    n, half = F.length("text"), F.expr("cast(length(text) div 2 as int)")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half))
    rows = texts.join(heads, "key", "left").select(
        "key", n.cast("bigint").alias("n_chars"), F.xxhash64("text").alias("text_hash"), "text", edited.alias("edited")
    )
    rows = with_signature(rows, "text", "signature", k, filled=True).drop("text")
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    rows = cut_lineage(with_signature(rows, "edited", "edited_signature", k, filled=True).drop("edited"), "signatures")
    others = (
        rows.select(F.col("key").alias("next_key"), "text_hash", F.col("signature").alias("next_signature"))
        .join(links, "next_key").where(F.col("text_hash") <= F.col("next_hash"))
        .groupBy(F.col("before").alias("key")).agg(F.first("next_signature").alias("next_signature"))
    )
    doc_id = F.when(F.col("key") != "", F.col("key")).cast(doc_type).alias("doc_id")
    return rows.join(others, "key", "left").select(
        doc_id, "n_chars", "edited_sha256", "signature", "edited_signature",
        likeness("signature", "edited_signature").alias("near_edited"), likeness("signature", "next_signature").alias("near_next"),
    )


@query("op4_order_minhash")
def op4_order_minhash(spark, sf_dir):
    found = edit_likeness(documents(spark, sf_dir), KMER_WORDS)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", shown("signature").alias("fingerprint"),
        shown("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next",
    )
