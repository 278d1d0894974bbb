"""Line dedup by range-partitioned hashes and keep bitmaps, in built-in functions only.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least `least_chars` code points that
stand in at least `least_docs` documents are frequent: they lose all their lines but those of the largest doc_id that holds
them. Each long line becomes a 128-bit hash with its document and position; these rows are dealt by ranges of hash and salt
(a document has one salt), sorted by document, largest first, and position, and streamed: a row whose document is not the
one before it is a first occurrence. First occurrences of all salts are counted, the first one of all is the document that
keeps its lines. No text is shuffled to find that out: what comes back is a bitmap for each text, cut into words of 64 lines,
of which those that keep all their lines are left out.

A line that stands in a third of all documents is dealt over SALTS groups; what goes on from each is one row.

Edge cases: a null text is one empty line; empty texts and lines are kept (they are shorter than any key); a line repeated in one document
counts once, and all its lines go or stay together; rows of one doc_id are one document in the counts and each loses its own lines; a
row without doc_id is no document of the counts and loses nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST_CHARS, LEAST_DOCS = 40, 5
SALTS = 64
WORD = 64  # lines in a word of a bitmap
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain lower() where the text has only ASCII characters, as it is many times faster."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def whole_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, form, position) of every line whose key has least_chars code points; form is a hash of the whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where(F.col("doc_id").isNotNull() & (F.char_length("text") >= least_chars))
    whole = texts.select("doc_id", F.xxhash64("text").alias("form"), lines_of(F.col("text")).alias("lines"))  # before the lines part: else the text is hashed again for each
    each = whole.select("doc_id", "form", F.posexplode("lines").alias("position", "line"))
    long = each.withColumn("line", F.trim("line", F.lit(SPACE))).where(F.char_length("line") >= least_chars).withColumn("key", lower_ascii(F.col("line")))
    return long.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "form", "position")


def frequent_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, n_docs, last) of hashes that stand in least_docs documents; last is the largest of them."""
    keys = ["h1", "h2", "salt"]
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).repartitionByRange(*keys).sortWithinPartitions(*keys, F.desc("doc_id"), "position")
    in_order = Window.partitionBy(*keys).orderBy(F.desc("doc_id"), "position")
    first = dealt.withColumn("first", ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(in_order)))
    salted = first.where("first").groupBy(*keys).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    return salted.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("last").alias("last")).where(F.col("n_docs") >= least_docs)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, form, n_dropped, kept) of the texts that lose lines; kept is an array of (word, bits) in order of word, bit i of a word standing
    for line 64 * word + i, set if it stays. Words that are not listed keep all."""
    lines = stored(long_lines(docs, least_chars), "lines")
    frequent = stored(frequent_lines(lines, least_docs), "frequent")
    dropped = lines.join(frequent, ["h1", "h2"]).where(F.col("doc_id") < F.col("last"))
    bit = F.expr(f"shiftleft(1L, position % {WORD})")
    words = dropped.groupBy("doc_id", "form", F.expr(f"int(position div {WORD})").alias("word")).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy("doc_id", "form").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("kept"))


def dense(kept: str) -> Column:
    """A bitmap of a stored table as an array of words without gaps, up to the last that is listed."""
    before = lambda i: F.when(i == 0, -1).otherwise(F.col(kept)[F.greatest(i - 1, F.lit(0))]["word"])
    return F.flatten(F.transform(kept, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - before(i) - 1), F.array(x["bits"]))))


def remove_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of docs; kept is the lines that stay, joined by a line feed."""
    bitmaps = stored(keep_bitmaps(docs, least_chars, least_docs), "bitmaps").select("doc_id", "form", "n_dropped", dense("kept").alias("words"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("form", F.xxhash64("text"))
    joined = texts.join(bitmaps.hint("merge"), ["doc_id", "form"], "left")  # one way at every size: bitmaps grow with the table, and a hot text is split
    left = F.expr(f"array_join(filter(split(text, '\\n', -1), (x, i) -> shiftright(coalesce(get(words, int(i div {WORD})), -1L), i % {WORD}) % 2 <> 0), '\\n')")
    return joined.select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("words").isNull(), F.col("text")).otherwise(left).alias("kept"))


def line_report(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """As remove_lines, with the digest of the text that is left in its place."""
    return remove_lines(docs, least_chars, least_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
