"""Line deduplication over a corpus, with DataFrame operations only.

The text is read once for its lines: a 128-bit hash of each key that is long enough, with the row and the position. These
occurrences are range-partitioned by hash, with a secondary sort by document, the largest first, and position. A
window streams that order: the first document of a key is the one that keeps its lines, the number of the last one says
how many have it. A key with over one in HOT of the occurrences (found from a sample, which changes the partitions and never the
result) is dealt over SALTS ranges by its document's hash, and its ranges' counts and first documents, SALTS rows a
key, are merged and broadcast. What comes back for a row is a sparse bitmap of its dropped lines (64 lines a word), never text.

Defined cases: a null or empty text is one empty line. Rows with a null doc_id count for nothing and keep all
lines. Rows of one doc_id are one document that may have several texts: the document counts once for a key, and where it is the
largest, all its rows keep the line. Bitmaps belong to a row's doc_id and text, so texts of one doc_id never share them.
Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT, SPACE, boxed, unboxed, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


#: Ranges that a hot key is dealt over, and occurrences looked at for hot keys.
SALTS, SAMPLE = 64, 2_000_000
KEY = ["h1", "h2"]


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos and a 128-bit hash of each line whose key is long enough."""
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    # Before the exact test a cheap one: the key is no longer than the line.
    rows = rows.where((F.char_length("line") >= min_chars) & (F.char_length(F.btrim("line", F.lit(SPACE))) >= min_chars))
    rows = rows.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return rows.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def hot_keys(seen: DataFrame) -> DataFrame:
    """Keys with over one in HOT of the occurrences in sampled documents: fewer than HOT."""
    part = min(1.0, SAMPLE / max(1, seen.count()))
    some = seen.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 62)) < int(part * (1 << 62)))
    counts, total = some.groupBy(*KEY).agg(F.count("*").alias("n")), some.count()
    return counts.where((F.col("n") * HOT > total) & (F.col("n") > 1)).select(*KEY)


def ranked(seen: DataFrame, hot: DataFrame) -> DataFrame:
    """seen with salt (-1 of keys that aren't hot), and of its key and salt: turn (the document's place, from 1 for the
    largest), n_docs and first (the largest doc_id)."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(-1)
    dealt = seen.join(F.broadcast(hot.withColumn("hot", F.lit(True))), KEY, "left").select(*seen.columns, salt.alias("salt"))
    group = W.partitionBy(*KEY, "salt").orderBy(F.desc("doc_id"))
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = dealt.repartitionByRange(*KEY, "salt").withColumn("turn", F.dense_rank().over(group))
    return found.withColumns({"n_docs": F.max("turn").over(whole), "first": F.max("doc_id").over(whole)})


def lost_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_hash, pos of every line that is dropped."""
    seen = written(occurrences(docs, min_chars), "lines")
    known = ranked(seen, hot_keys(seen))
    # Of the other keys only what is dropped; of hot ones all, until their ranges are merged.
    marked = written(known.where((F.col("salt") >= 0) | ((F.col("n_docs") >= min_docs) & (F.col("turn") > 1))).drop("turn"), "marked-lines")
    hot = marked.where("salt >= 0")
    ranges = hot.groupBy(*KEY, "salt").agg(F.max("n_docs").alias("n"), F.max("first").alias("first"))
    merged = ranges.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("first").alias("keeper")).where(F.col("n") >= min_docs)
    row = ["doc_id", "text_hash", "pos"]
    return marked.where("salt < 0").select(*row).unionByName(hot.join(F.broadcast(merged), KEY).where("doc_id <> keeper").select(*row))


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_hash, bits: map of line number div 64 to the 64 lines' drop bits. Only rows that lose a line."""
    row = ["doc_id", "text_hash"]
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = lost_lines(docs, min_chars, min_docs).groupBy(*row, F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def drop_common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """row (all columns of docs), doc_id, n_lines, n_dropped and kept (the remaining lines' text)."""
    bits = drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    both = boxed(docs, "doc_id").withColumn("text_hash", F.xxhash64("row.text")).join(bits.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")
    lines = lines_of(F.col("row.text"))
    kept = F.expr("filter(split(coalesce(row.text, ''), '\\n', -1), (x, i) -> coalesce(getbit(bits[cast(i div 64 as int)], i % 64), 0) = 0)")
    out = both.select("row", "doc_id", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("bits").isNotNull(), kept).alias("left"))
    dropped = F.when(F.col("left").isNull(), 0).otherwise(F.col("n_lines") - F.size("left")).cast("long")
    return out.select("row", "doc_id", "n_lines", dropped.alias("n_dropped"), F.coalesce(F.array_join("left", "\n"), "row.text", F.lit("")).alias("kept"))


def line_digest(docs: DataFrame) -> DataFrame:
    done = drop_common_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def dedupe_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the remaining lines as text; every document stays, a null text stays null."""
    done = drop_common_lines(docs, min_chars, min_docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    changes = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return unboxed(done, docs.columns, **changes)


#: The same rows in DuckDB.
ORACLE = """
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select r, doc_id, i as pos, ls[i] as line from docs, unnest(range(1, len(ls) + 1)) t(i)),
keyed as (
  select *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 and doc_id is not null
  group by key having count(distinct doc_id) >= 5),
marked as (
  select k.r, k.doc_id, k.pos, k.line, coalesce(k.doc_id <> c.keeper, false) as lost
  from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from marked group by r, doc_id
"""
