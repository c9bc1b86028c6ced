"""Line dedup by distributed prefix doubling over line-id sequences.

Every line is an id (its hash); a document is a sequence of ids. Prefix doubling
names blocks of 1, 2, 4, ... lines: the name of a block is that of its two halves, so
equal names of level k are suffixes whose longest common prefix is at least 2^k lines.
Only names that occur more than once go on, which leaves the repeated part of the
suffix array; the groups of a level are its longest-common-prefix intervals, counted
by partial aggregation, so a line on every page is no hot key.

A run of whole lines with at least ``min_chars`` characters (each line counting one
more for its end) that also occurs at an earlier place - by document id, then line - is
a later copy, and its lines are deleted. Every such run is covered by runs that are
just long enough, counted from their first line or from their last: single lines,
blocks of 2^k lines, or two overlapping blocks of 2^k lines, whose pair of names names
the run between two levels. A run just long enough has at most ``min_chars`` lines, so
doubling ends after log2(min_chars) levels whatever the length of the copies.

Line ids and names are 96 bits of two independent hashes. DataFrame functions only.

Defined results: null and empty texts stay as they are; documents with a null id keep
all lines; rows that repeat an id and text are one place, do not delete each other and get the
same result; rows of one id with other texts are ordered by line alone, so of the same line
at the same number in them all copies stay; of lines in several documents the one of the
smallest id stays; a document whose lines all go keeps its row, with an empty text; very
long texts are cut into lines whole; extra columns of any name stay as they are, but those
that begin with two underscores are reserved; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

MIN_CHARS = 50


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, row, line, weight, h1, h2): every line as an id."""
    text = F.col("text")
    rows = docs.where(text.isNotNull() & (text != "") & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    return rows.select("id", "row", "line", (F.length("t") + 1).alias("weight"), F.xxhash64("t").alias("h1"), F.hash("t").alias("h2"))


def place() -> Column:
    """Document id and line as one ordered number."""
    return F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")


def repeated(blocks: DataFrame) -> DataFrame:
    """Blocks whose name occurs more than once, and whether an earlier one does.

    The names are a table of their own, so that the join back reads two shuffles and
    adaptive execution can split a name that many blocks have.
    """
    groups = blocks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place()).alias("first")).where("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    groups = materialize(groups, "line-names")
    met = blocks.join(groups, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    return met.withColumn("later", place() > F.col("first")).drop("g1", "g2", "first")


def doubled(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks of ``2 * size`` lines from repeated blocks of ``size``."""
    after = Window.partitionBy("id", "row").orderBy("line").rangeBetween(size, size)
    pairs = blocks.select("id", "row", "line", "weight", "h1", "h2", "before", F.first(F.struct("h1", "h2", "weight")).over(after).alias("b")).where(F.col("b").isNotNull())
    return pairs.select("id", "row", "line", "before", (F.col("weight") + F.col("b.weight")).alias("weight"), F.xxhash64("h1", "b.h1").alias("h1"), F.hash("h2", "b.h2").alias("h2"), F.least("weight", "b.weight").alias("lighter"))


def spans_between(blocks: DataFrame, size: int, min_chars: int) -> DataFrame:
    """Runs of ``size + 1`` to ``2 * size - 1`` lines that are just long enough, as pairs of blocks of ``size``.

    Forward runs start at a block that is too short alone and end as soon as they are
    long enough; backward runs end at such a block and start as late as they can.
    """
    doc = Window.partitionBy("id", "row").orderBy("line")
    block = F.struct("line", "before", "weight", "h1", "h2")
    near = blocks.select("id", "row", "line", "before", "weight", "h1", "h2", F.collect_list(block).over(doc.rangeBetween(1, size - 1)).alias("next"), F.collect_list(block).over(doc.rangeBetween(1 - size, -1)).alias("last")).where(F.col("weight") < min_chars)
    end = F.col("before") + F.col("weight")
    ahead = F.filter("next", lambda x: x["before"] + x["weight"] - F.col("before") >= min_chars)
    behind = F.filter("last", lambda x: end - x["before"] >= min_chars)
    forward = near.select("id", "row", F.col("line").alias("from"), block.alias("a"), F.array_min(F.transform(ahead, lambda x: F.struct(x["line"].alias("line"), x["h1"].alias("h1"), x["h2"].alias("h2")))).alias("b")).where("b is not null")
    backward = near.select("id", "row", F.array_max(F.transform(behind, lambda x: F.struct(x["line"].alias("line"), x["h1"].alias("h1"), x["h2"].alias("h2")))).alias("a"), block.alias("b")).where("a is not null")
    runs = forward.select("id", "row", F.col("from").alias("line"), "a.h1", "a.h2", F.col("b.h1").alias("g1"), F.col("b.h2").alias("g2"), (F.col("b.line") - F.col("from") + size).alias("size"))
    runs = runs.union(backward.select("id", "row", "a.line", "a.h1", "a.h2", F.col("b.h1").alias("g1"), F.col("b.h2").alias("g2"), (F.col("b.line") - F.col("a.line") + size).alias("size")))
    return runs.select("id", "row", "line", "size", F.xxhash64("h1", "g1", "size").alias("h1"), F.hash("h2", "g2", "size").alias("h2"))


def later_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, row, gone): the sorted line numbers of each document that are later copies."""
    size, marks, spans = 1, [], []
    found = materialize(repeated(lines_of(docs)).dropDuplicates(["id", "row", "line"]), "line-blocks-1")
    before = Window.partitionBy("id", "row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0))).withColumn("lighter", F.lit(0))
    while True:
        copies = blocks.where(F.col("later") & (F.col("weight") >= min_chars) & (F.col("lighter") < min_chars))
        marks.append(copies.select("id", "row", "line", F.lit(size).alias("size")))
        if size > 1:
            spans.append(spans_between(blocks, size, min_chars))
        if 2 * size > min_chars or blocks.where(F.col("weight") < min_chars).isEmpty():
            break
        blocks = materialize(repeated(doubled(blocks, size)), f"line-blocks-{2 * size}")
        size *= 2
    if spans:
        between = spans[0]
        for more in spans[1:]:
            between = between.union(more)
        marks.append(repeated(materialize(between.distinct(), "line-spans")).where("later").select("id", "row", "line", "size"))
    gone = marks[0]
    for more in marks[1:]:
        gone = gone.union(more)
    lines = gone.select("id", "row", F.explode(F.sequence("line", F.col("line") + F.col("size") - 1)).alias("line"))
    return lines.groupBy("id", "row").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without later copies of lines, and ``__n_removed``; n_chars follows the text."""
    gone = later_lines(docs, min_chars).select(F.col("id").alias("__gone_id"), F.col("row").alias("__gone_row"), F.col("gone").alias("__gone"))
    text = docs["text"]
    joined = docs.join(gone, (docs["doc_id"] == F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_row")), "left")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    left = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(left.alias("text"))
        elif name == "n_chars":
            out.append(F.when(F.col("__gone").isNull(), docs[name]).otherwise(F.length(left)).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(docs[name])
    return joined.select(*out, F.coalesce(F.size("__gone"), F.lit(0)).alias("__n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("__n_removed").alias("n_removed"))


#: All runs of 1 to MIN_CHARS lines, compared as lists: longer ones hold shorter ones that are long enough.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')),
""" + "".join(f"""
b{k} AS (
  SELECT doc_id, line, min(doc_id * 1000000 + line) OVER (PARTITION BY b) AS first
  FROM (SELECT doc_id, line, list(t) OVER w AS b, sum(length(t) + 1) OVER w AS weight FROM lines
        WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING))
  WHERE len(b) = {k} AND weight >= {MIN_CHARS}),""" for k in range(1, MIN_CHARS + 1)) + """
gone AS (""" + " UNION ".join(f"""
  SELECT doc_id, unnest(range(line, line + {k})) AS line FROM b{k} WHERE doc_id * 1000000 + line > first""" for k in range(1, MIN_CHARS + 1)) + """)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN d.text ELSE coalesce(k.text, '') END AS text,
       coalesce(g.n, 0)::int AS n_removed
FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text FROM lines ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id) k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""  # fmt: skip
