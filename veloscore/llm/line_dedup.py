"""Line dedup: repeated windows of three lines, found globally, in DataFrame functions only.

A text is split at line feeds, and every three consecutive lines are a window, known by a 128-bit
hash of its lines. Of the places where a window starts, the one with the smallest (doc_id, hash of
the text, line number) is the first, null ids before others; the window's lines go at all other
places. Very long texts are taken whole. The line ranges of a document's later windows are merged, and what lies between them stays.

Windows are counted with a partial aggregate and joined back by hash, a join whose skewed keys
Spark splits; no list of a window's places is ever built. A document's own ranges, at most one a
line, are the only collected arrays.

Rows equal in doc_id and text are one document: each gets the same result, and they do not remove
each other's lines. Null texts stay null, with 0 lines; texts of fewer than three lines stay as
they are. Extra columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _own(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, key, at, k1, k2: each window's document, first line and hash."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("key"), _lines(F.col("text")).alias("lines")).where(F.size("lines") >= SPAN)

    def window(i: Column) -> Column:
        three = [F.element_at("lines", i + k) for k in range(1, SPAN + 1)]
        return F.struct(i.alias("at"), F.xxhash64(*three).alias("k1"), F.xxhash64(F.lit("second"), *three).alias("k2"))

    each = F.transform(F.sequence(F.lit(0), F.size("lines") - SPAN), window)
    return lines.select("doc_id", "key", F.inline(each))


def _later(docs: DataFrame) -> DataFrame:
    """doc_id, key, starts: the sorted starts of the windows that a document has to give up."""
    windows = _windows(docs)
    here = F.struct("doc_id", "key", "at")
    first = windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1")
    later = windows.join(first, ["k1", "k2"]).where(~here.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def remove_repeated_lines(docs: DataFrame, text: str, n_lines: str, n_removed: str) -> DataFrame:
    """docs with three more columns: the text left, the number of lines and of those removed."""
    later = _later(docs)
    key, doc, starts, begins, ends, lines = _own(docs, "key", "doc", "starts", "begins", "ends", "lines")
    later = later.select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("starts").alias(starts))
    joined = docs.join(later, docs.doc_id.eqNullSafe(later[doc]) & (F.xxhash64(docs.text) == later[key]), "left").drop(doc, key)
    s = F.col(starts)
    # runs of windows that touch: a run begins after a gap and ends before one
    begin = F.filter(s, lambda x, i: (i == 0) | (x > F.get(s, i - 1) + SPAN))
    end = F.transform(F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) > x + SPAN)), lambda x: x + SPAN)
    out = joined.withColumn(begins, begin).withColumn(ends, end).withColumn(lines, _lines(F.col("text")))
    b, e, every = F.col(begins), F.col(ends), F.col(lines)

    def between(i: Column) -> Column:
        """The lines between run i - 1 and run i."""
        since = F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1))
        until = F.when(i == F.size(b), F.size(every)).otherwise(F.get(b, i))
        return F.slice(every, since + 1, until - since)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(b)), between)), "\n")
    gone = F.aggregate(F.zip_with(b, e, lambda x, y: y - x), F.lit(0), lambda acc, x: acc + x)
    out = out.withColumn(text, F.when(s.isNull(), F.col("text")).otherwise(left))
    out = out.withColumn(n_lines, F.coalesce(F.size(every), F.lit(0)).cast("bigint"))
    out = out.withColumn(n_lines, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col(n_lines)).cast("bigint"))
    out = out.withColumn(n_removed, F.when(s.isNull(), F.lit(0)).otherwise(gone).cast("bigint"))
    return out.drop(starts, begins, ends, lines)


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, text (what is left)."""
    done = remove_repeated_lines(docs.select("doc_id", "text"), "left_text", "n_lines", "n_removed")
    return done.select("doc_id", "n_lines", "n_removed", F.col("left_text").alias("text"))


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines removed, and without those that have lost every line."""
    text, n, gone = _own(docs, "left_text", "n_lines", "n_removed")
    done = remove_repeated_lines(docs, text, n, gone).where((F.col(gone) == 0) | (F.col(gone) < F.col(n)))
    fields = [F.col(text).alias(c) if c == "text" else F.when(F.col(gone) > 0, F.length(text)).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return done.select(*fields)


#: The same in DuckDB SQL, rows equal in doc_id and text being one document. (Of different texts under one
#: id it takes the first by code point, not by hash.)
ORACLE = """
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, text, pos, list_slice(lines, pos + 1, pos + 3) AS win
      FROM (SELECT doc_id, text, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3)),
r AS (SELECT doc_id, text, pos, count(*) OVER (PARTITION BY win) AS n,
             row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, text, pos) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS line FROM r WHERE n > 1 AND k > 1),
l AS (SELECT doc_id, text, unnest(lines) AS line_text, unnest(range(0, len(lines))) AS line FROM d),
k AS (SELECT l.doc_id, l.text AS whole, count(*) AS n_lines, count(g.line) AS n_removed,
             coalesce(string_agg(line_text, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS text
      FROM l LEFT JOIN gone g ON g.doc_id IS NOT DISTINCT FROM l.doc_id AND g.text = l.text AND g.line = l.line GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, k.text
FROM documents d LEFT JOIN k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.whole = d.text
"""
