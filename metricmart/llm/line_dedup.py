"""Line dedup by content-defined chunks of lines, in DataFrame functions alone.

A text is its \\n-separated lines, each with a 31-bit hash. The least hash rolls
over the lines after a line; a chunk runs from a line to each later one, within
``MAX_LINES``, where both ends' hashes are below those of all lines between them.
So a chunk's bounds depend on its own lines alone and stay put whatever stands
around it, chunks overlap, there are fewer than two a line, and a repeated passage
holds the same chunks at every place: from its neighbouring lines (always a chunk)
to spans that join short lines. A chunk of ``MIN_CHARS`` characters or more that
occurs again anywhere (same document included) is removed everywhere but at its
first place, by document id, text hash and line number; overlapping chunks that go
make up the whole passage (very short lines at its ends may stay). Each line's
text stays at its first place.

Chunks are found again by 128-bit hashes chained over line hashes, without their
texts; only those found twice or more are cut out and compared byte by byte, and a
hash that different texts share removes nothing.

Defined results: NULL texts have no lines and stay NULL; an empty text is one
empty line; rows equal in id and text are one document listed twice and get the
same result; lines of equal hash bound no chunk with a line between them that
isn't above it, so equal lines in a row make chunks of two; rows with a NULL id
come before others; a text whose chunks all go becomes ""; very long texts are
cut like others, at any number of lines; an empty table gives an empty result;
other columns pass through, whatever their names.

``dedup_passages`` keys every two consecutive lines instead, of any length, so
that blank or very short lines go too where a pair of them repeats. Its pairs are
verified by their bytes like the chunks, and the same results are defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmart.llm.common import discard, fresh_name, materialise, materialise_at, scratch_path, table

#: Prime below 2**31: line hashes that bound chunks are taken modulo it.
MODULUS = 2_147_483_629
#: Lines of the longest chunk.
MAX_LINES = 8
#: Chunks of fewer characters (line ends not counted) stay: blank lines, closing brackets, numbers.
MIN_CHARS = 16


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("bigint") % MODULUS


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though ``use`` names it in lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def chunk_spans(text: Column) -> Column:
    """(first, last, h1, h2) of each chunk of a text: line numbers, from 0, and a 128-bit hash of its lines."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(
        _line_hash(x).alias("bound"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2"), F.char_length(x).alias("chars")))

    def from_each(lines: Column) -> Column:
        return F.flatten(F.transform(lines, lambda own, i: chunks_from(own, i, F.array(*[F.get(lines, i + k) for k in range(1, MAX_LINES)]))))

    def chunks_from(own: Column, i: Column, later: Column) -> Column:
        start = F.struct(
            F.lit(MODULUS).cast("bigint").alias("least"), i.alias("last"), own["h1"].alias("h1"), own["h2"].alias("h2"), own["chars"].alias("chars"),
            F.array().cast("array<struct<first:int,last:int,h1:bigint,h2:bigint>>").alias("found"))

        def with_line(state: Column, line: Column) -> Column:
            last, chars = state["last"] + 1, state["chars"] + line["chars"]
            h1, h2 = F.xxhash64(state["h1"], line["h1"]), F.xxhash64(state["h2"], line["h2"])
            chunk = F.struct(i.alias("first"), last.alias("last"), h1.alias("h1"), h2.alias("h2"))
            counts = (line["bound"] < state["least"]) & (chars >= MIN_CHARS)
            longer = F.struct(
                F.least(state["least"], line["bound"]).alias("least"), last.alias("last"), h1.alias("h1"), h2.alias("h2"), chars.alias("chars"),
                F.when(counts, F.concat(state["found"], F.array(chunk))).otherwise(state["found"]).alias("found"))
            # beyond a line that isn't above the first one, no chunk begins with it; NULL: beyond the text
            return F.when(line.isNotNull() & (state["least"] > own["bound"]), longer).otherwise(state)

        return F.aggregate(later, start, with_line, lambda state: state["found"])

    return _bind(lines, from_each)


def multi_line_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, last, h1, h2 of each chunk."""
    return _each(docs.filter("text IS NOT NULL"), chunk_spans(F.col("text")))


def _each(docs: DataFrame, chunks: Column) -> DataFrame:
    """doc_id, text_hash and the fields of each element of ``chunks``; hash and array are computed once a row."""
    # an outer explode, as Spark would compute the array a second time to filter on its size
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), chunks.alias("chunks"))
    return rows.select("doc_id", "text_hash", F.explode_outer("chunks").alias("chunk")).filter("chunk IS NOT NULL").select("doc_id", "text_hash", "chunk.*")


def line_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, last, chunk (its text) of every two consecutive lines of each text."""
    def joined(lines: Column) -> Column:
        return F.zip_with(F.slice(lines, 1, F.size(lines) - 1), F.slice(lines, 2, F.size(lines) - 1), lambda a, b: F.concat(a, F.lit("\n"), b))

    split = F.split("text", "\n", -1)
    pairs = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_bind(split, joined)).alias("first", "chunk"))
    return pairs.select("doc_id", "text_hash", "first", (F.col("first") + 1).alias("last"), "chunk")


def _chunk_key() -> list[Column]:
    """A 128-bit key of a chunk's text."""
    return [F.xxhash64("chunk").alias("h1"), F.xxhash64(F.lit("second"), "chunk").alias("h2")]


def _surplus(chunks: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, last of each chunk that has an earlier place."""
    places = materialise(chunks.select("doc_id", "text_hash", "first", "last", *_chunk_key()), "line-places")
    # grouping by the text itself compares bytes; copies are counted before the shuffle
    texts = chunks.select(*_chunk_key(), "chunk").groupBy("h1", "h2", "chunk").agg(F.count("*").alias("n"))
    same = texts.groupBy("h1", "h2").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    place = F.struct("doc_id", "text_hash", "first")
    first = places.groupBy("h1", "h2").agg(F.min(place).alias("keeper"))
    # written, so that the join below reads plain scans, whose skewed keys AQE can split
    repeated = materialise(same.filter("texts = 1 AND n > 1").join(first, ["h1", "h2"]).select("h1", "h2", "keeper"), "line-repeats")
    return places.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("keeper")))


def with_repeats(docs: DataFrame, column: str) -> DataFrame:
    """``docs``, written, with an array ``column`` of (first, last, h1, h2, again) of the chunks that occur twice or more.

    ``again`` is true where a chunk has an earlier place; the column is NULL without such chunks."""
    spark, place = docs.sparkSession, F.struct("doc_id", "text_hash", "first")
    scratch = [scratch_path(spark, what) for what in ("line-places", "line-repeats", "line-found")]
    places = materialise_at(multi_line_chunks(docs), scratch[0])
    keepers = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("keeper")).filter("n > 1").drop("n")
    # written, so that the join below reads plain scans, whose skewed keys AQE can split
    found = places.join(materialise_at(keepers, scratch[1]), ["h1", "h2"]).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "last", "h1", "h2", (~place.eqNullSafe(F.col("keeper"))).alias("again"))).alias("chunks"))
    # written, and the files before it gone, before the texts are shuffled
    found = materialise_at(found, scratch[2])
    discard(spark, *scratch[:2])
    box = fresh_name(docs, "found")
    joined = docs.join(found.select(F.struct("*").alias(box)), _same_document(docs, box), "left")
    held = materialise(joined.select(*[docs[c] for c in docs.columns], F.col(box)["chunks"].alias(column)), "line-chunks")
    discard(spark, scratch[2])
    return held


def shared_hashes(held: DataFrame, column: str) -> DataFrame:
    """h1, h2 of the chunks in ``column`` that have other bytes at another place."""
    lines = F.split("text", "\n", -1)
    cut = _bind(lines, lambda all_lines: F.transform(F.col(column), lambda c: F.struct(
        c["h1"].alias("h1"), c["h2"].alias("h2"),
        F.array_join(F.transform(F.sequence(c["first"], c["last"]), lambda i: F.get(all_lines, i)), "\n").alias("chunk"))))
    chunks = _each(held.filter(F.col(column).isNotNull()), cut).select("h1", "h2", "chunk")
    # grouping by the text itself compares bytes; copies are merged before the shuffle
    return chunks.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")


def _same_document(docs: DataFrame, box: str) -> Column:
    return docs["doc_id"].eqNullSafe(F.col(box)["doc_id"]) & (F.xxhash64(docs["text"]) == F.col(box)["text_hash"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Like ``repeated_lines`` for passages: maximal runs of lines that are in a pair with an earlier place."""
    def passages(starts: Column) -> Column:
        # pairs that overlap or touch, and are in order, are one run
        first = F.filter(starts, lambda x, i: (i == 0) | (F.get(starts, i - 1) < x - 2))
        last = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > x + 2))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("last")))

    found = _surplus(line_pairs(docs)).groupBy("doc_id", "text_hash").agg(F.collect_set("first").alias("starts"))
    return found.select("doc_id", "text_hash", _bind(F.array_sort("starts"), passages).alias("removed"))


def _without(text: Column, removed: Column) -> Column:
    """A text without the lines of the given (first, last) ranges."""
    gone = F.flatten(F.transform(removed, lambda r: F.sequence(r["first"], r["last"])))

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return _bind(F.split(text, "\n", -1), rest)


def dedup_lines(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text`` (and ``n_chars``, if there, counted anew).

    ``removed`` names a further column for the (first, last) lines of the removed chunks, which may overlap."""
    column = fresh_name(docs, "chunks")
    held = with_repeats(docs, column)
    shared = materialise(shared_hashes(held, column), "line-shared")  # as a rule without a row
    wrong = _each(held, F.col(column)).join(shared, ["h1", "h2"], "left_semi")
    # (first, last) as one number: Spark compares arrays of numbers by hash, of structs pair by pair
    code = lambda first, last: first.cast("bigint") * MAX_LINES + (last - first)
    kept = materialise(wrong.groupBy("doc_id", "text_hash").agg(F.collect_set(code(F.col("first"), F.col("last"))).alias("kept")), "line-kept")
    box = fresh_name(held, "gone")
    joined = held.join(kept.select(F.struct("*").alias(box)), _same_document(held, box), "left")
    again = F.transform(F.filter(held[column], lambda c: c["again"]), lambda c: code(c["first"], c["last"]))
    codes = F.array_except(again, F.coalesce(F.col(box)["kept"], F.array().cast("array<bigint>")))
    first, extra = (lambda c: F.floor(c / MAX_LINES).cast("int")), (lambda c: (c % MAX_LINES).cast("int"))
    ranges = F.transform(codes, lambda c: F.struct(first(c).alias("first"), (first(c) + extra(c)).alias("last")))
    return _cut(joined, held, docs.columns, F.when(F.size(ranges) > 0, ranges), removed)


def dedup_passages(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """Like ``dedup_lines``, with every repeated passage of two lines or more taken out."""
    return _take_out(docs, repeated_passages(docs), removed)


def _take_out(docs: DataFrame, ranges_of: DataFrame, removed: str | None) -> DataFrame:
    """``docs`` without the lines of the (doc_id, text_hash, removed) rows."""
    box = fresh_name(docs, "gone")
    joined = docs.join(ranges_of.select(F.struct("*").alias(box)), _same_document(docs, box), "left")
    return _cut(joined, docs, docs.columns, F.col(box)["removed"], removed)


def _cut(joined: DataFrame, docs: DataFrame, columns: list[str], ranges: Column, removed: str | None) -> DataFrame:
    """``columns`` of ``docs``, as joined, without the lines of ``ranges`` (NULL: all stay)."""
    text = F.when(ranges.isNull(), docs["text"]).otherwise(_without(docs["text"], ranges))
    changed = {"text": text}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(ranges.isNull(), docs["n_chars"]).otherwise(F.char_length(text).cast(kind))
    out = [changed.get(c, docs[c]).alias(c) for c in columns]
    return joined.select(*out, *([ranges.alias(removed)] if removed else []))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed chunks and lines, and a digest of what is left of every document."""
    return _counted(spark, sf_dir, dedup_lines, "n_removed_chunks")


def op10_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every repeated passage of two lines or more removed."""
    return _counted(spark, sf_dir, dedup_passages, "n_removed_passages")


def _counted(spark: SparkSession, sf_dir: str, dedup, ranges: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint")
    before = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(lines).cast("bigint").alias("n_lines"))
    out = dedup(before, "removed")
    n_removed = F.size(F.array_distinct(F.flatten(F.transform("removed", lambda r: F.sequence(r["first"], r["last"])))))
    return out.select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias(ranges),
        F.when(F.col("removed").isNull(), 0).otherwise(n_removed).cast("bigint").alias("n_removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _sql_chunks() -> str:
    """SELECTs of the chunks of 2 to MAX_LINES lines, from each line's followers."""
    def of(n: int) -> str:
        inside = " AND ".join(f"greatest(h, h{n - 1}) < h{k}" for k in range(1, n - 1)) or "true"
        return (f"SELECT doc_id, i, {n} AS n, concat_ws(chr(10), line, {', '.join(f'line{k}' for k in range(1, n))}) AS chunk "
                f"FROM followed WHERE h{n - 1} IS NOT NULL AND {inside}")

    return "\n  UNION ALL ".join(map(of, range(2, MAX_LINES + 1)))


#: DuckDB: the chunks from window functions over lines; chunks compared as texts.
OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) % {MODULUS} AS h FROM lines
), followed AS (
  SELECT *, {", ".join(f"lead(h, {k}) OVER w AS h{k}, lead(line, {k}) OVER w AS line{k}" for k in range(1, MAX_LINES))}
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), chunks AS (
  {_sql_chunks()}
), again AS (
  SELECT doc_id, i, n FROM chunks WHERE length(chunk) - (n - 1) >= {MIN_CHARS}
  QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM again
), per_doc AS (
  SELECT doc_id, count(*) AS n FROM again GROUP BY doc_id
)
SELECT lines.doc_id, count(*) AS n_lines, coalesce(any_value(per_doc.n), 0) AS n_removed_chunks, count(gone.i) AS n_removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.i = lines.i LEFT JOIN per_doc ON per_doc.doc_id = lines.doc_id
GROUP BY lines.doc_id
"""

#: DuckDB: pairs of lines by a window function; a pair's place is numbered among equal texts.
OP10_PASSAGES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), pairs AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next_line FROM lines
), judged AS (
  SELECT *, next_line IS NOT NULL AND row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, i) > 1 AS again FROM pairs
), marked AS (
  SELECT *, again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM judged
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM marked
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (starts) AS n_removed_passages, count(*) FILTER (gone) AS n_removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM edges GROUP BY doc_id
"""
