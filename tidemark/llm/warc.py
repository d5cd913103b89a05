"""WARC archives and their fixity audit by Merkle trees.

Pages become WARC records in archives of ``PER_ARCHIVE`` consecutive ids.  Each
record is hashed with its offset and length; ordered ranges of 16 places are
hashed into nodes, 16 nodes into the next level, up to one for each archive, and
archives likewise up to one root (two, where records without an id stand in
archives below zero).  A node's digest covers its children's places, offsets,
numbers of records and digests.  Two replicas
are compared from the root down: a level is joined only below nodes that differ,
so intact ranges are never looked at again, and what is left at the leaves are
the damaged, lost, moved or foreign records.  A record's place goes by its id and
its number among equal ids, so a loss leaves the places behind it alone; records
that have only moved are told from damaged ones by content (``unlike``).  What a
broken archive still yields is compared like any other; the break itself is one
more record at its end.

Defined results: null url is an empty URI, null html an empty body; line breaks
in a URL are written %0D and %0A, so that none ends a header; rows
without an id are spread over archives -1 to -65536 by their content; repeated rows are separate records in a stable order;
other columns are ignored; empty tables have no records, no root and no
differences.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, stored, table

#: Consecutive ids whose records share an archive, and bits of a place in the order of an archive's records.
PER_ARCHIVE, PLACE_BITS = 256, 20
#: Places for the ids of an archive and those without one; then come those of their second rows, and so on. Beyond ``REPEATS`` rows share places.
SLOTS = 2 * PER_ARCHIVE
REPEATS = (1 << PLACE_BITS) // SLOTS
#: Archive of files that lie in no archive's folder.
ASTRAY = -65537
#: Children of a tree node, as a number of bits.
FAN_BITS = 4
END = "\r\n\r\n"
START = "WARC/1.0\r\n"


def one_line(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame) -> DataFrame:
    """archive, page_id and the record as a string, without its end mark."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), one_line(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", name, ">\r\nWARC-Target-URI: ", F.col("url"), "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length("html").cast("string"), END, F.col("html")]
    lost = -1 - F.conv(F.substring(F.md5(F.concat("url", "html").cast("binary")), 1, 4), 16, 10).cast("long")
    archive = F.coalesce(F.shiftright("page_id", PER_ARCHIVE.bit_length() - 1), lost)
    return page.select(archive.alias("archive"), "page_id", F.concat(*(F.lit(h) if isinstance(h, str) else h for h in head)).alias("record"))


def catalogued(found: DataFrame) -> DataFrame:
    """archive, page_id, offset and length in the archive, sha256, and the record's place in its archive's order."""
    each = found.select("archive", "page_id", (F.octet_length("record") + len(END)).cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha256"))
    order = Window.partitionBy("archive").orderBy(F.asc_nulls_first("page_id"), "sha256")
    upto = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.partitionBy("archive", "page_id").orderBy("sha256")) - 1
    slot = F.coalesce(F.pmod("page_id", F.lit(PER_ARCHIVE)), F.lit(PER_ARCHIVE))
    return each.select("archive", "page_id", (upto - F.col("length")).alias("offset"), "length", "sha256", (nth % REPEATS * SLOTS + slot).cast("long").alias("place"))


def write_archives(found: DataFrame, path: str) -> None:
    """One gzip file of WARC records per archive, in the order of ``catalogued``."""
    ordered = found.withColumn("_key", F.sha2(F.col("record").cast("binary"), 256)).repartition("archive").sortWithinPartitions("archive", F.asc_nulls_first("page_id"), "_key")
    ordered.select("archive", F.col("record").alias("value")).write.partitionBy("archive").option("lineSep", END).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple[int | None, int, int, str]]:
    """(page id, offset, length, sha256) of each record; goes by the declared lengths.

    Bytes that are no record with its end mark are one odd record up to the next start mark.
    """
    at = 0
    while at < len(data):
        body = data.find(END.encode(), at)
        head = dict(line.split(": ", 1) for line in data[at : max(at, body)].decode("utf-8", "replace").split("\r\n") if ": " in line)
        size = head.get("Content-Length", "")
        stop = body + 4 + int(size) if body >= 0 and re.fullmatch("[0-9]{1,18}", size) else len(data)
        if not data.startswith(START.encode(), at) or data[stop : stop + 4] != END.encode():
            mark = data.find((END + START).encode(), at)
            if data.startswith(START.encode(), stop + 4) and data.startswith(START.encode(), at):
                mark = stop  # only the end mark is odd
            stop = mark + 4 if mark >= 0 else len(data)
            yield None, at, stop - at, hashlib.sha256(data[at:stop]).hexdigest()
            at = stop
            continue
        name = head.get("WARC-Record-ID", "").removeprefix("<urn:page:").removesuffix(">")
        page = int(name) if re.fullmatch("-?[0-9]{1,19}", name) else None
        yield page if page is not None and -(1 << 63) <= page < 1 << 63 else None, at, stop + 4 - at, hashlib.sha256(data[at:stop]).hexdigest()
        at = stop + 4


def unpacked(content: bytes) -> tuple[bytes, bool]:
    """What can be unpacked of gzip members, and whether that is all of them."""
    try:
        member = zlib.decompressobj(31)
        data = member.decompress(content)
        if member.eof and not member.unused_data:
            return data, True
    except zlib.error:
        pass
    out, at, step, member = [], 0, 4096, zlib.decompressobj(31)
    while at < len(content):
        part, before = content[at : at + step], member.copy()
        try:
            out.append(member.decompress(part))
        except zlib.error:
            if step == 1:
                return b"".join(out), False
            member, step = before, 1  # up to the very byte that breaks it
            continue
        at += len(part) - len(member.unused_data)
        if member.eof and at < len(content):
            member = zlib.decompressobj(31)
    return b"".join(out), member.eof


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of the archives as their bytes are now; a task holds one archive at a time beside its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                archive, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                data, whole = unpacked(content)
                rows = list(parsed(data))
                if not whole:
                    rows.append((None, len(data), 0, hashlib.sha256(content).hexdigest()))
                if rows:
                    seen, places = Counter(), []
                    for page, *_ in rows:
                        places.append(seen[page] % REPEATS * SLOTS + (PER_ARCHIVE if page is None else page % PER_ARCHIVE))
                        seen[page] += 1
                    cols = [[archive] * len(rows), *zip(*rows, strict=True), places]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["archive", "page_id", "offset", "length", "sha256", "place"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    archive = F.regexp_extract("path", "/archive=(-?[0-9]{1,17})/[^/]*$", 1)
    files = files.select(F.coalesce(archive.try_cast("long"), F.lit(ASTRAY)).cast("long").alias("archive"), "content")
    return files.mapInArrow(run, "archive long, page_id long, offset long, length long, sha256 string, place long")


NODE = ["archive", "node"]


def above(level: int) -> list[Column]:
    """The parent of a node of this level: within an archive by its place, beyond by the archive's number."""
    if level * FAN_BITS < PLACE_BITS:
        return [F.col("archive"), F.shiftright("node", FAN_BITS).alias("node")]
    return [F.shiftright("archive", FAN_BITS).alias("archive"), F.lit(0).cast("long").alias("node")]


def tree(catalogue: DataFrame) -> list[DataFrame]:
    """Levels (archive, node, digest, first_offset, n_records), leaves first; a node's digest covers its children in order.

    A node gathers at most 16 children, so no group grows with the data.
    """
    own = F.array_sort(F.collect_list(F.concat_ws(":", "offset", "length", "sha256")))  # one record but beyond REPEATS or among foreign ones
    leaves = catalogue.groupBy("archive", F.col("place").alias("node")).agg(F.sha2(F.array_join(own, ";").cast("binary"), 256).alias("digest"), F.min("offset").alias("first_offset"), F.count("*").alias("n_records"))
    levels = [stored(leaves)]
    ends = levels[0].agg(F.min("archive").alias("low"), F.max("archive").alias("high")).first()
    low, high = ends["low"], ends["high"]
    # archives below zero have a top node of their own
    while low is not None and (len(levels) * FAN_BITS <= PLACE_BITS or low != high and (low, high) != (-1, 0)):
        if len(levels) * FAN_BITS > PLACE_BITS:
            low, high = low >> FAN_BITS, high >> FAN_BITS
        up = above(len(levels) - 1)
        child = F.struct("archive", "node", "first_offset", "n_records", "digest").alias("_child")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("_child")), lambda c: F.concat_ws("=", *(c[x].cast("string") for x in ("archive", "node", "first_offset", "n_records", "digest")))), ";")
        first = F.min_by("_child.first_offset", F.struct("_child.archive", "_child.node"))
        levels.append(stored(levels[-1].select(*up, child).groupBy(*NODE).agg(F.sha2(joined.cast("binary"), 256).alias("digest"), first.alias("first_offset"), F.sum("_child.n_records").alias("n_records"))))
    return levels


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Nodes whose digests differ or that one side lacks."""
    a, b = one.select(*NODE, F.col("digest").alias("a")), other.select(*NODE, F.col("digest").alias("b"))
    return a.join(b, NODE, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*NODE)


def audit(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """Archive and place (``node``) of the records in which two trees differ, found by descending only below differing nodes.

    A tree that is lower than the other has no root to compare; the descent
    then starts at the lower one's top level.
    """
    top = min(len(one), len(other)) - 1
    bad = stored(differing(one[top], other[top]))
    for level in range(top - 1, -1, -1):
        parent = bad.select(F.col("archive").alias("_archive"), F.col("node").alias("_node"))
        up = above(level)
        below = lambda t: t.join(parent, (up[0] == F.col("_archive")) & (up[1] == F.col("_node")), "left_semi")  # noqa: B023, E731
        bad = stored(differing(below(one[level]), below(other[level])))
    return bad


def unlike(catalogue: DataFrame, replica: DataFrame, bad: DataFrame) -> DataFrame:
    """archive and offset of the catalogue's records, among those at the places ``bad``, whose bytes the replica lacks.

    Equal leaves hold equal records, so what has moved is found among the other differing leaves.
    """
    key = ["archive", "page_id", "length", "sha256"]
    places, at = bad.select("archive", F.col("node").alias("place")), ["archive", "place"]
    there = replica.join(places, at, "left_semi").groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.count("*").alias("_n"))
    here = catalogue.join(places, at, "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("offset")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return here.join(there, [*same, F.col("_nth") <= F.col("_n")], "left_anti").select("archive", "offset")


def damage(found: DataFrame, hit: Column) -> DataFrame:
    """A drill: the records for which ``hit`` holds get their last character replaced."""
    broken = F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit("\x7f"))
    return found.withColumn("record", F.when(hit, broken).otherwise(F.col("record")))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archives of ``pages`` against a replica in which every 32nd record or so, by md5(page_id), is damaged."""
    found = records(table(spark, sf_dir, "pages"))
    catalogue = stored(catalogued(found))
    path = scratch(spark)
    hit = (F.substring(F.md5(F.col("page_id").cast("string")), 1, 1) == "0") & (F.substring(F.md5(F.col("page_id").cast("string")), 2, 1) < "8")
    write_archives(damage(found, hit), path)
    replica = stored(read_archives(spark, path))
    lost = unlike(catalogue, replica, audit(tree(catalogue), tree(replica)))
    rows = catalogue.join(lost.withColumn("_intact", F.lit(False)), ["archive", "offset"], "left")
    return rows.select("page_id", "archive", "offset", "length", "sha256", F.coalesce("_intact", F.lit(True)).alias("intact"))


OP7_SQL = r"""
WITH page AS (
  SELECT page_id, CASE WHEN page_id IS NULL THEN -1 - ('0x' || substr(md5(url || coalesce(html, '')), 1, 4))::BIGINT ELSE (page_id - (page_id % 256 + 256) % 256) // 256 END AS archive,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS record
  FROM (SELECT page_id, html, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url FROM pages)),
leaf AS (SELECT page_id, archive, CAST(strlen(record) + 4 AS BIGINT) AS length, sha256(record) AS sha256 FROM page)
SELECT page_id, archive, CAST(sum(length) OVER w - length AS BIGINT) AS "offset", length, sha256,
       coalesce(NOT (substr(md5(CAST(page_id AS VARCHAR)), 1, 1) = '0' AND substr(md5(CAST(page_id AS VARCHAR)), 2, 1) < '8'), true) AS intact
FROM leaf
WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
