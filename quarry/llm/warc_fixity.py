"""WARC fixity audit over Merkle trees (operator 9).

An archive is a file of records one after another; a replica is a second copy of it. Every
record is hashed; a leaf hashes the record's offset range and digest, and each inner node
hashes the ranges and hashes of up to ``FANOUT`` children in order. An audit compares the
replicas' roots, archive by archive, and descends only into children of nodes that differ,
so the work below the roots follows the damage, not the collection.

Archives are bounded (``ARCHIVE_BYTES`` on average): records are dealt to them by a digest of
their id (of their size, if they have none), so no source or host can make one large, and one shuffle of narrow rows (never of
contents) by archive serves offsets and every level of the tree. What differs at one level is
written before the next one is compared, so the plan does not grow with the depth.

A record whose leaf differs is ``damaged`` if the replica holds its id with other contents,
``moved`` if it holds the same contents elsewhere (all records after one that grew or went), else ``missing``;
one that only the replica holds is ``extra``.

Defined results: a null payload is an empty one; null ids and repeated rows are records like
others, ordered by digest among themselves; a very long record is hashed whole by the engine; an archive or record that only one replica has is
reported; empty tables give an empty result; input columns beyond those named are not
carried, so none can clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, column, forget

FANOUT = 16
ARCHIVE_BYTES = 64 << 20
CRLF = "\r\n"


def warc_record(uri: Column, payload: Column, date: str = "2026-01-01T00:00:00Z") -> Column:
    """A response record as text: header lines, an empty line, the payload and two line ends."""
    body = F.coalesce(payload, F.lit(""))
    digest = F.sha2(F.concat(F.coalesce(uri, F.lit("")), F.lit("\n"), body), 256)
    uuid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF),
        body,
        F.lit(CRLF + CRLF),
    )


def archive_count(records: DataFrame, record: str = "record", archive_bytes: int = ARCHIVE_BYTES) -> int:
    total = records.agg(F.sum(F.octet_length(column(records, record)))).first()[0] or 0
    return max(1, math.ceil(total / archive_bytes))


def archive_of(key: Column, size: Column, archives: int) -> Column:
    """The archive of an id: the first 32 bits of its text's MD5, modulo the number of archives. Without an id, the record's bytes count."""
    digest = F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("size "), size.cast("string"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % archives


def leaves(records: DataFrame, archives: int, key: str = "id", record: str = "record") -> DataFrame:
    """archive, ordinal, id, first and last (offsets), digest (SHA-256 of the record) and hash of each record."""
    body = F.coalesce(column(records, record), F.lit(""))
    rows = records.select(
        archive_of(column(records, key), F.octet_length(body), archives).alias("archive"),
        column(records, key).alias("id"),
        F.octet_length(body).cast("long").alias("size"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
    )
    order = Window.partitionBy("archive").orderBy("id", "digest")
    last = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.select("archive", "id", "digest", "size", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), last.alias("last"))
    placed = placed.withColumn("first", F.col("last") - F.col("size"))
    return placed.select("archive", "ordinal", "id", "first", "last", "digest", F.sha2(F.concat_ws(":", "first", "last", "digest"), 256).alias("hash"))


def tree_depth(own: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the leaves, so that the largest archive has one root."""
    most = own.agg(F.max("ordinal")).first()[0] or 0
    depth = 0
    while most:
        most //= fanout
        depth += 1
    return depth


def nodes(own: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """archive, level (0: leaves), place, first, last and hash of all nodes of the archives' trees."""
    level = own.select("archive", F.col("ordinal").alias("place"), "first", "last", "hash")
    every = [level.withColumn("level", F.lit(0))]
    for i in range(1, depth + 1):
        child = F.struct("place", F.concat_ws(":", "first", "last", "hash").alias("line"))
        parts = F.transform(F.sort_array(F.collect_list(child)), lambda x: x["line"])
        level = level.groupBy("archive", F.expr(f"place div {fanout}").alias("place")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(F.array_join(parts, "\n"), 256).alias("hash")
        )
        level = checkpoint(level)  # else each level's plan would hold those below it
        every.append(level.withColumn("level", F.lit(i)))
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out


def mismatches(mine: DataFrame, theirs: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """archive and ordinal of the leaves that differ: from the roots down, only below nodes that differ."""

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.select("archive", "place", F.col("hash").alias("a")), b.select("archive", "place", F.col("hash").alias("b"))
        return a.join(b, ["archive", "place"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "place")

    found = checkpoint(differing(mine.where(F.col("level") == depth), theirs.where(F.col("level") == depth)))
    for i in range(depth - 1, -1, -1):
        above = found.select("archive", F.col("place").alias("parent"))

        def below(x: DataFrame, i: int = i, above: DataFrame = above) -> DataFrame:
            return x.where(F.col("level") == i).withColumn("parent", F.expr(f"place div {fanout}")).join(above, ["archive", "parent"], "left_semi")

        last, found = found, checkpoint(differing(below(mine), below(theirs)))
        forget(last)
    return found.select("archive", F.col("place").alias("ordinal"))


def audit(records: DataFrame, replica: DataFrame, key: str = "id", record: str = "record", archive_bytes: int = ARCHIVE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Every record of the first replica, and those only the second has, with where it stands, intact and status.

    ``records`` and ``replica`` have the id and the record (text). Columns: archive, ordinal, id,
    first, last, digest, replica_digest (of what the replica holds at that place), intact, status.
    """
    archives = archive_count(records, record, archive_bytes)
    mine, theirs = checkpoint(leaves(records, archives, key, record)), checkpoint(leaves(replica, archives, key, record))
    depth = max(tree_depth(mine, fanout), tree_depth(theirs, fanout))
    bad = mismatches(nodes(mine, depth, fanout), nodes(theirs, depth, fanout), depth, fanout)
    place = ["archive", "ordinal"]
    lost, other = mine.join(bad, place, "left_semi"), theirs.join(bad, place, "left_semi")

    def known(rows: DataFrame, among: DataFrame, name: str, by: list[str]) -> DataFrame:
        """``rows`` with a mark where ``among`` has a row of the same values, null ids included."""
        a, b = rows.alias("a"), among.select(*by).distinct().withColumn(name, F.lit(True)).alias("b")
        same = F.lit(True)
        for c in by:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return a.join(b, same, "left").select("a.*", F.col(f"b.{name}").isNotNull().alias(name))

    judged = known(known(lost, other, "held", ["archive", "id", "digest"]), other, "named", ["archive", "id"])
    status = F.when(F.col("held"), "moved").when(F.col("named"), "damaged").otherwise("missing")
    there = other.select(*place, F.col("digest").alias("replica_digest"))
    judged = judged.select(*place, status.alias("status")).join(there, place, "left")
    intact = F.col("status").isNull()
    out = mine.join(judged, place, "left").select(
        *place, "id", "first", "last", "digest", F.when(intact, F.col("digest")).otherwise(F.col("replica_digest")).alias("replica_digest"), intact.alias("intact"), F.coalesce("status", F.lit("intact")).alias("status")
    )
    extra = known(other, lost, "named", ["archive", "id"]).where("not named")
    nothing = F.lit(None).cast("string").alias("digest")
    return out.unionByName(extra.select(*place, "id", "first", "last", nothing, F.col("digest").alias("replica_digest"), F.lit(False).alias("intact"), F.lit("extra").alias("status")))


def write_archives(records: DataFrame, path: str, archives: int, key: str = "id", record: str = "record") -> None:
    """One folder an archive, with one file: the records' bytes one after another, in the order of ``leaves``."""
    body = column(records, record)
    rows = records.select(archive_of(column(records, key), F.octet_length(F.coalesce(body, F.lit(""))), archives).alias("archive"), column(records, key).alias("id"), F.sha2(body.cast("binary"), 256).alias("digest"), body.alias("value"))
    # The writer ends each row with a line feed; a record ends with one.
    rows = rows.repartition("archive").sortWithinPartitions("archive", "id", "digest").select("archive", F.expr("substring(value, 1, char_length(value) - 1)").alias("value"))
    rows.write.mode("overwrite").partitionBy("archive").text(path)


def read_archives(files: DataFrame) -> DataFrame:
    """path, ordinal, first, last, uri, payload and record (bytes) of each record of WARC files.

    ``files``: path and content, as Spark's ``binaryFile`` source gives them. Records are found
    by their declared lengths; a record whose header is unreadable ends its file's list with a
    null payload up to the file's end.
    """
    header = re.compile(rb"WARC/\d\.\d\r\n(.*?)\r\n\r\n", re.S)
    size, uri = re.compile(rb"^Content-Length:\s*(\d+)\s*$", re.I | re.M), re.compile(rb"^WARC-Target-URI:\s*(\S*)\s*$", re.I | re.M)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, rows = 0, []
                while at < len(content):
                    m = header.match(content, at)
                    n = m and size.search(m[1].replace(b"\r", b""))
                    if not n:
                        rows.append((path, len(rows), at, len(content), None, None, content[at:]))
                        break
                    end = m.end() + int(n[1])
                    stop = min(len(content), end + 4)
                    u = uri.search(m[1].replace(b"\r", b""))
                    rows.append((path, len(rows), at, stop, u[1].decode("utf-8", "replace") if u else None, content[m.end() : end], content[at:stop]))
                    at = stop
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "ordinal", "first", "last", "uri", "payload", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, ordinal long, first long, last long, uri string, payload binary, record binary")
