"""Merkle fixity audit of WARC replicas.

Records are hashed, ranges of 16 records in their order are leaves, and 16 nodes make a node of the next
level, up to one root. A node hashes its children in order, each with its offset from the start of the
node's range, its length and its digest. Two replicas' roots are compared, and only the children of nodes
that differ are looked at on the next level down, so that records are compared in damaged ranges only. A
record's place in the tree follows its number, and offsets start anew in each range, so that a lost record
changes the nodes above it and no others. Groups are of 16 rows; records that share a number are
pre-aggregated into one entry. Offsets in a file are summed for files with damage only.

Defined results: null urls and html are written as empty; rows with a null page_id share the number null,
which has a file, ranges and a root of its own; of records that share a number the sum of their keys is
compared, so that their order doesn't matter, and their lengths count together; an empty replica lacks all
records of the other; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.session import cut, table

FANOUT_BITS = 4
#: Records of one WARC file; a power of the fan-out.
FILE_RECORDS = 4096


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Records as files that `read_warc` reads, one per partition. UTF-8 payloads."""
    record = F.decode(warc_record(F.col("page_id"), F.col("url"), F.col("html")), "UTF-8")
    pages.select(F.left(record, F.length(record) - 2)).write.option("lineSep", "\r\n").text(path)  # it ends each row itself


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html, and whether the stated length fits, of each record; files are splittable.

    The version line separates records; a payload that holds that line itself shows up as a wrong length.
    """
    rows = spark.read.option("lineSep", "WARC/1.1\r\n").text(path).where("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name}: ?([^\r\n]*)", 1)
    rest = F.substr("value", F.length(head) + 5)
    html = F.when(rest.endswith("\r\n\r\n"), F.left(rest, F.length(rest) - 4)).otherwise(rest)
    return rows.select(
        F.nullif(F.regexp_extract(field("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        html.alias("html"),
        (field("Content-Length") == F.octet_length(html).cast("string")).alias("whole"),
    )


def record_digests(pages: DataFrame) -> DataFrame:
    """number, digest (hex SHA-256 of the record) and n_bytes; one row per record number."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select(F.col("page_id").cast("long").alias("number"), record.alias("r")).select("number", F.sha2("r", 256).alias("digest"), F.octet_length("r").cast("long").alias("n_bytes"))
    once = hashed.groupBy("number").agg(F.count("*").alias("n"), F.min("digest").alias("digest"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("keys"))
    return once.select("number", F.when(F.col("n") == 1, F.col("digest")).otherwise(F.sha2(F.concat_ws(" ", "n", "digest", "keys"), 256)).alias("digest"), "n_bytes")


def _level_up(nodes: DataFrame) -> DataFrame:
    """Nodes (number, digest, n_bytes) of 16 neighbours each; at most 16 rows a group."""
    groups = nodes.groupBy(F.shiftright("number", FANOUT_BITS).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("number", "digest", "n_bytes"))).alias("children"))
    upto = lambda i: F.aggregate(F.slice("children", 1, i), F.lit(0).cast("long"), lambda so_far, c: so_far + c["n_bytes"])
    entry = lambda c, i: F.concat_ws(":", c["number"], upto(i), c["n_bytes"], c["digest"])
    digest = F.sha2(F.array_join(F.transform("children", entry), ","), 256)
    return groups.select(F.col("parent").alias("number"), digest.alias("digest"), upto(F.size("children")).alias("n_bytes"))


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """Levels from the records up to the root, each written once."""
    levels = [records]
    for _ in range(depth):
        levels.append(cut(_level_up(levels[-1])))
    return levels


def _differing(a: DataFrame, b: DataFrame, within: DataFrame | None) -> DataFrame:
    """Nodes whose digests differ, or that one side lacks; only children of `within` if given."""
    if within is not None:
        parents = within.select(F.col("number").alias("parent"))
        a, b = (x.join(parents, F.shiftright("number", FANOUT_BITS).eqNullSafe(F.col("parent")), "left_semi") for x in (a, b))
    right = b.select(F.col("number").alias("number_b"), F.col("digest").alias("digest_b"), F.col("n_bytes").alias("n_bytes_b"))
    both = a.join(right, F.col("number").eqNullSafe(F.col("number_b")), "full_outer").where(~F.col("digest").eqNullSafe(F.col("digest_b")))
    return both.select(F.coalesce("number", "number_b").alias("number"), "digest", "digest_b", "n_bytes", "n_bytes_b")


def _offsets(records: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """number and where its record starts in its file, in files that hold a number of `found`."""
    files = found.select(_file(F.col("number")).alias("file")).distinct()
    mine = records.withColumn("file", _file(F.col("number"))).alias("r").join(files.alias("f"), F.col("r.file").eqNullSafe(F.col("f.file")), "left_semi")
    before = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one file of FILE_RECORDS numbers
    return mine.select(F.col("number").alias("at"), F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).cast("long").alias(name))


def _file(number: Column) -> Column:
    return F.shiftright(number, FILE_RECORDS.bit_length() - 1)  # exact for any number, down for negative ones


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """number, file, digest and digest_b, offset and offset_b (bytes from the file's start), n_bytes and n_bytes_b, status
    of each record that differs; what a side lacks is null there."""
    sides = [cut(record_digests(x)) for x in (pages, replica)]
    top = max(abs(x) for side in sides for x in side.agg(F.coalesce(F.max("number"), F.lit(0)), F.coalesce(F.min("number"), F.lit(0))).first())
    depth = max(1, -(-top.bit_length() // FANOUT_BITS))
    a, b = (tree(side, depth) for side in sides)
    found = None
    for level in range(depth, -1, -1):
        found = cut(_differing(a[level], b[level], found))
        if level and found.isEmpty():
            break
    found = found.where(F.lit(level == 0))
    for side, name in zip(sides, ("offset", "offset_b")):
        found = found.join(_offsets(side, found, name), F.col("number").eqNullSafe(F.col("at")), "left").drop("at")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return found.select("number", _file(F.col("number")).alias("file"), "digest", "digest_b", "offset", "offset_b", "n_bytes", "n_bytes_b", status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of `pages` in which some records are changed and some lost, by fixed residues."""
    changed = F.when(F.pmod("page_id", F.lit(97)) == 13, F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html"))
    return pages.select("page_id", "url", changed.alias("html")).where("page_id IS NULL OR pmod(page_id, 389) <> 7")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of `pages` that a damaged replica lost or changed."""
    pages = table(spark, sf_dir, "pages")
    found = audit(pages, damaged(pages))
    return found.select(F.col("number").alias("page_id"), "file", "digest", "digest_b", "offset", "offset_b", "n_bytes", "n_bytes_b", "status")


_RECORD = r"""concat('WARC/1.1', nl, 'WARC-Type: response', nl, 'WARC-Record-ID: <urn:page:', page_id, '>', nl, 'WARC-Target-URI: ', coalesce(url, ''), nl,
 'Content-Type: text/html', nl, 'Content-Length: ', octet_length(encode(html)), nl, nl, html, nl, nl)"""
_FILE = f"(({{0}} - ({{0}} % {FILE_RECORDS} + {FILE_RECORDS}) % {FILE_RECORDS}) // {FILE_RECORDS})"
_BEFORE = f"(coalesce(sum(n_bytes) OVER (PARTITION BY {_FILE.format("{id}")} ORDER BY {{id}} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT"
ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, concat(chr(13), chr(10)) AS nl FROM pages),
q AS (SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN html || '?' ELSE html END AS html, nl FROM p WHERE page_id IS NULL OR page_id % 389 <> 7),
a AS (SELECT *, {_BEFORE.format(id='page_id')} AS "offset" FROM (SELECT page_id, sha256({_RECORD}) AS digest, octet_length(encode({_RECORD})) AS n_bytes FROM p)),
b AS (SELECT *, {_BEFORE.format(id='id')} AS offset_b FROM (SELECT page_id AS id, sha256({_RECORD}) AS digest_b, octet_length(encode({_RECORD})) AS n_bytes FROM q))
SELECT coalesce(page_id, id) AS page_id, {_FILE.format("coalesce(page_id, id)")} AS file, digest, digest_b, "offset", offset_b, a.n_bytes, b.n_bytes AS n_bytes_b,
  CASE WHEN digest_b IS NULL THEN 'missing' WHEN digest IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM a FULL JOIN b ON page_id IS NOT DISTINCT FROM id WHERE digest IS DISTINCT FROM digest_b"""

QUERIES = {"op8_warc_fixity": op8_warc_fixity}
ORACLE_SQL = {"op8_warc_fixity": ORACLE}
