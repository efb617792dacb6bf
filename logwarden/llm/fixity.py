"""Merkle fixity audit of WARC records.

Pages become WARC response records in files, ordered by page; a record has an offset and a length.
Every file of a replica is a tree: the leaves are digests of records, a node is the digest of up to
``fanout`` ordered ranges below it, the root stands for the file. Two replicas are compared root by
root; only below roots, and then nodes, that differ are their children compared, down to the
records. There, records are matched by what they hold and then by their id, so a record lost or
inserted inside a file is told from those that it shifts. Records are hashed and measured where they
are read; digests and lengths are all that moves. All of it is DataFrame expressions, a group-by a
level over at most ``fanout`` children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import materialise

FANOUT = 16
#: Pages in a file, by page_id.
FILE_PAGES = 256
#: Files that pages without an id are dealt over.
LOOSE_FILES = 1 << 16


def warc_payload(url: Column, html: Column, page_id: Column) -> Column:
    """The bytes of a WARC/1.1 response record; null parts count as empty."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    block = F.concat(F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "utf-8"), body)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), block, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def _filed(pages: DataFrame, file_pages: int) -> DataFrame:
    """page_id, file_id, length, digest, payload: records with their files, as they are read."""
    rows = pages.select("page_id", "url", warc_payload(F.col("url"), F.col("html"), F.col("page_id")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.length("payload").cast("long"))
    loose = -1 - F.pmod(F.xxhash64(F.coalesce("url", "digest")), F.lit(LOOSE_FILES))
    return rows.withColumn("file_id", F.coalesce(F.floor(F.col("page_id") / file_pages), loose).cast("long"))


def _numbered(rows: DataFrame, *more: str) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy("page_id", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "file_id", (F.row_number().over(order) - 1).cast("long").alias("record_no"), "page_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", *more
    )


def warc_index(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """file_id, record_no, page_id, offset, length, digest: where each page's record is, without its bytes.

    Files hold ``file_pages`` page ids. Pages without an id are dealt over LOOSE_FILES files, numbered
    below zero, by their URL, or by their digest if they have none. Repeated rows are records of their own.
    """
    return _numbered(_filed(pages, file_pages).drop("payload"), "digest")


def warc_records(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """warc_index() with the records' bytes (payload) instead of their digests, for writing files."""
    return _numbered(_filed(pages, file_pages), "payload")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0: a digest of each record with its place, so a moved record differs too; and its id, if it has any."""
    own = F.col("page_id") if "page_id" in records.columns else F.lit(None).cast("long")
    digest = F.col("digest") if "digest" in records.columns else F.sha2("payload", 256)
    return records.select("file_id", F.lit(0).alias("level"), F.col("record_no").alias("node"), "offset", "length", digest.alias("digest"), own.alias("page_id"))


def merkle_tree(level0: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of every file's tree, leaves first, until each file has one root."""
    levels = [materialise(level0, "merkle")]
    most = levels[0].agg(F.max("node")).first()[0]
    while most:
        child = levels[-1]
        ranges = F.sort_array(F.collect_list(F.struct("node", "offset", "length", "digest")))
        up = child.groupBy("file_id", (F.floor(F.col("node") / fanout)).cast("long").alias("up")).agg(
            F.min("offset").alias("offset"), F.sum("length").alias("length"), ranges.alias("parts")
        )
        text = F.concat_ws(";", F.transform("parts", lambda x: F.concat_ws(",", x["offset"].cast("string"), x["length"].cast("string"), x["digest"])))
        levels.append(materialise(up.select("file_id", F.lit(len(levels)).alias("level"), F.col("up").alias("node"), "offset", "length", F.sha2(text, 256).alias("digest")), "merkle"))
        most //= fanout
    return levels


def paired(sides: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, a, b: the n-th records of both replicas that share the keys, nulls too; a or b is null without a partner."""
    nth = F.row_number().over(Window.partitionBy("side", *keys).orderBy("node"))
    record = F.struct("node", "offset", "length", "digest", "page_id")
    of = lambda s: F.max(F.when(F.col("side") == s, record)).alias(s)
    return sides.withColumn("nth", nth).groupBy(*keys, "nth").agg(of("a"), of("b"))


def audit(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """file_id, record_no, fault, offset, length, replica_offset, replica_length of records that differ.

    Faults: ``moved`` (the same record, by id and digest, at another place of the file), ``altered``
    (another digest under the same id), ``missing`` and ``surplus`` (no such record in the replica,
    or in the first). A record without an id goes by its number once its digest finds no match.
    record_no is the first's, for surplus records the replica's. A record that went to another file
    is missing in one and surplus in the other. The trees' levels come from merkle_tree(); the
    descent starts at the higher root and follows mismatches alone.
    """
    open_nodes = None
    for level in reversed(range(max(len(a), len(b)))):
        x = a[level] if level < len(a) else a[0].limit(0)
        y = b[level] if level < len(b) else b[0].limit(0)
        if open_nodes is not None:
            x, y = (f.join(open_nodes, (f["file_id"] == open_nodes["up_file"]) & (F.floor(f["node"] / fanout).cast("long") == open_nodes["up"]), "left_semi") for f in (x, y))
        if not level:
            break
        name = lambda f, s: f.select("file_id", "node", *[F.col(c).alias(f"{s}_{c}") for c in ("offset", "length", "digest")])
        met = name(x, "a").join(name(y, "b"), ["file_id", "node"], "full")
        differs = met.filter(~(F.col("a_digest").eqNullSafe(F.col("b_digest")) & F.col("a_offset").eqNullSafe(F.col("b_offset")) & F.col("a_length").eqNullSafe(F.col("b_length"))))
        open_nodes = materialise(differs.select(F.col("file_id").alias("up_file"), F.col("node").alias("up")).distinct(), "mismatches")
    fields = ["node", "offset", "length", "digest", "page_id"]
    sides = x.select(F.lit("a").alias("side"), "file_id", *fields).unionByName(y.select(F.lit("b").alias("side"), "file_id", *fields))
    # what is at its place in both goes first
    place = ["file_id", "node", "offset", "length", "digest"]
    apart = paired(sides, place).filter(F.col("a").isNull() | F.col("b").isNull())
    split = lambda f: f.select("file_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("r")), F.struct(F.lit("b").alias("side"), F.col("b").alias("r")))).alias("s")).filter("s.r is not null").select("s.side", "file_id", "s.r.*")
    same = materialise(paired(split(apart), ["file_id", "page_id", "digest"]).select("file_id", "a", "b"), "record-pairs")
    moved = same.filter("a is not null and b is not null").withColumn("fault", F.lit("moved"))
    rest = split(same.filter("a is null or b is null")).withColumn("number", F.when(F.col("page_id").isNull(), F.col("node")))
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "surplus").otherwise("altered")
    found = moved.unionByName(paired(rest, ["file_id", "page_id", "number"]).select("file_id", "a", "b", fault.alias("fault")))
    return found.select(
        "file_id", F.coalesce("a.node", "b.node").alias("record_no"), "fault", F.col("a.offset").alias("offset"), F.col("a.length").alias("length"), F.col("b.offset").alias("replica_offset"), F.col("b.length").alias("replica_length")
    )


def fixity_audit(first: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Compare two tables of records (file_id, record_no, offset, length, digest or payload; page_id where records have ids).

    One row per record that differs; none where replicas agree or both are empty. A null payload is
    a record without a digest and differs from any that has one.
    """
    fill = lambda r: leaves(r).withColumn("digest", F.coalesce("digest", F.lit("-")))
    return audit(merkle_tree(fill(first), fanout), merkle_tree(fill(replica), fanout), fanout)
