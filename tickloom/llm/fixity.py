"""Merkle fixity audit of replicated WARC records.

Records are hashed into leaves; leaves whose keys fall into the same range of ``FAN`` keys are hashed, in order, into a
node, nodes into wider ranges, up to one root for each file. Two replicas' roots are compared, and only where they differ
are the children compared, level by level, down to the damaged records. A node also has the range of byte offsets that
its records take up in the file, so a difference is at once a range to copy again.

A leaf's place comes from its record's key within the file, not from its count, so a lost or an added record changes
its own leaf only. Files hold at most ``FILE_KEYS`` keys: a group being hashed is never larger than ``FAN`` children, and the
number of levels is fixed. A whole number is placed by its value; other ids by their hash over as many files as the records ask for
(``files_for``), records without an id by that of their bytes. Hashes stand for bytes alone, since a lost record would otherwise change all that
follow it; ``tree(..., with_places=True)`` hashes offsets too, for replicas that must agree in them.

Records that share a key are one leaf, hashed in two steps (by the first digits of their hashes, so that no task holds all records of a hot
key). Where such a leaf differs the descent goes on to its records (``findings``): copies of equal id and bytes are counted in both replicas, and what
one has over is paired by id.

Defined results: a record that both replicas hold with equal bytes is ``ok``; of the records of an id that the other replica does not hold so,
as many as it holds with other bytes are ``changed`` (in order of their hashes) and the rest ``missing``, or ``extra`` in the second. Each record is a row with its own
offset: in a leaf records lie in order of hash, then id. A null payload is an empty one; very long ones are hashed whole. Empty replicas have no
roots. Only the id and the payload are read, so other columns can't clash.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

FAN = 16
FILE_KEYS = 4096
#: Files over which records are dealt whose place comes from a hash.
HASH_FILES = 1024
LEVELS = 3  # FAN ** LEVELS == FILE_KEYS


def warc_record(url: Column, record_id: Column, body: Column) -> Column:
    """A WARC response record as text; its block is the page."""
    block = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    )


def files_for(records: int) -> int:
    """Files to deal so many records over by hash, a power of two: a quarter of the keys used on average. Both replicas need the same number."""
    return max(HASH_FILES, 1 << max(0, records * 4 // FILE_KEYS).bit_length())


def placed(records: DataFrame, id_column: str, payload: str, files: int = HASH_FILES) -> DataFrame:
    """id, file, key, length, hash of each record; records lie in their file by key. files: over how many those are dealt that are placed by a hash."""
    name = F.col(f"`{id_column}`")
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    if dict(records.dtypes)[id_column] in ("tinyint", "smallint", "int", "bigint"):
        file, key = F.floor(name / F.lit(FILE_KEYS)), F.pmod(name, F.lit(FILE_KEYS))
    else:
        file, key = F.pmod(F.shiftright(F.xxhash64(name), 12), F.lit(files)), F.pmod(F.xxhash64(name), F.lit(FILE_KEYS))
    content = F.xxhash64(body)
    return records.select(
        name.alias("id"),
        F.when(name.isNull(), -1 - F.pmod(F.shiftright(content, 12), F.lit(files))).otherwise(file).cast("long").alias("file"),
        F.when(name.isNull(), F.pmod(content, F.lit(FILE_KEYS))).otherwise(key).cast("int").alias("key"),
        F.octet_length(body).cast("long").alias("length"),
        F.sha2(F.concat(F.lit("R").cast("binary"), body), 256).alias("hash"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """file, key, length, hash of each key's placed records. The hash of a single record is its own."""
    same = records.groupBy("file", "key", "hash").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"))
    part = same.select("file", "key", F.substring("hash", 1, 3).alias("digits"), "length", F.when(F.col("n") == 1, F.col("hash")).otherwise(F.concat_ws("*", "hash", F.col("n").cast("string"))).alias("hash"))
    for keys in (["file", "key", "digits"], ["file", "key"]):
        whole = F.when((F.count(F.lit(1)) == 1) & (F.max(F.length("hash")) == 64), F.max("hash")).otherwise(F.sha2(F.concat(F.lit("L").cast("binary"), F.concat_ws(",", F.array_sort(F.collect_list("hash"))).cast("binary")), 256))
        part = part.groupBy(*keys).agg(F.sum("length").alias("length"), whole.alias("hash"))
    return part


def with_offsets(leaf: DataFrame) -> DataFrame:
    """Adds each record's offset in its file (files are bounded, so a window over one file is)."""
    before = Window.partitionBy("file").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def tree(leaf: DataFrame, with_places: bool = False) -> list[DataFrame]:
    """Node tables by level, leaves first; each has file, node, offset, end, hash. The last level has the files' roots.

    with_places: a leaf's hash covers its offset and length too.
    """
    if with_places:
        leaf = leaf.withColumn("hash", F.sha2(F.concat_ws(":", F.lit("P"), F.col("offset").cast("string"), F.col("length").cast("string"), "hash").cast("binary"), 256))
    levels = [leaf.select("file", F.col("key").alias("node"), "offset", (F.col("offset") + F.col("length")).alias("end"), "hash")]
    for _ in range(LEVELS):
        below = levels[-1]
        grouped = below.groupBy("file", F.floor(F.col("node") / F.lit(FAN)).cast("int").alias("node")).agg(
            F.min("offset").alias("offset"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("children")
        )
        named = F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"]))
        levels.append(grouped.select("file", "node", "offset", "end", F.sha2(F.concat(F.lit("N").cast("binary"), F.concat_ws(",", named).cast("binary")), 256).alias("hash")))
    return levels


def audit(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """Damaged records: file, key, offset and length in the first replica (else the second), status."""
    differing = None
    for a, b in zip(reversed(first), reversed(second), strict=True):
        if differing is not None:  # only children of nodes that differ
            parent = F.floor(F.col("node") / F.lit(FAN)).cast("int")
            up = differing.select("file", F.col("node").alias("up"))
            a, b = (side.withColumn("up", parent).join(up, ["file", "up"], "left_semi").drop("up") for side in (a, b))
        b = b.select("file", "node", F.col("offset").alias("b_offset"), F.col("end").alias("b_end"), F.col("hash").alias("b_hash"))
        differing = a.join(b, ["file", "node"], "full_outer").where(~F.col("hash").eqNullSafe(F.col("b_hash")))
    status = F.when(F.col("b_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    begin = F.coalesce("offset", "b_offset")
    return differing.select("file", F.col("node").alias("key"), begin.alias("offset"), (F.coalesce("end", "b_end") - begin).alias("length"), status.alias("status"))


def counted(records: DataFrame) -> DataFrame:
    """Placed records with their copies counted: file, key, id, hash, length, n, and what names an id where nulls can't (``name``, ``named``)."""
    held = records.groupBy("file", "key", "id", "hash", "length").agg(F.count(F.lit(1)).alias("n"))
    return held.withColumns({"name": F.coalesce(F.col("id").cast("string"), F.lit("")), "named": F.col("id").isNotNull(), "digits": F.substring("hash", 1, 3)})


def _before(frame: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of a value over the rows before, by hash and id within keys: first by the hashes' first digits, so that no task orders all rows of a hot key."""
    lower = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    parts = frame.groupBy(*keys, "digits").agg(F.sum(value).alias("__sum"))
    parts = parts.withColumn("__lower", none(F.sum("__sum").over(lower(keys, "digits")))).drop("__sum")
    inner = frame.withColumn("__inner", none(F.sum(value).over(lower([*keys, "digits"], "hash", "name", "named"))))
    return inner.join(parts, [*keys, "digits"]).withColumn(out, (F.col("__lower") + F.col("__inner")).cast("long")).drop("__lower", "__inner")


def findings(first: DataFrame, second: DataFrame, leaves_: DataFrame) -> DataFrame:
    """Of each (file, key, name, named, hash) in differing leaves: how many copies are ok, changed, missing and extra. first, second: ``counted`` records."""
    key = ["file", "key", "name", "named", "digits", "hash"]
    some = leaves_.select("file", "key")
    side = lambda frame, a, b: frame.join(some, ["file", "key"], "left_semi").select(*key, a.alias("a"), b.alias("b"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    both = side(first, n, zero).unionByName(side(second, zero, n)).groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = both.withColumns({"ok": F.least("a", "b"), "over": F.greatest(F.col("a") - F.col("b"), zero), "under": F.greatest(F.col("b") - F.col("a"), zero)})
    one = key[:4]
    totals = both.groupBy(*one).agg(F.least(F.sum("over"), F.sum("under")).alias("pairs"))
    out = _before(_before(both, one, "over", "over_before"), one, "under", "under_before").join(totals, one)
    taken = lambda has, before: F.greatest(zero, F.least(F.col(has), F.col("pairs") - F.col(before)))
    out = out.withColumns({"changed": taken("over", "over_before"), "replaced": taken("under", "under_before")})
    return out.select(*one, "hash", "ok", "changed", (F.col("over") - F.col("changed")).alias("missing"), (F.col("under") - F.col("replaced")).alias("extra"))


def tree_of(records: DataFrame, name: str) -> list[DataFrame]:
    """The tree of placed records; leaves and nodes are written once, as a manifest that later audits can read."""
    levels = tree(written(with_offsets(leaves(records)), f"{name}-leaves"))
    return [levels[0], *(written(level, f"{name}-level{i}") for i, level in enumerate(levels[1:], 1))]


def audited_tree(records: DataFrame, id_column: str, payload: str, name: str) -> list[DataFrame]:
    """A replica's tree."""
    return tree_of(placed(records, id_column, payload), name)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: file, ordinal, offset, length, header, block. A file (by custom at most 1 GB) is read whole by one task.

    Gzip files are unpacked first; their offsets are those of the unpacked bytes. Where a header has no end or no length, or the file ends
    within a record, the rest of the file is one record without a header: an audit then finds it changed.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                rows, at = [], 0
                while at < len(data):
                    head = data.find(b"\r\n\r\n", at) + 4
                    named = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[at:head]) if head > 3 else None
                    size = int(named[1]) if named else len(data)
                    if head + size + 4 > len(data):
                        rows.append((path, len(rows), at, len(data) - at, None, data[at:]))
                        break
                    rows.append((path, len(rows), at, head + size + 4 - at, data[at:head].decode("utf-8", "replace"), data[head : head + size]))
                    at = head + size + 4
                yield pd.DataFrame(rows, columns=["file", "ordinal", "offset", "length", "header", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, ordinal long, offset long, length long, header string, block binary")


def drilled(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages' records, and a replica with planted damage: by crc32 of the id modulo 97, a changed, a cut and a lost record."""
    base = pages.select("page_id", warc_record(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    at = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")) % 97
    damaged = F.when(at == 3, F.overlay("record", F.lit("#"), F.lit(7))).when(at == 5, F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return base, base.where(at != 7).withColumn("record", damaged)


#: Copies of one record are made into rows by runs of so many.
COPIES = 4_096


def op3_query(pages: DataFrame) -> DataFrame:
    """Every record of the pages with its place, hash and the audit's finding against the drilled replica."""
    first, second = drilled(pages)
    files = files_for(pages.count())
    records = written(placed(first, "page_id", "record", files), "merkle-records")
    replica = written(placed(second, "page_id", "record", files), "merkle-replica")
    a, b = tree_of(records, "merkle-a"), tree_of(replica, "merkle-b")
    differing = written(audit(a, b).select("file", "key"), "merkle-differing")
    held = counted(records)
    found = findings(held, counted(replica), differing).drop("extra")
    inner = _before(held.withColumn("bytes", F.col("n") * F.col("length")), ["file", "key"], "bytes", "inside")
    out = inner.join(a[0].select("file", F.col("node").alias("key"), "offset"), ["file", "key"]).join(found, ["file", "key", "name", "named", "hash"], "left")
    # The copies of a record as rows: runs first, so that no row makes more than a bounded list.
    runs = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    copies = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * COPIES + 1, F.least(F.col("n"), (F.col("run") + 1) * COPIES))))
    ok = F.coalesce("ok", "n")
    status = F.when(F.col("copy") <= ok, "ok").when(F.col("copy") <= ok + F.col("changed"), "changed").otherwise("missing")
    return copies.select(F.col("id").alias("page_id"), "file", (F.col("offset") + F.col("inside") + (F.col("copy") - 1) * F.col("length")).alias("offset"), "length", "hash", status.alias("status"))


def op3_sql() -> str:
    """The same by comparing all records; DuckDB has no crc32, so the drill's remainder is computed bit by bit."""
    return f"""
with recursive ids as (select distinct page_id, cast(page_id as varchar) as s from pages where page_id is not null),
crc as (
  select page_id, s, 0 as i, cast(4294967295 as bigint) as c from ids
  union all
  select page_id, s, i + 1, list_reduce(list_prepend(xor(c, cast(ascii(s[(i // 8) + 1]) as bigint) * cast(i % 8 = 0 as bigint)), [cast(0 as bigint)]),
    lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) from crc where i < 8 * length(s)),
place as (select page_id, xor(c, 4294967295) % 97 as spot from crc where i = 8 * length(s)),
r as (select page_id, page_id // {FILE_KEYS} as file,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
  || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record from pages)
select r.page_id, file, cast(sum(strlen(record)) over (partition by file order by r.page_id, sha256('R' || record) rows unbounded preceding) - strlen(record) as bigint) as "offset",
  cast(strlen(record) as bigint) as length, sha256('R' || record) as hash,
  case when spot in (3, 5) then 'changed' when spot = 7 then 'missing' else 'ok' end as status from r join place using (page_id)
"""
