"""WARC files and a Merkle fixity audit of replicas.

Pages are written as WARC response records, in files of FILE_IDS neighbouring page ids, in the order of page id and record
hash; a file that would have over PART_ROWS records or PART_BYTES, or that of pages without an id, is dealt into parts by the
records' hash. Files are gzip-compressed and lie in a folder as grp=N/part=N/*.warc.txt.gz (the writer names them). A replica is
read from its files alone: records are found by their heads and Content-Length, and where a record is cut off or its head is
broken, reading goes on at the next head.

Each replica has a tree for each file. A leaf is the hash of a record with its length; records with ids of one slot form a
node, and up to FANOUT nodes, ordered and with the length of the byte range they cover, form the one above, up to the root.
Slots follow from page ids, so a record that is lost, added or cut moves the offsets but not the branches of its neighbours.
Replicas are compared root by root, and only below nodes that differ are children looked at, down to the records: altered (one
id, another record), lost and added.

Null html is an empty block, null url an empty target, a page_id of any size keeps its own file. Repeated rows are records of
their own and are counted. Line ends in a url become spaces. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm.common import cut, drop_cut, drop_folder, new_folder, release, table

FILE_IDS, FANOUT, LEVELS = 1024, 16, 3
#: Records and bytes of a file from which it is dealt into parts.
PART_ROWS, PART_BYTES = 4096, 64 << 20
CRLF = "\r\n"
#: The pages have no time of capture, so records have this one unless another is given.
DATE = "2024-01-01T00:00:00Z"
FILE = ["grp", "part"]


def record(url: Column, html: Column, page_id: Column, date: str = DATE) -> Column:
    """A response record as a string."""
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html{CRLF}{CRLF}"), F.coalesce(html, F.lit("")))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]+", " "), F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(f"{CRLF}{CRLF}"), block, F.lit(CRLF * 2),
    )


def archive(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, grp, part, record, record_sha256) of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record(F.col("url"), F.col("html"), F.col("page_id").cast("long"), date).alias("record"))
    grp = F.shiftright("page_id", FILE_IDS.bit_length() - 1)
    rows = rows.withColumn("grp", grp).withColumn("record_sha256", F.sha2(F.col("record").cast("binary"), 256))
    size = F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum(F.octet_length("record")) / PART_BYTES))
    large = cut(rows.groupBy("grp").agg(size.cast("int").alias("parts")).where("parts > 1").withColumnRenamed("grp", "g"), "large")
    if large.isEmpty():
        drop_cut(large)
        return rows.select("page_id", "grp", F.lit(0).alias("part"), "record", "record_sha256")
    dealt = F.pmod(F.conv(F.substring("record_sha256", 1, 8), 16, 10).cast("long"), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(large, F.col("grp").eqNullSafe(F.col("g")), "left").select("page_id", "grp", dealt.alias("part"), "record", "record_sha256")


def write_files(records: DataFrame, name: str = "warc") -> str:
    """Writes records as WARC files into a new folder, and returns it. A record ends with a line feed, which the writer of
    text files puts behind each value."""
    folder = new_folder(records.sparkSession, name)
    ordered = records.repartition(*FILE).sortWithinPartitions(*FILE, "page_id", "record_sha256")
    text = ordered.select(F.expr("substring(record, 1, length(record) - 1)").alias("value"), *FILE)
    _write(text, folder)
    release(records.sparkSession)
    return folder


def _write(text: DataFrame, folder: str) -> None:
    """Files of column value; gzip's quickest level is under half the time of its usual one."""
    text.write.partitionBy(*FILE).option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*\r\n")
_NEXT = re.compile(rb"(?=WARC/1\.[01]\r\nWARC-Type: )")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:([^>\r\n]*)>")
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n")


def read_records(data: bytes):
    """(page id or None, offset, end) of each record. A piece that is no whole record reaches to the next head."""
    at = 0
    while at < len(data):
        head = _HEAD.match(data, at)
        # a record cut off within its head runs into the next one's
        length = head and not _NEXT.search(head[0], 1) and _LENGTH.search(head[0])
        end = head.end() + int(length[1]) + 4 if length else -1
        whole = 0 <= end <= len(data) and data[end - 4 : end] == b"\r\n\r\n" and (end == len(data) or data.startswith(b"WARC/1.", end))
        if not whole:
            after = _NEXT.search(data, at + 1)
            end = after.start() if after else len(data)
        named = _ID.search(data, at, head.end() if length else min(end, at + 4096))
        said = named[1].decode("ascii", "replace") if named else "none"
        yield (int(said) if re.fullmatch(r"-?\d{1,19}", said) else None), at, end
        at = end


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(grp, part, content) of each file."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(folder)
    place = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)  # noqa: E731  no number: the group of pages without an id
    return read.select(place("grp").try_cast("long").alias("grp"), place("part").cast("int").alias("part"), "content")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(grp, part, page_id, offset, n_bytes, record_sha256) of each record in the files of a replica."""

    def run(batches):
        for batch in batches:
            for grp, part, content in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "content"))):
                data, _ = unzipped(content)
                rows = [(grp, part, page, a, b - a, hashlib.sha256(memoryview(data)[a:b]).hexdigest()) for page, a, b in read_records(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

    return _files(spark, folder).mapInArrow(run, "grp long, part int, page_id long, offset long, n_bytes long, record_sha256 string")


_NAMES = ["grp", "part", "page_id", "offset", "n_bytes", "record_sha256"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


MAGIC, SLICE, TRIED = b"\x1f\x8b\x08", 1 << 16, 4096


def _member(data: bytes, at: int) -> tuple[list[bytes], int, bool]:
    """What can be read of the gzip member at this place, where reading ended, and whether it ended as it should."""
    out, member = [], zlib.decompressobj(31)
    while not member.eof and at < len(data):
        before = member.copy()
        try:
            out.append(member.decompress(data[at : at + SLICE]))
            at += SLICE
        except zlib.error:
            # the slice anew, up to the damage
            for to in range(at, at + SLICE, 16):
                try:
                    out.append(before.decompress(data[to : to + 16]))
                except zlib.error:
                    return out, to, False
    return out, min(at, len(data)) - len(member.unused_data), member.eof


def _next_member(data: bytes, at: int) -> int:
    """Where the next member starts that can be read for a while; else the end."""
    while (at := data.find(MAGIC, at)) >= 0:
        try:
            zlib.decompressobj(31).decompress(data[at : at + TRIED])
            return at
        except zlib.error:
            at += 1
    return len(data)


def unzipped(data: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """What can be read of all members of a gzip file, and the ranges of stored bytes that cannot. Behind a damaged member,
    a member that is cut off, or bytes between members, reading goes on at the next start of one; of a damaged one what
    stands before the damage is kept."""
    out, bad, at = [], [], 0
    while at < len(data):
        read, end, sound = _member(data, at)
        if not sound:
            after = _next_member(data, at + 1)
            # a member that is cut off runs into the next one
            read, to, _ = _member(data[at:after], 0) if after < end else (read, end - at, False)
            bad.append((min(at + to, after - 1), after))
            end = after
        out += read
        at = end
    return b"".join(out), bad


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """(grp, part, first, behind) of the ranges of stored bytes in a replica's files that give no records."""

    def run(batches):
        for batch in batches:
            for grp, part, content in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "content"))):
                if found := unzipped(content)[1]:
                    first, behind = zip(*found)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(first, pa.int64()), pa.array(behind, pa.int64())], [*FILE, "first", "behind"])

    return _files(spark, folder).mapInArrow(run, "grp long, part int, first long, behind long")


def audit_storage(spark: SparkSession, one: str, other: str) -> DataFrame:
    """As audit(), of the files in two folders: a record that is lost from a file of the other of which a range cannot be read
    is called unreadable."""
    found = audit(*(cut(read_files(spark, x), "records") for x in (one, other)))
    bad = unreadable(spark, other).select(F.col("grp").alias("g"), F.col("part").alias("p")).distinct().withColumn("bad", F.lit(True))
    said = found.join(bad, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")), "left")
    fault = F.when(F.col("bad") & (F.col("fault") == "lost"), "unreadable").otherwise(F.col("fault"))
    return said.withColumn("fault", fault).select(found.columns)


def tree(records: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """(grp, part, at, hash) of each level from the slots up, each a table; the last has one node for each file."""
    slot = F.coalesce(F.col("page_id").bitwiseAND(FILE_IDS - 1), F.conv(F.substring("record_sha256", 1, 8), 16, 10).cast("long").bitwiseAND(FILE_IDS - 1))
    leaf = F.struct(F.col("record_sha256").alias("h"), F.col("n_bytes").alias("n"))
    out, below, at = [], records.select(*FILE, "page_id", leaf.alias("c"), slot.alias("at")), F.col("at")
    for k in range(levels + 1):
        ordered = F.struct("page_id", "c") if k == 0 else F.struct("at", "c")
        node = below.select(*FILE, at.cast("long").alias("up"), ordered.alias("o")).groupBy(*FILE, "up").agg(F.array_sort(F.collect_list("o")).alias("os"))
        text = F.array_join(F.transform("os", lambda o: F.concat(o["c"]["n"].cast("string"), F.lit(":"), o["c"]["h"])), "|")
        size = F.aggregate("os", F.lit(0).cast("long"), lambda n, o: n + o["c"]["n"])
        out.append(cut(node.select(*FILE, F.col("up").alias("at"), F.sha2(F.concat(F.lit("node|"), text).cast("binary"), 256).alias("h"), size.alias("n")), "nodes"))
        below = out[-1].select(*FILE, "at", F.struct("h", "n").alias("c"))
        at = F.shiftright("at", 4) if k < levels - 1 else F.lit(0)
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"{k}_"])
    return on


def audit(one: DataFrame, other: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(grp, part, page_id, record_sha256, fault, copies) of the records in which replicas (tables of records) differ: lost and
    added ones, and of an id that has as many of both, altered. Roots first, then children of differing nodes."""
    mine, theirs = tree(one, levels), tree(other, levels)
    keys, suspects, spent = [*FILE, "at"], None, [*mine, *theirs]
    for k in range(levels, -1, -1):
        a, b = mine[k], theirs[k].toDF(*[f"{c}_" for c in theirs[k].columns])
        if suspects is not None:
            up = lambda at: F.shiftright(at, 4) if k < levels - 1 else F.lit(0).cast("long")  # noqa: B023,E731  used at once
            a = a.join(suspects, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")) & (up("at") == F.col("up")), "left_semi")
            b = b.join(suspects, F.col("grp_").eqNullSafe(F.col("g")) & (F.col("part_") == F.col("p")) & (up("at_") == F.col("up")), "left_semi")
        differ = a.join(b, _same(a, b, keys), "full_outer").where(~(F.col("h").eqNullSafe(F.col("h_")) & F.col("n").eqNullSafe(F.col("n_"))))
        first = lambda c: F.when(F.col("h").isNotNull(), F.col(c)).otherwise(F.col(f"{c}_"))
        suspects = cut(differ.select(first("grp").alias("g"), first("part").alias("p"), first("at").alias("up")), "suspects")
        spent.append(suspects)
    slot = F.coalesce(F.col("page_id").bitwiseAND(FILE_IDS - 1), F.conv(F.substring("record_sha256", 1, 8), 16, 10).cast("long").bitwiseAND(FILE_IDS - 1))
    under = F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")) & (slot == F.col("up"))
    count = lambda x, sign: x.join(suspects, under, "left_semi").select(*FILE, "page_id", "record_sha256", F.lit(sign).alias("s"))
    both = count(one, 1).union(count(other, -1)).groupBy(*FILE, "page_id", "record_sha256").agg(F.sum("s").alias("more")).where("more <> 0")
    ids = both.groupBy(*FILE, "page_id").agg(F.sum("more").alias("left"), F.collect_list(F.struct("record_sha256", "more")).alias("rs"))
    each = ids.select(*FILE, "page_id", "left", F.explode("rs").alias("r")).select(*FILE, "page_id", "left", "r.*")
    kind = F.when((F.col("left") == 0) & F.col("page_id").isNotNull(), F.lit("altered")).when(F.col("more") > 0, F.lit("lost")).otherwise(F.lit("added"))
    found = each.select(*FILE, "page_id", "record_sha256", kind.alias("fault"), F.col("more").alias("copies"))
    found = cut(found.where("copies > 0 or fault = 'added'").withColumn("copies", F.abs("copies")), "faults")
    drop_cut(*spent)
    return found


def damaged_copy(spark: SparkSession, folder: str, every: int = 97) -> str:
    """A replica for drills, written from the files of another. Of each `every` page ids one has a record with another byte
    before its end, the next none, the next one without its last 9 bytes, and the next one twice."""
    files, copy = _files(spark, folder), new_folder(spark, "warc-copy")

    def run(batches):
        for batch in batches:
            for grp, part, content in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "content"))):
                data, out = unzipped(content)[0], []
                for page, a, b in read_records(data):
                    x, way = data[a:b], -1 if page is None else page % every
                    out.append({0: x[:-5] + (b"!" if x[-5:-4] != b"!" else b"?") + x[-4:], 1: b"", 2: x[:-9], 3: x + x}.get(way, x))
                whole = b"".join(out)
                # the writer ends each value with a line feed: a cut record at the end of a file gets one more
                text = whole[:-1] if whole.endswith(b"\n") else whole
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array([text.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()], pa.string()), pa.array([grp], pa.int64()), pa.array([part], pa.int32())], ["value", *FILE])

    _write(files.mapInArrow(run, "value string, grp long, part int"), copy)
    return copy


def op3_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of the archive with its place and what the audit of a damaged replica says of it: sound, altered (by a byte
    or by being cut) or lost; and the records that the replica has besides."""
    first = write_files(archive(table(spark, sf_dir, "pages")))
    second = damaged_copy(spark, first)
    one, other = cut(read_files(spark, first), "records"), cut(read_files(spark, second), "records")
    drop_folder(first)
    drop_folder(second)
    found = audit(one, other)
    drop_cut(other)
    keys = ["grp", "part", "page_id", "record_sha256"]
    lost = found.where("fault <> 'added'").toDF(*[f"{c}_" for c in found.columns])
    said = one.join(lost, _same(one, lost, keys), "left").select("page_id", "grp", "part", "offset", "n_bytes", "record_sha256", F.coalesce("fault_", F.lit("sound")).alias("state"))
    none = F.lit(None).cast("long")
    more = found.where("fault = 'added'").select("page_id", "grp", "part", none.alias("offset"), none.alias("n_bytes"), "record_sha256", F.col("fault").alias("state"))
    return said.union(more)


QUERIES = {"op3_warc_merkle_audit": op3_warc_merkle_audit}

_RECORD = f"""'WARC/1.0' || n || 'WARC-Type: response' || n || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || n ||
  'WARC-Date: {DATE}' || n || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\\r\\n]+', ' ', 'g') || n ||
  'Content-Type: application/http; msgtype=response' || n || 'Content-Length: ' || strlen(block) || n || n || block || n || n"""
ORACLE_SQL = {
    "op3_warc_merkle_audit": f"""
WITH blocks AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, url, chr(13) || chr(10) AS n,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS block
  FROM pages),
records AS (SELECT page_id, row_number() OVER () AS nth, {_RECORD} AS record FROM blocks),
hashed AS (
  SELECT page_id, nth, record, strlen(record) AS n_bytes, sha256(record) AS record_sha256,
         (page_id - (page_id % {FILE_IDS} + {FILE_IDS}) % {FILE_IDS}) // {FILE_IDS} AS grp FROM records),
parts AS (
  SELECT grp AS g, greatest(ceil(count(*) / {PART_ROWS}.0), ceil(sum(n_bytes) / {PART_BYTES}.0)) AS parts FROM hashed GROUP BY grp),
one AS (
  SELECT h.*, CAST(CAST('0x' || substr(record_sha256, 1, 8) AS BIGINT) % CAST(parts AS BIGINT) AS INTEGER) AS part
  FROM hashed h JOIN parts ON grp IS NOT DISTINCT FROM g),
drill AS (SELECT *, coalesce((page_id % 97 + 97) % 97, 9) AS way FROM one),
other AS (
  SELECT page_id, grp, part,
         sha256(CASE way WHEN 0 THEN substr(record, 1, length(record) - 5) || CASE WHEN substr(record, length(record) - 4, 1) = '!' THEN '?' ELSE '!' END || right(record, 4)
                         WHEN 2 THEN substr(record, 1, length(record) - 9) ELSE record END) AS record_sha256
  FROM drill CROSS JOIN (SELECT unnest([1, 2]) AS copy) WHERE way <> 1 AND (copy = 1 OR way = 3)),
counts AS (
  SELECT page_id, grp, part, record_sha256, sum(s) AS more
  FROM (SELECT page_id, grp, part, record_sha256, 1 AS s FROM one UNION ALL SELECT page_id, grp, part, record_sha256, -1 FROM other)
  GROUP BY ALL HAVING sum(s) <> 0),
faults AS (
  SELECT *, CASE WHEN page_id IS NOT NULL AND sum(more) OVER (PARTITION BY grp, part, page_id) = 0 THEN 'altered' WHEN more > 0 THEN 'lost' ELSE 'added' END AS fault
  FROM counts)
SELECT o.page_id, o.grp, o.part,
       CAST(sum(n_bytes) OVER (PARTITION BY o.grp, o.part ORDER BY o.page_id NULLS FIRST, o.record_sha256, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_bytes AS BIGINT) AS "offset",
       CAST(n_bytes AS BIGINT) AS n_bytes, o.record_sha256, coalesce(fault, 'sound') AS state
FROM one o LEFT JOIN faults f
  ON f.more > 0 AND o.grp IS NOT DISTINCT FROM f.grp AND o.part = f.part AND o.page_id IS NOT DISTINCT FROM f.page_id AND o.record_sha256 = f.record_sha256
UNION ALL
SELECT page_id, grp, part, NULL, NULL, record_sha256, fault FROM faults WHERE fault = 'added'""",
}
