"""WARC files and a Merkle fixity audit of replicas.

Pages become WARC/1.0 records in gzip files of about PER_FILE records. A replica is read back record by record, each with
its file, place and range of bytes (offset and length in the unpacked file). A leaf is the hash of a record's range and
its SHA-256; every 2^FAN_BITS nodes make a node of the next level, the hash of their hashes in order, up to a root for
each file and one for the archive. An audit compares two replicas' roots and descends only below nodes that differ, so its
joins shrink to the damaged branches. The records under differing leaves are then told apart, inside their file:

moved    the same bytes at another place (a fault before them changed the length)
corrupt  other bytes under the same record id, or after the same predecessor where the id can't be read
missing  in ours only
extra    in theirs only

write_warc() needs no file access of its own: a record ends with two line ends, which Spark's text writer puts between
rows. read_warc() takes files plain or gzip, of one member or many, and unpacks and cuts them piece by piece; files of WHOLE_FILE
bytes or more, which Spark doesn't give whole, are streamed by pyarrow's file systems. A record with a bad header, or whose length
doesn't lead to the end of a record, becomes a row of its own without url and id, up to the next record that begins after two
line ends. A damaged packed byte leaves what was unpacked before it in its member, and all other members: the packed range
between is a row without bytes that names it. What such a fault destroys in a file of one member is all that follows.

Defined cases: null html or url is an empty string; line ends in a url are written as %0D and %0A; a null page_id is an empty id; records are dealt to files by the hash
of page_id and url, so equal ids with different urls spread, and equal rows share a file, ordered by page_id, url and hash
(equal records are interchangeable); very long pages are long records; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.common import BATCH_BYTES, shared_dir, stored, table

PER_FILE, FAN_BITS = 1000, 4
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
STOP = END.encode()
GZIP = b"\x1f\x8b\x08"
PIECE, STEP, LOOK = 1 << 20, 1 << 14, 512
WHOLE_FILE = 1 << 30


def _id(page_id: str, url: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(url), F.lit(""))).cast("binary"))


def file_of(files: int, page_id: str = "page_id", url: str = "url") -> Column:
    return F.pmod(F.conv(F.substring(_id(page_id, url), 1, 8), 16, 10).cast("long"), F.lit(files))


def record(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A resource record without its closing line ends."""
    u, body, m = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A"), F.coalesce(F.col(html), F.lit("")), _id(page_id, url)
    name = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), u,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    return F.concat(head, body)


def laid_out(records: DataFrame) -> DataFrame:
    """records: page_id, url, file, sha256, length. Adds seq and offset."""
    w = Window.partitionBy("file").orderBy("page_id", "url", "sha256")
    return records.withColumn("seq", F.row_number().over(w).cast("long") - 1).withColumn("offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def sealed_hash(rec: Column) -> Column:
    return F.sha2(F.concat(rec, F.lit(END)).cast("binary"), 256)


def _written(rows: DataFrame, path: str) -> None:
    """rows: (value, file), sorted by file inside each partition."""
    rows.write.partitionBy("file").option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_warc(pages: DataFrame, path: str, files: int) -> None:
    """One file for each file number."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), file_of(files).alias("file"), record().alias("value"))
    dealt = rows.withColumn("sha256", sealed_hash(F.col("value"))).repartition(files, "file").sortWithinPartitions("file", "page_id", "url", "sha256")
    _written(dealt.select("value", "file"), path)


Read = Callable[[int], bytes]
#: A packed byte range that can't be unpacked.
Lost = tuple[int, int]


def unpacked(read: Read, packed: bool = False) -> Iterator[bytes | Lost | None]:
    """A file's plain bytes in pieces: of gzip members one after the other, None before each, or as they are. A member is unpacked up to its damaged byte,
    bit by bit of what zlib still gives; the range from there to the next member that unpacks is told. (A wrong checksum after
    data that unpacked whole is no range: what it says shows in the records.)"""
    buf, at = read(PIECE), 0  # at: the packed place of buf
    if not packed and buf[:2] != GZIP[:2]:
        while buf:
            yield buf
            buf = read(PIECE)
        return
    while buf:
        one, back = zlib.decompressobj(31), b""
        yield None
        while not one.eof:
            buf = buf or read(PIECE)
            if not buf:
                yield at, at  # the file ends inside a member
                return
            piece, before = buf[:STEP], one.copy()
            try:
                out = one.decompress(piece)
            except zlib.error:
                good, k = [], 0
                for k in range(len(piece)):
                    try:
                        good.append(before.decompress(piece[k : k + 1]))
                    except zlib.error:
                        break
                yield b"".join(good)
                # a damaged end lets a member run into the next one, so that is looked for from before the fault
                fault, near = at + k, (back + buf)[1:]
                buf, at = next_member(near, at + len(buf) - len(near), read)
                if not buf or at - fault > 8:
                    yield fault, at
                break
            yield out
            used = len(piece) - len(one.unused_data)
            back = (back + buf[:used])[-STEP:]
            buf, at = buf[used:], at + used
        zeros = len(buf) - len(buf.lstrip(b"\0"))
        buf, at = buf[zeros:], at + zeros
        buf = buf or read(PIECE)


def next_member(buf: bytes, at: int, read: Read) -> tuple[bytes, int]:
    """Skip to where a gzip member begins and unpacks; an empty rest if there is none."""
    while True:
        if (k := buf.find(GZIP)) < 0:
            more = read(PIECE)
            if not more:
                return b"", at + len(buf)
            buf, at = buf[-2:] + more, at + max(0, len(buf) - 2)
            continue
        buf, at = buf[k:], at + k
        while len(buf) < LOOK and (more := read(PIECE)):
            buf += more
        try:
            if zlib.decompressobj(31).decompress(buf[:LOOK]) or len(buf) < LOOK:
                return buf, at
        except zlib.error:
            pass
        buf, at = buf[1:], at + 1


def cut_records(parts: Iterable[bytes | Lost | None]) -> Iterator[tuple[int, bytes, dict[bytes, bytes], int, Lost | None]]:
    """(offset, bytes, header fields, start of the payload in them, None) of records. A range that is no record has no fields; a lost
    range has no bytes, and no record goes across it, nor across the start of a member (None) that begins as a record does."""
    buf, base = bytearray(), 0

    def cut(last: bool) -> Iterator[tuple[int, bytes, dict[bytes, bytes], int, None]]:
        """What can be told from buf; unless it is the last of its stretch the end of buf is waited for."""
        nonlocal buf, base, need
        at = 0
        while at < len(buf):
            split = buf.find(STOP, at)
            lines = bytes(buf[at : split if split >= 0 else at + 5]).split(b"\r\n")
            begins = lines[0].startswith(b"WARC/") or b"WARC/".startswith(bytes(buf[at : at + 5]))
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])} if split >= 0 else {}
            size = fields.get(b"content-length", b"")
            end = split + 4 + int(size) + 4 if size.isdigit() and len(size) < 13 else -1
            if begins and not last and (split < 0 or end > len(buf)):
                need = max(end - at, len(buf) - at + PIECE)
                break
            if begins and lines[0].startswith(b"WARC/") and 0 <= end <= len(buf) and buf[end - 4 : end] == STOP:
                yield base + at, bytes(buf[at:end]), fields, split + 4 - at, None
            else:
                new = buf.find(STOP + b"WARC/", at)
                end = new + 4 if new >= 0 else len(buf)
                if new < 0 and not last:
                    need = len(buf) - at + PIECE
                    break
                yield base + at, bytes(buf[at:end]), {}, 0, None
            at = end
        buf, base = buf[at:], base + at

    need, member = 0, False
    for part in parts:
        if part is None:
            member = True
            continue
        if member and part:
            if isinstance(part, bytes) and part.startswith(b"WARC/"):
                yield from cut(True)
                need = 0
            member = False
        if isinstance(part, tuple):
            yield from cut(True)
            need = 0
            yield base, b"", {}, 0, part
            continue
        buf += part
        if len(buf) >= need:
            need = 0
            yield from cut(False)
    yield from cut(True)


RECORD = pa.schema([(c, t) for c, t in zip(("path", "seq", "offset", "length", "url", "record_id", "sha256", "before", "headers", "payload"), (pa.string(), *[pa.int64()] * 3, *[pa.string()] * 5, pa.binary()), strict=True)])


def records_of(name: str, read: Read) -> Iterator[pa.RecordBatch]:
    out, before, size = [], "", 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RECORD, strict=True)], schema=RECORD)
    for seq, (at, data, fields, body, lost) in enumerate(cut_records(unpacked(read, name.endswith(".gz")))):
        said = {k: fields[k].decode(errors="replace") if k in fields else None for k in (b"warc-target-uri", b"warc-record-id")}
        head = f"damaged gzip bytes {lost[0]}-{lost[1]}" if lost else data[: max(0, body - 4)].decode(errors="replace")
        sha = hashlib.sha256(head.encode() if lost else data).hexdigest()
        out.append((name, seq, at, len(data), *said.values(), sha, before, head, data[body:-4] if fields else data))
        before, size = sha, size + len(data)
        if len(out) >= 500 or size >= BATCH_BYTES:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def read_warc(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """path, seq, offset, length, url, record_id, sha256 of the whole range, before (that of the range before), headers, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, packed in zip(b.column("path"), b.column("content"), strict=True):
                yield from records_of(name.as_py(), io.BytesIO(packed.as_py()).read)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("path").to_pylist():
                files, at = fs.FileSystem.from_uri(name)
                with files.open_input_stream(at, compression=None) as f:
                    yield from records_of(name, f.read)

    schema = "path string, seq long, offset long, length long, url string, record_id string, sha256 string, before string, headers string, payload binary"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small, large = files.filter(F.col("length") < whole), files.filter(F.col("length") >= whole)
    out = small.select("path", "content").mapInArrow(run, schema)
    if large.select("path").isEmpty():
        return out
    return out.union(large.select("path").mapInArrow(stream, schema))


def ranges(records: DataFrame) -> DataFrame:
    """file, seq, offset, length, url, record_id, sha256, before of the records in files written by write_warc."""
    return records.select(F.regexp_extract("path", "file=(\\d+)", 1).cast("long").alias("file"), "seq", "offset", "length", "url", "record_id", "sha256", "before")


def tree(leaves: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """leaves: (id, hash). Returns levels + 1 tables (id, hash), the root's last. A node holds 2^FAN_BITS children at most."""
    out = [leaves]
    for _ in range(levels):
        up = out[-1].groupBy(F.shiftright("id", FAN_BITS).alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "hash"))).alias("c"))
        joined = F.array_join(F.transform("c", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["hash"])), ",")
        out.append(up.select("id", F.sha2(joined.cast("binary"), 256).alias("hash")))
    nodes = out[0].withColumn("level", F.lit(0))
    for k, up in enumerate(out[1:], 1):
        nodes = nodes.union(up.withColumn("level", F.lit(k)))
    nodes = stored(nodes, name)
    return [nodes.filter(F.col("level") == k).select("id", "hash") for k in range(levels + 1)]


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaf ids whose hashes differ or that one side lacks, with both hashes, stored."""
    wrong = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if wrong is not None:
            below = wrong.select(F.col("id").alias("up"))
            a, b = (x.join(below, F.shiftright(x.id, FAN_BITS) == F.col("up"), "left_semi") for x in (a, b))
        both = a.withColumnRenamed("hash", "ours").join(b.withColumnRenamed("hash", "theirs"), "id", "full")
        wrong = both.filter(~F.col("ours").eqNullSafe(F.col("theirs")))
    return stored(wrong, "merkle-differing")


def damage(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """ours, theirs: stored ranges() of two replicas. What differs: file, seq (ours; null if extra), status, replica_offset,
    replica_length, replica_url, replica_sha256."""
    top = ours.select("file", "seq").union(theirs.select("file", "seq")).agg(F.max("seq"), F.max("file")).first()
    bits = lambda n: FAN_BITS * max(1, -(-max(1, int(n or 0).bit_length()) // FAN_BITS))
    low, high = bits(top[0]), bits(top[1])
    name = F.shiftleft("file", low) + F.col("seq")
    leaf = lambda df: df.select(name.alias("id"), F.sha2(F.concat_ws(":", "offset", "length", "sha256").cast("binary"), 256).alias("hash"))
    levels = (low + high) // FAN_BITS
    wrong = differing(tree(leaf(ours), levels, "merkle-ours"), tree(leaf(theirs), levels, "merkle-theirs")).select("id")
    a = stored(ours.join(wrong, name == F.col("id"), "left_semi").select("file", "seq", "record_id", "sha256", "before"), "merkle-a")
    b = stored(theirs.join(wrong, name == F.col("id"), "left_semi").select("file", F.col("seq").alias("at"), "offset", "length", "url", "record_id", "sha256", "before"), "merkle-b")
    found = None
    for status, key in (("moved", "sha256"), ("corrupt", "record_id"), ("corrupt", "before")):
        # equal keys inside one file are paired in order
        nth = lambda df, by: df.filter(f"{key} is not null").withColumn("nth", F.row_number().over(Window.partitionBy("file", key).orderBy(by)))  # noqa: E731, B023
        met = nth(a, "seq").select("file", key, "nth", "seq").join(nth(b, "at").select("file", key, "nth", "at"), ["file", key, "nth"]).select("file", "seq", "at", F.lit(status).alias("status"))
        met = stored(met, f"merkle-{status}")
        found = met if found is None else found.union(met)
        a, b = a.join(met, ["file", "seq"], "left_anti"), b.join(met, ["file", "at"], "left_anti")
    left = a.select("file", "seq", F.lit(None).cast("long").alias("at"), F.lit("missing").alias("status")).union(b.select("file", F.lit(None).cast("long").alias("seq"), "at", F.lit("extra").alias("status")))
    told = theirs.select("file", F.col("seq").alias("at"), F.col("offset").alias("replica_offset"), F.col("length").alias("replica_length"), F.col("url").alias("replica_url"), F.col("sha256").alias("replica_sha256"))
    return stored(found.union(left), "merkle-found").join(told, ["file", "at"], "left").drop("at")


def audit(manifest: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """manifest: stored (file, seq, ...). Its rows, and rows of extra records, with status (intact or as above), replica_offset,
    replica_length, replica_url and replica_sha256 where the replica differs."""
    status = F.coalesce("status", F.lit("intact"))
    return manifest.join(damage(ours, theirs), ["file", "seq"], "full").withColumn("status", status)


ADDED = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:added>\r\nWARC-Target-URI: urn:added\r\nContent-Length: 5\r\n\r\nadded"


def write_damaged(spark: SparkSession, source: str, path: str) -> None:
    """A replica with faults at known places of each file: a changed letter, a changed first letter of a header; and in every eighth
    file, where what follows moves, a lost half of a record, a lost record and an added one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, seq, head, body in zip(*(b.column(c).to_pylist() for c in ("file", "seq", "headers", "payload")), strict=True):
                rec, k = head.encode() + STOP + body, seq % 97 if file % 8 == 0 else seq % 97 % 60
                if k == 71:
                    continue
                change = {13: lambda r: r[:10] + b"X" + r[11:], 29: lambda r: b"X" + r[1:], 61: lambda r: r.decode()[: len(r.decode()) // 2].encode()}
                out.append((file, seq, 0, change.get(k, bytes)(rec)))
                if k == 83:
                    out.append((file, seq, 1, ADDED.encode()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["file", "seq", "k", "value"])

    rows = read_warc(spark, source).select(F.regexp_extract("path", "file=(\\d+)", 1).cast("long").alias("file"), "seq", "headers", "payload").mapInArrow(run, "file long, seq long, k int, value binary")
    _written(rows.sortWithinPartitions("file", "seq", "k").select(F.col("value").cast("string"), "file"), path)


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), "html")
    files = -(-pages.count() // PER_FILE) or 1
    sealed = F.concat(record(), F.lit(END))
    rows = pages.select("page_id", "url", file_of(files).alias("file"), sealed_hash(record()).alias("sha256"), F.octet_length(sealed).cast("long").alias("length"))
    manifest = stored(laid_out(rows), "merkle-manifest")
    ours, theirs = (f"{shared_dir(spark)}/warc-{n}-{uuid.uuid4().hex}" for n in ("ours", "theirs"))
    write_warc(pages, ours, files)
    write_damaged(spark, ours, theirs)
    a, b = (stored(ranges(read_warc(spark, p)), "merkle-ranges") for p in (ours, theirs))
    found = audit(manifest, a, b)
    number = lambda c: F.coalesce(c, F.lit(-1)).alias(c)  # noqa: E731  -1: there is none
    return found.select(
        number("page_id"), F.coalesce("url", "replica_url").alias("url"), "file", number("seq"), number("offset"), number("length"), "sha256", "status", number("replica_offset"), number("replica_length"), "replica_sha256"
    )


#: What the faults of write_damaged() must give; the layout of the replica is derived here without an audit.
ORACLE = r"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 1000) AS BIGINT)) AS files FROM pages), e AS (SELECT chr(13) || chr(10) AS e),
p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(page_id::VARCHAR || ' ' || coalesce(url, '')) AS m FROM pages),
r AS (SELECT page_id, url, ('0x' || m[1:8])::BIGINT % files AS file, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' || e
  || 'WARC-Date: 2024-01-01T00:00:00Z' || e || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html)::VARCHAR || e || e || html AS r FROM p, e, n),
h AS (SELECT page_id, url, file, r, sha256(r || e || e) AS sha256, strlen(r || e || e)::BIGINT AS length FROM r, e),
ours AS (SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM h WINDOW w AS (PARTITION BY file ORDER BY page_id, url, sha256)),
k AS (SELECT *, CASE WHEN file % 8 = 0 THEN seq % 97 ELSE seq % 97 % 60 END AS k FROM ours),
items AS (SELECT file, seq, 0 AS nth, CASE k WHEN 13 THEN substring(r, 1, 10) || 'X' || substring(r, 12) WHEN 29 THEN 'X' || substring(r, 2) WHEN 61 THEN substring(r, 1, length(r) // 2) ELSE r END || e || e AS d FROM k, e WHERE k <> 71
  UNION ALL SELECT file, seq, 1, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:uuid:added>' || e || 'WARC-Target-URI: urn:added' || e || 'Content-Length: 5' || e || e || 'added' || e || e FROM k, e WHERE k = 83),
theirs AS (SELECT file, seq, nth, sha256(d) AS other, strlen(d)::BIGINT AS size, coalesce(sum(strlen(d)) OVER (PARTITION BY file ORDER BY seq, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM items)
SELECT page_id, url, file, seq, "offset", length, sha256, status, coalesce(CASE WHEN status <> 'intact' THEN place END, -1) AS replica_offset, coalesce(CASE WHEN status <> 'intact' THEN size END, -1) AS replica_length, CASE WHEN status <> 'intact' THEN other END AS replica_sha256
FROM (SELECT k.*, place, size, other, CASE WHEN other IS NULL THEN 'missing' WHEN other <> sha256 THEN 'corrupt' WHEN place <> "offset" THEN 'moved' ELSE 'intact' END AS status FROM k LEFT JOIN theirs ON k.file = theirs.file AND k.seq = theirs.seq AND nth = 0)
UNION ALL SELECT -1, 'urn:added', file, -1, -1, -1, NULL, 'extra', place, size, other FROM theirs WHERE nth = 1
"""
