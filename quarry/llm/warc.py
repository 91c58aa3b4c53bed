"""Content-addressed WARC archive.

``pack`` keeps two tables: *payloads*, each distinct payload once under its SHA-256 (with its length),
and *records*, the exact header bytes of every record with the digest of its payload.  ``records_of``
reconstructs the original records by a join; ``write_warc`` and ``read_warc`` put them into WARC files
and parse such files, one record in memory at a time; ``read_files`` does so for all files and says
what each page's record holds.

Of records with equal payloads of at least ``min_bytes`` the one with the largest page_id is the
response; the others are revisits that refer to it.

Layout.  The store is bucketed by (digest, page_id of the record that brought the payload).  Payloads
are shuffled once, into that layout; when records are rebuilt, the scan already has the partitioning
of the join, so only headers move, and a task writes its records into one WARC file.

Only digests are shuffled to find the responses (an aggregate with map-side combine, so a payload
shared by a third of all pages is one row a task).  Pages that share a payload differ in page_id, so no
key of the payload shuffle is hot; small payloads that are all responses are spread by a salt, and so
are revisits, with the payload or response copied to each salt.

Defined cases: null html is an empty payload (equal empty payloads are linked like others when
min_bytes is 0); a payload of any length is one record; null url is written as an empty target;
repeated page_ids are kept as records of their own (equal ids with equal payloads: one of the rows is
the response); a null page_id never wins, and records that no page_id could be referred to by are all
responses; no pages give empty tables and no files; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"
SALTS = 32
NOBODY = -(1 << 63)  # stands for a null page_id in keys


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header(page_id, url: str | None, size: int, sha1: str, refers_to=None) -> bytes:
    """WARC header block of a page's record, up to and with the empty line."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + http


def parse(head: bytes) -> dict[str, str]:
    """Named fields of a header block."""
    first, *lines = head.split(CRLF * 2, 1)[0].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)


def _digested(pages: DataFrame) -> DataFrame:
    """page_id, url, html as bytes, and its digests; all three in the JVM."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("payload"), F.unhex(F.sha2(html, 256)).alias("digest"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("size"))


def pack(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write the payload store and the record table under ``folder``."""
    spark = pages.sparkSession
    folder = common.run_location(spark, folder)
    own = _digested(pages)
    key = F.when(F.col("size") >= min_bytes, F.col("digest"))
    brief = common.materialize(own.select("page_id", "url", "sha1", "size", "digest", key.alias("shared")).withColumn("uid", F.monotonically_increasing_id()), "warc-pages")

    # One row a digest: the record that is the response, and proof that equal digests are equal payloads.
    best = brief.groupBy("digest").agg(
        F.max(F.struct("page_id", "uid")).alias("best"),
        F.count("*").alias("n"), F.min("size").alias("s0"), F.max("size").alias("s1"), F.min("sha1").alias("h0"), F.max("sha1").alias("h1"),
    )
    proven = best.withColumn("proof", F.when((F.col("s0") != F.col("s1")) | (F.col("h0") != F.col("h1")), F.raise_error(F.lit("two payloads share a digest"))).otherwise(F.lit(True)))
    winners = common.materialize(proven.where("proof").select("n", F.col("digest").alias("d"), F.col("best.page_id").alias("winner"), F.col("best.uid").alias("winner_uid")), "warc-winners")

    salted = winners.where("n > 1").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = brief.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    linked = dealt.join(salted, (dealt["digest"] == salted["d"]) & (dealt["salt"] == salted["salt"]), "left")
    # ``alone``: a response that is not the one whose payload is stored.
    linked = linked.withColumn("wins", F.col("d").isNull() | (F.col("uid") == F.col("winner_uid")))
    linked = linked.withColumn("revisit", ~F.col("wins") & F.col("shared").isNotNull() & F.col("winner").isNotNull()).withColumn("alone", ~F.col("wins") & ~F.col("revisit"))
    linked = linked.select("page_id", "url", "sha1", "size", "digest", F.when(F.col("revisit"), F.col("winner")).alias("refers_to"), "revisit", "alone")

    def heads(batch):
        out = [header(p, u, n, base64.b32encode(bytes.fromhex(h)).decode(), r if v else None) for p, u, n, h, r, v in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "size", "sha1", "refers_to", "revisit")))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("digest"), pa.array(out, pa.binary()), batch.column("revisit"), batch.column("alone")], ["page_id", "digest", "header", "revisit", "alone"])

    with common.frugal(spark):
        common.map_arrow(linked, heads, "page_id bigint, digest binary, header binary, revisit boolean, alone boolean").write.parquet(f"{folder}/records")

    # The payload of each digest once: that of its winner, found by (digest, page_id), so no hot key.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = winners.select(F.col("d").alias("digest"), F.coalesce("winner", F.lit(NOBODY)).alias("giver"))
    chosen = own.withColumn("giver", F.coalesce("page_id", F.lit(NOBODY))).select("digest", "giver", "size", "payload").join(named, ["digest", "giver"])
    once = chosen.dropDuplicates(["digest", "giver"])
    name = f"warc_{uuid.uuid4().hex}"
    with common.frugal(spark):
        once.write.option("compression", "zstd").option("path", f"{folder}/payloads").bucketBy(buckets, "digest", "giver").format("parquet").saveAsTable(name)
    spark.sql(f"drop table {name}")  # its files stay
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/layout")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """digest, giver, size, sha1 (hex) and payload of the store; a payload that doesn't have its digest is an error.

    The scan knows its buckets, so a join on (digest, giver) leaves it where it is.
    """
    folder = common.run_location(spark, folder, make=False)
    buckets, name = spark.read.parquet(f"{folder}/layout").first().buckets, f"warc_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
    spark.sql(f"create table if not exists {name} (digest binary, giver bigint, size bigint, payload binary) using parquet clustered by (digest, giver) into {buckets} buckets location '{folder}/payloads'")
    whole = (F.unhex(F.sha2("payload", 256)) == F.col("digest")) & (F.octet_length("payload") == F.col("size"))
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), F.hex("digest"))).cast("binary")
    return spark.table(name).withColumn("payload", F.when(whole, F.col("payload")).otherwise(damaged)).select("digest", "giver", "size", F.sha1("payload").alias("sha1"), "payload")


def records_of(spark: SparkSession, folder: str) -> DataFrame:
    """page_id and the exact bytes of each record as it would stand alone in an archive.

    Headers of the records whose payloads are stored join the store where it lies; revisits need no
    payload; responses that repeat a payload (small ones, or of pages without an id) may be any share
    of all rows, so they are dealt by a salt and their payloads are copied to the salts.
    """
    records = spark.read.parquet(f"{folder}/records").withColumn("giver", F.coalesce("page_id", F.lit(NOBODY)))
    stored = payloads(spark, folder)
    end = F.lit(CRLF * 2)
    first = records.where("not revisit and not alone").join(stored.select("digest", "giver", "payload"), ["digest", "giver"]).select("page_id", F.concat("header", "payload", end).alias("record"))
    rest = records.where("revisit").select("page_id", F.concat("header", end).alias("record"))
    alone = records.where("alone").withColumn("salt", F.pmod(F.xxhash64("page_id", "header", F.rand(7)), F.lit(SALTS)).cast("int"))
    if not alone.isEmpty():
        copied = stored.select("digest", "payload").join(alone.select("digest").distinct(), "digest", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rest = rest.unionByName(alone.join(copied, ["digest", "salt"]).select("page_id", F.concat("header", "payload", end).alias("record")))
    return first.unionByName(rest)


def write_warc(spark: SparkSession, folder: str, target: str, packed: bool = False) -> DataFrame:
    """Reconstructed records in WARC files under ``target``, a file a task; returns path and number of records of each file.

    ``packed``: a gzip member a record, as .warc.gz files have it.
    """
    target = common.run_location(spark, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, fs_path = TaskContext.get(), common.shared_fs(target)
        fs, base = fs_path
        own, count, out = f"{base}/.{context.partitionId():06d}-{context.taskAttemptId()}", 0, None
        for batch in batches:
            for record in batch.column("record").to_pylist():
                out = out or fs.open_output_stream(own)
                out.write(gzip.compress(record, 1, mtime=0) if packed else record)
                count += 1
        if out is None:
            return
        out.close()
        path = f"part-{context.partitionId():06d}.warc{'.gz' if packed else ''}"
        fs.move(own, f"{base}/{path}")
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    return common.materialize(records_of(spark, folder).select("record").mapInArrow(common.trimmed(run), "path string, records bigint"), "warc-files")


def read_warc(source) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, HTTP header, payload) of each record of a WARC file, given as bytes or as a binary file object."""
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    while line := source.readline():
        head = [line]
        while head[-1] != CRLF:
            if not (line := source.readline()):
                raise ValueError("a record's header is cut off")
            head.append(line)
        fields = parse(b"".join(head))
        block = source.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or source.read(4) != CRLF * 2:
            raise ValueError(f"record {fields['WARC-Record-ID']} is cut off or its length is wrong")
        http, _, payload = block.partition(CRLF * 2)
        yield fields, http, payload


def read_files(spark: SparkSession, target: str, files: DataFrame) -> DataFrame:
    """Per page what its record in the WARC files says: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests of responses are those of the payload bytes in the file, and those of revisits
    must be the ones of the response they refer to; anything else is an error.  Revisits of one
    response may be any share of all rows, so they are dealt by a salt.
    """
    target = common.run_location(spark, target, make=False)
    listed = files.select("path", "records").collect()  # one row a file
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not listed:
        return spark.createDataFrame([], schema)

    def row(fields: dict[str, str], payload: bytes) -> tuple:
        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        refers = fields.get("X-Refers-To-Page")
        if fields["WARC-Type"] == "response":
            if len(payload) != size or sha1_base32(payload) != digest:
                raise ValueError(f"record {fields['WARC-Record-ID']} doesn't fit its payload")
        elif payload or fields["WARC-Refers-To"] != record_id(refers):
            raise ValueError(f"record {fields['WARC-Record-ID']} is no revisit")
        return int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, size, digest, fields["WARC-Type"], int(refers) if refers else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.shared_fs(target)
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, count = [], 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as raw:
                    plain = io.BufferedReader(raw, 1 << 20)
                    for fields, _, payload in read_warc(gzip.GzipFile(fileobj=plain) if path.endswith(".gz") else plain):
                        rows.append(row(fields, payload))
                        count += 1
                        if len(rows) == 4096:
                            yield batch_of(rows)
                            rows = []
                if count != records:
                    raise ValueError(f"{path} has {count} records, not {records}")
                if rows:
                    yield batch_of(rows)

    spread = spark.createDataFrame([(r.path, r.records) for r in listed], "path string, records bigint").repartition(len(listed))
    said = common.materialize(spread.mapInArrow(common.trimmed(run), schema), "warc-said")
    again = said.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    there = said.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("found"))
    keys = ["refers_to", "payload_digest"]
    there = there.join(again.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)
    there = there.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = again.join(there, [*keys, "salt"], "left")
    sized = F.when(F.col("found") == F.col("payload_bytes"), F.col("found")).otherwise(F.raise_error(F.lit("a revisit without its response")).cast("long"))
    return said.where("record_type = 'response'").unionByName(held.withColumn("payload_bytes", sized).select(*names))
