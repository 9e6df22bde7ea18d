"""WARC writing and split reading with boundary-chain verification.

Writing goes through Spark's text sink with the record end as line separator, so it works on every file system Spark
writes to and survives lost tasks. Reading goes through Spark's text source
with the version line as line separator: each split yields the stretches between
magic lines, whose lengths give their places in the file. Every magic line is only a candidate. Each task links its
candidates to their successors, and hands on where its chains leave the split; pointer jumping
over those few joints from the start of each file finds the joints that are real, and only
candidates on the way from a real joint are records. Magic in a payload is on no such way.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import new_path, written

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Spans of more than one stretch up to which the list of them goes to every task; beyond, it is joined by shuffle.
SMALL = 20_000
BUCKET = 1 << 16
#: More digits are longer than any file.
_LENGTH = re.compile(r"0*([0-9]{1,17})")


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "payload") -> DataFrame:
    """(id, digest, refers_to) of the rows that revisit an earlier one: equal payloads of LEAST_REVISIT bytes or more, smallest id first."""
    digest = pages.select(F.col(id_col).alias("id"), F.sha2(payload_col, 256).alias("digest"), F.octet_length(payload_col).alias("size")).where(F.col("size") >= LEAST_REVISIT)
    first = digest.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return digest.join(first.select("digest", "refers_to"), "digest").where("id != refers_to").select("id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "payload") -> None:
    """Write a record for each row to WARC files under ``path``. payload is binary, null means empty.

    Of rows with equal id and payload none revisits another; a null id is written empty and its row is never a revisit. Control characters and spaces in an address are percent-encoded; a null
    address is empty. An empty table writes files without records. The payload isn't shuffled
    if the list of revisits is small enough to be broadcast by Spark's own size check.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    again = written(roles(rows, "id"), "roles").withColumnsRenamed({"id": "id_", "digest": "digest_"})
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(again, (F.col("id") == F.col("id_")) & (F.col("digest") == F.col("digest_")), "left")
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n")
    ).cast("binary")
    body = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    fields = F.concat(
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"),
    )
    record = rows.withColumn("body", body).select(F.concat(F.lit(MAGIC), fields.cast("binary"), F.col("body")).cast("string").alias("value"))
    record.write.option("lineSep", END.decode()).option("compression", "none").text(path)


def _header(stretch: bytes) -> tuple[dict[str, str], int] | None:
    """The named fields at the start of a stretch, and where the content begins; None if it's no record header."""
    end = stretch.find(END)
    if end < 0:
        return None
    fields = {}
    for line in stretch[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in fields or _number(fields.get("content-length", "")) is None:
        return None
    return fields, end + len(END)


def _number(digits: str) -> int | None:
    """A length that a file can have: ASCII digits of less than 2^63 by far."""
    found = _LENGTH.fullmatch(digits)
    return int(found[1]) if found else None


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, split, number in the split, place relative to the split's first stretch, stretch)."""
    key, seq, at = None, 0, 0
    for batch in batches:
        for value, file, split in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (file, split) != key:
                key, seq, at = (file, split), 0, 0
            stretch = value.as_py()
            yield file, split, seq, at, stretch
            seq, at = seq + 1, at + len(stretch) + len(MAGIC)


def _chains(place: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one split's candidates, in order of place, with their successors: where their chains leave the split, and first and last visit of the forest whose parents are successors.

    A successor stands after its candidate, so one loop up and one down do.
    """
    n = len(place)
    at = np.searchsorted(place, after)
    known = at < n
    known[known] = place[at[known]] == after[known]
    parent = array("q", np.where(known, at, -1).tobytes())
    size, enter, free, leaves = array("q", [1]) * n, array("q", bytes(8 * n)), array("q", bytes(8 * n)), array("q", after.astype(np.int64).tobytes())
    for i in range(n):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    clock = 1
    for i in range(n - 1, -1, -1):
        p = parent[i]
        if p < 0:
            enter[i] = clock
            clock += size[i]
        else:
            enter[i] = free[p]
            free[p] += size[i]
            leaves[i] = leaves[p]
        free[i] = enter[i] + 1
    first = np.frombuffer(enter, np.int64)
    return np.frombuffer(leaves, np.int64), first, first + np.frombuffer(size, np.int64) - 1


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a split's length; of kind 1: a candidate; of kind 2: a stretch that is more or less than a record's. Places are relative to the split.

    Of a split four numbers a stretch are held, and its chains' while they are made.
    """
    names = ["kind", "file", "split", "seq", "place", "next", "exit", "enter", "leave", "whole"]

    def flush(key: tuple[str, int], length: int, rows: list[array]) -> Iterator[pa.RecordBatch]:
        seq, place, after, whole = (np.frombuffer(r, np.int64) if len(r) else np.empty(0, np.int64) for r in rows)
        found = np.flatnonzero(after >= 0)
        chains = [np.zeros(len(seq), np.int64) for _ in range(3)]
        for out, values in zip(chains, _chains(place[found], after[found]), strict=True):
            out[found] = values
        columns = [np.where(after >= 0, 1, 2), seq, place, after, *chains, whole != 0]
        columns = [np.concatenate([[first], c]) for first, c in zip((0, 0, length, 0, 0, 0, 0, False), columns, strict=True)]
        for i in range(0, len(seq) + 1, 8192):
            kind, *numbers, full = (c[i : i + 8192] for c in columns)
            n = len(kind)
            yield pa.record_batch([pa.array(kind.astype(np.int32)), pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), *map(pa.array, numbers), pa.array(full.astype(bool))], names=names)

    key, length, rows = None, 0, [array("q") for _ in range(4)]
    for file, split, seq, at, stretch in _walk(batches):
        if (file, split) != key:
            if key:
                yield from flush(key, length, rows)
            key, rows = (file, split), [array("q") for _ in range(4)]
        length = at + len(stretch) + len(MAGIC)
        header = _header(stretch) if split or seq else None
        if header:
            size = header[1] + int(header[0]["content-length"]) + len(END)
            row = (seq, at, at + size + len(MAGIC), size == len(stretch))
        elif split or seq or stretch:
            row = (seq, at, -1, 0)
        else:
            continue
        for column, value in zip(rows, row, strict=True):
            column.append(value)
    if key:
        yield from flush(key, length, rows)


_CANDIDATES = "kind int, file string, split long, seq long, place long, next long, exit long, enter long, leave long, whole boolean"


def reachable(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates on the chain from their file's start, all stretches, and (file, split, base) where splits begin; places count from the file's start and follow the magic line."""
    raw = written(_stretches(spark, path).mapInArrow(_candidates, _CANDIDATES), "candidates")
    # Where each split's first stretch stands: a prefix sum over the splits of a file, a row for each.
    lengths = raw.where("kind = 0").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", F.col("place").alias("n")))).alias("s"))
    sums = F.aggregate("s", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.n)))
    bases = lengths.select("file", F.explode(F.arrays_zip("s", F.slice(sums, F.lit(1), F.size("s")).alias("base"))).alias("z")).select("file", "z.s.split", F.col("z.base").alias("base"))
    bases = written(bases, "bases")
    placed = raw.where("kind > 0").join(bases, ["file", "split"])
    for c in ("place", "next", "exit"):
        placed = placed.withColumn(c, F.col(c) + F.col("base"))
    placed = written(placed.drop("base"), "placed")
    candidates = placed.where("kind = 1")
    # Joints: candidates at which a file starts or another split's chain arrives.
    arrive = candidates.select("file", F.col("exit").alias("place")).distinct()
    start = bases.select("file").distinct().withColumn("place", F.lit(len(MAGIC)).cast("long"))
    joints = candidates.join(arrive.unionByName(start).distinct(), ["file", "place"], "left_semi")
    joints = written(joints.select("file", "place", "exit"), "joints")
    real, jump = start.join(joints.select("file", "place"), ["file", "place"], "left_semi"), joints
    while True:
        # After k rounds, what up to 2^k jumps reach is real, and a jump is 2^k long.
        there = real.join(jump, ["file", "place"]).select("file", F.col("exit").alias("place")).join(joints.select("file", "place"), ["file", "place"], "left_semi")
        more = written(real.unionByName(there).distinct(), "real")
        if more.count() == real.count():
            break
        real = more
        onward = jump.select("file", F.col("place").alias("exit"), F.col("exit").alias("exit_"))
        jump = written(jump.join(onward, ["file", "exit"]).select("file", "place", F.col("exit_").alias("exit")), "jump")
    entries = candidates.join(real, ["file", "place"], "left_semi").select("file", "split", F.col("enter").alias("at"))
    # A split is entered once; on the way from its entry are the entry's ancestors in the split's forest.
    on = candidates.join(entries, ["file", "split"]).where("enter <= at and at <= leave")
    return on.drop("at", "kind"), placed, bases


_FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "digest", "http_length", "payload", "digest_ok"]
_KINDS = [*[pa.string()] * 5, pa.int64(), pa.binary(), pa.bool_()]
_COLUMNS = "record_type string, record_id string, refers_to string, target_uri string, digest string, http_length long, payload binary, digest_ok boolean"


def _fields(stretch: bytes, header: tuple[dict[str, str], int]) -> tuple:
    """The columns _FIELDS of a record; a response's payload is what follows the HTTP header."""
    fields, begin = header
    head, _, payload = stretch[begin : begin + int(fields["content-length"])].partition(END)
    length = next((int(x.split(b":")[1]) for x in head.lower().split(b"\r\n") if re.fullmatch(rb"content-length:\s*0*\d{1,17}", x)), 0)
    digest, kind = fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields["warc-type"]
    sound = kind == "revisit" or hashlib.sha256(payload).hexdigest() == digest
    return kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest, length, payload if kind == "response" else None, sound


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows that begin with a size in bytes, as batches of about 4 MB without it."""
    held, some = 0, []
    for size, *row in rows:
        some.append(row)
        held += size
        if held > 4 << 20 or len(some) == 4096:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)
            held, some = 0, []
    if some:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches that are just a record, with its fields."""

    def rows() -> Iterator[tuple]:
        for file, split, seq, at, stretch in _walk(batches):
            header = _header(stretch) if split or seq else None
            if header and header[1] + int(header[0]["content-length"]) + len(END) == len(stretch):
                yield len(stretch), file, split, seq, at, *_fields(stretch, header)

    return _batched(rows(), ["file", "split", "seq", "at", *_FIELDS], [pa.string(), pa.int64(), pa.int64(), pa.int64(), *_KINDS])


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((len(stretch), file, split, seq, stretch) for file, split, seq, _, stretch in _walk(batches))
    return _batched(rows, ["file", "split", "seq", "stretch"], [pa.string(), pa.int64(), pa.int64(), pa.binary()])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for file, place, stretch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                record = stretch.as_py()
                yield len(record), file, place - len(MAGIC), *_fields(record, _header(record))

    return _batched(rows(), ["file", "offset", *_FIELDS], [pa.string(), pa.int64(), *_KINDS])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record_type, record_id, refers_to, target_uri, digest, http_length, payload, digest_ok) of every record under ``path``.

    The payload of a revisit is null; digest and http_length are those of the full payload, from its own header.
    A file that doesn't begin with a record has none; what follows a broken record is dropped, as no chain
    leads there; an archive without records gives no rows. Records whose
    payload holds magic lines are put together from their stretches.
    """
    on, placed, bases = reachable(spark, path)
    on = written(on, "records")
    key = ["file", "split", "seq"]
    records = _stretches(spark, path).mapInArrow(_records, f"file string, split long, seq long, at long, {_COLUMNS}").join(bases, ["file", "split"])
    # Nearly every stretch is a record. The others, listed, are those off the chain and those of records in several stretches.
    whole = on.where("whole").select(*key)
    # Paths compress so well that a file's size says little of what a broadcast would hold.
    listed = written(placed.select(*key, "place").join(whole.hint("merge"), key, "left_anti"), "listed")
    if small := listed.count() <= SMALL:
        single = records.join(F.broadcast(listed.select(*key)), key, "left_anti")
    else:
        single = records.join(whole, key, "left_semi")
    single = single.select("file", (F.col("at") + F.col("base") - len(MAGIC)).alias("offset"), *_FIELDS)
    # The listed stretches from a record's place to its successor's are that record's; both are met in buckets of places.
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    spans = on.where("not whole").select("file", F.col("place").alias("from"), F.col("next").alias("to"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket("from"), bucket("to"))))
    inside = listed.withColumn("bucket", bucket("place")).join(spans, ["file", "bucket"]).where("place >= `from` and place < `to`").select(*key, "place", "from")
    inside = written(inside, "inside")
    if inside.isEmpty():
        return single
    parts = _stretches(spark, path).mapInArrow(_raw, "file string, split long, seq long, stretch binary").join(F.broadcast(inside) if small else inside, key)
    magic = F.when(F.col("place") == F.col("from"), F.lit(b"")).otherwise(F.lit(MAGIC))
    several = parts.select("file", "from", F.struct("place", F.concat(magic, "stretch").alias("b")).alias("p")).groupBy("file", "from").agg(F.array_sort(F.collect_list("p")).alias("p"))
    several = several.select("file", F.col("from").alias("place"), F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x.b)).alias("stretch"))
    return single.unionByName(several.mapInArrow(_parse, f"file string, offset long, {_COLUMNS}"))


def archive(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read its records back (see write_warc and read_warc).

    Null and empty html is an empty payload, a null address an empty one, a null id a record without number; repeated rows
    each have a record; an empty table gives no rows; other columns aren't written.
    """
    path = new_path(spark, "warc")
    write_warc(pages.withColumn(html_col, F.col(html_col).cast("string").cast("binary")), path, id_col, url_col, html_col)
    return read_warc(spark, path)


#: The query's rows for DuckDB.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND head <> page_id THEN head END AS refers_to
FROM d
"""
