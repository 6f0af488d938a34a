"""WARC archives inside ZIP packages: written by every task, read back by byte ranges.

A package holds a stored member `archive/data.warc.gz` (each record a gzip member of its own),
a stored index `indexes/index.tsv` (a fixed-width line for each record: offset and length in
the archive member) and `datapackage.json`. Packages go to the shared folder through a file
system found from its address (file, hdfs, s3, ...). Every attempt of a task writes names of its
own, and only packages listed in the manifest, itself a written table, are ever read; so lost
executors and repeated tasks leave no double records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from barlake.llm.text import slices, tune
from barlake.llm.zipped import Writer, members
from barlake.session import scratch_path, written

ARCHIVE, INDEX, LINE = "archive/data.warc.gz", "indexes/index.tsv", 32
RECORDS_PER_READ = 512


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to) -> bytes:
    """One WARC record. A revisit carries no payload, but the digest and length of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")),
            ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(refers_to))]
        block = http
    else:
        block = http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; the payload is what follows the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _writing(folder: str):
    def run(batches):
        out = None
        for batch in slices(batches, "html"):
            if out is None:  # an empty task writes nothing
                system, base = _file_system(folder)
                path = f"{base}/part-{uuid.uuid4().hex}.zip"
                stream = system.open_output_stream(path)
                out, index = Writer(stream), []
                out.begin(ARCHIVE)
                at = 0
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                payload = html.encode()
                packed = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packed.compress(record(page, url, payload, digest(payload), refers)) + packed.flush()
                out.write(data)
                index.append((at, len(data)))
                at += len(data)
        if out is not None:
            out.end()
            out.begin(INDEX)
            for a, n in index:
                out.write(f"{a:>18}\t{n:>12}\n".encode())
            out.end()
            out.begin("datapackage.json")
            out.write(json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}], "records": len(index)}).encode())
            out.end()
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([out.at], pa.int64()), pa.array([len(index)], pa.int64())],
                                             names=["name", "size", "records"])
    return run


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0) -> DataFrame:
    """Writes a record for every page and returns the manifest ``name, size, records``.

    Of pages with equal payloads of ``least_bytes`` or more, the one of the smallest id is a
    response, the others are revisits that refer to it; a null payload is empty. Payloads are
    grouped by SHA-1 and length; a frequent payload is reduced to its smallest id before it is
    shuffled, and its pages are a skewed key of an equi-join, which adaptive execution splits.
    Defined cases: a page that repeats an id with an equal payload is a response each time, as
    is a page without id; a null URL is written empty; other columns are ignored; empty tables
    write no package.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sha = src.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    first = (sha.where(F.col("n") >= least_bytes).groupBy("sha", "n")
             .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", "n", "first"))
    joined = sha.join(first, ["sha", "n"], "left").select("page_id", "url", "html", F.expr("if(first < page_id, first, null)").alias("refers_to"))
    return written(joined.mapInArrow(_writing(folder), "name string, size bigint, records bigint"), "warc-manifest")


def _reader(system, path):
    source = system.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)
    return source, read


def _locating(folder: str):
    """(name, size) of packages -> runs of records: byte range of the archive and index lines."""
    def run(batches):
        system, base = _file_system(folder)
        for batch in batches:
            for name, size in zip(batch.column("name").to_pylist(), batch.column("size").to_pylist()):
                source, read = _reader(system, f"{base}/{name}")
                found = members(read, size)
                archive, (at, length) = found[ARCHIVE], found[INDEX]
                source.close()
                firsts = list(range(0, length // LINE, RECORDS_PER_READ))
                yield pa.RecordBatch.from_pydict({
                    "name": [name] * len(firsts), "archive": [archive[0]] * len(firsts), "index": [at + f * LINE for f in firsts],
                    "records": [min(RECORDS_PER_READ, length // LINE - f) for f in firsts]},
                    schema=pa.schema([("name", pa.string()), ("archive", pa.int64()), ("index", pa.int64()), ("records", pa.int64())]))
    return run


def _reading(folder: str, max_bytes: int = 4 << 20):
    def run(batches):
        system, base = _file_system(folder)
        for batch in batches:
            for run_ in batch.to_pylist():
                source, read = _reader(system, f"{base}/{run_['name']}")
                lines = read(run_["index"], run_["records"] * LINE)
                places = [tuple(map(int, lines[i:i + LINE].split(b"\t"))) for i in range(0, len(lines), LINE)]
                rows, size = [], 0
                for at, n in places:
                    fields, block = parse(zlib.decompress(read(run_["archive"] + at, n), 31))
                    payload = block.partition(b"\r\n\r\n")[2]
                    response = fields["WARC-Type"] == "response"
                    rows.append({"page_id": fields["X-Page-Id"] or None, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
                                 "payload": payload if response else None, "payload_bytes": len(payload) if response else int(fields["X-Payload-Length"]),
                                 "payload_digest": digest(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                                 "refers_to": fields.get("WARC-Refers-To-Page")})
                    size += len(payload)
                    if size > max_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=READ)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=READ)
                source.close()
    return run


READ = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                  ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the packages, without extracting them: ``page_id, url, record_type,
    payload, payload_bytes, payload_digest, refers_to`` (ids as text). Directories and indexes
    are parsed first; the runs of records they name are dealt out and read by byte range, so a
    large package is read by many tasks."""
    runs = manifest.repartition("name").mapInArrow(_locating(folder), "name string, archive bigint, index bigint, records bigint")
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(tasks, F.col("name"), F.col("index"))
    return dealt.mapInArrow(_reading(folder), "page_id string, url string, record_type string, payload binary, payload_bytes bigint, "
                                              "payload_digest string, refers_to string")


def package_folder(spark: SparkSession) -> str:
    """A new folder for packages in the shared folder, made on the driver."""
    tune(spark)
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex[:12]}")
    system, base = _file_system(folder)
    system.create_dir(base, recursive=True)
    return folder
