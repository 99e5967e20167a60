"""WARC archives of page captures, and their transactions assembled again.

`write_archives` writes three records a page through Spark's text writer: the
request, the response (or a revisit without payload, if another page is the
response for equal payloads) and metadata, the first and the last concurrent to
the second. A file is one gzip stream of a task, so no archive passes the
driver and any folder that Spark writes to will do.

`read_records` reads archives through Spark's text reader, which cuts at the
mark between records and streams a file in one task (a gzip stream cannot be
split). A cut may also fall inside a payload that holds such a mark: pieces are
put together again by the records' own lengths, so memory is bounded by a
record and any payload comes back byte by byte.

`assemble` joins request and metadata records to the response or revisit that
their concurrent-to identifier names and returns one nested row for each
capture. Identifiers are unique, so no key is hot; payloads need not travel.

Of equal payloads of at least `least` bytes the largest page id is the
response; rows that repeat this id are responses, too, and a null id revisits
any other. Equality is decided by SHA-256 and counted with partial sums; the
pages of a payload that a third of all rows share look it up in a broadcast.
Null html is an empty payload, a null url leaves its header out, line breaks in
urls are percent-encoded. Identifiers of repeated or null page ids carry a
number after the id. A table without rows gives an archive without records and
an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_scan, cut, spread_join, stored

#: Fixed values of the format.
VERSION, BREAK, END = "WARC/1.1", "\r\n", "\r\n\r\n"
BETWEEN = END + VERSION + BREAK
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, RADIX32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORD = "type string, id string, concurrent_to string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, http string, fields map<string,string>"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 20 bits are five digits in hexadecimal and four in base 32."""
    sha = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(sha, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5))), RADIX32, BASE32)


# --- writing -------------------------------------------------------------------


def _record(kind: Column | str, headers: dict[str, Column], block: Column) -> Column:
    """A record as one string, without the mark that ends it; headers of a null value are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(f"{VERSION}{BREAK}WARC-Type: "), kind, F.lit(BREAK)]
    for name, value in headers.items():
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(BREAK)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _urn(name: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:page:"), name, F.lit(f":{kind}>"))


def with_verdicts(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(_id, _url, _html, _keep, _name): the response's id for pages that revisit it, else null; _name is the id, with a number if it is repeated."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), html.alias("_html"))
    rows = rows.withColumn("_same", F.unhex(F.sha2("_html", 256)))
    groups = rows.where(F.octet_length("_html") >= least).groupBy("_same").agg(F.max("_id").alias("_most"), F.count("*").alias("_n"))
    groups = cut(groups.where("_n > 1 and _most is not null"))
    again = cut(rows.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1 and _id is not null").withColumn("_again", F.lit(True)))
    rows = spread_join(rows, groups.select("_same", "_most"), ["_same"], counts=groups.select("_same", "_n"))
    rows = spread_join(rows, again.select("_id", "_again"), ["_id"], counts=again.select("_id", "_n"))
    number = F.when(F.col("_id").isNull() | F.col("_again"), F.concat(F.lit("."), F.monotonically_increasing_id().cast("string"))).otherwise("")
    name = F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), number)
    keep = F.when(~F.col("_most").eqNullSafe(F.col("_id")), F.col("_most"))
    return rows.select("_id", "_url", "_html", keep.alias("_keep"), name.alias("_name"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes request, response or revisit, and metadata records of every row to gzip archives in the folder `path`."""
    rows = with_verdicts(pages, least, id_col, url_col, html_col)
    url = F.replace(F.replace(F.col("_url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    host, target = F.regexp_extract(url, r"^[^/?#]*://([^/?#]*)", 1), F.regexp_extract(url, r"^[^/?#]*://[^/?#]*([^#]*)", 1)
    asked = F.coalesce(F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(END)), F.lit(f"GET / HTTP/1.1{END}"))
    size = F.octet_length("_html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), size, F.lit(END))
    again, of_response = F.col("_keep").isNotNull(), _urn(F.col("_name"), "response")
    common = {"WARC-Target-URI": url, "WARC-Date": F.lit(date)}
    answer = {
        "WARC-Record-ID": of_response,
        **common,
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), base32_sha1(F.col("_html"))),
        "WARC-Profile": F.when(again, SAME_PAYLOAD),
        "WARC-Refers-To": F.when(again, _urn(F.col("_keep").cast("string"), "response")),
        "Content-Type": F.lit("application/http; msgtype=response"),
    }
    notes = F.concat(F.lit("page-id: "), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(BREAK))
    records = [
        _record("request", {"WARC-Record-ID": _urn(F.col("_name"), "request"), "WARC-Concurrent-To": of_response, **common, "Content-Type": F.lit("application/http; msgtype=request")}, asked),
        _record(F.when(again, "revisit").otherwise("response"), answer, F.concat(http, F.when(again, "").otherwise(F.col("_html")))),
        _record("metadata", {"WARC-Record-ID": _urn(F.col("_name"), "metadata"), "WARC-Concurrent-To": of_response, **common, "Content-Type": F.lit("application/warc-fields")}, notes),
    ]
    rows.select(F.explode(F.array(*records)).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


# --- reading -------------------------------------------------------------------


class _Stream:
    """Records of one archive from the pieces between marks, in their order."""

    def __init__(self):
        self.held = bytearray()
        self.open = False

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(headers, block) of each record that the piece ends."""
        if self.open:
            self.held += BETWEEN.encode() + piece
        else:
            self.held = bytearray(piece.removeprefix((VERSION + BREAK).encode()))
        self.open = bool(self.held.strip())
        while self.open:
            at = self.held.find(END.encode())
            if at < 0:
                return
            start = at + len(END)
            end = start + _length(self.held[:at])
            if len(self.held) < end:
                return
            yield bytes(self.held[:at]), bytes(self.held[start:end])
            rest = self.held[end:]
            self.open = rest.startswith(BETWEEN.encode())
            if not self.open and rest.strip():
                raise ValueError("a record is longer than its Content-Length")
            self.held = rest[len(BETWEEN) :]

    def close(self) -> None:
        if self.open:
            raise ValueError("an archive ends within a record")


def _length(headers: bytes) -> int:
    return int(_fields(headers).get("content-length", "0"))


def _fields(headers: bytes) -> dict[str, str]:
    lines = (x.partition(b":") for x in headers.split(BREAK.encode()))
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, colon, v in lines if colon}


def _bare(uri: str | None) -> str | None:
    return uri.strip("<>") if uri else None


def parsed(headers: bytes, block: bytes, with_payload: bool) -> tuple:
    """The values of RECORD, and the payload if asked for."""
    h = _fields(headers)
    kind, payload, http, fields, size, digest, ok = h.get("warc-type"), None, None, None, None, None, None
    if kind in ("request", "response", "revisit"):
        head, _, payload = block.partition(END.encode())
        http = head.decode("utf-8", "replace")
    elif kind == "metadata":
        fields = list(_fields(block).items())
    told = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ok = told is None or told == digest
    elif kind == "revisit":  # of the payload that it leaves out
        size, digest, payload = int(_fields(block).get("content-length", "0")), told, None
    row = (kind, _bare(h.get("warc-record-id")), _bare(h.get("warc-concurrent-to")), h.get("warc-target-uri"), h.get("warc-date"), _bare(h.get("warc-refers-to")), digest, size, ok, http, fields)
    return (*row, payload if kind == "response" else None) if with_payload else row


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of gzip archives under `path`, with columns RECORD and, if asked for, the payload of responses."""
    pieces = spark.read.option("lineSep", BETWEEN).text(path)
    pieces = pieces.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    kinds = [("type", pa.string()), *((x, pa.string()) for x in ("id", "concurrent_to", "uri", "date", "refers_to", "payload_digest"))]
    kinds += [("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("http", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]
    kinds += [("payload", pa.binary())] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream = None, _Stream()
        for b in batches:
            out = []
            for of, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if of != file:
                    stream.close()
                    file, stream = of, _Stream()
                out += (parsed(*r, with_payload) for r in stream.feed(piece))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
        stream.close()

    return arrow_scan(pieces, run, RECORD + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """(id, response, request, metadata): one row for each response or revisit, with the request and metadata records concurrent to it, null where there are none.

    The records are read once and stored.
    """
    records = stored(records)
    part = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("id"), F.struct("id", "uri", "date", "http", "fields").alias(kind))
    answers = records.where(F.col("type").isin("response", "revisit")).select("id", F.struct(*(c for c in records.columns if c not in ("id", "concurrent_to", "fields"))).alias("response"))
    return answers.join(part("request"), "id", "left").join(part("metadata"), "id", "left")


def captures(assembled: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled transactions of pages."""
    return assembled.select(
        F.col("metadata.fields").getItem("page-id").try_cast("long").alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"^urn:page:(-?\d+)", 1).try_cast("long").alias("refers_to"),
    )


#: Base32 digits come from five bits each of the hexadecimal digest.
ORACLE = f"""
    with p as materialized (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
    r as (select *, max(page_id) over (partition by html) as most from p),
    digit as (select unnest(range(32)) as j),
    d as (select sha, string_agg(substr('{BASE32}', ((('0x' || sha[5 * (j // 4) + 1:5 * (j // 4) + 5])::bigint >> (15 - 5 * (j % 4))) & 31)::int + 1, 1), '' order by j) as digest
          from (select distinct sha from p), digit group by sha)
    select page_id, octet_length(encode(html))::bigint as payload_bytes, digest as payload_digest,
           case when page_id is distinct from most and most is not null then 'revisit' else 'response' end as record_type,
           case when page_id is distinct from most then most end as refers_to
    from r join d using (sha)"""
