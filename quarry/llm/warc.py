"""WARC archives, index first: records are found by offset and length and read in coalesced, sorted ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import bound_batches, heavy_join, materialise, new_path, release
from quarry.llm.store import Reader, Writer, make_folder

#: Bytes of an archive that a task reads together.
PART = 4 << 20
INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def one_line(value: str | None) -> str:
    return "".join(c if c.isprintable() else "%" + c.encode().hex().upper() for c in value or "")


def record(kind: str, page_id: int | None, url: str | None, digest: str, block: bytes, more: list[str] | None = None) -> bytes:
    """One record as a gzip member of its own."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {one_line(url)}", "WARC-Date: 2000-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", *(more or []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + out.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields of a record (names in lower case) and its block."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def write(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write a record for each page into archives in the shared folder; returns their index (INDEX).

    Of pages with equal payloads of at least `smallest` bytes, the one with the
    largest page_id becomes a response and the others revisit it. Which one
    that is is found on digests alone; only then are the bodies of responses,
    compressed, joined to it by page_id and digest. Equal rows of one page_id
    give one record each. A page without an id is a response, and none refers to it.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    html = F.coalesce("html", F.lit(""))
    light = pages.select("page_id", "url", F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).cast("long").alias("payload_bytes"))
    light = materialise(light, "page-digests")
    best = light.where((F.col("payload_bytes") >= smallest) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("pages"))
    best = materialise(best, "page-best")
    linked = heavy_join(light, best, ["sha1"], "pages", "left").drop("pages")
    response = F.col("page_id").isNull() | (F.col("payload_bytes") < smallest) | F.coalesce(F.col("refers_to") == F.col("page_id"), F.lit(True))
    linked = materialise(linked.withColumn("response", response), "page-links")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, text in zip(batch["page_id"], batch["url"], batch["html"]):
                payload = (text or "").encode()
                digest = hashlib.sha1(payload)
                out.append((page_id, digest.hexdigest(), record("response", None if pd.isna(page_id) else int(page_id), url, base32_digest(digest.hexdigest()), http_head(len(payload)) + payload)))
            yield pd.DataFrame(out, columns=["page_id", "sha1", "record"]).astype({"page_id": "Int64"})

    bodies = pages.select("page_id", "url", "html").mapInPandas(packed, "page_id long, sha1 string, record binary")
    wanted = linked.where("response").groupBy(F.col("page_id").alias("id"), "sha1").agg(F.max("url").alias("url"))
    responses = bodies.join(wanted.withColumnRenamed("sha1", "digest"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("digest"))).select("page_id", "url", "sha1", F.lit(0).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"), "record")
    revisits = linked.where("not response").select("page_id", "url", "sha1", "payload_bytes", "refers_to", F.lit(None).cast("binary").alias("record"))
    folder = make_folder(new_path(spark, "archives"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"  # another name for each attempt; the index names those that count
        out = None
        for batch in batches:
            rows = []
            for page_id, url, sha1, n, to, data in batch.itertuples(index=False, name=None):
                out = out or Writer(path)
                digest, page_id = base32_digest(sha1), None if pd.isna(page_id) else int(page_id)
                if data is None:
                    data = record("revisit", page_id, url, digest, http_head(n), [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(int(to))}"])
                rows.append((page_id, url, path, *out.add(data), digest))
            yield pd.DataFrame(rows, columns=["page_id", "url", "archive", "offset", "length", "payload_digest"]).astype({"page_id": "Int64"})
        if out:
            out.close()

    index = materialise(responses.unionByName(revisits).mapInPandas(archive, INDEX), "index")
    release(light, best, linked)
    return index


def read(index: DataFrame) -> DataFrame:
    """Read the records that an index (or a part of it) names.

    Columns: page_id, url, record_type, refers_to, payload_digest (of what was
    read; a revisit's from its header), payload_bytes (a revisit's from its
    HTTP header), payload (null for revisits). Each archive's records are
    sorted by offset and read in coalesced ranges, in parts of PART bytes, as
    many tasks as the records' bytes need.
    """
    part = F.floor(F.col("offset") / F.lit(PART))
    n = -(-(index.agg(F.sum("length")).first()[0] or 1) // PART)
    dealt = index.select("archive", "offset", "length").repartition(n, "archive", part).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            for path, group in batch.groupby("archive", sort=False):
                rows, held = [], 0
                for _, data in reader.read(path, list(zip(group["offset"].tolist(), group["length"].tolist()))):
                    fields, block = parse(data)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, to = fields["warc-type"], fields.get("warc-refers-to")
                    number = lambda x: None if x is None or x.endswith(":None>") else int(x.strip("<>").rpartition(":")[2])
                    if kind == "revisit":
                        digest, n, payload = fields["warc-payload-digest"].partition(":")[2], int(head.rpartition(b":")[2]), None
                    else:
                        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        if f"sha1:{digest}" != fields["warc-payload-digest"]:
                            raise ValueError(f"{path}: a payload doesn't have its digest")
                    rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], kind, number(to), digest, n, payload))
                    held += len(data)
                    if held > 8 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)
        reader.close()

    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return dealt.mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def archived(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write pages as WARC records and read all of them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; empty payloads are equal payloads. A null
    page_id is archived as a response. Repeated rows are archived once each;
    other columns are ignored. An empty table gives no rows.
    """
    return read(write(pages, smallest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
