"""WARC archives: a native writer, and a reader that verifies the chain of record boundaries.

Writer: records are text built by DataFrame expressions and written by Spark's text writer with
CRLF as line end, so executors write archives to any file system that Spark knows.

Reader: Spark's text source cuts archives at the magic, and large archives into splits, so no task
holds an archive; sums over a file's splits give every piece its offset. A piece with a header is a
candidate record whose Content-Length gives the offset of its successor, whichever task has that.
Candidates from all tasks form links (file, offset) -> successor; pointer jumping from offset 0 keeps
those that the chain reaches. A magic inside a payload is never reached. Payloads stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import fresh_path, written

VERSION = "WARC/1.1"
#: Where archives are cut. No beginning of it is also its end, so a reader that meets it across two
#: buffers can't miss it.
CUT = "\nWARC/1."
MAGIC_BYTES = len(CUT) - 1
BLANK = "\r\n\r\n"
PLACE = ["path", "split", "within"]
FIELDS = ["record_type", "record_id", "target_uri", "refers_to", "declared_digest"]
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column, from built-in functions.

    Five hexadecimal digits are 20 bits, so four base-32 digits.
    """
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with payload, payload_digest, payload_bytes, record_type and refers_to.

    Of pages with equal payloads of at least ``min_bytes``, the largest page_id is the response;
    pages that repeat that very page_id are responses too. Only digests that occur more than once
    are joined back. They are written first, so Spark knows their size: below its broadcast
    threshold the pages are not shuffled, beyond it a sort-merge join takes over.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.withColumns({"payload": payload, "payload_digest": base32_sha1(payload), "payload_bytes": F.octet_length(payload).cast("long")})
    repeated = pages.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    repeated = written(repeated.where("n > 1 and kept is not null").select(F.col("payload_digest").alias("digest"), "kept"), "warc-repeated")
    out = pages.join(repeated, pages.payload_digest == repeated.digest, "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return out.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("kept"))}).drop("digest", "kept")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 8192) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) as archives under ``path``, with
    at most ``records_per_file`` records each.

    Defined results: a null html is an empty payload, a null url an empty target, a null page_id
    an empty identifier; line ends within a url are dropped so that no header can be forged;
    columns of other names are ignored.
    """
    marked = mark_revisits(pages.select("page_id", "url", "html"), min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.coalesce(F.col("html"), F.lit(""))))
    revisit = F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "")
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(is_revisit, revisit).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    )
    # A record ends with two CRLF; the writer's line end is the second.
    marked.select(record.alias("value")).write.options(lineSep="\r\n", maxRecordsPerFile=records_per_file).text(path)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping.

    After round k the reached set holds the chain's first 2**k records and ``jump`` leads 2**k
    records ahead, so log2(records) rounds settle a file.
    """
    n = len(offsets)
    order = np.argsort(offsets, kind="stable")
    sorted_offsets = offsets[order]
    place = np.searchsorted(sorted_offsets, successors[order])
    hit = np.minimum(place, max(n - 1, 0))
    jump = np.where((place < n) & (sorted_offsets[hit] == successors[order]), hit, n)
    jump = np.append(jump, n)  # n: past the last record
    reached = np.zeros(n + 1, bool)
    reached[:n] = sorted_offsets == 0
    while True:
        ahead = jump[np.flatnonzero(reached)]
        grown = reached.copy()
        grown[ahead] = True
        grown[n] = False
        if (grown == reached).all():
            break
        reached, jump = grown, jump[jump]
    out = np.zeros(n, bool)
    out[order] = reached[:n]
    return out


@F.pandas_udf(T.LongType())
def _within(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Where each piece starts within its split: the text source keeps a split's order."""
    last, at = None, 0
    for path, split, size in batches:
        out = np.empty(len(size), np.int64)
        keys = list(zip(path, split, strict=True))
        changed = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
        sums = np.concatenate([[0], np.cumsum(size.to_numpy())])
        for lo, hi in zip([0, *changed], [*changed, len(keys)], strict=True):
            if lo in changed:
                at = 0
            out[lo:hi] = at + sums[lo:hi] - sums[lo]
            at += int(sums[hi] - sums[lo])
        last = keys[-1] if keys else last
        yield pd.Series(out)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(head, f"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))


def _payload(body: Column, is_http: Column) -> Column:
    """What follows the HTTP header of a block, or the block itself."""
    text = body.cast("string")
    http = F.octet_length(F.substring_index(text, BLANK, 1)) + 5
    return F.when(is_http & (F.instr(text, BLANK) > 0), body.substr(http, F.octet_length(body))).otherwise(body)


def _described(rows: DataFrame) -> DataFrame:
    """``rows`` (body, record_type, is_http, declared_digest) with payload, payload_digest and
    payload_bytes: of the payload, for revisits as their headers tell."""
    http_length = _field(F.substring_index(F.concat(F.lit("\r\n"), F.col("body").cast("string")), BLANK, 1), "content-length")
    revisit = F.col("record_type") == "revisit"
    rows = rows.withColumn("payload", _payload(F.col("body"), F.col("is_http")))
    return rows.withColumns({
        "payload_digest": F.when(revisit, F.col("declared_digest")).otherwise(base32_sha1(F.col("payload"))),
        "payload_bytes": F.when(revisit, F.when(F.col("is_http"), http_length.try_cast("long"))).otherwise(F.octet_length("payload").cast("long")),
    })


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between magics: place, value, whether a record can begin here (``length`` is then
    the block's, else null), ``body_at`` from the magic's end, and the header's fields.

    A piece that holds its record to the end has its ``body``.
    """
    raw = spark.read.option("lineSep", CUT).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"))
    within = _within.asNondeterministic()(F.xxhash64("path"), "split", F.octet_length("value").cast("long") + len(CUT))
    raw = raw.withColumn("within", within)
    first = (F.col("split") == 0) & (F.col("within") == 0)
    begins = ~first | F.col("value").startswith(CUT[1:])
    text = F.when(first, F.expr(f"substring(value, {MAGIC_BYTES + 1})")).otherwise(F.col("value"))
    raw = raw.withColumn("text", text)
    # The cut took the last byte of a header that ends where the next magic begins.
    whole = F.concat("text", F.lit("\n"))
    head = F.substring_index(whole, BLANK, 1)
    length = F.regexp_extract(F.concat(head, F.lit("\r\n")), r"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", 1).try_cast("long")
    ok = begins & whole.rlike(r"^[01]\r\n") & (F.instr(whole, BLANK) > 0)
    out = raw.withColumns({
        "length": F.when(ok, length), "body_at": F.octet_length(head).cast("long") + len(BLANK), "clean": F.col("value").endswith(BLANK[:-1]),
        "size": F.octet_length("value").cast("long"), "record_type": F.coalesce(_field(head, "warc-type"), F.lit("")), "record_id": _field(head, "warc-record-id"),
        "target_uri": _field(head, "warc-target-uri"), "refers_to": _field(head, "warc-refers-to"), "declared_digest": F.regexp_replace(_field(head, "warc-payload-digest"), "^sha1:", ""),
        "is_http": F.coalesce(_field(head, "content-type").startswith("application/http"), F.lit(False)),
    })
    full = F.col("body_at") + F.col("length") + len(BLANK) - 1 <= F.octet_length("text")
    body = F.col("text").cast("binary").substr((F.col("body_at") + 1).cast("int"), F.col("length").cast("int"))
    return out.withColumn("body", F.when(full, body))


CHAIN = "path string, split long, within long, offset long, successor long, seq long, n_pieces long"


def verified(bare: DataFrame) -> DataFrame:
    """The pieces that the boundary chain of their file covers: place, the record's offset and
    successor, and the piece's number within it. Only offsets are gathered, a file's in one task."""

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["split", "within"])
        start = group["start"].to_numpy()
        offset = np.where(start == 0, 0, start - MAGIC_BYTES)
        length = group["length"].to_numpy(float)
        clean = np.concatenate([[True], group["clean"].to_numpy()[:-1]])
        successor = np.where(np.isnan(length), -1, offset + MAGIC_BYTES + group["body_at"].to_numpy() + np.nan_to_num(length).astype(np.int64) + len(BLANK))
        end = int(group["file_size"].iloc[0])
        ends = np.isin(successor, offset[clean]) | (successor == end)
        good = clean & (successor > offset) & ends
        kept = np.zeros(len(offset), bool)
        kept[good] = reachable(offset[good], successor[good])
        heads = np.flatnonzero(kept)
        if not len(heads):
            return pd.DataFrame(columns=[c.split()[0] for c in CHAIN.split(", ")])
        own = heads[np.maximum(np.searchsorted(heads, np.arange(len(offset)), "right") - 1, 0)]
        inside = (offset >= offset[own]) & (offset < successor[own])
        out = group.loc[:, PLACE].assign(offset=offset[own], successor=successor[own], seq=np.arange(len(offset)) - own)[inside]
        return out.assign(n_pieces=out.groupby("offset")["seq"].transform("size"))

    held = bare.groupBy("path", "split").agg(F.sum(F.col("size") + len(CUT)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("path", "split", F.coalesce(before, F.lit(0)).alias("base"))
    links = bare.join(base, ["path", "split"]).select(*PLACE, (F.col("base") + F.col("within")).alias("start"), "length", "body_at", "clean", "file_size")
    return written(links.groupBy("path").applyInPandas(verify, CHAIN), "warc-chain")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path`` that the boundary chain reaches: path, offset,
    successor, record_type, record_id, target_uri, refers_to, declared_digest, payload_digest,
    payload_bytes and payload.

    payload_digest and payload_bytes are computed from the stored payload, for revisits taken from
    the record's headers; payload is null unless asked for. An empty file has no record; a file
    whose chain breaks (a record cut short, or whose end is neither a record nor the file's) yields
    the records before the break. Archives of any size are read by splits; a record must fit a row.
    """
    found = _described(pieces(spark, path))
    described = ["payload_digest", "payload_bytes"]
    bare = written(found.select(*PLACE, "file_size", "length", "body_at", "clean", "size", *FIELDS, "is_http", *described), "warc-pieces")
    chain = verified(bare)
    heads = chain.where("seq = 0").drop("seq")
    columns = ["path", "offset", "successor", *FIELDS, *described, "payload"]
    some = found.select(*PLACE, "payload") if with_payload else bare.select(*PLACE).withColumn("payload", F.lit(None).cast("binary"))
    out = heads.where("n_pieces = 1").join(bare, PLACE).join(some, PLACE).select(*columns)
    # Records whose payload holds magics are in several pieces: only these are put together.
    many = chain.where("n_pieces > 1")
    if many.isEmpty():
        return out
    parts = pieces(spark, path).select(*PLACE, "text", "value").join(many, PLACE)
    parts = parts.select("path", "offset", "successor", F.struct("seq", F.when(F.col("seq") == 0, F.col("text")).otherwise(F.col("value")).alias("x")).alias("p"))
    joined = parts.groupBy("path", "offset", "successor").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), CUT).alias("record"))
    joined = joined.join(heads.where("n_pieces > 1").select("path", "offset", "split", "within"), ["path", "offset"]).join(bare.drop(*described), PLACE)
    body = F.col("record").cast("binary").substr((F.col("body_at") + 1).cast("int"), F.col("length").cast("int"))
    joined = _described(joined.withColumn("body", body))
    return out.unionByName(joined.withColumn("payload", F.col("payload") if with_payload else F.lit(None).cast("binary")).select(*columns))


def round_trip(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` as archives to the shared folder and read the records back, with page_id
    and, for revisits, the page_id that they refer to."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    records = read_warc(spark, path, with_payload)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1).try_cast("long")
    return records.withColumns({"page_id": page("record_id"), "refers_to": page("refers_to")})
