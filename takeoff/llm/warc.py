"""WARC archives: written from pages, read back from any store Spark reads, and assembled to one nested row a capture.

Writing. A page is a request, a response and a metadata record that name the response in WARC-Concurrent-To. Of the pages with
one payload of at least `minimum` bytes, that with the smallest page_id is the response, each other one a revisit without the
payload. Spark's text writer puts the records out, its line separator being the record's end, so files are as large as tasks.

Reading. The text source cuts files at each line that begins with "WARC/1.", in splits where the file isn't compressed. A cut
inside a payload shows as a record with fewer bytes than its Content-Length; only the files that have one are gone through in
order, by lengths alone, and the cut records joined again. What stands outside of a record is passed over. Bytes stay as they are.

Assembly. Records that name each other in WARC-Concurrent-To, in either direction or over other records, belong to one capture.
A record that reaches no response, revisit or resource is a capture of its own.

Null html: empty payload. A null page_id comes after all others and has no metadata field; a null url has no target. Repeated rows
are records of their own, one of them at most a response. An empty table gives empty archives, and those no rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff.llm.common import documents, few, shared_folder, shipped, staged

END, DELIMITER = "\r\n\r\n", "\nWARC/1."
HEADS = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
CHAIN_ROUNDS = 64


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each ten hex digits are eight digits of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# Writing


def record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), *(p.alias(f"p{i}") for i, p in enumerate(parts)))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def target(url: Column) -> Column:
    """A url that fits in one header line: blanks and control characters as %XX."""
    plain = url
    for code in [*range(33), 127]:
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), plain).otherwise(url)


def record(kind: Column, rid: Column, date: str, block: Column, content_type: str, *fields: tuple[str, Column]) -> Column:
    """Header and block; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in (
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(date)), *fields, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string")))]
    return F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("\r\n"), block)


def write(pages: DataFrame, folder: str, minimum: int = 0, compression: str = "gzip", date: str = DATE) -> None:
    """Archives of the pages (page_id, url, html) in a new folder."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256))).withColumn("bytes", F.octet_length("html"))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    slim = rows.where(F.col("bytes") >= minimum).groupBy("page_id", "url", "key", "bytes", base32_sha1(F.col("html")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    copied = staged(slim.groupBy("key").agg(F.min(place).alias("first"), F.sum("n").alias("total"), F.first("digest").alias("digest"), F.first("bytes").alias("bytes")).where("total > 1"), "copied")
    known = few(copied)
    none = F.lit(None).cast("string")
    # responses: payloads that one page has; of the others one page and one copy of the payload; small ones each by itself
    large = rows.where(F.col("bytes") >= minimum)
    alone = large.join(few(copied.select("key")), "key", "left_anti").select("page_id", "url", "html", "bytes", base32_sha1(F.col("html")).alias("digest"), F.lit(0).alias("k"))
    payloads = large.join(few(copied.select("key")), "key", "left_semi").groupBy("key").agg(F.first("html").alias("html"))
    firsts = payloads.join(copied, "key").select("first.page_id", "first.url", "html", "bytes", "digest", F.lit(0).alias("k"))
    small = rows.where(F.col("bytes") < minimum).groupBy("page_id", "url", "html", "bytes").agg(F.count(F.lit(1)).alias("n"))
    small = small.select("page_id", "url", "html", "bytes", base32_sha1(F.col("html")).alias("digest"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    responses = alone.union(firsts).union(small).withColumns({"first_id": none, "first_url": none})
    again = slim.join(known.select("key", "first"), "key").withColumn("from", F.when(place.eqNullSafe(F.col("first")), 1).otherwise(0))
    again = again.where(F.col("n") > F.col("from")).withColumn("k", F.explode(F.sequence(F.col("from"), F.col("n").cast("int") - 1)))
    revisits = again.select("page_id", "url", none.alias("html"), "bytes", "digest", "k", record_id("response", F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(0)).alias("first_id"),
                            F.col("first.url").alias("first_url"))
    pool = responses.union(revisits)

    revisit, uri = F.col("first_id").isNotNull(), target(F.col("url"))
    own = [F.col("page_id"), F.col("url"), F.col("digest"), F.col("k")]
    rid = record_id("response", *own)
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")))
    host, path = F.regexp_extract(uri, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.regexp_extract(uri, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    about = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    uri_field, with_response = ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid)
    out = pool.select(F.explode(F.array(
        record(F.lit("request"), record_id("request", *own), date, asked, "application/http;msgtype=request", uri_field, with_response),
        record(F.when(revisit, "revisit").otherwise("response"), rid, date, answer, "application/http;msgtype=response", uri_field,
               ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
               ("WARC-Refers-To", F.col("first_id")), ("WARC-Refers-To-Target-URI", F.when(revisit, target(F.col("first_url")))), ("WARC-Refers-To-Date", F.when(revisit, F.lit(date)))),
        record(F.lit("metadata"), record_id("metadata", *own), date, about, "application/warc-fields", uri_field, with_response),
    )).alias("value"))
    out.write.option("lineSep", END).option("compression", compression).text(folder)


# Reading


def whole_records(chunks: DataFrame) -> DataFrame:
    """Of (file, start, place, bytes, have, declared), the texts of whole records of files in which a payload was cut: (bytes).

    Lengths alone are gone through, in the order of each file; the parts of a record are put together by their number.
    """
    shipped(chunks.sparkSession)
    kept = staged(chunks, "cut")
    mark = len(DELIMITER)

    def walk(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "place", "have", "declared", "size")), strict=True))
        owners, parts, missing, number = [], [], 0, 0
        owner = None
        for start, place, have, declared, size in rows:
            if missing > 0:
                number += 1
                missing -= mark + size
            else:
                owner, number, missing = (start, place), 0, max(0, (declared or 0) - (have or 0)) if have is not None else 0
            owners.append(owner)
            parts.append(number)
        file = table.column("file")[0].as_py()
        return pa.table({"file": pa.array([file] * len(rows)), "start": pa.array([r[0] for r in rows], pa.int64()), "place": pa.array([r[1] for r in rows], pa.int64()), "owner_start": pa.array([o[0] for o in owners], pa.int64()),
                         "owner_place": pa.array([o[1] for o in owners], pa.int64()), "part": pa.array(parts, pa.int32())})

    lengths = kept.select("file", "start", "place", F.col("have").cast("long").alias("have"), F.col("declared").cast("long").alias("declared"), F.octet_length("bytes").cast("long").alias("size"))
    owned = lengths.groupBy("file").applyInArrow(walk, "file string, start bigint, place bigint, owner_start bigint, owner_place bigint, part int")
    parted = kept.select("file", "start", "place", "bytes").join(owned, ["file", "start", "place"])
    lead = F.unhex(F.lit(DELIMITER.encode().hex()))
    piece = F.when(F.col("part") == 0, F.col("bytes")).otherwise(F.concat(lead, F.col("bytes")))
    joined = parted.groupBy("file", "owner_start", "owner_place").agg(F.array_sort(F.collect_list(F.struct("part", piece.alias("piece")))).alias("p"))
    return joined.select(F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["piece"])).alias("bytes"))


def header_length(data: Column) -> Column:
    """Bytes of a record's header without its blank line; null where there is none."""
    text = data.cast("string")
    return F.when(F.locate(END, text) > 0, F.octet_length(F.substring_index(text, END, 1)))


def value_of(header: Column, name: str) -> Column:
    """First value of a header field; null without it."""
    found = F.regexp_extract(header, rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def after(data: Column, start: Column, length: Column | None = None) -> Column:
    return F.substring(data, start + 1, length if length is not None else F.octet_length(data))


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives: record_id, type, uri, date, content_type, concurrent (ids), refers_to, stated_digest, header, block (bytes), payload (bytes)."""
    chunks = spark.read.option("lineSep", DELIMITER).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("bytes"))
    length = header_length(F.col("bytes"))
    head = F.substring_index(F.col("bytes").cast("string"), END, 1)
    declared = F.expr("try_cast(_d AS bigint)")
    sized = chunks.withColumns({"_h": length, "_d": F.when(length.isNotNull(), value_of(head, "Content-Length"))})
    sized = sized.select("file", "start", "place", "bytes", (F.octet_length("bytes") - F.col("_h") - len(END)).alias("have"), declared.alias("declared"))
    cut = staged(sized.where("have < declared").select("file").distinct(), "cut_files")
    if cut.isEmpty():
        texts = sized.select("bytes")
    else:
        known = few(cut)
        texts = sized.join(known, "file", "left_anti").select("bytes").union(whole_records(sized.join(known, "file", "left_semi")))
    text = F.col("bytes").cast("string")
    parsed = texts.where(header_length(F.col("bytes")).isNotNull()).select("bytes", F.substring_index(text, END, 1).alias("header"))
    parsed = parsed.where(F.regexp_replace("header", r"^WARC/1\.", "").rlike(r"^\d+\r?\n"))
    size = F.expr("try_cast(_d AS int)")
    parsed = parsed.withColumn("_d", value_of(F.col("header"), "Content-Length"))
    at = F.octet_length("header") + len(END)
    # without a length: up to the record's end
    block = F.when(size.isNotNull(), after(F.col("bytes"), at, size)).otherwise(after(F.col("bytes"), at))
    ids = F.transform(F.regexp_extract_all("header", F.lit(r"(?i)\nWARC-Concurrent-To:[ \t]*([^\r\n]*)"), 1), F.rtrim)
    field = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "refers_to": "WARC-Refers-To", "stated_digest": "WARC-Payload-Digest"}
    rows = parsed.select(*[value_of(F.col("header"), f).alias(c) for c, f in field.items()], ids.alias("concurrent"), "header", block.alias("block"))
    http_end = header_length(F.col("block"))
    payload = F.when(F.col("content_type").startswith("application/http") & http_end.isNotNull(), after(F.col("block"), http_end + len(END))).otherwise(F.col("block"))
    return rows.withColumns({"type": F.lower("type"), "payload": payload})


# Assembly


def owners(rows: DataFrame) -> DataFrame:
    """(record_id, capture) of the records that aren't heads of captures: the heads that WARC-Concurrent-To leads to, over any number of others."""
    heads = rows.where(F.col("type").isin(*HEADS)).select(F.col("record_id").alias("capture")).distinct()
    named = rows.select("record_id", F.explode("concurrent").alias("other")).where("record_id <> other")
    links = staged(named.union(named.select("other", "record_id")).distinct(), "links")
    others = rows.where(~F.col("type").isin(*HEADS)).select("record_id").distinct()
    known = staged(links.join(heads, links["other"] == heads["capture"]).select("record_id", "capture").join(others, "record_id", "left_semi"), "owned")
    found, rest = known, staged(others.join(known.select("record_id"), "record_id", "left_anti"), "rest")
    for _ in range(CHAIN_ROUNDS):
        if rest.isEmpty():
            break
        more = staged(links.join(rest, "record_id", "left_semi").join(known.select(F.col("record_id").alias("other"), "capture"), "other").select("record_id", "capture").distinct(), "owned")
        if more.isEmpty():
            break  # what is left reaches no head
        found, known, rest = found.union(more), more, staged(rest.join(more.select("record_id"), "record_id", "left_anti"), "rest")
    else:
        raise RuntimeError(f"records are linked over more than {CHAIN_ROUNDS} others")
    return found


def captures(rows: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, head (struct; null if no response claims the records), requests, metadata and others (arrays of structs).

    The structs have all columns of the records; leave out what isn't needed, payloads above all, and pass a staged table.
    """
    owned = owners(rows)
    inner = F.struct("record_id", *[c for c in rows.columns if c != "record_id"])
    bound = rows.where(~F.col("type").isin(*HEADS)).select("record_id", inner.alias("r")).join(owned, "record_id", "left")
    kind = lambda *t: F.sort_array(F.collect_list(F.when(F.col("r.type").isin(*t), F.col("r"))))
    apart = F.sort_array(F.collect_list(F.when(~F.col("r.type").isin("request", "metadata"), F.col("r"))))
    by = bound.withColumn("capture_id", F.coalesce("capture", "record_id")).groupBy("capture_id").agg(
        kind("request").alias("requests"), kind("metadata").alias("metadata"), apart.alias("others"), F.max(F.col("capture").isNull()).alias("lost"))
    heads = rows.where(F.col("type").isin(*HEADS)).select(F.col("record_id").alias("capture_id"), F.struct(*rows.columns).alias("head"))
    whole = heads.join(by.where("not lost").drop("lost"), "capture_id", "left")
    lost = by.where("lost").select("capture_id", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "requests", "metadata", "others")
    empty = F.array().cast(by.schema["requests"].dataType)
    return whole.select("capture_id", "head", *[F.coalesce(c, empty).alias(c) for c in ("requests", "metadata", "others")]).union(lost)


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """page_id (of the metadata record), payload_bytes, payload_digest, record_type and refers_to of each capture in archives that `write` made."""
    head = F.col("type").isin(*HEADS)
    slim = records(spark, path).select("record_id", "type", "concurrent", "refers_to", F.when(head, F.octet_length("payload")).cast("long").alias("bytes"),
                                       F.when(head, base32_sha1(F.col("payload"))).alias("digest"), F.when(~head, F.col("payload")).alias("payload"))
    caps = captures(staged(slim, "records")).where("head is not null")
    about = F.get("metadata", F.lit(0))["payload"].cast("string")
    page = F.expr("try_cast(_page AS bigint)")
    found = caps.select("capture_id", F.col("head.type").alias("record_type"), F.col("head.refers_to").alias("first"), "head.bytes", "head.digest", F.regexp_extract(about, r"(?m)^page_id: (-?\d+)", 1).alias("_page"))
    found = staged(found.select("capture_id", "record_type", "first", "bytes", "digest", page.alias("page_id")), "captures")
    firsts = found.where("record_type = 'response'").select(F.col("capture_id").alias("first"), F.col("bytes").alias("_b"), F.col("digest").alias("_d"), F.col("page_id").alias("refers_to"))
    revisit = F.col("record_type") == "revisit"
    return found.join(firsts, "first", "left").select("page_id", F.when(revisit, F.col("_b")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("_d")).otherwise(F.col("digest")).alias("payload_digest"),
                                                      "record_type", "refers_to")


def op12_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir, "pages"), path)
    return page_captures(spark, path)
