"""WARC archives (1.0 and 1.1, plain or gzip): writing with revisit records, and reading by boundary-chain verification.

Writing and reading are Spark's own text source with a record separator, so archives lie wherever Spark can write, commit
like any other output and are read in splits. A file is cut at each occurrence of the record magic, also of one inside a
payload. Cut offsets follow from the lengths of the pieces; each piece that reads as a record header is a candidate, with the
offset where its successor must begin. From the start of the file only the chain of true records can be followed:

* candidates whose successor is the next candidate form runs, within which nothing is in doubt;
* pointers from run to run are jumped, doubling their reach each round, and only what is reachable from offset 0 stays.

So magic inside payloads falls away, and those payloads are put together again from their pieces. Pieces are stored once, with their
numbers, so that a lost executor cannot number them anew between two passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small, stored

#: What stands before the last digit of a record's version, and how a version goes on.
MAGIC, VERSION, END = "WARC/1.", "0\r\n", "\r\n\r\n"
#: Payloads shorter than this are always written whole.
REVISIT_BYTES = 1000
#: Tasks that rows of one digest are dealt over where the list of repeated payloads is too long to broadcast.
SALTS = 64
DATE = "1970-01-01T00:00:00Z"


def _headers(kind: Column, key: Column, uri: Column, digest: Column, size: Column, refers: Column) -> Column:
    """The record's header after the magic, with the empty line; a fixed date, so that equal input gives equal files."""
    clean = F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    name = F.coalesce(key.cast("string"), F.lit("none"))
    lines = [
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("WARC-Payload-Length: "), size.cast("string")),
        F.when(refers.isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END))


def write(pages: DataFrame, path: str, *, files: int | None = None) -> None:
    """page_id, url, html (null: empty payload) to uncompressed archives under path, a record for each row.

    Of the rows with equal payloads of REVISIT_BYTES and more the one with the largest page_id is a response, and the others
    revisit it. Rows that share that page_id too are all responses, as is any row without page_id.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    long_ = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("refers"), F.count("*").alias("n"))
    repeated = stored(long_.where("n > 1 and refers is not null").drop("n"), "repeated")
    few = small(repeated)
    if few is repeated:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        out = rows.join(repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "size", "salt"], "left")
    else:
        out = rows.join(few, ["digest", "size"], "left")
    refers = F.when(F.col("page_id") != F.col("refers"), F.col("refers"))
    kind = F.when(refers.isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    record = F.concat(F.lit(MAGIC + VERSION), _headers(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), refers), F.when(refers.isNotNull(), F.lit("")).otherwise(F.col("payload")))
    text = out.select(record.alias("value"))
    (text.repartition(files) if files else text).write.option("lineSep", END).text(path)


def _field(header: Column, name: str, pattern: str) -> Column:
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*{pattern}[ \t]*(?:\r\n|$)", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between occurrences of the magic: file, offset (of the magic before it), value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    return stored(raw, "pieces", compact=True)


def boundaries(pieces: DataFrame) -> DataFrame:
    """Narrow rows of all pieces: file, nth, offset, next piece's offset, and for candidates the header's length and successor."""
    header = F.substring_index("value", END, 1)
    head = F.octet_length(header) + len(END)
    ends = (F.octet_length("value") >= head) & F.col("value").rlike(r"^[0-9]\r\n")
    length = F.when(ends, _field(header, "Content-Length", r"(\d{1,18})")).cast("long")
    rows = pieces.select("file", "block", "nth", F.octet_length("value").cast("long").alias("n"), F.when(length.isNotNull(), head.cast("long")).alias("head"), length.alias("length"))
    w = Window.partitionBy("file").orderBy("block", "nth")
    # The first piece of a file is what stands before its first magic; each further one follows a magic.
    start = F.sum(F.col("n") + len(MAGIC)).over(w) - F.col("n") - 2 * len(MAGIC)
    out = rows.withColumn("offset", start).withColumn("to", F.col("offset") + len(MAGIC) + F.col("n"))
    return out.withColumn("successor", F.when(F.col("offset") >= 0, F.col("offset") + len(MAGIC) + F.col("head") + F.col("length") + len(END))).drop("block", "n")


def reachable(candidates: DataFrame) -> DataFrame:
    """Of (file, offset, successor) candidates those on the chain from offset 0, as (file, offset)."""
    w = Window.partitionBy("file").orderBy("offset")
    before = F.lag("successor").over(w)
    runs = candidates.select("file", "offset", "successor", F.when(before == F.col("offset"), 0).otherwise(1).alias("first"))
    runs = stored(runs.withColumn("run", F.sum("first").over(w)), "runs")
    ends = runs.groupBy("file", "run").agg(F.max("successor").alias("exit"))
    entered = runs.select("file", F.col("offset").alias("exit"), F.col("run").alias("to"), F.col("offset").alias("at"))
    # run -> the run that its exit leads into, and where; runs without one end there
    step = stored(ends.join(entered, ["file", "exit"]).select("file", "run", "to", "at"), "jumps")
    reached = stored(runs.where("offset = 0").select("file", "run", F.col("offset").alias("at")), "reached")
    known = reached.count()
    while True:
        onward = reached.select("file", "run").join(step, ["file", "run"]).select("file", F.col("to").alias("run"), "at")
        reached = stored(reached.union(onward).distinct(), "reached")
        now = reached.count()
        if now == known:
            break
        known = now
        far = step.select("file", F.col("run").alias("to"), F.col("to").alias("_to"), F.col("at").alias("_at"))
        step = stored(step.join(far, ["file", "to"]).select("file", "run", F.col("_to").alias("to"), F.col("_at").alias("at")).union(step).distinct(), "jumps")
    return runs.join(reached, ["file", "run"]).where("offset >= at").select("file", "offset")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records under path: page_id, record_id, uri, payload_bytes, payload_digest (hex), record_type, refers_to, payload (null but for responses).

    page_id and refers_to are those of records written here, else null. Header names may be in any case, digests in base32. A payload of
    application/http is what follows the HTTP headers. A response's length and digest are those of the payload as read; if they differ from its header,
    reading fails.
    """
    pieces = _pieces(spark, path)
    marks = stored(boundaries(pieces), "boundaries")
    true = reachable(marks.where("successor is not null").select("file", "offset", "successor"))
    owner = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    # whole: nothing but the record itself lies between it and its successor, so its payload is at hand in its own piece
    held = marks.where("offset >= 0").join(true.withColumn("true", F.lit(True)), ["file", "offset"], "left")
    held = held.withColumn("own", F.max(F.when(F.col("true"), F.col("offset"))).over(owner))
    kept = stored(held.where("own is not null").select("nth", "file", "own", "offset", "head", "length", (F.col("own") != F.col("offset")).alias("inner"), (F.col("true") & (F.col("successor") <= F.col("to"))).alias("whole")), "kept")
    # All pieces but a few are whole records; the others are kept from among them, and joined where payloads contain the magic.
    odd = stored(marks.select("nth").join(kept.where("whole").select("nth"), "nth", "left_anti"), "odd")
    whole = pieces.select("nth", "value").join(small(odd), "nth", "left_anti").select("value")
    torn_parts = kept.where("inner or not whole").select("nth", "file", "own", "offset")
    torn_parts = torn_parts.join(kept.where("not inner and not whole").select("file", "own"), ["file", "own"], "left_semi")
    torn_parts = small(stored(torn_parts, "torn"))
    torn = pieces.select("nth", "value").join(torn_parts, "nth").groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("all"))
    torn = torn.select(F.array_join(F.transform("all", lambda x: x["value"]), MAGIC).alias("value"))
    return _records(whole.unionByName(torn))


def _told(header: Column) -> Column:
    """The SHA-1 that a header names, in hex; null where it names none, or one of another kind."""
    hexed = F.lower(_field(header, "WARC-Payload-Digest", r"sha1:([0-9a-f]{40})"))
    packed = F.upper(_field(header, "WARC-Payload-Digest", r"sha1:([a-z2-7]{32})"))
    # fixed values: digits of base32, and those that conv() knows
    digits = F.translate(packed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    parts = [F.lpad(F.lower(F.conv(F.substring(digits, 8 * k + 1, 8), 32, 16)), 10, "0") for k in range(4)]
    return F.coalesce(hexed, F.concat(*parts))


def _records(values: DataFrame) -> DataFrame:
    header = F.substring_index("value", END, 1)
    head = F.octet_length(header) + len(END)
    rows = values.select("value", header.alias("header"), head.alias("head"))
    size = _field(F.col("header"), "Content-Length", r"(\d+)").cast("int")
    block = F.substring(F.col("value").cast("binary"), F.col("head") + 1, size)
    rows = rows.select("header", _field(F.col("header"), "WARC-Type", r"(\w+)").alias("record_type"), block.alias("block"), size.alias("size"))
    whole = F.octet_length("block") == F.col("size")
    http = F.coalesce(_field(F.col("header"), "Content-Type", r"(application/http)[^\r]*").isNotNull(), F.lit(False))
    after = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END) + 1
    rows = rows.select("header", "record_type", whole.alias("whole"), F.when(http, F.substring("block", after, F.col("size"))).otherwise(F.col("block")).alias("body"), _told(F.col("header")).alias("told"))
    rows = rows.withColumn("digest", F.sha1("body"))
    response = F.col("record_type") == "response"
    right = ~response | (F.col("whole") & (F.col("told").isNull() | (F.col("digest") == F.col("told"))))
    checked = F.when(right, F.when(response, F.col("digest")).otherwise(F.col("told"))).otherwise(F.raise_error(F.lit("a payload does not match its digest")).cast("string"))
    urn = lambda name: _field(F.col("header"), name, r"<urn:page:(-?\d+)>").cast("long")
    length = _field(F.col("header"), "WARC-Payload-Length", r"(\d+)").cast("long")
    return rows.select(
        urn("WARC-Record-ID").alias("page_id"), _field(F.col("header"), "WARC-Record-ID", r"<?([^\r>]*)>?").alias("record_id"), _field(F.col("header"), "WARC-Target-URI", r"<?([^\r>]*)>?").alias("uri"),
        F.coalesce(length, F.when(response, F.octet_length("body").cast("long"))).alias("payload_bytes"),
        checked.alias("payload_digest"), "record_type", urn("WARC-Refers-To").alias("refers_to"), F.when(response, F.col("body").cast("string")).alias("payload"),
    )


def archive(pages: DataFrame, *, path: str | None = None) -> DataFrame:
    """Writes the archives and returns what reading them back says, without uri, record_id and payload: a record for each row.

    Null payloads are empty; rows that share a page_id, or have none, have a record each (write() says which are responses). No rows: no records.
    """
    path = path or new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).drop("uri", "record_id", "payload")
