"""WARC archives of captures, and the globally ordered index merged from their sorted runs.

Writing: one record per capture in plain WARC/1.1 files through Spark's own writer (a task that
is retried replaces its files). The first capture of a payload, by smallest id, is a response; later
ones are revisits that keep the HTTP header and refer to it. Reading: every archive is walked
by its Content-Length fields, and its captures become one run sorted by URL key and
timestamp. Merging: key ranges split the runs; a task merges the pieces of all runs in its range
with a loser tree, so that range after range the index is in global order.

Defined cases: a null payload is empty; a null URL is the empty URL; a null time is the epoch; a capture
without an id counts after all others; rows that repeat id and payload are separate captures of the same kind;
an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.functions.grouped import groups
from airlattice.llm.common import Scratch, small_batches
from airlattice.session import delete_at_exit

ARCHIVE_BYTES = 16 << 20       # payload of an archive on average
ARCHIVE_MOST = 512 << 20       # and at most (a single larger payload apart)
SHARED_ROWS = 200_000          # shared payloads of some 60 bytes each sent to every task; above, a shuffle join
RANGE_ROWS = 50_000            # index lines merged in one task
PER_RANGE = 8                  # sampled lines per range for its borders
INDEX = ("url_key string, captured timestamp, archive string, offset long, length long, page_id long, "
         "payload_bytes long, payload_digest string, record_type string, refers_to long")
# Ids are text while lines pass through pandas, where a number beside a null would lose digits.
LINES = INDEX.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")


def base32_sha1(data):
    """Bare upper-case base32 SHA-1 of a binary column, in Spark expressions.

    Hexadecimal digits are taken five at a time: 20 bits, four base-32 digits.
    """
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    # The digits of base conversion and the base-32 alphabet.
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(captures: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """(id, url, captured, payload) -> plus digest, record_type, refers_to.

    Only payloads that several captures hold are looked up: their smallest id is a grouped minimum,
    combined before the shuffle. While those are few the payloads themselves are not shuffled;
    otherwise they are joined by digest, where the skew join splits a very common one.
    """
    body = captures.select("id", "url", F.coalesce("captured", F.timestamp_seconds(F.lit(0))).alias("captured"),
                           F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload")) \
        .withColumn("bytes", F.length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    first = scratch.save(body.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared-payloads")
    if first.count() <= SHARED_ROWS:
        first = F.broadcast(first)
    revisit = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return (body.join(first, ["digest", "bytes"], "left")
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first"))


def write(rows: DataFrame, path: str) -> None:
    """One WARC record per row, as files of about ``ARCHIVE_BYTES`` under ``path``.

    A record is its header, a blank line, its block and two line ends, which is what the text
    writer makes of header and block with that line separator. Files end after a number of records that
    keeps them near the target, and below ``ARCHIVE_MOST`` even if all were of the largest size.
    """
    size = rows.agg(F.avg(F.length("payload")).alias("mean"), F.max(F.length("payload")).alias("most")).first()
    mean, most = (size["mean"] or 0) + 600, (size["most"] or 0) + 600
    per_file = max(1, int(min(ARCHIVE_BYTES / mean, ARCHIVE_MOST / most)))
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("payload").cast("string"))).otherwise(http)
    length = F.length(http) + F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(0)
    # A line end inside a URL would end the header line.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20")
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
             F.concat(F.lit("WARC-Record-ID: <urn:capture:"), name, F.lit(">")),
             F.concat(F.lit("WARC-Date: "), F.date_format(F.col("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
             F.concat(F.lit("WARC-Target-URI: "), url),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.when(F.col("record_type") == "revisit", F.concat(
                 F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                       "WARC-Refers-To: <urn:capture:"), F.col("refers_to").cast("string"), F.lit(">"))),
             F.lit("Content-Type: application/http; msgtype=response"),
             F.concat(F.lit("Content-Length: "), length.cast("string"))]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, no scheme, port 80/443, www or fragment; then path and query."""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host, mark, query = host.partition("?")
    host = host.rsplit("@", 1)[-1].lower()
    name, _, port = host.partition(":")
    labels = [s for s in name.split(".") if s]
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    own_port = f":{port}" if port and port not in ("80", "443") else ""
    return ",".join(reversed(labels)) + own_port + ")/" + (path if slash else "") + (mark + query if mark else "")


def walk(data: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, header fields, block) of every record of an uncompressed archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (s.partition(":") for s in lines)}
        size = int(fields["content-length"])
        if end + 4 + size + 4 > len(data) or data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield at, end + 8 + size - at, fields, view[end + 4:end + 4 + size]
        at = end + 8 + size


def _capture(name: str | None) -> str | None:
    number = (name or "").strip("<>").rpartition(":")[2]
    return None if number in ("", "none") else number


def read_runs(spark, path: str) -> DataFrame:
    """Every archive under ``path`` as one run of index lines, sorted by URL key and timestamp.

    Payloads of responses are digested again and compared with their header.
    """
    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for archive, data in zip(pdf["path"], pdf["content"]):
                rows = []
                for offset, length, fields, block in walk(bytes(data)):
                    head = bytes(block[:4096]).split(b"\r\n\r\n", 1)[0]
                    size = next(int(s.split(b":", 1)[1]) for s in head.split(b"\r\n") if s.lower().startswith(b"content-length:"))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response":
                        payload = block[len(head) + 4:]
                        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if real != digest or len(payload) != size:
                            raise ValueError(f"{archive}: payload at byte {offset} does not match its header")
                    rows.append((url_key(fields["warc-target-uri"]), fields["warc-date"], archive, offset, length,
                                 _capture(fields["warc-record-id"]), size, digest, fields["warc-type"],
                                 _capture(fields.get("warc-refers-to"))))
                rows.sort(key=lambda r: (r[0], r[1], r[3]))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                out["captured"] = pd.to_datetime(out["captured"], utc=True).dt.tz_localize(None)
                out["place"] = range(len(out))
                yield out
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")     # one archive at a time in a worker
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        return files.select("path", "content").mapInPandas(index, LINES + ", place long")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)


class LoserTree:
    """k-way merge: inner nodes keep the losers of their match, the overall winner is on top.

    Replacing the winner replays only the matches on its way up, about log2 k comparisons.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = max(1, len(runs))
        self.losers = [-1] * k
        for leaf in range(len(runs)):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None and y is None or (x is None) == (y is None) and a < b
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        k, winner = len(self.runs), leaf
        node = (leaf + k) // 2
        while node > 0:
            if self.losers[node] == -1:
                self.losers[node] = winner      # first to arrive waits for its opponent
                return
            if self._less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            top = self.losers[0]
            if self.heads[top] is None:
                return
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self._replay(top)


def merge_runs(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """Sorted runs -> the whole index, with ``range`` and ``position`` giving the global order.

    Borders are seeded sample lines by (URL key, timestamp, archive, offset); that key is
    unique, so a URL that holds a third of all captures is split like any others.
    """
    n = runs.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    key = F.struct("url_key", "captured", "archive", "offset")
    borders = []
    if ranges > 1:
        part = min(1.0, PER_RANGE * ranges / n)
        draw = F.pmod(F.xxhash64("archive", "offset"), F.lit(1 << 30)) / float(1 << 30)
        # About PER_RANGE lines per range, and only every PER_RANGE-th is kept as a border.
        line = runs.where(draw < part).select(key.alias("k")).orderBy("k").collect()
        step = len(line) / ranges
        borders = [line[int(step * i)]["k"] for i in range(1, ranges)] if line else []
    placed = _place(runs, [tuple(b) for b in borders]) if borders else runs.withColumn("range", F.lit(0))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups(frames, "range"):
            pdf = pdf.reset_index(drop=True)
            lines = list(zip(pdf["url_key"], pdf["captured"], pdf["archive"], pdf["offset"], pdf.index))
            pieces = [iter([lines[i] for i in at]) for _, at in sorted(pdf.groupby("archive", sort=True).indices.items())]
            order = [line[-1] for line in LoserTree(pieces)]
            out = pdf.iloc[order].drop(columns="place").copy()
            out["position"] = range(len(out))
            yield out
    kinds = LINES + ", range int, position int"
    cols = [c.split()[0] for c in LINES.split(", ")]
    merged = (placed.repartition("range").sortWithinPartitions("range", "archive", "place")
              .select(*cols, "range", "place").mapInPandas(merge, kinds))
    return merged.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _place(runs: DataFrame, borders: list[tuple]) -> DataFrame:
    """Add the range of every line: the number of borders at or below it."""
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = [(b[0], pd.Timestamp(b[1]), b[2], b[3]) for b in borders]
        for pdf in frames:
            lines = zip(pdf["url_key"], pdf["captured"], pdf["archive"], pdf["offset"])
            pdf["range"] = [bisect_right(edges, line) for line in lines]
            yield pdf
    return runs.mapInPandas(place, LINES + ", place long, range int")


def capture_history(captures: DataFrame, scratch: Scratch, *, min_bytes: int = 0) -> DataFrame:
    """Captures -> archives under the shared folder -> the index of all of them in global order."""
    spark = captures.sparkSession
    small_batches(spark)
    path = scratch.path("archives")
    write(records(captures, scratch, min_bytes), path)
    delete_at_exit(spark, path)
    runs = scratch.save(read_runs(spark, path), "runs")
    return scratch.save(merge_runs(runs, scratch), "history")
