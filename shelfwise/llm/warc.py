"""WARC archives of captures, revisits of equal payloads, and a merged capture index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import fresh_path, shuffle_width, stage, text_or_empty

# Fixed values of the archive format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "X-Row-Id"
REFERS_ID = "X-Refers-To-Row-Id"

# A text of Spark is no longer than this, nor are the headers beside the address; index entries that one merging task holds, about.
MOST_BYTES, MOST_HEADERS, MERGED_ENTRIES = 1 << 31, 2048, 250_000

ENTRY = (
    "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, file string, record_offset long, record_length long, run long"
)


def _header(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends in a value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    captured: Column | None = None,
    least_revisit: int = 1000,
    records_per_file: int = 4000,
    file_bytes: int = 1 << 28,
) -> None:
    """One record per row. Of equal payloads of at least ``least_revisit`` bytes that with the largest id is
    the response, the others revisit it and carry no payload.

    Rows that repeat both id and payload of a response are responses too. A null id is
    never revisited while its payload has another; a null url leaves the header out; a null
    html is an empty payload. ``captured`` gives the moment of capture in seconds since 1970,
    the row's id after 2024-01-01 where there is none. Other columns are not read.

    An archive holds at most ``records_per_file`` records and ``file_bytes`` bytes, or a
    single record that is larger: records are written by size class, each class four times
    the one before, so that its largest records fill no more than that.
    """
    payload = text_or_empty(html)
    number = F.col(page_id).cast("long")
    moment = captured if captured is not None else F.coalesce(number, F.lit(0)) + 1704067200
    rows = pages.select(
        number.alias("id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.sha2(payload.cast("binary"), 256).alias("content"),
        F.date_format(F.to_utc_timestamp(F.timestamp_seconds(moment), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )
    shared = rows.where(F.col("bytes") >= least_revisit).groupBy("content").agg(F.max("id").alias("response"), F.count("*").alias("n"))
    shared = stage(shared.where("n > 1").select("content", "response"), "warc-shared")
    # Small where few payloads repeat: then Spark sends it to the rows, as its size is known.
    judged = rows.join(shared, "content", "left").withColumn(
        "revisit", F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2)
    )
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("payload")))
    name = F.md5(F.concat_ws("|", "id", "url", "content").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    record = F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(f">{CRLF}"),
        _header("WARC-Date", F.col("date")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header(RECORD_ID, F.col("id")),
        F.when(F.col("revisit"), F.concat(_header("WARC-Profile", F.lit(REVISIT_PROFILE)), _header(REFERS_ID, F.col("response")))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF * 2),
        block,
    )
    edges = [max(1, file_bytes // records_per_file)]
    while edges[-1] < MOST_BYTES:
        edges.append(4 * edges[-1])
    # No record is longer: escapes triple an address at most.
    bound = F.col("bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + MOST_HEADERS
    number = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        number = F.when(bound <= edges[i], i).otherwise(number)
    found = sorted(r["class"] for r in rows.select(number.alias("class")).distinct().collect())
    for mode, i in zip(["error"] + ["append"] * len(edges), found or [0]):
        wanted = judged.where(number == i) if len(found) > 1 else judged
        most = max(1, min(records_per_file, file_bytes // edges[i]))
        wanted.select(record.alias("value")).write.mode(mode).option("lineSep", RECORD_END).option("maxRecordsPerFile", most).text(path)


def url_key(url: str | None) -> str:
    """Sort key of an address: host parts from the right, then path and query, without scheme, port and fragment."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    if not m:
        return (url or "").split("#")[0]
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive."""
    at, mark, end = 0, f"{VERSION}{CRLF}".encode(), RECORD_END.encode()
    while at < len(content):
        if not content.startswith(mark, at):
            raise ValueError(f"no record at byte {at}")
        head_end = content.index(end, at)
        lines = content[at + len(mark) : head_end].decode("utf-8").split(CRLF)
        headers = dict(line.split(": ", 1) for line in lines)
        start = head_end + len(end)
        stop = start + int(headers["Content-Length"])
        if content[stop : stop + len(end)] != end:
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, stop + len(end) - at, headers, content[start:stop]
        at = stop + len(end)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    run = TaskContext.get().partitionId()
    for batch in batches:
        rows = []
        for file, content in zip(batch["path"], batch["content"]):
            for offset, length, headers, block in parse_records(bytes(content)):
                http, _, payload = block.partition(RECORD_END.encode())
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response":
                    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file}: payload at byte {offset} is not what its header says")
                url = headers.get("WARC-Target-URI")
                rows.append(
                    (
                        url_key(url), headers["WARC-Date"], headers.get(RECORD_ID), url, size, digest,
                        headers["WARC-Type"], headers.get(REFERS_ID), file, offset, length, run,
                    )
                )
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])
        for name in ("page_id", "refers_to"):
            out[name] = out[name].astype("Int64")
        yield out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives in a folder, each archive's payloads checked against their digests."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(_entries, ENTRY)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.at, self.k = lists, [0] * len(lists), len(lists)
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether list ``a`` goes first; an ended list goes last, ties go to the earlier list."""
        x = self.lists[a][self.at[a]] if self.at[a] < len(self.lists[a]) else None
        y = self.lists[b][self.at[b]] if self.at[b] < len(self.lists[b]) else None
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                if building:
                    self.tree[node] = winner
                    return
            elif self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            first = self.tree[0]
            if self.at[first] >= len(self.lists[first]):
                return
            yield self.lists[first][self.at[first]]
            self.at[first] += 1
            self._replay(first)


def _merge(columns: list[str]):
    key = [columns.index(c) for c in ("url_key", "captured", "page_id", "file", "record_offset")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[int, list[tuple]] = {}
        whole = []
        for batch in batches:
            for values in zip(*(batch[c] for c in columns)):
                whole.append(values)
                number = values[-1]
                k = tuple(values[i] if not pd.isna(values[i]) else -1 for i in key)
                runs.setdefault(number, []).append((*k, len(whole) - 1))
        if not whole:
            return
        order = [entry[-1] for entry in LoserTree([runs[r] for r in sorted(runs)])]
        part = TaskContext.get().partitionId()
        for at in range(0, len(order), 10_000):
            out = pd.DataFrame([whole[i] for i in order[at : at + 10_000]], columns=columns)
            for name in ("page_id", "refers_to"):
                out[name] = out[name].astype("Int64")
            out["index_part"], out["index_row"] = part, range(at, at + len(out))
            yield out

    return run


def merged_index(entries: DataFrame) -> DataFrame:
    """Capture histories in the order of address key and moment: ``index_part``, then ``index_row``.

    ``entries`` are staged as runs, one per archive task, each sorted where it was made. A
    range of the whole order goes to each merging task, with the piece of every run that
    falls into it; the task merges its pieces with a loser tree. Ranges are cut by address
    key, moment, id and place, so a very common host or address spreads over many tasks.
    There are as many ranges as the entries need at about ``MERGED_ENTRIES`` each, so that
    what a task holds does not grow with the table.
    """
    order = ["url_key", "captured", "page_id", "file", "record_offset"]
    runs = stage(entries.sortWithinPartitions(*order), "warc-runs")
    ranges = max(shuffle_width(runs.sparkSession), -(-runs.count() // MERGED_ENTRIES))
    pieces = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order)
    return pieces.mapInPandas(_merge(runs.columns), f"{ENTRY}, index_part long, index_row long")


def captures(spark: SparkSession, pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Writes the archives, reads them back and gives the merged index of all captures.

    An empty table gives no archives and an empty index.
    """
    folder = path or fresh_path(spark, "warc")
    write_archives(pages, folder, **how)
    return merged_index(read_archives(spark, folder))
