"""Paged sources as streams: chains of pages, each page naming the cursor of the next one.

A chain is one resource or one session of a source. Cursors are opaque, so what follows a page is known only once it is read. A step is up to
pagesPerStep pages of one chain, read in one task, or twice as many as the step before up to mostPages; when it ends, the task pins the next step's cursor in the state folder. Offsets
of the stream are numbers of steps by chain, so the checkpoint of the query says which steps are committed, and a step that is
run again starts at the same cursor and must end at the same one: within a run the source is a snapshot. The driver handles numbers of
steps and one small pin a chain, and no page. Chains are read side by side; within one, pages come one after another.

A page is JSON: {"data": [...], "meta": {"has_more": bool, "next_cursor": string, "snapshot_at": string}}.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlencode, urlparse
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAGE_ROWS = "chain string, cursor string, place int, record string"
#: The cursor of a first page, which no source gives.
FIRST = "first"
TRIES, WAIT_SECONDS = 3, 1.0


def _files(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _children(uri: str) -> list:
    from pyarrow.fs import FileSelector

    fs, at = _files(uri)
    return fs.get_file_info(FileSelector(at, allow_not_found=True))


@dataclass
class FolderPages:
    """Pages that lie in root/chain=<chain>/cursor=<name>/, one file with a page a line, as write_pages leaves them. A cursor is a name, whose first line is meant, or <name>~<line>."""

    root: str
    at: str = ""
    lines: tuple[bytes, ...] = ()

    def chains(self) -> list[str]:
        return sorted(f.base_name.removeprefix("chain=") for f in _children(self.root) if f.base_name.startswith("chain="))

    def page(self, chain: str, cursor: str | None, since: str | None) -> dict:
        name, _, line = (cursor or FIRST).rpartition("~")
        if not (name and line.isdecimal()):
            name, line = cursor or FIRST, "0"
        at = f"{self.root}/chain={chain}/cursor={name}"
        if line == "0" or at != self.at:  # the file read last is held; its first line is always read anew
            found = [f.path for f in _children(at) if f.is_file and not f.base_name.startswith(("_", "."))]
            if len(found) != 1:
                raise ValueError(f"{at} holds {len(found)} files of pages")
            with _files(self.root)[0].open_input_file(found[0]) as file:
                self.at, self.lines = at, tuple(file.read().rstrip(b"\n").split(b"\n"))
        return json.loads(self.lines[int(line)])


@dataclass
class HttpPages:
    """GET url/<chain>?limit=&cursor= (first page: updated_since=). The environment variable named by auth holds the Authorization header.

    Only https, or plain http to this machine. Refusals for a while (429, 5xx) and lost connections are tried again; others are raised.
    """

    url: str
    names: list[str]
    limit: int
    auth: str

    def chains(self) -> list[str]:
        return self.names

    def page(self, chain: str, cursor: str | None, since: str | None) -> dict:
        where = urlparse(self.url)
        if where.scheme != "https" and where.hostname not in ("localhost", "127.0.0.1"):
            raise ValueError("a paged source must be asked by https")
        asked = {"limit": self.limit, **({"cursor": cursor} if cursor else {"updated_since": since} if since else {})}
        head = {"Authorization": os.environ[self.auth]} if self.auth else {}
        request = Request(f"{self.url.rstrip('/')}/{quote(chain, safe='')}?{urlencode(asked)}", headers=head)
        for tries in range(1, TRIES + 1):
            try:
                with urlopen(request, timeout=30) as answer:
                    return json.loads(answer.read())
            except (HTTPError, URLError, TimeoutError, ConnectionError) as error:
                lasting = isinstance(error, HTTPError) and error.code != 429 and error.code < 500
                if lasting or tries == TRIES:
                    raise
                time.sleep(WAIT_SECONDS * 2 ** (tries - 1))
        raise AssertionError("unreachable")


@dataclass
class Step(InputPartition):
    chain: str
    number: int


class PagedReader(DataSourceStreamReader):
    def __init__(self, options):  # names in any case
        names = [n for n in options.get("chains", "").split(",") if n]
        self.source = FolderPages(options["path"]) if "path" in options else HttpPages(options["url"], names, int(options.get("limit", 500)), options.get("auth", ""))
        self.state, self.pages, self.since = options["state"].rstrip("/"), int(options.get("pagesPerStep", 20)), options.get("since")
        self.most = int(options.get("mostPages", self.pages))
        if self.pages < 1:
            raise ValueError("pagesPerStep must be at least 1")
        self.pinned: dict[str, int] = {}

    # --- pins: where a step begins

    def _at(self, chain: str, number: int) -> str:
        return f"{self.state}/{quote(chain, safe='')}/{number}.json"

    def _pin(self, chain: str, number: int) -> dict | None:
        if number == 0:
            return {"cursor": None, "complete": False, "snapshot_at": None, "mark": None, "met": 0, "lap": 1}
        fs, at = _files(self._at(chain, number))
        try:
            with fs.open_input_file(at) as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def _set(self, chain: str, number: int, pin: dict) -> None:
        """Written under another name and then moved, so no half of a pin is ever read. A run of a step that ends elsewhere than an earlier one is refused."""
        had = self._pin(chain, number)
        if had is not None:
            if had != pin:
                raise ValueError(f"step {number} of {chain} ended at {had['cursor']} before and at {pin['cursor']} now: the source changed under its cursors")
            return
        fs, at = _files(self._at(chain, number))
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        draft = f"{at}.{os.getpid()}.{time.time_ns()}"
        with fs.open_output_stream(draft) as file:
            file.write(json.dumps(pin).encode())
        fs.move(draft, at)

    # --- offsets: steps by chain

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """One step beyond what is pinned, for each chain that has not ended."""
        out = {}
        for chain in self.source.chains():
            n = self.pinned.get(chain, 0)
            while self._pin(chain, n + 1) is not None:
                n += 1
            self.pinned[chain] = n
            out[chain] = n if self._pin(chain, n)["complete"] else n + 1
        return out

    def partitions(self, start: dict, end: dict) -> list[Step]:
        return [Step(chain, n) for chain, last in sorted(end.items()) for n in range(start.get(chain, 0), last)]

    def length(self, number: int) -> int:
        """Pages of a step by its number alone, so a step that is run again is as long. A micro-batch costs its time whatever it holds: long chains take few."""
        return min(self.pages << min(number, 40), max(self.pages, self.most))

    def read(self, partition: Step) -> Iterator:
        import pyarrow as pa

        form = pa.schema([("chain", pa.string()), ("cursor", pa.string()), ("place", pa.int32()), ("record", pa.string())])
        chain, pin = partition.chain, self._pin(partition.chain, partition.number)
        if pin is None:
            raise ValueError(f"step {partition.number} of {chain} has no pin: the state folder and the checkpoint belong together")
        for _ in range(self.length(partition.number)):
            page = self.source.page(chain, pin["cursor"], self.since)
            data, meta = page["data"], page["meta"]
            records = [json.dumps(r, ensure_ascii=False) for r in data]
            n = len(records)
            yield pa.record_batch([pa.array([chain] * n, pa.string()), pa.array([pin["cursor"] or FIRST] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(records, pa.string())], schema=form)
            pin = follow(pin, meta, chain)
            if pin["complete"]:
                break
        self._set(chain, partition.number + 1, pin)


def follow(pin: dict, meta: dict, chain: str) -> dict:
    """The pin after a page. Chains that turn back to an earlier cursor are found with one remembered cursor, renewed after 1, 2, 4, ... pages,
    so a circle is found after at most some three times the pages up to its first return, with a state of fixed size."""
    snapshot = pin["snapshot_at"] or meta.get("snapshot_at")
    if not meta["has_more"]:
        return {**pin, "cursor": None, "complete": True, "snapshot_at": snapshot}
    cursor = meta.get("next_cursor")
    if not cursor:
        raise ValueError(f"a page of {chain} has more after it but names no cursor")
    if cursor in (pin["mark"], pin["cursor"]):
        raise ValueError(f"the cursor {cursor} of {chain} came before: its pages go in a circle")
    met, lap, mark = pin["met"] + 1, pin["lap"], pin["mark"]
    if met == lap:
        met, lap, mark = 0, 2 * lap, cursor
    return {"cursor": cursor, "complete": False, "snapshot_at": snapshot, "mark": mark, "met": met, "lap": lap}


class PagedSource(DataSource):
    """Options: path of a folder, or url, chains (comma-separated), limit and auth; state (a shared folder of this run), pagesPerStep, mostPages, since."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGE_ROWS

    def streamReader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def paged_stream(spark: SparkSession, state: str, **options) -> DataFrame:
    """The pages of a source as a stream of PAGE_ROWS; record is JSON. The state folder belongs to the checkpoint of the one query that reads the stream."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("pages").options(state=state, **options).load()


def parsed(pages: DataFrame, schema: str, key: str) -> DataFrame:
    """Page rows with the fields of their records and error: bad_json where a record is no object of that schema, no_key where its key is missing or empty.

    Names of the schema must differ from those of PAGE_ROWS. Rows with an error are dead letters; they keep their record.
    """
    fields = F.from_json("record", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = pages.withColumn("_fields", fields)
    error = F.when(F.col("_fields").isNull() | F.col("_fields._bad").isNotNull(), "bad_json").when(F.coalesce(F.col(f"_fields.{key}").cast("string"), F.lit("")) == "", "no_key")
    return out.withColumn("error", error).select(*pages.columns, "_fields.*", "error").drop("_bad")


def next_since(spark: SparkSession, state: str, overlap: int = 300) -> DataFrame:
    """chain, complete and since of a run: since is when its snapshot was taken, less an overlap in seconds, once the chain has ended; else null, so the last mark holds."""
    pins = spark.read.schema("cursor string, complete boolean, snapshot_at timestamp").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(state)
    chain = F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -2))
    ended = pins.select(chain.alias("chain"), "complete", "snapshot_at").groupBy("chain").agg(F.max("complete").alias("complete"), F.max("snapshot_at").alias("at"))
    return ended.select("chain", "complete", F.when(F.col("complete"), F.col("at") - F.expr(f"interval {overlap} seconds")).alias("since"))


def retry_state(outcomes: DataFrame, key: str, most: int = 5) -> DataFrame:
    """A stream of outcomes (key string, failed boolean) to one row a key and micro-batch: key, tries, status.

    Several outcomes of a key within a batch count as one, which is good if any is. A good one ends the key's state (done); a failed one adds a try: retry up
    to most tries, dead beyond. A dead key that fails again stays dead; one that then succeeds is done. Null keys are one key.
    """

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        good = False
        for frame in frames:
            good |= bool((~frame["failed"].fillna(True).astype(bool)).any())
        tries = state.get[0] if state.exists else 0
        if good:
            if state.exists:
                state.remove()
            status = "done"
        else:
            tries += 1
            state.update((tries,))
            status = "retry" if tries <= most else "dead"
        yield pd.DataFrame({key: [own[0]], "tries": [tries], "status": [status]})

    return outcomes.select(key, "failed").groupBy(key).applyInPandasWithState(step, f"{key} string, tries long, status string", "tries long", "append", GroupStateTimeout.NoTimeout)


def write_pages(records: DataFrame, path: str, together: int = 64) -> None:
    """records (chain, page long, place, record: JSON text) as a folder of pages in the order of page; so many pages of a chain are one file, held by one task.

    Chains and pages may be given with gaps. The first file of a chain is named FIRST, others by their number.
    """
    from pyspark.sql import Window

    # line ends in JSON stand between its tokens only
    body = F.transform(F.array_sort(F.collect_list(F.struct("place", F.translate("record", "\n\r", "  ").alias("record")))), lambda r: r["record"])
    pages = records.groupBy("chain", "page").agg(F.concat(F.lit("["), F.concat_ws(",", body), F.lit("]")).alias("data"))
    order = Window.partitionBy("chain").orderBy("page")
    # one narrow row a page is put in order; texts are joined to it afterwards
    links = records.select("chain", "page").distinct().select("chain", "page", (F.row_number().over(order) - 1).alias("n"), F.lead("page").over(order).isNotNull().alias("more"))
    name = lambda n: F.when(n < together, FIRST).otherwise(F.concat(F.lit("g"), F.floor(n / together).cast("string")))
    cursor = F.concat(name(F.col("n") + 1), F.when((F.col("n") + 1) % together > 0, F.concat(F.lit("~"), ((F.col("n") + 1) % together).cast("string"))).otherwise(""))
    meta = F.when(F.col("more"), F.concat(F.lit('"has_more":true,"next_cursor":"'), cursor, F.lit('"'))).otherwise('"has_more":false')
    value = F.concat(F.lit('{"data":'), F.col("data"), F.lit(',"meta":{'), meta, F.lit("}}"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", value.alias("value")))), lambda p: p["value"])
    files = pages.join(links, ["chain", "page"]).groupBy("chain", name(F.col("n")).alias("cursor")).agg(F.concat_ws("\n", lines).alias("value"))
    files.write.partitionBy("chain", "cursor").text(path)
