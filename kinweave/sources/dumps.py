"""SQL dump files as a Spark data source: MySQL INSERT and PostgreSQL COPY text, one partition per file and byte range.

A dump is read in ranges of bytes. What a line means depends on what came before it: it may stand outside of statements, in a COPY block,
in a statement or in a string of one. So all ranges are scanned first, each for all four beginnings at once; a range's scan says how it
ends for each of them, and one pass over these few numbers tells each range how it truly begins. Then any range is read from its
first byte on: lines of a COPY block belong to the range that they begin in, and statements to the range that their first
line begins in. One huge block is read by many tasks, and nothing is held but one row. Doubled quotes and \\N are read as SQL has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from ..staging import new_folder

# Escapes of the two dialects.
MYSQL_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
COPY_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
RANGE_BYTES = 64 << 20
#: What a line can stand in.
OUT, COPYING, STATEMENT, STRING = range(4)

TOKEN = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([(),])|([^\s'(),][^'(),]*)", re.S)
QUOTE = re.compile(r"\\.", re.S)
INSERT = re.compile(r"INSERT INTO\s+([`\"\w.]+)\s*(?:\(([^)]*)\))?\s*VALUES", re.I)
COPY = re.compile(r"COPY\s+([\"\w.]+)\s*\(([^)]*)\)\s+FROM stdin;", re.I)
CREATE = re.compile(r"CREATE TABLE\s+(?:IF NOT EXISTS\s+)?([`\"\w.]+)\s*\((.*)\)", re.I | re.S)


def relative_path(path: str) -> str:
    """A dump path that stays inside its root: relative, without '..'."""
    p = PurePosixPath(path)
    if p.is_absolute() or ".." in p.parts or ":" in path:
        raise ValueError("dump path must be relative and stay below the root")
    return str(p)


def plain(name: str) -> str:
    return name.strip().strip('`"').rsplit(".", 1)[-1].strip('`"')


def number_or_text(text: str):
    text = text.strip()
    if text.upper() == "NULL":
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def mysql_rows(values: str) -> Iterator[list]:
    """The tuples after VALUES."""
    row: list | None = None
    for quoted, mark, bare in TOKEN.findall(values):
        if mark == "(":
            row = []
        elif mark == ")":
            if row is not None:
                yield row
            row = None
        elif mark != "," and row is not None:
            row.append(number_or_text(bare) if bare else re.sub(r"\\(.)|''", lambda m: "'" if m[1] is None else MYSQL_ESCAPES.get(m[1], m[1]), quoted, flags=re.S))


def copy_value(text: str):
    if text == "\\N":
        return None
    if text in ("t", "f"):
        return text == "t"
    return re.sub(r"\\(.)", lambda m: COPY_ESCAPES.get(m[1], m[1]), text)


def quotes_open(text: str, inside: bool = False) -> bool:
    """Whether a MySQL string is still open at the end of a text: escapes aside, each quote opens or closes one."""
    return inside != bool(QUOTE.sub("", text).count("'") % 2)


def begins_statement(head: str) -> bool:
    return head[:12].upper() in ("INSERT INTO ", "CREATE TABLE")


def step(state: int, line: str) -> int:
    """What the line after this one stands in."""
    if state == COPYING:
        return OUT if line.rstrip("\r\n") == "\\." else COPYING
    if state == OUT:
        head = line.lstrip()
        if COPY.match(head):
            return COPYING
        if not begins_statement(head):
            return OUT
    if quotes_open(line, state == STRING):
        return STRING
    return OUT if line.rstrip().endswith(";") else STATEMENT


def scan(lines: Iterator[tuple[int, str]], end: int) -> tuple[list[int], list[int]]:
    """For each of the four beginnings of a range: how it ends, and the byte of the last COPY header in it (-1: none)."""
    runs = {(state, -1): [state] for state in (OUT, COPYING, STATEMENT, STRING)}
    for at, line in lines:
        if at >= end:
            break
        after: dict[tuple[int, int], list[int]] = {}
        for (state, header), starts in runs.items():  # beginnings that have met stay together
            to = step(state, line)
            after.setdefault((to, at if state == OUT and to == COPYING else header), []).extend(starts)
        runs = after
    found = {start: run for run, starts in runs.items() for start in starts}
    return [found[s][0] for s in range(4)], [found[s][1] for s in range(4)]


def copy_lines(lines: Iterator[tuple[int, str]], end: int) -> Iterator[str]:
    for at, line in lines:
        if at >= end or line.rstrip("\r\n") == "\\.":
            return
        yield line.rstrip("\r\n")


def statements(lines: Iterator[tuple[int, str]], end: int, state: int = OUT, header: str = "") -> Iterator[tuple[str, Iterator[str] | None]]:
    """A COPY header with those lines of its block that begin before byte end, or a statement that does with None.

    state is what the first line stands in; header the line that opened the block where that is a COPY block.
    """
    if state == COPYING:
        block = copy_lines(lines, end)
        yield header, block
        for _ in block:
            pass
    elif state != OUT:  # the rest of a statement of an earlier range
        for _, line in lines:
            state = step(state, line)
            if state == OUT:
                break
    for at, line in lines:
        if at >= end:
            return
        head = line.lstrip()
        if COPY.match(head):
            block = copy_lines(lines, end)
            yield head, block
            for _ in block:  # of another table: passed over
                pass
        elif begins_statement(head):
            parts, state = [line], step(OUT, line)
            while state != OUT:
                nxt = next(lines, None)
                if nxt is None:
                    break
                parts.append(nxt[1])
                state = step(state, nxt[1])
            yield "".join(parts), None


def created_columns(body: str) -> list[str]:
    return [plain(line.strip().split()[0]) for line in body.splitlines() if line.strip()[:1] in ('`', '"')]


def dump_rows(lines: Iterator[tuple[int, str]], table: str, columns: list[str] | None, end: int = 1 << 62, state: int = OUT, header: str = "") -> Iterator[dict]:
    """Rows of one table as dicts. Column names come from the statement, else from columns, else from CREATE TABLE."""
    made: list[str] | None = columns
    for text, block in statements(lines, end, state, header):
        if block is not None:
            m = COPY.match(text)
            if plain(m[1]) == table:
                names = [plain(c) for c in m[2].split(",")]
                for line in block:
                    yield dict(zip(names, map(copy_value, line.split("\t")), strict=False))
        elif (m := CREATE.match(text.lstrip())) and plain(m[1]) == table and columns is None:
            made = created_columns(m[2])
        elif (m := INSERT.match(text.lstrip())) and plain(m[1]) == table:
            names = [plain(c) for c in m[2].split(",")] if m[2] else made
            if not names:
                raise ValueError(f"columns of {table} are not known")
            for row in mysql_rows(text.lstrip()[m.end() :]):
                yield dict(zip(names, row, strict=False))


def cast(value, kind):
    """A dump value as a Spark value; what does not fit is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, StringType):
            return ("true" if value else "false") if isinstance(value, bool) else str(value)
        if isinstance(kind, LongType):
            return int(value)
        if isinstance(kind, DoubleType):
            return float(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else {"1": True, "0": False, "t": True, "f": False}.get(str(value))
    except (TypeError, ValueError):
        return None
    raise TypeError(f"a dump column cannot be {kind}")


class DumpRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, state: int = OUT, header: int = -1):
        self.path, self.start, self.end, self.state, self.header = path, start, end, state, header


class DumpReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table = schema, options["table"]
        self.path, self.bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None
        self.mode, self.states = options.get("mode", "rows"), options.get("states")

    def _open(self, path: str):
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(path if "://" in path else f"file://{path}")
        return fs, at

    def partitions(self):
        """Ranges of the file, or of the files of a folder (hidden ones and marks aside)."""
        from pyarrow.fs import FileSelector, FileType

        fs, at = self._open(self.path)
        found = fs.get_file_info(at)
        files = [f for f in fs.get_file_info(FileSelector(at)) if f.type == FileType.File and f.base_name[0] not in "._"] if found.type == FileType.Directory else [found]
        ranges = [DumpRange(f.path, s, min(s + self.bytes, f.size)) for f in files for s in range(0, max(f.size, 1), self.bytes)]
        return self._begun(ranges) if self.states else ranges

    def _begun(self, ranges: list[DumpRange]) -> list[DumpRange]:
        """Each range with how it begins: the ends of the scanned ranges of its file, followed from the first on. Eight numbers a range."""
        from pyarrow.dataset import dataset

        fs, at = self._open(self.states)
        scanned = {(r["path"], r["start"]): r for r in dataset(at, filesystem=fs, format="parquet").to_table().to_pylist()}
        path, state, header = None, OUT, -1
        for part in ranges:
            if part.path != path:
                path, state, header = part.path, OUT, -1
            part.state, part.header = state, header
            found = scanned[part.path, part.start]
            header = header if found["headers"][state] < 0 else found["headers"][state]
            state = found["ends"][state]
        return ranges

    def read(self, part: DumpRange):
        fs, _ = self._open(self.path)
        with fs.open_input_file(part.path) as file:
            if self.mode == "scan":
                yield (part.path, part.start, *scan(self._lines(file, part.start), part.end))
                return
            header = next(self._lines(file, part.header))[1].lstrip() if part.state == COPYING else ""
            lines = self._lines(file, part.start)
            if self.mode == "names":
                texts = (text.lstrip() for text, block in statements(lines, part.end, part.state, header) if block is None)
                yield from ((",".join(created_columns(m[2])),) for m in map(CREATE.match, texts) if m and plain(m[1]) == self.table)
                return
            yield from (tuple(cast(row.get(f.name), f.dataType) for f in self.schema) for row in dump_rows(lines, self.table, self.columns, part.end, part.state, header))

    def _lines(self, file, start: int) -> Iterator[tuple[int, str]]:
        """(byte, line) from the first line that begins at start or later."""
        file.seek(max(start - 1, 0))
        held, at = b"", max(start - 1, 0)
        if start > 0:
            while True:
                chunk = file.read(1 << 20)
                held += chunk
                cut = held.find(b"\n")
                if cut >= 0 or not chunk:
                    at += cut + 1 if cut >= 0 else len(held)
                    held = held[cut + 1 :] if cut >= 0 else b""
                    break
        while True:
            cut = held.find(b"\n")
            while cut >= 0:
                yield at, held[: cut + 1].decode("utf-8", "replace")
                at, held = at + cut + 1, held[cut + 1 :]
                cut = held.find(b"\n")
            chunk = file.read(1 << 20)
            if not chunk:
                if held:
                    yield at, held.decode("utf-8", "replace")
                return
            held += chunk


class DumpSource(DataSource):
    """spark.read.format('sqldump').schema(...).option('table', t).load(path), a file or a folder of files.

    Options: columns, the names for INSERT statements without their own; rangeBytes; states, a folder with the scan of all ranges, without
    which every range is taken to begin outside of statements; mode: rows, or scan for how ranges end, or names for the columns that CREATE TABLE
    gives. Schemes are those of pyarrow, local paths included.
    """

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DumpReader(schema, dict(self.options))


def read_dump(spark: SparkSession, path: str, table: str, schema: str, columns: list[str] | None = None, root: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One table of a dump file or of a folder of them, in ranges of bytes; root, if given, is the folder that path must stay below.

    Column names that are not given come from CREATE TABLE, which is looked for in all ranges first, so that every range knows them.
    """
    if root is not None:
        path = f"{root.rstrip('/')}/{relative_path(path)}"
    spark.dataSource.register(DumpSource)
    read = spark.read.format("sqldump").option("table", table).option("rangeBytes", range_bytes)
    states = new_folder(spark, "dump-states")
    read.schema("path string, start long, ends array<int>, headers array<long>").option("mode", "scan").load(path).write.parquet(states)
    read = read.option("states", states)
    if not columns:
        names = read.schema("names string").option("mode", "names").load(path).agg(F.min("names")).first()[0]
        columns = names.split(",") if names else None
    read = read.schema(schema).option("mode", "rows")
    return (read.option("columns", ",".join(columns)) if columns else read).load(path)


def _block(head: str, end: str):
    """Adds the lines around a COPY block to the lines of a task; tasks without lines write none."""

    def wrap(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = True
        for frame in frames:
            if empty and len(frame):
                empty = False
                yield pd.DataFrame({"value": [head]})
            yield frame
        if not empty:
            yield pd.DataFrame({"value": [end]})

    return wrap


def write_copy(rows: DataFrame, table: str, path: str) -> None:
    """rows as a folder of PostgreSQL COPY text, one block a file; timestamps and numbers as Spark prints them."""
    fields = []
    for c, kind in rows.dtypes:
        text = F.col(c).cast("string") if kind != "boolean" else F.when(F.col(c), "t").otherwise("f")
        for char, mark in [("\\", "\\\\"), *((v, f"\\{k}") for k, v in COPY_ESCAPES.items())]:
            text = F.replace(text, F.lit(char), F.lit(mark))
        fields.append(F.when(F.col(c).isNull(), "\\N").otherwise(text))
    lines = rows.select(F.concat_ws("\t", *fields).alias("value"))
    lines.mapInPandas(_block(f"COPY {table} ({', '.join(rows.columns)}) FROM stdin;", "\\."), "value string").write.text(path)


def write_inserts(rows: DataFrame, table: str, path: str) -> None:
    """rows as a folder of MySQL text, one INSERT a row without column names, and one CREATE TABLE in a file of its own."""
    fields = []
    for c, kind in rows.dtypes:
        text = F.col(c).cast("string")
        if kind not in ("int", "bigint", "double"):
            for char, mark in [("\\", "\\\\"), ("'", "\\'"), *((v, f"\\{k}") for k, v in MYSQL_ESCAPES.items() if k not in "b")]:
                text = F.replace(text, F.lit(char), F.lit(mark))
            text = F.concat(F.lit("'"), text, F.lit("'"))
        fields.append(F.when(F.col(c).isNull(), "NULL").otherwise(text))
    made = f"CREATE TABLE `{table}` (\n" + ",\n".join(f"  `{c}` text" for c in rows.columns) + "\n);"
    lines = rows.select(F.concat(F.lit(f"INSERT INTO `{table}` VALUES ("), F.concat_ws(",", *fields), F.lit(");")).alias("value"))
    rows.sparkSession.createDataFrame([(made,)], "value string").union(lines).write.text(path)


# --- envelopes --------------------------------------------------------------------------------------------------------

RECORD_TYPES = ["identity", "relationship", "sales", "bankruptcy", "rental", "crm_deal", "crm_history", "call", "conversation"]
ENVELOPE = """source_system string, source_record_id string, record_type string, observed_at string, record_hash string, identifiers array<struct<type: string, value: string, is_verified: boolean>>,
    attributes map<string, string>, parent_record_id string, extraction_confidence double, extraction_method string"""


def read_landed(spark: SparkSession, path: str, schema: str = ENVELOPE) -> DataFrame:
    """Landed API pages: JSON lines of envelopes; a line that is no JSON has _bad set."""
    return spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def checked(envelopes: DataFrame) -> DataFrame:
    """Envelopes with error, the first rule that fails: keys, type, children without a parent, conversations without their pair, or others with it."""
    child = F.col("record_type").isin("crm_history", "call")
    pair = F.col("extraction_confidence").isNotNull() & F.col("extraction_method").isNotNull()
    any_ = F.col("extraction_confidence").isNotNull() | F.col("extraction_method").isNotNull()
    error = (
        F.when(F.coalesce("source_system", F.lit("")) == "", "no_source").when(F.coalesce("source_record_id", F.lit("")) == "", "no_id").when(F.coalesce("record_hash", F.lit("")) == "", "no_hash")
        .when(~F.coalesce(F.col("record_type").isin(*RECORD_TYPES), F.lit(False)), "bad_type").when(child & F.col("parent_record_id").isNull(), "no_parent")
        .when((F.col("record_type") == "conversation") & ~pair, "no_extraction").when((F.col("record_type") != "conversation") & any_, "extraction_forbidden")
    )
    return envelopes.withColumn("error", error)


def read_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table in parallel ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize="10000", **options).load()


def write_dataset(rows: DataFrame, path: str, key: str = "row_id") -> DataFrame:
    """Rows in ranges of their key as parquet; returns the digest of the whole, which does not depend on files or order."""
    cols = sorted(rows.columns)
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return back.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("digest"))


#: Readers by (source, mode).
CONNECTORS = {("dump", "batch"): read_dump, ("api", "batch"): read_landed, ("database", "batch"): read_table}
