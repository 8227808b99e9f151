"""SQLite databases as a Spark source and sink.

    spark.dataSource.register(SqliteTables)
    spark.read.format("sqlite_tables").option("table", "Race").option("partitions", 16).load("/shared/racing.db")
    df.write.format("sqlite_tables").option("table", "Race").mode("append").save("/shared/racing")

A path names one database or a folder of them that hold the same table, as the
sink writes it: a database for each task, listed in a manifest that is replaced
last.  Reading deals every database out by ranges of rowid, selects the columns
of the schema, and lets SQLite evaluate the filters that it evaluates as Spark
does.  The path must be one that all executors can open.
"""

from __future__ import annotations

import json
import math
import os
import sqlite3
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.sources.shared import Files

MANIFEST = "_manifest.json"
SUFFIXES = (".db", ".sqlite", ".sqlite3")
FETCH_ROWS = 10_000
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local_path(path: str) -> str:
    """SQLite opens files by their local path; a folder of another store is refused."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path}: databases are opened by local paths that all executors share")
    return path


def databases(path: str) -> list[str]:
    """The databases that a path names: itself, what a folder's manifest lists, or those in it by their suffix."""
    path = local_path(path)
    if os.path.isfile(path):
        return [path]
    manifest = os.path.join(path, MANIFEST)
    if os.path.isfile(manifest):
        with open(manifest, encoding="utf-8") as f:
            return [os.path.join(path, name) for name in json.load(f)["files"]]
    found = sorted(os.path.join(path, n) for n in os.listdir(path) if n.lower().endswith(SUFFIXES) and not n.startswith((".", "_"))) if os.path.isdir(path) else []
    if not found:
        raise FileNotFoundError(f"{path}: no database")
    return found


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def spark_type(declared: str) -> T.DataType:
    """The type of a column by its declaration: dates and truth values by their names, the others by SQLite's rules of affinity."""
    name = declared.upper()
    if "DATETIME" in name or "TIMESTAMP" in name:
        return T.TimestampType()
    if name == "DATE":
        return T.DateType()
    if "BOOL" in name:
        return T.BooleanType()
    if "INT" in name:
        return T.LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT", "JSON", "UUID")):
        return T.StringType()
    if "BLOB" in name or not name:
        return T.BinaryType() if "BLOB" in name else T.StringType()
    return T.DoubleType()


def declared_type(kind: T.DataType) -> str:
    for of, name in ((T.TimestampType, "DATETIME"), (T.TimestampNTZType, "DATETIME"), (T.DateType, "DATE"), (T.BooleanType, "BOOLEAN"), (T.IntegralType, "INTEGER"), (T.FractionalType, "REAL"), (T.BinaryType, "BLOB"), (T.StringType, "TEXT")):
        if isinstance(kind, of):
            return name
    raise TypeError(f"{kind.simpleString()} has no column of SQLite's")


def table_schema(path: str, table: str) -> T.StructType:
    with closing(opened(databases(path)[0])) as db:
        columns = db.execute("select name, type from pragma_table_info(?)", [table]).fetchall()
    if not columns:
        raise ValueError(f"{path}: no table {table}")
    return T.StructType([T.StructField(n, spark_type(t)) for n, t in columns])


def table_names(path: str) -> list[str]:
    with closing(opened(databases(path)[0])) as db:
        return [n for (n,) in db.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite\\_%' escape '\\' order by name")]


class CellError(ValueError):
    """A cell that doesn't fit its column's type."""


def _whole(v: object) -> int:
    if isinstance(v, int) or (isinstance(v, float) and v.is_integer()):
        return int(v)
    raise CellError


def _real(v: object) -> float:
    if isinstance(v, int | float):
        return float(v)
    raise CellError


def _text(v: object) -> str:
    if isinstance(v, bytes):
        raise CellError
    return v if isinstance(v, str) else repr(v)


def _truth(v: object) -> bool:
    known = {0: False, 1: True, "0": False, "1": True, "false": False, "true": True}
    key = v.strip().lower() if isinstance(v, str) else v
    if isinstance(key, int | float | str) and key in known:
        return known[key]
    raise CellError


def _moment(v: object) -> datetime:
    """ISO text (without a zone it is UTC) or milliseconds since 1970."""
    if isinstance(v, int):
        return _EPOCH + timedelta(milliseconds=v)
    try:
        found = datetime.fromisoformat(v.strip())
    except (AttributeError, ValueError):
        raise CellError from None
    return found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)


def _day(v: object) -> date:
    return _moment(v).date()


def _bytes(v: object) -> bytes:
    return v if isinstance(v, bytes) else _text(v).encode()


def reader_of(kind: T.DataType) -> tuple[Callable[[object], object], pa.DataType]:
    for of, read, arrow in (
        (T.TimestampType, _moment, pa.timestamp("us", "UTC")), (T.DateType, _day, pa.date32()), (T.BooleanType, _truth, pa.bool_()), (T.LongType, _whole, pa.int64()), (T.IntegerType, _whole, pa.int32()),
        (T.DoubleType, _real, pa.float64()), (T.StringType, _text, pa.string()), (T.BinaryType, _bytes, pa.binary()),
    ):
        if isinstance(kind, of):
            return read, arrow
    raise TypeError(f"{kind.simpleString()} is not read from SQLite")


Condition = tuple[str, str, object]
#: Comparisons by their SQL: equal, equal or both null, and so on; with None "is" and "is not" test for null.
COMPARED = ("=", "<=>", "<", "<=", ">", ">=")
OTHERS = ("in", "startswith", "is", "is not")


def condition(schema: T.StructType, name: str, op: str, value: object) -> tuple[str, list] | None:
    """A condition's SQL and parameters where SQLite agrees with Spark: numbers and texts, byte by byte, and nulls; else None.

    Dates and truth values have several spellings in a database, so only their nulls are compared there.
    """
    side, kind = quoted(name), schema[name].dataType
    if op in ("is", "is not"):
        return f"{side} {op} null", []
    values = list(value) if op == "in" else [value]
    if isinstance(kind, T.StringType):
        fits, side = all(isinstance(v, str) and "\0" not in v for v in values), f"{side} collate binary"
    else:
        numbers = isinstance(kind, T.LongType | T.IntegerType | T.DoubleType)
        fits = numbers and op != "startswith" and all(not isinstance(v, bool) and (isinstance(v, int) and -(2**63) <= v < 2**63 or isinstance(v, float) and math.isfinite(v)) for v in values)
    if not fits:
        return None
    if op == "in":
        return f"{side} in ({', '.join('?' * len(values))})", values
    if op == "startswith":
        return f"substr({quoted(name)}, 1, ?) = ? collate binary", [len(value), value]
    return f"{side} {'is' if op == '<=>' else op} ?", values


def as_column(name: str, op: str, value: object) -> Column:
    """The same condition as Spark evaluates it."""
    c = F.col(f"`{name.replace('`', '``')}`")
    known: dict[str, Callable[[], Column]] = {
        "=": lambda: c == value, "<=>": lambda: c.eqNullSafe(value), "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value,
        "in": lambda: c.isin(list(value)), "startswith": lambda: c.startswith(value), "is": c.isNull, "is not": c.isNotNull,
    }
    if op not in known or (op in ("is", "is not")) != (value is None):
        raise ValueError(f"no condition: {name} {op} {value!r}")
    return known[op]()


@dataclass
class RowRange(D.InputPartition):
    """A range of a database's rows; without bounds all of it."""

    path: str
    first: int | None = None
    end: int | None = None
    rowid: str = "rowid"


class SqliteReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.parts, self.lenient = int(options.get("partitions", "8")), options.get("mode", "failfast").lower() == "permissive"
        whole = table_schema(self.path, self.table)
        pushed = [x for c in json.loads(options.get("where", "[]")) if (x := condition(whole, *c))]
        self.where = [sql for sql, _ in pushed]
        self.values = [v for _, values in pushed for v in values]

    def partitions(self) -> Sequence[RowRange]:
        """Ranges of rowid of about equal width; a view or a table without rowids is one range."""
        spans = []
        for path in databases(self.path):
            with closing(opened(path)) as db:
                taken = {n.lower() for (n,) in db.execute("select name from pragma_table_info(?)", [self.table])}
                view = db.execute("select 1 from sqlite_master where type = 'view' and name = ?", [self.table]).fetchone()
                rowid = None if view else next((x for x in ("rowid", "oid", "_rowid_") if x not in taken), None)
                try:
                    low, high = db.execute(f"select min({rowid}), max({rowid}) from {quoted(self.table)}").fetchone() if rowid else (None, None)
                except sqlite3.OperationalError:
                    rowid = low = high = None
            if rowid and low is None:
                continue  # no rows
            spans.append(RowRange(path, low, None if high is None else high + 1, rowid or "rowid"))
        total = sum(s.end - s.first for s in spans if s.first is not None) or 1
        out = []
        for s in spans:
            if s.first is None:
                out.append(s)
                continue
            n = max(1, min(s.end - s.first, round(self.parts * (s.end - s.first) / total)))
            cuts = [s.first + (s.end - s.first) * k // n for k in range(n)] + [s.end]
            out += [RowRange(s.path, a, b, s.rowid) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out or [RowRange("")]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        names = self.schema.names
        readers, kinds = zip(*(reader_of(f.dataType) for f in self.schema.fields), strict=True) if names else ((), ())
        where, values = list(self.where), list(self.values)
        if part.first is not None:
            where = [f"{part.rowid} >= ? and {part.rowid} < ?", *where]
            values = [part.first, part.end, *values]
        sql = f"select {', '.join(map(quoted, names)) or '1'} from {quoted(self.table)}" + (f" where {' and '.join(where)}" if where else "")
        with closing(opened(part.path)) as db:
            rows = db.execute(sql, values)
            while batch := rows.fetchmany(FETCH_ROWS):
                columns = [self._column(n, r, c) for n, r, c in zip(names, readers, zip(*batch, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def _column(self, name: str, read: Callable[[object], object], cells: Sequence) -> list:
        out = []
        for v in cells:
            try:
                out.append(None if v is None else read(v))
            except (CellError, OverflowError):
                if not self.lenient:
                    raise CellError(f"{self.path}: {self.table}.{name}: {v!r} is no {self.schema[name].dataType.simpleString()}") from None
                out.append(None)
        return out


@dataclass
class Written(D.WriterCommitMessage):
    file: str | None
    rows: int = 0


@dataclass
class SqliteWriter(D.DataSourceArrowWriter):
    """A database for each task under a hidden name; the commit shows them all at once by replacing the manifest."""

    path: str
    table: str
    schema: T.StructType
    overwrite: bool

    def __post_init__(self) -> None:
        self.path = local_path(self.path)
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, rows = f"part-{uuid.uuid4().hex}.sqlite", 0
        target = os.path.join(self.path, f".{name}")
        moments = [isinstance(f.dataType, T.TimestampType | T.TimestampNTZType) for f in self.schema.fields]
        days = [isinstance(f.dataType, T.DateType) for f in self.schema.fields]
        put = f"insert into {quoted(self.table)} values ({', '.join('?' * len(moments))})"
        with closing(sqlite3.connect(target)) as db:
            db.execute("pragma journal_mode = off")
            db.execute(f"create table {quoted(self.table)} ({', '.join(f'{quoted(f.name)} {declared_type(f.dataType)}' for f in self.schema.fields)})")
            for batch in iterator:
                cells = [c.cast(pa.float64()).to_pylist() if pa.types.is_decimal(c.type) else c.to_pylist() for c in batch.columns]  # SQLite has no decimals
                cells = [[v if v is None else iso(v) for v in c] if m else [v if v is None else v.isoformat() for v in c] if d else c for c, m, d in zip(cells, moments, days, strict=True)]
                db.executemany(put, zip(*cells, strict=True))
                rows += batch.num_rows
            db.commit()
        if not rows:
            os.remove(target)
            return Written(None)
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        new = [m.file for m in messages if m and m.file]
        manifest = os.path.join(self.path, MANIFEST)
        before = []
        if os.path.isfile(manifest):
            with open(manifest, encoding="utf-8") as f:
                before = json.load(f)["files"]
        if not new and (self.overwrite or not before):  # an empty table is one without rows
            new = [f"part-{uuid.uuid4().hex}.sqlite"]
            with closing(sqlite3.connect(os.path.join(self.path, f".{new[0]}"))) as db:
                db.execute(f"create table {quoted(self.table)} ({', '.join(f'{quoted(f.name)} {declared_type(f.dataType)}' for f in self.schema.fields)})")
                db.commit()
        for name in new:
            os.replace(os.path.join(self.path, f".{name}"), os.path.join(self.path, name))
        with open(f"{manifest}.new", "w", encoding="utf-8") as f:
            json.dump({"table": self.table, "files": new if self.overwrite else [*before, *new], "rows": sum(m.rows for m in messages if m)}, f)
        os.replace(f"{manifest}.new", manifest)
        for name in before if self.overwrite else []:
            if name not in new:
                os.remove(os.path.join(self.path, name))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.file and os.path.exists(hidden := os.path.join(self.path, f".{m.file}")):
                os.remove(hidden)


def iso(t: datetime) -> str:
    """A moment as the databases have it: UTC with milliseconds."""
    t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}+00:00"


class SqliteTables(D.DataSource):
    """Options: path, table, partitions (of the whole read), where (JSON of conditions, all of which rows must meet as far as SQLite can tell),
    mode (failfast: a cell that doesn't fit its column ends the job; permissive: it is null).

    Conditions come as an option and not by ``pushFilters``: Spark 4.1 keeps what one use of a DataFrame pushed into such a source for the
    DataFrame's other uses, which then lack rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_tables"

    def schema(self) -> T.StructType:
        return table_schema(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options["path"], self.options["table"], schema, overwrite)


def scan(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, where: list[Condition] | None = None, partitions: int | None = None, permissive: bool = False) -> DataFrame:
    """A table of a database; with ``columns`` no others leave SQLite.

    ``where`` are conditions (column, operator, value) that all hold, such as ("price", "<=", 3.5), ("name", "startswith", "A"), ("id", "in", [1, 2]),
    ("going", "is", None).  SQLite leaves out the rows that it can tell; Spark applies them all.
    """
    spark.dataSource.register(SqliteTables)
    whole = table_schema(path, table)
    tests = list(where or [])
    unknown = [c for c in [*(columns or []), *(t[0] for t in tests)] if c not in whole.names]
    if unknown:
        raise ValueError(f"{path}: {table} has no {', '.join(unknown)}")
    read = [c for c in whole.names if columns is None or c in columns or c in {t[0] for t in tests}]
    options = {"table": table, "partitions": partitions or spark.sparkContext.defaultParallelism, "mode": "permissive" if permissive else "failfast"}
    if pushed := [t for t in tests if condition(whole, *t)]:
        options["where"] = json.dumps(pushed)
    out = spark.read.format("sqlite_tables").options(**options).schema(T.StructType([whole[c] for c in read])).load(path)
    for t in tests:
        out = out.filter(as_column(*t))
    return out if columns is None else out.select(*[F.col(f"`{c.replace('`', '``')}`") for c in columns])


def save(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Writes a table as databases into a folder, one for each task that has rows."""
    df.sparkSession.dataSource.register(SqliteTables)
    df.write.format("sqlite_tables").option("table", table).mode(mode).save(path)


# The tables of a racing database.
TABLES = {
    "races": "Race", "runners": "Runner", "horses": "Horse", "form": "FormEntry", "results": "ResultEntry", "evidence": "EvidenceProfile", "pace": "RunnerPaceProfile", "place_terms": "RacePlaceTerms",
    "bookmakers": "Bookmaker", "market_prices": "RunnerMarketPrice", "predictions": "PredictionSnapshot", "model_versions": "ModelVersion",
}
# The columns of the runs of all horses, and the largest fields of a band.
RUN_COLUMNS = ["id", "raceId", "horseId", "raceDate", "course", "distanceFurlongs", "going", "flatJumps", "raceClass", "numberOfRunners", "fieldSizeBand", "trainerName", "jockeyName", "draw", "weightLbsTotal", "officialRating", "headgear", "finishingPosition"]
SMALL_FIELD, MEDIUM_FIELD = 8, 14


def field_size_band(n: Column) -> Column:
    """By the number of runners; a race that doesn't say counts as large."""
    return F.when(n <= SMALL_FIELD, "SMALL").when(n <= MEDIUM_FIELD, "MEDIUM").otherwise("LARGE")


def global_runs(races: DataFrame, runners: DataFrame, results: DataFrame) -> DataFrame:
    """Each runner with its race, and its finishing position if there is a result; runners without a race go."""
    about = races.select(F.col("id").alias("raceId"), F.col("date").alias("raceDate"), F.col("racecourse").alias("course"), "distanceFurlongs", "going", "flatJumps", "raceClass", "numberOfRunners")
    own = [c for c in ("id", "raceId", "horseId", "trainerName", "jockeyName", "draw", "weightLbsTotal", "officialRating", "headgear")]
    placed = results.select(F.col("runnerId").alias("id"), "finishingPosition")
    # results first, while rows are narrow: the races' columns are shuffled with no runner
    return runners.select(*own).join(placed, "id", "left").join(about, "raceId").withColumn("fieldSizeBand", field_size_band(F.col("numberOfRunners"))).select(*RUN_COLUMNS)


@dataclass
class RacingData:
    """The tables of a racing database, each read from SQLite once, when it is first asked for, and from Parquet in ``folder`` after that.

    ``database`` may be a folder that has a folder of databases for each table. A folder that another session has filled is used as it is;
    ``refresh`` forgets a table. Without ``hold_sources`` the tables that the runs of all horses are made of are not stored for them.
    """

    spark: SparkSession
    database: str
    folder: str
    partitions: int | None = None
    hold_sources: bool = True
    _held: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._held:
            path = f"{self.folder}/{name}"
            if not Files(self.spark, self.folder).exists(f"{name}/_SUCCESS"):
                whole = global_runs(*map(self._source, ("races", "runners", "results"))) if name == "global_runs" else self._scan(name)
                whole.write.mode("overwrite").parquet(path)
            self._held[name] = self.spark.read.parquet(path)
        return self._held[name]

    def _source(self, name: str) -> DataFrame:
        """A table that another one is made of: as it is held, or out of SQLite where such tables are not stored."""
        if self.hold_sources or name in self._held or Files(self.spark, self.folder).exists(f"{name}/_SUCCESS"):
            return self.table(name)
        return self._scan(name)

    def _scan(self, name: str) -> DataFrame:
        return scan(self.spark, self._place(name), TABLES[name], partitions=self.partitions)

    def _place(self, name: str) -> str:
        """The database, or the folder of a table of its own as ``save`` writes it."""
        own = f"{self.database}/{TABLES[name]}"
        return own if os.path.isdir(local_path(own)) else self.database

    def refresh(self, name: str) -> None:
        self._held.pop(name, None)
        Files(self.spark, self.folder).delete(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or name == "global_runs":
            return self.table(name)
        raise AttributeError(name)
