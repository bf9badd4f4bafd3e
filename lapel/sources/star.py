"""The star as the operators see it: five tables, each read with only the columns asked for.

Operators name their columns (``star.sales("store_id", "total_amount")``) so that a source that has to join
to supply a column, such as the conformed one, joins only when the column is wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapel.functions.money import LARGE, UNITS
from lapel.sources.schema import FOREIGN_KEYS, SCHEMAS, TABLE_COMMENTS
from lapel.sources.snapshots import Snapshot, Snapshots

Day = date | Column | str
MONTH = "sale_month"
PARTS = "profile_parts"


def day(value: Day) -> Column:
    """A date, an ISO string or a column as a DATE column; literals fold, so they still reach the scan."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


class Star:
    """Base of every source. Subclasses supply ``table``."""

    spark: SparkSession

    def table(self, name: str, cols: Iterable[str] = ()) -> DataFrame:
        raise NotImplementedError

    def derives(self, cols: Iterable[str]) -> bool:
        """Are some of these client columns computed from the fact when asked for?"""
        return False

    def on_fact(self, stored: Star) -> Star:
        """The same star with whatever it derives from its fact derived from ``stored``."""
        return self

    def profile_parts(self) -> DataFrame | None:
        """Partial profiles kept beside the fact (``operators.profile.partial_profiles``), if there are any."""
        return None

    def stores(self, *cols: str) -> DataFrame:
        return self.table("stores", cols)

    def advisors(self, *cols: str) -> DataFrame:
        return self.table("advisors", cols)

    def products(self, *cols: str) -> DataFrame:
        return self.table("products", cols)

    def clients(self, *cols: str, ids: DataFrame | None = None) -> DataFrame:
        """Clients, or those whose ``client_id`` is among ``ids``; a source that derives columns derives only theirs."""
        if ids is None:
            return self.table("clients", cols)
        cols = cols or tuple(SCHEMAS["clients"].names)
        rows = self.table("clients", (*cols, *({"client_id"} - set(cols))))
        return rows.join(ids.select("client_id"), "client_id", "left_semi").select(*cols)

    def transactions(self, *cols: str, since: Day | None = None, before: Day | None = None) -> DataFrame:
        """Fact rows with ``since <= transaction_date < before``; both bounds optional."""
        cols = cols or tuple(SCHEMAS["transactions"].names)
        if since is None and before is None:
            return self.table("transactions", cols)
        df = self.table("transactions", (*cols, *({"transaction_date"} - set(cols))))
        if since is not None:
            df = df.filter(F.col("transaction_date") >= day(since))
        if before is not None:
            df = df.filter(F.col("transaction_date") < day(before))
        return df.select(*cols)

    def sales(self, *cols: str, since: Day | None = None, before: Day | None = None) -> DataFrame:
        """Fact rows that are not returns."""
        cols = cols or tuple(SCHEMAS["transactions"].names)
        df = self.transactions(*cols, *({"is_return"} - set(cols)), since=since, before=before)
        return df.filter(~F.col("is_return")).select(*cols)


class StoredStar(Star):
    """Tables kept in a catalog namespace, under a folder written by :func:`write_star`, or in a folder per table.

    A fact written by :func:`write_star` is partitioned by month; date bounds
    are turned into bounds on the month so that only the partitions needed are listed and read. Of such a folder a star
    sees what was committed when it was first read from; take a new star to see later commits.

    Nothing is inferred from files: they are read as declared, or as ``schemas`` says where a source's keys differ in
    type.
    """

    def __init__(
        self,
        spark: SparkSession,
        namespace: str | None = None,
        path: str | None = None,
        schemas: dict[str, T.StructType] | None = None,
    ):
        if (namespace is None) == (path is None):
            raise ValueError("give either a namespace or a path")
        self.spark, self.namespace, self.path = spark, namespace, path
        self.schemas = {**SCHEMAS, **(schemas or {})}
        self._scans: dict[str, DataFrame] = {}
        self._seen: Snapshot | None = None
        self._listed = namespace is not None

    def snapshot(self) -> Snapshot | None:
        """What the folder's commits said when this star was first read from; None for a folder without commits."""
        if not self._listed:
            self._seen = Snapshots(self.spark, self.path).current()
            self._listed = True
        return self._seen

    def folders(self) -> dict[str, list[str]] | None:
        """Where each table lies; None for tables that lie where their name says."""
        seen = self.snapshot()
        return seen and seen.folders

    def scan(self, name: str) -> DataFrame:
        """The table as stored; a folder is listed once per star."""
        if self.namespace is not None:
            return self.spark.table(f"{self.namespace}.{name}")
        if name not in self._scans:
            folders = self.folders()
            schema, reader = self.schemas[name] if name != PARTS else _parts_schema(self.schemas), self.spark.read
            if name in (PARTS, "transactions"):
                schema = T.StructType([*schema.fields, T.StructField(MONTH, T.DateType())])
            if folders is not None and name in (PARTS, "transactions"):
                # batches side by side: their names are partitions, too
                reader = reader.option("basePath", Snapshots(self.spark, self.path).table_root(name))
                schema = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
            places = [f"{self.path}/{name}"] if folders is None else folders[name]
            self._scans[name] = reader.schema(schema).parquet(*places)
        return self._scans[name]

    def profile_parts(self) -> DataFrame | None:
        return self.scan(PARTS) if (self.folders() or {}).get(PARTS) else None

    def table(self, name: str, cols: Iterable[str] = ()) -> DataFrame:
        df = self.scan(name)
        return df.select(*(tuple(cols) or SCHEMAS[name].names))

    def transactions(self, *cols: str, since: Day | None = None, before: Day | None = None) -> DataFrame:
        cols = cols or tuple(SCHEMAS["transactions"].names)
        df = self.scan("transactions")
        by_month = MONTH in df.columns
        if since is not None:
            df = df.filter(F.col("transaction_date") >= day(since))
            if by_month:
                df = df.filter(F.col(MONTH) >= F.trunc(day(since), "MM"))
        if before is not None:
            df = df.filter(F.col("transaction_date") < day(before))
            if by_month:
                df = df.filter(F.col(MONTH) < day(before))
        return df.select(*cols)


class MappedStar(Star):
    """A star given as ready DataFrames, one per table."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def table(self, name: str, cols: Iterable[str] = ()) -> DataFrame:
        cols = tuple(cols) or tuple(SCHEMAS[name].names)
        return self.tables[name].select(*cols)


Lens = tuple[Callable[[DataFrame], DataFrame], tuple[str, ...], tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]] | None]


class ViewedStar(Star):
    """A star seen through one transform per table, e.g. row filters and masks.

    ``lens[name]`` is ``(transform, columns it reads, row filter)``. It runs on the raw columns; the asked-for columns
    are picked afterwards. The row filter, a transform and the columns it reads, is the part that says which rows stay:
    a source that derives columns of clients is told whose first, if the filter itself reads none of those.
    """

    def __init__(self, base: Star, lens: dict[str, Lens]):
        self.spark, self.base, self.lens = base.spark, base, lens

    def derives(self, cols: Iterable[str]) -> bool:
        return self.base.derives(cols)

    def profile_parts(self) -> DataFrame | None:
        """The base's, unless a transform changes what they were made of."""
        return None if {"transactions", "products"} & set(self.lens) else self.base.profile_parts()

    def table(self, name: str, cols: Iterable[str] = ()) -> DataFrame:
        return self._seen(name, tuple(cols) or tuple(SCHEMAS[name].names), None)

    def clients(self, *cols: str, ids: DataFrame | None = None) -> DataFrame:
        return self._seen("clients", cols or tuple(SCHEMAS["clients"].names), ids)

    def _seen(self, name: str, cols: tuple[str, ...], ids: DataFrame | None) -> DataFrame:
        if name not in self.lens:
            return self.base.clients(*cols, ids=ids) if name == "clients" else self.base.table(name, cols)
        transform, reads, rows = self.lens[name]
        wanted = (*cols, *[c for c in reads if c not in cols])
        if name != "clients":
            return self.base.table(name, wanted).transform(transform).select(*cols)
        if rows is not None and self.base.derives(wanted) and not self.base.derives(rows[1]):
            own = ("client_id", *[c for c in rows[1] if c != "client_id"])
            ids = self.base.clients(*own, ids=ids).transform(rows[0]).select("client_id")
        return self.base.clients(*wanted, ids=ids).transform(transform).select(*cols)

    def transactions(self, *cols: str, since: Day | None = None, before: Day | None = None) -> DataFrame:
        """Date bounds go to the base, which may prune by them; row filters commute with them."""
        cols = cols or tuple(SCHEMAS["transactions"].names)
        if "transactions" not in self.lens:
            return self.base.transactions(*cols, since=since, before=before)
        transform, reads, _ = self.lens["transactions"]
        wanted = (*cols, *[c for c in reads if c not in cols])
        return self.base.transactions(*wanted, since=since, before=before).transform(transform).select(*cols)


def create_schema(spark: SparkSession, namespace: str, comment: str = "Retail sales star") -> None:
    """Create the namespace unless it is there."""
    quoted = comment.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {namespace} COMMENT '{quoted}'")


def create_star_tables(spark: SparkSession, namespace: str, names: Iterable[str] = tuple(SCHEMAS)) -> None:
    """Drop and create the tables, empty and commented, so that a set-up can be run again."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {namespace}.{name}")
        columns = ", ".join(
            f"{f.name} {f.dataType.simpleString()} COMMENT '" + f.metadata["comment"].replace("'", "\\'") + "'"
            for f in SCHEMAS[name]
        )
        spark.sql(f"CREATE TABLE {namespace}.{name} ({columns}) USING parquet COMMENT '{TABLE_COMMENTS[name]}'")


def cast_dates(df: DataFrame, *cols: str) -> DataFrame:
    """ISO strings to DATE. A malformed value raises, as Spark's ANSI mode has it."""
    return df.withColumns({c: F.to_date(c) for c in cols})


def conform_types(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a table, in order, in their declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def append_table(df: DataFrame, namespace: str, name: str) -> None:
    """Append rows to a table created by :func:`create_star_tables`."""
    conform_types(df, name).write.mode("append").insertInto(f"{namespace}.{name}")


def _write_fact(fact: DataFrame, folder: str) -> None:
    """By month. The rebalance hint lets AQE pick the number of files per month from the real sizes: a month with most
    of the rows is split over many tasks, small months share one."""
    fact = fact.withColumn(MONTH, F.trunc("transaction_date", "MM"))
    fact.hint("rebalance", F.col(MONTH)).write.partitionBy(MONTH).parquet(folder)


def _place(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:").rstrip("/")


def write_star(star: Star, path: str, parts: Callable[[Star], DataFrame] | None = None) -> StoredStar:
    """Write the star once so that many questions can be asked of it without re-deriving it.

    Everything goes to new folders, which one commit at the end puts in the place of what was there: readers see the
    former star until then, and a write that breaks off changes nothing. So a star can be written over itself, which
    folds the appended batches into one; a batch that is appended meanwhile goes to the new one. Tables a source derives from its fact are derived from the written one.

    With ``parts`` (``operators.profile.partial_profiles``) the partial profiles of the fact are kept beside it.
    """
    store = Snapshots(star.spark, path)
    own = isinstance(star, StoredStar) and star.path is not None and _place(star.path) == _place(path)
    seen = star.snapshot() if own else None  # of its own star, what it has seen is what is written
    base = store.base() if seen is None else seen.base
    schemas = {name: star.table(name).schema for name in SCHEMAS}
    folders = {name: store.new_folder(name) for name in SCHEMAS}
    _write_fact(star.transactions(), folders["transactions"])
    draft = _Draft(star.spark, path, schemas, {"transactions": [folders["transactions"]]})
    rest = star.on_fact(draft)
    for name in ("stores", "advisors", "products", "clients"):
        rest.table(name).write.parquet(folders[name])
    draft = _Draft(star.spark, path, schemas, {name: [f] for name, f in folders.items()})
    if parts is not None:
        folders[PARTS] = store.new_folder(PARTS)
        parts(draft).write.partitionBy(MONTH).parquet(folders[PARTS])
    store.replace({**{name: store.relative(f) for name, f in folders.items()}, "batches": seen.batches if seen else []}, base, seen.appends if seen else ())
    return StoredStar(star.spark, path=path, schemas=schemas)


def _parts_schema(schemas: dict[str, T.StructType]) -> T.StructType:
    """Of partial profiles, but for the month they are partitioned by; clients have the type that the fact gives them."""
    sums = "category string, high long, low long, large decimal(24,4), valued long, n long, first_day date, last_day date, prior_day date"
    return T.StructType([schemas["transactions"]["client_id"], *T.StructType.fromDDL(sums)])


class _Draft(StoredStar):
    """A star of folders that are not committed yet."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType], folders: dict[str, list[str]]):
        super().__init__(spark, path=path, schemas=schemas)
        self._seen, self._listed = Snapshot(0, folders, [], []), True


def append_batch(star: StoredStar, batch: str, rows: dict[str, DataFrame], parts: Callable[[Star], DataFrame] | None = None) -> bool:
    """Append rows to tables of a star written by :func:`write_star`, all of them in one commit.

    The batch's name is its identity: one that is there already adds nothing, and False is returned. A batch that broke
    off is sent again under its name. A star with partial profiles gets those of the batch's sales, and no others are
    touched; ``parts`` is then needed.
    """
    store = Snapshots(star.spark, star.path)
    if store.holds(batch):
        return False
    latest = StoredStar(star.spark, path=star.path, schemas=star.schemas)
    has_parts = bool((latest.folders() or {}).get(PARTS))
    if has_parts and "transactions" in rows and parts is None:
        raise ValueError("the star keeps partial profiles: say how they are made")
    folders = {}
    for name, df in rows.items():
        folders[name] = store.new_folder(name)
        typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in star.schemas[name]])
        if name == "transactions":
            _write_fact(typed, folders[name])
        else:
            typed.write.parquet(folders[name])
    if has_parts and "transactions" in rows:
        folders[PARTS] = store.new_folder(PARTS)
        seen = {name: list(places) for name, places in (latest.folders() or {}).items()}
        seen["transactions"] = [folders["transactions"]]
        if "products" in folders:
            seen["products"].append(folders["products"])
        parts(_Draft(star.spark, star.path, star.schemas, seen)).write.partitionBy(MONTH).parquet(folders[PARTS])
    return store.append(batch, {name: store.relative(f) for name, f in folders.items()})


def register_views(star: Star, prefix: str = "") -> None:
    """Temp views named like the tables, for free SQL over the star."""
    for name in SCHEMAS:
        star.table(name).createOrReplaceTempView(f"{prefix}{name}")


def row_counts(star: Star) -> DataFrame:
    """table_name, n for each of the five tables."""
    key = {"stores": "store_id", "advisors": "advisor_id", "products": "product_id", "clients": "client_id"}
    parts = [
        star.table(name, [key.get(name, "transaction_id")]).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")
        )
        for name in SCHEMAS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def amount_check(star: Star) -> DataFrame:
    """One row: fact rows, those whose amount has more than four decimals, those of 9e11 and more, those without amount.

    Sums are exact for amounts of up to four decimals (``functions.money``).
    """
    amount = F.col("total_amount")
    units = F.round(amount.cast("decimal(38,10)") * F.lit(UNITS), 6)
    fine = (F.abs(amount) < LARGE) & (units != F.floor(units))
    return star.transactions("total_amount").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(fine).alias("more_decimals"),
        F.count_if(F.abs(amount) >= LARGE).alias("large"),
        F.count_if(amount.isNull()).alias("missing"),
    )


def fk_check(star: Star) -> DataFrame:
    """Rows whose foreign key is set but points nowhere, one line per relationship.

    One pass per referring table: each row gives a (relationship, key) per foreign key, which map-side counting brings
    down to the distinct keys, so a key that holds much of the table is one row per task at the join. Keys are compared
    as text, since they differ in type.
    """
    lines = [(f"{name}.{col}", f"{ref}.{key}") for name, col, ref, key in FOREIGN_KEYS]
    uses, known = None, None
    for name in dict.fromkeys(k[0] for k in FOREIGN_KEYS):
        own = [(f"{name}.{col}", col) for n, col, _, _ in FOREIGN_KEYS if n == name]
        pairs = F.array(*[F.struct(F.lit(line).alias("foreign_key"), F.col(col).cast("string").alias("k")) for line, col in own])
        used = star.table(name, [col for _, col in own]).select(F.inline(pairs)).filter(F.col("k").isNotNull())
        used = used.groupBy("foreign_key", "k").agg(F.count(F.lit(1)).alias("n"))
        uses = used if uses is None else uses.unionByName(used)
    for name, col, ref, key in FOREIGN_KEYS:
        keys = star.table(ref, [key]).select(F.lit(f"{name}.{col}").alias("foreign_key"), F.col(key).cast("string").alias("k"))
        known = keys if known is None else known.unionByName(keys)
    orphans = uses.join(known, ["foreign_key", "k"], "left_anti").groupBy("foreign_key").agg(F.sum("n").alias("n"))
    every = star.spark.createDataFrame(lines, "foreign_key string, refers_to string")
    out = every.join(orphans, "foreign_key", "left")
    return out.select("foreign_key", "refers_to", F.coalesce("n", F.lit(0)).alias("orphans"))
