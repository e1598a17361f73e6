"""Event and quote tables on disk, partitioned by provider, venue, product, contract, year, month and day, and their loaders."""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog
from ..functions.schemas import MBO, MBP1, REJECTED, normalize_types
from ..functions.timing import DAY, as_date, day_ns, utc_date
from ..operators import filters, front, stats
from ..operators.validate import split

PARTITIONS = ("provider", "venue", "product", "contract", "year", "month", "session_date")
SCHEMAS = {"mbo": MBO, "mbp1": MBP1, "rejected": REJECTED}


@dataclass(frozen=True)
class Store:
    """Tables mbo, mbp1 and rejected under a root folder. A contract-day is a partition; days are filters on partitions."""

    spark: SparkSession
    root: str

    def path(self, kind: str) -> str:
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        return f"{self.root.rstrip('/')}/{kind}"

    def write(self, df: DataFrame, kind: str, provider: str = "default") -> None:
        """Replace the contract-days that df has rows of, each as a whole; all others stay as they are."""
        day = utc_date(F.col("ts_recv"))
        own = F.col("provider") if "provider" in df.columns else F.lit(provider)
        rows = df.withColumns({"provider": own, "session_date": day, "year": F.year(day), "month": F.month(day)})
        rows = rows.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "ord")
        rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(self.path(kind))

    def write_validated(self, validated: DataFrame, mode: str = "STRICT", provider: str = "default") -> None:
        """Kept rows to mbo and rejected ones to rejected; the rejected ones of a day written anew are replaced, too."""
        kept, rejected = split(validated, mode)
        self.write(kept, "mbo", provider)
        self.write(rejected, "rejected", provider)

    def replace(self, df: DataFrame, kind: str, backup: str | None = None) -> str:
        """Write the whole table anew, even from itself, and swap it in; the old one stays at the path that is returned.

        The new table is complete before the old one is moved; if the swap fails the old one is moved back."""
        path = self.path(kind)
        tag = backup or uuid.uuid4().hex
        fresh, old = f"{path}_new_{tag}", f"{path}_old_{tag}"
        Store(self.spark, f"{self.root.rstrip('/')}/{kind}_new_{tag}")._write_to(df, fresh)
        jvm = self.spark._jvm
        to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = to(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(to(path)) and not fs.rename(to(path), to(old)):
            raise OSError(f"{path} can't be moved to {old}")
        if not fs.rename(to(fresh), to(path)):
            fs.rename(to(old), to(path))
            raise OSError(f"{fresh} can't be moved to {path}")
        self.spark.catalog.refreshByPath(path)
        return old

    def _write_to(self, df: DataFrame, path: str) -> None:
        names = [c for c in PARTITIONS if c in df.columns]
        df.repartition(*names).sortWithinPartitions(*names, "ord").write.option("compression", "zstd").partitionBy(*names).parquet(path)

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind))

    def exists(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(kind))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def register(self, prefix: str = "") -> list[str]:
        """Temporary views of the tables there are, for SQL; their names."""
        names = []
        for kind in SCHEMAS:
            if self.exists(kind):
                self.read(kind).createOrReplaceTempView(prefix + kind)
                names.append(prefix + kind)
        return names

    # Discovery: from partitions' names, so no file is opened.

    def days(self, kind: str = "mbo") -> DataFrame:
        """(provider, venue, product, contract, session_date) of every partition."""
        names = [c for c in PARTITIONS if c not in ("year", "month")]
        return self.read(kind).select(*names).distinct()

    def dates(self, product: str, contract: str | None = None, kind: str = "mbo") -> DataFrame:
        rows = self.days(kind).where(F.col("product") == product)
        rows = rows if contract is None else rows.where(F.col("contract") == contract)
        return rows.select("session_date").distinct().orderBy("session_date")

    def contracts(self, product: str, day, kind: str = "mbo") -> DataFrame:
        rows = self.days(kind).where((F.col("product") == product) & (F.col("session_date") == F.lit(as_date(day))))
        return rows.select("contract").distinct().orderBy("contract")

    def front_contract(self, product: str, day, method: str = "volume") -> str:
        rows = front.front(self._days(self.read("mbo").where(F.col("product") == product), day, day), method).select("contract").limit(1).collect()
        if not rows:
            raise FileNotFoundError(f"no outright contract of {product} on {as_date(day)}")
        return rows[0]["contract"]

    def _days(self, df: DataFrame, first, last) -> DataFrame:
        first, last = as_date(first), as_date(last)
        return df.where(F.col("session_date").between(F.lit(first), F.lit(last)) & (F.col("ts_recv") >= day_ns(first)) & (F.col("ts_recv") < day_ns(last) + DAY))

    def load(self, kind: str, first, last=None, contract: str | None = None, product: str | None = None, columns: list[str] | None = None, session: str | None = None, method: str = "volume") -> DataFrame:
        """Rows of a contract, or of a product's front contract of each day, from first to last day, both included.

        session: only that session of the product, as default or by name; columns: after all filters, so others aren't read."""
        if (contract is None) == (product is None):
            raise ValueError("give a contract or a product")
        last = first if last is None else last
        named = product or catalog.product_of(contract)
        rows = self._days(self.read(kind).where(F.col("product") == named), first, last)
        if contract is not None:
            rows = rows.where(F.col("contract") == contract)
        else:
            best = front.front(self._days(self.read("mbo").where(F.col("product") == named), first, last), method)
            rows = rows.join(best, ["session_date", "contract"], "left_semi")
        if session is not None and as_date(first) == as_date(last):
            rows = filters.filter_rth(rows, named, first, session)
        elif session is not None:
            span = (as_date(last) - as_date(first)).days + 1
            days = [as_date(first).fromordinal(as_date(first).toordinal() + k) for k in range(span)]
            rows = filters.in_rth(rows, catalog.bounds_table(self.spark, named, days, session))
        return rows.select(*columns) if columns else rows

    get_mbo = functools.partialmethod(load, "mbo")
    get_mbp1 = functools.partialmethod(load, "mbp1")

    def contract_stats(self, contract: str, day, session: str | None = None) -> DataFrame:
        p = catalog.product(catalog.product_of(contract))
        return stats.contract_stats(self.load("mbo", day, contract=contract, session=session), ("session_date", "contract"), p.tick_fp)

    def product_stats(self, product: str, first, last, session: str = "default") -> DataFrame:
        """The front contract of each day with trades, in one job over the range."""
        rows = self.load("mbo", first, last, product=product, session=session)
        return stats.contract_stats(rows, ("session_date", "contract"), catalog.product(product).tick_fp).where("n_trade > 0")

    def cross_market(self, products: list[str], day) -> DataFrame:
        rows = front.front_events(self._days(self.read("mbo").where(F.col("product").isin(*products)), day, day), keys=("session_date", "product"))
        return stats.cross_market(rows, catalog.dim_product(self.spark))

    def overview(self, kind: str = "mbo") -> DataFrame:
        """Days and rows per contract; only partitions and footers are read."""
        return self.read(kind).groupBy("venue", "product", "contract").agg(F.count_distinct("session_date").alias("n_days"), F.min("session_date").alias("first"), F.max("session_date").alias("last"), F.count(F.lit(1)).alias("n_rows"))

    def info(self, product: str, kind: str = "mbo") -> dict:
        """What the catalogue knows of a product, with the days, contracts and rows that the table has."""
        got = self.overview(kind).where(F.col("product") == product).agg(F.count(F.lit(1)), F.min("first"), F.max("last"), F.sum("n_rows")).first()
        return catalog.info(product) | {"n_contracts": got[0], "first": got[1], "last": got[2], "n_rows": got[3] or 0}

    def work_list(self, first=None, last=None, products: list[str] | None = None, contracts: list[str] | None = None, kind: str = "mbo") -> DataFrame:
        """(product, contract, session_date) to be worked on: from day, month (YYYY-MM), year (YYYY) to the same, or all."""
        rows = self.days(kind).select("product", "contract", "session_date").distinct()
        if first is not None:
            a, b = span_of(first, first if last is None else last)
            rows = rows.where(F.col("session_date").between(F.lit(a), F.lit(b)))
        rows = rows if products is None else rows.where(F.col("product").isin(*products))
        return rows if contracts is None else rows.where(F.col("contract").isin(*contracts))

    def missing(self, work: DataFrame, kind: str = "mbp1") -> DataFrame:
        """The (contract, session_date) of work that the table doesn't have yet."""
        wanted = work.select("contract", "session_date").distinct()
        return wanted.join(self.days(kind).select("contract", "session_date"), ["contract", "session_date"], "left_anti") if self.exists(kind) else wanted


def span_of(first, last):
    """First and last day of days, months written YYYY-MM or years written YYYY."""
    import calendar
    import datetime as dt

    def ends(x):
        if isinstance(x, dt.date):
            return x, x
        text = str(x)
        if len(text) == 4:
            return dt.date(int(text), 1, 1), dt.date(int(text), 12, 31)
        if len(text) == 7 and text[4] == "-":
            year, month = int(text[:4]), int(text[5:])
            return dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])
        return as_date(text), as_date(text)

    return ends(first)[0], ends(last)[1]


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Event files of other writers: types made ours, ord from the row's place in its file, file_date the date in its name."""
    raw = spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias("_row"), F.col("_metadata.file_name").alias("_file"))
    named = raw.withColumns({"ord": F.col("_row"), "file_date": F.nullif(F.regexp_extract("_file", r"(\d{8})", 1), F.lit(""))})
    return normalize_types(named, T.StructType([*SCHEMAS[kind].fields, T.StructField("file_date", T.StringType())]))


def schema_drift(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(column, type, files): how many of the files have a column with a type; only footers are read."""
    rows = [(f.name, f.dataType.simpleString(), p) for p in paths for f in spark.read.parquet(p).schema.fields]
    return spark.createDataFrame(rows, "column string, type string, path string").groupBy("column", "type").agg(F.count(F.lit(1)).alias("files"))


def write_csv(df: DataFrame, path: str) -> None:
    """A summary of a few rows as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
