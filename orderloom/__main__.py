"""python -m orderloom ingest|batch|reconstruct|stats|overview|explore|check ...: batch steps over a store's folder."""

from __future__ import annotations

import argparse
import glob
import os
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import session
from .functions import catalog
from .functions.schemas import MBO, normalize_types
from .functions.timing import as_date
from .operators import book, normalize, quality, validate
from .sources import dbn, omd
from .sources.store import Store, write_csv


def _read(spark, kind: str, path: str):
    spark.dataSource.register(omd.OmdSource)
    return spark.read.format("omd").option("kind", kind).load(path)


#: Names of the vendor's files; all others are binary channels.
VENDOR = re.compile(r"\.dbn(\.zst)?$")


def _vendor_events(spark, path: str):
    """Events of a vendor's files; their days are those of the receive times."""
    spark.dataSource.register(dbn.DbnSource)
    events = normalize.vendor_translate(spark.read.format("dbn").load(path))
    return normalize_types(events, T.StructType([*MBO.fields, T.StructField("session_date", T.DateType())]))


def _channel_events(spark, path: str, day, classes: list[str] | None, futures_only: bool):
    """Events of a day's binary channels."""
    known = omd.series(_read(spark, "series", path), futures_only)
    orders, trades = (omd.resolved(_read(spark, k, path), known, classes) for k in ("orders", "trades"))
    events = normalize.hkex_translate(orders, trades, as_date(day).year)
    place = F.row_number().over(normalize.Window.partitionBy("contract").orderBy("seq_num", "msg_index", "sub_ord")).cast("long")
    events = events.withColumn("ord", place).drop("seq_num", "msg_index", "sub_ord").withColumn("session_date", F.lit(str(as_date(day))).cast("date"))
    return normalize.reconstitute_modifies(events)


def ingest_day(spark, store: Store, path: str, day, mode: str = "LOOSE", classes: list[str] | None = None, futures_only: bool = False) -> None:
    """A day's binary channels or vendor files to normalised and rejected events of the store; other days stay."""
    events = _vendor_events(spark, path) if VENDOR.search(path) else _channel_events(spark, path, day, classes, futures_only)
    if events.isEmpty():
        raise ValueError(f"no events in {path}")
    store.write_validated(validate.validate(events), mode)


def ingest(spark, a) -> None:
    ingest_day(spark, Store(spark, a.store), a.path, a.date, a.mode, a.classes, a.futures)


def batch(spark, a) -> None:
    """Every folder or archive under a path whose name holds a date, one job each; days that are there are left out, failures listed."""
    store, failed = Store(spark, a.store), 0
    there = {str(r[0]) for r in store.days().select("session_date").distinct().collect()} if store.exists("mbo") and not a.overwrite else set()
    for path in sorted(glob.glob(os.path.join(a.path, "*"))):
        if not (found := re.search(r"(\d{4})-?(\d{2})-?(\d{2})", os.path.basename(path))):
            continue
        day = "-".join(found.groups())
        if day in there:
            print(f"{day} there")
            continue
        try:
            ingest_day(spark, store, os.path.join(path, "*") if os.path.isdir(path) else path, day, a.mode, a.classes, a.futures)
            print(f"{day} ok")
        except Exception as e:  # one bad day doesn't stop the others
            failed += 1
            print(f"{day} failed: {str(e).splitlines()[0][:200]}")
    if failed:
        raise SystemExit(1)


def reconstruct(spark, a) -> None:
    """Top-of-book rows of the contract-days that have none yet, or of all with --overwrite."""
    store = Store(spark, a.store)
    events = store.load("mbo", a.first, a.last, product=a.product) if a.front else store._days(store.read("mbo").where(F.col("product") == a.product), a.first, a.last)
    if not a.overwrite:
        events = events.join(store.missing(store.work_list(a.first, a.last, [a.product])), ["contract", "session_date"], "left_semi")
    names = events.select("contract", "provider", "venue", "product").distinct()
    store.write(book.reconstruct(events).join(names, "contract"), "mbp1")


def stats(spark, a) -> None:
    Store(spark, a.store).product_stats(a.product, a.first, a.last).orderBy("session_date").show(1000, False)


def overview(spark, a) -> None:
    Store(spark, a.store).overview(a.kind).orderBy("venue", "product", "contract").show(1000, False)


def explore(spark, a) -> None:
    """What a day's channels define, by class; --csv writes a row for each order book."""
    definitions = _read(spark, "series", a.path)
    omd.instruments(definitions).orderBy("class_code").show(1000, False)
    if a.csv:
        write_csv(omd.inventory(definitions).orderBy("class_code", "symbol", "orderbook_id"), a.csv)


def check(spark, a) -> None:
    """Invariants of the quotes of days, and whether they are good enough."""
    store = Store(spark, a.store)
    quality.verdict(store._days(store.read("mbp1").where(F.col("product") == a.product), a.first, a.last)).orderBy("contract", "session_date").show(1000, False)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orderloom", description=__doc__)
    sub = parser.add_subparsers(required=True)
    for name, run in (("ingest", ingest), ("batch", batch)):
        p = sub.add_parser(name)
        p.add_argument("path", help="glob of the day's channels" if run is ingest else "folder with a folder or archive for each day")
        if run is ingest:
            p.add_argument("date", help="YYYY-MM-DD")
        else:
            p.add_argument("--overwrite", action="store_true")
        p.add_argument("--classes", nargs="*")
        p.add_argument("--futures", action="store_true", help="leave out what base definitions say isn't a future")
        p.add_argument("--mode", choices=("STRICT", "LOOSE"), default="LOOSE")
        p.set_defaults(run=run)
    for name, run in (("reconstruct", reconstruct), ("stats", stats), ("check", check)):
        p = sub.add_parser(name)
        p.add_argument("product", choices=catalog.available_products())
        p.add_argument("first")
        p.add_argument("last")
        p.set_defaults(run=run)
        if run is reconstruct:
            p.add_argument("--front", action="store_true", help="only each day's front contract")
            p.add_argument("--overwrite", action="store_true")
    p = sub.add_parser("overview")
    p.add_argument("--kind", choices=("mbo", "mbp1", "rejected"), default="mbo")
    p.set_defaults(run=overview)
    p = sub.add_parser("explore")
    p.add_argument("path")
    p.add_argument("--csv", help="folder for the whole inventory")
    p.set_defaults(run=explore)
    for name, p in sub.choices.items():
        if name != "explore":
            p.add_argument("--store", required=True)
        p.add_argument("--master")
    a = parser.parse_args(args)
    spark = session.build(a.master)
    a.run(spark, a)
    spark.stop()


if __name__ == "__main__":
    main()
