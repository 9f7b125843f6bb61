"""Materialised marts over a raw-table binding.

Staging and intermediate models stay lazy (views); marts are written as
Parquet below the shared folder named by ``spark.checkpoint.dir`` and read
back, which cuts lineage the way the source's table models do.

Every table is published whole (``sources.published``) with a fingerprint of
its definition (the code of the plans) and of the input files it derives from.  A
process that finds a table with the fingerprint it wants reads it and builds nothing; after a change
it builds again just the tables whose inputs or code changed, and readers of the old ones go on
undisturbed.  A mart is built at most once per warehouse.

The raw layer is written once on first use (the source's load step), so the
binding from the test tables is derived once, not by every model and check.

Beyond the source's marts, two query-side tables are materialised:

* ``fct_sales_wide`` - the six-table star join that every sales question
  starts from, written range-partitioned and sorted by ``order_date_key`` so a
  date filter prunes Parquet row groups.  Sales questions become one scan.
* ``rfm_customers`` - the RFM mart with the customer's state and city and
  the category of the customer's last valid item (computed once here, not
  by a fact-wide aggregate in every churn query).
"""

from __future__ import annotations

import functools
import hashlib
import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.hotkeys import hot_keys
from basketry.plans import models as M
from basketry.plans.declared import measures
from basketry.profile import TEST_PROFILE, Profile
from basketry.session import shared_root, shuffles_dropped
from basketry.sources import files, published
from basketry.sources.binding import (
    RAW_TABLES,
    SOURCE_TABLES,
    items_numbered,
    order_items_from,
    order_payments_from,
    raw_table,
)
from basketry.sources.files import file_system

MARTS = (
    "dim_time",
    "dim_customers",
    "dim_products",
    "dim_sellers",
    "dim_payments",
    "fct_order_items_sales",
    "fct_customer_rfm",
    "fct_sales_wide",
    "rfm_customers",
)

TARGET_PARTITION_BYTES = 128 * 1024 * 1024

#: The tables at item grain are written one share of the orders after another, so that the shuffle files of one share
#: are on disk at a time: a share for so many bytes of the items' files, and at most so many (each reads all files).
SLICE_BYTES = 64 * 1024 * 1024
SLICES = 8

_OPEN: dict[tuple, "Warehouse"] = {}
_OPEN_LOCK = threading.Lock()


# Which test tables each raw table derives from, and which raw tables each mart does.
RAW_INPUTS = {
    "orders": ("orders",),
    "_items_numbered": ("lineitem",),
    "customers": ("orders", "customer", "nation"),
    "products": ("part",),
    "category_name_translation": ("part",),
    "sellers": ("supplier", "nation"),
    "order_reviews": ("documents",),
    "geolocation": ("supplier", "nation"),
}
_FACT = ("orders", "_items_numbered", "customers")
_ALL_MARTS = tuple(t for t in RAW_INPUTS if t not in ("order_reviews", "geolocation"))
MART_INPUTS = {
    "dim_time": ("orders",),
    "dim_customers": ("customers", "orders"),
    "dim_products": ("products", "category_name_translation"),
    "dim_sellers": ("sellers",),
    "dim_payments": ("_items_numbered",),
    "fct_order_items_sales": _FACT,
    "_order_buyers": ("orders", "customers"),
    "_order_sales": _FACT,
    "_hot_orders": ("_items_numbered",),
    "_rfm_metrics": _FACT,
    "fct_customer_rfm": _FACT,
    "fct_sales_wide": _ALL_MARTS,
    "_order_rollup": _ALL_MARTS,
    "rfm_customers": (*_FACT, "products", "category_name_translation"),
}


def _files_digest(spark: SparkSession, sf_dir: str, tables: Iterable[str]) -> str:
    """Digest of the files of some input tables as the cluster lists them: names, sizes, times."""
    h = hashlib.sha1()
    for t in sorted(set(tables)):
        p, fs = file_system(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
        files = fs.listFiles(p, True) if fs.exists(p) else None
        found = []
        while files is not None and files.hasNext():
            st = files.next()
            found.append(f"{t}/{st.getPath().getName()}:{st.getLen()}:{st.getModificationTime()}")
        h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()[:12]


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    return _files_digest(spark, sf_dir, SOURCE_TABLES)


@functools.cache
def _code_digest() -> str:
    """Digest of the code that defines raw tables, marts and results."""
    h = hashlib.sha1()
    root = Path(__file__).resolve().parent.parent
    for part in ("plans", "catalog", "functions", "operators", "profile.py", "sources/binding.py"):
        at = root / part
        for f in sorted(at.glob("*.py")) if at.is_dir() else [at]:
            h.update(f.read_bytes())
    return h.hexdigest()[:12]


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str, profile: Profile = TEST_PROFILE, root: str | None = None,
                 raw: dict[str, DataFrame] | None = None):
        """``root``: where the tables are; by default a new folder.  ``open_warehouse`` gives the folder
        that all processes over an input share."""
        self.spark = spark
        self.sf_dir = sf_dir
        self.profile = profile
        if root is None:
            root = f"{shared_root(spark)}/basketry-marts/own-{uuid.uuid4().hex[:8]}"
        self.root = root
        self._raw_override = raw or {}
        self.made: list[str] = []  # tables that this warehouse has built, not found
        self._built: dict[str, DataFrame] = {}
        self._manifests: dict[str, tuple[DataFrame, published.Manifest]] = {}  # of the tables in _built that were published
        self._lock = threading.Lock()  # guards the dicts
        self._building: dict[str, threading.Lock] = {}  # one lock per table: built once, by whoever asks first
        self._digests: dict[tuple[str, ...], str] = {}

    @classmethod
    def from_tables(cls, spark: SparkSession, root: str, profile: Profile, marts: str | None = None) -> "Warehouse":
        """A warehouse over tables that ``load_tables`` published below ``root``; tables that were not loaded are left out."""
        raw = {}
        for name in RAW_TABLES:
            try:
                raw[name] = published.read(spark, f"{root}/{name}")
            except published.NotPublished:
                continue
        return cls(spark, root, profile, root=marts, raw=raw)

    def fingerprint(self, name: str) -> str | None:
        """Of a table's definition and inputs; none over given raw tables."""
        if self._raw_override:
            return None
        raw = (name.removeprefix("raw/"),) if name.startswith("raw/") else _ALL_MARTS if name.startswith("results/") else MART_INPUTS[name]
        tables = tuple(sorted({t for r in raw for t in RAW_INPUTS[r]}))
        if tables not in self._digests:
            self._digests[tables] = _files_digest(self.spark, self.sf_dir, tables)
        return hashlib.sha1(f"{name} {self.profile!r} {_code_digest()} {self._digests[tables]}".encode()).hexdigest()

    # ------------------------------------------------------------ raw/views
    def raw(self, name: str) -> DataFrame:
        """Raw-layer table, loaded (written) once like the source's load step,
        so the models and the reconciliation jobs read it without re-deriving it."""
        if name in self._raw_override:
            return self._raw_override[name]
        if name in ("order_items", "order_payments"):
            # both come from the numbered line items: number and write them
            # once; each table is a projection (payments also a filter) of
            # that one written table, so no item-sized table is written twice
            numbered = self._once("raw/_items_numbered", lambda: items_numbered(self.spark, self.sf_dir))
            derive = order_items_from if name == "order_items" else order_payments_from
            return derive(numbered)
        return self._once(f"raw/{name}", lambda: raw_table(self.spark, self.sf_dir, name))

    def stg(self, name: str) -> DataFrame:
        fn: Callable[[DataFrame], DataFrame] = getattr(M, f"stg_{name}")
        return fn(self.raw(name))

    def view(self, name: str) -> DataFrame:
        """Lazy (unmaterialised) model by name."""
        if name.startswith("stg_"):
            return self.stg(name[4:])
        if name == "int_customers_deduplicated":
            return M.int_customers_deduplicated(self.stg("customers"), self.stg("orders"))
        if name == "int_products_enriched":
            return M.int_products_enriched(self.stg("products"), self.raw("category_name_translation"))
        if name == "int_order_payments_aggregated":
            return M.int_order_payments_aggregated(self.stg("order_payments"))
        raise KeyError(name)

    # ---------------------------------------------------------------- marts
    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _write(self, name: str, df: DataFrame | list[DataFrame]) -> DataFrame:
        now = published.replace(df, self.path(name), {"fingerprint": self.fingerprint(name)}, measures(name))
        out = published.read(self.spark, self.path(name), now)
        with self._lock:
            self._built[name] = out
            self._manifests[name] = (out, now)
            self.made.append(name)
        return out

    def _found(self, name: str) -> DataFrame | None:
        """The table as some process has published it, if it is of the wanted definition and inputs."""
        want = self.fingerprint(name)
        now = published.current(self.spark, self.path(name)) if want else None
        if now is None or now.info.get("fingerprint") != want:
            return None
        out = published.read(self.spark, self.path(name), now)
        with self._lock:
            self._manifests[name] = (out, now)
        return out

    def _manifest(self, name: str) -> published.Manifest | None:
        """The manifest of a table as this warehouse serves it; none for one that was put in its place."""
        df = self.table(name)
        with self._lock:
            kept, now = self._manifests.get(name, (None, None))
        return now if kept is df else None

    def _parts(self, name: str) -> list[DataFrame]:
        """A table as its folders, one for each share of the orders it was written by; as one frame if it was not published."""
        now = self._manifest(name)
        return [self.table(name)] if now is None else published.read_parts(self.spark, self.path(name), now)

    def measured(self, name: str) -> DataFrame | None:
        """What the table's write measured (one row), if that is known: see ``declared.measures``."""
        now = self._manifest(name)
        return None if now is None else published.measured(self.spark, self.path(name), now)

    def measure(self, name: str, what: str) -> str | None:
        now = self._manifest(name)
        return None if now is None else now.info.get("measures", {}).get(what)

    def save_result(self, name: str, df: DataFrame) -> DataFrame:
        """Write a (small) job result below this warehouse and read it back."""
        path = self.path(f"results/{name}-{uuid.uuid4().hex[:8]}")
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _once(self, name: str, plan: Callable[[], DataFrame | list[DataFrame]]) -> DataFrame:
        with self._lock:
            if name in self._built:
                return self._built[name]
            lock = self._building.setdefault(name, threading.Lock())
        with lock:  # dependencies form a DAG, so waiting here cannot cycle
            with self._lock:
                if name in self._built:
                    return self._built[name]
            out = self._found(name)
            if out is None:
                return self._write(name, plan())
            with self._lock:
                self._built[name] = out
            return out

    def table(self, name: str) -> DataFrame:
        return self._once(name, lambda: self._plan(name))

    def _plan(self, name: str) -> DataFrame | list[DataFrame]:
        p = self.profile
        if name == "dim_time":
            return M.dim_time(M.calendar_days(self.stg("orders"))).coalesce(1)
        if name == "dim_customers":
            return M.dim_customers(self.view("int_customers_deduplicated"))
        if name == "dim_products":
            return M.dim_products(self.view("int_products_enriched"))
        if name == "dim_sellers":
            return M.dim_sellers(self.stg("sellers"))
        if name == "dim_payments":
            return M.dim_payments(self.view("int_order_payments_aggregated"))
        if name == "fct_order_items_sales":
            items, buyers, hot = self.stg("order_items"), self._buyers(), self.hot_orders()
            return self._sliced(lambda share: M.fct_order_items_sales(share(items), share(buyers), hot=hot))
        if name == "fct_customer_rfm":
            return self._plan_rfm()
        if name == "fct_sales_wide":
            # Range partitioning by date: files and row groups carry tight
            # min/max statistics on order_date_key for filter pushdown.  The
            # number of ranges follows the fact's size on storage, so output
            # files stay near the target size at any scale.  The ranges are
            # cut on (date, order, item): a date holding a large share of the
            # rows spans several ranges instead of one task, and every range
            # still covers one contiguous stretch of dates.
            # The fact is deliberately not written bucketed by order_id: that
            # would save the order join's shuffle, but a bucket cannot be split,
            # so a hot order would run as one task; shuffled, AQE splits it.
            # The calendar's columns follow from the date and are added after
            # the shuffle.
            # Each share of the orders has ranges of its own, over all dates; an
            # even share of the ranges keeps the files at their size.
            items, orders, hot = self.stg("order_items"), self._order_sales(), self.hot_orders()
            products, sellers, time = (self.table(t) for t in ("dim_products", "dim_sellers", "dim_time"))
            ranges = self._share(self._wide_ranges())

            def dated(share: Callable[[DataFrame], DataFrame]) -> DataFrame:
                wide = M.sales_undated(share(items), products, sellers, share(orders), hot)
                ranged = wide.repartitionByRange(ranges, "order_date_key", "order_id", "order_item_id")
                return M.with_calendar(ranged.sortWithinPartitions("order_date_key", "order_id"), time)

            return self._sliced(dated)
        if name == "rfm_customers":
            last = M.last_item_category(self.table("fct_order_items_sales"), self.table("dim_products"))
            out = M.rfm_with_customers(self.table("fct_customer_rfm"), self.table("dim_customers"), last)
            # customer pages filter by state: a local sort (no shuffle, so a
            # state holding most customers cannot skew it) gives row groups
            # tight state statistics for the pushed-down IN filter
            return out.sortWithinPartitions("customer_state")
        raise KeyError(name)

    def stored_bytes(self, name: str) -> int:
        """Bytes of a published table's files, from the file listing."""
        now = published.current(self.spark, self.path(name))
        return sum(n for _, n in files.data_files(self.spark, published.paths(self.path(name), now)))

    def _wide_ranges(self) -> int:
        """Ranges of the wide table, by the size of the items and the order's columns that each of them gets; items that were given are not listed."""
        floor = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if "order_items" in self._raw_override:
            return floor
        self.raw("order_items")
        return max(floor, -(-2 * self.stored_bytes("raw/_items_numbered") // TARGET_PARTITION_BYTES))

    def _slices(self) -> int:
        """Shares of the orders that a table at item grain is written by; one where the items were given."""
        if "order_items" in self._raw_override:
            return 1
        self.raw("order_items")
        return min(SLICES, -(-self.stored_bytes("raw/_items_numbered") // SLICE_BYTES) or 1)

    def _sliced(self, plan: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> list[DataFrame]:
        """``plan`` for each share of the orders; it gets the function that takes the share's rows of a table."""
        n = self._slices()
        return [plan(functools.partial(M.order_slice, k=k, n=n)) for k in range(n)]

    def _share(self, tasks: int) -> int:
        """Tasks of one share, of ``tasks`` for all: an even part, but as many as run at once."""
        return min(tasks, max(-(-tasks // self._slices()), self.spark.sparkContext.defaultParallelism))

    def rfm_recency(self) -> DataFrame:
        """Recency, frequency and money of every buyer, written once: the cut rows of the scores are found by reading it a few times."""
        fact = self.table("fct_order_items_sales")
        return self._once("_rfm_metrics", lambda: M.rfm_recency(M.rfm_metrics(M.rfm_customer_orders(fact))))

    def _plan_rfm(self) -> DataFrame:
        return M.rfm_segmented(M.rfm_scores(self.rfm_recency()))

    def order_rollup(self) -> DataFrame:
        """The wide table reduced to (order, category), written once: see ``models.order_rollup``."""
        def plan() -> list[DataFrame]:
            parts = self._parts("fct_sales_wide")  # no order is in two of them
            tasks = self._share(self._wide_ranges()) if len(parts) > 1 else self._wide_ranges()
            return [M.order_rollup(part, self.table("dim_time"), tasks, self.hot_orders()) for part in parts]

        return self._once("_order_rollup", plan)

    def result(self, name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        """A (small) query result that several figures start from: written once, found again by its fingerprint."""
        return self._once(f"results/{name}", plan)

    def _buyers(self) -> DataFrame:
        """Orders with their buyer, written once for the fact and the wide table."""
        # neither has a column for the two dates before delivery
        orders = self.stg("orders").drop("order_approved_at", "order_delivered_carrier_date")
        return self._once("_order_buyers", lambda: M.orders_with_buyer(orders, self.stg("customers")))

    def _order_sales(self) -> DataFrame:
        """What the wide table has of each order, written once for all shares of the orders."""
        return self._once("_order_sales", lambda: M.sales_orders(self.table("dim_customers"), self.table("dim_payments"), self._buyers()))

    def hot_orders(self) -> DataFrame | None:
        """Orders with more items than an even share of a task (fewer than there are tasks), written once; none: no split."""
        hot = self._once("_hot_orders", lambda: hot_keys(self.stg("order_items"), "order_id"))
        return None if hot.isEmpty() else hot

    def drop(self) -> None:
        """Remove everything in this warehouse's folder; the next use builds it again."""
        files.remove(self.spark, self.root)
        with self._lock:
            self._built.clear()

    def build_all(self, threads: int = 4) -> dict[str, DataFrame]:
        """Build every mart, up to ``threads`` at once (the source's dbt runs
        four models at a time); a mart waits only for the tables it reads."""
        with ThreadPoolExecutor(max_workers=threads) as pool:
            list(pool.map(self.raw, RAW_TABLES))
            list(pool.map(self.table, MARTS))
        return {m: self.table(m) for m in MARTS}


class RolledUp:
    """A warehouse whose wide table is its rollup by order and category: the same answers for sums of money and for
    distinct orders, customers and categories, so page queries of those kinds run on it unchanged."""

    def __init__(self, wh: Warehouse):
        self._wh = wh

    def __getattr__(self, name: str):
        return getattr(self._wh, name)

    def table(self, name: str) -> DataFrame:
        return self._wh.order_rollup() if name == "fct_sales_wide" else self._wh.table(name)


def open_warehouse(spark: SparkSession, sf_dir: str, profile: Profile = TEST_PROFILE) -> Warehouse:
    """One warehouse per (session, input folder and its files) in this process, over the tables that any process has published for the folder."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), _fingerprint(spark, sf_dir), profile)
    with _OPEN_LOCK:
        if key not in _OPEN:
            tag = hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:12]
            _OPEN[key] = Warehouse(spark, sf_dir, profile, root=f"{shared_root(spark)}/basketry-marts/{tag}")
        return _OPEN[key]
