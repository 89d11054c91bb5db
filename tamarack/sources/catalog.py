"""Logical entity tables over the Parquet files, with their columns."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: view -> (file, expressions); the text runs on Spark and on DuckDB alike
VIEWS: dict[str, tuple[str, list[str]]] = {
    "item": ("part", ["p_partkey AS id", "p_name AS name", "p_brand AS brand", "p_type AS item_type", "p_size AS pack_size", "p_retailprice AS retail_price"]),
    "area": ("region", ["r_regionkey AS id", "r_name AS name"]),
    "country": ("nation", ["n_nationkey AS id", "n_name AS name", "n_regionkey AS area_id"]),
    "client": ("customer", ["c_custkey AS id", "c_name AS name", "c_nationkey AS country_id", "c_acctbal AS balance", "c_mktsegment AS segment"]),
    "purchase": ("orders", ["o_orderkey AS id", "o_custkey AS client_id", "o_orderstatus AS status", "o_totalprice AS total_price", "o_orderdate AS created_at"]),
    "purchase_line": ("lineitem", ["concat_ws('-', CAST(l_orderkey AS string), CAST(l_linenumber AS string)) AS id", "l_orderkey AS purchase_id", "l_partkey AS item_id", "l_quantity AS quantity"]),
    "request_log": (
        "events",
        [
            "event_id AS request_id",
            "ts AS requested_at",
            "user_id AS client_id",
            "CAST(floor(event_id / 3) AS bigint) AS tx_id",
            "CASE event_type WHEN 'view' THEN 'GET' WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'click' THEN 'PATCH' ELSE 'DELETE' END AS method",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS int) AS k",
            "CASE WHEN event_type = 'signup' OR CAST(regexp_extract(props, '([0-9]+)', 1) AS int) % 3 = 0 THEN '/api/catalog/items' ELSE concat('/api/catalog/items/', CAST(user_id % 20 AS string)) END AS path",
            "CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS int) % 10 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 408 WHEN 5 THEN 409 WHEN 6 THEN 422 WHEN 7 THEN 429 WHEN 8 THEN 500 ELSE 503 END AS http_status",
            "value",
        ],
    ),
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, in a local run without it a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tamarack-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def view_sql(name: str) -> str:
    file, exprs = VIEWS[name]
    return f"SELECT {', '.join(exprs)} FROM {file}"


class Catalog:
    """Entity tables by name. ``columns`` is what the compiler may name; ``id`` is implicit where a table doesn't declare it."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables = spark, tables

    @classmethod
    def of_folder(cls, spark: SparkSession, sf_dir: str) -> Catalog:
        read = {file: spark.read.parquet(f"{sf_dir}/{file}.parquet") for file, _ in VIEWS.values()}
        return cls(spark, {name: read[file].selectExpr(*exprs) for name, (file, exprs) in VIEWS.items()})

    def columns(self, table: str) -> list[str]:
        if table not in self.tables:
            raise KeyError(f"unknown table {table!r}")
        names = self.tables[table].columns
        return names if "id" in names else ["id", *names]

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]
