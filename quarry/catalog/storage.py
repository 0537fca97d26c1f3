"""Registered queries of sources, sinks and data-quality checks (S1-S10,
Q1-Q5, A14)."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.catalog.base import query
from quarry.plans import quality as qa
from quarry.session import cut_lineage
from quarry.sources import files as fs
from quarry.sources import tables as tb

# Range scheme for the orders table: one bucket below 1996, yearly buckets,
# one open-ended bucket from 2000 (the data spans 1995-2001).
FIRST_UPPER, LAST_LOWER = 1996, 2000


@query("duplicate_rows")
def q_duplicate_rows(spark, sf):
    docs = tb.table(spark, sf, "documents")
    return (qa.duplicate_rows(docs, ["text"])
            .select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5")))


@query("duplicate_count")
def q_duplicate_count(spark, sf):
    docs = tb.table(spark, sf, "documents").drop("doc_id")
    return qa.duplicate_count(docs)


@query("unique_violations")
def q_unique_violations(spark, sf):
    return qa.unique_violations(tb.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("null_violations")
def q_null_violations(spark, sf):
    docs = tb.table(spark, sf, "documents").select("doc_id", "lang", "source")
    labelled = docs.join(tb.table(spark, sf, "labels"), "doc_id", "left")
    return qa.null_violations(labelled, ["doc_id", "lang", "source", "quality", "toxic"])


@query("type_violations")
def q_type_violations(spark, sf):
    orders = tb.table(spark, sf, "orders")
    return qa.type_violations(orders, "o_orderkey", {"o_orderpriority": ("varchar", 8),
                                                     "o_orderstatus": ("char", 1)})


@query("date_violations")
def q_date_violations(spark, sf):
    """Dates written as text, some of them on days that a month does not have."""
    day = F.date_format("o_orderdate", "dd").cast("int") + F.pmod("o_orderkey", F.lit(4)).cast("int")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad(day.cast("string"), 2, "0"))
    return qa.type_violations(tb.table(spark, sf, "orders").withColumn("due", text), "o_orderkey", {"due": ("date",)})


@query("partition_counts")
def q_partition_counts(spark, sf):
    return qa.partition_counts(tb.table(spark, sf, "orders"), "o_orderdate",
                               FIRST_UPPER, LAST_LOWER)


def _partitioned_orders(spark, sf):
    path = fs.fresh_path(spark, "orders-by-year")
    cols = tb.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    fs.write_year_partitioned(cols, path, "o_orderdate", FIRST_UPPER, LAST_LOWER)
    return path


@query("partitioned_roundtrip")
def q_partitioned_roundtrip(spark, sf):
    path = _partitioned_orders(spark, sf)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderdate",
                                           F.col("part_year").cast("int").alias("part_year"))


@query("pruned_read")
def q_pruned_read(spark, sf):
    path = _partitioned_orders(spark, sf)
    rows = fs.read_date_range(spark, path, "o_orderdate", "1997-01-01", "1997-12-31",
                              FIRST_UPPER, LAST_LOWER)
    return rows.select("o_orderkey", "o_orderdate", F.col("part_year").cast("int").alias("part_year"))


@query("partitions_read")
def q_partitions_read(spark, sf):
    path = _partitioned_orders(spark, sf)
    rows = fs.read_date_range(spark, path, "o_orderdate", "1997-01-01", "1997-12-31",
                              FIRST_UPPER, LAST_LOWER)
    year = F.regexp_extract("file", "part_year=([0-9]+)", 1).cast("int").alias("part_year")
    return fs.partitions_read(rows).select(year).distinct()


@query("point_lookup")
def q_point_lookup(spark, sf):
    return fs.point_lookup(tb.table(spark, sf, "customer"), "c_name", "Customer#000000005")


@query("typed_table_append")
def q_typed_table_append(spark, sf):
    name = f"suppliers_typed_{uuid.uuid4().hex[:8]}"
    fs.create_typed_table(spark, name, "s_suppkey BIGINT, s_name VARCHAR(30), "
                          "s_nation CHAR(4), s_acctbal DOUBLE",
                          fs.fresh_path(spark, "typed"))
    sup = tb.table(spark, sf, "supplier")
    fs.append_rows(spark, name, sup.select("s_suppkey", "s_name",
                                           F.col("s_nationkey").cast("string"), "s_acctbal"))
    rows = spark.table(name).select("*")
    out = cut_lineage(rows)
    spark.sql(f"DROP TABLE {name}")  # the catalog is left as it was
    return out


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    customer = tb.table(spark, sf, "customer")
    path = fs.fresh_path(spark, "customer-csv")
    customer.write.option("header", True).csv(path)
    return fs.read_csv(spark, path, customer.schema)


@query("typed_database")
def q_typed_database(spark, sf):
    """A database with a typed table: rows that fit are kept, an over-long value is refused."""
    sup = tb.table(spark, sf, "supplier")
    with fs.database(spark, f"quarry_{uuid.uuid4().hex[:8]}") as db:
        name = fs.create_typed_table(spark, f"{db}.suppliers", "s_suppkey BIGINT, s_name VARCHAR(18), s_nation CHAR(4)")
        fs.append_rows(spark, name, sup.select("s_suppkey", "s_name", F.col("s_nationkey").cast("string")))
        long = fs.refused(spark, name, sup.select("s_suppkey", F.concat("s_name", F.lit("!")), F.lit("x")))
        wide = fs.refused(spark, name, sup.select("s_suppkey", "s_name", F.lit("abcde")))
        out = cut_lineage(spark.table(name).withColumns({"long_name_refused": F.lit(long), "long_code_refused": F.lit(wide)}))
    return out


@query("csv_checked")
def q_csv_checked(spark, sf):
    """A file with inferred types, some lines of which have a wrong number or a missing field."""
    c = tb.table(spark, sf, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name",
                       F.when(F.col("c_custkey") % 211 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")),
                       F.when(F.col("c_custkey") % 307 != 0, F.col("c_mktsegment")))
    path = fs.fresh_path(spark, "customer-lines")
    header = "c_custkey,c_name,c_nationkey,c_mktsegment"

    def with_header(batches):  # every file begins with one
        for i, batch in enumerate(batches):
            if not i:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    c.select(line.alias("value")).mapInArrow(with_header, "value string").write.text(path)
    return fs.read_csv_checked(spark, path)


@query("export_indexed")
def q_export_indexed(spark, sf):
    orders = tb.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    path = fs.export(orders, fs.fresh_path(spark, "orders-export"), fmt="parquet",
                     index_by=["o_orderkey"])
    return spark.read.parquet(path)


@query("head_n")
def q_head_n(spark, sf):
    return fs.head(tb.table(spark, sf, "orders"), ["o_orderkey"], 10)


@query("tail_n")
def q_tail_n(spark, sf):
    return fs.tail(tb.table(spark, sf, "orders"), ["o_orderkey"], 10)


@query("row_index")
def q_row_index(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = tb.table(spark, sf, "lineitem").select(*keys, "l_quantity")
    return fs.with_row_index(lines, [*keys, "l_quantity"])
