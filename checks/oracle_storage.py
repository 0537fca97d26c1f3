"""DuckDB oracles of the source, sink and data-quality queries."""

PART_YEAR = "least(greatest(year(o_orderdate), 1995), 2000)"

SQL = {
    "duplicate_rows": """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5
FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1""",
    "duplicate_count": """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars) t""",
    "unique_violations": """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "null_violations": """
WITH j AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE doc_id IS NULL) AS doc_id,
             count(*) FILTER (WHERE lang IS NULL) AS lang,
             count(*) FILTER (WHERE source IS NULL) AS source,
             count(*) FILTER (WHERE quality IS NULL) AS quality,
             count(*) FILTER (WHERE toxic IS NULL) AS toxic FROM j)
SELECT "column", nulls FROM (UNPIVOT c ON doc_id, lang, source, quality, toxic
                            INTO NAME "column" VALUE nulls)
WHERE nulls > 0""",
    "type_violations": """
SELECT o_orderkey AS key, 'o_orderpriority' AS "column", o_orderpriority AS value,
       'longer than 8' AS reason
FROM orders WHERE length(o_orderpriority) > 8
UNION ALL
SELECT o_orderkey, 'o_orderstatus', o_orderstatus, 'longer than 1'
FROM orders WHERE length(o_orderstatus) > 1""",
    "partition_counts": f"""
SELECT {PART_YEAR} AS part_year, count(*) AS rows FROM orders GROUP BY 1""",
    "partitioned_roundtrip": f"""
SELECT o_orderkey, o_custkey, o_orderdate, CAST({PART_YEAR} AS INTEGER) AS part_year
FROM orders""",
    "partitions_read": f"""
SELECT DISTINCT CAST({PART_YEAR} AS INTEGER) AS part_year FROM orders
WHERE o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""",
    "pruned_read": f"""
SELECT o_orderkey, o_orderdate, CAST({PART_YEAR} AS INTEGER) AS part_year
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""",
    "point_lookup": "SELECT * FROM customer WHERE c_name = 'Customer#000000005'",
    "typed_table_append": """
SELECT s_suppkey, s_name, rpad(CAST(s_nationkey AS VARCHAR), 4, ' ') AS s_nation, s_acctbal
FROM supplier""",
    "csv_roundtrip": "SELECT * FROM customer",
    "export_indexed": """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index, o_orderkey, o_orderdate, o_totalprice
FROM orders""",
    "head_n": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "tail_n": "SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10) t ORDER BY o_orderkey",
    "row_index": """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS index,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
FROM lineitem""",
}

SQL["date_violations"] = """
WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || lpad(
             CAST(day(o_orderdate) + o_orderkey % 4 AS VARCHAR), 2, '0') AS due FROM orders)
SELECT o_orderkey AS key, 'due' AS "column", due AS value, 'not a date' AS reason
FROM t WHERE try_cast(due AS DATE) IS NULL"""
SQL["typed_database"] = """
SELECT s_suppkey, s_name, rpad(CAST(s_nationkey AS VARCHAR), 4, ' ') AS s_nation,
       (SELECT max(length(s_name || '!')) > 18 FROM supplier) AS long_name_refused, true AS long_code_refused
FROM supplier"""
SQL["csv_checked"] = """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 211 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey,
       CASE WHEN c_custkey % 307 <> 0 THEN c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 211 = 0 OR c_custkey % 307 = 0 THEN concat_ws(',', c_custkey, c_name,
            CASE WHEN c_custkey % 211 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END,
            CASE WHEN c_custkey % 307 <> 0 THEN c_mktsegment END) END AS bad_record
FROM customer"""
