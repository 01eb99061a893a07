"""Registered queries of complete catalogues: orders as split tables, some damaged, tied, older or of another host; each with its SQL.

The SQL never sees the tables' text: it works out from the order lines which tables are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import complete_catalog as cc
from corpusloom.runtime import read_table

RULES = cc.CatalogRules("program", "code", r"7\d{6}", ("tables.example.org",), ("N", "S"))


def order_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a table of a part a line; every odd line is led by a section row. Orders whose number divided by 11 leaves
    0 to 3 are damaged, 5 are of another host; places by the number's parity, years in steps of three, two documents a customer and year."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.floor(F.year("o_orderdate") / 3) * 3).cast("string").alias("y"), F.startswith("o_orderpriority", F.lit("1")).alias("urgent"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = read_table(spark, sf, "lineitem").withColumns({"r": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("l_orderkey"))})
    lines = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("hurt", F.col("o_orderkey") % 11)
    own = F.when(F.col("r") % 2 == 1, 2).otherwise(1)
    end = F.floor(F.col("r") * 3 / 2 + 0.5).cast("int")
    code = F.when((F.col("hurt") == 2) & (F.col("r") == 1), "none").otherwise(F.concat(F.lit("7"), F.lpad((F.col("l_partkey") % 1000000).cast("string"), 6, "0")))
    name = F.concat(F.when((F.col("hurt") == 3) & (F.col("r") == 1), "<b>").otherwise(""), F.lit("Part "), F.col("l_suppkey").cast("string"))
    label = F.concat(F.lit("Flag "), "l_returnflag")
    section = F.when(F.col("r") % 2 == 1, F.concat(F.lit("| I | "), label, F.lit(" | "), label, F.lit(" |\n"))).otherwise("")
    content = F.concat(F.lit("| no | Code | Program name |\n| --- | --- | --- |\n"), section, F.lit("| "), F.col("r").cast("string"), F.lit(" | "), code, F.lit(" | "), name, F.lit(" |"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source_file", "raw_file", "version", "content_hash", "academic_year")]
    return lines.select(
        F.concat_ws("-", "o_orderkey", "r").alias("chunk_id"), content.alias("content"), F.concat_ws("-", "o_custkey", "y", F.col("urgent").cast("string")).alias("doc_id"), F.lit("table").alias("chunk_type"),
        F.concat(F.lit("https://"), F.when(F.col("hurt") == 5, "other").otherwise("tables"), F.lit(".example.org/t")).alias("source_url"), *nothing, F.col("y").alias("admission_year"), F.when(F.col("o_orderkey") % 2 == 0, "N").otherwise("S").alias("campus"),
        F.col("o_orderkey").alias("table_index"), F.col("r").alias("table_part"), (F.col("n") + F.when(F.col("hurt") == 0, 1).otherwise(0)).cast("int").alias("table_part_count"),
        (end - own + 1 + F.when((F.col("hurt") == 1) & (F.col("r") == 2), 1).otherwise(0)).cast("int").alias("row_start"), end.alias("row_end"),
    )


def proved_tables(spark, sf):
    t, _ = cc.proved_tables(order_tables(spark, sf), RULES)
    return t.select("table_index", "declared", "entries", F.coalesce("fault", F.lit("")).alias("fault"))


def _catalog(spark, sf):
    none = F.array().cast("array<int>")
    asked = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    parts = order_tables(spark, sf)
    # a customer's request is answered from the customer's own documents: the place names tell customers apart
    own = parts.withColumn("campus", F.concat_ws("/", F.split_part("doc_id", F.lit("-"), F.lit(1)), "campus"))
    requests = asked.select("query_id", F.array(*(F.concat(F.col("query_id").cast("string"), F.lit(f"/{p}")) for p in RULES.places)).alias("places"), none.alias("asked_years"))
    return cc.complete_catalog(requests, own, RULES)


def complete_catalog(spark, sf):
    return _catalog(spark, sf).select("query_id", "place", "year", "table_index", "entry", "name", "code", F.col("section.label").alias("section"))


def rendered_catalog(spark, sf):
    entries = _catalog(spark, sf)
    chunks = entries.select("query_id", "chunk_id").distinct()
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    return cc.render_catalog(entries, chunks.withColumn("marker", F.row_number().over(order))).select("query_id", "text")


QUERIES = {f.__name__: f for f in (proved_tables, complete_catalog, rendered_catalog)}

_TABLES = """
l AS (SELECT l_orderkey AS k, l_returnflag, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
o AS (SELECT l.*, o_custkey AS cust, o_custkey || '-' || (year(o_orderdate) // 3 * 3) || '-' || starts_with(o_orderpriority, '1') AS doc, year(o_orderdate) // 3 * 3 AS y, k % 11 AS hurt, CASE WHEN k % 2 = 0 THEN 'N' ELSE 'S' END AS p,
  '7' || lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') AS code, 'Part ' || l_suppkey AS name FROM l JOIN orders ON k = o_orderkey),
s AS (SELECT *, 'Flag ' || first_value(l_returnflag) OVER (PARTITION BY k, (r + 1) // 2 ORDER BY r) AS section, k || '-' || ((r + 1) // 2 * 2 - 1) AS section_chunk FROM o),
dup AS (SELECT k, max(n) AS most FROM (SELECT k, section, code, count(*) AS n FROM s WHERE NOT (hurt IN (2, 3) AND r = 1) GROUP BY ALL) GROUP BY k),
t AS (SELECT k, any_value(cust) AS cust, any_value(doc) AS doc, any_value(y) AS y, any_value(p) AS p, any_value(hurt) AS hurt, CAST(any_value(n) AS BIGINT) AS n, any_value(n) + (any_value(n) + 1) // 2 AS declared,
  any_value(n) - CASE WHEN any_value(hurt) IN (2, 3) THEN 1 ELSE 0 END AS entries,
  CASE WHEN any_value(hurt) = 0 THEN 'parts' WHEN any_value(hurt) = 1 AND any_value(n) > 1 THEN 'rows' WHEN any_value(hurt) IN (2, 3) THEN 'broken' WHEN any_value(most) > 1 THEN 'codes' ELSE '' END AS fault FROM s LEFT JOIN dup USING (k) GROUP BY k)"""

_CHOSEN = f"""{_TABLES},
scope AS (SELECT * FROM t WHERE hurt <> 5 AND cust IN (SELECT c_custkey FROM customer)),
new AS (SELECT * FROM scope QUALIFY y = max(y) OVER (PARTITION BY cust)),
wide AS (SELECT * FROM new QUALIFY declared = max(declared) OVER (PARTITION BY doc, p)),
docs AS (SELECT cust, doc, sum(entries) AS entries, list(k) AS ks FROM wide GROUP BY cust, doc HAVING count(*) = 2 AND count(DISTINCT p) = 2 AND bool_and(fault = '')),
best AS (SELECT * FROM docs QUALIFY entries = max(entries) OVER (PARTITION BY cust)),
sig AS (SELECT cust, doc, any_value(b.ks) AS ks, string_agg(p || r || code || name || section, '/' ORDER BY p, r) AS s FROM best b JOIN s USING (cust, doc) WHERE list_contains(b.ks, s.k) GROUP BY cust, doc),
one AS (SELECT cust, any_value(ks) AS ks FROM sig GROUP BY cust HAVING count(DISTINCT s) = 1),
rows AS (SELECT s.*, cust || '/' || p AS place FROM one JOIN s USING (cust) WHERE list_contains(ks, k))"""

ORACLE_SQL = {
    "proved_tables": f"WITH {_TABLES} SELECT k AS table_index, CAST(declared AS INT) AS declared, entries, fault FROM t",
    "complete_catalog": f"WITH {_CHOSEN} SELECT cust AS query_id, place, CAST(y AS INT) AS year, k AS table_index, CAST(r AS INT) AS entry, name, code, section FROM rows",
    "rendered_catalog": f"""WITH {_CHOSEN}, m AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY k || '-' || r) AS marker FROM rows),
b AS (SELECT m.*, CASE WHEN m.r % 2 = 1 THEN CASE WHEN m.r > 1 THEN chr(10) ELSE '' END || '#### ' || section || ' [' || marker || ']' || chr(10) || chr(10) ELSE '' END || '- Programme **' || name || '**, code **' || code || '** [' || marker || '].' AS block FROM m),
t2 AS (SELECT cust, place, '### Programmes of ' || any_value(y) || ', ' || place || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY r) AS text FROM b GROUP BY cust, place)
SELECT cust AS query_id, string_agg(text, chr(10) || chr(10) ORDER BY place) AS text FROM t2 GROUP BY cust""",
}
