"""Source queries: tables written out as register, yearly or case files and read back."""

from uuid import uuid4

from pyspark.sql import functions as F

from panelwright.catalog.attribution import explanations
from panelwright.catalog.inputs import ATTRIBUTIONS, ORDER_PANEL, attributions, order_panel, r6
from panelwright.catalog.registry import query
from panelwright.operators.panel import panel_to_wide, wide_to_panel
from panelwright.functions.parsing import to_number
from panelwright.functions.text import standardize_columns
from panelwright.session import ensure_checkpoint_dir
from panelwright.sources import cases as C, registers as R
from panelwright.sources.tables import read_table

_BLOCK = ("n_orders", "urgent")


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid4().hex}"


def write_registers(spark, folder, path):
    """The order panel as register files: one source per nation and start year, two header rows
    in every part file. Sources are cut into parts by customer, so a large one is many files."""
    wide = panel_to_wide(order_panel(spark, folder), "entity_id", list(_BLOCK))
    people = read_table(spark, folder, "customer").join(
        read_table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    )
    year = F.when(F.col("c_acctbal") < 4000, "2023").otherwise("2024")
    cells = [F.col("c_custkey").cast("string"), F.col("c_mktsegment")] + [
        F.coalesce(F.col(f"m{s}_{m}").cast("string"), F.lit("")) for s in range(13) for m in _BLOCK
    ]
    rows = people.join(wide, F.col("entity_id") == F.col("c_custkey")).select(
        F.concat("n_name", F.lit(" - "), year, F.lit(".csv")).alias("source"),
        F.pmod("c_custkey", F.lit(4)).alias("part"),
        F.lit(2).alias("line"), F.array(*cells).alias("cells"),
    )
    top = ["No.", "Segment"] + [h for s in range(13) for h in (f"Month {s}", "")]
    sub = ["", ""] + list(_BLOCK) * 13
    heads = rows.select("source", "part").distinct().select(
        "source", "part", F.explode(F.array(*[
            F.struct(F.lit(i).alias("line"), F.array(*[F.lit(x) for x in h]).alias("cells"))
            for i, h in enumerate((top, sub))
        ])).alias("h"),
    ).select("source", "part", "h.line", "h.cells")
    both = heads.unionByName(rows).repartition("source", "part").sortWithinPartitions("source", "part", "line")
    # A task may hold several parts of one source; each must open its own file.
    flat = both.select("source", "part", *[F.col("cells")[i].alias(f"c{i}") for i in range(len(top))])
    flat.write.partitionBy("source", "part").option("emptyValue", "").csv(path)


@query("S1", "S2", "S3", "S5", "S6", "S8", "S9", "X1", sql=f"""
WITH {ORDER_PANEL}
SELECT p.entity_id, p.step, p.n_orders, p.urgent, n_name AS facility,
       CASE WHEN c_acctbal < 4000 THEN 2023 ELSE 2024 END AS data_year
FROM order_panel p JOIN customer ON c_custkey = p.entity_id JOIN nation ON n_nationkey = c_nationkey""")
def register_files(spark, folder):
    path = _folder(spark)
    write_registers(spark, folder, path)
    wide = standardize_columns(R.read_registers(spark, path, by_folder=True))
    numbers = {c: to_number(F.col(c)) for c in wide.columns if c.startswith("m")}
    wide = wide.withColumns(numbers).withColumn("entity_id", F.col("no").cast("long"))
    static, panel = wide_to_panel(wide, "entity_id")
    return panel.join(static.select("entity_id", "facility", "data_year"), "entity_id")


_STEPS = (0, 1, 13)


@query("P3", "P4", "P5", "P18", "X1", "S7", sql="""
WITH c AS (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT c_custkey AS no, CAST(least(18 + c_custkey % 120, 110) AS BIGINT) AS age,
        CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS sex, CAST(100 + c_nationkey AS DOUBLE) AS bp_systolic,
        unnest(range(14))::INTEGER AS step FROM c)
SELECT no, age, sex, bp_systolic, step,
  CASE WHEN step IN (0, 1, 13) AND (no + step) % 5 <> 0 THEN least(180, 40 + (no + step) % 30 * 10)::DOUBLE END AS weight,
  CASE WHEN step IN (0, 1, 13) THEN CASE WHEN (no + step) % 100 <= 1 THEN (no + step) % 100 ELSE (no + step) % 100 / 100.0::DOUBLE END END AS pct_adherence, count(*) AS entities
FROM r GROUP BY ALL""")
def clean_register_rows(spark, folder):
    """Customers as raw register rows, some repeated and with a thirteenth month, cleaned."""
    from panelwright.plans.registry import clean_registers

    people = read_table(spark, folder, "customer")
    people = people.unionByName(people.filter("c_custkey % 3 = 0"))
    no = F.col("c_custkey")
    weight = lambda s: F.when((no + s) % 5 != 0, F.concat((40 + (no + s) % 30 * 10).cast("string"), F.lit("kgs")))
    raw = people.select(
        no.cast("string").alias("No."), (18 + no % 120).cast("string").alias("Age"),
        F.get(F.array(F.lit(" m "), F.lit("Female"), F.lit("4")), (no % 3).cast("int")).alias("Sex"),
        F.concat((100 + F.col("c_nationkey")).cast("string"), F.lit(" / 80")).alias("Blood Pressure"),
        *[weight(s).alias(f"M{s}_Weight") for s in _STEPS],
        *[F.concat(((no + s) % 100).cast("string"), F.lit("%")).alias(f"M{s}_%Adherence") for s in _STEPS],
        F.lit("x.csv").alias("source_file"),
    )
    static, panel = clean_registers(raw)
    rows = static.select("patient_id", F.col("no").cast("long").alias("no"), "age", "sex", "bp_systolic").join(panel, "patient_id")
    columns = ["no", "age", "sex", "bp_systolic", "step", "weight", "pct_adherence"]
    return rows.groupBy(*columns).agg(F.count_distinct("patient_id").alias("entities"))


@query("S3", "S2", sql="""
SELECT n_name || ' - ' || CASE WHEN c_acctbal < 4000 THEN '2023' ELSE '2024' END || '.csv' AS source_file, n_name AS facility,
       CASE WHEN c_acctbal < 4000 THEN 2023 ELSE 2024 END AS data_year, count(DISTINCT c_custkey % 4) AS parts
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1, 2, 3""")
def register_catalog(spark, folder):
    path = _folder(spark)
    write_registers(spark, folder, path)
    return R.file_catalog(spark, path, by_folder=True).groupBy("source_file", "facility", "data_year").agg(
        F.count(F.lit(1)).alias("parts")
    )


@query("S2", sql="""
SELECT count(*) AS files, min(n_name || ' - ' || CASE WHEN c_acctbal < 4000 THEN '2023' ELSE '2024' END || '.csv') AS example
FROM (SELECT DISTINCT n_name, c_acctbal < 4000 AS early, c_custkey % 4 AS part, min(c_acctbal) AS c_acctbal
      FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1, 2, 3)""")
def register_drift(spark, folder):
    """Files per second header row: more than one line means that the files' blocks differ."""
    path = _folder(spark)
    write_registers(spark, folder, path)
    return R.layout_drift(R.file_catalog(spark, path, by_folder=True)).select("files", "example")


@query("S3", sql="""
SELECT 'notes ' || n_nationkey || '.csv' AS source_file, 'no year in file name' AS reason FROM nation""")
def register_rejects(spark, folder):
    """Files whose name carries no year are left out of the table and listed."""
    path = _folder(spark)
    write_registers(spark, folder, path)
    strays = read_table(spark, folder, "nation").select(
        F.concat(F.lit("notes "), F.col("n_nationkey").cast("string"), F.lit(".csv")).alias("source"), "n_name")
    strays.write.partitionBy("source").mode("append").csv(path)
    return R.rejected_files(R.file_catalog(spark, path, by_folder=True)).distinct()


@query("S4", "S7", "S10", sql="""
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority,
       CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def yearly_files(spark, folder):
    path = _folder(spark)
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias(" o_orderkey"),
        F.when(F.col("o_orderpriority") == "5-LOW", "No Data").otherwise(F.col("o_orderpriority")).alias("priority "),
        F.year("o_orderdate").alias("year"),
    )
    # Stray header rows among the data, one per year, as the extracts have them.
    strays = orders.select("year").distinct().select(
        F.lit("o_orderkey").alias(" o_orderkey"), F.lit("priority").alias("priority "), "year"
    )
    orders.unionByName(strays).write.partitionBy("year").option("header", "true").option(
        "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    table = R.read_yearly(spark, path, header_column="priority", by_folder=True)
    return table.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "priority", "year")


@query("S12", "S11", "P39", sql=f"""
WITH {ATTRIBUTIONS}
SELECT CAST(case_id AS VARCHAR) AS case_id, feature, value FROM attributions
WHERE case_id IN (SELECT o_orderkey FROM orders)""")
def case_files(spark, folder):
    path = _folder(spark)
    maps = attributions(spark, folder).groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("shap_values")
    )
    cases = explanations(spark, folder).join(maps, "case_id", "left").withColumn(
        "patient_id", F.col("case_id").cast("string")
    )
    cases.select("patient_id", "explanation", "shap_values").write.json(path)
    read = C.read_cases(spark, path, lines=True, pattern="part-*.json")
    return C.attribution_rows(read).withColumn("value", r6("value"))
