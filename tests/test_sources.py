"""Register files, yearly files, case files and exports on synthetic folders."""

import json

import pytest
from pyspark.sql import functions as F

from panelwright.plans import registry as plan
from panelwright.sources import cases as C, registers as R, sinks
from panelwright.sources.headers import file_heads, records_end

SUB = ["Monthly Doses Taken", "Cumulative Doses Taken", "Monthly Missed Doses", "%Adherence", "Weight", "Height",
       "Smear/TB Lamp", "Xpert MTB/RIF"]


def register_text(core, steps, rows):
    top = core + [h for i in range(steps) for h in ([f"Month {i}"] + [""] * 7)]
    sub = [""] * len(core) + SUB * steps
    body = [",".join('"' + str(v).replace('"', '""') + '"' if "," in str(v) else str(v) for v in r) for r in rows]
    blank = "," * (len(top) - 1)
    return "﻿" + "\n".join([",".join(top), ",".join(sub), *body, blank, blank]) + "\n"


CORE = ["No.", "Sex", "Age", "", "Date of Birth", "Weight", "Blood Pressure", "O2 Sat", "Outcome", "Co-morbidities"]


def person(no, sex, age, born, outcome, month0, extra=()):
    return [no, sex, age, "", born, "45kg", "120/80", "0.95", outcome, "dm; htn, odd", *extra, *month0]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("registers")
    step = ["20", "20", "1", "95.2%", "45kgs", "150 cm", "Negative", "not detected"]
    later = ["10", "15", "30", "0.5", "46", "", "1+", ""]
    (base / "AtokTrail - 2023.csv").write_text(
        register_text(CORE, 2, [person(1, "M", "45.4", "1/2/2063", "Cured", step + later),
                                person(2, "F", "30", "3/4/1990", "LTFU", step + [""] * 8)]), "utf-8")
    (base / "Pinsao - 2024.csv").write_text(
        register_text(CORE + ["Nationality"], 3, [person(7, "4", "200", "", "x", step + later + later, ["FILIPINO"])]), "utf-8")
    (base / "no year.csv").write_text(register_text(CORE, 1, []), "utf-8")
    return str(base)


def test_catalog(spark, folder):
    catalog = R.file_catalog(spark, folder)
    got = {r["source_file"]: (r["facility"], r["data_year"]) for r in catalog.collect()}
    assert got == {"AtokTrail - 2023.csv": ("Atok Trail", 2023), "Pinsao - 2024.csv": ("Pinsao", 2024),
                   "no year.csv": (None, None)}
    assert [r["source_file"] for r in R.rejected_files(catalog).collect()] == ["no year.csv"]
    assert len(R.layouts(catalog)) == 2
    assert R.layout_drift(catalog).count() == 3


def test_read_registers(spark, folder):
    df = R.read_registers(spark, folder)
    rows = {r["No."]: r.asDict() for r in df.collect()}
    assert set(rows) == {"1", "2", "7"}
    assert rows["1"]["M0_%Adherence"] == "95.2%" and rows["1"]["M1_Monthly Doses Taken"] == "10"
    assert rows["2"]["M1_Weight"] is None and rows["1"]["M2_Weight"] is None and rows["7"]["M2_Weight"] == "46"
    assert rows["7"]["Nationality"] == "FILIPINO" and rows["1"]["Nationality"] is None
    assert rows["1"]["Co-morbidities"] == "dm; htn, odd" and rows["1"]["facility"] == "Atok Trail"
    assert rows["7"]["data_year"] == 2024 and "col_3" in df.columns


def test_clean_registers(spark, folder):
    static, panel = plan.clean_registers(R.read_registers(spark, folder))
    rows = {r["no"]: r.asDict() for r in static.collect()}
    one = rows["1"]
    assert one["sex"] == "Male" and one["age"] == 45 and one["weight_kg"] == 45.0 and one["weight"] == "45.0 kg"
    assert (one["bp_systolic"], one["bp_diastolic"], one["o2_sat"]) == (120.0, 80.0, 95.0)
    assert one["outcome"] == "Cured" and one["co_morbidities"] == "Diabetes Mellitus, Hypertension, Odd"
    assert str(one["date_of_birth"]) == "1963-01-02"
    assert rows["7"]["sex"] is None and rows["7"]["age"] == 110
    assert static.select("patient_id").distinct().count() == 3 and panel.count() == 39
    cells = {(r["no"], r["step"]): r for r in panel.join(static.select("patient_id", "no"), "patient_id").collect()}
    first = cells[("1", 0)]
    assert first["pct_adherence"] == pytest.approx(0.952) and first["weight"] == 45.0 and first["height"] == 150.0
    assert first["smear_tb_lamp"] == 0.0 and cells[("1", 1)]["smear_tb_lamp"] == 1.0
    assert cells[("1", 5)]["weight"] is None


def test_yearly(spark, tmp_path):
    for year, rows in {2015: ["1,No Data,CURED", "No., Age ,Outcome/Status"], 2016: ["2,33,DIED"]}.items():
        (tmp_path / f"study_{year}.csv").write_text("No., Age ,Outcome/Status\n" + "\n".join(rows) + "\n")
    df = R.read_yearly(spark, str(tmp_path), header_column="Outcome/Status")
    got = {r["No."]: (r["Age"], r["Outcome/Status"], r["year"]) for r in df.collect()}
    assert got == {"1": (None, "CURED", 2015), "2": ("33", "DIED", 2016)}


def test_yearly_features(spark):
    df = spark.createDataFrame(
        [(2020, "1/1/2020", "1/5/2020", "6/1/2021", None, "3/3/1980", "1+", "MTB not detected"),
         (2020, "1/1/2020", "12/1/2019", "2/1/2020", "40", None, "zz", None)],
        "year int, date_of_screening string, date_of_diagnosis string, date_started_tx string, age string, birthdate string, "
        "microscopy_result string, rdt_result string")
    a, b = plan.yearly_features(df).collect()
    assert (a["diagnosis_month"], a["diagnosis_season"], a["days_screening_to_diagnosis"]) == (1, "Tag-lamig", 4)
    assert a["days_to_treatment"] is None and b["days_to_treatment"] == 62 and b["days_screening_to_diagnosis"] is None
    assert (a["age_final"], b["age_final"]) == (40.0, 40.0)
    assert (a["microscopy_result"], b["microscopy_result"], a["rdt_result"]) == ("1+", "Unknown", "Not_Detected")


def test_cases(spark, tmp_path):
    (tmp_path / "case_a.json").write_text(json.dumps({"patient_id": "A", "explanation": "e", "shap_values": {"Age": 0.5}}, indent=1))
    (tmp_path / "case_b.json").write_text(json.dumps({"explanation": "f"}))
    (tmp_path / "runtime_c.json").write_text(json.dumps({"patient_id": "C", "timestamp": "t1", "shap_values": {}}))
    got = {r["case_id"]: r for r in C.read_cases(spark, str(tmp_path)).collect()}
    assert set(got) == {"A", "case_b"} and got["case_b"]["attributions"] == {}
    assert [tuple(r) for r in C.attribution_rows(C.read_cases(spark, str(tmp_path))).collect()] == [("A", "Age", 0.5)]
    run = C.read_cases(spark, str(tmp_path), "runtime").collect()
    assert [(r["case_id"], r["timestamp"], r["explanation"]) for r in run] == [("C", "t1", "")]
    with pytest.raises(Exception, match="case_b"):
        C.read_cases(spark, str(tmp_path), require_values=True).collect()
    with pytest.raises(ValueError):
        C.read_cases(spark, str(tmp_path), "other")


def test_broken_case_names_its_file(spark, tmp_path):
    (tmp_path / "case_bad.json").write_text("{nope")
    with pytest.raises(Exception, match="case_bad"):
        C.read_cases(spark, str(tmp_path)).collect()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 45.0, 2.345)], "id int, weight double, x double").withColumn(
        "d", F.lit("2024-02-01").cast("date"))
    shown = sinks.readable(df, {"weight": "kg"}).first()
    assert tuple(shown) == (1, "45.0 kg", 2.34, "02/01/2024")
    sinks.write_csv(sinks.readable(df), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["d"] == "02/01/2024"
    sinks.write_parquet(df, str(tmp_path / "pq"), ["id"])
    assert spark.read.parquet(str(tmp_path / "pq")).first()["x"] == 2.345
    rolled = spark.createDataFrame([("p", "Age", 0.5, 0.5, "+", 1)],
        "case_id string, group string, signed_sum double, abs_sum double, sign string, members long")
    docs = sinks.case_documents(spark.createDataFrame([("p", "text")], "case_id string, explanation string"), rolled, "blind", 6)
    sinks.write_cases(docs, str(tmp_path / "cases"))
    back = spark.read.json(str(tmp_path / "cases")).first()
    assert back["shap_values"]["Age"] == 0.5 and back["condition"] == "blind" and back["month_of_prediction"] == 6
    assert sinks.run_manifest(docs, {"k": "5"}).first()["cases"] == 1


def test_nested_documents(spark):
    people = spark.createDataFrame([(1,), (2,)], "id int")
    notes = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, t int, v string")
    docs = {r["id"]: r["notes"] for r in C.nested_documents(people, "id", [C.child_array(notes, "id", ["t"], ["v"], "notes")]).collect()}
    assert [tuple(x) for x in docs[1]] == [(1, "a"), (2, "b")] and docs[2] is None


def test_landing_twice_keeps_the_runs_apart(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "a int, b int")
    first = R.land([a, b], str(tmp_path / "land"))
    second = R.land([a], str(tmp_path / "land"))
    assert first.count() == 2 and [tuple(r) for r in second.collect()] == [(1,)]


def test_equal_register_rows_are_entities_of_their_own(spark, folder):
    rows = R.read_registers(spark, folder)
    static, panel = plan.clean_registers(rows.unionByName(rows))
    assert static.select("patient_id").distinct().count() == 6 and panel.count() == 78
    assert panel.groupBy("patient_id", "step").count().filter("count > 1").count() == 0


def test_a_large_files_header_costs_a_few_kilobytes(spark, tmp_path):
    folder = tmp_path / "big"
    folder.mkdir()
    line = ",".join(["x" * 30] * 30) + "\n"
    with open(folder / "Asin - 2023.csv", "w", encoding="utf-8") as f:
        f.write("\ufeffNo.,\"Name\nof unit\",Month 0,\r\n,,Weight,Height\n")
        f.writelines([line] * (100_000_000 // len(line)))
    (folder / "Empty - 2024.csv").write_text("")
    (folder / "Short - 2024.csv").write_text("No.,Sex")
    heads = {r.file_path.rsplit("/", 1)[1].replace("%20", " "): r for r in file_heads(spark, str(folder), 2).collect()}
    big = heads["Asin - 2023.csv"]
    assert big.length > 99_000_000 and big.bytes_read < 64 << 10 and big.records == 2
    assert "Empty - 2024.csv" not in heads and (heads["Short - 2024.csv"].head, heads["Short - 2024.csv"].records) == ("No.,Sex", 1)
    found = {r.source_file: r for r in R.file_catalog(spark, str(folder)).collect()}
    assert sorted(found) == ["Asin - 2023.csv", "Short - 2024.csv"] and found["Asin - 2023.csv"].second == ",,Weight,Height"
    assert R.parse_head(found["Asin - 2023.csv"].head) == (("No.", "Name\nof unit"), ("Weight", "Height"), 1, 4)


def test_records_end_outside_quotes():
    assert records_end('a,"b\nc"\nd', 1) == (7, 1) and records_end("a", 1) == (-1, 0) and records_end('"a""\n"\n', 1) == (6, 1)


def test_scanned_heads_agree_with_opened_ones(spark, tmp_path, monkeypatch):
    for name, text in (("A - 2023.csv", "No.,Month 0\n,Weight\n1,2\n"), ("B+ - 2024.csv", "No.,Month 0\n,Height\n")):
        (tmp_path / name).write_text(text)
    rows = lambda: sorted(map(tuple, R.file_catalog(spark, str(tmp_path)).drop("path").collect()))
    opened = rows()
    monkeypatch.setattr(R, "opens_directly", lambda *a: False)
    assert rows() == opened and len(opened) == 2
