"""Readers on small files written by the test."""

import json

import pytest
from pyspark.sql import functions as F

from joinlift.sources import lake


@pytest.fixture(scope="module")
def bundle(tmp_path_factory):
    root = tmp_path_factory.mktemp("bundles")
    columns = [("id", ["integer"]), ("size", ["real"]), ("kind", ["categorical"]), ("price", ["real"]), ("n", ["integer"])]
    doc = {"dataResources": [{"resID": "learningData", "resPath": "tables/learningData.csv", "columns": [
        {"colIndex": i, "colName": c, "colType": t} for i, (c, t) in enumerate(columns)]}]}
    problem = {"about": {"taskType": "regression"}, "inputs": {"data": [{"targets": [{"colIndex": 3, "colName": "price"}]}]}}
    text = 'id,size,kind,price,n\n1,2.5,"a,b",10,4\n2,x,"say ""hi""",11,5\n3,,c,12,6\n'

    def write(name, nested, d=doc, p=problem, t=text):
        base = root / name
        tables = base / f"{name}_dataset" / "tables" if nested else base
        docs, probs = (base / f"{name}_dataset", base / f"{name}_problem") if nested else (base, base)
        for folder in (tables, docs, probs):
            folder.mkdir(parents=True, exist_ok=True)
        (tables / "learningData.csv").write_text(t)
        (docs / "datasetDoc.json").write_text(json.dumps(d, indent=1))
        if p:
            (probs / "problemDoc.json").write_text(json.dumps(p))
    write("nested", True)
    one_type = json.loads(json.dumps(doc))
    for c in one_type["dataResources"][0]["columns"]:
        c["colType"] = c["colType"][0]
    write("flat", False, d=one_type)
    write("noproblem", True, p=None)
    write("classes", True, p={**problem, "about": {"taskType": "classification"}})
    write("twice", True, d={"dataResources": doc["dataResources"] * 2})
    write("texttarget", True, p={**problem, "inputs": {"data": [{"targets": [{"colIndex": 2}]}]}})
    write("short", True, t="id,size,kind,price,n\n1,2,a,3,4\n")
    return str(root)


def test_bundle_cells(spark, bundle):
    cells, meta = lake.read_bundle(spark, bundle)
    got = cells.where("dataset_id in ('nested', 'flat')").toPandas()
    assert set(got.col) == {"id", "size", "price", "n"}
    for _, part in got.groupby("dataset_id"):
        at = part.sort_values("row_ord").groupby("col").v.apply(list)
        assert at["price"] == [10.0, 11.0, 12.0] and at["size"][0] == 2.5
        assert part[part.col == "size"].v.isna().sum() == 2
    types = meta.where("dataset_id = 'flat'").select(F.get("col_type", F.lit(0))).collect()
    assert {r[0] for r in types} == {"integer", "real", "categorical"}


def test_bundle_gate(spark, bundle):
    files = lake.bundle_files(spark, bundle)
    counts = lake.table_lines(spark, bundle).groupBy("dataset_id").agg((F.count("*") - 1).alias("n_rows"))
    gated = lake.gate(files, lake.columns_meta(spark, bundle), lake.problems(spark, bundle), counts,
                      min_rows=2, max_columns=30)
    got = {r["dataset_id"]: r["reject_reason"] for r in gated.collect()}
    assert got == {"nested": None, "flat": None, "noproblem": "missing files", "classes": "not a regression",
                   "twice": "several tables", "texttarget": "target not numeric", "short": "too few rows"}
    assert {r["reject_reason"]: r["n_datasets"] for r in lake.gate_counts(gated).collect()}["accepted"] == 2


def test_candidate_folder(spark, tmp_path):
    (tmp_path / "rain.csv").write_text("time,amount\n2020-01-01,1.5\n2020-01-02,inf\n2020-01-03,\n,\n")
    (tmp_path / "bikes.csv").write_text("time,count\n2020-01-01,7\n")
    got = lake.read_candidates(spark, str(tmp_path), "time", rename=True).toPandas().set_index(["dataset_id", "row_key"]).v
    assert dict(got) == {("rain", "2020-01-01"): 1.5, ("rain", "2020-01-02"): 0.0, ("rain", "2020-01-03"): 0.0,
                         ("bikes", "2020-01-01"): 7.0}


def test_records_and_stages(spark, tmp_path):
    line = {"query_dataset": "q", "target": "t", "candidate_dataset": "c", "imputation_strategy": "mean", "extra": 1,
            "mean_absolute_error": [2.0, 1.0], "mean_squared_error": [4.0, 1.0], "median_absolute_error": [1.0, 1.0],
            "r2_score": [0.5, 0.75]}
    (tmp_path / "r.json").write_text(json.dumps(line) + "\n\n")
    row = lake.record_pairs(lake.read_records(spark, str(tmp_path / "r.json"))).first()
    assert row["r2_after"] == 0.75 and row["mae_before"] == 2.0 and row["mark"] is None
    made = []
    def make():
        made.append(1)
        return spark.range(3)
    assert lake.stage(spark, str(tmp_path / "s"), make).count() == 3
    assert lake.stage(spark, str(tmp_path / "s"), make).count() == 3 and len(made) == 1


def test_content_ids_ignore_names_and_order(spark):
    rows = [("a", "1", "x", 1.0), ("a", "2", "x", 2.0), ("b", "2", "x", 2.0), ("b", "1", "x", 1.0), ("c", "1", "x", 1.5)]
    ids = lake.content_ids(spark.createDataFrame(rows, "dataset_id string, row_key string, col string, v double"))
    got = {r["dataset_id"]: r["content_id"] for r in ids.collect()}
    assert got["a"] == got["b"] != got["c"]
    records = spark.createDataFrame([("a", "c")], "query_dataset string, candidate_dataset string")
    out = lake.rename_to_ids(records, ids, ["query_dataset", "candidate_dataset"]).first()
    assert out["query_dataset"] == got["a"] and out["candidate_dataset"] == got["c"]


def test_cells_are_written_by_bucket(spark, tmp_path):
    cells = spark.createDataFrame([("a", "1", "x", 1.0), ("b", "1", "x", 2.0)], "dataset_id string, row_key string, col string, v double")
    lake.write_cells(cells, str(tmp_path / "cells"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "cells")).drop("bucket").count() == 2


def test_records_over_many_ranges(spark, tmp_path):
    """Quoted line breaks across the borders of small ranges, beside plain and broken files."""
    import csv
    import io
    from joinlift.sources import records

    def text(rows):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        return out.getvalue()
    hard = [["a", "b"]] + [[str(i), f'x "{i}"\n\n,tail {"y" * (i % 90)}\n' if i % 3 else f"plain {i}"] for i in range(400)]
    plain = [["a", "b"]] + [[str(i), f"p{i}"] for i in range(300)]
    (tmp_path / "hard.csv").write_text(text(hard))
    (tmp_path / "plain.csv").write_text(text(plain) + "\n\n")
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = records.text_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert lines.select("path", "at").distinct().count() > 30
    found, files = records.records(lines)
    got = {}
    for r in found.select("path", "row_ord", records.csv_fields(F.col("record")).alias("f")).orderBy("path", "row_ord").collect():
        assert r["row_ord"] == len(got.setdefault(r["path"].rsplit("/", 1)[1], []))
        got[r["path"].rsplit("/", 1)[1]].append(list(r["f"]))
    assert got == {"hard.csv": hard, "plain.csv": plain}
    state = {r["path"].rsplit("/", 1)[1]: (r["n_records"], r["problem"]) for r in files.collect()}
    assert state == {"hard.csv": (401, None), "plain.csv": (301, None), "open.csv": (0, "unclosed quote")}


def test_what_became_of_candidate_files(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("﻿time;x\n1;2\n1;3\n;\n")
    (tmp_path / "b+c.csv").write_text('x;"day"\n5;"1\n2"\n')
    (tmp_path / "none.csv").write_text("x;y\n1;2\n")
    (tmp_path / "only.csv").write_text("time\n1\n")
    (tmp_path / "empty.csv").write_text("\n\n")
    (tmp_path / "open.csv").write_text('time;x\n1;"2\n')
    keys = spark.createDataFrame([(n, "day" if n == "b+c" else "time") for n in ("a b", "b+c", "none", "only", "empty", "open")], "dataset_id string, key string")
    cells, files = lake.ingest_candidates(spark, str(tmp_path), keys, sep=";", row_id=True)
    assert {r["dataset_id"]: (r["n_rows"], r["reason"]) for r in files.collect()} == {
        "a b": (3, None), "b+c": (1, None), "none": (1, "no key column"), "only": (1, "no value column"), "empty": (-1, "empty file"), "open": (-1, "unclosed quote")}
    assert sorted(tuple(r) for r in cells.collect()) == [("a b", "1", "1", "x", 2.0), ("a b", "2", "1", "x", 3.0), ("b+c", "1", "1\n2", "x", 5.0)]
    base = lake.read_base(spark, str(tmp_path / "a b.csv"), "time", "base", sep=";", row_id=True)
    assert sorted((r["row_id"], r["row_key"], r["v"]) for r in base.where("row_key is not null").collect()) == [("1", "1", 2.0), ("2", "1", 3.0)]
    with pytest.raises(ValueError):
        lake.read_candidates(spark, str(tmp_path), "nowhere", sep=";")


def test_compressed_records_are_read_again(spark, tmp_path):
    records = spark.createDataFrame([(f"q{i}", "t", f"c{i}", None, "positive", [0.5, 0.25 * i]) for i in range(500)],
                                    "query_dataset string, target string, candidate_dataset string, imputation_strategy string, mark string, r2_score array<double>")
    sizes, found = [], []
    for how in ("none", "gzip"):
        path = str(tmp_path / how)
        lake.write_records(records, path, how)
        sizes.append(sum(f.stat().st_size for f in (tmp_path / how).glob("part-*")))
        found.append(sorted(map(str, lake.read_records(spark, path).collect())))
    assert found[0] == found[1] and len(found[0]) == 500 and sizes[1] * 4 < sizes[0]
