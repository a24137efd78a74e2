"""Large tables of a bundle are written in ranges."""

import pytest

from joinlift.sources import lake


@pytest.mark.parametrize("task_rows", [50, 1_000_000])
def test_tables_are_whole_and_in_order(spark, tmp_path, monkeypatch, task_rows):
    monkeypatch.setattr(lake, "TASK_ROWS", task_rows)
    ranges = []
    plain = lake._ranges
    monkeypatch.setattr(lake, "_ranges", lambda *a: ranges.extend(plain(*a)) or ranges)
    sizes = {"a large": 400, "b": 30, "c large": 120, "d": 1}
    lines = [(d, i, f'{d},"{i}\n x"' if i else "id,kind") for d, n in sizes.items() for i in range(n)]
    rows = spark.createDataFrame([lines[i * 7 % len(lines)] for i in range(len(lines))], "dataset_id string, row_ord long, line string").repartition(5)
    docs = spark.createDataFrame([(d, "{}", None) for d in sizes], "dataset_id string, doc string, problem string")
    lake.write_bundles(rows, docs, str(tmp_path / "out"))
    for d in sizes:
        text = (tmp_path / "out" / d / lake.TABLE_FILE).read_text()
        assert text == "".join(line + "\n" for name, _, line in sorted(lines) if name == d)
    found = {r["dataset_id"]: len(r["files"]) for f in ranges for r in f.collect()}
    assert set(found) == ({"a large", "c large"} if task_rows == 50 else set())
    assert all(n > 1 for n in found.values())
