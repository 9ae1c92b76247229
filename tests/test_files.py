"""Arrays that are written as their entries come, and work that is done once a row."""

import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quizforge.jobs import file_queries
from quizforge.sources import tables


def test_arrays_are_written_in_order(spark, tmp_path):
    rows = spark.range(500).repartition(7).select(F.concat((F.col("id") % 9).cast("string"), F.lit("/My é+ %/a.json")).alias("name"), "id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit('é"\n').alias("output"))).alias("j"))
    file_queries.write_arrays(rows, f"file://{tmp_path}", "name", "id", "j", '{"results": %s}')
    found = {p.relative_to(tmp_path).as_posix(): json.loads(p.read_bytes()) for p in tmp_path.rglob("*.json")}
    assert found == {f"{k}/My é+ %/a.json": {"results": [{"id": str(i), "output": 'é"\n'} for i in range(k, 500, 9)]} for k in range(9)}
    back = tables.read_outputs(spark, f"file://{tmp_path}")
    assert sorted(int(r.id) for r in back.collect()) == list(range(500)) and back.where("output = 'é\"\n'").count() == 500
    assert "Scan text" not in back._jdf.queryExecution().toString()  # the driver holds no list of the files


def test_a_task_holds_no_file_whole(tmp_path):
    def parts():
        for i in range(100):
            yield pa.RecordBatch.from_pydict({"name": ["a.json"] * 4 + [f"{i}/b.json"], "entry": [json.dumps("x" * 200_000)] * 5})

    tracemalloc.start()
    pool = pa.default_memory_pool()
    before, most = pool.bytes_allocated(), [0]

    def watched():
        for p in parts():
            most[0] = max(most[0], pool.bytes_allocated() - before)
            yield p

    done = list(file_queries._array_writer(f"file://{tmp_path}", b"[", b"]")(watched()))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done[0]["n"].to_pylist() == [500] and most[0] < 8e6 and held < 8e6
    assert all(len(json.loads((tmp_path / f"{i}" / "b.json").read_text())) == 1 for i in range(100))


def test_bodies_of_files_are_handed_on_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "_BODY_BYTES", 1000)
    for i in range(50):
        (tmp_path / f"{i}.json").write_bytes(b"x" * 300 + (b"\xff" if i == 7 else b""))
    files = pa.RecordBatch.from_pydict({"file": [f"file://{tmp_path}/{i}.json" for i in range(50)]})
    got = list(tables._bodies(iter([files])))
    assert max(b.num_rows for b in got) == 4 and sum(b.num_rows for b in got) == 50
    assert [t for b in got for t in b.column(0).to_pylist()][7] == "x" * 300 + "�"


@pytest.mark.parametrize("name", ["immutable_literals", "placeholder_literals", "text_qa"])
def test_literals_are_found_once_a_row(spark, name):
    from quizforge.jobs.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("titration curve") == 1
