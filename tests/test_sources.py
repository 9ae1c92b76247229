"""Arrays read in ranges, evaluation files, stored runs, rounds that go on, buckets, and scoring in flight."""

import csv
import json
import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizforge.operators import compose, inference, scoring, variants_image, variants_text
from quizforge.operators.inference import Limits
from quizforge.sources import json_arrays, runs, tables
from quizforge.sources.eval_tsv import EvalTsvWriter, Written, write_eval_tsv


def value(rng, depth=0):
    kind = rng.randrange(7)
    if kind == 0:
        return rng.choice(["", '"', "\\", '\\\\"', "a,b]", "[{", "}", "é中", "x" * rng.randrange(40), "\\\\\\"])
    if kind < 3 or depth > 3:
        return rng.choice([None, 7, True])
    if kind < 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice('abc\\"[') + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def elements(path, text, size):
    path.write_bytes(text)
    uri = f"file://{path}"
    with json_arrays._open(uri) as f:
        begin = json_arrays._array_begin(f, len(text), "results")
    if begin < 0:
        return None
    ranges = pd.DataFrame([(uri, begin, s, min(len(text), s + size)) for s in range(begin, len(text), size)], columns=["file", "begin", "start", "end"])
    told = json_arrays._put_together(pd.concat(json_arrays._summaries(iter([ranges]))))
    if not len(told):
        return None
    parts = list(json_arrays._elements(iter([told])))
    found = sorted((r.pos, r.element) for p in parts for r in p.itertuples())
    assert [p for p, _ in found] == list(range(len(found)))
    return [json.loads(e) for _, e in found]


def test_any_array_cut_anywhere_gives_its_elements(tmp_path):
    rng = random.Random(5)
    for n in range(400):
        own = [value(rng) for _ in range(rng.randrange(12))]
        text = json.dumps(own, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if n % 3 == 1:
            text = json.dumps({'"results": [': 1, "n": {"results": [1, 2]}, "s": "\\"})[:-1] + ', "results" : ' + text + ', "after": [1,2,{"x":[3]}]}'
        assert elements(tmp_path / "a.json", ("\n " * (n % 2) + text).encode(), rng.choice([1, 2, 3, 5, 7, 16, 64, 1000])) == own
    for text, want in ((b"[1,2", None), (b"not json", None), (b'{"a":[1]}', None), (b"", None), (b"[]", []), (b"[ ]", []), (b'\xef\xbb\xbf[1]', [1])):
        assert elements(tmp_path / "b.json", text, 2) == want


def test_one_large_array_is_many_tasks(spark, tmp_path):
    folder = tmp_path / "My Set+1%"
    folder.mkdir()
    items = [{"id": i, "query": f"q {i} \\ \"x\" [{{" + "word " * (i % 300), "target": "A", "image_path": [f"image/{i}.png"], "field": None} for i in range(8000)]
    (folder / "x_qa.json").write_text(json.dumps(items))
    (folder / "y_qa.json").write_text('[{"id": 1')
    whole = tables.read_qa(spark, f"file://{tmp_path}")
    size = (folder / "x_qa.json").stat().st_size
    cut = tables.read_qa(spark, f"file://{tmp_path}", range_bytes=size // 10)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, cut.collect()), key=repr) and cut.count() == 8000
    assert {r.dataset for r in cut.select("dataset").distinct().collect()} == {"My Set+1%"}
    parts = json_arrays.array_elements(spark, f"file://{tmp_path}", range_bytes=size // 10)
    told = parts.groupBy(F.floor(F.col("pos") / 1000)).count().count()
    assert told == 8 and parts.count() == 8000
    assert tables.read_outputs(spark, f"file://{tmp_path}", range_bytes=1000).count() == 8000


def test_eval_files_have_the_bytes_of_a_csv_writer(spark, tmp_path):
    texts = ["  lead and trail  ", 'a\t"b"\nc', "", "plain", "é\r\n", None]
    rows = [("d e", tag, i, str(i), t) for tag in ("r1", "r2") for i, t in enumerate(texts * 5)] + [("f", "r1", 0, "0", "x")]
    df = spark.createDataFrame(rows, "dataset string, run_tag string, pos int, index string, question string").repartition(5)
    for _ in range(2):
        write_eval_tsv(df, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d e__r1.tsv", "d e__r2.tsv", "f__r1.tsv"]
    with (tmp_path / "want.tsv").open("w", newline="") as f:
        writer = csv.DictWriter(f, fieldnames=["index", "question"], delimiter="\t", quoting=csv.QUOTE_MINIMAL)
        writer.writeheader()
        writer.writerows({"index": str(i), "question": "" if t is None else t} for i, t in enumerate(texts * 5))
    assert (tmp_path / "out" / "d e__r1.tsv").read_bytes() == (tmp_path / "want.tsv").read_bytes()
    write_eval_tsv(df, f"file://{tmp_path}/parts", rows_per_file=12)
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == ["d e__r1.part1.tsv", "d e__r1.part2.tsv", "d e__r1.tsv", "d e__r2.part1.tsv", "d e__r2.part2.tsv", "d e__r2.tsv", "f__r1.tsv"]


def test_aborted_evaluation_leaves_no_file(spark, tmp_path):
    import pyarrow as pa

    writer = EvalTsvWriter(str(tmp_path / "out"), spark.createDataFrame([], "_file string, q string").schema)
    done = writer.write(iter([pa.RecordBatch.from_pydict({"_file": ["a.tsv", "b.tsv"], "q": ["1", "2"]})]))
    assert isinstance(done, Written) and len(done.files) == 2
    writer.abort([done, None])
    assert list((tmp_path / "out").iterdir()) == []


RESULT = "model string, dataset string, action string, run_tag string, id string, output string, status string, attempt int"
KEYS = ["model", "dataset", "action", "run_tag", "id"]


def test_an_update_touches_its_own_runs_only(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    row = lambda d, i, out, status="ok", n=0: ("m", d, "T1", "r1", i, out, status, n)
    first = spark.createDataFrame([row(d, str(i), "one") for d in ("a", "b", None) for i in range(5)] + [row("a", "", "no id")], RESULT)
    runs.upsert(first, path, KEYS, F.col("attempt"))
    files = lambda d: {p.name for p in (tmp_path / "runs" / "model=m" / d).rglob("part-*")}
    before = files("dataset=b"), files("dataset=a")
    new = spark.createDataFrame([row("a", "1", "two", n=2), row("a", "1", "late copy of an old one", n=-1), row("a", "9", "new"), row(None, "1", "[ERROR] x", "error", 1)], RESULT)
    for _ in range(2):
        runs.upsert(new, path, KEYS, F.col("attempt"))
    assert files("dataset=b") == before[0] and not files("dataset=a") & before[1]
    table = runs.read_runs(spark, path, first.schema)
    got = {(r.dataset, r.id): r.output for r in table.collect()}
    assert len(got) == table.count() == 16 and got["a", "1"] == "two" and got["a", "9"] == "new" and got["b", "1"] == "one" and got[None, "1"] == "[ERROR] x" and got[None, "2"] == "one"
    items = spark.createDataFrame([row("a", str(i), "")[:5] for i in (1, 7)] + [row(None, "1", "")[:5]], RESULT.split(", output")[0])
    left = runs.pending(items, path, first.schema, KEYS, F.col("attempt"))
    assert {(r.dataset, r.id) for r in left.collect()} == {("a", "7"), (None, "1")}
    plan = runs.only_runs_of(table, items.where("dataset = 'a'"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "dataset" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = runs.only_runs_of(table, items.where("dataset = 'a'"))
    assert read.select(F.input_file_name()).distinct().count() <= len(files("dataset=a")) and read.count() == 6
    assert runs.read_runs(spark, f"file://{tmp_path}/nothing", first.schema).count() == 0


def test_more_runs_than_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "MAX_NAMED_RUNS", 3)
    rows = spark.range(40).selectExpr("'m' AS model", "concat('d', id % 8) AS dataset", "'T' AS action", "'r' AS run_tag", "string(id) AS id", "'x' AS output", "'ok' AS status", "0 AS attempt")
    path = f"file://{tmp_path}/runs"
    runs.upsert(rows, path, KEYS, F.col("attempt"))
    runs.upsert(rows.where("dataset <> 'd1'").withColumn("output", F.lit("y")).withColumn("attempt", F.lit(1)), path, KEYS, F.col("attempt"))
    assert {(r.output, r["count"]) for r in runs.read_runs(spark, path, rows.schema).groupBy("output").count().collect()} == {("x", 5), ("y", 35)}


def test_a_loop_that_crashed_goes_on_where_it_was(spark, tmp_path):
    start = spark.range(30).withColumn("retry_times", F.lit(0))
    asked = []

    def step(left, n, fail=None):
        asked.append(n)
        if n == fail:
            raise RuntimeError("down")
        return left.withColumn("ok", F.lit(True)).withColumn("judge_answer", F.when(F.col("id") % 5 == n, "no").otherwise("yes"))

    folder = f"file://{tmp_path}/rounds"
    with pytest.raises(RuntimeError):
        variants_image.run_rounds(start, lambda left, n: step(left, n, fail=2), folder=folder)
    # What a crash left of a round that isn't in the manifest is written over.
    spark.range(3).write.parquet(f"{folder}/round2")
    out = variants_image.run_rounds(start, step, folder=folder)
    assert asked == [0, 1, 2, 2] and out.count() == 30
    assert variants_image.run_rounds(start, step, folder=folder).count() == 30 and asked == [0, 1, 2, 2]
    own = spark.createDataFrame([("1", "5 mL", [{"kind": "unit", "original": "5 mL", "placeholder": ""}], "A", True)], "id string, query string, pairs array<struct<kind:string,original:string,placeholder:string>>, target string, can_modify boolean")
    tried = []

    def rewrite(left, n):
        tried.append(n)
        return left.withColumn("transformed", F.array(F.lit("5 g")))

    for _ in range(2):
        assert variants_text.run_t2_rounds(own, rewrite, folder=f"file://{tmp_path}/t2").first().retry_times == 3
    assert tried == [0, 1, 2, 3]
    drawn = []

    def draw(left, n):
        drawn.append(n)
        return left.withColumn("render_ok", F.lit(True)).withColumn("raw_evaluation", F.lit(f"Score: {60 + 20 * n}"))

    for _ in range(2):
        assert variants_image.run_chart_attempts(spark.range(2), ["id"], draw, folder=f"file://{tmp_path}/draw").first().score == 100
    assert drawn == [1, 2]


def test_buckets_join_without_an_exchange(spark, tmp_path):
    row = "dataset string, field string, id string, level string, query string, target string, image_path array<string>, pos int"
    both = []
    for level in ("T1", "V2"):
        df = spark.createDataFrame([(f"d{i % 3}", "f", str(i), level, "q", "A", ["i"], 0) for i in range(60)], row)
        both.append(tables.write_bucketed(df, f"test_{level}", f"file://{tmp_path}/{level}", compose.KEY, 4))
    out = compose.compose_tv(*both)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and out.count() == 60
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = compose.compose_tv(*both)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for level in ("T1", "V2"):
            spark.sql(f"DROP TABLE test_{level}")


def requests(spark, n, parts=1):
    return spark.range(n).repartition(parts).select("id", F.concat(F.lit("p"), "id").alias("prompt"))


def test_requests_are_in_flight_together(spark):
    def scorer():
        def answer(prompt):
            time.sleep(0.05)
            if prompt.endswith("7"):
                raise ValueError("no")
            return prompt[1:]

        return answer

    df = requests(spark, 240).cache()
    df.count()
    began = time.monotonic()
    rows = inference.infer(df, scorer, Limits(in_flight=12)).collect()
    assert time.monotonic() - began < 240 * 0.05 / 4
    assert [r.id for r in rows] == [r.id for r in df.collect()]
    assert all((r.output, r.status) == (str(r.id), "ok") if r.id % 10 != 7 else (r.output, r.status) == ("[ERROR] no", "error") for r in rows)


def test_no_more_requests_run_than_are_allowed():
    lock, now, most = threading.Lock(), [0], [0]

    def answer(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 if int(prompt) % 13 else 0.05)
        with lock:
            now[0] -= 1
        return prompt

    got = list(scoring.in_order(iter([[str(i)] for i in range(300)]), answer, Limits(in_flight=5)))
    assert [g[0][0] for g in got] == [str(i) for i in range(300)] and most[0] == 5


def test_batches_retries_and_time_limits():
    calls = []

    def answer(prompts):
        calls.append(list(prompts))
        if prompts[0] == "slow":
            time.sleep(5)
        if prompts[0] == "busy" and calls.count(prompts) < 3:
            raise ConnectionError("busy")
        if prompts[0] == "short":
            return []
        return [p.upper() for p in prompts]

    began = time.monotonic()
    got = list(scoring.in_order(iter([["a", "b"], ["slow", "x"], ["busy"], ["short"], ["c"]]), answer, Limits(in_flight=2, batch=2, timeout=0.4, retries=2, back_off=0.01)))
    assert time.monotonic() - began < 3
    assert got[0] == [("A", "ok"), ("B", "ok")] and got[1] == [("[ERROR] no answer in 0.4 s", "error")] * 2 and got[2] == [("BUSY", "ok")]
    assert got[3] == [("[ERROR] 0 outputs for 1 prompts", "error")] and got[4] == [("C", "ok")] and calls.count(["busy"]) == 3


def test_null_prompts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, prompt string").coalesce(1)
    batch = Limits(in_flight=3, batch=2)
    got = [tuple(r) for r in inference.infer(df, lambda: lambda ps: [None if p == "b" else p for p in ps], batch).collect()]
    assert got == [(1, "a", "a", "ok"), (2, None, "[ERROR] no prompt", "error"), (3, "b", None, "ok")]
    assert inference.infer(df.where("id > 5"), lambda: str).collect() == []
    assert inference.infer(df.where("id = 2"), lambda: str).first().status == "error"


def test_many_small_arrays_are_many_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"d{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 7}" / f"{i}.json").write_text(json.dumps({"results": [i, "x" * (i % 9)]} if i % 2 else [i, "x" * (i % 9)]))
    for name, text in (("bad.json", "[1, 2"), ("_no.json", "[1]"), (".no.json", "[1]"), ("none.json", ""), ("other.txt", "[1]")):
        (tmp_path / name).write_text(text)
    parts = json_arrays.array_elements(spark, f"file://{tmp_path}", range_bytes=20)
    got = parts.select("pos", "element", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.pos, r.element) for r in got) == sorted(x for i in range(300) for x in ((0, str(i)), (1, json.dumps("x" * (i % 9)))))
    assert len({r.task for r in got}) > 4  # both those of one range and those of several
    whole = json_arrays.array_elements(spark, f"file://{tmp_path}")
    assert sorted((r.pos, r.element) for r in whole.collect()) == sorted((r.pos, r.element) for r in got)
    assert whole.select(F.spark_partition_id()).distinct().count() == 4
    assert "binaryFile" not in whole._jdf.queryExecution().toString()


def test_a_manifest_is_listed_by_tasks(spark, tmp_path):
    root = tmp_path / "a +1%" / "image"
    for i in range(60):
        at = root / str(i % 5) / "image"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{i}.{'png' if i % 3 else 'JPEG'}").write_text("x")
    for name in ("_h.png", ".h.png", "empty.png", "a.txt", "_part=1.png", "x._COPYING_"):
        (root / name).write_text("" if name == "empty.png" else "x")
    (root / "_hidden").mkdir()
    (root / "_hidden" / "b.png").write_text("x")
    want = sorted([f"{i % 5}/image/{i}.{'png' if i % 3 else 'JPEG'}" for i in range(60)] + ["_part=1.png"])
    for end in ("", "/"):
        own = tables.image_manifest(spark, f"file://{root}{end}")
        assert sorted(r.path for r in own.collect()) == want
        plan = own._jdf.queryExecution().toString()
        assert str(root) not in plan and "binaryFile" not in plan  # the driver holds no list of the root's files
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{root}")
    listed = json_arrays.list_files(spark, f"file://{root}")
    assert sorted(r.file[len("file://") :] for r in listed.collect()) == sorted(r.path[len("file:") :] for r in seen.select("path").collect())
