"""Templates as text and as files, whose lines take work in proportion to their number."""

import random
import time

from pyspark.sql import functions as F

from forecourt.operators import assembly, catalogue
from forecourt.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain_lines(text):
    section, rows = "", []
    for line in (x.strip(" ") for x in text.split("\n")):
        if line.startswith("[") and line.endswith("]") and "]" not in line[1:-1] and len(line) > 2:
            section = line[1:-1]
        elif "=" in line and (label := line.partition("=")[0].strip()).replace("_", "a").isalnum() and label.isascii():
            rows.append((section, label, line.partition("=")[2].strip().strip('"')))
    return rows


def some_text(rng, n):
    line = lambda i: rng.choice([f"[S{rng.randrange(5)}]", "# note = 1", "", "  ", "nothing", f'l{i} = "v{i}"', f'l{i} = "v{i}"', f"  l{i}=v{i}", f'l{i} = ""', f'l_{i}_comments = "a [b] c"'])
    return "\n".join(line(i) for i in range(n))


def test_lines_of_texts_equal_a_plain_version(spark):
    rng = random.Random(3)
    texts = ["", "\n", "[A]", "[A]\n[B]\n", "a = 1", "a = 1\n[A]", "[A]\na = 1\n[A]\na = 2", *(some_text(rng, n) for n in (1, 2, 5, 40, 40, 300))]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, text string")
    found = {r["k"]: r["x"] for r in df.select("k", catalogue.template_lines(F.col("text")).alias("x")).collect()}
    assert found.pop(-1) is None
    for k, text in enumerate(texts):
        assert [tuple(r) for r in found[k]] == plain_lines(text), text


def test_a_large_template_takes_no_quadratic_work(spark):
    text = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.when(i % 1000 == 0, F.concat(F.lit("[s"), i.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("l"), i.cast("string"), F.lit(" = v")))), "\n").alias("text"))
    began = time.time()
    rows = text.select(F.explode(catalogue.template_lines(F.col("text"))).alias("r")).groupBy("r.section").count().collect()
    assert sum(r["count"] for r in rows) == 99_900 and {r["count"] for r in rows} == {999} and len(rows) == 100
    assert time.time() - began < 60  # with a list that grew by a copy a line it took minutes


def test_files_are_read_in_blocks_of_any_size(spark, tmp_path):
    rng, expected = random.Random(4), []
    for name in ("a", "b", "007"):
        (tmp_path / f"brand={name}").mkdir()
        text = f'first = "x"\n[{name}]\n' + 'filler = "y"\n' * 30 + some_text(rng, 200)
        (tmp_path / f"brand={name}" / "part-0.txt").write_text(text)
        expected += [(name, *row) for row in plain_lines(text)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("50b", "333b", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = catalogue.read_template_lines(spark, str(tmp_path), "brand")
            assert sorted(map(tuple, found.collect())) == sorted(expected), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_written_templates_have_one_file_and_their_heads(spark, tmp_path):
    rows = [("f", None, "t", "0", 1), ("f", "A", "x", "1", 2), ("f", "A", "y", None, 3), ("f", "B", "z", "2", 4), ("g", "A", "x", "1", 1)]
    lines = spark.createDataFrame(rows, "file string, section string, label string, value string, line int").repartition(4)
    assembly.template_rows(lines, "file", ["line"]).write.partitionBy("file").text(f"{tmp_path}/out")
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("*/part-*")}
    assert texts == {"file=f": 't = "0"\n[A]\nx = "1"\ny = ""\n[B]\nz = "2"\n', "file=g": '[A]\nx = "1"\n'} and len(list((tmp_path / "out").glob("*/part-*"))) == 2


def test_template_files_hold_no_file_in_a_row(spark):
    plan = registry.QUERIES["template_files"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan and "explode" not in plan
