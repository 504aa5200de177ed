"""Chunks, audio files and the TOML data source against plain versions."""

import pickle
import random
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.operators import chunks as ch
from forecourt.operators import speech
from forecourt.sources import record_store, toml_data_source, toml_source, wav_source


def plain_chunks(text, limit, overlap):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("([。！？])", r"\1 ", text or "")) if w]
    sentences, own = [], []
    for w in words:
        own.append(w)
        if re.search(r"""[.!?。！？]["')\]]*$""", w):
            sentences.append(own)
            own = []
    sentences += [own] if own else []
    pieces = [s[i : i + limit] for s in sentences for i in range(0, len(s), limit)]
    out, first, last = [], 0, 0
    while last < len(pieces):
        last = first
        while last < len(pieces) and sum(map(len, pieces[first : last + 1])) <= limit:
            last += 1
        out.append((sum(map(len, pieces[:first])), " ".join(w for p in pieces[first:last] for w in p)))
        if last < len(pieces):
            begin = first + 1
            while sum(map(len, pieces[begin:last])) > overlap or sum(map(len, pieces[begin : last + 1])) > limit:
                begin += 1
            first = begin
    return out


def test_chunks_equal_a_plain_version(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "bb", "ccc", "d.", "e!", 'f."', "好。好！", "x y"])
    texts = [None, "", " \n\t", "one", ". . .", "w " * 50, "好。" * 30] + [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(60)] + ["word " * 20_000 + "end."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("start_ms", F.lit(1))
    for limit, overlap in ((8, 3), (5, 0), (1, 0), (9, 8)):
        found = {}
        for r in ch.chunks(df, limit=limit, overlap=overlap).orderBy("doc_id", "chunk").collect():
            found.setdefault(r["doc_id"], []).append((r["start"], r["chunk_text"]))
            assert r["n_tokens"] == len(r["chunk_text"].split(" ")) <= limit and r["chunk"] == len(found[r["doc_id"]]) - 1
        for i, t in enumerate(texts[:-1]):
            assert found.get(i, []) == plain_chunks(t, limit, overlap), (limit, overlap, t)
        assert len(found[len(texts) - 1]) >= 20_001 // limit
    with pytest.raises(ValueError):
        ch.chunks(df, limit=4, overlap=4)
    assert ch.chunks(df.limit(0)).count() == 0


def test_chunks_meet_every_word_in_order():
    for n, step in ((1, 1), (1000, 7), (1000, 300)):
        own = ch.cut(np.arange(step, n, step), n, 64, 16)
        assert own[0]["start"] == 0 and own[-1]["start"] + own[-1]["length"] == n
        for a, b in zip(own, own[1:], strict=False):
            assert a["start"] < b["start"] <= a["start"] + a["length"] < b["start"] + b["length"]


def test_best_of_chunks(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 0, 0.9), (3, 0, None), (4, 0, 0.1)]
    found = ch.best_of_chunks(spark.createDataFrame(rows, "doc_id int, chunk int, score double"), "doc_id", 2)
    assert [tuple(r) for r in found.collect()] == [(1, 1, 0.9), (2, 0, 0.9)]


def plain_segments(loud, duration, silence=300, pad=200, frame=30):
    runs = []
    for i in loud:
        if runs and (i - runs[-1][1] - 1) * frame < silence:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    gaps = [2 * pad, *((b[0] - a[1] - 1) * frame for a, b in zip(runs, runs[1:], strict=False)), 2 * pad]
    return [(max(0, a * frame - min(pad, gaps[k] // 2)), int(min(duration, (z + 1) * frame + min(pad, gaps[k + 1] // 2)))) for k, (a, z) in enumerate(runs)]


def test_segments_equal_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(0, None), (1, []), (2, [0.0] * 30), (3, [1.0] * 30), (4, [1.0])]
    rows += [(i, [float(rng.random() < p) for _ in range(rng.randrange(1, 200))]) for i, p in enumerate([0.02, 0.05, 0.1, 0.3] * 20, 5)]
    df = spark.createDataFrame(rows, "k int, levels array<double>")
    found = {r["k"]: r["s"] for r in df.select("k", speech.segments(F.col("levels"), F.size("levels") * 30 - 7, 0.5).alias("s")).collect()}
    assert found.pop(0) is None
    for k, own in rows[1:]:
        assert [tuple(s) for s in found[k]] == plain_segments([i for i, x in enumerate(own) if x], len(own) * 30 - 7)


def test_files_of_all_widths_and_broken_ones(spark, tmp_path):
    x = np.round(np.sin(np.arange(1600)) * 100).astype(int)
    for wide in (1, 2, 3, 4):
        values = x + 128 if wide == 1 else x << (8 * (wide - 1))
        raw = b"".join(int(v).to_bytes(wide, "little", signed=wide > 1) for v in values for _ in range(2))
        with wave.open(str(tmp_path / f"w{wide}.wav"), "wb") as f:
            f.setnchannels(2)
            f.setsampwidth(wide)
            f.setframerate(8000)
            f.writeframes(raw)
    (tmp_path / "raw.wav").write_bytes((x << 8).astype("<i2").tobytes() + b"!")
    (tmp_path / "bad.wav").write_bytes(b"RIFF nothing")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "silent.wav").write_bytes(wav_source.encode(np.zeros(0), 8000, 1))
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = {r["source_file"].rpartition("/")[2]: r for r in wav_source.read_wavs(spark, str(tmp_path), rate=8000).collect()}
    assert len(rows) == 7 and rows["bad.wav"]["corrupt"] and rows["bad.wav"]["levels"] is None
    assert rows["silent.wav"]["n_samples"] == 0 and rows["silent.wav"]["levels"] == []
    level = [float(np.mean((x[i : i + 240] / 128.0) ** 2)) for i in range(0, 1600, 240)]
    for name in ("w1.wav", "w2.wav", "w3.wav", "w4.wav", "raw.wav"):
        assert rows[name]["n_samples"] == 1600 and rows[name]["rate"] == 8000 and np.allclose(rows[name]["levels"], level), name


def test_toml_format_packs_prunes_and_keeps_errors(spark, tmp_path):
    toml_data_source.register(spark)
    for i in range(40):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"c{i:02d}.toml").write_text(f'car_model = "M{i}"\n[PriciseLabels]\nbrand = "B"\n')
    (tmp_path / "CarLabels.toml").write_text('car_model = "x"\n')
    (tmp_path / "broken.toml").write_bytes(b"\xff= nothing")
    read = lambda **options: spark.read.format("toml").options(**options).load(str(tmp_path))
    expected = toml_source.read_catalogue(spark, str(tmp_path), permissive=True).withColumn("source_file", F.regexp_replace("source_file", "^file:/*", "/"))
    assert sorted(map(str, read().collect())) == sorted(map(str, expected.collect())) and read().count() == 41
    assert read(taskFiles=10).rdd.getNumPartitions() == 5 and read(taskBytes=1).rdd.getNumPartitions() == 41 and read().rdd.getNumPartitions() == 1
    some = read(taskFiles=1).where(F.col("source_file").startswith(f"{tmp_path}/d1/"))
    assert some.rdd.getNumPartitions() == some.count() == 13
    one = read().where(F.col("source_file") == f"{tmp_path}/d0/c00.toml")
    assert one.select("car_model").first()[0] == "M0" and one.count() == 1
    assert read().where(F.col("source_file").isin(f"{tmp_path}/d0/c00.toml", "none")).count() == 1
    assert spark.read.format("toml").load(f"{tmp_path}/absent").count() == 0
    assert toml_data_source.packed([("b", 5), ("a", 1), ("c", 9)], 6, 9) == [["a", "b"], ["c"]]


def test_toml_writer_commits_whole_jobs(spark, tmp_path):
    toml_data_source.register(spark)
    folder = f"{tmp_path}/out"
    cars = spark.range(20).selectExpr("cast(id as string) as name", "named_struct('car_model', concat('M', id), 'PriciseLabels', named_struct('brand', 'B', 'size', cast(null as string))) as car").repartition(4)
    cars.write.format("toml").mode("append").save(folder)
    found = spark.read.format("toml").load(folder)
    assert {r["car_model"] for r in found.collect()} == {f"M{i}" for i in range(20)} and found.where("size(entries) = 1").count() == 20
    failing = cars.selectExpr("concat('new', name) as name", "if(name = '7', raise_error('lost'), car) as car")
    with pytest.raises(Exception, match="lost"):
        failing.write.format("toml").mode("append").save(folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{i}.toml" for i in range(20))
    with pytest.raises(Exception, match="append"):
        cars.write.format("toml").mode("overwrite").save(folder)


def test_index_handles_are_opened_once_until_reloaded(spark, tmp_path):
    folder, handles = tmp_path.as_uri() + "/index", record_store.IndexHandles(spark)
    with pytest.raises(ValueError, match="no index"):
        handles.get(folder)
    build = lambda n: record_store.build_index(spark.range(n).selectExpr("id as doc_id", "concat('car ', id) as text"), folder, "text")
    build(3)
    first = handles.get(folder)
    assert first.count() == 3 and handles.get(folder) is first
    build(5)
    assert handles.get(folder) is first
    again = handles.get(folder, reload=True)
    assert again is not first and again.count() == 5 and handles.get(folder) is again
    handles.reset()
    assert not handles.opened and handles.get(folder).count() == 5
    spark.range(0).selectExpr("id as doc_id").write.parquet(f"{folder}-empty")
    with pytest.raises(ValueError, match="empty"):
        handles.get(f"{folder}-empty")
    assert f"{folder}-empty" not in handles.opened


def test_toml_format_plans_few_bytes_a_file(tmp_path, monkeypatch):
    for i in range(3000):
        (tmp_path / f"some-longer-folder-{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"some-longer-folder-{i % 7}" / f"a-name-of-some-length-{i:06d}.toml").write_text('car_model = "M"\n')
    (tmp_path / ".job-1").mkdir()
    (tmp_path / ".job-1" / "uncommitted.toml").write_text('car_model = "M"\n')
    expected = sorted(str(p) for p in tmp_path.glob("some*/*.toml"))
    for files, bound in ((4096, 4096), (500, 4096), (1, 4096), (500, 10)):
        monkeypatch.setattr(toml_data_source, "ORDERED", bound)
        reader = toml_data_source.TomlReader({"path": str(tmp_path), "taskfiles": str(files)})
        planned = reader.partitions()
        assert len(planned) == -(-3000 // files) and sorted(p for x in planned for p in x.paths) == expected
        if files > 1 and bound > 10:
            assert len(pickle.dumps(planned)) < 20 * 3000  # before, above 90 bytes a file
    monkeypatch.undo()
    assert sum(b.num_rows for x in planned for b in reader.read(x)) == 3000
