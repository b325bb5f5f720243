"""Stored arrays by ranges of rows, banks of features, the sink of pictures."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import jpeg
from sieveline.sources import arrays, readers
from sieveline.sources.pictures import write_pictures


def by_row(df) -> dict:
    return {(r["name"], r["row_id"]): list(r["value"]) for r in df.collect()}


def plain(name, a) -> dict:
    a = np.atleast_1d(a)
    return {(name, k): [float(x) for x in np.ravel(row)] for k, row in enumerate(a)}


def test_arrays_by_ranges_equal_numpy(spark, tmp_path):
    r = np.random.default_rng(1)
    kinds = {
        "c": r.normal(size=(1000, 6)),
        "f": np.asfortranarray(r.normal(size=(300, 4, 5)).astype("f4")),
        "one": np.float64(3.5),
        "flat": np.arange(77, dtype="i2"),
        "big_endian": r.normal(size=(20, 3)).astype(">f8"),
        "none": np.zeros((0, 3)),
    }
    for name, a in kinds.items():
        np.save(tmp_path / f"{name}.npy", a)
        got = arrays.read_rows(spark, str(tmp_path / f"{name}.npy"), task_bytes=4096)
        assert by_row(got) == plain(None, a), name
    assert arrays.read_rows(spark, str(tmp_path / "c.npy"), task_bytes=4096).rdd.getNumPartitions() == 12
    np.savez(tmp_path / "stored.npz", **kinds)
    np.savez_compressed(tmp_path / "packed.npz", **kinds)
    want = {k: v for name, a in kinds.items() for k, v in plain(name, a).items()}
    for file in ("stored", "packed"):
        assert by_row(arrays.read_rows(spark, str(tmp_path / f"{file}.npz"), task_bytes=4096)) == want, file


def test_small_steps_give_the_same_rows(tmp_path, monkeypatch):
    a = np.asfortranarray(np.random.default_rng(2).normal(size=(50, 3, 2)))
    np.savez_compressed(tmp_path / "a.npz", a=a)
    np.save(tmp_path / "a.npy", a)
    monkeypatch.setattr(arrays, "STEP", 100)
    for path in ("a.npy", "a.npz"):
        reader = arrays.ArrayReader({"files": json.dumps([str(tmp_path / path)]), "bytes": "700", "element": "double"})
        rows = [v for p in reader.partitions() for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert np.array_equal(np.array(rows), a.reshape(50, 6))


def test_objects_and_short_files_are_errors(spark, tmp_path):
    np.save(tmp_path / "objects.npy", np.array([{}], object))
    np.save(tmp_path / "short.npy", np.zeros((100, 8)))
    content = (tmp_path / "short.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(content[:-8])
    for name in ("objects", "short"):
        with pytest.raises(Exception, match="objects|ends within"):
            arrays.read_rows(spark, str(tmp_path / f"{name}.npy")).collect()


def test_lines_keep_their_places_over_blocks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("v\n" + "".join(f"x{k}\n" for k in range(5000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = spark.read.option("header", "true").schema("v string").csv(str(tmp_path / "m.csv"))
        got = {r["row_id"]: r["v"] for r in arrays.numbered_lines(lines, ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {k: f"x{k}" for k in range(5000)}


def test_bank_joins_vectors_with_their_facts(spark, tmp_path):
    want = {}
    for k, split in enumerate(("train", "val", "test")):
        a = np.random.default_rng(k).normal(size=(5 + k, 3)).astype("f4")
        np.save(tmp_path / f"feat_{split}.npy", a)
        (tmp_path / f"meta_{split}.csv").write_text("class_idx,note\n" + "".join(f"{i % 3},n{i}\n" for i in range(5 + k)))
        want |= {(split, i): (list(map(float, a[i])), i % 3, f"n{i}") for i in range(5 + k)}
    (tmp_path / "feature_bank_info.json").write_text('{"dim": 3,\n "encoder": "x"}')
    bank, info = arrays.read_bank(spark, str(tmp_path), "class_idx int, note string")
    assert info == {"dim": 3, "encoder": "x"}
    assert {(r["split"], r["row_id"]): (list(r["value"]), r["class_idx"], r["note"]) for r in bank.collect()} == want


def smooth(height: int, width: int, channels: int, seed: int) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    planes = [127 + 100 * np.sin((seed + c + 1) * y / 19 + x / (7 + c)) for c in range(channels)]
    return np.stack(planes, axis=2).round().astype(np.uint8)


def test_prefix_codes_are_short_and_free_of_all_ones():
    for counts in (np.arange(256), np.fromiter((int(1.6**k) if k < 40 else 0 for k in range(256)), np.int64), np.eye(256, dtype=int)[7]):
        codes, lengths, number, symbols = jpeg.prefix_code(counts)
        assert sum(number) == len(symbols) == np.count_nonzero(counts) and lengths.max() <= 16
        words = sorted(format(codes[s], f"0{lengths[s]}b") for s in symbols)
        assert not any(b.startswith(a) for a, b in zip(words, words[1:])) and all("0" in w for w in words)


def test_pictures_are_read_back(spark, tmp_path):
    shapes = {"a.jpg": (40, 50, 3), "b.jpg": (8, 8, 3), "c.jpg": (17, 33, 1), "d.jpg": (1, 1, 3), "e.jpg": (64, 120, 3)}
    images = {n: smooth(*s, k) for k, (n, s) in enumerate(shapes.items())}
    images["e.jpg"] = np.random.default_rng(0).integers(0, 256, (64, 120, 3)).astype(np.uint8)
    rows = [("x", n, i.shape[1], i.shape[0], i.shape[2], i.tobytes()) for n, i in images.items()]
    rows += [("x", "empty.jpg", 4, 4, 3, None), ("x", "wrong.jpg", 4, 4, 3, b"123"), ("x", "null.jpg", None, 4, 3, b"1" * 48)]
    df = spark.createDataFrame(rows, "f string, n string, width int, height int, channels int, data binary").withColumn("folder", F.lit(1))
    told = write_pictures(df, str(tmp_path / "out"), folder=F.col("f"), name=F.col("n"))
    assert {r["name"]: r["written"] for r in told.collect()} == {r[1]: r[1] in images for r in rows}
    found = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_pictures(spark, str(tmp_path / "out"), ["x"]).collect()}
    assert set(found) == set(images)
    for name, image in images.items():
        row = found[name]
        got = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"]).astype(int)
        assert got.shape == image.shape and np.abs(got - image).mean() < (8 if name == "e.jpg" else 2), name
    assert not list(tmp_path.glob("*.staging-*"))


def test_sink_leaves_all_or_nothing(spark, tmp_path):
    image = smooth(8, 8, 3, 1).tobytes()
    schema = "f string, n string, width int, height int, channels int, data binary"
    put = lambda rows, name: write_pictures(spark.createDataFrame(rows, schema), str(tmp_path / name), folder=F.col("f"), name=F.col("n"))
    for bad in ([("x", "a", 8, 8, 3, image)] * 2, [("x", None, 8, 8, 3, image)], [("x", "../a", 8, 8, 3, image)], [("_x", "a", 8, 8, 3, image)]):
        with pytest.raises(ValueError):
            put(bad, "bad")
    fails = spark.createDataFrame([("x", "a", 8, 8, 3, image), ("x", "b", 8, 8, 3, image)], schema)
    fails = fails.repartition(2).withColumn("width", F.when(F.col("n") == "b", F.raise_error(F.lit("lost")).cast("int")).otherwise(8))
    with pytest.raises(Exception, match="lost"):
        write_pictures(fails, str(tmp_path / "bad"), folder=F.col("f"), name=F.col("n"))
    assert not list(tmp_path.iterdir())
    assert put([], "empty").count() == 0 and (tmp_path / "empty").is_dir()
    with pytest.raises(FileExistsError):
        put([], "empty")


def test_vectors_written_and_read_back(spark, tmp_path):
    rows = [(k, [float(k), k / 3, -k * 2.5]) for k in range(500)]
    df = spark.createDataFrame(rows, "row_id long, v array<double>").repartition(3)
    arrays.write_rows(df, str(tmp_path / "out"), "v")
    got = sorted(list(r["value"]) for r in arrays.read_rows(spark, f"{tmp_path}/out/*.npy", task_bytes=512).collect())
    assert got == [v for _, v in rows]
    for bad in ([(1, None)], [(1, [1.0, None])], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError, match="nulls or vectors"):
            arrays.write_rows(spark.createDataFrame(bad, df.schema), str(tmp_path / "bad"), "v")
    arrays.write_rows(df.limit(0), str(tmp_path / "empty"), "v")
    assert [p.name for p in tmp_path.iterdir() if p.name != "out"] == ["empty"]


def test_stored_pictures_meet_in_arrow_batches(spark, tmp_path, capsys):
    from sieveline.plans.stored import stored_pictures

    r = np.random.default_rng(5)
    rows = [(k, r.normal(0, 1, 64).tolist(), k % 3) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = stored_pictures(spark, str(tmp_path))
    made.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    got = {x.vec_id: x for x in made.collect()}
    side = lambda k: 8 * (6 + k % 3) + 48
    assert {k: tuple(x)[1:] for k, x in got.items()} == {k: (True, side(k), side(k), True) if k % 50 != 3 else (False, None, None, False) for k in range(60)}
