"""Scans whose files are found by tasks: the driver holds no list of them, and none is lost."""

import json


def held(df, *suffixes):
    """Files of these names that the plan of a table holds on the driver."""
    return [x for x in df.inputFiles() if x.endswith(suffixes)]


def test_models_are_listed_by_tasks(spark, tmp_path):
    from reelframe.sources.files import scan_models

    want = {}
    for k in range(300):
        folder = tmp_path / "models" / str(k % 7) / ("deep er" if k % 2 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"net {k}.onnx").write_bytes(b"" if k % 5 == 0 else b"w")
        want[f"net {k}"] = 2
        if k % 3 == 0:
            (folder / f"net {k}.json").write_text(json.dumps({"scale_factor": k}), encoding="utf-8-sig")
            want[f"net {k}"] = k
    (tmp_path / "models" / "0" / "net 22.json").write_bytes(b"")  # no JSON object
    del want["net 22"]
    for name in (".hidden.onnx", "_part.onnx"):
        (tmp_path / "models" / name).write_bytes(b"w")
    found = scan_models(spark, str(tmp_path))
    assert held(found, ".onnx", ".json") == []
    assert {r.model: r.scale for r in found.collect()} == want


def test_a_folder_without_models(spark, tmp_path):
    from reelframe.sources.files import scan_models

    assert scan_models(spark, f"file://{tmp_path}").collect() == []


def test_a_store_is_listed_by_tasks(spark, tmp_path):
    import hashlib

    from reelframe.sources.objects import read_store, sink_object_store

    data = [b"body %d" % k for k in range(200)] + [b""]
    want = sorted((hashlib.sha256(x).hexdigest(), len(x)) for x in data)
    df = spark.createDataFrame([(*row, x) for row, x in zip(((hashlib.sha256(x).hexdigest(), len(x)) for x in data), data, strict=True)], "sha256 string, size long, data binary")
    at = str(tmp_path / "store")
    found = sink_object_store(df, at)
    assert [x for x in found.inputFiles() if x.startswith(f"file://{at}")] == [] and sorted(map(tuple, found.collect())) == want
    (tmp_path / "store" / "ab").mkdir(exist_ok=True)
    (tmp_path / "store" / "ab" / "no hash").write_bytes(b"x")
    assert sorted(map(tuple, sink_object_store(df, at, store=read_store(spark, at)).collect())) == want


def test_a_catalogue_is_listed_by_tasks(spark, tmp_path):
    from reelframe.sources.files import scan_catalog

    want = set()
    for k in range(200):
        folder = tmp_path / "media" / f"s{k % 5}" / "/".join("x" * (k % 3))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"clip {k}.mkv").write_bytes(b"." * (k % 4))
        want.add((str((folder / f"clip {k}.mkv").relative_to(tmp_path / "media")), False, k % 4))
        want |= {(str(p), True, 0) for p in folder.relative_to(tmp_path / "media").parents if str(p) != "."} | {(str(folder.relative_to(tmp_path / "media")), True, 0)} - {(".", True, 0)}
    for root in (str(tmp_path / "media"), f"file://{tmp_path}/media/"):
        found = scan_catalog(spark, root)
        assert held(found, ".mkv") == []
        assert {(r.path, r.is_dir, r.length) for r in found.collect()} == want
        stamp = int((tmp_path / "media" / "s0" / "clip 0.mkv").stat().st_mtime * 1000) * 1000
        assert abs(found.where("name = 'clip 0.mkv'").first().mtime_us - stamp) <= 1000
