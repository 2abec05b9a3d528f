import base64
import random

import pytest

from kinfolio import cli
from kinfolio.operators.assign import Codec

from .test_library import library  # noqa: F401


CODEC = Codec(lambda data: data, lambda image: (100, 80), lambda image, box: repr(box).encode(), lambda image, box, largest, quality: f"{largest} {quality}".encode())


def load():
    return lambda crops: [[float(len(c)), 1.0] for c in crops]


def test_commands(spark, library, tmp_path, capsys):  # noqa: F811
    cli.main(["inspect-db", "--db", library, "--recognition-db", library], spark)
    out = capsys.readouterr().out
    assert "total_photos" in out and "Ann" in out
    cli.main(["detect-datestamps", "--db", library, "--show-clean"], spark)
    assert "clean" in capsys.readouterr().out
    rng = random.Random(1)
    rows = [(1, 0, [1.0, 0.0, rng.random() / 9]), (1, 1, [0.0, 1.0, rng.random() / 9]), (2, 0, [1.0, 0.1, rng.random() / 9]), (9, 0, [0.9, 0.0, 0.0])]
    spark.createDataFrame(rows, "photo_id long, face_idx int, embedding array<float>").write.parquet(str(tmp_path / "e"))
    base = ["cluster", "--db", library, "--recognition-db", library, "--load-embeddings", str(tmp_path / "e"), "--baby-names", "Ann"]
    cli.main([*base, "--export-html", str(tmp_path / "g")], spark)
    assert "cluster_id" in capsys.readouterr().out and (tmp_path / "g").is_file()
    cli.main([*base, "--semi-supervised", "--labelled-seeds", "--min-cluster", "2", "--cut-distance", "5"], spark)
    capsys.readouterr()
    cli.main([*base, "--nearest-centroid", "--semi-supervised"], spark)
    assert "assigned_name" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="requires --semi-supervised"):
        cli.main([*base, "--nearest-centroid"], spark)
    page = (tmp_path / "g").read_text()
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</html>") and "thumbnails rendered" in page


def test_embeddings_are_computed_from_thumbnails(spark, library, tmp_path, capsys):  # noqa: F811
    with pytest.raises(SystemExit, match="--codec"):
        cli.main(["cluster", "--db", library, "--recognition-db", library, "--baby-names", "Ann"], spark)
    base = ["cluster", "--db", library, "--recognition-db", library, "--thumbnails-db", library, "--codec", "tests.test_cli:CODEC", "--embedder", "tests.test_cli:load", "--baby-names", "Ann"]
    cli.main([*base, "--save-embeddings", str(tmp_path / "e"), "--export-html", str(tmp_path / "g")], spark)
    assert {(r.photo_id, r.face_idx) for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {(1, 0), (1, 1)}
    page = (tmp_path / "g").read_text()
    assert page.count("<img") == 2 and "2 thumbnails rendered" in page and page.count(base64.b64encode(b"140 80").decode()) == 2
