"""Image files that are read in columns: what the writer made, what others make, and what is wrong."""

import numpy as np

from steadfold.sources import images


def test_files_come_back(spark, tmp_path):
    random = np.random.default_rng(3)
    made = {}
    for k, (w, h) in enumerate([(1, 1), (8, 8), (13, 5), (3, 7)]):
        x = random.normal(0, 1, w * h)
        lo, hi = x.min(), x.max()
        scaled = (x - lo) / ((hi - lo) or 1.0)
        for bits in (False, True):
            name = f"{k}-{bits}"
            (tmp_path / "in" / str(k % 2)).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / str(k % 2) / name).write_bytes(images.pnm(x, w, bits))
            made[name] = (w, h, 1 if bits else 255, (scaled > 0.5).astype(int).tolist() if bits else np.floor(scaled * 255).astype(int).tolist(), None)
    found = {r.path.rpartition("/")[2]: (r.width, r.height, r.depth, r.x, r.error) for r in images.read(spark, f"file://{tmp_path}/in").collect()}
    assert found == made


def test_other_writers_and_wrong_files(spark):
    files = [
        ("comments", b"P5 # a comment\n# another\n 2\t1\n255\n\x00\xff"), ("deep", b"P5\n2 1\n1000\n\x00\x01\x03\xe8"), ("digits", b"P5\n2 1\n255\n12"), ("bits", b"P4\n3 2\n\xa0\x40"),
        ("cut", b"P5\n2 2\n255\n\x00\x01\x02"), ("long", b"P5\n1 1\n255\nab"), ("none", b""), ("null", None), ("text", b"hello"), ("color", b"P6\n1 1\n255\nabc"), ("flat", b"P5\n0 5\n255\n"), ("header", b"P5\n2 2\n255"),
    ]
    found = {r.path: r for r in images.decoded(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert [found[k].x for k in ("comments", "deep", "digits", "bits")] == [[0, 255], [1, 1000], [49, 50], [1, 0, 1, 0, 1, 0]]
    assert found["cut"].error == "cut" and found["long"].error.startswith("longer") and found["flat"].error.startswith("an image")
    assert all(found[k].x is None and found[k].width is None and found[k].error for k in ("cut", "long", "none", "null", "text", "color", "flat", "header"))
