"""Region maps, labels, documents and digests on small tables."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascope.functions import text
from terrascope.operators import evaluate as ev
from terrascope.operators import regions as rg
from terrascope.sources import tables as tb


def test_safe_label_works_on_bytes(spark):
    rows = spark.createDataFrame([("traffic sign",), ("車輛",), ("",), ("a-b_C9",)], "label string")
    assert [r[0] for r in rows.select(text.safe_label(F.col("label"))).collect()] == ["traffic_sign", "______", "query", "a-b_C9"]
    clash = spark.createDataFrame([("a b",), ("a.b",), ("c",)], "label string")
    assert [(r.safe, r.labels) for r in tb.label_collisions(clash, "label").collect()] == [("a_b", 2)]


def test_frame_index_of_names(spark):
    names = ["000012.png", "cam7.left.jpg", ".hidden", "none.png", "99999999999.png", "img42"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in rows.select(text.frame_index_from_name(F.col("name"))).collect()] == [12, -1, -1, -1, -1, 42]


def test_joint_partition(spark):
    """Three random levels on two frames: ids follow the sorted distinct tuples of a frame."""
    rng = np.random.default_rng(31)
    levels = rng.integers(-1, 3, (2, 6, 9, 3))
    rows = [(f, u, v, *levels[f, v, u].tolist()) for f, v, u in np.ndindex(2, 6, 9)]
    table = spark.createDataFrame(rows, "frame_index int, u int, v int, low int, mid int, top int")
    got = rg.joint_partition(table, ["low", "mid", "top"]).collect()
    number = {f: {t: i for i, t in enumerate(sorted({r[3:] for r in rows if r[0] == f and max(r[3:]) >= 0}))} for f in range(2)}
    assert len(got) == len(rows)
    assert all(r.joint == number[r.frame_index].get((r.low, r.mid, r.top), -1) for r in got)


def test_any_level(spark):
    rows = [(1, [(1, True), (2, True)]), (2, [(1, True), (2, True)]), (2, [(0, False), (0, False)])]
    table = spark.createDataFrame(rows, "ref int, levels array<struct<pred: int, valid: boolean>>")
    got = {r.class_id: r for r in ev.any_level_recoverability(table, [1, 2]).collect()}
    assert got[1].any_level_recall == 1.0 and (got[2].covered_pixels, got[2].correct_pixels) == (1, 1)


def masks(spark, boxes):
    pixels = [(0, m, u, v) for m, (u0, v0, w, h, _) in enumerate(boxes) for u in range(u0, u0 + w) for v in range(v0, v0 + h)]
    table = spark.createDataFrame([(0, m, float(b[4])) for m, b in enumerate(boxes)], "frame_index int, mask_id int, score double")
    return table, spark.createDataFrame(pixels, "frame_index int, mask_id int, u int, v int")


def suppressed(shapes, scores, iou_t, score_t, inner_t):
    """Masks that stay, from the sets of their pixels: every rule as a statement about one mask and its rivals."""
    ranked = sorted(range(len(shapes)), key=lambda m: (-scores[m], m))
    place = {m: i for i, m in enumerate(ranked)}

    def lies_in(x, y):
        """How well mask x is hidden in the much larger mask y, 0 if it is not."""
        both = len(shapes[x] & shapes[y])
        hidden = both >= 0.85 * len(shapes[x]) and both < 0.5 * len(shapes[y])
        return 1 - both * both / (len(shapes[x]) * len(shapes[y])) if hidden else 0

    better = {m: ranked[: place[m]] for m in ranked}
    worse = {m: ranked[place[m] + 1 :] for m in ranked}
    apart = {m for m in ranked if all(len(shapes[m] & shapes[o]) <= iou_t * len(shapes[m] | shapes[o]) for o in better[m])}
    sure = {m for m in ranked if scores[m] > score_t}
    free_above = {m for m in ranked if all(lies_in(m, o) <= 1 - inner_t for o in better[m])}
    free_below = {m for m in ranked if all(lies_in(m, o) <= 1 - inner_t for o in worse[m] + better[m][-1:])}
    rescued = [rule or set(ranked[:3]) for rule in (sure, free_above, free_below)]
    return apart.intersection(*rescued)


def test_mask_nms_equals_rules_on_sets(spark):
    import random

    random.seed(4)
    for trial in range(4):
        boxes = [(random.randrange(12), random.randrange(12), random.randint(2, 9), random.randint(2, 9)) for _ in range(8)]
        chosen = [random.choice(boxes) for _ in range(14)] + boxes[:1] * 6
        scores = [random.randint(30, 99) / 100 for _ in chosen]
        table, pixels = masks(spark, [(*b, s) for b, s in zip(chosen, scores)])
        shapes = [{(u, v) for u in range(x, x + w) for v in range(y, y + h)} for x, y, w, h in chosen]
        limits = (0.6, [0.5, 0.995][trial % 2], [0.3, 0.8][trial // 2])
        got = {r.mask_id for r in rg.mask_nms(table, pixels, *limits).where("keep").collect()}
        assert got == suppressed(shapes, scores, *limits)


def test_later_mask_overwrites(spark):
    rng = np.random.default_rng(37)
    boxes = [(int(u), int(v), int(w), int(h), 1) for u, v, w, h in zip(rng.integers(0, 9, 12), rng.integers(0, 7, 12), rng.integers(1, 6, 12), rng.integers(1, 5, 12))]
    _, pixels = masks(spark, boxes)
    canvas = np.full((12, 15), -1)
    for m, (u, v, w, h, _) in enumerate(boxes):
        canvas[v : v + h, u : u + w] = m
    painted = rg.paint_raster(pixels.withColumn("mask_order", F.col("mask_id")), 15, 12).collect()
    assert len(painted) == canvas.size and all(r.region == canvas[r.v, r.u] for r in painted)


def test_alignment_rules(spark):
    twice = spark.createDataFrame([(1, 5, 0), (1, 6, 1)], "frame_index int, label_scan_index int, row_no int")
    assert tb.alignment_table(twice, "row_no").first().label_scan_index == 6
    with pytest.raises(Exception, match="duplicate alignment frame"):
        tb.alignment_table(twice).collect()


def test_pose_lines_and_inversion(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("a.png  a.pcd 1 0 0 0 1 2 3",)], "value string")
    back = tb.parse_pose_lines(lines, "cw").first()
    assert (back.image, back.tx, back.ty, back.tz) == ("a.png", -1.0, -2.0, -3.0)
    with pytest.raises(Exception, match="invalid pose line"):
        tb.parse_pose_lines(spark.createDataFrame([("a b 1 0 0",)], "value string")).collect()


def test_prompt_document_checks(spark):
    good = {
        "schema": "mcd_open_vocab_prompt_groups_v1", "frozen_before_heldout_evaluation": True, "primary_macro_class_ids": [1, 2],
        "classes": {"1": {"name": "a", "queries": ["one", "first class"]}, "2": {"name": "b", "queries": ["two"]}},
    }
    table = lambda d: spark.createDataFrame([(json.dumps(d),)], "document string")
    assert [r.query for r in tb.prompt_classes(table(good)).collect()] == ["one", "first class", "two"]
    assert tb.prompt_violations(table(good)).count() == 0
    bad = dict(good, schema="x", frozen_before_heldout_evaluation=False, primary_macro_class_ids=[1, 1, 2, 3])
    bad["classes"] = {"1": {"name": "a", "queries": ["a b", "a.b"]}, "2": {"name": "b", "queries": []}}
    assert {r.problem for r in tb.prompt_violations(table(bad)).collect()} == {
        "schema", "not_frozen", "missing_class", "no_query", "duplicate_class", "label_collision"}


def test_digests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"b.txt": b"two", "sub/a.txt": b"one"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    expected = hashlib.sha256()
    for name in sorted(files):
        expected.update(name.encode() + b"\0" + hashlib.sha256(files[name]).digest())
    got = tb.combined_digest(tb.file_digests(spark, str(tmp_path), str(tmp_path), "*.txt")).first()
    assert (got.combined, got.files) == (expected.hexdigest(), 2)


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    """Above the bound a file is no single value, whatever its bytes: line ends, none, a byte order mark, compressed."""
    noise = np.random.default_rng(3).integers(0, 256, 300_000).astype(np.uint8).tobytes()
    files = {"ends.bin": noise + b"\n", "open.bin": noise + b"x", "cr.bin": b"a\r\nb\r" * 500, "lines.bin": b"\n" * 1000, "one.bin": b"y" * 1000, "mark.bin": b"\xef\xbb\xbf" + noise, "a b%20c.bin": noise[::-1], "[x].bin": noise[:5000], "small.bin": b"z", "packed.bin.gz": gzip.compress(noise)}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    expected = {name: hashlib.sha256(body).hexdigest() for name, body in files.items()}
    monkeypatch.setattr(tb, "WHOLE", 500)
    streamed, real = [], tb._streamed_digests
    monkeypatch.setattr(tb, "_streamed_digests", lambda *a: streamed.append(real(*a)) or streamed[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = tb.file_digests(spark, str(tmp_path), str(tmp_path)).collect()
    assert len(got) == len(files) and {r.name: r.digest for r in got} == expected
    assert {r.path.rpartition("/")[2] for r in streamed[0].where("digest is not null").collect()} == set(files) - {"mark.bin", "[x].bin", "small.bin", "packed.bin.gz"}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_report_refuses_overwrite(spark, tmp_path):
    tb.write_report(spark.range(2), str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)already exists"):
        tb.write_report(spark.range(2), str(tmp_path / "r"))
