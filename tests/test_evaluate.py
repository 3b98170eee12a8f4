"""Numeric expectations of the evaluation operators on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascope.operators import evaluate as ev
from terrascope.operators import resample as rs
from terrascope.operators.frames import disjoint_scan_split


CLASSES = [3, 4, 6, 7, 9]


def test_split_precedence(spark):
    """Seventy frames, three to a scan, some without one."""
    rows = [(f, -1 if f % 11 == 3 else f // 3) for f in range(70)]
    held_by_training = {scan for f, scan in rows if f % 6 == 2 and scan >= 0}
    named = {True: lambda scan: "train", False: lambda scan: "unmatched" if scan < 0 else "shared_scan_excluded" if scan in held_by_training else "heldout"}
    expected = {f: named[f % 6 == 2](scan) for f, scan in rows}
    table = spark.createDataFrame(rows, "frame_index int, label_scan_index int")
    assert {r.frame_index: r.split for r in disjoint_scan_split(table, 6, 2).collect()} == expected
    assert len(set(expected.values())) == 4


class Rasters:
    """Three frames of 17 x 11 pixels in ragged regions, with counts worked out by numpy."""

    def __init__(self) -> None:
        rng = np.random.default_rng(19)
        v, u = np.mgrid[0:11, 0:17]
        self.region = np.stack([(u + shift) // 5 + 4 * (v // 4) for shift in (0, 2, 3)])
        self.region[rng.random(self.region.shape) < 0.12] = -1
        self.ref = np.array(CLASSES)[(self.region * 7 + rng.integers(0, 3, self.region.shape)) % len(CLASSES)]

    def rows(self):
        return [(f, int(u), int(v), int(self.region[f, v, u]), int(self.ref[f, v, u])) for f, v, u in np.ndindex(*self.region.shape)]

    def majority(self, frame, region):
        counts = [int((self.ref[frame][self.region[frame] == region] == c).sum()) for c in CLASSES]
        return CLASSES[int(np.argmax(counts))], max(counts), sum(counts)

    def oracle(self):
        out = np.zeros_like(self.ref)
        for f in range(len(out)):
            for region in set(self.region[f].ravel()) - {-1}:
                out[f][self.region[f] == region] = self.majority(f, region)[0]
        return out


@pytest.fixture(scope="module")
def rasters():
    return Rasters()


@pytest.fixture(scope="module")
def pixels(spark, rasters):
    return spark.createDataFrame(rasters.rows(), "frame_index int, u int, v int, region int, ref int").cache()


def test_majority_oracle_and_diagnostics(rasters, pixels):
    expected = rasters.oracle()
    got = ev.region_majority_oracle(pixels, pixels, CLASSES).collect()
    assert len(got) == expected.size and all(r.oracle == expected[r.frame_index, r.v, r.u] for r in got)
    counts = ev.region_counts(pixels, CLASSES)
    per_class = {(r.frame_index, r.class_id): r for r in ev.oracle_per_class(counts, CLASSES, ["frame_index"]).collect()}
    for f in range(3):
        for c in CLASSES:
            here, covered = rasters.ref[f] == c, rasters.region[f] >= 0
            right = here & (expected[f] == c)
            row = per_class[f, c]
            assert (row.reference_pixels, row.covered_pixels, row.correct_pixels) == (here.sum(), (here & covered).sum(), right.sum())
            assert row.recall == (pytest.approx(right.sum() / here.sum()) if here.any() else None)
    purity = {r.frame_index: r for r in ev.region_purity(counts).collect()}
    for f in range(3):
        found = [rasters.majority(f, r)[1:] for r in set(rasters.region[f].ravel()) - {-1}]
        assert purity[f].assigned_regions == len(found)
        assert purity[f].mean_region_purity == pytest.approx(np.mean([n / total for n, total in found]))
        assert purity[f].pixel_weighted_region_purity == pytest.approx(sum(n for n, _ in found) / sum(t for _, t in found))


def test_oracle_totals_over_splits(spark, rasters, pixels):
    splits = {0: "heldout", 1: "train", 2: "heldout"}
    table = spark.createDataFrame(list(splits.items()), "frame_index int, split string")
    rows = {(r.split, r.class_id): r for r in ev.oracle_by_split(ev.region_counts(pixels, CLASSES), table, CLASSES).collect()}
    assert {k for k, _ in rows} == {"all", "heldout", "train"}
    expected = rasters.oracle()
    for split, frames in {"all": [0, 1, 2], "heldout": [0, 2], "train": [1]}.items():
        for c in CLASSES:
            here, bare = rasters.ref[frames] == c, rasters.region[frames] < 0
            row = rows[split, c]
            assert row.uncovered_pixels == (here & bare).sum()
            assert row.covered_wrong_pixels == (here & ~bare & (expected[frames] != c)).sum()


def test_unknown_counts_as_error(spark):
    rows = spark.createDataFrame([(1, 1), (2, 0)], "ref int, pred int")
    tallies = ev.class_tallies(rows, [1, 2])
    metrics = ev.scalar_metrics(tallies, [1, 2]).first()
    assert metrics.pixel_accuracy == 0.5 and metrics.prediction_coverage == 0.5
    matrix = {(r.ref, r.pred): r.n for r in ev.confusion_matrix(rows, [1, 2]).collect()}
    assert [[matrix[c, p] for p in (0, 1, 2)] for c in (1, 2)] == [[0, 1, 0], [1, 0, 0]]


def test_region_lookup_keeps_uncovered_pixels(spark, rasters, pixels):
    found = sorted({(f, r) for f, _, _, r, _ in rasters.rows() if r >= 0})
    vectors = {k: [k[0] + 0.5, k[1] / 8.0] for k in found}
    scores = spark.createDataFrame([(*k, v) for k, v in vectors.items()], "frame_index int, region int, scores array<double>")
    for r in ev.region_to_pixel(pixels, scores, 2).collect():
        assert (r.covered, r.scores) == ((True, vectors[r.frame_index, r.region]) if r.region >= 0 else (False, [0.0, 0.0]))
    with pytest.raises(Exception, match="missing region feature"):
        ev.region_to_pixel(pixels, scores.where("not (frame_index = 1 and region = 5)"), 2).collect()


def test_absent_class_stays_out_of_macro_iou(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "ref int, pred int")
    report = {r.class_id: r for r in ev.class_report(ev.class_tallies(rows, [1, 2]), [1, 2]).collect()}
    assert report[2].iou is None and report[2].precision == 0.0 and report[2].recall is None
    assert ev.scalar_metrics(ev.class_tallies(rows, [1, 2]), [1, 2]).first().macro_iou == 0.5
    union = {r.class_id: r for r in ev.class_report(ev.class_tallies(rows, [1, 2]), [1, 2], union_rule=True).collect()}
    assert union[2].iou == 0.0


def reference_ap(labels, scores):
    pairs = sorted(zip(scores, labels), reverse=True)
    total, hits, seen, area, i = sum(labels), 0, 0, 0.0, 0
    while i < len(pairs):
        j, before = i, hits
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            hits, seen, j = hits + pairs[j][1], seen + 1, j + 1
        area, i = area + (hits - before) / total * hits / seen, j
    return area


def test_average_precision_with_ties_ignores_order_and_partitions(spark):
    rows = [(1 + (i * 7) % 2, [((i * 37) % 11) / 16.0, ((i * 29) % 5) / 8.0]) for i in range(200)]
    for parts in (1, 7):
        table = spark.createDataFrame(rows[::-1] if parts == 7 else rows, "ref int, scores array<double>").repartition(parts)
        got = {r.class_id: r.ap for r in ev.average_precision(table, [1, 2, 3][:2]).collect()}
        for k, c in enumerate([1, 2]):
            assert got[c] == pytest.approx(reference_ap([int(r == c) for r, _ in rows], [s[k] for _, s in rows]))
    none = ev.average_precision(spark.createDataFrame([(1, [0.5, 0.5])], "ref int, scores array<double>"), [1, 2]).collect()
    assert {r.class_id: r.ap for r in none} == {1: 1.0, 2: None}


def test_calibration_matches_per_cell_recount(spark):
    rows = [(1 + i % 2, 1 + (i * 3) % 2, (i * 17 % 100) / 100.0, (i * 13 % 40) / 100.0) for i in range(300)]
    table = spark.createDataFrame(rows, "ref int, top_class int, top_score double, margin double")
    cells = {(r.score_threshold, r.margin_threshold): r for r in ev.calibrate_unknown(table, [1, 2], [0.0, 0.5], [0.0, 0.2]).collect()}
    for (s, m), cell in cells.items():
        kept = [r for r in rows if r[2] >= s and r[3] >= m]
        assert cell.known_prediction_coverage == pytest.approx(len(kept) / len(rows))
        assert cell.train_pixel_accuracy == pytest.approx(sum(r[0] == r[1] for r in kept) / len(rows))
    best = ev.best_thresholds(ev.calibrate_unknown(table.withColumn("top_class", F.col("ref")), [1, 2], [0.5, 0.0], [0.0, -1.0])).first()
    assert (best.score_threshold, best.margin_threshold) == (0.0, -1.0)


def test_bootstrap_is_deterministic_and_paired(spark):
    rows = []
    for frame in range(6):
        for i in range(10):
            for order, stage in enumerate(("oracle", "full")):
                right = i < (8 if stage == "oracle" else 3 + frame % 3)
                rows.append((frame, stage, order, 1 + i % 2, 1 + i % 2 if right else 0, right))
    table = spark.createDataFrame(rows, "frame_index int, stage string, stage_order int, ref int, pred int, valid boolean")
    blocks = rs.frame_blocks(table.select("frame_index"), 2)
    assert sorted(r.group_id for r in blocks.collect()) == [0, 0, 1, 1, 2, 2]
    keys = ["group_id", "stage", "stage_order"]
    tallies = ev.class_tallies(table.join(blocks, "frame_index"), [1, 2], keys)
    first = sorted(map(tuple, rs.bootstrap_replicates(tallies, [1, 2], 50, 7).collect()))
    again = sorted(map(tuple, rs.bootstrap_replicates(tallies.repartition(3), [1, 2], 50, 7).collect()))
    assert first == again and len(first) == 100
    assert len({r[4] for r in first if r[1] == "full"}) > 3  # draws differ between replicates
    intervals = {(r.stage, r.metric): r for r in rs.bootstrap_intervals(rs.bootstrap_replicates(tallies, [1, 2], 50, 7)).collect()}
    drop = intervals["full", "macro_iou_drop"]
    level = intervals["oracle", "macro_iou"].bootstrap_mean - intervals["full", "macro_iou"].bootstrap_mean
    assert drop.bootstrap_mean == pytest.approx(level) and drop.ci95_low <= drop.bootstrap_mean <= drop.ci95_high


def test_area_order(spark):
    """Fifty frames of four levels, one of them missing once."""
    levels, rng = ("fine", "mid", "wide", "all"), np.random.default_rng(23)
    areas = np.sort(rng.integers(5, 4000, (50, 4)), axis=1).astype(float)
    areas[::3] = rng.permuted(areas[::3], axis=1)
    rows = [(f, level, float(areas[f, k])) for f in range(50) for k, level in enumerate(levels) if (f, k) != (7, 2)]
    got = ev.area_order_audit(spark.createDataFrame(rows, "frame_index int, level string, area_median double"), levels).first()
    ordered = sum(bool((np.diff(areas[f]) >= 0).all()) for f in range(50) if f != 7)
    assert (got.ordered_frames, got.frames_tested) == (ordered, 50) and got.ordered_fraction == pytest.approx(ordered / 50)
    for k, level in enumerate(levels):
        seen = [areas[f, k] for f in range(50) if (f, k) != (7, 2)]
        assert got[f"median_{level}"] == pytest.approx(np.median(seen))
