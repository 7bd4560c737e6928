import json

import pytest

from tagweave.operators import datasets, scoring
from tagweave.sources import files

BOX = "struct<x double, y double, w double, h double>"


def test_tags(spark):
    truth = spark.createDataFrame([("pi  715A",), ("V-1",), ("V-2",)], "tag string")
    nodes = spark.createDataFrame([("PI 715A",), ("V-9",), (None,), ("",)], "tag string")
    assert tuple(scoring.tag_accuracy(truth, nodes).first()) == (1, 1, 2, 0.5, 0.333, 0.4)
    assert [r.tag for r in scoring.missed_tags(truth, nodes).collect()] == ["V-1", "V-2"]
    none = nodes.limit(0)
    assert tuple(scoring.tag_accuracy(truth, none).first()) == (0, 0, 3, None, 0.0, None)
    assert tuple(scoring.tag_accuracy(none, none).first()) == (0, 0, 0, None, None, None)


def test_coverage(spark):
    truth = spark.createDataFrame([("valve",)] * 3 + [("equipment",)], "category string")
    nodes = spark.createDataFrame([("safety_valve",), ("valve",), ("unknown",), (None,)], "component_type string")
    got = {r.category: tuple(r)[1:] for r in scoring.category_coverage(truth, nodes).collect()}
    assert got == {"valve": (3, 2, 66.7), "equipment": (1, 0, 0.0)}


def test_boxes_by_hand(spark):
    truth = spark.createDataFrame([(0, 0, "valve", (0.0, 0.0, 10.0, 10.0)), (1, 0, "equipment", (100.0, 100.0, 20.0, 20.0)), (2, 0, "instrument", (0.0, 0.0, 4.0, 4.0)), (3, 1, "valve", (0.0, 0.0, 10.0, 10.0)), (4, 1, "equipment", (0.0, 0.0, 5.0, 5.0))], f"gt_id int, page int, category string, bbox {BOX}")
    nodes = spark.createDataFrame([(0, "valve", 0, (5.0, 0.0, 10.0, 10.0)), (0, "safety_valve", 1, (3.0, 4.0, 10.0, 10.0)), (0, "tank", 2, (100.0, 100.0, 20.0, 10.0)), (0, "flow_indicator", 3, (300.0, 400.0, 4.0, 4.0)), (1, "pump", 4, (0.0, 0.0, 5.0, 5.0))], f"page int, component_type string, ord int, bbox {BOX}")
    near = scoring.nearest_detections(truth, nodes, 120.0)
    got = {r.gt_id: (r.matched, r.nearest_center_distance_px, r.iou) for r in near.collect()}
    # both valves are 5 away, so the first counts: 50 of 150; the tank 200 of 400; the indicator is out of reach
    assert got == {0: (True, 5.0, 0.333), 1: (True, 5.0, 0.5), 2: (False, 500.0, 0.0), 3: (False, None, 0.0), 4: (True, 0.0, 1.0)}
    score = scoring.box_score(near).first()
    assert (score.sample_size, score.matched_count, score.unmatched_count, score.mean_iou_matched, score.mean_iou_all) == (5, 3, 2, 0.611, 0.367)


def test_ground_truth_files(spark, tmp_path):
    part = lambda **x: {"category": "valve", "tag": "V-1", "symbol": "gate", "source": "read", **x}
    (tmp_path / "a.json").write_text(json.dumps({"page_index": 3, "note": "x", "components": [part(), part(page=1, bbox=[1, 2, 3.5, 4]), part(bbox=[1, 2]), part(tag=None, bbox=None)]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"components": [part(page=0, bbox=[0, 0, 1, 1])]}))
    rows = files.ground_truth(spark, f"{tmp_path}/*.json").collect()
    assert sorted((r.page, r.nth, r.tag or "", tuple(r.bbox) if r.bbox else None) for r in rows) == [(0, 0, "V-1", (0.0, 0.0, 1.0, 1.0)), (1, 1, "V-1", (1.0, 2.0, 3.5, 4.0)), (3, 0, "V-1", None), (3, 2, "V-1", None), (3, 3, "", None)]


def test_relabelling(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "images").mkdir()
    for name, text in {"a": "0 .1 .2 .3 .4\n3 1 1 1 1\n\n21 .5 .5 .5 .5\n", "b": "3 1 1 1 1", "c": ""}.items():
        (tmp_path / "labels" / f"{name}.txt").write_text(text)
    for name in "abd":
        (tmp_path / "images" / f"{name}.jpg").write_bytes(b"x")
    lines = datasets.box_lines(files.label_files(spark, str(tmp_path / "labels")))
    images = files.image_files(spark, str(tmp_path / "images"), "*.jpg")
    merged = datasets.merged_split(images, lines, datasets.fixed_map(spark), "one", "train")
    assert [(r.name, r.boxes, r.labels) for r in merged.collect()] == [("one_a", 2, "0 .1 .2 .3 .4\n2 .5 .5 .5 .5")]
    (tmp_path / "data.yaml").write_text("nc: 3\nnames: ['Gate Valve', 'Arrow', \"Pump\"]\n")
    (tmp_path / "data2.yaml").write_text("names:\n  - Gate Valve\n  - Arrow\n  - Pump\n")
    for f in ("data.yaml", "data2.yaml"):
        classes = datasets.class_map(files.class_names(spark, str(tmp_path / f)))
        assert sorted(map(tuple, classes.collect())) == [(0, 0), (2, 2)]
    both = datasets.union_all([merged, datasets.merged_split(images, lines, datasets.class_map(files.class_names(spark, str(tmp_path / "data.yaml"))), "two", "valid")])
    assert sorted(map(tuple, datasets.split_stats(both).collect())) == [("one", "train", 1, 2), ("two", "valid", 1, 1)]


def test_model_files(tmp_path, monkeypatch):
    (tmp_path / "w").write_text("")
    assert files.model_file(None, str(tmp_path / "w")) and files.model_file(None, "/none") is None
    monkeypatch.setenv("DETECTOR_WEIGHTS", str(tmp_path / "w"))
    assert files.model_file(None, "/none") == str(tmp_path / "w")
