"""Dataset documents from files."""

import json

import pytest

from polyzona.sources import datasets as D


def document(zones):
    return json.dumps({"manifest": {"datasetId": "d", "datasetVersion": "1.0.0"}, "zones": zones}, indent=1)


def zone(i, level, parent=None, ring=((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), **more):
    return {"id": i, "datasetId": "d", "level": level, "name": i, "parentId": parent, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in ring]]}} | more


def test_load(spark, tmp_path):
    (tmp_path / "dataset.json").write_text(document([zone("a", 0), zone("b", 1, "a", neighborIds=[])]))
    rows = {r.id: r for r in D.load(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["b"].parent_id == "a" and rows["a"].bbox_e == 1.0 and rows["a"].center_x == 0.5


@pytest.mark.parametrize("bad, code", [(zone("a", 0), "DUPLICATE_ZONE_ID"), (zone("c", 1, "none"), "MISSING_PARENT"), (zone("c", -1), "INVALID_LEVEL"), (zone("c", 0, ring=((0, 0), (1, 0), (1, 1), (0, 1))), "RING_NOT_CLOSED"), (zone("c", 0, ring=((0, 0), (200, 0), (1, 1), (0, 0))), "COORDINATE_OUT_OF_RANGE")])
def test_invalid(spark, tmp_path, bad, code):
    (tmp_path / "x.json").write_text(document([zone("a", 0), bad]))
    with pytest.raises(D.DatasetInvalid, match=code):
        D.load(spark, str(tmp_path / "x.json"))
