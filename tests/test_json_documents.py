"""One JSON document in many splits against the json module, and back."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fernlake.sources import artifacts, coco
from fernlake.sources import json_documents as jd

ODD = ['a,b', 'quote " here', "back\\slash", '\\"', "br{ack]et", "", "ünï,çödé 東京", '","', "\n\t", "\\\\", '},{"x":[']


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "900")
    yield
    for name in names:
        spark.conf.unset(name)


def _value(rng, deep=0):
    kind = rng.randrange(7 if deep < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, rng.randrange(10**6), -1.5e-7])
    if kind < 4:
        return "".join(rng.choices(ODD, k=rng.randrange(3)))
    if kind < 6:
        return {rng.choice(ODD) + str(i): _value(rng, deep + 1) for i in range(rng.randrange(4))}
    return [_value(rng, deep + 1) for _ in range(rng.randrange(4))]


def _told(spark, path):
    """``field`` to its elements in order; the document's own members under the empty name."""
    fields = {}
    for r in jd.elements(spark, path).orderBy("split", "n").collect():
        own = fields.setdefault(r["field"], [])
        if r["raw"]:
            own.append(r["raw"].strip())
    return fields


@pytest.mark.parametrize("seed, indent", [(1, None), (2, 2), (3, None), (4, 1), (5, None), (6, None)])
def test_elements_equal_the_json_module(spark, small_splits, tmp_path, seed, indent):
    rng = random.Random(seed)
    doc = {}
    for i in range(rng.randrange(1, 9)):
        key = rng.choice(ODD) + f"field {i}"
        doc[key] = rng.choice([lambda: [_value(rng) for _ in range(rng.randrange(40))], lambda: {f"{rng.choice(ODD)}{j}": _value(rng) for j in range(rng.randrange(30))}, lambda: "x" * rng.randrange(900), lambda: _value(rng, 3)])()
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=rng.random() < 0.5))
    if path.stat().st_size > 2000:
        assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 1
    found = _told(spark, str(path))
    assert found.pop("")[0] == "{"
    own = jd.members(jd.elements(spark, str(path)).filter("field = '' and raw not in ('{', '')"))
    plain = {k: v for k, v in doc.items() if not isinstance(v, (list, dict))}
    assert {r["key"] for r in own.collect()} == set(plain)
    assert {r["key"]: r["value"] for r in own.collect() if isinstance(plain[r["key"]], str)} == {k: v for k, v in plain.items() if isinstance(v, str)}
    held = {k: v for k, v in doc.items() if isinstance(v, (list, dict))}
    assert {k: [json.loads(x) if isinstance(doc[k], list) else json.loads("{" + x + "}") for x in v] for k, v in found.items()} == {k: v if isinstance(v, list) else [{a: b} for a, b in v.items()] for k, v in held.items()}


def test_what_is_no_whole_document_raises(spark, tmp_path):
    for text in ('{"a": [1, 2', '{"a": "b', "]"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match="no whole JSON document"):
            jd.elements(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize("text", ["[]", "[1, {}]", "7", ""])
def test_documents_that_are_no_objects(spark, tmp_path, text):
    (tmp_path / "list.json").write_text(text)
    with pytest.raises(ValueError, match="no object"):
        artifacts.load_groups(spark, str(tmp_path / "list.json"))
    assert coco.read_coco(spark, str(tmp_path / "list.json"))[0].count() == 0


def test_summaries_compose():
    rng = random.Random(9)
    for _ in range(200):
        text = json.dumps([_value(rng) for _ in range(6)], ensure_ascii=False).encode()
        cuts = sorted(rng.sample([i + 1 for i, c in enumerate(text) if c == 44] or [0], k=min(4, max(1, text.count(b",")))))
        inside, depth = False, 0
        for low, high in zip([0, *cuts], [*cuts, len(text)]):
            flips, out, inn = jd.summary(text[low:high])
            inside, depth = inside ^ flips, depth + (inn if inside else out)
        assert (inside, depth) == (False, 0)


def test_documents_are_written_from_all_tasks_and_read_back(spark, small_splits, tmp_path):
    rows = spark.range(90).select((F.col("id") * 7 % 90).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a,"b'), F.col("id").cast("string"))).alias("v")).repartition(5)
    path = f"{tmp_path}/out/doc.json"
    for _ in range(2):  # the second replaces the first
        jd.write_document(spark, path, {"version": "1", "list": ("[]", rows.select("k", jd.value("k", "v").alias("raw")), ["k"]), "map": ("{}", rows.select("k", jd.member(F.col("k"), F.col("v")).alias("raw")), ["k"]), "none": ("[]", rows.limit(0).select("k", F.lit("").alias("raw")), ["k"]), "meta": {"x": [1]}})
    want = {r["k"]: r["v"] for r in rows.orderBy("k").collect()}
    doc = json.load(open(path))
    assert doc == {"version": "1", "list": [{"k": k, "v": v} for k, v in want.items()], "map": {str(k): v for k, v in want.items()}, "none": [], "meta": {"x": [1]}}
    assert [k for k in doc["map"]] == [str(k) for k in sorted(want)]
    assert os.listdir(f"{tmp_path}/out") == ["doc.json"] or {f for f in os.listdir(f"{tmp_path}/out") if not f.startswith(".")} == {"doc.json"}
    back = jd.elements(spark, path)
    assert {int(r["key"]): r["value"] for r in jd.members(back.filter("field = 'map' and raw <> ''")).collect()} == want
    assert back.filter("field = 'list' and raw <> ''").count() == 90


def test_a_manifest_of_many_splits(spark, small_splits, tmp_path):
    names = spark.createDataFrame([(f"{rn},{x}.jpg", f"group_{rn:06d}") for rn, x in enumerate(ODD * 20)], "file_name string, group_id string")
    artifacts.save_manifest(names, f"{tmp_path}/m.json", "groups")
    assert sorted(map(tuple, artifacts.load_groups(spark, f"{tmp_path}/m.json").collect())) == sorted(map(tuple, names.collect()))
    (tmp_path / "bare.json").write_text(json.dumps({r["file_name"]: r["group_id"] for r in names.collect()}))
    assert sorted(map(tuple, artifacts.load_groups(spark, f"{tmp_path}/bare.json").collect())) == sorted(map(tuple, names.collect()))
    artifacts.save_manifest(names.limit(0), f"{tmp_path}/empty.json", "groups")
    assert artifacts.load_groups(spark, f"{tmp_path}/empty.json").count() == 0


@pytest.mark.parametrize("text, cut", [("short", b",\n"), ("x,y" * 5000, b",")])
def test_documents_with_lines_are_cut_at_lines_unless_one_is_long(spark, small_splits, tmp_path, text, cut):
    path = str(tmp_path / "d.json")
    doc = {"images": [{"id": i, "file_name": text if i == 70 else f"a,\n{i}"} for i in range(100)], "n": [1]}
    with open(path, "w") as f:
        f.write("{" + ",\n".join(f"{json.dumps(k)}: [" + ",\n".join(json.dumps(v) for v in own) + "]" for k, own in doc.items()) + "}\n")
    rows, separator, found = jd._cut_at(spark, path)
    assert separator == cut and len(found) > 1
    if cut == b",\n":
        assert rows.count() < 110  # a row an element, not one a member
    assert [json.loads(r) for r in _told(spark, path)["images"]] == doc["images"]


def test_an_element_is_parsed_once(spark, tmp_path):
    path = str(tmp_path / "d.json")
    with open(path, "w") as f:
        json.dump({"annotations": [{"image_id": 1, "bbox": [1, 2, 3, 4], "category_id": 1}]}, f)
    _, boxes, _ = coco.read_coco(spark, path)
    optimized = boxes._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json(") == optimized.count("Generate inline(")
    assert boxes.count() == 1
