"""File formats: cell files by name, dirty CSV, GeoJSON, listings, manifest resume, streams."""

import json
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stainframe.functions.ordering import exact_percentiles, rank_within
from stainframe.operators.scoring import calibrate_thresholds, score_by, slide_summary, thickness_summary
from stainframe.sources import manifest as V
from stainframe.sources import readers as R
from stainframe.sources import sinks as K
from stainframe.sources.listing import list_files, touch
from stainframe.streaming.incremental import append_slide_scores, follow_cells, read_slide_scores


def test_cells_by_file_name_with_missing_columns_and_a_broken_file(spark, tmp_path):
    pq.write_table(pa.table({"cell_id": [1, 2], "membrane_ring_dab": [0.3, float("nan")], "region": ["Patient_Tissue", "Unknown"]}),
                   tmp_path / "S01_cells.parquet")
    pq.write_table(pa.table({"cell_id": [7], "centroid_x": [4.0]}), tmp_path / "S02_cells.parquet")
    (tmp_path / "S03_cells.parquet").write_bytes(b"not parquet at all, but long enough to be tried")
    rows = {(r["slide_id"], r["cell_id"]): r for r in R.scan_cells(spark, str(tmp_path)).collect()}
    assert set(rows) == {("S01", 1), ("S01", 2), ("S02", 7)}
    assert rows["S01", 2]["membrane_ring_dab"] is None and rows["S02", 7]["region"] is None


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    pq.write_table(pa.table({"cell_id": [1], "region": ["Patient_Tissue"], "solidity": [0.9]}), tmp_path / "S01_cells.parquet")
    df = R.scan_cells(spark, str(tmp_path), "Patient_Tissue", ["cell_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "solidity" not in plan.split("ReadSchema")[1] and "EqualTo(region,Patient_Tissue)" in plan


def test_dirty_baseline_csv(spark, tmp_path):
    head = "slide_name,region,total_cells,negative,weak_1plus,moderate_2plus,strong_3plus,pct_positive,h_score,mean_dab_od"
    text = "\n".join(["# research use only", head, head, " S01 ,Patient_Tissue,100,10,10,40,40,80,210,0.3", "S02,Patient_Tissue,many,1,1,1,1,1,1,1",
                      "S03,iCAP_Control,10,1,1,4,4,80,210,0.3", "S04,Patient_Tissue,0,0,0,0,0,0,0,0"])
    (tmp_path / "b.csv").write_text(text)
    got = {r["slide_name"]: (r["pct_2plus"], r["eligible"]) for r in R.scan_region_summary(spark, str(tmp_path / "b.csv")).collect()}
    assert got == {"S01": (80.0, True), "S04": (0.0, False)}


def test_geojson(spark, tmp_path):
    poly = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"classification": {"name": "Patient_Tissue"}}, "geometry": poly}, {"properties": {}, "geometry": poly}]}
    (tmp_path / "S09.geojson").write_text(json.dumps(doc, indent=2))
    rows = R.scan_region_polygons(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["slide_id"], r["name"], len(r["ring"])) for r in rows] == [("S09", "Patient_Tissue", 4), ("S09", "Unknown", 4)]


def test_tile_listing(spark, tmp_path):
    (tmp_path / "S01").mkdir()
    for name in ("0_352.png", "704_0.png", "thumb.png"):
        (tmp_path / "S01" / name).write_bytes(b"x")
    rows = {(r["slide_id"], r["x"], r["y"]) for r in R.scan_tile_index(spark, str(tmp_path)).collect()}
    assert rows == {("S01", 0, 352), ("S01", 704, 0)}


def test_manifest_resume_and_invalidation(spark, tmp_path):
    path = str(tmp_path / "manifest")
    tiles = spark.createDataFrame([("S01/0_0", 3), ("S01/0_1", 5), ("S01/0_2", 0)], "tile_key string, num_cells int")
    K.manifest_append(K.manifest_records(tiles.limit(0), "labels", "h1", ["num_cells"]), path)
    K.manifest_append(K.manifest_records(tiles.filter("num_cells > 3"), "labels", "h1", ["num_cells"]), path)
    K.manifest_append(K.manifest_records(tiles.filter("num_cells = 3"), "labels", "h1", ["num_cells"]), path)
    m = spark.read.parquet(path)
    assert [r["tile_key"] for r in R.manifest_pending(tiles, m, "h1").collect()] == ["S01/0_2"]
    assert R.manifest_pending(tiles, m, "h2").count() == 3
    assert {(r["tile_key"], r["value"]) for r in R.manifest_stats(m, "h1").collect()} == {("S01/0_0", 3.0), ("S01/0_1", 5.0)}


def test_slide_without_the_region_falls_back_to_all_cells(spark):
    rows = [("A", "Patient_Tissue", 0.5), ("A", "Unknown", 0.01), ("B", "Unknown", 0.5), ("B", "Unknown", None)]
    cells = spark.createDataFrame(rows, "slide_id string, region string, membrane_ring_dab double")
    for c in ("membrane_completeness", "membrane_thickness_px", "raw_membrane_dab"):
        cells = cells.withColumn(c, cells["membrane_ring_dab"])
    got = {r["slide_id"]: r for r in slide_summary(cells).collect()}
    assert (got["A"]["total_cells"], got["A"]["h_score"]) == (1, 300.0)
    assert (got["B"]["total_cells"], got["B"]["n_measured"], got["B"]["h_score"]) == (2, 1, 150.0)


def test_stream_picks_up_each_slide_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("cells", "out", "state"))
    for slide, values in (("S01", [0.5, 0.5]), ("S02", [0.01])):
        folder = tmp_path / "cells" / f"slide_id={slide}"
        folder.mkdir(parents=True)
        pq.write_table(pa.table({"cell_id": list(range(len(values))), "membrane_ring_dab": values}), folder / "part.parquet")
        append_slide_scores(follow_cells(spark, src), out, state).awaitTermination()
    got = {r["slide_id"]: (r["n_cells"], r["h_score"]) for r in spark.read.parquet(out).collect()}
    assert got == {"S01": (2, 300.0), "S02": (1, 0.0)} and spark.read.parquet(out).count() == 2


def test_baseline_keeps_long_lines_and_the_last_of_a_slide(spark, tmp_path):
    head = "slide_name,region,total_cells,negative,weak_1plus,moderate_2plus,strong_3plus,pct_positive,h_score,mean_dab_od"
    (tmp_path / "b.csv").write_text("\n".join([
        head, "S01,Patient_Tissue,100,10,10,40,40,80,210,0.3", "S02,Patient_Tissue,10,1,1,4,4,80,210,0.3,note,again", "S01,Patient_Tissue,50,50,0,0,0,0,0,0.1"]))
    got = {r["slide_name"]: (r["total_cells"], r["pct_2plus"]) for r in R.scan_region_summary(spark, str(tmp_path / "b.csv")).collect()}
    assert got == {"S01": (50, 0.0), "S02": (10, 80.0)}


def test_manifest_steps_are_apart(spark, tmp_path):
    path = str(tmp_path / "manifest")
    tiles = spark.createDataFrame([("S01/0_0", 3), ("S01/0_1", 5)], "tile_key string, num_cells int")
    K.manifest_append(K.manifest_records(tiles, "labels", "h1", ["num_cells"]), path)
    K.manifest_append(K.manifest_records(tiles.filter("num_cells = 3"), "cells", "h1", ["num_cells"]), path)
    m = spark.read.parquet(path)
    assert [r["tile_key"] for r in R.manifest_pending(tiles, m, "h1", step="cells").collect()] == ["S01/0_1"]
    assert R.manifest_pending(tiles, m, "h1", step="labels").count() == 0
    assert R.latest_records(m).count() == 3 and R.manifest_stats(m, "h1", "cells").count() == 1
    twice = m.filter("step = 'cells'").unionByName(m.filter("step = 'cells'").withColumn("stats", F.create_map(F.lit("num_cells"), F.lit(9.0))))
    assert [r["stats"] for r in R.latest_records(twice).collect()] == [{"num_cells": 9.0}]


def test_stream_adds_up_a_slide_of_several_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("cells", "out", "state"))
    folder = tmp_path / "cells" / "slide_id=S01"
    folder.mkdir(parents=True)
    for i, values in enumerate(([0.5], [0.01], [0.5, 0.01, 0.25])):
        pq.write_table(pa.table({"cell_id": list(range(len(values))), "membrane_ring_dab": values}), folder / f"part{i}.parquet")
        append_slide_scores(follow_cells(spark, src), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    whole = score_by(R.scan_cells(spark, src), ["slide_id"]).first()
    merged = read_slide_scores(spark, out).first()
    assert merged["n_cells"] == 5 and {k: whole[k] for k in merged.asDict()} == merged.asDict()


def test_stored_grade_and_thickness_count(spark):
    rows = [("A", None, 0.5, 1, None, 2.0, None), ("A", None, 0.5, None, 0, 2.0, 3.0), ("A", None, 0.5, None, None, 2.0, None)]
    cells = spark.createDataFrame(rows, "slide_id string, region string, membrane_ring_dab double, grade byte, grade_dab byte, membrane_thickness_px double, membrane_thickness_um double")
    for c in ("membrane_completeness", "raw_membrane_dab"):
        cells = cells.withColumn(c, cells["membrane_ring_dab"])
    got = slide_summary(cells).first()
    assert (got["negative"], got["weak_1plus"], got["strong_3plus"]) == (1, 1, 1) and got["mean_thickness_um"] == pytest.approx((1 + 3 + 1) / 3)
    both = {r["level"]: r for r in thickness_summary(cells).collect()}
    assert set(both) == {"slide", "region"} and both["slide"]["median_px"] == both["region"]["median_px"] == 2.0


def test_null_keys_are_groups(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(100)] + [("a", float(i)) for i in range(100)], "k string, v double")
    assert {r["m"] for r in exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect()} == {49.5}
    ranked = rank_within(df, ["k"], [F.col("v")])
    assert ranked.count() == 200 and ranked.filter("k IS NULL AND rank = v AND group_size = 100").count() == 100
    low = spark.createDataFrame([(None, 0.12)] * 100, "region string, membrane_ring_dab double")
    assert [tuple(r)[2:] for r in calibrate_thresholds(low, ["region"]).collect()] == [(0.12, 0.12, 0.2)]


def test_giant_slide_is_written_by_several_tasks(spark, tmp_path):
    cells = spark.range(200_000).selectExpr("CASE WHEN id % 10 = 0 THEN concat('S', id % 7) ELSE 'GIANT' END AS slide_id", "id AS cell_id", "rand() AS area_um2")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        K.write_cells(cells, str(tmp_path / "cells"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = [len(list(d.glob("*.parquet"))) for d in (tmp_path / "cells").glob("slide_id=*")]
    assert len(list((tmp_path / "cells" / "slide_id=GIANT").glob("*.parquet"))) > 1 and len(files) == 8
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 200_000


def test_listing_of_many_folders(spark, tmp_path):
    """10,000 empty files in 500 folders, listed by tasks that each take some folders."""
    paths = spark.range(10_000).selectExpr("concat('S', id % 500, '/', id, '_', id * 2, if(id % 10 = 0, '.TXT', '.png')) AS path")
    assert touch(paths, str(tmp_path / "all")) == 10_000
    (tmp_path / "all" / "5_6.png").write_bytes(b"abc")
    (tmp_path / "all" / "S1" / "deep").mkdir()
    (tmp_path / "all" / "S1" / "deep" / "7_8.PNG").write_bytes(b"")
    df = list_files(spark, [str(tmp_path / "none"), f"file://{tmp_path}/all"])
    assert df.count() == 10_002 and df.rdd.getNumPartitions() >= 32
    png = list_files(spark, [str(tmp_path / "all")], [".png"])
    assert png.count() == 9_002
    got = {r["name"]: (r["folder"], r["stem"], r["ext"], r["size"], r["priority"]) for r in png.where("name in ('5_6.png', '7_8.PNG', '11_22.png')").collect()}
    assert got == {"5_6.png": ("", "5_6", ".png", 3, 0), "7_8.PNG": ("S1/deep", "7_8", ".png", 0, 0), "11_22.png": ("S11", "11_22", ".png", 0, 0)}
    tiles = R.scan_tile_index(spark, str(tmp_path / "all"))
    assert tiles.where("slide_id = 'S11'").count() == 20 and tiles.where("slide_id = 'S10'").count() == 0


def test_tile_csv_is_a_file_for_each_tile(spark, tmp_path):
    rows = [(s, x, y, 10 * x + k, 1.23456 + k, 2.0, None if k else 3.5, None, 0.5, 0.25, k) for s in ("A", "B") for x in range(3) for y in range(2) for k in range(2)]
    cells = spark.createDataFrame(rows, "slide_id string, tile_x bigint, tile_y bigint, cell_id bigint, centroid_x double, centroid_y double, membrane_thickness_px double, "
                                  "membrane_thickness_um double, membrane_completeness double, membrane_ring_dab double, grade int")
    out = K.tile_csv_rows(cells)
    K.write_tile_csv(out, str(tmp_path / "csv"))
    files = list(tmp_path.glob("csv/slide_id=*/tile_x=*/tile_y=*/*.csv"))
    assert len(files) == 12
    text = next(tmp_path.glob("csv/slide_id=A/tile_x=1/tile_y=0/*.csv")).read_text().splitlines()
    assert text == ["cell_id,centroid_x,centroid_y,thickness_px,thickness_um,completeness,dab_intensity,composite_grade",
                    "10,1.2346,2.0000,3.5000,,0.5000,0.2500,0", "11,2.2346,2.0000,,,0.5000,0.2500,1"]
    back = K.read_tile_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.select(*out.columns).collect())) == sorted(map(tuple, out.collect()))


def _done(spark, *tiles):
    return K.manifest_records(spark.createDataFrame(list(tiles), "tile_key string, num_cells int"), "labels", "h1", ["num_cells"])


def _values(spark, path, of=None):
    return sorted((r["tile_key"], r["value"]) for r in R.manifest_stats(V.read(spark, path, of), "h1").collect())


def test_manifest_versions_of_two_writers(spark, tmp_path):
    """Both start from one version: the second to publish finds the number taken, and an append goes on from there."""
    path = str(tmp_path / "m")
    assert V.version(spark, path) == V.Version()
    start = V.append(_done(spark, ("A", 1)), path)
    first, second = V.stage(_done(spark, ("B", 2)), path), V.stage(_done(spark, ("C", 3)), path)
    V.publish(spark, path, start, start.folders + first.folders, start.schema)
    with pytest.raises(V.Conflict):
        V.publish(spark, path, start, start.folders + second.folders, start.schema)
    assert _values(spark, path) == [("A", 1.0), ("B", 2.0)]
    with pytest.raises(V.Conflict):
        V.append(_done(spark, ("D", 4)), path, base=start)
    assert V.append(_done(spark, ("C", 3)), path).number == 3
    assert _values(spark, path) == [("A", 1.0), ("B", 2.0), ("C", 3.0)]
    assert _values(spark, path, V.version(spark, path, 1)) == [("A", 1.0)]
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: V.append(_done(spark, (f"T{i}", i)), path).number, range(8)))
    assert sorted(made) == list(range(4, 12)) and len(_values(spark, path)) == 11


def test_manifest_writer_killed_before_publishing(spark, tmp_path):
    path = str(tmp_path / "m")
    V.append(_done(spark, ("A", 1)), path)
    V.stage(_done(spark, ("A", 7), ("B", 2)), path)
    (tmp_path / "m" / "versions" / "draft-dead").write_text('{"number": 2, "fol')
    assert _values(spark, path) == [("A", 1.0)]
    assert V.append(_done(spark, ("C", 3)), path).number == 2
    assert _values(spark, path) == [("A", 1.0), ("C", 3.0)]


def test_manifest_compaction(spark, tmp_path, monkeypatch):
    """The last record of a tile stays; what comes in while records are rewritten stays too; two compactions do not mix."""
    path = str(tmp_path / "m")
    for row in (("A", 1), ("B", 2), ("A", 5)):
        V.append(_done(spark, row), path)
    old, staged = V.version(spark, path), V.stage

    def slow(records, where):
        got = staged(records, where)
        monkeypatch.setattr(V, "stage", staged)
        V.append(_done(spark, ("C", 3)), path)
        return got

    monkeypatch.setattr(V, "stage", slow)
    made = V.compact(spark, path)
    assert (made.number, len(made.folders)) == (5, 2)
    assert _values(spark, path) == [("A", 5.0), ("B", 2.0), ("C", 3.0)]
    assert _values(spark, path, old) == [("A", 1.0), ("A", 5.0), ("B", 2.0)]

    def slower(records, where):
        got = staged(records, where)
        monkeypatch.setattr(V, "stage", staged)
        V.compact(spark, path)
        return got

    monkeypatch.setattr(V, "stage", slower)
    with pytest.raises(V.Conflict):
        V.compact(spark, path)
    assert len(_values(spark, path)) == 3


def test_manifest_empty_and_other_columns(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(ValueError):
        V.read(spark, path)
    assert V.compact(spark, path) == V.Version()
    V.append(_done(spark, ("A", 1)).limit(0), path)
    assert V.read(spark, path).count() == 0
    V.append(_done(spark, ("A", None), ("B", 2)), path)
    assert _values(spark, path) == [("A", None), ("B", 2.0)]
    with pytest.raises(ValueError):
        V.append(_done(spark, ("A", 1)).drop("stats"), path)


def test_files_are_made_and_listed_by_many_tasks(spark, tmp_path):
    """A short list in one task, as from one small file, and folders fewer than one old share."""
    paths = spark.range(60).coalesce(1).selectExpr("concat('S', id % 12, '/', id, '_', id, '.png') AS path")
    marks = paths.withColumn("path", F.col("path"))
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("touch", "touch")
    assert touch(marks, str(tmp_path / "few")) == 60
    stages = [before.getStageInfo(s) for j in before.getJobIdsForGroup("touch") for s in before.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert max(s.numTasks for s in stages if s) >= spark.sparkContext.defaultParallelism
    assert list_files(spark, [str(tmp_path / "few")]).rdd.getNumPartitions() == 13
