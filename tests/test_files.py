import hashlib
import json
import zipfile

import numpy as np
import pytest

from typolith.sources import files
from typolith.sources.files import LONG, read_long, write_long


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_round_trip(spark, tmp_path, kind):
    rows = spark.sql("SELECT id AS entity, DATE '2020-01-01' AS period, concat('c,', id % 2) AS category, CASE WHEN id = 3 THEN NULL ELSE id / 2e0 END AS value FROM range(5)")
    write_long(rows, str(tmp_path / kind), kind)
    back = read_long(spark, str(tmp_path / kind), kind)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def test_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a", 1.0), (2, None, "b", 2.0)], LONG)
    write_long(rows, str(tmp_path / "x"), by="category")
    assert {p.name for p in (tmp_path / "x").glob("category=*")} == {"category=a", "category=b"}
    assert read_long(spark, str(tmp_path / "x")).count() == 2


def test_delimited_and_matrix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code;name;v\n01;x;1,5\n02;y;1 000,25\n03;z;-\n04;;\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "a.csv"), ["v"]).collect()] == [("01", "x", 1.5), ("02", "y", 1000.25), ("03", "z", None), ("04", None, None)]
    (tmp_path / "m.csv").write_text("id,2023-01,2023-02\n7,1,2\n8,,0\n")
    assert sorted(map(tuple, files.read_matrix(spark, str(tmp_path / "m.csv"), "id").collect()), key=str) == sorted([(7, "2023-01", 1), (7, "2023-02", 2), (8, "2023-01", None), (8, "2023-02", 0)], key=str)


def test_tagged_union(spark, tmp_path):
    (tmp_path / "summary_a.csv").write_text("k,x\n1,2\n")
    (tmp_path / "summary_b.csv").write_text("k,y\n3,4\n")
    rows = files.read_tagged(spark, sorted(map(str, tmp_path.glob("summary_*.csv")))).collect()
    assert sorted((r.file, r.k, r.x, r.y) for r in rows) == [("summary_a", "1", "2", None), ("summary_b", "3", None, "4")]


def test_geojson(spark, tmp_path):
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "g.json").write_text(json.dumps(shape, indent=1))
    (row,) = files.read_geojson(spark, str(tmp_path / "g.json")).collect()
    assert json.loads(row.properties) == {"id": 1} and row.kind == "Point" and json.loads(row.geometry)["coordinates"] == [1, 2]


def test_sparse_workbook_and_zip(spark, tmp_path):
    np.savez_compressed(tmp_path / "m.npz", format=np.array("csr"), indptr=np.array([0, 2, 2, 3]), indices=np.array([0, 2, 1]), data=np.array([1.0, 2.0, 3.0]), shape=np.array([3, 3]))
    assert sorted((r.i, r.j, r.w) for r in files.read_sparse(spark, str(tmp_path / "m.npz")).collect()) == [(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0)]
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{space}"><si><t>name</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>4.5</v></c></row></sheetData></worksheet>')
    assert [(r.row, r.cells) for r in files.read_workbook(spark, str(tmp_path / "b.xlsx")).collect()] == [(2, {"A": "name", "C": "4.5"})]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        archive.writestr("d.csv", "year;v\n2022;a\n2023;b\n")
    assert [(r.entry, r.fields) for r in files.read_zipped(spark, str(tmp_path / "z.zip"), "year", ["2023"]).collect()] == [("d.csv", {"year": "2023", "v": "b"})]


def test_fetch(tmp_path):
    (tmp_path / "a").write_bytes(b"some bytes")
    digest, url, target = hashlib.sha256(b"some bytes").hexdigest(), (tmp_path / "a").as_uri(), str(tmp_path / "b")
    assert files.fetch(url, target, digest) == digest
    (tmp_path / "a").unlink()
    assert files.fetch(url, target) == digest
    with pytest.raises(ValueError):
        files.fetch(url, target, "0")


def test_written_forms(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "a"', 2.0), (2, None, 3.0)], "id long, name string, v double").coalesce(1)
    files.write_bundle(rows, str(tmp_path / "j"), more=["name", "v"])
    assert sorted((r.id, r.more.v) for r in spark.read.json(str(tmp_path / "j")).collect()) == [(1, 2.0), (2, 3.0)]
    files.write_client_csv(rows, str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*")
    assert part.read_bytes().decode("utf-8") == '\ufeff"id","name","v"\r\n"1","say ""a""","2.0"\r\n"2","","3.0"\r\n'
    assert files.markdown_table(rows.filter("id = 2")) == "| id | name | v |\n| --- | --- | --- |\n| 2 |  | 3.0 |\n"
    with pytest.raises(ValueError):
        files.markdown_table(rows, most=1)
    (tmp_path / "y.yml").write_text("a: 1\nnames:\n  x: old\nb: 2\n")
    files.write_names(str(tmp_path / "y.yml"), {"x": "new"})
    assert (tmp_path / "y.yml").read_text() == 'a: 1\nb: 2\nnames:\n  "x": "new"\n'
