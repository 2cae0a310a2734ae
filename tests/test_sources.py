"""Readers, combining and writing."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from veriloom.plans import ingest, load_all
from veriloom.sources import combine, files, readers, sinks


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\x00" + b"\x10\x20\x30" * width for _ in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_info(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(5, 3))
    got = readers.read_image_info(spark, str(tmp_path)).select("width", "height", "mode", "content").first()
    assert tuple(got) == (5, 3, "RGB", "[Image: PNG 5x3]")


def test_text_files_with_both_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_text("Grüße\nzwei Zeilen", encoding="utf-8")
    (tmp_path / "l.txt").write_bytes("Grüße\n".encode("latin-1"))
    got = {r["encoding_used"]: r for r in readers.read_text_files(spark, str(tmp_path)).collect()}
    assert (got["utf-8"]["content"], got["utf-8"]["character_count"], got["utf-8"]["word_count"], got["utf-8"]["line_count"]) == ("Grüße\nzwei Zeilen", 17, 3, 2)
    assert (got["latin-1"]["content"], got["latin-1"]["line_count"]) == ("Grüße\n", 2)


def test_csv_json_parquet_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for kind in sinks.FORMATS:
        path = sinks.write(df, str(tmp_path / f"t.{kind}"), kind)
        assert rows(readers.read_structured(spark, path), "id") == [(1, "a"), (2, None)]
    (tmp_path / "array.json").write_text('[{"id": 1}, {"id": 2}]')
    assert readers.read_json(spark, str(tmp_path / "array.json"), lines=False).count() == 2
    with pytest.raises(ValueError):
        readers.read_structured(spark, "t.xyz")


def test_listing_and_routing(spark, tmp_path):
    for name in ("a.CSV", "b.txt", "c.zip", "d.pdf"):
        (tmp_path / name).write_text("x")
    routed = readers.route_formats(readers.list_objects(spark, str(tmp_path)))
    got = {r["file_name"]: (r["file_class"], r["processing_status"]) for r in routed.collect()}
    assert got == {"a.CSV": ("structured", "success"), "b.txt": ("unstructured", "success"), "c.zip": ("unsupported", "unsupported"),
                   "d.pdf": ("unstructured", "unsupported")}
    assert readers.list_objects(spark, str(tmp_path), [".csv"]).count() == 1
    assert readers.list_objects(spark, str(tmp_path), max_keys=2).count() == 2


def test_jdbc_options():
    o = readers.jdbc_options("postgresql", "db", "claims", query="select 1 as id", split_on="id", lower=0, upper=100, parts=8)
    assert o == {"url": "jdbc:postgresql://db:5432/claims", "fetchsize": "10000", "dbtable": "(select 1 as id) src",
                 "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}
    assert readers.jdbc_options("oracle", "h", "x", table="t", user="u", password="p")["url"] == "jdbc:oracle:thin:@//h:1521/x"
    for bad in ({"kind": "sybase", "table": "t"}, {"kind": "mysql"}, {"kind": "mysql", "table": "t", "query": "q"}):
        with pytest.raises(ValueError):
            readers.jdbc_options(host="h", database="d", **bad)


def test_combine_tags_only_several_sources(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, z string")
    assert combine.combine(spark, {"a": a}).columns == ["x"]
    assert rows(combine.combine(spark, {"a": a, "b": b}).select("x", "z", "_data_source"), "x") == [(1, None, "a"), (2, "y", "b")]
    assert combine.combine(spark, {}, "x int").count() == 0


def test_incremental_does_not_load_the_mark_twice(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "t int")
    first = df.where("t <= 4")
    second = combine.since(df, "t", combine.high_water_mark(first, "t"), F.lit(7))
    assert rows(second, "t") == [(5,), (6,), (7,)]


def test_flatten(spark):
    df = spark.sql("select named_struct('a', 1, 'b', named_struct('c', array(1, 2))) as s, 'x' as k")
    assert rows(sinks.flatten(df)) == [(1, "[1,2]", "x")]
    assert sinks.flatten(df).columns == ["s_a", "s_b_c", "k"]


def test_a_large_file_is_read_by_several_tasks_without_cutting_lines(spark, tmp_path):
    lines = [f"{i} " + "grün " * (i % 50) for i in range(20_000)] + ["x" * 300_000, "", "end without a line feed"]
    (tmp_path / "big.txt").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    out = files.read_files(spark, str(tmp_path), lambda key, start, data: [(line.decode(),) for line in data.split(b"\n")[:-1] or [data]]
                           if data.endswith(b"\n") else [(line.decode(),) for line in data.split(b"\n")], "line string", range_bytes=100_000)
    assert out.rdd.getNumPartitions() > 20
    got = out.orderBy("start").collect()
    assert sorted(r["line"] for r in got) == sorted(lines) and {r["processing_status"] for r in got} == {"success"}
    totals = files.file_status(out).first()
    assert totals["bytes"] == (tmp_path / "big.txt").stat().st_size and totals["ranges"] > 20
    counts = files.read_files(spark, f"file:{tmp_path}/big.txt", files.text_counts, "e string, c long, w long, n long", range_bytes=100_000)
    text = "\n".join(lines)
    assert tuple(counts.agg(F.sum("c"), F.sum("w"), F.sum("n")).first()) == (len(text), len(text.split()), text.count("\n"))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_ranges_hold_every_line_once(size, tmp_path):
    for text in (b"", b"\n", b"a", b"a\n", b"\n\n\n", b"ab\ncd", b"ab\n\ncdefghi\nj\n"):
        (tmp_path / "f").write_bytes(text)
        path = str(tmp_path / "f")
        pieces = [p for t in files.plan_ranges([(path, len(text))], size, False) for p in t.pieces]
        with open(path, "rb") as handle:
            found = [files.read_lines(handle, start, end, len(text), block=2) for _, start, end in pieces]
        assert b"".join(d for _, d in found) == text
        assert all(text[at:at + len(d)] == d for at, d in found if d)


def test_a_function_that_raises_gives_a_failed_row(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.csv").write_text(f"a,b\n{i},1\n" if i else "")
    (tmp_path / "note.txt").write_text("not asked for")

    def rows_of(key, start, data):
        if key.endswith("/7.csv"):
            raise KeyError("no column b")
        return [tuple(map(int, line.split(b","))) for line in data.split()[1:]]

    out = files.read_files(spark, str(tmp_path), rows_of, "a long, b long", ["CSV"], whole=True)
    assert out.rdd.getNumPartitions() < 30  # small files share tasks
    got = {r["key"].rsplit("/", 1)[1]: (r["processing_status"], r["error_message"], r["a"]) for r in out.collect()}
    assert len(got) == 30 and got.pop("7.csv") == ("error", "KeyError: 'no column b'", None) and got.pop("0.csv") == ("success", None, None)
    assert all(v == ("success", None, int(k[:-4])) for k, v in got.items())
    status = {r["key"].rsplit("/", 1)[1]: r["processing_status"] for r in files.file_status(out).collect()}
    assert [k for k, v in status.items() if v == "error"] == ["7.csv"] and len(status) == 30
    wrong = files.read_files(spark, str(tmp_path / "1.csv"), lambda *a: [(1,)], "a long, b long").first()
    assert wrong["processing_status"] == "error" and "2 values" in wrong["error_message"]
    (tmp_path / "none").mkdir()
    assert files.read_files(spark, str(tmp_path / "none"), rows_of, "a long, b long").count() == 0


def test_a_folder_of_part_files_is_one_table(spark, tmp_path):
    root = str(tmp_path / "sf0.1")
    spark.range(0, 10, 1, 3).write.parquet(f"{root}/orders.parquet")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(f"{root}/deep/parts.parquet")
    spark.range(2).coalesce(1).write.csv(f"{root}/plain")
    listing = readers.list_objects(spark, root, tables=True)
    assert sorted(r["file_name"] for r in listing.where("extension = 'parquet'").collect()) == ["orders.parquet", "parts.parquet"]
    assert listing.where("extension = 'csv'").count() == 1
    assert listing.agg(F.sum("size")).first()[0] == readers.list_objects(spark, root).agg(F.sum("size")).first()[0]
    assert [tuple(r) for r in readers.file_summary(spark.read.parquet(f"{root}/orders.parquet"), root).collect()] == [("orders.parquet", 10, 1)]


def test_a_file_joined_from_parts_has_every_line_once(spark, tmp_path):
    lines = spark.range(0, 1000, 1, 7).select(F.concat(F.lit("é line "), "id").alias("value"))
    path = files.write_joined(lines, f"file:{tmp_path}/out")
    assert [(k.rsplit("/", 1)[1], n) for k, n in files.list_files(str(tmp_path / "out"))] == [("joined.txt", sum(len(f"é line {i}".encode()) + 1 for i in range(1000)))]
    assert (tmp_path / "out/joined.txt").read_text().splitlines() == [f"é line {i}" for i in range(1000)]
    assert files.list_files(files.write_joined(lines.limit(0), str(tmp_path / "none"))) == [(str(tmp_path / "none/joined.txt"), 0)]


def test_every_structured_object_is_summarized(spark, tmp_path):
    root = str(tmp_path / "in")
    spark.range(0, 10, 1, 3).withColumn("b", F.lit(1)).write.parquet(f"{root}/orders.parquet")
    spark.range(0).write.parquet(f"{root}/none.parquet")
    spark.range(7).write.json(f"{root}/deep/e.json")
    (tmp_path / "in/a[1].CSV").write_text("x,y,z\n1,2,3\n4,5,6\n")
    (tmp_path / "in/a1.CSV").write_text("x\n1\n")
    (tmp_path / "in/bad.parquet").write_text("not a table")
    (tmp_path / "in/note.txt").write_text("text")
    (tmp_path / "in/c.zip").write_text("x")
    out = readers.summarize_objects(spark, readers.list_objects(spark, root, tables=True))
    got = {r["file_name"]: (r["processing_status"], r["rows"], r["columns"]) for r in out.where("extension <> 'crc'").collect()}
    assert got == {"orders.parquet": ("success", 10, 2), "none.parquet": ("success", 0, 1), "e.json": ("success", 7, 1), "a[1].CSV": ("success", 2, 3),
                   "a1.CSV": ("success", 1, 1), "bad.parquet": ("error", None, None), "note.txt": ("success", None, None), "c.zip": ("unsupported", None, None)}
    assert out.where("processing_status = 'error'").first()["error_message"]


def test_the_format_router_counts_every_table(spark, tmp_path):
    for i, t in enumerate(ingest.LISTED):
        spark.range(i).select(*[F.col("id").alias(f"c{j}") for j in range(1 + i % 3)]).write.parquet(str(tmp_path / f"{t}.parquet"))
    out = load_all().QUERIES["src_format_router"](spark, str(tmp_path))
    assert rows(out, "rows") == [(f"{t}.parquet", "structured", "success", i, 1 + i % 3) for i, t in enumerate(ingest.LISTED)]


def _line_table(spark, tmp_path, n):
    lines = spark.range(n).select(F.concat(F.lit("é "), F.repeat(F.lit("word "), 200), "id").alias("text"))
    lines.write.parquet(str(tmp_path / "documents.parquet"))
    return lines.agg(F.sum(F.length("text") + 1)).first()[0]


def test_a_range_that_fails_is_no_total(spark, tmp_path, monkeypatch):
    characters, query = _line_table(spark, tmp_path, 1000), load_all().QUERIES["src_text_ranges"]
    assert rows(query(spark, str(tmp_path))) == [("utf-8", characters, 202 * 1000, 1000, 1, True)]

    def broken(key, start, data):
        if start:
            raise ValueError("no second range")
        return [("utf-8", len(data.decode()), 1, 1)]

    monkeypatch.setattr(ingest, "_utf8_counts", broken)
    with pytest.raises(Exception, match="no second range"):
        query(spark, str(tmp_path)).collect()


def test_a_file_that_is_not_utf8_in_one_range_is_latin1_as_a_whole(spark, tmp_path, monkeypatch):
    _line_table(spark, tmp_path, 1000)
    joined = files.write_joined

    def with_a_byte(df, path):
        joined(df, path)
        with open(f"{path}/joined.txt", "ab") as out:
            out.write(b"\xe9\n")

    monkeypatch.setattr(files, "write_joined", with_a_byte)
    size = sum(len(f"é {'word ' * 200}{i}\n".encode()) for i in range(1000)) + 2
    assert rows(load_all().QUERIES["src_text_ranges"](spark, str(tmp_path))) == [("latin-1", size, 202 * 1000 + 1, 1001, 1, True)]


def test_a_file_that_has_become_shorter_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\n" * 100)
    ranges = files.read_files(spark, str(tmp_path), files.text_counts, "e string, c long, w long, n long", range_bytes=100)
    real = files.plan_ranges([(str(tmp_path / "a.txt"), 700)], 100, False)
    reader = files._Reader(str(tmp_path), (), 100, False, files.text_counts, 4)
    status = [row[3] for task in real for row in reader.read(task)]
    assert status == ["success"] * 5 + ["error"] * 2 and files.all_read(ranges).count() == 5
