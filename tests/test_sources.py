import zipfile

import pytest

from gazetrail import cli
from gazetrail.sources import tables, xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(path, rows, names=("Info", "DATA")):
    def cell(ref, v):
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'

    body = "".join(f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{i + 1}" Target="worksheets/s{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i in range(len(names)):
            z.writestr(f"xl/worksheets/s{i + 1}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body if names[i] == "DATA" else ""}</sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    path = f"{tmp_path}/a.xlsx"
    workbook(path, [["A ", "B", "C"], ["x", 1, "."], [None, 2.5, "é"], [None, None, None]])
    assert [n for n, _ in xlsx.sheets(path)] == ["Info", "DATA"]
    rows = tables.read(spark, path, sheet="DATA")
    assert rows.columns == ["A", "B", "C"] and [tuple(r) for r in rows.collect()] == [("x", "1", "."), (None, "2.5", "é")]
    assert tables.read(spark, path, sheet="1").count() == 2
    with pytest.raises(Exception, match="no sheet"):
        tables.read(spark, path, sheet="other").count()
    assert tables.ingest(spark, path, f"{tmp_path}/a.parquet")
    assert [r.C for r in spark.read.parquet(f"{tmp_path}/a.parquet").collect()] == [None, "é"]
    workbook(path, [["A"]])
    assert not tables.ingest(spark, path, f"{tmp_path}/a.parquet")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{tmp_path}/a.parquet")


@pytest.mark.parametrize("kind", ["parquet", "csv", "tsv"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", "b,\tc"), ("é", None)], "x string, y string")
    tables.write(df, f"{tmp_path}/deep/t.{kind}")
    assert {tuple(r) for r in tables.read(spark, f"{tmp_path}/deep/t.{kind}").collect()} == {("a", "b,\tc"), ("é", None)}


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        tables.read(spark, "x.JSON")
    with pytest.raises(ValueError):
        tables.write(spark.range(1), "x.xlsx")


def test_text_lines_and_headers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\n\n  \n c \n")
    assert [r.words for r in tables.text_lines(spark, f"{tmp_path}/t.txt").collect()] == [["a", "b"], ["c"]]
    with pytest.raises(ValueError):
        tables.clean_headers(spark.createDataFrame([(1, 2)], ["a", "a "]))


def test_command_line(spark, tmp_path, capsys):
    d = str(tmp_path)
    rows = [(p, s, str(i), w, "100", "120", "130", "140") for p in ("p1", "p2") for s, t in (("s1", "the cat sat"), ("s2", "a dog")) for i, w in enumerate(t.split())]
    names = ["participant_id", "sentence_id", "word_id", "word", "first_fixation_duration", "gaze_duration", "go_past_time", "total_reading_time"]
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{d}/raw.parquet")
    (tmp_path / "c.yaml").write_text("column_map: {" + ", ".join(f"{n}: {n}" for n in names) + "}\n")
    cli.main(["prepare-corpus", "--config", f"{d}/c.yaml", "--input", f"{d}/raw.parquet", "--output", f"{d}/std.parquet"])
    cli.main(["ngram", "--input", f"{d}/std.parquet", "--output", f"{d}/n.parquet", "--order", "2"])
    with pytest.raises(SystemExit, match="no scorer"):  # never made-up scores under a model's name
        cli.main(["surprisal-ar", "--input", f"{d}/std.parquet", "--output", f"{d}/ar.parquet"])
    cli.main(["surprisal-ar", "--input", f"{d}/std.parquet", "--output", f"{d}/ar.parquet", "--model", "stand-in"])
    cli.main(["surprisal-mlm", "--input", f"{d}/std.parquet", "--output", f"{d}/mlm.parquet", "--model", "stand-in", "--max-sentences", "1"])
    cli.main(["merge", "--base", f"{d}/std.parquet", "--feature", f"{d}/n.parquet", "--feature", f"{d}/ar.parquet", "--feature", f"{d}/mlm.parquet", "--output", f"{d}/all.parquet"])
    out = spark.read.parquet(f"{d}/all.parquet")
    assert out.count() == 10 and {"ngram2_surprisal", "stand_in_surprisal", "stand_in_pseudo_surprisal"} <= set(out.columns)
    assert out.filter("stand_in_pseudo_surprisal is null").count() == 4
    cli.main(["inspect", "--input", f"{d}/all.parquet", "--rows", "1"])
    assert "0 " in capsys.readouterr().out
