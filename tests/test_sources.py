import io
import json
import os
import zipfile
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera import sources
from tessera.sources.delimited import survey
from tessera.sources.excel import NS, _xlsx_bytes
from tessera.sources.jsonfile import ColumnStream

TABLE = [("id", "name", "score"), ("1", "Ana", "1.5"), ("2", "Bo", ""), ("3", "Cé", "NA")]


def _write(path, text, enc="utf-8"):
    with open(path, "wb") as fh:
        fh.write(text.encode(enc))
    return path


@pytest.mark.parametrize("sep", [",", ";", "|"])
def test_separator_detection(spark, tmpdir_path, sep):
    p = _write(os.path.join(tmpdir_path, "t.csv"), "\n".join(sep.join(r) for r in TABLE) + "\n")
    df = sources.read_table(spark, p)
    assert df.columns == ["id", "name", "score"]
    rows = sorted(df.collect())
    assert rows[0].id == 1 and rows[0].score == 1.5 and rows[1].score is None and rows[2].score is None


def test_latin1_and_tsv(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "l.csv"), "\n".join(";".join(r) for r in TABLE) + "\n", "latin-1")
    assert {r.name for r in sources.read_table(spark, p).collect()} == {"Ana", "Bo", "Cé"}
    t = _write(os.path.join(tmpdir_path, "t.tsv"), "a\tb\n1,5\tx\n")
    assert sources.read_table(spark, t).first().a == "1,5"


def test_header_odd_and_one_column(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "h.csv"), "a,a,,d\n1,NA,null,\n2,3,x,y\n")
    df = sources.read_table(spark, p)
    assert df.columns == ["a", "a_1", "Unnamed: 2", "d"]
    first = sorted(df.collect())[0]
    assert first.a_1 is None and first["Unnamed: 2"] is None and first.d is None
    one = _write(os.path.join(tmpdir_path, "o.csv"), "x\n1\n2\n")
    assert sources.read_table(spark, one).columns == ["x"]


def _csv(tmp, name, text):
    os.makedirs(os.path.dirname(os.path.join(tmp, name)), exist_ok=True)
    return _write(os.path.join(tmp, name), text)


def test_csv_quotes_and_line_ends(spark, tmpdir_path):
    p = _csv(tmpdir_path, "q/1.csv", 'a,"b ""x"" c",d\n1,"say ""hi"" x",2\n\n2,"two\nlines, ""quoted""",3\n3,"",\n4,5" pipe,6\n')
    df = sources.read_table(spark, p)
    assert df.columns == ["a", 'b "x" c', "d"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 'say "hi" x', 2), (2, 'two\nlines, "quoted"', 3), (3, None, None), (4, '5" pipe', 6)]
    head = _csv(tmpdir_path, "q/2.csv", 'a,"two\nlines"\n1,2\n')
    assert sources.read_table(spark, head).columns == ["a", "two\nlines"]


def test_csv_only_files_with_open_quotes_are_read_whole(spark, tmpdir_path):
    _csv(tmpdir_path, "w/1.csv", 'a,b\n1,"x ""y"", z"\n2,\n')
    _csv(tmpdir_path, "w/2.csv", 'a,b\n1,"x\ny"\n')
    got = survey(spark, os.path.join(tmpdir_path, "w"), ",")
    assert [(r.header, r.latin, r.streamed) for r in got] == [("a,b", False, False), ("a,b", False, True)]


@pytest.mark.parametrize("row", ["1,2,3,4", "1,2,3,", "1,2,3,4,5", '1,"2\n",3,4'])
@pytest.mark.parametrize("infer", [True, False])
def test_csv_too_many_values_are_an_error(spark, tmpdir_path, row, infer):
    p = _csv(tmpdir_path, "t/1.csv", f"a,b,c\n7,8,9\n{row}\n")
    with pytest.raises(ValueError, match="more values"):
        sources.read_delimited(spark, p, infer=infer)


def test_csv_files_are_united_by_name(spark, tmpdir_path):
    for k, text in enumerate(["a,b\n1,2\n", "b,a\n3,4\n", "b,c.d\n5,é\n", "\n\n", ""]):
        _csv(tmpdir_path, f"h/{k} x.csv", text)
    _write(os.path.join(tmpdir_path, "h", "9.csv"), "a,b\nñ,6\n", "latin-1")
    df = sources.read_delimited(spark, os.path.join(tmpdir_path, "h"))
    assert df.columns == ["a", "b", "c.d"]
    assert sorted((r.b, r.a, r["c.d"]) for r in df.collect()) == [(2, "1", None), (3, "4", None), (5, None, "é"), (6, "ñ", None)]
    with pytest.raises(ValueError):
        sources.read_delimited(spark, os.path.join(tmpdir_path, "h", "3 x.csv"), sep=",")


def test_csv_types_follow_how_numbers_are_written(spark, tmpdir_path):
    p = _csv(tmpdir_path, "n/1.csv", "a,b,c,d,e,f,A\n12D,1, 7,1e3,True,99999999999999999999,x\n7F,-2,8 ,.5,false,1,y\n")
    df = sources.read_table(spark, p)
    assert dict(df.dtypes) == {"a": "string", "b": "bigint", "c": "bigint", "d": "double", "e": "boolean", "f": "double", "A_1": "string"}
    assert {(r.a, r.c, r.d, r.e) for r in df.collect()} == {("12D", 7, 1000.0, True), ("7F", 8, 0.5, False)}


def test_csv_text_of_documents_round_trip(spark):
    from tessera.plans.catalog import QUERIES
    from tessera.plans.fixtures import load

    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.text) for r in QUERIES["load_csv_text"](spark, sf).select("doc_id", "text").collect()}
    assert got == {(r.doc_id, r.text or None) for r in load(spark, sf, "documents").select("doc_id", "text").collect()}


def test_json_layouts(spark, tmpdir_path):
    recs = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    p1 = _write(os.path.join(tmpdir_path, "r.json"), json.dumps(recs))
    assert sorted(r.a for r in sources.read_table(spark, p1).collect()) == [1, 2]
    cols = {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}
    p2 = _write(os.path.join(tmpdir_path, "c.json"), json.dumps(cols))
    df = sources.read_table(spark, p2)
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [(1, "x"), (2, "y")]
    bad = _write(os.path.join(tmpdir_path, "bad.json"), "{not json")
    with pytest.raises(ValueError):
        sources.read_table(spark, bad).collect()


def test_json_columns_of_several_files(spark, tmpdir_path):
    for k, doc in enumerate([{"a": {"0": 1, "1": 2}, "t.x": {"0": "x, {y}", "1": None}}, {"t.x": {"0": 'q" \\ ,', "1": "[1, 2]"}, "a": {"0": 3, "1": 4}, "file": {"0": [1, {"z": 2}]}}]):
        _csv(tmpdir_path, f"j/{k}.json", json.dumps(doc, indent=k or None))
    df = sources.read_json(spark, os.path.join(tmpdir_path, "j"))
    assert df.columns == ["a", "t.x", "file"] and dict(df.dtypes)["a"] == "bigint"
    got = [tuple(r) for r in df.collect()]
    assert [r[:2] for r in got] == [(1, "x, {y}"), (2, None), (3, 'q" \\ ,'), (4, "[1, 2]")]
    assert json.loads(got[2][2]) == [1, {"z": 2}] and got[3][2] is None


def test_json_lines_with_nested_first_field(spark, tmpdir_path):
    p = _csv(tmpdir_path, "l/n.json", '{"a": {"x": 1}}\n{"a": {"x": 2}}\n')
    assert sorted(r.a.x for r in sources.read_table(spark, p).collect()) == [1, 2]
    q = _csv(tmpdir_path, "l/m.json", '{"a": {"x": 1}, "b": 5}\n')
    assert sources.read_table(spark, q).first().b == 5


@pytest.mark.parametrize("text", ['{"a": {"0": 1}', '{"a": {"0": 1}} x', '{"a": {"0": }}', '{"a" {"0": 1}}', "{}}"])
def test_column_stream_refuses_broken_documents(text):
    with pytest.raises(ValueError):
        s = ColumnStream()
        list(s.feed(text, last=True))


@given(st.dictionaries(st.text(max_size=5), st.dictionaries(st.text(max_size=4), st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=40)), max_size=4), max_size=4), st.integers(1, 9))
def test_column_stream_in_any_pieces(doc, size):
    text, s, got = json.dumps(doc, ensure_ascii=False), ColumnStream(), []
    for k in range(0, len(text), size):
        got += s.feed(text[k : k + size])
    got += s.feed("", last=True)
    assert got == [(n, c, r, None if v is None else str(v)) for n, (c, rows) in enumerate(doc.items()) for r, v in rows.items()]


def test_json_columns_do_not_pass_through_the_driver(spark, tmpdir_path):
    """Blocks of 64 KB: a file's pieces come from many tasks, and are put in order again."""
    n = 30_000
    p = _csv(tmpdir_path, "b/big.json", json.dumps({"k": {str(i): i for i in range(n)}, "v": {str(i): f"value, {i}" for i in range(n)}}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = sources.read_json(spark, p)
        r = df.selectExpr("count(*) AS n", "sum(k) AS s", "count_if(v = concat('value, ', k)) AS same").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (r.n, r.s, r.same) == (n, n * (n - 1) // 2, n)


def test_excel_folder_and_unsupported(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "books.xlsx")
    os.makedirs(d)
    for i in range(3):
        with open(os.path.join(d, f"b{i}.xlsx"), "wb") as fh:
            fh.write(_xlsx_bytes(["k", "v"], [[i, f"s{i}"], [i + 10, None]]))
    df = sources.read_table(spark, d)
    assert sorted(r.k for r in df.collect()) == [0, 1, 2, 10, 11, 12]
    with pytest.raises(ValueError):
        sources.read_table(spark, os.path.join(tmpdir_path, "table.txt"))


def _dated(header, rows, styles):
    """A workbook whose cells may be (serial, style number)."""
    plain = _xlsx_bytes(header, [[v[0] if isinstance(v, tuple) else v for v in r] for r in rows])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as z, zipfile.ZipFile(out, "w") as new:
        for name in z.namelist():
            text = z.read(name).decode()
            if name.endswith("sheet1.xml"):
                for ri, r in enumerate(rows, start=2):
                    for ci, v in enumerate(r):
                        if isinstance(v, tuple):
                            text = text.replace(f'r="{chr(65 + ci)}{ri}"', f'r="{chr(65 + ci)}{ri}" s="{v[1]}"')
            new.writestr(name, text)
        new.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS["m"]}">{styles}</styleSheet>')
    return out.getvalue()


def test_excel_dates_and_columns_by_name(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "dated.xlsx")
    os.makedirs(d)
    styles = ('<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts>'
              '<cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>')
    books = [(["k", "when", "n"], [[1, (45292, 1), (1.5, 3)], [2, (45292.5, 2), (2, 3)], [3, None, None]]), (["n", "k", "mixed.x"], [[7, 4, (45292, 1)], [8, 5, "text"]])]
    for i, (header, rows) in enumerate(books):
        with open(os.path.join(d, f"b{i}.xlsx"), "wb") as fh:
            fh.write(_dated(header, rows, styles))
    df = sources.read_table(spark, d)
    assert df.dtypes == [("k", "bigint"), ("when", "timestamp_ntz"), ("n", "double"), ("mixed.x", "string")]
    got = {r.k: tuple(r)[1:] for r in df.collect()}
    assert got == {1: (datetime(2024, 1, 1), 1.5, None), 2: (datetime(2024, 1, 1, 12), 2.0, None), 3: (None, None, None), 4: (None, 7.0, "2024-01-01 00:00:00"), 5: (None, 8.0, "text")}
    bad = _write(os.path.join(tmpdir_path, "bad.xlsx"), "no zip")
    with pytest.raises(ValueError):
        sources.read_table(spark, bad)


def test_metadata(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "a long, s string")
    r = sources.table_metadata(df).first()
    assert (r.n_rows, r.n_cols, r.columns) == (2, 2, "a,s") and r.memory_mb == round(18 / 1048576, 3)
