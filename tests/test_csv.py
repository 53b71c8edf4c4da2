import pytest

from tabgraph import errors
from tabgraph.sources.csv import fits, parse_rows, read_csv, read_string, sniff


def test_sniffing():
    g = sniff("foo,bar,baz,quux\nabc,1,-2,NaN\nxyz,3.14159, 20 ,100\npartialfinalrow,")
    assert g.has_header and g.names == ("foo", "bar", "baz", "quux") and g.types == ("string", "double", "bigint", "double")
    g = sniff("a\tb\tc\nPi\t3.14159\t-100\ne\t2.71828\t200\n")
    assert g.separator == "\t" and g.types == ("string", "double", "bigint")
    assert not sniff("a,b\nc,d\ne,f").has_header
    assert sniff("foo,bar,baz\n1,2,3,4,5\n1,2,3,4,5\n1,2,3,4,5").names[3:] == ("col_3", "col_4")
    assert sniff("x,y\n1,\n2,\n").types == ("bigint", "bigint")
    with pytest.raises(errors.CSVTooShort):
        sniff("one line")


@pytest.mark.parametrize("cell,kinds", [("1", "bigint boolean double string"), ("1e5", "string"), ("-2.", "double string"), (" 20 ", "bigint double string"), ("TRUE", "boolean string"), ("NaN", "double string"), ("-Inf", "double string"), ("+1", "string"), (".5", "string"), ("", "bigint boolean double string")])
def test_types_that_fit(cell, kinds):
    assert [k for k in ("bigint", "boolean", "double", "string") if fits(cell, k)] == kinds.split()


def test_files(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('a,b,c,d\n"as,df",1,f,3.1\n"two\nlines",12abc,t,\n"",,true,x\nshort,4\nlong,5,f,1.5,extra\n')
    from tabgraph.sources.csv import Guess

    g = Guess(",", True, ("a", "b", "c", "d"), ("string", "bigint", "boolean", "double"))
    assert [tuple(r) for r in read_csv(spark, str(f), g).df.collect()] == [("as,df", 1, False, 3.1), ("two\nlines", 12, True, None), ("", None, True, None), ("short", 4, None, None), ("long", 5, False, 1.5)]
    f.write_text("a,b,c,d\nasdf,1,f,3.1\nfdsa,4,t,6.2\n")
    t = read_csv(spark, str(f))
    assert t.df.dtypes == [("a", "string"), ("b", "bigint"), ("c", "boolean"), ("d", "double")] and t.count() == 2
    lines = spark.createDataFrame([("x,7,t,inf",)], "value string")
    assert tuple(parse_rows(spark, lines, g).first()) == ("x", 7, True, float("inf"))


def test_a_string_reads_like_a_file(spark, tmp_path):
    text = 'name|n|ok\n"as|df"|1|f\n"two\nlines"|12abc|t\r\n""||true\nshort|4\n"a \\"quoted\\" one"|5|f|extra\n|7|t\n"Ж日本🙂"|8|f\n'
    t = read_string(spark, text)
    want = [("as|df", 1, False), ("two\nlines", 12, True), ("", None, True), ("short", 4, None), ('a "quoted" one', 5, False), (None, 7, True), ("Ж日本🙂", 8, False)]
    assert t.names == ["name", "n", "ok", "col_3"]  # sniffing looks at no quotes
    from tabgraph.sources.csv import Guess

    g = Guess("|", True, ("name", "n", "ok"), ("string", "bigint", "boolean"))
    assert [tuple(r) for r in read_string(spark, text, g).ordered().collect()] == want
    (tmp_path / "x.csv").write_text(text)
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), g).df.collect()] == want
    plain = "a,b\n" + "".join(f"{i},x\n" for i in range(100))
    (tmp_path / "y.csv").write_text(plain)
    assert read_csv(spark, str(tmp_path / "y.csv"), multi_line=False).count() == 100 == read_string(spark, plain).count()
    with pytest.raises(errors.DuplicateColumn):
        read_string(spark, "a,a\n1,2\n")
    with pytest.raises(errors.DuplicateColumn):
        (tmp_path / "z.csv").write_text("a,a\n1,2\n")
        read_csv(spark, str(tmp_path / "z.csv"))
