"""CRM exports: rows of too many fields, date notations and strictness, with ANSI on and off."""

import datetime as dt

import pytest

from clickflow.operators import reconcile


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def export(tmp_path, text):
    path = tmp_path / "export.csv"
    path.write_text(text)
    return str(path)


SHIFTED = 'Date,Note,Orders,Revenue\n2024-01-01,"a, ""b""\nc",1,2.5\n2024-01-02,x,1,234,50\n2024-01-03,y,7\n'


def test_rows_with_too_many_fields(spark, ansi, tmp_path):
    path = export(tmp_path, SHIFTED)
    for use in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("crm_transactions").collect()):
        with pytest.raises(Exception, match="more than the header's 4 fields: 2024-01-02,x,1,234,50"):
            use(reconcile.load_crm(spark, path))
    kept = reconcile.load_crm(spark, path, malformed="skip").collect()
    assert [tuple(r) for r in kept] == [(dt.date(2024, 1, 1), 1.0, 2.5), (dt.date(2024, 1, 3), 7.0, None)]
    report = reconcile.malformed_rows(spark, path)
    assert [(r["record"], r["fields"]) for r in report.collect()] == [("2024-01-02,x,1,234,50", 5)] and report.count() == 1
    with pytest.raises(ValueError):
        reconcile.load_crm(spark, path, malformed="drop")


def test_quoted_commas_and_names_are_no_extra_fields(spark, tmp_path):
    path = export(tmp_path, 'Date,"Net, total",__record,Orders\n2024-01-01,"1,5","a,b,c",4\n')
    assert reconcile.load_crm(spark, path).collect() == [(dt.date(2024, 1, 1), 4.0)]
    assert reconcile.malformed_rows(spark, path).count() == 0


@pytest.mark.parametrize("cells,want", [
    (["15.01.2024", "1.2.2024 10:30"], [(2024, 1, 15), (2024, 2, 1)]),
    (["03/04/2024", "24/05/2024"], [(2024, 4, 3), (2024, 5, 24)]),
    (["03/04/2024", "05/24/2024"], [(2024, 3, 4), (2024, 5, 24)]),
    (["03/04/2024", "04/05/2024"], [(2024, 3, 4), (2024, 4, 5)]),  # undecided: the month first
    (["2024/1/5", "2024/12/31"], [(2024, 1, 5), (2024, 12, 31)]),
    (["20240229", "20231231"], [(2024, 2, 29), (2023, 12, 31)]),
    (["2024-01-05T10:00:00Z", "2024-01-06 23:59:59.5"], [(2024, 1, 5), (2024, 1, 6)]),
    (["31-12-2024"], [(2024, 12, 31)]),
])
def test_one_notation_for_the_whole_column(spark, ansi, tmp_path, cells, want):
    path = export(tmp_path, "date,orders\n" + "".join(f"{c},1\n" for c in [*cells, ""]))
    got = reconcile.load_crm(spark, path).collect()
    assert [r["date"] for r in got] == [dt.date(*w) for w in want] + [None]


def test_columns_without_one_notation(spark, ansi, tmp_path):
    with pytest.raises(ValueError, match="yyyy-MM-dd reads 2 of 3"):
        reconcile.load_crm(spark, export(tmp_path, "date,orders\n2024-01-01,1\nnonsense,2\n2024-01-03,3\n"))
    with pytest.raises(ValueError, match="no dates"):
        reconcile.load_crm(spark, export(tmp_path, "date,orders\nnonsense,2\n"))
    assert reconcile.load_crm(spark, export(tmp_path, "date,orders\n")).count() == 0


def test_a_named_format_is_strict(spark, ansi, tmp_path):
    bad = export(tmp_path, "date,orders\n2024-01-31,1\n2024-02-30,2\n")
    with pytest.raises(Exception, match="not a date in column 'date': 2024-02-30"):
        reconcile.load_crm(spark, bad, "yyyy-MM-dd").collect()
    named = export(tmp_path, "date,orders\n3 Jan 2024,1\n")
    assert reconcile.load_crm(spark, named, "d MMM yyyy").first()["date"] == dt.date(2024, 1, 3)
    with pytest.raises(Exception, match="not a date in column 'date': x"):
        reconcile.load_crm(spark, export(tmp_path, "date,orders\nx,1\n"), "d MMM yyyy").collect()


def test_votes(spark):
    df = spark.createDataFrame([("01.02.2024",), ("1.2.2024",), (" ",), (None,), ("2024-01-01",)], "d string")
    votes = reconcile.date_votes(df, "d").first().asDict()
    assert votes["cells"] == 3 and votes["dd.MM.yyyy"] == 2 and votes["yyyy-MM-dd"] == 1 and votes["yyyyMMdd"] == 0
