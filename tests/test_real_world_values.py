"""Values that clean test data lacks: small amounts, odd URLs, untidy CRM files, conflicting lookups."""

import pytest
from pyspark.sql import functions as F

from clickflow.functions.exprs import money_sum
from clickflow.operators import enrich, funnel, reconcile


def test_small_amounts_keep_their_digits(spark):
    rows = spark.range(1000).select(F.lit(0.004).alias("value"))
    assert rows.agg(money_sum("value")).first()[0] == 4.0


@pytest.mark.parametrize("url,host,path,source,query", [
    ("https://a.example.com/x?utm_source=news", "a.example.com", "/x", "news", None),
    ("https://a.example.com/x y?utm_source=a|b&search_query=Caf%C3%89+rzym#top", "a.example.com", "/x y", "a|b", "café rzym"),
    ("https://user@a.example.com:8080?utm_source=", "a.example.com", "", "", None),
    ("no url", None, None, None, None),
    (None, None, None, None, None),
])
def test_url_parts(spark, url, host, path, source, query):
    df = spark.createDataFrame([(url,)], "page_location string")
    row = enrich.url_enrichment(df).first()
    assert (row.page.hostname, row.page.path, row.url_params.utm_source) == (host, path, source)
    assert row.url_params_custom.search_query == query


def test_crm_cells_and_quoting(spark, tmp_path):
    path = tmp_path / "crm.csv"
    path.write_text('note,date,transactions,revenue\n'
                    '"said ""hi"", then\nleft",2024-01-01,3,1.5e2\n'
                    'x,2024-01-02,NaN,1d\ny,2024-01-03,n/a, -7.25 \n', encoding="utf-8")
    rows = sorted(reconcile.load_crm(spark, f"file://{path}").collect())
    assert [(str(r.date), r.crm_transactions, r.crm_revenue) for r in rows] == [
        ("2024-01-01", 3.0, 150.0), ("2024-01-02", None, None), ("2024-01-03", None, -7.25)]


def test_conflicting_sites_are_an_error(spark):
    events = spark.createDataFrame([(1, "e"), (2, "e"), (3, "e")], "stream_id long, event_name string")
    good = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "stream_id long, site string")
    assert sorted(((r.stream_id, r.site) for r in funnel.with_site(events, good).collect()), key=str) == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(ValueError, match="several sites"):
        funnel.with_site(events, good.union(spark.createDataFrame([(2, "c")], good.schema)))
