"""Facts are shuffled as company-years, and counts of reasons stage no metrics or histories."""
import datetime as dt

from test_group_joins import settings
from test_narrow_histories import formatted, nodes

from equispan.functions import staging
from equispan.operators import metrics as m
from equispan.plans import queries_metrics as qm


def test_only_company_years_are_shuffled(spark):
    rows = [("a", 2000, "revenue", 5.0), ("a", 2000, "ebit", 2.0), ("a", 2000, "revenue", 7.0), ("a", 1999, "capex", 1.0),
            ("b", 2001, "no such concept", 4.0), (None, 2000, "cash", 3.0), ("b", None, "cash", 6.0)]
    fin = spark.createDataFrame(rows * 2, "ticker string, fiscal_year int, concept string, value double")
    with settings(spark, **{"spark.sql.adaptive.enabled": "false"}):
        moved = nodes(formatted(m.company_series(staging.stage(fin))), "Exchange")
    assert moved and not [x for x in moved if "concept#" in x]
    got = {r.ticker: [(x.fy, x.revenue, x.ebit, x.capex, x.cash) for x in r.series] for r in m.company_series(fin).collect()}
    assert got == {"a": [(1999, None, None, 1.0, None), (2000, 7.0, 2.0, None, None)],
                   "b": [(None, None, None, None, 6.0), (2001, None, None, None, None)], None: [(2000, None, None, None, 3.0)]}


def test_counting_reasons_stages_no_metrics(spark, tmp_path, monkeypatch):
    day = [dt.date(1995 + k % 4, 3, 1) for k in range(12)]
    for name, rows, schema in (
            ("customer", [(k, f"Customer {k}", "MACHINERY", -1.0 if k == 2 else 10.0, 3) for k in range(1, 7)],
             "c_custkey long, c_name string, c_mktsegment string, c_acctbal double, c_nationkey int"),
            ("orders", [(k, 1 + k % 4, day[k]) for k in range(12)], "o_orderkey long, o_custkey long, o_orderdate date"),
            ("lineitem", [(k, 1e9 + k, 0.05, 0.02, "O", "N") for k in range(12)],
             "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_returnflag string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    expected = {r.why: r["count"] for r in qm.inputs(spark, d).where("why IS NOT NULL").groupBy("why").count().collect()}
    staging.forget()
    staged, plain = [], staging.stage

    def noted(df):
        staged.append(set(df.columns))
        return plain(df)

    monkeypatch.setattr(staging, "stage", noted)
    monkeypatch.setattr(qm, "stage", noted)
    got = {r.why: r.n for r in qm.excluded_first_pass(spark, d).collect()}
    assert got == expected and sum(got.values()) >= 2
    assert staged and not [c for c in staged if c & {"series", "concept", "wacc"}]
