"""Concepts of a ticker are counted after its pairs are dealt: no table of them all in the task that makes them."""
from equispan.operators import entities as en, quality as q

ROWS = [("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", "x", 1), ("c", None, 1), (None, "x", 1), (None, "z", 1)]


def _fin(spark):
    return spark.createDataFrame(ROWS, "ticker string, concept string, fiscal_year int")


def _below_first_shuffle(df):
    """The steps that run before any shuffle of the longest branch of the plan."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    return "\n".join(lines[max(i for i, x in enumerate(lines) if "Exchange" in x or "Repartition" in x) + 1:]) if any(
        "Exchange" in x or "Repartition" in x for x in lines) else "\n".join(lines)


def test_counts(spark):
    got = {r.ticker: r.n for r in q.concepts_known(_fin(spark)).collect()}
    assert got == {"a": 2, "b": 1, "c": 0, None: 2}


def test_no_table_of_pairs_before_the_shuffle(spark):
    fin = _fin(spark)
    names = fin.select("ticker").distinct()
    gate = q.coverage_gate(names, fin, core=2)
    assert (gate.first().names, gate.first().covered) == (4, 1)
    left = en.to_ingest(names, fin, min_concepts=2)
    assert sorted(str(r.ticker) for r in left.collect()) == ["None", "b", "c"]
    for df in (gate, left):
        assert "concept" in _below_first_shuffle(df) and "HashAggregate" not in _below_first_shuffle(df)
