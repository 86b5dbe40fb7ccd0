"""Data-quality checks (Q1-Q7)."""
from pyspark.sql import DataFrame, functions as F


def concepts_known(fin: DataFrame) -> DataFrame:
    """(ticker, n): how many concepts each ticker has.  The pairs are dealt before they are told apart: few of them recur
    within the task that makes them, so a table of them kept there would only take memory."""
    return fin.select("ticker", "concept").repartition("ticker", "concept").groupBy("ticker").agg(F.countDistinct("concept").alias("n"))


def concept_coverage(fin: DataFrame) -> DataFrame:
    return fin.groupBy("concept").agg(F.countDistinct("ticker").alias("tickers"))


def coverage_regression(fin: DataFrame, history: DataFrame, warn_drop=0.05) -> DataFrame:
    """Q1: concepts whose ticker count fell by more than the limit since the newest earlier run."""
    last = history.select(F.max("run_date").alias("run_date"))
    prev = history.join(F.broadcast(last), "run_date").select("concept", F.col("tickers").alias("before"))
    return (prev.join(concept_coverage(fin), "concept", "left").fillna(0, ["tickers"])
            .where(F.col("tickers") < F.col("before") * (1 - warn_drop))
            .select("concept", "before", F.col("tickers").alias("now")))


def ghosts(companies: DataFrame, fin: DataFrame, min_facts=3) -> DataFrame:
    """Q2: companies with hardly any facts."""
    n = fin.groupBy("ticker").agg(F.count("concept").alias("facts"))
    return (companies.select("ticker", "cik").join(n, "ticker", "left").fillna(0, ["facts"])
            .where(F.col("facts") < min_facts))


def mcap_xcheck(companies: DataFrame, external: DataFrame) -> DataFrame:
    """Q3: our market cap against a second source; beyond 15% the share count is replaced."""
    rows = companies.where("price IS NOT NULL").join(external, "ticker", "left")
    rows = rows.withColumn("diff", F.expr(
        "if(ext_mcap <> 0 AND shares_out <> 0, price * shares_out / ext_mcap - 1, NULL)"))
    rows = rows.withColumn("status", F.expr(
        "CASE WHEN ext_mcap IS NULL OR ext_mcap = 0 THEN 'no_ext' "
        "WHEN shares_out IS NULL OR shares_out = 0 THEN if(price <> 0, 'derived', NULL) "
        "WHEN abs(diff) <= 0.05 THEN 'ok' WHEN abs(diff) <= 0.15 THEN 'drift' ELSE 'patched' END"))
    return rows.withColumn("shares_checked", F.expr(
        "if(status IN ('derived', 'patched'), coalesce(try_divide(ext_mcap, price), shares_out), shares_out)"))


def tag_rank(picked: DataFrame) -> DataFrame:
    """Q4: the best tag that supplies a concept's latest fiscal year; anything above 0 is a fallback."""
    rows = picked.where("(form LIKE '10-K%' OR form LIKE '20-F%' OR form LIKE '40-F%') AND fp = 'FY' "
                        "AND (start IS NULL OR datediff(end, start) BETWEEN 350 AND 380)")
    per = rows.groupBy("cik", "ns", "concept", F.year("end").alias("fy")).agg(F.min("tag_rank").alias("tag_rank"))
    return (per.groupBy("cik", "ns", "concept").agg(F.max_by("tag_rank", "fy").alias("tag_rank"))
            .withColumn("fallback", F.expr("tag_rank >= 1")))


def coverage_gate(names: DataFrame, fin: DataFrame, core=15, bar=0.9) -> DataFrame:
    """Q5, run level: share of names with enough concepts, and whether it passes."""
    n = concepts_known(fin)
    return names.select("ticker").join(n, "ticker", "left").agg(
        F.count(F.lit(1)).alias("names"), F.expr(f"count_if(n >= {core})").alias("covered")).select(
        "names", "covered", F.expr("round(100 * try_divide(covered, names), 1)").alias("coverage_pct"),
        F.expr(f"coalesce(try_divide(covered, names) >= {bar}, false)").alias("gate_pass"))


def concept_gate(names: DataFrame, fin: DataFrame, ranks: DataFrame, min_have=0, top=None) -> DataFrame:
    """Q5, concept level: how many names have it, and on a fallback tag; optionally the worst few."""
    total = names.select(F.count(F.lit(1)).alias("names"))
    fb = ranks.where("fallback").groupBy("concept").agg(F.countDistinct("ticker").alias("fallback"))
    out = (concept_coverage(fin).withColumnRenamed("tickers", "have").join(fb, "concept", "left")
           .fillna(0, ["fallback"]).join(F.broadcast(total)).where(F.col("have") >= min_have)
           .select("concept", "have", "fallback", F.expr("round(100 * have / names, 1)").alias("have_pct"),
                   F.expr("round(100 * fallback / have, 1)").alias("fallback_pct")))
    return out if top is None else out.orderBy(F.desc("fallback_pct"), "concept").limit(top)


def churn(new: DataFrame, old: DataFrame, least=8) -> DataFrame:
    """Q6: names on one list only, against max(least, a tenth of the old list)."""
    both = (new.select("ticker").distinct().withColumn("n", F.lit(1))
            .join(old.select("ticker").distinct().withColumn("o", F.lit(1)), "ticker", "full"))
    return both.agg(F.expr("count_if(n IS NULL OR o IS NULL)").alias("changed"), F.count("o").alias("before")) \
        .withColumn("suspicious", F.expr(f"changed > greatest({least}, before DIV 10)"))


def shrink_guard(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Q7: members or changes below 90% of the previous run; both inputs are one row per universe."""
    return cur.alias("c").join(prev.alias("p"), "universe").select(
        "universe", F.expr("c.members < p.members * 0.9D OR c.changes < p.changes * 0.9D").alias("shrank"))


