"""Loan applications derived from the orders and customer tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Integer arithmetic plus one division: the text runs unchanged, and gives the
# same bits, in every SQL engine.
LOAN_PROJECTION = """
  CONCAT('L', CAST(o.o_orderkey AS STRING)) AS LoanID,
  CAST(CASE WHEN o.o_orderkey % 97 = 0 THEN 10 WHEN o.o_orderkey % 101 = 0 THEN 150 WHEN o.o_orderkey % 89 = 0 THEN NULL
       ELSE 18 + (o.o_custkey * 7 + o.o_orderkey * 11) % 52 END AS DOUBLE) AS Age,
  CAST(CASE WHEN o.o_orderkey % 211 = 0 THEN -1000 WHEN o.o_orderkey % 83 = 0 THEN NULL
       ELSE 15000 + (o.o_custkey * 7919 + o.o_orderkey * 104729) % 135000 END AS DOUBLE) AS Income,
  CAST(CASE WHEN o.o_orderkey % 223 = 0 THEN 0 ELSE 5000 + (o.o_orderkey * 15485863) % 245000 END AS DOUBLE) AS LoanAmount,
  CAST(300 + (o.o_orderkey * 7907 + o.o_custkey * 31) % 550 AS DOUBLE) AS CreditScore,
  CAST((o.o_custkey * 13 + o.o_orderkey * 29) % 120 AS DOUBLE) AS MonthsEmployed,
  CAST(1 + (o.o_orderkey * 3 + o.o_custkey) % 4 AS DOUBLE) AS NumCreditLines,
  CASE WHEN o.o_orderkey % 131 = 0 THEN 0.0 ELSE CAST(200 + (o.o_orderkey * 6101) % 2300 AS DOUBLE) / 100 END AS InterestRate,
  CAST(12 * (1 + (o.o_orderkey * 17 + o.o_custkey) % 5) AS DOUBLE) AS LoanTerm,
  CAST(10 + (o.o_orderkey * 5407 + o.o_custkey * 3) % 81 AS DOUBLE) / 100 AS DTIRatio,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'High School' WHEN '2-HIGH' THEN 'Bachelor''s' WHEN '3-MEDIUM' THEN 'Master''s' WHEN '4-NOT SPECIFIED' THEN 'PhD' ELSE 'Bachelor''s' END AS Education,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Full-time' WHEN 'BUILDING' THEN 'Part-time' WHEN 'FURNITURE' THEN 'Self-employed' WHEN 'MACHINERY' THEN 'Unemployed'
       ELSE CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE 'Full-time' END END AS EmploymentType,
  CASE c.c_nationkey % 3 WHEN 0 THEN 'Divorced' WHEN 1 THEN 'Married' ELSE 'Single' END AS MaritalStatus,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS HasMortgage,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS HasDependents,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Business' WHEN 2 THEN 'Education' WHEN 3 THEN 'Home' ELSE 'Other' END AS LoanPurpose,
  CASE WHEN (o.o_orderkey + o.o_custkey) % 3 = 0 THEN 'Yes' ELSE 'No' END AS HasCoSigner,
  CASE WHEN (o.o_orderkey * 7907 + o.o_custkey * 31) % 550 > (o.o_orderkey * 6101) % 2300 - 1700 THEN
         CASE WHEN (o.o_orderkey * 31337 + o.o_custkey * 271) % 100 < 7 THEN 1 ELSE 0 END
       ELSE CASE WHEN (o.o_orderkey * 31337 + o.o_custkey * 271) % 100 < 40 THEN 1 ELSE 0 END END AS DefaultFlag,
  o.o_orderkey * 2 AS RowSeq
"""


def loans_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per order; every 50th comes again, later and changed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").alias("o")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").alias("c")
    joined = orders.join(customers, F.expr("o.o_custkey = c.c_custkey"))
    exprs = [e for e in _projection()]
    base = joined.selectExpr(*exprs)
    copies = F.when(F.col("RowSeq") % 100 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        base.withColumn("copy", F.explode(copies))
        .withColumn("Income", F.col("Income") + F.col("copy"))
        .withColumn("RowSeq", F.col("RowSeq") + F.col("copy"))
        .drop("copy")
    )


def _projection():
    """The projection's items: each ends in `AS name`, then a comma and newline."""
    items = [item.strip() for item in LOAN_PROJECTION.strip().split(",\n  ")]
    return [item.rstrip(",") for item in items]


def proxy_score(df: DataFrame, out="p") -> DataFrame:
    """A stand-in default probability with many ties, for evaluation work."""
    raw = F.round((850 - F.col("CreditScore")) * (F.col("InterestRate") * 100))
    return df.withColumn(out, raw / 1375000)
