"""SQL text that states every result over the same parquet tables."""

from riskspark.operators.evaluation import THRESHOLDS
from riskspark.schema import (
    BINARY_COLS, CATEGORICAL_COLS, EDUCATION_LEVELS, FEATURE_COLS, NOMINAL_COLS, NOMINAL_VALUES, NUMERIC_COLS, TARGET,
)
from riskspark.sources.fixture import LOAN_PROJECTION

# --- Building blocks: each is one or more common table expressions ---------

RAW = f"""
b AS (SELECT {LOAN_PROJECTION} FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
loans_raw AS (SELECT * FROM b UNION ALL
  SELECT * REPLACE (Income + 1 AS Income, RowSeq + 1 AS RowSeq) FROM b WHERE RowSeq % 100 = 0)"""

UNIQ = RAW + """,
uniq AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY LoanID ORDER BY RowSeq) rn FROM loans_raw) WHERE rn = 1)"""

VALID = UNIQ + """,
aged AS (SELECT * REPLACE (CASE WHEN Age BETWEEN 18 AND 100 THEN Age END AS Age) FROM uniq),
inc AS (SELECT * FROM aged WHERE Income >= 0 OR (Income IS NULL AND NOT EXISTS (SELECT 1 FROM aged WHERE Income < 0))),
valid AS (SELECT * FROM inc WHERE LoanAmount > 0
  OR (LoanAmount IS NULL AND NOT EXISTS (SELECT 1 FROM inc WHERE LoanAmount <= 0)))"""


def _mode(c):
    return f"(SELECT {c} FROM valid WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


CLEAN = VALID + """,
cleaned AS (SELECT * REPLACE (""" + ", ".join(
    [f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM valid)) AS {c}" for c in NUMERIC_COLS]
    + [f"coalesce({c}, {_mode(c)}) AS {c}" for c in CATEGORICAL_COLS]
) + ") FROM valid)"

NORM = CLEAN + f""",
customers AS (SELECT DISTINCT concat('CUST_', LoanID) AS CustomerID, Age, Income, Education, EmploymentType,
  MaritalStatus, HasMortgage, HasDependents FROM cleaned),
loan_applications AS (SELECT LoanID, concat('CUST_', LoanID) AS CustomerID, LoanAmount, LoanPurpose, LoanTerm,
  InterestRate, HasCoSigner, {TARGET} FROM cleaned),
loan_details AS (SELECT LoanID, CreditScore, MonthsEmployed, NumCreditLines, DTIRatio FROM cleaned)"""

EMI = """CASE WHEN InterestRate / 100.0 / 12.0 > 0 THEN
  LoanAmount * (InterestRate / 100.0 / 12.0) * pow(1 + InterestRate / 100.0 / 12.0, LoanTerm)
  / (pow(1 + InterestRate / 100.0 / 12.0, LoanTerm) - 1) ELSE LoanAmount / nullif(LoanTerm, 0) END"""

FEATURES = CLEAN + f""",
fe AS (SELECT *, emi / (Income / 12.0) AS emi_ratio, emi * LoanTerm - LoanAmount AS interest FROM (
  SELECT *, LoanAmount / nullif(Income, 0) AS lti, Income / 12.0 AS monthly, {EMI} AS emi,
    MonthsEmployed / greatest((Age - 18) * 12, 1) AS emp_ratio,
    CASE WHEN CreditScore <= 0 THEN NULL WHEN CreditScore <= 580 THEN 0 WHEN CreditScore <= 670 THEN 1
         WHEN CreditScore <= 740 THEN 2 WHEN CreditScore <= 800 THEN 3 WHEN CreditScore <= 1000 THEN 4 END AS band,
    DTIRatio * InterestRate / nullif(CreditScore / 100.0, 0) AS cri,
    CASE WHEN DTIRatio > 0.6 AND CreditScore < 600 THEN 1 ELSE 0 END AS high_risk FROM cleaned))"""

SCORED = CLEAN + f""",
scored AS (SELECT LoanID, {TARGET} AS label, round((850 - CreditScore) * (InterestRate * 100)) / 1375000 AS p FROM cleaned),
marked AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scored),
sc AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY p),
cum AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
  sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM sc),
cm AS (SELECT count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM marked)"""

SWEEP = SCORED + """,
ts AS (SELECT unnest(range(1, 100)) AS step, unnest([""" + ", ".join(f"{t!r}::DOUBLE" for t in THRESHOLDS) + """]) AS threshold),
tot AS (SELECT sum(label) AS np, sum(1 - label) AS nn FROM scored),
hits AS (SELECT step, threshold, coalesce(sum(pos), 0) AS tp, coalesce(sum(neg), 0) AS fp
  FROM ts LEFT JOIN sc ON sc.p >= ts.threshold GROUP BY 1, 2),
sweep AS (SELECT step, threshold, tp, fp, np - tp AS fn, nn - fp AS tn,
  coalesce(2.0 * tp / nullif(2.0 * tp + fp + (np - tp), 0), 0) AS f1,
  (np - tp) * 10000.0 + fp * 500.0 AS cost FROM hits, tot)"""

_BEST = """
  (SELECT CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END FROM sweep ORDER BY f1 DESC, step LIMIT 1) AS bt,
  (SELECT max(f1) FROM sweep) AS bf,
  (SELECT threshold FROM sweep ORDER BY cost, step LIMIT 1) AS ct,
  (SELECT min(cost) FROM sweep) AS cc"""

SPLIT = CLEAN + f""",
n AS (SELECT {TARGET} AS c, count(*) AS m FROM cleaned GROUP BY 1),
share AS (SELECT c, m, m * (tot - ceil(tot * 0.2)) / tot AS s, tot - ceil(tot * 0.2) AS n_train
  FROM (SELECT *, sum(m) OVER () AS tot FROM n)),
sizes AS (SELECT c, m, floor(s) + CASE WHEN row_number() OVER (ORDER BY floor(s) - s, c) <= n_train - sum(floor(s)) OVER ()
  THEN 1 ELSE 0 END AS train FROM share),
ranked AS (SELECT LoanID, {TARGET}, row_number() OVER (PARTITION BY {TARGET} ORDER BY md5(concat('42:', LoanID))) AS k FROM cleaned),
split AS (SELECT LoanID, ranked.{TARGET}, k <= m - train AS is_test FROM ranked JOIN sizes ON sizes.c = ranked.{TARGET})"""


def _q(ctes, select):
    return f"WITH {ctes.strip()}\n{select}"


def _int(expr):
    return f"CAST({expr} AS BIGINT)"


def _union(parts):
    return " UNION ALL ".join(parts)


def _stack(cols, source):
    return _union([f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, {TARGET} FROM {source}" for c in cols])


def _code(c, values, default="NULL"):
    whens = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN {v}" for k, v in values.items())
    return f"CASE {c} {whens} ELSE {default} END"


_YES_NO = {"Yes": 1, "No": 0}
_ONE_HOT = [f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c in NOMINAL_COLS for v in NOMINAL_VALUES[c]]
_NUM = ", ".join(NUMERIC_COLS)
_RATE = f"round(avg({TARGET}) * 100.0, 2)"
_RISK = f"count(LoanID) AS Total_Loans, {_int(f'sum({TARGET})')} AS Default_Count, {_RATE} AS Default_Rate_Pct"
_L, _C, _D = "loan_applications l", "JOIN customers c ON l.CustomerID = c.CustomerID", "JOIN loan_details d ON l.LoanID = d.LoanID"


def _cleaning():
    q = {}
    q["s01_read_loans_csv"] = _q(RAW, "SELECT * FROM loans_raw")
    q["c01_dedup_first"] = _q(UNIQ, "SELECT * FROM uniq")
    q["c02_dedup_rows"] = _q(RAW, f"SELECT DISTINCT Education, EmploymentType, MaritalStatus, LoanPurpose, HasCoSigner, {TARGET} FROM loans_raw")
    q["c03_duplicate_count"] = _q(RAW, f"""SELECT {_int("count(*) - (SELECT count(*) FROM (SELECT DISTINCT LoanID FROM loans_raw))")} AS duplicate_rows FROM loans_raw""")
    q["c04_age_to_null"] = _q(RAW, "SELECT LoanID, RowSeq, CASE WHEN Age BETWEEN 18 AND 100 THEN Age END AS Age FROM loans_raw")
    q["c05_c06_c07_drop_invalid"] = _q(VALID, "SELECT LoanID, Age, Income, LoanAmount FROM valid")
    q["c07_nulls_kept"] = _q(RAW, "SELECT LoanID, RowSeq, Income, LoanAmount FROM loans_raw WHERE (Income IS NULL OR Income >= 0) AND (LoanAmount IS NULL OR LoanAmount > 0)")
    q["c07_no_invalid_income"] = _q(RAW, """SELECT LoanID, RowSeq, Income, LoanAmount FROM loans_raw
      WHERE (Income >= 0 OR Income IS NULL) AND LoanAmount > 0""")
    cols = [*NUMERIC_COLS, *CATEGORICAL_COLS]
    q["c08_missing_profile"] = _q(VALID, _union([f"SELECT '{c}' AS \"column\", {_int(f'count(*) - count({c})')} AS n_missing FROM valid" for c in cols]))
    q["c09_medians"] = _q(VALID, _union([f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.5) AS value FROM valid" for c in NUMERIC_COLS]))
    q["c10_modes"] = _q(VALID, _union([f"SELECT '{c}' AS \"column\", {_mode(c)} AS value" for c in CATEGORICAL_COLS]))
    q["c11_impute"] = _q(CLEAN, "SELECT * FROM cleaned")
    q["c12_cleaning_report"] = _q(VALID, f"""SELECT
      {_int("(SELECT count(*) FROM loans_raw)")} AS rows_in,
      {_int("(SELECT count(*) FROM loans_raw) - (SELECT count(*) FROM uniq)")} AS duplicates_dropped,
      {_int("(SELECT count(*) FROM uniq WHERE Age < 18 OR Age > 100)")} AS ages_nulled,
      {_int("(SELECT count(*) FROM uniq) - (SELECT count(*) FROM inc)")} AS income_dropped,
      {_int("(SELECT count(*) FROM inc) - (SELECT count(*) FROM valid)")} AS amount_dropped,
      {_int("(SELECT count(*) FROM valid)")} AS rows_out""")
    binary = ", ".join(f"{_code(c, _YES_NO)} AS {c}" for c in BINARY_COLS)
    q["c13_encode_binary"] = _q(RAW, f"SELECT LoanID, RowSeq, {binary} FROM loans_raw")
    q["c14_encode_ordinal"] = _q(RAW, f"SELECT LoanID, RowSeq, Education, {_code('Education', EDUCATION_LEVELS)} AS Education_Encoded FROM loans_raw")
    q["c15_one_hot"] = _q(RAW, f"SELECT LoanID, RowSeq, {', '.join(_ONE_HOT)} FROM loans_raw")
    q["c15_unknown_categories"] = _q(RAW, """SELECT 'LoanPurpose' AS "column", LoanPurpose AS value, count(*) AS n FROM loans_raw
      WHERE LoanPurpose NOT IN ('Auto', 'Business', 'Education') GROUP BY 2 UNION ALL
      SELECT 'MaritalStatus', MaritalStatus, count(*) FROM loans_raw WHERE MaritalStatus NOT IN ('Divorced', 'Married') GROUP BY 2""")
    q["c16_bools_to_int"] = _q(RAW, "SELECT LoanID, RowSeq, CAST(Income < 0 AS INTEGER) AS bad_income, CAST(LoanAmount <= 0 AS INTEGER) AS bad_amount FROM loans_raw")
    q["c17_encoded"] = _q(CLEAN, f"""SELECT LoanID, RowSeq, {_NUM}, Education, {binary},
      {_code('Education', EDUCATION_LEVELS)} AS Education_Encoded, {', '.join(_ONE_HOT)}, {TARGET} FROM cleaned""")
    return q


def _relational():
    q = {}
    q["n01_customer_id"] = _q(CLEAN, "SELECT LoanID, concat('CUST_', LoanID) AS CustomerID FROM cleaned")
    q["n02_customers"] = _q(NORM, "SELECT * FROM customers")
    q["n03_loan_applications"] = _q(NORM, "SELECT * FROM loan_applications")
    q["n04_loan_details"] = _q(NORM, "SELECT * FROM loan_details")

    def broken(t, k):
        return f"SELECT '{t}' AS table_name, 'primary key {k}' AS rule, {_int('count(*)')} AS violations FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1 OR {k} IS NULL)"

    def orphan(t, k, parent):
        return f"SELECT '{t}' AS table_name, 'foreign key {k}' AS rule, {_int('count(*)')} AS violations FROM {t} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {k} FROM {parent})"

    q["n05_integrity"] = _q(NORM, _union([
        broken("customers", "CustomerID"), broken("loan_applications", "LoanID"), broken("loan_details", "LoanID"),
        orphan("loan_applications", "CustomerID", "customers"), orphan("loan_details", "LoanID", "loan_applications")]))
    q["n05_integrity_raw"] = _q(RAW + """,
      t AS (SELECT LoanID, concat('CUST_', LoanID) AS CustomerID, Income, RowSeq FROM loans_raw),
      customers AS (SELECT DISTINCT CustomerID, Income FROM t WHERE RowSeq % 6 <> 0), loan_applications AS (SELECT LoanID, CustomerID FROM t),
      loan_details AS (SELECT LoanID FROM t)""", _union([
        broken("customers", "CustomerID"), broken("loan_applications", "LoanID"), broken("loan_details", "LoanID"),
        orphan("loan_applications", "CustomerID", "customers"), orphan("loan_details", "LoanID", "loan_applications")]))
    q["n06_table_counts"] = _q(NORM, _union([f"SELECT '{t}' AS table_name, {_int('count(*)')} AS row_count FROM {t}" for t in ("customers", "loan_applications", "loan_details")]))
    q["s08_published_views"] = q["n06_table_counts"]

    kpi = f"""{_int('count(*)')} AS Total_Applications, {_int(f'sum(CASE WHEN {TARGET} = 0 THEN 1 ELSE 0 END)')} AS Non_Default_Count,
      {_int(f'sum(CASE WHEN {TARGET} = 1 THEN 1 ELSE 0 END)')} AS Default_Count, {_RATE} AS Default_Rate_Pct"""
    marts = {
        "q1_kpi": f"SELECT {kpi} FROM {_L}",
        "q1x_kpi": f"SELECT {kpi}, round(avg(LoanAmount), 2) AS Avg_Loan_Amount, round(avg(InterestRate), 2) AS Avg_Interest_Rate FROM {_L}",
        "q2_education": f"SELECT Education, {_RISK}, round(avg(Income), 2) AS Avg_Income, round(avg(LoanAmount), 2) AS Avg_Loan_Amount FROM {_L} {_C} GROUP BY Education",
        "q3_employment": f"SELECT EmploymentType, {_RISK.replace('LoanID', 'l.LoanID')}, round(avg(Income), 2) AS Avg_Income, round(avg(MonthsEmployed), 1) AS Avg_Months_Employed FROM {_L} {_C} {_D} GROUP BY EmploymentType",
        "q4_purpose": f"SELECT LoanPurpose, {_RISK}, round(avg(LoanAmount), 2) AS Avg_Loan_Amount, round(avg(InterestRate), 2) AS Avg_Interest_Rate FROM {_L} GROUP BY LoanPurpose",
        "q5_profile": f"""SELECT CASE WHEN {TARGET} = 1 THEN 'Defaulter' ELSE 'Non-Defaulter' END AS Status, count(l.LoanID) AS Applicant_Count,
          round(avg(Income), 2) AS Avg_Income, round(avg(LoanAmount), 2) AS Avg_Loan_Amount, round(avg(CreditScore), 1) AS Avg_Credit_Score,
          round(avg(DTIRatio), 3) AS Avg_DTI_Ratio, round(avg(InterestRate), 2) AS Avg_Interest_Rate FROM {_L} {_C} {_D} GROUP BY {TARGET}""",
        "q6_band": f"""SELECT CASE WHEN CreditScore < 580 THEN '1. Poor (<580)' WHEN CreditScore BETWEEN 580 AND 669 THEN '2. Fair (580-669)'
          WHEN CreditScore BETWEEN 670 AND 739 THEN '3. Good (670-739)' WHEN CreditScore BETWEEN 740 AND 799 THEN '4. Very Good (740-799)'
          ELSE '5. Excellent (800+)' END AS Credit_Score_Band, {_RISK.replace('LoanID', 'l.LoanID')} FROM {_L} {_D} GROUP BY 1""",
        "q7_highrisk": f"""SELECT count(l.LoanID) AS High_Risk_Count, {_int(f'sum({TARGET})')} AS High_Risk_Defaults, {_RATE} AS High_Risk_Default_Rate_Pct
          FROM {_L} {_D} WHERE DTIRatio > 0.6 AND CreditScore < 600""",
        "q8_cosigner": f"SELECT HasCoSigner, {_RISK} FROM {_L} GROUP BY HasCoSigner",
    }
    for name, sql in marts.items():
        q[name] = _q(NORM, sql)
    for name in ("q2_education", "q3_employment", "q5_profile", "q6_band", "q7_highrisk"):
        q[f"{name}_wide"] = q[name]
    return q


def _features():
    q = {}
    q["f01_loan_to_income"] = _q(FEATURES, "SELECT LoanID, lti AS LoanToIncomeRatio FROM fe")
    q["f02_monthly_income"] = _q(FEATURES, "SELECT LoanID, monthly AS MonthlyIncome FROM fe")
    q["f03_emi"] = _q(FEATURES, "SELECT LoanID, round(emi, 4) AS EMI FROM fe")
    q["f04_emi_to_income"] = _q(FEATURES, "SELECT LoanID, round(emi_ratio, 4) AS EMIToIncomeRatio FROM fe")
    q["f05_employment_ratio"] = _q(FEATURES, "SELECT LoanID, emp_ratio AS EmploymentRatio FROM fe")
    q["f06_score_band"] = _q(FEATURES, "SELECT LoanID, band AS CreditScoreBand FROM fe")
    q["f06_undefined_features"] = _q(RAW, """SELECT count(*) FILTER (CreditScore IS NULL OR CreditScore <= 0 OR CreditScore > 1000) AS no_score_band,
      count(*) FILTER (Income IS NULL OR Income = 0 OR LoanAmount IS NULL) AS no_income_ratio FROM loans_raw""")
    q["f07_composite_risk"] = _q(FEATURES, "SELECT LoanID, cri AS CompositeRiskIndex FROM fe")
    q["f08_high_risk_flag"] = _q(FEATURES, "SELECT LoanID, high_risk AS HighRiskFlag FROM fe")
    q["f09_total_interest"] = _q(FEATURES, "SELECT LoanID, round(interest, 4) AS TotalInterestCost FROM fe")
    binary = ", ".join(f"{_code(c, _YES_NO)} AS {c}" for c in BINARY_COLS)
    engineered = """lti AS LoanToIncomeRatio, monthly AS MonthlyIncome, round(emi, 4) AS EMI,
      round(emi_ratio, 4) AS EMIToIncomeRatio, emp_ratio AS EmploymentRatio, band AS CreditScoreBand,
      cri AS CompositeRiskIndex, high_risk AS HighRiskFlag, round(interest, 4) AS TotalInterestCost"""
    q["f10_ml_ready"] = _q(FEATURES, f"""SELECT LoanID, {TARGET}, {_NUM}, {_code('Education', EDUCATION_LEVELS)} AS Education,
      {binary}, {engineered}, {', '.join(_ONE_HOT)} FROM fe""")
    # The scoring rules guard every ratio; they run on rows that cleaning has not touched.
    guarded = f"""
      SELECT *, CASE WHEN monthly > 0 THEN emi / monthly ELSE 0 END AS emi_ratio, emi * LoanTerm - LoanAmount AS interest FROM (
        SELECT *, CASE WHEN Income > 0 THEN LoanAmount / Income ELSE 0 END AS lti, Income / 12.0 AS monthly,
          CASE WHEN InterestRate / 100.0 / 12.0 > 0 THEN {EMI} WHEN LoanTerm > 0 THEN LoanAmount / LoanTerm ELSE 0 END AS emi,
          CASE WHEN Age IS NOT NULL THEN MonthsEmployed / greatest((Age - 18) * 12, 1) END AS emp_ratio,
          CASE WHEN CreditScore > 0 THEN DTIRatio * InterestRate / (CreditScore / 100.0) ELSE 0 END AS cri,
          CASE WHEN DTIRatio > 0.6 AND CreditScore < 600 THEN 1 ELSE 0 END AS high_risk,
          {{band}} AS band FROM loans_raw)"""
    right = """CASE WHEN CreditScore <= 580 THEN 0 WHEN CreditScore <= 670 THEN 1 WHEN CreditScore <= 740 THEN 2
      WHEN CreditScore <= 800 THEN 3 WHEN CreditScore <= 1000 THEN 4 ELSE 0 END"""
    left = """CASE WHEN CreditScore < 580 THEN 0 WHEN CreditScore < 670 THEN 1 WHEN CreditScore < 740 THEN 2
      WHEN CreditScore < 800 THEN 3 ELSE 4 END"""
    q["f11_scoring_features"] = _q(RAW, f"SELECT LoanID, RowSeq, {engineered} FROM ({guarded.format(band=right)})")
    q["f12_app_features"] = _q(RAW, f"SELECT LoanID, RowSeq, {engineered} FROM ({guarded.format(band=left)})")
    q["f13_cut"] = _q(RAW, """SELECT LoanID, RowSeq,
      CASE WHEN Age > 17 AND Age <= 30 THEN '18-30' WHEN Age > 30 AND Age <= 45 THEN '31-45'
           WHEN Age > 45 AND Age <= 60 THEN '46-60' WHEN Age > 60 AND Age <= 100 THEN '60+' END AS AgeGroup FROM loans_raw""")
    edges = ", ".join(f"quantile_cont(Income, {i / 5}) AS e{i}" for i in range(6))
    bracket = """CASE WHEN Income <= e1 THEN 'Very Low' WHEN Income <= e2 THEN 'Low' WHEN Income <= e3 THEN 'Medium'
      WHEN Income <= e4 THEN 'High' ELSE 'Very High' END"""
    q["f14_quantile_cut"] = _q(CLEAN + f", e AS (SELECT {edges} FROM cleaned)", f"SELECT LoanID, {bracket} AS IncomeBracket FROM cleaned, e")

    label = f"CASE {TARGET} WHEN 0 THEN 'Non-Default' WHEN 1 THEN 'Default' END"
    q["e01_default_label"] = _q(CLEAN, f"SELECT LoanID, {label} AS DefaultLabel FROM cleaned")
    q["e02_e03_target_distribution"] = _q(CLEAN, f"SELECT {label} AS DefaultLabel, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM cleaned), 1) AS pct FROM cleaned GROUP BY {TARGET}")

    def hist(c):
        edges = "[" + ", ".join([f"lo + {i} * ((hi - lo) / 25)" for i in range(25)] + ["hi"]) + "]"
        return f"""SELECT '{c}' AS "column", {TARGET}, CAST(bin AS INTEGER) AS bin, edges[bin + 1] AS bin_lo, edges[bin + 2] AS bin_hi, count(*) AS n
          FROM (SELECT {TARGET}, edges, least(len(list_filter(edges, lambda e: e <= {c})) - 1, 24) AS bin
                FROM cleaned, (SELECT {edges} AS edges FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM cleaned))) GROUP BY ALL"""
    q["e04_histogram"] = _q(CLEAN, _union([hist("Age"), hist("DTIRatio")]))

    def kde(c):
        return f"""SELECT '{c}' AS "column", {TARGET}, CAST(i AS INTEGER) AS point, round(x, 6) AS x,
            round(sum(n * exp(-0.5 * pow((x - v) / w, 2))) / max(cn * w * sqrt(2 * pi())), 6) AS density
          FROM (SELECT {TARGET}, {c} AS v, count(*) AS n FROM cleaned GROUP BY 1, 2)
          JOIN (SELECT {TARGET}, count(*) AS cn, stddev_samp({c}) * pow(count(*), -0.2) AS w FROM cleaned GROUP BY 1) USING ({TARGET}),
          (SELECT i, lo + i * ((hi - lo) / 199) AS x FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM cleaned), (SELECT unnest(range(200)) AS i))
          GROUP BY {TARGET}, i, x"""
    q["e05_density"] = _q(CLEAN, _union([kde("Age"), kde("DTIRatio")]))

    def box(c):
        return f"""SELECT '{c}' AS "column", {TARGET}, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
            min({c}) FILTER ({c} BETWEEN lo AND hi) AS whisker_lo, max({c}) FILTER ({c} BETWEEN lo AND hi) AS whisker_hi,
            {_int(f'count(*) FILTER ({c} NOT BETWEEN lo AND hi)')} AS n_outliers
          FROM cleaned JOIN (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT {TARGET}, quantile_cont({c}, 0.25) AS q1,
            quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM cleaned GROUP BY 1)) USING ({TARGET}) GROUP BY {TARGET}, q1, q2, q3"""
    q["e06_boxes"] = _q(CLEAN, _union([box(c) for c in ("Income", "CreditScore", "InterestRate", "MonthsEmployed")]))

    def rates(labels, name, expr, source):
        rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
        return f"""SELECT CAST(position AS INTEGER) AS position, t.{name}, coalesce(n, 0) AS n, round(r, 6) AS default_rate
          FROM (VALUES {rows}) t(position, {name}) LEFT JOIN (SELECT {expr} AS {name}, count(*) AS n, avg({TARGET}) AS r FROM {source} GROUP BY 1) USING ({name})"""
    age = "CASE WHEN Age > 17 AND Age <= 30 THEN '18-30' WHEN Age <= 45 THEN '31-45' WHEN Age <= 60 THEN '46-60' WHEN Age <= 100 THEN '60+' END"
    q["e07_rate_by_age_group"] = _q(CLEAN, rates(["18-30", "31-45", "46-60", "60+"], "AgeGroup", age, "cleaned"))
    q["e08_rate_by_income_quintile"] = _q(CLEAN + f", e AS (SELECT {edges} FROM cleaned)", rates(
        ["Very Low", "Low", "Medium", "High", "Very High"], "IncomeBracket", bracket, "cleaned, e"))
    cats = ["Education", "EmploymentType", "LoanPurpose", "MaritalStatus", "HasCoSigner", "HasMortgage"]
    q["e09_rate_by_category"] = _q(CLEAN, f"""SELECT "column", value, count(*) AS n, round(avg({TARGET}), 6) AS default_rate FROM ({_stack(cats, 'cleaned')}) GROUP BY 1, 2""")
    cols = [*NUMERIC_COLS, TARGET]
    q["e10_correlations"] = _q(CLEAN, _union([
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM cleaned" for a in cols for b in cols]))
    return q


def _evaluation():
    q = {}
    q["m02_class_distribution"] = _q(CLEAN, f"SELECT {TARGET}, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM cleaned), 6) AS pct FROM cleaned GROUP BY 1")
    q["m03_stratified_split"] = _q(SPLIT, "SELECT * FROM split")
    train = SPLIT + ", tr AS (SELECT * FROM split WHERE NOT is_test)"
    q["m04_scale_pos_weight"] = _q(train, f"SELECT round(sum(1 - {TARGET}) / sum({TARGET}), 9) AS scale_pos_weight FROM tr")
    q["m05_class_weights"] = _q(train, f"SELECT LoanID, {TARGET}, round(t / (2.0 * nc), 9) AS weight FROM (SELECT *, count(*) OVER () AS t, count(*) OVER (PARTITION BY {TARGET}) AS nc FROM tr)")
    q["m14_stratified_folds"] = _q(CLEAN + f""",
      pos AS (SELECT LoanID, {TARGET} AS c, row_number() OVER (ORDER BY {TARGET}, md5(concat('42/5:', LoanID))) - 1 AS i,
        row_number() OVER (PARTITION BY {TARGET} ORDER BY md5(concat('42/5:', LoanID))) AS k FROM cleaned),
      fs AS (SELECT c, i % 5 AS f, count(*) AS m FROM pos GROUP BY 1, 2),
      ends AS (SELECT c, f, sum(m) OVER (PARTITION BY c ORDER BY f) AS upto, m FROM fs)""",
      f"SELECT LoanID, c AS {TARGET}, CAST(f AS INTEGER) AS fold FROM pos JOIN ends USING (c) WHERE k <= upto AND k > upto - m")
    q["m17_confusion"] = _q(SCORED, "SELECT * FROM cm")
    r4 = "round_even({} * 10000.0, 0) / 10000.0"
    div = "coalesce(CAST({} AS DOUBLE) / nullif({}, 0), 0)"
    acc, pre = div.format("(tp + tn)", "tn + fp + fn + tp"), div.format("tp", "tp + fp")
    rec, f1 = div.format("tp", "tp + fn"), div.format("2 * tp", "2 * tp + fp + fn")
    q["m18_class_metrics"] = _q(SCORED, f"SELECT {r4.format(acc)}::DOUBLE AS accuracy, {r4.format(pre)}::DOUBLE AS precision, {r4.format(rec)}::DOUBLE AS recall, {r4.format(f1)}::DOUBLE AS f1 FROM cm")
    auc = "sum(neg * (tp - pos / 2.0)) / max(np * CAST(nn AS DOUBLE))"
    ap = "sum(pos / CAST(np AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE)))"
    ks = "greatest(max(tp / CAST(np AS DOUBLE) - fp / CAST(nn AS DOUBLE)), 0)"
    q["m19_roc_auc"] = _q(SCORED, f"SELECT round({auc}, 9) AS roc_auc FROM cum")
    q["v01_roc_points"] = _q(SCORED, "SELECT p AS threshold, fp / CAST(nn AS DOUBLE) AS fpr, tp / CAST(np AS DOUBLE) AS tpr FROM cum")
    q["v01_roc_corners"] = _q(SCORED, """SELECT p AS threshold, fp / CAST(nn AS DOUBLE) AS fpr, tp / CAST(np AS DOUBLE) AS tpr FROM (
      SELECT *, lead(pos) OVER (ORDER BY p DESC) AS a, lead(neg) OVER (ORDER BY p DESC) AS b FROM cum)
      WHERE a IS NULL OR (tp = pos AND fp = neg) OR a <> pos OR b <> neg""")
    q["v02_ks"] = _q(SCORED, f"SELECT ({r4.format(ks)})::DOUBLE AS ks FROM cum")
    q["v03_pr_points"] = _q(SCORED, "SELECT p AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(np AS DOUBLE) AS recall FROM cum")
    q["v04_average_precision"] = _q(SCORED, f"SELECT round({ap}, 9) AS average_precision FROM cum")
    mcc = "coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"
    pe = "(((tp + fp)::DOUBLE * (tp + fn) + (tn + fp)::DOUBLE * (tn + fn)) / pow(tn + fp + fn + tp, 2))"
    kappa = f"(({acc} - {pe}) / nullif(1 - {pe}, 0))"
    q["v05_mcc"] = _q(SCORED, f"SELECT round({mcc}, 9) AS mcc FROM cm")
    q["v06_kappa"] = _q(SCORED, f"SELECT round({kappa}, 9) AS kappa FROM cm")
    r2 = "(round_even({} * 100.0, 0) / 100.0)::DOUBLE"
    best = f"best AS (SELECT {_BEST})"
    q["v07_best_f1"] = _q(SWEEP + "," + best, f"SELECT {r2.format('bt')} AS best_f1_threshold, ({r4.format('bf')})::DOUBLE AS best_f1_score FROM best")
    q["v08_min_cost"] = _q(SWEEP + "," + best, f"SELECT {r2.format('ct')} AS best_cost_threshold, {r2.format('cc')} AS min_expected_cost FROM best")
    q["v09_threshold_sweep"] = _q(SWEEP, f"SELECT CAST(step AS INTEGER) AS step, threshold, {', '.join(f'{_int(c)} AS {c}' for c in ('tp', 'fp', 'fn', 'tn'))}, f1, cost::DOUBLE AS cost FROM sweep")
    info = f"{r2.format('bt')} AS best_f1_threshold, ({r4.format('bf')})::DOUBLE AS best_f1_score, {r2.format('ct')} AS best_cost_threshold, {r2.format('cc')} AS min_expected_cost, 10000.0::DOUBLE AS cost_fn, 500.0::DOUBLE AS cost_fp"
    q["s14_threshold_info"] = _q(SWEEP + "," + best, f"SELECT {info} FROM best")
    cuts = [i * 0.1 for i in range(1, 10)]
    bins = "CASE " + " ".join(f"WHEN p <= {e!r}::DOUBLE THEN {i}" for i, e in enumerate(cuts)) + " ELSE 9 END"
    q["v10_calibration_curve"] = _q(SCORED, f"SELECT {bins} AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS positive_rate FROM scored GROUP BY 1")
    q["v11_ks_chart"] = _q(SCORED + ", g AS (SELECT p AS threshold, tp / CAST(np AS DOUBLE) AS tpr, fp / CAST(nn AS DOUBLE) AS fpr, tp / CAST(np AS DOUBLE) - fp / CAST(nn AS DOUBLE) AS gap FROM cum)",
      "SELECT *, threshold = (SELECT threshold FROM g ORDER BY gap DESC, threshold DESC LIMIT 1) AS is_max FROM g")
    tiers = ["Low Risk (<30%)", "Medium Risk (30-60%)", "High Risk (>60%)"]
    tier = f"CASE WHEN p > -0.01 AND p <= 0.3 THEN '{tiers[0]}' WHEN p <= 0.6 THEN '{tiers[1]}' WHEN p <= 1.01 THEN '{tiers[2]}' END"
    q["v14_scorecard"] = _q(SCORED, f"""SELECT t.RiskCategory, coalesce(n, 0) AS Total_Applicants, {_int('coalesce(d, 0)')} AS Actual_Defaults, {r2.format('r * 100')} AS Actual_Default_Rate
      FROM (VALUES {', '.join(f"('{t}')" for t in tiers)}) t(RiskCategory) LEFT JOIN (SELECT {tier} AS RiskCategory, count(*) AS n, sum(label) AS d, avg(label) AS r FROM scored GROUP BY 1) USING (RiskCategory)""")
    q["v16_explanation_sample"] = _q(CLEAN, "SELECT LoanID FROM cleaned ORDER BY md5(concat('42:', LoanID)), LoanID LIMIT 1000")
    bundle = f"""(SELECT round({auc}, 9) FROM cum) AS ROC_AUC, (SELECT ({r4.format(ap)})::DOUBLE FROM cum) AS Average_Precision,
      ({r4.format(mcc)})::DOUBLE AS MCC, ({r4.format(kappa)})::DOUBLE AS Cohens_Kappa, (SELECT ({r4.format(ks)})::DOUBLE FROM cum) AS KS_Statistic"""
    q["v21_metric_bundle"] = _q(SCORED, f"SELECT {bundle}, tp AS TP, fp AS FP, tn AS TN, fn AS FN FROM cm")
    q["s15_metrics_document"] = _q(SWEEP + "," + best, f"SELECT 'proxy' AS model, {bundle}, tp AS cm_TP, fp AS cm_FP, tn AS cm_TN, fn AS cm_FN, {info} FROM cm, best")
    q["p04_decision"] = _q(SWEEP + "," + best, f"SELECT LoanID, CASE WHEN p >= {r2.format('ct')} THEN 1 ELSE 0 END AS Predicted_Default, {r2.format('ct')} AS Threshold FROM scored, best")
    q["p05_risk_tier"] = _q(SCORED, f"SELECT LoanID, CASE WHEN p <= 0.3 THEN '{tiers[0]}' WHEN p <= 0.6 THEN '{tiers[1]}' ELSE '{tiers[2]}' END AS risk_tier FROM scored")
    return q


def _scoring():
    q = {}
    text = ", ".join(CATEGORICAL_COLS)
    q["s18_parse_applicants"] = _q(RAW, f"SELECT LoanID, RowSeq, true AS is_valid, {_NUM}, {text} FROM loans_raw")
    binary = ", ".join(f"CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END AS {c}" for c in BINARY_COLS)
    q["p02_scoring_encoding"] = _q(RAW, f"SELECT LoanID, RowSeq, {binary}, {_code('Education', EDUCATION_LEVELS, '1')} AS Education, {', '.join(_ONE_HOT)} FROM loans_raw")
    have = {"Age", "Income", "LoanAmount"}
    q["p01_align"] = _q(RAW, "SELECT LoanID, RowSeq, " + ", ".join(f'{c}' if c in have else f'0.0::DOUBLE AS "{c}"' for c in FEATURE_COLS) + " FROM loans_raw")
    q["p08_underwriting"] = _q(SCORED, """SELECT LoanID,
      CASE WHEN p < 0.3 THEN 'Low Risk' WHEN p < 0.6 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_tier,
      CASE WHEN p < 0.3 THEN '✅ LOAN APPROVED' WHEN p < 0.6 THEN '⚠️ CONDITIONAL APPROVAL / MANUAL REVIEW' ELSE '❌ HIGH DEFAULT RISK (REJECT / MANUAL REVIEW)' END AS status,
      CASE WHEN p < 0.3 THEN 'Low default probability. Fast-track approval recommended.'
           WHEN p < 0.6 THEN 'Moderate risk. Additional proof of income or higher down payment advised.'
           ELSE 'Elevated risk of default. Requires underwriting committee manual review.' END AS recommendation,
      round((1 - p) * 100, 6) AS approval_pct, round(p * 100, 6) AS default_pct FROM scored""")
    return q


def _models():
    q = {}
    coded = ", ".join(f"CAST({_code(c, _YES_NO)} AS DOUBLE) AS {c}" for c in BINARY_COLS)
    q["m01_feature_vectors"] = _q(CLEAN, f"""SELECT LoanID, CAST({TARGET} AS DOUBLE) AS label, {_NUM}, {coded},
      CAST({_code('Education', EDUCATION_LEVELS)} AS DOUBLE) AS Education FROM cleaned""")
    q["m06_standard_scaling"] = _q(CLEAN, _union([
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM cleaned" for c in NUMERIC_COLS]))
    drivers = {"CreditScore": -0.5, "InterestRate": 0.8, "LoanAmount": 0.1}
    phis = ", ".join(f"{w} * ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS phi_{c}" for c, w in drivers.items())
    explained = CLEAN + f", explained AS (SELECT LoanID, {', '.join(drivers)}, {phis} FROM cleaned)"
    q["v17_linear_attributions"] = _q(explained, "SELECT LoanID, -2.0::DOUBLE AS base, " + ", ".join(
        f"round(phi_{c}, 6) AS phi_{c}" for c in drivers) + " FROM explained")
    q["v19_global_importance"] = _q(explained, _union([
        f"SELECT '{c}' AS Feature, round(avg(abs(phi_{c})), 6) AS Mean_Abs_SHAP FROM explained" for c in drivers]))
    parts = _union([f"SELECT LoanID, '{c}' AS feature, {c} AS value, phi_{c} AS phi FROM explained" for c in drivers])
    q["v20_waterfall"] = _q(explained + f""", parts AS ({parts})""", """SELECT LoanID, CAST(row_number() OVER w - 1 AS INTEGER) AS step,
      feature, value, round(phi, 6) AS phi, round(-2.0::DOUBLE + sum(phi) OVER w, 6) AS running
      FROM parts WINDOW w AS (PARTITION BY LoanID ORDER BY abs(phi) DESC, feature ROWS UNBOUNDED PRECEDING)""")
    q["p09_stream_decisions"] = _q(RAW, """SELECT LoanID, RowSeq, CASE WHEN p < 0.3 THEN 'Low Risk' WHEN p < 0.6 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_tier,
      round((1 - p) * 100, 6) AS approval_pct, CASE WHEN p >= 0.3 THEN 1 ELSE 0 END AS Predicted_Default, 0.3::DOUBLE AS Threshold
      FROM (SELECT *, round((850 - CreditScore) * (InterestRate * 100)) / 1375000 AS p FROM loans_raw)""")
    return q


def _proxies():
    q = {}
    p = "round((850 - CreditScore) * (InterestRate * 100)) / 1375000"
    shown = "(round_even(p * 10000.0, 0) / 10000.0)::DOUBLE"
    rows = f"(SELECT *, {p} AS p FROM loans_raw)"
    decided = "CASE WHEN p >= 0.3 THEN 1 ELSE 0 END"
    q["p06_batch_proxy"] = _q(RAW, f"""SELECT * EXCLUDE (p), {shown} AS Default_Probability, {decided} AS Predicted_Default,
      0.3::DOUBLE AS Threshold FROM {rows}""")
    q["p07_applicant_proxy"] = _q(RAW, f"""SELECT LoanID, RowSeq, {shown} AS default_probability, {decided} AS predicted_class,
      0.3::DOUBLE AS threshold_used, CASE WHEN p <= 0.3 THEN 'Low Risk (<30%)' WHEN p <= 0.6 THEN 'Medium Risk (30-60%)'
      ELSE 'High Risk (>60%)' END AS risk_tier FROM {rows}""")
    scores = {"proxy": p, "score_only": "(850 - CreditScore) / 550", "rate_only": "InterestRate / 25"}
    each = _union([f"SELECT '{m}' AS model, {TARGET} AS y, {expr} AS s FROM cleaned JOIN split USING (LoanID, {TARGET}) WHERE is_test" for m, expr in scores.items()])
    q["m21_best_candidate"] = _q(SPLIT + f""", scores AS ({each}),
      g AS (SELECT model, s, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY 1, 2),
      c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY s DESC) AS tp, sum(pos) OVER (PARTITION BY model) AS np,
        sum(neg) OVER (PARTITION BY model) AS nn FROM g),
      auc AS (SELECT model, round_even(sum(neg * (tp - pos / 2.0)) / max(np * CAST(nn AS DOUBLE)) * 10000.0, 0) AS a FROM c GROUP BY 1)""",
      "SELECT model AS best_model FROM auc ORDER BY a DESC, model LIMIT 1")
    return q


def _exports():
    sizes = {"sql_kpi_summary": "1", "sql_default_by_education": "count(DISTINCT Education)",
             "sql_default_by_employment": "count(DISTINCT EmploymentType)",
             "sql_default_by_purpose": "count(DISTINCT LoanPurpose)", "sql_financial_profiles": f"count(DISTINCT {TARGET})"}
    return _q(CLEAN, _union([f"SELECT '{m}' AS mart, {_int(n if n != '1' else 'least(count(*), 1)')} AS rows FROM cleaned" for m, n in sizes.items()]))


def oracle_sql():
    q = {**_cleaning(), **_relational(), **_features(), **_evaluation(), **_scoring(), **_models(), **_proxies()}
    # Files written and read back hold the same rows.
    q["s04_cleaned_table"] = q["c11_impute"]
    q["s05_encoded_table"] = q["c17_encoded"]
    q["s06_ml_ready_table"] = q["f10_ml_ready"]
    q["s09_exported_marts"] = _exports()
    return q
