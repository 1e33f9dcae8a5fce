"""Readers: loan tables from CSV, applicants from JSON text."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskspark.schema import APPLICANT_SCHEMA, LOAN_SCHEMA, NA_TOKENS, ORDER_COL


def read_loans(spark: SparkSession, path: str, na_tokens=NA_TOKENS, schema=LOAN_SCHEMA, target_name=None,
               multi_line=False) -> DataFrame:
    """Loan CSV with a header, as typed columns plus the input order.

    Values are read as text, missing-value tokens become null, and text that
    is no number becomes null too. Columns the schema does not know stay text.
    RowSeq orders rows as they stand in the files, by file, block and row.
    `multi_line` is for files with line breaks inside quotes; such files are
    not split. In text columns a token counts only as it stands, in numeric
    ones also with blanks around it.
    """
    text = spark.read.csv(path, header=True, inferSchema=False, nullValue=None, emptyValue="", escape='"', multiLine=multi_line)
    if target_name and target_name in text.columns:
        text = text.withColumnRenamed(target_name, "DefaultFlag")
    kinds = {f.name: f.dataType for f in schema}
    if ORDER_COL in text.columns:
        order = F.col(ORDER_COL).try_cast("bigint")
    else:
        order = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
    def cell(c):
        kind = kinds.get(c)
        plain = F.col(c) if kind is None or isinstance(kind, T.StringType) else F.trim(F.col(c))
        return _typed(F.when(~plain.isin(list(na_tokens)), F.col(c)), kind).alias(c)

    cells = [cell(c) for c in text.columns if c != ORDER_COL]
    return text.select(*cells, order.alias(ORDER_COL))


def _typed(col, kind):
    if kind is None or isinstance(kind, T.StringType):
        return col
    # Whole numbers may be written as 1.0.
    number = F.trim(col).try_cast("double")
    return number if isinstance(kind, T.DoubleType) else number.try_cast(kind)


def parse_applicants(df: DataFrame, json_col="json", schema=APPLICANT_SCHEMA, id_field=None) -> DataFrame:
    """One applicant per JSON text: the other columns plus the 16 attributes.

    A text that is no JSON object gives nulls and is_valid = false. `id_field`
    names a member of the object that is kept as a text column, so that a
    scored row can be matched to its applicant.
    """
    parsed = df.withColumn("_a", F.from_json(F.col(json_col), schema))
    if id_field:
        parsed = parsed.withColumn(id_field, F.get_json_object(json_col, f"$.{id_field}"))
    keep = [c for c in parsed.columns if c not in (json_col, "_a")]
    ok = F.col(json_col).isNotNull() & F.json_object_keys(json_col).isNotNull()
    return parsed.select(*keep, ok.alias("is_valid"), *[F.col(f"_a.{f.name}").alias(f.name) for f in schema])


def read_table(spark: SparkSession, path: str, fmt="parquet") -> DataFrame:
    """A table written by an earlier step."""
    return spark.read.option("header", True).format(fmt).load(path)
