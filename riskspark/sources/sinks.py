"""Writers: step tables, marts, published relational tables, documents."""

from pyspark.sql import DataFrame

from riskspark.operators.relational import PRIMARY_KEYS


def write_table(df: DataFrame, path: str, fmt="parquet", mode="overwrite") -> None:
    """A step's output. CSV carries a header and only flat columns."""
    if fmt == "csv":
        flat = [name for name, kind in df.dtypes if not kind.startswith(("struct", "array", "map"))]
        df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def export_mart(df: DataFrame, directory: str, name: str) -> str:
    """A small result as CSV with a header; rows keep their order."""
    path = f"{directory.rstrip('/')}/{name}"
    write_table(df.coalesce(1), path, "csv")
    return path


def publish_tables(tables: dict, mode="overwrite", database=None, buckets=None) -> None:
    """Make the normalised tables queryable by name.

    Without a database they become temporary views. With one they are saved
    as tables, bucketed by key when `buckets` is given, so that the marts join
    them without a shuffle.
    """
    for name, df in tables.items():
        if database is None:
            df.createOrReplaceTempView(name)
            continue
        writer = df.write.mode(mode).format("parquet")
        if buckets:
            key = "CustomerID" if name == "loan_applications" else PRIMARY_KEYS[name]
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")


def write_comparison(df: DataFrame, *directories) -> None:
    """Model comparison as CSV in every directory and JSON in the first."""
    df = df.coalesce(1)
    for d in directories:
        write_table(df, f"{d.rstrip('/')}/model_comparison", "csv")
    df.write.mode("overwrite").json(f"{directories[0].rstrip('/')}/model_comparison_json")


def write_document(df: DataFrame, directory: str, name="evaluation_metrics") -> str:
    """A nested one-row document as JSON."""
    path = f"{directory.rstrip('/')}/{name}"
    df.coalesce(1).write.mode("overwrite").json(path)
    return path
