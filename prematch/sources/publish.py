"""Sets of tables that are published whole or not at all (A12), with a manifest of counts and fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "release_id STRING, published_at TIMESTAMP, kind STRING, n_tables INT, table_name STRING, format STRING, location STRING, row_count LONG, fingerprint STRING"


def fingerprint(df: DataFrame) -> Column:
    """Stands for the rows of a table in any order: an aggregate that every task combines. Names and order of columns count too."""
    salt = F.lit("|".join(df.columns))
    row = F.xxhash64(salt, *[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
    return F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string"))


def publish(tables: dict[str, DataFrame], root: str, kind: str = "export", fmt: str = "parquet") -> str:
    """Write all tables of a release aside, then make it visible by one file of manifest rows; returns its id.

    A reader finds a release only through the manifest, and that file is moved into place as a whole: one that was stopped before
    leaves nothing to read, whatever it has written, and older releases stay as they were.
    """
    spark = next(iter(tables.values())).sparkSession
    release = uuid.uuid4().hex
    rows = []
    for name, df in tables.items():
        location = f"{root}/releases/{release}/{name}"
        if fmt == "parquet":
            df.write.mode("errorifexists").parquet(location)
            back = spark.read.schema(df.schema).parquet(location)
        elif fmt == "json":
            df.write.mode("errorifexists").option("ignoreNullFields", "false").json(location)
            back = spark.read.schema(df.schema).json(location)
        else:
            raise ValueError(f"Unknown format {fmt!r}; known are parquet and json.")
        # counted and fingerprinted from what was written, not from a plan that might give other rows a second time
        found = back.agg(F.count("*").alias("n"), fingerprint(back).alias("f")).first()
        rows.append((release, kind, len(tables), name, fmt, location, found["n"], found["f"]))
    entries = spark.createDataFrame(rows, "release_id STRING, kind STRING, n_tables INT, table_name STRING, format STRING, location STRING, row_count LONG, fingerprint STRING")
    entries.withColumn("published_at", F.current_timestamp()).select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return release


def releases(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """One row per published table of every complete release."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window

    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    whole = entries.withColumn("__n", F.count("*").over(Window.partitionBy("release_id"))).filter(F.col("__n") == F.col("n_tables")).drop("__n")
    return whole if kind is None else whole.filter(F.col("kind") == kind)


def read_release(spark: SparkSession, root: str, schemas: dict[str, str] | None = None, release: str | None = None, kind: str | None = None, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of a release, the newest if none is named. JSON tables need their schema, Parquet files bring their own. verify: recompute counts and fingerprints, raise where they differ."""
    known = releases(spark, root, kind)
    if release is None:
        newest = known.agg(F.max(F.struct("published_at", "release_id"))["release_id"]).first()[0]
        if newest is None:
            raise ValueError(f"Nothing has been published under {root}.")
        release = newest
    out = {}
    for r in known.filter(F.col("release_id") == release).collect():  # one row per table
        df = spark.read.schema(schemas[r["table_name"]]) if schemas else spark.read
        df = df.parquet(r["location"]) if r["format"] == "parquet" else df.json(r["location"])
        if verify and df.agg(fingerprint(df)).first()[0] != r["fingerprint"]:
            raise ValueError(f"{r['table_name']} of release {release} is not what was published.")
        out[r["table_name"]] = df
    if not out:
        raise ValueError(f"There is no release {release} under {root}.")
    return out
