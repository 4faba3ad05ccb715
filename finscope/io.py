"""Readers of split and single extracts, and writers of findings and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finscope.clean import is_blank

HOUSES = ("HOC", "HOL")


def text_schema(columns: list[str]) -> T.StructType:
    """Everything is read as text, so that leading zeros stay."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that the path names, so that it need not be a local one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_version(spark: SparkSession, directory: str, base: str, house: str, version: str | None = None) -> str | None:
    """The versioned file if it exists, else the plain one, else None."""
    names = ([f"{base}_{house}_{version}.csv"] if version else []) + [f"{base}_{house}.csv"]
    return next((f"{directory}/{n}" for n in names if exists(spark, f"{directory}/{n}")), None)


#: What Windows-1252 has where ISO-8859-1 has control characters.
_LATIN = "".join(map(chr, (c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))))
_WINDOWS = _LATIN.encode("latin-1").decode("cp1252")


def _csv(spark: SparkSession, path: str, windows: bool = False) -> DataFrame:
    """A CSV file with a header, all text; in UTF-8 or Windows-1252."""
    reader = lambda: spark.read.option("header", True).option("multiLine", True).option("encoding", "ISO-8859-1" if windows else "UTF-8")
    columns = reader().csv(path).columns
    df = reader().schema(text_schema(columns)).csv(path)
    if not windows:
        return df
    return df.select(*[F.translate(F.col(f"`{c}`"), _LATIN, _WINDOWS).alias(c.translate(str.maketrans(_LATIN, _WINDOWS))) for c in columns])


def read_split(spark: SparkSession, directory: str, base: str, houses=HOUSES, version: str | None = None) -> DataFrame | None:
    """<base>_<house>.csv of each house, with its house; None where no house has one."""
    parts = []
    for house in houses:
        if path := resolve_version(spark, directory, base, house, version):
            parts.append(_csv(spark, path).withColumn("house", F.lit(house)))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_single(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame | None:
    """A combined file in UTF-8, or in Windows-1252 where UTF-8 gives replacement characters."""
    if not exists(spark, path):
        return None
    df = _csv(spark, path)
    broken = F.lit(False)
    for c in df.columns:
        broken = broken | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
    if any("�" in c for c in df.columns) or df.where(broken).limit(1).count():
        df = _csv(spark, path, windows=True)
    return rename_ensure(df, names) if names else df


def rename_ensure(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Report headers to clean names; the first of several headers of one name counts, and missing ones are null."""
    have, out = {c.strip(): c for c in df.columns}, {}
    for header, name in names.items():
        if header in have and name not in out:
            out[name] = F.col(f"`{have[header]}`")
    mapped = {h.strip() for h in names}
    rest = [F.col(f"`{c}`") for c in df.columns if c.strip() not in mapped and c not in out and c not in names.values()]
    kept = {c: F.col(f"`{c}`") for c in names.values() if c in df.columns and c not in out}
    columns = {n: out.get(n, kept.get(n, F.lit(None).cast("string"))) for n in dict.fromkeys(names.values())}
    return df.select(*[c.alias(n) for n, c in columns.items()], *rest)


def drop_grand_total(df: DataFrame, key: str) -> DataFrame:
    """Without the summary row, whose key is blank."""
    return df.where(~is_blank(F.col(key)))


def load_domain(spark: SparkSession, directory: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """The frames of a domain: table to base name of its extract. Missing files leave their table out."""
    found = {t: read_split(spark, directory, base) if not base.endswith(".csv") else read_single(spark, f"{directory}/{base}") for t, base in tables.items()}
    return {t: df for t, df in found.items() if df is not None}


def write_findings(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def write_evidence(evidence: DataFrame, path: str) -> None:
    """Failing rows, one directory for each check and house."""
    evidence.write.mode("overwrite").partitionBy("check_id", "house").parquet(path)


def tracker(results: DataFrame, domain: str | None = None, house: str | None = None, comments=("owner", "comment", "resolved_on")) -> DataFrame:
    """Failing checks by domain, severity and id, with empty columns for comments."""
    out = results.where("failing > 0")
    out = out.where(F.col("domain") == domain) if domain else out
    out = out.where(F.col("house") == house) if house else out
    rank = F.expr("CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END")
    out = out.withColumn("severity_rank", rank).orderBy("domain", "severity_rank", "check_id", "house")
    return out.select("check_id", "domain", "object", "dimension", "severity", "severity_rank", "house", "total", "failing", "error_rate", "rag", *[F.lit("").alias(c) for c in comments])
