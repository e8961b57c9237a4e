"""The bibliographic snapshot: authors and works in parquet, by updated_date."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHORS = (
    "id string, display_name string, works_count int, cited_by_count int, "
    "last_known_institutions array<struct<display_name:string>>, "
    "topics array<struct<display_name:string,field:struct<display_name:string>>>, updated_date string"
)
WORKS = "id string, authors_count int, authorships array<struct<author:struct<id:string>>>, updated_date string"


def read_authors(spark: SparkSession, root: str) -> DataFrame:
    """Author records under root/updated_date=*/; any file system that Spark reads."""
    return spark.read.schema(AUTHORS).parquet(root)


def read_works(spark: SparkSession, root: str) -> DataFrame:
    """Work records. Of the nested columns the scan reads the leaves that are used."""
    return spark.read.schema(WORKS).parquet(root)


def list_partitions(snapshot: DataFrame) -> DataFrame:
    """The snapshot's partitions, from the folder names alone."""
    return snapshot.select("updated_date").distinct().orderBy("updated_date")


def filter_authors(authors: DataFrame, min_works: int = 5) -> DataFrame:
    """Nodes of the map: authors with enough works, with first institution and field."""
    return first_affiliation(authors.where(F.col("works_count") >= min_works)).select("id", "display_name", "works_count", "cited_by_count", "institution", "field")


def first_affiliation(authors: DataFrame) -> DataFrame:
    """institution and field: of the first list entries, null for null or empty lists."""
    institution = F.get("last_known_institutions", F.lit(0))["display_name"]
    return authors.withColumns({"institution": institution, "field": F.get("topics", F.lit(0))["field"]["display_name"]})


def extract_authorships(works: DataFrame) -> DataFrame:
    """work_id, n_authors (as stated) and the author ids; reads one nested leaf."""
    return works.select(F.col("id").alias("work_id"), F.col("authors_count").alias("n_authors"), F.col("authorships.author.id").alias("author_ids"), *[c for c in works.columns if c == "updated_date"])


def extract_incremental(works: DataFrame, out: str) -> list[str]:
    """Extract the partitions that out lacks; run again at will. Returns their names.

    Each write replaces exactly the partitions it holds, so a run that broke off is
    repaired by the next. The list of partition names comes to the driver: one short
    string a snapshot day.
    """
    spark = works.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda day: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/updated_date={day}"))
    pending = [r["updated_date"] for r in list_partitions(works).collect() if not done(r["updated_date"])]
    if pending:
        rows = extract_authorships(works.where(F.col("updated_date").isin(pending)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("updated_date").parquet(out)
    return pending
