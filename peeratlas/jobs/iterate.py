"""Iterative jobs that go on where an earlier run ended."""

import hashlib
import json

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import Blocks, named, numbered, part_count
from ..operators.community import label_round
from ..sources.sinks import filesystem

#: Of the tables under a folder: those of another form are left alone.
FORM = 2


def latest_round(folder: str) -> tuple[int, str] | None:
    """The highest finished round=N in the folder, and its path; other names are ignored,
    as are rounds that were not written to the end."""
    files, path = filesystem(folder)
    if files.get_file_info(path).type.name == "NotFound":
        return None
    names = [i.base_name for i in files.get_file_info(FileSelector(path))]
    rounds = [int(n[6:]) for n in names if n.startswith("round=") and n[6:].isdigit()]
    done = [n for n in rounds if files.get_file_info(f"{path}/round={n}/_SUCCESS").type.name == "File"]
    return (max(done), f"{folder}/round={max(done)}") if done else None


def label_rounds(edges: DataFrame, folder: str, rounds: int, parameters: dict | None = None, names: DataFrame | None = None) -> DataFrame:
    """node, label by label propagation, each round a table of numbers of nodes under
    folder/<hash of the parameters>; rounds that are there are not computed again. So are the
    names of the numbers and the blocks of edges: they are written before the first round and
    read where they lie by all later ones, of this run and of those that go on from it. With
    names(number, node) the edges' ends are such numbers, in the order of the nodes."""
    spark = edges.sparkSession
    mark = hashlib.sha256(json.dumps([FORM, parameters or {}], sort_keys=True).encode()).hexdigest()[:12]
    place = f"{folder}/{mark}"
    done = latest_round(place)
    if done is None:  # round 0 is written last, so where a round is there is all it needs
        edges, names = (edges, names) if names is not None else numbered(edges)
        names.write.mode("overwrite").parquet(f"{place}/names")
        parts = part_count(2 * edges.count())
        spark.createDataFrame([(parts,)], "parts int").write.mode("overwrite").parquet(f"{place}/parts")
        Blocks(edges, parts, f"{place}/blocks-{parts}").nodes().select("node", F.col("node").alias("label")).write.mode("overwrite").parquet(f"{place}/round=0")
        done = (0, f"{place}/round=0")
    if done[0] < rounds:
        parts = spark.read.parquet(f"{place}/parts").first()[0]
        graph = Blocks(edges, parts, f"{place}/blocks-{parts}")
        for n in range(done[0] + 1, rounds + 1):
            label_round(graph, spark.read.parquet(f"{place}/round={n - 1}")).write.mode("overwrite").parquet(f"{place}/round={n}")
    return named(spark.read.parquet(f"{place}/round={rounds}"), spark.read.parquet(f"{place}/names"), "node", "label").select("node", "label")
