"""Keyed store of the embedding index (O12, O52): rows are assigned by their key.

``path``/rows holds the entries by (gene_id, idx) with their vectors and a
digest of what the vector was made from; it is partitioned by ``part``, a hash
of the gene and the thousand its position is in, so that a gene of any size
lies in many parts.  ``path``/layout is one row: the number of parts, which
never changes.

An upsert embeds only entries whose digest the store does not have, and writes
only the parts that these belong to (dynamic partition overwrite, in one
commit).  Entries that a release no longer has stay, as the keys of a mapping
do.  If the last commit ends half way, a part can be absent; the next upsert
finds its entries missing and embeds them again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..operators.embed import embed
from ..schemas import INDEX
from ..session import scratch_path

#: Parts of a new store, and positions of a gene that lie in one part.
PARTS, BLOCK = 256, 1024
COLUMNS = [*INDEX.fieldNames(), "digest"]
STORE = T.StructType([*INDEX, T.StructField("digest", T.StringType()), T.StructField("part", T.IntegerType())])


def _digest(embedder_name: str) -> Column:
    """What a vector and its row depend on."""
    return F.sha2(F.to_json(F.struct(F.lit(embedder_name).alias("by"), "key", "gene_name", "type", "text")), 256)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("gene_id", F.floor(F.col("idx") / BLOCK)), F.lit(parts)).cast("int")


def _layout(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("parts int").parquet(f"{path}/layout").first()["parts"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["gene_id"].eqNullSafe(b["gene_id"]) & (a["idx"] == b["idx"])


def read_index_store(spark: SparkSession, path: str) -> DataFrame:
    """The entries with their vectors; ``part`` prunes reads of few genes."""
    return spark.read.schema(STORE).parquet(f"{path}/rows")


def upsert_index(entries: DataFrame, path: str, embedder, parts: int = PARTS) -> int:
    """Assign the entries (key, gene_id, gene_name, idx, type, text; one for each (gene_id, idx)) in the store.

    Returns how many were embedded; with none, nothing is written.
    """
    spark = entries.sparkSession
    known = _layout(spark, path)
    parts = known or parts
    new = entries.select("*", _digest(embedder.name).alias("digest"), _part(parts).alias("part"))
    if known is not None:
        stored = read_index_store(spark, path)
        old = stored.select("gene_id", "idx", "digest")
        new = new.join(old, _same_key(new, old) & (new["digest"] == old["digest"]), "left_anti")
    # The model's work is written before it is used, so it is done once.
    scratch = scratch_path(spark, "index-changed")
    embed(new, "text", embedder).write.parquet(scratch)
    changed = spark.read.parquet(scratch)
    touched = [r["part"] for r in changed.select("part").distinct().collect()]  # at most ``parts`` numbers
    if not touched:
        if known is None:
            _write(changed, path, parts)
        return 0
    rows = changed.select(*COLUMNS, "part")
    if known is not None:
        here = stored.where(F.col("part").isin(touched)).select(*COLUMNS, "part")
        rows = here.join(changed.select("gene_id", "idx"), _same_key(here, changed), "left_anti").unionByName(rows)
    _write(rows, path, parts)
    return changed.count()


def _write(rows: DataFrame, path: str, parts: int) -> None:
    """Replace the parts that have rows; the layout is written before the first of them."""
    spark = rows.sparkSession
    if _layout(spark, path) is None:
        spark.createDataFrame([(parts,)], "parts int").write.mode("overwrite").parquet(f"{path}/layout")
    (rows.select(*COLUMNS, "part").repartition("part").sortWithinPartitions("part", "gene_id", "idx")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/rows"))
