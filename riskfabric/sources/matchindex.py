"""A fitted inventory on files: first candidates by key, term weights, vectors. Built once per inventory version, probed by many batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.functions.tfidf import char_wb
from riskfabric.operators import match
from riskfabric.session import cut
from riskfabric.sources.graphstore import Manifests

TABLES = ("by_value", "by_cert", "first", "idf", "vectors")


class MatchIndex:
    """The index of one version. `match` gives what `match.match_assets` gives against the inventory it was built from."""

    def __init__(self, spark: SparkSession, version: int, folder: str, remainder: float, schemas: dict[str, str]) -> None:
        self.version, self.remainder = version, remainder
        self.tables = {t: spark.read.schema(schemas[t]).parquet(f"{folder}/{t}") for t in TABLES}

    @classmethod
    def build(cls, internal: DataFrame, root: str, threshold: float = match.THRESHOLD) -> MatchIndex:
        """Fits the inventory, writes the tables to a fresh folder and commits them as the next version; readers see all or nothing."""
        spark = internal.sparkSession
        remainder = match.REMAINDER * threshold
        corpus = cut(match.candidate_texts(internal))
        idf, vectors = match.fitted(corpus, char_wb())
        by_value, by_cert = match.exact_keys(internal)
        folder, schemas = f"{root}/files/{uuid.uuid4().hex}", {}
        for name, table in zip(TABLES, (by_value, by_cert, corpus.select("c", "first"), idf, vectors)):
            table.write.parquet(f"{folder}/{name}")
            schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        log = Manifests(spark, f"{root}/versions")
        while True:
            version = log.newest()["version"] + 1
            if log.commit({"version": version, "folder": folder, "remainder": remainder, "schemas": schemas}):
                return cls(spark, version, folder, remainder, schemas)

    @classmethod
    def newest(cls, spark: SparkSession, root: str) -> MatchIndex:
        held = Manifests(spark, f"{root}/versions").newest()
        if "folder" not in held:
            raise FileNotFoundError(f"{root} holds no index")
        return cls(spark, held["version"], held["folder"], held["remainder"], held["schemas"])

    def match(self, ext: DataFrame, threshold: float = match.THRESHOLD) -> DataFrame:
        """Exact match first, fuzzy for the rest. The threshold must not lie below the one the index was built for."""
        if threshold < self.remainder / match.REMAINDER - 1e-12:
            raise ValueError("the index was built for a higher threshold")
        t = self.tables
        exact = cut(match.match_keys(ext, t["by_value"], t["by_cert"]))
        rest = ext.join(exact.select(F.col("ext_id").alias("id")), "id", "left_anti")
        fuzzy = match.best_match(rest, t["first"], t["idf"], t["vectors"], threshold, self.remainder)
        return exact.withColumn("method", F.lit("exact")).unionByName(fuzzy.withColumn("method", F.lit("fuzzy")))
