"""Sections of fused signals as graph rows: SBOM components, AI models and binary reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.operators.risk import exploit_severity


def _node(ident: Column, label: str, **values: Column) -> list[Column]:
    known = {"exploit_score": "double", "severity": "string", "signature_verified": "boolean", "is_malicious": "boolean"}
    return [ident.alias("id"), F.lit(label).alias("label"), *[values.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in known.items()]]


def _edge(src: Column, dst: Column, kind: str, source: Column | None = None) -> list[Column]:
    return [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (source if source is not None else F.lit(None)).cast("string").alias("source")]


def _identity() -> Column:
    return F.concat(F.lit("Identity:"), "entity")


def component_rows(components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of SBOM components: entity, name, version, purl, format, cves array<string>, exploit_score.

    A component is DEVELOPED by its entity; score and severity are set where it has vulnerabilities, to which it is linked.
    """
    purl = F.coalesce("purl", F.concat(F.lit("pkg:generic/"), F.coalesce("name", F.lit("unknown")), F.lit("@"), F.coalesce("version", F.lit("0.0.0"))))
    rows = components.withColumn("_c", F.concat(F.lit("SoftwareComponent:"), purl))
    hit = F.size(F.coalesce("cves", F.array().cast("array<string>"))) > 0
    found = rows.select("_c", F.explode("cves").alias("cve")).withColumn("_v", F.concat(F.lit("Vulnerability:"), "cve"))
    nodes = rows.select(_node(_identity(), "Identity")).unionByName(rows.select(_node(
        F.col("_c"), "SoftwareComponent", exploit_score=F.when(hit, F.col("exploit_score")), severity=F.when(hit, exploit_severity(F.col("exploit_score")))))).unionByName(
        found.select(_node(F.col("_v"), "Vulnerability")))
    edges = rows.select(_edge(_identity(), F.col("_c"), "DEVELOPED", F.col("format"))).unionByName(
        found.select(_edge(F.col("_c"), F.col("_v"), "HAS_VULNERABILITY")))
    return nodes, edges


def model_rows(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of MBOMs: entity, model_name, version, signature_verified, datasets array<struct<name>>, and
    dependencies array<struct<package_name, version, purl>>."""
    rows = models.withColumn("_m", F.concat(F.lit("AIModel:pkg:ml/"), F.coalesce("model_name", F.lit("unknown_model")), F.lit("@"), F.coalesce("version", F.lit("0.0.0"))))
    sets = rows.select("_m", F.explode("datasets").alias("d")).select("_m", F.concat(F.lit("Dataset:pkg:dataset/"), "d.name").alias("_d"))
    deps = rows.select("_m", F.explode("dependencies").alias("d")).select("_m", F.concat(F.lit("SoftwareComponent:"), F.coalesce(
        "d.purl", F.concat(F.lit("pkg:generic/"), "d.package_name", F.lit("@"), "d.version"))).alias("_c"))
    nodes = rows.select(_node(_identity(), "Identity")).unionByName(
        rows.select(_node(F.col("_m"), "AIModel", signature_verified=F.coalesce("signature_verified", F.lit(False))))).unionByName(
        sets.select(_node(F.col("_d"), "Dataset"))).unionByName(deps.select(_node(F.col("_c"), "SoftwareComponent")))
    edges = rows.select(_edge(_identity(), F.col("_m"), "DEVELOPED", F.lit("MBOM"))).unionByName(
        sets.select(_edge(F.col("_m"), F.col("_d"), "TRAINED_ON"))).unionByName(deps.select(_edge(F.col("_m"), F.col("_c"), "DEPENDS_ON")))
    return nodes, edges


def report_rows(reports: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of binary reports: target_purl, hash, is_malicious. A report hangs on the component of its target, else on
    the model, else on nothing."""
    rows = reports.withColumn("_r", F.concat(F.lit("BinaryAnalysisReport:report:binary/"), "hash"))
    targets = nodes.filter(F.col("label").isin("SoftwareComponent", "AIModel")).select(
        F.substring_index("id", ":", 1).alias("_kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("_purl"), "id").groupBy("_purl").agg(
        F.max_by("id", "_kind").alias("_owner"))  # SoftwareComponent is the later name
    linked = rows.select("_r", "target_purl").join(targets, F.col("target_purl") == F.col("_purl"))
    return rows.select(_node(F.col("_r"), "BinaryAnalysisReport", is_malicious=F.col("is_malicious"))), linked.select(
        _edge(F.col("_owner"), F.col("_r"), "HAS_ANALYSIS_REPORT"))


def fold_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node; of several values of a property the largest, in one aggregate that combines map-side."""
    return nodes.groupBy("id", "label").agg(*[F.max(c).alias(c) for c in nodes.columns if c not in ("id", "label")])
