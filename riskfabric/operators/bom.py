"""Bills of materials: component (CycloneDX, SPDX), provenance and model documents to flat rows.

Documents are parsed once to VARIANT and read by path, so a field of the wrong kind is null, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.operators.normalize import sanitize

BAD_SIGNATURE = "bad-signature"
SIGNATURE_ERROR = "Invalid cryptographic signature in provenance."


def _get(doc: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, path, kind)


def _kind(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc), F.lit("VOID"))


def _is_object(doc: Column) -> Column:
    return _kind(doc).startswith("OBJECT")


def _named(doc: Column, key: str, default: str) -> Column:
    """Text of a field; the default when the key is absent, empty text when it is an explicit null."""
    found = _get(doc, f"$['{key}']", "variant")
    return F.when(found.isNull(), F.lit(default)).otherwise(sanitize(_get(doc, f"$['{key}']")))


def _optional(doc: Column, key: str) -> Column:
    value = _get(doc, f"$['{key}']")
    return F.when(value.isNotNull(), sanitize(value))


def _key(value: Column) -> Column:
    """Text that is joined on: like `sanitize`, but whole, since two keys with an equal beginning are not equal."""
    return F.coalesce(value.cast("string"), F.lit(""))


def _whole(doc: Column, key: str) -> Column:
    value = _get(doc, f"$['{key}']")
    return F.when(value.isNotNull(), _key(value))


def parse_sbom(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Format, spec version, serial and vendor per document; `error` when it is no JSON object."""
    parsed = df.withColumn("_v", F.try_parse_json(payload))
    v = F.col("_v")
    bom_format = _get(v, "$.bomFormat")
    text_format = _kind(_get(v, "$.bomFormat", "variant")) == "STRING"
    fmt = (
        F.when(~_is_object(v), F.lit(None))
        .when(text_format & (F.lower(bom_format) == "cyclonedx"), "CycloneDX")
        .when(_get(v, "$.spdxVersion", "variant").isNotNull(), "SPDX")
        .otherwise("Unknown"))
    with_format = parsed.withColumn("format", fmt)
    meta = _get(v, "$.metadata.component", "variant")
    by = lambda a, b, c: F.when(F.col("format") == "CycloneDX", a).when(F.col("format") == "SPDX", b).otherwise(c)
    return with_format.withColumns({
        "spec_version": by(_named(v, "specVersion", "unknown"), _named(v, "spdxVersion", "unknown"), F.lit("Unknown")),
        "serial_number": by(_optional(v, "serialNumber"), _optional(v, "documentNamespace"), F.lit(None).cast("string")),
        "vendor": by(F.when(_is_object(meta), _named(meta, "name", "Unknown Vendor")).otherwise("Unknown Vendor"),
                     _named(v, "name", "Unknown Vendor"), _named(v, "vendor", "Unknown")),
        "error": F.when(F.col("format").isNull(), F.lit("Payload must be a dictionary")),
    })


def _elements(doc: Column, key: str) -> Column:
    """Object elements of a list field; anything else counts as an empty list."""
    items = F.coalesce(_get(doc, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, _is_object)


def sbom_components(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per component of every well-formed document."""
    docs = parse_sbom(df, payload).filter(F.col("error").isNull())
    items = F.when(F.col("format") == "CycloneDX", _elements(F.col("_v"), "components")).when(
        F.col("format") == "SPDX", _elements(F.col("_v"), "packages"))
    keep = [c for c in docs.columns if c not in ("_v", "error", payload)]
    rows = docs.select(*keep, F.explode(items).alias("_c"))
    c = F.col("_c")
    cyclone = F.col("format") == "CycloneDX"
    supplier_object = _get(c, "$.supplier", "variant")
    supplier = F.when(_is_object(supplier_object), _get(c, "$.supplier.name")).when(
        _kind(supplier_object) == "STRING", _get(c, "$.supplier"))
    refs = F.filter(_elements(c, "externalRefs"), lambda r: _get(r, "$.referenceType") == "purl")
    spdx_purl = F.when(F.size(refs) > 0, _key(_get(F.try_element_at(refs, F.lit(1)), "$.referenceLocator")))
    cyclone_purl = _get(c, "$['purl']")
    return rows.select(
        *keep,
        _named(c, "name", "unknown").alias("name"),
        F.when(cyclone, _named(c, "version", "0.0.0")).otherwise(_named(c, "versionInfo", "0.0.0")).alias("version"),
        F.when(cyclone, F.when(cyclone_purl.isNotNull(), _key(cyclone_purl))).otherwise(spdx_purl).alias("purl"),
        F.when(cyclone, _optional(c, "bom-ref")).otherwise(_optional(c, "SPDXID")).alias("bom_ref"),
        F.when(cyclone, F.nullif(sanitize(supplier), F.lit(""))).otherwise(_optional(c, "supplier")).alias("supplier"))


def validate_provenance(df: DataFrame, payload: str = "provenance") -> DataFrame:
    """has_provenance, signature_verified, slsa_level, builder_id; `error` for a bad signature."""
    parsed = df.withColumn("_v", F.try_parse_json(payload))
    v = F.col("_v")
    given = _is_object(v) & (_kind(v) != "OBJECT<>")
    rejected = F.coalesce(_get(v, "$.signature") == BAD_SIGNATURE, F.lit(False))
    predicate = _get(v, "$.predicate", "variant")
    is_slsa = F.contains(F.lower(F.coalesce(_get(v, "$.predicateType"), F.lit(""))), F.lit("slsa"))
    build_type = F.lower(F.coalesce(_get(predicate, "$.buildType"), F.lit("")))
    text_type = _get(predicate, "$.buildType", "variant").isNull() | (_kind(_get(predicate, "$.buildType", "variant")) == "STRING")
    builder = _get(predicate, "$.builder", "variant")
    has_builder = builder.isNotNull() & ~_kind(builder).isin("VOID", "OBJECT<>") & F.coalesce(_get(predicate, "$.builder") != "", F.lit(True))
    level = F.when(
        given & is_slsa & _is_object(predicate) & text_type & (F.contains(build_type, F.lit("slsa")) | has_builder), 3)
    ok = given & ~rejected
    return parsed.withColumns({
        "has_provenance": ok, "signature_verified": ok, "slsa_level": F.when(ok, level),
        "builder_id": F.when(ok, _get(predicate, "$.builder.id")),
        "error": F.when(given & rejected, F.lit(SIGNATURE_ERROR)),
    }).drop("_v")


def parse_mbom(df: DataFrame, key: str, payload: str = "payload") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, their datasets and their dependencies from model documents."""
    docs = df.select(F.col(key), F.try_parse_json(payload).alias("_v")).filter(_is_object(F.col("_v")))
    v = F.col("_v")
    arch = _get(v, "$.architecture", "variant")
    ok = _is_object(arch)

    def either(doc: Column, first: str, second: str, kind: str) -> Column:
        """First value that is neither missing, zero nor empty."""
        a = _get(doc, f"$.{first}", kind)
        usable = a.isNotNull() & (a != (F.lit("") if kind == "string" else F.lit(0)))
        return F.when(usable, a).otherwise(_get(doc, f"$.{second}", kind))

    named_model = _get(v, "$.model_name", "variant").isNotNull()
    models = docs.select(
        key, F.when(named_model, sanitize(_get(v, "$.model_name"))).otherwise(_named(v, "name", "unknown_model")).alias("model_name"),
        _named(v, "version", "0.0.0").alias("version"),
        F.when(ok, _named(arch, "name", "unknown_arch")).otherwise("unknown_arch").alias("architecture"),
        F.when(ok, either(arch, "parameters_count", "parameters", "bigint")).alias("parameters_count"),
        F.when(ok, either(arch, "layers_count", "layers", "bigint")).alias("layers_count"),
        F.when(ok, _named(arch, "framework", "PyTorch")).otherwise("PyTorch").alias("framework"),
        F.coalesce(_get(v, "$.signature_verified", "boolean"), F.lit(False)).alias("signature_verified"))
    d = F.col("_d")
    datasets = docs.select(key, F.explode(_elements(v, "datasets")).alias("_d")).select(
        key, _named(d, "name", "unknown_dataset").alias("name"), _get(d, "$.size_gb", "double").alias("size_gb"),
        _optional(d, "license").alias("license"), either(d, "hash_sha256", "hash", "string").alias("hash_sha256"),
        _optional(d, "source_url").alias("source_url"))
    dependencies = docs.select(key, F.explode(_elements(v, "dependencies")).alias("_d")).select(
        key, F.when(F.length(F.coalesce(_get(d, "$.package_name"), F.lit(""))) > 0, sanitize(_get(d, "$.package_name")))
        .otherwise(_named(d, "name", "unknown")).alias("package_name"),
        _named(d, "version", "0.0.0").alias("version"), _whole(d, "purl").alias("purl"), _optional(d, "license").alias("license"))
    return models, datasets, dependencies
