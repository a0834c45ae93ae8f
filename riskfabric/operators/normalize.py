"""Row-wise normalisers: raw signals, inventory rows and device messages to common shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Normalizer = Callable[[DataFrame], DataFrame]

# Asset type, event type per signal source.
SOURCE_SHAPES = {
    "github": ("software", "repo", "commit_scan"),
    "pypi": ("software", "package", "vulnerability"),
    "npm": ("software", "package", "sbom"),
    "network_scanner": ("ipv4-addr", "ip_address", "port_scan"),
}

# Penalty per vulnerability severity.
SEVERITY_PENALTY = {"CRITICAL": 30, "HIGH": 20, "MEDIUM": 10}
REPORT_PENALTY = 15
WIDE_SBOM_PENALTY = 5
WIDE_SBOM_DEPENDENCIES = 30
DEFAULT_RATING = 70

_REGISTRY: dict[str, Normalizer] = {}


def register_normalizer(source: str, fn: Normalizer) -> None:
    """Plug-in point: a source name and a DataFrame -> DataFrame normaliser."""
    _REGISTRY[source] = fn


def normalizer_for(source: str) -> Normalizer:
    return _REGISTRY.get(source, normalize_signals)


def _by_source(pick: Callable[[tuple[str, str, str]], Column], default: Column) -> Column:
    out = None
    for source, shape in SOURCE_SHAPES.items():
        cond = F.col("source") == source
        out = F.when(cond, pick(shape)) if out is None else out.when(cond, pick(shape))
    return out.otherwise(default)


def normalize_signals(df: DataFrame) -> DataFrame:
    """Map any raw signal to asset type, value, event type and severity by its source."""
    package = F.col("source").isin("pypi", "npm")
    severity = F.when(package, F.lower(F.coalesce("severity", F.lit("unknown")))).otherwise(F.lit("info"))
    return df.withColumns(
        {
            "asset_type": _by_source(lambda s: F.lit(s[0]), F.lit("unknown")),
            "value": _by_source(lambda s: F.col(s[1]), F.lit("unknown")),
            "event_type": _by_source(lambda s: F.lit(s[2]), F.lit("generic_signal")),
            "norm_severity": severity,
            "enriched": F.lit(True),
        }
    )


def normalize_hosts(df: DataFrame, host: str = "host", ip: str = "ip") -> DataFrame:
    """Host inventory rows to assets; the address property exists only when present."""
    name = F.coalesce(F.col(host), F.lit("unknown-host"))
    present = F.length(F.coalesce(F.col(ip), F.lit(""))) > 0
    base = F.create_map(F.lit("source"), F.lit("splunk"), F.lit("os"), F.col("os"), F.lit("mac"), F.col("mac"))
    return df.select(
        F.concat(F.lit("asset--splunk--"), name).alias("id"),
        F.lit("host").alias("type"),
        name.alias("value"),
        F.concat(F.lit("Splunk Host: "), name).alias("name"),
        F.when(present, F.map_concat(base, F.create_map(F.lit("ip_address"), F.col(ip)))).otherwise(base).alias("properties"),
    )


def normalize_resources(df: DataFrame, resource_id: str = "resource_id", name: str = "name") -> DataFrame:
    """Cloud resource rows to assets; slashes in the identifier become dashes."""
    rid = F.coalesce(F.col(resource_id), F.lit("unknown-resource"))
    label = F.coalesce(F.col(name), F.lit("Unknown Azure Resource"))
    return df.select(
        F.concat(F.lit("asset--sentinel--"), F.replace(rid, F.lit("/"), F.lit("-"))).alias("id"),
        F.lit("cloud-resource").alias("type"),
        rid.alias("value"),
        F.concat(F.lit("Azure Resource: "), label).alias("name"),
        F.create_map(
            F.lit("source"), F.lit("microsoft_sentinel"), F.lit("azure_type"), F.col("azure_type"),
            F.lit("location"), F.col("location"),
        ).alias("properties"),
    )


def normalize_users(df: DataFrame) -> DataFrame:
    """Directory rows: the account-disabled bit (2) of the flags, groups never null."""
    return df.select(
        "dn", "cn", "username", "upn",
        F.coalesce("groups", F.array().cast("array<string>")).alias("groups"),
        F.coalesce(F.col("flags").bitwiseAND(F.lit(2)) != 0, F.lit(False)).alias("is_disabled"),
    )


def parse_device_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Keep topic and qos, decode the JSON payload; messages that are not JSON are dropped."""
    decoded = df.withColumn("_v", F.try_parse_json(F.col(payload))).filter(F.col("_v").isNotNull())
    return decoded.withColumnRenamed("_v", "decoded")


def explode_registers(df: DataFrame, data: str = "data", start: str = "start_address") -> DataFrame:
    """One row per holding register; address = start address + position."""
    keep = [c for c in df.columns if c != data]
    return df.select(*keep, F.posexplode(data).alias("position", "register_value")).withColumn(
        "address", F.col(start) + F.col("position")
    )


def purl(name: Column, version: Column, given: Column | None = None, kind: str = "generic") -> Column:
    """Package URL: the given one, else built from kind, name and version (datasets carry no version)."""
    built = F.concat(F.lit(f"pkg:{kind}/"), name)
    if kind != "dataset":
        built = F.concat(built, F.lit("@"), version)
    return built if given is None else F.coalesce(given, built)


def first_present(*cols: str, default: str) -> Column:
    """First non-empty value; an empty string counts as missing."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(default))


def entity_name() -> Column:
    return first_present("repo", "package", "actor", default="Unknown_Entity")


def rating_tier(score: Column) -> Column:
    return F.when(score > 80, "Low").when(score > 60, "Medium").otherwise("High")


def signal_penalty() -> Column:
    by_severity = F.lit(0)
    for name, value in SEVERITY_PENALTY.items():
        by_severity = F.when(F.col("severity") == name, value).otherwise(by_severity)
    return (
        F.when(F.col("type") == "vulnerability", by_severity)
        .when(F.col("type") == "report", REPORT_PENALTY)
        .when(
            (F.col("type") == "sbom") & (F.coalesce("dependencies_count", F.lit(0)) > WIDE_SBOM_DEPENDENCIES),
            WIDE_SBOM_PENALTY,
        )
        .otherwise(0)
    )


def adjusted_score(base: Column | None = None) -> Column:
    """External rating (70 when unknown) less the penalty of the signal, never below zero."""
    rating = F.lit(DEFAULT_RATING) if base is None else F.coalesce(base, F.lit(DEFAULT_RATING))
    return F.greatest(F.lit(0), rating - signal_penalty())


def salted_hash(col: Column, salt: str) -> Column:
    """sha256(value + salt); null and empty values stay as they are."""
    return F.when(F.length(col) > 0, F.sha2(F.concat(col, F.lit(salt)), 256)).otherwise(col)


def redact_author(col: Column) -> Column:
    return F.when(F.contains(col, F.lit("@")), F.lit("REDACTED_PII")).otherwise(col)


def minimize(df: DataFrame, salt: str, hashed: tuple[str, ...] = (), authors: tuple[str, ...] = ()) -> DataFrame:
    """Hash identifying columns and redact authors that hold a mail address."""
    changes = {c: salted_hash(F.col(c), salt) for c in hashed}
    changes.update({c: redact_author(F.col(c)) for c in authors})
    return df.withColumns(changes)


def minimize_components(components: Column) -> Column:
    """The author rule applied inside an array of component structs."""
    return F.transform(components, lambda c: c.withField("author", redact_author(c["author"])))


def redact_params(params: Column, secret_keys: tuple[str, ...] = ("api_key",)) -> Column:
    return F.transform_values(
        params, lambda k, v: F.when(k.isin(*secret_keys), F.lit("***REDACTED***")).otherwise(v)
    )


def sanitize(col: Column, limit: int = 1024) -> Column:
    return F.substring(F.coalesce(col.cast("string"), F.lit("")), 1, limit)


def in_time_window(ts: Column, start: Column, end: Column) -> Column:
    """Time of day inside [start, end], also across midnight; an open bound is the day's edge."""
    now = F.date_format(ts, "HH:mm:ss")
    lo, hi = F.coalesce(start, F.lit("00:00:00")), F.coalesce(end, F.lit("23:59:59"))
    return F.when(lo <= hi, (now >= lo) & (now <= hi)).otherwise((now >= lo) | (now <= hi))


def backoff(attempt: Column, jitter: float = 0.0, seed: int | None = None, cap: float | None = 60.0) -> Column:
    """2^attempt plus uniform jitter as a share of the base, optionally capped."""
    base = F.pow(F.lit(2.0), attempt)
    delay = base if jitter == 0 else base + F.rand(seed) * jitter * base
    return delay if cap is None else F.least(delay, F.lit(cap))


for _source in SOURCE_SHAPES:
    register_normalizer(_source, normalize_signals)
