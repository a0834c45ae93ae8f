"""Text operators: CVE and actor extraction, secret and unsafe-code scans, requirement lines, tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, names and advisory ranges.
CVE_PATTERN = r"CVE-\d{4}-\d{4,7}"
ACTORS = ("APT29", "Lazarus", "Equation Group", "Sandworm")
SECRET_PATTERNS = (
    r'(?i)(password|passwd|secret|api_key|token|auth_token|vault_token|private_key)\s*=\s*["\'][a-zA-Z0-9_\-\.\:\/\+\=\%]{8,}["\']',
    r'(?i)(aws_access_key_id|aws_secret_access_key)\s*=\s*["\'][a-zA-Z0-9_\-\.\:\/\+\=]{10,}["\']',
)
LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SECRET_EXEMPT = ("example", "localhost", "test")
UNSAFE_PATTERNS = {
    "eval_usage": r"\beval\s*\(",
    "exec_usage": r"\bexec\s*\(",
    "shell_true": r"shell\s*=\s*True",
    "unsecured_temp": r"tempfile\.mktemp\(",
}
ADVISORIES = {"pyjwt": "<2.8.0", "urllib3": "<1.26.17", "requests": "<2.31.0", "hvac": "<1.1.0"}
MESSAGE_ACTIONS = (
    (("Resolved", "SBOM"), "Discovery step completed."),
    (("Risk Level",), "Risk assessment performed."),
    (("mitigation plan",), "Remediation triggered."),
    (("Compliance verified",), "Compliance check passed."),
)


def extract_cves(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CVE_PATTERN), F.lit(0)))


def extract_actors(text: Column, names: tuple[str, ...] = ACTORS) -> Column:
    """Names found anywhere in the text, case-insensitive. The gazetteer is short, so it is unrolled."""
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(n.lower())), F.lit(n)) for n in names]))


def lines_of(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(F.split(F.col(text), LINE_BREAK, -1)).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line"
    )


def scan_secrets(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per (line, pattern) hit; lines that mention an exempt word are skipped.

    The document is tested as a whole first, so only documents with a hit are split into lines. Both patterns
    need an equals sign, which is cheaper to look for than the patterns.
    """
    any_hit = F.lit(False)
    for pattern in SECRET_PATTERNS:
        any_hit = any_hit | F.col(text).rlike(pattern)
    lines = lines_of(df.filter(F.contains(F.col(text), F.lit("=")) & any_hit), text, keep)
    exempt = F.lit(False)
    for word in SECRET_EXEMPT:
        exempt = exempt | F.contains(F.lower("line"), F.lit(word))
    kinds = F.array_compact(
        F.array(*[F.when(F.col("line").rlike(p), F.lit(i + 1)) for i, p in enumerate(SECRET_PATTERNS)])
    )
    return lines.filter(~exempt).select(
        *keep, "line_no", F.explode(kinds).alias("pattern_no"), F.substring(F.trim("line"), 1, 60).alias("excerpt")
    )


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def match_lines(text: Column, pattern: str) -> Column:
    """Line number in which each match of the pattern starts; matches may run over a line end."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches,
        lambda before, hit: F.struct(_newlines(before).alias("a"), _newlines(hit).alias("b")),
    )
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(
        steps, start,
        lambda acc, s: F.struct(
            (acc["at"] + s["a"] + s["b"]).alias("at"),
            F.concat(acc["found"], F.array(acc["at"] + s["a"])).alias("found"),
        ),
        lambda acc: acc["found"],
    )


def scan_unsafe(df: DataFrame, text: str, keep: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per match of an unsafe pattern with its line number."""
    patterns = patterns or UNSAFE_PATTERNS
    any_hit = F.lit(False)
    for pattern in patterns.values():
        any_hit = any_hit | F.col(text).rlike(pattern)
    found = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.when(F.col(text).rlike(pattern), match_lines(F.col(text), pattern)).alias("found"))
        for kind, pattern in patterns.items()
    ])
    return df.filter(any_hit).select(*keep, F.inline(found)).select(*keep, "kind", F.explode("found").alias("line_no"))


def parse_requirements(df: DataFrame, line: str) -> DataFrame:
    """Package and version of each requirement line; comments, blanks and unpinned lines drop out."""
    text = F.trim(F.col(line))
    parts = F.split(text, "==|>=|<=|<|>")
    return (
        df.filter((F.length(text) > 0) & ~text.startswith("#"))
        .withColumn("_parts", parts)
        .filter(F.size("_parts") >= 2)
        .withColumns({"package": F.lower(F.trim(F.col("_parts")[0])), "version": F.trim(F.col("_parts")[1])})
        .drop("_parts")
    )


def version_key(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def audit_requirements(df: DataFrame, advisories: DataFrame) -> DataFrame:
    """Requirement rows on an advisory's package; `below_fix` tells whether the version lies in its range `affected`, like `<2.8.0`."""
    fixed_in = F.trim(F.regexp_replace("affected", "^<", ""))
    return df.join(advisories, "package").withColumn("fixed_in", fixed_in).withColumn(
        "below_fix", version_key(F.col("version")) < version_key(F.col("fixed_in"))
    )


def tag_messages(text: Column) -> Column:
    tags = [
        F.when(_any_contains(text, words), F.lit(label)) for words, label in MESSAGE_ACTIONS
    ]
    return F.array_distinct(F.array_compact(F.array(*tags)))


def _any_contains(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def needs_approval(cascade: Column) -> Column:
    return cascade > 0.8
