"""Fixed vocabularies and dimension tables. All values here are fixed by the data contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keyword families of titles and comments, (category, severity, keywords in order).
KEYWORD_FAMILIES = (
    ("security", "high", ("security", "vulnerability", "cve-", "xss", "sql injection", "csrf", "exploit")),
    ("bug", "medium", ("fix", "bug", "crash", "regression", "null pointer", "npe")),
    ("performance", "medium", ("performance", "perf", "slow", "optimi", "n+1")),
    ("testing", "low", ("test", "coverage", "spec")),
)
#: Licences that training may use.
ALLOWED_LICENSES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC")
#: File suffixes by language.
LANGUAGE_SUFFIXES = (
    ("typescript", (".ts", ".tsx", ".mts", ".cts")),
    ("javascript", (".js", ".jsx", ".mjs", ".cjs")),
    ("python", (".py", ".pyi")),
)
#: Package to technology.
TECHNOLOGIES = (
    ("@nestjs/common", "nestjs"),
    ("@nestjs/core", "nestjs"),
    ("express", "express"),
    ("fastify", "fastify"),
    ("prisma", "prisma"),
    ("@prisma/client", "prisma"),
    ("typeorm", "typeorm"),
    ("drizzle-orm", "drizzle-orm"),
    ("sequelize", "sequelize"),
    ("@mikro-orm/core", "mikro-orm"),
    ("knex", "knex"),
    ("kysely", "kysely"),
)
#: Fixed values: (rule id, version, category, severity, evidence kind, tags).
RULES = (
    ("javascript.console-log", "0.2.0", "maintainability", "low", "ast-call-expression", ("javascript", "typescript", "logging")),
    ("javascript.sql-injection", "0.1.0", "security", "high", "ast-call-expression", ("javascript", "typescript", "sql")),
    ("javascript.empty-catch-block", "0.1.0", "error-handling", "medium", "ast-catch-clause", ("javascript", "typescript", "error-handling")),
    ("javascript.loose-equality", "0.1.0", "maintainability", "low", "ast-binary-expression", ("javascript", "typescript", "maintainability")),
    ("javascript.dangerous-eval", "0.1.0", "security", "high", "ast-call-expression", ("javascript", "typescript", "security")),
    ("python.sql-injection", "0.1.0", "security", "high", "ast-call", ("python", "sql")),
    ("python.bare-except", "0.1.0", "error-handling", "medium", "ast-except-clause", ("python", "error-handling")),
    ("python.mutable-default-argument", "0.1.0", "bug", "high", "ast-default-parameter", ("python", "bug")),
    ("python.dangerous-eval", "0.1.0", "security", "high", "ast-call", ("python", "security")),
    ("python.debug-artifact", "0.1.0", "maintainability", "low", "ast-call", ("python", "maintainability")),
)
#: Closed vocabularies, best first where they are ordered.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("definite", "likely", "possible", "suggestion")
LANGUAGES = ("javascript", "typescript", "python")
SOURCE_TYPES = ("repository", "commit", "pull-request", "issue", "synthetic", "human-authored")
FILE_STATUSES = ("added", "removed", "renamed")
MODEL_STATUSES = ("planned", "in-progress", "trained", "evaluated", "released")
ADAPTER_TYPES = ("lora", "qlora", "full-finetune")
LICENSE_STATUSES = ("allowed", "review-required", "blocked", "unknown")
TAXONOMY_CATEGORIES = ("security", "database", "typescript-javascript", "nestjs", "architecture", "maintainability", "testing", "performance", "standards")


def literal_rows(spark: SparkSession, names: tuple[str, ...], rows) -> DataFrame:
    """A small table from literals, without Python rows in the plan."""

    def cell(v) -> Column:
        return F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)

    return spark.range(1).select(F.inline(F.array(*[F.struct(*[cell(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def rule_dimension(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, ("rule_id", "version", "category", "severity", "kind", "tags"), RULES)
