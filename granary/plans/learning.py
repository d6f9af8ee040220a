"""What people decided about fields, mined for rules: aliases, paths, roles and columns to set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import label_key

# The kinds of variants.
ALIAS, PATH, ROLE = "alias", "header_path", "role_context"
CONTEXT = ["domain", "record_type", "observed_type", "unit"]
VARIANT = ["code", "kind", "alias", "header_path", "role", *CONTEXT]


def learned_variants(decisions: DataFrame, known: DataFrame | None = None, least: int = 1) -> DataFrame:
    """Variants of fields that decisions teach: VARIANT, support, conflicts, first_decision, first_item.

    decisions: decision_id, item_id, code, header_path, role, learn_alias, learn_path (boolean), domain, record_type, observed_type, unit. A
    decision teaches an alias; and its path, or with a role the path in that role; or the role alone. support counts the files that
    taught a variant, conflicts the other fields that the same label or path was taught for in its domain and
    record type. Variants that known holds (VARIANT), and those of fewer than least files, are left out. Blank aliases and
    empty paths teach nothing; decisions without a field neither.
    """
    none = F.lit(None).cast("string")
    no_path = F.lit(None).cast("array<string>")
    role = F.nullif(F.trim("role"), F.lit(""))
    path = F.when(F.size("header_path") > 0, F.col("header_path"))
    said = lambda kind, alias, path, role: F.struct(F.lit(kind).alias("kind"), alias.alias("alias"), path.alias("header_path"), role.alias("role"))
    alias = F.nullif(F.trim("learn_alias"), F.lit(""))
    by_path = F.coalesce("learn_path", F.lit(False)) & path.isNotNull()
    taught = F.array_compact(F.array(
        F.when(alias.isNotNull(), said(ALIAS, alias, no_path, none)),
        F.when(by_path & role.isNull(), said(PATH, none, path, none)).when(by_path, said(ROLE, none, path, role)).when(role.isNotNull(), said(ROLE, none, no_path, role)),
    ))
    each = decisions.filter("code is not null").select("decision_id", "item_id", "code", *CONTEXT, F.inline(taught))
    found = each.groupBy(*VARIANT).agg(F.countDistinct("item_id").alias("support"), F.min("decision_id").alias("first_decision"), F.min_by("item_id", "decision_id").alias("first_item"))
    # A label means one field where no other was taught it; labels are told apart as headers are.
    key = F.coalesce(label_key(F.col("alias")), label_key(F.array_join("header_path", " / ")))
    keyed = found.withColumn("key", key)
    same = ["key", "domain", "record_type"]
    rivals = keyed.filter("key <> ''").groupBy(*same).agg(F.countDistinct("code").alias("codes"))
    met = keyed.alias("v").join(rivals.alias("r"), (F.col("v.key") == F.col("r.key")) & F.col("v.domain").eqNullSafe(F.col("r.domain")) & F.col("v.record_type").eqNullSafe(F.col("r.record_type")), "left")
    full = met.select(*[F.col(f"v.{c}") for c in VARIANT], "support", (F.coalesce("codes", F.lit(1)) - 1).cast("long").alias("conflicts"), "first_decision", "first_item").filter(F.col("support") >= least)
    if known is None:
        return full
    held = known.select(F.struct(*VARIANT).alias("held")).distinct()
    return full.join(held, F.struct(*VARIANT).eqNullSafe(F.col("held")), "left_anti")


def ignore_rules(decisions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rules that set columns aside: rule_key, version, header_path, parent_path, domain, record_type, observed_type, reason, support, first_decision.

    decisions: also ignore_scope and ignore_reason. Only those for a whole context (scope context) make rules, and only with a reason; the first one's
    stands. rule_key is the SHA-256 of what the rule is for as JSON. Rules that known holds (rule_key) are left out.
    """
    identity = F.to_json(F.struct("domain", "header_path", F.col("observed_type").alias("observed_data_type"), "record_type"), {"ignoreNullFields": "false"})
    kept = decisions.filter((F.col("ignore_scope") == "context") & (F.trim(F.coalesce("ignore_reason", F.lit(""))) != "")).withColumn("rule_key", F.sha2(identity, 256))
    rules = kept.groupBy("rule_key", "header_path", "domain", "record_type", "observed_type").agg(F.min_by("ignore_reason", "decision_id").alias("reason"), F.countDistinct("item_id").alias("support"), F.min("decision_id").alias("first_decision"))
    rules = rules if known is None else rules.join(known.select("rule_key"), "rule_key", "left_anti")
    parent = F.slice("header_path", 1, F.greatest(F.size("header_path") - 1, F.lit(0)))
    return rules.select("rule_key", F.lit(1).alias("version"), "header_path", parent.alias("parent_path"), "domain", "record_type", "observed_type", "reason", "support", "first_decision")


def unreasoned(decisions: DataFrame) -> DataFrame:
    """decision_id of decisions that would set a context aside without a reason."""
    return decisions.filter((F.col("ignore_scope") == "context") & (F.trim(F.coalesce("ignore_reason", F.lit(""))) == "")).select("decision_id")


def next_versions(fields: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fields: code, version, published_version; variants: see learned_variants. The versions that variants make, published, and their variants.

    The first table has code, version, supersedes and variants (how many); the second code, version and VARIANT in a fixed order, ordinal from 1. A
    field without new variants, and variants of fields that aren't there, make none; a variant that conflicts waits for people.
    """
    sure = variants.filter("conflicts = 0")
    newest = fields.groupBy("code").agg(F.max("version").alias("last"), F.max("published_version").alias("supersedes"))
    made = sure.groupBy("code").agg(F.count(F.lit(1)).alias("variants")).join(newest, "code").select("code", (F.col("last") + 1).alias("version"), "supersedes", "variants")
    place = F.row_number().over(Window.partitionBy("code").orderBy("first_decision", "kind", "alias", F.to_json("header_path"), "role", *CONTEXT))
    return made, sure.withColumn("ordinal", place).join(made.select("code", "version"), "code").select("code", "version", "ordinal", *[c for c in VARIANT if c != "code"], "support")
