"""Reconciliation of declared state with actual state: which rows to create, update or leave, and the new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matched(declared: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """declared with `_exists` and `_differs` (null-safe) against the actual row of the same key."""
    there = actual.select(*[F.col(k) for k in keys], *[F.col(f).alias(f"_actual_{f}") for f in fields], F.lit(True).alias("_exists"))
    joined = declared.join(there, keys, "left")
    differs = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_actual_{f}")) for f in fields], F.lit(False))
    return joined.withColumn("_exists", F.coalesce("_exists", F.lit(False))).withColumn("_differs", differs)


def new_state(declared: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Declared rows, and the actual rows that nothing declares: never a deletion."""
    return declared.unionByName(actual.join(declared.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def reconcile_teams(declared: DataFrame, actual: DataFrame, fields: list[str], key: str = "team_id") -> DataFrame:
    """(key, action): create what is missing, update what exists to the declared fields, every time."""
    action = F.when(F.col("_exists"), "updated").otherwise("created")
    return _matched(declared, actual, [key], fields).select(key, action.alias("action"))


def key_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def salted_key_hash(value: Column, salt: str) -> Column:
    """What a stored key is compared by: the salt is digested first, its digest joined to the key, and both digested."""
    return F.sha2(F.concat(value, F.sha2(F.lit(salt), 256)), 256)


def display_key(value: Column) -> Column:
    return F.concat(F.left(value, F.lit(6)), F.lit("..."), F.right(value, F.lit(4)))


def reconcile_keys(declared: DataFrame, actual: DataFrame, salt: str | None = None, prefix: str = "sk-") -> DataFrame:
    """declared (team_id, value) against actual (key_hash): only hash and display form leave this function."""
    value = F.col("value")
    hashed = salted_key_hash(value, salt) if salt is not None else key_hash(value)
    known = actual.select("key_hash", F.lit(True).alias("_exists")).distinct()
    joined = declared.select(
        "team_id", hashed.alias("key_hash"), display_key(value).alias("display"), F.startswith(value, F.lit(prefix)).alias("_ok")
    ).join(known, "key_hash", "left")
    action = F.when(~F.col("_ok"), "refused").when(F.col("_exists"), "updated").otherwise("created")
    return joined.select("team_id", "key_hash", "display", action.alias("action"))


def conditional_upsert(declared: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, action): created, updated when a field differs (null-safe), unchanged otherwise."""
    action = F.when(~F.col("_exists"), "created").when(F.col("_differs"), "updated").otherwise("unchanged")
    return _matched(declared, actual, keys, fields).select(*keys, action.alias("action"))


def reconcile_prices(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Price definitions by (project, alias): created, replaced when pattern or price changed, skipped when equal.

    `managed` rows of actual belong to someone else and are never compared.
    """
    own = actual.where(~F.col("managed"))
    actions = conditional_upsert(declared, own, ["project", "alias"], ["pattern", "price_in", "price_out"])
    return actions.withColumn("action", F.when(F.col("action") == "updated", "replaced").when(F.col("action") == "unchanged", "skipped").otherwise(F.col("action")))


def reconcile_memberships(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(org, account) with the role set on every run: what someone changed by hand goes back to the declared one."""
    matched = _matched(declared, actual, ["org", "account"], ["role"])
    return matched.select(
        "org", "account", "role", F.when(F.col("_exists"), "updated").otherwise("created").alias("action"),
        (F.col("_exists") & F.col("_differs")).alias("was_reset"),
    )


def config_agreement(expected: DataFrame, configured: DataFrame, fields: list[str], key: str = "team_id") -> DataFrame:
    """Teams whose route is missing or different in the other configuration."""
    matched = _matched(expected, configured, [key], fields)
    problem = F.when(~F.col("_exists"), "missing").when(F.col("_differs"), "different")
    return matched.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def declared_checks(declared: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Declared rows that break a rule; a rule is a name and the condition that must hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return declared.withColumn("reasons", F.array_join(broken, ",")).where("reasons <> ''")


def apply_actions(declared: DataFrame, actual: DataFrame, actions: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The state that actions (keys, action) leave: actual with the declared fields of the rows that are updated (or
    replaced), and the declared rows that are created.

    An action does what it says and no more: an update of a row that isn't there does nothing, a row created that is there
    already is written over, and rows without an action, or with another one, stay. Columns of actual besides keys and
    fields stay as they are, and are null in created rows that don't declare them. Keys are unique on each side.
    """
    written = declared.join(actions.select(*keys, "action"), keys).where("action IN ('created', 'updated', 'replaced')")
    fresh = written.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_written"))
    kept = actual.join(fresh, keys, "left").select(
        *[F.when(F.col("_written"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in actual.columns]
    )
    created = written.where("action = 'created'").drop("action").join(actual.select(*keys), keys, "left_anti")
    shared = [c for c in created.columns if c in actual.columns]
    return kept.unionByName(created.select(*shared), allowMissingColumns=True)


def second_run_is_noop(
    declared: DataFrame, actual: DataFrame, keys: list[str], fields: list[str], actions: DataFrame | None = None
) -> DataFrame:
    """Actions of a second run, on the state that the first one's actions (those of `conditional_upsert`, if none are given)
    leave when they are applied: nothing may be created or changed, unless an action was not right."""
    actions = conditional_upsert(declared, actual, keys, fields) if actions is None else actions
    state = apply_actions(declared, actual, actions, keys, fields)
    return conditional_upsert(declared, state, keys, fields).where("action <> 'unchanged'")
