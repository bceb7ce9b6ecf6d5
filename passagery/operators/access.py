"""Tenants, roles and permissions as joins.

Requests name (user, knowledge base) pairs; roles are resolved for the pairs asked, never for all combinations.
The role table has a fixed handful of rows and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from passagery import constants as K
from passagery.functions import codes


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.ROLES, "role_id int, role_code string")


def with_role_codes(bindings: DataFrame, roles: DataFrame) -> DataFrame:
    return bindings.join(F.broadcast(roles.select("role_id", "role_code")), "role_id")


def super_users(bindings: DataFrame, roles: DataFrame) -> DataFrame:
    held = with_role_codes(bindings.filter(F.col("tenant_id") == K.SUPER_TENANT), roles)
    return held.filter(F.col("role_code") == "SUPER_ADMIN").select("user_id").distinct()


def flag_super(df: DataFrame, bindings: DataFrame, roles: DataFrame) -> DataFrame:
    flagged = super_users(bindings, roles).withColumn("is_super", F.lit(True))
    return df.join(flagged, "user_id", "left").withColumn("is_super", F.coalesce("is_super", F.lit(False)))


def effective_kb_roles(requests: DataFrame, kbs: DataFrame, bindings: DataFrame, roles: DataFrame, grants: DataFrame) -> DataFrame:
    """Role of each request's user on its knowledge base: super user, tenant administrator, a granted role, or none."""
    held = with_role_codes(bindings, roles).select("user_id", "tenant_id", F.col("role_code").alias("held_role"), "role_id")
    granted = with_role_codes(grants, roles).select("kb_id", F.col("role_code").alias("held_role")).distinct().withColumn("granted", F.lit(True))
    resolved = (
        flag_super(requests, bindings, roles)
        .join(kbs.select("kb_id", "tenant_id"), "kb_id", "left")
        .join(held.drop("role_id"), ["user_id", "tenant_id"], "left")
        .join(granted, ["kb_id", "held_role"], "left")
    )
    role = (
        F.when(F.col("is_super"), "SUPER_ADMIN").when(F.col("held_role") == "TENANT_ADMIN", "TENANT_ADMIN")
        .when(F.col("granted"), F.col("held_role")).otherwise(K.NO_ROLE)
    )
    return resolved.withColumn("kb_role", role).drop("held_role", "granted", "is_super", "tenant_id")


def tenant_roles(requests: DataFrame, bindings: DataFrame, roles: DataFrame) -> DataFrame:
    """Role per (user, tenant) asked; a super user is one everywhere."""
    held = with_role_codes(bindings, roles).select("user_id", "tenant_id", F.col("role_code").alias("held_role"))
    flagged = flag_super(requests, bindings, roles).join(held, ["user_id", "tenant_id"], "left")
    return flagged.withColumn("tenant_role", F.when(F.col("is_super"), "SUPER_ADMIN").otherwise(F.col("held_role"))).drop("held_role", "is_super")


def has_tenant_admin(users: DataFrame, bindings: DataFrame, roles: DataFrame) -> DataFrame:
    admin = F.col("role_code") == "TENANT_ADMIN"
    above = (F.col("role_code") == "SUPER_ADMIN") & (F.col("tenant_id") == K.SUPER_TENANT)
    any_admin = with_role_codes(bindings, roles).groupBy("user_id").agg(F.bool_or(admin | above).alias("is_admin"))
    return users.select("user_id").join(any_admin, "user_id", "left").withColumn("is_admin", F.coalesce("is_admin", F.lit(False)))


def allowed(action: str, role: Column, owner: Column | None = None, compat: bool = False) -> Column:
    """Whether a role may do `action`; an owner may always delete. `compat` refuses super users other than for viewing."""
    names = [r for r in K.ACTION_ROLES[action] if not (compat and r == "SUPER_ADMIN" and action != "view")]
    permitted = role.isin(names)
    return permitted | F.coalesce(owner, F.lit(False)) if owner is not None and action == "delete" else permitted


def authorize_all(requests: DataFrame, permitted: Column) -> DataFrame:
    """A request for several knowledge bases passes only when each of them does."""
    return requests.withColumn("ok", permitted).groupBy("request_id").agg(
        F.bool_and("ok").alias("permitted"), F.count(F.lit(1)).alias("n_kbs")
    )


def list_users(users: DataFrame, bindings: DataFrame, roles: DataFrame, tenants: DataFrame, tenant_id: int | None) -> DataFrame:
    """Users visible to an administrator of `tenant_id` (None: to a super user), with primary tenant and roles."""
    coded = with_role_codes(bindings, roles)
    place = F.struct("binding_id")
    info = coded.groupBy("user_id").agg(
        F.min_by("tenant_id", place).alias("tenant_id"), F.bool_or(F.col("tenant_id") == K.SUPER_TENANT).alias("is_super"),
        F.bool_or(F.col("tenant_id") == tenant_id if tenant_id is not None else F.lit(True)).alias("visible"),
        F.array_sort(F.collect_set(F.struct("role_id", "role_code"))).alias("held"),
    )
    seen = info if tenant_id is None else info.filter(F.col("visible") & ~F.col("is_super"))
    how = "left" if tenant_id is None else "inner"
    return (
        users.join(seen, "user_id", how).join(tenants.select("tenant_id", "tenant_name"), "tenant_id", "left")
        .withColumn("role_codes", F.array_join(F.transform("held", lambda r: r["role_code"]), ","))
        .drop("held", "visible", "is_super")
    )


def list_tenants(requests: DataFrame, bindings: DataFrame, roles: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants each asking user may see. A super user sees all of them: one row with `sees_all` stands for the list."""
    asking = flag_super(requests.select("user_id").distinct(), bindings, roles)
    own = bindings.filter(F.col("tenant_id") != K.SUPER_TENANT).select("user_id", "tenant_id").distinct()
    named = own.join(tenants.select("tenant_id", "tenant_name"), "tenant_id")
    plain = asking.filter(~F.col("is_super")).join(named, "user_id").select("user_id", "tenant_id", "tenant_name", F.lit(False).alias("sees_all"))
    above = asking.filter("is_super").select(
        "user_id", F.lit(None).cast("int").alias("tenant_id"), F.lit(None).cast("string").alias("tenant_name"), F.lit(True).alias("sees_all")
    )
    return plain.unionByName(above)


def tenants_for(user_id: int, bindings: DataFrame, roles: DataFrame, tenants: DataFrame) -> DataFrame:
    """The full list for one asking user."""
    mine = bindings.filter(F.col("user_id") == user_id)
    seen = list_tenants(mine, mine, roles, tenants)
    everything = tenants.filter(seen.agg(F.count_if("sees_all").alias("n")).scalar() > 0)
    return everything.unionByName(tenants.join(seen.filter("NOT sees_all"), "tenant_id", "left_semi"))


def list_roles(roles: DataFrame, to_super: bool = False) -> DataFrame:
    shown = roles if to_super else roles.filter(F.col("role_code") != "SUPER_ADMIN")
    return shown.withColumn("level", codes.role_level(F.col("role_code")))


def lookup_roles(asked: DataFrame, roles: DataFrame, code: str = "role_code") -> DataFrame:
    """A batch of lookups by role code: the role id, null for a code that is no role. Roles are a small fixed table."""
    known = F.broadcast(roles.select(F.col("role_code").alias(code), "role_id"))
    return asked.join(known, code, "left")


def roles_in(asked: DataFrame, roles: DataFrame, ids: str = "role_ids") -> DataFrame:
    """Adds the roles of each row's set of ids, in order of the id; ids that are no role add nothing, nor do repeats."""
    known = roles.agg(F.array_sort(F.collect_list(F.struct("role_id", "role_code"))).alias("roles")).scalar()
    held = F.filter("__roles", lambda r: F.coalesce(F.array_contains(ids, r["role_id"]), F.lit(False)))
    return asked.withColumn("__roles", known).withColumn("roles", held).drop("__roles")


def kb_permissions(grants: DataFrame, roles: DataFrame) -> DataFrame:
    """Role codes granted on each knowledge base, in role order (at most one entry per role)."""
    coded = with_role_codes(grants, roles)
    held = F.array_sort(F.collect_set(F.struct("role_id", "role_code")))
    return coded.groupBy("kb_id").agg(F.array_join(F.transform(held, lambda r: r["role_code"]), ",").alias("role_codes"))


def apply_grants(current: DataFrame, changes: DataFrame, keys: list[str], value: str = "role_id") -> DataFrame:
    """Bindings after a log of GRANT / REVOKE changes; the latest change per key decides, so replays change nothing."""
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct("action", value), F.struct("change_no")).alias("last"))
    merged = current.select(*keys, F.col(value).alias("old")).join(latest, keys, "full_outer")
    return (
        merged.withColumn(value, F.when(F.col("last").isNull(), F.col("old")).when(F.upper("last.action") != "REVOKE", F.col(f"last.{value}")))
        .filter(F.col(value).isNotNull()).select(*keys, value)
    )


def permission_matrix(spark: SparkSession) -> DataFrame:
    rows = [(role, i, p) for role, held in K.ROLE_PERMISSIONS.items() for i, p in enumerate(held)]
    return spark.createDataFrame(rows, "role_code string, position int, permission string")


def has_permission(bindings: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    holders = [r for r, held in K.ROLE_PERMISSIONS.items() if permission in held]
    return with_role_codes(bindings, roles).groupBy("user_id").agg(F.bool_or(F.col("role_code").isin(holders)).alias("permitted"))


def highest_role(bindings: DataFrame, roles: DataFrame) -> DataFrame:
    return with_role_codes(bindings, roles).groupBy("user_id").agg(
        F.min_by("role_code", codes.role_level(F.col("role_code"))).alias("highest_role")
    )


def role_facets(bindings: DataFrame, roles: DataFrame) -> DataFrame:
    return with_role_codes(bindings, roles).groupBy("role_code").agg(F.count(F.lit(1)).alias("n_users"))


def lookup_users(names: DataFrame, users: DataFrame, name_col: str = "username") -> DataFrame:
    """A batch of lookups by name: the user id, and whether the name is taken."""
    return names.join(users.select(name_col, "user_id"), name_col, "left").withColumn("taken", F.col("user_id").isNotNull())
