"""Row-level security: clearance, departments and grants to users, departments and roles.

An object without grants is open, so all grants count: they are reduced to one flag an object, combined before the
shuffle, and joined by the object's key. Who asks is a literal in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.principal import Principal, level_rank


def grant_matches(p: Principal) -> Column:
    """A permission row that lets p read; ``write`` alone doesn't."""
    subject = lambda kind, value: (F.col("subject_type") == kind) & value
    who = subject("user", F.col("subject_value") == p.user)
    if p.department is not None:
        who = who | subject("department", F.col("subject_value") == p.department)
    if p.roles:
        who = who | subject("role", F.col("subject_value").isin(*sorted(p.roles)))
    return F.col("permission").isin("read", "admin") & F.coalesce(who, F.lit(False))


def _grants(permissions: DataFrame, key: str, p: Principal) -> DataFrame:
    """(key, granted) for every object with permission rows: one row an object, combined before the shuffle."""
    return permissions.groupBy(F.col(key).alias("_object")).agg(F.bool_or(grant_matches(p)).alias("_granted"))


def _open_or_granted(rows: DataFrame, permissions: DataFrame, key: str, p: Principal, flag: str) -> DataFrame:
    """Add ``flag``: the object has no permission rows, or one of them matches."""
    found = _grants(permissions, key, p)
    return rows.join(found, rows[key] == found["_object"], "left").withColumn(flag, F.coalesce("_granted", F.lit(True))).drop("_object", "_granted")


def same_department(p: Principal, column: str = "department") -> Column:
    return F.coalesce(F.col(column) == F.lit(p.department), F.lit(False)) if p.department is not None else F.lit(False)


def retrieval_filter(documents: DataFrame, permissions: DataFrame, p: Principal | None) -> DataFrame:
    """Documents p may search: cleared, and of the own department, without permission rows, or granted.

    Knowledge-base permissions and the active flag play no part here. Admins, and calls without principal, see all.
    """
    if p is None or p.is_admin:
        return documents
    cleared = documents.where(F.col("confidential_level").isin(*p.levels))
    marked = _open_or_granted(cleared, permissions, "document_id", p, "_open")
    return marked.where(same_department(p) | F.col("_open")).drop("_open")


def can_read_documents(documents: DataFrame, document_permissions: DataFrame, kb_permissions: DataFrame, p: Principal) -> DataFrame:
    """documents with ``can_read``.

    Admins read all, archived ones too. Others: not archived, cleared; then the own department, or the knowledge base
    open or granted and the document open or granted.
    """
    if not p.active or p.is_admin:
        return documents.withColumn("can_read", F.lit(p.active))
    marked = _open_or_granted(documents, kb_permissions, "knowledge_base_id", p, "_kb")
    marked = _open_or_granted(marked, document_permissions, "document_id", p, "_document")
    cleared = level_rank(F.lit(p.clearance)) >= level_rank(F.col("confidential_level"))
    allowed = (F.col("status") != "archived") & cleared & (same_department(p) | (F.col("_kb") & F.col("_document")))
    return marked.withColumn("can_read", F.coalesce(allowed, F.lit(False))).drop("_kb", "_document")


def can_access_bases(bases: DataFrame, kb_permissions: DataFrame, p: Principal) -> DataFrame:
    """bases with ``can_access``; clearance plays no part."""
    if not p.active or p.is_admin:
        return bases.withColumn("can_access", F.lit(p.active))
    marked = _open_or_granted(bases, kb_permissions, "knowledge_base_id", p, "_kb")
    return marked.withColumn("can_access", same_department(p, "owner_department") | F.col("_kb")).drop("_kb")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge: a change replaces the row with its key, or is added. Keys are unique within changes."""
    old = rows.join(changes.select(*keys), keys, "left_anti")
    return old.unionByName(changes, allowMissingColumns=True)


def delete_by_key(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def with_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """users with ``roles``, the sorted distinct names of their roles; none gives an empty array.

    Names are gathered by user before users are joined. Assignments to a role that is not there count for nothing.
    """
    named = user_roles.select("user_id", "role_id").distinct().join(roles.select("role_id", "name"), "role_id")
    held = named.groupBy("user_id").agg(F.array_sort(F.collect_set("name")).alias("roles"))
    return users.join(held, "user_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def restrict_bases(requested: Column, allowed: Column) -> Column:
    """Requested ids that are allowed, in requested order, repeats kept; all allowed ones if none is left."""
    kept = F.filter(F.coalesce(requested, F.array().cast("array<string>")), lambda x: F.array_contains(allowed, x))
    return F.when(F.size(kept) > 0, kept).otherwise(allowed)
