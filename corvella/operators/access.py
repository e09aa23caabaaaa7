"""Access rules for a table of principals at once: classes of principals and of objects with equal rights, and pairs of classes.

Principals are alike if they have the same clearance, department and roles and no grants of their own; objects are alike if
they have the same level, department and grants. Classes meet by equality joins only: on the department, on the level of
what is open to all, on the subject of a grant. No principal meets an object, and no group is gathered: what an object
grants is compared by sums of hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.principal import LEVELS


@dataclass(frozen=True)
class Access:
    """``principals`` (principal_id, class_id, sees_all), ``objects`` (object_id, class_id, open) and ``pairs`` (principal_class, object_class).

    A class goes by its smallest member. Who sees all, administrators, and what is open to every principal whatever their
    clearance are in no pair. Ids must be unique, not null.
    """

    principals: DataFrame
    objects: DataFrame
    pairs: DataFrame

    def principals_of_objects(self) -> DataFrame:
        """(object_id, n): how many principals have access."""
        sizes = self.principals.where("not sees_all").groupBy("class_id").agg(F.count("*").alias("size"))
        met = self.pairs.join(sizes, F.col("principal_class") == F.col("class_id")).groupBy(F.col("object_class").alias("class_id")).agg(F.sum("size").alias("n"))
        counts = self.principals.agg(F.count("*").alias("of_all"), F.count_if("sees_all").alias("of_admins")).first()
        seen = F.when(F.col("open"), F.lit(counts.of_all)).otherwise(F.coalesce("n", F.lit(0)) + F.lit(counts.of_admins))
        return self.objects.join(met, "class_id", "left").select("object_id", seen.alias("n"))

    def can_see(self, asked: DataFrame) -> DataFrame:
        """asked (principal_id, object_id) with ``allowed``."""
        who = asked.join(self.principals.withColumnRenamed("class_id", "principal_class"), "principal_id", "left").join(self.objects.withColumnRenamed("class_id", "object_class"), "object_id", "left")
        met = who.join(self.pairs.withColumn("met", F.lit(True)), ["principal_class", "object_class"], "left")
        known = F.col("principal_class").isNotNull() & F.col("object_class").isNotNull()
        return met.select("principal_id", "object_id", (known & (F.coalesce("sees_all", F.lit(False)) | F.coalesce("open", F.lit(False)) | F.coalesce("met", F.lit(False)))).alias("allowed"))


def _levels_up_to(clearance: Column) -> Column:
    """The levels a clearance covers."""
    rank = F.lit(None).cast("int")
    for name, value in LEVELS.items():
        rank = F.when(clearance == name, value).otherwise(rank)
    return F.filter(F.array(*map(F.lit, LEVELS)), lambda x: F.element_at(F.create_map(*(F.lit(v) for pair in LEVELS.items() for v in pair)), x) <= rank)


def access_classes(objects: DataFrame, key: str, permissions: DataFrame, principals: DataFrame, level: str | None = None, department: str = "department", active_only: bool = False) -> Access:
    """Who may search which objects (``security.retrieval_filter``, with ``level``) or use which bases (``can_access_bases``, without).

    principals: principal_id, user, department, roles (array), clearance, active. A principal sees an object if its
    level is covered (without ``level`` all are), and the department is the same, or nobody is named in grants on the
    object, or a grant to read or administer names the user, the department or a role. Administrators see all.
    ``active_only``: inactive principals see nothing; otherwise the flag plays no part, as in retrieval.
    """
    who = principals.where("active") if active_only else principals
    reads = permissions.where(F.col("permission").isin("read", "admin")).select(F.col(key).alias("object_id"), "subject_type", "subject_value").where("subject_value is not null").distinct()

    # Principals: a user with grants of their own is a class alone.
    named = reads.where("subject_type = 'user'").select(F.col("subject_value").alias("user")).distinct().withColumn("own", F.lit(True))
    roles = F.array_sort(F.array_distinct(F.coalesce("roles", F.array().cast("array<string>"))))
    known = who.withColumn("roles", roles).join(named, "user", "left").withColumn("alone", F.when(F.col("own"), F.col("user")))
    admin = F.array_contains("roles", "admin")  # a role like others, but one that grants needn't name
    alike = ["alone", "department", "roles", "clearance"] if level else ["alone", "department", "roles"]
    sets = known.groupBy(*alike).agg(F.min("principal_id").alias("class_id"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in alike]
    members = known.alias("p").join(sets.alias("s"), same).select("p.principal_id", "s.class_id", F.array_contains("p.roles", "admin").alias("sees_all"))
    classes = sets.where(~admin).select(F.col("class_id").alias("principal_class"), F.col("alone").alias("user"), "department", "roles", *(["clearance"] if level else []))

    # Objects: their grants as a count and sums of hashes.
    mark = F.xxhash64("subject_type", "subject_value")
    other = F.xxhash64("subject_value", "subject_type", F.lit(1))
    part = lambda h, shift: F.sum(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    marks = reads.groupBy("object_id").agg(F.count("*").alias("grants"), *(part(h, s).alias(n) for n, h, s in (("m0", mark, 0), ("m1", mark, 32), ("m2", other, 0), ("m3", other, 32))))
    closed = permissions.select(F.col(key).alias("object_id")).distinct().withColumn("closed", F.lit(True))
    own_level = F.col(level) if level else F.lit(None).cast("string")
    things = objects.select(F.col(key).alias("object_id"), own_level.alias("level"), F.col(department).alias("department"))
    things = things.join(closed, "object_id", "left").join(marks, "object_id", "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    kinds = ["level", "department", "closed", "grants", "m0", "m1", "m2", "m3"]
    found = things.groupBy(*kinds).agg(F.min("object_id").alias("class_id"))
    matched = [F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}")) for c in kinds]
    held = things.alias("o").join(found.alias("c"), matched).select("o.object_id", "c.class_id", (F.lit(False) if level else ~F.col("o.closed")).alias("open"))
    rights = found.select(F.col("class_id").alias("object_class"), "level", "department", "closed")

    # Pairs of classes.
    covered = classes.withColumn("level", F.explode(_levels_up_to(F.col("clearance")))) if level else classes
    at_level = ["level"] if level else []
    pair = ["principal_class", "object_class"]
    home = covered.where("department is not null").join(rights.where("department is not null"), [*at_level, "department"]).select(*pair)
    if level:
        public = covered.select("principal_class", "level").join(rights.where("not closed").select("object_class", "level"), "level").select(*pair)
        home = home.unionByName(public)
    subjects = F.array_distinct(F.concat(
        F.when(F.col("user").isNotNull(), F.array(F.struct(F.lit("user").alias("subject_type"), F.col("user").alias("subject_value")))).otherwise(F.array()),
        F.when(F.col("department").isNotNull(), F.array(F.struct(F.lit("department").alias("subject_type"), F.col("department").alias("subject_value")))).otherwise(F.array()),
        F.transform("roles", lambda r: F.struct(F.lit("role").alias("subject_type"), r.alias("subject_value"))),
    ))
    stand = covered.select("principal_class", *at_level, F.explode(subjects).alias("s")).select("principal_class", *at_level, "s.subject_type", "s.subject_value")
    given = rights.where("closed").join(reads, F.col("object_class") == F.col("object_id")).select("object_class", *at_level, "subject_type", "subject_value")
    granted = stand.join(given, [*at_level, "subject_type", "subject_value"]).select(*pair)
    return Access(members, held, home.unionByName(granted).distinct())

