"""Classes of principals and objects against the rules for one principal."""

import pytest
from pyspark.sql import functions as F

from corvella.functions.principal import Principal
from corvella.operators import access, security
from corvella.plans import views

SF = "/root/testdata/sf0.001"
PEOPLE = [
    ("p1", "u3", "engineering", ["reader"], "internal", True), ("p2", "u6", "engineering", ["reader"], "internal", True), ("p3", "x1", "engineering", ["reader", "reader"], "internal", True),
    ("p4", "x2", None, None, "restricted", True), ("p5", "x3", "finance", ["editor", "auditor"], "public", False), ("p6", "x4", "legal", ["admin"], "public", True), ("p7", "x5", "nowhere", ["admin"], "public", False),
    ("p8", "u9", None, ["auditor"], "confidential", True),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "principal_id string, user string, department string, roles array<string>, clearance string, active boolean")


def _principal(row):
    _, user, department, roles, clearance, active = row
    return Principal(user, department, frozenset(roles or ()), clearance, active)


def _allowed(found, key, ids):
    asked = found.principals.select("principal_id").crossJoin(ids.select(F.col(key).alias("object_id")))
    out: dict = {}
    for r in found.can_see(asked).where("allowed").collect():
        out.setdefault(r.principal_id, set()).add(r.object_id)
    return out


def test_documents(spark, people):
    documents, permissions = views.documents(spark, SF).cache(), views.document_permissions(spark, SF)
    odd = spark.createDataFrame([(0, "user", None, "read"), (1, "user", "x2", "write"), (2, "role", "auditor", "read"), (2, "role", "auditor", "read")], permissions.schema)
    permissions = permissions.unionByName(odd).cache()
    found = access.access_classes(documents, "document_id", permissions, people, "confidential_level")
    want = {row[0]: {r.document_id for r in security.retrieval_filter(documents, permissions, _principal(row)).collect()} for row in PEOPLE}
    assert _allowed(found, "document_id", documents) == {k: v for k, v in want.items() if v}
    counts = {r.object_id: r.n for r in found.principals_of_objects().collect()}
    assert counts == {r.document_id: sum(r.document_id in v for v in want.values()) for r in documents.select("document_id").collect()}
    classes = {r.principal_id: r.class_id for r in found.principals.collect()}
    assert classes["p4"] != classes["p8"] and classes["p3"] in ("p2", "p3") and found.objects.select("class_id").distinct().count() < documents.count()


def test_bases(spark, people):
    bases, permissions = views.knowledge_bases(spark, SF).cache(), views.base_permissions(spark, SF).cache()
    found = access.access_classes(bases, "knowledge_base_id", permissions, people, department="owner_department", active_only=True)
    want = {row[0]: {r.knowledge_base_id for r in security.can_access_bases(bases, permissions, _principal(row)).where("can_access").collect()} for row in PEOPLE}
    assert _allowed(found, "knowledge_base_id", bases) == {k: v for k, v in want.items() if v}


def test_empty_tables(spark, people):
    documents, permissions = views.documents(spark, SF), views.document_permissions(spark, SF)
    nobody = access.access_classes(documents, "document_id", permissions, people.where("false"), "confidential_level")
    assert nobody.principals_of_objects().where("n > 0").count() == 0
    nothing = access.access_classes(documents.where("false"), "document_id", permissions, people, "confidential_level")
    assert nothing.principals_of_objects().count() == 0
    free = access.access_classes(documents, "document_id", permissions.where("false"), people, "confidential_level")
    want = {row[0]: security.retrieval_filter(documents, permissions.where("false"), _principal(row)).count() for row in PEOPLE}
    assert {k: len(v) for k, v in _allowed(free, "document_id", documents).items()} == {k: n for k, n in want.items() if n}
