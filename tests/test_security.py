"""Access rules against plain Python statements of them, over all combinations of a small world."""

import itertools

import pytest
from pyspark.sql import functions as F

from corvella.functions.principal import LEVELS, Principal
from corvella.operators import security

LEVELS_OF = [*LEVELS, None]
DEPARTMENTS = ["finance", "legal", None]
GRANTS = [None, ("user", "ann", "read"), ("department", "finance", "admin"), ("role", "reader", "read"), ("user", "ann", "write"), ("role", None, "read"), ("user", "bob", "read")]
PEOPLE = [
    Principal("ann", "finance", frozenset(("reader",)), "internal"), Principal("bob", None, frozenset(), "restricted"), Principal("root", None, frozenset(("admin",)), "public"),
    Principal("gone", "finance", frozenset(), "restricted", active=False), Principal("gone2", "finance", frozenset(("admin",)), "restricted", active=False), Principal("cid", "legal", frozenset(("x", "reader")), "confidential"),
]


@pytest.fixture(scope="module")
def world(spark):
    docs, grants, kb_grants = [], [], []
    for i, (level, dept, status, g, k) in enumerate(itertools.product(LEVELS_OF, DEPARTMENTS, ["ready", "archived"], range(len(GRANTS)), range(3))):
        docs.append((i, f"kb{k}", level, dept, status, g))
        if GRANTS[g]:
            grants.append((i, *GRANTS[g]))
    for k, g in ((1, 3), (2, 6)):
        kb_grants.append((f"kb{k}", *GRANTS[g]))
    schema = "subject_type string, subject_value string, permission string"
    return (
        docs,
        dict(enumerate([None, GRANTS[3], GRANTS[6]])),
        spark.createDataFrame(docs, "document_id long, knowledge_base_id string, confidential_level string, department string, status string, g int"),
        spark.createDataFrame(grants, f"document_id long, {schema}"),
        spark.createDataFrame(kb_grants, f"knowledge_base_id string, {schema}"),
    )


def _granted(p, g):
    if g is None:
        return True
    kind, value, permission = g
    same = {"user": value == p.user, "department": p.department is not None and value == p.department, "role": value in p.roles}[kind]
    return permission in ("read", "admin") and same


@pytest.mark.parametrize("p", PEOPLE, ids=lambda p: p.user)
def test_reading(world, p):
    docs, kbs, documents, grants, kb_grants = world
    got = {r.document_id: r.can_read for r in security.can_read_documents(documents, grants, kb_grants, p).collect()}
    for i, kb, level, dept, status, g in docs:
        if not p.active or p.is_admin:
            want = p.active
        else:
            cleared = level is not None and LEVELS[p.clearance] >= LEVELS[level]
            own = p.department is not None and dept == p.department
            want = status != "archived" and cleared and (own or (_granted(p, kbs[int(kb[2:])]) and _granted(p, GRANTS[g])))
        assert got[i] == want, (i, kb, level, dept, status, GRANTS[g])


@pytest.mark.parametrize("p", [*PEOPLE, None], ids=lambda p: p.user if p else "nobody")
def test_retrieval(world, p):
    docs, _, documents, grants, _ = world
    got = {r.document_id for r in security.retrieval_filter(documents, grants, p).collect()}
    for i, _, level, dept, _, g in docs:
        own = p is not None and p.department is not None and dept == p.department
        want = p is None or p.is_admin or (level in p.levels and (own or _granted(p, GRANTS[g])))
        assert (i in got) == want


def test_bases(spark, world):
    *_, kb_grants = world
    bases = spark.createDataFrame([("kb0", "legal"), ("kb1", None), ("kb2", "finance")], "knowledge_base_id string, owner_department string")
    see = lambda p: {r.knowledge_base_id for r in security.can_access_bases(bases, kb_grants, p).where("can_access").collect()}
    assert see(PEOPLE[0]) == {"kb0", "kb1", "kb2"} and see(PEOPLE[1]) == {"kb0", "kb2"} and see(PEOPLE[2]) == {"kb0", "kb1", "kb2"} and see(PEOPLE[3]) == set()


def test_keyed_changes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    changes = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, security.upsert(rows, changes, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert [r.k for r in security.delete_by_key(rows, changes, ["k"]).collect()] == [1]


def test_base_restriction(spark):
    allowed = F.array(F.lit("a"), F.lit("b"))
    pick = lambda *x: spark.range(1).select(security.restrict_bases(F.array(*map(F.lit, x)).cast("array<string>"), allowed)).first()[0]
    assert pick("b", "z", "b", "a") == ["b", "b", "a"] and pick("z") == ["a", "b"] and pick() == ["a", "b"]


def test_roles_from_tables(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    held = spark.createDataFrame([(1, 2), (1, 2), (1, 1), (2, 9), (None, 1), (3, None)], "user_id long, role_id int")
    roles = spark.createDataFrame([(1, "admin"), (2, "editor")], "role_id int, name string")
    got = {r.user_id: r.roles for r in security.with_roles(users, held, roles).collect()}
    assert got == {1: ["admin", "editor"], 2: [], 3: []}
    assert [r.roles for r in security.with_roles(users.limit(1), held.limit(0), roles).collect()] == [[]]


def test_admin_gate():
    from corvella.functions.principal import Principal, require_admin

    require_admin(Principal("root", roles=frozenset(("admin",))))
    for p in (Principal("ann"), Principal("old", roles=frozenset(("admin",)), active=False)):
        with pytest.raises(PermissionError):
            require_admin(p)
