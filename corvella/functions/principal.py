"""The principal a query runs for, and the expressions that read bearer tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Confidentiality levels by rank.
LEVELS = {"public": 1, "internal": 2, "confidential": 3, "restricted": 4}


@dataclass(frozen=True)
class Principal:
    user: str
    department: str | None = None
    roles: frozenset[str] = field(default_factory=frozenset)
    clearance: str = "internal"
    active: bool = True

    @property
    def is_admin(self) -> bool:
        return "admin" in self.roles

    @property
    def levels(self) -> list[str]:
        return [name for name, rank in LEVELS.items() if rank <= LEVELS[self.clearance]]


def require_admin(p: Principal) -> None:
    """PermissionError unless p is an active administrator; where the service answers 403."""
    if not (p.active and p.is_admin):
        raise PermissionError("Admin role is required.")


def level_rank(c: Column) -> Column:
    rank = F.when(c == "public", LEVELS["public"])
    for name, value in LEVELS.items():
        rank = rank.when(c == name, value)
    return rank


def parse_token(token: str | None) -> Principal:
    """``user|department|clearance|role,role``; ``admin`` is the super-user. ValueError where the service says 401."""
    if not token:
        raise ValueError("missing bearer token")
    if token == "admin":
        return Principal("admin", "admin", frozenset(("admin",)), "restricted")
    parts = [p.strip() for p in token.split("|")] + ["", "", ""]
    clearance = parts[2] or "internal"
    if clearance not in LEVELS:
        raise ValueError("invalid clearance level in bearer token")
    return Principal(parts[0] or token, parts[1] or None, frozenset(r.strip() for r in parts[3].split(",") if r.strip()), clearance)


def token_columns(token: Column) -> Column:
    """Struct (user, department, clearance, roles, error) of a column of bearer tokens; a bad token has an error."""
    part = lambda i: F.nullif(strip(F.get(F.split(token, "\\|", -1), F.lit(i))), F.lit(""))
    admin = token == "admin"
    roles = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(part(3), F.lit("")), ","), strip), lambda r: r != "")))
    clearance = F.coalesce(part(2), F.lit("internal"))
    bad = F.when(F.coalesce(token, F.lit("")) == "", "missing bearer token").when(~admin & ~clearance.isin(*LEVELS), "invalid clearance level")
    return F.struct(
        F.when(admin, "admin").otherwise(F.coalesce(part(0), token)).alias("user"),
        F.when(admin, "admin").otherwise(part(1)).alias("department"),
        F.when(admin, "restricted").otherwise(clearance).alias("clearance"),
        F.when(admin, F.array(F.lit("admin"))).otherwise(roles).alias("roles"),
        bad.alias("error"),
    )


def may_administer(token: Column) -> Column:
    """``require_admin`` of a struct of ``token_columns``: a valid token with the admin role."""
    return token["error"].isNull() & F.array_contains(token["roles"], "admin")
