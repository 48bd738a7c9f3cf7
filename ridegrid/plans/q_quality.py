"""Registered data-quality queries; the oracle SQL is written per rule family."""

from __future__ import annotations

from ridegrid.operators import quality as Q
from ridegrid.plans.registry import register
from ridegrid.schemas import (
    CONVENTIONAL_DOMAINS,
    ENUM_DOMAINS,
    FOREIGN_KEYS,
    MAX_LENGTHS,
    PRIMARY_KEYS,
    UNIQUE_KEYS,
    not_null_columns,
)


def _row(rule: str, table: str, key: str, detail: str, src: str) -> str:
    return (f"SELECT '{rule}' AS Rule, '{table}' AS TableName, CAST({key} AS VARCHAR) AS RecordKey, "
            f"CAST({detail} AS VARCHAR) AS Detail FROM {src}")


def _k(col: str) -> str:
    return f"'{col}=' || CAST({col} AS VARCHAR)"


def _pk_sql(table: str, pk: str) -> str:
    src = f"(SELECT {pk}, count(*) AS n FROM {table} GROUP BY {pk} HAVING count(*) > 1) d"
    return _row("primary_key", table, _k(pk), "'count=' || CAST(n AS VARCHAR)", src)


def _unique_sql(label: str, src_table: str, cols: tuple[str, ...], ci: bool) -> str:
    sel = ", ".join(f"lower({c}) AS {c}" if ci else c for c in cols)
    grp = ", ".join(f"lower({c})" if ci else c for c in cols)
    cond = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    src = f"(SELECT {sel}, count(*) AS n FROM {src_table} WHERE {cond} GROUP BY {grp} HAVING count(*) > 1) d"
    key = " || ',' || ".join(_k(c) for c in cols)
    return _row("unique", label, key, "'count=' || CAST(n AS VARCHAR)", src)


def _nn_sql(table: str, cols: list[str], key: str) -> str:
    return "\nUNION ALL\n".join(_row("not_null", table, _k(key), f"'{c}'", f"{table} WHERE {c} IS NULL")
                                for c in cols)


def _fk_sql(table: str, col: str, parent: str, pcol: str, key: str) -> str:
    src = (f"{table} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
           f"(SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{col})")
    detail = f"'{col}=' || CAST(c.{col} AS VARCHAR) || ' not in {parent}.{pcol}'"
    return _row("foreign_key", table, f"'{key}=' || CAST(c.{key} AS VARCHAR)", detail, src)


def _domain_sql(table: str, col: str, domain: tuple[str, ...], key: str) -> str:
    values = ", ".join(f"'{d}'" for d in domain)
    return _row("domain", table, _k(key), f"'{col}=' || {col}", f"{table} WHERE {col} IS NOT NULL AND {col} NOT IN ({values})")


def _range_sql(table: str, col: str, lo: int, hi: int, key: str) -> str:
    v = f"TRY_CAST(trim({col}) AS INT)"
    return _row("range", table, _k(key), f"'{col}=' || coalesce({col}, 'NULL')",
                f"{table} WHERE {v} IS NULL OR {v} < {lo} OR {v} > {hi}")


def _length_sql(table: str, col: str, n: int, key: str) -> str:
    detail = f"'{col} length ' || CAST(length({col}) AS VARCHAR) || ' > {n}'"
    return _row("length", table, _k(key), detail, f"{table} WHERE length({col}) > {n}")


def _u(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


PK_SQL = _u([_pk_sql(t, pk) for t, pk in PRIMARY_KEYS.items()] + [_pk_sql(f, "RequestID") for f in Q.FEEDS])
UNIQUE_SQL = _u(
    [_unique_sql(t, t, cols, ci) for t, cols, ci in UNIQUE_KEYS]
    + [_unique_sql("users+register_requests",
                   "(SELECT Email FROM users UNION ALL SELECT email AS Email FROM register_requests) e",
                   ("Email",), True)]
)
NOT_NULL_SQL = _u([_nn_sql(t, not_null_columns(t), PRIMARY_KEYS[t]) for t in PRIMARY_KEYS]
                  + [_nn_sql("imported_users", ["UserID", "Name", "Email", "Role"], "UserID")]
                  + [_nn_sql(f, cols, "RequestID") for f, cols in Q.FEED_NOT_NULL.items()])
FK_SQL = _u([_fk_sql(c, cc, p, pc, PRIMARY_KEYS[c]) for c, cc, p, pc in FOREIGN_KEYS]
            + [_fk_sql(c, cc, p, pc, "RequestID") for c, cc, p, pc in Q.FEED_FOREIGN_KEYS])
ENUM_SQL = _u([_domain_sql(t, c, d, PRIMARY_KEYS[t]) for (t, c), d in {**ENUM_DOMAINS, **CONVENTIONAL_DOMAINS}.items()]
              + [_domain_sql("imported_users", "Role", ENUM_DOMAINS["users", "Role"], "UserID")]
              + [_range_sql(f, c, lo, hi, "RequestID") for f, c, lo, hi in Q.FEED_RANGES])
LENGTH_SQL = _u([_length_sql(t, c, n, PRIMARY_KEYS[t]) for (t, c), n in MAX_LENGTHS.items()]
                + [_length_sql("imported_users", c, MAX_LENGTHS["users", c], "UserID") for c in ("Name", "Email")]
                + [_length_sql(f, c, n, "RequestID") for f, c, n in Q.FEED_LENGTHS])


@register("dq_pk", PK_SQL)
def dq_pk(td):
    """Duplicate primary keys (tables and request ids)."""
    return Q.dq_pk(td)


@register("dq_unique", UNIQUE_SQL)
def dq_unique(td):
    """Duplicate unique keys, including e-mails requested for registration."""
    return Q.dq_unique(td)


@register("dq_not_null", NOT_NULL_SQL)
def dq_not_null(td):
    """Missing required values."""
    return Q.dq_not_null(td)


@register("dq_fk", FK_SQL)
def dq_fk(td):
    """C4: dangling references (tables and request feeds)."""
    return Q.dq_fk(td)


@register("dq_enum", ENUM_SQL)
def dq_enum(td):
    """Values outside enumerated domains; ratings outside 1..5."""
    return Q.dq_enum(td)


@register("dq_length", LENGTH_SQL)
def dq_length(td):
    """Text longer than its column allows."""
    return Q.dq_length(td)


@register("dq_report", _u([f"SELECT * FROM ({s}) x" for s in
                           (PK_SQL, UNIQUE_SQL, NOT_NULL_SQL, FK_SQL, ENUM_SQL, LENGTH_SQL)]))
def dq_report(td):
    """All rule families together."""
    return Q.dq_report(td)
