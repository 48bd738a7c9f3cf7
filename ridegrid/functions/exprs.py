"""Shared Column expressions (all built-in functions, so they stay in codegen).

Each helper takes Columns and returns a Column; none of them touches data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridegrid.schemas import MONEY, RATE

# Plan name -> ride discount (reference's CASE on PlanName).
PLAN_DISCOUNTS = [("Basic Plan", "0.05"), ("Premium Plan", "0.10"), ("Annual Plan", "0.15")]
NO_DISCOUNT = "0.00"

ADMIN = "admin"
DEFAULT_ROLE = "user"
LOG_PAGE_DEFAULT = 100
LOG_PAGE_MAX = 500


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plan_discount(plan_name: Column | str) -> Column:
    """Discount of a plan name; unknown or NULL name gives 0.00."""
    name = _c(plan_name)
    expr = None
    for plan, pct in PLAN_DISCOUNTS:
        cond = name == F.lit(plan)
        value = F.lit(pct).cast(RATE)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(F.lit(NO_DISCOUNT).cast(RATE))


def ride_cost(rate: Column | str, hours: Column | str, discount: Column | str) -> Column:
    """(rate * hours) * (1 - discount) stored as DECIMAL(10,2) (half-up); NULL if that cannot hold it."""
    return ((_c(rate) * _c(hours)) * (F.lit(1) - _c(discount))).try_cast(MONEY)


def expected_end(start: Column | str, hours: Column | str) -> Column:
    """Start + INTERVAL hours HOUR; the interval takes hours rounded to an integer."""
    return _c(start) + F.make_dt_interval(hours=F.round(_c(hours), 0).cast("int"))


def digest(password: Column | str) -> Column:
    """Unsalted SHA-256 hex digest."""
    return F.sha2(_c(password), 256)


def parse_int(text: Column | str) -> Column:
    """Integer text -> int, anything else -> NULL."""
    return _try_cast(F.trim(_c(text)), "int")


def _try_cast(col: Column, to: str) -> Column:
    return col.try_cast(to)


def parse_amount(text: Column | str) -> Column:
    """Numeric text -> DECIMAL(10,2) amount, anything else -> NULL."""
    return _try_cast(_try_cast(F.trim(_c(text)), "double"), MONEY)


def vehicle_label(manufacturer: Column | str, vtype: Column | str) -> Column:
    """E11: 'Manufacturer • Type' with missing parts shown as ''."""
    return F.concat(F.coalesce(_c(manufacturer), F.lit("")), F.lit(" • "), F.coalesce(_c(vtype), F.lit("")))


def or_na(text: Column | str) -> Column:
    """NULL or '' -> 'N/A'."""
    return F.coalesce(F.nullif(_c(text), F.lit("")), F.lit("N/A"))


def money_text(amount: Column | str) -> Column:
    """Two-decimal text of a number; NULL -> '0.00'."""
    return F.coalesce(_c(amount).cast(MONEY).cast("string"), F.lit("0.00"))


def non_blank(text: Column | str) -> Column:
    """Text present after trimming."""
    return F.coalesce(_c(text).rlike(r"\S"), F.lit(False))


def assignment_vehicle_label(model: Column | str, registration: Column | str) -> Column:
    """E15: 'Model (Registration)'."""
    return F.concat(_c(model), F.lit(" ("), _c(registration), F.lit(")"))


def truthy_id(x: Column | str) -> Column:
    """§2.13.4: an id is present when it is not NULL and not 0."""
    return F.coalesce(_c(x) != 0, F.lit(False))


def truthy_text(x: Column | str) -> Column:
    """§2.13.4: a text field is present when it is not NULL and not ''."""
    return F.coalesce(_c(x) != "", F.lit(False))


def is_admin(role: Column | str) -> Column:
    """F16: requester role, missing role counts as 'user'."""
    return F.coalesce(_c(role), F.lit(DEFAULT_ROLE)) == F.lit(ADMIN)


def clamp_limit(value) -> int:
    """Page size for the audit listing: missing/invalid -> 100, clamped to [1, 500]."""
    try:
        n = int(value or LOG_PAGE_DEFAULT)
    except (TypeError, ValueError):
        n = LOG_PAGE_DEFAULT
    return max(1, min(n, LOG_PAGE_MAX))


def holds(cond: Column) -> Column:
    """SQL ``IF cond`` semantics: a NULL condition is not taken."""
    return F.coalesce(cond, F.lit(False))
