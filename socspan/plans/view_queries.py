"""The canonical tables themselves."""

from __future__ import annotations

from .common import Book
from .views import SQL

_b = Book()
for _name in SQL:
    _b.add(f"view_{_name}", lambda t, n=_name: getattr(t, n).drop("alert_ids", "ok"), "select * exclude (ok) from cases" if _name == "cases" else f"select * from {_name}")

QUERIES, ORACLES = _b.queries, _b.oracles
