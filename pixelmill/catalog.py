"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from ._registered import ORACLE_SQL, QUERIES
from .queries import audits, features, images, notebook, tables

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "features", "images", "notebook", "tables"]
