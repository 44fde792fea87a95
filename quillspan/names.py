"""How names compare: outer blanks go, letters are lower-cased, a blank name is no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks that are cut from both ends of a name (space, tab, no-break space).
BLANKS = " \t\u00a0"


def name_of(c: Column | str) -> Column:
    """The compared form of a name; null where there is no value."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.lower(F.trim(c, F.lit(BLANKS)))
    return F.when(trimmed != "", trimmed)


def file_of(c: Column | str) -> Column:
    """The compared form of a file id: as a name, with backslashes read as slashes."""
    c = F.col(c) if isinstance(c, str) else c
    return name_of(F.translate(c, "\\", "/"))


def name_sql(c: str) -> str:
    """The same for DuckDB."""
    return f"nullif(lower(trim({c}, ' ' || chr(9) || chr(160))), '')"


def file_sql(c: str) -> str:
    return f"nullif(lower(trim(replace({c}, chr(92), '/'), ' ' || chr(9) || chr(160))), '')"
