"""The definition of a database's table, and the statements that make one like it.

A table that goes to a database of the same product keeps its types, nullability, defaults,
identity columns, primary key and secondary indexes. MySQL itself gives the whole statement;
of others the definition is read from JDBC metadata.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: JDBC's type names with a length, and with precision and scale.
SIZED, SCALED = ("CHAR", "VARCHAR", "BINARY", "VARBINARY", "CLOB", "BLOB", "CHARACTER", "NCHAR", "NVARCHAR"), ("DECIMAL", "NUMERIC")
_IDENTITY = re.compile(r"AUTOINCREMENT: start (-?\d+) increment (-?\d+)", re.IGNORECASE)


@dataclass(frozen=True)
class ColumnDef:
    """identity: start and step, for a column that numbers itself."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    identity: tuple[int, int] | None = None


@dataclass(frozen=True)
class IndexDef:
    """columns: (name, ascending), in order."""

    name: str
    unique: bool
    columns: tuple[tuple[str, bool], ...]


@dataclass(frozen=True)
class TableDef:
    """text: the product's own statement, if it gives one."""

    product: str
    columns: tuple[ColumnDef, ...]
    key: tuple[str, ...] = ()
    indexes: tuple[IndexDef, ...] = ()
    text: str | None = None


def _each(rows) -> list:
    """A result set's rows, read by name while it is on each."""
    while rows.next():
        yield rows


def type_text(name: str, size: int, digits: int) -> str:
    """A type as a statement has it: `VARCHAR(40)`, `DECIMAL(10,2)`, `CHAR (8) FOR BIT DATA`."""
    if "()" in name:
        return name.replace("()", f"({size})")
    if name.upper() in SCALED:
        return f"{name}({size},{digits})"
    return f"{name}({size})" if name.upper() in SIZED else name


def read(meta, catalog: str | None, schema: str | None, table: str, escaped: str) -> TableDef:
    """From a connection's metadata; `escaped` is the table's name as a pattern."""
    columns = []
    for r in _each(meta.getColumns(catalog, schema, escaped, None)):
        if r.getString("TABLE_NAME") != table:
            continue
        name, kind, size, digits = r.getString("COLUMN_NAME"), r.getString("TYPE_NAME"), r.getInt("COLUMN_SIZE"), r.getInt("DECIMAL_DIGITS")
        nullable, default, own, at = r.getInt("NULLABLE") != 0, r.getString("COLUMN_DEF"), r.getString("IS_AUTOINCREMENT") == "YES", r.getInt("ORDINAL_POSITION")
        numbered = _IDENTITY.search(default or "")
        identity = (int(numbered[1]), int(numbered[2])) if numbered else (1, 1) if own else None
        columns.append((at, ColumnDef(name, type_text(kind, size, digits), nullable, None if identity else default, identity)))
    key = sorted((r.getShort("KEY_SEQ"), r.getString("COLUMN_NAME")) for r in _each(meta.getPrimaryKeys(catalog, schema, table)))
    found: dict[str, list] = {}
    unique: dict[str, bool] = {}
    for r in _each(meta.getIndexInfo(catalog, schema, table, False, True)):
        if (name := r.getString("INDEX_NAME")) is not None:
            found.setdefault(name, []).append((r.getShort("ORDINAL_POSITION"), r.getString("COLUMN_NAME"), r.getString("ASC_OR_DESC") != "D"))
            unique[name] = not r.getBoolean("NON_UNIQUE")
    own_key = tuple(name for _, name in key)
    indexes = [IndexDef(n, unique[n], tuple((c, up) for _, c, up in sorted(x))) for n, x in sorted(found.items())]
    return TableDef(meta.getDatabaseProductName(), tuple(c for _, c in sorted(columns, key=lambda x: x[0])), own_key, tuple(x for x in indexes if not (x.unique and tuple(c for c, _ in x.columns) == own_key)))


def statements(table: TableDef, name: str, quoted: Callable[[str], str], index_name: Callable[[str], str]) -> list[str]:
    """CREATE TABLE and CREATE INDEX for a table like that one; `name` is quoted already. Identity columns take given values too."""
    parts = []
    for c in table.columns:
        more = f" GENERATED BY DEFAULT AS IDENTITY (START WITH {c.identity[0]}, INCREMENT BY {c.identity[1]})" if c.identity else f" DEFAULT {c.default}" if c.default is not None else ""
        parts.append(f"{quoted(c.name)} {c.type}{more}{'' if c.nullable else ' NOT NULL'}")
    if table.key:
        parts.append(f"PRIMARY KEY ({', '.join(map(quoted, table.key))})")
    made = [f"CREATE TABLE {name} ({', '.join(parts)})"]
    for x in table.indexes:
        columns = ", ".join(f"{quoted(c)}{'' if up else ' DESC'}" for c, up in x.columns)
        made.append(f"CREATE {'UNIQUE ' if x.unique else ''}INDEX {quoted(index_name(x.name))} ON {name} ({columns})")
    return made
