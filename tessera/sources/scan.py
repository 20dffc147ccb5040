"""Files and addresses as tables in FROM and JOIN.

``FROM 'a.parquet'``, ``FROM /data/a.csv x``, ``JOIN s3a://b/c.parquet``, ``FROM ['a.csv',
'b.csv']``, comma lists of these, and ``remote('...')`` or ``remote(['...', '...'])``
are registered as sources and replaced by their names. Strings and comments
elsewhere are left alone.
"""

from __future__ import annotations

import re

from ..errors import InvalidInput
from .catalog import Catalog, file_kind

_SKIP = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)
_WORD = re.compile(r"[A-Za-z_]\w*")
_BARE = re.compile(r"[^\s,()\[\]'\";]+")
_SPACE = re.compile(r"(?:\s+|--[^\n]*|/\*.*?\*/)*", re.S)
_ALIAS = re.compile(r"(?:as\s+)?(?P<name>[A-Za-z_]\w*|\"[^\"]*\")", re.I)
#: Words that end a table item, so that they are no alias of it.
_STOPS = frozenset("on using where group having order limit offset join inner left right full outer cross semi anti natural union except intersect as from set window qualify tablesample lateral".split())


def _quoted(text: str) -> str:
    return text[1:-1].replace("''", "'")


def _is_source(text: str) -> bool:
    return file_kind(text) is not None or "://" in text


def _list(sql: str, at: int) -> tuple[list[str], int]:
    """The entries of a bracket list that begins at ``at``, and its end."""
    entries, at = [], at + 1
    while True:
        at = _SPACE.match(sql, at).end()
        if at >= len(sql):
            raise InvalidInput("a list of files is not closed")
        if sql[at] == "]":
            return entries, at + 1
        if sql[at] == ",":
            at += 1
        elif sql[at] == "'":
            m = _SKIP.match(sql, at)
            entries.append(_quoted(m.group()))
            at = m.end()
        elif m := _BARE.match(sql, at):
            entries.append(m.group())
            at = m.end()
        else:
            raise InvalidInput(f"unexpected {sql[at]!r} in a list of files")


def _source(sql: str, at: int) -> tuple[list[str], int] | None:
    """Paths of the source that begins at ``at`` and where it ends, if one does."""
    if m := re.compile(r"remote\s*\(", re.I).match(sql, at):
        at = _SPACE.match(sql, m.end()).end()
        if sql[at : at + 1] == "[":
            paths, end = _list(sql, at)
        elif sql[at : at + 1] == "'":
            q = _SKIP.match(sql, at)
            paths, end = [_quoted(q.group())], q.end()
        else:
            b = _BARE.match(sql, at)
            if not b:
                raise InvalidInput("remote() without a file")
            paths, end = [b.group()], b.end()
        end = _SPACE.match(sql, end).end()
        if sql[end : end + 1] != ")":
            raise InvalidInput("remote() is not closed")
        return paths, end + 1
    if sql[at : at + 1] == "[":
        paths, end = _list(sql, at)
        return (paths, end) if paths and all(map(_is_source, paths)) else None
    if sql[at : at + 1] == "'":
        m = _SKIP.match(sql, at)
        return ([_quoted(m.group())], m.end()) if m and _is_source(_quoted(m.group())) else None
    if (m := _BARE.match(sql, at)) and _is_source(m.group()) and ("/" in m.group() or m.group().count(".") == 1 and file_kind(m.group())):
        return [m.group()], m.end()
    return None


def rewrite(sql: str, catalog: Catalog) -> str:
    """``sql`` with its files registered in ``catalog`` and named."""
    out, at, last = [], 0, 0
    while at < len(sql):
        if m := _SKIP.match(sql, at):
            at = m.end()
        elif m := _WORD.match(sql, at):
            at = m.end()
            if m.group().lower() not in ("from", "join"):
                continue
            while True:  # the items of a comma list
                start = _SPACE.match(sql, at).end()
                found = _source(sql, start)
                if found is None:
                    break
                source = catalog.add_files(found[0])
                out += [sql[last:start], source.name]
                at = last = found[1]
                after = _SPACE.match(sql, at).end()
                alias = _ALIAS.match(sql, after)
                if alias and alias.group("name").lower() not in _STOPS:
                    after = _SPACE.match(sql, alias.end()).end()
                if sql[after : after + 1] != ",":
                    break
                at = after + 1
        else:
            at += 1
    return "".join([*out, sql[last:]])
