"""Text expressions: file names, quoting, HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Last component without its last extension; a leading dot is no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def shorten_folder(text: Column, folder: str) -> Column:
    """Replace a folder path by its last component wherever it occurs."""
    last = folder.rstrip("/").rsplit("/", 1)[-1]
    return F.replace(text, F.lit(folder), F.lit(last))


def strip_quotes(text: Column) -> Column:
    """Remove both quote characters anywhere."""
    return F.translate(text, "\"'", "")


# The non-printing part of Latin-1, and its short escapes.
_CONTROLS = r"[\x00-\x1f\x7f-\xa0\xad]"
_SHORT_ESCAPES = (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def _escape_controls(text: Column) -> Column:
    """Backslash escapes for the non-printing part of Latin-1."""
    for char, escape in _SHORT_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escape))

    def escaped(char: Column) -> Column:
        code = F.lpad(F.lower(F.hex(F.ascii(char))), 2, "0")
        return F.when(char.rlike(_CONTROLS), F.concat(F.lit("\\x"), code)).otherwise(char)

    spelled = F.array_join(F.transform(F.split(text, ""), escaped), "")
    return F.when(text.rlike(_CONTROLS), spelled).otherwise(text)


def quoted_literal(text: Column) -> Column:
    """A string as it is written inside a tuple text.

    Single quotes, unless the text holds a single but no double quote; NULL is
    written ``None``.  Backslashes and non-printing Latin-1 are escaped.
    """
    body = _escape_controls(F.replace(text, F.lit("\\"), F.lit("\\\\")))
    has_single, has_double = text.contains("'"), text.contains('"')
    return (
        F.when(text.isNull(), F.lit("None"))
        .when(has_single & ~has_double, F.concat(F.lit('"'), body, F.lit('"')))
        .when(
            has_single,
            F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")),
        )
        .otherwise(F.concat(F.lit("'"), body, F.lit("'")))
    )


# Characters that would end text or an attribute.
HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escaped_sql(value: str) -> str:
    """SQL: a text with HTML's special characters escaped."""
    return reduce(lambda sql, e: f"replace({sql}, '{e[0]}', '{e[1]}')", HTML_ENTITIES, value)


def cell_sql(name: str, is_double: bool) -> str:
    """SQL: a table cell; whole numbers without decimals, NULL as empty."""
    if is_double:
        whole = f"if({name} = floor({name}), cast(cast({name} as bigint) as string), null)"
        return f"coalesce({whole}, cast({name} as string), '')"
    return f"coalesce({escaped_sql(f'cast({name} as string)')}, '')"


def row_sql(cells: list[str]) -> str:
    """SQL: one HTML table row."""
    return "concat('<tr>', " + ", ".join(f"'<td>', {c}, '</td>'" for c in cells) + ", '</tr>')"


# Outcomes of linking a stylesheet into a page.
LINKED = "ok"
NO_STYLE = "no_style"
NO_STYLESHEET = "no_stylesheet"


def stylesheet_status(html: Column) -> Column:
    """Whether a page can take a stylesheet link, and why not."""
    return (
        F.when(~html.contains("style"), NO_STYLE)
        .when(~html.contains("stylesheet"), NO_STYLESHEET)
        .otherwise(LINKED)
    )


def link_stylesheet(html: Column, sheet_name: str) -> Column:
    """Insert a stylesheet link after the last line that mentions one.

    NULL when no line does.  The greedy prefix runs to the last mention and the
    rest of that line, so the page is scanned once and never split into lines.
    """
    link = f'\n    <link rel="stylesheet" href="{sheet_name}"/>'
    safe = link.replace("\\", "\\\\").replace("$", "\\$")
    linked = F.regexp_replace(html, r"(?s)\A(.*stylesheet[^\n]*)", f"$1{safe}")
    return F.when(stylesheet_status(html) == LINKED, linked)
