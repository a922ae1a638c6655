"""Text rules shared by Spark code and the DuckDB oracle.

Java regex (Spark) and RE2 (DuckDB) differ from Python's ``re`` in a few
places; the patterns below are written so all engines agree:
  * word characters are spelled ``[\\p{L}\\p{N}_]`` (Python's Unicode ``\\w``),
  * whitespace is spelled out as ASCII (Java's ``\\s`` is ASCII, Python's is not),
  * Python's ``str.strip()`` set of whitespace is passed to ``trim`` explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word tokenizer of the built-in tokenizer slot.
WORD_TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\t\n\x0B\f\r \p{L}\p{N}_]"

# Characters Python's str.strip() removes (ASCII and Unicode
# whitespace), in code point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Line boundaries of Python's str.splitlines().
PY_LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def py_strip(c: Column) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.trim(c, F.lit(PY_WHITESPACE))


def sql_literal(s: str) -> str:
    """A DuckDB/ANSI string literal."""
    return "'" + s.replace("'", "''") + "'"
