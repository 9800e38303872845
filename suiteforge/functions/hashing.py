"""H4/H5: content hashes used as cache keys.

* plain text (a prompt string, a solution): ``sha2(text, 256)`` -- identical
  bytes to hashing the UTF-8 text, JVM-side;
* chat messages (``array<struct<role, content>>``): sha256 of the compact,
  key-sorted JSON of the list, non-ASCII text escaped as ``\\uXXXX`` (UTF-16,
  so characters beyond the first plane as surrogate pairs).  ``messages_key``
  builds these bytes with column functions; ``messages_key_compat`` is a small
  Arrow-batched helper that gives the same keys.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def text_key(text: Column | str) -> Column:
    """H4/H5: sha256 hex of a string."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


# fixed values: JSON's short escapes
SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))


def json_ascii(s: Column) -> Column:
    """A string as ASCII JSON text, ``null`` for null; only texts that need it are taken apart."""

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        over = n - 0x10000
        out = F
        for char, short in SHORT_ESCAPES.items():
            out = out.when(c == char, short)
        pair = F.concat(_unit(F.shiftright(over, 10) + 0xD800), _unit(over.bitwiseAND(0x3FF) + 0xDC00))
        return out.when(n.between(0x20, 0x7E), c).when(n > 0xFFFF, pair).otherwise(_unit(n))

    plain = ~s.rlike(r'[^\x20-\x7E]|["\\]')
    text = F.when(plain, s).otherwise(F.array_join(F.transform(F.split(s, ""), escaped), ""))
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def messages_json(messages: Column | str) -> Column:
    """The compact JSON text of a list of messages, keys sorted (``content`` before ``role``), null for null."""
    m = F.col(messages) if isinstance(messages, str) else messages
    one = lambda x: F.concat(F.lit('{"content":'), json_ascii(x["content"]), F.lit(',"role":'), json_ascii(x["role"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(m, one), ","), F.lit("]"))


def messages_key(messages: Column | str) -> Column:
    """H4 (messages path): sha256 of :func:`messages_json`, exact for any text."""
    return F.sha2(messages_json(messages), 256)


@F.pandas_udf(StringType())
def messages_key_compat(messages: pd.Series) -> pd.Series:
    """H4 (messages path, exact bytes incl. non-ASCII escaping), one Arrow batch at a time."""

    def one(msgs):
        if msgs is None:
            return None
        rows = [{"role": r["role"], "content": r["content"]} for r in msgs]
        s = json.dumps(rows, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(s.encode("utf-8")).hexdigest()

    return messages.map(one)
