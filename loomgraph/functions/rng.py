"""Counter-based randomness: the first 32 bits of md5 over a tag and counters, the same on every engine and partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(tag: str, *counters: Column | str) -> Column:
    """Uniform BIGINT below 2**32."""
    keys = [F.col(c) if isinstance(c, str) else c for c in counters]
    text = F.concat_ws("|", F.lit(tag), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def u32_sql(tag: str, *counters: str) -> str:
    """The same number in plain SQL."""
    return f"('0x'||substr(md5(concat_ws('|','{tag}',{','.join(f'({c})::VARCHAR' for c in counters)})),1,8))::BIGINT"


def below(n: Column, tag: str, *counters: Column | str) -> Column:
    """Uniform BIGINT below n, from 62 bits: two words, so that nothing beyond 2**32 stays undrawn."""
    return (u32(tag, *counters) * 1073741824 + u32(f"{tag}+", *counters) % 1073741824) % n


def below_sql(n: str, tag: str, *counters: str) -> str:
    """The same number in plain SQL."""
    return f"(({u32_sql(tag, *counters)} * 1073741824 + {u32_sql(f'{tag}+', *counters)} % 1073741824) % {n})"


def below_py(n: int, tag: str, *counters: int) -> int:
    """The same number inside a task."""
    word = lambda t: int(hashlib.md5("|".join([t, *map(str, counters)]).encode(), usedforsecurity=False).hexdigest()[:8], 16)
    return (word(tag) * 1073741824 + word(f"{tag}+") % 1073741824) % n
