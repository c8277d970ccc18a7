"""crc32 of short strings in DuckDB's SQL, which has no such function."""

#: CTEs of the table of the 256 remainders of the reflected polynomial 0xEDB88320; ``WITH RECURSIVE`` goes before.
CRC32_CTES = """crcbits AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crcbits WHERE k < 8),
crctab AS (SELECT list(c ORDER BY i) AS remainders FROM crcbits WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII string; the query joins ``crctab``."""
    codes = f"list_transform(string_split({text}, ''), lambda q: CAST(unicode(q) AS BIGINT))"
    return (f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), "
            "lambda c, b: xor(c >> 8, remainders[xor(c & 255, b) + 1])))")
