"""Pieces of SQL that checks share."""

#: The table of the byte-wise CRC-32, for SQL.
CRC_TABLE = "(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i))"


def crc_sql(numbers, tab="tab"):
    """The unsigned CRC-32 of a list of byte values."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, x: xor(c >> 8, {tab}[(xor(c, x) & 255) + 1])), 4294967295)"
