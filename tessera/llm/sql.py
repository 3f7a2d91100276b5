"""Parts of the operators' SQL."""


def crc32(names: str, text: str = "x") -> str:
    """CTEs tab and crc: a table names with the text column x, and the crc32 of its UTF-8 bytes, a step a byte; the table by its rule."""
    return f"""tab as (select list_transform(range(256), lambda n: list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
crc as (select x, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), (2 * i + 1)::int, 2))::bigint)),
   lambda c, y: xor(c >> 8, tab[(xor(c & 255, y) + 1)::int])), 4294967295) as crc from (select {text} as x, encode({text}) as b from {names}), tab)"""
