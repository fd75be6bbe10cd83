"""The law of `sharding` as SQL."""

from __future__ import annotations

from callwarden.llm.sharding import _P, round_keys


def _mixed(value: str, key: int) -> str:
    g = f"(({value}) * 48271 + {key}) % {_P}"
    return f"((({g}) * ({g})) % {_P} + ({g})) % {_P}"


def _permute(source: str, seed: int) -> str:
    """(doc_id, size, text_crc32, n, a, b, v) of a source with the same columns, v permuted once."""
    kept = "doc_id, size, text_crc32, n, a, b"
    sql = f"SELECT {kept}, v % a AS x, v // a AS y FROM {source}"
    keys = round_keys(seed)
    for k, l in zip(keys[::2], keys[1::2], strict=True):
        sql = f"SELECT {kept}, (x + {_mixed('y', k)}) % a AS x, y FROM ({sql}) s"
        sql = f"SELECT {kept}, x, (y + {_mixed('x', l)}) % b AS y FROM ({sql}) s"
    return f"SELECT {kept}, y * a + x AS v FROM ({sql}) s"


def sharding_sql(shards: int, seed: int = 42) -> str:
    table = (
        "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    )
    value = lambda at: f"(strpos('0123456789ABCDEF', d[{at}]) - 1)"
    return f"""
WITH RECURSIVE crc_table AS (SELECT {table} AS t),
digits AS (SELECT doc_id, string_split(coalesce(hex(encode(text)), ''), '') AS d, coalesce(octet_length(encode(text)), 0) AS n_bytes FROM documents),
summed AS (SELECT doc_id, n_bytes + 8 AS size, xor(list_reduce(
    list_concat([4294967295], list_transform(range(n_bytes), lambda i: {value("2 * i + 1")} * 16 + {value("2 * i + 2")})),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32 FROM digits, crc_table),
sized AS (SELECT *, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM documents) c),
numbered AS (SELECT doc_id, size, text_crc32, n, a, b, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS v FROM summed, sized),
walk AS ({_permute("numbered", seed)} UNION ALL {_permute("(SELECT * FROM walk WHERE v >= n)", seed)})
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(v % {shards} AS INTEGER) AS shard,
  CAST(v // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE v < n"""
