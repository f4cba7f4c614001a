"""SQL of the training-data operators that it can express, over the tables as given."""

#: crc32 of a decimal number: a table of 256 entries, then a byte at a time.
CRC_TABLE = """
    bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc32(column: str) -> str:
    digits = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {digits}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


ORACLE_SQL = {
    "op11_prefix_trie": f"""
WITH RECURSIVE {CRC_TABLE},
    own AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, {crc32("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table),
    turns AS (
        SELECT c.conv_id, 0 AS part, rn, role, text FROM convs c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 5 AND rn <= h
        UNION ALL SELECT c.conv_id, 1, rn, role, text FROM convs c JOIN own ON own.conv_id = c.conv_id AND rn > h),
    paths AS (
        SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(concat(strlen(role), ':', role, text)), '') OVER w AS path, strlen(text) AS bytes
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, rn ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    nodes AS (SELECT path, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN path <> '' THEN left(path, length(path) - 32) END AS above FROM paths GROUP BY path),
    kids AS (SELECT above AS path, count(*) AS n_children FROM nodes GROUP BY above),
    sums AS (
        SELECT left(n.path, 32 * k) AS path, count(*) FILTER (kids.path IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
        FROM nodes n LEFT JOIN kids ON kids.path = n.path, unnest(range(n.depth + 1)) u(k) GROUP BY 1),
    ends AS (
        SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.above LEFT JOIN kids ON kids.path = n.path JOIN sums ON sums.path = n.path LEFT JOIN ends ON ends.path = n.path""",
    "op12_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
    h AS (SELECT *, list_transform(range(4), lambda k: CAST('0x' || substr(sha1(payload), CAST(10 * k + 1 AS INTEGER), 10) AS BIGINT)) AS parts FROM p)
SELECT page_id, strlen(payload) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((parts[1 + k // 8] >> CAST(35 - 5 * (k % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h""",
}
