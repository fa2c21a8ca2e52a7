"""SQL of the digest trees."""

from __future__ import annotations

from graphlore.operators import merkle


def tree_sql(rows: str, name: str) -> str:
    """Nodes of the tree over ``rows`` (key, h), for any depth up to six."""
    parts = [f"{name}_d AS (SELECT count(*) AS n, CASE {' '.join(f'WHEN count(*) <= {merkle.LEAF * 16**d} THEN {d}' for d in range(6))} ELSE 6 END AS d FROM {rows})"]
    for level in range(6, -1, -1):
        leaf = f"SELECT substr(sha256(key), 1, {level}) AS prefix, sha256(string_agg(key || ':' || h, chr(10) ORDER BY encode(key), h)) AS digest, count(*) AS n FROM {rows}, {name}_d WHERE d = {level} GROUP BY 1"
        if level == 6:
            parts.append(f"{name}_6 AS ({leaf})")
        else:
            parts.append(f"{name}_{level} AS ({leaf} UNION ALL SELECT substr(prefix, 1, {level}), sha256(string_agg(substr(prefix, {level + 1}, 1) || ':' || digest, chr(10) ORDER BY prefix)), sum(n) FROM {name}_{level + 1} GROUP BY 1)")
    return ", ".join(parts)
