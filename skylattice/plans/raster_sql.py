"""SQL fragments for raster neighbourhood steps, shared by the comparison statements.

They state each step the direct way (self-joins, recursion) rather than the way the Spark
operators do it.
"""

from __future__ import annotations


def _on(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))


def opening_sql(src: str, dst: str, keys: str = "chip_id") -> str:
    """CTEs that open ``src`` (keys, y, x) with a 3 x 3 square into ``dst``."""
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
    {dst}_e AS (SELECT {cols}, a.y, a.x FROM {src} a JOIN {src} b ON {_on(keys, 'a', 'b')} AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 9),
    {dst} AS (SELECT DISTINCT {cols}, a.y, a.x FROM {src} a JOIN {dst}_e b ON {_on(keys, 'a', 'b')} AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)"""


def labels_sql(src: str, dst: str, keys: str = "chip_id") -> str:
    """CTEs that label ``src`` into ``dst`` (keys, y, x, label) with the smallest pixel id; needs WITH RECURSIVE."""
    cols = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""
    {dst}_w({keys}, y, x, id) AS (SELECT {cols}, s.y, s.x, s.y::BIGINT * 4294967296 + s.x FROM {src} s
      UNION SELECT {cols}, s.y, s.x, w.id FROM {dst}_w w JOIN {src} s ON {_on(keys, 'w', 's')} AND abs(s.y - w.y) <= 1 AND abs(s.x - w.x) <= 1 AND w.id < s.y::BIGINT * 4294967296 + s.x),
    {dst} AS (SELECT {keys}, y, x, min(id) AS label FROM {dst}_w GROUP BY ALL)"""


def threshold_sql(field: str, dst: str, ks: str, keys: str = "chip_id") -> str:
    """CTEs ``dst`` (keys, k, y, x, value): pixels of ``field`` at or above median + k sigma."""
    return f"""
    {dst}_m AS (SELECT {keys}, median(value) AS med FROM {field} WHERE value IS NOT NULL GROUP BY {keys}),
    {dst}_s AS (SELECT {keys}, any_value(med) AS med, 1.4826 * median(abs(value - med)) AS sig FROM {field} JOIN {dst}_m USING ({keys}) GROUP BY {keys}),
    {dst} AS (SELECT {keys}, k, y, x, value FROM {field} JOIN {dst}_s USING ({keys}) CROSS JOIN (SELECT unnest([{ks}]) AS k) WHERE sig > 0 AND value >= med + k * sig)"""


def select_sql(labels: str, field: str, dst: str, keys: str = "chip_id", source: str | None = None, min_area: int = 5) -> str:
    """CTEs ``dst`` (keys, k, y, x, label): the chosen components; ``source`` is (keys, sy, sx)."""
    near = "false" if source is None else "coalesce(abs(y - sy) <= 3 AND abs(x - sx) <= 3, false)"
    join = "" if source is None else f"LEFT JOIN {source} USING ({keys})"
    return f"""
    {dst}_c AS (SELECT {keys}, k, label, count(*) AS size, bool_or({near}) AS near, max({{'v': value, 'ny': -y, 'nx': -x}}) AS peak
      FROM {labels} JOIN {field} USING ({keys}, y, x) {join} GROUP BY {keys}, k, label HAVING count(*) >= {min_area}),
    {dst}_t AS (SELECT *, bool_or(near) OVER (PARTITION BY {keys}, k) AS any_near, max(peak) OVER (PARTITION BY {keys}, k) AS top FROM {dst}_c),
    {dst} AS (SELECT l.* FROM {labels} l JOIN {dst}_t t USING ({keys}, k, label) WHERE CASE WHEN any_near THEN near ELSE peak = top END)"""


def plume_sql(field: str, dst: str, ks: str, keys: str = "chip_id", source: str | None = None) -> str:
    """Threshold, opening, labels and selection chained; needs WITH RECURSIVE."""
    kk = f"{keys}, k"
    return ", ".join([
        threshold_sql(field, f"{dst}_th", ks, keys), opening_sql(f"{dst}_th", f"{dst}_op", kk),
        labels_sql(f"{dst}_op", f"{dst}_lb", kk), select_sql(f"{dst}_lb", field, dst, keys, source),
    ])


def retrieval_sql(src: str, dst: str, keys: str, robust: bool) -> str:
    """CTEs ``dst``: ``src`` (keys, y, x, b11, b12, excl) with delta_r, c, c_initial, n_excluded."""
    sigma = (
        f"{dst}_a AS (SELECT {keys}, median(CASE WHEN ok THEN dr0 END) AS mid FROM {dst}_d GROUP BY {keys}), "
        f"{dst}_b AS (SELECT {keys}, any_value(mid) AS mid, 1.4826 * median(CASE WHEN ok THEN abs(dr0 - mid) END) AS sig FROM {dst}_d JOIN {dst}_a USING ({keys}) GROUP BY {keys})"
        if robust else
        f"{dst}_b AS (SELECT {keys}, 0.0 AS mid, stddev_pop(CASE WHEN ok THEN dr0 END) AS sig FROM {dst}_d GROUP BY {keys})"
    )
    return f"""
    {dst}_v AS (SELECT *, b11 IS NOT NULL AND b12 IS NOT NULL AND NOT coalesce(excl, false) AS ok FROM {src}),
    {dst}_0 AS (SELECT {keys}, sum(CASE WHEN ok THEN b11 * b12 END) / nullif(sum(CASE WHEN ok THEN b12 * b12 END), 0) AS c0 FROM {dst}_v GROUP BY {keys}),
    {dst}_d AS (SELECT v.*, c0, (c0 * b12 - b11) / nullif(b11, 0) AS dr0 FROM {dst}_v v JOIN {dst}_0 USING ({keys})), {sigma},
    {dst}_1 AS (SELECT {keys}, any_value(sig) AS sig, count(CASE WHEN ok AND abs(dr0 - mid) <= sig THEN 1 END) AS n, count(CASE WHEN ok AND abs(dr0 - mid) > sig THEN 1 END) AS nout,
      sum(CASE WHEN ok AND abs(dr0 - mid) <= sig THEN b11 * b12 END) / nullif(sum(CASE WHEN ok AND abs(dr0 - mid) <= sig THEN b12 * b12 END), 0) AS c1 FROM {dst}_d JOIN {dst}_b USING ({keys}) GROUP BY {keys}),
    {dst} AS (SELECT d.*, CASE WHEN sig IS NOT NULL AND n >= 3 THEN c1 ELSE c0 END AS c, c0 AS c_initial, CASE WHEN sig IS NOT NULL AND n >= 3 THEN nout ELSE 0 END AS n_excluded,
      (CASE WHEN sig IS NOT NULL AND n >= 3 THEN c1 ELSE c0 END * b12 - b11) / nullif(b11, 0) AS delta_r FROM {dst}_d d JOIN {dst}_1 USING ({keys}))"""
