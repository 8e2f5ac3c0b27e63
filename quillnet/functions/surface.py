"""Functions for Spark SQL: ``register(spark)`` makes them callable by name in a session.

Scalar and table functions are SQL themselves, so that Catalyst sees through them; only the page reader is Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillnet.functions.elements import HtmlElements

#: Each creates one function.
STATEMENTS = (
    """decade(year INT) RETURNS INT COMMENT 'the decade of a four-digit year, else 0'
    RETURN CASE WHEN length(CAST(year AS STRING)) = 4 THEN year - pmod(year, 10) ELSE 0 END""",
    r"""squash_ws(s STRING) RETURNS STRING COMMENT 'runs of white space as one space, none at the ends'
    RETURN trim(regexp_replace(s, '[\\s\\p{Z}]+', ' '))""",
    """pos_class(tag STRING) RETURNS STRING COMMENT 'class of a part-of-speech tag'
    RETURN (SELECT CASE WHEN t LIKE 'V%' THEN 'V' WHEN t LIKE 'Adj%' THEN 'Adj' WHEN t LIKE 'Adv%' THEN 'Adv' ELSE split_part(t, '_', 1) END
            FROM (SELECT split_part(translate(tag, '/[]', ''), '|', 1) AS t))""",
    """disparity_integral(x DOUBLE, k DOUBLE) RETURNS DOUBLE COMMENT 'null where x or k is 1'
    RETURN CASE WHEN x <> 1 AND k <> 1 THEN pow(1 - x, k) / ((k - 1) * (x - 1)) END""",
    """disparity_significance(share DOUBLE, degree DOUBLE) RETURNS DOUBLE COMMENT 'alpha of an edge that has this share of its end; null where the share or the degree is 1'
    RETURN 1 - (degree - 1) * (disparity_integral(share, degree) - disparity_integral(0, degree))""",
    """clamp_distance(x DOUBLE, at DOUBLE) RETURNS DOUBLE RETURN least(abs(at - x), at)""",
    """vec_len(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1e-9D + sqrt(aggregate(v, 0D, (s, c) -> s + c * c))""",
    """cylinder(x1 DOUBLE, y1 DOUBLE, z1 DOUBLE, x2 DOUBLE, y2 DOUBLE, z2 DOUBLE)
    RETURNS STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, length: DOUBLE, phi: DOUBLE, theta: DOUBLE> COMMENT 'middle, length and direction of the cylinder between two points'
    RETURN (SELECT named_struct('x', (x1 + x2) / 2, 'y', (y1 + y2) / 2, 'z', (z1 + z2) / 2, 'length', d, 'phi', atan2(y2 - y1, x2 - x1), 'theta', acos((z2 - z1) / d))
            FROM (SELECT sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2) + pow(z2 - z1, 2)) AS d))""",
    """expand_path(points ARRAY<ARRAY<DOUBLE>>, n INT) RETURNS ARRAY<ARRAY<DOUBLE>> COMMENT 'a path as n points that are evenly spaced by its numbering'
    RETURN transform(sequence(0, n - 1), k -> transform(points[0], (_, c) ->
        points[CAST(floor(k * (size(points) - 1) / (n - 1)) AS INT)][c]
        + (points[least(CAST(floor(k * (size(points) - 1) / (n - 1)) AS INT) + 1, size(points) - 1)][c] - points[CAST(floor(k * (size(points) - 1) / (n - 1)) AS INT)][c])
        * (k * (size(points) - 1) / (n - 1) - floor(k * (size(points) - 1) / (n - 1)))))""",
    """lattice(n BIGINT) RETURNS TABLE (id BIGINT, x BIGINT, y BIGINT, z BIGINT) COMMENT 'the points of a cubic grid'
    RETURN SELECT i + n * (j + n * k), i, j, k FROM (SELECT explode(sequence(0L, n - 1)) AS i) a, (SELECT explode(sequence(0L, n - 1)) AS j) b, (SELECT explode(sequence(0L, n - 1)) AS k) c""",
    """page_links(page STRING) RETURNS TABLE (ord INT, href STRING, text STRING) COMMENT 'anchors with an href'
    RETURN SELECT ord, coalesce(attrs['href'], ''), squash_ws(text) FROM html_elements(page, 'a') WHERE map_contains_key(attrs, 'href')""",
    r"""label_values(page STRING) RETURNS TABLE (label STRING, value STRING) COMMENT 'labels of table rows with each line of the cell beside them'
    RETURN SELECT regexp_replace(label, '[^\\p{L}\\p{N}_]+', ''), squash_ws(line)
    FROM (SELECT label, explode(split(value, '\n')) AS line
          FROM (SELECT parent, ord, tag, attrs, text AS label, lead(text) OVER (PARTITION BY parent ORDER BY ord) AS value FROM html_elements(page, 'td,th'))
          WHERE value IS NOT NULL AND (tag = 'th' OR array_contains(split(coalesce(attrs['class'], ''), '\\s+'), 'attrLabels')))
    WHERE squash_ws(line) <> ''""",
)


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session (again, if they are there) and returns their names."""
    spark.udtf.register("html_elements", HtmlElements)
    for s in STATEMENTS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {s}")
    return ["html_elements", *(s.split("(")[0].strip() for s in STATEMENTS)]
