"""Views that present the star-schema tables as raster, deep-sample and metadata inputs."""

from __future__ import annotations

#: name: (tables, SQL); {idiv} is integer division in the dialect at hand.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "deep": (("lineitem",), "SELECT CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS src, l_orderkey {idiv} 64 AS y, l_orderkey % 64 AS x, l_linenumber AS s, l_quantity AS z, l_quantity + 10 * l_tax AS zback, 10 * l_discount AS a, l_extendedprice * cast(0.00001 as double) AS r, l_tax AS g, l_discount AS b FROM lineitem"),
    "rgb": (("embeddings",), "SELECT vec_id AS y, k AS x, cast(embedding[{base} + 3 * k] as double) AS r, cast(embedding[{base} + 3 * k + 1] as double) AS g, cast(embedding[{base} + 3 * k + 2] as double) AS b FROM embeddings CROSS JOIN (SELECT {range21}) ks"),
    "plane": (("embeddings",), "SELECT vec_id AS y, k AS x, cast(embedding[{base} + k] as double) AS v FROM embeddings CROSS JOIN (SELECT {range64}) ks"),
    "dirs": (("embeddings",), "SELECT vec_id, cast(embedding[{base}] as double) AS dx, cast(embedding[{base} + 1] as double) AS dy, cast(embedding[{base} + 2] as double) AS dz FROM embeddings"),
    "names": (("part",), "SELECT DISTINCT p_name AS name FROM part"),
    "channels": (("orders",), "SELECT DISTINCT concat(lower(substr(o_orderpriority, 3)), '.', CASE o_orderstatus WHEN 'F' THEN 'left' WHEN 'O' THEN 'right' ELSE 'mid' END, '.', c) AS name FROM orders CROSS JOIN (SELECT {rgba}) cs"),
    "timecode": (("events",), "SELECT event_id, cast({hour} as bigint) AS hh, cast({minute} as bigint) AS mm, cast({second} as bigint) AS ss, cast(({micros} * 30) {idiv} 1000000 as bigint) AS ff FROM events"),
    "manifest": (("part",), "SELECT p_partkey AS id, p_name AS v1, p_brand AS v2 FROM part"),
    "attributes": (("events",), "SELECT event_id, 'k' AS key, {prop} AS value FROM events"),
    "windows": (("orders",), "SELECT o_custkey, min(o_orderkey % 640) AS minx, min(o_orderkey {idiv} 640) AS miny, max(o_orderkey % 640) AS maxx, max(o_orderkey {idiv} 640) AS maxy FROM orders GROUP BY o_custkey"),
    "bytes": (("documents",), "SELECT doc_id, pos, {code} % 256 AS b FROM {chars}"),
}
SPARK = {"idiv": "div", "base": "0", "range21": "explode(sequence(0, 20)) AS k", "range64": "explode(sequence(0, 63)) AS k", "rgba": "explode(array('R', 'G', 'B', 'A')) AS c", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "micros": "(unix_micros(cast(ts as timestamp)) % 1000000)", "prop": "get_json_object(props, '$.k')", "code": "ascii(c)", "chars": "documents LATERAL VIEW posexplode(split(text, '')) t AS pos, c"}
DUCK = {"idiv": "//", "base": "1", "range21": "unnest(range(21)) AS k", "range64": "unnest(range(64)) AS k", "rgba": "unnest(['R', 'G', 'B', 'A']) AS c", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "micros": "(epoch_us(ts) % 1000000)", "prop": "json_extract_string(props, '$.k')", "code": "unicode(c)", "chars": "(SELECT doc_id, unnest(range(len(cs))) AS pos, unnest(cs) AS c FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM documents) q) t"}
