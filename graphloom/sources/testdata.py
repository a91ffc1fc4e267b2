"""Code-graph tables derived from the star-schema test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Orders are modules too, numbered from here.
ORDER_BASE = 1_000_000_000_000

#: Adapter name -> SQL over {tables} and other adapters.
ADAPTERS = {
    "module": """
        SELECT p_partkey AS module_id,
               CASE WHEN p_partkey % 61 = 7 THEN 'virtual:m' || CAST(p_partkey AS STRING)
                    WHEN p_partkey % 53 = 9 THEN 'conf/m' || CAST(p_partkey AS STRING) || '/next.config.js'
                    ELSE CASE p_partkey % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'pages' WHEN 2 THEN 'app' WHEN 3 THEN 'lib' ELSE 'dist' END
                         || '/d' || CAST(p_partkey % 7 AS STRING) || '/m' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 23 = 5 THEN '.test' ELSE '' END
                         || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' ELSE '.vue' END END AS path,
               CAST(floor(p_retailprice * 10) AS BIGINT) AS size, p_size % 3 = 0 AS has_side_effects, p_partkey % 50 = 0 AS is_entry
        FROM {part}
        UNION ALL SELECT {order_base} + o_orderkey, CASE WHEN o_orderkey % 71 = 11 THEN 'virtual:o' ELSE 'log/c' || CAST(o_custkey AS STRING) || '/o' END || CAST(o_orderkey AS STRING) || '.ts',
               CAST(floor(o_totalprice) AS BIGINT), o_orderkey % 4 = 0, o_orderkey % 50 = 0
        FROM {orders}""",
    # every pair of neighbouring line items, the next order of the same customer, and a package of every order
    "import": """
        SELECT a.l_partkey AS module_id, b.l_partkey AS resolved_to, b.l_partkey AS target, CASE a.l_returnflag WHEN 'R' THEN 'Dynamic' WHEN 'A' THEN 'TypeOnly' ELSE 'Static' END AS kind,
               CAST(min(b.l_linenumber) AS BIGINT) AS line, max(CASE WHEN p.p_size > 45 THEN 1 ELSE 0 END) = 1 AS is_external,
               CASE WHEN max(p.p_size) <= 45 THEN './m' || CAST(b.l_partkey AS STRING) WHEN b.l_partkey % 3 = 0 THEN '@scope/pkg' || CAST(b.l_partkey % 40 AS STRING) || '/sub' WHEN b.l_partkey % 3 = 1 THEN 'react'
                    ELSE 'pkg' || CAST(b.l_partkey % 60 AS STRING) || '/x' END AS source
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN {part} p ON p.p_partkey = b.l_partkey
        WHERE a.l_partkey <> b.l_partkey
        GROUP BY a.l_partkey, b.l_partkey, a.l_returnflag
        UNION ALL SELECT {order_base} + o_orderkey, {order_base} + later, later, CASE o_orderstatus WHEN 'F' THEN 'Dynamic' WHEN 'O' THEN 'Static' ELSE 'TypeOnly' END, o_orderkey % 5 + 1, FALSE, './o' || CAST(later AS STRING)
        FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM {orders}) o WHERE later IS NOT NULL
        UNION ALL SELECT {order_base} + o_orderkey, CAST(NULL AS BIGINT), o_custkey, 'Static', o_orderkey % 5 + 1, TRUE, CASE o_custkey % 3 WHEN 0 THEN '@scope/pkg' || CAST(o_custkey % 50 AS STRING) WHEN 1 THEN 'pkg' || CAST(o_custkey % 90 AS STRING) ELSE 'react/jsx' END
        FROM {orders}""",
    "specifier": """
        SELECT module_id, resolved_to, kind, source, line, is_external,
               CASE WHEN kind = 'Dynamic' OR line % 4 = 0 THEN 'None' WHEN line % 4 = 1 THEN 'Default' WHEN line % 4 = 2 THEN 'Named' ELSE 'Namespace' END AS specifier,
               CASE line % 4 WHEN 1 THEN 'default' WHEN 2 THEN CASE WHEN target % 11 = 3 AND target % 2 = 0 THEN 're' ELSE 'useThing' END || CAST(target AS STRING) WHEN 3 THEN '*' ELSE '' END AS name
        FROM {import}""",
    "edge": """
        SELECT DISTINCT module_id AS src, resolved_to AS dst FROM {import} WHERE resolved_to IS NOT NULL""",
    # with rings of three orders besides
    "ring": """
        SELECT src, dst FROM {edge}
        UNION SELECT {order_base} + o_orderkey, {order_base} + o_orderkey + 1 FROM {orders} WHERE o_orderkey % 97 < 2 AND o_orderkey + 2 < (SELECT count(*) FROM {orders})
        UNION SELECT {order_base} + o_orderkey + 2, {order_base} + o_orderkey FROM {orders} WHERE o_orderkey % 97 = 0 AND o_orderkey + 2 < (SELECT count(*) FROM {orders})""",
    "layer": """
        SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM {part} WHERE p_partkey > 1
        UNION SELECT p_partkey, CAST(floor(p_partkey / 3) AS BIGINT) FROM {part} WHERE p_partkey > 2 AND p_size > 40""",
    "export": """
        SELECT l_partkey AS module_id, l_linenumber AS line,
               CASE l_linenumber WHEN 1 THEN 'default' WHEN 2 THEN 'useThing' || CAST(l_partkey AS STRING) WHEN 3 THEN 'Widget' || CAST(l_partkey AS STRING) WHEN 4 THEN 'GET'
                                 WHEN 5 THEN 'MAX_SIZE' WHEN 6 THEN 'helper' || CAST(l_partkey AS STRING) ELSE 'Props' || CAST(l_partkey AS STRING) END AS name,
               CASE l_linenumber WHEN 1 THEN 'Default' WHEN 7 THEN 'TypeOnly' ELSE 'Named' END AS kind, l_linenumber = 7 AS is_type_only,
               CASE WHEN l_partkey % 13 = 0 THEN CAST(NULL AS BIGINT) ELSE count(*) - 1 END AS usage_count
        FROM {lineitem} WHERE l_linenumber <= 7 GROUP BY l_partkey, l_linenumber""",
    # by star, in chains and rings; by name and renamed in chains of up to six; default and whole modules under a name
    "reexport": """
        SELECT p_partkey AS module_id, '*' AS name, p_partkey + 1 AS origin, '*' AS origin_name FROM {part} WHERE p_partkey % 29 < 7 AND p_partkey + 1 < (SELECT count(*) FROM {part})
        UNION ALL SELECT p_partkey + 1, '*', p_partkey, '*' FROM {part} WHERE p_partkey % 58 = 3 AND p_partkey + 1 < (SELECT count(*) FROM {part})
        UNION ALL SELECT p_partkey, 're' || CAST(p_partkey AS STRING), p_partkey + CASE WHEN p_partkey % 8 IN (0, 3, 6, 1, 4) THEN 11 ELSE 1 END,
               CASE p_partkey % 8 WHEN 7 THEN 'helper' || CAST(p_partkey + 1 AS STRING) WHEN 5 THEN 'default' WHEN 2 THEN '*' ELSE 're' || CAST(p_partkey + 11 AS STRING) END
        FROM {part} WHERE p_partkey % 11 = 3 AND p_partkey + 11 < (SELECT count(*) FROM {part})""",
    "offer": """
        SELECT module_id, name, kind, is_type_only FROM {export} UNION ALL SELECT module_id, name, 'ReExport', FALSE FROM {reexport} WHERE name <> '*'""",
    "symbol": """
        SELECT o_orderkey AS symbol_id, o_orderkey % n AS module_id, CASE WHEN o_orderkey % 9 = 0 THEN '_s' ELSE 's' END || CAST(o_orderkey AS STRING) AS name,
               CASE o_orderstatus WHEN 'F' THEN 'Function' WHEN 'O' THEN 'Class' ELSE 'Decorator' END AS raw_kind, o_orderkey % 4 = 0 AS is_exported, o_orderkey % 3 <> 0 AS is_used,
               CAST(o_orderkey % 500 + 1 AS INT) AS line, 'C' || CAST(o_orderkey % 97 AS STRING) AS owner, CASE o_orderkey % 2 WHEN 0 THEN 'private' ELSE 'public' END AS visibility,
               CASE o_orderkey % 6 WHEN 0 THEN 'ClassMethod' WHEN 1 THEN 'ClassProperty' WHEN 2 THEN 'ClassGetter' WHEN 3 THEN 'ClassSetter' WHEN 4 THEN 'ClassConstructor' ELSE 'ClassField' END AS member_kind,
               CASE o_orderkey % 5 WHEN 0 THEN '7' WHEN 1 THEN '"on"' ELSE 'a + b' END AS enum_value,
               CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS INT) ELSE CAST(o_orderkey * 7 % 400 AS INT) END AS line_count, CAST(o_orderkey % 9 AS INT) AS parameter_count, CAST(o_orderkey % 37 AS INT) AS method_count,
               CAST(o_orderkey % 15 AS INT) AS field_count, CAST(o_orderkey % 17 AS INT) AS complexity, CAST(o_orderkey % 8 AS INT) AS max_nesting_depth, CAST(o_orderkey % 6 AS INT) AS return_count
        FROM {orders}, (SELECT count(*) AS n FROM {part}) k""",
    "dependency": """
        SELECT c_custkey AS dep_no, CASE c_custkey % 4 WHEN 0 THEN '@scope/pkg' || CAST(c_custkey % 50 AS STRING) ELSE 'pkg' || CAST(c_custkey AS STRING) END AS package,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Development' WHEN 'HOUSEHOLD' THEN 'Peer' WHEN 'MACHINERY' THEN 'Optional' ELSE 'Runtime' END AS dep_type,
               CASE c_custkey % 6 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' WHEN 3 THEN '' WHEN 4 THEN '>= ' ELSE '=' END || CAST(c_custkey % 4 AS STRING) || '.' || CAST(c_custkey % 7 AS STRING) || '.' || CAST(c_custkey % 11 AS STRING) AS version_req,
               c_custkey % 17 = 3 AS workspace
        FROM {customer}""",
    "latest": """
        SELECT c_custkey AS dep_no, CAST(CASE c_custkey % 3 WHEN 0 THEN (c_custkey * 3 + 1) % 4 ELSE c_custkey % 4 END AS STRING) || '.' || CAST(CASE c_custkey % 3 WHEN 2 THEN c_custkey % 7 ELSE (c_custkey * 5) % 7 END AS STRING) || '.' || CAST((c_custkey + 2) % 11 AS STRING) || CASE WHEN c_custkey % 19 = 4 THEN '-beta.' || CAST(c_custkey % 3 AS STRING) ELSE '' END AS version
        FROM {customer}""",
    "finding": """
        SELECT 'unused_export' AS type, module_id, path, module_id * 10 + 1 AS finding_id, module_id % 4 = 0 AS is_type_only, size FROM {module} WHERE module_id % 3 = 0
        UNION ALL SELECT 'unreachable_file', module_id, path, module_id * 10 + 2, FALSE, size FROM {module} WHERE module_id % 4 = 1
        UNION ALL SELECT 'unreachable_module', module_id, path, module_id * 10 + 3, FALSE, size FROM {module} WHERE module_id % 5 = 2
        UNION ALL SELECT 'circular_dependency', module_id, path, module_id * 10 + 4, FALSE, size FROM {module} WHERE module_id % 7 = 3
        UNION ALL SELECT 'unused_npm_dependency', module_id, CAST(NULL AS STRING), module_id * 10 + 5, FALSE, size FROM {module} WHERE module_id % 11 = 4
        UNION ALL SELECT 'code_smell', module_id, path, module_id * 10 + 6, FALSE, size FROM {module} WHERE module_id % 6 = 5
        UNION ALL SELECT 'dynamic_import', module_id, path, module_id * 10 + 7, FALSE, size FROM {module} WHERE module_id % 13 = 6
        UNION ALL SELECT 'type_only_import', module_id, path, module_id * 10 + 8, TRUE, size FROM {module} WHERE module_id % 17 = 7
        UNION ALL SELECT 'framework', module_id, CAST(NULL AS STRING), module_id * 10 + 9, FALSE, size FROM {module} WHERE module_id % 19 = 8""",
    "run": """
        SELECT event_id AS run_no, 'tool' || CAST(user_id % 5 AS STRING) AS tool, event_type AS project, ts, CAST(floor(value * 100) AS BIGINT) AS micros, event_type <> 'error' AS success FROM {events}""",
}

ADAPTERS = {name: sql.replace("{order_base}", str(ORDER_BASE)) for name, sql in ADAPTERS.items()}


def frame(spark: SparkSession, sf_dir: str, name: str, stream: bool = False, **given: DataFrame) -> DataFrame:
    """A test table, or an adapter over them, as a DataFrame; a table also as a stream of its files. given: adapters that are there already, by name."""
    if name in given:
        return given[name]
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spark.readStream.schema(table.schema).parquet(f"{sf_dir}/{{{name}.parquet}}") if stream else table  # braces: a stream takes a single file only from a glob
    sql = ADAPTERS[name]
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    for x in used:  # keywords can't be names of spark.sql's frames
        sql = sql.replace("{" + x + "}", "{t_" + x + "}")
    return spark.sql(sql, **{f"t_{x}": frame(spark, sf_dir, x, **given) for x in used})


def with_adapters(query: str) -> str:
    """DuckDB SQL for a query that names adapters as {name}: those it needs, in order, as common tables."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for x in re.findall(r"\{(\w+)\}", sql):
            if x in ADAPTERS and x not in order:
                visit(ADAPTERS[x])
                order.append(x)

    visit(query)
    plain = lambda sql: re.sub(r"\{(\w+)\}", lambda m: f"g_{m[1]}" if m[1] in ADAPTERS else m[1], sql)
    tables = ",\n".join(f"g_{x} AS ({plain(ADAPTERS[x])})" for x in order)
    body = plain(query).strip()
    if not order:
        return body
    recursive = bool(re.match(r"WITH RECURSIVE\b", body, re.I))
    rest = re.sub(r"^WITH (RECURSIVE )?", ", ", body, flags=re.I) if body[:4].upper() == "WITH" else body
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}\n{rest}"
