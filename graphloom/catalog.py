"""Every registered query of the code-graph engine and its SQL: operators of the library over the adapters of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import registry, text, versions
from graphloom.operators import chains, deps, detection, findings, graph, patterns, quality, report, rules
from graphloom.sources import rule_files
from graphloom.sources.testdata import frame, with_adapters
from graphloom.storage import cut, scratch_path, spread
from graphloom.streaming import due_state, polling

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a table reader as a query, with the SQL of its result."""

    def add(make):
        key = name or make.__name__.strip("_")
        _QUERIES[key] = lambda spark, sf_dir: make(lambda t, stream=False, **given: frame(spark, sf_dir, t, stream, **given))
        if sql:
            _SQL[key] = with_adapters(sql)
        return make

    return add


REACH = "r(n) AS (SELECT module_id FROM {module} WHERE is_entry UNION SELECT e.dst FROM r JOIN {edge} e ON r.n = e.src)"
CONFIG = "regexp_matches(regexp_extract(path, '[^/]*$'), '(package\\.json|tsconfig\\.json|jsconfig\\.json|\\.eslintrc|\\.prettierrc|next\\.config|vite\\.config|rollup\\.config)')"
SAFETY = f"CASE WHEN is_entry THEN 'Unsafe' WHEN {CONFIG} THEN 'Unsafe' WHEN dyn THEN 'ReviewCarefully' WHEN has_side_effects THEN 'ReviewCarefully' ELSE 'SafeToDelete' END AS verdict, CASE WHEN is_entry THEN 'Entry point' WHEN {CONFIG} THEN 'Configuration file' WHEN dyn THEN 'Dynamically imported' WHEN has_side_effects THEN 'Module has side effects' ELSE '' END AS reason"
DYN = "module_id IN (SELECT resolved_to FROM {import} WHERE kind = 'Dynamic') AS dyn"
CLOSURE = "c(s, d) AS (SELECT src, dst FROM {ring} WHERE src <> dst UNION SELECT c.s, e.dst FROM c JOIN {ring} e ON c.d = e.src), k AS (SELECT a.s AS module_id, least(a.s, min(a.d)) AS scc_id FROM c a JOIN c b ON a.s = b.d AND a.d = b.s WHERE a.s <> a.d GROUP BY a.s)"


def _unreachable(t, imports: DataFrame | None = None) -> DataFrame:
    """imports: where a query reads them too, from the shared folder, so that they are derived once."""
    edges = t("edge") if imports is None else imports.where("resolved_to is not null").select(F.col("module_id").alias("src"), F.col("resolved_to").alias("dst"))
    return graph.unreachable_modules(t("module"), edges)


@query(f"WITH RECURSIVE {REACH} SELECT path, size, verdict, reason FROM (SELECT path, size, {SAFETY} FROM (SELECT *, {DYN} FROM {{module}}) m WHERE module_id NOT IN (SELECT n FROM r) AND NOT starts_with(path, 'virtual:'))")
def unreachable_modules(t):
    imports = cut(t("import").select("module_id", "resolved_to", "kind"), "imports")
    return graph.with_safety(_unreachable(t, imports), imports).select("path", "size", "verdict", "reason")


@query(f"WITH RECURSIVE {REACH} SELECT path, size FROM {{module}} WHERE module_id NOT IN (SELECT n FROM r) AND NOT starts_with(path, 'virtual:')")
def unreachable_by_rounds(t):
    return graph.unreachable_modules(t("module"), t("edge"), jumps=False).select("path", "size")


@query(f"SELECT path, verdict, reason FROM (SELECT path, {SAFETY} FROM (SELECT *, {DYN} FROM {{module}}) m)")
def safety_assessment(t):
    return graph.with_safety(t("module"), t("import")).select("path", "verdict", "reason")


@query(f"WITH RECURSIVE {REACH}, u AS (SELECT * FROM {{module}} WHERE module_id NOT IN (SELECT n FROM r) AND NOT starts_with(path, 'virtual:')) SELECT count(*) AS modules, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN has_side_effects THEN 0 ELSE size END) AS BIGINT) AS safe_bytes FROM u")
def bundle_impact(t):
    return graph.bundle_impact(_unreachable(t))


@query(f"WITH RECURSIVE {REACH} SELECT path, CAST(0 AS BIGINT) AS size FROM {{module}} WHERE module_id NOT IN (SELECT n FROM r)")
def unreachable_files(t):
    """All files but those of the graph that is built from the entries."""
    from graphloom.sources.files import unreachable_files as files

    built = graph.reachable(t("module").where("is_entry").select("module_id"), t("edge"))
    return files(t("module"), t("module").join(built, "module_id"))


@query("SELECT m.path, count(x.target) AS n_targets, coalesce(string_agg(x.target, ',' ORDER BY x.target), '') AS targets FROM {module} m LEFT JOIN (SELECT i.module_id, coalesce(b.path, i.source) AS target FROM {import} i LEFT JOIN {module} b ON b.module_id = i.resolved_to) x ON x.module_id = m.module_id AND NOT starts_with(x.target, 'virtual:') WHERE NOT starts_with(m.path, 'virtual:') GROUP BY m.path")
def module_dependencies(t):
    return graph.module_dependencies(t("module"), t("import"))


RESOLVED = "SELECT a.path AS from_path, b.path AS to_path, b.size AS to_size, i.* FROM {import} i JOIN {module} a ON a.module_id = i.module_id JOIN {module} b ON b.module_id = i.resolved_to WHERE NOT starts_with(a.path, 'virtual:') AND NOT starts_with(b.path, 'virtual:')"


@query(f"SELECT from_path, to_path, kind, source FROM ({RESOLVED})")
def import_resolution_join(t):
    return graph.resolved_imports(t("module"), t("import")).select("from_path", "to_path", "kind", "source")


@query(f"SELECT from_path, to_path, to_size, NOT is_external AS creates_chunk FROM ({RESOLVED}) WHERE kind = 'Dynamic'")
def dynamic_imports(t):
    return graph.dynamic_imports(t("module"), t("import"))


@query("SELECT path FROM {module} WHERE module_id IN (SELECT resolved_to FROM {import} WHERE kind = 'Dynamic')")
def dynamic_targets_semi(t):
    return t("module").join(graph.dynamic_targets(t("import")), "module_id", "left_semi").select("path")


@query(f"SELECT from_path, count(*) AS n, CAST(sum(to_size) AS BIGINT) AS lazy_bytes, string_agg(to_path, ',' ORDER BY to_path) AS targets FROM ({RESOLVED}) WHERE kind = 'Dynamic' GROUP BY from_path")
def dynamic_by_parent(t):
    return graph.dynamic_by_parent(graph.dynamic_imports(t("module"), t("import")))


@query(f"SELECT CAST(sum(to_size) AS BIGINT) AS lazy_bytes FROM ({RESOLVED}) WHERE kind = 'Dynamic'")
def lazy_loading_potential(t):
    return graph.dynamic_imports(t("module"), t("import")).agg(F.sum("to_size").alias("lazy_bytes"))


SPEC = "SELECT m.path, s.source, s.name, s.line FROM {specifier} s JOIN {module} m ON m.module_id = s.module_id WHERE NOT starts_with(m.path, 'virtual:') AND "
for _which, _test in (("side_effect", "specifier = 'None' AND kind = 'Static'"), ("namespace", "specifier = 'Namespace'"), ("type_only", "kind = 'TypeOnly'")):
    query(SPEC + _test, f"{_which}_imports")(lambda t, w=_which: graph.specifier_imports(t("module"), t("specifier"), w))


#: Uses over named, renamed and star re-exports, as (module, name).
LIVE = """x AS (SELECT DISTINCT * FROM {reexport}), own AS (SELECT module_id, name FROM {offer}),
    l(m, n) AS (SELECT resolved_to, unnest(CASE WHEN specifier = 'Namespace' THEN ['*', 'default'] ELSE [name] END) FROM {specifier} WHERE specifier IN ('Named', 'Default', 'Namespace') AND kind <> 'Dynamic' AND resolved_to IS NOT NULL
    UNION SELECT module_id, unnest(['*', 'default']) FROM {module} WHERE is_entry
    UNION SELECT x.origin, unnest(CASE WHEN x.name = '*' THEN [l.n] WHEN x.origin_name = '*' THEN ['*', 'default'] ELSE [x.origin_name] END) FROM l JOIN x ON x.module_id = l.m
    AND CASE WHEN x.name = '*' THEN l.n = '*' OR l.n <> 'default' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.module_id = l.m AND o.name = l.n) ELSE x.name = l.n OR l.n = '*' AND x.name <> 'default' END)"""
UNUSED = f"WITH RECURSIVE {LIVE} SELECT e.module_id, m.path, e.name, e.kind, e.is_type_only FROM {{offer}} e JOIN {{module}} m ON m.module_id = e.module_id WHERE NOT m.is_entry AND NOT starts_with(m.path, 'virtual:') AND NOT EXISTS (SELECT 1 FROM l WHERE l.m = e.module_id AND (l.n = e.name OR l.n = '*' AND e.name <> 'default'))"


@query(UNUSED)
def unused_exports(t):
    return graph.unused_exports(t("module"), t("offer"), t("specifier"), t("reexport"))


@query(f"WITH RECURSIVE {LIVE} SELECT m AS module_id, n AS name FROM l")
def live_exports(t):
    from graphloom.operators.liveness import live_exports as live

    return live(t("module").where("is_entry").select("module_id"), t("offer"), t("specifier"), t("reexport"))


@query("SELECT count(*) FILTER (WHERE NOT is_type_only) AS runtime, count(*) FILTER (WHERE is_type_only) AS type_only FROM {export}")
def exports_type_split(t):
    return graph.export_split(t("export"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT module_id, scc_id FROM k")
def cycles(t):
    return graph.components(t("ring"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT module_id, scc_id FROM k")
def cycles_by_rounds(t):
    return graph.components(t("ring"), trim=False)


@query(
    f"""WITH RECURSIVE {REACH}, {CLOSURE} SELECT scc_id, count(*) AS length, CAST(sum(size) AS BIGINT) AS total_size, bool_and(NOT is_entry AND NOT starts_with(path, 'virtual:') AND k.module_id NOT IN (SELECT n FROM r)) AS all_unreachable,
    string_agg(regexp_extract(path, '[^/]*$'), ' -> ' ORDER BY k.module_id) AS members FROM k JOIN {{module}} m ON m.module_id = k.module_id GROUP BY scc_id"""
)
def cycle_sizes(t):
    edges = cut(t("edge"), "edges")  # derived once for the cycles and the search
    return graph.cycle_summary(graph.components(t("ring", edge=edges)), t("module"), graph.unreachable_modules(t("module"), edges))


#: The whole import graph with its components contracted: groups, edges between them, and every chain from an entry's group.
GROUPS = CLOSURE.replace("{ring}", "{edge}") + """, g AS (SELECT m.module_id, coalesce(k.scc_id, m.module_id) AS gid FROM {module} m LEFT JOIN k ON k.module_id = m.module_id),
    ce AS (SELECT DISTINCT a.gid AS a, b.gid AS b FROM {edge} e JOIN g a ON a.module_id = e.src JOIN g b ON b.module_id = e.dst WHERE a.gid <> b.gid),
    p(node, depth) AS (SELECT DISTINCT gid, 0 FROM g JOIN {module} m ON m.module_id = g.module_id WHERE is_entry UNION ALL SELECT ce.b, depth + 1 FROM p JOIN ce ON ce.a = p.node)"""
NEAR = "n(node, depth) AS (SELECT module_id, 0 FROM {module} WHERE is_entry UNION SELECT e.dst, depth + 1 FROM n JOIN {edge} e ON e.src = n.node WHERE depth < 40), d AS (SELECT node, min(depth) AS depth FROM n GROUP BY node)"


def _chains(t) -> DataFrame:
    return chains.chain_summary(t("module").where("is_entry").select("module_id"), t("edge"))


@query(
    f"""WITH RECURSIVE {GROUPS}, {NEAR} SELECT g.module_id, d.depth, q.longest, q.chains, v.via FROM g JOIN d ON d.node = g.module_id JOIN (SELECT node, CAST(max(depth) AS BIGINT) AS longest, count(*) AS chains FROM p GROUP BY node) q ON q.node = g.gid
    LEFT JOIN (SELECT e.dst, string_agg(e.src, ',' ORDER BY e.src) AS via FROM (SELECT e.*, row_number() OVER (PARTITION BY e.dst ORDER BY e.src) AS k FROM {{edge}} e JOIN d a ON a.node = e.src JOIN d b ON b.node = e.dst WHERE a.depth + 1 = b.depth AND e.src <> e.dst) e WHERE k <= 3 GROUP BY e.dst) v ON v.dst = g.module_id"""
)
def dependency_chains(t):
    return _chains(t).select("module_id", F.col("depth").cast("int").alias("depth"), "longest", F.col("chains").cast("long").alias("chains"), F.array_join(F.col("via").cast("array<string>"), ",").alias("via"))


@query(
    f"""WITH RECURSIVE {NEAR}, c(node, chain, depth) AS (SELECT node, [node], depth FROM d WHERE depth = 0 UNION ALL
    SELECT d.node, list_append(c.chain, d.node), d.depth FROM c JOIN (SELECT e.dst, min(e.src) AS src FROM {{edge}} e JOIN d a ON a.node = e.src JOIN d b ON b.node = e.dst WHERE a.depth + 1 = b.depth GROUP BY e.dst) s ON s.src = c.node JOIN d ON d.node = s.dst)
    SELECT node AS module_id, array_to_string(chain, '>') AS chain FROM c WHERE depth > 5"""
)
def deep_chains(t):
    summary = _chains(t)
    return chains.unfold(summary, summary.where("depth > 5")).select("module_id", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))


@query(
    """WITH RECURSIVE p(node, path, depth) AS (SELECT module_id, [module_id], 0 FROM {module} WHERE is_entry UNION ALL SELECT e.dst, list_append(p.path, e.dst), depth + 1 FROM p JOIN {layer} e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst))
    SELECT node AS module_id, depth, array_to_string(path, '>') AS chain FROM p WHERE depth > 5"""
)
def layer_chains(t):
    return graph.chains(t("module").where("is_entry").select("module_id"), t("layer"))


@query(f"WITH RECURSIVE {REACH} SELECT m.module_id, m.path, i.importers FROM {{module}} m JOIN (SELECT dst, count(*) AS importers, bool_or(src IN (SELECT n FROM r)) AS live FROM {{edge}} GROUP BY dst) i ON i.dst = m.module_id WHERE NOT m.is_entry AND NOT i.live AND NOT starts_with(m.path, 'virtual:')")
def dead_modules(t):
    return graph.dead_modules(t("module"), t("edge"))


@query("WITH RECURSIVE x AS (SELECT * FROM {edge} WHERE (src * 7 + dst) % 13 <> 0), r(n) AS (SELECT module_id FROM {module} WHERE is_entry UNION SELECT e.dst FROM r JOIN x e ON r.n = e.src) SELECT n AS module_id FROM r")
def reach_after_changes(t):
    """A graph that lacks a tenth of its edges, then two batches of changes: those come in, and a thirteenth of all goes."""
    from graphloom.streaming.live_reach import LiveReach

    edges, gone = cut(t("edge"), "edges"), "(src * 7 + dst) % 13 = 0"  # read by the first run and both batches
    live = LiveReach(edges.sparkSession, scratch_path(edges.sparkSession, "live_reach"), "bigint")
    live.begin(t("module").where("is_entry").select("module_id"), edges.where("(src + dst) % 10 <> 0"))
    changes = lambda test, op: edges.where(test).select("src", "dst", F.lit(op).alias("op"), F.lit(1).alias("seq"))
    live.apply(changes("(src + dst) % 10 = 0", "add"), 0)
    live.apply(changes(gone, "remove"), 1)
    return live.after(2)


# --- symbols and quality -----------------------------------------------------------------------

KIND = "CASE WHEN raw_kind IN ('Function', 'Variable', 'Class', 'Parameter', 'TypeAlias', 'Interface', 'Enum') THEN raw_kind ELSE 'Variable' END"
SYM = f"SELECT s.*, m.path, {KIND} AS kind FROM {{symbol}} s JOIN {{module}} m ON m.module_id = s.module_id"


def _symbols(t) -> DataFrame:
    return t("symbol").join(t("module").select("module_id", "path"), "module_id").withColumn("kind", quality.symbol_kind(F.col("raw_kind")))


@query(f"SELECT path, symbol_id, name, kind, line FROM ({SYM}) WHERE NOT is_used AND NOT is_exported AND NOT starts_with(name, '_') AND NOT starts_with(path, 'virtual:')")
def unused_symbols(t):
    return quality.unused_symbols(_symbols(t))


@query(f"SELECT kind, count(*) AS total, count(*) FILTER (WHERE NOT is_used) AS unused FROM ({SYM}) GROUP BY kind")
def symbol_stats(t):
    return quality.symbol_stats(_symbols(t))


MEMBER = "CASE member_kind WHEN 'ClassMethod' THEN 'Method' WHEN 'ClassProperty' THEN 'Property' WHEN 'ClassGetter' THEN 'Getter' WHEN 'ClassSetter' THEN 'Setter' WHEN 'ClassConstructor' THEN 'Constructor' ELSE 'Method' END AS member"


@query(f"SELECT path, owner, name, {MEMBER}, visibility FROM ({SYM}) WHERE NOT is_used AND NOT starts_with(name, '_') AND NOT starts_with(path, 'virtual:')")
def unused_class_members(t):
    return quality.unused_members(_symbols(t))


@query(f"SELECT {MEMBER}, count(*) AS unused, count(*) FILTER (WHERE visibility = 'private') AS private, count(DISTINCT owner) AS classes FROM ({SYM}) WHERE NOT is_used GROUP BY 1")
def class_member_stats(t):
    return quality.member_stats(_symbols(t))


ENUM = "CASE WHEN regexp_matches(enum_value, '^-?[0-9]+(\\.[0-9]+)?$') THEN 'Number' WHEN regexp_matches(enum_value, '^\"[^\"]*\"$') THEN 'String' ELSE 'Computed' END"


@query(f"SELECT path, owner, name, {ENUM} AS value_kind, CASE {ENUM} WHEN 'Number' THEN enum_value WHEN 'String' THEN trim(enum_value, '\"') END AS value FROM ({SYM}) WHERE NOT is_used AND NOT starts_with(name, '_') AND NOT starts_with(path, 'virtual:')")
def unused_enum_members(t):
    return quality.unused_enum_members(_symbols(t))


@query(f"SELECT count(DISTINCT (module_id, owner)) AS total_enums, count(*) AS total_members, count(*) FILTER (WHERE NOT starts_with(name, '_') AND NOT starts_with(path, 'virtual:')) AS unused_members FROM ({SYM}) WHERE NOT is_used")
def enum_stats(t):
    return quality.enum_stats(_symbols(t))


SMELL = {n: f"SELECT path, symbol_id, name, line, '{n}' AS smell, {m} AS value, {d} AS threshold, '{k} ''' || name || ''' {s.split('%d')[0]}' || CAST({m} AS VARCHAR) || '{s.split('%d')[1]} (recommended: {d})' AS message, '{a}' AS advice, 'Warning' AS severity FROM ({SYM}) WHERE kind = '{k}' AND {m} > {d} AND NOT starts_with(path, 'virtual:')" for n, k, m, d, _, s, a in quality.SMELLS}
for _name in SMELL:
    query(SMELL[_name], f"smells_{_name}")(lambda t, n=_name: quality.smells(_symbols(t)).where(F.col("smell") == n))
_ALL = " UNION ALL ".join(SMELL.values())


@query(f"SELECT 'smell' AS dimension, smell AS value, count(*) AS n FROM ({_ALL}) GROUP BY smell UNION ALL SELECT 'severity', severity, count(*) FROM ({_ALL}) GROUP BY severity")
def smell_stats(t):
    return quality.smell_stats(quality.smells(_symbols(t)))


# --- findings ----------------------------------------------------------------------------------

CATEGORY = "CASE WHEN type = 'unused_export' AND is_type_only THEN 'types' WHEN type = 'unused_export' THEN 'exports' WHEN type IN ('unreachable_file', 'unreachable_module') THEN 'files' WHEN type = 'circular_dependency' THEN 'circular' WHEN type = 'unused_npm_dependency' THEN 'dependencies' WHEN type = 'code_smell' THEN 'quality' WHEN type IN ('dynamic_import', 'type_only_import') THEN 'imports' ELSE 'framework' END"
IGNORES = ["**/*.test.tsx", "lib/**", "app/d3/*", "", "**/m1*.js"]
_order = [*reversed(findings.DEFAULT_IGNORES), *(p for p in IGNORES if p)]
_values = ", ".join(f"({k}, '{p}', '{text.glob_to_regex(p)}')" for k, p in enumerate(_order))
MATCHED = f"SELECT f.*, g.pattern AS matched_pattern FROM {{finding}} f LEFT JOIN (SELECT finding_id, arg_min(pattern, idx) AS pattern FROM {{finding}} x JOIN (VALUES {_values}) p(idx, pattern, regex) ON regexp_matches(x.path, p.regex) GROUP BY finding_id) g ON g.finding_id = f.finding_id"


@query(f"SELECT finding_id, type, {CATEGORY} AS category FROM {{finding}}")
def finding_category(t):
    return findings.with_category(t("finding")).select("finding_id", "type", "category")


_POSITION = ", ".join(f"({k}, '{n}')" for k, n in enumerate(findings.CATEGORIES))


@query(f"SELECT position, name, coalesce(n, 0) AS n FROM (VALUES {_POSITION}) c(position, name) LEFT JOIN (SELECT {CATEGORY} AS category, count(*) AS n FROM {{finding}} GROUP BY 1) f ON f.category = c.name")
def category_counts(t):
    return findings.category_counts(t("finding"))


_COUNTED = findings.COUNTED


@query(
    f"""SELECT {', '.join(f"count(*) FILTER (WHERE type = '{x}') AS {x}" for x in _COUNTED)}, count(*) FILTER (WHERE type = 'unused_export' AND is_type_only) AS type_only_unused_export, count(*) AS findings, (SELECT count(*) FROM {{module}}) AS modules, (SELECT count(*) FROM {{module}} WHERE NOT starts_with(path, 'virtual:')) AS real_modules,
    (SELECT count(*) FROM {{import}}) AS dependencies, (SELECT count(DISTINCT source) FROM {{import}} WHERE is_external) AS external FROM {{finding}}"""
)
def statistics_row(t):
    return findings.statistics(t("finding"), t("module"), t("import"))


@query("SELECT finding_id, CASE WHEN type = 'circular_dependency' THEN 'm' || module_id WHEN type NOT IN ('framework', 'unused_npm_dependency') THEN path END AS filter_path FROM {finding}")
def finding_filter_path(t):
    members = F.concat(F.lit("m"), F.col("module_id"), F.lit(",m"), F.col("module_id") + 1)
    return t("finding").select("finding_id", findings.filter_path(F.col("type"), F.col("path"), members).alias("filter_path"))


@query("SELECT module_id, name, CASE WHEN is_type_only THEN 'TypeOnly' WHEN kind = 'Default' THEN 'Default' ELSE 'Named' END AS shown FROM {export}")
def export_kinds(t):
    return t("export").select("module_id", "name", findings.export_kind(F.col("kind"), F.col("is_type_only")).alias("shown"))


@query("SELECT 'unknown' AS file, 'error ' || event_id AS message, 'Error' AS severity FROM events WHERE event_type = 'error' UNION ALL SELECT 'unknown', 'slow ' || event_id, 'Warning' FROM events WHERE value > 90")
def errors_and_warnings(t):
    said = lambda test, word: t("events").where(test).select(F.concat(F.lit(word), F.col("event_id")).alias("message"))
    return findings.errors_and_warnings(said("event_type = 'error'", "error "), said("value > 90", "slow "))


@query(f"SELECT finding_id, path, matched_pattern IS NULL AS kept FROM ({MATCHED})")
def ignore_split(t):
    return findings.split_ignored(t("finding"), IGNORES).select("finding_id", "path", F.col("matched_pattern").isNull().alias("kept"))


@query(f"SELECT finding_id, matched_pattern FROM ({MATCHED}) WHERE matched_pattern IS NOT NULL")
def ignore_first_match(t):
    return findings.split_ignored(t("finding"), IGNORES).where("matched_pattern is not null").select("finding_id", "matched_pattern")


@query(f"SELECT {', '.join(f"count(*) FILTER (WHERE type = '{x}') AS {x}" for x in findings.BREAKDOWN)} FROM ({MATCHED}) WHERE matched_pattern IS NOT NULL")
def ignored_breakdown(t):
    return findings.ignored_breakdown(findings.split_ignored(t("finding"), IGNORES).where("matched_pattern is not null"))


#: A pattern for every part: files of a module, all of a customer's orders, and modules whose number begins with the part's in one of two folders.
PATTERNS = "SELECT p_partkey AS idx, CASE p_partkey % 3 WHEN 0 THEN '**/m' || p_partkey || '.*' WHEN 1 THEN 'log/c' || p_partkey || '/*' ELSE '**/d' || chr(123) || '1,' || (p_partkey % 9) || chr(125) || '/m' || p_partkey || '*' END AS pattern FROM {part}"


@query(
    f"""WITH p AS ({PATTERNS}), m AS (SELECT path, TRY_CAST(nullif(regexp_extract(path, '/m([0-9]+)[.]', 1), '') AS BIGINT) AS own, TRY_CAST(nullif(regexp_extract(path, '^log/c([0-9]+)/', 1), '') AS BIGINT) AS customer,
        regexp_extract(path, '/d([0-9]+)/m([0-9]+)', 1) AS folder, regexp_extract(path, '/d([0-9]+)/m([0-9]+)', 2) AS number FROM {{module}} WHERE NOT starts_with(path, 'virtual:')),
    h AS (SELECT path, idx, pattern FROM m JOIN p ON idx = own WHERE idx % 3 = 0 UNION ALL SELECT path, idx, pattern FROM m JOIN p ON idx = customer WHERE idx % 3 = 1
        UNION ALL SELECT path, idx, pattern FROM m JOIN p ON starts_with(number, CAST(idx AS VARCHAR)) WHERE idx % 3 = 2 AND folder IN ('1', CAST(idx % 9 AS VARCHAR)))
    SELECT path, min(idx) AS idx, arg_min(pattern, idx) AS pattern FROM h GROUP BY path"""
)
def ignore_many_patterns(t):
    patterns_ = t("part").selectExpr("p_partkey as idx", PATTERNS.removeprefix("SELECT p_partkey AS idx, ").removesuffix(" AS pattern FROM {part}") + " as pattern")
    return patterns.first_matches(t("module").where("not startswith(path, 'virtual:')"), patterns.pattern_index(patterns_))


_FOUR = ("unused_export", "unreachable_module", "framework_export", "circular_dependency")


@query(f"SELECT {', '.join(f"count(*) FILTER (WHERE type = '{x}' AND matched_pattern IS NULL) AS {x}, count(*) FILTER (WHERE type = '{x}') AS stale_{x}" for x in _FOUR)} FROM ({MATCHED})")
def recalculated_statistics(t):
    return findings.recalculated(t("finding"), IGNORES)


@query(f"SELECT finding_id, category FROM (SELECT finding_id, {CATEGORY} AS category FROM {{finding}}) WHERE category IN ('files', 'types')")
def category_retention(t):
    return findings.retain(t("finding"), ["files", "types"]).select("finding_id", "category")


@query("SELECT DISTINCT name, CASE WHEN name IN ('symbols', 'types', 'imports', 'quality') THEN 'granted' ELSE 'refused' END AS outcome, CASE WHEN name IN ('symbols', 'types', 'imports', 'quality') THEN NULL WHEN name = 'framework' THEN 'requires package.json' ELSE 'requires full graph' END AS reason FROM (SELECT CASE event_type WHEN 'click' THEN 'files' WHEN 'error' THEN 'quality' WHEN 'view' THEN 'symbols' ELSE 'framework' END AS name FROM events)")
def capability_partition(t):
    asked = t("events").select(F.when(F.col("event_type") == "click", "files").when(F.col("event_type") == "error", "quality").when(F.col("event_type") == "view", "symbols").otherwise("framework").alias("name"))
    return findings.partition_categories(asked.union(asked.sparkSession.createDataFrame([("nonsense",)], "name string")), findings.capabilities(asked.sparkSession, "files"))


@query("SELECT finding_id, type FROM {finding} WHERE type = 'code_smell' UNION ALL SELECT finding_id, type FROM {finding} WHERE type = 'unreachable_file'")
def findings_union(t):
    f = t("finding")
    return findings.union_findings([f.where("type = 'code_smell'").select("finding_id", "type"), f.where("type = 'unreachable_file'").select("type", "finding_id")])


@query("SELECT has_side_effects, CAST(rank AS INTEGER) AS rank, path, CASE WHEN size >= 1048576 THEN printf('%.2f MB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0) ELSE CAST(size AS VARCHAR) || ' bytes' END AS shown, greatest(n - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY has_side_effects ORDER BY size DESC, path) AS rank, count(*) OVER (PARTITION BY has_side_effects) AS n FROM {module}) WHERE rank <= 10")
def topk_per_group(t):
    return findings.files_section(t("module"))


@query("WITH f AS (SELECT m.path, e.name FROM {export} e JOIN {module} m ON m.module_id = e.module_id WHERE NOT is_type_only ORDER BY m.path, e.name LIMIT 50) SELECT path, string_agg(name, ', ' ORDER BY name) AS names, count(*) AS n FROM f GROUP BY path ORDER BY path LIMIT 10")
def exports_section(t):
    return findings.exports_section(t("export").join(t("module").select("module_id", "path"), "module_id"))


_JSON = "SELECT finding_id, chr(123) || '\"category\":\"' || " + CATEGORY + " || '\",\"finding_id\":' || finding_id || ',\"is_type_only\":' || CAST(is_type_only AS VARCHAR) || ',\"module_id\":' || module_id || CASE WHEN path IS NULL THEN '' ELSE ',\"path\":\"' || path || '\"' END || ',\"size\":' || size || ',\"type\":\"' || type || '\"' || chr(125) AS json FROM {finding}"


@query(_JSON)
def json_report(t):
    return findings.json_rows(t("finding"))


# --- rules and detection -----------------------------------------------------------------------


def _rule_rows(t, asked: list[rules.Rule] | None = None) -> DataFrame:
    return rules.rule_rows(t("module"), t("export"), t("specifier"), asked)


def _rule_hits(t, rule: rules.Rule) -> DataFrame:
    return _rule_rows(t, [rule]).where(rule.predicate()).select("module_id", "path", "name")


_IMPORTS = "EXISTS (SELECT 1 FROM {specifier} s WHERE s.module_id = e.module_id AND "
#: One rule for each kind of condition: match table and the same condition in SQL over e (export with path).
CONDITIONS: dict[str, tuple[dict, str]] = {
    "import_from": ({"import_from": ["react", "pkg1/x"]}, f"{_IMPORTS} s.source IN ('react', 'pkg1/x'))"),
    "import_from_pattern": ({"import_from_pattern": "^@scope/"}, f"{_IMPORTS} regexp_matches(s.source, '^@scope/'))"),
    "import_specifiers": ({"import_from": "react", "import_specifiers": ["default"]}, f"{_IMPORTS} s.source = 'react' AND s.specifier IN ('Named', 'Default') AND s.name = 'default')"),
    "import_default": ({"import_from": "react", "import_default": True}, f"{_IMPORTS} s.source = 'react' AND s.specifier = 'Default')"),
    "import_namespace": ({"import_from_pattern": "^pkg", "import_namespace": True}, f"{_IMPORTS} regexp_matches(s.source, '^pkg') AND s.specifier = 'Namespace')"),
    "export_name": ({"export_name": ["GET", "default"]}, "e.name IN ('GET', 'default')"),
    "export_pattern": ({"export_pattern": "^use[A-Z][a-z]+"}, "regexp_matches(e.name, '^use[A-Z][a-z]+')"),
    "export_type": ({"export_type": "const"}, "NOT e.is_type_only AND e.name <> '' AND (NOT regexp_matches(e.name, '^[A-Z]') OR regexp_matches(e.name, '^[A-Z_]+$') AND contains(e.name, '_'))"),
    "export_type_class": ({"export_type": "class"}, "NOT e.is_type_only AND regexp_matches(e.name, '^[A-Z]')"),
    "path_starts_with": ({"path_starts_with": ["pages/", "app/d1"]}, "(starts_with(e.path, 'pages/') OR starts_with(e.path, 'app/d1'))"),
    "path_ends_with": ({"path_ends_with": [".tsx", ".vue"]}, "(ends_with(e.path, '.tsx') OR ends_with(e.path, '.vue'))"),
    "path_pattern": ({"path_pattern": "^(pages|app)/d[2-4]/.*[.]tsx?$"}, "regexp_matches(e.path, '^(pages|app)/d[2-4]/.*[.]tsx?$')"),
    "not_import_from": ({"not_import_from": ["pkg2/x", "pkg5/x"]}, f"NOT {_IMPORTS} s.source IN ('pkg2/x', 'pkg5/x'))"),
    "not_export_name": ({"not_export_name": ["default"]}, "e.name <> 'default'"),
    "not_export_pattern": ({"not_export_pattern": "^(use|helper)"}, "NOT regexp_matches(e.name, '^(use|helper)')"),
    "not_path_pattern": ({"not_path_pattern": "^src/|[.]test[.]"}, "NOT regexp_matches(e.path, '^src/|[.]test[.]')"),
    "usage_count": ({"min_usage_count": 2, "max_usage_count": 4}, "coalesce(e.usage_count BETWEEN 2 AND 4, FALSE)"),
}
EXPORTS = "SELECT x.*, m.path FROM {export} x JOIN {module} m ON m.module_id = x.module_id"
for _key, (_match, _where) in CONDITIONS.items():
    query(f"SELECT module_id, path, name FROM ({EXPORTS}) e WHERE {_where}", f"rule_{_key}")(lambda t, m=_match, k=_key: _rule_hits(t, rules.Rule(k, m)))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) <= 10485760 AND regexp_matches(text, 'icensed under|@public')")
def rule_content_pattern(t):
    rows = t("documents").select("doc_id", F.col("text").alias("content"))
    return rows.where(rules.Rule("content", {"content_pattern": "icensed under|@public"}).predicate()).select("doc_id")


ORDERED = ("export_name", "path_ends_with", "export_pattern", "path_starts_with", "usage_count")
_hits = lambda files: " UNION ALL ".join(f"SELECT module_id, path, {'NULL' if files else 'name'} AS name, {k} AS rule_idx, '{n}' AS rule, {files} AS file_only FROM ({'SELECT * FROM {module}' if files else EXPORTS}) e WHERE {CONDITIONS[n][1]}" for k, n in enumerate(ORDERED) if n.startswith("path") == files)
#: Export rules up to a module's first file rule, and that rule once a module.
MATCHES = f"SELECT x.* FROM ({_hits(False)}) x LEFT JOIN (SELECT module_id, min(rule_idx) AS ff FROM ({_hits(True)}) GROUP BY module_id) f ON f.module_id = x.module_id WHERE ff IS NULL OR rule_idx < ff UNION ALL SELECT * FROM ({_hits(True)}) QUALIFY row_number() OVER (PARTITION BY module_id ORDER BY rule_idx) = 1"


def _matches(t) -> DataFrame:
    asked = [rules.Rule(n, CONDITIONS[n][0]) for n in ORDERED]
    return rules.evaluate(_rule_rows(t, asked), asked, rules.module_rows(t("module"), t("specifier"), asked))


@query(f"SELECT module_id, name, CAST(rule_idx AS INTEGER) AS rule_idx, rule FROM ({MATCHES})")
def rule_first_match(t):
    return _matches(t).select("module_id", "name", "rule_idx", "rule")


@query(f"SELECT module_id, path, name, arg_min(rule, rule_idx) AS rule, count(*) AS rules FROM ({MATCHES}) WHERE NOT file_only GROUP BY ALL")
def framework_used_exports(t):
    return rules.marked_used(_matches(t))


@query(f"SELECT CAST(rule_idx AS INTEGER) AS rule_idx, rule, count(*) FILTER (WHERE NOT file_only) AS marked, count(*) FILTER (WHERE file_only) AS skipped FROM ({MATCHES}) GROUP BY ALL")
def rule_statistics(t):
    return rules.rule_stats(_matches(t))


EVIDENCE = """SELECT framework, type, pattern, weight FROM (
    SELECT source AS v, 'import' AS type FROM {import} UNION ALL SELECT path, 'file_path' FROM {module} UNION ALL SELECT path, 'file_extension' FROM {module}) x JOIN (VALUES
    ('React', 'import', '^react$', 1.0, '^react$'), ('React', 'import', '^react-dom$', 0.8, '^react-dom$'), ('Next.js', 'import', '^next$', 1.0, '^next$'), ('Next.js', 'import', '^next/', 0.9, '^next/'),
    ('Next.js', 'file_path', '**/app/**', 0.7, '^(.*/)?app/.*$'), ('Next.js', 'file_path', '**/pages/**', 0.7, '^(.*/)?pages/.*$'), ('Next.js', 'file_path', 'middleware.{ts,js}', 0.8, '^(.*/)?middleware\\.(ts|js)$'),
    ('Vue', 'import', '^vue$', 1.0, '^vue$'), ('Vue', 'import', '^@vue/', 0.9, '^@vue/'), ('Vue', 'file_extension', '.vue', 0.8, '\\.vue$'), ('Vue', 'file_path', 'nuxt.config.{ts,js}', 0.9, '^(.*/)?nuxt\\.config\\.(ts|js)$'),
    ('Svelte', 'import', '^svelte$', 1.0, '^svelte$'), ('Svelte', 'file_extension', '.svelte', 0.8, '\\.svelte$')) d(framework, type, pattern, weight, regex) USING (type) WHERE regexp_matches(v, regex)"""
EVIDENCE = EVIDENCE.replace("{ts,js}", "' || chr(123) || 'ts,js' || chr(125) || '")
CONFIDENCE = f"SELECT framework, round(least(1.0, CAST(sum(weight) AS DOUBLE)), 6) AS confidence, count(*) AS hits, string_agg(DISTINCT type || ':' || pattern, ', ' ORDER BY type || ':' || pattern) AS evidence FROM ({EVIDENCE}) GROUP BY framework"


def _evidence(t) -> DataFrame:
    files = rule_files.builtin()
    by_import = detection.evidence(t("import"), "source", ("import",), files)
    return detection.confidence(by_import.union(detection.evidence(t("module"), "path", ("file_path", "file_extension"), files)))


@query(CONFIDENCE)
def framework_confidence(t):
    return _evidence(t)


@query(f"SELECT framework FROM ({CONFIDENCE}) c WHERE NOT (framework = 'React' AND EXISTS (SELECT 1 FROM ({CONFIDENCE}) n WHERE n.framework = 'Next.js'))")
def framework_suppression(t):
    return detection.suppress(_evidence(t), rule_files.builtin()).select("framework")


@query(f"SELECT framework, priority, CAST(row_number() OVER (ORDER BY priority DESC, confidence DESC, framework) AS INTEGER) AS rank FROM (SELECT *, CASE framework WHEN 'Next.js' THEN 100 ELSE 50 END AS priority FROM ({CONFIDENCE}))")
def framework_rank(t):
    return detection.ranked(_evidence(t), rule_files.builtin()).select("framework", "priority", "rank")


@query(
    """SELECT e.module_id, e.name, CASE WHEN EXISTS (SELECT 1 FROM {specifier} s WHERE s.module_id = e.module_id AND s.source = 'react') THEN 'React'
    WHEN regexp_matches(e.path, '^(.*/)?(app|pages)/.*$') THEN 'Next.js' WHEN ends_with(e.path, '.vue') THEN 'Vue' ELSE 'Unknown' END AS framework FROM (SELECT x.*, m.path FROM {export} x JOIN {module} m ON m.module_id = x.module_id) e"""
)
def export_framework(t):
    return detection.export_framework(_rule_rows(t), rule_files.builtin()).select("module_id", "name", "framework")


@query(f"SELECT DISTINCT framework FROM ({EVIDENCE}) WHERE framework <> 'React'")
def frameworks_detected(t):
    return detection.detect(t("import"), t("module"), rule_files.builtin()).where("framework <> 'React'")


# --- dependencies ------------------------------------------------------------------------------

PACKAGE = "CASE WHEN starts_with(source, '@') THEN array_to_string(list_slice(string_split(source, '/'), 1, 2), '/') ELSE string_split(source, '/')[1] END"
USED = f"SELECT DISTINCT {PACKAGE} AS package FROM {{import}} WHERE is_external"


@query(f"SELECT package, dep_type FROM {{dependency}} WHERE dep_type <> 'Peer' AND package NOT IN ({USED})")
def unused_packages(t):
    return deps.unused_packages(t("dependency"), t("import"))


@query(f"SELECT coalesce(dep_type, 'total') AS dep_type, count(*) AS declared, count(u.package) AS used, count(*) - count(u.package) AS unused, round(count(u.package) * 100.0 / count(*), 4) AS percent FROM (SELECT d.dep_type, u.package FROM {{dependency}} d LEFT JOIN ({USED}) u ON u.package = d.package) u GROUP BY ROLLUP (dep_type)")
def dependency_coverage(t):
    return deps.coverage(t("dependency"), t("import"))


def _listed(table: str, *columns: str) -> str:
    """The rows of a query as text, in order."""
    return f"(SELECT coalesce(string_agg({" || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)}, ',' ORDER BY {", ".join(columns)}), '') FROM ({_SQL[table]}))"


_SIDE = {"symbol_stats": ("kind", "total", "unused"), "member_stats": ("member", "unused", "private", "classes"), "smell_stats": ("dimension", "value", "n"), "dependency_coverage": ("dep_type", "declared", "used", "unused")}
_ENUMS, _BUNDLE = ("total_enums", "total_members", "unused_members"), ("modules", "total_bytes", "safe_bytes")


@query(
    f"""SELECT s.findings, s.external, i.*, {', '.join(f"e.{x} AS enum_{x}" for x in _ENUMS)}, {', '.join(f"b.{x} AS bundle_{x}" for x in _BUNDLE)}, {', '.join(f"{_listed('class_member_stats' if n == 'member_stats' else n, *cs)} AS {n}" for n, cs in _SIDE.items())}
    FROM ({_SQL['statistics_row']}) s, (SELECT count(*) AS ignored_findings, {', '.join(f"count(*) FILTER (WHERE type = '{x}') AS ignored_{x}" for x in findings.BREAKDOWN)} FROM ({MATCHED}) WHERE matched_pattern IS NOT NULL) i, ({_SQL['enum_stats']}) e, ({_SQL['bundle_impact']}) b"""
)
def statistics_blocks(t):
    imports = cut(t("import").select("module_id", "resolved_to", "kind", "source", "is_external"), "imports")
    symbols, ignored = _symbols(t), findings.split_ignored(t("finding"), IGNORES).where("matched_pattern is not null")
    tables = {
        "ignored": findings.ignored_block(ignored), "bundle_impact": graph.bundle_impact(_unreachable(t, imports)), "symbol_stats": quality.symbol_stats(symbols), "member_stats": quality.member_stats(symbols), "enum_stats": quality.enum_stats(symbols),
        "dependency_coverage": deps.coverage(t("dependency"), imports), "smell_stats": quality.smell_stats(quality.smells(symbols)),
    }
    row = findings.with_blocks(findings.statistics(t("finding"), t("module"), imports), tables)
    listed = lambda name, columns: F.array_join(F.transform(name, lambda x: F.concat_ws(":", *(x[c].cast("string") for c in columns))), ",").alias(name)
    return row.select(
        "findings", "external", "ignored.ignored_findings", *(F.col(f"ignored.{x}").alias(f"ignored_{x}") for x in findings.BREAKDOWN), *(F.col(f"enum_stats.{x}").alias(f"enum_{x}") for x in _ENUMS),
        *(F.col(f"bundle_impact.{x}").alias(f"bundle_{x}") for x in _BUNDLE), *(listed(n, cs) for n, cs in _SIDE.items()),
    )


def _triple(x: str, k: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '^([0-9]+)\\.([0-9]+)\\.([0-9]+)(-([0-9A-Za-z.-]+))?$', {k}), '') AS BIGINT)"


STRIPPED = "regexp_replace(version_req, '^(\\^|~|>=)', '')"
PARTS = f"SELECT d.dep_no, d.package, d.dep_type, d.version_req, l.version AS latest, {', '.join(f'{_triple(STRIPPED, k)} AS c{k}, {_triple('l.version', k)} AS l{k}' for k in (1, 2, 3))}, contains(l.version, '-') AS pre, {', '.join(f'{_triple("regexp_replace(trim(version_req), '^(\\^|~|>=|=)[ ]*', '')", k)} AS b{k}' for k in (1, 2, 3))} FROM {{dependency}} d JOIN {{latest}} l ON l.dep_no = d.dep_no WHERE NOT d.workspace"
UPDATES = f"""SELECT dep_no, package, dep_type, version_req, latest, CASE WHEN c1 IS NULL OR NOT ((l1, l2, l3) > (c1, c2, c3)) THEN 'None' WHEN l1 > c1 THEN 'Major' WHEN l2 > c2 THEN 'Minor' WHEN l3 > c3 THEN 'Patch' ELSE 'None' END AS update_type,
    CASE WHEN pre THEN FALSE WHEN starts_with(version_req, '^') THEN (l1, l2, l3) >= (b1, b2, b3) AND CASE WHEN b1 > 0 THEN l1 = b1 WHEN b2 > 0 THEN l1 = 0 AND l2 = b2 ELSE (l1, l2, l3) = (b1, b2, b3) END
    WHEN starts_with(version_req, '~') THEN (l1, l2, l3) >= (b1, b2, b3) AND l1 = b1 AND l2 = b2 WHEN starts_with(version_req, '>=') THEN (l1, l2, l3) >= (b1, b2, b3) ELSE (l1, l2, l3) = (b1, b2, b3) END AS satisfied FROM ({PARTS})"""


@query(UPDATES)
def update_recommendations(t):
    return deps.updates(t("dependency"), t("latest"))


@query(f"SELECT dep_no, update_type FROM ({UPDATES}) WHERE update_type IN ('Minor', 'Patch')")
def safe_updates(t):
    return deps.safe_updates(deps.updates(t("dependency"), t("latest"))).select("dep_no", "update_type")


@query(f"SELECT dep_no, CASE WHEN c1 IS NULL THEN 'None' WHEN l1 > c1 THEN 'Major' WHEN l2 > c2 THEN 'Minor' WHEN l3 > c3 THEN 'Patch' ELSE 'None' END AS update_type FROM ({PARTS})")
def version_update_type(t):
    return deps.updates(t("dependency"), t("latest"), compat=True).select("dep_no", "update_type")


@query(f"SELECT dep_no, satisfied FROM ({UPDATES})")
def version_satisfies(t):
    return deps.updates(t("dependency"), t("latest")).select("dep_no", "satisfied")


@query(f"SELECT dep_no, version, CAST(dense_rank() OVER (ORDER BY {_triple('version', 1)}, {_triple('version', 2)}, {_triple('version', 3)}, NOT contains(version, '-'), regexp_extract(version, '-(.*)$', 1)) AS INTEGER) AS rank FROM {{latest}}")
def version_order(t):
    return deps.version_order(t("latest"), "dep_no", "version")


@query("SELECT package, dep_type, version_req AS old_req, CASE WHEN dep_no % 5 = 0 THEN '9.0.0' ELSE version_req END AS new_req, dep_no % 5 = 0 AS changed FROM {dependency} WHERE NOT starts_with(package, '@')")
def manifest_update(t):
    own = t("dependency").where("not startswith(package, '@')")
    return deps.apply_updates(own, own.where("dep_no % 5 = 0").select("package", "dep_type", F.lit("9.0.0").alias("new_req")))


@query("WITH f AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder FROM {module} WHERE module_id % 3 = 0 AND len(string_split(path, '/')) = 3 UNION SELECT 'src') SELECT m.path, coalesce((SELECT folder FROM f WHERE folder = regexp_replace(m.path, '/[^/]*$', '') AND contains(m.path, '/')), CASE WHEN starts_with(m.path, 'src/') THEN 'src' END) AS manifest_folder FROM {module} m")
def nearest_manifest(t):
    folders = t("module").where("module_id % 3 = 0 and size(split(path, '/')) = 3").select(F.substring_index("path", "/", 2).alias("folder")).distinct()
    return deps.nearest_manifest(t("module").select("path"), folders.union(folders.sparkSession.createDataFrame([("src",)], "folder string")))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN FALSE WHEN c_nationkey % 2 = 0 THEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') ELSE TRUE END AS enabled FROM customer")
def member_enabled(t):
    allow = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("MACHINERY"), F.lit("HOUSEHOLD"))).otherwise(F.array().cast("array<string>"))
    return t("customer").select("c_custkey", deps.member_enabled(F.col("c_mktsegment"), allow, F.array(F.lit("BUILDING"))).alias("enabled"))


@query("SELECT package, min(dep_type) AS dep_type, arg_min(version_req, (dep_type, version_req)) AS version_req, count(*) AS declarations FROM {dependency} GROUP BY package")
def dependency_lookup(t):
    return deps.first_declarations(t("dependency"))


# --- scalar functions --------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE CAST(n AS VARCHAR) || ' bytes' END AS shown FROM (SELECT p_partkey, p_partkey * p_partkey * 3 AS n FROM part)")
def format_bytes(t):
    return t("part").select("p_partkey", text.format_bytes(F.col("p_partkey") * F.col("p_partkey") * 3).alias("shown"))


@query("SELECT item_id, sha256(text) AS sha256_hex FROM benchmark")
def checksum(t):
    return t("benchmark").select("item_id", registry.sha256_hex(F.col("text")).alias("sha256_hex"))


URLS = "CASE page_id % 5 WHEN 0 THEN 'https://github.com/own' || page_id || '/repo' WHEN 1 THEN 'git+https://github.com/own' || page_id || '/repo.git' WHEN 2 THEN 'git@github.com:own' || page_id || '/repo.git' WHEN 3 THEN url ELSE ' https://github.com/o/r' || page_id || '.git ' END"


@query(f"SELECT page_id, CASE WHEN page_id % 5 IN (0, 1, 2) THEN 'own' || page_id WHEN page_id % 5 = 4 THEN 'o' END AS owner, CASE WHEN page_id % 5 IN (0, 1, 2) THEN 'repo' WHEN page_id % 5 = 4 THEN 'r' || page_id END AS repo, CASE WHEN page_id % 5 IN (0, 1, 2) THEN 'https://github.com/own' || page_id || '/repo' WHEN page_id % 5 = 4 THEN 'https://github.com/o/r' || page_id END AS canonical FROM pages")
def repository_parse(t):
    rows = t("pages").select("page_id", F.expr(URLS).alias("address"))
    return rows.withColumns(registry.repository(F.col("address"))).drop("address")


LINES = "CASE event_id % 7 WHEN 0 THEN '## [' || (event_id % 5) || '.2.3] - 2024-01-15' WHEN 1 THEN '## ' || (event_id % 5) || '.0.1 (2024-02-01)' WHEN 2 THEN '# v1.' || (event_id % 5) || '.3 / 2024-01-15' WHEN 3 THEN '## [1.2.' || (event_id % 5) || ']' WHEN 4 THEN 'text ' || event_id WHEN 5 THEN '### Fixed' ELSE '## 1.2.' || (event_id % 5) || '-rc.1' END"


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN (event_id % 5) || '.2.3' WHEN 1 THEN (event_id % 5) || '.0.1' WHEN 2 THEN '1.' || (event_id % 5) || '.3' WHEN 3 THEN '1.2.' || (event_id % 5) WHEN 6 THEN '1.2.' || (event_id % 5) || '-rc.1' END AS version, CASE event_id % 7 WHEN 0 THEN '2024-01-15' WHEN 1 THEN '2024-02-01' WHEN 2 THEN '2024-01-15' END AS date FROM events")
def heading_parse(t):
    return t("events").select("event_id", F.expr(LINES).alias("line")).withColumns(registry.heading(F.col("line"))).drop("line")


CHANGELOG = "SELECT user_id, string_agg(line, chr(10) ORDER BY event_id) AS body FROM (SELECT user_id, event_id, " + LINES + " AS line FROM events) GROUP BY user_id"


@query(
    """WITH l AS (SELECT user_id, event_id, """ + LINES + """ AS line, event_id % 7 IN (0, 1, 2, 3, 6) AS head FROM events),
    n AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS entry_no FROM l)
    SELECT user_id, CAST(entry_no AS BIGINT) AS entry_no, CAST(count(*) FILTER (WHERE NOT head) AS BIGINT) AS lines, coalesce(string_agg(line, chr(10) ORDER BY event_id) FILTER (WHERE NOT head), '') AS body FROM n GROUP BY user_id, entry_no"""
)
def changelog_segments(t):
    lines = t("events").select("user_id", F.struct("event_id", F.expr(LINES).alias("line")).alias("l"))
    logs = lines.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x.line), "\n").alias("body"))
    out = registry.segments(logs, "user_id", "body")
    return out.select("user_id", "entry_no", F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))).cast("long").alias("lines"), "body")


@query(
    """WITH l AS (SELECT user_id, event_id, """ + LINES + """ AS line, event_id % 7 IN (0, 1, 2, 3, 6) AS head FROM events),
    n AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS entry_no FROM l)
    SELECT user_id, CAST(entry_no AS INTEGER) AS entry_no, any_value(CASE WHEN head THEN regexp_extract(line, '[0-9]+[.][0-9]+[.][0-9]+(-rc[.]1)?') END) AS version,
    any_value(CASE WHEN head THEN nullif(regexp_extract(line, '20[0-9]+-[0-9]+-[0-9]+'), '') END) AS date, coalesce(string_agg(line, chr(10) ORDER BY event_id) FILTER (WHERE NOT head), '') AS body FROM n GROUP BY user_id, entry_no"""
)
def changelog_lateral(t):
    from graphloom.functions.tables import register_tables

    lines = t("events").select("user_id", F.struct("event_id", F.expr(LINES).alias("line")).alias("l"))
    logs = lines.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x.line), "\n").alias("body"))
    register_tables(logs.sparkSession)
    return logs.sparkSession.sql("SELECT l.user_id, e.* FROM {logs} l, LATERAL changelog_entries(l.body) e", logs=logs)


@query("SELECT p_partkey, 'src/' || a || '/x.' || b AS pattern, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) - 1 AS INTEGER) AS n FROM part, (VALUES (0, 'a'), (1, NULL)) f(i, f), (VALUES (0, 'ts'), (1, 'js'), (2, '')) g(j, b), LATERAL (SELECT coalesce(f, 'm' || p_partkey) AS a)")
def brace_lateral(t):
    from graphloom.functions.tables import register_tables

    rows = spread(t("part")).select("p_partkey", F.expr("'src/{a,m' || p_partkey || '}/x.{ts,js,}'").alias("glob"))
    register_tables(rows.sparkSession)
    return rows.sparkSession.sql("SELECT p.p_partkey, e.* FROM {rows} p, LATERAL brace_expansions(p.glob, true) e", rows=rows)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '**/' || p_name WHEN 1 THEN '**/x' || p_partkey WHEN 2 THEN '' ELSE '**/a/b' || p_partkey END AS glob FROM part")
def gitignore_to_glob(t):
    line = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name || '/' WHEN 1 THEN '/x' || p_partkey WHEN 2 THEN '!' || p_name ELSE ' a/b' || p_partkey || '// ' END")
    return t("part").select("p_partkey", text.gitignore_column(line).alias("glob"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9-]', '-', 'g') AS slug FROM part")
def project_slug(t):
    return t("part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("SELECT event_id, 'node_modules/p' || event_id AS key, 'p' || event_id AS name, '1.0.' || (event_id % 9) AS version FROM events WHERE event_id % 3 <> 0")
def lockfile_npm(t):
    from graphloom.sources.lockfiles import npm_lock

    entry = F.concat(F.lit('"'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x/p"), F.col("event_id"))).otherwise(F.concat(F.lit("node_modules/p"), F.col("event_id"))), F.lit('":{"version":"1.0.'), F.col("event_id") % 9, F.lit('"}'))
    files = t("events").select(F.concat(F.lit("lock"), F.col("user_id")).alias("path"), entry.alias("e")).groupBy("path").agg(F.concat(F.lit('{"packages":{"":{"version":"0"},'), F.array_join(F.collect_list("e"), ","), F.lit("}}")).alias("content"))
    return npm_lock(files).select(F.substring("name", 2, 20).cast("long").alias("event_id"), F.concat(F.lit("node_modules/"), F.col("name")).alias("key"), "name", "version")


# --- reports -----------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (WHERE a AND b) AS common, count(*) FILTER (WHERE NOT b) AS only_a, count(*) FILTER (WHERE NOT a) AS only_b, round(count(*) FILTER (WHERE a AND b) * 100.0 / greatest(count(*) FILTER (WHERE a), count(*) FILTER (WHERE b)), 4) AS agreement FROM (SELECT path, bool_or(type = 'unused_export') AS a, bool_or(type = 'code_smell') AS b FROM {finding} WHERE type IN ('unused_export', 'code_smell') GROUP BY path)")
def overlap(t):
    f = t("finding")
    return report.overlap(f.where("type = 'unused_export'"), f.where("type = 'code_smell'"), ["path"])


FOUND = "SELECT '/root/' || path || CASE WHEN module_id % 2 = 1 THEN '.bak' ELSE '' END AS path, CASE WHEN module_id % 7 <> 0 THEN 'N' || (module_id % 500) END AS name FROM {finding} WHERE type = 'unused_export'"
TRUTH = "SELECT module_id AS position, CASE module_id % 3 WHEN 0 THEN path WHEN 1 THEN split_part(path, '/', 2) || '/' || split_part(path, '/', 3) ELSE path || '.orig' END AS path, CASE WHEN module_id % 7 <> 0 THEN 'n' || (module_id % 500) END AS name, module_id % 2 = 0 AS unused FROM {module} WHERE module_id % 5 <> 0"


@query(
    f"""WITH f AS (SELECT row_number() OVER () AS k, lower(path) AS path, coalesce(lower(name), '') AS name FROM ({FOUND})), t AS (SELECT position, lower(path) AS path, coalesce(name, '') AS name, unused FROM ({TRUTH})),
    e AS (SELECT k, min(position) FILTER (WHERE unused) AS met, bool_or(NOT unused) AS used FROM f JOIN t ON f.name = t.name AND f.path <> '' AND t.path <> '' AND (contains(f.path, t.path) OR contains(t.path, f.path)) GROUP BY k),
    c AS (SELECT count(met) AS tp, count(*) FILTER (WHERE met IS NULL) AS fp, (SELECT count(*) FROM t WHERE unused) - count(DISTINCT met) AS fn FROM e)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c"""
)
def accuracy(t):
    found = t("finding").where("type = 'unused_export'").select(
        F.upper(F.concat(F.lit("\\root\\"), F.replace("path", F.lit("/"), F.lit("\\")), F.when(F.col("module_id") % 2 == 1, ".bak").otherwise(""))).alias("path"),
        F.when(F.col("module_id") % 7 != 0, F.concat(F.lit("N"), F.col("module_id") % 500)).alias("name"),
    )
    truth = t("module").where("module_id % 5 <> 0").selectExpr("module_id as position", "case module_id % 3 when 0 then path when 1 then split_part(path, '/', 2) || '/' || split_part(path, '/', 3) else path || '.orig' end as path", "case when module_id % 7 <> 0 then 'n' || (module_id % 500) end as name", "module_id % 2 = 0 as is_unused")
    return report.accuracy(found, truth)


BENCH = "SELECT tool, count(*) AS runs, min(micros) AS least, max(micros) AS most, round(avg(micros), 4) AS mean, max(CASE WHEN k = n // 2 + 1 THEN micros END) AS median, round(stddev_pop(micros), 4) AS deviation, round(count(*) FILTER (WHERE success) * 100.0 / count(*), 4) AS success_rate FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY micros, run_no) AS k, count(*) OVER (PARTITION BY tool) AS n FROM {run}) GROUP BY tool"


@query(BENCH)
def bench_stats(t):
    return report.bench_stats(t("run"))


@query(f"SELECT tool, (SELECT arg_min(tool, mean) FROM ({BENCH})) AS best, round((mean - (SELECT min(mean) FROM ({BENCH}))) * 100.0 / (SELECT min(mean) FROM ({BENCH})), 4) AS slower_percent FROM ({BENCH})")
def bench_ranking(t):
    return report.fastest(report.bench_stats(t("run")))


@query("SELECT tool, CAST(rank AS INTEGER) AS rank, run_no, micros, previous, CASE WHEN previous > 0 THEN round((micros - previous) * 100.0 / previous, 4) END AS change_percent FROM (SELECT *, row_number() OVER w AS rank, lead(micros) OVER w AS previous FROM {run} WINDOW w AS (PARTITION BY tool ORDER BY ts DESC, run_no DESC)) WHERE rank <= 10")
def run_trend(t):
    return report.trend(t("run"))


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_checked FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 60 MINUTE <= TIMESTAMP '2024-01-31 00:00:00'")
def due_projects(t):
    return polling.due_projects(t("events"), "2024-01-31 00:00:00")


@query("SELECT CAST(user_id AS VARCHAR) AS project, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_checked FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id HAVING max(ts) + INTERVAL 60 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE user_id IS NOT NULL) - INTERVAL 2 HOUR")
def due_by_timers(t):
    events = t("events", stream=True)
    checks = events.select(F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("int").alias("minutes"), F.lit(None).cast("boolean").alias("enabled"))
    log = scratch_path(events.sparkSession, "due-log")
    due_state.start_log(due_state.due_log(checks), log, scratch_path(events.sparkSession, "due-state")).awaitTermination()
    return due_state.due_now(events.sparkSession.read.schema(due_state.LOG).parquet(log)).select("project", F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss").alias("last_checked"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(t):
    return polling.event_windows(t("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM n GROUP BY user_id, k")
def event_sessions(t):
    return polling.sessions(t("events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"SELECT category, CAST(rank AS INTEGER) AS rank, finding_id, type, greatest(n - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, finding_id) AS rank, count(*) OVER (PARTITION BY category) AS n FROM (SELECT finding_id, type, size, {CATEGORY} AS category FROM {{finding}})) WHERE rank <= 10")
def report_sections(t):
    return findings.report_sections(t("finding"), tie="finding_id").select("category", "rank", "finding_id", "type", "more")


# --- files and saved answers -------------------------------------------------------------------
# The texts are made of table rows in Spark, and read back by the library; the SQL says what must come out.


def _texts(t, table: str, key: str, sql: str, path: str = "path") -> DataFrame:
    return t(table).select(key, F.expr(f"'f' || {key}").alias(path), F.expr(sql).alias("content"))


@query(
    """SELECT 'f' || c_custkey AS path, 'n' || c_custkey AS name, '1.' || (c_custkey % 5) || '.0' AS version, package, version_req, dep_type FROM (
    SELECT c_custkey, 'a' || c_custkey AS package, '^1.0.0' AS version_req, 'Runtime' AS dep_type FROM customer UNION ALL SELECT c_custkey, 'b', '2', 'Development' FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, '@s/c', '*', 'Peer' FROM customer WHERE c_custkey % 3 <> 0) WHERE c_custkey % 7 <> 0"""
)
def manifest_rows(t):
    text = """'{' || CASE WHEN c_custkey % 7 <> 0 THEN '"name":"n' || c_custkey || '",' ELSE '' END || '"version":"1.' || (c_custkey % 5) || '.0","dependencies":{"a' || c_custkey || '":"^1.0.0"}'
        || CASE WHEN c_custkey % 3 <> 0 THEN ',"devDependencies":{"b":"2"},"peerDependencies":{"@s/c":"*"}' ELSE '' END || '}'"""
    return deps.manifest_rows(_texts(t, "customer", "c_custkey", text))


@query("SELECT 'f' || c_custkey AS lockfile, CASE c_custkey % 3 WHEN 0 THEN '@s/p' || c_custkey ELSE 'p' || c_custkey END AS name, '1.' || (c_custkey % 5) || '.0' AS version, CASE WHEN c_custkey % 2 = 0 THEN 'sha' || c_custkey END AS checksum FROM customer")
def lockfile_pnpm(t):
    from graphloom.sources.lockfiles import pnpm_lock

    text = "'packages:\\n  ' || CASE c_custkey % 3 WHEN 0 THEN '/@s/p' || c_custkey || '/1.' WHEN 1 THEN '/p' || c_custkey || '/1.' ELSE 'p' || c_custkey || '@1.' END || (c_custkey % 5) || '.0:' || CASE WHEN c_custkey % 2 = 0 THEN '\\n    resolution: {integrity: sha' || c_custkey || '}\\n' ELSE ' {}\\n' END"
    return pnpm_lock(_texts(t, "customer", "c_custkey", text)).drop("resolved")


@query("SELECT 'f' || c_custkey AS lockfile, 'p' || c_custkey AS name, '0.' || (c_custkey % 9) || '.1' AS version, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey END AS checksum, 'registry+x' AS resolved FROM customer UNION ALL SELECT 'f' || c_custkey, 'q', '1.0.0', NULL, NULL FROM customer WHERE c_custkey % 5 = 0")
def lockfile_cargo(t):
    from graphloom.sources.lockfiles import cargo_lock

    text = """'[[package]]\\nname = "p' || c_custkey || '"\\nversion = "0.' || (c_custkey % 9) || '.1"\\nsource = "registry+x"\\n' || CASE WHEN c_custkey % 2 = 0 THEN 'checksum = "c' || c_custkey || '"\\n' ELSE '' END
        || CASE WHEN c_custkey % 5 = 0 THEN '[[package]]\\nname = "q"\\nversion = "1.0.0"\\n' ELSE '' END"""
    return cargo_lock(_texts(t, "customer", "c_custkey", text))


@query(
    """SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN 'workspace' ELSE 'n' || c_custkey END AS name, package, version_req, dep_type, workspace FROM (
    SELECT c_custkey, 's' || c_custkey AS package, '1.' || (c_custkey % 3) AS version_req, 'Runtime' AS dep_type, FALSE AS workspace FROM customer UNION ALL SELECT c_custkey, 'u', '*', 'Development', TRUE FROM customer
    UNION ALL SELECT c_custkey, 'v', '2', 'Build', FALSE FROM customer WHERE c_custkey % 2 = 0)"""
)
def cargo_manifest(t):
    from graphloom.sources.lockfiles import cargo_manifest as read

    text = """CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '[package]\\nname = "n' || c_custkey || '"\\nversion = "0.1.0"\\n' END || '[dependencies]\\ns' || c_custkey || ' = "1.' || (c_custkey % 3) || '"\\nbad = 3\\n[dev-dependencies]\\nu = {workspace = true}\\n'
        || CASE WHEN c_custkey % 2 = 0 THEN '[build-dependencies]\\nv = {version = "2"}\\n' ELSE '' END"""
    return read(_texts(t, "customer", "c_custkey", text)).select("path", "name", "package", "version_req", "dep_type", "workspace")


@query("SELECT 'f' || c_custkey AS path, 'crates/a' || c_custkey AS member FROM customer UNION ALL SELECT 'f' || c_custkey, 'x/**' FROM customer")
def cargo_members(t):
    from graphloom.sources.lockfiles import cargo_members as read

    return read(_texts(t, "customer", "c_custkey", "'[workspace]\\nmembers = [\"crates/a' || c_custkey || '\", \"x/**\"]\\n'"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1.0.' || c_custkey WHEN 1 THEN '2.0.' || c_custkey WHEN 2 THEN 'unknown' END AS version, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'MIT' WHEN c_custkey % 4 = 0 THEN 'ISC' END AS license,
    CASE WHEN c_custkey % 4 IN (0, 1) THEN 'o' || c_custkey END AS owner FROM customer"""
)
def registry_latest(t):
    from graphloom.sources.snapshots import latest

    body = """CASE c_custkey % 4 WHEN 0 THEN '{"dist-tags":{"latest":"1.0.' || c_custkey || '"},"license":' || CASE WHEN c_custkey % 3 = 0 THEN '{"type":"MIT"}' ELSE '"ISC"' END || ',"repository":' || CASE WHEN c_custkey % 8 = 0 THEN '{"url":"git+https://github.com/o' || c_custkey || '/r.git"}' ELSE '"git@github.com:o' || c_custkey || '/r"' END || '}'
        WHEN 1 THEN '{"crate":{"max_version":"2.0.' || c_custkey || '","repository":"https://github.com/o' || c_custkey || '/r"}}' WHEN 2 THEN '{}' END"""
    answers = t("customer").select(F.expr("CASE c_custkey % 4 WHEN 1 THEN 'crates.io' WHEN 2 THEN 'jsr' ELSE 'npm' END").alias("registry"), F.col("c_custkey").cast("string").alias("package"), F.expr(body).alias("body"))
    return latest(answers).select(F.col("package").cast("long").alias("c_custkey"), "version", "license", "owner")


@query("SELECT 'r' || user_id AS repo, CASE min(k) WHEN 0 THEN 'CHANGELOG.md' WHEN 1 THEN 'HISTORY.md' ELSE 'RELEASES' END AS name FROM (SELECT user_id, event_id % 4 AS k FROM events WHERE event_id % 4 < 3) GROUP BY user_id")
def changelog_choice(t):
    from graphloom.sources.snapshots import changelog

    name = "CASE event_id % 4 WHEN 0 THEN 'CHANGELOG.md' WHEN 1 THEN 'HISTORY.md' WHEN 2 THEN 'RELEASES' ELSE 'README.md' END"
    return changelog(t("events").select(F.expr("'r' || user_id").alias("repo"), F.expr(name).alias("name"), F.lit("x").alias("content"))).select("repo", "name")


@query("SELECT c_custkey AS repo, 'v1.' || c_custkey AS tag, 'one' AS name, c_custkey % 2 = 0 AS prerelease FROM customer UNION ALL SELECT c_custkey, 'v2', NULL, FALSE FROM customer WHERE c_custkey % 3 = 0")
def release_rows(t):
    from graphloom.sources.snapshots import releases

    body = """'[{"tag_name":"v1.' || c_custkey || '","name":"one","prerelease":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' || CASE WHEN c_custkey % 3 = 0 THEN ',{"tag_name":"v2"}' ELSE '' END || ']'"""
    return releases(t("customer").select(F.col("c_custkey").alias("repo"), F.expr(body).alias("body"))).drop("published_at")


@query("SELECT 'unused_export' AS type, 'm' || c_custkey AS path, 'e' || c_custkey AS name FROM customer UNION ALL SELECT 'unreachable_file', 'u' || c_custkey, NULL FROM customer WHERE c_custkey % 2 = 0")
def own_report(t):
    from graphloom.sources.snapshots import own_output

    text = """'{"findings":[{"type":"unused_export","module":"m' || c_custkey || '","export_name":"e' || c_custkey || '"}' || CASE WHEN c_custkey % 2 = 0 THEN ',{"type":"unreachable_file","path":"u' || c_custkey || '"}' ELSE '' END || ']}'"""
    return own_output(_texts(t, "customer", "c_custkey", text))


@query("SELECT 'unreachable_file' AS type, 'u' || c_custkey AS path, NULL AS name FROM customer UNION ALL SELECT 'unused_export', 'i' || c_custkey, 'e' FROM customer UNION ALL SELECT 'unused_npm_dependency', 'i' || c_custkey, 'd' || c_custkey FROM customer WHERE c_custkey % 2 = 0")
def other_report(t):
    from graphloom.sources.snapshots import other_output

    text = """'{"files":["u' || c_custkey || '"],"issues":[{"file":"i' || c_custkey || '","exports":[{"name":"e"}],"dependencies":[' || CASE WHEN c_custkey % 2 = 0 THEN '{"name":"d' || c_custkey || '"}' ELSE '' END || ']}]}'"""
    return other_output(_texts(t, "customer", "c_custkey", text))


@query(
    """SELECT * FROM (SELECT 'unused_export' AS type, 'm' || c_custkey AS path, 'e' || c_custkey AS name FROM customer WHERE c_custkey % 5 IN (0, 3) UNION ALL SELECT 'unreachable_file', 'u' || c_custkey, NULL FROM customer WHERE c_custkey % 5 IN (1, 2, 3)
    UNION ALL SELECT 'unused_export', 'i' || c_custkey, 'e' FROM customer WHERE c_custkey % 5 IN (1, 2) UNION ALL SELECT 'unused_npm_dependency', 'i' || c_custkey, 'd' || c_custkey FROM customer WHERE c_custkey % 5 = 2)"""
)
def mixed_reports(t):
    from graphloom.sources.snapshots import any_output

    text = """CASE c_custkey % 5 WHEN 0 THEN '{"findings":[{"type":"unused_export","module":"m' || c_custkey || '","export_name":"e' || c_custkey || '","line":[1,{"a":null}]},7,{"type":3}]}'
        WHEN 1 THEN '{"files":["u' || c_custkey || '"],"issues":[{"file":"i' || c_custkey || '","exports":[{"name":"e","pos":1}],"dependencies":null}],"extra":{"x":[]}}'
        WHEN 2 THEN '{"files":[{"path":"u' || c_custkey || '","size":3}],"issues":[{"file":"i' || c_custkey || '","exports":["e"],"dependencies":["d' || c_custkey || '"]},"odd"]}'
        WHEN 3 THEN '{"findings":[{"type":"unused_export","path":"m' || c_custkey || '","name":"e' || c_custkey || '"}],"files":[null,"u' || c_custkey || '",4]}' ELSE '{"findings":[' || c_custkey END"""
    return any_output(_texts(t, "customer", "c_custkey", text))


@query("SELECT 'line ' || event_id || CASE event_id % 3 WHEN 0 THEN ' Unused export' ELSE ' DEAD code' END AS value FROM events WHERE event_id % 3 < 2")
def text_report(t):
    from graphloom.sources.snapshots import text_output

    return text_output(t("events").select(F.expr("'line ' || event_id || CASE event_id % 3 WHEN 0 THEN ' Unused export' WHEN 1 THEN ' DEAD code' ELSE ' fine' END").alias("value")))


# --- scripts -----------------------------------------------------------------------------------


@query("SELECT m.path, i.source, i.kind, CASE i.kind WHEN 'Static' THEN 'useThing,default' WHEN 'TypeOnly' THEN 'T' ELSE '' END AS names FROM {import} i JOIN {module} m ON m.module_id = i.module_id")
def script_imports(t):
    from graphloom.sources.files import extract_imports

    line = "CASE kind WHEN 'Static' THEN 'import D, { useThing as u } from \"' || source || '\"' WHEN 'TypeOnly' THEN 'import type { T } from \"' || source || '\"' ELSE 'const x = () => import(\"' || source || '\") // import \"no\"' END"
    texts = t("import").groupBy("module_id").agg(F.array_join(F.collect_list(F.expr(line)), "\n").alias("content")).join(t("module").select("module_id", "path"), "module_id")
    return extract_imports(texts).withColumn("names", F.array_join("names", ","))


@query(f"SELECT path, name, CASE WHEN kind = 'Class' THEN 'Class' ELSE 'Function' END AS raw_kind, CAST(row_number() OVER (PARTITION BY path ORDER BY symbol_id) AS INTEGER) AS line, is_exported, CASE WHEN kind <> 'Class' THEN CAST(parameter_count AS INTEGER) END AS parameter_count, CASE WHEN kind <> 'Class' THEN 1 + CAST(complexity AS INTEGER) END AS complexity, CASE WHEN kind <> 'Class' THEN 1 END AS max_nesting_depth FROM ({SYM})")
def script_symbols(t):
    from graphloom.sources.symbols import scripts

    body = "CASE WHEN kind = 'Class' THEN 'class ' || name || ' { run() { return 1 } }' ELSE 'function ' || name || '(' || array_join(transform(sequence(0, parameter_count), x -> 'a' || x), ', ', '') || ') { {} ' || repeat('if (a0) x(); ', complexity) || '}' END"
    body = body.replace("sequence(0, parameter_count)", "slice(sequence(0, parameter_count), 1, parameter_count)")
    rows = _symbols(t).withColumn("text", F.expr(f"CASE WHEN is_exported THEN 'export ' ELSE '' END || {body}"))
    texts = rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("symbol_id", "text"))), lambda x: x.text), "\n").alias("content"))
    return scripts(texts, ["symbols"]).select("path", F.explode("symbols").alias("s")).select("path", "s.*").select("path", "name", "raw_kind", "line", "is_exported", "parameter_count", "complexity", "max_nesting_depth")


@query(
    """WITH k AS (SELECT regexp_replace(path, '\\.[^./]+$', '') AS key, arg_min(path, (length(path), path)) AS resolved_path FROM {module} GROUP BY 1)
    SELECT path, k.resolved_path FROM {module} m JOIN k ON k.key = regexp_replace(path, '\\.[^./]+$', '') WHERE NOT starts_with(path, 'virtual:')"""
)
def path_resolution(t):
    from graphloom.sources.files import resolve

    paths = t("module").select("path")
    up = F.expr("'.././' || element_at(split(path, '/'), 2) || '/x/../' || regexp_replace(element_at(split(path, '/'), -1), '\\\\.[^./]+$', '')")
    return resolve(paths.where("not startswith(path, 'virtual:')").withColumn("source", up), paths).select("path", "resolved_path")


@query(r"SELECT path, regexp_matches(path, '^pages/(.*/)?[^/]*\.tsx?$') OR regexp_matches(path, '^conf/[^/]*/next\.config\.js$') AS is_entry FROM {module}")
def entry_patterns(t):
    from graphloom.plans import entries

    own = rule_files.RuleFile("own", 1, (), (), (), (("pages", "**/pages/**/*.{ts,tsx}", 5), ("conf", "conf/*/next.config.js", 9)))
    return entries.mark_entries(t("module").select("path"), [], entries.entry_patterns([own]))


# --- names, checksums and ranges ---------------------------------------------------------------


@query("SELECT item_id, item_id % 3 <> 2 AS fits FROM benchmark WHERE text IS NOT NULL")
def checksum_verify(t):
    given = F.when(F.col("item_id") % 3 == 0, registry.sha512_sri(F.col("text"))).when(F.col("item_id") % 3 == 1, F.regexp_replace(registry.sha512_sri(F.col("text")), "^sha512-", "")).otherwise(F.lit("sha512-AAAA"))
    return t("benchmark").where("text is not null").select("item_id", registry.verify_sri(F.col("text"), given).alias("fits"))


@query("SELECT dep_no, CASE WHEN starts_with(package, '@') THEN replace(package, '/', '%2f') ELSE package END AS encoded FROM {dependency}")
def registry_names(t):
    return t("dependency").select("dep_no", text.registry_name(F.col("package")).alias("encoded"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Next.js' WHEN 1 THEN 'Vue' WHEN 2 THEN 'Svelte' WHEN 3 THEN 'React' END AS framework FROM part")
def framework_by_content(t):
    content = F.expr("CASE p_partkey % 5 WHEN 0 THEN '{\"react\":1,\"next\":2}' WHEN 1 THEN '{\"@vue/x\":1,\"svelte\":1}' WHEN 2 THEN '{\"svelte\":1}' WHEN 3 THEN '{\"react\":1}' ELSE p_name END")
    return t("part").select("p_partkey", text.framework_by_content(content).alias("framework"))


@query(
    f"""SELECT dep_no, NOT contains(version, '-') AND CASE dep_no % 4 WHEN 0 THEN l1 = 1 OR l1 >= 3 WHEN 1 THEN (l1, l2, l3) >= (0, 2, 0) AND (l1, l2, l3) <= (2, 3, 4) WHEN 2 THEN (l1, l2, l3) >= (1, 3, 0) AND l1 < 3 ELSE TRUE END AS inside
    FROM (SELECT *, {', '.join(f"{_triple('version', k)} AS l{k}" for k in (1, 2, 3))} FROM {{latest}})"""
)
def version_ranges(t):
    req = F.expr("CASE dep_no % 4 WHEN 0 THEN '1.x || >=3.0.0' WHEN 1 THEN '0.2.0 - 2.3.4' WHEN 2 THEN '>1.2 <3' ELSE '*' END")
    return t("latest").select("dep_no", versions.admits(F.col("version"), req).alias("inside"))


#: Each dependency's requirement in one of seven forms, and the versions published under forty names.
REQUIRED = """'n' || (dep_no % 40) AS package, CASE dep_no % 7 WHEN 0 THEN '^' || {v} WHEN 1 THEN '~' || {v} WHEN 2 THEN '>=0.' || (dep_no % 5) || ' <2' WHEN 3 THEN '1.x || >=3.2.1' WHEN 4 THEN '0.2.0 - 2.3.4' WHEN 5 THEN '>=' || {v} || '-alpha' ELSE 'latest' END AS req"""
_V = "(dep_no % 4) || '.' || (dep_no % 7) || '.' || (dep_no % 11)"
_R = "(dep_no % 4, dep_no % 7, dep_no % 11)"


@query(
    f"""WITH v AS (SELECT DISTINCT 'n' || (dep_no % 40) AS package, version, {', '.join(f"{_triple('version', k)} AS l{k}" for k in (1, 2, 3))}, contains(version, '-') AS pre, regexp_extract(version, '-(.*)$', 1) AS tag FROM {{latest}}),
    q AS (SELECT DISTINCT dep_no, {REQUIRED.replace('{v}', _V)} FROM {{dependency}}),
    hit AS (SELECT q.dep_no, v.* FROM q JOIN v ON v.package = q.package AND CASE dep_no % 7
        WHEN 0 THEN NOT pre AND (l1, l2, l3) >= {_R} AND CASE WHEN dep_no % 4 > 0 THEN l1 = dep_no % 4 WHEN dep_no % 7 > 0 THEN l1 = 0 AND l2 = dep_no % 7 ELSE (l1, l2, l3) = {_R} END
        WHEN 1 THEN NOT pre AND (l1, l2, l3) >= {_R} AND l1 = dep_no % 4 AND l2 = dep_no % 7 WHEN 2 THEN NOT pre AND (l1, l2, l3) >= (0, dep_no % 5, 0) AND l1 < 2
        WHEN 3 THEN NOT pre AND (l1 = 1 OR (l1, l2, l3) >= (3, 2, 1)) WHEN 4 THEN NOT pre AND (l1, l2, l3) >= (0, 2, 0) AND (l1, l2, l3) <= (2, 3, 4)
        WHEN 5 THEN CASE WHEN pre THEN (l1, l2, l3) = {_R} ELSE (l1, l2, l3) >= {_R} END ELSE FALSE END)
    SELECT q.dep_no, q.package, q.req, b.best FROM q LEFT JOIN (SELECT dep_no, arg_max(version, (l1, l2, l3, NOT pre, tag)) AS best FROM hit GROUP BY dep_no) b ON b.dep_no = q.dep_no"""
)
def best_satisfying(t):
    asked = t("dependency").selectExpr("dep_no", *(x.replace("{v}", _V) for x in REQUIRED.split(", CASE")[:1]), "CASE" + REQUIRED.replace("{v}", _V).split(", CASE")[1])
    return versions.best_satisfying(asked, t("latest").selectExpr("'n' || (dep_no % 40) AS package", "version")).select("dep_no", "package", "req", "best")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
