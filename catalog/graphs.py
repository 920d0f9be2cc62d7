"""Import resolution, file and symbol graphs, reading order and data flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Catalog, table
from catalog.corpora import (
    DEGREES, LAYERED, PART_DEPS, PART_EDGES, PART_FILES, PART_MEASURED, PART_SYMBOLS, TYPED_EDGES, layered,
    part_files, part_symbols, typed_edges,
)
from stratacode.operators import edges as e
from stratacode.operators import flow, graph, order
from stratacode.operators.common import with_batch
from stratacode.session import cut_lineage

C = Catalog()


def _deps(spark, d):
    files, symbols = part_files(spark, d), part_symbols(spark, d)
    return files, symbols, e.resolve_dependencies(files, symbols)


def _edges(spark, d):
    """Files, symbols, dependencies and edges; the resolver knows the files of both ends."""
    files, symbols = part_files(spark, d), part_symbols(spark, d)
    resolved = e.resolve_imports(files, symbols)
    return files, symbols, resolved.select("repo_id", "source_symbol_id", "target_symbol_id", "dep_type"), e.import_edges(resolved)


@C.query("symbols_with_file", f"""WITH {PART_FILES}, {PART_SYMBOLS}
SELECT repo_id, symbol_id, kind, path FROM symbols JOIN files USING (repo_id, file_id)""")
def symbols_with_file(spark, d):
    return e.with_file(part_symbols(spark, d), part_files(spark, d)).select("repo_id", "symbol_id", "kind", "path")


@C.query("embeddable_symbols", f"""WITH {PART_SYMBOLS}
SELECT repo_id, symbol_id, kind FROM symbols WHERE kind IN ('function', 'class', 'method') AND source_code <> ''""")
def embeddable_symbols(spark, d):
    return e.has_source(e.of_kind(part_symbols(spark, d), e.EMBEDDABLE_KINDS)).select("repo_id", "symbol_id", "kind")


@C.query("first_symbols", f"""WITH {PART_SYMBOLS}
SELECT repo_id, file_id, symbol_id FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, file_id ORDER BY ordinal, symbol_id) AS rn
  FROM symbols WHERE kind IN ('function', 'class')) WHERE rn = 1""")
def first_symbols(spark, d):
    return e.first_symbol(part_symbols(spark, d), e.NODE_KINDS)


@C.query("import_paths", f"""WITH {PART_SYMBOLS}
SELECT repo_id, symbol_id, split_part(ltrim(replace(name, '.', '/'), './'), ' as ', 1) AS import_path
FROM symbols WHERE kind = 'import'""")
def import_paths(spark, d):
    return e.normalise_imports(part_symbols(spark, d)).drop("file_id")


@C.query("resolve_dependencies", f"WITH {PART_DEPS} SELECT * FROM deps")
def resolve_dependencies(spark, d):
    return _deps(spark, d)[2]


@C.query("file_edges", f"WITH {PART_EDGES} SELECT * FROM edges")
def file_edges(spark, d):
    """From the stored form of the dependencies, which knows symbols only."""
    _, symbols, deps = _deps(spark, d)
    return e.file_edges(deps, symbols)


@C.query("fan_metrics", f"WITH {PART_MEASURED} SELECT repo_id, file_id, fan_in, fan_out FROM measured")
def fan_metrics(spark, d):
    files, _, _, edges = _edges(spark, d)
    return e.fan_metrics(files, edges).select("repo_id", "file_id", "fan_in", "fan_out")


@C.query("dependency_counts", f"WITH {PART_DEPS} SELECT repo_id, count(*) AS total_dependencies FROM deps GROUP BY 1")
def dependency_counts(spark, d):
    _, symbols, deps = _deps(spark, d)
    return e.dependency_counts(deps, symbols)


@C.query("weighted_links", f"""WITH {TYPED_EDGES}, per_type AS (
  SELECT repo_id, src_file_id, tgt_file_id, dep_type, count(*) AS n FROM edges GROUP BY 1, 2, 3, 4)
SELECT repo_id, src_file_id AS source, tgt_file_id AS target, sum(n)::BIGINT AS weight,
       (array_agg(dep_type ORDER BY n DESC, dep_type))[1] AS type FROM per_type GROUP BY 1, 2, 3""")
def weighted_links(spark, d):
    return graph.weighted_links(typed_edges(spark, d))


_SCORED = """CASE WHEN language = 'python' THEN 'critical' WHEN language = 'typescript' THEN 'caution'
             WHEN language = 'javascript' THEN 'safe' END"""


def _scored(files):
    return files.withColumn("criticality", F.expr(_SCORED))


@C.query("file_graph_nodes", f"""WITH {PART_MEASURED}
SELECT repo_id, file_id AS id, split_part(path, '/', -1) AS label, path, regexp_replace(path, '/[^/]*$', '') AS "group",
       'file' AS kind, coalesce(loc, 0) AS loc, coalesce({_SCORED}, 'medium') AS criticality,
       CASE {_SCORED} WHEN 'critical' THEN 100.0 WHEN 'caution' THEN 75.0 WHEN 'safe' THEN 25.0 ELSE 50.0 END::DOUBLE AS criticality_score,
       coalesce(language, 'unknown') AS language, fan_in, fan_out FROM measured""")
def file_graph_nodes(spark, d):
    files, symbols, deps, edges = _edges(spark, d)
    return graph.file_graph(_scored(e.fan_metrics(files, edges)), symbols, deps)[0]


@C.query("file_graph_links", f"""WITH {PART_EDGES}
SELECT repo_id, src_file_id AS source, tgt_file_id AS target, 'imports' AS type, count(*) AS weight FROM edges GROUP BY 1, 2, 3""")
def file_graph_links(spark, d):
    files, symbols, deps = _deps(spark, d)
    # Links do not depend on the degrees of the nodes.
    plain = _scored(files).selectExpr("*", "0 AS fan_in", "0 AS fan_out")
    return graph.file_graph(plain, symbols, deps)[1]


@C.query("file_graph_metadata", f"""WITH {PART_EDGES}
SELECT f.repo_id, count(*) AS total_nodes, any_value(coalesce(n, 0)) AS total_edges, count(DISTINCT split_part(path, '/', 1)) AS clusters
FROM files f LEFT JOIN (SELECT repo_id, count(DISTINCT (src_file_id, tgt_file_id)) AS n FROM edges GROUP BY 1) l USING (repo_id)
GROUP BY 1""")
def file_graph_metadata(spark, d):
    files, symbols, deps, edges = _edges(spark, d)
    return graph.graph_metadata(files, graph.weighted_links(edges))


@C.query("symbol_graph_nodes", f"""WITH {PART_FILES}, {PART_SYMBOLS}
SELECT repo_id, symbol_id AS id, name AS label, path, regexp_replace(path, '/[^/]*$', '') AS "group", kind,
       (end_line - start_line + 1)::INT AS loc, cyclomatic_complexity AS complexity, coalesce({_SCORED}, 'medium') AS criticality,
       CASE {_SCORED} WHEN 'critical' THEN 100.0 WHEN 'caution' THEN 75.0 WHEN 'safe' THEN 25.0 ELSE 50.0 END::DOUBLE AS criticality_score
FROM symbols JOIN files USING (repo_id, file_id) WHERE kind IN ('function', 'class')""")
def symbol_graph_nodes(spark, d):
    return graph.symbol_nodes(_scored(part_files(spark, d)), part_symbols(spark, d))


# Any symbol may depend on any other here, so that every endpoint rule is met.
def _wild_deps(spark, d):
    symbols = part_symbols(spark, d)
    target = symbols.selectExpr(
        "repo_id", "symbol_id AS target_symbol_id", "ordinal AS slot", "kind AS target_kind"
    )
    return symbols, symbols.selectExpr("repo_id", "symbol_id AS source_symbol_id", "ordinal + 1 AS slot").join(
        target, ["repo_id", "slot"]
    ).selectExpr("repo_id", "source_symbol_id", "target_symbol_id", "concat('t_', target_kind) AS dep_type")


_WILD_DEPS = """deps AS (
  SELECT s.repo_id, s.symbol_id AS source_symbol_id, t.symbol_id AS target_symbol_id, 't_' || t.kind AS dep_type
  FROM symbols s JOIN symbols t ON s.repo_id = t.repo_id AND t.ordinal = s.ordinal + 1)"""


@C.query("symbol_graph_links", f"""WITH {PART_SYMBOLS}, {_WILD_DEPS}, first_node AS (
  SELECT repo_id, file_id, symbol_id AS first_node FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, file_id ORDER BY ordinal, symbol_id) AS rn
    FROM symbols WHERE kind IN ('function', 'class')) WHERE rn = 1),
ends AS (
  SELECT repo_id, symbol_id, CASE WHEN kind = 'import' THEN first_node ELSE symbol_id END AS node
  FROM symbols LEFT JOIN first_node USING (repo_id, file_id) WHERE kind IN ('function', 'class', 'import')),
pairs AS (
  SELECT d.repo_id, s.node AS source, t.node AS target, dep_type, source_symbol_id, target_symbol_id
  FROM deps d JOIN ends s ON s.repo_id = d.repo_id AND s.symbol_id = source_symbol_id
              JOIN ends t ON t.repo_id = d.repo_id AND t.symbol_id = target_symbol_id
  WHERE s.node <> t.node)
SELECT repo_id, source, target, 1 AS weight,
       (array_agg(dep_type ORDER BY source_symbol_id, target_symbol_id))[1] AS type FROM pairs GROUP BY 1, 2, 3""")
def symbol_graph_links(spark, d):
    symbols, deps = _wild_deps(spark, d)
    return graph.symbol_links(symbols, deps)


@C.query("symbol_graph_metadata", f"""WITH {PART_FILES}, {PART_SYMBOLS}, {_WILD_DEPS}, first_node AS (
  SELECT repo_id, file_id, symbol_id AS first_node FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, file_id ORDER BY ordinal, symbol_id) AS rn
    FROM symbols WHERE kind IN ('function', 'class')) WHERE rn = 1),
ends AS (
  SELECT repo_id, symbol_id, CASE WHEN kind = 'import' THEN first_node ELSE symbol_id END AS node
  FROM symbols LEFT JOIN first_node USING (repo_id, file_id) WHERE kind IN ('function', 'class', 'import')),
links AS (
  SELECT d.repo_id, count(DISTINCT (s.node, t.node)) AS n FROM deps d JOIN ends s ON s.repo_id = d.repo_id AND s.symbol_id = source_symbol_id
  JOIN ends t ON t.repo_id = d.repo_id AND t.symbol_id = target_symbol_id WHERE s.node <> t.node GROUP BY 1)
SELECT s.repo_id, count(*) AS total_nodes, any_value(coalesce(n, 0)) AS total_edges, count(DISTINCT split_part(path, '/', 1)) AS clusters
FROM symbols s JOIN files USING (repo_id, file_id) LEFT JOIN links l ON l.repo_id = s.repo_id WHERE kind IN ('function', 'class') GROUP BY 1""")
def symbol_graph_metadata(spark, d):
    symbols, deps = _wild_deps(spark, d)
    return graph.symbol_graph(_scored(part_files(spark, d)), symbols, deps)[2]


@C.query("module_edges", f"""WITH {PART_EDGES}
SELECT DISTINCT x.repo_id, split_part(s.path, '/', 1) AS src_module, split_part(t.path, '/', 1) AS tgt_module
FROM edges x JOIN files s ON s.repo_id = x.repo_id AND s.file_id = src_file_id
             JOIN files t ON t.repo_id = x.repo_id AND t.file_id = tgt_file_id
WHERE split_part(s.path, '/', 1) <> split_part(t.path, '/', 1)""")
def module_edges(spark, d):
    files, _, _, edges = _edges(spark, d)
    return e.module_edges(edges, files)


@C.query("nation_module_edges", """SELECT DISTINCT o_orderpriority AS repo_id, s_nationkey::VARCHAR AS src_module, c_nationkey::VARCHAR AS tgt_module
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
WHERE s_nationkey <> c_nationkey""")
def nation_module_edges(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey", "o_orderpriority AS repo_id")
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").selectExpr(
        "repo_id", "concat('s', l_suppkey) AS src_file_id", "concat('c', o_custkey) AS tgt_file_id"
    )
    repos = table(spark, d, "orders").selectExpr("o_orderpriority AS repo_id").distinct()
    places = table(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS file_id", "concat(s_nationkey, '/x') AS path").unionByName(
        table(spark, d, "customer").selectExpr("concat('c', c_custkey) AS file_id", "concat(c_nationkey, '/x') AS path")
    )
    # Five repositories share the places; the pairing is on the repository, not all with all files.
    files = places.withColumn("repo_id", F.explode(F.array(*[F.lit(r) for r in (
        "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])))
    return e.module_edges(edges, files.join(repos, "repo_id", "left_semi"))


@C.query("file_dependencies", f"""WITH {PART_EDGES}
SELECT DISTINCT x.repo_id, src_file_id AS file_id, path AS target_path FROM edges x JOIN files t ON t.repo_id = x.repo_id AND t.file_id = tgt_file_id""")
def file_dependencies(spark, d):
    """The imports of a file as rows, of any number."""
    files, _, _, edges = _edges(spark, d)
    return e.file_dependency_paths(edges, files)


@C.query("file_dependency_map", f"""WITH {PART_EDGES}, named AS (
  SELECT x.repo_id, src_file_id AS file_id, path
  FROM (SELECT DISTINCT repo_id, src_file_id, tgt_file_id FROM edges) x JOIN files t ON t.repo_id = x.repo_id AND t.file_id = tgt_file_id)
SELECT repo_id, file_id, string_agg(path, ',' ORDER BY path) AS targets, count(*) AS n_targets FROM named GROUP BY 1, 2""")
def file_dependency_map(spark, d):
    files, _, _, edges = _edges(spark, d)
    return e.file_dep_map(edges, files).withColumn("targets", F.array_join("targets", ","))


@C.query("adjacency", f"""WITH {TYPED_EDGES}
SELECT DISTINCT repo_id, src_file_id AS file_id, 'imports' AS direction, tgt_file_id AS other FROM edges
UNION ALL SELECT DISTINCT repo_id, tgt_file_id, 'imported_by', src_file_id FROM edges""")
def adjacency(spark, d):
    forward, backward = e.adjacency(typed_edges(spark, d))
    return forward.selectExpr("repo_id", "file_id", "'imports' AS direction", "imports AS other").unionByName(
        backward.selectExpr("repo_id", "file_id", "'imported_by' AS direction", "imported_by AS other")
    )


_PAGE_FILES = """raw_pages AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo_id, length(html)::INT AS loc,
         ltrim(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/') AS path FROM pages)"""


def _page_files(spark, d):
    return table(spark, d, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("repo_id"), F.length("html").alias("loc"),
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"),
    )


@C.query("path_tree", f"""WITH {_PAGE_FILES}, parts AS (
  SELECT repo_id, loc, string_split(path, '/') AS parts FROM raw_pages),
prefixes AS (
  SELECT repo_id, loc, parts, unnest(range(1, len(parts) + 1)) AS depth FROM parts),
named AS (
  SELECT repo_id, loc, depth, depth = len(parts) AS leaf, array_to_string(parts[1:depth], '/') AS path FROM prefixes)
SELECT repo_id, path, depth::INT AS depth, CASE WHEN bool_or(leaf) THEN 'file' ELSE 'directory' END AS type,
       count(*) AS files, sum(loc)::BIGINT AS loc, split_part(path, '/', -1) AS name,
       CASE WHEN depth = 1 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent
FROM named GROUP BY repo_id, path, depth""")
def path_tree(spark, d):
    return graph.tree_order(graph.path_tree(_page_files(spark, d)))


_TIERS = f"""WITH RECURSIVE {LAYERED}, {DEGREES},
walk AS (
  SELECT repo_id, file_id, 0 AS tier FROM files
  WHERE NOT EXISTS (SELECT 1 FROM edges WHERE edges.repo_id = files.repo_id AND src_file_id = file_id)
  UNION
  SELECT x.repo_id, x.src_file_id, w.tier + 1 FROM edges x JOIN walk w ON w.repo_id = x.repo_id AND w.file_id = x.tgt_file_id),
tiers AS (SELECT repo_id, file_id, max(tier)::INT AS tier FROM walk GROUP BY 1, 2)"""


def _reading(spark, d):
    files, edges = layered(spark, d)
    return order.reading_order(e.fan_metrics(files, edges), edges), files, edges


@C.query("reading_order", f"""{_TIERS}
SELECT repo_id, file_id, path, fan_in, fan_out, language, tier,
       row_number() OVER (PARTITION BY repo_id ORDER BY tier, fan_in DESC, path) AS position, '' AS annotation
FROM measured JOIN tiers USING (repo_id, file_id)""")
def reading_order(spark, d):
    return _reading(spark, d)[0]


@C.query("topological_tiers", f"{_TIERS} SELECT repo_id, file_id, tier FROM tiers")
def topological_tiers(spark, d):
    files, edges = layered(spark, d)
    return order.topological_tiers(files, edges).select("repo_id", "file_id", "tier")


# Files that reach a loop are stuck; the others have the length of their longest chain.
@C.query("tiers_of_imports", f"""WITH RECURSIVE {PART_EDGES}, step AS (
  SELECT DISTINCT repo_id, src_file_id AS s, tgt_file_id AS t FROM edges),
reach AS (SELECT repo_id, s, t FROM step UNION SELECT r.repo_id, r.s, x.t FROM reach r JOIN step x ON x.repo_id = r.repo_id AND x.s = r.t),
looped AS (SELECT repo_id, s AS f FROM reach WHERE s = t),
stuck AS (SELECT repo_id, f FROM looped UNION SELECT r.repo_id, r.s FROM reach r JOIN looped l ON l.repo_id = r.repo_id AND l.f = r.t),
free AS (SELECT repo_id, file_id FROM files WHERE (repo_id, file_id) NOT IN (SELECT repo_id, f FROM stuck)),
walk AS (
  SELECT repo_id, file_id, 0 AS level FROM files WHERE (repo_id, file_id) NOT IN (SELECT repo_id, s FROM step)
  UNION
  SELECT x.repo_id, x.s, w.level + 1 FROM step x JOIN walk w ON w.repo_id = x.repo_id AND w.file_id = x.t
  JOIN free f ON f.repo_id = x.repo_id AND f.file_id = x.s),
levels AS (SELECT repo_id, file_id, max(level) AS level FROM walk GROUP BY 1, 2),
deepest AS (SELECT repo_id, max(level) AS deepest FROM levels GROUP BY 1)
SELECT repo_id, file_id, coalesce(level, deepest + 1, 0)::INT AS tier
FROM files LEFT JOIN levels USING (repo_id, file_id) LEFT JOIN deepest USING (repo_id)""")
def tiers_of_imports(spark, d):
    """Resolved imports are full of cycles: most files end in the last tier."""
    files, _, _, edges = _edges(spark, d)
    return order.topological_tiers(files, edges).select("repo_id", "file_id", "tier")


@C.query("ordered_nodes", f"""{_TIERS}
SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY tier, fan_in DESC, path) AS position, file_id AS id
FROM measured JOIN tiers USING (repo_id, file_id)""")
def ordered_nodes(spark, d):
    reading, files, _ = _reading(spark, d)
    return order.ordered_nodes(reading, files.selectExpr("repo_id", "path", "file_id AS id"))


@C.query("reading_batches", f"""{_TIERS}, numbered AS (
  SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY tier, fan_in DESC, path) AS position
  FROM measured JOIN tiers USING (repo_id, file_id))
SELECT repo_id, path, (position - 1) // 10 AS batch_id, ((position - 1) % 10 + 1)::INT AS batch_pos FROM numbered""")
def reading_batches(spark, d):
    files, edges = layered(spark, d)
    tiers = order.topological_tiers(e.fan_metrics(files, edges), edges)
    return with_batch(tiers.select("repo_id", "path", "tier", "fan_in"), ["repo_id"], ["tier", F.desc("fan_in"), "path"], 10).select(
        "repo_id", "path", "batch_id", "batch_pos"
    )


def _deepest_entries(files, edges, k):
    """The files nothing imports, by path."""
    from stratacode.operators.rules import rank_entry_points

    roots = e.fan_metrics(files, edges).where("fan_in = 0").select("repo_id", "path")
    return rank_entry_points(roots, k)


_FLOW = f"""WITH {LAYERED}, {DEGREES}, named AS (
  SELECT DISTINCT x.repo_id, s.path AS from_path, t.path AS to_path
  FROM edges x JOIN files s ON s.repo_id = x.repo_id AND s.file_id = src_file_id
               JOIN files t ON t.repo_id = x.repo_id AND t.file_id = tgt_file_id),
entry AS (SELECT repo_id, min(path) AS path FROM measured WHERE fan_in = 0 GROUP BY 1),
hop1 AS (SELECT n.*, 1 AS hop, '' AS parent FROM named n JOIN entry e ON e.repo_id = n.repo_id AND e.path = from_path),
hop2 AS (SELECT n.*, 2 AS hop, h.to_path AS parent FROM named n JOIN hop1 h ON h.repo_id = n.repo_id AND h.to_path = n.from_path),
walked AS (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY hop, parent, to_path)::INT AS step, from_path, to_path, hop FROM walked"""


@C.query("flow_from_first_entry", _FLOW)
def flow_from_first_entry(spark, d):
    files, edges = layered(spark, d)
    return flow.trace_data_flow(_deepest_entries(files, edges, 1), files, edges, max_entries=1)


# A file emits its edges when it is first expanded: as an entry, or as an import of an
# entry that was itself fresh.  The recursion carries the files expanded so far.
_FRESH = "list_filter(coalesce(o.targets, []), lambda x: NOT list_contains(s.expanded, x) AND x <> e.path)"


@C.query("data_flow", f"""WITH RECURSIVE {PART_MEASURED}, named AS (
  SELECT DISTINCT x.repo_id, s.path AS from_path, t.path AS to_path
  FROM edges x JOIN files s ON s.repo_id = x.repo_id AND s.file_id = src_file_id
               JOIN files t ON t.repo_id = x.repo_id AND t.file_id = tgt_file_id),
outgoing AS (SELECT repo_id, from_path, list(to_path ORDER BY to_path) AS targets FROM named GROUP BY 1, 2),
entry AS (
  SELECT repo_id, path, rk FROM (
    SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path)::INT AS rk FROM measured WHERE fan_in = 0) WHERE rk <= 5),
walk AS (
  SELECT DISTINCT repo_id, 0 AS rk, []::VARCHAR[] AS expanded, NULL::VARCHAR AS parent, []::VARCHAR[] AS children FROM entry
  UNION ALL
  SELECT s.repo_id, s.rk + 1,
         CASE WHEN list_contains(s.expanded, e.path) THEN s.expanded ELSE list_concat(list_append(s.expanded, e.path), {_FRESH}) END,
         CASE WHEN NOT list_contains(s.expanded, e.path) THEN e.path END,
         CASE WHEN list_contains(s.expanded, e.path) THEN [] ELSE {_FRESH} END
  FROM walk s JOIN entry e ON e.repo_id = s.repo_id AND e.rk = s.rk + 1
  LEFT JOIN outgoing o ON o.repo_id = e.repo_id AND o.from_path = e.path),
parents AS (
  SELECT repo_id, rk, 1 AS hop, '' AS place, parent FROM walk WHERE parent IS NOT NULL
  UNION ALL
  SELECT repo_id, rk, 2, child, child FROM (SELECT repo_id, rk, unnest(children) AS child FROM walk)),
steps AS (
  SELECT p.repo_id, from_path, to_path, hop,
         row_number() OVER (PARTITION BY p.repo_id ORDER BY rk, hop, place, to_path)::INT AS step
  FROM parents p JOIN named n ON n.repo_id = p.repo_id AND n.from_path = p.parent)
SELECT repo_id, step, from_path, to_path, hop FROM steps WHERE step <= 40""")
def data_flow(spark, d):
    """Five entries share what has been seen."""
    files, _, _, edges = _edges(spark, d)
    edges = cut_lineage(e.distinct_edges(edges))
    return flow.trace_data_flow(_deepest_entries(files, edges, flow.MAX_ENTRIES), files, edges)
