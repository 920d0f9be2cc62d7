from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from stratacode.operators import edges as e
from stratacode.operators import flow, graph, order
from stratacode.operators.common import number_rows, top_k

FILES = "repo_id string, file_id string, path string"
SYMBOLS = "repo_id string, file_id string, symbol_id string, kind string, name string, ordinal int"
EDGES = "repo_id string, src_file_id string, tgt_file_id string, dep_type string"


def _best_target(files, importer, wanted):
    """The file an import names, as the best-ranked of all candidates.

    A candidate answers to its path without suffix or to the last part of that.  The whole import path ranks before its last part; for
    one key the last full path ranks before the first bare name.  The importing file is no candidate, but it hides others of its key.
    """
    ranked = []
    for level, key in enumerate((wanted, wanted[wanted.rfind("/") + 1 :])):
        holders = []
        for place, (path, fid) in enumerate(files):
            stem = path[: path.rindex(".")]
            if stem == key:
                holders.append(((0, -place), fid))
            elif "/" not in key and stem.endswith("/" + key):
                holders.append(((1, place), fid))
        if holders:
            ranked.append((level, min(holders)[1]))
    return next((fid for _, fid in sorted(ranked) if fid != importer), None)


def _resolve_plain(files, symbols):
    by_path = sorted((path, fid) for _, fid, path in files)
    declared = {fid: min((s[5], s[2]) for s in symbols if s[1] == fid and s[3] in ("function", "class", "method"))[1]
                for fid in {s[1] for s in symbols if s[3] in ("function", "class", "method")}}
    pairs = []
    for _, importer, sid, kind, name, _ in symbols:
        wanted = re.sub(r" as .*", "", re.sub(r"^[./]+", "", name.replace(".", "/"))).strip()
        if kind == "import" and wanted:
            target = _best_target(by_path, importer, wanted)
            pairs += [(sid, declared[target])] if target in declared else []
    return sorted(pairs)


def test_resolution_matches_plain_model(spark):
    rng = random.Random(3)
    dirs, names = ["", "a/", "a/b/", "c/"], ["x", "y", "z", "x.y"]
    paths = sorted({rng.choice(dirs) + rng.choice(names) + rng.choice([".py", ".ts"]) for _ in range(25)})
    files = [("r", f"f{i}", p) for i, p in enumerate(paths)]
    symbols = []
    for i, (_, fid, _) in enumerate(files):
        for k in range(rng.randrange(5)):
            kind = rng.choice(["import", "import", "function", "variable", "method"])
            name = rng.choice(["x", "a.x", ".a.b.y", "c.z as q", "nope", "a.b.x.y", "b.z", "y"])
            symbols.append(("r", fid, f"s{i}_{k}", kind, name, rng.randrange(4)))
    got = e.resolve_dependencies(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS))
    assert sorted((r.source_symbol_id, r.target_symbol_id) for r in got.collect()) == _resolve_plain(files, symbols)


def test_full_stem_beats_alias_and_self_falls_through(spark):
    files = [("r", "f1", "a/util.py"), ("r", "f2", "util.py"), ("r", "f3", "z/util.py"), ("r", "f4", "b/only.py")]
    symbols = [
        ("r", "f1", "c1", "class", "K", 0), ("r", "f2", "c2", "class", "K", 0), ("r", "f3", "c3", "class", "K", 0),
        ("r", "f1", "i1", "import", "util", 1),        # the root file, not the first alias
        ("r", "f2", "i2", "import", "util", 1),        # itself, and no other candidate
        ("r", "f2", "i3", "import", "a.util", 1),
        ("r", "f1", "i4", "import", "b.only", 1),      # matched file owns no target
        ("r", "f3", "i5", "import", "z.util", 1),      # itself first, then by last segment
    ]
    got = e.resolve_dependencies(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS))
    assert sorted((r.source_symbol_id, r.target_symbol_id) for r in got.collect()) == [("i1", "c2"), ("i3", "c1"), ("i5", "c2")]


def test_fan_metrics_sum_up(spark):
    edges = spark.createDataFrame([("r", "a", "b", "imports")] * 3 + [("r", "b", "c", "imports")], EDGES)
    files = spark.createDataFrame([("r", f, f) for f in "abcd"], FILES)
    got = {r.file_id: (r.fan_in, r.fan_out) for r in e.fan_metrics(files, edges).collect()}
    assert got == {"a": (0, 3), "b": (3, 1), "c": (1, 0), "d": (0, 0)}


def test_weighted_link_ties_by_type(spark, rows):
    edges = spark.createDataFrame([("r", "a", "b", "calls"), ("r", "a", "b", "imports")], EDGES)
    assert rows(graph.weighted_links(edges), "source", "target", "type", "weight") == [("a", "b", "calls", 2)]


def test_symbol_links_remap_imports_and_drop_methods(spark, rows):
    symbols = spark.createDataFrame(
        [("r", "f1", "i1", "import", "x", 0), ("r", "f1", "c1", "class", "K", 2), ("r", "f1", "g1", "function", "g", 1),
         ("r", "f2", "m2", "method", "m", 0), ("r", "f2", "g2", "function", "h", 1), ("r", "f3", "i3", "import", "y", 0)], SYMBOLS)
    deps = spark.createDataFrame(
        [("r", "i1", "g2", "imports"), ("r", "i1", "m2", "imports"), ("r", "i3", "g2", "imports"), ("r", "g1", "g2", "calls"),
         ("r", "i1", "g1", "imports")],
        "repo_id string, source_symbol_id string, target_symbol_id string, dep_type string")
    # i1 stands for g1 (first node of f1); i3 has no node in its file; m2 is no node.
    assert rows(graph.symbol_links(symbols, deps), "source", "target", "type", "weight") == [("g1", "g2", "calls", 1)]


def test_path_tree_prefixes(spark, rows):
    files = spark.createDataFrame([("r", "/a/b/c.py", 5), ("r", "a/d.py", None), ("r", "e.py", 2)], "repo_id string, path string, loc int")
    assert rows(graph.path_tree(files), "path", "type", "files", "loc", "parent") == [
        ("a", "directory", 2, 5, ""), ("a/b", "directory", 1, 5, "a"), ("a/b/c.py", "file", 1, 5, "a/b"),
        ("a/d.py", "file", 1, 0, "a"), ("e.py", "file", 1, 2, ""),
    ]
    assert [r.path for r in graph.tree_order(graph.path_tree(files)).where("parent = ''").collect()] == ["a", "e.py"]


def _kahn(nodes, edges):
    deps = {n: {t for s, t in edges if s == n and t != n} for n in nodes}
    tier, level = {}, 0
    while True:
        ready = [n for n in nodes if n not in tier and not (deps[n] - set(tier))]
        if not ready:
            break
        tier.update({n: level for n in ready})
        level += 1
    tier.update({n: level for n in nodes if n not in tier})
    return tier


def _random_graph(rng, n, m):
    nodes = [f"n{i}" for i in range(n)]
    return nodes, sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)})


def test_tiers_match_plain_kahn_with_cycles(spark):
    rng = random.Random(9)
    files, edges, expected = [], [], {}
    for r in range(6):
        nodes, pairs = _random_graph(rng, 12, 5 + 3 * r)
        files += [(f"r{r}", n, n) for n in nodes]
        edges += [(f"r{r}", s, t, "imports") for s, t in pairs if s != t]
        expected.update({(f"r{r}", n): t for n, t in _kahn(nodes, pairs).items()})
    got = order.topological_tiers(spark.createDataFrame(files, FILES), spark.createDataFrame(edges, EDGES)).collect()
    assert {(r.repo_id, r.file_id): r.tier for r in got} == expected


def test_tiers_without_edges(spark):
    files = spark.createDataFrame([("r", "a", "a"), ("r", "b", "b")], FILES)
    got = order.topological_tiers(files, spark.createDataFrame([], EDGES)).collect()
    assert {r.tier for r in got} == {0}


def test_reading_order_positions(spark):
    files = spark.createDataFrame(
        [("r", "a", "a", 0, 1, "py"), ("r", "b", "b", 2, 0, "py"), ("r", "c", "c", 2, 0, None), ("r", "d", "d", 1, 1, "py"), ("r", "e", "e", 1, 1, "py")],
        FILES + ", fan_in int, fan_out int, language string")
    edges = spark.createDataFrame([("r", "a", "b", "imports"), ("r", "d", "e", "imports"), ("r", "e", "d", "imports")], EDGES)
    got = order.reading_order(files, edges).orderBy("position").collect()
    assert [(r.path, r.tier, r.position) for r in got] == [("b", 0, 1), ("c", 0, 2), ("a", 1, 3), ("d", 2, 4), ("e", 2, 5)]
    levels = order.peel(edges)
    assert {r.file_id for r in order.cycle_remainder(files, levels).collect()} == {"d", "e"}


def _trace(entries, deps, hops=2, cap=40):
    """The edges of a trace by their defining order instead of a walk.

    Every path of at most ``hops`` imports from an entry is listed.  A file expands where it is first reached, over the entries in turn and within one
    entry by hops; its edges follow in the order of their targets.
    """
    expands, order = {}, []
    for e, entry in enumerate(entries):
        paths = [(entry,)]
        for hop in range(1, hops + 1):
            for place, path in enumerate(paths):
                expands.setdefault(path[-1], (e, hop, place))
            paths = [p + (t,) for place, p in enumerate(paths) if expands[p[-1]] == (e, hop, place) for t in deps.get(p[-1], [])]
            order += [((e, hop, i), p[-2], p[-1], hop) for i, p in enumerate(paths)]
    return [x[1:] for x in sorted(order)][:cap]


def test_trace_matches_plain_walk(spark):
    rng = random.Random(21)
    files, edges, entries, expected = [], [], [], {}
    for r in range(12):
        nodes, pairs = _random_graph(rng, 14, 10 + 12 * r)
        repo = f"r{r}"
        files += [(repo, n, n) for n in nodes]
        edges += [(repo, s, t, "imports") for s, t in pairs if s != t for _ in range(2)]
        deps = {n: sorted(t for s, t in pairs if s == n and t != n) for n in nodes}
        chosen = rng.sample(nodes, 5)
        entries += [(repo, p, i + 1) for i, p in enumerate(chosen)]
        expected[repo] = _trace(chosen, deps)
    got = {repo: [] for repo in expected}
    for hops, cap in ((2, 40), (3, 15)):
        for repo in expected:
            chosen = [p for rr, p, _ in sorted(entries, key=lambda x: x[2]) if rr == repo]
            deps = {}
            for rr, s, t, _ in sorted(edges):
                if rr == repo and t not in deps.setdefault(s, []):
                    deps[s].append(t)
            expected[repo] = _trace(chosen, deps, hops, cap)
        got = {repo: [] for repo in expected}
        result = flow.trace_data_flow(
            spark.createDataFrame(entries, "repo_id string, path string, entry_rank int"),
            spark.createDataFrame(files, FILES), spark.createDataFrame(edges, EDGES), hops, cap)
        for row in result.orderBy("repo_id", "step").collect():
            got[row.repo_id].append((row.from_path, row.to_path, row.hop))
        assert got == expected


def test_number_rows_splits_a_hot_key(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'other', 'hot') AS repo_id", "id * 7919 % 5000 AS v")
    numbered = number_rows(df, ["repo_id"], ["v"]).cache()
    for key in ("hot", "other"):
        rows = [r for r in numbered.where(F.col("repo_id") == key).orderBy("v").collect()]
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))


def test_number_rows_of_nulls_small_keys_and_batches(spark):
    made = [(k, i) for i, k in enumerate(["a", None, "b", "a", None, "c"] * 700)]
    df = spark.createDataFrame(made, "repo_id string, v int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {(r.repo_id, r.v): r.position for r in number_rows(df, ["repo_id"], [F.desc("v")]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for key in ("a", "b", "c", None):
        for at, v in enumerate(sorted((v for k, v in made if k == key), reverse=True)):
            want[key, v] = at + 1
    assert got == want and number_rows(df.limit(0), ["repo_id"], ["v"]).count() == 0


def test_number_rows_moves_rows_once(spark):
    df = spark.range(100).selectExpr("id % 3 AS repo_id", "id AS v")
    numbered = number_rows(df, ["repo_id"], ["v"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "BroadcastHashJoin" in plan
    # Exchanges are left only on the side of the table of slices.
    assert all("_place" not in line or "functions" in line or "keys=" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS repo_id", "id AS v")
    plan = top_k(df, ["repo_id"], ["v"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_edges_of_the_resolver_equal_those_of_the_stored_dependencies(spark, rows):
    rng = random.Random(12)
    files = spark.createDataFrame([("r", f"f{i}", f"d{i % 3}/m{i}.py") for i in range(12)], FILES)
    made = [("r", f"f{rng.randrange(12)}", f"s{i}", rng.choice(["import", "function"]), f"m{rng.randrange(14)}", i) for i in range(200)]
    symbols = spark.createDataFrame(made, SYMBOLS)
    direct = e.import_edges(e.resolve_imports(files, symbols))
    stored = e.file_edges(e.resolve_dependencies(files, symbols), symbols)
    assert rows(direct) == rows(stored) and direct.count() > 20
    assert direct._jdf.queryExecution().executedPlan().toString().count("Join ") < stored._jdf.queryExecution().executedPlan().toString().count("Join ")


def test_edge_plans_do_not_read_source_text(spark, tmp_path):
    path = str(tmp_path / "symbols")
    spark.createDataFrame([("r", "f", "s", "import", "x", 0, "text")], SYMBOLS + ", source_code string").write.parquet(path)
    symbols = spark.read.parquet(path)
    files = spark.createDataFrame([("r", "f", "p.py")], FILES)
    plan = e.file_edges(e.resolve_dependencies(files, symbols), symbols)._jdf.queryExecution().executedPlan().toString()
    assert "source_code" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_file_dep_map_lists_every_import(spark):
    from catalog.graphs import C

    edges = spark.range(1200).selectExpr("'r' AS repo_id", "'a' AS src_file_id", "concat('t', id) AS tgt_file_id", "'imports' AS dep_type")
    files = spark.range(1200).selectExpr("'r' AS repo_id", "concat('t', id) AS file_id", "concat('p', lpad(id, 4, '0')) AS path")
    whole = e.file_dep_map(edges.unionAll(edges), files).first()
    assert whole.n_targets == 1200 and whole.targets == [f"p{i:04d}" for i in range(1200)]
    cut = e.file_dep_map(edges, files, 5).first()
    assert cut.n_targets == 1200 and cut.targets == whole.targets[:5]
    assert "nth" not in C.oracle["file_dependency_map"]


def test_tiers_broadcast_no_files(spark, monkeypatch):
    plans, whole = [], order.stage

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, name)

    monkeypatch.setattr(order, "stage", seen)
    files = spark.range(9).selectExpr("'r' AS repo_id", "concat('f', id) AS file_id", "concat('p', id) AS path")
    chain = spark.range(8).selectExpr("'r' AS repo_id", "concat('f', id + 1) AS src_file_id", "concat('f', id) AS tgt_file_id", "'imports' AS dep_type")
    got = {r.file_id: r.tier for r in order.topological_tiers(files, chain).collect()}
    assert got == {f"f{i}": i for i in range(9)}
    assert len(plans) == 9 and not any("Broadcast" in plan for plan in plans[1:])
