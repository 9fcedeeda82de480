"""Pose graphs as tables against the dense solution and against the solver in memory."""

import numpy as np

from sweepmill.operators import graphs, substructure


def chain(n, seed, loops=()):
    """A drifting walk of n poses: (true-ish start poses, a, b, measured edges, loop)."""
    rng = np.random.default_rng(seed)
    steps = graphs.moved(np.tile(np.eye(4), (n, 1, 1)), np.concatenate([rng.normal(0, 0.05, (n, 3)), rng.normal(0, 0.3, (n, 3)) + (0.5, 0, 0)], axis=1))
    true = [np.eye(4)]
    for s in steps[1:]:
        true.append(true[-1] @ s)
    true = np.array(true)
    noise = graphs.moved(np.tile(np.eye(4), (n, 1, 1)), rng.normal(0, 0.004, (n, 6)))
    poses = [np.eye(4)]
    for i in range(1, n):
        poses.append(poses[-1] @ np.linalg.inv(true[i - 1]) @ true[i] @ noise[i])
    poses = np.array(poses)
    a, b = [*range(n - 1), *[x for x, _ in loops]], [*range(1, n), *[y for _, y in loops]]
    z = [*(np.linalg.inv(poses[1:]) @ poses[:-1]), *[np.linalg.inv(true[y]) @ true[x] for x, y in loops]]
    return poses, np.array(a), np.array(b), np.array(z).reshape(-1, 4, 4), np.array([False] * (n - 1) + [True] * len(loops))


def frames_of(spark, some):
    nodes = [(c, i, *map(float, p)) for c, g in some.items() for i, p in enumerate(graphs.poses7(g[0]))]
    links = [(c, int(a), int(b), *map(float, z), bool(k)) for c, g in some.items() for a, b, z, k in zip(g[1], g[2], graphs.poses7(g[3]), g[4], strict=True)]
    seven = ", ".join(f"{p} double" for p in graphs.POSE)
    return spark.createDataFrame(nodes, f"capture string, node long, {seven}"), spark.createDataFrame(links, f"capture string, a long, b long, {seven}, loop boolean")


def test_tables_against_the_solver_in_memory(spark):
    some = {"a": chain(40, 1, [(0, 39), (5, 30)]), "b": chain(9, 2, [(8, 1)]), "c": chain(6, 3), "d": chain(1, 4), "e": chain(25, 5, [(3, 20), (2, 24), (2, 24)])}
    frames, edges = frames_of(spark, some)
    for segment, rounds in ((64, 15), (8, 2)):
        got = substructure.solve_graphs(frames, edges, "capture", rounds, segment=segment).collect()
        assert len(got) == sum(len(g[0]) for g in some.values())
        for c, g in some.items():
            want, before, after = graphs.solve_many(g[0], [len(g[0])], *g[1:], rounds=rounds) if len(g[1]) else (g[0], [0.0], [0.0])
            mine = sorted((r for r in got if r["capture"] == c), key=lambda r: r["node"])
            assert np.isclose(mine[0]["cost0"], before[0], rtol=1e-9, atol=1e-12) and np.isclose(mine[0]["cost1"], after[0], rtol=1e-6, atol=1e-9)
            poses = graphs.matrices(np.array([[r[p] for p in graphs.POSE] for r in mine]))
            assert np.abs(poses - want).max() < 1e-4


def test_elements_against_a_dense_solution(spark):
    rng = np.random.default_rng(6)
    n, rows, whole, right = 60, [], np.zeros((360, 360)), np.zeros(360)
    pairs = [(i, i + 1) for i in range(n - 1)] + [(3, 50), (10, 11), (20, 59), (0, 30)] + [(7,)]
    for p in pairs:
        j, f = rng.normal(size=(6, 6 * len(p))), rng.normal(size=6 * len(p))
        at = np.concatenate([np.arange(6) + 6 * x for x in p])
        k = j.T @ j + np.eye(len(f))
        whole[np.ix_(at, at)] += k
        right[at] += f
        rows.append(("a", [x + 1 for x in p], k.ravel().tolist(), f.tolist()))
    df = spark.createDataFrame(rows, "capture string, nodes array<long>, k array<double>, f array<double>")
    want = np.linalg.solve(whole + 1e-4 * np.eye(360), right).reshape(n, 6)
    for segment in (2, 8, 100):
        got = {r["node"]: r["x"] for r in substructure.solve_elements(df, segment=segment).collect()}
        assert sorted(got) == list(range(1, n + 1)) and np.allclose([got[i + 1] for i in range(n)], want, atol=1e-8)
    assert substructure.solve_elements(df.limit(0)).collect() == []


def test_long_chain_is_solved_in_several_tasks(spark):
    """A chain of 20 000 nodes against elimination from one end to the other."""
    n, rng = 20_000, np.random.default_rng(8)
    j = rng.normal(size=(n - 1, 6, 12)) + np.concatenate([np.eye(6), -np.eye(6)], axis=1)
    f = rng.normal(size=(n - 1, 12))
    k = np.einsum("eij,eik->ejk", j, j)
    rows = [("long", [i + 1, i + 2], k[i].ravel().tolist(), f[i].tolist()) for i in range(n - 1)]
    df = spark.createDataFrame(rows, "capture string, nodes array<long>, k array<double>, f array<double>")
    diagonal, right = np.tile(1e-4 * np.eye(6), (n, 1, 1)), np.zeros((n, 6))
    for end in (0, 1):
        diagonal[end : n - 1 + end] += k[:, 6 * end : 6 * end + 6, 6 * end : 6 * end + 6]
        right[end : n - 1 + end] += f[:, 6 * end : 6 * end + 6]
    for i in range(1, n):
        carry = k[i - 1, 6:, :6] @ np.linalg.inv(diagonal[i - 1])
        diagonal[i] -= carry @ k[i - 1, :6, 6:]
        right[i] -= carry @ right[i - 1]
    x = np.zeros((n, 6))
    for i in range(n - 1, -1, -1):
        x[i] = np.linalg.solve(diagonal[i], right[i] - (k[i, :6, 6:] @ x[i + 1] if i < n - 1 else 0))
    got = substructure.solve_elements(df).toPandas().sort_values("node")
    assert got["node"].tolist() == list(range(1, n + 1)) and np.allclose(np.stack(got["x"].tolist()), x, rtol=1e-5, atol=1e-5)
    assert (n - 1) // substructure.TOGETHER >= 4  # calls, each some of the 313 segments


def test_no_table_of_nodes_is_gathered_in_the_driver(spark, monkeypatch):
    some = {"a": chain(40, 1, [(0, 39), (5, 30)]), "b": chain(9, 2, [(8, 1)]), "c": chain(6, 3)}
    plans, kept = [], substructure.stash

    def stash(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, label)

    monkeypatch.setattr(substructure, "stash", stash)
    for few in (substructure.FEW, 0):
        plans.clear()
        monkeypatch.setattr(substructure, "FEW", few)
        out = substructure.solve_graphs(*frames_of(spark, some), "capture", 2, segment=8)
        plans.append(("solved", out._jdf.queryExecution().executedPlan().toString()))
        assert out.count() == 55
        for label, plan in plans:
            # Those of captures have one key.
            wide = [x for x in plan.splitlines() if "BroadcastExchange" in x and ("node" in x or x.count("input[") != 1)]
            assert not wide and (few or "Broadcast" not in plan), (label, plan)
