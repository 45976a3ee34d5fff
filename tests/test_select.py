import itertools
import random

from chunkweave.operators import graph, placement
from chunkweave.operators import select as S

DEMO = {1: "ABC", 2: "ABCF", 3: "AF", 4: "BCG", 5: "HGI"}
PRIZE = {1: 2, 2: 1, 3: 1, 4: 4, 5: 5}


def test_smallest_pairs_evict_the_first_of_the_largest():
    assert graph.smallest_pairs([(0, 1, 0.5), (0, 2, 0.5), (1, 2, 0.3)], 2) == [(0, 2, 0.5), (1, 2, 0.3)]


def test_merged_groups_may_overlap():
    assert graph.merged_groups([(0, 1), (2, 3), (1, 4), (4, 2)]) == [[0, 1, 4, 2], [2, 3]]


def demo():
    vertices = {f: (len(c), PRIZE[f]) for f, c in DEMO.items()}
    edges = [(u, v, -len(set(DEMO[u]) & set(DEMO[v]))) for u, v in itertools.combinations(DEMO, 2) if set(DEMO[u]) & set(DEMO[v])]
    return vertices, edges


def test_demo_instance():
    vertices, edges = demo()
    want = {3: (3, 5, [5]), 4: (4, 6, [1, 4]), 5: (5, 9, [4, 5]), 6: (6, 11, [1, 4, 5]), 7: (7, 13, [1, 2, 3, 4, 5])}
    for budget, expected in want.items():
        assert S.dstp(vertices, edges, budget) == expected
        cost, prize, picked = S.bisected(lambda q: S.grown_quota(vertices, edges, q), sum(PRIZE.values()), budget)
        assert cost <= budget and prize <= expected[1] and sum(PRIZE[f] for f in picked) == prize


def random_files(seed):
    rng = random.Random(seed)
    sizes = {c: rng.randint(1, 9) for c in range(1, 15)}
    return {f: [(c, sizes[c]) for c in rng.choices(list(sizes), k=rng.randint(1, 5))] for f in range(1, 9)}, sizes


def test_selections_stay_within_capacity():
    for seed in range(20):
        files, sizes = random_files(seed)
        total, heat = sum({c: s for cs in files.values() for c, s in cs}.values()), {f: 1.0 / f for f in files}
        for ratio in (0.2, 0.5, 1.0):
            cap = total * ratio
            picked, stored = S.density_select(files, heat, cap)
            assert sum(sizes[c] for c in stored) <= cap and stored == {c for f in picked for c, _ in files[f]}
            for fold in (lambda s: S.popularity(files, heat, cap, s), lambda s: S.completion_greedy(files, heat, cap, s)):
                servers = S.Servers(3, cap / 3)
                chosen = fold(servers)
                assert all(u <= cap / 3 for u in servers.used) and sum(servers.used) <= cap
                assert all(c in servers.of for f in chosen for c, _ in files[f])
            got = S.budget_fill(files, dict.fromkeys(files, 3), int(cap))
            assert sum(sizes[c] for c in {c for f in got for c, _ in files[f]}) <= cap


def test_fill_never_goes_back():
    s = S.Servers(2, 10)
    s.fill([(1, 6), (2, 6), (3, 4), (4, 6), (5, 1)])
    assert s.of == {1: 1, 2: 2, 3: 2}


def test_spread_drops_a_group_or_a_chunk():
    s = S.Servers(2, 5)
    assert s.spread([(1, 4), (2, 4), (3, 4)], True) is None
    assert s.spread([(1, 4), (2, 4), (3, 4)], False) is not None


def test_every_method_runs():
    import pandas as pd

    files, sizes = random_files(3)
    info = pd.DataFrame({"file_id": list(files), "heat": [1.0 / f for f in files], "raw_size": [sum(s for _, s in c) for c in files.values()]})
    for column in ("gain", "gain_parallel", "gain_filled", "boosted"):
        info[column] = info["heat"]
    for name in placement.METHODS:
        picked, placed = placement.run_cell(files, info, name, 0.5, 3, k=2)
        assert set(picked) <= set(files) and set(placed.values()) <= {1, 2, 3} and set(placed) <= set(sizes)
    assert placement.method("LADedup-two") == "ladedup_two"


def test_balanced_takes_the_emptiest_server_that_has_room():
    rng = random.Random(3)
    for _ in range(200):
        s = S.Servers(4, [rng.randint(5, 30) for _ in range(4)])
        s.used, s.count = [rng.randint(0, 9) for _ in range(4)], [rng.randint(0, 3) for _ in range(4)]
        used, count, want = list(s.used), list(s.count), []
        chunks = [(c, rng.randint(1, 9)) for c in range(rng.randint(1, 8))]
        for c, size in chunks:
            room = [(used[i], count[i], i) for i in range(4) if used[i] + size <= s.limit[i]]
            if not room:
                want = None
                break
            i = min(room)[2]
            used[i] += size
            count[i] += 1
            want.append((c, size, i))
        assert s.balanced(chunks) == want


def plain_communities(groups, files, benefit, capacity, servers):
    """Every step over all communities."""
    stored, out = set(), []
    size = {c: n for cs in files.values() for c, n in cs}
    while True:
        found = []
        for i, g in enumerate(groups):
            need = list(dict.fromkeys(c for f in g for c, _ in files[f] if c not in stored))
            gain = sum(benefit[f] for f in g if any(c not in stored for c, _ in files[f]))
            d = sum(size[c] for c in need)
            if i not in out and gain > 0 and sum(size[c] for c in stored) + d <= capacity and (plan := servers.balanced([(c, size[c]) for c in need])) is not None:
                found.append((-gain / d, i, plan))
        if not found:
            return out, {f for f, cs in files.items() if all(c in stored for c, _ in cs)}
        _, i, plan = min(found, key=lambda x: x[:2])
        servers.commit(plan)
        stored |= {c for c, _, _ in plan}
        out.append(i)


def test_files_are_grouped_in_one_pass():
    of = {f: f % 7 for f in (5, 3, 20, 14, 7, 0, 6)}
    assert S.grouped(of) == ([0, 3, 5, 6], [[0, 7, 14], [3], [5], [6, 20]]) and S.grouped({}) == ([], [])

    class Counted(dict):
        reads = 0

        def __getitem__(self, key):
            Counted.reads += 1
            return dict.__getitem__(self, key)

    S.grouped(Counted((f, f) for f in range(1000)))
    assert Counted.reads <= 2000


def test_communities_that_do_not_fit_wait_for_a_change(monkeypatch):
    n, pops = 400, []
    pop = S.heapq.heappop
    monkeypatch.setattr(S.heapq, "heappop", lambda q: pops.append(1) or pop(q))
    files = {f: [(f, 50 * n)] for f in range(n)} | {n + f: [(n + f, 1)] for f in range(n)}
    benefit = {f: 100 * n if f < n else 1 for f in files}  # the large ones come first, and none fits
    picked, whole = S.community_greedy([[f] for f in files], files, benefit, 30 * n, S.Servers(1, 30 * n))
    assert picked == list(range(n, 2 * n)) and whole == set(picked)
    assert len(pops) <= 3 * len(files)


def test_community_greedy_is_the_plain_one():
    for seed in range(60):
        files, sizes = random_files(seed)
        rng = random.Random(seed)
        benefit = {f: rng.randint(0, 9) for f in files}
        groups = [[f for f in files if f % 3 == k] for k in range(3)] + [[f] for f in files if f > 5]
        cap = sum({c: s for cs in files.values() for c, s in cs}.values()) * rng.choice([0.3, 0.6, 1.2])
        assert S.community_greedy(groups, files, benefit, cap, S.Servers(3, cap / 3)) == plain_communities(groups, files, benefit, cap, S.Servers(3, cap / 3))


def test_grown_quota_within_the_budget_and_connected():
    rng = random.Random(9)
    vertices = {v: (rng.randint(3, 9), rng.randint(1, 9)) for v in range(1, 41)}
    edges = [(v, v + 1, -1) for v in range(1, 40)]
    for budget in (10, 40, 90):
        cost, prize, picked = S.dstp(vertices, edges, budget)
        assert cost <= budget and prize == sum(vertices[v][1] for v in picked)
        assert picked == list(range(picked[0], picked[0] + len(picked))) if picked else True


def test_cell_keys_change_with_settings_and_inputs():
    one = placement.cell_key({"method": "mean", "ratio": 0.1}, {"edges": "a"})
    assert one == placement.cell_key({"ratio": 0.1, "method": "mean"}, {"edges": "a"})
    assert len({one, placement.cell_key({"method": "mean", "ratio": 0.2}, {"edges": "a"}), placement.cell_key({"method": "mean", "ratio": 0.1}, {"edges": "b"})}) == 3


def test_closest_pairs_is_the_scan(spark):
    rng = random.Random(4)
    for k in (1, 3, 7, 40):
        pairs = [(u, v, rng.choice([0.1, 0.2, 0.3, 0.4])) for u, v in itertools.combinations(range(9), 2)]
        got = graph.closest_pairs(spark.createDataFrame(pairs, "u long, v long, distance double"), k).collect()
        assert sorted(tuple(r) for r in got) == sorted(graph.smallest_pairs(pairs, k))
