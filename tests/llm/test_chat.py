import itertools

from retrievium.llm import chat as H

CHATS = "conv_id long, turn long, role string, text string, x long"


def legal(roles):
    r = roles[1:] if roles[:1] == ("system",) else roles
    return len(r) % 2 == 0 and len(r) > 0 and all(x == ("user", "assistant")[i % 2] for i, x in enumerate(r))


def cheapest(roles):
    """Least cost over all merges, labels and insertions, by trying legal role sequences."""
    best = None
    n = len(roles)
    for size in range(2, 2 * n + 4):
        for start in ((), ("system",)):
            target = (*start, *(("user", "assistant")[i % 2] for i in range(size - len(start))))
            if not legal(target):
                continue
            # dp over (turns used, slots used)
            cost = {(0, 0): 0}
            for i, j in itertools.product(range(n + 1), range(size + 1)):
                if (i, j) not in cost:
                    continue
                c = cost[i, j]

                def put(k, v):
                    if k not in cost or v < cost[k]:
                        cost[k] = v

                if j < size:
                    put((i, j + 1), c + H.INSERT)
                    at = i
                    total = c
                    while at < n:
                        known = H.known_role(roles[at])
                        total += H.KEEP if known == target[j] else H.UNKNOWN if known is None else H.RELABEL
                        if at > i:
                            total += H.MERGE
                        at += 1
                        put((at, j + 1), total)
            if (n, size) in cost and (best is None or cost[n, size] < best):
                best = cost[n, size]
    return best


def test_cost_is_least():
    for n in (1, 2, 3, 4):
        for roles in itertools.product(["user", "assistant", "system", "nobody"], repeat=n):
            cost, turns = H.repair(list(roles))
            assert legal(tuple(r for r, _ in turns)), (roles, turns)
            assert [i for _, own in turns for i in own] == list(range(n))
            assert cost == cheapest(roles), roles


def test_odd_rows(spark):
    long = "z" * 200_000
    rows = [(1, 0, "user", "hi <|end|>", 1), (1, 1, "gpt", long, 1), (None, None, None, None, None), (2, 5, " USER ", "", 1), (2, 5, " USER ", "", 1), (3, 0, "assistant", "a", 1)]
    got = {r.conv_id: r for r in H.format_chats(spark.createDataFrame(rows, CHATS)).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1].cost == 0 and long in got[1].rendered and got[1].rendered.count("<|end|>") == 2
    assert got[2].n_turns == 2 and got[2].rendered.endswith("<|end|>\n")
    assert got[3].n_inserted + got[3].n_relabelled > 0
    assert H.format_chats(spark.createDataFrame([], CHATS)).count() == 0
