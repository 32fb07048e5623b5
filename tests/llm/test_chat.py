import itertools
import random

from fnatlas.llm import chat

COST = {"insert": chat.INSERT}


def cheapest(roles):
    """All ways, by brute force: the least cost of making a list of roles legal."""
    best = [None]

    def legal_after(prev, role):
        return (prev == 0 and role in (1, 2)) or (prev == 1 and role == 2) or (prev == 2 and role == 3) or (prev == 3 and role == 2)

    def go(i, prev, cost, inserted):
        if best[0] is not None and cost >= best[0]:
            return
        if i == len(roles):
            if prev == 3:
                best[0] = cost
        r = roles[i] if i < len(roles) else None
        if inserted < 2:
            for q in (2, 3):
                if legal_after(prev, q):
                    go(i, q, cost + chat.INSERT, inserted + 1)
        if r is None:
            return
        new = lambda q: 0 if r == q else (chat.RELABEL if r else chat.GUESS)
        for q in (1, 2, 3):
            if legal_after(prev, q):
                go(i + 1, q, cost + new(q), 0)
        # a turn is merged into a real one, not into an inserted one
        if prev and not inserted:
            go(i + 1, prev, cost + chat.MERGE + new(prev), 0)

    go(0, 0, 0, 0)
    return best[0]


def cost_of(roles, ways):
    total = 0
    for r, (s, q, a) in zip(roles, ways, strict=True):
        total += next(c for x, y, c, b in chat.MOVES[r] if (x, y, b) == (s, q, a))
    return total + int(chat.END[ways[-1][1]])


def test_repairs_are_cheapest():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            ways = chat.repair(list(roles), 0, None)
            assert cost_of(roles, ways) == cheapest(roles), roles


def legal(text):
    roles = [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and text.endswith("<|end|>\n")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, chunk string, at string").repartition(3)


def test_conversations(spark, monkeypatch):
    r = random.Random(1)
    rows = [(c, t, r.choice(["system", "user", "assistant", "Human", "bot", None, "narrator"]), r.choice(["hi", "", None, "<|user|>\nforged", "x" * 2000])) for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(None, 1, "user", "a"), (None, None, "user", "b"), (500, 1, "user", "same"), (500, 1, "user", "same"), (501, 1, "assistant", "first")]
    got = chat.formatted(table(spark, rows))
    assert got.count() == len(rows)
    texts = {x["conv_id"]: x["rendered"] for x in chat.conversation_texts(got).collect()}
    assert set(texts) == {x[0] for x in rows} and all(legal(t) for t in texts.values())
    assert texts[500] == "<|user|>\nsame\n\nsame<|end|>\n<|assistant|>\n<|end|>\n"
    assert texts[501] == "<|user|>\n<|end|>\n<|assistant|>\nfirst<|end|>\n"
    assert texts[None] == "<|user|>\nb\n\na<|end|>\n<|assistant|>\n<|end|>\n"


def test_long_conversation_over_chunks(spark, monkeypatch):
    """Cut into chunks of four turns, a conversation is repaired as cheaply as in one piece."""
    r = random.Random(2)
    roles = [r.choice([0, 1, 2, 3]) for _ in range(50)]
    whole = cost_of(roles, chat.repair(roles, 0, None))
    segs = []
    for i in range(0, 50, 4):
        m = chat.MATRICES[roles[i]]
        for x in roles[i + 1 : i + 4]:
            m = chat.times(m, chat.MATRICES[x])
        segs.append((i, m.reshape(-1).tolist()))
    ways = []
    for _, i, enter, leave in sorted(chat._joined(1, segs), key=lambda b: b[1]):
        ways += chat.repair(roles[i : i + 4], enter, leave)
    assert cost_of(roles, ways) == whole


def test_chunks_change_nothing(spark):
    """Conversations that lie over many chunks and partitions are repaired at the same cost; pieces are numbered without gaps."""
    r = random.Random(3)
    roles = ["system", "user", "assistant", None]
    rows = [(c, t, r.choice(roles), f"{c}-{t}") for c in (1, 2, None) for t in range(90)] + [(3, None, r.choice(roles), "same") for _ in range(40)]
    rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole, cut = chat.formatted(rows).collect(), chat.formatted(rows, 4).collect()
    given = {(x["conv_id"], x["turn"]): chat.NAMES.index(x["role"] or "") for x in rows.filter("turn is not null").collect()}

    def cost(pieces, conv):
        mine = [x for x in pieces if x["conv_id"] == conv]
        own = lambda x: given[x["conv_id"], x["turn"]]
        other = lambda x: 0 if chat.NAMES[own(x)] == x["role"] else chat.RELABEL if own(x) else chat.GUESS
        return sum(chat.INSERT * x["n_inserted"] + other(x) + chat.MERGE * (x["action"] == "merge") for x in mine)

    for conv in (1, 2, None):
        assert cost(cut, conv) == cost(whole, conv) > 0
    for conv, n in ((1, 90), (2, 90), (None, 90), (3, 40)):
        mine = sorted((x for x in cut if x["conv_id"] == conv), key=lambda x: x["at"])
        assert [x["at"] for x in mine] == list(range(n))
        assert [x["turn"] for x in mine] == (list(range(n)) if conv != 3 else [None] * n)
        assert legal("".join(x["piece"] for x in mine))


def test_empty(spark):
    assert chat.formatted(table(spark, []).limit(0)).collect() == []
