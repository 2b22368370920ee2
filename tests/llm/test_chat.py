from sparkbars.llm import chat

from .conftest import by_id

KIND = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    said = {}
    for c, t, r, x in rows:
        said.setdefault(c, []).append((t, r or "unknown", x or ""))
    said = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0))] for c, v in said.items()}
    classes = {}
    for c, v in said.items():
        classes.setdefault(tuple(v), []).append(c)
    out = {}
    for v, cs in classes.items():
        if not any(len(o) > len(v) and o[:len(v)] == v for o in classes):
            low = min(cs, key=lambda c: (c is not None, c or 0)) if None not in cs else min(c for c in cs if c is not None) if len(cs) > 1 else None
            out[low] = (len(v), len(cs), "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in v))
    return out


def test_snapshots_collapse(spark):
    rows = []
    for c, n in ((1, 3), (2, 1), (3, 5), (4, 5), (9, 2)):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(n)]
    rows += [(5, 0, "user", "turn 0"), (5, 1, "assistant", "other"), (6, 0, None, None), (7, 0, "user", "turn 0\x1f"), (8, None, "user", "n"), (8, 0, "user", "m"),
             (None, 0, "user", "null id"), (10, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS rank", "2 AS n_turns", "3 AS rendered", "4 AS keep_id")
    got = {r.conv_id: (r.n_turns, r.n_snapshots, r.rendered) for r in chat.format_chats(df).collect()}
    assert got == brute(rows)
    assert set(got) == {3, 5, 6, 7, 8, None, 10} and got[3][1] == 2


def test_repeated_turns_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    got = by_id(chat.format_chats(spark.createDataFrame(rows, KIND)), "conv_id")
    assert set(got) == {1} and got[1].n_turns == 2
    assert chat.format_chats(spark.createDataFrame([], KIND)).count() == 0


def test_native_plan(spark):
    plan = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a")], KIND))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
