import json
import random

import pytest

from subweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, json string"


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def answer(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def corpus(seed=0, deep=0.0):
    """Conversations; with deep, answers that make calls too."""
    rng, rows = random.Random(seed), []
    for conv in range(12):
        ids = []
        for turn in range(rng.randint(1, 14)):
            kind = rng.random()
            own = [(f"c{rng.randint(0, 6)}", rng.choice(["search", "fetch", "nope"]), rng.choice([{"query": "q"}, {"url": "u"}, {"query": 3}, {}])) for _ in range(rng.randint(1, 3))]
            if kind < 0.3:
                ids += [i for i, *_ in own]
                rows.append((conv, turn, "assistant", call(*own)))
            elif kind < 0.6 or rng.random() < deep:
                body = json.loads(answer(rng.choice([*ids, "c1", "unknown"])))
                if rng.random() < deep:
                    body |= json.loads(call(*own))
                    ids += [i for i, *_ in own]
                rows.append((conv, turn, "tool", json.dumps(body)))
            else:
                rows.append((conv, turn, "user", rng.choice(["hi", 'quote " and \\', "{not json", "é\n漢"])))
    rng.shuffle(rows)
    return rows


def brute(rows):
    """Position and call turn of each message, from the top of each tree down."""
    out = []
    for conv in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[3], r[2]))
        bodies = [json.loads(r[3]) if r[3].startswith('{"') else {} for r in own]
        made = {}
        for i, body in enumerate(bodies):
            for place, c in enumerate(body.get("tool_calls", ())):
                made.setdefault(c["id"], (i, place))
        link = {i: made[b["tool_call_id"]] for i, b in enumerate(bodies) if own[i][2] == "tool" and b.get("tool_call_id") in made}
        tree = dict(link)
        for i in range(len(own)):
            way, at = [], i
            while at in tree and at not in way:
                way.append(at)
                at = tree[at][0]
            if at in way and i == min(way[way.index(at) :]):
                del tree[i]

        def below(i, tree=tree):
            yield i
            for j in sorted((j for j in tree if tree[j][0] == i), key=lambda j: (tree[j][1], j)):
                yield from below(j)

        order = [j for i in range(len(own)) if i not in tree for j in below(i)]
        assert sorted(order) == list(range(len(own)))
        out += [(conv, own[i][1], k, own[link[i][0]][1] if i in link else None) for k, i in enumerate(order)]
    return sorted(out, key=str)


def positions(spark, rows):
    got = chat.formatted(spark.createDataFrame([(*r, "?") for r in rows], SCHEMA))
    return sorted(((r["conv_id"], r["turn"], r["position"], r["call_turn"]) for r in got.collect()), key=str)


@pytest.mark.parametrize(("seed", "deep"), [(1, 0.0), (2, 0.6), (3, 0.9)])
def test_order_against_brute_force(spark, seed, deep):
    rows = corpus(seed, deep)
    assert positions(spark, rows) == brute(rows)


def test_chains_out_of_turn_and_circles(spark):
    both = lambda i, *own: json.dumps(json.loads(answer(i)) | json.loads(call(*own)))
    chain = [(1, 9, "assistant", call(("a", "now", {}))), (1, 2, "tool", both("a", ("b", "now", {}))), (1, 3, "tool", answer("b"))]
    circle = [(2, 5, "tool", both("x", ("y", "now", {}))), (2, 4, "tool", both("y", ("x", "now", {}))), (2, 1, "tool", both("z", ("z", "now", {}))), (2, 8, "tool", answer("y"))]
    long = [(3, 100 - k, "tool", both(f"c{k}", (f"c{k + 1}", "now", {}))) for k in range(40)] + [(3, 200, "assistant", call(("c0", "now", {})))]
    got = positions(spark, chain + circle + long)
    assert got == brute(chain + circle + long)
    assert [t for c, t, _, _ in sorted(got, key=lambda r: r[2]) if c == 1] == [9, 2, 3]
    assert [t for c, t, _, _ in sorted(got, key=lambda r: r[2]) if c == 2] == [1, 4, 5, 8]


def test_a_conversation_over_many_ranges(spark):
    rows = [(1, k, "user", "hello") for k in range(500)] + [(1, 3, "user", "same")] * 200 + [(k, 0, "user", "x") for k in range(2, 50)]
    assert positions(spark, rows) == brute(rows)


def test_validation_and_json(spark):
    good = ("a", "search", {"query": "q", "limit": 3})
    bad = [("b", "search", {"limit": 3}), ("c", "search", {"query": 1}), ("d", "search", {"query": "q", "extra": 1}), ("e", "nope", {}), ("a", "weather", {"place": "x", "days": 2, "metric": True})]
    rows = [(1, 0, "assistant", call(good, *bad, content="é"), "?"), (1, 1, "tool", answer("a", "done"), "?")]
    first, second = chat.formatted(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert (first["n_calls"], first["n_bad_calls"], first["n_repeated_ids"]) == (6, 4, 1)
    want = {"content": "é", "conv_id": 1, "role": "assistant", "tool_calls": [{"arguments": a, "id": i, "name": n} for i, n, a in (good, *bad)], "turn": 0}
    assert first["json"] == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert second["json"] == '{"content":"done","conv_id":1,"role":"tool","tool_call_id":"a","turn":1}'
    assert (second["linked"], second["call_turn"]) == (True, 0)


@pytest.mark.parametrize(
    ("tool", "arguments", "good"),
    [
        ("now", {}, True), ("now", "garbage", False), ("now", [1, 2], False), ("now", None, False), ("now", "{}", True),
        ("search", {"query": "q", "limit": 3.0}, True), ("search", {"query": "q", "limit": 3.5}, False), ("search", {"query": "q", "limit": None}, False),
        ("search", '{"query": "q"}', True), ("search", '{"query": 1}', False), ("search", {"limit": 1}, False),
        ("fetch", {"url": "u", "method": "GET"}, True), ("fetch", {"url": "u", "method": "PUT"}, False),
        ("fetch", {"url": "u", "headers": [{"name": "a", "value": "b"}]}, True), ("fetch", {"url": "u", "headers": [{"name": "a"}]}, False),
        ("fetch", {"url": "u", "headers": [{"name": "a", "value": "b", "x": 1}]}, False), ("fetch", {"url": "u", "headers": {}}, False), ("fetch", {"url": "u", "headers": []}, True),
        ("weather", {"place": "p", "days": "2", "metric": True}, False),
    ],
)
def test_schemas(spark, tool, arguments, good):
    (r,) = chat.formatted(spark.createDataFrame([(1, 0, "assistant", call(("a", tool, arguments)), "?")], SCHEMA)).collect()
    assert r["n_bad_calls"] == (0 if good else 1)


def test_awkward_rows(spark):
    rows = [(None, None, None, None, "?"), (None, 0, "user", "x", "?"), (1, None, "user", "late", "?"), (1, 0, "user", "", "?"), (1, 0, "user", "", "?"), (1, 1, "tool", answer("zz"), "?"), (1, 2, "user", "y" * 100_000, "?"), (1, 3, "assistant", '{"tool_calls": []}', "?"), (1, 4, "assistant", '{"tool_calls": [{}]}', "?")]
    got = chat.written(chat.formatted(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r["conv_id"] or 0, r["position"]) for r in got) == [(0, 0), (0, 1), *((1, i) for i in range(7))]
    assert all(r["text"].startswith("<|im_start|>") for r in got)
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = chat.formatted(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
