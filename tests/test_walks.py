import json
import random

from epistride.sources import walks


def brute(rows, terms, most, elements, distinct):
    """Texts in order, keys by recursion."""
    found = {}

    def scan(value, path, place):
        children = list(value.items()) if isinstance(value, dict) else [(None, v) for v in value[:elements]] if isinstance(value, list) else []
        for key, child in children:
            own = f"{path}[]" if key is None else f"{path}.{key}" if path else key
            if terms is None or (key is not None and any(t in key.lower() for t in terms)):
                n, types, examples = found.setdefault(own, [0, set(), []])
                found[own][0] = n + 1
                types.add(type(child).__name__)
                text = repr(child)[: walks.LONGEST]
                if not isinstance(child, (dict, list)) and len(examples) < most and not (distinct and text in examples):
                    examples.append(text)
            scan(child, own, place)

    for text, _ in sorted((r for r in rows if r[0]), key=lambda r: float("inf") if r[1] is None else r[1]):
        try:
            scan(json.loads(text), "", 0)
        except ValueError:
            pass
    return {k: (n, sorted(t), e) for k, (n, t, e) in found.items()}


def texts(n, seed=0):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(9 if depth < 4 else 6)
        if kind < 6:
            return [rng.randrange(30), rng.random(), "t" * rng.randrange(300), None, True, rng.choice("abc")][kind]
        return {rng.choice(["Pos", "z", "tcp_x", "a b"]): value(depth + 1) for _ in range(3)} if kind < 8 else [value(depth + 1) for _ in range(rng.randrange(5))]

    rows = [(json.dumps({"Pos": value(0), "z": value(0)}), i) for i in range(n)]
    return [*rows, ("", n), (None, n + 1), ("{broken", n + 2), ("[1, [2]]", n + 3), ('"text"', n + 4)]


def test_keys_equal_a_recursion(spark, monkeypatch):
    monkeypatch.setattr(walks, "HELD", 20)  # passes on what it has, again and again
    rows = texts(400)
    mixed = random.Random(1).sample(rows, len(rows))
    data = spark.createDataFrame(mixed, "body string, at long").repartition(7)
    for terms, most, elements, distinct in [(None, 3, None, True), (["pos", "TCP"], 3, 2, False), (["z"], 20, 2, True), (["absent"], 3, 2, True)]:
        got = walks.key_paths(data, "body", "at", terms, most, elements, distinct).collect()
        want = brute(rows, terms and [t.lower() for t in terms], most, elements, distinct)
        assert {r.path: (r.n, r.types, r.examples) for r in got} == want


def test_rows_without_order_and_empty_tables(spark):
    data = spark.createDataFrame([('{"k": 2}', None), ('{"k": 1}', 5), ('{"k": 2}', 9)], "body string, at long")
    assert walks.key_paths(data, "body", "at").first().examples == ["1", "2"]
    assert walks.key_paths(data, "body").first().examples == ["1", "2"]  # equal places: by the text
    assert walks.key_paths(data.limit(0), "body", "at").count() == 0
    assert walks.key_paths(spark.createDataFrame([("[" * 100_000,)], "body string"), "body").count() == 0


def test_first_values(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 30, None, "" if i % 2 else "x") for i in range(100)], "at int, a int, b double, c string").repartition(5)
    got = {r.field: (r.type, r.first_values) for r in walks.first_values(rows, ["a", "b", "c"], ["at"]).collect()}
    assert got == {"a": ("int", [str((i * 7) % 30) for i in range(20)]), "b": ("double", []), "c": ("string", ["x"])}
    assert walks.first_values(rows.limit(0), ["a"], ["at"]).count() == 0
