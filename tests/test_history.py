import random
import re
from datetime import datetime, timedelta

import pytest

from normloom.operators import history as V

SCHEMA = "id string, status string, eff string, observed_at timestamp, loaded_at timestamp, version_no int"
T0 = datetime(2024, 1, 1)


def frame(spark, data):
    return spark.createDataFrame([(i, s, e, T0 + timedelta(minutes=o) if o is not None else None, T0 + timedelta(minutes=x) if x is not None else None, 7) for i, s, e, o, x in data], SCHEMA)


def run(spark, data, **kw):
    out = V.versions(frame(spark, data), "id", ["status"], ["eff"], **kw)
    minutes = lambda t: None if t is None else int((t - T0).total_seconds() // 60)
    return sorted((r["id"], r["version_no"], r["status"], r["eff"], minutes(r["valid_from"]), minutes(r["valid_to"])) for r in out.collect())


def brute(data):
    best = {}
    for i, s, e, o, x in data:
        if i is None or o is None:
            continue
        s = None if s is None else s.strip().lower()
        e = None if e is None or not e.strip() else e.strip()
        key = (x is not None, x or 0, s is not None, s or "", e is not None, e or "")
        if (i, o) not in best or key > best[i, o][0]:
            best[i, o] = (key, (s, e))
    out = []
    for i in {k[0] for k in best}:
        runs = []
        for o in sorted(k[1] for k in best if k[0] == i):
            state = best[i, o][1]
            if not runs or runs[-1][0] != state:
                runs.append((state, o))
        for n, (state, o) in enumerate(runs):
            out.append((i, n + 1, *state, o, runs[n + 1][1] if n + 1 < len(runs) else None))
    return sorted(out)


def test_rules(spark):
    data = [
        ("a", "In_Force ", "2024-01-01", 0, 1), ("a", "in_force", "2024-01-01", 10, 11), ("a", "in_force", "", 20, 21), ("a", "in_force", None, 30, 31),
        ("a", "in_force", "2024-01-01", 40, 41), ("a", "in_force", "2024-01-01", 40, 41), ("a", "amended", None, 40, 90), (None, "x", None, 1, 1), ("b", "x", None, None, 1),
        ("c", None, None, 5, None),
    ]
    assert run(spark, data) == brute(data) == [
        ("a", 1, "in_force", "2024-01-01", 0, 20), ("a", 2, "in_force", None, 20, 40), ("a", 3, "amended", None, 40, None), ("c", 1, None, None, 5, None),
    ]


@pytest.mark.parametrize("slice_rows", [100_000, 50])
@pytest.mark.parametrize("states", [1, 2, 5])
def test_random_across_words_and_slices(spark, states, slice_rows):
    r = random.Random(states)
    data = [("hot", f"s{r.randrange(states)}", r.choice(["", None, "2024-02-02"]), r.randrange(900), r.randrange(50)) for _ in range(700)]
    data += [(f"d{r.randrange(5)}", f"s{r.randrange(states)}", None, r.randrange(200), r.randrange(50)) for _ in range(150)]
    r.shuffle(data)
    assert run(spark, data, slice_rows=slice_rows) == brute(data)


def test_one_entity_in_slices(spark):
    """Every row of one entity, in runs that cross slices; nothing but a row per slice is gathered per entity."""
    r = random.Random(7)
    data = [("hot", f"s{i // 45 % 3}" if r.random() > 0.02 else "odd", None, i * 3, i) for i in range(800)] + [("hot", "same", None, 9000 + i, i) for i in range(150)]
    assert run(spark, data, slice_rows=40) == brute(data)
    out = V.versions(frame(spark, data), "id", ["status"], ["eff"], slice_rows=40)
    lines = [re.sub(r"^[ :+\-|]*", "", x) for x in out._jdf.queryExecution().analyzed().toString().splitlines()]
    per_entity = [i for i, x in enumerate(lines) if x.startswith("Window ") and re.search(r"\], \[_e#\d+\], \[", x)]
    below = [next(x for x in lines[i:] if not x.startswith(("Window", "Project"))) for i in per_entity]
    assert below and all(re.match(r"Aggregate \[_e#\d+, _s#\d+\]", x) for x in below), below


def test_empty_and_moment(spark):
    assert run(spark, []) == []
    out = V.versions(frame(spark, [("a", "x", None, 0, 0), ("a", "y", None, 10, 10)]), "id", ["status"], ["eff"])
    at = lambda m: [r["status"] for r in V.at_moment(out, T0 + timedelta(minutes=m)).collect()]
    assert at(-1) == [] and at(0) == ["x"] and at(9) == ["x"] and at(10) == ["y"]
