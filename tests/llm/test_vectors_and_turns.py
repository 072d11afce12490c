"""Range joins of embeddings, repair of conversations, whitening: each against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from geoquill.llm import ranges, turns, whitening

VECTORS = "vec_id long, embedding array<float>, label int, n_links string, cell int, node string"
TURNS = "conv_id long, turn long, role string, text string, conv int, cost string"


def unit(v):
    return np.asarray(v, float) / np.linalg.norm(v)


@pytest.fixture(scope="module")
def vectors():
    """Two labels: spread-out vectors, copies, a tight group, chains at the threshold's edge, and all kinds of odd rows."""
    rng = np.random.default_rng(3)
    out = []
    add = lambda v, label=1, key=None: out.append((len(out) if key is None else key, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, "x", 1, "y"))
    for label in (1, 2):
        for _ in range(150):
            add(rng.normal(size=8), label)
        centre = unit(rng.normal(size=8))
        for _ in range(120):  # a tight group
            add(centre + rng.normal(size=8) * 0.02, label)
        for k in range(60):  # a chain whose ends are no neighbours
            add(np.cos(k * 0.1) * np.eye(8)[0] + np.sin(k * 0.1) * np.eye(8)[label], label)
    same = out[3][1]
    for _ in range(70):
        add(same)
    add([5 * x for x in same])  # the same direction
    add(same, 2), add(same, None)
    add(None), add([0.0] * 8), add([]), add([1.0, None] + [0.0] * 6), add([math.nan] + [1.0] * 7), add([math.inf] + [1.0] * 7)
    add([1.0, 2.0], 1), add([2.0, 4.0], 1), add([1e38] * 8), add([1e-38] * 8)
    add(out[170][1], 1, key=5)  # an id on two vectors
    out.append(out[0])
    out.append((None, *out[200][1:]))
    rng.shuffle(out)
    return [(r[0] if r[0] is None else int(r[0]), *r[1:]) for r in out]


def linked(rows, least=0.93):
    """(key, links, component's smallest key) of every row, as a sorted list."""
    usable = [r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    links = [0] * len(rows)
    whole = [np.asarray(r[1], float) / np.abs(np.asarray(r[1], float)).max() if u else None for r, u in zip(rows, usable, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = whole[i], whole[j]
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], low.get(find(i)), r[0] is not None and r[0] == low.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("rows,pivots", [(2048, 32), (60, 6), (25, 3)])
def test_range_join_is_exact(spark, vectors, rows, pivots):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    got = ranges.near(df, rows=rows, pivots=pivots, sample=40)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == linked(vectors)


def test_range_join_of_nothing(spark):
    assert ranges.near(spark.createDataFrame([], VECTORS)).collect() == []
    one = ranges.near(spark.createDataFrame([(7, None, None, "", 0, "")], VECTORS)).collect()
    assert [tuple(r) for r in one] == [(7, 0, 7, True)]


def test_a_tight_group_is_linked_without_comparisons(spark, monkeypatch):
    """All of 600 near copies lie in rings that are linked whole, so no product of blocks holds two of them."""
    rng = np.random.default_rng(1)
    centre = unit(rng.normal(size=16))
    rows = [(k, (centre + rng.normal(size=16) * 0.01).tolist(), 1) for k in range(600)] + [(600 + k, rng.normal(size=16).tolist(), 1) for k in range(150)]
    members = []
    real = ranges.found

    def spy(table, cosine, size, made):
        members.append(table.groupBy("cell").count().collect())
        return real(table, cosine, size, made)

    monkeypatch.setattr(ranges, "found", spy)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in ranges.near(df, rows=100, pivots=8, sample=80).collect()}
    assert all(got[k]["n_links"] == 599 and got[k]["component_id"] == 0 for k in range(600))
    assert sorted(map(tuple, got.values()), key=str) == linked([(*r, 0) for r in rows])
    # the group is a cell of its own: nobody is copied into it, and its nodes nowhere
    assert sum(r["count"] for r in members[0]) <= 1.3 * len(rows)


# -- conversations ----------------------------------------------------------------------------


def crc_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """From the end backwards: the least (cost, audit, lines) from each row and state; insertions tried up to three."""
    convs = {r[0]: [] for r in rows}
    for r in crc_damage(rows):
        convs[r[0]].append(r[1:])
    out = []
    for conv, items in convs.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in items:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}

        @cache
        def best(i, state, left, items=items, faults=faults):
            found = []
            if left:
                for role in follow[state].replace("s", ""):
                    c, audit, lines = best(i, role, left - 1)
                    found.append((c + 3, "I" + audit, ({"u": "user", "a": "assistant"}[role] + ":", *lines)))
            if i == len(items):
                if state in ("", "a"):
                    found.append((0, "", ()))
            else:
                _, role, text = items[i]
                c, audit, lines = best(i + 1, state, 3)
                found.append((c + 4, "D" + audit, lines))
                if faults[i] not in ("blank", "duplicate"):
                    extra = 3 if faults[i] == "truncated" else 0
                    for to in follow[state]:
                        c, audit, lines = best(i + 1, to, 3)
                        if role[:1] == to:
                            found.append((c + extra, "K" + audit, (role + ":" + text, *lines)))
                        if to != "s":
                            found.append((c + extra + 3, "R" + audit, ({"u": "user", "a": "assistant"}[to] + ":" + text, *lines)))
            return min(found) if found else (10**9, "Z", ())

        cost, audit, lines = best(0, "", 3)
        numbers = [t for t, *_ in items if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:], strict=False))
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = []
    say = lambda: rng.choice(["Hello.", "What?", "no end", "", " \n", "Yes!", "déjà vu.  ", "again and again."]) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(5)) + "."
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.1:
                continue
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(["system", "user", "assistant", "tool", "", None, "User"])
            rows.append((conv, None if rng.random() < 0.05 else turn, role, None if rng.random() < 0.05 else say(), 1, "x"))
    for turn in range(95):  # goes over many segments and batches
        rows.append((100, turn, rng.choice(["user", "assistant", "assistant", "system"]), say(), 1, "x"))
    rows += [(101, 3, "user", "same.", 1, "x"), (101, 3, "user", "same.", 1, "x"), (101, 3, "assistant", "other.", 1, "x")]
    rows += [(None, 1, "user", "who?", 1, "x"), (None, None, "assistant", "me.", 1, "x"), (102, None, None, None, 1, "x"), (103, -5, "system", "x" * 50_000 + ".", 1, "x")]
    dropped = next(k for k in range(200, 400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone.", 1, "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows,size", [(10_000, 128), (7, 3), (40, 2), (1, 1)])
def test_repair_is_cheapest(spark, talks, rows, size):
    df = spark.createDataFrame(talks, TURNS).repartition(3)
    got = turns.repair(df, rows=rows, turns=size)
    assert sorted(map(tuple, got.collect()), key=str) == brute(talks)


def test_repair_of_nothing(spark):
    got = turns.repair(spark.createDataFrame([], TURNS))
    assert got.collect() == [] and got.columns == ["conv_id", *(c.split()[0] for c in turns.RESULT.split(", "))]


# -- whitening --------------------------------------------------------------------------------


def test_whitening(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    rows = [(k, v.tolist(), "x", 0.5) for k, v in enumerate(base)]
    rows += [(1000 + k, base[3].tolist(), "x", 0.5) for k in range(300)]  # copies don't bend the fit
    rows += [rows[0], (None, base[5].tolist(), "x", 0.5), (5, base[6].tolist(), "x", 0.5)]
    odd = [(2000, None, "x", 0.5), (2001, [1.0, None, 2.0, 3.0, 4.0, 5.0], "x", 0.5), (2002, [math.nan] * 6, "x", 0.5), (2003, [math.inf] * 6, "x", 0.5), (2004, [], "x", 0.5)]
    short = [(2005, [1.0, 2.0], "x", 0.5)]
    df = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<double>, x string, whitened double").repartition(5)
    got = whitening.whiten(df).toPandas()
    x = {k: np.floor(256 * np.array(v)) for k, v, *_ in rows}
    every = [(k, np.floor(256 * np.array(v))) for k, v, *_ in rows]
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    assert (got["n"] == n).all() and len(got) == 4 * (len(rows) + 1)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    by = {k: v for k, v in got[got["vec_id"].notna()].groupby("vec_id")}
    sign = None
    for k, v in every:
        if k is None or k == 5 or k == 0:
            continue
        mine = by[k].sort_values("component")
        assert mine["component"].tolist() == [1, 2, 3, 4]
        assert set(mine["deviation"]) == {int(((n * v - sums) ** 2).sum())}
        w = ((n * v - sums) / n) @ q[:, :4] / np.sqrt(e[:4])
        if sign is None:
            sign = np.sign(w * mine["whitened"].to_numpy(float))
        assert np.allclose(mine["whitened"].to_numpy(float), w * sign, atol=1e-9)
        assert np.allclose(mine["explained"], e[:4] / e.sum(), rtol=1e-9)
    assert len(by[0]) == 8 and len(by[5]) == 8 and got["vec_id"].isna().sum() == 4
    assert by[2005][["deviation", "whitened"]].isna().all(axis=None) and len(by[2005]) == 4


def test_whitening_of_little_and_of_much(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    # two places: one component has variance; entries beyond 64 bits saturate
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], round(r["whitened"], 9)) for r in got) == [(1, 1, 2, 131072, -1.0), (2, 1, 2, 131072, 1.0), (3, 1, 2, 131072, 1.0)]
    large = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])], schema)).collect()
    assert [(r["vec_id"], r["deviation"], round(r["whitened"], 9)) for r in sorted(large)] == [(1, None, 1.0), (2, None, -1.0), (3, None, -1.0)]
