"""Candidates and verification of the line dedup on groups of lines that share much text."""

import random

import numpy as np

from auditlake.llm import line_dedup


def edited(rng, line, edits):
    c = list(line)
    for _ in range(edits):
        i = rng.randrange(len(c))
        rng.choice([lambda: c.insert(i, "q"), lambda: c.pop(i), lambda: c.__setitem__(i, "z")])()
    return "".join(c)


def text(rng, chars):
    return "".join(rng.choice("abcdefghé ") for _ in range(chars))


def test_wide_bands_of_many_pairs():
    rng = random.Random(11)
    for words, chars in ((1, 300), (2, 1200), (3, 2200)):
        pairs = []
        for _ in range(60):
            a = text(rng, chars + rng.randint(-40, 40))
            b = edited(rng, a, rng.randint(0, 2 * (chars // 24)))
            pairs.append((a, b) if len(a) >= len(b) else (b, a))
        k = np.array([len(b) // 24 for _, b in pairs])
        want = [line_dedup.within(a, b, int(x)) for (a, b), x in zip(pairs, k)]
        assert 5 < sum(want) < 55
        assert line_dedup._wide([a for a, _ in pairs], [b for _, b in pairs], k, words).tolist() == want
        assert line_dedup.within_all([a for a, _ in pairs], [b for _, b in pairs], k).tolist() == want


def test_counts_of_16_classes_never_refuse_a_near_pair():
    rng = random.Random(12)
    for _ in range(300):
        a, edits = text(rng, rng.choice((30, 300, 3000))), rng.randint(0, 8)
        b = edited(rng, a, edits)
        x, y = line_dedup.nibbles([a, b])[:, None]
        assert line_dedup.apart(x, y)[0] + abs(len(a) - len(b)) <= 2 * edits


def test_keys_of_the_shorter_line_are_looked_up_by_the_longer():
    """Edits dealt evenly leave the fewest segments whole; lines side by side give the same keys as alone."""
    rng = random.Random(13)
    lines = []
    for chars in (24, 47, 48, 95, 96, 150, 240, 400, 800, 1600):
        for _ in range(20):
            a = list(text(rng, chars))
            for i in range(chars // 24):
                a[i * 24 + rng.randrange(24)] = "Z"
            lines += ["".join(a), text(rng, chars)]
            lines.append(edited(rng, lines[-1], chars // 24))
    together = line_dedup.keys(lines)
    alone = [line_dedup.keys([line]) for line in lines]
    assert (np.bincount(together[0], minlength=len(lines)) == [len(x[0]) for x in alone]).all()
    order = np.argsort(together[0], kind="stable")
    for c in (1, 2, 3):
        assert (together[c][order] == np.concatenate([x[c] for x in alone])).all()
    for (i, a), (j, b) in (((i, lines[i]), (i + 1, lines[i + 1])) for i in range(1, len(lines), 3)):
        if len(a) > len(b):
            i, j, a, b = j, i, b, a
        if line_dedup.within(a, b, len(a) // 24):
            assert set(alone[i][1][alone[i][3] > 0].tolist()) & set(alone[j][1].tolist())


def test_dense_group_against_all_pairs(spark, monkeypatch):
    """Variants of one long line, most of them not near: every later line near an earlier one is found, however the group is tiled."""
    rng = random.Random(14)
    base = text(rng, 500)
    lines = [base] + [edited(rng, base, rng.randint(4, 40)) for _ in range(70)] + [text(rng, 500) for _ in range(20)]
    lines += [edited(rng, lines[i], 15) for i in range(1, 90, 4)]
    lines = list(dict.fromkeys(lines))
    near = lambda a, b: line_dedup.within(a, b, min(len(a), len(b)) // 24)
    want = {j for j in range(len(lines)) if any(near(lines[i], lines[j]) for i in range(j))}
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").repartition(3)
    assert 20 < len(want) < len(lines) - 20
    assert {r["b"] for r in line_dedup.near_earlier(df).collect()} == want
    monkeypatch.setattr(line_dedup, "TILE", 50)
    assert {r["b"] for r in line_dedup.near_earlier(df).collect()} == want


def test_lines_go_to_as_many_tiles_as_there_are_parts(spark):
    """All pairs of 200 lines: the text of a line was sent once per candidate, 19,900 times in all."""
    ids = np.arange(1000, 1200)
    rows = [(1000, int(b), ids[ids < b].tobytes(), 3) for b in ids[1:]]
    got = line_dedup.tiles(spark.createDataFrame(rows, "g long, b long, a binary, r long")).collect()
    assert len(got) <= 2 * 3 * len(ids) and len({r["tile"] for r in got}) == 9
    pairs = [(r["id"], a) for r in got if r["a"] is not None for a in np.frombuffer(r["a"], "<i8").tolist()]
    assert sorted(pairs) == [(int(b), int(a)) for b in ids for a in ids if a < b]
    held = {(r["tile"], r["id"]) for r in got}
    assert all((r["tile"], a) in held for r in got if r["a"] is not None for a in np.frombuffer(r["a"], "<i8").tolist())


def test_a_key_of_many_lines_is_matched_in_parts(spark, monkeypatch):
    rng = random.Random(15)
    head = text(rng, 60)
    lines = [head + text(rng, 60) for _ in range(120)]
    lines += [edited(rng, line, 3) for line in lines[::6]]
    df = spark.createDataFrame([(i, line, 1) for i, line in enumerate(lines)], "id long, line string, open int")
    rows = [r.asDict() for r in line_dedup.packed(df, 0, 1).collect()]
    whole = {(a, b) for x, y in line_dedup.matches(rows) for a, b in zip(x.tolist(), y.tolist())}
    monkeypatch.setattr(line_dedup, "MATCHES", 7)
    assert {(a, b) for x, y in line_dedup.matches(rows) for a, b in zip(x.tolist(), y.tolist())} == whole and len(whole) > 1000
