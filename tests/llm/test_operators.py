"""Every training-data operator on small, awkward tables, against brute force or an exact round trip."""

import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import (binary, embedding, golay, licenses, line_dedup, mixing, packing, pii, quality_knn, quality_rules, rans,
                           simhash, tokens)
from auditlake.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the of and house river tree stone light water field morning letter carpenter window garden quiet little great old "
         "new road bridge winter summer paper music story").split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(4)
    out = [(i, sentence(rng, rng.randint(12, 80)) + ".", "en", f"src{i % 3}", 1) for i in range(30)]
    out += [(30, None, None, None, None), (31, "", "en", None, 0), (32, " \n\t ", "en", "src0", 4), (None, "no id here at all", "en", "src1", 1)]
    out += [(33, out[3][1], "en", "src0", 1), (34, out[3][1] + " end", "en", "src0", 1), out[5], out[5]]
    out += [(35, " ".join(sentence(rng, 40) for _ in range(150)), "en", "src2", 1), (36, "x" * 30000, "en", "src2", 1),
            (37, "é中 日本\r\n\tthe\x00 \x0b a<|endoftext|>b", "en", "src2", 1)]
    return out


def clash(df):
    """More columns, with names that the operators use inside."""
    for c in ("row", "key", "size", "fp", "group", "of", "at", "first", "bucket", "copies", "_m", "kept", "has_id", "shard"):
        df = df.withColumn(c, F.lit("theirs"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- 1 PII ---------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, docs, none):
    rng = random.Random(2)
    parts = ["a@b.c_d@e.f", "x@y", "me.two@mail.example.com,", "1.2.3.4.5", "256.1.1.1", "001.002.003.255", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "+1 (301) 555-0346", "+12", "é", "中", "+44 20 7946 0958 and", "12", " ", "\n", "a.b@c-d.e.f",
             "4" * 25, "@@", "+", "(", "1.1.1.1+2", "0" * 13]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "a" * 50000, "a.b" * 20000, "1 " * 20000, "a@b" + ".c" * 20000, "x@y.z " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(clash(df)).select("doc_id", *pii.KINDS, "found").collect()}
    for i, t in enumerate(texts):
        mine = [f"{k}:{s['start']}:{s['end']}" for k in pii.KINDS for s in got[i][k]]
        assert mine == base_spans(t), (i, t and t[:80])
    assert pii.find(none).count() == 0


def test_pii_contexts_find_unseen_identifiers(spark):
    texts = [f"please call number +1 (301) 555-0{i:03d} today for details" for i in range(12)]
    texts += ["please call number 301-555-7777 today for details", "the lot 301-555-8888 was sold for money",
              "please call number +1 (301) 555-0001 today for details"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert [(s["start"], s["end"]) for s in got[12]["found"]] == [(19, 31)]
    assert not got[13]["found"] and len(got[14]["phone"]) == 1


def test_pii_found_identifiers_induce_patterns(spark):
    """Seeds trust Tel:, what stands there trusts Ring:, and so a number that no seed's pattern surrounds is found."""
    rng = random.Random(3)
    far = lambda: "".join(rng.choice("abcdefghijklmnopq") for _ in range(9))
    texts = [f"{far()} Tel: +1 (301) 555-0{i:03d} {far()}" for i in range(20)]
    texts += [f"{far()} Tel: 301-555-70{i:02d} {far()}" for i in range(6)] + [f"{far()} Ring: 301-555-70{i:02d} {far()}" for i in range(6)]
    texts += [f"{far()} Ring: 301-555-9999 {far()}", f"{far()} Lot: 301-555-8888 {far()}"]
    # a neighbour that holds a digit, one longer than any bound, and a list of addresses
    texts += [f"{far()} Tel2: +1 (301) 555-1{i:03d} {far()}" for i in range(20)] + [f"{far()} Tel2: 301-555-6666 {far()}"]
    texts += [f"{far()} {'w' * 200}: +1 (301) 555-2{i:03d} {far()}" for i in range(20)] + [f"{far()} {'w' * 200}: 301-555-5555 {far()}"]
    texts += [f"{far()} {'w' * 199}: 301-555-4444 {far()}", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[r["doc_id"]][s["start"]:s["end"]] for r in pii.find(clash(df)).collect() for s in r["found"]}
    assert found == {f"301-555-70{i:02d}" for i in range(6)} | {"301-555-9999", "301-555-6666", "301-555-5555"}


def test_pii_bootstrap_against_brute_force(spark):
    """Trusted patterns of random mentions equal those of plain loops over sets."""
    rng = random.Random(17)
    seeds = {f"s{i}@x.org": "email" for i in range(12)} | {f"+1 301 555 0{i:03d}": "phone" for i in range(12)}
    unseen = [f"u{i}@x" for i in range(12)] + [f"301-555-1{i:03d}" for i in range(12)] + [f"v{i}" for i in range(6)]
    left, right = [f"l{i}" for i in range(9)] + [""], [f"r{i}" for i in range(9)] + [""]
    for spread in (2, 4, 9):
        rows_ = []
        for n, e in enumerate([*seeds, *unseen]):
            for _ in range(3):
                at = (n // 6 + rng.randint(0, spread)) % 10
                rows_.append((e, seeds.get(e), left[at], f"a {left[at]}" if left[at] else "", right[(at + rng.randint(0, 2)) % 10], ""))
        groups = {}
        for e, _, l, ll, r, _ in rows_:
            for p in (("l", l), ("ll", ll), ("r", r), ("b", f"{l} {r}" if l and r else "")):
                if p[1]:
                    groups.setdefault(p, set()).add(e)
        may = lambda e, k: seeds[e] == k if e in seeds else "@" in e if k == "email" else k == "phone" and e.startswith("301-")
        belief = {(e, k): pii.GRAIN for e, k in seeds.items()}
        while True:
            worth = {}
            for p, held in groups.items():
                for k in ("email", "phone"):
                    known = [belief[e, k] for e in held if (e, k) in belief]
                    open_ = sum(may(e, k) for e in held) - len(known)
                    score = int(2 * sum(known) / (2 * (len(held) + 1) - open_))
                    if len(known) >= pii.MIN_SEEDS and score >= pii.TRUST * pii.GRAIN:
                        worth[p, k] = score
            new = {}
            for (p, k), score in worth.items():
                for e in groups[p]:
                    if e not in seeds and may(e, k) and (e, k) not in belief:
                        new[e, k] = max(new.get((e, k), 0), score)
            if not new:
                break
            belief |= new
        df = spark.createDataFrame(rows_, "entity string, seed string, left string, left2 string, right string, right2 string")
        assert {((r["side"], r["context"]), r["kind"]) for r in pii.induce(df).collect()} == set(worth) and worth


# -- 2 quality classifier ------------------------------------------------------------------------

def test_quality_classifier(spark, docs, none):
    rng = random.Random(8)
    good = [(i, sentence(rng, 60) + ".") for i in range(120)]
    bad = [(1000 + i, " ".join(w + rng.choice(["###", "$$$"]) for w in sentence(rng, 60).split())) for i in range(60)]
    table = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), (None, "the house")], "doc_id long, text string")
    assert quality_knn.shape("a1" * 20 + "B") != quality_knn.shape("a1" * 20 + "#")
    labels = spark.createDataFrame([(5000, 0), (5001, 0)] + [(i, 1) for i, _ in good[:60]] + [(i, 0) for i, _ in bad[:30]] + [(None, 1), (7, None)],
                                   "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(clash(table), labels).collect()}
    assert len(got) == 183 and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i, _ in good[60:]) > max(got[i] for i, _ in bad[30:])
    assert {r["score"] for r in quality_knn.score(docs, labels.where("false")).collect()} == {0.5}
    assert quality_knn.score(none, labels).count() == 0


# -- 3 mixing ------------------------------------------------------------------------------------

def fill(sizes, weights, goal):
    """Targets by the sentence of the rule: reshare what is above twice the size until none is."""
    target, capped = {}, set()
    while True:
        left = goal - sum(2 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        total = sum(weights[s] for s in free)
        target = {s: 2 * sizes[s] if s in capped else left * weights[s] / total for s in sizes}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark, docs, none):
    narrow = mixing.sized(clash(docs))
    got = [r.asDict() for r in narrow.join(mixing.copies(narrow), "key").collect()]
    assert len(got) == len(rows())
    again = [r.asDict() for r in narrow.join(mixing.copies(narrow), "key").collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = {}
    for _, t, _, s, _ in rows():
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert abs(mine[0]["target"] - target[s]) < 1e-6 and mine[0]["source_size"] == sizes[s]
        assert all(0 <= r["copies"] <= 2 for r in mine)
        off = target[s] - sum(r["copies"] * r["size"] for r in mine)
        spare = [r["size"] for r in mine if r["size"] and (r["copies"] < 2 if off > 0 else r["copies"] > 0)]
        assert abs(off) <= 0.02 * target[s] + 12 or abs(off) < min(spare, default=1e9)
    mixed = mixing.mix(clash(docs))
    assert mixed.columns == clash(docs).columns and mixing.mix(none).count() == 0
    assert mixed.where("row = 'theirs'").count() == sum(r["copies"] for r in got)


# -- 4 SimHash -----------------------------------------------------------------------------------

def test_golay_code():
    near, far = golay.tables()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 4000)
    assert np.bitwise_count(near[golay._remainder(x)]).max() <= 3
    y = x ^ (1 << rng.integers(0, 23, 4000))
    home, nearby = golay.home(x), golay.nearby(y)
    assert all(h in n for h, n in zip(home.tolist(), nearby.tolist()))


def components(fps, bits):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_simhash_links_and_components(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(4):
            g = f
            for _ in range(rng.randint(1, 5)):
                g ^= 1 << rng.randrange(64)
            fps.append(g)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {(r["src"], r["dst"]) for r in simhash.links(df).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == want
    comp = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    root = components(fps, 4)
    for i, j in ((i, j) for i in range(len(fps)) for j in range(i)):
        if signed[i] in comp and signed[j] in comp:
            assert (comp[signed[i]] == comp[signed[j]]) == (root[i] == root[j])


def test_simhash_documents(spark, docs, none):
    import xxhash
    got = simhash.near_duplicates(clash(docs)).collect()
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text, *_ in rows():
        w = [x for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
        shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert by_id[doc_id]["fp"] & ((1 << 64) - 1) == fp
    assert by_id[33]["component_id"] == 3 and by_id[30]["component_id"] == by_id[32]["component_id"] == 30
    kept = simhash.keep_one(clash(docs))
    assert kept.columns == clash(docs).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({r["group"] for r in got}) and 33 not in ids and ids.count(5) == 1
    assert simhash.keep_one(none).count() == 0


# -- 5 licences ----------------------------------------------------------------------------------

def test_licences(spark, none):
    files = spark.createDataFrame([
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files, to deal in the Software without restriction."),
        ("a/b/c.txt", "river stone water"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/x.txt", None),
        ("d/e.txt", "garden\nThis work is licensed under the GNU General Public License, version 3.\nwater"),
        ("d/f.txt", "nothing to state"), (None, "Released under the MIT License."), ("top.txt", ""), ("a/b/q/r/s.txt", "deep"),
        ("a/x.txt", None)], "path string, text string")
    got = {(r["_row"]["path"]): r for r in licenses.scan(clash(files)).collect()}
    assert licenses.scan(files).count() == 10
    assert got["a/LICENSE"]["own_license"] == "MIT" and got["a/b/LICENSE.txt"]["own_license"] == "Apache-2.0"
    assert got["a/b/c.txt"]["license"] == "Apache-2.0" and got["a/b/c.txt"]["distance"] == 0
    assert got["a/b/q/r/s.txt"]["license"] == "Apache-2.0" and got["a/b/q/r/s.txt"]["distance"] == 2
    assert got["a/x.txt"]["license"] == "MIT" and got["a/x.txt"]["inherited_from"] == "a"
    assert got["d/e.txt"]["own_license"] == "GPL-3.0" and got["d/f.txt"]["license"] is None
    assert got[None]["own_license"] == "MIT" and got["top.txt"]["license"] is None
    assert licenses.scan(none.select(F.col("lang").alias("path"), "text")).count() == 0


def cosines(passages, texts):
    """Per passage the best (score, license) over all templates, by hand."""
    def split(text):
        return [t for t in re.split(r"[^a-z0-9.+]+|\.(?![0-9])", text.lower()) if t]
    held = [set(split(t or "")) for t in texts]
    def vector(text):
        found = split(text)
        vec = {t: (1 + math.log(found.count(t))) * (math.log((1 + len(texts)) / (1 + (sum(t in h for h in held) if t in known else 0))) + 1)
               for t in set(found)}
        norm = math.sqrt(sum(w * w for w in vec.values()))
        return {t: w / norm for t, w in vec.items()}
    known = {t for _, text in licenses.TEMPLATES for t in split(text)}
    vectors = [(name, vector(text)) for name, text in licenses.TEMPLATES]
    out = []
    for passage in passages:
        mine = vector(passage)
        out.append(min((-sum(w * mine.get(t, 0) for t, w in vec.items()), name) for name, vec in vectors))
    return [(-s, name) for s, name in out]


AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS BE "
         "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY ARISING FROM THE USE OF THE SOFTWARE.")
MIT_TEXT = licenses.TEMPLATES[5][1][:-1] + (", and to permit persons to whom the Software is furnished to do so, subject to the following "
                                            "conditions: The above copyright notice and this permission notice shall be included in all "
                                            "copies or substantial portions of the Software.")
HEADERS = {"MIT": MIT_TEXT, "Apache-2.0": licenses.TEMPLATES[1][1], "BSD-3-Clause": licenses.TEMPLATES[7][1],
           "GPL-3.0": licenses.TEMPLATES[12][1], "GPL-2.0": licenses.TEMPLATES[13][1]}


def test_wrapped_headers_against_brute_force(spark):
    files, want = [], {}
    for name, notice in HEADERS.items():
        for mark, width in (("# ", 60), ("// ", 78), (" * ", 70), ("", 66)):
            header = "\n".join(mark + line for line in textwrap.wrap(notice, width))
            warranty = "\n".join(mark + line for line in textwrap.wrap(AS_IS, width))
            path = f"src/{name}{len(files)}.py"
            files.append((path, f"{header}\n{mark.rstrip()}\n{warranty}\n\nimport os\nprint(1)\n"))
            want[path] = (name, notice)
    files.append(("src/near.py", "\n".join("# " + x for x in textwrap.wrap(HEADERS["MIT"], 64)) + "\nimport os\nimport re"))
    want["src/near.py"] = ("MIT", HEADERS["MIT"])
    got = {r["_row"]["path"]: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    scores = cosines([notice for _, notice in want.values()], [t for _, t in files])
    for (path, (name, _)), (score, best) in zip(want.items(), scores):
        assert best == name and got[path]["own_license"] == name, path
        assert got[path]["own_score"] >= round(score, 9) - 1e-8, path


def test_oracle_sql_is_sql():
    from auditlake.llm.queries import ORACLE_SQL
    assert ORACLE_SQL and all(isinstance(sql, str) for sql in ORACLE_SQL.values())


def test_licence_scan_against_brute_force(spark):
    rng = random.Random(8)
    files = {}
    for _ in range(60):
        folder = "/".join(["", "a", "a/b", "a/b/c", "a/b/c/d", "a/e", "f", "f/g/h"][rng.randrange(8)].split("/"))
        name = rng.choice(["LICENSE", "COPYING.txt", *[f"x{i}.py" for i in range(9)]])
        kept = [w for w in rng.choice(licenses.TEMPLATES)[1].split(" ") if rng.random() < 0.8]
        notice = rng.choice(["", " ".join(kept), "\n".join(textwrap.wrap(" ".join(kept), 50))])
        files[f"{folder}/{name}".lstrip("/")] = f"{sentence(rng, 5)}\n\n{notice}\n\n{sentence(rng, 5)}"

    def passages(path, text):
        cue = lambda parts: [p for p in parts if re.search(licenses.CUE, p)]
        lines = cue(text.split("\n"))
        whole = [text] if re.search(licenses.LICENCE_FILE, path.split("/")[-1]) else []
        return lines and [*lines, *cue(s for x in lines for s in re.split(licenses.SENTENCE, x)), "\n".join(lines), *cue(text.split("\n\n")), *whole]

    own, stated = {}, {}
    for path, text in files.items():
        found = [(-round(s, 9), name) for s, name in cosines(passages(path, text), files.values()) if round(s, 9) >= licenses.THRESHOLD]
        own[path] = min(found, default=(None, None))
        if found and re.search(licenses.LICENCE_FILE, path.split("/")[-1]):
            folder = path.rpartition("/")[0]
            stated[folder] = min(stated.get(folder, (0, "", "")), (own[path][0], path, own[path][1]))
    got = {r["_row"]["path"]: r for r in licenses.scan(spark.createDataFrame([*files.items()], "path string, text string")).collect()}
    assert len(got) == len(files) and stated and len({name for _, name in own.values()}) > 4
    for path, (score, name) in own.items():
        r, above, steps = got[path], path.rpartition("/")[0], 0
        assert r["own_license"] == name and (r["own_score"] or 0) == pytest.approx(-(score or 0), abs=2e-9), path
        while above and above not in stated:
            above, steps = above.rpartition("/")[0], steps + 1
        granted = stated[above][2] if above in stated else None
        assert r["license"] == (name or granted), path
        assert (r["inherited_from"], r["distance"]) == ((above, steps) if granted and not name else (None, None)), path


# -- 6 token ids ---------------------------------------------------------------------------------

def test_encoder_equals_library():
    rng = random.Random(3)
    alphabet = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "'s", " 're", "9", " ", "　", "中", "!", "<|endoftext|>",
                " <|endoftext|> ", "\r\n", "\x0b", "\x00", "\x01", "\x02", "×", "ɏ", "😀", " word,", "the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["", "x" * 5000]
    enc = tokens.Encoder(tokens.default_path(), remember=500)
    got = [raw for at in range(0, len(texts), 700) for raw in enc.encode(texts[at:at + 700])]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n, symbols in ((0, 5), (1, 1), (700, 3), (rans.LANES * 5 + 17, 60000), (rans.LANES * (2 * rans.CHECKPOINT_STEPS + 3), 900)):
        ids = (rng.zipf(1.3, n) % symbols).astype("<u4")
        count = np.bincount(ids, minlength=1)
        table = rans.Table(np.flatnonzero(count), count[count > 0])
        raw = rans.encode_block(ids, table, np.arange(3), np.ones(3, bool), np.array([n, 0, 0]))
        block = rans.Block(raw)
        assert np.array_equal(block.decode(table), ids)
        for mark, (step, _, _) in enumerate(block.marks):
            assert np.array_equal(block.decode(table, mark), ids[step * rans.LANES:])
        if n > 100:
            broken = bytearray(raw)
            broken[len(raw) // 2] ^= 1
            with pytest.raises(ValueError):
                rans.Block(bytes(broken))


def library_ids(text, end):
    enc = tokens.encoder(tokens.default_path()).tokenizer
    return np.array([*enc.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(spark, docs, none, tmp_path):
    binary.write(clash(docs), f"file://{tmp_path}/all", block_tokens=3000)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in binary.read(spark, f"file://{tmp_path}/all").collect())
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library_ids(text, 0)
        want.append((start, doc_id, len(ids), ids.tobytes()))
        start += len(ids)
    assert got == want
    binary.write(none, f"file://{tmp_path}/none")
    assert binary.read(spark, f"file://{tmp_path}/none").count() == 0


# -- 7 quality rules -----------------------------------------------------------------------------

def test_quality_rules(spark, none):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["the a", "", " ", "of it", "x#*"]) for _ in range(9)) for _ in range(30)] + [None, "", "the " * 3000]
    texts += [sentence(rng, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(clash(df)).collect():
        t, m = texts[r["_row"]["doc_id"]] or "", r["_m"]
        w = words(t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(w) < 100 else set(range(len(w)))
        lines = [x for x in t.split("\n") if words(x)]
        assert (m["n_words"], m["word_chars"], m["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert (m["n_symbols"], m["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(clash(df))
    assert kept.columns == clash(df).columns and len(texts) - 1 in {r["doc_id"] for r in kept.collect()}
    assert quality_rules.keep_good(none).count() == 0


# -- 8 line dedup --------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def edited(rng, line, n):
    c = list(line)
    for _ in range(n):
        i = rng.randrange(len(c))
        rng.choice([lambda: c.insert(i, "q"), lambda: c.pop(i), lambda: c.__setitem__(i, "z")])()
    return "".join(c)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = edited(rng, a, rng.randint(0, 4)) if len(a) > 5 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
        for k in range(4):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


def test_edit_distance_of_many_pairs():
    rng = random.Random(3)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice("abcdé😀") for _ in range(rng.choice((0, 1, 5, 30, 100, 260, 900))))
        pairs.append((a, edited(rng, a, rng.randint(0, 2 + len(a) // 20)) if len(a) > 4 else a[:3] + "x"))
    pairs += [(b, a[::-1]) for a, b in pairs[:50]] + [("a" * 40, "a" * 30), ("", "")]
    k = np.array([max(0, min(len(a), len(b)) // 24 + rng.randint(-1, 1)) for a, b in pairs])
    want = [distance(a, b) <= x for (a, b), x in zip(pairs, k)]
    assert line_dedup.within_all([a for a, _ in pairs], [b for _, b in pairs], k).tolist() == want
    assert [line_dedup.within(a, b, int(x)) for (a, b), x in zip(pairs, k)] == want and 100 < sum(want) < 500
    assert line_dedup.within_all([], [], k[:0]).tolist() == []


def test_counts_of_characters_move_by_two_with_an_edit(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice((30, 300, 3000))))
        b = edited(rng, a, rng.randint(0, 6))
        rows.append((*line_dedup.bags([a, b]).tolist(), distance(a, b) if len(a) < 400 else 6))
    df = spark.createDataFrame(rows, "x long, y long, k int")
    assert df.where(line_dedup._fits("x", "y", line_dedup.F.col("k"))).count() == len(rows)


def test_least_grams_are_those_of_each_line_alone():
    rng = random.Random(5)
    lines = ["".join(rng.choice("abc ") for _ in range(rng.choice((12, 13, 24, 80, 700)))) for _ in range(60)]
    together = line_dedup.least(lines)
    assert all((together[i] == line_dedup.least([line])[0]).all() for i, line in enumerate(lines))


def test_line_dedup_against_brute_force(spark, none):
    rng = random.Random(12)
    lines = [sentence(rng, rng.randint(3, 16)) for _ in range(50)] + ["short", "é" * 30, "", " \t", "}", "é"]
    lines += [edited(rng, line, rng.randint(1, 3)) for line in lines[:40]]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    table = [*enumerate(texts), (60, None), (61, ""), (None, texts[0]), (5, texts[5])]
    df = clash(spark.createDataFrame(table, "doc_id long, text string"))
    first, near = {}, set()
    for i, t in [*enumerate(texts), (10 ** 9, texts[0])]:
        for at, line in enumerate(t.split("\n")):
            if words(line):
                first.setdefault(line, (i, at))
    for a in first:
        for b in first:
            k = int(line_dedup.edits_allowed(min(len(a), len(b))))
            if k and first[a] < first[b] and distance(a, b) <= k:
                near.add(b)
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(table) and near
    for r in got:
        i, t = r["_row"]["doc_id"], r["_row"]["text"]
        place = 10 ** 9 if i is None else i
        want = t if t is None else "\n".join(line for at, line in enumerate(t.split("\n")) if not words(line)
                                             or first[line] == (place, at) and line not in near)
        assert r["text"] == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_threshold_grows_with_the_line(spark):
    rng = random.Random(21)
    lines = ["".join(rng.choice("abcdefgh    ") for _ in range(n)) for n in (47, 48, 71, 72, 96, 300, 300, 400) for _ in range(2)]
    lines += [edited(rng, a, rng.randint(1, len(a) // 24 + 1)) for a in lines for _ in range(2)]
    lines += [" ".join("replaced" if at == 9 else w for at, w in enumerate(a.split(" "))) for a in lines[10:16]]
    lines = [*dict.fromkeys(lines)]
    df = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    near = set()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            k = min(len(a), len(b)) // line_dedup.CHARS_PER_EDIT
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                near.add(i)
    got = {r["_row"]["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert {i for i, r in got.items() if r["n_near"]} == near and len([i for i in near if len(lines[i]) > 250]) > 5
    assert {i for i, r in got.items() if r["text"] == ""} >= near


# -- 9 packing -----------------------------------------------------------------------------------

def test_column_generation():
    rng = np.random.default_rng(3)
    sizes = np.unique(rng.integers(1, 60, 60))
    demand = rng.integers(1, 400, len(sizes))
    slots = packing.plan_slots(sizes, demand, 128)
    used = np.zeros(int((slots["sequence"] + slots["copies"]).max()), np.int64)
    for c in slots.itertuples():
        used[c.sequence:c.sequence + c.copies] += c.size
    per = slots.groupby("size")["copies"].sum()
    assert used.max() <= 128 and per.to_dict() == dict(zip(sizes.tolist(), demand.tolist()))
    assert len(used) <= 1.005 * (sizes * demand).sum() / 128 + 2


def test_packing(spark, docs, none):
    got = packing.pack(clash(docs)).toPandas()
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 2048
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    pieces = {}
    for r in got.itertuples():
        pieces.setdefault((None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    want = {}
    for doc_id, text, *_ in rows():
        ids = library_ids(text, 1)
        want.setdefault((doc_id, len(ids)), []).extend(
            (at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for at in range(0, len(ids), 2048))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(none).count() == 0


# -- 10 embeddings -------------------------------------------------------------------------------

def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 32))
    near = base[:60] + 0.08 * rng.standard_normal((60, 32))
    vectors = [[float(c) for c in v] for v in np.concatenate([base, near, base[:5], 2 * base[5:8]]).astype(np.float32)]
    odd = [None, [0.0] * 32, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [None] + [1.0] * 31, [], [1.0, 2.0], [1.0, 2.0]]
    table = [(i, v) for i, v in enumerate(vectors + odd)]
    got = {r["vec_id"]: r for r in embedding.near_duplicates(clash(spark.createDataFrame(table, "vec_id long, embedding array<float>"))).collect()}
    x = np.array(vectors)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    mine = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (mine <= links).all() and mine.sum() >= 0.9 * links.sum()
    for i in range(len(vectors), len(vectors) + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    a, b = len(table) - 2, len(table) - 1
    assert got[b]["component_id"] == a and got[b]["n_links"] == 1 and not got[b]["kept"]
    assert got[360]["component_id"] == 0 and got[360]["n_links"] >= 1
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("dim, shift", [(8, 0), (16, 0), (16, 1.5), (32, 0), (64, 1.5), (128, 0)])
def test_embedding_recall_in_any_dimension(spark, dim, shift):
    """Pairs just above the threshold, centred and off centre."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((600, dim)) + shift * np.ones(dim)
    x /= np.linalg.norm(x, axis=1)[:, None]
    across = rng.standard_normal(x.shape)
    across -= (across * x).sum(axis=1)[:, None] * x
    across /= np.linalg.norm(across, axis=1)[:, None]
    cos = rng.uniform(0.9, 0.93, 600)[:, None]
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos ** 2) * across])
    table = [(i, [float(c) for c in v]) for i, v in enumerate(both)]
    got = {r["vec_id"]: r["n_links"] for r in embedding.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    both /= np.linalg.norm(both, axis=1)[:, None]
    links = (both @ both.T >= 0.9).sum(axis=1) - 1
    mine = np.array([got[i] for i in range(len(both))])
    assert (mine <= links).all() and mine.sum() >= 0.9 * links.sum() > 0


def test_embedding_rows_that_repeat_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.05]
    table = [(5, a), (5, b), (5, b), (3, c), (None, a), (7, None), (7, a)]
    got = sorted(map(tuple, embedding.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (None, 0, None, False), (7, 0, 7, True),
                          (7, 1, 5, False)], key=str)
