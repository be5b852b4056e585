import hashlib
import random

import numpy as np
import pytest

from tidestore.llm import components, line_dedup, near_dup, substring_dedup

from .conftest import words

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def union(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zz" + str(rng.randrange(1000))
    return " ".join(w)


def corpus():
    rng, rows = random.Random(3), []
    base = [words(60 + 20 * k, k) for k in range(6)]
    for k, b in enumerate(base):
        rows += [b, b.upper() if k % 2 else b, edited(b, rng, 1), edited(b, rng, 2), edited(b, rng, 5), b + " tail words here"]
    chain = words(80, 50).split()
    rows += [" ".join(chain[i : i + 70]) for i in range(0, 10, 2)]
    rows += ["", None, "one", "one", "One two", "  ", "one two three", words(5, 9)]
    passage = words(40, 77)
    rows += [words(40, 200 + i) + " " + passage for i in range(30)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize(("shingle", "percent", "block"), [(3, 85, 256), (5, 80, 2)])
def test_near_duplicates_equal_brute_force(make_docs, shingle, percent, block):
    rows = corpus()
    params = near_dup.NearDupParams(shingle=shingle, percent=percent, block=block, crowd=1 if block == 2 else 16)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(make_docs(rows), params).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOW).split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b])]
    want = union(sets, links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_one_bucket_of_twenty_thousand(spark, monkeypatch):
    """Texts of one template, most of them unlike: none is compared with all others, and no link is lost."""
    rng, template = random.Random(4), words(60, 1)
    rows = []
    for i in range(20_000):
        own = " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))
        rows.append((i, f"{template} {own}" if i % 100 else f"{template} {rows[i - 50][1].split(' ', 60)[60] if i else own} end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    made = []
    across = near_dup._across_components

    def counted(members, *rest):
        made.append(members.agg(near_dup.F.sum("blocks")).first()[0] or 0)
        return across(members, *rest)

    monkeypatch.setattr(near_dup, "_across_components", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: i - 50 if i and i % 100 == 0 else i for i in range(20_000)}
    assert sum(made) < 40 * 20_000


def test_near_duplicates_of_odd_rows(make_docs):
    text = words(30)
    rows = [(3, text), (3, text), (None, text), (2, text), (9, None), (9, "")]
    got = near_dup.near_duplicates(make_docs(rows)).collect()
    assert len(got) == 6
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(3, 2, False), (None, None, True), (2, 2, True), (9, 9, True)}
    assert near_dup.near_duplicates(make_docs(rows).limit(0)).count() == 0
    kept = near_dup.drop_near_duplicates(make_docs(rows))
    assert kept.columns == make_docs(rows).columns and kept.count() == 4


def test_bands_miss_little():
    p = near_dup.NearDupParams()
    assert (1 - 0.8**p.rows) ** p.bands <= p.miss


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 201), (201, 202), (202, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    df = spark.createDataFrame([*links, (None, 1), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected_components(df).collect()}
    ids = {x for ab in links for x in ab if ab[0] != ab[1]}
    assert got == {i: c for i, c in union({x for ab in links for x in ab}, links).items() if i in ids}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lines_equal_brute_force(make_docs):
    rng = random.Random(5)
    pool = [words(6, k) for k in range(25)] + [words(40, 90 + k) for k in range(6)] + [words(n, 300 + n)[: n + 1] for n in range(1, 40, 3)] + ["short", "x", "é" * 20, "é" * 40, "aaaaaaaaaaaaaaaaaaaaaaa", "ab" * 40, ""]

    def line():
        s = rng.choice(pool)
        if s and rng.random() < 0.5:
            p = rng.randrange(len(s))
            s = rng.choice([s[:p] + s[p + 1 :], s[:p] + "é" + s[p:], s[:p] + "Z" + s[p + 1 :], s[:p] + "YY" + s[p:]])
        return rng.choice(["", " ", "\t"]) + s + rng.choice(["", "\r", " "])

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 9)))) for i in range(40)] + [(100, None), (None, pool[0]), (101, "\n\n")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(make_docs(rows), removed="removed").collect()}
    earlier = []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines = (t or "").split("\n")
        keep, own = [], []
        for s in lines:
            s_ = s.strip(line_dedup.BLANK)
            gone = s_ and any(s_ == e or (abs(len(s_) - len(e)) < 2 and distance(s_, e) <= 1) for e in earlier)
            own.append(bool(gone))
            if s_:
                earlier.append(s_)
            if not gone:
                keep.append(s)
        assert got[i]["text"] == (None if t is None else "\n".join(keep)), i
        assert got[i]["removed"] == [k for k, g in enumerate(own) if g]
    assert got[None]["text"] == pool[0]
    assert line_dedup.dedup_lines(make_docs(rows)).columns == make_docs(rows).columns
    assert line_dedup.line_dedup_report(make_docs(rows).limit(0)).count() == 0


def test_rows_of_one_id_keep_their_own_lines(make_docs):
    one, two, near = words(8, 1), words(8, 2), words(8, 1)[:-1]
    rows = [(1, one), (5, f"{one}\nalpha {two}"), (5, f"beta {two}\n{near}"), (5, f"gamma {two}\nalpha {two}"), (7, f"new\nbeta {two}")]
    got = sorted((r["doc_id"], r["text"], r["removed"]) for r in line_dedup.dedup_lines(make_docs(rows), removed="removed").collect())
    want = [(1, one, []), (5, f"alpha {two}", [0]), (5, f"beta {two}", [1]), (5, f"gamma {two}\nalpha {two}", []), (7, "new", [1])]
    assert got == sorted(want)


def test_very_long_lines(make_docs):
    long = "ab" + "".join(random.Random(8).choices("abcdé ", k=100_000)) + "."
    rows = [(1, long), (2, long[:60_000] + "Z" + long[60_000:]), (3, long[:99_000] + "X" + long[99_001:]), (4, "Q" + long[2:] + "Q"), (5, long[1:])]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(make_docs(rows), removed="removed").collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: [], 5: [0]}


def test_line_dedup_has_no_python_in_its_plan(make_docs):
    plan = line_dedup.line_dedup_report(make_docs([(1, "a\nb"), (2, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    a = rng.integers(97, 99, 700).astype(np.uint8)
    data = np.concatenate([a, a[:300], np.zeros(90, np.uint8), np.full(120, 255, np.uint8)])
    text, order = data.tobytes(), substring_dedup.suffix_array(data)
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    got = substring_dedup.common_prefixes(data, order, 50, lanes=7)
    for p in range(1, len(order)):
        x, y = text[order[p - 1] :][:50], text[order[p] :][:50]
        assert got[p] == next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))


def removed(rows, length=50):
    out, seen = {}, {}
    for i, t in rows:
        x = (t or "").encode()
        for j in range(len(x) - length + 1) if i is not None else ():
            s = x[j : j + length]
            seen[s] = min(seen.get(s, i), i)
    for i, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for j in range(len(x) - length + 1) if i is not None else ():
            if seen[x[j : j + length]] < i:
                gone[j : j + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out[i] = (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard_bytes", [16 << 20, 600])
def test_substrings_equal_brute_force(spark, make_docs, shard_bytes, monkeypatch):
    merges, merged = [], substring_dedup.merged_ranges
    monkeypatch.setattr(substring_dedup, "merged_ranges", lambda strings: merges.append(strings.count()) or merged(strings))
    rng, rows = random.Random(2), corpus()
    passage, other = "é" + words(30, 500), words(12, 501)
    rows += [(1000 + i, words(20, 600 + i) + passage[rng.randrange(9) :] + words(9, 700 + i) + other) for i in range(25)]
    rows += [(2000, "ab" * 200), (2001, "ab" * 30), (2002, "x" * 49), (2003, "x" * 49), (2004, "x" * 50), (2005, "x" * 51), (None, passage), (2006, "\0" * 60), (2007, "\0" * 55)]
    rows += [(2000, "ab" * 200)]
    params = substring_dedup.SubstringParams(shard_bytes=shard_bytes, block_bytes=2000, batch_bytes=3000, context_bytes=3000)
    got = substring_dedup.dedup_substrings(make_docs(rows), params).collect()
    assert bool(merges) == (shard_bytes < 1000) and all(n > 20 for n in merges)
    want = removed(rows)
    assert len(got) == len(rows)
    for r in got:
        n = sum(x["past"] - x["first"] for x in r["spans"])
        assert (r["n_bytes"], n, len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) == want[r["doc_id"]], r["doc_id"]


def test_merge_of_runs_whose_high_halves_collide():
    runs = [([1, 5, 5, 9], [0, 1, 3, 0], [4, 7, 2, 1]), ([5, 5, 8], [1, 2, 0], [3, 9, 9]), ([], [], [])]
    runs = [(np.array(h, np.uint64), np.array(lo, np.uint64), np.array(m, np.int64)) for h, lo, m in runs]
    high, low, least, places = substring_dedup.merge_sorted(runs)
    assert list(zip(high.tolist(), low.tolist(), least.tolist(), strict=True)) == [(1, 0, 4), (5, 1, 3), (5, 2, 9), (5, 3, 2), (8, 0, 9), (9, 0, 1)]
    assert [p.tolist() for p in places] == [[0, 1, 3, 5], [1, 2, 4], []]


def test_substrings_of_nothing(make_docs):
    assert substring_dedup.substring_report(make_docs([(1, "")]).limit(0)).count() == 0
    got = substring_dedup.substring_report(make_docs([(1, None), (2, "")])).collect()
    assert {(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {(0, 0, 0)}
