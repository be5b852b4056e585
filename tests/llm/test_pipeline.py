import math
import re
from collections import Counter, defaultdict
from hashlib import md5

import corpus_pipeline
import __spark_entry__ as entry
from pyspark.sql import functions as F
from tidestore.llm import mixing, packing, registry, toxicity

from .conftest import words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def one_edit(a, b):
    """Whether two different lines are one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def slow_lines(docs):
    """doc_id to text without the lines that an earlier line equals or nearly equals, by comparing all of a length."""
    seen, out = defaultdict(dict), {}
    for i, text in sorted(docs.items()):
        keep = []
        for raw in text.split("\n"):
            line = raw.strip(" \t\r\v\f")
            near = line and (line in seen[len(line)] or any(one_edit(line, x) for n in (-1, 0, 1) for x in seen[len(line) + n]))
            if line:
                seen[len(line)][line] = True
            if not near:
                keep.append(raw)
        out[i] = "\n".join(keep)
    return out


def slow_groups(docs):
    """Least ids of the groups that links between all pairs make."""
    sets = {}
    for i, text in docs.items():
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    group = {i: i for i in docs}
    ids = sorted(docs)
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return group


def slow_mix(rows):
    """(position, doc_id) of every take."""
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sorted((r["doc_id"] for r in rows if r["source"] == s), key=lambda i: md5(str(i).encode()).hexdigest()) for s in names}
    params = mixing.MixParams()
    pick = lambda values, k: values[k % len(values)]
    targets = mixing.water_fill([sum(size[i] for i in of[s]) for s in names], [pick(params.weights, k) for k in range(len(names))], params.share, params.most)
    out = []
    for k, (s, target) in enumerate(zip(names, targets, strict=True)):
        slope, place = pick(params.slopes, k), 0
        for _ in (0, 1):
            for i in of[s]:
                left = min(size[i], int(target + 0.5) - place)
                if left > 0 and 2 * left >= size[i]:
                    y = min(1, place / target)
                    out.append((2 * y / ((1 - slope) + math.sqrt((1 - slope) ** 2 + 4 * slope * y)), i))
                place += size[i]
    return sorted(out)


def test_every_stage_equals_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = [r.asDict() for r in docs.collect()]
    before = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = lambda rows: {r["doc_id"]: r["text"] for r in rows}

    model = toxicity.fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    weight = dict(zip(model.coordinate.tolist(), model.weight.tolist(), strict=True))
    extract = toxicity._extractor(toxicity.ToxicityParams().bits)
    clean = set()
    for r in before:
        raw = r["text"].encode()
        own, _ = extract(packing.np.frombuffer(raw, packing.np.uint8), packing.np.array([0, len(raw)]))
        if 1 / (1 + math.exp(-max(-40, min(40, model.bias + sum(weight.get(f, 0.0) for f in own.tolist()))))) < 0.7:
            clean.add(r["doc_id"])
    assert set(texts(kept["toxicity"])) == clean and len(clean) < len(before)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(truth.get(r["doc_id"], 1) == 1 for r in before if r["doc_id"] not in clean)

    assert texts(kept["line_dedup"]) == slow_lines(texts(kept["toxicity"]))
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    groups = slow_groups(texts(kept["line_dedup"]))
    assert texts(kept["near_dedup"]) == {i: t for i, t in texts(kept["line_dedup"]).items() if groups[i] == i}
    want = slow_mix(kept["near_dedup"])
    assert Counter(r["doc_id"] for r in kept["mixing"] if WORD.search(r["text"])) == Counter(i for _, i in want)
    left = defaultdict(list)
    for t, i in want:
        left[i].append(t)
    order = [left[r["doc_id"]].pop(0) for r in kept["mixing"] if WORD.search(r["text"])]
    assert all(a <= b + 1e-9 for a, b in zip(order, order[1:], strict=False))

    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    tokens = Counter()
    for r in kept["mixing"]:
        tokens[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    packed = Counter()
    for p in kept["packing"]:
        packed[p["doc_id"]] += p["length"]
    assert packed == tokens
    whole = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in whole} == dict(tokens)


def test_stages_take_odd_rows_and_no_rows(spark, make_docs):
    odd = [(1, words(30, 1)), (1, words(30, 2)), (2, None), (3, ""), (None, words(30, 3)), (None, None, None), (4, "a\n" * 2000), (5, "x" * 100_000, None), (6, words(30, 1))]
    docs = make_docs(odd)
    for rows in (docs, docs.limit(0), docs.withColumn("text", F.lit(None).cast("string"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            n, before = out.count(), rows.count()
            assert n >= before if name == "packing" else n <= 2 * before
            if name == "line_dedup":
                assert n == before
            if name == "near_dedup" and before:
                assert out.where("doc_id is null").count() == rows.where("doc_id is null").count()


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.QUERIES) < set(names) and "pipeline" in names
