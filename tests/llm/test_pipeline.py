"""The pipeline's stages on small tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    at = str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9)))
    text = lambda n=200: (" ".join(word() for _ in range(n)) + ".").capitalize()
    rows = [(i, text(), "en", f"src{i % 4}") for i in range(160)]
    rows += [(200 + i, rows[i][1], "en", "src0") for i in range(20)]  # exact copies
    words = [r[1].split() for r in rows[:20]]
    rows += [(300 + i, " ".join([*w[:50], "changed", *w[51:]]), "en", "src1") for i, w in enumerate(words)]  # near copies
    rows += [(400 + i, " ".join(word().upper() + "!!" for _ in range(150)), "en", "src2") for i in range(40)]  # bad
    rows += [(500, None, None, None), (501, "", "en", None), (0, rows[0][1], "en", "src0")]
    spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i < 400), 0) for i, *_ in rows[:160] + rows[200:240]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == names
    ids = {n: set(x.doc_id) for n, x in seen.items()}
    assert not ids["quality_classifier"] & set(range(400, 440)) and set(range(160)) <= ids["quality_classifier"]
    assert not ids["exact_dedup"] & set(range(200, 220)) and set(range(160)) <= ids["exact_dedup"] and (seen["exact_dedup"].doc_id == 0).sum() == 1
    assert len(ids["simhash_near_dedup"] & set(range(300, 320))) <= 1 and set(range(160)) <= ids["simhash_near_dedup"]
    assert ids["packing"] == ids["mix_sources"]
    assert seen["packing"].length.sum() >= seen["mix_sources"].text.fillna("").str.split().str.len().sum()


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups_of(rows, alike):
    """Rows in groups that hang together by ``alike``."""
    groups = []
    for row in rows:
        near = [g for g in groups if any(alike(row, other) for other in g)]
        groups = [g for g in groups if g not in near] + [[row, *(x for g in near for x in g)]]
    return groups


def test_stages_by_brute_force(spark, folder):
    """Every stage's result from its own input, made again by comparing all with all."""
    from lodestack.llm import mixing, packing, quality

    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), {}
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        rows[name] = docs.collect()
    facts = lambda found: sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.source or "") for r in found)

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {(r.doc_id, r.score >= 0.5) for r in quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    assert facts(rows["quality_classifier"]) == facts([r for r in inputs["quality_classifier"] if (r.doc_id, True) in good])

    by_text = {}
    for r in inputs["exact_dedup"]:
        by_text.setdefault(r.text or "", []).append(r)
    assert facts(rows["exact_dedup"]) == facts([min(g, key=lambda r: r.doc_id) for g in by_text.values()])

    sets = {(r.doc_id, r.text): shingles(r.text) for r in inputs["simhash_near_dedup"]}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    near = groups_of(inputs["simhash_near_dedup"], lambda x, y: jaccard(sets[x.doc_id, x.text], sets[y.doc_id, y.text]) >= 0.8)
    assert facts(rows["simhash_near_dedup"]) == facts([min(g, key=lambda r: r.doc_id) for g in near])

    size = lambda r: len((r.text or "").split())
    own, taken, copies = Counter(), Counter(), Counter(r.doc_id for r in rows["mix_sources"])
    for r in inputs["mix_sources"]:
        own[r.source] += size(r)
        taken[r.source] += size(r) * copies[r.doc_id]
    order = [*sorted(s for s in own if s is not None), *([None] if None in own else [])]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, float(sum(own.values()))  # the share of weight 1 that meets all words, by bisection
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(3 * own[s], middle * weight[s]) for s in own) < sum(own.values()) else (low, middle)
    for s in own:
        target = min(3 * own[s], high * weight[s])
        passes = min(3, int(target // own[s])) if own[s] else 0
        sums = 1
        for r in inputs["mix_sources"]:
            sums |= sums << size(r) if r.source == s else 0
        budget = round(target) - passes * own[s] if passes < 3 else 0
        nearest = min((x for x in range(sums.bit_length()) if sums >> x & 1), key=lambda x: abs(x - budget))
        assert abs(taken[s] - passes * own[s] - budget) == abs(nearest - budget)

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in inputs["packing"]:
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        for a in range(0, len(ids), 4 * 4096):
            want[r.doc_id, a // 4, zlib.crc32(ids[a : a + 4 * 4096]), len(ids) // 4] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in rows["packing"]) == want
    places = {}
    for r in rows["packing"]:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_near_duplicates_come_through_fingerprints(spark, folder, monkeypatch):
    """Without the join by shingles, SimHash with pivot tables still finds the near copies within its reach."""
    from lodestack.llm import simhash

    calls, pivots = [], simhash.pivot_tables
    monkeypatch.setattr(simhash, "pivot_tables", lambda *args: calls.append(args) or pivots(*args))
    monkeypatch.setattr(simhash, "shingle_links", lambda *args: spark.createDataFrame([], "a long, b long"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 200 or doc_id between 300 and 319")
    copy_of = {r.doc_id: r.doc_id - 300 for r in docs.where("doc_id >= 300").collect()}
    fps = {r.doc_id: int(simhash.fingerprint(r.text)[0]) & (1 << 64) - 1 for r in docs.collect()}
    within = {i for i, j in copy_of.items() if (fps[i] ^ fps[j]).bit_count() <= 3}
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs.dropDuplicates(["doc_id"]), folder).collect()}
    assert calls and within and kept == set(fps) - within


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and len(got)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
