"""The pipeline's stages against the operators' brute-force rules on the smallest tables."""

from __future__ import annotations

import random
import re
from itertools import combinations

import corpus_pipeline as p
from factspark.llm import decontaminate
from factspark.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert seen[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[0] - ids[1]) > 0 and len(ids[1] - ids[2]) > 0
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in map(decontaminate.words_of, items) for i in range(max(1, len(w) - 9))}
    dirty = {r["doc_id"] for r in seen[3].collect() for w in [decontaminate.words_of(r["text"])] if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))}
    assert ids[3] - ids[4] == dirty
    texts = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    lines = [x for t in seen[2].select("text").collect() for x in (t[0] or "").split("\n") if len(x) >= 20]
    assert len(lines) == len(set(lines))
    shingles = {}
    for r in seen[3].collect():
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])) if x]
        key = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])
        assert key not in shingles or not w
        shingles[key] = r["doc_id"]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path())
    assert {r["doc_id"]: r["n_tokens"] for r in seen[5].collect()} == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_run(spark):
    out = p.run(spark, SF)
    assert {"doc_id", "n_tokens"} <= set(out.columns) and 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count() and p.ORACLE_SQL is None


def test_near_duplicates_from_80_percent(spark):
    """The stage against brute force, with planted pairs on both sides of 80 and of 85 percent."""
    rng = random.Random(5)
    texts, planted = [], []
    for changed in (1, 2, 3, 4, 5, 6):  # a changed word far from the others and the ends costs five shingles on either side
        for _ in range(3):
            w = [f"t{rng.randrange(10**6)}" for _ in range(164)]
            x = list(w)
            for k in range(changed):
                x[10 + 25 * k] = f"e{rng.randrange(10**6)}"
            planted.append((len(texts), len(texts) + 1))
            texts += [" ".join(w), " ".join(x)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(len(texts)), 2)}
    assert all(sum(low <= alike[x] < high for x in planted) >= 3 for low, high in ((0.6, 0.8), (0.8, 0.85), (0.85, 1)))
    kept = set(range(len(texts))) - {b for (_, b), s in alike.items() if s >= 0.8}
    out = p.drop_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF)
    assert {r["doc_id"] for r in out.collect()} == kept


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, component_id long"


def edge_rows():
    """Null and empty texts, null and repeated ids, ties, a very long text, and columns whose names the operators use."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"word{rng.randrange(4000)}" for _ in range(n))
    same = prose(60)
    texts = [(1, None), (2, ""), (3, same), (4, same), (4, same), (4, prose(30)), (None, prose(40)), (None, None), (7, prose(60_000)), (8, "a line of text that repeats\n" * 3 + prose(20)), (9, "a line of text that repeats\n" + prose(25))]
    return [(i, t, "en", "s", len(t or ""), f"m{k}", k) for k, (i, t) in enumerate(texts)]


def test_stages_on_edge_rows(spark):
    """Each stage by itself: rows with nulls stay unless its rule says otherwise, other columns are untouched, and an empty table gives an empty one."""
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "bpe_encoding":
            assert len(rows) == docs.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
            continue
        assert out.columns == docs.columns
        given = {r["mark"]: r for r in docs.collect()}
        assert all((r["doc_id"], r["lang"], r["component_id"]) == (given[r["mark"]]["doc_id"], given[r["mark"]]["lang"], given[r["mark"]]["component_id"]) for r in rows)
        kept = {r["mark"]: r["text"] for r in rows}
        if name == "line_dedup":
            assert kept.keys() == {f"m{k}" for k in range(11)} - {"m3", "m4"} and kept["m9"].count("a line of text") == 1 and "a line" not in kept["m10"] and kept["m0"] is None and kept["m6"] == given["m6"]["text"]
            assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
        elif name == "minhash_near_dedup":
            assert {"m0", "m1", "m2", "m7", "m8"} <= kept.keys() and "m3" not in kept
        elif name == "benchmark_decontamination":
            assert kept.keys() == given.keys()


def test_decontamination_without_items(spark, tmp_path):
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.drop_contaminated(spark, spark.createDataFrame(edge_rows(), SCHEMA), str(tmp_path)).count() == 11


def test_run_deletes_what_it_wrote(spark):
    from pathlib import Path

    from factspark.llm.common import shared_dir

    before = {x.name for x in Path(shared_dir(spark)).iterdir()}
    rows = p.run(spark, SF).count()
    left = {x.name.split("-")[0] for x in Path(shared_dir(spark)).iterdir() if x.name not in before}
    assert rows and left <= {"pipeline", "step"}
