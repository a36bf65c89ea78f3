"""The pipeline, stage by stage and as a whole, against brute force: clean texts, a toxic group, near copies, repeated lines, nulls."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm.mixing import BLOCK_WORDS
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.simhash import fingerprint
from tidemark.llm.toxicity import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __taken int"


def planted():
    rng = random.Random(11)
    clean, bad = [f"w{i}" for i in range(400)], ["vileslur", "hatefulcurse"]
    line = lambda: " ".join(rng.choices(clean, k=rng.randint(6, 12)))
    boilerplate = [line() for _ in range(4)]
    texts = ["\n".join(line() for _ in range(rng.randint(1, 8))) for _ in range(160)]
    toxic = {i for i in range(0, 160, 4)}
    texts = [t if i not in toxic else " ".join(w if rng.random() > 0.2 else rng.choice(bad) for w in t.split()) for i, t in enumerate(texts)]
    for i in range(1, 160, 10):
        texts[i] += "\n" + "\n".join(boilerplate)
    long = "\n".join(line() for _ in range(300))
    texts += [long, long, long + " tail", None, "", " \n ", texts[3], texts[3]]
    rows = [(i, t, "en", [None, "web", "books"][i % 3], None if t is None else len(t), 1) for i, t in enumerate(texts)]
    return [*rows, (None, "no id at all", "en", "web", 12, 1), (5, texts[5], "en", "books", len(texts[5]), 1)], toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    rows, toxic = planted()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def without_lines(texts):
    """Texts in their order, freed of lines in a run of three that started earlier."""
    seen, out = set(), []
    for text in texts:
        lines, gone = [] if text is None else text.split("\n"), set()
        for s in range(len(lines) - 2):
            key = tuple(lines[s : s + 3])
            if key in seen:
                gone |= {s, s + 1, s + 2}
            seen.add(key)
        out.append(None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


def order(row):
    return (row.doc_id is None, row.doc_id or 0)


def kept_ids(rows):
    """The smallest id of each component of fingerprints at most 3 bits apart."""
    rows = [r for r in rows if r.doc_id is not None]
    prints, parent = [fingerprint((r.text or "").encode()) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(r.doc_id, least.get(root(i), r.doc_id))
    return sorted(least.values())


def test_every_stage(spark, folder):
    from tokenizers import Tokenizer

    rows, toxic = planted()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "source mixing", "packing"]
    steps = {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, folder), "test-stage")
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__taken"]
        steps[name] = docs.collect()

    clean = steps["toxicity"]
    gone = {r[0] for r in rows} - {r.doc_id for r in clean}
    scored = {r.doc_id for r in toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert gone == scored - {None} and len(gone & toxic) >= 0.9 * len(toxic) and not gone - toxic

    lines, one_each = steps["line dedup"], sorted({(r.doc_id, r.text) for r in clean}, key=lambda r: (r[0] is None, r[0] or 0))
    expected = dict(zip((i for i, _ in one_each), without_lines([t for _, t in one_each]), strict=True))
    assert Counter(r.doc_id for r in lines) == Counter(r.doc_id for r in clean) and all(r.text == expected[r.doc_id] for r in lines)

    single = steps["simhash near-dedup"]
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == kept_ids(lines) and sum(r.doc_id is None for r in single) == 1
    assert all(r.text == expected[r.doc_id] for r in single)

    mixed, size, target = steps["source mixing"], Counter(), {}
    for r in single:
        size[r.source] += len(WORD.findall(r.text or ""))
    weight, capped = {s: w for s, w in zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=True)}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        target = {s: 2 * size[s] if s in capped else left * w / sum(v for u, v in weight.items() if u not in capped) for s, w in weight.items()}
        over = {s for s in target if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in mixed:
        words, whole = WORD.findall(r.text), WORD.findall(expected[r.doc_id])
        assert words and words == whole[: len(words)]
        taken[r.source] += len(words)
    assert all(abs(taken[s] - target[s]) <= BLOCK_WORDS for s in target) and max(Counter(r.doc_id for r in mixed).values()) <= 2

    tokenizer, packed = Tokenizer.from_file(tokenizer_path()), steps["packing"]
    ids = [[*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in mixed]
    wanted = Counter()
    for r, own in zip(mixed, ids, strict=True):
        first, at = len(own) % 1024 or min(len(own), 1024), 0
        cuts = [first] + [1024] * ((len(own) - first) // 1024)
        for n in cuts:
            wanted[r.doc_id, n, zlib.crc32(np.array(own[at : at + n], "<u4").tobytes())] += 1
            at += n
    whole = sum(wanted.values())
    assert sum(r.length for r in packed) == sum(map(len, ids)) and len(packed) == whole
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert {(r.doc_id, r.length, r.ids_crc32) for r in packed} == set(wanted)

    result = P.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in result.collect()) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_the_operators_own(spark, folder):
    from tidemark.llm.line_dedup import line_dedup

    names = ["__d", "__h", "__rd", "__rh", "__n_lines", "__runs", "__kept_id", "__rows", "__toxic_id", "__doc", "__source", "__hash", "__size", "__same", "__turn", "__c0", "a`b", "x.y"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 12")
    docs = docs.select("*", *(F.lit(n).alias(n) for n in names))
    for _, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, folder), "test-clash")
        assert all(r[n] == n for r in docs.collect() for n in names) and docs.columns[-len(names) :] == names
    out = line_dedup(docs)
    assert out.columns == [c for c in docs.columns if c not in ("__n_lines", "__runs")] + ["__n_lines", "__runs"] and out.count() == docs.count()
