"""All operators and stages on rows that share an id, come several times or have none, and on very long texts, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, exact_dedup, hmm, line_dedup, mixing, packing, simhash, substring_dedup, toxicity
from tidemark.llm.chat import rotate
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, rank int, n long, place double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def rows_of():
    rng = random.Random(21)
    line = lambda n=9: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(2, n)))
    run3, run5, run40 = ([line() for _ in range(n)] for n in (3, 5, 40))
    block = "\n".join(run40)
    rows = [(5, "aaa bbb"), (5, "zzz yyy"), (7, "aaa bbb"), (9, "zzz yyy"), (7, "aaa bbb"), (None, "aaa bbb"), (None, "alone " * 30), (None, "alone " * 30), (None, None), (11, None), (11, ""), (LAST, block), (None, block)]
    rows += [(20 + i, "\n".join([line(), *run, line()])) for i, run in enumerate([run3, run5, run40, run3, run5, run40, run5 + run3, run40 + run3])]
    rows += [(3, block), (3, block), (3, "other\n" + block), (30, "\n".join(line() for _ in range(30)))]
    long = "\n".join(line(12) for _ in range(20_000))  # about a megabyte
    rows += [(40, long), (41, long + "\ntail"), (42, "same\n" * 3000), (43, "x" * 300_000 + " " + "y " * 1000)]
    return [(i, t, "abc"[n % 3], n, n, 0.5) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


def in_order():
    """Distinct documents as the operators order them: by id, null last, then by the text's hash (signed, seed 42, null 42)."""
    key = lambda t: 42 if t is None else np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64).item()
    return sorted({(i, t) for i, t, *_ in rows_of()}, key=lambda r: (LAST if r[0] is None else r[0], key(r[1])))


def test_exact(docs, monkeypatch):
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows_of()]
    expected = Counter()
    for i, t in normal:
        same = [j for j, u in normal if u == t]
        keep = min((j for j in same if j is not None), default=None)
        expected[i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == expected
    monkeypatch.setattr(exact_dedup.Polynomial, "text", lambda self, data: (len(data) % 3, 1))  # all texts of a length collide
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == expected


def test_substrings(docs):
    seen, expected = set(), {}
    for i, text in in_order():
        words, gone = WORD.findall(text or ""), set()
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        expected[i, hashlib.sha256(kept.encode()).hexdigest(), len(words), len(gone)] = sorted(gone)
    out = substring_dedup.substring_dedup(docs).collect()
    assert len(out) == docs.count() and {(r.doc_id, r.kept_sha256, r.n_words, r.n_removed) for r in out} == set(expected)
    assert all([j for s in r.spans for j in range(s.start, s.end)] == expected[r.doc_id, r.kept_sha256, r.n_words, r.n_removed] for r in out)


def test_lines(docs):
    seen, expected = set(), set()
    for i, text in in_order():
        lines, gone = [] if text is None else text.split("\n"), set()
        for n, s in itertools.product((1, 2, 3), range(len(lines))):
            key = tuple(lines[s : s + n])
            if len(key) == n:
                if key in seen and (n == 3 or len(WORD.findall(" ".join(key))) >= 50):
                    gone.update(range(s, s + n))
                seen.add(key)
        runs = [(g[0][1], g[-1][1]) for g in (list(x) for _, x in itertools.groupby(enumerate(sorted(gone)), lambda p: p[1] - p[0]))]
        expected.add((i, None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in gone), tuple(runs)))
    out = line_dedup.line_dedup(docs).collect()
    assert len(out) == docs.count()
    assert {(r.doc_id, r.text, tuple((x.first, x.last) for x in r["__runs"] or [])) for r in out} == expected


def test_suffix_array_of_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RANGE_ROWS", 7)  # many ranges
    rng = random.Random(2)
    texts = [rng.choices("abcd", k=rng.randint(1, 60)) for _ in range(12)]
    keyed = line_dedup._keyed(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    ids = {r.line: (r.a, r.b) for r in spark.createDataFrame([(c,) for c in "abcd"], "line string").select("line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).collect()}
    rounds = []
    for m, table in line_dedup.intervals(keyed, min_lines=3, min_words=None):
        windows = {(d, i): tuple(ids[x] for x in t[i : i + m]) for d, t in enumerate(texts) for i in range(len(t) - m + 1)}
        times = Counter(windows.values())
        held = {p: w for p, w in windows.items() if times[w] > 1}
        got = {(r.d, r.i): (r["rank"], r.n, (r["first"].d, r["first"].i)) for r in table.collect()}
        assert got == {p: (sum(v < w for v in held.values()), times[w], min(q for q, v in held.items() if v == w)) for p, w in held.items()}
        rounds.append(m)
    assert rounds[:4] == [1, 2, 3, 6]


def fingerprint_of(text):
    return simhash.fingerprint((text or "").encode())


def test_near_copies(docs):
    rows = [(i, t, fingerprint_of(t)) for i, t, *_ in rows_of()]
    prints = sorted({p for *_, p in rows})
    label = {p: p for p in prints}
    for _ in prints:
        for a, b in itertools.combinations(prints, 2):
            if (a ^ b).bit_count() <= 3:
                label[a] = label[b] = min(label[a], label[b])
    least = {}
    for i, _, p in rows:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], LAST))
    out = simhash.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.bits % (1 << 64), r.component_id) for r in out) == Counter((i, p, least.get(label[p])) for i, _, p in rows)
    kept = simhash.keep_one(docs).collect()
    assert sorted(label[fingerprint_of(r.text)] for r in kept) == sorted(set(label.values()))  # one of each component
    assert all(r.doc_id == least.get(label[fingerprint_of(r.text)]) for r in kept)
    assert {"aaa bbb", "zzz yyy"} <= {r.text for r in kept}


def test_shards_that_outgrow_get_trees(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 3000, dtype=np.int64)
    values = np.unique(np.concatenate([base, base[:1500] ^ 1, base[:700] ^ 6]))
    monkeypatch.setattr(simhash, "FANOUT", 4)
    classes = spark.createDataFrame([(int(v), 0) for v in values], "bits long, rep long")
    tables = simhash.sharded(classes, 3, 50)
    held = [(n, r.shard, r.bits, r.home) for n, t in enumerate(tables) for r in t.collect()]
    assert len(tables) > 2 and max(Counter(x[:2] for x in held).values()) < len(values) / 4
    assert sorted(v for *_, v, home in held if home)[:1] and {v for _, _, v, _ in held} == set(values.tolist())
    group = {v: v for v in values.tolist()}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    shards = {}
    for n, shard, v, home in held:
        shards.setdefault((n, shard), []).append((v, home))
    for own in shards.values():
        bits, home = np.array([v for v, _ in own]), np.array([h for _, h in own])
        for a, b in zip(*simhash.shard_links(bits.view(np.uint64), home, 3), strict=True):
            group[root(int(bits[a]))] = root(int(bits[b]))
    unsigned = values.view(np.uint64)
    assert all(root(int(values[a])) == root(int(values[b])) for a, b in np.argwhere(np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 3))


def test_mixing(docs):
    out = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows_of())
    taken, target = Counter(), {r.source: r.target for r in out}
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in target)
    words = Counter()
    for r in mixing.apply_mix(docs).collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == taken


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected, out = Counter(), packing.pack(docs, tokenizer_path()).collect()
    for i, t, *_ in rows_of():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or min(len(ids), 1024), len(ids), 1024), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_toxicity_judges_rows(spark):
    rng = random.Random(5)
    text = lambda bad: " ".join(rng.choices(["river", "stone", "cloud", "green"], k=30) + ["nastyword"] * (4 * bad))
    rows = [(i, text(i % 4 == 0), i) for i in range(200)] + [(1001, text(True), 0), (1001, text(False), 1), (None, text(True), 2), (None, text(False), 3), (1002, None, 4), (1002, "stone " * 400_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] * 2, "doc_id long, toxic int")
    out = {(r.doc_id, r.predicted) for r in toxicity.toxicity(docs, labels).collect()}
    assert {(1001, 0), (1001, 1), (None, 0), (None, 1), (1002, 0)} <= out
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    own = kept.where("doc_id is null or doc_id > 200").collect()
    assert len(own) == 4 and not any(r.text and "nasty" in r.text for r in own)


def test_language_model(docs, spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 2_000)
    texts = [(i, (t or "").encode().lower().split()) for i, t, *_ in rows_of()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, x in texts if not held(i) for w in x) + Counter({None: sum(not held(i) for i, _ in texts)})
    n, v = sum(counts.values()), len(counts)
    blocks = hmm.blocks_of(docs.select("doc_id", "text"))
    assert blocks.where("words is not null").count() > 5  # rows without an id are dealt like any other
    out = hmm.score_documents(docs, passes=1).collect()
    expected = Counter((i, held(i), len(x) + 1, sum(counts[w] > 0 for w in [*x, None]), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*x, None]), 4)) for i, x in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == expected
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 12))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)]
    rows += [(50, base[50].tolist(), "x"), (100, base[7].tolist(), "x"), (None, base[3].tolist(), "x"), (350, (base[350] * 1e200).tolist(), "x"), (500, (base[20] * 1e-200).tolist(), "x"), (501, (base[500 - 300] * 1e250).tolist(), "x"), (550, [1.0] * 5, "x"), (551, [1.0] * 4 + [2.0], "x"), (600, [5e-324] + [0.0] * 11, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    out = ann.nearest(table, F.col("vec_id") % 50 == 0, shard_rows=90).collect()
    data = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None})
    scaled = lambda v: np.array(v) / np.abs(v).max()
    cosine = lambda a, b: scaled(a) @ scaled(b) / np.linalg.norm(scaled(a)) / np.linalg.norm(scaled(b))
    expected, hits = Counter(), 0
    for i, v in data:
        if i % 50 == 0:
            near = sorted((-cosine(v, u), j) for j, u in data if j != i and len(u) == len(v))[:5]
            expected.update((i, j) for _, j in near)
    hits = sum((Counter((r.query_id, r.vec_id) for r in out) & expected).values())
    assert len(out) == sum(expected.values()) and hits >= 0.9 * len(out) and all(-1 <= r.score <= 1 for r in out)
    assert Counter(r["rank"] for r in out if r.query_id == 100) == Counter({1: 2, 2: 2, 3: 2, 4: 2, 5: 2})  # two vectors, two queries
    assert [(r.vec_id, r.score) for r in out if r.query_id == 550] == [(551, pytest.approx(cosine([1] * 5, [1] * 4 + [2])))]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_over_shards_and_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4000, 16)).astype(np.float32).astype(float)
    base[1000:2300] = base[7]  # a third of the rows are one vector
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    out = ann.nearest(table, F.col("vec_id") % 20 == 0, shard_rows=1100).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    good = 0
    for q in range(0, 4000, 20):
        score = unit @ unit[q]
        score[q] = -2
        least = np.sort(score)[-5]
        good += sum(score[r.vec_id] >= least - 1e-12 for r in out if r.query_id == q)
    assert len(out) == 1000 and good >= 900
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 1000] == [7, 1001, 1002, 1003, 1004]


def test_perspectives(spark):
    kind = "conv_id long, turn long, role string, text string, block string, c string"
    rows = [(1, 0, "ann", "hi", "z", "z")] * 3 + [(1, 0, "bob", "x" * 2_000_000, "z", "z"), (1, 5, None, "", "z", "z"), (None, 1, "cy", None, "z", "z"), (2, None, None, "no one", "z", "z")]
    out = rotate(spark.createDataFrame(rows, kind)).collect()
    views = {}
    for r in sorted(out, key=lambda r: r.position):
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    assert {k: len(v) for k, v in views.items()} == {(1, "ann"): 5, (1, "bob"): 5, (None, "cy"): 1}
    for own in views.values():
        ends = list(itertools.accumulate(len(r.rendered) for r in own))
        assert [r.start for r in own] == [0, *ends[:-1]] and [r.position for r in own] == list(range(len(own)))
    assert rotate(spark.createDataFrame([], kind)).count() == 0
