"""Every operator against a brute-force version on small tables with nulls, empty and blank texts, ties, repeats and extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import ann, exact_dedup, hmm, line_dedup, mixing, packing, simhash, substring_dedup, toxicity
from tidemark.llm.chat import rotate
from tidemark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, h string, bits int"


def corpus():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "e", "zeta x"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    shared = "\n".join(line() for _ in range(8))
    texts = [None, "", " \t\n", "one", shared, shared + "\n" + line(), line() + "\n" + shared.replace("alpha", "omega", 1), shared.replace(" ", "  "), "same " * 60, line() + "\r\n" + line() + " <|endoftext|>", "\n".join(line() for _ in range(400))]
    texts += ["\n".join(line() for _ in range(rng.randint(1, 12))) for _ in range(25)]
    texts += [shared] * 4
    return [(i * 3 % 101, t, "en", [None, "a", "b", "c"][i % 4], None, 1, "x", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact(docs, empty):
    normal = {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in corpus()}
    out = by_id(exact_dedup.exact_dedup(docs))
    assert len(out) == len(normal)
    for i, t in normal.items():
        same = [j for j, u in normal.items() if u == t]
        assert tuple(out[i]) == (i, min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_fingerprints_compose():
    poly, data = exact_dedup.Polynomial(), bytes(range(256)) * 700
    whole = poly.text(data)
    assert whole == poly.combine(poly.text(data[:65536]), poly.text(data[65536:]), len(data) - 65536)
    assert whole != poly.text(data[:-1] + b"\0")


def test_substrings(docs, empty):
    seen, expected = set(), {}
    for i, text, *_ in sorted(corpus(), key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone |= set(range(s, s + 20))
            seen.add(key)
        expected[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    out = by_id(substring_dedup.substring_dedup(docs))
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in out.items()} == expected
    assert substring_dedup.substring_dedup(empty).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    prints = {r[0]: brute_print(r[1]) for r in corpus()}
    label = {i: i for i in prints}
    for _ in prints:
        for i, j in itertools.combinations(prints, 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[i] = label[j] = min(label[i], label[j])
    out = by_id(simhash.near_dedup(docs))
    assert {i: (r.bits % (1 << 64), r.component_id) for i, r in out.items()} == {i: (prints[i], label[i]) for i in prints}
    assert simhash.near_dedup(empty).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(i for i in label if label[i] == i)


def test_one_row_of_copies_without_ids_stays(spark):
    with_id, own, alike = "a text with an id", "a text without one", "x y z " * 40
    rows = [(4, with_id), (None, with_id), (None, with_id), (None, own), (None, own), (None, None), (None, ""), (None, alike), (None, alike.upper())]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.text for r in out if r.doc_id is not None] == [with_id]
    assert sorted(brute_print(r.text) for r in out if r.doc_id is None) == sorted(map(brute_print, (own, "", alike)))


@pytest.mark.parametrize("parts", [1, 5])
def test_shards_find_all_links(parts):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    values = np.unique(np.concatenate([values, values[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200, dtype=np.uint64)), values[:90] ^ np.uint64(7)]))
    tree, found = simhash.top_tree(values, parts), set()
    index, shard, home = simhash.deal(tree, values, 3)
    for s in set(shard.tolist()):
        own = index[shard == s]
        a, b = simhash.shard_links(values[own], home[shard == s], 3)
        found |= set(zip(own[a].tolist(), own[b].tolist(), strict=True))
    group = list(range(len(values)))
    for _ in range(8):
        for a, b in found:
            group[a] = group[b] = min(group[a], group[b])
    links = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
    assert all(group[a] == group[b] for a, b in links)


def test_lines(docs, empty):
    seen, expected = set(), {}
    for i, text, *_ in sorted(corpus(), key=lambda r: r[0]):
        lines, gone = (text.split("\n") if text is not None else []), set()
        for s in range(len(lines) - 2):
            key = tuple(lines[s : s + 3])
            if key in seen:
                gone |= {s, s + 1, s + 2}
            seen.add(key)
        expected[i] = None if text is None else "\n".join(x for j, x in enumerate(lines) if j not in gone)
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()} == expected
    assert line_dedup.without_repeats(empty).columns == empty.columns and line_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("min_lines, min_words", [(3, 50), (5, 12), (4, None)])
def test_short_runs_of_many_words(spark, min_lines, min_words):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, below, two = words(64), words(49), words(30) + "\n" + words(20)
    shared = [words(n) for n in (1, 2, 3, 4, 5, 50)]
    texts = [words(5) + "\n" + passage, below, two, passage, words(5) + "\n" + two + "\n" + words(5), below, f"{passage}\n{below}\n{passage}"]
    texts += ["\n".join(rng.choices(shared, k=rng.randint(1, 9))) for _ in range(40)]
    seen, expected = set(), {}
    for i, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for n in range(1, min_lines + 1):
            for s in range(len(lines) - n + 1):
                key = tuple(lines[s : s + n])
                if key in seen and (n == min_lines or min_words is not None and len(" ".join(key).split()) >= min_words):
                    gone |= set(range(s, s + n))
                seen.add(key)
        expected[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(rows, min_lines, min_words).collect()} == expected
    if (min_lines, min_words) == (line_dedup.MIN_LINES, line_dedup.MIN_WORDS):
        assert expected[3] == "" and expected[5] == below and expected[4].count("\n") == 1 and expected[6] == below
        assert {r.doc_id: r.text for r in line_dedup.without_repeats(rows).collect()} == expected


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    assert {r.doc_id: r["size"] for r in rows} == sizes and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    per, target, taken = Counter(), {}, Counter()
    for r in rows:
        per[r.source] += r["size"]
        target[r.source], taken[r.source] = r.target, taken[r.source] + r.taken
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        left = 1.5 * sum(per.values()) - sum(2 * per[s] for s in capped)
        shares = {s: 2 * per[s] if s in capped else left * weight[s] / sum(w for u, w in weight.items() if u not in capped) for s in order}
        over = {s for s in order if shares[s] > 2 * per[s] and s not in capped}
        if not over:
            break
        capped |= over
    assert all(abs(shares[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in order)
    assert sorted(tuple(map(str, r)) for r in rows) == sorted(tuple(map(str, r)) for r in mixing.mix(docs).collect())
    mixed = Counter()
    for r in mixing.apply_mix(docs).collect():
        mixed[r.doc_id] += len(WORD.findall(r.text))
    assert mixed == Counter({r.doc_id: r.taken for r in rows if r.taken})
    assert mixing.mix(empty).count() == 0


def test_mixing_of_small_sources(spark):
    rows = [(i, " ".join(["w"] * (10 + i % 7)), f"s{i:03}") for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.taken > 0 and abs(r.taken - r.target) <= 1 for r in out)
    assert abs(sum(r.taken for r in out) - 1.5 * sum(r["size"] for r in out)) <= 1


def test_sainte_lague_gives_the_highest_quotients(spark):
    shares = {"a": 1000.0, "b": 400.0, "c": 3.0, "d": 2.0, "e": 2.0, "f": 2.0, "g": 0.0}
    for seats in (1, 3, 7, 10, 23, 400):
        won = Counter(dict.fromkeys(shares, 0))
        for _ in range(seats):
            won[max(shares, key=lambda s: (shares[s] / (2 * won[s] + 1), -ord(s)))] += 1
        rows = spark.createDataFrame([(s, x, seats) for s, x in shares.items()], "s string, x double, n int")
        assert {r.s: r.quota for r in mixing.sainte_lague(rows, [], "x", mixing.F.col("n"), [mixing.F.col("s")]).collect()} == dict(won)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in corpus()}
    rows = packing.pack(docs, tokenizer_path()).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in pieces.items():
        lengths = [x[2] for x in sorted(own)]
        assert sum(lengths) == len(ids[i]) and all(n == 1024 for n in lengths[1:]) and (len(ids[i]) > 1024 or len(lengths) == 1)
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(pieces) == len(ids) and len(sequences) <= -(-sum(map(len, ids.values())) // 1024) + 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_local_search_empties_bins():
    plan = packing.local_search(Counter({(6, 2): 1, (5, 3): 1, (4, 4): 1, (6,): 1}), 10)
    assert sum(plan.values()) == 3 and sorted(x for p, n in plan.items() for x in p * n) == [2, 3, 4, 4, 5, 6, 6]


def test_toxicity(spark):
    rng = random.Random(5)
    clean, bad = ["river", "stone", "cloud", "green", "music"], ["nastyword", "uglyterm"]
    rows = [(i, " ".join(rng.choices(clean, k=30) + (rng.choices(bad, k=2) if i % 4 == 0 else [])), "x") for i in range(300)] + [(1000, None, "x"), (1001, "", "x"), (None, "stone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert len(out) == len(rows) and held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()} >= {1000, 1001, None}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and all(r.score < 1e-6 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((600, 16))
    base[100] = base[200] = base[50]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, []), (900, [1.0, 2.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 50 == 0).collect()
    data = base.astype(np.float32).astype(float)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        score = unit @ unit[q]
        score[q] = -2
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [x[0] for x in got] == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-9 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 0.9 * 60 and [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == 50][:2] == [100, 200]


def test_language_model(docs, empty):
    tokens = {r[0]: [*(r[1] or "").encode().lower().split(), None] for r in corpus()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, x in tokens.items() if not held[i] for t in x)
    n, v = sum(counts.values()), len(counts)
    for i, r in by_id(hmm.score_documents(docs, passes=2)).items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(counts[t] > 0 for t in tokens[i]), n)
        assert abs(r.base_score - sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens[i])) < 1e-6 and r.score < 0
    assert hmm.score_documents(empty).count() == 0


@pytest.mark.parametrize("size", [2, 3, 100])
def test_forward_recursion_is_exact_and_training_counts_whole_sequences(size):
    rng = np.random.default_rng(4)
    model = hmm.Model.initial(np.full(5, 0.2), states=2)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 7, 2)]
    lengths, flat = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    got, counts = model.log10_likelihood(flat, lengths, size), model.expected(flat, lengths, size)
    starts, moves, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    for s, x in zip(seqs, got, strict=True):
        weight = {p: model.start[p[0]] * np.prod([model.emit[o, z] for o, z in zip(s, p, strict=True)]) * np.prod([model.move[a, b] for a, b in zip(p, p[1:], strict=False)]) for p in itertools.product(range(2), repeat=len(s))}
        total = sum(weight.values())
        assert abs(np.log10(total) - x) < 1e-12
        for p, w in weight.items():
            starts[p[0]] += w / total
            for o, z in zip(s, p, strict=True):
                emissions[o, z] += w / total
            for a, b in zip(p, p[1:], strict=False):
                moves[a, b] += w / total
    assert all(np.allclose(a, b, atol=1e-10) for a, b in zip(counts, (starts, moves, emissions), strict=True))


def test_score_against_plain_recursion(docs):
    """Every word of the small corpus has a class of its own, so that a word's probability in a state is its class's emission."""
    made = hmm.sequences(hmm.blocks_of(docs.select("doc_id", "text")))
    model, inside, everything, distinct, train_docs = hmm.fit(made, 2)
    classes = {r.doc_id: np.frombuffer(hmm.zstandard.ZstdDecompressor().decompress(bytes(r.classes)), "<u2").tolist() for r in made.where("train_docs is null").collect()}
    out, texts = by_id(hmm.score_documents(docs, passes=2)), {r[0]: r[1] for r in corpus()}
    tokens = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    counts = Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    for i, words in tokens.items():
        kinds, message, score = [*classes[i], hmm.END], model.start, 0.0
        for at, kind in enumerate(kinds):
            count = train_docs if kind == hmm.END else counts[words[at]]
            message = (message @ model.move if at else message) * model.emit[kind] * (count + 1) / 10 ** inside[kind]
            score += np.log10(message.sum())
            message = message / message.sum()
        assert abs(score - out[i].score) < 1e-8


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 300, "cy", "so"), (1, None, None, "end"), (2, 0, "ann", "x"), (None, 0, "bob", "y")]
    out = rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    views = {}
    for r in sorted(out, key=lambda r: r.position):
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    assert {k: len(x) for k, x in views.items()} == {(1, "ann"): 4, (1, "bob"): 4, (1, "cy"): 4, (2, "ann"): 1, (None, "bob"): 1}
    for (_, who), own in views.items():
        whole = "".join(r.rendered for r in own)
        for r in own:
            assert whole[r.start :].startswith(r.rendered) and (r.mask_start is not None) == (r.role == "assistant") == (r.speaker == who)
            if r.mask_start is not None:
                assert whole[r.mask_start : r.mask_end].endswith("<|im_end|>")
