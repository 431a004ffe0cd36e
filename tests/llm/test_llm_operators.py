"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as pyspark_functions

from orefield.llm import html_text, knn_join, language_id, language_model, mixing, ngram_join, packing, prefix_sums, quality, textnum
from orefield.llm.components import components
from orefield.llm.exact_dedup import exact_dedup, keep_first
from orefield.llm.ngram_join import keep_one_of_each, ngram_jaccard_join
from orefield.llm.queries import piece_file, tokenizer_files
from orefield.llm.shared import cut
from orefield.llm.sharding import balanced_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, size long, n long"
WORDS = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "Éta", "theta", "iota", "kappa", "la", "mu"]


def make(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, 3) for r in rows], SCHEMA)


def sample_rows():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one two", "en", "b"), (5, "ONE  two ", "en", "b"), (5, "ONE  two ", "en", "b"), (None, "no id here at all", "de", "c")]
    base = say(120).split()
    for i in range(40):
        text = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            text[rng.randrange(len(text))] = f"new{i}"
        rows.append((100 + i, " ".join(text), "en", "a"))
    rows += [(200 + i, say(rng.randrange(1, 90)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", None])) for i in range(40)]
    rows += [(300, "long" + say(9000), "de", "a"), (301, "x" * 70000, "de", "a"), (302, "a\x0bb\x0cc\rd", "de", "b")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, sample_rows()).cache()


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def test_exact_dedup(spark, docs):
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r)
    want = collections.Counter()
    for t, g in groups.items():
        best = min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        want.update((r.doc_id, best.doc_id, len(g), hashlib.sha256(t.encode()).hexdigest()) for r in g)
    for size in (64, 16384):
        found = exact_dedup(docs, block_bytes=size).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
        assert sum(r.kept for r in found) == len(groups)
        assert all(r.kept <= (r.doc_id == r.keep_id) for r in found)
    kept = keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup(docs.limit(0)).count() == 0


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = [shingles(r.text) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(root(i), []).append(r.doc_id)
    return [(r.doc_id, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, r in enumerate(rows)], len(least)


def test_ngram_join(spark, docs):
    rows = docs.collect()
    want, n = brute_components(rows)
    found = ngram_jaccard_join(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == collections.Counter(want)
    assert sum(r.keep for r in found) == n
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == n
    assert ngram_jaccard_join(docs.limit(0)).count() == 0


def test_ngram_join_with_shared_passages(spark):
    rng, passage = random.Random(5), [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 30))]
        rows.append((i, " ".join(passage + own if i % 2 else own + passage), "en", "a"))
    docs = make(spark, rows)
    want, _ = brute_components(docs.collect())
    found = ngram_jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(want)


def test_bitmaps_bound_overlap_from_above():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200)).astype(np.uint64))
        b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            size = min(ngram_join.width(len(a)), ngram_join.width(len(b))) // 8
            x, y = (ngram_join.fold(ngram_join.bitmap(s, ngram_join.width(len(s))), size) for s in (a, b))
            assert ngram_join.may_link(x, len(a), y[None], np.array([len(b)]), 80)[0]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_know_equal_words():
    texts = ["Hello  hello\tHELLO x", "", "x hello"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    value, row = textnum.words(data, offsets)
    assert row.tolist() == [0, 0, 0, 0, 2, 2] and len(set(value.tolist())) == 2 and value[3] == value[4]


def test_sharding(spark, docs):
    rows = balanced_shards(docs, 4).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    shards = collections.defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    assert balanced_shards(docs.limit(0)).count() == 0
    even = make(spark, [(i, f"text {i}", "en", "a") for i in range(4000)])
    sizes = collections.Counter()
    for r in balanced_shards(even).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_sharding_against_loops(spark, docs):
    rows = [(hashlib.md5((r.text or "").encode()).hexdigest(), r.doc_id is not None, r.doc_id or 0, r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect()]
    more = [(3000 + i, "same words here", "en", "a") for i in range(3)] + [(4000 + i, f"filler {i} " * 40, "en", "a") for i in range(200)]
    rows = sorted(rows + [(hashlib.md5(t.encode()).hexdigest(), True, i, i, len(t) + 1) for i, t, *_ in more])
    total, groups, at = sum(r[4] for r in rows), collections.defaultdict(list), 0
    for r in rows:
        groups[r[0]].append((at, r[4]))
        at += r[4]
    at, want = 0, collections.Counter()
    for key, _, _, doc_id, size in rows:
        whole = len(groups[key]) > 1 and sum(n for _, n in groups[key]) <= total / 5 / 64
        want[doc_id, size, min(4, (groups[key][0][0] if whole else at) * 5 // total)] += 1
        at += size
    got = balanced_shards(docs.unionByName(make(spark, more)), 5).collect()
    assert collections.Counter((r.doc_id, r.size, r.shard) for r in got) == want


def test_global_prefix(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i % 5 + 1) for i in range(1000)], "k long, size long")
    got, total = prefix_sums.global_prefix(rows, "k")
    at = 0
    for place, r in enumerate(sorted(got.collect())):
        assert (r.start, r.place) == (at, place)
        at += r.size
    assert total == at


def test_mixing(spark, docs):
    rows = mixing.mix_to_weights(docs, block_words=8, n_shards=3).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_to_weights(docs.repartition(3), block_words=8, n_shards=3).collect()), key=str)
    n = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += n(r.text)
    taken, target = collections.Counter(), {}
    for r in rows:
        assert r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert set(target) == set(sizes.values())
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - t) <= 16 + 0.01 * t for s, t in target.items())
    assert all(r.taken == sum(s.words for s in r.shards) for r in rows)
    mixed = mixing.mixed_documents(docs, block_words=8, n_shards=3)
    assert mixed.columns == docs.columns
    by_doc = collections.Counter()
    for r in mixed.collect():
        by_doc[r.doc_id] += n(r.text)
    want = collections.Counter()
    for r in rows:
        want[r.doc_id] += r.taken
    assert +by_doc == +want
    by_shard = collections.Counter()
    for r in mixing.mixed_documents(docs, block_words=8, n_shards=3, shard_col="in_shard").collect():
        by_shard[r.doc_id, r.in_shard] += n(r.text)
    want = collections.Counter()
    for r in rows:
        for s in r.shards:
            want[r.doc_id, s.shard] += s.words
    assert by_shard == want
    assert mixing.mix_to_weights(docs.limit(0)).count() == 0


def plain_mix(docs, n_shards, block_words, seed=17):
    """(document, shard) -> words, by loops over sources, shards, slots and words; ``docs``: (id, hash of the id, source, size)."""
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(d[3] for d in docs if d[2] == s) for s in sources}
    target = mixing.targets([size[s] for s in sources], [1 + i % 3 for i in range(len(sources))], 3)
    each = [max(1, min(block_words, size[s] // 256)) for s in sources]
    blocks = [-(-size[s] // e) for s, e in zip(sources, each)]
    slots = [round(t * b / size[s]) if size[s] else 0 for s, t, b in zip(sources, target, blocks)]
    drawn, out = mixing.draws(np.array(slots), n_shards, seed), collections.Counter()
    for i, s in enumerate(sources):
        words = [d[0] for d in sorted((d for d in docs if d[2] == s), key=lambda d: (d[1], d[0])) for _ in range(d[3])]
        slot = 0
        for shard in range(n_shards):
            for _ in range(drawn[shard, i]):
                turn, at = divmod(slot, blocks[i])
                key = textnum.mix(np.array([seed + i * 0x9E3779B97F4A7C15 + turn & (1 << 64) - 1], np.uint64))
                block = int(mixing.permuted(np.array([at]), np.array([blocks[i]]), key)[0])
                for doc in words[block * each[i] : (block + 1) * each[i]]:
                    out[doc, shard] += 1
                slot += 1
    return out, {s: t for s, t in zip(sources, target)}


def test_mixing_against_loops(spark):
    rng = random.Random(12)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(60))), "en", rng.choice("aaaab") if i % 50 else "tiny") for i in range(300)]
    docs = make(spark, rows)
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    found = {}
    for n_shards in (1, 7):
        want, target = plain_mix([(r[0], hashes[r[0]], r[3], len(r[1].split())) for r in rows], n_shards, 8)
        found[n_shards] = {(r.doc_id, s.shard): s.words for r in mixing.mix_to_weights(docs, block_words=8, n_shards=n_shards).collect() for s in r.shards}
        assert found[n_shards] == dict(want)
        for source in "a", "b", "tiny":
            own = {r[0] for r in rows if r[3] == source}
            taken = sum(n for (d, _), n in want.items() if d in own)
            assert abs(taken - target[source]) <= 8 + 0.01 * target[source]
    assert len({s for _, s in found[7]}) == 7


def test_targets_stop_at_the_cap():
    got = mixing.targets([10, 100, 1000], [1, 2, 3], 3)
    assert got[:2] == [30, 300] and abs(sum(got) - 1110) < 1e-9
    assert mixing.targets([0, 5], [1, 2], 3) == [0.0, 5.0]


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(4)
    length = rng.integers(1, 100, 400).astype(float)
    sizes = np.stack([length, np.ones(400), length**2], axis=1)
    capacity = np.array([128.0, 5, 7000])
    length[length**2 > 7000] = 80
    sizes = np.stack([length, np.ones(400), length**2], axis=1)
    where, offset = packing.vector_best_fit(sizes, capacity, np.array([1, 0.3, 0.5]), rule)
    for b in set(where.tolist()):
        own = where == b
        assert (sizes[own].sum(0) <= capacity).all()
        at = 0
        for i in sorted(np.flatnonzero(own), key=lambda i: offset[i]):
            assert offset[i] == at
            at += int(length[i])


def test_packing_is_an_exact_round_trip(spark, docs):
    from tokenizers import Tokenizer

    file, ranks = tokenizer_files()
    plain = Tokenizer.from_file(file)
    more = make(spark, [(900, "two  spaces and \n a line", "en", "a"), (901, " lead and trail ", "en", "a"), (902, "tab\t x\n\ny z  w", "en", "a"), (903, "<|endoftext|> in text", "en", "a"), (904, "x\n y", "en", "a")])
    both = docs.unionByName(more)
    rows = packing.pack_pieces(packing.token_pieces(both, file, ranks, most=64), most_tokens=64, group_rows=16).collect()
    pieces, packed = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        packed[r.sequence_id].append(r)
    for doc_id, text in {r.doc_id: r.text for r in both.collect() if r.doc_id != 5}.items():
        ids, at = plain.encode(text or "", add_special_tokens=False).ids + [2], 0
        for i, r in enumerate(sorted(pieces[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            assert r.length == 64 or i == 0
            at += r.length
        assert at == len(ids)
    for s in packed.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_pieces(packing.token_pieces(docs.limit(0), file, ranks)).count() == 0
    held = packing.token_pieces(more, file, ranks, with_ids=True).first()
    assert zlib.crc32(held.ids) == held.ids_crc32


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(400)] + [(i, [0.5] * 6) for i in range(400, 600)]
    vectors += [(50, [0.1] * 6), (700, None), (750, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [float("nan")] * 6), (850, [float("inf")] * 6), (None, [9.0] * 6), (900, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, label int, row int")
    good = [(i, np.pad(np.floor(256 * np.array(v, float)), (0, 6 - len(v))).astype(int)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for n, (q, x) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for m, (i, y) in enumerate(good) if m != n)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for size, pivots in ((64, 7), (4096, 7), (50, None)):
        got = knn_join.top_k_inner_product(frame, n_pivots=pivots, chunk_rows=size)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert knn_join.top_k_inner_product(frame.limit(0)).count() == 0
    assert knn_join.top_k_inner_product(frame.filter("vec_id = 50").limit(1)).count() == 0


def test_top_k_skips_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 4, (12, 16))
    vectors = [(i, (middle[i % 12] + rng.normal(0, 0.05, 16)).tolist()) for i in range(1200)]
    got = knn_join.top_k_inner_product(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), with_cells=True, chunk_rows=100).collect()
    whole = np.floor(256 * np.array([v for _, v in vectors])).astype(np.int64)
    for r in got:
        score = whole @ whole[r.query_id]
        best = [int(i) for i in np.lexsort((np.arange(1200), -score)) if i != r.query_id][r.rank - 1]
        assert (r.vec_id, r.score) == (best, score[best])
    assert len(got) == 24 * 5 and max(r.kept_cells / r.n_cells for r in got) < 0.4


def test_forward_sums_all_segmentations():
    pieces = sorted([b"a", b"b", b"ab", b"ba", b"aba", *[bytes([i]) for i in range(256) if i not in (97, 98)]])
    p = np.random.default_rng(1).random((len(pieces), 2))
    p /= p.sum(0)
    model = language_id.LanguageModel(["x", "y"], pieces, language_id.scale(p, pieces))
    finder = language_id.Pieces(pieces)

    def brute(word, i):
        return 1.0 if not word else sum(p[pieces.index(word[:n]), i] * brute(word[n:], i) for n in range(1, len(word) + 1) if word[:n] in pieces)

    texts = ["abab ba", "b", "", "abba"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    total = model.totals(finder, data, offsets)
    for r, t in enumerate(texts):
        for i in range(2):
            assert total[r, i] == pytest.approx(sum(np.log(brute(w.encode(), i)) for w in t.split()))


def test_forward_of_long_words_and_counts_of_learning():
    pieces = sorted([b"a", b"b", b"ab", b"bab" * 7, *[bytes([i]) for i in range(256) if i not in (97, 98)]])
    p = np.random.default_rng(2).random((len(pieces), 2)) * 1e-3
    model, finder = language_id.LanguageModel(["x", "y"], pieces, language_id.scale(p, pieces)), language_id.Pieces(pieces)
    rng = random.Random(3)
    words = ["".join(rng.choice(["a", "b", "bab" * 7]) for _ in range(n)) for n in (40, 400, 5000)]

    def plain(word, i):
        """Log of the sum over segmentations, in logs, end by end."""
        logs = [0.0]
        for end in range(1, len(word) + 1):
            logs.append(np.logaddexp.reduce([logs[end - len(q)] + np.log(p[j, i]) for j, q in enumerate(pieces) if q in known and word[:end].endswith(q)]))
        return logs[-1]

    known = {b"a", b"b", b"ab", b"bab" * 7}
    data = np.frombuffer("".join(words).encode(), np.uint8)
    width = np.array([len(w) for w in words])
    got = model.word_scores(finder, data, np.cumsum(width) - width, width)
    for r, w in enumerate(words[:2]):
        for i in range(2):
            assert got[r, i] == pytest.approx(plain(w.encode(), i), rel=1e-9)
    assert np.isfinite(got).all()
    # A round of learning from a single word equals counting over all of its segmentations.
    word, start = b"abab", language_id.learn([("x", b"abab", 2), ("x", b"a" * 300, 1)], pieces, rounds=1, smoothing=0.5).scaled[:-1, 0]
    want = np.full(len(pieces), 0.5)
    for cuts in itertools.product([0, 1], repeat=3):
        parts = bytes(word).replace(b"", b"|").strip(b"|").split(b"|")
        for at in range(2, -1, -1):
            if not cuts[at]:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if all(q in pieces for q in parts):
            share = (1 / len(pieces)) ** len(parts)
            total = sum((1 / len(pieces)) ** k * c for k, c in ((4, 1), (3, 2), (2, 1)))
            for q in parts:
                want[pieces.index(q)] += 2 * share / total
    want[pieces.index(b"a")] += 300
    lengths = np.array([len(q) for q in pieces])
    assert np.allclose(start / language_id.SCALE**lengths, want / want.sum())


def corpus(spark, n=240):
    rng = random.Random(8)
    words = {"en": "the of and that with this there which".split(), "de": "der und nicht schön über ein zwischen ich".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(20, 60))), lang, "a") for i in range(n) for lang in [rng.choice(["en", "de"])]]
    return rows


def test_language(spark):
    rows = corpus(spark)
    odd = [(1000, None, "en", "a"), (1001, "12 !", "en", "a"), (1002, "", None, "a"), (None, "the of and", "en", None), (1003, "und " * 30000, None, "a")]
    got = {r.doc_id: r for r in language_id.predict_language(make(spark, rows + odd), piece_file()).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in rows if got[r[0]].held_out]
    assert held and all(got[r[0]].lang_pred == r[2] for r in held)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "en"]
    assert language_id.predict_language(make(spark, odd[:3]), piece_file()).filter("lang_pred = 'und'").count() == 3
    assert language_id.predict_language(make(spark, []), piece_file()).count() == 0


def test_quality(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice(WORDS) for _ in range(rng.randrange(10, 60))]
        rows.append((i, " ".join(words) if good else " | ".join(words), "en", "a"))
        labels.append((i, int(good), 0))
    odd = [(1000, None, "en", "a"), (1001, "", "en", "a"), (None, "alpha " * 9000, "en", "a"), (1, "la mu", "en", "a")]
    docs, table = make(spark, rows + odd), spark.createDataFrame([*labels, (1, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, table).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.9 * len(held)
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.quality_scores(docs, table.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), table).count() == 0


def test_language_model(spark):
    rows = corpus(spark, 120) + [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "The  OF\tunseen1", None, None), (None, "the of", "en", "a"), (1003, "und ich " * 20000, "de", "a")]
    docs = make(spark, rows)
    got = {r.doc_id: r for r in language_model.score_texts(docs, *tokenizer_files(), most_common=5, steps=20).collect()}
    counts, tokens = collections.Counter(), {}
    for i, t, *_ in rows:
        tokens[i] = [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i])
    total, types = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in t))
        assert r.score < 0
    assert language_model.score_texts(docs.limit(0), *tokenizer_files(), steps=5).count() == 0


def small_model(seed=3):
    rng = np.random.default_rng(seed)
    model = language_model.AttentionModel.new(rng.integers(0, 50, 40).astype(float), 2, seed)
    for k, v in model.params.items():
        model.params[k] = (v + rng.normal(0, 0.4, v.shape)).astype(np.float32)
    return model, rng


def plain_log(model, before, target):
    """Natural log probability of ``target`` after the ids ``before``: one position at a time, in double precision, by every turn of the tree."""
    p = {k: v.astype(float) for k, v in model.params.items()}
    e = p["E"][before]
    q = e[-1] @ p["Q"]
    s = np.array([q @ (x @ p["K"]) + p["D"][len(before) - 1 - i] for i, x in enumerate(e)])
    a = np.exp(s - s.max())
    c = sum(w * (x @ p["V"]) for w, x in zip(a / a.sum(), e))
    g = np.tanh(e[-1] @ p["W"] + c @ p["O"] + p["b"])
    own = slice(model.tree.start[target], model.tree.start[target + 1])
    return sum(-np.log1p(np.exp(-t * (g @ p["N"][n] + p["n"][n]))) for n, t in zip(model.tree.node[own], model.tree.turn[own]))


def test_attention_scores_each_id_once_against_loops():
    model, rng = small_model()
    lengths = np.array([1, 31, 32, 33, 90, 56, 57])
    stream, begin = rng.integers(0, 40, lengths.sum()), np.cumsum(lengths) - lengths
    got = model.log_probabilities(stream, begin, lengths)
    for b, n in zip(begin, lengths):
        ids = [2, *stream[b : b + n].tolist()]
        for i in range(n):
            # The window that scores id i: the first, or the one in whose last 24 places it stands.
            start = 0 if i < 32 else (i - 8) // 24 * 24
            assert got[b + i] == pytest.approx(plain_log(model, np.array(ids[start : i + 1]), ids[i + 1]), rel=1e-3, abs=1e-4)
    g = model.forward(stream[None, :20])["g"][-1:]
    assert np.exp(model.log_of(np.repeat(g, 40, 0), np.arange(40))).sum() == pytest.approx(1, abs=1e-4)


def test_a_new_model_gives_shares_of_counts():
    counts = np.arange(1, 31, dtype=float)
    model = language_model.AttentionModel.new(counts, 2, 1)
    g = model.forward(np.arange(5)[None])["g"][:1]
    assert np.allclose(np.exp(model.log_of(np.repeat(g, 30, 0), np.arange(30))), (counts + 0.1) / (counts + 0.1).sum(), rtol=1e-3)


def test_gradients_against_differences():
    model, rng = small_model(4)
    windows = rng.integers(0, 40, (5, 33))
    windows[3, 20:], windows[4, 2:] = -1, -1

    def loss():
        own = [plain_log(model, w[: i + 1], w[i + 1]) for w in windows for i in range(32) if w[i + 1] >= 0]
        return -sum(own) / len(own)

    found = model.gradients(windows)
    for name, p in model.params.items():
        g = found[name]
        if name in language_model.LARGE:
            whole = np.zeros((len(p), p.size // len(p)))
            np.add.at(whole, g[0], g[1])
            g = whole.reshape(p.shape)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, out = p[at], []
        for step in (0.01, -0.01):
            p[at] = was + step
            out.append(loss())
        p[at] = was
        assert g[at] == pytest.approx((out[0] - out[1]) / 0.02, rel=0.03, abs=1e-5)


def test_gradients_of_nodes_are_summed_by_row_against_loops():
    rng = np.random.default_rng(6)
    for sizes in ([], [1], [1, 1], [7, 1, 300, 2, 64, 1]):
        x, first = rng.normal(size=(sum(sizes), 5)), np.cumsum([0, *sizes])[:-1].astype(int)
        want = [sum(x[a : a + n]) for a, n in zip(first, sizes)]
        assert np.allclose(language_model.row_sums(x, first), np.reshape(want, (len(sizes), 5)))
    random = np.random.default_rng(7)
    model = language_model.AttentionModel.new(random.integers(0, 50, 300).astype(float), 2, 7)
    found = model.gradients(random.integers(0, 300, (5, 33)))
    for name in ("N", "n"):
        assert len(set(found[name][0].tolist())) == len(found[name][0]) == len(found[name][1]) > language_model.TOP


def test_rows_of_a_key_are_summed_once_against_loops():
    """Keys with one row, with as many as are added up together, and with more; gradients of ids and nodes name each row once."""
    rng = np.random.default_rng(8)
    sizes = [1, 3, language_model.LAYERS, language_model.LAYERS + 1, 2, 200]
    key = rng.permutation(np.repeat(np.arange(len(sizes)) * 7, sizes))
    x = rng.normal(size=(len(key), 5))
    found, sums = language_model.sums_by(key, x)
    assert found.tolist() == [7 * i for i in range(len(sizes))]
    assert np.allclose(sums, [sum(r for k, r in zip(key, x) if k == one) for one in found])
    assert [len(t) for t in language_model.sums_by(key[:0], x[:0])] == [0, 0]
    model = language_model.AttentionModel.new(rng.integers(0, 50, 300).astype(float), 2, 7)
    for windows in (rng.integers(0, 300, (5, 33)), np.where(np.arange(33) < 3, 4, -np.ones((2, 33), int))):
        gradients = model.gradients(windows)
        for name in language_model.LARGE:
            rows, g = gradients[name]
            assert len(set(rows.tolist())) == len(rows) == len(g)


def test_steps_of_a_way_are_near_the_root_or_on_a_level():
    """Every step of every id's way is found once: among the nodes near the root, or on the level of its place."""
    tree = language_model.Tree.of(np.random.default_rng(9).integers(0, 50, 300).astype(float))
    ids = np.array([5, 299, 5, 0, 17])
    low = len(tree.bias) - language_model.TOP
    at, turn, begin = tree.near(ids)
    got = [[] for _ in ids]
    for row, column, t in zip(at // language_model.TOP, at % language_model.TOP, turn):
        got[row].append((low + column, t))
    order, levels = tree.levels(ids)
    for node, turn in levels:
        for row, n, t in zip(order, node, turn):
            got[row].append((n, t))
    assert len(begin) == len(ids)
    for i, steps in zip(ids, got):
        own = slice(tree.start[i], tree.start[i + 1])
        assert sorted(steps) == sorted(zip(tree.node[own], tree.turn[own]))


def test_windows_of_a_document():
    ids = np.arange(100, 170)
    whole = language_model.windows_of(ids, 2)
    assert whole[:, 0].tolist() == [2, 131, 163] and [x for w in whole for x in w[1:].tolist() if x >= 0] == ids.tolist()
    assert len(language_model.windows_of(ids[:1], 2)) == 1 and len(language_model.windows_of(ids[:64], 2)) == 2


def test_training_takes_every_window_against_loops(spark):
    """Two tasks of several trainers each, in two rounds: means of what each trainer changes, by row, as plain loops give them."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 40, n).astype("<u2") for n in (1, 31, 32, 33, 700, 200, 64, 5, 90, 410)]
    tokens = cut(spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(texts)], "row long, ids binary").repartition(2, "row"), "ids")
    tasks = [[r.row for r in part] for part in tokens.select("row").rdd.glom().collect()]
    turn = {r.row: r.turn for r in tokens.selectExpr("row", "pmod(xxhash64(row), 2) turn").collect()}
    assert set(turn.values()) == {0, 1}
    got = language_model.fit_attention(tokens, 40, 2, steps=3, trainer_windows=8)
    counts = np.bincount(np.concatenate(texts), minlength=40).astype(float)
    model = language_model.AttentionModel.new(counts, 2, 5)
    every = sorted((i, w.tobytes(), w) for i, t in enumerate(texts) for w in language_model.windows_of(t, 2))
    squares = language_model.fresh_squares(model.params)
    model.learn(np.stack([w for *_, w in every]).astype(np.int64), 3, 5, 0.4, squares, warm_up=50)
    trained = 0
    for i in range(2):
        changes = []
        for task in tasks:
            own = [w for row in task if turn[row] == i for w in language_model.windows_of(texts[row], 2)]
            for at in range(0, len(own), 8):
                trained += len(own[at : at + 8])
                one = language_model.AttentionModel(model.tree, {k: v.copy() for k, v in model.params.items()}, 2)
                touched = one.learn(np.stack(own[at : at + 8]).astype(np.int64), 1, 5 + i, 0.02, {k: v.copy() for k, v in squares.items()}, least=0.5)
                changes.append(({k: v - model.params[k] for k, v in one.params.items()}, touched))
        for name, p in model.params.items():
            for at in range(len(p)):
                moved = [c[name][at] for c, t in changes if name not in t or t[name][at]]
                if moved:
                    p[at] += sum(moved) / len(moved)
    assert trained == len(every)
    for name, p in model.params.items():
        assert np.allclose(got.params[name], p, atol=1e-4), name


def test_training_beats_the_unigram(spark):
    rows = corpus(spark, 700)
    got = language_model.score_texts(make(spark, rows), *tokenizer_files(), steps=150, trainer_windows=500).filter("held_out").collect()
    assert len(got) > 50 and sum(r.score for r in got) > sum(r.base_score for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href="/">Home</a></header>
<nav><ul><li>Menu</li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>Head  line&amp;</h1><p><b>One <i>two</i>.<br><p>Three&nbsp;four &lt;x&gt;
five</p><aside>side</aside><div class="comments"><p>first!</p></div></article><form>ask</form><footer>&copy; us</footer>"""


def test_html_extraction(spark):
    assert html_text.main_text(PAGE)[0] == "Head line&\nOne two.\nThree four <x> five"
    template = '<html><body><div class="x1">Same on all</div><div>Body {0}</div><div class="x2">Bottom</div></body></html>'
    pages = [(i, f"http://h.example/{i}", template.format(f"text number {i}")) for i in range(10)]
    pages += [(20, "https://lone.example/a", template.format("alone")), (21, None, None), (22, "odd", ""), (23, "http://h.example/copy", PAGE), (24, "http://h.example/copy", PAGE), (None, "x", "plain text")]
    frame = spark.createDataFrame([(*p, 1, "h") for p in pages], "page_id long, url string, html string, row long, host string")
    for most in (1_000_000, 0):
        got = {r.page_id: r for r in html_text.extract_main_text(frame, most_held=most).collect()}
        assert all(got[i].text == f"Body text number {i}" for i in range(10))
        assert got[20].text == "Same on all\nBody alone\nBottom" and got[21].text == got[22].text == "" and got[None].text == "plain text"
        assert got[23].text == got[24].text == html_text.main_text(PAGE)[0] and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract_main_text(frame.limit(0)).count() == 0


def test_html_wrapper_around_an_article(spark):
    page = '<body><div><nav>same</nav><{0}><p>differs {1}</p></{0}><div>foot</div></div></body>'
    frame = spark.createDataFrame([(i, f"http://h.example/{i}", page.format("main" if i % 2 else "article", i)) for i in range(8)], "page_id long, url string, html string")
    for most in (1_000_000, 0):
        assert {r.page_id: r.text for r in html_text.extract_main_text(frame, most_held=most).collect()} == {i: f"differs {i}" for i in range(8)}


def test_html_recurring_inside_articles(spark):
    page = '<body><article><h1>Title {0}</h1><p>Body {0}</p><div class="x"><p>Read this too</p></div></article></body>'
    nested = "<body><main><article><p>One story</p><p>told again</p></article><p>{0}</p></main></body>"
    pages = [(i, f"http://h.example/{i}", page.format(i)) for i in range(6)] + [(i, f"http://h.example/{i}", page.format("copied")) for i in range(6, 12)]
    pages += [(i, f"http://copies.example/{i}", page.format(1)) for i in range(20, 28)] + [(i, f"http://few.example/{i}", page.format(i)) for i in range(30, 33)]
    pages += [(i, f"http://nested.example/{i}", nested.format(f"beside {i}")) for i in range(40, 46)]
    want = {i: f"Title {i if i < 6 else 'copied'}\nBody {i if i < 6 else 'copied'}" for i in range(12)} | {i: "Title 1\nBody 1\nRead this too" for i in range(20, 28)}
    want |= {i: f"Title {i}\nBody {i}\nRead this too" for i in range(30, 33)} | {i: f"One story\ntold again\nbeside {i}" for i in range(40, 46)}
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for most in (1_000_000, 0):
        assert {r.page_id: r.text for r in html_text.extract_main_text(frame, most_held=most).collect()} == want


@pytest.mark.parametrize("page, text", [
    ('<div class="content with-sidebar"><p>Hello article.</p></div>', "Hello article."), ('<div class="has-footer"><article>x</article></div>', "x"),
    ('<div class="sidebar"><p>only this</p></div>', "only this"), ("<form><article>a<p>b</article></form>", "a\nb"), ("a < b <c", "a < b"), ("<p>x<p>y</p>z", "x\ny\nz"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<ul><li>a<li>b<p>c<li>d</ul>", "a\nb\nc\nd"), ("</b>x</p>y<b>z</b>", "x\nyz"),
    ('<article>post<section id="comments"><article class="comment">bad</article></section></article>', "post"), ('<div id=comments>hi</div><p>text</p>', "text"),
    ("<article><b>One<p>two</b> three</article> after", "One\ntwo three"), ("<nav><article>teaser</article></nav><main>m</main>", "m"), ("<!-- <article>no</article> -->yes<!-- open", "yes"),
])
def test_html_shown(page, text):
    assert html_text.main_text(page)[0] == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "</p>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, '<a ="' * 200_000, "<" * 1_000_000, "<p>" * 200_000, "<b>" * 100_000 + "</b>" * 100_000, "<a href='" * 100_000])
def test_html_parsing_is_linear(page):
    began = time.perf_counter()
    html_text.parse_page(page)
    assert time.perf_counter() - began < 8


def test_html_counting_against_loops(spark):
    rng = random.Random(4)
    bar = lambda: '<div class="links">' + "".join(f'<a href="x">{rng.choice(WORDS)} {rng.randrange(99)}</a> ' for _ in range(rng.randrange(3, 6))) + "</div>"
    pages = []
    for i in range(60):
        host = f"h{i % 4}.example"
        parts = [f"<nav>menu of {host}</nav>", bar() if i % 2 else "", f"<article><p>{rng.choice(WORDS)}</p><p>own {i % 50}</p>" + rng.choice(["", "<div>read on</div>", bar()]) + "</article>", f"<div>{rng.choice(WORDS)}</div>", "<p>&copy;</p>" if i % 3 else ""]
        pages.append((f"http://{host}/{i}", "".join(parts) if i % 5 else "".join(parts).replace("article", "section")))
    seen = collections.defaultdict(lambda: (set(), set()))
    for url, page in pages:
        for host, inside, value, article, content in html_text.subtree_rows(url, page):
            seen[host, inside, value][0].add(content)
            seen[host, inside, value][1].add(article)
    want = {(host, value) for (host, inside, value), (contents, articles) in seen.items() if value is not None
            for n in [min(len(contents), len(articles)) if inside else len(contents)] if n >= 4 and n >= 0.3 * len(seen[host, inside, None][0])}
    rows = [r for url, page in pages for r in html_text.subtree_rows(url, page)]
    counted = spark.createDataFrame(rows * 2, html_text.COUNTED)
    got = [tuple(r) for r in html_text.recurring_subtrees(counted, 4, 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 8
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    held = collections.defaultdict(set)
    for host, value in want:
        held[host].add(value)
    for most in (1_000_000, 0):
        found = {r.page_id: (r.text, r.n_blocks, r.n_template) for r in html_text.extract_main_text(frame, most_held=most).collect()}
        assert found == {i: html_text.main_text(page, held[html_text._host(url)]) for i, (url, page) in enumerate(pages)}
        assert not any("menu" in t for t, _, _ in found.values()) and sum(n for _, _, n in found.values()) > 100


def test_ngram_join_cuts_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng, passage = random.Random(6), [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 24))]), "en", "a") for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more", "en", "a") for i in range(0, 200, 7)]
    docs, tiles = make(spark, rows), []
    cut_up = ngram_join._in_blocks
    monkeypatch.setattr(ngram_join, "_in_blocks", lambda *args: tiles.append((args[0], cut_up(*args))) or tiles[-1][1])
    found = ngram_jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_components(docs.collect())[0])
    (whole, units) = tiles[0]
    whole, by_unit, met = whole.collect(), collections.defaultdict(list), collections.Counter()
    for r in units.collect():
        by_unit[tuple(r[c] for c in ngram_join.UNIT)].append(r)
    assert max(collections.Counter(r.shingle for r in whole).values()) > 100 and max(map(len, by_unit.values())) < 60
    for unit, members in by_unit.items():
        two = unit[1:2] + unit[3:4] != unit[2:3] + unit[4:5]
        met.update((unit[0], *sorted((x.node, y.node))) for i, x in enumerate(members) for y in members[:i] if not two or x.side != y.side)
    pairs = {(x.shingle, *sorted((x.node, y.node))) for x in whole for y in whole if x.shingle == y.shingle and x.node < y.node and 100 * min(x.n, y.n) >= 80 * max(x.n, y.n)}
    assert pairs <= set(met) and set(met.values()) == {1}


@pytest.mark.parametrize("carried", [1, 32])
def test_ngram_join_of_long_texts_carries_few_tiles(spark, monkeypatch, carried):
    """Long texts that share hundreds of tiles: rows stay small, no link is lost where the first common tile is beyond what is carried."""
    monkeypatch.setattr(ngram_join, "FIRST_TILES", carried)
    rng = random.Random(8)
    base, rows = [f"b{i}" for i in range(4000)], []
    for i in range(12):
        start, text = rng.randrange(3000), list(base)
        text[start : start + (300, 480, 700, 950)[i % 4]] = [f"o{i}x{j}" for j in range(300)]
        rows.append((i, " ".join(text), "en", "a"))
    docs, carry = make(spark, rows), []
    pairs = ngram_join._tile_pairs
    monkeypatch.setattr(ngram_join, "cut", lambda df, name, **more: (carry.append(cut(df, name)) or carry[-1]) if name == "signatures" else cut(df, name, **more))
    found = ngram_jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_components(docs.collect())[0])
    assert all(len(r.met) <= carried for r in carry[0].collect())

    # Two classes in the same hundred tiles leave once where their lists show it, and never less than once.
    tiles, bits = list(range(100, 200)), ngram_join.bitmap(np.arange(100, dtype=np.uint64), 1024).tobytes()
    at = [(t, 0, 0, 0, 0, 100, node, node, 0, bits, tiles[:carried]) for t in tiles for node in (1, 2)]
    types = [pa.int64()] * 8 + [pa.int32(), pa.binary(), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at), types)], names=[*ngram_join.UNIT, "n", "node", "component", "side", "bits", "met"])
    assert [r for b in pairs(80)(iter([batch])) for r in b.to_pylist()] == [{"a": 2, "b": 1}]


def test_ngram_join_of_very_long_texts(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**5)}" for _ in range(200_000)]
    near, far = [w if i % 60 else "x" for i, w in enumerate(long)], [w if i % 18 else "y" for i, w in enumerate(long)]
    docs = make(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate((long, near, far, long))])
    found = ngram_jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_components(docs.collect())[0])


def test_sharers_of_one_shingle_leave_in_parts(monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_SHARERS", 50)
    rows = sorted([(5, i // 2, 9) for i in range(2000)] + [(s, 1, 9) for s in (2, 3, 8)] + [(7, 1, 9), (7, 2, 9), (4, 1, 9), (4, 1, 9)])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 33])], names=["shingle", "node", "n"]) for i in range(0, len(rows), 33)]
    out = list(ngram_join._shared(np.array([8], np.uint64))(iter(batches)))
    assert max(len(b) for b in out) < 100
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(5, i, 9, 50) for i in range(1000)] + [(7, 1, 9, 2), (7, 2, 9, 2), (8, 1, 9, 50)]


@pytest.mark.parametrize("page", ["<aside>x" * 125_000, "<article><p>x</p>" * 20_000, "<div class=sidebar>x" * 50_000, "<nav><div>a</div>" * 30_000])
def test_nested_pages_take_linear_time_and_space(page):
    began = time.perf_counter()
    trees = html_text.parse_page(page)[2]
    html_text.subtree_rows("http://a.example/b", page)
    html_text.template_blocks(trees, {t.text for t in trees})
    assert time.perf_counter() - began < 12


def test_template_blocks_and_article_hashes_against_loops():
    rng = random.Random(8)
    trees = [html_text.Tree(i, None, a, a + rng.randrange(1, 9), None) for i in range(200) for a in [rng.randrange(60)]]
    recurring = set(rng.sample(range(200), 25))
    assert html_text.template_blocks(trees, recurring) == {i for t in trees if t.text in recurring for i in range(t.first, t.last)}
    blocks, shown = [rng.choice("abc") for _ in range(60)], [rng.random() < 0.8 for _ in range(60)]
    ranges = {(a, a + n) for a in range(50) for n in range(0, 10)}
    found = html_text._range_hashes(blocks, shown, ranges)
    texts = {r: tuple(b for b, s in zip(blocks[slice(*r)], shown[slice(*r)]) if s) for r in ranges}
    assert len({(found[r], texts[r]) for r in ranges}) == len(set(found.values())) == len(set(texts.values()))


def test_top_k_raises_beyond_64_bits(spark):
    rows = lambda big: spark.createDataFrame([(0, [1.0, 2.0]), (1, [big, 1.0]), (50, [3.0, big])], "vec_id long, embedding array<double>")
    for big in (1e17, 1e300, -1e17, 2.0**21):
        if abs(big) > 2.0**30:
            with pytest.raises(ValueError, match="64 bits"):
                knn_join.top_k_inner_product(rows(big))
        else:
            got = {(r.query_id, r.vec_id): r.score for r in knn_join.top_k_inner_product(rows(big)).collect()}
            x = int(256 * big)
            assert got[0, 1] == 256 * x + 512 * 256 and got[50, 1] == 768 * x + x * 256 and got[0, 50] == 256 * 768 + 512 * x


def test_exact_dedup_of_one_text_on_most_rows(spark):
    """One short and one long text on 90 % of the rows, where tables of names are too large to be sent."""
    long = "many blocks " * 300
    texts = {i: "the same" if i % 10 < 6 else long if i % 10 < 9 else f"own {i} " + ("x" * (i % 7) * 40) for i in range(400)}
    rows = make(spark, [(i, t, "en", "a") for i, t in texts.items()]).repartition(6)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = exact_dedup(rows, block_bytes=64).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[norm(t)].append(i)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, min(g), len(g), i == min(g)) for g in groups.values() for i in g} and len(got) == 400


def test_columns_named_like_helpers_stay(spark):
    """Columns of the caller that are named like the operators' own (in capitals too) come back with what they held."""
    names = ["__row", "__ROW_", "__text", "__score", "__held", "__mix_spans", "__mix_shard"]
    docs = make(spark, corpus(spark, 60)).select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: pyspark_functions.concat(pyspark_functions.lit(n), pyspark_functions.col("doc_id")) for n in names})
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "0 toxic")
    for kept in (keep_first(docs), keep_one_of_each(docs), quality.keep_good(docs, labels, threshold=0.0), mixing.mixed_documents(docs), mixing.mixed_documents(docs, shard_col="shard").drop("shard")):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
