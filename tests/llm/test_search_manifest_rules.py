"""Ranked search, manifest and rule ledger against plain loops, on tables with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.llm import manifest, nra_search, rule_ledger

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, n long, item long, size long, slot long, word string, failed_rules long"
WORDS = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "Éta", "theta", "iota", "kappa", "la", "mu"]


def make(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 2, 3, 4, 5, 6, "w", 7) for r in rows], SCHEMA)


def sample_rows():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "", "a"), (4, "one two", "en", "b"), (5, "ONE  two ", "en", "b"), (5, "ONE  two ", "en", "b"), (5, "zwei", "de", "b")]
    rows += [(None, "no id here", "de", "c"), (None, "no id", "de", "c"), (-7, "before zero", "en", "c"), (-(2**63), "least", "en", "c"), (2**63 - 1, "most", "en", "c"), (900, "alone", "en", "lone"), (901, "also", "en", "")]
    rows += [(i, say(rng.randrange(1, 120)), rng.choice(["en", "de"]), "a" if i % 3 else "hot") for i in range(100, 460)]
    rows += [(10**6 * i, say(20), "en", "sparse") for i in range(1, 40)]
    rows += [(3000, "long" + say(9000), "de", "a"), (3001, "x" * 70000, "de", "a"), (3002, "a\x0bb\x0cc\rd", "de", "b"), (3003, "same\nsame\n \n same\nsame!\n" * 30, "en", "b")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, sample_rows()).repartition(5).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run_up(nodes, fan_out):
    """(levels of nodes, root)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan_out])) for i in range(0, len(levels[-1]), fan_out)])
    return levels


def climb(levels, at, leaf, fan_out):
    """(siblings, root) from a leaf of one tree."""
    beside = []
    for nodes in levels[:-1]:
        first = at - at % fan_out
        run = nodes[first : first + fan_out]
        left, right = run[: at - first], run[at - first + 1 :]
        beside += left + right
        leaf = sha("".join([*left, leaf, *right]))
        at //= fan_out
    return beside, leaf


@pytest.mark.parametrize("fan_out", [2, 16])
def test_manifest_against_loops(spark, docs, fan_out):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, t))))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = collections.defaultdict(list)
    for r in docs.collect():
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        own = leaf(r, r.text)
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, own, leaf(r, lower(r.text)) if tampered else own, r.doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: run_up([x[2] for x in sorted(groups[s])], fan_out) for s in order}
    top = run_up([trees[s][-1][0] for s in order], fan_out)
    want = collections.Counter()
    for i, s in enumerate(order):
        for j, (_, _, own, tampered, doc_id) in enumerate(sorted(groups[s])):
            beside, sub = climb(trees[s], j, tampered, fan_out)
            above, root = climb(top, i, sub, fan_out)
            want[(doc_id, own, trees[s][-1][0], top[-1][0], sha("".join(beside + above)), root, root == top[-1][0])] += 1
    got = manifest.manifest_check(docs, fan_out=fan_out)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == want
    assert {r.verified for r in got.collect()} == {True, False}


def test_manifest_ranks_and_empty_tables(spark, docs):
    rows = docs.select(F.coalesce("source", F.lit("")).alias("group"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("leaf"))
    found = manifest.ranks(rows).collect()
    for group in {r.group for r in found}:
        own = sorted((r for r in found if r.group == group), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        ids = [-math.inf if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids)
    assert manifest.manifest_check(docs.limit(0)).count() == 0
    (one,) = manifest.manifest_check(docs.filter("doc_id = 900")).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def plain_search(docs, items, k):
    find = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    bags = [(r.doc_id, collections.Counter(find(r.text))) for r in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for r in items:
        terms = set(find(r.text)) & set(df)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // n_terms
            scored.append((-sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b), d is None, d or 0, d))
        out += [(r.item_id, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k]) if x[0] < 0]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(9)
    rows = [(1, "gamma3 Beta7, beta7 LA1 nowhere"), (2, None), (3, "?!"), (4, "one"), (5, "éta3 ÉTA3 Éta3 mu29"), (5, "éta3 ÉTA3 Éta3 mu29"), (6, "unknown words alone"), (None, "theta1 theta2")]
    rows += [(10 + i, " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60)))) for i in range(25)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "item_id long, text string, item long, doc_id long")


@pytest.mark.parametrize("first_read, doc_block, item_block", [(1, 50, 7), (64, 1 << 14, 1024)])
def test_search_against_loops(spark, docs, items, monkeypatch, first_read, doc_block, item_block):
    monkeypatch.setattr(nra_search, "FIRST_READ", first_read)
    monkeypatch.setattr(nra_search, "DOC_BLOCK", doc_block)
    monkeypatch.setattr(nra_search, "ITEM_BLOCK", item_block)
    got = nra_search.nra_search(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs.collect(), items.collect(), 10)


def test_search_ties_and_empty_tables(spark, items):
    same = make(spark, [(i, "gamma3 la1", "en", "a") for i in range(40)] + [(100 + i, "other words here", "en", "a") for i in range(200)]).repartition(3)
    got = nra_search.nra_search(same, items.filter("item_id = 1")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(10)) and len({r.score for r in got}) == 1
    assert nra_search.nra_search(same.limit(0), items).count() == 0
    assert nra_search.nra_search(same, items.limit(0)).count() == 0


def test_lists_are_not_read_to_their_ends():
    """With a rare term that sets the best documents apart, long lists stay unread."""
    rng = np.random.default_rng(1)
    n = 20_000
    doc = np.concatenate([rng.permutation(n), rng.choice(n, 12, replace=False)])
    term = np.repeat([0, 1], [n, 12])
    tf = np.concatenate([rng.integers(1, 3, n), np.full(12, 40)])
    m = rng.integers(100, 2000, n)
    m[doc[n:]] = 50
    lists = nra_search.ImpactLists(np.array([0, 1]), term, doc, tf, m)
    reads = []
    lists.doc = type("Read", (np.ndarray,), {"__getitem__": lambda self, i: (reads.append(i.stop - i.start) if isinstance(i, slice) else None, np.ndarray.__getitem__(self, i))[1]})(n + 12, int, lists.doc.copy())
    at, score = lists.best(np.array([0, 1]), np.array([10, 9000]), 10)
    low = np.zeros(n, np.int64)
    np.add.at(low, doc, np.array([10, 9000])[term] * (10**9 * tf // (1000 * tf + 8 * m[doc])))
    assert sorted(score)[-10:] == sorted(low)[-10:] and (low[at] == score).all()
    assert sum(reads) < n / 4


def measured(text):
    words, lines = re.findall("[^\x20\x09-\x0d]+", text), [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    is_letter = lambda x: x.isascii() and x.isalpha() or ord(x) > 127
    return (
        len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(again), len(lines), sum(map(is_letter, text)), len(re.findall("[A-Z]", text)),
        sum(map(is_letter, "".join(words))), sum(not any(is_letter(x) or x in "0123456789" for x in w) for w in words),
    )


def test_measures_against_loops(spark, docs):
    odd = [(1, "a b c a b c d", "", ""), (2, "# $$ <b> é|ñ\nx\n\n x\nx", "", ""), (3, "日本 語\n日本 語\n", "", ""), (4, "a b c", "", ""), (5, "UP DOWN -- ** 12 3a\r\nUP DOWN -- ** 12 3a\r\n", "", ""), (6, "a a a a", "", "")]
    rows = docs.unionByName(make(spark, odd))
    got = rule_ledger.ledger(rows).select("doc_id", *rule_ledger.MEASURES).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r.doc_id, *measured(r.text or "")) for r in rows.collect())
    assert rule_ledger.ledger(rows.limit(0)).count() == 0


def test_verdicts_policies_and_ablations(spark, docs):
    names = [r.name for r in rule_ledger.rules()]
    plain = {
        "few_words": lambda m: m["n_words"] < 50, "repeated_windows": lambda m: m["n_repeat_words"] * 2 > m["n_words"], "symbols": lambda m: m["n_symbols"] * 10 > m["n_words"],
        "shouting": lambda m: m["n_upper"] * 100 > m["n_letters"] * 40, "duplicate_lines": lambda m: m["n_dup_lines"] * 2 > m["n_lines"], "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
        "long_words": lambda m: m["word_chars"] > 14 * m["n_words"], "few_letters": lambda m: m["n_word_letters"] * 100 < m["word_chars"] * 60, "bare_marks": lambda m: m["n_marks_only"] * 5 > m["n_words"],
    }
    more = [(5000 + i, t, "", "") for i, t in enumerate(["SHOUT IT " * 40 + "quietly said", "a# b# c$ " * 30 + " ".join(f"w{i}" for i in range(200)), "-- " * 30 + " ".join(f"w{i}" for i in range(60)), "-- ## " * 50])]
    rows = docs.unionByName(make(spark, more))
    led = rule_ledger.ledger(rows).cache()
    failed = []
    for r in led.collect():
        fails = {n for n in names if plain[n](r.asDict())}
        assert r.failed_rules == sum(1 << names.index(n) for n in fails)
        failed.append((fails, r.doc_id))
    verdict = lambda p, f: not f & set(p.fatal) and len(f & set(p.named)) <= p.allowed
    got = rule_ledger.rule_verdicts(rows)
    base, strict = rule_ledger.BASE, rule_ledger.STRICT
    want = collections.Counter((d, not verdict(base, f), verdict(base, f) and verdict(strict, f)) for f, d in failed)
    assert collections.Counter((r.doc_id, r.base_failed, r.kept) for r in got.collect()) == want
    table = {(r.policy, r.version, r.rule): r for r in rule_ledger.ablations(led).collect()}
    for p in rule_ledger.POLICIES:
        for rule in (*p.fatal, *p.named):
            r, own = table.pop((p.name, p.version, rule)), set(p.fatal) | set(p.named)
            assert r.failed == sum(rule in f for f, _ in failed) and r.only == sum(f & own == {rule} for f, _ in failed)
            assert r.kept == sum(verdict(p, f) for f, _ in failed) and r.kept_without == sum(verdict(p, f - {rule}) for f, _ in failed)
    assert not table
    assert [r.kept for r in rule_ledger.ablations(led.limit(0)).collect()] == [0] * sum(len(p.fatal) + len(p.named) for p in rule_ledger.POLICIES)
