"""Every stage of the pipeline against a plain version, on the smallest tables."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from orefield.llm import mixing, quality
from orefield.llm.queries import tokenizer_files
from orefield.llm.textnum import buffers

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows in, rows out) of each stage, each on what the one before has written."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert sorted(after.columns) == sorted(before.columns), name
        assert 0 < after.count()


def test_quality(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    own = quality.held_out
    rows = before.select("doc_id", "text")
    model = quality.fit_quality(rows.filter(~own(rows.doc_id, 4, 2)), labels.select("doc_id", "quality").filter(~own(labels.doc_id, 4, 2)))
    table = rows.toPandas()
    ids = iter(table.doc_id)
    scored = [(next(ids), s) for _, data, offsets in buffers(pa.array(table.text)) for s in model.score(quality.pooled(data, offsets, model.vectors))]
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(i for i, s in scored if s >= 0.7)


def test_exact_copies(stages):
    before, after = stages["exact_copies"]
    best = {}
    for r in before.collect():
        key, own = re.sub("[\x20\x09-\x0d]", "", r.text or ""), (-len(r.text or ""), r.doc_id)
        best[key] = min(best.get(key, own), own)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for _, i in best.values())


def test_near_copies(stages):
    before, after = stages["near_copies"]
    rows = before.collect()
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(min(g) for g in least.values())


def test_mixture(stages):
    before, after = stages["mixture"]
    texts, size, taken = {r.doc_id: words(r.text) for r in before.collect()}, collections.Counter(), collections.Counter()
    source = {r.doc_id: r.source for r in before.collect()}
    for i, w in texts.items():
        size[source[i]] += len(w)
    by_doc = collections.Counter()
    for r in after.collect():
        assert r.source == source[r.doc_id] and set(words(r.text)) <= set(texts[r.doc_id])
        by_doc[r.doc_id] += len(words(r.text))
    assert all(n <= 3 * len(texts[i]) for i, n in by_doc.items())
    for i, n in by_doc.items():
        taken[source[i]] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, target in zip(names, mixing.targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))], 3)):
        assert abs(taken[s] - target) <= 64 + 0.01 * target


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    plain = Tokenizer.from_file(tokenizer_files()[0])
    want = collections.Counter()
    for r in before.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    rows = after.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.1 * sum(r.length for r in rows) / 1024 + 2


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages["packing"][1].columns and got.count() == stages["packing"][1].count()
