"""Every stage of the pipeline against SQL or brute force, each on its own input."""

import hashlib
from collections import Counter

import duckdb

import corpus_pipeline
from inkwarden.llm import line_dedup, quality_rules
from inkwarden.session import stage
from tests.llm.test_native import WORD, _targets
from tests.llm.test_near import _shingles
from tests.llm.test_texts import _library

SF = "/root/testdata/sf0.001"


def _root(up, i):
    while up[i] != i:
        i = up[i]
    return i


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    inputs = [docs]
    for name, step in corpus_pipeline.STAGES:
        inputs.append(stage(step(spark, inputs[-1], SF), "test"))
    assert all(d.columns == docs.columns for d in inputs[:-1])
    tables = [d.toPandas() for d in inputs]

    con.register("before", tables[0])
    kept = con.execute(f"WITH {quality_rules.verdict_sql('before')} SELECT doc_id FROM judged WHERE kept").fetchall()
    assert sorted(tables[1].doc_id) == sorted(x for (x,) in kept) and 0 < len(kept) < len(tables[0])
    assert tables[1].merge(tables[0]).shape == tables[1].shape  # as they came

    con.register("kept", tables[1])
    lines = con.execute(f"WITH {line_dedup.lines_sql('kept')} SELECT doc_id, text FROM deduped").fetchall()
    assert Counter(zip(tables[2].doc_id, tables[2].text)) == Counter(lines)
    assert (tables[2].n_chars == tables[2].text.str.len()).all()

    rows = tables[2].sort_values("doc_id")
    ids, sets = rows.doc_id.tolist(), [_shingles(t) for t in rows.text]
    up = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((_root(up, i), _root(up, j)))
                up[b] = a
    assert sorted(tables[3].doc_id) == sorted({ids[_root(up, i)] for i in range(len(ids))})

    words = {i: len(WORD.findall(t)) for i, t in zip(tables[3].doc_id, tables[3].text)}
    sizes, got, times = Counter(), Counter(), Counter(tables[4].doc_id)
    for i, s in zip(tables[3].doc_id, tables[3].source):
        sizes[s] += words[i]
    taken = [len(WORD.findall(t)) for t in tables[4].text]
    for s, n in zip(tables[4].source, taken):
        got[s] += n
    assert all(abs(got[s] - t) <= 1 for s, t in _targets(dict(sizes)).items())
    assert max(times.values()) <= 2
    cut = Counter(s for i, s, n in zip(tables[4].doc_id, tables[4].source, taken) if n != words[i])
    assert max(cut.values(), default=0) <= 2  # one document a source and pass

    library = _library()
    want = Counter()
    for i, t in zip(tables[4].doc_id, tables[4].text):
        x = library.encode(t, add_special_tokens=False).ids
        want[i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(zip(tables[5].doc_id, tables[5].n_tokens, tables[5].ids_sha256, tables[5].decoded_sha256)) == want
