"""The corpus pipeline, stage by stage, against plain Python over the same rows."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRETS = (
    re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}"""),
    re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}"),
)


def _shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _smallest_of_groups(docs):
    sets, head = {i: _shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i for i in ids if find(i) == i}


def _plain(text):
    return "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower()).split()


def test_stages_against_plain_python(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    # columns whose names the operators use inside must not matter
    docs = docs.withColumns({c: F.lit(1) for c in ("_spans", "_base", "_leaks", "_score", "_key", "klass", "slot")})
    states = [{r.doc_id: r for r in docs.collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows = docs.collect()
        states.append({r.doc_id: r for r in rows})
        assert len(rows) == len(states[-1]) > 0
    start, good, single, clean, safe, mixed = states

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [(i in good) == bool(q) for i, q in labels.items() if i in start and q is not None]
    assert sum(right) >= 0.9 * len(right)

    assert set(single) == _smallest_of_groups({i: r.text for i, r in good.items()})

    items = [_plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = [f" {' '.join(w)} " for w in items if len(w) >= 5]
    seeds = {tuple(w[k : k + 5]) for w in items for k in range(len(w) - 4)}
    for i, r in single.items():
        words = _plain(r.text)
        if any(w in f" {' '.join(words)} " for w in whole):
            assert i not in clean
        if not any(tuple(words[k : k + 5]) in seeds for k in range(len(words) - 4)):
            assert i in clean

    assert set(safe) == set(clean)
    for i, r in safe.items():
        if r.text == clean[i].text:
            assert not any(p.search(r.text or "") for p in SECRETS)
        else:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)

    assert set(mixed) == set(safe)
    assert sorted(r.position for r in mixed.values()) == list(range(len(mixed)))


def test_groups_are_of_rows_with_missing_and_repeated_ids(spark, sf_dir):
    texts = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["c"]), (7, texts["c"]), (5, texts["d"]), (5, texts["d"]), (5, texts["e"]), (4, texts["e"]), (8, texts["f"]), (8, texts["f"] + " more"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "")[:1]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (None, "b"), (7, "c"), (5, "d"), (4, "e"), (8, "f"), (None, ""), (None, "")], key=str)
