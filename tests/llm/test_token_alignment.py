"""Token alignment against a plain count over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wirelight.llm import token_alignment
from wirelight.llm.queries import TOKENIZER_A, TOKENIZER_B, tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.load(tokenizer_path(TOKENIZER_A), tokenizer_path(TOKENIZER_B))


def brute(rows, tokenizers):
    """Whole texts, every pair of tokens compared by its byte range, nothing shared with the operator but the vocabularies."""
    per_doc, total = [], Counter()
    for key, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            whole = (" " + text).encode()
            a, b = tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.b.encode(text)
            spans_a, spans_b = _spans(a, tokenizers.a_bytes), _spans(b, tokenizers.b_bytes)
            if b"".join(tokenizers.a_bytes[i] for i in a) == whole == b"".join(tokenizers.b_bytes[i] for i in b):
                n_a, n_b = len(a), len(b)
                links = [(x, y) for (x, lo, hi) in spans_a for (y, low, high) in spans_b if lo < high and low < hi]
                ends = sorted({hi for *_, hi in spans_a} & {hi for *_, hi in spans_b})
                for low, high in zip([0, *ends], ends):
                    groups.append(",".join(str(x) for x, lo, hi in spans_a if low <= lo < high) + "|" + ",".join(str(y) for y, lo, hi in spans_b if low <= lo < high))
        total.update(links)
        per_doc.append((key, n_a, n_b, links, groups))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (key, n_a, n_b, len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for key, n_a, n_b, links, groups in per_doc)


def _spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(table[i])))
        at += len(table[i])
    return out


def corpus():
    rng = random.Random(3)
    rows = [
        (1, None), (2, ""), (3, " "), (4, "a "), (5, "  two  spaces\n\n and lines \n"), (6, "plain <|endoftext|> </s> <s> <unk> text"),
        (7, "a ▁ mark"), (8, "▁"), (9, "naïve 東京 🙂 é   x　 y"), (10, "\x00 \x1c a\x1f b\x85 c"), (11, "tab\t after"), (12, "it's we'll 12 345,6 --- ok"),
        (13, "x" * 700), (14, " " * 40), (15, "\n"), (16, "\r\n end"), (17, "a  b"), (18, "same same same"), (18, "same same same"), (19, "same same same"),
    ]
    words = ["idiom", "naïve", "straße", "the", "of", "ingtion", "3.14", "(x)", "東京", "e-mail", "ré", "ungver"]
    return rows + [(100 + i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", " \n ", "\t"]) for _ in range(rng.randrange(1, 40)))) for i in range(60)]


def found(spark, rows, tokenizers, **limits):
    docs = spark.createDataFrame([(k, t, 5, "x") for k, t in rows], "doc_id long, text string, row int, n_best string").repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in token_alignment.align_tokens(docs, tokenizers, **limits).collect())


def test_equals_the_plain_count(spark, tokenizers):
    rows = corpus()
    assert tokenizers.splits
    assert found(spark, rows, tokenizers) == brute(rows, tokenizers)


def test_many_spills_and_split_parts(spark, tokenizers):
    rows = corpus()
    assert found(spark, rows, tokenizers, spill=30, known=50, split_bytes=40) == brute(rows, tokenizers)
    assert found(spark, rows, tokenizers, spill=1) == brute(rows, tokenizers)


def test_runs_are_sorted_and_share_pairs(tokenizers):
    task, seen = token_alignment._Task(tokenizers), []
    for _, text in corpus():
        one = list(map(task.numbers.__getitem__, tokenizers.parts(text))) if text else []
        task.learn()
        if one and task.counts[one][:, 0].all():
            task.docs.append((task.place, one))
        task.place += 1
        if len(task.docs) >= 5:
            seen.append(list(task.runs(len(seen))))
    keys = []
    for run in (r for spill in seen for r in spill):
        own = token_alignment._keys(run["keys"])
        assert (np.diff(own.astype(np.int64)) > 0).all() and {int(k >> token_alignment.KEY_BITS) % token_alignment.PARTS for k in own} == {run["part"]}
        assert token_alignment.unpack(run["sizes"]).sum() == len(token_alignment.unpack(run["docs"])) == len(token_alignment.unpack(run["times"]))
        keys += own.tolist()
    assert len(seen) > 10 and len(keys) > 2 * len(set(keys))


def test_whole_texts_where_stretches_are_not_allowed(spark, tokenizers):
    whole = token_alignment.Tokenizers(tokenizers.a_json, tokenizers.b_model)
    whole.__dict__["splits"] = False
    texts = [t for _, t in corpus() if t]
    one = whole.align(texts)
    for text, n_a, n_b, good in zip(texts, one.n_a, one.n_b, one.good):
        assert (n_a, n_b) == ((len(whole.a.encode(" " + text).ids), len(whole.b.encode(text))) if good else (0, 0))


def test_long_text_and_one_text_many_times(spark, tokenizers):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdeü") for _ in range(rng.randrange(1, 12))) for _ in range(150_000))
    got = found(spark, [(1, long)] + [(i, "only this") for i in range(2, 500)], tokenizers)
    a, b = len(tokenizers.a.encode(" " + long).ids), len(tokenizers.b.encode(long))
    assert got[0][:3] == (1, a, b)
    links = got[1][4]
    assert {row[4:7] for row in got[1:]} == {(links, got[1][5], got[1][6])} and got[1][6] >= 498 * links


def test_empty_table(spark, tokenizers):
    assert found(spark, [], tokenizers) == []


def test_merge_equals_a_counter():
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 9):
        runs = []
        for _ in range(k):
            keys = np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64))
            runs.append((keys, rng.integers(1, 9, len(keys))))
        total = Counter()
        for keys, counts in runs:
            for key, n in zip(keys.tolist(), counts.tolist()):
                total[key] += n
        keys, counts = token_alignment.merge(runs, block=7)
        assert list(zip(keys.tolist(), counts.tolist())) == sorted(total.items())


def test_best_of_side_keeps_ties():
    keys = np.array([(1 << 24) | 3, (1 << 24) | 5, (1 << 24) | 9, (4 << 24) | 1], dtype=np.uint64)
    assert token_alignment.best_of_side(keys, np.array([2, 7, 7, 1])).tolist() == [False, True, True, True]
