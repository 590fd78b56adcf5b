"""The filter audit against plain loops over documents and orders, with weak hashes too."""

import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tremor.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, mask string, n long"


def rows(seed=5):
    rng = random.Random(seed)
    words = [a + b for a, b in itertools.product("ba ke li mo nu".split(), repeat=2)]

    def prose(n, kinds):
        return " ".join(rng.choice(words[:kinds]) for _ in range(n))

    texts = [None, "", " \n", "a\xa0b " * 60, "A" * 40, "é" * 600, "AB " * 60, prose(60, 25) + " #", prose(200, 25), "x " * 70000]
    texts += [prose(rng.choice([10, 55, 300]), rng.choice([4, 25])) + rng.choice(["", " $5", " ABCDEFGHIJKLMNOPQRSTU"]) for _ in range(25)]
    texts += ["p" * 800 + "a", "p" * 800 + "b", "q" * 100 + "a" + "p" * 700, "q" * 100 + "b" + "p" * 700]
    texts += [rng.choice(texts) for _ in range(30)]
    found = [(i, t, rng.choice(["s1", "s1", "s2", "", None]), "x", "y", 1) for i, t in enumerate(texts)]
    return [*found, found[8], found[8], (None, texts[8], "s1", "x", "y", 1), (None, texts[8], "s2", "x", "y", 1), (None, None, None, None, None, None)]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999, 1, 1)]


def by_loops(docs, labels):
    first = {}
    for r in docs:
        t = r[1] or ""
        if r[0] is not None:
            first[t] = min(first.get(t, r[0]), r[0])
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    parts = defaultdict(list)
    for r in docs:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if r[0] is not None and r[0] > first[t] else set()
        parts[r[2] or ""].append((fails, r[0] in good, r[0] in toxic))
    out = []
    for part, ds in parts.items():
        shapley = defaultdict(int)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = list(ds)
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                early = sum(1 for d in ds if f in d[0] and d[0] & set(order[:k]))
                alone = sum(1 for d in ds if d[0] == {f})
                steps.append((part, "".join(order), k + 1, len(left), len(gone), early, alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 1, 0])
def test_audit_matches_plain_loops(spark, monkeypatch, bits):
    """With hashes of one bit or none, only the comparison of texts tells documents apart."""
    if bits < 64:
        monkeypatch.setattr(filter_audit, "block_hash", lambda part: F.xxhash64(part).bitwiseAND(F.lit(2**bits - 1)))
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == by_loops(rows(), LABELS)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    got = filter_audit.audit(one, labels).collect()
    assert len(got) == 600 and {r.shapley for r in got if r.filter_order[r.step - 1] == "A"} == {120}


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "AB cd " * 500 + "x" * 3000 + " y"
    whole = filter_audit.failing(text)
    monkeypatch.setattr("tremor.llm.common.pieces.__defaults__", (7,))
    assert filter_audit.failing(text) == whole
