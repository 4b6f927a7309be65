import hashlib
import random
import re

import pytest

from cohortspark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for item, of in items:
            v = words(of)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[i : i + n]:
                        hit.update(range(s, s + n))
                        met.add(str(item))
        out.append((doc_id, len(w), len(hit), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("lengths", [[12, 25, 10], [3, 12], [1, 2, 9, 11], [4, 5, 6, 7, 8]])
def test_hits_by_brute_force(spark, lengths):
    draw = random.Random(sum(lengths))
    word = lambda: draw.choice(["ab", "cd", "ef", "Gh", "é1"])
    items = [(i + 9, " ".join(word() for _ in range(n))) for i, n in enumerate(lengths)] + [(2, None), (1, "- -")]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(draw.randrange(12)))]
        for _ in range(draw.randrange(3)):
            chosen = draw.choice(items)[1] or ""
            parts += [chosen.replace(" ", draw.choice([" ", "... ", "\n"])), " ".join(word() for _ in range(draw.randrange(9)))]
        docs.append((i, " ".join(parts)))
    got = d.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = [(r["doc_id"], r["n_words"], r["n_hit"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got.collect()]
    assert sorted(found, key=str) == slow(docs, items)


def test_spans_and_documents_go(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before, it. {passage.title()}! After it."), (2, "Clean: as it was."), (3, None), (4, passage)], "doc_id long, text string")
    assert sorted(r[0] for r in d.remove_documents(docs, items).collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in d.remove_spans(docs, items).collect()}
    assert cut == {1: "Before, it! After it.", 2: "Clean: as it was.", 3: None, 4: ""}


def test_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (1, "two three four five six seven eight nine ten eleven"), (None, "x")], "item_id long, text string")
    met = d.hits(odd_docs, items)
    by = {(r["doc_id"], r["n_hit"]): (r["copies"], r["items"]) for r in met.collect()}
    assert by[1, 10] == (2, ["1"]) and by[7, 10] == (1, ["1"]) and by[6, 1] == (1, [])
    assert met.agg({"copies": "sum"}).first()[0] == odd_docs.count()
    kept = d.remove_documents(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 5
    assert d.remove_spans(odd_docs, items).columns == odd_docs.columns
    assert d.remove_documents(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert d.remove_documents(no_docs, items).count() == 0 and d.hits(no_docs, items).count() == 0
