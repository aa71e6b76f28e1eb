import random
import re
from collections import Counter

import pyarrow as pa

from kappaloom.llm import decontaminate as dc
from kappaloom.llm.decontaminate import benchmark_blocks, benchmark_leaks, without_leaks


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(docs, items, threshold=0.8):
    out = []
    for d, text in docs:
        ws = tokens(text)
        for i, t in items:
            own = tokens(t)
            k, n = min(5, len(own)), min(len(own), len(ws))
            if not own or n < k:
                continue
            a = Counter(tuple(own[j:j + k]) for j in range(len(own) - k + 1))
            best = (0.0, 0)
            for w in range(len(ws) - n + 1):
                b = Counter(tuple(ws[w + j:w + j + k]) for j in range(n - k + 1))
                s = sum((a & b).values()) / sum((a | b).values())
                if s > best[0]:
                    best = (s, w)
            if best[0] >= threshold:
                out.append((d, i, best[0], best[1], n))
    return sorted(set(out), key=repr)


def make(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("stuvw") + str(rnd.randint(0, 25))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 5, 9, 20, 41])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "A b C d E f G h i J"), (23, "la la la la la la la la la la la la")]
    docs = []
    for d in range(120):
        ws = [word() for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.7:
            own = tokens(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 3)):
                if own:
                    at = rnd.randrange(len(own))
                    own[at:at + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
            cut = rnd.randint(0, len(ws))
            ws[cut:cut] = own
        docs.append((d, " ".join(ws)))
    docs += [(500, None), (501, ""), (502, "la " * 300), (503, items[3][1].upper()), (None, items[4][1])]
    return docs, items


def run(spark, docs_of, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in benchmark_leaks(docs_of(docs), benchmark_blocks(table)).collect()), key=repr)


def test_against_brute_force(spark, docs_of):
    for seed in (1, 2):
        docs, items = make(seed)
        assert run(spark, docs_of, docs, items) == brute(docs, items)


def test_items_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    docs, items = make(3)
    assert len(benchmark_blocks(spark.createDataFrame(items, "item_id long, text string"))) > 2
    assert run(spark, docs_of, docs, items) == brute(docs, items)


def test_contaminated_rows_go(spark, docs_of):
    docs, items = make(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    kept = without_leaks(docs_of(docs), benchmark_blocks(table))
    assert kept.columns == docs_of([]).columns
    bad = {d for d, *_ in brute(docs, items)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _ in docs if d not in bad), key=repr)


def test_empty_tables(spark, docs_of):
    docs, items = make(5)
    assert run(spark, docs_of, [], items) == [] and run(spark, docs_of, docs, []) == []
    assert without_leaks(docs_of(docs), []).count() == len(docs)


def test_pairs_compared_do_not_grow_with_the_benchmark(monkeypatch):
    """Items with a common phrase, of which few have anything else in common with the texts."""
    rnd = random.Random(6)
    words = lambda n: " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(n))
    items = [(i, "which of the following is true about " + words(30)) for i in range(4000)]
    texts = [words(200) + " which of the following is true about " + words(200) for _ in range(20)]
    texts += [words(50) + " " + items[i][1] + " " + words(50) for i in range(10)]
    compared = []
    near = dc.LeakFinder._near
    monkeypatch.setattr(dc.LeakFinder, "_near", lambda self, p, item: compared.append(len(item)) or near(self, p, item))
    seen = {}
    for n in (200, 4000):
        compared.clear()
        found = dc.Benchmark(items[:n], 5, 24, 0.8).find(pa.array(texts))
        assert [(t, i, s) for t, i, s, *_ in found] == [(20 + i, i, 1.0) for i in range(10)]
        seen[n] = sum(compared)
    assert seen[4000] <= 1.1 * seen[200] < 2000


def test_windows_in_small_portions(spark, docs_of, monkeypatch):
    monkeypatch.setattr(dc, "PAIRS", 7)
    docs, items = make(7)
    assert dc.Benchmark([(i, t) for i, t in items if t], 5, 24, 0.8).find(
        pa.array([t for _, t in docs])) == sorted(
        [(d, *found) for d, (i, t) in enumerate(docs) for (_, *found) in brute([(i, t)], items)],
        key=lambda r: (min(5, len(tokens(dict(items)[r[1]]))), r[0], [i for i, t in items if t].index(r[1])))
