import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import ROWS, documents
from pyspark.sql import functions as F

from tessella.llm import decontamination, vector_codes
from tessella.llm.decontamination import leaks, op12_decontamination, op12_rows
from tessella.llm.vector_codes import compress, nearest, op11_rows, op11_vector_codes


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def leaks_by_force(docs, items):
    """(doc_id, n_words, n_hit, n_items, digest, contaminated) of each document, window by window."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                own = windows.get(tuple(w[i : i + m]))
                if own:
                    hit |= set(range(i, i + m))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def agree(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("class", F.lit(1))
    got = [tuple(r) for r in op12_rows(d, b).collect()] if not options else None
    if options:
        got = [(r.id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in leaks(d, b, **options).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=lambda x: str(key(x))) == sorted(leaks_by_force(docs, items), key=lambda x: str(key(x)))


def spliced(rng, letters, items, n):
    docs = []
    for i in range(n):
        w = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            source = words(rng.choice(items)[1])
            a = rng.randrange(0, len(source) + 1)
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = source[a : a + rng.randrange(1, 25)]
        docs.append((i // 2 if i % 7 == 0 else i, " ".join(w).title() if i % 3 else " - ".join(w)))
    return docs


@pytest.mark.parametrize("letters,shortest", [(["a", "b"], 10), (["a", "b"], 1), (["x1", "é", "日本", "the", "of", "end", "w", "q", "r"], 6), (["x1", "é", "日本", "the", "of"], 1)])
def test_leaks_equal_brute_force(spark, letters, shortest):
    rng = random.Random(f"{letters}{shortest}")
    items = [(i if i % 9 else 3, " ".join(rng.choice(letters) for _ in range(rng.randrange(shortest, 40)))) for i in range(12)]
    items += [(40, items[0][1].upper()), (41, None), (42, " ... "), (None, "no id " * 8)]
    docs = [*spliced(rng, letters, items[:12], 40), (900, None), (901, ""), (902, " ".join(letters * 900)), (None, items[1][1]), (7, items[2][1]), (7, items[2][1])]
    agree(spark, docs, items, **({"map_bits": 1 << 12, "broadcast_rows": 0, "gram": 3} if len(letters) == 2 else {}))


def test_leaks_of_odd_tables(spark):
    items = [(1, "one two"), (2, ROWS[0][1]), (3, "Word word word word word word word word word word word")]
    agree(spark, [r[:2] for r in ROWS], items)
    agree(spark, [r[:2] for r in ROWS], [])
    agree(spark, [], items)


def test_leaks_leave_no_python_in_the_plan(spark, small, capsys):
    op12_decontamination(spark, small).explain("extended")
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
    assert decontamination.WINDOW == 10


def codes_by_force(rows, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), 16, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        code = far.argmin(2)
        if turn < rounds:
            for p in range(16):
                for e in set(code[:, p]):
                    books[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    error = far.min(2).sum(1)
    labels = {}
    for (_, _, label), e in zip(kept, error):
        labels[label] = labels.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in cs), int(e), labels[label], digest) for (i, _, label), cs, e in zip(kept, code, error)]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, v int, codes string").repartition(3)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=32)], int(i % 3) if i % 5 else None) for i in rng.permutation(300)]
    rows += [(7, rows[0][1], 1), rows[1], rows[1], (None, rows[2][1], 2), (400, None, 1), (401, [], 1), (402, [None] * 32, 1), (403, [float("nan")] * 32, 1), (404, [float("inf")] * 32, 1), (405, [0.0] * 32, None)]
    want = sorted(map(str, codes_by_force(rows)))
    assert sorted(str(tuple(r)) for r in op11_rows(vectors(spark, rows)).collect()) == want
    assert sorted(str(tuple(r)) for r in op11_rows(vectors(spark, rows), broadcast_rows=0).collect()) == want
    few = rows[:9]
    assert sorted(str(tuple(r)) for r in op11_rows(vectors(spark, few)).collect()) == sorted(map(str, codes_by_force(few)))
    odd = [*few, (500, [1.0] * 16, 1), (501, [1.0] * 31, 1)]  # other lengths take no part
    assert sorted(str(tuple(r)) for r in op11_rows(vectors(spark, odd)).collect()) == sorted(map(str, codes_by_force(few)))
    assert op11_rows(vectors(spark, [])).count() == 0
    assert op11_rows(vectors(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(ValueError, match="62 bits"):
        compress(vectors(spark, [(1, [1e30] * 16, 1)]))


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16])
def test_bounds_lose_no_nearest_entry(width):
    rng = np.random.default_rng(width)
    for peak in (2, 40, 1 << 24):
        x, book = rng.integers(-peak, peak + 1, (700, width)), rng.integers(-peak, peak + 1, (64, width))
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        code, error, exact = nearest(x, book)
        assert (code == far.argmin(1)).all() and (error == far.min(1)).all() and exact <= 700 * 65


def test_bounds_give_up_most_entries(spark, small):
    rows = vector_codes.integers(spark.read.parquet(f"{small}/embeddings.parquet"), vector="embedding")
    x = np.array([r.v for r in rows.select("v").collect()]).reshape(rows.count(), 16, -1)
    assert sum(nearest(x[:, p], x[:64, p])[2] for p in range(16)) < 0.6 * 64 * 16 * len(x)
    assert op11_vector_codes(spark, small).count() == len(x)


def test_sql_agrees(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for query, sql in ((op12_decontamination, decontamination.OP12_SQL), (op11_vector_codes, vector_codes.OP11_SQL)):
        got, want = query(spark, small), con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
