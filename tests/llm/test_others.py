import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import corpus, frame, words
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, licences, mixing, topk
from flowlens.llm.common import stored_at


# --- licences ----------------------------------------------------------------------------------


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_licence_forms(spark):
    mit = dict((name, t) for name, t in reversed(licences.TEXTS))["MIT"]
    forms = [
        mit, mit.upper(), "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.replace("\n", "\r\n  "),
        "(c) Someone, 2021\n* " + mit.replace(",", " ").replace("NONINFRINGEMENT", "non-infringement"), mit + "\nmore",
    ]
    got = {r.doc_id: r for r in licences.scan(texts(spark, [*forms, None, "", " ..\n!"])).collect()}
    assert [got[i].licence for i in range(8)] == ["MIT", "MIT", "MIT", "MIT", None, None, None, None]
    assert all(got[i].licence_digest is None and got[i].licence_notices == [] for i in (5, 6, 7))


def test_notices(spark):
    got = licences.scan(texts(spark, ["a\n  Released under the MIT LICENCE\nb", "Released under the MIT License. More", "licensed under CC-BY-NC 4.0!!"]))
    assert [r.licence_notices for r in got.orderBy("doc_id").collect()] == [["MIT"], [], ["CC-BY-NC-4.0"]]


def test_licences_of_a_given_table(spark):
    own = "Given Licence 1.0\nYou may favour this work, whatever the licences of others say.\nCopyright (c) 2019 Somebody"
    table = spark.createDataFrame([("Own-1.0", own), ("Own-note", "Under the Own Licence."), ("Z", "under the own license"), ("none", "..."), ("null", None)], "licence string, text string")
    values = [
        own.upper().replace("FAVOUR", "FAVOR").replace("LICENCE", "LICENSE"), own.replace("\n", " \r\n * ").replace("2019 Somebody", "2024 Other"),
        own.replace("1.0", "1.1"), "x\nUnder the own license!\ny", "x\nUnder the own license!\ny", "MIT License", None, "...",
    ]
    docs = texts(spark, values).withColumn("licence", F.lit("old")).withColumn("lines", F.lit("kept")).withColumn("known_digest", F.lit(1))
    got = licences.scan(docs, table).orderBy("doc_id").collect()
    assert [r.licence for r in got] == ["Own-1.0", "Own-1.0", None, None, None, None, None, None]
    assert [r.licence_notices for r in got] == [[], [], [], ["Own-note"], ["Own-note"], [], [], []]
    assert all(r.lines == "kept" and r.known_digest == 1 for r in got) and got[0].licence_digest == got[1].licence_digest


def test_every_known_text_is_found(spark):
    rows = [*licences.TEXTS, *licences.NOTICES]
    planted = ["(c) 2020 A\n" + re.sub(r"\bLICENSE\b", "LICENCE", t.upper()).replace(",", " ;") + "\n\nCopyright 2021 B" for _, t in rows]
    got = licences.scan(texts(spark, planted)).orderBy("doc_id").collect()
    assert [(r.licence, t) for r, (_, t) in zip(got, rows, strict=True) if r.licence is None] == []
    assert [r.licence for r in got] == [name for name, _ in rows]


def test_licences_as_sql(spark):
    rows = [(i, t) for i, t, *_ in corpus() if i is not None] + [(900, licences.TEXTS[3][1]), (901, licences.NOTICES[0][1])]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(licences.SQL).fetchall(), key=str)
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found.select("doc_id", "licence_digest", "licence", F.array_join("licence_notices", ",")).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert licences.scan(frame(spark, [])).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def test_mixing_as_sql_and_plain(spark):
    rows = corpus()
    docs = frame(spark, rows)
    mixed = mixing.curriculum(docs, mixing.size_of()).collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = sorted(map(str, con.execute(mixing.SQL).fetchall()))
    assert sorted(str((r.doc_id, r.mix_size, r.mix_source_size, r.mix_target, r.mix_taken)) for r in mixed) == want
    # Targets by plain water-filling.
    size = {}
    for _, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len(words(t))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, still = {}, 1.5 * sum(size.values()), set(names)
    while still:
        level = left / sum(weight[s] for s in still)
        over = {s for s in still if level * weight[s] >= 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in still}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        still -= over
    for s in names:
        own = [r for r in mixed if r.source == s]
        assert all(math.isclose(r.mix_target, target[s]) and r.mix_source_size == size[s] for r in own)
        assert abs(sum(r.mix_taken for r in own) - target[s]) <= max(r.mix_size for r in own)
    assert all(r.mix_taken <= 2 * r.mix_size for r in mixed)


def test_positions_follow_the_schedule(spark):
    mixed = mixing.curriculum(frame(spark), mixing.size_of())
    rows = mixing.ordered(mixed, 3).collect()
    at = [r.mix_position for r in rows]
    assert at == sorted(at) and all(0 <= t <= 1 for t in at)
    assert len(rows) == sum(r.mix_taken // max(1, r.mix_size) for r in mixed.collect())
    one = spark.range(1).select(
        *[mixing.time_of(F.lit(w), F.lit(100.0), F.lit(t)) for w in (0.0, 25.0, 100.0) for t in (-0.5, 0.0, 0.5)]
    ).first()
    for k, (w, t) in enumerate((w, t) for w in (0, 25, 100) for t in (-0.5, 0.0, 0.5)):
        assert math.isclose(100 * ((1 - t) * one[k] + t * one[k] ** 2), w, abs_tol=1e-9)


def test_mixing_empty_and_sizeless(spark):
    assert mixing.curriculum(frame(spark, []), mixing.size_of()).count() == 0
    rows = [(1, None, "x", None, 0, 0.0, 1, "v"), (2, " ", "x", "s", 0, 0.0, 1, "v")]
    assert [r.mix_taken for r in mixing.curriculum(frame(spark, rows), mixing.size_of()).collect()] == [0, 0]


# --- decontamination ---------------------------------------------------------------------------

ITEM = "A train leaves Paris at 9 and runs 80 km per hour. How far has the train from Paris come when it is 12?"
ITEMS = [(1, ITEM), (2, "alpha beta gamma delta epsilon zeta"), (3, "too short"), (4, None), (None, "x " * 20), (1, ITEM)]


def leaks(spark, values, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = decontaminate.with_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    return [[x.item_id for x in r.leaks] for r in sorted(got, key=lambda r: r.doc_id)]


def test_leaks(spark):
    other = ITEM.replace("Paris", "Rome").replace("9", "7").replace("80 km", "60 miles").replace("12", "10")
    torn = ITEM.replace("from Paris", "from Rome")  # one town of the item meets two of the text
    values = [
        "Some words before it. " + ITEM + " And after.", other, torn, ITEM.upper(), "noise " * 5 + ITEM[20:90],
        "He said alpha, beta; GAMMA delta epsilon zeta!", "alpha beta gamma delta", "1 2 3 4 5 6 7 8 9 10 11 12", None, "",
        "too short", "x " * 30, ITEM + "\n" + other,
    ]
    assert leaks(spark, values) == [[1], [1], [1], [1], [1], [2], [], [], [], [], [3], [], [1]]


def test_leaks_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, ITEM, "a", "b")], "doc_id long, text string, leaks_0 string, leaks string")
    row = decontaminate.with_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert row.leaks_0 == "a" and [x.item_id for x in row.leaks] == [1]
    off = decontaminate.with_leaks(spark.createDataFrame([(1, "too short")], "doc_id long, text string"),
                                   spark.createDataFrame(ITEMS, "item_id long, text string"), short_items=False)
    assert off.first().leaks == []


def template(text):
    """(form, value, is slot) of every word, one after the other."""
    out, opens, number = [], True, False
    for word in words(text):
        bare = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡")
        ends = re.search(r"[.!?:][\"')\]”’»]*$", word) is not None
        if bare:
            low, was = bare.lower(), number
            number = bool(re.match(r"^[0-9][0-9.,:/]*$", bare)) or low in decontaminate.NUMBERS
            title = len(bare) > 1 and bare[0].isupper() and bare[1:].islower() and bare.isalpha()
            name = title and not opens and not number
            unit = low in decontaminate.UNITS and was and not number and not name
            form = "<num>" if number else "<unit>" if unit else "<name>" if name else low
            out.append((form, low, number or unit or name))
            opens = False
        opens = opens or ends
    return out


def plain_leaks(texts, items):
    """Every window of every item against every place of every text, by the stated rules."""
    full, literal = decontaminate.WINDOW, decontaminate.LITERAL
    parsed = sorted({(i, t) for i, t in items if i is not None and t is not None})
    forms = {i: template(t) for i, t in parsed}
    texts_of = dict(parsed)

    def enough_literal(ws, least):
        return sum(not w[2] for w in ws) >= least

    def stock(item, b):
        window = [w[1] for w in forms[item][b : b + full]]
        return len({texts_of[i] for i, f in forms.items() if len(f) >= full
                    and any([w[1] for w in f[k : k + full]] == window for k in range(len(f) - full + 1))}) > decontaminate.STOCK

    out = []
    for text in texts:
        doc, found = template(text), []
        for i, item in forms.items():
            n, hits = len(item), {}
            size = min(full, n)
            tests = []
            if n >= decontaminate.SHORTEST:
                at = range(n - size + 1)
                if any(enough_literal(item[b : b + size], min(literal, size)) for b in at):
                    tests.append((size, 0, min(literal, size)))
                else:
                    tests.append((n, 0, decontaminate.LEAST))
                tests.append((size, 1, 0))
            elif n >= 2 and len(doc) == n:
                tests.append((n, 1, 0))
            for size, column, least in tests:
                for b in range(n - size + 1):
                    want = [w[column] for w in item[b : b + size]]
                    for a in range(len(doc) - size + 1):
                        if [w[column] for w in doc[a : a + size]] == want and enough_literal(doc[a : a + size], least):
                            hits.setdefault(a - b, set()).add((a, b, size))
            best = 0
            for windows in hits.values():
                same = {w for w in windows if [x[1] for x in doc[w[0] : w[0] + w[2]]] == [x[1] for x in item[w[1] : w[1] + w[2]]]}
                pairs = {(a + k, b + k) for a, b, size in windows for k in range(size)}
                maps = {(doc[a][0], doc[a][1], item[b][1]) for a, b in pairs if doc[a][2] and doc[a][0] != "<num>"}
                clash = len({(f, x) for f, x, _ in maps}) < len(maps) or len({(f, y) for f, _, y in maps}) < len(maps)
                if clash:
                    pairs = {(a + k, b + k) for a, b, size in same for k in range(size)}
                lone = len({a for a, _, _ in windows}) == 1 and 2 * len(pairs) < n
                if pairs and not (lone and (not same or stock(i, next(iter(windows))[1]))):
                    best = max(best, len(pairs))
            if best:
                found.append((i, best))
        out.append(sorted(found))
    return out


def test_leaks_as_plain_search(spark):
    rng = random.Random(12)
    pool = "the train leaves Paris at nine and runs 80 km per hour how far has it come 12 Rome when is Anna 3 apples of".split()
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 5, 7, 9, 14, 25])))) for k in range(40)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 30]))) for _ in range(20)]
    for k in range(60):  # passages with other numbers and names, some torn
        item = rng.choice(items)[1].split(" ")
        swap = {w: rng.choice([w, w, "Rome", "7", "Oslo"]) for w in ("Paris", "Anna", "80", "12")}
        part = [swap.get(w, w) for w in item[rng.randrange(3) :]]
        if k % 3 == 0 and part:
            part[rng.randrange(len(part))] = rng.choice(pool)
        texts.append(" ".join([*(rng.choice(pool) for _ in range(rng.choice([0, 0, 6]))), *part, "end."]))
    texts += [t for _, t in items[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.with_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = [[(x.item_id, x.words) for x in r.leaks] for r in sorted(rows, key=lambda r: r.doc_id)]
    want = plain_leaks(texts, items)
    assert got == want and sum(map(bool, want)) > 20


def test_leaks_of_items_rich_in_slots(spark):
    items = [
        "What is 15 plus 27 minus 3?", "Is 91 a prime number?", "Who wrote War and Peace?",
        "Add 12, 15, 18 and 21, then divide by 3.", "Convert 3 km 40 m and 5 km 20 m into cm.",
        "7 8 9 and 10 11 12 13 14 15 16", "Add 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 up now",
    ]
    values = [
        *["Noise before. " + t + " Noise after." for t in items], "What is 4 plus 5 minus 1?", "is 7 a prime number",
        "Convert 1 mi 2 ft and 8 mi 9 ft into cm!", "We add 2, 3, 4 and 5 then divide by 6", "What is 4 plus 5 times 1?",
        "1 2 3 and 4 5 6 7 8 9 10", "7 8 9 and 10 11 12 13", items[6].replace("13", "99"), items[6].replace(" 13", ""),
    ]
    want = [[0], [1], [2], [3], [4], [5], [6], [0], [1], [4], [3], [], [], [5], [6], [6]]
    assert leaks(spark, values, list(enumerate(items))) == want


def test_one_clash_leaves_the_rest(spark):
    end = " Then it waits there until the people from the town have come on board with all their bags and goes on to Paris again."
    long = ITEM + end
    fruit = "A box holds 3 apples and 3 pears, so how many of them are left when 3 and 5 are sold?"
    values = [
        long.replace("from Paris", "from Rome"), long.replace("to Paris", "to Rome"), fruit.replace("3 pears", "4 pears"),
        fruit.replace("3 apples and 3", "5 apples and 7"), fruit.replace("3 and 5", "4 and 4"),
    ]
    assert leaks(spark, values, [(1, long), (2, fruit)]) == [[1], [1], [2], [2], [2]]


def test_lone_windows(spark):
    stock = "Which of the following is an example of "
    items = [
        "In 1990 the Senate of Rome was the place where all of the laws were read out by an old man each year.",
        stock + "a gas that warms the air of big towns in summer more than rain does in spring?",
        stock + "words that rhyme when they are read out loud by somebody who comes from far away?",
        stock + "plants whose leaves stay on them in winter although snow covers all of their roots?",
        "In 1990 the Senate of Rome was the place of laws.",
    ]
    values = [
        "We saw that in 1850 the Duke of York was the only guest.", "Tell us which of the following is an example of good style.",
        "He told me that plants whose leaves stay on them in winter.", "It was said that in 1850 the Duke of York was the place where none met.",
        items[0], items[1],
    ]
    assert leaks(spark, values, list(enumerate(items[:4]))) == [[], [], [3], [0], [0], [1]]
    assert leaks(spark, values[:1], [(4, items[4])]) == [[4]]
    assert leaks(spark, values[1:2], [(k, items[1]) for k in range(4)]) == [[0, 1, 2, 3]]  # one text only


def test_long_windows_hash_as_short_ones(monkeypatch):
    with np.errstate(over="ignore"):
        texts = decontaminate.Templates(pa.array(["a 1 b Cde 2 " * 8, "x y", "b 3 c " * 9]))
        monkeypatch.setattr(decontaminate, "WINDOW", 12)
        want = texts.windows(11, False, 2)
        monkeypatch.setattr(decontaminate, "WINDOW", 8)
        got = texts.windows(11, False, 2)
    assert len(want[0]) and all((a == b).all() for a, b in zip(want, got, strict=True))


def test_blocks_of_items_and_empty(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    assert leaks(spark, [ITEM, "alpha beta gamma delta epsilon zeta", "no"]) == [[1], [2], []]
    assert leaks(spark, [ITEM], [(9, None)]) == [[]]
    empty = decontaminate.with_leaks(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert empty.count() == 0


# --- top-k -------------------------------------------------------------------------------------


def vectors(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(n)]
    rows[3:9] = [(i, rows[3][1]) for i in range(3, 9)]  # ties
    rows += [(n, None), (n + 1, [1.0, None] + [0.0] * 6), (n + 2, [float("nan")] + [0.0] * 7), (n + 3, [float("inf")] * 8)]
    rows += [(n + 4, [1.0, 2.0]), (n + 5, [2.0, 1.0]), (None, [1.0] * 8), rows[5], rows[5]]
    return rows


def plain_top(rows, every, k):
    good = [
        (i, np.floor(256 * np.array(v, float))) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, x in {(i, tuple(v)) for i, v in good if i % every == 0}:
        found = sorted((-int(np.dot(x, v)), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("n", [3, 60, 300])
def test_top_k_is_exact(spark, monkeypatch, n):
    monkeypatch.setattr(topk, "INDEX_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rows = vectors(n, max(n, 12))[: n if n < 12 else None]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(frame_, F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 10, 5)


def test_bound_stops_early_and_exactly():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(2000, 6)))
    most = int((x**2).sum(axis=1).max())
    table = topk.lifted(x, x[:32], most, query=False)
    for q in x[:20]:
        mine = topk.lifted(q[None], x[:32], most, query=True)
        bound = ((q**2).sum() + most - np.abs(table - mine).max(axis=1) ** 2) / 2
        assert (bound + topk.SLACK >= x @ q).all()
        ids, scores = topk.best_of(q, bound, np.arange(2000), x, -1, 5)
        assert ids.tolist() == np.lexsort((np.arange(2000), -(x @ q)))[:5].tolist()


def test_top_k_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 10 == 0, 5).count() == 0


def test_top_k_copies_no_queries(spark):
    rows = [(i, v) for i, v in vectors(1, 300) if v is not None and i is not None]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Once a copy of the queries per group of index blocks was broadcast, through the driver.
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan


def test_top_k_carries_the_best_over_blocks():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(600, 6)))
    x[300:] = x[:300]  # ties across blocks
    for q in x[:20]:
        held = np.zeros(5, np.int64), np.full(5, -np.inf)
        for lo in (400, 200, 0):
            ids = np.arange(lo, lo + 200)
            held = topk.best_of(q, x[ids] @ q, ids, x[ids], 3, 5, held)
        others = np.delete(np.arange(600), 3)
        assert held[0].tolist() == others[np.lexsort((others, -(x[others] @ q)))[:5]].tolist()


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_top_k_of_wide_components(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "INDEX_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [scale * float(x) for x in rng.integers(-4, 5, 3) * (i % 7 == 0)]) for i in range(60)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 10, 5)


def test_packed_widths():
    for top, width in ((32767, 2), (-32768, 2), (32768, 4), (-(2**31), 4), (2**31, 8)):
        data = topk.packed(np.array([[top, 0]]))
        assert len(data) == 2 * width and topk.unpacked(data, 1, 2).tolist() == [[top, 0]]
    assert topk.unpacked(topk.packed(np.zeros((3, 0), np.int64)), 3, 0).shape == (3, 0)


def test_blocks_are_stored_in_small_row_groups(spark):
    def rows(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng().bytes(1 << 20)])], names=["vectors"])

    _, path = stored_at(spark.range(40).coalesce(1).mapInArrow(rows, "vectors binary"), **topk.ROW_GROUPS)
    (file,) = Path(path.removeprefix("file:")).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 40 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 20 << 20
