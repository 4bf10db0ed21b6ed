"""Vector codes, lexical search and personal data against brute-force versions, on the small tables and on awkward rows."""

import gc
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clickflow.llm import lexical_search, personal_data, queries, vector_codes

SF = "/root/testdata/sf0.001"


# --- vector codes -----------------------------------------------------------------

def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label) -> {(id, code, error, label_error, sha)} as a Counter."""
    whole = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not whole:
        return Counter()
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            of = {}
            for _, v, _ in whole:
                of.setdefault(nearest(p, v)[1], []).append(cut(v, p))
            for k, own in of.items():
                new[p][k] = [sum(c) // len(own) for c in zip(*own)]
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, v, label in whole:
        near = [nearest(p, v) for p in range(parts)]
        coded.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), label))
    total = Counter()
    for _, _, e, label in coded:
        total[label] += e
    return Counter((i, c, e, total[label], sha) for i, c, e, label in coded)


VECTORS = "vec_id long, embedding array<float>, label int, id string, code long, v int, own int, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3, "e") for i, v, label in rows], VECTORS)


def collected(df):
    return Counter(map(tuple, df.collect()))


def test_vector_codes_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert collected(queries.op11_vector_codes(spark, SF)) == brute_codes(rows)


def test_vector_codes_awkward(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], rnd.choice([1, 2, None])) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rows += [(1, None, 1), (2, [1.0] * 7 + [None], 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] + [0.0] * 7, None),
             (None, rows[0][1], 7), (5, rows[5][1], None), (5, rows[5][1], None), (-9, [0.0] * 8, None), (50, [0.0] * 8, 2),
             (51, [-0.0005] * 8, 3), (52, [1000.25] * 8, 3)]
    for entries in (4, 256):
        got = vector_codes.vector_codes(vectors(spark, rows), entries=entries)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert collected(got) == brute_codes(rows, entries=entries)
    assert vector_codes.vector_codes(vectors(spark, rows).limit(0)).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1)])).count() == 0
    assert [r["code"] for r in vector_codes.vector_codes(vectors(spark, [(1, [], 1)])).collect()] == ["00000000"]
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)]):
        with pytest.raises(ValueError):
            vector_codes.vector_codes(vectors(spark, bad))
    with pytest.raises(Exception, match="components below"):
        vector_codes.vector_codes(vectors(spark, [(1, [70_000.0] * 4, 1)])).count()


def test_orchard_search_is_exact_with_ties_and_prunes():
    rnd = np.random.default_rng(3)
    # a coarse grid: many equal distances and equal entries
    entries = rnd.integers(0, 4, (200, 3))
    points = rnd.integers(0, 5, (3000, 3))
    code, error, _ = vector_codes.Codebook(entries).nearest(points)
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    # well-separated groups: the lists are left long before their ends
    centres = rnd.integers(-50_000, 50_000, (256, 4))
    points = centres[rnd.integers(0, 256, 2000)] + rnd.integers(-5, 6, (2000, 4))
    code, error, computed = vector_codes.Codebook(centres).nearest(points)
    far = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (code == far.argmin(axis=1)).all() and computed < 0.5 * far.size


# --- lexical search ---------------------------------------------------------------

def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t)
            for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(docs, items, k=50):
    """Counter of (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in items:
        own = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scored = []
        for i, c, size in counted:
            m = 100 - 50 + (50 * size * n) // length
            if score := sum(w * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in own.items() if t in c):
                scored.append((-score, i is None, i or 0, i))
        out.update((item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1))
    return out


def searched(spark, docs, items, folder, k=50, **more):
    d = spark.createDataFrame([(i, t, "s", 1, "q", 7) for i, t in docs], "doc_id long, text string, ids string, rank int, q string, score int")
    b = spark.createDataFrame([(i, t, 5, "x") for i, t in items], "item_id long, text string, q int, item string")
    index = lexical_search.write_index(d.repartition(3), f"{folder}/index-{k}-{len(more)}")
    return collected(lexical_search.search(index, b, k, **more).select("item_id", "rank", "doc_id", "score"))


def test_lexical_search_of_the_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op12_lexical_search(spark, SF)
    assert dict(got.dtypes)["rank"] == "int"
    assert collected(got.select("item_id", "rank", "doc_id", "score")) == brute_search(docs, items)


SEARCHED = [(1, None), (2, ""), (3, " ,.- "), (4, "Alpha beta"), (5, "alpha BETA"), (5, "alpha beta"), (None, "alpha beta"),
            (6, "alpha " * 5000 + "gamma"), (-7, "alpha beta"), (8, "éclair Éclair naïve_alpha 42"), (9, "delta")]
ASKED = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "nothing here"), (None, "Gamma, delta!"), (5, "éclair 42 42")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_lexical_search_awkward(spark, tmp_path, monkeypatch, k):
    assert searched(spark, SEARCHED, ASKED, tmp_path, k) == brute_search(SEARCHED, ASKED, k)
    # one block per few queries
    assert searched(spark, SEARCHED, ASKED, tmp_path, k, block_bytes=100) == brute_search(SEARCHED, ASKED, k)


def test_lexical_search_empty_tables(spark, tmp_path):
    assert not searched(spark, [], ASKED, tmp_path / "a") and not searched(spark, SEARCHED, [], tmp_path / "b")
    assert not searched(spark, [(1, None)], ASKED, tmp_path / "c")


def test_best_positions_equal_full_scores_and_stop_early():
    rnd = np.random.default_rng(1)
    n = 20_000
    lists, scores = [], np.zeros(n, np.int64)
    for share in (0.5, 0.2, 0.1):
        docs = np.sort(rnd.choice(n, int(n * share), replace=False)).astype(np.int32)
        impacts = (rnd.pareto(1.5, len(docs)) * 100).astype(np.int64)
        lists.append(lexical_search.ImpactList(docs, impacts))
        scores[docs] += impacts
    order = np.lexsort((np.arange(n), -scores))
    for k in (1, 10, 50):
        docs, got, looked_up = lexical_search.best_positions(lists, n, k)
        assert docs.tolist() == order[:k].tolist() and got.tolist() == scores[order[:k]].tolist()
        assert looked_up < n / 5
    # a known k-th score elsewhere ends it sooner, and equal scores are kept
    kth = int(scores[order[9]])
    docs, got, sooner = lexical_search.best_positions(lists, n, 50, kth)
    assert docs.tolist() == [d for d in order[:50].tolist() if scores[d] >= kth] and sooner <= looked_up
    # all scores equal: ties go by number, over the whole list
    flat = lexical_search.ImpactList(np.arange(1000, dtype=np.int32)[::-1][::-1], np.full(1000, 5))
    assert lexical_search.best_positions([flat], 1000, 7)[0].tolist() == list(range(7))


def test_a_task_carries_its_best_over_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 7)
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=6))) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert lexical_search.build_index(d.coalesce(2)).count() >= 400 // 7
    assert searched(spark, docs, items, tmp_path, 5) == brute_search(docs, items, 5)


def test_index_rows_and_row_groups_stay_small(spark, tmp_path, monkeypatch):
    """What an executor holds of the index at a time does not grow with the documents of a task."""
    docs = spark.range(600).selectExpr("id as doc_id", "array_join(transform(sequence(1, 400), x -> concat('w', 400 * id + x)), ' ') as text")
    lexical_search.write_index(docs.coalesce(1), f"{tmp_path}/large")
    table = pq.read_table(f"{tmp_path}/large")
    assert sum(table["n_docs"].to_pylist()) == 600
    assert max(pa.Table.from_pylist([r], table.schema).nbytes for r in table.to_pylist()) < 2 << 20
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 7)
    lexical_search.write_index(docs.coalesce(1), f"{tmp_path}/many")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "many").glob("*.parquet")]
    assert sum(m.num_rows for m in files) >= 600 // 7
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 16


def test_a_full_shard_is_freed_at_once():
    shard = lexical_search._Shard()
    shard.add(1, [b"a", b"b", b"a"])
    shard.add(2, [b"b", b"c"])
    assert dict(shard.numbers) == {b"a": 0, b"b": 1, b"c": 2}
    # a cycle would leave it to a collection of garbage, many shards later
    assert all(x is not shard.numbers for x in gc.get_referents(shard.numbers.default_factory))


@pytest.mark.parametrize("searched_postings", [1, 300, 1 << 18])
def test_shards_are_searched_in_groups(spark, tmp_path, monkeypatch, searched_postings):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 40)
    monkeypatch.setattr(lexical_search, "SEARCHED_POSTINGS", searched_postings)
    rnd = random.Random(6)
    docs = [(rnd.choice([None, rnd.randint(-60, 60)]) if i % 9 == 0 else rnd.randint(-500, 500),
             " ".join(rnd.choices(["a", "b", "c", "d e", "é", "f" * 300], k=rnd.randint(0, 12)))) for i in range(300)]
    items = [(1, "a b"), (1, "a b"), (2, "c e unknown"), (None, "f" * 300 + " é"), (3, "unknown"), (4, None)]
    assert searched(spark, docs + SEARCHED, items, tmp_path, 5) == brute_search(docs + SEARCHED, items, 5)


# --- personal data ----------------------------------------------------------------

def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19:
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            if total % 10 == 0:
                out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (personal_data.KINDS.index(s[0]), s[1], s[2])))


def base_row(doc_id, text):
    spans = base_spans(text)
    return (doc_id, *(sum(s[0] == k for s in spans) for k in personal_data.BASE_KINDS), hashlib.sha256(joined(spans).encode()).hexdigest())


def check_spans(rows, docs):
    """Base columns equal; base spans are among all spans; added spans overlap no base span and are in order."""
    assert Counter(tuple(r)[:6] for r in rows) == Counter(base_row(i, t) for i, t in docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t)
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        base = next(base_spans(t) for t in texts[r["doc_id"]] if base_row(r["doc_id"], t) == tuple(r)[:6])
        assert set(base) <= set(spans) and r["spans"] == joined(spans)
        for k, a, b in set(spans) - set(base):
            assert a < b and not any(a < e and s < b for _, s, e in base)


PERSONAL = [
    (1, None), (2, ""), (3, "plain words only"), (4, "a@b.c_d@e.f x@y z@w..v _@_-.-._"), (4, "a@b.c_d@e.f x@y z@w..v _@_-.-._"),
    (5, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.0255 1.2.3"), (None, "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713"),
    (6, "+1 (017) 555-7713 +12 +123 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 call +44 20 7946 0958."),
    (7, "\U0001F600 é me@host.example.com \U0001F600 10.0.0.1"), (8, "7" * 2000), (9, "x" * 2000 + "@" + "y." * 500 + "z"),
    (10, "+" + "1 " * 900), (11, "1." * 900), (12, "a@b.c," * 300), (13, "5500 0000 0000 0004\n4012888888881881 1.1.1.1"),
]


def personal(spark, docs):
    return spark.createDataFrame([(i, t, "k", 5, "c", 1, None) for i, t in docs],
                                 "doc_id long, text string, kind string, start int, content string, at int, matches string")


def test_personal_data_of_the_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_spans(queries.op13_personal_data(spark, SF).collect(), docs)


def test_personal_data_awkward(spark):
    docs = personal(spark, PERSONAL)
    check_spans(personal_data.personal_digest(docs).collect(), PERSONAL)
    assert personal_data.personal_digest(docs.limit(0)).count() == 0
    none = personal_data.personal_digest(personal(spark, [(1, None), (2, "words")])).collect()
    assert [r["spans"] for r in none] == ["", ""]


def test_personal_data_of_long_runs(spark):
    """Runs of a million characters are read once; their spans are known without the (quadratic) brute force."""
    n = 1_000_000
    docs = [(1, "7" * n), (2, "x" * n + "@y.z"), (3, "+" + "1 " * n), (4, "1." * (n // 4)), (5, "x" * n), (6, "a@" + "b." * n + "c")]
    got = {r["doc_id"]: r for r in personal_data.personal_digest(personal(spark, docs)).collect()}
    assert [got[i]["spans"] for i in (1, 3, 5)] == ["", "", ""]
    assert got[2]["spans"] == f"email:0:{n + 4}" and got[6]["spans"] == f"email:0:{2 * n + 3}"
    assert got[4]["n_ip"] == n // 16 and got[4]["spans"].startswith("ip:0:7,ip:8:15,")


def made_texts(rnd, n):
    """Texts with one planted thing each: (text, true span or None). Made from parts unlike the gazetteers' order."""
    names, first = ["Okafor", "Lindqvist", "Moreau", "Tanaka"], personal_data.FIRST_NAMES.split()
    number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    made = [
        lambda: ("Please call me at ", f"({rnd.randint(200, 989)}) {rnd.randint(200, 989)}-{number(4)}", " today", True),
        lambda: ("You can e-mail ", f"jan{number(2)} [at] mail{number(1)} [dot] org", " for it", True),
        lambda: ("social security number ", f"{rnd.randint(100, 660)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9998)}", " on file", True),
        lambda: ("yours, signed by Mr ", f"{rnd.choice(first)} {rnd.choice(names)}", " himself", True),
        lambda: ("as the paper on ", f"{rnd.choice(['Deep', 'Random', 'Great'])} {rnd.choice(['Forests', 'Lakes', 'Rivers'])}", " says", False),
        lambda: ("the value ", number(16), " was measured", None),
        lambda: ("it was seen at ", "home", " again", None),
    ]
    out = []
    for _ in range(n):
        before, span, after, true = rnd.choice(made)()
        text = f"Some words stand here {rnd.random():.3f} and {before}{span}{after}."
        out.append((text, (text.index(before + span) + len(before), text.index(before + span) + len(before) + len(span)), true))
    return out


def test_personal_data_added_spans_on_held_out_texts(spark):
    rnd = random.Random(11)
    texts = made_texts(rnd, 600)
    held_out = texts[300:]
    trained = personal_data.votes(personal_data.candidates(personal(spark, [(i, t) for i, (t, _, _) in enumerate(texts[:300])])))
    model = personal_data.train(trained)
    docs = personal(spark, [(i, t) for i, (t, _, _) in enumerate(held_out)])
    rows = (personal_data.votes(personal_data.candidates(docs)).withColumn("p", personal_data.probability(model))
            .where("p >= 0.5 and not base").join(docs.select("doc_id", F.unhex(F.md5("text")).alias("content")), "content")
            .select("doc_id", "start", "end").collect())
    got = {(r["doc_id"], r["start"], r["end"]) for r in rows}
    wanted = {(i, *span) for i, (_, span, true) in enumerate(held_out) if true}
    clean = {(i, *span) for i, (_, span, true) in enumerate(held_out) if not true}
    assert len(got & wanted) >= 0.9 * len(wanted)
    assert len(got & clean) <= 0.05 * len(clean) and len(got - wanted) <= 0.05 * len(got)


def test_estimated_reliabilities_follow_planted_ones(spark):
    """Votes drawn from known reliabilities: the estimates come near them, without any true label given."""
    rnd, rows = random.Random(4), []
    planted = {"form": (0.9, 0.95), "edges": (0.7, 0.9), "variety": (0.75, 0.75), "gazetteer": (0.9, 0.8), "cue": (0.65, 0.97),
               "against": (0.8, 0.7)}
    for _ in range(20_000):
        true = rnd.random() < 0.3
        rows.append(("card", *((1 if (rnd.random() < yes) == true else -1) if true else (-1 if rnd.random() < no else 1)
                               for yes, no in planted.values())))
    table = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{x} int" for x in planted))
    share, reliable = personal_data.estimate(table.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("n")))["card"]
    assert abs(share - 0.3) < 0.03
    for x, (yes, no) in planted.items():
        assert abs(reliable[x][0] - yes) < 0.05 and abs(reliable[x][1] - no) < 0.05
