"""Similarity joins, neighbours, decontamination, token ledger, pipeline: against brute force."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from needlework.llm import ann, components, decontaminate, jaccard, rollup
from needlework.llm.common import table
from needlework.llm.queries import queries
from needlework.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


# -- components


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 900)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(root) if find(n) != n}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- Jaccard join


def sets_of(text, n):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_components(texts, n, threshold):
    sets = [sets_of(t, n) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= threshold:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


def near_texts(seed, groups=6, copies=30):
    r = random.Random(seed)
    words = ["the", "of", *(f"w{i}" for i in range(400))]
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = [None, "", " \t\x0b", "One two", "one TWO", "É é", "é é", "a\xa0b c"]
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(4, 120))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                own[r.randrange(len(own))] = r.choice(words)
            texts.append(" ".join(own) + (f" {passage}" if r.random() < 0.3 else ""))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("n", "num", "den", "part"), [(3, 9, 10, 4000), (5, 8, 10, 4000), (3, 9, 10, 7), (2, 1, 2, 12)])
def test_jaccard_components(spark, n, num, den, part):
    texts = near_texts(n + part)
    docs = frame(spark, texts).withColumn("size", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, num, den, part_sets=part).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, n, Fraction(num, den))


def test_jaccard_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 1)  # every list counts as long
    texts = near_texts(77, groups=3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts, 3, Fraction(9, 10))]


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    same = "a b c d e f g"
    docs = frame(spark, [same, same, same, "other words here", "other words here", None], [5, 5, None, None, None, None])
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert rows == sorted([(5, 5, 5), (5, 5, 5), (None, 5, 5), (None, 1, None), (None, 1, None), (None, 0, None)], key=str)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1
    with pytest.raises(ValueError):
        jaccard.jaccard_components(docs, 3, 11, 10)


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " end"
    rows = [(1, c), (5, a), (5, b), (7, near), (9, b), (None, a), (None, "lonely words of no one"), (3, None), (5, "")]
    found = jaccard.jaccard_components(frame(spark, [t for _, t in rows], [i for i, _ in rows]), 3, 8, 10)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == sorted([(1, 38, 1), (5, 38, 5), (5, 38, 5), (7, 39, 5), (9, 38, 5), (None, 38, 5), (None, 2 + 1, None), (3, 0, 3), (5, 0, 5)], key=str)
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns({"kept": F.lit(1), "row_no": F.lit(2)})
    kept = jaccard.keep_one(docs, 3, 8, 10)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, c), (5, a), (5, b), (None, "lonely words of no one"), (3, None), (5, "")], key=str)


def test_keep_one(spark):
    texts = near_texts(5)
    kept = {r.doc_id for r in jaccard.keep_one(frame(spark, texts)).collect()}
    assert kept == {c for _, c in brute_components(texts, 5, Fraction(8, 10))}


# -- nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))


def brute_nearest(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scored = {}
            for j, x in good:
                if j != i:
                    s = 0.0
                    for a, b in zip(q, x, strict=True):
                        s += a * b
                    scored[j] = max(s, scored.get(j, -np.inf))
            out[i] = sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_exhaustive_when_leaves_are_few(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=6).tolist()) for i in range(60)]
    rows += [(i, [1.0, 0, 0, 0, 0, 0]) for i in range(100, 140)]
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0, 0, 0, 0]), (260, [float("nan")] * 6), (280, [float("inf"), 0, 0, 0, 0, 0]), (300, [1.0]), (None, [1.0] * 6), (20, rows[20][1])]
    docs = vectors(spark, rows).withColumn("score", F.lit("x")).withColumn("leaf", F.lit(1))
    got = defaultdict(list)
    for x in ann.nearest(docs, every=20, k=20, index=ann.build_index(docs, target=1.0)).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    expected = brute_nearest([x for x in rows if x[1] is None or len(x[1]) == 6], 20, 20)
    assert {q: [(i, round(s, 9)) for i, s in own] for q, own in got.items()} == {q: [(i, round(s, 9)) for i, s in own] for q, own in expected.items()}


@pytest.mark.parametrize("part", [4096, 40])
def test_recall_on_the_table(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "PART_ROWS", part)
    docs = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in docs.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    index = ann.build_index(docs, leaf_rows=60)
    assert len(index.tree.leaf) > 20 and index.visits < len(index.tree.leaf)
    found = defaultdict(dict)
    for r in ann.nearest(docs, index=index).collect():
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.argsort(-score)[:20]].tolist())
        assert sorted(found[q]) == list(range(1, 21))
        own = [found[q][k] for k in range(1, 21)]
        assert own == sorted(own, key=lambda t: (-t[1], t[0])) and q not in {i for i, _ in own}
        hits += len(best & {i for i, _ in own})
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.9


def test_ann_edges(spark):
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert ann.nearest(vectors(spark, [(0, None), (20, [0.0])])).count() == 0
    assert ann.nearest(vectors(spark, [(1, [1.0, 2.0]), (3, [1.0, 2.0])])).count() == 0
    two = ann.nearest(vectors(spark, [(0, [1.0, 2.0]), (3, [1.0, 2.0]), (2, [1.0, 2.0])])).orderBy("rank").collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in two] == [(0, 1, 2, 5.0), (0, 2, 3, 5.0)]


# -- decontamination

ITEM = "A train leaves Paris at 60 km per hour and Anna rides it for 3 hours while her brother walks 5 miles to the old station near the river"


def leaks(spark, texts, items, **more):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = frame(spark, texts).withColumn("item_id", F.lit(5)).withColumn("h", F.lit("x"))
    return {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(docs, bench, **more).collect()}


def test_templates(spark):
    other = ITEM.replace("Paris", "Lyon").replace("60", "75").replace("Anna", "Maria").replace("3 hours", "4 hours")
    unlike = ITEM.replace("60 km", "60 km and 60 km and 60 km")
    mixed = "He walks. " + other + ". And so on and on."
    noise = "the old station near the river is closed while her brother sleeps and nobody walks there any more today"
    texts = [ITEM, other, mixed.upper().lower(), mixed, noise, None, "", ITEM]
    found = leaks(spark, texts, [ITEM, None, "", "one two", noise[:40]])
    assert {(0, 0), (1, 0), (3, 0), (7, 0)} <= found
    assert {(4, 0), (5, 0), (6, 0)}.isdisjoint(found) and not any(i in (1, 2, 3) for _, i in found)
    assert (4, 4) in found
    assert unlike


def test_slots_must_agree(spark):
    item = "Tom has 5 red apples and Tom buys 5 more red apples so that he has many red apples and then 5 pears in his big basket"
    same = item.replace("5", "8").replace("Tom", "Kim")
    mixed = "Tom has 1 red apples and Tom buys 2 more red apples so that he has many red apples and then 3 pears in his big basket"
    assert leaks(spark, [same, mixed, item], [item]) == {(0, 0), (2, 0)}
    assert leaks(spark, [same, mixed, item], [item], min_consistent=0.0) == {(0, 0), (1, 0), (2, 0)}


def test_one_consistent_occurrence_is_enough(spark):
    item = "A train leaves Paris at 9 and travels 120 km. How far does Alice walk in 3 hours?"
    other = item.replace("Paris", "Lyon").replace("9", "7").replace("120", "80").replace("Alice", "Maria").replace("3 hours", "5 hours")
    third = item.replace("Paris", "Rome").replace("9", "4").replace("120", "60").replace("Alice", "Kim").replace("3 hours", "2 hours")
    longer = lambda t: t.replace(" How far", " So how far")
    texts = [item, other, f"{item} {other}", f"{other} {third}", f"{third}\n{other}\n{item}", f"{longer(other)} {longer(third)}"]
    assert leaks(spark, texts, [item]) == {(i, 0) for i in range(6)}
    assert decontaminate.drop_leaks(frame(spark, texts), spark.createDataFrame([(0, item)], "item_id long, text string")).count() == 0


def test_windows_of_slots_are_met_verbatim(spark):
    items = ["Who Wrote Hamlet And Macbeth", "2 + 2 = 4 ; 3 + 3 = 6", "add 1 2 3 4 5 6 7 8 9 to the sum of both"]
    texts = [f"Well. {t}? So it is." for t in items] + ["2 + 2 = 5 ; 3 + 3 = 7", items[2].replace("1 2 3", "4 3 2")]
    assert leaks(spark, texts, items) == {(0, 0), (1, 1), (2, 2), (4, 2)}


def test_case_hides_no_copy(spark):
    items = ["A train leaves Paris at 9 and travels 120 km. How far does Alice walk in 3 hours?", "Yesterday Bob And Carol Met Dave Near Big Ben In London"]
    texts = [f(t) for t in items for f in (str, str.lower, str.upper, str.title)] + [items[0].replace("Paris", "Lyon").replace("Alice", "Maria")]
    assert leaks(spark, texts, items) == {(i, i // 4) for i in range(8)} | {(8, 0)}


def test_leaks_of_the_corpus(spark):
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in words(r.text)}
    found = decontaminate.benchmark_leaks(docs, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert whole and whole <= got
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert kept == set(range(1000)) - {d for d, _ in got}


def test_decontamination_edges(spark):
    assert leaks(spark, [], [ITEM]) == set()
    assert leaks(spark, [ITEM], []) == set()
    assert leaks(spark, [ITEM, ITEM + " x"], ["one two three four five six"]) == set()
    docs = frame(spark, [ITEM, ITEM, "fine"], [None, 3, 3])
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert [r.text for r in decontaminate.drop_leaks(docs, bench).collect()] == ["fine"]
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns


# a plain version of the decontamination, by its definition

UNIT = rf"(\x02\d+) ?\x01?({decontaminate.UNITS})(?![\p{{L}}\p{{N}}])"


def plain_tokens(text):
    t = regex.sub(r"[\x01-\x03]", " ", text)
    t = regex.sub(r"(?<=[\p{L}\p{N},;:)] )(\p{Lu}\p{Ll}+)", "\x01\\1", t)
    if regex.search(r"[0-9]", text):
        t = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", t)
        t = regex.sub(r"(?<![\p{L}0-9])([0-9]+)(?![0-9])", "\x02\\1", t)
        t = regex.sub("(\x02[0-9]+) ?%", "\\1 \x03percent", t)
        t = regex.sub("[$€£] ?(?=\x02)", " \x03currency ", t)
        t = regex.sub(UNIT, "\\1 \x03\\2", t, flags=regex.I)
    return [x for x in regex.split(r"[^\p{L}\p{M}\p{N}\x01-\x03]+", t.lower()) if x]


def plain_leaks(texts, items, coverage=0.6, consistent=0.8):
    kind = lambda t: ord(t[0]) if ord(t[0]) <= 3 else 0
    bare = lambda t: t[1:] if kind(t) else t
    forms = lambda ts: ([kind(t) or t for t in ts], [bare(t) if kind(t) == 1 else kind(t) or t for t in ts], [bare(t) for t in ts])
    value = lambda t: bare(t) if kind(t) == 1 else t
    literals = lambda w: sum(isinstance(x, str) for x in w)
    out = set()
    for k, item in enumerate(items):
        own = plain_tokens(item or "")
        m = min(len(own), decontaminate.WINDOW)
        if not own:
            continue
        h, p, v = forms(own)
        places = range(len(own) - m + 1)
        cut = lambda form, i: tuple(form[i : i + m])
        wanted = set()
        for i in places:
            typed, worded = literals(cut(h, i)) >= 2, literals(cut(p, i)) >= 2
            wanted |= {(cut(h, i), i, typed)} if typed else set()
            wanted |= {(cut(p, i) if worded else cut(v, i), i, typed)}
        slotted, n = any(isinstance(x, int) for x in h), len(own)
        every, templates = {i for _, i, _ in wanted}, {i for _, i, typed in wanted if typed}

        def enough(places):
            met, of = {i for i, _ in places}, {i for i, typed in places if typed}
            return len(met) >= coverage * len(every) or (templates and len(of) >= coverage * len(templates))

        for d, text in enumerate(texts):
            found = plain_tokens(text or "")
            if not found or (m < decontaminate.MIN_TOKENS and len(found) != m):
                continue
            shapes = [{cut(form, j) for form in forms(found)} for j in range(len(found) - m + 1)]
            met = {(i, j, typed) for w, i, typed in wanted for j, own_forms in enumerate(shapes) if w in own_forms}
            if not enough({(i, typed) for i, _, typed in met}):
                continue
            support = Counter(j - i for i, j, _ in met)
            bands = {}
            half = max(1, n // 2)
            for i, j, typed in met:
                s = j - i
                for band in [(0, s), (1, s // half), (1, s // half - 1), (2, 0)] if slotted else [(2, 0)]:
                    best = bands.setdefault(band, {})
                    best[i, typed] = max(best.get((i, typed), (0, -(1 << 60))), (support[s], s))
            for best in bands.values():
                if not enough(set(best)):
                    continue
                pairs = {(value(own[i + x]), value(found[i + s + x])) for (i, _), (_, s) in best.items() for x in range(m) if kind(own[i + x])}
                forth, back = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
                ok = [forth[a] == 1 and back[next(b for c, b in pairs if c == a)] == 1 for a in forth]
                if not ok or sum(ok) / len(ok) >= consistent:
                    out.add((d, k))
                    break
    return out


@pytest.mark.parametrize("most,bits", [(decontaminate.BROADCAST_WINDOWS, decontaminate.SIEVE_BITS), (3, decontaminate.SIEVE_BITS), (3, 7)])
def test_leaks_by_definition(spark, monkeypatch, most, bits):
    """Windows that are broadcast, and those that are sieved for and shuffled, few bits included, give the same leaks."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", bits)
    r = random.Random(12)
    names, things = ["Anna", "Ben", "Cleo", "Dan"], ["apples", "red pens", "stones"]
    shapes = ["{a} has {x} {t} and gives {y} of them to {b}. How many {t} has {a} now?", "A car drives {x} km in {y} hours, then {a} drives {x} km back.", "What is {x} + {y} - {x}?", "Is it {a}", "{x} {y} {x} {y} {z} {x}"]

    def fill(shape):
        a, b = r.sample(names, 2)
        return shape.format(a=a, b=b, t=r.choice(things), x=r.randint(1, 9), y=r.randint(10, 99), z=r.randint(100, 999))

    items = [fill(s) for s in shapes for _ in range(2)] + ["Yes", "so it is", None, ""]
    texts = [None, "", "yes", "So it is!", "so it is not"]
    for _ in range(60):
        parts = [fill(r.choice(shapes)) if r.random() < 0.6 else r.choice([x for x in items if x]) for _ in range(r.randint(1, 3))]
        words = " ".join(parts).split()
        if r.random() < 0.5:
            words = [w for w in words if r.random() > 0.06]
        texts.append(("Well, " if r.random() < 0.5 else "") + " ".join(words))
    expected = plain_leaks(texts, items)
    assert leaks(spark, texts, items) == expected and len(expected) > 40


def test_leaks_whatever_columns_are_called(spark):
    docs = frame(spark, [ITEM, "fine"]).withColumns({c: F.lit("x") for c in ("leaked", "row_key", "t", "band", "m", "window")})
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string").withColumn("leaked", F.lit(1))
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == ["fine"]


# -- token ledger


def test_ledger(spark):
    import public_tokenizers

    counter = {"v": (vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}
    own = rollup.BytePairs(*counter["v"])
    texts = ["one two", None, "", "one two", "three é" * 9]
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{i % 2}", 0) for i, t in enumerate(texts)], SCHEMA).withColumn("tokens", F.lit("x"))
    counts = rollup.count_tokens(docs, counter)
    ledger = rollup.TokenLedger(spark)
    assert ledger.totals().count() == 0
    assert ledger.insert("a", counts) and not ledger.insert("a", counts)
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.chars) for r in ledger.totals().collect()}

    def expected(rows):
        out = {}
        for i, t, n in rows:
            key = (None if i == 4 else f"s{i % 2}", "en", "v")
            d, k, c = out.get(key, (0, 0, 0))
            out[key] = (d + 1, k + n, c + len(t or ""))
        return out

    rows = [(i, t, own.count(t)) for i, t in enumerate(texts)]
    assert total() == expected(rows)
    surplus = rollup.surplus_copies(docs)
    assert [r.doc_id for r in surplus.collect()] == [3]
    assert ledger.delete("b", surplus) and not ledger.delete("b", surplus)
    rows = [x for x in rows if x[0] != 3]
    assert total() == expected(rows)
    assert ledger.delete("again", surplus) and total() == expected(rows)  # nothing held any more
    revised = counts.where("doc_id = 0").withColumn("tokens", F.lit(100).cast("long"))
    assert ledger.revise("c", revised) and total() == expected([(i, t, 100 if i == 0 else n) for i, t, n in rows])
    assert ledger.batches() == ["a", "again", "b", "c"]
    with pytest.raises(ValueError):
        ledger.insert("../x", counts)
    assert rollup.count_tokens(docs.where("false"), counter).count() == 0


def test_first_writer_of_a_batch_counts(spark):
    ledger = rollup.TokenLedger(spark)
    rows = spark.createDataFrame([(1, "s", "en", "v", 1, 5, 9)], rollup.ROWS)
    assert ledger.commit("a", rows)
    late = f"{ledger.path}/staged/late"
    rows.write.parquet(f"{late}/rows")
    assert not ledger._publish(late, f"{ledger.path}/batches/a")
    assert not ledger._fs.exists(ledger._path(late))
    assert sorted(x.getPath().getName() for x in ledger._fs.listStatus(ledger._path(f"{ledger.path}/batches/a"))) == ["rows", "totals"]
    assert ledger.totals().first().tokens == 5


@pytest.mark.parametrize("drop", [False, True])
def test_compaction_keeps_totals(spark, drop):
    ledger = rollup.TokenLedger(spark)
    rows = [(i, "s", "en", "v", 1, i, 2 * i) for i in range(20)]
    ledger.commit("a", spark.createDataFrame(rows, rollup.ROWS))
    total = lambda: [tuple(r) for r in ledger.totals().collect()]
    assert ledger.compact(drop) and not ledger.compact(drop)
    assert total() == [("s", "en", "v", 20, 190, 380)]
    assert not ledger.commit("a", spark.createDataFrame(rows, rollup.ROWS))
    ids = spark.createDataFrame([(3,), (4,)], "doc_id long")
    assert ledger.delete("b", ids) and ledger.compact(drop) and ledger.delete("c", ids) and ledger.compact(drop)
    assert total() == [("s", "en", "v", 18, 183, 366)] and ledger.held(ids).count() == 0
    assert ledger.batches() == ["a", "b", "c"] and ledger._names("generations") == ["000000001", "000000002", "000000003"]


def test_counts_of_the_query(spark):
    """The registered query against plain counting: single line ends, smallest id of each text."""
    import public_tokenizers

    docs, expected, known = sorted(table(spark, SF, "documents").collect(), key=lambda x: x.doc_id), {}, set()
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        counter, known = rollup.BytePairs(vocabulary_path(f"{version}.tiktoken"), public_tokenizers.PATTERN), set()
        for x in docs:
            if x.text not in known:
                known.add(x.text)
                t = re.sub("\n{2,}", "\n", x.text)
                n = expected.setdefault((x.source, x.lang, version), [0, 0, 0])
                for k, v in enumerate((1, counter.count(t), len(t))):
                    n[k] += v
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens, r.chars] for r in queries()["op8_token_counts"](spark, SF).collect()}
    assert got == expected


# -- pipeline


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage_table(stage(spark, docs, SF), name)
        assert out.schema.names == docs.schema.names
        assert 0 < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_odd_rows(spark):
    r = random.Random(6)
    clean = [" ".join(r.choice(["ando", "therin", "edble", "stou", "hand"]) + str(i) for _ in range(60)).translate(str.maketrans("0123456789", "qwertzuiop")) for i in range(12)]
    docs = frame(spark, [None, "", *clean, clean[0]]).withColumn("key", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage_table(stage(spark, docs, SF), name)
    assert sorted(r.doc_id for r in docs.collect()) == list(range(14))


def test_pipeline_run(spark, monkeypatch):
    """run() leaves what the stages give one by one, and only its result stays staged."""
    from needlework.llm import common

    began = common.staged_so_far()
    rows = corpus_pipeline.run(spark, SF)
    assert common.staged_so_far() == began + 1
    docs = table(spark, SF, "documents")
    assert 0 < rows.select("doc_id").distinct().count() < docs.count() and rows.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


ODD = ["window", "pos", "rank", "length", "shard", "slot", "key", "kept", "leaked", "row_key", "h", "t", "v", "spans", "score", "leaf", "bin", "component_id", "n_shingles", "tokens", "docs", "row_no", "size", "m"]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Nulls, empty and very long texts, repeated rows, ids twice, extra columns named like internal ones; and empty tables."""
    at = tmp_path_factory.mktemp("odd")
    more = {c: F.lit("x") for c in ODD}
    long_text = " ".join(f"word{i % 977} idiot trash can, call +1 555 0{i % 1000:03d} 9999;" for i in range(18_000))
    same = "the very same text that stands here again and again"
    rows = [(1, None), (2, ""), (3, long_text), (4, same), (4, same), (5, same), (6, ITEM), (6, "another text under a known id"), (None, same), (None, None), (7, "\n\n \t")]
    frame(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns(more).write.parquet(f"{at}/odd/documents.parquet")
    for name in ("labels", "benchmark", "embeddings"):
        whole = table(spark, SF, name)
        whole.withColumns({c: f for c, f in more.items() if c not in whole.columns}).write.parquet(f"{at}/odd/{name}.parquet")
        whole.where("false").write.parquet(f"{at}/empty/{name}.parquet")
    table(spark, SF, "documents").where("false").write.parquet(f"{at}/empty/documents.parquet")
    return at, len(rows)


@pytest.mark.parametrize("name", [q for q in queries() if q not in ("op6_ann", "pipeline")])
def test_queries_on_odd_tables(spark, odd_tables, name):
    at, n = odd_tables
    found = queries()[name](spark, f"{at}/odd").collect()
    if name not in ("op3_decontamination", "op4_packing", "op8_token_counts"):
        assert len(found) == n  # a row a row
    if name == "op4_packing":
        assert sum(x.piece == 0 for x in found) == n
    assert queries()[name](spark, f"{at}/empty").count() == 0


def test_pipeline_on_odd_tables(spark, odd_tables):
    at, _ = odd_tables
    found = queries()["pipeline"](spark, f"{at}/odd")
    assert found.where("piece = 0").count() > 3 and queries()["pipeline"](spark, f"{at}/empty").count() == 0
