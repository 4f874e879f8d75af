"""Randomised differential tests: every answer against brute force, on hand-made and given collections."""

import random

import pytest
from pyspark.sql import functions as F

from needlework.functions import text as fn
from needlework.operators import ingest, lists, occurrence, phrases, topk
from needlework.plans.index import TopkIndex
from needlework.plans.workload import k_schedule, run_patterns
from needlework.sources import collections as src


def docs(spark, texts):
    return src.corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def tf(text, p):
    return sum(text.startswith(p, i) for i in range(len(text) - len(p) + 1))


def brute(texts, p, k):
    found = [(tf(t, p), len(t.encode()), i) for i, t in enumerate(texts)]
    return [(i, n) for n, size, i in sorted((x for x in found if x[0]), key=lambda x: (-x[0], -x[1], x[2]))][:k]


def answer(df):
    return [(r.doc_id, r.tf) for r in df.collect()]


@pytest.mark.parametrize(
    ("texts", "p", "k", "expected"),
    [
        (["aaaa", "aa"], "aa", 2, [(0, 3), (1, 1)]),
        (["ab", "abxx", "abyy"], "ab", 2, [(1, 1), (2, 1)]),
        (["x", "xy", "z"], "x", 10, [(1, 1), (0, 1)]),
        (["ab", "cd"], "bc", 5, []),
        (["a b", "b"], "b", 1, [(0, 1)]),
        (["a", "b"], "==", 3, []),
        (["a.b", "axb"], "a.b", 3, [(0, 1)]),
        (["Viè", "Vie"], "iè", 3, [(0, 1)]),
        (["a\\Eb\nc", "a\\b"], "\\Eb\nc", 3, [(0, 1)]),
        ([None, "", "a_a"], "_", 3, [(2, 1)]),
    ],
)
def test_cases(spark, texts, p, k, expected):
    assert answer(topk.topk_documents(docs(spark, texts), p, k)) == expected
    table = spark.createDataFrame([(7, p, k)], "pattern_id long, pattern string, k int")
    assert sorted(answer(topk.topk_batch(docs(spark, texts), table, 10))) == sorted(expected)


def test_refused(spark):
    own = docs(spark, ["a"])
    for p in ("", "a\x01"):
        with pytest.raises(ValueError):
            topk.topk_documents(own, p, 1)
    with pytest.raises(ValueError):
        topk.topk_documents(own, "a", 0)
    with pytest.raises(ValueError):
        topk.topk_batch(own, spark.createDataFrame([(0, "a", 9)], "pattern_id long, pattern string, k int"), 5)


@pytest.fixture(scope="module")
def random_texts():
    r = random.Random(4)
    return ["".join(r.choice("ab.é \n") for _ in range(r.randint(0, 60))) for _ in range(40)]


def test_random_patterns(spark, random_texts):
    r, own = random.Random(9), docs(spark, random_texts).cache()
    rows = []
    for m in range(1, 8):
        for k in k_schedule(len(random_texts))[::4]:
            t = r.choice([x for x in random_texts if len(x) >= m])
            at = r.randrange(len(t) - m + 1)
            rows.append((len(rows), t[at : at + m], k))
    table = spark.createDataFrame(rows, "pattern_id long, pattern string, k int")
    expected = {(i, rank + 1, *d) for i, p, k in rows for rank, d in enumerate(brute(random_texts, p, k))}
    for frequencies in (occurrence.tf_scan, occurrence.tf_automaton):
        found = topk.rank_within(frequencies(own, table), ["pattern_id"], 20).join(table, "pattern_id").where("rank <= k")
        assert {(x.pattern_id, x.rank, x.doc_id, x.tf) for x in found.collect()} == expected


def test_stored_lists_answer_as_search_does(spark, random_texts):
    own = docs(spark, random_texts).cache()
    stored = lists.build_gram_lists(own, 2, 3, len(random_texts)).cache()
    grams = [*sorted({t[i : i + 2] for t in random_texts for i in range(len(t) - 1)})[:25], "zz", "q"]
    rows = [(i, p, 1 + i % 12) for i, p in enumerate(grams)]
    table = spark.createDataFrame(rows, "pattern_id long, pattern string, k int")
    found = lists.routed_topk(own, table, stored, 12)
    assert {(x.pattern_id, x.rank, x.doc_id, x.tf) for x in found.collect()} == {(i, n + 1, *d) for i, p, k in rows for n, d in enumerate(brute(random_texts, p, k))}
    by_list, missed = lists.from_lists(table, stored), lists.misses(table, stored)
    assert 0 < missed.count() < len(rows)
    assert {x.pattern_id for x in by_list.collect()}.isdisjoint({x.pattern_id for x in missed.collect()})
    for x in stored.collect():
        assert x.k_star == (x.n_docs if x.is_complete else next(2**e for e in range(40) if 3 * 2**e > x.occ))


def test_phrase_lists(spark):
    texts = ["abababab", "babab", "aab"]
    own = docs(spark, texts)
    stored = lists.build_phrase_lists(own, phrases.lz78_phrases(own, "collection"), 2, 3)
    found = {x.pattern: [(d.doc_id, d.tf) for d in x.docs] for x in stored.collect()}
    assert set(found) >= {"a", "b", "ab"}
    for p, own_list in found.items():
        assert own_list == brute(texts, p, len(own_list))


@pytest.mark.parametrize("scope", ["document", "collection"])
def test_phrases(spark, random_texts, scope):
    own = docs(spark, random_texts).cache()
    table = phrases.lz78_phrases(own, scope).cache()
    rows = table.orderBy("doc_id", "phrase_id").collect()
    spelled = {}
    for x in rows:
        assert x.start_pos == len(spelled.get(x.doc_id, ""))
        spelled[x.doc_id] = spelled.get(x.doc_id, "") + x.ptext
    assert spelled == {i: t + "\x01" for i, t in enumerate(random_texts)}
    trie = lambda x: x.doc_id if scope == "document" else None
    known = {(trie(x), x.phrase_id): x.ptext for x in rows}
    assert len(known) == len(rows)
    for x in rows:
        assert x.ptext[-1] == x.symbol
        assert x.ptext[:-1] == (known[trie(x), x.parent_id] if x.parent_id is not None else "")
    for p in ("a", "ab", "a a", "ba.a", "aa"):
        expected = {i: tf(t, p) for i, t in enumerate(random_texts) if tf(t, p)}
        assert {x.doc_id: x.tf for x in phrases.occ_all_types(table, p).collect()} == expected
        kinds = {1: phrases.occ_type1, 2: phrases.occ_type2, 3: phrases.occ_type3}
        located = phrases.occurrence_types(table, occurrence.locate_positions(own, p), len(p))
        assert {(x.doc_id, x.occ_type, x.occ) for x in located.collect()} == {(x.doc_id, kind, x.occ) for kind, f in kinds.items() for x in f(table, p).collect()}


@pytest.mark.parametrize("scope", ["document", "collection"])
def test_phrase_navigation(spark, random_texts, scope):
    own = docs(spark, random_texts)
    table = phrases.lz78_phrases(own, scope).cache()
    rows = table.orderBy("doc_id", "phrase_id").collect()
    trie = lambda x: x.doc_id if scope == "document" else None
    key = lambda x: (x.doc_id, x.phrase_id)
    pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if trie(a) == trie(b)]
    inside = [(a, b) for a, b in pairs if a.doc_id == b.doc_id]
    assert {(*key(x), x.next_id) for x in phrases.adjacent(table, scope).collect()} == {(*key(a), b.phrase_id) for a, b in pairs}
    assert {(*key(x), x.next_id) for x in phrases.next_phrase(table).collect() if x.next_id} == {(*key(a), b.phrase_id) for a, b in inside}
    asked = {(*key(a), b.phrase_id) for a, b in inside if a.ptext.endswith("a") and b.ptext.startswith("b")}
    assert {(*key(x), x.next_id) for x in phrases.range_report(table, "a", "b").collect()} == asked
    assert {key(x) for x in phrases.range_exists(table, "a").collect()} == {key(b) for a, b in inside if a.ptext.endswith("a")}
    # ranks of each trie: gapless, in order of strings, and their boxes report what string tests do
    for ranked, name, string in ((phrases.preorder, "preorder", lambda x: x.ptext), (phrases.reverse_order, "rev_rank", lambda x: "\x01" if x.is_terminal else x.ptext[::-1])):
        found = {key(x): getattr(x, name) for x in ranked(table, scope).collect()}
        for one in {trie(x) for x in rows}:
            order = sorted((x for x in rows if trie(x) == one), key=lambda x: (string(x), -x.phrase_id))
            assert [found[key(x)] for x in order] == list(range(1, len(order) + 1))
    if scope == "collection":
        head = [x.rev_rank for x in phrases.reverse_order(table, scope).collect() if x.ptext.endswith("a")]
        tail = [x.preorder for x in phrases.preorder(table, scope).collect() if x.ptext.startswith("b")]
        box = phrases.grid_range(phrases.grid(table, scope), min(head), max(head), min(tail), max(tail))
        assert {(*key(x), x.next_id) for x in box.collect()} == asked
        assert {x.phrase_id: x.doc_id for x in phrases.phrase_to_document(table, table.select("phrase_id"), 16).collect()} == {x.phrase_id: x.doc_id for x in rows}
        assert phrases.subtree_size(table, "a", scope).first().n_phrases == sum(x.ptext.startswith("a") for x in rows)
        assert phrases.doc_array(table, scope).select("preorder").distinct().count() == len(rows)
    real = {(trie(x), x.ptext) for x in rows if not x.is_terminal}
    nodes = {(t, p[i:]) for t, p in real for i in range(len(p))}
    unreal = nodes - real
    below = {n: [x for x in nodes if x[0] == n[0] and x[1][1:] == n[1]] for n in unreal}
    extra = {n for n in unreal if len(below[n]) == 1 and below[n][0] in unreal}
    counted = phrases.fictitious_nodes(table, scope).collect()
    assert sum(x.n_extra for x in counted) == len(extra) and sum(x.n_fictitious for x in counted) == len(unreal) - len(extra)
    factors = {(*key(x), x.i, x.j) for x in phrases.pattern_factors(table, "aba").collect()}
    assert factors == {(*key(x), i + 1, j) for x in rows if not x.is_terminal for i in range(3) for j in range(i + 1, 4) if "aba"[i:j] == x.ptext}


def test_types_of_a_collection(spark, sf):
    """Known numbers of occurrences by type under one dictionary over all documents."""
    own = src.corpus(src.table(spark, sf, "documents"))
    table = phrases.lz78_phrases(own, "collection").cache()
    for p, expected in {"on": (8098, 1706, 0), "the": (4031, 1126, 0), "ata": (133, 77, 0), "tion the": (35, 85, 1)}.items():
        found = phrases.occurrence_counts(table, p).agg(*[F.sum(c).alias(c) for c in ("occ1", "occ2", "occ3")]).first()
        assert tuple(found) == expected


def test_ids_of_any_size(spark):
    own = src.corpus(spark.createDataFrame([(None, "ab"), (1 << 40, "abab"), (-5, ""), (7, None)], "doc_id long, text string"))
    for scope in phrases.SCOPES:
        found = phrases.lz78_phrases(own, scope).orderBy("doc_id", "phrase_id").collect()
        assert [(x.doc_id, x.ptext) for x in found] == [(-5, "\x01"), (1 << 40, "a"), (1 << 40, "b"), (1 << 40, "ab"), (1 << 40, "\x01")]
    assert lists.build_phrase_lists(own.where("false"), phrases.lz78_phrases(own.where("false")), 2, 0).count() == 0


def test_positions_and_offsets(spark, random_texts):
    own = docs(spark, random_texts)
    offsets = ingest.doc_offsets(own, 3).cache()
    at, expected = 0, {}
    for i, t in enumerate(random_texts):
        expected[i] = (at, at + len(t) + 1)
        at += len(t) + 1
    assert {x.doc_id: (x.doc_start, x.doc_end) for x in offsets.collect()} == expected
    asked = spark.range(0, at, 7).select(F.col("id").alias("text_pos"))
    for x in ingest.position_to_document(offsets, asked, 16).collect():
        lo, hi = expected[x.doc_id]
        assert lo <= x.text_pos < hi
    assert ingest.position_to_document(offsets, asked, 16).count() == asked.count()
    assert {(x.doc_id, x.pos) for x in occurrence.locate_positions(own, "aa").collect()} == {(i, j) for i, t in enumerate(random_texts) for j in range(len(t)) if t.startswith("aa", j)}


def test_readers(spark, tmp_path):
    assert [r.text for r in spark.createDataFrame([("p##q#",)], "t string").select(F.explode(fn.documents_of(F.col("t"), "#")).alias("text")).collect()] == ["p\n", "q"]
    single = tmp_path / "single.txt"
    single.write_text("#p##q#!")
    assert [r.text for r in src.read_single_file(spark, str(single), "#").orderBy("doc_id").collect()] == ["", "p\n", "q"]
    names = []
    for i, body in enumerate([b"Ab\xc3\xa9.", b"x", b"CD\x01e\n"]):
        (tmp_path / f"f{i}").write_bytes(body)
        names.append(str(tmp_path / f"f{i}"))
    (tmp_path / "list").write_text("\n".join(names))
    assert [(r.doc_id, r.text) for r in src.read_file_list(spark, str(tmp_path / "list")).orderBy("doc_id").collect()] == [(0, "Ab  "), (1, "CD e")]
    assert [r.text for r in src.read_file_list(spark, str(tmp_path / "list"), lower=True).orderBy("doc_id").collect()] == ["ab  ", "cd e"]
    (tmp_path / "patterns").write_text("ab\nabc\na b c\n" + "x" * 100 + "\n")
    assert [r.pattern for r in src.read_patterns(spark, str(tmp_path / "patterns")).collect()] == ["abc", "a b c"]
    assert [r.pattern for r in src.read_patterns(spark, str(tmp_path / "patterns"), most_spaces=1).collect()] == ["abc"]
    (tmp_path / "ini").write_text("[GLOBALS]\nTEST=1\nN_REP=7\n[TOPK]\ng=16\ninputFile=/a/b\nfilesInList=0\nlowercase=1\nboundSymbol=10\ncutDoc=1\n")
    s = src.Settings.load(spark, str(tmp_path / "ini"))
    assert (s.g, s.input_file, s.files_in_list, s.lowercase, s.delimiter, s.repetitions, s.test) == (16, "/a/b", False, True, "\n", 7, True)


def test_listed_files_are_taken_once_each(spark, tmp_path):
    names = []
    for name, body in {"ba.txt": "beta one.", "a.txt": "beta two.", "a[1]{x}*?.txt": "odd name.", "empty": "", "two words": "with blanks."}.items():
        (tmp_path / name).write_text(body)
        names.append(str(tmp_path / name))
    (tmp_path / "list").write_text("\n".join([*names, names[1]]) + "\n\n")
    found = src.read_file_list(spark, str(tmp_path / "list")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in found] == [(0, "beta one"), (1, "beta two"), (2, "odd name"), (3, "with blanks"), (4, "beta two")]
    (tmp_path / "none").write_text("")
    assert src.read_file_list(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("body", ["p##q#!", "##p#q##", "p", "#", "", "a#b#c" * 40 + "##d#"])
def test_single_files_are_read_in_splits(spark, tmp_path, body):
    (tmp_path / "one").write_text(body)
    whole = spark.createDataFrame([(body[:-1],)], "t string").select(F.posexplode(fn.documents_of(F.col("t"), "#"))).collect() if body else []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32b")
    try:
        found = src.read_single_file(spark, str(tmp_path / "one"), "#").orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.doc_id, r.text) for r in found] == [(r.pos, r.col) for r in whole]


def test_numbers_of_many_ranges(spark):
    rows = spark.range(0, 50_000, 1, 7).select((F.col("id") * 7919 % 50_000).alias("id"), F.lit("x" * 50).alias("other"))
    found = src.numbered(rows, "id", parts=13)
    assert found.where("doc_no <> id").count() == 0 and found.count() == 50_000


@pytest.mark.parametrize("gram", [2, None])
def test_index_round_trip(spark, random_texts, tmp_path, gram):
    own = docs(spark, random_texts)
    built = TopkIndex.build(own, g=3, gram=gram, block_bytes=200)
    built.save(str(tmp_path / "index"))
    index = TopkIndex.load(spark, str(tmp_path / "index"))
    for p in ("a", "ab", "b. a", "zz"):
        for k in (1, 50):
            assert answer(index.topk(p, k)) == brute(random_texts, p, k)
    asked = [(0, "a"), (1, random_texts[3][:4]), (2, "zzz"), (3, random_texts[5][2:12])]
    found = index.search(spark.createDataFrame(asked, "pattern_id long, pattern string")).collect()
    assert {(x.pattern_id, x.doc_id, x.tf) for x in found} == {(i, d, n) for i, p in asked for d, n in brute(random_texts, p, 99)}
    blocks = index.candidate_blocks(spark.createDataFrame(asked, "pattern_id long, pattern string")).groupBy("pattern_id").count().collect()
    every, blocks = index.meta.first().blocks, {x.pattern_id: x["count"] for x in blocks}
    assert blocks[0] == every > 4 and 2 not in blocks and 0 < blocks[3] < every
    totals = index.totals().first()
    assert totals.n_docs == len(random_texts) and totals.n_lists == index.topk_lists.count() and totals.n_nodes == index.phrases.count() + 1
    assert index.bits_per_character(str(tmp_path / "index")) > 0
    assert run_patterns(own, ["ab", "a."], 3).mean_us > 0


ODD = [(0, "abab\x00ab\x00"), (0, "ab\x00abab"), (0, "abba"), (None, "abab"), (None, "baba"), (3, "😀a😀a😀a"), (4, "è è è è"), (5, ""), (6, "a"), (7, None), (8, "ab\nab\nab😀"), (9, "ab" * 40)]


@pytest.mark.parametrize(("m", "sent"), [(1, True), (3, False)])
def test_lists_by_code_are_those_by_string(spark, monkeypatch, m, sent):
    own = src.corpus(spark.createDataFrame(ODD, "doc_id long, text string"))
    as_rows = lambda df: {(x.pattern, x.occ, x.n_docs, x.is_complete, x.k_star, tuple(map(tuple, x.docs))) for x in df.collect()}
    expected = as_rows(lists._stored(lists.staged(lists.gram_frequencies(own, m), "f"), 2, 11)[1])
    monkeypatch.setattr(lists, "gram_frequencies", None)  # all pairs of substring and document as strings
    if not sent:
        monkeypatch.setattr(lists, "BROADCAST_ROWS", 0)
    assert as_rows(lists.build_gram_lists(own, m, 2, 11)) == expected and len(expected) > 2
    assert not any("?" in x[0] for x in expected)  # half a surrogate pair


def test_lists_of_long_substrings_and_of_none(spark):
    long_ones = lists.build_gram_lists(docs(spark, ["".join(map(chr, range(97, 123))) * 3]), 20, 2, 1).collect()  # 26**20 is no code
    assert {x.occ for x in long_ones} == {3} and len(long_ones) == 7
    assert lists.build_gram_lists(docs(spark, ["abc", ""]), 4, 2, 2).count() == 0 and lists.build_gram_lists(docs(spark, ["abcdef"]), 4, 2, 1).count() == 0


def test_counts_of_large_alphabets():
    import numpy as np
    import pyarrow as pa

    from needlework.functions import codes

    texts = [["abcabc"], ["bca", "bcabca"], []]
    alphabet = np.arange(ord("a"), ord("a") + (1 << 20))
    code, row, n = codes.counted(pa.array(texts, pa.list_(pa.string())), 3, codes.ranks(alphabet[alphabet < codes.CODE_POINTS]), 1 << 20)
    names = [chr(97 + (c >> 40)) + chr(97 + (c >> 20 & 0xFFFFF)) + chr(97 + (c & 0xFFFFF)) for c in code.tolist()]
    assert set(zip(names, row.tolist(), n.tolist(), strict=True)) == {("abc", 0, 2), ("bca", 0, 1), ("cab", 0, 1), ("bca", 1, 3), ("cab", 1, 1), ("abc", 1, 1)}


def test_index_by_parts(spark, random_texts, tmp_path):
    own, path = docs(spark, random_texts), str(tmp_path / "index")
    index = TopkIndex.build(own, path, g=3, gram=2, block_bytes=200, parts=["topk_lists"])
    assert index.corpus is index.postings is index.phrases is None and index.topk_lists.count() > 0
    index = TopkIndex.build(own, path, g=3, gram=2, block_bytes=200, parts=["corpus", "postings"])
    index.save(str(tmp_path / "copy"))
    copy = TopkIndex.load(spark, str(tmp_path / "copy"))
    for p in ("a", "ab", "b. a", "zz"):
        assert answer(copy.topk(p, 50)) == brute(random_texts, p, 50)
    blocks = copy.corpus.groupBy("block").agg(F.sum(F.col("doc_length") + 1).alias("n"), F.max(F.col("doc_length") + 1).alias("last")).collect()
    assert len(blocks) == copy.meta.first().blocks > 4 and all(x.n < 200 + x.last for x in blocks)
    posted = {(x.gram, x.block) for x in copy.postings.collect()}
    assert posted == {(x.text[i : i + 3], x.block) for x in copy.corpus.collect() for i in range(len(x.text) - 2)} and len(posted) == copy.postings.count()
    assert copy.phrases is None and copy.totals().first().n_nodes == phrases.lz78_phrases(own).count() + 1


def test_small_blocks_are_written_by_few_tasks(spark, random_texts):
    from needlework.plans.index import _blocked

    dealt = _blocked(docs(spark, random_texts), 1000, 20)
    assert dealt.rdd.getNumPartitions() <= 8 < dealt.select("block").distinct().count()


ASKED = {
    "topk_cache_misses": ["topk_lists"],
    "topk_from_lists": ["topk_lists"],
    "topk_routed": ["topk_lists"],
    "topk_indexed": ["corpus", "postings"],
    "topk_after_reload": ["corpus", "postings", "topk_lists"],
}


@pytest.mark.parametrize("name", ASKED)
def test_only_asked_parts_are_built(spark, monkeypatch, sf, name):
    from needlework import catalogue
    from needlework.plans.index import saved_parts

    monkeypatch.setattr(catalogue, "_built", {})
    assert catalogue.queries()[name](spark, sf).count() > 0
    assert saved_parts(spark, *catalogue._built.values()) == [*ASKED[name], "meta"]


def test_symbols(spark, random_texts):
    from collections import Counter

    own = docs(spark, random_texts)
    counted = Counter("".join(random_texts))
    assert {x.symbol: x.freq for x in ingest.symbol_histogram(own).collect()} == counted
    ranked = ingest.symbol_priority(ingest.symbol_histogram(own)).collect()
    assert [x.symbol for x in sorted(ranked, key=lambda x: x.rank)] == sorted(counted, key=lambda c: (-counted[c], c))
    drawn = ingest.sample_patterns(own, 3, 10).collect()
    assert len(drawn) == 10
    for x in drawn:
        assert random_texts[x.doc_id][x.pos : x.pos + 3] == x.pattern and len(set(x.pattern)) > 1
    assert ingest.corpus_stats(docs(spark, [])).first().n_docs == 0


def test_stream(spark, tmp_path, random_texts):
    from needlework.streaming.append import standing, watch

    table = spark.createDataFrame([(0, "ab", 5), (1, "a", 2)], "pattern_id long, pattern string, k int")
    rows = list(enumerate(random_texts))
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        watch(stream, table, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {(x.pattern_id, x.rank, x.doc_id, x.tf) for x in standing(spark, table, str(tmp_path / "out"), 5).collect()}
    assert found == {(i, n + 1, *d) for i, p, k in ((0, "ab", 5), (1, "a", 2)) for n, d in enumerate(brute(random_texts, p, k))}
