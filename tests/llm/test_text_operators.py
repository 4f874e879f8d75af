"""Personal data, token ids, packing, sharding: against plain definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from needlework.llm import packing, pii, sharding
from needlework.llm.tokens import WordBpe, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


# -- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in twice) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(s, e, k) for s, _, k, e in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1205.@+- ()%é\n", max_size=60) | st.text(alphabet="0145 -.+@a", max_size=40))
def test_base_spans_follow_the_patterns(text):
    assert [x[:3] for x in pii.find_spans(text) if x.kind in pii.BASE_KINDS] == plain_spans(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [x.kind for x in pii.find_spans(t)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32 end") == ["iban"]
    assert kinds("iban GB82 WEST 1234 5698 7654 33 end") == []
    assert kinds("my social security number is 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    assert kinds('token = "0123456789abcdef0123"') == ["secret"]
    assert kinds(None) == kinds("") == []
    text = "é mail a.b@c.de or +1 (555) 555-0100."
    assert pii.redact(text, pii.find_spans(text)) == "é mail [EMAIL] or [PHONE]."


def test_ibans_end_where_the_checksum_holds():
    german, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    said = lambda t: [t[x.start : x.end] for x in pii.find_spans(t) if x.kind == "iban"]
    assert said(f"IBAN: {german} BIC: COBADEFFXXX") == [german]
    assert said("DE89370400440532013000 12 EUR") == ["DE89370400440532013000"]
    assert said(f"{german} {british} {german} AND MORE") == [german, british, german]
    assert said(f"AB12 {german}") == [german] and said(f"{german}a") == []


def test_long_secrets_go_whole():
    text = "token=" + "a1" * 200 + " end"
    assert pii.redact(text, pii.find_spans(text)) == "token=[SECRET] end"
    pii.find_spans("token=" * 50_000 + "a" * 300_000)


def test_context_stands_on_both_sides():
    spans = lambda t: [x.kind for x in pii.find_spans(t)]
    assert spans("my ssn is 123-45-6789") == spans("123-45-6789 is my ssn") == ["ssn"]
    assert spans("123-45-6789 " + "x " * 40 + "ssn") == spans("part 123-45-6789, ssn") == []


def test_long_runs_are_linear():
    import time

    began = time.time()
    for run in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "a@" * 150_000):
        pii.find_spans(run)
    assert time.time() - began < 20


def test_pii_report(spark):
    texts = ["x a@b.cd 1.2.3.4", None, "", "é +12 345 678 90", "x a@b.cd 1.2.3.4"]
    docs = frame(spark, texts).withColumn("spans", F.lit(1)).withColumn("score", F.lit("x"))
    found = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    assert len(found) == 5
    for i, t in enumerate(texts):
        said = ",".join(f"{k}:{s}:{e}" for s, e, k in plain_spans(t or ""))
        assert found[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and found[i].spans == said
    assert (found[0].n_email, found[0].n_ip, found[3].n_phone) == (1, 1, 1)
    clean = {r.doc_id: r for r in pii.pii_redact(frame(spark, texts)).collect()}
    assert clean[0].text == "x [EMAIL] [IP]" and clean[0].n_chars == 14 and clean[1].text is None
    assert pii.pii_redact(docs).columns == docs.columns
    assert pii.pii_report(docs.where("false")).count() == 0


# -- token ids and packing

PATH = vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdehiorstuvÉéßµ²½ \n\t'’.,!?#$-0189\x01\xa0\xad", max_size=60))
def test_ids_are_the_librarys(text):
    own = test_ids_are_the_librarys.__dict__.setdefault("own", WordBpe(PATH))
    assert own.fast is not None
    assert own.encode(text).tolist() == own.slow.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    seen = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = []
    for i, t in texts:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert seen == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pack(spark, capacity):
    r = random.Random(3)
    texts = [None, "", "same text here", "same text here", "naïve ünïcode ⅷ Ⅷ 語", *(" ".join(r.choice(["the", "antioned", "12,5", "ß!"]) for _ in range(r.randint(1, 90))) for _ in range(150)), "word " * 9000]
    docs = frame(spark, texts).withColumn("rank", F.lit(9)).withColumn("length", F.lit("no"))
    rows = packing.pack(docs, PATH, capacity).collect()
    used = check_packing(rows, list(enumerate(texts)), capacity)
    assert used <= -(-sum(x.length for x in rows) // capacity) * 1.05 + 2


def test_pack_edges(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0
    rows = packing.pack(frame(spark, ["a b"] * 70, [None] * 70), PATH, 8).collect()
    assert len(rows) == 70 and len({(x.sequence_id, x.offset) for x in rows}) == 70
    ids = packing.pack(frame(spark, ["the end"]), PATH, with_ids=True).first()
    assert ids.ids[-1] == 1 and zlib.crc32(np.array(ids.ids, "<u4").tobytes()) == ids.ids_crc32


def test_ranks_of_hot_lengths_are_gapless(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).cast("long").alias("length"), F.col("id").alias("ids_crc32"), F.col("id").alias("row_no"))
    got = sorted(r["rank"] for r in packing.ranked(pieces, {7: 5000}, group_rows=100).collect())
    assert got == list(range(5000))


@pytest.mark.parametrize(
    ("histogram", "least"),
    [({1400: 1000, 50: 300}, 500), ({3000: 500, 1000: 900, 96: 300}, 600), ({2049: 100, 2047: 99}, 100), ({4096: 7}, 7), ({1: 5}, 1), ({}, 0), ({n: 30 for n in range(1, 4096, 7)}, None)],
)
def test_plans(histogram, least):
    plan = packing.plan_packing(histogram)
    bound = -(-sum(n * k for n, k in histogram.items()) // 4096)
    assert plan.sequences <= (least if least is not None else bound) * 1.02 + 1
    used = {}
    for n, k in histogram.items():
        s, o = plan.place(np.full(k, n), np.arange(k))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            used.setdefault(a, []).append((b, n))
    for places in used.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 4096


_R = np.random.default_rng(0)
TRAPS = {
    "small ones belong beside large ones": (100, {51: 1000, 25: 1000, 24: 1000}),
    "quarters": (4096, {2149: 500, 1074: 500, 1224: 500, 874: 1000}),
    "thirds": (4096, dict(Counter(np.concatenate([_R.integers(1300, 1500, 3000), _R.integers(2000, 2600, 2000), _R.integers(100, 700, 1500)]).tolist()))),
}


@pytest.mark.parametrize("name", TRAPS)
def test_weights_solve_the_program(name):
    capacity, histogram = TRAPS[name]
    plan, plain = packing.plan_packing(histogram, capacity), packing.plan_packing(histogram, capacity, rate=0.0)
    best_fit = sum(x for _, x in packing.best_fit(list(histogram.items()), capacity))
    assert plan.bound <= plan.sequences <= plan.bound * 1.015 + 1
    assert plan.sequences <= best_fit and plan.sequences < 0.95 * plain.sequences
    assert abs(plan.gap - (plan.sequences / plan.bound - 1)) < 1e-12
    if name == "quarters":
        assert plan.sequences < 0.95 * best_fit and plan.bound > 1.02 * sum(n * k for n, k in histogram.items()) / capacity


def test_bound_holds_for_small_programs():
    r = random.Random(5)

    def least(items, capacity):  # by trying all
        best = [len(items)]

        def go(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for i, room in enumerate(rooms):
                if room >= items[k] and room not in rooms[:i]:
                    go(k + 1, [*rooms[:i], room - items[k], *rooms[i + 1 :]])
            go(k + 1, [*rooms, capacity - items[k]])

        go(0, [])
        return best[0]

    for _ in range(25):
        capacity = r.randint(8, 30)
        items = sorted((r.randint(1, capacity - 1) for _ in range(r.randint(1, 9))), reverse=True)
        plan = packing.plan_packing(Counter(items), capacity)
        assert plan.bound <= least(items, capacity) + 1e-9 <= plan.sequences + 1e-9 and plan.sequences <= least(items, capacity) + 1


def test_best_fit_in_runs_is_best_fit():
    r = random.Random(9)
    for _ in range(40):
        capacity = r.randint(10, 60)
        counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 8))}
        rooms = []
        for n in sorted(Counter(counts).elements(), reverse=True):
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
        runs = packing.best_fit(list(counts.items()), capacity)
        assert sum(x for _, x in runs) == len(rooms)
        assert Counter({n: sum(f.get(n, 0) * x for f, x in runs) for n in counts}) == Counter(counts)


def test_repeated_rows_are_no_hot_group(spark):
    docs = frame(spark, ["same text"] * 3000, [1] * 3000).repartition(4)
    pieces = packing.token_pieces(docs, PATH).withColumn("row_no", F.monotonically_increasing_id()).cache()
    ((n, k),) = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}.items()
    rows = packing.ranked(pieces, {n: k}, group_rows=100)
    assert sorted(r["rank"] for r in rows.collect()) == list(range(3000))
    groups = pieces.groupBy(F.pmod(F.xxhash64("row_no"), F.lit(30))).count().agg(F.max("count")).first()[0]
    assert groups < 200


def test_price_is_optimal():
    r = random.Random(2)
    for _ in range(60):
        capacity = r.randint(5, 25)
        lengths = sorted(r.sample(range(1, capacity + 1), r.randint(1, 4)))
        counts, gains = [r.randint(1, 4) for _ in lengths], [r.random() for _ in lengths]
        best = {0: 0.0}
        for n, g, k in zip(lengths, gains, counts, strict=True):
            best = _fold(best, n, g, k, capacity)
        found = packing.price(np.array(lengths), np.array(gains), np.array(counts), capacity)
        assert sum(n * k for n, k in found.items()) <= capacity
        assert abs(sum(gains[lengths.index(n)] * k for n, k in found.items()) - max(best.values())) < 1e-9


def _fold(best, n, g, k, capacity):
    out = {}
    for c, v in best.items():
        for j in range(k + 1):
            if c + j * n <= capacity:
                out[c + j * n] = max(out.get(c + j * n, 0.0), v + j * g)
    return out


# -- sharding


def check_shards(rows, texts, shards):
    size = {i: len((t or "").encode()) + 1 for i, t in texts}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert all(0 <= r.shard < shards for r in rows)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((size[i], zlib.crc32((t or "").encode())) for i, t in texts)
    return [sum(r.size for r in by.get(k, [])) for k in range(shards)]


@pytest.mark.parametrize("rows_per_range", [None, 20])
def test_shards_of_equal_bytes(spark, rows_per_range):
    r = random.Random(8)
    texts = [None, "", "é"] + ["hot copy"] * 900 + ["x" * r.randint(1, 400) for _ in range(2000)]
    docs = frame(spark, texts).withColumn("shard", F.lit("mine")).withColumn("key", F.lit(1))
    rows = sharding.shard(docs, 8, rows_per_range=rows_per_range).collect()
    sizes = check_shards(rows, list(enumerate(texts)), 8)
    share = sum(sizes) / 8
    assert max(abs(s - share) for s in sizes) <= 0.01 * share + 400


def test_shards_edges(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    one = sharding.shard(frame(spark, ["a"]), 8).collect()
    assert [(x.shard, x.slot) for x in one] in [[(k, 0)] for k in range(8)]
    twice = sharding.shard(frame(spark, ["a", "a", "a"], [None, 4, 4]), 2).collect()
    assert len(twice) == 3 and len({(x.shard, x.slot) for x in twice}) == 3
    kept = sharding.shard(frame(spark, ["a", "b"]), 2, keep=("text",)).collect()
    assert sorted(x.text for x in kept) == ["a", "b"]
    with pytest.raises(ValueError):
        sharding.shard(frame(spark, []), 0)


def test_kept_columns_keep_their_values(spark):
    names = ["key", "leaf", "leaf_bits", "first_slot", "part", "row_no", "kept", "text"]
    docs = frame(spark, ["a", "b", None]).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names[:-1]})
    rows = sharding.shard(docs, 2, keep=tuple(names)).collect()
    assert {r.doc_id: tuple(r[c] for c in names) for r in rows} == {r.doc_id: tuple(r[c] for c in names) for r in docs.collect()}
    with pytest.raises(ValueError):
        sharding.shard(docs, 2, keep=("Size",))


@pytest.mark.parametrize("ids", [[None] * 3000, [4] * 3000])
def test_a_single_key_is_cut_too(spark, ids):
    docs = frame(spark, ["hot " * 30] * 3000 + ["x" * (i % 300) for i in range(3000)], ids + list(range(10, 3010))).repartition(3)
    rows = sharding.shard(docs, 8, rows_per_range=200).collect()
    sizes = check_shards(rows, [(i, "hot " * 30) for i in range(3000)] + [(3000 + i, "x" * (i % 300)) for i in range(3000)], 8)
    assert max(abs(s - sum(sizes) / 8) for s in sizes) <= 0.01 * sum(sizes) / 8 + 400
