"""Splitting, encoding, leaks and repetition against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tessera.llm import leaks, repetition, split, tokenizer

LIMIT, LEAST, OVERLAP = 60, 15, 8


def brute(data, limit, least, overlap):
    """The rule, word by word, by trying every byte."""
    n, s, out = len(data), 0, []
    edge = lambda c: c in (0, n) or data[c] & 0xC0 != 0x80

    def blank(c):
        start = data.rfind(b"\n", 0, c - 1) + 1
        return data[c - 1] == 10 and not data[start : c - 1].strip(b" \t\r")

    while n - s > limit:
        ends = range(s + limit, s + least, -1)
        c = next((c for c in ends if blank(c)), None) or next((c for c in ends if data[c - 1] == 10), None) or next(c for c in range(s + limit, 0, -1) if edge(c))
        out.append((s, c))
        s = next((p for p in range(c - overlap, c) if data[p - 1] == 10), None) or next(p for p in range(c - overlap, n) if edge(p))
    return [*out, (s, n)] if n else []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t\r\n\né漢🚀", max_size=400))
def test_pieces_equal_brute_force(t):
    data = t.encode()
    assert split.pieces(data, LIMIT, LEAST, OVERLAP) == brute(data, LIMIT, LEAST, OVERLAP)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\né漢", max_size=400))
def test_balanced_pieces_cover_and_cost_least(t):
    data = t.encode()
    got = split.pieces(data, LIMIT, LEAST, OVERLAP, "total")
    first = split.pieces(data, LIMIT, LEAST, OVERLAP)

    def cost(ps):
        blank, lines = map(set, split.boundaries(data))
        ends = sum(split.WEIGHTS[0 if b in blank else 1 if b in lines else 2] for _, b in ps[:-1])
        return ends + sum(((LIMIT - (b - a)) / LIMIT) ** 2 for a, b in ps)

    assert not data or (got[0][0] == 0 and got[-1][1] == len(data) and all(a2 < b1 and b - a <= LIMIT for (a, b1), (a2, b) in zip(got, got[1:])))
    assert cost(got) <= cost(first) + 1e-9
    for a, b in got:
        data[a:b].decode()


def test_split_rows(spark):
    long = "é" * 3000 + "\n\n" + "x" * 3000
    c = [("a", 10, long, "crumb"), ("a", 10, long, "crumb"), ("b", 0, "short", "s"), ("c", 0, None, None), ("d", None, long, ""), ("e", 0, "", ""), (None, 5, long, None)]
    df = spark.createDataFrame(c, "chunk_id string, byte_start int, code string, breadcrumb string").withColumn("text", F.lit(1)).withColumn("id", F.lit(2))
    got = split.split_oversized(df)
    assert {r.chunk_id for r in got.collect()} == {"a", None}
    assert [(r.byte_start, r.byte_end) for r in got.where("chunk_id = 'a'").orderBy("byte_start").collect()] == [(10 + a, 10 + b) for a, b in split.pieces(long.encode())]
    named = split.split_oversized(df, label_col="breadcrumb").where("chunk_id = 'a'").orderBy("byte_start").collect()
    assert {r.breadcrumb for r in named} == {"crumb"} and all(r.code.encode() == long.encode()[r.byte_start - 10 : r.byte_end - 10] for r in named)
    assert split.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(df, overlap=2000)


TEXTS = [
    None, "", " ", "  two  spaces \n\n\n tabs\t\t", "it's we'll I'D don''t", "naïve 漢字 ٣٤ x²½ 🚀🚀 e\u0301", "<|endoftext|> a<|endoftext|>", "\u00a0nbsp\u2003em\u200bzero\x00\x07\r\n",
    "x" * 5000, " " * 3000, "a1b2_c3 == !== ::", "the cat the cat the", "the cat the cat the",
]


def test_ids_equal_the_tokenizer_and_decode(spark):
    enc = tokenizer._encoding(tokenizer.VOCABULARY)
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("ids", F.lit(2))
    got = tokenizer.encode(df).collect()
    assert len(got) == len(TEXTS)
    assert {r.doc_id: r.ids for r in got} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokenizer.decode(tokenizer.encode(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokenizer.encode(df.limit(0)).count() == 0


def test_ids_do_not_depend_on_what_is_hot(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string")
    plain = rows(tokenizer.encode(df))
    monkeypatch.setattr(tokenizer, "HOT_SHARE", 2.0)  # nothing is
    assert rows(tokenizer.encode(df)) == plain
    monkeypatch.setattr(tokenizer, "HOT_SHARE", 0.0)  # all short words are
    assert rows(tokenizer.encode(df)) == plain


def plain_words(t):
    import regex

    return [w.lower() for w in regex.findall(r"[\p{L}\p{N}_]+", t or "")]


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(6)] + ["É", "x_y", "٣"]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(r.randint(5, 30)))) for i in range(20)] + [(97, None), (98, ""), (99, "short one")]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(some(5) + plain_words(r.choice(items)[1])[2:] + some(5)).upper()) for i in range(60)]
    docs += [(900, None), (901, ""), docs[0]]
    grams = {i: {tuple(plain_words(t)[k : k + 12]) for k in range(len(plain_words(t)) - 11)} for i, t in items}
    want = {(d, i) for d, t in docs for k in range(len(plain_words(t)) - 11) for i in grams if tuple(plain_words(t)[k : k + 12]) in grams[i]}
    d, e = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(-1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(-1))
    got = leaks.leaked(d, e)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and got.count() == len(want) and want
    clean = leaks.scrub(d.distinct(), e)
    assert leaks.leaked(clean, e).count() == 0 and clean.count() == 62
    assert leaks.scrub(d, e, whole=True).where(F.col("doc_id").isin([x for x, _ in want])).count() == 0
    assert leaks.leaked(d.limit(0), e).count() == 0 and leaks.leaked(d, e.limit(0)).count() == 0


@pytest.mark.parametrize("block,most", [(7, 10**6), (2048, 0), (7, 0)])
def test_leaks_do_not_depend_on_blocks_or_broadcast(spark, monkeypatch, block, most):
    r = random.Random(5)
    some = lambda n: [f"w{r.randint(0, 40)}" for _ in range(n)]
    items = [(i, " ".join(some(30))) for i in range(12)]
    docs = [(i, " ".join(some(r.randint(0, 40)) + items[i % 12][1].split()[r.randint(0, 20) :] + some(r.randint(0, 40)))) for i in range(40)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = rows(leaks.leak_hits(d, e).distinct())
    monkeypatch.setattr(leaks, "BLOCK", block)
    assert want and rows(leaks.leak_hits(d, e, most=most).distinct()) == want


def test_leaks_take_time_in_proportion_to_a_text(spark):
    import time

    e = spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(30)))], "item_id long, text string")

    def seconds(n):
        d = spark.createDataFrame([(1, " ".join(f"u{k}" for k in range(n)) + " " + " ".join(f"i{k}" for k in range(30)))], "doc_id long, text string")
        began = time.time()
        assert leaks.leaked(d, e).count() == 1
        return time.time() - began

    seconds(20_000)
    # ten times the words; 1.5 s are allowed for what any job costs
    assert seconds(200_000) < 10 * (seconds(20_000) + 1.5)
    assert seconds(1_000_000) < 60


def test_spans(spark):
    item = " ".join(f"i{k}" for k in range(20))
    d = spark.createDataFrame([(1, "a b " + item + " c " + " ".join(f"i{k}" for k in range(12)))], "doc_id long, text string")
    e = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert rows(leaks.leak_spans(d, e)) == [(1, 2, 7, 21), (1, 23, 7, 34)]


def brute_repeats(w, width=8):
    hit = set()
    for i in range(len(w) - width + 1):
        if any(w[j : j + width] == w[i : i + width] for j in range(i)):
            hit |= set(range(i, i + width))
    return len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeats_equal_brute_force(w):
    assert repetition.repeats(w, 4) == brute_repeats(w, 4)


def test_repetitive_documents(spark):
    phrase = " ".join(f"p{i}" for i in range(8))
    unique = lambda n: " ".join(f"u{i}" for i in range(n))
    docs = [
        (1, unique(24) + " " + phrase + " " + phrase),  # 40 words, 8 repeats: 20 %
        (2, unique(20) + " " + " ".join([phrase] * 3)),  # 44 words, 16 repeats: 36 %
        (3, " ".join([phrase] * 4)),  # too short
        (4, "spam " * 400), (5, None), (6, ""), (2, unique(20) + " " + " ".join([phrase] * 3)), (7, unique(100)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(0)).withColumn("h", F.lit(0))
    assert rows(repetition.repetitive(df)) == [(2,), (4,)]
    assert {(r.doc_id, r.n_words, r.n_repeats) for r in repetition.repeated_share(df).collect()} == {(1, 40, 8), (2, 44, 16), (4, 400, 399)}
    assert repetition.repetitive(df.limit(0)).count() == 0


def test_divergence_ranks_odd_documents(spark):
    docs = [(i, "the cat sat on the mat and looked at the other cats in the yard " * 4, "en") for i in range(20)] + [(99, "$$$ !!! 777 " * 60 + " x" * 40, "EN "), (100, None, None)]
    got = {r.doc_id: (r.js_chars, r.js_words) for r in repetition.divergence(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert 100 not in got and got[99][0] > got[0][0] and got[99][1] > got[0][1] and all(0 <= x <= 1 for v in got.values() for x in v)
